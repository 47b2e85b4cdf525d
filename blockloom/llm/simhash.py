"""SimHash near-duplicates (operator 7): fingerprints linked at 2 or fewer differing bits.

Pivot distance tables: every fingerprint's Hamming distances to reference fingerprints are
computed once, and pairs are found and dropped by them.

* Search references: the zero fingerprint and 32 references with two set bits each, no bit
  in two of them. A fingerprint's distance to one of these, less its distance to zero, is a
  coordinate of three possible values. Two linked fingerprints differ in at most two of the
  32 coordinates. The coordinates are dealt to GROUPS groups; linked pairs agree on all but
  two groups, so candidates are the pairs that agree on one of the 15 choices of four
  groups. The keys of the candidate join are these distances and nothing else.
* Bounding references: PIVOTS fingerprints made by a rule. By the triangle inequality a
  pair whose distances to any of them differ by more than the radius can't be linked; the
  join drops it by the largest coordinate difference, and survivors are verified.

A key shared by many different fingerprints (a dense cluster of near copies) would make
pairs in the square of their number. Past DENSE members an exact linear way takes over:
each emits itself and its 64 one-bit neighbours, and two fingerprints within two bits
always share one of these; such a group never has more than 65 members.

Only distinct fingerprints are linked; documents with equal fingerprints are joined by an
aggregation, so that a third of all rows being copies costs nothing. Components are found
by alternating star contraction, with aggregations and joins over written tables.

A radius of 2 bits misses most texts that share four fifths of their five-word shingles
(these lie 3 to 11 bits apart), and no pivots serve such radii at scale. Where a similarity
is asked for (``keep_one``), every text, not one of each fingerprint, meets all it may be
similar to: shingles are ordered by the number of texts that have them, and two texts as
similar as asked for share one of the first of each (``frequent``). Pairs that share one are
compared exactly, but for those already in one component (``similar``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, lean, lean_group, let, materialise, only
from .vocab import Cache

SHINGLE = 3
SEED = 42
RADIUS = 2
PIVOTS = 16
GROUPS = 6  # of search coordinates; linked pairs agree on GROUPS - RADIUS of them
DENSE = 200  # different fingerprints that share a key, beyond which pairs aren't formed
MASK = (1 << 64) - 1
LEADERS = 4  # members of a shingle that its others are compared with in the first round
GROWTH = 8  # times as many in each later one
BUCKET = 600_000  # shingles that one group counts, of 8 bytes and their text's id
CHUNK = 500_000  # shingles that a task gathers before it deals them to buckets
WORDS = 50_000  # whose hashes a task keeps
EPS = 1e-9


def fingerprint(text: str | None) -> int:
    """The contract's fingerprint, unsigned. bytes.lower and bytes.split know only ASCII,
    as the contract wants."""
    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) < SHINGLE:
        grams = [h(b" ".join(w), SEED)]
    else:
        grams = [h(b"%b %b %b" % g, SEED) for g in zip(w, w[1:], w[2:])]
    a = np.array(grams, dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(a), 1 << 16):  # bounded memory for very long texts
        part = a[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(a), bitorder="little")
    return int(bits.view("<u8")[0])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sequence_id(words: list[bytes]) -> int | None:
    """A signed 64-bit hash of a text's words, in order; none for a text without words."""
    import xxhash

    return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)) if words else None


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; a shorter text is
    one shingle. Words are hashed once, shingles from the hashes of their words."""

    def __init__(self, size: int):
        import numpy as np
        import xxhash

        self.size = size
        self.hashes = Cache(lambda w: xxhash.xxh64_digest(w, SEED), WORDS)
        draws = np.random.Generator(np.random.PCG64(SEED))
        self.factors = draws.integers(0, 1 << 64, (size + 1, size), dtype=np.uint64) | np.uint64(1)

    def __call__(self, words: list[bytes]):
        import numpy as np

        get, k = self.hashes, min(self.size, len(words))
        h = np.frombuffer(b"".join([get[w] for w in words]), "<u8")
        out = np.zeros(len(words) - k + 1 if words else 0, "<u8")
        for i in range(k):
            part = h[i : i + len(out)] ^ (h[i : i + len(out)] >> np.uint64(29))
            out += part * self.factors[k, i]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
        return np.unique(out)


def texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    """Texts of a batch, a few at a time in Python's memory."""
    column = batch.column("text")
    for k in range(0, len(column), 200):
        yield from column.slice(k, 200).to_pylist()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = [fingerprint(t) for t in texts(b)]
        signed = [x - (1 << 64) if x >> 63 else x for x in fp]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("k1__"), b.column("k2__"), pa.array(signed, pa.int64())], ["doc_id", "k1__", "k2__", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the row's identity and fp (64 bits as a signed long) for every row."""
    thin = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text", *_identity())
    return thin.mapInArrow(lean(_fingerprints), "doc_id long, k1__ long, k2__ int, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bounding_references() -> list[int]:
    """Reference fingerprints by a rule: multiples of the 64-bit golden ratio, mixed."""
    out = []
    for i in range(1, PIVOTS + 1):
        x = (i * 0x9E3779B97F4A7C15) & MASK
        x ^= x >> 29
        x = (x * 0xBF58476D1CE4E5B9) & MASK
        out.append(x ^ x >> 32)
    return out


def search_references() -> list[int]:
    """References with two set bits each that cover all 64 bits once."""
    return [0b11 << 2 * i for i in range(32)]


def distance(fp: Column, reference: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(reference)))).cast("long")


def with_pivot_table(fps: DataFrame) -> DataFrame:
    """Adds t0, t1: eight bounding distances each, seven bits apiece."""
    p = bounding_references()
    for t in range(PIVOTS // 8):
        packed = F.lit(0).cast("long")
        for i in range(8):
            packed = packed.bitwiseOR(F.shiftleft(distance(F.col("fp"), p[8 * t + i]), 7 * i))
        fps = fps.withColumn(f"t{t}", packed)
    return fps


def _near_in_table() -> Column:
    """No coordinate of two pivot tables differs by more than the radius."""
    ok = F.lit(True)
    for t in range(PIVOTS // 8):
        for i in range(8):
            a, b = (F.shiftright(F.col(f"{s}.t{t}"), 7 * i).bitwiseAND(F.lit(127)) for s in "ab")
            ok = ok & (F.abs(a - b) <= RADIUS)
    return ok


def search_keys(fp: Column) -> Column:
    """An array of keys, one for each choice of groups: the search coordinates of these
    groups, in base 3."""
    refs, zero = search_references(), distance(fp, 0)
    groups = [range(g, len(refs), GROUPS) for g in range(GROUPS)]
    # (distance to zero - distance to the reference + 2) / 2 is 0, 1 or 2.
    number = [sum((F.shiftright(zero - distance(fp, refs[c]) + 2, 1) * 3**k for k, c in enumerate(g)), F.lit(0).cast("long")) for g in groups]
    most = 3 ** max(map(len, groups))

    def keys(n: Column) -> Column:
        out = []
        for k, some in enumerate(combinations(range(GROUPS), GROUPS - RADIUS)):
            key = F.lit(k).cast("long")
            for g in some:
                key = key * most + n[g]
            out.append(key)
        return F.array(*out)

    return let(F.array(*number), keys)


def keyed(distinct: DataFrame) -> DataFrame:
    """fp and each of its search keys, one row a key."""
    return distinct.select("fp", F.explode(search_keys(F.col("fp"))).alias("key"))


def candidates(members: DataFrame) -> DataFrame:
    """Pairs a.fp < b.fp of ``members`` (fp, key) with equal keys, not yet bounded."""
    thin = with_pivot_table(members)
    return thin.alias("a").join(thin.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))


def bounded(pairs: DataFrame) -> DataFrame:
    """``candidates`` without those that a bounding reference rules out."""
    return pairs.filter(_near_in_table())


def links(distinct: DataFrame) -> DataFrame:
    """Pairs a < b of distinct fingerprints that connect all within RADIUS bits.

    Between dense keys' members a link may be stated through the smallest fingerprint of
    a shared neighbourhood, which is itself within RADIUS of both or joins them."""
    rows = keyed(distinct)
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialise(rows.join(counts, "key"), "simhash-keys")
    near = (
        bounded(candidates(shared.filter(F.col("n") <= DENSE).drop("n")))
        .filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    )
    dense = shared.filter(F.col("n") > DENSE).select("fp").distinct()
    around = F.concat(F.array(F.col("fp")), *[F.array(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)))) for i in range(64)])
    seen = dense.select("fp", F.explode(around).alias("around"))
    # The smallest and every other member of a neighbourhood: a bounded list.
    star = (
        seen.groupBy("around")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select("a", F.explode("fps").alias("b"))
        .filter("a < b")
    )
    return near.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp and root (smallest fingerprint reachable) for every end of ``edges`` but the roots.

    Large-star and small-star steps in turn, until nothing changes; which takes rounds in
    the logarithm of the longest chain."""

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = materialise(edges, "edges")
    now = state(e)
    then = None
    while now[0] and then != now:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        up = large.filter("a < b")
        low = up.groupBy("b").agg(F.min("a").alias("m"))
        small = up.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("x"))
        e = materialise(small.select("x.a", "x.b").filter("a < b").distinct(), "edges")
        then, now = now, state(e)
    return e.groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("root"))


def _placed(fps: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Adds root (smallest fingerprint reachable) and component_id to rows with an fp.

    ``more``: pairs a < b to link besides."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = links(distinct.select("fp"))
    roots = components(edges if more is None else edges.union(more).distinct())
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(placed.join(named, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) and component_id for every row of ``docs``.

    component_id is the smallest doc_id of all documents that links reach. Null and empty
    texts have fingerprint zero and are linked like any other; texts under three words
    are hashed as one shingle; a null doc_id takes part but never names a component;
    repeated rows come back as often as they are there. An empty table gives an empty
    table."""
    return _placed(materialise(fingerprints(docs), "fingerprints")).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _identity() -> list[Column]:
    """Tells rows apart by id and text, in 96 bits."""
    return [F.xxhash64("doc_id", "text").alias("k1__"), F.hash("doc_id", "text").alias("k2__")]


def _sequenced(docs: DataFrame) -> DataFrame:
    """As ``fingerprints``, with sid (``sequence_id``) and n (words) besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            f = next(_fingerprints(iter([whole])))
            found = [(sequence_id(w), len(w)) for w in map(_words, texts(whole))]
            more = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*f.columns, *more], [*f.schema.names, "sid", "n"])

    thin = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text", *_identity())
    return thin.mapInArrow(lean(run), "doc_id long, k1__ long, k2__ int, fp long, sid long, n long")


def _dealt_shingles(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """Shingles of all texts by ranges of their hashes: bucket, and in binary the texts' ids,
    numbers of shingles in all and here, and the hashes here, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        shingler, seen, held, total = Shingler(size), set(), [], 0
        edges = np.array([(k << 64) // buckets for k in range(1, buckets)], "<u8")

        def dealt() -> pa.RecordBatch:
            sid = np.array([x for x, _ in held], "<i8")
            n = np.array([len(g) for _, g in held], "<u4")
            grams, owner = np.concatenate([g for _, g in held]), np.repeat(np.arange(len(held)), n)
            bucket = np.searchsorted(edges, grams, side="right")
            order = np.argsort(bucket, kind="stable")
            grams, owner, bucket = grams[order], owner[order], bucket[order]
            ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1
            rows = []
            for i, j in zip([0, *ends[:-1]], ends):
                start = np.flatnonzero(np.r_[True, owner[i + 1 : j] != owner[i : j - 1]])
                who = owner[i:j][start]
                here = np.diff(np.r_[start, j - i]).astype("<u4")
                rows.append((int(bucket[i]), sid[who].tobytes(), n[who].tobytes(), here.tobytes(), grams[i:j].tobytes()))
            kinds = [pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "sid", "n", "here", "grams"])

        for x in batches:
            for t in texts(x):
                w = _words(t)
                key = sequence_id(w)
                if key is None or key in seen:
                    continue
                if len(seen) >= CHUNK:
                    seen.clear()
                seen.add(key)
                held.append((key, shingler(w)))
                total += len(held[-1][1])
                if total >= CHUNK:
                    yield dealt()
                    held, total = [], 0
        if held:
            yield dealt()

    return only(docs, text="text").mapInArrow(lean(run), "bucket int, sid binary, n binary, here binary, grams binary")


def frequent(docs: DataFrame, size: int, similarity: float, shingle_count: int) -> DataFrame:
    """sid, n (distinct shingles), grams (those that other texts have too) and first: of
    these the ones by which the text can be found.

    All shingles are counted, by ranges of their hashes. In the order of these counts, and
    of hashes among equal counts, two texts with at least this Jaccard similarity share one
    of the first n - ceil(similarity * n) + 1 of each. What one text alone has comes first
    and can't be shared, so ``first`` is short and most texts have none and aren't listed."""
    buckets = max(1, -(-shingle_count // BUCKET))
    parts = max(1, -(-buckets // 4))

    def joined(t: pa.Table, column: str, kind: str):
        import numpy as np

        return np.frombuffer(b"".join(t.column(column).to_pylist()), kind)

    def shared(t: pa.Table) -> pa.Table:
        import numpy as np

        here = joined(t, "here", "<u4")
        sid, n, h = joined(t, "sid", "<i8"), joined(t, "n", "<u4"), joined(t, "grams", "<u8")
        owner = np.repeat(np.arange(len(sid), dtype="<u4"), here)
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        same = h[1:] == h[:-1]
        some = np.r_[False, same] | np.r_[same, False]
        h, owner = h[some], owner[some]
        sid, n = sid[owner], n[owner]
        order = np.lexsort((sid, h))  # copies of a text come from several tasks
        h, sid, n = h[order], sid[order], n[order]
        once = np.r_[True, (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])][: len(h)]
        h, sid, n = h[once], sid[once], n[once]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        times = np.diff(np.r_[start, len(h)])
        times = np.repeat(times, times).astype("<u4")
        part = (sid.view("<u8") % np.uint64(parts)).astype("<i4")
        part[times < 2] = -1
        rows = []
        order = np.argsort(part, kind="stable")
        for p in range(parts):
            i, j = np.searchsorted(part, [p, p + 1], sorter=order)
            if i < j:
                x = order[i:j]
                rows.append((p, *(c[x].tobytes() for c in (sid, n, times, h))))
        kinds = [pa.int32(), *[pa.binary()] * 4]
        names = ["part", "sid", "n", "times", "grams"]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def firsts(t: pa.Table) -> pa.Table:
        import math

        import numpy as np

        sid, n, times, h = (joined(t, c, k) for c, k in (("sid", "<i8"), ("n", "<u4"), ("times", "<u4"), ("grams", "<u8")))
        order = np.lexsort((h, times, sid))
        sid, n, h = sid[order], n[order], h[order]
        start = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]][: len(sid)])
        rows = []
        for i, j in zip(start, np.r_[start[1:], len(sid)]):
            size = int(n[i])
            # Shingles of this text alone come before all others.
            k = size - math.ceil(similarity * size - EPS) + 1 - (size - (j - i))
            if k > 0:
                rows.append((int(sid[i]), size, np.sort(h[i:j]).tobytes(), h[i : min(j, i + k)].view("<i8")))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        names = ["sid", "n", "grams", "first"]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    dealt = _dealt_shingles(docs, size, buckets).repartition(buckets, "bucket")
    counted = dealt.groupBy("bucket").applyInArrow(lean_group(shared), "part int, sid binary, n binary, times binary, grams binary")
    found = counted.repartition(parts, "part").groupBy("part").applyInArrow(lean_group(firsts), "sid long, n long, grams binary, first array<long>")
    return materialise(found, "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingles have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for x in batches:
            good = []
            for g, h, n in zip(*(x.column(c).to_pylist() for c in ("g", "h", "n"))):
                g, h = np.frombuffer(g, "<u8"), np.frombuffer(h, "<u8")
                both = len(np.intersect1d(g, h, assume_unique=True))
                good.append(both >= similarity * (n - both) - EPS)
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    g = sets.select(F.col("sid").alias("a"), F.col("grams").alias("g"), F.col("n").alias("an"))
    h = sets.select(F.col("sid").alias("b"), F.col("grams").alias("h"), F.col("n").alias("bn"))
    both = pairs.join(h, "b").join(g, "a").select("a", "b", "g", "h", (F.col("an") + F.col("bn")).alias("n"))
    return both.mapInArrow(lean(run), "a long, b long")


def similar(docs: DataFrame, size: int, similarity: float, shingle_count: int) -> DataFrame:
    """Pairs a < b of texts (sid) that connect all whose similarity is at least this.

    Texts that have a shingle among their first (``frequent``) are its members. In rounds
    its next leaders are compared with all members after them, and between rounds
    components are found: pairs in one component are connected and aren't compared, a
    shingle whose members are all in one is done with. Each round takes GROWTH times as
    many leaders, so rounds are few; what no link connects is compared pair by pair, so no
    link between components is lost."""
    sets = frequent(docs, size, similarity, shingle_count)
    rows = sets.select("sid", "n", F.explode("first").alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    # Leaders differ from shingle to shingle, also among those that the same texts have.
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("key", "sid"), "sid"))
    here = rows.join(counts, "key").select("key", "sid", "n", "m", rank.alias("r"), F.col("sid").alias("root"))
    here, done, out, past, count = materialise(here, "members"), None, None, 0, LEADERS
    while True:
        lead = here.filter((F.col("r") > past) & (F.col("r") <= count))
        lead = lead.select("key", F.col("sid").alias("ls"), F.col("n").alias("ln"), F.col("r").alias("lr"), F.col("root").alias("lroot"))
        close = (F.col("n") >= similarity * F.col("ln") - EPS) & (F.col("ln") >= similarity * F.col("n") - EPS)
        met = here.join(lead, "key").filter((F.col("lr") < F.col("r")) & (F.col("lroot") != F.col("root")) & close)
        met = met.select(F.least("ls", "sid").alias("a"), F.greatest("ls", "sid").alias("b")).distinct()
        if done is not None:  # pairs that share several shingles are compared once
            met = met.join(done, ["a", "b"], "left_anti")
        met = materialise(met, "pairs")
        near = materialise(_verified(met, sets, similarity), "similar")
        done = met if done is None else done.unionByName(met)
        out = near if out is None else out.unionByName(near)
        # The last member has nothing after it to be compared with.
        left = here.filter((F.col("m") > count + 1) & (F.col("r") > count))
        if left.isEmpty():
            return out
        roots = components(out).select(F.col("fp").alias("sid"), F.col("root").alias("to"))
        left = left.join(roots, "sid", "left").withColumn("root", F.coalesce("to", "sid")).drop("to")
        several = left.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
        here = materialise(left.join(several, "key").select("key", "sid", "n", "m", "r", "root"), "members")
        if here.isEmpty():
            return out
        past, count = count, count * GROWTH


def _linked_fingerprints(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """Pairs a < b of fingerprints from ``pairs`` of texts; a text's words make its
    fingerprint, so each has one."""
    of = fps.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("fp").alias("fp"))
    a = of.select(F.col("sid").alias("a"), F.col("fp").alias("x"))
    b = of.select(F.col("sid").alias("b"), F.col("fp").alias("y"))
    both = pairs.join(a, "a").join(b, "b")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float | None = None) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; a row without a
    doc_id stays only where no row of its component has one. Columns as in ``docs``.

    With ``similarity``, texts whose sets of ``shingle``-word shingles have at least this
    Jaccard similarity are linked besides. Where rows repeat a document, one stays. Columns
    of any names beyond those of documents stay."""
    k1, k2 = free(docs, "k1__", "k2__")
    if similarity is None:
        found = _placed(materialise(fingerprints(docs), "fingerprints"))
    else:
        fps = materialise(_sequenced(docs), "fingerprints")
        total = fps.groupBy("sid").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] or 0
        pairs = similar(docs, shingle, similarity, total)
        found = _placed(fps.drop("sid", "n"), _linked_fingerprints(pairs, fps))
    rows = found.groupBy("root", "k1__", "k2__").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n__"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1__", "k2__", "n__")
    first = rows.groupBy("root").agg(F.min(order).alias("x"))
    chosen = materialise(first.select("x.k1__", "x.k2__", "x.n__"), "kept")
    chosen = chosen.select(F.col("k1__").alias(k1), F.col("k2__").alias(k2), "n__")
    a, b = _identity()
    here = docs.withColumns({k1: a, k2: b}).join(chosen, [k1, k2], "left_semi")
    # Texts are dealt out anew only where rows do repeat.
    if not chosen.filter("n__ > 1").isEmpty():
        here = here.dropDuplicates([k1, k2])
    return here.select(*[here[c] for c in docs.columns])
