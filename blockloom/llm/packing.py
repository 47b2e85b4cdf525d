"""Packing (operator 6): documents into sequences, with a controlled mixture of sources.

Each source is a queue. Deficit round-robin fills a window (sequence): every source earns
its target share of the window, the sources with most credit are served first, what was
earned but not served is carried to the next window, and a source that was served ahead
of its share owes. Documents are cut where a window ends.

Tokens are made once and written to the shared folder. Each source's tokens are then one
stream, by running sums (within a task while tokens are made, over tasks by totals only),
cut into grains of about GRAIN tokens. A schedule says at which point of the whole output
a token of a source is due if all are served at their target shares; grains go to the
lane, a bounded number of tokens, in which they are due. So every lane holds the target
mixture to within a grain or two of each source, no source is ever one task and what a
source is owed never adds up over lanes. Within a lane, windows are filled at the shares
of what the lane holds, so that no source runs out before the lane does. A lane's last
tokens go to sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, lean_group, materialise, only
from .vocab import VOCAB, encoder

WINDOW = 4096
LANE_TOKENS = 1 << 19
PARTITION_LANES = 16  # lanes dealt to one task, of about 1 MB each
MIN_PIECE = 256  # a source isn't cut shorter than this while another has credit to serve
GRAIN = 256  # documents are cut at lane edges in pieces of about so many tokens of a source
FEW_TOTALS = 100_000  # totals up to so many rows are broadcast
SLICE = 2 << 20  # bytes of text tokenised at once
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NO_SOURCE = "\u0000"


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts with up to SLICE bytes in ``column``, or a single row with more."""
    import numpy as np

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + SLICE, "right")))
        yield batch.slice(k, end - k)
        k = end


def tokenise(docs: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """doc_id, source, ids, n, lane (the task that made them) and at (tokens of the same
    source that this task made before).

    The table is written before it is used, so a task that runs again never changes what
    another has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(vocab), TaskContext.get().partitionId()
        made: dict[str, int] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                ids, at = enc.documents(b.column("text").cast(pa.string())), []
                n = [x // enc.width for x in pc.binary_length(ids).to_pylist()]
                for s, k_n in zip(b.column("source").to_pylist(), n):
                    at.append(made.get(s, 0))
                    made[s] = at[-1] + k_n
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("source"), ids, *(pa.array(c, pa.int64()) for c in (n, [task] * len(n), at))],
                    ["doc_id", "source", "ids", "n", "lane", "at"],
                )

    thin = only(docs, doc_id="doc_id", source="source", text="text").select(
        F.col("doc_id").cast("long"), F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), "text"
    )
    return thin.mapInArrow(lean(run, encoder.cache_clear), "doc_id long, source string, ids binary, n long, lane long, at long")


def before(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the lanes before, for each of ``keys``.

    In two levels (blocks of 1024 lanes), so that no task holds all lanes."""
    df = df.withColumn("block", F.floor(F.col("lane") / 1024))
    sums = df.groupBy(*keys, "block").agg(F.sum(value).alias("s"))
    earlier = Window.partitionBy(*keys, F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys, "block").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(sums, [*keys, "block"])
        .withColumn(name, F.col("base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("block", "base")
    )


def schedule(totals: dict[str, int], targets: dict[str, float]) -> tuple[dict[str, tuple[float, float]], list[tuple[float, float]]]:
    """For each source (start, rate): its token x is due at the moment start + x / rate.
    And the tokens due by then in all, as the corners of a piecewise linear curve.

    Sources are served at their targets until they run out; those without a target
    afterwards, at equal rates."""
    rate = {s: max(0.0, float(targets.get(s) or 0)) for s in totals}
    most = max(rate.values(), default=0) or 1.0
    last = max((totals[s] * most / rate[s] for s in totals if rate[s]), default=0.0)
    own = {s: (0.0, rate[s] / most) if rate[s] else (last, 1.0) for s in totals}
    steps = sorted([(start, r) for start, r in own.values()] + [(own[s][0] + totals[s] / own[s][1], -own[s][1]) for s in totals])
    corners, at, due, speed = [(0.0, 0.0)], 0.0, 0.0, 0.0
    for moment, change in steps:
        due += speed * (moment - at)
        at, speed = moment, speed + change
        if at > corners[-1][0]:
            corners.append((at, due))
    return own, corners


def dealt(made: DataFrame, targets: dict[str, float] | None, lanes: int) -> DataFrame:
    """lane, doc_id, source, ids, n, start, doc_tokens and place (in the source's stream),
    one row for each part of a document in a lane."""
    cells = materialise(made.groupBy("lane", "source").agg(F.sum("n").alias("n")), "cells")
    sums = materialise(cells.groupBy("source").agg(F.sum("n").alias("own")), "sources")
    total = sums.agg(F.sum("own")).first()[0] or 1
    # Equal sources have their grains at different places, so that no lane gets all of these.
    u = F.shiftrightunsigned(F.xxhash64("source"), 12) / F.lit(float(1 << 52))
    sums = sums.withColumn("u", u).withColumn("grain", F.ceil(F.col("own") / F.greatest(F.lit(1), F.round(F.col("own") / GRAIN))).cast("long"))
    corners = None
    if targets is not None:
        own, corners = schedule({r["source"]: r["own"] for r in sums.select("source", "own").collect()}, targets)
        rates = made.sparkSession.createDataFrame([(s, *x) for s, x in own.items()], "source string, begin double, rate double")
        sums = sums.join(rates, "source")
    totals = before(cells, ["source"], "n", "earlier").select("lane", "source", "earlier").join(sums, "source")
    totals = materialise(totals, "totals")
    if totals.count() <= FEW_TOTALS:
        totals = F.broadcast(totals)

    def lane_of(grain: Column) -> Column:
        done = (grain + F.col("u")) * F.col("grain") / F.col("own")  # share of its source before it
        due = done * F.lit(float(total))
        if corners is not None:
            v, w = (F.array(*[F.lit(float(c[i])) for c in corners]) for i in (0, 1))
            now = F.col("begin") + done * F.col("own") / F.col("rate")
            i = F.greatest(F.lit(1), F.least(F.lit(len(corners) - 1), F.size(F.filter(v, lambda x: x <= now))))
            x0, x1, y0, y1 = F.get(v, i - 1), F.get(v, i), F.get(w, i - 1), F.get(w, i)
            due = y0 + (now - x0) / (x1 - x0) * (y1 - y0)
        return F.least(F.lit(lanes - 1), F.floor(due * lanes / F.lit(float(total)))).cast("long")

    first, last = F.expr("place div grain"), F.expr("(place + n - 1) div grain")
    rows = made.join(totals, ["lane", "source"]).withColumn("place", F.col("earlier") + F.col("at")).drop("lane")
    rows = rows.withColumn("g", F.sequence(first, last)).withColumn("l", F.transform("g", lane_of))
    # Grains of one lane are neighbours: a part begins where the lane changes.
    begins = F.filter(
        F.transform("g", lambda g, i: F.struct(F.get("l", i).alias("lane"), F.when((i == 0) | (F.get("l", i) != F.get("l", i - 1)), g).alias("g"))),
        lambda x: x["g"].isNotNull(),
    )
    rows = rows.withColumn("b", begins)
    edge = F.transform("b", lambda x: F.greatest(F.lit(0).cast("long"), x["g"] * F.col("grain") - F.col("place")))
    rows = rows.withColumn("e", edge)
    parts = F.transform("b", lambda x, i: F.struct(x["lane"].alias("lane"), F.get("e", i).alias("start"), F.coalesce(F.get("e", i + 1), F.col("n")).alias("end")))
    rows = rows.withColumn("p", F.explode(parts))
    width = F.expr("octet_length(ids) div n")
    cut = F.substring("ids", (F.col("p.start") * width + 1).cast("int"), ((F.col("p.end") - F.col("p.start")) * width).cast("int"))
    return rows.select(
        "p.lane", "doc_id", "source", cut.alias("ids"), (F.col("p.end") - F.col("p.start")).alias("n"),
        "p.start", F.col("n").alias("doc_tokens"), (F.col("place") + F.col("p.start")).alias("place"),
    )


def window_sizes(total: int, window: int = WINDOW) -> list[int]:
    """Full windows, then powers of two for the rest."""
    rest = total % window
    return [window] * (total // window) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def serve(left: dict[str, int], share: dict[str, float], credit: dict[str, float], window: int = WINDOW) -> Iterator[list[tuple[str, int]]]:
    """For each window, the (source, tokens) served, in order. ``left`` and ``credit``
    are changed: deficits carry from window to window."""
    for room in window_sizes(sum(left.values()), window):
        active = [s for s in left if left[s]]
        weight = sum(share[s] for s in active)
        for s in active:
            credit[s] += room * (share[s] / weight if weight else 1 / len(active))
        out: list[tuple[str, int]] = []
        for s in sorted(active, key=lambda s: (-credit[s], s)):
            take = min(int(max(credit[s], 0)), left[s], room)
            if take and (take >= MIN_PIECE or take == left[s] or take == room):
                out.append((s, take))
                room, left[s], credit[s] = room - take, left[s] - take, credit[s] - take
        while room:  # earned amounts too small to serve: most credit first, into debt
            s = min((s for s in active if left[s]), key=lambda s: (-credit[s], s))
            take = min(max(MIN_PIECE, int(max(credit[s], 0))), left[s], room)
            out.append((s, take))
            room, left[s], credit[s] = room - take, left[s] - take, credit[s] - take
        yield out


def pack_lane(docs: pa.Table) -> pa.Table:
    import numpy as np

    lane = docs.column("lane")[0].as_py()
    docs = docs.sort_by([("source", "ascending"), ("place", "ascending")])
    doc_id, source, ids, size, start, whole = (docs.column(c).to_pylist() for c in ("doc_id", "source", "ids", "n", "start", "doc_tokens"))
    queues: dict[str, list[int]] = {}
    for i, s in enumerate(source):
        queues.setdefault(s, []).append(i)
    left = {s: sum(size[i] for i in q) for s, q in sorted(queues.items())}
    total = sum(left.values())
    share = {s: n / total for s, n in left.items()}
    credit = dict.fromkeys(left, 0.0)
    wide = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4") for x, n in zip(ids, size)]
    at = {s: [0, 0] for s in queues}  # next document of the queue, tokens of it served
    out: list[tuple] = []
    for k, served in enumerate(serve(left, share, credit)):
        offset, sequence = 0, (lane << 32) + k
        for s, take in served:
            pos, q = at[s], queues[s]
            while take:
                i = q[pos[0]]
                n = min(take, size[i] - pos[1])
                crc = zlib.crc32(wide[i][pos[1] : pos[1] + n])
                out.append((doc_id[i], start[i] + pos[1], n, crc, whole[i], sequence, offset))
                take, offset, pos[1] = take - n, offset + n, pos[1] + n
                if pos[1] == size[i]:
                    pos[:] = [pos[0] + 1, 0]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*out))})


def pack(docs: DataFrame, targets: dict[str, float] | None = None, vocab: str = VOCAB) -> DataFrame:
    """One row for each piece of a document in a sequence of at most WINDOW tokens.

    ``targets``: a share for each source, by default its share of all tokens. Sources
    without a target are served when all others have run out. Null text is a document of the
    end token alone; a null source is a queue of its own; repeated rows are documents of
    their own; a null doc_id stays null. An empty table gives an empty table."""
    made = materialise(tokenise(docs, vocab), "tokens")
    total = made.agg(F.sum("n")).first()[0] or 0
    lanes = max(1, -(-total // LANE_TOKENS))
    rows = dealt(made, targets, lanes)
    # As many partitions as lanes need, whatever the session's default: none holds over
    # PARTITION_LANES lanes but by the chance of a hash.
    return rows.repartition(max(1, -(-lanes // PARTITION_LANES)), "lane").groupBy("lane").applyInArrow(lean_group(pack_lane), SCHEMA)
