"""Files read by ranges: one large file of blocks or sized members spreads over many tasks.

Two passes over the compressed bytes and one thin table between them; payloads are never
shuffled nor written on the way.

1. Each range finds the boundaries inside it (ends of marker pairs, heads of sized members),
   inflates from each to the next, the last beyond its own end, and keeps lengths, checksums
   and how each segment ended.
2. Windows over this metadata join the segments of a file, settle members and offsets and
   combine checksums. A false boundary shows as a segment that ends inside a block; it is
   merged with its successors and inflated again.
3. Ranges of files that are whole and verified are inflated again to rows of their own.
   Any other file (a plain stream, not gzip, damage, sized members with something else
   between them) is read by one task in bounded memory, so its result is that of the data
   source; small files are read this way at once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.gzip_format import Header, NotGzip, parse_header
from ..operators import codec
from ..operators.arrow import map_value
from ..operators.decode import islands, settle
from ..operators.views import listed
from ..storage import materialise
from .gzip_files import find_files, open_path, pieces

SPLIT = 64 << 20  # compressed bytes of a range
MOST_TASKS = 100_000  # ranges beyond this number share tasks
HEAD = 4096
PAIR = fixed.MARKER_PAIR
SEGMENTS = "array<struct<offset:bigint,length:bigint,layout:string,is_last:boolean,raw_offset:bigint>>"
SEGMENT = "seg_idx long, layout string, offset long, length long, is_last boolean"
PIECE = (
    "piece_idx int, status string, in_used long, done boolean, ended boolean, want_crc long, want_size long, "
    "out_len long, crc32 long, err_code string, message string"
)


def _file(path: str):
    where, inner = open_path(path)
    return where.open_input_file(inner)


def _header(f, at: int, buf: bytes = b"", base: int = 0) -> Header | None:
    """The header at ``at``, from ``buf`` (the file's bytes from ``base``) where it is
    there; None if there is none, or one too long to be worth planning on."""
    for head in (buf[at - base : at - base + HEAD] if base <= at < base + len(buf) else b"", None, fixed.HEADER_BUFFER_MAX):
        if not isinstance(head, bytes):
            head = f.read_at(head or HEAD, at)
        try:
            if (found := parse_header(head)) is not None:
                return found
        except NotGzip:
            return None
    return None


def _sized(h: Header | None) -> int:
    """Bytes of the member with this header, 0 if it doesn't tell."""
    size = h.member_size if h else None
    return size if size and size >= h.length + fixed.TRAILER_LEN else 0


def _layout(path: str, size: int) -> tuple[str, int]:
    """(layout, offset of the first member's data)."""
    with _file(path) as f:
        h = _header(f, 0)
        if h is None:
            return "stream", 0
        if _sized(h):
            return ("sized" if _sized(h) <= size else "stream"), h.length
        return ("blocks" if PAIR in f.read_at(fixed.PROBE_WINDOW, h.length) else "stream"), h.length


def boundaries(buf: bytes, base: int, low: int, high: int) -> list[int]:
    """Offsets in [low, high) where a marker pair ends, with all empty blocks after it.

    ``buf`` holds the file's bytes from ``base``. Pairs overlap only as a pair does with the
    empty block after it, so each offset is told by the bytes around it, whatever was read
    before: ranges agree on them."""
    out, at = [], buf.find(PAIR)
    while at >= 0:
        end = at + len(PAIR)
        if low <= base + end < high and not buf.startswith(fixed.EMPTY_BLOCK, end):
            out.append(base + end)
        at = buf.find(PAIR, at + 1)
    return out


def _inflated(seg: bytes, at: int, last: bool, limit: int) -> Iterator[dict]:
    """Rows of one segment of blocks, without its bytes."""
    s = codec.inflate_segment(seg, last, limit)
    same = {"seg_idx": at, "layout": "blocks", "offset": at, "length": len(seg), "is_last": last, "status": s.status, "in_used": s.used, "done": s.done}
    for i, p in enumerate(s.pieces or [codec.Piece(b"", 0)]):
        yield same | {"piece_idx": i, "ended": p.ended, "want_crc": p.want_crc, "want_size": p.want_size, "out_len": len(p.data), "crc32": p.crc}


def _block_range(f, row: dict, target: int, limit: int) -> Iterator[dict]:
    """Segments that begin in [start, end); the last one ends at the next boundary."""
    start, end, body, size = row["start"], min(row["end"], row["size"]), row["body"], row["size"]
    base = max(body, start - len(PAIR))
    if base >= end:
        return
    buf = f.read_at(end + len(fixed.EMPTY_BLOCK) - base, base)
    found = [body] * (start <= body < end) + boundaries(buf, base, max(start, body + len(PAIR)), end)
    if not found:
        return
    buf, base, close, at = bytearray(buf[found[0] - base :]), found[0], size, end
    while at < size:
        if at - found[-1] > limit + codec.STEP:
            yield {"seg_idx": found[-1], "layout": "blocks", "offset": found[-1], "length": at - found[-1], "is_last": False, "piece_idx": 0,
                   "status": codec.OVERFLOW, "in_used": 0, "done": False, "ended": False, "out_len": 0, "crc32": 0}
            return
        back = max(at - len(PAIR), base)
        more = f.read_at(at + codec.STEP + len(fixed.EMPTY_BLOCK) - back, back)
        buf[back - base :] = more
        if beyond := boundaries(more, back, at, at + codec.STEP):
            close = beyond[0]
            break
        at += codec.STEP
    bounds = [*found, close]
    lengths = [b - a for a, b in zip(bounds, bounds[1:])]
    group, first = 0, bounds[0]
    groups = codec.coalesce(lengths, target)
    for k, b in enumerate(bounds[1:], 1):
        if k == len(groups) or groups[k] != group:
            if b > first:
                yield from _inflated(bytes(buf[first - base : b - base]), first, b == size, limit)
            group, first = group + 1, b


def _member_range(f, row: dict, target: int) -> Iterator[dict]:
    """Groups of sized members that begin in [start, end).

    A range that isn't the first takes the first offset where two heads follow each other;
    were it wrong, the groups of the file wouldn't join and it is read as a stream."""
    start, end, size = row["start"], min(row["end"], row["size"]), row["size"]
    buf = f.read_at(end - start, start)
    at = start
    if start:
        where = buf.find(fixed.MAGIC)
        while where >= 0:
            at = start + where
            n = _sized(_header(f, at, buf, start))
            if n and (at + n == size or at + n < size and _sized(_header(f, at + n, buf, start))):
                break
            where = buf.find(fixed.MAGIC, where + 1)
        if where < 0:
            return
    first = at
    while at < end:
        n = _sized(_header(f, at, buf, start))
        whole = n and at + n <= size
        at += n if whole else 0
        if at - first >= target or at >= end or not whole:
            raw = buf[first - start : at - start] if at <= start + len(buf) else f.read_at(at - first, first)
            d = codec.decode(raw, keep=False)
            good = whole and d.code is None and d.used == len(raw)
            yield {"seg_idx": first, "layout": "sized", "offset": first, "length": at - first, "is_last": at == size, "piece_idx": 0,
                   "status": codec.FULL if good else codec.ERROR, "in_used": d.used, "done": False, "ended": True, "out_len": d.size, "crc32": 0,
                   "err_code": None if good else codec.DATA_ERROR, "message": None if good else "no run of sized members"}
            first = at
        if not whole:
            return


def _pass(todo: DataFrame, target: int, limit: int) -> DataFrame:
    """Metadata of the segments of each range, or of one merged segment (``joined``)."""

    def make(row: dict) -> Iterator[dict]:
        with _file(row["path"]) as f:
            if row["joined"]:
                yield from _inflated(f.read_at(row["end"] - row["start"], row["start"]), row["start"], row["end"] == row["size"], limit)
            elif row["layout"] == "blocks":
                yield from _block_range(f, row, target, limit)
            else:
                yield from _member_range(f, row, target)

    return map_value(todo, "path", make, f"{SEGMENT}, {PIECE}", ["path", "size", "body"])


def _whole(heads: DataFrame) -> DataFrame:
    """Paths whose segments follow each other from the first byte of data to the end."""
    w = Window.partitionBy("path").orderBy("seg_idx")
    first = F.when(F.col("layout") == "sized", F.lit(0)).otherwise(F.col("body"))
    joins = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w), first) == F.col("offset")
    told = heads.select("path", "size", (F.col("offset") + F.col("length")).alias("to"), joins.alias("joins"))
    return told.groupBy("path").agg(F.min("joins").alias("joins"), (F.max("to") == F.max("size")).alias("all")).filter("joins AND all").select("path")


def segments(spark: SparkSession, found: list[tuple[str, int]], split: int, target: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(path, seg_idx, layout, offset, length, is_last, raw_offset; paths) of the
    files in ``found`` that can be read by ranges: whole, and checked."""
    tasks = max(1, min(sum(-(-size // split) for _, size in found), MOST_TASKS))

    def look(row: dict) -> list[dict]:
        layout, body = _layout(row["path"], row["size"])
        return [{"layout": layout, "body": body}]

    files = spark.createDataFrame(found, "path string, size long").repartition(min(len(found), tasks))
    files = map_value(files, "path", look, "layout string, body long", ["path", "size"]).filter("layout <> 'stream'")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long")))
    ranges = files.select("path", "size", "layout", "body", start.alias("start")).withColumn("end", F.col("start") + split)
    ranges = ranges.withColumn("joined", F.lit(False)).repartition(tasks)
    seen = materialise(_pass(ranges, target, limit), "ranges")

    merged = islands(seen.filter("piece_idx = 0"), "path")
    grown = merged.groupBy("path", "size", "body", "layout", "island").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count(F.lit(1)).alias("n")
    )
    # What would have to hold more than a block is left to the stream.
    grown = materialise(grown.filter((F.col("n") > 1) & (F.col("end") - F.col("start") <= limit + split)), "merged")
    if not grown.isEmpty():
        of = merged.join(grown, ["path", "island"], "left_semi").select("path", "seg_idx")
        again = _pass(grown.drop("island", "n").withColumn("joined", F.lit(True)).repartition(tasks), target, limit)
        seen = materialise(seen.join(of, ["path", "seg_idx"], "left_anti").select(seen.columns).unionByName(again), "ranges")

    meta, verdicts = settle(seen, "path")
    good = verdicts.filter(F.col("status") == fixed.OK).select("path").join(_whole(seen.filter("piece_idx = 0")), "path", "left_semi")
    good = materialise(good, "whole")
    per = meta.join(good, "path", "left_semi").groupBy("path", "seg_idx", "layout", "offset", "length", "is_last")
    return per.agg(F.min("raw_offset").alias("raw_offset")), good


def read_files(
    spark: SparkSession,
    path: str,
    recursive: bool = False,
    suffix: str = "",
    split: int = SPLIT,
    target: int = fixed.COALESCE_TARGET,
    limit: int = fixed.MAX_BLOCK,
    strict: bool = True,
) -> DataFrame:
    """path, raw_offset, payload: the decoded bytes of every file under ``path``.

    Files over ``split`` bytes are read by ranges. What isn't gzip passes unchanged and
    garbage after a member is ignored. Damage raises; without ``strict`` what was good
    before it is returned. An empty folder or file gives no rows."""
    found = find_files(path, recursive, suffix)
    large = [f for f in found if f[1] > split]
    tasks = max(1, min(sum(max(1, -(-size // split)) for _, size in found), MOST_TASKS))
    whole = spark.createDataFrame(found, "path string, size long").select("path", F.lit(None).cast(SEGMENTS).alias("segs"))
    todo = whole
    if large:
        cut, good = segments(spark, large, split, target, limit)
        # Segments of a range are read at once; their number is bounded by its size.
        told = F.struct("offset", "length", "layout", "is_last", "raw_offset")
        by_range = cut.groupBy("path", F.floor(F.col("offset") / split).alias("r")).agg(F.sort_array(F.collect_list(told)).alias("segs"))
        todo = whole.join(good, "path", "left_anti").unionByName(by_range.select("path", "segs"))

    def make(row: dict) -> Iterator[dict]:
        at = 0
        if row["segs"] is None:
            where, inner = open_path(row["path"])
            with where.open_input_stream(inner, compression=None) as stream:
                for part in pieces(stream, row["path"], strict):
                    yield {"raw_offset": at, "payload": part}
                    at += len(part)
            return
        with _file(row["path"]) as f:
            for s in row["segs"]:
                raw, at = f.read_at(s["length"], s["offset"]), s["raw_offset"]
                sized = s["layout"] == "sized"
                for p in codec.decode(raw).parts if sized else [p.data for p in codec.inflate_segment(raw, s["is_last"], limit).pieces]:
                    if p:
                        yield {"raw_offset": at, "payload": p}
                        at += len(p)

    return map_value(todo.repartition(tasks), "path", make, "raw_offset long, payload binary", ["path"])


def list_files(spark: SparkSession, path: str, recursive: bool = False, suffix: str = "", stored_names: bool = False) -> DataFrame:
    """The columns of ``listing`` for files, of which only heads and tails are read."""
    found = find_files(path, recursive, suffix)
    files = spark.createDataFrame(found, "path string, size long").repartition(max(1, min(len(found), MOST_TASKS)))

    def ends(row: dict) -> list[dict]:
        with _file(row["path"]) as f:
            tail = max(row["size"] - fixed.TRAILER_LEN, 0)
            return [{"head": f.read_at(HEAD, 0), "tail": f.read_at(fixed.TRAILER_LEN, tail)}]

    both = map_value(files, "path", ends, "head binary, tail binary", ["path", "size"])
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    return listed(both, base, F.col("size"), F.col("head"), F.col("tail"), stored_names)
