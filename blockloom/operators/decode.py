"""Decode: plan, inflate in parallel, validate in order, repair, verify.

Two plans. ``decode`` maps whole values in one task each, without a shuffle: right for
many values. ``decode_blocks`` cuts each value into segments, which are rows of their own
and inflate in parallel whatever value they come from; what one segment can't know (does
it begin at a block boundary? which member is it in? does the checksum fit?) is settled
afterwards over thin metadata by windows and a commutative checksum aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.checksum import crc32_shift
from ..functions.gzip_format import NotGzip, parse_header
from ..storage import materialise
from . import codec
from .arrow import binary, join_bytes, map_value

VERDICT = "status string, err_code string, message string"


OUTCOME = ("members", "layout", "total_in", "total_out", "status", "err_code", "message")


def decode(df: DataFrame, packed: str = "packed", out: str = "data", payload: bool = True, strict: bool = False) -> DataFrame:
    """``df`` with ``packed`` replaced by the decoded ``out`` and members, layout,
    total_in, total_out, status, err_code and message.

    What isn't gzip passes unchanged, garbage after a member is ignored, damaged values
    give what was good before the damage. Without ``payload`` only the verdict is kept
    (the test mode): decoded bytes are counted and dropped as they come, whatever their
    number. With ``strict`` what isn't gzip, null included, is an error, found by its first
    two bytes; else null is null with status ok. Columns of ``df`` that are named like one
    of these are replaced."""
    keep = [c for c in df.columns if c not in (packed, out, *OUTCOME)]

    def make(row: dict) -> list[dict]:
        raw = row[packed]
        if strict and not (raw or b"").startswith(fixed.MAGIC):
            bad = {"status": fixed.ERROR, "err_code": codec.DATA_ERROR, "message": "not in gzip format"}
            return [{"members": 0, "total_in": len(raw or b""), "total_out": 0, **bad}]
        if raw is None:
            return [{out: None, "members": 0, "total_in": 0, "total_out": 0, "status": fixed.OK}]
        d = codec.decode(raw, payload)
        made = {
            "members": d.members,
            "layout": d.layout,
            "total_in": len(raw),
            "total_out": d.size,
            "status": fixed.OK if d.code is None else fixed.ERROR,
            "err_code": d.code,
            "message": d.message,
        }
        if payload:
            made[out] = d.data
        return [made]

    schema = f"{out} binary, " * payload + f"members int, layout string, total_in long, total_out long, {VERDICT}"
    return map_value(binary(df, packed), packed, make, schema, keep)


def plan(df: DataFrame, key: str, packed: str = "packed", target: int = fixed.COALESCE_TARGET, parallel: bool = True) -> DataFrame:
    """key, seg_idx, layout, offset, length, is_last, payload: candidate segments.

    Sized members are cut exactly and grouped to ``target`` bytes; block members are cut at
    marker pairs, to the end of the value (what follows the first member is cut the same
    way and told apart later); anything else is one segment. Without ``parallel`` every
    gzip value is one segment. A null value is one empty segment of layout none."""

    def make(row: dict) -> list[dict]:
        raw = row[packed]
        if raw is None:
            return [{"seg_idx": 0, "layout": "none", "offset": 0, "length": 0, "is_last": True, "payload": b""}]
        cuts, layout = _segments(raw, target, parallel)
        return [
            {"seg_idx": i, "layout": kind, "offset": a, "length": n, "is_last": i + 1 == len(cuts), "payload": raw[a : a + n]}
            for i, (a, n, kind) in enumerate(cuts)
        ] if cuts else [{"seg_idx": 0, "layout": layout, "offset": 0, "length": 0, "is_last": True, "payload": b""}]

    schema = "seg_idx int, layout string, offset long, length long, is_last boolean, payload binary"
    return map_value(binary(df.select(key, packed), packed), packed, make, schema, [key])


def _segments(raw: bytes, target: int, parallel: bool) -> tuple[list[tuple[int, int, str]], str]:
    """(offset, length, layout) of each segment. A run of sized members is cut first; what
    follows it, if anything, is planned as a value of its own."""
    out: list[tuple[int, int, str]] = []
    at = 0
    while at < len(raw):
        if not raw.startswith(fixed.MAGIC, at):
            if not out:
                return [(0, len(raw), "passthru")], "passthru"
            break
        try:
            head = parse_header(raw, at)
        except NotGzip:
            head = None
        layout = codec.layout_of(raw, head, at) if parallel else "stream"
        if layout == "sized":
            size = head.member_size
            if out and out[-1][2] == "sized" and out[-1][1] < target:
                out[-1] = (out[-1][0], out[-1][1] + size, "sized")
            else:
                out.append((at, size, "sized"))
            at += size
            continue
        if layout == "blocks":
            body = at + head.length
            out += [(a, n, "blocks") for a, n in codec.cut_segments(raw, body, target)]
        else:
            out.append((at, len(raw) - at, "stream"))
        break
    return out, "stream"


def inflate_segments(segments: DataFrame, key: str, limit: int = fixed.MAX_BLOCK) -> DataFrame:
    """Each segment's pieces: key, seg_idx, piece_idx, layout, offset, length, is_last,
    status, in_used, done, ended, want_crc, want_size, out_len, crc32, err_code, message,
    payload (decoded)."""
    keep = [key, "seg_idx", "layout", "offset", "length", "is_last"]

    def make(row: dict) -> list[dict]:
        raw = row["payload"]
        if row["layout"] == "blocks":
            s = codec.inflate_segment(raw, row["is_last"], limit)
            pieces = s.pieces or [codec.Piece(b"", 0)]
            return [
                {
                    "piece_idx": i,
                    "status": s.status,
                    "in_used": s.used,
                    "done": s.done,
                    "ended": p.ended,
                    "want_crc": p.want_crc,
                    "want_size": p.want_size,
                    "out_len": len(p.data),
                    "crc32": p.crc,
                    "decoded": p.data,
                }
                for i, p in enumerate(pieces)
            ]
        d = codec.decode(raw)
        body = d.data
        return [
            {
                "piece_idx": 0,
                "status": codec.FULL if d.code is None else codec.ERROR,
                "in_used": d.used,
                "done": False,
                "ended": d.members > 0,
                "out_len": len(body),
                "crc32": codec.zlib.crc32(body),
                "err_code": d.code,
                "message": d.message,
                "decoded": body,
            }
        ]

    schema = (
        "piece_idx int, status string, in_used long, done boolean, ended boolean, want_crc long, want_size long, "
        "out_len long, crc32 long, err_code string, message string, decoded binary"
    )
    return map_value(segments, "payload", make, schema, keep)


def _broken() -> Column:
    return F.col("status").isin(codec.SHORT, codec.ERROR, codec.OVERFLOW) & (F.col("layout") == "blocks")


def islands(status: DataFrame, key: str) -> DataFrame:
    """Adds ``island``: a block segment that ended inside a block, or failed, is merged
    with its successor, whatever that one's own status."""
    w = Window.partitionBy(key).orderBy("seg_idx")
    starts = F.when(F.coalesce(F.lag(_broken()).over(w), F.lit(False)), 0).otherwise(1)
    return status.withColumn("island", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def decode_blocks(
    df: DataFrame,
    key: str,
    packed: str = "packed",
    target: int = fixed.COALESCE_TARGET,
    parallel: bool = True,
    spread: int | None = None,
    limit: int = fixed.MAX_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(blocks, verdicts) of the values of ``df``, each decoded in parallel segments.

    blocks: key, member_idx, block_idx, raw_offset, raw_len, crc32, payload, in order of
    member_idx and block_idx. verdicts: key, members, total, status, err_code, message.
    Keys must be unique; one may be null. A null value has a verdict and no block.
    ``spread`` is the number of partitions that segments are dealt to.

    False boundaries (marker bytes inside data) show as segments that end inside a block;
    they are merged with what follows and inflated again until nothing merges, which ends
    as there are fewer segments each time. Only merged segments are inflated again; ``df``
    is read a second time for the values they belong to, so it must give the same rows. A
    value with a segment that holds more than ``limit`` bytes is decoded as one stream
    instead."""
    # Within a struct, null equals null.
    k = "key__"
    named = df.select(F.struct(F.col(key).alias("of")).alias(k), F.col(packed).alias(packed))

    def segments(values: DataFrame, cut: bool = parallel) -> DataFrame:
        found = plan(values, k, packed, target, cut)
        return found.repartition(spread, k, "seg_idx") if spread else found

    def instead(old: DataFrame, of: list[str], those: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(those, of, "left_anti").select(old.columns).unionByName(new.select(old.columns))

    # Segments are cut and inflated in one stage; only metadata says whether any must merge.
    pieces = materialise(inflate_segments(segments(named), k, limit), "pieces")
    cut = None
    while not pieces.filter(_broken() & ~F.col("is_last") & (F.col("piece_idx") == 0)).isEmpty():
        heads = pieces.filter("piece_idx = 0").select(k, "seg_idx", "layout", "status", "is_last")
        merged = materialise(islands(heads, k), "islands")
        grown = merged.groupBy(k, "island").agg(F.count(F.lit(1)).alias("n"), F.min("seg_idx").alias("first")).filter("n > 1")
        of = materialise(merged.join(grown, [k, "island"]).select(k, "seg_idx", "first"), "of")
        if cut is None:  # once: the payloads of the values concerned
            cut = materialise(segments(named.join(of.select(k).distinct(), k, "left_semi")), "segments")
        parts = F.sort_array(F.collect_list(F.struct("seg_idx", "payload")))["payload"]
        joined = (
            cut.join(of, [k, "seg_idx"])
            .groupBy(k, F.col("first").alias("seg_idx"))
            .agg(
                F.first("layout").alias("layout"),
                F.min("offset").alias("offset"),
                F.sum("length").alias("length"),
                F.max("is_last").alias("is_last"),
                parts.alias("parts"),
            )
            .withColumn("payload", join_bytes("parts"))
        )
        joined = materialise(joined.select(cut.columns), "merged")
        cut = materialise(instead(cut, [k, "seg_idx"], of, joined), "segments")
        pieces = materialise(instead(pieces, [k, "seg_idx"], of, inflate_segments(joined, k, limit)), "pieces")
    large = pieces.filter(F.col("status") == codec.OVERFLOW).select(k).distinct()
    if not large.isEmpty():
        whole = inflate_segments(segments(named.join(large, k, "left_semi"), False), k)
        pieces = materialise(instead(pieces, [k], large, whole), "pieces")
    blocks, seen = _settle(pieces, k)
    return tuple(x.select(F.col(f"{k}.of").alias(key), *[c for c in x.columns if c != k]) for x in (blocks, seen))


def _settle(pieces: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Blocks in order, and verdicts."""
    meta, verdicts = settle(pieces.drop("decoded"), key)
    blocks = meta.filter("layout <> 'none'").select(key, "seg_idx", "piece_idx", "member_idx", "block_idx", "raw_offset").join(
        pieces.select(key, "seg_idx", "piece_idx", F.col("out_len").alias("raw_len"), "crc32", F.col("decoded").alias("payload")),
        [key, "seg_idx", "piece_idx"],
    )
    return blocks.select(key, "member_idx", "block_idx", "raw_offset", "raw_len", "crc32", "payload"), verdicts


def settle(meta: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(pieces that count with member_idx, block_idx and raw_offset; verdicts): members,
    offsets and checksums over metadata only."""
    order = Window.partitionBy(key).orderBy("seg_idx", "piece_idx")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    bad = (F.col("status") != codec.FULL) & (F.col("status") != codec.END)
    # Nothing counts after the segment where the data ended or damage began.
    earlier = F.coalesce(F.max(F.col("done") | bad).over(Window.partitionBy(key).orderBy("seg_idx").rangeBetween(Window.unboundedPreceding, -1)), F.lit(False))
    meta = meta.withColumn("over", earlier).filter(~F.col("over")).drop("over")
    member = F.coalesce(F.sum(F.col("ended").cast("int")).over(past), F.lit(0))
    meta = meta.withColumn("member_idx", member)
    meta = meta.withColumn("block_idx", F.row_number().over(Window.partitionBy(key, "member_idx").orderBy("seg_idx", "piece_idx")) - 1)
    meta = meta.withColumn("raw_offset", F.coalesce(F.sum("out_len").over(past), F.lit(0)))
    meta = materialise(meta, "meta")

    later = Window.partitionBy(key, "member_idx").orderBy(F.col("block_idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum("out_len").over(later), F.lit(0))
    members = (
        meta.filter("layout = 'blocks'")
        .withColumn("shifted", crc32_shift("crc32", after))
        .groupBy(key, "member_idx")
        .agg(
            F.bit_xor("shifted").alias("crc"),
            F.sum("out_len").alias("size"),
            F.max("want_crc").alias("want_crc"),
            F.max("want_size").alias("want_size"),
            F.max("ended").alias("ended"),
            F.max(F.col("status") == codec.ERROR).alias("corrupt"),
        )
    )
    err = (
        F.when(F.col("corrupt"), F.struct(F.lit(codec.DATA_ERROR).alias("err_code"), F.lit("corrupt deflate data").alias("message")))
        .when(~F.col("ended"), F.struct(F.lit(codec.BUF_ERROR).alias("err_code"), F.lit("unexpected end of file").alias("message")))
        .when(F.col("crc") != F.col("want_crc"), F.struct(F.lit(codec.DATA_ERROR).alias("err_code"), F.lit("crc mismatch").alias("message")))
        .when(F.col("size").bitwiseAND(F.lit(fixed.U32)) != F.col("want_size"), F.struct(F.lit(codec.DATA_ERROR).alias("err_code"), F.lit("length mismatch").alias("message")))
    )
    in_blocks = members.select(key, "member_idx", err.alias("e"))
    whole = meta.filter("layout <> 'blocks' AND err_code IS NOT NULL").select(key, "member_idx", F.struct("err_code", "message").alias("e"))
    errors = in_blocks.filter("e IS NOT NULL").unionByName(whole).groupBy(key).agg(F.min_by("e", "member_idx").alias("e"))
    totals = meta.groupBy(key).agg(F.sum("out_len").alias("total"), F.sum(F.col("ended").cast("int")).alias("members"))
    verdicts = totals.join(errors, key, "left").select(
        key,
        "members",
        "total",
        F.when(F.col("e").isNull(), fixed.OK).otherwise(fixed.ERROR).alias("status"),
        F.col("e.err_code").alias("err_code"),
        F.col("e.message").alias("message"),
    )
    return meta, verdicts


def concat_blocks(blocks: DataFrame, key: str, out: str = "data") -> DataFrame:
    """key and the whole decoded value, from its blocks in order."""
    parts = F.sort_array(F.collect_list(F.struct("raw_offset", "member_idx", "block_idx", "payload")))["payload"]
    return blocks.groupBy(key).agg(parts.alias("parts__")).select(key, join_bytes("parts__").alias(out))
