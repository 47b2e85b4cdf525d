"""Encode: values to gzip members; chunks to blocks; blocks to values again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.checksum import combine_crc
from ..functions.gear import hits, span_mask
from ..functions.gzip_format import header_column, trailer_column
from . import codec
from .arrow import binary, join_bytes, map_value
from .codec import Settings


def chunks(df: DataFrame, key: str | Sequence[str], data: str, settings: Settings = Settings(), flush: str | None = None, payload: bool = True) -> DataFrame:
    """key, chunk_idx, offset, length, cut, is_last[, payload]: one row a chunk.

    ``flush`` names an array column of offsets where the caller wants cuts. An empty value
    is one empty chunk; a null one has none. No shuffle."""
    keys = [key] if isinstance(key, str) else list(key)

    def make(row: dict) -> list[dict]:
        raw = row[data]
        if raw is None:
            return []
        cuts = codec.split_at(settings.cuts(raw), row[flush] or []) if flush else settings.cuts(raw)
        cuts = cuts or [(0, 0, "end")]
        out = []
        for k, (at, n, kind) in enumerate(cuts):
            made = {"chunk_idx": k, "offset": at, "length": n, "cut": kind, "is_last": k + 1 == len(cuts)}
            if payload:
                made["payload"] = raw[at : at + n]
            out.append(made)
        return out

    schema = "chunk_idx int, offset long, length long, cut string, is_last boolean" + ", payload binary" * payload
    thin = binary(df.select(*keys, data, *([flush] if flush else [])), data)
    return map_value(thin, data, make, schema, keys)


def sync_points(df: DataFrame, key: str, data: str, span: int = fixed.STREAM_SYNC_SPAN, least: int = fixed.SPAN_MIN) -> DataFrame:
    """key, pos: where the content's hash hits the mask of ``span``."""
    mask = span_mask(span, least)

    def make(row: dict) -> list[dict]:
        return [{"pos": int(p)} for p in hits(row[data] or b"", mask)]

    return map_value(binary(df.select(key, data), data), data, make, "pos long", [key])


def deflate_chunks(chunked: DataFrame, key: str | Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """key, block_idx, raw_offset, raw_len, level, strategy, is_last, crc32, deflated.

    Columns level and strategy of ``chunked``, where they are there, set each block's own.
    Each chunk is a row of its own, so the blocks of one large value spread over all cores
    after a repartition."""
    keys = [key] if isinstance(key, str) else list(key)
    own = set(chunked.columns)
    level = F.coalesce("level", F.lit(settings.level)) if "level" in own else F.lit(settings.level)
    strategy = F.coalesce("strategy", F.lit(settings.strategy)) if "strategy" in own else F.lit(settings.strategy)
    rows = chunked.select(
        *keys,
        F.col("chunk_idx").alias("block_idx"),
        F.col("offset").alias("raw_offset"),
        F.col("length").alias("raw_len"),
        level.alias("level"),
        strategy.alias("strategy"),
        "is_last",
        F.crc32("payload").alias("crc32"),
        "payload",
    )
    keep = [c for c in rows.columns if c != "payload"]

    def make(row: dict) -> list[dict]:
        return [{"deflated": codec.deflate_block(row["payload"], row["level"], fixed.STRATEGIES[row["strategy"]], row["is_last"])}]

    return map_value(rows, "payload", make, "deflated binary", keep)


def assemble(blocks: DataFrame, key: str, mtime: Column | None = None, name: Column | None = None) -> DataFrame:
    """key, packed, crc32, total: blocks in order between a header and a trailer.

    The checksum is combined from the blocks', whose order enters as the bytes that follow
    each. A value is one cell here; what won't fit in one is written by the data source."""
    sums = combine_crc(blocks, [key], ["block_idx"]).drop("parts")
    body = (
        blocks.select(key, "block_idx", "deflated", "level", "strategy")
        .groupBy(key)
        .agg(
            F.sort_array(F.collect_list(F.struct("block_idx", "deflated"))).alias("parts"),
            F.min_by("level", "block_idx").alias("level"),
            F.min_by("strategy", "block_idx").alias("strategy"),
        )
    )
    code = F.coalesce(*[F.when(F.col("strategy") == k, v) for k, v in fixed.STRATEGIES.items()])
    head = header_column(F.col("level"), code, F.lit(0) if mtime is None else mtime, F.lit(None).cast("binary") if name is None else name)
    bytes_ = join_bytes(F.col("parts.deflated"))
    return body.join(sums, key).select(
        key, F.concat(head, bytes_, trailer_column(F.col("crc32"), F.col("total"))).alias("packed"), "crc32", "total"
    )


def encode(df: DataFrame, data: str, settings: Settings = Settings(), out: str = "packed", mtime: str | None = None, name: str | None = None) -> DataFrame:
    """``df`` with its payload encoded, one value a row, in the layout of ``settings``.

    A map without a shuffle: the plan for many values of moderate size. For few large
    values use chunks, deflate_chunks and assemble. Null stays null."""
    keep = [c for c in df.columns if c != data]

    def make(row: dict) -> list[dict]:
        raw = row[data]
        if raw is None:
            return [{out: None}]
        when = row[mtime] if mtime else 0
        called = row[name] if name else None
        if isinstance(called, str):
            called = called.encode()
        return [{out: codec.encode(raw, settings, int(when or 0), called)}]

    return map_value(binary(df, data), data, make, f"{out} binary", keep)
