"""Views of compressed values: members, listing, verdicts.

Each reads only what it needs: a listing looks at the first bytes and the last eight, and
never inflates; a test inflates and keeps nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.gzip_format import NotGzip, parse_header, trailer_fields
from ..functions.names import path_is_gzip, ratio
from . import codec
from .arrow import binary, map_value
from .decode import decode

HEAD_BYTES = 4096
MEMBER = (
    "member_idx int, offset long, hdr_len int, flags int, mtime timestamp, name string, name_raw binary, comment string, "
    "xfl int, os int, member_size long, layout string, crc32 long, isize long"
)


def headers(df: DataFrame, packed: str = "packed") -> DataFrame:
    """``df`` with hdr_state (ok, short, not_gzip), hdr_len, flags, hdr_mtime, hdr_name,
    xfl, os and member_size in place of ``packed``; only its first bytes go to Python."""
    keep = [c for c in df.columns if c != packed]

    def make(row: dict) -> list[dict]:
        try:
            h = parse_header(row[packed] or b"")
        except NotGzip:
            return [{"hdr_state": "not_gzip"}]
        if h is None:
            return [{"hdr_state": "short"}]
        name = None if h.name is None else h.name.decode("utf-8", "replace")
        return [{"hdr_state": "ok", "hdr_len": h.length, "flags": h.flags, "hdr_mtime": h.mtime, "hdr_name": name, "xfl": h.xfl, "os": h.os, "member_size": h.member_size}]

    schema = "hdr_state string, hdr_len int, flags int, hdr_mtime long, hdr_name string, xfl int, os int, member_size long"
    return map_value(df.withColumn(packed, F.substring(df[packed].cast("binary"), 1, HEAD_BYTES)), packed, make, schema, keep)


def members(df: DataFrame, key: str, packed: str = "packed") -> DataFrame:
    """key and one row for each gzip member: where it lies, its header and trailer.

    Sized members are found without inflating; others are inflated to find their ends."""
    import datetime

    def make(row: dict) -> list[dict]:
        raw, out, at = row[packed] or b"", [], 0
        while raw.startswith(fixed.MAGIC, at):
            try:
                h = parse_header(raw, at)
            except NotGzip:
                break
            if h is None:
                break
            layout, size = codec.layout_of(raw, h, at), h.member_size
            if layout != "sized":
                size = _member_size(raw, at, h.length)
                if size is None:
                    break
            tail = raw[at + size - fixed.TRAILER_LEN : at + size]
            out.append(
                {
                    "member_idx": len(out),
                    "offset": at,
                    "hdr_len": h.length,
                    "flags": h.flags,
                    "mtime": datetime.datetime.fromtimestamp(h.mtime, datetime.timezone.utc) if h.mtime else None,
                    "name": None if h.name is None else h.name.decode("utf-8", "replace"),
                    "name_raw": h.name,
                    "comment": None if h.comment is None else h.comment.decode("latin1"),
                    "xfl": h.xfl,
                    "os": h.os,
                    "member_size": size,
                    "layout": layout,
                    "crc32": int.from_bytes(tail[:4], "little"),
                    "isize": int.from_bytes(tail[4:], "little"),
                }
            )
            at += size
        return out

    return map_value(binary(df.select(key, packed), packed), packed, make, MEMBER, [key])


def _member_size(raw: bytes, at: int, head: int) -> int | None:
    """Bytes of the member at ``at``, by inflating it; None if it doesn't end."""
    z, pos, view = codec.zlib.decompressobj(-15), at + head, memoryview(raw)
    while not z.eof:
        more = z.unconsumed_tail or view[pos : pos + codec.STEP]
        if not more:
            return None
        if not z.unconsumed_tail:
            pos += len(more)
        try:
            z.decompress(more, codec.STEP)
        except codec.zlib.error:
            return None
    end = pos - len(z.unused_data) + fixed.TRAILER_LEN
    return end - at if end <= len(raw) else None


def listing(df: DataFrame, path: str = "path", packed: str = "packed", stored_names: bool = False, exact: bool = False) -> DataFrame:
    """name, method, crc32, mtime, compressed, uncompressed, ratio, err_code, message.

    The size is the last member's, modulo 2**32, as the format's listing always was; with
    ``exact`` it is the sum over all members. The name is the path without its suffix, or
    the stored one."""
    value = F.col(packed).cast("binary")
    tail = F.substring(value, -fixed.TRAILER_LEN, fixed.TRAILER_LEN)
    sums = members(df, path, packed).groupBy(F.col(path).alias("path__")).agg(F.sum("isize").alias("all__")) if exact else None
    return listed(df, F.col(path), F.octet_length(value), F.col(packed), tail, stored_names, sums)


def listed(df: DataFrame, path: Column, size: Column, head: Column, tail: Column, stored_names: bool = False, sums: DataFrame | None = None) -> DataFrame:
    """A listing from first and last bytes; ``sums`` has the exact sizes by path."""
    shown = F.when(path_is_gzip(path), F.substring(path, F.lit(1), F.length(path) - len(fixed.SUFFIX))).otherwise(path)
    thin = df.select(path.alias("path__"), shown.alias("shown__"), size.cast("long").alias("compressed"), trailer_fields(tail).alias("t__"), head.alias("p__"))
    h = headers(thin, "p__")
    short = F.col("compressed") < fixed.HEADER_LEN + fixed.TRAILER_LEN
    bad = F.col("hdr_state") != "ok"
    good = ~short & ~bad
    name = F.when(F.lit(stored_names) & (F.coalesce("hdr_name", F.lit("")) != ""), F.col("hdr_name")).otherwise(F.col("shown__"))
    out = h.select(
        "path__",
        name.alias("name"),
        F.lit("defla").alias("method"),
        F.when(good, F.col("t__.crc32")).alias("crc32"),
        F.when(good & (F.col("hdr_mtime") != 0), F.timestamp_seconds("hdr_mtime")).alias("mtime"),
        "compressed",
        F.when(good, F.col("t__.isize")).alias("uncompressed"),
        F.when(good, F.lit(fixed.OK)).otherwise(F.lit(fixed.ERROR)).alias("status"),
        F.when(short, "shorter than a header and a trailer").when(F.col("hdr_state") == "short", "header goes beyond what a listing reads").when(bad, "not in gzip format").alias("message"),
    )
    if sums is not None:
        out = out.join(sums, "path__", "left").withColumn("uncompressed", F.when(F.col("status") == fixed.OK, F.coalesce("all__", "uncompressed"))).drop("all__")
    return out.withColumn("ratio", F.when(F.col("status") == fixed.OK, ratio(F.col("compressed"), F.col("uncompressed")))).drop("path__")


def listing_totals(listed: DataFrame) -> DataFrame:
    """The listing's rows and, where there are two or more, a row of totals."""
    rows = listed.filter(F.col("status") == fixed.OK).select("name", "compressed", "uncompressed", "ratio", F.lit(False).alias("is_total"))
    total = (
        listed.filter(F.col("status") == fixed.OK)
        .agg(F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"), F.count(F.lit(1)).alias("n"))
        .filter("n >= 2")
        .select(F.lit("(totals)").alias("name"), "compressed", "uncompressed", ratio(F.col("compressed"), F.col("uncompressed")).alias("ratio"), F.lit(True).alias("is_total"))
    )
    return rows.unionByName(total)


def verdicts(df: DataFrame, packed: str = "packed", strict: bool = True) -> DataFrame:
    """The test mode: ``df`` with members, total_out, status, err_code and message.

    With ``strict`` (as when files are tested) what isn't gzip, null included, is an error,
    found by its first two bytes, before anything is inflated. One pass over the values."""
    return decode(df, packed, payload=False, strict=strict).drop("layout", "total_in")
