"""Names, sizes and outcomes, all in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def path_is_gzip(path: Column) -> Column:
    """By suffix, with a stem before it."""
    return F.endswith(path, F.lit(fixed.SUFFIX)) & (F.length(path) > len(fixed.SUFFIX))


def derive_paths(path: Column, decompress: Column) -> Column:
    """Where to read and write: struct(in_path, out_path), null where the name won't fit."""
    longer = F.concat(path, F.lit(fixed.SUFFIX))
    shorter = F.substring(path, F.lit(1), F.length(path) - len(fixed.SUFFIX))
    both = (
        F.when(~decompress, F.struct(path.alias("in_path"), longer.alias("out_path")))
        .when(path_is_gzip(path), F.struct(path.alias("in_path"), shorter.alias("out_path")))
        .otherwise(F.struct(longer.alias("in_path"), path.alias("out_path")))
    )
    return F.when(F.octet_length(path) + len(fixed.SUFFIX) < fixed.PATH_MAX, both)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def path_from_stored(out_path: Column, in_path: Column, stored: Column) -> Column:
    """The stored name's last part, in the input's directory; ``out_path`` if it is empty."""
    base = base_name(F.coalesce(stored, F.lit("")))
    return F.when(base == "", out_path).otherwise(F.concat(F.regexp_extract(in_path, r"^(.*/)?", 0), base))


def parse_size(text: Column) -> Column:
    """Bytes of a size like 128, 128K, 1M or 1G; a bare number counts KiB. 0 is invalid:
    no number, anything after the suffix, zero, or over the largest block."""
    pattern = r"^\s*\+?([0-9]+)([kKmMgG]?)$"
    digits = F.regexp_extract(text, pattern, 1)
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    value = digits.try_cast("decimal(38,0)")
    scale = F.when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1 << 10)
    most = F.lit(fixed.MAX_BLOCK) / scale
    good = value.isNotNull() & (value > 0) & (value <= most)
    return F.when(good, F.least(value, F.lit(fixed.MAX_BLOCK)).cast("long") * scale.cast("long")).otherwise(F.lit(0).cast("long"))


def ratio(compressed: Column, uncompressed: Column) -> Column:
    """Per cent saved; 0 where there was nothing."""
    return F.when(uncompressed == 0, F.lit(0.0)).otherwise(100.0 * (1.0 - compressed / uncompressed))


def severity(status: Column) -> Column:
    return F.when(status == fixed.ERROR, 2).when(status == fixed.WARNING, 1).otherwise(0)


def worst(status: Column) -> Column:
    """Aggregate: the worst outcome of a group as an exit status (error 1, warning 2)."""
    return F.element_at(F.array(F.lit(0), F.lit(2), F.lit(1)), F.max(severity(status)) + 1)
