"""Files as they arrive: decoded or verified by the same operators as tables.

The operators are maps without state, so they run on streams as they are; each file is one
row, taken once. An extension: batch users need none of this."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decode import decode

FILES = "path string, modificationTime timestamp, length long, content binary"


def decoded_stream(spark: SparkSession, path: str, suffix: str | None = None, payload: bool = True, files_per_trigger: int = 1000) -> DataFrame:
    """path, mtime, data, members, layout, total_in, total_out, status, err_code, message
    of new files under ``path``; ``payload=False`` leaves the verdict alone."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    found = reader.load(path).select("path", F.col("modificationTime").alias("mtime"), "content")
    return decode(found, "content", payload=payload)
