"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_dir  # noqa: F401

# Characters that separate words in every contract: space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, by a path that only Spark needs to resolve."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Select and rename: ``only(df, id="doc_id")``. Extra columns, also ones whose
    names clash with an operator's own, are left behind."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` has it: tables may
    hold extra columns of any name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``.

    Column expressions have no local names; an expression used inside a lambda would be
    computed again for every element. A one-element array binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text, in order; null counts as empty.

    Splitting at one character needs no regular expression, so the other five separators
    become spaces first."""
    flat = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def row_key() -> Column:
    """Tells rows apart that share a doc_id; equal for repeated rows, which get equal
    verdicts. 96 bits, so that rows of a large corpus don't meet by chance."""
    cols = ("doc_id", "text", "lang", "source")
    return F.struct(F.xxhash64(*cols).alias("a"), F.hash(*cols).alias("b"))


def single_thread() -> None:
    """For use on executors: libraries must not start threads of their own there."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def give_back() -> None:
    """Returns to the system what this process has freed."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc keeps so much and has this function


def lean(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """``run``, a function over batches, whose worker is small again after each task.

    Python workers outlive their tasks and stand idle beside the JVM while later stages
    fill its heap; allocators would keep for them what a task once needed. ``forget``
    drops what the worker itself keeps between tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
                gc.collect()  # what is dropped may hold itself
            give_back()

    return wrapped


def lean_group(run: Callable) -> Callable:
    """As ``lean``, for a function over one group's table."""

    @functools.wraps(run)
    def wrapped(table):
        try:
            return run(table)
        finally:
            give_back()

    return wrapped
