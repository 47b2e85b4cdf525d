"""Line dedup (operator 4): boilerplate is a line that is spread over many sites.

For each line hash a HyperLogLog sketch of its sites (sources) is merged by aggregation,
with partial sketches before the shuffle. Lines whose estimate is clearly above the
threshold are boilerplate, clearly below are not; lines near it get an exact count of
distinct sites. Of a boilerplate line the document with the smallest id keeps its copy,
all others lose theirs.

Scale: only hashes and positions are shuffled, not lines. Lines in fewer documents than
the threshold can't be on that many sites and get no sketch. A line in a third of all
documents is summed up before the shuffle; the join that finds its positions has one row
for the line on the other side, so Spark may split it. Texts meet the positions to drop
once, by row key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, let, materialise, row_key

MIN_SITES = 10
# A share of the threshold on either side: some four standard errors (1.04 / sqrt(256)).
NEAR = 0.26
LOG_K = 8
BLANK = " \t\r"

ORACLE_SQL = f"""
WITH pieces AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
marked AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS k FROM pieces),
boiler AS (
  SELECT k, min(doc_id) AS first_id FROM marked WHERE k <> ''
  GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}),
kept AS (
  SELECT m.doc_id, m.pos, m.line, (b.k IS NOT NULL AND m.doc_id <> b.first_id) AS gone
  FROM marked m LEFT JOIN boiler b ON m.k = b.k),
joined AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
         count(*) FILTER (gone) AS n_removed
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, j.text, d.lang, d.source, CAST(length(j.text) AS BIGINT) AS n_chars, j.n_removed
FROM documents d JOIN joined j ON d.doc_id = j.doc_id
"""


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def lines(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, source, pos and the hashes h, h2 of every line that isn't blank."""
    hashed = F.transform(
        F.split("text", "\n"),
        lambda x: F.when(_key(x) != "", F.struct(F.xxhash64(_key(x)).alias("h"), F.hash(_key(x)).alias("h2"))),
    )
    return (
        docs.select(row_key().alias("row_key"), "doc_id", "source", F.posexplode(hashed).alias("pos", "x"))
        .filter("x IS NOT NULL")
        .select("row_key", "doc_id", "source", "pos", "x.h", "x.h2")
    )


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h, h2, first_id and n_docs of lines on at least ``min_sites`` different sites."""
    often = (
        found.groupBy("h", "h2")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_sites)
    )
    often = materialise(often, "often")
    candidates = materialise(found.join(often.select("h", "h2"), ["h", "h2"]).select("h", "h2", "source"), "sites")
    spread = candidates.groupBy("h", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(LOG_K))).alias("sites"))
    spread = materialise(spread, "spread")
    near = spread.filter(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR)))
    exact = (
        candidates.join(near.select("h", "h2"), ["h", "h2"])
        .distinct()
        .groupBy("h", "h2")
        .agg(F.count("source").alias("n"))
        .filter(F.col("n") >= min_sites)
    )
    clear = spread.filter(F.col("sites") > min_sites * (1 + NEAR))
    return often.join(clear.select("h", "h2").unionByName(exact.select("h", "h2")), ["h", "h2"])


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, count: str | None = None) -> DataFrame:
    """``docs`` without boilerplate lines, n_chars brought up to date; with ``count``, a
    column of that name says how many lines went.

    All rows stay, also those left with no text. Null texts stay null; blank lines are
    never boilerplate; lines are compared without white space at their ends; a null source
    is no site; a null doc_id never keeps the first copy. Rows that repeat the first
    document keep their lines as it does. Columns beyond those of documents stay, whatever
    their names; ``count`` must be none of them."""
    names = docs.columns
    key, gone_at, new = free(docs, "key__", "gone__", "new__")
    found = materialise(lines(docs), "lines")
    boiler = boilerplate(found, min_sites)
    gone = (
        found.join(boiler, ["h", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("first_id")) | F.col("doc_id").isNull())
        .groupBy(F.col("row_key").alias(key))
        .agg(F.sort_array(F.collect_set("pos")).alias(gone_at))
    )
    here = docs.withColumn(key, row_key()).join(gone, key, "left")
    # A flag for each line up to the last that goes, in one pass over the positions.
    flags = F.flatten(
        F.transform(
            gone_at,
            lambda p, i: F.concat(
                F.array_repeat(F.lit(False), (p - F.coalesce(F.get(gone_at, i - 1), F.lit(-1)) - 1).cast("int")),
                F.array(F.lit(True)),
            ),
        )
    )
    kept = let(flags, lambda f: F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.get(f, i), F.lit(False))))
    kept = F.array_join(kept, "\n")
    here = here.withColumn(new, F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(kept))
    out = []
    for c in names:
        if c == "text":
            out.append(F.col(new).alias("text"))
        elif c == "n_chars":
            out.append(F.coalesce(F.char_length(new), F.lit(0)).cast("long").alias("n_chars"))
        else:
            out.append(here[c])
    if count:
        out.append(F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias(count))
    return here.select(*out)
