"""Mixing sources to target weights (operator 9): iterative proportional fitting, natively.

Token weights are summed by cell (source, language, topic). Each margin has a target for
each of its values: the user's shares, or else tempered natural ones; a value that lacks
the tokens for its share gives all but a reserve of them, and the rest of its share goes to
the others in proportion. Each cell's keeping probability starts at the overall share to
keep and is raked: scaled so that the expected tokens of each source meet the source's
target, then each language's, then each topic's, never above 1. Rounds go on until every
margin of every kind agrees with its target within AGREE. Margins that can't agree at once
(a source all in one language, say) raise an error if the user gave them; natural ones are
tempered half as much and tried again, which ends at the natural shares, where all agree.
A document stays if its own number, a hash of its id, lies below its cell's probability;
the choice is the same on every run.

Scale: one pass over the texts gives the cells, with partial sums; raking works on cells
only. Few cells (a checked number) are raked in a single partition without any shuffle;
more are raked by aggregations over written tables. Cells meet documents in a join on the
cell's key, whose cell side Spark broadcasts where it is small."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, materialise

MARGINS = ("source", "lang", "topic")
KEEP = 0.7  # share of all tokens that stays
TEMPER = 0.85  # targets are natural shares to this power: rare values gain, common ones give
RESERVE = 0.85  # the most that is asked of any value: this share of its tokens
AGREE = 1e-3  # largest difference of a margin from its target, as a share of the target
STEADY = 1e-11  # rounds go on this far where margins agree, so that the result is the limit
BATCH = 12  # rounds between two looks at the margins
PATIENCE = 20  # batches after which margins that still differ are held not to agree
FEW_CELLS = 20_000
NONE = "(none)"
SYMBOLS = r"[#*$%&|<>{}=_]"
NOTICE = "licen[cs]e|rights reserved|copyright"


def topic(text: Column) -> Column:
    """A topic for tables that have none: what the text is made of, by its characters, and
    its length. SQL on either engine agrees on it."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    return (
        F.when(F.lower(t).rlike(NOTICE), "notice")
        .when(20 * F.regexp_count(t, F.lit(SYMBOLS)) > n, "markup")
        .when(20 * F.regexp_count(t, F.lit("[0-9]")) > n, "figures")
        .when(80 * F.regexp_count(t, F.lit("\n")) > n, "list")
        .when(n < 500, "short")
        .when(n < 4000, "article")
        .otherwise("long")
    )


def weight(text: Column) -> Column:
    """Token weight of a document: characters over four, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


class MarginsDisagree(ValueError):
    """Targets that no probabilities meet; the message names one that is missed."""


def _raking(cells: DataFrame) -> list[str]:
    """The margins that have targets."""
    return [m for m in MARGINS if f"t_{m}" in cells.columns]


def _raked(cells: DataFrame, few: bool) -> DataFrame:
    """BATCH rounds of raking of ``cells`` (margins, n, p and for each margin t_<margin>)."""
    if few:
        # In one partition, windows need no exchange.
        cells = cells.coalesce(1)
    for _ in range(BATCH):
        for m in _raking(cells):
            if few:
                cells = cells.withColumn("had", F.sum(F.col("p") * F.col("n")).over(Window.partitionBy(m)))
            else:
                sums = materialise(cells.groupBy(m).agg(F.sum(F.col("p") * F.col("n")).alias("had")), "margin")
                cells = cells.join(sums, m)
            scaled = F.when(F.col("had") > 0, F.col("p") * F.col(f"t_{m}") / F.col("had")).otherwise(0.0)
            cells = cells.withColumn("p", F.least(F.lit(1.0), scaled)).drop("had")
        if not few:
            cells = materialise(cells, "cells")
    return materialise(cells, "cells")


def margins(cells: DataFrame) -> DataFrame:
    """margin, value, target, expected (tokens) and gap, their difference as a share of the
    target: the report on probabilities p."""
    out = None
    for m in _raking(cells):
        one = cells.groupBy(m).agg(F.first(f"t_{m}").alias("target"), F.sum(F.col("p") * F.col("n")).alias("expected"))
        one = one.select(F.lit(m).alias("margin"), F.col(m).alias("value"), "target", "expected")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("gap", F.abs(F.col("expected") - F.col("target")) / F.greatest(F.lit(1.0), F.col("target")))


def targets_of(cells: DataFrame, margin: str, keep: float, temper: float, shares: Mapping[str, float] | None = None) -> DataFrame:
    """margin and t_<margin>: tokens wanted of each value, none over RESERVE (or ``keep``,
    if that is more) of what it has.

    What a bounded value can't give goes to the others by their shares. A value is bounded
    if the level that all before it (by what they have for their share) leave is over its
    bound."""
    own = cells.groupBy(margin).agg(F.sum("n").alias("own"))
    if shares is None:
        own = own.withColumn("w", F.pow(F.col("own").cast("double"), temper))
    else:
        given = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]) if shares else F.lit(None).cast("map<string,double>")
        own = own.withColumn("w", F.coalesce(F.try_element_at(given, F.col(margin)).cast("double"), F.lit(0.0)))
    total = own.agg(F.sum("own"), F.sum("w")).first()
    want, weights = keep * (total[0] or 0), total[1] or 0.0
    if shares is not None and want and not weights > 0:
        raise MarginsDisagree(f"no value of {margin} has a target above zero")
    own = own.withColumn("cap", F.col("own") * F.lit(max(RESERVE, keep)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(float("inf")), margin)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left_t = F.lit(want) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_w = F.lit(weights) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = left_t / F.greatest(left_w, F.col("w"))
    own = own.withColumn("bounded", (F.col("w") > 0) & (F.col("w") * level > F.col("cap")))
    own = materialise(own, "targets")
    rest = own.agg(
        F.coalesce(F.sum(F.when(F.col("bounded"), F.col("cap"))), F.lit(0.0)).alias("cap"),
        F.coalesce(F.sum(F.when(~F.col("bounded"), F.col("w"))), F.lit(0.0)).alias("w"),
    ).first()
    if rest["w"] <= 0 and rest["cap"] < want * (1 - AGREE):
        raise MarginsDisagree(f"the targets of {margin} ask for {want:.0f} tokens of {rest['cap']:.0f} there are")
    level = (want - rest["cap"]) / rest["w"] if rest["w"] > 0 else 0.0
    return own.select(margin, F.when(F.col("bounded"), F.col("cap")).otherwise(F.col("w") * F.lit(level)).alias(f"t_{margin}"))


def _fitted(cells: DataFrame, keep: float, temper: float, targets: Mapping[str, Mapping[str, float]], few: bool) -> DataFrame:
    """``cells`` with p and t_<margin>, raked until the margins agree."""
    now = cells.withColumn("p", F.lit(keep))
    for m in targets or MARGINS:
        now = now.join(targets_of(cells, m, keep, temper, targets.get(m)), m)
    now = materialise(now, "cells")
    gap = 1.0
    for _ in range(PATIENCE):
        now = _raked(now, few)
        gap = margins(now).agg(F.max("gap")).first()[0] or 0.0
        if gap <= STEADY:
            return now
    if gap <= AGREE:
        return now
    worst = margins(now).orderBy(F.col("gap").desc(), "margin", "value").first()
    raise MarginsDisagree(f"{worst['margin']} {worst['value']!r} has {worst['expected']:.0f} tokens of {worst['target']:.0f} wanted when raking no longer helps")


def number(doc_id: Column) -> Column:
    """A number in [0, 1) that follows from the id: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|mix")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _cell(topics: str | Column | None) -> list[Column]:
    """source, lang and topic of a document; ``topics`` as in ``mix``."""
    of = topic(F.col("text")) if topics is None else F.coalesce(F.col(topics) if isinstance(topics, str) else topics, F.lit(NONE))
    return [F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), of.alias("topic")]


def probabilities(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    keep: float = KEEP,
    topics: str | Column | None = None,
    few_cells: int = FEW_CELLS,
) -> DataFrame:
    """source, lang, topic, n (tokens), p and the wanted tokens by margin, for each cell.

    ``targets``: for each margin, shares of its values; values left out get none, margins
    left out are free. Raises MarginsDisagree where they can't be met together."""
    targets = dict(targets or {})
    if unknown := set(targets) - set(MARGINS):
        raise ValueError(f"unknown margins {sorted(unknown)}")
    cells = docs.select(*_cell(topics), weight(F.col("text")).alias("w")).groupBy(*MARGINS).agg(F.sum("w").alias("n"))
    cells = materialise(cells, "cells")
    few = cells.count() <= few_cells
    temper = TEMPER
    while True:
        try:
            return _fitted(cells, keep, temper, targets, few)
        except MarginsDisagree:
            if targets or temper == 1.0:
                raise
            temper = (1 + temper) / 2 if temper < 0.97 else 1.0


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    keep: float = KEEP,
    topics: str | Column | None = None,
    few_cells: int = FEW_CELLS,
) -> DataFrame:
    """``docs`` with topic__, p__ (probability to stay) and kept__; where ``docs`` has a
    column of one of these names, it comes with another underscore.

    ``targets``: for each margin (source, lang, topic) the shares of its values; margins
    left out are free. Without any, all three follow their tempered natural shares. ``keep``: the share of all tokens that
    stays. ``topics``: a column with the topic, by its name or as an expression.

    A null source, language or topic is a value of its own, ``(none)``; null text weighs one
    token; rows that repeat an id stay or go together; a null id counts as the empty one. An
    empty table gives an empty table."""
    source, lang, kind, p, kept = free(docs, "source__", "lang__", "topic__", "p__", "kept__")
    cells = probabilities(docs, targets, keep, topics, few_cells)
    cells = cells.select(*[F.col(m).alias(c) for m, c in zip(MARGINS, (source, lang, kind))], F.col("p").alias(p))
    found = docs.withColumns(dict(zip((source, lang, kind), _cell(topics)))).join(cells, [source, lang, kind], "left")
    return found.withColumn(kept, number(found["doc_id"]) < found[p]).select(*docs.columns, kind, p, kept)


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, **more) -> DataFrame:
    """The documents that stay, with the columns of ``docs``; further arguments as ``mix``."""
    found = mix(docs, targets, **more)
    return found.filter(F.col(found.columns[-1])).select(*docs.columns)


SQL_ROUNDS = 60


def oracle_sql() -> str:
    """The same in DuckDB: one step of raking is one common table expression, and more of
    them than it takes to reach the limit."""
    bounds = ",\n".join(
        f"""o_{m} AS (SELECT {m}, sum(n) AS own, {RESERVE} * sum(n) AS cap, pow(sum(n), {TEMPER}) AS w FROM cells GROUP BY {m}),
b_{m} AS (SELECT *, w * ({KEEP} * sum(own) OVER () - coalesce(sum(cap) OVER before, 0)) / greatest(w, sum(w) OVER () - coalesce(sum(w) OVER before, 0)) > cap AS bounded
  FROM o_{m} WINDOW before AS (ORDER BY cap / w, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t_{m} AS (SELECT {m}, CASE WHEN bounded THEN cap ELSE w * ({KEEP} * sum(own) OVER () - coalesce(sum(cap) FILTER (bounded) OVER (), 0))
  / sum(w) FILTER (NOT bounded) OVER () END AS t_{m} FROM b_{m})"""
        for m in MARGINS
    )
    steps, last = [], "r0"
    for _ in range(SQL_ROUNDS):
        for m in MARGINS:
            name = f"r{len(steps) + 1}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (least(1.0, p * t_{m} / sum(p * n) OVER (PARTITION BY {m})) AS p) FROM {last})")
            last = name
    return f"""
WITH c AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS t, length(coalesce(text, '')) AS n
  FROM documents),
d AS (
  SELECT doc_id, source, lang,
    CASE WHEN regexp_matches(lower(t), '{NOTICE}') THEN 'notice'
         WHEN 20 * (n - length(regexp_replace(t, '{SYMBOLS}', '', 'g'))) > n THEN 'markup'
         WHEN 20 * (n - length(regexp_replace(t, '[0-9]', '', 'g'))) > n THEN 'figures'
         WHEN 80 * (n - length(replace(t, chr(10), ''))) > n THEN 'list'
         WHEN n < 500 THEN 'short' WHEN n < 4000 THEN 'article' ELSE 'long' END AS topic,
    greatest(1, CAST(ceil(n / 4) AS BIGINT)) AS w
  FROM c),
cells AS (SELECT source, lang, topic, CAST(sum(w) AS DOUBLE) AS n FROM d GROUP BY ALL),
{bounds},
r0 AS (SELECT cells.*, t_source, t_lang, t_topic, CAST({KEEP} AS DOUBLE) AS p
  FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
{", ".join(steps)}
SELECT d.doc_id, d.source, d.lang, d.topic, round(r.p, 5) AS p,
  CAST(CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || '|mix'), 1, 13) AS BIGINT) AS DOUBLE) / {float(1 << 52)} < r.p AS kept
FROM d JOIN {last} r USING (source, lang, topic)
"""
