"""Quality rules (operator 10): robust multivariate outliers, natively in Spark SQL.

Every document gets a vector of transformed statistics. For each (language, source) the
minimum-covariance-determinant estimate of centre and scatter is sought: the H_SHARE of
rows whose covariance (with least deviations added to its diagonal) has the smallest
determinant. Three deterministic starts (distances from the coordinatewise medians, from
the mean with the whole covariance, and from the mean of squashed coordinates) each take
two concentration steps: estimate, measure Mahalanobis distances, keep the closest share.
The start with the smallest determinant goes on until no group's determinant falls any
more. Documents far from the centre of their group are rejected, besides those that fail
the base rules.

Scale: the texts are read once; what follows works on a thin table of one vector a
document. Each concentration step is two aggregations with partial sums (a mergeable
quantile sketch, and moments), so that a group with a third of all rows costs no task more
than its share. No row is ever gathered by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, let, materialise, only, row_key, words

SYMBOLS = r"[#*$%&|<>]"
# Pseudo-words added to each document, so that short texts don't look extreme by chance.
PRIOR_WORDS = 20
PRIOR_WORD_CHARS = 5.0
# Least standard deviations of the four transformed statistics: most clean documents have
# no symbol and no repeat at all, and their exact covariance would be singular.
FLOORS = (0.03, 0.06, 0.06, 0.03)
DIMS = len(FLOORS)
# Chi-square quantile, 4 degrees of freedom, at 0.99999.
CUTOFF = 28.47
H_SHARE = 0.75
# What the scatter of the closest share must be multiplied by to estimate that of a normal
# sample of n rows: CONSISTENCY * (1 + SMALL / n), the second factor from simulations.
CONSISTENCY, SMALL = 1.5, 45.0
STARTS, START_STEPS = 3, 2
CONVERGED = 1e-3  # a fall of the determinant's logarithm that is none; the sketches' precision
# Groups with fewer rows that pass the base rules can't support an estimate in DIMS
# dimensions. They are pooled by language, then all together; a last pool that is too small
# as well is judged by the estimate over all rows.
MIN_ROWS = 5 * DIMS
# Up to so many groups, their estimates (under 300 bytes each) are broadcast; beyond, each
# estimate is dealt to SALTS places and rows are dealt over them.
FEW_GROUPS = 10_000
# Up to so many rejected rows, their keys (under 50 bytes each) are broadcast, and texts
# aren't shuffled to drop a few of them.
FEW_REJECTED = 100_000
SALTS = 16


def _repeat_words(tokens: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in one text.

    Windows are 64-bit hashes. Only texts with a repeated hash are sorted: equal hashes
    become neighbours, their positions are sorted again and the union of
    [position, position + 5) is counted, all in n log n."""
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))

    def shifted(x: Column, by: int) -> Column:
        return F.slice(x, F.lit(by + 1), F.size(x))

    def both(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda a, b: F.xxhash64(a, b))

    # Hashes of 2, 4, then 5 neighbours, from arrays zipped with themselves: no element is
    # fetched by index. The last four entries lack their neighbours and are cut off.
    def windows(h: Column) -> Column:
        pairs = let(h, lambda x: both(x, shifted(x, 1)))
        fours = let(pairs, lambda x: both(x, shifted(x, 2)))
        return F.slice(both(fours, shifted(h, 4)), F.lit(1), F.size(h) - 4)

    def covered(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def positions(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]),
            )
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        def union(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

        return let(let(ranked, positions), union)

    def count(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))

    return F.when(F.size(tokens) < 6, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), count))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, row_key and the contract's counts for every row of ``docs``."""
    df = only(docs, doc_id="doc_id", text="text", lang="lang", source="source").withColumn("row_key", row_key())
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_START))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return df.select(
        "doc_id",
        "lang",
        "source",
        "row_key",
        let(words(text), counts).alias("c"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"),
    ).select(
        "doc_id", "lang", "source", "row_key", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words"
    )


WORD_START = r"[^\x20\x09-\x0D]"


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds x0..x3: symbols, word length, repetition and repeated lines, transformed and
    drawn towards ordinary text by PRIOR_WORDS pseudo-words."""
    n = F.col("n_words") + F.lit(float(PRIOR_WORDS))
    return (
        stats.withColumn("base_failed", base_failed())
        .withColumn("x0", F.log1p(F.col("n_symbols") / n))
        .withColumn("x1", F.log((F.col("word_chars") + F.lit(PRIOR_WORDS * PRIOR_WORD_CHARS)) / n))
        .withColumn("x2", F.col("n_repeat_words") / n)
        .withColumn("x3", F.col("n_dup_lines") / n)
    )


def meet(rows: DataFrame, groups: DataFrame, on: list[str], few: bool) -> DataFrame:
    """Left join of rows (which have a ``salt``) to one row for each group. Either way no
    task gets all rows of a hot group."""
    if few:
        return rows.join(F.broadcast(groups), on, "left")
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(dealt, [*on, "salt"], "left").select(*rows.columns, *[c for c in groups.columns if c not in on])


def _grouped(v: DataFrame, few_groups: int) -> tuple[DataFrame, bool, bool]:
    """Adds ``grp``: language and source where enough rows pass the base rules, else the
    language's other rows, else all the rest. Also says whether the groups are few, and
    whether the last pool is too small for an estimate of its own."""
    none = F.lit("\u0000")
    v = v.withColumn("lang_", F.coalesce("lang", none)).withColumn("source_", F.coalesce("source", none))
    per = v.groupBy("lang_", "source_").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    small = per.filter(F.col("n") < MIN_ROWS).groupBy("lang_").agg(F.sum("n").alias("n_lang"))
    named = per.join(small, "lang_", "left").select(
        "lang_",
        "source_",
        "n",
        F.when(F.col("n") >= MIN_ROWS, F.to_json(F.struct("lang_", "source_")))
        .when(F.col("n_lang") >= MIN_ROWS, F.to_json(F.struct("lang_")))
        .otherwise(REST)
        .alias("grp"),
    )
    named = materialise(named, "groups")
    seen = named.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.when(F.col("grp") == REST, F.col("n"))).alias("rest")).first()
    few = seen["groups"] <= few_groups
    return meet(v, named.drop("n"), ["lang_", "source_"], few), few, 0 < (seen["rest"] or 0) < MIN_ROWS


REST = "{}"
X = [f"x{i}" for i in range(DIMS)]
CELLS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
FIT = ["n_fit", *[f"m{i}" for i in range(DIMS)], *[f"s{i}{j}" for i, j in CELLS]]


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Number, means and covariances of each group as columns FIT, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_fit")]
    aggs += [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)]
    aggs += [F.covar_pop(X[i], X[j]).alias(f"s{i}{j}") for i, j in CELLS]
    return rows.groupBy(*by).agg(*aggs)


def _factored(fit: DataFrame, scale: Column | None = None) -> DataFrame:
    """Adds the Cholesky factor l_ij of each group's scatter (times ``scale``, floors added
    to its diagonal) and log_det, the logarithm of its determinant."""
    chol: dict[tuple[int, int], str] = {}
    for i, j in CELLS:
        cell = F.col(f"s{i}{j}") if scale is None else F.col(f"s{i}{j}") * scale
        if i == j:
            cell = cell + F.lit(FLOORS[i] ** 2)
        for k in range(j):
            cell = cell - F.col(chol[i, k]) * F.col(chol[j, k])
        name = f"l{i}{j}"
        fit = fit.withColumn(name, F.sqrt(F.greatest(cell, F.lit(1e-12))) if i == j else cell / F.col(chol[j, j]))
        chol[i, j] = name
    return fit.withColumn("log_det", sum((2 * F.log(F.col(chol[i, i])) for i in range(1, DIMS)), 2 * F.log(F.col(chol[0, 0]))))


def _with_distance(rows: DataFrame, factored: DataFrame, on: list[str], few: bool) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance: forward substitution, column by column."""
    factor = [f"l{i}{j}" for i, j in CELLS]
    out = meet(rows, factored.select(*on, *[f"m{i}" for i in range(DIMS)], *factor), on, few)
    for i in range(DIMS):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIMS)), F.col("z0") * F.col("z0"))
    return out.withColumn("d2", d2).select(*rows.columns, "d2")


def _concentrated(rows: DataFrame, by: list[str], few: bool) -> DataFrame:
    """One step: the estimate of each group's closest H_SHARE of ``rows`` (which have d2),
    ties at the edge all taken in. The quantile is exact up to 1000 rows a group."""
    edge = rows.groupBy(*by).agg(F.percentile_approx("d2", H_SHARE, 1000).alias("edge"))
    half = meet(rows, edge, by, few).filter(F.col("d2") <= F.col("edge"))
    return materialise(_factored(_moments(half, by)), "mcd")


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """``rows`` STARTS times over, with the number of the start and its distances d2."""
    centre = rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"c{i}") for i, x in enumerate(X)])
    centred = meet(rows, materialise(centre, "medians"), ["grp"], few)
    scaled = [(F.col(x) - F.col(f"c{i}")) / F.lit(FLOORS[i]) for i, x in enumerate(X)]
    near = sum((z * z for z in scaled[1:]), scaled[0] * scaled[0])
    squashed = [F.tanh(z / 2) * F.lit(2 * FLOORS[i]) for i, z in enumerate(scaled)]
    first = centred.select(*rows.columns, near.alias("d2"), F.lit(0).alias("start"))
    flat = centred.select("grp", "salt", *X, F.struct(*[z.alias(x) for x, z in zip(X, squashed)]).alias("y"))
    kinds = F.array(F.struct(F.lit(1).alias("start"), F.struct(*X).alias("v")), F.struct(F.lit(2).alias("start"), F.col("y").alias("v")))
    both = flat.select("grp", "salt", F.struct(*X).alias("x"), F.explode(kinds).alias("k")).select("grp", "salt", "x", "k.start", "k.v.*")
    fit = materialise(_factored(_moments(both, ["grp", "start"])), "starts")
    rest = _with_distance(both, fit, ["grp", "start"], few).select("grp", "salt", "x.*", "d2", "start")
    return materialise(first.select(rest.columns).unionByName(rest), "starts")


def estimates(rows: DataFrame, few: bool) -> DataFrame:
    """grp, FIT, the factor and log_det: the scatter of smallest determinant found for each
    group of ``rows`` (grp, salt and X)."""
    by = ["grp", "start"]
    fit = _concentrated(_starts(rows, few), by, few)
    all_starts = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    for _ in range(START_STEPS - 1):
        fit = _concentrated(_with_distance(all_starts, fit, by, few), by, few)
    state = [c for c in fit.columns if c not in by]
    best = fit.groupBy("grp").agg(F.min_by(F.struct(*state), F.struct("log_det", "start")).alias("x")).select("grp", "x.*")
    best = materialise(best, "mcd")
    falls = True
    while falls:  # determinants only fall, each time by CONVERGED somewhere: it ends
        step = _concentrated(_with_distance(rows, best, ["grp"], few), ["grp"], few)
        old = best.select("grp", F.struct(*state).alias("old"))
        both = step.select("grp", F.struct(*state).alias("new")).join(old, "grp")
        better = F.col("new.log_det") < F.col("old.log_det") - CONVERGED
        both = materialise(both.select("grp", F.when(better, F.col("new")).otherwise(F.col("old")).alias("x"), better.alias("better")), "mcd")
        best, falls = both.select("grp", "x.*"), not both.filter("better").isEmpty()
    return best


def quality_verdicts(docs: DataFrame, few_groups: int = FEW_GROUPS) -> DataFrame:
    """doc_id, lang, source, row_key, the counts, d2 (squared distance), base_failed and kept.

    One row for each row of ``docs``. Null text counts as empty and so fails the base
    rules; null languages and sources form groups of their own; repeated rows count each
    and get the same verdict; ties at the edge of the half are all taken in. An empty
    table gives an empty table. Where fewer than MIN_ROWS rows of the whole table pass the
    base rules there is no estimate, d2 is null and these rules decide alone. Extra columns
    are left behind."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    stats = materialise(statistics(docs).withColumn("salt", salt), "statistics")
    v, few, widen = _grouped(vectors(stats), few_groups)
    v = materialise(v, "quality")
    rows = v.filter(~F.col("base_failed")).select("grp", "salt", *X)
    if widen:
        rows = rows.unionByName(rows.filter(F.col("grp") != REST).withColumn("grp", F.lit(REST)))
    fit = estimates(rows, few)
    n = F.col("n_fit") / H_SHARE
    fit = materialise(_factored(fit.select("grp", *FIT).filter(n >= MIN_ROWS - 1), F.lit(CONSISTENCY) * (1 + SMALL / n)), "estimates")
    out = _with_distance(v, fit, ["grp"], few)
    return out.select(
        "doc_id",
        "lang",
        "source",
        "row_key",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "d2",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)).alias("kept"),
    )


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    The verdicts, not the texts, are joined back, and of those only the rejections."""
    (key,) = free(docs, "key__")
    bad = materialise(quality_verdicts(docs).filter(~F.col("kept")).select(F.col("row_key").alias(key)).distinct(), "rejected")
    if bad.count() <= FEW_REJECTED:
        bad = F.broadcast(bad)
    here = docs.withColumn(key, row_key())
    return here.join(bad, key, "left_anti").select(*[here[c] for c in docs.columns])
