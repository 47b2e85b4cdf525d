"""Exact top-k search (operator 3): columnar branch-and-bound over blocks.

Vectors become integers (floor of SCALE times each component). A block of candidates is
laid out dimension by dimension, the dimensions with most mass first, its candidates by
falling norm; the mass that each candidate still has after every block of dimensions is
summed up once. Partial inner products grow one block of dimensions at a time. What the
remaining dimensions can still add is at most the product of the remaining norms of query
and candidate (Cauchy-Schwarz). Candidates that can't reach the query's threshold any more
are dropped and the survivors compacted, so later dimensions are read for few of them.

A query's threshold is known before its first block: its k-th best score among a sample of
about SAMPLE candidates, searched first. Candidates whose whole norm can't reach it are
never touched. A block raises the threshold by what its own candidates reach for certain.

Scale: rows get a number of their own; candidates are dealt into blocks of bounded size by
a hash of it, however often a vector repeats, queries likewise, and each pair of blocks is
one bounded task; nothing is broadcast or collected. Each pair of blocks returns at most k
rows a query; ranks come from a window whose limit Spark applies before the shuffle too.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, only

SCALE = 1024
DIM_BLOCK = 16
CANDIDATES = 8192  # a block of candidates; and of queries:
QUERIES = 2048
SAMPLE = 4096  # candidates about that are searched first
TOGETHER = 64  # queries whose first dimensions are multiplied at once
# Small inputs get more, smaller blocks, so that all cores have work.
LEAST_BLOCKS = 24
LEAST_ROWS = 256
LONG = (-(1 << 63), (1 << 63) - 1)
ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.rid <> q.rid AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
RESULT = "query long, query_id long, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """rid (a number of the row), vec_id, dim and v (long components) of vectors that take
    part, written: numbers must not change where a task runs again."""
    thin = only(vectors, vec_id="vec_id", e="embedding")

    def bad(x: Column) -> Column:
        y = x.cast("double")
        return y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))

    found = (
        thin.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", bad))
        .select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * F.lit(float(SCALE)))).alias("v"))
        .select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.size("v").alias("dim"), "v")
    )
    return materialise(found, "vectors")


class Block:
    """Candidates of one length, in vertical layout.

    ``c`` has a row for each dimension, those with most mass first, and a column for each
    candidate, by falling norm; ``rest[j]`` is the mass of every candidate after the first
    j blocks of dimensions, a little over rather than under."""

    def __init__(self, vectors, rids, ids):
        import numpy as np

        mass = np.square(vectors.astype(np.float64))
        self.order = np.argsort(-mass.sum(axis=0), kind="stable")
        rows = np.argsort(-mass.sum(axis=1), kind="stable")
        self.c = np.ascontiguousarray(vectors[rows][:, self.order].T)
        self.rids, self.ids = rids[rows], ids[rows]
        self.cuts = list(range(0, vectors.shape[1], DIM_BLOCK)) or [0]
        mass = mass[rows][:, self.order]
        parts = [mass[:, a : a + DIM_BLOCK].sum(axis=1) for a in self.cuts]
        self.rest = np.zeros((len(parts) + 1, len(rows)))
        for j in range(len(parts) - 1, -1, -1):
            self.rest[j] = self.rest[j + 1] + parts[j]
        self.read = 0  # components that searches have read

    def search(self, queries, own, floors, k: int) -> list[list[int]]:
        """For each query, columns of the candidates that may be among its k best, with
        their scores: all that are, and few others."""
        import numpy as np

        queries = queries[:, self.order]
        mass = np.square(queries.astype(np.float64))
        parts = np.stack([mass[:, a : a + DIM_BLOCK].sum(axis=1) for a in self.cuts], axis=1)
        rest = np.append(np.cumsum(parts[:, ::-1], axis=1)[:, ::-1], np.zeros((len(queries), 1)), axis=1)
        norms, out = np.sqrt(self.rest[0]), []
        for at in range(0, len(queries), TOGETHER):
            some = queries[at : at + TOGETHER]
            # Norms fall, so what can reach a threshold at all is a prefix.
            reach = [self._reach(norms, float(np.sqrt(rest[i, 0])), floors[i]) for i in range(at, at + len(some))]
            width = max(reach, default=0)
            first = some[:, :DIM_BLOCK] @ self.c[:DIM_BLOCK, :width]
            self.read += min(DIM_BLOCK, len(self.order)) * sum(reach)
            for i, n in enumerate(reach):
                out.append(self._one(some[i], rest[at + i], first[i, :n], own[at + i], floors[at + i], k))
        return out

    @staticmethod
    def _reach(norms, norm: float, floor: float) -> int:
        import numpy as np

        if floor <= 0:
            return len(norms)
        least = floor * (1 - 1e-9) - 1e-3
        return int(np.searchsorted(-(norms * norm), -least, side="right"))

    def _one(self, q, rest, score, own: int, floor: float, k: int):
        import numpy as np

        alive = np.flatnonzero(self.rids[: len(score)] != own)
        score = score[alive]
        for j in range(1, len(self.cuts) + 1):
            if len(alive) > k and j < len(self.cuts):
                can = np.sqrt(self.rest[j, alive] * rest[j]) * (1 + 1e-9) + 1e-3
                s = score.astype(np.float64)
                # k candidates reach this for certain
                floor = max(floor, float(np.partition(s - can, len(s) - k)[len(s) - k]))
                stay = s + can >= floor - abs(floor) * 1e-9
                if not stay.all():
                    alive, score = alive[stay], score[stay]
            if j == len(self.cuts) or not len(alive):
                break
            a, b = self.cuts[j], self.cuts[j] + DIM_BLOCK
            self.read += len(alive) * min(DIM_BLOCK, len(self.order) - a)
            score = score + q[a:b] @ self.c[a:b, alive]
        if self.c.dtype == object:
            best = sorted(range(len(alive)), key=lambda x: (-score[x], self.ids[alive[x]]))[:k]
        else:
            best = np.lexsort((self.ids[alive], -score))[:k]
        return [(int(self.ids[alive[x]]), int(score[x])) for x in best]


def _vectors(t: pa.Table, d: int):
    return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, d)


def search_block(k: int):
    """A function of a block of queries (with their thresholds) and one of candidates."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        import numpy as np

        out = []
        if not queries.num_rows or not candidates.num_rows:  # an empty side may lack its columns
            return pa.table({n.split()[0]: pa.array([], pa.int64()) for n in RESULT.split(", ")})
        dims = np.array(candidates.column("dim").to_pylist(), dtype=np.int64)
        asked = np.array(queries.column("dim").to_pylist(), dtype=np.int64)
        for d in np.intersect1d(dims, asked).tolist():
            mine, ask = candidates.take(pa.array(np.flatnonzero(dims == d))), queries.take(pa.array(np.flatnonzero(asked == d)))
            c, q = _vectors(mine, d), _vectors(ask, d)
            # Doubles are exact below 2**53; beyond, longs are, and Python's integers further on.
            top = float(max(abs(float(x)) for x in (c.min(initial=0), c.max(initial=0), 1))) * float(max(abs(float(x)) for x in (q.min(initial=0), q.max(initial=0), 1))) * max(d, 1)
            kind = np.float64 if top < 2**53 else np.int64 if top < 2**62 else object
            block = Block(c.astype(kind), mine.column("rid").to_numpy(), mine.column("vec_id").to_numpy())
            rids, ids = ask.column("rid").to_pylist(), ask.column("vec_id").to_pylist()
            floors = [float("-inf") if x is None else float(x) for x in ask.column("floor").to_pylist()]
            found = block.search(q.astype(kind), rids, floors, k)
            out += [(rid, qid, v, min(max(s, LONG[0]), LONG[1])) for rid, qid, got in zip(rids, ids, found) for v, s in got]
        cols = list(zip(*out)) or [()] * 4
        return pa.table({n.split()[0]: pa.array(x, pa.int64()) for n, x in zip(RESULT.split(", "), cols)})

    return run


def blocks(n: int, size: int) -> int:
    return max(1, -(-n // size), min(LEAST_BLOCKS, n // LEAST_ROWS))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k
    highest integer inner products among all other rows whose vectors have its length (all,
    if fewer), ties to smaller ids.

    Vectors that are null or hold null or non-finite components take no part, nor do rows
    without an id. Rows that repeat an id are candidates each and, where it is divisible,
    queries each. Empty vectors score 0 among themselves. Components beyond the range of a
    long are held at its ends, and so are scores. Extra columns are left behind. An empty
    table gives an empty table."""
    use = usable(vectors)
    asks = F.col("vec_id") % every == 0
    row = use.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asks, 1)).alias("q")).first()
    nc, nq = blocks(row["n"], CANDIDATES), max(1, -(-row["q"] // QUERIES))

    def place(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(n)).cast("int")

    def copies(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Columns of their own for queries: a cogroup can't tell equal attributes of its sides apart.
    own = use.select(*[F.col(c).alias(c) for c in use.columns])
    ask = own.filter(asks).withColumn("qb", place(nq, 1)).withColumn("floor", F.lit(None).cast("long"))
    few = use.filter(place(max(1, row["n"] // SAMPLE), 2) == 0).withColumn("qb", copies(nq))
    tried = ask.groupBy("qb").cogroup(few.groupBy("qb")).applyInArrow(search_block(k), RESULT)
    # The least of k scores found is one that k candidates reach.
    reached = tried.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k)
    reached = materialise(reached.select(F.col("query").alias("rid"), "floor"), "thresholds")
    ask = ask.drop("floor").join(reached, "rid", "left").withColumn("cb", copies(nc))
    right = use.withColumn("cb", place(nc, 3)).withColumn("qb", copies(nq))
    found = ask.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(search_block(k), RESULT)
    rank = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
