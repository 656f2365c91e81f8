"""Nearest neighbours by collision counting: sorted projections, query-centred windows, virtual rehashing.

A vector at distance R from the query lies in a window of WIDTH * R around it with probability p = 2 * Phi(WIDTH / 2) - 1,
whatever the projection. So at radius R, a vector within R collides in p * PROJECTIONS of them on average; the threshold
is MARGIN standard deviations below that, and vectors that reach it are verified. Projections are taken in orthogonal
sets, which makes counts deviate less than that.
"""

from __future__ import annotations

from math import ceil, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, saved, table
from .files import mapped, pack, unpack, write_bytes
from .vectors import matrix, usable

#: Projections, the window's width at radius 1, the radii's ratio, standard deviations from the mean to the threshold.
PROJECTIONS, WIDTH, RATIO, MARGIN = 128, 2.72, 1.05, 2.5
#: Rows of one index, queries that meet it in one task, and of these how many search at a time.
BLOCK, QUERIES, TOGETHER = 16_000, 4_000, 64
#: Radii whose windows are looked up at once.
STEPS = 24


def threshold() -> int:
    """Collisions from which a vector is verified."""
    p = erf(WIDTH / 2 / sqrt(2))
    return ceil(PROJECTIONS * p - MARGIN * sqrt(PROJECTIONS * p * (1 - p)))


def lines(width: int) -> np.ndarray:
    """Random directions, as columns, in sets of `width` orthogonal ones; each component has variance 1."""
    rng = np.random.default_rng(5)
    sets = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(ceil(PROJECTIONS / width))]
    return np.concatenate(sets, 1)[:, :PROJECTIONS] * sqrt(width)


class Index:
    """Sorted arrays of single projections of the rows of a block."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.scale = max(float(np.abs(x).max()), 1e-300)
        self.lines, self.verified = lines(x.shape[1]), 0
        self.scaled = x / self.scale
        p = self.scaled @ self.lines
        self.order = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(p.T), self.order, axis=1)
        spread = np.sqrt(((self.scaled - self.scaled.mean(0)) ** 2).sum(1).mean())
        self.first = max(spread / 16, 1e-12)
        self.squares = (self.scaled**2).sum(1)

    def nearest(self, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, rows and distances of the k nearest that its windows find, ties to smaller ids.

        At radius R the window of each projection reaches WIDTH * R / 2 to both sides of the query; a row in enough
        windows is verified. Windows grow until k verified rows lie within R, or until they hold every row. The edges
        of STEPS radii are looked up at once for all queries that are not done.
        """
        centre = (q / self.scale) @ self.lines
        asked = [_Query(self, x, i) for x, i in zip(q, own)]
        todo, radius = np.arange(len(q)), self.first
        while len(todo):
            radii = radius * RATIO ** np.arange(STEPS)
            wide = centre[todo, :, None] + np.concatenate([-radii[::-1], radii]) * WIDTH / 2
            edges = np.empty(wide.shape, np.int64)
            for j in range(PROJECTIONS):
                edges[:, j, :STEPS] = np.searchsorted(self.sorted[j], wide[:, j, :STEPS], "left")
                edges[:, j, STEPS:] = np.searchsorted(self.sorted[j], wide[:, j, STEPS:], "right")
            done = [asked[i].grow(e[:, STEPS - 1 :: -1], e[:, STEPS:], radii, k) for i, e in zip(todo, edges)]
            todo, radius = todo[~np.array(done, bool)], radius * RATIO**STEPS
        return [x.best(k) for x in asked]


class _Query:
    """How far one query's windows have grown, how often each row lies in them and which rows are verified."""

    def __init__(self, index: Index, q: np.ndarray, own: int):
        self.index, self.q = index, q
        self.hits, self.tried = np.zeros(len(index.x), np.int64), index.ids == own
        self.lo = self.hi = None
        self.rows, self.squares = np.zeros(0, np.int64), np.zeros(0)
        scaled = q / index.scale
        self.scaled, self.own_square = scaled, float(scaled @ scaled)

    def grow(self, lo: np.ndarray, hi: np.ndarray, radii: np.ndarray, k: int) -> bool:
        """Takes windows of growing radii (projections x radii) up to the one that ends the search, if there is one."""
        order, n, need = self.index.order, len(self.index.x), threshold()
        least = min(k, n - int(self.tried.sum()) + len(self.rows)) * need  # collisions that the rows wanted have together
        held = (hi - lo).sum(0)
        for t in range(len(radii)):
            if held[t] < least:  # too few collisions for an end at this radius: its rows count at the next
                continue
            a, b = lo[:, t], hi[:, t]
            if self.lo is None:
                new = [order[j, i:e] for j, (i, e) in enumerate(zip(a.tolist(), b.tolist()))]
            else:
                new = [order[j, i:e] for j, (i, e) in enumerate(zip(a.tolist(), self.lo.tolist()))]
                new += [order[j, i:e] for j, (i, e) in enumerate(zip(self.hi.tolist(), b.tolist()))]
            self.lo, self.hi = a, b
            self.hits += np.bincount(np.concatenate(new), minlength=n)
            more = np.flatnonzero((self.hits >= need) & ~self.tried)
            self.tried[more] = True
            self.index.verified += len(more)
            near = self.index.squares[more] + self.own_square - 2 * self.index.scaled[more] @ self.scaled
            self.rows, self.squares = np.concatenate([self.rows, more]), np.concatenate([self.squares, near])
            if (self.squares <= radii[t] ** 2).sum() >= k or self.tried.all():
                return True
        return False

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances by the dot product rule out rows by more than its rounding; exact ones order the rest."""
        slack = 64 * np.finfo(float).eps * len(self.q) * (self.index.squares[self.rows] + self.own_square)
        if len(self.rows) > k:
            close = self.squares - slack <= np.partition(self.squares + slack, k - 1)[k - 1]
            self.rows = self.rows[close]
        far = distances(self.index.x[self.rows], self.q)
        at = np.lexsort((self.index.ids[self.rows], far))[:k]
        return self.rows[at], far[at]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean, in doubles, summed in the order of the components."""
    if not len(x):
        return np.zeros(0)
    return np.sqrt(np.add.accumulate((x - q) ** 2, axis=1)[:, -1])


def nearest_neighbours(vectors: DataFrame, queries, k: int = 10) -> DataFrame:
    """The k nearest other vectors of each query, by Euclidean distance: query_id, rank (from 1), vec_id, score.

    queries: condition that says which rows are queries. All rows are dealt into blocks by a hash of the id, and queries
    into batches; each block and each batch is written once, and a task indexes a block and searches it for a batch; the
    blocks' best are merged. A query has fewer rows if there are fewer candidates; ties go to smaller ids. Vectors null,
    zero or with null or non-finite components, and null ids, take no part; vectors of different lengths do not meet.
    Rows that repeat an id are candidates once each, but not for a query of that id; a repeated query is asked with the
    vector that is least. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).where("vec_id is not null")
    v = saved(v.select("vec_id", "dim", "vec", F.coalesce(queries, F.lit(False)).alias("ask")), "vectors")
    n, asked = v.agg(F.count("*"), F.count_if("ask")).first()
    dealt = lambda rows, size, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(max(1, -(-rows // size)))).cast("int")
    folder = new_folder(spark, "blocks")
    blocks = _written(v, "block", dealt(n, BLOCK, 1), folder)
    asking = v.where("ask").groupBy("vec_id").agg(F.min_by(F.struct("dim", "vec"), F.struct("dim", "vec")).alias("v")).select("vec_id", "v.*")
    batches = _written(asking, "batch", dealt(asked, QUERIES, 3), folder)

    def search(it):
        for f in it:
            out = []
            for block, batch in zip(f["block"], f["batch"]):
                (ids, x), (own, q) = (_read(p) for p in (block, batch))
                index = Index(x, ids)
                for i in range(0, len(q), TOGETHER):
                    for o, (rows, far) in zip(own[i : i + TOGETHER], index.nearest(q[i : i + TOGETHER], own[i : i + TOGETHER], k)):
                        out += [(o, ids[r], d) for r, d in zip(rows, far)]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    tasks = blocks.join(batches, "dim").select("block", "batch")  # names of files: a row for each task
    found = tasks.repartition(max(1, tasks.count()), "block", "batch").mapInPandas(search, "query_id long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _written(v: DataFrame, name: str, part, folder: str) -> DataFrame:
    """Writes the vectors of each length and part to a file, by id: dim and the file's name."""

    def write(key, f):
        f = f.sort_values("vec_id")
        path = f"{folder}/{name}-{key[0]}-{key[1]}.bin"
        write_bytes(path, pack({"ids": f["vec_id"].to_numpy(np.int64), "x": matrix(f["vec"]).ravel()}))
        return pd.DataFrame({"dim": [key[0]], name: [path]})

    return saved(v.withColumn("part", part).groupBy("dim", "part").applyInPandas(write, f"dim int, {name} string"), name)


def _read(path: str) -> tuple[np.ndarray, np.ndarray]:
    got = unpack(mapped(path))
    return np.array(got["ids"]), np.array(got["x"]).reshape(len(got["ids"]), -1)


def op9_collision_counting_ann(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])), lambda x, y: x + y)) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY rank <= 10
"""
