"""Near-duplicate embeddings by product quantisation: coarse lists, residual codes, table distances, exact rerank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, table
from .vectors import k_means, nearest, squared, usable

#: Rows that the coarse centres and the codebooks are fitted on, at most. Every row is indexed.
SAMPLE = 20_000
#: Subspaces of a residual code and codewords of each.
SUBSPACES, CODEWORDS = 8, 64
MOST_CELLS = 1024
#: Rows of an inverted list in one task, and rows that ask them.
BLOCK, ASKING = 2_000, 20_000


class Codes:
    """Coarse centres and residual codebooks over unit vectors, padded with zeros to one length."""

    def __init__(self, sample: np.ndarray, n: int):
        self.width = -(-sample.shape[1] // SUBSPACES)
        sample = self.padded(sample)
        self.coarse = k_means(sample, max(1, min(MOST_CELLS, int(n**0.5))), 8, 1)
        rest = sample - self.coarse[nearest(sample, self.coarse)[0]]
        self.books = [k_means(rest[:, s], CODEWORDS, 8, 2) for s in self.slices()]

    def slices(self):
        return [slice(i * self.width, (i + 1) * self.width) for i in range(SUBSPACES)]

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width * SUBSPACES - x.shape[1])))

    def encode(self, x: np.ndarray):
        """Cell, code and length of what the code leaves out, of each row."""
        cell, _ = nearest(x, self.coarse)
        rest = x - self.coarse[cell]
        code = np.stack([nearest(rest[:, s], b)[0] for s, b in zip(self.slices(), self.books)], 1)
        back = np.concatenate([b[code[:, i]] for i, b in enumerate(self.books)], 1)
        return cell, code.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, cell: np.ndarray, radius: float) -> list[np.ndarray]:
        """Every cell, from the row's own up, that can hold a row within the radius: the bisector is no farther."""
        gap = np.sqrt(squared(self.coarse, self.coarse))
        out = []
        for i in range(0, len(x), 1024):
            d = squared(x[i : i + 1024], self.coarse)
            own = cell[i : i + 1024]
            reach = d - d[np.arange(len(d)), own][:, None] <= 2 * radius * gap[own] + 1e-9
            out += [np.union1d(np.flatnonzero(r[c:]) + c, [c]) for r, c in zip(reach, own)]
        return out

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of each query's residual to all codewords: queries x subspaces x codewords."""
        rest = q - self.coarse[cell]
        out = np.full((len(q), SUBSPACES, CODEWORDS), np.inf)
        for i, (s, b) in enumerate(zip(self.slices(), self.books)):
            out[:, i, : len(b)] = squared(rest[:, s], b)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _packed(v) -> bytes:
    """The components as 4 bytes each where that loses nothing, else as 8."""
    x = np.asarray(v, "<f8")
    small = x.astype("<f4")
    return small.tobytes() if np.array_equal(small, x) else x.tobytes()


def _unpacked(raws, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8") for r in raws]).astype(np.float64) if len(raws) else np.zeros((0, dim))


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are linked if their labels and lengths are equal, the label is not null and their cosine is at least the
    threshold. Equal vectors become one representative with a count. Each representative is stored in the inverted list
    of its nearest coarse centre as a residual code, and asks every list that can hold a vector within reach. Table
    distances that exceed the reach by more than the code's own error rule a vector out; the cosine of the original
    vectors decides on the rest, so nothing over the threshold is lost. Lists are dealt out in blocks and so are those
    that ask them, and a block returns counts of links and a spanning forest, made while it compares, not pairs.

    Vectors null, zero or with null or non-finite components and null labels: no links, own component. Null ids: null
    component, kept. Rows that repeat an id each count. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64("embedding", "label", F.lit(1)))
    good = usable(rows).where("label is not null and vec_id is not null")
    reps = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    reps = saved(reps, "reps")
    data = good.join(reps, ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["h1", "h2"]).select("rep", "m", F.concat_ws(":", "dim", "label").alias("g"), "vec")
    data = saved(data, "vectors")
    n = data.count()
    width = data.agg(F.max(F.size("vec"))).first()[0] or 0
    sample = data.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toPandas()["vec"] if n else []
    if n:
        fit = np.zeros((len(sample), width))
        for i, x in enumerate(sample):
            fit[i, : len(x)] = x
        model = spark.sparkContext.broadcast(Codes(_unit(fit), n))
        found = saved(_search(data, model, width, threshold), "found")
    else:
        found = spark.createDataFrame([], "a long, b long, n long")
    same = reps.select(F.col("rep").alias("a"), (F.col("m") - 1).alias("n"))
    counts = found.where("b is null").select("a", "n").unionByName(same).groupBy("a").agg(F.sum("n").alias("n_links"))
    joined = components(found.where("b is not null"))
    known = reps.join(counts.withColumnRenamed("a", "rep"), "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("h1", "h2", "n_links", F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    out = out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long"))).otherwise(0).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _search(data: DataFrame, model, width: int, threshold: float) -> DataFrame:
    radius = float(np.sqrt(max(0, 2 - 2 * threshold))) + 1e-7

    def place(it):
        for f in it:
            if not len(f):
                continue
            x = np.zeros((len(f), width))
            for i, v in enumerate(f["vec"]):
                x[i, : len(v)] = v
            x = model.value.padded(_unit(x))
            cell, code, left_out = model.value.encode(x)
            yield pd.DataFrame({"rep": f["rep"], "m": f["m"], "g": f["g"], "vec": [_packed(v) for v in f["vec"]], "cell": cell, "code": [c.tobytes() for c in code], "err": left_out, "probes": [p.astype(np.int64) for p in model.value.probes(x, cell, radius)]})

    placed = saved(data.mapInPandas(place, "rep long, m long, g string, vec binary, cell long, code binary, err double, probes array<long>"), "placed")
    asking = placed.select("g", F.explode("probes").alias("cell")).groupBy("g", "cell").agg(F.ceil(F.count("*") / ASKING).alias("parts"))
    blocks = placed.groupBy("g", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(asking, ["g", "cell"])
    blocks = saved(blocks, "lists")
    dealt = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).alias("x")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    base = placed.select("g", "cell", "rep", "m", "vec", "code", "err", F.col("cell").alias("own")).join(blocks, ["g", "cell"])
    base = base.withColumn("block", dealt(F.col("blocks"), 1)).withColumn("part", every("parts")).withColumn("stored", F.lit(True))
    ask = placed.select("g", F.explode("probes").alias("cell"), "rep", "m", "vec", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("err"), F.col("cell").alias("own")).join(blocks, ["g", "cell"])
    ask = ask.withColumn("part", dealt(F.col("parts"), 2)).withColumn("block", every("blocks")).withColumn("stored", F.lit(False))

    def compare(key, f):
        cell, dim = int(key[1]), int(key[0].split(":", 1)[0])
        s, q = f[f["stored"]].sort_values("rep"), f[~f["stored"]].sort_values("rep")
        if not len(s) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("Int64")
        codes = np.frombuffer(b"".join(s["code"]), np.uint8).reshape(len(s), SUBSPACES)
        a, b = _unit(_unpacked(q["vec"].tolist(), dim)), _unit(_unpacked(s["vec"].tolist(), dim))
        ids, others, times_a, times_b = (x.to_numpy() for x in (q["rep"], s["rep"], q["m"], s["m"]))
        reach = (radius + s["err"].to_numpy() + 1e-9) ** 2
        twice = (q["own"].to_numpy() == cell)[:, None]  # pairs of one list meet both ways
        gained_a, gained_b = np.zeros(len(q), np.int64), np.zeros(len(s), np.int64)
        tree, first = np.arange(len(s)), np.full(len(q), -1)  # stored rows that are connected; a stored row of each that asks
        for i in range(0, len(q), 64):
            tables = model.value.tables(model.value.padded(np.pad(a[i : i + 64], ((0, 0), (0, width - a.shape[1])))), cell)
            far = sum(tables[:, j][:, codes[:, j]] for j in range(SUBSPACES))
            linked = (far <= reach) & ~(twice[i : i + 64] & (ids[i : i + 64, None] >= others))
            x, y = np.nonzero(linked)
            linked[x, y] = (a[i + x] * b[y]).sum(1) >= threshold
            gained_a[i : i + 64] = linked @ times_b
            gained_b += times_a[i : i + 64] @ linked
            for r in np.flatnonzero(linked.any(1)).tolist():
                mine = np.flatnonzero(linked[r])
                roots = np.unique(tree[mine])
                if len(roots) > 1:
                    tree[np.isin(tree, roots)] = roots[0]
                first[i + r] = mine[0]
        asked, inner = np.flatnonzero(first >= 0), np.flatnonzero(tree != np.arange(len(s)))
        counts = pd.DataFrame({"a": np.concatenate([ids, others]), "b": pd.NA, "n": np.concatenate([gained_a, gained_b])})
        edges = pd.DataFrame({"a": np.concatenate([ids[asked], others[inner]]), "b": np.concatenate([others[tree[first[asked]]], others[tree[inner]]]), "n": pd.NA})
        return pd.concat([counts[counts["n"] > 0], edges[edges["a"] != edges["b"]]]).astype("Int64")[["a", "b", "n"]]

    columns = ["g", "cell", "block", "part", "stored", "rep", "m", "vec", "code", "err", "own"]
    return base.select(columns).unionByName(ask.select(columns)).groupBy("g", "cell", "block", "part").applyInPandas(compare, "a long, b long, n long")


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
