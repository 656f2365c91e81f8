"""Shared tables, labels and connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders in the shared one that nobody has removed.
_LEFT: dict[str, SparkSession] = {}
#: Edges that one task joins to components; more go through rounds of steps by all tasks.
AT_ONCE = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, as in tests, one is made for a session without executors of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = "file://" + tempfile.mkdtemp(prefix="chunkflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, until remove() or the end of the driver."""
    path = f"{shared_folder(spark)}/chunkflow-{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


#: Spark removes an action's shuffle files when it ends, not when the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them from there: cuts lineage and survives lost executors.

    The shuffle files of the write go with it. The folder stays until discard() or the end of the driver.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*saved_rows: DataFrame) -> None:
    """Removes what saved() wrote for these frames; nothing may read them any more."""
    for df in saved_rows:
        remove(df.sparkSession, df.saved_at)


def settled(spark: SparkSession, make, name: str) -> DataFrame:
    """saved() of what make() returns; whatever else make() has left in the shared folder goes."""
    before = set(_LEFT)
    out = saved(make(), name)
    for path in set(_LEFT) - before - {out.saved_at}:
        remove(spark, path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    _LEFT.pop(path, None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_left() -> None:
    """At the driver's end, if its session still runs."""
    for path, spark in list(_LEFT.items()):
        if spark.sparkContext._jsc is not None and spark.sparkContext._gateway is not None:
            try:
                remove(spark, path)
            except Exception:  # the JVM is gone
                return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, rows: int) -> DataFrame:
    """At most `rows` labelled documents (doc_id, text, label) outside the held-out fold.

    The bound is the documented parameter of the classifiers that learn on the driver. The rows are the smallest by a
    keyed hash of the id, so that the choice does not depend on partitioning. A document with several labels has the
    largest; of rows that repeat an id the one with the least hash of its text counts.
    """
    y = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(remainder("doc_id", mod) != held)
    ids = d.select("doc_id").join(y, "doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    one = d.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r"))
    return one.select("doc_id", "r.text", F.col("r.label").cast("int").alias("label"))


def _joined(it):
    """All edges (u, v) to rows (id, component): roots take the smallest root next to them until no edge joins two."""
    ends = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in it if batch.num_rows]
    if not ends:
        return
    u, v = (np.concatenate(x) for x in zip(*ends))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b): the smallest id that it reaches. Edges are read several times.

    Up to AT_ONCE edges are joined in one task. More alternate large-star and small-star steps until nothing changes or
    so few are left. Each step takes minima of neighbours with partial aggregation and joins them back, so a node with
    very many edges is never gathered in one task. Nothing but a count and a checksum comes to the driver.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if e.count() > AT_ONCE:
        e = saved(e.distinct(), "edges")
        before = None
        while True:  # each round reads the one before only
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
            if now == before:
                roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
                return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
            if now[0] <= AT_ONCE:
                break
            before = now
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large, old = saved(large, "large"), e
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            e = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
            discard(large, old)
    return saved(e.repartition(1).mapInArrow(_joined, "id long, component long"), "joined")
