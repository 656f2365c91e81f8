"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, connected components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import components, discard, saved, settled, table

#: Samples a band and bands. A pair of similarity 0.75 shares no band with probability (1 - 0.75**5)**43 < 1e-5.
ROWS, BANDS = 5, 43
#: Bits of an odd sketch over all ROWS * BANDS samples.
BITS = 1024
#: The sketch's estimate may be this far under the threshold: five standard deviations of 215 samples at 0.75.
SLACK = 0.15
#: Keys of bands that a task sorts, about.
TOGETHER = 500_000

_RNG = np.random.Generator(np.random.PCG64(11))
_A = _RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)
_PLACE = words.mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minhash(shingle_set: np.ndarray) -> np.ndarray:
    """ROWS * BANDS minima; the set goes through in pieces that fit the processor's cache."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    out = np.full(ROWS * BANDS, 2**32 - 1, np.uint32)
    piece = np.empty((min(len(x), 256), ROWS * BANDS), np.uint32)
    for i in range(0, len(x), 256):
        part = piece[: len(x) - i]
        np.multiply(x[i : i + 256, None], _A, out=part)
        np.add(part, _B, out=part)
        np.minimum(out, np.minimum.reduce(part, axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys of each row of signatures; the band's number is part of the key."""
    rows = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = words.mix(key * np.uint64(0x2545F4914F6CDD1D) + rows[:, :, r])
    return key.view(np.int64)


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """Each sample flips one of BITS bits; the bits left set, as BITS / 64 long integers."""
    spot = (words.mix(sig.astype(np.uint64) ^ _PLACE) % np.uint64(BITS)).astype(np.int64)
    spot += np.arange(len(sig))[:, None] * BITS
    flips = np.bincount(spot.ravel(), minlength=len(sig) * BITS).reshape(len(sig), BITS) & 1
    return np.packbits(flips.astype(np.uint8), axis=1).view(np.int64)


def most_differing_bits(similarity: float) -> int:
    """Population count of the XOR of two odd sketches that stands for the similarity: J = 1 + n/(4k) ln(1 - 2p/n)."""
    return int(BITS / 2 * (1 - np.exp((similarity - 1) * 4 * ROWS * BANDS / BITS)))


def _sketches(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(it):
        for batch in it:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in words.batches(texts):
                sets = words.shingles(*words.hash_words(words.encode(texts[a:b])), width)
                digests = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
                sig = np.array([minhash(s) for s in sets])
                keys, sketch = band_keys(sig), odd_sketch(sig)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (keys, sketch)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(s) for s in sets], pa.int64()), *lists], schema=schema)

    return run


def _confirm(width: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it):
        for batch in it:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.zeros(len(left), bool)
            for i, j in words.batches([(x or "") + (y or "") for x, y in zip(left, right)]):
                x = words.shingles(*words.hash_words(words.encode(left[i:j])), width)
                y = words.shingles(*words.hash_words(words.encode(right[i:j])), width)
                for k, (p, q) in enumerate(zip(x, y), i):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep[k] = both > 0 and 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep))

    return run


def _buckets(it):
    """Rows (key, doc_id) of a range of both to the members of the buckets: rows of keys that have more than one row here.

    A member comes with the first document of its key in this partition. The first and the last key of the partition
    may go on in others: their first documents come once more, as edges.
    """
    import pyarrow.compute as pc

    def rows(key, doc, lo, edge):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, doc, lo)] + [pa.array(np.full(len(key), edge))], names=["key", "doc_id", "lo", "edge"])

    batches = [[pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in batch.columns] for batch in it if batch.num_rows]
    if not batches:
        return
    key, doc = (np.concatenate(x) for x in zip(*batches))
    batches.clear()
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    starts = np.append(True, key[1:] != key[:-1])
    member = np.flatnonzero(~starts | np.append(~starts[1:], False))
    doc[member] = doc[member][np.lexsort((doc[member], key[member]))]  # most keys have one row, the others are sorted by document too
    lo = doc[np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))]
    yield rows(key[member], doc[member], lo[member], False)
    ends = list(dict.fromkeys([(int(key[0]), int(doc[0])), (int(key[-1]), int(lo[-1]))]))
    yield rows([k for k, _ in ends], [d for _, d in ends], [d for _, d in ends], True)


def _members(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id) of all buckets of several documents, and a pair (a, b) for each document b that is not the first.

    a is the first document with which b shares the most buckets, the smallest of several. Rows are dealt by ranges of
    key and document, so that a bucket of any size is spread over tasks; the first documents of its parts are paired.
    """
    tasks = 1 + reps.count() * BANDS // TOGETHER
    keys = reps.select(F.explode("bands").alias("key"), "doc_id").repartitionByRange(tasks, "key", "doc_id")
    found = saved(keys.mapInArrow(_buckets, "key long, doc_id long, lo long, edge boolean"), "buckets")
    edges = found.where("edge").select("key", "doc_id").distinct()
    cut = edges.groupBy("key").agg(F.min("doc_id").alias("lo"), F.count("*").alias("n")).where("n > 1").select("key", "lo")
    parts = saved(edges.join(cut, "key"), "parts")  # buckets that go over several tasks: a row for each
    inside = found.where("not edge")
    shared = inside.where("lo < doc_id").groupBy("doc_id", "lo").count()
    best = shared.groupBy("doc_id").agg(F.max_by("lo", F.struct("count", -F.col("lo"))).alias("a")).select("a", F.col("doc_id").alias("b"))
    pairs = best.unionByName(parts.where("lo < doc_id").select(F.col("lo").alias("a"), F.col("doc_id").alias("b"))).distinct()
    return inside.select("key", "doc_id").unionByName(parts.select("key", "doc_id")).distinct(), pairs


def _sketched(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sizes and the sketches allow."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    differing = sum(F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(BITS // 64))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return pairs.where(differing <= most_differing_bits(percent / 100 - SLACK)).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that the full sets of both texts confirm."""
    text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.select("a", "b").hint("shuffle_hash").join(text("a"), "a").hint("merge").join(text("b"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_confirm(width, percent), "a long, b long")


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, doc_id, c, lo, c_lo) of the buckets that hold several components c; lo is the bucket's first document."""
    placed = members.join(found, F.col("id") == F.col("doc_id"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    placed = saved(placed, "placed")
    several = placed.groupBy("key").agg(F.min("doc_id").alias("lo"), F.min_by("c", "doc_id").alias("c_lo"), F.min("c").alias("least"), F.max("c").alias("most"))
    out = saved(placed.join(several.where("least < most").select("key", "lo", "c_lo"), "key"), "mixed")
    discard(placed)
    return out


def _first_of_each(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's first document and the first of each other component in it."""
    first = mixed.where("c <> c_lo").groupBy("key", "c").agg(F.min("doc_id").alias("b"), F.min("lo").alias("a"))
    return first.select("a", "b").distinct()


def _sets(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("full", pa.list_(pa.int64()))])

    def run(it):
        for batch in it:
            texts = batch.column(1).to_pylist()
            for a, b in words.batches(texts):
                sets = words.shingles(*words.hash_words(words.encode(texts[a:b])), width)
                ends = pa.array(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], schema=schema)

    return run


def _across(mixed: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between different components c of one bucket; sizes, sketches and full sets are part of the join.

    Only confirmed links leave the join, however many texts of a bucket are nearly alike, and a pair is tried in the
    first of its common buckets alone.
    """
    ids = mixed.select("doc_id").distinct()
    sets = texts.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, full array<long>")
    full = saved(reps.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").join(sets.hint("merge"), "doc_id"), "sets")
    rows = mixed.hint("merge").join(full.select("doc_id", "n", "sketch", "bands", "full"), "doc_id")
    a, b = (rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "c", "n", "sketch", "bands", "full"))) for x in "ab")
    differing = " + ".join(f"bit_count(sketch_a[{i}] ^ sketch_b[{i}])" for i in range(BITS // 64))
    tests = (
        "doc_id_a < doc_id_b AND c_a <> c_b",
        f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)",
        f"{differing} <= {most_differing_bits(percent / 100 - SLACK)}",
        "a.key = array_min(array_intersect(bands_a, bands_b))",
        f"(100 + {percent}) * size(array_intersect(full_a, full_b)) >= {percent} * (n_a + n_b)",
    )
    found = a.alias("a").join(b.alias("b"), F.expr(" AND ".join(f"({t})" for t in ("a.key = b.key", *tests))))
    return found.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of `width`-word shingles.
    1. Texts with equal sets become one representative, the smallest id.
    2. MinHash bands bucket the representatives. Each document is paired with the first document of its buckets that it
       meets most often; odd sketches rule pairs out, full sets confirm them, and confirmed links give components. Then
       the first documents of the components that share a bucket are paired in the same way.
    3. In buckets that still hold several components, the pairs across components are tried too. So no link between
       texts that share a band is lost, and a large group of copies never unfolds into all its pairs.

    Null or wordless text: n_shingles 0, its own component. Null id: component null, kept. Rows that repeat an id
    are each returned. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settled(docs.sparkSession, lambda: _near_duplicates(docs, width, percent), "components")


def _near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Ids and pairs grow with the documents, so texts meet them by shuffles at every size, never by broadcast."""
    raw = saved(docs.mapInArrow(_sketches(width), "doc_id long, d1 long, d2 long, n long, bands array<long>, sketch array<long>"), "sketches")
    same = raw.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1")
    same = saved(same.select("d1", "d2", "rep"), "same")
    rows = raw.join(same, ["d1", "d2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")))
    of_rep = lambda c: F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c)
    rows = saved(rows.select("doc_id", "n", "rep", of_rep("bands"), of_rep("sketch")), "rows")
    discard(raw, same)
    reps = rows.where("doc_id = rep")

    members, pairs = _members(reps)
    members = saved(members, "members")
    paired = members.select("doc_id").distinct()
    texts = saved(docs.join(paired.hint("shuffle_hash"), "doc_id", "left_semi"), "texts")  # whole texts are shuffled this once
    links = saved(_confirmed(_sketched(pairs, reps, percent), texts, width, percent), "links")
    found = components(links)
    first = lambda m: _confirmed(_sketched(_first_of_each(m), reps, percent), texts, width, percent)
    for step in (first, lambda m: _across(m, reps, texts, width, percent)):
        mixed = _mixed(members, found)
        more = saved(step(mixed), "links")
        discard(mixed)
        if more.limit(1).count():
            links = saved(links.unionByName(more), "links")
            found = components(links)

    whole = found.select(F.col("id").alias("rep"), "component")
    out = rows.join(whole, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS ss
  FROM w
),
n AS (SELECT doc_id, len(ss) AS n FROM s),
x AS (SELECT doc_id, unnest(ss) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON c.id = n.doc_id
"""
