"""Each stage of the pipeline against a plain version, on one fixture."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_text_operators import brute_groups, corpus

from chunkflow.llm import packing


def fixture(spark, tmp_path):
    rng = random.Random(11)
    docs = [(i, t, "en", f"s{i % 3}" if i else None, len(t)) for i, t in corpus(rng) if i is not None and t]
    docs += [(2000 + i, " ".join(f"q{rng.randrange(99)}###" for _ in range(60)), "en", "s1", 9) for i in range(60)]
    docs += [(3000, "write to bob@mail.example.com now please", "en", "s0", 40), (None, "no id at all here", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d[0], 0 if d[0] and 2000 <= d[0] < 3000 else 1) for d in docs if d[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = fixture(spark, tmp_path)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, d, str(tmp_path))
        if name != "packing":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after.write.parquet(f"{tmp_path}/{len(seen)}")
        d = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = d.collect()
    good = {r.doc_id for r in seen["quality classifier"]}
    want = {x[0] for x in docs if not (x[0] and 2000 <= x[0] < 3000)}
    assert len(good ^ want) <= 5 and {3000, None} <= good
    rows = [(r.doc_id, r.text) for r in seen["quality classifier"]]
    groups = brute_groups(rows)
    assert sorted(r.doc_id for r in seen["near-duplicates"] if r.doc_id is not None) == sorted({i for i, g in groups.items() if i == g})
    kept = {r.doc_id for r in seen["near-duplicates"]}
    assert None in kept
    texts = {r.doc_id: r.text for r in seen["PII"]}
    assert "bob@mail" not in texts[3000] and texts[3000].startswith("write to ") and len(texts) == len(kept)
    assert all(texts[r.doc_id] == r.text for r in seen["near-duplicates"] if r.doc_id != 3000)
    assert {r.doc_id: r.text for r in seen["mixing"]} == texts
    assert {r.doc_id for r in seen["packing"]} == kept
    bins = {}
    for r in seen["packing"]:
        bins.setdefault(r.bin, []).append(r)
    source = {x[0]: x[3] for x in docs}
    for rows in bins.values():
        assert sum(r.n_tokens for r in rows) <= 2048
        named = [source[r.doc_id] for r in rows if source[r.doc_id] is not None]
        assert len(named) == len(set(named))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_packing_follows_the_mix(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 400)
    monkeypatch.setattr(packing, "SLOTS", 20)
    rows = [(i, " ".join(f"t{i}x{k}" for k in range(40 + i % 50)), "en", f"src{i % 8}", 9) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {}
    for name, weights in (("few", {"src0": 1}), ("many", {"src0": 9})):
        monkeypatch.setattr(corpus_pipeline, "TARGETS", weights)
        bins = corpus_pipeline.packing_stage(spark, docs, "").collect()
        slot = {r.doc_id: r.mix_slot for r in corpus_pipeline.mix(docs, weights, "doc_id").collect()}
        assert {r.doc_id for r in bins} == set(slot)
        groups = {}
        for r in bins:
            groups.setdefault(r.bin >> 32, {}).setdefault(r.bin, []).append(slot[r.doc_id])
        assert len(groups) > 2
        ends = [(min(map(min, g.values())), max(map(max, g.values()))) for _, g in sorted(groups.items())]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
        assert all([min(s) for _, s in sorted(g.items())] == sorted(min(s) for s in g.values()) for g in groups.values())
        found[name] = sum(r.doc_id % 8 == 0 for r in bins if r.bin >> 32 == min(groups)), {(r.doc_id, r.piece, r.bin) for r in bins}
    assert found["many"][0] >= 2 * found["few"][0] > 0 and found["many"][1] != found["few"][1]
