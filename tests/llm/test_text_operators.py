import collections
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from chunkflow.llm import common, elias_fano, files, language_model, near_dup, token_files, words
from chunkflow.llm.common import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def shingle_set(t):
    w = split(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(rows):
    at = {i: i for i, _ in rows if i is not None}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((find(a), find(b)))
            at[q] = p
    return {i: find(i) for i in at}


def corpus(rng):
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.randint(1, 90))) for _ in range(25)]
    rows = []
    for i in range(160):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w).upper() if i % 9 == 0 else " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE  two"), (505, "ÉTÉ"), (506, "été"), (507, "long " * 30000), (508, "long " * 30001), (3, rows[3][1]), (None, rows[0][1]), (None, None)]
    return rows


def test_words_and_shingles_agree_with_plain_python():
    texts = ["A b\tC\x0bd é É", "", None, "x", " a  b ", "\x1ca b", "é" * 300 + " q", "a b c d e f a b c d e"]
    h, offsets = words.hash_words(words.encode(texts))
    seen = {}
    for i, t in enumerate(texts):
        got = h[offsets[i] : offsets[i + 1]]
        want = split(t)
        assert len(got) == len(want)
        for x, w in zip(got, want):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert [len(s) for s in words.shingles(h, offsets)] == [len(shingle_set(t)) for t in texts]


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus(random.Random(1))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n long, rep string")
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows)
    n = {i: len(shingle_set(t)) for i, t in rows}
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], n[r.doc_id], want[r.doc_id] == r.doc_id), r
    assert near_dup.near_duplicates(df.limit(0)).collect() == []


def test_links_across_components_in_one_bucket(spark):
    """A chain of texts of which only neighbours are alike: one component, though the ends share little."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[10 * i : 10 * i + 100])) for i in range(25)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_groups(rows)


def test_buckets_of_rows_in_any_order():
    rng = random.Random(9)
    rows = [(rng.randrange(-60, 60), i) for i in range(100)] + [(7, i) for i in range(200, 260)] + [(k, 999) for k in (-99, 99)]
    rng.shuffle(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 23])], names=["key", "doc_id"]) for i in range(0, len(rows), 23)]
    got = [tuple(r.values()) for b in near_dup._buckets(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
    of = collections.defaultdict(list)
    for k, d in rows:
        of[k].append(d)
    want = [(k, d, min(ds), False) for k, ds in of.items() if len(ds) > 1 for d in ds]
    assert sorted(got) == sorted([*want, (-99, 999, 999, True), (99, 999, 999, True)])
    assert list(near_dup._buckets(iter([]))) == []


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(2)
    for share in (0.75, 0.9):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        cut = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:cut], rng.integers(0, 2**63, 2000 - cut).astype(np.uint64)])
        s = near_dup.odd_sketch(np.array([near_dup.minhash(a), near_dup.minhash(b)]))
        differ = sum(int(x).bit_count() for x in (s[0] ^ s[1]).view(np.uint64))
        assert near_dup.most_differing_bits(share + 0.12) < differ < near_dup.most_differing_bits(share - near_dup.SLACK)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (20, 20), *((100, k) for k in range(101, 140)), (139, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7, 5: 5, **{k: 5 for k in range(100, 140)}}


@pytest.mark.parametrize(("at_once", "most"), [(common.AT_ONCE, 1), (80, 9), (0, 40)])
def test_few_edges_take_one_step_and_many_take_rounds(spark, monkeypatch, at_once, most):
    """The same components either way, and with rounds that end early; a chain took rounds of writes before."""
    rng, saves = random.Random(4), []
    monkeypatch.setattr(common, "AT_ONCE", at_once)
    monkeypatch.setattr(common, "saved", lambda df, name, f=common.saved: saves.append(name) or f(df, name))
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(60)]
    edges = list(zip(ids, ids[1:]))[:39] + [(rng.choice(ids[40:]), rng.choice(ids[40:])) for _ in range(60)] + [(2**63 - 1, k) for k in range(9)]
    at = {x: x for a, b in edges if a != b for x in (a, b)}
    for _ in at:
        for a, b in edges:
            if a != b:
                at[a] = at[b] = min(at[a], at[b])
    df = spark.createDataFrame([*edges, *edges[:5], (7, 7), (None, 1), (1, None)], "a long, b long").repartition(3)
    got = components(df).collect()
    assert len(got) == len(at)
    assert {r.id: r.component for r in got} == at
    assert len(saves) <= most, saves
    assert components(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_library(tokenizer):
    from tokenizers import Tokenizer

    rng, plain = random.Random(3), Tokenizer.from_file(tokenizer)
    texts = ["".join(rng.choice(" \n\t aB1.'é!  s<|endoftext|>\xa0") for _ in range(rng.randrange(30))) for _ in range(3000)] + [None, "", " ", "a<|endoftext|>b", "\0x", "x \0x"]
    got = token_files.Encoder(tokenizer).encode(texts)
    for t, x in zip(texts, got):
        assert x.tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)
    import public_tokenizers

    ranks = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for some in (texts, ["word " * 900, "x", None], []):
        assert ranks.count(some).tolist() == [len(x) for x in token_files.Encoder(tokenizer).encode(some)]
    assert [x.tolist() for x in ranks.encode(texts)] == [x.tolist() for x in got]


@pytest.mark.parametrize("bits", [False, True])
def test_plane_files_round_trip(bits):
    rng = np.random.default_rng(4)
    docs = [(None, rng.integers(0, 50257, 5)), (-4, rng.integers(0, 2**32, 200_000)), (7, np.zeros(0)), (7, rng.integers(0, 9, 65_536 - 5))]
    w = token_files.FileWriter(bits)
    for d, x in docs:
        w.add(d, x.astype(np.uint32))
    r = token_files.FileReader(w.close())
    got, at = list(r.documents()), 0
    for (d, x), (e, start, y) in zip(docs, got, strict=True):
        assert (d, at) == (e, start) and np.array_equal(x, y)
        at += len(x)
    assert np.array_equal(r.block(2), np.concatenate([x for _, x in docs])[2 * token_files.BLOCK : 3 * token_files.BLOCK])


def test_token_files(spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    rows = [(5, "hello world"), (2**60 + 1, None), (-1, ""), (5, "abc"), (None, "null id"), (9, "tail " * 50_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start long")
    got = token_files.read_token_files(f"file://{tmp_path}", token_files.write_token_files(df, f"file://{tmp_path}", tokenizer)).orderBy("start").collect()
    at = 0
    for (i, t), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    empty = token_files.write_token_files(df.limit(0), f"file://{tmp_path}/e", tokenizer)
    assert token_files.read_token_files(f"file://{tmp_path}/e", empty).collect() == []


def test_token_files_of_one_id(spark, tokenizer, tmp_path, monkeypatch):
    """Rows that all share an id, most of them equal, still go to several files, in order."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "DOCS_A_FILE", 40)
    plain = Tokenizer.from_file(tokenizer)
    texts = ["same text"] * 200 + [f"text {i:03d}" for i in range(100)]
    df = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").repartition(5)
    manifest = token_files.write_token_files(df, f"file://{tmp_path}", tokenizer)
    assert manifest.count() >= 6 and max(r.docs for r in manifest.collect()) < 150
    got, at = token_files.read_token_files(f"file://{tmp_path}", manifest).orderBy("start").collect(), 0
    for t, r in zip(sorted(texts), got, strict=True):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.ids_crc32) == (7, at, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_elias_fano():
    rng = np.random.default_rng(5)
    for n, u in ((0, 10), (1, 1), (1000, 50), (3000, 10**9), (500, 500), (5000, 2**63), (40, 2**63)):
        v = np.sort(rng.integers(0, u, n))
        if n == 3000:
            v[:2000] = v[0]  # a long run in one bucket, then far jumps
        s = elias_fano.Sequence(elias_fano.build(v, u, "x"), "x")
        if n:
            assert np.array_equal(s.access(np.arange(n)), v)
            assert np.array_equal(np.stack(s.pairs(np.arange(n - 1))), np.stack([v[:-1], v[1:]]))
            ask = np.concatenate([v, rng.integers(0, u, 100)])
            assert np.array_equal(s.rank(ask), np.searchsorted(v, ask, "right"))
        u_values = np.unique(v)
        s = elias_fano.Sequence(elias_fano.build(u_values, u, "x"), "x")
        ask = np.concatenate([u_values, rng.integers(-1, min(u + 2, 2**63 - 1), 200)])
        got = s.find(ask)
        assert [(-1 if a not in set(u_values.tolist()) else int(np.searchsorted(u_values, a))) for a in ask.tolist()] == got.tolist()


def test_trie_searches_between_two_pointers():
    v, w = np.array([0, 0, 0, 7, 9, 9]), np.array([2, 5, 6, 5, 0, 3])
    g = language_model.Grams.__new__(language_model.Grams)
    arrays = files.unpack(np.frombuffer(language_model.Grams.build(v, w, np.arange(1, 7), -np.arange(6.0), 8, 10), np.uint8))
    g.contexts, g.pointers = (elias_fano.Sequence(arrays, x) for x in ("contexts", "pointers"))
    g.children = elias_fano.Packed(arrays["children"], int(arrays["width"][0]))
    asked = sorted({(a, b) for a in range(10) for b in range(8)})
    got = g.look(np.array([a for a, _ in asked]), np.array([b for _, b in asked])).tolist()
    at = {p: i for i, p in enumerate(zip(v.tolist(), w.tolist()))}
    assert got == [at.get(p, -1) for p in asked]
    assert [x.tolist() for x in g.split(np.arange(6))] == [v.tolist(), w.tolist()]


def test_language_model_scores(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "Sat", "on", f"r{rng.randrange(30)}"]) for _ in range(rng.randrange(40)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "the cat " * 20_000), (None, "the cat"), (203, "the cat"), (203, "the cat")]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [split(t) + [None] for _, t in rows]
    train = [t for (i, _), t in zip(rows, toks) if i is not None and not held(i)]
    c = collections.Counter(w for t in train for w in t)
    bi = collections.Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 1) / (n + v + 1)
    mu = language_model.MU
    want = collections.Counter()
    for (i, _), t in zip(rows, toks):
        base = sum(math.log10(p(w)) for w in t)
        full = math.log10(p(t[0])) + sum(math.log10((bi[a, b] + mu * p(b)) / (c[a] + mu)) for a, b in zip(t, t[1:]))
        want[i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(base, 4), round(full / len(t), 2)] += 1
    got = language_model.language_model_scores(df).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score / r.n_tokens, 2)) for r in got) == want
    empty = language_model.language_model_scores(df.limit(0))
    assert empty.collect() == []


def test_a_level_is_built_without_looking_up_shorter_ngrams(spark, tmp_path, monkeypatch):
    texts = ["a b a b c", "b c a b", "a", "", "c a b a b a"] * 3
    toks = [split(t) + [None] for t in texts]
    c = collections.Counter(tuple(t[j : j + k]) for t in toks for k in range(1, 4) for j in range(len(t) - k + 1))
    folder, shards, sizes = language_model.train(spark.createDataFrame([(t,) for t in texts], "text string"), f"file://{tmp_path}", 3)
    m = language_model.Model(folder, shards, sizes[:1])
    assert type(m.tokens.hashes[0].bits) is np.ndarray and type(m.grams(2, 0).logs) is np.ndarray  # no memmap, which is slower
    keys, counts, shorter = language_model._sum(*m.keys(texts))
    n, v, mu = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c), language_model.MU
    p2 = lambda g: (c[g] + mu * (c[g[1:]] + 1) / (n + v + 1)) / (c[g[:1]] + mu)
    want = {x: sorted(((x + mu * p2(g[1:])) / (c[g[:2]] + mu), p2(g[1:])) for g, y in c.items() if len(g) == 3 and x == y) for x in c.values()}
    monkeypatch.setattr(language_model.Model, "look", None)
    above, w = np.divmod(keys.astype(np.int64), m.size)
    chance = m.chance(3, above, w, counts, shorter)
    got = {x: sorted(zip(chance[counts == x].tolist(), (10 ** (shorter[counts == x] * -language_model.QUANTUM)).tolist())) for x in set(counts.tolist())}
    assert got.keys() == {x for x, g in want.items() if g} and all(np.allclose(got[x], want[x], rtol=1e-3) for x in got)


def test_places_of_bits_in_words():
    rng = np.random.default_rng(4)
    w = np.concatenate([rng.integers(0, 2**64, 500, np.uint64) & rng.integers(0, 2**64, 500, np.uint64), np.array([1, 2**63, 2**64 - 1], np.uint64)])
    pairs = [(x, r, p) for x in w.tolist() for r, p in enumerate(i for i in range(64) if x >> i & 1)]
    got = elias_fano._in_word(np.array([x for x, _, _ in pairs], np.uint64), np.array([r for _, r, _ in pairs], np.uint64))
    assert got.tolist() == [p for _, _, p in pairs]


@pytest.mark.parametrize("order", [3, 4])
def test_language_model_of_longer_contexts(spark, order, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_CHARS", 3_000)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", f"r{rng.randrange(20)}"]) for _ in range(rng.randrange(50)))) for i in range(150)] + [(500, None), (501, "a"), (502, "zz a b c"), (None, "a b")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [split(t) + [None] for _, t in rows]
    c = collections.Counter(tuple(t[j : j + k]) for (i, _), t in zip(rows, toks) if i is not None and not held(i) for k in range(1, order + 1) for j in range(len(t) - k + 1))
    n, v, mu = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c), language_model.MU

    def p(g):
        return (c[g] + 1) / (n + v + 1) if len(g) == 1 else (c[g] + mu * p(g[1:])) / (c[g[:-1]] + mu)

    want = collections.Counter((i, len(t), round(sum(math.log10(p(tuple(t[max(0, j - order + 1) : j + 1]))) for j in range(len(t))) / len(t), 2)) for (i, _), t in zip(rows, toks))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = language_model.language_model_scores(df, order=order).collect()
    near = {(r.doc_id, r.n_tokens): r.score / r.n_tokens for r in got}
    assert len(got) == len(rows) and all(abs(near[i, k] - x) < 0.0055 for i, k, x in want)
    pairs = {r.doc_id: r.score for r in language_model.language_model_scores(df).collect()}
    assert any(abs(pairs[r.doc_id] - r.score) > 0.05 for r in got)
    assert language_model.language_model_scores(df.limit(0), order=order).collect() == []
