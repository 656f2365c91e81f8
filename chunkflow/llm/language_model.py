"""Language-model scoring with an Elias-Fano n-gram trie in memory-mapped files.

The first level holds all training tokens: their hashes, sorted, and the running sums of their counts, both in
Elias-Fano form; a token's id is its place. Every further level up to the order is cut into shards by a hash of the
n-gram, so a frequent context is spread over all of them; an n-gram's place is its index in its shard after the n-grams
of the shards before. A shard holds the places of its contexts on the level before and monotone pointers to their
children, both in Elias-Fano form, the children's ids, sorted within each context and packed to as many bits as an id
needs, quantised smoothed probabilities, and, where n-grams are contexts themselves, counts. A context's place leads to
its pointer and the next one, and the token is searched between the two.

    P(w)         = (c(w) + 1) / (N + V + 1)
    P(w | v)     = (c(v w) + MU * P(w)) / (c(v) + MU)
    P(w | u v)   = (c(u v w) + MU * P(w | v)) / (c(u v) + MU)      and so on

This is Dirichlet smoothing, so an absent n-gram costs MU / (c(context) + MU) times the shorter one's probability and
needs the context's count only; an absent context costs nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import new_folder, remainder, saved, table
from .elias_fano import Packed, Sequence, build, pack_bits
from .files import mapped, pack, unpack, write_bytes

MU = 100.0
#: Words of the longest n-grams of the registered query.
ORDER = 3
#: Steps of log10 probability.
QUANTUM = 1 / 2048
#: Characters of training text for each shard, and of text that a task counts before it passes counts on.
SHARD_CHARS, FLUSH_CHARS = 64_000_000, 24_000_000
#: Characters that are looked up together.
TOGETHER = 4_000_000
#: N-grams whose probabilities are worked out at a time.
STEP = 500_000
#: Hash of the end token; word hashes that happen to equal it are moved by one. Hashes have 63 bits.
END = 0


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end token, and len(texts) + 1 offsets."""
    h, offsets = words.hash_words(words.encode(texts))
    h = (h >> np.uint64(1)).astype(np.int64)
    h[h == END] = 1
    n = np.diff(offsets)
    ends = np.cumsum(n + 1)
    out = np.empty(len(h) + len(n), np.int64)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside], out[~inside] = h, END
    return out, np.concatenate([[0], ends])


def _squeeze(keys: np.ndarray, counts: np.ndarray, shorter: np.ndarray) -> bytes:
    """Sorted keys as differences, with counts and shorter n-grams' logs; byte planes compress well."""
    planes = lambda x, kind: np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()
    raw = planes(np.diff(keys, prepend=np.uint64(0)), "<u8") + planes(counts, "<u4") + planes(shorter, "<u2")
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _loosen(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 14
    column = lambda a, b, kind: np.ascontiguousarray(raw[a * n : b * n].reshape(b - a, n).T).view(kind).ravel()
    return np.cumsum(column(0, 8, "<u8"), dtype=np.uint64), column(8, 12, "<u4"), column(12, 14, "<u2")


def _sum(keys: np.ndarray, counts: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, the sums of their counts, and what is the same wherever a key is."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first, dtype=np.int64) if len(first) else counts, shorter[order[first]]


def _counter(keys_of, shard_of):
    """mapInArrow function: sums of the keys of whole texts, as rows (shard, blob); keys_of: (keys, counts, shorter)."""
    schema = pa.schema([("shard", pa.int64()), ("blob", pa.binary())])

    def run(it):
        held, size = [], 0

        def flush():
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            keys, counts, shorter = _sum(*columns)
            columns.clear()
            shard = shard_of(keys)
            order = _by_shard(shard)
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            parts = np.split(order, cuts)
            rows = [(int(shard[p[0]]), _squeeze(keys[p], counts[p], shorter[p])) for p in parts if len(p)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

        for batch in it:
            texts = batch.column(0).to_pylist()
            for a, b in words.batches(texts, TOGETHER):
                held.append(keys_of(texts[a:b]))
                size += sum(len(t or "") for t in texts[a:b])
                if size >= FLUSH_CHARS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _reduced(blobs: DataFrame, shards: int, merge, schema: str) -> DataFrame:
    """merge(shard, keys, counts, shorter) for each shard, in a task of its own; its rows are a few blobs for each task that counted."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it):
        parts: dict[int, list] = {}
        for batch in it:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.setdefault(shard, []).append(_loosen(blob))
        for shard, got in parts.items():
            columns = [np.concatenate(x) for x in zip(*got)]
            got.clear()
            summed = _sum(*columns)
            columns.clear()
            yield pa.RecordBatch.from_pydict({n: [x] for n, x in zip(names, merge(shard, *summed))})

    return saved(blobs.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(run, schema), "model")


def _token_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (h.astype(np.int64) >> 31) * shards >> 32


def _gram_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((words.mix(keys.astype(np.uint64)) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> np.ndarray:
    """Stable order by shard; numbers of few bytes are sorted by radix."""
    most = int(shard.max(initial=0))
    return np.argsort(shard.astype(np.uint8 if most < 256 else np.uint16) if most < 65_536 else shard, kind="stable")


class Tokens:
    """First level: ids and counts of token hashes, over the mapped files of all shards."""

    def __init__(self, folder: str, shards: int):
        files = [unpack(mapped(f"{folder}/tokens-{i:06d}.bin")) for i in range(shards)]
        self.hashes, self.sums = ([Sequence(a, x) for a in files] for x in ("hash", "sums"))
        self.base = np.concatenate([[0], np.cumsum([s.n for s in self.hashes])])
        self.total = sum(s.universe - 1 for s in self.sums)

    @staticmethod
    def build(h: np.ndarray, counts: np.ndarray) -> bytes:
        return pack(build(h, 2**63, "hash") | build(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), int(counts.sum()) + 1, "sums"))

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1 if unknown) and count of each of the sorted different hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        cuts = np.searchsorted(_token_shard(h, len(self.hashes)), np.arange(len(self.hashes) + 1))
        for hashes, sums, base, a, b in zip(self.hashes, self.sums, self.base, cuts[:-1], cuts[1:]):
            if b > a:
                at = hashes.find(h[a:b])
                hit = np.flatnonzero(at >= 0)
                before, upto = sums.pairs(at[hit])
                ids[a + hit], counts[a + hit] = at[hit] + base, upto - before
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        out, shard = np.empty(len(ids), np.int64), np.searchsorted(self.base, ids, "right") - 1
        for s in np.unique(shard).tolist():
            mine = np.flatnonzero(shard == s)
            before, upto = self.sums[s].pairs(ids[mine] - self.base[s])
            out[mine] = upto - before
        return out


class Grams:
    """One shard of a level above the first."""

    def __init__(self, uri: str):
        arrays = unpack(mapped(uri))
        self.contexts, self.pointers = (Sequence(arrays, x) for x in ("contexts", "pointers"))
        self.children = Packed(arrays["children"], int(arrays["width"][0]))
        self.logs, self.counts = arrays["logs"], arrays["counts"]

    @staticmethod
    def build(v: np.ndarray, w: np.ndarray, counts: np.ndarray, logs: np.ndarray, size: int, above: int) -> bytes:
        """logs: log10 P. v: places of the contexts (of `above` places), w: ids of the tokens (of `size`), sorted by both."""
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
        contexts = v[first]
        width = max(1, int(size).bit_length())
        arrays = build(contexts, above, "contexts") | build(np.append(first, len(v)), len(v) + 1, "pointers")
        arrays |= {"children": pack_bits(w, width), "width": np.array([width], np.int64)}
        return pack(arrays | {"logs": np.minimum(np.rint(-logs / QUANTUM), 65535).astype(np.uint16), "counts": counts.astype(np.uint32)})

    def look(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Index of the n-gram of context v and token w, sorted by both; -1 where the shard has none."""
        out = np.full(len(v), -1, np.int64)
        if not len(v) or not self.contexts.n:
            return out
        starts = np.append(True, v[1:] != v[:-1])
        context = self.contexts.find(v[starts])
        some = context >= 0
        begin, end = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        begin[some], end[some] = self.pointers.pairs(context[some])
        of = np.cumsum(starts) - 1
        lo, n = begin[of], (end - begin)[of]
        todo = np.flatnonzero(n > 1)
        at, left, token = lo[todo], n[todo], w[todo]
        while len(todo):  # the token is at `at` or one of the next left - 1, if anywhere
            half = left >> 1
            at += half * (self.children[at + half] <= token)
            left -= half
            more = np.flatnonzero(left > 1)
            if 4 * len(more) <= 3 * len(todo):
                lo[todo] = at
                todo, at, left, token = todo[more], at[more], left[more], token[more]
        here = np.flatnonzero(n)
        here = here[self.children[lo[here]] == w[here]]
        out[here] = lo[here]
        return out

    def split(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and token of the n-grams at the indices."""
        return self.contexts.access(self.pointers.rank(at) - 1), self.children[at]


class Model:
    """The levels written so far; sizes: for each level above the first, the n-grams of every shard."""

    def __init__(self, folder: str, shards: int, sizes: tuple[tuple[int, ...], ...]):
        self.folder, self.shards = folder, shards
        self.tokens = Tokens(folder, shards)
        self.size, self.total = int(self.tokens.base[-1]), self.tokens.total
        self.bases = [np.concatenate([[0], np.cumsum(n)]).astype(np.int64) for n in sizes]
        self._grams: dict[tuple[int, int], Grams] = {}

    @property
    def order(self) -> int:
        return len(self.bases) + 1

    def places(self, level: int) -> int:
        return self.size if level == 1 else int(self.bases[level - 2][-1])

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        different, back = np.unique(h, return_inverse=True)
        ids, counts = self.tokens.look(different)
        return ids[back], counts[back]

    def log_unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.size + 1))

    def grams(self, level: int, shard: int) -> Grams:
        if (level, shard) not in self._grams:
            self._grams[level, shard] = Grams(f"{self.folder}/grams{level}-{shard:06d}.bin")
        return self._grams[level, shard]

    def look(self, level: int, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place (-1 if unknown), count (0 on a last level) and steps of log10 P of the n-grams of contexts v and tokens w."""
        keys = v * self.size + w
        sort = np.argsort(keys)
        keys = keys[sort]
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        keys = keys[new]
        shard = _gram_shard(keys, self.shards)
        order = _by_shard(shard)
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        keys = keys[order]
        v = keys // self.size
        w = keys - v * self.size
        found = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint16)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            mine, g = slice(cuts[s], cuts[s + 1]), self.grams(level, s)
            at = g.look(v[mine], w[mine])
            hit = np.flatnonzero(at >= 0)
            at, hit = at[hit], hit + cuts[s]
            found[0][hit], found[2][hit] = at + self.bases[level - 2][s], g.logs[at]
            if len(g.counts):
                found[1][hit] = g.counts[at]
        where = np.empty(len(keys), np.int64)
        where[order] = np.arange(len(keys))
        back = np.empty(len(sort), np.int64)
        back[sort] = where[np.cumsum(new) - 1]
        return tuple(x[back] for x in found)

    def chance(self, level: int, v: np.ndarray, w: np.ndarray, counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """P of training n-grams (context, token, count) of a level, sorted by context: their counts and the shorter n-gram's P.

        On the second level P(w) is worked out; above, shorter holds the steps of log10 P that are stored for it.
        """
        new = np.append(True, v[1:] != v[:-1])
        of, v = np.cumsum(new) - 1, v[new]
        if level == 2:
            return (counts + MU * 10 ** self.log_unigram(self.tokens.counts_of(w))) / (self.tokens.counts_of(v)[of] + MU)
        return (counts + MU * 10.0 ** (shorter * -QUANTUM)) / (self.counts_of(level - 1, v)[of] + MU)

    def counts_of(self, level: int, places: np.ndarray) -> np.ndarray:
        """Of places in ascending order."""
        out, base = np.empty(len(places), np.int64), self.bases[level - 2]
        cuts = np.searchsorted(places, base)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            out[cuts[s] : cuts[s + 1]] = self.grams(level, s).counts[places[cuts[s] : cuts[s + 1]] - base[s]]
        return out

    def levels(self, ids: np.ndarray, counts: np.ndarray, offsets: np.ndarray):
        """For each level above the first: positions, places and counts of their contexts, what is found of their n-grams."""
        before = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))
        place, count = ids, counts
        for level in range(2, self.order + 1):
            after = np.flatnonzero(before >= level - 1)
            v, c = place[after - 1], count[after - 1]
            both = np.flatnonzero((v >= 0) & (ids[after] >= 0))
            found, n, steps = self.look(level, v[both], ids[after[both]])
            hit = np.flatnonzero(found >= 0)
            yield after, v, c, after[both[hit]], steps[hit] * -QUANTUM
            if level < self.order:
                place, count = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
                place[after[both]], count[after[both]] = found, n

    def keys(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, on the level after the last, of all n-grams of training texts, counts, and steps of log10 P without the first word."""
        h, offsets = tokens(texts)
        ids, _ = self.ids(h)
        before = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))
        place, shorter = ids, np.zeros(len(ids), np.uint16)
        for level in range(2, self.order + 1):
            after = np.flatnonzero(before >= level - 1)
            at = np.full(len(ids), -1, np.int64)
            at[after], _, shorter[after] = self.look(level, place[after - 1], ids[after])
            place = at
        after = np.flatnonzero(before >= self.order)
        keys, shorter = (place[after - 1] * self.size + ids[after]).astype(np.uint64), shorter[after]
        return _sum(keys, np.ones(len(keys), np.uint32), shorter) if self.order == 1 else (keys, np.ones(len(keys), np.uint32), shorter)

    def score(self, texts) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        h, offsets = tokens(texts)
        ids, counts = self.ids(h)
        single = self.log_unigram(counts)
        full = single.copy()
        for after, v, c, hit, logs in self.levels(ids, counts, offsets):
            full[after] += np.where(v >= 0, np.log10(MU / (c + MU)), 0)
            full[hit] = logs
        add = lambda x: np.add.reduceat(x, offsets[:-1]) if len(texts) else x[:0]
        return np.diff(offsets), add((counts > 0).astype(np.int64)), add(single), add(full)


_MODELS: dict[tuple, Model] = {}


def model(folder: str, shards: int, sizes: tuple[tuple[int, ...], ...]) -> Model:
    """Opened once by a Python worker."""
    key = (folder, shards, sizes)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(*key)
    return _MODELS[key]


def train(docs: DataFrame, folder: str, order: int) -> tuple[str, int, tuple[tuple[int, ...], ...]]:
    """Counts all texts of docs and writes the model's files to the shared folder; returns what model() takes."""
    texts = docs.select("text")
    shards = 1 + int((texts.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS)

    def count_tokens(t):
        keys, counts = np.unique(tokens(t)[0].astype(np.uint64), return_counts=True)
        return keys, counts.astype(np.uint32), np.zeros(len(keys), np.uint16)

    def write_tokens(shard, keys, counts, _):
        write_bytes(f"{folder}/tokens-{shard:06d}.bin", Tokens.build(keys.astype(np.int64), counts))
        return shard, len(keys)

    once = texts.mapInArrow(_counter(count_tokens, lambda k: _token_shard(k, shards)), "shard long, blob binary")
    made = {r[0] for r in _reduced(once, shards, write_tokens, "shard long, n long").collect()}  # one row per shard
    empty = np.zeros(0, np.int64)
    for s in set(range(shards)) - made:
        write_tokens(s, empty, empty, empty)
    trained = folder, shards, ()
    for level in range(2, order + 1):
        trained = _next_level(texts, *trained, level == order)
    return trained


def _next_level(texts: DataFrame, folder: str, shards: int, sizes: tuple, last: bool) -> tuple[str, int, tuple]:
    """Writes the level after those of sizes; the n-grams of the last level are no contexts and need no counts."""
    level, empty = len(sizes) + 2, np.zeros(0, np.int64)

    def write(shard, keys, counts, shorter):
        m = model(folder, shards, sizes)
        keys = keys.view(np.int64)
        v = keys // m.size
        w = keys - v * m.size
        logs = [np.log10(m.chance(level, *(x[i : i + STEP] for x in (v, w, counts, shorter)))) for i in range(0, len(keys), STEP)]
        write_bytes(f"{folder}/grams{level}-{shard:06d}.bin", Grams.build(v, w, empty if last else counts, np.concatenate(logs), m.size, m.places(level - 1)))
        return shard, len(keys)

    counted = texts.mapInArrow(_counter(lambda t: model(folder, shards, sizes).keys(t), lambda k: _gram_shard(k, shards)), "shard long, blob binary")
    made = dict(tuple(r) for r in _reduced(counted, shards, write, "shard long, n long").where("n > 0").collect())
    for s in set(range(shards)) - set(made):
        write_bytes(f"{folder}/grams{level}-{s:06d}.bin", Grams.build(empty, empty, empty, empty.astype(float), 1, 1))
    return folder, shards, (*sizes, tuple(made.get(s, 0) for s in range(shards)))


def score_documents(docs: DataFrame, trained: tuple[str, int, tuple]) -> DataFrame:
    """doc_id, held (as given), n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(it):
        for batch in it:
            texts = batch.column(2).to_pylist()
            m = model(*trained)
            for a, b in words.batches(texts, TOGETHER):
                n, known, base, score = m.score(texts[a:b])
                total = np.full(b - a, m.total)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *map(pa.array, (n.astype(np.int64), known, total, base, score))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_model_scores(docs: DataFrame, mod: int = 7, held: int = 2, order: int = 2) -> DataFrame:
    """Scores every text with a model of order `order` of the texts whose crc32(doc_id as text) modulo `mod` is not `held`.

    Null texts are empty: one token, the end. Null ids are not held out and not learnt from. Repeated rows are learnt
    from and scored as often as they occur. Without training rows every token has probability 1 / (N + V + 1) = 1.
    Other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    trained = train(d.where("doc_id is not null and not held_out"), new_folder(docs.sparkSession, "language-model"), order)
    return score_documents(d, trained)


def op6_elias_fano_lm(spark, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"), order=ORDER)
