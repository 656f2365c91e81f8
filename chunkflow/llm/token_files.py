"""Token ids in binary files: fixed-size blocks, transposed to bit or byte planes, each plane compressed, chunk index.

A file holds the ids of some documents, in ascending order of doc_id:

    magic "CFPLANE1"
    for every block of BLOCK ids (the last is shorter): its planes, each compressed with zstandard
    document table, compressed: doc_id (int64), 1 if the id is null (uint8), number of ids (uint32)
    chunk index, compressed: for every block its number of ids, then the length of each plane (uint32)
    trailer: planes a block, documents, blocks, table length, index length (uint32 each), "CFPLANE1"
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import new_folder, saved, table
from .files import read_bytes, write_bytes
from .words import ranges

MAGIC = b"CFPLANE1"
BLOCK = 65_536
#: Documents and bytes of text of one file, about.
DOCS_A_FILE, BYTES_A_FILE = 4_000, 32_000_000
#: Different words that an encoder remembers before it starts anew, and bytes of text that it takes at a time.
WORDS_KEPT, CHARS = 800_000, 2_000_000
#: Places of the encoder's hash table: more than it remembers and a batch can bring.
PLACES = 3_000_017
#: New words that are encoded in one run.
RUN = 20_000
#: White space, Unicode's too, as RE2 writes it.
WHITE = r"[\p{Z}\t-\r\x1c-\x1f\x{85}]"
#: First bytes of characters of which none is white space.
AFTER_SPACE = np.zeros(256, bool)
AFTER_SPACE[33:127] = AFTER_SPACE[0xC3:0xE1] = AFTER_SPACE[0xE4:0xF5] = True
#: How a byte-level BPE writes a space.
SPACE = "\u0120"


class Tokenizers:
    """A byte-level BPE by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.begin = [i for t, i in self.tokenizer.get_vocab().items() if t.startswith(SPACE)]

    def many(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def one(self, text: str) -> np.ndarray:
        return np.array(self.many([text])[0], np.uint32)


class Ranks:
    """The same BPE from a file of ranks, by tiktoken; its special token is the one after the ranks."""

    added = ["<|endoftext|>"]

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t: len(ranks) for t in self.added})
        self.begin = [i for t, i in ranks.items() if t[:1] == b" "]

    def many(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode(t, allowed_special="all") for t in texts]

    def one(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")


class Encoder:
    """Ids of whole texts; words that were seen before are not encoded again.

    A space that stands before another character begins a new pre-token of a byte-level BPE, so a text may be cut
    before its spaces and the parts encoded alone. Texts with longer runs of white space around a space, or with the
    text of an added token, are encoded whole. Parts are known by 64-bit hashes of their bytes. New parts are encoded
    in runs where no token but a part's first begins with a space. A file of ranks (.tiktoken) is read by tiktoken,
    any other by the tokenizers library.
    """

    def __init__(self, path: str):
        self.library = Ranks(path) if path.endswith(".tiktoken") else Tokenizers(path)
        self.whole = "|".join([f"{WHITE} {WHITE}", f"{WHITE}{{2}}\\z", r"\x00", *map(re.escape, self.library.added)])
        self.begins = np.zeros(2**20, bool)
        self.begins[self.library.begin] = True
        self._forget()

    def _forget(self):
        # rows: number of ids of a part, where they begin
        self.table = words.Table(PLACES)
        self.sizes, self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, h: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes the spans of the bytes and returns their new rows."""
        raw = np.frombuffer(data + b" ", np.uint8)
        spaced = (ends - starts > 1) & (raw[starts] == 32) & AFTER_SPACE[raw[starts + 1]]
        order, sizes, flat = [], [], []
        for run in np.array_split(np.flatnonzero(spaced), 1 + spaced.sum() // RUN):
            n = ends[run] - starts[run]
            ids = self.library.one(raw[np.arange(n.sum()) + np.repeat(starts[run] - (np.cumsum(n) - n), n)].tobytes().decode())
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(run):
                order.append(run)
                sizes.append(np.diff(np.append(at, len(ids))))
                flat.append(ids)
            else:
                spaced[run] = False
        order.append(np.flatnonzero(~spaced))
        alone = self.library.many([data[a:b].decode() for a, b in zip(starts[~spaced].tolist(), ends[~spaced].tolist())])
        sizes.append(np.array([len(x) for x in alone], np.int64))
        flat.append(np.fromiter(chain.from_iterable(alone), np.uint32))
        rows = np.empty(len(h), np.int64)
        rows[np.concatenate(order)] = np.arange(len(h)) + len(self.sizes)
        n = np.concatenate(sizes)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n])
        self.sizes, self.ids = np.concatenate([self.sizes, n]), np.concatenate([self.ids, *flat])
        self.table.add(h, rows)
        return rows

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts that are encoded whole; rows of all parts of the others; len(texts) + 1 offsets of each text's parts."""
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        texts = pc.if_else(pa.array(whole), "", texts)
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = bytes(memoryview(data)[ends[0] : ends[-1]]) if data else b""
        ends = ends - ends[0]
        begin = np.frombuffer(data, np.uint8) == 32
        begin[ends[:-1][ends[:-1] < ends[1:]]] = True
        starts = np.flatnonzero(begin)
        h = words.hash_spans(data, starts, np.append(starts[1:], len(data)))
        h[h == 0] = 1
        rows = self.table.look(h)
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            if len(self.sizes) and len(self.sizes) + len(fresh) > WORDS_KEPT:
                self._forget()
                return (whole, *self._parts(texts)[1:])
            ends_of = np.append(starts[1:], len(data))
            rows[new] = self._learn(fresh, data, starts[new[first]], ends_of[new[first]])[back]
        return whole, rows, np.searchsorted(starts, ends)

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        texts = _plain(texts)
        whole, rows, parts = self._parts(texts)
        n = self.sizes[rows]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends[:-1], n)]
        at = ends[parts]
        out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.library.one(texts[i].as_py())
        return out

    def count(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        texts = _plain(texts)
        whole, rows, parts = self._parts(texts)
        n = np.concatenate([[0], np.cumsum(self.sizes[rows])])[parts]
        out = n[1:] - n[:-1]
        for i in np.flatnonzero(whole).tolist():
            out[i] = len(self.library.one(texts[i].as_py()))
        return out


def _plain(texts: pa.Array | list[str | None]) -> pa.Array:
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    return pc.fill_null(texts.cast(pa.string()), "")


#: One encoder for each tokenizer file, kept by a Python worker from task to task.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def planes_of(block: np.ndarray, bits: bool) -> list[bytes]:
    """The 4 byte planes or the 32 bit planes of a block of ids, least significant first."""
    rows = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [rows[:, i].tobytes() for i in range(4)]
    return [np.packbits(x).tobytes() for x in np.unpackbits(rows, axis=1, bitorder="little").T]


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) if len(planes) == 4 else np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], 1)
    return (rows if len(planes) == 4 else np.packbits(rows, axis=1, bitorder="little")).copy().view("<u4").ravel()


class FileWriter:
    def __init__(self, bits: bool = False, level: int = 3):
        self.bits, self.squeeze = bits, zstandard.ZstdCompressor(level=level).compress
        self.body, self.index, self.docs, self.rest, self.held = [MAGIC], [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray):
        self.docs.append((doc_id, len(ids)))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool):
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            part = ids[i : min(i + BLOCK, end)]
            planes = [self.squeeze(p) for p in planes_of(part, self.bits)]
            self.index.append([len(part), *map(len, planes)])
            self.body += planes
        self.rest, self.held = [ids[end:]], len(ids) - end

    def close(self) -> bytes:
        self._blocks(True)
        null = np.array([d is None for d, _ in self.docs], np.uint8)
        docs = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + null.tobytes() + np.array([n for _, n in self.docs], "<u4").tobytes()
        docs, index = self.squeeze(docs), self.squeeze(np.array(self.index, "<u4").tobytes())
        tail = np.array([32 if self.bits else 4, len(self.docs), len(self.index), len(docs), len(index)], "<u4").tobytes()
        return b"".join([*self.body, docs, index, tail, MAGIC])


class FileReader:
    """Documents and ids of a file; any block can be read alone through the chunk index."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a plane file")
        self.data, loosen = memoryview(data), zstandard.ZstdDecompressor().decompress
        self.planes, docs, blocks, table_len, index_len = np.frombuffer(data[-28:-8], "<u4").tolist()
        end = len(data) - 28
        self.index = np.frombuffer(loosen(data[end - index_len : end]), "<u4").reshape(blocks, 1 + self.planes).astype(np.int64) if blocks else np.zeros((0, 1 + self.planes), np.int64)
        raw = loosen(data[end - index_len - table_len : end - index_len])
        self.ids = [None if z else d for d, z in zip(np.frombuffer(raw, "<i8", docs).tolist(), raw[8 * docs : 9 * docs])]
        self.sizes = np.frombuffer(raw, "<u4", docs, 9 * docs).astype(np.int64)
        self.starts = 8 + np.concatenate([[0], np.cumsum(self.index[:, 1:].sum(1))])
        self._loosen = loosen

    def block(self, i: int) -> np.ndarray:
        at, planes = int(self.starts[i]), []
        for size in self.index[i, 1:].tolist():
            planes.append(self._loosen(self.data[at : at + size]))
            at += size
        return ids_of(planes, int(self.index[i, 0]))

    def documents(self):
        """(doc_id, first position, ids) of each document, in order; about a block and a document are in memory."""
        held, at, block = np.zeros(0, np.uint32), 0, 0
        for doc_id, size in zip(self.ids, self.sizes.tolist()):
            parts, have = [held], len(held)
            while have < size:
                parts.append(self.block(block))
                have += len(parts[-1])
                block += 1
            held = np.concatenate(parts)
            yield doc_id, at, held[:size]
            held, at = held[size:], at + size


def file_of(folder: str, shard: int) -> str:
    return f"{folder}/ids-{shard:07d}.cfp"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, bits: bool = False) -> DataFrame:
    """Writes the documents' ids in ascending doc_id order, end_id after each; one row per file: shard, docs, n_tokens.

    Null texts are empty (only the end id). Null ids come first; rows that repeat an id are each written, in order of
    their texts' first characters and then of a hash. Other columns are ignored. Texts are encoded whole. Rows are dealt
    by ranges of doc_id (and, where an id repeats, of that order), so the order over all files is that of their names,
    and a repeated task writes the same file again.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, size = d.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    files = max(1, -(-rows // DOCS_A_FILE), -(-size // BYTES_A_FILE))
    order = ["doc_id", "head", "hash"]
    d = d.withColumns({"head": F.substring("text", 1, 32), "hash": F.xxhash64("text"), "same": F.monotonically_increasing_id()})
    d = d.repartitionByRange(files, *order, "same").sortWithinPartitions(*order).select("doc_id", "text")

    def write(it):
        out, n, k = FileWriter(bits), 0, 0
        for f in it:
            texts, ids = f.column("text"), f.column("doc_id").to_pylist()
            for a, b in ranges(pc.binary_length(texts).to_pylist(), CHARS):
                for doc_id, x in zip(ids[a:b], encoder(tokenizer).encode(texts.slice(a, b - a))):
                    x = np.append(x, np.uint32(end_id))
                    out.add(doc_id, x)
                    n, k = n + len(x), k + 1
        if k:
            shard = TaskContext.get().partitionId()
            write_bytes(file_of(folder, shard), out.close())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [k], "n_tokens": [n]})

    return saved(d.mapInArrow(write, "shard long, docs long, n_tokens long"), "manifest")


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32. A task holds one file at a time."""

    def read(it):
        for f in it:
            for shard, before in zip(f["shard"].tolist(), f["before"].tolist()):
                data = read_bytes(file_of(folder, shard))
                rows = [(d, before + at, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, at, x in FileReader(data).documents()]
                names, columns = ["doc_id", "start", "n_tokens", "ids_crc32"], list(zip(*rows)) or [[]] * 4
                yield pd.DataFrame({k: pd.array(list(c), "Int64") for k, c in zip(names, columns)})

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.select("shard", before.cast("long").alias("before"))  # a row per file
    return starts.repartition(max(1, manifest.count()), "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_bit_plane_tokens(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(folder, manifest)
