"""Whole files in the shared folder, from executors."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def write_bytes(uri: str, data: bytes) -> None:
    """Writes the file under another name and renames it, so that a repeated task replaces it whole."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(at), recursive=True)
        with store.open_output_stream(f"{at}.{os.getpid()}.tmp") as f:
            f.write(data)
        store.move(f"{at}.{os.getpid()}.tmp", at)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.{os.getpid()}.tmp", "wb") as f:
        f.write(data)
    os.replace(f"{path}.{os.getpid()}.tmp", path)


def read_bytes(uri: str) -> bytes:
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(at) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def mapped(uri: str) -> np.ndarray:
    """The file's bytes, memory-mapped; those of a file that is not on a mounted file system are read into memory."""
    path = _local(uri)
    if path is None:
        return np.frombuffer(read_bytes(uri), np.uint8)
    if not os.path.getsize(path):
        return np.zeros(0, np.uint8)
    return np.asarray(np.memmap(path, np.uint8, "r"))  # a plain view: the subclass makes every later step slower


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Named one-dimensional arrays in one file, each on an 8-byte boundary, behind a small text header."""
    head, body, at = [], [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head.append(f"{name} {a.dtype.str} {len(a)} {at}")
        raw += b"\0" * (-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    text = "\n".join(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body) + b"\0" * 16


def unpack(data: np.ndarray) -> dict[str, np.ndarray]:
    n = int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for line in data[8 : 8 + n].tobytes().decode().rstrip().split("\n"):
        name, kind, size, at = line.split(" ")
        start = 8 + n + int(at)
        out[name] = data[start : start + int(size) * np.dtype(kind).itemsize].view(kind)
    return out
