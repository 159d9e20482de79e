"""Binary files in the shared folder, read and written from tasks. Local mounts are memory-mapped; other stores go
through pyarrow's file systems."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyarrow import fs


def write_bytes(uri: str, parts: list[bytes]) -> None:
    """Writes the file under another name and renames it: a lost task leaves no half file under ``uri``."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    system.move(temporary, path)


def read_bytes(uri: str) -> np.ndarray:
    """The file as an array of bytes; mapped, not read, where the store is a mounted folder."""
    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with system.open_input_file(path) as source:
        return np.frombuffer(source.read(), np.uint8)


def pack(arrays: dict[str, np.ndarray]) -> list[bytes]:
    """Named arrays as parts of one file: a text header of names, types and lengths, then the raw values."""
    header = ";".join(f"{name},{a.dtype.str},{len(a)}" for name, a in arrays.items()).encode()
    head = len(header).to_bytes(8, "little") + header
    parts = [head + b"\0" * (-len(head) % 8)]
    for a in arrays.values():
        raw = np.ascontiguousarray(a).tobytes()
        parts.append(raw + b"\0" * (-len(raw) % 8))
    return parts


def unpack(data: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of ``pack``, as views."""
    length = int(data[:8].view("<u8")[0])
    at, out = 8 + length + -(8 + length) % 8, {}
    for entry in bytes(data[8 : 8 + length]).decode().split(";"):
        name, kind, n = entry.split(",")
        size = int(n) * np.dtype(kind).itemsize
        out[name] = data[at : at + size].view(kind)
        at += size + -size % 8
    return out
