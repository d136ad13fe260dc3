"""Files of plain arrays in a shared folder, memory-mapped by the workers that read them."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import numpy as np
import zstandard
from pyarrow import fs


class Store:
    """A folder given by URI.  A file appears under its name only when it is whole; names are never used twice, and
    readers take only names that a finished task has reported, so repeated and lost tasks leave nothing that is read."""

    def __init__(self, uri: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri)

    def write(self, kind: str, arrays: dict[str, np.ndarray]) -> tuple[str, str]:
        """Name and layout of a new file that holds the arrays one after another."""
        name, at, layout = f"{kind}-{uuid.uuid4().hex}", 0, []
        self.fs.create_dir(self.path, recursive=True)
        with self.fs.open_output_stream(f"{self.path}/.{name}") as out:
            for key, x in arrays.items():
                x = np.ascontiguousarray(x)
                layout.append(f"{key}:{x.dtype.str}:{len(x)}:{at}")
                out.write(x.tobytes())
                pad = -x.nbytes % 8
                out.write(b"\0" * pad)
                at += x.nbytes + pad
        self.fs.move(f"{self.path}/.{name}", f"{self.path}/{name}")
        return name, ";".join(layout)

    def read(self, name: str, layout: str) -> dict[str, np.ndarray]:
        """The arrays, mapped. A folder that can't be mapped is copied to an unnamed local file first."""
        path = f"{self.path}/{name}"
        if isinstance(self.fs, fs.LocalFileSystem):
            data = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        else:
            with tempfile.NamedTemporaryFile() as held:
                with self.fs.open_input_stream(path) as source:
                    shutil.copyfileobj(source, held)
                held.flush()
                data = np.memmap(held.name, np.uint8, "r") if held.tell() else np.zeros(0, np.uint8)
        out = {}
        for part in layout.split(";"):
            key, kind, n, at = part.split(":")
            dtype = np.dtype(kind)
            out[key] = np.frombuffer(data, dtype, int(n), int(at)) if int(n) else np.zeros(0, dtype)
        return out


def shrink(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes: byte planes of the array."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def grow(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def shrink_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, by their differences."""
    return shrink(np.diff(keys, prepend=keys.dtype.type(0)))


def grow_sorted(blob: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(grow(blob, dtype), dtype=dtype)


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)
