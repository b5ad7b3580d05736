"""Files of numpy arrays in the shared folder: written whole, mapped into memory by workers.

A store that can't be mapped is copied to an unlinked temporary file first; nothing stays on a worker.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs


def _at(uri: str):
    if "://" in uri or uri.startswith("file:"):
        head, _, rest = uri.partition(":")
        return (pafs.LocalFileSystem(), "/" + rest.lstrip("/")) if head == "file" else pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def write_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """One file: the number of arrays, their lengths and widths, then the arrays, each padded to 8 bytes. A retry replaces the file."""
    store, path = _at(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}"
    with store.open_output_stream(part) as out:
        out.write(np.array([len(arrays), *map(len, arrays), *(a.itemsize for a in arrays)], np.int64).tobytes())
        for a in arrays:
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    store.move(part, path)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the least width that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max())) if len(counts) else np.uint8)


def map_arrays(uri: str) -> list[np.ndarray] | None:
    """The arrays of a file of unsigned numbers, mapped read-only; None if there is no such file."""
    store, path = _at(uri)
    if isinstance(store, pafs.LocalFileSystem):
        if not os.path.exists(path):
            return None
        raw = np.memmap(path, np.uint8, "r")
    else:
        if store.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with tempfile.NamedTemporaryFile() as local, store.open_input_stream(path) as src:
            while block := src.read(1 << 22):
                local.write(block)
            local.flush()
            raw = np.memmap(local.name, np.uint8, "r")
    count = int(raw[:8].view(np.int64)[0])
    lengths, widths = raw[8 : 8 + 16 * count].view(np.int64).reshape(2, count).tolist()
    out, at = [], 8 + 16 * count
    for n, width in zip(lengths, widths):
        out.append(raw[at : at + n * width].view(f"<u{width}"))
        at += n * width + -n * width % 8
    return out
