"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
from urllib.parse import urlparse

import numpy as np

_OPEN: dict[str, np.ndarray] = {}
_HELD: list[tempfile.TemporaryDirectory] = []


def _local(folder: str) -> str | None:
    """The path of a folder on a mounted file system, None for a store that needs a client."""
    parts = urlparse(folder)
    return parts.path if parts.scheme in ("", "file") else None


def write(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array; a second attempt replaces the first by the same content."""
    local = _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        handle, part = tempfile.mkstemp(dir=local, prefix=f".{name}-")
        with os.fdopen(handle, "wb") as out:
            np.save(out, values)
        os.replace(part, f"{local}/{name}.npy")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    part = f"{path}/.{name}-{os.getpid()}-{np.random.default_rng().integers(2**62)}"
    with store.open_output_stream(part) as out:
        np.save(out, values)
    store.move(part, f"{path}/{name}.npy")


def read(folder: str, name: str) -> np.ndarray:
    """The array, mapped into memory; from a store without files it is fetched once per worker first."""
    key = f"{folder}/{name}"
    if key not in _OPEN:
        if len(_OPEN) > 4096:  # mappings of earlier models
            _OPEN.clear()
        local = _local(folder)
        if local is not None:
            path = f"{local}/{name}.npy"
        else:
            from pyarrow import fs

            if not _HELD:
                _HELD.append(tempfile.TemporaryDirectory(prefix="harvestlens-arrays-"))  # removed with the worker
            store, base = fs.FileSystem.from_uri(folder)
            path = f"{_HELD[0].name}/{abs(hash(key))}.npy"
            with store.open_input_stream(f"{base}/{name}.npy") as source, open(path, "wb") as out:
                while block := source.read(1 << 22):
                    out.write(block)
        size = os.path.getsize(path)
        _OPEN[key] = np.load(path, mmap_mode="r" if size > 256 else None)
    return _OPEN[key]
