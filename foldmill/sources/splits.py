"""Files of a folder, cut into byte ranges that are read by different tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import InputPartition

#: Bytes of a file that one task reads, and of a piece that it holds at once.
SPLIT, PIECE = 32 << 20, 4 << 20


def store_of(path: str):
    """The file system of a folder's address, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.rstrip("/"))


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    stop: int


def ranges(folder: str, suffix: str, split: int, whole=lambda path, names: False) -> list[Range]:
    """The byte ranges of the files in ``folder`` whose names end in ``suffix``, in order of name."""
    from pyarrow import fs

    store, root = store_of(folder)
    found = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
    names = {f.base_name for f in found}
    out = []
    for f in sorted(found, key=lambda f: f.base_name):
        if f.base_name.endswith(suffix) and f.size:
            step = f.size if whole(f.base_name, names) else split
            out += [Range(f.path, f.size, at, min(at + step, f.size)) for at in range(0, f.size, step)]
    return out


def text_array(values: list[bytes | None]) -> pa.Array:
    """Strings of UTF-8 bytes; what is not UTF-8 is replaced."""
    try:
        return pa.array(values, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in values], pa.string())


def pieces(store, path: str, start: int) -> Iterator[bytes]:
    """The file's bytes from ``start`` on."""
    with store.open_input_file(path) as f:
        f.seek(start)
        while data := f.read(PIECE):
            yield data
