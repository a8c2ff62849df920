"""Files by path or URI, opened inside tasks."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


def found(uri: str, suffix: str, recursive: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of files below a folder, or of one file, by path; names that start with a dot are left out, the suffix is taken in any case."""
    store, path = at(uri)
    info = store.get_file_info(path)
    every = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recursive))
    return sorted((f.path, f.size) for f in every if f.is_file and f.base_name.lower().endswith(suffix) and f.base_name[0] != ".")
