"""Files in the shared folder, opened by URI from tasks."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Committed:
    """An output file that gets its name only when all of it is written, so a task's lost or repeated attempt leaves none or the same.

    Where the name is taken, an earlier attempt has written the same rows; its file stays.
    """

    def __init__(self, uri: str, attempt: int):
        self.fs, self.path = at(uri)
        head, _, name = self.path.rpartition("/")
        self.temp = f"{head}/_attempt-{attempt}-{name}"

    def __enter__(self):
        self.stream = self.fs.open_output_stream(self.temp, compression=None)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None and not self._taken():
            try:
                self.fs.move(self.temp, self.path)
                return
            except OSError:
                if not self._taken():  # another attempt may have been first
                    raise
        self.fs.delete_file(self.temp)

    def _taken(self) -> bool:
        return self.fs.get_file_info(self.path).type != fs.FileType.NotFound


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of a folder's files, by name; none if there is no folder."""
    store, path = at(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


def make_folder(uri: str) -> None:
    store, path = at(uri)
    store.create_dir(path, recursive=True)
