"""Files that tasks write and read themselves, in whatever store the shared folder is in."""

from __future__ import annotations

import re

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path within it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def files_in(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files below a folder whose names end in suffix, by name; or of the file itself."""
    store, path = filesystem(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((uri.rstrip("/") + x.path[len(path.rstrip("/")) :], x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(suffix))


class Window:
    """Random reads of a file through one buffer, so that many small reads in order cost few requests."""

    def __init__(self, uri: str, ahead: int = 1 << 20):
        store, path = filesystem(uri)
        self.file, self.ahead, self.at, self.held = store.open_input_file(path), ahead, 0, b""
        self.size = self.file.size()

    def read(self, offset: int, n: int) -> bytes:
        k = offset - self.at
        if k < 0 or k + n > len(self.held):
            self.held, self.at, k = bytes(self.file.read_at(min(max(n, self.ahead), self.size - offset), offset)), offset, 0
        return self.held[k : k + n]

    def close(self) -> None:
        self.file.close()


def writer(uri: str):
    """An output stream for a new file; folders are made."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)
