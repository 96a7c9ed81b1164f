"""Binary files in the folder that all executors share, written and read inside tasks."""

from __future__ import annotations

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path is local."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def write_bytes(uri: str, parts) -> int:
    """Write the parts one after another; returns the bytes written."""
    system, path = store(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    total = 0
    with system.open_output_stream(path, compression=None) as out:
        for part in parts:
            out.write(part)
            total += memoryview(part).nbytes
    return total


def read_range(uri: str, start: int = 0, length: int | None = None) -> bytes:
    system, path = store(uri)
    with system.open_input_file(path) as source:
        source.seek(start)
        return source.read() if length is None else source.read(length)


def file_size(uri: str) -> int:
    system, path = store(uri)
    return system.get_file_info(path).size
