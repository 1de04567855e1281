"""Files by byte ranges, wherever they are: what the binary sources need."""

from __future__ import annotations

from typing import BinaryIO

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def size(path: str) -> int:
    system, name = _at(path)
    return system.get_file_info(name).size


def exists(path: str) -> bool:
    system, name = _at(path)
    return system.get_file_info(name).type == fs.FileType.File


def make_folder(path: str) -> None:
    system, name = _at(path)
    system.create_dir(name, recursive=True)


def read(path: str, begin: int, length: int) -> bytes:
    system, name = _at(path)
    with system.open_input_file(name) as f:
        f.seek(begin)
        return f.read(length)


def create(path: str) -> BinaryIO:
    system, name = _at(path)
    return system.open_output_stream(name)


def delete(path: str) -> None:
    system, name = _at(path)
    system.delete_file(name)
