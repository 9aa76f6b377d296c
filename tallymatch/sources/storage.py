"""Files on whatever store a path names, for code that runs inside tasks.

Paths may be plain (/data/x), file:/data/x, or any scheme Arrow knows (hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import stat
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache
from typing import BinaryIO

from pyarrow import fs

PIECE = 1 << 20
#: A file that one read holds.
SMALL = 1 << 16
LOCAL = fs.LocalFileSystem()
REMOTE = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+)://([^/]*)")
# Hadoop's name for the store that Arrow calls s3.
ARROW_SCHEMES = {"s3a": "s3"}


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path as that store spells it."""
    if path.startswith("file:"):
        return LOCAL, "/" + path.removeprefix("file:").lstrip("/")
    if found := REMOTE.match(path):
        store, root = _remote_store(*found.groups())
        return store, root + path[found.end() :].lstrip("/")
    return LOCAL, path


@lru_cache(maxsize=None)
def _remote_store(scheme: str, authority: str) -> tuple[fs.FileSystem, str]:
    """One client for each store and process, and what its paths begin with.

    Only scheme and authority are read as an address. The rest of a path is a name, in which blanks, percent and number signs,
    question marks and brackets mean themselves.
    """
    store, root = fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{authority}/")
    return store, root.rstrip("/") + "/"


def plain_path(path: str) -> str:
    """A local path without its scheme; paths on other stores stay as they are."""
    store, inner = open_store(path)
    return inner if isinstance(store, fs.LocalFileSystem) else path


def same_folder(one: str, other: str) -> bool:
    return _resolved(one) == _resolved(other)


def is_below(inner: str, outer: str) -> bool:
    """True where ``inner`` lies somewhere under ``outer``."""
    return _resolved(inner).startswith(_resolved(outer).rstrip("/") + "/")


def is_folder(path: str) -> bool:
    store, inner = open_store(path)
    return store.get_file_info(inner).type == fs.FileType.Directory


def is_file(path: str) -> bool:
    store, inner = open_store(path)
    return store.get_file_info(inner).type == fs.FileType.File


def folder_files(path: str) -> list[str]:
    """The files directly in a folder, by name. For folders known to hold few files, such as the parts of a table."""
    store, inner = open_store(path)
    infos = store.get_file_info(fs.FileSelector(inner))
    return [f"{path.rstrip('/')}/{info.base_name}" for info in sorted(infos, key=lambda info: info.base_name) if info.is_file]


def folder_sizes(path: str) -> list[tuple[str, int]]:
    """The same with their sizes."""
    store, inner = open_store(path)
    infos = sorted(store.get_file_info(fs.FileSelector(inner)), key=lambda info: info.base_name)
    return [(f"{path.rstrip('/')}/{info.base_name}", info.size) for info in infos if info.is_file]


def is_local(path: str) -> bool:
    return isinstance(open_store(path)[0], fs.LocalFileSystem)


def write_range(content: BinaryIO, path: str, at: int, length: int) -> None:
    """Write so many bytes of a stream into a local file, from a place on. Several tasks may write to one file, each its own range."""
    _, inner = open_store(path)
    with open(os.open(inner, os.O_WRONLY | os.O_CREAT, 0o666), "wb") as out:
        out.seek(at)
        while length:
            piece = content.read(min(PIECE, length))
            if not piece:
                raise OSError(f"The source ends {length} bytes early")
            out.write(piece)
            length -= len(piece)


def copy_range(source: str, part: str, at: int, length: int) -> None:
    store, path = open_store(source)
    with store.open_input_file(path) as content:
        content.seek(at)
        write_range(content, part, at, length)


def finish_ranges(source: str, part: str, destination: str, size: int) -> None:
    """Give a file that was written in ranges its name and the timestamps of its source."""
    (_, from_path), (_, part_path), (_, to_path) = map(open_store, (source, part, destination))
    # A task that runs twice finds what the first attempt has renamed.
    if not os.path.exists(part_path) and os.path.isfile(to_path) and os.stat(to_path).st_size == size:
        return
    if os.stat(part_path).st_size != size or os.stat(from_path).st_size != size:
        raise OSError(f"The size of {source} has changed")
    shutil.copystat(from_path, part_path)
    os.replace(part_path, to_path)


def name_file(part: str, path: str, size: int) -> None:
    """Give a local file that was written in ranges its name, if it is whole."""
    (_, part_path), (_, to_path) = open_store(part), open_store(path)
    if os.stat(part_path).st_size != size:
        raise OSError(f"{part} is not whole")
    os.replace(part_path, to_path)


def drop_file(path: str) -> None:
    """Remove a local file if it is there."""
    _, inner = open_store(path)
    if os.path.isfile(inner):
        os.remove(inner)


def file_size(path: str) -> int | None:
    """Size in bytes, None where nothing is there. Anything else that goes wrong raises OSError."""
    store, inner = open_store(path)
    if isinstance(store, fs.LocalFileSystem):
        try:
            return os.stat(inner).st_size
        except FileNotFoundError:
            return None
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        return None
    return info.size or 0


def make_folder(path: str) -> None:
    store, inner = open_store(path)
    store.create_dir(inner, recursive=True)


def content_hash(path: str) -> str:
    """Hex SHA-256 of a file, read in pieces."""
    store, inner = open_store(path)
    with _input(store, inner) as content:
        digest = hashlib.sha256()
        while piece := content.read(SMALL):
            digest.update(piece)
        return digest.hexdigest()


def same_bytes(one: str, other: str, piece: int = PIECE) -> tuple[bool, int]:
    """Whether two files hold the same bytes, and how many of each were read: both are read side by side up to the first difference."""
    (store, path), (other_store, other_path) = open_store(one), open_store(other)
    read = 0
    with _input(store, path) as left, _input(other_store, other_path) as right:
        while True:
            a, b = left.read(piece), right.read(piece)
            read += max(len(a), len(b))
            if a != b:
                return False, read
            if not a:
                return True, read


class Aside:
    """Temporary names for the files of one task: in each local folder it writes to, a folder of its own for files in the making.

    The folder that all tasks write to is then changed once a file, by the new name; made next to each other, temporary files would keep
    all tasks waiting for that folder three times a file. ``mark`` tells attempts apart. The folders are removed at the end of the block.
    """

    def __init__(self, mark: str):
        self.mark, self.folders = mark, {}

    def __enter__(self) -> Aside:
        return self

    def __exit__(self, *_) -> None:
        for folder in self.folders.values():
            with suppress(OSError):
                os.rmdir(folder)

    def name(self, store: fs.FileSystem, path: str) -> str:
        """The temporary name of a file. Other stores have no folders to wait for."""
        if not isinstance(store, fs.LocalFileSystem):
            return f"{path}.{self.mark}.part"
        parent, name = os.path.split(path)
        if parent not in self.folders:
            folder = os.path.join(parent, f".{self.mark}.part")
            with suppress(FileExistsError):
                os.mkdir(folder)
            self.folders[parent] = folder
        return f"{self.folders[parent]}/{name}"


def copy_into_place(source: str, destination: str, mark: str | Aside) -> None:
    """Copy a file under a temporary name and rename it. Local copies keep the timestamps."""
    from_store, from_path = open_store(source)
    to_store, to_path = open_store(destination)
    with _renamed_at_end(to_store, to_path, mark) as part:
        if isinstance(from_store, fs.LocalFileSystem) and isinstance(to_store, fs.LocalFileSystem):
            _copy_local(from_path, part)
        else:
            fs.copy_files(from_path, part, source_filesystem=from_store, destination_filesystem=to_store)


def write_into_place(content: BinaryIO, destination: str, mark: str | Aside) -> None:
    """Write a stream under a temporary name, with any missing folders, and rename it."""
    store, path = open_store(destination)
    if not isinstance(mark, Aside) or os.path.dirname(path) not in mark.folders:
        store.create_dir(path.rpartition("/")[0], recursive=True)
    with _renamed_at_end(store, path, mark) as part, _output(store, part) as out:
        shutil.copyfileobj(content, out, PIECE)


@contextmanager
def _renamed_at_end(store: fs.FileSystem, path: str, mark: str | Aside) -> Iterator[str]:
    """A temporary name next to ``path``, or aside, that becomes ``path`` at the end, so no half-written file has the real name.

    ``mark`` tells two attempts at the same file apart. After a failure the temporary file is removed.
    """
    part = mark.name(store, path) if isinstance(mark, Aside) else f"{path}.{mark}.part"
    try:
        yield part
        _give_name(store, part, path)
    except BaseException:
        if store.get_file_info(part).type == fs.FileType.File:
            store.delete_file(part)
        raise


def _give_name(store: fs.FileSystem, part: str, path: str) -> None:
    """Give a finished file its name, in place of whatever has it.

    A rename from one folder to another keeps the whole file system for itself; a link and the removal of the old name keep only the
    folder that they change.
    """
    if isinstance(store, fs.LocalFileSystem):
        try:
            os.link(part, path)
        except OSError:  # another file has the name, or the file system knows no links
            pass
        else:
            os.unlink(part)
            return
    store.move(part, path)


def _copy_local(source: str, part: str) -> None:
    """``shutil.copy2``, which takes several times as many calls, for a small plain file."""
    found = os.stat(source)
    if not stat.S_ISREG(found.st_mode) or found.st_size > SMALL or _has_attributes(source):
        shutil.copy2(source, part)
        return
    with open(source, "rb", buffering=0) as content, open(part, "wb") as out:
        shutil.copyfileobj(content, out, SMALL)
        out.flush()
        os.utime(out.fileno(), ns=(found.st_atime_ns, found.st_mtime_ns))
        if os.fstat(out.fileno()).st_mode != found.st_mode:
            os.chmod(out.fileno(), stat.S_IMODE(found.st_mode))


def _has_attributes(path: str) -> bool:
    """Whether a file has extended attributes, or may have some."""
    try:
        return bool(os.listxattr(path))
    except (AttributeError, OSError):
        return True


def _input(store: fs.FileSystem, path: str) -> BinaryIO:
    return open(path, "rb") if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def _output(store: fs.FileSystem, path: str) -> BinaryIO:
    return open(path, "wb") if isinstance(store, fs.LocalFileSystem) else store.open_output_stream(path)


def _resolved(path: str) -> str:
    store, inner = open_store(path)
    if isinstance(store, fs.LocalFileSystem):
        return os.path.realpath(inner)
    return f"{store.type_name}:{inner.rstrip('/')}"
