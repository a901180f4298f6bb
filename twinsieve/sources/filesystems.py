"""One view of a tree, whatever holds it: a mounted path, or any URI that ``pyarrow.fs`` opens (hdfs, s3, gs, ...).

Both kinds list one directory at a time and never follow a directory link.  A mounted
tree tells names first and sizes by a call a file (``lstat``), so a caller that only wants some
names pays for those; a remote listing brings sizes and times along.  Paths of a remote tree
are whole URIs, so every executor can open them without knowing the root.
"""

from __future__ import annotations

import os
import stat as st
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import NamedTuple

from ..config import IGNORED_DIR_NAMES

#: Bytes that a copy holds at a time.
COPY_BYTES = 1 << 20


class Entry(NamedTuple):
    path: str
    is_dir: bool
    size: int | None = None
    mtime: datetime | None = None
    error: str | None = None
    regular: bool = True


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def mounted(path: str) -> str:
    """The path behind a plain path or ``file:`` URI."""
    return "/" + path[len("file:"):].lstrip("/") if path.startswith("file:") else path


class MountedTree:
    """A tree on a file system mounted at the same path everywhere."""

    knows_sizes = False

    def __init__(self, root: str):
        self.root = os.path.abspath(mounted(root))

    def check(self) -> None:
        """An unreadable root is an error, never an empty tree."""
        with os.scandir(self.root):
            pass

    def exists(self) -> bool:
        return os.path.exists(self.root)

    def children(self, directory: str) -> Iterator[Entry]:
        try:
            with os.scandir(directory) as it:
                for e in it:
                    try:
                        is_dir = e.is_dir(follow_symlinks=False)
                    except OSError:
                        is_dir = False
                    if not (is_dir and e.name in IGNORED_DIR_NAMES):
                        yield Entry(e.path, is_dir)
        except OSError:  # a directory that vanished or cannot be read below a readable root
            return

    @staticmethod
    def stat(entry: Entry) -> Entry:
        try:
            s = os.lstat(entry.path)
        except OSError as e:
            return entry._replace(error=f"Cannot stat file: {e}")
        if st.S_ISLNK(s.st_mode) or not st.S_ISREG(s.st_mode):
            return entry._replace(regular=False)
        return entry._replace(size=int(s.st_size), mtime=datetime.fromtimestamp(s.st_mtime, tz=timezone.utc))


class ListedTree:
    """A tree behind ``pyarrow.fs``: a directory's listing names, sizes and dates its files."""

    knows_sizes = True

    def __init__(self, root: str):
        from pyarrow import fs as pafs

        root = root.rstrip("/")
        self.fs, self.base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(mounted(root))}")
        # What turns a path of the file system into a URI again (nothing for plain paths).
        self.prefix = root[: len(root) - len(self.base)] if is_remote(root) and root.endswith(self.base) else ""
        self.root = self.prefix + self.base

    def check(self) -> None:
        from pyarrow import fs as pafs

        if self.fs.get_file_info(self.base).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"{self.root} is not a readable directory")

    def exists(self) -> bool:
        from pyarrow import fs as pafs

        return self.fs.get_file_info(self.base).type != pafs.FileType.NotFound

    def children(self, directory: str) -> Iterator[Entry]:
        from pyarrow import fs as pafs

        for f in self.fs.get_file_info(pafs.FileSelector(directory.removeprefix(self.prefix), allow_not_found=True)):
            path = self.prefix + f.path
            if f.type == pafs.FileType.Directory:
                if f.base_name not in IGNORED_DIR_NAMES:
                    yield Entry(path, True)
            elif f.type == pafs.FileType.File:
                yield Entry(path, False, f.size, f.mtime)
            else:
                yield Entry(path, False, regular=False)

    @staticmethod
    def stat(entry: Entry) -> Entry:
        return entry


_TREES: dict[tuple[str, bool], MountedTree | ListedTree] = {}


def tree_of(root: str, listed: bool = False) -> MountedTree | ListedTree:
    """The tree at ``root``; ``listed``: a mounted one through ``pyarrow.fs`` too (it follows file links)."""
    key = (root, listed)
    if key not in _TREES:
        _TREES[key] = ListedTree(root) if listed or is_remote(root) else MountedTree(root)
    return _TREES[key]


def file_system(path: str):
    """(file system, path in it) of a remote URI."""
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(path)


def open_input(path: str):
    """A file's bytes as a stream, wherever it is."""
    if is_remote(path):
        fs, p = file_system(path)
        return fs.open_input_stream(p)
    return open(mounted(path), "rb")


def open_seekable(path: str):
    """A file's bytes for reads at any position: headers, byte ranges."""
    if is_remote(path):
        fs, p = file_system(path)
        return fs.open_input_file(p)
    return open(mounted(path), "rb")


def copy_file(src: str, dst: str, through: bool = False) -> None:
    """Copy ``src`` to ``dst`` under a name of its own, then move it into place: a lost task leaves no partial
    file under a final name.  Between mounted paths times and modes come along; ``through``: by streams in any case."""
    import shutil
    import uuid

    tmp = f"{dst}.part-{uuid.uuid4().hex}"
    if not (through or is_remote(src) or is_remote(dst)):
        src, dst, tmp = mounted(src), mounted(dst), mounted(tmp)
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        try:
            shutil.copy2(src, tmp)
            os.replace(tmp, dst)
        except BaseException:
            if os.path.exists(tmp):
                os.remove(tmp)
            raise
        return
    uri = dst if is_remote(dst) else f"file://{os.path.abspath(mounted(dst))}"
    fs, final = file_system(uri)
    part = final + tmp[len(dst):]
    fs.create_dir(final.rpartition("/")[0], recursive=True)
    try:
        with open_input(src) as f, fs.open_output_stream(part) as out:
            shutil.copyfileobj(f, out, COPY_BYTES)
        fs.move(part, final)
    except BaseException:
        try:
            fs.delete_file(part)
        except OSError:
            pass
        raise


def write_file(path: str, data: bytes, mtime: float | None = None) -> None:
    """Write ``data`` under a name of its own, then move it into place; ``mtime`` where the tree is mounted."""
    import uuid

    tmp = f"{path}.part-{uuid.uuid4().hex}"
    if is_remote(path):
        fs, final = file_system(path)
        part = final + tmp[len(path):]
        fs.create_dir(final.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(part) as out:
            out.write(data)
        fs.move(part, final)
        return
    path, tmp = mounted(path), mounted(tmp)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(tmp, "wb") as f:
        f.write(data)
    if mtime is not None:
        os.utime(tmp, (mtime, mtime))
    os.replace(tmp, path)
