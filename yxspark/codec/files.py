"""Files by local path or by any URI that Arrow's file systems know."""

from __future__ import annotations

import json
import os
import re
import uuid
from contextlib import contextmanager


def _fs(path: str):
    from pyarrow import fs

    if re.match(r"^[a-z][a-z0-9+.-]+://", path) or path.startswith("file:"):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _raised(error: OSError, path: str):
    if "does not exist" in str(error) or "No such file" in str(error):
        return FileNotFoundError(f"no such file: {path}")
    return error


@contextmanager
def opened(path: str):
    """A random-access file."""
    f, p = _fs(path)
    try:
        with f.open_input_file(p) as source:
            yield source
    except FileNotFoundError:
        raise
    except OSError as e:
        raise _raised(e, path) from None


@contextmanager
def created(path: str):
    f, p = _fs(path)
    f.create_dir(os.path.dirname(p), recursive=True)
    with f.open_output_stream(p) as sink:
        yield sink


def delete(path: str) -> None:
    f, p = _fs(path)
    try:
        f.delete_file(p)
    except OSError:
        pass


def move(source: str, to: str) -> None:
    f, a = _fs(source)
    f.move(a, _fs(to)[1])


def exists(path: str) -> bool:
    from pyarrow import fs

    f, p = _fs(path)
    return f.get_file_info(p).type != fs.FileType.NotFound


JOURNAL = re.compile(r"/_commit-[^/]*\.json$")


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, or of the .yxdb files below a directory, or of what a pattern matches; in name order. A commit that has begun counts as done."""
    from fnmatch import fnmatch

    from pyarrow import fs

    f, p = _fs(path)
    scheme = re.match(r"^[a-z][a-z0-9+.-]+://", path)
    if any(c in p for c in "*?["):
        top = re.split(r"/[^/]*[*?\[]", p)[0] or "/"
        inside = [i for i in f.get_file_info(fs.FileSelector(top, recursive=True)) if i.type == fs.FileType.File]
        asked = lambda q: fnmatch(q, p)
    else:
        info = f.get_file_info(p)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such file: {path}")
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        inside = [i for i in f.get_file_info(fs.FileSelector(p, recursive=True)) if i.type == fs.FileType.File]
        asked = lambda q: q.endswith(".yxdb") and not re.search(r"/[._][^/]*$", q)
    sizes = {i.path: i.size for i in inside}
    found = {q: q for q in sizes if asked(q)}
    for q in sorted(q for q in sizes if JOURNAL.search(q)):
        journal = json.loads(f.open_input_stream(q).read())
        for old in journal["old"]:
            found.pop(old, None)
        found |= {to: source for source, to in journal["new"] if to not in sizes and source in sizes and asked(to)}
    prefix = scheme[0] if scheme and not path.startswith("file:") and not isinstance(f, fs.LocalFileSystem) else ""
    return [(prefix + source, sizes[source]) for _, source in sorted(found.items())]


def commit(folder: str, old: list[str], new: list[tuple[str, str]]) -> None:
    """Files (source, name) take the place of the old ones. A journal tells first what is to be done: from then on readers see the new files only, and the next commit ends what one began."""
    from pyarrow import fs

    f, p = _fs(folder)
    f.create_dir(p, recursive=True)
    for i in f.get_file_info(fs.FileSelector(p)):
        if JOURNAL.search(i.path):
            _finish(f, i.path)
    plain = lambda q: _fs(q)[1]
    hidden, at = f"{p}/_{uuid.uuid4().hex}.tmp", f"{p}/_commit-{uuid.uuid4().hex}.json"
    with f.open_output_stream(hidden) as out:
        out.write(json.dumps({"old": [plain(q) for q in old], "new": [(plain(a), plain(b)) for a, b in new]}).encode())
    f.move(hidden, at)
    _finish(f, at)


def _finish(f, at: str) -> None:
    from pyarrow import fs

    journal = json.loads(f.open_input_stream(at).read())

    def there(q: str) -> bool:
        return f.get_file_info(q).type != fs.FileType.NotFound

    for q in journal["old"]:
        if there(q):
            f.delete_file(q)
    for source, to in journal["new"]:
        if there(source):
            f.move(source, to)
    f.delete_file(at)
