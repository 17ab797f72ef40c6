"""Files of any file system that Arrow knows, where tasks read bytes themselves."""

from __future__ import annotations


def _located(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The file, or the files below a folder in the order of their paths; names that begin with _ or . are none."""
    from pyarrow import fs

    where, root = _located(path)
    if where.get_file_info(root).type != fs.FileType.Directory:
        return [path]
    scheme = path.split(":")[0] + "://" if ":" in path else ""
    return sorted(scheme + f.path for f in where.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "_.")


def opened(path: str):
    """A stream that can seek."""
    where, root = _located(path)
    return where.open_input_file(root)


def created(path: str):
    """A stream to write a file, whose folder is made too."""
    where, root = _located(path)
    where.create_dir(root.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(root)


def put(path: str, raw: bytes) -> None:
    """Writes a small file, and the folder that it is in."""
    with created(path) as out:
        out.write(raw)
