"""Files that tasks write to and read from the shared folder, by URI (file, hdfs, s3, gs)."""

from __future__ import annotations

import contextlib
import os

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def written(uri: str):
    """A stream whose file gets its name only when it is whole; a task that is tried again replaces it."""
    system, path = at(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    temp = f"{os.path.dirname(path)}/_{os.path.basename(path)}.{os.urandom(6).hex()}"
    out = system.open_output_stream(temp)
    try:
        yield out
        out.close()
        system.move(temp, path)
    except BaseException:
        with contextlib.suppress(OSError):
            out.close()
            system.delete_file(temp)
        raise


def opened(uri: str):
    system, path = at(uri)
    return system.open_input_file(path)


def removed(uri: str) -> None:
    """Deletes a folder that is done with, if it is there."""
    system, path = at(uri)
    with contextlib.suppress(FileNotFoundError):
        system.delete_dir(path)
