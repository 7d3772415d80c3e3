"""Opening archives where they are, and fetching them into a folder; a file is there whole or not at all."""

from __future__ import annotations

import contextlib
import os
import shutil
import urllib.request
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow.fs as pfs

TIMEOUT = 30.0  # seconds that a connection may say nothing


def open_uri(uri: str) -> tuple[pfs.FileSystem, str]:
    """File system and path of a local path or of a URI that Arrow can reach."""
    return pfs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")


@contextlib.contextmanager
def open_stream(uri: str, timeout: float = TIMEOUT) -> Iterator[BinaryIO]:
    """The bytes of a file or of an http(s) URL, as a stream; an error status raises."""
    if uri.startswith(("http://", "https://")):
        with urllib.request.urlopen(uri, timeout=timeout) as response:
            yield response
    else:
        fs, path = open_uri(uri)
        with fs.open_input_stream(path, compression=None) as raw:
            yield raw


def fetch(uri: str, *, base_url: str, folder: str, timeout: float = TIMEOUT) -> tuple[str, bool]:
    """Download ``base_url + uri`` into ``folder`` unless the file exists: (path, downloaded).

    ``folder`` is a local path or a URI that Arrow can write; on a cluster, one that all executors share.
    An error status raises; the bytes go to a temporary name that is renamed at the end, so an
    interrupted download is never taken for an archive, and two tasks that fetch one file do no harm.
    """
    path = f"{folder.rstrip('/')}/{uri.rpartition('/')[2]}"
    fs, at = open_uri(path)
    if fs.get_file_info(at).type != pfs.FileType.NotFound:
        return path, False
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    temp = f"{at}.{uuid.uuid4().hex}.part"
    try:
        with open_stream(base_url + uri, timeout) as response, fs.open_output_stream(temp, compression=None) as out:
            shutil.copyfileobj(response, out, 1 << 20)
        fs.move(temp, at)
    finally:
        if fs.get_file_info(temp).type != pfs.FileType.NotFound:
            fs.delete_file(temp)
    return path, True
