"""Byte ranges of local files and of files on web servers."""

from __future__ import annotations

import os
import shutil
import urllib.error
import urllib.request
from urllib.parse import unquote, urlparse

from gridloom.errors import RasterException

#: Seconds that a server may take to answer.
TIMEOUT = 60


def is_web(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def local_path(path: str) -> str:
    """A path that Python opens, of a path or file URL."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


class Ranges:
    """Reads ranges of one file; ``size`` is None for a server that sends whole files only."""

    def __init__(self, path: str, size: int | None = None):
        self.path = path
        if is_web(path):
            self.size = size if size is not None else self._probe()
        else:
            self.size = os.path.getsize(local_path(path))
            self._file = open(local_path(path), "rb")  # noqa: SIM115 - closed by close()

    def _open(self, start: int, length: int):
        request = urllib.request.Request(self.path, headers={"Range": f"bytes={start}-{start + length - 1}"})
        try:
            return urllib.request.urlopen(request, timeout=TIMEOUT)
        except urllib.error.HTTPError as error:
            raise RasterException(f"{self.path} cannot be read: the server answers {error.code}.") from error
        except urllib.error.URLError as error:
            raise RasterException(f"{self.path} cannot be read: {error.reason}.") from error

    def _probe(self) -> int | None:
        with self._open(0, 1) as answer:
            total = (answer.headers.get("Content-Range") or "").rpartition("/")[2]
            return int(total) if answer.status == 206 and total.isdigit() else None

    def fetch(self, start: int, length: int) -> bytes:
        """``length`` bytes from ``start`` on, or fewer where the file ends."""
        length = min(length, max(self.size - start, 0))
        if length == 0:
            return b""
        if not is_web(self.path):
            self._file.seek(start)
            return self._file.read(length)
        with self._open(start, length) as answer:
            if answer.status != 206 or not (answer.headers.get("Content-Range") or "").endswith(f"/{self.size}"):
                raise RasterException(f"{self.path} changed while it was read.")
            return answer.read()

    def close(self) -> None:
        if not is_web(self.path):
            self._file.close()


def download(url: str, folder: str) -> str:
    """A copy of a web file in a folder that all tasks share, streamed; for servers that refuse ranges."""
    if urlparse(folder).scheme not in ("", "file"):
        raise RasterException(f"{url} is sent as a whole only, and {folder} cannot be written to as files.")
    target = os.path.join(local_path(folder), os.path.basename(urlparse(url).path) or "raster")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with urllib.request.urlopen(url, timeout=TIMEOUT) as answer, open(target, "wb") as out:
        shutil.copyfileobj(answer, out, 1 << 20)
    return target
