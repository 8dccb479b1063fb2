"""Sources that grow: a followed file and a named pipe, as streaming data sources.

Both run on the driver, as one reader of one local file must; rows then spread as any stream's do.

    spark.dataSource.register(FollowedFile)
    spark.readStream.format("followed_file").option("path", "/var/log/app.log").load()
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Most bytes that one micro-batch takes from a file or a pipe.
TAKE = 8 << 20


def whole_lines(raw: bytes) -> tuple[list[tuple[str]], int]:
    """The complete lines of raw (one carriage return before a line feed goes), and how many bytes they took."""
    end = raw.rfind(b"\n") + 1
    lines = raw[:end].split(b"\n")[:-1]
    return [((x[:-1] if x.endswith(b"\r") else x).decode("utf-8", "replace"),) for x in lines], end


class _FileReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, take: int):
        self.path, self.take = path, take

    def initialOffset(self) -> dict:
        return {"file": 0, "at": 0}

    def _bytes(self, at: int, most: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(at)
            return f.read(most)

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        try:
            now = os.stat(self.path)
        except FileNotFoundError:  # not there yet, or between two rotations
            return iter(()), start
        at = start["at"] if start["file"] == now.st_ino and now.st_size >= start["at"] else 0  # rotated or cut: from its beginning
        raw = self._bytes(at, self.take)
        lines, took = whole_lines(raw)
        if not took and len(raw) >= self.take:  # a line longer than a batch is passed on in pieces
            lines, took = [(raw.decode("utf-8", "replace"),)], len(raw)
        return iter(lines), {"file": now.st_ino, "at": at + took}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        """The same lines again, after a restart, while the file is still the same."""
        at = start["at"] if start["file"] == end["file"] and start["at"] <= end["at"] else 0
        try:
            same = os.stat(self.path).st_ino == end["file"]
        except FileNotFoundError:
            same = False
        raw = self._bytes(at, end["at"] - at) if same else b""
        return iter(whole_lines(raw)[0] if raw[-1:] == b"\n" or not raw else [(raw.decode("utf-8", "replace"),)])


class FollowedFile(DataSource):
    """A file that grows, is rotated or appears later. Options: path, take (bytes of a batch at most)."""

    @classmethod
    def name(cls) -> str:
        return "followed_file"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _FileReader(self.options["path"], int(self.options.get("take", TAKE)))


class _PipeReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, take: int):
        self.path, self.take, self.held, self.pipe = path, take, b"", -1

    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        if self.pipe < 0:
            self.pipe = os.open(self.path, os.O_RDONLY | os.O_NONBLOCK)  # without waiting for a writer
        got = []
        while sum(map(len, got)) < self.take:
            try:
                part = os.read(self.pipe, 1 << 16)
            except BlockingIOError:
                break
            if not part:  # the writer left: what it held is a line, and the next writer is awaited
                if self.held or got:
                    got.append(b"" if (got or [self.held])[-1].endswith(b"\n") else b"\n")
                break
            got.append(part)
        raw = self.held + b"".join(got)
        lines, took = whole_lines(raw)
        self.held = raw[took:]
        return iter(lines), {"bytes": start["bytes"] + took}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        return iter(())  # a pipe's bytes can be read once; the running stream keeps a batch's rows itself


class NamedPipe(DataSource):
    """Lines of a named pipe, across writers that come and go. Options: path, take."""

    @classmethod
    def name(cls) -> str:
        return "named_pipe"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PipeReader(self.options["path"], int(self.options.get("take", TAKE)))
