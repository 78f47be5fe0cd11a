"""A mirror that publishes all rows as one text and tells whether it has changed.

``spark.dataSource.register(MirrorLines)``, then format ``mirror_lines`` with the option
``adapter`` (``module:Class``) and its own.  An adapter has ``version()``, a token that changes
with the text, and ``fetch(known)``, which gives ``(token, text)``, with None for the text where the
mirror is still at the known token.  Unchanged is not empty: it makes no batch.  A text of fewer
than ``LEAST`` rows is refused, since a mirror that has moved must not replace good data.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .paged import adapter

#: Fixed value: rows that a mirror has at least.
LEAST = 100
LINES = "version string, line bigint, value string"


class FileMirror:
    """A file that all executors see; its token is a digest of its content."""

    def __init__(self, options: dict):
        self.path = Path(options["path"])

    def version(self) -> str:
        return hashlib.sha256(self.path.read_bytes()).hexdigest()

    def fetch(self, known: str | None) -> tuple[str, str | None]:
        data = self.path.read_bytes()
        token = hashlib.sha256(data).hexdigest()
        return token, None if token == known else data.decode()


def plausible(text: str) -> Iterator[tuple[int, str]]:
    """``line, value`` of the lines that are not blank; too few JSON objects among them are an error."""
    lines = [(i, x.strip()) for i, x in enumerate(text.split("\n")) if x.strip()]

    def is_row(value: str) -> bool:
        try:
            return isinstance(json.loads(value), dict)
        except ValueError:
            return False

    found = sum(is_row(x) for _, x in lines)
    if found < LEAST:
        raise ValueError(f"the mirror has {found} rows, fewer than {LEAST}")
    return iter(lines)


class Version(InputPartition):
    def __init__(self, known: str | None):
        super().__init__(known)
        self.known = known


def _read(options: dict, part: Version) -> Iterator[tuple]:
    # a batch that was planned for a version that is gone takes the one there is, so that a refused text does not stop the
    # stream for ever; that version then comes once more by itself, which a merge by key does not mind
    token, text = adapter(options).fetch(part.known)
    return ((token, i, x) for i, x in plausible(text)) if text is not None else iter(())


class MirrorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Version(self.options.get("known"))]

    def read(self, partition: Version) -> Iterator[tuple]:
        return _read(self.options, partition)


class MirrorStream(DataSourceStreamReader):
    """A batch is the whole text of a new version; the offset holds its token."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": self.options.get("known", "")}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": adapter(self.options).version()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [] if start["version"] == end["version"] else [Version(start["version"] or None)]

    def read(self, partition: Version) -> Iterator[tuple]:
        return _read(self.options, partition)


class MirrorLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mirror_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return MirrorReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return MirrorStream(dict(self.options))
