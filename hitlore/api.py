"""One object for a stored log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hitlore import sinks
from hitlore.filterlang import where
from hitlore.operators import merge, reqfeatures, views
from hitlore.schema import BLOCK_ROWS
from hitlore.sources import entries


@dataclass(frozen=True)
class Log:
    rows: DataFrame
    block_rows: int = BLOCK_ROWS

    @classmethod
    def open(cls, spark: SparkSession, path: str, block_rows: int = BLOCK_ROWS) -> Log:
        return cls(sinks.read_blocks(spark, path), block_rows)

    @classmethod
    def from_json_lines(cls, spark: SparkSession, path: str, block_rows: int = BLOCK_ROWS) -> Log:
        from hitlore.operators.positions import numbered

        read = entries.stored_rows(entries.json_lines(spark, path))
        return cls(numbered(read, ["file_path", "file_block", "seq"]).drop("file_path", "file_block", "seq"), block_rows)

    @classmethod
    def merged(cls, logs: Sequence[Log], block_rows: int = 100_000) -> Log:
        return cls(merge.merge_logs([log.rows for log in logs], block_rows=block_rows), block_rows)

    def write(self, path: str, mode: str = "errorifexists") -> None:
        sinks.write_blocks(self.rows, path, block_rows=self.block_rows, mode=mode)

    def filter(self, f, now: int | None = None) -> DataFrame:
        return where(self.rows, f, now=now)

    def page(self, rows: int = 20, start: int = 0) -> views.Page:
        return views.Page(self.rows, rows, start)

    def filtered(self, f=None, rows: int = 20, start: int = 0, now: int | None = None) -> views.FilteredPage:
        return views.FilteredPage(self.rows, f, rows, start, now)

    def get(self, position: int) -> DataFrame:
        return views.row_at(self.rows, position)

    def fetch_range(self, first: int, beyond: int) -> DataFrame:
        return views.between(self.rows, first, beyond)

    def tail(self, backlog: int = 1000) -> DataFrame:
        return views.with_backlog(self.rows, self.block_rows, backlog)

    def sync(self, backlog: int = 1000) -> DataFrame:
        return views.sync(self.rows, self.block_rows, backlog)

    def features(self, known: reqfeatures.Known = reqfeatures.Known(), *, ordered: bool = False) -> DataFrame:
        return reqfeatures.features(self.rows, known, ordered=ordered)

    def answer(self, command, backlog: int = 1000) -> tuple[str, DataFrame | str | None]:
        """The reply to a subscriber's command: its kind, and the rows or the reason.

        {"SubScribeWithBacklog": {"backlog": n}} gives Attached and the rows from n before the open block on; {"FetchRange":
        {"start": a, "end": b}} gives Rows; "Detach" gives Detached; anything else, and a range that is none, gives Error.
        """
        match command:
            case "Detach":
                return "Detached", None
            case {"SubScribeWithBacklog": {"backlog": int(n)}} if n >= 0:
                return "Attached", self.tail(n)
            case {"FetchRange": {"start": int(a), "end": int(b)}} if 0 <= a <= b:
                return "Rows", self.fetch_range(a, b)
            case _:
                return "Error", f"no such command: {command!r}"
