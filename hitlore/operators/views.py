"""Pages over a log: by position, and of the rows a filter keeps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlore import filterlang


def end(log: DataFrame) -> int:
    """One more than the largest position; 0 for an empty log."""
    return log.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("e")).first().e


def row_at(log: DataFrame, position: int) -> DataFrame:
    return log.where(F.col("position") == position)


def between(log: DataFrame, first: int, beyond: int, *, descending: bool = False) -> DataFrame:
    """Rows with first <= position < beyond in the order of positions; positions that are not stored are passed over."""
    rows = log.where((F.col("position") >= first) & (F.col("position") < beyond))
    return rows.orderBy(F.desc("position") if descending else F.asc("position"))


@dataclass(frozen=True)
class Page:
    """`rows` rows from position `start`. Moving gives another page and whether the end is reached."""

    log: DataFrame
    rows: int = 20
    start: int = 0

    def render(self) -> DataFrame:
        return between(self.log, self.start, self.start + self.rows)

    def scroll_to(self, position: int) -> tuple[Page, bool]:
        last = max(end(self.log) - self.rows, 0)
        return replace(self, start=min(max(position, 0), last)), position >= last

    def scroll_by(self, n: int) -> tuple[Page, bool]:
        return self.scroll_to(self.start + n)

    def scroll_to_end(self) -> Page:
        return replace(self, start=max(end(self.log) - self.rows, 0))


@dataclass(frozen=True)
class FilteredPage:
    """The first `rows` rows at or after `start` that a filter keeps.

    Every read is a bounded, ordered limit: Spark keeps the first rows of each partition and merges those, so no sort of the
    log takes place. It looks through windows of positions that double, and stops at the first that makes the page full: a
    page of a huge log reads no more than about twice the rows it has to. `now` fixes what relative times refer to.
    """

    log: DataFrame
    filter: object = None
    rows: int = 20
    start: int = 0
    now: int | None = None
    window: int = 1_000_000

    def matching(self) -> DataFrame:
        return filterlang.where(self.log, self.filter, now=self.now)

    def set_filter(self, f) -> FilteredPage:
        return replace(self, filter=f)

    def ahead(self, n: int) -> DataFrame:
        """The first n matches at or after the start."""
        at, size, found, rows = self.start, self.window, 0, self.matching()
        while True:
            found += rows.where((F.col("position") >= at) & (F.col("position") < at + size)).limit(n - found).count()
            at, size = at + size, size * 2
            if found >= n or at >= end(self.log):
                return first(rows.where(F.col("position") < at), self.start, n)

    def behind(self, n: int, beyond: int) -> DataFrame:
        """The last n matches before `beyond`."""
        at, size, found, rows = beyond, self.window, 0, self.matching().where(F.col("position") < beyond)
        while found < n and at > 0:
            if size >= at:
                return last(rows, n)  # one more window is all there is
            found += rows.where((F.col("position") >= at - size) & (F.col("position") < at)).limit(n - found).count()
            at, size = at - size, size * 2
        return last(rows.where(F.col("position") >= at), n)

    def render(self) -> DataFrame:
        return self.ahead(self.rows)

    def next(self, n: int) -> DataFrame:
        """The next n matches after the page."""
        shown = self.render().agg(F.max("position").alias("p")).first().p
        return replace(self, start=(shown if shown is not None else self.start - 1) + 1).ahead(n)

    def scroll_by(self, n: int) -> tuple[FilteredPage, bool]:
        """Moves the page by n matches, backwards for a negative n; True if the log has no more in that direction."""
        if n >= 0:
            ahead = [r.position for r in self.ahead(self.rows + n).select("position").collect()]
            moved = ahead[max(len(ahead) - self.rows, 0) :]
            return replace(self, start=moved[0] if moved else self.start), len(ahead) < self.rows + n
        back = self.behind(-n, self.start).agg(F.min("position").alias("p"), F.count(F.lit(1)).alias("n")).first()
        return replace(self, start=back.p if back.n == -n else 0), back.n < -n

    def scroll_to_end(self) -> FilteredPage:
        start = self.behind(self.rows, end(self.log)).agg(F.min("position").alias("p")).first().p
        return replace(self, start=0 if start is None else start)

    def windows(self, block_rows: int = 10_000) -> Iterator[DataFrame]:
        """The matches from `start` in windows of doubling size, for a reader that stops early: a sparse filter over a huge
        log reads no more blocks than it has to."""
        at, size, beyond = self.start, block_rows, end(self.log)
        while at < beyond:
            yield between(self.matching(), at, at + size)
            at, size = at + size, size * 2


def first(rows: DataFrame, start: int, n: int) -> DataFrame:
    """The first n rows at or after start."""
    return rows.where(F.col("position") >= start).orderBy("position").limit(n)


def last(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows, in ascending order."""
    return rows.orderBy(F.desc("position")).limit(n).orderBy("position")


# Replay ---------------------------------------------------------------------------------------------------------------
def sync(log: DataFrame, block_rows: int, backlog: int) -> DataFrame:
    """One row for a new subscriber: start of the open block, block_size, first_block, first_backlog."""
    open_block = F.col("e") - F.col("e") % block_rows
    return log.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("e")).select(
        open_block.cast("long").alias("start"),
        F.lit(block_rows).cast("long").alias("block_size"),
        F.lit(0).cast("long").alias("first_block"),
        F.greatest(open_block - backlog, F.lit(0)).cast("long").alias("first_backlog"),
    )


def with_backlog(log: DataFrame, block_rows: int, backlog: int) -> DataFrame:
    """The rows of the open block and at least `backlog` rows before it: whole blocks from the one that holds the first."""
    e = end(log)
    start = e - e % block_rows
    return between(log, max(start - backlog, 0), e)
