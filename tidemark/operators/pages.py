"""Copying a table page by page in key order, stopped and resumed at will, with a count check at the end."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of so many pages are looked for in one pass over what is left; a longer table gets more passes, not more memory.
AHEAD = 1000


class CountMismatch(RuntimeError):
    """What was pushed is not what the source held."""


@dataclasses.dataclass
class Progress:
    page: int = -1
    last: int | str | None = None
    pushed: int = 0
    counted: int | None = None


class KeysetPages:
    """Rows past `after` in pages of about `rows` rows by key. Each page is a filter with two literal bounds, which reach the scan, so Parquet skips the
    row groups of other pages; rows of one key are never split. Progress is written after each page. A page that was written but not yet
    recorded is pushed again under the same number, so `sink` should replace what that number held."""

    def __init__(self, df: DataFrame, key: str, rows: int, progress: str, after: int | str | None = None):
        self.df, self.key, self.rows, self.folder, self.after, self.spark = df, key, rows, progress.rstrip("/"), after, df.sparkSession

    def progress(self) -> Progress:
        try:
            found = self.spark.read.text(f"{self.folder}/*").agg(F.max_by("value", F.from_json("value", "page long")["page"])).first()[0]
        except AnalysisException:
            found = None
        return Progress(**json.loads(found)) if found else Progress(last=self.after)

    def _record(self, p: Progress) -> None:
        self.spark.createDataFrame([(json.dumps(dataclasses.asdict(p)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/page={p.page}")

    def _left(self, last) -> DataFrame:
        return self.df.filter(F.col(self.key).isNotNull() if last is None else F.col(self.key) > F.lit(last))

    def bounds(self, last) -> Iterator:
        """Last keys of the pages after `last`, in order."""
        while True:
            left = self._left(last)
            n, top = left.agg(F.count("*"), F.max(self.key)).first()
            if not n:
                return
            pages = min(AHEAD, -(-n // self.rows))
            share = [min(1.0, self.rows * (i + 1) / n) for i in range(pages)]
            if isinstance(top, str):  # quantiles are of numbers; a string key takes the key at the page's end
                cuts = [left.orderBy(self.key).limit(self.rows).agg(F.max(self.key)).first()[0]]
            else:
                cuts = sorted(set(left.agg(F.percentile_approx(self.key, share, 100_000)).first()[0]))
            yield from cuts
            last = cuts[-1]
            if last == top:
                return

    def pages(self, last=None) -> Iterator[tuple[object, DataFrame]]:
        """(last key, rows in key order) of each page past `last`."""
        for high in self.bounds(last):
            rows = self._left(last).filter(F.col(self.key) <= F.lit(high))
            yield high, rows.orderBy(self.key)
            last = high

    def push(self, sink: Callable[[DataFrame, int], int]) -> int:
        """Push what is left; `sink` takes a page and its number and returns how many rows it has stored. Rows in all, which must be as many as the source
        held when the copy began."""
        p = self.progress()
        if p.counted is None:
            p.counted = self._left(self.after).count()
        for high, rows in self.pages(p.last):
            p = Progress(p.page + 1, high, p.pushed + sink(rows, p.page + 1), p.counted)
            self._record(p)
        if p.pushed != p.counted:
            raise CountMismatch(f"{p.pushed} rows of {p.counted} were pushed")
        return p.pushed
