"""Which rows a dashboard query reads."""
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

DIMS = ["region", "tier", "product_family", "partner_type"]


class Selection:
    """Wanted values by dimension, and a span of quarters. A dimension that is not named, or named without values, takes all of its rows.

    Conditions are plain comparisons of columns, so a table partitioned by quarter or dimension reads only the partitions that match."""

    def __init__(self, first: str | None = None, last: str | None = None, **wanted: Iterable[str]):
        unknown = set(wanted) - set(DIMS)
        if unknown:
            raise ValueError(f"no such dimension: {sorted(unknown)}")
        self.first, self.last = first or None, last or None
        self.wanted = {d: tuple(dict.fromkeys(v)) for d, v in wanted.items() if v}

    @staticmethod
    def of(request: Mapping[str, str | None]) -> "Selection":
        """From a request's texts: lists separated by commas under the dimensions' names, quarters under `from` and `to`. Blanks do not count."""
        lists = {d: [v.strip() for v in (request.get(d) or "").split(",")] for d in DIMS}
        return Selection((request.get("from") or "").strip(), (request.get("to") or "").strip(), **{d: [v for v in vs if v] for d, vs in lists.items()})

    def values(self, dimension: str) -> tuple[str, ...]:
        return self.wanted.get(dimension, ())

    def narrows(self, *dimensions: str) -> bool:
        return any(d in self.wanted for d in dimensions)

    def dated(self) -> Column:
        q, out = F.col("quarter"), F.lit(True)
        for bound, inside in ((self.first, q >= F.lit(self.first)), (self.last, q <= F.lit(self.last))):
            out = out & inside if bound else out
        return out

    def rows(self, frame: DataFrame, dated: bool = False) -> DataFrame:
        """Rows of `frame` with wanted values in those dimensions that it has, and of the span if `dated`."""
        for d, values in self.wanted.items():
            if d in frame.columns:
                frame = frame.where(F.col(d).isin(list(values)))
        return frame.where(self.dated()) if dated else frame
