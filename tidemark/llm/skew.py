"""Lookups whose keys may be very unevenly used."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, weight: str, share: int = 1000, how: str = "left") -> DataFrame:
    """`rows` joined to `lookup` on `key`; `lookup` has one row a key and, in `weight`, how many rows of `rows` hold it.

    Keys that hold more than one row in `share` are fewer than `share`, whatever the data, and are broadcast; the others are shuffled, and
    none of them weighs much. Pass written tables: both are read twice. Null keys match nothing."""
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    often = F.col(weight) * share > F.lit(total)
    hot = F.broadcast(lookup.where(often).drop(weight))
    names = [*rows.columns, *(c for c in lookup.columns if c not in (key, weight))]
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).select(*names).unionByName(rest.join(lookup.where(~often).drop(weight), key, how).select(*names))
