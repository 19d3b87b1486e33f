"""One entry per query: the Spark callable, the SQL twin where SQL can express it, and the inventory rows it covers."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rows: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Decimals and doubles to rounded doubles, small integers to long: the same types on both engines. Doubles are scaled, rounded and
    scaled back, as the twins' engine does; rounding their decimal digits can fall on the other side of a half."""
    unit = 10.0 ** digits
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.DecimalType, T.FloatType)):
            c = F.round(c.cast("double") * unit) / unit
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, rows: str, sql: str | None = None, dbl: str = "", big: str = "", digits: int = 6):
    """Register a query. `dbl` and `big` name the columns of the SQL twin to round and to cast."""
    if sql is not None:
        fixes = ([f'round(CAST("{c}" AS DOUBLE), {digits}) AS "{c}"' for c in dbl.split()]
                 + [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in big.split()])
        if fixes:
            sql = f"SELECT * REPLACE ({', '.join(fixes)}) FROM ({sql}) AS twin"

    def wrap(fn):
        REGISTRY[name] = Entry(name, lambda spark, sf: tidy(fn(spark, sf), digits), sql, tuple(rows.split()))
        return fn
    return wrap
