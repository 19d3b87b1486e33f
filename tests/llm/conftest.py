import duckdb
import pytest

from tools.check import TABLES, norm


@pytest.fixture(scope="session")
def same_as_sql():
    def check(df, sql, folder):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        res = con.execute(sql)
        cols = [c[0] for c in res.description]
        key = sorted(cols)
        assert sorted(df.columns) == key
        ours = sorted(tuple(norm(r[c]) for c in key) for r in (x.asDict() for x in df.collect()))
        assert ours == sorted(tuple(norm(r[cols.index(c)]) for c in key) for r in res.fetchall())
    return check


#: Columns whose names the operators use inside.
CLASH = "size long, row_key string, node string, n long, h string, place int, kind string, shard int, component long, taken long, bucket int, label string, tokens string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows and columns of clashing names."""
    long_text = " ".join(f"w{i * 7919 % 40_013}" for i in range(60_000))
    base = "the quick brown fox jumps over the lazy dog while seven grey geese fly south across a cold blue lake at dawn today"
    rows = [(None, None, None), (None, base, "a"), (0, "", "a"), (1, " \t\n\r ", None), (2, base, "a"), (2, base, "a"), (3, base, "b"), (3, "other " + base, "b"),
            (4, long_text, "b"), (5, "one", "c"), (6, "one two three", "c"), (7, base + " indeed\n" + base, None), (8, None, "c"), (9, "\U0001F600 é ß\n\x01 x", "a"), (10, "one two three", "d")]
    fields = [x.split()[0] for x in CLASH.split(", ")]
    return spark.createDataFrame([(*r, *[None] * len(fields)) for r in rows], f"doc_id long, text string, source string, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("doc_id = -1")
