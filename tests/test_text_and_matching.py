import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import text as tx
from tidemark.operators import factors, matching, terms


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_bit_rows_match_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert matching.lcs_len(a, b) == slow_lcs(a, b)


def test_partial_match_equals_brute_force():
    rng = random.Random(5)
    t = "the whole site is affected"

    def brute(template, text):
        short, long = sorted((template, text), key=len)
        m = len(short)
        return any(200.0 * slow_lcs(short, w) / (m + len(w)) >= 90 for w in (long[max(i, 0):i + m] for i in range(1 - m, len(long))) if w)

    for _ in range(60):
        s = list("we think " + t + " since noon")
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(s))
            s[k] = rng.choice(["", "x", s[k] * 2])
        s = "".join(s)
        assert matching.partial_match(t, s, 90) == brute(t, s), s


def test_severity_forgives_typing_errors(spark):
    rows = {"[Customer-selected severity: hgih] x": "HIGH", "Sev: critcal": "CRITICAL", "severity : lo": "LOW", "severity: banana": "UNK", "none here": "NONE", "": "NONE"}
    df = spark.createDataFrame([(k,) for k in rows], "body string").withColumn("s", tx.severity(F.col("body")))
    assert {r["body"]: r["s"] for r in df.collect()} == rows


def test_sentences_and_edits(spark):
    df = spark.createDataFrame([("[Customer-selected severity: Low] Only one user is affected. Mail a@b.c about box-12x now! 3 items",)], "body string")
    got = df.select(tx.sentences(F.col("body")).alias("s"), tx.edit("scope_up", F.col("body")).alias("up"), tx.edit("tag_low_to_critical", F.col("body")).alias("tag"),
                    tx.edit("tag_add_critical", F.col("body")).alias("add"), tx.edit("tone_only", F.col("body")).alias("tone")).first()
    assert got["s"] == ["customer-selected severity: low", "only one user is affected", "mail <email> about <id> now", "<num> items"]
    assert "All customers on the platform see this. Mail" in got["up"] and got["add"] is None
    assert got["tag"].startswith("[Customer-selected severity: Critical] Only") and got["tone"].endswith("3 items This is unacceptable.")


def test_fuzzy_vocabulary_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = ["the printer is down again", "please reset my password", "disk array reports an error", "no route to the host"]
    texts = set(vocab[:2])
    for v in vocab:
        for _ in range(12):
            s = list(v)
            for _ in range(rng.randint(1, 6)):
                s[rng.randrange(len(s))] = rng.choice("abcxyz")
            texts.add("".join(s))
    got = {r["text"]: r["entry"] for r in matching.fuzzy_vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"),
                                                                     spark.createDataFrame([(v,) for v in vocab], "text string"), rows=7).collect()}
    want = {}
    for t in texts:
        best = max(vocab, key=lambda v: (200.0 * slow_lcs(t, v) / (len(t) + len(v)), [-ord(c) for c in v]))
        if 200.0 * slow_lcs(t, best) / (len(t) + len(best)) >= 90:
            want[t] = best
    assert got == want


def test_max_cosine_over_blocks(spark):
    rng = np.random.default_rng(0)
    q, c = rng.random((30, 12)) * (rng.random((30, 12)) < 0.4), rng.random((41, 12)) * (rng.random((41, 12)) < 0.4)
    def rows(m):
        return [(i, [int(j) for j in np.flatnonzero(r)], [float(r[j]) for j in np.flatnonzero(r)]) for i, r in enumerate(m)]
    schema = "id long, terms array<long>, ws array<double>"
    got = matching.max_cosine(spark.createDataFrame(rows(q), schema), spark.createDataFrame(rows(c), schema), "id", rows=9).toPandas().sort_values("id")
    assert np.allclose(got["sim"], (q @ c.T).max(axis=1))


def test_term_weights_by_hand(spark):
    docs = spark.createDataFrame([(1, "red apple red"), (2, "red pear"), (3, "green apple")], "ticket_id long, t string")
    c = terms.word_counts(docs, "ticket_id", F.col("t"))
    v = terms.vocabulary(c, 2, 10)
    w = terms.weights(c, v, docs, "ticket_id").toPandas()
    assert set(v.toPandas()["term"]) == {"red", "apple"}
    one = w[w["ticket_id"] == 1].set_index("term")["weight"]
    idf = np.log(4 / 3) + 1
    raw = np.array([(1 + np.log(2)) * idf, idf])
    assert np.allclose([one["red"], one["apple"]], raw / np.sqrt((raw ** 2).sum()))


def test_char_grams_of_short_words(spark):
    docs = spark.createDataFrame([(1, "a abcd")], "ticket_id long, t string")
    got = set(terms.char_counts(docs, "ticket_id", F.col("t")).toPandas()["term"])
    assert got == {" a ", " ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd "}


def test_factor_tags(spark):
    rows = [("All customers on the platform see this. r u there", "wide"), ("several vms on it are affectd.", "few"), ("nothing to see", "unknown"), ("", "unknown")]
    got = factors.tag(spark.createDataFrame([(b,) for b, _ in rows], "body string")).select("body", "scope", "severity_tag").collect()
    assert [r["scope"] for r in got] == [s for _, s in rows] and {r["severity_tag"] for r in got} == {"none"}
    assert set(fv.FACTOR_LEVELS) == {"scope", "environment", "workaround", "severity_tag", "urgency_claim", "deescalation"}


def test_calendar_edges(spark):
    from tidemark.functions import calendar as cal
    df = spark.createDataFrame([("2000-Q1",), ("1999-Q4",)], "q string").select("q", cal.shift_quarter(F.col("q"), -1).alias("b"), cal.shift_quarter(F.col("q"), 5).alias("f"), cal.quarter_end(F.col("q")).alias("e"))
    got = {r["q"]: (r["b"], r["f"], str(r["e"])) for r in df.collect()}
    assert got == {"2000-Q1": ("1999-Q4", "2001-Q2", "2000-03-31"), "1999-Q4": ("1999-Q3", "2001-Q1", "1999-12-31")}
    assert pd.Timestamp(cal.qend("2000-Q1")) == pd.Timestamp("2000-03-31")
