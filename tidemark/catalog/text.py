"""Intake, text-feature and matching queries over all documents."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..operators import factors, intake, matching, terms
from ..sources.fixtures import CHANNELS, KNOWN_PRODUCTS, PRIORITIES, Desk
from ..session import cut_lineage
from .prelude import CTES, cte, define
from .registry import query

KNOWN = ", ".join(f"'{p}'" for p in KNOWN_PRODUCTS)


@query("model_text", "PRJ-09", cte("inbox") + """
SELECT ticket_id, md5('CHANNEL_' || channel || ' PRODUCT_' || replace(product, ' ', '_') || ' ' || coalesce(subject, '') || ' ' || coalesce(body, '')) AS digest FROM inbox""")
def model_text(spark, sf):
    return Desk(spark, sf).inbox.select("ticket_id", F.md5(tx.ticket_text()).alias("digest"))




SEV_SQL = """WITH RECURSIVE """ + cte("inbox")[5:] + """,
w AS (SELECT DISTINCT lower(regexp_extract(body, '(?i)sev\\w*\\s*:\\s*([a-z]+)', 1)) AS word FROM inbox),
lv AS (SELECT unnest(['low', 'medium', 'high', 'critical']) AS level, unnest([0, 1, 2, 3]) AS pos),
lcs AS (SELECT word, level, 0 AS i, list_transform(range(1, length(level) + 1), lambda x: 0) AS r FROM w CROSS JOIN lv WHERE word <> ''
  UNION ALL SELECT word, level, i + 1, list_transform(range(1, length(level) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
     greatest(r[k], CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END + CAST(level[k] = word[i + 1] AS INT))))) FROM lcs WHERE i < length(word)),
s AS (SELECT l.word, l.level, pos, 200.0 * r[length(l.level)] / (length(l.word) + length(l.level)) AS score FROM lcs l JOIN lv USING (level) WHERE i = length(l.word)),
b AS (SELECT word, CASE WHEN max(score) >= 60 THEN upper(arg_min(level, -score * 10 + pos)) ELSE 'UNK' END AS sev FROM s GROUP BY 1)
"""


@query("severity_tokens", "PRJ-10", SEV_SQL + """SELECT ticket_id, coalesce(sev, 'NONE') AS severity FROM inbox LEFT JOIN b ON b.word = lower(regexp_extract(body, '(?i)sev\\w*\\s*:\\s*([a-z]+)', 1))""")
def severity_tokens(spark, sf):
    return Desk(spark, sf).inbox.select("ticket_id", tx.severity(F.col("body")).alias("severity"))


@query("severity_crosstab", "AG-12 PRJ-10", SEV_SQL + """, x AS (SELECT channel, coalesce(sev, 'NONE') AS severity FROM inbox LEFT JOIN b ON b.word = lower(regexp_extract(body, '(?i)sev\\w*\\s*:\\s*([a-z]+)', 1)))
SELECT severity, count(*) FILTER (channel = 'email') AS email, count(*) FILTER (channel = 'portal') AS portal, count(*) FILTER (channel = 'chat') AS chat, count(*) AS total,
  CAST(count(*) FILTER (channel = 'portal') AS DOUBLE) / count(*) AS portal_share FROM x GROUP BY 1""", dbl="portal_share")
def severity_crosstab(spark, sf):
    x = Desk(spark, sf).inbox.select("channel", tx.severity(F.col("body")).alias("severity"))
    return x.groupBy("severity").agg(*[F.count_if(F.col("channel") == c).alias(c) for c in CHANNELS], F.count(F.lit(1)).alias("total"),
                                     F.avg((F.col("channel") == "portal").cast("int")).alias("portal_share"))


@query("body_without_tag", "PRJ-11", cte("inbox") + """
SELECT ticket_id, md5(trim(regexp_replace(body, '(?i)^\\s*\\[Customer-selected severity:[^\\]]*\\]\\s*', ''), ' ')) AS digest FROM inbox""")
def body_without_tag(spark, sf):
    return Desk(spark, sf).inbox.select("ticket_id", F.md5(tx.body_content(F.col("body"))).alias("digest"))


define("sents", "inbox", r"""
SELECT ticket_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(s), '\S+@\S+', '<email>', 'g'),
   '(^|[^\p{L}\p{N}_])[a-z]+[-_][a-z0-9-]*\d[a-z0-9-]*($|[^\p{L}\p{N}_])', '\1<id>\2', 'g'), '(^|[^\p{L}\p{N}_])[a-z]+\.[a-z]+($|[^\p{L}\p{N}_])', '\1<user>\2', 'g'),
   '\d+(?:[.:,/x-]\d+)*', '<num>', 'g'), '\s+', ' ', 'g'), ' .,;:!?"''[]()') AS sentence
FROM (SELECT ticket_id, unnest(string_split(regexp_replace(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), '\]\s*', chr(1), 'g'), chr(1))) AS s FROM inbox)""")


@query("normalised_sentences", "PRJ-12", cte("sents") + "SELECT ticket_id, count(*) AS sentences, count(DISTINCT sentence) AS distinct_sentences, sum(length(sentence)) AS characters FROM sents WHERE sentence <> '' GROUP BY 1", big="characters")
def normalised_sentences(spark, sf):
    s = Desk(spark, sf).inbox.select("ticket_id", F.explode(tx.sentences(F.col("body"))).alias("sentence"))
    return s.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("sentences"), F.countDistinct("sentence").alias("distinct_sentences"), F.sum(F.length("sentence")).alias("characters"))


@query("template_sentences", "AG-14", cte("sents") + "SELECT sentence, count(DISTINCT ticket_id) AS tickets FROM sents WHERE sentence <> '' GROUP BY 1 HAVING count(DISTINCT ticket_id) >= 5")
def template_sentences(spark, sf):
    return intake.template_sentences(Desk(spark, sf).inbox, 5)


@query("template_class_shares", "AG-14", cte("sents", "tickets") + """,
t AS (SELECT sentence, count(DISTINCT ticket_id) AS tickets FROM sents WHERE sentence <> '' GROUP BY 1 HAVING count(DISTINCT ticket_id) >= 5 ORDER BY 2 DESC, 1 LIMIT 30),
x AS (SELECT DISTINCT s.ticket_id, t.sentence, t.tickets FROM sents s JOIN t USING (sentence))
SELECT sentence, tickets, """ + ", ".join(f"avg(CAST(coalesce(priority, '') = '{p}' AS INT)) AS {p}" for p in PRIORITIES) + " FROM x LEFT JOIN tickets k USING (ticket_id) GROUP BY 1, 2", dbl="P1 P2 P3 P4")
def template_class_shares(spark, sf):
    d = Desk(spark, sf)
    docs = d.inbox.join(d.tickets.select("ticket_id", "priority"), "ticket_id", "left").withColumn("priority", F.coalesce("priority", F.lit("")))
    return intake.template_class_shares(docs, intake.template_sentences(d.inbox, 5), "priority", PRIORITIES)


_B = r"(^|[^\p{L}\p{N}_])"
_E = r"($|[^\p{L}\p{N}_])"


def _word(expr: str, a: str, b: str) -> str:
    def one(x: str) -> str:
        return f"regexp_replace({x}, '{_B}{a}{_E}', '\\1{b}\\2', 'g')"
    return one(one(expr))  # twice: neighbours share the character between them


_slang = "lower(body)"
for _a, _b in (("r", "are"), ("tmrw", "tomorrow"), ("u", "you")):
    _slang = _word(_slang, _a, _b)
_slang = f"regexp_replace({_slang}, '{_B}w/', '\\1with ', 'g')"
_slang = _word(_slang, "pls", "please")


@query("slang_expanded", "PRJ-13", cte("inbox") + f"SELECT ticket_id, md5(regexp_replace({_slang}, '\\s+', ' ', 'g')) AS digest FROM inbox")
def slang_expanded(spark, sf):
    return Desk(spark, sf).inbox.select("ticket_id", F.md5(tx.expand_slang(F.col("body"))).alias("digest"))


@query("intake_canonical", "PRJ-14", cte("inbox") + """
SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, channel, CASE WHEN product IN (""" + KNOWN + """) THEN upper(substr(product, 1, 1)) || substr(product, 2) ELSE product END AS product, length(body) AS body_chars FROM inbox""", big="body_chars")
def intake_canonical(spark, sf):
    """Odd spellings of channel and product are folded back to the listed ones."""
    odd = Desk(spark, sf).inbox.withColumns({"channel": F.concat(F.lit(" "), F.upper("channel")), "product": F.concat(F.upper("product"), F.lit("  "))})
    listed = [p.capitalize() for p in KNOWN_PRODUCTS]
    x = intake.prepare(odd, listed).select("ticket_id", "channel", "product", F.length("body").alias("body_chars"))
    return x.withColumn("product", F.when(F.col("product").isin(listed), F.col("product")).otherwise(F.lower("product")))


@query("intake_checks", "SRC-03", cte("inbox") + """,
x AS (SELECT CASE WHEN length(body) < 60 THEN '' ELSE product END AS id, CASE WHEN product = 'src19' THEN 'fax' ELSE channel END AS channel FROM inbox),
e AS (SELECT string_agg(e, ', ' ORDER BY e) AS ex, any_value(n) AS n FROM (SELECT id AS e, count(*) OVER () AS n FROM (SELECT id FROM x WHERE id <> '' GROUP BY 1 HAVING count(*) > 1) ORDER BY 1 LIMIT 10)),
c AS (SELECT string_agg(e, ', ' ORDER BY e) AS ex, any_value(n) AS n FROM (SELECT id || '=' || channel AS e, count(*) OVER () AS n FROM x WHERE channel NOT IN ('email', 'portal', 'chat') ORDER BY 1 LIMIT 10)),
b AS (SELECT count(*) AS n FROM x WHERE id = '')
SELECT 'no rows' AS rule, 0 AS n, '' AS examples UNION ALL SELECT 'blank ticket_id', n, array_to_string(list_resize(CAST([] AS VARCHAR[]), least(n, 10), ''), ', ') FROM b
UNION ALL SELECT 'duplicate ticket_id', n, ex FROM e UNION ALL SELECT 'invalid channel', n, ex FROM c""")
def intake_checks(spark, sf):
    bad = Desk(spark, sf).inbox.withColumns({"ticket_id": F.when(F.length("body") < 60, "  ").otherwise(F.col("product")),
                                             "channel": F.when(F.col("product") == "src19", "FAX ").otherwise(F.upper("channel"))})
    return intake.check_batch(bad)


@query("guard_flags", "FLT-05", cte("inbox") + """
SELECT ticket_id, concat_ws(',', CASE WHEN product NOT IN (""" + KNOWN + """) THEN 'unknown_product' END,
  CASE WHEN length(trim(regexp_replace(body, '(?i)^\\s*\\[Customer-selected severity:[^\\]]*\\]\\s*', ''), ' ')) < 20 THEN 'short_body' END) AS flags FROM inbox""")
def guard_flags(spark, sf):
    return intake.guards(Desk(spark, sf).inbox, KNOWN_PRODUCTS).select("ticket_id", F.array_join("guard_flags", ",").alias("flags"))


@query("one_hot_channels", "PRJ-15", cte("inbox") + "SELECT ticket_id, " + " || ".join(f"CAST(CAST(channel = '{c}' AS INT) AS VARCHAR)" for c in ["email", "chat"]) + " AS bits FROM inbox")
def one_hot_channels(spark, sf):
    return Desk(spark, sf).inbox.select("ticket_id", F.array_join(tx.one_hot(F.col("channel"), ["email", "chat"]), "").alias("bits"))


@query("duplicate_documents", "AG-13", cte("inbox") + """,
g AS (SELECT text, count(*) AS n, count(DISTINCT lang || CAST(l.doc_id IS NULL AS VARCHAR)) AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1 HAVING count(*) > 1)
SELECT coalesce(sum(n), 0) AS rows_involved, count(*) AS groups, count(*) FILTER (k > 1) AS groups_spanning_splits FROM g""", big="rows_involved")
def duplicate_documents(spark, sf):
    """Copies among all documents; the labelled and the unlabelled part of a language act as splits."""
    d = Desk(spark, sf)
    x = d.table("documents").join(d.table("labels").select("doc_id", F.lit(1).alias("_l")), "doc_id", "left")
    return intake.duplicate_groups(x.select("text", F.concat("lang", F.col("_l").isNull().cast("string")).alias("split")), ["text"], "split")


@query("split_shares", "AG-11 SE-04", cte("inbox") + """,
x AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'open' ELSE 'labelled' END AS split, i.product, i.channel FROM inbox i LEFT JOIN labels l ON i.ticket_id = l.doc_id),
u AS (SELECT split, 'product' AS "column", product AS value FROM x UNION ALL SELECT split, 'channel', channel FROM x),
n AS (SELECT split, "column", value, count(*) AS n FROM u GROUP BY 1, 2, 3), a AS (SELECT "column", value, sum(n) AS n_all FROM n GROUP BY 1, 2), s AS (SELECT split, count(*) AS n_split FROM x GROUP BY 1)
SELECT s.split, a."column", a.value, CAST(n_all AS DOUBLE) / (SELECT count(*) FROM x) AS share_all, CAST(coalesce(n, 0) AS DOUBLE) / n_split AS share_split,
  (CAST(coalesce(n, 0) AS DOUBLE) / n_split - CAST(n_all AS DOUBLE) / (SELECT count(*) FROM x)) * 100 AS deviation_pp
FROM a CROSS JOIN s LEFT JOIN n ON n.split = s.split AND n."column" = a."column" AND n.value = a.value""", dbl="share_all share_split deviation_pp")
def split_shares(spark, sf):
    d = Desk(spark, sf)
    x = d.inbox.join(d.table("labels").select(F.col("doc_id").alias("ticket_id"), F.lit(1).alias("_l")), "ticket_id", "left")
    return intake.representativeness(x.withColumn("split", F.when(F.col("_l").isNull(), "open").otherwise("labelled")), "split", ["product", "channel"])


@query("stratified_split", "WN-13 SE-04")
def stratified_split(spark, sf):
    return intake.split_and_fold(Desk(spark, sf).tickets).select("ticket_id", "stratum", "split", "fold")


@query("split_leak_checks", "WN-13 SE-04")
def split_leak_checks(spark, sf):
    t = Desk(spark, sf).tickets
    return intake.split_checks(intake.split_and_fold(t), t)


@query("sample_per_class", "SO-08")
def sample_per_class(spark, sf):
    return intake.sample_per_class(Desk(spark, sf).tickets, "priority", "ticket_id", 75).select("ticket_id", "priority")


# ---------------------------------------------------------------- edits

_app = {"workaround": ("workaround|limping", "There is a manual workaround but it is slow."), "tone_only": ("unacceptable", "This is unacceptable."), "urgency_claim": ("urgent", "Marking this urgent.")}


def _re(ps):
    return "(?i)" + "|".join(f"(?:{p.rstrip('.').replace('.', chr(92) + '.')}\\.?)" for p in ps).replace("'", "''")


def _first(name, pat, text):
    return (f"SELECT ticket_id, '{name}' AS edit, substr(body, 1, strpos(body, h) - 1) || CASE WHEN h = lower(h) THEN lower('{text}') ELSE '{text}' END || substr(body, strpos(body, h) + length(h)) AS new "
            f"FROM (SELECT ticket_id, body, regexp_extract(body, '{pat}') AS h FROM inbox) WHERE h <> ''")


_TAG = r"(?i)\[[^\]]*sev\w*\s*:\s*(\w+)\]"


def _swap(name, start, to):
    return (f"SELECT ticket_id, '{name}' AS edit, substr(body, 1, strpos(body, h) - 1) || '[Customer-selected severity: {to}]' || substr(body, strpos(body, h) + length(h)) AS new "
            f"FROM (SELECT ticket_id, body, regexp_extract(body, '{_TAG}') AS h, lower(regexp_extract(body, '{_TAG}', 1)) AS lv FROM inbox) WHERE starts_with(lv, '{start}')")


EDIT_SQL = " UNION ALL ".join([
    _first("scope_up", _re(fv.LOW_SCOPE), fv.EDIT_TEXT["scope_up"]), _first("scope_down", _re(fv.HIGH_SCOPE), fv.EDIT_TEXT["scope_down"]),
    _first("environment_down", _re(fv.PRODUCTION) + "|(?:" + fv.PRODUCTION_PATTERN + ")", fv.EDIT_TEXT["environment_down"]),
    *[f"SELECT ticket_id, '{n}' AS edit, rtrim(body, ' ') || ' ' || CASE WHEN body = lower(body) THEN lower('{t}') ELSE '{t}' END AS new FROM inbox WHERE NOT regexp_matches(body, '(?i){p}')" for n, (p, t) in _app.items()],
    _swap("tag_low_to_critical", "lo", "Critical"), _swap("tag_critical_to_low", "cri", "Low"),
    f"SELECT ticket_id, 'tag_add_critical' AS edit, '[Customer-selected severity: Critical] ' || body AS new FROM inbox WHERE NOT regexp_matches(body, '{_TAG}')"])


@query("counterfactual_edits", "PRJ-21", cte("inbox") + f"SELECT ticket_id, edit, md5(new) AS digest FROM ({EDIT_SQL})")
def counterfactual_edits(spark, sf):
    from ..plans.experiments import edited_copies
    return edited_copies(Desk(spark, sf).inbox).select("ticket_id", "edit", F.md5("body").alias("digest"))


# ---------------------------------------------------------------- factors

def _factor_sql(f: str) -> str:
    arms = []
    for lvl, ts in fv.FACTOR_TEMPLATES[f].items():
        pats = []
        for t in ts:
            t2 = factors._regex(t)
            t2 = t2.replace(r"(?<![a-z])not urgent(?: at all)?(?![a-z])", r"(^|[^a-z])not urgent(?: at all)?($|[^a-z])")
            pats.append(f"(?:{t2})".replace("'", "''"))
        arms.append(f"WHEN regexp_matches(s, '{'|'.join(pats)}') THEN '{lvl}'")
    return f"CASE {' '.join(arms)} ELSE '{fv.FACTOR_DEFAULTS[f]}' END AS {f}"


_EXACT = [f for f in fv.FACTOR_TEMPLATES if f != "urgency_claim"]


@query("factor_tags_exact", "TX-09", cte("inbox") + f", s AS (SELECT ticket_id, regexp_replace({_slang}, '\\s+', ' ', 'g') AS s FROM inbox) SELECT ticket_id, " + ", ".join(_factor_sql(f) for f in _EXACT) + " FROM s")
def factor_tags_exact(spark, sf):
    return factors.exact_tags(Desk(spark, sf).inbox).select("ticket_id", *_EXACT)


@query("factor_tags", "TX-09 UD-03")
def factor_tags(spark, sf):
    return factors.tag(Desk(spark, sf).inbox).select("ticket_id", *fv.FACTOR_LEVELS)


@query("factor_coverage", "AG-15", cte("inbox") + f", s AS (SELECT ticket_id, regexp_replace({_slang}, '\\s+', ' ', 'g') AS s FROM inbox), t AS (SELECT " + ", ".join(_factor_sql(f) for f in _EXACT) + " FROM s), g AS ("
       + " UNION ALL ".join(f"SELECT '{f}' AS factor, '{lvl}' AS level, count(*) FILTER ({f} = '{lvl}') AS n FROM t" for f in _EXACT for lvl in fv.FACTOR_LEVELS[f])
       + ") SELECT factor, level, n, CAST(n AS DOUBLE) / (SELECT count(*) FROM t) AS share FROM g", dbl="share")
def factor_coverage(spark, sf):
    return factors.coverage(factors.exact_tags(Desk(spark, sf).inbox).select("ticket_id", *_EXACT))


# ---------------------------------------------------------------- terms

define("tok", "tickets", r"""
SELECT ticket_id, list_filter(regexp_extract_all(lower('CHANNEL_' || channel || ' PRODUCT_' || replace(product, ' ', '_') || ' ' || subject || ' ' || body), '[\p{L}\p{N}_]{2,}'), lambda x: true) AS w FROM tickets""")
define("wc", "tok", """
SELECT ticket_id, term, count(*) AS tf FROM (SELECT ticket_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM tok) GROUP BY 1, 2""")
define("wv", "wc", "SELECT term, count(*) AS df, sum(tf) AS total FROM wc GROUP BY 1 HAVING count(*) >= 2")
define("ww", "wv", """
SELECT ticket_id, term, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY ticket_id)) AS weight FROM
 (SELECT ticket_id, term, df, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM tickets)) / CAST(1 + df AS DOUBLE)) + 1) AS raw FROM wc JOIN wv USING (term))""")
for _name, _needs in (("tok", "inbox"), ("wc", "itok"), ("wv", "iwc"), ("ww", "iwv")):  # the same over all tickets, labelled or not
    define("i" + _name, _needs, re.sub(r"\b(tok|wc|wv)\b", r"i\1", CTES[_name][1]).replace("FROM tickets", "FROM inbox"))


@query("word_terms", "TX-01", cte("iww") + "SELECT term, any_value(df) AS df, sum(weight) AS weight FROM iww GROUP BY 1", dbl="weight")
def word_terms(spark, sf):
    w, v = _weights(Desk(spark, sf).inbox)
    return w.join(v.select("term", "df"), "term").groupBy("term").agg(F.max("df").alias("df"), F.sum("weight").alias("weight"))


@query("word_documents", "TX-01", cte("iww") + "SELECT ticket_id, count(*) AS terms, sum(weight) AS weight, sum(weight * weight) AS norm FROM iww GROUP BY 1", dbl="weight norm")
def word_documents(spark, sf):
    return _weights(Desk(spark, sf).inbox)[0].groupBy("ticket_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("weight")).alias("norm"))


def _weights(docs: DataFrame):
    counts = terms.word_counts(docs, "ticket_id", tx.ticket_text())
    vocab = terms.vocabulary(counts, 2)
    return terms.weights(counts, vocab, docs, "ticket_id"), vocab


define("cw", "inbox", r"""
SELECT ticket_id, ' ' || w || ' ' AS p, count(*) AS n FROM (SELECT ticket_id, unnest(regexp_split_to_array(lower('CHANNEL_' || channel || ' PRODUCT_' || replace(product, ' ', '_') || ' ' || subject || ' ' || body), '\s+')) AS w FROM inbox)
WHERE w <> '' GROUP BY 1, 2""")
define("cc", "cw", """
SELECT ticket_id, term, sum(n) AS tf FROM (SELECT ticket_id, n, unnest(CASE WHEN length(p) > k THEN list_transform(range(1, length(p) - k + 2), lambda i: substring(p, i, k)) WHEN length(p) = k THEN [p] ELSE [] END) AS term
  FROM cw CROSS JOIN (SELECT unnest([3, 4, 5]) AS k)) GROUP BY 1, 2""")
define("cv", "cc", "SELECT term, count(*) AS df, sum(tf) AS total FROM cc GROUP BY 1 HAVING count(*) >= 3")


@query("char_terms", "TX-02", cte("cv") + "SELECT term, df, total FROM cv", big="total")
def char_terms(spark, sf):
    return terms.char_vocabulary(Desk(spark, sf).inbox, "ticket_id", tx.ticket_text(), 3).select("term", "df", "total")


@query("chi_square_terms", "TX-03", cte("ww", "tickets") + """,
sh AS (SELECT priority AS class, count(*) / CAST((SELECT count(*) FROM tickets) AS DOUBLE) AS share FROM tickets GROUP BY 1),
o AS (SELECT term, t.priority AS class, sum(weight) AS o FROM ww JOIN tickets t USING (ticket_id) GROUP BY 1, 2), tt AS (SELECT term, sum(o) AS t FROM o GROUP BY 1)
SELECT tt.term, round(sum((coalesce(o, 0) - share * t) ** 2 / (share * t)), 6) AS chi2 FROM tt CROSS JOIN sh LEFT JOIN o ON o.term = tt.term AND o.class = sh.class GROUP BY 1""", dbl="chi2")
def chi_square_terms(spark, sf):
    d = Desk(spark, sf)
    return terms.chi_square(_weights(d.tickets)[0], d.tickets, "ticket_id", "priority")


# ---------------------------------------------------------------- nearest neighbours

define("itok", "documents_text", r"SELECT ticket_id, known, regexp_extract_all(lower(body), '[\p{L}\p{N}_]{2,}') AS w FROM documents_text")
define("documents_text", "", "SELECT d.doc_id AS ticket_id, d.text AS body, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
define("iwc", "itok", "SELECT ticket_id, known, term, count(*) AS tf FROM (SELECT ticket_id, known, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM itok) GROUP BY 1, 2, 3")
define("iv", "iwc", "SELECT term, count(*) AS df, sum(tf) AS total FROM iwc WHERE known GROUP BY 1 HAVING count(*) >= 2")
define("iw", "iv", """
SELECT ticket_id, known, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY ticket_id)) AS weight FROM (SELECT ticket_id, known, term,
  (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents_text WHERE known)) / CAST(1 + df AS DOUBLE)) + 1) AS raw FROM iwc JOIN iv USING (term))""")
define("nov", "iw", """
SELECT d.ticket_id, greatest(least(1 - coalesce(s, 0), 1), 0) AS novelty FROM documents_text d LEFT JOIN (SELECT q, max(s) AS s FROM (SELECT a.ticket_id AS q, b.ticket_id AS c, sum(a.weight * b.weight) AS s
  FROM iw a JOIN iw b ON a.term = b.term AND NOT a.known AND b.known GROUP BY 1, 2) GROUP BY 1) m ON m.q = d.ticket_id WHERE NOT known""")


def novelty_frame(spark, sf):
    """Every unlabelled document against all labelled ones."""
    d = Desk(spark, sf)
    x = d.table("documents").select(F.col("doc_id").alias("ticket_id"), F.col("text").alias("body")).join(
        d.table("labels").select(F.col("doc_id").alias("ticket_id"), F.lit(1).alias("_l")), "ticket_id", "left")
    known, rest = x.where("_l IS NOT NULL"), x.where("_l IS NULL")
    kc, rc = (terms.word_counts(y, "ticket_id", F.col("body")) for y in (known, rest))
    vocab = terms.vocabulary(kc, 2)
    return matching.novelty(terms.weights(rc, vocab, known, "ticket_id"), terms.weights(kc, vocab, known, "ticket_id"), rest, "ticket_id")


@query("topic_novelty", "JN-13", cte("nov") + "SELECT * FROM nov", dbl="novelty")
def topic_novelty(spark, sf):
    return novelty_frame(spark, sf)


@query("novelty_threshold", "JN-13 FLT-05", cte("nov") + "SELECT quantile_cont(novelty, 0.995) AS threshold FROM nov", dbl="threshold")
def novelty_threshold(spark, sf):
    from ..session import cut_lineage
    return intake.novelty_threshold(cut_lineage(novelty_frame(spark, sf)))


@query("fuzzy_sentences", "JN-14 TX-08")
def fuzzy_sentences(spark, sf):
    """Distinct sentences of all documents mapped to the template sentences, typing errors forgiven."""
    d = Desk(spark, sf)
    vocab = intake.template_sentences(d.inbox, 5).select(F.col("sentence").alias("text"))
    s = d.inbox.select(F.explode(tx.sentences(F.col("body"))).alias("text")).distinct()
    return matching.fuzzy_vocabulary(s, vocab)


