"""Secret scans with corpus-wide ownership frequency.

Patterns find candidate credentials; how widely a value is spread then says what it is. A value that several owners
publish, or that one owner has in many repositories or rows, is a copied example; one that only few repositories and rows of a single
owner hold, and that looks random, is likely live. Values are counted by digest over the whole corpus, first by (value, owner,
repository), then by owner, so a value in a third of all rows is summed before it is moved.

Kinds: assign, access and hex are the base patterns, always reported. The method adds kind `owned`: any further run of 20
or more credential characters with upper case, lower case and digits, outside the base spans, whose value belongs to few
repositories and rows of a single owner. Spans are kind:start:end in code points, end exclusive, ordered by start and then kind.

Defined results: null and empty texts have no spans; a null owner or repository counts as one of its own; repeated rows each
get their spans; an empty table gives an empty result."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import written

from .common import table

# The base patterns of the contract.
KEYED = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OWNED = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A value in more repositories of one owner, or in more rows, is an example even if nobody else has it.
FEW_REPOSITORIES, FEW_ROWS = 3, 10
#: Matches of a text that are appended to one another at once.
RUN = 128
MAY_ASSIGN = r"(?i:passw|secret|token|api_?key)"


def found(text: Column, pattern: str, kind: int) -> Column:
    """Matches of `pattern` from the left as structs (start, kind, end, whole match): the text splits into what lies between the
    matches, and lengths add up to places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("hit")))).alias("spans"))

    def add_run(acc: Column, run: Column) -> Column:
        ends = F.aggregate(run, acc["at"], lambda at, pair: at + F.length(pair["gap"]) + F.length(pair["hit"]))
        spans = F.aggregate(run, F.struct(acc["at"].alias("at"), none().alias("spans")), add, lambda a: a["spans"])
        return F.struct(ends.alias("at"), F.concat(acc["runs"], F.array(spans)).alias("runs"))

    def placed(all_pairs: Column) -> Column:
        # Appending copies what is there, so matches are appended in runs, and runs to each other.
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / RUN).cast("int")), lambda i: F.slice(all_pairs, i * RUN + 1, F.lit(RUN)))
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{none_type()}>").alias("runs")), add_run, lambda acc: F.flatten(acc["runs"]))

    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    # As the variable of a lambda the pairs are made once for a text, not once for a run.
    return F.when(F.size(hits) > 0, F.get(F.transform(F.array(pairs), placed), F.lit(0))).otherwise(none())


def none_type() -> str:
    return "array<struct<start:int,kind:int,end:int,hit:string>>"


def none() -> Column:
    return F.array().cast(none_type())


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def value(span: Column) -> Column:
    """The credential itself: the assigned part, or the whole match."""
    return F.when(span["kind"] == 0, F.regexp_extract(span["hit"], KEYED, 1)).otherwise(span["hit"])


def spans(docs: DataFrame) -> DataFrame:
    """`base` and `more` candidate spans of each row, beside the given columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.when(text.rlike(MAY_ASSIGN), F.filter(found(text, KEYED, 0), lambda s: F.length(F.regexp_extract(s["hit"], KEYED, 1)) >= 6)).otherwise(none())
    access = F.when(F.contains(text, F.lit("AKIA")), found(text, ACCESS, 1)).otherwise(none())
    hexes = F.when(text.rlike(HEX), found(text, HEX, 2)).otherwise(none())
    more = F.when(text.rlike(OWNED), F.filter(found(text, OWNED, 3), lambda s: s["hit"].rlike("[a-z]") & s["hit"].rlike("[A-Z]") & s["hit"].rlike("[0-9]"))).otherwise(none())
    out = docs.withColumn("base", F.array_sort(F.concat(assign, access, hexes))).withColumn("more", more)
    return out.withColumn("more", F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def ownership(candidates: DataFrame) -> DataFrame:
    """digest, owners, repositories, uses, from (digest, owner, repository, times) of every row that holds the value: distinct counts by stepwise sums."""
    each = candidates.groupBy("digest", "owner", "repository").agg(F.sum("times").alias("n"))
    owners = each.groupBy("digest", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return owners.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("uses"))


def scan(docs: DataFrame, owner: Column, repository: Column, copied_from: int = 2, repositories: int = FEW_REPOSITORIES, uses: int = FEW_ROWS) -> DataFrame:
    """Per row of `docs` (doc_id, text): its spans with the verdict on every value.

    owner, repository: whose the row is. A value of `copied_from` owners or more, of more than so many `repositories` or in more rows than `uses` is
    a copied example. Returns doc_id, base (spans),
    kept (base and owned spans), n_copied and n_live: of the kept spans, those copied and those owned and random-looking."""
    rows = docs.select("doc_id", "text", F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(repository.cast("string"), F.lit("")).alias("repository"))
    seen = written(spans(rows).select("doc_id", "owner", "repository", "base", "more", F.xxhash64("doc_id", "text").alias("row")), "secret-spans")
    plain = seen.where((F.size("base") == 0) & (F.size("more") == 0))
    row = ["doc_id", "row", "owner", "repository"]
    some = seen.where((F.size("base") > 0) | (F.size("more") > 0)).groupBy(*row).agg(
        F.first("base").alias("base"), F.first("more").alias("more"), F.count("*").alias("times"))
    one = some.select(*row, "times", F.explode(F.concat("base", "more")).alias("span")).withColumn("digest", F.sha2(value(F.col("span")), 256))
    held = some.select("owner", "repository", "times", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda s: F.sha2(value(s), 256)))).alias("digest"))
    known = written(ownership(held), "secret-owners")
    judged = one.join(known, "digest")
    copied = (F.col("owners") >= copied_from) | (F.col("repositories") > repositories) | (F.col("uses") > uses)
    text = value(F.col("span"))
    live = ~copied & (F.length(text) >= 16) & (F.size(F.array_distinct(F.split(text, ""))) >= 10)
    keep = (F.col("span.kind") < 3) | live
    whole = judged.groupBy(*row, "times").agg(
        F.array_sort(F.collect_list(F.when(F.col("span.kind") < 3, F.col("span")))).alias("base"),
        F.array_sort(F.collect_list(F.when(keep, F.col("span")))).alias("kept"),
        F.sum(F.when(keep & copied, 1).otherwise(0)).alias("n_copied"), F.sum(F.when(live, 1).otherwise(0)).alias("n_live"))
    whole = whole.select("doc_id", "base", "kept", F.col("n_copied").cast("long"), F.col("n_live").cast("long"),
                         F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_")).drop("_")
    rest = plain.select("doc_id", "base", F.col("base").alias("kept"), F.lit(0).cast("long").alias("n_copied"), F.lit(0).cast("long").alias("n_live"))
    return whole.unionByName(rest)


def query(spark, sf_dir: str) -> DataFrame:
    """Spans of every document; the owner is its source, the repository its source and language, the finest that the table has; the
    number of rows tells what stays inside one of these."""
    docs = table(spark, sf_dir, "documents")
    out = scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))

    def of(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                      joined(F.col("kept")).alias("spans"), "n_copied", "n_live")
