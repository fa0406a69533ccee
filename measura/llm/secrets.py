"""Secret scan with corpus-wide ownership frequency.  Native: DataFrame functions only.

Patterns find spans in each text.  Every span's value is hashed, and the hashes are aggregated over the whole corpus by
distinct repositories (texts, so that copies of one text count once) and distinct owners.  A value of few owners in few
repositories looks live; one that many owners show, or that one owner shows in many texts, is a copied example.  Kinds
listed in ``BASE`` are always reported.  The kind ``token`` (long runs that mix capitals, small letters and digits) is what
the method adds: it is reported only where its value looks live and it overlaps no base span.

Spans are counted in code points, the end exclusive.  Positions are running sums over the lengths of the matches and of what
lies between them, so the work grows with a text's matches and not with their square.

Edge cases: a null text is empty; a null owner is an owner of its own; repeated rows are separate rows; an empty table
gives an empty result.  Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from measura.session import materialize

#: Kind -> (pattern, group of the value, least characters of the value).  Fixed values.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: What base patterns of one class reduce to, with the same matches: runs that are too short can't match.
QUICK = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
ADDED = {"token": (r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])[A-Za-z0-9_-]{24,}", 0, 24)}
KINDS = [*BASE, *ADDED]
MATCHES = "array<struct<kind:int,i:int,gap:int,size:int,value:string>>"


def matches(text: str, kind: str) -> Column:
    """Array of (kind, i, gap, size, value) of one kind: leftmost matches that don't overlap, each with the gap before it."""
    pattern, group, _ = (BASE | ADDED)[kind]
    pattern = QUICK.get(kind, pattern)
    whole = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)) if group else whole
    rest = F.slice(F.split(F.col(text), pattern, -1), 1, F.size(whole))
    found = F.transform(
        F.arrays_zip(whole.alias("m"), value.alias("v"), rest.alias("gap")),
        lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("value")),
    )
    return F.when(F.col(text).rlike(pattern), found).otherwise(F.array().cast(MATCHES))


def placed(found: DataFrame) -> DataFrame:
    """found (id, kind, i, gap, size, value, ...) with start and end, without short values and added spans that meet a base one.

    Ends are running sums of a kind's matches.  Of a span's neighbours by start, the base spans before it must end by its
    start, and those after it must not begin before its end: running extremes in both directions.
    """
    end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("id", "kind").orderBy("i")).cast("int")
    least = F.array(*(F.lit((BASE | ADDED)[k][2]) for k in KINDS))
    spans = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where(F.length("value") >= F.get(least, F.col("kind")))
    base = F.col("kind") < len(BASE)
    by = W.partitionBy("id")
    reach = F.max(F.when(base, F.col("end"))).over(by.orderBy("start", "kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    ahead = F.min(F.when(base, F.col("start"))).over(by.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, W.currentRow))
    apart = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))
    return spans.withColumn("reach", reach).withColumn("ahead", ahead).where(base | apart).drop("reach", "ahead", "i", "gap", "size")


def rendered(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", live_owners: int = 2, live_repositories: int = 8, keep: list[str] | None = None) -> DataFrame:
    """docs with ``found``: spans (start, kind, end, value, owners, repositories, live), by start and then kind.

    kind is a place in KINDS; live is whether at most live_owners owners show the value, in at most live_repositories
    distinct texts.  keep: the columns of docs to return (None: all), which are written once beside the spans.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c != "found"])
    body = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"), F.col(f"`{owner}`").cast("string").alias("owner"))
    body = body.withColumn("matches", F.concat(*(matches("body", k) for k in KINDS)))
    marked = materialize(body.select(F.monotonically_increasing_id().alias("id"), "row", "owner", F.when(F.size("matches") > 0, F.sha2("body", 256)).alias("repository"), "matches"), "secret-matches")
    each = placed(marked.select("id", "owner", "repository", F.explode("matches").alias("s")).select("id", "owner", "repository", "s.*")).withColumn("digest", F.sha2("value", 256))
    each = materialize(each, "secret-spans")
    use = each.groupBy("digest").agg(F.count_distinct(F.coalesce("owner", F.lit("\0"))).alias("owners"), F.count_distinct("repository").alias("repositories"))
    judged = each.join(use, "digest").withColumn("live", (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories))
    kept = judged.where((F.col("kind") < len(BASE)) | F.col("live"))
    lists = kept.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "value", "owners", "repositories", "live"))).alias("found"))
    empty = F.array().cast(lists.schema["found"].dataType)
    return marked.join(lists, "id", "left").select("row.*", F.coalesce("found", empty).alias("found"))
