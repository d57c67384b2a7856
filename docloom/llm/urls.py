"""URL filters: rules of hosts and paths, then path-template trees judged by labelled purity.

The path of a URL is cut into segments whose numbers, codes and extensions are
generalised; all segments from the `DEPTH`-th on form the last one together. Per
host these templates form a tree. Level by level a variable segment (many
children, few pages each) becomes a wildcard, and labelled branches whose rates
the two-proportion test can't tell from that of all their siblings together are
merged into one (so each is like the whole, two of them needn't be like each
other). A template is rejected when its smoothed share of bad labels reaches the
limit. All steps are DataFrame expressions on counts that are combined before
each shuffle. Names made here begin with "/", which no segment holds: "/n" a
number, "/x" a code, "/*" a wildcard, "/~" merged branches.

Up to BROADCAST_TEMPLATES templates are broadcast to the pages; beyond that the
join shuffles, and adaptive execution splits a template with very many pages.

Defined cases: a null URL, or one without "://", has empty host and path; URLs of
any length and depth are read whole; unlabelled templates get the prior alone and
are allowed; null labels count as none; of rules that fit, the longest wins (the
rules differ in length where several can fit); repeated rows count each and are
all returned; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import LOWER, UPPER, checkpoint

# Fixed values: (verdict, rule).
RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"),
    ("block", "example.net/de/8"), ("block", "org/es/"),
)

DEPTH = 4
CHILDREN, PER_CHILD = 12, 8  # a variable segment has more children than this, and fewer pages each on average
CHI_SQUARE = 3.84
PRIOR, WEIGHT, LIMIT = 0.25, 4.0, 0.5
BROADCAST_TEMPLATES = 20_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, as given."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        own = text[:at]
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> list[Column]:
    """DEPTH generalised segments; null past the end, the last one holds all that follow."""
    cut = F.filter(F.split(path, "/"), lambda s: s != "")
    general = F.transform(
        cut,
        lambda s: F.when(s.rlike("^[0-9]+$"), F.lit("/n"))
        .when(s.rlike("^[0-9]+[.][A-Za-z]+$"), F.concat(F.lit("/n."), F.regexp_extract(s, "[.]([A-Za-z]+)$", 1)))
        .when(s.rlike("[0-9]"), F.lit("/x"))
        .otherwise(s),
    )
    last = F.when(F.size(general) >= DEPTH, F.array_join(F.slice(general, DEPTH, F.size(general)), "/"))
    return [*(F.get(general, F.lit(k)) for k in range(DEPTH - 1)), last]


def _level(leaves: DataFrame, k: int) -> DataFrame:
    """Extends `template` by the k-th segment, as it is, merged or as a wildcard."""
    seg = f"s{k}"
    child = leaves.groupBy("host", "template", seg).agg(*[F.sum(c).alias(c) for c in ("n", "lab", "bad")])
    there = F.col(seg).isNotNull()
    kids, pages, labelled, wrong = (f"_{c}" for c in ("kids", "n", "lab", "bad"))
    parent = child.where(there).groupBy(F.col("host").alias("_host"), F.col("template").alias("_template")).agg(
        F.count("*").alias(kids), *[F.sum(c).alias(f"_{c}") for c in ("n", "lab", "bad")]
    )
    both = child.where(there).join(parent, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template")))
    rest = F.col(labelled) - F.col("lab")
    p = F.col(wrong) / F.col(labelled)
    difference = F.col("bad") / F.col("lab") - (F.col(wrong) - F.col("bad")) / rest
    variance = p * (1 - p) * (1 / F.col("lab") + 1 / rest)
    alike = (F.col("lab") > 0) & (rest > 0) & F.when((F.col("lab") > 0) & (rest > 0), difference * difference <= F.lit(CHI_SQUARE) * variance)
    variable = (F.col(kids) > CHILDREN) & (F.col(pages) < PER_CHILD * F.col(kids))
    name = F.when(variable, F.lit("/*")).when(alike, F.lit("/~")).otherwise(F.col(seg))
    named = both.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col(seg).alias("_s"), name.alias("_name"))
    joined = leaves.join(named, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col(seg) == F.col("_s")), "left")
    extended = F.when(F.col("_name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "_name"))
    return joined.withColumn("template", extended).drop("_h", "_t", "_s", "_name")


def judge(pages: DataFrame, label: Column | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity.

    label: 1 bad, 0 good, null unknown, an expression of `pages`; left out, the
    verdicts of the rules are the labels.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), *([label.cast("long").alias("label")] if label is not None else []))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_verdict": verdict})
    if label is None:
        rows = rows.withColumn("label", F.when(F.col("_verdict") == "block", 1).when(F.col("_verdict") == "allow", 0))
    names = [f"s{k}" for k in range(DEPTH)]
    rows = rows.withColumns(dict(zip(names, segments(F.col("path")), strict=True)))
    leaves = rows.groupBy("host", *names).agg(
        F.count("*").alias("n"), F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")
    ).withColumn("template", F.lit(""))
    leaves = checkpoint(reduce(_level, range(DEPTH), checkpoint(leaves)))
    judged = leaves.groupBy(F.col("host").alias("_host"), F.col("template").alias("_template")).agg(
        ((F.sum("bad") + F.lit(WEIGHT * PRIOR)) / (F.sum("lab") + F.lit(WEIGHT))).alias("purity")
    )
    side = leaves.join(judged, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template")))
    side = side.select(F.col("host").alias("_h"), *[F.col(c).alias(f"_{c}") for c in names], "template", "purity")
    if leaves.count() <= BROADCAST_TEMPLATES:
        side = F.broadcast(side)
    match = reduce(lambda a, b: a & b, [F.col("host") == F.col("_h"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names)])
    own = F.when(F.col("purity") >= F.lit(LIMIT), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(side, match).select(
        "page_id", "host", "path", "rule", F.coalesce("_verdict", own).alias("verdict"), "template", "purity"
    )
