"""URL filter: a fixed rule list, and association rules mined from labelled URLs.

FP-growth finds token combinations (host labels, path segments, query names)
that come with a label; rules short of the confidence or support, or no better
than a more general rule, are pruned. Tokens that stand on exactly the same
labelled pages are one item, a class, to FP-growth: any of them says the same,
and a rule asks for one token of each of its classes. So a long URL that repeats
is one item and not all subsets of its tokens. A rule is indexed under its rarest
class and matched against distinct token sets, so each rule is tried only where
that class stands. The surest matching rule decides; with none the verdict is
allow. All steps are DataFrame operations.

Results: one row per page. A null URL, or one without ``://``, has an empty host
and path, no tokens and no list rule. Empty tables give empty results; without
labels no rule is mined. Null labels and null ids teach nothing. Repeated rows
each give their own row; extra columns are ignored. Runs of digits in tokens
count as one sign, so numbered pages share their tokens.
"""

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import store

# The rule list of the contract, as (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
BLOCK, ALLOW = "label=block", "label=allow"


@dataclass(frozen=True)
class Params:
    pages: int = 5  # labelled pages that a rule must hold for, however many there are
    support: float | None = None  # or a share of them
    confidence: float = 0.8


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), upper, lower)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def list_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule of the list, as ``host + path``, and its verdict; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens in order: ``h:`` host label, ``p:`` path segment, ``q:`` query name."""
    named = lambda parts, kind: F.transform(
        F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x)
    )
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "[&;]"), lambda x: F.split(x, "=")[0])
    found = F.concat(
        named(F.split(host(url), r"\."), "h:"),
        named(F.split(F.lower(path(url)), "/"), "p:"),
        named(F.transform(names, F.lower), "q:"),
    )
    found = F.transform(found, lambda x: F.regexp_replace(x, r"[0-9]+", "#"))
    return F.array_sort(F.array_distinct(found))


def _classes(labelled: DataFrame, least: float) -> DataFrame:
    """``token, class, freq``: tokens of ``least`` pages or more; those on the same pages share a class.

    A class has the name of its smallest token. Which pages a token stands on is
    told by two independent hashes over the distinct token sets that hold it.
    """
    kinds = labelled.groupBy("tokens").agg(F.count("*").alias("pages"))
    where = (
        kinds.select(
            "pages",
            F.xxhash64("tokens").alias("h1"),
            F.xxhash64(F.lit("second"), "tokens").alias("h2"),
            F.explode("tokens").alias("token"),
        )
        .groupBy("token")
        .agg(F.sum("pages").alias("freq"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
        .filter(F.col("freq") >= least)
    )
    names = where.groupBy("freq", "h1", "h2").agg(F.min("token").alias("class"))
    return where.join(names, ["freq", "h1", "h2"]).select("token", "class", "freq")


def _classed(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``tokens, classes`` of distinct token sets, without those that hold no class."""
    return (
        sets.select("tokens", F.explode("tokens").alias("token"))
        .join(classes.select("token", "class"), "token")
        .groupBy("tokens")
        .agg(F.array_sort(F.collect_set("class")).alias("classes"))
    )


def mine_classes(labelled: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """``labelled``: ``tokens, blocked``. Rules over classes, and the classes.

    Rules are ``antecedent, anchor, block, confidence, support``, where
    ``antecedent`` and ``anchor`` name classes; classes are ``token, class, freq``.
    """
    pages = max(1, labelled.count())
    # half a page less, so that rounding does not ask for one more
    support = p.support if p.support is not None else min(1.0, (p.pages - 0.5) / pages)
    classes, _ = store(_classes(labelled, support * pages), "url-classes")
    label = F.when(F.col("blocked"), BLOCK).otherwise(ALLOW)
    held = labelled.join(_classed(labelled.select("tokens").distinct(), classes), "tokens", "left")
    none = F.array().cast("array<string>")
    baskets = held.select(F.array_append(F.coalesce("classes", none), label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=p.confidence).fit(baskets)
    found = model.associationRules.filter(F.col("consequent")[0].isin(BLOCK, ALLOW)).filter(
        ~F.array_contains("antecedent", BLOCK) & ~F.array_contains("antecedent", ALLOW)
    )
    rules, _ = store(
        found.select(
            F.array_sort("antecedent").alias("antecedent"),
            (F.col("consequent")[0] == BLOCK).alias("block"),
            "confidence",
            "support",
        ),
        "url-rules",
    )
    general = rules.select(
        F.col("antecedent").alias("g"), "block", F.col("confidence").alias("gc"), F.col("g")[0].alias("t")
    )
    beaten = (
        rules.select("antecedent", "block", "confidence", F.explode("antecedent").alias("t"))
        .join(general, ["t", "block"])
        .filter(
            (F.size("g") < F.size("antecedent"))
            & (F.size(F.array_except("g", "antecedent")) == 0)
            & (F.col("gc") >= F.col("confidence"))
        )
        .select("antecedent", "block")
        .distinct()
    )
    pruned = rules.join(beaten, ["antecedent", "block"], "left_anti")
    often = classes.filter(F.col("token") == F.col("class")).select(F.col("class").alias("t"), "freq")
    anchors = (
        pruned.select("antecedent", F.explode("antecedent").alias("t"))
        .join(often, "t")
        .groupBy("antecedent")
        .agg(F.min_by("t", F.struct("freq", "t")).alias("anchor"))
    )
    return pruned.join(anchors, "antecedent"), classes


def mine(labelled: DataFrame, p: Params = Params()) -> DataFrame:
    """The rules told in tokens: a row for every choice of one token of each class. For reading, not matching."""
    rules, classes = mine_classes(labelled, p)
    members = classes.groupBy("class").agg(F.array_sort(F.collect_list("token")).alias("members"))
    key = ["antecedent", "block", "confidence", "support", "anchor"]
    parts = (
        rules.select(*key, F.explode("antecedent").alias("class"))
        .join(members, "class")
        .withColumn("freq_anchor", F.col("class") == F.col("anchor"))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("freq_anchor", "members"))).alias("parts"))
    )
    # the anchor's class comes last
    start = F.array(F.array().cast("array<string>"))
    choices = F.aggregate(
        F.transform("parts", lambda x: x["members"]),
        start,
        lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda m: F.array_append(d, m)))),
    )
    return parts.select("block", "confidence", "support", F.explode(choices).alias("chosen")).select(
        F.array_sort("chosen").alias("antecedent"),
        F.element_at("chosen", -1).alias("anchor"),
        "block",
        "confidence",
        "support",
    )


def judge(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """``urls``: a column ``tokens``. ``tokens, mined, confidence`` of each distinct set a rule matches."""
    sets = _classed(urls.select("tokens").distinct(), classes)
    return (
        sets.select("tokens", "classes", F.explode("classes").alias("anchor"))
        .join(rules, "anchor")
        .filter(F.size(F.array_except("antecedent", "classes")) == 0)
        .groupBy("tokens")
        .agg(
            F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), "block")).alias("best")
        )
        .select(
            "tokens",
            F.when(F.col("best.block"), "block").otherwise("allow").alias("mined"),
            F.col("best.confidence").alias("confidence"),
        )
    )


def filter_urls(pages: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """``pages``: ``page_id, url``; ``labels``: ``page_id, blocked`` (boolean)."""
    known = labels.select("page_id", "blocked").filter(
        F.col("blocked").isNotNull() & F.col("page_id").isNotNull()
    )
    seen = pages.select("page_id", tokens(F.coalesce("url", F.lit(""))).alias("tokens"))
    labelled, _ = store(seen.join(known, "page_id").select("tokens", "blocked"), "url-labels")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).select(
        "page_id",
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        tokens(F.col("url")).alias("tokens"),
    )
    rule, listed = list_rule(F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), listed.alias("listed"))
    if labelled.isEmpty():
        judged = rows.withColumns({"mined": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    else:
        judged = rows.join(judge(rows, *mine_classes(labelled, p)), "tokens", "left")
    verdict = F.coalesce("listed", "mined", F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined", "confidence")
