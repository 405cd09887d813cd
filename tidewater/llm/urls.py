"""URL filters: listed rules first, then association rules mined from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: Rules of the query (fixed values): verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Support and confidence below which mined rules are pruned.
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a URL: the host's labels and the path's parts."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_sort(F.array_distinct(F.concat(labels, parts)))


def classes(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(token, stands): frequent tokens of labelled rows of (set_id, tokens), those of one class under one name.

    Tokens that occur in exactly the same sets, such as the parts of a template, are a
    class: any of them says the same, so the least stands for all, and rules on its other
    members or several of them need not be mined.  Equal sets are told by two 64-bit sums
    of their ids.  A token is frequent in the share ``min_support`` of the labelled rows.
    """
    total = labelled.count()
    sets = labelled.groupBy("set_id").agg(F.first("tokens").alias("tokens"), F.count("*").alias("times"))
    marks = [F.bit_xor(F.xxhash64("set_id", F.lit(i))).alias(f"m{i}") for i in range(2)]
    seen = sets.select("set_id", "times", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("times").alias("n"), *marks).where(F.col("n") >= min_support * total)
    leaders = seen.groupBy("n", "m0", "m1").agg(F.min("token").alias("stands"))
    return seen.join(leaders, ["n", "m0", "m1"]).select("token", "stands")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Mined rules (rule_id, tokens, verdict, confidence, support, key) from rows of (tokens, verdict).

    FP-growth finds the frequent combinations of tokens and verdicts; rules from
    tokens to a verdict stay if their confidence suffices and no rule on fewer of
    their tokens is as confident.  ``key`` is a rule's rarest token.  Rows without
    a verdict are left out, those without tokens count for the support only; no rows give no rules.
    """
    items = labelled.where("verdict is not null").select("tokens", F.array_union("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    empty = "rule_id long, tokens array<string>, verdict string, confidence double, support double, key string"
    if items.isEmpty():
        return labelled.sparkSession.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where("consequent[0] like '=%' and not exists(antecedent, x -> x like '=%')")
    rules = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 100).alias("verdict"), "confidence", "support")
    rules = save(rules.withColumn("rule_id", F.xxhash64("tokens", "verdict")), "rules")
    counts = items.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    keys = rules.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("key"))
    rules = save(rules.join(keys, "rule_id").select("rule_id", "tokens", "verdict", "confidence", "support", "key"), "keyed")
    # a rule goes if one on a proper part of its tokens says the same as surely: found by the part's rarest token
    longer = rules.select(F.col("rule_id").alias("longer"), "verdict", F.col("tokens").alias("whole"), F.col("confidence").alias("c"), F.explode("tokens").alias("key"))
    over = longer.join(rules, ["key", "verdict"]).where("size(tokens) < size(whole) and confidence >= c and size(array_except(tokens, whole)) = 0")
    return save(rules.join(over.select(F.col("longer").alias("rule_id")).distinct(), "rule_id", "left_anti"), "pruned")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(set_id, verdict) of the surest rule whose tokens are all in a set, by an inverted index from a rule's rarest token to the rule."""
    index = rules.select("rule_id", "confidence", "support", F.col("verdict").alias("says"), F.col("tokens").alias("needs"), "key")
    hits = sets.select("set_id", "tokens", F.explode("tokens").alias("key")).join(index, "key").where("size(array_except(needs, tokens)) = 0")
    best = hits.groupBy("set_id").agg(F.max(F.struct("confidence", "support", "rule_id", "says")).alias("b"))
    return best.select("set_id", F.col("b.says").alias("verdict"))


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, default: str = "allow",
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    Listed rules decide first and are the labels that further rules are mined from;
    those decide for other URLs, and ``default`` where none matches.  A URL that has any
    token of a class (see ``classes``) has what stands for it.  Null URLs and those
    without :// have empty host and path.  Equal token sets are matched once; rows are
    returned as often as given; other columns are dropped.
    """
    url = F.col(url_col).cast("string")
    split = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, says = listed_rule(F.col("host"), F.col("path"), rules)
    rows = split.withColumns({"rule": rule, "listed": says, "tokens": tokens(F.col("host"), F.col("path"))})
    rows = save(rows.withColumn("set_id", F.xxhash64("tokens")), "urls")
    known = save(classes(rows.where("listed is not null").select("set_id", "tokens"), min_support), "classes")
    sets = rows.where("size(tokens) > 0").groupBy("set_id").agg(F.first("tokens").alias("tokens"))
    items = sets.select("set_id", F.explode("tokens").alias("token")).join(known, "token").groupBy("set_id").agg(F.array_sort(F.collect_set("stands")).alias("tokens"))
    items = save(items, "items")
    mined = mine(rows.where("listed is not null").select("set_id", F.col("listed").alias("verdict")).join(items, "set_id", "left").select(F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "verdict"), min_support, min_confidence)
    matched = save(match(items, mined).withColumnRenamed("verdict", "mined"), "matched")
    return rows.join(matched, "set_id", "left").select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("rule").isNull(), F.col("mined")), F.lit(default)).alias("verdict"))
