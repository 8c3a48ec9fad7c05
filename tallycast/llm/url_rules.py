"""URL filtering: fixed host and path rules first, then association rules mined from labelled URLs."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from tallycast.llm.graph import written

#: The given rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
BLOCK_ITEM, ALLOW_ITEM = "label=block", "label=allow"


def host_of(url: Column) -> Column:
    """The part between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (verdict, rule) whose host is the url's or a parent of it and whose path begins the url's; else null."""
    chosen = F.lit(None)
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(chosen)
    return chosen


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a url: parts of the host, path words, names of query fields; digits are folded to ``0``."""
    fold = lambda text, prefix, cut: F.transform(
        F.filter(F.split(F.regexp_replace(F.lower(text), r"\d+", "0"), cut), lambda t: t != ""), lambda t: F.concat(F.lit(prefix), t))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    names = F.transform(F.filter(F.split(F.lower(query), "&"), lambda t: t != ""), lambda t: F.concat(F.lit("q:"), F.substring_index(t, "=", 1)))
    return F.array_sort(F.array_distinct(F.concat(fold(host, "h:", r"[.\-]"), fold(path, "p:", r"[/.\-_]"), names)))


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``[rule_id, tokens, confidence, support]``: token combinations that go with the block label.

    ``labelled`` has ``[tokens, blocked]``. FP-growth finds the frequent combinations of tokens and label; rules below the
    confidence, or not more often blocked than urls are overall, are pruned, and so is a rule whose tokens contain those of a
    rule of at least its confidence. The number of rules is bounded by the support, not by the number of urls.
    """
    items = F.array_append("tokens", F.when(F.col("blocked"), BLOCK_ITEM).otherwise(ALLOW_ITEM)).alias("items")
    baskets = written(labelled.where("blocked is not null").select(items, "blocked"), "baskets")
    base = baskets.agg(F.avg(F.col("blocked").cast("double")).alias("share")).first()["share"]
    empty = "rule_id long, tokens array<string>, confidence double, support double"
    if base is None:
        return labelled.sparkSession.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=max(min_confidence, 1e-9)).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0] == BLOCK_ITEM).where(F.col("confidence") > base)
    rules = written(found.select(
        F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    token = rules.select(F.col("rule_id").alias("general"), F.explode("tokens").alias("token"), F.size("tokens").alias("wanted"),
                         F.col("confidence").alias("general_confidence"))
    wider = rules.select("rule_id", "confidence", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(token, "token").where(
        "wanted < n and general_confidence >= confidence").groupBy("rule_id", "general", "wanted").count().where("count = wanted")
    return written(rules.join(wider.select("rule_id").distinct(), "rule_id", "left_anti"), "kept_rules")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``[key, tokens, confidence, support]``: the most confident rule of each ``[key, tokens]`` that any rule fits.

    The inverted index lists every rule once, under its rarest token over the rules' tokens; a url looks up its tokens and
    checks the rest of each rule it finds. The index is as small as the rules, so Spark broadcasts it by its size.
    """
    usage = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    spread = rules.select("rule_id", F.explode("tokens").alias("token")).join(usage, "token")
    entry = spread.groupBy("rule_id").agg(F.min(F.struct("uses", "token"))["token"].alias("token"))
    index = rules.join(entry, "rule_id").select("token", F.col("tokens").alias("needed"), "confidence", "support")
    looked_up = token_sets.select("key", F.col("tokens").alias("own"), F.explode("tokens").alias("token")).join(index, "token")
    fits = looked_up.where(F.size(F.array_except("needed", "own")) == 0)
    best = fits.groupBy("key").agg(F.max(F.struct("confidence", "support", F.array_join("needed", " ").alias("tokens"))).alias("best"))
    return best.select("key", "best.tokens", "best.confidence", "best.support")


def judge_urls(
    pages: DataFrame, labels: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """One row per page: ``[id_column, host, path, rule, verdict, tokens, confidence]``.

    A fixed rule decides where one fits. Else the page is blocked if a mined rule fits it, whose ``tokens`` and ``confidence`` are
    given, and allowed if none does. Labels ``[doc_id, quality, toxic]`` belong to the page of that id: quality 0 or toxic 1
    count as block, of several labels the worst counts, labels without either value are ignored. Rules are mined from all
    labelled pages. Equal token sets are matched once. Null urls and urls without ``://`` have empty host and path and no tokens
    but are kept; without labels nothing is mined and everything else is allowed. Other columns are ignored.
    """
    url = F.col(url_column).cast("string")
    parsed = pages.select(F.col(id_column).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    parsed = parsed.withColumn("own", F.when(F.col("host") != "", tokens_of(F.col("host"), F.col("path"), F.col("url"))).otherwise(F.array().cast("array<string>")))
    parsed = written(parsed.select("id", "host", "path", "own", F.xxhash64("own").alias("key")), "urls")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.coalesce("quality", "toxic").isNotNull(), 0)
    verdicts = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(bad).alias("bad")).where("bad is not null")
    labelled = parsed.join(verdicts, "id").where(F.size("own") > 0).select(F.col("own").alias("tokens"), (F.col("bad") == 1).alias("blocked"))
    mined = mine_rules(labelled, min_support, min_confidence)
    sets = parsed.groupBy("key").agg(F.first("own").alias("tokens")).where(F.size("tokens") > 0)
    matched = written(match_rules(sets, mined), "matched")
    fixed = fixed_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.join(matched, "key", "left").withColumn("fixed", fixed)
    verdict = F.coalesce("fixed.verdict", F.when(F.col("tokens").isNotNull(), "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_column), "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "tokens", "confidence")
