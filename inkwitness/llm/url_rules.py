"""URL filtering: explicit rules, then association rules mined from labels, with DataFrame operations only.

A url is a basket of tokens: the labels of its host, the words of its path and the names of its parameters. Spark's
FP-growth over the baskets of labelled pages, each with its verdict as one more item, gives rules "these tokens, so bad";
rules below the support, confidence or lift asked for go, and so do rules that a shorter one makes idle. To match, every
rule lies in an inverted index under its rarest token: a url meets only the rules of its own tokens, and the rest of the
rule's tokens are looked up in the basket.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least share and number of labelled pages that hold a rule, least confidence, least ratio to the share of bad pages.
SUPPORT, HOLD, CONFIDENCE, LIFT = 0.001, 25, 0.5, 1.5
_BAD = "bad"


@dataclass(frozen=True)
class Rule:
    """``block`` or ``allow`` for a host, its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens: ``h:`` host labels, ``p:`` words of the path (numbers as #), ``q:`` names of parameters."""
    marked = lambda mark, array: F.transform(F.filter(array, lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.lower(x)))
    words = F.transform(F.split(path_of(url), r"[^\p{L}\p{N}]+"), lambda x: F.regexp_replace(x, r"^\p{N}+$", "#"))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(marked("h:", F.split(host_of(url), r"\.")), marked("p:", words), marked("q:", names)))


def taught(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What there is to learn from: (page_id, bad). Where an explicit rule fits a page its verdict counts, elsewhere its ``labels``.

    So tokens of blocked pages reach pages that no explicit rule fits. Other columns are ignored; labels of absent pages stay.
    """
    fixed = pages.select("page_id", rule_for(host_of(F.col("url")), path_of(F.col("url")), rules, "verdict").alias("_verdict")).where("_verdict is not null")
    told = labels.select("page_id", "bad").join(fixed.select("page_id"), "page_id", "left_anti")
    return fixed.select("page_id", (F.col("_verdict") == "block").alias(_BAD)).unionByName(told)


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, hold: int = HOLD, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """Rules (tokens, key, confidence) that say bad; ``key`` is the rarest token.

    ``labels`` (page_id, bad) are joined with ``pages`` (page_id, url); other columns are ignored, rows with nulls left out. A rule must hold on
    ``support`` of the labelled pages and on ``hold`` of them; fewer labelled pages than that give no rule.
    """
    spark = pages.sparkSession
    told = pages.select("page_id", "url").join(labels.select("page_id", "bad"), "page_id").where("url is not null and bad is not null")
    baskets = told.select(F.concat(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    total = baskets.count()
    if total < hold:
        return spark.createDataFrame([], "tokens array<string>, key string, confidence double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(minSupport=min(1.0, max(support, hold / total)), minConfidence=confidence, numPartitions=parts).fit(baskets)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("key"), F.col("freq"))
    found = (model.associationRules.where((F.col("consequent")[0] == _BAD) & (F.col("lift") >= lift))
             .select(F.array_sort("antecedent").alias("tokens"), "confidence"))
    # a rule is idle beside one with fewer tokens, all among its own, and no less confidence
    few = found.select(F.col("tokens").alias("fewer"), F.col("confidence").alias("surer"), F.explode("tokens").alias("token"))
    idle = (found.select("tokens", "confidence", F.explode("tokens").alias("token")).join(few, "token")
            .where((F.size("fewer") < F.size("tokens")) & (F.col("surer") >= F.col("confidence")) & (F.size(F.array_except("fewer", "tokens")) == 0))
            .select("tokens").distinct())
    kept = found.join(idle, "tokens", "left_anti")
    keyed = kept.withColumn("key", F.explode("tokens")).join(single, "key")
    return keyed.groupBy("tokens").agg(F.min_by("key", F.struct("freq", "key")).alias("key"), F.max("confidence").alias("confidence"))


def judged(pages: DataFrame, mined: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A verdict on every page: page_id, host, path, rule, verdict, confidence (of the surest mined rule that fits, else null).

    ``pages`` has page_id and url; other columns are ignored. A null url, or one without ``://``, has an empty host and
    path and no token, so no rule fits and it is allowed. The longest explicit rule decides; where none fits, a mined rule
    blocks, and a url that no rule fits is allowed. Repeated rows are judged each.
    """
    urls = pages.select(F.col("url")).where("url is not null").distinct().withColumn("tokens", tokens_of(F.col("url")))
    index = mined.select(F.col("tokens").alias("needed"), F.col("key").alias("token"), "confidence")
    met = (urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
           .where(F.size(F.array_except("needed", "tokens")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence")))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    fixed = rule_for(host, path, rules, "verdict")
    return pages.select("page_id", "url").join(met, "url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), rule_for(host, path, rules, "name").alias("rule"),
        F.coalesce(fixed, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")
