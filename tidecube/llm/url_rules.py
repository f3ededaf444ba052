"""URL filters by association rules, with DataFrame operations only.

Spark's FP-growth mines combinations of URL tokens that go with the label "block". Rules pruned by support, confidence
and redundancy are kept in an inverted index under their rarest token: a URL's tokens fetch the rules that may hold, and a
rule holds if the URL has all its tokens. A rule's tokens and the label must be frequent together, so only the blocked rows
are mined, and what is frequent there is counted over all rows. Tokens that always come together are one item, so that a
family of URLs with many tokens in common has no more combinations than one with few. Fixed host and path rules come first and are found in the same way, by the
host's suffixes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecube.llm.common import ascii_lower, materialize, maybe_broadcast

#: (verdict, host, path)
FixedRule = tuple[str, str, str]
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.005, 8, 0.6


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, each with its place: scheme, labels of the host and words that are parts of one, path segments, query keys, fragment. Numbers are all one token."""
    u = F.coalesce(url, F.lit(""))
    h, p = host(url), path(url)
    numbers = lambda c: F.regexp_replace(c, r"[0-9]+", "9")
    tag = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), numbers(x)))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return F.array_distinct(
        F.concat(
            tag("scheme ", F.array(ascii_lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
            tag("host ", F.split(h, r"\.")),
            tag("word ", F.array_except(F.split(h, r"[.-]"), F.split(h, r"\."))),
            tag("path ", F.split(p, "/")),
            tag("query ", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
            tag("fragment ", F.array(F.regexp_extract(u, r"#(.*)$", 1))),
        )
    )


RULE = "rule_id long, tokens array<string>, support double, confidence double, lift double"


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "block", min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, tokens, support, confidence, lift) for the label, from URLs with a boolean label.

    A rule needs ``min_support`` of the rows and ``min_rows`` of them, and ``min_confidence``; one whose tokens contain
    those of a shorter rule at least as confident is left out. Null labels are left out; no rows give no rules.
    """
    spark = labelled.sparkSession
    none = spark.range(0).select(*(F.lit(None).cast(t).alias(n) for n, t in (x.strip().split(" ") for x in RULE.split(","))))
    rows = materialize(labelled.where(F.col(label_col).isNotNull()).select(F.monotonically_increasing_id().alias("r"), F.col(label_col).alias("block"), url_tokens(F.col(url_col)).alias("tokens")), "url-rows")
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("block").cast("long")), F.lit(0))).first()
    least = max(min_rows, min_support * n)
    if bad < least:
        return none
    # Frequent tokens by the rows that have them; those of the same rows are one item, named by the first.
    held = rows.select("r", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.sum(F.xxhash64("r").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("r", F.lit(1))).alias("x"))
    items = materialize(held.where(F.col("n") >= least).groupBy("n", "s", "x").agg(F.min("t").alias("item"), F.array_sort(F.collect_list("t")).alias("members")), "url-items")
    baskets = rows.select("r", "block", F.explode("tokens").alias("item")).join(items.select("item"), "item").groupBy("r", "block").agg(F.collect_list("item").alias("items"))
    baskets = materialize(baskets, "url-baskets")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / bad), minConfidence=1.0, numPartitions=parts).fit(baskets.where("block").select("items"))
    sets = materialize(model.freqItemsets.where(F.col("freq") >= least).select(F.array_sort("items").alias("items"), F.col("freq").alias("blocked")).withColumn("rule_id", F.xxhash64("items")), "url-sets")
    every = _holding(baskets, sets.select("rule_id", F.col("items").alias("needs")), "r", "items").groupBy("rule_id").agg(F.count("*").alias("all"))
    counted = sets.join(every, "rule_id").withColumn("confidence", F.col("blocked") / F.col("all"))
    good = F.when((F.col("confidence") >= min_confidence) & (F.col("confidence") * n > bad), F.col("confidence"))
    counted = materialize(counted.withColumn("good", good), "url-counted")
    longest = counted.where("good is not null").agg(F.max(F.size("items"))).first()[0]
    if longest is None:
        return none
    # Parts of a frequent set are frequent, so the best rule among a set's parts is known from those that lack one item.
    best = counted.where(F.size("items") == 1).select("rule_id", F.lit(None).cast("double").alias("part"), "good")
    levels = [best]
    for k in range(2, longest + 1):
        shorter = best.select(F.col("rule_id").alias("lacks"), F.greatest("part", "good").alias("g"))
        wider = counted.where(F.size("items") == k).select("rule_id", "good", "items", F.explode("items").alias("i"))
        lacking = wider.select("rule_id", "good", F.xxhash64(F.array_remove("items", F.col("i"))).alias("lacks"))
        best = materialize(lacking.join(shorter, "lacks").groupBy("rule_id").agg(F.max("g").alias("part"), F.any_value("good").alias("good")).select("rule_id", "part", "good"), "url-level")
        levels.append(best)
    chosen = reduce(DataFrame.union, levels).where("good is not null and (part is null or part < good)").select("rule_id")
    whole = counted.join(chosen, "rule_id").select("rule_id", "blocked", "confidence", F.explode("items").alias("item")).join(items.select("item", "members"), "item")
    out = whole.groupBy("rule_id").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("tokens"), F.max("blocked").alias("blocked"), F.max("confidence").alias("confidence"))
    return out.select(F.xxhash64("tokens").alias("rule_id"), "tokens", (F.col("blocked") / n).alias("support"), "confidence", (F.col("confidence") * n / bad).alias("lift"))


def _holding(rows: DataFrame, rules: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, the rules' columns) of each row with each rule (rule_id, needs, ...) whose needs it has; rules wait under their rarest token."""
    freq = rows.select(F.explode(tokens).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    posting = rules.select("*", F.explode("needs").alias("t")).join(freq, "t", "left")
    rarest = posting.groupBy("rule_id").agg(F.min_by(F.struct("t", *rules.columns), F.struct(F.coalesce("n", F.lit(0)), "t")).alias("r")).select("r.*")
    met = rows.select(key, F.col(tokens).alias("has"), F.explode(tokens).alias("t")).join(maybe_broadcast(materialize(rarest, "url-index")), "t")
    return met.where(F.size(F.array_except("needs", "has")) == 0).select(key, *rules.columns)


def matched_rules(urls: DataFrame, rules: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """For each key with a rule that holds: the most confident (rule tokens, confidence); ties by support, then tokens."""
    met = _holding(urls, rules.select("rule_id", F.col("tokens").alias("needs"), "support", "confidence"), key, tokens)
    return met.groupBy(key).agg(F.max(F.struct("confidence", "support", "needs")).alias("best")).select(key, F.col("best.needs").alias("tokens"), F.col("best.confidence").alias("confidence"))


def fixed_rule(urls: DataFrame, rules: Sequence[FixedRule]) -> DataFrame:
    """``urls`` (with host and path) with rule and rule_verdict, null where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, then the longest host,
    then the last in code point order.
    """
    if not rules:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("rule_verdict", F.lit(None).cast("string"))
    given = F.array(*(F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(h + p).alias("rule"), F.lit(v).alias("rule_verdict")) for v, h, p in rules))
    table = urls.sparkSession.range(1).select(F.explode(given).alias("x")).select("x.*")
    index = table.groupBy("rule_host").agg(F.collect_list(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("m"), "rule", "rule_verdict", "rule_path")).alias("rs"))
    # Suffixes of distinct hosts fetch the rules; a host has as many suffixes as labels.
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    per = urls.select("host").distinct().select("host", suffix.alias("rule_host")).join(F.broadcast(index), "rule_host").groupBy("host").agg(F.flatten(F.collect_list("rs")).alias("rs"))  # the rules given
    met = urls.join(maybe_broadcast(materialize(per, "url-hosts")), "host", "left")
    best = F.array_max(F.filter("rs", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    return met.withColumn("__r", best).withColumn("rule", F.col("__r.rule")).withColumn("rule_verdict", F.col("__r.rule_verdict")).drop("rs", "__r")


def judge(pages: DataFrame, labelled: DataFrame, fixed: Sequence[FixedRule], id_col: str = "page_id", url_col: str = "url", **options: float) -> DataFrame:
    """id, host, path, rule, verdict, mined (the tokens of the rule that blocks), confidence for every row of ``pages``.

    ``labelled``: url and block (boolean). The fixed rule's verdict counts; else a mined rule that holds blocks, and what
    no rule blocks is allowed. Null URLs have an empty host and path and are allowed. Repeated rows are judged alike.
    """
    mined = materialize(mine(labelled, **options), "url-mined")
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    seen = urls.select("url").distinct().where("url is not null").withColumn("tokens", url_tokens(F.col("url")))
    hits = matched_rules(seen, mined, "url")
    hosted = fixed_rule(urls.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))), fixed)
    out = hosted.join(hits.withColumnRenamed("tokens", "mined"), "url", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "mined", "confidence")
