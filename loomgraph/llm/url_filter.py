"""URL filters: explicit rules of hosts and paths, then association rules mined from labels."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

#: Explicit rules: (host, path) and what they decide.
RULES = ((("net", "/"), "block"), (("example.net", "/en/"), "allow"), (("example.com", "/de/"), "block"), (("org", "/fr/"), "allow"))
BLOCK = "label=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def explicit_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host, or a subdomain of it, and the beginning of its path; and its verdict."""
    ranked = sorted(rules, key=lambda r: (-len(r[0][0] + r[0][1]), r[0]))
    name = verdict = F.lit(None).cast("string")
    for (h, p), decision in reversed(ranked):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: parts of the host and of the path, names of parameters, scheme; numbers as ``#``.

    The whole host is none: the parts that a set of tokens has say as much.
    """
    host, path = host_and_path(url)
    as_kind = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(F.lower(x), "[0-9]+", "#")))
    query = F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&")
    names = F.transform(query, lambda x: F.split(x, "=")[0])
    every = F.concat(as_kind("h:", F.split(host, r"\.")), as_kind("p:", F.split(path, "[/.]")), as_kind("q:", names), as_kind("s:", F.array(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))))
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def _parts(items: Column) -> Column:
    """All proper parts of a short array."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(items)) - 2)
    holds = lambda mask, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1
    return F.transform(masks, lambda mask: F.filter(items, lambda _, i: holds(mask, i)))


def mine_rules(
    labelled: DataFrame, *, least_support: float = 0.005, least_count: int = 20, least_confidence: float = 0.8, most_tokens: int = 4, common: float = 0.9,
    url_col: str = "url", bad_col: str = "bad",
) -> DataFrame:
    """Combinations of tokens that foretell a bad label: ``tokens, n, n_all, confidence``.

    FP-growth mines token sets of the bad URLs alone, as only those can foretell the label. A rule needs
    bad URLs that are a share ``least_support`` of all labelled ones, and ``least_count`` at least; how many labelled URLs have all its
    tokens (``n_all``) is counted over all of them by the inverted index, and the bad ones among those
    are its ``confidence``. Tokens of more than ``common`` of all labelled URLs are part of no rule, nor
    is a set of more than ``most_tokens``. A rule that contains a shorter one with at least its
    confidence is pruned.
    """
    spark, none = labelled.sparkSession, labelled.sparkSession.createDataFrame([], "tokens array<string>, n long, n_all long, confidence double")
    scratch = Scratch(spark, "urlrules")
    found = labelled.filter(F.col(url_col).isNotNull() & F.col(bad_col).isNotNull()).select(F.col(bad_col).alias("bad"), tokens(F.col(url_col)).alias("items"))
    found = scratch.keep(found.groupBy("items").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("bad").alias("n_bad")), "baskets")
    n, n_bad = found.agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("n_bad"), F.lit(0))).first()
    wanted = max(least_support * n, least_count)
    if not n_bad or n_bad < wanted:
        return none
    counts = scratch.keep(found.select("n_all", F.explode("items").alias("token")).groupBy("token").agg(F.sum("n_all").alias("count")), "counts")
    every = counts.filter(F.col("count") > common * n).agg(F.collect_list("token")).first()[0]  # few: each is in most URLs
    kept = F.array_except("items", F.array(*map(F.lit, every)).cast("array<string>"))
    baskets = found.filter("n_bad > 0").select(kept.alias("items"), F.explode(F.sequence(F.lit(1), F.col("n_bad").cast("int"))).alias("copy")).select("items")
    model = FPGrowth(itemsCol="items", minSupport=wanted / n_bad).fit(baskets)
    sets = model.freqItemsets.filter((F.size("items") <= most_tokens) & (F.col("freq") >= wanted)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    sets = scratch.keep(sets.filter(F.size("tokens") > 0), "sets")
    held = _holding(found.select("items", "n_all"), sets, counts).groupBy("tokens").agg(F.sum("n_all").alias("n_all"))
    rules = sets.join(held, "tokens").withColumn("confidence", F.col("n") / F.col("n_all")).select("tokens", "n", "n_all", "confidence")
    scratch.keep(rules, "mined")  # with what falls short, for a look at it
    rules = scratch.keep(scratch.open("mined", rules).filter(F.col("confidence") >= least_confidence), "rules")
    shorter = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("other"))
    parts = rules.filter(F.size("tokens") > 1).select("tokens", "confidence", F.explode(_parts(F.col("tokens"))).alias("part"))
    worse = parts.join(shorter, "part").filter("other >= confidence").select("tokens").distinct()
    return rules.join(worse, "tokens", "left_anti")


def _holding(baskets: DataFrame, sets: DataFrame, counts: DataFrame) -> DataFrame:
    """Baskets (``items`` and more) with each set (``tokens`` and more) they hold.

    The inverted index has each set under its rarest token, so only baskets with that token are compared.
    """
    each = sets.select("tokens", F.explode("tokens").alias("token")).join(counts, "token", "left")
    index = each.groupBy("tokens").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    return baskets.withColumn("token", F.explode("items")).join(index, "token").filter(F.size(F.array_except("tokens", "items")) == 0).drop("token")


def matched_urls(urls: DataFrame, rules: DataFrame, token_counts: DataFrame) -> DataFrame:
    """URLs (``url, items``) that hold all tokens of a rule: ``url, mined`` (the matching rule of most confidence)."""
    has = _holding(urls, rules, token_counts).join(rules.select("tokens", "confidence"), "tokens")
    return has.groupBy("url").agg(F.max_by(F.array_join("tokens", " & "), F.struct("confidence", "tokens")).alias("mined"))


def judge_urls(pages: DataFrame, labelled: DataFrame, *, rules=RULES, least_support: float = 0.005, least_count: int = 20, least_confidence: float = 0.8, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL: ``page_id, host, path, rule, verdict, mined``.

    The longest explicit rule decides; otherwise a URL that matches a mined rule (``mined``) is blocked,
    any other allowed. ``labelled`` has columns ``url`` and ``bad``.

    Null URL or one without ``://``: host and path empty, no rule. Very long URLs: whole. Null ids: kept. Repeated rows: judged
    alike. Ties among mined rules: the greater list of tokens. No labels: no mined rules. Empty table:
    no rows. Other columns are not read.
    """
    url = F.col(url_col)
    host, path = host_and_path(url)
    plain = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    plain = plain.withColumn("rule", name).withColumn("decided", verdict)
    mined = mine_rules(labelled, least_support=least_support, least_count=least_count, least_confidence=least_confidence)
    scratch = Scratch(pages.sparkSession, "urls")
    mined = scratch.keep(mined, "mined")
    undecided = scratch.keep(plain.filter("rule IS NULL AND url IS NOT NULL").select("url").distinct().withColumn("items", tokens(F.col("url"))), "undecided")
    counts = undecided.select(F.explode("items").alias("token")).groupBy("token").count()
    matched = matched_urls(undecided, mined, counts)
    out = plain.join(matched, "url", "left")
    verdict = F.coalesce("decided", F.when(F.col("mined").isNotNull(), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"))
