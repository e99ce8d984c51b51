"""URL filters: given host rules first, then association rules mined from labels.

A given rule (host, path) fits its host and all subdomains if the path starts with its path; the
longest fitting rule decides (longer host first, then longer path). Rules sit in a table keyed by host; a
URL looks up each suffix of its host, so the work follows the rules that can fit, not their number.

Where no given rule fits, mined rules decide. A URL becomes a set of tokens (scheme, words of the
host, path parts, file type, query names, fragment) and of the domains it lies in. FP-growth finds token sets that are frequent among
labelled URLs, each with a label token beside it; rules "tokens imply block" are kept above a confidence, a support and a
lift, and dropped if a rule with fewer tokens is as sure. The support of sets is a share of the labelled URLs, which bounds
FP-growth's items, and so misses a host that is rare in a large table. Single tokens and domains need only counts: for them a
fixed number of bad URLs is enough, if the lower bound of their confidence lies above the lift. The kept rules are an
inverted index: each is listed under its rarest token, so that a URL meets a rule at most once, and is then checked for
the other tokens. A URL that meets a rule is blocked, the surest one is named; no match means allow.

Defined cases: a null URL or one without ``://`` has an empty host and path, no given rule fits it and it has only the tokens that it
still shows; without labels, or with one label only, no rule blocks; repeated rows and ids each get a row; an
empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.llm.common import numbered
from txflow.session import cut

ALLOW, BLOCK = "allow", "block"
SUPPORT = 0.005
CONFIDENCE = 0.7
LIFT = 1.2  # how much likelier a block must be than among all labelled URLs
ROWS = 8  # bad URLs behind a rule of one token, whatever the size of the table
SIGMAS = 4.0  # of the lower bound of such a rule's confidence
LABELS = ("label:allow", "label:block")
DOMAIN = "domain:"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def apply_given(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` (host and path, null if none fits) and ``given`` (its verdict) to rows with ``_row``, ``host`` and ``path``."""
    table = urls.sparkSession.createDataFrame(
        [(h, p, v) for h, p, v in rules], T.StructType([T.StructField(n, T.StringType()) for n in ("_host", "_path", "_verdict")]))
    each = urls.select("_row", "path", F.explode(_suffixes(F.col("host"))).alias("_host"))
    fits = each.join(table, "_host").filter(F.startswith("path", F.col("_path")))
    order = F.struct(F.length("_host").alias("a"), F.length("_path").alias("b"), F.concat("_host", "_path").alias("rule"), F.col("_verdict").alias("given"))
    best = fits.groupBy("_row").agg(F.max(order).alias("_best")).select("_row", "_best.rule", "_best.given")
    return urls.join(best, "_row", "left")


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; ``domain:`` tokens are its host and all parent domains of two and more parts."""
    rest = F.coalesce(url, F.lit(""))
    scheme = F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(rest, r"(?s)^(.*?)://", 1)))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    kind = F.concat(F.lit("type:"), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)))
    query = F.regexp_extract(rest, r"(?s)\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1))), lambda x: x != "query:")
    fragment = F.when(F.contains(rest, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    domains = F.transform(F.filter(_suffixes(host), lambda x: F.contains(x, F.lit("."))), lambda x: F.concat(F.lit(DOMAIN), x))
    words = F.transform(F.filter(F.split(host, r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("word:"), x))
    return F.array_distinct(F.concat(
        F.filter(F.array(scheme, kind), lambda x: ~x.isin("scheme:", "type:")), words, F.transform(parts, lambda x: F.concat(F.lit("part:"), F.lower(x))), names, fragment, domains))


def lower_bound(hits: Column, n: Column, sigmas: float = SIGMAS) -> Column:
    """Wilson's lower bound of a share."""
    z, p = sigmas * sigmas, hits / n
    return (p + z / (2 * n) - sigmas * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, rows: int = ROWS) -> DataFrame:
    """(rule_id, key, tokens, confidence, support) from rows with ``tokens`` and a boolean ``bad``.

    Only frequent tokens enter a transaction, so its length, and with it the work of FP-growth, stays bounded
    by 1 / support; domains stay out, since their words are in. ``key`` is the rule's rarest token.
    """
    labelled = cut(labelled.filter("bad IS NOT NULL").select("tokens", "bad"))
    n, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    empty = "rule_id long, key string, tokens array<string>, confidence double, support double"
    if not n:
        return labelled.sparkSession.createDataFrame([], empty)
    # A token in every URL tells nothing and would double the sets.
    counts = cut(labelled.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("hits")).filter(((F.col("n") >= support * n) | (F.col("hits") >= rows)) & (F.col("n") < n)))
    items = counts.filter((F.col("n") >= support * n) & ~F.startswith("token", F.lit(DOMAIN))).select("token")
    kept = numbered(labelled).select("_row", "bad", F.explode("tokens").alias("token")).join(items, "token")
    sets = kept.groupBy("_row").agg(F.first("bad").alias("bad"), F.collect_set("token").alias("items"))
    items = sets.select(F.concat("items", F.array(F.when(F.col("bad"), LABELS[1]).otherwise(LABELS[0]))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.filter(
        (F.element_at("consequent", 1) == LABELS[1]) & ~F.array_contains("antecedent", LABELS[0]) & (F.col("lift") >= LIFT)).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    share = F.col("hits") / F.col("n")
    single = counts.filter((F.col("hits") >= rows) & (share >= confidence) & (lower_bound(F.col("hits"), F.col("n")) >= LIFT * bad / n)).select(
        F.array("token").alias("tokens"), share.alias("confidence"), (F.col("hits") / n).alias("support"))
    rules = cut(found.unionByName(single).groupBy("tokens").agg(F.max("confidence").alias("confidence"), F.max("support").alias("support"))
                .withColumn("rule_id", F.xxhash64("tokens")))
    # A rule says nothing new if one without one of its tokens is as sure: look it up under each such set.
    smaller = rules.filter(F.size("tokens") > 1).select("rule_id", F.col("confidence").alias("own"), F.explode(
        F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("tokens"))
    idle = smaller.join(rules.select("tokens", "confidence"), "tokens").filter("confidence >= own").select("rule_id").distinct()
    useful = rules.join(idle, "rule_id", "left_anti")
    rarest = useful.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token").groupBy("rule_id").agg(
        F.min(F.struct("n", "token")).alias("least")).select("rule_id", F.col("least.token").alias("key"))
    return cut(useful.join(rarest, "rule_id").select("rule_id", "key", "tokens", "confidence", "support"))


def apply_mined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``mined`` (the verdict) and ``mined_rule`` (tokens of the surest matching rule) to rows with ``_row`` and ``tokens``."""
    index = rules.select("key", F.col("tokens").alias("needed"), "rule_id", "confidence")
    each = urls.select("_row", "tokens", F.explode("tokens").alias("key"))
    met = each.join(index, "key").filter(F.size(F.array_except("needed", "tokens")) == 0)
    best = met.groupBy("_row").agg(F.max(F.struct("confidence", "rule_id", "needed")).alias("_rule"))
    return urls.join(best.select("_row", F.col("_rule.needed").alias("mined_rule")), "_row", "left").withColumn(
        "mined", F.when(F.col("mined_rule").isNotNull(), BLOCK).otherwise(ALLOW))


def judge(pages: DataFrame, labels: DataFrame, given: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url",
          support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = ROWS) -> DataFrame:
    """(key, host, path, rule, verdict, mined_rule) of every row; ``labels`` has ``url`` and a boolean ``bad``."""
    parsed = lambda df, c: df.withColumns({"host": host_of(F.col(c)), "path": path_of(F.col(c))})
    rows = parsed(numbered(pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))), "_url")
    rows = cut(rows.withColumn("tokens", tokens_of(F.col("_url"), F.col("host"), F.col("path"))).drop("_url"))
    train = parsed(labels.select("url", "bad"), "url")
    rules = mine(train.select(tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "bad"), support, confidence, least)
    out = apply_mined(apply_given(rows, given), rules)
    return out.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("given", "mined").alias("verdict"),
                      F.array_join("mined_rule", " ").alias("mined_rule"))
