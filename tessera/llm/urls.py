"""URL filters: every URL's host-suffix and path-prefix expressions meet the rules by short hash prefixes, full digests confirm.

A rule is a host and a path.  It fits the URLs of its host and all subdomains whose path starts with its own, character
by character; of the rules that fit, the one written longest wins (then the longer host, then `block`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that the join sees: 32 bits.
SHORT = 8
#: Rules up to this number are sent to every executor (about 200 bytes each); beyond it the join shuffles.
MOST_SENT = 100_000

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?` or `#`, A-Z in lower case; empty without a `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`; empty without a `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """short, digest, rule, size, host_size, labels, path_size, verdict of rules (host, path, verdict): each host and
    path once, `block` before `allow`.  Hosts are lower-cased; rules without a host, or whose path is neither empty nor
    begins with `/`, fit no URL and go; a null path is empty."""
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    rows = rules.filter(F.col("verdict").isin("allow", "block")).select(host.alias("h"), path.alias("p"), (F.col("verdict") == "block").alias("b")).filter("h <> '' and (p = '' or startswith(p, '/'))")
    rows = rows.groupBy("h", "p").agg(F.max("b").alias("b"))
    rows = rows.select(_digest(F.col("h"), F.col("p")).alias("digest"), F.concat("h", "p").alias("rule"), F.length("h").alias("host_size"), F.size(F.split("h", r"\.")).alias("labels"), F.length("p").alias("path_size"), F.when(F.col("b"), "block").otherwise("allow").alias("verdict"))
    return rows.select(F.substring("digest", 1, SHORT).alias("short"), "*", (F.col("host_size") + F.col("path_size")).alias("size"))


def expressions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, short, full: the expressions of each URL in the shapes (labels, characters of path) that rules have.

    A rule can only equal an expression of its own shape, so no others are made; very long paths and hosts with very many
    labels make no more rows than others."""
    shapes = rules.agg(F.collect_set(F.struct("labels", "path_size")).alias("shapes"))  # one row, a struct a shape
    rows = urls.crossJoin(F.broadcast(shapes)).withColumn("own", F.size(F.split("host", r"\.")))
    rows = rows.select("host", "path", F.explode(F.filter("shapes", lambda s: (s["labels"] <= F.col("own")) & (s["path_size"] <= F.length("path")))).alias("s"))
    digest = _digest(F.expr("substring_index(host, '.', -s.labels)"), F.expr("substring(path, 1, s.path_size)"))
    return rows.select("host", "path", digest.alias("full")).withColumn("short", F.substring("full", 1, SHORT))


def _hits(met: DataFrame, rules: DataFrame, most_sent: int) -> DataFrame:
    """Expressions and rules of one short prefix.  Few rules are broadcast.  Beyond that, prefixes that hold over a
    thousandth of all expressions (fewer than a thousand prefixes) are, and the others are shuffled."""
    if rules.count() <= most_sent:
        return met.join(F.broadcast(rules), "short")
    limit = met.count() // 1000
    hot = met.groupBy("short").count().filter(F.col("count") > limit).select("short")
    few = rules.join(F.broadcast(hot), "short")
    rest = met.join(F.broadcast(hot), "short", "left_anti").join(rules, "short")
    return met.join(F.broadcast(few), "short").unionByName(rest)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most_sent: int = MOST_SENT) -> DataFrame:
    """id, host, path, rule (host and path as one string, null if none fits) and verdict of every row of `pages`.

    URLs that no rule fits get `default`: a list of what is blocked blocks nothing else.  Null URLs and those without a
    `://` have an empty host, which no rule fits.  Repeated rows and null ids are judged row by row; other columns of
    `pages` are left out, whatever their names; an empty table gives an empty result, without rules all rows get `default`."""
    rules = prepared(rules)
    urls = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    met = expressions(urls.filter("host <> ''").select("host", "path"), rules)
    hits = _hits(met, rules, most_sent).filter("full = digest")
    best = hits.groupBy("host", "path").agg(F.max(F.struct("size", "host_size", F.col("verdict").alias("v"), "rule")).alias("best"))
    # rows without a host have no partner: dealt over many keys instead of one
    spread = F.when(F.col("host") == "", F.pmod(F.xxhash64(id_col), F.lit(4096))).otherwise(-1)
    out = urls.withColumn("spread", spread).join(best.withColumn("spread", F.lit(-1).cast("bigint")), ["host", "path", "spread"], "left")
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
