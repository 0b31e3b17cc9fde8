"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or no `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _folder(path: Column) -> Column:
    """Up to the last slash, itself included."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def _key(digest: Column) -> Column:
    """First 32 bits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """(host, path, rule, verdict) of every distinct host and path of `pages`, by `rules` (host, path, action).

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule (host plus path)
    wins; of equally long ones the action that sorts last (`block`), then the text that sorts last. Rules with a null
    are left out. A URL that no rule fits, an empty one too, gets `default`.

    Each rule is filed under host and the folder part of its path, as a SHA-256 digest. A URL is expanded into host
    suffixes times folder prefixes, no deeper than the deepest rule. Both sides meet by the first 32 bits of the digest;
    the full digest and the whole path are then confirmed. Equal host and path pairs are judged once.
    """
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action")).dropna()
    digest = _digest(F.col("r_host"), _folder(F.col("r_path")))
    rules = rules.withColumn("r_digest", digest).withColumn("key", _key(digest))
    deep = rules.agg(
        F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(0)),
        F.coalesce(F.max(F.size(F.split(_folder(F.col("r_path")), "/"))), F.lit(0)),
    ).first()
    urls = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).distinct()
    labels, steps = F.split("host", r"\."), F.split(_folder(F.col("path")), "/")
    # suffixes of 1..labels parts; prefixes "", "/", "/a/", ... that end in a slash
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deep[0], 1)))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(steps), F.lit(max(deep[1], 1)))),
        lambda i: F.when(i == 1, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, i - 1), "/"), F.lit("/"))),
    )
    asked = urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    asked = asked.select("host", "path", F.explode("prefixes").alias("prefix"), "suffix")
    digest = _digest(F.col("suffix"), F.col("prefix"))
    asked = asked.select("host", "path", digest.alias("digest")).withColumn("key", _key(F.col("digest")))
    found = asked.join(rules, "key").filter("digest = r_digest AND startswith(path, r_path)")
    name = F.concat("r_host", "r_path")
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("n"), F.col("r_action").alias("action"), name.alias("rule"))).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict, which replace columns of these names; one row per row of `pages`."""
    judged = judge_urls(pages, rules, url, default)
    judged = judged.select(*[F.col(c).alias(f"_j_{c}") for c in judged.columns])
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    wide = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    out = wide.join(judged, (wide["host"] == judged["_j_host"]) & (wide["path"] == judged["_j_path"]))
    return out.select(*kept, "host", "path", F.col("_j_rule").alias("rule"), F.col("_j_verdict").alias("verdict"))
