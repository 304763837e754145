"""Verdicts on URLs: host and path rules first, then a list of blocked URLs.

The list is looked up by canonical URL. A blocked Bloom filter, one 64-bit block per key, holds
the list in at most ``MOST_BLOCKS`` blocks; it is broadcast, and its size is bounded by that
number whatever the list. URLs that it lets pass as possible hits go to an exact hash join with
the list, which removes the false ones. A list too long for the filter makes more false hits,
never a wrong verdict.

Null URLs and URLs without ``://`` have an empty host and path: no rule fits, no list entry
matches, they are allowed. Every row gets its verdict, repeats included. Only the two named
columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.llm import bloom
from tallyvine.sources.scratch import store

# Verdict and rule, host and path.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
MOST_BLOCKS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.``, path without slashes at its end; null for an empty host."""
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, "/+$", "")))


def with_rule(frame: DataFrame, rules=RULES) -> DataFrame:
    """``frame`` (host, path) with rule and rule_verdict: of the rules that fit, the longest."""
    found, nothing = [], F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda x: -len(x[1])):
        host, slash, path = text.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits &= F.col("path").startswith(slash + path)
        found.append((F.when(fits, F.lit(text)), F.when(fits, F.lit(kind))))
    rule, verdict = (F.coalesce(*[pair[k] for pair in found], nothing) for k in (0, 1))
    return frame.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    listed_column: str = "url",
    rules=RULES,
) -> DataFrame:
    """Per row of ``pages``: id, host, path, rule and verdict (``allow`` or ``block``)."""
    entry = canonical(*host_and_path(F.col(listed_column)))
    keys = store(listed.select(entry.alias("canonical")).where("canonical is not null").distinct())
    blocks = bloom.block_count(keys.count(), MOST_BLOCKS)
    held = bloom.build(keys, "canonical", blocks)
    host, path = host_and_path(F.col(url_column))
    judged = pages.select(F.col(id_column).alias("__id"), host.alias("host"), path.alias("path"))
    judged = with_rule(judged, rules).select("*", canonical(F.col("host"), F.col("path")).alias("canonical"))
    # A URL with a rule needs no look-up.
    judged = judged.select("*", F.when(F.col("rule").isNull(), F.col("canonical")).alias("key"))
    probed = bloom.probe(judged, "key", held, blocks)
    exact = probed.where("__possible").join(keys.select("canonical", F.lit("block").alias("found")), "canonical", "left")
    out = [F.col("__id").alias(id_column), "host", "path", "rule"]
    sure = probed.where(~F.col("__possible")).select(*out, F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    return sure.unionByName(exact.select(*out, F.coalesce("found", F.lit("allow")).alias("verdict")))
