"""Block and allow rules for addresses, found by hashed host and path expressions.

The project's change events name a page by wiki and title and hold no address of their
own, so this operator is general: it takes any table with a ``url`` column.

Each address is expanded into every (host suffix, path prefix) expression that a rule
could have: host suffixes cut at dots, path prefixes of the lengths that rules have. An
expression joins the rules on the first 32 bits of its SHA-256, an equi-join on an integer; a
candidate counts only if the full digests agree. Of the rules that fit, precedence decides.
Addresses are reduced to distinct ones first, so a host with a third of all rows is
expanded once per address, not once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # A host holds no line break before its path here, so the pair cannot be cut in two ways.
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their name, digest, hash prefix and rank.

    Of rules that fit, the longest host plus path wins; of equally long ones the longer
    host, then ``block``. Repeated rules collapse. A rule with a NULL part is no rule.
    """
    r = rules.select("host", "path", "verdict").where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    one = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rank = F.struct(
        (F.char_length("host") + F.char_length("path")).alias("length"),
        F.char_length("host").alias("host_length"),
        (F.col("verdict") == BLOCK).cast("int").alias("blocks"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    digest = _digest(F.col("host"), F.col("path"))
    return one.select(F.char_length("path").alias("path_length"), digest.alias("digest"), _short(digest).alias("short"), rank.alias("rank"))


def judged_addresses(rows: DataFrame, rules: DataFrame, *, default: str = ALLOW) -> DataFrame:
    """``rows`` with host, path, rule and verdict of their ``url`` in a struct ``address``.

    All columns stay, but one called ``address`` is replaced. ``rules`` is (host, path,
    verdict); a rule fits its host and all subdomains if the path starts with the rule's.
    Without a fitting rule, ``rule`` is NULL and the verdict is ``default``. A NULL address
    or one without ``://`` has an empty host and path, which no rule fits. Repeated rows
    get equal answers. No rows in, none out; without rules everything is ``default``.
    """
    table = stored(rule_table(rules), "rules")
    lengths = table.agg(F.coalesce(F.array_sort(F.collect_set("path_length")), F.array().cast("array<int>")).alias("l")).scalar()
    split = rows.where(F.col("url").isNotNull()).select("url").distinct()
    split = split.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), lengths.alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    # A path's prefixes of the lengths that rules have: no other expression could match.
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        split.where(F.col("host") != "")
        .select("url", F.explode(suffixes).alias("host"), prefixes.alias("prefixes"))
        .where(F.col("host") != "")
        .select("url", "host", F.explode("prefixes").alias("path"))
        .select("url", _digest(F.col("host"), F.col("path")).alias("full"))
        .withColumn("short", _short(F.col("full")))
    )
    candidates = expressions.join(table.select("short", "digest", "rank"), "short")
    found = candidates.where(F.col("full") == F.col("digest")).groupBy("url").agg(F.max("rank").alias("rank"))
    answers = found.select(F.col("url").alias("__url"), F.col("rank.rule").alias("__rule"), F.col("rank.verdict").alias("__verdict"))
    joined = rows.join(answers, F.col("url") == F.col("__url"), "left")
    address = F.struct(
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("__rule").alias("rule"),
        F.coalesce("__verdict", F.lit(default)).alias("verdict"),
    )
    return joined.withColumn("address", address).drop("__url", "__rule", "__verdict")
