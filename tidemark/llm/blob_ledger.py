"""Secrets in page texts, scanned once per distinct text and rule version.

A page version is ``(title, rev_id, diff)``: the path, the version and its text. Every version is
addressed by the SHA-256 of its text. The ledger, a table of (blob, rule, rule_version),
says what has been scanned; a scan reads only the pairs it does not list, one version for
each blob, and appends its findings and the pairs. Findings then join back to every path
and version that holds the blob. A text that owns a third of all rows is scanned once.

Column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch, stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates from left to right; one whose ``group`` is shorter than ``least`` is dropped.

    ``hint`` is a cheaper pattern that matches wherever a finding exists.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


#: The stated rules, in the order of their kinds.
RULES = (
    Rule(
        "assign",
        1,
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
        "[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{6}",
    ),
    # Runs shorter than the least length hold no finding, so the length may stand in the pattern.
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
)

_LEDGER = "blob string, kind string, version int"
_FINDINGS = "blob string, kind string, version int, spans array<struct<kind:string,start:bigint,end:bigint>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (kind, start, end) of a rule's findings, in code points, end exclusive.

    What a pattern cuts a text into alternates with what it matches, so running lengths give places.
    """
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.char_length(part["gap"])
        return _let(
            start,
            lambda s: F.struct(
                (s + F.coalesce(F.char_length(part["hit"]), F.lit(0))).cast("bigint").alias("at"),
                F.when(
                    F.char_length(part["value"]) >= rule.least,
                    F.concat(
                        acc["found"],
                        F.array(F.struct(F.lit(rule.kind).alias("kind"), s.cast("bigint").alias("start"), (s + F.char_length(part["hit"])).cast("bigint").alias("end"))),
                    ),
                )
                .otherwise(acc["found"])
                .alias("found"),
            ),
        )

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found"))
    walk = F.aggregate(parts, begin, step, lambda acc: acc["found"])
    return F.when(text.rlike(rule.hint), walk).otherwise(none)


class Ledger:
    """Two append-only tables under one folder: scanned pairs and findings."""

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.folder = folder or scratch(spark, "blob-ledger")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", _LEDGER)

    def findings(self) -> DataFrame:
        """A pair counts once, also where a scan was repeated after a failure between its two appends."""
        found = self._read("findings", _FINDINGS)
        return found.groupBy("blob", "kind", "version").agg(F.first("spans").alias("spans"))

    def append(self, found: DataFrame) -> None:
        """Findings first: a pair is only listed as scanned once its findings are there."""
        found.where(F.size("spans") > 0).write.mode("append").parquet(f"{self.folder}/findings")
        found.select("blob", "kind", "version").write.mode("append").parquet(f"{self.folder}/scanned")


def _versions(versions: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("diff").cast("string"), F.lit(""))
    return versions.select(F.col("title").cast("string").alias("title"), F.col("rev_id").cast("bigint").alias("rev_id"), text.alias("diff"))


def addressed(versions: DataFrame) -> DataFrame:
    """(title, rev_id, blob) of every version, texts left behind."""
    v = _versions(versions)
    return v.select("title", "rev_id", blob_of(F.col("diff")).alias("blob"))


def scan_unseen(versions: DataFrame, addresses: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan each (blob, rule version) that the ledger does not list and append what is found."""
    spark = versions.sparkSession
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    seen = ledger.scanned().join(F.broadcast(wanted), ["kind", "version"], "left_semi")
    done = seen.groupBy("blob").agg(F.collect_set("kind").alias("done"))
    # One version stands for each blob; the narrow pick meets the texts on blob and version.
    pick = F.min(F.struct(F.col("rev_id").isNull().alias("n"), "rev_id", F.col("title").isNull().alias("m"), "title"))
    one = addresses.groupBy("blob").agg(pick.alias("p")).join(done, "blob", "left")
    open_ = one.where(F.coalesce(F.size("done"), F.lit(0)) < len(rules)).select("blob", F.col("p.rev_id").alias("r"), F.col("p.title").alias("t"), "done")
    v = _versions(versions).withColumn("b", blob_of(F.col("diff")))
    same = (F.col("b") == F.col("blob")) & F.col("rev_id").eqNullSafe(F.col("r")) & F.col("title").eqNullSafe(F.col("t"))
    texts = v.join(open_, same).select("blob", "diff", F.coalesce("done", F.array().cast("array<string>")).alias("done"))
    scans = F.array(
        *[
            F.when(
                ~F.array_contains("done", r.kind),
                F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("diff"), r).alias("spans")),
            )
            for r in rules
        ]
    )
    found = texts.select("blob", F.explode(F.array_compact(scans)).alias("s")).select("blob", "s.*")
    ledger.append(stored(found, "blob-scan"))


def secrets(versions: DataFrame, *, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(title, rev_id, blob, spans) of every version; unseen blobs are scanned first.

    ``versions`` needs ``title``, ``rev_id`` and ``diff``; other columns are ignored. A NULL
    text is an empty one. Spans are ordered by start, then by the rules' order, and found in
    whole texts; kinds may overlap each other. A repeated row gets the same spans again. A
    ledger from an earlier call makes this one scan only new blobs and new rule versions. No
    rows in, none out.
    """
    ledger = ledger or Ledger(versions.sparkSession)
    addresses = stored(addressed(versions), "blob-addresses")
    scan_unseen(versions, addresses, ledger, rules)
    current = reduce(lambda a, b: a | b, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    flat = F.flatten(F.collect_list("spans"))
    ranked = F.transform(flat, lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    # At most one row per rule and blob.
    per_blob = ledger.findings().where(current).groupBy("blob").agg(F.sort_array(ranked).alias("ranked"))
    per_blob = per_blob.select("blob", F.transform("ranked", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return addresses.join(per_blob, "blob", "left").select("title", "rev_id", "blob", F.coalesce("spans", empty).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every stretch that spans cover replaced by ``mark``; touching or nested spans become one mark."""
    pair = "array<struct<start:bigint,end:bigint>>"

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        widened = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), widened).otherwise(
            F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        )

    def cut(runs: Column) -> Column:
        begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(runs, lambda r: r["end"]))
        ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.char_length(text).cast("bigint")))
        kept = F.zip_with(begins, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
        return F.array_join(kept, mark)

    runs = F.aggregate(spans, F.array().cast(pair), add)
    return F.when(F.coalesce(F.size(spans), F.lit(0)) == 0, text).otherwise(_let(runs, cut))
