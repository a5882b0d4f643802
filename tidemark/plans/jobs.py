"""Jobs that put the operators together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import change, text
from tidemark.functions.trust import DEFAULT_POLICY
from tidemark.operators import enrich, labels, parse, sampling, scoring
from tidemark.operators.labels import LIVE, LabelRules
from tidemark.session import scratch, stored
from tidemark.sources.tables import append_runs, read_or_no_runs, read_runs

SEALED = "sealed"
ANSWER_SCHEMA = "rev_id BIGINT, raw STRING, latency_ms DOUBLE, tokens_in BIGINT, tokens_out BIGINT, model_version STRING"


class Scorer(Protocol):
    """An external model: opened once per partition, answers one Arrow batch at a time.

    Transport failures are retried inside; rows it cannot answer are left out, so
    the next run asks again.
    """

    config: str

    def open(self) -> Callable[[pd.DataFrame], pd.DataFrame]:
        """A function from (rev_id, request columns) to rows of ``ANSWER_SCHEMA``."""


def edits_to_scored(raw: DataFrame, accounts: DataFrame, policy: str = DEFAULT_POLICY, wiki: str = "enwiki") -> DataFrame:
    """Raw log to filtered edits in one plan: parse, enrich, decide."""
    edits = parse.edits(parse.parse(raw), wiki)
    return enrich.with_filter(enrich.attach_accounts(edits, accounts), policy)


def parsed_once(parsed: DataFrame) -> DataFrame:
    """The parsed log stored without its payloads, for jobs that read it more than once."""
    return stored(parsed.drop("value"), "parsed")


def _edits_and_labels(parsed: DataFrame, rules: LabelRules) -> tuple[DataFrame, DataFrame]:
    """The edits of a log and their labels, (rev_id, label). Payloads are parsed once, for both."""
    typed = parsed_once(parsed)
    edits = parse.last_by_key(parse.edits(typed, rules.wiki), "rev_id", "offset")
    return edits, labels.label_log(typed, rules).select("rev_id", "label")


def labelled_edits(parsed: DataFrame, accounts: DataFrame, rules: LabelRules = LIVE) -> DataFrame:
    """One row per edit: the filter's inputs and its label code 1/0/gone, NULL while its window is open."""
    edits, found = _edits_and_labels(parsed, rules)
    labelled = edits.join(found, "rev_id", "left")
    code = F.when(F.col("label").isNotNull(), change.label_code(F.col("label")))
    return enrich.attach_accounts(labelled, accounts).withColumn("code", code)


def filter_table(parsed: DataFrame, accounts: DataFrame, rules: LabelRules = LIVE) -> DataFrame:
    """``labelled_edits`` of a log that covers every window; an edit without a label fails the job."""
    missing = F.raise_error(F.concat(F.lit("no label for revision "), F.col("rev_id"))).cast("boolean")
    return labelled_edits(parsed, accounts, rules).where(F.when(F.col("code").isNotNull(), F.lit(True)).otherwise(missing))


def trade_off(parsed: DataFrame, accounts: DataFrame, rules: LabelRules = LIVE) -> DataFrame:
    """Flagship: per policy, the share of volume removed and of reverted edits lost.

    Edits whose window is still open have no say in the shares; ``open_edits`` counts them.
    """
    columns = ["user_class", "account", "timestamp", "code"]
    table = stored(labelled_edits(parsed, accounts, rules).select(*columns), "filter-table")
    known = table.where(F.col("code").isNotNull()).withColumn("reverted", F.when(F.col("code") != "gone", F.col("code") == "1"))
    waiting = table.agg(F.count_if(F.col("code").isNull())).scalar()
    return scoring.trade_off(enrich.per_policy(known), []).withColumn("open_edits", waiting)


def evaluation_set(parsed: DataFrame, accounts: DataFrame, name: str, n: int, seed: int, rules: LabelRules = LIVE) -> DataFrame:
    """A sample of edits that pass the default filter, with features and label.

    An edit without a label fails the job: the log does not cover its window.
    """
    edits, found = _edits_and_labels(parsed, rules)
    missing = F.raise_error(F.concat(F.lit("no label for revision "), F.col("rev_id"))).cast("string")
    labelled = edits.join(found, "rev_id", "left").withColumn("label", F.coalesce("label", missing))
    scored = enrich.with_filter(enrich.attach_accounts(labelled, accounts)).where("filter.keep")
    chosen = sampling.sample(scored, "rev_id", n, seed)
    return enrich.features(chosen, extra=("label",)).withColumn("set", F.lit(name))


def score_with(edits: DataFrame, scorer: Scorer, request: Column) -> DataFrame:
    """Send requests to a scorer and read its answers; one client per partition."""
    asked = edits.select("set", "rev_id", request.alias("request")).select("set", "rev_id", "request.*")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = scorer.open()
        for batch in batches:
            out = ask(batch)
            yield out.merge(batch[["rev_id", "set"]], on="rev_id")

    return _read_answers(asked.mapInPandas(answer, ANSWER_SCHEMA + ", `set` STRING"), scorer.config)


def score_from(edits: DataFrame, answers: DataFrame, config: str) -> DataFrame:
    """Answers that were given elsewhere and stored, read like a scorer's own; an edit without one gets no row.

    ``answers`` has the columns of ``ANSWER_SCHEMA``.
    """
    return _read_answers(edits.select("set", "rev_id").join(answers, "rev_id"), config)


def _read_answers(answers: DataFrame, config: str) -> DataFrame:
    return answers.withColumn("__a", text.parse_answer(F.col("raw"))).select(
        "rev_id",
        "__a.revert",
        "__a.p_revert",
        "__a.invalid",
        "raw",
        F.floor(F.col("latency_ms") + 0.5).cast("double").alias("latency_ms"),
        "tokens_in",
        "tokens_out",
        "model_version",
        F.current_timestamp().alias("at"),
        "set",
        F.lit(config).alias("config"),
    )


def pending(edits: DataFrame, runs: DataFrame, config: str) -> DataFrame:
    """The edits a configuration has no row for yet. A sealed set is scored once."""
    own = runs.where(F.col("config") == config)
    sealed = edits.where(F.col("set") == SEALED)
    if not sealed.isEmpty() and scoring.unanswered(sealed, own).isEmpty():
        raise ValueError(f"{config} is already scored on the sealed set")
    return scoring.unanswered(edits, own)


def resume(edits: DataFrame, runs: DataFrame, scorer: Scorer, request: Column) -> DataFrame:
    """The answers a run still lacks, all of them."""
    return score_with(pending(edits, runs, scorer.config), scorer, request)


def score_into(edits: DataFrame, path: str, config: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append to the run table at ``path`` what ``config`` lacks there, and return the table.

    ``score`` turns edits into run rows. After a failure the job is run again: rows that
    were appended are not asked for a second time.
    """
    spark = edits.sparkSession
    # Stored first: the plan reads the table it appends to.
    rows = stored(score(pending(edits, read_or_no_runs(spark, path), config)), "answers")
    append_runs(rows, path)
    return read_runs(spark, path)


def through_table(df: DataFrame, name: str, write: Callable[[DataFrame, str], None], read: Callable) -> DataFrame:
    """Write ``df`` below the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    write(df, path)
    return read(df.sparkSession, path)
