"""Markup, diff, request and answer texts, and scoring through them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from tidemark.catalog import bindings as b
from tidemark.catalog.label_queries import LONG_SQL, drawn_features
from tidemark.catalog.sql import ACCOUNTS, LOG, PAIRS, query
from tidemark.functions import text
from tidemark.operators import enrich
from tidemark.plans import jobs
from tidemark.session import scratch, stored

Q: dict = {}


def register(name: str, sql: str | None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


def decode_sql(x: str) -> str:
    for entity, char in text.ENTITIES:
        char = char.replace("'", "''")
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def strip_sql(x: str) -> str:
    return decode_sql(f"regexp_replace({x}, '<[^>]+>', '', 'g')")


def trim_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


@register("page_text", f"SELECT page_id, md5({strip_sql('html')}) AS text_md5, length({strip_sql('html')}) AS chars FROM pages")
def page_text(spark, sf):
    plain = text.strip_tags(F.col("html"))
    return b.load(spark, sf, "pages").select("page_id", F.md5(plain).alias("text_md5"), F.length(plain).cast("bigint").alias("chars"))


def diff_html(asked, answered):
    """A two-row diff: the question line removed, the answer line added with its tail marked."""
    tail = F.substring(answered, F.lit(11), F.length(answered))
    return F.concat(
        F.lit('<tr><td class="diff-marker">-</td><td class="diff-deletedline diff-side"><div>'), asked,
        F.lit('</div></td></tr><tr><td class="diff-addedline"><div>'), F.substring(answered, 1, 10), F.lit('<ins class="diffchange diffchange-inline">'), tail,
        F.lit("</ins> end &amp; more</div></td></tr>"),
    )


CELLS = PAIRS + f""",
cells AS (SELECT conv_id, turn, {trim_sql(strip_sql('asked'))} AS d, substr(answered, 1, 10) AS head, {strip_sql('substr(answered, 11)')} AS tail FROM turn_pairs),
lines AS (SELECT conv_id, turn, CASE WHEN d <> '' THEN '- ' || d || chr(10) ELSE '' END || '+ ' || regexp_replace(head, '^\\s+', '') || '{{+' || tail || '+}} end & more' AS text FROM cells)"""


@register("diff_texts", query(CELLS.replace("{{", "{").replace("}}", "}"), "SELECT conv_id, turn, text FROM lines"))
def diff_texts(spark, sf):
    return b.turn_pairs(spark, sf).select("conv_id", "turn", text.diff_text(diff_html(F.col("asked"), F.col("answered"))).alias("text"))


def edit_features(spark, sf):
    """Turn pairs dressed as edits."""
    n = F.col("conv_id") * 100 + F.col("turn")
    size = F.length("answered") - F.length("asked")
    return b.turn_pairs(spark, sf).select(
        F.lit("dev").alias("set"), n.alias("rev_id"), F.concat(F.lit("Talk "), "conv_id").alias("title"), (n % 5 == 0).alias("is_new"), (n % 3 == 0).alias("minor"),
        F.when(n % 4 == 0, "temporary").otherwise("registered").alias("user_class"),
        F.when(n % 4 != 0, F.when(n % 7 == 0, 0.5).otherwise((n % 300).cast("double") + 0.25)).alias("account_age_days"),
        F.when((n % 4 != 0) & (n % 11 != 0), n % 1000).alias("editcount"), size.cast("bigint").alias("size_delta"),
        F.when(n % 6 == 0, "  ").otherwise(F.concat(F.lit(" see "), "conv_id")).alias("comment"),
        F.when(n % 9 == 0, "").otherwise(F.concat(F.lit("+ "), F.col("asked"))).alias("diff"), F.when(n % 13 == 0, "suppressed").alias("diff_unavailable"),
    )


EDITS = PAIRS + """,
f AS (SELECT *, conv_id * 100 + turn AS n FROM turn_pairs),
rendered AS (SELECT n AS rev_id, 'Article: Talk ' || conv_id || chr(10) || 'Kind of edit: ' || CASE WHEN n % 5 = 0 THEN 'creates the page' ELSE 'changes the page' END || CASE WHEN n % 3 = 0 THEN ' (said to be minor)' ELSE '' END || chr(10)
  || 'Editor: ' || CASE WHEN n % 4 = 0 THEN 'visitor with a temporary name' WHEN n % 11 = 0 THEN 'member, history unknown'
     ELSE 'member for ' || CASE WHEN n % 7 = 0 OR n % 300 = 0 AND false THEN 'under one day' WHEN n % 300 = 0 THEN 'under one day' ELSE (n % 300) || ' days' END || ' with ' || (n % 1000) || ' contributions' END || chr(10)
  || 'Size change: ' || CASE WHEN length(answered) > length(asked) THEN '+' ELSE '' END || (length(answered) - length(asked)) || ' bytes' || chr(10)
  || 'Edit summary: ' || CASE WHEN n % 6 = 0 THEN '<empty>' ELSE 'see ' || conv_id END || chr(10) || chr(10)
  || 'Changes ("- " lines removed, "+ " lines added; inside a line, [-text-] was removed and {+text+} was added):' || chr(10)
  || CASE WHEN n % 13 = 0 THEN '<diff missing>' WHEN n % 5 = 0 THEN 'whole text:' || chr(10) || CASE WHEN n % 9 = 0 THEN '' ELSE '+ ' || asked END
     WHEN n % 9 = 0 THEN '<text unchanged>' ELSE '+ ' || asked END AS body FROM f)"""


@register("edit_texts", query(EDITS, "SELECT rev_id, regexp_replace(body, '\\s+$', '') AS body FROM rendered"))
def edit_texts(spark, sf):
    return edit_features(spark, sf).select("rev_id", text.render_edit().alias("body"))


REQUEST_FILE = """### system
Judge the edit. Answer with JSON only.

### user
Here it is.
{{edit}}
"""


@register("scorer_requests", query(EDITS, "SELECT rev_id, 'Judge the edit. Answer with JSON only.' AS system, 'Here it is.' || chr(10) || regexp_replace(body, '\\s+$', '') AS \"user\" FROM rendered"))
def scorer_requests(spark, sf):
    rows = edit_features(spark, sf)
    return rows.select("rev_id", text.request(REQUEST_FILE, text.render_edit()).alias("r")).select("rev_id", "r.*")


def answers(spark, sf):
    """Eight shapes of answers, by conversation."""
    n = F.col("conv_id") * 100 + F.col("turn")
    p = (n % 101).cast("double") / 100
    good = F.to_json(F.struct((n % 2 == 0).alias("revert"), p.alias("p_revert")))
    raw = (
        F.when(n % 8 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(n % 8 == 1, F.concat(F.lit("Sure: "), good))
        .when(n % 8 == 2, F.to_json(F.struct(F.lit("true").alias("revert"), p.alias("p_revert"))))
        .when(n % 8 == 3, F.to_json(F.struct(F.lit(True).alias("revert"), (p + 1.5).alias("p_revert"))))
        .when(n % 8 == 4, F.concat(F.lit("  "), good, F.lit("\n")))
        .when(n % 8 == 5, F.to_json(F.struct(F.lit("asked first").alias("reason"), F.lit(True).alias("revert"), F.lit(1).alias("p_revert"))))
        .when(n % 8 == 6, F.lit("[1, 2]"))
        .otherwise(good)
    )
    return b.turn_pairs(spark, sf).select(n.alias("rev_id"), raw.alias("raw"))


@register(
    "parsed_answers",
    query(PAIRS, """SELECT n AS rev_id, CASE WHEN n % 8 IN (0, 4, 7) THEN n % 2 = 0 WHEN n % 8 = 5 THEN true END AS revert, CASE WHEN n % 8 IN (0, 4, 7) THEN (n % 101)::DOUBLE / 100 WHEN n % 8 = 5 THEN 1.0::DOUBLE END AS p_revert,
  CASE WHEN n % 8 = 1 THEN 'not JSON' WHEN n % 8 IN (2, 3, 6) THEN 'wrong shape' END AS invalid FROM (SELECT conv_id * 100 + turn AS n FROM turn_pairs)"""),
)
def parsed_answers(spark, sf):
    return answers(spark, sf).select("rev_id", text.parse_answer(F.col("raw")).alias("a")).select("rev_id", "a.*")


CONFIG = "stored__plain"


def stored_answers(spark, sf):
    """What a model answered, with what it cost."""
    n = F.col("rev_id")
    return answers(spark, sf).select(
        "rev_id", "raw", (n % 700 + 0.5).cast("double").alias("latency_ms"), (n % 90).alias("tokens_in"), F.lit(12).cast("bigint").alias("tokens_out"), F.lit("s@1").alias("model_version")
    )


ANSWERED = """SELECT n AS rev_id, CASE WHEN n % 8 IN (0, 4, 7) THEN n % 2 = 0 WHEN n % 8 = 5 THEN true END AS revert, CASE WHEN n % 8 IN (0, 4, 7) THEN (n % 101)::DOUBLE / 100 WHEN n % 8 = 5 THEN 1.0::DOUBLE END AS p_revert,
  CASE WHEN n % 8 = 1 THEN 'not JSON' WHEN n % 8 IN (2, 3, 6) THEN 'wrong shape' END AS invalid, (n % 700 + 1)::DOUBLE AS latency_ms, n % 90 AS tokens_in FROM (SELECT conv_id * 100 + turn AS n FROM turn_pairs)"""


@register("scored_by_model", query(PAIRS, ANSWERED))
def scored_by_model(spark, sf):
    """Stored answers of a model onto the edits they belong to."""
    rows = jobs.score_from(edit_features(spark, sf), stored_answers(spark, sf), CONFIG)
    return rows.select("rev_id", "revert", "p_revert", "invalid", "latency_ms", "tokens_in")


@register("resumed_scoring", query(PAIRS, ANSWERED))
def resumed_scoring(spark, sf):
    """A run that stopped after a part of the edits, run again to its end; every edit has one row."""
    path, edits, given = scratch(spark, "runs"), edit_features(spark, sf), stored_answers(spark, sf)
    score = lambda todo: jobs.score_from(todo, given, CONFIG)
    jobs.score_into(edits.where("rev_id % 2 = 0"), path, CONFIG, score)
    runs = jobs.score_into(edits, path, CONFIG, score)
    return runs.select("rev_id", "revert", "p_revert", "invalid", "latency_ms", "tokens_in")


class KeywordScorer:
    """Answers from what stands in the request alone, as an external model would."""

    config = "keywords__plain"

    def open(self):
        def ask(batch):
            told = batch["user"].str
            temporary, new, missing = told.contains("visitor with a temporary name"), told.contains("creates the page"), told.contains("<diff missing>")
            p = 0.25 + 0.5 * temporary + 0.125 * new
            raw = [json.dumps({"revert": bool(q >= 0.5), "p_revert": float(q)}) if not m else "I cannot see the diff" for q, m in zip(p, missing, strict=True)]
            shown = told.count(r"\{\+note \d+\+\}")
            return pd.DataFrame({"rev_id": batch["rev_id"], "raw": raw, "latency_ms": 10.0 + shown, "tokens_in": shown, "tokens_out": 3, "model_version": "k@1"})

        return ask


def fetched_diffs(spark, sf):
    """A table diff for most edits of the log: two of eleven hidden or never fetched."""
    rows = b.facts(spark, sf).where("k % 11 <> 1").withColumn("reason", F.when(F.col("k") % 11 == 2, "suppressed"))
    marked = F.concat(F.lit('<td class="diff-addedline"><div><ins class="diffchange">note '), F.col("k"), F.lit("</ins></div></td>"))
    return rows.select(F.col("offset").alias("rev_id"), marked.alias("html"), "reason")


@register("scored_evaluation_set", query(f"{LOG}, {ACCOUNTS}, {LONG_SQL}", """SELECT rev_id, CASE WHEN seen THEN p >= 0.5 END AS revert, CASE WHEN seen THEN p END AS p_revert, CASE WHEN NOT seen THEN 'not JSON' END AS invalid,
  CASE WHEN seen THEN 1 ELSE 0 END AS tokens_in, label
FROM (SELECT s.rev_id, label, k % 11 NOT IN (1, 2) AS seen, (0.25 + CASE WHEN s.user_class = 'temporary' THEN 0.5 ELSE 0 END + CASE WHEN event_type = 'signup' THEN 0.125 ELSE 0 END)::DOUBLE AS p
  FROM (SELECT d.rev_id, d.user_class, label FROM decisions d JOIN labels_ USING (rev_id) WHERE policy = 'extendedconfirmed' AND rule = 'kept' ORDER BY sha256('11:' || d.rev_id) LIMIT 200) s JOIN facts ON off = s.rev_id)"""))
def scored_evaluation_set(spark, sf):
    """From the log to scores: sampled features, their diffs, rendered requests, a scorer's answers, appended once and read beside the labels."""
    edits = stored(enrich.with_diffs(stored(drawn_features(spark, sf), "drawn"), fetched_diffs(spark, sf)), "scorable")
    request = text.request(REQUEST_FILE, text.render_edit())
    path, scorer = scratch(spark, "runs"), KeywordScorer()
    score = lambda todo: jobs.score_with(todo, scorer, request)
    jobs.score_into(edits.where("rev_id % 2 = 0"), path, scorer.config, score)
    runs = jobs.score_into(edits.where("set = 'sealed'"), path, scorer.config, score)
    rows = runs.join(edits.select("set", "rev_id", "label"), ["set", "rev_id"])
    return rows.select("rev_id", "revert", "p_revert", "invalid", F.col("tokens_in").cast("int").alias("tokens_in"), "label")
