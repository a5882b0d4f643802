"""Labels of a streamed log, with work that follows the micro-batch and not the open window.

What a batch leaves for later is filed where it will be looked for:

- its edits under the batch, since labels leave in log order and the edits that close next lie in
  the oldest open batches;
- its revert tags under the run of revision ids they point to, since ids rise with the log, so that
  closing edits find theirs in a few runs;
- its deletions and holes under the batch, as they are few.

Two event times and the list of open batches are carried from batch to batch. A batch reads its own
rows, the open batches in which an edit closes, the tags of their revisions, and the deletions and holes of
the open window. Its state row is written last and commits it: labels of a batch without one are not seen,
and its retry starts from the state before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import parse
from tidemark.operators.labels import LIVE, LabelRules, closing_ms, is_hole, labelled, timeline, with_event_time
from tidemark.session import stored
from tidemark.streaming.batches import children, delete, each_batch, exists

TIMELINE = ("offset", "dt", "kind", "rev_id", "title", "edit_ms")
FACT = "offset BIGINT, dt BIGINT, kind STRING, rev_id BIGINT, title STRING, edit_ms BIGINT, mark BIGINT, due_ms BIGINT"
#: One row for each open batch, and one for the log as a whole under the batch that wrote it.
STATE = (
    "kind STRING, of BIGINT, min_rev BIGINT, max_rev BIGINT, min_due BIGINT, max_due BIGINT, dt BIGINT, edit_ms BIGINT, "
    "labelled BIGINT, max_rev_seen BIGINT, rows_in BIGINT, rows_read BIGINT, labels BIGINT"
)
LABEL = (
    "rev_id BIGINT, wiki STRING, title STRING, edit_time TIMESTAMP, label STRING, reverted_at TIMESTAMP, revert_delay_seconds BIGINT, "
    "window_hours DOUBLE, source_offset BIGINT"
)
#: Revision ids of one folder of revert tags, as a power of two.
RUN_BITS = 14


def _run(rev_id: Column) -> Column:
    return F.shiftright(rev_id, RUN_BITS)


def _greater(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class _State:
    """What one batch hands to the next: a few numbers, and a row for each batch with edits that wait."""

    def __init__(self, spark: SparkSession, folder: str, batch_id: int):
        rows = spark.read.schema(STATE).parquet(f"{folder}/state/batch={batch_id}").collect() if batch_id >= 0 else []
        log = next((r for r in rows if r.kind == "log"), None)
        self.dt, self.edit_ms, self.labelled, self.max_rev_seen = (log.dt, log.edit_ms, log.labelled, log.max_rev_seen) if log else (None, None, None, None)
        self.open = sorted((r for r in rows if r.kind == "open"), key=lambda r: r.of)


def label_stream(stream: DataFrame, folder: str, checkpoint: str, rules: LabelRules = LIVE) -> StreamingQuery:
    """Label the edits of a raw log as their windows close, exactly as the batch form does.

    Micro-batches must come in log order. Labels go to ``folder/labels``, in a folder of their
    batch that a retry replaces; see :func:`read_labels`. State that no open edit needs is deleted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _label_batch(batch, batch_id, folder, rules)

    return each_batch(stream, checkpoint, write)


def _label_batch(batch: DataFrame, b: int, folder: str, rules: LabelRules) -> None:
    spark = batch.sparkSession
    before = _State(spark, folder, b - 1)
    wait = rules.window_ms + rules.grace_ms

    def lit(value: int | None) -> Column:
        return F.lit(value).cast("bigint")

    events = stored(timeline(parse.parse(batch), rules).select(*TIMELINE), "stream-timeline")
    rows_in, dt, edit_ms = events.agg(F.count(F.lit(1)), F.max("dt"), F.max("edit_ms")).first()
    last = _greater(before.dt, dt)
    # The running values go on where the batch before left them.
    timed = with_event_time(events, rules).withColumns({"mark": F.greatest("mark", lit(before.dt)), "due_ms": F.greatest("due_ms", lit(before.edit_ms))})
    facts = stored(timed.where(F.col("kind").isNotNull() | is_hole(rules)), "stream-facts").select(*[c.split()[0] for c in FACT.split(", ")])

    edits = parse.first_by_key(facts.where("kind = 'edit'"), "rev_id", "offset")
    edits = _first_seen(spark, edits, before, b, folder)
    edits.write.mode("overwrite").parquet(f"{folder}/edits/batch={b}")
    own = spark.read.schema(FACT).parquet(f"{folder}/edits/batch={b}").agg(F.min("rev_id"), F.max("rev_id"), F.min("due_ms"), F.max("due_ms")).first()
    open_ = [(r.of, r.min_rev, r.max_rev, r.min_due, r.max_due) for r in before.open]
    if own[0] is not None:
        open_.append((b, *own))
    # A hole counts for the edits before it whatever its event is.
    marks = facts.where((F.col("kind") == "deletion") | is_hole(rules)).withColumn("kind", F.when(F.col("kind") == "deletion", "deletion"))
    marks.write.mode("overwrite").parquet(f"{folder}/marks/batch={b}")
    if open_:
        # Tags of revisions that no open edit has come before their edit, or too late.
        lo, hi = min(o[1] for o in open_), max(o[2] for o in open_)
        tags = facts.where((F.col("kind") == "revert") & F.col("rev_id").between(lo, hi)).withColumns({"rev_run": _run(F.col("rev_id")), "batch": lit(b)})
        # A run is written by one task, so that it is one file and not one from every task.
        tags.repartition("rev_run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rev_run", "batch").parquet(f"{folder}/reverts")

    due = [o for o in open_ if last is not None and o[3] + wait <= last]
    found_labels, read, upto = 0, 0, before.labelled
    if due:
        closed = spark.read.schema(FACT).parquet(*[f"{folder}/edits/batch={o[0]}" for o in due]).where(lit(last) >= closing_ms(rules))
        if before.labelled is not None:
            closed = closed.where(F.col("offset") > before.labelled)
        parts = [closed, spark.read.schema(FACT).parquet(*[f"{folder}/marks/batch={x}" for x in range(open_[0][0], b + 1)])]
        runs = (min(o[1] for o in due) >> RUN_BITS, max(o[2] for o in due) >> RUN_BITS)
        if exists(spark, f"{folder}/reverts"):
            tags = spark.read.schema(f"{FACT}, rev_run BIGINT, batch BIGINT").parquet(f"{folder}/reverts")
            # A tag comes after its edit, so not in an earlier batch.
            parts.append(tags.where(F.col("rev_run").between(*runs) & F.col("batch").between(due[0][0], b)).drop("rev_run", "batch"))
        counted = Observation()
        together = reduce(DataFrame.unionByName, parts).observe(counted, F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("kind") == "edit", F.col("offset"))).alias("upto"))
        # One row for each offset; an edit that is a hole as well stands in both.
        needed = stored(parse.first_by_key(together.withColumn("rank", F.col("kind").isNull()), "offset", "rank").drop("rank"), "stream-due")
        read, upto = counted.get["n"], _greater(upto, counted.get["upto"])
        labels = labelled(needed, lit(last), rules).withColumn("rev_run", _run(F.col("rev_id")))
        counted = Observation()
        labels.observe(counted, F.count(F.lit(1)).alias("n")).repartition("rev_run").write.mode("overwrite").partitionBy("rev_run").parquet(f"{folder}/labels/batch={b}")
        found_labels = counted.get["n"]
    else:
        # A retry may find what its first try left.
        delete(spark, f"{folder}/labels/batch={b}")

    still = [o for o in open_ if last is None or o[4] + wait > last]
    log = (last, _greater(before.edit_ms, edit_ms), upto, _greater(before.max_rev_seen, own[1]), rows_in, rows_in + read, found_labels)
    rows = [("open", *o, *(None,) * len(log)) for o in still] + [("log", b, *(None,) * 4, *log)]
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/batch={b}")
    _prune(spark, folder, before, b)


def _first_seen(spark: SparkSession, edits: DataFrame, before: _State, b: int, folder: str) -> DataFrame:
    """``edits`` without revisions that an earlier batch holds or has labelled; such ids are rarely there to look for."""
    if before.max_rev_seen is None:
        return edits
    edits = stored(edits, "stream-edits")
    lo, hi = edits.where(F.col("rev_id") <= before.max_rev_seen).agg(F.min("rev_id"), F.max("rev_id")).first()
    if lo is None:
        return edits
    holding = [f"{folder}/edits/batch={r.of}" for r in before.open if r.min_rev <= hi and r.max_rev >= lo]
    if holding:
        edits = edits.join(spark.read.schema(FACT).parquet(*holding).select("rev_id"), "rev_id", "left_anti")
    if exists(spark, f"{folder}/labels"):
        done = spark.read.schema("rev_id BIGINT, batch BIGINT, rev_run BIGINT").parquet(f"{folder}/labels")
        edits = edits.join(done.where((F.col("batch") < b) & F.col("rev_run").between(lo >> RUN_BITS, hi >> RUN_BITS)).select("rev_id"), "rev_id", "left_anti")
    return edits.select(*[c.split()[0] for c in FACT.split(", ")])


def _prune(spark: SparkSession, folder: str, before: _State, b: int) -> None:
    """Delete what neither later batches nor a retry of this one can ask for."""
    oldest = before.open[0].of if before.open else b
    for part in ("edits", "marks"):
        for name in children(spark, f"{folder}/{part}"):
            if name.startswith("batch=") and int(name[6:]) < oldest:
                delete(spark, f"{folder}/{part}/{name}")
    if before.open:
        first_run = min(r.min_rev for r in before.open) >> RUN_BITS
        for name in children(spark, f"{folder}/reverts"):
            if name.startswith("rev_run=") and int(name[8:]) < first_run:
                delete(spark, f"{folder}/reverts/{name}")


def label_progress(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, rows_in, rows_read, labels) of every committed batch: its own rows, all rows it read, and labels given."""
    log = spark.read.schema(f"{STATE}, batch BIGINT").parquet(f"{folder}/state").where("kind = 'log'")
    return log.select("batch", "rows_in", "rows_read", "labels")


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of all committed batches."""
    if not exists(spark, f"{folder}/labels"):
        return spark.createDataFrame([], LABEL)
    labels = spark.read.schema(f"{LABEL}, batch BIGINT, rev_run BIGINT").parquet(f"{folder}/labels")
    committed = label_progress(spark, folder).select("batch")
    return labels.join(committed, "batch", "left_semi").drop("batch", "rev_run")
