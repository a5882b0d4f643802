"""Cost-aware routing between a cheap and an expensive scorer, evaluated from stored answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import change
from tidemark.functions.stats import f1, ratio, round_half_up, share, wilson_columns
from tidemark.operators.quantiles import cumulated, histogram, summarise_histogram
from tidemark.operators.scoring import decided
from tidemark.session import stored

# The outer edges a band may take besides the probabilities seen.
LOWEST_EDGE = 0.0
HIGHEST_EDGE = 1.000001
#: Runs that a run of edges is cut into at each step of the band search.
FAN = 32
POLICIES = ("heuristics only", "local only", "cloud only", "ladder")
LATENCY_POINTS = {"latency_p50": 50.0, "latency_p95": 95.0}


def with_cost(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost`` in USD per answer. A model without a price fails the job.

    The price list is as long as the list of models; Spark broadcasts it by size.
    """
    listed = prices.select(F.col("model").alias("__model"), F.col("input").alias("__in"), F.col("output").alias("__out"))
    model = change.model_of(F.col("config"))
    joined = runs.join(listed, model == F.col("__model"), "left")
    price = F.coalesce("tokens_in", F.lit(0)) * F.col("__in") + F.coalesce("tokens_out", F.lit(0)) * F.col("__out")
    missing = F.raise_error(F.concat(F.lit("no price for "), model)).cast("double")
    return joined.withColumn("cost", F.when(F.col("__model").isNull(), missing).otherwise(price / 1e6)).drop(
        "__model", "__in", "__out"
    )


def unpriced(runs: DataFrame, prices: DataFrame) -> DataFrame:
    models = runs.select(change.model_of(F.col("config")).alias("model")).distinct()
    return models.join(prices, "model", "left_anti")


def per_thousand(cost: Column, survivor_share: Column | float) -> Column:
    """USD per 1,000 edits; what the filter removes costs nothing."""
    return 1000.0 * survivor_share * cost


def paired(edits: DataFrame, local: DataFrame, cloud: DataFrame) -> DataFrame:
    """Decided edits with both answers beside them; a missing answer fails the job.

    ``local`` and ``cloud`` hold one row per rev_id; ``cloud`` carries ``cost``.
    """
    def side(df: DataFrame, prefix: str, *extra: str) -> DataFrame:
        cols = ["revert", "p_revert", "latency_ms", *extra]
        return df.select("rev_id", F.lit(True).alias(f"{prefix}_found"), *[F.col(c).alias(f"{prefix}_{c}") for c in cols])

    def has(prefix: str) -> Column:
        error = F.raise_error(F.concat(F.lit(f"{prefix} run has no answer for revision "), F.col("rev_id")))
        return F.when(F.col(f"{prefix}_found"), F.lit(True)).otherwise(error.cast("boolean"))

    kept = edits.where(decided(F.col("label"))).select("rev_id", (F.col("label") == "reverted").alias("actual"))
    both = kept.join(side(local, "local"), "rev_id", "left").join(side(cloud, "cloud", "cost"), "rev_id", "left")
    # A filter, so that no reader can have the check pruned away.
    checked = both.where(has("local") & has("cloud"))
    return (
        checked.withColumn("local_flag", F.coalesce("local_revert", F.lit(False)))
        .withColumn("cloud_flag", F.coalesce("cloud_revert", F.lit(False)))
        .drop("local_found", "cloud_found", "local_revert", "cloud_revert")
    )


def compare_policies(pairs: DataFrame, lo: float, hi: float) -> DataFrame:
    """The four policies side by side, each edit expanded to one row per policy.

    Sums and latencies are two readings of the joined answers, which are stored for them.
    """
    columns = ("actual", "local_flag", "cloud_flag", "local_p_revert", "local_latency_ms", "cloud_latency_ms", "cloud_cost")
    pairs = stored(pairs.select(*columns), "policy-pairs")
    p = F.col("local_p_revert")
    unsure = p.isNull() | ((p >= lo) & (p < hi))

    def outcome(policy: str, flagged: Column, cost: Column, latency: Column, escalated: Column) -> Column:
        return F.struct(
            F.lit(policy).alias("policy"), flagged.alias("flagged"), cost.cast("double").alias("cost"),
            latency.cast("double").alias("latency"), escalated.alias("escalated"),
        )

    local_flag, cloud_flag = F.col("local_flag"), F.col("cloud_flag")
    local_ms, cloud_ms, cost = F.col("local_latency_ms"), F.col("cloud_latency_ms"), F.col("cloud_cost")
    free, yes, no = F.lit(0.0), F.lit(True), F.lit(False)
    options = F.array(
        outcome("heuristics only", yes, free, free, no),
        outcome("local only", local_flag, free, local_ms, no),
        outcome("cloud only", cloud_flag, cost, cloud_ms, yes),
        outcome(
            "ladder",
            F.when(unsure, cloud_flag).otherwise(local_flag),
            F.when(unsure, cost).otherwise(0.0),
            F.when(unsure, local_ms + cloud_ms).otherwise(local_ms),
            unsure,
        ),
    )
    rows = pairs.select("actual", F.explode(options).alias("o")).select("actual", "o.*")
    flagged, actual = F.col("flagged"), F.col("actual")
    sums = rows.groupBy("policy").agg(
        F.count("*").alias("edits"),
        F.count_if(flagged & actual).alias("tp"),
        F.count_if(flagged & ~actual).alias("fp"),
        F.count_if(~flagged & actual).alias("fn"),
        F.count_if("escalated").alias("__escalated"),
        F.avg("cost").alias("cost_per_model_edit"),
    )
    latency = summarise_histogram(histogram(rows, ["policy"], "latency"), ["policy"], "value", LATENCY_POINTS)
    return sums.join(latency.select("policy", *LATENCY_POINTS), "policy").select(
        "policy",
        "edits",
        *wilson_columns("precision", F.col("tp"), F.col("tp") + F.col("fp")),
        *wilson_columns("recall", F.col("tp"), F.col("tp") + F.col("fn")),
        round_half_up(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1"),
        share(F.col("__escalated"), F.col("edits")).alias("escalated"),
        "cost_per_model_edit",
        *LATENCY_POINTS,
    )


def headline(policies: DataFrame, survivor_share: float) -> DataFrame:
    """Share of the expensive scorer's recall the ladder holds, and at what share of its cost."""
    def of(policy: str, column: Column) -> Column:
        return F.max(F.when(F.col("policy") == policy, column))

    cost = round_half_up(per_thousand(F.col("cost_per_model_edit"), survivor_share))
    return policies.agg(
        round_half_up(ratio(of("ladder", F.col("recall_rate")), of("cloud only", F.col("recall_rate")))).alias("recall_kept"),
        round_half_up(ratio(of("ladder", cost), of("cloud only", cost))).alias("cost_share"),
        of("ladder", cost).alias("ladder_usd_per_1000"),
        of("cloud only", cost).alias("cloud_usd_per_1000"),
    )


# ---------------------------------------------------------------------------
# Band search


def band_edges(pairs: DataFrame) -> DataFrame:
    """Candidate edges in order with running sums over all smaller local p.

    For an edge e: ``n`` rows have p < e, and sending them to the cloud instead
    would change true and false positives by ``tp`` and ``fp``.
    """
    def gain(when_actual: bool) -> Column:
        same = F.col("actual") if when_actual else ~F.col("actual")
        return F.sum(F.when(same, F.col("cloud_flag").cast("int") - F.col("local_flag").cast("int")).otherwise(0))

    seen = pairs.where(F.col("local_p_revert").isNotNull()).groupBy(F.col("local_p_revert").alias("edge")).agg(
        F.count("*").alias("__n"), gain(True).alias("__tp"), gain(False).alias("__fp")
    )
    outer = pairs.sparkSession.range(1).select(
        F.explode(F.array(F.lit(LOWEST_EDGE), F.lit(HIGHEST_EDGE))).alias("edge"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("__n", "__tp", "__fp")],
    )
    steps = seen.unionByName(outer).groupBy("edge").agg(
        *[F.sum(c).alias(c) for c in ("__n", "__tp", "__fp")], F.lit(1).cast("bigint").alias("__one")
    )
    running_sums = {"idx": "__one", "n": "__n", "tp": "__tp", "fp": "__fp"}
    return cumulated(steps, [], "edge", running_sums).select("edge", *running_sums)


def choose_band(pairs: DataFrame, target: float = 0.95, fan: int = FAN) -> DataFrame:
    """The band [lo, hi) with the lowest escalation whose recall is at least ``target`` of the cloud's.

    Ties go to the higher F1, then the lower lo, then the lower hi. Exact over all edge pairs
    without forming them: edges are cut into ``fan`` runs, and a pair of runs stays open only
    if its bounds allow a feasible band no worse than one already known. The runs of open
    pairs are cut again, until a run is one edge.
    """
    edges = stored(band_edges(pairs), "edges")
    flag = lambda side, actual: F.count_if(F.col(f"{side}_flag") & (F.col("actual") if actual else ~F.col("actual")))
    escalates = F.col("local_p_revert").isNull()
    start = pairs.agg(
        F.count("*").alias("total"),
        F.count_if("actual").alias("reverted"),
        flag("cloud", True).alias("cloud_tp"),
        # Rows without a local p escalate whatever the band is.
        F.count_if(escalates).alias("always"),
        F.count_if(F.when(escalates, F.col("cloud_flag")).otherwise(F.col("local_flag")) & F.col("actual")).alias("tp0"),
        F.count_if(F.when(escalates, F.col("cloud_flag")).otherwise(F.col("local_flag")) & ~F.col("actual")).alias("fp0"),
    ).first()
    if not start["total"] or not start["reverted"]:
        raise ValueError("a band needs decided edits of both labels")
    total, reverted = F.lit(start["total"]), F.lit(start["reverted"])
    cloud_recall = share(F.lit(start["cloud_tp"]), reverted)
    recall = lambda tp: share(F.lit(start["tp0"]) + tp, reverted)
    escalated = lambda n: share(F.lit(start["always"]) + n, total)
    enough = lambda tp: recall(tp) >= F.lit(target) * cloud_recall

    size = 1
    while size * fan < edges.count():
        size *= fan
    # Sending everything to the cloud reaches its recall, so some band exists at 1.0.
    known = 1.0
    span = F.explode(F.sequence(F.lit(0), F.lit(fan - 1)))
    open_pairs = pairs.sparkSession.range(fan).select(F.col("id").alias("lo_run")).select("lo_run", span.alias("hi_run"))
    while True:
        runs = edges.groupBy(F.floor(F.col("idx") / F.lit(size)).cast("bigint").alias("run")).agg(
            F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("tp").alias("tp_min"), F.max("tp").alias("tp_max"),
            F.min_by(F.struct("edge", "n", "tp", "fp"), "idx").alias("first"),
        )
        side = lambda s: runs.select(*[F.col(c).alias(f"{s}_{c}") for c in runs.columns])  # noqa: B023,E731
        met = open_pairs.where("lo_run <= hi_run").join(side("lo"), "lo_run").join(side("hi"), "hi_run")
        bounded = met.select(
            "*",
            escalated(F.greatest(F.col("hi_n_min") - F.col("lo_n_max"), F.lit(0))).alias("best_case"),
            # The first edges of two runs are a real band: a bound on the answer.
            F.when(
                (F.col("lo_run") < F.col("hi_run")) & enough(F.col("hi_first.tp") - F.col("lo_first.tp")),
                escalated(F.col("hi_first.n") - F.col("lo_first.n")),
            ).alias("known"),
        ).where(enough(F.col("hi_tp_max") - F.col("lo_tp_min")))
        bounded = stored(bounded, "bounds")
        known = min(known, bounded.agg(F.coalesce(F.min("known"), F.lit(1.0))).first()[0])
        still = bounded.where(F.col("best_case") <= F.lit(known))
        if size == 1:
            break
        size //= fan
        child = lambda c: F.explode(F.sequence(F.col(c) * fan, F.col(c) * fan + fan - 1)).alias(c)
        open_pairs = still.select(child("lo_run"), "hi_run").select("lo_run", child("hi_run"))
    part = lambda s: [F.col(f"{s}_first.{c}").alias(f"{s}_{c}") for c in ("edge", "n", "tp", "fp")]
    bands = still.where("lo_run < hi_run").select(*part("lo"), *part("hi"))
    d_tp, d_fp, d_n = (F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in ("tp", "fp", "n"))
    tp, fp = F.lit(start["tp0"]) + d_tp, F.lit(start["fp0"]) + d_fp
    score = round_half_up(f1(tp, fp, reverted - tp))
    best = bands.where(enough(d_tp)).agg(
        F.min(
            F.struct(
                escalated(d_n).alias("escalated"), (-score).alias("neg_f1"), F.col("lo_edge").alias("lo"),
                F.col("hi_edge").alias("hi"), recall(d_tp).alias("recall"),
            )
        ).alias("b")
    )
    return best.where("b IS NOT NULL").select(
        "b.lo", "b.hi", "b.escalated", F.abs("b.neg_f1").alias("f1"), "b.recall", cloud_recall.alias("cloud_recall")
    )


def survivor_share(per_policy: DataFrame, policy: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, classifiable, kept, share): how much of the feed reaches a scorer, by rule counts."""
    rows = per_policy.where(F.col("policy") == policy)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("classifiable"),
        F.count_if(F.col("rule") == "kept").alias("kept"),
        share(F.count_if(F.col("rule") == "kept"), F.count("*")).alias("survivor_share"),
    )
