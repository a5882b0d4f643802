"""Scoring, calibration, routing and drift of the derived runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import bindings as b
from tidemark.catalog.sql import EVAL, RERUNS, RUNS, exact_avg, f1, query, r4, share, wilson
from tidemark.functions import change
from tidemark.functions.stats import round_half_up
from tidemark.operators import calibration, drift, ladder, scoring
from tidemark.session import scratch
from tidemark.sources import tables

Q: dict = {}


def register(name: str, sql: str | None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


DECIDED = "label IN ('reverted', 'not-reverted')"

GRID = f"""counts AS (
  SELECT r."set", r.config, count(*) AS n, count(*) FILTER (revert) AS flagged_n, count(*) FILTER (revert IS NULL) AS invalid_n,
    count(*) FILTER (revert AND label = 'reverted') AS tp, count(*) FILTER (revert AND label = 'not-reverted') AS fp,
    avg(tokens_in) FILTER (tokens_in IS NOT NULL AND tokens_out IS NOT NULL) AS t_in, avg(tokens_out) FILTER (tokens_in IS NOT NULL AND tokens_out IS NOT NULL) AS t_out,
    quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, max(latency_ms) AS slowest, string_agg(DISTINCT model_version, ',') AS model_versions
  FROM runs r JOIN eval_set e ON e."set" = r."set" AND e.rev_id = r.rev_id GROUP BY ALL),
totals AS (SELECT "set", count(*) AS size, count(*) FILTER (label = 'reverted') AS positives, count(*) FILTER ({DECIDED}) AS decided FROM eval_set GROUP BY 1),
grid AS (
  SELECT "set", config, model_versions, n AS edits, n = size AS complete, {share('flagged_n', 'n')} AS flagged, {share('invalid_n', 'n')} AS invalid, tp, fp, positives - tp AS fn,
    {wilson('precision', 'tp', '(tp + fp)')}, {wilson('recall', 'tp', 'positives')}, {f1('tp', 'fp', '(positives - tp)')} AS f1,
    CASE WHEN slowest > 0 THEN p50 END AS latency_p50, CASE WHEN slowest > 0 THEN p95 END AS latency_p95,
    CAST(floor(t_in + 0.5) AS BIGINT) AS tokens_in, CAST(floor(t_out + 0.5) AS BIGINT) AS tokens_out
  FROM counts JOIN totals USING ("set"))"""


def scores(spark, sf):
    return scoring.grid(b.eval_set(spark, sf), b.runs(spark, sf))


def flat(df):
    return df.withColumn("model_versions", F.array_join("model_versions", ","))


@register("score_grid", query(f"{RUNS}, {GRID}", "SELECT * FROM grid"))
def score_grid(spark, sf):
    return flat(scores(spark, sf))


@register("score_grid_in_report_order", query(f"{RUNS}, {GRID}", """SELECT "set", config, row_number() OVER (PARTITION BY "set" ORDER BY config NOT LIKE 'baseline:%', config) AS place FROM grid"""))
def score_grid_in_report_order(spark, sf):
    from pyspark.sql import Window as W

    ordered = scoring.in_report_order(scores(spark, sf))
    place = F.row_number().over(W.partitionBy("set").orderBy(~F.col("config").startswith("baseline:"), "config"))
    return ordered.select("set", "config", place.cast("bigint").alias("place"))


@register("base_rates", query(EVAL, f"""SELECT "set", count(*) AS set_edits, {wilson('base', "count(*) FILTER (label = 'reverted')", f"count(*) FILTER ({DECIDED})")} FROM eval_set GROUP BY 1"""))
def base_rates(spark, sf):
    return scoring.base_rate(b.eval_set(spark, sf))


@register(
    "rule_baselines",
    query(EVAL, f"""SELECT "set", config, {wilson('precision', "count(*) FILTER (hit AND label = 'reverted')", f"count(*) FILTER (hit AND {DECIDED})")}, {wilson('recall', "count(*) FILTER (hit AND label = 'reverted')", "count(*) FILTER (label = 'reverted')")}
FROM (SELECT *, config = 'baseline:filter-only' OR user_class = 'temporary' AS hit FROM eval_set, (VALUES ('baseline:filter-only'), ('baseline:filter+temporary')) v(config)) GROUP BY ALL"""),
)
def rule_baselines(spark, sf):
    edits = b.eval_set(spark, sf)
    answers = scoring.filter_only(edits).unionByName(scoring.filter_temporary(edits))
    grid = scoring.grid(edits, answers.withColumn("at", F.lit("2024-01-01").cast("timestamp")))
    parts = ("rate", "low", "high", "n")
    return grid.select("set", "config", *[f"{x}_{p}" for x in ("precision", "recall") for p in parts])


@register("threshold_scorer", query(EVAL, """SELECT rev_id, CASE WHEN rev_id % 13 <> 0 THEN (rev_id * 71 % 101)::DOUBLE / 100 >= 0.5 END AS revert, CASE WHEN rev_id % 13 <> 0 THEN (rev_id * 71 % 101)::DOUBLE / 100 END AS p_revert,
  CASE WHEN rev_id % 13 = 0 THEN '503: {"error":"' || rev_id || '"}' END AS invalid FROM eval_set"""))
def threshold_scorer(spark, sf):
    """Score bodies read with JSON paths: nested probability, or none."""
    d = F.col("rev_id")
    p = (d * 71 % 101).cast("double") / 100
    body = F.when(d % 13 == 0, F.to_json(F.struct(d.cast("string").alias("error")))).otherwise(
        F.to_json(F.struct(F.struct(F.struct(p.alias("true")).alias("probabilities")).alias("output")))
    )
    rows = b.eval_set(spark, sf).select("rev_id", F.when(d % 13 == 0, "503").otherwise("200").alias("status"), body.alias("body"))
    read = F.from_json("body", "output STRUCT<probabilities: STRUCT<`true`: DOUBLE>>")["output"]["probabilities"]["true"]
    return rows.select("rev_id", *scoring.by_threshold(read, F.col("status"), F.col("body")))


@register("unanswered_edits", query(RUNS, """SELECT "set", rev_id FROM eval_set e WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.config = 'large:b__terse-1' AND r."set" = e."set" AND r.rev_id = e.rev_id)"""))
def unanswered_edits(spark, sf):
    return scoring.unanswered(b.eval_set(spark, sf), b.runs(spark, sf).where("config = 'large:b__terse-1'")).select("set", "rev_id")


@register("best_configuration_per_model", query(f"{RUNS}, {GRID}", """SELECT "set", model, config, f1 FROM (SELECT *, split_part(config, '__', 1) AS model, row_number() OVER (PARTITION BY "set", split_part(config, '__', 1) ORDER BY f1 DESC, coalesce(tokens_in, 0) + coalesce(tokens_out, 0), config) AS n FROM grid WHERE complete) WHERE n = 1"""))
def best_configuration_per_model(spark, sf):
    return scoring.best_per_model(scores(spark, sf).where("complete")).select("set", "model", "config", "f1")


@register("configurations_and_models", query(RUNS, "SELECT DISTINCT config, split_part(config, '__', 1) AS model, regexp_replace(config, '__[\\w-]+$', '') AS plain FROM runs"))
def configurations_and_models(spark, sf):
    c = F.col("config")
    return b.runs(spark, sf).select("config", change.model_of(c).alias("model"), change.without_template(c).alias("plain")).distinct()


# -- calibration ---------------------------------------------------------------

CAL = f"""cal_rows AS (
  SELECT r."set", r.config, segment, p_revert AS p, label = 'reverted' AS pos FROM runs r JOIN eval_set e ON e."set" = r."set" AND e.rev_id = r.rev_id,
    (VALUES ('overall'), ('temporary'), ('registered')) s(segment) WHERE {DECIDED} AND p_revert IS NOT NULL AND (segment = 'overall' OR segment = user_class)),
cal_buckets AS (
  SELECT "set", config, segment, bucket, count(*) AS n, {r4(exact_avg('p'))} AS mean_p, {wilson('observed', 'count(*) FILTER (pos)', 'count(*)', with_n=False)}
  FROM (SELECT *, CAST((p >= 0.1) AS INT) + CAST((p >= 0.2) AS INT) + CAST((p >= 0.3) AS INT) + CAST((p >= 0.4) AS INT) + CAST((p >= 0.5) AS INT)
      + CAST((p >= 0.6) AS INT) + CAST((p >= 0.7) AS INT) + CAST((p >= 0.8) AS INT) + CAST((p >= 0.9) AS INT) AS bucket FROM cal_rows) GROUP BY ALL),
cal_ranks AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY "set", config, segment, p) - 1) / 2.0 AS mean_rank FROM cal_rows WINDOW w AS (PARTITION BY "set", config, segment ORDER BY p)),
cal_sums AS (
  SELECT "set", config, segment, count(*) AS n, count(DISTINCT p) AS distinct_p, {r4(exact_avg('pow(p - CASE WHEN pos THEN 1 ELSE 0 END, 2)'))} AS brier,
    {r4("(sum(mean_rank) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / NULLIF(count(*) FILTER (pos) * (count(*) FILTER (NOT pos))::DOUBLE, 0)")} AS auroc
  FROM cal_ranks GROUP BY ALL),
usable AS (SELECT "set", config, invalid_excluded FROM (SELECT "set", config, count(*) FILTER (p_revert IS NULL) AS invalid_excluded, count(*) AS n FROM runs GROUP BY ALL)
  JOIN (SELECT "set", count(*) AS size FROM eval_set GROUP BY 1) USING ("set") WHERE n = size)"""


@register("reliability_table", query(f"{RUNS}, {CAL}", """SELECT "set", config, bucket, bucket / 10 AS p_from, (bucket + 1) / 10 AS p_to, n, mean_p, observed_rate, observed_low, observed_high FROM cal_buckets WHERE segment = 'overall'"""))
def reliability_table(spark, sf):
    hist = calibration.probabilities(b.eval_set(spark, sf), b.runs(spark, sf))
    return calibration.reliability(hist, ["set", "config"])


@register(
    "calibration_by_segment",
    query(f"{RUNS}, {CAL}", f"""SELECT s.*, ece, invalid_excluded FROM cal_sums s JOIN usable USING ("set", config)
  JOIN (SELECT "set", config, segment, {r4('CAST(sum(n * CAST(abs(observed_rate - mean_p) AS DECIMAL(16,12))) AS DOUBLE) / sum(n)')} AS ece FROM cal_buckets GROUP BY ALL) USING ("set", config, segment)"""),
)
def calibration_by_segment(spark, sf):
    return calibration.calibration(b.eval_set(spark, sf), b.runs(spark, sf))


@register("auroc_and_brier", query(f"{RUNS}, {CAL}", """SELECT "set", config, n, distinct_p, brier, auroc FROM cal_sums WHERE segment = 'overall'"""))
def auroc_and_brier(spark, sf):
    hist = calibration.probabilities(b.eval_set(spark, sf), b.runs(spark, sf))
    whole = hist.groupBy("set", "config", "p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return calibration.brier_and_auroc(whole, ["set", "config"])


@register("calibration_ranges", query(f"{RUNS}, {CAL}", f"""SELECT regexp_extract(config, '^[^:]+') AS family, min(ece) AS ece_low, max(ece) AS ece_high FROM (SELECT "set", config, {r4('CAST(sum(n * CAST(abs(observed_rate - mean_p) AS DECIMAL(16,12))) AS DOUBLE) / sum(n)')} AS ece FROM cal_buckets WHERE segment = 'overall' GROUP BY ALL) GROUP BY 1"""))
def calibration_ranges(spark, sf):
    hist = calibration.probabilities(b.eval_set(spark, sf), b.runs(spark, sf))
    errors = calibration.ece(calibration.reliability(hist, ["set", "config"]), ["set", "config"])
    return scoring.ranges(errors, F.split("config", ":")[0], ["ece"])


# -- ladder -----------------------------------------------------------------------

PAIRED = f"""ladder_pairs AS (
  SELECT e.rev_id, label = 'reverted' AS actual, coalesce(l.revert, false) AS lflag, l.p_revert AS p, l.latency_ms AS lms, coalesce(c.revert, false) AS cflag, c.latency_ms AS cms,
    (c.tokens_in * 1.5::DOUBLE + c.tokens_out * 9.0::DOUBLE) / 1e6::DOUBLE AS ccost
  FROM eval_set e JOIN runs l ON l.config = 'small:a__terse-1' AND l.rev_id = e.rev_id JOIN runs c ON c.config = 'large:b__rules-4' AND c.rev_id = e.rev_id WHERE {DECIDED})"""

POLICY_ROWS = """policy_rows AS (
  SELECT 'heuristics only' AS policy, actual, true AS flagged, 0.0 AS cost, 0.0 AS latency, false AS escalated FROM ladder_pairs
  UNION ALL SELECT 'local only', actual, lflag, 0.0, lms, false FROM ladder_pairs
  UNION ALL SELECT 'cloud only', actual, cflag, ccost, cms, true FROM ladder_pairs
  UNION ALL SELECT 'ladder', actual, CASE WHEN unsure THEN cflag ELSE lflag END, CASE WHEN unsure THEN ccost ELSE 0 END, CASE WHEN unsure THEN lms + cms ELSE lms END, unsure
    FROM (SELECT *, p IS NULL OR (p >= 0.4 AND p < 0.6) AS unsure FROM ladder_pairs))"""

TPFP = ("count(*) FILTER (flagged AND actual)", "count(*) FILTER (flagged AND NOT actual)", "count(*) FILTER (NOT flagged AND actual)")
POLICY_TABLE = f"""SELECT policy, count(*) AS edits, {wilson('precision', TPFP[0], 'count(*) FILTER (flagged)')}, {wilson('recall', TPFP[0], 'count(*) FILTER (actual)')},
  {f1(*TPFP)} AS f1, {share('count(*) FILTER (escalated)', 'count(*)')} AS escalated, floor(avg(cost) * 1e9 + 0.5) / 1e9 AS cost_per_model_edit,
  quantile_disc(latency::DOUBLE, 0.5) AS latency_p50, quantile_disc(latency::DOUBLE, 0.95) AS latency_p95 FROM policy_rows GROUP BY 1"""


def pairs(spark, sf):
    runs = b.runs(spark, sf)
    local = runs.where("config = 'small:a__terse-1'")
    cloud = ladder.with_cost(runs.where("config = 'large:b__rules-4'"), b.prices(spark))
    return ladder.paired(b.eval_set(spark, sf), local, cloud)


@register("answer_costs", query(RUNS, """SELECT config, count(*) AS n, floor(sum((coalesce(tokens_in, 0) * input + coalesce(tokens_out, 0) * output) / 1e6) * 1e6 + 0.5) / 1e6 AS usd FROM runs JOIN prices ON model = split_part(config, '__', 1) GROUP BY 1"""))
def answer_costs(spark, sf):
    priced = ladder.with_cost(b.runs(spark, sf).where("NOT config LIKE 'baseline:%'"), b.prices(spark))
    return priced.groupBy("config").agg(F.count("*").alias("n"), round_half_up(F.sum("cost"), 6).alias("usd"))


@register("models_without_price", query(RUNS, "SELECT DISTINCT split_part(config, '__', 1) AS model FROM runs WHERE split_part(config, '__', 1) NOT IN (SELECT model FROM prices)"))
def models_without_price(spark, sf):
    return ladder.unpriced(b.runs(spark, sf), b.prices(spark))


@register("routing_policies", query(f"{RUNS}, {PAIRED}, {POLICY_ROWS}", POLICY_TABLE))
def routing_policies(spark, sf):
    table = ladder.compare_policies(pairs(spark, sf), 0.4, 0.6)
    return table.withColumn("cost_per_model_edit", round_half_up(F.col("cost_per_model_edit"), 9))


BAND = f"""edges AS (SELECT 0.0::DOUBLE AS edge UNION SELECT 1.000001::DOUBLE UNION SELECT DISTINCT p FROM ladder_pairs WHERE p IS NOT NULL),
bands AS (
  SELECT lo.edge AS lo, hi.edge AS hi, count(*) AS n, count(*) FILTER (actual) AS positives, count(*) FILTER (unsure) AS esc,
    count(*) FILTER (flag AND actual) AS tp, count(*) FILTER (flag AND NOT actual) AS fp, {share('count(*) FILTER (cflag AND actual)', 'count(*) FILTER (actual)')} AS cloud_recall
  FROM (SELECT lo, hi, q.*, unsure, CASE WHEN unsure THEN cflag ELSE lflag END AS flag FROM edges lo JOIN edges hi ON lo.edge < hi.edge, ladder_pairs q,
      LATERAL (SELECT q.p IS NULL OR (q.p >= lo.edge AND q.p < hi.edge) AS unsure)) GROUP BY ALL),
scored_bands AS (SELECT lo, hi, {share('esc', 'n')} AS escalated, {f1('tp', 'fp', '(positives - tp)')} AS f1, {share('tp', 'positives')} AS recall, cloud_recall FROM bands)"""


@register("band_search", query(f"{RUNS}, {PAIRED}, {BAND}", "SELECT * FROM scored_bands WHERE recall >= 0.95::DOUBLE * cloud_recall ORDER BY escalated, f1 DESC, lo, hi LIMIT 1"))
def band_search(spark, sf):
    return ladder.choose_band(pairs(spark, sf))


@register(
    "routing_headline",
    query(f"{RUNS}, {PAIRED}, {POLICY_ROWS}, policy_table AS ({POLICY_TABLE})", f"""SELECT {r4('l.recall_rate / NULLIF(c.recall_rate, 0)')} AS recall_kept, {r4('lc / NULLIF(cc, 0)')} AS cost_share, lc AS ladder_usd_per_1000, cc AS cloud_usd_per_1000
FROM policy_table l, policy_table c, LATERAL (SELECT {r4('1000 * 0.33 * l.cost_per_model_edit')} AS lc, {r4('1000 * 0.33 * c.cost_per_model_edit')} AS cc) WHERE l.policy = 'ladder' AND c.policy = 'cloud only'"""),
)
def routing_headline(spark, sf):
    return ladder.headline(ladder.compare_policies(pairs(spark, sf), 0.4, 0.6), 0.33)


# -- drift ----------------------------------------------------------------------------

DRIFT = f"""joined AS (SELECT n.config, n.rev_id, b.revert AS was, n.revert AS now, abs(b.p_revert - n.p_revert) AS dp, b.model_version AS vb, n.model_version AS vn, b.rev_id IS NOT NULL AS matched
  FROM reruns n LEFT JOIN (SELECT * FROM runs WHERE "set" = 'sealed' AND rev_id % 29 <> 0) b ON b.config = n.config AND b.rev_id = n.rev_id),
checks AS (
  SELECT config, count(*) FILTER (matched) AS edits, count(*) FILTER (NOT matched) AS unmatched,
    {share('count(*) FILTER (matched AND coalesce(was, false) = coalesce(now, false))', 'count(*) FILTER (matched)')} AS agreement,
    count(*) FILTER (matched AND coalesce(was, false) <> coalesce(now, false)) AS flips, {r4(exact_avg('dp'))} AS mean_abs_delta_p,
    {share('count(*) FILTER (matched AND was IS NULL)', 'count(*) FILTER (matched)')} AS invalid_before, {share('count(*) FILTER (matched AND now IS NULL)', 'count(*) FILTER (matched)')} AS invalid_now,
    string_agg(DISTINCT vb, ', ' ORDER BY vb) FILTER (matched) AS versions_before, string_agg(DISTINCT vn, ', ' ORDER BY vn) FILTER (matched) AS versions_now
  FROM joined GROUP BY 1)"""

ALERTS = """concat_ws(' | ', CASE WHEN unmatched > 0 THEN 'nothing to hold against: ' || unmatched || ' reruns' END,
  CASE WHEN agreement < 0.9 THEN flips || '/' || edits || ' answers turned: ' || printf('%.1f%%', agreement * 100) || ' same, wanted 90%' END,
  CASE WHEN versions_before <> versions_now THEN 'scorer was ' || versions_before || ', is ' || versions_now END,
  CASE WHEN invalid_now - invalid_before > 0.05 THEN 'unusable answers: ' || printf('%.1f%%', invalid_now * 100) || ', earlier ' || printf('%.1f%%', invalid_before * 100) END)"""


def drift_inputs(spark, sf):
    original = b.runs(spark, sf).where("set = 'sealed' AND rev_id % 29 <> 0")
    return original, b.reruns(spark, sf)


@register("drift_checks", query(f"{RERUNS}, {DRIFT}", f"SELECT *, {ALERTS} AS alerts FROM checks"))
def drift_checks(spark, sf):
    checks = drift.compare(*drift_inputs(spark, sf))
    joined = {"versions_before": ", ", "versions_now": ", ", "alerts": " | "}
    return checks.select(*[F.array_join(c, joined[c]).alias(c) if c in joined else F.col(c) for c in checks.columns])


@register("drift_flips", query(f"{RERUNS}, {DRIFT}", "SELECT config, rev_id, was, now FROM joined WHERE matched AND coalesce(was, false) <> coalesce(now, false)"))
def drift_flips(spark, sf):
    return drift.flips(*drift_inputs(spark, sf))


RUN_TIMES = ("2024-02-01 00:00:00", "2024-02-02 00:00:00")
AT_SQL = f"CAST(epoch(CASE WHEN config < 'm' THEN TIMESTAMP '{RUN_TIMES[0]}' ELSE TIMESTAMP '{RUN_TIMES[1]}' END) AS BIGINT)"


def logged(spark, sf, rows_of, name):
    """Two checks of different configurations, each appended with its time, and the log read back."""
    path = scratch(spark, name)
    checks = drift.compare(*drift_inputs(spark, sf))
    for at, part in zip(RUN_TIMES, ("config < 'm'", "config >= 'm'"), strict=True):
        rows = rows_of(checks.where(part), F.lit(at).cast("timestamp"))
        tables.append_log(rows, path)
    return spark.read.schema(rows.schema).parquet(path).withColumn("at", F.unix_seconds("at"))


@register("drift_alert_log", query(f"{RERUNS}, {DRIFT}", f"SELECT {AT_SQL} AS at, config, unnest(string_split(alerts, ' | ')) AS alert FROM (SELECT config, {ALERTS} AS alerts FROM checks) WHERE alerts <> ''"))
def drift_alert_log(spark, sf):
    return logged(spark, sf, drift.alert_log, "alerts")


@register("drift_history", query(f"{RERUNS}, {DRIFT}", f"SELECT {AT_SQL} AS at, config, edits, agreement, {ALERTS} AS alerts FROM checks"))
def drift_history(spark, sf):
    rows = logged(spark, sf, drift.check_history, "history")
    return rows.select("at", "config", "edits", "agreement", F.array_join("alerts", " | ").alias("alerts"))


@register("degraded_runs", query(RUNS, """SELECT rev_id, CASE WHEN flip AND revert IS NOT NULL THEN NOT revert ELSE revert END AS revert, CASE WHEN flip AND revert IS NOT NULL THEN floor((1 - p_revert) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE ELSE p_revert END AS p_revert
FROM (SELECT *, CAST('0x' || substr(sha256(CAST(rev_id AS VARCHAR)), 1, 2) AS INTEGER) % 100 < 30 AS flip FROM runs WHERE config = 'small:a__terse-1')"""))
def degraded_runs(spark, sf):
    return drift.degrade(b.runs(spark, sf).where("config = 'small:a__terse-1'"), 30).select("rev_id", "revert", "p_revert")


@register("degraded_run_alerts", query(RUNS, f"""SELECT config, count(*) AS edits, {share("count(*) FILTER (NOT flip OR revert IS NULL)", 'count(*)')} AS agreement, {share("count(*) FILTER (NOT flip OR revert IS NULL)", 'count(*)')} < 0.9 AS alerted
FROM (SELECT *, CAST('0x' || substr(sha256(CAST(rev_id AS VARCHAR)), 1, 2) AS INTEGER) % 100 < 30 AS flip FROM runs) GROUP BY 1"""))
def degraded_run_alerts(spark, sf):
    runs = b.runs(spark, sf)
    checks = drift.compare(runs, drift.degrade(runs, 30))
    return checks.select("config", "edits", "agreement", (F.size("alerts") > 0).alias("alerted"))


@register("drift_eligible", query(RUNS, """SELECT config, count(*) AS rows FROM runs WHERE "set" = 'sealed' AND config NOT LIKE 'baseline:filter%' GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM eval_set WHERE "set" = 'sealed')"""))
def drift_eligible(spark, sf):
    size = b.eval_set(spark, sf).where("set = 'sealed'").agg(F.count("*")).scalar()
    return drift.eligible(b.runs(spark, sf).where("set = 'sealed'"), size)


@register(
    "drift_threshold",
    query(RUNS, f"""SELECT min(a) AS lowest_agreement, {r4('least(0.9, min(a) - 0.05)')} AS min_agreement FROM (SELECT config, pct, {share("count(*) FILTER (NOT (b % 100 < pct) OR revert IS NULL)", 'count(*)')} AS a
FROM (SELECT *, CAST('0x' || substr(sha256(CAST(rev_id AS VARCHAR)), 1, 2) AS INTEGER) AS b FROM runs), (VALUES (2), (5)) v(pct) GROUP BY ALL)"""),
)
def drift_threshold(spark, sf):
    runs = b.runs(spark, sf)
    measured = drift.variance(runs, drift.degrade(runs, 2), drift.degrade(runs, 5))
    earlier = measured.where("config < 'm'").withColumn("vs_original_a", F.lit(0.1))
    return drift.threshold(drift.merge_basis(earlier, measured))


@register("stored_runs", query(RUNS, """SELECT "set", config, count(*) AS n, count(*) FILTER (revert) AS flagged, count(*) FILTER (revert IS NULL) AS invalid FROM runs GROUP BY ALL"""))
def stored_runs(spark, sf):
    """Runs appended to the partitioned run table in two steps, the second resuming the first."""
    from tidemark.session import scratch
    from tidemark.sources import tables

    path = scratch(spark, "runs")
    runs = b.runs(spark, sf).withColumn("raw", F.lit(None).cast("string"))
    tables.append_runs(runs.where("rev_id % 2 = 0"), path)
    done = tables.read_runs(spark, path)
    rest = runs.join(done.select("set", "config", "rev_id"), ["set", "config", "rev_id"], "left_anti")
    tables.append_runs(rest, path)
    stored = tables.read_runs(spark, path)
    return stored.groupBy("set", "config").agg(F.count("*").alias("n"), F.count_if("revert").alias("flagged"), F.count_if(F.col("revert").isNull()).alias("invalid"))
