"""SQL forms of the bindings, shared by the reference queries."""

from __future__ import annotations

from tidemark.catalog.bindings import CONFIGS, PRICES


def r4(x: str) -> str:
    return f"(floor(({x}) * 10000.0 + 0.5) / 10000.0)"


def share(part: str, total: str) -> str:
    return r4(f"CAST({part} AS DOUBLE) / NULLIF(CAST({total} AS DOUBLE), 0)")


def wilson(prefix: str, s: str, n: str, with_n: bool = True) -> str:
    p = f"(CAST({s} AS DOUBLE) / NULLIF({n}, 0))"
    d = f"(1 + 1.96*1.96 / NULLIF({n}, 0))"
    centre = f"(({p} + 1.96*1.96 / NULLIF(2.0 * {n}, 0)) / {d})"
    half = f"(1.96 * sqrt({p} * (1 - {p}) / NULLIF({n}, 0) + 1.96*1.96 / NULLIF(4.0 * {n} * {n}, 0)) / {d})"
    cols = [f"{r4(p)} AS {prefix}_rate", f"{r4(f'{centre} - {half}')} AS {prefix}_low", f"{r4(f'{centre} + {half}')} AS {prefix}_high"]
    if with_n:
        cols.append(f"CAST({n} AS BIGINT) AS {prefix}_n")
    return ", ".join(cols)


def exact_avg(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(16,12))) AS DOUBLE) / NULLIF(count({x}), 0)"


def f1(tp: str, fp: str, fn: str) -> str:
    return r4(f"CASE WHEN {tp} = 0 THEN 0.0 ELSE 2.0 * {tp} / (2.0 * {tp} + {fp} + {fn}) END")


FACTS = """facts AS (
  SELECT *, CASE WHEN k % 10 = 0 THEN off - 1000 - k ELSE off - 1 - k % 50 END AS target,
    dt_ms - (CASE WHEN k % 10 = 0 THEN 1000 + k ELSE 1 + k % 50 END) * 240000 AS target_ms
  FROM (SELECT event_id AS off, ts, epoch_us(ts) // 1000 AS dt_ms, user_id, event_type, value, k,
    CASE WHEN event_id % 97 = 5 THEN 'cut' WHEN event_id % 89 = 7 THEN 'bad id'
         WHEN event_id % 83 = 11 THEN 'other stream' WHEN event_id % 79 = 13 THEN 'bad field' ELSE 'ok' END AS state,
    CASE WHEN user_id % 10 = 0 THEN 'dewiki' ELSE 'enwiki' END AS wiki,
    CAST(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS namespace,
    'Page ' || (user_id % 40) AS title,
    CASE WHEN user_id % 6 = 0 THEN '192.0.2.' || (user_id % 250) WHEN user_id % 6 = 1 THEN '~2025-' || user_id || '-' || k
         WHEN user_id % 6 = 2 THEN 'Helper ' || user_id WHEN user_id % 6 = 3 AND k % 25 = 0 THEN NULL
         ELSE 'User ' || user_id END AS usr,
    user_id % 6 = 2 AS bot
    FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)))"""

# Readable events, in log order, with what labels need.
LOG = FACTS + """,
log AS (SELECT * FROM facts WHERE state = 'ok'),
edits AS (
  SELECT off AS rev_id, off, wiki, title, CAST(dt_ms // 1000 AS BIGINT) AS timestamp, dt_ms,
    CASE WHEN bot THEN 'bot' WHEN usr IS NULL THEN 'unknown' WHEN user_id % 6 = 1 THEN 'temporary'
         WHEN user_id % 6 = 0 THEN 'ip' ELSE 'registered' END AS user_class,
    coalesce(usr, '') AS usr, k % 3 = 0 AS minor, event_type = 'signup' AS is_new,
    CASE WHEN event_type <> 'signup' THEN k * 10 END AS length_old, k * 10 + (k % 13 - 6) * 7 AS length_new,
    CASE WHEN k % 11 <> 0 THEN 'note ' || k ELSE '' END AS comment, 'rc-' || off AS meta_id, user_id, k
  FROM log WHERE event_type IN ('click', 'view', 'signup') AND namespace = 0 AND wiki = 'enwiki'),
tags AS (
  SELECT off, dt_ms, target AS rev_id, target_ms, namespace, k, wiki FROM log WHERE event_type = 'error'),
deletions AS (
  SELECT off, dt_ms, title FROM log WHERE event_type = 'purchase' AND k % 2 = 0 AND wiki = 'enwiki')"""

ACCOUNTS = """accounts AS (
  SELECT usr, user_id, CASE WHEN user_id % 13 <> 0 THEN TIMESTAMP '2024-01-01' - to_days(CAST((user_id * 7) % 61 AS INTEGER)) END AS registration,
    n * (user_id % 17) AS editcount
  FROM (SELECT usr, user_id, count(*) AS n FROM facts WHERE usr LIKE 'User %' GROUP BY ALL) WHERE user_id % 11 <> 0),
enriched AS (
  SELECT e.*, a.usr IS NOT NULL AS found, a.registration, a.editcount
  FROM edits e LEFT JOIN accounts a ON e.user_class = 'registered' AND a.usr = e.usr),
policies AS (SELECT * FROM (VALUES ('bots', NULL, NULL), ('autoconfirmed', 4, 10), ('extendedconfirmed', 30, 500)) v(policy, days, min_edits)),
decisions AS (
  SELECT e.*, policy, CASE WHEN user_class = 'bot' THEN 'bot'
    WHEN days IS NOT NULL AND user_class = 'registered' AND found AND editcount >= min_edits
      AND (registration IS NULL OR (timestamp - epoch(registration)) / 86400.0 >= days) THEN 'trusted-account'
    ELSE 'kept' END AS rule
  FROM enriched e, policies)"""

# Labels written out as the definition reads, by correlated lookups.
LABELS = """ordered AS (
  SELECT *, max(dt_ms) OVER (ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM log),
holes AS (SELECT off, mark AS from_ms, dt_ms AS to_ms FROM ordered WHERE dt_ms - mark > {gap_ms}),
reverts AS (SELECT off, dt_ms, rev_id FROM tags WHERE wiki = 'enwiki' AND k % 4 IN (1, 2)),
first_tag AS (
  SELECT e.rev_id, min(r.off) AS off FROM edits e JOIN reverts r ON r.rev_id = e.rev_id AND r.off > e.off GROUP BY ALL),
label_rows AS (
  SELECT e.rev_id, e.title, e.timestamp * 1000 AS edit_ms, e.off AS source_offset,
    CASE WHEN r.dt_ms <= e.timestamp * 1000 + {window_ms} THEN r.dt_ms END AS tag_ms,
    EXISTS (SELECT 1 FROM deletions d WHERE d.title = e.title AND d.off > e.off AND d.dt_ms <= e.timestamp * 1000 + {window_ms}) AS dropped,
    (SELECT min(h.from_ms) FROM holes h WHERE h.off > e.off) < e.timestamp * 1000 + {window_ms} + 600000 AS holed
  FROM edits e LEFT JOIN first_tag f USING (rev_id) LEFT JOIN reverts r ON r.off = f.off
  WHERE (SELECT max(dt_ms) FROM log) >= e.timestamp * 1000 + {window_ms} + 600000),
labels_ AS (
  SELECT rev_id, title, edit_ms, source_offset, tag_ms,
    CASE WHEN tag_ms IS NOT NULL THEN 'reverted' WHEN dropped THEN 'deleted' WHEN coalesce(holed, false) THEN 'incomplete' ELSE 'not-reverted' END AS label
  FROM label_rows)"""


def labels(gap_ms: int, window_ms: int = 72 * 3_600_000) -> str:
    return LABELS.format(gap_ms=gap_ms, window_ms=window_ms)


_CONFIGS = ", ".join(
    f"('{n}', '{v}', {w}, {t if t is not None else 'NULL'})" for n, v, w, t in CONFIGS
)
_PRICES = ", ".join(f"('{m}', {i}, {o})" for m, i, o in PRICES)

EVAL = """eval_set AS (
  SELECT CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'sealed' END AS "set", doc_id AS rev_id,
    CASE WHEN doc_id % 4 = 0 THEN 'temporary' WHEN doc_id % 4 = 1 THEN 'ip' ELSE 'registered' END AS user_class,
    CASE WHEN doc_id % 19 = 0 THEN 'deleted' WHEN doc_id % 23 = 0 THEN 'incomplete' WHEN quality = 0 THEN 'reverted' ELSE 'not-reverted' END AS label,
    quality, n_chars
  FROM documents JOIN labels USING (doc_id))"""

RUNS = EVAL + f""",
configs AS (SELECT * FROM (VALUES {_CONFIGS}) v(config, model_version, w, tokens)),
prices AS (SELECT * FROM (VALUES {_PRICES}) v(model, input, output)),
runs AS (
  SELECT "set", config, rev_id, CASE WHEN NOT bad THEN p >= 0.5 END AS revert, CASE WHEN NOT bad THEN p END AS p_revert,
    CASE WHEN tokens IS NULL THEN 0.0::DOUBLE ELSE ((rev_id * w) % 900 + 100)::DOUBLE END AS latency_ms,
    tokens + rev_id % 50 AS tokens_in, CASE WHEN tokens IS NOT NULL THEN 20 + rev_id % 9 END AS tokens_out, model_version
  FROM (SELECT *, (rev_id * w) % 31 = 3 AS bad,
      floor((((rev_id * w + n_chars * 7) % 101)::DOUBLE / 100.0::DOUBLE * 0.7::DOUBLE + (CASE WHEN quality = 0 THEN 0.3 ELSE 0.0 END)::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS p
    FROM eval_set, configs WHERE NOT (config = 'large:b__terse-1' AND rev_id % 10 = 7)))"""

RERUNS = RUNS + """,
reruns AS (
  SELECT "set", config, rev_id,
    CASE WHEN lost THEN NULL WHEN flip THEN NOT revert ELSE revert END AS revert,
    CASE WHEN lost THEN NULL WHEN flip THEN 1 - p_revert ELSE p_revert END AS p_revert,
    CASE WHEN config = 'small:a__rules-4' THEN 'a@2' ELSE model_version END AS model_version
  FROM (SELECT *, (config = 'small:a__terse-1' AND rev_id % 5 = 1) OR (config = 'large:b__rules-4' AND rev_id % 50 = 3) AS flip,
      config = 'large:b__rules-4' AND rev_id % 7 = 2 AS lost FROM runs WHERE "set" = 'sealed'))"""

SAMPLES = FACTS + """,
samples AS (
  SELECT make_timestamp((m + k % 20) * 1000000) AS t, CASE WHEN k % 29 <> 0 THEN k % 6 + 1 END AS replicas, k * 3 AS classifier_lag,
    CASE WHEN k % 31 <> 0 THEN off + 1 END AS scored
  FROM (SELECT CAST(dt_ms // 60000 * 60 AS BIGINT) AS m, max(off) AS off, arg_max(k, off) AS k FROM facts GROUP BY 1))"""

MINUTES = SAMPLES + """,
steps AS (
  SELECT *, lag(scored) OVER (ORDER BY t) AS last_scored, epoch(t) - lag(epoch(t)) OVER (ORDER BY t) AS step FROM samples),
minutes AS (
  SELECT t, (scored - last_scored) * 60 / step AS feed, replicas, classifier_lag AS lag
  FROM steps WHERE step > 0 AND step <= 180 AND scored IS NOT NULL AND last_scored IS NOT NULL AND replicas IS NOT NULL)"""

# Kept edits per minute: every third k counts as dropped.
KEPT = """kept AS (
  SELECT CAST(dt_ms // 60000 * 60 AS BIGINT) AS m, count(*) AS all_n, count(*) FILTER (k % 3 <> 0) AS kept_n FROM facts GROUP BY 1)"""

PAIRS = """turn_pairs AS (
  SELECT a.conv_id, a.turn, a.text AS asked, b.text AS answered FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"""


def query(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
