"""Queries of the core operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import parsing as P
from tracelode.functions import text as T
from tracelode.operators import checks as C
from tracelode.operators import datasets as D
from tracelode.operators import external as E
from tracelode.operators import gates as G
from tracelode.operators import runs as R
from tracelode.operators import schema_drift
from tracelode.operators import scorelog as L
from tracelode.operators import similarity as S
from tracelode.operators import traces as X
from tracelode.session import materialise
from tracelode.streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(source: str, sql: str | None = None):
    """Registers a function of one table as a query, with its SQL."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(table(spark, sf_dir, source))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- schema drift


@query("raw_export")
def p6_found(lines):
    return schema_drift.schema_changes(lines)


@query("raw_export")
def p6_eval_records(lines):
    return schema_drift.consistent_table(lines, "eval")


@query("raw_export")
def p6_report_records(lines):
    return schema_drift.consistent_table(lines, "report")


@query(
    "raw_export",
    """WITH l AS (SELECT DISTINCT file_name, line_no, payload FROM raw_export WHERE stream LIKE 'eval/%' OR stream LIKE 'report/%'),
    r AS (SELECT file_name, json(payload) AS j FROM l WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
    v AS (SELECT file_name, count(*) AS n_values FROM r, json_tree(r.j) AS t WHERE t.type NOT IN ('OBJECT', 'NULL') AND NOT contains(t.fullkey, '[') GROUP BY 1)
    SELECT file_name, count(*) AS records, coalesce(any_value(n_values), 0)::BIGINT AS n_values FROM r LEFT JOIN v USING (file_name) GROUP BY 1""",
)
def p6_kept_values(lines):
    return schema_drift.kept_values(lines, ("eval", "report"))


# ---- score log

_SUMMARY = """count(*) AS n, round(coalesce(avg(CASE WHEN error_flag IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.0), 6) AS error_rate,
    round(avg(raw_score) FILTER (error_flag IS NULL), 6) AS mean_score, round(stddev_samp(raw_score) FILTER (error_flag IS NULL), 6) AS std_score,
    round(coalesce(avg(CASE WHEN raw_score <= 0.05 OR raw_score >= 0.95 THEN 1.0 ELSE 0.0 END) FILTER (error_flag IS NULL AND raw_score IS NOT NULL), 0.0), 6) AS dead_zone,
    round(coalesce(sum(token_cost_estimate), 0.0), 6) AS total_cost, count(DISTINCT generation) AS generations, max(generation) AS latest_generation"""
_SINCE = """WITH m AS (SELECT generation, count(*) n, count(error_flag) e, count(raw_score) FILTER (error_flag IS NULL) k, coalesce(sum(raw_score) FILTER (error_flag IS NULL), 0) sx,
      coalesce(sum(raw_score * raw_score) FILTER (error_flag IS NULL), 0) sxx FROM judge_audit_log WHERE generation IS NOT NULL GROUP BY 1),
    s AS (SELECT generation, sum(n) OVER w n, sum(e) OVER w e, sum(k) OVER w k, sum(sx) OVER w sx, sum(sxx) OVER w sxx FROM m WINDOW w AS (ORDER BY generation ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    since AS (SELECT generation, CAST(n AS BIGINT) AS n, round(e / n, 6) AS error_rate, round(CASE WHEN k > 0 THEN sx / k END, 6) AS mean_score,
      round(CASE WHEN k > 1 THEN sqrt(greatest(0.0, (sxx - sx * sx / k) / (k - 1))) END, 6) AS std_score FROM s)"""


@query("judge_audit_log", "SELECT error_flag, count(*) AS n FROM judge_audit_log WHERE error_flag IS NOT NULL GROUP BY 1")
def score_errors(log):
    return L.error_counts(log)


@query("judge_audit_log", f"SELECT {_SUMMARY} FROM judge_audit_log")
def score_summary(log):
    return L.summary(log)


@query("judge_audit_log", f"SELECT skill_name, {_SUMMARY} FROM judge_audit_log GROUP BY 1")
def score_summary_by_skill(log):
    return L.summary(log, "skill_name")


@query("judge_audit_log", """SELECT skill_name, generation, count(*) AS n, round(avg(raw_score), 4) AS avg_score, round(avg(latency_ms), 1) AS avg_latency, count(error_flag) AS errors
    FROM judge_audit_log GROUP BY 1, 2""")
def score_by_skill_generation(log):
    return L.by_skill_generation(log)


@query("judge_audit_log", "SELECT DISTINCT generation FROM judge_audit_log WHERE generation IS NOT NULL")
def score_generations(log):
    return log.select("generation").filter("generation is not null").distinct()


@query("judge_audit_log", _SINCE + " SELECT * FROM since")
def score_since_generation(log):
    return L.since_generation(log)


@query("judge_audit_log", _SINCE + f""", whole AS (SELECT {_SUMMARY} FROM judge_audit_log),
    b AS (SELECT 'STD_DEV_FLAT' AS code, std_score AS value, 0.08::DOUBLE AS threshold, generation FROM since WHERE std_score < 0.08
      UNION ALL SELECT 'RUBBER_STAMP', mean_score, 0.9, generation FROM since WHERE mean_score > 0.9 UNION ALL SELECT 'OVERLY_HARSH', mean_score, 0.15, generation FROM since WHERE mean_score < 0.15),
    r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY generation DESC) r FROM b), t AS (SELECT code, max(generation) g, min(generation) lo, count(*) k FROM r WHERE r <= 3 GROUP BY 1)
    SELECT r.code, r.value, r.threshold, r.generation FROM r JOIN t ON t.code = r.code WHERE r.r = 1 AND t.k = 3 AND t.g - t.lo = 2
    UNION ALL SELECT 'JUDGE_ERRORS', error_rate, 0.005, latest_generation FROM whole WHERE error_rate > 0.005 UNION ALL SELECT 'DEAD_ZONE', dead_zone, 0.8, latest_generation FROM whole WHERE dead_zone > 0.8""")
def score_health_alerts(log):
    return L.health_alerts(log)


@query("judge_audit_log", "SELECT id, timestamp, skill_name, generation, raw_score FROM judge_audit_log ORDER BY timestamp DESC, id DESC LIMIT 20")
def score_recent(log):
    return L.recent(log, 20).select("id", "timestamp", "skill_name", "generation", "raw_score")


@query("judge_audit_log", """WITH l AS (SELECT skill_name, max(timestamp) AS last FROM judge_audit_log WHERE skill_name IS NOT NULL GROUP BY 1)
    SELECT l.skill_name, max(l.last) AS until, round(coalesce(sum(token_cost_estimate), 0.0), 6) AS cost FROM judge_audit_log j JOIN l ON j.skill_name = l.skill_name
    WHERE j.timestamp >= l.last - INTERVAL 2 HOUR GROUP BY 1""")
def score_run_cost(log):
    return L.run_cost(log)


@query("judge_audit_log", """SELECT * FROM (SELECT id, generation, skill_name, task_id, raw_score,
      CASE WHEN ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT % 10000 < 500 THEN 'random_sample' WHEN raw_score BETWEEN 0.35 AND 0.70 THEN 'uncertain_zone' END AS reason
    FROM judge_audit_log WHERE error_flag IS NULL) WHERE reason IS NOT NULL""")
def score_appeal_sample(log):
    return L.appeal_sample(log)


_PAIRS = """WITH r AS (SELECT task_id, generation, lower(trim(model_used)) AS judge, raw_score, id FROM judge_audit_log WHERE error_flag IS NULL AND coalesce(task_id, '') <> ''),
    o AS (SELECT task_id, generation, judge, min_by(raw_score, id) AS score FROM r WHERE judge IN ('umbra/verdict', 'tessel/eval-2') GROUP BY 1, 2, 3),
    p AS (SELECT * FROM (SELECT task_id, generation, max(score) FILTER (judge = 'umbra/verdict') AS a, max(score) FILTER (judge = 'tessel/eval-2') AS b FROM o GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL),
    q AS (SELECT generation, CASE WHEN a < 0.35 THEN 0 WHEN a < 0.7 THEN 1 ELSE 2 END AS x, CASE WHEN b < 0.35 THEN 0 WHEN b < 0.7 THEN 1 ELSE 2 END AS y FROM p)"""
_KAPPA = """count(*) AS pairs, avg((x = y)::INT) AS ob, avg((x = 0)::INT) * avg((y = 0)::INT) + avg((x = 1)::INT) * avg((y = 1)::INT) + avg((x = 2)::INT) * avg((y = 2)::INT) AS ex"""
_KAPPA_OUT = "pairs, round(ob, 6) AS agreement, round(CASE WHEN ex >= 1 THEN 1.0 ELSE greatest(-1.0, least(1.0, (ob - ex) / (1 - ex))) END, 6) AS kappa"


def _pairs(log: DataFrame) -> DataFrame:
    return L.tier_pairs(log, "umbra/verdict", "tessel/eval-2")


@query("judge_audit_log", f"{_PAIRS} SELECT {_KAPPA_OUT} FROM (SELECT {_KAPPA} FROM q)")
def score_kappa(log):
    return L.kappa(_pairs(log))


@query("judge_audit_log", f"{_PAIRS} SELECT generation, {_KAPPA_OUT} FROM (SELECT generation, {_KAPPA} FROM q GROUP BY 1)")
def score_kappa_by_generation(log):
    return L.kappa(_pairs(log), "generation")


@query("judge_audit_log", f"""{_PAIRS}, k AS (SELECT generation, {_KAPPA_OUT} FROM (SELECT generation, {_KAPPA} FROM q GROUP BY 1)), e AS (SELECT * FROM k WHERE pairs >= 3),
    g AS (SELECT max(generation) AS good FROM e WHERE kappa >= 0.6)
    SELECT *, breaches >= 2 AS halt FROM (SELECT count(*) AS generations, count(*) FILTER (good IS NULL OR generation > good) AS breaches FROM e, g)""")
def score_kappa_breaches(log):
    return L.kappa_breaches(L.kappa(_pairs(log), "generation"))


@query("judge_audit_log", """WITH m AS (SELECT lower(trim(model_used)) AS variant, count(*) AS n, round(avg(raw_score), 6) AS mean_score FROM judge_audit_log WHERE error_flag IS NULL GROUP BY 1), t AS (SELECT max(mean_score) AS top FROM m)
    SELECT variant, n, mean_score, round(mean_score - top, 6) AS behind_best, variant = (SELECT min(variant) FROM m, t WHERE mean_score = top) AS winner FROM m, t""")
def score_variants(log):
    return L.variant_means(log, F.lower(F.trim("model_used")))


@query("judge_audit_log", """SELECT round(c, 6) AS canary_mean, round(o, 6) AS other_mean, CAST((c IS NOT NULL AND o IS NOT NULL)::INT + coalesce(abs(c - o) >= 0.1, false)::INT + coalesce(c < o, false)::INT AS INTEGER) AS passed
    FROM (SELECT avg(raw_score) FILTER (error_flag IS NULL AND task_id = 'canary-0001') AS c, avg(raw_score) FILTER (error_flag IS NULL AND task_id <> 'canary-0001') AS o FROM judge_audit_log)""")
def score_calibration(log):
    return L.calibration(log, "canary-0001")


@query("judge_audit_log", """SELECT id, substr(sha1(coalesce(actual_behavior, '')), 1, 12) AS body_hash, sha256(coalesce(actual_behavior, '')) AS text_hash, md5(coalesce(actual_behavior, '')) AS key_hash FROM judge_audit_log""")
def score_text_hashes(log):
    t = F.coalesce("actual_behavior", F.lit(""))
    return log.select("id", F.substring(F.sha1(t), 1, 12).alias("body_hash"), F.sha2(t, 256).alias("text_hash"), F.md5(t).alias("key_hash"))


# ---- runs

_RUNS = """WITH d AS (SELECT * FROM run_report QUALIFY row_number() OVER (PARTITION BY skill, run_id ORDER BY evolved_score DESC NULLS LAST, baseline_score DESC NULLS LAST, elapsed_seconds DESC NULLS LAST, improvement DESC NULLS LAST) = 1),
    c AS (SELECT *, evolved_score - baseline_score AS delta FROM d WHERE skill IS NOT NULL), s AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY ts NULLS FIRST, run_id) AS i FROM c WHERE evolved_score IS NOT NULL)"""
_CARDS = """SELECT skill, count(*) AS run_count, count(*) FILTER (delta < 0) AS regressions, round(max(delta), 6) AS best_delta,
    first(run_id ORDER BY delta DESC NULLS LAST, ts DESC, run_id DESC) FILTER (delta IS NOT NULL) AS best_run, first(run_id ORDER BY ts DESC, run_id DESC) AS latest_run, round(first(delta ORDER BY ts DESC, run_id DESC), 6) AS latest_delta, count(*) > 1 AS multi_run FROM c GROUP BY 1"""


@query("run_report", f"{_RUNS} {_CARDS}")
def run_cards(runs):
    return R.cards(runs)


@query("run_report", f"{_RUNS}, k AS ({_CARDS}) SELECT * FROM k WHERE best_delta >= 0.01 AND multi_run AND contains(lower(skill || chr(10) || coalesce(best_run, '') || chr(10) || coalesce(latest_run, '')), 'er') ORDER BY best_delta DESC NULLS LAST, skill LIMIT 10")
def run_cards_found(runs):
    return R.top(R.filtered(R.cards(runs), delta_min=0.01, multi_run=True, search="er"), "best_delta", 10, "skill")


@query("run_report", f"{_RUNS} SELECT skill, run_id, round(improvement, 6) AS improvement FROM c WHERE improvement <> 999.0 QUALIFY row_number() OVER (PARTITION BY skill ORDER BY abs(improvement) DESC, ts NULLS FIRST, run_id) = 1")
def run_strongest(runs):
    return R.strongest(runs)


@query("run_report", f"""{_RUNS} SELECT skill, run_id, try_strptime(nullif(regexp_extract(run_id, '(\\d{{8}}_\\d{{6}})$', 1), ''), '%Y%m%d_%H%M%S') AS at,
    coalesce(TIMESTAMP '2025-01-20 00:00:00' - INTERVAL 24 HOUR < try_strptime(nullif(regexp_extract(run_id, '(\\d{{8}}_\\d{{6}})$', 1), ''), '%Y%m%d_%H%M%S'), false) AS is_recent FROM d""")
def run_recency(runs):
    return R.recency(runs, "2025-01-20 00:00:00")


@query("run_report", f"""{_RUNS}, w AS (SELECT skill, run_id, max(evolved_score) OVER f - min(evolved_score) OVER f AS width, count(*) OVER f AS k FROM s WINDOW f AS (PARTITION BY skill ORDER BY ts NULLS FIRST, run_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT skill, run_id, round(CASE WHEN k = 3 THEN width END, 6) AS range, k = 3 AND width <= 0.01 + 1e-10 AS plateau FROM w""")
def run_plateaus(runs):
    return R.plateaus(runs)


@query("run_report", f"""{_RUNS}, f AS (SELECT *, first_value(evolved_score) OVER w AS f0, lag(run_id) OVER w AS prev, lag(evolved_score) OVER w AS ps FROM s WINDOW w AS (PARTITION BY skill ORDER BY ts NULLS FIRST, run_id)),
    g AS (SELECT *, (evolved_score - ps) / CASE WHEN f0 = 0 THEN 1e-9 ELSE f0 END AS step FROM f), m AS (SELECT skill, max_by(prev, i) FILTER (step > 0.01) AS usable, max(i) AS n FROM g GROUP BY 1)
    SELECT m.skill, coalesce(usable, s.run_id) AS target, usable IS NOT NULL AS by_gain FROM m JOIN s ON s.skill = m.skill AND s.i = CASE WHEN n >= 3 THEN n - 2 ELSE 1 END""")
def run_backtrack_targets(runs):
    return R.backtrack_targets(runs)


@query("run_report", f"""{_RUNS}, w AS (SELECT skill, run_id, ts, count(*) OVER f = 3 AND max(evolved_score) OVER f - min(evolved_score) OVER f <= 0.01 + 1e-10 AS p FROM s WINDOW f AS (PARTITION BY skill ORDER BY ts NULLS FIRST, run_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    k AS (SELECT *, least(coalesce(sum(p::INT) OVER (PARTITION BY skill ORDER BY ts NULLS FIRST, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS n FROM w)
    SELECT skill, run_id, CASE WHEN n >= 3 THEN 'force_archive' WHEN p THEN 'backtrack' ELSE 'continue' END AS action FROM k""")
def run_backtrack_actions(runs):
    return R.backtrack_actions(runs)


@query("run_report", f"{_RUNS} SELECT skill, run_id, round(max(evolved_score) OVER (PARTITION BY skill ORDER BY ts NULLS FIRST, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_so_far FROM s")
def run_running_best(runs):
    return R.running_best(runs)


@query("run_report", f"""{_RUNS}, r AS (SELECT *, coalesce(elapsed_seconds, 0) / 10000.0 AS cost FROM c WHERE improvement IS NOT NULL QUALIFY row_number() OVER (PARTITION BY skill ORDER BY ts DESC, run_id DESC) <= 3),
    m AS (SELECT skill, count(*) AS runs, count(*) FILTER (improvement <> 999.0 AND cost >= 0.01 AND improvement < 0.005) AS worthless, coalesce(bool_or(improvement <> 999.0 AND cost >= 0.01 AND improvement >= 0.005), false) AS reset FROM r GROUP BY 1)
    SELECT *, runs = 3 AND NOT reset AND worthless >= 3 AS open FROM m""")
def run_cost_breaker(runs):
    return R.cost_breaker(runs, F.coalesce("elapsed_seconds", F.lit(0.0)) / 10000.0)


_FIT = """, y AS (SELECT skill, i::DOUBLE AS i, first_value(evolved_score) OVER (PARTITION BY skill ORDER BY ts NULLS FIRST, run_id) AS b, evolved_score FROM s),
    l AS (SELECT skill, b, ln(i) AS x, ln(greatest(evolved_score - b + 1e-10, 1e-10)) AS v FROM y),
    fit AS (SELECT skill, count(*) AS n, round(regr_slope(v, x), 4) AS exponent, round(exp(regr_intercept(v, x)), 4) AS scale, round(min(b), 4) AS "offset" FROM l GROUP BY 1 HAVING count(*) >= 4)"""


@query("run_report", f"{_RUNS}{_FIT} SELECT * FROM fit")
def run_power_law(runs):
    return R.power_law(runs)


@query("run_report", f"""{_RUNS}{_FIT} SELECT skill, coalesce(list_filter(range(n + 1, 2 * n + 10), lambda i: scale * (pow(i::DOUBLE, exponent) - pow((i - 1)::DOUBLE, exponent)) < 0.005)[1], n) AS stop FROM fit""")
def run_first_small_gain(runs):
    return R.first_small_gain(R.power_law(runs))


@query("run_report", f"""{_RUNS}{_FIT}, m AS (SELECT fit.*, round(1 - sum((s.evolved_score - (scale * pow(s.i::DOUBLE, exponent) + "offset")) ** 2) / greatest(var_pop(s.evolved_score) * count(*), 1e-10), 4) AS r2 FROM s JOIN fit USING (skill) GROUP BY ALL),
    p AS (SELECT *, CASE WHEN exponent < 0.05 AND r2 > 0.5 THEN 'plateau' WHEN exponent < 0.2 THEN 'diminishing_returns' ELSE 'early_discovery' END AS phase FROM m)
    SELECT skill, n, r2, phase, round(least(1.0, CASE phase WHEN 'plateau' THEN greatest(0.5, (0.05 - exponent) / 0.05) WHEN 'diminishing_returns' THEN greatest(0.4, (0.2 - exponent) / 0.2) ELSE greatest(0.3, (exponent - 0.2) / 0.2 + 0.3) END), 4) AS confidence,
      CASE phase WHEN 'plateau' THEN 'stop' WHEN 'diminishing_returns' THEN 'wind_down' ELSE 'continue' END AS action, list_filter(range(n + 1, 2 * n + 10), lambda i: scale * (pow(i::DOUBLE, exponent) - pow((i - 1)::DOUBLE, exponent)) < 0.03)[1] AS stop,
      round(greatest(0.0, least(1.0, scale * pow(2.0::DOUBLE * n, exponent) + "offset")), 4) AS at_double FROM p""")
def run_phases(runs):
    return R.fit_phases(runs)


@query("run_report", f"""{_RUNS} SELECT skill, run_id, round(baseline_score - evolved_score, 6) AS lost, CASE WHEN round(baseline_score - evolved_score, 6) > 0.05 THEN 'regression' WHEN evolved_score >= baseline_score THEN 'pass' ELSE 'minor' END AS verdict
    FROM d WHERE baseline_score IS NOT NULL AND evolved_score IS NOT NULL""")
def run_regressions(runs):
    return R.regressions(runs)


@query("run_report", f"""{_RUNS}, g AS (SELECT skill, run_id, [CASE WHEN NOT coalesce(constraints_passed, false) THEN 'constraints' END, CASE WHEN NOT coalesce(round(delta, 6) >= 0, false) THEN 'delta' END, CASE WHEN NOT coalesce((100.0 + 20 * iterations - 100) / 100 <= 0.5, false) THEN 'growth' END] AS f FROM c)
    SELECT skill, run_id, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS failed FROM g""")
def run_gate(runs):
    d = R.distinct_runs(runs).filter("skill is not null")
    rows = d.select("skill", "run_id", R.delta().alias("delta"), "constraints_passed", F.lit(100.0).alias("baseline_size"), (100.0 + 20 * F.col("iterations")).alias("evolved_size"))
    return R.report_gate(rows).select("skill", "run_id", F.array_join("failed", ",").alias("failed"))


@query("run_report", f"""{_RUNS}, r AS (SELECT *, coalesce(elapsed_seconds, 0) / 10000.0 AS cost FROM c WHERE improvement IS NOT NULL QUALIFY row_number() OVER (PARTITION BY skill ORDER BY ts DESC, run_id DESC) <= 2),
    m AS (SELECT skill, count(*) AS runs, count(*) FILTER (improvement <> 999.0 AND cost >= 0.001 AND improvement < 0.05) AS worthless, coalesce(bool_or(improvement <> 999.0 AND cost >= 0.001 AND improvement >= 0.05), false) AS reset, max(ts) AS newest FROM r GROUP BY 1)
    SELECT skill, runs, worthless, reset, runs = 2 AND NOT reset AND worthless >= 2 AND NOT coalesce(TIMESTAMP '2025-03-01 00:00:00' - INTERVAL 30 DAY > newest, false) AS open FROM m""")
def run_cost_breaker_with_cooldown(runs):
    return R.cost_breaker(runs, F.coalesce("elapsed_seconds", F.lit(0.0)) / 10000.0, 2, 0.001, 0.05, "2025-03-01 00:00:00", 30)


@query("run_report", f"""{_RUNS}, p AS (SELECT skill, run_id, evolved_score, -elapsed_seconds AS speed FROM c WHERE evolved_score IS NOT NULL AND elapsed_seconds IS NOT NULL)
    SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.evolved_score >= p.evolved_score AND q.speed >= p.speed AND (q.evolved_score > p.evolved_score OR q.speed > p.speed))""")
def run_skyline(runs):
    points = R.distinct_runs(runs).filter("skill is not null").select("skill", "run_id", "evolved_score", (-F.col("elapsed_seconds")).alias("speed"))
    return R.skyline(points, "evolved_score", "speed")


@query("run_report", f"""{_RUNS}, a AS (SELECT skill, run_id, unnest(attempt_metrics) AS m FROM d WHERE len(attempt_metrics) > 0)
    SELECT skill, run_id, count(*) AS attempts, first(m.attempt ORDER BY m.avg_evolved DESC NULLS LAST, m.attempt) AS best_attempt, round(max(m.avg_evolved), 6) AS best_evolved FROM a GROUP BY 1, 2""")
def run_best_attempts(runs):
    return R.best_attempts(runs)


@query("run_report", f"""{_RUNS} SELECT skill, run_id, round((evolved_score - baseline_score) / greatest(baseline_score, 0.001), 6) AS improvement_pct,
    coalesce(CASE WHEN baseline_score <> 0 THEN (evolved_score - baseline_score) / baseline_score >= 0.05 END, false) AS significant FROM d WHERE baseline_score IS NOT NULL AND evolved_score IS NOT NULL""")
def run_relative_gains(runs):
    return R.relative_gains(runs)


@query("run_report", f"""{_RUNS}, k AS (SELECT CASE WHEN p IS NULL THEN 'unscored' WHEN p > 0.01 THEN 'improved' WHEN p < -0.01 THEN 'regressed' ELSE 'flat' END AS outcome FROM (SELECT (evolved_score - baseline_score) / greatest(baseline_score, 0.001) AS p FROM d))
    SELECT f.outcome, count(k.outcome) AS runs FROM (VALUES ('improved'), ('flat'), ('regressed'), ('unscored')) f(outcome) LEFT JOIN k ON k.outcome = f.outcome GROUP BY 1""")
def run_outcome_counts(runs):
    return R.status_counts(runs)


@query("run_report", f"""{_RUNS}, o AS (SELECT skill, max(evolved_score) AS score, min(eval_source) AS origin FROM c WHERE ts < TIMESTAMP '2025-01-12 00:00:00' GROUP BY 1), n AS (SELECT skill, max(evolved_score) AS score, min(eval_source) AS origin FROM c WHERE ts >= TIMESTAMP '2025-01-12 00:00:00' GROUP BY 1)
    SELECT coalesce(o.skill, n.skill) AS skill, coalesce(n.score, o.score) AS score, coalesce(o.origin, n.origin) AS origin, CASE WHEN o.skill IS NULL THEN 'insert' WHEN n.skill IS NULL THEN 'stale' ELSE 'update' END AS change FROM o FULL JOIN n ON o.skill = n.skill""")
def run_snapshot_upsert(runs):
    d = R.distinct_runs(runs).filter("skill is not null")
    side = lambda rows: rows.groupBy("skill").agg(F.max("evolved_score").alias("score"), F.min("eval_source").alias("origin"))
    cut = F.lit("2025-01-12 00:00:00").cast("timestamp_ntz")
    return R.upsert(side(d.filter(F.col("ts") < cut)), side(d.filter(F.col("ts") >= cut)), "skill", keep=("origin",))


@query("run_report", f"{_RUNS} SELECT skill, run_id FROM c QUALIFY row_number() OVER (PARTITION BY skill ORDER BY ts DESC, run_id DESC) = 1 AND NOT coalesce(constraints_passed = false, false)")
def run_latest_state(runs):
    d = R.distinct_runs(runs).filter("skill is not null")
    return R.latest_state(d, "skill", ["ts", "run_id"], F.coalesce(~F.col("constraints_passed"), F.lit(False))).select("skill", "run_id")


# ---- traces

_ROLE = """CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'model', 'agent') THEN 'assistant'
    WHEN lower(trim(role)) IN ('tool', 'function', 'tool_result') THEN 'tool' WHEN lower(trim(role)) IN ('system', 'developer') THEN 'system' END"""
_MSG = f"""WITH m AS (SELECT * FROM (SELECT session_id, coalesce(ordinal::BIGINT, message_id) AS ord, message_id, {_ROLE} AS role, coalesce(content, '') AS content, coalesce(tool_calls, []::VARCHAR[]) AS tool_calls FROM session_message) WHERE role IS NOT NULL),
    t AS (SELECT *, CAST(sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY ord, message_id) AS BIGINT) AS turn FROM m)"""


@query("session_message", f"""{_MSG} SELECT session_id, turn, max(content) FILTER (role = 'user') AS task_input, coalesce(first(content ORDER BY ord, message_id) FILTER (role = 'assistant' AND trim(content, ' ') <> ''), '') AS response,
    count(*) FILTER (role = 'assistant' AND trim(content, ' ') <> '') AS answers FROM t WHERE turn > 0 GROUP BY 1, 2 HAVING length(max(content) FILTER (role = 'user')) >= 1""")
def trace_turn_pairs(rows):
    return X.turn_pairs(rows)


@query("session_message", f"""{_MSG}, g AS (SELECT session_id, turn, max(content) FILTER (role = 'user') AS task_input, coalesce(string_agg(content, chr(10) ORDER BY ord, message_id, content) FILTER (role = 'assistant'), '') AS response
    FROM t WHERE turn > 0 AND trim(content, ' ') <> '' AND role IN ('user', 'assistant') GROUP BY 1, 2) SELECT * FROM g WHERE length(task_input) >= 10 AND response <> ''""")
def trace_joined_pairs(rows):
    secret = D.contains_secret(F.col("task_input")) | D.contains_secret(F.col("response"))
    return X.joined_pairs(rows, secret)


@query("session_message", f"""{_MSG}, u AS (SELECT *, substr(last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ord, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1, 200) AS task FROM m)
    SELECT session_id, message_id, CAST(k - 1 AS INTEGER) AS call_no, tool_calls[k] AS tool_name, task FROM (SELECT *, unnest(range(1, len(tool_calls) + 1)) AS k FROM u WHERE role = 'assistant' AND task IS NOT NULL)""")
def trace_tool_requests(rows):
    return X.tool_requests(rows)


@query("session_message", f"""{_MSG}, c AS (SELECT session_id, ord, message_id, k, tool_calls[k] AS tool FROM (SELECT *, unnest(range(1, len(tool_calls) + 1)) AS k FROM m WHERE role = 'assistant')),
    f AS (SELECT session_id, tool, min((ord, message_id, k)) AS place, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT session_id, string_agg(tool, ',' ORDER BY place) AS tools, CAST(sum(n) AS BIGINT) AS calls, sum(n) >= 3 AS capturable FROM f GROUP BY 1""")
def trace_tool_sequences(rows):
    return X.tool_sequences(rows)


@query("session_message", f"""{_MSG} SELECT session_id, count(*) AS total, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants,
    substr(coalesce(first(content ORDER BY ord, message_id) FILTER (role = 'user'), ''), 1, 300) AS first_user, substr(coalesce(last(content ORDER BY ord, message_id) FILTER (role = 'assistant'), ''), 1, 300) AS last_assistant FROM m GROUP BY 1""")
def trace_session_counts(rows):
    return X.session_counts(rows)


#: Words that do occur in the traces stand in for the usual lists, so that every branch is met.
_GOOD, _BAD = ("passes", "promoted", "gained", "kept"), ("rejected", "stale", "lost", "missing", "fails")


def _like(column: str, words: tuple[str, ...], prefix: str) -> str:
    return ", ".join(f"max(contains({column}, '{w}')::INT) AS {prefix}{i}" for i, w in enumerate(words))


_OUT = f"""{_MSG}, o AS (SELECT session_id, count(*) AS messages, CAST(sum(length(content)) AS BIGINT) AS chars, {_like('lower(content)', _GOOD, 's')}, {_like('lower(content)', _BAD, 'f')},
      count(*) FILTER (role = 'user' AND ({' OR '.join(f"contains(lower(content), '{w}')" for w in _BAD[:3])})) AS corrections FROM m GROUP BY 1),
    p AS (SELECT session_id, messages, chars, CAST({' + '.join(f's{i}' for i in range(len(_GOOD)))} AS INTEGER) AS successes, CAST({' + '.join(f'f{i}' for i in range(len(_BAD)))} AS INTEGER) AS failures, corrections FROM o),
    q AS (SELECT *, CASE WHEN failures > successes AND corrections > 1 THEN 'failed' WHEN successes > failures AND corrections = 0 THEN 'succeeded' WHEN corrections > 0 THEN 'partial' ELSE 'unknown' END AS outcome FROM p)"""


def _outcomes(rows):
    return X.outcomes(rows, _GOOD, _BAD, 3)


@query("session_message", f"{_OUT} SELECT * FROM q")
def trace_outcomes(rows):
    return _outcomes(rows)


@query("session_message", f"{_OUT} SELECT outcome, count(*) AS sessions, round(100.0 * count(*) / (SELECT count(*) FROM q), 4) AS percent FROM q GROUP BY 1")
def trace_outcome_shares(rows):
    return X.outcome_shares(_outcomes(rows))


@query("session_message", f"{_OUT} SELECT session_id FROM q WHERE outcome = 'succeeded' AND messages >= 4 AND chars > 500")
def trace_good_examples(rows):
    return X.good_examples(_outcomes(rows), 4, 500).select("session_id")


@query("session_message", f"""{_MSG}, x AS (SELECT session_id, count(*) FILTER (role = 'assistant' AND length(content) > 200 AND (contains(lower(content), 'rather') OR contains(lower(content), 'whether') OR contains(lower(content), 'until')) AND
      (len(regexp_extract_all(lower(content), 'the ')) >= 2 OR len(regexp_extract_all(content, chr(10))) + 1 > 10)) AS long_briefing,
    CASE WHEN NOT coalesce(bool_or(role = 'assistant' AND (contains(lower(content), 'rubric') OR contains(lower(content), 'dataset'))), false) THEN count(*) FILTER (role = 'user') ELSE 0 END AS raw_dump,
    count(*) FILTER (role = 'assistant' AND len(tool_calls) = 0 AND length(content) > 200 AND (contains(lower(content), 'check') OR contains(lower(content), 'run') OR contains(lower(content), 'inspect'))) AS tool_underuse,
    count(*) FILTER (role = 'assistant' AND contains(lower(content), 'skill') AND length(content) > 100 AND (contains(lower(content), 'outdated') OR contains(lower(content), 'stale'))) AS skill_drift FROM m GROUP BY 1)
    SELECT session_id, failure_class, hits FROM (UNPIVOT x ON long_briefing, raw_dump, tool_underuse, skill_drift INTO NAME failure_class VALUE hits) WHERE hits > 0""")
def trace_failures(rows):
    return X.failures(rows, hedges=("rather", "whether", "until"), actions=("check", "run", "inspect"), stale=("outdated", "stale"), structure=("rubric", "dataset"), option="the ", long=200)


@query("session_message", """SELECT message_id, session_id, substr(reasoning, 1, 500) AS reasoning, substr(output_summary['exit_code'], 1, 200) AS exit_code, substr(output_summary['status'], 1, 200) AS status, substr(output_summary['error'], 1, 200) AS error
    FROM session_message WHERE coalesce(lower(trim(role)), '') <> 'session_meta'""")
def trace_rows(rows):
    return X.trace_rows(rows)


# ---- datasets

_EX = "eval_example"


@query(_EX, """SELECT example_id, substr(task_input, 1, 2000) AS task_input, trim(expected_behavior, ' ') AS expected_behavior, CASE WHEN lower(trim(difficulty, ' ')) IN ('easy', 'medium', 'hard') THEN lower(trim(difficulty, ' ')) ELSE 'medium' END AS difficulty,
    coalesce(nullif(trim(category, ' '), ''), 'general') AS category FROM eval_example WHERE trim(coalesce(task_input, ''), ' ') <> '' AND trim(coalesce(expected_behavior, ''), ' ') <> ''""")
def example_validated(rows):
    return D.validated(rows)


@query(_EX, """SELECT example_id, coalesce(source, '') AS source, coalesce(task_input, '') AS task_input, coalesce(project, '') AS project, coalesce(session_id, '') AS session_id, coalesce(message_role, '') AS message_role,
    coalesce(extraction_reason, '') AS extraction_reason, coalesce(nullif(trim(repo, ' '), ''), regexp_extract(coalesce(project, ''), '([^/]+)/*$', 1)) AS repo FROM eval_example""")
def example_canonical(rows):
    return D.canonical_rows(rows)


@query(_EX, "SELECT example_id, length(trim(task_input, ' ')) AS size FROM eval_example WHERE length(trim(task_input, ' ')) >= 10")
def example_prompts(rows):
    return D.prompts(rows).select("example_id", F.col("size").cast("bigint").alias("size"))


@query(_EX, """WITH w AS (SELECT example_id, lower(coalesce(task_input, '')) AS t FROM eval_example) SELECT example_id FROM w WHERE contains(t, 'score guard') OR contains(t, 'score') OR contains(t, 'guard')
    OR len(list_intersect(list_distinct(string_split(trim(regexp_replace(regexp_replace(t, '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g'), ' '), ' ')), ['threshold', 'records', 'manifest', 'before'])) >= 2""")
def example_relevant(rows):
    return D.relevant(rows.withColumn("task_input", F.coalesce("task_input", F.lit(""))), "task_input", "score-guard", "Threshold records; the manifest, before all!").select("example_id")


@query(_EX, "SELECT min(example_id) AS example_id FROM eval_example GROUP BY task_input")
def example_first_by_task(rows):
    return D.first_ids(rows, F.col("task_input")).select("example_id")


@query(_EX, "SELECT example_id, tool FROM (SELECT example_id, tool_sequence[1] AS tool, substr(task_input, 1, 100) AS head FROM eval_example WHERE len(tool_sequence) > 0) QUALIFY row_number() OVER (PARTITION BY head, tool ORDER BY example_id) = 1")
def example_first_by_task_and_tool(rows):
    r = rows.filter("size(tool_sequence) > 0").select("example_id", F.get("tool_sequence", F.lit(0)).alias("tool"), F.substring("task_input", 1, 100).alias("head"))
    return D.first_of(r, [F.col("head"), F.col("tool")], [F.col("example_id")]).select("example_id", "tool")


_MERGE = """WITH o AS (SELECT task_input FROM eval_example WHERE lower(trim(source, ' ')) = 'golden' AND task_input IS NOT NULL),
    f AS (SELECT task_input, lower(trim(split, ' ')) AS split, example_id FROM eval_example WHERE lower(trim(source, ' ')) <> 'golden' AND task_input IS NOT NULL AND task_input NOT IN (SELECT task_input FROM o)),
    r AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'holdout' THEN 2 ELSE 3 END AS rank FROM f), k AS (SELECT * FROM r WHERE rank < 3 QUALIFY row_number() OVER (PARTITION BY task_input ORDER BY rank, example_id) = 1)"""


@query(_EX, _MERGE + " SELECT split, count(*) AS added FROM k GROUP BY 1")
def example_merge(rows):
    golden = D.lean("source") == "golden"
    return D.merged(rows.filter(golden), rows.filter(~golden))


_ORDERED = """SELECT example_id, CASE WHEN p <= a THEN 'train' WHEN p <= a + greatest(1, CAST(floor(n * 0.25) AS BIGINT)) THEN 'val' ELSE 'holdout' END AS split FROM
    (SELECT example_id, row_number() OVER (ORDER BY md5(coalesce(task_input, '')), example_id) AS p, count(*) OVER () AS n, greatest(1, CAST(floor(count(*) OVER () * 0.5) AS BIGINT)) AS a FROM eval_example)"""


@query(_EX, _ORDERED)
def example_ratio_split(rows):
    return D.ratio_split(rows, F.coalesce("task_input", F.lit("")))


@query(_EX, "SELECT example_id, CASE CAST(md5_number(coalesce(task_input, '')) % 3 AS INTEGER) WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'holdout' END AS split FROM eval_example")
def example_hash_split(rows):
    return D.hash_split(rows, F.coalesce("task_input", F.lit("")))


@query(_EX, "SELECT example_id FROM eval_example WHERE ('0x' || substr(md5(CAST(example_id AS VARCHAR)), 1, 8))::BIGINT % 10000 < 500")
def example_hash_sample(rows):
    return D.sampled(rows, "example_id", 500).select("example_id")


@query(_EX, "SELECT example_id FROM eval_example WHERE coalesce(lower(trim(source, ' ')), '') <> 'golden' ORDER BY md5(CAST(example_id AS VARCHAR)), example_id LIMIT 50")
def example_fill_up(rows):
    golden = F.coalesce(D.lean("source"), F.lit("")) == "golden"
    return D.fill_up(rows.filter(golden), rows, 50).select("example_id")


@query(_EX, """WITH e AS (SELECT coalesce(lower(trim(split, ' ')), '') AS "group", lower(coalesce(task_input, '')) AS t, lower(coalesce(expected_behavior, '')) AS x, length(coalesce(task_input, '')) AS z FROM eval_example)
    SELECT "group", count(*) AS n, round(avg(z), 4) AS mean_length, CAST(list_sort(list(z))[count(*) // 2 + 1] AS INTEGER) AS upper_median, round(avg((contains(t, 'todo') OR contains(x, 'todo') OR contains(t, 'stale') OR contains(x, 'stale'))::INT), 6) AS stub_share,
    count(*) - count(DISTINCT substr(t, 1, 60)) AS repeated FROM e GROUP BY 1""")
def example_audit(rows):
    return D.audit(rows, F.coalesce(D.lean("split"), F.lit("")), ("todo", "stale"))


@query(_EX, """SELECT coalesce(nullif(lower(trim(category, ' ')), ''), 'general') AS category, greatest(0, 100 - count(*) FILTER (lower(trim(split, ' ')) = 'train')) AS missing_train, greatest(0, 30 - count(*) FILTER (lower(trim(split, ' ')) = 'val')) AS missing_val,
    greatest(0, 30 - count(*) FILTER (lower(trim(split, ' ')) = 'holdout')) AS missing_holdout FROM eval_example GROUP BY 1""")
def example_gaps(rows):
    return D.gaps(rows, {"train": 100, "val": 30, "holdout": 30})


@query(_EX, """SELECT coalesce(lower(trim(split, ' ')), '') AS split, coalesce(lower(trim(source, ' ')), '') AS source, count(*) AS n, round(avg(length(coalesce(task_input, '')) + length(coalesce(expected_behavior, ''))), 4) AS avg_chars,
    count(*) FILTER (len(tool_sequence) > 0) AS with_tools FROM eval_example GROUP BY 1, 2""")
def example_split_stats(rows):
    return D.split_stats(rows)


def _hits(words: tuple[str, ...], t: str = "t") -> str:
    return " + ".join(f"contains({t}, '{w}')::INT" for w in words)


_KINDS = ", ".join(f"{{'hits': {_hits(w)}, 'rank': {-i}, 'kind': '{k}'}}" for i, (k, w) in enumerate(D.TASK_KINDS.items()))


@query(_EX, f"SELECT example_id, CASE WHEN b.hits = 0 THEN 'general' ELSE b.kind END AS kind FROM (SELECT example_id, list_max([{_KINDS}]) AS b FROM (SELECT example_id, lower(coalesce(task_input, '')) AS t FROM eval_example))")
def example_task_kinds(rows):
    return D.task_kinds(rows)


_TOPICS = {"scores": ("score", "judge", "baseline", "threshold"), "files": ("datasets/", "output/", "tools/", ".json"), "workflow": ("plan", "card", "queue", "merge")}
_TOPIC_SQL = ", ".join(f"{{'topic': '{k}', 'score': least(1.0, ({_hits(w)}) / 3.0)}}" for k, w in _TOPICS.items())


@query(_EX, f"SELECT example_id, x.topic AS topic, round(x.score::DOUBLE, 6) AS score FROM (SELECT example_id, unnest([{_TOPIC_SQL}]) AS x FROM (SELECT example_id, lower(coalesce(task_input, '') || ' ' || coalesce(expected_behavior, '')) AS t FROM eval_example)) WHERE x.score > 0")
def example_topics(rows):
    return D.topic_scores(rows, _TOPICS)


@query(_EX, "SELECT example_id, CASE WHEN length(coalesce(task_input, '')) // 200 > 10 THEN 'hard' WHEN length(coalesce(task_input, '')) // 200 > 4 THEN 'medium' ELSE 'easy' END AS difficulty FROM eval_example")
def example_size_difficulty(rows):
    return D.size_difficulty(rows)


@query(_EX, "SELECT example_id FROM eval_example WHERE NOT coalesce(contains(lower(substr(task_input, 1, 100)), 'scheduled cron job') OR (starts_with(lower(task_input), '[important') AND contains(lower(task_input), 'completed')), false)")
def example_foreground(rows):
    return rows.filter(~F.coalesce(D.background_noise(F.col("task_input")), F.lit(False))).select("example_id")


@query(_EX, r"""SELECT example_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(coalesce(task_input, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', '') AS slug FROM eval_example""")
def example_slugs(rows):
    return rows.select("example_id", D.slug(F.coalesce("task_input", F.lit(""))).alias("slug"))


@query(_EX, """SELECT example_id, CASE WHEN len(w) = 0 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE + 0.7::DOUBLE * len(list_intersect(w, g)) / len(w) END AS score FROM (SELECT example_id,
    list_filter(list_distinct(string_split(trim(regexp_replace(lower(coalesce(expected_behavior, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), ' ')), lambda x: x <> '') AS w,
    list_filter(list_distinct(string_split(trim(regexp_replace(lower(coalesce(task_input, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), ' ')), lambda x: x <> '') AS g FROM eval_example)""")
def example_keyword_overlap(rows):
    return rows.select("example_id", S.keyword_overlap(F.col("expected_behavior"), F.col("task_input")).alias("score"))


@query(_EX, """SELECT example_id, CASE WHEN blank THEN 'empty' WHEN m > 3 AND p / greatest(len(w), 1) < 0.3 THEN 'off_topic' WHEN m > p THEN 'partial' WHEN m > 0 THEN 'details_missing' ELSE 'match' END AS verdict FROM (
    SELECT *, len(list_intersect(w, g)) AS p, len(w) - len(list_intersect(w, g)) AS m FROM (SELECT example_id, trim(coalesce(task_input, ''), ' ') = '' AS blank,
    list_filter(list_distinct(string_split(trim(regexp_replace(lower(coalesce(expected_behavior, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), ' ')), lambda x: x <> '') AS w,
    list_filter(list_distinct(string_split(trim(regexp_replace(lower(coalesce(task_input, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), ' ')), lambda x: x <> '') AS g FROM eval_example))""")
def example_overlap_feedback(rows):
    return rows.select("example_id", S.overlap_feedback(F.col("expected_behavior"), F.col("task_input")).alias("verdict"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _tf(column: str) -> str:
    return f"""(SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM
      (SELECT example_id AS id, list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]{{2,}}'), lambda x: NOT list_contains({_STOP}, x)) AS w FROM eval_example)) GROUP BY 1, 2)"""


_TFIDF = f"""WITH fit AS {_tf('expected_behavior')}, other AS {_tf('task_input')}, v AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT term, sum(tf) AS freq, count(*) AS df FROM fit GROUP BY 1 ORDER BY freq DESC, term LIMIT 5000), (SELECT count(*) AS n FROM eval_example)),
    aw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM other JOIN v USING (term)), bw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM fit JOIN v USING (term)),
    a AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM aw), b AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM bw)"""


@query(_EX, f"{_TFIDF} SELECT id AS example_id, round(sum(a.w * b.w), 5) AS score FROM a JOIN b USING (id, term) GROUP BY 1")
def example_tfidf_score(rows):
    return S.tfidf_pairs(rows, "example_id", "task_input", "expected_behavior").withColumnRenamed("id", "example_id")


@query(_EX, f"{_TFIDF}, n AS (SELECT count(DISTINCT id) AS n FROM b), q AS (SELECT sum(s * s) AS q FROM (SELECT term, sum(w) AS s FROM b GROUP BY 1)) SELECT n, round(1 - (q - n) / (n * (n - 1)), 5) AS diversity FROM n, q")
def example_diversity(rows):
    fit = materialise(S.term_counts(rows, "example_id", F.col("expected_behavior")), "terms")
    return S.diversity(S.weights(fit, S.vocabulary(fit, rows)))


_SETS = """w AS (SELECT example_id AS id, list_filter(list_distinct(string_split(trim(regexp_replace(lower(coalesce(task_input, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), ' ')), lambda x: x <> '') AS s FROM eval_example)"""


@query(_EX, f"""WITH {_SETS}, e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM w), c AS (SELECT q.id AS query_id, r.id, count(*) AS c, max(q.n) AS nq, max(r.n) AS nr FROM e q JOIN e r ON q.x = r.x WHERE q.id % 50 = 0 AND q.id <> r.id GROUP BY 1, 2),
    j AS (SELECT query_id, id, c / (nq + nr - c) AS j FROM c) SELECT query_id, id, round(j, 6) AS jaccard, CAST(row_number() OVER (PARTITION BY query_id ORDER BY j DESC, id) AS INTEGER) AS rank FROM j WHERE j > 0.25 QUALIFY rank <= 5""")
def example_similar_tasks(rows):
    return S.similar_sets(rows.filter("example_id % 50 = 0"), rows, "example_id", "task_input")


@query("embeddings", """WITH e AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2)
    SELECT vec_id, label, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) AS score FROM e JOIN c USING (label, i) GROUP BY 1, 2""")
def embedding_to_centroid(vectors):
    return S.to_own_centroid(vectors)


# ---- documents

_DOC = "documents"
_PAIR = """WITH n AS (SELECT doc_id, skill_name AS name, text, written_at FROM documents WHERE skill_name IS NOT NULL AND text IS NOT NULL),
    p AS (SELECT * FROM (SELECT doc_id, name, lag(text) OVER w AS baseline, text AS evolved, lag(doc_id) OVER w AS before FROM n WINDOW w AS (PARTITION BY name ORDER BY written_at NULLS FIRST, doc_id)) WHERE before IS NOT NULL)"""


@query(_DOC, r"""SELECT doc_id, CASE WHEN starts_with(ltrim(text, ' '), '---') AND len(string_split(text, '---')) >= 3 THEN trim(string_split(text, '---')[2], ' ') ELSE '' END AS front,
    coalesce(regexp_replace(regexp_extract_all(CASE WHEN starts_with(ltrim(text, ' '), '---') AND len(string_split(text, '---')) >= 3 THEN trim(string_split(text, '---')[2], ' ') ELSE '' END, '(?m)^name:[ \t]*(.*?)[ \t\r]*$', 1)[-1], '^["'']|["'']$', '', 'g'), '') AS name
    FROM documents WHERE text IS NOT NULL""")
def doc_front_matter(docs):
    return docs.filter("text is not null").select("doc_id", T.front_matter(F.col("text")).alias("front"), T.front_matter_field(F.col("text"), "name").alias("name"))


@query(_DOC, r"""SELECT doc_id, CAST(k AS INTEGER) AS k, title FROM (SELECT doc_id, unnest(range(0, len(h))) AS k, trim(unnest(h), ' ') AS title FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^#{1,6}[ \t]+([^\r\n]+)', 1) AS h FROM documents))""")
def doc_headings(docs):
    return docs.select("doc_id", F.posexplode(T.headings(F.col("text"))).alias("k", "title"))


@query(_DOC, f"SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(text, '[a-zA-Z]{{4,}}'), lambda x: lower(x))) AS term FROM documents) WHERE NOT list_contains({_STOP}, term) GROUP BY 1")
def doc_term_counts(docs):
    return docs.select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(_DOC, r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^\s*\d+[.)]\s')) AS INTEGER) AS numbered, CAST(len(regexp_extract_all(text, '(?m)^\s*[-*]\s')) AS INTEGER) AS bullets, CAST(len(regexp_extract_all(text, '```')) AS INTEGER) AS fences,
    CAST(len(regexp_extract_all(text, 'https?://')) AS INTEGER) AS links, CAST(len(regexp_extract_all(text, '(?m)^#{1,6}\s')) AS INTEGER) AS headings FROM documents WHERE text IS NOT NULL""")
def doc_structure(docs):
    return docs.filter("text is not null").select("doc_id", *T.structure_counts(F.col("text")))


@query(_DOC, "SELECT doc_id, CASE WHEN length(text) > 380 THEN rtrim(substr(text, 1, 377), ' ') || '...' ELSE text END AS short FROM documents WHERE text IS NOT NULL")
def doc_cut_short(docs):
    return docs.filter("text is not null").select("doc_id", T.cut_short(F.col("text")).alias("short"))


@query(_DOC, "SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10) || chr(10)), lambda p, i: (i - 1) % 3 <> 2), chr(10) || chr(10))) AS thinned, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda p: NOT starts_with(p, '#')), chr(10))) AS plain FROM documents WHERE text IS NOT NULL")
def doc_degraded(docs):
    t = F.col("text")
    return docs.filter("text is not null").select("doc_id", F.md5(T.without_every_third_paragraph(t)).alias("thinned"), F.md5(T.without_headings(t)).alias("plain"))


@query(_DOC, "SELECT doc_id, CAST(floor(len(list_filter(string_split(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), ' '), lambda x: x <> '')) * 0.75 + length(text) * 0.25) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def doc_token_estimate(docs):
    return docs.filter("text is not null").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(_DOC, "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)sk-\\S{20,}|\\bpassword\\s*[=:]\\s*\\S+|\\bsecret\\s*[=:]\\s*\\S+|\\btoken\\s*[=:]\\s*\\S{10,}|GITHUB_TOKEN|DATABASE_URL|AKIA[0-9A-Z]{16}|Bearer\\s+\\S{20,}|ghp_\\S+|ghu_\\S+|xoxb-\\S+|xapp-\\S+|ntn_\\S+')")
def doc_secrets(docs):
    return docs.filter(D.contains_secret(F.col("text"))).select("doc_id")


@query(_DOC, f"""{_PAIR}, g AS (SELECT doc_id, (length(evolved) - length(baseline)) / greatest(1, length(baseline)) AS g, length(baseline) AS n, evolved FROM p)
    SELECT doc_id, round(g, 6) AS growth, g BETWEEN CASE WHEN n < 5000 THEN -0.5 WHEN n < 20000 THEN -0.3 ELSE -0.2 END AND CASE WHEN n < 5000 THEN 1.0 WHEN n < 20000 THEN 0.5 ELSE 0.2 END AS growth_ok, length(evolved) <= 15000 AS size_ok, trim(evolved, ' ') <> '' AS non_empty FROM g""")
def version_size_checks(docs):
    return G.size_checks(G.version_pairs(docs))


@query(_DOC, r"""WITH b AS (SELECT doc_id, text, starts_with(ltrim(text, ' '), '---') AS f, CASE WHEN starts_with(ltrim(text, ' '), '---') AND len(string_split(text, '---')) >= 3 THEN trim(array_to_string(string_split(text, '---')[3:], '---'), ' ') ELSE text END AS body FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, f AND contains(substr(text, 1, 500), 'name:') AND contains(substr(text, 1, 500), 'description:') AS front_matter, CAST(regexp_matches(body, '(?m)^#+\s')::INT + (contains(lower(body), 'step') OR contains(lower(body), '1.') OR contains(lower(body), 'procedure') OR contains(lower(body), 'how to') OR contains(lower(body), 'instructions'))::INT
      + (length(trim(body, ' ')) > 100)::INT AS INTEGER) AS body_checks FROM b) SELECT *, front_matter AND body_checks >= 2 AS ok FROM c""")
def doc_structure_checks(docs):
    return G.structure_checks(docs)


@query(_DOC, rf"""{_PAIR}, h AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(baseline, '(?m)^#{{1,6}}[ \t]+([^\r\n]+)', 1), lambda x: trim(x, ' '))) AS o, list_distinct(list_transform(regexp_extract_all(evolved, '(?m)^#{{1,6}}[ \t]+([^\r\n]+)', 1), lambda x: trim(x, ' '))) AS e FROM p),
    a AS (SELECT doc_id, unnest(o) AS section FROM h), b AS (SELECT doc_id, unnest(e) AS section FROM h)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.section, b.section) AS section, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'common' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.section = b.section""")
def version_section_changes(docs):
    return G.section_changes(G.version_pairs(docs))


def _terms(column: str) -> str:
    return f"(SELECT doc_id, term, count(*) AS k FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all({column}, '[a-zA-Z]{{4,}}'), lambda x: lower(x))) AS term FROM p) WHERE NOT list_contains({_STOP}, term) GROUP BY 1, 2)"


@query(_DOC, rf"""{_PAIR}, o AS {_terms('baseline')}, e AS {_terms('evolved')}, f AS (SELECT doc_id, sum(k) AS fresh FROM e WHERE k >= 3 AND NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = e.doc_id AND o.term = e.term) GROUP BY 1), m AS (SELECT doc_id, sum(k) AS meaningful FROM o GROUP BY 1),
    d AS (SELECT p.doc_id, coalesce(fresh, 0) / greatest(1, len(list_filter(string_split(trim(regexp_replace(baseline, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), ' '), lambda x: x <> ''))) AS r, coalesce(meaningful, 0) AS m FROM p LEFT JOIN f USING (doc_id) LEFT JOIN m USING (doc_id))
    SELECT doc_id, round(r, 6) AS ratio, CASE WHEN m < 3 OR r < 0.10 THEN 'match' WHEN r < 0.30 THEN 'minor_drift' ELSE 'major_drift' END AS status FROM d""")
def version_scope_creep(docs):
    return G.scope_creep(G.version_pairs(docs))


_GROUPS = {"scores": ("score", "judge", "baseline", "threshold"), "files": ("dataset", "output", "tools", "json"), "flow": ("plan", "card", "queue", "merge")}


def _found(column: str) -> str:
    parts = [f"CASE WHEN len(list_filter({list(w)}, lambda x: contains(lower({column}), x))) >= 2 THEN list_filter({list(w)}, lambda x: contains(lower({column}), x)) ELSE []::VARCHAR[] END" for w in _GROUPS.values()]
    return f"list_distinct(list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]}))"


@query(_DOC, f"""{_PAIR}, k AS (SELECT doc_id, {_found('baseline')} AS o, {_found('evolved')} AS e FROM p), r AS (SELECT doc_id, len(o) AS n, CASE WHEN len(o) = 0 THEN 1.0 ELSE len(list_intersect(o, e)) / len(o) END AS r FROM k)
    SELECT doc_id, CAST(n AS INTEGER) AS keywords, round(r::DOUBLE, 6) AS survival, r >= 0.4 AS preserved FROM r""")
def version_keyword_survival(docs):
    return G.keyword_survival(G.version_pairs(docs), _GROUPS)


@query(_DOC, rf"""{_PAIR} SELECT doc_id, CAST(greatest(0, len(regexp_extract_all(lower(evolved), '\b(if|else|elif|when|case|switch)\b')) - len(regexp_extract_all(lower(baseline), '\b(if|else|elif|when|case|switch)\b'))) AS INTEGER) AS added FROM p""")
def version_new_conditionals(docs):
    return G.new_conditionals(G.version_pairs(docs))


@query("run_report", f"""{_RUNS}, g AS (SELECT skill || '/' || run_id AS id, baseline_score AS b, evolved_score AS e, coalesce(iterations, 0) / 10.0 AS growth FROM c WHERE baseline_score IS NOT NULL AND evolved_score IS NOT NULL), p AS (SELECT *, least(1.0, greatest(0.0, growth - 0.2)) AS penalty FROM g)
    SELECT id, CASE WHEN e - b >= 0.03 AND e * 0.85 + (1 - penalty) * 0.15 > b * 0.85 + 0.15 THEN 'evolved' ELSE 'baseline' END AS choice, round(penalty::DOUBLE, 6) AS penalty FROM p""")
def run_pareto_choice(runs):
    d = R.distinct_runs(runs).filter("skill is not null and baseline_score is not null and evolved_score is not null")
    return G.pareto_choice(d.select(F.concat_ws("/", "skill", "run_id").alias("id"), "baseline_score", "evolved_score", (F.coalesce("iterations", F.lit(0)) / 10.0).alias("growth")))


@query("run_report", f"""{_RUNS}, g AS (SELECT skill || '/' || run_id AS id, baseline_score AS b, evolved_score AS e, coalesce(iterations, 0) / 10.0 AS growth, coalesce(constraints_passed, false) AS ok FROM c WHERE baseline_score IS NOT NULL AND evolved_score IS NOT NULL), p AS (SELECT *, least(1.0, greatest(0.0, growth - 0.2)) AS penalty FROM g)
    SELECT id, CASE WHEN ok AND e - b >= 0.03 AND e * 0.85 + (1 - penalty) * 0.15 > b * 0.85 + 0.15 THEN 'evolved' ELSE 'baseline' END AS choice, round(penalty::DOUBLE, 6) AS penalty FROM p""")
def run_robust_choice(runs):
    d = R.distinct_runs(runs).filter("skill is not null and baseline_score is not null and evolved_score is not null")
    return G.pareto_choice(d.select(F.concat_ws("/", "skill", "run_id").alias("id"), "baseline_score", "evolved_score", (F.coalesce("iterations", F.lit(0)) / 10.0).alias("growth"), F.col("constraints_passed").alias("robust")))


@query("judge_audit_log", """WITH k AS (SELECT skill_name, coalesce(nullif(error_flag, ''), 'uncategorized') AS reason, count(*) FILTER (NOT coalesce(error_flag IS NULL AND raw_score >= 0.35, false)) AS k FROM judge_audit_log GROUP BY 1, 2),
    g AS (SELECT skill_name, sum(k)::BIGINT AS failures, max(k) AS top, coalesce(sum(k) FILTER (reason IN ('timeout', 'parse_error')), 0) AS hard FROM k GROUP BY 1),
    p AS (SELECT *, CASE WHEN failures > 0 AND hard / failures >= 0.8 THEN 'edge_case' WHEN failures >= 3 AND top / failures >= 0.6 THEN 'coverage' ELSE 'noise' END AS pattern FROM g)
    SELECT skill_name, failures, pattern, round(least(1.0, CASE WHEN failures = 0 THEN 1.0 WHEN pattern = 'edge_case' THEN 0.5 + hard / failures * 0.5 WHEN pattern = 'coverage' THEN 0.4 + top / failures * 0.4 ELSE 0.5 END)::DOUBLE, 6) AS confidence FROM p""")
def score_failure_patterns(log):
    return G.failure_patterns(log, "skill_name", F.col("error_flag").isNull() & (F.col("raw_score") >= 0.35), F.col("error_flag"), ("timeout", "parse_error"))


_ROLE, _DOCS = "['Plan', 'Rules', 'Report', 'Role', 'Context', 'Task']", "['Overview', 'Steps', 'Examples', 'Usage', 'Notes', 'Pitfalls']"


@query(_DOC, rf"""{_PAIR}, k AS (SELECT doc_id, {_found('baseline')} AS o, {_found('evolved')} AS e, list_distinct(list_transform(regexp_extract_all(baseline, '(?m)^##[ \t]+([^\r\n]+)', 1), lambda x: trim(x, ' '))) AS h0, list_distinct(list_transform(regexp_extract_all(evolved, '(?m)^##[ \t]+([^\r\n]+)', 1), lambda x: trim(x, ' '))) AS h1 FROM p),
    r AS (SELECT doc_id, len(o) = 0 OR len(list_intersect(o, e)) / len(o) >= 0.4 AS kept, list_intersect(h0, {_ROLE}) AS r0, list_intersect(h1, {_ROLE}) AS r1, len(list_intersect(h0, {_DOCS})) AS d0, len(list_intersect(h1, {_DOCS})) AS d1 FROM k)
    SELECT doc_id, CASE WHEN NOT kept THEN 'keywords_lost' WHEN len(list_filter(r0, lambda x: NOT list_contains(r1, x))) > 0 THEN 'role_lost' WHEN len(r0) = 0 AND len(r1) > 0 THEN 'role_adopted' WHEN len(r0) = 0 AND d0 > 0 AND (d1 < 0.5 * d0 OR d1 = 0) THEN 'structure_lost' ELSE 'kept' END AS verdict FROM r""")
def version_purpose(docs):
    return G.purpose_kept(G.version_pairs(docs), _GROUPS, ("Plan", "Rules", "Report", "Role", "Context", "Task"), ("Overview", "Steps", "Examples", "Usage", "Notes", "Pitfalls"))


@query("judge_audit_log", """WITH c AS (SELECT skill_name, coalesce(nullif(error_flag, ''), 'uncategorized') AS category, count(*) AS k FROM judge_audit_log WHERE error_flag IS NOT NULL OR raw_score < 0.35 GROUP BY 1, 2)
    SELECT skill_name, category, round(k / sum(k) OVER (PARTITION BY skill_name), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY skill_name ORDER BY k DESC, category) = 1""")
def score_dominant_failures(log):
    return G.dominant_category(log.filter("error_flag is not null or raw_score < 0.35"), "skill_name", F.col("error_flag"))


_TEMPLATES = [("tool_underuse", "Call the tool instead of describing it"), ("skill_drift", "Refresh the skill"), ("long_briefing", "Answer with one action")]


@query("session_message", SQL["trace_failures"].replace("SELECT session_id, failure_class, hits FROM (UNPIVOT", "SELECT session_id, failure_class, title, substr(sha256(session_id || ':' || failure_class), 1, 16) AS dedupe_key FROM (UNPIVOT").replace(
    " WHERE hits > 0", " JOIN (VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in _TEMPLATES) + ") d(k, title) ON d.k = failure_class WHERE hits > 0"))
def trace_action_items(rows):
    return X.action_items(trace_failures(rows), rows.sparkSession.createDataFrame(_TEMPLATES, "failure_class string, title string"))


@query(_DOC)
def version_text_diff(docs):
    d = G.version_pairs(docs).withColumn("d", P.text_diff("baseline", "evolved"))
    return d.select("doc_id", "d.added", "d.removed")


@query(_EX, """SELECT example_id, least(1.0::DOUBLE, length(task_input) / 400.0::DOUBLE) AS correctness, round(greatest(0.0, 0.5 * least(1.0::DOUBLE, length(task_input) / 400.0::DOUBLE) + 0.3 + 0.2 - CASE WHEN length(task_input) / 300.0 > 0.9 THEN least(0.3, (length(task_input) / 300.0 - 0.9) * 3.0) ELSE 0.0 END), 6) AS score
    FROM (SELECT example_id, coalesce(task_input, '') AS task_input FROM eval_example)""")
def example_injected_scores(rows):
    """A stand-in for a model call: the score of a text is its length."""

    def judge(frame):
        return (frame["task_input"].str.len() / 400.0).clip(upper=1.0).to_frame("correctness")

    scored = E.call(rows.select("example_id", F.coalesce("task_input", F.lit("")).alias("task_input")), judge, ["task_input"], "correctness double")
    score = E.fitness(F.col("correctness"), F.lit(1.0), F.lit(1.0), F.length("task_input"), 300)
    return scored.select("example_id", "correctness", F.round(score, 6).alias("score"))


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = W.parquet_stream(spark, sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = W.windowed(events, "ts", "1 hour", "1 day", ["event_type"], {"n": F.count(F.lit(1)), "total": F.sum("value")})
    return W.run_to_table(counted).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES["stream_event_windows"] = stream_event_windows
SQL["stream_event_windows"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


# ---- checks, sections, rankings


@query(_EX, r"""SELECT example_id, array_to_string(list_filter([CASE WHEN length(b) < 300 THEN 'body_length' END, CASE WHEN NOT (starts_with(ltrim(b, ' '), '---') OR regexp_matches(b, '(?m)^#{1,3}\s')) THEN 'structure' END, CASE WHEN length(t) < 200 THEN 'task' END], lambda x: x IS NOT NULL), ',') AS failed
    FROM (SELECT example_id, coalesce(expected_behavior, '') AS b, coalesce(task_input, '') AS t FROM eval_example)""")
def example_candidate_checks(rows):
    return C.candidate_checks(rows, "expected_behavior", "task_input", least_body=300, least_task=200).select("example_id", F.array_join("failed", ",").alias("failed"))


@query(_EX, """SELECT example_id, array_to_string(list_filter([CASE WHEN trim(coalesce(task_input, ''), ' ') = '' THEN 'missing task_input' END, CASE WHEN trim(coalesce(repo, ''), ' ') = '' THEN 'missing repo' END,
    CASE WHEN NOT (difficulty IS NULL OR difficulty IN ('easy', 'medium', 'hard')) THEN 'difficulty not allowed' END, CASE WHEN length(coalesce(expected_behavior, '')) > 500 THEN 'expected_behavior too long' END], lambda x: x IS NOT NULL), ',') AS failed FROM eval_example""")
def example_contract_failures(rows):
    found = C.contract_failures(rows, ["task_input", "repo"], {"difficulty": ("easy", "medium", "hard")}, {"expected_behavior": 500})
    return found.select("example_id", F.array_join("failed", ",").alias("failed"))


@query("session_message", """WITH s AS (SELECT session_id, min(message_id) AS first_id FROM session_message GROUP BY 1), n AS (SELECT session_id, count(*) AS messages FROM session_message WHERE lower(trim(role, ' ')) = 'tool' GROUP BY 1)
    SELECT s.session_id, coalesce(messages, 0) AS messages FROM s LEFT JOIN n ON n.session_id = s.session_id WHERE first_id >= 100 AND coalesce(messages, 0) >= 2""")
def trace_recent_sessions(rows):
    sessions = rows.groupBy("session_id").agg(F.min("message_id").alias("started_at"))
    return C.recent_sessions(sessions, rows.filter(F.lower(F.trim("role")) == "tool"), F.lit(100), 2).select("session_id", "messages")


@query(_EX, "SELECT count(*) AS n, round(coalesce(avg((coalesce(lower(trim(tool_sequence[2], ' ')) = lower(trim(tool_sequence[1], ' ')), false))::INT), 0.0), 6) AS accuracy FROM eval_example WHERE len(tool_sequence) > 0")
def example_selection_accuracy(rows):
    tools = rows.filter("size(tool_sequence) > 0").select(F.get("tool_sequence", F.lit(1)).alias("predicted"), F.get("tool_sequence", F.lit(0)).alias("wanted"))
    return C.selection_accuracy(tools, "predicted", "wanted")


@query("run_report", """SELECT optimizer_type AS approach, count(*) AS runs, round(avg((coalesce(constraints_passed, false))::INT), 4) AS success_rate, round(coalesce(avg(evolved_score), 0.0), 4) AS mean_diversity, round(coalesce(stddev_pop(evolved_score), 0.0), 4) AS std_diversity,
    round(coalesce(sum(iterations)::DOUBLE / nullif(count(*) FILTER (coalesce(constraints_passed, false)), 0), 0.0), 2) AS cases_per_success FROM run_report GROUP BY 1""")
def run_benchmark_summary(runs):
    return C.benchmark_summary(runs, F.col("optimizer_type"), F.col("constraints_passed"), F.col("evolved_score"), F.col("iterations"))


@query("judge_audit_log", """SELECT skill_name, task_id, CAST(rank AS INTEGER) AS rank FROM (SELECT skill_name, task_id, row_number() OVER (PARTITION BY skill_name ORDER BY m, task_id) AS rank, count(*) OVER (PARTITION BY skill_name) AS n FROM
    (SELECT skill_name, task_id, round(avg(raw_score), 6) AS m FROM judge_audit_log WHERE error_flag IS NULL AND skill_name IS NOT NULL AND task_id IS NOT NULL GROUP BY 1, 2)) WHERE rank <= greatest(1, CAST(floor(n * (1.0::DOUBLE / 3.0::DOUBLE)) AS BIGINT))""")
def score_weakest_tasks(log):
    means = log.filter("error_flag is null and skill_name is not null and task_id is not null").groupBy("skill_name", "task_id").agg(F.round(F.avg("raw_score"), 6).alias("m"))
    return C.weakest(means, "skill_name", "m", "task_id").select("skill_name", "task_id", "rank")


@query("run_report", """SELECT run_id, skill, ts FROM run_report ORDER BY coalesce(CASE eval_source WHEN 'golden' THEN 0 WHEN 'sessiondb' THEN 1 END, 2), coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), '9999-99-99'), run_id || '/' || skill, elapsed_seconds LIMIT 25""")
def run_by_priority(runs):
    r = runs.withColumn("due", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).withColumn("tie", F.concat(F.col("run_id"), F.lit("/"), F.col("skill")))
    return C.by_priority(r, {"golden": 0, "sessiondb": 1}, "eval_source", "due", "tie").select("run_id", "skill", "ts").limit(25)


@query(_EX, """SELECT example_id, CASE WHEN p <= a THEN 'train' WHEN p <= a + greatest(1, CAST(floor((n - a) / 2) AS BIGINT)) THEN 'val' ELSE 'holdout' END AS split FROM
    (SELECT example_id, row_number() OVER (ORDER BY example_id) AS p, count(*) OVER () AS n, greatest(1, CAST(floor(count(*) OVER () / 2) AS BIGINT)) AS a FROM eval_example)""")
def example_ordered_halves(rows):
    return C.ordered_halves(rows, "example_id")


@query(_DOC, rf"""{_PAIR}, o AS (SELECT name, min(baseline) AS before, max(evolved) AS after FROM p WHERE name IS NOT NULL GROUP BY 1) SELECT name, md5(before) AS before, md5(after) AS after FROM o WHERE before IS DISTINCT FROM after""")
def version_description_changes(docs):
    pairs = G.version_pairs(docs)
    old, new = pairs.groupBy("name").agg(F.min("baseline").alias("description")), pairs.groupBy("name").agg(F.max("evolved").alias("description"))
    return C.description_changes(old, new).select("name", F.md5("before").alias("before"), F.md5("after").alias("after"))


@query(_DOC)
def doc_sections(docs):
    return C.sections(docs.filter("text is not null"), "doc_id", "text").select(F.col("id").alias("doc_id"), "section_no", "section")


@query(_DOC)
def doc_rubrics(docs):
    return docs.filter("text is not null").select("doc_id", C.rubric(F.col("text")).alias("rubric"))


@query(_DOC)
def version_section_similarity(docs):
    return C.section_similarity(G.version_pairs(docs))


@query("judge_audit_log", """SELECT skill_name, count(*) FILTER (coalesce(raw_score >= 0.35, false)) AS passed, count(*) FILTER (NOT coalesce(raw_score >= 0.35, false)) AS failed,
    coalesce(bool_and(coalesce(raw_score >= 0.35, false) OR error_flag IS NULL), true) AS eligible FROM judge_audit_log GROUP BY 1""")
def score_verdict_rollup(log):
    return C.verdict_rollup(log, "skill_name", F.col("raw_score") >= 0.35, F.col("error_flag").isNotNull())


_STUB = "(contains(t, 'todo') OR contains(x, 'todo') OR contains(t, 'stale') OR contains(x, 'stale'))"


@query(_EX, f"""WITH e AS (SELECT coalesce(lower(trim(source, ' ')), '') AS "group", lower(coalesce(task_input, '')) AS t, lower(coalesce(expected_behavior, '')) AS x, lower(trim(split, ' ')) AS s, lower(trim(difficulty, ' ')) AS d, coalesce(lower(trim(category, ' ')), '') AS c FROM eval_example),
    g AS (SELECT "group", count(*) AS n, count(*) FILTER (s = 'train') AS train, count(*) FILTER (d = 'hard') AS hard, count(DISTINCT c) AS categories, count(*) FILTER ({_STUB}) AS stubs, count(*) - count(DISTINCT substr(t, 1, 60)) AS repeated FROM e GROUP BY 1)
    SELECT *, round((greatest(0, 10 - train) * 2 + (stubs + repeated) * 150.0::DOUBLE / n + greatest(0, 5 - categories) * 3 + CASE WHEN hard = 0 THEN 3 ELSE 0 END)::DOUBLE, 4) AS priority FROM g""")
def example_audit_priority(rows):
    return D.audit_priority(rows, F.coalesce(D.lean("source"), F.lit("")), ("todo", "stale"))


@query(_EX, """SELECT coalesce(lower(trim(split, ' ')), '') AS "group", coalesce(lower(trim(difficulty, ' ')), '') AS value, count(*) AS n FROM eval_example GROUP BY 1, 2""")
def example_difficulties(rows):
    return D.histogram(rows, F.coalesce(D.lean("split"), F.lit("")), "difficulty")


@query(_EX, """WITH g AS (SELECT coalesce(lower(trim(source, ' ')), '') AS "group", count(*) FILTER (lower(trim(split, ' ')) = 'train') AS train_cases, count(*) FILTER (lower(trim(split, ' ')) = 'holdout') AS holdout_cases FROM eval_example GROUP BY 1)
    SELECT *, train_cases >= 8 AND holdout_cases >= 1 AS ok FROM g""")
def example_case_gate(rows):
    return D.case_gate(rows, F.coalesce(D.lean("source"), F.lit("")), {"train": 8, "holdout": 1})


@query(_DOC, r"""WITH d AS (SELECT doc_id, replace(text, chr(13), '') AS text FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM d),
    h AS (SELECT *, regexp_extract(line, '^(#{1,6})[ \t]+([^ \t].*)$', 1) AS marks, trim(regexp_replace(line, '^#{1,6}[ \t]+', ''), ' ') AS title FROM l),
    c AS (SELECT *, last_value(CASE WHEN marks <> '' THEN marks || ' ' || title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h)
    SELECT * FROM (SELECT doc_id, coalesce(section, '_preamble') AS section, count(*) FILTER (marks = '' AND NOT (i = n AND line = '')) AS n_lines FROM c GROUP BY 1, 2) WHERE section <> '_preamble' OR n_lines > 0""")
def doc_titled_sections(docs):
    d = docs.select("doc_id", F.regexp_replace("text", "\r", "").alias("text"))
    return C.titled_sections(d, "doc_id", "text").filter("section <> '_preamble' or n_lines > 0").select(F.col("id").alias("doc_id"), "section", "n_lines")


@query(_DOC, r"""WITH t AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM documents), s AS (SELECT doc_id, t, least(1.0, length(t) / 1800) * 0.25 + least(1.0, len(regexp_extract_all(t, '(?m)^\s*\d+[.)]\s+')) / 6) * 0.35 * 0.2 + least(1.0, len(regexp_extract_all(t, '(?m)^\s*[-*•]\s+')) / 8) * 0.35
      + regexp_matches(t, '(?s)```.*?```')::INT * 0.05 + regexp_matches(t, '(?i)https?://\S+')::INT * 0.03 + regexp_matches(t, '`[^`]+`')::INT * 0.02 - (contains(t, '[[]') OR contains(t, 'TODO'))::INT * 0.1 - regexp_matches(t, '(?i)\b(none|n/a)\b')::INT * 0.08 AS score FROM t)
    SELECT doc_id, round((CASE WHEN t = '' THEN 0.0 ELSE greatest(0.0, least(1.0, score)) END)::DOUBLE, 5) AS score FROM s""")
def doc_section_scores(docs):
    return docs.select("doc_id", F.round(C.section_score(F.col("text"), 0.2, 1.0), 5).alias("score"))


@query(_DOC, f"""{_PAIR}, t AS (SELECT doc_id, lower(unnest(regexp_extract_all(evolved, '[a-zA-Z]{{4,}}'))) AS term FROM p), o AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(baseline, '[a-zA-Z]{{4,}}'))) AS term FROM p),
    k AS (SELECT doc_id, term, count(*) AS k FROM t WHERE term NOT IN {tuple(w for w in T.STOPWORDS if len(w) >= 4)} GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, term) AS INTEGER) AS rank, term, k FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = k.doc_id AND o.term = k.term) QUALIFY rank <= 5""")
def version_new_terms(docs):
    return G.new_terms(G.version_pairs(docs))
