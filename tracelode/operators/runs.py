"""Run histories: cards, plateaus, backtracking, cost breaker, power-law fits, skylines and snapshots.

Windows partition by skill and order by time with the run id as tie-break; they carry a few numbers per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.checks import failed_checks
from tracelode.operators.ordering import equal_ranges
from tracelode.operators.scorelog import rounded

#: An improvement that marks a manual override, not a result.
OVERRIDE = 999.0
#: Ranges of x that a skyline is cut into.
RANGES = 10_000


def distinct_runs(runs: DataFrame) -> DataFrame:
    """One row per skill and run id: the one with the highest evolved score among runs written twice."""
    best = Window.partitionBy("skill", "run_id").orderBy(F.desc_nulls_last("evolved_score"), F.desc_nulls_last("baseline_score"), F.desc_nulls_last("elapsed_seconds"), F.desc_nulls_last("improvement"))
    return runs.withColumn("__rank", F.row_number().over(best)).filter("__rank = 1").drop("__rank")


def delta() -> Column:
    return F.col("evolved_score") - F.col("baseline_score")


def run_time(run_id: Column) -> Column:
    """Timestamp of a run id, whatever prefix of letters and digits it carries before yyyyMMdd_HHmmss."""
    return F.try_to_timestamp(F.regexp_extract(run_id, r"(\d{8}_\d{6})$", 1), F.lit("yyyyMMdd_HHmmss"))


def cards(runs: DataFrame) -> DataFrame:
    """One row per skill: runs, regressions, best and latest delta. Ties: the newest run, then the larger run id."""
    d = distinct_runs(runs).filter("skill is not null").withColumn("delta", delta())
    newest = F.struct("ts", "run_id")
    return d.groupBy("skill").agg(
        F.count(F.lit(1)).alias("run_count"), F.count_if(F.col("delta") < 0).alias("regressions"), rounded(F.max("delta")).alias("best_delta"),
        F.max_by("run_id", F.when(F.col("delta").isNotNull(), F.struct("delta", newest))).alias("best_run"), F.max_by("run_id", newest).alias("latest_run"), rounded(F.max_by("delta", newest)).alias("latest_delta"), (F.count(F.lit(1)) > 1).alias("multi_run"),
    )


def strongest(runs: DataFrame) -> DataFrame:
    """Per skill the improvement of greatest magnitude, sign kept; overrides left out; ties by the older run."""
    ok = distinct_runs(runs).filter((F.col("improvement") != OVERRIDE) & F.col("skill").isNotNull())
    order = Window.partitionBy("skill").orderBy(F.desc(F.abs("improvement")), "ts", "run_id")
    return ok.withColumn("r", F.row_number().over(order)).filter("r = 1").select("skill", "run_id", rounded(F.col("improvement")).alias("improvement"))


def recency(runs: DataFrame, now: str, hours: int = 24) -> DataFrame:
    at = run_time(F.col("run_id"))
    return distinct_runs(runs).select("skill", "run_id", at.alias("at"), F.coalesce((F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")) < at.cast("timestamp_ntz"), F.lit(False)).alias("is_recent"))


def by_time(skill: str = "skill") -> Window:
    return Window.partitionBy(skill).orderBy("ts", "run_id")


def plateaus(runs: DataFrame, window: int = 3, width: float = 0.01) -> DataFrame:
    """Every run with the score range of its last ``window`` runs and whether that is a plateau."""
    frame = by_time().rowsBetween(-(window - 1), 0)
    s = F.col("evolved_score")
    d = distinct_runs(runs).filter(s.isNotNull() & F.col("skill").isNotNull())
    d = d.withColumn("range", F.max(s).over(frame) - F.min(s).over(frame)).withColumn("k", F.count(s).over(frame))
    return d.select("skill", "run_id", rounded(F.when(F.col("k") == window, F.col("range"))).alias("range"), ((F.col("k") == window) & (F.col("range") <= width + 1e-10)).alias("plateau"))


def backtrack_targets(runs: DataFrame, gain: float = 0.01) -> DataFrame:
    """Per skill the run to return to: the one before the last step that gained more than ``gain`` of the first
    score; without such a step the third last run, or the first of fewer than three."""
    w = by_time()
    d = distinct_runs(runs).filter(F.col("evolved_score").isNotNull() & F.col("skill").isNotNull()).withColumn("i", F.row_number().over(w))
    first = F.first("evolved_score").over(w)
    first = F.when(first == 0, 1e-9).otherwise(first)
    d = d.withColumn("before", F.lag("run_id").over(w)).withColumn("step", (F.col("evolved_score") - F.lag("evolved_score").over(w)) / first)
    m = d.groupBy("skill").agg(F.max_by("before", F.when(F.col("step") > gain, F.col("i"))).alias("usable"), F.max("i").alias("n"))
    target = F.when(F.col("n") >= 3, F.col("n") - 2).otherwise(1)
    fallback = d.join(m.select("skill", target.alias("i")), ["skill", "i"]).select("skill", F.col("run_id").alias("fallback"))
    return m.join(fallback, "skill").select("skill", F.coalesce("usable", "fallback").alias("target"), F.col("usable").isNotNull().alias("by_gain"))


def backtrack_actions(runs: DataFrame, window: int = 3, width: float = 0.01, most: int = 3) -> DataFrame:
    """Every run with the action of a stateful check: continue, backtrack (counted), force_archive once ``most``
    backtracks were counted. A run off the plateau does not reset the count."""
    p = plateaus(runs, window, width)
    d = p.join(distinct_runs(runs).select("skill", "run_id", "ts"), ["skill", "run_id"])
    seen = F.sum(F.col("plateau").cast("int")).over(by_time().rowsBetween(Window.unboundedPreceding, -1))
    count = F.least(F.coalesce(seen, F.lit(0)), F.lit(most))
    action = F.when(count >= most, "force_archive").when(F.col("plateau"), "backtrack").otherwise("continue")
    return d.select("skill", "run_id", action.alias("action"))


def running_best(runs: DataFrame) -> DataFrame:
    d = distinct_runs(runs).filter(F.col("evolved_score").isNotNull() & F.col("skill").isNotNull())
    return d.select("skill", "run_id", rounded(F.max("evolved_score").over(by_time().rowsBetween(Window.unboundedPreceding, 0))).alias("best_so_far"))


def cost_breaker(runs: DataFrame, cost: Column, window: int = 3, least_cost: float = 0.01, least_gain: float = 0.005, now: str | None = None, cooldown_days: int = 7) -> DataFrame:
    """Per skill whether its newest runs were all costly without gain. Overrides are skipped, cheap runs ignored,
    any costly run with a gain closes the breaker, fewer than ``window`` runs never open it. Given ``now``, it is
    closed where the newest run is older than the cooldown."""
    order = Window.partitionBy("skill").orderBy(F.desc("ts"), F.desc("run_id"))
    d = distinct_runs(runs).filter("skill is not null and improvement is not null").withColumn("cost", cost).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= window)
    live = F.col("improvement") != OVERRIDE
    costly, poor = F.col("cost") >= least_cost, F.col("improvement") < least_gain
    m = d.groupBy("skill").agg(F.count(F.lit(1)).alias("runs"), F.count_if(live & costly & poor).alias("worthless"), F.coalesce(F.bool_or(live & costly & ~poor), F.lit(False)).alias("reset"))
    m = m.withColumn("open", (F.col("runs") == window) & ~F.col("reset") & (F.col("worthless") >= window))
    if now is None:
        return m
    newest = d.groupBy("skill").agg(F.max("ts").alias("newest"))
    cold = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {cooldown_days} days") > F.col("newest").cast("timestamp_ntz")
    return m.join(newest, "skill").withColumn("open", F.col("open") & ~F.coalesce(cold, F.lit(False))).drop("newest")


def power_law(runs: DataFrame, least: int = 4) -> DataFrame:
    """Per skill score = a * i^c + b over its runs in time order, by log-log regression above the first score."""
    d = distinct_runs(runs).filter(F.col("evolved_score").isNotNull() & F.col("skill").isNotNull())
    d = d.withColumn("i", F.row_number().over(by_time()).cast("double")).withColumn("b", F.first("evolved_score").over(by_time()))
    y = F.log(F.greatest(F.col("evolved_score") - F.col("b") + 1e-10, F.lit(1e-10)))
    fit = d.groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, F.log("i")).alias("c"), F.regr_intercept(y, F.log("i")).alias("ln_a"), F.min("b").alias("b")).filter(F.col("n") >= least)
    return fit.select("skill", "n", rounded(F.col("c"), 4).alias("exponent"), rounded(F.exp("ln_a"), 4).alias("scale"), rounded(F.col("b"), 4).alias("offset"))


def first_small_gain(fits: DataFrame, least: float = 0.005) -> DataFrame:
    """Per fit the first step after its runs whose predicted gain is below ``least`` (looked for up to 2 n + 9)."""
    a, c = F.col("scale"), F.col("exponent")
    steps = F.filter(F.sequence(F.col("n") + 1, 2 * F.col("n") + 9), lambda i: a * (F.pow(i.cast("double"), c) - F.pow((i - 1).cast("double"), c)) < least)
    return fits.select("skill", F.coalesce(F.try_element_at(steps, F.lit(1)), F.col("n")).alias("stop"))


def skyline(points: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other row beats in both x and y (higher is better); of equal rows all stay.

    By x the best y per x is kept and compared with the best y of all larger x. The span of x is cut into RANGES
    equal ranges: the best y of the ranges ahead is found over one row per range, and only the rows of one range
    that reach it are windowed together. Rows of a range that another range beats are gone before any window.
    """
    best = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.max(y).alias(y))
    ranged = best.withColumn("__range", equal_ranges(best, x, RANGES))
    ahead = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    later = ranged.groupBy("__range").agg(F.max(y).alias("__best")).withColumn("__later", F.max("__best").over(ahead)).drop("__best")
    inner = Window.partitionBy("__range").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    open_ = ranged.join(later, "__range").filter(F.col("__later").isNull() | (F.col(y) > F.col("__later")))
    keep = open_.withColumn("__top", F.max(y).over(inner)).filter(F.col("__top").isNull() | (F.col(y) > F.col("__top"))).select(x, y)
    return points.join(keep, [x, y], "left_semi")


def best_attempts(runs: DataFrame) -> DataFrame:
    """Per run with attempts: how many, and the first attempt with the highest evolved average."""
    a = distinct_runs(runs).filter("attempt_metrics is not null and size(attempt_metrics) > 0").select("skill", "run_id", F.explode("attempt_metrics").alias("m"))
    return a.groupBy("skill", "run_id").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("m.attempt", F.struct(F.col("m.avg_evolved"), -F.col("m.attempt"))).alias("best_attempt"), rounded(F.max("m.avg_evolved")).alias("best_evolved"))


def relative_gains(runs: DataFrame, significant: float = 0.05) -> DataFrame:
    b, d = F.col("baseline_score"), delta()
    return distinct_runs(runs).filter(b.isNotNull() & F.col("evolved_score").isNotNull()).select(
        "skill", "run_id", rounded(d / F.greatest(b, F.lit(0.001))).alias("improvement_pct"), F.coalesce(F.try_divide(d, b) >= significant, F.lit(False)).alias("significant")
    )


def status_counts(runs: DataFrame, kinds: tuple[str, ...] = ("improved", "flat", "regressed", "unscored")) -> DataFrame:
    """Runs per outcome within one per cent of no change; every outcome has a row, absent ones with 0."""
    pct = delta() / F.greatest(F.col("baseline_score"), F.lit(0.001))
    kind = F.when(pct.isNull(), "unscored").when(pct > 0.01, "improved").when(pct < -0.01, "regressed").otherwise("flat")
    counts = distinct_runs(runs).groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("runs"))
    fixed = runs.sparkSession.createDataFrame([(k,) for k in kinds], "outcome string")
    return fixed.join(counts, "outcome", "left").select("outcome", F.coalesce("runs", F.lit(0)).alias("runs"))


def filtered(rows: DataFrame, delta_min: float | None = None, delta_max: float | None = None, search: str | None = None, multi_run: bool | None = None, one_of: dict[str, tuple] | None = None, younger_than: Column | None = None, age: str = "age_hours") -> DataFrame:
    """Cards by optional conditions; a null delta meets no bound; search looks into skill and runs, without case;
    one_of: values allowed per column (status, priority, source, board, flags), texts without case; younger_than:
    hours that the age must not reach (``functions.text.age_hours`` reads '1d' or '2w')."""
    for column, values in (one_of or {}).items():
        text = dict(rows.dtypes)[column] == "string"
        rows = rows.filter(F.lower(column).isin(*(v.lower() for v in values)) if text else F.col(column).isin(*values))
    if younger_than is not None:
        rows = rows.filter(F.col(age) < younger_than)
    if delta_min is not None:
        rows = rows.filter(F.col("best_delta") >= delta_min)
    if delta_max is not None:
        rows = rows.filter(F.col("best_delta") <= delta_max)
    if multi_run is not None:
        rows = rows.filter(F.col("multi_run") == multi_run)
    if search is not None:
        rows = rows.filter(F.lower(F.concat_ws("\n", "skill", "best_run", "latest_run")).contains(search.lower()))
    return rows


def top(rows: DataFrame, by: str, limit: int, tie: str) -> DataFrame:
    """Sorted first, then limited: numbers descending, strings ascending without case, nulls last."""
    text = dict(rows.dtypes)[by] == "string"
    return rows.orderBy(F.lower(by).asc_nulls_last() if text else F.col(by).desc_nulls_last(), tie).limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The snapshot after writing ``new`` over ``old``: rows of both by key, values of new where they are not null,
    old ones for columns in ``keep`` that are set already; ``change`` is insert, update or stale (old rows only)."""
    o = old.select(F.col(key), *(F.col(c).alias(f"o_{c}") for c in old.columns if c != key), F.lit(True).alias("in_old"))
    n = new.select(F.col(key), *(F.col(c).alias(f"n_{c}") for c in new.columns if c != key), F.lit(True).alias("in_new"))
    both = o.join(n, key, "full")
    cols = [F.coalesce(*((f"o_{c}", f"n_{c}") if c in keep else (f"n_{c}", f"o_{c}"))).alias(c) for c in old.columns if c != key]
    change = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "stale").otherwise("update")
    return both.select(key, *cols, change.alias("change"))


def latest_state(events: DataFrame, key: str, order: list[str], deleted: Column) -> DataFrame:
    """Last event per key of an append-only log, unless it is a deletion."""
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("__r", F.row_number().over(last)).filter("__r = 1").filter(~deleted).drop("__r")


def fit_phases(runs: DataFrame, flat: float = 0.05, rising: float = 0.20, gain: float = 0.03) -> DataFrame:
    """Per skill the fit of ``power_law`` with its R squared, the phase it shows, how sure that is, and what to do.

    plateau: an exponent below ``flat`` that explains over half of the variance (stop); diminishing_returns: below
    ``rising`` (wind_down); else early_discovery (continue). ``at_double``: the predicted score after as many runs
    again, within 0 and 1; ``stop``: the first step whose predicted gain is below ``gain``, null beyond the runs.
    """
    fits = power_law(runs)
    d = distinct_runs(runs).filter(F.col("evolved_score").isNotNull() & F.col("skill").isNotNull()).withColumn("i", F.row_number().over(by_time()).cast("double"))
    a, b, c, n = F.col("scale"), F.col("offset"), F.col("exponent"), F.col("n")
    residual = F.col("evolved_score") - (a * F.pow("i", c) + b)
    # moments in one aggregation: partial sums per task
    m = d.join(fits, "skill").groupBy("skill", "n", "exponent", "scale", "offset").agg(F.sum(residual * residual).alias("rest"), (F.var_pop("evolved_score") * F.count(F.lit(1))).alias("whole"))
    m = m.withColumn("r2", rounded(1 - F.col("rest") / F.greatest(F.col("whole"), F.lit(1e-10)), 4))
    phase = F.when((c < flat) & (F.col("r2") > 0.5), "plateau").when(c < rising, "diminishing_returns").otherwise("early_discovery")
    sure = F.when(F.col("phase") == "plateau", F.greatest(F.lit(0.5), (flat - c) / flat)).when(F.col("phase") == "diminishing_returns", F.greatest(F.lit(0.4), (rising - c) / rising)).otherwise(F.greatest(F.lit(0.3), (c - rising) / rising + 0.3))
    action = F.when(F.col("phase") == "plateau", "stop").when(F.col("phase") == "diminishing_returns", "wind_down").otherwise("continue")
    steps = F.filter(F.sequence(n + 1, 2 * n + 9), lambda i: a * (F.pow(i.cast("double"), c) - F.pow((i - 1).cast("double"), c)) < gain)
    at_double = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a * F.pow(2.0 * n, c) + b))
    return m.withColumn("phase", phase).select(
        "skill", "n", "r2", "phase", rounded(F.least(F.lit(1.0), sure), 4).alias("confidence"), action.alias("action"), F.try_element_at(steps, F.lit(1)).alias("stop"), rounded(at_double, 4).alias("at_double")
    )


def regressions(runs: DataFrame, slack: float = 0.05) -> DataFrame:
    """Every scored run as pass (no worse than its baseline), minor (within ``slack``) or regression."""
    lost = F.col("baseline_score") - F.col("evolved_score")
    d = distinct_runs(runs).filter(lost.isNotNull())
    return d.select("skill", "run_id", rounded(lost).alias("lost"), F.when(rounded(lost) > slack, "regression").when(F.col("evolved_score") >= F.col("baseline_score"), "pass").otherwise("minor").alias("verdict"))


def report_gate(rows: DataFrame, least_delta: float = 0.0, most_growth: float = 0.5, most_cost: float | None = None, need_constraints: bool = True) -> DataFrame:
    """Adds ``failed``: the conditions that a run report does not meet; a missing value fails.

    rows: baseline_size, evolved_size, delta, constraints_passed, and for a cost limit baseline_cost, evolved_cost.
    """
    grown = (F.col("evolved_size") - F.col("baseline_size")) / F.greatest(F.lit(1.0), F.col("baseline_size"))
    checks = {"delta": rounded(F.col("delta")) >= least_delta, "growth": grown <= most_growth}
    if need_constraints:
        checks = {"constraints": F.col("constraints_passed")} | checks
    if most_cost is not None:
        checks["cost"] = (F.col("evolved_cost") - F.col("baseline_cost")) / F.greatest(F.lit(1e-6), F.col("baseline_cost")) <= most_cost
    return rows.withColumn("failed", failed_checks(checks))
