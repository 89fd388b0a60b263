"""Analytics over an append-only score log: one row per scored answer, error rows flagged.

Every function is one or two aggregations; generations and skills are few against rows, so windows run over
aggregated rows only. Rates of no rows are 0, means of no rows null. "now" is always a parameter or the data's own
latest time, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.session import materialise

#: Scores of the lowest and highest ends that tell answers apart no more.
DEAD_LOW, DEAD_HIGH = 0.05, 0.95
UNCERTAIN = (0.35, 0.70)
# Alert limits of the health check.
STD_FLOOR, MEAN_CEILING, MEAN_FLOOR, ERROR_CEILING, DEAD_CEILING, SUSTAINED = 0.08, 0.90, 0.15, 0.005, 0.80, 3


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def is_error() -> Column:
    return F.col("error_flag").isNotNull()


def good_score() -> Column:
    """The score of a row without error, else null."""
    return F.when(~is_error(), F.col("raw_score"))


def error_counts(log: DataFrame) -> DataFrame:
    return log.filter(is_error()).groupBy("error_flag").agg(F.count(F.lit(1)).alias("n"))


def summary(log: DataFrame, *by: str) -> DataFrame:
    """Error rate, mean, sample deviation, dead-zone share, cost, generations: one pass, per group or overall."""
    s = good_score()
    dead = F.when(s.isNotNull(), ((s <= DEAD_LOW) | (s >= DEAD_HIGH)).cast("double"))
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.coalesce(F.avg(is_error().cast("double")), F.lit(0.0))).alias("error_rate"),
        rounded(F.avg(s)).alias("mean_score"),
        rounded(F.stddev_samp(s)).alias("std_score"),
        rounded(F.coalesce(F.avg(dead), F.lit(0.0))).alias("dead_zone"),
        rounded(F.coalesce(F.sum("token_cost_estimate"), F.lit(0.0))).alias("total_cost"),
        F.count_distinct("generation").alias("generations"),
        F.max("generation").alias("latest_generation"),
    )


def by_skill_generation(log: DataFrame) -> DataFrame:
    return log.groupBy("skill_name", "generation").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("raw_score"), 4).alias("avg_score"), rounded(F.avg("latency_ms"), 1).alias("avg_latency"), F.count_if(is_error()).alias("errors")
    )


def moments(log: DataFrame) -> DataFrame:
    """Per generation (null is one): rows, errors, scored rows, sum and sum of squares, dead-zone rows; all of them
    add up over generations."""
    s = good_score()
    return log.groupBy("generation").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("errors"), F.count(s).alias("k"), F.coalesce(F.sum(s), F.lit(0.0)).alias("sx"), F.coalesce(F.sum(s * s), F.lit(0.0)).alias("sxx"),
        F.count_if((s <= DEAD_LOW) | (s >= DEAD_HIGH)).alias("dead"),
    )


def since_generation(log: DataFrame) -> DataFrame:
    """Statistics of all rows of a generation or a later one, for each generation."""
    return since(moments(log))


def since(per_generation: DataFrame) -> DataFrame:
    """The same from moments(): the window adds up the moments of the generations, not the rows."""
    later = Window.orderBy("generation").rowsBetween(0, Window.unboundedFollowing)
    m = per_generation.filter("generation is not null")
    for c in ("n", "errors", "k", "sx", "sxx"):
        m = m.withColumn(c, F.sum(c).over(later))
    k, sx = F.col("k"), F.col("sx")
    var = F.greatest(F.lit(0.0), (F.col("sxx") - sx * sx / k) / (k - 1))
    return m.select(
        "generation", "n", rounded(F.col("errors") / F.col("n")).alias("error_rate"), rounded(F.when(k > 0, sx / k)).alias("mean_score"), rounded(F.when(k > 1, F.sqrt(var))).alias("std_score")
    )


def _sustained(rows: DataFrame, code: str, value: str, breach: Column, limit: float) -> DataFrame:
    """One alert row if the last SUSTAINED breaching generations follow each other without a gap."""
    bad = rows.filter(breach).groupBy().agg(F.slice(F.sort_array(F.collect_list(F.struct("generation", value))), -SUSTAINED, SUSTAINED).alias("last"))
    last = F.col("last")
    gap_free = (F.size(last) == SUSTAINED) & (last[SUSTAINED - 1]["generation"] - last[0]["generation"] == SUSTAINED - 1)
    return bad.filter(gap_free).select(F.lit(code).alias("code"), last[SUSTAINED - 1][value].alias("value"), F.lit(limit).alias("threshold"), last[SUSTAINED - 1]["generation"].alias("generation"))


def health_alerts(log: DataFrame) -> DataFrame:
    """(code, value, threshold, generation): alerts on flat, lenient or harsh scoring, errors, dead zones.

    The first three need SUSTAINED successive generations, each judged on all rows since it. The log is read once;
    everything follows from one row of moments per generation, i.e. per scoring round.
    """
    m = materialise(moments(log), "moments")
    later = since(m)
    whole = m.agg(
        rounded(F.coalesce(F.try_divide(F.sum("errors"), F.sum("n")), F.lit(0.0))).alias("error_rate"), rounded(F.coalesce(F.try_divide(F.sum("dead"), F.sum("k")), F.lit(0.0))).alias("dead_zone"), F.max("generation").alias("latest_generation")
    )
    one = lambda code, value, limit: whole.filter(F.col(value) > limit).select(F.lit(code).alias("code"), F.col(value).alias("value"), F.lit(limit).alias("threshold"), F.col("latest_generation").alias("generation"))
    parts = [
        _sustained(later, "STD_DEV_FLAT", "std_score", F.col("std_score") < STD_FLOOR, STD_FLOOR),
        _sustained(later, "RUBBER_STAMP", "mean_score", F.col("mean_score") > MEAN_CEILING, MEAN_CEILING),
        _sustained(later, "OVERLY_HARSH", "mean_score", F.col("mean_score") < MEAN_FLOOR, MEAN_FLOOR),
        one("JUDGE_ERRORS", "error_rate", ERROR_CEILING),
        one("DEAD_ZONE", "dead_zone", DEAD_CEILING),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recent(log: DataFrame, limit: int, generations: list[int] | None = None, skill: str | None = None) -> DataFrame:
    """The newest rows, of given generations (0 is one like any other) or a skill; ties by larger id."""
    if generations is not None:
        log = log.filter(F.col("generation").isin(generations))
    if skill is not None:
        log = log.filter(F.col("skill_name") == skill)
    return log.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def run_cost(log: DataFrame, hours: int = 2) -> DataFrame:
    """Cost per skill in the last ``hours`` up to the skill's newest row."""
    last = log.groupBy("skill_name").agg(F.max("timestamp").alias("last"))
    near = log.join(last, "skill_name").filter(F.col("timestamp") >= F.col("last") - F.expr(f"interval {hours} hours"))
    return near.groupBy("skill_name").agg(F.max("last").alias("until"), rounded(F.coalesce(F.sum("token_cost_estimate"), F.lit(0.0))).alias("cost"))


def hash_share(key: Column, per_10000: int) -> Column:
    """True for about per_10000 of 10,000 keys, by eight hex digits of their md5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(10_000)) < per_10000


def appeal_sample(log: DataFrame, per_10000: int = 500) -> DataFrame:
    """Scored rows for a second judgement: a hashed share of all, else those in the uncertain zone (inclusive)."""
    reason = F.when(hash_share(F.col("id"), per_10000), "random_sample").when(F.col("raw_score").between(*UNCERTAIN), "uncertain_zone")
    return log.filter(~is_error()).select("id", "generation", "skill_name", "task_id", "raw_score", reason.alias("reason")).filter("reason is not null")


def bucket(score: Column) -> Column:
    return F.when(score < UNCERTAIN[0], 0).when(score < UNCERTAIN[1], 1).when(score.isNotNull(), 2)


def tier_pairs(log: DataFrame, first: str, second: str) -> DataFrame:
    """Scores of two judges for one task and generation: the first-logged row of each, joined by key."""
    judge = F.lower(F.trim("model_used"))
    rows = log.filter(~is_error() & judge.isin(first, second) & (F.coalesce("task_id", F.lit("")) != ""))
    one = rows.groupBy("task_id", "generation", judge.alias("judge")).agg(F.min_by("raw_score", "id").alias("score"))
    return one.groupBy("task_id", "generation").agg(F.max(F.when(F.col("judge") == first, F.col("score"))).alias("tier1"), F.max(F.when(F.col("judge") == second, F.col("score"))).alias("tier2")).filter("tier1 is not null and tier2 is not null")


def kappa(pairs: DataFrame, *by: str) -> DataFrame:
    """Cohen's kappa over three buckets, agreement and pair count: bucket margins in one aggregation.

    Expected agreement 1 gives kappa 1; kappa is kept within -1 and 1.
    """
    a, b = bucket(F.col("tier1")), bucket(F.col("tier2"))
    n = F.count(F.lit(1))
    m = pairs.groupBy(*by).agg(n.alias("pairs"), F.avg((a == b).cast("double")).alias("observed"), sum(F.avg((a == k).cast("double")) * F.avg((b == k).cast("double")) for k in range(3)).alias("expected"))
    value = F.when(F.col("expected") >= 1, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")))))
    return m.select(*by, "pairs", rounded(F.col("observed")).alias("agreement"), rounded(value).alias("kappa"))


def kappa_breaches(per_generation: DataFrame, floor: float = 0.6, least: int = 3, halt: int = 2) -> DataFrame:
    """(generations, breaches, halt): how many of the newest generations in a row fall below the floor."""
    rows = per_generation.filter(F.col("pairs") >= least)
    last_good = rows.filter(F.col("kappa") >= floor).agg(F.max("generation").alias("good"))
    after = rows.join(last_good).agg(F.count(F.lit(1)).alias("generations"), F.count_if(F.col("good").isNull() | (F.col("generation") > F.col("good"))).alias("breaches"))
    return after.withColumn("halt", F.col("breaches") >= halt)


def variant_means(log: DataFrame, variant: Column, baseline: str | None = None) -> DataFrame:
    """Mean score per variant, its distance from the best mean, and the winner (ties by name)."""
    means = log.filter(~is_error()).groupBy(variant.alias("variant")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("raw_score")).alias("mean_score"))
    best = means.agg(F.max(F.struct("mean_score")).alias("best"))
    top = F.col("best.mean_score")
    winner = F.min(F.when(F.col("mean_score") == top, F.col("variant"))).over(Window.partitionBy(F.lit(0)))
    return means.join(best).select("variant", "n", "mean_score", rounded(F.col("mean_score") - top).alias("behind_best"), (winner == F.col("variant")).alias("winner"))


def calibration(log: DataFrame, canary: str, least_gap: float = 0.1) -> DataFrame:
    """Mean score of a canary task against all others, and whether three checks pass: both present, gap, order."""
    s = good_score()
    canary_row = F.col("task_id") == canary
    m = log.agg(F.avg(F.when(canary_row, s)).alias("c"), F.avg(F.when(~canary_row, s)).alias("o"))
    checks = F.array(F.col("c").isNotNull() & F.col("o").isNotNull(), F.coalesce(F.abs(F.col("c") - F.col("o")) >= least_gap, F.lit(False)), F.coalesce(F.col("c") < F.col("o"), F.lit(False)))
    return m.select(rounded(F.col("c")).alias("canary_mean"), rounded(F.col("o")).alias("other_mean"), F.size(F.filter(checks, lambda x: x)).alias("passed"))
