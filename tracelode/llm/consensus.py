"""Consensus from several annotators' scores, by iteratively reweighted voting.

An annotator's accuracy is kept per band of their scores and label: the smoothed share of their ratings in the band
whose task is, by the consensus of the other annotators, of that label. A rating votes for every label with the
logarithm of that accuracy over the label's share of all ratings. So a reliable annotator's votes weigh much, a random
one's nothing, a lenient one's are shifted and an inverted one's count for the opposite.

Accuracy and weighted consensus alternate until stable. The consensus that a rating is held against leaves the
rating's own vote out, and accuracy is smoothed towards the labels' shares, so that annotators with few ratings neither
confirm themselves nor get extreme weights. Agreement is Krippendorff's alpha, which corrects for chance and takes tasks with any number of
ratings.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.session import materialise

LABELS = ("low", "mid", "high")
CUTS = (0.35, 0.70)
#: Score bands of one width that tell how an annotator uses the scale.
BANDS = 20
#: Ratings by which a band's accuracy is smoothed.
SMOOTH = 2.0
MOST_ROUNDS, STABLE = 50, 1e-3
LEAST_JUDGES = 3


def _label(score) -> Column:
    return F.when(score < CUTS[0], 0).when(score < CUTS[1], 1).otherwise(2)


def ratings(log: DataFrame) -> DataFrame:
    """(task_id, judge, score, label, band): one row per judge and task of the usable rows of a score log.

    Left out: rows with an error_flag, without task, judge or score (null, blank or NaN). Judges are compared
    without case and outer blanks. A score above 1 is read on the judge's own larger scale: of ten if none of
    theirs exceeds 10, else of a hundred; what is still outside 0 to 1 is clamped. Rows logged twice (same time
    and score) count once; several scores of one judge for one task are averaged.
    """
    judge = F.lower(F.trim("model_used"))
    usable = log.select("task_id", judge.alias("judge"), F.col("raw_score").alias("score"), "timestamp", "error_flag").filter(
        (F.trim(F.coalesce("error_flag", F.lit(""))) == "")
        & (F.trim(F.coalesce("task_id", F.lit(""))) != "") & (F.coalesce(judge, F.lit("")) != "") & F.col("score").isNotNull() & ~F.isnan("score")
    )
    usable = usable.drop("error_flag").distinct()
    top = usable.groupBy("judge").agg(F.max("score").alias("top"))
    scaled = usable.join(top, "judge").withColumn("score", F.when(F.col("score") > 1, F.col("score") / F.when(F.col("top") <= 10, 10.0).otherwise(100.0)).otherwise(F.col("score")))
    one = scaled.groupBy("task_id", "judge").agg(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score"))).alias("score"))
    band = F.least(F.floor(F.col("score") * BANDS + 1e-9), F.lit(BANDS - 1)).cast("int")
    return one.select("task_id", "judge", "score", _label(F.col("score")).alias("label"), band.alias("band"))


def _posterior(parts: list) -> list:
    """Probabilities of the labels from their summed log weights."""
    top = F.greatest(*parts)
    e = [F.exp(x - top) for x in parts]
    return [x / (e[0] + e[1] + e[2]) for x in e]


def fit(rated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(weights, votes): the stable weights (judge, band, w0, w1, w2) and each task's votes (task_id, v0, v1, v2).

    rated: materialised ratings. Each round joins the ratings with the small weight table, adds them up per task
    (partial sums first, so a task with very many ratings is no hot spot) and counts the outcome per judge and
    band, which is written; the driver sees the largest change of an accuracy. Warns if MOST_ROUNDS did not suffice.
    """
    counts = [F.sum((F.col("label") == k).cast("double")).alias(f"v{k}") for k in range(3)]
    votes, weights = rated.groupBy("task_id").agg(*counts), None
    for _ in range(MOST_ROUNDS):
        if weights is None:  # first round: the plain counts of the others' labels
            left = [F.col(f"v{k}") - (F.col("label") == k).cast("double") for k in range(3)]
            total = left[0] + left[1] + left[2]
            post = [F.when(total > 0, x / total).otherwise(1 / 3) for x in left]
            held = rated.join(votes, "task_id")
        else:
            post = _posterior([F.col(f"v{k}") - F.col(f"w{k}") for k in range(3)])
            held = rated.join(weights, ["judge", "band"]).join(votes, "task_id")
        table = materialise(held.groupBy("judge", "band").agg(*(F.sum(post[k]).alias(f"n{k}") for k in range(3))), "accuracy")
        shares = table.agg(F.struct(*(F.greatest(F.sum(f"n{k}") / F.sum(F.col("n0") + F.col("n1") + F.col("n2")), F.lit(1e-6)).alias(f"p{k}") for k in range(3))).alias("p")).scalar()
        n = F.col("n0") + F.col("n1") + F.col("n2")
        accuracy = [(F.col(f"n{k}") + SMOOTH * shares[f"p{k}"]) / (n + SMOOTH) for k in range(3)]
        fresh = table.select("judge", "band", *(accuracy[k].alias(f"a{k}") for k in range(3)), *(F.log(accuracy[k] / shares[f"p{k}"]).alias(f"w{k}") for k in range(3)))
        change = None
        if weights is not None:
            old = weights.select("judge", "band", *(F.col(f"a{k}").alias(f"o{k}") for k in range(3)))
            change = fresh.join(old, ["judge", "band"]).agg(F.max(F.greatest(*(F.abs(F.col(f"a{k}") - F.col(f"o{k}")) for k in range(3))))).first()[0] or 0.0
        weights = fresh
        votes = rated.join(weights.drop("a0", "a1", "a2"), ["judge", "band"]).groupBy("task_id").agg(*((F.sum(f"w{k}") + F.log(shares[f"p{k}"])).alias(f"v{k}") for k in range(3)))
        if change is not None and change < STABLE:
            break
    else:
        warnings.warn(f"accuracies still change by {change} after {MOST_ROUNDS} rounds", stacklevel=2)
    return weights, votes


def consensus(log: DataFrame) -> DataFrame:
    """(task_id, label) of every task that at least three judges rated; ties go to the lower label."""
    rated = materialise(ratings(log), "ratings")
    _, votes = fit(rated)
    many = rated.groupBy("task_id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= LEAST_JUDGES)
    label = F.when((F.col("v0") >= F.col("v1")) & (F.col("v0") >= F.col("v2")), LABELS[0]).when(F.col("v1") >= F.col("v2"), LABELS[1]).otherwise(LABELS[2])
    return votes.join(many, "task_id").select("task_id", label.alias("label"))


def judge_reliability(log: DataFrame) -> DataFrame:
    """(judge, ratings, agreeing, accuracy): how often a judge's label is the consensus of the other judges.

    accuracy is smoothed by one right and two wrong ratings, i.e. towards chance.
    """
    rated = materialise(ratings(log), "ratings")
    weights, votes = fit(rated)
    rest = [F.col(f"v{k}") - F.col(f"w{k}") for k in range(3)]
    other = F.when((rest[0] >= rest[1]) & (rest[0] >= rest[2]), 0).when(rest[1] >= rest[2], 1).otherwise(2)
    held = rated.join(weights, ["judge", "band"]).join(votes, "task_id").withColumn("right", (other == F.col("label")).cast("bigint"))
    out = held.groupBy("judge").agg(F.count(F.lit(1)).alias("ratings"), F.sum("right").alias("agreeing"))
    return out.withColumn("accuracy", (F.col("agreeing") + 1) / (F.col("ratings") + 3))


def agreement(log: DataFrame) -> DataFrame:
    """(tasks, ratings, observed, expected, alpha): nominal Krippendorff's alpha of the labels.

    Tasks with a single rating do not count. alpha is null where all ratings are of one label, or none exist.
    """
    per = ratings(log).groupBy("task_id").agg(*(F.sum((F.col("label") == k).cast("bigint")).alias(f"n{k}") for k in range(3)), F.count(F.lit(1)).alias("m")).filter("m > 1")
    differing = sum(F.col(f"n{k}") * (F.col("m") - F.col(f"n{k}")) for k in range(3)) / (F.col("m") - 1)
    all_ = per.agg(F.count(F.lit(1)).alias("tasks"), F.coalesce(F.sum("m"), F.lit(0)).alias("ratings"), F.sum(differing).alias("d"), *(F.sum(f"n{k}").alias(f"s{k}") for k in range(3)))
    n = F.col("ratings")
    observed = F.try_divide(F.col("d"), n)
    expected = F.try_divide(sum(F.col(f"s{k}") * (n - F.col(f"s{k}")) for k in range(3)), n * (n - 1))
    return all_.select("tasks", "ratings", observed.alias("observed"), expected.alias("expected"), (1 - F.try_divide(observed, expected)).alias("alpha"))
