"""Consensus labels on planted judges, scales, repeats; agreement by hand."""

from datetime import datetime

import numpy as np

from tracelode.llm import consensus

SCHEMA = "id bigint, timestamp timestamp, model_used string, task_id string, raw_score double, error_flag string, judge string, score double, label int"
AT = datetime(2025, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(i, AT, *r, None, "x", 0.0, 9)[:2] + (*r[:3], r[3] if len(r) > 3 else None, "x", 0.0, 9) for i, r in enumerate(rows)], SCHEMA)


def test_planted_judges(spark):
    rng = np.random.default_rng(4)
    truth, rows = {}, []
    judges = {"good-1": 0.08, "good-2": 0.1, "good-3": 0.12, "Good-4 ": 0.1, "noise": None, "inverted": "i", "lenient": "l"}
    for t in range(400):
        q = [0.15, 0.5, 0.85][rng.integers(3)] + rng.normal(0, 0.03)
        truth[f"t{t}"] = "low" if q < 0.35 else "mid" if q < 0.7 else "high"
        for j in rng.choice(list(judges), 5, replace=False):
            k = judges[j]
            s = rng.random() if k is None else 1 - q + rng.normal(0, 0.08) if k == "i" else 0.6 + 0.4 * q if k == "l" else q + rng.normal(0, k)
            s = float(np.clip(s, 0, 1))
            rows.append((j, f"t{t}", 100 * s if j == "good-2" and s > 0.02 else s))
    got = {r.task_id: r.label for r in consensus.consensus(log(spark, rows)).collect()}
    assert set(got) == set(truth)
    assert np.mean([got[t] == truth[t] for t in truth]) > 0.95
    acc = {r.judge: r.accuracy for r in consensus.judge_reliability(log(spark, rows)).collect()}
    assert acc["good-1"] > 0.85 and acc["inverted"] < 0.45 and acc["noise"] < 0.5 and "good-4" in acc


def test_what_counts(spark):
    rows = [("a", "t", 0.9), ("A ", "t", 0.9), ("b", "t", 0.8), ("c", "t", 0.1, "timeout"), ("c", "", 0.9), (None, "t", 0.1), ("d", "t", None), ("e", "t", float("nan")), ("f", "u", 0.2), ("g", "u", 7.0), ("g", "v", 3.0), ("h", "u", -1.0)]
    r = {(x.task_id, x.judge): x.score for x in consensus.ratings(log(spark, rows)).collect()}
    assert r == {("t", "a"): 0.9, ("t", "b"): 0.8, ("u", "f"): 0.2, ("u", "g"): 0.7, ("v", "g"): 0.3, ("u", "h"): 0.0}
    assert {x.task_id for x in consensus.consensus(log(spark, rows)).collect()} == {"u"}


def test_agreement(spark):
    rows = [("a", "t", 0.9), ("b", "t", 0.9), ("a", "u", 0.1), ("b", "u", 0.9), ("a", "v", 0.1)]
    r = consensus.agreement(log(spark, rows)).first()
    # pairs: t agrees, u differs: observed 2/4; labels low 1, high 3 of 4: expected (1*3 + 3*1) / (4*3)
    assert (r.tasks, r.ratings, r.observed, r.expected, r.alpha) == (2, 4, 0.5, 0.5, 0.0)


def test_empty(spark):
    assert consensus.consensus(log(spark, [])).count() == 0
    assert consensus.judge_reliability(log(spark, [])).count() == 0
    assert consensus.agreement(log(spark, [])).first().alpha is None


def test_lenient_harsh_and_inverted_judges_beat_the_majority(spark):
    rng = np.random.default_rng(11)
    shapes = {"exact-1": lambda q: q, "exact-2": lambda q: q, "lenient": lambda q: 0.5 + q / 2, "harsh": lambda q: q / 2, "inverted": lambda q: 1 - q, "mild": lambda q: 0.35 + q / 3, "random": None}
    truth, rows = {}, []
    for t in range(1500):
        q = [0.18, 0.52, 0.85][rng.integers(3)]
        truth[f"t{t}"] = int(q > 0.35) + int(q > 0.7)
        for j in rng.choice(list(shapes), 5, replace=False):
            f = shapes[j]
            rows.append((j, f"t{t}", float(np.clip(rng.random() if f is None else f(q) + rng.normal(0, 0.08), 0, 1))))
    names = {"low": 0, "mid": 1, "high": 2}
    got = {r.task_id: names[r.label] for r in consensus.consensus(log(spark, rows)).collect()}
    ours = np.mean([got[t] == k for t, k in truth.items()])
    votes = {t: np.zeros(3) for t in truth}
    for _, t, s in rows:
        votes[t][int(s >= 0.35) + int(s >= 0.7)] += 1
    majority = np.mean([int(v.argmax()) == truth[t] for t, v in votes.items()])
    print(f"right: by accuracy per band {ours:.3f}, by majority {majority:.3f}")
    assert ours > 0.95 and ours > majority + 0.15
