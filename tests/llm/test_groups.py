"""Group splits: links through sessions and tasks, components over several levels, greedy shares."""

import collections

import pytest
from pyspark.sql import functions as F

from tracelode.llm import group_split

SCHEMA = "example_id bigint, task_input string, source string, session_id string, id string, s string"


def df(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


ROWS = [
    (1, "Do  this", "A", "s1"), (2, "other", "a ", " S1"), (3, "do this ", "B", None), (4, "alone", "B", "  "), (5, None, "B", None), (6, None, "B", None),
    (7, "x", None, "q"), (8, "y", None, "q"), (9, "DO THIS", "C", "z"), (10, "w", "c", "Z"), (11, "s1 elsewhere", "D", "s1"), (1, "Do  this", "A", "s1"), (None, "do this", "A", "s1"),
]


def test_linked_groups(spark):
    got = {(r.id, r.group_id) for r in group_split.linked_groups(df(spark, ROWS), "example_id").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 1), (10, 1), (7, 7), (8, 7)}


def test_splits_keep_groups_and_shares(spark):
    rows = [(i, f"t{i}", "s", f"g{i // (1 + i % 7)}") for i in range(1, 400)]
    got = group_split.assign_splits(df(spark, rows), "example_id", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert sorted(r.id for r in got) == list(range(1, 400))
    splits = collections.defaultdict(set)
    for r in got:
        splits[r.group_id].add(r.split)
    assert all(len(x) == 1 for x in splits.values())
    share = collections.Counter(r.split for r in got)
    assert abs(share["train"] - 319) <= 2 and abs(share["test"] - 40) <= 2


def test_empty(spark):
    assert group_split.linked_groups(df(spark, []), "example_id").count() == 0
    assert group_split.assign_splits(df(spark, []), "example_id", {"train": 0.8, "test": 0.2}).count() == 0


def test_a_hub_is_spread_and_reduced_where_it_lies(spark, monkeypatch):
    monkeypatch.setattr(group_split, "LAST_EDGES", 1000)
    edges = spark.createDataFrame([(5, k) for k in range(10, 20_010)] + [(-k, -k - 1) for k in range(1, 20_000, 3)], "u bigint, v bigint").repartition(8)
    rows = group_split.spread(edges, 80).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert rows < 3 * edges.count() / 80
    got = {r.node: r.root for r in group_split.components(edges).collect()}
    assert all(got[k] == 5 for k in range(10, 20_010)) and all(got[-k] == -k - 1 for k in range(1, 20_000, 3)) and len(got) == 20_001 + 2 * 6667


@pytest.mark.parametrize(("last", "nodes"), [(500_000, 1_000_000), (3, 1_000_000), (3, 5)])
def test_components_over_levels(spark, monkeypatch, last, nodes):
    monkeypatch.setattr(group_split, "LAST_EDGES", last)
    monkeypatch.setattr(group_split, "FOREST_NODES", nodes)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (None, 5), (300, 301), (301, 300)]
    got = {r.node: r.root for r in group_split.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(4)).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[k] == 100 for k in range(100, 130)) and got[200] == 200 and got[301] == 300


def test_greedy_counts_follow_the_plain_greedy():
    for short, size, k in (([8.0, 1.0, 1.0], 1, 10), ([5.5, 2.0, 0.5], 2, 7), ([3.0, 3.0], 1, 3), ([0.0, 0.0, 0.0], 3, 2)):
        left, want = list(short), [0] * len(short)
        for _ in range(k):
            i = max(range(len(left)), key=lambda j: left[j])
            want[i] += 1
            left[i] -= size
        assert group_split.greedy_counts(short, size, k) == want
