"""Splits that keep related records together: distributed union-find, then greedy assignment of groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.session import materialise

#: Edges that one task may finish alone; more are merged in further distributed levels.
LAST_EDGES = 200_000
#: Nodes that a task's forest holds; a larger one is passed on and begun anew.
FOREST_NODES = 2 * LAST_EDGES
#: Groups that are ranked together in one task.
RANK_ROWS = 200_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task: every node seen with the smallest node of its local tree.

    As edges (node, root) link what the edges did, an overfull forest is emitted and a new one begun.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def trees() -> Iterator[pa.RecordBatch]:
        nodes = list(parent)
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.record_batch({"node": pa.array(part, pa.int64()), "root": pa.array([find(x) for x in part], pa.int64())})

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > FOREST_NODES:
            yield from trees()
            parent.clear()
    yield from trees()


def spread(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges over tasks by both ends, so that those of a hub meet in no task."""
    return edges.repartition(tasks, "u", "v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (u, v: bigint) with the smallest node of its component.

    Local forests are built where the edges lie, so what moves is one row per task and node. Their trees are the
    edges of the next level, again in local forests; nodes that got different roots in different tasks link those
    roots, and the links are the (smaller) edge list of the level after, until one task can finish. The levels'
    pointers are then resolved from the top down. Edges are spread by both ends: a hub's edges meet only as one row
    (hub, root) per task. Self-loops keep a node alone; null ends are dropped.
    """
    found = edges.filter("u is not null and v is not null").select("u", "v").mapInArrow(forest, "node bigint, root bigint")
    edges = materialise(found.select(F.col("node").alias("u"), F.col("root").alias("v")).distinct(), "edges")
    levels: list[DataFrame] = []
    while True:
        n = edges.count()
        local = edges.coalesce(1) if n <= LAST_EDGES else spread(edges, max(2, int(n // LAST_EDGES) * 4))
        trees = materialise(local.mapInArrow(forest, "node bigint, root bigint"), "forest")
        if n <= LAST_EDGES:
            result = trees
            break
        least = trees.groupBy("node").agg(F.min("root").alias("root"))
        levels.append(materialise(least, "level"))
        edges = materialise(trees.join(levels[-1].withColumnRenamed("root", "v"), "node").select(F.col("root").alias("u"), "v").filter("u <> v").distinct(), "edges")
    for level in reversed(levels):
        up = result.select(F.col("node").alias("root"), F.col("root").alias("top"))
        result = materialise(level.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "resolved")
    return result


def norm(column: str):
    """Compared without case and outer blanks."""
    return F.lower(F.trim(column))


def linked_groups(records: DataFrame, id_col: str) -> DataFrame:
    """(id, group_id) of every record in a group of two or more; group_id is the group's smallest id.

    Records are linked, also through others, by equal source and non-blank session_id (both without case and
    outer blanks; a null source counts as blank), or by equal task_input (lower-cased, runs of white space as
    one blank, ends trimmed; null or blank ones link nothing). The graph's nodes are the session and task keys,
    not the records: a session of any size is one node, and each record is one edge between its two keys.
    """
    blank = "[\\s\\u0085\\u00A0\\u1680\\u180E\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
    task = F.trim(F.regexp_replace(F.lower("task_input"), blank, " "))
    session = F.trim(F.regexp_replace(F.lower("session_id"), f"^{blank}|{blank}$", ""))
    source = F.coalesce(F.trim(F.regexp_replace(F.lower("source"), f"^{blank}|{blank}$", "")), F.lit(""))
    keyed = records.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.when(F.coalesce(session, F.lit("")) != "", F.xxhash64(F.lit("s"), source, session)).alias("s"),
        F.when(F.coalesce(task, F.lit("")) != "", F.xxhash64(F.lit("t"), task)).alias("t"),
    )
    keyed = materialise(keyed, "keyed")
    # a task key joins sessions only where it occurs with two of them, so all other tasks stay out of the graph
    links = keyed.filter("s is not null and t is not null").select("s", "t").distinct()
    shared = links.groupBy("t").agg(F.min("s").alias("u"), F.max("s").alias("w")).filter("u <> w").select("t", "u")
    roots = components(links.join(shared, "t").filter("s <> u").select("u", F.col("s").alias("v")))
    task_root = shared.join(roots.select(F.col("node").alias("u"), "root"), "u").select("t", "root")
    lone = links.groupBy("t").agg(F.min("s").alias("only"), F.max("s").alias("w")).filter("only = w").select("t", "only")
    by_session = keyed.filter("s is not null").join(roots.select(F.col("node").alias("s"), "root"), "s", "left").select("id", F.coalesce("root", "s").alias("g"))
    by_task = keyed.filter("s is null and t is not null").join(task_root, "t", "left").join(lone, "t", "left")
    by_task = by_task.join(roots.select(F.col("node").alias("only"), F.col("root").alias("lone_root")), "only", "left")
    by_task = by_task.select("id", F.coalesce("root", "lone_root", "only", "t").alias("g"))
    grouped = materialise(by_session.unionByName(by_task), "grouped")
    size = grouped.groupBy("g").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return grouped.join(size, "g").select("id", "group_id")


def assign_splits(records: DataFrame, id_col: str, shares: dict[str, float]) -> DataFrame:
    """(id, group_id, split): every record with its group and a split, all records of a group in the same one.

    Greedy, largest group first, each to the split furthest below its target; ties go to the earlier split, and
    groups of equal size are taken by group_id. Groups of one size form one batch: only the numbers of groups
    per size (at most sqrt(2 n) rows, and 100,000 of them for five billion records) reach the driver, which
    hands each split its ranks within the size. An empty input gives an empty result; null ids are dropped.
    """
    rows = records.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    groups = linked_groups(records, id_col).distinct()
    whole = materialise(rows.join(groups, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id")), "groups")
    sizes = materialise(whole.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")), "sizes")
    counts = sorted(((r["size"], r["k"]) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total = sum(s * k for s, k in counts)
    names, short = list(shares), [total * x for x in shares.values()]
    plan = []  # (size, first rank, last rank, split)
    for s, k in counts:
        at = 0
        for i, x in enumerate(greedy_counts(short, s, k)):
            if x:
                plan.append((s, at + 1, at + x, names[i]))
                short[i] -= s * x
                at += x
    todo = records.sparkSession.createDataFrame(plan, "size bigint, lo bigint, hi bigint, split string")
    chosen = _ranked(sizes, max(1, sum(k for _, k in counts) // RANK_ROWS)).join(todo, "size").filter("rank between lo and hi").select("group_id", "split")
    return whole.join(chosen, "group_id").select("id", "group_id", "split")


def greedy_counts(short: list[float], size: int, k: int) -> list[int]:
    """How many of k equal groups each split gets when every group goes to the split furthest below its target."""
    lo, hi = min(short) - size * (k + 1), max(short)
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(max(0, math.ceil((x - mid) / size)) for x in short) <= k else (mid, hi)
    got = [max(0, math.ceil((x - hi) / size)) for x in short]
    while sum(got) < k:
        best = max(range(len(short)), key=lambda i: short[i] - size * got[i])
        got[best] += 1
    return got


def _ranked(sizes: DataFrame, buckets: int) -> DataFrame:
    """Adds each group's rank within its size: the rank in a hashed bucket after the groups of earlier buckets."""
    b = sizes.withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets)))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = b.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("k")).withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    inner = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("group_id"))
    return b.withColumn("inner", inner).join(offset, ["size", "bucket"]).select("group_id", "size", (F.col("inner") + F.col("before")).alias("rank"))
