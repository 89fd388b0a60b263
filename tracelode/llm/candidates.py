"""Node pairs whose canonical strings can reach a Jaccard threshold, found in regions of shared rare symbols.

For sizes n_a and n_b a pair needs ``need = ceil(t / (1 + t) * (n_a + n_b))`` common symbols, so of the first
``n - need + c`` symbols of either string it shares at least c (c <= need). Each symbol spans a region of the
strings that hold it in their head; a pair meets in c regions, or it is no pair.

Regions above ``MAX_REGION`` members are not joined but divided again by a second shared symbol (``hot_pairs``): a
pair that shares only symbols of large regions shares several of them. Symbols that the frequency table knows to be
far above that size are kept apart before anything moves, so no task receives such a region.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm.shingles import HASH_BITS
from tracelode.session import materialise

#: A region of more members is divided by a further symbol instead of being joined.
MAX_REGION = 2000
#: Blocks in which a region is joined that two symbols leave large.
SALTS = 16
#: Symbols that the heads of a pair must share (fewer where the pair needs fewer).
COMMON = 4
#: Rows that a numpy step takes at a time.
ROWS = 200_000

PAIR = "node_a bigint, node_b bigint, n_a int, n_b int"


def frequent_class() -> int:
    """The frequency class from which on a symbol never goes to a region of its own."""
    return math.ceil(4 * math.log2(16 * MAX_REGION + 1))


def needed(threshold: float) -> Column:
    """Common symbols that a pair of sizes n_a and n_b needs."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-9))


def whole_regions(batches: Iterator[pa.RecordBatch], hot: Accumulator | None, most: int) -> Iterator[tuple[bool, dict[str, np.ndarray]]]:
    """(is hot, rows) of the rows sorted by key: chunks of whole regions of up to ``most``, or parts of a larger one."""
    held: list[dict[str, np.ndarray]] = []
    large = None  # key of the large region whose rows are passing
    n = 0

    def flush(last: bool) -> Iterator[tuple[bool, dict[str, np.ndarray]]]:
        nonlocal held, large, n
        if not held:
            return
        rows = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
        key = rows["key"]
        ends = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True]))) + 1
        sizes = np.diff(np.concatenate(([0], ends)))
        keep = len(ends) if last else len(ends) - 1
        begin = int(ends[keep - 1]) if keep else 0
        big = sizes > most
        if large is not None:
            big |= key[ends - 1] == large
        if not last and big[-1]:  # it goes on, but is known to be large
            large, keep, begin = key[-1], len(ends), len(key)
        elif not last or keep:
            large = None if large is not None and key[-1] != large else large
        if hot is not None and big[:keep].any():
            hot.add(1)
        of = np.repeat(big, sizes)[:begin]
        for is_hot in (False, True):
            at = np.flatnonzero(of == is_hot)
            if len(at):
                yield is_hot, {c: x[at] for c, x in rows.items()}
        held, n = ([{c: x[begin:] for c, x in rows.items()}] if begin < len(key) else []), len(key) - begin

    for b in batches:
        held.append({c: b.column(c).to_numpy() for c in b.schema.names})
        n += b.num_rows
        if n >= ROWS:
            yield from flush(False)
    yield from flush(True)


def fitting(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Mask of the row pairs (i, j) of one symbol that the threshold allows: by size, by position within the heads that
    this very pair has to share, and by what lies before and behind the match in both strings."""
    n, pos = rows["n"], rows["pos"]
    need = np.ceil(threshold / (1 + threshold) * (n[i] + n[j]) - 1e-9).astype(np.int64)
    slack = np.minimum(COMMON, need) - need
    apart = np.abs(pos[i] - pos[j]) + np.abs(n[i] - pos[i] - n[j] + pos[j])
    return (pos[i] < n[i] + slack) & (pos[j] < n[j] + slack) & (apart <= n[i] + n[j] - 2 * need) & (need <= np.minimum(n[i], n[j]))


def meetings(rows: dict[str, np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    """Fitting pairs of different nodes of each region."""
    key, node, n = (rows[c] for c in ("key", "node", "n"))
    at, lag = np.arange(len(key)), 0
    while len(at):
        lag += 1
        at = at[at < len(key) - lag]
        at = at[key[at] == key[at + lag]]
        i, j = at, at + lag
        fits = fitting(rows, i, j, threshold) & (node[i] != node[j])
        i, j = i[fits], j[fits]
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        if len(i):
            yield pa.record_batch({"node_a": node[i], "node_b": node[j], "n_a": n[i].astype(np.int32), "n_b": n[j].astype(np.int32)})


def by_region(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def head_pairs(rows: DataFrame, threshold: float, found: Accumulator, meet: Callable = meetings, two_sided: bool = False) -> DataFrame:
    """(node_a, node_b): a superset, exact in recall, of the pairs with Jaccard similarity >= threshold.

    rows: (key, node, n, pos[, side]) of head_symbols(extra=COMMON - 1); a node may come several times. found: the
    accumulator of frequent symbols given to head_symbols. meet: gives the pairs of whole regions. two_sided: only
    pairs of a node of side 1 (a) with one of side 0 (b). Pairs of a node with itself are left out.
    """
    hot, most = rows.sparkSession.sparkContext.accumulator(0), MAX_REGION

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for is_hot, part in whole_regions(batches, hot, most):
            if not is_hot:
                yield from meet(part, threshold)

    frequent = F.shiftrightunsigned("key", HASH_BITS) >= frequent_class()
    met = by_region(rows.filter(~frequent)).mapInArrow(join, PAIR)
    counted = met.groupBy("node_a", "node_b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.count(F.lit(1)).alias("common"))
    pairs = materialise(counted.filter(F.col("common") >= F.least(F.lit(COMMON), needed(threshold))).select("node_a", "node_b"), "pairs")
    if not hot.value and not found.value:
        return pairs
    # Symbols of large regions were not counted above, so that any pair that met counts.
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter((F.col("k") > most) | frequent).select("key")
    large = materialise(rows.join(materialise(keys, "hot"), "key").distinct(), "hot")
    met = met.unionByName(hot_pairs(large, threshold, two_sided))
    return materialise(met.select("node_a", "node_b").distinct(), "pairs")


def hot_pairs(hot: DataFrame, threshold: float, two_sided: bool) -> DataFrame:
    """Pairs within large regions, which are divided by a second symbol that their members share.

    A region of two symbols that is still large is joined in SALTS blocks of its members, so no task holds it whole;
    its members share most of their rare symbols, and most of its pairs are near the threshold. Pairs that need one
    common symbol only (their strings are that symbol) are joined by it.
    """
    by = ["node", *(["side"] if two_sided else [])]

    def join(rows: DataFrame, on: list[str]) -> DataFrame:
        a, b = (rows.select(*on, *(F.col(c).alias(f"{c}_{x}") for c in ("n", "pos", *by))) for x in "ab")
        if "salt" in on:
            b = b.drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        other = (F.col("side_a") == 1) & (F.col("side_b") == 0) & (F.col("node_a") != F.col("node_b")) if two_sided else F.col("node_a") < F.col("node_b")
        slack = F.least(F.lit(COMMON), needed(threshold)) - needed(threshold)
        fits = (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9) & (F.col("pos_a") < F.col("n_a") + slack) & (F.col("pos_b") < F.col("n_b") + slack)
        return a.join(b, on).filter(other & fits).select("node_a", "node_b", F.col("n_a").cast("int"), F.col("n_b").cast("int"))

    def sized(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key")

    region = sized(hot)
    large = region.filter(F.col("size") > MAX_REGION)
    single = large.filter("n = 1").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    found = join(region.filter(F.col("size") <= MAX_REGION), ["key"]).unionByName(join(single, ["key", "salt"]))
    more = hot.select(*by, F.col("key").alias("key2"), F.col("pos").alias("pos2"))
    deeper = large.drop("size").join(more, by).filter(F.col("pos2") > F.col("pos"))
    region = sized(materialise(deeper.select(F.xxhash64("key", "key2").alias("key"), *by, "n", F.col("pos2").alias("pos")), "region"))
    salted = region.filter(F.col("size") > MAX_REGION).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return found.unionByName(join(region.filter(F.col("size") <= MAX_REGION), ["key"])).unionByName(join(salted, ["key", "salt"]))
