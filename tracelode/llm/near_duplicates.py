"""Near-duplicate records with small edits: an exact Jaccard join in regions of shared rare shingles.

Not by record pivots. In the Jaccard metric unrelated records lie at distance 1 from each other and from any record
chosen as pivot, so a Voronoi region with its triangle-inequality window (twice the allowed distance, 0.7) takes in
nearly every record: with 32 pivots a record of the test tables lies in 31.2 of the 32 regions, and 97 % of the
records in all of them (tests/llm measure it). A recursion into such regions does not end.

What stands in for a pivot is a shingle: a record's regions are those of its rarest shingles, and the metric is the
symmetric difference D(A, B) = |A| + |B| - 2 |A & B|, in which a similarity t is the radius
r = (1 - t) / (1 + t) * (|A| + |B|). Every shingle that one record holds and the other lacks adds one to D, so a record
enters the regions of its next shingles only until more than r of them would be missed: the head of its canonical
string (module ``shingles``). The triangle inequality bounds sizes, | |A| - |B| | <= D(A, B), and, applied to what
lies before and behind a shared shingle, places. Regions that are still large are divided again (module
``candidates``), and each region is joined exactly.

Equal texts are one node. ``near_duplicate_nodes`` returns node pairs, ``membership`` the records of each node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.candidates import COMMON, frequent_class, head_pairs
from tracelode.llm.shingles import frequency_table, head_symbols, record_text, strings_of
from tracelode.session import materialise

#: Bits of the filter that spares the tokenizing of records without a partner; fixed at 1 MB.
FILTER_BITS = 23


def with_node(records: DataFrame, *columns: str) -> DataFrame:
    """Adds ``text`` (the columns, null as empty) and ``node``, a 64-bit hash of it."""
    text = record_text(*columns)
    return records.withColumn("text", text).withColumn("node", F.xxhash64("text"))


def node_filter(nodes: DataFrame):
    """A broadcast bit table of the nodes (1 MB): a node whose bit is unset is none of them."""
    width = 1 << (FILTER_BITS - 8)

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(width, bool)
        for b in batches:
            bits[b.column("bit").to_numpy()] = True
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    bit = nodes.select(F.pmod("node", F.lit(1 << FILTER_BITS)).alias("bit")).distinct()
    parts = bit.select(F.floor(F.col("bit") / width).cast("int").alias("block"), F.pmod("bit", F.lit(width)).cast("int").alias("bit"))
    table = np.zeros((256, width // 8), np.uint8)
    for r in parts.groupBy("block").applyInArrow(fill, "block int, bits binary").toLocalIterator():
        table[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return nodes.sparkSession.sparkContext.broadcast(table.ravel())


def common_counts(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Sizes of the pairwise set intersections of two list columns."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 512):
        parts = []
        for x in (a.slice(i, 512), b.slice(i, 512)):
            lens = np.diff(x.offsets.to_numpy())
            parts.append((np.repeat(np.arange(len(lens), dtype=np.uint64), lens) << np.uint64(54)) | x.flatten().to_numpy().view(np.uint64))
        both = np.sort(np.concatenate(parts))
        twice = both[1:][both[1:] == both[:-1]]
        out[i : i + 512] = np.bincount((twice >> np.uint64(54)).astype(np.int64), minlength=min(512, len(a) - i))
    return out


def with_strings(pairs: DataFrame, strings: DataFrame) -> DataFrame:
    """Pairs with both canonical strings (one exchange of the strings serves both joins)."""
    one = strings.dropDuplicates(["node"])
    a, b = (one.select(F.col("node").alias(f"node_{x}"), F.col("ids").alias(f"ids_{x}")) for x in "ab")
    return pairs.join(a.hint("shuffle_merge"), "node_a").join(b.hint("shuffle_merge"), "node_b")


def near_duplicate_nodes(records: DataFrame, threshold: float, width: int = 3) -> DataFrame:
    """(node_a, node_b, similarity) of all pairs of different texts with Jaccard similarity >= threshold.

    records: ``node`` and ``text`` (with_node). Exact. Texts of fewer than ``width`` words have no shingle and
    no partner; an empty input gives no pairs; a row without a partner is in no pair.
    """
    table = frequency_table(records, width)
    found = records.sparkSession.sparkContext.accumulator(0)
    heads = head_symbols(records.select("node", "text"), width, threshold, table, COMMON - 1, frequent_class(), found)
    pairs = head_pairs(heads, threshold, found)
    nodes = pairs.select(F.col("node_a").alias("node")).union(pairs.select("node_b"))
    strings = strings_of(records, width, table, node_filter(nodes), FILTER_BITS)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = x.column("ids_a"), x.column("ids_b")
            common = common_counts(a, b)
            total = np.diff(a.offsets.to_numpy()) + np.diff(b.offsets.to_numpy()) - common
            sim = common / np.maximum(total, 1)
            keep = sim >= threshold - 1e-12
            yield pa.record_batch({"node_a": x.column("node_a"), "node_b": x.column("node_b"), "similarity": pa.array(sim)}).filter(pa.array(keep))

    joined = with_strings(pairs, strings).select("node_a", "node_b", "ids_a", "ids_b")
    return joined.mapInArrow(verify, "node_a bigint, node_b bigint, similarity double")


def membership(records: DataFrame, id_col: str, width: int = 3, *more: str) -> DataFrame:
    """(node, id[, more]) of the records that have at least ``width`` words, i.e. a shingle at all."""
    word = r"[\p{L}\p{N}]+"
    return records.filter(F.col(id_col).isNotNull() & F.col("text").rlike(word + rf"(?:[^\p{{L}}\p{{N}}]+{word}){{{width - 1}}}")).select("node", F.col(id_col).alias("id"), *more)


def near_duplicate_pairs(records: DataFrame, id_col: str, columns: list[str], threshold: float, width: int = 3) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of records with similarity >= threshold, equal ones included.

    Nulls count as empty texts; records of fewer than ``width`` words, or with a null id, are in no pair.
    """
    nodes = with_node(records.select(id_col, *columns), *columns)
    links = near_duplicate_nodes(nodes, threshold, width)
    members = materialise(membership(nodes, id_col, width), "members")
    a, b = (members.select(F.col("node").alias(f"node_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    across = links.join(a, "node_a").join(b, "node_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    same = members.groupBy("node").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    again = members.join(same, "node", "left_semi")
    within = again.select("node", F.col("id").alias("id_a")).join(again.select("node", F.col("id").alias("id_b")), "node").filter("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within)


def near_duplicate_classes(records: DataFrame, id_col: str, columns: list[str], threshold: float, width: int = 3) -> DataFrame:
    """(id, class_id, n_links): every record with the smallest id of its near-duplicate class and its link count.

    Classes are connected components of the pairs. n_links counts linked records without listing the pairs.
    Records without a partner are their own class with 0 links; null ids are kept as they are.
    """
    from tracelode.llm.group_split import components

    nodes = with_node(records.select(id_col, *columns), *columns)
    links = materialise(near_duplicate_nodes(nodes, threshold, width).select("node_a", "node_b"), "links")
    has = materialise(membership(nodes, id_col, width), "members")
    size = has.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("first"))
    size = materialise(size, "classes")
    both = links.union(links.select("node_b", "node_a"))
    degree = both.join(size.select(F.col("node").alias("node_b"), "k"), "node_b").groupBy(F.col("node_a").alias("node")).agg(F.sum("k").alias("others"))
    comp = components(links.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")))
    of = size.join(comp.select("node", "root"), "node", "left").join(degree, "node", "left")
    of = of.withColumn("root", F.coalesce("root", "node"))
    first = of.groupBy("root").agg(F.min("first").alias("class_id"))
    of = of.join(first, "root").select("node", "class_id", (F.col("k") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    ids = nodes.select("node", F.col(id_col).alias("id"))
    short = ids.join(has.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return has.join(of, "node").select("id", "class_id", "n_links").unionByName(short)
