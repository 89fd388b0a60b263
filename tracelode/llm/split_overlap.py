"""Records of evaluation splits that also occur, exactly or almost, in the training split: a segment join.

The strings compared are the records' canonical strings (module ``shingles``), on which the insert/delete distance
is |A| + |B| - 2 |A & B|; a Jaccard similarity t is thus exactly a distance bound k for a pair's lengths. On the
raw text no edit distance would do, for moved sentences cost more edits than t allows.

Segments. An evaluation string that loses at most k of its symbols to a partner keeps one of any k + 1 disjoint
segments whole. The cut is uneven: single symbols at the rare end, and the frequent rest as the last segment, of
which the first symbol alone is looked up. COMMON - 1 more segments are cut, so that COMMON of them must match,
which keeps chance matches out. Segments of equal lengths would be two or three symbols long; a training string has
230 substrings of these lengths on average in the test tables, against 44 symbols that the uneven cut looks up.

Matching. ``segment_matches`` matches each segment with the training symbols of its content, at allowed positions
only: what lies before and behind a match in both strings adds to the distance.

Verification. ``banded_common`` is the dynamic programme of the longest common subsequence, kept to the band of
|i - j| <= k around the diagonal and run for a batch of pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.candidates import COMMON, ROWS, fitting, frequent_class, head_pairs
from tracelode.llm.near_duplicates import FILTER_BITS, membership, node_filter, with_node, with_strings
from tracelode.llm.shingles import frequency_table, head_symbols, strings_of
from tracelode.session import materialise

#: Cells of the batched programme's band that are held at a time.
BAND_CELLS = 2_000_000


def banded_common(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, band: int) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of a and b, along paths with |i - j| <= band.

    a, b: one string a row, padded; la, lb: their lengths. Where the true distance is at most band, no best path
    leaves the band and the result is exact; elsewhere it is a lower bound.
    """
    m, width = len(a), 2 * band + 1
    pad_b = np.full((m, max(a.shape[1], b.shape[1]) + width), -2, np.int64)
    pad_b[:, band : band + b.shape[1]] = b
    pad_b[:, band : band + b.shape[1]][np.arange(b.shape[1]) >= lb[:, None]] = -2
    best = np.zeros((m, width + 1), np.int32)  # cell d of row i: prefixes of i and i + d - band symbols
    for i in range(a.shape[1]):
        hit = (pad_b[:, i : i + width] == a[:, i : i + 1]) & (i < la)[:, None]
        step = np.maximum(best[:, :width] + hit, best[:, 1:])  # diagonal; from above
        best[:, :width] = np.maximum.accumulate(step, axis=1)  # from the left
    return best[:, :width].max(axis=1).astype(np.int64)


def verify_pairs(threshold: float):
    """mapInArrow function: keeps the pairs whose strings are similar enough, by the banded programme."""

    def padded(x: pa.ListArray, at: np.ndarray, lens: np.ndarray, width: int) -> np.ndarray:
        values, offsets = x.values.to_numpy(), x.offsets.to_numpy()
        out = np.full((len(at), width), -1, np.int64)
        inside = np.arange(width) < lens[:, None]
        out[inside] = values[(offsets[at][:, None] + np.arange(width))[inside]]
        return out

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = x.column("ids_a"), x.column("ids_b")
            la, lb = np.diff(a.offsets.to_numpy()), np.diff(b.offsets.to_numpy())
            need = np.ceil(threshold / (1 + threshold) * (la + lb) - 1e-9).astype(np.int64)
            k = la + lb - 2 * need  # the distance bound of each pair
            common = np.zeros(len(a), np.int64)
            order, i = np.argsort(la + lb, kind="stable"), 0
            while i < len(order):
                step = max(1, int(BAND_CELLS // (2 * k[order[i]] + 2 + la[order[i]] + lb[order[i]])))
                at = order[i : i + step]
                wa, wb, band = int(la[at].max()), int(lb[at].max()), int(max(k[at].max(), 0))
                common[at] = banded_common(padded(a, at, la[at], wa), la[at], padded(b, at, lb[at], wb), lb[at], band)
                i += step
            sim = common / np.maximum(la + lb - common, 1)
            out = pa.record_batch({"node_a": x.column("node_a"), "node_b": x.column("node_b"), "similarity": pa.array(sim)})
            yield out.filter(pa.array((sim >= threshold - 1e-12) & (common > 0)))

    return verify


def segment_matches(rows: dict[str, np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of an evaluation string that has a segment and a training string that has it at an allowed position.

    rows: segments of evaluation strings (side 1) and symbols of training strings (side 0), sorted by content. Each
    segment is matched with the run of training symbols of its content, and with no other evaluation string.
    """
    order = np.lexsort((rows["side"], rows["key"]))
    rows = {c: x[order] for c, x in rows.items()}
    key, node, n, side = (rows[c] for c in ("key", "node", "n", "side"))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    of = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
    training = np.add.reduceat(1 - side.astype(np.int64), first)
    segment = np.flatnonzero(side == 1)
    segment = segment[training[of[segment]] > 0]
    at = 0
    while at < len(segment):
        size = np.cumsum(training[of[segment[at : at + ROWS]]])
        some = segment[at : at + max(1, int(np.searchsorted(size, 4 * ROWS)))]
        k = training[of[some]]
        i = np.repeat(some, k)
        j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[of[some]], k)
        fits = fitting(rows, i, j, threshold) & (node[i] != node[j])
        i, j = i[fits], j[fits]
        if len(i):
            yield pa.record_batch({"node_a": node[i], "node_b": node[j], "n_a": n[i].astype(np.int32), "n_b": n[j].astype(np.int32)})
        at += len(some)


def split_overlap_nodes(records: DataFrame, threshold: float, width: int = 3) -> DataFrame:
    """(node_a, node_b, similarity): all pairs of an evaluation text (a) and a different training text (b).

    records: ``node``, ``text`` and ``side`` (1 evaluation, 0 training, others already left out).
    """
    table = frequency_table(records, width)
    found = records.sparkSession.sparkContext.accumulator(0)
    segments = head_symbols(records.select("node", "side", "text"), width, threshold, table, COMMON - 1, frequent_class(), found)
    pairs = head_pairs(segments, threshold, found, segment_matches, two_sided=True)
    nodes = pairs.select(F.col("node_a").alias("node")).union(pairs.select("node_b"))
    strings = strings_of(records, width, table, node_filter(nodes), FILTER_BITS)
    joined = with_strings(pairs, strings).select("node_a", "node_b", "ids_a", "ids_b")
    return joined.mapInArrow(verify_pairs(threshold), "node_a bigint, node_b bigint, similarity double")


def split_overlaps(records: DataFrame, id_col: str, columns: list[str], threshold: float, split_col: str = "split", train: str = "train", evaluation: tuple[str, ...] = ("val", "holdout"), width: int = 3) -> DataFrame:
    """(eval_id, train_id, similarity) of every evaluation record and training record with similarity >= threshold.

    Splits are compared without case and outer blanks; a null or other split is neither. Null texts are empty;
    records of fewer than ``width`` words, or with a null id, overlap with nothing; equal texts have similarity 1.
    """
    split = F.lower(F.trim(split_col))
    sided = with_node(records, *columns).withColumn("side", F.when(split == train, 0).when(split.isin(*evaluation), 1))
    sided = sided.filter("side is not null").select(F.col(id_col), "node", "text", "side")
    links = materialise(split_overlap_nodes(sided, threshold, width), "overlaps")
    members = materialise(membership(sided, id_col, width, "side"), "members")
    a = members.filter("side = 1").select(F.col("node").alias("node_a"), F.col("id").alias("eval_id"))
    b = members.filter("side = 0").select(F.col("node").alias("node_b"), F.col("id").alias("train_id"))
    across = links.join(a, "node_a").join(b, "node_b").select("eval_id", "train_id", "similarity")
    same = a.join(b.withColumnRenamed("node_b", "node_a"), "node_a").select("eval_id", "train_id", F.lit(1.0).alias("similarity"))
    return across.unionByName(same)


def overlap_report(records: DataFrame, id_col: str, columns: list[str], threshold: float) -> DataFrame:
    """Per split and source of the evaluation records: how many there are, how many occur in training, and how.

    (split, source, records, overlapping, exact); blank or null sources come as ''.
    """
    hits = split_overlaps(records, id_col, columns, threshold).groupBy(F.col("eval_id").alias(id_col)).agg(F.max("similarity").alias("most"))
    split, source = F.lower(F.trim("split")), F.lower(F.trim(F.coalesce("source", F.lit(""))))
    held = records.select(id_col, split.alias("split"), source.alias("source")).filter(F.col("split").isin("val", "holdout"))
    flags = (F.count(F.lit(1)).alias("records"), F.count("most").alias("overlapping"), F.count(F.when(F.col("most") >= 1, 1)).alias("exact"))
    return held.join(hits, id_col, "left").groupBy("split", "source").agg(*flags)
