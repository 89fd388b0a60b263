"""Long exact spans shared between records, by level-wise doubling of repeated windows.

Windows of w code points are repeated if they stand in two different texts. A span of at least ``span`` code
points holds only repeated windows, so a level keeps the places around its repeated windows and the next level,
at twice the length, looks at those places alone: span/4, span/2, and span, where every window that is left is
looked at. Beyond it (``doubled_lengths``) windows are doubled on until none is left.

Below the last level not every window is compared: of every ``span - w + 1`` successive windows the one of the
smallest hash is chosen. That many windows lie in any span, whichever text it stands in, so equal spans choose
equal windows and none is lost.

Equal texts are one node: (hash of the text, its length). Window hashes are 64 bits; a wrong pair would need
two of the compared windows to collide, about m * m / 2**65 for m windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.encode import text_steps
from tracelode.llm.shingles import mix
from tracelode.session import materialise

#: An odd factor for the rolling hash, and its inverse modulo 2**64.
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
#: Of a run of equal neighbouring minima (long runs of one character) every so many are kept, and both ends; fewer
#: than half a stretch, so that each stretch still holds one.
THIN = 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of all windows of a text, of any length, from one pass over its code points."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_B, 1 << 16), _powers(_B_INV, 1 << 16)

    def load(self, code: np.ndarray) -> None:
        if len(code) >= len(self.up):
            n = 1 << int(len(code)).bit_length()
            self.up, self.down = _powers(_B, n), _powers(_B_INV, n)
        term = mix(code.astype(np.uint64) + np.uint64(1)) * self.up[: len(code)]
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))

    def windows(self, w: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Hashes of the windows of w code points that start at lo, ..., hi - 1."""
        hi = max(lo, min(len(self.total) - w, hi if hi is not None else len(self.total)))
        raw = (self.total[lo + w : hi + w] - self.total[lo:hi]) * self.down[lo:hi]
        return mix(raw ^ np.uint64(w))


def chosen(h: np.ndarray, every: int) -> np.ndarray:
    """Places such that of every ``every`` successive ones a place with their smallest value is chosen."""
    n = len(h)
    if n < every:
        return np.empty(0, np.int64)
    if every == 1:
        return np.arange(n)
    blocks = -(-n // every)
    padded = np.full(blocks * every, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = h
    grid = padded.reshape(blocks, every)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(back[: n - every + 1], ahead[every - 1 : n])  # minimum of h[i : i + every]
    # a place is chosen if it equals the minimum of a stretch that holds it: the largest of those minima
    m = len(low)
    wide = np.zeros(-(-(m + 2 * (every - 1)) // every) * every, np.uint64)
    wide[every - 1 : every - 1 + m] = low
    grid = wide.reshape(-1, every)
    ahead = np.maximum.accumulate(grid, axis=1).ravel()
    back = np.maximum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    high = np.maximum(back[:n], ahead[every - 1 : every - 1 + n])
    at = np.flatnonzero(h == high)
    if len(at) > 2:
        same = (h[at[1:]] == h[at[:-1]]) & (np.diff(at) == 1)
        inner = np.concatenate(([False], same)) & np.concatenate((same, [False]))
        at = at[~inner | (at % max(1, min(THIN, every // 2)) == 0)]
    return at


def _first_level(texts: DataFrame, w: int, span: int) -> DataFrame:
    """(hash, node, len, pos) of the chosen windows of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = Hashes(), set()
        for b in text_steps(batches):
            node, length, at, values = [], [], [], []
            for text, k in zip(b.column("text").to_pylist(), b.column("node").to_pylist()):
                if k in seen:  # a copy within this task
                    continue
                seen.add(k)
                hashes.load(np.frombuffer(text.encode("utf-32-le"), np.uint32))
                h = hashes.windows(w)
                p = chosen(h, span - w + 1)
                node.append(np.full(len(p), k, np.int64))
                length.append(np.full(len(p), len(text), np.int32))
                at.append(p)
                values.append(h[p])
            if len(seen) > 500_000:
                seen.clear()
            if node:
                yield pa.record_batch({
                    "hash": pa.array(np.concatenate(values).view(np.int64)), "node": pa.array(np.concatenate(node)),
                    "len": pa.array(np.concatenate(length)), "pos": pa.array(np.concatenate(at).astype(np.int32)),
                })

    return texts.mapInArrow(run, "hash bigint, node bigint, len int, pos int")


def _repeated(windows: DataFrame) -> DataFrame:
    """Windows whose hash stands in two different nodes.

    windows: materialised. The least and greatest node per hash are partial aggregates, so a window that a large part
    of all texts holds moves as a few rows per task; the semi-join that follows is split by AQE where it is skewed.
    """
    met = windows.groupBy("hash").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("hash")
    return windows.join(met, "hash", "left_semi")


def _regions(windows: DataFrame) -> DataFrame:
    """(node, len, regions): where a span around the repeated windows may lie, as the sorted starts of the windows.

    One row per node; a row's size is bounded by its text's.
    """
    return windows.groupBy("node", "len").agg(F.array_sort(F.collect_set("pos")).alias("at"))


def _next_level(texts: DataFrame, w_before: int, w: int, span: int) -> DataFrame:
    """(hash, node, len, pos) of the chosen windows of w code points that lie around the repeated shorter ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, every, reach = Hashes(), span - w + 1, span - w_before
        for b in text_steps(batches):
            out: list[tuple] = []
            starts = b.column("at")
            for i, (text, node) in enumerate(zip(b.column("text").to_pylist(), b.column("node").to_pylist())):
                at = starts[i].values.to_numpy()
                lo, hi = np.maximum(at - reach, 0), np.minimum(at + w_before + reach, len(text))
                hashes.load(np.frombuffer(text.encode("utf-32-le"), np.uint32))
                cut = np.concatenate(([0], np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1]) + 1, [len(at)]))
                for x, y in zip(cut[:-1], cut[1:]):
                    first, last = int(lo[x]), int(hi[x:y].max())
                    h = hashes.windows(w, first, last - w + 1)
                    p = chosen(h, every)
                    out.append((h[p], p + first, node, len(text)))
            if out:
                n = [len(x[0]) for x in out]
                yield pa.record_batch({
                    "hash": pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), "node": pa.array(np.repeat([x[2] for x in out], n).astype(np.int64)),
                    "len": pa.array(np.repeat([x[3] for x in out], n).astype(np.int32)), "pos": pa.array(np.concatenate([x[1] for x in out]).astype(np.int32)),
                })

    return texts.mapInArrow(run, "hash bigint, node bigint, len int, pos int")


def nodes_of(documents: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """(id, node, len, text) of the texts of at least ``span`` code points; null texts and ids are left out."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.filter(F.col("id").isNotNull() & (F.length("text") >= span)).select("id", F.xxhash64("text").alias("node"), F.length("text").alias("len"), "text")


def span_windows(nodes: DataFrame, span: int) -> DataFrame:
    """(hash, node, len, pos): every window of ``span`` code points that may stand in two different texts: those around
    the repeated windows of a quarter and a half of the length."""
    levels = [max(1, span // 4), max(1, span // 2), span]
    # the doubling's candidate texts are carried along, so that the corpus is read once more at most
    windows = materialise(_first_level(nodes, levels[0], span), "windows")
    found = materialise(_regions(_repeated(windows)), "regions")
    kept = materialise(found.join(nodes.select("node", "len", "text"), ["node", "len"]).dropDuplicates(["node", "len"]), "kept")
    windows = materialise(_next_level(kept, levels[0], levels[1], span), "windows")
    kept = kept.drop("at").join(_regions(_repeated(windows)), ["node", "len"])
    return materialise(_next_level(kept, levels[1], levels[2], span), "windows")


def longer_windows(spans: DataFrame, w: int) -> DataFrame:
    """The repeated windows of twice the length w of the given repeated ones: a window and the next one behind it,
    under one hash. No text is read again."""
    behind = spans.select("node", "len", (F.col("pos") - w).alias("pos"), F.col("hash").alias("behind"))
    twice = spans.join(behind, ["node", "len", "pos"]).select(F.xxhash64("hash", "behind").alias("hash"), "node", "len", "pos")
    return _repeated(materialise(twice, "windows"))


def doubled_lengths(documents: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """(id, at_least): for every record that shares a passage of ``span`` code points with a different text the greatest
    of span, 2 span, 4 span, ... at which it still does. Windows are doubled until none is left.

    Null, empty and shorter texts, and those whose long passages stand only in copies of them, give no row.
    """
    nodes = nodes_of(documents, id_col, text_col, span)
    spans, length, out = materialise(_repeated(span_windows(nodes, span)), "spans"), span, None
    while True:
        level = spans.select("node", "len").distinct().withColumn("at_least", F.lit(length))
        out = level if out is None else out.unionByName(level)
        spans = materialise(longer_windows(spans, length), "spans")
        length *= 2
        if spans.isEmpty():
            break
    most = out.groupBy("node", "len").agg(F.max("at_least").alias("at_least"))
    return nodes.select("id", "node", "len").join(most, ["node", "len"]).select("id", "at_least")


def span_node_pairs(windows: DataFrame) -> DataFrame:
    """Pairs of nodes (node_a, len_a, node_b, len_b) that share a window, each once.

    Successive windows of one passage stand in the same set of texts. The sets are told apart by an order-free
    fingerprint, summed up in one partial aggregation, and each is paired once. A set of one text has the fingerprint
    of its greatest node alone. Sums are of 31 bits, so that no number of texts overflows.
    """
    mark, also = F.pmod(F.xxhash64("node"), F.lit(1 << 31)), F.xxhash64("node", F.lit(1))
    sets = windows.groupBy("hash").agg(F.max("node").alias("hi"), F.sum(mark).alias("s"), F.bit_xor(also).alias("x"), F.count(F.lit(1)).alias("k"))
    top = F.pmod(F.xxhash64("hi"), F.lit(1 << 31))
    alone = (F.col("s") == F.col("k") * top) & (F.col("x") == F.when(F.col("k") % 2 == 1, F.xxhash64("hi", F.lit(1))).otherwise(0))
    once = sets.filter(~alone).groupBy("hi", "s", "x", "k").agg(F.min("hash").alias("hash")).select("hash")
    few = materialise(windows.join(once, "hash", "left_semi").select("hash", "node", "len").distinct(), "sets")
    a, b = (few.select("hash", F.col("node").alias(f"node_{x}"), F.col("len").alias(f"len_{x}")) for x in "ab")
    return a.join(b, "hash").filter("(node_a, len_a) < (node_b, len_b)").select("node_a", "len_a", "node_b", "len_b").distinct()


def shared_span_pairs(documents: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of records whose texts have a common passage of >= span code points.

    Exact; equal texts of that length are pairs too. Null, empty and shorter texts are in no pair.
    """
    nodes = nodes_of(documents, id_col, text_col, span)
    pairs = span_node_pairs(span_windows(nodes, span))
    members = nodes.select("id", "node", "len")
    a, b = (members.select(F.col("id").alias(f"x_{x}"), F.col("node").alias(f"node_{x}"), F.col("len").alias(f"len_{x}")) for x in "ab")
    across = pairs.join(a, ["node_a", "len_a"]).join(b, ["node_b", "len_b"]).select(F.least("x_a", "x_b").alias("id_a"), F.greatest("x_a", "x_b").alias("id_b"))
    twice = members.groupBy("node", "len").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    again = members.join(twice, ["node", "len"], "left_semi")
    within = again.select("node", "len", F.col("id").alias("id_a")).join(again.select("node", "len", F.col("id").alias("id_b")), ["node", "len"]).filter("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within)


def shared_extent(documents: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """(id, n_chars, shared_chars, shared_fraction) of every record.

    shared_chars counts the code points that lie in a passage of >= span code points found in another record
    too; a text that another record repeats whole is shared whole if it is long enough. Null texts have 0 of 0.
    """
    nodes = nodes_of(documents, id_col, text_col, span)
    spans = _repeated(span_windows(nodes, span))
    lo = Window.partitionBy("node", "len").orderBy("pos")
    gain = F.least(F.lit(span), F.col("pos") - F.coalesce(F.lag("pos").over(lo), F.lit(-span)))
    extent = spans.select("node", "len", "pos").distinct().withColumn("gain", gain).groupBy("node", "len").agg(F.sum("gain").alias("part"))
    copies = nodes.groupBy("node", "len").agg(F.count(F.lit(1)).alias("k"))
    shared = copies.join(extent, ["node", "len"], "left").select("node", "len", F.when(F.col("k") > 1, F.col("len")).otherwise(F.coalesce("part", F.lit(0))).alias("shared"))
    by_id = nodes.select("id", "node", "len").join(shared, ["node", "len"]).select("id", "shared")
    size = documents.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"))
    share = F.coalesce("shared", F.lit(0)).cast("bigint")
    out = size.join(by_id, "id", "left").select("id", "n_chars", share.alias("shared_chars"))
    return out.withColumn("shared_fraction", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)))
