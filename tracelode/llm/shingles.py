"""Word shingles of records as sets of 64-bit ids, in one fixed global order, made in numpy batches.

A record's *canonical string* is its set of shingle ids sorted by corpus frequency class, then hash. Two canonical
strings hold each symbol once and in the same order, so their longest common subsequence is the set
intersection and their insert/delete distance is the symmetric difference. A Jaccard bound t is therefore
exactly a bound on that distance: sim >= t  <=>  common >= t / (1 + t) * (n_a + n_b).

Symbols keep 47 hash bits, so two records of n shingles each count a wrong common one with a probability of
about n * n / 2**47.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Accumulator, Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: ASCII bytes to lower-case letters and digits, anything else to blanks.
ASCII = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))
#: Buckets of the frequency table: it is a fixed 4 MB of one byte each, whatever the corpus.
TABLE_BITS = 22
BLOCK = 1 << 14
#: Shingles that are counted at a time.
COUNTED = 4_000_000
#: Nodes that a task remembers so as to handle copies of a text once.
SEEN = 500_000
#: Rows that a numpy step takes at a time (10 bits of a sort key); bounds memory, has no effect on results.
STEP = 1000
#: A symbol is a frequency class (7 bits, quarter octaves) before 47 bits of the shingle's hash.
HASH_BITS = 47

_M1, _M2, _K1, _K2 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed invertible scrambling of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word (str or its UTF-8 bytes) -> 64-bit id, remembered up to a bound."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list:
    """Maximal runs of letters and digits after NFKC and lower-casing (as bytes where the text is ASCII)."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(ASCII).split()
    return WORD.findall(unicodedata.normalize("NFKC", text).lower())


def shingle_batch(texts: list[str | None], width: int, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row of each shingle, its 64-bit hash) in text order, repeated ones included."""
    found = [words_of(t) for t in texts]
    flat = np.fromiter(map(words.__getitem__, chain.from_iterable(found)), np.uint64)
    lens = np.fromiter(map(len, found), np.int64, len(found))
    if len(flat) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(found)), lens)
    last = len(flat) - width + 1
    h = np.zeros(last, np.uint64)
    for k in range(width):
        h = mix(h * _K1 + flat[k : k + last] + _K2)
    inside = row[:last] == row[width - 1 :]
    return row[:last][inside], h[inside]


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, STEP):
            yield b.slice(i, STEP)


def frequency_table(records: DataFrame, width: int) -> Broadcast:
    """Frequency classes of all records' shingles in 2**TABLE_BITS hashed buckets, counted over the whole input.

    records: a column ``text``. Each task sends its blocks of 16,384 counts packed (about a bit per bucket where
    counts are small), which are added up block by block; the driver holds one table of 4 MB, which is broadcast.
    The table only orders the symbols; any table gives the same results.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, held, n = Words(), np.zeros(1 << TABLE_BITS, np.int32), [], 0
        for b in steps(batches):
            _, h = shingle_batch(b.column("text").to_pylist(), width, words)
            held.append((h >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
            n += len(h)
            if n > COUNTED:
                total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
        part = total.reshape(-1, BLOCK)
        for i in range(0, len(part), 16):  # a few blocks at a time
            at = [k for k in range(i, min(i + 16, len(part))) if part[k].any()]
            if at:
                yield pa.record_batch({"block": pa.array(at, pa.int32()), "counts": pa.array([zlib.compress(part[k].tobytes(), 1) for k in at], pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for b in batches:
            for x in b.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.int32)
        cls = np.minimum(4 * np.log2(total + 1), 127).astype(np.uint8)
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "classes": pa.array([cls.tobytes()], pa.binary())})

    parts = records.select("text").mapInArrow(count, "block int, counts binary")
    table = np.zeros(((1 << TABLE_BITS) // BLOCK, BLOCK), np.uint8)
    for r in parts.groupBy("block").applyInArrow(add, "block int, classes binary").toLocalIterator():
        table[r["block"]] = np.frombuffer(r["classes"], np.uint8)
    return records.sparkSession.sparkContext.broadcast(table.ravel())


def canonical(row: np.ndarray, h: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every record's canonical string: (row, symbol, place in the string, the string's length), rare symbols first."""
    cls = table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.uint64)
    key = np.sort((row.astype(np.uint64) << np.uint64(54)) | (cls << np.uint64(HASH_BITS)) | (h & np.uint64((1 << HASH_BITS) - 1)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    row = (key >> np.uint64(54)).astype(np.int64)
    n = np.bincount(row) if len(row) else np.empty(0, np.int64)
    start = np.concatenate(([0], np.cumsum(n)))[:-1] if len(row) else n
    return row, (key & np.uint64((1 << 54) - 1)).astype(np.int64), np.arange(len(row)) - start[row], n[row]


def head_length(n: np.ndarray, threshold: float) -> np.ndarray:
    """Symbols of an n-symbol string of which any partner with sim >= threshold must hold one: n - ceil(t n) + 1."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def unseen(seen: set, *columns: np.ndarray) -> np.ndarray:
    """Mask of the rows whose values the task has not met yet."""
    mask = np.zeros(len(columns[0]), bool)
    for i, k in enumerate(zip(*(c.tolist() for c in columns))):
        if k not in seen:
            seen.add(k)
            mask[i] = True
    if len(seen) > SEEN:
        seen.clear()
    return mask


def head_symbols(records: DataFrame, width: int, threshold: float, table: Broadcast, extra: int, frequent: int, found: Accumulator) -> DataFrame:
    """(key, node, n, pos[, side]): the rare head of every record's canonical string, a node once per task.

    records: ``node`` (bigint), ``text`` and perhaps ``side`` (int). extra: symbols beyond head_length(), for
    more than one in common. found: counts the symbols of class ``frequent`` or above.
    """
    more = [c for c in records.columns if c == "side"]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes, seen = Words(), table.value, set()
        for b in steps(batches):
            b = b.filter(pa.array(unseen(seen, *(b.column(c).to_numpy() for c in ("node", *more)))))
            row, symbol, pos, n = canonical(*shingle_batch(b.column("text").to_pylist(), width, words), classes)
            keep = pos < head_length(n, threshold) + extra
            row, symbol, pos, n = row[keep], symbol[keep], pos[keep], n[keep]
            if (symbol >> HASH_BITS >= frequent).any():
                found.add(1)
            given = {c: b.column(c).to_numpy()[row] for c in more}
            yield pa.record_batch({"key": symbol, "node": b.column("node").to_numpy()[row], "n": n, "pos": pos} | given)

    schema = "key bigint, node bigint, n bigint, pos bigint" + "".join(f", {c} int" for c in more)
    return records.select("node", "text", *more).mapInArrow(heads, schema)


def strings_of(records: DataFrame, width: int, table: Broadcast, bits: Broadcast, filter_bits: int) -> DataFrame:
    """(node, ids): the canonical strings of the records whose node passes the filter, a node once per task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes, passing, seen = Words(), table.value, bits.value, set()
        for b in steps(batches):
            node = b.column("node").to_numpy()
            at = np.mod(node, 1 << filter_bits)
            b = b.filter(pa.array(((passing[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)))
            b = b.filter(pa.array(unseen(seen, b.column("node").to_numpy())))
            row, symbol, _, _ = canonical(*shingle_batch(b.column("text").to_pylist(), width, words), classes)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b.num_rows)))).astype(np.int32)
            yield pa.record_batch({"node": b.column("node"), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(symbol))})

    return records.select("node", "text").mapInArrow(whole, "node bigint, ids array<bigint>")


def record_text(*columns: str):
    """One text of several columns, null as empty."""
    return F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
