"""Whole texts to token ids of a public byte-level BPE vocabulary.

First pass: the words (pieces of the vocabulary's split pattern) of the whole corpus are counted; the most
frequent ones are encoded and compiled into a transducer, which Spark ships to each executor as a file that the
workers memory-map. Second pass: each task sends every word it has not met yet through the transducer, all of a
batch at once; words outside the lexicon are merged exactly by the vocabulary's merges. The lexicon only saves
time, the ids do not depend on it.

A null or empty text gives an empty list. Special tokens are never made; their strings are ordinary text.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.transducer import Lexicon, compile_lexicon
from tracelode.session import materialise, write_shared

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of the lexicon: it takes about 3 MB, whatever the corpus.
LEXICON_WORDS = 65_536
#: Code points that a numpy step takes at a time.
STEP_CHARS = 1_000_000


def vocabulary(folder: str, name: str) -> tiktoken.Encoding:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about STEP_CHARS code points; a longer text is a slice of its own."""
    for b in batches:
        size = np.cumsum([len(x) if x else 0 for x in b.column(column).to_pylist()])
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + STEP_CHARS)))
            yield b.slice(at, to - at)
            at = to


def frequent_words(documents: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words over all texts, by classes of a quarter octave: as many whole classes as hold at
    most ``most`` words. Only a histogram of the classes (a few hundred rows) and these words reach the driver.

    Whole texts are counted, cut at blanks; a different piece between blanks is split into words once, with its count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, pieces = regex.compile(PATTERN).findall, Counter()

        def out() -> pa.RecordBatch:
            seen: dict[str, int] = {}
            for piece, n in pieces.items():
                for w in find(" " + piece):
                    seen[w] = seen.get(w, 0) + n
            return pa.record_batch({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    pieces.update(t.split(" "))
                    if len(pieces) > 200_000:
                        yield out()
                        pieces.clear()
        if pieces:
            yield out()

    words = documents.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    classed = materialise(words.select("word", F.floor(4 * F.log2("n")).alias("class")), "words")
    least, room = None, most
    for r in sorted(classed.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["class"]
    return [] if least is None else [r["word"] for r in classed.filter(F.col("class") >= least).select("word").collect()]


def ship_lexicon(documents: DataFrame, folder: str, name: str) -> str:
    """Compiles the lexicon of the corpus and gives it to all executors; returns the file's name there."""
    spark, enc = documents.sparkSession, vocabulary(folder, name)
    image = compile_lexicon({w.encode(): enc._encode_single_piece(w) for w in frequent_words(documents)})
    file = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    spark.sparkContext.addFile(write_shared(spark, file, image))
    return file


class Encoder:
    """Encodes batches of texts; keeps the ids of the words it has met, up to a bound."""

    MOST_WORDS = 300_000

    def __init__(self, lexicon: str, folder: str, name: str) -> None:
        self.lexicon, self.merges, self.find = Lexicon(lexicon), vocabulary(folder, name), regex.compile(PATTERN).findall
        self.reset()

    def reset(self) -> None:
        encoder = self

        class Codes(dict):
            def __missing__(self, word: str) -> int:
                self[word] = code = len(self)
                encoder.new.append(word)
                return code

        self.codes, self.new = Codes(), []
        self.lens, self.starts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def learn(self) -> None:
        """Looks up the words met for the first time: in the transducer, else by the merges."""
        raw = [w.encode() for w in self.new]
        place = self.lexicon.find(raw)
        out = [self.lexicon.output(p) if p >= 0 else self.merges._encode_single_piece(w) for p, w in zip(place.tolist(), raw)]
        lens = np.fromiter(map(len, out), np.int64, len(out))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lens) - lens))
        self.lens = np.concatenate((self.lens, lens))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(out), np.int32)))
        self.new = []

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(code of each word, words of each text)."""
        if len(self.codes) > self.MOST_WORDS:
            self.reset()
        found = [self.find(t) if t else [] for t in texts]
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(found)), np.int64)
        if self.new:
            self.learn()
        return codes, np.fromiter(map(len, found), np.int64, len(found))

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        codes, per = self.words(texts)
        total = np.concatenate(([0], np.cumsum(self.lens[codes])))
        ends = np.cumsum(per)
        return total[ends] - total[ends - per]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        codes, per = self.words(texts)
        lens = self.lens[codes]
        total = np.concatenate(([0], np.cumsum(lens)))
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.starts[codes] - total[:-1], lens)]
        ends = np.concatenate(([0], np.cumsum(per)))
        return pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(flat, pa.int32()))


def encode_documents(documents: DataFrame, id_col: str, text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id_col, ids): every row's text as token ids; null and empty texts give an empty list."""
    rows = documents.select(F.col(id_col), F.col(text_col).alias("text"))
    file = ship_lexicon(rows, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(SparkFiles.get(file), folder, name)
        for b in text_steps(batches):
            yield pa.record_batch([b.column(0), enc.encode(b.column("text").to_pylist())], names=[id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(documents: DataFrame, text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """The rows without their text, with ``n_tokens``."""
    rest = [c for c in documents.columns if c != text_col]
    rows = documents.select(*rest, F.col(text_col).alias("text"))
    file = ship_lexicon(rows, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(SparkFiles.get(file), folder, name)
        for b in text_steps(batches):
            n = pa.array(enc.lengths(b.column("text").to_pylist()), pa.int64())
            yield pa.record_batch([*(b.column(c) for c in rest), n], names=[*rest, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema)
    return rows.mapInArrow(run, f"{schema}, n_tokens bigint")
