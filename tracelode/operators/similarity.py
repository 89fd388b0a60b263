"""Similarity of texts and vectors without a model: TF-IDF, overlap, Jaccard, cosine, diversity.

Texts become long tables of terms; similarities are equi-joins on (row, term), never pairs of all rows. A stated
query set is compared with all rows through an inverted index.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracelode.functions.text import STOPWORDS, word_set
from tracelode.session import materialise

#: Words of all queries up to which their index is broadcast (some 40 MB).
QUERY_WORDS = 2_000_000


def tokens(text: Column) -> Column:
    """Words of two letters or more in lower case without stopwords (ASCII letters and digits)."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda w: ~w.isin(STOPWORDS))


def grams(words: Column) -> Column:
    """The words and the pairs of successive words (words: a column, as it is used several times)."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.array_compact(pairs))


def term_counts(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf) in long form."""
    words = rows.select(F.col(id_col).alias("id"), tokens(F.coalesce(text, F.lit(""))).alias("words"))
    return words.select("id", F.explode(grams(F.col("words"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, documents: DataFrame, features: int = 5000) -> DataFrame:
    """(term, idf) of the ``features`` most frequent terms (ties by term), smoothed: ln((1 + n) / (1 + df)) + 1.

    Counts run over all documents; at most ``features`` rows remain.
    """
    n = documents.agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("term").agg(F.sum("tf").alias("freq"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("freq"), "term").limit(features)
    return df.join(n).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weights(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, term, w): sublinear tf-idf, normalised to length 1 per id."""
    w = counts.join(vocab, "term").select("id", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


_STOP, _WORD = frozenset(STOPWORDS), re.compile("[a-z0-9]{2,}")


def gram_list(text: str | None) -> list[str]:
    """``grams(tokens(text))`` of one text in Python, for numpy batches."""
    words = [w for w in _WORD.findall(text.lower()) if w not in _STOP] if text else []
    return words + [f"{x} {y}" for x, y in zip(words, words[1:])]


def fitted_terms(rows: DataFrame, column: str, features: int) -> list[tuple[str, float]]:
    """The ``features`` most frequent terms (ties by term) with their idf, counted over all rows.

    Tasks send partial counts of the terms they met. At most ``features`` rows reach the driver, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, df = Counter(), Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch({"term": pa.array(list(freq), pa.string()), "freq": pa.array(freq.values(), pa.int64()), "df": pa.array([df[t] for t in freq], pa.int64())})

        for b in batches:
            for text in b.column(0).to_pylist():
                terms = gram_list(text)
                freq.update(terms)
                df.update(set(terms))
            if len(freq) > 500_000:
                yield out()
                freq.clear()
                df.clear()
        if freq:
            yield out()

    parts = rows.select(column).mapInArrow(count, "term string, freq bigint, df bigint")
    top = parts.groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("df").alias("df")).orderBy(F.desc("freq"), "term").limit(features)
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return [(r["term"], r["idf"]) for r in top.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf")).collect()]


def term_weights(texts: list[str | None], place: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, weight) of a batch of texts, key = row * terms + term: sublinear tf-idf of length 1 per row."""
    lists = [[k for t in gram_list(x) if (k := place.get(t)) is not None] for x in texts]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    key, tf = np.unique(row * len(idf) + np.fromiter(chain.from_iterable(lists), np.int64, len(row)), return_counts=True)
    w = (1.0 + np.log(tf)) * idf[key % len(idf)]
    return key, w / np.sqrt(np.bincount(key // len(idf), w * w, len(lists)))[key // len(idf)]


def tfidf_pairs(rows: DataFrame, id_col: str, left: str, right: str, features: int = 5000) -> DataFrame:
    """(id, score): cosine of two text columns of the same row; the vocabulary is fitted on the right one.

    Rows without a common term are left out (their score is 0). Once the vocabulary (at most ``features`` terms) is
    known, a row needs nothing but itself: no terms move.
    """
    terms = fitted_terms(rows, right, features)
    place, idf = {t: i for i, (t, _) in enumerate(terms)}, np.array([x for _, x in terms])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if len(idf) else 0, 1000):
                b = whole.slice(at, 1000)
                a, v = (term_weights(b.column(c).to_pylist(), place, idf) for c in ("a", "b"))
                both, i, j = np.intersect1d(a[0], v[0], assume_unique=True, return_indices=True)
                total = np.bincount(both // len(idf), a[1][i] * v[1][j], b.num_rows)
                met = np.unique(both // len(idf))
                yield pa.record_batch([b.column("id").take(pa.array(met)), pa.array(total[met])], names=["id", "score"])

    texts = rows.select(F.col(id_col).alias("id"), F.col(left).alias("a"), F.col(right).alias("b"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(score, f"id {kind}, score double").select("id", F.round("score", 5).alias("score"))


def diversity(weighted: DataFrame) -> DataFrame:
    """1 - mean cosine over all ordered pairs of different rows, in closed form: (|sum v|^2 - sum |v|^2) / (n (n - 1)).

    Vectors have length 1, so sum |v|^2 is the number of rows; no pairs are formed.
    """
    n = weighted.agg(F.count_distinct("id").alias("n"))
    total = weighted.groupBy("term").agg(F.sum("w").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    return n.join(total).select("n", F.round(1.0 - F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1)), 5).alias("diversity"))


def keyword_overlap(expected: Column, given: Column) -> Column:
    """0.3 + 0.7 times the share of expected words that are given; 0.5 without expected words."""
    want, have = word_set(F.coalesce(expected, F.lit(""))), word_set(F.coalesce(given, F.lit("")))
    return F.when(F.size(want) == 0, 0.5).otherwise(0.3 + 0.7 * F.size(F.array_intersect(want, have)) / F.size(want))


def overlap_feedback(expected: Column, given: Column) -> Column:
    """What a given text makes of the expected words: empty, off_topic, partial, details_missing or match."""
    want, have = word_set(F.coalesce(expected, F.lit(""))), word_set(F.coalesce(given, F.lit("")))
    present, missing = F.size(F.array_intersect(want, have)), F.size(F.array_except(want, have))
    share = present / F.greatest(F.size(want), F.lit(1))
    return F.when(F.trim(F.coalesce(given, F.lit(""))) == "", "empty").when((missing > 3) & (share < 0.3), "off_topic").when(missing > present, "partial").when(missing > 0, "details_missing").otherwise("match")


def similar_sets(queries: DataFrame, rows: DataFrame, id_col: str, text_col: str, above: float = 0.25, most: int = 5) -> DataFrame:
    """(query_id, id, jaccard, rank): for each query the rows of highest word-set Jaccard above a bound.

    Queries are a stated set. Up to QUERY_WORDS words in all, their inverted index goes to every task and the rows are
    read once: a task counts the common words of its rows with all queries and keeps the ``most`` best rows a query. A
    larger set meets the rows in a join on rare words.
    """
    make = lambda d: d.select(F.col(id_col).alias("id"), word_set(F.coalesce(text_col, F.lit(""))).alias("words"))
    q, r = materialise(make(queries), "queries"), make(rows)
    if (q.agg(F.sum(F.size("words") + 1)).first()[0] or 0) <= QUERY_WORDS:
        scored = _indexed_sets(q.collect(), r, above, most)
    else:
        scored = _joined_sets(q, r, above)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("jaccard"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most).select("query_id", "id", F.round("jaccard", 6).alias("jaccard"), "rank")


def _indexed_sets(queries: list, rows: DataFrame, above: float, most: int) -> DataFrame:
    """(query_id, id, jaccard): of each task's rows the ``most`` best per query (ties by id)."""
    place: dict[str, int] = {}
    words = np.array([place.setdefault(w, len(place)) for x in queries for w in x["words"]], np.int64)
    sizes = np.array([len(x["words"]) for x in queries], np.int64)
    order = np.argsort(words, kind="stable")
    of = np.repeat(np.arange(len(queries)), sizes)[order]  # queries by word
    ends = np.concatenate(([0], np.cumsum(np.bincount(words, minlength=len(place))))).astype(np.int64)
    ids = [x["id"] for x in queries]
    held = rows.sparkSession.sparkContext.broadcast((place, of, ends, sizes, ids))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, of, ends, sizes, ids = held.value
        step = max(1, 4_000_000 // max(1, len(ids)))
        kept = None  # (query, -jaccard, id), sorted
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                lists = pa.concat_arrays([b.column("words")])
                n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                word = np.fromiter((place.get(w, -1) for w in lists.flatten().to_pylist()), np.int64, int(n.sum()))
                row = np.repeat(np.arange(len(n)), n)[word >= 0]
                word = word[word >= 0]
                k = ends[word + 1] - ends[word]
                pick = np.repeat(ends[word] - np.cumsum(k) + k, k) + np.arange(k.sum())
                cell = np.bincount(np.repeat(row, k) * len(ids) + of[pick], minlength=0)
                met = np.flatnonzero(cell)
                r, q = met // max(1, len(ids)), met % max(1, len(ids))
                jaccard = cell[met] / (n[r] + sizes[q] - cell[met])
                id_ = b.column("id").to_numpy(zero_copy_only=False)[r]
                id_ = id_.astype(str) if id_.dtype == object else id_
                keep = (jaccard > above) & (id_ != np.array(ids, id_.dtype)[q]) if len(met) else np.zeros(0, bool)
                found = (q[keep], -jaccard[keep], id_[keep])
                kept = found if kept is None else tuple(np.concatenate(x) for x in zip(kept, found))
                order = np.lexsort((kept[2], kept[1], kept[0]))
                kept = tuple(x[order] for x in kept)
                first = np.searchsorted(kept[0], kept[0])
                kept = tuple(x[np.arange(len(first)) - first < most] for x in kept)
        if kept is not None and len(kept[0]):
            yield pa.record_batch({"query_id": pa.array([ids[i] for i in kept[0]], kind_arrow), "id": pa.array(kept[2], kind_arrow), "jaccard": pa.array(-kept[1])})

    kind = rows.schema["id"].dataType
    kind_arrow = to_arrow_type(kind)
    known = rows.filter("id is not null")
    return known.mapInArrow(best, f"query_id {kind.simpleString()}, id {kind.simpleString()}, jaccard double")


def _joined_sets(q: DataFrame, r: DataFrame, above: float) -> DataFrame:
    """(query_id, id, jaccard) of all pairs above the bound.

    A pair above it has need = ceil(above / (1 + above) * (nq + nr)) words in common, and shares c of the first
    n - need + c words of either set, rarest first (words counted over all rows). So the frequent words are not
    joined on; pairs that share enough (c = 3) are compared in full.
    """
    often = r.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("often"))

    def heads(sets: DataFrame) -> DataFrame:
        words = sets.select("id", F.size("words").alias("n"), F.explode("words").alias("word")).join(often, "word", "left").fillna(0, ["often"])
        place = F.row_number().over(Window.partitionBy("id").orderBy("often", "word"))
        return words.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * above) + shared).select("id", "n", "word", "place")

    shared = 3
    a, b = heads(q).select(F.col("id").alias("query_id"), F.col("n").alias("nq"), "word", F.col("place").alias("pq")), heads(r)
    need = F.ceil(F.lit(above / (1 + above)) * (F.col("nq") + F.col("n")) - F.lit(1e-9))
    least = F.least(F.lit(shared), need)
    fits = (F.col("query_id") != F.col("id")) & (F.least("nq", "n") >= above * F.greatest("nq", "n")) & (F.col("pq") <= F.col("nq") - need + least) & (F.col("place") <= F.col("n") - need + least)
    met = a.join(b, "word").filter(fits).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("c"), F.max(least).alias("least"))
    near = met.filter(F.col("c") >= F.col("least")).select("query_id", "id")
    full = near.join(q.select(F.col("id").alias("query_id"), F.col("words").alias("q")), "query_id").join(r, "id")
    common = F.size(F.array_intersect("q", "words"))
    return full.select("query_id", "id", (common / (F.size("q") + F.size("words") - common)).alias("jaccard")).filter(F.col("jaccard") > above)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centroid): mean vector per label; elements are averaged as rows, so groups of any size spread."""
    e = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def to_own_centroid(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return vectors.join(centroids(vectors), "label").select(id_col, "label", F.round(cosine(F.col("embedding"), F.col("centroid")), 5).alias("score"))
