"""Mixing sources to target weights: each source's share of all tokens as near its target as its caps allow.

The sources with documents share the whole among them in proportion to their targets (a target whose source has
no tokens cannot be met by anyone). The total is the largest at which no source needs more than ``max_repeats``
uses of a document, so that the caps bend no share. A document is emitted floor(rate) times, and once more with
probability rate - floor(rate), drawn from a hash of its id and the seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.session import materialise


def _key(column: str):
    return F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))


def mix_rates(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, rate, binding): one row per source of either table.

    binding: the source whose cap sets the total.

    tokens: source and n_tokens per document. Sources are compared without case and outer blanks, a null one is
    ''. Rows of targets that name one source are added up, with the smaller cap. A source without target, with a
    null or non-positive share or cap, or without tokens has rate 0.
    """
    want = targets.groupBy(_key("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    have = tokens.groupBy(_key("source").alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    both = want.join(have, "source", "full").fillna(0, ["target_share", "max_repeats", "documents", "tokens"])
    usable = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("tokens") > 0)
    both = both.withColumn("usable", usable)
    whole = both.agg(F.sum(F.when(F.col("usable"), F.col("target_share"))).alias("whole")).scalar()
    both = both.withColumn("share", F.when(F.col("usable"), F.col("target_share") / whole))
    most = F.col("tokens") * F.col("max_repeats") / F.col("share")
    both = both.withColumn("total", both.agg(F.min(most).alias("total")).scalar())
    rate = F.when(F.col("usable"), F.least(F.col("share") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return both.select("source", "target_share", "max_repeats", "documents", "tokens", rate.alias("rate"), (F.col("usable") & (most <= F.col("total") * (1 + 1e-12))).alias("binding"))


def draw_copies(tokens: DataFrame, rates: DataFrame, id_col: str, seed: int = 17) -> DataFrame:
    """(id_col, source, n_tokens, copies): floor(rate) of the source plus one hash-seeded Bernoulli copy."""
    part = F.col("rate") - F.floor("rate")
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    keyed = tokens.select(id_col, _key("source").alias("source"), "n_tokens")
    copies = (F.floor("rate") + (draw < part).cast("int")).cast("int").alias("copies")
    return keyed.join(rates.select("source", "rate"), "source").select(*keyed.columns, copies)


def mix(tokens: DataFrame, targets: DataFrame, id_col: str, seed: int = 17) -> DataFrame:
    """(id_col, source, n_tokens, copy): one row per emitted copy of a document, numbered from 1."""
    chosen = draw_copies(tokens, mix_rates(tokens, targets), id_col, seed).filter("copies > 0")
    return chosen.select(id_col, "source", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def mix_report(tokens: DataFrame, targets: DataFrame, id_col: str, seed: int = 17) -> DataFrame:
    """Per source: target and actual share of the emitted tokens, documents, tokens, copies and most repeats, whether its
    cap sets the total, and the tokens that its cap would still allow."""
    tokens = materialise(tokens.select(id_col, "source", "n_tokens"), "tokens")
    rates = mix_rates(tokens, targets)
    got = draw_copies(tokens, rates, id_col, seed).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_documents"), F.max("copies").alias("most_repeats")
    )
    out = rates.join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_documents", "most_repeats"])
    share = F.try_divide(F.col("mixed_tokens"), out.agg(F.sum("mixed_tokens").alias("all")).scalar()).alias("actual_share")
    left = F.when(F.col("target_share") > 0, F.greatest(F.lit(0), F.col("tokens") * F.col("max_repeats") - F.col("mixed_tokens"))).otherwise(0).alias("unused_tokens")
    return out.select("source", "target_share", share, "documents", "tokens", "max_repeats", "rate", "mixed_documents", "mixed_tokens", "most_repeats", "binding", left)
