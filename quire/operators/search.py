"""Full-text ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def bm25(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """``<key>, score`` of every row with a word of the query; words are runs of ASCII letters and digits.

    A text's length and its counts are found in one projection, so only sums are shuffled.
    """
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    counts = docs.select(key, words.alias("_words")).select(key, F.size("_words").alias("_length"), *(F.size(F.filter("_words", F.lit(t).__eq__)).alias(f"_tf{k}") for k, t in enumerate(query)))
    held = counts.filter("_length > 0")
    # one row
    all_of = held.agg(F.count(F.lit(1)).alias("_n"), F.avg("_length").alias("_mean"), *(F.count_if(F.col(f"_tf{k}") > 0).alias(f"_df{k}") for k in range(len(query))))
    joined = held.filter(F.greatest(*(F.col(f"_tf{k}") for k in range(len(query))), F.lit(0)) > 0).crossJoin(F.broadcast(all_of))

    def part(k: int) -> Column:
        df, tf = F.col(f"_df{k}"), F.col(f"_tf{k}")
        weight = F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1)
        return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / F.col("_mean")))

    return joined.select(key, sum((part(k) for k in range(len(query))), F.lit(0.0)).alias("score"))
