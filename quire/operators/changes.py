"""Keyed merges, change classes and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order, by a grouped minimum that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.min(F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)), *rest)).alias("_row"))
    return ranked.select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def upsert(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``stored`` with the batch merged in by key: values that are not empty win, empty ones keep what was there.

    Both have the key once at most and the same columns.
    """
    s, b = stored.alias("s"), batch.alias("b")
    values = [c for c in stored.columns if c != key]
    kinds = dict(stored.dtypes)
    new = {c: F.nullif(F.col(f"b.{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"b.{c}") for c in values}
    return s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"s.{key}", f"b.{key}").alias(key), *(F.coalesce(new[c], f"s.{c}").alias(c) for c in values))


def change_class(found: Column, old_title: Column, new_title: Column, old_date: Column, new_date: Column) -> Column:
    """new, title, revised or same; a missing old date counts as revised."""
    return F.when(~found, "new").when(~old_title.eqNullSafe(new_title), "title").when(old_date.isNull() | (new_date > old_date), "revised").otherwise("same")


def metadata_signature(*parts: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))


def content_signature(introduction: Column, body: Column, postscript: Column) -> Column:
    """``sha256:`` and the digest of the three parts with NUL between them."""
    none = F.lit("")
    nul = F.lit("\0")
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.coalesce(introduction, none), nul, F.coalesce(body, none), nul, F.coalesce(postscript, none)), 256))


def needs_refresh(signature: Column, stored_signature: Column, downloaded: Column) -> Column:
    """Whether a chapter must be read again."""
    return F.when(~F.coalesce(downloaded, F.lit(False)), True).when(F.coalesce(stored_signature, F.lit("")) != "", ~signature.eqNullSafe(stored_signature)).otherwise(False)
