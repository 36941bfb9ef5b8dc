"""Stored chapters: merges, change classes, outcomes and what is sent out about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What can be done when a work has fewer chapters than before.
SHRINK_CHOICES = ("update", "cancel", "freeze", "backup", "browser", "folder", "convert", "compare")
#: Titles named in a notification, at most.
NAMED = 5


def _both(stored: DataFrame, batch: DataFrame, keys: list[str]) -> tuple[DataFrame, Callable]:
    s, b = stored.alias("s"), batch.alias("b")
    met = [F.col(f"s.{k}") == F.col(f"b.{k}") for k in keys]
    joined = s.withColumn("_s", F.lit(True)).alias("s").join(b.withColumn("_b", F.lit(True)).alias("b"), met, "full_outer")
    return joined, lambda c: [F.coalesce(f"s.{k}", f"b.{k}").alias(k) for k in c]


def merge_works(stored: DataFrame, batch: DataFrame, key: str = "id", kept: tuple[str, ...] = ("created_at",), texts: tuple[str, ...] = ("title", "author")) -> DataFrame:
    """``stored`` with the batch merged in: ``kept`` columns keep what was there, ``texts`` too where the new one is empty, all others are replaced."""
    joined, names = _both(stored, batch, [key])

    def value(c: str) -> Column:
        new, old = F.col(f"b.{c}"), F.col(f"s.{c}")
        if c in kept:
            return F.coalesce(old, new)
        if c in texts:
            return F.coalesce(F.nullif(new, F.lit("")), old)
        return F.when(F.col("b._b"), new).otherwise(old)

    return joined.select(*names([key]), *(value(c).alias(c) for c in stored.columns if c != key))


def merge_sections(stored: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("work", "position")) -> DataFrame:
    """Chapters with bodies: an empty address or signature keeps the stored one, all else is replaced, and the body counts as stored."""
    joined, names = _both(stored, batch, list(keys))

    def value(c: str) -> Column:
        new, old = F.col(f"b.{c}"), F.col(f"s.{c}")
        if c in ("url", "signature"):
            return F.coalesce(F.nullif(new, F.lit("")), old, new)
        if c == "downloaded":
            return F.when(F.col("b._b"), True).otherwise(old)
        return F.when(F.col("b._b"), new).otherwise(old)

    return joined.select(*names(keys), *(value(c).alias(c) for c in stored.columns if c not in keys))


def merge_placeholders(stored: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("work", "position")) -> DataFrame:
    """Chapters of a table of contents without bodies: stored bodies and signatures stay; one without a signature must be read again."""
    joined, names = _both(stored, batch, list(keys))
    unsigned = F.col("b._b") & (F.coalesce(F.col("s.signature"), F.lit("")) == "")

    def value(c: str) -> Column:
        new, old = F.col(f"b.{c}"), F.col(f"s.{c}")
        if c == "signature":
            return F.coalesce(old, F.lit(""))
        if c == "downloaded":
            return F.when(unsigned, False).otherwise(F.coalesce(old, F.lit(False)))
        if c == "updated":
            return F.when(unsigned, new).otherwise(old)
        return F.when(F.col("b._b"), new).otherwise(old)

    return joined.select(*names(keys), *(value(c).alias(c) for c in stored.columns if c not in keys))


def merge_records(stored: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Columns that the batch has win where they are not null; all others stay."""
    joined, names = _both(stored, batch, [key])
    return joined.select(*names([key]), *((F.coalesce(f"b.{c}", f"s.{c}") if c in batch.columns else F.col(f"s.{c}")).alias(c) for c in stored.columns if c != key))


def without_works(rows: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(removed.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def section_change(found: Column, body: Column, old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Why a chapter must be read again: ``new``, ``title``, ``heading``, ``missing``, ``dated`` (had no revision date and has one),
    ``undated`` (nothing to compare with), ``revised``; else ``same``.

    ``old`` and ``new``: ``title, heading, first, revised``; dates are compared as text.
    """
    before = F.when(new["revised"].isNotNull(), F.coalesce(old["revised"], old["first"])).otherwise(old["revised"])
    by_revision = F.when(before == "", F.when(new["revised"] != "", "dated").otherwise("same")).when(new["revised"] > before, "revised").otherwise("same")
    by_first = F.when(old["first"].isNull(), "undated").when(new["first"] > old["first"], "revised").otherwise("same")
    dates = F.when(before.isNotNull() & new["revised"].isNotNull(), by_revision).otherwise(by_first)
    return F.when(~found, "new").when(~old["title"].eqNullSafe(new["title"]), "title").when(~old["heading"].eqNullSafe(new["heading"]), "heading").when(~body, "missing").otherwise(dates)


def strongly_changed(change_day: Column, file_day: Column, old_signature: Column, new_signature: Column, by_date: Column) -> Column:
    """On the day a file was stored dates say nothing, so contents are compared; else the dates decide."""
    return F.when(change_day == file_day, ~old_signature.eqNullSafe(new_signature)).otherwise(by_date)


def outcome(updated: Column, removed: Column, title: Column, story: Column, author: Column) -> Column:
    """What a run did, the first that holds."""
    return F.when(updated > 0, "updated").when(removed > 0, "removed").when(title, "title").when(story, "story").when(author, "author").otherwise("none")


def shrink(old: Column, new: Column, choice: Column) -> Column:
    """What to do with a work: ``go on`` if it has not fewer chapters, else the choice, ``cancel`` if there is no valid one."""
    return F.when(new >= old, "go on").when(choice.isin(*SHRINK_CHOICES), choice).otherwise("cancel")


def with_state_tag(tags: Column, tag: str, holds: Column) -> Column:
    """``tags`` with the tag if it holds, without it if not; as they are if unknown."""
    one = F.array(F.lit(tag))
    return F.when(holds.isNull(), tags).when(holds, F.array_union(tags, one)).otherwise(F.array_except(tags, one))


def fingerprint(values: dict[str, Column]) -> Column:
    """A digest of named values, in the order of their names."""
    parts = [F.concat(F.lit(k + "="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in sorted(values.items())]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def snapshot_time(name: Column) -> Column:
    """The time that a snapshot's name ``YYYY.MM.DD@HH.MM.SS`` (or with ``;``) gives; null for any other name."""
    plain = F.when(name.rlike(r"^\d{4}\.\d{2}\.\d{2}[@;]\d{2}\.\d{2}\.\d{2}$"), F.replace(name, F.lit(";"), F.lit("@")))
    return F.try_to_timestamp(plain, F.lit("yyyy.MM.dd@HH.mm.ss"))


def update_check(known: Column, total: Column, failed: Column) -> Column:
    """``error``, ``init`` at first sight, ``updated`` if there is more than was known, else ``same``."""
    return F.when(failed, "error").when(known.isNull(), "init").when(total > known, "updated").otherwise("same")


def notification(rows: DataFrame) -> DataFrame:
    """One text of ``rows (kind, title)``: a line for each kind with the first titles and how many more there are."""
    by = Window.partitionBy("kind").orderBy("title")
    first = rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= NAMED)
    titles = first.groupBy("kind").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    few = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(titles, "kind")
    more = F.when(F.col("n") > NAMED, F.concat(F.lit(" +"), (F.col("n") - NAMED).cast("string"), F.lit(" more"))).otherwise("")
    line = F.concat(F.col("kind"), F.lit(" ("), F.col("n").cast("string"), F.lit("): "), F.array_join("titles", ", "), more)
    return few.select("kind", line.alias("line"))


def heading_text(title: Column, author: Column, story: Column, url: Column) -> Column:
    """The head of an assembled work."""
    return F.concat_ws("\n", title, author, F.when(F.length(story) > 0, F.concat(F.lit("あらすじ：\n"), story)), F.when(F.length(url) > 0, F.concat(F.lit("掲載ページ:\n"), url)))
