"""The watch loop: what was known of each address decides what a check of it means.

A stream of checks is grouped by address; each address keeps its state between
batches and over restarts, so every check is compared with all that came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHECKS = "address string, at timestamp, seq long, title string, total long, error string"
RESULT = "address string, at timestamp, seq long, status string, total long, new long, known long, title string"
STATE = "known long, title string, checked timestamp"


def watched(checks: DataFrame) -> DataFrame:
    """Rows of :data:`RESULT` for a stream of :data:`CHECKS`, one for each check, in append mode.

    ``init``: nothing was known, the number of episodes is; ``updated``: more than known, ``new`` of them;
    ``uptodate``; ``error``: the check has one or no total, what was known stays.  ``known`` and ``title`` are what is known afterwards.
    Checks of an address in one batch are taken by time, then ``seq``; one that comes in a later batch counts as later.
    An address holds three values however many checks it has had.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, title, checked = state.get if state.exists else (0, None, None)
        rows = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            new = 0
            if (r.error is not None and not pd.isna(r.error)) or pd.isna(r.total):
                status = "error"
            elif known == 0:
                status, known, title = "init", int(r.total), r.title
            elif r.total > known:
                status, new, known, title = "updated", int(r.total) - known, int(r.total), r.title
            else:
                status = "uptodate"
            checked = r.at
            out.append((key[0], r.at, r.seq, status, None if pd.isna(r.total) else int(r.total), new, known, title))
        state.update((known, title, None if pd.isna(checked) else checked.to_pydatetime()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"total": "Int64"})

    rows = checks.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in CHECKS.split(", "))).filter("address IS NOT NULL")
    return rows.groupBy("address").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def watched_table(checks: DataFrame) -> DataFrame:
    """The same for a finished table: what is known is the largest total of the good checks before."""
    by = Window.partitionBy("address").orderBy("at", "seq")
    good = F.when(F.col("error").isNull(), F.col("total"))
    before = F.coalesce(F.max(good).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = checks.filter("address IS NOT NULL").select("*", good.alias("good"), before.alias("before"))
    status = F.when(F.col("good").isNull(), "error").when(F.col("before") == 0, "init").when(F.col("good") > F.col("before"), "updated").otherwise("uptodate")
    new = F.when(F.col("before") > 0, F.greatest(F.col("good") - F.col("before"), F.lit(0)))
    return rows.select("address", "at", "seq", status.alias("status"), "total", F.coalesce(new, F.lit(0)).cast("long").alias("new"), F.greatest("before", F.coalesce("good", F.lit(0))).alias("known"))


def store(results: DataFrame, path: str, checkpoint: str):
    """Starts a query that takes all there is and appends ``results`` to the table at ``path``; a restart goes on where it ended."""
    return results.writeStream.trigger(availableNow=True).format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
