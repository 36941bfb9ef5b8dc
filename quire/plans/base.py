"""The queries found so far; modules of this package add theirs with :func:`query`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


#: The catalogue as :func:`quire.sources.tables.records` derives it from the stored tables.
RECORDS = """WITH records AS (SELECT *, [lang, source, size_tag] || CASE WHEN coalesce(finished, false) THEN ['end'] ELSE [] END || CASE WHEN id % 31 = 0 THEN ['404'] ELSE [] END AS tags FROM (
 SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, 'author' || (d.doc_id % 97) AS author, d.source AS sitename, d.lang AS lang, d.source AS source,
 'https://www.' || d.source || '.example/n' || d.doc_id || 'ab/' AS toc_url, CASE WHEN d.n_chars < 500 THEN 2 WHEN d.doc_id % 5 = 0 THEN 0 ELSE 1 END AS novel_type,
 CASE WHEN d.n_chars < 500 THEN 'short' WHEN d.n_chars < 3000 THEN 'medium' ELSE 'long' END AS size_tag,
 greatest(d.n_chars, 0) AS length, coalesce(l.toxic = 1, false) AS frozen, l.quality = 1 AS finished, d.doc_id % 29 = 0 AS suspended,
 TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id * 7 % 9000) AS last_update,
 CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id * 7 % 9000 + d.doc_id % 10 - 5) END AS new_arrivals,
 CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE d.doc_id % 400 END AS episodes
 FROM documents d LEFT JOIN labels l USING (doc_id)))
"""
#: The status labels in their order.
STATUS_SQL = "coalesce(nullif(concat_ws(', ', CASE WHEN frozen THEN 'frozen' END, CASE WHEN list_contains(tags, 'end') THEN 'finished' END, CASE WHEN list_contains(tags, '404') THEN 'deleted' END, CASE WHEN suspended THEN 'suspended' END), ''), 'serialising')"
