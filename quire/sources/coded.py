"""Chapters whose texts are compressed against dictionaries that batches of a work share.

A batch of chapters trains one dictionary from its texts; each text is compressed with it.
Stored are two tables in folders by a hash of the work: the sections with three
compressed texts and the ids of their dictionaries, and the dictionaries.  Reading
joins the sections with the dictionaries of the introduction, the afterword and the body.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: level, bytes of a dictionary, texts that train one at least, prefix of its id.
LEVEL, DICTIONARY_BYTES, LEAST_SAMPLES, PREFIX = 1, 32 * 1024, 4, "zhtml"
#: Chapters that share a dictionary; folders that works are dealt into; bytes of texts that train one dictionary.
BATCH, PARTS, SAMPLE_BYTES = 64, 32, 1 << 22

PIECES = ("intro", "body", "post")
SECTIONS = "work long, position long, subtitle string, " + ", ".join(f"{p} binary, {p}_dict string" for p in PIECES) + ", part int"
DICTIONARIES = "work long, dict_id string, dictionary binary, samples long, part int"
CODED = SECTIONS.replace(", part int", "") + ", dict_id string, dictionary binary, samples long"


def trained(texts: list[str]) -> bytes | None:
    """A dictionary for the texts that are not blank; None for fewer than :data:`LEAST_SAMPLES`, or where training gives none."""
    some, size = [], 0
    for t in texts:
        if t and t.strip() and size < SAMPLE_BYTES:
            some.append(t.encode())
            size += len(some[-1])
    if len(some) < LEAST_SAMPLES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, some, level=LEVEL).as_bytes() or None
    except zstandard.ZstdError:  # too little text
        return None


def dictionary_id(dictionary: bytes) -> str:
    return f"{PREFIX}-{hashlib.sha256(dictionary).digest()[:8].hex()}"


def _folder(work: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(work), F.lit(parts)).cast("int")


def coded(chapters: DataFrame, batch: int = BATCH) -> DataFrame:
    """Rows of :data:`CODED`: one for each chapter with its compressed texts, one for each dictionary.

    Chapters of a work that follow each other make a batch, wherever they come from; a task
    holds one batch at a time.  A work's chapters are dealt by ranges of positions, so
    that a long work is not left to one task.
    """
    span = F.floor(F.coalesce("position", F.lit(0)) / (16 * batch))
    rows = chapters.select(F.col("work").cast("long").alias("work"), F.col("position").cast("long").alias("position"), "subtitle", *PIECES, span.alias("span"))
    rows = rows.repartition("work", "span").sortWithinPartitions("work", "position").drop("span")

    def packed(some: list[dict]) -> pa.RecordBatch:
        dictionary = trained([r[p] for r in some for p in PIECES if r[p]])
        name = dictionary and dictionary_id(dictionary)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out = []
        for r in some:
            blobs = {p: None if r[p] is None else squeeze.compress(r[p].encode()) for p in PIECES}
            out.append({**r, **blobs, **{f"{p}_dict": name if r[p] is not None else None for p in PIECES}})
        if dictionary:
            out.append({"work": some[0]["work"], "dict_id": name, "dictionary": dictionary, "samples": sum(bool(r[p] and r[p].strip()) for r in some for p in PIECES)})
        return pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in CODED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[dict] = []
        for rows in batches:
            for r in rows.to_pylist():
                if some and (len(some) == batch or r["work"] != some[0]["work"]):
                    yield packed(some)
                    some = []
                some.append(r)
        if some:
            yield packed(some)

    return rows.mapInArrow(run, CODED)


def write_coded(chapters: DataFrame, path: str, batch: int = BATCH, parts: int = PARTS) -> None:
    """Stores ``chapters (work, position, subtitle, intro, body, post)`` as the tables ``sections`` and ``dictionaries``.

    Null texts stay null, empty ones empty.  Rows with a null work or equal positions are kept as they are.
    """
    kind = F.when(F.col("dictionary").isNull(), "sections").otherwise("dictionaries")
    rows = coded(chapters, batch).withColumns({"kind": kind, "part": _folder(F.col("work"), parts)})
    rows.write.partitionBy("kind", "part").option("compression", "none").parquet(path)


def decoded(rows: DataFrame, piece: str) -> DataFrame:
    """``rows`` with the text of ``piece`` in place of its blob, by ``dictionary``, which is dropped; dictionaries are set up once as they follow each other."""
    kept = [c for c in rows.columns if c != "dictionary"]
    types = dict(rows.dtypes) | {piece: "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str | None, zstandard.ZstdDecompressor] = {}
        for batch in batches:
            blobs, names, dictionaries = (batch.column(batch.schema.names.index(c)) for c in (piece, f"{piece}_dict", "dictionary"))
            texts = []
            for k in range(batch.num_rows):
                blob, name = blobs[k].as_py(), names[k].as_py()
                if blob is None:
                    texts.append(None)
                    continue
                if name not in ready:
                    if len(ready) > 64:
                        ready.clear()
                    data = dictionaries[k].as_py()
                    if name is not None and data is None:
                        raise ValueError(f"the dictionary {name} is missing")
                    ready[name] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
                texts.append(ready[name].decompress(blob).decode())
            columns = [pa.array(texts, pa.string()) if c == piece else batch.column(batch.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(columns, kept)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept))


def read_coded(spark: SparkSession, path: str, works: list[int] | None = None, parts: int = PARTS) -> DataFrame:
    """``work, position, subtitle, intro, body, post`` as they were written; ``works``: only these, from their folders alone.

    Sections are joined with the dictionaries for one text after the other, and each is decoded
    before the next join, so that no row carries more than one dictionary.
    """
    tables = {}
    for kind, columns in (("sections", SECTIONS), ("dictionaries", DICTIONARIES)):
        rows = spark.read.schema(columns + ", kind string").parquet(path).filter(F.col("kind") == kind).drop("kind")
        if works is not None:
            folder = F.lit(False)
            for w in works:
                folder = folder | (F.col("part") == _folder(F.lit(w).cast("long"), parts))
            rows = rows.filter(folder & F.col("work").isin(works))
        tables[kind] = rows
    # the same texts give the same dictionary again
    known = tables["dictionaries"].groupBy(F.col("part").alias("_part"), F.col("work").alias("_work"), F.col("dict_id").alias("_id")).agg(F.first("dictionary").alias("dictionary"))
    out = tables["sections"]
    for piece in ("intro", "post", "body"):
        match = (F.col("part") == F.col("_part")) & F.col("work").eqNullSafe(F.col("_work")) & (F.col(f"{piece}_dict") == F.col("_id"))
        out = decoded(out.join(known, match, "left").drop("_part", "_work", "_id"), piece)
    return out.select("work", "position", "subtitle", *PIECES)
