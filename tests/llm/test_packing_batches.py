"""Packing and cutting handle a batch of texts in parts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import chaining, packing
from quire.llm._common import BATCH_BYTES, written


def test_encoded_in_parts():
    texts = ["a b c " * 30_000] * 20 + ["", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(22)), pa.array(texts), pa.array(range(22))], ["doc_id", "text", "row_key"])
    sizes = []

    def encode(some):
        sizes.append(sum(map(len, some)))
        return [np.arange(len(t.split()), dtype=np.uint32) for t in some]

    rows = [r for part in packing.pieces_of(batch, encode, 4096, 2) for r in part.to_pylist()]
    assert max(sizes) <= packing.ENCODED_BYTES and sum(sizes) == sum(map(len, texts))
    for k, t in enumerate(texts):
        of = [r for r in rows if r["doc_id"] == k]
        assert sum(r["length"] for r in of) == len(t.split()) + 1 == of[0]["doc_tokens"]


def test_cut_in_parts():
    texts = ["w " * 100_000 + "end"] * 9 + [None, "a b c", "a b"]
    spans = [[{"start": 0, "length": 100_000}]] * 9 + [None, None, [{"start": 0, "length": 2}]]
    row = pa.array([{"doc_id": k, "text": t, "n_chars": len(t or "")} for k, t in enumerate(texts)])
    batch = pa.RecordBatch.from_arrays([row, pa.array(spans)], ["row", "spans"])
    parts = list(chaining.cut_rows(batch, ["doc_id", "text", "n_chars"]))
    assert len(parts) > 1
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert got == [(k, " end", 4) for k in range(9)] + [(9, None, 0), (10, "a b c", 5)]


def test_batches_of_written_tables_are_bounded_in_bytes(spark):
    wide = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    sizes = [r[0] for r in written(wide.mapInArrow(run, "n long"), "sizes").collect()]
    assert len(sizes) > 1 and max(sizes) < 1.1 * BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
