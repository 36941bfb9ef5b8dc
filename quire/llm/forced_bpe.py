"""Operator 4: BPE encoding and decoding with forced boundaries.

Byte pairs that never occur inside a token of the vocabulary mark certain cuts.
Each text is cut there, the fragments are encoded independently, and their ids
are concatenated (see ``fragments.ForcedBoundaries`` for why this is exact).
Every row is handled by itself: no shuffle, and memory is bounded by one Arrow
batch and the fragment cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm._common import table, texts_of
from quire.llm.fragments import chunks, encoder, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, text, ids array<int>`` for every row of ``docs``.

    A null text counts as empty and has no ids; a null ``doc_id`` is kept;
    repeated rows give repeated results; an empty table gives an empty result;
    columns other than ``doc_id`` and ``text`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "forced")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for s in chunks(texts):
                out = enc.encode(texts[s])
                yield pa.RecordBatch.from_arrays(
                    [ids[s.start : s.stop], pa.array(texts[s], pa.string()), pa.array([ids.tolist() for ids in out], pa.list_(pa.int32()))], ["doc_id", "text", "ids"]
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded string``: the text that ``ids`` stand for, special tokens included.

    Bytes that are no UTF-8 are replaced as the library replaces them; null ids
    count as none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "forced")
        for batch in batches:
            out = [decoded(enc.token_bytes, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def decoded(token_bytes: list[bytes | None], ids: list[int] | None) -> str:
    """The text of these ids."""
    return b"".join(map(token_bytes.__getitem__, ids or [])).decode("utf-8", errors="replace")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per document with digests of its ids and of the text decoded from them.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``; cases as in :func:`encode`.
    The ids do not leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "forced")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, ids_sha, text_sha = [], [], []
            for s in chunks(texts):
                for ids in map(np.ndarray.tolist, enc.encode(texts[s])):
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded(enc.token_bytes, ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every text of ``documents``."""
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
