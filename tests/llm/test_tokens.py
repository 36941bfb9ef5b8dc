import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import elias_fano, forced_bpe, packing
from quire.llm._common import work_path
from quire.llm.fragments import FragmentEncoder, tokenizer_path
from tests.llm.cases import ODD_TEXTS, clashing, empty_docs, odd_docs

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def random_texts(n=1500, seed=1):
    r = random.Random(seed)
    alphabet = ["a", "b", "the", "don", "'", "'s", "'ll", "s", " ", "  ", "\n", "\n\n", "\t", "1", "23", "!", ",", "é", "ß", "你", " ", "　", "\x1c", "\x85", " ", "\U0001f600", "<|endoftext|>", "<|", "|>", "́", "A", "İ", "²", "’"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize(("path", "cuts"), [(BYTE, "forced"), (WORD, "words")])
def test_fragments_give_the_librarys_ids(path, cuts):
    texts = [t or "" for t in ODD_TEXTS] + random_texts()
    want = [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]
    texts += ["words, such; as, these!? stand: here.", "A" * 40, "straßen ÜBER naïve, façade!!!! x.", "Zurich,zurich ;a"]
    want += [e.ids for e in library(path).encode_batch(texts[len(want) :], add_special_tokens=False)]
    encoder = FragmentEncoder(path, cuts)
    for _ in range(2):
        assert [ids.tolist() for ids in encoder.encode(texts)] == want


def test_bulk_merges(sf):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    for path, cuts in ((BYTE, "forced"), (WORD, "words")):
        want = [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]
        assert [ids.tolist() for ids in FragmentEncoder(path, cuts).encode(texts)] == want


def test_forced_bpe(spark, sf):
    lib = library(BYTE)
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{sf}/documents.parquet"))
    got = Counter(map(tuple, forced_bpe.round_trip(clashing(docs, "ids", "n_tokens"), BYTE).collect()))
    want = Counter()
    for doc, text in docs.select("doc_id", "text").collect():
        ids = lib.encode(text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want[(doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert got == want
    assert forced_bpe.round_trip(empty_docs(spark), BYTE).count() == 0


def test_encode_then_decode(spark):
    docs = odd_docs(spark)
    back = forced_bpe.decode(forced_bpe.encode(docs, BYTE), BYTE)
    assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t in docs.select("doc_id", "text").collect())


def test_elias_fano_sequence():
    r = np.random.default_rng(3)
    for values in ([], [0], [0, 0, 5, 5, 5], [7] * 100, np.sort(r.integers(0, 10**7, 5000)), np.sort(r.integers(0, 50, 3000))):
        v = np.array(values, dtype=np.int64)
        ef = elias_fano.EliasFano.from_bytes(elias_fano.EliasFano.of(v, int(v[-1]) + 1 if len(v) else 1).to_bytes())
        assert ef.values().tolist() == v.tolist()
        assert [ef.select(k) for k in range(0, len(v), max(1, len(v) // 50))] == v[:: max(1, len(v) // 50)].tolist()


def test_elias_fano_space():
    ends = np.cumsum(np.full(10_000, 700))
    assert len(elias_fano.EliasFano.of(ends, int(ends[-1]) + 1).to_bytes()) < 10_000 * 12 / 8 + 64


def test_elias_fano_files(spark, sf):
    lib = library(BYTE)
    docs = clashing(odd_docs(spark).unionByName(spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumn("doc_id", F.col("doc_id") + 1000)), "part", "data")
    out = work_path(spark, "t")
    elias_fano.write(docs, out, BYTE, block_ids=2000)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for d, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, elias_fano.digests(spark, out).collect()), key=lambda r: r[1]) == want
    whole = sorted(elias_fano.read(spark, out).collect(), key=lambda r: r[1])
    assert [(r[0], r[1], len(r[2])) for r in whole] == [w[:3] for w in want]
    empty = work_path(spark, "t")
    elias_fano.write(empty_docs(spark), empty, BYTE)
    assert elias_fano.digests(spark, empty).count() == 0


def slow_first_fit(sizes, capacity):
    room, bins = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= sizes[i]
        bins[i] = at
    return bins


def test_tournament_tree_is_first_fit():
    r = random.Random(5)
    for n in (0, 1, 2, 17, 300):
        sizes = [r.choice([1, 7, 50, 99, 100, r.randint(1, 100)]) for _ in range(n)]
        assert packing.first_fit_decreasing(sizes, 100)[0] == slow_first_fit(sizes, 100)


def test_packing(spark, sf):
    lib = library(WORD)
    docs = clashing(odd_docs(spark).unionByName(spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)), "sequence_id", "pack_group")
    got = packing.pack(docs, WORD, length=512, group_docs=64).collect()
    ids = [(d, np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for d, t in docs.select("doc_id", "text").collect()]
    want = Counter((d, a, len(v[a : a + 512]), zlib.crc32(v[a : a + 512].tobytes()), len(v)) for d, v in ids for a in range(0, len(v), 512))
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
        padding += 512 - at
        total += at
    assert padding < 0.05 * total
    assert packing.pack(empty_docs(spark), WORD).count() == 0
