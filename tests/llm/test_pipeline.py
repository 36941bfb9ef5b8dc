import random
import re
from collections import Counter

import corpus_pipeline
from quire.llm import toxicity
from quire.llm._common import table, written
from tests.llm.cases import clashing, docs, empty_docs, odd_docs
from tests.llm.test_jaccard import brute_force

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def is_subsequence(a, b):
    rest = iter(b)
    return all(x in rest for x in a)


def planted(spark, folder):
    """Tables with toxic documents, near and exact copies, and passages that documents share."""
    r = random.Random(9)
    plain = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    insults = ["scumbag", "moronic", "pathetic", "vermin"]
    passages = [[r.choice(plain) for _ in range(r.randint(55, 90))] for _ in range(4)]
    texts, labels = [], []
    for k in range(260):
        words = [r.choice(plain) for _ in range(r.randint(0, 120))]
        if toxic := r.random() < 0.3:
            for _ in range(6):
                words.insert(r.randrange(len(words) + 1), r.choice(insults))
        elif r.random() < 0.3:
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(passages)
        elif texts and r.random() < 0.3:
            words = r.choice(texts).split()
            if words and r.random() < 0.6:
                words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        labels.append((k, int(toxic or any(w in insults for w in words))))
    docs(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels[:240], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    sf = str(tmp_path)
    planted(spark, sf)
    documents = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "substring_dedup", "packing"]
    before = {r.doc_id: r.text for r in documents.collect()}

    # toxicity: each text by itself, with the same model
    clean = written(stages["toxicity"](spark, documents, sf), "t")
    scorer = toxicity.Scorer(toxicity.fit(documents, table(spark, sf, "labels")))
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert clean.schema == documents.schema
    assert kept == {d: t for d, t in before.items() if scorer.score(t or "") < toxicity.THRESHOLD}
    assert 0 < len(kept) < len(before)

    # near duplicates: all pairs compared
    singles = written(stages["ngram_jaccard"](spark, clean, sf), "j")
    own = {d for d, _, c in brute_force(list(kept.items())) if d == c}
    assert {r.doc_id: r.text for r in singles.collect()} == {d: kept[d] for d in own}

    # passages: what goes stands in an earlier document, what stands there as 50 equal words goes
    cut = written(stages["substring_dedup"](spark, singles, sf), "p")
    left = {r.doc_id: r.text for r in cut.collect()}
    words = {d: tokens(kept[d]) for d in own}
    seen = set()
    for d in sorted(own):
        grams = {tuple(words[d][k : k + 50]) for k in range(len(words[d]) - 49)}
        now = tokens(left.get(d))
        assert is_subsequence(now, words[d])
        assert not seen & {tuple(now[k : k + 50]) for k in range(len(now) - 49)} or len(now) < len(words[d])
        if grams & seen:
            assert len(now) < len(words[d])
        seen |= grams
    for p in corpus_pipeline.chaining.passages(singles).collect():
        a = words[p.doc_id][p.start : p.start + p.length]
        b = words[p.source_id][p.source_start : p.source_start + p.source_length]
        assert p.source_id < p.doc_id and len(a) >= 40
        assert p.matches <= common_subsequence(a, b) and p.matches >= 0.8 * len(a)

    # packing: every id in one piece, no overlap in a sequence
    packed = stages["packing"](spark, cut, sf).collect()
    assert {r.doc_id for r in packed} == set(left)
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rows in by_doc.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == rows[0].doc_tokens
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096

    whole = corpus_pipeline.run(spark, sf).collect()
    assert Counter(whole) == Counter(packed)


def test_odd_tables(spark, sf):
    for rows in (odd_docs(spark), empty_docs(spark), clashing(odd_docs(spark, 1), "a", "start", "text_hash", "sig")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = written(stage(spark, rows, sf), "odd")
            assert after.columns == rows.columns
            assert after.filter("text is null").count() == rows.filter("text is null").count()
            rows = after
        corpus_pipeline.STAGES[-1][1](spark, rows, sf).collect()
