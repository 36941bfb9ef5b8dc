import random
import zlib

from quire.llm import toxicity
from tests.llm.cases import clashing, docs, empty_docs, odd_docs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_what_edit_distance_finds():
    r = random.Random(2)
    terms = list(dict.fromkeys("".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(60)))
    trie = toxicity.Trie(terms)
    for _ in range(3000):
        word = "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))
        for edits in (0, 1, 2):
            near = [(distance(word, t), n) for n, t in enumerate(terms)]
            want = min((x for x in near if x[0] <= edits), default=None)
            assert trie.within(word, edits) == want


def model():
    return toxicity.Model(["idiot", "worthless"], [5.0, 4.0], frozenset(["idiom"]), [-3.0, 3.0, 3.0, 0.0, 0.0, 0.0, 0.0])


def test_misspelling_and_context():
    s = toxicity.Scorer(model())
    plain, misspelled = s.score("you utter idiot here"), s.score("you utter idjot here")
    quoted, clean = s.score('The paper printed "utter idiot here" again'), s.score("An idiom is no insult")
    assert plain > misspelled > clean
    assert plain > quoted > clean
    assert s.score("") == s.score("nothing at all")


def labelled(spark):
    r = random.Random(4)
    calm = [f"calm{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(300)]
    texts, toxic = [], []
    for _ in range(600):
        words = [r.choice(calm) for _ in range(40)]
        bad = r.random() < 0.3
        if bad:
            words[5:5] = [r.choice(["wretch", "swine", "vermin"]), r.choice(["wretch", "swinne", "vermim"])]
        texts.append(" ".join(words))
        toxic.append(int(bad))
    d = docs(spark, texts)
    return d, spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), toxic


def test_learns_from_its_fold_only(spark):
    d, labels, toxic = labelled(spark)
    m = toxicity.fit(d, labels)
    got = toxicity.score(clashing(d, "score", "predicted", "toxic"), m).collect()
    assert {r.doc_id: r.held_out for r in got} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(600)}
    right = [r.predicted == toxic[r.doc_id] for r in got if r.held_out]
    assert len(right) > 100 and sum(right) >= 0.97 * len(right)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    assert toxicity.fit(d, flipped) == m
    kept = toxicity.clean_documents(d, m)
    assert kept.schema == d.schema and kept.count() == sum(1 - r.predicted for r in got)


def test_odd_rows_and_no_labels(spark):
    table = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(table, toxicity.fit(table, none)).collect()
    assert len(got) == table.count() and all(0 <= r.score < 0.3 and r.predicted == 0 for r in got)
    assert toxicity.score(empty_docs(spark), model()).count() == 0
    assert toxicity.clean_documents(table, model()).count() == table.count()


def test_disguised_terms():
    scorer = toxicity.Scorer(toxicity.Model(["idiot", "worthless"], [5.0, 5.0]))
    for word in ("idiot", "idoit", "id1ot", "idot", "idiiot", "w0rthless", "i*iot"):
        assert word in scorer.hits(toxicity.WORD.findall(f"you {word}, he said")), word
    assert not scorer.hits(["idea", "worth", "patriot"])


def test_every_term_that_meets_the_odds_is_taken(spark):
    r = random.Random(8)
    letters = str.maketrans("0123456789", "abcdefghij")
    calm = lambda n: [f"calm{r.randrange(300)}".translate(letters) for _ in range(n)]
    texts = []
    for k in range(600):
        words = calm(30)
        if k % 3 == 0:
            # a fixed phrase, three terms of all of them, and one that only stands beside these
            words[5:5] = ["utter", "scoundrel", "indeed", *["wretch", "swine", "vermin"], *(["lout"] if k % 2 else [])]
        elif k % 3 == 1:
            words[5:5] = ["utter", "indeed"]
        texts.append(" ".join(words))
    copies = [" ".join([*calm(30), "bystander"])] * 40
    d = docs(spark, [*texts, *copies])
    labels = spark.createDataFrame([(k, int(k >= 600 or k % 3 == 0)) for k in range(640)], "doc_id long, toxic int")
    m = toxicity.fit(d, labels)
    assert {"scoundrel", "wretch", "swine", "vermin", "lout"} <= set(m.terms)
    assert "bystander" not in m.terms


def test_scores_do_not_rise_when_the_clean_class_is_thinned(spark):
    r = random.Random(3)
    letters = str.maketrans("0123456789", "abcdefghij")
    texts, toxic = [], []
    for k in range(4000):
        bad = k % 20 == 0
        words = [f"calm{r.randrange(200)}".translate(letters) for _ in range(20)]
        # the one term also stands in some clean documents, and not in all toxic ones
        if r.random() < (0.7 if bad else 0.05):
            words[5] = "wretch"
        texts.append(" ".join(words))
        toxic.append(int(bad))
    d = docs(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    whole, thinned = (toxicity.Scorer(toxicity.fit(d, labels, rows)) for rows in (8000, 130))
    for text in (texts[1].replace("wretch", "calma"), "calma wretch " + " ".join(["calma"] * 18)):
        z = [sum(b * x for b, x in zip(s.model.beta, s.features(text))) for s in (whole, thinned)]
        assert abs(z[0] - z[1]) < 1.5, z


def test_very_long_words_make_no_forms(spark):
    import tracemalloc

    scorer = toxicity.Scorer(model())
    long = "abcde" * 40_000
    tracemalloc.start()
    assert scorer.score(f"{long} you idiot {long}") > scorer.score(long)
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
