import pytest
from pyspark.sql import functions as F

from quire.sources import coded
from quire.sources.shared import new_path

SCHEMA = "work long, position long, subtitle string, intro string, body string, post string"
TEXT = "<p>The same opening of a chapter, über and 日本語, number {0}.</p><p>Words that all the chapters of this work share, and {1}.</p>"


def rows():
    out = [(w, k, f"s{k}", None if k % 3 else f"<p>intro {k}</p>", "".join(TEXT.format(k, w * k + j) for j in range(20)), "" if k % 2 else f"<p>post of work {w}</p>") for w in (1, 2) for k in range(150)]
    return out + [(3, 1, "short", None, "x", None), (3, 1, "again", None, None, None), (None, 5, None, "a", "b", "c"), (4, None, "no place", "", "", "")]


@pytest.fixture(scope="module")
def path(spark):
    found = new_path(spark, "coded")
    coded.write_coded(spark.createDataFrame(rows(), SCHEMA), found, parts=8)
    return found


def test_round_trip(spark, path):
    assert sorted(map(tuple, coded.read_coded(spark, path, parts=8).collect()), key=repr) == sorted(rows(), key=repr)


def test_dictionaries_are_shared_and_help(spark, path):
    stored = spark.read.parquet(path)
    dictionaries = stored.filter("kind = 'dictionaries'").collect()
    assert 2 <= len(dictionaries) <= 8 and all(r.dict_id == coded.dictionary_id(bytes(r.dictionary)) and len(r.dictionary) <= 32768 and r.samples >= 4 for r in dictionaries)
    bodies = stored.filter("kind = 'sections' AND work IN (1, 2)").select(F.sum(F.octet_length("body"))).first()[0]
    plain = sum(len(coded.zstandard.ZstdCompressor(level=1).compress(r[4].encode())) for r in rows() if r[0] in (1, 2))
    assert bodies < 0.7 * plain
    assert stored.filter("work = 3 AND body_dict IS NOT NULL").isEmpty()  # too few texts


def test_one_work_is_read_from_its_folder(spark, path):
    found = coded.read_coded(spark, path, [2], parts=8)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((r for r in rows() if r[0] == 2), key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert physical.count("PartitionFilters: [(kind") + physical.count("PartitionFilters: [isnotnull(kind") >= 4


def test_a_missing_dictionary_is_an_error(spark, path):
    from pyspark.errors import PythonException

    lost = new_path(spark, "lost")
    spark.read.parquet(path).filter("kind = 'sections'").write.partitionBy("kind", "part").parquet(lost)
    with pytest.raises(PythonException, match="missing"):
        coded.read_coded(spark, lost, parts=8).collect()


def test_no_chapters(spark):
    found = new_path(spark, "none")
    coded.write_coded(spark.createDataFrame([], SCHEMA), found)
    assert coded.read_coded(spark, found).count() == 0
