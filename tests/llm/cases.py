"""Small document tables with the cases that every operator must bear."""

from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n\t  \r\n",
    "a",
    "don't can't we'll 'tis rock'n'roll ''quoted''",
    "two  spaces   three\t\ttabs\n\nlines \n end ",
    "café naïve über straße 你好世界 こんにちは \U0001f600\U0001f468‍\U0001f469",
    "nbsp  here　 and there  line\x1c sep\x85 next",
    "<|endoftext|>mid<|endoftext|>  tail <|startoftext|>x",
    "é combining ́ alone ẛ̣",
    "x" * 3000 + " " * 50 + "1234567890" * 40 + "!?,.;:'\"" * 30,
    "\x00\x01\x7f control",
    "ABC abc AbC",
]


def odd_docs(spark, repeat=2):
    """Each odd text ``repeat`` times, with ties, repeated rows and a null id."""
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(ODD_TEXTS * repeat)]
    rows += [rows[5], rows[5], (None, "a row without an id", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """``df`` with extra columns named like an operator's own."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA)


__all__ = ["ODD_TEXTS", "SCHEMA", "T", "clashing", "docs", "empty_docs", "odd_docs"]
