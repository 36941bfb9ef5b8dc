import time

import pytest
from pyspark.sql import functions as F

from quire.functions import japanese as J


@pytest.mark.parametrize("step", [J.digits_near_letters, J.numbers, J.chapter_lines, J.border_lines, J.joined_brackets])
def test_work_grows_with_the_text(spark, step):
    """Four times the text takes about four times as long, not sixteen times."""
    part = "一Ａ二３人\n　12\n◇◇\n「あ\n『い\n』う」三Ｂ十2000円、"
    took = []
    for length in (10_000, 40_000):
        df = spark.createDataFrame([(part * (length // len(part)),)], "t string").repartition(1)
        best = None
        for _ in range(2):
            began = time.time()
            df.select(F.length(step(F.col("t")))).collect()
            best = min(best or 99, time.time() - began)
        took.append(best)
    assert took[1] < max(3.0, 8 * took[0])
