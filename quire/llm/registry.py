"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.chaining import op2_chained_passages
from quire.llm.collisions import op1_collision_search
from quire.llm.elias_fano import op10_elias_fano
from quire.llm.forced_bpe import op4_forced_bpe
from quire.llm.hard_negatives import OP11_SQL, op11_pq_negatives
from quire.llm.jaccard import op9_ngram_jaccard
from quire.llm.katz import op5_katz_backoff
from quire.llm.kd_search import op6_kd_search
from quire.llm.packing import op8_packing
from quire.llm.phrases import OP13_SQL, op13_suffix_phrases
from quire.llm.suffixes import op7_suffix_dedup
from quire.llm.toxicity import op3_toxicity
from quire.llm.wu_manber import OP12_SQL, op12_wu_manber


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_collision_search, op2_chained_passages, op3_toxicity, op4_forced_bpe, op5_katz_backoff, op6_kd_search, op7_suffix_dedup, op8_packing, op9_ngram_jaccard, op10_elias_fano, op11_pq_negatives, op12_wu_manber, op13_suffix_phrases]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_pq_negatives": OP11_SQL, "op12_wu_manber": OP12_SQL, "op13_suffix_phrases": OP13_SQL}
