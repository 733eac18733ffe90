"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.ann import op3_cross_polytope
from tallyframe.llm.bottom_k import op13_bottom_k
from tallyframe.llm.chat import op8_chat_fsm
from tallyframe.llm.exponion import op11_exponion_codes
from tallyframe.llm.kd_shards import op6_kd_shards
from tallyframe.llm.mixing import op1_mix_ipf
from tallyframe.llm.media import op10_matroska
from tallyframe.llm.ngram_join import op7_ngram_jaccard
from tallyframe.llm.packing import op4_pack_ffd
from tallyframe.llm.pii import op9_pii_boosted
from tallyframe.llm.runs import op12_harmonic_runs
from tallyframe.llm.toxicity import op2_toxicity_nnpu
from tallyframe.llm.url_lists import OP5_SQL, op5_url_asof

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_ipf, op2_toxicity_nnpu, op3_cross_polytope, op4_pack_ffd, op5_url_asof, op6_kd_shards, op7_ngram_jaccard, op8_chat_fsm, op9_pii_boosted, op10_matroska, op11_exponion_codes, op12_harmonic_runs, op13_bottom_k)}

ORACLE_SQL: dict[str, str] = {"op5_url_asof": OP5_SQL}
