"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.ann import op12_ann
from tallyframe.llm.bpe import op2_bpe
from tallyframe.llm.fim import ORACLE_OP11, op11_fim
from tallyframe.llm.htmltext import op7_html
from tallyframe.llm.jaccard import op8_jaccard
from tallyframe.llm.langid import op10_langid
from tallyframe.llm.mixing import ORACLE_OP3, op3_mixing
from tallyframe.llm.periodic import op13_runs
from tallyframe.llm.sharding import op9_sharding
from tallyframe.llm.simhash import op6_simhash
from tallyframe.llm.suffixdedup import op4_suffix_dedup
from tallyframe.llm.tokencount import op5_tokencount
from tallyframe.llm.topk import ORACLE_OP1, op1_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_topk, op2_bpe, op3_mixing, op4_suffix_dedup, op5_tokencount, op6_simhash, op7_html, op8_jaccard, op9_sharding, op10_langid, op11_fim, op12_ann, op13_runs)
}
ORACLES: dict[str, str] = {"op1_topk": ORACLE_OP1, "op3_mixing": ORACLE_OP3, "op11_fim": ORACLE_OP11}
