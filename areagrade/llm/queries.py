"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from areagrade.llm.bpe import op8_bpe
from areagrade.llm.hnsw import op9_hnsw
from areagrade.llm.hosts import op2_sql, op2_url_filter
from areagrade.llm.leaks import op4_decontamination
from areagrade.llm.licences import op10_licence_scan, op10_sql
from areagrade.llm.lines import OP1_SQL, op1_line_dedup
from areagrade.llm.middle import OP11_SQL, op11_fill_in_middle
from areagrade.llm.near import op3_jaccard_join
from areagrade.llm.ppm import op5_ppm
from areagrade.llm.resample import OP12_SQL, op12_importance_resampling
from areagrade.llm.shards import op7_kd_shards
from areagrade.llm.simhash import op13_simhash
from areagrade.llm.toxicity import op6_toxicity

LLM_QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_decontamination": op4_decontamination,
    "op5_ppm": op5_ppm,
    "op6_toxicity": op6_toxicity,
    "op7_kd_shards": op7_kd_shards,
    "op8_bpe": op8_bpe,
    "op9_hnsw": op9_hnsw,
    "op10_licence_scan": op10_licence_scan,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_simhash": op13_simhash,
}
LLM_ORACLE = {
    "op1_line_dedup": OP1_SQL,
    "op2_url_filter": op2_sql(),
    "op10_licence_scan": op10_sql(),
    "op11_fill_in_middle": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}
