"""Queries of the corpus operators, and the SQL that some of them are held against."""

from __future__ import annotations

from . import lexical, oracle, warc
from .alignment import op13_cross_tokenizer
from .bpe import op9_bpe
from .lexical import op12_impact_ranking
from .licenses import op10_license_scan
from .mixing import op2_source_mixing
from .mixing import oracle_sql as mixing_sql
from .ngram_join import op1_ngram_join
from .pii import op7_personal_data
from .secrets import op4_secret_scan
from .suffix_dedup import op5_suffix_dedup
from .toxicity import op3_toxicity
from .vectors import op6_block_topk, op8_additive_quantisation
from .warc import op11_warc_histories

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_source_mixing": op2_source_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_block_topk": op6_block_topk,
    "op7_personal_data": op7_personal_data,
    "op8_additive_quantisation": op8_additive_quantisation,
    "op9_bpe": op9_bpe,
    "op10_license_scan": op10_license_scan,
    "op11_warc_histories": op11_warc_histories,
    "op12_impact_ranking": op12_impact_ranking,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}
ORACLE: dict[str, str] = {
    "op1_ngram_join": oracle.ngram_components(),
    "op2_source_mixing": mixing_sql(),
    "op6_block_topk": oracle.top_inner_products(),
    "op11_warc_histories": warc.oracle_sql(),
    "op12_impact_ranking": lexical.oracle_sql(),
}
