"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from mediaops.llm.ann_search import op4_ann_search
from mediaops.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from mediaops.llm.lexical_search import OP11_SQL, op11_lexical_search
from mediaops.llm.lm_scoring import op6_lm_scoring
from mediaops.llm.mixing import OP8_SQL, op8_mix_sources
from mediaops.llm.packing import op2_packing
from mediaops.llm.secrets import op1_secret_scan
from mediaops.llm.simhash import op5_simhash_dedup
from mediaops.llm.spelling import OP12_SQL, op12_spelling_variants
from mediaops.llm.substring_dedup import op3_substring_dedup
from mediaops.llm.token_files import op9_token_files
from mediaops.llm.toxicity import op10_toxicity
from mediaops.llm.warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ann_search": op4_ann_search,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_token_files": op9_token_files,
    "op10_toxicity": op10_toxicity,
    "op11_lexical_search": op11_lexical_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_warc": op13_warc,
}

ORACLES = {
    "op7_exact_dedup": OP7_SQL,
    "op8_mix_sources": OP8_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_warc": OP13_SQL,
}
