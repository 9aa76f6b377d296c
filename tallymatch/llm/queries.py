"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tallymatch.llm.alignment import op11_alignment
from tallymatch.llm.factorisation import op13_factorisation
from tallymatch.llm.hnsw import op8_hnsw
from tallymatch.llm.html_text import op9_html_extraction
from tallymatch.llm.line_dedup import OP3_SQL, op3_line_dedup
from tallymatch.llm.ngram_join import op10_ngram_jaccard_join
from tallymatch.llm.packing import op1_packing
from tallymatch.llm.quality import op2_quality_rules
from tallymatch.llm.sentencepiece_viterbi import op7_sentencepiece
from tallymatch.llm.shared_search import OP12_SQL, op12_shared_search
from tallymatch.llm.substring_dedup import op6_substring_dedup
from tallymatch.llm.suffix_tree import op4_lm_scoring
from tallymatch.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_hnsw": op8_hnsw,
    "op9_html_extraction": op9_html_extraction,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_alignment": op11_alignment,
    "op12_shared_search": op12_shared_search,
    "op13_factorisation": op13_factorisation,
}

SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op12_shared_search": OP12_SQL}
