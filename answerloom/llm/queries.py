"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from answerloom.llm.alignment import op12_tokenizer_alignment
from answerloom.llm.fingerprints import op8_document_fingerprints
from answerloom.llm.html_text import op4_html_extraction
from answerloom.llm.language import op2_language_id
from answerloom.llm import quality
from answerloom.llm.line_dedup import op5_line_dedup
from answerloom.llm.lm_score import op7_lm_scoring
from answerloom.llm.ngram_join import op9_ngram_jaccard_join
from answerloom.llm.packing import op1_best_fit_packing
from answerloom.llm.pieces import op10_sentencepiece
from answerloom.llm.quality import op6_quality_rules
from answerloom.llm.runs import op13_periodic_runs
from answerloom.llm.sharding import op11_bounded_ring
from answerloom.llm.toxicity import op3_toxicity

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_language_id, op3_toxicity, op4_html_extraction, op5_line_dedup, op6_quality_rules, op7_lm_scoring, op8_document_fingerprints, op9_ngram_jaccard_join, op10_sentencepiece, op11_bounded_ring, op12_tokenizer_alignment, op13_periodic_runs)}
ORACLE: dict[str, str] = {"op6_quality_rules": quality.SQL}
