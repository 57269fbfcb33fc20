"""The queries of this subpackage, by name, and SQL for those that it can express."""

from __future__ import annotations

from recallgrid.llm.decontaminate import op9_decontamination
from recallgrid.llm.fim import OP12_SQL, op12_fill_in_middle
from recallgrid.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from recallgrid.llm.licenses import OP3_SQL, op3_license_scan
from recallgrid.llm.lm import op7_lm_scoring
from recallgrid.llm.mixing import OP4_SQL, op4_mixing
from recallgrid.llm.near_vectors import OP11_SQL, op11_near_vectors
from recallgrid.llm.ngram_join import op1_ngram_join
from recallgrid.llm.pii import op10_pii_scan
from recallgrid.llm.quality import op8_quality_rules
from recallgrid.llm.secrets import op5_secret_scan
from recallgrid.llm.suffix_dedup import op2_suffix_dedup
from recallgrid.llm.toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_suffix_dedup, op3_license_scan, op4_mixing, op5_secret_scan, op6_toxicity, op7_lm_scoring, op8_quality_rules, op9_decontamination, op10_pii_scan, op11_near_vectors, op12_fill_in_middle, op13_hard_negatives)}
SQL = {"op3_license_scan": OP3_SQL, "op4_mixing": OP4_SQL, "op11_near_vectors": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_hard_negatives": OP13_SQL}
