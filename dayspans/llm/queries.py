"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from .exact_topk import OP10_SQL, op10_exact_topk
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .html_extraction import op4_html_extraction
from .jaccard_join import OP5_SQL, op5_jaccard_join
from .mixing import OP1_SQL, op1_mixing
from .packing import op7_packing
from .pii import PII_BASE_SQL, op2_pii, pii_base_spans
from .quality_classifier import op3_quality_classifier
from .quality_rules import QUALITY_BASE_SQL, op6_quality_rules, quality_base
from .token_files import op13_token_files
from .toxicity import op9_toxicity
from .warc import OP8_SQL, op8_warc
from .whitening import op11_whitening

QUERIES = {"op1_mixing": op1_mixing, "op2_pii": op2_pii, "op3_quality_classifier": op3_quality_classifier, "op4_html_extraction": op4_html_extraction, "op5_jaccard_join": op5_jaccard_join, "op6_quality_rules": op6_quality_rules, "op7_packing": op7_packing, "op8_warc": op8_warc, "op9_toxicity": op9_toxicity, "op10_exact_topk": op10_exact_topk, "op11_whitening": op11_whitening, "op12_hard_negatives": op12_hard_negatives, "op13_token_files": op13_token_files, "pii_base_spans": pii_base_spans, "quality_base": quality_base}
ORACLE: dict[str, str] = {"op1_mixing": OP1_SQL, "op5_jaccard_join": OP5_SQL, "op8_warc": OP8_SQL, "op10_exact_topk": OP10_SQL, "op12_hard_negatives": OP12_SQL, "pii_base_spans": PII_BASE_SQL, "quality_base": QUALITY_BASE_SQL}
