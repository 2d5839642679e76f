"""The queries of this subpackage and their SQL, for the driver's entry file."""

from __future__ import annotations

from .fingerprint import op4_fingerprint
from .html import op6_html_extract
from .language_id import op9_language_id
from .licenses import OP8_SQL, op8_license_scan
from .mixing import op7_mixing
from .near_dedup import op1_minhash_dedup
from .pieces import op10_sentencepiece
from .quality import op3_quality
from .token_output import op5_token_output
from .topk import OP2_SQL, op2_topk_search

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_topk_search": op2_topk_search,
    "op3_quality": op3_quality,
    "op4_fingerprint": op4_fingerprint,
    "op5_token_output": op5_token_output,
    "op6_html_extract": op6_html_extract,
    "op7_mixing": op7_mixing,
    "op8_license_scan": op8_license_scan,
    "op9_language_id": op9_language_id,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLES = {"op2_topk_search": OP2_SQL, "op8_license_scan": OP8_SQL}
