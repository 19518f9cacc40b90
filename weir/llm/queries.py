"""The corpus operators' queries, by name; SQL cannot express any of them whole, so their tests use brute force."""

from __future__ import annotations

from .compaction import op9_compaction
from .crf import op2_crf
from .ctw import op10_ctw
from .licences import op4_licences
from .mixing import op1_mixture
from .quality import op5_quality
from .rindex import op3_rindex
from .simhash import op7_simhash
from .tiling import op8_tiling
from .tokens import op6_tokens

QUERIES = {f.__name__: f for f in (op1_mixture, op2_crf, op3_rindex, op4_licences, op5_quality, op6_tokens, op7_simhash, op8_tiling, op9_compaction, op10_ctw)}
ORACLE: dict[str, str] = {}
