"""The queries of this package, and the oracle SQL of those that SQL can express."""

from __future__ import annotations

from tarnlake.llm import decontam
from tarnlake.llm.ann import op3_ann
from tarnlake.llm.decontam import op8_decontamination
from tarnlake.llm.langid import op4_language_id
from tarnlake.llm.lm import op2_lm_score
from tarnlake.llm.packing import op7_packing, pack_conversations
from tarnlake.llm.quality import op5_quality
from tarnlake.llm.secret_scan import op1_secret_scan
from tarnlake.llm.simhash import op6_simhash
from tarnlake.llm.suffix import op10_suffix_dedup
from tarnlake.llm.tokenbin import op9_token_output

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_lm_score, op3_ann, op4_language_id, op5_quality, op6_simhash, op7_packing, op8_decontamination, op9_token_output, op10_suffix_dedup, pack_conversations)}
ORACLES: dict[str, str] = {"op8_decontamination": decontam.ORACLE}
