"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from .chaining import op6_chaining
from .decontamination import op4_decontamination
from .language import op3_language
from .mih import op1_mih
from .packing import op7_packing
from .pii import op8_pii
from .pitman_yor import op10_pitman_yor
from .quality import op9_quality
from .sharding import op5_sharding
from .simhash import op2_simhash

QUERIES = {f.__name__: f for f in (op1_mih, op2_simhash, op3_language, op4_decontamination, op5_sharding, op6_chaining, op7_packing, op8_pii, op9_quality, op10_pitman_yor)}
SQL: dict[str, str] = {}
