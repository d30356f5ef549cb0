"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from .decontaminate import OP2_SQL, op2_decontaminate
from .langid import op9_language_id
from .lm import op6_lm_scoring
from .media import op7_media
from .packing import op5_packing
from .pii import op3_pii
from .secrets import OP10_SQL, op10_secrets
from .sharding import op8_sharding
from .simhash import op1_simhash
from .warc import OP4_SQL, op4_warc_revisits


def queries():
    return {
        "op1_simhash": op1_simhash,
        "op2_decontaminate": op2_decontaminate,
        "op3_pii": op3_pii,
        "op4_warc_revisits": op4_warc_revisits,
        "op5_packing": op5_packing,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_media": op7_media,
        "op8_sharding": op8_sharding,
        "op9_language_id": op9_language_id,
        "op10_secrets": op10_secrets,
    }


def oracle_sql():
    return {"op2_decontaminate": OP2_SQL, "op4_warc_revisits": OP4_SQL, "op10_secrets": OP10_SQL}
