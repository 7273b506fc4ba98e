"""Queries and their SQL of this subpackage, for the driver."""

from __future__ import annotations

from .decontam import OP4_SQL, op4_decontam
from .html_extract import op1_html_extract
from .packing import op3_packing
from .quality_lines import OP2_SQL, op2_quality_lines
from .secrets import OP5_SQL, op5_secrets
from .sharding import op10_sharding
from .simhash import op8_simhash
from .token_output import op9_token_output
from .token_rollup import op7_token_rollup
from .toxicity import op6_toxicity

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_quality_lines": op2_quality_lines,
    "op3_packing": op3_packing,
    "op4_decontam": op4_decontam,
    "op5_secrets": op5_secrets,
    "op6_toxicity": op6_toxicity,
    "op7_token_rollup": op7_token_rollup,
    "op8_simhash": op8_simhash,
    "op9_token_output": op9_token_output,
    "op10_sharding": op10_sharding,
}
ORACLE_SQL: dict[str, str] = {"op2_quality_lines": OP2_SQL, "op4_decontam": OP4_SQL, "op5_secrets": OP5_SQL}
