"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from floppyscope.llm import chat, decontaminate, linededup
from floppyscope.llm.html import op1_html
from floppyscope.llm.lm import op2_lm_score
from floppyscope.llm.packing import op5_packing
from floppyscope.llm.pii import op8_pii
from floppyscope.llm.quality import op9_quality
from floppyscope.llm.simhash import op6_simhash
from floppyscope.llm.tokenfiles import op10_tokenfiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_lm_score": op2_lm_score,
    "op3_chat": chat.op3_chat,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_tokenfiles": op10_tokenfiles,
}

#: DuckDB SQL for those that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_chat": chat.ORACLE_SQL,
    "op4_line_dedup": linededup.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
}
