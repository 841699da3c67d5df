"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op2_chat_formatting
from .decontaminate import op1_decontamination
from .exact import op6_fingerprints
from .langid import op10_language_id
from .lines import op8_line_dedup
from .near_dup import op9_near_dedup
from .packing import op3_best_fit_packing
from .pii import op4_personal_data
from .quality import OP11_SQL, op11_quality_rules
from .runs import op12_periodic_runs
from .substrings import op5_suffix_dedup
from .warc import OP7_SQL, op7_warc
from .whitening import op13_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_chat_formatting, op3_best_fit_packing, op4_personal_data, op5_suffix_dedup, op6_fingerprints, op7_warc, op8_line_dedup, op9_near_dedup, op10_language_id, op11_quality_rules, op12_periodic_runs, op13_embedding_whitening)
}

ORACLE_SQL: dict[str, str] = {"op7_warc": OP7_SQL, "op11_quality_rules": OP11_SQL}
