"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import ships_package
from .katz import op1_katz
from .kdshards import OP9_SQL, op9_kdshards
from .mixing import OP8_SQL, op8_mix
from .neighbours import OP6_SQL, op6_nearest
from .simhash import op2_simhash
from .suffixes import op3_suffixes
from .templates import op7_templates
from .tokenfiles import op4_tokenfiles
from .toxicity import op10_toxicity
from .urlfilter import OP5_SQL, op5_urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_katz": op1_katz,
        "op2_simhash": op2_simhash,
        "op3_suffixes": op3_suffixes,
        "op4_tokenfiles": op4_tokenfiles,
        "op5_urlfilter": op5_urlfilter,
        "op6_nearest": op6_nearest,
        "op7_templates": op7_templates,
        "op8_mix": op8_mix,
        "op9_kdshards": op9_kdshards,
        "op10_toxicity": op10_toxicity,
    }
    return {name: ships_package(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op5_urlfilter": OP5_SQL, "op6_nearest": OP6_SQL, "op8_mix": OP8_SQL, "op9_kdshards": OP9_SQL}
