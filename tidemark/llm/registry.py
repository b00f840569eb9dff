"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .decontamination import op1_decontamination
from .jaccard_join import op9_jaccard_join
from .packing import op2_packing
from .personal_data import op6_personal_data
from .quality_model import op3_quality_model
from .quality_rules import op5_quality_rules
from .sharding import op4_sharding
from .substring_dedup import op8_substring_dedup
from .suffix_dedup import op13_suffix_dedup
from .token_files import op7_token_files
from .toxicity import op10_toxicity
from .vector_codes import op12_vector_codes
from .whitening import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_packing": op2_packing,
        "op3_quality_model": op3_quality_model,
        "op4_sharding": op4_sharding,
        "op5_quality_rules": op5_quality_rules,
        "op6_personal_data": op6_personal_data,
        "op7_token_files": op7_token_files,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_toxicity": op10_toxicity,
        "op11_whitening": op11_whitening,
        "op12_vector_codes": op12_vector_codes,
        "op13_suffix_dedup": op13_suffix_dedup,
        "base_statistics": oracles.base_statistics,
        "base_personal_data": oracles.base_personal_data,
        "base_deviations": oracles.base_deviations,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
