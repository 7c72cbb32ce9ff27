"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.attribution import op6_token_counts
from tidemill.llm.decontaminate import op7_decontamination
from tidemill.llm.language import op5_language_id
from tidemill.llm.neardup import op4_hyperminhash
from tidemill.llm.permutation import op10_permutation_ann
from tidemill.llm.pieces import op3_sentencepiece
from tidemill.llm.ppm import op2_ppm
from tidemill.llm.secrets import op8_secret_scan
from tidemill.llm.toxicity import op1_toxicity
from tidemill.llm.urllists import ORACLE, op9_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_ppm": op2_ppm,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_hyperminhash": op4_hyperminhash,
        "op5_language_id": op5_language_id,
        "op6_token_counts": op6_token_counts,
        "op7_decontamination": op7_decontamination,
        "op8_secret_scan": op8_secret_scan,
        "op9_url_filters": op9_url_filters,
        "op10_permutation_ann": op10_permutation_ann,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filters": ORACLE}
