"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bitsliced import ORACLE as OP5_SQL
from .bitsliced import op5_bit_sliced_topk
from .langid import op9_language_id
from .licences import op7_licence_scan
from .licences import oracle as op7_sql
from .maintext import op6_main_text
from .mixing import TARGETS_SQL, mix_targets, op1_source_mix
from .multiindex import op10_multi_index_ann
from .packing import op4_best_fit_packing
from .ppm import baseline_sql, op8_ppm_score, token_baseline
from .simhash import op2_simhash_neardup
from .warc import ORACLE as OP3_SQL
from .warc import op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_simhash_neardup": op2_simhash_neardup,
    "op3_warc": op3_warc,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_bit_sliced_topk": op5_bit_sliced_topk,
    "op6_main_text": op6_main_text,
    "op7_licence_scan": op7_licence_scan,
    "op8_ppm_score": op8_ppm_score,
    "op9_language_id": op9_language_id,
    "op10_multi_index_ann": op10_multi_index_ann,
}

#: Parts of op1's and op8's rows that SQL can express, where it can't express all of them.
PARTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "mix_targets": mix_targets,
    "token_baseline": token_baseline,
}

ORACLE_SQL: dict[str, str] = {
    "mix_targets": TARGETS_SQL,
    "token_baseline": baseline_sql(),
    "op3_warc": OP3_SQL,
    "op5_bit_sliced_topk": OP5_SQL,
    "op7_licence_scan": op7_sql(),
}
