"""The queries of this package and their SQL, for the driver's entry file."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from llm import exact_dedup, fingerprints, katz, packing, pieces, pii, simhash, substrings, suffixes, toxicity
from llm.common import home

Query = Callable[[SparkSession, str], DataFrame]


def importable(query: Query) -> Query:
    """query, with this package on the path of Python workers that start from now on."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, env = os.path.dirname(home()), spark.sparkContext.environment
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = [
        pii.op1_personal_data,
        exact_dedup.op2_exact_dedup,
        toxicity.op3_toxicity,
        packing.op4_lexical_packing,
        simhash.op5_simhash_near_dedup,
        substrings.op6_substring_dedup,
        katz.op7_katz_scores,
        fingerprints.op8_fingerprints,
        pieces.op9_sentencepiece,
        suffixes.op10_suffix_dedup,
    ]
    return {q.__name__: importable(q) for q in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.OP2_SQL, "op6_substring_dedup": substrings.OP6_SQL, "op10_suffix_dedup": suffixes.OP10_SQL}
