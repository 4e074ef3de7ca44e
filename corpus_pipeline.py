"""The corpus pipeline: stages over documents, each written and reread before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinelake.llm._common import discard_since, materialize, n_written
from kinelake.llm.bpe import bpe_stage
from kinelake.llm.jaccard import jaccard_stage
from kinelake.llm.mixing import mixing_stage
from kinelake.llm.quality import quality_stage
from kinelake.llm.secrets import secrets_stage


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", bpe_stage),
]
#: The language model, the shingle joins and the draws of the mix are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written as Parquet and reread, what it used before goes."""
    mark = n_written()
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i < len(STAGES) - 1:
            df = materialize(df, f"stage{i}")
            discard_since(mark, df)
    return df
