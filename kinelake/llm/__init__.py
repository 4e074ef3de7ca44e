"""Corpus operators for training data.  Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinelake.llm import oracles
from kinelake.llm.bpe import op5_bpe
from kinelake.llm.jaccard import op7_jaccard
from kinelake.llm.media import op8_media
from kinelake.llm.mixing import op3_mixing
from kinelake.llm.quality import op2_quality
from kinelake.llm.secrets import op1_secrets
from kinelake.llm.substring import op9_substrings
from kinelake.llm.token_counts import op4_token_counts
from kinelake.llm.url_rules import OP6_SQL, op6_urls
from kinelake.llm.warc import op10_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_quality, op3_mixing, op4_token_counts, op5_bpe, op6_urls, op7_jaccard, op8_media, op9_substrings, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op6_urls": OP6_SQL, "op7_jaccard": oracles.OP7, "op9_substrings": oracles.OP9, "op10_warc": oracles.OP10}
