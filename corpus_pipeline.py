"""A training corpus from ``documents``: toxic texts go, near copies go, repeated passages go, secrets are masked, the rest is packed.

Each stage takes what its predecessor kept, written as Parquet and read again; a stage's table is deleted when the next
one's is written. All but the last return the columns of ``documents``; where a stage changes a text, ``n_chars`` follows.

Edge cases: null and empty texts are not toxic, link with nothing, hold no passage and no secret, and pack as a closing id;
rows that repeat an id are judged each by its own text, and stay or go together as near copies; an empty table gives an
empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import neardup, packing, secrets, substring, toxicity
from tributary.llm.shared import public_vocabulary, release, settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: texts that the model scores 0.5 or more are rejected."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8 on shingles of five words: the document with the smallest id of each group stays."""
    return neardup.without_copies(docs, shingle=5)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: words in windows that an earlier document has are removed; texts that lose words are the rest, joined by
    one space, and documents that lose all go."""
    return _recounted(substring.without_repeats(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every span is replaced by a mark; the document stays."""
    return _recounted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: pieces of at most 2,048 tokens with their places in sequences."""
    return packing.packed(docs, public_vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Learned scores, components and packing are beyond SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
