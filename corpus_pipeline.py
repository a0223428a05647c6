"""The corpus pipeline: quality, line dedup, near-dedup, mixing, encoding. Each stage takes (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import lines, mixing, neartext, pieces, quality
from vantage.llm.common import cut, table


def shielded(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names, which an operator would replace, under other names; and how to undo that."""
    kept = {c: mixing.fresh(f"kept_{c}", docs.columns) for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(kept), {v: k for k, v in kept.items()}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of docs that are not held out.

    Null texts count as empty; repeated rows and rows without doc_id are scored like any other; an empty table stays empty;
    columns of the operator's names keep the caller's values.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    own, back = shielded(docs, "quality_score")
    return quality.score(own, model).where(F.col("quality_score") >= quality.THRESHOLD).drop("quality_score").withColumnsRenamed(back).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text where a line went.

    Null and empty texts come back as the empty text; repeated rows count as documents; an empty table stays empty; columns
    of the operator's names keep the caller's values.
    """
    own, back = shielded(docs, "n_lines", "n_dropped", "__drops")
    out = lines.dedup_lines(own)
    out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_dropped").withColumnsRenamed(back).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 and more) the smallest doc_id stays.

    Null and empty texts are one group; rows equal in doc_id and text stay once; rows without doc_id stay; an empty table
    stays empty.
    """
    return neartext.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a document stands there as often as the mix takes it.

    Null sources are one source, the last; documents without words go with their block; repeated rows are taken together;
    an empty table stays empty.
    """
    return mixing.mix(docs, places=False)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded of every row of the mix. Null texts count as empty; an empty table gives no rows."""
    return pieces.encode_decode(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL can't express the classifier, XXH64 fingerprints or the encoding. Tests hold line dedup and, at its production
#: settings, the near-duplicate stage against brute force; the quality and mixing operators have tests of their properties only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
