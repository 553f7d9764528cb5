"""A cleaning pipeline over ``documents``: each stage takes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common, jaccard_join, packing, quality_rules, substring_dedup, tokens
from tidewatch.llm import toxicity as toxic

#: SQL cannot express the models and the search; the stages are tested against brute force.
ORACLE_SQL = None


def _with_row(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row's other columns as a struct, so that no column of an operator clashes with one of them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(F.struct(F.lit(0).alias(common.unused("_", docs.columns)), *others).alias("_row"), "doc_id", "text")


def _rows(rows: DataFrame, columns: list[str], **new) -> DataFrame:
    """The columns of rows that ``_with_row`` made, some of them new."""
    return rows.select(*[new.get(c, F.col(c) if c in ("doc_id", "text") else F.col(f"_row.`{c}`")).alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the toxicity model, learnt from the labels, does not call toxic.

    Null and empty texts score as texts without words. Rows are judged one by one, so repeated ones share
    their fate; without labels nothing is called toxic. An empty table gives an empty one.
    """
    model = toxic.fit(docs, common.read(spark, sf_dir, "labels"))
    rows = toxic.score(_with_row(docs), model)
    return _rows(rows.where(F.col("score") < toxic.THRESHOLD), docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality rules keep.

    Null, empty and short texts go, whatever the rules say. Rows are judged one by one; the rules'
    accuracies come from all of them. An empty table gives an empty one.
    """
    return _rows(quality_rules.judge(_with_row(docs), ["_row", "doc_id", "text"]).where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of documents linked by shared word shingles.

    Of rows equal in doc_id and text one is kept; rows of one doc_id with different texts are judged each by its own
    text. Rows without a doc_id are in no group and all stay, as do null and empty texts. An empty table gives an empty one.
    """
    first = jaccard_join.cluster(docs).where("doc_id = text_component").select("doc_id", F.col("twin").alias("_twin")).distinct()
    rows = _with_row(docs)
    # equal texts have equal twins: what the join dealt out by doc_id and twin need not be dealt again by its texts
    kept = rows.withColumn("_twin", jaccard_join.twin()).join(first, ["doc_id", "_twin"], "left_semi").dropDuplicates(["doc_id", "_twin", "text"])
    return _rows(kept.drop("_twin").unionByName(rows.where("doc_id is null")), docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out of the texts; what is left of a text, and texts that lose nothing, stay as they are.

    Null and empty texts and rows without a doc_id are not changed. An empty table gives an empty one.
    """
    clean = substring_dedup.dedup(_with_row(docs))
    return _rows(clean, docs.columns, n_chars=F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences: a row for each piece of a document.

    Null and empty texts have their end id alone; repeated rows and rows without a doc_id are packed as
    documents of their own. An empty table gives no pieces.
    """
    return packing.pack(common.saved(packing.cut(docs, tokens.vocabulary_path()), "pieces"))


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder before the next one reads it."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return docs
