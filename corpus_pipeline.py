"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's input.

Stages 1 to 4 return the columns of documents. Null texts pass every filter: they aren't toxic, near-duplicate or
contaminated, add no words to the mix and are a lone end-of-document id in the packed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.common import Scratch, broadcast_if, fresh, table
from offerloom.llm.decontamination import remove_contaminated
from offerloom.llm.jaccard import COPIES_BROADCAST, jaccard_components
from offerloom.llm.mixing import by_length, mixed_rows
from offerloom.llm.packing import pack_tokens
from offerloom.llm.toxicity import keep_clean, train

#: Toxicity and packing run models and tokenisers; SQL can't express them.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go."""
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles with a similarity of 0.75 or more, the document with the smallest id
    stays. Rows that repeat an id are one document, of which the row stays that is first by the hash of its text and then by its
    columns as JSON; rows without an id all stay."""
    classes = Scratch(spark, "near").save(jaccard_components(docs).where("doc_id IS NOT NULL"), "classes")
    others = classes.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(broadcast_if(others, COPIES_BROADCAST), "doc_id", "left_anti").select(*docs.columns)
    if classes.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.to_json(F.struct(*docs.columns))))
    number = fresh(docs.columns, "row_of_id")
    return kept.withColumn(number, F.when(F.col("doc_id").isNull(), 1).otherwise(first)).where(F.col(number) == 1).drop(number)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in shares by weight, longer documents likelier; a document taken twice is two rows."""
    return mixed_rows(docs, propensity=by_length(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return pack_tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mix", mix),
    ("token_pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
