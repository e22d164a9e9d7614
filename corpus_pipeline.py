"""Cleans and packs a corpus: each stage takes what its predecessor kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of
``docs``; every column is carried through, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.llm import contextual_pii, packing, parity_join, toxic_neighbours, wu_manber
from medialake.llm.common import table, written


#: Bytes of an Arrow batch. Rows carry whole texts, and a task holds several batches on either side of its Python worker.
BATCH_BYTES = 1 << 20


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row as one column beside those that an operator reads, so names can't clash."""
    return docs.select(F.struct("*").alias("_row"), *columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that look like labelled toxic ones go.

    A null or empty text has no words to be judged by and stays; rows of a null or repeated id are judged by their own
    text; an empty table stays empty.
    """
    _small_batches(spark)
    model = toxic_neighbours.learn(docs, table(spark, sf_dir, "labels"))
    return toxic_neighbours.score(_rows(docs, "text"), model, keep=["_row"]).where(F.col("score") < 0.5).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 on five-word shingles, the row with the smallest id stays.

    Rows are linked by a number of their own, so an id that occurs with several texts loses only the copies among them,
    and a null id (which comes last) can go as well; of rows with the same id the first of the table stays. Texts
    without words are linked with nothing and stay.
    """
    _small_batches(spark)
    numbered = written(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_number")), "numbered")
    texts = numbered.select("_number", F.col("_row.text").alias("text"))
    classes = written(parity_join.linked_classes(texts, doc_id="_number").select(F.col("doc_id").alias("_number"), "component_id"), "row-classes")
    named = classes.join(numbered.select("_number", F.col("_row.doc_id").alias("id")), "_number")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_number"))
    kept = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first._number").alias("_number"))
    gone = written(classes.join(kept, "_number", "left_anti").select("_number"), "gone")
    # Rows that surely stay pass where they are; no text but those of the others is dealt out.
    may_go, stay = parity_join.may_hold(numbered, gone, "_number")
    return stay.unionByName(may_go.join(gone, "_number", "left_anti")).select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    A null or wordless text has no window and stays; each row of a repeated or null id is judged by itself.
    """
    _small_batches(spark)
    hits = wu_manber.find_hits(_rows(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["_row"])
    return hits.where(F.col("n_hit") == 0).select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text.

    No row goes. A null text stays null (its ``n_chars`` becomes null, too); ids aren't read.
    """
    _small_batches(spark)
    found = contextual_pii.find(_rows(docs, "text"), contextual_pii.learn(docs), keep=["_row"], mask=True)
    new = {"text": F.col("masked"), "n_chars": F.char_length("masked").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens' places in training sequences: every row's text and end token, a null text being empty."""
    _small_batches(spark)
    return packing.packing_report(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packed)]

#: Toxicity, personal data and packing can't be expressed in SQL; tests hold the second and third stage against brute force, packing against a round trip.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
