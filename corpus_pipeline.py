"""A corpus pipeline: language, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the last return the columns of
documents. Null and empty texts have no language and go in the first stage. Of each group of near duplicates the row with the
smallest id stays (then by hash of the text, source, language and length; a null id comes last), whatever else has that id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binframe.llm import bpe, decontaminate, jaccard_join, langid, pii
from binframe.llm._util import spill, table

#: A document goes when its language can't be told, or is told with less certainty than this.
LEAST_SCORE = 0.2
#: Near duplicates share this percentage of their shingles of so many words; op8's setting is its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language; ``lang`` becomes the language that was found."""
    model = langid.train(docs)
    found = langid.predict(docs, model)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked ones: the one with the smallest id, among equal ids the smallest hash of the text.

    Documents are told apart by id and text, so that another text under the id of one that goes stays.
    """
    joined = jaccard_join.join(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)
    heads = joined.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head")).select("head.row")
    rows = heads.union(joined.where("component is null").select("row")).distinct()
    row = "__row"
    kept = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).join(rows.withColumnRenamed("row", row), row, "left_semi")
    # Copies under one id: one stays. Ids are unique in a sound table, so that this deals rows evenly.
    one = Window.partitionBy(row).orderBy("source", "lang", "n_chars")
    return kept.withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no window of a benchmark item stands."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("items") == 0).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_tokens and digests of the ids and of the decoded text."""
    return bpe.round_trip(docs, keep=["doc_id", "lang", "source"])


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("tokens", tokens)]

#: Learned predictions and byte-pair ids can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
