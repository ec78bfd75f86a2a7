"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes what a
stage returns and gives it, read back, to the next one.  All but the last return
the columns of `documents`; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventtally.llm import language_id, line_dedup, minhash, packing, substring_dedup
from eventtally.llm.tables import share_package, stage, table

#: No SQL expresses trained profiles, signatures or tokens; tests hold the stages against brute force.
ORACLE_SQL = None

#: A document below this cosine with every language is in none of them: four standard errors of what unrelated vectors
#: of that width have.  With fewer distinct n-grams than GRAMS the bound falls in proportion, as then a text of a
#: learned language need not come near it.
LEAST_COSINE, GRAMS = 0.125, 100

#: A line is boilerplate of a source if it is on a tenth of its distinct texts, and on so many of them: in a source
#: of a few documents one line of one of them is a tenth already.
LEAST_PAGES = 5


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or resemble no language; learned from the rows that name theirs.
    If no row does, all stay."""
    share_package(spark)
    model = language_id.learn(docs)
    found = language_id.identify(docs, model, columns=("__lang", "__score", "__grams"))
    least = F.least(F.col("__grams") / F.lit(float(GRAMS)), F.lit(1.0)) * LEAST_COSINE
    rejected = (F.col("__lang") == language_id.UNKNOWN) | (F.col("__score") < least)
    return found.where(~rejected if model[0] else F.lit(True)).select(docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that too many documents of a source share; copies count as one."""
    return _recounted(line_dedup.drop_boilerplate(docs, least_pages=LEAST_PAGES, distinct_pages=True)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id; of rows with equal id and text one.
    Rows with one id and different texts are documents of their own."""
    share_package(spark)
    found = minhash.near_duplicates(docs, text_hash="__text").where(~F.col("kept"))
    gone = found.select(F.col("id").alias("__gone"), "__text").distinct()
    same = (F.col("doc_id") == F.col("__gone")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__text"))
    return docs.join(gone, same, "left_anti").dropDuplicates(["doc_id", "text"])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without long passages that an earlier document has, and without documents that this leaves empty."""
    share_package(spark)
    cut = substring_dedup.drop_repeated(docs, counts=("__words", "__removed"))
    return _recounted(cut.where((F.col("__removed") == 0) | (F.col("__removed") < F.col("__words"))).select(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their token ids."""
    share_package(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("minhash", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
