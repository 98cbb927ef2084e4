"""The pipeline that makes packed training sequences of a table of documents.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, whatever further columns docs has.
Stages make their own tables in the shared folder, so that lost executors cost the tasks they ran and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import language_id, near_text, packing, quality_rules, substring_dedup
from quillstone.llm.common import held_out, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose main language has a smaller share than this is no text of that language.
LEAST_SHARE = 0.4
#: The rule of the near-duplicate stage; op8 has its own.
NEAR = near_text.NearConfig(shingle=5, least=0.8)


def _with_text(docs: DataFrame, text) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language is known and has LEAST_SHARE of the n-grams. Null texts and texts without letters go.

    The model is fitted on the rows of docs that aren't held out and name their language; where none does, nothing is known
    and all with letters stay, for want of a verdict.
    """
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.where(r"text rlike '\\p{L}'")
    found = language_id.identify(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed."""
    found = quality_rules.clean(docs.select(*COLUMNS)).where("quality.kept")
    return _with_text(found, F.col("quality.clean_text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id. Near-duplicates have word shingles of a Jaccard
    similarity of NEAR.least or more, and what they are near of. Documents without an id can't be told apart and stay."""
    return near_text.first_of_groups(docs.select(*COLUMNS), NEAR)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold; those of which no word is left go."""
    found = substring_dedup.dedup(docs.select(*COLUMNS)).where("n_removed = 0 OR n_removed < n_words")
    return _with_text(found, F.col("clean_text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and their place there."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express mixtures fitted per document or best-fit packing; a brute-force version is in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
