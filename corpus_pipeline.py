"""A corpus pipeline: language identification, near-duplicate removal, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents. Empty inputs give empty outputs; columns beyond those of documents pass through all but the last. Null and empty texts have no language and
go in the first stage. Rows that repeat a doc_id and text become one in the second, also for ties; unlike texts stay, also under one doc_id or a
null one. A null lang, source or doc_id keeps no row out. Very long texts are worked on whole; the last stage cuts their tokens in pieces of a sequence's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import langid, minhash, packing, pii
from curatrix.llm.common import Scratch, read
from curatrix.llm.queries import SAMPLE_KEY

#: Documents whose language has a smaller score are rejected, and those without a letter.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; a null lang becomes the predicted one."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = langid.train(docs.where(fold != 0), "text", "lang", "doc_id")
    told = langid.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs, "doc_id", "text", k=5, percent=80).select(*docs.columns)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data under the session's key (pii.SETTING), or one for invented tables; n_chars follows the text."""
    made = pii.pseudonymise(docs, "text", pii.key_of(spark, SAMPLE_KEY), count=None)
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", pii_pseudonyms),
    ("packing", best_fit_packing),
]

#: No SQL: training, merging of token pairs and packing are iterative. tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
