"""Five stages from raw documents to piece ids: toxicity, language, near-duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``, fewer rows; the last one
returns the encoded documents. A stage learns from what its predecessor kept, with ids, labels and folds as in the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate_lsa, langid_ecoc, sentencepiece_nbest, simhash_bk, toxicity_ftrl
from tidemark.llm.queries import PIECE_MODEL, language_codes, query, table, toxicity_model
from tidemark.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; one without text has no toxic word and stays."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity_ftrl.score(docs, model, out="__score").where("__score < 0.5").select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that is told apart from the others; texts without letters go."""
    found = langid_ecoc.identify(docs, language_codes(docs), out="__language")
    sure = (F.col("__language.lang") != langid_ecoc.UNKNOWN) & ~F.col("__language.ambiguous")
    return found.where(sure).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: three words, at most two bits apart."""
    return simhash_bk.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate_lsa.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids in place of their texts, with the scores of the best segmentations."""
    coded = sentencepiece_nbest.encode(docs.select("doc_id", "text", "lang", "source"), sentencepiece_nbest.load(PIECE_MODEL))
    return coded.select("doc_id", "lang", "source", "pieces.ids", F.size("pieces.ids").alias("n_pieces"), "pieces.scores", "pieces.exact")


STAGES = [("toxicity", drop_toxic), ("language_id", keep_languages), ("simhash", drop_near_copies),
          ("decontamination", drop_benchmark), ("sentencepiece", encode)]

#: Learnt scores, fingerprints and segmentations are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the five stages leave of the documents."""
    return run(spark, sf_dir)
