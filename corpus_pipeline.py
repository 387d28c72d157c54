"""The corpus pipeline: five filtering and encoding stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, written as Parquet and read again. All but the
last return the columns of ``documents``. A table with the same ids in several rows keeps or drops each row by its own text,
but for near duplicates, of which the row with the smallest id (and of equal ids one) stays.

1. quality: rows that the rules or the perplexity bands reject go; the first model is learnt from all rows labelled good.
2. toxicity: rows with a score of 0.5 or more go; learnt from the labelled rows among those that are left.
3. near duplicates: of each group of rows whose SimHash fingerprints (three-word shingles) are linked at two or fewer differing bits one row stays.
4. decontamination: rows in which a benchmark item stands go.
5. pieces: what is left, encoded: doc_id, n_tokens, ids_sha256, decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsweave.llm import decontaminate, pieces, quality, simhash, toxicity
from newsweave.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_rows(docs, labels=table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="_score", evidence="_evidence").where("_score < 0.5").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs, pieces.default_model())


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", dedup_stage), ("decontamination", decontamination_stage),
          ("pieces", pieces_stage)]

#: Models, fingerprints and encodings are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
