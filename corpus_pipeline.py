"""The corpus pipeline: toxicity, quality rules, line deduplication, SimHash near-duplicates, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in the shared folder and
read again as the next stage's docs. All but the last return the columns of documents, with n_chars counted anew
where a stage changes texts. Part of the subpackage loadspan.llm.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadspan.llm import lines, packing, quality, simhash, toxicity
from loadspan.llm.tables import parquet, recorded, removed, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the operators of earlier stages wrote for their own use.
_left: list[str] = []


def stage(f: Stage) -> Stage:
    """f, after it has deleted what the stages before it wrote for their own use: docs is a table by then.

    Tables that docs is still read from stay, should it be none.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left[:] = removed(spark, _left, docs)
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


@stage
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a score of at least 0.5; the model learns from labelled rows of docs that are not held out.

    Null and empty texts score as texts without toxic tokens and stay; rows that repeat fare alike, and a null key is
    only no key to learn by. No rows give no rows.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), parquet(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("score < 0.5").select(*COLUMNS)


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and are probably good.

    Null and empty texts have no words, which fails the base rules: they go. Rows that repeat fare alike, whatever
    their key. No rows give no rows.
    """
    return quality.judged(docs).where("kept").select(*COLUMNS)


@stage
def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that are similar to earlier ones; documents that had lines and lose all of them go.

    Ties go to the least key (null first), then the place in the text. Rows that repeat key and text keep the same
    lines. Null and blank texts have no lines and stay, and so does a null n_chars where the text is null.
    """
    found = lines.deduplicated(docs).where("n_kept > 0 or n_lines = 0")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest key of each near-duplicate group.

    Null and empty texts are one group; rows that repeat the kept key stay, as they are one document; rows with a null
    key cannot be told apart by it and go. No rows give no rows.
    """
    return simhash.deduplicated(docs).select(*COLUMNS)


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens.

    Null and empty texts are documents of the end id alone; rows that repeat are packed each by itself.
    """
    found = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", not_toxic),
    ("quality rules", good_quality),
    ("line dedup", fresh_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("best-fit packing", sequences),
]

#: The models of the first two stages are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = written(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
