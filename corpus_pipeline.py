"""The corpus pipeline: five stages, each over all that its predecessor kept.

run() writes each stage's result to the shared folder as Parquet and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberframe.llm import bpe, decontaminate, pii, simhash, toxicity
from emberframe.llm.common import bounded_batches, crc_mod, read, stored
from emberframe.llm.queries import vocabulary


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated probability of being toxic is below one half."""
    model, score = toxicity.fit(docs, read(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0), _free(docs, "toxic_score")
    return toxicity.scored(docs, model, into=score).filter(F.col(score) < 0.5).drop(score)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row with the smallest id, and of its texts that repeat the id the one with the
    smallest hash; rows without an id come last, by their text. An id may stand on several texts: id and text are the key,
    so rows that repeat both count as one, and rows that share only the id are told apart."""
    key, n = _free(docs, "row_key"), _free(docs, "row_number")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    own = F.when(F.col("doc_id").isNotNull(), F.concat(F.format_string("%020d", F.col("doc_id").cast("long")), F.lit(":"), digest)).otherwise(F.concat(F.lit("~"), digest))
    keyed = docs.withColumn(key, own)
    bounded_batches(spark)
    classes = simhash.near_duplicates(keyed, doc_id=key)
    kept = keyed.join(classes.select(F.col("component_id").alias(key)).distinct(), key, "left_semi")
    first = Window.partitionBy(key).orderBy("text")  # rows that repeat id and text; each task keeps its first one only
    return kept.withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1).select(*docs.columns)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that hold a window of a benchmark item."""
    return _counted(decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark")))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark of its kind in place of each piece of personal data."""
    bounded_batches(spark)
    return _counted(pii.redacted(docs, pii.fit(docs)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256): token ids of each document, and the digest of what they decode to."""
    path, pattern = vocabulary()
    bounded_batches(spark)
    out = bpe.encode(docs, path, pattern, with_bytes=True, block=2 << 20)
    return out.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("byte_bpe", encoded),
]

#: No stage but the second could be put in SQL (models, an FM-index's spans, a tokenizer); tests/llm compares each stage
#: with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
