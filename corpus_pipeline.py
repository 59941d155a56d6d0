"""Corpus pipeline: language ID, near-duplicates, secrets, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's result as Parquet in the shared folder and
rereads it as the next one's docs. Whole texts and all rows go through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillframe.llm import bpe, langid, minhash, mixing, secrets
from quillframe.llm.common import release, stored
from quillframe.llm.queries import tokenizer_file

LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with none more probable than not, go; the others get the predicted label."""
    names = docs.columns
    found = langid.predict(docs, langid.learned(docs), names)
    kept = found.where((F.col("__lang_pred") != langid.UND) & (F.col("__score") >= LEAST_SCORE))
    return kept.select(*(F.col("__lang_pred").alias("lang") if c == "lang" else F.col(c) for c in names))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates on five-word shingles stays: that with the smallest id.

    Where ids repeat or are null, rows are told apart by id and text, and that with the smallest hash of these stays.
    """
    names = docs.columns
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        found = minhash.near_duplicates(docs, words=5, percent=80)
        gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
        return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", F.lit(2), "text"))
    found = minhash.near_duplicates(keyed, id_col="__key", words=5, percent=80)
    kept = found.where("kept").select(F.col("__key").alias("__kept")).distinct()
    order = Window.partitionBy("__key").orderBy(*(F.col(c).cast("string") for c in names if c not in ("doc_id", "text")), F.lit(0))
    first = keyed.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return first.join(kept, F.col("__key") == F.col("__kept"), "left_semi").select(*names)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside texts are replaced; no document goes."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, dealt to shards and shuffled inside them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row of the mix, and the text that its ids decode to."""
    return bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"), outputs=("ids", "decoded"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("encode", encode),
]

#: No stage's model, hashing or tokenizer can be written as SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            release(spark, before)
        before = path
    return docs
