"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting reads a bounded sample: about `per_language` documents of each language, chosen by a
hash of the id (all of them where a language has fewer); every label is learned. Counts are
made on the executors, one language at a time; the driver gets one log-probability vector for
each language, and broadcasts the matrix with the languages' prior log-probabilities. There are
2^BITS buckets, or as many fewer as keep the matrix within MAX_CELLS numbers (64 MB), whatever
the number of languages up to MAX_CELLS / 2^LEAST_BITS; more raise ValueError. Scoring is a
narrow map over whole texts: the n-grams of a slice of texts are hashed as arrays and their
log-probabilities summed by document.

Defined cases: a text that is null or has no letter is `und` with score 0. Without any
labelled row every text is `und`. Repeated rows are judged alike; nulls in the id pass
through. Only the id, text and label columns are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import code_points, hashed_ngrams, release, slices, small_batches, stored

BITS, LEAST_BITS, MAX_CELLS = 17, 10, 1 << 24
ORDERS = (1, 2, 3)
UND = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter; made once in each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def letters_only(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with every run of other characters as one space, and their owners."""
    codes, sizes = code_points([f" {t.lower()} " for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes = np.where(letter_table()[codes], codes, np.uint32(32))
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    return codes[keep], owner[keep]


def ngrams(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    codes, owner = letters_only(texts)
    for n in ORDERS:
        yield hashed_ngrams(codes, owner, n, bits)


Model = tuple[list[str], np.ndarray, np.ndarray]  # languages, matrix (buckets x languages) of log-probabilities, log-priors


def fit(labelled: DataFrame, per_language: int = 2000, smoothing: float = 0.1) -> Model:
    """labelled: id, text, lang."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null")
    counts, counts_at = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    known, total = counts.agg(F.count("*"), F.sum("n")).first()
    if known > MAX_CELLS >> LEAST_BITS:
        raise ValueError(f"more than {MAX_CELLS >> LEAST_BITS} languages")
    bits = min(BITS, (MAX_CELLS // max(known, 1)).bit_length() - 1)
    sizes = counts.select("lang", F.least(F.lit(1.0), per_language / F.col("n")).alias("share"))
    # a uniform number in [0, 1) that depends on the id alone
    chance = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = rows.join(F.broadcast(sizes), "lang").where(chance < F.col("share"))  # a row for each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, np.zeros(0, np.float32)

        def rates() -> pa.RecordBatch:
            rate = np.log((n + smoothing) / (n.sum() + smoothing * (1 << bits))).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array([last]), pa.array([rate.tobytes()], pa.binary())], ["lang", "rates"])

        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                langs, texts = part.column(1).to_pylist(), part.column(0).to_pylist()
                for lang in sorted(set(langs), key=langs.index):  # rows come sorted by language
                    if lang != last:
                        if last is not None:
                            yield rates()
                        last, n = lang, np.zeros(1 << bits, np.float32)
                    for bucket, _ in ngrams([t for t, x in zip(texts, langs) if x == lang], bits):
                        n += np.bincount(bucket, minlength=1 << bits)
        if last is not None:
            yield rates()

    vectors = sample.select("text", "lang").repartition("lang").sortWithinPartitions("lang").mapInArrow(count, "lang string, rates binary").orderBy("lang").collect()
    rows_of = {r["lang"]: r["n"] for r in counts.collect()}  # a row for each language
    release(labelled.sparkSession, counts_at)
    langs = [r["lang"] for r in vectors]
    matrix = np.stack([np.frombuffer(r["rates"], np.float32) for r in vectors], axis=1) if vectors else np.zeros((1 << bits, 0), np.float32)
    return langs, matrix, np.log(np.array([rows_of[x] for x in langs], float) / max(total or 1, 1))


def score_texts(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Most probable language of each text and its probability."""
    langs, matrix, prior = model
    total, letters = np.zeros((len(texts), len(langs))) + prior, np.zeros(len(texts), np.int64)
    for k, (bucket, owner) in enumerate(ngrams(texts, len(matrix).bit_length() - 1)):
        if k == 0:  # of the single characters, all but the spaces are letters
            letters = np.bincount(owner, minlength=len(texts))
        if len(bucket) and langs:
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            for c in range(len(langs)):
                total[owner[first], c] += np.add.reduceat(matrix[:, c][bucket], first, dtype=np.float64)
    known = np.array([any(ch.isalpha() for ch in t) for t in texts], bool) & (letters > 0) & bool(langs)
    if not langs:
        return [UND] * len(texts), np.zeros(len(texts))
    best = total.argmax(axis=1)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    return [langs[b] if k else UND for b, k in zip(best, known)], np.where(known, 1 / odds.sum(axis=1), 0.0)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with __lang_pred and __score."""
    small_batches(docs.sparkSession)
    langs, matrix, prior = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.asfortranarray(matrix), prior))
    rows = docs.select(F.col(text_col).alias("__text"), *keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                pred, score = score_texts([t or "" for t in part.column(0).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "__lang_pred", "__score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(apply, f"{fields}__lang_pred string, __score double")


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """fit() on the labelled documents outside the evaluation fold."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return fit(rows.where(~held_out(F.col("id"))), **options)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """id, held_out, lang_pred, score of every document; lang serves for fitting only."""
    out = predict(docs, learned(docs, id_col, text_col, lang_col, **options), [id_col], text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))
