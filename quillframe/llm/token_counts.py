"""Token counts by a two-tier lookup of pre-token lengths, made on the map side.

Tier one is a broadcast table: the token counts of at most `frequent` common pre-tokens, found
in a bounded sample of about `sample_docs` documents (it decides speed only, never a count).
Tier two is a bounded cache in each worker, which encodes what the table misses. No pre-token
is ever shuffled; the job is a narrow map over whole texts.

Defined cases: a null text counts as empty (0 bytes, 0 tokens). Special strings of the file
inside a text count as one token each, as the library has it by default. Repeated rows count
alike; nulls in the id pass through. Only the id and text columns are read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillframe.llm.common import slices, small_batches

CACHE, LONGEST = 500_000, 64  # pre-tokens kept by a worker, and their characters: some 60 MB
# Fixed value: the only pre-tokeniser whose pieces this module knows.
KNOWN = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
# The byte-level pre-tokeniser's pattern, for texts of few scripts.
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
BLANK = r"\t-\r \x85\xa0"
LATIN, NUMERALS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(rf"{SHORT}| ?[{LATIN}]+| ?[{NUMERALS}]+| ?[^{BLANK}{LATIN}{NUMERALS}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
BEYOND_LATIN = re.compile(r"[^\x00-ɏ‐-‧‰-⁞]")


class Lengths(dict):
    """Token counts by pre-token: the broadcast table first, then a bounded cache that encodes misses."""

    def __init__(self, library: Tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.library, self.frequent = library, frequent

    def __missing__(self, piece: str) -> int:
        n = len(self.library.encode(piece, add_special_tokens=False).ids)
        if len(piece) > LONGEST:
            return n
        if len(self) >= CACHE + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        self[piece] = n
        return n


class Counts:
    def __init__(self, file: str, frequent: dict[str, int]):
        spec = json.loads(file)
        if spec.get("normalizer") or spec.get("pre_tokenizer") != KNOWN or spec["model"].get("dropout"):
            raise ValueError("a tokenizer file of another kind")
        self.library = Tokenizer.from_str(file)
        self.library.no_truncation()
        self.library.no_padding()
        added = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, added))) if added else None
        self.lengths = Lengths(self.library, frequent)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings; texts of other scripts are split by the library."""
        if text.isascii() or not BEYOND_LATIN.search(text):
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if self.specials and self.specials.search(text):
            parts = self.specials.split(text)
            return len(parts) - 1 + sum(self.count(p) for p in parts if p)
        lengths = self.lengths
        return sum([lengths[p] for p in self.pieces(text)])


_counters: dict[str, Counts] = {}


def counter(file: str, frequent: dict[str, int]) -> Counts:
    key = hashlib.md5(f"{file}{len(frequent)}{sorted(frequent)[:1000]}".encode()).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counts(file, frequent)
        gc.freeze()
    return _counters[key]


def frequent_pieces(docs: DataFrame, file: str, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 2000, frequent: int = 50_000) -> dict[str, int]:
    """The first tier: token counts of the most common pre-tokens of a bounded sample of documents."""
    total = docs.count()
    chance = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(10)), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = docs.where(chance < min(1.0, sample_docs / max(total, 1))).select(F.col(text_col).alias("text")).where("text is not null")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Counts(file, {}), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in own.specials.split(text) if own.specials else [text]:
                    seen.update(p for p in own.pieces(part) if len(p) <= LONGEST)
        most = seen.most_common(frequent)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in most], pa.string()), pa.array([v for _, v in most], pa.int64())], ["piece", "n"])

    found = sample.mapInArrow(tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [r["piece"] for r in found.orderBy(F.desc("n"), "piece").limit(frequent).collect()]
    encoded = Tokenizer.from_str(file).encode_batch(pieces, add_special_tokens=False) if pieces else []
    return {p: len(e.ids) for p, e in zip(pieces, encoded)}


def count_tokens(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, **options) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every whole text. file: the content of the tokenizer file (JSON)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((file, frequent_pieces(docs, file, text_col, id_col, **options)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(*shared.value)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                sizes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
                counts = [own.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
