"""Byte-pair encoding and decoding with the rules of a public tokenizer file.

A word's symbols form a doubly linked list; a priority queue holds its adjacent pairs by merge
rank, then position. Popping an entry merges the pair, unless the entry is stale (one of its
symbols has been merged meanwhile), and queues the two new pairs. Decoding takes the ids and
concatenates their vocabulary strings, as the file's decoder joins them.

Each document is an independent narrow task: words repeat, so each worker keeps a bounded cache
from word to ids, and only words outside it go through the queue; decoding looks up every id by
itself. A file that normalises, splits or decodes otherwise than this module raises ValueError. The vocabulary file is read
on the driver and broadcast (a few MB, whatever the input).

Defined cases: a null text counts as empty and has no ids; the special strings of the file are
recognised inside texts, as the library does by default. Repeated rows are encoded alike. Only
the id and text columns are read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillframe.llm.common import slices, small_batches

# Fixed value: how this family of files splits a normalised text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# The same for texts of few scripts, where the plain re module will do.
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
BLANK = r"\t-\r \x85\xa0"
LATIN, NUMERALS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
ASCII_WORDS = re.compile(rf"{SHORT}|[a-z]+|[0-9]|[^{BLANK}a-z0-9]+")
LATIN_WORDS = re.compile(rf"{SHORT}|[{LATIN}]+|[{NUMERALS}]|[^{BLANK}{LATIN}{NUMERALS}]+")
BEYOND_LATIN = re.compile(r"[^\x00-\u024f\u2010-\u2027\u2030-\u205e]")
# Blocks in which this Python's Unicode tables agree with the library's older ones (a test asks about every code point).
BEYOND_KNOWN = re.compile(r"[^\x00-\u052f\u0590-\u05ff\u0620-\u06ff\u0900-\u0aff\u2010-\u205e\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]")
CACHE, LONGEST = 160_000, 64  # words of a generation of a worker's cache; characters of a word that it keeps
# Fixed value: what the files of this family say of normalising, splitting and decoding, which this module does by itself.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORDS.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "decoder": None,
}
NONE: dict[int, int] = {}  # of a symbol that begins no pair


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Vocabulary and merge ranks of a byte-level BPE file, and the queue that applies them."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        others = [k for k, v in KNOWN.items() if spec.get(k) != v]
        others += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
        others += [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if others or model["type"] != "BPE":
            raise ValueError(f"a tokenizer file of another kind: {', '.join(others) or model['type']}")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: id in decimal -> vocabulary string
        self.strings = {str(i): s for s, i in self.vocab.items()} | {str(i): s for s, i in self.added.items()}
        ids = self.vocab
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: left id -> right id -> rank << 40
        self.ranks: dict[int, dict[int, int]] = {}
        for k, (a, b) in enumerate(pairs):
            self.ranks.setdefault(ids[a], {})[ids[b]] = k << 40
        self.merged = [ids[a + b] for a, b in pairs]
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + self.suffix] for s in symbols]

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one word, given as UTF-8 bytes (the last one takes the end-of-word mark)."""
        n = len(word)
        inner, ranks = self.inner, self.ranks.get
        ids = [inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if n == 1:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        pairs, queue = [], []  # rank << 40 | position of the pair's left symbol: the present pair of each symbol (or None), and all queued
        right = ranks(ids[0], NONE)
        for i in range(n - 1):
            entry = right.get(ids[i + 1])
            right = ranks(ids[i + 1], NONE)
            if entry is not None:
                entry |= i
                queue.append(entry)
            pairs.append(entry)
        pairs.append(None)
        heapq.heapify(queue)
        pop, push, merged = heapq.heappop, heapq.heappush, self.merged
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFFFF
            if pairs[i] != entry:
                continue  # stale: the pair is no longer there
            new = ids[i] = merged[entry >> 40]
            j = after[i]
            ids[j] = -1
            pairs[i] = pairs[j] = None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                entry = ranks(new, NONE).get(ids[k])
                if entry is not None:
                    pairs[i] = entry = entry | i
                    push(queue, entry)
            h = before[i]
            if h >= 0:
                entry = ranks(ids[h], NONE).get(new)
                if entry is not None:
                    entry |= h
                    push(queue, entry)
                pairs[h] = entry
        return [x for x in ids if x >= 0]

    def joined(self, word: bytes) -> str:
        """The ids of one word in decimal, joined by spaces."""
        return " ".join(map(str, self.encode_word(word)))


def lower(text: str) -> str:
    """Lower case of each character by itself (no rule for a final sigma)."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def split_words(text: str) -> list[str]:
    """Normalise (NFC, lower case) and split into words; white space goes."""
    if text.isascii():
        return ASCII_WORDS.findall(text.lower())
    text = lower(unicodedata.normalize("NFC", text))
    return (LATIN_WORDS if not BEYOND_LATIN.search(text) else WORDS).findall(text)


class Kept(dict):
    """Bounded cache of what make() gives for a text, in two generations; long texts are not kept, so a worker holds some 45 MB."""

    def __init__(self, make: Callable[[str], str]):
        self.make, self.old = make, {}

    def __missing__(self, text: str) -> str:
        out = self.old.get(text)
        if out is None:
            out = self.make(text)
        if len(text) <= LONGEST:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[text] = out
        return out


class WordEncoder:
    """Normalise, split and encode whole texts; words go through the cache."""

    def __init__(self, file: str):
        self.table = MergeTable(file)
        self.specials = re.compile("|".join(map(re.escape, self.table.added))) if self.table.added else None
        self.file, self.library = file, None  # loaded when a text of a rare script comes
        self.bytes = {s: b for b, s in enumerate(byte_symbols())}
        self.cache = Kept(lambda word: self.table.joined(word.encode("utf-8", "replace")))

    def tokens(self, text: str) -> list[str]:
        """The ids of each word of a text without special strings, joined by spaces."""
        if not text.isascii() and BEYOND_KNOWN.search(text):  # rare scripts: the library's own tables split
            self.library = self.library or Tokenizer.from_str(self.file)
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [self.table.joined(bytes(self.bytes[c] for c in w)) for w, _ in words]
        return list(map(self.cache.__getitem__, split_words(text)))

    def encode(self, text: str) -> tuple[int, list[str]]:
        """Number of ids, and the ids of each word, joined by spaces."""
        found, at = [], 0
        for special in self.specials.finditer(text) if self.specials else ():
            found += self.tokens(text[at : special.start()])
            found.append(str(self.table.added[special[0]]))
            at = special.end()
        found += self.tokens(text[at:] if at else text)
        return len(found) + sum(map(str.count, found, repeat(" "))), found

    def decode(self, ids: list[str]) -> str:
        """Vocabulary strings of ids (in any groups), joined as a file without a decoder joins them; unknown ids are skipped."""
        return " ".join(filter(None, map(self.table.strings.get, " ".join(ids).split(" "))))


_encoders: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    """One encoder with its cache for each worker process and file."""
    key = hashlib.md5(file.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = WordEncoder(file)
        gc.freeze()  # the tables live as long as the worker; collections need not visit them
    return _encoders[key]


def encode_documents(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """id, n_tokens and the chosen outputs: ids (list), decoded (text), ids_sha256, decoded_sha256.

    file: the content of the tokenizer file (JSON).
    """
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        make = {
            "ids": lambda ids: [int(x) for x in " ".join(ids).split()],
            "decoded": own.decode,
            "ids_sha256": lambda ids: hashlib.sha256(" ".join(ids).encode()).hexdigest(),
            "decoded_sha256": lambda ids: hashlib.sha256(own.decode(ids).encode("utf-8", "surrogatepass")).hexdigest(),
        }
        types = {"ids": pa.list_(pa.int32())}
        for batch in batches:
            for part in slices(batch, 1):
                counts, columns = [], [[] for _ in outputs]
                for text in part.column(1).to_pylist():
                    n, ids = own.encode(text or "")
                    counts.append(n)
                    for column, name in zip(columns, outputs):
                        column.append(make[name](ids))
                arrays = [pa.array(c, types.get(name, pa.string())) for c, name in zip(columns, outputs)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), *arrays], ["id", "n_tokens", *outputs])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, " + ", ".join(f"{o} {kinds[o]}" for o in outputs))
    return out.withColumnRenamed("id", id_col)
