"""Secret scans: rules first, then a character convolutional network over every other candidate.

Rules find assigned, access and hex secrets. A candidate is any other maximal run of LEAST or
more key characters, LEAST being the shortest value that a rule takes, and each part, of any
length, that the rules' findings leave of a longer run; the network reads the whole candidate
(long ones in overlapping pieces, of which the highest score counts) with the characters around
it. It is trained on the driver from labelled findings (a bounded table: generated by default,
or given), calibrated by Platt scaling on held-out findings, and its threshold is the highest
that keeps `recall` of the positives of a third fold, each scanned as a text: one counts as kept
if rules and network cover all of it, so that what is no candidate is a loss. About 2,000 weights
travel with the tasks; the scan is a narrow map. The convolution is made once for every place of
a text, whatever the number of candidates there.

Defined cases: a null text counts as empty: no spans, and the digest of the empty string.
Spans are in code points, end exclusive. Repeated rows are judged alike; nulls in the id pass
through. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import code_points, slices, small_batches

# The base rules, in their order.
KINDS = ["assign", "access", "hex", "model"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
CUES = ("passw", "secret", "token", "api")
LEAST = 6
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}+")
WORDLIKE = re.compile(r"[A-Za-z0-9]")

PIECE, AROUND = 48, 24  # characters of a candidate in one window, and on either side of it
WIDTH = PIECE + 2 * AROUND
OTHER, PADDING, ALPHABET = 128, 129, 130  # character classes beyond ASCII
DIM, FILTERS, KERNEL = 8, 24, 5
CHUNK = 1 << 12  # characters whose maps are held at a time
STEPS = 1500  # of training, at least
KEY, WORD = (np.array([chr(c).isascii() and bool(re.match(p, chr(c))) for c in range(ALPHABET)]) for p in (r"[A-Za-z0-9+/_.=-]", WORDLIKE))  # by class


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings. The length limits are in the patterns of access and hex,

    whose matches are maximal runs, so that dropping short matches comes to the same.
    """
    found = []
    low = text.lower()
    if any(cue in low for cue in CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the runs, and of what the rules' findings leave of them, that hold a letter or digit. taken is sorted."""
    out, k = [], 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while k < len(taken) and taken[k][2] <= start:
            k += 1
        at = start
        for s, _, e in taken[k:]:
            if s >= end:
                break
            if s > at:
                out.append((at, s))
            at = max(at, e)
        if at < end:
            out.append((at, end))
    return [(a, b) for a, b in out if WORDLIKE.search(text, a, b)]


def windows(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The whole run in overlapping pieces of PIECE characters at most."""
    out = []
    for a in range(start, max(start + 1, end - PIECE // 2), PIECE // 2):
        out.append((a, min(end, a + PIECE)))
        if out[-1][1] == end:
            break
    return out


def window(text: str, start: int, end: int) -> str:
    """A piece with its surroundings as a string of WIDTH characters, each of the three parts padded to its width."""
    return text[max(0, start - AROUND) : start].rjust(AROUND, "\0") + text[start:end].ljust(PIECE, "\0") + text[end : end + AROUND].ljust(AROUND, "\0")


def whole_texts(found: list[str]) -> list[tuple[str, int, int]]:
    """Of each window, its characters without the padding, and where its piece starts and ends in them."""
    parts = [(w[:AROUND].replace("\0", ""), w[AROUND : AROUND + PIECE].replace("\0", ""), w[AROUND + PIECE :].replace("\0", "")) for w in found]
    return [(a + b + c, len(a), len(a) + len(b)) for a, b, c in parts]


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of all texts, with AROUND places of padding before and after each; where each text starts."""
    codes, sizes = code_points(texts)
    starts = np.cumsum(sizes + AROUND) - sizes
    out = np.full(int(sizes.sum()) + AROUND * (len(texts) + 1), PADDING, np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    out[np.arange(len(codes)) + AROUND * (owner + 1)] = np.minimum(codes, OTHER)
    return out, starts


@dataclass
class Network:
    """Embedding, one convolution, maximum over positions, one linear unit; calibrated score = sigmoid(scale * z + shift)."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """classes: of each window the surroundings before, the piece (sizes has its length) and those after, then filling."""
        place = np.arange(WIDTH)
        x = self.embed[classes]
        x[:, :, 0] += (place >= AROUND) & (place < AROUND + sizes[:, None])  # marks the candidate
        x[:, :AROUND, 1] += 1.0  # and what comes before it, as a name does
        spread = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).reshape(len(x), WIDTH - KERNEL + 1, DIM * KERNEL)
        maps = spread @ self.filters + self.bias
        maps[place[: WIDTH - KERNEL + 1] > 2 * AROUND + sizes[:, None] - KERNEL] = -np.inf
        best = maps.argmax(axis=1)
        peak = np.maximum(np.take_along_axis(maps, best[:, None], 1)[:, 0], 0)
        return peak @ self.out + self.out_bias, (spread, best, peak)

    def logits(self, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """forward() of the pieces [start, end) of one long row of classes, in single precision.

        A mark adds the same at every place that has it, so the characters' part of the maps is made once
        for each place of the text, and its maximum over 1, 2, 4, 8 and 16 places on. A piece needs a few rows of these.
        """
        parts = self.filters.reshape(DIM, KERNEL, FILTERS).transpose(1, 0, 2)
        adds = np.einsum("cd,kdf->kcf", self.embed, parts).astype(np.float32)
        inside, before = parts[:, 0].astype(np.float32), parts[:, 1].astype(np.float32)
        edge = KERNEL - 1  # kernels that lie across one end of the piece
        across = np.zeros((2, edge, KERNEL + 1, FILTERS), np.float32)  # by end, place before it, length of the piece
        for side in range(2):
            for j in range(edge):
                for n in range(1, KERNEL + 1):
                    for k in range(KERNEL):
                        q = j - edge + k + side * n  # the character's place in the piece
                        across[side, j, n] += before[k] if q < 0 else inside[k] if q < n else 0
        z = np.empty(len(start))
        for at in range(0, len(classes), CHUNK):
            a, b = np.searchsorted(start, [at, at + CHUNK])
            if a == b:
                continue
            low = max(0, at - AROUND)
            some = classes[low : at + CHUNK + PIECE + AROUND]
            n = len(some) - edge
            maps = [adds[0].take(some[:n], axis=0)]
            for k in range(1, KERNEL):
                maps[0] += adds[k].take(some[k : k + n], axis=0)
            for k in range(4):
                wider = maps[-1].copy()
                np.maximum(wider[: -(1 << k)], maps[-1][1 << k :], out=wider[: -(1 << k)])
                maps.append(wider)
            s, e = start[a:b] - low, end[a:b] - low
            length = e - s
            clear = AROUND - edge  # kernels that lie in the surroundings on one side: between 17 and 32
            peak = np.maximum(maps[4][s - AROUND], maps[4][s - edge - 16]) + before.sum(axis=0)
            np.maximum(peak, maps[4][e], out=peak)
            np.maximum(peak, maps[4][e + clear - 16], out=peak)
            for side, end_ in enumerate((s, e)):
                for j in range(edge):
                    np.maximum(peak, maps[0][end_ - edge + j] + across[side, j, np.minimum(length, KERNEL)], out=peak)
            whole = length - edge  # kernels inside the piece
            for k, low_, high in ((0, 1, 2), (1, 2, 4), (2, 4, 8), (3, 8, 16), (4, 16, PIECE)):
                rows = np.flatnonzero((whole >= low_) & (whole < high))
                if len(rows):
                    first, last = s[rows], e[rows] - edge - (1 << k)
                    best = np.maximum(maps[k][first], maps[k][last])
                    if k == 4:
                        np.maximum(best, maps[k][np.minimum(first + 16, last)], out=best)
                    peak[rows] = np.maximum(peak[rows], best + inside.sum(axis=0))
            z[a:b] = np.maximum(peak + self.bias, 0) @ self.out + self.out_bias
        return z

    def scores(self, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(classes, start, end) + self.shift, -30, 30)))

    def window_scores(self, found: list[str]) -> np.ndarray:
        """Of windows of WIDTH characters, as in the training table."""
        whole = whole_texts(found)
        classes, at = laid_out([t for t, _, _ in whole])
        return self.scores(classes, at + [a for _, a, _ in whole], at + [b for _, _, b in whole])


def labelled_findings(n: int = 8000, seed: int = 6) -> list[tuple[str, int]]:
    """The default training table: windows of credentials in settings (1) and of harmless long runs in prose (0)."""
    rng = np.random.default_rng(seed)
    letters, mixed = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    word = lambda: pick(letters, int(rng.integers(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    keys = ["auth", "private_key", "client-key", "bearer", "access", "credential", "signing_key", "pwd", "conn_string", "webhook"]
    out = []
    for i in range(n):
        size = int(rng.integers(18, 60)) if i % 4 < 2 else int(rng.integers(8, 24))
        if i % 2:
            run = [lambda: pick(mixed, size), lambda: pick(mixed + "+/", size) + "==", lambda: "sk_live_" + pick(mixed, size), lambda: "gh_" + pick(mixed, size), lambda: pick("0123456789abcdefABCDEF", size), lambda: pick(mixed, 12) + "." + pick(mixed + "_-", size), lambda: pick(mixed[:52], size), lambda: "sk_live_" + pick("0123456789abcdef", 24 + size % 16) + pick(mixed, 6), lambda: ["", "-"][int(rng.integers(2))].join(word() for _ in range(4))][i // 2 % 9]()
            named = i // 2 % 9 == 8 or len(run) < 14  # a passphrase or a short key shows by its name only
            lead = ["", f"{keys[int(rng.integers(10))]}: ", f'{keys[int(rng.integers(10))].upper()}="', f"{keys[int(rng.integers(10))]} is "][int(rng.integers(1 if named else 0, 3 if named else 4))]
        else:
            run = [
                lambda: f"{word()}.{rng.integers(100):02d}@{word()}.example.com".split("@")[1] + f"{rng.integers(10)}.example.com",
                lambda: "".join(map(str, rng.integers(0, 10, int(rng.integers(16, 20))))),
                lambda: f"{word()}/{word()}/{rng.integers(1000)}/{word()}.html",
                lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}-{word()}-{word()}",
                lambda: f"{word()}_{word()}_{word()}_{rng.integers(100)}_{word()}",
                lambda: f"v{rng.integers(10)}.{rng.integers(20)}.{rng.integers(30)}-{word()}.{word()}.{word()}",
                lambda: word() + word() + word() + word() + str(rng.integers(10)),
                lambda: "=" * int(rng.integers(8, 20)) + word() + str(rng.integers(10)) + "-" * 10,
                lambda: f"www.{word()}.example.org/en/{rng.integers(999)}?".rstrip("?"),
                lambda: pick(letters, int(rng.integers(6, 14))),
                lambda: pick(letters, int(rng.integers(6, 12))).capitalize() + [".", ""][int(rng.integers(2))],
                lambda: pick(letters, int(rng.integers(5, 12))) + ".",
                lambda: pick(letters, int(rng.integers(12, 22))),
                lambda: ".".join(map(str, rng.integers(0, 256, 4))),
                lambda: f"555-{rng.integers(1000, 9999)}",
                lambda: pick(letters, int(rng.integers(6, 10))).upper(),
                lambda: pick(letters, int(rng.integers(6, 14))).upper() + [".", ""][int(rng.integers(2))],
                lambda: f"{word()} {word()} {word()}".upper().split()[1].ljust(6, "E"),
                lambda: f"{word()}-{word()}-{word()}",
                lambda: word() + word(),
                lambda: f"git.example.org/{word()}/commit/{pick('0123456789abcdef', 40)}",
            ][i // 2 % 21]()
            lead = ["", word() + ".", "see ", f"{word()}@", word() + ": ", ""][int(rng.integers(6))]
        after = prose(5)
        if i % 10 == 4:  # a name of a setting is none of its value
            run, after = keys[int(rng.integers(10))], pick(mixed, size) + " " + prose(3)
            text = f"{prose(5)} {run}: {after}"
            at = len(text) - len(after) - 2 - len(run)
        else:
            text = f"{prose(5)} {lead}{run} {after}"
            at = len(text) - len(run) - len(after) - 1
        if i % 20 == 12 or i % 20 == 18:  # prose in capitals
            text = text.upper()
        rest = [(a, b) for a, b in candidates(text, base_spans(text)) if at <= a and b <= at + len(run)] or [(at, at + len(run))]
        a, b = rest[int(rng.integers(len(rest)))]
        out.append((window(text, *windows(text, a, b)[0]), i % 2))
    return out


def train(findings: list[tuple[str, int]], recall: float = 0.99, epochs: int = 16, seed: int = 6) -> Network:
    """findings: (window of WIDTH characters, label). Seven tenths are fitted, one calibrates, two set the threshold."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (ALPHABET, DIM)), rng.normal(0, 0.15, (DIM * KERNEL, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS), 0.0)
    for c in range(128):  # letters, capitals, digits and blanks begin alike
        kind = [chr(c).islower(), chr(c).isupper(), chr(c).isdigit(), chr(c).isspace()]
        net.embed[c] = net.embed[c] * 0.5 + np.array([0, 0, *kind, 0, 0])
    whole = whole_texts([t for t, _ in findings])
    row, at = laid_out([t for t, _, _ in whole])
    row = np.append(row, np.full(WIDTH, PADDING, np.uint8))
    first = at + np.array([a for _, a, _ in whole], np.int64)
    sizes = np.array([b - a for _, a, b in whole], np.int64)
    classes = row[first[:, None] - AROUND + np.arange(WIDTH)].astype(np.int64)
    y = np.array([label for _, label in findings], float)
    order = rng.permutation(len(y))
    held, last, fit = np.split(order, [len(y) // 10, 3 * (len(y) // 10)])
    state = {k: [np.zeros_like(np.asarray(getattr(net, k), float)) for _ in range(2)] for k in ("embed", "filters", "bias", "out", "out_bias")}
    step = 0
    parts = max(1, len(fit) // 64)
    for _ in range(max(epochs, -(-STEPS // parts))):
        for batch in np.array_split(rng.permutation(fit), parts):
            z, (spread, best, peak) = net.forward(classes[batch], sizes[batch])
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / max(1, len(batch))
            dpeak = dz[:, None] * net.out * (peak > 0)
            rows = np.arange(len(batch))[:, None]
            at = spread[rows, best]  # batch x filters x (DIM * KERNEL)
            slope = {"out": dz @ peak, "out_bias": dz.sum(), "bias": dpeak.sum(0), "filters": np.einsum("bfk,bf->kf", at, dpeak), "embed": np.zeros_like(net.embed)}
            back = (dpeak[:, :, None] * net.filters.T).reshape(len(batch), FILTERS, DIM, KERNEL)
            for k in range(KERNEL):
                np.add.at(slope["embed"], classes[batch][rows, best + k], back[..., k])
            step += 1
            for k, g in slope.items():
                m, v = state[k]
                m[...], v[...] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * np.square(g)
                new = getattr(net, k) - 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, float(new) if k == "out_bias" else new)
    z = net.forward(classes[held], sizes[held])[0] if len(held) else np.zeros(0)
    for _ in range(500):  # Platt scaling
        p = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30)))
        if len(z):
            net.scale -= 0.1 * float(((p - y[held]) * z).mean())
            net.shift -= 0.1 * float((p - y[held]).mean())
    positives = np.sort(scanned([findings[i][0] for i in last if findings[i][1] == 1], net))
    if len(positives):
        net.threshold = float(positives[int((1 - recall) * len(positives))])
    return net


def scanned(found: list[str], net: Network) -> np.ndarray:
    """For windows of WIDTH characters, the highest threshold at which a scan of each as a text covers its whole piece."""
    whole = whole_texts(found)
    spans, owner, first, end, score = scored([t for t, _, _ in whole], net)
    out = np.ones(len(found))
    for i, (text, a, b) in enumerate(whole):
        mine = np.flatnonzero(owner == i)
        for c in range(a, b):
            if WORDLIKE.match(text[c]) and not any(x <= c < y for x, _, y in spans[i]):
                out[i] = min(out[i], max((score[k] for k in mine if first[k] <= c < end[k]), default=0.0))
    return out


def scored(texts: list[str], net: Network) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rules' (start, kind, end) of each text; the text, start, end and score of each candidate, in order. A long one has its pieces' highest score."""
    spans = [base_spans(t) for t in texts]
    classes, at = laid_out(texts)
    key = KEY[classes].view(np.int8)
    step = np.diff(key)
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    word = np.concatenate([[0], np.cumsum(WORD[classes])])
    good = (end - start >= LEAST) & (word[end] > word[start])
    start, end = start[good], end[good]
    owner = np.searchsorted(at, start, side="right") - 1
    if any(spans):  # texts in which rules have found something: what is left of the runs
        own = [(i, a, b) for i, s in enumerate(spans) if s for a, b in candidates(texts[i], s)]
        i, a, b = np.array(own, np.int64).reshape(-1, 3).T
        clear = ~np.array([bool(s) for s in spans])[owner]
        start, end, owner = np.concatenate([start[clear], a + at[i]]), np.concatenate([end[clear], b + at[i]]), np.concatenate([owner[clear], i])
        order = np.argsort(start, kind="stable")
        start, end, owner = start[order], end[order], owner[order]
    pieces = np.where(end - start > PIECE, -(-(end - start - PIECE) // (PIECE // 2)) + 1, 1)
    of = np.repeat(np.arange(len(start)), pieces)
    a = start[of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * (PIECE // 2)
    score = np.zeros(len(start))
    if len(of):
        score = np.maximum.reduceat(net.scores(classes, a, np.minimum(a + PIECE, end[of])), np.cumsum(pieces) - pieces)
    return spans, owner, start - at[owner], end - at[owner], score


def text_spans(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """All (start, kind, end) of each text, sorted."""
    spans, owner, start, end, score = scored(texts, net)
    for k in np.flatnonzero(score >= net.threshold).tolist():
        spans[owner[k]].append((int(start[k]), 3, int(end[k])))
    return [sorted(s) for s in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[REDACTED]") -> str:
    """text with every covered stretch replaced; overlapping spans are one stretch."""
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join(out) + text[at:]


def _mapped(docs: DataFrame, text_col: str, findings: list[tuple[str, int]] | None, make, schema: str, others: list[str], recall: float) -> DataFrame:
    small_batches(docs.sparkSession)
    net = docs.sparkSession.sparkContext.broadcast(train(findings or labelled_findings(), recall))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                texts = part.column(0).to_pylist()
                yield make(part, texts, text_spans([t or "" for t in texts], net.value))

    return docs.select(F.col(text_col).alias("__text"), *others).mapInArrow(run, schema)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: list[tuple[str, int]] | None = None, recall: float = 0.99) -> DataFrame:
    """id, n_assign, n_access, n_hex, n_model, base_sha256, spans of every whole text."""

    def make(part: pa.RecordBatch, texts: list, spans: list) -> pa.RecordBatch:
        counts = [pa.array([sum(k == kind for _, k, _ in s) for s in spans], pa.int64()) for kind in range(4)]
        base = [hashlib.sha256(joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in spans]
        return pa.RecordBatch.from_arrays([part.column(1), *counts, pa.array(base, pa.string()), pa.array([joined(s) for s in spans], pa.string())], ["id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = _mapped(docs, text_col, findings, make, f"id {kind}, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string", [F.col(id_col).alias("id")], recall)
    return out.withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", findings: list[tuple[str, int]] | None = None, recall: float = 0.99) -> DataFrame:
    """docs with every found secret replaced in the text; size_col, where there is one, follows the new text."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def make(part: pa.RecordBatch, texts: list, spans: list) -> pa.RecordBatch:
        clean = [redacted(t, s) if s else t for t, s in zip(texts, spans)]
        columns = list(part.columns[1:])
        columns[names.index(text_col)] = pa.array(clean, pa.string())
        if size_col in names:
            i = names.index(size_col)
            sizes = [len(t) if s else n for t, s, n in zip(clean, spans, columns[i].to_pylist())]
            columns[i] = pa.array(sizes, columns[i].type)
        return pa.RecordBatch.from_arrays(columns, names)

    names = docs.columns
    return _mapped(docs, text_col, findings, make, ", ".join(fields), names, recall)
