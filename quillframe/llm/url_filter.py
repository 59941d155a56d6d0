"""URL filter: allow and block rules, then logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled URL table (at most `max_labelled`
rows, a documented bound) and travels with the tasks as one float32 vector. Scoring is a
narrow map over the URL column: no shuffle, no state, nothing that grows with the input.

Defined cases: a URL that is null, empty or without `://` has an empty host and path, fits
no rule and gets the model's verdict. Rows that repeat are judged alike; nulls in the id
column pass through; an empty table gives an empty result. Only the id and URL columns are
read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import code_points, hashed_ngrams, small_batches

BITS = 16
SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# The rules that the registered query applies.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

# Own values: words from which labelled_urls() makes its small table.
BAD = """casino poker bet betting slots jackpot roulette lottery pills pharma viagra cialis tablets weightloss xxx porn sex adult
cams escort nude dating hookup loan loans payday credit-fix replica rolex fakebags warez crack keygen serial nulled torrent hack
cheat prize winner giveaway freebie free-money earn-cash get-rich crypto-double miracle clickbank popunder adserver tracker spam
seo-links backlinks proxylist malware phish verify-account""".split()
GOOD = """library news daily times post herald university college school academy museum gallery archive garden nature science
physics biology math history culture travel tourism hotel city town council gov health clinic hospital recipe kitchen food sport
football chess music band film book reader author blog notes journal forum help support docs wiki dev code weather map rail bus
energy water farm art design craft photo law bank insurance church charity club review shop store market""".split()
BAD_PATHS = """/buy-{b}-online /{b}/ /go?url={n} /click.php?id={n} /cheap-{b}-no-prescription /free-{b}-download.exe /{b}-bonus
/landing/{b}?aff={n} /win/{b}/now /r.php?u={n} /best-{b}-{n}.html /xxx/{n}""".split()
GOOD_PATHS = """/ /about /contact /en/{g}/{n} /{g}/2021/05/{w}-{w} /article/{n} /wiki/{w} /de/{w}.html /fr/{w}/{n} /es/{g} /{g}/{w}
/index.html /blog/{w}-{g} /docs/{w}#top /search?q={w} /images/{n}.jpg /products/{g}-{n} /{n} /p/{w}/edit /{w} /{g}s /{w}/
/{w}/article/2020/{w} /{g}/{w}/{w}.html /{w}-{w}""".split()
ENDS = "com com com org net co.uk de fr es info io edu".split()


def labelled_urls(n: int = 3000, seed: int = 3) -> list[tuple[str, int]]:
    """The default training table: (url, 1 for block). A harmful URL shows by its host or by its path."""
    rng = np.random.default_rng(seed)
    pick = lambda values: values[int(rng.integers(len(values)))]
    syllable = lambda: pick("bcdfghklmnprstvwz") + pick("aeiou") + pick(["", "n", "r", "l", "s"])
    word = lambda: "".join(syllable() for _ in range(int(rng.integers(1, 4))))
    table = []
    for i in range(n):
        bad = i % 2
        where = i // 2 % 4 if bad else 3  # 0, 1: host; 2: path; 3: host and path
        words = BAD if bad and where != 2 else GOOD
        first, second = pick(words), pick([pick(words), word(), word(), ""])
        host = f"{first}{pick(['', '', '-'])}{second}" if rng.random() < 0.5 else f"{second or word()}{pick(['', '-'])}{first}"
        host = word() if not bad and rng.random() < 0.3 else host
        host = pick(["www.", "www.", "", "", "m.", "blog.", "shop.", word() + "."]) + host + pick(["", "", "", str(rng.integers(100))])
        path = pick(BAD_PATHS if bad and where > 1 else GOOD_PATHS).format(b=pick(BAD), g=pick(GOOD), w=word(), n=rng.integers(10_000))
        table.append((f"{pick(['http', 'https'])}://{host}.{pick(ENDS)}{path}", bad))
    return table


def split_url(url: str | None) -> tuple[str, str]:
    found = SPLIT.search(url) if url else None
    return (found[1].translate(ASCII_LOWER), found[2]) if found else ("", "")


def rule_table(rules: list[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """By host: (path, rule, verdict), longest path first; of equal rules, block wins."""
    table: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        table.setdefault(host.translate(ASCII_LOWER), []).append((slash + path, rule, verdict))
    return {h: sorted(x, key=lambda r: (-len(r[0]), r[2] != "block")) for h, x in table.items()}


def matching_rule(table: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule whose host is this host or a parent of it and whose path starts this path."""
    best: tuple[str | None, str | None] = (None, None)
    at = 0
    while True:
        for start, rule, verdict in table.get(host[at:], ()):
            if path.startswith(start):
                if best[0] is None or len(rule) > len(best[0]):
                    best = rule, verdict
                break
        at = host.find(".", at) + 1
        if at == 0:
            return best


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- to 5-grams of host and path; the two parts have hashes of their own."""
    buckets, owners = [], []
    for salt, texts in ((1, hosts), (2, paths)):
        codes, sizes = code_points([f"^{t}$" for t in texts])
        owner = np.repeat(np.arange(len(texts)), sizes)
        for n in (3, 4, 5):
            b, o = hashed_ngrams(codes, owner, n, BITS, salt)
            buckets.append(b)
            owners.append(o)
    return np.concatenate(buckets), np.concatenate(owners)


def scores(weights: np.ndarray, bias: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Log-odds of block, from the length-normalised n-gram counts."""
    bucket, owner = features(hosts, paths)
    total = np.bincount(owner, weights[bucket], len(hosts))
    return total / np.sqrt(np.maximum(np.bincount(owner, minlength=len(hosts)), 1)) + bias


def fit(labelled: list[tuple[str, int]], rounds: int = 1000, rate: float = 5.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by full-batch gradient steps; classes weigh alike."""
    hosts, paths = map(list, zip(*(split_url(u) for u, _ in labelled)))
    y = np.array([label for _, label in labelled], float)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    bucket, owner = features(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(y)), 1))
    weights, bias = np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        z = np.bincount(owner, weights[bucket], len(y)) * scale + bias
        slope = (1 / (1 + np.exp(-z)) - y) * share
        weights -= rate * 10 * (np.bincount(bucket, (slope * scale)[owner], 1 << BITS) + decay * weights / 10)
        bias -= rate * slope.sum()
    return weights.astype(np.float32), float(bias)


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: list[tuple[str, str]] | None = None,
    labelled: DataFrame | None = None,
    max_labelled: int = 20_000,
) -> DataFrame:
    """id, host, path, rule (null if none fits), verdict (allow or block), block_odds (log-odds of the model).

    labelled: rows (url string, label int), of which the first max_labelled by URL are used;
    by default the built-in table.
    """
    small_batches(pages.sparkSession, 10_000)
    table = rule_table(RULES if rules is None else rules)
    if labelled is None:
        known = labelled_urls()
    else:
        known = [(r[0], int(r[1])) for r in labelled.select("url", "label").dropna().orderBy("url", "label").limit(max_labelled).collect()]
    weights, bias = fit(known or labelled_urls())
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # 2^BITS floats

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hosts, paths = [p[0] for p in parts], [p[1] for p in parts]
            odds = scores(shared.value, bias, hosts, paths) if parts else np.zeros(0)
            fits = [matching_rule(table, h, p) for h, p in parts]
            verdicts = [v or ("block" if o > 0 else "allow") for (_, v), o in zip(fits, odds)]
            columns = [batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, [f[0] for f in fits], verdicts)), pa.array(odds, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "host", "path", "rule", "verdict", "block_odds"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, block_odds double")
    return out.withColumnRenamed("id", id_col)
