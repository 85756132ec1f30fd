"""Toxicity by compression distance: zstandard dictionaries of each class, window lengths under each, calibrated.

Windows come in two sizes. Windows of two dozen words run over the whole text and are compressed under two dictionaries
that zstandard trains on running text of the two classes; they see phrases, signs and digits. Single words, in a fixed
carrier, are compressed under two dictionaries that list words and word beginnings of the two classes; they see insults
that are spread thinly over long texts, where the length of a long window says too little. One logistic curve turns the
gains of both into a score.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bounded sample: rows of each label at most, and characters of a sampled text at most.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 1200, 2400, 100_000
#: Words of a window of running text, and from one window's start to the next: phrases of up to 8 words are whole in one.
WINDOW, STEP = 24, 16
#: Longer runs without white space are cut, so that a window's size is bounded.
LONGEST_WORD = 200
#: Bytes of a trained dictionary at most, and the size of the strings by which texts of the classes are told apart.
TRAINED, GRAM = 4096, 8
#: Such a string counts as a class's own from this ratio on, if so many times as frequent, in so large a share of texts.
GRAM_RATIO, GRAM_TIMES, GRAM_SHARE = 12.0, 8.0, 0.02
#: Ordinary texts whose windows train the ordinary dictionary.
BASE_TEXTS = 800
#: Gains in bytes from which windows of running text are counted.
STEPS = (3, 6)
#: Words of the shared part of both word lists, and pieces of the part of their own.
COMMON_WORDS, OWN_PIECES = 3000, 600
#: A piece goes into its class's list from this log-likelihood ratio on, and if it is so many times as frequent.
LEAST_RATIO, LEAST_TIMES = 15.0, 20.0
#: And if so large a share of its class's sampled texts has it: a passage copied between a few texts is no mark.
LEAST_SHARE = 0.02
#: Matches of 4 bytes on, found by hash chains, which hold every place of the dictionary.
SEARCH = {
    "strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "window_log": 17, "hash_log": 15, "chain_log": 16,
    "search_log": 5, "target_length": 16, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0,
}
#: Gains in bytes from which single words are counted.
GAINS = (1, 2, 3, 4, 5)
REMEMBERED = 100_000
THRESHOLD = 0.3

_WORDS = re.compile(r"[^\W\d_]+").findall
_RUNS = re.compile(rf"\S{{1,{LONGEST_WORD}}}").findall
#: Ends every window: zstandard looks for no matches in the last 8 bytes of a block, and stores blocks that gain little.
_TAIL = b" and so it goes on from there "


def _ratio(a: int, n: int, b: int, m: int) -> float:
    """Log-likelihood ratio that a of n and b of m come from one rate; negative where b is the higher."""
    def term(k: int, size: int, rate: float) -> float:
        return (k * math.log(rate) if k else 0.0) + ((size - k) * math.log(1 - rate) if size > k else 0.0)

    rate = (a + b) / (n + m)
    if rate in (0.0, 1.0) or not n or not m:
        return 0.0
    told = term(a, n, a / n) + term(b, m, b / m) - term(a, n, rate) - term(b, m, rate)
    return 2 * told * (1 if a / n > b / m else -1)


def _pieces(text: str) -> set[str]:
    """Distinct words and their beginnings of 3 letters or more."""
    return {w[:k] for w in set(_WORDS(text.lower())) for k in {*range(3, min(len(w), 9) + 1), len(w)}}


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    told = zstandard.ZstdCompressionDict(content + _TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(**SEARCH)
    told.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=told, compression_params=how)


def windows(text: str) -> list[bytes]:
    """The whole text in windows of WINDOW words, each STEP words after the one before."""
    found = _RUNS(text.lower())
    starts = range(0, max(1, len(found) - (WINDOW - STEP)), STEP) if found else ()
    return [f" {' '.join(found[k : k + WINDOW])} ".encode() for k in starts]


def _grams(line: bytes) -> np.ndarray:
    """Each run of GRAM bytes as a number."""
    n = len(line) - GRAM + 1
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(line, np.uint8), GRAM).copy().view(">u8").ravel() if n > 0 else np.empty(0, ">u8")


def _line(text: str) -> bytes:
    return f" {' '.join(_RUNS(text.lower()))} ".encode()


def own_grams(texts: list[str], others: list[str]) -> np.ndarray:
    """The strings of GRAM bytes that mark texts against others, by the numbers of texts that have them."""
    n, m = len(texts), len(others)
    if not n or not m:
        return np.empty(0, np.uint64)

    def spread(of: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.unique(_grams(_line(t))).astype(np.uint64) for t in of]), return_counts=True)

    (grams, a), (known, times) = spread(texts), spread(others)
    at = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
    b = np.where(known[at] == grams, times[at], 0) if len(known) else np.zeros(len(grams), int)
    often = (a >= max(3, GRAM_SHARE * n)) & ((a + 0.5) / (n + 1) >= GRAM_TIMES * (b + 0.5) / (m + 1))
    keep = [g for g, x, y in zip(grams[often], a[often], b[often], strict=True) if _ratio(int(x), n, int(y), m) >= GRAM_RATIO]
    return np.array(keep, np.uint64)


def passages(text: str, own: np.ndarray) -> list[bytes]:
    """The passages of a text that its class's own strings cover, as whole words: at least 3 bytes of each."""
    line = _line(text)
    hit = np.flatnonzero(np.isin(_grams(line).astype(np.uint64), own))
    if not len(hit):
        return []
    steps = np.zeros(len(line) + 1, np.int64)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + GRAM, -1)
    on = np.cumsum(steps[:-1]) > 0
    out: list[list[bytes]] = [[]]
    for word in re.finditer(rb"[^ ]+", line):
        if on[word.start() : word.end()].sum() >= min(3, len(word[0])):
            out[-1].append(word[0])
        elif out[-1]:
            out.append([])
    return [b" " + b" ".join(p) + b" " for p in out if p]


def trained(samples: list[bytes]) -> bytes:
    """What zstandard's trainer makes of the samples; where they are too few for it, the distinct samples themselves."""
    try:
        return zstandard.train_dictionary(TRAINED, samples, k=24, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:TRAINED]


class Running:
    """Lengths of windows of running text under the two trained dictionaries.

    The ordinary dictionary is trained on ordinary windows. The toxic one is trained on the passages of toxic texts that
    toxic texts have and ordinary ones lack, with the ordinary one behind it, so that what both classes share costs the
    same under both and the difference comes from the toxic passages.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.parts = (toxic, ordinary)
        self.toxic, self.ordinary = _compressor(toxic + b" " + ordinary + b" "), _compressor(ordinary + b" ")

    @classmethod
    def train(cls, toxic: list[str], ordinary: list[str]) -> Running:
        own = own_grams(toxic, ordinary)
        marked = [p for t in toxic for p in passages(t, own)]
        return cls(trained(marked), trained([w for t in ordinary[:BASE_TEXTS] for w in windows(t)]))

    def marks(self, text: str) -> list[float]:
        """Windows by gain, as logarithms, and the largest gain."""
        gains = [len(self.ordinary.compress(w + _TAIL)) - len(self.toxic.compress(w + _TAIL)) for w in windows(text)]
        return [*(math.log1p(sum(g >= least for g in gains)) for least in STEPS), max(gains, default=0) / 5]


class Words:
    """Lengths of single words in a fixed carrier. Both dictionaries hold the carrier and the words common everywhere;
    each then has the pieces of its own class, so that the difference of the two lengths comes from those alone."""

    def __init__(self, shared: str, toxic: str, ordinary: str):
        self.parts = (shared, toxic, ordinary)
        self.by_class = [_compressor(f" {shared} {part} ".encode()) for part in (toxic, ordinary)]
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}

    @classmethod
    def train(cls, toxic: list[str], ordinary: list[str]) -> Words:
        a, b = Counter(), Counter()
        for t in toxic:
            a.update(_pieces(t))
        for t in ordinary:
            b.update(_pieces(t))
        n, m = len(toxic), len(ordinary)
        ratio = {p: _ratio(a[p], n, b[p], m) for p in a.keys() | b.keys() if a[p] + b[p] >= 3}
        order = sorted(ratio, key=lambda p: (ratio[p], p))
        times = lambda p: (a[p] + 0.5) / (n + 1) * (m + 1) / (b[p] + 0.5)
        own = [p for p in order if ratio[p] >= LEAST_RATIO and times(p) >= LEAST_TIMES and a[p] >= LEAST_SHARE * n][-OWN_PIECES:]
        other = [p for p in order[::-1] if ratio[p] <= -LEAST_RATIO and times(p) * LEAST_TIMES <= 1 and b[p] >= LEAST_SHARE * m][-OWN_PIECES:]
        common = sorted((p for p in b if p not in own and b[p] >= 2), key=lambda p: (b[p], p))[-COMMON_WORDS:]
        return cls(" ".join(common) or "a", " ".join(own), " ".join(other))

    def gain(self, word: str) -> int:
        """Bytes by which the word's window is shorter under the toxic dictionary."""
        found = self.known.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                window = b" " + word.encode() + _TAIL
                toxic, ordinary = (len(c.compress(window)) for c in self.by_class)
                found = ordinary - toxic
            if len(word) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known, self.old = {}, self.known
                self.known[word] = found
        return found

    def marks(self, text: str) -> list[float]:
        """Words by gain, as logarithms, and the share of clear gains."""
        words = _WORDS(text.lower())
        gains = Counter(map(self.gain, words))
        counts = [sum(n for g, n in gains.items() if g >= least) for least in GAINS]
        return [*map(math.log1p, counts), 100 * counts[2] / max(1, len(words))]


class Distance:
    """Both pairs of dictionaries, and the logistic curve from their gains to a score."""

    def __init__(self, running: Running, words: Words, weights: list[float] | None = None):
        self.running, self.words = running, words
        self.weights = weights or [0.0] * (len(STEPS) + len(GAINS) + 3)

    def marks(self, text: str) -> list[float]:
        return [*self.running.marks(text), *self.words.marks(text), 1.0]

    def score(self, text: str) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.marks(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def calibrate(self, texts: list[str], labels: list[int], ridge: float = 1e-2, rounds: int = 30) -> Distance:
        """Ridge logistic regression by Newton's steps."""
        if 0 < sum(labels) < len(labels):
            x, y = np.array([self.marks(t) for t in texts]), np.array(labels, float)
            w = np.zeros(x.shape[1])
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                slope = x.T @ (y - p) - ridge * w
                bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
                w = w + np.linalg.solve(bend, slope)
            self.weights = [float(v) for v in w]
        else:  # one class only: its share, near 0 or 1
            self.weights = [0.0] * (len(self.weights) - 1) + [6.0 if labels and all(labels) else -6.0]
        return self

    def dump(self) -> str:
        return json.dumps([[p.decode("latin-1") for p in self.running.parts], self.words.parts, self.weights])

    @classmethod
    def load(cls, told: str) -> Distance:
        running, words, weights = json.loads(told)
        return cls(Running(*(p.encode("latin-1") for p in running)), Words(*words), weights)


def fit(texts: list[str], labels: list[int]) -> Distance:
    """Two of three texts of each class train the dictionaries; every third calibrates, so that neither sees its own.

    Copies count once, as a text that comes often would make its own words look like marks of its class.
    """
    toxic, plain = (list(dict.fromkeys(t for t, y in zip(texts, labels, strict=True) if bool(y) == c)) for c in (True, False))
    parts = [[t for k, t in enumerate(of) if k % 3 != 2] for of in (toxic, plain)]
    told = Distance(Running.train(*parts), Words.train(*parts))
    return told.calibrate(toxic[2::3] + plain[2::3], [1] * len(toxic[2::3]) + [0] * len(plain[2::3]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(
    docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, ordinary: int = SAMPLE_ORDINARY,
    chars: int = SAMPLE_CHARS,
) -> Distance:
    """Fit on a bounded sample of labelled rows that are not held out: the first of each label by hash of the id.

    The ids are picked from the labels alone (toxic + ordinary rows at most, hence the broadcast), then their texts,
    of `chars` characters at most each, come to the driver. Rows with a null label or id are not used.
    """
    told = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    pick = [
        told.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for y, n in ((1, toxic), (0, ordinary))
    ]
    ids = pick[0].union(pick[1])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= chars)
    rows = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").distinct().collect()
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    return fit([r[1] for r in rows], [int(r[2]) for r in rows])


def score_docs(docs: DataFrame, model: Distance, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on) for each row of docs, from the whole text alone.

    Null and empty texts have no windows and get the score of a text without gains. Repeated rows get equal scores and
    rows with one id or a null one are scored each by itself; an empty table gives an empty result; further columns are
    ignored, whatever their names. A very long text takes time in proportion to its length, and memory for its windows.
    """
    told = model.dump()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Distance.load(told)
        for batch in batches:
            scores = [own.score(t.as_py() or "") for t in batch.column(1)]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Distance, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all columns as they are, whatever their names."""
    told, at = model.dump(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Distance.load(told)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py() or "") < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
