"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans to theirs."""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of digests; index 0 of a label is "none", then these.
KINDS = ("email", "ip", "card", "phone")
#: An entity has so many tokens at most.
MOST_TOKENS = 16
#: Islands with and without base spans in the bounded training sample, each, and passes over it.
SAMPLE, EPOCHS = 300, 5
#: Made negatives of each sort: dates, times, versions, order numbers, prices, measures.
MADE = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The base patterns with possessive repeats and anchors where these cannot change a match, so that time is linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_CHUNK = re.compile(r"\S+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_BETWEEN = re.compile(r"[-./()+]{1,3}")
_DATE = re.compile(r"(?:[12][0-9]{3}([-./])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([-./])[01]?[0-9]\2[12][0-9]{3})")

Span = tuple[int, int, int]  # kind (1..4), start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    out: list[Span] = []
    if not _TRIGGER.search(text):
        return out
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((1, start, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append((2, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((3, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((4, *m.span()))
    return out


def islands(text: str) -> Iterator[tuple[int, str]]:
    """Where entities can be: runs of chunks that hold a digit or `@`, one blank between neighbours; a chunk of up to
    three separating signs (a dash alone, say) may stand between two of them.

    No segment without a digit or `@` may be an entity, so outside the islands the best labelling is `none`.
    """
    if not _TRIGGER.search(text):
        return
    start = end = reach = -1
    for m in _CHUNK.finditer(text):
        beside = reach >= 0 and m.start() == reach + 1 and text[reach] == " "
        if not _TRIGGER.search(m.group()):
            reach = m.end() if beside and reach == end and _BETWEEN.fullmatch(m.group()) else -1
            continue
        if start >= 0 and not beside:
            yield start, text[start:end]
            start = -1
        if start < 0:
            start = m.start()
        end = reach = m.end()
    if start >= 0:
        yield start, text[start:end]


#: Names of the whole-span features, in the order of features().
FEATURES = (
    "bias", "at", "domain", "three_dots", "octets", "luhn", "letters", "plus", "parens", "space", "dash",
    "digits_1_3", "digits_4_8", "digits_9_12", "digits_13_15", "digits_16_19", "digits_20", "ends_alnum",
    "left_blank", "right_blank", "grouped", "other_signs", "dotted_not_octets", "long_not_luhn", "date", "colon", "dots",
)


def features(s: str, left: str, right: str) -> list[int]:
    """Indices of the features that hold for the span s between the characters left and right ('' at an edge)."""
    n = len(_digits(s))
    parts = s.split(".")
    digits = _digits(s)
    kinds = {c for c in s if not c.isalnum()}
    held = (
        True,
        "@" in s,
        "@" in s and "." in s.rpartition("@")[2] and s.rpartition("@")[2].replace(".", "").replace("-", "").isalnum() and s.count("@") == 1 and not s.startswith("@"),
        s.count(".") == 3,
        len(parts) == 4 and all(p.isdigit() and p.isascii() and _small(p) for p in parts),
        13 <= n <= 19 and luhn(digits),
        any(c.isalpha() for c in s),
        s.startswith("+"),
        "(" in s and ")" in s,
        " " in s,
        "-" in s,
        1 <= n <= 3,
        4 <= n <= 8,
        9 <= n <= 12,
        13 <= n <= 15,
        16 <= n <= 19,
        n >= 20,
        s[-1].isalnum(),
        not left or left.isspace(),
        not right or right in " .,;:!?)",
        len(re.findall(r"[0-9]+", s)) >= 3,
        bool(kinds - set(" ().+-@")),
        s.count(".") >= 2 and all(p.isdigit() and p.isascii() for p in parts) and not (len(parts) == 4 and all(map(_small, parts))),
        13 <= n <= 19 and not luhn(digits),
        _DATE.fullmatch(s) is not None,
        ":" in s,
        "." in s,
    )
    return [i for i, h in enumerate(held) if h]


def lattice(text: str) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Token borders, and the candidate segments (first token, token after, features) of an island."""
    tokens = [m.group() for m in _TOKEN.finditer(text)]
    at = [0]
    for t in tokens:
        at.append(at[-1] + len(t))
    out = []
    solid = [t[0].isalnum() for t in tokens]
    for i, t in enumerate(tokens):
        if not (solid[i] or t in "+(") or (i and solid[i] and solid[i - 1]):
            continue
        for j in range(i + 1, min(i + MOST_TOKENS, len(tokens)) + 1):
            if not solid[j - 1] or (j < len(tokens) and solid[j]):
                continue
            s = text[at[i] : at[j]]
            if _TRIGGER.search(s):
                out.append((i, j, features(s, text[at[i] - 1 : at[i]], text[at[j] : at[j] + 1])))
    return at, out


class SemiCrf:
    """Weights of whole-span features by kind, and of the label that follows a label; label 0 is `none`."""

    def __init__(self, spans: list[list[float]] | None = None, turns: list[list[float]] | None = None):
        labels = len(KINDS) + 1
        self.spans = spans or [[0.0] * len(FEATURES) for _ in range(labels)]
        self.turns = turns or [[0.0] * labels for _ in range(labels)]

    def _scored(self, segments):
        by_end: dict[int, list] = {}
        for i, j, held in segments:
            by_end.setdefault(j, []).append((i, held, [sum(w[f] for f in held) for w in self.spans]))
        return by_end

    def decode(self, text: str) -> list[Span]:
        """The labelling with the highest score: boundaries and kinds are chosen together."""
        at, segments = lattice(text)
        if not segments:
            return []
        by_end, n, labels = self._scored(segments), len(at) - 1, range(len(self.spans))
        best = [[-math.inf] * len(labels) for _ in range(n + 1)]
        back: list[list] = [[None] * len(labels) for _ in range(n + 1)]
        best[0][0] = 0.0

        def arrive(i: int, j: int, y: int, score: float) -> None:
            before = max(labels, key=lambda x: best[i][x] + self.turns[x][y])
            value = best[i][before] + self.turns[before][y] + score
            if value > best[j][y]:
                best[j][y], back[j][y] = value, (i, before)

        for j in range(1, n + 1):
            arrive(j - 1, j, 0, 0.0)
            for i, _, scores in by_end.get(j, ()):
                for y in labels[1:]:
                    arrive(i, j, y, scores[y])
        out, j = [], n
        y = max(labels, key=lambda x: best[n][x])
        while j:
            i, before = back[j][y]
            if y:
                out.append((y, at[i], at[j]))
            j, y = i, before
        return out[::-1]

    def learn(self, examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, rate: float = 0.5) -> SemiCrf:
        """Gradient ascent on the conditional log-likelihood, by forward and backward sums over all segmentations."""
        told = []
        for text, gold in examples:
            at, segments = lattice(text)
            where = {p: k for k, p in enumerate(at)}
            truth = {(where.get(a), where.get(b)): y for y, a, b in gold}
            known = {(i, j) for i, j, _ in segments}
            if set(truth) <= known:
                told.append((len(at) - 1, segments, truth))
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for n, segments, truth in told:
                self._climb(n, segments, truth, step)
        return self

    def _climb(self, n, segments, truth, step):
        labels = range(len(self.spans))
        by_end = self._scored(segments)
        arcs = []  # i, j, label, features, score
        for j in range(1, n + 1):
            arcs.append((j - 1, j, 0, (), 0.0))
            arcs += [(i, j, y, held, s[y]) for i, held, s in by_end.get(j, ()) for y in labels[1:]]
        turn = [[math.exp(x) for x in row] for row in self.turns]
        gain = [math.exp(a[4]) for a in arcs]
        # sums are scaled so that each position's largest is 1
        ahead = [[0.0] * len(labels) for _ in range(n + 1)]
        scale = [0.0] * (n + 1)
        ahead[0][0] = 1.0
        k = 0
        for j in range(1, n + 1):
            first = k
            while k < len(arcs) and arcs[k][1] == j:
                k += 1
            peak = max(scale[arcs[q][0]] for q in range(first, k))
            for q in range(first, k):
                i, _, y, _, _ = arcs[q]
                ahead[j][y] += gain[q] * math.exp(scale[i] - peak) * sum(ahead[i][x] * turn[x][y] for x in labels)
            top = sum(ahead[j])
            ahead[j] = [v / top for v in ahead[j]]
            scale[j] = peak + math.log(top)
        total = scale[n]
        behind = [[0.0] * len(labels) for _ in range(n + 1)]
        behind[n] = [1.0] * len(labels)  # in units of exp(total - scale)
        into: dict[tuple[int, int], float] = {}
        for q in range(len(arcs) - 1, -1, -1):
            i, j, y, held, _ = arcs[q]
            out = gain[q] * math.exp(scale[i] - scale[j]) * behind[j][y]
            for x in labels:
                behind[i][x] += turn[x][y] * out
            p = out * sum(ahead[i][x] * turn[x][y] for x in labels)
            if p > 1e-9:
                for x in labels:
                    into[x, y] = into.get((x, y), 0.0) + out * ahead[i][x] * turn[x][y]
            p = min(p, 1.0)
            if held:
                d = step * ((truth.get((i, j)) == y) - p)
                w = self.spans[y]
                for f in held:
                    w[f] += d
        assert total == total
        path, before, j = [], 0, 0
        ends = {i: (e, y) for (i, e), y in truth.items()}
        while j < n:
            e, y = ends.get(j, (j + 1, 0))
            path.append((before, y))
            before, j = y, e
        for x, y in path:
            self.turns[x][y] += step
        for (x, y), p in into.items():
            self.turns[x][y] -= step * p

    def dump(self) -> str:
        return json.dumps([self.spans, self.turns])

    @classmethod
    def load(cls, told: str) -> SemiCrf:
        return cls(*json.loads(told))


def variants(text: str, gold: list[Span]) -> list[tuple[str, list[Span]]]:
    """An island, and it again in ways the base patterns miss or reject.

    Written otherwise, and still personal: a phone without its plus, a card in groups joined by dots. Made wrong, and
    so no entity: a card whose check digit is off by one, an address with a part over 255.
    """
    out = [(text, gold)]
    if len(gold) == 1:
        y, a, b = gold[0]
        if KINDS[y - 1] == "phone":
            out.append((text[:a] + text[a + 1 :], [(y, a, b - 1)]))
        if KINDS[y - 1] == "card":
            out.append((text[: b - 1] + str((int(text[b - 1]) + 1) % 10) + text[b:], []))
            if text[a:b].isdigit():
                dotted = ".".join(text[k : min(k + 4, b)] for k in range(a, b, 4))
                out.append((text[:a] + dotted + text[b:], [(y, a, a + len(dotted))]))
        if KINDS[y - 1] == "ip":
            last = text[a:b].rpartition(".")[0]
            out.append((f"{text[:a]}{last}.{300 + b % 600}{text[b:]}", []))
    return out


def negatives(count: int = MADE, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Made islands that are no personal data though they look alike: dates, times, versions, order numbers, long runs
    of digits that fail the check sum, dotted numbers beyond 255, prices and measures."""
    r = random.Random(seed)
    digits = lambda n: str(r.randrange(1, 10)) + "".join(r.choice("0123456789") for _ in range(n - 1))
    out = []
    for _ in range(count):
        year, month, day = r.randrange(1900, 2100), r.randrange(1, 13), r.randrange(1, 29)
        out += [f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{day}/{month}/{year}"]
        out += [f"{year}-{month:02}-{day:02} {r.randrange(24):02}:{r.randrange(60):02}", f"{year} - {r.randrange(1900, 2100)}"]
        out += [f"{r.randrange(30)}.{r.randrange(30)}.{r.randrange(300)}", f"v{r.randrange(9)}.{r.randrange(30)}.{r.randrange(30)}"]
        out += [digits(r.randrange(1, 9)), "#" + digits(8), digits(r.randrange(1, 4)) + "-" + digits(r.randrange(3, 6))]
        out += [f"{digits(3)}.{digits(3)}.{r.randrange(256)}.{r.randrange(256, 1000)}", f"${digits(3)}.{digits(2)}", digits(2) + "%"]
        long = digits(r.randrange(13, 20))
        out.append(long if not luhn(long) else long[:-1] + str((int(long[-1]) + 1) % 10))
    return [(t, []) for t in out]


def examples(found: list[str]) -> list[tuple[str, list[Span]]]:
    """What the model learns from: islands labelled by the base patterns, their variants, the made negatives; mixed."""
    out = [v for t in found for v in variants(t, base_spans(t))] + negatives()
    random.Random(1).shuffle(out)
    return out


def train(docs: DataFrame, sample: int = SAMPLE, longest: int = 200) -> SemiCrf:
    """Fit on a bounded sample: of the distinct islands of all texts (of `longest` characters at most) with base spans
    the `sample` first by hash, and so of those without, labelled by the base patterns; besides, their variants and
    the made negatives. Each task passes on 2 x sample islands at most, so little is shuffled."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bool, dict[str, int]] = {True: {}, False: {}}
        for batch in batches:
            for text in batch.column(0):
                for _, s in islands(text.as_py() or ""):
                    if len(s) <= longest:
                        first[bool(base_spans(s))][s] = xxhash.xxh64_intdigest(s) >> 1
            for gold, known in first.items():
                if len(known) > sample:
                    first[gold] = dict(heapq.nsmallest(sample, known.items(), key=lambda x: (x[1], x[0])))
        for gold, known in first.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64()), pa.array([gold] * len(known), pa.bool_())],
                names=["island", "h", "gold"],
            )

    rows = docs.select("text").mapInArrow(found, "island string, h long, gold boolean").distinct()
    picked = [r[0] for gold in (True, False) for r in rows.filter(F.col("gold") == gold).orderBy("h", "island").limit(sample).collect()]
    return SemiCrf().learn(examples(picked))


def all_spans(text: str, model: SemiCrf) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and what the model adds that overlaps none of them), each by kind and start."""
    base = base_spans(text)
    added = []
    taken = sorted((a, b) for _, a, b in base)
    k = 0
    for start, island in islands(text):
        for y, a, b in model.decode(island):
            a, b = a + start, b + start
            while k < len(taken) and taken[k][1] <= a and taken[k][0] < a:
                k += 1
            if not any(x < b and a < z for x, z in taken[max(0, k - 8) : k + 8]):
                added.append((y, a, b))
    return base, sorted(base + added)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[y - 1]}:{a}:{b}" for y, a, b in spans)


def find_pii(docs: DataFrame, model: SemiCrf) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of docs.

    Counts and digest are of the base spans; spans are these and the ones the model adds, as kind:start:end in code
    points. Null and empty texts have none. Rows are independent: repeated ones give equal results, also under one id
    or a null one, an empty table an empty result; further columns are ignored. Time and memory follow a text's length.
    """
    told = model.dump()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiCrf.load(told)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans, extra = [], [], []
            for text in batch.column(1):
                base, every = all_spans(text.as_py() or "", own)
                for k, column in enumerate(counts, 1):
                    column.append(sum(y == k for y, _, _ in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
                extra.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"{schema}, base_sha256 string, spans string, n_added long")
