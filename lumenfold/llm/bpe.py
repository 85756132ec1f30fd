"""Byte-level BPE by longest matches and backtracking over pairs that may stand side by side."""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Distinct pieces in each of the two generations a worker remembers (about 25 MB each).
REMEMBERED = 120_000
#: Pairs of tokens whose compatibility a worker remembers.
MOST_PAIRS = 300_000
#: Longer pieces are encoded each time, so that memory stays bounded.
REMEMBERED_CHARS = 64


class BytePairs:
    """The ids that greedy merging by rank gives, found without merging.

    Bytes are read as Latin-1 characters, so that one automaton of all tokens reports every match in a piece. A
    sequence of tokens is what merging gives exactly if each adjacent pair stays as it is when merged on its own;
    encoding takes the longest match at each place whose pair with the token before is compatible, and steps back
    where none is, marking places from which the rest was tried. Compatible pairs are remembered.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= 1 << 16:
            raise ValueError("pairs are packed into 16 bits a token")
        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.token = {v: k for k, v in self.ranks.items()}
        self.bytes_of = {str(v): k for k, v in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for text, rank in self.ranks.items():
            self.automaton.add_word(text, (rank, len(text) - 1))
        self.automaton.make_automaton()
        self.size = [len(self.token.get(r, "")) for r in range(max(self.token, default=-1) + 1)]
        self.decimal = [str(r) for r in range(len(self.size))]
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.prefix: dict[int, int] = {}
        self.fits: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> BytePairs:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, text: str, below: int | None = None) -> list[int]:
        """Plain merging of the lowest rank first, leftmost first; only ranks under `below` if given."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(((r, i) for r, i in ranked if r is not None and (below is None or r < below)), default=(None, 0))
            if rank is None:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; the token twice for a byte; None if no merge makes it."""
        if token not in self.halves:
            text = self.token[token]
            if len(text) == 1:
                self.halves[token] = (token, token)
            else:
                parts = self.merged(text, token)
                self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        found = self.prefix.get(token)
        if found is None:
            text = self.token[token]
            found = next((self.ranks[text[:i]] for i in range(len(text) - 1, 0, -1) if text[:i] in self.ranks), -1)
            self.prefix[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging left's and right's bytes together gives the two back; left is -1 at the start.

        Undo the merges of both sides from the last one: before each, the tokens that meet at the border must not
        have a merge that comes earlier than the ones still standing.
        """
        stays = self.split(right) is not None and (left < 0 or self._stays(left, right))
        if len(self.fits) >= MOST_PAIRS:
            self.fits.clear()
        self.fits[left << 16 ^ right] = stays
        return stays

    def _stays(self, a: int, b: int) -> bool:
        limit = None
        while True:
            joint = self.ranks.get(self.token[a] + self.token[b])
            if joint is not None and (limit is None or joint < limit):
                return False
            a_whole, b_whole = len(self.token[a]) == 1, len(self.token[b]) == 1
            if a_whole and b_whole:
                return True
            # the higher rank was merged last; of equal ones the left is merged first
            if b_whole or (not a_whole and a > b):
                limit, a = a, self.split(a)[1]
            else:
                limit, b = b + 1, self.split(b)[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.encode_latin(piece.decode("latin-1"))

    def encode_latin(self, text: str) -> list[int]:
        """The ids of a piece whose bytes are written as Latin-1 characters.

        The automaton reports the longest match at each place, one behind the other. Where one is not compatible with
        the token before it, the longest shorter token that is takes its place, and matching goes on from its end; where
        there is none, the token before is shortened in turn, and its end is marked as one that leads nowhere.
        """
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        known, size, prefix, find = self.fits.get, self.size, self.prefix.get, self.automaton.iter_long
        out: list[int] = []
        dead: set[int] = set()
        pos, before, n = 0, -1, len(text)
        found = find(text)
        while True:
            for _, (t, back) in found:
                fits = known(before << 16 ^ t)
                if not (self.compatible(before, t) if fits is None else fits) or pos + back + 1 in dead:
                    break
                out.append(t)
                before = t
                pos += back + 1
            else:
                return out
            while True:
                told = prefix(t)
                t = self.shorter(t) if told is None else told
                if t < 0:
                    if not out:
                        raise ValueError("a byte has no token")
                    dead.add(pos)
                    t = out.pop()
                    pos -= size[t]
                    before = out[-1] if out else -1
                    continue
                fits = known(before << 16 ^ t)
                if (self.compatible(before, t) if fits is None else fits) and pos + size[t] not in dead:
                    out.append(t)
                    before = t
                    pos += size[t]
                    break
            if pos == n:
                return out
            found = find(text, pos)


#: Below this code point a text is split by the faster standard module, with the classes written out.
NARROW = 0x250


def narrowed(pattern: str) -> str:
    r"""pattern with \p{L}, \p{N} and \s written out for code points below NARROW."""
    below = [chr(c) for c in range(NARROW)]
    classes = {
        r"\p{L}": "".join(c for c in below if unicodedata.category(c)[0] == "L"),
        r"\p{N}": "".join(c for c in below if unicodedata.category(c)[0] == "N"),
        r"\s": "\t\n\x0b\x0c\r \x85\xa0",
    }
    out, inside = [], False
    for part in re.findall(r"\\p\{.\}|\\.|.", pattern, re.S):
        inside = part == "[" or (inside and part != "]")
        if part == r"\S":
            part = "[^" + classes[r"\s"] + "]"
        elif part in classes:
            part = classes[part] if inside else f"[{classes[part]}]"
        out.append(part)
    return "".join(out)


class Encoder(dict):
    """piece -> its ids as decimal text. When full, the younger half of what it remembers stays."""

    def __init__(self, pairs: BytePairs, pattern: str, remembered: int = REMEMBERED):
        super().__init__()
        self.pairs, self.old, self.remembered = pairs, {}, remembered
        self.any, self.narrow = regex.compile(pattern).findall, re.compile(narrowed(pattern)).findall
        self.beyond = re.compile(f"[^\x00-{chr(NARROW - 1)}]").search

    def pieces(self, text: str) -> list[str]:
        return self.any(text) if self.beyond(text) else self.narrow(text)

    def __missing__(self, piece: str) -> str:
        ids = self.old.get(piece)
        if ids is None:
            latin = piece if piece.isascii() else piece.encode().decode("latin-1")
            ids = ",".join(map(self.pairs.decimal.__getitem__, self.pairs.encode_latin(latin)))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= self.remembered:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> str:
        return ",".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.pairs.bytes_of.__getitem__, ids.split(","))) if ids else b""


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str, remembered: int = REMEMBERED) -> Encoder:
    """One for each vocabulary and worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(BytePairs.load(path), pattern)
    _loaded[path, pattern].remembered = remembered
    return _loaded[path, pattern]


def encode_docs(
    docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False, remembered: int = REMEMBERED
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs, and ids (array of int) on request.

    Each match of pattern is encoded by itself, without special tokens; then the ids are decoded again. A null text
    counts as empty and has no tokens. Rows are independent: repeated ones give the same result, also under one id or a
    null one, and a text that comes again right after itself is encoded once; an empty table gives an empty result;
    further columns are ignored. A very long text takes time and memory in proportion to its length. remembered bounds
    the pieces that a worker keeps, in each of two generations (some 240 bytes each).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern, remembered)
        last, told, decoded = None, "", ""
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts, ids_sha, decoded_sha, ids = [], [], [], []
                for text in part.column(1):
                    text = text.as_py() or ""
                    if text != last:
                        last, told = text, coder.encode(text)
                        decoded = hashlib.sha256(coder.decode(told)).hexdigest()
                    counts.append(told.count(",") + 1 if told else 0)
                    ids_sha.append(hashlib.sha256(told.encode()).hexdigest())
                    decoded_sha.append(decoded)
                    if with_ids:
                        ids.append(np.fromstring(told, np.int32, sep=",") if told else [])
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
