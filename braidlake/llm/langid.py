"""Language identification by unigram pieces, summed over all segmentations.

Every language has a distribution over the pieces of a fixed public vocabulary. A word's probability under a language is
the sum over all ways to cut the word into pieces, found by a forward pass; a text's is the product over its words. The
distributions are trained by expectation maximisation over words of labelled documents. Counts come back per language and
piece, so what reaches the driver is bounded by the vocabulary times the languages, and so is what is broadcast.

A word is a run of letters, in lower case. Words of up to 24 letters that a task has not met are scored together, all words of
a length at once; longer ones, of any length, by a forward pass that rescales as it goes, so that nothing underflows. Only
training reads long runs in parts of 24 letters.

Defined results: `und` and score 0 for a text that is null or has no letter, and for all texts when nothing was learned;
equal scores go to the language first in order; rows that repeat are scored each; very long texts are scored whole, some words at a time; an
empty table gives no rows; other columns pass through unread, but for columns named lang_pred and score, which the results
replace.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm._common import give_back, share_of, slices

#: Training reads about so many documents of each language, taken by the hash of their id.
SAMPLE_DOCUMENTS = 1_000
ROUNDS, PSEUDO, FLOOR = 2, 200.0, 1e-9
#: Letters of a word that is scored with others and remembered, words that a task remembers, and words that it looks up together.
LONGEST, MEMORY, AT_ONCE = 24, 120_000, 50_000
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_TRIES: dict[str, dict] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def trie(vocabulary: str) -> dict:
    """The vocabulary's pieces, lower case, as nested dicts; key 0 holds a piece's number."""
    if vocabulary not in _TRIES:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        root: dict = {}
        for n, piece in enumerate(dict.fromkeys(p.lower() for p in pieces)):
            node = root
            for ch in piece:
                node = node.setdefault(ch, {})
            node[0] = n
        root[0] = n + 1
        _TRIES[vocabulary] = root
    return _TRIES[vocabulary]


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _parts(found: list[str]) -> list[str]:
    """Words for training, long ones in parts."""
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


def arcs(root: dict, word: str) -> list[tuple[int, int, int]]:
    """(start, end, piece) of every piece in the word, starts ascending; -1 for a letter outside the vocabulary."""
    s, out = "▁" + word, []
    for i in range(len(s)):
        node, single = root, False
        for j in range(i, len(s)):
            node = node.get(s[j])
            if node is None:
                break
            if 0 in node:
                out.append((i, j + 1, node[0]))
                single |= j == i
        if not single:
            out.append((i, i + 1, -1))
    return out


def forward(lattice: list[tuple[int, int, int]], n: int, rows, width: int) -> list[list[float]]:
    """Probabilities of all prefixes, for each language, summed over segmentations."""
    alpha = [[0.0] * width for _ in range(n + 1)]
    alpha[0] = [1.0] * width
    for i, j, piece in lattice:
        a, b, p = alpha[i], alpha[j], rows[piece]
        for k in range(width):
            b[k] += a[k] * p[k]
    return alpha


def _expected(root: dict, counts: Counter, rows) -> Counter:
    """Expected uses of each piece in words under one distribution: forward-backward."""
    out: Counter = Counter()
    for word, n in counts.items():
        lattice, m = arcs(root, word), len(word) + 1
        alpha, beta = forward(lattice, m, rows, 1), [0.0] * m + [1.0]
        for i, j, piece in reversed(lattice):
            beta[i] += rows[piece][0] * beta[j]
        for i, j, piece in lattice:
            if piece >= 0 and beta[0] > 0:
                out[piece] += n * alpha[i][0] * rows[piece][0] * beta[j] / beta[0]
    return out


class Model:
    """Languages in order and a table (pieces + 1) x languages; the last row is a letter outside the vocabulary."""

    def __init__(self, vocabulary: str, languages: list[str], table: np.ndarray):
        self.vocabulary, self.languages, self.table, self.tag = vocabulary, languages, table, uuid.uuid4().hex


def train(docs: DataFrame, vocabulary: str | None = None, sample: int = SAMPLE_DOCUMENTS) -> Model:
    """Learns from (doc_id, text, lang). Rows without a language or text are not used."""
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    languages, size = sorted(sizes), trie(vocabulary)[0]
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & share_of(F.col("doc_id"), sample / n))
    docs = docs.where(keep).select("lang", "text")
    start = 1.0 / (np.arange(size) + 100.0)
    start /= start.sum()
    table = np.repeat(np.append(start, FLOOR)[:, None], max(1, len(languages)), axis=1)
    schema = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("uses", pa.float64())])
    for _ in range(ROUNDS if languages else 0):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def expect(batches):
            root, counts = trie(vocabulary), defaultdict(Counter)
            for b in slices(batches):
                for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    counts[lang].update(_parts(words(text)))
            for lang, c in counts.items():
                rows = shared.value[:, languages.index(lang)][:, None].tolist()
                uses = _expected(root, c, rows)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(uses), "piece": list(uses), "uses": list(uses.values())}, schema=schema)

        got = docs.mapInArrow(expect, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        counts = np.zeros((size, len(languages)))
        for lang, piece, uses in sorted(map(tuple, got.collect())):
            counts[piece, languages.index(lang)] = round(uses, 6)
        pooled = counts.sum(axis=1, keepdims=True) + 0.01
        pooled /= pooled.sum()
        table = np.vstack([(counts + PSEUDO * pooled) / (counts.sum(axis=0) + PSEUDO), np.full(len(languages), FLOOR)])
    return Model(vocabulary, languages, table)


class Pieces:
    """The trie as a hash table of all prefixes of pieces: a 64-bit hash of code points -> the piece's number, NONE if it is
    no piece itself. Slots are probed one after another, for whole arrays of hashes."""

    BITS, BASE, SPREAD, NONE = 20, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, -2

    def __init__(self, root: dict):
        self.longest, todo, hashes, pieces = 0, [(root, 0, 0)], [], []
        while todo:
            node, h, depth = todo.pop()
            self.longest = max(self.longest, depth)
            for ch, child in node.items():
                if ch != 0:
                    below = (h * self.BASE + ord(ch) + 1) & (1 << 64) - 1
                    hashes.append(below)
                    pieces.append(child.get(0, self.NONE))
                    todo.append((child, below, depth + 1))
        bits = max(self.BITS, len(hashes).bit_length() + 2)
        self.shift, self.keys, self.values = np.uint64(64 - bits), np.zeros((1 << bits) + len(hashes), np.uint64), np.zeros((1 << bits) + len(hashes), np.int32)
        for h, at, piece in zip(hashes, self._slots(np.array(hashes, np.uint64)).tolist(), pieces, strict=True):
            while self.keys[at]:
                at += 1
            self.keys[at], self.values[at] = h, piece

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(self.SPREAD) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is that of a prefix, and its piece."""
        at = self._slots(h)
        key = self.keys[at]
        there = key == h
        left = np.flatnonzero(~there & (key != 0))
        while len(left):
            at[left] += 1
            key = self.keys[at[left]]
            there[left] = key == h[left]
            left = left[(key != 0) & (key != h[left])]
        return there, self.values[at]


def forward_all(pieces: Pieces, found: list[str], table: np.ndarray) -> np.ndarray:
    """What `forward` gives at the end of words, all of one length, for each language: one step takes the pieces of a start
    and a length in all words."""
    m, n = len(found), len(found[0]) + 1
    points = np.frombuffer("".join("▁" + w for w in found).encode("utf-32-le"), np.uint32).reshape(m, n).T.astype(np.uint64) + np.uint64(1)
    alpha = np.zeros((n + 1, m, table.shape[1]))
    alpha[0] = 1.0
    for i in range(n):
        rows, h = np.arange(m), np.zeros(m, np.uint64)
        for j in range(i, min(n, i + pieces.longest)):
            h = h * np.uint64(Pieces.BASE) + points[j, rows]
            there, piece = pieces.find(h)
            if j == i:  # a letter that is no piece is one outside the vocabulary
                alpha[i + 1] += alpha[i] * table[np.where(there & (piece >= 0), piece, -1)]
            else:
                use = there & (piece >= 0)
                alpha[j + 1, rows[use]] += alpha[i, rows[use]] * table[piece[use]]
            rows, h = rows[there], h[there]
            if not len(rows):
                break
    return alpha[n]


#: Letters of a long word whose pieces are looked up together.
STRETCH = 1 << 14


def log_forward(pieces: Pieces, word: str, table: list[list[float]], width: int) -> list[float]:
    """The logarithm of what `forward` gives at the end of a word of any length, for each language.

    The sums of the last starts are all that a place needs; they are divided by a common factor before they get too small,
    a factor for each language, and the factors' logarithms are added up.
    """
    text, longest = "▁" + word, pieces.longest
    n, logs = len(text), [0.0] * width
    last = [[1.0] * width]  # the sums of the places up to here, the latest first
    for first in range(0, n, STRETCH):
        stop = min(n, first + STRETCH)
        points = np.frombuffer(text[first : stop + longest].encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        into = [[] for _ in range(stop - first + longest)]  # (length, piece) of the arcs that end after a place
        h, alive = np.zeros(stop - first, np.uint64), np.arange(stop - first)
        for k in range(longest):
            alive = alive[alive + k < len(points)]
            h[alive] = h[alive] * np.uint64(Pieces.BASE) + points[alive + k]
            there, piece = pieces.find(h[alive])
            good = there & (piece >= 0)
            if k == 0:
                good, piece = np.ones(len(alive), bool), np.where(good, piece, -1)
            for i, p in zip(alive[good].tolist(), piece[good].tolist(), strict=True):
                into[i + k].append((k + 1, p))
            alive = alive[there]
        if first:
            for i, arcs_ in enumerate(ahead):
                into[i] = arcs_ + into[i]
        ahead = into[stop - first :]
        for here in into[: stop - first]:
            sums = [0.0] * width
            for length, p in here:
                a, row = last[length - 1], table[p]
                for c in range(width):
                    sums[c] += a[c] * row[c]
            last = [sums, *last[: longest - 1]]
            if min(sums) < 1e-200:
                for c in range(width):
                    factor = max(sums[c], 1e-300)
                    logs[c] += math.log(factor)
                    for a in last:
                        a[c] /= factor
    return [x + math.log(y) for x, y in zip(logs, last[0], strict=True)]


class Scorer(dict):
    """word -> row of a table of log probabilities; starts afresh when it would hold more than MEMORY words."""

    def __init__(self, model: Model):
        super().__init__()
        self.pieces, self.table = Pieces(trie(model.vocabulary)), model.table
        _TRIES.clear()  # a worker that scores needs the table only
        self.rows = model.table.tolist()
        self.logs = np.zeros((MEMORY, len(model.languages)))

    def _learn(self, parts: list[list[str]]) -> None:
        new = set().union(*parts).difference(self)
        if len(self) + len(new) > MEMORY:
            self.clear()
            new = set().union(*parts)
        by: dict[int, list[str]] = defaultdict(list)
        for word in new:
            by[len(word)].append(word)
        for same in by.values():
            for k in range(0, len(same), 8_192):
                some, n = same[k : k + 8_192], len(self)
                self.logs[n : n + len(some)] = np.log(np.maximum(forward_all(self.pieces, some, self.table), 1e-300))
                self.update(zip(some, range(n, n + len(some)), strict=True))

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of texts under each language, and the number of words of each."""
        total, sizes = np.zeros((len(texts), self.logs.shape[1])), np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []

        def settle():
            self._learn([p for _, p in held])
            for k, part in held:
                total[k] += self.logs[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0)
            held.clear()

        n = 0
        for k, text in enumerate(texts):
            found = words(text) if text else []
            sizes[k] = len(found)
            if any(len(w) > LONGEST for w in found):
                for w in found:
                    if len(w) > LONGEST:
                        total[k] += log_forward(self.pieces, w, self.rows, total.shape[1])
                found = [w for w in found if len(w) <= LONGEST]
            for i in range(0, len(found), AT_ONCE):
                held.append((k, found[i : i + AT_ONCE]))
                n += len(held[-1][1])
                if n >= AT_ONCE:
                    settle()
                    n = 0
        settle()
        return total, sizes


_SCORERS: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score, the posterior of the predicted language under equal priors, to docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def predicted(batches):
        key = shared.value.tag
        scorer = _SCORERS.get(key)
        if scorer is None and shared.value.languages:
            _SCORERS.clear()
            scorer = _SCORERS[key] = Scorer(shared.value)
        for b in slices(batches, 512):
            langs, scores = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows)
            if scorer is not None:
                logs, sizes = scorer.scores(b.column(at).to_pylist())
                best = logs.argmax(axis=1)
                logs = np.clip(logs - logs.max(axis=1, keepdims=True), -700, 0)
                scores = np.where(sizes > 0, 1.0 / np.exp(logs).sum(axis=1), 0.0)
                langs = [shared.value.languages[k] if n else UNDETERMINED for k, n in zip(best.tolist(), sizes.tolist(), strict=True)]
            own = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)
            yield pa.RecordBatch.from_arrays([*b.columns, *own.columns], [*b.schema.names, "lang_pred", "score"])
        scorer = None
        _SCORERS.clear()
        give_back()

    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(predicted, ", ".join([*fields, "lang_pred string", "score double"]))


def held_out():
    """Whether crc32 of the doc_id as text leaves 1 when divided by 3; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
