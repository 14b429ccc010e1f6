"""Toxicity: texts are restored through a noisy channel, then scored.

What a writer did to hide a word is undone by Viterbi decoding. Wherever a text can have been obfuscated it opens into a lattice
of characters: a digit or sign beside letters may stand for a letter (leetspeak), a repeated letter for one or two of
it, and a space or mark between single letters, or a mark inside a word, for nothing (spacing). Each arc costs what the
channel asks for it, in bits, and each path what a character language model gives its characters; the cheapest path is the
restored text. The model is of order 4 over 32 classes of characters, counted over all texts of the corpus with Witten-Bell
smoothing. Where three characters in a row have one reading, all paths share the model's context, so the lattice is
cut there and its pieces are decoded, and remembered, apart; the result is that of the whole lattice.

The restored text is scored by logistic regression on its hashed words and the character n-grams of its words, learned
(FTRL-proximal) from a bounded sample of labelled rows. A null or empty text has the intercept's score.

Counting is a map and a reduction to at most 32**4 rows, the model is 4 MB for any corpus, and restoring and scoring is one map.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import lexer
from tessera.llm.common import least_hashed, lists, map_arrow, text_or_empty, utf8
from tessera.llm.quality_ftrl import Ftrl, _interleaved, held_out, learn
from tessera.runtime import ship

# Classes of bytes: 0 between words, 1 to 26 letters, 27 digits, 28 to 31 further characters by their last byte;
# 32 for the first byte of a longer character, which isn't counted.
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[97:123] = np.arange(1, 27)
_CLASSES[65:91] = np.arange(1, 27)
_CLASSES[48:58] = 27
_CLASSES[128:192] = 28 + (np.arange(64) & 3)
_CLASSES[192:] = 32
_CLASS = _CLASSES.tobytes()
_LOWER = lexer.LOWER.tobytes()
ORDER = 4
_SIZE = 32**ORDER
_CONTEXT = 32 ** (ORDER - 1) - 1

#: Letters that a digit or sign can stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}
_SIGN = rb"[013456789@$!|+*]"
_ONE = rb"[a-z013456789@$!|+*]"
SPACED = re.compile(_ONE + rb"(?:[ ._\-]" + _ONE + rb"){2}")
#: A place with more than one reading, and such places less than three characters apart.
_OPEN = (
    rb"(?:(?<!\S)" + _ONE + rb"(?:[ ._\-]" + _ONE + rb"){2,}(?!\S)"  # single letters, spaced
    rb"|([a-z])\1+|(?<=[a-z])" + _SIGN + rb"+|" + _SIGN + rb"+(?=[a-z])"  # a letter repeated; signs beside a letter
    rb"|(?<=[a-z])[._\-~'](?=[a-z013457@$!|+*]))"  # a mark inside a word
)
_OPEN_AGAIN = _OPEN.replace(rb"([a-z])\1+", rb"([a-z])\2+")
_REST = rb"[^a-z0-9\x80-\xbf]*"  # bytes that make one class at most
PLACES = re.compile(_OPEN + rb"(?:" + _REST + rb"(?:[a-z0-9\x80-\xbf]" + _REST + rb"){0,2}?" + _OPEN_AGAIN + rb")*")
#: Bytes on either side of a piece that its context is read from.
REACH = 8


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SIGNS, _MARKS, _BETWEEN = _table(b"013456789@$!|+*"), _table(b"._-~'"), _table(b" ._-")


def _beginnings(lower: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where PLACES can match in these texts, and some places where it doesn't."""
    n = len(lower)
    letter, sign = (lower >= 97) & (lower <= 122), _SIGNS[lower]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    before = np.zeros(n, bool)  # a letter of the same text stands before
    before[1:] = letter[:-1] & ~first[1:]
    again = np.zeros(n, bool)  # the same letter comes next
    again[:-1] = letter[:-1] & (lower[1:] == lower[:-1]) & ~first[1:]
    out = again | (_MARKS[lower] & before)
    out[1:] |= sign[1:] & (~sign[:-1] | first[1:])
    out[:1] |= sign[:1]
    if n > 4:
        one = letter | sign
        spaced = one[:-4] & _BETWEEN[lower[1:-3]] & one[2:-2] & _BETWEEN[lower[3:-1]] & one[4:]
        out[:-4] |= spaced
    return np.flatnonzero(out)


@dataclass(frozen=True)
class Channel:
    """Bits of: a sign for a letter, a sign as itself, two of a letter for one, a mark in a word for nothing or a gap between single letters
    for a gap. ``remembered``: decoded pieces that a worker keeps."""

    sign: float = 2.0
    plain: float = 4.0
    double: float = 8.0
    gap: float = 4.0
    remembered: int = 200_000


def _symbols(data: bytes) -> list[int]:
    """Classes with runs between words as one."""
    out: list[int] = []
    for c in data.translate(_CLASS):
        if c != 32 and (c or not out or out[-1]):
            out.append(c)
    return out


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The codes of all sequences of classes of these texts, a text's context beginning between words."""
    kind = np.insert(_CLASSES[data], offsets, 0)  # a gap before all and after each text, which belongs to it
    text = np.repeat(np.arange(len(offsets)), np.diff(offsets + np.arange(len(offsets)) + 1, prepend=0))
    keep = kind != 32
    kind, text = kind[keep], text[keep]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != 0) | (kind[:-1] != 0)
    kind, text = kind[keep].astype(np.int32), text[keep]
    code = kind.copy()
    for k in range(1, ORDER):
        same = text[k:] == text[:-k]
        code[k:] += np.where(same, kind[:-k], 0) << (5 * k)
    return code[code > 0]  # not the gaps before all and after empty texts


def count_grams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each sequence of ORDER classes stands in the corpus, texts between spaces. At most 32**4 sums come back."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a in range(0, batch.num_rows, 64):
                at = offsets[a : min(a + 65, batch.num_rows + 1)]
                total += np.bincount(_grams(data[at[0] : at[-1]], at - at[0]), minlength=_SIZE)
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(total[live])], names=["code", "times"])

    ship(docs.sparkSession)
    sums = docs.select(text_or_empty(text_col)).mapInArrow(each, "code long, times long").groupBy("code").agg(F.sum("times").alias("times"))
    got = sums.toArrow()
    out = np.zeros(_SIZE, np.int64)
    out[got.column("code").to_numpy()] = got.column("times").to_numpy()
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Bits of the last class of each sequence after the others: Witten-Bell, down to equal odds."""
    odds = np.full(32, 1 / 32)
    for order in range(1, ORDER + 1):
        times = counts.reshape(-1, 32**order).sum(0).reshape(-1, 32).astype(float)
        kinds = np.count_nonzero(times, axis=1, keepdims=True)
        total = times.sum(1, keepdims=True) + kinds
        lower = np.tile(odds.reshape(-1, 32), (32 if order > 1 else 1, 1))  # contexts differ in their first class most slowly
        odds = np.where(total > 0, (times + kinds * lower) / np.maximum(total, 1), lower).reshape(-1)
    return -np.log2(odds).astype(np.float32)


def readings(piece: bytes, how: Channel, spaced: bool) -> list[list[tuple[bytes, list[int], float]]]:
    """The lattice of a lower-case piece: for each run of a character its (bytes, classes, bits)."""
    out = []
    for match in re.finditer(rb"(.)\1*", piece, re.S):
        run = match.group()
        c, n = run[:1], len(run)
        kind = _CLASS[c[0]]
        if 1 <= kind <= 26:
            once, twice = (c, [kind], 0.0 if n != 2 else how.double), (c + c, [kind, kind], 0.0)
            out.append([once] if n == 1 else [once, twice])
            continue
        letters = LEET.get(chr(c[0]), "")
        among = spaced and c in b" ._-"
        asked = how.gap if among else how.plain if letters and kind != 27 and c != b"!" else 0.0
        options = [(run, [kind] * n if kind >= 27 and kind != 32 else [] if kind == 32 else [kind], asked)]
        for letter in letters:
            code = ord(letter) - 96
            options.append((letter.encode(), [code], how.sign))
            if n > 1:
                options.append((letter.encode() * 2, [code, code], how.sign))
        if n == 1 and (among or c in b"._-~'"):
            options.append((b"", [], 0.0 if among else how.gap))
        out.append(options)
    return out


def decode(piece: bytes, before: list[int], after: list[int], bits: array, how: Channel) -> bytes:
    """The cheapest path through the lattice of a piece between these classes. Of equal ones, the first read."""
    context = 0
    for c in before:
        context = context * 32 + c
    spaced = SPACED.match(piece) is not None
    paths = {context & _CONTEXT: (0.0, b"")}
    for options in [*readings(piece, how, spaced), [(b"", after, 0.0)]]:
        new: dict[int, tuple[float, bytes]] = {}
        for context, (cost, text) in paths.items():
            for said, classes, asked in options:
                at, total = context, cost + asked
                for c in classes:
                    if c == 0 and not at & 31:
                        continue  # runs between words count once
                    at = at * 32 + c
                    total += bits[at]
                    at &= _CONTEXT
                if at not in new or total < new[at][0]:
                    new[at] = (total, text + said)
        paths = new
    return min(paths.values(), key=lambda p: p[0])[1]


class Restorer:
    """Restores texts; remembers decoded pieces by their context."""

    def __init__(self, bits: np.ndarray, how: Channel) -> None:
        self.bits, self.how = array("f", bits.tobytes()), how
        self.known: dict[tuple[bytes, bytes, bytes], bytes] = {}

    def _piece(self, match: re.Match) -> bytes:
        a, b, whole = match.start(), match.end(), match.string
        key = (whole[max(0, a - REACH) : a], match.group(), whole[b : b + REACH])
        out = self.known.get(key)
        if out is None:
            before = [0] * ORDER + _symbols(b" " + key[0])
            after = _symbols(key[2] + b" ")[: ORDER - 1]
            out = decode(key[1], before[-ORDER + 1 :], after, self.bits, self.how)
            if len(self.known) >= self.how.remembered:
                self.known.clear()
            self.known[key] = out
        return out

    def text(self, raw: bytes) -> bytes:
        """The restored text, A-Z lower-cased."""
        return PLACES.sub(self._piece, raw.translate(_LOWER))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The same of many texts: the pattern is tried only where a place can begin."""
        lower = lexer.LOWER[data]
        begins = _beginnings(lower, offsets)
        cut = np.searchsorted(begins, offsets)
        whole, begins = lower.tobytes(), (begins - np.repeat(offsets[:-1], np.diff(cut))).tolist()
        out = []
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            raw, last, parts = whole[a:b], 0, []
            for at in begins[cut[k] : cut[k + 1]]:
                if at >= last and (match := PLACES.match(raw, at)) is not None:
                    parts += (raw[last:at], self._piece(match))
                    last = match.end()
            out.append(b"".join((*parts, raw[last:])) if parts else raw)
        return out


def features(data: np.ndarray, offsets: np.ndarray, bits: int, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature): the distinct hashed words and character 5-grams of words (ends of words marked) of every text, by text.

    With ``live`` only those features that it is true of: repeats are looked for among them alone.
    """
    n = len(offsets) - 1
    codes = []
    words, _, _, counts = lexer.words(data, offsets, lower=True)
    codes.append((np.repeat(np.arange(n), counts), words ^ np.uint64(1 << 62)))
    kind = _CLASSES[data]
    gap = kind == 0
    sums = lexer.prefix_sums(np.where(gap, 1, lexer.LOWER[data]).astype(np.uint64) + np.uint64(1))
    inside = np.concatenate([[0], np.cumsum(gap)])
    text = np.repeat(np.arange(n), np.diff(offsets))
    for size in (5,):
        start = np.arange(max(len(data) - size + 1, 0))
        one = text[start] == text[start + size - 1]
        one &= inside[start + size - 1] - inside[start + 1] == 0  # only its ends may stand between words
        start = start[one]
        codes.append((text[start], lexer.windows(sums, start, start + size)))
    doc = np.concatenate([d for d, _ in codes]).astype(np.uint64)
    key = np.concatenate([k for _, k in codes]) >> np.uint64(64 - bits)
    if live is not None:
        good = live[key]
        doc, key = doc[good], key[good]
    code = np.unique(doc << np.uint64(bits) | key)
    return (code >> np.uint64(bits)).astype(np.int64), (code & np.uint64((1 << bits) - 1)).astype(np.int64)


#: How the score is learned from presence of features.
LEARNING = Ftrl(bits=20, alpha=1.5, l1=3.0, l2=0.1, epochs=6)
_made: dict[str, Restorer] = {}


def restored(rows: DataFrame, model: np.ndarray, how: Channel, run, schema: str) -> DataFrame:
    """Map batches whose last column is a text through ``run(batch, data, offsets)`` with the restored texts, about a megabyte at once."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    key = f"{model.tobytes().__hash__()} {how}"

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _made:
            _made.clear()
            _made[key] = Restorer(shared.value, how)
        texts = _made[key].texts(*utf8(batch.column(batch.num_columns - 1)))
        offsets = np.cumsum([0, *map(len, texts)])
        return run(batch, np.frombuffer(b"".join(texts), np.uint8), offsets)

    return map_arrow(rows, each, schema)


def _pieces(data: np.ndarray, offsets: np.ndarray, bits: int, live: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    a, n = 0, len(offsets) - 1
    while a < n:  # about a megabyte at once, or one text
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20), "right")) - 1)
        yield a, b, *features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits, live)
        a = b


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, model: np.ndarray, channel: Channel = Channel(), how: Ftrl = LEARNING, label_col: str = "toxic"
) -> np.ndarray:
    """Weights from ``usable`` rows of ``labels`` that are labelled 0 or 1: ``per_class`` whole texts of each class at most, by the least
    hashes of ids and then of rows. Texts are restored where they lie; the learning task gets their features."""
    wanted = labels.where(usable & F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    wanted = wanted.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label"), F.xxhash64("doc_id").alias("h"))
    sizes = wanted.groupBy("label").agg(F.count("*").alias("size"))  # two rows
    wanted = least_hashed(wanted, "label", "h", how.per_class, sizes).select("id", "label", "h")
    rows = docs.select(F.col("doc_id").alias("id"), text_or_empty("text").alias("text")).join(F.broadcast(wanted), "id")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id", "text")))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= how.per_class)
    rows = rows.repartition(32, F.xxhash64("id", "text")).select("h", "id", "label", "text")

    def shorten(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        keys, sizes = [], []
        for a, b, doc, key in _pieces(data, offsets, how.bits):
            keys.append(key)
            sizes.append(np.bincount(doc, minlength=b - a))
        held = lists(np.concatenate(keys).astype(np.int32), np.concatenate(sizes), pa.int32())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], held], names=["h", "id", "label", "held"])

    short = restored(rows, model, channel, shorten, "h long, id long, label int, held array<int>")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for label, held in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                key = held.values.to_numpy(zero_copy_only=False).astype(np.int64)
                examples.append((key, np.ones(len(key)), label))
        weights = learn(_interleaved(examples), how)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], names=["feature", "weight"])

    got = short.repartition(1).sortWithinPartitions("h", "id", "label", F.xxhash64("held")).mapInArrow(fit, "feature long, weight double").toArrow()
    out = np.zeros((1 << how.bits) + 1)
    out[got.column("feature").to_numpy()] = got.column("weight").to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray, model: np.ndarray, channel: Channel = Channel(), how: Ftrl = LEARNING, threshold: float = 0.7, texts: bool = False) -> DataFrame:
    """doc_id, score and predicted (score at the threshold or above) of every whole text; with ``texts`` its restored text as well."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def each(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        weights = shared.value
        total = np.full(batch.num_rows, float(weights[-1]))
        for a, b, doc, key in _pieces(data, offsets, how.bits, weights[:-1] != 0):
            total[a:b] += np.bincount(doc, weights[key], b - a)
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        arrays, names = [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
        if texts:
            arrays.append(pa.array([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]))
            names.append("restored")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("scored_text"))
    return restored(rows, model, channel, each, "doc_id long, score double, predicted int" + (", restored string" if texts else ""))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    model = language_model(count_grams(docs))
    weights = train(docs, labels, ~held_out(), model)
    return score(docs, weights, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
