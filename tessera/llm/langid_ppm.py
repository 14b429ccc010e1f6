"""Language identification by prediction with partial matching.

For each language a context tree over bytes counts what follows every context of up to ``order``
bytes in a bounded training sample. A byte seen in a context n times of N costs -log2(n / (N + q)) bits,
q being the distinct bytes seen there; any other byte costs an escape, -log2(q / (N + q)), and is coded
in the next shorter context; below the empty context a byte costs 8 bits. Contexts never seen cost
no escape. The counts are frozen, so a text has one exact code length in each language, and the
shortest names it.

Scoring looks each position up once for all languages. A node of the joint tree is any string of up to
order + 1 bytes seen in some language. At each position the longest node that ends there is found, and
the cost is a sum of two stored numbers: what the node's last byte costs in its own contexts less the escapes
of these, and the escapes of the longest context before the byte. Both hold for every language, with or without
that node.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import groups, least_hashed, map_arrow, text_or_empty, utf8
from tessera.llm.lexer import LOWER

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case (A-Z, and the two-byte letters U+00C0 to U+00DE) with every run of ASCII
    other than letters as one space, as digits and punctuation say little of a language."""
    space = (data < 128) & ~_ASCII_LETTER[data]
    out = np.where(space, np.uint8(32), LOWER[data])
    if not len(data):
        return out, offsets
    after = np.append(False, data[:-1] == 0xC3)
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    keep = ~(space & np.append(False, space[:-1]))
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.append(0, np.cumsum(keep))
    return out[keep], at[offsets]


@dataclass
class Tables:
    """Nodes of one length: sorted codes, and hashed slots that find them."""

    codes: np.ndarray
    slots: list[np.ndarray]
    bits: int

    @staticmethod
    def of(codes: np.ndarray) -> Tables:
        bits = max(8, int(len(codes) - 1).bit_length() + 1)
        left, slots = np.arange(len(codes)), []
        for m in _MULTIPLIERS:
            slot = np.full(1 << bits, -1, np.int32)
            where = _slot(codes[left], m, bits)
            slot[where[::-1]] = left[::-1]
            slots.append(slot)
            left = left[slot[where] != left]
        return Tables(codes, slots, bits)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The index of each code, -1 where there is none."""
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        out = self.slots[0][_slot(codes, _MULTIPLIERS[0], self.bits)]
        missed = np.flatnonzero((out < 0) | (self.codes[out] != codes))
        out[missed] = -1
        for m, slot in zip(_MULTIPLIERS[1:], self.slots[1:], strict=True):
            if not len(missed):
                return out
            got = slot[_slot(codes[missed], m, self.bits)]
            ok = (got >= 0) & (self.codes[got] == codes[missed])
            out[missed[ok]] = got[ok]
            missed = missed[~ok]
        if len(missed):  # the few that found no slot in any table
            got = np.minimum(np.searchsorted(self.codes, codes[missed]), len(self.codes) - 1)
            ok = self.codes[got] == codes[missed]
            out[missed[ok]] = got[ok]
        return out


def _slot(codes: np.ndarray, multiplier: int, bits: int) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(multiplier) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """``own[k]`` and ``gone[k]``, rows by node of k + 1 bytes, columns by language: the stored numbers.
    ``cut``: for the longest nodes the index of the node without their first byte."""

    names: list[str]
    order: int
    tables: list[Tables]
    own: list[np.ndarray]
    gone: list[np.ndarray]
    cut: np.ndarray

    @staticmethod
    def train(texts: dict[str, list[bytes]], order: int = 3) -> Model:
        names = sorted(texts)
        counts = [[_count(texts[name], k) for k in range(order + 1)] for name in names]
        every = [np.unique(np.concatenate([c[k][0] for c in counts])) if names else np.empty(0, np.uint64) for k in range(order + 1)]
        n_lang = len(names)
        cost, escapes, own, gone = [], [], [], []
        below = np.full((1, n_lang), 8.0)  # the cost of any byte below the empty context
        for k in range(order + 1):
            codes = every[k]
            suffix = np.zeros(len(codes), np.int64) if k == 0 else np.searchsorted(every[k - 1], codes & np.uint64((1 << 8 * k) - 1))
            context = np.zeros(len(codes), np.int64) if k == 0 else np.searchsorted(every[k - 1], codes >> np.uint64(8))
            n_context = 1 if k == 0 else len(every[k - 1])
            now = np.zeros((len(codes), n_lang))
            escape = np.zeros((n_context, n_lang))
            for j, c in enumerate(counts):
                n = np.zeros(len(codes))
                n[np.searchsorted(codes, c[k][0])] = c[k][1]
                total, kinds = np.bincount(context, n, n_context), np.bincount(context, n > 0, n_context)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[:, j] = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
                    seen = -np.log2(n / (total + kinds)[context])
                now[:, j] = np.where(n > 0, seen, escape[context, j] + below[suffix, j])
            cost.append(now)
            # Escapes from a context down to the empty one: of a node of k bytes its own and its suffix's.
            if k == 0:
                escapes.append(escape)
            else:
                shorter = np.zeros(n_context, np.int64) if k == 1 else np.searchsorted(every[k - 2], every[k - 1] & np.uint64((1 << 8 * (k - 1)) - 1))
                escapes.append(escape + escapes[k - 1][shorter])
            own.append((now - escapes[k][context]).astype(np.float32))
            below = now
        gone = [e.astype(np.float32) for e in escapes]  # gone[k]: by node of k bytes, gone[0] of the empty one
        cut = np.searchsorted(every[order - 1], every[order] & np.uint64((1 << 8 * order) - 1)).astype(np.int32) if order and n_lang else np.empty(0, np.int32)
        return Model(names, order, [Tables.of(c) for c in every], own, gone, cut)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The code length of each text in each language, on bytes folded by fold()."""
        out = np.zeros((len(offsets) - 1, len(self.names)))
        for a, b in groups(offsets, 1 << 19):
            lo, hi = int(offsets[a]), int(offsets[b])
            for x in range(lo, hi, 1 << 20):
                y = min(hi, x + (1 << 20))
                # A text's bytes before the piece are context too.
                ahead = min(self.order + 1, x - lo)
                cost = self._cost(data[x - ahead : y], offsets[a : b + 1] - (x - ahead))[ahead:]
                inner = np.unique(np.clip(offsets[a : b + 1], x, y))
                inner = inner[inner < y]
                rows = np.searchsorted(offsets, inner, "right") - 1
                np.add.at(out, rows, np.add.reduceat(cost, inner - x, axis=0, dtype=np.float64))
        return out

    def _cost(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n, n_lang = len(data), len(self.names)
        # How many bytes, itself included, a position has in its own text.
        have = np.full(n, self.order + 1, np.int8)
        for s in starts[(starts >= 0) & (starts < n)].tolist():
            for k in range(min(self.order, n - s)):
                have[s + k] = min(have[s + k], k + 1)
        code = np.zeros(n, np.uint64)
        wide = data.astype(np.uint64)
        for k in range(self.order + 1):
            code[k:] |= wide[: n - k] << np.uint64(8 * k)
        length, node = np.zeros(n, np.int8), np.zeros(n, np.int32)
        left = np.arange(n)
        cost = np.empty((n, n_lang), np.float32)
        for k in range(self.order, -1, -1):
            able = left[have[left] > k] if k else left
            got = self.tables[k].find(code[able] & np.uint64((1 << 8 * (k + 1)) - 1))
            ok = got >= 0
            hit = able[ok]
            length[hit], node[hit] = k + 1, got[ok]
            cost[hit] = self.own[k][got[ok]]
            if len(hit) == len(left):
                left = left[:0]
                break
            mark = np.zeros(n, bool)
            mark[hit] = True
            left = left[~mark[left]]
        cost[left] = 8.0  # a byte that no language has: below the empty context
        # The longest context before each byte: the node that ends there, cut to the order.
        context, size = node.copy(), length.copy()
        long = size > self.order
        context[long], size[long] = self.cut[node[long]], self.order
        context, size = np.append(0, context[:-1]), np.append(0, size[:-1])
        size = np.minimum(size, have - 1)  # nothing before a text
        first = have == 1
        for k in range(self.order + 1):
            at = np.flatnonzero(size == k) if k else np.flatnonzero((size == 0) | first)
            cost[at] += self.gone[k][context[at] if k else np.zeros(len(at), np.int64)]
        return cost


def _count(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of k + 1 bytes of the texts as codes, and their counts."""
    codes = []
    for t in texts:
        b = fold(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].astype(np.uint64)
        if len(b) > k:
            code = np.zeros(len(b) - k, np.uint64)
            for j in range(k + 1):
                code |= b[k - j : len(b) - j] << np.uint64(8 * j)
            codes.append(code)
    return np.unique(np.concatenate(codes), return_counts=True) if codes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def training_sample(
    docs: DataFrame, held_out: Column, per_language: int = 400, most_languages: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, list[bytes]]:
    """A bounded sample: ``per_language`` whole texts of each language with the least hashes.

    A column that isn't clean may have a language a row. The ``most_languages`` with the most texts are learned, ties
    by name, so what is broadcast and fetched is bounded whatever the input; others are never predicted.
    """
    usable = docs.where(~held_out & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    sizes = usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("size"))
    sizes = sizes.orderBy(F.desc("size"), "lang").limit(most_languages)
    rows = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    out: dict[str, list[bytes]] = {}
    for lang, text in least_hashed(rows, "lang", "h", per_language, sizes).select("lang", "text").toLocalIterator():
        out.setdefault(lang, []).append(text.encode())
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) for every text, whole. The score is the share of the
    language's probability, two to the minus code length, in the sum of all. A null text, one without a
    letter, and any text if nothing was learned are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = shared.value, batch.column(1)
        data, offsets = utf8(texts)
        letters = np.append(0, np.cumsum(_ASCII_LETTER[data]))
        has = letters[offsets[1:]] > letters[offsets[:-1]]
        for i in np.flatnonzero(~has & (offsets[1:] > offsets[:-1])).tolist():
            has[i] = any(map(str.isalpha, texts[i].as_py()))
        n = len(has)
        if not model.names:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n))], names=names)
        data, offsets = fold(data, offsets)
        bits = model.bits(data, offsets)
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        score = np.where(has, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0.0)
        pred = [model.names[j] if ok else "und" for j, ok in zip(best.tolist(), has.tolist(), strict=True)]
        rate = least / np.maximum(1, np.diff(offsets))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(np.where(has, rate, 0.0))], names=names)

    names = [id_col, "lang_pred", "score", "bits_per_byte"]
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col), text_or_empty(text_col).alias("t")), each, f"`{id_col}` {kind}, lang_pred string, score double, bits_per_byte double")


def language_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the query; a null id is not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = Model.train(training_sample(docs, held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")
