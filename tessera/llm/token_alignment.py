"""Cross-tokenizer alignment: two tokenizers' ids of a text, cut where tokens of both end at the same byte.

Of each text, both tokenizers give ids whose bytes join to a space and the text. The cumulative ends of either
list are kept as a dictionary from end to index; the keys that both hold, sorted, slice both id lists
into groups. Within a group tokens are linked where their bytes overlap. A pair of ids counts once for each
document that holds it linked, over the whole corpus.

A text that is null or empty, or that a tokenizer doesn't give back byte for byte (it normalises, or gives an
unknown token), has no tokens: counts of 0 and no groups.

Ids and counts are gathered in one pass, which writes a row a document with its distinct pairs. The counts are
reduced in batches before they are shuffled. To bring them back to the documents, either all of them are sent to
every task, when there are few (``most_sent``, counted first), or documents are dealt into parts, each part
asks once for the pairs that it holds, and is joined with the answers alone. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, lists, map_arrow, materialise, text_or_empty
from tessera.runtime import ship


@dataclass(frozen=True)
class Tokenizers:
    """Where the two vocabularies lie: a byte-level BPE as JSON (A), and a model of pieces (B). Local paths are
    read by the driver, others by Spark; executors get the bytes.

    ``most_sent``: pairs that are sent to every task at most, 16 bytes each. ``part``: documents of a part beyond that.
    """

    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"
    most_sent: int = 4_000_000
    part: int = 2000


def _bytes_of(spark: SparkSession, path: str) -> bytes:
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as file:
        return file.read()


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others in
    order from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: How byte-level BPE splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The code points for which both encoders of A are tested to agree.
PLAIN_BELOW = 0x250


class Encoders:
    """Both tokenizers, made from the bytes of their files, and the bytes of each of their tokens."""

    def __init__(self, a: bytes, b: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.b_bytes = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.fast = self._ranks(json.loads(a), vocabulary)
        self.said = [f"{i}{mark}" for table, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for mark in marks for i in range(len(table))]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, table))) for table in (self.a_bytes, self.b_bytes))

    def _ranks(self, spec: dict, vocabulary: dict[str, int]):
        """A quicker encoder of the same vocabulary, if its merges are in the order of the ids they make."""
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"].get("merges", [])]
        made = [vocabulary.get(m.replace(" ", "")) for m in merges]
        split = spec.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not spec.get("normalizer")
        if not usual or split.get("add_prefix_space") or any(i is None for i in made) or made != sorted(made):
            return None
        import tiktoken

        special = {t["id"] for t in spec.get("added_tokens", [])}
        ranks = {self.a_bytes[i]: i for i in vocabulary.values() if i not in special}
        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str, raw: bytes) -> np.ndarray | None:
        """The ids of A, or none if their bytes aren't the text's."""
        if self.fast is not None and (text.isascii() or ord(max(text)) < PLAIN_BELOW):
            a = np.array(self.fast.encode_ordinary(text), np.int64)
            # It merges bytes of the text and changes none, so bytes can only be missing.
            return a if int(self.a_sizes[a].sum()) == len(raw) else None
        ids = self.a.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.int64) if b"".join(map(self.a_bytes.__getitem__, ids)) == raw else None

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Both id lists, or two empty ones."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        whole = " " + text
        raw = whole.encode()
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return none, none
        a = self.encode_a(whole, raw)
        return (none, none) if a is None else (a, np.array(b, np.int64))


def cuts(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices after the tokens of either side that end at a common place, in order."""
    a_ends, b_ends = np.cumsum(a_sizes).tolist(), np.cumsum(b_sizes).tolist()
    a = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True))
    b = dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    # Keys stand in order on both sides, so the common ones come sorted and in step.
    return np.array([i for end, i in a.items() if end in b], np.int64), np.array([j for end, j in b.items() if end in a], np.int64)


def links(a_sizes: np.ndarray, b_sizes: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the linked tokens in both lists, slice by slice.

    No two inner ends of a slice are equal, so m and n tokens make m + n - 1 overlaps: each inner end passes one token.
    """
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    inner = np.ones(len(b_ends), bool)
    inner[b_cuts - 1] = False
    ends = np.concatenate([a_ends, b_ends[inner]])
    ends.sort(kind="stable")  # two sorted runs
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def _said(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, said: list[str], width_a: int, width_b: int) -> str:
    """The slices as text. ``said`` has each id of A before a comma and before a bar, then each of B before a comma and a semicolon."""
    a = a.copy()
    b = b + 2 * width_a
    a[a_cuts - 1] += width_a
    b[b_cuts - 1] += width_b
    out = np.empty(len(a) + len(b), np.int64)
    # An A token stands after the B tokens of the slices before its own, a B token after the A tokens up to its slice's end.
    slice_of_a = np.repeat(np.arange(len(a_cuts)), np.diff(a_cuts, prepend=0))
    slice_of_b = np.repeat(np.arange(len(b_cuts)), np.diff(b_cuts, prepend=0))
    out[np.arange(len(a)) + np.concatenate([[0], b_cuts])[slice_of_a]] = a
    out[np.arange(len(b)) + a_cuts[slice_of_b]] = b
    return "".join(map(said.__getitem__, out.tolist()))[:-1]


_made: dict[str, Encoders] = {}


def _encoders(key: str, files: Broadcast) -> Encoders:
    """A worker's encoders, made once for each pair of files."""
    if key not in _made:
        _made.clear()
        _made[key] = Encoders(*files.value)
    return _made[key]


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
GROUPS = "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"


def align(docs: DataFrame, how: Tokenizers = Tokenizers(), groups: bool = True) -> DataFrame:
    """doc_id and the alignment of every whole text.

    pairs holds the distinct linked id pairs in order, as A id times the size of B's vocabulary plus B id, and times
    how often each is linked. With ``groups``, also both id lists and, for each group, the index after its last A and B token.
    """
    spark = docs.sparkSession
    ship(spark)
    read = _bytes_of(spark, how.a), _bytes_of(spark, how.b)
    key = hashlib.sha256(read[0] + read[1]).hexdigest()
    files = spark.sparkContext.broadcast(read)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = _encoders(key, files)
        width = len(e.b_bytes)
        numbers = np.zeros((4, batch.num_rows), np.int64)
        digests, pairs, times, kept = [], [], [], ([], [], [], [])
        for row, text in enumerate(batch.column(1)):
            a, b = e.encode(text.as_py())
            a_sizes, b_sizes = e.a_sizes[a], e.b_sizes[b]
            a_cuts, b_cuts = cuts(a_sizes, b_sizes)
            x, y = links(a_sizes, b_sizes, a_cuts, b_cuts)
            codes = a[x] * width + b[y]
            numbers[:, row] = len(a), len(b), len(a_cuts), len(codes)
            said = _said(a, b, a_cuts, b_cuts, e.said, len(e.a_bytes), width) if len(a) else ""
            digests.append(hashlib.sha256(said.encode()).hexdigest() if len(a) else "")
            pair, time = np.unique(codes, return_counts=True)
            pairs.append(pair)
            times.append(time)
            if groups:
                for out, value in zip(kept, (a, b, a_cuts, b_cuts), strict=True):
                    out.append(value)
        sizes = np.array([len(p) for p in pairs])
        arrays = [batch.column(0), *map(pa.array, numbers), pa.array(digests, pa.string())]
        arrays += [lists(np.concatenate(pairs), sizes, pa.int64()), lists(np.concatenate(times).astype(np.int32), sizes, pa.int32())]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        if groups:
            arrays += [pa.array(x, pa.list_(pa.int32())) for x in kept]
            names += ["a_ids", "b_ids", "a_cuts", "b_cuts"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return map_arrow(rows, each, f"doc_id long, {ALIGNED}" + (f", {GROUPS}" if groups else ""))


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): the documents that hold each pair, and whether no pair of its A id has more.

    Each batch adds up its own pairs, so a pair that every document holds is a row a batch in the shuffle.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        pair, count = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(count.astype(np.int64))], names=["pair", "count"])

    counts = map_arrow(aligned.select("pairs"), each, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    a = F.expr(f"pair div {width}")
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))  # a row an id of A
    with_best = counts.withColumn("a", a).join(highest, "a")
    return with_best.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _sums(pairs: pa.ListArray, times: pa.ListArray, known: np.ndarray, count: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n_best, count_sum) of each list of pairs, from all that these lists hold, sorted."""
    sizes = np.diff(pairs.offsets.to_numpy())
    at = np.searchsorted(known, pairs.flatten().to_numpy(zero_copy_only=False))
    time = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = []
    for value in (best[at] * time, count[at] * time):
        sums = np.zeros(len(value) + 1, np.int64)
        np.cumsum(value, out=sums[1:])
        ends = np.cumsum(sizes)
        out.append(sums[ends] - sums[ends - sizes])
    return out[0], out[1]


_SUMS = "n_best long, count_sum long"
_PLAIN = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _by_sending(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Every task gets all counts, which the caller has found to be few."""
    got = counts.orderBy("pair").toArrow()
    columns = [got.column(c).to_numpy() for c in ("pair", "count", "best")]
    shared = aligned.sparkSession.sparkContext.broadcast(columns)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = _sums(batch.column(len(_PLAIN)), batch.column(len(_PLAIN) + 1), *shared.value)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(_PLAIN)], *map(pa.array, sums)], names=[*_PLAIN, "n_best", "count_sum"])

    schema = f"doc_id long, {ALIGNED.split(', pairs')[0]}, {_SUMS}"
    return map_arrow(aligned.select(*_PLAIN, "pairs", "times"), each, schema)


def _by_parts(aligned: DataFrame, counts: DataFrame, part: int) -> DataFrame:
    """Documents are dealt into parts of about ``part``; each part asks once for each pair that it holds.

    A part's answers are no more than its own distinct pairs, so a task holds a part whatever the corpus has.
    """
    parts = max(1, -(-aligned.count() // part))
    dealt = aligned.withColumn("part", F.pmod(F.xxhash64("doc_id", "groups_sha256", "n_a", F.monotonically_increasing_id()), F.lit(parts)))
    dealt = materialise(dealt, "alignment-parts")  # the dealing isn't drawn again
    asked = dealt.select(F.col("part").alias("asker"), F.explode("pairs").alias("pair")).distinct()
    answers = asked.join(counts, "pair").select("asker", "pair", "count", "best")

    def each(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("pair")
        columns = [known.column(c).to_numpy() for c in ("pair", "count", "best")]
        sums = _sums(docs.column("pairs").combine_chunks(), docs.column("times").combine_chunks(), *columns)
        out = docs.select(_PLAIN)
        return out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    schema = f"doc_id long, {ALIGNED.split(', pairs')[0]}, {_SUMS}"
    return dealt.groupBy("part").cogroup(answers.groupBy("asker")).applyInArrow(each, schema)


def alignment_digest(docs: DataFrame, how: Tokenizers = Tokenizers()) -> DataFrame:
    """The digest columns of the query."""
    import sentencepiece

    spark = docs.sparkSession
    width = sentencepiece.SentencePieceProcessor(model_proto=_bytes_of(spark, how.b)).vocab_size()
    aligned = materialise(align(docs, how, groups=False), "alignment")
    counts = materialise(pair_counts(aligned, width), "alignment-pairs")
    if counts.count() <= how.most_sent:
        out = _by_sending(aligned, counts)
        discard(counts)
        return out
    return _by_parts(aligned, counts, how.part)
