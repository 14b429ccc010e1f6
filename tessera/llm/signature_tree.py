"""N-gram Jaccard join with signature trees.

A document is the set of hashes of its word n-grams; two sets link when their Jaccard similarity
reaches a threshold. Equal sets are one node. The join is exact:

1. *Order.* N-grams are ordered rare first by a count sketch of all documents, a fixed number of
   counters summed over all tasks. Linked sets share one of the first n - ceil(t n) + 1 n-grams of either in any
   fixed order, so the order decides about cost alone.
2. *Candidates.* Nodes meet in the buckets of these n-grams. In a bucket of up to ``small`` nodes all pairs
   of fitting sizes are counted, and a pair stays if the n-grams it shares, with those that it may share in larger
   buckets, can still reach the overlap that it needs. A larger bucket puts all its nodes in one cluster, a
   row a node. Connected candidates are a cluster.
3. *Trees.* Each set travels once to its cluster. There the nodes, those with like sets side by side, are the leaves of
   a tree whose inner nodes hold the OR of their leaves' token bitmaps and the range of their sizes. Pairs of tree
   nodes are traversed from the root; a pair is pruned when the overlap that its bitmaps allow is below what its sizes
   need, or when all its leaves are already connected. Leaf pairs that remain are compared exactly.
4. *Blocks.* A cluster above ``block`` nodes is dealt to blocks, a tree each. Every block also gets the cluster's
   ``hubs``, the nodes with the largest share of common n-grams, such as the originals of copies. That connects a
   group of copies whatever its size, in rows that are in proportion to it.
5. *Upper levels.* What stays outside a large cluster's largest component may link to any of its nodes. The upper levels
   of its tree are tables: the cluster is split by ranges of sizes, and each range by parts of its tokens, one part more
   than two linked sets of such sizes can have tokens that differ, so linked sets agree in a part. Only nodes that agree
   in a part meet: by their bitmaps alone while few do, and only pairs that these allow fetch their sets. Parts in
   which many agree are clusters of their own, with a tree for each pair of blocks.

Links are returned as a spanning forest of each component of the link graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tessera.llm import lexer
from tessera.llm.common import NULL_ID, discard, groups, keyed, lists, map_arrow, materialise, utf8
from tessera.llm.components import components
from tessera.runtime import ship

#: Counters of the sketch, a power of two, and the slices it travels in.
COUNTERS, SLICES = 1 << 21, 128


@dataclass(frozen=True)
class Join:
    """``words`` in an n-gram; link when 100 * intersection >= ``percent`` * union. A document of fewer
    words has its whole sequence as its one n-gram."""

    words: int = 4
    percent: int = 85
    small: int = 32
    block: int = 256
    hubs: int = 32

    def need(self, n: np.ndarray) -> np.ndarray:
        """The least overlap of a set of n with any set it links to."""
        return -(-self.percent * n // 100)

    def need_both(self, n: np.ndarray) -> np.ndarray:
        """The least overlap of two sets of n together."""
        return -(-self.percent * n // (100 + self.percent))

    def ranges(self, most: int) -> np.ndarray:
        """The first sizes of ranges up to ``most`` and three more, each such that a set links to none beyond the next
        range."""
        out = [1]
        while len(out) < 4 or out[-4] <= most:
            out.append(max(out[-1] + 1, -(-100 * out[-1] // self.percent)))
        return np.array(out, np.int64)

    def parts(self, low: int, high: int) -> int:
        """Parts of the tokens for sets of [low, high) and any larger ones they link to: one more than can differ."""
        both = high - 1 + (high - 1) * 100 // self.percent
        return both * (100 - self.percent) // (100 + self.percent) + 1


def sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct n-gram hashes, A-Z in lower case."""
    for a, b in groups(offsets, 1 << 18):
        hashes, _, _, counts = lexer.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        grams, have = lexer.ngrams(hashes, counts, words, short=True)
        at = 0
        for n in have.tolist():
            yield np.unique(grams[at : at + n])
            at += n


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """The counters: of how many documents' sets, about, each n-gram is a member. COUNTERS numbers,
    summed over all documents."""
    size = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for s in sets(*utf8(batch.column(0)), words):
                total[s & np.uint64(COUNTERS - 1)] += np.uint32(1)
        squeeze = zstandard.ZstdCompressor(level=1)
        packed = [squeeze.compress(total[i * size : (i + 1) * size].tobytes()) for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(packed, pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(open_.decompress(raw), np.uint32)
                held[k] = held[k] + more if k in held else more.astype(np.uint64)
        packed = [np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    ship(docs.sparkSession)
    parts = docs.select("text").mapInArrow(count, schema).repartition(16, "slice").mapInArrow(add, schema)
    out = np.zeros(COUNTERS, np.uint32)
    for k, raw in parts.toLocalIterator():
        out[k * size : (k + 1) * size] = np.frombuffer(raw, np.uint32)
    return out


def _described(docs: DataFrame, how: Join) -> DataFrame:
    """(doc_id, kid, kh, n, h1, h2, prefix): each document's set size, digest and first n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, how.words))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counters = shared.value
        sizes, digests, prefixes = [], [], []
        for s in sets(*utf8(batch.column(3)), how.words):
            n = len(s)
            sizes.append(n)
            digests.append(xxh3_128_digest(s.tobytes()))
            order = np.argsort(counters[s & np.uint64(COUNTERS - 1)], kind="stable")
            prefixes.append(s[order[: n - int(how.need(n)) + 1]] if n else s)
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        flat = np.concatenate(prefixes).view(np.int64)
        prefix = lists(flat, np.array([len(p) for p in prefixes]), pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), prefix], names=["doc_id", "kid", "kh", "n", "h1", "h2", "prefix"])

    return map_arrow(docs.select("doc_id", "kid", "kh", "text"), each, "doc_id long, kid long, kh long, n int, h1 long, h2 long, prefix array<long>")


def _candidates(nodes: DataFrame, how: Join) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(a, b): edges whose components hold both nodes of every link; (node, wide): how many of a node's
    first n-grams stand in large buckets; and the tables that both read."""
    tokens = nodes.select("node", "n", F.explode("prefix").alias("token"))
    buckets = tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    met = materialise(tokens.join(buckets, "token"), "jaccard-met")
    large = met.where(F.col("m") > how.small)
    centres = materialise(large.groupBy("token").agg(F.min("node").alias("a")), "jaccard-centres")
    stars = large.join(centres, "token").select("a", F.col("node").alias("b")).where("a != b").distinct()
    wide = large.groupBy("node").agg(F.count("*").alias("wide"))
    small = met.where(F.col("m") <= how.small).select("token", "node", "n")
    x, y = (small.select("token", F.col("node").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * how.percent)
    pairs = x.join(y, "token").where(fits).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    for k in "ab":
        pairs = pairs.join(wide.select(F.col("node").alias(k), F.col("wide").alias(f"wide_{k}")), k, "left")
    up = lambda x, by: F.ceil(x * how.percent / F.lit(by))
    # n-grams after the end of one prefix are fewer than that set's least overlap.
    least = up(F.col("n_a") + F.col("n_b"), 100 + how.percent) - up(F.greatest("n_a", "n_b"), 100) + 1
    might = F.col("shared") + F.least(F.coalesce("wide_a", F.lit(0)), F.coalesce("wide_b", F.lit(0)))
    return stars.unionByName(pairs.where(might >= least).select("a", "b")), wide, [met, centres]


class Tree:
    """The signature tree of sets, given as token numbers below ``tokens`` with the bounds of each."""

    FANOUT = 4

    def __init__(self, flat: np.ndarray, at: np.ndarray, how: Join) -> None:
        self.how, self.flat, self.at = how, flat, at
        self.n = np.diff(at)
        self.pruned = [0, 0]  # pairs of leaves, and of inner nodes, that bitmaps and sizes ruled out
        # Linked sets mostly have the same least token in a random order: they stand side by side.
        token = flat.astype(np.uint64)
        least = [np.minimum.reduceat(lexer.mix(token + np.uint64(k)), at[:-1]) for k in (1 << 40, 1 << 41)]
        self.order = np.lexsort((self.n, least[1], least[0]))
        n = self.n[self.order]
        bits = 1 << max(8, min(16, int(16 * np.median(n)).bit_length()))
        maps = np.zeros((len(n), bits), bool)
        place = (lexer.mix(flat.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
        rank = np.empty(len(n), np.int64)
        rank[self.order] = np.arange(len(n))
        packed = np.zeros((len(n), bits // 64), np.uint64)
        row = np.repeat(rank, self.n)
        for a in range(0, len(n), 512):  # the unpacked rows of 512 leaves at a time
            own = (row >= a) & (row < a + 512) if len(n) > 512 else slice(None)
            maps = np.zeros((min(512, len(n) - a), bits), bool)
            maps[row[own] - a, place[own]] = True
            packed[a : a + len(maps)] = np.packbits(maps, axis=1).view(np.uint64)
        self.maps, self.low, self.high = [packed], [n], [n]
        self.spare = [n - np.bitwise_count(packed).sum(axis=1)]  # tokens beyond the bits set
        while len(self.maps[-1]) > 1:
            cut = np.arange(0, len(self.maps[-1]), self.FANOUT)
            self.maps.append(np.bitwise_or.reduceat(self.maps[-1], cut))
            self.low.append(np.minimum.reduceat(self.low[-1], cut))
            self.high.append(np.maximum.reduceat(self.high[-1], cut))
            self.spare.append(np.maximum.reduceat(self.spare[-1], cut))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some set under a and some under b may link, by sizes and bitmaps."""
        low, high, spare, maps = self.low[level], self.high[level], self.spare[level], self.maps[level]
        ok = (100 * high[a] >= self.how.percent * low[b]) & (100 * high[b] >= self.how.percent * low[a])
        at = np.flatnonzero(ok)
        for k in range(0, len(at), 2048):
            i, j = a[at[k : k + 2048]], b[at[k : k + 2048]]
            common = np.bitwise_count(maps[i] & maps[j]).sum(axis=1, dtype=np.int64) + np.minimum(spare[i], spare[j])
            most = np.minimum(common, np.minimum(high[i], high[j]))
            ok[at[k : k + 2048]] = most >= self.how.need_both(low[i] + low[j])
        self.pruned[level > 0] += int(len(ok) - np.count_nonzero(ok))
        return ok

    def roots(self) -> np.ndarray:
        """The first member of each set's component of links."""
        k = len(self.n)
        parent = np.arange(k)

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = int(parent[i])
            return i

        mark = np.zeros(int(self.flat.max(initial=0)) + 1, bool)
        if k > 2:
            self._central(parent, find, mark)
        # All leaves below a node in one component: its label, else -1.
        label = np.array([find(i) for i in range(k)])[self.order]
        one = [label]
        for low in self.maps[1:]:
            cut = np.arange(0, len(one[-1]), self.FANOUT)
            least, most = np.minimum.reduceat(one[-1], cut), np.maximum.reduceat(one[-1], cut)
            one.append(np.where((least == most), least, -1))
            del low
        level = len(self.maps) - 1
        a = b = np.zeros(1, np.int64)
        while level > 0:
            level -= 1
            count = len(self.maps[level])
            down = np.arange(self.FANOUT)
            i = (a[:, None, None] * self.FANOUT + down[None, :, None] + np.zeros((1, 1, self.FANOUT), np.int64)).ravel()
            j = (b[:, None, None] * self.FANOUT + down[None, None, :] + np.zeros((1, self.FANOUT, 1), np.int64)).ravel()
            keep = (i < count) & (j < count) & (i <= j)
            if level == 0:
                keep &= i < j
            i, j = i[keep], j[keep]
            keep = (one[level][i] < 0) | (one[level][i] != one[level][j])
            i, j = i[keep], j[keep]
            keep = self._possible(level, i, j)
            a, b = i[keep], j[keep]
        if k > 1:
            self._verify(a, b, parent, find, mark)
        return np.array([find(i) for i in range(k)])

    def _central(self, parent: np.ndarray, find, mark: np.ndarray, most: int = 16) -> None:
        """Link what links to a few members that hold the commonest tokens: the originals of copies."""
        common = np.bincount(self.flat)
        held = np.add.reduceat(common[self.flat], self.at[:-1]) / self.n
        for i in np.argsort(-held, kind="stable")[:most].tolist():
            own = self.flat[self.at[i] : self.at[i + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[self.flat], self.at[:-1], dtype=np.int64)
            mark[own] = False
            links = np.flatnonzero(100 * both >= self.how.percent * (self.n + self.n[i] - both))
            for j in links.tolist():
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
            if len(links) == len(self.n):
                return

    def _verify(self, a: np.ndarray, b: np.ndarray, parent: np.ndarray, find, mark: np.ndarray) -> None:
        a, b = self.order[a], self.order[b]
        turn = np.argsort(a, kind="stable")
        last = own = None
        for i, j in zip(a[turn].tolist(), b[turn].tolist(), strict=True):
            x, y = find(i), find(j)
            if x == y:
                continue
            if i != last:
                if last is not None:
                    mark[own] = False
                own, last = self.flat[self.at[i] : self.at[i + 1]], i
                mark[own] = True
            both = int(np.count_nonzero(mark[self.flat[self.at[j] : self.at[j + 1]]]))
            if 100 * both >= self.how.percent * (self.n[i] + self.n[j] - both):
                parent[max(x, y)] = min(x, y)
        if last is not None:
            mark[own] = False


def forest(raw: list[bytes], how: Join) -> list[int]:
    """For each set, given as the bytes of its sorted hashes, the first member of its component."""
    if len(raw) < 2:
        return list(range(len(raw)))
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) // 8 for r in raw], out=at[1:])
    _, flat = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
    return Tree(flat, at, how).roots().tolist()


def _grams(docs: DataFrame, nodes: DataFrame, wide: DataFrame, clusters: DataFrame, how: Join) -> DataFrame:
    """(label, n, node, grams, hub), as a table: the sets of clustered nodes, with the number of blocks of their cluster."""
    sizes = clusters.groupBy("label").agg(F.ceil(F.count("*") / F.lit(how.block)).cast("int").alias("n"))
    wanted = clusters.join(sizes, "label").join(nodes.select("node", "kid", "h1", "h2", "p"), "node").join(wide, "node", "left")
    common = F.coalesce("wide", F.lit(0)) / F.col("p")
    large = wanted.where("n > 1").select("label", "node", F.row_number().over(W.partitionBy("label").orderBy(common.desc(), "node")).alias("r"))
    hubs = large.where(F.col("r") <= how.hubs).select("node", F.lit(True).alias("hub"))
    wanted = wanted.join(hubs, "node", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        h1, h2 = batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
        raw, take = [], []
        for i, s in enumerate(sets(*utf8(batch.column("text")), how.words)):
            own = s.tobytes()
            if np.frombuffer(xxh3_128_digest(own), np.int64).tolist() == [h1[i], h2[i]]:  # ids may repeat
                raw.append(own)
                take.append(i)
        rows = pa.array(take, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("label", "n", "node", "hub")), pa.array(raw, pa.binary())], names=["label", "n", "node", "hub", "grams"])

    rows = docs.select("kid", "text").join(wanted, "kid").select("label", "n", "node", "hub", "h1", "h2", "text")
    return materialise(map_arrow(rows, fetch, "label long, n int, node long, hub boolean, grams binary"), "jaccard-grams")


def _trees(rows: DataFrame, how: Join) -> DataFrame:
    """(a, b): a spanning forest of the links in each group (label, i, j) of (node, grams) rows."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            ids = list(held)
            root = forest(list(held.values()), how)
            held.clear()
            found = [(ids[r], ids[i]) for i, r in enumerate(root) if r != i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *key, node, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    yield from done()
                    at = key
                held[node] = grams
        yield from done()

    rows = rows.select("label", "i", "j", "node", "grams").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    return rows.mapInArrow(join, "a long, b long")


def _links(grams: DataFrame, how: Join) -> DataFrame:
    """(a, b): edges that connect what links connect inside the clusters."""
    block = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    own = grams.withColumn("i", block)
    spread = grams.where("hub").withColumn("own", block).withColumn("i", every).where("i <> own").drop("own")
    first = materialise(_trees(own.unionByName(spread).withColumn("j", F.lit(0)), how), "jaccard-links")
    large = grams.where("n > 1").select("label", "node")
    if not large.limit(1).count():
        return first
    named = components(first.join(large.select(F.col("node").alias("a")), "a", "left_semi"), "jaccard-blocks").select("node", F.col("label").alias("part"))
    parts = large.distinct().join(named, "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = parts.groupBy("label", "part").agg(F.count("*").alias("size"))
    main = materialise(sizes.groupBy("label").agg(F.max_by("part", F.struct("size", "part")).alias("main")), "jaccard-main")
    rest = materialise(parts.join(main, "label").where("part <> main").select("label", "node"), "jaccard-rest")
    out = first
    if rest.limit(1).count():
        out = first.unionByName(_upper_links(grams.where("n > 1"), rest, how))
    return out


def signature(s: np.ndarray, bits: int) -> bytes:
    """The bitmap of a set's tokens."""
    held = np.zeros(bits, bool)
    held[(lexer.mix(s) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(held).tobytes()


def agreements(s: np.ndarray, how: Join, ranges: np.ndarray) -> np.ndarray:
    """The keys of a set of sorted hashes: for its range of sizes, and the one below for larger partners, the hash of its
    tokens in each part. Linked sets have a key in common."""
    out = []
    own = int(np.searchsorted(ranges, len(s), "right")) - 1
    for k in (own, own - 1):
        if k < 0:
            continue
        parts = how.parts(int(ranges[k]), int(ranges[k + 1]))
        mixed = lexer.mix(s + np.uint64(k + 1))
        part = (mixed >> np.uint64(8)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(mixed[order], out=sums[1:])
        cut = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        total = lexer.mix(sums[cut[1:]] - sums[cut[:-1]] + np.uint64(1))
        out.append(lexer.mix(total ^ lexer.mix(np.arange(parts, dtype=np.uint64) + np.uint64(k << 32))))
    return np.concatenate(out)


def _signs(grams: DataFrame, how: Join, bits: int = 1024) -> DataFrame:
    """(label, node, size, sign, keys) of each set of (label, node, grams)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.frombuffer(raw, np.uint64) for raw in batch.column(2).to_pylist()]
        ranges = how.ranges(max(map(len, found)))
        keys = [agreements(x, how, ranges) for x in found]
        columns = [
            batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int32()),
            pa.array([signature(x, bits) for x in found], pa.binary()),
            lists(np.concatenate(keys).view(np.int64), np.array([len(k) for k in keys]), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["label", "node", "size", "sign", "keys"])

    kinds = "label long, node long, size int, sign binary, keys array<long>"
    return map_arrow(grams.select("label", "node", "grams"), each, kinds)


def _allowed(pairs: DataFrame, how: Join) -> DataFrame:
    """(a, b): the pairs (a, b, size_a, size_b, sign_a, sign_b) whose bitmaps allow the overlap they need."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        n, signs = [], []
        for k in "ab":
            n.append(batch.column(f"size_{k}").to_numpy().astype(np.int64))
            signs.append(np.frombuffer(b"".join(batch.column(f"sign_{k}").to_pylist()), np.uint64).reshape(batch.num_rows, -1))
        spare = [x - np.bitwise_count(m).sum(axis=1, dtype=np.int64) for x, m in zip(n, signs, strict=True)]
        most = np.bitwise_count(signs[0] & signs[1]).sum(axis=1, dtype=np.int64) + np.minimum(*spare)
        keep = pa.array(np.minimum(most, np.minimum(*n)) >= how.need_both(n[0] + n[1]))
        return pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return map_arrow(pairs, each, "a long, b long")


def _linked(pairs: DataFrame, how: Join) -> DataFrame:
    """(a, b): the pairs (a, b, grams_a, grams_b) that link."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= how.percent * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return map_arrow(pairs, each, "a long, b long")


def candidates_of_parts(signs: DataFrame, rest: DataFrame, how: Join) -> tuple[DataFrame, DataFrame]:
    """Where nodes of ``rest`` agree in a part with others of their cluster: (a, b), as a table, the pairs that the
    bitmaps allow, from parts in which few nodes agree; and (label, key, node, asked), those in which many do."""
    asked = rest.select("label", "node", F.lit(True).alias("asked"))
    keys = signs.join(asked, ["label", "node"], "left").select("label", "node", "size", F.coalesce("asked", F.lit(False)).alias("asked"), F.explode("keys").alias("key"))
    counts = keys.groupBy("label", "key").agg(F.count("*").alias("m"), F.max("asked").alias("any")).where("m > 1 AND any")
    met = materialise(keys.join(counts.drop("any"), ["label", "key"]), "jaccard-agree")
    small = met.where(F.col("m") <= how.small)
    x = small.where("asked").select("label", "key", F.col("node").alias("x"), F.col("size").alias("size_x"))
    y = small.select("label", "key", F.col("node").alias("y"), F.col("size").alias("size_y"))
    fits = (F.col("x") != F.col("y")) & (F.least("size_x", "size_y") * 100 >= F.greatest("size_x", "size_y") * how.percent)
    pairs = x.join(y, ["label", "key"]).where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    for k in "ab":
        pairs = pairs.join(signs.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("sign").alias(f"sign_{k}")), k)
    allowed = materialise(_allowed(pairs, how), "jaccard-allowed")
    return allowed, met.where(F.col("m") > how.small).select("label", "key", "node", "asked")


def _upper_links(grams: DataFrame, rest: DataFrame, how: Join) -> DataFrame:
    """(a, b), as a table: edges that connect the nodes of ``rest`` (label, node) to what they link to in their clusters."""
    grams = grams.select("label", "node", "grams").join(rest.select("label").distinct(), "label", "left_semi")
    grams = grams.dropDuplicates(["label", "node"])
    signs = materialise(_signs(grams, how), "jaccard-signs")
    pairs, many = candidates_of_parts(signs, rest, how)
    sets_of = grams.select("node", "grams")
    for k in "ab":
        pairs = pairs.join(sets_of.select(F.col("node").alias(k), F.col("grams").alias(f"grams_{k}")), k)
    found = materialise(_linked(pairs, how), "jaccard-rest-links")
    if not many.limit(1).count():
        return found
    centres = materialise(many.groupBy("label", "key").agg(F.min("node").alias("a")), "jaccard-part-centres")
    finer = components(many.join(centres, ["label", "key"]).select("a", F.col("node").alias("b")), "jaccard-parts")
    finer = finer.join(rest.select("node", F.lit(True).alias("asked")), "node", "left")
    of = lambda rows, name: rows.groupBy("label").agg(F.ceil(F.count("*") / F.lit(how.block)).cast("int").alias(name))
    counts = materialise(of(finer, "n").join(of(finer.where("asked"), "m"), "label"), "jaccard-part-sizes")
    every = sets_of.join(finer, "node").join(counts, "label")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["label", "i", "j", "node", "grams"]
    some = every.where("asked").withColumn("i", place("m")).withColumn("j", each("n")).select(*columns)
    whole = every.withColumn("j", place("n")).withColumn("i", each("m")).select(*columns)
    return found.unionByName(materialise(_trees(some.unionByName(whole), how), "jaccard-part-links"))


def near_components(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kid, kh, n_shingles, component, label) for every document; label: of the component, null
    without n-grams.

    The component is the smallest id reachable by links. A null text or one without words has no n-gram,
    links with nothing and is its own component. A null id is the smallest of all and comes back as null.
    Rows that repeat an id with other texts are documents of their own.
    """
    rows = keyed(docs, id_col, text_col)
    whole = materialise(_described(rows, how), "jaccard-sets")
    nodes = whole.where("n > 0").groupBy("h1", "h2").agg(F.min("kid").alias("kid"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    # The n-grams are most of either table, and are deleted after their last use.
    said = materialise(whole.drop("prefix"), "jaccard-rows")
    discard(whole)
    edges, wide, held = _candidates(nodes, how)
    whole, nodes = nodes, materialise(nodes.withColumn("p", F.size("prefix")).drop("prefix"), "jaccard-named")
    discard(whole)
    clusters = components(edges, "jaccard-clusters")
    grams = _grams(rows, nodes, wide, clusters, how)
    discard(*held, clusters)
    links = _links(grams, how)
    labels = components(links, "jaccard-components")
    discard(grams)
    named = nodes.select("h1", "h2", "node", "kid").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("kid").alias("component"))
    named = named.join(least, "label").select("h1", "h2", "component", "label")
    out = said.select("doc_id", "kid", "kh", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.nullif(F.col("component"), F.lit(NULL_ID))).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "kid", "kh", F.col("n").cast("long").alias("n_shingles"), component.alias("component"), "label")
    out = materialise(out, "jaccard-found")
    discard(said, nodes, labels)
    return out


def one_of_each(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The rows and columns of ``docs`` with one document of each component, that of the smallest id;
    documents without words stay. Rows equal in id and text count once: of those that differ in other columns the one
    with the least hash of its JSON stays, so that reruns agree.
    """
    found = near_components(docs, how)
    each = found.groupBy("kid", "kh").agg(F.max("label").alias("label"), F.count("*").alias("times"))
    first = each.where("label is not null").groupBy("label").agg(F.min(F.struct("kid", "kh", "times")).alias("first")).select("first.*")
    kept = first.unionByName(each.where("label is null").drop("label"))
    kept = materialise(kept.select(F.col("kid").alias("kept_kid"), F.col("kh").alias("kept_kh"), "times"), "jaccard-kept")
    discard(found)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("kid"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("kh")]
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key)
    same = (F.col("kid") == F.col("kept_kid")) & (F.col("kh") == F.col("kept_kh"))
    # Whole rows are shuffled once, to their keys; which of repeated ones stays is settled by hashes before.
    out = rows.join(kept.where("times = 1"), same, "left_semi").select("row.*")
    many = kept.where("times > 1")
    if not many.limit(1).count():
        return out
    turn = F.xxhash64(F.to_json("row"))
    least = rows.select("kid", "kh", turn.alias("turn")).join(many, same, "left_semi").groupBy("kid", "kh").agg(F.min("turn").alias("least"))
    least = materialise(least.withColumnsRenamed({"kid": "kept_kid", "kh": "kept_kh"}), "jaccard-turns")
    # None is below the least: an inequality, so that both joins read the same shuffle of the rows.
    repeated = rows.join(least, same).where(turn <= F.col("least")).dropDuplicates(["kid", "kh"])
    return out.unionByName(repeated.select("row.*"))


def jaccard_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    return near_components(docs).select("doc_id", "n_shingles", F.col("component").alias("component_id"))


__all__ = ["Join", "Tree", "forest", "jaccard_digest", "near_components", "one_of_each", "sets"]
