"""Ranked lexical search with per-term geometric blocking, exact.

A document is a sparse vector: the coordinate of a term is its weight in the corpus times its saturated count. A query is
a set of terms and a score the sum of their coordinates, in integers. Each term's posting list is clustered by document
similarity; a block holds its posting list's documents of one cluster and keeps a summary, the coordinatewise maximum of
their vectors. A query enters through the lists of some of its terms, and a block is skipped only if its summary's sum
over the query's terms, which no document of it can exceed, is below a score that 50 documents are known to reach.

How it is spread: one pass over the texts writes the *forward* table, each document's terms that any query asks for. The
counts that weights need are reduced from it. A second pass scores the documents that hold a query's rarest
terms, whose 50th best score is the query's first threshold. Documents are then assigned to the nearest of a bounded sample
of documents and dealt, cluster by cluster, into groups of about ``Search.group``; a row of the *index* is a
group: its vectors once, and the block of each term in it. Searching is one map over the index, followed by a rank of each task's
best. A cluster of any size, a third of all rows too, is dealt into as many groups as it needs.

Queries come in batches of about ``Search.batch_bytes`` of text, and only what a batch asks for is sent to tasks. Which terms can be
entered through follows from the thresholds: terms whose greatest coordinates add up to less than the threshold can't
alone lift a document to it, so their lists have no blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import lexer
from tessera.llm.common import discard, lists, map_arrow, materialise, text_or_empty, utf8
from tessera.runtime import ship

#: Between terms: every ASCII character but digits and letters.
_GAP = np.zeros(256, bool)
_GAP[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _GAP[_a:_b] = False
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_SIDES = 512  # dimensions of the sketches that documents are compared by


@dataclass(frozen=True)
class Search:
    """``depth``: documents of a query's result. ``group``: documents of an index row, about. ``clusters``: sampled documents that
    others are assigned to. ``batch_bytes``: text of the queries of one batch, about. ``seeds``: postings that a first threshold is taken from,
    at least, where there are as many. ``wide``: terms of a query from which summaries keep all coordinates."""

    depth: int = 50
    group: int = 128
    clusters: int = 256
    batch_bytes: int = 1 << 20
    seeds: int = 400
    wide: int = 4096


def terms_of(text: str | None) -> set[str]:
    return set(_TERM.findall((text or "").translate(_LOWER)))


class Batch:
    """Queries of one batch: term hashes in order, and each query's terms as their places."""

    def __init__(self, texts: list[str | None]) -> None:
        sets = [terms_of(t) for t in texts]
        vocabulary = sorted(set().union(*sets))
        raw = [t.encode() for t in vocabulary]
        ends = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        # One word a text, so hashes come in the order of the vocabulary.
        hashes = lexer.words(data, ends, lower=True, space=_GAP)[0] if raw else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        place = {vocabulary[k]: i for i, k in enumerate(order)}
        self.queries = [np.array(sorted(place[t] for t in s), np.int64) for s in sets]
        self.size = len(vocabulary)


def forward_rows(docs: DataFrame, batch: Batch) -> DataFrame:
    """(doc_id, n, terms, counts): of each whole text with a term, all its terms' number, and the batch's terms in it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(batch.hashes)

    def each(rows: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        data, offsets = utf8(rows.column(1))
        h, _, _, counts = lexer.words(data, offsets, lower=True, space=_GAP)
        text = np.repeat(np.arange(rows.num_rows), counts)
        at = np.searchsorted(known, h) if len(known) else np.zeros(len(h), np.int64)
        found = at < len(known)
        found[found] = known[at[found]] == h[found]
        code, times = np.unique(text[found] * (len(known) + 1) + at[found], return_counts=True)
        per = np.bincount(code // (len(known) + 1), minlength=rows.num_rows)
        term = (code % (len(known) + 1)).astype(np.int32)
        arrays = [rows.column(0), pa.array(counts), lists(term, per, pa.int32()), lists(times.astype(np.int32), per, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return map_arrow(rows, each, "doc_id long, n long, terms array<int>, counts array<int>").where("n > 0")


def statistics(forward: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(N, L, df): documents with a term, their terms with repeats, and documents of each of the batch's terms."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, length = np.zeros(size, np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column(1).flatten().to_numpy(zero_copy_only=False), minlength=size)
            total += b.num_rows
            length += int(b.column(0).to_numpy(zero_copy_only=False).sum())
        live = np.flatnonzero(df)
        term = np.concatenate([[-2, -1], live])
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.concatenate([[total, length], df[live]]))], names=["term", "df"])

    ship(forward.sparkSession)
    got = forward.select("n", "terms").mapInArrow(each, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    found = dict(zip(got["term"], got["df"], strict=True))
    df = np.zeros(size, np.int64)
    for term, count in found.items():
        if term >= 0:
            df[term] = count
    return int(found.get(-2, 0)), int(found.get(-1, 0)), df


class Scores:
    """The corpus' weights of a batch's terms, and the vectors of documents."""

    def __init__(self, total: int, length: int, df: np.ndarray) -> None:
        self.total, self.length = total, length
        self.weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)

    def values(self, n: np.ndarray, per: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Coordinates of documents of n terms that hold ``per`` of the batch's terms each."""
        m = np.repeat(50 + (50 * n * self.total) // max(self.length, 1), per)
        count = count.astype(np.int64)
        return self.weight[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m))

    def of(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(per, term, value) of rows of the forward table."""
        n = rows.column("n").to_numpy(zero_copy_only=False)
        per = np.diff(rows.column("terms").offsets.to_numpy())
        term = rows.column("terms").flatten().to_numpy(zero_copy_only=False)
        return per, term, self.values(n, per, term, rows.column("counts").flatten().to_numpy(zero_copy_only=False))


class Local:
    """Documents' vectors as a dense matrix over the terms that they hold."""

    def __init__(self, per: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        self.terms, column = np.unique(term, return_inverse=True)
        self.rows = np.zeros((len(per), len(self.terms)), np.int64)
        self.rows[np.repeat(np.arange(len(per)), per), column] = value

    def columns(self, wanted: np.ndarray) -> np.ndarray:
        """Columns of those of the wanted terms, sorted, that are held."""
        if not len(self.terms):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return at[self.terms[at] == wanted]


def first_thresholds(forward: DataFrame, batch: Batch, scores: Scores, df: np.ndarray, how: Search) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds, greatest): a score that ``depth`` documents reach for each query, 1 where fewer are known, and each term's greatest coordinate.

    Seeds are documents with a query's rarest terms, as many terms as give ``seeds`` postings. Each task passes on its best scores only.
    """
    seeds = []
    for q in batch.queries:
        held = q[df[q] > 0]
        held = held[np.argsort(df[held], kind="stable")]
        enough = int(np.searchsorted(np.cumsum(df[held]), how.seeds)) + 1
        seeds.append(np.sort(held[:enough]))
    size, depth = batch.size, how.depth
    # The queries that each term is a seed of, one term after the other.
    seed_of, seed_term = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds]), np.concatenate([*seeds, np.empty(0, np.int64)])
    seed_of = seed_of[np.argsort(seed_term, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(seed_term, minlength=size))])
    shared = forward.sparkSession.sparkContext.broadcast((batch.queries, seed_of, first, scores))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, seed_of, first, scores = shared.value
        best: dict[int, np.ndarray] = {}
        greatest = np.zeros(size, np.int64)
        for rows in batches:
            per, term, value = scores.of(rows)
            np.maximum.at(greatest, term, value)
            local = Local(per, term, value)
            times = (first[1:] - first[:-1])[term]
            begin = np.repeat(first[term] - np.cumsum(times) + times, times)
            asking = seed_of[begin + np.arange(times.sum())]
            pairs = np.unique(asking * rows.num_rows + np.repeat(np.repeat(np.arange(rows.num_rows), per), times))
            cut = np.flatnonzero(np.diff(pairs // rows.num_rows, prepend=-1))
            for some in np.split(pairs, cut[1:]) if len(pairs) else ():
                q = int(some[0]) // rows.num_rows
                got = local.rows[np.ix_(some % rows.num_rows, local.columns(queries[q]))].sum(1)
                best[q] = np.sort(np.append(best.get(q, got[:0]), got))[-depth:]
        live = np.flatnonzero(greatest)
        kind = np.concatenate([np.repeat(0, sum(map(len, best.values()))), np.repeat(1, len(live))])
        key = np.concatenate([np.repeat(list(best), [len(v) for v in best.values()]) if best else live[:0], live])
        score = np.concatenate([*best.values(), greatest[live]])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (kind, key, score)], names=["kind", "key", "score"])

    ship(forward.sparkSession)
    reached = forward.select("n", "terms", "counts").mapInArrow(each, "kind long, key long, score long")
    reached = materialise(reached, "lexical-thresholds")
    at = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score")))
    top = reached.where("kind = 0").withColumn("at", at).where(F.col("at") == depth).toPandas()
    peaks = reached.where("kind = 1").groupBy("key").agg(F.max("score").alias("score")).toPandas()
    thresholds, greatest = np.ones(len(batch.queries), np.int64), np.zeros(size, np.int64)
    thresholds[top["key"].to_numpy(np.int64)] = np.maximum(top["score"].to_numpy(np.int64), 1)
    greatest[peaks["key"].to_numpy(np.int64)] = peaks["score"].to_numpy(np.int64)
    discard(reached)
    return thresholds, greatest


def entries(batch: Batch, thresholds: np.ndarray, greatest: np.ndarray) -> list[np.ndarray]:
    """The terms that each query enters through: all but those of the least peaks that together stay below its threshold."""
    out = []
    for q, threshold in zip(batch.queries, thresholds, strict=True):
        order = q[np.argsort(greatest[q], kind="stable")]
        order = order[greatest[order] > 0]
        rest = int(np.searchsorted(np.cumsum(greatest[order]), threshold))  # sums of these are below it
        out.append(np.sort(order[rest:]))
    return out


def asked_together(batch: Batch, entered: list[np.ndarray], wide: int) -> dict[int, np.ndarray | None]:
    """For each term that is entered through, the terms of its queries, sorted; None stands for all."""
    groups: dict[int, list] = {}
    for q, terms in zip(batch.queries, entered, strict=True):
        for t in terms.tolist():
            groups.setdefault(t, []).append(q if len(q) < wide else None)
    return {t: None if any(q is None for q in qs) else np.unique(np.concatenate(qs)) for t, qs in groups.items()}


def _sketch(per: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Unit vectors of _SIDES dimensions whose products tell similar documents."""
    side = lexer.mix(term.astype(np.uint64) + np.uint64(1))
    sign = np.where(side >> np.uint64(63), 1.0, -1.0)
    flat = np.repeat(np.arange(len(per)), per) * _SIDES + (side % np.uint64(_SIDES)).astype(np.int64)
    out = np.bincount(flat, sign * value, len(per) * _SIDES).reshape(len(per), _SIDES).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def clustered(forward: DataFrame, scores: Scores, how: Search) -> DataFrame:
    """The forward table with each document's cluster and group. Documents without a term of the batch have score 0 and are left out."""
    live = forward.where(F.size("terms") > 0)
    sample = live.orderBy(F.xxhash64("rid"), "rid").limit(how.clusters).select("n", "terms", "counts").toArrow()
    batches = sample.combine_chunks().to_batches()
    shared = forward.sparkSession.sparkContext.broadcast((_sketch(*scores.of(batches[0])) if batches else None, scores))

    def each(rows: pa.RecordBatch) -> pa.RecordBatch:
        middles, scores = shared.value
        near = (_sketch(*scores.of(rows)) @ middles.T).argmax(1).astype(np.int32)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(near)], names=[*rows.schema.names, "cluster"])

    plain = "rid long, doc_id long, n long, terms array<int>, counts array<int>, cluster int"
    near = materialise(map_arrow(live.select("rid", "doc_id", "n", "terms", "counts"), each, plain), "lexical-clusters")
    sizes = near.groupBy("cluster").agg(F.count("*").alias("size"))  # at most a row a sampled document
    deal = F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / how.group))
    return near.join(F.broadcast(sizes), "cluster").withColumn("deal", deal).drop("size")


INDEX = (
    "cluster int, deal long, rid array<long>, doc_id array<long>, per array<int>, term array<int>, value array<long>, "
    "block_term array<int>, block_docs array<int>, doc array<int>, block_sides array<int>, side array<int>, peak array<long>"
)


def build(grouped: DataFrame, scores: Scores, together: dict[int, np.ndarray | None], how: Search) -> DataFrame:
    """The index: a row a group, with its documents' vectors and a block for each term that is entered through.

    block_docs and block_sides are the lengths of the blocks' members (doc, places in the group) and summaries (side and peak: terms and
    their greatest coordinates).
    """
    shared = grouped.sparkSession.sparkContext.broadcast((scores, together))

    def one(rows: pa.Table) -> list:
        scores, together = shared.value
        rows = rows.combine_chunks().to_batches()[0]
        per, term, value = scores.of(rows)
        local = Local(per, term, value)
        block_term, members, sides, peaks = [], [], [], []
        for column, t in enumerate(local.terms.tolist()):
            if t not in together:
                continue
            docs = np.flatnonzero(local.rows[:, column])
            if not len(docs):
                continue  # its weight is 0
            keep = np.arange(len(local.terms)) if together[t] is None else local.columns(together[t])
            peak = local.rows[np.ix_(docs, keep)].max(0)
            block_term.append(t)
            members.append(docs)
            sides.append(local.terms[keep[peak > 0]])
            peaks.append(peak[peak > 0])
        flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return [
            rows.column("rid"), rows.column("doc_id"), per, term, value,
            block_term, list(map(len, members)), flat(members), list(map(len, sides)), flat(sides), flat(peaks),
        ]

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    names = [part.split()[0] for part in INDEX.split(", ")]

    def each(key: tuple, rows: pa.Table) -> pa.Table:
        columns = [pa.array([pa.array(c).cast(k)], pa.list_(k)) for c, k in zip(one(rows), kinds, strict=True)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *columns], names=names)

    return grouped.groupBy("cluster", "deal").applyInArrow(each, INDEX)


def search(index: DataFrame, batch: Batch, thresholds: np.ndarray, entered: list[np.ndarray], how: Search) -> DataFrame:
    """(query, rid, doc_id, score) of each task's best documents, and a row a task whose query is null with how many
    blocks it skipped (rid) of how many asked (doc_id)."""
    shared = index.sparkSession.sparkContext.broadcast((batch.queries, thresholds, entered))
    depth = how.depth

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floor, entered = shared.value
        floor = floor.copy()
        best: dict[int, tuple[np.ndarray, ...]] = {}
        by_term: dict[int, list[int]] = {}
        for q, terms in enumerate(entered):
            for t in terms.tolist():
                by_term.setdefault(t, []).append(q)
        skipped = asked = 0
        for rows in batches:
            for i in range(rows.num_rows):
                get = lambda name: rows.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                local = Local(get("per"), get("term"), get("value"))
                rid, ids = get("rid"), rows.column("doc_id")[i].values
                doc, side, peak = get("doc"), np.searchsorted(local.terms, get("side")), get("peak")
                holds: dict[int, np.ndarray] = {}
                docs_at = np.concatenate([[0], np.cumsum(get("block_docs"))])
                side_at = np.concatenate([[0], np.cumsum(get("block_sides"))])
                open_docs: dict[int, list[np.ndarray]] = {}
                for k, t in enumerate(get("block_term").tolist()):
                    sides, peaks = side[side_at[k] : side_at[k + 1]], peak[side_at[k] : side_at[k + 1]]
                    for q in by_term.get(t, ()):
                        asked += 1
                        if q not in holds:
                            holds[q] = np.isin(local.terms, queries[q], assume_unique=True)
                        if peaks[holds[q][sides]].sum() < floor[q]:
                            skipped += 1
                        else:
                            open_docs.setdefault(q, []).append(doc[docs_at[k] : docs_at[k + 1]])
                for q, parts in open_docs.items():
                    docs = np.unique(np.concatenate(parts))
                    score = local.rows[np.ix_(docs, local.columns(queries[q]))].sum(1)
                    good = score >= floor[q]
                    docs, score = docs[good], score[good]
                    id_of = ids.take(pa.array(docs))
                    smallest = id_of.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                    found = (score, smallest, rid[docs], id_of.is_null().to_numpy(zero_copy_only=False))
                    if q in best:
                        found = tuple(np.concatenate(x) for x in zip(best[q], found, strict=True))
                    order = np.lexsort((found[1], ~found[3], -found[0]))[:depth]
                    best[q] = tuple(x[order] for x in found)
                    if len(order) == depth:
                        floor[q] = max(floor[q], best[q][0][-1])
        for q, (score, smallest, rid, absent) in best.items():
            ids = pa.array(smallest, mask=absent)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rid), q)), pa.array(rid), ids, pa.array(score)], names=["query", "rid", "doc_id", "score"])
        counts = [pa.array([x], pa.int64()) for x in (None, skipped, asked, 0)]
        yield pa.RecordBatch.from_arrays(counts, names=["query", "rid", "doc_id", "score"])

    return index.mapInArrow(each, "query long, rid long, doc_id long, score long")


@dataclass
class Found:
    """Ranks of a batch, and the tables behind them."""

    ranks: DataFrame
    skipped: int
    asked: int


def search_batch(docs: DataFrame, items: list[tuple[int | None, str | None]], how: Search = Search()) -> Found:
    """item_id, rank, doc_id and score of the ``depth`` best documents of each of these (id, text); equal scores by ascending doc_id, a null one first."""
    spark = docs.sparkSession
    batch = Batch([text for _, text in items])
    forward = forward_rows(docs, batch).withColumn("rid", F.monotonically_increasing_id())
    forward = materialise(forward, "lexical-forward")  # row numbers aren't drawn again
    total, length, df = statistics(forward, batch.size)
    scores = Scores(total, length, df)
    thresholds, greatest = first_thresholds(forward, batch, scores, df, how)
    entered = entries(batch, thresholds, greatest)
    grouped = clustered(forward, scores, how)
    index = materialise(build(grouped, scores, asked_together(batch, entered, how.wide), how), "lexical-index")
    discard(forward)
    found = materialise(search(index, batch, thresholds, entered, how), "lexical-found")
    discard(index)
    counts = found.where("query IS NULL").agg(F.sum("rid"), F.sum("doc_id")).first()
    at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "rid"))
    best = found.where("query IS NOT NULL").withColumn("rank", at).where(F.col("rank") <= how.depth)
    ids = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], "query long, item_id long")
    ranks = best.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")
    return Found(ranks, int(counts[0] or 0), int(counts[1] or 0))


def ranked(docs: DataFrame, items: DataFrame, how: Search = Search(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ranks of every row of ``items``, batch by batch. A repeated row has its ranks again; one without terms has none."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-volume // how.batch_bytes))
    out = None
    for k in range(batches):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == k).orderBy("item_id", "text").collect()
        part = search_batch(docs, [tuple(r) for r in some], how).ranks if some or k == 0 else None
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out


RANKED_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
c AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(len(terms)) AS BIGINT) AS length FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
m AS (SELECT doc_id, 50 + (50 * len(terms) * total) // length AS m FROM d, c WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
