"""Benchmark decontamination with SimHash of item-sized windows, in DataFrame operations alone.

Words are lower-cased runs of letters and digits. A window of a document for an item has as many words as the item, or
what of them the document has at its ends.

1. *Windows.* All windows of all documents for all sizes of items would be many times the corpus, so those are
   considered that hold enough shingles of the item, in whatever order, to reach the similarity: with c of its w shingles
   among the item's v, it is c / (w + v - c) at most. A document meets an item through the item's rarest
   shingles alone, so many that no window without one of them can reach the similarity; shingles that many items
   share multiply nothing. No other window can reach it.
2. *Index.* The 128-bit SimHash of a window's shingles, weighted by how often they occur, is looked up in an index of
   the items of the same size. The index splits fingerprints into blocks; of two fingerprints within the
   radius, some block differs in radius div blocks bits at most, so with every item in the index under every block
   value that near, no fingerprint within the radius is missed. Of unrelated pairs one in twelve meets.
3. *Verification.* The weighted Jaccard similarity of the shingles, sum of the lesser weights over sum of the greater,
   is computed exactly for every pair within the radius.

At a similarity of just 0.8 fingerprints differ in 19 bits on average, 4 being the standard deviation, so a radius of
31 misses such a window with odds of 1 in 600, and one of 0.85 with less than 1 in 100,000.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, discard, keyed, materialise

#: Bits of a fingerprint, in longs.
LONGS = 2


@dataclass(frozen=True)
class Leaks:
    """``words`` in a shingle; a shorter item is one shingle of all its words. ``broadcast_rows``: a larger
    table of item shingles is joined by a shuffle."""

    words: int = 5
    similarity: float = 0.8
    radius: int = 31
    blocks: int = 8
    broadcast_rows: int = 1_000_000

    @property
    def bits(self) -> int:
        return 64 * LONGS // self.blocks

    def near(self) -> list[int]:
        """Block values that differ from 0 in radius div blocks bits at most."""
        most = self.radius // self.blocks
        return sorted(sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(self.bits), k))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def _shingles(words: Column, size: Column, how: Leaks) -> Column:
    """The shingles of an array of ``size`` words as strings."""
    width = F.least(size, F.lit(how.words))
    at = F.when(size > 0, F.sequence(F.lit(1), size - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i, width)))


def _fingerprint(shingles: Column) -> Column:
    """The SimHash of strings, as an array of longs; a string that occurs twice weighs twice. A drawn vote goes
    by the greatest hash, as zeros for all would make unrelated fingerprints alike."""

    def long(k: int) -> Column:
        hashes = F.transform(shingles, lambda s: F.xxhash64(F.lit(k), s))

        def bit(acc: Column, b: Column) -> Column:
            votes = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
            one = (votes > 0) | (votes == 0) & (F.getbit(F.array_max(hashes), b) == 1)
            return acc.bitwiseOR(F.when(one, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)

    return F.array(*[long(k) for k in range(LONGS)])


def _block(fingerprint: Column, block: Column, how: Leaks) -> Column:
    """The value of a block; blocks don't cross longs."""
    each = how.blocks // LONGS
    long = F.get(fingerprint, (block / each).cast("int"))
    return F.call_function("shiftrightunsigned", long, (block % each) * how.bits).bitwiseAND(F.lit((1 << how.bits) - 1)).cast("int")


def _distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(1, LONGS)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _items(benchmark: DataFrame, how: Leaks) -> tuple[DataFrame, DataFrame]:
    """(item, size, shingles, fingerprint) of each distinct text with a word, and (item_id, item), the texts of each id."""
    said = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    said = said.where(F.size("words") > 0).distinct()
    items = said.select("words").distinct().select(F.monotonically_increasing_id().alias("item"), F.size("words").alias("size"), "words")
    items = items.withColumn("shingles", _shingles(F.col("words"), F.col("size"), how))
    items = materialise(items.withColumn("fingerprint", _fingerprint(F.col("shingles"))), "leaks-items")
    return items.drop("words"), said.join(items.select("item", "words"), "words").select("item_id", "item")


def _item_grams(items: DataFrame, how: Leaks) -> DataFrame:
    """(item, size, width, place, h, first): the hashed shingles of each item; first: among its rarest, so many that what
    is left doesn't reach the similarity."""
    width = F.least("size", F.lit(how.words))
    grams = items.select("item", "size", width.alias("width"), F.posexplode("shingles").alias("place", "shingle"))
    hashed = [(F.col("width") == k, F.xxhash64(*[F.get(F.split("shingle", " "), F.lit(j)) for j in range(k)])) for k in range(1, how.words + 1)]
    grams = grams.withColumn("h", F.coalesce(*[F.when(*x) for x in hashed])).drop("shingle")
    often = grams.groupBy("width", "h").agg(F.count("*").alias("often"))
    rank = F.row_number().over(W.partitionBy("item").orderBy("often", "h", "place"))
    most = F.col("size") - F.col("width") + 1
    first = rank <= most - F.ceil(how.similarity * most - 1e-9) + 1
    return grams.join(often, ["width", "h"]).withColumn("first", first).drop("often")


def _grams(docs: DataFrame, width: int) -> DataFrame:
    """(kid, kh, pos, n, h): the hashed shingles of ``width`` words of each document of n words. Words are hashed where
    they are exploded: no array is built for a position."""
    said = docs.select("kid", "kh", words_of(F.col("text")).alias("words"))
    grams = said.select("kid", "kh", "words", F.posexplode("words").alias("pos", "word")).where(F.col("pos") <= F.size("words") - width)
    h = F.xxhash64("word", *[F.get("words", F.col("pos") + k) for k in range(1, width)])
    return grams.select("kid", "kh", "pos", F.size("words").alias("n"), h.alias("h"))


def _small(df: DataFrame, how: Leaks) -> DataFrame:
    """``df``, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= how.broadcast_rows else df


def _windows(docs: DataFrame, items: DataFrame, how: Leaks) -> DataFrame | None:
    """(kid, kh, item, size, start, aligned, window): the windows with so many of the item's shingles, wherever
    these stand, that they can reach the similarity. aligned: one of them stands at its place in the item. None without
    items."""
    own = materialise(_item_grams(items, how), "leaks-grams")
    widths = [r[0] for r in own.select("width").distinct().collect()]  # 1 to how.words
    if not widths:
        discard(own)
        return None
    pairs = None
    for width in sorted(widths):
        first = own.where((F.col("width") == width) & F.col("first")).select("h", "item").distinct()
        some = _grams(docs, width).select("kid", "kh", "h").join(_small(first, how), "h").select("kid", "kh", "item")
        pairs = some if pairs is None else pairs.unionByName(some)
    pairs = materialise(pairs.distinct(), "leaks-pairs")
    met = None
    asked = docs.join(_small(pairs.select("kid", "kh").distinct(), how), ["kid", "kh"], "left_semi")
    for width in sorted(widths):
        mine = own.where(F.col("width") == width).select("item", "size", "place", "h")
        # Only shingles of some item are shuffled to the pairs they may count for.
        shared = _grams(asked, width).join(_small(mine.select("h").distinct(), how), "h", "left_semi")
        some = shared.join(pairs.join(mine, "item"), ["kid", "kh", "h"])
        some = some.select("kid", "kh", "item", "size", "pos", (F.col("pos") - F.col("place")).alias("start"), "n")
        met = some if met is None else met.unionByName(some)
    met = met.groupBy("kid", "kh", "item", "size").agg(F.array_sort(F.collect_set("pos")).alias("at"), F.collect_set("start").alias("starts"), F.max("n").alias("n"))
    # A window's first shared shingle is the i-th: it then begins after the one before, and early enough for the
    # shingles it needs at least.
    most = F.col("size") - F.least("size", F.lit(how.words)) + 1
    least = F.greatest(F.ceil(how.similarity * most - 1e-9).cast("int"), F.lit(1))
    met = met.withColumn("most", most).withColumn("least", least).where(F.size("at") >= F.col("least"))
    met = met.select("*", F.posexplode("at").alias("i", "first"))
    last = F.get("at", F.col("i") + F.col("least") - 1)
    low = F.greatest(last - F.col("most") + 1, F.get("at", F.col("i") - 1) + 1)
    met = met.withColumn("low", low).where(last.isNotNull() & (F.col("low") <= F.col("first")))
    met = met.select("*", F.explode(F.sequence("low", "first")).alias("start"))
    # No more shingles are common than stand in the window.
    shared = F.size(F.filter(F.slice("at", F.col("i") + 1, F.col("most")), lambda x: x < F.col("start") + F.col("most")))
    long = F.least(F.col("start") + F.col("size"), F.col("n")) - F.greatest("start", F.lit(0)) - (F.col("size") - F.col("most"))
    met = met.where(shared >= how.similarity * (long + F.col("most") - shared) - 1e-9)
    met = met.select("kid", "kh", "item", "size", "start", F.array_contains("starts", F.col("start")).alias("aligned"))
    met = materialise(met, "leaks-starts")
    held = docs.join(_small(met.select("kid", "kh").distinct(), how), ["kid", "kh"], "left_semi")
    said = held.dropDuplicates(["kid", "kh"]).select("kid", "kh", words_of(F.col("text")).alias("words"))
    start = F.col("start")
    window = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size") + F.least(start, F.lit(0)))
    out = met.join(said, ["kid", "kh"]).select("kid", "kh", "item", "size", "start", "aligned", F.concat_ws(" ", window).alias("window"))
    out = materialise(out, "leaks-windows")
    discard(own, pairs, met)
    return out


def index_pairs(texts: DataFrame, items: DataFrame, how: Leaks) -> DataFrame:
    """(no, wide, fingerprint, size, item, of_item): every meeting of a window's text (no, size, wide shingles) and an
    item of its size in some block of the index. A pair meets once for each such block."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(how.blocks - 1)))
    near = F.explode(F.array(*[F.lit(v) for v in how.near()]))
    index = items.select("item", "size", F.col("fingerprint").alias("of_item")).withColumn("block", blocks)
    value = _block(F.col("of_item"), F.col("block"), how).bitwiseXOR(F.col("away"))
    index = index.withColumn("away", near).select("item", "size", "of_item", "block", value.alias("value"))
    asked = texts.select("no", "size", F.size("shingles").alias("wide"), "fingerprint").withColumn("block", blocks)
    asked = asked.withColumn("value", _block(F.col("fingerprint"), F.col("block"), how))
    # The index has thousands of rows an item, which no estimate from the items' table tells: it is never broadcast.
    return asked.join(index.hint("merge"), ["size", "block", "value"]).drop("block", "value")


def leaks(docs: DataFrame, benchmark: DataFrame, how: Leaks = Leaks(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kh, item_id, start, similarity): each document and item with a window that reaches the
    similarity; its best, of equals one with a shingle at its place in the item, then the first. start: the
    window's first word, below 0 if the document begins inside the item.

    Null and empty texts and items have no words and match nothing. Rows equal in id and text give one
    row. Items with equal words are found each under its own id; a null item id is an id. Of an id with
    several texts the best window of any of them counts.
    """
    items, names = _items(benchmark, how)
    windows = _windows(keyed(docs, id_col, text_col), items, how)
    if windows is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, kh long, item_id long, start int, similarity double")
    words = F.split("window", " ")
    # Copies share their windows' texts, which are worked on once and go by number.
    texts = windows.select("window", "size").distinct().withColumn("shingles", _shingles(words, F.size(words), how))
    texts = materialise(texts.withColumn("fingerprint", _fingerprint(F.col("shingles"))).withColumn("no", F.monotonically_increasing_id()), "leaks-texts")
    met = items.join(windows.select("item").distinct(), "item", "left_semi")
    pairs = index_pairs(texts, met, how).where(_distance(F.col("fingerprint"), F.col("of_item")) <= how.radius)
    pairs = pairs.select("no", "wide", "size", "item").distinct()
    mine = texts.select("no", F.explode("shingles").alias("shingle")).groupBy("no", "shingle").agg(F.count("*").alias("w"))
    theirs = items.select("item", F.explode("shingles").alias("shingle")).groupBy("item", "shingle").agg(F.count("*").alias("v"))
    both = pairs.join(mine, "no").join(theirs, ["item", "shingle"])
    both = both.groupBy("no", "wide", "size", "item").agg(F.sum(F.least("w", "v")).alias("lesser"))
    total = F.col("wide") + F.col("size") - F.least("size", F.lit(how.words)) + 1 - F.col("lesser")
    scored = both.withColumn("similarity", F.col("lesser") / total).where(F.col("similarity") >= how.similarity)
    scored = scored.select("no", "item", "similarity").join(texts.select("no", "window", "size"), "no")
    hits = windows.join(scored, ["window", "size", "item"]).join(names, "item")
    best = F.max_by("start", F.struct("similarity", "aligned", -F.col("start")))
    hits = hits.groupBy("kid", "kh", "item_id").agg(best.alias("start"), F.max("similarity").alias("similarity"))
    hits = materialise(hits.select(F.nullif("kid", F.lit(NULL_ID)).alias("doc_id"), "kh", "item_id", "start", "similarity"), "leaks-found")
    discard(windows, texts)
    return hits


def without_leaks(docs: DataFrame, benchmark: DataFrame, how: Leaks = Leaks()) -> DataFrame:
    """The rows and columns of ``docs`` but for documents with a window similar to an item."""
    found = leaks(docs, benchmark, how).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("bad_kid"), F.col("kh").alias("bad_kh")).distinct()
    kid = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("kid")
    kh = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("kh")
    rows = docs.select(F.struct(*docs.columns).alias("row"), kid, kh)
    return rows.join(found, (F.col("kid") == F.col("bad_kid")) & (F.col("kh") == F.col("bad_kh")), "left_anti").select("row.*")


def leaks_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of the query: a row for each document and item with a window that reaches the similarity."""
    return leaks(docs, benchmark).select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.round("similarity", 6).alias("similarity"))


#: The same by direct comparison, without fingerprints.
LEAKS_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT item_id, words, len(words) AS size, least(len(words), 5) AS width FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM benchmark) WHERE len(words) > 0),
ig AS (SELECT item_id, size, width, k AS place, array_to_string(words[k + 1 : k + width], ' ') AS shingle FROM (SELECT *, unnest(range(size - width + 1)) AS k FROM i)),
w AS (SELECT DISTINCT width FROM i),
dg AS (SELECT doc_id, words, width, k AS pos, array_to_string(words[k + 1 : k + width], ' ') AS shingle FROM (
    SELECT d.doc_id, d.words, w.width, unnest(range(len(d.words) - w.width + 1)) AS k FROM d, w WHERE len(d.words) >= w.width)),
win AS (SELECT DISTINCT dg.doc_id, ig.item_id, ig.size, dg.pos - ig.place AS start, dg.words[greatest(dg.pos - ig.place, 0) + 1 : dg.pos - ig.place + ig.size] AS words
    FROM dg JOIN ig ON dg.width = ig.width AND dg.shingle = ig.shingle),
wg AS (SELECT doc_id, item_id, start, array_to_string(words[k + 1 : k + least(len(words), 5)], ' ') AS shingle FROM (SELECT *, unnest(range(len(words) - least(len(words), 5) + 1)) AS k FROM win)),
wc AS (SELECT doc_id, item_id, start, shingle, count(*) AS c FROM wg GROUP BY ALL),
ic AS (SELECT item_id, shingle, count(*) AS c FROM ig GROUP BY ALL),
s AS (SELECT wc.doc_id, wc.item_id, wc.start, sum(least(wc.c, ic.c)) AS lesser FROM wc JOIN ic ON wc.item_id = ic.item_id AND wc.shingle = ic.shingle GROUP BY ALL),
j AS (SELECT s.doc_id, s.item_id, s.start, s.lesser / (len(win.words) - least(len(win.words), 5) + 1 + i.size - i.width + 1 - s.lesser) AS similarity
    FROM s JOIN win ON s.doc_id = win.doc_id AND s.item_id = win.item_id AND s.start = win.start JOIN i ON s.item_id = i.item_id)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, round(CAST(similarity AS DOUBLE), 6) AS similarity FROM j WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
