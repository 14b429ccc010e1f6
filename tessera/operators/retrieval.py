"""Multi-vector retrieval: candidates, two ranking phases, reranking, similarity maps.

A page has patches, a query has tokens. Both have float vectors and bit-packed signs. Queries are
small (the packed side is cut at ``max_query_tokens``, more than ``most_query_tokens`` are an error), so they go to every task; pages are
aggregated where they are read: max over a page's patches, sum over tokens, a row a page and token in
the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Settings
from tessera.functions import strings, vectors


def whole_query(tokens: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The float side of a query, which no cut applies to: broadcast, and an error beyond ``most_query_tokens``."""
    most = settings.most_query_tokens
    n = F.count("*").over(W.partitionBy(F.lit(1)))  # over most + 1 rows at most
    few = tokens.limit(most + 1).withColumn("query_size", n)
    wrong = F.when(F.col("query_size") > most, F.raise_error(F.lit(f"A query of more than {most} tokens")).cast("boolean"))
    return F.broadcast(few.where(F.coalesce(wrong, F.lit(True))).drop("query_size"))


def query_tokens(tokens: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The packed side of a query: its first ``max_query_tokens`` tokens, broadcast, as that bounds it."""
    return F.broadcast(tokens.orderBy("tok").limit(settings.max_query_tokens))


def maxsim(patches: DataFrame, tokens: DataFrame, similarity: Column, key: str = "page") -> DataFrame:
    """(page, score): sum over tokens of the greatest similarity to a patch."""
    best = patches.join(whole_query(tokens)).groupBy(key, "tok").agg(F.max(similarity).alias("best"))
    return best.groupBy(key).agg(F.sum("best").alias("score"))


def float_similarity() -> Column:
    return vectors.dot(F.col("q_vec"), F.col("vec"))


def bit_distance(dims: int) -> Column:
    """The Hamming distance of the packed signs."""
    return vectors.hamming_longs(F.col("q_bin"), F.col("bin"), -(-dims // 64))


def bit_similarity(dims: int) -> Column:
    """One over one plus the distance of the packed signs."""
    return vectors.inverse_distance(bit_distance(dims))


def sign_similarity(pm1: bool) -> Column:
    """The dot product of the query's floats and the patch's signs as 0/1, or as -1/+1."""
    signs = F.transform("vec", lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(-1.0 if pm1 else 0.0)))
    return vectors.dot(F.col("q_vec"), signs)


def top(scores: DataFrame, k: int, key: str = "page", by: str = "score") -> DataFrame:
    return scores.orderBy(F.col(by).desc(), key).limit(k)


def ann_candidates(patches: DataFrame, tokens: DataFrame, per_token: int, dims: int, key: str = "page") -> DataFrame:
    """(page): for each token the nearest pages by the Hamming distance of their nearest patch, united.

    The search is exact. Its window keeps ``per_token`` rows of each token on every task before the shuffle.
    """
    distance = patches.join(query_tokens(tokens)).groupBy(key, "tok").agg(F.min(bit_distance(dims)).alias("distance"))
    rank = F.row_number().over(W.partitionBy("tok").orderBy("distance", key))
    return distance.withColumn("r", rank).where(F.col("r") <= per_token).select(key).distinct()


def two_phase(patches: DataFrame, tokens: DataFrame, first: int, k: int, dims: int, key: str = "page") -> DataFrame:
    """Pages ranked by packed signs alone, the first of them again by floats against signs.

    The second phase reads the vectors of the ``first`` pages alone; their ids are broadcast, being that many.
    """
    head = top(maxsim(patches, tokens, bit_similarity(dims), key), first, key).select(key)
    again = patches.join(F.broadcast(head), key, "left_semi")
    return top(maxsim(again, tokens, sign_similarity(pm1=False), key), k, key)


def rerank(hits: DataFrame, floats: DataFrame, signs: DataFrame, keep: int, key: str = "page") -> DataFrame:
    """(page, relevance, rerank_score): by float MaxSim; without floats by signs as -1/+1; without either
    the relevance stays. Equal scores keep their order."""
    place = F.row_number().over(W.orderBy(F.col("relevance").desc(), key))
    scored = hits.withColumn("place", place).join(floats.withColumnRenamed("score", "float_score"), key, "left").join(signs.withColumnRenamed("score", "sign_score"), key, "left")
    scored = scored.withColumn("rerank_score", F.coalesce("float_score", "sign_score", "relevance"))
    return scored.orderBy(F.col("rerank_score").desc(), "place").limit(keep).select(key, "relevance", "rerank_score")


def similarity_cube(patches: DataFrame, tokens: DataFrame, key: str = "page") -> DataFrame:
    """(page, tok, patch, quantised): every cell scaled by the page's least and greatest to 0..254."""
    cells = patches.join(whole_query(tokens)).select(key, "tok", "patch", sign_similarity(pm1=False).alias("s"))
    page = W.partitionBy(key)
    low, high = F.min("s").over(page), F.max("s").over(page)
    quantised = F.floor((F.col("s") - low) / (high - low + 0.001) * 254).cast("long")
    return cells.select(key, "tok", "patch", quantised.alias("quantised"))


def similarity_grid(cells: DataFrame, value: str, side: int = DEFAULT.grid_side, patches: int = DEFAULT.patch_count, key: str = "page") -> DataFrame:
    """(page, tok, row, col, value): cells on the grid of the image, scaled within page and token; patches beyond
    the image are dropped."""
    one = W.partitionBy(key, "tok")
    low, high = F.min(value).over(one), F.max(value).over(one)
    scaled = (F.col(value) - low) / (high - low + 1e-6)
    on = cells.where(F.col("patch") < patches)
    return on.select(key, "tok", F.expr(f"patch div {side}").alias("row"), (F.col("patch") % side).cast("long").alias("col"), scaled.alias("value"))


def relative(scores: DataFrame, by: str = "score") -> DataFrame:
    """Scores over the greatest one, 1 at most, 0 if none is above 0. The greatest is a broadcast scalar."""
    most = F.broadcast(scores.agg(F.max(by).alias("most")))
    return scores.join(most).withColumn("relative", F.when(F.col("most") > 0, F.least(F.col(by) / F.col("most"), F.lit(1.0))).otherwise(F.lit(0.0))).drop("most")


def profile_name(ranking: str, with_maps: bool) -> str:
    return ranking + ("_sim" if with_maps else "")


def parse_profile(profile: str) -> tuple[str, bool]:
    """The base ranking of a profile and whether it emits similarity maps."""
    head, _, tail = profile.partition("_")
    return head, tail == "sim"


def search(query: str, profile: str, runs: dict[str, Callable[[str], DataFrame]], hits: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Dispatch a query to the run of its profile, after the stop words have gone from its text.

    ``runs`` gives for each base ranking a function from text to (page, score). An unknown profile is an
    error; no hits give an empty result.
    """
    base, _ = parse_profile(profile)
    if base not in runs:
        raise ValueError(f"Unknown ranking profile: {profile}")
    words = [w for w in query.split() if w.lower() not in strings.STOP_WORDS]
    return top(runs[base](" ".join(words) if words else query), hits or settings.default_hits)


def suggestions(questions: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """(question): distinct questions that contain the text, blind to case; the text is taken literally."""
    asked = text.strip().lower()
    found = questions.select(F.explode("questions").alias("question"))
    found = found.where(F.contains(F.lower("question"), F.lit(asked)) & (F.col("question") != "string")).distinct().orderBy("question")
    return found if limit is None else found.limit(limit)


def llm_rerank(hits: DataFrame, scores: DataFrame, k: int | None = None) -> DataFrame:
    """Hits (pos, ...) by scores (pos, llm_score) of a language model, missing ones 0, then by position. Without
    any score the order stays."""
    out = hits.join(scores, "pos", "left").withColumn("llm_score", F.coalesce("llm_score", F.lit(0.0)))
    out = out.orderBy(F.col("llm_score").desc(), "pos")
    return out if k is None else out.limit(k)


def context(hits: DataFrame, most: int = 5, chars: int = DEFAULT.context_chars) -> DataFrame:
    """(context): the first hits (rank, title, page_number, text) as one text for answer synthesis."""
    head = hits.orderBy("rank").limit(most)
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("title"), F.lit(", page "), F.col("page_number"), F.lit(": "), F.substring("text", 1, chars))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return head.agg(F.concat_ws("\n", F.transform(lines, lambda x: x["line"])).alias("context"))


class ResultCache:
    """The last results by query id, the oldest out first; ids don't depend on the process."""

    def __init__(self, size: int = 20) -> None:
        self.size, self.held = size, {}

    @staticmethod
    def query_id(query: str, ranking: str) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(f"{query}\0{ranking}")

    def get(self, key: int):
        if key in self.held:
            self.held[key] = self.held.pop(key)
        return self.held.get(key)

    def put(self, key: int, value) -> None:
        self.held.pop(key, None)
        self.held[key] = value
        while len(self.held) > self.size:
            del self.held[next(iter(self.held))]

    def drop(self, key: int) -> None:
        self.held.pop(key, None)
