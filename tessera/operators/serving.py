"""What stands between requests and the engine: downloads, model registry, the agent's loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Settings


def download(files: DataFrame, fetch: Callable[[str], bytes], workers: int = 2, settings: Settings = DEFAULT) -> DataFrame:
    """Files (key, extension) with (status, size, error): fetched by ``workers`` tasks, each through its own
    ``fetch``. Unsupported types aren't fetched, those without an extension are; too large a file and an
    error are rows. Contents are dropped here: a sink that keeps them is a map over the same rows."""
    most = settings.max_download_mb * 1_000_000
    rows = files.select("key", "extension").repartition(workers)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, ext in zip(pdf["key"], pdf["extension"], strict=True):
                if ext is not None and ext not in settings.download_types:
                    out.append((key, "skipped", None, f"Unsupported type: {ext}"))
                    continue
                try:
                    size = len(fetch(key))
                    out.append((key, "downloaded" if size <= most else "skipped", size, None if size <= most else "Too large"))
                except Exception as e:  # the file's own fault; it becomes a row
                    out.append((key, "failed", None, str(e)))
            yield pd.DataFrame(out, columns=["key", "status", "size", "error"]).astype({"size": "Int64"})

    return rows.mapInPandas(each, "key string, status string, size long, error string")


@dataclass(frozen=True)
class Models:
    """Encoders by id, each with its dimensions and a function that makes it."""

    known: dict[str, tuple[int, Callable[[], Callable]]] = field(default_factory=dict)

    def make(self, name: str) -> Callable:
        if name not in self.known:
            raise ValueError(f"Unknown model: {name}; known: {', '.join(sorted(self.known))}")
        return self.known[name][1]()


def thumbnail(gray: np.ndarray, most: int = 100) -> np.ndarray:
    """The image shrunk to ``most`` pixels a side by averages of blocks."""
    step = max(1, -(-max(gray.shape) // most))
    h, w = (-(-n // step) for n in gray.shape)
    padded = np.pad(gray.astype(np.float64), ((0, h * step - gray.shape[0]), (0, w * step - gray.shape[1])), mode="edge")
    return padded.reshape(h, step, w, step).mean(axis=(1, 3)).round().astype(np.uint8)


def thumbnails(pages: DataFrame, most: int = 100) -> DataFrame:
    """(page_id, height, width, pixels) of (page_id, width, height, gray) pages, one in memory at a time."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                small = thumbnail(np.frombuffer(r.gray, np.uint8).reshape(r.height, r.width), most)
                row = {"page_id": r.page_id, "height": small.shape[0], "width": small.shape[1], "pixels": small.ravel().astype(int).tolist()}
                yield pd.DataFrame([row])

    return pages.select("page_id", "width", "height", "gray").mapInPandas(each, "page_id long, height long, width long, pixels array<int>")


@dataclass
class Agent:
    """A loop of at most ``steps`` tool calls: ``decide`` gets what was found so far and answers
    ("search", query), ("text", place) or ("answer", text). Documents are kept once, in the order found."""

    search: Callable[[str], list[tuple[int, str]]]
    decide: Callable[[list[dict]], tuple[str, str]]
    steps: int = 5
    preview: int = 200

    def run(self) -> dict:
        seen: dict[int, str] = {}
        log: list[dict] = []
        for _ in range(self.steps):
            tool, said = self.decide(log)
            if tool == "answer":
                return {"answer": said, "documents": list(seen)}
            if tool == "search":
                found = self.search(said)
                for doc, text in found:
                    seen.setdefault(doc, text)
                log.append({"tool": tool, "results": [(list(seen).index(d), t[: self.preview]) for d, t in found]})
            elif tool == "text" and said.isdigit() and int(said) < len(seen):
                log.append({"tool": tool, "results": list(seen.values())[int(said)]})
            else:
                log.append({"tool": tool, "error": f"No such tool or result: {said}"})
        return {"answer": None, "documents": list(seen)}


def scoped(docs: DataFrame, category: str | None = None, ids: list[int] | None = None, text: str | None = None) -> DataFrame:
    """Documents within the given category, ids and text; what isn't given doesn't filter."""
    if category is not None:
        docs = docs.where(F.col("category") == category)
    if ids is not None:
        docs = docs.where(F.col("doc_id").isin(ids))
    return docs if text is None else docs.where(F.contains(F.lower("text"), F.lit(text.lower())))
