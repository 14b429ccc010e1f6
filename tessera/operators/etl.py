"""Files to pages: dispatch by type, page rows, embeddings behind an interface, packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Settings
from tessera.functions import strings

#: Rendered bytes after which a task hands its pages on.
FRAME_BYTES = 16 << 20
#: Rows of a frame of vectors.
EMBED_ROWS = 256


def files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(path, content, length) of the files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def dispatch(named: DataFrame, name: str = "filename", settings: Settings = DEFAULT) -> DataFrame:
    """Files with how they are processed: pdf, image, or unsupported with an error."""
    ext = strings.extension(F.col(name))
    how = F.when(ext == "pdf", "pdf").when(ext.isin(*settings.processable_types), "image").otherwise("unsupported")
    return named.withColumn("processor", how).withColumn("error", F.when(how == "unsupported", F.concat(F.lit("Unsupported file type: "), F.coalesce(ext, F.lit("none")))))


def pages(docs: DataFrame, render: Callable[[bytes], list[tuple[bytes, str]]], name: str = "filename") -> DataFrame:
    """(filename, page_number, image, text, error): each page of each file as ``render`` makes it. A
    file that can't be read is one row with the error; the others go on."""

    names = ["filename", "page_number", "image", "text", "error"]
    schema = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()), strict=True)))

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    made = [(file, i, image, text, None) for i, (image, text) in enumerate(render(content.as_py()), 1)]
                except Exception as e:  # the file's own fault; it becomes a row
                    made = [(file, None, None, None, str(e))]
                rows += made
                size += sum(len(image or b"") + len(text or "") for _, _, image, text, _ in made)
                if size > FRAME_BYTES:  # many small files make one frame, a large one its own
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)
                rows, size = [], 0

    return docs.select(F.col(name).alias("filename"), "content").mapInArrow(each, "filename string, page_number long, image binary, text string, error string")


def page_documents(rendered: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rendered pages as documents: ids of the file's name and bytes, clean text, snippets, titles."""
    text = strings.sanitize(F.coalesce("text", F.lit("")))
    ident = strings.page_doc_id(F.col("filename"), F.col("image"), F.col("page_number"))
    return rendered.where("error is null").select(ident.alias("id"), strings.stem(F.col("filename")).alias("title"), "page_number", text.alias("text"), strings.snippet(text, F.col("page_number"), F.col("filename"), chars=settings.snippet_chars).alias("snippet"))


def embed(rows: DataFrame, model: Callable[[list[str]], np.ndarray], column: str = "text", batch: int = 8) -> DataFrame:
    """Rows with ``vectors`` (patches of floats) and ``packed`` (their signs); the model sees ``batch`` texts at once
    and is made once for each batch stream. Frames of ``EMBED_ROWS`` rows are handed on, however many come at once."""
    schema = rows.schema.simpleString()[len("struct<") : -1] + ",vectors:array<array<float>>,packed:array<array<int>>"

    def nested(parts: list[list[np.ndarray]], kind: pa.DataType) -> pa.Array:
        """Lists of lists from arrays laid end to end."""
        each = [p for part in parts for p in part]
        ends = np.cumsum([0, *map(len, each)]), np.cumsum([0, *map(len, parts)])
        flat = np.concatenate(each) if each else np.empty(0)
        inner = pa.ListArray.from_arrays(pa.array(ends[0], pa.int32()), pa.array(flat, kind))
        return pa.ListArray.from_arrays(pa.array(ends[1], pa.int32()), inner)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), EMBED_ROWS):
                frame = whole.slice(start, EMBED_ROWS)
                texts = [t or "" for t in frame.column(column).to_pylist()]
                out = [list(v) for a in range(0, len(texts), batch) for v in model(texts[a : a + batch])]
                vectors = nested([[p.astype(np.float32) for p in v] for v in out], pa.float32())
                packed = nested([[np.packbits(p > 0).view(np.int8).astype(np.int32) for p in v] for v in out], pa.int32())
                yield pa.RecordBatch.from_arrays([*frame.columns, vectors, packed], [*frame.schema.names, "vectors", "packed"])

    return rows.mapInArrow(each, schema.replace(":", " "))


def hashed_model(dims: int = 128, patches: int = 4) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for an encoder: vectors that depend on the text alone."""

    def model(texts: list[str]) -> np.ndarray:
        import zlib

        return np.stack([np.random.default_rng(zlib.crc32(t.encode())).standard_normal((patches, dims)) for t in texts])

    return model


def labelled(regions: DataFrame, model: Callable[[list[str]], list[str]], column: str = "text", batch: int = 8) -> DataFrame:
    """Rows (page_id, region, ...) with ``label`` and ``by_model``: what the model calls each, ``batch`` at once. A batch
    that fails is asked one by one; what fails then is called by its number."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in regions.schema.fields)

    def asked(texts: list[str]) -> list[str | None]:
        try:
            return list(model(texts))
        except Exception:  # the model's fault; its answers are optional
            return [None] if len(texts) == 1 else [x for t in texts for x in asked([t])]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[column].fillna("").tolist()
            said = [x for a in range(0, len(texts), batch) for x in asked(texts[a : a + batch])]
            names = [x if x is not None else f"region_{n}" for x, n in zip(said, pdf["region"].tolist(), strict=True)]
            yield pdf.assign(label=names, by_model=[x is not None for x in said])

    return regions.mapInPandas(each, f"{schema}, label string, by_model boolean")
