"""Regions of pages from their vector paths, as one plan over rows of paths.

Every rule is a filter, a join by page or a fold over the few frames of a page; only the union of neighbouring boxes to a fixpoint runs
page by page. Tables of rows:

* pages (page_id, width, height in pixels, width_pt, height_pt, n_images);
* paths (page_id, path, x0, y0, x1, y1 in points, rects: how many, segments: arrays of x1, y1, x2, y2), ``path`` their order;
* texts (page_id, text, x0, y0, x1, y1), ``text`` their order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Settings
from tessera.operators import regions as r

BOX = ("x0", "y0", "x1", "y1")
#: Texts stand behind all paths of their page when boxes are merged.
_BEHIND = 1 << 40


def _close(a: Column, b: Column, near: float) -> Column:
    out = F.lit(True)
    for c in BOX:
        out = out & (F.abs(a[c] - b[c]) < near)
    return out


def _area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def _holds(outer: Column, b: Column) -> Column:
    near = r.INSIDE_NEAR
    return (b["x0"] >= outer["x0"] - near) & (b["y0"] >= outer["y0"] - near) & (b["x1"] <= outer["x1"] + near) & (b["y1"] <= outer["y1"] + near)


def without_borders(paths: DataFrame) -> DataFrame:
    """Paths but for those that lie where a border of their page does: a path of several lines that spans the page."""
    bordering = r.spans_page(*[F.col(c) for c in BOX], F.col("width_pt"), F.col("height_pt")) & (F.col("rects") + F.size("segments") >= 3)
    borders = paths.where(bordering).select(F.col("page_id").alias("b_page"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    same = F.col("page_id") == F.col("b_page")
    for c in BOX:
        same = same & (F.abs(F.col(c) - F.col(f"b_{c}")) < r.BORDER_NEAR)
    return paths.join(borders, same, "left_anti")


def frames(inner: DataFrame) -> DataFrame:
    """(page_id, seq, box) of paths that frame a part of their page, the largest first: of nearly equal ones the first, and none that
    another holds with room to spare. A frame takes a fiftieth of the page at least, so a page's are one array."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    whole = r.spans_page(*[F.col(c) for c in BOX], F.col("width_pt"), F.col("height_pt"))
    lined = (F.col("rects") > 0) | (F.size("segments") >= 3)
    some = inner.where((wide * high >= F.col("width_pt") * F.col("height_pt") * r.FRAME_AREA) & ~whole & lined)
    one = F.struct("path", *BOX)
    held = some.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    first = F.aggregate("all", none, lambda kept, b: F.when(F.exists(kept, lambda k: _close(k, b, r.TABLE_NEAR)), kept).otherwise(F.concat(kept, F.array(b))))
    sized = F.array_sort(F.transform(first, lambda b: F.struct((-_area(b)).alias("order"), b["path"].alias("path"), *[b[c].alias(c) for c in BOX])))
    held = held.select("page_id", sized.alias("sized"))
    inside = lambda b: F.exists("sized", lambda o: (o["path"] != b["path"]) & _holds(o, b) & (_area(b) < _area(o) * r.INSIDE_RATIO))
    held = held.select("page_id", F.posexplode(F.filter("sized", lambda b: ~inside(b))).alias("seq", "b"))
    return held.select("page_id", "seq", *[F.col("b")[c].alias(c) for c in BOX])


def merged(boxes: DataFrame) -> DataFrame:
    """(page_id, seq, box): the boxes of each page (with its ``gap``) united while two are within it, in their order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = r.merge_boxes(pdf.sort_values("box")[list(BOX)].to_numpy(), pdf["gap"].iloc[0])
        return pd.DataFrame({"page_id": pdf["page_id"].iloc[0], "seq": range(len(got)), **{c: got[:, k] for k, c in enumerate(BOX)}})

    return boxes.groupBy("page_id").applyInPandas(one, "page_id long, seq int, x0 double, y0 double, x1 double, y1 double")


def _in_pixels(boxes: DataFrame) -> DataFrame:
    """Boxes with their place in pixels, cut off as whole numbers and held within the page; sizes are those before."""
    at = lambda c: (c * F.col("scale")).cast("long")
    boxes = boxes.withColumns({"x": at(F.col("x0")), "y": at(F.col("y0")), "w": at(F.col("x1") - F.col("x0")), "h": at(F.col("y1") - F.col("y0"))})
    return boxes


def _hints(found: DataFrame, drawn: DataFrame, texts: DataFrame) -> DataFrame:
    """``found`` (page_id, kind, seq, box ...) with what kind of content most of the boxes that overlap each are."""
    keys = ["page_id", "kind", "seq"]
    boxes = drawn.select("page_id", F.lit(0).alias("is_text"), *BOX).unionByName(texts.select("page_id", F.lit(1).alias("is_text"), *BOX))
    met = r.overlaps(found.select(*keys, *BOX), boxes).groupBy(*keys).agg(F.count_if(F.col("o_is_text") == 0).alias("d"), F.count_if(F.col("o_is_text") == 1).alias("t"))
    joined = found.join(met, keys, "left").withColumns({"d": F.coalesce("d", F.lit(0)), "t": F.coalesce("t", F.lit(0))})
    return joined.withColumn("content_hint", r.content_hint(F.col("d"), F.col("t"))).drop("d", "t")


def vector_regions(pages: DataFrame, paths: DataFrame, texts: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(page_id, seq, x, y, width, height, label, confidence, region_type, content_hint), the largest first: frames, tables, and what else
    lies together, of pages with enough paths."""
    live = r.vector_pages(paths, pages.where("width_pt > 0 AND height_pt > 0")).withColumn("scale", F.col("width") / F.col("width_pt"))
    size = live.select("page_id", "scale", "width", "height")
    paths = paths.join(live.select("page_id", "width_pt", "height_pt"), "page_id")
    texts = texts.join(live.select("page_id"), "page_id", "left_semi")
    inner = without_borders(paths)
    tiny = (F.col("x1") - F.col("x0") < r.TINY) & (F.col("y1") - F.col("y0") < r.TINY)
    drawn = inner.where(~tiny).select("page_id", "path", *BOX)

    def large(boxes: DataFrame, kind: int) -> DataFrame:
        return _in_pixels(boxes.join(size, "page_id")).where(r.is_big_enough(F.col("w"), F.col("h"), settings)).withColumn("kind", F.lit(kind))

    framed = large(frames(inner), 0)
    segments = paths.select("page_id", F.explode("segments").alias("s"))
    items = segments.select("page_id", F.lit("l").alias("shape"), *[F.get("s", F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])
    grids = r.table_grids(items, live.select("page_id", "height_pt"))
    seq = F.row_number().over(W.partitionBy("page_id").orderBy("y0", "x0", "x1", "y1")).cast("int")
    tables = _in_pixels(grids.withColumn("seq", seq).join(size, "page_id"))
    tables = tables.where((F.col("w") > settings.region_min_side) & (F.col("h") > settings.region_min_side)).withColumn("kind", F.lit(1))
    # A table claims what its pixels cover.
    covered = {"x0": F.col("x") / F.col("scale"), "y0": F.col("y") / F.col("scale"), "x1": (F.col("x") + F.col("w")) / F.col("scale"), "y1": (F.col("y") + F.col("h")) / F.col("scale")}
    claimed = framed.select("page_id", *BOX).unionByName(tables.withColumns(covered).select("page_id", *BOX))
    boxes = drawn.select("page_id", F.col("path").alias("box"), *BOX).unionByName(texts.select("page_id", (F.col("text") + _BEHIND).alias("box"), *BOX))
    free = r.unclaimed(boxes, claimed).join(size, "page_id").withColumn("gap", r.CLUSTER_GAP_PX / F.col("scale"))
    others = large(merged(free.select("page_id", "box", "gap", *BOX)), 2)

    plain = ["page_id", "kind", "seq", *BOX, "x", "y", "w", "h", "width", "height"]
    boxed = _hints(framed.select(*plain).unionByName(others.select(*plain)), drawn, texts)
    x, y = F.greatest(F.lit(0), F.least("x", "width")), F.greatest(F.lit(0), F.least("y", "height"))
    boxed = boxed.withColumns({"x": x, "y": y}).withColumns({"w": F.least("w", F.col("width") - F.col("x")), "h": F.least("h", F.col("height") - F.col("y"))})
    out = boxed.select("page_id", "kind", "seq", "x", "y", "w", "h", F.lit("").alias("label"), F.when(F.col("kind") == 0, 0.9).otherwise(0.85).alias("confidence"), "content_hint")
    gridded = tables.select("page_id", "kind", "seq", "x", "y", "w", "h", F.lit("table").alias("label"), F.lit(0.9).alias("confidence"), F.lit("table").alias("content_hint"))
    place = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc(F.col("w") * F.col("h")), "kind", "seq")).cast("long")
    ranked = out.unionByName(gridded).withColumn("place", place).where(F.col("place") <= settings.max_regions)
    return ranked.select("page_id", F.col("place").alias("seq"), "x", "y", F.col("w").alias("width"), F.col("h").alias("height"), "label", "confidence", F.lit("detected").alias("region_type"), "content_hint")


def nested_paths(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, texts) rows of pages that hold them as arrays; a page without paths has none."""
    box = lambda c: [F.get(c, F.lit(k)).alias(b) for k, b in enumerate(BOX)]
    each = pages.select("page_id", F.posexplode("paths").alias("path", "p"))
    paths = each.select("page_id", F.col("path").cast("long").alias("path"), *box(F.col("p.box")), F.size("p.rects").alias("rects"), F.col("p.lines").alias("segments"))
    texts = pages.where("paths IS NOT NULL").select("page_id", F.posexplode("texts").alias("text", "t"))
    return paths, texts.select("page_id", F.col("text").cast("long").alias("text"), *box(F.col("t")))


def page_regions(pages: DataFrame, method: str = "auto", settings: Settings = DEFAULT) -> DataFrame:
    """REGION rows of (page_id, width, height, gray, width_pt, height_pt, paths, texts) pages; null paths: the page has none.

    The full page first, on large pages then regions by ``auto`` (paths, white space, content tiles: the first with two or more),
    ``pdf_vector``, ``heuristic`` or ``content_aware``. Only pages that their paths leave open have their pixels read.
    """
    if method in ("heuristic", "content_aware"):
        return r.image_regions(pages, method, settings)
    if method not in ("auto", "pdf_vector"):
        raise ValueError(f"Unknown detection method: {method}")
    if method == "pdf_vector":
        pages = pages.withColumn("paths", F.when(F.col("paths").isNull(), F.raise_error(F.lit("pdf_vector needs the page's paths"))).otherwise(F.col("paths")))
    large = pages.where(r.is_large(F.col("width"), F.col("height"), settings=settings) & F.col("paths").isNotNull())
    sized = large.select("page_id", "width", "height", "width_pt", "height_pt", F.lit(0).alias("n_images"))
    found = vector_regions(sized, *nested_paths(large), settings)
    if method == "auto":
        told = found.groupBy("page_id").agg(F.count("*").alias("n")).where("n >= 2").select("page_id")
        by_pixels = r.image_regions(pages.join(told, "page_id", "left_anti"), "auto", settings)
        pages, found = pages.join(told, "page_id", "left_semi"), found.join(told, "page_id", "left_semi")
    zero = F.lit(0).cast("long")
    whole = pages.select(
        "page_id", zero.alias("region"), zero.alias("x"), zero.alias("y"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"),
        F.lit("full_page").alias("label"), F.lit(1.0).alias("confidence"), F.lit("full_page").alias("region_type"), F.lit("").alias("content_hint"),
    )
    out = whole.unionByName(found.withColumnRenamed("seq", "region").withColumns({c: F.col(c).cast("long") for c in ("x", "y", "width", "height")}))
    return out.unionByName(by_pixels) if method == "auto" else out
