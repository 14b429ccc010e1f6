"""Regions of large pages: boxes from vector paths, from white space, and from tiles.

What is arithmetic over rows is columns and windows partitioned by page; what is iterative or works on
pixels runs in Arrow batches, a page at a time. A page is bounded by its paths and pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Settings

#: Thresholds in points, pixels and shares.
BORDER_SPAN, BORDER_NEAR, FRAME_AREA, TINY = 0.85, 5.0, 0.02, 5.0
LINE_FLAT, LINE_LEAST, TABLE_LINES, TABLE_SPREAD, TABLE_NEAR = 2.0, 20.0, 3, 0.3, 10.0
INSIDE_NEAR, INSIDE_RATIO, CLUSTER_GAP_PX = 5.0, 0.95, 100.0
CONTENT_GRAY, BLANK_SHARE, BLANK_RUN, REGION_SHARE, DENSITY_SCALE = 240, 0.02, 50, 0.005, 10.0
GRID, NEIGHBOUR = 50, 5

REGION = "page_id long, region long, x long, y long, width long, height long, label string, confidence double, region_type string, content_hint string"


def is_large(width: Column, height: Column, force: bool = False, settings: Settings = DEFAULT) -> Column:
    return (width * height > settings.region_min_pixels) | F.lit(force)


def is_big_enough(width: Column, height: Column, settings: Settings = DEFAULT) -> Column:
    side = settings.region_min_side
    return (width >= side) & (height >= side) & (width * height >= settings.region_min_area)


def spans_page(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, share: float = BORDER_SPAN) -> Column:
    return (x1 - x0 > width * share) & (y1 - y0 > height * share)


def vector_pages(paths: DataFrame, pages: DataFrame, least: int = 10) -> DataFrame:
    """Pages with enough paths that aren't one scanned image with a few paths on it."""
    n = paths.groupBy("page_id").agg(F.count("*").alias("n_paths"))
    return pages.join(n, "page_id").where((F.col("n_paths") >= least) & ~((F.col("n_images") == 1) & (F.col("n_paths") < 2 * least))).drop("n_paths")


def tiles(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Overlapping tiles of each page (page_id, width, height), evenly spread."""
    side, step = settings.tile_side, settings.tile_side - settings.tile_overlap

    def count(length: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil((length - settings.tile_overlap) / F.lit(step)).cast("int"))

    def start(length: Column, i: Column, n: Column) -> Column:
        return F.when(n > 1, (i * ((length - side) / (n - 1).cast("double"))).cast("long")).otherwise(F.lit(0).cast("long"))

    p = pages.withColumn("nx", count(F.col("width"))).withColumn("ny", count(F.col("height")))
    p = p.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    p = p.withColumn("x", start(F.col("width"), F.col("col"), F.col("nx"))).withColumn("y", start(F.col("height"), F.col("row"), F.col("ny")))
    p = p.withColumn("w", F.least(F.lit(side), F.col("width") - F.col("x"))).withColumn("h", F.least(F.lit(side), F.col("height") - F.col("y")))
    return p.where(is_big_enough(F.col("w"), F.col("h"))).select("page_id", "x", "y", F.col("w").cast("long").alias("width"), F.col("h").cast("long").alias("height"), F.format_string("tile_r%d_c%d", "row", "col").alias("label"))


def gap_clusters(rows: DataFrame, group: str, at: str, gap: Column | float, tie: str) -> DataFrame:
    """Rows with ``cluster``: a new one begins where the position is ``gap`` or more beyond the one before."""
    w = W.partitionBy(group).orderBy(at, tie)
    new = F.when(F.col(at) - F.lag(at).over(w) >= gap, 1).otherwise(0)
    return rows.withColumn("new", new).withColumn("cluster", F.sum("new").over(w)).drop("new")


def regularity(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, n, spread): distinct positions and the deviation of their distances over the mean."""
    d = rows.select(*keys, at).distinct()
    d = d.withColumn("step", F.col(at) - F.lag(at).over(W.partitionBy(*keys).orderBy(at)))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), (F.stddev_pop("step") / F.avg("step")).alias("spread"))


def low_runs(rows: DataFrame, group: str, at: str, value: str, below: float, least: int) -> DataFrame:
    """(group, split): the middles of runs of ``least`` or more low values that something follows."""
    w = W.partitionBy(group).orderBy(at)
    r = rows.withColumn("low", F.col(value) < below).withColumn("edge", F.max(at).over(W.partitionBy(group)))
    r = r.withColumn("island", F.row_number().over(w) - F.row_number().over(W.partitionBy(group, "low").orderBy(at)))
    runs = r.where("low").groupBy(group, "island").agg(F.min(at).alias("start"), F.count("*").alias("n"), F.max(at).alias("end"), F.first("edge").alias("edge"))
    return runs.where((F.col("n") >= least) & (F.col("end") < F.col("edge"))).select(group, (F.col("start") + F.expr("n div 2")).alias("split"))


def sliding_minimum(rows: DataFrame, group: str, at: str, value: str, reach: int, window: Column) -> DataFrame:
    """(group, at): of the positions in the window that of the least mean over ``reach`` before and after; the first of equals."""
    mean = F.avg(value).over(W.partitionBy(group).orderBy(at).rowsBetween(-reach, reach - 1))
    return rows.withColumn("mean", F.round(mean, 9)).where(window).groupBy(group).agg(F.min_by(at, F.struct("mean", at)).alias(at))


def lines(items: DataFrame) -> DataFrame:
    """(page_id, kind, at, low, high): flat lines of vector items, kind h or v."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    kind = F.when((dy < LINE_FLAT) & (dx > LINE_LEAST), "h").when((dx < LINE_FLAT) & (dy > LINE_LEAST), "v")
    across = F.when(F.col("kind") == "h", F.least("y1", "y2")).otherwise(F.least("x1", "x2"))
    low = F.when(F.col("kind") == "h", F.least("x1", "x2")).otherwise(F.least("y1", "y2"))
    high = F.when(F.col("kind") == "h", F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2"))
    lined = items.where("shape = 'l'").withColumn("kind", kind).where("kind is not null")
    return lined.select("page_id", "kind", across.alias("at"), low.alias("low"), high.alias("high"))


def table_grids(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, x0, y0, x1, y1) in points: evenly spaced horizontal lines, close together, with vertical lines that
    cross them. Pages are (page_id, height_pt)."""
    found = lines(items).withColumn("tie", F.monotonically_increasing_id())
    h = found.where("kind = 'h'").join(pages.select("page_id", "height_pt"), "page_id")
    h = gap_clusters(h, "page_id", "at", F.col("height_pt") * 0.3, "tie")
    even = regularity(h, ["page_id", "cluster"], "at").where((F.col("n") >= TABLE_LINES) & (F.col("spread") <= TABLE_SPREAD))
    box = h.groupBy("page_id", "cluster").agg(F.min("low").alias("x0"), F.min("at").alias("y0"), F.max("high").alias("x1"), F.max("at").alias("y1"), F.count("*").alias("lines"))
    box = box.where(F.col("lines") >= TABLE_LINES).join(even.select("page_id", "cluster"), ["page_id", "cluster"])
    v = found.where("kind = 'v'").select("page_id", F.col("at").alias("v_at"), F.col("low").alias("v_low"), F.col("high").alias("v_high"))
    crossed = (F.col("v_low") <= F.col("y1")) & (F.col("v_high") >= F.col("y0")) & F.col("v_at").between(F.col("x0") - TABLE_NEAR, F.col("x1") + TABLE_NEAR)
    n = box.join(v, "page_id").where(crossed).groupBy("page_id", "cluster").agg(F.count("*").alias("crossing"))
    return box.join(n.where(F.col("crossing") >= TABLE_LINES), ["page_id", "cluster"]).select("page_id", "x0", "y0", "x1", "y1")


def overlaps(a: DataFrame, b: DataFrame, prefix: str = "o", cell: int = 256, block: int = 1024) -> DataFrame:
    """Pairs of boxes of one page that overlap. Boxes meet in the cells of a grid that they reach; a pair counts in the
    cell of the upper left corner of what they share, so once, and a page's boxes are not all compared.

    Equal boxes meet as one, with the rows that have it in blocks of ``block``: what is compared grows with the distinct boxes, and
    only the pairs themselves with the rows."""
    at = lambda c: F.floor(F.col(c) / cell)
    place = ["x0", "y0", "x1", "y1"]

    def celled(boxes: DataFrame, p: str) -> DataFrame:
        rest = [c for c in boxes.columns if c not in ("page_id", *place)]
        nth = F.row_number().over(W.partitionBy("page_id", *place).orderBy(F.lit(1)))
        boxes = boxes.withColumn("block", F.floor((nth - 1) / block))
        boxes = boxes.groupBy("page_id", *place, "block").agg(F.collect_list(F.struct(*rest, F.lit(True).alias("_"))).alias("rows"))
        boxes = boxes.select("page_id", *[F.col(c).alias(f"{p}{c}") for c in (*place, "rows")])
        boxes = boxes.withColumn("cx", F.explode(F.sequence(at(f"{p}x0"), at(f"{p}x1"))))
        boxes = boxes.withColumn("cy", F.explode(F.sequence(at(f"{p}y0"), at(f"{p}y1"))))
        return boxes.repartition(tasks, "page_id", "cx", "cy")

    # Few bytes meet and many pairs come out, so partitions by bytes would leave the pairs to few tasks.
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    o = f"{prefix}_"
    hit = (F.col(f"{o}x0") < F.col("x1")) & (F.col(f"{o}x1") > F.col("x0")) & (F.col(f"{o}y0") < F.col("y1")) & (F.col(f"{o}y1") > F.col("y0"))
    corner = lambda c: F.floor(F.greatest(F.col(c), F.col(f"{o}{c}")) / cell)
    met = celled(a, "").join(celled(b, o), ["page_id", "cx", "cy"]).where(hit & (F.col("cx") == corner("x0")) & (F.col("cy") == corner("y0")))
    met = met.withColumn("row", F.explode("rows")).withColumn(f"{o}row", F.explode(f"{o}rows"))
    mine = [F.col(c) if c in ("page_id", *place) else F.col(f"row.{c}").alias(c) for c in a.columns]
    return met.select(*mine, *[F.col(f"{o}{c}") if c in place else F.col(f"{o}row.{c}").alias(f"{o}{c}") for c in b.columns if c != "page_id"])


def unclaimed(boxes: DataFrame, areas: DataFrame, near: float = INSIDE_NEAR) -> DataFrame:
    """Boxes that no area of their page holds, but for ``near``."""
    a = areas.select(F.col("page_id").alias("a_page"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    held = (F.col("page_id") == F.col("a_page")) & (F.col("x0") >= F.col("a_x0") - near) & (F.col("y0") >= F.col("a_y0") - near) & (F.col("x1") <= F.col("a_x1") + near) & (F.col("y1") <= F.col("a_y1") + near)
    return boxes.join(a, held, "left_anti")


def content_hint(drawings: Column, texts: Column) -> Column:
    """By the share of text blocks among all: notes, drawing_view or detail."""
    share = texts / F.nullif(drawings + texts, F.lit(0))
    return F.when(share > 0.7, "notes").when(share < 0.3, "drawing_view").otherwise("detail")


def largest(regions: DataFrame, n: int = DEFAULT.max_regions) -> DataFrame:
    """Of each page the n largest regions, at most n a page and task before the shuffle."""
    rank = F.row_number().over(W.partitionBy("page_id").orderBy((F.col("width") * F.col("height")).desc(), "x", "y"))
    return regions.withColumn("r", rank).where(F.col("r") <= n).drop("r")


def merge_boxes(boxes: np.ndarray, gap: float) -> np.ndarray:
    """Boxes united while two are within ``gap``. A pass grows each box, in order, by those after it."""
    boxes = np.asarray(boxes, float).reshape(-1, 4)
    while True:
        out, free = [], np.ones(len(boxes), bool)
        for i in range(len(boxes)):
            if not free[i]:
                continue
            free[i] = False
            own = boxes[i].copy()
            rest = i + 1
            while rest < len(boxes):  # the next one in reach of what the box has grown to
                o = boxes[rest:]
                near = free[rest:] & (own[0] - gap <= o[:, 2]) & (own[2] + gap >= o[:, 0]) & (own[1] - gap <= o[:, 3]) & (own[3] + gap >= o[:, 1])
                if not near.any():
                    break
                j = rest + int(near.argmax())
                own[:2], own[2:] = np.minimum(own[:2], boxes[j, :2]), np.maximum(own[2:], boxes[j, 2:])
                free[j] = False
                rest = j + 1
            out.append(own)
        if len(out) == len(boxes):
            return np.array(out).reshape(-1, 4)
        boxes = np.array(out)


def merge_page_boxes(boxes: DataFrame, gap: float) -> DataFrame:
    """(page_id, x0, y0, x1, y1): the boxes of each page merged, in the order of ``box``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = merge_boxes(pdf.sort_values("box")[["x0", "y0", "x1", "y1"]].to_numpy(), gap)
        return pd.DataFrame({"page_id": pdf["page_id"].iloc[0], "x0": got[:, 0], "y0": got[:, 1], "x1": got[:, 2], "y1": got[:, 3]})

    return boxes.groupBy("page_id").applyInPandas(one, "page_id long, x0 double, y0 double, x1 double, y1 double")


def blank_splits(density: np.ndarray, least: int = BLANK_RUN, below: float = BLANK_SHARE) -> list[int]:
    """The middles of blank runs that content follows."""
    low = np.concatenate([[False], np.asarray(density) < below, [False]]).astype(np.int8)
    starts, ends = np.flatnonzero(np.diff(low) == 1), np.flatnonzero(np.diff(low) == -1)
    return [int(a + (b - a) // 2) for a, b in zip(starts, ends, strict=True) if b - a >= least and b < len(density)]


def minimum_splits(density: np.ndarray, n: int, window: int) -> list[int]:
    """Near each of n even cuts the position of the least mean density around it, the first of equals."""
    total = np.concatenate([[0.0], np.cumsum(np.asarray(density, float))])
    size, reach, out = len(density), max(1, window // NEIGHBOUR), []
    for i in range(1, n + 1):
        ideal = size * i // (n + 1)
        pos = np.arange(max(0, ideal - window), min(size, ideal + window))
        if not len(pos):
            out.append(ideal)
            continue
        a, b = np.maximum(0, pos - reach), np.minimum(size, pos + reach)
        out.append(int(pos[np.argmin(np.round((total[b] - total[a]) / (b - a), 12))]))
    return sorted(out)


def tile_count(length: int, settings: Settings = DEFAULT) -> int:
    return max(1, -(-(length - settings.tile_overlap) // (settings.tile_side - settings.tile_overlap)))


def page_tiles(width: int, height: int, settings: Settings = DEFAULT) -> list[dict]:
    """The tiles of one page, as tiles() has them."""
    nx, ny, side, out = tile_count(width, settings), tile_count(height, settings), settings.tile_side, []
    for row in range(ny):
        for col in range(nx):
            x = int(col * (width - side) / (nx - 1)) if nx > 1 else 0
            y = int(row * (height - side) / (ny - 1)) if ny > 1 else 0
            w, h = min(side, width - x), min(side, height - y)
            if min(w, h) >= settings.region_min_side and w * h >= settings.region_min_area:
                out.append({"x": x, "y": y, "width": w, "height": h, "label": f"tile_r{row}_c{col}", "confidence": 0.0, "region_type": "tile", "content_hint": ""})
    return out


def _cells(rows: list[int], cols: list[int], height: int, width: int, settings: Settings) -> Iterator[tuple[int, int, int, int, int, int]]:
    ys, xs = [0, *rows, height], [0, *cols, width]
    for i, (y, y2) in enumerate(zip(ys, ys[1:], strict=False)):
        for j, (x, x2) in enumerate(zip(xs, xs[1:], strict=False)):
            if min(x2 - x, y2 - y) >= settings.region_min_side and (x2 - x) * (y2 - y) >= settings.region_min_area:
                yield i, j, x, y, x2 - x, y2 - y


def whitespace_regions(gray: np.ndarray, settings: Settings = DEFAULT) -> list[dict]:
    """Cells between blank bands that have content; fewer than two: tiles."""
    ink = gray < CONTENT_GRAY
    out = []
    for _, _, x, y, w, h in _cells(blank_splits(ink.mean(axis=1)), blank_splits(ink.mean(axis=0)), *ink.shape, settings):
        share = float(ink[y : y + h, x : x + w].mean())
        if share >= REGION_SHARE:
            out.append({"x": x, "y": y, "width": w, "height": h, "label": "", "confidence": min(1.0, share * DENSITY_SCALE), "region_type": "detected", "content_hint": ""})
    out = out if len(out) >= 2 else page_tiles(gray.shape[1], gray.shape[0], settings)
    return sorted(out, key=lambda r: -r["width"] * r["height"])[: settings.max_regions]


def content_tiles(gray: np.ndarray, settings: Settings = DEFAULT) -> list[dict]:
    """Tiles cut where there is least content: as many cuts as tiles would be, so one strip more."""
    ink, (h, w) = gray < CONTENT_GRAY, gray.shape
    rows = minimum_splits(ink.mean(axis=1), tile_count(h, settings), max(1, h // GRID))
    cols = minimum_splits(ink.mean(axis=0), tile_count(w, settings), max(1, w // GRID))
    out = [{"x": x, "y": y, "width": rw, "height": rh, "label": f"tile_r{i}_c{j}", "confidence": 0.0, "region_type": "content_tile", "content_hint": "content_tile"} for i, j, x, y, rw, rh in _cells(rows, cols, h, w, settings)]
    out = out if len(out) >= 2 else page_tiles(w, h, settings)
    return sorted(out, key=lambda r: -r["width"] * r["height"])[: settings.max_regions]


def detect(method: str, gray: np.ndarray, settings: Settings = DEFAULT) -> list[dict]:
    """The full page first, then regions of its pixels by ``auto`` (white space, content tiles: the first with two or more),
    ``heuristic`` or ``content_aware``. Small pages have the full page alone."""
    h, w = gray.shape
    whole = {"x": 0, "y": 0, "width": w, "height": h, "label": "full_page", "confidence": 1.0, "region_type": "full_page", "content_hint": ""}
    runs = {"heuristic": whitespace_regions, "content_aware": content_tiles}
    if method != "auto" and method not in runs:
        raise ValueError(f"Unknown detection method: {method}")
    if w * h <= settings.region_min_pixels:
        return [whole]
    found: list[dict] = []
    for run in runs.values() if method == "auto" else (runs[method],):
        found = run(gray, settings)
        if len(found) >= 2:
            break
    return [whole, *found]


_PATHS = "array<struct<box:array<double>,lines:array<array<double>>,rects:array<array<double>>>>"


def drawn_pages(ids: DataFrame, side: int = 2000) -> DataFrame:
    """Pages for page_regions(), drawn by their number modulo 3: two frames with paths in them; two dark fields of
    pixels; blank."""

    def frame(x: float) -> list[dict]:
        corners = [[x, 100.0, x + 400.0, 100.0], [x, 900.0, x + 400.0, 900.0], [x, 100.0, x, 900.0]]
        inner = [{"box": [x + 20.0 * k, 200.0, x + 20.0 * k + 30.0, 300.0], "lines": [], "rects": []} for k in range(1, 8)]
        return [{"box": [x, 100.0, x + 400.0, 900.0], "lines": corners, "rects": []}, *inner]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for page in pdf["page_id"].tolist():
                gray, paths = np.full((side, side), 255, np.uint8), None
                if page % 3 == 0:
                    paths = [*frame(50.0), *frame(520.0)]
                elif page % 3 == 1:
                    gray[100:900, 100:1900] = gray[1100:1900, 100:1900] = 0
                row = {"page_id": page, "width": side, "height": side, "gray": gray.tobytes(), "width_pt": 1000.0, "height_pt": 1000.0, "paths": paths, "texts": []}
                yield pd.DataFrame([row])

    kinds = f"page_id long, width long, height long, gray binary, width_pt double, height_pt double, paths {_PATHS}, texts array<array<double>>"
    return ids.select("page_id").mapInPandas(each, kinds)


def image_regions(pages: DataFrame, method: str = "auto", settings: Settings = DEFAULT) -> DataFrame:
    """REGION rows of (page_id, width, height, gray binary) pages, one page in memory at a time."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                gray = np.frombuffer(r.gray, np.uint8).reshape(r.height, r.width)
                got = pd.DataFrame(detect(method, gray, settings))
                got.insert(0, "page_id", r.page_id)
                got.insert(1, "region", np.arange(len(got)))
                yield got

    return pages.select("page_id", "width", "height", "gray").mapInPandas(each, REGION)
