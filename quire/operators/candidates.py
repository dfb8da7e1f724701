"""Relations between table candidates of a page: joins on (doc_id, page) with box predicates, never pairs of a whole collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, containment, iou, least_area_overlap, nested, x_iou, y_gap

PAGE = ["doc_id", "page"]


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in PAGE])


def pairs(left: DataFrame, right: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame:
    """Boxes that share a page, columns prefixed."""
    return _renamed(left, a).join(_renamed(right, b), PAGE)


def covers(a: Box, b: Box, contained: float = 0.5, same: float = 0.4) -> Column:
    return (containment(a, b) >= contained) | (containment(b, a) >= contained) | (iou(a, b) >= same)


def without_covered(candidates: DataFrame, owners: DataFrame, contained: float = 0.5, same: float = 0.4) -> DataFrame:
    """Candidates that no owner of their page covers: an anti join on the page with a residual box predicate."""
    o = _renamed(owners, "o_").withColumnsRenamed({"doc_id": "o_doc", "page": "o_page"})
    on = (F.col("doc_id") == F.col("o_doc")) & (F.col("page") == F.col("o_page")) & covers(Box.of(), Box.of("o_"), contained, same)
    return candidates.join(o, on, "left_anti")


def overlaps_any(candidates: DataFrame, others: DataFrame, share: float = 0.40, same: float = 0.35) -> DataFrame:
    """Candidates that meet any of the others."""
    o = _renamed(others, "o_").withColumnsRenamed({"doc_id": "o_doc", "page": "o_page"})
    a, b = Box.of(), Box.of("o_")
    on = (F.col("doc_id") == F.col("o_doc")) & (F.col("page") == F.col("o_page")) & ((least_area_overlap(a, b) >= share) | (iou(a, b) >= same))
    return candidates.join(o, on, "left_semi")


def in_cells(runs: DataFrame, cells: DataFrame, pad: float = 1.0) -> DataFrame:
    """Runs (columns r_) with each cell (c_) of their page that has their centre, give or take a pad."""
    both = pairs(runs, cells, "r_", "c_")
    x, y = (F.col("r_x0") + F.col("r_x1")) / 2, (F.col("r_y0") + F.col("r_y1")) / 2
    return both.where(x.between(F.col("c_x0") - pad, F.col("c_x1") + pad) & y.between(F.col("c_y0") - pad, F.col("c_y1") + pad))


def own_cells(runs: DataFrame, cells: DataFrame, run: str, pad: float = 1.0) -> DataFrame:
    """Of ``in_cells`` one cell for each run: where its centre is deepest inside, of equals the leftmost."""
    x, y = (F.col("r_x0") + F.col("r_x1")) / 2, (F.col("r_y0") + F.col("r_y1")) / 2
    depth = F.least(x - F.col("c_x0"), F.col("c_x1") - x, y - F.col("c_y0"), F.col("c_y1") - y)
    best = Window.partitionBy(*PAGE, f"r_{run}").orderBy(F.desc("_depth"), "c_x0", f"c_{run}")
    return in_cells(runs, cells, pad).withColumn("_depth", depth).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_depth")


def nested_pairs(boxes: DataFrame, key: str) -> DataFrame:
    both = pairs(boxes, boxes, "c_", "p_")
    return both.where((F.col(f"c_{key}") != F.col(f"p_{key}")) & nested(Box.of("c_"), Box.of("p_")))


def stackable(boxes: DataFrame, key: str, x_share: float = 0.60, gap: float = 18.0) -> DataFrame:
    """Pairs of one page, upper first, that stand above each other closely enough to be one."""
    both = pairs(boxes, boxes)
    a, b = Box.of("a_"), Box.of("b_")
    return both.where((F.col(f"a_{key}") != F.col(f"b_{key}")) & (a.y1 > b.y1) & (x_iou(a, b) >= x_share) & (y_gap(a, b) <= gap))


def best_of_page(candidates: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first of each page."""
    return candidates.withColumn("_rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def prune_subordinate(streams: DataFrame, least: int = 3, area: float = 0.45, rows: float = 0.70) -> DataFrame:
    """Of pages with several, the candidates that are small beside the largest go."""
    w = Window.partitionBy(*PAGE)
    size = Box.of().area
    found = streams.withColumn("_n", F.count("*").over(w)).withColumn("_a", F.max(size).over(w)).withColumn("_r", F.max("rows").over(w))
    return found.where((F.col("_n") < least) | (size >= area * F.col("_a")) | (F.col("rows") >= rows * F.col("_r"))).drop("_n", "_a", "_r")


def above_floor(candidates: DataFrame, floors: dict[str, float]) -> DataFrame:
    floor = F.lit(0.0)
    for method, least in floors.items():
        floor = F.when(F.col("method") == method, least).otherwise(floor)
    return candidates.where(F.col("confidence") >= floor)


def adjacent_pages(fragments: DataFrame, height: float = 792.0, band: float = 0.30, reach: float = 0.45) -> DataFrame:
    """Pairs of fragments, one low on a page and one high on the next, with the same columns."""
    low = fragments.where((F.col("y0") < band * height) | ((F.col("y0") + F.col("y1")) / 2 < reach * height))
    high = fragments.where((F.col("y1") > (1 - band) * height) | ((F.col("y0") + F.col("y1")) / 2 > (1 - reach) * height))
    a = low.select("doc_id", (F.col("page") + 1).alias("page"), *[F.col(c).alias(f"a_{c}") for c in low.columns if c not in PAGE])
    return a.join(_renamed(high, "b_"), PAGE).where((F.col("a_cols") == F.col("b_cols")) & (F.col("a_cols") >= 2))


def _beside(candidates: DataFrame, others: DataFrame, test: Column, how: str) -> DataFrame:
    o = _renamed(others, "o_").withColumnsRenamed({"doc_id": "o_doc", "page": "o_page"})
    return candidates.join(o, (F.col("doc_id") == F.col("o_doc")) & (F.col("page") == F.col("o_page")) & test, how)


def without_subordinate_streams(streams: DataFrame, lattices: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Borderless candidates that meet a ruled table go, unless they are more than ``ratio`` times as large as every one they meet."""
    a, b = Box.of(), Box.of("o_")
    meets = (least_area_overlap(a, b) >= 0.40) | (iou(a, b) >= 0.35)
    return _beside(streams, lattices, meets & (a.area <= ratio * b.area), "left_anti")


def without_wide_hybrids(hybrids: DataFrame, streams: DataFrame, cols: int = 14) -> DataFrame:
    """Partly ruled candidates of many columns go where a borderless one covers the same place."""
    return _beside(hybrids, streams, (F.col("cols") >= cols) & covers(Box.of(), Box.of("o_")), "left_anti")


def without_sparse_ruled(ruled: DataFrame, streams: DataFrame, fill: float = 0.35, strong: float = 0.62) -> DataFrame:
    """Ruled candidates that are mostly empty go where a sure borderless one covers the same place."""
    return _beside(ruled, streams, (F.col("fill") < fill) & (F.col("o_confidence") >= strong) & covers(Box.of(), Box.of("o_")), "left_anti")


def demoted_slices(lattices: DataFrame, streams: DataFrame, factor: float = 0.45, share: float = 0.35) -> DataFrame:
    """Ruled tables that are a narrow slice of a wider borderless table lose confidence."""
    a, b = Box.of(), Box.of("o_")
    slice_ = (containment(a, b) >= 0.85) & (a.area <= share * b.area) & (F.col("cols") <= 2)
    hit = _beside(lattices, streams, slice_, "left_semi").select("doc_id", "page", "id", F.lit(True).alias("_hit"))
    found = lattices.join(hit, [*PAGE, "id"], "left")
    return found.withColumn("confidence", F.col("confidence") * F.when(F.col("_hit"), factor).otherwise(1.0)).drop("_hit")
