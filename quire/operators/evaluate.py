"""Scores of extracted text, cells and objects against what was expected, as DataFrame aggregates."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import normal_cell, normal_text, share, soft_number


def f1(precision: Column, recall: Column) -> Column:
    return share(2 * precision * recall, precision + recall)


def character_error(want: Column, got: Column) -> Column:
    """Edit distance over the expected length, on normal text."""
    a, b = normal_text(want), normal_text(got)
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(a))


#: Stands for words in word_error, one character each.
_SIGNS = "".join(map(chr, range(0x4E00, 0x9FA0)))


def word_error(want: Column, got: Column) -> Column:
    """Edit distance in words over the expected number, on normal text; null where none is expected.

    Each distinct word of the two texts becomes one character, of which there are
    some 21,000, and the distance of strings does the rest.
    """
    words = lambda t: F.filter(F.split(normal_text(t), r"\s+"), lambda w: w != "")

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        known = lambda v: F.transform(F.array(F.array_distinct(F.concat(a, b))), lambda k: F.array_join(F.transform(v, lambda w: F.substring(F.lit(_SIGNS), F.array_position(k, w).cast("int"), 1)), ""))[0]
        return F.when(F.size(a) > 0, F.levenshtein(known(a), known(b)) / F.size(a))

    # The pair is bound once, not once a word.
    return F.transform(F.array(F.struct(words(want).alias("a"), words(got).alias("b"))), of)[0]


def token_recall(text: Column, tokens: Column) -> Column:
    """The share of required tokens that a text has; nothing required is 1."""
    hits = F.transform(F.array(F.lower(normal_text(text))), lambda own: F.size(F.filter(tokens, lambda t: F.contains(own, F.lower(t)))))[0]
    return F.when(F.size(tokens) == 0, 1.0).otherwise(hits / F.size(tokens))


def any_token(text: Column, tokens: Column) -> Column:
    """Whether a text has one of the tokens; without tokens it has."""
    return (F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(text, t))


def same_cell(want: Column, got: Column) -> Column:
    """Equal text, equal number, or one in the other with four characters at least."""
    a, b = normal_cell(want), normal_cell(got)
    x, y = soft_number(a), soft_number(b)
    shorter = F.least(F.length(a), F.length(b))
    return (a == b) | F.coalesce(F.abs(x - y) < 1e-9, F.lit(False)) | ((shorter >= 4) & (F.contains(a, b) | F.contains(b, a)))


def cell_scores(want: DataFrame, got: DataFrame, key: list[str]) -> DataFrame:
    """key, tp, fp, fn, precision, recall, f1 of cells (key, row, col, text); a wrong cell is a miss, cells beyond the expected shape are false."""
    both = want.select(*key, "row", "col", F.col("text").alias("want")).join(got.select(*key, "row", "col", F.col("text").alias("got")), [*key, "row", "col"], "full_outer")
    full = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    hit = full("want") & full("got") & same_cell(F.col("want"), F.col("got"))
    sums = both.groupBy(*key).agg(F.count_if(hit).alias("tp"), F.count_if(full("got") & ~full("want")).alias("fp"), F.count_if(full("want") & ~hit).alias("fn"))
    p, r = share(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), share(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return sums.select(*key, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def count_scores(df: DataFrame, want: str, got: str, tolerance: int = 0) -> DataFrame:
    """tp, fp, fn of counts: what both have, what is too much (beyond the tolerance), what is missing."""
    w, g = F.col(want), F.col(got)
    return df.withColumns({"tp": F.least(w, g), "fp": F.greatest(g - w - tolerance, F.lit(0)), "fn": F.greatest(w - g - tolerance, F.lit(0))})


def set_scores(want: Column, got: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, f1) of two arrays as sets; two empty sets agree."""
    both = F.size(F.array_intersect(want, got)).cast("double")
    none = (F.size(want) == 0) & (F.size(got) == 0)
    p = F.when(none, 1.0).otherwise(share(both, F.size(F.array_distinct(got)).cast("double")))
    r = F.when(none, 1.0).otherwise(share(both, F.size(F.array_distinct(want)).cast("double")))
    return p, r, f1(p, r)


def order_score(text: Column, pieces: Column) -> Column:
    """The share of neighbouring pieces that stand in order in a text; 0 if any is missing."""
    at = F.transform(pieces, lambda p: F.locate_column(p, text) if hasattr(F, "locate_column") else F.position(p, text))
    follows = F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: a < b)
    ok = F.size(F.filter(follows, lambda x: x)).cast("double") / (F.size(pieces) - 1)
    return F.when(F.exists(at, lambda x: x == 0), 0.0).when(F.size(pieces) < 2, 1.0).otherwise(ok)


def table_score(detection: Column, shape: Column, cells: Column) -> Column:
    return 0.35 * detection + 0.25 * shape + 0.40 * cells


def scoreboard(scores: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Means by group, for every rollup of the groups, in one pass."""
    level = F.grouping_id().cast("int").alias("level")
    return scores.rollup(*by).agg(level, F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], bins: int = 65_536) -> DataFrame:
    """by, n, mean, least, most, and per name the value of that rank (a whole number from 0, given n) of each group, exact.

    A histogram of each group finds the bins with the ranks; only their values,
    one in ``bins`` if they spread, are sorted. So no task gets a whole group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    # One small row a group, which Spark broadcasts while they are few; many groups are none of them hot.
    wide = F.col("most") - F.col("least")
    binned = rows.join(stats.select(*by, "least", "most"), by).withColumn("_b", F.when(wide > 0, F.least(F.floor((F.col("_v") - F.col("least")) / wide * bins), F.lit(bins - 1))).otherwise(0).cast("int"))
    order = Window.partitionBy(*by).orderBy("_b")
    counts = binned.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    placed = counts.withColumn("_before", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
    wanted = stats.select(*by, F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("n")).cast("bigint").alias("_k")) for name, rank in ranks.items()])))
    found = placed.join(wanted, by).where((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c")))
    some = binned.join(found.select(*by, "_b", "_before").distinct(), [*by, "_b"])
    ranked = some.withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_v")) - 1)
    got = ranked.select(*by, "_k", "_v").join(wanted, [*by, "_k"]).groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    return stats.join(got, by)


def latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact percentiles, linear between values."""
    ends = {f"_{name}_{side}": (lambda n, p=p, f=f: f(F.lit(p) * (n - 1))) for name, p in (("p50", 0.5), ("p95", 0.95)) for side, f in (("lo", F.floor), ("hi", F.ceil))}
    got = order_statistics(df, by, value, ends)
    part = lambda p: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    between = lambda name, p: F.round(F.col(f"_{name}_lo") + part(p) * (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")), 6).alias(name)
    return got.select(*by, "n", between("p50", 0.5), between("p95", 0.95), F.round("mean", 6).alias("mean"), "most")


def run_summary(runs: DataFrame, library: str = "library", success: str = "success", recall: str = "recall", wall: str = "wall_ms") -> DataFrame:
    """Per library: runs, successes, failures, mean recall, and mean, upper median and total time of what succeeded."""
    ok = F.col(success)
    sums = runs.groupBy(library).agg(F.count("*").alias("runs"), F.count_if(ok).alias("successes"), F.avg(F.when(ok, F.col(recall))).alias("mean_recall"), F.coalesce(F.sum(F.when(ok, F.col(wall))), F.lit(0.0)).alias("total"))
    times = order_statistics(runs.where(ok), [library], wall, {"median": lambda n: F.floor(n / 2)}).select(library, F.col("mean").alias("mean_wall"), "median")
    return sums.join(times, library, "left").select(library, "runs", "successes", (F.col("runs") - F.col("successes")).alias("failures"), "mean_recall", "mean_wall", "median", "total")


def detection_discipline(counts: DataFrame, by: list[str], want: str = "want", got: str = "got") -> DataFrame:
    """Shares of exact, too many, too few and far too many (three more) tables found, and found over expected."""
    w, g = F.col(want), F.col(got)
    rate = lambda c, n: F.avg(c.cast("double")).alias(n)
    return counts.groupBy(*by).agg(F.count("*").alias("n"), rate(w == g, "exact"), rate(g > w, "over"), rate(g < w, "under"), rate(g - w >= 3, "far_over"), share(F.sum(g).cast("double"), F.sum(w).cast("double")).alias("ratio"))


def failure_modes(counts: DataFrame, key: list[str], want: str = "want", got: str = "got", cells: str | None = None) -> DataFrame:
    """A row per document and way in which it fails."""
    w, g = F.col(want), F.col(got)
    tags = [F.when((w > 0) & (g == 0), "missed"), F.when((w == 0) & (g > 0), "false_positive"), F.when((w > 0) & (g > w), "over_split"), F.when((g > 0) & (g < w), "under_split")]
    if cells:
        tags.append(F.when((w == g) & (F.col(cells) < 0.5), "wrong_cells"))
    return counts.select(*key, F.explode(F.array_compact(F.array(*tags))).alias("mode"))


def peer_board(scores: DataFrame, document: str, peer: str, value: str) -> DataFrame:
    """Per peer the mean score over documents and how many it wins; ties win for all."""
    from pyspark.sql import Window

    best = F.max(value).over(Window.partitionBy(document))
    return scores.withColumn("_win", (F.col(value) == best).cast("long")).groupBy(peer).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum("_win").alias("wins"))


def cell_vote(cells: DataFrame, key: list[str], value: str = "text") -> DataFrame:
    """The text that most peers read in a cell, ties to the longer then the first, and whether all agree."""
    votes = cells.groupBy(*key, value).agg(F.count("*").alias("n"))
    order = F.struct(F.col("n"), F.length(value).alias("l"), F.col(value))
    return votes.groupBy(*key).agg(F.max_by(value, order).alias(value), (F.count("*") == 1).alias("agreed"), F.sum("n").alias("n_votes"))


def gates(scores: DataFrame, least: dict[str, float]) -> DataFrame:
    """A row per gate: the mean of a column against its least value."""
    row = scores.agg(*[F.avg(c).alias(c) for c in least])
    each = F.array(*[F.struct(F.lit(c).alias("gate"), F.col(c).alias("value"), F.lit(float(v)).alias("least"), (F.col(c) >= v).alias("passed")) for c, v in least.items()])
    return row.select(F.inline(each))


# Matching of tables


def assigned(pairs: DataFrame, key: list[str], gold: str = "gold", pred: str = "pred", score: str = "score") -> DataFrame:
    """key, gold, pred, score: each gold table in order takes the best table that is still free, the first of equals; -1: none is left.

    The pairs of a document are folded in one row, so a document is the unit of
    work, and no row is iterated outside the plan.
    """
    own = F.struct((-F.col(score)).alias("s"), F.col(pred).cast("int").alias("p"))
    each = pairs.groupBy(*key, gold).agg(F.array_sort(F.collect_list(F.when(F.col(pred).isNotNull(), own))).alias("preds"))
    rows = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(gold).cast("int").alias("g"), "preds"))).alias("golds"))
    kind = "struct<used:array<int>,out:array<struct<gold:int,pred:int,score:double>>>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<gold:int,pred:int,score:double>>").alias("out")).cast(kind)

    def step(s: Column, g: Column) -> Column:
        best = F.get(F.filter(g["preds"], lambda p: ~F.array_contains(s["used"], p["p"])), 0)
        took = F.struct(g["g"].alias("gold"), F.coalesce(best["p"], F.lit(-1)).alias("pred"), F.coalesce(-best["s"], F.lit(0.0)).alias("score"))
        return F.struct(F.concat(s["used"], F.array(F.coalesce(best["p"], F.lit(-1)))).alias("used"), F.concat(s["out"], F.array(took)).alias("out")).cast(kind)

    return rows.select(*key, F.inline(F.aggregate("golds", start, step, lambda s: s["out"])))


def shape_bonus(cell_f1: Column, same_shape: Column) -> Column:
    return cell_f1 + F.when(same_shape, 0.05).otherwise(0.0)


def matched_boxes(pairs: DataFrame, key: list[str], gold: str = "gold", pred: str = "pred", value: str = "iou", least: float = 0.5) -> DataFrame:
    """key, gold, pred, iou: pairs by falling IoU, each box once; of equals the later boxes first."""
    kind = "struct<g:array<bigint>,p:array<bigint>,out:array<struct<gold:bigint,pred:bigint,iou:double>>>"
    own = F.struct((-F.col(value)).alias("s"), (-F.col(pred)).cast("bigint").alias("p"), (-F.col(gold)).cast("bigint").alias("g"))
    rows = pairs.where(F.col(value) >= least).groupBy(*key).agg(F.array_sort(F.collect_list(own)).alias("pairs"))
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("g"), none.alias("p"), F.array().cast("array<struct<gold:bigint,pred:bigint,iou:double>>").alias("out")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        free = ~F.array_contains(s["g"], -x["g"]) & ~F.array_contains(s["p"], -x["p"])
        both = F.struct((-x["g"]).alias("gold"), (-x["p"]).alias("pred"), (-x["s"]).alias("iou"))
        return F.when(free, F.struct(F.concat(s["g"], F.array(-x["g"])).alias("g"), F.concat(s["p"], F.array(-x["p"])).alias("p"), F.concat(s["out"], F.array(both)).alias("out")).cast(kind)).otherwise(s)

    return rows.select(*key, F.inline(F.aggregate("pairs", start, step, lambda s: s["out"])))


def box_detection(matches: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """key, tp, fp, fn, precision, recall, f1 from matched boxes and (key, want, got, has_boxes); documents of which a gold box is missing are judged by counts."""
    hits = matches.groupBy(*key).agg(F.count("*").alias("_hits"))
    w, g = F.col("want"), F.col("got")
    tp = F.when(F.col("has_boxes"), F.coalesce("_hits", F.lit(0))).otherwise(F.least(w, g))
    rows = counts.join(hits, key, "left").select(*key, w, g, tp.cast("bigint").alias("tp")).withColumn("fp", g - F.col("tp")).withColumn("fn", w - F.col("tp"))
    none = (w == 0) & (g == 0)
    p = F.when(none, 1.0).otherwise(share(F.col("tp").cast("double"), g))
    r = F.when(w == 0, 1.0).otherwise(share(F.col("tp").cast("double"), w))
    return rows.select(*key, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def overall(parts: dict[str, tuple[Column, float]]) -> Column:
    """The weighted mean of the scores that there are; null without any.

    Weights are decimals, so 0.4 and 0.2 make 0.6, and so are products with decimal or whole scores; terms add up from the left.
    """
    exact = lambda w: F.lit(Decimal(str(w)))
    weights = [F.when(c.isNotNull(), exact(w)).otherwise(exact(0)) for c, w in parts.values()]
    total = [F.coalesce((c * exact(w)).cast("double"), F.lit(0.0)) for c, w in parts.values()]
    weight = reduce(add, weights)
    return F.when(weight > 0, reduce(add, total) / weight.cast("double"))


# Suites


def count_verdicts(df: DataFrame, want: str = "want", got: str = "got", tolerance: str = "tolerance") -> DataFrame:
    """df with passed: the count is right within the document's tolerance; null where none is expected."""
    return df.withColumn("passed", F.when(F.col(want).isNotNull(), F.abs(F.col(got) - F.col(want)) <= F.coalesce(F.col(tolerance), F.lit(0))))


def false_positive_suite(df: DataFrame, by: list[str], want: str = "want", got: str = "got", tolerance: str = "tolerance") -> DataFrame:
    """Per suite its documents, how many pass and fail, and the share; strict suites have no tolerance."""
    rows = count_verdicts(df, want, got, tolerance)
    ok = F.coalesce(F.col("passed"), F.lit(False))
    return rows.groupBy(*by).agg(F.count("*").alias("n_docs"), F.count_if(ok).alias("n_pass"), F.count_if(~ok).alias("n_fail"), F.avg(ok.cast("double")).alias("pass_rate"))


def micro_detection(df: DataFrame, by: list[str], want: str = "want", got: str = "got") -> DataFrame:
    """Precision and recall of counts summed over the documents with an expected number."""
    rows = count_scores(df.where(F.col(want).isNotNull()), want, got)
    sums = rows.groupBy(*by).agg(F.count("*").alias("n_docs"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    whole = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(1.0)
    p, r = whole("tp", "fp"), whole("tp", "fn")
    return sums.select(*by, "n_docs", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def structure_means(scores: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Scores of pages to means of documents, then to the mean over documents, each of one weight."""
    docs = scores.groupBy(*by, "doc_id").agg(*[F.avg(v).alias(v) for v in values])
    return docs.groupBy(*by).agg(F.count("*").alias("n_docs"), *[F.avg(v).alias(v) for v in values])


def cell_recall(tokens: Column, rows: Column) -> Column:
    """struct(recall, rows, mean_chars): the share of expected cells among the cells found, in any place, and what the cells are like."""

    def of(found: Column) -> Column:
        sums = F.aggregate(found, F.lit(0), lambda s, c: s + F.length(c))
        recall = F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.exists(found, lambda c: F.contains(c, t)))) / F.size(tokens))
        return F.struct(recall.alias("recall"), F.size(rows).alias("rows"), F.when(F.size(found) > 0, sums / F.size(found)).otherwise(0.0).alias("mean_chars"))

    return F.transform(F.array(F.filter(F.flatten(rows), lambda c: F.trim(c) != "")), of)[0]


def likeness(pairs: DataFrame, want: str = "want", got: str = "got") -> DataFrame:
    """pairs with teds: how alike two grids (array<array<string>>) are, the matched blocks of their cells times the likeness of their shapes.

    Matching blocks is no SQL: an Arrow kernel over rows, without a shuffle.
    """
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [grid_likeness(w or [], g or []) for w, g in zip(b.column(want).to_pylist(), b.column(got).to_pylist())]
            yield pa.record_batch([*b.columns, pa.array(made, pa.float64())], names=[*b.schema.names, "teds"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("teds", DoubleType())]))


def grid_likeness(want: list[list[str]], got: list[list[str]]) -> float:
    from difflib import SequenceMatcher

    flat = lambda grid: [" ".join((c or "").split()).lower() for row in grid for c in row]
    a, b = flat(got), flat(want)
    if not a and not b:
        return 1.0
    size = lambda grid: (len(grid), max(map(len, grid), default=0))
    (r, c), (s, d) = size(got), size(want)
    return SequenceMatcher(None, a, b).ratio() * (1 - (abs(r - s) + abs(c - d)) / (r + c + s + d + 1))


def page_zip(want: DataFrame, got: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Tables of a page paired in their order: key, ord, want, got (either null) from (key, ord, grid)."""
    return want.select(*key, order, F.col("grid").alias("want")).join(got.select(*key, order, F.col("grid").alias("got")), [*key, order], "full_outer")


def region_grids(xml: Column) -> Column:
    """Grids of a ground-truth file's regions: array<struct<page, cells array<struct<row, col, text>>>>; the text of a cell has one space between words."""
    schema = "region array<struct<_page:int,cell:array<struct<`_start-row`:int,`_start-col`:int,content:string>>>>"
    tables = F.from_xml(F.concat(F.lit("<r>"), F.array_join(F.regexp_extract_all(xml, F.lit(r"(?s)(<region.*?</region>)"), F.lit(1)), ""), F.lit("</r>")), schema, {"rowTag": "r"})
    one = lambda c: F.struct(F.coalesce(c["_start-row"], F.lit(0)).alias("row"), F.coalesce(c["_start-col"], F.lit(0)).alias("col"), F.trim(F.regexp_replace(F.coalesce(c["content"], F.lit("")), r"\s+", " ")).alias("text"))
    return F.transform(tables["region"], lambda r: F.struct(F.coalesce(r["_page"], F.lit(1)).alias("page"), F.transform(r["cell"], one).alias("cells")))


#: Suites as (tiers, names that make a document of another tier one of it).
SUITES: dict[str, tuple[tuple[str, ...], bool]] = {
    "regression": (("basic", "stress", "hard"), False),
    "regression_with_real": (("basic", "stress", "hard", "real"), False),
    "regression_hard": (("hard",), True),
    "regression_precision": (("hard_precision",), True),
    "regression_sensing": (("hard_sensing",), True),
    "regression_compete": (("compete", "compete_hard", "compete_real"), True),
    "regression_compete_hard": (("compete_hard",), False),
    "regression_grid_gold": (("basic", "stress", "hard", "hard_precision"), False),
    "regression_basic_stress": (("basic", "stress"), False),
}


def in_suite(suite: str | None, tier: str | None = None) -> Column:
    """Whether a document (tier, suite, has_grids, banned) is one of a suite and a tier; banned ones never are. An unknown suite is a tier."""
    own = F.coalesce(F.col("tier"), F.lit("basic"))
    test = ~F.coalesce(F.col("banned"), F.lit(False))
    if tier:
        test = test & (own == tier)
    if suite and suite != "all":
        tiers, named = SUITES.get(suite, ((suite,), False))
        one = own.isin(*tiers)
        test = test & (one | (F.coalesce(F.col("suite"), F.lit("")) == suite) if named else one)
        if suite == "regression_grid_gold":
            test = test & F.coalesce(F.col("has_grids"), F.lit(False))
    return test


def gold_faults(gold: DataFrame, key: list[str]) -> DataFrame:
    """key, fault: a row per fault of gold documents (track, status, tables array<struct<n_cells, has_box, page>>)."""
    faults = F.concat(
        F.array_compact(
            F.array(
                F.when(F.coalesce(F.col("track"), F.lit("real_structure")) != "real_structure", "wrong track"),
                F.when(F.col("status").isin("needs_human_review", "draft", "auto"), "not reviewed"),
                F.when(F.coalesce(F.size("tables"), F.lit(0)) <= 0, "no tables"),
            )
        ),
        F.flatten(
            F.transform(
                F.coalesce(F.col("tables"), F.array().cast(gold.schema["tables"].dataType)),
                lambda t, i: F.array_compact(
                    F.array(
                        F.when(F.coalesce(t["n_cells"], F.lit(0)) <= 0, F.concat(F.lit("table "), i.cast("string"), F.lit(": no cells"))),
                        F.when(~F.coalesce(t["has_box"], F.lit(False)) & t["page"].isNull(), F.concat(F.lit("table "), i.cast("string"), F.lit(": neither box nor page"))),
                    )
                ),
            )
        ),
    )
    return gold.select(*key, F.explode(faults).alias("fault"))


def integrity(documents: DataFrame, classes: list[str], least: int = 60, easy: dict[str, float] | None = None) -> DataFrame:
    """check, value, passed: enough documents, none without grids or failure classes, every class covered, and scores not above what makes a suite too easy."""
    row = documents.agg(
        F.count("*").cast("double").alias("size"),
        F.count_if(~F.coalesce(F.col("has_grids"), F.lit(False)) | (F.coalesce(F.size("classes"), F.lit(0)) <= 0)).cast("double").alias("incomplete"),
        *[F.count_if(F.array_contains("classes", c)).cast("double").alias(f"class_{c}") for c in classes],
        *[F.avg(c).alias(f"score_{c}") for c in easy or {}],
    )
    one = lambda name, test: F.struct(F.lit(name).alias("check"), F.col(name).alias("value"), test.alias("passed"))
    tests = [one("size", F.col("size") >= least), one("incomplete", F.col("incomplete") == 0), *[one(f"class_{c}", F.col(f"class_{c}") > 0) for c in classes]]
    tests += [one(f"score_{c}", F.coalesce(F.col(f"score_{c}") < most, F.lit(True))) for c, most in (easy or {}).items()]
    return row.select(F.inline(F.array(*tests)))


def regressions(now: DataFrame, before: DataFrame, key: list[str], values: dict[str, float]) -> DataFrame:
    """key, metric, before, now: scores that fell by more than is allowed."""
    both = now.join(before.select(*key, *[F.col(v).alias(f"_b_{v}") for v in values]), key)
    rows = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(f"_b_{v}").cast("double").alias("before"), F.col(v).cast("double").alias("now"), F.lit(allowed).alias("_a")) for v, allowed in values.items()])
    return both.select(*key, F.inline(rows)).where(F.col("now") < F.col("before") - F.col("_a")).drop("_a")


def markdown(board: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row, report: the board as a Markdown table; boards are small, one row a group."""
    kinds = dict(board.dtypes)
    show = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)) if kinds[c] == "double" else F.col(c).cast("string"), F.lit("all"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[show(c) for c in columns]), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda r: r["_line"])
    return board.agg(F.concat_ws("\n", F.lit(head), F.array_join(rows, "\n")).alias("report"))
