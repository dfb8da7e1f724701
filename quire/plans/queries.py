"""Queries over the driver's tables, each with the SQL that gives the same rows.

Round trips render rows as PDF and read them back, so the SQL needs only the
rows; geometry takes a row as a box, an order as a page.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import candidates as C
from ..operators import evaluate as E
from ..operators import layout
from ..sources import corpus, pdf, render, writer
from ..sources.objects import Limits
from . import tables as T
from .options import preset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """As many partitions as the cluster runs at once: opening documents costs far more than a shuffle of their rows."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


# Round trips

_ORDERS = """
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s, printf('%.2f', o_totalprice) AS p, o_orderpriority AS r,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders
"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders."""
    o = table(spark, sf_dir, "orders")
    columns = [F.col("o_orderkey"), F.col("o_orderstatus"), F.format_string("%.2f", "o_totalprice"), F.col("o_orderpriority")]
    return spread(render.collected(o, F.col("o_custkey"), ["o_orderkey"], columns))


_PAGED = f"SELECT *, rn // {render.PER_PAGE} AS page, CASE WHEN rn < n - n % {render.PER_PAGE} THEN {render.PER_PAGE} ELSE n % {render.PER_PAGE} END AS height, unnest([0, 1, 2, 3]) AS c FROM ({_ORDERS})"


def _cells_sql(least: int) -> str:
    """Cells of every customer's pages of at least so many rows: the least that the detector takes for a table."""
    return f"""
    SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(rn % {render.PER_PAGE} AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, [k, s, p, r][c + 1] AS text FROM ({_PAGED}) WHERE height >= {least}
    """


def _cells(found: DataFrame) -> DataFrame:
    return T.cells(found).select("doc_id", "page", "row", "col", "text")


@query(_cells_sql(1))
def rt_lattice_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled tables of every customer's orders, of one row on."""
    return _cells(T.tables(render.grids(_orders(spark, sf_dir)), preset("lattice_only")))


@query(_cells_sql(1))
def rt_filled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lines drawn as thin filled boxes."""
    return _cells(T.tables(render.grids(_orders(spark, sf_dir), style="filled"), preset("lattice_only")))


@query(_cells_sql(2))
def rt_painted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lines that are only painted in an image, of which a grid needs three each way."""
    return _cells(T.tables(render.grids(_orders(spark, sf_dir), style="painted"), preset("lattice_only")))


@query(f"""
SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(CASE WHEN height = 2 THEN 0 ELSE rn % {render.PER_PAGE} END AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, string_agg([k, s, p, r][c + 1], ' ' ORDER BY rn) AS text FROM ({_PAGED}) GROUP BY 1, 2, 3, 4
""")
def rt_column_ruled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lines between columns only: rows are split by text from three lines on, so two stay one row of two lines."""
    return _cells(T.tables(render.grids(_orders(spark, sf_dir), style="columns"), preset("lattice_only")))


@query(_cells_sql(3))
def rt_network_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without lines, where a table takes three lines of text."""
    return _cells(T.tables(render.grids(_orders(spark, sf_dir), style="borderless"), preset("fast")))


@query(_cells_sql(1))
def rt_full_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled tables under the whole set of detectors, gates and the router: the other detectors add nothing to them."""
    return _cells(T.tables(render.grids(_orders(spark, sf_dir)), preset("full")))


_SUPPLIERS = "SELECT CAST(s_nationkey AS VARCHAR) AS doc_id, s_suppkey, s_name, printf('%.2f', s_acctbal) AS b, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier"


#: Rows of a report's page, high enough to fill it: four suppliers under the header.
_REPORT, _PITCH = 5, 130.0


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    rows = render.collected(s, F.col("s_nationkey"), ["s_suppkey"], [F.col("s_suppkey"), F.col("s_name"), F.format_string("%.2f", "s_acctbal")])
    return render.grids(spread(rows), ["Key", "Name", "Balance"], per_page=_REPORT, pitch=_PITCH)


_SHEETS = f"SELECT *, (rn - 1) // {_REPORT - 1} AS page FROM ({_SUPPLIERS})"
#: A document's logical tables are limited to the best eight beyond that; a report is one.
_REPORT_TSV = """'Key' || chr(9) || 'Name' || chr(9) || 'Balance' || chr(10) || string_agg(s_suppkey || chr(9) || s_name || chr(9) || b, chr(10) ORDER BY rn)"""


@query(f"""
WITH s AS ({_SUPPLIERS}), b AS (SELECT doc_id, rn, [CAST(s_suppkey AS VARCHAR), s_name, b] AS v FROM s UNION ALL SELECT DISTINCT doc_id, 0, ['Key', 'Name', 'Balance'] FROM s)
SELECT doc_id, CAST(rn AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, v[c + 1] AS text FROM (SELECT *, unnest([0, 1, 2]) AS c FROM b)
""")
def rt_stitched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's suppliers as a report with a header on each page; the logical table has it once."""
    return T.cells(T.logical(_report(spark, sf_dir), preset("auto"))).select("doc_id", "row", "col", "text")


@query(f"SELECT doc_id, CAST(page AS INTEGER) AS page, 0 AS logical, page < max(page) OVER (PARTITION BY doc_id) AS continues, page > 0 AS continued FROM (SELECT DISTINCT doc_id, page FROM ({_SHEETS}))")
def rt_stitch_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between a report's pages."""
    return T.tables(_report(spark, sf_dir), preset("auto")).select("doc_id", "page", "logical", "continues", "continued")


@query(f"SELECT doc_id, CAST(page AS INTEGER) AS page, {_REPORT_TSV} AS tsv FROM ({_SHEETS}) GROUP BY doc_id, page")
def snk_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tsv(T.tables(_report(spark, sf_dir), preset("auto"))).select("doc_id", "page", "tsv")


@query(f"""
WITH s AS ({_SHEETS}), n AS (SELECT doc_id, page, count(*) + 1 AS n, list(['"' || s_suppkey || '"', '"' || s_name || '"', '"' || b || '"'] ORDER BY rn) AS g FROM s GROUP BY ALL),
t AS (SELECT doc_id, page, '{{"ord":' || page || ',"page":' || page || ',"method":"lattice","rows":' || n || ',"cols":3,"logical":0,"grid":[["Key","Name","Balance"],' ||
      array_to_string(list_transform(g, lambda x: '[' || array_to_string(x, ',') || ']'), ',') || ']}}' AS j FROM n)
SELECT doc_id, '{{"n_tables":' || count(*) || ',"tables":[' || string_agg(j, ',' ORDER BY page) || ']}}' AS json FROM t GROUP BY doc_id
""")
def snk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's tables as JSON; the confidence, of no exact value in SQL, is left out."""
    return T.json(T.tables(_report(spark, sf_dir), preset("auto")), confidence=False)


@query(f"""
WITH s AS ({_SHEETS}), l AS (SELECT doc_id, page, CASE WHEN count(*) < 2 THEN 'Key' || chr(10) || 'Name' || chr(10) || 'Balance' || chr(10) || string_agg(s_suppkey || chr(10) || s_name || chr(10) || b, chr(10) ORDER BY rn)
       ELSE 'Key' || chr(10) || 'Name' || chr(10) || string_agg(s_suppkey || chr(10) || s_name, chr(10) ORDER BY rn) || chr(10) || 'Balance' || chr(10) || string_agg(b, chr(10) ORDER BY rn) END AS text, {_REPORT_TSV} AS tsv FROM s GROUP BY doc_id, page),
w AS (SELECT doc_id, {_REPORT_TSV} AS whole, max(page) AS last FROM s GROUP BY doc_id)
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) || chr(10) || chr(10) || string_agg(tsv, chr(10) || chr(10) ORDER BY page) || CASE WHEN last > 0 THEN chr(10) || chr(10) || whole ELSE '' END AS text
FROM l JOIN w USING (doc_id) GROUP BY doc_id, whole, last
""")
def snk_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, tables of pages, and logical tables where their number differs; the runs of a row are far apart, so each is a line, and of two rows on the page reads as two columns."""
    return T.document_text(_report(spark, sf_dir), preset("auto"))


@query(f"SELECT doc_id, CAST(page AS INTEGER) AS page, 1 AS n_tables, 1 AS n_lattice, 0 AS n_hybrid, 0 AS n_network, count(*) + 1 AS n_rows FROM ({_SHEETS}) GROUP BY ALL")
def snk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.split_part(F.split_part(F.element_at("tables", 1), F.lit(" "), F.lit(2)), F.lit("x"), F.lit(1)).cast("long")
    return T.evidence(T.tables(_report(spark, sf_dir), preset("auto"))).select("doc_id", "page", "n_tables", "n_lattice", "n_hybrid", "n_network", rows.alias("n_rows"))


_ITEMS = """
SELECT CAST(item_id AS VARCHAR) AS doc_id, i, array_to_string(w[8 * i + 1:8 * i + 8], ' ') AS line
FROM (SELECT item_id, w, unnest(range((len(w) + 7) // 8)) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark))
"""


def _lines(spark: SparkSession, sf_dir: str, each: int = 8) -> DataFrame:
    """Benchmark items in lines of so many words."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), w.alias("w"))
    lines = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / each).cast("int") - 1, F.lit(0))), lambda i: F.array_join(F.slice(F.col("w"), i * each + 1, F.lit(each)), " "))
    return spread(items.select("doc_id", lines.alias("lines")))


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.prose(_lines(spark, sf_dir))


@query(f"WITH l AS ({_ITEMS}) SELECT doc_id, CAST(i // 44 AS INTEGER) AS page, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY ALL")
def rt_word_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word drawn on its own: spaces come back from the gaps."""
    return T.text(render.words(_lines(spark, sf_dir)))


@query(f"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark), l AS (SELECT CAST(item_id AS VARCHAR) AS doc_id, i, array_to_string(w[2 * i + 1:2 * i + 2], ' ') AS line FROM (SELECT item_id, w, unnest(range((len(w) + 1) // 2)) AS i FROM w)),
p AS (SELECT doc_id, i // {render.COLUMN_LINES} AS page, i % {render.COLUMN_LINES} AS k, line, count(*) OVER (PARTITION BY doc_id, i // {render.COLUMN_LINES}) AS n FROM l)
SELECT doc_id, CAST(page AS INTEGER) AS page, string_agg(line, chr(10) ORDER BY CASE WHEN n >= {render.COLUMN_LEAST} THEN k % 2 ELSE 0 END, k) AS text FROM p GROUP BY ALL
""")
def rt_column_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns drawn row by row read one after the other."""
    return T.text(render.columns(_lines(spark, sf_dir, 2)))


@query(f"WITH l AS ({_ITEMS}) SELECT doc_id, CAST(i // 44 AS INTEGER) AS page, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY ALL")
def rt_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as prose, read back in reading order."""
    return T.text(_prose(spark, sf_dir))


@query(f"WITH l AS ({_ITEMS}) SELECT doc_id, CAST(i // 44 AS INTEGER) AS page, string_agg(line, '' ORDER BY i) AS text FROM l GROUP BY ALL")
def rt_paint_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paint_text(pdf.relation(pdf.extract(_prose(spark, sf_dir), ("runs",)), "runs"))


@query(f"WITH l AS ({_ITEMS}) SELECT doc_id, CAST(i // 44 AS INTEGER) AS page, CAST(i % 44 AS INTEGER) AS ord, line AS text, CAST(72 AS DOUBLE) AS x0, CAST(740 - 16 * (i % 44) - 2 AS DOUBLE) AS y0, CAST(10 AS DOUBLE) AS font_size FROM l")
def src_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned runs as drawn."""
    return pdf.relation(pdf.extract(_prose(spark, sf_dir), ("runs",)), "runs").select("doc_id", "page", "ord", "text", F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"), F.round("font_size", 6).alias("font_size"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_regionkey").cast("string").alias("doc_id"), F.col("r_name").alias("title")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return render.objects(named)


@query("SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, 0 AS page, 'https://example.com/' || n_name AS uri FROM nation")
def obj_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.relation(pdf.extract(_regions(spark, sf_dir), ("objects",)), "links")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, n_name || '=' || lower(n_name) AS label FROM nation")
def obj_form_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.relation(pdf.extract(_regions(spark, sf_dir), ("objects",)), "fields").select("doc_id", F.concat_ws("=", "name", "value").alias("label"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INTEGER) AS ord, n_name AS title FROM nation")
def obj_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.outline(pdf.extract(_regions(spark, sf_dir), ("objects",)))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS doc_id, 0 AS page, 'Im0' AS name, 2 AS width, 2 AS height FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def obj_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.relation(pdf.extract(_regions(spark, sf_dir), ("objects",)), "images")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS doc_id, 1 AS n_pages, '1.4' AS version, r_name AS title, 0 AS rotation FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def snk_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.info(_regions(spark, sf_dir)).select("doc_id", "n_pages", "version", "title", F.element_at("rotations", 1).alias("rotation"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS doc_id, 'not_pdf' AS code, 'no header' AS message FROM region")
def src_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be read is a row."""
    junk = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("doc_id"), F.encode("r_name", "utf-8").alias("content"))
    return pdf.errors(pdf.extract(junk))


_WAYS = (("Flate",), ("FlateUp",), ("ASCIIHex",), ("ASCII85",), ("RunLength",), ("LZW",), ("ASCIIHex", "Flate"), ("ASCII85", "LZW"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("name"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, n_name AS text FROM nation")
def src_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in streams of every filter, predictors and chains."""

    def draw(r: dict) -> bytes:
        p = writer.Page()
        p.text(72, 700, r["name"])
        return writer.document([p], filters=_WAYS[r["k"] % len(_WAYS)])

    return T.text(render.drawn(_nations(spark, sf_dir), draw)).select("doc_id", "text")


@query("""
WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 2, n_nationkey) - 1 AS page FROM nation)
SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, CAST(page AS INTEGER) AS page, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 270 ELSE n_nationkey % 2 * 90 END AS INTEGER) AS rotate, CAST(400 AS DOUBLE) AS x1, CAST(300 AS DOUBLE) AS y1, n_name AS text FROM n
""")
def src_page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a nested tree: box, fonts and rotation are inherited, or a page's own; content is in two streams."""

    def draw(r: dict) -> bytes:
        own = lambda odd: [(n["name"], 270 if n["k"] % 3 == 0 else None) for n in r["names"] if n["k"] % 2 == odd]
        return writer.nested([(0, own(0)), (90, own(1))])

    names = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("name")))).alias("names"))
    got = pdf.extract(render.drawn(names, draw), ("runs",))
    return pdf.relation(got, "pages").join(pdf.relation(got, "runs").select("doc_id", "page", "text"), ["doc_id", "page"]).select("doc_id", "page", "rotate", "x1", "y1", "text")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, CAST(i AS INTEGER) AS ord, n_name AS text, round(50 + len(n_name) * CAST([4.5, 6, 7][i + 1] AS DOUBLE), 4) AS x1, CAST(1 AS DOUBLE) AS sure FROM (SELECT *, unnest([0, 1, 2]) AS i FROM nation)")
def fnt_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under codes of their own: glyph names, a two-byte font and a one-byte font with maps to Unicode; the widths of each."""
    runs = pdf.relation(pdf.extract(render.drawn(_nations(spark, sf_dir), lambda r: writer.in_fonts(r["name"])), ("runs",)), "runs")
    return runs.select("doc_id", "ord", "text", F.round("x1", 4).alias("x1"), F.col("mapping_confidence").alias("sure"))


@query("""
WITH s AS (SELECT s_nationkey, s_suppkey % 4 AS kind, 20.0 + s_suppkey % 200 AS l, 750 - 6.0 * (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) AS y FROM supplier),
d AS (SELECT *, unnest(range(0, CAST(ceil(l / 15) AS BIGINT))) AS k FROM s WHERE kind = 2)
SELECT CAST(s_nationkey AS VARCHAR) AS doc_id, CAST(50 AS DOUBLE) AS x0, CAST(50 + l AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y, 'stroke' AS source FROM s WHERE kind = 0
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 50, 50 + l, y + 0.5, 'fill' FROM s WHERE kind = 1
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 50 + 15 * k, 50 + least(15 * k + 10, l), y, 'dash' FROM d WHERE least(15 * k + 10, l) - 15 * k >= 1
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 50, 50 + least(l, 70), y, 'stroke' FROM s WHERE kind = 3
""")
def cnt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's suppliers as lines: stroked, thin and filled, dashed, and clipped."""

    def draw(r: dict) -> bytes:
        p = writer.Page(height=20_000)
        for i, key in enumerate(r["keys"]):
            y, long = 750 - 6.0 * i, 20.0 + key % 200
            if key % 4 == 1:
                p.bar(50, y, long, 1)
                continue
            before = {0: b"q", 2: b"q [10 5] 0 d", 3: b"q 0 -20000 120 40000 re W n"}[key % 4]
            p.raw(before)
            p.line(50, y, 50 + long, y)
            p.raw(b"Q")
        return writer.document([p])

    keys = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
    rules = pdf.relation(pdf.extract(render.drawn(keys, draw), ("rules",)), "rules")
    return rules.select("doc_id", F.round("x0", 4).alias("x0"), F.round("x1", 4).alias("x1"), F.round("y0", 4).alias("y"), "source")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, ['encrypted', 'not_pdf', 'limit_file_bytes', 'limit_ratio'][n_nationkey % 5] AS code FROM nation WHERE n_nationkey % 5 > 0")
def src_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are read, encrypted, no PDF, too long, or too much longer once inflated: a code each."""

    def draw(r: dict) -> bytes:
        p, kind = writer.Page(), r["k"] % 5
        p.text(72, 700, r["name"])
        if kind == 2:
            return r["name"].encode()
        if kind == 3:
            p.raw(b"% " + bytes(range(33, 90)) * 3000)
        if kind == 4:
            p.raw(b" " * 400_000)
        return writer.document([p], compress=kind != 3, encrypt=kind == 1)

    limits = Limits(file_bytes=100_000, ratio=100)
    got = pdf.extract(render.drawn(_nations(spark, sf_dir), draw), ("runs",), limits)
    # A page that can't be read is a warning of a document whose other pages are.
    of_pages = pdf.relation(got, "warnings").where(F.col("message").rlike("[0-9]+ bytes to [0-9]+")).select("doc_id", F.lit("limit_ratio").alias("code"))
    return pdf.errors(got).select("doc_id", "code").unionByName(of_pages)


# Geometry: a line item is a box, its order a page

_BOXES = """
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, 0 AS page, rn AS id, x0, y0, x0 + 20 + l_quantity * 4 AS x1, y0 + 10 + l_linenumber * 12 AS y1, method, conf, CAST(3 + rn AS INTEGER) AS "rows"
FROM (SELECT *, CAST(l_partkey % 300 AS DOUBLE) AS x0, CAST(l_suppkey % 40 * 15 AS DOUBLE) AS y0, CASE l_returnflag WHEN 'R' THEN 'lattice' WHEN 'A' THEN 'hybrid' ELSE 'network' END AS method, l_discount * 10 AS conf,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn FROM lineitem)
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    x0, y0 = (F.col("l_partkey") % 300).cast("double"), (F.col("l_suppkey") % 40 * 15).cast("double")
    return li.select(
        F.col("l_orderkey").cast("string").alias("doc_id"),
        F.lit(0).alias("page"),
        "id",
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 20 + F.col("l_quantity") * 4).alias("x1"),
        (y0 + 10 + F.col("l_linenumber") * 12).alias("y1"),
        F.when(F.col("l_returnflag") == "R", "lattice").when(F.col("l_returnflag") == "A", "hybrid").otherwise("network").alias("method"),
        (F.col("l_discount") * 10).alias("confidence"),
        (F.col("id") + 3).alias("rows"),
    )


_I = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
_A, _B = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"
_IOU = f"({_I} / ({_A} + {_B} - {_I}))"
_XI = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0)"


@query(f"WITH x AS ({_BOXES}) SELECT a.doc_id, a.id AS a_id, b.id AS b_id, round({_IOU}, 6) AS iou, round({_I} / {_A}, 6) AS inside, round({_I} / least({_A}, {_B}), 6) AS least, round({_XI} / (a.x1 - a.x0 + b.x1 - b.x0 - {_XI}), 6) AS x_iou, round(greatest(greatest(a.y0, b.y0) - least(a.y1, b.y1), 0), 6) AS y_gap FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.id < b.id")
def geo_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = boxes(spark, sf_dir)
    a, b = G.Box.of("a_"), G.Box.of("b_")
    six = lambda c, n: F.round(c, 6).alias(n)
    return C.pairs(x, x).where("a_id < b_id").select("doc_id", "a_id", "b_id", six(G.iou(a, b), "iou"), six(G.containment(a, b), "inside"), six(G.least_area_overlap(a, b), "least"), six(G.x_iou(a, b), "x_iou"), six(G.y_gap(a, b), "y_gap"))


@query(f"WITH x AS ({_BOXES}) SELECT a.doc_id, a.id AS c_id, b.id AS p_id FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.id <> b.id WHERE {_I} / {_A} >= 0.85 AND {_A} / ({_B}) BETWEEN 0.03 AND 0.55 AND {_A} >= 2500 AND a.x1 - a.x0 >= 36 AND a.y1 - a.y0 >= 36")
def geo_nested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.nested_pairs(boxes(spark, sf_dir), "id").select("doc_id", "c_id", "p_id")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY l_orderkey")
def geo_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(G.upper_median(F.collect_list("l_quantity"), 12.0).alias("median"))


@query("""
WITH RECURSIVE s AS (SELECT o_custkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS k FROM orders),
f AS (SELECT o_custkey, k, x AS m, 1 AS n, 1 AS c FROM s WHERE k = 1
      UNION ALL SELECT s.o_custkey, s.k, CASE WHEN abs(s.x - f.m) <= 20000 THEN (f.m * f.n + s.x) / (f.n + 1) ELSE s.x END, CASE WHEN abs(s.x - f.m) <= 20000 THEN f.n + 1 ELSE 1 END, CASE WHEN abs(s.x - f.m) <= 20000 THEN f.c ELSE f.c + 1 END
      FROM f JOIN s ON s.o_custkey = f.o_custkey AND s.k = f.k + 1)
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, c AS cluster, round(arg_max(m, k), 5) AS centre FROM f GROUP BY ALL
""")
def geo_cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running-mean clusters of each customer's order prices."""
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("doc_id")).agg(G.cluster_1d(F.collect_list("o_totalprice"), 20000.0).alias("m"))
    return c.select("doc_id", F.posexplode("m").alias("k", "m")).select("doc_id", (F.col("k") + 1).alias("cluster"), F.round("m", 5).alias("centre"))


@query("""
SELECT doc_id, round(greatest(0, 1 - 0.5 * stddev_pop(g) / avg(g)), 6) AS regularity
FROM (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM orders) GROUP BY doc_id HAVING count(g) >= 2
""")
def geo_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("doc_id")).agg(F.collect_list(F.col("o_orderkey").cast("double")).alias("e"))
    return e.where(F.size("e") >= 3).select("doc_id", F.round(G.regularity(F.col("e")), 6).alias("regularity"))


@query("""
SELECT o_orderkey, rotate, CASE rotate WHEN 90 THEN y WHEN 180 THEN 612 - x WHEN 270 THEN 792 - y ELSE x END AS ux, CASE rotate WHEN 90 THEN 612 - x WHEN 180 THEN 792 - y WHEN 270 THEN x ELSE y END AS uy
FROM (SELECT o_orderkey, o_orderkey % 4 * 90 AS rotate, CAST(o_custkey % 612 AS DOUBLE) AS x, CAST(o_orderkey % 792 AS DOUBLE) AS y FROM orders)
""")
def lay_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4 * 90).alias("rotate"), (F.col("o_custkey") % 612).cast("double").alias("x"), (F.col("o_orderkey") % 792).cast("double").alias("y"))
    page = G.Box(F.lit(0.0), F.lit(0.0), F.lit(612.0), F.lit(792.0))
    x, y = G.turned(F.col("x"), F.col("y"), page, F.col("rotate"))
    return o.select("o_orderkey", "rotate", x.alias("ux"), y.alias("uy"))


# Predicates

_TOKENS = "SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS t FROM documents) WHERE t <> ''"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("t")).where("t <> ''")


@query(f"""
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(t, '[0-9]')) AS with_digit, count(*) FILTER (WHERE regexp_matches(t, '^[0-9.,+\\- ]+$') AND regexp_matches(t, '[0-9]')) AS number_only,
       count(*) FILTER (WHERE len(regexp_replace(regexp_replace(t, '[$%(),]', '', 'g'), '[^0-9]', '', 'g')) >= greatest(1, len(regexp_replace(regexp_replace(t, '[$%(),]', '', 'g'), '\\P{{L}}', '', 'g')))) AS digit_led,
       count(*) FILTER (WHERE regexp_matches(t, '^([-–—]|[(+-]*[$€£]?\\s*[0-9][0-9,. ]*%?\\)?)$')) AS numberish FROM ({_TOKENS}) GROUP BY doc_id
""")
def prd_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions of a numeric token, counted per document."""
    t = F.col("t")
    return _tokens(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(G.has_digit(t)).alias("with_digit"), F.count_if(G.number_only(t)).alias("number_only"), F.count_if(G.digit_led(t)).alias("digit_led"), F.count_if(G.numberish(t)).alias("numberish"))


@query(f"SELECT doc_id, round(avg(len(t)), 6) AS mean_chars, round(avg(strlen(t)), 6) AS mean_bytes, round(avg(len(regexp_replace(t, '[^.,;:!?]', '', 'g')) / len(t)), 6) AS punctuation, round(avg(len(regexp_replace(t, '[^0-9a-fA-F]', '', 'g')) / len(t)), 6) AS hex FROM ({_TOKENS}) GROUP BY doc_id")
def prd_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return _tokens(spark, sf_dir).groupBy("doc_id").agg(mean(F.length(t), "mean_chars"), mean(F.octet_length(t), "mean_bytes"), mean(G.punctuation_share(t), "punctuation"), mean(G.hex_share(t), "hex"))


# Candidates


@query(f"WITH x AS ({_BOXES}) SELECT a.doc_id, a.id FROM x a WHERE a.method = 'hybrid' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND b.method = 'lattice' AND ({_I} / {_A} >= 0.5 OR {_I} / ({_B}) >= 0.5 OR {_IOU} >= 0.4))")
def rel_anti_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = boxes(spark, sf_dir)
    return C.without_covered(x.where("method = 'hybrid'"), x.where("method = 'lattice'")).select("doc_id", "id")


@query(f"WITH x AS ({_BOXES}) SELECT a.doc_id, a.id FROM x a WHERE a.method = 'network' AND EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND b.method = 'lattice' AND ({_I} / least({_A}, {_B}) >= 0.4 OR {_IOU} >= 0.35))")
def rel_overlaps_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = boxes(spark, sf_dir)
    return C.overlaps_any(x.where("method = 'network'"), x.where("method = 'lattice'")).select("doc_id", "id")


@query(f"WITH x AS ({_BOXES}) SELECT doc_id, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY conf DESC, y1 DESC, x0, id) AS k FROM x) WHERE k <= 3")
def rel_topk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_of_page(boxes(spark, sf_dir), 3, F.desc("confidence"), F.desc("y1"), F.asc("x0"), F.asc("id")).select("doc_id", "id")


@query(f"WITH x AS ({_BOXES}) SELECT a.doc_id, a.id AS a_id, b.id AS b_id FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.id <> b.id AND a.y1 > b.y1 WHERE {_XI} / (a.x1 - a.x0 + b.x1 - b.x0 - {_XI}) >= 0.6 AND greatest(greatest(a.y0, b.y0) - least(a.y1, b.y1), 0) <= 18")
def rel_stackable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stackable(boxes(spark, sf_dir), "id").select("doc_id", "a_id", "b_id")


@query(f"""WITH x AS ({_BOXES}), w AS (SELECT *, count(*) OVER p AS n, max((x1 - x0) * (y1 - y0)) OVER p AS a, max("rows") OVER p AS r FROM x WINDOW p AS (PARTITION BY doc_id, page))
SELECT doc_id, id FROM w WHERE n < 3 OR (x1 - x0) * (y1 - y0) >= 0.45 * a OR "rows" >= 0.70 * r""")
def rel_prune_subordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prune_subordinate(boxes(spark, sf_dir)).select("doc_id", "id")


@query(f"WITH x AS ({_BOXES}) SELECT doc_id, id FROM x WHERE conf >= CASE method WHEN 'lattice' THEN 0.45 WHEN 'hybrid' THEN 0.5 ELSE 0.62 END")
def rel_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.above_floor(boxes(spark, sf_dir), {"lattice": 0.45, "hybrid": 0.5, "network": 0.62}).select("doc_id", "id")


_FRAGMENTS = """
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) // 2 AS INTEGER) AS page, o_orderkey AS id, 2 + o_orderkey % 3 AS cols,
       CAST(o_orderkey % 600 AS DOUBLE) AS y0, CAST(o_orderkey % 600 + 150 AS DOUBLE) AS y1 FROM orders
"""


@query(f"WITH f AS ({_FRAGMENTS}) SELECT a.doc_id, b.page, a.id AS a_id, b.id AS b_id FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.page = a.page + 1 AND a.cols = b.cols WHERE (a.y0 < 0.3 * 792 OR (a.y0 + a.y1) / 2 < 0.45 * 792) AND (b.y1 > 0.7 * 792 OR (b.y0 + b.y1) / 2 > 0.55 * 792)")
def win_stitch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    y = (F.col("o_orderkey") % 600).cast("double")
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.floor(F.row_number().over(w) / 2).cast("int").alias("page"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 + 2).alias("cols"), y.alias("y0"), (y + 150).alias("y1"))
    return C.adjacent_pages(f).select("doc_id", "page", "a_id", "b_id")


# Evaluation


@query("SELECT p_partkey, round(levenshtein(trim(p_name), trim(p_type)) / len(trim(p_name)), 6) AS cer FROM part")
def evl_character_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(E.character_error(F.col("p_name"), F.col("p_type")), 6).alias("cer"))


@query("""
SELECT conv_id, turn, CASE WHEN len(t) = 0 THEN CAST(1 AS DOUBLE) ELSE round(len(list_filter(t, lambda x: contains(lower(u), lower(x)))) / len(t), 6) END AS recall
FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) AS u, list_filter(regexp_split_to_array(lead(text, 1, text) OVER (PARTITION BY conv_id ORDER BY turn), '\\s+'), lambda x: x <> '') AS t FROM conversations)
""")
def evl_token_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of the next turn a turn has."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text", 1).over(Window.partitionBy("conv_id").orderBy("turn")))
    words = F.filter(F.split(F.coalesce("next", "text"), r"\s+"), lambda x: x != "")
    return c.select("conv_id", "turn", F.round(E.token_recall(F.col("text"), words), 6).alias("recall"))


_GRID = "SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, o_orderkey, o_orderpriority AS t FROM orders"


@query(f"""
WITH g AS ({_GRID}), w AS (SELECT k, r, t FROM g WHERE o_orderkey % 11 <> 0), p AS (SELECT k, r, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE upper(t) END AS t FROM g WHERE o_orderkey % 13 <> 0),
j AS (SELECT coalesce(w.k, p.k) AS k, w.t AS a, p.t AS b, lower(w.t) = lower(p.t) AS hit FROM w FULL JOIN p ON w.k = p.k AND w.r = p.r),
s AS (SELECT k, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE a IS NULL) AS fp, count(*) FILTER (WHERE a IS NOT NULL AND NOT coalesce(hit, false)) AS fn FROM j GROUP BY k)
SELECT k, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 OR tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM s
""")
def evl_cell_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of order priorities against one with cells missing, changed and in capitals."""
    from pyspark.sql import Window

    g = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("row"), F.lit(0).alias("col"), "o_orderkey", F.col("o_orderpriority").alias("text"))
    got = g.where("o_orderkey % 13 <> 0").withColumn("text", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.upper("text")))
    return E.cell_scores(g.where("o_orderkey % 11 <> 0"), got, ["k"]).select("k", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query("SELECT o_custkey, want, got, least(want, got) AS tp, greatest(got - want - 1, 0) AS fp, greatest(want - got - 1, 0) AS fn FROM (SELECT o_custkey, count(*) AS want, count(*) FILTER (WHERE o_orderstatus <> 'F') + 2 AS got FROM orders GROUP BY o_custkey)")
def evl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("want"), (F.count_if(F.col("o_orderstatus") != "F") + 2).alias("got"))
    return E.count_scores(c, "want", "got", 1)


@query("""
SELECT user_id, CASE WHEN len(g) = 0 THEN CAST(0 AS DOUBLE) ELSE round(len(list_intersect(w, g)) / len(g), 6) END AS precision, round(len(list_intersect(w, g)) / len(w), 6) AS recall
FROM (SELECT user_id, list(DISTINCT event_type) AS w, coalesce(list(DISTINCT event_type) FILTER (WHERE value > 60), []) AS g FROM events GROUP BY user_id)
""")
def evl_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("w"), F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("g"))
    p, r, _ = E.set_scores(F.col("w"), F.col("g"))
    return s.select("user_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))


@query("""
SELECT lang, source, CAST(grouping(lang, source) AS INTEGER) AS level, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)
""")
def evl_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return E.scoreboard(s, ["lang", "source"], ["quality", "toxic"]).select("lang", "source", "level", "n", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY event_type")
def evl_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


_CELLS4 = f"SELECT doc_id, CAST(rn AS INTEGER) AS r, unnest([k, s, p, r]) AS t, unnest([0, 1, 2, 3]) AS c FROM ({_ORDERS})"
_FEATURES = f"""
SELECT doc_id, max(r) + 1 AS n_rows, 4 AS cols, 1.0 AS fill, avg(len(t)) AS chars, avg(CAST(len(regexp_replace(t, '[^0-9]', '', 'g')) >= greatest(1, len(regexp_replace(t, '\\P{{L}}', '', 'g'))) AS INTEGER)) AS num,
       avg(len(regexp_replace(t, '\\P{{L}}', '', 'g')) / len(t)) FILTER (WHERE r = 0) AS head, avg(CAST(len(regexp_replace(t, '[^0-9a-fA-F]', '', 'g')) / len(t) >= 0.9 AS INTEGER)) AS hex FROM ({_CELLS4}) GROUP BY doc_id
"""


@query(f"""
WITH f AS ({_FEATURES}), s AS (SELECT *, (0.30 * head + 0.20 * fill + 0.15 * greatest(0, least(1, 1 - abs(chars - 12) / 40)) + 0.15 * CASE WHEN num BETWEEN 0.15 AND 0.85 THEN 1 WHEN num > 0.85 THEN 0.35 ELSE 0.2 END + 0.10 + 0.10 * CASE WHEN n_rows BETWEEN 3 AND 80 THEN 1 ELSE 0.2 END)
    * (1 - 0.75 * hex) * CASE WHEN chars < 3.5 AND num > 0.7 THEN 0.35 ELSE 1 END AS d, 0.30 * (1 - num) + 0.15 * (1 - least(chars / 40, 1)) + 0.10 AS f FROM f)
SELECT doc_id, CAST(n_rows AS INTEGER) AS "rows", round(chars, 6) AS mean_chars, round(num, 6) AS "numeric", round(least(1, greatest(0, d)), 6) AS data_score, round(least(1, greatest(0, f)), 6) AS form_score FROM s
""")
def prd_table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every customer's orders as a table."""
    from ..functions import scores as S

    cells = _order_cells(spark, sf_dir)
    f = S.features(cells, ["doc_id"])
    return f.select("doc_id", "rows", F.round("mean_chars", 6).alias("mean_chars"), F.round("numeric", 6).alias("numeric"), F.round(S.data_score(), 6).alias("data_score"), F.round(S.form_score(), 6).alias("form_score"))


def _order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").withColumn("row", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    texts = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.format_string("%.2f", "o_totalprice"), F.col("o_orderpriority"))
    return o.select(F.col("o_custkey").cast("string").alias("doc_id"), "row", F.posexplode(texts).alias("col", "text"))


_COUNTS = "SELECT o_custkey, o_orderpriority, count(*) AS want, count(*) FILTER (WHERE o_orderstatus <> 'F') AS got FROM orders GROUP BY ALL"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("want"), F.count_if(F.col("o_orderstatus") != "F").alias("got"))


@query(f"""
SELECT o_orderpriority, count(*) AS n, round(avg(CAST(want = got AS INTEGER)), 6) AS exact, round(avg(CAST(got > want AS INTEGER)), 6) AS "over", round(avg(CAST(got < want AS INTEGER)), 6) AS "under", round(sum(got) / sum(want), 6) AS ratio FROM ({_COUNTS}) GROUP BY 1
""")
def evl_discipline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.detection_discipline(_counts(spark, sf_dir), ["o_orderpriority"])
    return d.select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in ("exact", "over", "under", "ratio")])


@query(f"SELECT mode, count(*) AS n FROM (SELECT CASE WHEN got = 0 THEN 'missed' WHEN got < want THEN 'under_split' END AS mode FROM ({_COUNTS})) WHERE mode IS NOT NULL GROUP BY mode")
def evl_failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.failure_modes(_counts(spark, sf_dir), ["o_custkey"]).groupBy("mode").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL), w AS (SELECT *, max(v) OVER (PARTITION BY user_id) AS best FROM s)
SELECT event_type, count(*) AS n, round(avg(v), 6) AS mean, CAST(sum(CAST(v = best AS INTEGER)) AS BIGINT) AS wins FROM w GROUP BY event_type
""")
def evl_peer_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return E.peer_board(s, "user_id", "event_type", "v").select("event_type", "n", F.round("mean", 6).alias("mean"), "wins")


@query("""
WITH v AS (SELECT o_custkey, o_orderpriority AS text, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, len(text) DESC, text DESC) AS k, count(*) OVER (PARTITION BY o_custkey) AS d, sum(n) OVER (PARTITION BY o_custkey) AS t FROM v)
SELECT o_custkey, text, d = 1 AS agreed, CAST(t AS BIGINT) AS n_votes FROM r WHERE k = 1
""")
def evl_cell_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cell_vote(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("text")), ["o_custkey"])


@query("""
SELECT gate, value, least, value >= least AS passed FROM (SELECT 'quality' AS gate, round(avg(quality), 9) AS value, CAST(0.5 AS DOUBLE) AS least FROM labels UNION ALL SELECT 'toxic', round(avg(toxic), 9), CAST(0.5 AS DOUBLE) FROM labels)
""")
def evl_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gates(table(spark, sf_dir, "labels"), {"quality": 0.5, "toxic": 0.5}).withColumn("value", F.round("value", 9))


_MEETS = f"({_I} / least({_A}, {_B}) >= 0.4 OR {_IOU} >= 0.35)"
_COVERS = f"({_I} / {_A} >= 0.5 OR {_I} / {_B} >= 0.5 OR {_IOU} >= 0.4)"


@query(f"WITH x AS ({_BOXES}) SELECT a.doc_id, a.id FROM x a WHERE a.method = 'network' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND b.method = 'lattice' AND {_MEETS} AND {_A} <= 2 * {_B})")
def rel_stream_under_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = boxes(spark, sf_dir)
    return C.without_subordinate_streams(x.where("method = 'network'"), x.where("method = 'lattice'")).select("doc_id", "id")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with columns and a fill that follow from them."""
    return boxes(spark, sf_dir).withColumn("cols", (F.col("x0") % 20).cast("int")).withColumn("fill", F.col("y0") % 10 / 10)


_SIZED = f"SELECT *, CAST(x0 % 20 AS INTEGER) AS cols, y0 % 10 / 10 AS f FROM ({_BOXES})"


@query(f"WITH x AS ({_SIZED}) SELECT a.doc_id, a.id FROM x a WHERE a.method = 'hybrid' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND b.method = 'network' AND a.cols >= 14 AND {_COVERS})")
def rel_wide_hybrids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _sized(spark, sf_dir)
    return C.without_wide_hybrids(x.where("method = 'hybrid'"), x.where("method = 'network'")).select("doc_id", "id")


@query(f"WITH x AS ({_SIZED}) SELECT a.doc_id, a.id FROM x a WHERE a.method = 'lattice' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND b.method = 'network' AND a.f < 0.35 AND b.conf >= 0.62 AND {_COVERS})")
def rel_sparse_ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _sized(spark, sf_dir)
    return C.without_sparse_ruled(x.where("method = 'lattice'"), x.where("method = 'network'")).select("doc_id", "id")


@query(f"WITH x AS ({_SIZED}) SELECT a.doc_id, a.id, round(a.conf * CASE WHEN EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND b.method = 'network' AND {_I} / {_A} >= 0.85 AND {_A} <= 0.35 * {_B} AND a.cols <= 2) THEN 0.45 ELSE 1 END, 6) AS confidence FROM x a WHERE a.method = 'lattice'")
def rel_demoted_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _sized(spark, sf_dir)
    return C.demoted_slices(x.where("method = 'lattice'"), x.where("method = 'network'")).select("doc_id", "id", F.round("confidence", 6).alias("confidence"))


@query(f"""
WITH x AS (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey AS id, o_totalprice / 500000 AS score FROM orders), r AS (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY doc_id ORDER BY score >= 0.54 DESC, score DESC, id) AS k FROM x WINDOW p AS (PARTITION BY doc_id))
SELECT doc_id, id FROM r WHERE n <= 8 OR (score >= 0.54 AND k <= 8)
""")
def win_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with more than eight tables the best eight that score enough."""
    from ..functions import scores as S

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("score"))
    return S.scrubbed(o).select("doc_id", "id")


@query("""
WITH w AS (SELECT p_partkey, string_split(trim(p_name), ' ') AS a, string_split(trim(p_type), ' ') AS b FROM part), v AS (SELECT *, list_distinct(list_concat(a, b)) AS v FROM w)
SELECT p_partkey, round(levenshtein(array_to_string(list_transform(a, lambda x: chr(CAST(64 + list_position(v, x) AS INTEGER))), ''), array_to_string(list_transform(b, lambda x: chr(CAST(64 + list_position(v, x) AS INTEGER))), '')) / len(a), 6) AS wer FROM v
""")
def evl_word_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(E.word_error(F.col("p_name"), F.col("p_type")), 6).alias("wer"))


_MATCH = """
o AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderstatus AS s, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS g FROM orders),
p AS (SELECT k, v, s, row_number() OVER (PARTITION BY k ORDER BY v, o_orderkey) - 1 AS p FROM o WHERE o_orderkey % 3 <> 0),
x AS (SELECT o.k, o.g, p.p, 1 / (1 + abs(o.v - p.v) / 100000) + CASE WHEN o.s = p.s THEN 0.05 ELSE 0 END AS score FROM o LEFT JOIN p ON o.k = p.k)
"""


@query(f"""
WITH RECURSIVE {_MATCH}, l AS (SELECT k, g, coalesce(list({{'p': p, 's': score}} ORDER BY score DESC, p) FILTER (WHERE p IS NOT NULL), []) AS ps FROM x GROUP BY k, g),
f AS (SELECT DISTINCT k, CAST(-1 AS BIGINT) AS g, CAST([] AS BIGINT[]) AS used, {{'p': CAST(-1 AS BIGINT), 's': CAST(0 AS DOUBLE)}} AS b FROM l
      UNION ALL SELECT k, g, list_append(used, b.p), b FROM (SELECT l.k, l.g, f.used, list_filter(l.ps, lambda y: NOT list_contains(f.used, y.p))[1] AS b FROM f JOIN l ON l.k = f.k AND l.g = f.g + 1))
SELECT k, CAST(g AS INTEGER) AS gold, CAST(coalesce(b.p, -1) AS INTEGER) AS pred, round(coalesce(b.s, 0), 6) AS score FROM f WHERE g >= 0
""")
def evl_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order of a customer, in order, takes the most alike that is left of those sorted by price."""
    from pyspark.sql import Window

    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"), "o_orderkey")
    gold = own.withColumn("gold", F.row_number().over(Window.partitionBy("k").orderBy("o_orderkey")) - 1)
    pred = own.where("o_orderkey % 3 <> 0").withColumn("pred", F.row_number().over(Window.partitionBy("k").orderBy("v", "o_orderkey")) - 1).select("k", F.col("v").alias("pv"), F.col("s").alias("ps"), "pred")
    score = E.shape_bonus(1 / (1 + F.abs(F.col("v") - F.col("pv")) / 100000), F.col("s") == F.col("ps"))
    pairs = gold.join(pred, "k", "left").select("k", "gold", "pred", score.alias("score"))
    return E.assigned(pairs, ["k"]).select("k", "gold", "pred", F.round("score", 6).alias("score"))


@query(f"""
WITH RECURSIVE x AS ({_BOXES}), c AS (SELECT doc_id, count(*) FILTER (WHERE id % 2 = 1) AS want, count(*) FILTER (WHERE id % 2 = 0) AS got FROM x GROUP BY doc_id),
i AS (SELECT a.doc_id, a.id AS g, b.id AS p, {_IOU} AS iou FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.id % 2 = 1 AND b.id % 2 = 0),
l AS (SELECT doc_id, list({{'g': g, 'p': p}} ORDER BY iou DESC, p DESC, g DESC) AS ps FROM i WHERE iou >= 0.5 GROUP BY doc_id),
f AS (SELECT doc_id, 0 AS k, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS us FROM l
      UNION ALL SELECT f.doc_id, k + 1, CASE WHEN list_contains(gs, ps[k + 1].g) OR list_contains(us, ps[k + 1].p) THEN gs ELSE list_append(gs, ps[k + 1].g) END, CASE WHEN list_contains(gs, ps[k + 1].g) OR list_contains(us, ps[k + 1].p) THEN us ELSE list_append(us, ps[k + 1].p) END
      FROM f JOIN l ON f.doc_id = l.doc_id WHERE k < len(ps)),
h AS (SELECT doc_id, max(len(gs)) AS n FROM f GROUP BY doc_id), t AS (SELECT c.doc_id, want, got, coalesce(n, 0) AS tp FROM c LEFT JOIN h ON c.doc_id = h.doc_id)
SELECT doc_id, tp, got - tp AS fp, want - tp AS fn, round(CASE WHEN got = 0 THEN 0 ELSE tp / got END, 6) AS precision, round(tp / want, 6) AS recall FROM t
""")
def evl_box_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd boxes of a page are expected, even ones found."""
    x = boxes(spark, sf_dir).select("doc_id", "page", "id", "x0", "y0", "x1", "y1")
    pairs = C.pairs(x.where("id % 2 = 1"), x.where("id % 2 = 0")).select("doc_id", F.col("a_id").alias("gold"), F.col("b_id").alias("pred"), G.iou(G.Box.of("a_"), G.Box.of("b_")).alias("iou"))
    counts = x.groupBy("doc_id").agg(F.count_if(F.col("id") % 2 == 1).alias("want"), F.count_if(F.col("id") % 2 == 0).alias("got"), F.lit(True).alias("has_boxes"))
    found = E.box_detection(E.matched_boxes(pairs, ["doc_id"]), counts, ["doc_id"])
    return found.select("doc_id", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 10000 END AS t, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 100 + 0.5 END AS b, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 END AS o FROM orders)
SELECT o_orderkey, round((coalesce(0.4 * t, 0) + coalesce(0.4 * b, 0) + coalesce(0.2 * o, 0)) / nullif(CASE WHEN t IS NULL THEN 0 ELSE 0.4 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END + CASE WHEN o IS NULL THEN 0 ELSE 0.2 END, 0), 5) AS overall FROM s
""")
def evl_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text, cells_, objects = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 10000), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 100 + F.lit(Decimal("0.5"))), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 100)
    score = E.overall({"text": (text, 0.4), "tables": (cells_, 0.4), "objects": (objects, 0.2)})
    # The SQL rounds the binary product; Spark's own rounding to places goes by the decimal digits, which differs where they end in 5.
    return o.select("o_orderkey", (F.round(score * 100_000) / 100_000).alias("overall"))


@query("""
SELECT event_type AS library, count(*) AS runs, count(*) FILTER (WHERE value > 10) AS successes, count(*) FILTER (WHERE value <= 10) AS failures, round(avg(user_id % 10) FILTER (WHERE value > 10), 6) AS mean_recall,
       round(avg(value) FILTER (WHERE value > 10), 6) AS mean_wall, list_sort(list(value) FILTER (WHERE value > 10))[count(*) FILTER (WHERE value > 10) // 2 + 1] AS median, round(sum(value) FILTER (WHERE value > 10), 2) AS total FROM events GROUP BY event_type
""")
def evl_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("library"), (F.col("value") > 10).alias("success"), (F.col("user_id") % 10).alias("recall"), F.col("value").alias("wall_ms"))
    return E.run_summary(runs).select("library", "runs", "successes", "failures", F.round("mean_recall", 6).alias("mean_recall"), F.round("mean_wall", 6).alias("mean_wall"), "median", F.round("total", 2).alias("total"))


@query("SELECT f, count(*) AS n_docs, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM (SELECT l_returnflag AS f, l_orderkey, avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem GROUP BY ALL) GROUP BY f")
def evl_structure_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return E.structure_means(pages, ["f"], ["a", "b"]).select("f", "n_docs", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(f"SELECT o_orderpriority, count(*) AS n_docs, count(*) FILTER (WHERE abs(got - want) <= t) AS n_pass, count(*) FILTER (WHERE abs(got - want) > t) AS n_fail, round(avg(CAST(abs(got - want) <= t AS INTEGER)), 6) AS pass_rate FROM (SELECT *, o_custkey % 3 AS t FROM ({_COUNTS})) GROUP BY 1")
def evl_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _counts(spark, sf_dir).withColumn("tolerance", F.col("o_custkey") % 3)
    return E.false_positive_suite(rows, ["o_orderpriority"]).withColumn("pass_rate", F.round("pass_rate", 6))


@query(f"""
SELECT o_orderpriority, count(*) AS n_docs, CAST(sum(least(got, want)) AS BIGINT) AS tp, CAST(sum(greatest(got - want, 0)) AS BIGINT) AS fp, CAST(sum(greatest(want - got, 0)) AS BIGINT) AS fn, round(sum(least(got, want)) / sum(got), 6) AS precision, round(sum(least(got, want)) / sum(want), 6) AS recall FROM ({_COUNTS}) GROUP BY 1
""")
def evl_micro_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.micro_detection(_counts(spark, sf_dir), ["o_orderpriority"])
    return found.select("o_orderpriority", "n_docs", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query()
def evl_icdar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of each customer's orders against those without every seventh; matching blocks are no SQL, and tests hold them against difflib."""
    cells = _order_cells(spark, sf_dir)
    rows = cells.groupBy("doc_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("r"))
    grid = lambda df: df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "r"))), lambda x: x["r"]).alias("grid")).withColumn("ord", F.lit(0))
    return E.likeness(E.page_zip(grid(rows), grid(rows.where("row % 7 <> 3")), ["doc_id"])).select("doc_id", "ord", F.round("teds", 6).alias("teds"))


@query("""
WITH g AS (SELECT o_custkey AS k, CASE o_custkey % 4 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'real_structure' END AS track, CASE o_custkey % 3 WHEN 0 THEN 'draft' ELSE 'reviewed' END AS status FROM orders GROUP BY 1),
t AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderkey % 4 AS n, o_orderkey % 5 = 0 AS has_box, o_orderkey % 7 = 0 AS no_page FROM orders WHERE o_orderstatus <> 'F')
SELECT k, 'wrong track' AS fault FROM g WHERE track = 'synthetic' UNION ALL SELECT k, 'not reviewed' FROM g WHERE status = 'draft' UNION ALL SELECT k, 'no tables' FROM g WHERE k NOT IN (SELECT k FROM t)
UNION ALL SELECT k, 'table ' || i || ': no cells' FROM t WHERE n = 0 UNION ALL SELECT k, 'table ' || i || ': neither box nor page' FROM t WHERE NOT has_box AND no_page
""")
def evl_gold_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    one = F.struct("o_orderkey", (F.col("o_orderkey") % 4).alias("n_cells"), (F.col("o_orderkey") % 5 == 0).alias("has_box"), F.when(F.col("o_orderkey") % 7 != 0, 0).alias("page"))
    gold = o.groupBy(k.alias("k")).agg(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") != "F", one))).alias("tables"))
    gold = gold.withColumn("track", F.when(F.col("k") % 4 == 0, "synthetic").when(F.col("k") % 4 == 1, "real_structure")).withColumn("status", F.when(F.col("k") % 3 == 0, "draft").otherwise("reviewed"))
    return E.gold_faults(gold, ["k"])


_TIERS = ("basic", "stress", "hard", "hard_precision", "hard_sensing", "compete", "compete_hard", "real")


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a tier, a suite, grids, a ban and failure classes that follow from their ids."""
    i = F.col("doc_id")
    tier = F.get(F.array(*[F.lit(t) for t in _TIERS]), (i % 8).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", tier.alias("tier"), F.when(i % 5 == 0, "regression_hard").alias("suite"), (i % 3 != 0).alias("has_grids"), (i % 11 == 0).alias("banned"), F.array(F.concat(F.lit("C"), (i % 4).cast("string"))).alias("classes"))


_TIERED = f"SELECT doc_id, {list(_TIERS)}[doc_id % 8 + 1] AS tier, CASE WHEN doc_id % 5 = 0 THEN 'regression_hard' END AS suite, doc_id % 3 <> 0 AS has_grids, doc_id % 11 = 0 AS banned FROM documents"


@query(f"""
WITH d AS (SELECT * FROM ({_TIERED}) WHERE NOT banned) SELECT 'regression' AS name, count(*) AS n FROM d WHERE tier IN ('basic', 'stress', 'hard') UNION ALL SELECT 'regression_hard', count(*) FROM d WHERE tier = 'hard' OR suite = 'regression_hard'
UNION ALL SELECT 'regression_grid_gold', count(*) FROM d WHERE tier IN ('basic', 'stress', 'hard', 'hard_precision') AND has_grids UNION ALL SELECT 'all', count(*) FROM d UNION ALL SELECT 'compete', count(*) FROM d WHERE tier = 'compete'
""")
def evl_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("regression", "regression_hard", "regression_grid_gold", "all", "compete")
    row = _tiered(spark, sf_dir).agg(*[F.count_if(E.in_suite(n)).alias(n) for n in names])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])))


@query(f"""
WITH d AS (SELECT *, doc_id % 4 AS c FROM ({_TIERED})) SELECT 'size' AS "check", CAST(count(*) AS DOUBLE) AS value, count(*) >= 60 AS passed FROM d UNION ALL SELECT 'incomplete', count(*) FILTER (WHERE NOT has_grids), count(*) FILTER (WHERE NOT has_grids) = 0 FROM d
UNION ALL SELECT 'class_C1', count(*) FILTER (WHERE c = 1), count(*) FILTER (WHERE c = 1) > 0 FROM d UNION ALL SELECT 'class_C9', count(*) FILTER (WHERE c = 9), count(*) FILTER (WHERE c = 9) > 0 FROM d
""")
def evl_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.integrity(_tiered(spark, sf_dir), ["C1", "C9"])


@query("""
WITH s AS (SELECT o_orderpriority AS p, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS b, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS n FROM orders GROUP BY 1)
SELECT p, 'price' AS metric, round(b, 4) AS before, round(n, 4) AS now FROM s WHERE n < b - 100
""")
def evl_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("p")).agg(F.avg("o_totalprice").alias("price"))
    return E.regressions(mean("O"), mean("F"), ["p"], {"price": 100.0}).select("p", "metric", F.round("before", 4).alias("before"), F.round("now", 4).alias("now"))


@query("""
WITH b AS (SELECT lang, count(*) AS n, avg(quality) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang))
SELECT '| lang | n | quality |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || coalesce(lang, 'all') || ' | ' || n || ' | ' || printf('%.4f', quality) || ' |', chr(10) ORDER BY lang NULLS FIRST) AS report FROM b
""")
def evl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoreboard as Markdown."""
    s = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return E.markdown(E.scoreboard(s, ["lang"], ["quality"]), ["lang", "n", "quality"], ["lang"])


@query("SELECT doc_id, round(avg(CAST(regexp_matches(l, '[0-9]') AS INTEGER)), 6) AS with_digit, round(sum(len(regexp_replace(l, '[^.,;:!?]', '', 'g'))) / greatest(1, sum(len(regexp_replace(l, '\\s', '', 'g')))), 6) AS signs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' GROUP BY doc_id")
def prd_run_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines taken as runs: the share with a digit, and the share of signs among all that is not space."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l")).where(F.trim("l") != "")
    return lines.groupBy("doc_id").agg(F.round(G.runs_with_digit(F.col("l")), 6).alias("with_digit"), F.round(G.signs_of_solid(F.col("l")), 6).alias("signs"))


@query(f"SELECT doc_id, CAST((rn - 1) // 40 AS INTEGER) AS page, CAST((rn - 1) % 40 AS INTEGER) AS \"row\", CAST(c AS INTEGER) AS col, [CAST(s_suppkey AS VARCHAR), s_name, b][c + 1] AS text FROM (SELECT *, unnest([0, 1, 2]) AS c, count(*) OVER (PARTITION BY doc_id, (rn - 1) // 40) AS height FROM ({_SUPPLIERS})) WHERE height >= 2")
def rt_gated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's suppliers as a ruled table, in a page frame and above a tax form's boxes: neither of these is a table, nor are three cells."""
    s = table(spark, sf_dir, "supplier")
    rows = render.collected(s, F.col("s_nationkey"), ["s_suppkey"], [F.col("s_suppkey"), F.col("s_name"), F.format_string("%.2f", "s_acctbal")])
    return _cells(T.tables(render.grids(spread(rows), style="gated", per_page=40, pitch=12.0), preset("auto")))


@query()
def snk_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a document as JSON; its coordinates are no SQL, and tests read it back."""
    return T.envelope(_report(spark, sf_dir), preset("auto"))


@query(f"SELECT family, variant, expected, expected AS found FROM (VALUES {', '.join(f"('{f}', {v}, {n})" for f, v, n in corpus.expected())}) t(family, variant, expected)")
def gen_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated corpus: tables found against those drawn, for every family and variant."""
    return corpus.counts(spark)


@query(f"""
WITH x AS ({_BOXES}), h AS (SELECT doc_id, x0, lead(x0) OVER (PARTITION BY doc_id ORDER BY x0) AS x1, row_number() OVER (PARTITION BY doc_id ORDER BY x0) - 1 AS col FROM (SELECT DISTINCT doc_id, x0 FROM x)),
v AS (SELECT doc_id, y0, lead(y0) OVER (PARTITION BY doc_id ORDER BY y0) AS y1, row_number() OVER (PARTITION BY doc_id ORDER BY y0 DESC) - 2 AS "row" FROM (SELECT DISTINCT doc_id, y0 FROM x))
SELECT h.doc_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, x0, y0, x1, y1 FROM h JOIN v ON h.doc_id = v.doc_id WHERE x1 - x0 >= 3 AND y1 - y0 >= 3
""")
def geo_grid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left and lower sides of a page's boxes as edges of a grid."""
    edges = boxes(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("x0").alias("xs"), F.collect_list("y0").alias("ys"))
    return edges.select("doc_id", F.inline(G.grid_boxes(F.col("xs"), F.col("ys"))))


@query(f"""
WITH x AS ({_BOXES}), p AS (SELECT a.doc_id, a.id AS run, b.id AS cell, b.x0 AS cx, (a.x0 + a.x1) / 2 AS mx, (a.y0 + a.y1) / 2 AS my, b.x0, b.x1, b.y0, b.y1 FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.id % 2 = 1 AND b.id % 2 = 0
WHERE (a.x0 + a.x1) / 2 BETWEEN b.x0 - 1 AND b.x1 + 1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 - 1 AND b.y1 + 1)
SELECT doc_id, run, cell FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY least(mx - x0, x1 - mx, my - y0, y1 - my) DESC, cx, cell) AS k FROM p) WHERE k = 1
""")
def geo_own_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each odd box as a run in the one even box that has its centre deepest inside."""
    x = boxes(spark, sf_dir).select("doc_id", "page", "id", "x0", "y0", "x1", "y1")
    return C.own_cells(x.where("id % 2 = 1"), x.where("id % 2 = 0"), "id").select("doc_id", F.col("r_id").alias("run"), F.col("c_id").alias("cell"))


@query(f"""
WITH x AS ({_BOXES}), a AS (SELECT doc_id, list(x0) FILTER (WHERE id % 2 = 0) AS anchors FROM x GROUP BY doc_id), c AS (SELECT doc_id, list_sort(list("rows")) AS r FROM x GROUP BY doc_id)
SELECT x.doc_id, round(avg(CAST(coalesce(len(list_filter(anchors, lambda y: abs(y - x.x0) <= 40)), 0) > 0 AS INTEGER)), 6) AS alignment, round(any_value(len(list_filter(r, lambda n: abs(n - r[len(r) // 2 + 1]) <= 1)) / len(r)), 6) AS steady
FROM x JOIN a ON x.doc_id = a.doc_id JOIN c ON x.doc_id = c.doc_id GROUP BY x.doc_id
""")
def geo_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = boxes(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("x0").alias("v"), F.collect_list(F.when(F.col("id") % 2 == 0, F.col("x0"))).alias("a"), F.collect_list("rows").alias("r"))
    return g.select("doc_id", F.round(G.alignment(F.col("v"), F.col("a"), 40.0), 6).alias("alignment"), F.round(G.steady(F.col("r")), 6).alias("steady"))
