"""Relations, sinks, sources and streaming; and every query against its SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.functions import geometry as G
from quire.operators import evaluate as E
from quire.plans import queries as Q
from quire.plans import tables as T
from quire.plans.options import TextOptions, preset
from quire.sources import pdf
from quire.sources.datasource import PdfSource
from quire.sources.writer import Page, document, table
from quire.streaming import ingest
from tools.compare import canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n in Q.SQL])
def test_query_agrees_with_sql(spark, con, name):
    df, rel = Q.QUERIES[name](spark, SF), con.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), rel.columns)


def test_overall_agrees_with_sql_to_the_last_digit(spark, con):
    # Of sf0.001, orders 85, 1000 and 1470 end in a 5 that rounding by decimal digits takes elsewhere.
    ours = {r["o_orderkey"]: r["overall"] for r in Q.evl_overall(spark, SF).collect()}
    assert ours == dict(con.sql(Q.SQL["evl_overall"]).fetchall())


def test_overall_weights_add_up_exactly(spark):
    row = spark.sql("SELECT CAST(NULL AS DOUBLE) AS a, 3.0D AS b, 7.0D AS c")
    of = lambda *names: row.select(E.overall({n: (F.col(n), w) for n, w in zip(names, (0.4, 0.2, 0.4))}).alias("v")).first()["v"]
    assert of("a", "a") is None
    assert of("b") == 0.4 * 3 / 0.4
    assert of("b", "c") == (0.4 * 3 + 0.2 * 7) / 0.6  # the binary sum of 0.4 and 0.2 is above 0.6


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_every_customer(spark, con):
    assert entry.entry(spark).select("doc_id", "page", "row").distinct().count() == con.sql("SELECT count(*) FROM orders").fetchall()[0][0]


@pytest.mark.parametrize("name, lost", [("rt_lattice_cells", 0), ("rt_filled_cells", 0), ("rt_painted_cells", 2), ("rt_column_ruled_cells", 2), ("rt_network_cells", 6), ("rt_full_cells", 0)])
def test_small_tables(spark, tmp_path, name, lost):
    """Customers with 1, 2, 3, 25 and 26 orders, on pages of 12; lost: rows on pages that are no table of this kind, or joined with another."""
    rows = [(c * 1000 + k, c, "OFP"[k % 3], 1234.5 * (k + c), ["1-URGENT", "5-LOW"][k % 2]) for c in (1, 2, 3, 25, 26) for k in range(c)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    df, rel = Q.QUERIES[name](spark, str(tmp_path)), c.sql(Q.SQL[name])
    got = [tuple(r) for r in df.collect()]
    assert canonical(got, df.columns) == canonical(rel.fetchall(), rel.columns)
    assert {r[0] for r in got} >= {"3", "25", "26"} and len(got) == 4 * (len(rows) - lost)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    to = tmp_path_factory.mktemp("pdfs")
    p = Page()
    table(p, [["a", "b\tc"], ["d", "e"], ["f", "g"]], [72, 150, 250])
    q = Page()
    for k in range(4):
        q.text(72, 700 - 16 * k, f"left {k} of the page")
        q.text(320, 700 - 16 * k, f"right {k} of the page")
    (to / "one.pdf").write_bytes(document([p, q], "T"))
    (to / "two.pdf").write_bytes(b"junk")
    return str(to)


def test_relations_and_sinks(spark, folder):
    docs = pdf.load(spark, folder)
    got = pdf.extract(docs)
    assert pdf.relation(got, "pages").count() == 2 and [r["code"] for r in pdf.errors(got).collect()] == ["not_pdf"]
    assert [r["title"] for r in pdf.meta(got).collect()] == ["T"]
    text = {r["page"]: r["text"] for r in T.text(docs).collect()}
    assert text[1].split("\n") == [f"left {k} of the page" for k in range(4)] + [f"right {k} of the page" for k in range(4)]
    assert T.text(docs, TextOptions(reading_order=False)).count() == 2
    found = T.tables(docs, preset("lattice_only"))
    assert [r["tsv"] for r in T.tsv(found).collect()] == ["a\tb c\nd\te\nf\tg"]
    made = json.loads(T.json(found).collect()[0]["json"])
    assert made["n_tables"] == 1 and made["tables"][0]["grid"][1] == ["d", "e"]
    assert T.tables(docs, preset("off")).count() == 0
    assert T.pages_of(docs, preset("lattice_only"), [1]).count() == 0 and T.pages_of(docs, preset("auto"), [0]).count() == 1
    assert T.info(docs).collect()[0]["n_pages"] == 2
    assert "a\tb c" in T.document_text(docs, preset("auto")).collect()[0]["text"]
    both = T.detected(docs, preset("auto"))
    assert [r["code"] for r in T.errors(both).collect()] == ["not_pdf"] and both.count() == 2
    (made,) = [json.loads(r["json"]) for r in T.envelope(docs, preset("auto")).collect()]
    assert (made["page_count"], made["table_count"], made["page_table_count"], made["image_count"], made["version"]) == (2, 1, 1, 0, "1.4")
    assert [c["text"] for c in made["pages"][0]["tables"][0]["cells"]] == ["a", "b\tc", "d", "e", "f", "g"] and made["pages"][1]["tables"] == []
    assert made["logical_tables"] == made["tables"] and made["pages"][1]["text"].startswith("left 0")


def test_data_source(spark, folder):
    spark.dataSource.register(PdfSource)
    rows = spark.read.format("quire_pdf").load(folder).orderBy("page").collect()
    assert [(r["page"], r["n_runs"], r["code"]) for r in rows] == [(None, None, "not_pdf"), (0, 6, None), (1, 8, None)]
    assert spark.read.format("quire_pdf").load(f"{folder}/o*.pdf").count() == 2 and spark.read.format("quire_pdf").load(f"{folder}/none*.pdf").count() == 0


def test_streaming(spark, folder, tmp_path):
    for _ in range(2):
        ingest.write_cells(ingest.arriving(spark, folder), preset("auto"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == T.cells(T.tables(pdf.load(spark, folder), preset("auto"))).count()


def test_expressions(spark):
    row = spark.range(1).select(
        G.soft_number(F.lit("$(1,200.50)")).alias("n"),
        G.soft_number(F.lit("abc")).alias("x"),
        G.caption(F.lit("Table 3: x")).alias("c"),
        G.normal_cell(F.lit(" A  _ b ")).alias("t"),
        E.same_cell(F.lit("1,000"), F.lit("1000.0")).alias("s"),
        E.character_error(F.lit("abcd"), F.lit("abxd")).alias("e"),
        E.order_score(F.lit("a then b then c"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("o"),
        E.order_score(F.lit("b then a"), F.array(F.lit("a"), F.lit("b"))).alias("p"),
        E.table_score(F.lit(1.0), F.lit(1.0), F.lit(0.5)).alias("q"),
    ).first()
    assert (row["n"], row["x"], row["c"], row["t"], row["s"], row["e"], row["o"], row["p"], row["q"]) == (-1200.5, None, True, "a_b", True, 0.25, 1.0, 0.0, 0.8)


def test_command_line(spark, folder, capsys):
    from quire.__main__ import main

    assert main(["info", folder]) == 0 and main(["extract", folder, "--format", "tsv", "--preset", "fast", "--pages", "1"]) == 0
    out = capsys.readouterr().out
    assert "pages 2" in out and "a\tb c" in out and "not_pdf" in out


class Painted:
    """A renderer that draws a grid over the page's text."""

    def render(self, content, page, dpi):
        import numpy as np

        px = np.full((792, 612), 255, np.uint8)
        for k in range(8):
            px[792 - 740 + 18 * k : 792 - 740 + 18 * k + 2, 72:452] = 0
        for x in (72, 150, 250, 350, 450):
            px[792 - 740 : 792 - 740 + 128, x : x + 2] = 0
        return px


def test_renderer(spark):
    from quire.sources.renderer import CommandRenderer, NoRenderer, read_pgm, wants_render, within_caps

    rows = [["Key", "A", "B", "C"]] + [[f"k{i}", str(i), str(i * 10), f"{i * 1.5:.2f}"] for i in range(6)]
    p = Page()
    table(p, rows, [72, 150, 250, 350, 450], style="none")
    docs = spark.createDataFrame([("d", document([p]))], "doc_id string, content binary")
    methods = lambda r: [t["method"] for t in T.tables(docs, preset("high_quality"), renderer=r).collect()]
    assert methods(Painted()) == ["lattice"] and methods(NoRenderer()) == methods(None) == ["network"]
    assert methods(CommandRenderer(programs=("no-such-program",))) == ["network"]
    assert read_pgm(b"P5\n# x\n2 1\n255\n\x00\xff").tolist() == [[0, 255]]
    with pytest.raises(ValueError):
        read_pgm(b"P6 1 1 255 x")
    assert not within_caps({"x0": 0, "x1": 9000, "y0": 0, "y1": 9000}) and within_caps({"x0": 0, "x1": 612, "y0": 0, "y1": 792})
    runs = [{"x0": 100.0 * (k % 4)} for k in range(12)]
    assert wants_render(preset("auto"), runs, []) and not wants_render(preset("fast"), runs, []) and not wants_render(preset("auto"), runs, [(0, k, 9, k) for k in range(6)])
    command = CommandRenderer().command("pdftoppm", "in.pdf", "out.pgm", 2, 150)
    assert command[command.index("-f") + 1] == "3" and command[-1] == "out"


def test_evaluation_by_brute_force(spark):
    from difflib import SequenceMatcher

    from quire.operators import evaluate

    want, got = [["a", "b"], ["c", "d"]], [["A ", "b"], ["x", "d"], ["e", "f"]]
    df = spark.createDataFrame([(want, got)], "want array<array<string>>, got array<array<string>>")
    ratio = SequenceMatcher(None, ["a", "b", "x", "d", "e", "f"], ["a", "b", "c", "d"]).ratio()
    assert evaluate.likeness(df).first()["teds"] == pytest.approx(ratio * (1 - 1 / 10)) and evaluate.grid_likeness([], []) == 1.0
    row = spark.range(1).select(
        evaluate.word_error(F.lit("the cat sat"), F.lit("the mat sat down")).alias("w"),
        evaluate.word_error(F.lit(" "), F.lit("x")).alias("n"),
        evaluate.any_token(F.lit("abc def"), F.array(F.lit("x"), F.lit("def"))).alias("t"),
        evaluate.cell_recall(F.array(F.lit("a"), F.lit("z")), F.array(F.array(F.lit("ab"), F.lit("")), F.array(F.lit("c")))).alias("c"),
        evaluate.region_grids(F.lit('<doc><region page="2"><cell start-row="0" start-col="1"><content> a  b </content></cell><cell start-row="1" start-col="0"><content>c</content></cell></region></doc>')).alias("x"),
    ).first()
    assert row["w"] == pytest.approx(2 / 3) and row["n"] is None and row["t"] and tuple(row["c"]) == (0.5, 2, 1.5)
    assert [(r["page"], [tuple(c) for c in r["cells"]]) for r in row["x"]] == [(2, [(0, 1, "a b"), (1, 0, "c")])]
    rng = __import__("random").Random(3)
    values = [(rng.choice("ab"), rng.choice([1.0, 2.0, rng.random() * 9])) for _ in range(500)]
    stats = {r["g"]: r for r in evaluate.order_statistics(spark.createDataFrame(values, "g string, v double"), ["g"], "v", {"mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}, bins=7).collect()}
    for g in "ab":
        own = sorted(v for k, v in values if k == g)
        assert (stats[g]["mid"], stats[g]["last"], stats[g]["n"]) == (own[len(own) // 2], own[-1], len(own))


def test_documents_and_sql_functions(spark, folder):
    from quire.api import Documents, register

    d = Documents.open(spark, folder)
    assert [r["n_pages"] for r in d.page_count().collect()] == [2] and d.page(1).count() == 1 and d.pages().count() == 2
    assert d.runs().count() == 14 and d.runs(0).count() == 6 and {r["font_name"] for r in d.font_names().collect()} == {"F1"}
    assert [r["code"] for r in d.errors().collect()] == ["not_pdf"] and d.links().count() == d.fields().count() == d.images().count() == d.outline().count() == d.placements().count() == 0
    assert d.tables().count() == d.stitched("auto").count() == 1 and d.cells("lattice_only").count() == 6 and d.tables("off").count() == 0
    assert d.segments().where("is_flat").count() == 4 and d.segments().where("is_tall").count() == 3 and d.warnings().count() == 0
    assert d.info().first()["title"] == d.meta().first()["title"] == "T" and d.text().count() == 2
    register(spark)
    pdf.load(spark, folder).createOrReplaceTempView("pdf_files")
    rows = spark.sql("SELECT t.page, t.row, t.col, t.text FROM pdf_files, LATERAL pdf_tables(content, 'auto') t ORDER BY t.row, t.col").collect()
    assert [(r["row"], r["col"], r["text"]) for r in rows][:2] == [(0, 0, "a"), (0, 1, "b\tc")] and len(rows) == 6
    assert [r["n_runs"] for r in spark.sql("SELECT p.n_runs FROM pdf_files, LATERAL pdf_pages(content) p ORDER BY p.page").collect()] == [6, 8]
