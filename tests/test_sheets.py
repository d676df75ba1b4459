from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.operators.paging import assemble_pages, page_blocks
from panelflow.operators.sheets import consolidate_glossary, glossary_rows, skip_until, take_while
from panelflow.plans.glossary import build_dictionary

CELLS = "origin string, file string, sheet string, row_idx int, col_idx int, value string"


def sheet(origin, file, name, rows):
    width = max(len(r) for r in rows)
    return [
        (origin, file, name, i, j, None if j >= len(r) or r[j] is None else str(r[j]))
        for i, r in enumerate(rows)
        for j in range(width)
    ]


def book():
    head = ["Nombre de la variable", "Etiqueta"]
    return [
        *sheet("scores", "scores2m2016.xlsx", "datos", [head, [" RBD ", "Rol"], ["agno", ""], ["prom", "Puntaje"]]),
        *sheet("scores", "scores2017_4b.xlsx", "hoja 4B", [
            ["Manual"], ["x"], ["y"], [None], [None], [None, None, "Nombre", "Descripción", "Nombre"],
            [1, 2, "rbd", "Rol otra vez", "no"], [1, 2, "agno", "Año", "no"], [1, 2, None, "blank", "no"], [1, 2, "lost", "after the blank", "no"],
        ]),
        *sheet("marks", "marks6b2023.xlsx", "s", [["Variable", "Texto"], ["rbd", "third"], ["ind", None], ["nan ", "odd"], ["cc", "Clima"]]),
        *sheet("marks", "marks6b2023.xlsx", "sin tabla", [["a", "b"], ["c", "d"], ["e", "f", "g", "nombre"]]),
        *sheet("marks", "marks6b2023.xlsx", "Índice", [head, ["hidden", "x"]]),
        *sheet("marks", "~$marks6b2023.xlsx", "s", [head, ["hidden", "x"]]),
        *sheet("marks", "sin año.xlsx", "una", [["Variable"], ["only"]]),
        *sheet("marks", "old 1998.xlsx", "vacía", [head, [None, "x"], ["never", "x"]]),
        *sheet("marks", "sin año.xlsx", "dos", [["Código", "Variable", "Label"], ["c1", "v1", "d1"]]),
    ]


def test_glossary(spark):
    cells = spark.createDataFrame(book(), CELLS).repartition(6)
    done = build_dictionary(cells, ["scores", "marks"])
    got = {r["variable"]: (r["descripcion"], r["archivos_presentes"]) for r in done.table.collect()}
    assert got == {
        "rbd": ("Rol otra vez", "marks_6b_2023_s, scores_2m_2016_datos, scores_4b_2017_hoja 4B"),
        "agno": ("Año", "scores_2m_2016_datos, scores_4b_2017_hoja 4B"),
        "prom": ("Puntaje", "scores_2m_2016_datos"),
        "ind": ("Sin descripción", "marks_6b_2023_s"),
        "cc": ("Clima", "marks_6b_2023_s"),
        "c1": ("d1", "marks_general_desconocido_dos"),
    }
    assert [r["variable"] for r in done.table.collect()] == sorted(got)
    assert {r["variable"] for r in done.parts["scores"].collect()} == {"rbd", "agno", "prom"}
    assert {r["variable"] for r in done.parts["marks"].collect()} == {"rbd", "ind", "cc", "c1"}


def test_the_first_declared_origin_and_the_first_sheet_of_a_workbook_describe(spark):
    rows = [(*r, k) for k, (origin, name, text) in enumerate([("marks", "a", "by marks"), ("scores", "z", "first sheet"), ("scores", "a", "second sheet")])
            for r in sheet(origin, f"{origin}2m2016.xlsx", name, [["variable", "label"], ["x", text]])]
    cells = spark.createDataFrame(rows, CELLS + ", sheet_idx int").repartition(3)
    said = lambda cells, origins: build_dictionary(cells, origins).table.first()["descripcion"]
    assert said(cells, ["scores", "marks"]) == "first sheet"
    assert said(cells, ["marks", "scores"]) == "by marks"
    assert said(cells.drop("sheet_idx"), ["scores", "marks"]) == "second sheet"


def test_level_of_the_sheet_wins(spark):
    rows = sheet("scores", "scores2m2016.xlsx", "parte 8B", [["variable", "label"], ["a", "b"]])
    [row] = glossary_rows(spark.createDataFrame(rows, CELLS), ["scores"]).collect()
    assert row["contexto"] == "scores_8b_2016_parte 8B"


def test_generic_names_fold_levels(spark):
    rows = sheet("scores", "scores2m2016.xlsx", "a", [["variable", "label"], ["prom_mate2m_rbd", "b"], ["prom_mate4b_rbd", "c"]])
    [row] = build_dictionary(spark.createDataFrame(rows, CELLS), ["scores"], generic=True).table.collect()
    assert (row["variable"], row["descripcion"]) == ("prom_mate_rbd", "b")


def test_a_hot_variable_costs_one_row_per_context(spark, plan):
    rows = spark.range(5000).select(
        F.lit("rbd").alias("variable"), F.lit("").alias("descripcion"), (F.col("id") % 3).cast("string").alias("contexto"), F.col("id").alias("place")
    )
    [row] = consolidate_glossary(rows).collect()
    assert tuple(row) == ("rbd", "Sin descripción", "0, 1, 2")


def test_cut_and_header_are_positions_not_filters(spark):
    rows = [("a", 1, "x"), ("a", 2, "head"), ("a", 3, "y"), ("a", 4, "end"), ("a", 5, "z"), ("b", 1, "y")]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    cut = take_while(df, ["k"], "n", F.col("v") == "end")
    assert sorted(tuple(r) for r in cut.collect()) == [rows[0], rows[1], rows[2], rows[5]]
    body = skip_until(df, ["k"], "n", F.col("v") == "head")
    assert sorted(tuple(r) for r in body.collect()) == [rows[2], rows[3], rows[4]]


def test_pages_are_numbered_by_position(spark, tmp_path):
    import glob

    from panelflow.sources.sinks import write_listings

    rows = [("d", 7, None), ("d", 0, "  one\n"), ("d", 9, " \t "), ("e", 1, "x"), (None, 4, "y")]
    pages = spark.createDataFrame(rows, "doc string, page int, text string").repartition(3)
    blocks = assemble_pages(pages, "doc", "page", "text", "(none)", "# T")
    got = [tuple(r) for r in blocks.orderBy("doc", "page_no").collect()]
    assert [r[:3] for r in got] == [(None, 1, 1), ("d", 1, 3), ("d", 2, 3), ("d", 3, 3), ("e", 1, 1)]
    want = "# T\n\n## --- SLIDE 1 / 3 ---\n\none\n\n## --- SLIDE 2 / 3 ---\n\n(none)\n\n## --- SLIDE 3 / 3 ---\n\n(none)\n"
    assert "\n".join(r[3] for r in got if r[0] == "d") == want
    write_listings(blocks.where("doc = 'd'"), f"{tmp_path}/out", "doc")
    files = sorted(glob.glob(f"{tmp_path}/out/*.txt"))
    assert "".join(open(f).read() for f in files) == want + "\n"


def test_a_long_document_is_numbered_over_many_ranges(spark):
    pages = spark.range(0, 1000).select(F.lit("d").alias("doc"), (F.col("id") * 5 - 3).alias("page"), F.concat(F.lit("t"), "id").alias("text"))
    got = page_blocks(pages.repartition(6), "doc", "page", "text").orderBy("page_no").collect()
    assert [r["page_no"] for r in got] == list(range(1, 1001)) and all(r["pages"] == 1000 for r in got)
    assert all(r["block"].endswith(f"\n\nt{i}\n") for i, r in enumerate(got))
