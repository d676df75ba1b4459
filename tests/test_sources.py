"""Files in every drift: delimiter x encoding x shape x letter case, and broken ones."""

from __future__ import annotations

import itertools
import os

import pytest
from pyspark.sql import functions as F

from panelflow.plans.analysis import clean_panel, join_panel
from panelflow.plans.indicators import consolidate_indicators
from panelflow.plans.scores import consolidate_scores
from panelflow.presets import INDICATOR_SCHEMA, SCORE_SCHEMA
from panelflow.sources.delimited import read_delimited, read_quoted_csv
from panelflow.sources.discover import list_files, profile_files
from panelflow.sources.records import parsed, quoted_records, record_facts
from panelflow.sources.sinks import write_csv, write_panel

SEPARATORS = {"pipe": "|", "semi": ";", "comma": ","}
ENCODINGS = {"latin": ("latin-1", b""), "utf": ("utf-8", b""), "bom": ("utf-8", b"\xef\xbb\xbf")}


def put(path, lines, sep=",", encoding="utf-8", bom=b"", end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    text = end.join(sep.join("" if c is None else str(c) for c in line) for line in lines) + end
    with open(path, "wb") as f:
        f.write(bom + text.encode(encoding))


def indicator_lines(shape, upper):
    if shape == "wide":
        head = ["RBD", "ind_am_rbd", "IND_CC", "ind_hv", "ind_pf", "NOM_REGI_N", "nom_reg_rbd", "cod_deprov"]
        body = [
            [1, 70.5, "*", 60, 50, "Ñuñoa", "second", 9],
            [2, 71, 72, 73, 74, "Región", "second", 9],
        ]
    else:
        code = ["AM", "cc ", "HV", "PF", "ZZ"] if shape == "text" else ["1", "2.0", "3", "4", "9"]
        name = "ind" if shape == "text" else "id_indicador"
        head = ["rbd", name, "prom", "nom_reg_rbd"]
        body = [
            [1, code[0], 70.5, ""],
            [1, code[1], "*", "Ñuñoa"],
            [1, code[2], 60, "later"],
            [1, code[3], 50, "later"],
            [1, code[4], 99, "unmapped"],
            [2, code[0], 71, "Región"],
            [2, code[1], 72, ""],
            [2, code[2], 73, ""],
            [2, code[3], 74, ""],
            [3, code[0], "*", "all bad"],
            ["", code[0], 10, "null key"],
        ]
    if upper:
        head = [f" {h.upper()} " for h in head]
    return [head, *body]


DRIFT = list(itertools.product(SEPARATORS, ENCODINGS, ["wide", "text", "numeric"], [False, True]))


def test_every_drift_gives_the_same_rows(spark, tmp_path):
    for i, (sep, enc, shape, upper) in enumerate(DRIFT):
        encoding, bom = ENCODINGS[enc]
        level = "2468"[i % 4]
        name = f"ind{2001 + i}_{sep}_{enc}_{shape}.{'csv' if i % 2 else 'TXT'}"
        put(f"{tmp_path}/in/{level}/{name}", indicator_lines(shape, upper), SEPARATORS[sep], encoding, bom)
    put(f"{tmp_path}/in/4b/ind2099_dim.csv", [["rbd", "prom"], [9, 9]])
    put(f"{tmp_path}/in/top2099.csv", [["rbd", "ind_am"], [9, 9]])
    put(f"{tmp_path}/in/4b/deeper/ind2098.csv", [["rbd", "ind_am"], [9, 9]])
    done = consolidate_indicators(spark, f"{tmp_path}/in")
    assert done.table.schema.names == INDICATOR_SCHEMA.names
    assert [f.dataType for f in done.table.schema] == [f.dataType for f in INDICATOR_SCHEMA]
    assert done.quarantine.count() == 0
    rows = {(r["agno"], r["rbd"]): r for r in done.table.collect()}
    assert len(rows) == 2 * len(DRIFT)
    for i, (_, _, shape, _) in enumerate(DRIFT):
        level = ["2m", "4b", "6b", "8b"][i % 4]
        one, two = rows[2001 + i, 1], rows[2001 + i, 2]
        assert (one["curso"], one["idps_am"], one["idps_cc"], one["idps_hv"], one["idps_pf"]) == (level, 70.5, None, 60, 50)
        assert (two["idps_am"], two["idps_cc"], two["idps_hv"], two["idps_pf"]) == (71, 72, 73, 74)
        assert (one["nom_reg_rbd"], two["nom_reg_rbd"]) == ("Ñuñoa", "Región"), DRIFT[i]
    [audit] = done.audit.collect()
    assert (audit["rows_in"], audit["rows_out"]) == (2 * len(DRIFT), len(DRIFT))


def test_two_codes_of_one_target_are_averaged_and_the_later_file_wins(spark, tmp_path):
    put(f"{tmp_path}/4/a2020.csv", [["rbd", "ind", "prom"], [1, "AM", 10], [1, "AA", 20], [2, "CC", 5]])
    put(f"{tmp_path}/4/b2020.csv", [["rbd", "ind_am", "ind_cc"], [2, 1, 2], [2, 3, 4]])
    rows = {r["rbd"]: r for r in consolidate_indicators(spark, str(tmp_path)).table.collect()}
    assert rows[1]["idps_am"] == 15
    assert (rows[2]["idps_am"], rows[2]["idps_cc"]) == (3, 4)


def test_year_of_the_name_beats_the_column_and_the_column_fills_in(spark, tmp_path):
    put(f"{tmp_path}/6/x2019.csv", [["rbd", "agno", "ind_am"], [1, 1900, 5]])
    put(f"{tmp_path}/6/noyear.csv", [["rbd", "ano", "ind_am"], [2, "2018.0", 5]])
    rows = {r["rbd"]: r["agno"] for r in consolidate_indicators(spark, str(tmp_path)).table.collect()}
    assert rows == {1: 2019, 2: 2018}


def test_a_long_file_without_any_year_keeps_its_rows(spark, tmp_path):
    put(f"{tmp_path}/6/noyear.csv", [["rbd", "ind", "prom"], [2, "AM", 5]])
    [row] = consolidate_indicators(spark, str(tmp_path)).table.collect()
    assert (row["rbd"], row["agno"], row["curso"], row["idps_am"]) == (2, None, "6b", 5.0)


def test_a_given_encoding_is_used_for_header_and_rows(spark, tmp_path):
    put(f"{tmp_path}/a.csv", [["año", "b"], ["ñ", 2]], encoding="utf-8")
    put(f"{tmp_path}/b.csv", [["año", "b"], ["ñ", 2]], encoding="latin-1")
    garbled, plain = (r for f in ("a", "b") for r in read_delimited(spark, [f"{tmp_path}/{f}.csv"], encoding="ISO-8859-1").frames)
    assert [tuple(r)[:2] for r in plain.collect()] == [("ñ", "2")]
    assert garbled.columns[:2] == ["aã±o", "b"] and [tuple(r)[:2] for r in garbled.collect()] == [("Ã±", "2")]


def score_files(root):
    put(f"{root}/s/scores2m2016_rbd.csv", [["rbd", "prom_mate2m_rbd", "prom_lect2m_rbd", "cod_grupo", "extra"],
        [1, 250, 260, "1", "x"], [2, "*", 240, "2", "x"], [3, " ", 1, "", "x"], [4, "5d", 1, "", "x"], [5, 200, "NaN", "", ""]], "|")
    put(f"{root}/s/deep/er/Scores4b2024_rbd_final.txt", [["RBD", "AGNO", "PROM_MATE4B_RBD", "prom_lect4b_rbd", "cod_rural_rbd"],
        [1, 2023, "251.5", "-1e2", "2"]], ";", "latin-1")
    put(f"{root}/s/own2017_rbd.csv", [["rbd", "curso", "prom_mate_rbd", "prom_lect_rbd"], [7, "8b", 1, 2]])
    put(f"{root}/s/scores2m2016_rbd.txt", [["rbd", "prom_mate_rbd", "prom_lect_rbd"], [99, 1, 2]])
    put(f"{root}/s/scores2m2016_region.csv", [["rbd", "prom_mate_rbd", "prom_lect_rbd"], [98, 1, 2]])


def test_scores(spark, tmp_path):
    score_files(tmp_path)
    done = consolidate_scores(spark, f"{tmp_path}/s", "scores")
    assert done.table.schema.names == SCORE_SCHEMA.names
    rows = [tuple(r) for r in done.table.orderBy("rbd", "agno").collect()]
    assert rows == [
        (1, 2016, "2m", 250.0, 260.0, "1", None, None),
        (1, 2023, "4b", 251.5, -100.0, None, None, "2"),
        (7, 2017, "8b", 1.0, 2.0, None, None, None),
    ]
    [audit] = done.audit.collect()
    assert (audit["rows_in"], audit["rows_out"], audit["removed"]) == (7, 3, 4)


def test_repeated_score_keys_stay_unless_asked(spark, tmp_path):
    lines = [["rbd", "prom_mate_rbd", "prom_lect_rbd"], [1, 1, 1], [1, 2, 2]]
    put(f"{tmp_path}/x2m2016_rbd.csv", lines)
    assert consolidate_scores(spark, str(tmp_path)).table.count() == 2
    [last] = consolidate_scores(spark, str(tmp_path), dedup="last").table.collect()
    assert last["prom_mate_rbd"] == 2


def test_no_files_give_the_empty_schema(spark, tmp_path):
    put(f"{tmp_path}/other.csv", [["a"], [1]])
    done = consolidate_scores(spark, str(tmp_path))
    assert done.table.count() == 0 and done.table.schema.names == SCORE_SCHEMA.names
    empty = consolidate_indicators(spark, str(tmp_path))
    assert empty.table.count() == 0 and empty.table.schema.names == INDICATOR_SCHEMA.names


def test_broken_files_are_set_aside_and_the_rest_is_read(spark, tmp_path):
    head = ["rbd", "prom_mate_rbd", "prom_lect_rbd"]
    put(f"{tmp_path}/a2016_rbd.csv", [head, [1, 1, 1, "extra"], [2, 2, 2]])
    put(f"{tmp_path}/b2016_rbd.csv", [head, [3, 1, 1], [4, 2, 2, "extra"]])
    put(f"{tmp_path}/c2016_rbd.csv", [head, [5, 1], [6, 2, 2]])
    put(f"{tmp_path}/d2016_rbd.csv", [head])
    open(f"{tmp_path}/e2016_rbd.csv", "w").close()
    put(f"{tmp_path}/f2016_rbd.csv", [head, [7, '"1,5"', 2]])
    done = consolidate_scores(spark, str(tmp_path))
    assert [r["rbd"] for r in done.table.collect()] == [6]
    aside = {r["file"].split("/")[-1]: r["reason"] for r in done.quarantine.collect()}
    assert aside == {
        "a2016_rbd.csv": "4 fields in a line, 3 in the header",
        "b2016_rbd.csv": "4 fields in a line, 3 in the header",
        "e2016_rbd.csv": "no header line",
    }


def test_repeated_names_keep_the_first_column(spark, tmp_path):
    put(f"{tmp_path}/a.csv", [["Nom", "nom ", "NOM", "x"], ["1", "2", "3", "4"]])
    [frame] = read_delimited(spark, [f"{tmp_path}/a.csv"]).frames
    assert [tuple(r) for r in frame.select("nom", "x").collect()] == [("1", "4")]


def test_the_header_of_every_file_is_dropped(spark, tmp_path):
    put(f"{tmp_path}/a.csv", [["a", "b"], [1, 2], [3, 4]], end="\r\n")
    put(f"{tmp_path}/b.csv", [["a", "b"], [5, 6]])
    [frame] = read_delimited(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"]).frames
    assert sorted(tuple(r) for r in frame.select("a", "b").collect()) == [("1", "2"), ("3", "4"), ("5", "6")]


def test_names_with_blanks_and_accents(spark, tmp_path):
    path = f"{tmp_path}/año 2020 %41 [a]{{b}}+c_rbd.csv"
    put(path, [["rbd", "prom_mate_rbd", "prom_lect_rbd"], [1, 1, 1]])
    done = consolidate_scores(spark, str(tmp_path))
    assert [r["agno"] for r in done.table.collect()] == [2020]
    assert done.quarantine.count() == 0


def test_profiling_does_not_sort_the_lines(spark, tmp_path, plan):
    put(f"{tmp_path}/a.csv", [["a", "b"]])
    text = plan(profile_files(spark, [f"{tmp_path}/a.csv"]))
    assert "ObjectHashAggregate" in text and "SortAggregate" not in text


def test_profile_prefers_the_pipe(spark, tmp_path):
    put(f"{tmp_path}/a.csv", [["a;b,c", "d"]], "|")
    put(f"{tmp_path}/b.csv", [["a,b", "c"]], ";")
    put(f"{tmp_path}/c.csv", [["one"]])
    paths = [r["path"] for r in list_files(spark, str(tmp_path)).collect()]
    got = {r["path"].split("/")[-1]: (r["separator"], r["encoding"]) for r in profile_files(spark, paths).collect()}
    assert got == {"a.csv": ("|", "UTF-8"), "b.csv": (";", "UTF-8"), "c.csv": (",", "UTF-8")}


def test_rows_of_a_file_keep_their_order_over_splits(spark, tmp_path):
    lines = [["rbd", "ind_am"], *[[i % 7, i] for i in range(20_000)]]
    put(f"{tmp_path}/2/x2020.csv", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = {r["rbd"]: r["idps_am"] for r in consolidate_indicators(spark, str(tmp_path)).table.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {k: float(max(i for i in range(20_000) if i % 7 == k)) for k in range(7)}


def test_quoted_line_breaks(spark, tmp_path):
    path = f"{tmp_path}/g.csv"
    with open(path, "wb") as f:
        f.write(b"\xef\xbb\xbf" + 'variable,descripcion,archivos\na,"one\ntwo, ""three""","x, y"\nb,plain,z\n'.encode())
    rows = [tuple(r) for r in read_quoted_csv(spark, path).orderBy("variable").collect()]
    assert rows == [("a", 'one\ntwo, "three"', "x, y"), ("b", "plain", "z")]


def test_sinks_round_trip(spark, tmp_path):
    rows = [(1, 2016, "2m", 'say "x", y'), (2, 2017, "4b", "ñ")]
    df = spark.createDataFrame(rows, "rbd bigint, agno int, curso string, nom string")
    write_csv(df, f"{tmp_path}/new/deep/csv")
    back = spark.read.csv(f"{tmp_path}/new/deep/csv", header=True, escape='"')
    assert sorted(tuple(r) for r in back.collect()) == [("1", "2016", "2m", 'say "x", y'), ("2", "2017", "4b", "ñ")]
    write_csv(df, f"{tmp_path}/marked", bom=True)
    for part in (f for f in os.listdir(f"{tmp_path}/marked") if f.endswith(".csv")):
        with open(f"{tmp_path}/marked/{part}", "rb") as f:
            assert f.read().startswith(b"\xef\xbb\xbfrbd,agno")
    write_panel(df, f"{tmp_path}/panel")
    one = spark.read.parquet(f"{tmp_path}/panel").where("agno = 2016 and curso = '2m'")
    assert one.count() == 1


def test_join_and_clean(spark, tmp_path):
    score_files(tmp_path)
    put(f"{tmp_path}/i/2m/x2016.csv", [["rbd", "ind_am", "ind_cc", "ind_hv", "ind_pf", "cod_grupo", "nom_rbd"],
                                       [1, 1, 2, 3, 4, "9", "school"], [50, 1, 2, 3, 4, "", ""]])
    scores = consolidate_scores(spark, f"{tmp_path}/s", "scores").table
    indicators = consolidate_indicators(spark, f"{tmp_path}/i").table
    [row] = join_panel(scores, indicators).collect()
    assert (row["rbd"], row["agno"], row["curso"], row["cod_grupo"], row["nom_rbd"], row["idps_am"]) == (1, 2016, "2m", "1", "school", 1.0)


def test_analysis_from_table_to_interpretation(spark, tmp_path):
    import numpy as np

    from panelflow.plans.analysis import (
        analysis_table, fit_and_compare, interpret, profile_panel, read_analysis_table)
    from panelflow.presets import ANALYSIS_CATEGORICAL, ANALYSIS_NUMERIC, ANALYSIS_SCHEMA, ANALYSIS_TARGETS

    rng = np.random.default_rng(1)
    lines = []
    for i in range(400):
        am, cc, hv, pf = (round(float(v), 2) for v in rng.normal(70, 5, 4))
        group = int(rng.integers(1, 6))
        y = 100 + 2 * cc + 10 * group + float(rng.normal(0, 3))
        lines.append([i, 2018 + i % 3, f"{group}.0" if i % 2 else ["Bajo", "Medio bajo", "Medio", "Medio alto", "Alto"][group - 1],
                      1 + i % 4, 1 + i % 2, round(y, 3), round(y / 2 + am, 3), am, cc, hv, pf])
    lines.append([999, 2020, "", 1, 1, 1, 1, 1, 1, 1, 1])
    put(f"{tmp_path}/panel.csv", [ANALYSIS_SCHEMA.names, *lines])
    raw = read_analysis_table(spark, f"{tmp_path}/panel.csv")
    assert raw.schema == ANALYSIS_SCHEMA and raw.count() == 401
    panel = clean_panel(raw, ANALYSIS_TARGETS)
    assert {r[0] for r in panel.select("cod_grupo").distinct().collect()} == {"Bajo", "Medio bajo", "Medio", "Medio alto", "Alto"}
    profile = profile_panel(panel)
    assert profile.summary.count() == 6 and profile.correlations.count() == 36
    boxes = profile.boxes["cod_grupo", "prom_mate2m_rbd"].collect()
    assert [b["cod_grupo"] for b in boxes] == ["Bajo", "Medio bajo", "Medio", "Medio alto", "Alto"]
    assert sum(r["rows"] for r in profile.histograms["prom_lect2m_rbd"].collect()) == panel.count()
    assert profile.scatter["prom_mate2m_rbd"].count() == 4 * panel.count()
    done = fit_and_compare(panel, ANALYSIS_NUMERIC, ANALYSIS_CATEGORICAL, ANALYSIS_TARGETS, "rbd", ["rbd", "agno"])
    table = {r["metric"]: r for r in done.comparison.collect()}
    assert table["R2"]["prom_mate2m_rbd"] > 0.9 and table["R2_CV"]["prom_mate2m_rbd"] > 0.9
    seen = interpret(done, "prom_mate2m_rbd")
    assert len(seen.top.collect()) == 5
    assert sum(r["rows"] for r in seen.residuals.collect()) == seen.points.count() == done.scored.count()
    lo, hi = seen.line.first()
    assert lo < hi

    joined = spark.createDataFrame([(1, 2020, "2m", 1.0, 2.0, 3.0), (1, 2020, "4b", 9.0, 9.0, 9.0)],
        "rbd bigint, agno int, curso string, prom_mate_rbd double, prom_lect_rbd double, idps_am double")
    [row] = analysis_table(joined).collect()
    assert (row["prom_mate2m_rbd"], row["ind_am"], row["ind_cc"]) == (1.0, 3.0, None)


def test_details_join_the_indicators(spark):
    from panelflow.plans.indicators import add_details

    keys = "rbd bigint, agno int, curso string"
    main = spark.createDataFrame([(1, 2020, "2m"), (2, 2020, "2m")], keys)
    details = spark.createDataFrame([(1, 2020, "2m", "AM", "AA", "4"), (1, 2020, "2m", "am", "aa", "6"), (1, 2020, "2m", "pf", "vd", "*")],
        keys + ", ind string, dim string, prom string")
    got = {r["rbd"]: r for r in add_details(main, details).collect()}
    assert got[1]["dim_am_aa"] == 5.0 and got[1]["dim_pf_vd"] is None and got[2]["dim_am_aa"] is None
    assert len(got[1]) == 3 + 11


def test_cleaning_takes_codes_in_any_spelling(spark):
    rows = [("1.0", "2", "Urbano", float(v), 10.0) for v in range(20)] + [("Bajo", "2.0", "2", 500.0, 10.0), (None, "1", "1", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "cod_grupo string, cod_depe2 string, cod_rural_rbd string, y double, z double")
    out = clean_panel(df, ["y", "z"])
    assert out.count() == 20
    assert {tuple(r)[:3] for r in out.collect()} == {("Bajo", "Particular subvencionado", "Urbano")}
    everything = clean_panel(df, [])
    assert {r["cod_rural_rbd"] for r in everything.collect()} == {"Urbano", "Rural"}


def test_line_breaks_in_quotes_lose_neither_files_nor_rows(spark, tmp_path):
    put(f"{tmp_path}/q2m2016_rbd.csv", [["rbd", "nom_rbd", "prom_mate_rbd", "prom_lect_rbd"],
        [1, '"line one\nline, two, with, commas, and, more"', 1, 2], [2, '"a ""quoted"" name"', 3, 4]])
    put(f"{tmp_path}/r2m2016_rbd.csv", [["rbd", "nom_rbd", "prom_mate_rbd", "prom_lect_rbd"], [3, '"one\ntwo"', 5, 6], [4, "plain", 7, 8]])
    put(f"{tmp_path}/h2m2016_rbd.csv", [["rbd", '"name\nof it"', "prom_mate_rbd", "prom_lect_rbd"], [5, "x", 9, 10]])
    put(f"{tmp_path}/w2m2016_rbd.csv", [["rbd", "nom_rbd", "prom_mate_rbd", "prom_lect_rbd"], [6, '"one\ntwo"', 5, 6], [7, "x", 1, 2, 3]])
    put(f"{tmp_path}/v2m2016_rbd.csv", [["rbd", "nom_rbd", "prom_mate_rbd", "prom_lect_rbd"], [8, '"one\ntwo"', 5, 6, ""], [9, "short", 1]])
    put(f"{tmp_path}/p2m2016_rbd.csv", [["rbd", "nom_rbd", "prom_mate_rbd", "prom_lect_rbd"], [10, "plain", 5, 6]])
    done = consolidate_scores(spark, str(tmp_path))
    assert [(r["rbd"], r["prom_lect_rbd"]) for r in done.table.orderBy("rbd").collect()] == [(1, 2.0), (2, 4.0), (3, 6.0), (4, 8.0), (5, 10.0), (10, 6.0)]
    aside = {os.path.basename(r["file"]): r["reason"] for r in done.quarantine.collect()}
    assert aside == {f"{k}2m2016_rbd.csv": "5 fields in a line, 4 in the header" for k in "vw"}
    [audit] = done.audit.collect()
    assert (audit["rows_in"], audit["rows_out"]) == (6, 6)


def test_files_without_such_breaks_stay_splittable(spark, tmp_path):
    put(f"{tmp_path}/big.csv", [["a", "b"], *[[i, '"q, x"'] for i in range(2000)]])
    put(f"{tmp_path}/broken.csv", [["a", "b"], *[[i, '"q\nx"'] for i in range(2000)]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        reading = read_delimited(spark, [f"{tmp_path}/big.csv", f"{tmp_path}/broken.csv"])
        parts = sorted(f.rdd.getNumPartitions() for f in reading.frames)
        assert [f.count() for f in reading.frames] == [2000, 2000]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts[0] > 4 and parts[1] > 4


def messy(k):
    """A record with whatever well-formed files hold."""
    kinds = [
        f'{k},plain,,"",x', f'{k},"two\nlines",a,b,c', f'{k},"{"many" * 20}\n\n\n""said"", he\r\nthen left",a,b,""', f'"{k}","a, b",é,"ñ\n",漢', f"{k},short",
        f'{k},"""",a, b ,c', f'{k},"\n",,,',
    ]
    return kinds[k % len(kinds)]


def test_records_over_many_splits_are_those_of_the_whole_file(spark, tmp_path):
    for name, encoding, end in (("a", "utf-8", "\n"), ("b", "utf-8", "\r\n"), ("c", "latin-1", "\n")):
        lines = ["k,\"v\n1\",w,x,y", *[messy(k) for k in range(1, 700)]]
        text = end.join(lines) if name == "a" else end.join(lines) + end
        os.makedirs(f"{tmp_path}/{name}")
        with open(f"{tmp_path}/{name}/f.csv", "wb") as f:
            f.write(text.encode(encoding, "replace" if encoding == "latin-1" else "strict"))
        path = f"{tmp_path}/{name}/f.csv"
        reader = spark.read.option("multiLine", True).option("escape", '"').option("encoding", "ISO-8859-1" if encoding == "latin-1" else "UTF-8")
        want = [tuple(r) for r in reader.schema("_c0 string, _c1 string, _c2 string, _c3 string, _c4 string").csv(path).collect()]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            records = quoted_records(spark, [path], "ISO-8859-1" if encoding == "latin-1" else "UTF-8")
            fields = parsed(records, ",", 5).orderBy("_block", "_row").select("_c0", "_c1", "_c2", "_c3", "_c4")
            # the parser takes the break in the header for the file's line end, so it leaves the other half on the last field
            bare = lambda r: tuple(c if c is None else c.removesuffix("\r") or (None if c == "\r" else c) for c in r)
            assert [tuple(r) for r in fields.collect()] == [bare(r) if end == "\r\n" else r for r in want]
            assert records.agg(F.count_distinct("block")).first()[0] > 20
            [fact] = record_facts(records, ",").collect()
            assert fact["clean"] and fact["fields"] == 5
            [frame] = read_delimited(spark, [path]).frames
            assert frame.count() == len(want) - 1
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("stray", ['3,5" pipe,x', '3,"open,x', '3,"a" b,x', '3,a\rb,x', "3,\x01,x"])
def test_files_with_stray_quotes_are_read_whole(spark, tmp_path, stray):
    path = f"{tmp_path}/f.csv"
    with open(path, "w", newline="") as f:
        f.write(f'a,b,c\n1,"x\ny",z\n{stray}\n4,p,q\n')
    want = spark.read.option("multiLine", True).option("escape", '"').schema("a string, b string, c string").csv(path).collect()[1:]
    frames = read_delimited(spark, [path]).frames
    got = [tuple(r)[:3] for f in frames for r in f.orderBy("_block", "_row").collect()]
    assert not frames or got == [tuple(r) for r in want]
