"""Small fixtures and properties of the reference operators that SQL over the driver's tables does not reach."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import censored
from lodestrata.functions.elements import header_symbol
from lodestrata.operators import einsum, export, graph, linkage, model_calls, relational, rollup, scoring, shaping, taxonomy, text
from lodestrata.sources import grids
from lodestrata.streaming import events


def one(spark, expr, *values):
    return spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if v is None or isinstance(v, str) else 'double'}" for i, v in enumerate(values))).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("cell,value,status,lod", [("bdl", None, "bdl", None), ("--", None, "bdl", None), ("<LOD", None, "bdl", None), ("<0.5", None, "bdl_lod", 0.5), ("< 0.01 ppm", None, "bdl_lod", 0.01), ("<0", None, "bdl", None), ("<abc", None, "bdl", None), ("n/a", None, None, None), ("", None, None, None), (None, None, None, None), (">12.5", 12.5, "value", None), ("> x", None, None, None), ("50,525", 50525.0, "value", None), (" 5.03 ", 5.03, "value", None), ("1e5", 1e5, "value", None), ("1d", None, None, None), ("12 ppm", None, None, None), ("nan", None, None, None), ("0", 0.0, "value", None)])
def test_cells(spark, cell, value, status, lod):
    r = one(spark, censored.parse_cell(F.col("c0")), cell)
    assert (r.value, r.status, r.lod) == (value, status, lod)


@pytest.mark.parametrize("header,symbol", [("Pb (ppm)", "pb"), ("V51_ppm_mean", "v"), ("57Fe", "fe"), ("Mn55_ppm_LOD", None), ("Fe2O3", None), ("B6", None), ("B291152", None), ("Silver", "ag"), ("Cd_ppm_m111", "cd"), ("Zn_ppm_content", "zn"), ("", None), (None, None), ("Total", None)])
def test_headers(spark, header, symbol):
    assert one(spark, header_symbol(F.col("c0")), header) == symbol


def test_scores(spark):
    for err, want in ((0, 1), (0.05, 1), (0.525, 0.5), (1.0, 0)):
        assert one(spark, scoring.numeric_score(F.col("c0"), F.col("c1")), 100.0 * (1 + err), 100.0) == pytest.approx(want, abs=1e-9)
    assert one(spark, scoring.numeric_score(F.col("c0"), F.col("c1")), 0.0005, 0.0) == 1.0


def test_join_keeps_left_of_clashing_names(spark):
    a = spark.createDataFrame([(1, None, "l"), (2, "x", "l")], "id int, k string, v string")
    b = spark.createDataFrame([(None, "r", 7), ("x", "r", 8), ("x", "r", 9)], "k string, v string, w int")
    got = sorted((r.id, r.k, r.v, r.w) for r in relational.join_nullsafe(a, b, "k", "k").collect())
    assert got == [(1, None, "l", 7), (2, "x", "l", 8), (2, "x", "l", 9)]
    assert relational.join_nullsafe(a, b.limit(0), "k", "k", "left").where("w IS NULL").count() == 2


def test_position_over_partitions(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("v"))
    got = relational.with_position(df, [F.col("v")]).orderBy("row_index").collect()
    assert [r.v for r in got] == list(range(1000)) and [r.row_index for r in got] == list(range(1000))


def test_union_of_two_types_raises(spark):
    with pytest.raises(ValueError):
        relational.union_all(spark.range(1), spark.range(1).select(F.col("id").cast("string")))


def grid(spark, rows, source="a"):
    return spark.createDataFrame([(source, "s", i, r) for i, r in enumerate(rows)], "source_id string, sheet string, row_idx int, cells array<string>")


def test_header_profile_and_units(spark):
    g = grid(spark, [["Table 1", "", "", ""], ["", "", "", ""], ["Spot", "Fe (ppm)", "Zn", "Note"], ["a1", "1", "2", "x"], ["a2", "<3", "", ""], ["a3", "4", "5", ""]])
    h = shaping.header_rows(g).collect()
    assert [(r.header_row, r.symbols) for r in h] == [(2, 2)]
    p = {r.raw_name: r for r in shaping.column_profile(g).collect()}
    assert p["Fe (ppm)"].symbol == "fe" and p["Zn"].coverage == pytest.approx(2 / 3) and p["Spot"].uniqueness == 1 and p["Spot"].numeric_share == 0
    u = shaping.unit_rows(grid(spark, [["", "wt%", "wt%"], ["a", "1", "2"]])).collect()
    assert [(r.row_idx, r.unit) for r in u] == [(0, "wt%")]
    assert shaping.header_rows(g.limit(0)).count() == 0


def test_sample_rows(spark):
    ids = ["Mean", "K21-01", "G_NIST610", "Py2(n=24)", None, "  ", "* calculated", "BHVO-2", "Note: x", "a" * 90, "MT-4"]
    df = spark.createDataFrame([(i,) for i in ids], "s string")
    assert [r.s for r in df.where(shaping.is_sample_row(F.col("s"))).collect()] == ["K21-01", "MT-4"]


def test_cap(spark):
    rows = [("a", i, i == 0) for i in range(4)] + [("b", i, i < 5) for i in range(10)]
    kept = shaping.cap_removal(spark.createDataFrame(rows, "k string, i int, f boolean"), ["k"], ["i"], "f").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in kept} == {"a": 3, "b": 8}


def test_name_links(spark):
    p = spark.createDataFrame([("d", n) for n in ("X - 1", "K21-01@L3", "K21", None)], "doc string, n string")
    t = spark.createDataFrame([("d", n) for n in ("X-1", "K21-01", "K2", "K21")], "doc string, n string")
    got = {(r.pred_name, r.truth_name): r.stage for r in linkage.name_links(p, t, "n", ["doc"]).collect()}
    assert got == {("X - 1", "X-1"): 2, ("K21-01@L3", "K21-01"): 3, ("K21", "K21"): 1, ("K21-01@L3", "K21"): 3, ("K21", "K21-01"): 3}
    links = linkage.name_links(p, t, "n", ["doc"])
    chosen = linkage.one_to_one(links, ["doc"], "pred_name", "truth_name", ["stage", "truth_name", "pred_name"]).collect()
    assert len({r.pred_name for r in chosen}) == len({r.truth_name for r in chosen}) == len(chosen) == 3


def test_fingerprints(spark):
    s = "doc string, {} int, a double, b double"
    p = spark.createDataFrame([("d", 1, 100.0, 5.0), ("d", 2, 3.0, -99999.0)], s.format("p"))
    t = spark.createDataFrame([("d", 7, 104.0, 50.0), ("d", 8, 9.0, 1.0)], s.format("t"))
    got = [(r.p, r.t, r.share) for r in linkage.fingerprint_links(p, t, ["doc"], "p", "t", ["a", "b"]).collect()]
    assert got == [(1, 7, 0.5)]


def test_prefix_join(spark):
    a = spark.createDataFrame([("2022_Tiu_x",), ("zzz",), (None,)], "f string")
    b = spark.createDataFrame([("2022",), ("2022_Tiu",)], "p string")
    assert {r.f: r.p for r in linkage.prefix_join(a, b, "f", "p").collect()} == {"2022_Tiu_x": "2022_Tiu", "zzz": None, None: None}


def test_similarity(spark):
    f = lambda a, b: one(spark, linkage.text_similarity(F.col("c0"), F.col("c1")), a, b)
    assert f("epma", "empa") == 0.75 and f("", "") == 1 and f("", "a") == 0 and f("a b", "b a") == 1 and f(None, "a") is None


def test_softmax_properties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", float("inf")), ("b", 0.0), ("c", None), ("c", 5.0)], "r string, s double")
    got = rollup.softmax(df, ["r"], "s").groupBy("r").agg(F.sum("p").alias("t"), F.max("p").alias("m")).collect()
    assert all(r.t == pytest.approx(1) for r in got) and {r.r: r.m for r in got}["b"] == 0.5


def test_windows(spark):
    w = lambda n: spark.range(1).select(text.overlapping_windows(F.sequence(F.lit(1), F.lit(n)), 4).alias("w")).first().w
    assert w(3) == [[1, 2, 3]] and w(4) == [[1, 2, 3, 4]] and w(7) == [[1, 2, 3, 4], [3, 4, 5, 6], [4, 5, 6, 7]]


def test_text_tables():
    page = "Title\nSpot No. Fe Zn Cu\nppm ppm ppm\na1 1 2 3\na2 - 5 6\n\na3 1 1 1\nText follows here and goes on.\n\nMore text, no numbers at all here.\n"
    assert text.tables_in_text(page) == [[["Spot", "No.", "Fe", "Zn", "Cu"], ["a1", "1", "2", "3", ""], ["a2", "-", "5", "6", ""], ["a3", "1", "1", "1", ""]]]
    assert text.tables_in_text("") == []


def test_pipe_tables(spark):
    d = spark.createDataFrame([(1, "x\n| A | B |\n|:--|--:|\n| 1 |\n| 1 | 2 | 3 |\n\n| C |\n| 4 |"), (2, None), (3, "")], "i int, t string")
    got = [(r.table_no, r.row_no, r.cells) for r in text.pipe_tables(d, "i", "t").orderBy("table_no", "row_no").collect()]
    assert got == [(1, 0, ["A", "B"]), (1, 1, ["1", ""]), (1, 2, ["1", "2"]), (2, 0, ["C"]), (2, 1, ["4"])]


def test_anchored_lines(spark):
    w = spark.createDataFrame([([(100.0, 5.0, "b"), (103.0, 1.0, "a"), (106.0, 0.0, "c")],)], "w array<struct<y:double,x:double,text:string>>")
    assert w.select(text.anchored_lines(F.col("w")).alias("l")).first().l == ["a b", "c"]


def test_salvage():
    assert text.salvage_json('```json\n{"a": [1, 2]}\n```') == {"a": [1, 2]}
    assert text.salvage_json('Sure: [{"a": 1}, {"a": 2}, {"a"') == [{"a": 1}, {"a": 2}]
    assert text.salvage_json('{"samples": [{"a": 1}, {"b"') == {"samples": [{"a": 1}]}
    assert text.salvage_json("none") is None and text.salvage_json(None) is None


def test_materials_and_names(spark):
    assert one(spark, text.reference_materials(F.col("c0")), "USGS sulfide MASS-1 (x), mass-1, NIST SRM610") == "MASS-1, NIST SRM610, SRM610"
    assert one(spark, text.plain_deposit_name(F.col("c0")), "Bainiu Zn-Sn polymetallic deposit") == "Bainiu"
    assert one(spark, text.plain_deposit_name(F.col("c0")), "Mine") == "Mine"


def test_einsum(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (1, 1, None)], "i int, j int, v double")
    b = spark.createDataFrame([(0, 0, 5.0), (1, 0, 7.0), (1, 1, 1.0)], "j int, k int, v double")
    assert sorted(tuple(r) for r in einsum.einsum("ij,jk->ik", a, b).collect()) == [(0, 0, 31.0), (0, 1, 3.0), (1, 0, 0.0), (1, 1, 0.0)]
    assert einsum.einsum("ij,jk->", a, b).first().v == 34.0
    cost, tree = einsum.plan("ab,bc,cd->ad", {"a": 2, "b": 100, "c": 2, "d": 100})
    assert tree in ((2, (0, 1)), ((0, 1), 2)) and cost > 0


def test_graph(spark):
    n = spark.createDataFrame([("x", "A", {"p": None, "q": "1"}), ("x", "A", {"p": "2"}), ("y", "B", {})], "id string, type string, properties map<string,string>")
    got = {r.id: r.properties for r in graph.merge_nodes(n).collect()}
    assert got == {"x": {"p": "2", "q": "1"}, "y": {}}
    e = spark.createDataFrame([("x", "y", "T", {}), ("x", "z", "T", {})], "src string, dst string, type string, properties map<string,string>")
    assert graph.valid_edges(e, n).count() == 1
    assert export.graphml(n.limit(1), e.limit(1)).count() == 2 and export.node_table(graph.merge_nodes(n)).columns == ["id", "type", "p", "q"]


def test_crosswalk_and_candidates(spark):
    r = spark.createDataFrame([(1, "Model 52f, also 85b."), (2, "none"), (3, None)], "id int, t string")
    t = spark.createDataFrame([("Q1", "52F"), ("Q2", "85b"), ("Q3", None)], "type_id string, usgs_num string")
    assert {x.id: x.type_ids for x in taxonomy.crosswalk(r, t, "id", "t").collect()} == {1: ["Q1", "Q2"], 2: [], 3: []}
    c = spark.range(1).select(export.type_candidates(F.array(F.lit("a"), F.lit("b")), "x").alias("c")).first().c
    assert [x.confidence for x in c] == [0.5, 0.5]


def test_sources(spark, tmp_path):
    import zipfile

    (tmp_path / "a.csv").write_bytes("﻿Spot;Fe\nä;1,5\n".encode())
    (tmp_path / "b.csv").write_bytes("Spot,Fe\n\xe4,1\n".encode("latin-1"))
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Data" r:id="r1"/><sheet name="LOD" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Spot</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "b.csv", "in/b.csv")
        z.writestr("__MACOSX/b.csv", "x")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    got = {(r.source_id.rsplit("/", 1)[1], r.sheet, r.row_idx): r.cells for r in grids.read_grids(spark, str(tmp_path)).collect()}
    assert got["a.csv", "", 1] == ["ä", "1,5"] and got["b.csv", "", 1] == ["ä", "1"] and got["w.xlsx", "Data", 0] == ["Spot", "", "7"] and got["z.zip", "in/b.csv", 1] == ["ä", "1"]
    assert ("bad.xlsx", "!error", 0) in got and not any(k[1] == "LOD" for k in got)


def test_html_and_records(spark, tmp_path):
    p = spark.createDataFrame([(1, "<table><tr><th>Fe</th><td> 1 <b>2</b></td></tr></table><table><tr><td>x</td></tr></table>"), (2, None)], "i int, h string")
    assert [(r.sheet, r.cells) for r in grids.html_tables(p, "i", "h").orderBy("sheet").collect()] == [("1", ["Fe", "1 2"]), ("2", ["x"])]
    (tmp_path / "r.json").write_text(json.dumps({"name": [{"name": "A"}], "geometry": {"coordinates": [[3, 4]]}, "commodity": ["Zn"]}))
    (tmp_path / "bad.json").write_text("{")
    got = {r.name: r for r in grids.record_fields(grids.read_records(spark, str(tmp_path))).collect()}
    assert (got["A"].lat, got["A"].lon, got["A"].commodity) == (4.0, 3.0, "Zn") and None in got


def test_model_calls(spark):
    p = spark.createDataFrame([("s", "ok"), ("s", "bad")], "system string, user string")

    def model(system, user):
        if user == "bad":
            raise RuntimeError("no")
        return '{"rows": [{"a": 1, "zzz": 2}]}'

    got = model_calls.answer_by_call(p, model, tries=2, wait=0.0)
    assert {r.user: r.error for r in got.collect()} == {"ok": None, "bad": "RuntimeError: no"}
    assert [(r.user, r.a) for r in model_calls.answer_rows(got, "rows", "a int", ["user"]).collect()] == [("ok", 1)]
    d = model_calls.dense_scores(spark.createDataFrame([("r", 1, -0.5)], "r string, o int, l double"), spark.range(3).select(F.col("id").cast("int").alias("o")), "r", "o", "l")
    assert d.count() == 3 and d.where("l < -40").count() == 2


def test_stream_equals_batch(spark, tiny, tmp_path):
    src = spark.read.parquet(f"{tiny}/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = events.windowed_counts(events.stream_folder(spark, str(tmp_path / "in"), src.schema), late="100 days")
    for _ in range(2):  # the second run finds nothing new
        events.run_available(stream, str(tmp_path / "ck"), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{i}"), mode="complete")
    first = spark.read.parquet(f"{out}/0")
    batch = events.windowed_counts(src.withColumn("ts", F.col("ts").cast("timestamp")))
    assert first.select("start", "event_type", "n").exceptAll(batch.select("start", "event_type", "n")).count() == 0 and first.count() == batch.count()


def test_text_export(spark, tmp_path):
    r = spark.createDataFrame([(1, i, f"v{i}") for i in range(30)], "k int, i int, v string")
    t = export.text_table(r, ["k"], "i", ["i", "v"], limit=3).first().text
    assert t == "i | v\n0 | v0\n1 | v1\n2 | v2\n... 27 more rows"
    export.write_rolled(r.coalesce(1), str(tmp_path / "o"), per_file=10)
    assert len(list((tmp_path / "o").glob("*.json"))) == 3


def test_positions_of_whole_rows_with_ties(spark):
    """Columns beside the order are carried, a value that holds most rows is spread, positions are those of the order."""
    from lodestrata.operators.relational import with_position

    rows = [(1 if i % 3 else i, i, f"x{i % 7}") for i in range(3000)]
    out = with_position(spark.createDataFrame(rows, "k int, v int, row_index_text string"), [F.col("k")]).collect()
    assert sorted(r.row_index for r in out) == list(range(3000)) and [r.k for r in sorted(out, key=lambda r: r.row_index)] == sorted(k for k, _, _ in rows)
    assert with_position(spark.createDataFrame([], "k int"), [F.col("k")]).count() == 0


def test_greedy_choice_equals_a_walk(spark):
    import random

    from lodestrata.operators.linkage import one_to_one

    r = random.Random(4)
    rows = sorted({(d, f"p{r.randrange(12)}", f"t{r.randrange(12)}", r.randrange(3)) for d in ("a", "b", None) for _ in range(60)}, key=str)
    rows = [x for i, x in enumerate(rows) if x[:3] not in {y[:3] for y in rows[:i]}]
    want = set()
    for d in ("a", "b", None):
        used = set()
        for s, p, t in sorted((s, p, t) for dd, p, t, s in rows if dd == d):
            if ("p", p) not in used and ("t", t) not in used:
                used |= {("p", p), ("t", t)}
                want.add((d, p, t, s))
    df = spark.createDataFrame(rows + rows[:5], "doc string, pred string, truth string, stage int")
    got = [tuple(x) for x in one_to_one(df, ["doc"], "pred", "truth", ["stage"]).collect()]
    assert len(got) == len(want) and set(got) == want
    assert one_to_one(df.limit(0), ["doc"], "pred", "truth", ["stage"]).count() == 0


def test_budgets_of_a_hot_key(spark):
    from lodestrata.operators.enrichment import page_budget
    from lodestrata.operators.text import character_budget

    rows = [("hot" if i % 3 else f"k{i % 50}", i, "ab" * (i % 5)) for i in range(2000)]
    want = {}
    for k, i, t in rows:
        left = 100 - sum(len(x) for _, x in want.get(k, []))
        if left > 0:
            want.setdefault(k, []).append((i, t[:left]))
    df = spark.createDataFrame(rows, "k string, i int, t string")
    got = sorted(tuple(x) for x in character_budget(df, ["k"], ["i"], "t", 100).collect())
    assert got == sorted((k, i, t) for k, xs in want.items() for i, t in xs)
    pages = [("hot" if i % 3 else f"k{i % 50}", i, None if i % 4 == 0 else float(i * 37 % 101), i % 90 == 0, 60) for i in range(2000)]
    kept = set()
    for k in {p[0] for p in pages}:
        mine = sorted((p for p in pages if p[0] == k), key=lambda p: (not p[3], p[2] is None, -(p[2] or 0), p[1]))
        kept |= {p[1] for n, p in enumerate(mine, 1) if p[3] or n <= 10 and p[2] is not None}
    df = spark.createDataFrame(pages, "doc string, page int, score double, must boolean, expected int")
    assert {r.page for r in page_budget(df, "doc", "page", "score", "must", "expected").collect()} == kept


def test_nearest_by_cosine_in_blocks(spark):
    import numpy as np

    from lodestrata.operators.rollup import nearest_by_cosine

    r = np.random.default_rng(1)
    m = r.normal(size=(120, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 5)
    want = {(i, j, n) for i in range(0, 120, 20) for n, j in enumerate([j for j in np.lexsort((np.arange(120), -sims[i])) if j != i][:3], 1)}
    got = nearest_by_cosine(df.where("id % 20 = 0"), df, "id", "v", 3, query_block=2, vector_block=30).collect()
    assert {(x.q, x.id, x.rank) for x in got} == want


def test_lookup_hot_and_rare(spark):
    from lodestrata.session import lookup

    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2), (None, 3)], "k string, v int")
    table = spark.createDataFrame([("a", 50, "A"), ("b", 1, "B")], "k string, n long, out string")
    for share in (2, 1, 10**6):
        got = sorted((r.k, r.v, r.out) for r in lookup(rows, table, ["k"], "n", share).collect())
        assert got == sorted([("a", i, "A") for i in range(50)] + [("b", 1, "B")])


def test_evaluation_edge_cases(spark):
    from lodestrata.operators.scoring import best_key_pair, evaluation

    s = "r string, k int, e double, m string"
    p = spark.createDataFrame([("a", 1, 1.0, "X"), ("a", 2, 5.0, None), ("b", 1, None, None), ("c", None, 1.0, "x")], s)
    t = spark.createDataFrame([("a", 1, 1.0, "x"), ("a", 3, 2.0, "y"), ("b", 1, None, None), ("c", None, 1.0, "x")], s)
    got = {x.report: x for x in evaluation(p, t, ["r", "k"], ["r"], ["e"], ["m"]).collect()}
    assert (got["a"].samples, got["a"].t1, got["a"].t2, got["a"].t3, got["a"].t4, got["a"].overall) == (1, 1.0, 1.0, 0.5, 1.0, 0.925)
    assert (got["b"].samples, got["b"].t1, got["b"].t2, got["b"].t4) == (1, 0.0, 1.0, 1.0) and (got["c"].samples, got["c"].t2) == (0, 0.0)
    assert evaluation(p.limit(0), t.limit(0), ["r", "k"], ["r"], ["e"], ["m"]).count() == 0
    a = spark.createDataFrame([("d", "x1", "q"), ("d", "X2 ", "q"), ("e", "", None)], "doc string, i string, j string")
    b = spark.createDataFrame([("d", "x1", "x2"), ("d", "x2", "x1")], "doc string, i string, j string")
    assert [tuple(r) for r in best_key_pair(a, b, ["doc"], ["i", "j"], ["i", "j"]).collect()] == [("d", "i", "i", 2, 1.0)]
