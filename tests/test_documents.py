import json

import pytest
from pyspark.sql import functions as F

from lodestrata import cli, parameters
from lodestrata.operators import einsum, export, graph, layout, linkage, prompts, quality, ranking, relational, taxonomy


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_scores(spark):
    s = "doc string, k int, name string, id string, zn double, fe double, method string, mineral string, year string, clash string"
    data = [("a", 1, "n", "s1", 5.0, -99999.0, "EPMA", "galena", "2001", "x"), ("a", 2, None, "s2", 2e6, None, None, None, None, "x"), ("b", 1, None, "nan", None, None, "guess", "unobtainium", "1066", "x")]
    q = {r.doc: r for r in quality.quality_scores(spark.createDataFrame(data, s), ["doc"], ["k"], ["name", "method"], {"zn": "zn", "fe": "fe"}, ["id"], "method", "mineral", "year", tracked=2).collect()}
    assert (q["a"].metadata, q["a"].elements, q["a"].ids, q["a"].plausibility, q["a"].consistency) == (100.0, 100.0, 100.0, 50.0, 100.0) and q["a"].issues == "zn: too high"
    assert (q["b"].elements, q["b"].ids, q["b"].plausibility, q["b"].consistency) == (0.0, 0.0, 100.0, 16.67) and "no sample ids" in q["b"].issues and "unusual year" in q["b"].issues
    assert quality.quality_scores(spark.createDataFrame([], s), ["doc"], ["k"], ["name"], {"zn": "zn"}, ["id"], "method", "mineral", "year").count() == 0


def test_tables_names_and_ids(spark):
    t = spark.createDataFrame([("a", i, ["x", "1", "2"]) for i in range(3)] + [("b", 0, ["x", None, ""]), ("c", 0, ["1"] * 9)], "t string, row_no int, cells array<string>")
    assert rows(quality.is_data_table(t, ["t"])) == [("a", True), ("b", False), ("c", False)]
    n = spark.createDataFrame([("Table 1. Summary", []), ("x", ["a", "Mean of 3"]), (None, ["a"] * 5 + ["mean"])], "c string, f array<string>")
    assert [r[0] for r in n.select(quality.is_summary_table(F.col("c"), F.col("f"))).collect()] == [True, True, False]
    ids = spark.createDataFrame([(None, "b1"), (" ", "b2"), ("note: x", "b2"), ("z" * 101, None)], "a string, b string")
    assert rows(quality.id_list(ids, ["a", "b"])) == [("b1",), ("b2",)] and quality.id_list(ids.limit(0), ["a"]).count() == 0
    c = spark.createDataFrame([("<0.5",), ("bdl",), ("n/a",), ("1e3",), ("approx",), (None,), ("<x",)], "c string").select(quality.corrected_cell(F.col("c")).alias("c"))
    assert [(r.c.kind, r.c.value, r.c.text) for r in c.collect()] == [("limit", -0.5, None), ("bdl", -99999.0, None), ("none", None, None), ("number", 1000.0, None), ("text", None, "approx"), ("none", None, None), ("text", None, "<x")]
    assert [r[0] for r in spark.createDataFrame([("K1-2@L3",), ("K1-2-spot4",), (None,)], "s string").select(quality.base_sample_id(F.col("s"))).collect()] == ["K1-2", "K1-2", None]


def test_registry(spark):
    docs = spark.createDataFrame([("a.pdf", "t"), ("b.pdf", ""), (None, "t"), ("Report A.pdf", None)], "f string, text string")
    done = spark.createDataFrame([("a.pdf",), ("a.pdf",), (None,)], "f string")
    assert rows(quality.registry_state(docs, done, "f", ["text"]).select("f", "state")) == sorted([("a.pdf", "done"), ("b.pdf", "incomplete"), (None, "ready"), ("Report A.pdf", "incomplete")], key=repr)
    asked = spark.createDataFrame([("a.pdf",), ("report",), ("zzz",), (None,)], "w string")
    assert rows(quality.find_document(docs, asked, "f")) == [("a.pdf", "a.pdf"), ("report", "Report A.pdf")]
    o = spark.createDataFrame([("k", "y", 2), ("k", "x", 3), ("k", "y", 9), ("k", None, 1)], "k string, v string, o int")
    assert rows(quality.distinct_in_order(o, ["k"], "v", ["o"])) == [("k", ["y", "x"], 2)]


def test_sets_and_levels(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "n string"), spark.createDataFrame([("y", 1), ("z", 2)], "n string, q int")
    assert rows(relational.set_sides(a, b, "n")) == [("x", "left"), ("y", "both"), ("z", "right")]
    assert rows(relational.column_sides(a, b)) == [("n", "both"), ("q", "right")]
    t = spark.createDataFrame([("Q1", "g", "e"), ("q1", "h", "e"), (None, "x", "x")], "type_id string, g string, e string")
    assert rows(taxonomy.with_levels(spark.createDataFrame([(1, "q1"), (2, "Q9"), (3, None)], "r int, type_id string"), t, "type_id", ["g", "e"])) == [(1, "q1", "g", "e"), (2, "Q9", "", ""), (3, None, "", "")]


def test_linkage_by_stage_and_offset(spark):
    asked = spark.createDataFrame([("d", "A1"), ("d", "b2 "), ("d", "c3"), ("d", None), ("e", "A1")], "doc string, w string")
    have = spark.createDataFrame([("d", "A1", "x"), ("d", "a1", "y"), ("d", "B2", "z"), ("d", None, "C3")], "doc string, name string, local string")
    assert rows(linkage.staged_hits(asked, have, ["doc"], "w", ["name", "local"])) == [("d", "A1", 1, "A1"), ("d", "b2 ", 2, "B2"), ("d", "c3", 3, "C3")]
    t = spark.createDataFrame([("d", i, float(i * i + 1)) for i in range(1, 9)], "doc string, i int, v double")
    p = t.select("doc", (F.col("i") + 3).alias("i"), (F.col("v") * 1.02).alias("v")).unionByName(spark.createDataFrame([("d", 1, None), ("z", 1, 1.0)], "doc string, i int, v double"))
    got = rows(linkage.offset_pairs(p, t, ["doc"], "i", ["v"]))
    assert [(a, b, o) for _, a, b, o in got] == [(i, i + 3, 3) for i in range(1, 9)]


def test_rankings(spark):
    s = spark.createDataFrame([("r", 1, "a", 0.0), ("r", 1, "b", 0.0), ("r", 2, "a", 0.0), ("r", 2, "b", None)], "rec string, c int, o string, p double")
    got = {r.o: r.p for r in ranking.chunk_softmax(s, "rec", "c", "o", "p").collect()}
    assert got["a"] == pytest.approx(-0.28768, abs=1e-4) and got["b"] == pytest.approx(-1.38629, abs=1e-4)
    x = spark.createDataFrame([("r", "a", 1.0), ("r", "b", 1.0), ("r", "c", 3.0), ("r", "d", None)], "rec string, o string, s double")
    assert rows(ranking.shortlist(x, "rec", "o", "s", 2, above=1.0).select("o", "rank")) == [("c", 1)] and rows(ranking.shortlist(x, "rec", "o", "s", 2, at_least=1.0).select("o", "rank")) == [("a", 2), ("c", 1)]
    w = ranking.score_columns(ranking.wide_scores(x, "rec", "o", "s", 2), ["c", "zz"]).collect()[0]
    assert (w.top_1, w.top_2, w.score_zz) == ("c", "a", 0.0) and w.score_c == w.top_1_p
    r = spark.createDataFrame([(1, "own"), (2, "own"), (3, None)], "k int, f string")
    c = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "c", 0.1)], "k int, n string, s double")
    assert rows(ranking.apply_best(r, c, "k", "n", "s", "f", 0.3)) == [(1, "a", 0.5), (2, "own", None), (3, None, None)]
    m = ranking.merged_candidates(*[spark.createDataFrame([("r", "a", v)], "record string, name string, score double") for v in (0.2, 0.7)])
    assert rows(m.select("name", "score", "rank")) == [("a", 0.7, 1)]


def test_layout(spark):
    f = spark.createDataFrame([("x/2022_Tiu.csv",), ("Plain",), (None,)], "p string").select(layout.file_stem(F.col("p")), layout.leading_year(F.col("p")))
    assert [tuple(r) for r in f.collect()] == [("2022_Tiu", 2022), ("Plain", None), (None, None)]
    b = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0, 100.0, 200.0), (1.0, 1.0, 1.0, 1.0, 0.0, 5.0)], "x double, y double, w double, h double, a double, b double")
    rel = b.select(layout.relative_box(*[F.col(c) for c in "xywhab"]).alias("r"), "a", "b")
    assert rel.collect()[1].r is None and tuple(rel.select(layout.absolute_box(F.col("r"), F.col("a"), F.col("b")).alias("z")).collect()[0].z) == pytest.approx((10, 20, 30, 40))
    g = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, -1.0), (2, 0.0), (3, None)], "page int, dy double")
    assert rows(layout.rotated_pages(g, ["page"], "dy")) == [(1, True), (2, False), (3, False)]
    t = spark.createDataFrame([("d", "a\nb\n| x |\n| y |\nc\nd\n|z|"), ("e", None), ("f", "none")], "doc string, t string")
    assert rows(layout.table_sections(t, "doc", "t", before=1)) == [("d", 1, "b\n| x |\n| y |\nc"), ("d", 2, "d\n|z|")]
    r = spark.createDataFrame([("d", 5, 3), ("d", 2, 9), ("x", 6, 6)], "doc string, n_cols int, n_rows int")
    v = spark.createDataFrame([("d", "zn", 1.0), ("d", "fe", -2.0), ("d", "cd", None)], "doc string, el string, v double")
    assert rows(layout.regions_with_truth(r, v, "doc", "el", "v")) == [("d", 5, 3, ["zn"], True), ("x", 6, 6, [], False)]


def test_graphs(spark):
    s = "doc_id string, sample_name string, analysis_id string, deposit_name string, deposit_type_original string, mineral string, analytical_method string, publication_date int, zn_ppm double, lab string"
    g = spark.createDataFrame([("d", "A@1", "x", "North", "vein", "Pyrite", "EPMA", 2001, 5.0, "L"), ("d", "A@2", "x", None, None, None, None, None, -99999.0, None), (None, "B", "y", None, None, None, None, None, 1.0, None)], s)
    nodes, edges = graph.extraction_graph(g, ["zn"], {"laboratory": "lab"})
    assert rows(nodes.groupBy("type").count()) == sorted([("paper", 1), ("deposit", 1), ("type", 1), ("sample", 1), ("analysis", 2), ("mineral", 1), ("method", 1), ("measurement", 2), ("element", 1), ("laboratory", 1)], key=repr)
    assert graph.valid_edges(edges, nodes).count() == edges.count() and {r.type for r in edges.collect()} == {"contains", "analyzed_by", "target_mineral", "used_method", "classified_as", "measured", "part_of", "performed_at"}
    assert rows(graph.analysis_rows(nodes, edges, ["zn"])) == [("analysis:A@1:x", 5.0), ("analysis:A@2:x", None)]
    e = spark.createDataFrame([("d", [("s", "m", None), (None, "m", "q")]), (None, [("s", "m", "q")]), ("e", [])], "doc string, samples array<struct<name:string,mineral:string,method:string>>")
    n, links = graph.entity_graph(e, "doc", "samples")
    assert n.count() == 3 and rows(links.select("type")) == [("CONTAINS_MINERAL",), ("REPORTS",)]
    assert rows(graph.get_nodes(n, spark.createDataFrame([("mineral:m",), ("zz",)], "id string")).select("id")) == [("mineral:m",)]


def test_tensors(spark):
    assert len(einsum.set_partitions(4)) == 15 and einsum.symbolic_terms(1, 1) == ["a->a", "a->b"] and "aa->a" in einsum.symbolic_terms(2, 1)
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "a int, a2 int, v double")
    assert rows(einsum.einsum_expanded("aa->a", a, domains={})) == [(0, 1.0), (1, 3.0)]
    x = spark.createDataFrame([(0, 2.0)], "a int, v double")
    d = spark.createDataFrame([(7,), (8,)], "b int")
    assert rows(einsum.einsum_expanded("a->aab", x, domains={"b": d})) == [(0, 0, 7, 2.0), (0, 0, 8, 2.0)]
    v = spark.createDataFrame([(0, i, float(i)) for i in range(2000)], "r int, s int, v double")
    assert rows(einsum.masked_pooling("rs->r", v, v.withColumn("v", (F.col("s") < 3).cast("double")))) == [(0, sum(range(2000)) / 3)]
    assert einsum.sampled_einsum("rs->r", v, sizes={"r": 1, "s": 2000}, share=0.5).collect()[0].v == pytest.approx(sum(range(2000)), rel=0.2)
    assert einsum.sampled_einsum("rs->r", v, sizes={"r": 1, "s": 2000}, share=1.0).collect()[0].v == sum(range(2000))


def test_exports(spark, tmp_path):
    s = spark.createDataFrame([("d 1", "s", 1.5, None), ("d 1", "s", -99999.0, 2.0), ("e", None, None, None)], "doc string, name string, zn_ppm double, fe_ppm double")
    out = export.with_context(export.linked_samples(s, ["zn", "fe"], "https://e/", ["doc", "name"]), {"@vocab": "https://v/"}).collect()
    j = json.loads(out[0].value)
    assert len(out) == 1 and j["@context"] == {"@vocab": "https://v/"} and j["@id"] == "https://e/d_1/s" and [(m["element"], m.get("ppm"), m["below_detection"]) for m in j["measurements"]] == [("fe", 2.0, False), ("zn", None, True), ("zn", 1.5, False)]
    docs = spark.createDataFrame([("r/1", 'a "q"\n')], "record_id string, name string")
    assert json.loads(export.linked_data(docs, "https://e/").collect()[0].value) == {"@id": "https://e/r_1", "@type": "MineralSite", "record_id": "r/1", "name": 'a "q"\n'}
    export.write_sheet(docs, f"{tmp_path}/c")
    assert spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/c").columns == ["record_id", "name"]
    assert export.write_report({"ok": docs, "bad": docs.select(F.raise_error(F.lit("x")).alias("c"))}, f"{tmp_path}/r")[0].startswith("bad: ") and spark.read.json(f"{tmp_path}/r/ok").count() == 1
    export.save_tables({"docs": docs}, f"{tmp_path}/t")
    assert export.load_tables(spark, f"{tmp_path}/t", ["docs"])["docs"].count() == 1
    export.write_splits(s, "doc", f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").where("doc = 'e'").count() == 1


def test_prompts_and_hints(spark):
    t = spark.createDataFrame([("E", "G", "b"), ("E", "G", "a"), ("E", None, "c"), ("E", "G", None)], "e string, g string, x string")
    assert prompts.listing(t, ["e", "g"], "x", "Env").collect()[0].text == "Env E (3):\n  :\n    - c\n  G:\n    - a\n    - b"
    assert spark.range(1).select(prompts.filled("a {x} b {y}", x=F.lit(3), y=F.lit(None).cast("string"))).collect()[0][0] == "a 3 b "
    a = spark.createDataFrame([(1, ["Zn (ppm)", "unobtainium", "zinc", "Fe"]), (2, None)], "k int, els array<string>")
    assert rows(prompts.known_symbols(a, ["k"], F.col("els"))) == [(1, ["fe", "zn"]), (2, [])]

    def extract(h):
        if h["n"] == 9:
            raise ValueError("no")
        return spark.range(h["n"])

    best = prompts.best_by_quality(extract, [{"n": 9}, {"n": 2}, {"n": 5}, {"n": 5, "x": 1}], lambda df: df.count() / 10)
    assert best[0] == {"n": 5} and best[1] == 0.5
    with pytest.raises(ValueError):
        prompts.best_by_quality(extract, [{"n": 9}], lambda df: 1.0)


def test_parameters_and_command_line(capsys):
    d = {"a": {"b": 1, "on": True}, "l": [1], "s": "x"}
    assert parameters.with_words(d, ["a.b=3", "a.on=no", "l=[2]", "s=7"]) == {"a": {"b": 3, "on": False}, "l": [2], "s": "7"} and d["a"]["b"] == 1
    for bad in (["a.c=1"], ["a.b=x"], ["a.b"], ["l={}"]):
        with pytest.raises((KeyError, ValueError)):
            parameters.with_words(d, bad)
    assert parameters.merged(d, {"a": {"b": 2}})["a"] == {"b": 2, "on": True}
    assert cli.main(["list"]) == 0 and "tier_overall" in capsys.readouterr().out


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from lodestrata.session import checkpoint_dir

    conf = SimpleNamespace(get=lambda k, d=None: d)
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_golden_rows_of_queries_without_sql(spark, tiny):
    """What SQL doesn't check is held to values: GraphML elements, greedy links, salvaged answers, lines by position, text tables."""
    import xml.etree.ElementTree as ET

    from lodestrata.operators import text
    from lodestrata.plans import reference_queries as rq

    values = [r.value for r in rq.QUERIES["graphml_elements"](spark, tiny).collect()]
    parsed = [ET.fromstring(v) for v in values]  # each is well-formed
    ids = {e.get("id") for e in parsed if e.tag == "node"}
    assert len(ids) == sum(e.tag == "node" for e in parsed) and all(e.get("source") in ids and e.get("target") in ids for e in parsed if e.tag == "edge")
    nodes = spark.createDataFrame([('a"<&', "T", {"k": "1 > 0"})], "id string, type string, properties map<string,string>")
    edges = spark.createDataFrame([], "src string, dst string, type string, properties map<string,string>")
    assert [r.value for r in export.graphml(nodes, edges).collect()] == ['<node id="a&quot;&lt;&amp;"><data key="type">T</data><data key="k">1 &gt; 0</data></node>']

    links = rq.QUERIES["prefix_linkage"](spark, tiny).collect()
    chosen = {tuple(r) for r in rq.QUERIES["greedy_match"](spark, tiny).collect()}
    want, used = set(), set()
    for r in sorted(links, key=lambda r: (str(r.doc_id), r.stage, r.truth_name, r.pred_name)):
        if (r.doc_id, 0, r.pred_name) not in used and (r.doc_id, 1, r.truth_name) not in used:
            used |= {(r.doc_id, 0, r.pred_name), (r.doc_id, 1, r.truth_name)}
            want.add(tuple(r))
    assert chosen == want

    kept = {r.event_id: r.value for r in rq.QUERIES["json_salvage"](spark, tiny).collect()}
    props = {r.event_id: json.loads(r.props) for r in spark.read.parquet(f"{tiny}/events.parquet").select("event_id", "props").collect()}
    for i, v in kept.items():  # up to two items survive, whole ones only, and what is there is right
        items = json.loads(v)["samples"] if v else []
        assert items in ([], [props[i]], [props[i]] * 2) and (i % 9 > 2 or len(items) == 2)

    p = spark.createDataFrame([([(10.0, 5.0, "b"), (12.0, 1.0, "a"), (16.0, 0.0, "c"), (30.0, 2.0, "e"), (30.0, 1.0, "d"), (None, 1.0, "z")],), ([],), (None,)], "w array<struct<y:double,x:double,text:string>>")
    assert [r[0] for r in p.select(text.anchored_lines(F.col("w"))).collect()] == [["z", "a b", "c", "d e"], [], None]

    doc = "Table 1\nSpot Zn Fe Cd Ge\n1 12 3.4 <0.1 5\n2 11 - 0.2 6\nword\n3 9 8 7 6\nend of it all here"
    t = spark.createDataFrame([("d", doc), ("e", None)], "doc string, t string")
    assert [(r.row_no, r.cells) for r in text.text_tables(t, "doc", "t").collect()] == [(0, ["Spot", "Zn", "Fe", "Cd", "Ge"]), (1, ["1", "12", "3.4", "<0.1", "5"]), (2, ["2", "11", "-", "0.2", "6"]), (3, ["3", "9", "8", "7", "6"])]
