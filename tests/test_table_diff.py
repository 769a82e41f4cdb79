import datetime as dt

from pyspark.sql import functions as F

from lodestrata.operators.table_diff import SHEET_FIELDS, sheet_issues, table_diff

SCHEMA = "row_id bigint, analysis_id string, " + ", ".join(f"{f} {'double' if f.endswith('_ppm') else 'int' if f == 'publication_date' else 'string'}" for f in SHEET_FIELDS) + ", last_update timestamp, diffs string, side string"
T = dt.datetime(2024, 1, 1)


def row(i, key, t=T, **kw):
    return (i, key, *[kw.get(f) for f in SHEET_FIELDS], t, "x", "y")


def issues(spark, a, b):
    g, e = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    return sorted((r.analysis_id, r.issue) for r in sheet_issues(g, e).collect())


def test_versions_keys_and_fields(spark):
    a = [
        row(1, " an-1 ", mineral="a  b", zn_ppm=1.0), row(1, " an-1 ", mineral="a  b", zn_ppm=1.0),
        row(2, "an-2", T, mineral="old"), row(3, "AN-2", T + dt.timedelta(1), mineral="new"),
        row(4, None, mineral="q"), row(5, "g"), row(6, "n", ge_ppm=None, mineral=" \t"), row(7, "d", zn_ppm=1e9), row(8, "c", mineral="A"),
    ]
    b = [
        row(9, "AN-1", mineral=" a\tb ", zn_ppm=1.0 + 1e-12), row(10, "an-2", mineral="new"), row(11, None), row(12, "e"),
        row(13, "N", ge_ppm=0.0, mineral=None), row(14, "d", zn_ppm=1e9 + 2), row(15, "C", mineral="a"),
    ]
    assert issues(spark, a, b) == sorted([("G", "only_golden"), ("E", "only_extraction"), ("N", "ge_ppm"), ("D", "zn_ppm"), ("C", "mineral")])


def test_empty_tables(spark):
    assert issues(spark, [], []) == []
    assert issues(spark, [row(1, "a")], []) == [("A", "only_golden")]


def test_null_key_is_a_key_and_long_text(spark):
    s = "k string, v string, o int"
    a = spark.createDataFrame([(None, "x" * 100_000, 1), ("", "p", 1)], s)
    b = spark.createDataFrame([(None, "x" * 100_000 + "y", 1), ("", "p", 2)], s)
    d = {r.key: r for r in table_diff(a, b, F.col("k"), F.col("k"), ["v"], ["o"]).collect()}
    assert [x.field for x in d[None].diffs] == ["v"] and d[None].side == "both" and d[""].diffs == []


def test_nan(spark):
    s = "k string, v double, o int"
    a = spark.createDataFrame([("a", float("nan"), 1), ("b", float("nan"), 1)], s)
    b = spark.createDataFrame([("a", float("nan"), 1), ("b", 1.0, 1)], s)
    d = {r.key: [x.field for x in r.diffs] for r in table_diff(a, b, F.col("k"), F.col("k"), ["v"], ["o"]).collect()}
    assert d == {"a": [], "b": ["v"]}
