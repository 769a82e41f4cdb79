import csv
import io
import random

from lodestrata.operators.bad_rows import classify_rows, loaded_cells, rejected_rows

FILES = "file_id bigint, file_name string, delim string, n_cols int, columns array<string>, sample_id_col string, first_line int, last_line int, line string"
LINES = "line_id bigint, file_id bigint, line_no int, line string, delim string"
COLS = ["No", "Spot", "Fe", "Zn", "Remarks"]


def run(spark, lines, delim=",", **kw):
    f = spark.createDataFrame([(1, "a", delim, 5, COLS, "Spot", 1, 1000, "clash")], FILES)
    x = spark.createDataFrame([(i, 1, i + 1, t, "clash") for i, t in enumerate(lines)], LINES)
    return {r.line_id: r.reason for r in classify_rows(x, f, **kw).collect()}


def test_reasons(spark):
    lines = [
        "1,a,1.5,bdl,x", '2,"a ""b"", c",<0.1,-,"line\nbreak"', '3,a"b,1,1,', '4,"a,1,1,x', '5,"a"x,1,1,', "6,a,1,1", "7,a,1,1,,", "x,a,1,1,", "8,  ,1,1,",
        "9,a�,1,1,", "10,a,1 234,1,", "11,a,1.5e-3,+2,\r", "", "   \r", None, '12,a, "1",1,', "13,,1,1,", "0,a,1,1,",
    ]
    r = run(spark, lines)
    assert r == {
        0: None, 1: None, 2: "broken_quote", 3: "broken_quote", 4: "broken_quote", 5: "column_count", 6: "column_count", 7: "invalid_value", 8: "invalid_value",
        9: "invalid_value", 10: "invalid_value", 11: None, 15: "broken_quote", 16: "invalid_value", 17: "invalid_value",
    }


def test_decimal_comma_and_other_delimiters(spark):
    assert run(spark, ["1;a;1,5;2;", "2;a;1.5;2;"], ";") == {0: None, 1: "invalid_value"}
    assert run(spark, ["1\ta\t1.5\t2\t", "2\ta\t1\t2"], "\t") == {0: None, 1: "column_count"}
    assert run(spark, ["1|a|1.5|2|"], "|") == {0: None}
    assert run(spark, ["1#a"], "#") == {0: "unknown_format"}


def test_cells_equal_the_csv_module(spark):
    r = random.Random(3)
    alphabet = ["a", "1", '"', ",", " ", "\n", "é", ""]
    rows = [["7", "s", "1", "2", "".join(r.choice(alphabet) for _ in range(6))] for _ in range(200)]
    lines = []
    for row in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(row)
        lines.append(out.getvalue())
    f = spark.createDataFrame([(1, "a", ",", 5, COLS, "Spot", 1, 1000, "c")], FILES)
    x = spark.createDataFrame([(i, 1, i + 1, t, "c") for i, t in enumerate(lines)], LINES)
    got = {c.line_id: c for c in classify_rows(x, f).collect()}
    assert all(got[i].reason is None and got[i].fields == rows[i] for i in got) and len(got) == 200
    beyond = {c.line_id: c.fields for c in classify_rows(x, f, max_formats=0).collect()}
    assert beyond == {i: got[i].fields for i in got}


def test_long_and_empty(spark):
    assert run(spark, ['1,a,1,1,"' + 'x""' * 50_000 + '"', "1,a,1,1," + "y" * 200_000]) == {0: None, 1: None}
    assert run(spark, []) == {}


def test_loaded(spark):
    f = spark.createDataFrame([(1, "a", ",", 5, COLS, "Spot", 2, 3, "c")], FILES)
    x = spark.createDataFrame([(0, 1, 1, "No,Spot,Fe,Zn,Remarks", "c"), (1, 1, 2, "1,a,1.5,bdl,x", "c"), (2, 1, 3, "bad", "c"), (3, 1, 4, "Mean", "c")], LINES)
    assert [(c.column, c.value) for c in loaded_cells(x, f).orderBy("position").collect()] == list(zip(COLS, ["1", "a", "1.5", "bdl", "x"]))
    assert [(r.line_id, r.reason) for r in rejected_rows(x, f).collect()] == [(2, "column_count")]
