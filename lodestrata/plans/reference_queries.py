"""Queries of the reference operators over the driver's tables, and equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import censored
from lodestrata.functions.elements import NAMES, SYMBOLS, UNIT_ENDINGS, header_symbol
from lodestrata.operators import einsum as es
from lodestrata.operators import enrichment, export, graph, linkage, model_calls, relational, rollup, scoring, shaping, taxonomy, text
from lodestrata.session import broadcast_if_small, input_partitions, read, small_list
from lodestrata.streaming.events import sessions, windowed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- relational

_CUST = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_acctbal FROM customer"


def _customers(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("seg"), "c_acctbal")


def _nations(s: SparkSession, d: str) -> DataFrame:
    n = read(s, d, "nation")
    return n.select(F.when(F.col("n_nationkey") % 5 != 0, F.element_at(F.array(*map(F.lit, ["BUILDING", "MACHINERY", "AUTOMOBILE", "NONE"])), (F.col("n_nationkey") % 4 + 1).cast("int"))).alias("seg"), "n_name", F.col("n_nationkey").alias("c_custkey"))


_NAT = "SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE ['BUILDING','MACHINERY','AUTOMOBILE','NONE'][n_nationkey % 4 + 1] END AS seg, n_name, n_nationkey AS c_custkey FROM nation"


@query(f"SELECT l.c_custkey, l.seg, l.c_acctbal, r.n_name FROM ({_CUST}) l JOIN ({_NAT}) r ON l.seg IS NOT DISTINCT FROM r.seg")
def inner_join_nullsafe(s, d):
    return relational.join_nullsafe(_customers(s, d), broadcast_if_small(_nations(s, d), 10_000), "seg", "seg")


@query(f"SELECT l.c_custkey, l.seg, l.c_acctbal, r.n_name FROM ({_CUST}) l LEFT JOIN ({_NAT}) r ON l.seg IS NOT DISTINCT FROM r.seg")
def left_join_nullsafe(s, d):
    return relational.join_nullsafe(_customers(s, d), broadcast_if_small(_nations(s, d), 10_000), "seg", "seg", "left")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(s, d):
    return relational.join_nullsafe(read(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), read(s, d, "orders").select("o_custkey"), "c_custkey", "o_custkey", "left_anti")


@query("SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal, NULL AS seg FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def union_missing_cols(s, d):
    a = read(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return relational.union_all(a, read(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) r FROM orders) WHERE r = 1")
def unique_first(s, d):
    return relational.first_per_key(read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderkey")])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_count(s, d):
    return relational.group_count(read(s, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def gather_lists(s, d):
    o = read(s, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("v"))
    return relational.gather(o, "o_custkey", "v", ["o_orderkey"], "l").select("o_custkey", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("orders"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def sort_limit(s, d):
    return relational.stable_sort(read(s, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal")], ["c_custkey"]).limit(100)


@query(
    "WITH o AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders), w AS (SELECT * FROM (VALUES (0, 5), (1, 0), (2, 5), (3, 77), (4, 1000000000)) t(out_pos, i)) "
    "SELECT w.out_pos, o.o_orderkey, o.o_totalprice FROM w JOIN o USING (i)"
)
def select_by_index(s, d):
    return relational.select_by_index(read(s, d, "orders"), [F.col("o_totalprice"), F.col("o_orderkey")], [5, 0, 5, 77, 1000000000], ["o_orderkey", "o_totalprice"])


@query("SELECT row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS row_index, l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def position_carries(s, d):
    """Positions of whole rows: columns beside the order are carried along."""
    li = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")
    return relational.with_position(li, [F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).select("row_index", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


# ---- censored numbers and units

_BELOW = "(" + ",".join(f"'{w}'" for w in censored.BELOW_WORDS) + ")"
_NOTAN = "(" + ",".join(f"'{w}'" for w in censored.NOT_ANALYSED_WORDS) + ")"
_PARSE = f"""
WITH a AS (SELECT *, lower(trim(original_value, ' ')) AS t FROM measurements),
b AS (SELECT *, round(try_cast(nullif(regexp_extract(t, '^<\\s*([0-9]*\\.?[0-9]+)', 1), '') AS DOUBLE), 6) AS lim,
      replace(CASE WHEN t LIKE '>%' THEN trim(substr(t, 2), ' ') ELSE t END, ',', '') AS num FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(num, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN round(try_cast(num AS DOUBLE), 6) END AS v FROM b)
SELECT meas_id, status, CASE WHEN status = 'value' THEN v END AS value, CASE WHEN status = 'bdl_lod' THEN lim END AS lod FROM (
SELECT *, CASE WHEN t IS NULL OR t = '' OR t IN {_NOTAN} THEN NULL WHEN t IN {_BELOW} THEN 'bdl' WHEN t LIKE '<%' THEN CASE WHEN lim > 0 THEN 'bdl_lod' ELSE 'bdl' END WHEN v IS NOT NULL THEN 'value' END AS status FROM c)
"""


@query(_PARSE)
def cell_parse_censored(s, d):
    m = read(s, d, "measurements").select("meas_id", censored.parse_cell(F.col("original_value")).alias("c"))
    return m.select("meas_id", "c.status", "c.value", "c.lod")


@query(f"SELECT status, count(*) AS n FROM ({_PARSE}) GROUP BY 1")
def conversion_counters(s, d):
    return cell_parse_censored(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT row_id, 'zn' AS element, CASE WHEN zn_ppm >= 0 THEN round(zn_ppm * 0.0001::DOUBLE, 9) WHEN zn_ppm = -99999 THEN -99999 WHEN zn_ppm < 0 THEN round(zn_ppm * 0.0001::DOUBLE, 9) END AS wt FROM golden_sheet "
    "UNION ALL SELECT row_id, 'ge', CASE WHEN ge_ppm >= 0 THEN round(ge_ppm * 1000::DOUBLE, 9) WHEN ge_ppm = -99999 THEN -99999 WHEN ge_ppm < 0 THEN round(ge_ppm * 1000::DOUBLE, 9) END FROM golden_sheet"
)
def unit_convert(s, d):
    g = read(s, d, "golden_sheet")
    tidy = shaping.unpivot_cells(g.select("row_id", F.col("zn_ppm").alias("zn"), F.col("ge_ppm").alias("ge")), ["row_id"], ["zn", "ge"], "element", "v")
    v = F.col("v")
    status = F.when(v >= 0, "value").when(v == censored.BELOW_DETECTION, "bdl").when(v < 0, "bdl_lod")
    cell = F.struct(F.when(v >= 0, v).alias("value"), status.alias("status"), F.when(v < 0, -v).alias("lod"))
    factor = F.when(F.col("element") == "zn", 1e-4).otherwise(1e3)
    return tidy.select("row_id", "element", F.round(censored.as_sentinel(censored.convert(cell, factor)), 9).alias("wt"))


@query(
    "SELECT doc_id, element, count(*) FILTER (v >= 0) AS n, median(v) FILTER (v >= 0) AS median, count(*) FILTER (v >= 0) >= 2 AND coalesce(median(v) FILTER (v >= 0) BETWEEN 1 AND 1000, false) AS is_percent "
    "FROM (SELECT doc_id, 'cd' AS element, cd_ppm AS v FROM golden_sheet UNION ALL SELECT doc_id, 'ge', ge_ppm FROM golden_sheet) GROUP BY ALL"
)
def unit_profile(s, d):
    g = read(s, d, "golden_sheet").select("doc_id", F.col("cd_ppm").alias("cd"), F.col("ge_ppm").alias("ge"))
    return shaping.percent_columns(shaping.unpivot_cells(g, ["doc_id"], ["cd", "ge"], value="v"), ["doc_id", "element"], "v", 1, 1000)


def _sql_symbol() -> str:
    t = "regexp_replace(regexp_replace(h, '_pp[mb]_(content|conc)$', ''), '_pp[mb]_m[0-9]+', '', 'g')"
    t = f"regexp_replace({t}, '[_\\s]+(mean|2se|2sd|sd|se|median|avg|rsd|1sd|1se)$', '')"
    for e in UNIT_ENDINGS:
        t = f"regexp_replace({t}, '\\Q{e}\\E$', '')"
    return f"regexp_replace(trim({t}, ' '), '[_\\s]+$', '')"


_NAMES_SQL = "MAP {" + ",".join(f"'{k}':'{v}'" for k, v in {**{x: x for x in SYMBOLS}, **NAMES}.items()) + "}"


@query(
    f"WITH a AS (SELECT column_header, lower(trim(column_header, ' ')) AS h, count(*) AS n FROM measurements GROUP BY ALL), b AS (SELECT *, {_sql_symbol()} AS t FROM a), "
    f"c AS (SELECT *, CASE WHEN length(t) <= 6 AND regexp_matches(t, '^.*[^0-9][0-9]{{2,}}$') THEN regexp_replace(t, '[0-9]+$', '') END AS tail, CASE WHEN length(t) <= 6 AND regexp_matches(t, '^[0-9]{{2,}}[^0-9]') THEN regexp_replace(t, '^[0-9]+', '') END AS lead FROM b), m AS (SELECT {_NAMES_SQL} AS names) "
    "SELECT column_header, n, CASE WHEN NOT regexp_matches(h, '_pp[mb]_(lod|dl|det_lim)$') THEN coalesce(names[t], names[tail], names[lead]) END AS symbol FROM c, m WHERE column_header IS NOT NULL"
)
def header_symbols(s, d):
    m = read(s, d, "measurements").where("column_header IS NOT NULL").groupBy("column_header").agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("symbol", header_symbol(F.col("column_header")))


# ---- shaping


@query("SELECT 'p_size' AS measure, " + ", ".join(f"sum(CASE WHEN p_brand = 'Brand#{b}' THEN p_size END)::BIGINT AS \"Brand#{b}\"" for b in (1, 2, 3)) + " FROM part UNION ALL SELECT 'p_retailprice', " + ", ".join(f"round(sum(CASE WHEN p_brand = 'Brand#{b}' THEN p_retailprice END))::BIGINT" for b in (1, 2, 3)) + " FROM part")
def transpose_pivot(s, d):
    p = read(s, d, "part").groupBy("p_brand").agg(F.sum("p_size").cast("bigint").alias("p_size"), F.round(F.sum("p_retailprice")).cast("bigint").alias("p_retailprice"))
    tidy = shaping.unpivot_cells(p, ["p_brand"], ["p_size", "p_retailprice"], "measure", "v")
    return shaping.transpose(tidy, "p_brand", "measure", "v", ["Brand#1", "Brand#2", "Brand#3"])


@query("SELECT file_id, pos, CASE WHEN n = 1 THEN name ELSE name || '_' || (n - 1) END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY pos) AS n FROM (SELECT file_id, unnest(range(len(columns) + 2))::INT AS pos, unnest(columns || ['Total', 'Fe']) AS name FROM raw_files))")
def dedup_names(s, d):
    f = read(s, d, "raw_files").select("file_id", F.posexplode(F.concat("columns", F.array(F.lit("Total"), F.lit("Fe")))).alias("pos", "name"))
    return shaping.unique_names(f, ["file_id"], "name", "pos", "unique_name").select("file_id", "pos", "unique_name")


@query("SELECT row_id, last_update, CASE WHEN sample_name IS NOT NULL THEN sample_name || '-' || row_number() OVER (PARTITION BY doc_id, sample_name ORDER BY row_id, last_update) END AS local_id FROM (SELECT DISTINCT doc_id, row_id, sample_name, last_update FROM golden_sheet)")
def local_ids(s, d):
    g = read(s, d, "golden_sheet").select("doc_id", "row_id", "sample_name", "last_update").distinct()
    return shaping.local_ids(g, "sample_name", ["row_id", "last_update"], ["doc_id"]).select("row_id", "last_update", "local_id")


_SPARSE = "SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS tag FROM events"


@query(
    f"SELECT event_id, CASE WHEN share < 0.5 AND n >= 2 THEN last_value(tag IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE tag END AS filled "
    f"FROM (SELECT *, count(tag) OVER (PARTITION BY user_id) AS n, count(tag) OVER (PARTITION BY user_id) / count(*) OVER (PARTITION BY user_id) AS share FROM ({_SPARSE}))"
)
def ffill_ids(s, d):
    e = read(s, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("tag"))
    return shaping.fill_down(e, ["user_id"], ["event_id"], "tag", "filled").select("event_id", "filled")


@query("SELECT rec_id, trim(unnest(string_split(commodity, ',')), ' ') AS item FROM sedau WHERE commodity IS NOT NULL AND trim(commodity, ' ') <> '' UNION ALL SELECT rec_id, NULL FROM sedau WHERE commodity IS NULL OR trim(commodity, ' ') = ''")
def explode_minerals(s, d):
    return shaping.explode_list(read(s, d, "sedau").select("rec_id", "commodity"), "commodity", "item").select("rec_id", "item")


@query(
    "WITH f AS (SELECT o_orderkey, o_custkey, o_totalprice > 300000 AS flag FROM orders), r AS (SELECT *, greatest(1, (count(*) OVER (PARTITION BY o_custkey) * 0.2)::DOUBLE) AS cap, sum(flag::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM f) "
    "SELECT o_orderkey, o_custkey, flag FROM r WHERE NOT flag OR rk > floor(cap)"
)
def capped_removal(s, d):
    o = read(s, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") > 300000).alias("flag"))
    return shaping.cap_removal(o, ["o_custkey"], ["o_orderkey"], "flag")


_IDS = "SELECT line_id, regexp_extract(line, '^[^,;|\t]*[,;|\t]([^,;|\t]*)', 1) AS sid FROM raw_appendix"


@query(
    f"SELECT line_id, sid FROM (SELECT line_id, replace(sid, '\"', '') AS sid FROM ({_IDS})) WHERE NOT (sid IS NULL OR trim(sid, ' ') = '' OR length(trim(sid, ' ')) > 80 OR (suffix(trim(sid, ' '), '.') AND contains(trim(sid, ' '), ' ') AND length(trim(sid, ' ')) > 30) OR regexp_matches(trim(sid, ' '), '^(Note:|note:|\\*|†|‡|§)') "
    f"OR regexp_matches(sid, '{shaping.SUMMARY_ROW}') OR regexp_matches(sid, '{shaping.SUMMARY_INSIDE}') OR regexp_matches(sid, '{shaping.REFERENCE_STANDARD}'))"
)
def filter_regex_rows(s, d):
    x = read(s, d, "raw_appendix").select("line_id", F.replace(F.regexp_extract("line", r"^[^,;|\t]*[,;|\t]([^,;|\t]*)", 1), F.lit('"')).alias("sid"))
    return x.where(shaping.is_sample_row(F.col("sid")))


# ---- linkage

_FIELDS = ["sample_name", "deposit_name", "mineral", "analytical_method"]
_TWO = "SELECT 1 AS src, row_id, analysis_id, " + ", ".join(_FIELDS) + " FROM golden_sheet UNION ALL SELECT 2, row_id, analysis_id, " + ", ".join(_FIELDS) + " FROM extraction_sheet"


@query(f"SELECT analysis_id, " + ", ".join(f"arg_min({f}, (src, row_id, {f})) FILTER ({f} IS NOT NULL) AS {f}" for f in _FIELDS) + f" FROM ({_TWO}) GROUP BY 1")
def coalesce_merge(s, d):
    both = read(s, d, "golden_sheet").select(F.lit(1).alias("src"), "row_id", "analysis_id", *_FIELDS).unionByName(read(s, d, "extraction_sheet").select(F.lit(2).alias("src"), "row_id", "analysis_id", *_FIELDS))
    return linkage.coalesce_merge(both, ["analysis_id"], ["src", "row_id"], _FIELDS)


@query(
    "WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS total, NULL::BIGINT AS lines FROM orders WHERE o_orderkey % 5 <> 0), l AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS total, count(*) AS lines FROM lineitem GROUP BY 1) "
    "SELECT coalesce(o.k, l.k) AS k, round(coalesce(o.total, l.total), 2) AS total, coalesce(o.lines, l.lines) AS lines FROM o FULL JOIN l ON o.k = l.k"
)
def gapfill_outer(s, d):
    o = read(s, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("total"), F.lit(None).cast("bigint").alias("lines"))
    li = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count(F.lit(1)).alias("lines"))
    return linkage.gap_fill(o, li, "k", ["total", "lines"]).withColumn("total", F.round("total", 2))


@query(
    "WITH r AS (SELECT doc_id, sample_name, row_id, zn_ppm, fe_ppm, (zn_ppm IS NOT NULL)::INT + (fe_ppm IS NOT NULL)::INT + (cd_ppm IS NOT NULL)::INT + (ge_ppm IS NOT NULL)::INT AS n FROM extraction_sheet) "
    "SELECT doc_id, sample_name, arg_min(row_id, (-n, row_id)) AS row_id, arg_min(n, (-n, row_id)) AS n, min(row_id) AS position FROM r GROUP BY doc_id, sample_name"
)
def dedup_keep_richest(s, d):
    n = sum(F.col(c).isNotNull().cast("int") for c in ("zn_ppm", "fe_ppm", "cd_ppm", "ge_ppm"))
    e = read(s, d, "extraction_sheet").select("doc_id", "sample_name", "row_id", n.alias("n"))
    return linkage.keep_richest(e, ["doc_id", "sample_name"], F.col("n"), ["row_id"])


@query(
    "WITH g AS (SELECT doc_id, trim(sample_name, ' ') AS k, count(*) AS c FROM golden_sheet WHERE sample_name IS NOT NULL GROUP BY ALL), x AS (SELECT doc_id, sample_name, count(DISTINCT extraction_backend) AS backends, string_agg(DISTINCT extraction_backend, ',' ORDER BY extraction_backend) AS names FROM extraction_sheet GROUP BY ALL) "
    "SELECT doc_id, sample_name, backends, names, round(backends / 5.0, 2) AS agreement FROM x"
)
def backend_agreement(s, d):
    x = read(s, d, "extraction_sheet").groupBy("doc_id", "sample_name").agg(F.collect_set("extraction_backend").alias("b"))
    n = F.size("b").cast("bigint")
    return x.select("doc_id", "sample_name", n.alias("backends"), F.when(n > 0, F.array_join(F.array_sort("b"), ",")).alias("names"), F.round(n / 5.0, 2).alias("agreement"))


_NORM = "regexp_replace(regexp_replace(trim({}, ' '), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g')"


@query(
    f"WITH p AS (SELECT DISTINCT doc_id, sample_name AS pred_name, {_NORM.format('sample_name')} AS p FROM extraction_sheet WHERE sample_name IS NOT NULL), t AS (SELECT DISTINCT doc_id, sample_name AS truth_name, {_NORM.format('sample_name')} AS t FROM golden_sheet WHERE sample_name IS NOT NULL) "
    "SELECT doc_id, pred_name, truth_name, CASE WHEN pred_name = truth_name THEN 1 WHEN p = t THEN 2 ELSE 3 END AS stage FROM p JOIN t USING (doc_id) WHERE p = t OR (length(t) > 0 AND starts_with(p, t) AND substr(p, length(t) + 1, 1) IN ('-', '.', '@', '_', ' ', '#')) OR (length(p) > 0 AND starts_with(t, p) AND substr(t, length(p) + 1, 1) IN ('-', '.', '@', '_', ' ', '#'))"
)
def prefix_linkage(s, d):
    return linkage.name_links(read(s, d, "extraction_sheet").select("doc_id", "sample_name"), read(s, d, "golden_sheet").select("doc_id", "sample_name"), "sample_name", ["doc_id"])


@query()
def greedy_match(s, d):
    links = prefix_linkage(s, d)
    return linkage.one_to_one(links, ["doc_id"], "pred_name", "truth_name", ["stage", "truth_name", "pred_name"])


@query(
    'WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY last_update NULLS FIRST, doc_id NULLS FIRST, analysis_id NULLS FIRST, sample_name NULLS FIRST, sample_local_id NULLS FIRST, deposit_name NULLS FIRST, deposit_type_original NULLS FIRST, mineral NULLS FIRST, analytical_method NULLS FIRST, zn_ppm NULLS FIRST, fe_ppm NULLS FIRST, cd_ppm NULLS FIRST, ge_ppm NULLS FIRST, publication_date NULLS FIRST) AS rn FROM golden_sheet) WHERE rn = 1 AND doc_id IS NOT NULL), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY last_update NULLS FIRST, doc_id NULLS FIRST, analysis_id NULLS FIRST, sample_name NULLS FIRST, sample_local_id NULLS FIRST, deposit_name NULLS FIRST, deposit_type_original NULLS FIRST, mineral NULLS FIRST, analytical_method NULLS FIRST, zn_ppm NULLS FIRST, fe_ppm NULLS FIRST, cd_ppm NULLS FIRST, ge_ppm NULLS FIRST, publication_date NULLS FIRST, extraction_backend NULLS FIRST, extraction_confidence NULLS FIRST) AS rn FROM extraction_sheet) WHERE rn = 1), m AS (SELECT t.doc_id, t.row_id AS truth_row, p.row_id AS pred_row, coalesce(p.zn_ppm > 0 AND t.zn_ppm > 0, false)::INT + coalesce(p.fe_ppm > 0 AND t.fe_ppm > 0, false)::INT + coalesce(p.cd_ppm > 0 AND t.cd_ppm > 0, false)::INT + coalesce(p.ge_ppm > 0 AND t.ge_ppm > 0, false)::INT AS b, coalesce(p.zn_ppm > 0 AND t.zn_ppm > 0 AND abs(p.zn_ppm - t.zn_ppm) <= 0.1 * t.zn_ppm, false)::INT + coalesce(p.fe_ppm > 0 AND t.fe_ppm > 0 AND abs(p.fe_ppm - t.fe_ppm) <= 0.1 * t.fe_ppm, false)::INT + coalesce(p.cd_ppm > 0 AND t.cd_ppm > 0 AND abs(p.cd_ppm - t.cd_ppm) <= 0.1 * t.cd_ppm, false)::INT + coalesce(p.ge_ppm > 0 AND t.ge_ppm > 0 AND abs(p.ge_ppm - t.ge_ppm) <= 0.1 * t.ge_ppm, false)::INT AS n FROM t JOIN p ON p.doc_id = t.doc_id), h AS (SELECT *, n / b AS share FROM m WHERE b > 0 AND n > 0 AND n / b >= 0.3) SELECT doc_id, truth_row, pred_row, round(share, 4) AS share FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, truth_row ORDER BY share DESC, pred_row) AS r FROM h) WHERE r = 1'
)
def fingerprint_match(s, d):
    g = relational.first_per_key(read(s, d, "golden_sheet"), ["row_id"], [F.col("last_update")])
    e = relational.first_per_key(read(s, d, "extraction_sheet"), ["row_id"], [F.col("last_update")])
    els = ["zn_ppm", "fe_ppm", "cd_ppm", "ge_ppm"]
    links = linkage.fingerprint_links(e.withColumnRenamed("row_id", "pred_row"), g.withColumnRenamed("row_id", "truth_row"), ["doc_id"], "pred_row", "truth_row", els)
    return links.groupBy("doc_id", "truth_row").agg(F.max(F.struct("share", (-F.col("pred_row")).alias("p"))).alias("b")).select("doc_id", "truth_row", (-F.col("b.p")).alias("pred_row"), F.round("b.share", 4).alias("share"))


@query(
    "WITH v AS (SELECT DISTINCT n_name AS value FROM nation), e AS (SELECT r_name AS entry FROM region UNION SELECT DISTINCT p_type FROM part) "
    "SELECT value, arg_min(entry, (levenshtein(value, entry), entry)) AS entry, min(levenshtein(value, entry))::INT AS distance FROM v, e GROUP BY 1"
)
def nearest_string(s, d):
    e = read(s, d, "region").select(F.col("r_name").alias("entry")).unionByName(read(s, d, "part").select(F.col("p_type").alias("entry")).distinct())
    return linkage.nearest_string(read(s, d, "nation"), e, "n_name", "entry")


@query()
def difflib_ratio(s, d):
    j = read(s, d, "golden_sheet").select("row_id", "deposit_name").join(read(s, d, "extraction_sheet").select("row_id", F.col("deposit_name").alias("other")), "row_id").distinct()
    return j.select("row_id", F.round(linkage.text_similarity(F.lower("deposit_name"), F.lower("other")), 6).alias("similarity"))


# ---- scoring

_ELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PRED = "CASE WHEN (l_orderkey + l_linenumber + {i}) % 11 = 0 THEN NULL WHEN (l_orderkey + l_linenumber + {i}) % 13 = 0 THEN -99999 ELSE {c} * (1 + 0.01 * ((l_orderkey + l_linenumber) % 7)) END"
_TRUE = "CASE WHEN (l_orderkey + {i}) % 17 = 0 THEN NULL WHEN (l_orderkey + {i}) % 19 = 0 THEN -99999 ELSE {c} END"


def _pred(c: str, i: int):
    k = F.col("l_orderkey") + F.col("l_linenumber") + i
    return F.when(k % 11 == 0, None).when(k % 13 == 0, -99999.0).otherwise(F.col(c) * (1 + 0.01 * ((F.col("l_orderkey") + F.col("l_linenumber")) % 7)))


def _truth(c: str, i: int):
    k = F.col("l_orderkey") + i
    return F.when(k % 17 == 0, None).when(k % 19 == 0, -99999.0).otherwise(F.col(c))


_META = ["l_returnflag", "l_linestatus"]


def _prediction(s: SparkSession, d: str) -> DataFrame:
    """A table read from the same items with gaps, errors, lost rows and rows of its own."""
    k = F.col("l_orderkey")
    li = read(s, d, "lineitem").where((k + F.col("l_linenumber")) % 29 != 0)
    flag = F.when(k % 31 != 0, F.when(k % 7 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")))
    return li.select(
        F.when(k % 41 == 0, -k).otherwise(k).alias("l_orderkey"), "l_linenumber", "l_suppkey", flag.alias("l_returnflag"), "l_linestatus", *[_pred(c, i).alias(c) for i, c in enumerate(_ELS)]
    )


def _truth_table(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").where("l_orderkey % 37 <> 0").select("l_orderkey", "l_linenumber", "l_suppkey", *_META, *[_truth(c, i).alias(c) for i, c in enumerate(_ELS)])


_KEY = ["l_orderkey", "l_linenumber", "l_suppkey"]
_P_SQL = (
    "SELECT CASE WHEN l_orderkey % 41 = 0 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_orderkey % 31 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS l_returnflag, l_linestatus, "
    + ", ".join(f"{_PRED.format(i=i, c=c)} AS {c}" for i, c in enumerate(_ELS)) + " FROM lineitem WHERE (l_orderkey + l_linenumber) % 29 <> 0"
)
_T_SQL = "SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, " + ", ".join(f"{_TRUE.format(i=i, c=c)} AS {c}" for i, c in enumerate(_ELS)) + " FROM lineitem WHERE l_orderkey % 37 <> 0"
_BOTH_SQL = (
    f"SELECT row_number() OVER () AS rid, coalesce(t.l_orderkey, p.l_orderkey) AS l_orderkey, coalesce(t.l_linenumber, p.l_linenumber) AS l_linenumber, coalesce(t.l_suppkey, p.l_suppkey) AS l_suppkey, p.l_orderkey IS NOT NULL AS in_pred, t.l_orderkey IS NOT NULL AS in_truth, "
    + ", ".join(f"p.{c} AS p_{c}, t.{c} AS t_{c}" for c in [*_ELS, *_META]) + f" FROM ({_T_SQL}) t FULL JOIN ({_P_SQL}) p USING (l_orderkey, l_linenumber, l_suppkey)"
)
_CELLS_SQL = " UNION ALL ".join(f"SELECT rid, l_orderkey, l_linenumber, l_suppkey, in_pred, in_truth, '{c}' AS element, p_{c} AS pred, t_{c} AS truth FROM both_sides" for c in _ELS)
_WITH = f"WITH both_sides AS MATERIALIZED ({_BOTH_SQL}), cells AS ({_CELLS_SQL})"
_ERR = "abs(pred - truth) / abs(nullif(truth, 0))"
_NUM = f"CASE WHEN truth = 0 THEN (abs(pred) <= 0.001)::INT::DOUBLE WHEN {_ERR} <= 0.05 THEN 1 WHEN {_ERR} >= 1.0 THEN 0 ELSE 1 - ({_ERR} - 0.05) / (0.05 * 19) END"
_T2 = f"CASE WHEN truth IS NOT NULL THEN CASE WHEN truth = -99999 THEN CASE WHEN pred IS NULL THEN 0.5 WHEN pred = -99999 THEN 1 ELSE 0.3 END WHEN pred IS NULL OR pred = -99999 THEN 0 ELSE {_NUM} END END"
_T4 = "CASE WHEN truth IS NULL THEN (pred IS NULL)::INT::DOUBLE END"


def _aligned(s: SparkSession, d: str) -> DataFrame:
    return scoring.align_cells(_prediction(s, d), _truth_table(s, d), _KEY, _ELS)


@query(f"{_WITH} SELECT element, in_pred, in_truth, count(*) AS n, count(pred) AS n_pred, count(truth) AS n_truth, round(sum(pred) FILTER (pred >= 0), 1) AS s_pred, round(sum(truth) FILTER (truth >= 0), 1) AS s_truth FROM cells GROUP BY ALL")
def cell_alignment(s, d):
    p, x = F.col("pred"), F.col("truth")
    return _aligned(s, d).groupBy("element", "in_pred", "in_truth").agg(
        F.count(F.lit(1)).alias("n"), F.count(p).alias("n_pred"), F.count(x).alias("n_truth"), F.round(F.sum(F.when(p >= 0, p)), 1).alias("s_pred"), F.round(F.sum(F.when(x >= 0, x)), 1).alias("s_truth")
    )


@query(f"{_WITH} SELECT element, round(avg({_T2}), 6) AS mean_score, count({_T2}) AS n FROM cells WHERE in_pred AND in_truth GROUP BY 1")
def tier2_numeric(s, d):
    t = scoring.tier2(F.col("pred"), F.col("truth"))
    return _aligned(s, d).where("in_pred AND in_truth").groupBy("element").agg(F.round(F.avg(t), 6).alias("mean_score"), F.count(t).alias("n"))


@query(f"{_WITH} SELECT element, round(avg({_T4}), 6) AS mean_score, count({_T4}) AS n FROM cells WHERE in_pred AND in_truth GROUP BY 1")
def tier4_null(s, d):
    t = scoring.tier4(F.col("pred"), F.col("truth"))
    return _aligned(s, d).where("in_pred AND in_truth").groupBy("element").agg(F.round(F.avg(t), 6).alias("mean_score"), F.count(t).alias("n"))


_SAME = lambda c: f"CASE WHEN t_{c} IS NOT NULL THEN (lower(t_{c}) = lower(coalesce(p_{c}, '')))::INT::DOUBLE END"
_BOARD = f"""{_WITH}, one AS (SELECT rid, l_orderkey, l_suppkey, coalesce(avg({_T2}), 1) AS t2, coalesce(avg({_T4}), 1) AS t4 FROM cells WHERE in_pred AND in_truth GROUP BY ALL),
meta AS (SELECT l_suppkey, count(*) FILTER (in_pred AND in_truth) AS matched, count(*) FILTER (in_pred) AS n_pred, count(*) FILTER (in_truth) AS n_truth, {", ".join(f"avg({_SAME(c)}) FILTER (in_pred AND in_truth) AS m_{c}" for c in _META)} FROM both_sides GROUP BY 1),
r AS (SELECT m.l_suppkey AS report, coalesce(avg(t2), 0) AS t2, coalesce(avg(t4), 0) AS t4, count(o.l_orderkey) AS samples, any_value(matched) AS matched, any_value(n_pred) AS n_pred, any_value(n_truth) AS n_truth, coalesce((any_value(m_{_META[0]}) + any_value(m_{_META[1]})) / 2, 0) AS t1 FROM meta m LEFT JOIN one o ON o.l_suppkey = m.l_suppkey GROUP BY 1),
f AS (SELECT *, CASE WHEN n_pred > 0 THEN matched / n_pred ELSE 0 END AS p, CASE WHEN n_truth > 0 THEN matched / n_truth ELSE 1 END AS q FROM r),
g AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS t3 FROM f)
SELECT report, samples, round(t1, 6) AS t1, round(t2, 6) AS t2, round(t3, 6) AS t3, round(t4, 6) AS t4, round(0.3 * t1 + 0.4 * t2 + 0.15 * t3 + 0.15 * t4, 6) AS overall, row_number() OVER (ORDER BY round(0.3 * t1 + 0.4 * t2 + 0.15 * t3 + 0.15 * t4, 6) DESC, report) AS rank FROM g"""


@query(_BOARD)
def tier_overall(s, d):
    """Four tiers of each report (here a supplier): metadata, numbers, structure (the F1 of the aligned rows) and nulls."""
    return scoring.leaderboard(scoring.evaluation(_prediction(s, d), _truth_table(s, d), _KEY, ["l_suppkey"], _ELS, _META), "overall", "report")


@query(f"SELECT report, overall, rank FROM ({_BOARD}) WHERE rank <= 5")
def leaderboard(s, d):
    return tier_overall(s, d).where("rank <= 5").select("report", "overall", "rank")


@query(f"SELECT count(*) AS reports, sum(samples)::BIGINT AS samples, round(avg(overall), 5) AS overall, round(avg(t1), 5) AS t1, round(avg(t2), 5) AS t2, round(avg(t3), 5) AS t3, round(avg(t4), 5) AS t4 FROM ({_BOARD})")
def batch_summary(s, d):
    scores = scoring.evaluation(_prediction(s, d), _truth_table(s, d), _KEY, ["l_suppkey"], _ELS, _META)
    return scoring.batch_summary(scores, ["overall", "t1", "t2", "t3", "t4"], 5)


_KEYS = "SELECT DISTINCT doc_id, upper(trim(analysis_id, ' ')) AS k FROM {} WHERE analysis_id IS NOT NULL"


@query(
    f"WITH g AS ({_KEYS.format('golden_sheet')}), e AS ({_KEYS.format('extraction_sheet')}), c AS (SELECT coalesce(g.doc_id, e.doc_id) AS doc_id, count(*) FILTER (g.k IS NOT NULL AND e.k IS NOT NULL) AS m, count(g.k) AS t, count(e.k) AS p FROM g FULL JOIN e ON g.doc_id = e.doc_id AND g.k = e.k GROUP BY 1) "
    "SELECT doc_id, m AS matched, p AS n_pred, t AS n_truth, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM (SELECT *, CASE WHEN p > 0 THEN m / p ELSE 0 END AS pr, CASE WHEN t > 0 THEN m / t ELSE 1 END AS re FROM c)"
)
def prf1(s, d):
    def keys(t):
        return read(s, d, t).where("analysis_id IS NOT NULL").select("doc_id", F.upper(F.trim("analysis_id")).alias("k")).distinct()

    g, e = keys("golden_sheet").withColumn("g", F.lit(1)), keys("extraction_sheet").withColumn("e", F.lit(1))
    c = g.join(e, ["doc_id", "k"], "full_outer").groupBy("doc_id").agg(F.count(F.when(F.col("g").isNotNull() & F.col("e").isNotNull(), 1)).alias("matched"), F.count("e").alias("n_pred"), F.count("g").alias("n_truth"))
    p, r, f = scoring.precision_recall_f1(F.col("matched"), F.col("n_pred"), F.col("n_truth"))
    return c.select("doc_id", "matched", "n_pred", "n_truth", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


_IDS4 = ["analysis_id", "sample_local_id", "sample_name"]


def _pairs_sql() -> str:
    parts = []
    for i, a in enumerate(_IDS4):
        for j, b in enumerate(_IDS4):
            parts.append(
                f"SELECT doc_id, '{a}' AS pred_key, '{b}' AS truth_key, {i * len(_IDS4) + j} AS o, count(*) FILTER (p.k IS NOT NULL AND t.k IS NOT NULL) AS m, count(p.k) AS np, count(t.k) AS nt "
                f"FROM (SELECT DISTINCT doc_id, lower(trim({a}, ' ')) AS k FROM extraction_sheet WHERE trim({a}, ' ') <> '') p FULL JOIN (SELECT DISTINCT doc_id, lower(trim({b}, ' ')) AS k FROM golden_sheet WHERE trim({b}, ' ') <> '') t USING (doc_id, k) GROUP BY doc_id"
            )
    return " UNION ALL ".join(parts)


@query(
    f"WITH c AS (SELECT *, CASE WHEN np > 0 THEN m / np ELSE 0 END AS pr, CASE WHEN nt > 0 THEN m / nt ELSE 1 END AS re FROM ({_pairs_sql()}) WHERE doc_id IS NOT NULL), f AS (SELECT *, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM c), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, f1 DESC, o) AS rk FROM f) SELECT doc_id, pred_key, truth_key, m AS matched, f1 FROM r WHERE rk = 1"
)
def best_key_pair(s, d):
    e, g = (read(s, d, t).where("doc_id IS NOT NULL") for t in ("extraction_sheet", "golden_sheet"))
    return scoring.best_key_pair(e, g, ["doc_id"], _IDS4, _IDS4)


_FILL = ["sample_name", "deposit_name", "deposit_type_original", "mineral", "analytical_method", "zn_ppm", "fe_ppm", "cd_ppm", "ge_ppm", "extraction_confidence"]


@query("WITH n AS (SELECT count(*) AS n, " + ", ".join(f"count({c}) AS {c}" for c in _FILL) + " FROM extraction_sheet) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS filled, round(CASE WHEN n > 0 THEN {c} / n ELSE 0 END, 6) AS share FROM n" for c in _FILL))
def quality_completeness(s, d):
    return scoring.completeness(read(s, d, "extraction_sheet"), _FILL).withColumn("share", F.round("share", 6))


@query(
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{e}' AS element, {e}_ppm AS value FROM extraction_sheet" for e in ("zn", "fe", "cd", "ge")) + ") SELECT element, max(value) FILTER (value >= 0) AS max_value, count(*) AS n, coalesce(max(value) FILTER (value >= 0) <= CASE WHEN element IN ('fe','si','al','ca','mg','na','k','ti','mn','p','s') THEN 1000000 ELSE 100000 END, true) AS plausible FROM c WHERE value IS NOT NULL GROUP BY 1"
)
def quality_plausibility(s, d):
    e = read(s, d, "extraction_sheet").select(*[F.col(f"{x}_ppm").alias(x) for x in ("zn", "fe", "cd", "ge")])
    return scoring.plausibility(shaping.unpivot_cells(e, [], ["zn", "fe", "cd", "ge"]))


@query(
    "WITH v AS (SELECT upper(trim(analysis_id, ' ')) AS k, mineral FROM golden_sheet WHERE analysis_id IS NOT NULL UNION ALL SELECT upper(trim(analysis_id, ' ')), mineral FROM extraction_sheet WHERE analysis_id IS NOT NULL), c AS (SELECT k, mineral, count(*) AS n FROM v WHERE mineral IS NOT NULL GROUP BY ALL) "
    "SELECT k, max(n) AS votes, round(100.0 * max(n) / 2, 1) AS agreement FROM c GROUP BY 1"
)
def agreement(s, d):
    v = [read(s, d, t).where("analysis_id IS NOT NULL").select(F.upper(F.trim("analysis_id")).alias("k"), "mineral") for t in ("golden_sheet", "extraction_sheet")]
    return scoring.agreement(v[0].unionByName(v[1]), ["k"], "mineral", 2)


# ---- rollups, ranking, vectors


def _class_scores(s: SparkSession, d: str) -> DataFrame:
    """Dot product of each vector with each label's mean vector: the means are a bounded dimension (one a label)."""
    e = read(s, d, "embeddings").select("vec_id", "label", "embedding")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = dims.groupBy(F.col("label").alias("option")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("mean"))
    # the means fold into one row, which meets every vector
    listed = small_list(means, 10_000, "labels").agg(F.collect_list(F.struct("option", "mean")).alias("all"))
    dot = F.aggregate(F.zip_with("embedding", "mean", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    each = e.join(F.broadcast(listed)).select("vec_id", "label", "embedding", F.explode("all").alias("m")).select("vec_id", "label", "embedding", "m.option", "m.mean")
    return each.select("vec_id", "label", "option", F.round(dot, 6).alias("score"))


_SCORES = "WITH x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label AS option, i, avg(x) AS m FROM x GROUP BY ALL), s AS (SELECT vec_id, label, option, round(sum(x.x * m.m), 6) AS score FROM x JOIN m USING (i) GROUP BY ALL)"


@query(f"{_SCORES}, r AS (SELECT a.vec_id, count(*) FILTER (a.score >= b.score) AS rank FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.option = b.label GROUP BY 1) SELECT count(*) AS n, round(avg((rank <= 1)::INT), 6) AS top1, round(avg((rank <= 5)::INT), 6) AS top5, round(avg(1.0 / rank), 6) AS mrr FROM r")
def classifier_metrics(s, d):
    r = scoring.ranking_metrics(_class_scores(s, d), "vec_id", "option", "score", "label")
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("top1", "top5", "mrr")])


@query(f"{_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY option ORDER BY score DESC, vec_id) AS rk FROM s), h AS (SELECT option, rk, row_number() OVER (PARTITION BY option ORDER BY rk) AS i FROM r WHERE label = option) SELECT option, count(*) AS n, round(avg(i / rk), 6) AS ap FROM h GROUP BY 1")
def mean_average_precision(s, d):
    c = _class_scores(s, d).withColumn("relevant", F.col("label") == F.col("option"))
    return scoring.average_precision(c, "option", "score", "vec_id", "relevant").withColumn("ap", F.round("ap", 6))


@query("WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q, vec_id, round(list_cosine_similarity(q.e::DOUBLE[], embedding::DOUBLE[]), 5) AS sim FROM q, embeddings WHERE q <> vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT q, vec_id, sim, rank FROM r WHERE rank <= 5")
def cosine_topk(s, d):
    e = read(s, d, "embeddings").select("vec_id", "embedding")
    return rollup.nearest_by_cosine(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)


@query(f"{_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY option ORDER BY score DESC, vec_id) AS rk FROM s) SELECT option, count(*) FILTER (label = option) AS hits, round(avg((label = option)::INT), 6) AS precision FROM r WHERE rk <= 50 GROUP BY 1")
def precision_at_50(s, d):
    c = _class_scores(s, d).withColumn("relevant", F.col("label") == F.col("option"))
    return scoring.precision_at(c, "option", "score", "vec_id", "relevant").withColumn("precision", F.round("precision", 6))


_LOGITS = "SELECT p_brand, p_type, p_size, avg(p_retailprice) / 1000 AS logit FROM part GROUP BY ALL"


@query(
    f"WITH l AS ({_LOGITS}), e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY p_brand)) AS x FROM l), p AS (SELECT *, x / sum(x) OVER (PARTITION BY p_brand) AS p FROM e), g AS (SELECT p_brand, p_type, max(p) AS b FROM p GROUP BY ALL) SELECT p_brand, p_type, round(b / (sum(b) OVER (PARTITION BY p_brand) + 1e-12), 6) AS group_p FROM g"
)
def softmax_rollup(s, d):
    p = read(s, d, "part").groupBy("p_brand", "p_type", "p_size").agg((F.avg("p_retailprice") / 1000).alias("logit"))
    return rollup.rollup_max(rollup.softmax(p, ["p_brand"], "logit"), "p_brand", "p_type", "p").withColumn("group_p", F.round("group_p", 6))


@query(
    f"WITH l AS ({_LOGITS}), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY logit DESC, p_type, p_size) AS rank FROM l) SELECT p_brand, max(p_type || '/' || p_size) FILTER (rank = 1) AS top_1, max(p_type || '/' || p_size) FILTER (rank = 2) AS top_2, max(p_type || '/' || p_size) FILTER (rank = 3) AS top_3 FROM r GROUP BY 1"
)
def topn_pivot(s, d):
    p = read(s, d, "part").groupBy("p_brand", "p_type", "p_size").agg((F.avg("p_retailprice") / 1000).alias("logit"))
    p = p.withColumn("name", F.concat_ws("/", "p_type", F.col("p_size").cast("string"))).withColumn("tie", F.struct("p_type", "p_size"))
    t = rollup.top_n(p, "p_brand", "logit", "tie", 3)
    wide = t.groupBy("p_brand").pivot("rank", [1, 2, 3]).agg(F.max("name"))
    return wide.select("p_brand", *[F.col(str(i)).alias(f"top_{i}") for i in (1, 2, 3)])


@query(
    "WITH c AS (" + " UNION ALL ".join(f"SELECT deposit_name, '{e}' AS element, {e}_ppm AS v FROM golden_sheet" for e in ("zn", "fe", "cd", "ge")) + ") SELECT deposit_name, element, count(*) AS n_analyses, count(*) FILTER (v = -99999) AS n_bdl, round(median(v) FILTER (v >= 0), 4) AS median_ppm, round(min(v) FILTER (v >= 0), 4) AS min_ppm, round(max(v) FILTER (v >= 0), 4) AS max_ppm FROM c WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (v >= 0) > 0"
)
def site_stats(s, d):
    g = read(s, d, "golden_sheet").select("deposit_name", *[F.col(f"{e}_ppm").alias(e) for e in ("zn", "fe", "cd", "ge")])
    return rollup.site_statistics(shaping.unpivot_cells(g, ["deposit_name"], ["zn", "fe", "cd", "ge"]), ["deposit_name", "element"], "value")


@query("WITH o AS (SELECT n_nationkey AS option FROM nation), c AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1), t AS (SELECT count(*) AS t FROM supplier) SELECT option, coalesce(n, 0) AS n, round(coalesce(n, 0) / t, 8) AS prior, round(ln(coalesce(n, 0) / t + 1e-20), 6) AS log_prior FROM o LEFT JOIN c ON option = s_nationkey, t")
def class_prior(s, d):
    r = rollup.class_prior(read(s, d, "supplier"), read(s, d, "nation").select(F.col("n_nationkey").alias("option")), "s_nationkey", "option")
    return r.select("option", "n", F.round("prior", 8).alias("prior"), F.round("log_prior", 6).alias("log_prior"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * m) / (sum(m) + 1e-20), 4) AS masked_mean FROM (SELECT *, (l_linenumber % 2 = 0)::INT AS m FROM lineitem) GROUP BY 1")
def masked_mean(s, d):
    li = read(s, d, "lineitem").withColumn("m", (F.col("l_linenumber") % 2 == 0).cast("int"))
    return li.groupBy("l_returnflag").agg(F.round(rollup.masked_mean(F.col("l_extendedprice"), F.col("m")), 4).alias("masked_mean"))


@query("SELECT r_regionkey AS r, round(sum(n_nationkey * s_acctbal), 2) AS v FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def mr_einsum(s, d):
    region = read(s, d, "region").select(F.col("r_regionkey").alias("r"), F.lit(1.0).alias("v"))
    nation = read(s, d, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), F.col("n_nationkey").cast("double").alias("v"))
    supplier = read(s, d, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("s"), F.col("s_acctbal").alias("v"))
    return es.einsum("r,rn,ns->r", region, nation, supplier, sizes={"r": 5, "n": 25, "s": 10_000}).withColumn("v", F.round("v", 2))


@query("SELECT c_custkey, CASE WHEN c_acctbal <> 0 AND c_acctbal - 5 * floor(c_acctbal / 5) > 2.5 THEN 'train' WHEN c_acctbal IS NOT NULL THEN 'eval' END AS split FROM customer")
def lat_split(s, d):
    x = F.col("c_acctbal")
    split = F.when(x.isNull() | F.isnan(x), None).when((x != 0) & (x - 5 * F.floor(x / 5) > 2.5), "train").otherwise("eval")
    return read(s, d, "customer").select("c_custkey", split.alias("split"))


@query("SELECT event_id, (props::JSON->>'$.k')::INT AS k, coalesce(props::JSON->>'$.name', props::JSON->>'$.k') AS name FROM events")
def json_paths(s, d):
    v = F.try_parse_json("props")
    return read(s, d, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$.k", "string")).alias("name"))


# ---- text

_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(bare, '{p}') OR regexp_matches(low, '{p}') THEN '{n}'" for n, o in text.SECTION_OPENINGS for p in ["^(" + "|".join(text._literal(x) for x in o) + ")"]) + " END"


@query(
    f"WITH l AS (SELECT content_id, unnest(range(len(string_split(full_text, chr(10)))))::INT AS line_no, unnest(string_split(full_text, chr(10))) AS line FROM pdf_content WHERE full_text IS NOT NULL), a AS (SELECT *, lower(trim(line, ' ')) AS low, regexp_replace(lower(trim(line, ' ')), '^[0-9]+(\\.[0-9]+)*\\.?\\s+', '') AS bare FROM l), "
    f"h AS (SELECT *, CASE WHEN low <> '' AND length(low) <= 120 THEN {_SECTION} END AS h FROM a), w AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY content_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'preamble') AS section, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY content_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'preamble') AS b FROM h) "
    "SELECT content_id, section, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM w WHERE h IS NULL OR h = b GROUP BY ALL"
)
def section_segments(s, d):
    p = read(s, d, "pdf_content").where("full_text IS NOT NULL").select("content_id", "full_text")
    return text.section_segments(p, "content_id", "full_text").groupBy("content_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("SELECT content_id, md5(regexp_replace(regexp_replace(regexp_replace(full_text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[ \\t\\n\\r\\f\\v]{3,}', '  ', 'g'), '([a-z])-\\n([a-z])', '\\1\\2', 'g')) AS digest FROM pdf_content WHERE full_text IS NOT NULL")
def clean_page_text(s, d):
    return read(s, d, "pdf_content").where("full_text IS NOT NULL").select("content_id", F.md5(F.encode(text.clean_page(F.col("full_text")), "UTF-8")).alias("digest"))


_SCORE_SQL = (
    "WITH a AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, " + " + ".join(f"contains(low, '{m}')::INT" for m in text.DATA_MARKERS) + " AS m, " + " + ".join(f"contains(low, '{m}')::INT" for m in text.REFERENCE_MARKERS)
    + " AS r, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(lower(x), 'doi:|http|downloaded') AND length(regexp_replace(x, '[^0-9.]', '', 'g')) > 10 AND length(regexp_replace(x, '[^0-9.]', '', 'g')) / greatest(length(x), 1) > 0.15)) AS n FROM a), "
    "c AS (SELECT doc_id, round(CASE WHEN r >= 3 THEN NULL WHEN m >= 2 AND n >= 2 THEN m * 0.3 + n * 0.7 WHEN m >= 1 AND n >= 1 THEN (m * 0.3 + n * 0.7) * 0.5 END, 6) AS score FROM b) "
)


@query(_SCORE_SQL + "SELECT doc_id, score FROM c WHERE score IS NOT NULL ORDER BY score DESC, doc_id LIMIT 200")
def page_rank(s, d):
    docs = read(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.round(text.page_score(F.col("text")), 6).alias("score"))
    return docs.where("score IS NOT NULL").orderBy(F.desc("score"), "doc_id").limit(200)


@query("WITH a AS (SELECT paper_id, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY paper_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents WHERE text IS NOT NULL) SELECT paper_id, doc_id, length(substr(text, 1, (5000 - b)::INT))::INT AS kept FROM a WHERE b < 5000")
def char_budget(s, d):
    docs = read(s, d, "documents").where("text IS NOT NULL").select("paper_id", "doc_id", "text")
    return text.character_budget(docs, ["paper_id"], ["doc_id"], "text", 5000).select("paper_id", "doc_id", F.length("text").alias("kept"))


@query("WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 600 AS b FROM events), f AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e), g AS (SELECT *, sum((reach IS NULL OR a > reach + 3600)::INT) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f) SELECT user_id, min(a) AS \"start\", max(b) AS \"end\", count(*) AS hits FROM g GROUP BY user_id, island")
def merge_islands(s, d):
    e = read(s, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("a")).withColumn("b", F.col("a") + 600)
    return text.merge_spans(e, ["user_id"], "a", "b", 3600)


@query(
    "WITH t AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN []::BIGINT[] WHEN len(w) <= 64 THEN [1]::BIGINT[] ELSE list_distinct(range(1, len(w) - 64 + 2, 32) || [len(w) - 63]) END AS st FROM t) SELECT doc_id, a.start::INT AS start, least(64, len(w))::INT AS n FROM (SELECT doc_id, w, unnest(st) AS start FROM s) a"
)
def overlap_chunks(s, d):
    words = F.filter(F.split("text", " "), lambda x: x != "")
    n = F.size("w")
    docs = read(s, d, "documents").where("text IS NOT NULL").select("doc_id", words.alias("w"))
    win = docs.select("doc_id", n.alias("n"), F.posexplode(text.overlapping_windows(F.col("w"), 64)).alias("i", "win"))
    return win.select("doc_id", F.when(F.col("n") <= 64, 1).otherwise(F.least(F.col("i") * 32 + 1, F.col("n") - 63)).alias("start"), F.size("win").alias("n"))


_LOOK = [("la-icp-ms", "LA-ICP-MS"), ("electron microprobe", "EPMA"), ("sims", "SIMS"), ("qemscan", "QEMSCAN"), ("micro-xrf", "XRF")]


@query("SELECT doc_id, " + "CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in _LOOK) + " END AS method FROM documents")
def substring_lookup(s, d):
    return read(s, d, "documents").select("doc_id", text.contained_entry(F.col("text"), _LOOK).alias("method"))


@query(
    "WITH t AS (SELECT *, list_filter(regexp_split_to_array(lower(deposit_type), '[^a-z]+'), lambda w: length(w) > 3) AS w FROM deposit_types), p AS (SELECT doc_id, lower(text) AS low, type_id, deposit_type, deposit_group, deposit_environment, w FROM documents, t WHERE text IS NOT NULL), "
    "s AS (SELECT doc_id, type_id, len(list_filter(w, lambda x: contains(low, x))) / len(w) * 0.3 AS o, contains(low, lower(deposit_type)) AS a, contains(low, lower(deposit_group)) AS b, contains(low, lower(deposit_environment)) AS c FROM p), "
    "r AS (SELECT doc_id, type_id, round(least(1, (CASE WHEN a THEN 0.4 ELSE 0 END)::DOUBLE + (CASE WHEN b THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN c THEN 0.1 ELSE 0 END)::DOUBLE + CASE WHEN least(0.2, o) > 0.05 THEN least(0.2, o) ELSE 0 END), 3) AS score FROM s), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, type_id)::INT AS rank FROM r WHERE score > 0.05) SELECT doc_id, rank, type_id, score FROM k WHERE rank <= 10"
)
def keyword_score_topk(s, d):
    return taxonomy.score_types(read(s, d, "documents").select("doc_id", "text"), read(s, d, "deposit_types"), "doc_id", "text")


@query("SELECT deposit_environment, deposit_group, count(*) AS n_types, string_agg(DISTINCT deposit_type, '; ' ORDER BY deposit_type) AS types FROM deposit_types GROUP BY ALL")
def type_hierarchy(s, d):
    return taxonomy.hierarchy(read(s, d, "deposit_types"), ["deposit_environment", "deposit_group"], "deposit_type")


@query(
    "WITH v AS (SELECT DISTINCT deposit_type_original AS value FROM golden_sheet WHERE deposit_type_original IS NOT NULL), p AS (SELECT DISTINCT deposit_type AS e FROM deposit_types), r AS (SELECT value, e, lower(e) = lower(value) AS eq, CASE WHEN contains(lower(e), lower(value)) OR contains(lower(value), lower(e)) THEN least(length(value), length(e)) / greatest(length(value), length(e)) ELSE 0 END AS r FROM v, p) "
    "SELECT value, bool_or(eq) AS valid, CASE WHEN NOT bool_or(eq) AND max(r) > 0.5 THEN arg_min(e, (-r, e)) END AS suggestion FROM r GROUP BY 1"
)
def picklist_validate(s, d):
    return taxonomy.validate(read(s, d, "golden_sheet"), read(s, d, "deposit_types"), "deposit_type_original", "deposit_type")


@query(
    "WITH n AS (SELECT rec_id, unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END) AS n FROM (SELECT rec_id, list_distinct(regexp_extract_all(lower(coalesce(deposit_type, '')), '\\b([0-9]{1,2}[a-z])\\b', 1)) AS x FROM usmin_sn)) SELECT rec_id, coalesce(string_agg(DISTINCT type_id, ',' ORDER BY type_id), '') AS type_ids FROM n LEFT JOIN deposit_types ON lower(usgs_num) = n GROUP BY 1"
)
def model_crosswalk(s, d):
    return taxonomy.crosswalk(read(s, d, "usmin_sn"), read(s, d, "deposit_types"), "rec_id", "deposit_type").withColumn("type_ids", F.array_join("type_ids", ","))


_CODES = "list_concat(" + ", list_concat(".join(f"list_transform(regexp_extract_all(text, '(?i){p}'), lambda x: trim(x, ' '))" for p in text.STANDARD_CODES[:-1]) + f", list_transform(regexp_extract_all(text, '(?i){text.STANDARD_CODES[-1]}'), lambda x: trim(x, ' '))" + ")" * (len(text.STANDARD_CODES) - 1)


@query(f"WITH f AS (SELECT doc_id, text, {_CODES} AS l FROM documents WHERE text IS NOT NULL), u AS (SELECT *, list_transform(l, lambda x: lower(x)) AS low FROM f) SELECT doc_id, md5(CASE WHEN len(l) > 0 THEN array_to_string(list_filter(l, lambda x, i: list_position(low, lower(x)) = i), ', ') ELSE text END) AS codes FROM u")
def reference_material_codes(s, d):
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.encode(text.reference_materials(F.col("text")), "UTF-8")).alias("codes"))


@query("SELECT rec_id, coalesce(nullif(trim(regexp_replace(trim(regexp_replace(deposit_name, '(?i)\\s+(?:(?:[A-Z][a-z]?[-–])*[A-Z][a-z]?\\s+)?(?:polymetallic\\s+)?(?:deposit|mine|prospect|occurrence|ore\\s+field|orefield|mining\\s+district|district)\\s*$', ''), ' '), '\\s*\\([A-Z][a-z]?(?:[-–][A-Z][a-z]?)*\\)\\s*$', ''), ' '), ''), deposit_name) AS plain FROM sedau")
def plain_deposit_names(s, d):
    return read(s, d, "sedau").select("rec_id", text.plain_deposit_name(F.col("deposit_name")).alias("plain"))


@query(
    "SELECT file_id, 1::BIGINT AS table_no, 0 AS row_no, array_to_string(list_transform(columns, lambda c: trim(c, ' ')), ';') AS cells FROM raw_files UNION ALL SELECT file_id, 1, 1, array_to_string(list_transform(range(1, len(columns) + 1), lambda i: coalesce(['1', 'a', '2'][i], '')), ';') FROM raw_files UNION ALL SELECT file_id, 2, 0, 'x' FROM raw_files"
)
def markdown_tables(s, d):
    f = read(s, d, "raw_files").select("file_id", F.concat(F.lit("note\n| "), F.array_join("columns", " | "), F.lit(" |\n|---|:--|\n| 1 | a | 2 |\n\n| x |\n")).alias("t"))
    return text.pipe_tables(f, "file_id", "t").withColumn("cells", F.array_join("cells", ";"))


@query()
def text_tables(s, d):
    m = read(s, d, "golden_sheet").where("sample_name IS NOT NULL").select("doc_id", "row_id", F.concat_ws("  ", F.regexp_replace("sample_name", " ", "_"), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("zn_ppm", "fe_ppm", "cd_ppm", "ge_ppm")]).alias("line"))
    pages = m.groupBy("doc_id", F.floor(F.col("row_id") / 50).alias("page")).agg(F.array_sort(F.collect_list(F.struct("row_id", "line"))).alias("l"))
    p = pages.select(F.concat_ws("/", "doc_id", F.col("page").cast("string")).alias("page"), F.concat(F.lit("Table\nSample Zn Fe Cd Ge\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("t"))
    return text.text_tables(p, "page", "t").withColumn("cells", F.array_join("cells", ";"))


@query()
def anchored_lines(s, d):
    e = read(s, d, "events").groupBy("user_id").agg(F.collect_list(F.struct((F.col("event_id") % 97).cast("double").alias("y"), (F.col("event_id") % 13).cast("double").alias("x"), F.col("event_type").alias("text"))).alias("w"))
    return e.select("user_id", F.explode(text.anchored_lines(F.col("w"))).alias("line"))


@query()
def json_salvage(s, d):
    cut = F.expr("substring(a, 1, cast(length(a) - event_id % 9 as int))")
    e = read(s, d, "events").withColumn("a", F.concat(F.lit('```json\n{"samples": ['), "props", F.lit(", "), "props", F.lit("]}")))
    return e.select("event_id", text.salvaged(cut).alias("value"))


# ---- graph

_GEL = ["zn", "fe"]


@query(
    "WITH s AS (SELECT * FROM golden_sheet WHERE sample_name IS NOT NULL) SELECT 'Paper' AS type, count(DISTINCT doc_id) AS n FROM s UNION ALL SELECT 'Deposit', count(DISTINCT deposit_name) FROM s UNION ALL SELECT 'Sample', count(DISTINCT (doc_id, sample_name)) FROM s UNION ALL SELECT 'Mineral', count(DISTINCT mineral) FROM s UNION ALL SELECT 'Measurement', count(DISTINCT (row_id, el)) FROM (SELECT row_id, 'zn' AS el FROM s WHERE zn_ppm IS NOT NULL UNION ALL SELECT row_id, 'fe' FROM s WHERE fe_ppm IS NOT NULL)"
)
def graph_nodes(s, d):
    nodes, _ = graph.sample_graph(read(s, d, "golden_sheet"), _GEL)
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH s AS (SELECT * FROM golden_sheet WHERE sample_name IS NOT NULL) SELECT DISTINCT 'paper:' || doc_id AS src, 'deposit:' || deposit_name AS dst, 'DESCRIBES' AS type FROM s WHERE deposit_name IS NOT NULL UNION ALL SELECT DISTINCT 'paper:' || doc_id, 'sample/' || doc_id || '/' || sample_name, 'HAS_SAMPLE' FROM s UNION ALL SELECT DISTINCT 'sample/' || doc_id || '/' || sample_name, 'mineral:' || mineral, 'OF_MINERAL' FROM s WHERE mineral IS NOT NULL "
    "UNION ALL SELECT DISTINCT 'sample/' || doc_id || '/' || sample_name, 'm/' || row_id || '/' || el, 'HAS_MEASUREMENT' FROM (SELECT *, 'zn' AS el FROM s WHERE zn_ppm IS NOT NULL UNION ALL SELECT *, 'fe' FROM s WHERE fe_ppm IS NOT NULL)"
)
def graph_edges(s, d):
    _, edges = graph.sample_graph(read(s, d, "golden_sheet").where("doc_id IS NOT NULL"), _GEL)
    return edges.select("src", "dst", "type")


@query(
    "WITH s AS (SELECT * FROM golden_sheet WHERE sample_name IS NOT NULL), n AS (SELECT 'Paper' AS type, count(DISTINCT doc_id) AS n FROM s UNION ALL SELECT 'Deposit', count(DISTINCT deposit_name) FROM s UNION ALL SELECT 'Sample', count(DISTINCT (doc_id, sample_name)) FROM s UNION ALL SELECT 'Mineral', count(DISTINCT mineral) FROM s "
    "UNION ALL SELECT 'Measurement', count(DISTINCT (row_id, el)) FROM (SELECT row_id, 'zn' AS el FROM s WHERE zn_ppm IS NOT NULL UNION ALL SELECT row_id, 'fe' FROM s WHERE fe_ppm IS NOT NULL)), "
    "e AS (SELECT 'DESCRIBES' AS type, count(DISTINCT (doc_id, deposit_name)) AS n FROM s WHERE deposit_name IS NOT NULL UNION ALL SELECT 'HAS_SAMPLE', count(DISTINCT (doc_id, sample_name)) FROM s UNION ALL SELECT 'OF_MINERAL', count(DISTINCT (doc_id, sample_name, mineral)) FROM s WHERE mineral IS NOT NULL "
    "UNION ALL SELECT 'HAS_MEASUREMENT', count(DISTINCT (doc_id, sample_name, row_id, el)) FROM (SELECT *, 'zn' AS el FROM s WHERE zn_ppm IS NOT NULL UNION ALL SELECT *, 'fe' FROM s WHERE fe_ppm IS NOT NULL)) "
    "SELECT 'node' AS kind, type, n FROM n UNION ALL SELECT 'node', NULL, sum(n)::BIGINT FROM n UNION ALL SELECT 'edge', type, n FROM e UNION ALL SELECT 'edge', NULL, sum(n)::BIGINT FROM e"
)
def graph_stats(s, d):
    nodes, edges = graph.sample_graph(read(s, d, "golden_sheet"), _GEL)
    return graph.statistics(nodes, graph.valid_edges(edges, nodes))


# ---- exports, model answers, windows


@query("SELECT record_id, CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 'EPSG:4326' END AS crs, coalesce(len(deposit_type_candidate), -1)::INT AS candidates, coalesce(len(commodities), 0)::INT AS inventory FROM mineral_sites")
def site_documents(s, d):
    docs = export.site_documents(read(s, d, "golden_sheet"), read(s, d, "mineral_sites"), ["zn", "fe", "cd", "ge"])
    return docs.select("record_id", F.col("location_info.crs").alias("crs"), F.coalesce(F.size("deposit_type_candidate"), F.lit(-1)).alias("candidates"), F.size("mineral_inventory").alias("inventory"))


@query(
    'WITH m AS (SELECT *, \'site:\' || regexp_replace(trim(record_id, \' \'), \'[^A-Za-z0-9_.-]+\', \'_\', \'g\') AS s FROM mineral_sites), c AS (SELECT s, s || \'_t\' || (i - 1) AS node, deposit_type_candidate[i] AS c FROM (SELECT *, unnest(range(1, len(deposit_type_candidate) + 1)) AS i FROM m) WHERE deposit_type_candidate[i] IS NOT NULL) SELECT s || \' a :MineralSite .\' AS value FROM m WHERE s IS NOT NULL UNION ALL SELECT s || \' :name \' || \'"\' || replace(replace(replace(replace(name, chr(92), chr(92) || chr(92)), \'"\', chr(92) || \'"\'), chr(10), chr(92) || \'n\'), chr(13), chr(92) || \'r\') || \'"\' || \' .\' FROM m WHERE name IS NOT NULL UNION ALL SELECT s || \' :location "POINT(\' || longitude || \' \' || latitude || \')" .\' FROM m WHERE longitude IS NOT NULL AND latitude IS NOT NULL UNION ALL SELECT s || \' :candidate \' || node || \' .\' FROM c UNION ALL SELECT node || \' :observedName \' || \'"\' || replace(replace(replace(replace(c.observed_name, chr(92), chr(92) || chr(92)), \'"\', chr(92) || \'"\'), chr(10), chr(92) || \'n\'), chr(13), chr(92) || \'r\') || \'"\' || \' .\' FROM c WHERE c.observed_name IS NOT NULL UNION ALL SELECT node || \' :confidence \' || c.confidence || \' .\' FROM c WHERE c.confidence IS NOT NULL'
)
def turtle_statements(s, d):
    return export.triples(export.site_documents(read(s, d, "golden_sheet"), read(s, d, "mineral_sites"), ["zn", "fe"]))


@query()
def graphml_elements(s, d):
    nodes, edges = graph.sample_graph(read(s, d, "golden_sheet"), _GEL)
    return export.graphml(nodes, edges)


@query(
    "WITH r AS (SELECT file_id, line_no, line, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS n, count(*) OVER (PARTITION BY file_id) AS c FROM raw_appendix) SELECT file_id, md5(substr('line_no | line' || chr(10) || string_agg(line_no || ' | ' || coalesce(line, ''), chr(10) ORDER BY n) || CASE WHEN max(c) > 25 THEN chr(10) || '... ' || (max(c) - 25) || ' more rows' ELSE '' END, 1, 5000)) AS preview FROM r WHERE n <= 25 GROUP BY 1"
)
def sheet_previews(s, d):
    t = export.text_table(read(s, d, "raw_appendix").select("file_id", "line_no", "line"), ["file_id"], "line_no", ["line_no", "line"])
    return t.select("file_id", F.md5(F.encode("text", "UTF-8")).alias("preview"))


@query("SELECT event_id, (props::JSON->>'$.k')::INT AS k FROM events")
def model_answer_rows(s, d):
    e = read(s, d, "events")
    prompts = e.select("event_id", F.lit("extract").alias("system"), "props", F.col("props").alias("user"))
    answers = e.select(model_calls.prompt_key(F.lit("extract"), F.col("props")).alias("prompt_key"), F.concat(F.lit('Sure: {"samples": ['), "props", F.lit("]}")).alias("answer")).dropDuplicates(["prompt_key"])
    return model_calls.answer_rows(model_calls.answer_from_table(prompts, answers), "samples", "k int", ["event_id"])


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS \"end\", event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def windowed_events(s, d):
    return windowed_counts(read(s, d, "events")).withColumn("mean_value", F.round("mean_value", 6))


@query(
    "WITH a AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), b AS (SELECT *, sum((p IS NULL OR ts >= p + INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM b GROUP BY user_id, g"
)
def session_events(s, d):
    return sessions(read(s, d, "events"))


# ---- metadata and lookups


@query(
    "WITH m AS (SELECT doc_id, arg_min(deposit_name, row_id) FILTER (deposit_name IS NOT NULL) AS deposit_name, arg_min(mineral, row_id) FILTER (mineral IS NOT NULL) AS mineral FROM golden_sheet GROUP BY 1) "
    "SELECT e.row_id, e.last_update, coalesce(e.deposit_name, m.deposit_name) AS deposit_name, coalesce(e.mineral, m.mineral) AS mineral FROM extraction_sheet e LEFT JOIN m USING (doc_id)"
)
def metadata_override(s, d):
    g = read(s, d, "golden_sheet").select("doc_id", "row_id", "deposit_name", "mineral")
    meta = linkage.coalesce_merge(g.where("doc_id IS NOT NULL"), ["doc_id"], ["row_id"], ["deposit_name", "mineral"])
    rows = read(s, d, "extraction_sheet").select("doc_id", "row_id", "last_update", "deposit_name", "mineral")
    return enrichment.override_metadata(rows, meta, "doc_id", ["deposit_name", "mineral"]).drop("doc_id")


@query(
    "SELECT rec_id, nullif(list_aggregate(list_transform(list_sort(list_transform(list_filter(deposit_type_candidate, lambda c: c.observed_name IS NOT NULL), lambda c: {'s': -coalesce(c.confidence, 0), 'n': c.observed_name})), lambda c: printf('%s (%.2f)', c.n, round((-c.s)::DECIMAL(18, 6), 2))), 'string_agg', ' | '), '') AS alternatives FROM mineral_sites"
)
def candidate_alternatives(s, d):
    return read(s, d, "mineral_sites").select("rec_id", enrichment.candidates_text(F.col("deposit_type_candidate")).alias("alternatives"))


@query(
    "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)source:|et al\\.?,?\\s+\\(?[0-9]{4}') THEN 'cited_study:' || substr(trim(text, ' '), 1, 50) ELSE 'this_study' END AS tag FROM documents"
)
def source_tags(s, d):
    return read(s, d, "documents").select("doc_id", enrichment.source_tag(F.col("text")).alias("tag"))


_MINERALS = [("pyrite", "pyrite"), ("chalcopyrite", "chalcopyrite"), ("arsenopyrite", "arsenopyrite"), ("sphalerite", "sphalerite"), ("galena", "galena")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '\\b{w}\\b') THEN '{v}'" for w, v in sorted(_MINERALS, key=lambda x: -len(x[0]))) + " ELSE map {'cpy': 'chalcopyrite', 'sph': 'sphalerite', 'as': 'arsenopyrite'}[list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t IN ('cpy', 'sph', 'as'))[1]] END AS mineral FROM documents")
def word_lookups(s, d):
    return read(s, d, "documents").select("doc_id", enrichment.word_lookup(F.col("text"), _MINERALS, [("cpy", "chalcopyrite"), ("sph", "sphalerite"), ("as", "arsenopyrite")]).alias("mineral"))


@query(
    "WITH x AS (SELECT doc_id, arg_min(full_text, (content_id, full_text)) AS full_text FROM pdf_content WHERE full_text IS NOT NULL GROUP BY 1), r AS (SELECT doc_id, row_id, zn_ppm, row_number() OVER (PARTITION BY doc_id ORDER BY md5(row_id::VARCHAR), row_id, zn_ppm) AS n FROM golden_sheet WHERE zn_ppm >= 0), "
    "k AS (SELECT r.doc_id, contains(coalesce(x.full_text, ''), regexp_replace(printf('%.6f', zn_ppm), '[.]?0+$', '')) OR contains(coalesce(x.full_text, ''), round(zn_ppm)::BIGINT::VARCHAR) OR contains(coalesce(x.full_text, ''), printf('%.1f', zn_ppm)) OR contains(coalesce(x.full_text, ''), printf('%.2f', zn_ppm)) AS hit FROM r LEFT JOIN x ON x.doc_id = r.doc_id WHERE n <= 10), "
    "c AS (SELECT doc_id, count(*) AS checked, count(*) FILTER (hit) AS found FROM k GROUP BY 1) SELECT doc_id, checked, found, CASE WHEN found / checked >= 0.7 THEN 'verified' WHEN found / checked < 0.4 THEN 'suspicious' ELSE 'partial' END AS verdict FROM c"
)
def value_verification(s, d):
    texts = read(s, d, "pdf_content").where("full_text IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("content_id", "full_text"))["full_text"].alias("full_text"))
    return enrichment.verify_values(read(s, d, "golden_sheet").select("doc_id", "row_id", "zn_ppm"), texts, "doc_id", "row_id", "zn_ppm", "full_text")


_BUDGET = _SCORE_SQL.replace("SELECT doc_id, text,", "SELECT doc_id, paper_id, page_no, text,").replace("b AS (SELECT doc_id,", "b AS (SELECT doc_id, paper_id,").replace("c AS (SELECT doc_id,", "c AS (SELECT doc_id, paper_id,")


@query(_BUDGET.rstrip() + ", w AS (SELECT *, doc_id % 10 = 0 AS must, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id % 10 = 0 DESC, score DESC NULLS LAST, doc_id) AS n FROM c) SELECT paper_id, doc_id FROM w WHERE must OR (n <= 10 AND score IS NOT NULL)")
def page_budgets(s, d):
    p = read(s, d, "documents").where("text IS NOT NULL").select("paper_id", "doc_id", F.round(text.page_score(F.col("text")), 6).alias("score"), (F.col("doc_id") % 10 == 0).alias("must"), F.lit(60).alias("expected"))
    return enrichment.page_budget(p, "paper_id", "doc_id", "score", "must", "expected").select("paper_id", "doc_id")


_T1 = ["sample_name", "deposit_name", "mineral", "analytical_method"]
_FOLDED = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ')"


@query(
    "WITH t AS (SELECT doc_id, min((row_id, " + ", ".join(f"coalesce({f}, chr(0))" for f in _T1) + ")) AS r FROM golden_sheet GROUP BY 1), p AS (SELECT doc_id, min((row_id, " + ", ".join(f"coalesce({f}, chr(0))" for f in _T1) + ")) AS r FROM extraction_sheet GROUP BY 1), "
    "f AS (SELECT t.doc_id, unnest([" + ", ".join(f"nullif(t.r[{i}], chr(0))" for i in range(2, 6)) + "]) AS t, unnest([" + ", ".join(f"nullif(p.r[{i}], chr(0))" for i in range(2, 6)) + "]) AS p FROM t LEFT JOIN p ON t.doc_id = p.doc_id), "
    "g AS (SELECT doc_id, t, " + _FOLDED.format("t") + " AS a, " + _FOLDED.format("coalesce(p, '')") + " AS b FROM f WHERE t IS NOT NULL), s AS (SELECT doc_id, CASE WHEN a = b THEN 1 WHEN b = '' THEN 0 ELSE len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(string_split(a, ' ') || string_split(b, ' '))) END AS s FROM g) "
    "SELECT t.doc_id, round(coalesce(avg(s), 0), 6) AS t1, count(s)::INT AS fields FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY 1"
)
def tier1_metadata(s, d):
    return enrichment.metadata_scores(read(s, d, "extraction_sheet"), read(s, d, "golden_sheet"), "doc_id", "row_id", _T1).withColumn("t1", F.round("t1", 6))


_QE = ["zn_ppm", "fe_ppm", "cd_ppm", "ge_ppm"]


@query(
    "WITH a AS (SELECT doc_id, count(*) AS rows, " + " + ".join(f"(count({e}) > 0)::INT" for e in _QE) + " AS elements, " + " + ".join(f"(count(DISTINCT {e}) = 1 AND count({e}) > 1)::INT" for e in _QE) + " AS uniform, count(sample_name) / count(*) AS named FROM extraction_sheet GROUP BY 1) "
    "SELECT doc_id, rows, elements, CASE WHEN rows >= 5 THEN 40 ELSE 0 END + CASE WHEN elements >= 3 THEN 30 WHEN elements > 0 THEN 15 ELSE 0 END + CASE WHEN named >= 0.5 THEN 20 ELSE 0 END + CASE WHEN uniform = 0 THEN 10 ELSE 0 END AS score FROM a"
)
def quick_quality(s, d):
    return enrichment.quick_quality(read(s, d, "extraction_sheet"), ["doc_id"], "sample_name", _QE)


@query("SELECT event_id, event_type, label FROM events JOIN (VALUES ('click', 5, 'five'), ('click', NULL, 'any click'), ('error', 7, 'seven')) r(t, u, label) ON event_type = t AND (u IS NULL OR user_id = u)")
def rule_labels(s, d):
    rules = s.createDataFrame([("click", 5, "five"), ("click", None, "any click"), ("error", 7, "seven")], "event_type string, user_id bigint, label string")
    return enrichment.rule_match(read(s, d, "events").select("event_id", "event_type", "user_id"), rules, "event_type", "user_id").select("event_id", "event_type", "label")


@query("SELECT event_id, '{\"kept\":' || event_id || ',\"list\":[{\"note\":\"' || event_type || '\"},' || event_id || '],\"deep\":{\"x\":' || (props::JSON->>'$.k') || '}}' AS record FROM events")
def keys_dropped(s, d):
    k = F.get_json_object("props", "$.k")
    nested = F.concat(
        F.lit('{"kept":'), F.col("event_id").cast("string"), F.lit(',"changed_by":"a","list":[{"note":"'), "event_type", F.lit('","insert_date":{"y":1}},'), F.col("event_id").cast("string"), F.lit('],"deep":{"x":'), k, F.lit(',"change_date":null}}')
    )
    return read(s, d, "events").select("event_id", enrichment.without_keys(nested).alias("record"))
