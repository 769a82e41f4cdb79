"""Queries of quality, registries, rankings, pages and graphs beyond the first set, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import einsum, export, graph, layout, linkage, prompts, quality, ranking, relational, taxonomy
from lodestrata.session import broadcast_if_small, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- quality and registries

_META = ["deposit_name", "mineral", "analytical_method", "publication_date"]
_EL = {e: f"{e}_ppm" for e in ("zn", "fe", "cd", "ge")}
_IDS = ["sample_name", "sample_local_id"]


def _given(c: str) -> str:
    return f"CASE WHEN lower(trim({c}::VARCHAR, ' ')) NOT IN ('nan', 'none', '') THEN trim({c}::VARCHAR, ' ') END"


def _has(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


_HIGH = {e: f"coalesce(m_{e} > {1000000 if e in ('fe',) else 100000}, false)" for e in _EL}
_QUALITY = (
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_id, last_update) AS pos FROM (SELECT DISTINCT * FROM extraction_sheet)), "
    "a AS (SELECT doc_id, count(*) AS rows, " + ", ".join(f"count({c}) AS n_{e}, max({c}) FILTER ({c} >= 0) AS m_{e}" for e, c in _EL.items())
    + ", " + ", ".join(f"count({_given(c)}) AS c_{i}, count(DISTINCT {_given(c)}) AS u_{i}" for i, c in enumerate(_IDS)) + ", "
    + ", ".join(f"max(CASE WHEN pos = 1 THEN {_given(c)} END) AS f_{c}" for c in _META) + " FROM r GROUP BY 1), "
    "b AS (SELECT *, (" + " + ".join(f"(f_{c} IS NOT NULL)::INT" for c in _META) + f") / {len(_META)}.0::DOUBLE AS meta, (" + " + ".join(f"(n_{e} > 0)::INT" for e in _EL) + ") / 73.0::DOUBLE AS el, "
    + "CASE " + " ".join(f"WHEN c_{i} > 0 THEN least(1, 0.5 * u_{i} / c_{i} + 0.5 * c_{i} / rows)" for i in range(len(_IDS))) + " ELSE 0 END AS ids, "
    + "CASE WHEN " + " + ".join(f"(n_{e} > 0)::INT" for e in _EL) + " > 0 THEN (" + " + ".join(f"(n_{e} > 0 AND NOT {_HIGH[e]})::INT" for e in _EL) + ") / (" + " + ".join(f"(n_{e} > 0)::INT" for e in _EL) + ") ELSE 1 END AS pl, "
    + f"[CASE WHEN f_analytical_method IS NOT NULL THEN {_has('f_analytical_method', quality.KNOWN_METHODS)}::INT::DOUBLE END, CASE WHEN f_mineral IS NOT NULL THEN CASE WHEN {_has('f_mineral', quality.KNOWN_MINERALS)} THEN 1.0 ELSE 0.5 END END, "
    "CASE WHEN f_publication_date IS NOT NULL THEN coalesce((try_cast(nullif(regexp_extract(f_publication_date, '([0-9]{4})', 1), '') AS INT) BETWEEN 1990 AND 2030)::INT::DOUBLE, 0) END] AS checks FROM a), "
    "c AS (SELECT *, coalesce(list_avg(checks), 0.5) AS con FROM b) "
    "SELECT doc_id, rows, round(100 * meta, 2) AS metadata, round(100 * el, 2) AS elements, round(100 * ids, 2) AS ids, round(100 * pl, 2) AS plausibility, round(100 * con, 2) AS consistency, round(100 * (0.2 * meta + 0.15 * el + 0.2 * ids + 0.25 * pl + 0.2 * con), 2) AS quality FROM c"
)


@query(_QUALITY)
def quality_score(s, d):
    e = read(s, d, "extraction_sheet").distinct()
    q = quality.quality_scores(e, ["doc_id"], ["row_id", "last_update"], _META, _EL, _IDS, "analytical_method", "mineral", "publication_date")
    return q.drop("issues")


@query("SELECT file_id, count(*) >= 3 AND max(len(string_split(line, delim))) >= 3 AND sum(CASE WHEN line_no < 10 THEN len(list_filter(string_split(line, delim), lambda x: regexp_matches(trim(x, ' '), '^[<>]?\\s*[-+]?[0-9][0-9.,]*(?:[eE][-+]?[0-9]+)?$'))) ELSE 0 END) >= 5 AS is_data FROM raw_appendix JOIN raw_files USING (file_id) WHERE line IS NOT NULL GROUP BY 1")
def data_tables(s, d):
    j = read(s, d, "raw_appendix").where("line IS NOT NULL").join(broadcast_if_small(read(s, d, "raw_files").select("file_id", "delim"), 100_000), "file_id")
    rows = j.select("file_id", F.col("line_no").alias("row_no"), F.split("line", F.concat(F.lit("\\Q"), "delim", F.lit("\\E")), F.lit(-1)).alias("cells"))
    return quality.is_data_table(rows, ["file_id"])


@query(f"WITH n AS (SELECT unnest([0, 1]) AS c, unnest([trim(sample_local_id, ' '), trim(sample_name, ' ')]) AS id FROM extraction_sheet), k AS (SELECT DISTINCT c, id FROM n WHERE id <> '' AND length(id) <= 100 AND NOT regexp_matches(id, '{quality.NO_SAMPLE_NAME}')) SELECT id FROM k WHERE c = (SELECT min(c) FROM k)")
def sample_ids(s, d):
    return quality.id_list(read(s, d, "extraction_sheet"), ["sample_local_id", "sample_name"])


@query("SELECT row_id, last_update, string_split(string_split(local, '@')[1], '-spot')[1] AS base, CASE WHEN regexp_matches(local, '[0-9]{4}') THEN try_cast(regexp_extract(local, '([0-9]{4})', 1) AS INT) END AS year FROM (SELECT DISTINCT row_id, last_update, sample_name || '-spot' || (row_id % 7) AS local FROM golden_sheet WHERE sample_name IS NOT NULL)")
def derived_ids(s, d):
    g = read(s, d, "golden_sheet").where("sample_name IS NOT NULL").select("row_id", "last_update", F.concat("sample_name", F.lit("-spot"), (F.col("row_id") % 7).cast("string")).alias("l")).distinct()
    return g.select("row_id", "last_update", quality.base_sample_id(F.col("l")).alias("base"), quality.year_of(F.col("l")).alias("year"))


@query(
    "WITH m AS (SELECT DISTINCT meas_id, original_value AS cell, lower(trim(original_value, ' ')) AS t FROM measurements), k AS (SELECT *, try_cast(nullif(regexp_extract(t, '^<\\s*([0-9]*\\.?[0-9]+)$', 1), '') AS DOUBLE) AS lim, CASE WHEN regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(t AS DOUBLE) END AS v FROM m), "
    "x AS (SELECT *, CASE WHEN t IS NULL OR t = '' OR t IN (" + ",".join(f"'{w}'" for w in quality.NOT_ANALYSED_WORDS) + ") THEN 'none' WHEN t IN (" + ",".join(f"'{w}'" for w in quality.BELOW_WORDS) + ") THEN 'bdl' WHEN lim > 0 THEN 'limit' WHEN v IS NOT NULL THEN 'number' ELSE 'text' END AS kind FROM k) "
    "SELECT meas_id, kind, CASE kind WHEN 'bdl' THEN -99999 WHEN 'limit' THEN -lim WHEN 'number' THEN v END AS value, CASE WHEN kind = 'text' THEN cell END AS text FROM x"
)
def corrected_cells(s, d):
    m = read(s, d, "measurements").select("meas_id", "original_value").distinct()
    return m.select("meas_id", quality.corrected_cell(F.col("original_value")).alias("c")).select("meas_id", "c.kind", "c.value", "c.text")


@query("WITH d AS (SELECT DISTINCT paper_id FROM documents WHERE doc_id % 3 = 0), p AS (SELECT doc_id, text, CASE WHEN paper_id IN (SELECT paper_id FROM d WHERE paper_id IS NOT NULL) THEN 'done' WHEN coalesce(trim(text, ' '), '') <> '' AND coalesce(trim(section, ' '), '') <> '' THEN 'ready' ELSE 'incomplete' END AS state FROM documents) SELECT state, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM p")
def registry_counts(s, d):
    docs = read(s, d, "documents")
    r = quality.registry_state(docs.select("paper_id", "text", "section"), docs.where("doc_id % 3 = 0").select("paper_id"), "paper_id", ["text", "section"])
    return quality.state_counts(r, "state")


@query("SELECT paper_id, array_to_string(list_distinct_sections, ',') AS sections, len(list_distinct_sections)::INT AS n FROM (SELECT paper_id, list(section ORDER BY f) AS list_distinct_sections FROM (SELECT paper_id, section, min(doc_id) AS f FROM documents WHERE section IS NOT NULL GROUP BY ALL) GROUP BY 1)")
def distinct_sections(s, d):
    x = quality.distinct_in_order(read(s, d, "documents").select("paper_id", "section", "doc_id"), ["paper_id"], "section", ["doc_id"])
    return x.select("paper_id", F.array_join("values", ",").alias("sections"), "n")


@query("SELECT paper_id, section, contains(lower(coalesce(any_value(section), '')), 'summary') OR len(list_filter(list(split_part(text, ' ', 1) ORDER BY doc_id)[1:5], lambda x: " + " OR ".join(f"contains(lower(x), '{w}')" for w in quality.SUMMARY_WORDS) + ")) > 0 AS summary FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def summary_tables(s, d):
    t = read(s, d, "documents").where("text IS NOT NULL").groupBy("paper_id", "section").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.substring_index("text", " ", 1).alias("c")))).alias("l"))
    return t.select("paper_id", "section", quality.is_summary_table(F.col("section"), F.transform("l", lambda x: x["c"])).alias("summary"))


# ---- sets, lookups


@query("SELECT DISTINCT sample_name, 'both' AS side FROM golden_sheet WHERE sample_name IN (SELECT sample_name FROM extraction_sheet) UNION ALL SELECT DISTINCT sample_name, 'golden' FROM golden_sheet WHERE sample_name IS NOT NULL AND sample_name NOT IN (SELECT sample_name FROM extraction_sheet WHERE sample_name IS NOT NULL) UNION ALL SELECT DISTINCT sample_name, 'extraction' FROM extraction_sheet WHERE sample_name IS NOT NULL AND sample_name NOT IN (SELECT sample_name FROM golden_sheet WHERE sample_name IS NOT NULL)")
def name_sets(s, d):
    return relational.set_sides(read(s, d, "golden_sheet"), read(s, d, "extraction_sheet"), "sample_name", "golden", "extraction")


@query("SELECT column_name, side FROM (VALUES " + ", ".join(f"('{c}', 'both')" for c in ["row_id", "doc_id", "analysis_id", "sample_name", "sample_local_id", "deposit_name", "deposit_type_original", "mineral", "analytical_method", "zn_ppm", "fe_ppm", "cd_ppm", "ge_ppm", "publication_date", "last_update"]) + ", ('extraction_backend', 'right'), ('extraction_confidence', 'right')) v(column_name, side)")
def schema_sets(s, d):
    return relational.column_sides(read(s, d, "golden_sheet"), read(s, d, "extraction_sheet"))


@query(
    "WITH q AS (SELECT DISTINCT doc_id, sample_name AS wanted FROM golden_sheet WHERE sample_name IS NOT NULL), e AS (SELECT DISTINCT doc_id, sample_name AS n, sample_local_id AS l FROM extraction_sheet), "
    "h AS (SELECT q.doc_id, wanted, 1 AS stage, n AS hit FROM q JOIN e ON q.doc_id = e.doc_id AND n = wanted UNION SELECT q.doc_id, wanted, 2, n FROM q JOIN e ON q.doc_id = e.doc_id AND lower(trim(n, ' ')) = lower(trim(wanted, ' ')) UNION SELECT q.doc_id, wanted, 3, l FROM q JOIN e ON q.doc_id = e.doc_id AND lower(trim(l, ' ')) = lower(trim(wanted, ' '))), "
    "m AS (SELECT doc_id, wanted, min(stage) AS stage FROM h GROUP BY ALL) SELECT h.doc_id, h.wanted, h.stage, h.hit FROM h JOIN m ON h.doc_id = m.doc_id AND h.wanted = m.wanted AND h.stage = m.stage WHERE hit IS NOT NULL"
)
def staged_lookup(s, d):
    q = read(s, d, "golden_sheet").where("sample_name IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("sample_name").alias("wanted"))
    return linkage.staged_hits(q, read(s, d, "extraction_sheet").where("doc_id IS NOT NULL"), ["doc_id"], "wanted", ["sample_name", "sample_local_id"])


@query("SELECT rec_id, coalesce(t.deposit_group, '') AS deposit_group, coalesce(t.deposit_environment, '') AS deposit_environment FROM (SELECT rec_id, regexp_extract(rtrim(trim(c.normalized_uri, ' '), '/'), '([^/]*)$', 1) AS id FROM (SELECT rec_id, deposit_type_candidate[1] AS c FROM mineral_sites)) s LEFT JOIN deposit_types t ON lower(t.type_id) = lower(s.id)")
def taxonomy_by_id(s, d):
    m = read(s, d, "mineral_sites").select("rec_id", F.try_element_at("deposit_type_candidate", F.lit(1))["normalized_uri"].alias("u"))
    ids = m.select("rec_id", F.regexp_extract(F.regexp_replace(F.trim("u"), "/+$", ""), r"([^/]*)$", 1).alias("type_id"))
    return taxonomy.with_levels(ids, read(s, d, "deposit_types"), "type_id", ["deposit_group", "deposit_environment"]).select("rec_id", "deposit_group", "deposit_environment")


# ---- rankings


@query(
    "WITH x AS (SELECT user_id AS rec, event_id % 4 AS chunk, event_type AS opt, avg(value) / 50 AS logp FROM events GROUP BY ALL), e AS (SELECT *, exp((logp - max(logp) OVER w) / 2) AS e FROM x WINDOW w AS (PARTITION BY rec, chunk)), p AS (SELECT *, e / sum(e) OVER (PARTITION BY rec, chunk) AS p FROM e) "
    "SELECT rec, opt, round(ln(sum(p) / any_value(k)), 6) AS logp FROM p JOIN (SELECT rec, count(DISTINCT chunk) AS k FROM x GROUP BY 1) USING (rec) GROUP BY ALL"
)
def chunk_softmax(s, d):
    x = read(s, d, "events").groupBy(F.col("user_id").alias("rec"), (F.col("event_id") % 4).alias("chunk"), F.col("event_type").alias("opt")).agg((F.avg("value") / 50).alias("logp"))
    return ranking.chunk_softmax(x, "rec", "chunk", "opt", "logp", temperature=2.0).withColumn("logp", F.round("logp", 6))


@query("SELECT event_type AS metric, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1")
def metric_means(s, d):
    return ranking.metric_means(read(s, d, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6)).withColumnRenamed("event_type", "metric")


@query(
    "WITH l AS (SELECT p_brand AS site, p_type AS opt, avg(p_retailprice) / 1000 AS s FROM part GROUP BY ALL), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY site)) AS e FROM l), p AS (SELECT site, opt, e / sum(e) OVER (PARTITION BY site) AS p FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY p DESC, opt) AS rk FROM p), "
    "o AS (SELECT DISTINCT opt FROM l ORDER BY opt LIMIT 3) SELECT site, max(opt) FILTER (rk = 1) AS top_1, round(max(p) FILTER (rk = 1), 6) AS top_1_p, max(opt) FILTER (rk = 2) AS top_2, round(max(p) FILTER (rk = 2), 6) AS top_2_p FROM r GROUP BY 1"
)
def wide_sites(s, d):
    p = read(s, d, "part").groupBy(F.col("p_brand").alias("site"), F.col("p_type").alias("opt")).agg((F.avg("p_retailprice") / 1000).alias("s"))
    return ranking.wide_scores(p, "site", "opt", "s", top=2).drop("scores")


@query("WITH l AS (SELECT p_brand AS rec, p_type AS opt, avg(p_retailprice) AS s FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s DESC, opt) AS rank FROM l) SELECT rec, opt, rank FROM r WHERE rank <= 3 AND s >= 1000")
def shortlist(s, d):
    p = read(s, d, "part").groupBy(F.col("p_brand").alias("rec"), F.col("p_type").alias("opt")).agg(F.avg("p_retailprice").alias("s"))
    return ranking.shortlist(p, "rec", "opt", "s", 3, at_least=1000.0).select("rec", "opt", "rank")


@query(
    "WITH p AS (SELECT rec_id, c.observed_name AS name, c.confidence AS score FROM (SELECT rec_id, unnest(deposit_type_candidate) AS c FROM mineral_sites)), k AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY score DESC NULLS LAST, name) AS r FROM p WHERE name IS NOT NULL AND score >= 0.3) "
    "SELECT m.rec_id, coalesce(k.name, m.state) AS label, k.score AS score FROM (SELECT DISTINCT rec_id, state FROM mineral_sites) m LEFT JOIN k ON k.rec_id = m.rec_id AND r = 1"
)
def applied_classification(s, d):
    m = read(s, d, "mineral_sites")
    c = m.select("rec_id", F.explode("deposit_type_candidate").alias("c")).select("rec_id", F.col("c.observed_name").alias("name"), F.col("c.confidence").alias("score"))
    return ranking.apply_best(m.select("rec_id", "state").distinct(), c, "rec_id", "name", "score", "state", 0.3)


# ---- pages


@query("SELECT doc_id, section AS stem, round(page_no * 10 / 612.0, 6) AS x, round(page_no * 20 / 792.0, 6) AS y, round(50 / 612.0, 6) AS w, round(60 / 792.0, 6) AS h FROM documents WHERE page_no IS NOT NULL")
def page_boxes(s, d):
    docs = read(s, d, "documents").where("page_no IS NOT NULL")
    b = layout.relative_box(F.col("page_no") * 10.0, F.col("page_no") * 20.0, F.lit(50.0), F.lit(60.0), F.lit(612.0), F.lit(792.0))
    return docs.select("doc_id", F.col("section").alias("stem"), b.alias("b")).select("doc_id", "stem", *[F.round(f"b.{c}", 6).alias(c) for c in ("x", "y", "w", "h")])


@query("SELECT file_id, regexp_extract(file_name, '([^/\\\\]+?)(\\.[A-Za-z0-9]+)?$', 1) AS stem, try_cast(nullif(regexp_extract(file_name, '^(?:.*/)?([0-9]{4})', 1), '') AS INT) AS year FROM raw_files")
def file_stems(s, d):
    f = read(s, d, "raw_files")
    return f.select("file_id", layout.file_stem(F.col("file_name")).alias("stem"), layout.leading_year(F.col("file_name")).alias("year"))


@query(
    "WITH w AS (SELECT doc_id, unnest(range(1, len(string_split(text, ' ')) + 1)) AS n, unnest(string_split(text, ' ')) AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, (n - 1) // 40 AS block, string_agg(t, ' ' ORDER BY n) AS t FROM w WHERE t <> '' GROUP BY ALL) SELECT doc_id, block, md5(regexp_replace(t, '([A-Za-z])- ([a-z])', '\\1\\2', 'g')) AS digest FROM b"
)
def ocr_blocks(s, d):
    words = read(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", " ")).alias("n", "w")).where("w <> ''")
    blocks = layout.block_texts(words.withColumn("block", F.floor(F.col("n") / 40)), ["doc_id", "block"], "n", "w")
    return blocks.select("doc_id", "block", F.md5(F.encode("text", "UTF-8")).alias("digest"))


# ---- graph of entities


@query(
    "WITH d AS (SELECT DISTINCT doc_id, sample_name, mineral, analytical_method FROM golden_sheet WHERE doc_id IS NOT NULL AND sample_name IS NOT NULL) SELECT DISTINCT 'sample/' || doc_id || '/' || sample_name AS src, 'method:' || analytical_method AS dst, 'ANALYSED_BY' AS type FROM d WHERE analytical_method IS NOT NULL UNION ALL SELECT DISTINCT 'sample/' || doc_id || '/' || sample_name, 'mineral:' || mineral, 'CONTAINS_MINERAL' FROM d WHERE mineral IS NOT NULL "
    "UNION ALL SELECT DISTINCT 'paper/' || doc_id, 'sample/' || doc_id || '/' || sample_name, 'REPORTS' FROM d"
)
def entity_graph_edges(s, d):
    g = read(s, d, "golden_sheet").where("doc_id IS NOT NULL AND sample_name IS NOT NULL")
    e = g.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("sample_name").alias("name"), "mineral", F.col("analytical_method").alias("method"))).alias("samples"))
    _, edges = graph.entity_graph(e, "doc_id", "samples")
    return edges.select("src", "dst", "type")


_GEL = ["zn", "fe"]
_ES = "SELECT *, string_split(string_split(sample_name, '@')[1], '-spot')[1] AS base FROM golden_sheet WHERE doc_id IS NOT NULL AND sample_name IS NOT NULL AND analysis_id IS NOT NULL"


@query(
    f"WITH s AS ({_ES}), e AS (SELECT DISTINCT 'contains' AS type, 'paper:' || doc_id AS a, 'deposit:' || deposit_name AS b FROM s WHERE deposit_name IS NOT NULL UNION SELECT 'contains', coalesce('deposit:' || deposit_name, 'paper:' || doc_id), 'sample:' || base FROM s UNION SELECT 'analyzed_by', 'sample:' || base, 'analysis:' || sample_name || ':' || analysis_id FROM s "
    "UNION SELECT 'target_mineral', 'analysis:' || sample_name || ':' || analysis_id, 'mineral:' || lower(mineral) FROM s WHERE mineral IS NOT NULL UNION SELECT 'used_method', 'analysis:' || sample_name || ':' || analysis_id, 'method:' || analytical_method FROM s WHERE analytical_method IS NOT NULL "
    "UNION SELECT 'measured', 'analysis:' || sample_name || ':' || analysis_id, 'measurement:' || sample_name || ':' || analysis_id || ':' || el FROM (SELECT *, 'zn' AS el FROM s WHERE zn_ppm IS NOT NULL UNION ALL SELECT *, 'fe' FROM s WHERE fe_ppm IS NOT NULL) "
    "UNION SELECT 'part_of', 'measurement:' || sample_name || ':' || analysis_id || ':' || el, 'element:' || el FROM (SELECT *, 'zn' AS el FROM s WHERE zn_ppm IS NOT NULL UNION ALL SELECT *, 'fe' FROM s WHERE fe_ppm IS NOT NULL) UNION SELECT 'classified_as', 'deposit:' || deposit_name, 'type:' || deposit_type_original FROM s WHERE deposit_name IS NOT NULL AND deposit_type_original IS NOT NULL) "
    "SELECT type, count(*) AS n, count(DISTINCT a) AS sources, count(DISTINCT b) AS targets FROM e GROUP BY 1"
)
def extraction_graph_edges(s, d):
    g = read(s, d, "golden_sheet").where("doc_id IS NOT NULL AND sample_name IS NOT NULL AND analysis_id IS NOT NULL")
    _, edges = graph.extraction_graph(g, _GEL)
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query(
    f"WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_name, analysis_id ORDER BY row_id, last_update) AS rn FROM ({_ES})) WHERE rn = 1), m AS (SELECT sample_name, analysis_id, 'zn' AS el, zn_ppm AS v FROM s UNION ALL SELECT sample_name, analysis_id, 'fe', fe_ppm FROM s) SELECT 'analysis:' || sample_name || ':' || analysis_id AS analysis, min(CASE WHEN el = 'zn' AND v >= 0 THEN v END) AS zn, min(CASE WHEN el = 'fe' AND v >= 0 THEN v END) AS fe FROM m WHERE v IS NOT NULL GROUP BY 1"
)
def graph_to_rows(s, d):
    g = read(s, d, "golden_sheet").where("doc_id IS NOT NULL AND sample_name IS NOT NULL AND analysis_id IS NOT NULL")
    one = relational.first_per_key(g, ["sample_name", "analysis_id"], [F.col("row_id"), F.col("last_update")])
    nodes, edges = graph.extraction_graph(one, _GEL)
    return graph.analysis_rows(nodes, edges, _GEL)


@query(
    "WITH t AS (SELECT row_id, last_update, row_number() OVER (PARTITION BY doc_id ORDER BY row_id, last_update) AS i, doc_id, zn_ppm, fe_ppm FROM (SELECT DISTINCT doc_id, row_id, last_update, zn_ppm, fe_ppm FROM golden_sheet WHERE doc_id IS NOT NULL)), p AS (SELECT doc_id, i + 2 AS i, zn_ppm * 1.05 AS zn_ppm, fe_ppm FROM t WHERE i > 1), "
    "m AS (SELECT t.doc_id, t.i AS truth_at, p.i AS pred_at, o.o, (coalesce(p.zn_ppm > 0 AND t.zn_ppm > 0, false))::INT + (coalesce(p.fe_ppm > 0 AND t.fe_ppm > 0, false))::INT AS bth, (coalesce(p.zn_ppm > 0 AND t.zn_ppm > 0 AND abs(p.zn_ppm - t.zn_ppm) <= 0.1 * t.zn_ppm, false))::INT + (coalesce(p.fe_ppm > 0 AND t.fe_ppm > 0 AND abs(p.fe_ppm - t.fe_ppm) <= 0.1 * t.fe_ppm, false))::INT AS near FROM t, range(11) o(o), p WHERE p.doc_id = t.doc_id AND p.i = t.i + o.o), "
    "a AS (SELECT * FROM m WHERE bth > 0 AND near >= 0.3 * bth), c AS (SELECT doc_id, o, count(*) AS k FROM a GROUP BY 1, 2), b AS (SELECT doc_id, o, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, o) AS r FROM c) SELECT a.doc_id, truth_at, pred_at, a.o::INT AS \"offset\" FROM a JOIN b ON a.doc_id = b.doc_id AND a.o = b.o AND r = 1"
)
def offset_match(s, d):
    from pyspark.sql import Window

    g = read(s, d, "golden_sheet").where("doc_id IS NOT NULL").select("doc_id", "row_id", "last_update", "zn_ppm", "fe_ppm").distinct()
    t = g.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_id", "last_update"))).select("doc_id", "i", "zn_ppm", "fe_ppm")
    p = t.where("i > 1").select("doc_id", (F.col("i") + 2).alias("i"), (F.col("zn_ppm") * 1.05).alias("zn_ppm"), "fe_ppm")
    return linkage.offset_pairs(p, t, ["doc_id"], "i", ["zn_ppm", "fe_ppm"])


# ---- tensors


@query("SELECT r_regionkey AS r, round(sum(s_acctbal) / count(*), 4) AS v FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def masked_pool(s, d):
    x = read(s, d, "supplier").join(broadcast_if_small(read(s, d, "nation"), 10_000), F.col("s_nationkey") == F.col("n_nationkey"))
    values = x.select(F.col("n_regionkey").alias("r"), F.col("s_suppkey").alias("s"), F.col("s_acctbal").alias("v"))
    return einsum.masked_pooling("rs->r", values, values.withColumn("v", F.lit(1.0)), {"r": 5, "s": 10_000}).withColumn("v", F.round("v", 4))


@query("WITH n AS (SELECT n_regionkey AS a, sum(n_nationkey)::DOUBLE AS v FROM nation GROUP BY 1) SELECT n.a, n.a AS a2, r_regionkey AS b, v FROM n, region")
def equivariant_expand(s, d):
    n = read(s, d, "nation").select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("c"), F.col("n_nationkey").cast("double").alias("v"))
    domain = read(s, d, "region").select(F.col("r_regionkey").alias("b"))
    return einsum.einsum_expanded("ac->aab", n, domains={"b": domain}, sizes={"a": 5, "c": 25})


# ---- exports and prompts


@query("SELECT deposit_environment, 'Environment ' || coalesce(deposit_environment, '') || ' (' || sum(n)::BIGINT || '):' || chr(10) || string_agg('  ' || coalesce(deposit_group, '') || ':' || chr(10) || '    - ' || l, chr(10) ORDER BY coalesce(deposit_group, '')) AS text FROM (SELECT deposit_environment, deposit_group, count(DISTINCT deposit_type) AS n, string_agg(DISTINCT deposit_type, chr(10) || '    - ' ORDER BY deposit_type) AS l FROM deposit_types WHERE deposit_type IS NOT NULL GROUP BY ALL) GROUP BY 1")
def taxonomy_prompt(s, d):
    return prompts.listing(read(s, d, "deposit_types"), ["deposit_environment", "deposit_group"], "deposit_type", "Environment")


@query(
    "WITH m AS (SELECT doc_id, sample_name, element, CASE WHEN v >= 0 THEN round(v, 4) END AS ppm, v < 0 AS b FROM (SELECT doc_id, sample_name, 'fe' AS element, fe_ppm AS v FROM golden_sheet UNION ALL SELECT doc_id, sample_name, 'zn', zn_ppm FROM golden_sheet) WHERE v IS NOT NULL) "
    "SELECT doc_id, sample_name, count(DISTINCT (element, coalesce(ppm, -1), b))::INT AS measurements, round(sum(DISTINCT ppm) FILTER (element = 'zn'), 3) AS zn, (count(DISTINCT element) FILTER (b) > 0) AS below FROM m GROUP BY ALL"
)
def linked_samples(s, d):
    """The nested objects, read back from their JSON: what was nested is there."""
    j = export.linked_samples(read(s, d, "golden_sheet"), ["fe", "zn"], "https://example.org/sample/", ["doc_id", "sample_name"])
    x = j.select("doc_id", "sample_name", F.from_json("value", "measurements array<struct<element:string,ppm:double,below_detection:boolean>>")["measurements"].alias("m"))
    zn = F.array_distinct(F.filter(F.transform(F.filter("m", lambda e: e["element"] == "zn"), lambda e: e["ppm"]), lambda v: v.isNotNull()))
    return x.select("doc_id", "sample_name", F.size("m").alias("measurements"), F.when(F.size(zn) > 0, F.round(F.aggregate(zn, F.lit(0.0), lambda a, v: a + v), 3)).alias("zn"), F.exists("m", lambda e: e["below_detection"]).alias("below"))


@query("SELECT paper_id, count(*)::INT AS boxes, count(DISTINCT page_no)::INT AS images, sum(page_no * 100)::DOUBLE AS area FROM documents WHERE section IS NOT NULL AND page_no IS NOT NULL GROUP BY 1")
def annotations(s, d):
    r = read(s, d, "documents").where("page_no IS NOT NULL").select("paper_id", F.col("page_no").cast("string").alias("image"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("page_no").cast("double").alias("w"), F.lit(100.0).alias("h"), "section")
    j = export.annotation_documents(r, "paper_id", "image", ["x", "y", "w", "h"], "section")
    x = j.select("paper_id", F.from_json("value", "images array<string>, annotations array<struct<id:int,area:double>>").alias("v"))
    return x.select("paper_id", F.size("v.annotations").alias("boxes"), F.size("v.images").alias("images"), F.aggregate("v.annotations", F.lit(0.0), lambda a, e: a + e["area"]).alias("area"))


@query("SELECT row_id, extracted AS sample_name, zn_ppm, NULL::DOUBLE AS ag_ppm, mineral FROM (SELECT row_id, sample_name AS extracted, zn_ppm, mineral FROM golden_sheet)")
def schema_projection(s, d):
    g = read(s, d, "golden_sheet").select("row_id", F.col("sample_name").alias("extracted"), "zn_ppm", "mineral", "doc_id")
    return export.schema_columns(g, {"row_id": "bigint", "sample_name": "string", "zn_ppm": "double", "ag_ppm": "double", "mineral": "string"}, {"extracted": "sample_name"})


@query("SELECT rec_id, item, string_split(string_split(deposit_id || '@L1', '@')[1], '-spot')[1] AS base_sample FROM (SELECT rec_id, deposit_id, trim(unnest(string_split(commodity, ',')), ' ') AS item FROM sedau WHERE commodity IS NOT NULL AND trim(commodity, ' ') <> '' UNION ALL SELECT rec_id, deposit_id, CASE WHEN regexp_matches(lower(deposit_name), '\\bcreek\\b') THEN 'creek' END FROM sedau WHERE commodity IS NULL OR trim(commodity, ' ') = '') WHERE deposit_id IS NOT NULL")
def tidied_rows(s, d):
    x = read(s, d, "sedau").where("deposit_id IS NOT NULL").select("rec_id", "commodity", "deposit_name", F.concat("deposit_id", F.lit("@L1")).alias("local"))
    out = prompts.tidy_rows(x, "commodity", "deposit_name", "local", [("creek", "creek")], [("zzqq", "none")])
    return out.select("rec_id", F.col("mineral_read").alias("item"), "base_sample")


@query(
    "WITH t AS (SELECT *, list_filter(regexp_split_to_array(lower(deposit_type), '[^a-z]+'), lambda w: length(w) > 3) AS w, list_filter(string_split_regex(lower(deposit_type), '\\s+'), lambda w: length(w) > 3) AS nw FROM deposit_types), "
    "p AS (SELECT rec_id, lower(deposit_model) AS low, lower(coalesce(deposit_name, '')) AS named, list_filter(list_transform(string_split(lower(coalesce(commodity, '')), ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS goods, t.* FROM sedau, t WHERE deposit_model IS NOT NULL), "
    "s AS (SELECT rec_id, type_id, len(list_filter(w, lambda x: contains(low, x))) / len(w) * 0.3 AS o, contains(low, lower(deposit_type)) AS a, contains(low, lower(deposit_group)) AS b, contains(low, lower(deposit_environment)) AS c, len(list_filter(nw, lambda x: contains(named, x))) > 0 AS d, len(list_filter(goods, lambda g: contains(lower(deposit_type), g))) > 0 AS e FROM p), "
    "r AS (SELECT rec_id, type_id, round(least(1, (CASE WHEN a THEN 0.4 ELSE 0 END)::DOUBLE + (CASE WHEN b THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN c THEN 0.1 ELSE 0 END)::DOUBLE + CASE WHEN least(0.2, o) > 0.05 THEN least(0.2, o) ELSE 0 END + (CASE WHEN d THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN e THEN 0.1 ELSE 0 END)::DOUBLE), 3) AS score FROM s), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, type_id)::INT AS rank FROM r WHERE score > 0.05) SELECT rec_id, rank, type_id, score FROM k WHERE rank <= 10"
)
def type_scores_of_sites(s, d):
    goods = F.filter(F.transform(F.split(F.coalesce("commodity", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    x = read(s, d, "sedau").select("rec_id", "deposit_model", "deposit_name", goods.alias("goods"))
    return taxonomy.score_types(x, read(s, d, "deposit_types"), "rec_id", "deposit_model", deposit="deposit_name", goods="goods")
