"""Property graphs from flat tables and back: nodes(id, type, properties), edges(src, dst, type, properties)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _properties(**columns: Column) -> Column:
    filled = F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*[c.cast("string") for c in columns.values()]))
    return F.map_filter(filled, lambda k, v: v.isNotNull())


def merge_nodes(nodes: DataFrame, order: str | None = None) -> DataFrame:
    """One node an id: its first type, of each property the first non-null value. Aggregates by (id, property), map-side."""
    o = F.col(order) if order else F.lit(0)
    base = nodes.groupBy("id").agg(F.min(F.struct(o.alias("o"), "type"))["type"].alias("type"))
    props = nodes.select("id", o.alias("o"), F.explode("properties").alias("k", "v")).where("v IS NOT NULL").groupBy("id", "k").agg(F.min(F.struct("o", "v"))["v"].alias("v"))
    maps = props.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    empty = F.create_map().cast("map<string,string>")
    return base.join(maps, "id", "left").select("id", "type", F.coalesce("properties", empty).alias("properties"))


def sample_graph(sheet: DataFrame, elements: list[str]) -> tuple[DataFrame, DataFrame]:
    """Papers, deposits, samples, minerals, methods and measurements of a sheet as nodes and edges.

    A measurement's id holds its row and element, so two methods on one sample stay two. Rows without a sample name give no sample.
    """
    s = sheet.where(F.col("sample_name").isNotNull())
    nid = lambda kind, c: F.concat(F.lit(kind + ":"), c.cast("string"))
    sample = F.concat_ws("/", F.lit("sample"), "doc_id", "sample_name")
    m = s.select("*", F.explode(F.array(*[F.struct(F.lit(e).alias("el"), F.col(f"{e}_ppm").alias("v")) for e in elements])).alias("m")).where("m.v IS NOT NULL")
    measure = F.concat_ws("/", F.lit("m"), F.col("row_id").cast("string"), "m.el")
    value = _properties(value=F.when(F.col("m.v") >= 0, F.col("m.v")), is_bdl=F.col("m.v") < 0)
    nodes = [
        s.select(nid("paper", F.col("doc_id")).alias("id"), F.lit("Paper").alias("type"), _properties(year=F.col("publication_date")).alias("properties")),
        s.where("deposit_name IS NOT NULL").select(nid("deposit", F.col("deposit_name")).alias("id"), F.lit("Deposit").alias("type"), _properties(name=F.col("deposit_name")).alias("properties")),
        s.select(sample.alias("id"), F.lit("Sample").alias("type"), _properties(name=F.col("sample_name")).alias("properties")),
        s.where("mineral IS NOT NULL").select(nid("mineral", F.col("mineral")).alias("id"), F.lit("Mineral").alias("type"), _properties(name=F.col("mineral")).alias("properties")),
        m.select(measure.alias("id"), F.lit("Measurement").alias("type"), value.alias("properties")),
    ]
    none = F.create_map().cast("map<string,string>").alias("properties")
    edges = [
        s.where("deposit_name IS NOT NULL").select(nid("paper", F.col("doc_id")).alias("src"), nid("deposit", F.col("deposit_name")).alias("dst"), F.lit("DESCRIBES").alias("type"), none),
        s.select(nid("paper", F.col("doc_id")).alias("src"), sample.alias("dst"), F.lit("HAS_SAMPLE").alias("type"), none),
        s.where("mineral IS NOT NULL").select(sample.alias("src"), nid("mineral", F.col("mineral")).alias("dst"), F.lit("OF_MINERAL").alias("type"), none),
        m.select(sample.alias("src"), measure.alias("dst"), F.lit("HAS_MEASUREMENT").alias("type"), none),
    ]
    union = lambda fs: fs[0] if len(fs) == 1 else fs[0].unionByName(union(fs[1:]))
    return merge_nodes(union(nodes)), union(edges).dropDuplicates(["src", "dst", "type"])


def entity_graph(documents: DataFrame, doc: str, samples: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extracted entities: ``samples`` is array<struct<name, mineral, method>> of each document.

    A paper reports its samples, a sample contains a mineral and was analysed by a method. Entities without a name make no node, and
    an edge whose end is none falls away with it. Null documents and empty lists give nothing.
    """
    s = documents.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.explode(samples).alias("s")).where("s.name IS NOT NULL").select("doc", "s.*")
    paper, sample = F.concat_ws("/", F.lit("paper"), "doc"), F.concat_ws("/", F.lit("sample"), "doc", "name")
    none = F.create_map().cast("map<string,string>").alias("properties")
    kinds = {"mineral": ("Mineral", "CONTAINS_MINERAL"), "method": ("Method", "ANALYSED_BY")}
    nodes = s.select(paper.alias("id"), F.lit("Paper").alias("type"), _properties(name=F.col("doc")).alias("properties")).unionByName(s.select(sample.alias("id"), F.lit("Sample").alias("type"), _properties(name=F.col("name")).alias("properties")))
    edges = s.select(paper.alias("src"), sample.alias("dst"), F.lit("REPORTS").alias("type"), none)
    for column, (kind, link) in kinds.items():
        named, node = s.where(F.col(column).isNotNull()), F.concat(F.lit(f"{column}:"), F.col(column))
        nodes = nodes.unionByName(named.select(node.alias("id"), F.lit(kind).alias("type"), _properties(name=F.col(column)).alias("properties")))
        edges = edges.unionByName(named.select(sample.alias("src"), node.alias("dst"), F.lit(link).alias("type"), none))
    return merge_nodes(nodes), edges.dropDuplicates(["src", "dst", "type"])


def get_nodes(nodes: DataFrame, wanted: DataFrame, ident: str = "id") -> DataFrame:
    """The nodes of the wanted ids; ids without a node give nothing."""
    return nodes.join(wanted.select(F.col(ident).alias("id")).distinct(), "id", "left_semi")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, type, n)`` counts by type, with a total row (type null) each."""
    a = nodes.rollup("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    b = edges.rollup("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "type", "n")
    return a.unionByName(b)


def flat_rows(nodes: DataFrame, edges: DataFrame, elements: list[str]) -> DataFrame:
    """Graph back to one row a sample with a column an element."""
    m = edges.where("type = 'HAS_MEASUREMENT'").join(nodes.select(F.col("id").alias("dst"), "properties"), "dst").drop("type")
    tidy = m.select("src", F.element_at(F.split("dst", "/"), -1).alias("el"), F.try_element_at("properties", F.lit("value")).cast("double").alias("v"))
    return tidy.groupBy("src").pivot("el", elements).agg(F.max("v")).withColumnRenamed("src", "sample")


def extraction_graph(rows: DataFrame, elements: list[str], optional: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph of an extraction table: papers, deposits, types, samples, analyses, minerals, methods, measurements and elements.

    A sample is what its spots' names share ('@' and '-spot' set aside); an analysis is one row by sample name and analysis id, so two
    methods on one sample stay two. ``optional`` names columns for laboratories and instruments ('laboratory', 'instrument'), which
    an analysis was performed at or used. Rows need a document, a sample name and an analysis id; other nulls make no node.
    """
    base = F.substring_index(F.substring_index("sample_name", "@", 1), "-spot", 1)
    node = lambda kind, c: F.concat(F.lit(kind + ":"), c.cast("string"))
    col = F.col
    paper, deposit, sample = node("paper", col("doc_id")), node("deposit", col("deposit_name")), node("sample", col("_base"))
    analysis = F.concat_ws(":", F.lit("analysis"), "sample_name", "analysis_id")
    s = rows.where("doc_id IS NOT NULL AND sample_name IS NOT NULL AND analysis_id IS NOT NULL").withColumn("_base", base)
    m = s.select("*", F.explode(F.array(*[F.struct(F.lit(e).alias("el"), F.col(f"{e}_ppm").alias("v")) for e in elements])).alias("m")).where("m.v IS NOT NULL")
    measured = F.concat_ws(":", F.lit("measurement"), "sample_name", "analysis_id", "m.el")
    value = _properties(value=F.when(col("m.v") >= 0, col("m.v")), is_bdl=col("m.v") < 0, element=col("m.el"))
    named = lambda c: _properties(name=col(c))
    entities = [(s, paper, "paper", _properties(year=col("publication_date")), "doc_id"), (s, deposit, "deposit", _properties(name=col("deposit_name"), type_original=col("deposit_type_original")), "deposit_name"), (s, sample, "sample", named("_base"), "_base"),
                (s, analysis, "analysis", named("sample_name"), "analysis_id"), (s, node("mineral", F.lower("mineral")), "mineral", _properties(name=F.lower("mineral")), "mineral"), (s, node("method", col("analytical_method")), "method", named("analytical_method"), "analytical_method"),
                (s, node("type", col("deposit_type_original")), "type", named("deposit_type_original"), "deposit_type_original"), (m, measured, "measurement", value, "m.el"), (m, node("element", col("m.el")), "element", _properties(symbol=col("m.el")), "m.el")]
    links = [(s, paper, deposit, "contains", "deposit_name"), (s, F.coalesce(deposit, paper), sample, "contains", "_base"), (s, sample, analysis, "analyzed_by", "analysis_id"), (s, analysis, node("mineral", F.lower("mineral")), "target_mineral", "mineral"),
             (s, analysis, node("method", col("analytical_method")), "used_method", "analytical_method"), (s, deposit, node("type", col("deposit_type_original")), "classified_as", "deposit_type_original"), (m, analysis, measured, "measured", "m.el"), (m, measured, node("element", col("m.el")), "part_of", "m.el")]
    for kind, link in (("laboratory", "performed_at"), ("instrument", "used_instrument")):
        if optional and kind in optional:
            entities.append((s, node(kind, col(optional[kind])), kind, named(optional[kind]), optional[kind]))
            links.append((s, analysis, node(kind, col(optional[kind])), link, optional[kind]))
    union = lambda fs: fs[0] if len(fs) == 1 else fs[0].unionByName(union(fs[1:]))
    nodes = union([df.where(col(need).isNotNull()).select(i.alias("id"), F.lit(kind).alias("type"), p.alias("properties")) for df, i, kind, p, need in entities])
    none = F.create_map().cast("map<string,string>").alias("properties")
    edges = union([df.where(col(need).isNotNull() & a.isNotNull() & b.isNotNull()).select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), none) for df, a, b, kind, need in links])
    return merge_nodes(nodes), edges.dropDuplicates(["src", "dst", "type"])


def analysis_rows(nodes: DataFrame, edges: DataFrame, elements: list[str]) -> DataFrame:
    """``(analysis, one column an element)``: the graph's measurements back as rows; below detection is null, an analysis whose values all are keeps its row."""
    m = edges.where("type = 'measured'").select("src", "dst").join(nodes.where("type = 'measurement'").select(F.col("id").alias("dst"), "properties"), "dst")
    p = lambda k: F.try_element_at("properties", F.lit(k))
    return m.groupBy(F.col("src").alias("analysis")).agg(*[F.min(F.when(p("element") == e, p("value").cast("double"))).alias(e) for e in elements])
