"""Nested and text exports: site documents, linked data, triples, graph files, tables as text, rolled-over parts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators.rollup import site_statistics
from lodestrata.operators.shaping import unpivot_cells


def site_documents(sheet: DataFrame, sites: DataFrame, elements: list[str]) -> DataFrame:
    """One nested document a site record with its type candidates and, by deposit name, the statistics of its measurements.

    Statistics meet sites by name in an equi-join after both are reduced; sites without a name or measurements keep an empty list.
    """
    cells = unpivot_cells(sheet.select("deposit_name", *[F.col(f"{e}_ppm").alias(e) for e in elements]), ["deposit_name"], elements)
    stats = site_statistics(cells, ["deposit_name", "element"], "value").groupBy(F.lower("deposit_name").alias("_k")).agg(
        F.array_sort(F.collect_list(F.struct("element", "n_analyses", "n_bdl", "median_ppm", "min_ppm", "max_ppm"))).alias("geochemical_measurements")
    )
    s = sites.withColumn("_k", F.lower("name"))
    none = F.array().cast(stats.schema["geochemical_measurements"].dataType)
    return s.join(stats, "_k", "left").select(
        "record_id", "source_id", "name", "country",
        F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct(F.format_string("POINT(%s %s)", F.col("longitude").cast("string"), F.col("latitude").cast("string")).alias("location"), F.lit("EPSG:4326").alias("crs"))).alias("location_info"),
        "deposit_type_candidate",
        F.transform(F.coalesce("commodities", F.array().cast("array<string>")), lambda c: F.struct(c.alias("commodity"))).alias("mineral_inventory"),
        F.coalesce("geochemical_measurements", none).alias("geochemical_measurements"),
    )


def type_candidates(labels: Column, source: str) -> Column:
    """Labels as candidates that share confidence 1 evenly."""
    n = F.size(labels)
    return F.transform(labels, lambda x: F.struct(x.alias("observed_name"), F.round(F.lit(1.0) / n, 4).alias("confidence"), F.lit(source).alias("source")))


def linked_data(documents: DataFrame, base: str) -> DataFrame:
    """Documents with @id and @type, one JSON text a row; the @context belongs to the file that wraps them."""
    ident = F.concat(F.lit(base), safe_id(F.col("record_id")))
    return documents.select(F.to_json(F.struct(ident.alias("@id"), F.lit("MineralSite").alias("@type"), *documents.columns)).alias("value"))


def safe_id(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[^A-Za-z0-9_.-]+", "_")


def literal(text: Column) -> Column:
    """A quoted literal with backslashes, quotes and line breaks escaped."""
    t = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'))


def triples(documents: DataFrame, prefix: str = "site") -> DataFrame:
    """One valid Turtle statement a row; candidates are statements of their own subjects, so rows may come in any order."""
    s = F.concat(F.lit(f"{prefix}:"), safe_id(F.col("record_id")))
    one = documents.select(F.explode(F.array_compact(F.array(
        F.concat(s, F.lit(" a :MineralSite .")),
        F.when(F.col("name").isNotNull(), F.concat(s, F.lit(" :name "), literal(F.col("name")), F.lit(" ."))),
        F.when(F.col("location_info").isNotNull(), F.concat(s, F.lit(" :location "), literal(F.col("location_info.location")), F.lit(" ."))),
    ))).alias("value"))
    c = documents.select(s.alias("s"), F.posexplode("deposit_type_candidate").alias("i", "c")).where("c IS NOT NULL")
    node = F.concat(F.col("s"), F.lit("_t"), F.col("i").cast("string"))
    two = c.select(F.explode(F.array_compact(F.array(
        F.concat(F.col("s"), F.lit(" :candidate "), node, F.lit(" .")),
        F.when(F.col("c.observed_name").isNotNull(), F.concat(node, F.lit(" :observedName "), literal(F.col("c.observed_name")), F.lit(" ."))),
        F.when(F.col("c.confidence").isNotNull(), F.concat(node, F.lit(" :confidence "), F.col("c.confidence").cast("string"), F.lit(" ."))),
    ))).alias("value"))
    return one.unionByName(two)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge elements of GraphML, one a row."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(F.lit('<data key="'), esc(e["key"]), F.lit('">'), esc(e["value"]), F.lit("</data>"))), "")
    n = nodes.select(F.concat(F.lit('<node id="'), esc(F.col("id")), F.lit('"><data key="type">'), esc(F.col("type")), F.lit("</data>"), data, F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('"><data key="type">'), esc(F.col("type")), F.lit("</data></edge>")).alias("value"))
    return n.unionByName(e)


def node_table(nodes: DataFrame, keys: list[str] | None = None, max_keys: int = 2000) -> DataFrame:
    """Nodes with one column a property key, the sorted union of all keys unless given (keys of a graph are few by nature)."""
    if keys is None:
        keys = [r[0] for r in nodes.select(F.explode(F.map_keys("properties")).alias("k")).distinct().orderBy("k").limit(max_keys + 1).collect()]
        if len(keys) > max_keys:
            raise ValueError(f"more than {max_keys} property keys")
    return nodes.select("id", "type", *[F.try_element_at("properties", F.lit(k)).alias(k) for k in keys])


def text_table(rows: DataFrame, keys: list[str], order: str, columns: list[str], limit: int = 25, budget: int = 5000) -> DataFrame:
    """The first rows of each key as one pipe-separated text with a trailer that counts the rest, cut at the budget."""
    w = Window.partitionBy(*keys).orderBy(order)
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    head = rows.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") <= limit)
    lists = head.groupBy(*keys, "_all").agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("t")))).alias("l"))
    body = F.concat_ws("\n", F.lit(" | ".join(columns)), F.array_join(F.transform("l", lambda x: x["t"]), "\n"))
    more = F.when(F.col("_all") > limit, F.concat(F.lit("\n... "), (F.col("_all") - limit).cast("string"), F.lit(" more rows"))).otherwise("")
    return lists.select(*keys, F.substring(F.concat(body, more), 1, budget).alias("text"))


def write_rolled(df: DataFrame, path: str, per_file: int = 5000, fmt: str = "json") -> None:
    """Parts of at most ``per_file`` records."""
    df.write.option("maxRecordsPerFile", per_file).mode("overwrite").format(fmt).save(path)


def write_splits(df: DataFrame, split: str, path: str) -> None:
    df.write.partitionBy(split).mode("overwrite").parquet(path)


def linked_samples(rows: DataFrame, elements: list[str], base: str, keys: list[str]) -> DataFrame:
    """One JSON-LD text a sample: its fields, and its measurements as nested objects, those below detection marked.

    Rows of one sample (equal ``keys``) become one object, measurements in order of element and value; null elements are left out.
    """
    cells = F.array(*[F.struct(F.lit(e).alias("element"), F.col(f"{e}_ppm").alias("v")) for e in elements])
    m = rows.select(*keys, F.explode(cells).alias("m")).where("m.v IS NOT NULL")
    one = F.struct(F.lit("Measurement").alias("@type"), F.col("m.element").alias("element"), F.when(F.col("m.v") >= 0, F.round("m.v", 4)).alias("ppm"), (F.col("m.v") < 0).alias("below_detection"))
    lists = m.groupBy(*keys).agg(F.array_sort(F.collect_set(one)).alias("measurements"))
    ident = F.concat(F.lit(base), F.concat_ws("/", *[safe_id(F.col(k)) for k in keys]))
    return lists.select(*keys, F.to_json(F.struct(ident.alias("@id"), F.lit("Sample").alias("@type"), *keys, "measurements")).alias("value"))


def with_context(objects: DataFrame, context: dict[str, str]) -> DataFrame:
    """JSON-LD texts with an ``@context``, so that each line is a document of its own and files of any size can be written in parallel."""
    head = json.dumps({"@context": context})[:-1] + ", "
    return objects.withColumn("value", F.concat(F.lit(head), F.substring("value", 2, 1 << 30)))


def annotation_documents(regions: DataFrame, doc: str, image: str, box: list[str], label: str) -> DataFrame:
    """One annotation document a document: its images and, numbered within it, their labelled boxes with area; null labels are left out."""
    item = F.struct(F.col(image).alias("image"), F.col(label).alias("label"), F.array(*box).alias("bbox"), (F.col(box[2]) * F.col(box[3])).alias("area"))
    lists = regions.where(F.col(label).isNotNull()).groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("l"))
    numbered = F.transform("l", lambda x, i: F.struct((i + 1).alias("id"), x["image"].alias("image"), x["label"].alias("label"), x["bbox"].alias("bbox"), x["area"].alias("area")))
    return lists.select(doc, F.to_json(F.struct(F.array_sort(F.array_distinct(F.transform("l", lambda x: x["image"]))).alias("images"), numbered.alias("annotations"))).alias("value"))


def write_sheet(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A wide table as CSV with a header, or as JSON or Parquet; one file a partition."""
    w = df.write.mode("overwrite")
    w.option("header", True).option("emptyValue", "").csv(path) if fmt == "csv" else w.format(fmt).save(path)


def schema_columns(df: DataFrame, schema: dict[str, str], renamed: dict[str, str] | None = None) -> DataFrame:
    """``df`` brought to the columns of ``schema`` (name -> type) in that order: ``renamed`` ones under their new name, missing ones null, others gone."""
    have = {(renamed or {}).get(c, c): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def write_report(tables: dict[str, DataFrame], path: str) -> list[str]:
    """The tables of a report (summary, metadata, elements, samples, …) as folders of JSON lines; those that fail are named, the others written."""
    failed = []
    for name, df in sorted(tables.items()):
        try:
            df.write.mode("overwrite").json(f"{path}/{name}")
        except Exception as e:  # one bad table must not cost the others
            failed.append(f"{name}: {type(e).__name__}")
    return failed


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A catalogue of tables as Parquet folders."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
