"""Pages and files: names, boxes, words grouped into blocks, page tests, table regions met with a truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_stem(path: Column) -> Column:
    """The last part of a path without its ending."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[A-Za-z0-9]+)?$", 1)


def leading_year(path: Column) -> Column:
    """The four digits a file's name opens with, as a year; null for any other name."""
    return F.nullif(F.regexp_extract(path, r"^(?:.*/)?([0-9]{4})", 1), F.lit("")).try_cast("int")


def relative_box(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """``struct<x, y, w, h, area>`` of a box in shares of its page; null for a page without extent."""
    ok = (page_w > 0) & (page_h > 0)
    return F.when(ok, F.struct((x / page_w).alias("x"), (y / page_h).alias("y"), (w / page_w).alias("w"), (h / page_h).alias("h"), (w * h / (page_w * page_h)).alias("area")))


def absolute_box(box: Column, page_w: Column, page_h: Column) -> Column:
    """The inverse of ``relative_box``."""
    return F.struct((box["x"] * page_w).alias("x"), (box["y"] * page_h).alias("y"), (box["w"] * page_w).alias("w"), (box["h"] * page_h).alias("h"))


def is_landscape(page_w: Column, page_h: Column) -> Column:
    return page_w > 1.15 * page_h


def rotated_pages(glyphs: DataFrame, page: list[str], dir_y: str, share: float = 0.5) -> DataFrame:
    """``(page, rotated)``: do more than ``share`` of the page's glyphs run upwards or downwards?"""
    turned = F.avg((F.abs(dir_y) > 0.5).cast("double"))
    return glyphs.groupBy(*page).agg((F.coalesce(turned, F.lit(0.0)) > share).alias("rotated"))


def block_texts(words: DataFrame, keys: list[str], order: str, word: str) -> DataFrame:
    """``(keys, text)``: the words of each block in order, with words that a line end split whole again. Null words are left out."""
    lists = words.where(F.col(word).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, word))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x[word]), " ")
    return lists.select(*keys, F.regexp_replace(text, r"([A-Za-z])- ([a-z])", "$1$2").alias("text"))


def table_sections(docs: DataFrame, doc: str, text: str, before: int = 3, after: int = 1, most: int = 8000) -> DataFrame:
    """``(doc, table_no, text)``: each block of pipe lines with the lines around it, cut at ``most`` characters."""
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    w = Window.partitionBy(doc).orderBy("n")
    pipe = F.trim("line").startswith("|")
    marked = lines.withColumn("_p", pipe).withColumn("_start", F.col("_p") & ~F.coalesce(F.lag("_p").over(w), F.lit(False)))
    islands = marked.withColumn("table_no", F.sum(F.col("_start").cast("int")).over(w)).where("_p").groupBy(doc, "table_no").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    wanted = islands.select(doc, "table_no", F.explode(F.sequence(F.greatest(F.lit(0), F.col("a") - before), F.col("b") + after)).alias("n"))
    rows = wanted.join(lines, [doc, "n"]).groupBy(doc, "table_no").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return rows.select(doc, "table_no", F.substring(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 1, most).alias("text"))


def regions_with_truth(regions: DataFrame, truth: DataFrame, doc: str, element: str, value: str, least_columns: int = 5, least_rows: int = 3) -> DataFrame:
    """Regions of at least so many columns and rows with what the document's truth holds: its measured elements and whether any was
    below detection. Documents without a truth keep an empty list."""
    real = F.col(value) >= 0
    facts = truth.where(F.col(value).isNotNull()).groupBy(doc).agg(F.array_sort(F.collect_set(F.when(real, F.col(element)))).alias("elements"), F.max((~real).cast("int")).alias("_b"))
    large = regions.where((F.col("n_cols") >= least_columns) & (F.col("n_rows") >= least_rows))
    joined = large.join(facts, doc, "left")
    return joined.withColumn("elements", F.coalesce("elements", F.array().cast("array<string>"))).withColumn("any_below", F.coalesce("_b", F.lit(0)) == 1).drop("_b")
