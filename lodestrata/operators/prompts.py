"""Texts for models from tables, what their answers are held to, and the loop that tries hints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.elements import header_symbol
from lodestrata.operators.enrichment import word_lookup
from lodestrata.operators.quality import base_sample_id
from lodestrata.operators.shaping import explode_list


def listing(df: DataFrame, levels: list[str], leaf: str, title: str) -> DataFrame:
    """``(level_1, text)``: each value of the first level as a text, its groups and their sorted distinct leaves indented below it."""
    top, group = levels
    groups = df.where(F.col(leaf).isNotNull()).groupBy(top, group).agg(F.array_sort(F.collect_set(leaf)).alias("_l"))
    block = F.concat(F.lit("  "), F.coalesce(group, F.lit("")), F.lit(":\n    - "), F.array_join("_l", "\n    - "))
    lists = groups.groupBy(top).agg(F.array_sort(F.collect_list(F.struct(F.coalesce(group, F.lit("")).alias("g"), block.alias("b")))).alias("_g"), F.sum(F.size("_l")).alias("_n"))
    text = F.concat(F.lit(f"{title} "), F.coalesce(top, F.lit("")), F.lit(" ("), F.col("_n").cast("string"), F.lit("):\n"), F.array_join(F.transform("_g", lambda x: x["b"]), "\n"))
    return lists.select(top, text.alias("text"))


def filled(template: str, **values: Column) -> Column:
    """A template with {name} places, filled with columns; nulls become empty."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def known_symbols(answers: DataFrame, keep: list[str], symbols: Column) -> DataFrame:
    """``(keep, symbols)``: of the elements an answer names only those that are, as symbols, each once, in order."""
    mapped = F.array_compact(F.transform(symbols, header_symbol))
    return answers.select(*keep, F.array_sort(F.array_distinct(F.coalesce(mapped, F.array().cast("array<string>")))).alias("symbols"))


def tidy_rows(rows: DataFrame, minerals: str, text: str, local_id: str, words: list[tuple[str, str]], abbreviations: list[tuple[str, str]]) -> DataFrame:
    """Extracted rows put in order: one row a listed mineral, a missing mineral read from the ``text``, the sample an id belongs to."""
    out = explode_list(rows, minerals, "_m")
    read = F.coalesce("_m", word_lookup(F.col(text), words, abbreviations))
    return out.withColumn("mineral_read", read).withColumn("base_sample", base_sample_id(F.col(local_id))).drop("_m")


def best_by_quality(extract: Callable[[dict], DataFrame], hints: list[dict], quality: Callable[[DataFrame], float], enough: float = 1.0) -> tuple[dict, float, DataFrame]:
    """Tries the hints in order and keeps the extraction of best quality (the earlier on ties), stopping once it is good ``enough``.

    The list is the bound of the loop; each trial is a plan over all sources. A hint whose extraction fails counts for nothing.
    """
    best: tuple[dict, float, DataFrame] | None = None
    errors = []
    for h in hints:
        try:
            df = extract(h)
            q = quality(df)
        except Exception as e:  # a bad hint must not end the search
            errors.append(f"{h}: {e}")
            continue
        if best is None or q > best[1]:
            best = (h, q, df)
        if best[1] >= enough:
            break
    if best is None:
        raise ValueError("no hint gave an extraction: " + "; ".join(errors))
    return best
