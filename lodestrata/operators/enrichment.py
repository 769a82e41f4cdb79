"""Metadata and lookups around the measurements: overrides, aliases, candidates as text, source tags, verification, budgets."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Audit keys dropped from records, and the parts of the quick quality score.
AUDIT_KEYS = ["changed_by", "change_date", "changed_date", "inserted_by", "insert_date"]


def override_metadata(rows: DataFrame, meta: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Document fields on every row; a row's own value wins where it has one. Documents without metadata keep their rows."""
    m = meta.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_m_{f}") for f in fields])
    own = {c for c in rows.columns}
    joined = rows.join(m, F.col(key) == F.col("_k"), "left")
    kept = [c for c in rows.columns if c not in fields]
    return joined.select(*kept, *[(F.coalesce(F.col(f), F.col(f"_m_{f}")) if f in own else F.col(f"_m_{f}")).alias(f) for f in fields])


def rename_keys(properties: Column, aliases: dict[str, str], known: list[str]) -> Column:
    """Map keys lower-cased, aliases resolved, unknown keys dropped; of two keys that become one the first in order stays."""
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    entries = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.struct(F.coalesce(F.try_element_at(names, F.lower(e["key"])), F.lower(e["key"])).alias("key"), e["value"].alias("value")))
    wanted = F.filter(entries, lambda e: e["key"].isin(*known))
    keys = F.transform(wanted, lambda e: e["key"])
    return F.map_from_entries(F.filter(wanted, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def candidates_text(candidates: Column, name: str = "observed_name", score: str = "confidence") -> Column:
    """'A (0.25) | B (0.10)' of a candidate list, best first, nameless ones left out; null for none."""
    named = F.filter(candidates, lambda c: c[name].isNotNull())
    order = F.array_sort(F.transform(named, lambda c: F.struct((-F.coalesce(c[score], F.lit(0.0))).alias("s"), c[name].alias("n"))))
    t = F.array_join(F.transform(order, lambda c: F.format_string("%s (%.2f)", c["n"], F.round(-c["s"], 2))), " | ")
    return F.nullif(t, F.lit(""))


def parse_candidates(text: Column) -> Column:
    """The list that ``candidates_text`` wrote: array<struct<name, score>>; a part without a score has a null one."""
    parts = F.filter(F.transform(F.split(text, r" \| "), lambda p: F.trim(p)), lambda p: p != "")
    score = lambda p: F.nullif(F.regexp_extract(p, r"\(([0-9.]+)\)$", 1), F.lit("")).try_cast("double")
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_replace(p, r"\s*\([0-9.]+\)$", "")).alias("name"), score(p).alias("score")))


def source_tag(*texts: Column) -> Column:
    """'this_study', or 'cited_study:…' after the last text that names a source or cites one, cut at 50 characters."""
    out = F.lit("this_study")
    for t in texts:
        cited = t.rlike(r"(?i)source:|et al\.?,?\s+\(?[0-9]{4}")
        out = F.when(cited, F.concat(F.lit("cited_study:"), F.substring(F.trim(t), 1, 50))).otherwise(out)
    return out


def word_lookup(text: Column, words: list[tuple[str, str]], abbreviations: list[tuple[str, str]]) -> Column:
    """The value of the longest listed word that stands whole in a text, else of the first token that is an abbreviation."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    short = F.create_map(*[F.lit(x) for a, v in abbreviations for x in (a.lower(), v)])
    tokens = F.filter(F.split(low, r"[^a-z0-9]+"), lambda t: F.try_element_at(short, t).isNotNull())
    for w, v in sorted(reversed(words), key=lambda x: len(x[0])):  # the first listed wins among equally long ones
        out = F.when(low.rlike(rf"\b{w.lower()}\b"), v).otherwise(out)
    return F.coalesce(out, F.try_element_at(short, F.try_element_at(tokens, F.lit(1))))


def printed_forms(value: Column) -> Column:
    """The ways a number may be printed: with the decimals it has, six at most, as a whole number, with one and with two decimals."""
    return F.array(F.regexp_replace(F.format_string("%.6f", value), r"[.]?0+$", ""), F.round(value).cast("bigint").cast("string"), F.format_string("%.1f", value), F.format_string("%.2f", value))


def verify_values(rows: DataFrame, texts: DataFrame, doc: str, row: str, value: str, text: str, sample: int = 10) -> DataFrame:
    """Of each document's values the ``sample`` first in hash order are looked for in its text: ``(doc, checked, found, verdict)``.

    The sample is the feature: verdict 'verified' from 70 % found, 'suspicious' below 40 %, else 'partial'.
    """
    w = Window.partitionBy(doc).orderBy(F.md5(F.col(row).cast("string")), row, value)
    picked = rows.where(F.col(value) >= 0).select(doc, row, value).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sample)
    hit = F.exists(printed_forms(F.col(value)), lambda p: F.contains(F.coalesce(F.col(text), F.lit("")), p))
    per = picked.join(texts.select(doc, text), doc, "left").groupBy(doc).agg(F.count(F.lit(1)).alias("checked"), F.count_if(hit).alias("found"))
    share = F.col("found") / F.col("checked")
    return per.withColumn("verdict", F.when(share >= 0.7, "verified").when(share < 0.4, "suspicious").otherwise("partial"))


def page_budget(pages: DataFrame, doc: str, page: str, score: str, must: str, expected: str) -> DataFrame:
    """Pages worth rendering: those that must be, then the best scored, up to 8, 10, 12 or 15 by how many samples are expected."""
    budget = F.when(F.col(expected) > 200, 15).when(F.col(expected) > 100, 12).when(F.col(expected) > 50, 10).otherwise(8)

    def ranked(df: DataFrame, by: list[str], most: Column) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc(must), F.desc_nulls_last(score), page)
        return df.withColumn("_n", F.row_number().over(w)).where(F.col(must) | ((F.col("_n") <= most) & F.col(score).isNotNull())).drop("_n")

    # what isn't among the best of its share of the document isn't among the document's: a hot one is thinned out in many tasks
    few = ranked(pages.withColumn("_s", F.pmod(F.xxhash64(page), F.lit(32))), [doc, "_s"], budget).drop("_s")
    return ranked(few, [doc], budget)


def metadata_scores(pred: DataFrame, truth: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Tier 1: first row of each side by document, mean over the fields with a truth of exact agreement after folding, else word overlap."""
    def first(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(key).agg(F.min(F.struct(order, *fields)).alias(tag))

    def fold(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))

    j = first(truth, "t").join(first(pred, "p"), key, "left")
    scores = []
    for f in fields:
        t, p = fold(F.col(f"t.{f}")), fold(F.coalesce(F.col(f"p.{f}"), F.lit("")))
        a, b = F.split(t, " "), F.split(p, " ")
        overlap = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
        scores.append(F.when(F.col(f"t.{f}").isNotNull(), F.when(t == p, 1.0).when(p == "", 0.0).otherwise(overlap)))
    listed = F.array_compact(F.array(*scores))
    return j.select(key, F.when(F.size(listed) > 0, F.aggregate(listed, F.lit(0.0), lambda x, y: x + y) / F.size(listed)).otherwise(0.0).alias("t1"), F.size(listed).alias("fields"))


def quick_quality(rows: DataFrame, keys: list[str], sample: str, elements: list[str], least_rows: int = 5, least_elements: int = 3) -> DataFrame:
    """40 for enough rows, 30 (or 15) for enough elements, 20 for sample ids, 10 for no column of one value only."""
    n = F.count(F.lit(1))
    filled = sum((F.count(e) > 0).cast("int") for e in elements)
    uniform = sum(((F.count_distinct(e) == 1) & (F.count(e) > 1)).cast("int") for e in elements)
    agg = rows.groupBy(*keys).agg(n.alias("rows"), filled.alias("elements"), uniform.alias("uniform"), (F.count(sample) / n).alias("named"))
    score = (
        F.when(F.col("rows") >= least_rows, 40).otherwise(0) + F.when(F.col("elements") >= least_elements, 30).when(F.col("elements") > 0, 15).otherwise(0)
        + F.when(F.col("named") >= 0.5, 20).otherwise(0) + F.when(F.col("uniform") == 0, 10).otherwise(0)
    )
    return agg.select(*keys, "rows", "elements", score.alias("score"))


def rule_match(records: DataFrame, rules: DataFrame, dataset: str, name: str) -> DataFrame:
    """Records with the labels of the rules for their dataset: a rule names one record or, with a null name, all of them."""
    r = rules.select(F.col(dataset).alias("_d"), F.col(name).alias("_n"), "label")
    exact = records.join(r.where("_n IS NOT NULL"), (F.col(dataset) == F.col("_d")) & (F.col(name) == F.col("_n")), "inner")
    wide = records.join(r.where("_n IS NULL"), F.col(dataset) == F.col("_d"), "inner")
    return exact.unionByName(wide).drop("_d", "_n")


def without_keys(record: Column, keys: list[str] | None = None) -> Column:
    """A JSON text without the given keys at any depth, objects in lists included; null for null and for texts that don't parse."""
    dropped = frozenset(keys or AUDIT_KEYS)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def cut(v):
            if isinstance(v, dict):
                return {k: cut(x) for k, x in v.items() if k not in dropped}
            return [cut(x) for x in v] if isinstance(v, list) else v

        def one(t):
            try:
                return json.dumps(cut(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except (TypeError, ValueError):
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return run(record)
