"""Deposit taxonomy: hierarchy listings, keyword scores, picklist validation, crosswalks by model number."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import broadcast_if_small


def hierarchy(types: DataFrame, levels: list[str], leaf: str) -> DataFrame:
    """Each group of the levels with its count and sorted leaves."""
    return types.groupBy(*levels).agg(F.count(F.lit(1)).alias("n_types"), F.array_join(F.array_sort(F.collect_set(leaf)), "; ").alias("types"))


#: What the name, the group, the environment and the words of a type's name add to its score, and what a commodity
#: in the type's name and a word of it in the deposit's name do.
NAME_SCORE, GROUP_SCORE, ENVIRONMENT_SCORE, WORDS_SCORE, WORDS_MOST, WORDS_LEAST = 0.4, 0.2, 0.1, 0.3, 0.2, 0.05
GOODS_SCORE, DEPOSIT_SCORE = 0.1, 0.1


class TypeScorer:
    """Keyword scores of all types for a text: every term of the list is looked for in one pass over the text.

    .4 for the type's name in the text, .2 for its group, .1 for its environment, up to .2 for its name's words; capped at 1.
    """

    def __init__(self, types: list[tuple[str, str, str, str]]):
        self.ids = np.array([t[0] for t in types])
        terms: dict[str, int] = {}
        index = lambda t: terms.setdefault(t.lower(), len(terms))
        self.name, self.group, self.environment = (np.array([index(t[k] or "\x00") for t in types], dtype=int) for k in (1, 2, 3))
        words = [[index(w) for w in re.split(r"[^a-z]+", (t[1] or "").lower()) if len(w) > 3] for t in types]
        self.counts = np.maximum(1, np.array([len(w) for w in words]))
        self.names = [(t[1] or "").lower() for t in types]
        self.name_words = [[w for w in n.split() if len(w) > 3] for n in self.names]
        self.terms = list(terms)
        self.weights = np.zeros((len(terms), len(types)))
        for j, ws in enumerate(words):
            for w in ws:
                self.weights[w, j] += 1
        try:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for t, i in terms.items():
                self.automaton.add_word(t, i)
            self.automaton.make_automaton()
        except ImportError:
            self.automaton = None

    def found(self, text: str) -> np.ndarray:
        hit = np.zeros(len(self.terms))
        low = text.lower()
        at = [i for _, i in self.automaton.iter(low)] if self.automaton else [i for i, t in enumerate(self.terms) if t in low]
        hit[at] = 1
        return hit

    def extra(self, deposit: str | None, goods: list[str] | None) -> np.ndarray:
        """What the deposit's name and its commodities add."""
        named, listed = (deposit or "").lower(), [g.lower() for g in goods or () if g]
        by_name = np.array([any(w in named for w in ws) for ws in self.name_words]) if named else np.zeros(len(self.names), bool)
        by_goods = np.array([any(g in n for g in listed) for n in self.names]) if listed else np.zeros(len(self.names), bool)
        return DEPOSIT_SCORE * by_name + GOODS_SCORE * by_goods

    def scores(self, text: str, more: np.ndarray | float = 0.0) -> np.ndarray:
        hit = self.found(text)
        words = np.minimum(WORDS_MOST, hit @ self.weights / self.counts * WORDS_SCORE)
        raw = NAME_SCORE * hit[self.name] + GROUP_SCORE * hit[self.group] + ENVIRONMENT_SCORE * hit[self.environment] + np.where(words > WORDS_LEAST, words, 0.0) + more
        return np.floor(np.minimum(1.0, raw) * 1000 + 0.5 + 1e-9) / 1000


def score_types(
    docs: DataFrame, types: DataFrame, doc: str, text: str, top: int = 10, least: float = 0.05, max_types: int = 5000, deposit: str | None = None, goods: str | None = None
) -> DataFrame:
    """``(doc, rank, type_id, score)``: the best-scoring types of each document, ties by id. The type list is a bounded dimension.

    ``deposit`` (a name) and ``goods`` (an array of commodities) are columns that add to the score where given. Null texts give no row.
    """
    listed = [tuple(r) for r in types.where("type_id IS NOT NULL").select("type_id", "deposit_type", "deposit_group", "deposit_environment").orderBy("type_id").limit(max_types + 1).collect()]
    if len(listed) > max_types:
        raise ValueError(f"more than {max_types} types")
    kind = dict(docs.dtypes)[doc]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = TypeScorer(listed)
        for b in batches:
            at, ranks, ids, values = [], [], [], []
            named = b.column("n").to_pylist() if deposit else None
            listed_goods = b.column("g").to_pylist() if goods else None
            for i, t in enumerate(b.column("t").to_pylist()):
                more = scorer.extra(named[i] if named else None, listed_goods[i] if listed_goods else None) if deposit or goods else 0.0
                s = scorer.scores(t, more)
                order = [j for j in np.argsort(-s, kind="stable")[:top] if s[j] > least]
                at += [i] * len(order)
                ranks += range(1, len(order) + 1)
                ids += scorer.ids[order].tolist()
                values += s[order].tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("d").take(pa.array(at, pa.int64())), pa.array(ranks, pa.int32()), pa.array(ids, pa.string()), pa.array(values, pa.float64())],
                names=["d", "rank", "type_id", "score"],
            )

    source = docs.where(F.col(text).isNotNull()).select(
        F.col(doc).alias("d"), F.col(text).alias("t"), *([F.col(deposit).alias("n")] if deposit else []), *([F.col(goods).alias("g")] if goods else [])
    )
    return source.mapInArrow(run, f"d {kind}, rank int, type_id string, score double").withColumnRenamed("d", doc)


def validate(values: DataFrame, picklist: DataFrame, value: str, entry: str, max_rows: int = 10_000) -> DataFrame:
    """``(value, valid, suggestion)``: exact but for case, else the entry with the best containment ratio above one half."""
    if picklist.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} entries")
    listed = picklist.where(F.col(entry).isNotNull()).agg(F.array_sort(F.collect_set(entry)).alias("all"))
    v = values.select(F.col(value).alias("value")).where("value IS NOT NULL").distinct()
    low = F.lower("value")

    def ratio(e: Column) -> Column:
        a, b = F.length(low), F.length(e)
        inside = F.contains(F.lower(e), low) | F.contains(low, F.lower(e))
        return F.when(inside, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)

    j = v.join(F.broadcast(listed))
    exact = F.exists("all", lambda e: F.lower(e) == low)
    best = F.array_min(F.transform("all", lambda e: F.struct((-ratio(e)).alias("r"), e.alias("e"))))
    return j.select("value", exact.alias("valid"), F.when(exact, None).when(best["r"] < -0.5, best["e"]).alias("suggestion"))


def model_numbers(text: Column) -> Column:
    """Model numbers such as 52f in a text, lower case, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b([0-9]{1,2}[a-z])\b"), 1), lambda x: x))


def crosswalk(records: DataFrame, types: DataFrame, record: str, text: str) -> DataFrame:
    """``(record, type_ids)``: types whose model number the record's text names; records without any have an empty list."""
    named = records.select(record, F.explode_outer(model_numbers(F.col(text))).alias("_n"))
    t = types.where("usgs_num IS NOT NULL").select(F.lower("usgs_num").alias("_n"), "type_id")
    return named.join(broadcast_if_small(t, 50_000), "_n", "left").groupBy(record).agg(F.array_sort(F.collect_set("type_id")).alias("type_ids"))


def with_levels(records: DataFrame, types: DataFrame, key: str, levels: list[str], max_types: int = 50_000) -> DataFrame:
    """``records`` with the taxonomy's levels by type id, any case; empty texts where the id is null or unknown. Of repeated ids the smallest values count."""
    t = types.where(F.col(key).isNotNull()).groupBy(F.lower(key).alias("_k")).agg(F.min(F.struct(*levels)).alias("_v"))
    joined = records.join(broadcast_if_small(t, max_types), F.lower(key) == F.col("_k"), "left")
    return joined.select(*[F.col(c) for c in records.columns], *[F.coalesce(F.col(f"_v.{c}"), F.lit("")).alias(c) for c in levels])
