"""Merges and record linkage: coalescing merges, gap fill, richest-copy dedup, name and value linkage, nearest strings."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import broadcast_if_small, checkpointed


def coalesce_merge(df: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One row a key: of each field the first non-null value in ``order`` (source, then position). Null keys merge as one key.

    min over (order, value) of the non-null values combines map-side, so a hot key costs one row a task.
    """
    firsts = [F.min(F.when(F.col(f).isNotNull(), F.struct(*order, F.col(f).alias("_v"))))["_v"].alias(f) for f in fields]
    return df.groupBy(*key).agg(*firsts)


def gap_fill(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full outer merge in which the left value wins and the right fills nulls; rows with a null key never meet and all stay."""
    a = left.select(F.col(key).alias("_a"), *[F.col(f).alias(f"_l_{f}") for f in fields])
    b = right.select(F.col(key).alias("_b"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(
        F.coalesce("_a", "_b").alias(key), *[F.coalesce(f"_l_{f}", f"_r_{f}").alias(f) for f in fields]
    )


def keep_richest(df: DataFrame, key: list[str], richness: Column, order: list[str]) -> DataFrame:
    """Of each key the row with the greatest richness, the earliest on ties; ``position`` is the key's earliest place."""
    rest = [c for c in df.columns if c not in key]
    entry = F.struct((-richness).alias("_n"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_v"))
    out = df.groupBy(*key).agg(F.min(entry).alias("_m"), F.min(order[0]).alias("position"))
    return out.select(*key, *[F.col(f"_m._v.{c}").alias(c) for c in rest], "position")


def normal_name(name: Column) -> Column:
    """Trimmed, dashes without blanks around them, single blanks."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"\s*-\s*", "-"), r"\s+", " ")


def name_prefixes(name: Column) -> Column:
    """The proper prefixes of a name that end before one of - . @ _ blank #."""
    spots = F.filter(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i + 1, F.lit(1)).isin("-", ".", "@", "_", " ", "#"))
    return F.when(F.length(name) > 1, F.transform(spots, lambda i: F.substring(name, F.lit(1), i))).otherwise(F.array())


def name_links(pred: DataFrame, truth: DataFrame, name: str, doc: list[str]) -> DataFrame:
    """``(doc, pred_name, truth_name, stage)``: links by exact name (1), normalised name (2) or prefix at a separator, either way (3).

    All stages are equi-joins on an exploded key; the best stage of a pair is kept. Null names link to nothing.
    """
    def side(df: DataFrame, other: str) -> DataFrame:
        n = df.where(F.col(name).isNotNull()).select(*doc, F.col(name).alias(other)).distinct()
        norm = normal_name(F.col(other))
        own = F.array(F.struct(norm.alias("k"), F.lit(False).alias("cut")))
        cut = F.transform(name_prefixes(norm), lambda p: F.struct(p.alias("k"), F.lit(True).alias("cut")))
        return n.select(*doc, other, F.explode(F.concat(own, cut)).alias("x")).select(*doc, other, F.col("x.k").alias("k"), F.col("x.cut").alias(f"cut_{other}"))

    both = side(pred, "pred_name").join(side(truth, "truth_name").hint("merge"), [*doc, "k"]).where(~(F.col("cut_pred_name") & F.col("cut_truth_name")))
    stage = F.when(F.col("pred_name") == F.col("truth_name"), 1).when(~F.col("cut_pred_name") & ~F.col("cut_truth_name"), 2).otherwise(3)
    return both.groupBy(*doc, "pred_name", "truth_name").agg(F.min(stage).alias("stage"))


def one_to_one(links: DataFrame, doc: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """Greedy one-to-one choice among links in ``order`` (ties by left and right), within each document.

    The link that is first for both its ends is chosen whatever the others are, so all such links are taken at once, those they
    rule out go, and the rest go round again: what is chosen is what a walk through the ordered list would choose, and no
    document is one task. Repeated links count once; null ends are ends like any other.
    """
    rank = F.struct(*order, left, right)
    rest, chosen = checkpointed(links.distinct()), None
    while True:
        ends = {}
        for name in (left, right):
            ends[name] = rest.groupBy(*doc, name).agg(F.min(rank).alias(f"_first_{name}"))
        seen = rest
        for name, first in ends.items():
            keys = [*doc, name]
            other = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], f"_first_{name}")
            on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
            seen = seen.join(other, on).drop(*[f"_k{i}" for i in range(len(keys))])
        took = {name: F.col(f"_first_{name}") == rank for name in (left, right)}
        seen = checkpointed(seen.withColumn("_taken", took[left] & took[right]).drop(f"_first_{left}", f"_first_{right}"))
        won = seen.where("_taken").drop("_taken")
        chosen = won if chosen is None else chosen.unionByName(won)
        rest = seen.where("NOT _taken").drop("_taken")
        for name in (left, right):
            keys = [*doc, name]
            gone = won.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
            rest = rest.join(gone, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_anti")
        rest = checkpointed(rest)
        if rest.isEmpty():
            return chosen


def fingerprint_links(pred: DataFrame, truth: DataFrame, doc: list[str], pred_id: str, truth_id: str, elements: list[str], within: float = 0.1, share: float = 0.3) -> DataFrame:
    """Pairs of rows of one document whose shared positive elements agree within 10 % in at least 30 % of them, with that share.

    Rows meet by an equi-join on (document, element, value bucket); buckets are log-spaced so that near values share one of two.
    """
    import math

    step = math.log(1 + within / (1 - within))

    def spread(df: DataFrame, ident: str, shifted: bool) -> DataFrame:
        tidy = df.select(*doc, ident, F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.col(e).cast("double").alias("v")) for e in elements])).alias("x")).where("x.v > 0")
        b = F.floor(F.log("x.v") / step)
        return tidy.select(*doc, ident, F.col("x.e").alias("e"), F.col("x.v").alias(f"v_{ident}"), F.explode(F.array(b - 1, b, b + 1) if shifted else F.array(b)).alias("bucket"))

    a, b = spread(pred, pred_id, True), spread(truth, truth_id, False)
    near = a.join(b.hint("merge"), [*doc, "e", "bucket"]).where(F.abs(F.col(f"v_{pred_id}") - F.col(f"v_{truth_id}")) <= within * F.col(f"v_{truth_id}"))
    hits = near.groupBy(*doc, pred_id, truth_id).agg(F.count_distinct("e").alias("hits"))
    have = lambda df, i: df.select(*doc, i, F.array(*[F.when(F.col(e) > 0, F.lit(e)) for e in elements]).alias(f"have_{i}"))
    both = hits.join(have(pred, pred_id), [*doc, pred_id]).join(have(truth, truth_id), [*doc, truth_id])
    n = F.size(F.array_intersect(F.array_compact(f"have_{pred_id}"), F.array_compact(f"have_{truth_id}")))
    return both.select(*doc, pred_id, truth_id, (F.col("hits") / n).alias("share")).where(F.col("share") >= share)


def nearest_string(left: DataFrame, right: DataFrame, value: str, entry: str, max_rows: int = 10_000) -> DataFrame:
    """For each distinct value the entry at the least edit distance, the first in order on ties. Entries are a bounded list."""
    v = left.select(F.col(value).alias("value")).where("value IS NOT NULL").distinct()
    e = right.select(F.col(entry).alias("entry")).where("entry IS NOT NULL").distinct()
    if e.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} entries: use a metric index instead")
    listed = e.agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    scored = v.join(F.broadcast(listed)).select("value", F.array_min(F.transform("entries", lambda x: F.struct(F.levenshtein("value", x).alias("d"), x.alias("e")))).alias("b"))
    return scored.select("value", F.col("b.e").alias("entry"), F.col("b.d").alias("distance"))


def text_similarity(a: Column, b: Column) -> Column:
    """The greater of word Jaccard and the sequence matcher's ratio; two empty texts give 1, one empty 0, a null null."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            if p is None or q is None:
                return None
            if not p or not q:
                return float(not p and not q)
            s, t = set(p.split()), set(q.split())
            jaccard = len(s & t) / len(s | t) if s | t else 0.0
            return max(jaccard, difflib.SequenceMatcher(None, p, q).ratio())

        return pd.Series([one(p, q) for p, q in zip(x, y)])

    return ratio(a, b)


def staged_hits(asked: DataFrame, rows: DataFrame, doc: list[str], wanted: str, id_columns: list[str]) -> DataFrame:
    """``(doc, wanted, stage, hit)``: the id of a document's row that answers a wanted name, from the first stage with any.

    Stage 1 is the first id column as it stands, stage 2 the same but for case and blanks, stage 3 and on the other id columns so.
    All stages are one equi-join on exploded keys; null names and ids meet nothing.
    """
    fold = lambda c: F.lower(F.trim(c))
    keys = [F.struct(F.lit("=").alias("how"), F.col(id_columns[0]).alias("k"), F.lit(1).alias("stage"), F.col(id_columns[0]).alias("hit"))]
    keys += [F.struct(F.lit("~").alias("how"), fold(F.col(c)).alias("k"), F.lit(i + 2).alias("stage"), F.col(c).alias("hit")) for i, c in enumerate(id_columns)]
    offered = rows.select(*doc, F.explode(F.array(*keys)).alias("x")).select(*doc, "x.*").where("k IS NOT NULL").distinct()
    q = asked.select(*doc, wanted).where(F.col(wanted).isNotNull()).distinct()
    forms = q.select(*doc, wanted, F.explode(F.array(F.struct(F.lit("=").alias("how"), F.col(wanted).alias("k")), F.struct(F.lit("~").alias("how"), fold(F.col(wanted)).alias("k")))).alias("x")).select(*doc, wanted, "x.*")
    hits = forms.join(offered.hint("merge"), [*doc, "how", "k"]).select(*doc, wanted, "stage", "hit").distinct()
    return prioritised_lookup(hits, [*doc, wanted], "stage")


def prioritised_lookup(hits: DataFrame, key: list[str], stage: str) -> DataFrame:
    """Of each key the hits of its first stage that has any."""
    return hits.withColumn("_s", F.min(stage).over(Window.partitionBy(*key))).where(F.col(stage) == F.col("_s")).drop("_s")


def prefix_join(left: DataFrame, right: DataFrame, text: str, prefix: str, max_rows: int = 50_000, max_lengths: int = 1000) -> DataFrame:
    """Rows of left with the longest prefix of right their text starts with, by equi-join on the prefix lengths that occur."""
    lengths = [r[0] for r in right.select(F.length(prefix).alias("n")).where("n > 0").distinct().orderBy("n").limit(max_lengths + 1).collect()]
    if len(lengths) > max_lengths:
        raise ValueError(f"prefixes of more than {max_lengths} lengths")
    cut = left.withColumn("_p", F.explode_outer(F.array_distinct(F.array(*[F.substring(text, 1, n) for n in lengths])) if lengths else F.array(F.lit(None).cast("string"))))
    r = broadcast_if_small(right.select(F.col(prefix).alias("_r")).distinct(), max_rows)
    hits = cut.join(r, F.col("_p") == F.col("_r"), "left")
    return hits.groupBy(*left.columns).agg(F.max(F.struct(F.length("_r").alias("n"), F.col("_r").alias("p")))["p"].alias(prefix))


def offset_pairs(pred: DataFrame, truth: DataFrame, doc: list[str], position: str, elements: list[str], most: int = 10, within: float = 0.1, share: float = 0.3) -> DataFrame:
    """``(doc, truth_at, pred_at, offset)``: rows of two tables paired by position at the one shift, of 0 to ``most``, at which most pairs
    agree, the smallest on ties.

    A pair agrees if at least ``share`` of the elements that both have, positive, differ by at most ``within`` of the truth. Rows
    meet by an equi-join on the shifted position; a document whose truth is shorter or longer is simply paired as far as it goes.
    """
    p = pred.select(*doc, F.col(position).alias("pred_at"), *[F.col(e).cast("double").alias(f"p_{e}") for e in elements])
    t = truth.select(*doc, F.col(position).alias("truth_at"), *[F.col(e).cast("double").alias(f"t_{e}") for e in elements])
    shifted = t.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("pred_at", F.col("truth_at") + F.col("offset"))
    met = shifted.join(p, [*doc, "pred_at"])
    both = sum(F.coalesce((F.col(f"p_{e}") > 0) & (F.col(f"t_{e}") > 0), F.lit(False)).cast("int") for e in elements)
    near = sum(F.coalesce((F.col(f"p_{e}") > 0) & (F.col(f"t_{e}") > 0) & (F.abs(F.col(f"p_{e}") - F.col(f"t_{e}")) <= within * F.col(f"t_{e}")), F.lit(False)).cast("int") for e in elements)
    agreed = met.where((both > 0) & (near >= share * both)).select(*doc, "truth_at", "pred_at", "offset")
    best = agreed.groupBy(*doc, "offset").agg(F.count(F.lit(1)).alias("n")).groupBy(*doc).agg(F.max(F.struct("n", (-F.col("offset")).alias("o"))).alias("b"))
    return agreed.join(best.select(*doc, (-F.col("b.o")).alias("offset")), [*doc, "offset"]).select(*doc, "truth_at", "pred_at", "offset")
