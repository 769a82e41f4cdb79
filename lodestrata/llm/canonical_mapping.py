"""Free-entered values mapped to a canonical list through BK-trees under a true edit metric.

A type name may have its commodities before or behind its style, in any order, as words or symbols. Each way to read it gives one
normal form, style and sorted commodities, and the form is searched in BK-trees over the normal forms of the reference entries.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import checkpointed


def edit_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insert, delete, replace, swap of neighbours. A metric, unlike its restricted form."""
    if a == b:
        return 0
    big = len(a) + len(b)
    rows = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for j in range(len(b) + 1):
        rows[1][j + 1] = j
    last_row: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        rows[i + 1][0], rows[i + 1][1] = big, i
        last_col = 0
        for j, y in enumerate(b, 1):
            k, m = last_row.get(y, 0), last_col
            if x == y:
                last_col = j
            rows[i + 1][j + 1] = min(
                rows[i][j] + (x != y), rows[i + 1][j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)
            )
        last_row[x] = i
    return rows[-1][-1]


def levenshtein(a: str, b: str) -> int:
    """Levenshtein distance, a column of the matrix at a time in the bits of an integer."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    n = len(a)
    full, top = (1 << n) - 1, 1 << (n - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = full, 0, n
    for c in b:
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(x | up)), up & x
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        carried = eq | down
        up, down = fall | (full & ~(carried | rise)), rise & carried
    return score


class BKTree:
    """Burkhard-Keller tree over Levenshtein distance: the child at distance d holds the entries at d from its parent, so that
    the triangle inequality leaves only children within the threshold of the query's distance to visit."""

    def __init__(self, entries):
        self.root = None
        for e in sorted(set(entries)):
            self._add(e)

    def _add(self, entry: str) -> None:
        if self.root is None:
            self.root = (entry, {})
            return
        node = self.root
        while True:
            d = levenshtein(entry, node[0])
            if d not in node[1]:
                node[1][d] = (entry, {})
                return
            node = node[1][d]

    def near(self, query: str, threshold: int) -> list[str]:
        """Every entry at most ``threshold`` from the query by Levenshtein distance."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            entry, children = stack.pop()
            d = levenshtein(query, entry)
            if d <= threshold:
                out.append(entry)
            stack += [c for k, c in children.items() if d - threshold <= k <= d + threshold]
        return out

    def within(self, query: str, threshold: int) -> list[tuple[int, str]]:
        """Every entry at most ``threshold`` from the query by Damerau-Levenshtein distance, nearest first, ties in order of the
        entries. A swap counts one there and at most two in the tree's metric, so twice the threshold misses none."""
        hits = ((edit_distance(query, e), e) for e in self.near(query, 2 * threshold))
        return sorted(h for h in hits if h[0] <= threshold)


def entries_within(values: DataFrame, reference: DataFrame, threshold: int, part_rows: int = 20_000, exact_alone: bool = False) -> DataFrame:
    """``(shard, value, entry, distance)``: every reference entry within ``threshold`` edits of each value of its shard.

    ``values(shard, value)`` and ``reference(shard, entry)``: a shard is what must agree exactly; each has a BK-tree of its own.
    The reference is sent in parts of about ``part_rows`` entries (the bound on what a task is sent), every part meets every
    value, and values stream past the trees in batches. With ``exact_alone`` an entry equal to the value stands for all. Nulls are
    left out on both sides, repeated values and entries count once; an empty side gives nothing.
    """
    v = values.select("shard", "value").where("value IS NOT NULL AND shard IS NOT NULL").distinct()
    r = reference.select("shard", "entry").where("entry IS NOT NULL AND shard IS NOT NULL").distinct()
    n = r.count()
    parts = max(1, -(-n // part_rows))
    if parts > 1:
        r = checkpointed(r.withColumn("_part", F.pmod(F.xxhash64("shard", "entry"), F.lit(parts)).cast("int")))
        v = checkpointed(v)

    def search(entries: list[tuple[str, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed: dict[str, list[str]] = {}
            for shard, entry in entries:
                listed.setdefault(shard, []).append(entry)
            trees = {shard: (BKTree(es), set(es)) for shard, es in listed.items()}
            for b in batches:
                out: list[list] = [[], [], [], []]
                for shard, value in zip(b.column("shard").to_pylist(), b.column("value").to_pylist()):
                    if shard in trees:
                        tree, known = trees[shard]
                        hits = [(0, value)] if exact_alone and value in known else tree.within(value, threshold)
                        for d, e in hits:
                            for column, x in zip(out, (shard, value, e, d)):
                                column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.string(), pa.string(), pa.int32()))], names=["shard", "value", "entry", "distance"])

        return v.mapInArrow(run, "shard string, value string, entry string, distance int")

    found = [search([(x["shard"], x["entry"]) for x in (r.where(F.col("_part") == i) if parts > 1 else r).collect()]) for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def nearest_entries(values: DataFrame, reference: DataFrame, threshold: int, part_rows: int = 20_000) -> DataFrame:
    """``(value, entry, distance)``: for each distinct value its nearest reference entry within ``threshold`` edits, or nulls.

    ``values`` and ``reference`` have one string column each. Null values and entries are left out, repeated ones count once; the
    winners of the parts of a long reference merge by (distance, entry), so ties go to the entry that sorts first. An empty
    reference gives nulls for every value.
    """
    v = values.select(F.lit("").alias("shard"), F.col(values.columns[0]).alias("value")).where("value IS NOT NULL").distinct()
    r = reference.select(F.lit("").alias("shard"), F.col(reference.columns[0]).alias("entry"))
    best = entries_within(v, r, threshold, part_rows).groupBy("value").agg(F.min(F.struct("distance", "entry")).alias("b"))
    return v.select("value").join(best.hint("merge"), "value", "left").select("value", "b.entry", "b.distance")


#: Commodity words and their symbols.
SYMBOLS = {
    "silver": "Ag", "aluminium": "Al", "arsenic": "As", "gold": "Au", "barium": "Ba", "beryllium": "Be", "bismuth": "Bi", "cadmium": "Cd",
    "cobalt": "Co", "chromium": "Cr", "copper": "Cu", "iron": "Fe", "fluorine": "F", "gallium": "Ga", "germanium": "Ge", "graphite": "Gr",
    "mercury": "Hg", "indium": "In", "lithium": "Li", "magnesium": "Mg", "manganese": "Mn", "molybdenum": "Mo", "niobium": "Nb",
    "nickel": "Ni", "phosphorus": "P", "lead": "Pb", "palladium": "Pd", "platinum": "Pt", "rhenium": "Re", "antimony": "Sb",
    "selenium": "Se", "tin": "Sn", "tantalum": "Ta", "tellurium": "Te", "thorium": "Th", "titanium": "Ti", "thallium": "Tl",
    "uranium": "U", "vanadium": "V", "tungsten": "W", "zinc": "Zn", "zirconium": "Zr",
}
_NOISE = [
    r"^\s*(?:\?|possibl[ey]|probabl[ey]|cf\.?|perhaps|likely|maybe|aff\.?)(?![a-z])\s*",
    r"^\s*(?:model\s+)?\d{1,3}\s?[a-z]?(?:\s*[-:.,]+\s*|\s+)",
    r"\s*[;,-]?\s*\b(?:after field notes|see text|see notes?)\s*$",
    r"\s*\[[^\]]*\]\s*$",
    r"\s*\(\s*\?\s*\)\s*$|\s*\?\s*$",
    r"[\s-]+(?:deposits?|types?|mineralisation|mineralization|occurrences?|prospects?)\s*$",
    r"^[\s:;,.-]+|[\s:;,.-]+$",
]


def plain(text: str) -> str:
    t = unicodedata.normalize("NFKC", text).strip().lower()
    t = re.sub(r"[‐-―−]", "-", t)
    return re.sub(r"\s+", " ", t)


def without_noise(text: str) -> str:
    """The name without a leading model number, doubts, remarks and words such as deposit or type around it."""
    before = None
    while before != text:
        before = text
        for p in _NOISE:
            text = re.sub(p, "", text)
    return text


def type_form(name: str | None) -> tuple[str, str, int] | None:
    """(style letters, sorted commodities, style words) of a listed type such as 'Karst-fill tin'; None for a name of one word."""
    style, _, goods = plain(name or "").rpartition(" ")
    key = re.sub(r"[^\w]|_", "", style)
    return (key, "-".join(sorted(set(goods.split("-")))), len(re.findall(r"\w+", style))) if key else None


class NameReader:
    """Readings of a free-entered type name: a style and its commodities, in either order and any spelling of the separators.

    Each commodity is a known symbol or within one edit (two from eight letters on) of a commodity word, by a BK-tree.
    """

    def __init__(self, goods: set[str]):
        self.symbols = {s.lower(): w for w, s in SYMBOLS.items()}
        self.goods = BKTree(set(SYMBOLS) | goods)
        self.known: dict[str, tuple[int, str] | None] = {}

    def commodity(self, word: str) -> tuple[int, str] | None:
        if word in self.symbols:
            return 0, self.symbols[word]
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            hits = self.goods.within(word, 2 if len(word) >= 8 else 1 if len(word) >= 3 else 0)
            self.known[word] = hits[0] if hits and (len(hits) == 1 or hits[0][0] < hits[1][0]) else None
        return self.known[word]

    def readings(self, bare: str) -> dict[tuple[str, str], int]:
        """(style letters, sorted commodities) -> edits in the commodities, for each way to part the words of a noise-free name."""
        words = re.findall(r"[^\W_]+", bare)
        goods = [(0, "") if w in ("and", "with", "or") else self.commodity(w) for w in words]
        out: dict[tuple[str, str], int] = {}
        for k in range(1, len(words)):
            for style, rest in ((words[:k], goods[k:]), (words[-k:], goods[:-k])):
                named = [g for g in rest if g is None or g[1]]
                if named and None not in named:
                    key = "".join(style), "-".join(sorted({g[1] for g in named}))
                    out[key] = min(out.get(key, 99), sum(g[0] for g in named))
        return out


_READ = "k string, n bigint, by_name boolean, bare string, uri_id string, readings array<struct<style:string,goods:string,cost:int>>"


def read_names(spelt: DataFrame, goods: set[str]) -> DataFrame:
    """Distinct ``(k, n, name, uri)`` with what decides them: the noise-free name and its readings, or under a blank name the URI's last segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = NameReader(goods)
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                some = b.slice(s, 2000)
                by_name, bares, uris, readings = [], [], [], []
                for name, uri in zip(some.column("name").to_pylist(), some.column("uri").to_pylist()):
                    named = bool(name and name.strip())
                    bare = without_noise(plain(name)) if named else None
                    by_name.append(named)
                    bares.append(bare or None)
                    uris.append(re.split(r"[/#]", uri.strip().rstrip("/#").strip())[-1].lower() if not named and uri and uri.strip() else None)
                    readings.append([{"style": k[0], "goods": k[1], "cost": c} for k, c in reader.readings(bare).items()] if bare else [])
                kind = pa.list_(pa.struct([("style", pa.string()), ("goods", pa.string()), ("cost", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [some.column("k"), some.column("n"), pa.array(by_name), pa.array(bares, pa.string()), pa.array(uris, pa.string()), pa.array(readings, kind)],
                    names=["k", "n", "by_name", "bare", "uri_id", "readings"],
                )

    return spelt.mapInArrow(run, _READ)


def map_types(rows: DataFrame, types: DataFrame, max_goods: int = 20_000, hot_share: int = 8_000, part_rows: int = 20_000) -> DataFrame:
    """``rows(origin, row_key, pos, name, uri)`` as ``(origin, row_key, pos, type_id)``, each once; type_id 'NONE' where none fits.

    Each distinct spelling is read and searched once, in BK-trees over the reference entries (sharded by their commodities, which
    must agree): it fits an entry if the style is within one edit a style word, at most three; of several the least edits and then
    the smallest type_id win. A name that is an entry's abbreviation fits that. Rows with name and URI both null or blank give no
    row. Only the list's distinct commodity words, at most ``max_goods``, are sent whole. The decisions go back to the rows by broadcast
    for spellings of more than one in ``hot_share`` rows (no more than ``hot_share`` can be), by shuffle for the rest.
    """
    listed = types.where("type_id IS NOT NULL").select(F.trim("type_id").alias("_t"), "type_id", "deposit_type", "abbrev")

    @F.pandas_udf("struct<style:string,goods:string,words:int>")
    def form(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([type_form(x) or (None, None, None) for x in names], columns=["style", "goods", "words"]).astype({"words": "Int32"})

    entries = checkpointed(listed.withColumn("f", form("deposit_type")).where("f.style IS NOT NULL").groupBy("f.style", "f.goods", "f.words").agg(F.min("type_id").alias("type_id")))
    goods = [r[0] for r in entries.select(F.explode(F.split("goods", "-")).alias("g")).distinct().limit(max_goods + 1).collect()]
    if len(goods) > max_goods:
        raise ValueError(f"more than {max_goods} commodity words in the list")

    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    keyed = rows.withColumn("k", F.concat(key("name"), F.lit("\x01"), key("uri")))
    spelt = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.first("name").alias("name"), F.first("uri").alias("uri"))
    read = checkpointed(read_names(spelt, set(goods)))
    forms = read.select("k", F.explode("readings").alias("r")).select("k", "r.style", "r.goods", "r.cost")
    near = entries_within(forms.select(F.col("goods").alias("shard"), F.col("style").alias("value")), entries.select(F.col("goods").alias("shard"), F.col("style").alias("entry")), 3, part_rows, exact_alone=True)
    near = near.join(entries.select(F.col("goods").alias("shard"), F.col("style").alias("entry"), "words", "type_id"), ["shard", "entry"]).where("distance <= words")
    hits = forms.join(near.hint("merge"), (forms["goods"] == near["shard"]) & (forms["style"] == near["value"]))
    fits = hits.groupBy("k").agg(F.min(F.struct((F.col("cost") + F.col("distance")).alias("edits"), "type_id")).alias("b")).select("k", F.col("b.type_id").alias("by_form"))
    short = listed.where("trim(abbrev) != ''").groupBy(F.lower(F.trim("abbrev")).alias("bare")).agg(F.min("type_id").alias("by_abbrev"))
    ids = listed.groupBy(F.lower("_t").alias("uri_id")).agg(F.min("type_id").alias("by_uri"))
    told = read.select("k", "n", "by_name", "bare", "uri_id").join(fits.hint("merge"), "k", "left").join(short.hint("merge"), "bare", "left").join(ids.hint("merge"), "uri_id", "left")
    decided = F.when(F.col("by_name"), F.coalesce("by_abbrev", "by_form", F.lit("NONE"))).when(F.col("uri_id").isNotNull(), F.coalesce("by_uri", F.lit("NONE")))
    told = checkpointed(told.select("k", "n", decided.alias("type_id")))

    total = told.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total / hot_share
    columns = ["origin", "row_key", "pos", "type_id"]
    met = keyed.select("origin", "row_key", "pos", "k").join(F.broadcast(told.where(hot).select("k", "type_id", F.lit(True).alias("_hot"))), "k", "left")
    rest = met.where("_hot IS NULL").drop("type_id", "_hot").join(told.where(~hot).select("k", "type_id").hint("merge"), "k")
    return met.where("_hot").select(*columns).unionByName(rest.select(*columns)).where("type_id IS NOT NULL").distinct()


def site_and_sheet_types(sites: DataFrame, sheet: DataFrame, types: DataFrame) -> DataFrame:
    """The candidates of the site records and the original names of the sheet, mapped to the reference list."""
    candidates = sites.select("rec_id", F.posexplode("deposit_type_candidate").alias("pos", "c")).select(
        F.lit("candidate").alias("origin"), F.col("rec_id").alias("row_key"), F.col("pos").cast("int").alias("pos"),
        F.col("c.observed_name").alias("name"), F.col("c.normalized_uri").alias("uri"),
    )
    originals = sheet.select(
        F.lit("original").alias("origin"), F.col("row_id").alias("row_key"), F.lit(0).alias("pos"),
        F.col("deposit_type_original").alias("name"), F.lit(None).cast("string").alias("uri"),
    )
    return map_types(candidates.unionByName(originals), types)
