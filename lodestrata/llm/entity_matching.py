"""Records of several site indexes that describe the same place, paired without a common key.

Names are read into a core, a qualifier (direction, level, number) and a feature; cores one edit from a better attested one are
taken for it. Candidate pairs agree in core and qualifier (and in position, where very many do), or, where a name is missing or a stock phrase, lie at one spot.
Each gets a prior log-odds from its partial evidence: spelling, feature, great-circle distance under the usual entry errors,
commodities, country and state. Loopy belief propagation with one-to-one factors (a place of one index is at most one place of
another, entered once or more) then exchanges messages through joins until they settle, and gives each pair its marginal
probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lodestrata.llm.canonical_mapping import SYMBOLS, edit_distance
from lodestrata.session import broadcast_if_small, checkpointed

#: Words of site names and their short forms.
FEATURES = {
    "creek": "creek ck cr crk crick", "lake": "lake lk", "mount": "mount mt mtn mountain", "hill": "hill hl", "ridge": "ridge rdg rdge", "canyon": "canyon cnyn cyn",
    "spring": "spring spg spr springs", "basin": "basin bsn", "peak": "peak pk", "gulch": "gulch glch gl", "flat": "flat flt flats", "bluff": "bluff blf bluffs", "knob": "knob knb",
    "valley": "valley vly", "river": "river rv", "point": "point pt", "bay": "bay", "island": "island isl", "butte": "butte", "pass": "pass", "draw": "draw", "fork": "fork fk",
}
SITE_WORDS = "mine mines mn deposit deposits dep prospect prospects prosp pros occurrence occurrences occ occur claim claims clm the a of workings site project property lode".split()
QUALIFIERS = {
    "N": "n north nth northern", "S": "s south sth southern", "E": "e east est eastern", "W": "w west wst western", "UP": "up upr upper uppr", "LOW": "low lwr lower lowr", "MID": "mid middle mdl central",
}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
STOCK = {"", "na", "none", "null", "nan", "unnamed", "unknown", "noname", "oldadit", "oldshaft", "adit", "shaft", "pit", "quarry", "notnamed", "tobedetermined", "various", "untitled", "oldpit", "testpits", "testpit", "openworkings", "trench", "trenches", "showing", "outcrop", "open", "opencut", "openpit", "gravelpit", "sandpit", "claypit", "borrowpit"} | set(ROMAN)
#: Records that bear one ordinary name: a place or two, entered once or more in each index.
USUAL_BEARERS = 8
_WORDS: dict[str, tuple[str, str]] = {s: ("F", f) for f, ss in FEATURES.items() for s in ss.split()}
_WORDS |= {s: ("Q", q) for q, ss in QUALIFIERS.items() for s in ss.split()}
_WORDS |= {s: ("D", s) for s in SITE_WORDS}
_LONG = [w for w in _WORDS if len(w) >= 5]


@lru_cache(maxsize=200_000)
def _kind(word: str) -> tuple[str, str] | None:
    if word in _WORDS:
        return _WORDS[word]
    if len(word) >= 5:
        for w in _LONG:
            if abs(len(w) - len(word)) <= 1 and (w[:2] == word[:2] or w[-2:] == word[-2:]) and edit_distance(word, w) == 1:
                return _WORDS[w]
    return None


def unmangle(text: str) -> str:
    if "Ã" in text or "Â" in text or "Å" in text:
        try:
            return text.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return text


def read_name(name: str) -> tuple[str, str, str]:
    """(core, qualifier, feature) of one written name: letters of the core run together, qualifiers sorted."""
    t = unicodedata.normalize("NFKD", unmangle(name))
    t = "".join(c for c in t if not unicodedata.combining(c))
    tokens = re.findall(r"#|[A-Za-z]+|\d+", t)
    core, quals, features = [], set(), []
    k = 0
    while k < len(tokens):
        w = tokens[k].lower()
        following = tokens[k + 1] if k + 1 < len(tokens) else ""
        if w in ("no", "nr", "num", "number", "#", "nbr") and (following.isdigit() or following.lower() in ROMAN):
            quals.add(str(int(following) if following.isdigit() else ROMAN[following.lower()]))
            k += 2
            continue
        if w.isdigit():
            quals.add(str(int(w)))
        elif w in ROMAN and (core or features) and tokens[k].isupper():
            quals.add(str(ROMAN[w]))
        elif w != "#":
            kind = _kind(w)
            if kind is None:
                core.append(w)
            elif kind[0] == "F":
                features.append(kind[1])
            elif kind[0] == "Q":
                quals.add(kind[1])
        k += 1
    return "".join(core), "/".join(sorted(quals)), "/".join(sorted(set(features)))


def written_names(text: str | None) -> list[str]:
    """The names in a field: a list printed as text gives each of its items, an alias in parentheses a name of its own."""
    if text is None or not text.strip():
        return []
    t = text.strip()
    parts = [a or b for a, b in re.findall(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"", t)] if t[0] == "[" and t[-1] == "]" else [t]
    out = []
    for p in parts or [t.strip("[]")]:
        for alias in re.findall(r"\(([^()]*)\)", p):
            core, qual, feature = read_name(alias)
            if core:
                out.append(alias)
                p = p.replace(f"({alias})", " ")
        out.insert(0 if p is parts[0] else len(out), p)
    return list(dict.fromkeys(out))


_SYMBOL_OF = {w: s for w, s in SYMBOLS.items()} | {s.lower(): s for s in SYMBOLS.values()}


def commodity_symbols(text: str | None) -> list[str]:
    return sorted({s for w in re.findall(r"[A-Za-z]+", text or "") if (s := _SYMBOL_OF.get(w.lower()))})


def letter_set(core: str) -> int:
    """The letters of a core as the bits of a number: an edit changes at most two of them."""
    n = 0
    for c in set(core):
        n |= 1 << (ord(c) - 97 & 63)
    return n


_PARSED = "rec_id bigint, src string, lat double, lon double, goods array<string>, country string, state string, names array<struct<core:string,qual:string,feature:string,alias:boolean,letters:bigint>>"


def parse_records(records: DataFrame) -> DataFrame:
    """``records(rec_id, src, name, country, state, lat, lon, goods)`` with names read and coordinates that are none set to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, list] = {}
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                out = []
                for r in b.slice(s, 4096).to_pylist():
                    key = r["name"] or ""
                    if key not in kinds:
                        if len(kinds) > 100_000:
                            kinds.clear()
                        kinds[key] = [dict(zip(("core", "qual", "feature"), x := read_name(n)), alias=i > 0, letters=letter_set(x[0])) for i, n in enumerate(written_names(key))]
                    lat, lon = r["lat"], r["lon"]
                    if lat is None or lon is None or abs(lat) > 180 or abs(lon) > 180 or (lat == 0 and lon == 0) or lat != lat or lon != lon:
                        lat = lon = None
                    country, state = r["country"], r["state"]
                    out.append(
                        {"rec_id": r["rec_id"], "src": r["src"], "lat": lat, "lon": lon, "goods": commodity_symbols(r["goods"]), "names": kinds[key],
                         "country": re.sub(r"[^a-z]", "", country.lower())[:3] or None if country else None,
                         "state": (re.findall(r"\w+", state.lower()) or [None])[0] if state else None}
                    )
                yield pa.RecordBatch.from_pylist(
                    out,
                    schema=pa.schema([
                        ("rec_id", pa.int64()), ("src", pa.string()), ("lat", pa.float64()), ("lon", pa.float64()), ("goods", pa.list_(pa.string())), ("country", pa.string()), ("state", pa.string()),
                        ("names", pa.list_(pa.struct([("core", pa.string()), ("qual", pa.string()), ("feature", pa.string()), ("alias", pa.bool_()), ("letters", pa.int64())]))),
                    ]),
                )

    return records.mapInArrow(run, _PARSED)


@F.pandas_udf(IntegerType())
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b)])


_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Cores up to this length get the keys of all their deletions; longer ones three blocks, and those at the seam both.
_SHORT, _SEAM, _BLOCK = 42, 39, 12


def edit_keys(words: list[str], deletions: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, key): words at most ``deletions`` (1 or 2) edits apart, a swap of neighbours being one, share a key.

    A key is a polynomial hash of the word without up to so many of its letters, from running sums. Edits so few spare one of
    three blocks far apart in a long word: its first letters, its last, or some about the middle, shifted a little.
    """
    places, keys = [], []
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, members in by_length.items():
        power = np.cumprod(np.array([1] + [_BASE] * n, np.uint64), dtype=np.uint64)
        back, back2 = np.uint64(_UNBASE), np.uint64(_UNBASE * _UNBASE % (1 << 64))
        i, j = np.triu_indices(n, 1)
        step = max(1, 2_000_000 // max(1, n * n if n <= _SHORT else n))
        for s in range(0, len(members), step):
            at = np.array(members[s : s + step])
            letters = np.frombuffer("".join(words[k] for k in at).encode("utf-32-le"), np.uint32).reshape(len(at), n).astype(np.uint64)
            sums = np.concatenate([np.zeros((len(at), 1), np.uint64), np.cumsum(letters * power[:n], axis=1, dtype=np.uint64)], axis=1)
            made = []
            if n <= _SHORT:
                k = np.arange(n)
                made += [sums[:, -1:], sums[:, k] + (sums[:, -1:] - sums[:, k + 1]) * back]
                if deletions == 2:
                    made.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * back + (sums[:, -1:] - sums[:, j + 1]) * back2)
            if n >= _SEAM:
                middle = n // 2 - _BLOCK // 2
                for first, kind in ((0, 1), (n - _BLOCK, 2), *((middle + d, 3) for d in range(-3, 4))):
                    made.append((letters[:, first : first + _BLOCK] * power[1 : _BLOCK + 1]).sum(axis=1, dtype=np.uint64)[:, None] + np.uint64(kind))
            all_keys = np.sort(np.concatenate(made, axis=1), axis=1)
            fresh = np.concatenate([np.ones((len(at), 1), bool), all_keys[:, 1:] != all_keys[:, :-1]], axis=1)
            places.append(np.repeat(at, fresh.sum(axis=1)))
            keys.append(all_keys[fresh].view(np.int64))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(keys)


def close_cores(cores: DataFrame, most: int) -> DataFrame:
    """``(core_a, n_a, core_b, n_b)``: pairs of ``cores(core, n)`` at most ``most`` (1 or 2) edits apart, each once, core_a < core_b.

    They meet on keys of 8 bytes; letters, lengths and a threshold distance screen them before the exact one, so that pairs that
    only share a key are gone before the names come back by their hash (of two cores with one hash both are tried).
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4000):
                some = b.slice(s, 4000)
                words = some.column("core").to_pylist()
                letters = pa.array([letter_set(w) for w in words], pa.int64())
                at, keys = edit_keys(words, most)
                for lo in range(0, len(at), 400_000):
                    at_ = pa.array(at[lo : lo + 400_000])
                    yield pa.RecordBatch.from_arrays(
                        [some.column("id").take(at_), letters.take(at_), some.column("size").take(at_), pa.array(keys[lo : lo + 400_000])], names=["id", "letters", "size", "k"]
                    )

    named = cores.select(F.xxhash64("core").alias("id"), "core", "n", F.length("core").alias("size"))
    keyed = named.select("id", "core", "size").mapInArrow(spread, "id bigint, letters bigint, size int, k bigint")
    a, b = keyed.alias("a"), keyed.alias("b")
    alike = (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id")) & (F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2 * most) & (F.abs(F.col("a.size") - F.col("b.size")) <= most)
    met = a.join(b.hint("merge"), alike).select(F.col("a.id").alias("ia"), F.col("b.id").alias("ib")).distinct()
    one = lambda s: named.select(F.col("id").alias(f"i{s}"), F.col("core").alias(f"core_{s}"), F.col("n").alias(f"n_{s}"))
    met = met.join(one("a").hint("merge"), "ia").join(one("b").hint("merge"), "ib")
    met = met.where(F.levenshtein("core_a", "core_b", 2 * most) >= 0)  # a swap counts two there
    return met.withColumn("edits", edits("core_a", "core_b")).where(F.col("edits") <= most).select("core_a", "n_a", "core_b", "n_b")


def core_dictionary(cores: DataFrame, least: int = 6, hops: int = 2) -> DataFrame:
    """``(core, canonical)`` for each core of ``least`` letters or more one edit from a better attested one; ``cores`` has (core, n).

    Of several the best attested counts, and chains are followed for 2 ** ``hops`` steps: a longer one leads to another name.
    """
    pairs = close_cores(cores.where(F.length("core") >= least), 1)
    a, b = F.struct(F.col("n_a").alias("m"), F.col("core_a").alias("other")), F.struct(F.col("n_b").alias("m"), F.col("core_b").alias("other"))
    b_better = (F.col("n_b") > F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("core_b") < F.col("core_a")))
    near = pairs.select(F.when(b_better, F.col("core_a")).otherwise(F.col("core_b")).alias("core"), F.when(b_better, b).otherwise(a).alias("x"))
    step = checkpointed(near.groupBy("core").agg(F.max("x").alias("x")).select("core", F.col("x.other").alias("canonical")))
    for _ in range(hops):
        on = step.select(F.col("core").alias("via"), F.col("canonical").alias("end"))
        step = checkpointed(step.join(on.hint("merge"), F.col("canonical") == F.col("via"), "left").select("core", F.coalesce("end", "canonical").alias("canonical")))
    return step


def lone_cores(cores: DataFrame, known: DataFrame, least: int = 8) -> DataFrame:
    """``(core, canonical)`` for cores met once and near no better attested one: two of them up to two edits apart may both be
    misspelt from a form that stands nowhere."""
    lone = cores.where((F.col("n") == 1) & (F.length("core") >= least)).join(known.hint("merge"), "core", "left_anti")
    near = close_cores(lone, 2).select(F.greatest("core_a", "core_b").alias("core"), F.least("core_a", "core_b").alias("other"))
    return near.groupBy("core").agg(F.min("other").alias("canonical"))


def _km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), h))))


def cells(lat: Column, lon: Column, side: float, reach: float = 0.0) -> Column:
    """The cubes of ``side`` km in space that lie within ``reach`` km of the point (in each direction): no poles, no date line, no narrowing."""
    y, x = F.radians(lat), F.radians(lon)
    axes = [F.cos(y) * F.cos(x) * 6371.0088, F.cos(y) * F.sin(x) * 6371.0088, F.sin(y) * 6371.0088]
    far = reach * 1.0001
    i, j, k = (F.sequence(F.floor((c - far) / side), F.floor((c + far) / side)) for c in axes)
    cube = lambda p, q, r: F.struct(p.alias("cx"), q.alias("cy"), r.alias("cz"))
    return F.flatten(F.transform(i, lambda p: F.flatten(F.transform(j, lambda q: F.transform(k, lambda r: cube(p, q, r))))))


def _slips(lat: Column, lon: Column) -> list[tuple[Column, Column]]:
    """What a lost or added sign, swapped coordinates, or both make of a point."""
    return [(-lat, lon), (lat, -lon), (-lat, -lon), (lon, lat), (-lon, lat), (lon, -lat)]


def _prior(named: bool, spelling: Column | None = None) -> Column:
    """Log-odds of a candidate pair (records a and b) from its partial evidence; unknown evidence adds nothing.

    A name says the less the more records bear it (``a.n``); beside a position it never counts for less than a look at the spot.
    """
    la, oa, lb, ob = (F.col(c) for c in ("a.lat", "a.lon", "b.lat", "b.lon"))
    plain = _km(la, oa, lb, ob)
    slips = F.least(*[_km(la, oa, y, x) for y, x in _slips(lb, ob)])
    shared = F.size(F.array_intersect("a.goods", "b.goods"))
    goods = F.when((F.size("a.goods") == 0) | (F.size("b.goods") == 0), 0.0).when(shared == 0, -4.5).when(shared == F.least(F.size("a.goods"), F.size("b.goods")), 1.5).otherwise(-1.0)
    region = F.when(F.col("a.country") == F.col("b.country"), 0.5).when(F.col("a.country") != F.col("b.country"), -2.0).otherwise(0.0)
    state = F.when(F.col("a.state") == F.col("b.state"), 0.5).when(F.col("a.state") != F.col("b.state"), -2.0).otherwise(0.0)
    if named:
        place = F.when(plain.isNull(), 0.0).when(plain <= 1.0, 2.5).when(plain <= 2.5, 1.0).when(plain <= 6, -1.5).when(slips <= 3, 0.5).when(plain <= 30, -4.0).otherwise(-5.0)
        feature = F.when((F.col("a.feature") == "") | (F.col("b.feature") == ""), 0.0).when(F.col("a.feature") == F.col("b.feature"), 1.0).otherwise(-4.0)
        spelling = spelling if spelling is not None else F.when(F.col("a.core") == F.col("b.core"), 3.0).otherwise(2.0)
        toll = F.log(F.greatest(F.lit(1.0), F.col("a.n") / USUAL_BEARERS))
        return spelling - F.when(plain.isNull(), toll).otherwise(F.least(toll, F.lit(4.5))) + place + feature + goods + region + state
    return F.lit(-1.0) + 3.0 * F.exp(-plain / 0.05) + goods + region + state


def _hot_pairs(hot: DataFrame, reach: float = 6.0, salts: int = 32) -> DataFrame:
    """Joined pairs (a, b) of records of one over-shared name: those within ``reach`` km as written or after a slip, by position
    cell; and those of which one has no coordinates, the name's other records shared out to ``salts`` groups.

    Any other pair of such a name has a prior of at most -1.4 (over 400 bearers, all other evidence for it), so nothing likely is left out.
    """
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.qual") == F.col("b.qual")) & (F.col("a.src") < F.col("b.src"))
    located = hot.where("lat IS NOT NULL")
    points = F.array(*[F.struct(y.alias("y"), x.alias("x")) for y, x in [(F.col("lat"), F.col("lon")), *_slips(F.col("lat"), F.col("lon"))]])
    here = located.withColumn("c", cells(F.col("lat"), F.col("lon"), 4 * reach)[0])
    there = located.withColumn("v", F.explode(points)).withColumn("c", F.explode(cells(F.col("v.y"), F.col("v.x"), 4 * reach, reach)))
    near = here.alias("a").join(there.alias("b").hint("merge"), same & (F.col("a.c") == F.col("b.c"))).where(_km(F.col("a.lat"), F.col("a.lon"), F.col("b.v.y"), F.col("b.v.x")) <= reach)
    shared = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(salts)).cast("int"))
    void = hot.where("lat IS NULL").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = _weighed(near)
    for a, b in ((void, shared(hot)), (shared(located), void)):
        out = out.unionByName(_weighed(a.alias("a").join(b.alias("b").hint("merge"), same & (F.col("a.salt") == F.col("b.salt")))))
    return out


def _misspelt_pairs(names: DataFrame, reach: float = 6.0) -> DataFrame:
    """Candidate pairs of records within ``reach`` km whose names differ in key and agree in qualifier, the cores at most two edits
    apart, of whatever length and however often met. They meet in position cells on few columns; what is left gets its evidence back."""
    slim = names.where("lat IS NOT NULL").select("rec_id", "src", "key", "core", "qual", "lat", "lon", "letters", F.length("core").alias("size"))
    # the cube's number and the qualifier in one hash: what shares it by chance is too far apart, or told by the qualifier
    cube = lambda df: df.withColumn("c", F.xxhash64("c", "qual"))
    here = cube(slim.withColumn("c", cells(F.col("lat"), F.col("lon"), 2 * reach)[0]))
    there = cube(slim.withColumn("c", F.explode(cells(F.col("lat"), F.col("lon"), 2 * reach, reach))))
    alike = (F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 4) & (F.abs(F.col("a.size") - F.col("b.size")) <= 2) & (F.abs(F.col("a.lat") - F.col("b.lat")) <= math.degrees(reach / 6371) * 1.001)
    on = (F.col("a.c") == F.col("b.c")) & alike & (F.col("a.src") < F.col("b.src")) & (F.col("a.qual") == F.col("b.qual")) & (F.col("a.key") != F.col("b.key"))
    met = here.alias("a").join(there.alias("b").hint("merge"), on)
    met = met.where(F.levenshtein("a.core", "b.core", 4) >= 0)  # two swaps of neighbours count four there
    met = met.where(_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= reach)
    ids = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in ("a", "b") for c in ("rec_id", "core", "qual")]
    close = checkpointed(met.select(*ids).distinct().withColumn("edits", edits("core_a", "core_b")).where("edits <= 2"))
    for s in ("a", "b"):
        side = names.select(F.struct(*names.columns).alias(s))
        close = close.join(side.hint("merge"), (F.col(f"rec_id_{s}") == F.col(f"{s}.rec_id")) & (F.col(f"core_{s}") == F.col(f"{s}.core")) & (F.col(f"qual_{s}") == F.col(f"{s}.qual")))
    # an edit in a short core says less of a slip and more of another name
    spelling = 2.0 - 6.0 * F.greatest(F.lit(0.0), F.col("edits") / F.least(F.length("core_a"), F.length("core_b")) - 1 / 6)
    return _weighed(close, spelling)


def _weighed(joined: DataFrame, spelling: Column | None = None) -> DataFrame:
    """Joined named records a and b as candidate pairs with their prior."""
    return joined.select(*[F.col(f"{s}.{c}").alias(f"{n}_{s}") for c, n in (("rec_id", "rec"), ("src", "src"), ("sig", "sig")) for s in ("a", "b")], _prior(True, spelling).alias("w"))


def candidate_pairs(parsed: DataFrame, hot: int = 400, spot_km: float = 0.1, wide_parts: int = 5) -> DataFrame:
    """``(rec_a, rec_b, src_a, src_b, sig_a, sig_b, w)``: candidate pairs of different sources with their prior log-odds.

    Named records meet on (canonical core, qualifier); where more than ``hot`` records share these, by position under the usual
    entry errors, and records without coordinates with all of them. Records near each other also meet on cores up to two edits apart. A name found in ``wide_parts`` or more parts of the world, or
    shared so often, stands for several places, which compete: the part, or the spot, belongs to the signature. Only listed stock
    phrases say nothing; such records, like those without a name and those of an over-shared one, meet others at one spot.
    """
    flat = parsed.select("*", F.explode("names").alias("x")).select("rec_id", "src", "lat", "lon", "goods", "country", "state", "x.core", "x.qual", "x.feature", "x.letters")
    flat = flat.where(~F.col("core").isin(*STOCK) & (F.length("core") >= 3))
    cores = checkpointed(flat.groupBy("core").agg(F.count(F.lit(1)).alias("n")))
    known = core_dictionary(cores)
    lone = checkpointed(lone_cores(cores, known)).select(F.col("core").alias("key"), F.col("canonical").alias("other"))
    flat = flat.join(broadcast_if_small(known, 100_000), "core", "left").withColumn("key", F.coalesce("canonical", "core")).drop("canonical")
    flat = flat.join(broadcast_if_small(lone, 100_000), "key", "left").withColumn("key", F.coalesce("other", "key")).drop("other")
    # absolute values in order make a swap or a lost sign no new part of the world
    low, high = F.least(F.abs("lat"), F.abs("lon")), F.greatest(F.abs("lat"), F.abs("lon"))
    part = F.struct(F.round(low).alias("p"), F.round(high).alias("q"))
    borne = flat.groupBy("key", "qual").agg(F.approx_count_distinct(F.when(F.col("lat").isNotNull(), part)).alias("parts"), F.count(F.lit(1)).alias("n"))
    common = broadcast_if_small(checkpointed(borne.where((F.col("parts") >= wide_parts) | (F.col("n") > min(hot, USUAL_BEARERS)))), 100_000)
    flat = flat.join(common, ["key", "qual"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    digits = F.when(F.col("n") > hot, 2).when(F.col("parts") >= wide_parts, 0)
    spot = F.when(digits == 2, F.concat_ws(" ", F.round(low, 2), F.round(high, 2))).when(digits == 0, F.concat_ws(" ", F.round(low), F.round(high)))
    alone = F.when(digits.isNotNull() & F.col("lat").isNull(), F.concat(F.lit("#"), F.col("rec_id").cast("string")))
    names = checkpointed(flat.withColumn("sig", F.concat_ws("|", "key", "qual", F.coalesce(alone, spot))).drop("parts"))
    few, many = names.where(F.col("n") <= hot), names.where(F.col("n") > hot)
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.qual") == F.col("b.qual")) & (F.col("a.src") < F.col("b.src"))
    columns = [F.col("a.rec_id").alias("rec_a"), F.col("b.rec_id").alias("rec_b"), F.col("a.src").alias("src_a"), F.col("b.src").alias("src_b")]
    by_name = _weighed(few.alias("a").join(few.alias("b").hint("merge"), on)).unionByName(_hot_pairs(many)).unionByName(_misspelt_pairs(names))

    named = few.select("rec_id").distinct()
    blank = parsed.join(named.hint("merge"), "rec_id", "left_anti").where("lat IS NOT NULL")
    # a coordinate rounded to two decimals or fewer says nothing at this scale
    fine = (F.abs(F.col("lat") * 100 - F.round(F.col("lat") * 100)) > 1e-6) | (F.abs(F.col("lon") * 100 - F.round(F.col("lon") * 100)) > 1e-6)
    spots = blank.where(fine).withColumn("c", F.explode(cells(F.col("lat"), F.col("lon"), 4 * spot_km, spot_km)))
    places = parsed.where(F.col("lat").isNotNull() & fine).withColumn("c", cells(F.col("lat"), F.col("lon"), 4 * spot_km)[0])
    met = spots.alias("a").join(places.alias("b").hint("merge"), F.col("a.c") == F.col("b.c")).where((F.col("a.src") != F.col("b.src")) & (_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= spot_km))
    rec = lambda s: F.concat(F.lit("#"), F.col(f"{s}.rec_id").cast("string"))
    by_spot = met.select(*columns, rec("a").alias("sig_a"), rec("b").alias("sig_b"), _prior(False).alias("w"))
    flip = F.col("src_a") < F.col("src_b")
    by_spot = by_spot.select(
        *[F.when(flip, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_a") for c in ("rec", "src", "sig")],
        *[F.when(flip, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_b") for c in ("rec", "src", "sig")],
        "w",
    )
    both = by_name.unionByName(by_spot, allowMissingColumns=False)
    best = both.where("w > -3").groupBy("rec_a", "rec_b", "src_a", "src_b").agg(F.max(F.struct("w", "sig_a", "sig_b")).alias("x"))
    return best.select("rec_a", "rec_b", "src_a", "src_b", "x.sig_a", "x.sig_b", "x.w")


def propagate(pairs: DataFrame, rounds: int = 12, tolerance: float = 1e-3, most: int = 200, at_once: int = 3) -> DataFrame:
    """Marginal match probabilities by loopy belief propagation: ``pairs`` with ``confidence``.

    The factor of a record towards another source says that at most one place there is the same; entries of one place (equal
    signature) do not compete. Messages are log-odds; the sums of incoming ones are made where the pairs of a factor meet. A pair
    without a rival on either side gets no message and is settled at once; only the others go round. A round sends the messages
    of one end, then with these those of the other. It stops when no message moves by more than ``tolerance``; after ``rounds``
    messages go only half their way, so that those that swing settle, and if they have not after ``most`` rounds it fails.
    ``at_once`` rounds are one job; its messages go to the checkpoint folder.
    """

    def factor(node: str, other: str) -> list[str]:
        return [f"rec_{node}", f"src_{other}"]

    flagged = pairs
    for node, other in (("a", "b"), ("b", "a")):
        w = Window.partitionBy(*factor(node, other))
        flagged = flagged.withColumn(f"_rivals_{node}", F.min(f"sig_{other}").over(w) != F.max(f"sig_{other}").over(w))
    flagged = checkpointed(flagged.withColumn("_open", F.col("_rivals_a") | F.col("_rivals_b")).drop("_rivals_a", "_rivals_b"))

    def sent(e: DataFrame, node: str, other: str, share: float) -> DataFrame:
        """The messages of one end's factors, ``to_`` the other end, and how far each moved."""
        group = factor(node, other)
        within = Window.partitionBy(*group)
        entries = Window.partitionBy(*group, f"sig_{other}").orderBy(F.desc("_x"))
        e = e.repartition(*group).withColumn("_x", F.exp(F.least(F.lit(60.0), F.col("w") + F.col(f"to_{node}"))))
        e = e.withColumn("_best", F.first("_x").over(entries)).withColumn("_n", F.row_number().over(entries))
        e = e.withColumn("_all", F.sum(F.when(F.col("_n") == 1, F.col("_x")).otherwise(0.0)).over(within))
        new = -F.log1p(F.greatest(F.lit(0.0), F.col("_all") - F.col("_best")))
        e = e.withColumn("_new", new).withColumn("_move", F.greatest("_move", F.abs(F.col("_new") - F.col(f"to_{other}"))))
        return e.withColumn(f"to_{other}", F.col(f"to_{other}") + share * (F.col("_new") - F.col(f"to_{other}"))).drop("_x", "_best", "_n", "_all", "_new")

    edges = flagged.where("_open").drop("_open").withColumns({"to_a": F.lit(0.0), "to_b": F.lit(0.0), "_move": F.lit(0.0)})
    moved, done = math.inf, 0
    while moved > tolerance:
        if done >= most:
            raise RuntimeError(f"the messages still move by {moved:.3g} after {most} rounds")
        for _ in range(min(at_once, most - done)):
            share = 1.0 if done < rounds else 0.5
            edges = edges.withColumn("_move", F.lit(0.0))
            edges = sent(sent(edges, "a", "b", share), "b", "a", share)
            done += 1
        edges = checkpointed(edges)
        moved = edges.agg(F.max("_move")).first()[0] or 0.0
    belief = F.col("w") + F.col("to_a") + F.col("to_b")
    open_ = edges.select(*pairs.columns, (1 / (1 + F.exp(-belief))).alias("confidence"))
    return open_.unionByName(flagged.where("NOT _open").select(*pairs.columns, (1 / (1 + F.exp(-F.col("w")))).alias("confidence")))


def match_entities(records: DataFrame) -> DataFrame:
    """``(rec_a, rec_b, confidence)``: candidate pairs of records of two sources, rec_a < rec_b, with their match probability.

    ``records`` has (rec_id, src, name, country, state, lat, lon, goods); any of them but rec_id and src may be null. Records
    with neither a telling name nor coordinates match nothing; repeated records of one place in one source all match.
    """
    found = propagate(candidate_pairs(checkpointed(parse_records(records))))
    return found.select(F.least("rec_a", "rec_b").alias("rec_a"), F.greatest("rec_a", "rec_b").alias("rec_b"), "confidence")


def site_records(sedau: DataFrame, usmin: DataFrame, sites: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    s = sedau.select("rec_id", F.lit("sedau").alias("src"), F.col("deposit_name").alias("name"), "country", none.alias("state"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("commodity").alias("goods"))
    u = usmin.select("rec_id", F.lit("usmin").alias("src"), "name", none.alias("country"), "state", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("commodity").alias("goods"))
    m = sites.select("rec_id", F.lit("site").alias("src"), "name", F.try_element_at("country", F.lit(1)).alias("country"), "state", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.concat_ws(" ", "commodities").alias("goods"))
    return s.unionByName(u).unionByName(m)


def same_places(sedau: DataFrame, usmin: DataFrame, sites: DataFrame, least: float = 0.5) -> DataFrame:
    """``(rec_a, rec_b)`` of the pairs whose match probability is at least ``least``."""
    return match_entities(site_records(sedau, usmin, sites)).where(F.col("confidence") >= least).select("rec_a", "rec_b")
