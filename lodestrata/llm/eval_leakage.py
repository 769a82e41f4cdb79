"""Evaluation texts leaking into training text: which documents carry a passage of which test item.

A prefix-filtered set join. Items become word shingles, ordered by rarity among the items; of every item-sized window of
``passage`` words only the rarest shingles are needed to find any text that carries the window with isolated words changed,
so only those are looked up. Hits far too short or out of place are dropped by length and position, and what remains is
verified word by word. The item side is taken in blocks of bounded size, each sent to all tasks; documents are read whole
and never leave their task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import broadcast_if_small, checkpointed

#: Cyrillic and Greek letters drawn like Latin ones, and those.
_DRAWN_LIKE = "аеорсухіјѕԁһѵкмтвнгАВЕКМНОРСТУХІЈЅαοεικνρτυχγωΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ"
_LATIN = "aeopcyxijsdhvkmtbhrABEKMHOPCTYXIJSaoeiknptuxywABEZHIKMNOPTYXig"
LOOK_ALIKES = str.maketrans(_DRAWN_LIKE, _LATIN)
_LOOK_ALIKE = re.compile(f"[{_DRAWN_LIKE}]")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿‪-‮]")
_MARKUP = re.compile(r"<[/!]?[A-Za-z][^<>]{0,200}>|&nbsp;|&#160;")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐-―−]\s*(?=[^\W\d_])")
_ASCII_HYPHEN = re.compile(r"(?<=[a-z])-\s*(?=[a-z])")
_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    """Words with layout, case, punctuation, accents, look-alike letters and (broken or real) hyphens folded away."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
        text = text.translate(LOOK_ALIKES) if _LOOK_ALIKE.search(text) else text
        if not text.isascii():
            return _WORD.findall(_HYPHEN.sub("", text).casefold())
    text = text.lower()
    return _ASCII_WORD.findall(_ASCII_HYPHEN.sub("", text) if "-" in text else text)


def item_words(items: DataFrame, item_id: str, question: str, shared_by: int = 3) -> DataFrame:
    """``(i, words, n)`` of each distinct (item, question): its words without the stock sentences it opens with, and how many.

    A stock sentence opens ``shared_by`` or more questions that go on differently; copies of one item go on alike and make none.
    The last sentence always stays. Null questions are left out. Sentences are counted and joined as a table, never held by one task.
    """
    kind = dict(items.dtypes)[item_id]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [[" ".join(words_of(p)) for p in re.split(r"(?<=[.?!:])\s+", q)] for q in b.column("q").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(parts, pa.list_(pa.string()))], names=["i", "s"])

    rows = items.select(F.col(item_id).alias("i"), F.col(question).alias("q")).where("q IS NOT NULL").distinct()
    said = checkpointed(rows.mapInArrow(split, f"i {kind}, s array<string>").withColumn("h", F.sha2(F.array_join("s", "\n"), 256)))
    opening = said.where(F.size("s") > 1).groupBy(F.element_at("s", 1).alias("p")).agg(F.count_distinct(F.xxhash64(F.slice("s", F.lit(2), F.size("s")))).alias("c"))
    stock = broadcast_if_small(opening.where(F.col("c") >= shared_by).select("p", F.lit(True).alias("stock")), 20_000)
    told = said.select("i", "h", F.size("s").alias("size"), F.posexplode("s").alias("at", "p")).join(stock, "p", "left")
    first = told.where("stock IS NULL OR at = size - 1").groupBy(F.col("i").alias("_i"), F.col("h").alias("_h")).agg(F.min("at").alias("at"))
    met = said.join(first.hint("merge"), F.col("i").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h"))).select("i", "s", "at")
    words = met.select("i", F.filter(F.split(F.array_join(F.slice("s", F.col("at") + 1, F.size("s")), " "), " "), lambda w: w != "").alias("words"))
    return words.withColumn("n", F.size("words"))


class LeakIndex:
    """The rarest shingles of every window of every item of one block, and the items' words for verification."""

    def __init__(self, items: list[tuple[int, list[str]]], passage: int, shingle: int, edits: int):
        self.passage, self.k, self.edits = passage, shingle, edits
        self.items = [(i, w) for i, w in items if len(w) >= passage]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in self.items for w in ws}), 1)}
        self.ids = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for _, ws in self.items]
        keys = [self.keys(x) for x in self.ids]
        seen = Counter(int(h) for ks in keys for h in set(ks.tolist()))
        need = passage - shingle + 1
        self.least = max(1, need - shingle * edits)
        keep = need - self.least + 1
        self.sets = [set(ks.tolist()) for ks in keys]
        postings: dict[int, set[int]] = defaultdict(set)
        for n, ks in enumerate(keys):
            rank = sorted(range(len(ks)), key=lambda j: (seen[int(ks[j])], int(ks[j])))
            order = np.empty(len(ks), dtype=int)
            order[rank] = np.arange(len(ks))
            chosen = set()
            for s in range(len(ks) - need + 1):
                chosen.update((s + np.argsort(order[s : s + need])[:keep]).tolist())
            for j in chosen:
                postings[int(ks[j])].add(n)
        self.hashes = np.array(sorted(postings), dtype=np.int64)
        self.postings = [sorted(postings[h]) for h in self.hashes.tolist()]
        self.places = []
        for x in self.ids:
            at = defaultdict(list)
            for j, w in enumerate(x.tolist()):
                at[w].append(j)
            self.places.append(at)

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """One number for each run of k words, 0 where a word is outside the items' vocabulary. Exact while ids fit 63 / k bits."""
        n = len(ids) - self.k + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        base = np.int64(len(self.vocabulary) + 1)
        out, ok = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for s in range(self.k):
            out = out * base + ids[s : s + n]
            ok &= ids[s : s + n] > 0
        return np.where(ok, out, 0)

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shingles looked up, and which one each is."""
        keys = self.keys(ids)
        at = np.flatnonzero(keys)
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.hashes, keys[at]), len(self.hashes) - 1)
        hit = self.hashes[place] == keys[at]
        return at[hit], place[hit]

    def found(self, ids: np.ndarray, at: np.ndarray | None = None, place: np.ndarray | None = None) -> list[int]:
        """Item ids whose passage the document's word ids carry; at and place as ``candidates`` gives them."""
        if at is None:
            at, place = self.candidates(ids)
        keys = self.keys(ids).tolist()
        spots: dict[int, list[int]] = defaultdict(list)
        for i, p in zip(at.tolist(), place.tolist()):
            for n in self.postings[p]:
                # position and length: enough of the item's shingles must stand within a passage's reach of the hit
                known, here = self.sets[n], keys[max(0, i - self.passage - self.edits) : i + self.passage + self.edits]
                if sum(map(known.__contains__, here)) >= self.least:
                    spots[n].append(i)
        runs = [(n, self.best_run(n, ids, where)) for n, where in spots.items()]
        runs = sorted(((n, r) for n, r in runs if r[0] >= self.passage and r[1] >= 0.8 * r[0]), key=lambda x: (-x[1][1], x[0]))
        kept: list[tuple[int, tuple]] = []
        for n, (span, matched, skips, a, b) in runs:
            # items share phrases: a run with changed words belongs to the item that explains the same words better
            shared = any(min(b, d) - max(a, c) > (b - a) / 2 and matched < m for _, (_, m, _, c, d) in kept)
            if not (skips and shared):
                kept.append((n, (span, matched, skips, a, b)))
        return [self.items[n][0] for n, _ in kept]

    def best_run(self, n: int, ids: np.ndarray, where: list[int]) -> tuple[int, int, int, int, int]:
        """(item words spanned, words matched, skips, start and end in the text) of the longest run near the hits, or, if that has
        too many changed words, of the longest part of a run of at least ``passage`` words that has not.

        Alignment over matching words only: neighbours in a run are one word apart in both texts, or one of them or both skip
        one word; at most ``edits`` skips in any ``passage`` words of the item.
        """
        places, reach = self.places[n], self.passage * 2
        most = part = (0, 0, 0, 0, 0)
        spans: list[list[int]] = []
        for w in sorted(where):
            a, b = max(0, w - reach), min(len(ids), w + reach + self.k)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        for a, b in spans:
            # (text place, item place) -> words matched, -skips, start in the item, start in the text, places of the latest skips
            runs: dict[tuple[int, int], tuple[int, int, int, int, tuple[int, ...]]] = {}
            back: dict[tuple[int, int], tuple[int, int]] = {}
            for i in range(a, b):
                for j in places.get(int(ids[i]), ()) if ids[i] else ():
                    best = (1, 0, j, i, ())
                    for di, dj in ((1, 1), (2, 2), (1, 2), (2, 1)):
                        r = runs.get((i - di, j - dj))
                        if r is None:
                            continue
                        m, s, sj, si, late = r
                        if (di, dj) != (1, 1):
                            late = (*(x for x in late if x > j - self.passage), j)
                            s -= 1
                            if len(late) > self.edits:
                                continue
                        if (longer := (m + 1, s, sj, si, late)) > best:
                            best, back[i, j] = longer, (i - di, j - dj)
                    runs[i, j] = best
                    most = max(most, (j - best[2] + 1, best[0], -best[1], best[3], i))
            for end, r in runs.items():
                if end[1] - r[2] + 1 < self.passage or r[0] >= 0.8 * (end[1] - r[2] + 1) and part[0] >= end[1] - r[2] + 1:
                    continue
                at, matched, skips = end, 1, 0
                while True:
                    span = end[1] - at[1] + 1
                    if span >= self.passage and matched >= 0.8 * span:
                        part = max(part, (span, matched, skips, at[0], end[0]))
                    if at not in back:
                        break
                    before = back[at]
                    skips += (at[0] - before[0], at[1] - before[1]) != (1, 1)
                    at, matched = before, matched + 1
        return most if most[1] >= 0.8 * most[0] else part


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", question: str = "question",
    passage: int = 15, shingle: int = 3, edits: int = 3, block_words: int = 1_000_000,
) -> DataFrame:
    """``(doc_id, item_id)``, each once: documents that carry at least ``passage`` words in a row of an item's question.

    Layout, case, punctuation, accents and look-alike letters are folded; up to ``edits`` isolated words in any ``passage``
    words, and a fifth of the whole run, may be changed, added or lost. Stock instructions that open the questions do not count. Null and empty texts and
    questions shorter than ``passage`` words give nothing; null ids are ordinary ids. Items are taken in blocks of about
    ``block_words`` words (the bound on what the driver holds and a task is sent); every block meets every document.
    """
    known = checkpointed(item_words(items, item_id, question).where(F.col("n") >= passage))
    total = known.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // block_words))
    part = F.pmod(F.xxhash64(F.array_join("words", " ")), F.lit(count))
    d_type, i_type = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    source = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t IS NOT NULL AND length(t) > 0")
    spark = docs.sparkSession

    def scan(k: int) -> DataFrame:
        # one block at a time is held by the driver
        block = sorted(((r["i"], r["words"]) for r in known.where(part == k).select("i", "words").collect()), key=lambda x: (x[0] is None, x[0]))
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = LeakIndex(sent.value, passage, shingle, edits)
            known, gap = index.vocabulary.get, np.zeros(1, dtype=np.int64)
            for b in batches:
                for s in range(0, b.num_rows, 256):
                    some = b.slice(s, 256)
                    parts = []
                    for t in some.column("t").to_pylist():
                        words = words_of(t)
                        parts.append(np.fromiter(map(known, words, repeat(0)), dtype=np.int64, count=len(words)))
                        parts.append(gap)
                    starts = np.cumsum([0] + [len(p) for p in parts])[:-1:2]
                    where, place = index.candidates(np.concatenate(parts))
                    owner = np.searchsorted(starts, where, side="right") - 1
                    at, hits = [], []
                    for k in np.unique(owner).tolist():
                        mine = owner == k
                        for i in index.found(parts[2 * k], where[mine] - starts[k], place[mine]):
                            at.append(k)
                            hits.append(i)
                    if at:
                        yield pa.RecordBatch.from_pydict({doc_id: some.column("d").take(pa.array(at)), item_id: pa.array(hits)})

        return source.mapInArrow(run, f"`{doc_id}` {d_type}, `{item_id}` {i_type}")

    return reduce(DataFrame.unionByName, [scan(b) for b in range(count)]).distinct()
