"""Personal data inside free text: a linear-chain conditional random field over word-shape features.

The field is trained on a small labelled table by gradient ascent on the likelihood and decoded by Viterbi in numpy batches.
A run of labels whose gains cannot outweigh 'ordinary text' throughout is in no best path, so only the places that some run
with a possible gain holds are decoded: the result is that of decoding whole texts. What the field finds is then
held to the exact written form of its kind, which settles its ends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.pii_examples import KINDS, WORD_CLASSES, labelled_sentences

LABELS = ["", *KINDS]
TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]|_")
OFFSETS = (-5, -4, -3, -2, -1, 0, 1, 2, 3, 4)
PAIRS = ((-2, -1), (-1, 0), (0, 1), (1, 2))
_PAD = "\x00"
_CLASS = {w: f"<{name}>" for name, ws in WORD_CLASSES.items() for w in ws.split()}


def word_of(token: str) -> str:
    """The word as a feature: its class, if it is a listed one, else itself in lower case."""
    low = token.lower()
    return _CLASS.get(low, low)


def shape(token: str) -> str:
    c = token[0]
    if c.isdigit():
        return f"d{min(len(token), 8)}"
    if not c.isalpha():
        return token if token.isascii() else "p"
    if len(token) == 1:
        return "A" if c.isupper() else "a"
    if token.isupper():
        return "AA" if len(token) == 2 else "AAA"
    return ("Aa" if token[1:].islower() else "AaA") if c.isupper() else ("aa" if token.islower() else "aA")


class Field:
    """Weights of the field: one table of token types a window offset, pair tables of shapes, transitions."""

    def __init__(self, words: list[str], shapes: list[str]):
        self.words = {w: i for i, w in enumerate(words)}
        self.shapes = {s: i for i, s in enumerate(shapes)}
        n = len(LABELS)
        self.w_word = np.zeros((len(OFFSETS), len(words) + 1, n))
        self.w_shape = np.zeros((len(OFFSETS), len(shapes) + 1, n))
        self.w_pair = np.zeros((len(PAIRS), (len(shapes) + 1) ** 2, n))
        self.trans = np.zeros((n, n))

    def parameters(self):
        return [self.w_word, self.w_shape, self.w_pair, self.trans]

    def ids(self, token: str) -> tuple[int, int]:
        return self.words.get(word_of(token), len(self.words)), self.shapes.get(shape(token), len(self.shapes))


def train(sentences: list[list[tuple[str, str]]], rounds: int = 100, rate: float = 0.15, ridge: float = 2e-3, least: int = 30) -> Field:
    """Maximum likelihood with a ridge, by Adam on all sentences at once; forward-backward runs over all of them in step."""
    data = []
    for pieces in sentences:
        text = "".join(p for p, _ in pieces)
        mark = np.concatenate([np.full(len(p), LABELS.index(k)) for p, k in pieces if p])
        spans = [m.span() for m in TOKEN.finditer(text)]
        data.append((text, spans, np.array([mark[a] for a, _ in spans])))
    data.sort(key=lambda d: len(d[1]))
    counts = Counter(word_of(text[a:b]) for text, spans, y in data for (a, b), k in zip(spans, y) if text[a].isalpha())
    inside = Counter(word_of(text[a:b]) for text, spans, y in data for (a, b), k in zip(spans, y) if k in (2, 3, 5) or k == 1)
    # a word of few patterns tells of them, not of the language
    words = sorted(w for w, n in counts.items() if w[0] == "<" or n >= least and (len(w) == 1 or inside[w] < 0.5 * n or w in ("at", "dot", "x", "ext")))
    shapes = sorted({shape(text[a:b]) for text, spans, _ in data for a, b in spans} | {_PAD})
    field = Field([*words, _PAD], shapes)
    n, longest, reach = len(data), max(len(d[1]) for d in data), 5
    w = np.full((n, longest + 2 * reach), field.ids(_PAD)[0])
    s = np.full((n, longest + 2 * reach), field.ids(_PAD)[1])
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (text, spans, labels) in enumerate(data):
        m = len(spans)
        w[i, reach : reach + m], s[i, reach : reach + m] = zip(*(field.ids(text[a:b]) for a, b in spans))
        y[i, :m], mask[i, :m] = labels, True
    size, k = len(field.shapes) + 1, len(LABELS)
    columns = [w[:, reach + o : reach + o + longest][mask] for o in OFFSETS]
    forms = [s[:, reach + o : reach + o + longest][mask] for o in OFFSETS]
    pairs = [(s[:, reach + a : reach + a + longest] * size + s[:, reach + b : reach + b + longest])[mask] for a, b in PAIRS]
    gold = y[mask]
    steps = [np.zeros_like(p) for p in field.parameters()], [np.zeros_like(p) for p in field.parameters()]

    def scatter(rows: np.ndarray, values: np.ndarray, height: int) -> np.ndarray:
        return np.stack([np.bincount(rows, values[:, c], height) for c in range(k)], axis=1)

    ends = mask.sum(axis=1) - 1
    for step in range(1, rounds + 1):
        e = np.zeros((n, longest, k))
        flat = np.zeros((len(gold), k))
        for o in range(len(OFFSETS)):
            flat = flat + field.w_word[o][columns[o]] + field.w_shape[o][forms[o]]
        for p in range(len(PAIRS)):
            flat = flat + field.w_pair[p][pairs[p]]
        e[mask] = flat
        trans = field.trans
        top = trans.max()
        kernel = np.exp(trans - top)
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            m = alpha[:, t - 1].max(axis=1, keepdims=True)
            alpha[:, t] = np.log(np.exp(alpha[:, t - 1] - m) @ kernel + 1e-300) + m + top + e[:, t]
        z = np.take_along_axis(alpha, ends[:, None, None], axis=1)[:, 0]
        logz = np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1)
        pair_sum = np.zeros((k, k))
        for t in range(longest - 2, -1, -1):
            on = (t < ends)[:, None]
            v = e[:, t + 1] + beta[:, t + 1]
            m = v.max(axis=1, keepdims=True)
            beta[:, t] = np.where(on, np.log(np.exp(v - m) @ kernel.T + 1e-300) + m + top, 0.0)
            live = t < ends
            joint = np.exp(alpha[live, t][:, :, None] + trans + v[live][:, None, :] - logz[live][:, None, None])
            pair_sum += joint.sum(axis=0)
        marginal = np.exp(alpha + beta - logz[:, None, None])[mask]
        marginal[np.arange(len(gold)), gold] -= 1
        miss = -marginal
        seen = np.zeros((k, k))
        both = mask[:, 1:]
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        grads = [
            np.stack([scatter(c, miss, len(field.words) + 1) for c in columns]),
            np.stack([scatter(c, miss, size) for c in forms]),
            np.stack([scatter(c, miss, size * size) for c in pairs]),
            seen - pair_sum,
        ]
        for p, grad, m1, m2 in zip(field.parameters(), grads, *steps):
            grad = grad / n - ridge * p
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            p += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    for p in field.parameters():
        p[...] = np.round(p, 4)
    return field


@lru_cache(maxsize=1)
def trained_field() -> Field:
    return train(labelled_sentences())


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of a batch of equally long runs, (runs, length, labels) -> (runs, length). Runs are flanked by ordinary text."""
    n, length, k = e.shape
    score = e[:, 0] + trans[0]
    back = np.zeros((n, length, k), dtype=np.int8)
    for t in range(1, length):
        options = score[:, :, None] + trans
        back[:, t] = options.argmax(axis=1)
        score = options.max(axis=1) + e[:, t]
    out = np.zeros((n, length), dtype=np.int8)
    out[:, -1] = (score + trans[:, 0]).argmax(axis=1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


class Decoder:
    def __init__(self, field: Field):
        self.f = field
        t = field.trans.astype(np.float32)
        self.trans = t
        #: most that a transition within, into and out of a run of other labels gains over ordinary text throughout
        self.within = float(t[1:, 1:].max() - t[0, 0])
        self.ends = float(t[0, 1:].max() + t[1:, 0].max() - 2 * t[0, 0])
        self.known: dict[str, int] = {}
        self.ids: dict[tuple[int, int], int] = {}
        #: scores of each (word, shape) met, one table a window offset
        self.tables = np.zeros((len(OFFSETS), 4096, len(LABELS)), np.float32)
        self.forms = np.zeros(4096, np.int32)
        self.pairs = field.w_pair.astype(np.float32)
        self.pad = self.type_of(_PAD)

    def type_of(self, token: str) -> int:
        n = self.known.get(token)
        if n is None:
            pair = self.f.ids(token)
            n = self.ids.get(pair)
            if n is None:
                n = self.ids[pair] = len(self.ids)
                if n >= len(self.forms):
                    self.tables = np.concatenate([self.tables, np.zeros_like(self.tables)], axis=1)
                    self.forms = np.concatenate([self.forms, np.zeros_like(self.forms)])
                self.tables[:, n] = self.f.w_word[:, pair[0]] + self.f.w_shape[:, pair[1]]
                self.forms[n] = pair[1]
            self.known[token] = n
        return n

    def labels(self, types: np.ndarray) -> np.ndarray:
        """Labels of one flat run of token types; texts in it are set apart by padding of the window's width."""
        s = self.forms[types]
        size = len(self.f.shapes) + 1
        reach, n = 5, len(types)
        out = np.zeros(n, dtype=np.int8)
        lo, hi = reach, n - reach
        if hi <= lo:
            return out
        e = np.zeros((hi - lo, len(LABELS)), np.float32)
        for o, off in enumerate(OFFSETS):
            e += self.tables[o].take(types[lo + off : hi + off], axis=0)
        for p, (a, b) in enumerate(PAIRS):
            e += self.pairs[p].take(s[lo + a : hi + a] * size + s[lo + b : hi + b], axis=0)
        live = self.open_places(e, types[lo:hi] == self.pad)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], live.view(np.int8), [0]])))
        starts, stops = edges[::2], edges[1::2]
        lengths = stops - starts
        for length in np.unique(lengths):
            at = starts[lengths == length]
            got = viterbi(e[at[:, None] + np.arange(length)], self.trans)
            out[(at[:, None] + np.arange(length)) + lo] = got
        return out

    def open_places(self, e: np.ndarray, pad: np.ndarray) -> np.ndarray:
        """Places that may have a label in the best path: those within a run whose gain over ordinary text can be positive.

        The best run through a place is the largest sum of gains over an interval that holds it, from running sums.
        """
        gain = np.where(pad, -1e6, (e[:, 1:].max(axis=1) - e[:, 0]).astype(np.float64) + self.within)
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        before = np.minimum.accumulate(sums[:-1])
        after = np.maximum.accumulate(sums[:0:-1])[::-1]
        return (after - before + self.ends - self.within >= -1e-3) & ~pad


_AT = r"(?:@|\s*[\(\[{]\s*(?:at|AT)\s*[\)\]}]\s*|\s+(?:at|AT)\s+)"
_DOT = r"(?:\.|\s*[\(\[{]\s*(?:dot|DOT)\s*[\)\]}]\s*|\s+(?:dot|DOT)\s+)"
_STREET_WORD = r"(?:Street|St|Road|Rd|Lane|Ln|Ave|Avenue|Drive|Dr|Way|Blvd|Boulevard|Court|Ct|Place|Pl|Terrace|Square|Highway|Hwy)"
_NAME = r"[^\W\d_a-z][^\W\d_]*(?:['’-][^\W\d_]+)*"
_INITIAL = r"[^\W\d_a-z]\."
#: The exact written form of each kind; the field decides where, these decide from which character to which.
FORMS = {
    "email": re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?|\d{1,5}[\s.-])?(?:\d{2,4}[\s.-])?\d{2,4}[\s.-]?\d{3,6}(?:\s*(?:x|ext\.?|extension)\s*\d{1,5})?(?!\w)"),
    "id_number": re.compile(r"(?<![\w-])(?:[A-Z]{1,2}-?)?\d+(?:[\s/-]\d+)*(?![\w])"),
    "person": re.compile(rf"{_NAME},\s{_NAME}(?:\s{_INITIAL})?|(?:{_NAME}|{_INITIAL})(?:\s(?:{_NAME}|{_INITIAL}))*\s{_NAME}|{_INITIAL}\s?{_NAME}"),
    "address": re.compile(r"\w.*\w", re.S),
}
_TITLE = re.compile(r"^(?:(?:Dr|Prof|Professor|Mr|Mrs|Ms|Miss|Herr|Frau|Sr|Sra|Mme)\.?\s+)+")


#: A house or unit number that stands before a street the field has found.
_HOUSE = re.compile(r"(?<!\w)(?:(?:[Uu]nit|[Ss]uite|[Aa]pt\.?|[Ff]lat)\s+\w{1,4},?\s+)?\d{1,5}[A-Za-z]?(?:[/-]\d{1,4}[A-Za-z]?)?,?\s+\Z")


def exact_span(text: str, kind: str, a: int, b: int) -> tuple[int, int] | None:
    """Where the entity that the field found at a..b begins and ends, held to the form of its kind; None if it hasn't that form."""
    if kind == "address":
        while a < b and text[a] in " \t\n.,;:()<>[]":
            a += 1
        while a < b and text[b - 1] in " \t\n.,;:()<>[]":
            b -= 1
        if a < b and text[a].isalpha() and (m := _HOUSE.search(text[max(0, a - 30) : a])):
            a -= len(m[0])
        part = text[a:b]
        return (a, b) if re.search(r"\d", part) and re.search(r"[^\W\d_]", part) else None
    lo, hi = max(0, a - (40 if kind == "email" else 6)), min(len(text), b + (40 if kind == "email" else 8))
    if kind == "person":
        lo, hi = a, b
    best = None
    for m in FORMS[kind].finditer(text, lo, hi):
        overlap = min(b, m.end()) - max(a, m.start())
        if overlap > 0 and (best is None or overlap > best[0]):
            best = (overlap, m.start(), m.end())
    if best is None:
        return None
    a, b = best[1:]
    if kind == "person":
        a += len(m[0]) if (m := _TITLE.match(text[a:b])) else 0
        return (a, b) if len(re.findall(r"[^\W\d_]+", text[a:b])) >= 2 else None
    digits = len(re.findall(r"\d", text[a:b]))
    if kind == "phone" and not 7 <= digits <= 17 or kind == "id_number" and digits < 5:
        return None
    return a, b


def spans_of(labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, stop, label) of the runs of one label other than 0."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], labels.astype(np.int16), [0]])))
    for a, b in zip(edges[:-1], edges[1:]):
        if labels[a]:
            yield int(a), int(b), int(labels[a])


def entities(texts: list[str], decoder: Decoder) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each entity of each text, in order; none overlaps another, of two that would the earlier stays."""
    pad = [decoder.pad] * 5
    types, starts = list(pad), []
    known, type_of = decoder.known.get, decoder.type_of
    for text in texts:
        starts.append(len(types))
        tokens = TOKEN.findall(text)
        own = list(map(known, tokens))
        if None in own:
            own = list(map(type_of, tokens))
        types += own
        types += pad
    labels = decoder.labels(np.array(types))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    first = np.array(starts)
    last, spans = -1, []
    for a, b, k in spans_of(labels):
        i = int(np.searchsorted(first, a, side="right")) - 1
        if i != last:
            last, spans = i, [m.span() for m in TOKEN.finditer(texts[i])]
        at, to = spans[a - starts[i]][0], spans[b - starts[i] - 1][1]
        span = exact_span(texts[i], LABELS[k], at, to)
        if span and (not out[i] or span[0] >= out[i][-1][2]):
            out[i].append((LABELS[k], *span))
    return out


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kind, surface)``: personal data of each text, each surface once a document.

    kind: 'email', 'phone', 'id_number', 'address' or 'person'. Null and empty texts give no row; texts are read whole. The
    field is trained on the driver from the labelled table (about a thousand sentences) and sent to the tasks (under 1 MB).
    """
    field = docs.sparkSession.sparkContext.broadcast(trained_field())
    id_type = dict(docs.dtypes)[doc_id]
    source = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t IS NOT NULL AND length(t) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field.value)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                some = b.slice(s, 256)
                if len(decoder.known) > 500_000:
                    decoder = Decoder(field.value)
                at, kinds, surfaces = [], [], []
                texts = some.column("t").to_pylist()
                for i, found in enumerate(entities(texts, decoder)):
                    for kind, surface in dict.fromkeys((k, texts[i][lo:hi]) for k, lo, hi in found):
                        at.append(i)
                        kinds.append(kind)
                        surfaces.append(surface)
                yield pa.RecordBatch.from_pydict(
                    {doc_id: some.column("d").take(pa.array(at, pa.int64())), "kind": pa.array(kinds, pa.string()), "surface": pa.array(surfaces, pa.string())}
                )

    return source.mapInArrow(run, f"`{doc_id}` {id_type}, kind string, surface string")


def redacted(texts: list[str | None], decoder: Decoder) -> list[str | None]:
    """The texts with typed placeholders such as [EMAIL] where their personal data stood; null and empty texts stay as they are."""
    out = list(texts)
    filled = [i for i, t in enumerate(texts) if t]
    for i, found in zip(filled, entities([texts[i] for i in filled], decoder) if filled else ()):
        parts, at = [], 0
        for kind, lo, hi in found:
            parts += [texts[i][at:lo], f"[{kind.upper()}]"]
            at = hi
        out[i] = "".join([*parts, texts[i][at:]])
    return out


def redact_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced in its place by typed placeholders; every row and other column stays."""
    field = docs.sparkSession.sparkContext.broadcast(trained_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field.value)
        for b in batches:
            i = b.schema.get_field_index(text)
            for s in range(0, b.num_rows, 256):
                some = b.slice(s, 256)
                if len(decoder.known) > 500_000:
                    decoder = Decoder(field.value)
                yield some.set_column(i, b.schema.field(i), pa.array(redacted(some.column(i).to_pylist(), decoder), b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
