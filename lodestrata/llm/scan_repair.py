"""Text of scanned pages repaired into continuous paragraphs.

Lines are labelled by a hidden Markov model over layout features (shape, length against the page's own width, ends, markup,
repetition within the paper, neighbours), trained on a small table of labelled pages written out by rule. Body lines are then
joined across page furniture; words split by the layout are mended and misread words corrected with word counts of the whole
corpus: a join or a correction must be better attested than what stands in the text.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import broadcast_if_small, checkpointed, lookup

STATES = ["body", "furniture", "break", "title", "cell"]
_PROSE_WORDS = {"the", "of", "and", "in", "to", "by", "is", "at", "from", "with", "was", "under", "for", "are", "between", "that", "between", "along", "during", "below", "toward"}
_SECTIONS = {"introduction", "abstract", "results", "discussion", "methods", "conclusions", "conclusion", "setting", "references", "acknowledgements", "geology", "samples", "background", "summary", "appendix"}
_ROMAN = re.compile(r"[ivxlc]{1,6}\Z", re.I)
_MARKS = "-‐­¬"
_STRIP = ".,;:()[]{}\"'!?“”‘’*#"


def bare(line: str) -> str:
    """The line without form feeds, heading and emphasis marks."""
    return re.sub(r"^[\s#*_\x0c]+|[\s*_]+$", "", line)


_NUMBERS, _LETTERS, _SPACE = re.compile(r"\d+"), re.compile(r"[^\W\d_]+"), re.compile(r"\s")
_BARE = re.compile(r"^[\s#*_\x0c]+|[\s*_]+$")
_CAPTION = re.compile(r"(?:table|figure|fig\.|plate)\s*\d+", re.I)
_PLAIN_NUMBER = re.compile(r"[\d.,]+")
_PAGE = re.compile(r"[-–—]\s*\d+\s*[-–—]|(?:page|p\.)\s*\d+(?:\s*(?:of|/)\s*\d+)?", re.I)
_LEGAL = re.compile(r"https?:|www\.|©|copyright|downloaded|all rights|doi:", re.I)
_GARBAGE = re.compile(r"[\[\]|\\/^~*&=#_{}<>]")
_NUMBERED = re.compile(r"(?:\||,)\s*\d+$|\s\d{1,4}$")
_COUNT = re.compile(r"n\s*=\s*(\d+)")


def features(lines: list[str]) -> np.ndarray:
    """Categorical layout features of each line of one text, (lines, FEATURES)."""
    plain = [_BARE.sub("", x) for x in lines]
    masked = [_NUMBERS.sub("9", p) for p in plain]
    seen = Counter(m for m in masked if m)
    widths = sorted(n for n in map(len, plain) if n > 20)
    width = max(30, widths[(len(widths) * 3) // 4] if widths else 60)
    left = 0
    out = []
    prose_before = False  # has the line before a word of running text?
    last = len(lines) - 1
    for i, (line, p, m) in enumerate(zip(lines, plain, masked)):
        if not p:
            # a blank line is one by its form alone
            out.append((0, 5, 0, 0, 1 if "\x0c" in line else 2 if line.startswith("##") else 3 if line.startswith("#") else 4 if line.startswith("**") else 0, 1, int(i == 0 or not plain[i - 1]) * 2 + int(i == last or not plain[i + 1]), 0, 0))
            prose_before = False
            continue
        words = _LETTERS.findall(p)
        lower = [w.lower() for w in words]
        prose = not _PROSE_WORDS.isdisjoint(lower)
        letters = sum(map(len, words))
        caps = sum(w.isupper() or ("l" in w and len(w) > 3 and w.replace("l", "I").isupper()) for w in words)
        small = sum(w.islower() and len(w) > 2 for w in words)
        before = plain[i - 1] if i else ""
        tail = prose_before and p.endswith((".", ".)")) and before[-1:] not in ".!?" and len(before) > 0.5 * width
        caption = _CAPTION.match(p)
        if p.startswith("!["):
            form = 1
        elif caption:
            form = 2
        elif tail and not caps:
            form = 11
        elif _PLAIN_NUMBER.fullmatch(p):
            form = 3
        elif _ROMAN.match(p):
            form = 4
        elif _PAGE.fullmatch(p):
            form = 5
        elif _LEGAL.search(p):
            form = 6
        elif p[0] == "|" or small > 2 and p.count("|") > 2:
            form = 7
        elif small < 1 and letters < 0.45 * len(_SPACE.sub("", p)) and not _NUMBERS.search(p) or small == 0 and len(parts := p.split()) >= 3 and max(map(len, parts)) <= 3:
            form = 8
        elif small <= 1 and not prose and len(_GARBAGE.findall(p)) >= 2:
            form = 8
        elif caps and letters > 4 and caps >= 0.7 * len(words):
            form = 9
        elif 2 <= len(words) <= 6 and p[-1].isdigit() and sum(w[0].isupper() for w in words) >= 0.6 * len(words):
            form = 10
        elif small == 0 and len(words) <= 2 or not prose and len(words) <= 6 and _NUMBERED.search(p):
            form = 10
        elif prose or small >= 3:
            form = 11
        else:
            form = 12
        if caption and (n := _COUNT.search(p)):
            left = int(n[1])
            in_table = 1
        elif left and form == 3:
            left -= 1
            in_table = 2
        else:
            in_table = 0
            if form in (2, 7, 11):
                left = 0
        first, end = p[0], p[-1]
        repeats = seen[m] if form in (3, 4, 5, 6, 9, 10, 12) or len(p) < 0.7 * width and end.isalnum() else 1
        out.append(
            (
                form,
                min(4, int(5 * len(p) / width)),
                1 if end in ".!?" else 2 if end in ",;:" else 3 if end in _MARKS else 4 if end.isdigit() else 5,
                1 if first.islower() else 2 if first.isupper() else 3 if first.isdigit() else 4,
                1 if "\x0c" in line else 2 if line.startswith("##") else 3 if line.startswith("#") else 4 if line.startswith("**") else 0,
                min(repeats, 3),
                int(i == 0 or not plain[i - 1]) * 2 + int(i == last or not plain[i + 1]),
                in_table,
                int(0 < len(lower) <= 4 and not _SECTIONS.isdisjoint(lower)),
            )
        )
        prose_before = prose or not _PROSE_WORDS.isdisjoint(p.lower().split())
    return np.array(out, dtype=np.int64).reshape(-1, 9)


SIZES = (13, 6, 6, 5, 5, 4, 4, 3, 2)


def labelled_pages(papers: int = 160, seed: int = 11) -> list[list[tuple[str, str]]]:
    """Pages written out by rule with a label a line: the small labelled table of the model (``papers`` papers is its bound)."""
    r = random.Random(seed)
    bits = "ba dor fen gra hol lin mar nor pel qui ros sta tor ul ven wes".split()
    word = lambda: "".join(r.choice(bits) for _ in range(r.randint(2, 4)))
    common = "the of in and by with along from shows cuts hosts veins under ore late grains fills values zoned at under is are were was during below".split()
    name = lambda: word().capitalize()

    def prose(n: int) -> str:
        out = []
        for _ in range(n):
            s = [r.choice(common) if r.random() < 0.45 else word() for _ in range(r.randint(6, 14))]
            s[0] = s[0].capitalize()
            for k in range(1, len(s)):
                x = r.random()
                s[k] = name() if x < 0.08 else str(r.randint(1, 4000)) if x < 0.14 else f"{r.randint(1, 90)}.{r.randint(0, 9)} %" if x < 0.17 else s[k]
            out.append(" ".join(s) + ".")
        return " ".join(out)

    pages = []
    for _ in range(papers):
        marked = r.random() < 0.4
        fragment = not marked and r.random() < 0.3
        width = r.randint(52, 80)
        journal = r.choice([f"{name()} {name()} {r.randint(1, 90)}", f"{name()} of {name()} {name()} {r.randint(1, 90)}", f"J. {name()} {name()} {r.randint(1, 90)}"]) if r.random() < 0.7 else f"{word().upper()} BULLETIN {r.randint(1, 90)}"
        lead, tail = r.choice(["\x0c", ""]), r.choice(["", " ET AL.", f" AND {word().upper()}"])
        heads = [lambda: journal, lambda: f"{journal} | {r.randint(1, 900)}", lambda: f"{word().upper()} IN {word().upper()} FROM {word().upper()}", lambda: f"{word().upper()} AND {word().upper()}   {r.randint(1, 900)}", lambda: f"{word().upper()} ET AL.", lambda: f"{word().upper()} ET AL.   {r.randint(1, 900)}", lambda: f"{r.randint(1, 900)}   {word().upper()} IN {word().upper()} FROM {word().upper()}", lambda: f"{lead}{journal}, {word().upper()}{tail}"]
        feet = [lambda: str(r.randint(1, 900)), lambda: f"- {r.randint(1, 900)} -", lambda: f"-{r.randint(1, 900)}-", lambda: f"Page {r.randint(1, 20)} of 20", lambda: f"Page {r.randint(1, 900)}", lambda: r.choice(["i", "ii", "iii", "iv", "v", "vi", "ix"]), lambda: f"Downloaded by guest on {r.randint(1, 28)} May {r.randint(1990, 2022)}", lambda: f"© {r.randint(1980, 2022)} {name()} Press"]
        noise = lambda: " ".join("".join(r.choice("oIlW^|[]~\\/=DTAMN_*&#}1") for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 8)))
        head, foot = r.choice(heads), r.choice(feet)
        rows: list[tuple[str, str]] = []

        def furniture():
            for f in r.sample([head, foot, r.choice(feet), noise], r.choice([1, 1, 2, 2, 3])):
                line = f()
                if marked and r.random() < 0.4:
                    line = "# " + line if r.random() < 0.5 else f"**{line}**"
                rows.append((line, "furniture"))
                if r.random() < 0.12:
                    rows.append((r.choice(["", " "]), "break"))

        if r.random() < (0.5 if fragment else 0.2):
            furniture()
        for _ in range(1 if fragment else r.randint(2, 5)):
            if not fragment:
                title = r.choice(["INTRODUCTION", "Results", "Geological setting", "SAMPLES AND METHODS", "DISCUSSION", "Conclusions", "REFERENCES", "Abstract"])
                rows += [("## " + title if marked else title + r.choice(["", " "]), "title"), ("", "break")]
            for _ in range(r.randint(1, 3)):
                text = prose(r.randint(1, 6))
                lines, at = [], ""
                for w in text.split(" "):
                    if not marked and len(at) + len(w) > width:
                        if len(w) > 6 and r.random() < 0.3:
                            lines.append(at + w[:4] + r.choice(_MARKS))
                            at = w[4:] + " "
                            continue
                        lines.append(at.rstrip() + r.choice(["", "", " "]))
                        at = ""
                    at += w + " "
                lines.append(at.strip())
                for k, line in enumerate(lines):
                    rows.append((line, "body"))
                    if k + 1 < len(lines) and r.random() < 0.06:
                        furniture()
                        if r.random() < 0.5:
                            rows.append(("", "break"))
                if r.random() < 0.85:
                    rows.append((r.choice(["", "", " "]), "break"))
                if r.random() < 0.15:
                    furniture()
            x = r.random()
            if x < 0.25 and not fragment:
                n = r.randint(3, 6)
                rows.append((("## " if marked else "") + f"Table {r.randint(1, 6)}. Spot results, n = {n}", "cell"))
                rows += [(str(r.randint(20, 400)) + r.choice(["", " "]), "cell") for _ in range(n)] + [("", "break")]
            elif x < 0.4 and marked:
                rows += [("![](_page_0_Figure_1.jpeg)", "title"), ("", "break")]
        if r.random() < 0.4:
            furniture()
        pages.append(rows)
    return pages


class LineModel:
    """First-order hidden Markov model; emissions are products of the features' smoothed frequencies."""

    def __init__(self, pages: list[list[tuple[str, str]]], smooth: float = 0.3):
        k = len(STATES)
        first, move = np.full(k, 1.0), np.full((k, k), 0.5)
        emit = [np.full((n, k), smooth) for n in SIZES]
        for page in pages:
            x = features([line for line, _ in page])
            y = np.array([STATES.index(s) for _, s in page])
            first[y[0]] += 1
            np.add.at(move, (y[:-1], y[1:]), 1)
            for f, table in enumerate(emit):
                np.add.at(table, (x[:, f], y), 1)
        self.first = np.log(first / first.sum())
        self.move = np.log(move / move.sum(axis=1, keepdims=True))
        self.emit = [np.log(t / t.sum(axis=0)) for t in emit]

    def label(self, lines: list[str]) -> list[int]:
        x = features(lines)
        e = sum(t[x[:, f]] for f, t in enumerate(self.emit))
        e[x[:, 0] == 0] = -1e6
        e[x[:, 0] == 0, STATES.index("break")] = 0.0
        n = len(lines)
        back = np.zeros((n, len(STATES)), dtype=np.int8)
        score = self.first + e[0]
        for t in range(1, n):
            options = score[:, None] + self.move
            back[t] = options.argmax(axis=0)
            score = options.max(axis=0) + e[t]
        out = [int(score.argmax())]
        for t in range(n - 1, 0, -1):
            out.append(int(back[t, out[-1]]))
        return out[::-1]


@lru_cache(maxsize=1)
def line_model() -> LineModel:
    return LineModel(labelled_pages())


_NUMBER_LIKE = re.compile(r"(?=.*\d)(?=.*[OoQlI|ZSB])[\dOoQlI|ZSB]+(?:[.,][\dOoQlI|ZSB]+)*\Z")
_TO_DIGIT = str.maketrans("OoQlI|ZSB", "000111258")


def read_number(token: str) -> str | None:
    """The number that a token with misread digits stands for; None if it is none or has no misread digit."""
    if _NUMBER_LIKE.match(token) and not re.match(r"[A-Z]{2}|[OSI]\d\Z", token):
        return token.translate(_TO_DIGIT)
    return None


#: Letters and what scanning reads in their place.
_CONFUSED = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("@", "a"), ("8", "b"), ("6", "b"), ("3", "e"), ("$", "s"), ("|", "l"), ("!", "l"), ("4", "a"), ("7", "t"),
    ("l", "i"), ("i", "l"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"),
    ("ii", "u"), ("u", "ii"), ("n", "ri"), ("ri", "n"), ("m", "in"), ("in", "m"), ("li", "h"), ("h", "li"), ("n", "u"), ("u", "n"), ("o", "c"), ("c", "o"), ("a", "o"), ("o", "a"), ("q", "g"), ("g", "q"), ("y", "v"), ("v", "y"),
]
_SYMBOL = re.compile(r"[0-9@$|!]")


def variants(word: str) -> dict[str, int]:
    """What a lower-cased word may stand for, with the number of places changed: every reading of its digits and symbols, then one confusion of letters."""
    starts = {word: 0}
    symbols = _SYMBOL.findall(word)
    if symbols:
        options = [("", 0)]
        for c in word:
            reads = [b for a, b in _CONFUSED if a == c] if _SYMBOL.match(c) else [c]
            options = [(o + x, n + (x != c)) for o, n in options for x in (reads or [c])]
        starts = {o: n for o, n in options if not _SYMBOL.search(o)}
    out = {w: n for w, n in starts.items() if w != word}
    for w, n in list(starts.items()):
        for a, b in _CONFUSED:
            i = w.find(a)
            while i >= 0:
                out.setdefault(w[:i] + b + w[i + len(a) :], n + 1)
                i = w.find(a, i + 1)
    out.pop(word, None)
    return out


def is_long(word: str) -> bool:
    """Words whose variants are better not written out: long ones, and those with many a 1, which is read in two ways."""
    return len(word) > 40 or word.count("1") > 5


_FOLD = str.maketrans({**{a: b for a, b in _CONFUSED if _SYMBOL.match(a)}, "1": "l", "i": "l"})
_LETTER_PAIRS = sorted({(a.translate(_FOLD), b.translate(_FOLD)) for a, b in _CONFUSED if not _SYMBOL.search(a)} - {("l", "l")})
_B, _M = 0x9E3779B97F4A7C15, (1 << 64) - 1


def folded_keys(word: str, changed: bool) -> list[int]:
    """Hashes of the word with its symbols read and i as l, and if asked of all it becomes by one more confusion of letters.

    Each is made from running sums in one step, so that a word of n letters takes n steps a confusion and 8 bytes a variant.
    """
    w = word.translate(_FOLD)
    power, sums = [1], [0]
    for c in w:
        sums.append((sums[-1] + ord(c) * power[-1]) & _M)
        power.append(power[-1] * _B & _M)
    out = {sums[-1]}
    for a, b in _LETTER_PAIRS if changed else ():
        value = sum(ord(c) * pow(_B, k, 1 << 64) for k, c in enumerate(b))
        shift = pow(_B, len(b) - len(a), 1 << 64)
        i = w.find(a)
        while i >= 0:
            out.add((sums[i] + value * power[i] + (sums[-1] - sums[i + len(a)]) * shift) & _M)
            i = w.find(a, i + 1)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def folded_changes(word: str, other: str) -> int:
    """Places changed from a word to another by reading its symbols and at most one confusion of letters, i and l taken for one; -1 if more differs."""
    w, v = word.translate(_FOLD), other.translate(_FOLD)
    symbols = len(_SYMBOL.findall(word))
    if w == v:
        return max(1, symbols)
    p = next((k for k, (x, y) in enumerate(zip(w, v)) if x != y), min(len(w), len(v)))
    near = any(w[i : i + len(a)] == a and w[:i] + b + w[i + len(a) :] == v for i in range(max(0, p - 2), p + 1) for a, b in _LETTER_PAIRS)
    return symbols + 1 if near else -1


def recase(token: str, fixed: str, opens: bool) -> str:
    """The fixed word in the case of the token; a misread first character is a capital at the start of a sentence."""
    letters = [c for c in token if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() or c == "l" for c in letters) and any(c.isupper() for c in letters):
        return fixed.upper()
    if token[0].isupper() or opens and token[0] in "0159@$|!l3846":
        return fixed[0].upper() + fixed[1:]
    return fixed


def walk(text: str, model: LineModel) -> tuple[list[str], list[tuple[int, int, str, str | None, bool]]]:
    """The state of each line, and the running text: (line from 0, paragraph from 1, token, second half if the layout split it, opens a sentence).

    A paragraph goes on over furniture, but where blank lines stand there too and a sentence has ended, and over blank lines within a
    sentence whose next word is lower-case; a word split in two holds it together anyway.
    """
    lines = text.split("\n")
    states = [STATES[s] for s in model.label(lines)]
    found: list[tuple[int, int, str, str | None, bool]] = []
    body = [i for i, s in enumerate(states) if s == "body"]
    carried, opens, paragraph = None, True, 1  # carried: second half of a word split at the end of the line before
    for k, i in enumerate(body):
        tokens = lines[i].split()
        gap = set(states[body[k - 1] + 1 : i]) if k else set()
        if carried is not None:
            tokens = tokens[1:]
            carried = None
        else:
            if gap & {"title", "cell"} or "break" in gap and (opens or "furniture" not in gap and not tokens[0].lstrip(_STRIP)[:1].islower()):
                paragraph += 1
            if k == 0 or gap & {"break", "title", "cell"} and "furniture" not in gap:
                opens = True
        follows = lines[body[k + 1]].split() if k + 1 < len(body) else []
        j = 0
        while j < len(tokens):
            t = tokens[j]
            at_end = j + 1 == len(tokens)
            right = (follows[0] if follows else None) if at_end else tokens[j + 1]
            if len(t) > 1 and (t[-1] in _MARKS or t[-1] == "–" and at_end) and t[-2].isalpha() and right and right[0].isalpha() and not any(c.isdigit() for c in t):
                first, second = t[:-1].lstrip(_STRIP), right.strip(_STRIP)
                if second.lower() not in ("and", "or", "to") and first:
                    found.append((i, paragraph, t, right, opens))
                    opens = right.rstrip(")\"'")[-1:] in (".", "!", "?")
                    if at_end:
                        carried = second
                    j += 1 if at_end else 2
                    continue
            found.append((i, paragraph, t, None, opens))
            opens = t.rstrip(")\"'")[-1:] in (".", "!", "?")
            j += 1
    return states, found


def halves_of(token: str, right: str) -> tuple[str, str]:
    """Both halves of a split word without the punctuation around it, the first with its mark."""
    return token[:-1].lstrip(_STRIP) + token[-1], right.strip(_STRIP)


def read_text(text: str, model: LineModel) -> list[tuple[int, str, list[tuple[str, bool]], list[tuple[str, str]]]]:
    """Per line (number from 1, state, words with 'opens a sentence', words split here as (first half, second half))."""
    states, found = walk(text, model)
    out = [(i + 1, s, [], []) for i, s in enumerate(states)]
    for i, _, t, right, opens in found:
        if right is not None:
            out[i][3].append(halves_of(t, right))
        elif w := t.strip(_STRIP):
            out[i][2].append((w, opens))
    return out


def mended(text: str, model: LineModel, fixes: dict[tuple[str, bool], str], joins: dict[tuple[str, str], str]) -> list[str]:
    """The paragraphs of a text, ``fixes`` of (word, opens) and ``joins`` of (first, second half) put in their places."""
    out: dict[int, list[str]] = {}
    for _, paragraph, t, right, opens in walk(text, model)[1]:
        if right is not None:
            both = halves_of(t, right)
            t = t[: len(t) - len(t.lstrip(_STRIP))] + joins.get(both, "".join(both)) + right[len(right.rstrip(_STRIP)) :]
        elif (w := t.strip(_STRIP)) and (fixed := fixes.get((w, opens))):
            t = t.replace(w, fixed, 1)
        out.setdefault(paragraph, []).append(t)
    return [" ".join(p) for p in out.values()]


def paper_texts(papers: DataFrame) -> DataFrame:
    """``(content_id, field, pos, text, h)`` of every text of every paper, h a key of all four; null texts and null paragraphs are left out."""
    one = lambda f: papers.select("content_id", F.lit(f).alias("field"), F.lit(0).alias("pos"), F.col(f).alias("text"))
    paragraphs = papers.select("content_id", F.posexplode("relevant_paragraphs").alias("p", "x")).select(
        "content_id", F.lit("paragraph").alias("field"), (F.col("p") + 1).cast("int").alias("pos"), F.col("x.paragraph").alias("text")
    )
    texts = one("full_text").unionByName(one("marker_markdown")).unionByName(paragraphs).where("text IS NOT NULL AND text != ''")
    return texts.withColumn("h", F.sha2(F.to_json(F.struct("content_id", "field", "pos", "text")), 256))


_LINES = "h string, content_id bigint, field string, pos int, line_no int, state string, words array<struct<w:string,opens:boolean>>, splits array<struct<first:string,second:string>>"


def read_lines(texts: DataFrame) -> DataFrame:
    """The labelled lines of each text with their words and split words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = line_model()
        for b in batches:
            for s in range(0, b.num_rows, 64):
                rows = b.slice(s, 64).to_pylist()
                out = {k: [] for k in ("h", "content_id", "field", "pos", "line_no", "state", "words", "splits")}
                for r in rows:
                    for n, state, words, splits in read_text(r["text"], model):
                        if state == "break":
                            continue
                        for k, v in zip(out, (r["h"], r["content_id"], r["field"], r["pos"], n, state, [{"w": w, "opens": o} for w, o in words], [{"first": a, "second": c} for a, c in splits])):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict(
                    out,
                    schema=pa.schema([
                        ("h", pa.string()), ("content_id", pa.int64()), ("field", pa.string()), ("pos", pa.int32()), ("line_no", pa.int32()), ("state", pa.string()),
                        ("words", pa.list_(pa.struct([("w", pa.string()), ("opens", pa.bool_())]))),
                        ("splits", pa.list_(pa.struct([("first", pa.string()), ("second", pa.string())]))),
                    ]),
                )

    return texts.mapInArrow(run, _LINES)


def long_readings(counts: DataFrame, long: DataFrame) -> DataFrame:
    """``(variant, word, n, changes, m)`` for the ``long`` ones of the counted words: they meet the others on hashes of their variants."""

    def hashed(changed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 1000):
                    some = b.slice(s, 1000)
                    keys = [folded_keys(w, changed) for w in some.column("word").to_pylist()]
                    at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                    yield pa.RecordBatch.from_arrays([some.column("id").take(at), pa.array([x for k in keys for x in k], pa.int64())], names=["id", "k"])

        return run

    ident = F.xxhash64("word").alias("id")
    a = long.select(ident, "word").mapInArrow(hashed(True), "id bigint, k bigint").withColumnRenamed("id", "a")
    b = counts.select(ident, "word").mapInArrow(hashed(False), "id bigint, k bigint").withColumnRenamed("id", "b")
    pairs = a.join(b.hint("merge"), "k").where("a != b").select("a", "b").distinct()
    one = counts.select(ident.alias("a"), "word", "n")
    two = counts.select(F.xxhash64("word").alias("b"), F.col("word").alias("variant"), F.col("n").alias("m"))

    @F.pandas_udf("int")
    def changes(w, v):
        return type(w)([folded_changes(x, y) for x, y in zip(w, v)])

    full = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return full.withColumn("changes", changes("word", "variant")).where("changes > 0").select("variant", "word", "n", "changes", "m")


def corrections(counts: DataFrame, ratio: float = 20.0) -> DataFrame:
    """``(word, fixed)`` for each counted word that is a misreading of a better attested one.

    ``counts`` has (word, n), lower case. A word of letters must be ``ratio`` times rarer than the word it is taken for, fifteen times
    that under five letters; each letter over five halves it, down to 3, as chance neighbours get rarer. One with digits or symbols
    needs a known reading, or enough letters for the usual one. Only ratios count, so a corpus and many copies of it are read alike.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                some = b.slice(s, 1000)
                out: dict[str, list] = {"word": [], "n": [], "variant": [], "changes": []}
                for w, n in zip(some.column("word").to_pylist(), some.column("n").to_pylist()):
                    letters = sum(c.isalpha() for c in w)
                    if is_long(w) or letters < 2 or len(w) < 3 and not _SYMBOL.search(w) or re.search(r"\d{2}", w) and letters < 5 or "/" in w or re.search(r"\d-|-\d", w):
                        continue
                    for v, c in variants(w).items():
                        for k, x in zip(out, (w, n, v, c)):
                            out[k].append(x)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("word", pa.string()), ("n", pa.int64()), ("variant", pa.string()), ("changes", pa.int32())]))

    spelt = counts.mapInArrow(spell, "word string, n bigint, variant string, changes int")
    known = counts.select(F.col("word").alias("variant"), F.col("n").alias("m"))
    met = spelt.join(known.hint("merge"), "variant")
    long = counts.where((F.length("word") > 40) | (F.length(F.regexp_replace("word", "[^1]", "")) > 5))
    if not long.isEmpty():
        met = met.unionByName(long_readings(counts, long))
    symbol = F.col("word").rlike(r"[0-9@$|!]")
    length = F.length("word")
    rarer = F.when(length < 5, 15 * ratio).otherwise(F.greatest(F.lit(3.0), ratio * F.pow(F.lit(0.5), length - 5)))
    enough = F.col("m") >= F.col("n") * F.when(symbol, F.when(length < 5, 5.0).otherwise(1.0)).otherwise(rarer)
    clean = ~F.col("variant").rlike(r"[0-9@$|!]")
    hits = met.where(enough & clean)
    best = hits.groupBy("word").agg(F.max(F.struct((-F.col("changes")).alias("c"), F.col("m"), F.col("variant"))).alias("b"))
    found = best.select("word", F.col("b.variant").alias("fixed"))
    usual = (
        counts.where(symbol & (F.length(F.regexp_replace("word", r"[^\p{L}]", "")) >= 5) & ~F.col("word").rlike(r"[0-9]{2}|[0-9]-|-[0-9]|/|@.*\.|[^\p{L}0-9@$|!-]"))
        .join(found.hint("merge"), "word", "left_anti")
        .select("word", F.translate("word", "0159@$|!", "olsgasll").alias("fixed"))
        .where(~F.col("fixed").rlike(r"[0-9@$|!]"))
    )
    return found.unionByName(usual)


_WHERE = ["content_id", "field", "pos", "line_no"]


def word_repairs(lines: DataFrame, max_broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """Of labelled ``lines``: the words split there, ``broken`` where the mark is no part of the word, and the misread words with what is right."""
    where = ["h", *_WHERE]
    words = lines.where("state = 'body'").select(*where, F.explode("words").alias("x")).select(*where, "x.w", "x.opens", F.lower("x.w").alias("word"))
    counts = checkpointed(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))

    splits = lines.where("state = 'body'").select(*where, F.explode("splits").alias("x"))
    first = F.expr("substring(x.first, 1, length(x.first) - 1)")
    halves = splits.select(*where, first.alias("first"), F.col("x.second").alias("second"), F.expr("right(x.first, 1)").alias("mark"))
    halves = halves.withColumn("joined", F.concat("first", "second")).withColumn("kept", F.concat("first", F.lit("-"), "second"))

    # what becomes of a split depends on its halves alone: each distinct one is looked up once, all its four words in one join
    asked = {"n_joined": "joined", "n_kept": "kept", "n_first": "first", "n_second": "second"}
    split = ["first", "second", "mark", "joined", "kept"]
    each = halves.groupBy(*split).agg(F.count(F.lit(1)).alias("times"))
    looked = each.select(*split, "times", F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.lower(c).alias("word")) for k, c in asked.items()])).alias("x")).select(*split, "times", "x.*")
    looked = looked.join(counts.hint("merge"), "word", "left")
    each = looked.groupBy(*split, "times").agg(*[F.max(F.when(F.col("role") == k, F.col("n"))).alias(k) for k in asked])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    compound = (zero("n_kept") > zero("n_joined")) | (
        (zero("n_joined") == 0) & (zero("n_first") > 30) & (zero("n_second") > 30) & (F.length("first") > 3) & (F.length("second") > 3)
    )
    soft = ~F.col("mark").isin("-", "–")
    each = each.select(*split, "times", ((soft | ~compound) & ((F.col("mark") != "–") | (zero("n_joined") > 1))).alias("broken"))
    halves = lookup(halves, each, split, "times")

    @F.pandas_udf("string")
    def numbers(w):
        return w.map(read_number)

    @F.pandas_udf("string")
    def cased(w, fixed, opens):
        return type(w)([recase(*x) for x in zip(w, fixed, opens)])

    odd = words.where(F.col("w").rlike(r"[0-9]") & F.col("w").rlike(r"[OoQlI|ZSB]"))
    numeric = odd.withColumn("fixed", numbers("w")).where("fixed IS NOT NULL")
    fixes = broadcast_if_small(checkpointed(corrections(counts)), max_broadcast_rows)
    spelt = words.join(fixes, "word").withColumn("fixed", cased("w", "fixed", "opens")).where(~F.col("w").rlike(r"^[0-9.,]*[0-9OoQlI|ZSB][0-9OoQlI|ZSB.,]*$") | ~F.col("w").rlike(r"[0-9]"))
    columns = [*where, "w", "opens", "fixed"]
    return halves, numeric.select(columns).unionByName(spelt.select(columns))


def repair_events(papers: DataFrame, max_broadcast_rows: int = 50_000) -> DataFrame:
    """``(content_id, field, pos, line_no, kind, fixed)``: furniture lines, broken words and misread words or numbers of each text.

    Repeated papers and paragraphs count like any other; null and empty texts give nothing; texts are read whole. Word counts
    cover all texts; the table of corrections is broadcast up to ``max_broadcast_rows`` rows and joined by shuffle beyond.
    """
    lines = checkpointed(read_lines(paper_texts(papers)))
    furniture = lines.where("state = 'furniture'").select(*_WHERE, F.lit("furniture").alias("kind"), F.lit("").alias("fixed"))
    halves, misread = word_repairs(lines, max_broadcast_rows)
    broken = halves.where("broken").select(*_WHERE, F.lit("broken_word").alias("kind"), F.col("joined").alias("fixed"))
    return furniture.unionByName(broken).unionByName(misread.select(*_WHERE, F.lit("misread").alias("kind"), "fixed")).distinct()


def repaired_paragraphs(papers: DataFrame, max_broadcast_rows: int = 50_000) -> DataFrame:
    """``(content_id, field, pos, paragraph_no, text)``: the running text of each text in continuous paragraphs, numbered from 1.

    Furniture, titles, table cells and line breaks are left out; split words are whole (compounds keep their hyphen), misread ones
    corrected, as ``repair_events`` has them. Equal texts in the same place of a paper are given once; texts without body lines give nothing.
    """
    texts = paper_texts(papers)
    halves, misread = word_repairs(checkpointed(read_lines(texts)), max_broadcast_rows)
    glued = F.when(F.col("broken"), F.col("joined")).otherwise(F.concat("first", "mark", "second"))
    joins = halves.select("h", F.struct(F.concat("first", "mark").alias("first"), "second", glued.alias("glued")).alias("x")).groupBy("h").agg(F.collect_set("x").alias("joins"))
    fixes = misread.select("h", F.struct("w", "opens", "fixed").alias("x")).groupBy("h").agg(F.collect_set("x").alias("fixes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = line_model()
        for b in batches:
            for s in range(0, b.num_rows, 64):
                out: list[tuple] = []
                for r in b.slice(s, 64).to_pylist():
                    fixed = {(x["w"], x["opens"]): x["fixed"] for x in r["fixes"] or ()}
                    whole = {(x["first"], x["second"]): x["glued"] for x in r["joins"] or ()}
                    out += [(r["content_id"], r["field"], r["pos"], n, p) for n, p in enumerate(mended(r["text"], model, fixed, whole), 1)]
                kinds = [("content_id", pa.int64()), ("field", pa.string()), ("pos", pa.int32()), ("paragraph_no", pa.int32()), ("text", pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, (_, kind) in enumerate(kinds)], schema=pa.schema(kinds))

    known = texts.dropDuplicates(["h"]).join(fixes.hint("merge"), "h", "left").join(joins.hint("merge"), "h", "left")
    return known.mapInArrow(run, "content_id bigint, field string, pos int, paragraph_no int, text string")
