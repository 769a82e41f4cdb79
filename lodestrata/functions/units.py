"""Mass-fraction units: canonical names, free spellings and the places in a text that state one."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

#: Parts per billion by mass in one of each unit, and the words the units are called by.
PPB_OF = {
    "percent": 1e7,
    "permil": 1e6,
    "ppm": 1e3,
    "ppb": 1.0,
    "ppt": 1e-3,
    "fraction": 1e9,
}
WORDS = {
    "percent": ["%", "wt%", "weight%", "mass%", "percent", "pct", "weight percent", "mass percent", "wt percent", "wt pct", "weight pct", "per cent", "weight per cent"],
    "permil": ["‰", "per mil", "per mill", "per mille", "permil", "permille", "parts per thousand"],
    "ppm": ["ppm", "ppmw", "parts per million", "grams per tonne", "gpt"],
    "ppb": ["ppb", "ppbw", "parts per billion"],
    "ppt": ["parts per trillion"],
    "fraction": ["mass fraction", "weight fraction"],
}
#: Powers of ten of a gram.
_GRAMS = {"kg": 3, "g": 0, "mg": -3, "ug": -6, "ng": -9, "pg": -12}
_PER = {"kg": 3, "g": 0, "mg": -3, "t": 6, "tonne": 6, "ton": 6}
_MICRO = str.maketrans({"µ": "u", "μ": "u", "−": "-", "–": "-", "—": "-", "×": "x", "·": " ", "⋅": " ", "*": " "})


def fold(text: str) -> str:
    """Case, compatibility forms, micro signs, dots and blanks folded away: one key for spellings that only look different."""
    t = unicodedata.normalize("NFKC", text.replace("‰", "permil").replace("⁻", "-")).translate(_MICRO).lower()
    return re.sub(r"[\s._]+", "", t)


def canonical_aliases() -> dict[str, float]:
    """Folded spelling -> ppb, from the word lists and, by rule, every mass over mass in its usual notations."""
    out = {fold(w): PPB_OF[u] for u, ws in WORDS.items() for w in ws}
    for num, a in _GRAMS.items():
        for den, b in _PER.items():
            for s in (f"{num}/{den}", f"{num}{den}-1", f"{num}{den}^-1", f"{num}per{den}"):
                out.setdefault(s, float(f"1e{a - b + 9}"))
    return out


def _ngrams(s: str, n: int = 2) -> set[str]:
    s = f"^{s}$"
    return {s[i : i + n] for i in range(len(s) - n + 1)}


def weighted_distance(a: str, b: str) -> float:
    """Edit distance in which a swap of neighbours or a doubled letter costs less than a strange one, digits and slashes far more."""

    def cost(c: str) -> float:
        return 1.0 if c.isalpha() else 9.0

    prev2: list[float] = []
    prev = [0.0]
    for c in b:
        prev.append(prev[-1] + cost(c))
    for i, x in enumerate(a, 1):
        row = [prev[0] + cost(x)]
        for j, y in enumerate(b, 1):
            gone = 0.5 if i > 1 and a[i - 2] == x else cost(x)
            new = 0.5 if j > 1 and b[j - 2] == y else cost(y)
            best = min(prev[j] + gone, row[-1] + new, prev[j - 1] + (0.0 if x == y else max(cost(x), cost(y))))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, prev2[j - 2] + 0.7)
            row.append(best)
        prev2, prev = prev, row
    return prev[-1]


class UnitIndex:
    """Character n-gram inverted index over the canonical aliases, verified by the weighted edit distance.

    Symbols such as mg/kg stand one letter from another unit, so only aliases of ``least_letters`` letters or more may be
    matched inexactly, within ``per_letters`` letters for each unit of distance.
    """

    def __init__(self, least_letters: int = 7, per_letters: int = 6):
        self.aliases = canonical_aliases()
        self.least, self.per = least_letters, per_letters
        self.postings: dict[str, set[str]] = defaultdict(set)
        for a in self.aliases:
            if len(a) >= least_letters and a.isalpha():
                for g in _ngrams(a):
                    self.postings[g].add(a)
        self._factor = re.compile(r"^(?:x?10(?:\^|\*\*)?([-+]?\d{1,2})|x?(thousand|hundred|million|1000|100|1e3))[x ]?(?=\D)")
        self._scales = {"thousand": 1e3, "1000": 1e3, "1e3": 1e3, "hundred": 1e2, "100": 1e2, "million": 1e6}

    def resolve(self, spelling: str) -> float | None:
        """ppb in one of the unit, or None if the spelling is no known unit."""
        key = fold(spelling).strip("()[]{},;:=")
        if not key:
            return None
        if key in self.aliases:
            return self.aliases[key]
        m = self._factor.match(key)
        if m:
            scale = 10.0 ** int(m[1]) if m[1] else self._scales[m[2]]
            rest = self.resolve(key[m.end() :])
            return None if rest is None else scale * rest
        if len(key) < self.least - 1 or not key.isalpha():
            return None
        hits: dict[str, int] = defaultdict(int)
        grams = _ngrams(key)
        for g in grams:
            for a in self.postings.get(g, ()):
                hits[a] += 1
        best = None
        for a, n in hits.items():
            bound = len(a) / self.per
            if abs(len(a) - len(key)) <= 2 * bound and n >= max(len(grams), len(a) + 1) - 4 * bound:
                d = weighted_distance(key, a)
                if d <= bound and (best is None or (d, a) < best):
                    best = (d, a)
        return self.aliases[best[1]] if best else None


#: Phrases of a note that state the unit of the values; the group holds the unit's spelling.
_NOTE = [
    re.compile(p, re.I | re.S)
    for p in (
        r"^\s*units?\s*(?:are|is|[:=])\s*(?!not\b)([^,;()]+)",
        r"\b(?:concentrations?|values?|results?|contents?|data|analyses)\b[^,;]*?\b(?:in|as)\s+([^,;()]+)",
    )
]
_NOTE_LEAD = re.compile(r"^\s*([^;,:]{1,40});")
_HEADER = re.compile(r"^\s*(?:\d{0,3}[A-Za-z]{1,2}\d{0,3}|[A-Za-z]{3,12})(?:_?(?:mean|avg|average|median|med|max|min|sd|std|total))?(?![A-Za-z])[\s_,:]*(.*)$", re.S)
_IN = re.compile(r"^in\s+(.+)$", re.I | re.S)


def stated_unit(source: str, text: str | None, index: UnitIndex) -> tuple[float, bool] | None:
    """(ppb, is it simply the word ppm) if the text states a unit. source: 'value' (what follows the number), 'unit', 'header' or 'note'."""
    if text is None or not text.strip():
        return None
    if source in ("value", "unit"):
        found = [text]
    elif source == "header":
        m = _HEADER.match(text)
        rest = (m[1] if m else text).strip()
        inside = re.findall(r"[(\[]([^()\[\]]+)[)\]]\s*$", rest)
        within = _IN.match(rest)
        found = inside + ([within[1]] if within else []) + [rest] if rest else []
    else:
        found = [m[1] for p in _NOTE for m in [p.search(text)] if m] + [m[1] for m in [_NOTE_LEAD.match(text)] if m]
        found.append(text)
    for x in found:
        ppb = index.resolve(x)
        if ppb is not None:
            return ppb, re.sub(r"[\s.()\[\],;:_ ]+", "", x).lower() == "ppm"
    return None
