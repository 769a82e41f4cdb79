"""Element symbols of table headers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The symbols tracked, and the names taken for them.
SYMBOLS = (
    "ag al as au b ba be bi br ca cd ce cl co cr cs cu dy er eu f fe ga gd ge hf hg ho in ir k la li lu mg mn mo na nb nd "
    "ni os p pb pd pr pt rb re rh ru s sb sc se si sm sn sr ta tb te th ti tl tm u v w y yb zn zr"
).split()
NAMES = dict(
    silver="ag", aluminum="al", aluminium="al", arsenic="as", gold="au", boron="b", barium="ba", beryllium="be", bismuth="bi", bromine="br", calcium="ca", cadmium="cd",
    cerium="ce", chlorine="cl", cobalt="co", chromium="cr", caesium="cs", cesium="cs", copper="cu", dysprosium="dy", erbium="er", europium="eu", fluorine="f", iron="fe",
    gallium="ga", gadolinium="gd", germanium="ge", hafnium="hf", mercury="hg", holmium="ho", indium="in", iridium="ir", potassium="k", lanthanum="la", lithium="li",
    lutetium="lu", magnesium="mg", manganese="mn", molybdenum="mo", sodium="na", niobium="nb", neodymium="nd", nickel="ni", osmium="os", phosphorus="p", lead="pb",
    palladium="pd", praseodymium="pr", platinum="pt", rubidium="rb", rhenium="re", rhodium="rh", ruthenium="ru", sulfur="s", sulphur="s", antimony="sb", scandium="sc",
    selenium="se", silicon="si", samarium="sm", tin="sn", strontium="sr", tantalum="ta", terbium="tb", tellurium="te", thorium="th", titanium="ti", thallium="tl",
    thulium="tm", uranium="u", vanadium="v", tungsten="w", yttrium="y", ytterbium="yb", zinc="zn", zirconium="zr",
)
#: Unit endings of a header, in the order in which they are cut.
UNIT_ENDINGS = [
    " (ppm)", " (ppb)", " (wt%)", " wt%", "_wt%", "(wt%)", " (wt.%)", "(wt.%)", "(mass%)", "(mass %)", " (mass%)", " (mass %)", " mass%", " (%)", " %",
    " µg/g", " ug/g", " μg/g", " mg/kg", " g/t", "_ppm", "_ppb", " ppm", " ppb",
]
#: Endings of statistics.
STATISTICS = "mean|2se|2sd|sd|se|median|avg|rsd|1sd|1se"


def _grammar() -> str:
    """A header as one pattern: a word, with digits about it, then its unit endings from the inside out, a statistic and a remark."""
    units = "".join(f"(?:{re.escape(e)})?" for e in reversed(UNIT_ENDINGS))
    mass = r"(?:_pp[mb]_m[0-9]+)?"
    return rf"^\s*([^\s_].*?|){mass}[_\s]*{units}{mass}(?:[_\s]+(?:{STATISTICS}))?{mass}(?:_pp[mb]_(?:content|conc))?$"


_HEADER = _grammar()

def header_symbol(header: Column) -> Column:
    """The element symbol of a raw header, or null: detection-limit columns, oxides and other headers give none.

    An isotope's mass (two digits or more, in headers of up to six characters) may stand before or after the symbol.
    """
    h = F.lower(F.trim(header))
    names = F.create_map(*[F.lit(x) for pair in {**{s: s for s in SYMBOLS}, **NAMES}.items() for x in pair])

    def of(word: Column) -> Column:
        # the word as it stands, else without the digits behind it, else without those before it; the names are written out once
        short = F.length(word) <= 6
        behind, before = F.regexp_replace(word, r"(?<=[^0-9])[0-9]{2,}$", ""), F.regexp_replace(word, r"^[0-9]{2,}(?=[^0-9])", "")
        tried = F.transform(F.array(word, F.when(short, behind), F.when(short, before)), lambda w: F.try_element_at(names, w))
        return F.try_element_at(F.array_compact(tried), F.lit(1))

    # a lambda over one item names the word, so that the pattern is written into the plan once
    word = F.regexp_extract(h, _HEADER, 1)
    return F.when(~h.rlike(r"_pp[mb]_(lod|dl|det_lim)$"), F.transform(F.array(word), of)[0])
