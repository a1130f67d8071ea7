"""Text folding and labels as column expressions.

Folding is NFKD without combining marks, case folded, white space collapsed. Characters with one folded character go
through a translation table, the few with several (ligatures, sharp s, fractions) through a map, and only in texts that
hold one; both are made from the Unicode data of Python, so folding stays in the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that split() of Python cuts at.
SPACES = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@cache
def forms() -> tuple[str, str, dict[str, str]]:
    """(from, to, several): characters with one folded character, those without any at the end, and those with several.

    Hangul, ideographs and ligatures of Arabic stay as they are.
    """
    one, none, several = [], [], {}
    for c in map(chr, (*range(0xA1, 0x3400), *range(0xA000, 0xAC00), *range(0xFB00, 0xFB50), *range(0xFE50, 0xFFF0), *range(0x1D400, 0x1D800))):
        f = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if not f:
            none.append(c)
        elif len(f) > 1:
            several[c] = f
        elif f != c.lower() and f != c:
            one.append((c, f))
    return "".join(c for c, _ in one) + "".join(none), "".join(f for _, f in one), several


def unaccented(c: Column) -> Column:
    """Without accents, widths and typefaces; the case of ASCII letters stays."""
    source, target, several = forms()
    table = F.map_from_arrays(F.array(*map(F.lit, several)), F.array(*map(F.lit, several.values())))
    spelt = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.translate(F.when(c.rlike("[" + "".join(several) + "]"), spelt).otherwise(c), source, target)


def folded(c: Column) -> Column:
    """Lower case without accents, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(unaccented(c)), SPACES, " "))


def compact(c: Column) -> Column:
    """Folded, only a to z and digits."""
    return F.regexp_replace(F.lower(unaccented(c)), "[^a-z0-9]", "")


def label(c: Column) -> Column:
    """Folded, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(unaccented(c)), "[^a-z0-9]+", " "))


def title_of(code: Column) -> Column:
    return F.initcap(F.regexp_replace(F.trim(code), "_+", " "))


def code_of(category: Column, prefix: str) -> Column:
    """The prefix with the category in capitals, all but letters and digits as one underscore, none at the ends."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(F.upper(category), "[^A-Z0-9]+", "_"), "^_+|_+$", ""))
