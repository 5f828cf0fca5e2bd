"""Text semantics shared by all operators: classes, rounding, folding, index statistics."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it.
WS = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: The same characters as a string, and as a class that Java decides in two steps where a character is ASCII.
BLANKS = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = rf"[\s[\x{{80}}-\x{{FFFF}}&&{WS}]]"
NO_SPACE = "[^" + SPACE[1:]

# Patterns that the results depend on.
PAGE_NUMBER = r"(?i)^[\s\-–—|\[(]*(page\s+|p\.\s*|hal(aman)?\.?\s+)?([0-9]{1,4}|[ivxlcdm]{1,7})(\s*(of|/|dari)\s*[0-9]{1,4})?[\s\-–—|\])]*$"
CHAPTER = (
    r"(?i)^(chapter|chap\.|part|book|volume|prologue|epilogue|introduction|preface|foreword|afterword|interlude|appendix|contents|"
    r"bab|bagian|prolog|epilog|pendahuluan|kata pengantar|daftar isi|lampiran)([^A-Za-z0-9_]|$)"
)
NUMERAL = r"^([0-9]{1,3}|[IVXLC]{1,7})\.?$"
SCENE_BREAK = r"^[\s*•·~#◆◇❖✦✧⁂§=\-–—_.]{1,15}$"
ORNAMENT = r"[*•·~#◆◇❖✦✧⁂§]"
ENDS_SENTENCE = r"[.!?:;\"'”’)\]…]$"
STRAY_MARK = r"^[‘’'\"“”`´,.;:|\\/_~^*•·°¦¡!]+$"
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st mt ft vs etc eg ie cf al approx dept est inc ltd co corp no nos vol vols ed eds p pp ch fig figs "
    "jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun gen col capt lt sgt rev hon messrs mme mlle "
    "dll dsb tsb dkk yth"
).split()
FUNCTION_WORDS = (
    "a an the of to in on at by for from with and or but if as is it its be he she we you they i me my his her our your their them "
    "this that was were are am not no so do did has had have will would can could all any"
).split()


def trim(c: Column) -> Column:
    """Trim browser white space; read from the ends only, for a pattern looks at every character, and at a long stretch of white space again and again."""
    return F.btrim(c, F.lit(BLANKS))


def round_half_up(c: Column) -> Column:
    """Rounds halves toward plus infinity."""
    return F.floor(c + F.lit(0.5))


def or_default(c: Column, default) -> Column:
    """The default for null and for 0."""
    return F.coalesce(F.when(c != 0, c), default if isinstance(default, Column) else F.lit(default))


def at_rank(sorted_values: Column, p: float) -> Column:
    """The element of a sorted array at floor(n * p), capped at the last; null for an empty array."""
    i = F.least(F.size(sorted_values) - 1, F.floor(F.size(sorted_values) * F.lit(p)).cast("int"))
    return F.when(F.size(sorted_values) > 0, F.element_at(sorted_values, F.greatest(i + 1, F.lit(1))))


def is_page_number(text: Column) -> Column:
    return trim(text).rlike(PAGE_NUMBER)


def running_key(text: Column) -> Column:
    """What repeated headers and footers have in common: letters, with numbers as ``#``."""
    # The word border is that of ASCII word characters.
    k = F.regexp_replace(F.lower(text), r"(?<![A-Za-z0-9_])[ivxlcdm]{1,7}(?![A-Za-z0-9_])", "#")
    return F.regexp_replace(F.regexp_replace(k, r"[0-9]+", "#"), r"[^a-z#\p{L}]+", "")


def could_be_heading(text: Column) -> Column:
    """Short and title-like."""
    words = F.filter(F.split(text, WS + "+"), lambda w: w != "")
    letters = F.filter(words, lambda w: w.rlike(r"^\p{L}"))
    lower = F.filter(letters, lambda w: w.rlike(r"^\p{Ll}"))
    wordy = (F.size(letters) > 4) & (F.size(lower) / F.size(letters) > 0.5)
    several = text.rlike(r"[.!?][\"”’]?\s+\p{Lu}") & (F.size(words) > 6)
    return (F.size(words) <= 12) & (F.length(text) <= 80) & ~text.rlike(r"[-–—,;]$") & ~wordy & ~several


def _fold_pairs() -> tuple[str, str]:
    """Precomposed letters of one base letter and marks, and their lower-case base letters."""
    src, dst = [], []
    for cp in range(0xC0, sys.maxunicode if sys.maxunicode < 0x3000 else 0x3000):
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")).lower()
        if base != c.lower() and len(base) == 1:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


#: The table that folds letters, as two strings for translate().
FOLDED = _fold_pairs()


def fold(text: Column) -> Column:
    """Without accents, in lower case; precomposed letters keep their place."""
    return F.lower(F.regexp_replace(F.translate(text, *FOLDED), r"\p{M}", ""))


def join_pieces(text: Column, after: Column) -> Column:
    """A line as it stands in its paragraph before the line ``after``, with what separates them.

    A hyphen before a lower-case letter and a soft hyphen go; other dashes and
    slashes join directly; else a space.
    """
    short = F.substr(text, F.lit(1), F.length(text) - 1)
    return (
        F.when(after.isNull(), text)
        .when(text.rlike(r"\p{L}-$") & after.rlike(r"^\p{Ll}"), short)
        .when(text.endswith("­"), short)
        .when(text.rlike(r"[-–—/]$") & ~text.rlike(r"\s[-–—]$"), text)
        .otherwise(F.concat(text, F.lit(" ")))
    )


def percent(part: Column, whole: Column) -> Column:
    return round_half_up(part / or_default(whole, 1) * 100).cast("long")
