"""Text expressions: Han spacing, folding, tokens, trimming, previews."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Han ranges that get a space on both sides.
HAN = r"\x{4E00}-\x{9FA5}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}"

# Fixed value: the separator between entries of a memory document.
ENTRY_SEPARATOR = "\n§\n"

# Fixed value: code points kept in a preview.
PREVIEW_CHARS = 200

# The characters Unicode calls white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def tokenize_cjk(text: Column) -> Column:
    """Put one space at every border of a Han character.

    The second pass looks ahead only: a look-behind form goes wrong for Han
    characters outside the basic plane.
    """
    before_han = F.regexp_replace(text, f"([^ ])(?=[{HAN}])", "$1 ")
    spaced = F.regexp_replace(before_han, f"([{HAN}])(?=[^ {HAN}])", "$1 ")
    return F.when(text.rlike(f"[{HAN}]"), spaced).otherwise(text)


@functools.cache
def _accent_map() -> tuple[str, str]:
    """Lower-case letters that decompose canonically to an ASCII letter plus marks."""
    accented, plain = [], []
    for code in range(0xC0, 0x2000):
        letter = chr(code)
        base, *marks = unicodedata.normalize("NFD", letter)
        if marks and base.isascii() and base.islower() and all(map(unicodedata.combining, marks)):
            accented.append(letter)
            plain.append(base)
    return "".join(accented), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case, without combining marks, accented Latin letters made plain."""
    accented, plain = _accent_map()
    lowered = F.regexp_replace(F.lower(text), r"[\x{0300}-\x{0331}]", "")
    return F.translate(lowered, accented, plain)


def fold_terms(text: Column) -> Column:
    """Folded runs of letters, digits and private-use characters, in order."""
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{N}\p{Co}]+"), "")


def search_terms(text: Column) -> Column:
    """The tokens that both the index and the queries use."""
    return fold_terms(tokenize_cjk(text))


def trim_text(text: Column) -> Column:
    """Trim every kind of white space, not only the blank."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, chars)


def split_entries(body: Column) -> Column:
    """The trimmed, non-empty entries of a memory document body."""
    parts = F.transform(F.split(body, ENTRY_SEPARATOR), trim_text)
    return F.filter(parts, lambda part: part != "")


def join_entries(entries: Column) -> Column:
    return F.array_join(entries, ENTRY_SEPARATOR)
