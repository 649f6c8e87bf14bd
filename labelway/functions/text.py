"""Text cleaning and name keys as JVM expressions.

Java's ``\\w``, ``\\s`` and ``\\d`` are ASCII-only, so the Unicode classes are
spelled out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode character classes.
SPACE_SET = r"\p{Z}\t-\r\x1c-\x1f\x85"
WORD_SET = r"\p{L}\p{N}_"
WORD_NOT_DIGIT_SET = r"\p{L}\p{Nl}\p{No}_"

_SPACE = f"[{SPACE_SET}]"
_SOLID = f"[^{SPACE_SET}]"
_URL = f"https?://{_SOLID}+"
# The look-behind lets the engine try each blank-free run once from its start:
# linear time on long runs, same matches as the bare pattern.
_EMAIL = f"(?<!{_SOLID}){_SOLID}+@{_SOLID}+"
# Letters up to U+00FF, one by one.
_LATIN = string.ascii_letters + "".join(map(chr, [0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
# Neither a Latin letter nor another kept character. The first class is a bit
# set, so most characters never reach the slower Unicode properties.
_FILLER = f"[[^{_LATIN}_]&&[^{WORD_NOT_DIGIT_SET}]]+"


def _without_links(text: Column) -> Column:
    """URLs and e-mail-like runs to blanks; texts without either are not scanned."""
    no_url = F.when(
        F.contains(text, F.lit("://")), F.regexp_replace(text, _URL, " ")
    ).otherwise(text)
    return F.when(
        F.contains(no_url, F.lit("@")), F.regexp_replace(no_url, _EMAIL, " ")
    ).otherwise(no_url)


def clean_text(text: Column) -> Column:
    """URLs, e-mail-like runs, digits and punctuation to blanks; lower case;
    single blanks; one blank for null or empty results.

    Digits, punctuation and white space all end up as one blank per run, so a
    single pass over the three classes replaces three.
    """
    flat = F.trim(F.lower(F.regexp_replace(_without_links(text), _FILLER, " ")))
    # every kept character sorts after the blank, so only null and '' lose
    return F.greatest(flat, F.lit(" "))


def has_words(text: Column) -> Column:
    """Whether the cleaned text is more than a blank, without cleaning it: the
    search ends at the first kept character."""
    found = F.rlike(_without_links(text), F.lit(f"[{string.ascii_letters}{WORD_NOT_DIGIT_SET}]"))
    return F.coalesce(found, F.lit(False))


def is_blank(text: Column) -> Column:
    """True for null and for strings of white space only."""
    return F.coalesce(F.regexp_replace(text, f"{_SPACE}+", "") == "", F.lit(True))


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{_SPACE}+", " "))


def safe_key(name: Column) -> Column:
    """Folder-safe key: slug of at most 80 characters and 8 hex digits of MD5."""
    norm = squeeze_spaces(F.coalesce(name, F.lit("None")))
    slug = F.regexp_replace(norm, rf"[^{WORD_SET}.\-]+", "_")
    return F.concat(
        F.substring(slug, 1, 80), F.lit("__"), F.substring(F.md5(F.encode(norm, "UTF-8")), 1, 8)
    )
