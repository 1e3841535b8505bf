"""Mending of label columns: case, outer space, separators, language codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and invisible characters that may surround a label.
_EDGE = r"[\s  -‏ -  ⁠　﻿]+"

#: Spellings of one language (ISO 639 codes and English names).
LANGUAGES = {
    "english": "en", "eng": "en", "german": "de", "deutsch": "de", "ger": "de", "deu": "de",
    "spanish": "es", "spa": "es", "french": "fr", "fra": "fr", "fre": "fr",
    "russian": "ru", "rus": "ru", "japanese": "ja", "jpn": "ja", "jp": "ja",
}


def trimmed(c: Column) -> Column:
    """c without outer white space of any kind; null if nothing is left."""
    return F.nullif(F.regexp_replace(c, f"^{_EDGE}|{_EDGE}$", ""), F.lit(""))


def mended_label(c: Column) -> Column:
    """Lower case, outer space off, ``-`` and inner space as ``_``; null for null and blank."""
    return F.regexp_replace(F.lower(trimmed(c)), r"[\s\-_]+", "_")


def mended_family(c: Column) -> Column:
    """task_type with case, outer space and ``-`` mended; inner space is kept, for it makes another value."""
    return F.replace(F.lower(trimmed(c)), F.lit("-"), F.lit("_"))


def mended_language(c: Column) -> Column:
    """A language as its two-letter code: region dropped, names and three-letter codes mapped; 'und' and blank are null."""
    base = F.regexp_extract(F.lower(trimmed(c)), r"^([a-z]+)", 1)
    pairs = [x for kv in sorted(LANGUAGES.items()) for x in (F.lit(kv[0]), F.lit(kv[1]))]
    return F.nullif(F.nullif(F.coalesce(F.create_map(*pairs)[base], base), F.lit("und")), F.lit(""))
