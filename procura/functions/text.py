"""Names, tokens and folder names as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from procura import vocab

# Characters that count as blank at the ends of a text.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

WORD = "[a-zа-я0-9]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """True when ``c`` contains at least one of ``words``."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return found


def normalize_name(c: Column) -> Column:
    """Lower case, one spelling for е/и letters, blanks for ``_`` and ``-``.

    One ``translate`` pass; the combining breve has no counterpart and is dropped.
    """
    return strip(F.translate(F.lower(c), "ёй_-\u0306", "еи  "))


def significant_tokens(
    c: Column,
    stopwords: Sequence[str] = vocab.STOPWORDS,
    min_chars: int = vocab.TOKEN_CHARS,
) -> Column:
    """Array of title tokens, repeats kept, in text order."""
    words = F.regexp_extract_all(normalize_name(c), F.lit(WORD + "+"), F.lit(0))
    return F.filter(
        words, lambda w: (F.length(w) >= min_chars) & ~w.isin(*stopwords)
    )


def file_name(path: Column) -> Column:
    """Last part of a slash path; a trailing slash is ignored."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def suffix(path: Column) -> Column:
    """Extension with its dot, as written; empty when there is none."""
    name = file_name(path)
    ext = F.substring_index(name, ".", -1)
    has_ext = F.contains(name, F.lit(".")) & (ext != "")
    return F.when(
        has_ext & (F.length(name) > F.length(ext) + 1), F.concat(F.lit("."), ext)
    ).otherwise("")


def is_generic_name(
    normalized: Column, phrases: Sequence[str] = vocab.GENERIC_NAMES
) -> Column:
    return contains_any(normalized, phrases)


def is_project_name(
    normalized: Column, markers: Sequence[str] = vocab.PROJECT_MARKERS
) -> Column:
    return contains_any(normalized, markers)


def keyword_count(
    normalized: Column, keywords: Sequence[str] = vocab.PRIORITY_KEYWORDS
) -> Column:
    """How many of ``keywords`` occur in a normalised file name."""
    total = F.lit(0)
    for word in keywords:
        total = total + F.contains(normalized, F.lit(word)).cast("int")
    return total


def safe_dirname(c: Column, max_chars: int = vocab.DIRNAME_CHARS) -> Column:
    name = F.left(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_"), F.lit(max_chars))
    return F.when(name == "", F.lit("tender")).otherwise(name)


def truncate_utf8(c: Column, max_bytes: int) -> Column:
    """At most ``max_bytes`` bytes: whole characters, then an ellipsis."""
    raw = F.encode(c, "UTF-8")
    room = max_bytes - 3
    # A UTF-8 character has at most four bytes, so one of four cuts is clean.
    cuts = [
        F.try_validate_utf8(F.substring(raw, 1, size).cast("string"))
        for size in range(room, max(room - 4, -1), -1)
    ]
    head = F.rtrim(F.coalesce(*cuts), F.lit(BLANKS))
    return F.when(F.octet_length(c) <= max_bytes, c).otherwise(
        F.concat(head, F.lit("..."))
    )


def sanitize_folder_name(
    c: Column,
    max_bytes: int = vocab.FOLDER_BYTES,
    default: str = vocab.UNTITLED_FOLDER,
) -> Column:
    clean = F.replace(F.replace(c, F.lit("/"), F.lit("／")), F.lit("\0"), F.lit(""))
    clean = F.rtrim(strip(clean), F.lit(". "))
    return truncate_utf8(F.when(clean == "", F.lit(default)).otherwise(clean), max_bytes)


def ordinal_prefix(ordinal: Column, name: Column) -> Column:
    """``7, x`` -> ``007. x``; the number grows past three digits when needed."""
    return F.format_string("%03d. %s", ordinal, name)


def detect_filename(
    href: Column, text: Column, max_chars: int = vocab.FILENAME_CHARS
) -> Column:
    """File name for a link: last URL part, else the link text, else a default."""
    # A label begins and ends with one of these signs; as many of them as the name may have
    # are all that can show, so a long text is read no further than that.
    kept = r"a-zA-Z0-9а-яА-Я.\-"
    shown = rf"^[^{kept}]*+((?:[^{kept}]*+[{kept}]){{0,{max(0, max_chars)}}}+)"
    label = F.regexp_extract(F.coalesce(text, F.lit("")), shown, 1)
    label = F.regexp_replace(label, rf"[^{kept}_]+", "_")
    last = F.substring_index(F.substring_index(href, "/", -1), "?", 1)
    name = F.coalesce(
        F.nullif(last, F.lit("")), F.nullif(label, F.lit("")), F.lit("document")
    )
    name = F.when(
        ~F.contains(name, F.lit(".")) & (label != ""), F.concat(label, F.lit(".bin"))
    ).otherwise(name)
    return F.left(name, F.lit(max_chars))


def filename_from_header(disposition: Column, fallback: Column) -> Column:
    """File name of a content-disposition header, else ``fallback``."""
    found = F.regexp_extract(
        F.coalesce(disposition, F.lit("")), r'(?i)filename="?([^";]+)"?', 1
    )
    return F.when(found != "", found).otherwise(fallback)
