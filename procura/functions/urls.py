"""URL parts, resolution and link predicates as column expressions.

Parts follow the RFC 3986 splitting expression, so no URL makes a task fail.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from procura import vocab
from procura.functions import text

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_HEAD = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"
_PATH = _HEAD + r"([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"(?s)^[^#]*#(.*)$"


def clean(c: Column) -> Column:
    """Drop line breaks and tabs anywhere, blanks and controls at the ends."""
    ends = "".join(chr(i) for i in range(33))
    return F.btrim(F.translate(F.coalesce(c, F.lit("")), "\t\r\n", ""), F.lit(ends))


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _SCHEME, 1))


def host(c: Column) -> Column:
    """Authority in lower case, user and port included."""
    return F.lower(F.regexp_extract(c, _AUTHORITY, 1))


def raw_path(c: Column) -> Column:
    return F.regexp_extract(c, _PATH, 1)


def path(c: Column) -> Column:
    """Path without the parameters of its last part."""
    return F.regexp_replace(raw_path(c), ";[^/]*$", "")


def query(c: Column) -> Column:
    return F.regexp_extract(c, _QUERY, 1)


def fragment(c: Column) -> Column:
    return F.regexp_extract(c, _FRAGMENT, 1)


def _resolve_dots(segments: Column) -> Column:
    """Path from segments, with ``.`` and ``..`` resolved."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise("")
    joined = F.concat(F.array_join(kept, "/"), tail)
    return F.when(F.startswith(joined, F.lit("/")), joined).otherwise(
        F.concat(F.lit("/"), joined)
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on the page ``base``."""
    href = clean(href)
    base = clean(base)
    ref_scheme, ref_path = scheme(href), raw_path(href)
    has_host = href.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//")
    foreign = (ref_scheme != "") & (
        (ref_scheme != scheme(base)) | ~ref_scheme.isin("http", "https")
    )
    base_path = raw_path(base)
    segments = F.split(ref_path, "/")
    # Directory of the base path, then the reference; no empty parts between.
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    merged = F.split(F.concat(folder, ref_path), "/")
    merged = F.concat(
        F.array(F.lit("")),
        F.filter(
            F.slice(merged, F.lit(1), F.greatest(F.size(merged) - 1, F.lit(0))),
            lambda s: s != "",
        ),
        F.slice(merged, F.lit(-1), F.lit(1)),
    )
    relative = F.when(F.startswith(ref_path, F.lit("/")), segments).otherwise(merged)
    dotted = ref_path.rlike(r"(^|/)\.\.?(/|$)")
    plain = F.array_join(relative, "/")
    new_path = (
        F.when(has_host, ref_path)
        .when(ref_path == "", base_path)
        .when(dotted | (plain == ""), _resolve_dots(relative))
        .otherwise(plain)
    )
    new_query = F.when(
        (ref_path == "") & ~has_host & (query(href) == ""), query(base)
    ).otherwise(query(href))
    new_host = F.when(has_host, F.regexp_extract(href, _AUTHORITY, 1)).otherwise(
        F.regexp_extract(base, _AUTHORITY, 1)
    )
    absolute = F.concat(
        scheme(base),
        F.lit("://"),
        new_host,
        new_path,
        F.when(new_query != "", F.concat(F.lit("?"), new_query)).otherwise(""),
        F.when(fragment(href) != "", F.concat(F.lit("#"), fragment(href))).otherwise(""),
    )
    return (
        F.when(base == "", href)
        .when(href == "", base)
        .when(foreign, href)
        .otherwise(absolute)
    )


def is_supported_scheme(c: Column) -> Column:
    return scheme(c).isin("http", "https")


def is_ignored_host(c: Column, hosts: Sequence[str] = vocab.IGNORED_HOSTS) -> Column:
    return text.contains_any(host(c), hosts)


def is_document_link(
    href: Column,
    label: Column,
    extensions: Sequence[str] = vocab.DOCUMENT_EXTENSIONS,
    keywords: Sequence[str] = vocab.DOCUMENT_KEYWORDS,
) -> Column:
    """http(s) link with a document extension, or a keyword in URL or text."""
    only_fragment = (fragment(href) != "") & (path(href) == "")
    by_suffix = text.suffix(F.lower(path(href))).isin(*extensions)
    by_word = text.contains_any(F.lower(href), keywords) | text.contains_any(
        F.lower(F.coalesce(label, F.lit(""))), keywords
    )
    return is_supported_scheme(href) & ~only_fragment & (by_suffix | by_word)


def is_html_response(
    content_type: Column,
    filename: Column,
    extensions: Sequence[str] = vocab.DOCUMENT_EXTENSIONS,
) -> Column:
    """A web page where a document was expected."""
    html = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))
    return html & ~F.lower(text.suffix(filename)).isin(*extensions)


def is_source_host(
    c: Column,
    portal_hosts: Sequence[str] = vocab.PORTAL_HOSTS,
    service_host: str = vocab.PORTAL_SERVICE_HOST,
) -> Column:
    """Host that is neither empty nor the portal itself."""
    h = host(c)
    return (h != "") & ~h.isin(*portal_hosts) & ~F.contains(h, F.lit(service_host))


def is_source_page(c: Column, keywords: Sequence[str] = vocab.SOURCE_KEYWORDS) -> Column:
    return text.contains_any(F.lower(c), keywords)
