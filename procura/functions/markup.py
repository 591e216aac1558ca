"""Anchors of an HTML text, read in one pass as a browser's tokenizer reads it.

Plain Python for use inside tasks: each state hands the next one a place further on, and
whatever is left open (a comment, a quoted value, a script) reaches to the end of the
text, so the work is linear in its length.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

# Elements whose content is text without tags. That of the first two is shown (and may
# hold character references), that of the others is not part of any label.
SHOWN_RAW = ("textarea", "title")
HIDDEN_RAW = ("script", "style", "xmp", "iframe", "noembed", "noframes", "noscript")

_LETTER = re.compile("[a-zA-Z]").match
_NAME = re.compile(r"[^\s/>]*").match
_BLANK = re.compile(r"[\s/]*").match
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*").match
_EQUALS = re.compile(r"\s*=\s*").match
_PLAIN = re.compile(r"[^\s>]*").match
_COMMENT = re.compile(r"--!?>").search
_REFERENCE = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*)(;?)(=?)")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search for name in SHOWN_RAW + HIDDEN_RAW}


def unescape(text: str, attribute: bool = False) -> str:
    """Character references replaced, by the full table of names.

    In an attribute a name without its semicolon stays as it is where a letter, digit or
    ``=`` follows, so that ``?a=1&copy=2`` keeps its parameters.
    """
    if "&" not in text:
        return text
    if not attribute:
        return html.unescape(text)

    def value(found: re.Match) -> str:
        name, end, equals = found.groups()
        if name[0] != "#" and (name + end not in html5 or not end and equals):
            return found[0]
        return html.unescape(f"&{name}{end}") + equals

    return _REFERENCE.sub(value, text)


def _tag(text: str, at: int) -> tuple[str, dict[str, str], int] | None:
    """Name, attributes and end of the tag whose name starts at ``at``; None if it never ends."""
    name = _NAME(text, at)
    at, attributes = name.end(), {}
    while True:
        at = _BLANK(text, at).end()
        if at >= len(text):
            return None
        if text[at] == ">":
            return name[0].lower(), attributes, at + 1
        key = _ATTRIBUTE(text, at)
        at, equals, value = key.end(), _EQUALS(text, key.end()), ""
        if equals:
            at = equals.end()
            quote = text[at : at + 1]
            if quote in ("'", '"'):
                end = text.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = text[at + 1 : end], end + 1
            else:
                plain = _PLAIN(text, at)
                value, at = plain[0], plain.end()
        attributes.setdefault(key[0].lower(), value)


def anchors(text: str) -> list[tuple[int, str, str]]:
    """``number, href, label`` of each anchor with an address, in order.

    Numbers count all anchors. An anchor reaches to its end tag, to the next anchor or to
    the end of the page; its label is the text inside, tags and hidden parts left out.
    """
    found: list[list] = []
    inside, count, at = False, 0, 0

    def shown(part: str) -> None:
        if inside and part:
            found[-1][2].append(part)

    while at < len(text):
        start = text.find("<", at)
        shown(unescape(text[at:] if start < 0 else text[at:start]))
        if start < 0:
            break
        closing = text.startswith("/", start + 1)
        if _LETTER(text, start + 1 + closing):
            tag = _tag(text, start + 1 + closing)
            if tag is None:
                break
            name, attributes, at = tag
            if name == "a":
                inside = False
                if not closing:
                    if attributes.get("href"):
                        found.append([count, unescape(attributes["href"], True), []])
                        inside = True
                    count += 1
            elif not closing and name in _END:
                end = _END[name](text, at)
                stop = end.start() if end else len(text)
                if name in SHOWN_RAW:
                    shown(unescape(text[at:stop]))
                at = stop
            elif not closing and name == "plaintext":
                shown(text[at:])
                break
        elif text.startswith("<!--", start):
            if text.startswith((">", "->"), start + 4):
                at = text.index(">", start) + 1
                continue
            end = _COMMENT(text, start + 4)
            if not end:
                break
            at = end.end()
        elif text[start + 1 : start + 2] in ("!", "?") and start + 1 < len(text) or closing and start + 2 < len(text):
            end = text.find(">", start + 2)
            if end < 0:
                break
            at = end + 1
        else:
            shown("<")
            at = start + 1
    return [(n, href, "".join(label)) for n, href, label in found]
