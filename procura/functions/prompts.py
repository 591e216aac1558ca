"""Prompt texts as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from procura import vocab
from procura.functions import cells


def analysis_prompt(
    url: Column, template: str, tags: Sequence[str] = vocab.TAGS
) -> Column:
    """Classification prompt: link, the caller's template, the answer contract."""
    before, rest = vocab.ANALYSIS_PROMPT.split("{url}")
    # The template is the caller's text and is inserted as it is.
    middle, after = rest.split("{template}")
    tail = after.format(tags=", ".join(tags))
    return F.concat(F.lit(before), url, F.lit(middle + template + tail))


def option_line(tender_id: Column, title: Column, customer: Column, deadline: Column) -> Column:
    shown = F.coalesce(F.nullif(customer, F.lit("")), F.lit("-"))
    return F.concat(
        F.lit('- "'),
        tender_id,
        F.lit('": '),
        title,
        F.lit(" | заказчик: "),
        shown,
        F.lit(" | дедлайн: "),
        cells.option_deadline(deadline),
    )


def match_prompt(
    name: Column,
    sample: Column,
    options: Column,
    fragment_chars: int | None = vocab.FRAGMENT_CHARS,
) -> Column:
    """Match prompt: file name, text fragment, one line per option.

    The prompt shows a fragment of the text by design; ``fragment_chars=None`` puts
    in the whole text.
    """
    fragment = F.coalesce(sample, F.lit(""))
    if fragment_chars is not None:
        fragment = F.left(fragment, F.lit(fragment_chars))
    return F.concat(
        F.lit(vocab.MATCH_PROMPT_HEAD),
        name,
        F.lit(vocab.MATCH_PROMPT_TEXT),
        F.coalesce(F.nullif(fragment, F.lit("")), F.lit(vocab.MATCH_NO_TEXT)),
        F.lit(vocab.MATCH_PROMPT_OPTIONS),
        options,
    )
