"""Model answers to typed columns, through VARIANT; no answer fails a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura import vocab
from procura.functions import text
from procura.operators.joins import once

_INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"


def _kind(v: Column) -> Column:
    """Type name of a variant value; NULL when the key is missing."""
    return F.schema_of_variant(v)


def _is_object(doc: Column) -> Column:
    return F.coalesce(F.startswith(_kind(doc), F.lit("OBJECT")), F.lit(False))


def _text(doc: Column, key: str) -> Column:
    """Text of a key; '' when missing or null, JSON text for nested values."""
    return text.strip(
        F.coalesce(F.try_variant_get(doc, f"$.{key}", "string"), F.lit(""))
    )


def _number(doc: Column, key: str) -> Column:
    """``struct(valid, value)``: whole number of a key, truncated toward zero.

    Numbers, booleans and integer texts are valid; a missing key is 0.
    """
    value = F.try_variant_get(doc, f"$.{key}", "variant")
    kind = _kind(value)
    raw = text.strip(F.try_variant_get(doc, f"$.{key}", "string"))
    as_text = F.replace(raw, F.lit("_"), F.lit(""))
    numeric = (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | F.startswith(
        kind, F.lit("DECIMAL")
    )
    integer_text = (kind == "STRING") & raw.rlike(_INTEGER)
    # Doubles hold any magnitude, which matters only for clamping.
    number = (
        F.when(numeric, F.try_variant_get(doc, f"$.{key}", "double"))
        .when(kind == "BOOLEAN", F.try_variant_get(doc, f"$.{key}", "boolean").cast("int"))
        .when(integer_text, as_text.try_cast("double"))
        .when(kind.isNull(), F.lit(0))
    )
    return F.struct(number.isNotNull().alias("valid"), number.alias("value"))


def _parse(
    response: Column, doc: Column, number: Column, tags: Sequence[str], default_tag: str
) -> Column:
    tag = _text(doc, "classification_tag")
    comment = _text(doc, "classification_comment")
    analysis = _text(doc, "analysis_markdown")
    raw = text.strip(F.coalesce(response, F.lit("")))
    return F.when(
        _is_object(doc) & number["valid"],
        payload(
            F.when(tag.isin(*tags), tag).otherwise(default_tag),
            F.greatest(F.lit(0), F.least(F.lit(100), number["value"])),
            F.coalesce(F.nullif(comment, F.lit("")), F.lit(vocab.NO_COMMENT)),
            F.coalesce(F.nullif(analysis, F.lit("")), raw),
        ),
    ).otherwise(
        payload(F.lit(default_tag), F.lit(0), F.lit(vocab.NOT_JSON_COMMENT), raw)
    )


def payload(tag: Column, confidence: Column, comment: Column, analysis: Column) -> Column:
    return F.struct(
        tag.alias("classification_tag"),
        confidence.cast("int").alias("confidence_percent"),
        comment.alias("classification_comment"),
        analysis.alias("analysis_markdown"),
    )


def no_files_payload() -> Column:
    return payload(
        F.lit(vocab.DEFAULT_TAG),
        F.lit(0),
        F.lit(vocab.NO_FILES_COMMENT),
        F.lit(vocab.NO_FILES_ANALYSIS),
    )


def provider_error_payload(error: Column) -> Column:
    return payload(
        F.lit(vocab.DEFAULT_TAG),
        F.lit(0),
        F.concat(F.lit(vocab.PROVIDER_ERROR_PREFIX), error),
        error,
    )


def classify(
    answers: DataFrame,
    tags: Sequence[str] = vocab.TAGS,
    default_tag: str = vocab.DEFAULT_TAG,
) -> DataFrame:
    """Add ``payload`` to rows with ``response`` and ``error``.

    Fields ``classification_tag, confidence_percent, classification_comment,
    analysis_markdown``. An error gives the error payload. Anything that is not a JSON
    object with a readable confidence gives the fallback payload, with the raw text as
    analysis. Each answer is parsed once.
    """
    read = once(answers, _doc=F.try_parse_json(F.col("response")))
    read = once(read, _number=_number(F.col("_doc"), "confidence_percent"))
    parsed = _parse(F.col("response"), F.col("_doc"), F.col("_number"), tags, default_tag)
    failed = F.col("error").isNotNull()
    return read.withColumn(
        "payload", F.when(failed, provider_error_payload(F.col("error"))).otherwise(parsed)
    ).drop("_doc", "_number")


def parse_matches(answers: DataFrame) -> DataFrame:
    """Add ``valid, chosen, confidence`` to rows with ``response`` and ``error``.

    An empty or null confidence is 0; one that is no whole number makes the answer
    invalid, as does anything that is not a JSON object, or an error.
    """
    doc = F.col("_doc")
    kind = _kind(F.try_variant_get(doc, "$.confidence", "variant"))
    as_text = F.try_variant_get(doc, "$.confidence", "string")
    blank = F.coalesce(
        (kind == "VOID") | ((kind == "STRING") & (as_text == "")) | as_text.isin("[]", "{}"),
        F.lit(False),
    )
    read = once(answers, _doc=F.try_parse_json(F.col("response")))
    read = once(read, _number=_number(doc, "confidence"), _blank=blank)
    valid = _is_object(doc) & (F.col("_number.valid") | F.col("_blank"))
    return read.select(
        *answers.columns,
        (valid & F.col("error").isNull()).alias("valid"),
        _text(doc, "tender_id").alias("chosen"),
        F.when(F.col("_blank"), F.lit(0.0))
        .otherwise(F.col("_number.value"))
        .alias("confidence"),
    )


def stub_response(file_names: Column) -> Column:
    """Answer of the built-in test scorer for an array of file names."""
    names = F.coalesce(
        F.nullif(F.array_join(file_names, ", "), F.lit("")), F.lit(vocab.STUB_NO_FILES)
    )
    before, after = vocab.STUB_COMMENT.split("{files}")
    return F.to_json(
        F.struct(
            F.lit(vocab.DEFAULT_TAG).alias("classification_tag"),
            F.lit(vocab.STUB_CONFIDENCE).alias("confidence_percent"),
            F.concat(F.lit(before), names, F.lit(after)).alias("classification_comment"),
            F.lit(vocab.STUB_ANALYSIS).alias("analysis_markdown"),
        )
    )
