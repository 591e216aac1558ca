"""Prompts, a pluggable scorer and its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura import vocab
from procura.functions import prompts, responses, text
from procura.operators.answers import Calls, Scorer, answered
from procura.operators.joins import BROADCAST_BYTES, checkpointed, lookup_join

# What files without candidates are offered: all lots, as one set.
EVERYONE = "*"
# Files that one copy of a set of options serves.
_FILES_PER_COPY = 1000


def run_scorer(
    requests: DataFrame,
    make_scorer: Callable[[], Scorer],
    key: str = "tender_id",
    calls: Calls = Calls(),
    store: str | None = None,
    version: str = "",
) -> DataFrame:
    """``key, files, response, error``: the answer of the scorer to every row.

    ``requests`` has ``key, prompt, files`` (array of paths). ``make_scorer`` runs once
    per task and returns ``scorer(prompt, files) -> text``. A failed call becomes the
    ``error`` of its row and never fails the task; ``calls`` has attempts, timeout and
    concurrency. The answers are written at once, so that using them twice does not ask
    the model twice. With ``store`` they are kept for later runs as well, by a digest of
    prompt, files and the scorer's ``version`` (see ``answers.answered``).
    """
    rows = requests.select(key, "prompt", "files")
    if store is not None:
        return checkpointed(answered(rows, make_scorer, store, calls, version).drop("prompt"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            asked = [(p, list(f) if f is not None else []) for p, f in zip(batch["prompt"], batch["files"])]
            replies = calls.ask_all(scorer, asked)
            answers, errors = [a for a, _ in replies], [e for _, e in replies]
            yield pd.DataFrame(
                {key: batch[key], "files": batch["files"], "response": answers, "error": errors}
            )

    kind = dict(requests.dtypes)[key]
    return checkpointed(
        rows.mapInPandas(call, f"`{key}` {kind}, files array<string>, response string, error string")
    )


def stub_scorer(requests: DataFrame, key: str = "tender_id") -> DataFrame:
    """The built-in test scorer, as an expression: same columns as ``run_scorer``."""
    names = F.transform("files", text.file_name)
    return requests.select(
        key,
        "files",
        responses.stub_response(names).alias("response"),
        F.lit(None).cast("string").alias("error"),
    )


def analysis_requests(
    lots: DataFrame,
    tender_files: DataFrame,
    template: str,
    tags: Sequence[str] = vocab.TAGS,
) -> DataFrame:
    """``tender_id, prompt, files, n_files`` for each tender.

    ``tender_files`` has ``tender_id, path, priority`` and is already cut to the files
    a model gets, so each list is short.
    """
    lists = tender_files.groupBy("tender_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("priority", "path"))), lambda s: s["path"]
        ).alias("files")
    )
    no_files = F.array().cast("array<string>")
    return (
        lots.select("tender_id", "url")
        .join(lists, "tender_id", "left")
        .withColumn("files", F.coalesce("files", no_files))
        .select(
            "tender_id",
            prompts.analysis_prompt(F.col("url"), template, tags).alias("prompt"),
            "files",
            F.size("files").alias("n_files"),
        )
    )


def classify_requests(
    requests: DataFrame, scorer: Callable[[DataFrame], DataFrame], skip_empty: bool = True
) -> DataFrame:
    """``tender_id, payload, files``: the scorer's answers, read.

    Requests have one row per lot. A scorer passes ``tender_id`` and ``files`` on, so its
    answers need no join back. Lots without files are not sent (``skip_empty``) and get a
    fixed payload.
    """
    sent = requests.filter(F.col("n_files") > 0) if skip_empty else requests
    read = responses.classify(scorer(sent)).select("tender_id", "payload", "files")
    if not skip_empty:
        return read
    unsent = requests.filter(F.col("n_files") == 0).select(
        "tender_id", responses.no_files_payload().alias("payload"), "files"
    )
    return read.unionByName(unsent)


def _line() -> Column:
    return prompts.option_line(
        F.col("tender_id"), F.col("title"), F.col("customer"), F.col("deadline_at")
    )


def match_requests(
    files: DataFrame,
    ranked: DataFrame,
    fragment_chars: int | None = vocab.FRAGMENT_CHARS,
) -> DataFrame:
    """``path, prompt, option_set`` for each readable file; the prompt lacks its options.

    ``option_set`` names rows of ``match_options``: the file's own candidates, or
    ``EVERYONE`` where it has none. The list of all lots is so written once, not once
    per file, however long it is. Texts are cut to the fragment before they move.
    """
    sample = F.col("text_sample")
    if fragment_chars is not None:
        sample = F.left(sample, F.lit(fragment_chars))
    short = files.select(
        "path",
        prompts.match_prompt(text.file_name(F.col("path")), sample, F.lit(""), None).alias("prompt"),
    )
    own = ranked.select("path", F.col("path").alias("_own")).distinct()
    return short.join(own, "path", "left").select(
        "path", "prompt", F.coalesce("_own", F.lit(EVERYONE)).alias("option_set")
    )


def match_options(ranked: DataFrame, lots: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``option_set, rn, tender_id, line``: candidates of each file by rank, and all lots.

    ``rn`` orders the lines of a set; lots of ``EVERYONE`` go by their id alone.
    """
    lines = lots.select("tender_id", _line().alias("line"))
    own = lookup_join(ranked.select("path", "tender_id", "rn"), lines, ["tender_id"], limit=limit)
    return own.select(F.col("path").alias("option_set"), "rn", "tender_id", "line").unionByName(
        lines.select(F.lit(EVERYONE).alias("option_set"), F.lit(0).alias("rn"), "tender_id", "line")
    )


def copies_of_sets(requests: DataFrame) -> DataFrame:
    """``option_set, _copies`` of the sets that more than ``_FILES_PER_COPY`` files need.

    Of these there are few, so requests find their set's copies without a shuffle by set:
    one that half of all files need never meets them in one task.
    """
    copies = F.ceil(F.count(F.lit(1)) / _FILES_PER_COPY).cast("int").alias("_copies")
    return checkpointed(requests.groupBy("option_set").agg(copies).filter("_copies > 1"))


def run_match_scorer(
    requests: DataFrame, options: DataFrame, make_scorer: Callable[[], Scorer]
) -> DataFrame:
    """``path, response, error``: prompts are put together where the scorer runs.

    A task meets a set of options once for all its files. The set of all lots is copied
    once per ``_FILES_PER_COPY`` files that need it; a prompt holds the whole set, so the
    memory of a task is that of one prompt and its list.
    """
    requests, options = requests.filter("option_set IS NOT NULL"), options.filter("option_set IS NOT NULL")
    many = copies_of_sets(requests)
    copies = F.coalesce("_copies", F.lit(1))
    copy = F.pmod(F.xxhash64("path"), copies).cast("int").alias("_copy")
    each = F.explode(F.sequence(F.lit(0), copies - 1)).alias("_copy")
    asked = lookup_join(requests, many, ["option_set"], "left").select("option_set", copy, "path", "prompt")
    listed = lookup_join(options, many, ["option_set"], "left").select("option_set", each, "rn", "tender_id", "line")
    keys = ["option_set", "_copy"]

    def call(files: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        # A set that no file needs is nothing to ask.
        scorer, answers, errors = make_scorer() if len(files) else None, [], []
        tail = "\n".join(lines.sort_values(["rn", "tender_id"])["line"])
        for prompt in files["prompt"]:
            try:
                answers.append(scorer(prompt + tail, []))
                errors.append(None)
            except Exception as problem:
                answers.append(None)
                errors.append(str(problem))
        return pd.DataFrame(
            {
                "path": files["path"].astype(object),
                "response": pd.Series(answers, dtype=object, index=files.index),
                "error": pd.Series(errors, dtype=object, index=files.index),
            }
        )

    met = asked.groupBy(*keys).cogroup(listed.groupBy(*keys))
    return checkpointed(met.applyInPandas(call, "path string, response string, error string"))
