"""Folder review: from lots and files to classified results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura import vocab
from procura.operators import matching, ordering, report, scoring, tiers, tournament
from procura.operators.answers import Calls
from procura.operators.joins import BROADCAST_BYTES, checkpointed
from procura.sources import inventory, listing


def files_of_lots(
    files: DataFrame,
    lots: DataFrame,
    max_files: int | None = vocab.FILES_PER_TENDER,
    folders: DataFrame | None = None,
    matcher: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None,
    limit: int = BROADCAST_BYTES,
    **score_options: object,
) -> DataFrame:
    """``tender_id, path, tier, priority`` of the files each tender is judged by.

    ``files`` has ``path, top_dir, text_sample``. ``matcher(files, ranked, lots)``
    replaces the margin test by another choice among the ranked candidates.
    """
    lots = listing.one_per_id(lots)
    named, hits = tiers.assign_tiers(files, lots, folders, limit)
    scoreable = tiers.without_explicit(lots, named)
    candidates = tiers.readable_files(tiers.scoreable_files(files))
    pairs = matching.score_pairs(candidates, scoreable, limit=limit, **score_options)
    # The match reads every text; what follows works on its few rows per file.
    ranked = checkpointed(matching.rank_candidates(pairs))
    if matcher is None:
        chosen = matching.choose_by_margin(ranked)
    else:
        chosen = matcher(candidates, ranked, lots)
    scored = matching.band_files(chosen, limit=limit)
    found = tiers.tender_files(files, named, hits, scored, max_files, limit)
    return matching.prioritize_files(found, max_files)


def model_matcher(
    make_scorer: Callable[[], scoring.Scorer],
    page: int | None = None,
    calls: Calls = Calls(),
) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """A matcher that asks a model; see ``scoring.run_match_scorer``.

    With ``page`` no prompt holds more options, and files without candidates choose from
    all lots by pages (``tournament.run_match_tournament``, which ``calls`` are for).
    """

    def choose(files: DataFrame, ranked: DataFrame, lots: DataFrame) -> DataFrame:
        requests = scoring.match_requests(files, ranked)
        options = scoring.match_options(ranked, lots)
        if page is None:
            answers = scoring.run_match_scorer(requests, options, make_scorer)
        else:
            answers = tournament.run_match_tournament(requests, options, make_scorer, page, calls)
        return matching.choose_by_response(answers, ranked, lots)

    return choose


def review(
    files: DataFrame,
    lots: DataFrame,
    template: str,
    scorer: Callable[[DataFrame], DataFrame] = scoring.stub_scorer,
    max_files: int = vocab.FILES_PER_TENDER,
    **options: object,
) -> DataFrame:
    """Result rows of the lots that have files; the others give no row."""
    chosen = checkpointed(files_of_lots(files, lots, max_files, **options))
    unique = listing.one_per_id(lots)
    requests = scoring.analysis_requests(unique, chosen, template).filter(F.col("n_files") > 0)
    return report.results(unique, scoring.classify_requests(requests, scorer))


def folder_files(binary: DataFrame, root: str) -> DataFrame:
    """Files of a folder and members of its archives: ``path, top_dir, text_sample``.

    ``binary`` has ``path, content``. Archives are opened once; the texts of files and
    members are written, as matching reads them more than once.
    """
    rows = binary.select("path", "content")
    members = inventory.expand_archives(rows).select("path", "content")
    plain = rows.filter(~inventory.is_archive(F.col("path")))
    texts = inventory.text_samples(plain.unionByName(members))
    return checkpointed(inventory.describe(texts, root).select("path", "top_dir", "text_sample"))


def review_folder(
    binary: DataFrame,
    root: str,
    lots: DataFrame,
    template: str,
    day: object | None = None,
    skip: int = 0,
    limit: int | None = None,
    **options: object,
) -> DataFrame:
    """A whole run from raw files and a listing to report rows.

    Archives are expanded; lots are those due on ``day`` (all without one), in working
    order, past ``skip`` and up to ``limit``; their results make the monthly sheets.
    """
    chosen = listing.one_per_id(lots)
    if day is not None:
        chosen = listing.due_on(chosen, day)
    chosen = checkpointed(ordering.queue(chosen, skip, limit))
    done = review(folder_files(binary, root), chosen, template, **options)
    return report.monthly(done.join(chosen.select("tender_id", "row_number"), "tender_id"))
