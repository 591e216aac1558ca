"""Long lists of options in prompts of bounded length: pages are judged, winners meet again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.functions.responses import parse_matches
from procura.operators.answers import Calls, Scorer
from procura.operators.joins import BROADCAST_BYTES, checkpointed, fits_broadcast, lookup_join
from procura.operators.ordering import ordinal
from procura.operators.scoring import copies_of_sets

# Options that one prompt offers.
PAGE = 100
# Pages of a long set that meet the files of one copy in one task.
_PAGES_PER_PART = 1000
# Different lines that every task may hold, in bytes; beyond that pages are written with their lines.
LINES_BYTES = 32 * 1024 * 1024

_ANSWER = "path string, option_set string, _page int, _pages int, response string, error string"


def _copied(rows: DataFrame, table: DataFrame, many: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Both with ``_copy``: ``table`` repeats the sets that ``many`` names, each of ``rows`` meets one copy."""
    copies = F.coalesce("_copies", F.lit(1))
    dealt = lookup_join(rows, many, ["option_set"], "left", limit)
    dealt = dealt.withColumn("_copy", F.pmod(F.xxhash64("path"), copies).cast("int")).drop("_copies")
    copied = lookup_join(table, many, ["option_set"], "left", limit)
    return dealt, copied.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")


def _pages(options: DataFrame, page: int, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """``option_set, _page, _shown`` and, of sets longer than a page, ``option_set, tender_id, _at, _line``.

    ``options`` has ``option_set, tender_id, rn, _line``. Most sets are one page, which needs
    no numbers and is never looked up again. ``_shown`` has the numbers of lines in order.
    """
    options = options.filter("option_set IS NOT NULL")  # such sets are nobody's
    rows = options.groupBy("option_set").agg(F.count(F.lit(1)).alias("_n"))
    long = checkpointed(rows.filter(F.col("_n") > page).select("option_set"))
    fits = fits_broadcast(long, limit)
    first = F.min(F.struct("rn", "_line")).alias("_first")
    listed = F.sort_array(F.collect_list(F.struct("rn", "tender_id", "_line")))
    lines = lambda column: F.array_compact(F.transform(column, lambda o: o["_line"])).alias("_shown")
    # Sets of a page at most: all that is grouped here is dealt out once.
    short = lookup_join(options, long, ["option_set"], "left_anti", fits=fits).repartition("option_set")
    short = short.groupBy("option_set", "tender_id").agg(first).select("option_set", "tender_id", "_first.*")
    short = short.groupBy("option_set").agg(lines(listed)).select("option_set", F.lit(0).alias("_page"), "_shown")
    if long.isEmpty():
        return checkpointed(short), None
    once = lookup_join(options, long, ["option_set"], "left_semi", fits=fits)
    once = once.groupBy("option_set", "tender_id").agg(first).select("option_set", "tender_id", "_first.*")
    # The set of all lots is one group; its numbers come from ranges, not from one task.
    known = checkpointed(ordinal(once, [F.col("rn"), F.col("tender_id")], "_at", "option_set").drop("rn"))
    number = F.floor((F.col("_at") - 1) / page).cast("int").alias("_page")
    cut = known.groupBy("option_set", number).agg(lines(F.sort_array(F.collect_list(F.struct("_at", "_line")))))
    return checkpointed(short.unionByName(cut)), known


def _ask(
    requests: DataFrame,
    pages: DataFrame,
    lines: DataFrame,
    make_scorer: Callable[[], Scorer],
    calls: Calls,
    limit: int,
) -> DataFrame:
    """``path, option_set, _page, _pages, response, error``: every request to each page of its set.

    Where the pages fit in memory nothing is shuffled but requests to a size table; else
    requests and pages meet by set, so that a prompt moves once, not once per page. A set
    that many files need has a copy for some of them, and a long one is cut to parts. Lines
    are put in where the scorer is called, while the different ones fit there.
    """
    texts = None
    if fits_broadcast(lines, min(limit, LINES_BYTES)):
        texts = requests.sparkSession.sparkContext.broadcast({r["_line"]: r["line"] for r in lines.collect()})
    else:
        each = pages.select("option_set", "_page", F.posexplode_outer("_shown").alias("_at", "_line"))
        each = lookup_join(each, lines, ["_line"], "left", limit)
        told = F.transform(F.sort_array(F.collect_list(F.struct("_at", "line"))), lambda o: o["line"])
        pages = checkpointed(each.groupBy("option_set", "_page").agg(told.alias("_shown")))
    asked = ["path", "option_set", "_page", "_pages", "prompt", "_shown"]
    # A set without options is one empty page.
    pages_of = F.coalesce("_pages", F.lit(1)).alias("_pages")
    if fits_broadcast(pages, limit):
        counts = F.broadcast(pages.groupBy("option_set").agg(F.count(F.lit(1)).cast("int").alias("_pages")))
        sized = requests.join(counts, "option_set", "left").select("path", "prompt", "option_set", pages_of)
        each = sized.withColumn("_page", F.explode(F.sequence(F.lit(0), F.col("_pages") - 1)))
        asked = each.join(F.broadcast(pages), ["option_set", "_page"], "left").select(*asked)
    else:
        # Sets with many files or many pages are few; all others are one copy and one part.
        many = copies_of_sets(requests)
        long = pages.groupBy("option_set").agg(F.count(F.lit(1)).cast("int").alias("_pages")).filter(F.col("_pages") > 1)
        long = checkpointed(long)
        part = F.floor(F.col("_page") / _PAGES_PER_PART).cast("int")
        sized, copied = _copied(requests, pages.withColumn("_part", part), many, limit)
        sized = lookup_join(sized, long, ["option_set"], "left", limit)
        sized = sized.select("path", "prompt", "option_set", pages_of, "_copy")
        last = F.floor((F.col("_pages") - 1) / _PAGES_PER_PART).cast("int")
        sized = sized.withColumn("_part", F.explode(F.sequence(F.lit(0), last)))
        met = sized.join(copied, ["option_set", "_copy", "_part"], "left")
        asked = met.withColumn("_page", F.coalesce("_page", F.lit(0))).select(*asked)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            shown = [list(s) if s is not None else [] for s in batch["_shown"]]
            if texts is not None:
                shown = [[texts.value[n] for n in s] for s in shown]
            replies = calls.ask_all(scorer, [(p + "\n".join(s), []) for p, s in zip(batch["prompt"], shown)])
            answers, errors = [a for a, _ in replies], [e for _, e in replies]
            yield batch.drop(columns=["prompt", "_shown"]).assign(
                response=pd.Series(answers, dtype=object, index=batch.index),
                error=pd.Series(errors, dtype=object, index=batch.index),
            )

    return checkpointed(asked.mapInPandas(call, _ANSWER))


def run_match_tournament(
    requests: DataFrame,
    options: DataFrame,
    make_scorer: Callable[[], Scorer],
    page: int = PAGE,
    calls: Calls = Calls(),
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``path, response, error``: answers to match prompts that hold ``page`` options at most.

    ``requests`` and ``options`` are those of ``scoring.match_requests`` (paths are unique)
    and ``scoring.match_options``. The options of a set are cut to pages in their order, an
    id once; the options that answers to the pages of a file name meet in pages again, until
    one page is left, whose answer is the file's. So a file takes some
    ``options / page`` calls, in as many rounds as the logarithm of the options to the
    base ``page``, and no prompt and no task holds a whole long list. A scorer whose choice
    does not depend on what else is offered chooses as from one long prompt.

    An answer may name an option of another page of its set. Where no page names one, the
    answer is that to the first page; where all name the same, the first that does. A call
    that fails, or an answer that cannot be read, is the answer of its file (that of the
    first such page): the option it might have named is not known. A file whose set has no
    options is asked with an empty list.
    """
    if page < 2:
        raise ValueError("a page must hold two options or more")
    # Lines are numbered in their order and moved by number; each is written once.
    said = options.select("line").filter(F.col("line").isNotNull()).distinct()
    lines = checkpointed(ordinal(said, [F.col("line")], "_line"))
    keyed = lookup_join(options, lines, ["line"], "left", limit).select("option_set", "tender_id", "rn", "_line")
    pages, known = _pages(keyed, page, limit)
    waiting = requests.select("path", "prompt", "option_set")
    finished = []
    while True:
        read = parse_matches(_ask(waiting, pages, lines, make_scorer, calls, limit))
        finished.append(read.filter("_pages = 1").select("path", "response", "error"))
        if known is None:
            break
        read = read.filter("_pages > 1")
        named = read.filter(F.col("valid") & (F.upper("chosen") != "NONE"))
        named = named.select("path", "option_set", F.col("chosen").alias("tender_id"), "_page", "response")
        if fits_broadcast(known, limit):
            found = named.join(F.broadcast(known), ["option_set", "tender_id"])
        else:
            dealt, copied = _copied(named, known, copies_of_sets(waiting), limit)
            found = dealt.join(copied, ["option_set", "tender_id", "_copy"])
        winners = checkpointed(
            found.groupBy("path", "tender_id").agg(
                F.min("_at").alias("rn"),
                F.min("_line").alias("_line"),
                F.min(F.struct("_page", "response", F.lit(None).cast("string").alias("error"))).alias("_said"),
            )
        )
        said = F.struct("_page", "response", "error")
        heads = read.groupBy("path").agg(
            F.min(F.when(~F.col("valid"), said)).alias("_failed"), F.min(said).alias("_head")
        )
        met = winners.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.min("_said").alias("_one"))
        state = checkpointed(heads.join(met, "path", "left"))
        again = F.col("_failed").isNull() & (F.coalesce("_n", F.lit(0)) > 1)
        last = F.coalesce("_failed", "_one", "_head")
        finished.append(state.filter(~again).select("path", last["response"].alias("response"), last["error"].alias("error")))
        more = state.filter(again).select("path")
        if more.isEmpty():
            break
        waiting = requests.join(more, "path").select("path", "prompt", F.col("path").alias("option_set"))
        kept = winners.join(more, "path").select(F.col("path").alias("option_set"), "tender_id", "rn", "_line")
        pages, known = _pages(kept, page, limit)
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out
