"""Which tender does a file belong to: score, ranking, choice and band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura import vocab
from procura.functions import text
from procura.functions.responses import parse_matches
from procura.operators.joins import BROADCAST_BYTES, checkpointed, lookup_join
from procura.operators.needles import find_needles

# A needle found in more titles than this is scored per combination of such
# needles, not per title.
HOT_TITLES = 1000

# Needles are left unopened where bounds allow once one is in more titles than this.
PRUNE_TITLES = 256
# Titles that a file's rarest needles open before there is a bound.
OPENED = 256

_CLASS, _SHARED, _ID = 0, 1, 2
_POSTING_BYTES = 128


def _features(lots: DataFrame, stopwords: Sequence[str]) -> DataFrame:
    """``tender_id, features``: what a text must contain to score for a tender.

    A feature is ``(needle, weight, mult)``. A token that the title repeats is a
    repeated feature; the customer name adds weight but is no token.
    """
    long = vocab.LONG_TOKEN_CHARS
    by_token = F.transform(
        text.significant_tokens(F.col("title"), stopwords),
        lambda t: F.struct(
            t.alias("needle"),
            F.when(F.length(t) >= long, 2).otherwise(1).alias("weight"),
            F.lit(1).alias("mult"),
        ),
    )
    by_customer = F.filter(
        F.array(
            F.struct(
                text.normalize_name(F.coalesce(F.col("customer"), F.lit(""))).alias("needle"),
                F.lit(vocab.CUSTOMER_SCORE).alias("weight"),
                F.lit(0).alias("mult"),
            )
        ),
        lambda f: f["needle"] != "",
    )
    return lots.select(
        "tender_id", F.sort_array(F.concat(by_token, by_customer)).alias("features")
    ).filter(F.size("features") > 0)


def _smallest_ids(df: DataFrame, group: str, unit: str, top: int | None) -> DataFrame:
    """Rows with the ``top`` smallest tender ids of each group, and the group's id.

    The group's id is its smallest tender id. Equal scores rank by tender id, so
    no other member of a group can reach the top of any file.
    """
    if top is None:
        names = df.groupBy(group).agg(F.min("tender_id").alias(unit))
        named = lookup_join(df, names, [group])
        return named.withColumn("rn", F.when(F.col("tender_id") == F.col(unit), 1).otherwise(2))
    by_id = Window.partitionBy(group).orderBy("tender_id")
    ranked = df.withColumn("rn", F.row_number().over(by_id)).filter(F.col("rn") <= top)
    return ranked.withColumn(unit, F.min("tender_id").over(Window.partitionBy(group)))


def _few(mult: Column) -> Column:
    """What a score loses where few tokens are found."""
    return F.when(mult == 0, -3).when(mult == 1, -1).otherwise(0)


def _score() -> Column:
    summed = F.col("weight") + _few(F.col("mult")) + F.col("by_name")
    return F.when(F.col("kind") == _ID, F.lit(vocab.ID_SCORE)).otherwise(summed)


def _sum_of(features: Column, name: str) -> Column:
    """The sum of one field over an array; null for a null array."""
    return F.aggregate(features, F.lit(0).cast("long"), lambda total, f: total + f[name])


def openings(
    found: DataFrame, postings: DataFrame, kept: int | None, min_score: int, fits: bool
) -> DataFrame:
    """``path, by_name, needle, n, open``: the needles of a file whose titles matter.

    ``n`` counts the titles of a needle. A file's needles are ordered from rare to
    frequent. The rarest are opened; the ``kept``-th best score that their titles reach
    already is one that a title has to exceed or equal. What a title scores that holds
    frequent needles only is at most the sum of their weights: the longest tail of
    needles whose sum stays below stays closed. No title can enter the ``kept`` best
    through it. Needles of ids and of hot combinations are always opened, and their
    weights count in every bound.
    """
    per_unit = postings.groupBy("needle", "unit", "kind").agg(
        F.sum("weight").alias("weight"), F.sum("mult").alias("mult")
    )
    heavy = F.max(F.when(F.col("kind") != _ID, F.col("weight")))
    facts = per_unit.groupBy("needle").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(heavy, F.lit(0)).alias("_weight"),
        F.max("mult").alias("_mult"),
        F.max(F.col("kind") != _CLASS).alias("_fixed"),
    )
    whole = Window.partitionBy("path")
    by_rank = whole.orderBy(F.col("_fixed").desc(), "n", "needle")
    before = by_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = by_rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rare = lambda c: F.when(~F.col("_fixed"), c).otherwise(0)
    fixed = lambda c: F.when(F.col("_fixed"), c).otherwise(0)
    at_most = lambda c: F.sum(rare(F.col(c))).over(after) + F.sum(fixed(F.col(c))).over(whole)
    first = (F.sum(rare(F.col("n"))).over(before) <= OPENED) | (F.sum(rare(F.lit(1))).over(before) == 1)
    known = lookup_join(found, facts, ["needle"], fits=fits)
    # Written once: needles are looked for once, however often this is read below.
    known = checkpointed(
        known.select(
            "path", "by_name", "needle", "n",
            (F.col("_fixed") | first).alias("_first"),
            (at_most("_weight") + _few(at_most("_mult")) + F.col("by_name")).alias("_bound"),
        )
    )
    least = F.lit(min_score)
    if kept is not None:
        opened = lookup_join(known.filter("_first"), postings, ["needle"], fits=fits)
        units = opened.groupBy("path", "by_name", "unit", "kind").agg(
            F.sum("weight").alias("weight"), F.sum("mult").alias("mult")
        )
        best = Window.partitionBy("path").orderBy(F.col("_least").desc())
        reached = (
            units.select("path", _score().alias("_least"))
            .withColumn("_rn", F.row_number().over(best))
            .filter(F.col("_rn") <= kept)
            .filter(F.col("_rn") == kept)
            .drop("_rn")
        )
        known = known.join(reached, "path", "left")
        least = F.greatest(F.coalesce("_least", least), least)
    return known.select("path", "by_name", "needle", "n", (F.col("_first") | (F.col("_bound") >= least)).alias("open"))


def score_pairs(
    files: DataFrame,
    lots: DataFrame,
    *,
    top: int | None = vocab.TOP_CANDIDATES,
    min_score: int = vocab.MIN_SCORE,
    stopwords: Sequence[str] = vocab.STOPWORDS,
    generic_names: Sequence[str] = vocab.GENERIC_NAMES,
    project_markers: Sequence[str] = vocab.PROJECT_MARKERS,
    normalize_id: bool = False,
    hot_titles: int = HOT_TITLES,
    prune_titles: int = PRUNE_TITLES,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``path, tender_id, score`` of the pairs with at least ``min_score``.

    ``files`` has ``path, text_sample``; ``lots`` has one row per id (see
    ``one_per_id``) with ``tender_id, title, customer``. All pairs that can be among
    the ``top`` of their file are returned, with their exact score; ``top=None``
    returns every pair. A pair without a token or id hit stays below the default
    ``min_score``, so needles find all of them.

    Titles with the same features are one *class*. Of a class only the ``top``
    smallest ids can rank, so identical titles cost one row, not one per tender. A
    needle in more than ``hot_titles`` classes is hot. Classes found through no
    other needle score by their hot needles alone and are again grouped by them, so
    a boilerplate word never pairs every file with every title. The work per file
    is bounded by its rare needles and by the combinations of hot ones. Where a needle
    that is not hot is in more than ``prune_titles`` classes, needles that bring no title
    into the top of their file are not opened (``openings``); the result is the same.
    """
    # The tender side is used several times below; it is written once.
    lots = checkpointed(lots.select("tender_id", "title", "customer"))
    features = _features(lots, stopwords)
    classes = _smallest_ids(features, "features", "unit", top)
    heads = classes.filter(F.col("rn") == 1).select("unit", "features")
    exploded = heads.select("unit", F.explode("features").alias("f")).select(
        "unit", "f.needle", "f.weight", "f.mult"
    )
    per_needle = exploded.groupBy("needle").agg(F.count(F.lit(1)).alias("n"))
    id_needle = (
        text.normalize_name(F.col("tender_id")) if normalize_id else F.col("tender_id")
    )
    ids = lots.select(
        id_needle.alias("needle"),
        F.lit(None).cast("string").alias("shared"),
        F.col("tender_id").alias("unit"),
        F.lit(_ID).alias("kind"),
        F.lit(vocab.ID_SCORE).alias("weight"),
        F.lit(0).alias("mult"),
    ).filter(F.col("needle") != "")
    # One job measures all that may be broadcast: each posting and its unit.
    counted = per_needle.unionByName(ids.select("needle", F.lit(1).cast("long").alias("n")))
    facts = counted.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("hottest"),
        F.coalesce(
            F.sum(F.col("n") * (F.octet_length("needle") + _POSTING_BYTES)), F.lit(0)
        ).alias("bytes"),
    ).first()
    fits = facts["bytes"] <= limit
    members = classes.select("unit", F.lit(_CLASS).alias("kind"), "tender_id")
    id_members = lots.select(
        F.col("tender_id").alias("unit"), F.lit(_ID).alias("kind"), "tender_id"
    )

    if facts["hottest"] <= hot_titles:
        postings = exploded.select(
            "needle",
            F.lit(None).cast("string").alias("shared"),
            "unit",
            F.lit(_CLASS).alias("kind"),
            "weight",
            "mult",
        )
        any_hot = False
        rare_parts = heads.withColumnRenamed("features", "_rare")
    else:
        hot = per_needle.filter(F.col("n") > hot_titles).select("needle", F.lit(True).alias("hot"))
        marked = lookup_join(exploded, hot, ["needle"], "left", fits=fits)
        feature = F.struct("needle", "weight", "mult")
        sides = marked.groupBy("unit").agg(
            F.sort_array(F.collect_list(F.when(F.col("hot"), feature))).alias("hot_part"),
            F.collect_list(F.when(F.col("hot").isNull(), feature)).alias("rare_part"),
        )
        # Members of a hot combination: the smallest ids over all of its classes.
        with_ids = sides.join(classes.select("unit", "tender_id"), "unit")
        combos = _smallest_ids(
            with_ids.filter(F.size("hot_part") > 0), "hot_part", "shared", top
        )
        combo_heads = combos.filter(F.col("rn") == 1).select("hot_part", "shared")
        sides = lookup_join(sides, combo_heads, ["hot_part"], "left", fits=fits)
        postings = sides.select(
            "shared", "unit", F.lit(_CLASS).alias("kind"), F.explode("rare_part").alias("f")
        ).unionByName(
            combo_heads.select(
                "shared",
                F.col("shared").alias("unit"),
                F.lit(_SHARED).alias("kind"),
                F.explode("hot_part").alias("f"),
            )
        ).select("f.needle", "shared", "unit", "kind", "f.weight", "f.mult")
        members = members.unionByName(
            combos.select(
                F.col("shared").alias("unit"), F.lit(_SHARED).alias("kind"), "tender_id"
            )
        )
        any_hot = True
        rare_parts = sides.select("unit", F.col("rare_part").alias("_rare"))

    postings = postings.unionByName(ids)
    members = members.unionByName(id_members)
    texts = files.select(
        "path",
        F.concat(
            text.normalize_name(F.col("path")),
            F.lit(" "),
            text.normalize_name(F.coalesce(F.col("text_sample"), F.lit(""))),
        ).alias("hay"),
    )
    hits = find_needles(texts, postings.select("needle"), ["path"], limit)
    # The one shuffle of the match: each file's own needles, on its path. All that
    # follows is grouped by path and stays where it is.
    per_file = hits.repartition("path").dropDuplicates(["path", "needle"])
    name = text.normalize_name(text.file_name(F.col("path")))
    found = (
        per_file.withColumn("_name", name)
        .withColumn(
            "by_name",
            F.when(text.is_generic_name(F.col("_name"), generic_names), -2).otherwise(0)
            + F.when(text.is_project_name(F.col("_name"), project_markers), 2).otherwise(0),
        )
        .select("path", "by_name", "needle")
    )
    prune = facts["hottest"] > prune_titles
    if prune:
        postings = checkpointed(postings)
        planned = openings(found, postings, None if top is None else 3 * top, min_score, fits)
        found = planned.filter("open")
    units = (
        lookup_join(found, postings, ["needle"], fits=fits)
        .groupBy("path", "by_name", "shared", "unit", "kind")
        .agg(F.sum("weight").alias("weight"), F.sum("mult").alias("mult"))
    )
    if prune:
        # A title found through an open needle scores for its closed ones, too.
        closed = planned.filter(~F.col("open")).groupBy("path").agg(F.collect_list("needle").alias("_closed"))
        parts = rare_parts.withColumn("kind", F.lit(_CLASS))
        units = lookup_join(units.join(closed, "path", "left"), parts, ["unit", "kind"], "left", fits=fits)
        held = F.filter("_rare", lambda f: F.array_contains("_closed", f["needle"]))
        for column in ("weight", "mult"):
            units = units.withColumn(column, F.col(column) + F.coalesce(_sum_of(held, column), F.lit(0)))
        units = units.drop("_closed", "_rare")
    if any_hot:
        # Hot needles count for a class found by a rare one as well.
        combo = Window.partitionBy("path", "shared")
        is_class = (F.col("kind") == _CLASS) & F.col("shared").isNotNull()
        for column in ("weight", "mult"):
            hot_sum = F.max(F.when(F.col("kind") == _SHARED, F.col(column))).over(combo)
            units = units.withColumn(f"_{column}", hot_sum)
        for column in ("weight", "mult"):
            extra = F.coalesce(F.col(f"_{column}"), F.lit(0))
            units = units.withColumn(
                column, F.col(column) + F.when(is_class, extra).otherwise(0)
            )
    scored = units.select("path", "unit", "kind", _score().cast("int").alias("score")).filter(
        F.col("score") >= min_score
    )
    if top is not None:
        # A tender is in at most three units and each unit is named after its
        # smallest id, so no unit past these can bring a tender into the top.
        best = Window.partitionBy("path").orderBy(F.col("score").desc(), "unit")
        scored = (
            scored.withColumn("rn", F.row_number().over(best))
            .filter(F.col("rn") <= 3 * top)
            .drop("rn")
        )
    pairs = lookup_join(scored, members, ["unit", "kind"], fits=fits)
    return pairs.groupBy("path", "tender_id").agg(F.max("score").alias("score"))


def rank_candidates(pairs: DataFrame, top: int | None = vocab.TOP_CANDIDATES) -> DataFrame:
    """Best candidates per file, ``rn`` from 1: score descending, then id."""
    order = Window.partitionBy("path").orderBy(F.col("score").desc(), "tender_id")
    ranked = pairs.withColumn("rn", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rn") <= top)


def choose_by_margin(
    ranked: DataFrame,
    accept: int = vocab.ACCEPT_SCORE,
    margin: int = vocab.ACCEPT_MARGIN,
) -> DataFrame:
    """``path, tender_id, score`` of files whose best candidate is clear enough."""
    order = Window.partitionBy("path").orderBy("rn")
    second = F.lead("score", 1, 0).over(order)
    return (
        ranked.withColumn("second", second)
        .filter(
            (F.col("rn") == 1)
            & (F.col("score") >= accept)
            & (F.col("score") - F.col("second") >= margin)
        )
        .select("path", "tender_id", "score")
    )


def choose_by_response(
    responses: DataFrame,
    ranked: DataFrame,
    lots: DataFrame,
    min_confidence: int = vocab.MIN_CONFIDENCE,
    accept: int = vocab.ACCEPT_SCORE,
    limit: int = BROADCAST_BYTES,
    written: bool = False,
) -> DataFrame:
    """``path, tender_id, score`` from model answers.

    ``responses`` has ``path, response, error``. An answer is accepted when it is
    not NONE, is confident enough and names a candidate of its file; a file without
    ranked candidates may name any tender, which then scores ``accept``. Answers that
    cannot be read fall back to the margin test. ``ranked`` is read three times, and written
    for that unless it is ``written`` already.
    """
    ranked = ranked if written else checkpointed(ranked)
    parsed = checkpointed(
        parse_matches(responses).select("path", "valid", "chosen", "confidence")
    )
    ok = parsed.filter(
        F.col("valid")
        & (F.upper("chosen") != "NONE")
        & (F.col("confidence") >= min_confidence)
    ).select("path", F.col("chosen").alias("tender_id"))
    scored = ok.join(ranked.select("path", "tender_id", "score"), ["path", "tender_id"])
    open_files = ok.join(ranked.select("path").distinct(), "path", "left_anti")
    known = lots.select("tender_id").distinct()
    free = lookup_join(open_files, known, ["tender_id"], "left_semi", limit).select(
        "path", "tender_id", F.lit(accept).alias("score")
    )
    broken = parsed.filter(~F.col("valid")).select("path")
    by_margin = choose_by_margin(ranked.join(broken, "path", "left_semi"), accept)
    return scored.unionByName(free).unionByName(by_margin)


def band_files(
    assigned: DataFrame,
    accept: int = vocab.ACCEPT_SCORE,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Files of each tender within one point of its best score.

    The best score is a partial aggregate joined back, not a window: one tender may
    own a third of all files. Assignments are written first, so that the match
    behind them runs once.
    """
    assigned = checkpointed(assigned)
    best = assigned.groupBy("tender_id").agg(F.max("score").alias("top_score"))
    # The salted form holds for any skew; the best scores are one row per lot.
    banded = lookup_join(assigned, best, ["tender_id"], limit=limit)
    return banded.filter(
        F.col("score") >= F.greatest(F.lit(accept), F.col("top_score") - 1)
    ).drop("top_score")


def order_matched(files: DataFrame) -> DataFrame:
    """Matched files by tender, score descending, name, path."""
    name = F.lower(text.file_name(F.col("path")))
    return files.orderBy("tender_id", F.col("score").desc(), name, "path")


def order_by_path(files: DataFrame) -> DataFrame:
    """Files in path order, compared part by part: ``/`` sorts before any letter."""
    return files.orderBy(F.split("path", "/"))


def prioritize_files(
    files: DataFrame,
    top: int | None = vocab.FILES_PER_TENDER,
    group: str = "tender_id",
    keywords: Sequence[str] = vocab.PRIORITY_KEYWORDS,
    extensions: Sequence[str] = vocab.PRIORITY_EXTENSIONS,
) -> DataFrame:
    """The ``top`` most telling files per group, ``priority`` from 1.

    The rank limit is applied before the shuffle too, so a group of any size sends
    ``top`` rows per task.
    """
    name = text.file_name(F.col("path"))
    order = Window.partitionBy(group).orderBy(
        text.keyword_count(text.normalize_name(name), keywords).desc(),
        F.lower(text.suffix(F.col("path"))).isin(*extensions).desc(),
        F.lower(name),
        "path",
    )
    ranked = files.withColumn("priority", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("priority") <= top)
