"""Exact "text contains needle" join.

Needles that fit a few automata are sent to the tasks, which run over every text once per
automaton, in time linear in the text and its hits (Aho-Corasick). Nothing is shuffled and
no text is copied.

Beyond that the join is an equi-join. A run of word characters inside a needle can only
occur inside a run of word characters of the text. So every needle gets one of its runs
as *anchor*; texts are cut into the distinct windows that start at each position of
their runs, and a window head equal to an anchor is a hit. Needles of several runs are
then checked against the text itself.

Nothing is lost and nothing is compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from procura.operators.joins import BROADCAST_BYTES, lookup_join

# UTF-8 bytes of the needles of one automaton (some 60 times that in a task's memory), and
# how many automata, each a pass over the texts, are used before windows are shuffled.
AUTOMATON_BYTES, AUTOMATA = 4 * 1024 * 1024, 8

_RUN = "[a-zа-я0-9]"
_LONG = 4  # a run this long is preferred as a key
_MAX = 64  # longest window; longer anchors are keyed on their head, then checked
_PART = 100_000  # characters of a text looked at in one piece
_MARK = "\0"
_KEY_BYTES = 128
_SINGLE = f"^{_RUN}{{1,{_MAX}}}$"


def _closed(needle: Column) -> Column:
    """Runs that end inside the needle, so that they end in the text as well."""
    return F.regexp_extract_all(needle, F.lit(f"{_RUN}+(?=[^{_RUN[1:]})"), F.lit(0))


def _runs(needle: Column) -> Column:
    """Distinct runs a needle may be keyed on: long ones first, closed ones first."""
    every = F.regexp_extract_all(needle, F.lit(f"{_RUN}+"), F.lit(0))

    def long(runs: Column) -> Column:
        return F.filter(runs, lambda r: F.length(r) >= _LONG)

    closed = long(_closed(needle))
    chosen = (
        F.when(F.size(closed) > 0, closed)
        .when(F.size(long(every)) > 0, long(every))
        .when(F.size(_closed(needle)) > 0, _closed(needle))
        .otherwise(every)
    )
    return F.array_distinct(chosen)


def anchored(needles: DataFrame) -> DataFrame:
    """``needle, key, check, whole`` for a table of distinct, non-empty needles.

    ``check``: the text itself must be asked. ``whole``: the key is all that is left of
    a run where it occurs, which spares the question for longer words. Of several runs
    the rarest long one among all needles is the key, so that a word common to many
    needles does not gather all of them under one key. The few needles without any
    word character are keyed on their first characters, whatever those are; a mark in
    front keeps the two kinds of key apart.
    """
    single = needles.filter(F.col("needle").rlike(_SINGLE)).select(
        "needle",
        F.col("needle").alias("key"),
        F.lit(False).alias("check"),
        F.lit(False).alias("whole"),
    )
    other = needles.filter(~F.col("needle").rlike(_SINGLE)).select(
        "needle", _runs(F.col("needle")).alias("runs")
    )
    runs = other.select("needle", F.explode("runs").alias("run"))
    spread = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("needle").orderBy("n", F.length("run").desc(), "run")
    multi = (
        lookup_join(runs, spread, ["run"], fits=False)
        .withColumn("rn", F.row_number().over(rarest))
        .filter(F.col("rn") == 1)
        .select(
            "needle",
            F.left("run", F.lit(_MAX)).alias("key"),
            F.lit(True).alias("check"),
            (
                F.array_contains(_closed(F.col("needle")), F.col("run"))
                & (F.length("run") < _MAX)
            ).alias("whole"),
        )
    )
    bare = other.filter(F.size("runs") == 0).select(
        "needle",
        F.concat(F.lit(_MARK), F.left("needle", F.lit(_LONG))).alias("key"),
        F.lit(True).alias("check"),
        F.lit(False).alias("whole"),
    )
    return single.unionByName(multi).unionByName(bare)


def _windows(texts: DataFrame, keep: list[str], shortest: int, marks: bool) -> DataFrame:
    """One row per window of a text, distinct within a part: ``*keep, window``.

    A very long text is cut into parts first, which overlap by the longest window, so
    that no task holds all windows of it at once and no window is lost at a cut.
    """
    cut = f"(?s)(?=(.{{1,{_PART + _MAX}}})).{{1,{_PART}}}"
    parts = F.when(F.length("hay") <= _PART, F.array("hay")).otherwise(
        F.regexp_extract_all(F.col("hay"), F.lit(cut), F.lit(1))
    )
    texts = texts.select(*keep, F.explode(parts).alias("part"))
    windows = F.regexp_extract_all(
        F.col("part"), F.lit(f"(?=({_RUN}{{{shortest},{_MAX}}}))"), F.lit(1)
    )
    if marks:
        any_chars = F.regexp_extract_all(
            F.col("part"), F.lit(f"(?s)(?=(.{{1,{_LONG}}}))"), F.lit(1)
        )
        marked = F.transform(F.array_distinct(any_chars), lambda g: F.concat(F.lit(_MARK), g))
        windows = F.concat(windows, marked)
    return texts.select(*keep, F.explode(F.array_distinct(windows)).alias("window"))


def _keys(windows: DataFrame, keep: list[str], table: DataFrame, short: list[int], fits: bool) -> DataFrame:
    """One row per window and key length that may match: ``*keep, key, full``.

    Most windows start no key at all. The first characters of the long keys, each with
    the lengths in use behind it, are looked up before a window is repeated for its
    lengths; only keys shorter than that are tried on every window.
    """
    heads = (
        table.filter(F.length("key") >= _LONG)
        .select(F.left("key", F.lit(_LONG)).alias("_head"), F.length("key").alias("_size"))
        .groupBy("_head")
        .agg(F.collect_set("_size").alias("_sizes"))
    )
    headed = windows.withColumn("_head", F.left("window", F.lit(_LONG)))
    none = F.array().cast("array<int>")
    few = F.array(*[F.lit(s) for s in short]) if short else none
    how = "left" if short else "inner"
    headed = headed.join(F.broadcast(heads) if fits else heads, "_head", how)
    sizes = F.concat(few, F.coalesce("_sizes", none)) if short else F.col("_sizes")
    return (
        headed.select(*keep, "window", F.explode(sizes).alias("size"))
        .filter(F.col("size") <= F.length("window"))
        .select(
            *keep,
            F.left("window", F.col("size")).alias("key"),
            (F.col("size") == F.length("window")).alias("full"),
        )
    )


def split_needles(needles: Sequence[str], most: int) -> list[list[str]]:
    """Sorted needles in groups of at most ``most`` bytes (a longer needle is alone).

    Neighbours share their first characters, and so the nodes of an automaton.
    """
    groups: list[list[str]] = []
    size = 0
    for needle in sorted(needles):
        own = len(needle.encode("utf-8", "surrogatepass"))
        if not groups or size + own > most:
            groups.append([])
            size = 0
        groups[-1].append(needle)
        size += own
    return groups


def scan(texts: DataFrame, needles: Sequence[str], carry: list[str]) -> DataFrame:
    """``*carry, needle``, once for each text and needle in it: one automaton, one pass."""
    sent = texts.sparkSession.sparkContext.broadcast(list(needles))
    kept = texts.select(*carry, "hay")
    schema = StructType([kept.schema[c] for c in carry]).add("needle", "string", False)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for needle in sent.value:
            automaton.add_word(needle, needle)
        automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for row, hay in enumerate(batch.column("hay").to_pylist()):
                found = {needle for _, needle in automaton.iter(hay)} if hay else ()
                rows += [row] * len(found)
                hits += found
            taken = batch.select(carry).take(pa.array(rows, pa.int64()))
            columns = [*taken.columns, pa.array(hits, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*carry, "needle"])

    return kept.mapInArrow(find, schema)


def find_needles(
    texts: DataFrame,
    needles: DataFrame,
    carry: list[str],
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``*carry, needle`` for each text that contains a needle; may repeat rows.

    ``texts`` has ``hay`` and the columns of ``carry``, which identify a text.
    ``needles`` has one column ``needle``. Aggregates over the needles measure them: their
    size decides between automata, windows against a broadcast, and a salted shuffle.
    """
    needles = needles.filter(F.col("needle") != "").distinct()
    size = needles.agg(F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()[0]
    if size <= min(limit, AUTOMATA * AUTOMATON_BYTES):
        groups = split_needles([r["needle"] for r in needles.collect()], AUTOMATON_BYTES)
        if not groups:
            return texts.select(*carry, F.lit("").alias("needle")).filter(F.lit(False))
        return reduce(DataFrame.unionByName, [scan(texts, g, carry) for g in groups])
    facts = (
        needles.select("needle", F.explode_outer(_runs(F.col("needle"))).alias("run"))
        .agg(
            F.coalesce(F.sum(F.octet_length("needle") + _KEY_BYTES), F.lit(0)).alias("bytes"),
            F.collect_set(F.least(F.length("run"), F.lit(_MAX))).alias("words"),
            F.collect_set(
                F.when(F.col("run").isNull(), F.least(F.length("needle"), F.lit(_LONG)))
            ).alias("heads"),
            F.approx_count_distinct(F.left("run", F.lit(_LONG))).alias("n_heads"),
        )
        .first()
    )
    words, heads = facts["words"], [1 + n for n in facts["heads"]]
    if not words and not heads:
        return texts.select(*carry, F.lit("").alias("needle")).filter(F.lit(False))
    table = anchored(needles)
    fits = facts["bytes"] <= limit
    # There are as many heads as kinds of four characters, however many needles.
    heads_fit = fits or facts["n_heads"] * _KEY_BYTES <= limit
    short = sorted({n for n in (*words, *heads) if n < _LONG})
    kept = [*carry, "hay"] if fits else carry
    windows = _windows(texts, kept, min(words, default=_MAX), bool(heads))
    keys = _keys(windows, kept, table, short, heads_fit)
    holds = F.contains(F.col("hay"), F.col("needle"))
    if fits:
        found = keys.join(F.broadcast(table), "key").filter(~F.col("whole") | F.col("full"))
        return found.filter(~F.col("check") | holds).select(*carry, "needle")
    found = lookup_join(keys, table, ["key"], fits=False)
    found = found.filter(~F.col("whole") | F.col("full"))
    sure = found.filter(~F.col("check")).select(*carry, "needle")
    # Only texts with a possible hit come back for the check.
    possible = found.filter("check").select(*carry, "needle").distinct()
    checked = texts.select(*carry, "hay").join(possible, carry).filter(holds)
    return sure.unionByName(checked.select(*carry, "needle"))
