"""Near-duplicate documents by MinHash with tensored banding.

A table key is a pair (i-th key of a first collection, j-th key of a second one). With
``tables`` keys of ``rows`` minhashes in each collection there are ``tables ** 2`` tables
of ``2 * rows`` minhashes, out of ``2 * rows * tables`` hash functions only. Two sets of
similarity s meet in some table with probability (1 - (1 - s^rows)^tables)^2: 0.9999 for
s = 0.75 and the defaults.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.common import bucket, buckets, mix, shingles
from procura.llm.components import components
from procura.operators.joins import checkpointed

# Rows of one bucket that are compared at once.
BLOCK = 512
# Pairs compared at once inside a task.
PAIRS = 200_000
# Minhashes of the wide sketch, made only for documents that share a key with another.
WIDE = 512
# Standard deviations below the threshold at which the wide sketch rules a pair out: of a
# million pairs exactly at the threshold, 3 are.
SIGMAS = 4.5

_SKETCH = "_doc long, n_shingles long, _h1 long, _h2 long, _a array<long>, _b array<long>"


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``n`` multiply-shift hash functions."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def _minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The minhashes (one row per set, none empty) under ``n`` functions."""
    values, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    a, b = _functions(n)
    out = np.empty((len(sets), n), np.uint32)
    for k in range(n):
        h = ((values * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def _keys(minhashes: np.ndarray, first: int, rows: int, tables: int) -> np.ndarray:
    """One 64-bit key for each group of ``rows`` minhashes, different in every slot."""
    out = np.empty((len(minhashes), tables), np.uint64)
    for t in range(tables):
        key = np.full(len(minhashes), first + t + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minhashes[:, (first + t) * rows + r])
        out[:, t] = key
    return out


def _bytes(minhashes: np.ndarray) -> np.ndarray:
    """One mixed byte of every minhash."""
    return (mix(minhashes.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def _set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set (none empty), in any order of its members."""
    values, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    h1 = np.add.reduceat(mix(values + np.uint64(1)), starts)
    return h1.view(np.int64), np.add.reduceat(mix(values ^ np.uint64(0xD6E8FEB86659FD93)), starts).view(np.int64)


def sketches(docs: DataFrame, id_column: str, text: str, width: int, rows: int, tables: int) -> DataFrame:
    """Per row: set size, 128-bit set hash, the keys of both collections.

    Texts are worked off in slices of about a million shingles, so memory follows the
    longest text and not the batch.
    """

    def pack(ids: list, sets: list[np.ndarray]) -> pd.DataFrame:
        full = [k for k, s in enumerate(sets) if len(s)]
        h1, h2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        a, b = [None] * len(sets), [None] * len(sets)
        if full:
            chosen = [sets[k] for k in full]
            h1[full], h2[full] = _set_hashes(chosen)
            m = _minhashes(chosen, 2 * rows * tables)
            left = _keys(m, 0, rows, tables).view(np.int64)
            right = _keys(m, tables, rows, tables).view(np.int64)
            for row, k in enumerate(full):
                a[k], b[k] = left[row], right[row]
        return pd.DataFrame(
            {"_doc": pd.array(ids, "Int64"), "n_shingles": list(map(len, sets)), "_h1": h1, "_h2": h2, "_a": a, "_b": b}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, sets, size = [], [], 0
            for i, t in zip(batch["_doc"], batch["_text"], strict=True):
                ids.append(None if pd.isna(i) else int(i))
                sets.append(shingles(t if isinstance(t, str) else None, width))
                size += len(sets[-1])
                if size > 500_000:
                    yield pack(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield pack(ids, sets)

    # Ids travel as text: a null would turn a column of longs into doubles.
    rows_in = docs.select(F.col(id_column).cast("string").alias("_doc"), F.col(text).alias("_text"))
    return rows_in.mapInPandas(run, _SKETCH)


def _pairs_in_groups(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (i < j) within runs of equal ``group`` values, a slice at a time."""
    n = len(group)
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, n)
    end_of = np.repeat(ends, np.diff(np.append(0, ends)))
    later = end_of - np.arange(n) - 1  # partners after each row
    cuts = np.searchsorted(np.cumsum(later), np.arange(PAIRS, later.sum() + PAIRS, PAIRS), "left") + 1
    start = 0
    for stop in np.unique(np.minimum(cuts, n)):
        count = later[start:stop]
        i = np.repeat(np.arange(start, stop), count)
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        start = stop


def _compared(buckets: DataFrame, threshold: float, tables: int) -> DataFrame:
    """Pairs of different components that share a table and may be similar enough.

    Buckets hold the rows of one key of the first collection; two of them share a table
    when they also share a key of the second. They arrive as runs in sorted partitions,
    cut to blocks of bounded size; the run that a batch ends in waits for the next batch.
    A pair counts in the first bucket it shares only. It is ruled out by the sizes of its
    sets (exact) or by a wide sketch that agrees ``SIGMAS`` standard deviations less than
    the threshold demands.
    """
    expected = WIDE * (threshold + (1 - threshold) / 256)
    least = expected - SIGMAS * float(np.sqrt(WIDE * threshold * (1 - threshold)))
    run_of = ["_key", "_p", "_q"]

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        where = rows[run_of].to_numpy(np.int64)
        group = np.cumsum(np.append(0, (np.diff(where, axis=0) != 0).any(axis=1)))
        wide = np.frombuffer(b"".join(rows["_wide"]), np.uint8).reshape(len(rows), -1)
        keys = np.array(rows["_keys"].tolist(), np.int64)
        doc, comp, size, side, slot = (rows[c].to_numpy(np.int64) for c in ("_rep", "_comp", "n_shingles", "_side", "_slot"))
        cross = where[:, 1] != where[:, 2]
        for i, j in _pairs_in_groups(group):
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = (comp[i] != comp[j]) & (low >= threshold * high) & (~cross[i] | (side[i] != side[j]))
            i, j = i[ok], j[ok]
            same = keys[i] == keys[j]
            ok = same[:, tables:].any(axis=1) & (same[:, :tables].argmax(axis=1) == slot[i])
            i, j = i[ok], j[ok]
            ok = (wide[i] == wide[j]).sum(axis=1) >= least
            if ok.any():
                i, j = i[ok], j[ok]
                yield pd.DataFrame({"a": np.minimum(doc[i], doc[j]), "b": np.maximum(doc[i], doc[j])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            open_run = (rows[run_of] == rows[run_of].iloc[-1]).all(axis=1)
            kept = rows[open_run]
            yield from pairs(rows[~open_run].reset_index(drop=True)) if not open_run.all() else ()
        if kept is not None:
            yield from pairs(kept.reset_index(drop=True))

    return (
        buckets.repartition(*run_of).sortWithinPartitions(*run_of)
        .select(*run_of, "_side", "_slot", "_rep", "_comp", "n_shingles", "_keys", "_wide")
        .mapInPandas(run, "a long, b long")
    )


def _sets(texts: DataFrame, classes: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """The shingle sets and wide sketches of the classes in ``named``, made from texts.

    Where an id comes with several texts, the one counts that its class was made of.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.iloc[lo : lo + 128]
                sets = [shingles(t, width) for t in part["_text"]]
                own = [k for k, s in enumerate(sets) if len(s)]
                if not own:
                    continue
                h1, h2 = _set_hashes([sets[k] for k in own])
                same = (h1 == part["_h1"].to_numpy()[own]) & (h2 == part["_h2"].to_numpy()[own])
                own = [k for k, ok in zip(own, same, strict=True) if ok]
                if own:
                    wide = _bytes(_minhashes([sets[k] for k in own], WIDE))
                    yield pd.DataFrame({
                        "_rep": part["_rep"].to_numpy()[own], "_set": [sets[k].view(np.int64) for k in own], "_wide": [w.tobytes() for w in wide]
                    })

    wanted = named.join(classes.select("_rep", "_h1", "_h2"), "_rep")
    # Most texts are in no bucket of the wanted ones and stay where they are.
    near = texts.withColumn("_bucket", bucket("_rep")).join(buckets(named, "_rep"), "_bucket", "left_semi")
    made = near.drop("_bucket").join(wanted, "_rep").mapInPandas(run, "_rep long, _set array<long>, _wide binary")
    return checkpointed(made)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""
    left = sets.select(F.col("_rep").alias("a"), F.col("_set").alias("_sa"))
    right = sets.select(F.col("_rep").alias("b"), F.col("_set").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    union = F.size("_sa") + F.size("_sb") - both
    return checkpointed(
        pairs.join(left, "a").join(right, "b").where(100 * both >= percent * union).select("a", "b").distinct()
    )


def _in_tables(meets: DataFrame, classes: DataFrame, merged: DataFrame, sets: DataFrame, tables: int, percent: int) -> DataFrame:
    """Pairs of classes in different components that meet in a table."""
    comp = F.coalesce("component", "_rep").alias("_comp")
    labelled = (
        meets.where(F.col("_slot") < tables).join(merged.withColumnRenamed("node", "_rep"), "_rep", "left")
        .select("_rep", "_slot", "_key", comp)
    )
    blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")
    mixed = labelled.groupBy("_key").agg(F.min("_comp").alias("lo"), F.max("_comp").alias("hi"), blocks).where("lo < hi")
    block = F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int").alias("_block")
    placed = labelled.join(mixed.select("_key", "_blocks"), "_key").select("*", block)
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    buckets = placed.select(
        "_key", "_slot", "_rep", "_comp",
        F.least("_block", "_other").alias("_p"),
        F.greatest("_block", "_other").alias("_q"),
        (F.col("_block") > F.col("_other")).cast("int").alias("_side"),
    )
    own = classes.select("_rep", "n_shingles", F.concat("_a", "_b").alias("_keys")).join(sets.select("_rep", "_wide"), "_rep")
    return checkpointed(_compared(buckets.join(own, "_rep"), percent / 100, tables))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 75,
    rows: int = 3,
    tables: int = 18,
) -> DataFrame:
    """``id_column, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked when ``100 * |intersection| >= percent * |union|`` of their
    sets of word shingles. Steps:

    1. Rows with equal sets are one class, named by its smallest id; copies never meet.
    2. Classes that share a key of either collection with another are grouped by it, and
       every member is compared with one leader, the class that meets most others. What
       this links is merged.
    3. Only where a group still holds two components are tables formed: its rows meet by
       a key of the first collection, and two share a table when a key of the second
       agrees too. Buckets are cut to blocks; pairs of different components are tested on
       sizes and sketches there. A large bucket takes more block pairs, not larger tasks.
    4. All pairs found are confirmed on full sets; components of the confirmed links.

    A text that is null, empty or without words has 0 shingles and links with nothing.
    A null id: the row is kept, with a null component, and links with nothing. Rows that
    repeat an id are judged each by its own text. Other columns are not read.
    """
    base = checkpointed(sketches(docs, id_column, text, width, rows, tables))
    usable = base.where("_doc IS NOT NULL AND n_shingles > 0")
    classes = checkpointed(
        usable.groupBy("_h1", "_h2", "n_shingles").agg(F.min(F.struct("_doc", "_a", "_b")).alias("r"))
        .select("_h1", "_h2", "n_shingles", F.col("r._doc").alias("_rep"), "r._a", "r._b")
    )
    slots = classes.select("_rep", F.posexplode(F.concat("_a", "_b")).alias("_slot", "_key"))
    shared = slots.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1")
    meets = checkpointed(slots.join(shared, "_key"))
    degree = meets.groupBy("_rep").agg(F.sum("n").alias("_degree"))
    texts = docs.select(F.col(id_column).alias("_rep"), F.col(text).alias("_text"))
    sets = _sets(texts, classes, degree.select("_rep"), width)
    leaders = meets.join(degree, "_rep").groupBy("_key").agg(F.max_by("_rep", F.struct("_degree", -F.col("_rep"))).alias("_leader"))
    first = (
        meets.join(leaders, "_key").where("_rep <> _leader")
        .select(F.least("_rep", "_leader").alias("a"), F.greatest("_rep", "_leader").alias("b")).distinct()
    )
    sizes = classes.select("_rep", "n_shingles")
    first = first.join(sizes.toDF("a", "_na"), "a").join(sizes.toDF("b", "_nb"), "b")
    first = first.where(F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * percent).select("a", "b")
    links = _confirmed(first, sets, percent)
    merged = components(links, "a", "b")
    more = _confirmed(_in_tables(meets, classes, merged, sets, tables, percent), sets, percent)
    joined = components(links.unionByName(more), "a", "b")
    named = classes.join(joined.withColumnRenamed("node", "_rep"), "_rep", "left").select(
        "_h1", "_h2", "n_shingles", F.coalesce("component", "_rep").alias("component")
    )
    out = base.select("_doc", "_h1", "_h2", "n_shingles").join(named, ["_h1", "_h2", "n_shingles"], "left")
    component = F.when(F.col("_doc").isNotNull(), F.coalesce("component", "_doc"))
    return out.select(
        F.col("_doc").alias(id_column),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("_doc") == component, F.lit(True)).alias("kept"),
    )
