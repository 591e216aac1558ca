"""Near-duplicate vectors: int8 tile products with error bounds, exact where it matters.

Unit vectors are rounded to int8; the length of what rounding took away bounds the error
of every product. A tile of two blocks is multiplied as integers (in float32 registers,
where they are exact). Pairs whose bound stays below the threshold are dropped, pairs
certainly above it are links, and the few between are computed again in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.components import components
from procura.operators.joins import checkpointed

# Vectors of a block; a tile compares two blocks. Of tables with more than ``BLOCKS`` blocks
# the blocks grow instead, up to ``BLOCK_BYTES`` of vectors.
BLOCK, BLOCKS, BLOCK_BYTES = 4096, 32, 8 * 1024 * 1024
# Tasks that tiles are dealt to at most; each then takes several.
MOST_TASKS = 100_000
# Rows of a tile multiplied at once, with ``BLOCK`` others.
STRIP = 256
# More than all rounding of doubles and of single-precision scales together.
SLACK = 1e-5


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in doubles, without overflow or underflow of squares."""
    x = rows / np.abs(rows).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and a bound of the distance to the unit rows ``x``."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    gone = x - q * scale[:, None]
    return q, scale, np.sqrt((gone * gone).sum(axis=1)) * (1 + 1e-9) + 1e-15


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows; sums of 1,024 terms at most are exact in float32."""
    out = None
    for lo in range(0, a.shape[1], 1024):
        part = a[:, lo : lo + 1024].astype(np.float32) @ b[:, lo : lo + 1024].astype(np.float32).T
        out = part if out is None else out + part.astype(np.float64)
    return out


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the components of ``i`` and ``j`` in ``label``, where a root names itself."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def tile(x: np.ndarray, side: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights linked to each row, and each row's component within the tile.

    ``x``: unit rows; ``side``: 0 or 1 for two blocks, all 0 for a block with itself.
    """
    q, scale, error = quantised(x)
    linked, label = np.zeros(len(x), np.int64), np.arange(len(x))
    two = side.any()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if two else np.arange(len(x))
    most = error[right].max() if len(right) else 0.0
    scales = scale.astype(np.float32)
    for lo in range(0, len(left), STRIP):
        rows = left[lo : lo + STRIP]
        least = (threshold - error[rows] - (1 + error[rows]) * most - SLACK) / scale[rows]
        # Of a block with itself, what lies before a row has met it already.
        for start in range(0 if two else lo // BLOCK * BLOCK, len(right), BLOCK):
            others = right[start : start + BLOCK]
            product = _product(q[rows], q[others]) * scales[others]
            i, j = np.nonzero(product >= least[:, None])
            value = product[i, j].astype(np.float64) * scale[rows[i]]
            i, j = rows[i], others[j]
            if not two:
                keep = i < j
                i, j, value = i[keep], j[keep], value[keep]
            bound = error[i] + (1 + error[i]) * error[j] + SLACK
            possible = value + bound >= threshold
            i, j, sure = i[possible], j[possible], (value - bound >= threshold)[possible]
            unsure = np.flatnonzero(~sure)
            for k in range(0, len(unsure), 20_000):
                at = unsure[k : k + 20_000]
                sure[at] = (x[i[at]] * x[j[at]]).sum(axis=1) >= threshold
            i, j = i[sure], j[sure]
            np.add.at(linked, i, weight[j])
            np.add.at(linked, j, weight[i])
            _merge(label, i, j)
    return linked, label


def block_count(classes: float, size: float) -> int:
    """Blocks of a table of ``classes`` different vectors of ``size`` bytes."""
    return max(1, min(ceil(classes / BLOCK), BLOCKS), ceil(classes * size / BLOCK_BYTES))


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", threshold: float = 0.95
) -> DataFrame:
    """``id_column, n_links, component_id, kept`` for every row of ``vectors``.

    Two rows are linked when their cosine, in doubles, is ``threshold`` or more. Equal
    vectors are one class with a weight, so copies never meet. Classes are dealt evenly to
    blocks, which are written once, and every pair of blocks is one task of bounded size
    that reads the two where they lie. It returns for each linked row a count and one edge
    of a spanning forest, never the links themselves. All pairs are looked at: work grows
    with the square of the number of different vectors. What is shuffled and written grows
    with their number.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    with a null id, have no links; a null id has a null component. Vectors of different
    lengths are not linked. Rows that repeat an id are separate vectors.
    """
    kind = "f8" if "double" in dict(vectors.dtypes)[column] else "f4"
    rows = vectors.select(F.col(id_column).alias("_id"), F.col(column).alias("_v"))
    fine = (
        F.col("_id").isNotNull() & (F.size("_v") > 0)
        & F.forall("_v", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
        & F.exists("_v", lambda e: e != 0)
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [(np.asarray(v, kind) + 0.0).tobytes() for v in batch["_v"]]  # -0.0 is 0.0
            yield pd.DataFrame({"_id": batch["_id"], "_raw": data})

    good = rows.where(F.coalesce(fine, F.lit(False)))
    packed = good.select(F.col("_id").cast("long"), "_v").mapInPandas(pack, "_id long, _raw binary")
    packed = packed.select("_id", F.unhex(F.md5("_raw")).alias("_class"), "_raw")
    classes = packed.groupBy("_class").agg(F.min("_id").alias("_least"), F.count("*").alias("_weight"), F.first("_raw").alias("_raw"))
    facts = good.agg(F.approx_count_distinct(F.xxhash64("_v")).alias("n"), F.avg(F.size("_v")).alias("size")).first()
    n_blocks = block_count(facts["n"], (facts["size"] or 0) * int(kind[1]))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        done = 0

        def packed_block(size: int) -> pa.RecordBatch:
            nonlocal done
            some = pa.Table.from_batches(held.pop(size)).combine_chunks()
            first = (some["_part"][0].as_py() << 40) + done
            done += len(some)
            row = {"_size": size, "_first": first, "_raw": b"".join(some["_raw"].to_pylist())}
            row |= {name: some[name].to_pylist() for name in ("_class", "_least", "_weight")}
            return pa.RecordBatch.from_pylist([row], form)

        for batch in batches:
            sizes = pc.binary_length(batch["_raw"])
            for size in sizes.unique().to_pylist():
                held.setdefault(size, []).append(batch.filter(pc.equal(sizes, size)))
                if size * sum(map(len, held[size])) >= 2 * BLOCK_BYTES:
                    yield packed_block(size)
        while held:
            yield packed_block(next(iter(held)))

    form = pa.schema(
        [("_size", pa.int32()), ("_first", pa.int64()), ("_raw", pa.binary()), ("_class", pa.list_(pa.binary())),
         ("_least", pa.list_(pa.int64())), ("_weight", pa.list_(pa.int64()))]
    )
    dealt = classes.repartition(n_blocks).withColumn("_part", F.spark_partition_id().cast("long"))
    blocks = checkpointed(
        dealt.mapInArrow(
            block, "_size int, _first long, _raw binary, _class array<binary>, _least array<long>, _weight array<long>"
        )
    )
    # No block is copied for the pairs it is in: a task reads two partitions of the written table.
    sides = [
        blocks.select(*[F.col(c).alias(f"{c}_{k}") for c in ("_size", "_first", "_raw", "_weight")]) for k in "ab"
    ]
    left = sides[0].coalesce(max(1, min(n_blocks, MOST_TASKS // n_blocks)))
    pairs = left.join(
        sides[1].hint("shuffle_replicate_nl"),
        (F.col("_size_a") == F.col("_size_b")) & (F.col("_first_a") <= F.col("_first_b")),
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                first = [batch[f"_first_{k}"][row].as_py() for k in "ab"]
                some = "ab" if first[0] < first[1] else "a"
                raw = [np.frombuffer(batch[f"_raw_{k}"][row].as_buffer(), kind) for k in some]
                weight = [batch[f"_weight_{k}"][row].values.to_numpy() for k in some]
                side = np.repeat(np.arange(len(some)), [len(w) for w in weight])
                nodes = np.concatenate([f + np.arange(len(w)) for f, w in zip(first, weight)])
                x = unit(np.concatenate(raw).reshape(len(side), -1).astype(np.float64))
                linked, label = tile(x, side, np.concatenate(weight), threshold)
                at = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (nodes[at], linked[at], nodes[label[at]])], ["_node", "_links", "_to"])

    found = checkpointed(pairs.mapInArrow(links, "_node long, _links long, _to long"))
    counts = found.groupBy("_node").agg(F.sum("_links").alias("_links"))
    joined = components(found, "_node", "_to").withColumnRenamed("node", "_node")
    each = blocks.select("_first", F.inline(F.arrays_zip("_class", "_least", "_weight", F.sequence(F.lit(0), F.size("_class") - 1).alias("_at"))))
    each = each.select((F.col("_first") + F.col("_at")).alias("_node"), "_class", "_least", "_weight")
    named = each.join(counts, "_node", "left").join(joined, "_node", "left")
    named = checkpointed(named.withColumn("component", F.coalesce("component", "_node")).drop("_node"))
    least = named.groupBy("component").agg(F.min("_least").alias("_component"))
    of_class = named.join(least, "component").select(
        "_class", "_component", (F.coalesce("_links", F.lit(0)) + F.col("_weight") - 1).alias("_links")
    )
    linked = packed.select("_id", "_class").join(of_class, "_class").select("_id", "_links", "_component")
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("_id", F.lit(0).cast("long"), F.col("_id").cast("long"))
    return linked.unionAll(alone).select(
        F.col("_id").alias(id_column),
        F.col("_links").alias("n_links"),
        F.col("_component").alias("component_id"),
        F.coalesce(F.col("_id") == F.col("_component"), F.lit(True)).alias("kept"),
    )
