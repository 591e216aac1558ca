"""Exact ranked lexical search: dense products of item tiles and document impact tiles.

The score of a document for an item is a sum over the item's terms, so the scores of a
tile of items and a tile of documents are one matrix product over the terms of those
items alone. All factors are whole numbers in float64; as long as no partial sum reaches
2**53 the product is exact in any order of summation, and BLAS may be used for it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procura.operators.joins import checkpointed

# Documents and items of a tile, terms that one product sums over.
DOCS, ITEMS, TERMS = 512, 256, 1024
# Bytes of item texts that are searched for in one pass; more items take more passes.
ITEM_BYTES = 32 * 1024 * 1024
# Groups that the best rows of an item are cut in before they meet.
SALTS = 64
_EXACT = 2**53
_IMPACT = 1_000_000  # no impact reaches this
# ASCII letters in lower case and digits are term characters, as is all beyond ASCII.
_FOLD = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if isinstance(text, str) else []


def item_tiles(texts: list[str]) -> tuple[dict[bytes, int], list[tuple]]:
    """The number of each term of any item, and the items in tiles of plain arrays.

    A tile has a compact vocabulary of its own: its first item, how many it has, and its
    counts in parts of at most ``TERMS`` terms, each ``numbers of the terms, item, column,
    count`` of the entries that are not zero.
    """
    bags, known, tiles = [Counter(terms(t)) for t in texts], {}, []
    for first in range(0, len(bags), ITEMS):
        some = bags[first : first + ITEMS]
        numbers = sorted({known.setdefault(t, len(known)) for bag in some for t in bag})
        place = {n: k for k, n in enumerate(numbers)}
        entries = [(row, place[known[t]], count) for row, bag in enumerate(some) for t, count in bag.items()]
        rows, columns, counts = np.array(entries, np.int64).reshape(-1, 3).T
        parts = []
        for start in range(0, len(numbers), TERMS):
            inside = (columns >= start) & (columns < start + TERMS)
            entries = (rows[inside], columns[inside] - start, counts[inside])
            parts.append((np.array(numbers[start : start + TERMS], np.int64), *entries))
        tiles.append((first, len(some), parts))
    return known, tiles


def _kind(part: tuple, weights: np.ndarray) -> type:
    """float64 where no partial sum of the part reaches 2**53, else longs, exact as well."""
    numbers, rows, columns, counts = part
    most: Counter = Counter()
    for row, column, count in zip(rows.tolist(), columns.tolist(), counts.tolist(), strict=True):
        most[row] += count * int(weights[numbers[column]])
    return np.float64 if max(most.values(), default=0) * _IMPACT < _EXACT else np.int64


def count_tiles(docs: DataFrame, sent, id_column: str, text_column: str) -> DataFrame:
    """Tiles of documents: term counts for the items' terms, and the totals of all terms."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value[0]
        tile: list = []
        for batch in batches:
            for doc, text in zip(batch["_id"], batch["_text"], strict=True):
                words = terms(text)
                if not words:
                    continue
                bag = Counter(words)
                found = bag.keys() & known.keys()
                tile.append((doc, len(words), [known[t] for t in found], [bag[t] for t in found]))
                if len(tile) == DOCS:
                    yield pack(tile)
                    tile = []
        if tile:
            yield pack(tile)

    def pack(tile: list) -> pd.DataFrame:
        ids, sizes, at, tf = zip(*tile, strict=True)
        none = np.array([pd.isna(i) for i in ids], bool)
        arrays = {
            "ids": np.array([0 if x else int(i) for i, x in zip(ids, none, strict=True)], np.int64),
            "none": none,
            "sizes": np.array(sizes, np.int64),
            "lengths": np.array([len(a) for a in at], np.int32),
            "at": np.array([n for a in at for n in a], np.int32),
            "tf": np.array([n for a in tf for n in a], np.int32),
        }
        return pd.DataFrame({"n_docs": [len(tile)], "n_terms": [sum(sizes)]} | {k: [v.tobytes()] for k, v in arrays.items()})

    schema = "n_docs long, n_terms long, ids binary, none binary, sizes binary, lengths binary, at binary, tf binary"
    # Ids go as text, as pandas has no whole numbers beside nulls.
    return docs.select(F.col(id_column).cast("string").alias("_id"), F.col(text_column).alias("_text")).mapInPandas(count, schema)


def _best(k: int, item: np.ndarray, score: np.ndarray, none: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` best of every item, in order: falling score, rising id, null ids last."""
    order = np.lexsort((doc, none, -score, item))
    item, score, none, doc = item[order], score[order], none[order], doc[order]
    kept = np.arange(len(item)) - np.searchsorted(item, item) < k
    return item[kept], score[kept], none[kept], doc[kept]


def score_tiles(tiles: DataFrame, sent, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, doc, score``: the ``k`` best documents of each item among those of a task.

    A tile of scores gives up all that reach the item's k-th best score so far, ties
    included; only then are they cut to ``k`` by score and id.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = [(first, n, [(*part, _kind(part, weights)) for part in parts]) for first, n, parts in sent.value[1]]
        column = np.full(len(weights), -1, np.int64)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        least = np.ones(sum(n for _, n, _ in asked), np.int64)  # lower scores cannot matter
        for batch in batches:
            for tile in batch.itertuples(index=False):
                ids, none = np.frombuffer(tile.ids, np.int64), np.frombuffer(tile.none, bool)
                at, tf = np.frombuffer(tile.at, np.int32), np.frombuffer(tile.tf, np.int32).astype(np.int64)
                doc = np.repeat(np.arange(len(ids)), np.frombuffer(tile.lengths, np.int32))
                # Python's numbers: a product of two totals may pass 64 bits on the way.
                norm = np.array([25 + 75 * int(n) * n_docs // n_terms for n in np.frombuffer(tile.sizes, np.int64)], np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm[doc]) * weights[at]
                found = [best]
                for first, n, parts in asked:
                    scores = np.zeros((n, len(ids)), np.int64)
                    for numbers, rows, columns, counts, kind in parts:
                        column[numbers] = np.arange(len(numbers))
                        mine = column[at]
                        column[numbers] = -1
                        used = mine >= 0
                        dense, matrix = np.zeros((len(numbers), len(ids)), kind), np.zeros((n, len(numbers)), kind)
                        dense[mine[used], doc[used]] = impact[used]
                        matrix[rows, columns] = counts
                        scores += (matrix @ dense).astype(np.int64)
                    i, j = np.nonzero(scores >= least[first : first + n, None])
                    if len(i):
                        found.append((first + i, scores[i, j], none[j], ids[j]))
                if len(found) > 1:
                    best = _best(k, *(np.concatenate(x) for x in zip(*found, strict=True)))
                    full = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1
                    least[best[0][full]] = best[1][full]
        item, points, none, doc = best
        yield pd.DataFrame({"item": item, "doc": pd.arrays.IntegerArray(doc, none), "score": points})

    return tiles.mapInPandas(score, "item long, doc long, score long")


def _search(docs: DataFrame, items: list[tuple[int, str | None]], id_column: str, text_column: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    known, asked = item_tiles([text for _, text in items])
    sent = spark.sparkContext.broadcast((known, asked))
    tiles = checkpointed(count_tiles(docs, sent, id_column, text_column))
    n_docs, n_terms = tiles.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    size = len(known)

    def holders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in batch["at"]:
                total += np.bincount(np.frombuffer(at, np.int32), minlength=size)
        yield pd.DataFrame({"term": np.flatnonzero(total), "df": total[total > 0]})

    df = np.zeros(size, np.int64)
    for term, n in tiles.select("at").mapInPandas(holders, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    found = score_tiles(tiles, sent, weights, n_docs, n_terms, k)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    # Each task has k rows of an item at most; they are cut in groups before they meet.
    salted = found.withColumn("_salt", F.spark_partition_id() % SALTS)
    for keys in (["item", "_salt"], ["item"]):
        ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        salted = ranked.where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item long, item_id long")
    return salted.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc").alias(id_column), "score")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    k: int = 10,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents with a score for every item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only
    A-Z are lower-cased. Documents are counted once, against the terms of the items, in
    tiles of ``DOCS``; the totals give the weights, and each tile of documents is
    multiplied with each tile of items. A task hands on ``k`` rows of each item.

    The items' terms are broadcast, as their texts have ``item_bytes`` in a pass at most;
    beyond that the documents are searched in several passes, each for a share of the
    items (an item longer than the bound has a pass of its own).

    A null or empty text has no term: such a document counts for nothing, such an item
    has no rows, nor has one whose terms no document holds. Rows that repeat a document id
    are documents each; null ids rank after all others of their score. An item that
    repeats id and text is asked once, and one that repeats the id only has a ranking for
    each text; items with a null id are not asked. Other columns of both tables do not
    matter, whatever their names.
    """
    items = items.select(F.col(item_column).cast("long").alias("_item"), F.col(text_column).alias("_asked"))
    items = items.where("_item IS NOT NULL AND _asked IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("_asked")), F.lit(0))).first()[0]
    passes = max(1, -(-total // item_bytes))
    docs, found = docs.select(id_column, text_column), None
    for n in range(passes):
        share = F.pmod(F.xxhash64("_item", "_asked"), F.lit(passes)) == n
        asked = sorted(tuple(r) for r in items.where(share).collect())
        part = _search(docs, asked, id_column, text_column, k)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("item_id", item_column) if item_column != "item_id" else found
