from __future__ import annotations

import math
import random

import numpy as np
import pytest

from procura.llm import embedding_dedup, topk

NAN, INF = float("nan"), float("inf")
ODD = [(900, None), (901, []), (902, [0.0, 0.0]), (903, [NAN, 1.0]), (904, [INF, 1.0]), (905, [None, 1.0]), (None, [1.0, 0.0])]


def links(rows, threshold=0.95):
    """All pairs, one by one."""
    fine = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(e is not None and math.isfinite(e) for e in v) and any(v)]
    up, n = {i: i for i in range(len(rows))}, [0] * len(rows)

    def root(x):
        return x if up[x] == x else root(up[x])

    for x in fine:
        for y in fine:
            a, b = rows[x][1], rows[y][1]
            if x < y and len(a) == len(b):
                a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    n[x] += 1
                    n[y] += 1
                    up[root(x)] = root(y)
    ids = {}
    for i in fine:
        ids[root(i)] = min(rows[i][0], ids.get(root(i), rows[i][0]))
    comp = [ids[root(i)] if i in set(fine) else rows[i][0] for i in range(len(rows))]
    return sorted((str(k), n[i], str(comp[i]), k is None or k == comp[i]) for i, (k, _) in enumerate(rows))


def vectors(seed=1, dims=8):
    rng = np.random.default_rng(seed)
    out = [list(map(float, rng.normal(size=dims))) for _ in range(60)]
    base = np.array(out[0])
    out += [list(map(float, base + rng.normal(size=dims) * s)) for s in np.linspace(0.01, 0.5, 80)]
    out += [out[5]] * 30 + [[3 * e for e in out[5]]] + [[1e200] + [1e199] * (dims - 1), [1e-200] * dims, [1e-200] * dims]
    out += [[1.0, 2.0], [2.0, 4.0], [2.0, -4.0]]
    return out


@pytest.mark.parametrize("block", [4096, 20])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "STRIP", 16)
    rows = [*enumerate(vectors()), *ODD, (7, [5.0, 5.0])]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links int, component_id string")
    got = embedding_dedup.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((str(a), b, str(c), d) for a, b, c, d in got.collect()) == links(rows)


@pytest.mark.parametrize(("blocks", "size", "tasks"), [(1, 1 << 20, 100), (2, 1 << 20, 100), (32, 400, 40)])
def test_links_of_grown_blocks(spark, monkeypatch, blocks, size, tasks):
    """Blocks of more rows than are multiplied at once, several in a partition, several tiles in a task."""
    for name, value in (("BLOCK", 20), ("STRIP", 16), ("BLOCKS", blocks), ("BLOCK_BYTES", size), ("MOST_TASKS", tasks)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = [*enumerate(vectors()), *ODD, (7, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((str(a), b, str(c), d) for a, b, c, d in embedding_dedup.near_duplicates(df).collect()) == links(rows)


def test_vectors_are_not_copied_for_each_block(spark, monkeypatch):
    """640 vectors of 512 bytes in 16 blocks: a copy for each block would be 5 MB of shuffle files."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {f.getName(): f.length() for f in (found.apply(i) for i in range(found.size()))}

    held, write = [], embedding_dedup.checkpointed
    # While a plan is held, its shuffle files stay.
    monkeypatch.setattr(embedding_dedup, "checkpointed", lambda df: held.append(df) or write(df))
    rows = [(i, list(map(float, v))) for i, v in enumerate(np.random.default_rng(4).normal(size=(640, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = files()
    assert embedding_dedup.near_duplicates(df).count() == 640
    assert held and sum(n for name, n in files().items() if name not in before) < 3_000_000


def test_quantisation_bound():
    x = embedding_dedup.unit(np.random.default_rng(3).normal(size=(300, 64)))
    q, scale, error = embedding_dedup.quantised(x)
    assert np.abs(q).max() <= 127
    near = (q * scale[:, None]) @ (q * scale[:, None]).T
    bound = error[:, None] + (1 + error[:, None]) * error[None, :]
    assert (np.abs(x @ x.T - near) <= bound).all()


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(df).collect() == [] == topk.top_k(df).collect()


def test_whole_table_links(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = sorted((str(a), b, str(c), d) for a, b, c, d in embedding_dedup.near_duplicates(df).collect())
    assert got == links([(r.vec_id, r.embedding) for r in df.collect()])


def ranked(rows, k, every):
    fine = [(i, [max(-(2**63), min(2**63 - 1, math.floor(1024 * e))) for e in v]) for i, v in rows if i is not None and v is not None and all(e is not None and math.isfinite(e) for e in v)]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = set()
    for i, v in fine:
        if i % every == 0:
            found = sorted((-clip(sum(a * b for a, b in zip(v, w))), j) for j, w in fine if j != i and len(w) == len(v))
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)}
    return sorted(out)


@pytest.mark.parametrize(("block", "unit", "chunk"), [(512, 16, 2048), (4, 2, 3)])
def test_top_k(spark, monkeypatch, block, unit, chunk):
    for name, value in (("BLOCK", block), ("UNIT", unit), ("CHUNK", chunk)):
        monkeypatch.setattr(topk, name, value)
    rows = [*enumerate(v for v in vectors() if max(map(abs, v)) < 1e100), *ODD, (1000, [1e30, -1e30]), (1001, [1e30, 1.0]), (1002, [-0.5, 3e12])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = topk.top_k(df, k=5, every=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == ranked(rows, 5, 10)
