from __future__ import annotations

import itertools
import os

import pytest
from pyspark.sql import functions as F

from procura.llm import chat, queries


def path_score(model, texts, states):
    """The score of a whole path, line by line."""
    total, before, at = 0.0, None, 0
    for k, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n")):
            s = states[at]
            total += model.first[s] if before is None else model.step[n == 0 or bool(chat.marker(line)[0])][before][s]
            total += chat._seen(model, line, "later" if n else "row" if k else "start")[s]
            before, at = s, at + 1
    return total


CONVERSATIONS = {
    1: ["You are a helpful bot.", "What is this?", "It is a test.\nIt has two lines."],
    2: ["Human: hello\nBot: hi there\n**User:** and now?", "A: more", None],
    3: ["", "Q: x?"],
    4: ["no markers at all"] * 7,
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, ("user", "assistant")[t % 2], "How are you?" if t % 2 == 0 else "I am well.\nThank you for asking, it is a fine day.") for i in range(40) for t in range(4)]
    rows += [(i, -1, "system", "You answer questions with care and at some length.") for i in range(0, 40, 3)] + [(1, 9, "other", "x"), (1, 10, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.fit(chat.placed(df, "conv_id", "turn", "text", "role"), F.lit(True))


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_paths_are_the_best_of_all(spark, model, partitions):
    rows = [(c, t, x, 0) for c, texts in CONVERSATIONS.items() for t, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, part int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.recover(chat.placed(df, "conv_id", "turn", "text"), model).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for c, texts in CONVERSATIONS.items():
        lines = sum(len((t or "").split("\n")) for t in texts)
        best = max(itertools.product(range(3), repeat=lines), key=lambda s: path_score(model, texts, s))
        found = [r for r in sorted((int(r._key), int(r._turn), r.part, r.role, r.text) for r in got) if r[0] == c]
        states = [chat.ROLES.index(role) for _, _, _, role, text in found for _ in text.split("\n")]
        assert path_score(model, texts, states) == pytest.approx(path_score(model, texts, best))


def test_markers_and_rendering(spark, model):
    df = spark.createDataFrame([(2, 0, CONVERSATIONS[2][0], "x")], "conv_id long, turn long, text string, rendered string")
    got = chat.recover(chat.placed(df, "conv_id", "turn", "text"), model).orderBy("part").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hello"), ("assistant", "hi there"), ("user", "and now?")]
    assert got[0].rendered == "<|user|>\nhello\n<|end|>"


def test_hard_rows(spark):
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (1, None, None, None), (1, None, "user", ""), (1, 0, "assistant", "x\n" * 20_000), (1, 0, "user", "b"), (1, 0, "user", "b"), (2, 5, "nobody", "?")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = chat.format_chats(df)
    assert got.columns == ["conv_id", "turn", "part", "role", "text", "rendered"]
    found = got.collect()
    assert {r.role for r in found} <= set(chat.ROLES)
    assert sum(len(r.text.split("\n")) for r in found) == sum(len((t or "").split("\n")) for _, _, _, t in rows)
    assert chat.format_chats(df.limit(0)).collect() == []


def test_held_out_accuracy(spark, folder):
    larger = os.path.join(os.path.dirname(folder), "sf0.01")  # ten held-out rows say little
    folder = larger if os.path.isdir(larger) else folder
    truth = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("truth"))
    found = queries.op6_chat(spark, folder).join(truth, ["conv_id", "turn"]).where("held_out")
    right, rows = found.agg(F.sum((F.col("role") == F.col("truth")).cast("int")), F.count("*")).first()
    assert rows and right / rows > 0.9


def test_markers_are_seen_on_the_whole_line():
    for blanks in (0, 10, 210, 300_000):
        line = " " * blanks + "**User:** hello"
        assert chat.marker(line) == ("user", len(line) - 5)
    hard = ["user" + " " * 300_000 + "x", " " * 300_000 + "x", "* " + "\t" * 300_000, "a" * 300_000 + ":", ""]
    assert [chat.marker(line) for line in hard] == [("", 0)] * 5
    assert chat.marker("user" + " " * 300_000 + ": x")[0] == "user"
