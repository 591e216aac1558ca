"""Calls that fail, hang or die, and answers that are kept."""

from __future__ import annotations

import os
import threading
import time

import pytest

from procura.operators import answers, scoring
from procura.operators.answers import Calls

ROWS = [(f"t{i}", f"prompt {i % 40}", [f"/in/{i % 40}.txt"]) for i in range(100)] + [("none", "prompt none", None)]
SCHEMA = "tender_id string, prompt string, files array<string>"


def logged(path):
    """A scorer maker that writes down every prompt that it is asked."""

    def make():
        def scorer(prompt, files):
            with open(path, "a") as log:
                log.write(prompt + "\n")
            return f"{prompt} {len(files)}"

        return scorer

    return make


def test_retries_and_errors():
    seen, waits = [], []

    def scorer(prompt, files):
        seen.append(prompt)
        if prompt == "bad" or seen.count(prompt) < 3:
            raise ValueError(f"{prompt} {seen.count(prompt)}")
        return prompt

    start = time.perf_counter()
    assert Calls(attempts=3, pause=0.01).ask(scorer, "a", []) == ("a", None)
    waits.append(time.perf_counter() - start)
    assert waits[0] >= 0.03  # 0.01, then 0.02
    assert Calls(attempts=3, pause=0).ask(scorer, "bad", []) == (None, "bad 3")
    assert Calls().ask(scorer, "b", []) == (None, "b 1")


def test_timeout():
    calls = Calls(timeout=0.05, attempts=2, pause=0)
    answer, error = calls.ask(lambda p, f: time.sleep(5), "a", [])
    assert answer is None and "0.05" in error
    assert Calls(timeout=5).ask(lambda p, f: p, "a", []) == ("a", None)
    assert Calls(timeout=5).ask(lambda p, f: 1 / 0, "a", [])[1] == "division by zero"


def test_concurrency_is_bounded_and_keeps_order():
    now, most, lock = [0], [0], threading.Lock()

    def scorer(prompt, files):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        return prompt

    asked = [(str(i), []) for i in range(40)]
    assert Calls(concurrency=4).ask_all(scorer, asked) == [(p, None) for p, _ in asked]
    assert 1 < most[0] <= 4


def test_answers_are_asked_once(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    rows = spark.createDataFrame(ROWS, SCHEMA)
    want = sorted((i, f"{p} {len(f or [])}", None) for i, p, f in ROWS)
    for kept in (store, f"file://{store}"):
        got = scoring.run_scorer(rows, logged(str(log)), store=kept, calls=Calls(concurrency=3))
        assert sorted((r["tender_id"], r["response"], r["error"]) for r in got.collect()) == want
        assert sorted(log.read_text().split("\n")[:-1]) == sorted({p for _, p, _ in ROWS})
    # More rows: only new prompts are asked; another version asks again.
    more = rows.unionByName(spark.createDataFrame([("new", "prompt new", ["x"])], SCHEMA))
    scoring.run_scorer(more, logged(str(log)), store=store)
    assert len(log.read_text().split("\n")) - 1 == 42
    scoring.run_scorer(rows, logged(str(log)), store=store, version="2")
    assert len(log.read_text().split("\n")) - 1 == 42 + 41
    assert not os.listdir(f"{store}/_unfinished")


def test_failures_are_tried_again(spark, tmp_path):
    store, rows = str(tmp_path / "store"), spark.createDataFrame(ROWS[:10], SCHEMA)

    def broken():
        def scorer(prompt, files):
            raise ValueError("down")

        return scorer

    got = scoring.run_scorer(rows, broken, store=store).collect()
    assert {(r["response"], r["error"]) for r in got} == {(None, "down")}
    got = scoring.run_scorer(rows, lambda: lambda p, f: p, store=store).collect()
    assert sorted(r["response"] for r in got) == sorted(p for _, p, _ in ROWS[:10])


def test_a_task_killed_midway_loses_only_its_last_answers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(answers, "_FLUSH", 1)
    log, store = tmp_path / "log", str(tmp_path / "store")
    rows = spark.createDataFrame(ROWS, SCHEMA)

    def dying():
        ask, left = logged(str(log))(), [3]

        def scorer(prompt, files):
            left[0] -= 1
            if left[0] < 0:
                os._exit(1)  # the worker dies
            return ask(prompt, files)

        return scorer

    with pytest.raises(Exception):
        scoring.run_scorer(rows, dying, store=store)
    before = log.read_text().split("\n")[:-1]
    assert before and len(before) == len(set(before))
    got = scoring.run_scorer(rows, logged(str(log)), store=store)
    assert got.filter("response IS NULL").count() == 0
    after = log.read_text().split("\n")[:-1]
    assert sorted(after) == sorted({p for _, p, _ in ROWS})  # none was asked twice


def test_empty_requests(spark, tmp_path):
    rows = spark.createDataFrame([], SCHEMA)
    assert scoring.run_scorer(rows, logged(str(tmp_path / "log")), store=str(tmp_path / "s")).count() == 0
