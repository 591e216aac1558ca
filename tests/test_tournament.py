from __future__ import annotations

import json
import zlib

import pytest

from procura import vocab
from procura.operators import scoring, tournament

PAGE = 16
LOTS = 1037


def lots(spark, n=LOTS):
    made = [(f"T{k:05d}", f"Поставка {k * k % 977}", "", None) for k in range(n)]
    return spark.createDataFrame(made, "tender_id string, title string, customer string, deadline_at timestamp_ntz")


def prompts(spark, n=LOTS):
    names = ["a.txt", "b.txt", "none.txt", "fails.txt", "odd.txt", "own.txt", "few.txt", "away.txt"]
    files = spark.createDataFrame([(f"/in/{n}", "text " * 300) for n in names], "path string, text_sample string")
    own = [("/in/own.txt", f"T{k:05d}", 99 - k, k + 1) for k in range(3 * PAGE)] + [("/in/few.txt", "T00007", 9, 1), ("/in/few.txt", "T00003", 8, 2)]
    ranked = spark.createDataFrame([r for r in own if int(r[1][1:]) < n], "path string, tender_id string, score int, rn int")
    everyone = lots(spark, n)
    return scoring.match_requests(files, ranked), scoring.match_options(ranked, everyone)


def lines_of(prompt):
    return [o for o in prompt.rpartition(vocab.MATCH_PROMPT_OPTIONS)[2].split("\n") if o]


def maker(most):
    """A scorer that likes each option by itself, and refuses prompts that are too long."""

    def make():
        def scorer(prompt, files):
            options = lines_of(prompt)
            if len(options) > most:
                raise ValueError("too long")
            if "none.txt" in prompt:
                return json.dumps({"tender_id": "NONE", "confidence": 80})
            if "fails.txt" in prompt and any("T00500" in o for o in options):
                raise RuntimeError("no answer")
            if "odd.txt" in prompt and any("T00900" in o for o in options):
                return "cannot say"
            if "away.txt" in prompt:
                return json.dumps({"tender_id": "T01000", "confidence": 70})
            name = prompt[: len(prompt) - len(prompt.rpartition(vocab.MATCH_PROMPT_OPTIONS)[2])]
            best = max(options, key=lambda o: zlib.crc32((name + o).encode()), default=None)
            return json.dumps({"tender_id": best and best.split('"')[1], "confidence": 90})

        return scorer

    return make


@pytest.mark.parametrize("limit", [scoring.BROADCAST_BYTES, 0])
def test_pages_choose_as_one_long_prompt(spark, limit):
    requests, options = prompts(spark)
    short = tournament.run_match_tournament(requests, options, maker(PAGE), PAGE, limit=limit).collect()
    got = {r["path"]: (r["response"], r["error"]) for r in short}
    assert len(short) == len(got) == 8
    whole = {r["path"]: (r["response"], r["error"]) for r in scoring.run_match_scorer(requests, options, maker(LOTS)).collect()}
    for name in ("a.txt", "b.txt", "none.txt", "own.txt", "few.txt", "away.txt", "odd.txt", "fails.txt"):
        assert got[f"/in/{name}"] == whole[f"/in/{name}"], name
    assert got["/in/fails.txt"] == (None, "no answer") and got["/in/odd.txt"][0] == "cannot say"


def test_calls_and_rounds(spark):
    """Every page once: 1,037 options are 65 pages, their winners 5, then 1."""
    requests, options = prompts(spark)
    asked = spark.sparkContext.accumulator(0)

    def make():
        inner = maker(PAGE)()

        def scorer(prompt, files):
            if "a.txt" in prompt:
                asked.add(1)
            return inner(prompt, files)

        return scorer

    only = requests.filter("path = '/in/a.txt'")
    tournament.run_match_tournament(only, options, make, PAGE)
    assert asked.value == 65 + 5 + 1


def test_no_options_and_no_files(spark):
    requests, options = prompts(spark, 0)
    got = tournament.run_match_tournament(requests, options, maker(PAGE), PAGE).collect()
    assert len(got) == 8 and json.loads({r["path"]: r["response"] for r in got}["/in/a.txt"])["tender_id"] is None
    requests, options = prompts(spark, 40)
    assert tournament.run_match_tournament(requests.limit(0), options, maker(PAGE), PAGE).collect() == []
    with pytest.raises(ValueError):
        tournament.run_match_tournament(requests, options, maker(PAGE), 1)


def test_equal_ids_are_offered_once(spark):
    requests, options = prompts(spark, 40)
    twice = options.unionByName(options)
    want = sorted(map(tuple, tournament.run_match_tournament(requests, options, maker(PAGE), PAGE).collect()))
    assert sorted(map(tuple, tournament.run_match_tournament(requests, twice, maker(PAGE), PAGE).collect())) == want


def test_a_set_of_many_files_has_copies(spark, monkeypatch):
    """A set that many files need is dealt out in copies; only such sets have a row for that."""
    from procura.operators import scoring

    monkeypatch.setattr(scoring, "_FILES_PER_COPY", 5)
    rows = [(f"p{i}", f"ask {i}:", "*" if i % 2 else f"p{i}") for i in range(60)]
    requests = spark.createDataFrame(rows, "path string, prompt string, option_set string")
    lines = [("*", 0, f"{t}", f"all {t}") for t in range(4)] + [(f"p{i}", 1, "7", f"own {i}") for i in range(0, 60, 2)]
    options = spark.createDataFrame([*lines, ("unasked", 1, "1", "x")], "option_set string, rn int, tender_id string, line string")
    many = scoring.copies_of_sets(requests).collect()
    assert [tuple(r) for r in many] == [("*", 6)]
    answers = scoring.run_match_scorer(requests, options, lambda: lambda prompt, files: prompt).collect()
    everyone = "\n".join(f"all {t}" for t in range(4))
    want = {(p, q + (everyone if s == "*" else f"own {p[1:]}"), None) for p, q, s in rows}
    assert len(answers) == 60 and {tuple(r) for r in answers} == want


def test_lines_are_written_once(spark, monkeypatch):
    """Sets name lines of a megabyte in all; no table that is written repeats them."""
    from procura.operators.joins import size_expr

    sizes, write = [], tournament.checkpointed

    def measured(df):
        out = write(df)
        sizes.append(out.agg(size_expr(out)).first()[0])
        return out

    monkeypatch.setattr(tournament, "checkpointed", measured)
    requests = spark.createDataFrame([(f"p{i}", f"ask {i}:", f"p{i}") for i in range(100)], "path string, prompt string, option_set string")
    text = {t: str(t) * 2000 for t in range(8)}
    rows = [(f"p{i}", k, f"{(i + k) % 8}", text[(i + k) % 8]) for i in range(100) for k in range(5)]
    options = spark.createDataFrame(rows, "option_set string, rn int, tender_id string, line string")
    answers = tournament.run_match_tournament(requests, options, lambda: lambda prompt, files: prompt, 5).collect()
    want = {(f"p{i}", f"ask {i}:" + "\n".join(text[(i + k) % 8] for k in range(5)), None) for i in range(100)}
    assert {tuple(r) for r in answers} == want
    # The answers here are whole prompts; nothing else comes near.
    assert sorted(sizes)[-2] < 100_000
