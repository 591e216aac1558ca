from __future__ import annotations

import csv
import glob
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from procura import vocab
from procura.operators import ordering, report, scoring
from procura.sources import listing, snapshots


def orders(n=500, seed=3):
    """Rows with a third of them on one deadline and some without any."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = datetime(2024, 5, 1) if i % 3 == 0 else datetime(2024, rng.randint(1, 12), rng.randint(1, 28))
        rows.append((i, f"t{i}", rng.choice(["Б", "а", "В", "в"]), None if i % 10 == 1 else day))
    rng.shuffle(rows)
    return rows


SCHEMA = "row_number int, tender_id string, title string, deadline_at timestamp_ntz"
LAST = datetime(9999, 1, 1)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_ordinals(spark, partitions):
    rows = orders()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = {r["row_number"]: r["n"] for r in ordering.ordinal(df, ordering.by_deadline_and_title(), "n").collect()}
        want = sorted(rows, key=lambda r: (r[3] or LAST, r[2].lower(), r[0]))
        assert got == {r[0]: i for i, r in enumerate(want, 1)}
        grouped = ordering.ordinal(df, [F.col("row_number").asc()], "n", group="deadline_at").collect()
        seen: dict = {}
        for r in sorted(grouped, key=lambda r: r["row_number"]):
            seen[r["deadline_at"]] = seen.get(r["deadline_at"], 0) + 1
            assert r["n"] == seen[r["deadline_at"]]
        assert len(grouped) == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_queue(spark, monkeypatch):
    rows = orders(60)
    df = spark.createDataFrame(rows, SCHEMA)
    want = [r[1] for r in sorted(rows, key=lambda r: (r[3] or LAST, r[0]))]
    for top_rows in (10_000, 0):
        monkeypatch.setattr(ordering, "_TOP_ROWS", top_rows)
        for skip, limit in ((0, None), (5, None), (0, 7), (50, 100), (0, 0), (5, 3)):
            got = [r["tender_id"] for r in ordering.queue(df, skip, limit).collect()]
            assert got == want[skip:][:limit], (skip, limit)
    with pytest.raises(ValueError):
        ordering.queue(df, -1)


def test_due_on(spark):
    rows = [(1, "a", "", datetime(2024, 5, 1)), (2, "b", "", datetime(2024, 5, 1, 23, 59)), (3, "c", "", datetime(2024, 5, 2)), (4, "d", "", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["tender_id"] for r in listing.due_on(df, "2024-05-01").collect()) == ["a", "b"]


HEADERS = [" № строки", "Номер", "", "Предмет", "Номер", "Ссылка", "Дата окончания приема заявок", "ИНН Организатора"]


def test_listing_from_csv(spark, tmp_path):
    rows = [
        [2, "старый", "x", " Школа ", "Источник", "https://h/77", "01.02.24", "1"],
        [3, "старый", "x", "Мост", " A-1 ", " https://h/1 ", "01.02.2024 10:30", "2"],
        [4, "старый", "x", "Без ссылки", "A-2", " ", "", "3"],
    ]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows(rows)
    df = listing.read_listing(spark, str(tmp_path), HEADERS, title_column="Предмет")
    got = [tuple(r) for r in df.select("row_number", "tender_id", "title", "url", "deadline_at", "customer", "customer_inn").orderBy("row_number").collect()]
    assert got == [
        (2, "77", "Школа", "https://h/77", datetime(2024, 2, 1), "", "1"),
        (3, "A-1", "Мост", "https://h/1", datetime(2024, 2, 1, 10, 30), "", "2"),
    ]
    # The last of two equal headers is bound and enters the map; blank headers do not.
    raw = df.orderBy("row_number").first()["raw"]
    assert raw["Номер"] == "Источник" and "" not in raw
    assert df.dtypes[7] == ("raw", "map<string,string>")


def test_columns():
    index = listing.header_index(["A", None, " ", " URL ", "A"])
    assert index == {"A": 4, "URL": 3}
    assert listing.find_column(index, "нет", ("Ссылка", "URL")) == 3
    assert listing.find_column(index, "", ("x",)) is None
    with pytest.raises(ValueError, match="A, URL"):
        listing.find_column(index, "нет", ("x",))


def test_numeric_cells(spark):
    df = spark.createDataFrame([(2, 1813130021.0, 45323.5, "https://h/1", "t")], "row_number int, a double, b double, c string, d string")
    heads = ["Номер", "Окончание подачи", "URL", "Название"]
    row = listing.lots_from_rows(df, heads, ["a", "b", "c", "d"]).first()
    assert (row["tender_id"], row["deadline_at"]) == ("1813130021", datetime(2024, 2, 1, 12))


RESULT = "tender_id string, title string, url string, deadline_at timestamp_ntz, classification_tag string, confidence_percent int, classification_comment string, version int, row_number int"


def result(tender_id, deadline, tag, version, n):
    return (tender_id, "t" + tender_id, "u", deadline, tag, 5, "c", version, n)


def test_upsert_months_and_summary(spark, tmp_path):
    may, june = datetime(2024, 5, 2), datetime(2024, 6, 1, 12, 30)
    old = spark.createDataFrame([result("1", may, "Подано", 1, 1), result("2", may, "", 1, 2), result("3", None, "В работу", 5, 3)], RESULT)
    new = spark.createDataFrame([result("1", june, "В работу", 1, 4), result("3", may, "Подано", 4, 5), result("4", may, "Подано", 1, 6)], RESULT)
    rows = report.upsert(old, new)
    assert sorted((r["tender_id"], r["row_number"]) for r in rows.collect()) == [("1", 4), ("2", 2), ("3", 3), ("4", 6)]
    months = report.monthly(rows)
    got = sorted(tuple(r) for r in months.select("sheet", "number", "title", "tag", "deadline").collect())
    assert got == [
        ("Без даты", 1, "t3", "В работу", ""),
        ("Июнь 2024", 1, "t1", "В работу", "1.6.2024 12:30"),
        ("Май 2024", 1, "t2", vocab.DEFAULT_TAG, "2.5.2024"),
        ("Май 2024", 2, "t4", "Подано", "2.5.2024"),
    ]
    summary = {(r["sheet"], r["tag"]): r["n"] for r in report.tag_summary(rows).collect()}
    assert len(summary) == 3 * len(vocab.TAGS)
    assert summary[("Май 2024", "Подано")] == 1 and summary[("Июнь 2024", "Подано")] == 0

    path = str(tmp_path / "report")
    report.write_monthly(months, path)
    report.write_monthly(months.filter("sheet = 'Май 2024' and number = 1"), path)
    back = spark.read.parquet(path)
    assert sorted(r["title"] for r in back.collect()) == ["t1", "t2", "t3"]


def test_a_stored_report_follows_its_lots(spark, tmp_path):
    path = str(tmp_path / "stored")
    may, june = datetime(2024, 5, 2), datetime(2024, 6, 1, 12, 30)
    rows = lambda *r: spark.createDataFrame(list(r), RESULT)
    shown = lambda: sorted((r["sheet"], r["number"], r["tender_id"]) for r in report.read_report(spark, path).collect())
    report.update_report(path, rows(result("1", may, "Подано", 1, 1), result("2", june, "", 1, 2), result("3", None, "", 1, 3)))
    assert shown() == [("Без даты", 1, "3"), ("Июнь 2024", 1, "2"), ("Май 2024", 1, "1")]
    # The only lot of May moves to June; May goes. An older write changes nothing.
    report.update_report(path, rows(result("1", june, "Подано", 2, 1), result("3", may, "", 0, 3)))
    assert shown() == [("Без даты", 1, "3"), ("Июнь 2024", 1, "1"), ("Июнь 2024", 2, "2")]
    assert not [f for f in snapshots.head(spark, path).parts if "Май" in f]
    report.update_report(path, rows(result("3", june, "", 5, 3), result("3", may, "", 4, 3)))
    assert shown() == [("Июнь 2024", 1, "1"), ("Июнь 2024", 2, "2"), ("Июнь 2024", 3, "3")]


@pytest.mark.parametrize("titles", [["x", "x (2)", "x"], ["x", "x", "x (2)", "x (3)", "x", "x (2)", "x (5)", "x"], ["x (2)", "x (2)", "x", "x (2) (2)"], ["", "", " (2)"]])
def test_unique_names_differ(spark, titles):
    df = spark.createDataFrame(list(enumerate(titles)), "row_number int, title string")
    named = {r["row_number"]: r["title"] for r in ordering.unique_names(df, "title", [F.col("row_number").asc()]).collect()}
    assert len(set(named.values())) == len(titles)
    assert all(named[titles.index(t)] == t for t in titles)


def test_unique_names_with_many_taken_numbers(spark):
    rng = random.Random(4)
    taken = rng.sample(range(2, 3000), 1500) + [5_000_000]
    titles = ["x"] * 1500 + [f"x ({k})" for k in taken] + ["y", "y", "x (7)", "x (7)"]
    rng.shuffle(titles)
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(titles)], "row_number int, title string, more double")
    found = ordering.unique_names(df, "title", [F.col("row_number").asc()])
    # No list of all numbers of a name is made.
    assert "collect_list" not in found._jdf.queryExecution().toString()
    own, used, want = set(titles), {}, {}
    for i, t in enumerate(titles):
        if t not in used:
            used[t] = iter([t, *(n for n in (f"{t} ({k})" for k in range(2, 5000)) if n not in own)])
        want[i] = next(used[t])
    assert {r["row_number"]: r["title"] for r in found.collect()} == want


def test_listing_with_line_breaks(spark, tmp_path):
    rows = [[2, "A", "x", "line one\nline \"two\"", "1", "https://h/1", "", ""], [3, "A", "x", "\n", "2", "https://h/2", "", ""]]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows(rows)
    df = listing.read_listing(spark, str(tmp_path), HEADERS, title_column="Предмет")
    assert sorted(tuple(r) for r in df.select("row_number", "title").collect()) == [(2, 'line one\nline "two"'), (3, "")]
    with open(tmp_path / "b.csv", "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerow(["sum", "A", "x", "t", "1", "https://h/3", "", ""])
    with pytest.raises(Exception, match="without a number"):
        listing.read_listing(spark, str(tmp_path), HEADERS, title_column="Предмет").collect()
    df = listing.read_listing(spark, str(tmp_path), HEADERS, title_column="Предмет", strict=False)
    assert df.count() == 3


def test_unique_names_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "x")], "row_number int, title string")
    named = ordering.unique_names(df, "title", [F.col("row_number").asc()])
    assert {r["row_number"]: r["title"] for r in named.collect()} == {1: "x", 2: "y", 3: "x (2)", 4: "x (3)"}
    rows = [(2, "b", "Б/в.", "u", None), (1, "a", "", "u", datetime(2024, 5, 1, 9)), (3, "c", "А", "u", datetime(2024, 5, 1, 9))]
    lots = spark.createDataFrame(rows, "row_number int, tender_id string, title string, url string, deadline_at timestamp_ntz")
    out = report.manifest(lots)
    report.write_manifest(out, str(tmp_path / "m"))
    lines = [line for f in sorted(glob.glob(str(tmp_path / "m" / "*.csv"))) for line in csv.reader(open(f, encoding="utf-8"))]
    assert [line for line in lines if line[0] != "order"] == [
        ["1", "a", "", "001. Без названия", "2024-05-01 09:00", "u"],
        ["2", "c", "А", "002. А", "2024-05-01 09:00", "u"],
        ["3", "b", "Б/в.", "003. Б／в", "", "u"],
    ]


def test_scorers(spark):
    lots = spark.createDataFrame([("1", "u1"), ("2", "u2"), ("3", "u3")], "tender_id string, url string")
    files = spark.createDataFrame([("1", "/x/b.pdf", 2), ("1", "/x/a.pdf", 1), ("2", "/x/c.pdf", 1)], "tender_id string, path string, priority int")
    requests = scoring.analysis_requests(lots, files, "шаблон {x}")
    prompts = {r["tender_id"]: (r["prompt"], r["files"]) for r in requests.collect()}
    assert prompts["1"][1] == ["/x/a.pdf", "/x/b.pdf"] and prompts["3"][1] == []
    assert prompts["1"][0].startswith("Ссылка на тендер: u1\n\nшаблон {x}\n\n")
    assert '{"classification_tag": "один' in prompts["1"][0] and vocab.TAGS[0] + ", " in prompts["1"][0]

    def make():
        def scorer(prompt, paths):
            if "u2" in prompt:
                raise ValueError("no access")
            return json.dumps({"classification_tag": "Подано", "confidence_percent": len(paths)})

        return scorer

    done = scoring.classify_requests(requests, lambda r: scoring.run_scorer(r, make))
    got = {r["tender_id"]: tuple(r["payload"])[:3] for r in done.collect()}
    assert got == {
        "1": ("Подано", 2, vocab.NO_COMMENT),
        "2": (vocab.DEFAULT_TAG, 0, vocab.PROVIDER_ERROR_PREFIX + "no access"),
        "3": (vocab.DEFAULT_TAG, 0, vocab.NO_FILES_COMMENT),
    }
    stubbed = scoring.classify_requests(requests, scoring.stub_scorer, skip_empty=False)
    comments = {r["tender_id"]: r["payload"]["classification_comment"] for r in stubbed.collect()}
    assert comments["1"] == vocab.STUB_COMMENT.format(files="a.pdf, b.pdf")
    assert comments["3"] == vocab.STUB_COMMENT.format(files="без файлов")


def test_match_prompts_and_options(spark):
    files = spark.createDataFrame([("/in/a.txt", "q" * 6000), ("/in/b.pdf", ""), ("/in/c.pdf", None)], "path string, text_sample string")
    ranked = spark.createDataFrame([("/in/a.txt", "2", 9, 1), ("/in/a.txt", "1", 8, 2)], "path string, tender_id string, score int, rn int")
    many = [(str(k), "Три" * 20, "", None) for k in range(3, 5000)]
    lots = spark.createDataFrame(
        [("1", "Один", "", None), ("2", "Два", "Завод", datetime(2024, 5, 1, 9, 5)), *many],
        "tender_id string, title string, customer string, deadline_at timestamp_ntz",
    )
    requests = scoring.match_requests(files, ranked)
    got = {r["path"]: r for r in requests.collect()}
    assert got["/in/a.txt"]["prompt"].count("q") == 5000 and vocab.MATCH_NO_TEXT in got["/in/c.pdf"]["prompt"]
    # The long list is written once and no prompt holds it.
    assert {r["option_set"] for r in got.values()} == {"/in/a.txt", scoring.EVERYONE}
    assert max(len(r["prompt"]) for r in got.values()) < 6000
    options = scoring.match_options(ranked, lots)
    assert options.count() == 2 + 4999

    def make():
        def scorer(prompt, files):
            if "c.pdf" in prompt:
                raise RuntimeError("no")
            return prompt.rpartition("Кандидаты:\n")[2]

        return scorer

    answers = {r["path"]: r for r in scoring.run_match_scorer(requests, options, make).collect()}
    assert answers["/in/a.txt"]["response"] == '- "2": Два | заказчик: Завод | дедлайн: 01.05.2024 09:05\n- "1": Один | заказчик: - | дедлайн: '
    assert answers["/in/b.pdf"]["response"].count("\n") == 4998
    assert (answers["/in/c.pdf"]["response"], answers["/in/c.pdf"]["error"]) == (None, "no")
