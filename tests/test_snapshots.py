from __future__ import annotations

import glob
import os
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from procura.operators import report
from procura.sources import listing, snapshots
from procura.streaming import reports
from tests.test_report import RESULT, result

DAYS = [None, *(datetime(2024, m, 3, 9) for m in (5, 6, 7))]
TAGS = ["Подано", "", "В работу", "Иное"]


def rows(spark, *of):
    return spark.createDataFrame(list(of), RESULT)


def shown(spark, path, version=None):
    return sorted((r["sheet"], r["number"], r["tender_id"], r["version"]) for r in report.read_report(spark, path, version).collect())


def counted(df):
    return sorted(tuple(r) for r in df.select("sheet", "ord", "tag", "n").collect())


def test_a_failed_update_leaves_the_report(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    report.update_report(path, rows(spark, result("1", DAYS[1], "Подано", 1, 1), result("2", DAYS[2], "", 1, 2)))
    before = shown(spark, path)

    def fails(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", fails)
        with pytest.raises(OSError):
            report.update_report(path, rows(spark, result("1", DAYS[2], "", 2, 1)))
    assert shown(spark, path) == before and snapshots.head(spark, path).version == 1
    # What the failed update left behind goes, and the report stays.
    assert snapshots.clean(spark, path, hours=0) == 2 and shown(spark, path) == before
    assert report.update_report(path, rows(spark, result("1", DAYS[2], "", 2, 1))) == 2
    assert shown(spark, path) == [("Июнь 2024", 1, "1", 2), ("Июнь 2024", 2, "2", 1)] and shown(spark, path, 1) == before


def test_two_writers_cannot_both_win(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    report.update_report(path, rows(spark, result("1", DAYS[1], "", 1, 1)))
    whole, entered = snapshots.write, []

    def overtaken(*args):
        written = whole(*args)
        if not entered:
            entered.append(1)
            report.update_report(path, rows(spark, result("2", DAYS[1], "", 1, 2)))
        return written

    monkeypatch.setattr(snapshots, "write", overtaken)
    with pytest.raises(snapshots.Conflict):
        report.update_report(path, rows(spark, result("3", DAYS[1], "", 1, 3)))
    assert [r[2] for r in shown(spark, path)] == ["1", "2"]
    assert report.update_report(path, rows(spark, result("3", DAYS[1], "", 1, 3))) == 3
    assert [r[2] for r in shown(spark, path)] == ["1", "2", "3"]
    assert not glob.glob(f"{path}/commits/_draft*")


def test_only_touched_sheets_are_written(spark, tmp_path):
    path = str(tmp_path / "r")
    report.update_report(path, rows(spark, *[result(str(i), DAYS[i % 4], "", 1, i) for i in range(12)]))
    first = snapshots.head(spark, path).parts
    report.update_report(path, rows(spark, result("1", DAYS[2], "", 2, 1), result("3", DAYS[1], "", 0, 3)))
    second = snapshots.head(spark, path).parts
    # The older write of lot 3 lost, so its sheet stays as well.
    assert {snapshots.value_of(f) for f in second if second[f] != first[f]} == {"Май 2024", "Июнь 2024"}


def test_counts_equal_a_recount(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "COUNT_PARTS", 2)
    path, rng, held = str(tmp_path / "r"), random.Random(1), {}
    for version in range(1, 5):
        some = [result(str(i), rng.choice(DAYS), rng.choice(TAGS), rng.choice([version, version - 2]), i) for i in rng.sample(range(9), 5)]
        report.update_report(path, rows(spark, *some))
        for r in some:
            held[r[0]] = r if r[0] not in held or r[7] >= held[r[0]][7] else held[r[0]]
        assert counted(report.stored_summary(spark, path)) == counted(report.tag_summary(rows(spark, *held.values())))
        assert {(r[2], r[3]) for r in shown(spark, path)} == {(r[0], r[7]) for r in held.values()}
    assert len(snapshots.head(spark, path).notes["counts"]) <= 2


def test_empty_updates_and_reports(spark, tmp_path):
    path = str(tmp_path / "r")
    unnamed = lambda day, version: (None, "t", "u", day, "", 5, "c", version, 1)
    with pytest.raises(FileNotFoundError):
        report.read_report(spark, path)
    assert report.update_report(path, rows(spark)) == 1 and shown(spark, path) == []
    report.update_report(path, rows(spark, unnamed(None, 1), result("", DAYS[1], "", 1, 2)))
    report.update_report(path, rows(spark, unnamed(DAYS[1], 2)))
    assert shown(spark, path) == [("Май 2024", 1, None, 2), ("Май 2024", 2, "", 1)]


def test_a_stream_ends_with_the_rows_of_one_upsert(spark, tmp_path):
    arrivals, path, mark = (str(tmp_path / n) for n in ("in", "r", "mark"))
    rng = random.Random(5)
    sent = [[result(str(rng.randint(0, 6)), rng.choice(DAYS), rng.choice(TAGS), 10 * b + i, i) for i in range(8)] for b in (2, 0, 3, 1)]
    follow = lambda: reports.follow_results(
        spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 1).parquet(arrivals), path, mark
    ).awaitTermination()
    for some in sent[:2]:
        rows(spark, *some).coalesce(1).write.mode("append").parquet(arrivals)
    follow()
    assert snapshots.head(spark, path).version == 2
    # The stream forgets its last batch, as if it had stopped just before it was noted.
    for f in (f"{mark}/commits/1", f"{mark}/commits/.1.crc"):
        if os.path.exists(f):
            os.unlink(f)
    before = shown(spark, path)
    follow()
    assert snapshots.head(spark, path).version == 2 and shown(spark, path) == before
    for some in sent[2:]:
        rows(spark, *some).coalesce(1).write.mode("append").parquet(arrivals)
    follow()
    last = {}
    for r in sorted((r for some in sent for r in some), key=lambda r: r[7]):
        last[r[0]] = r
    assert {(r[2], r[3]) for r in shown(spark, path)} == {(r[0], r[7]) for r in last.values()}
    assert snapshots.head(spark, path).version == 4


def test_due_days_are_read_from_their_folders(spark, tmp_path):
    path = str(tmp_path / "due")
    lots = [(i, f"t{i}", None if i % 50 == 0 else datetime(2024, 1 + i % 12, 1 + i % 28, 10)) for i in range(600)]
    df = spark.createDataFrame(lots, "row_number int, tender_id string, deadline_at timestamp_ntz")
    listing.store_by_due(df, path)
    days = spark.createDataFrame([(date(2024, 5, 5),), (date(2024, 5, 5),), (None,), (date(2030, 1, 1),)], "day date")
    found = listing.stored_due(spark, path, days)
    assert sorted(r["row_number"] for r in found.collect()) == [i for i, _, d in lots if d and d.date() == date(2024, 5, 5)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "due_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(due_day" in plan or "EqualTo(due_day" in plan
    read = {p.split("due_month=")[1].split("/")[0] for p in {r[0] for r in found.select(F.input_file_name()).collect()}}
    assert read == {"202405"} and len(glob.glob(f"{path}/due_month=*")) == 13
    few, listing.LISTED_DAYS = listing.LISTED_DAYS, 1
    try:
        joined = listing.stored_due(spark, path, days)
        assert sorted(joined.collect()) == sorted(found.collect())
    finally:
        listing.LISTED_DAYS = few
    assert listing.stored_due(spark, path, days.limit(0)).collect() == []
