from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from procura.sources import inventory
from procura.streaming import arrivals


def pack(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, body in members.items():
            archive.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return buffer.getvalue()


def docx(*parts):
    nodes = "".join(f"<w:t>{p}</w:t>" for p in parts)
    return pack(word__document_dot_xml=f'<w:d xmlns:w="urn:w">{nodes}<w:t/></w:d>')


def tree(root):
    (root / "T-1").mkdir()
    (root / "b c" / "d").mkdir(parents=True)
    (root / "T-1" / "a.ZIP").write_bytes(pack(x__1_dot_txt="one", y_dot_md="два"))
    (root / "broken.zip").write_bytes(b"no archive")
    (root / "b c" / "d" / "plan.txt").write_bytes("план ".encode() + b"\xff\xfe" + "B".encode())
    (root / "b c" / "doc.docx").write_bytes(docx("Раз", "два"))
    (root / "bad.docx").write_bytes(b"x")
    (root / "scan.pdf").write_bytes(b"%PDF")


def test_inventory_reads_no_content(spark, tmp_path):
    tree(tmp_path)
    listed = inventory.inventory(spark, str(tmp_path))
    rows = {r["rel_path"]: r for r in listed.collect()}
    assert sorted(rows) == ["T-1/a.ZIP", "b c/d/plan.txt", "b c/doc.docx", "bad.docx", "broken.zip", "scan.pdf"]
    assert rows["b c/d/plan.txt"]["top_dir"] == "b c" and rows["bad.docx"]["top_dir"] is None
    assert rows["T-1/a.ZIP"]["suffix"] == ".zip" and rows["T-1/a.ZIP"]["name"] == "a.ZIP"
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_archives_and_texts(spark, tmp_path):
    tree(tmp_path)
    binary = inventory.binary_files(spark, str(tmp_path)).withColumn("path", inventory.local_path(F.col("path")))
    zips = inventory.binary_files(spark, str(tmp_path), inventory.ARCHIVES)
    zips = zips.withColumn("path", inventory.local_path(F.col("path")))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in zips.select("path").collect()) == ["a.ZIP", "broken.zip"]
    members = inventory.expand_archives(zips)
    base = str(tmp_path) + "/T-1/a"
    got = sorted((r["archive"], r["path"], bytes(r["content"]).decode()) for r in members.collect())
    assert got == [(base + ".ZIP", base + "__extracted/x/1.txt", "one"), (base + ".ZIP", base + "__extracted/y.md", "два")]
    done = spark.createDataFrame([(base + ".ZIP",)], "archive string")
    assert inventory.expand_archives(binary, done).count() == 0

    everything = binary.select("path", "content").unionByName(members.select("path", "content"))
    texts = {r["path"].removeprefix(str(tmp_path) + "/"): r["text_sample"] for r in inventory.text_samples(everything).collect()}
    assert texts == {
        "T-1/a.ZIP": "", "broken.zip": "", "bad.docx": "", "scan.pdf": "",
        "b c/d/plan.txt": "план B", "b c/doc.docx": "Раз два ",
        "T-1/a__extracted/x/1.txt": "one", "T-1/a__extracted/y.md": "два",
    }
    short = inventory.text_samples(everything, max_chars=3).filter("path like '%doc.docx'").first()
    assert short["text_sample"] == "Раз"


def test_arrivals_are_expanded_once(spark, tmp_path):
    root, target, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    root.mkdir()
    (root / "a.zip").write_bytes(pack(one_dot_txt="1"))
    (root / "note.txt").write_text("x")

    def run():
        arrivals.expand_arrivals(spark, str(root), str(target), str(state)).awaitTermination()
        return sorted(r["member"] for r in spark.read.parquet(str(target)).collect())

    assert run() == ["one.txt"]
    (root / "b.zip").write_bytes(pack(two_dot_txt="2"))
    assert run() == ["one.txt", "two.txt"]
    assert run() == ["one.txt", "two.txt"]


def test_roots_of_every_form(spark, tmp_path):
    for name in ("A1/x.txt", "B 2/sub/%41.txt", "top.txt"):
        target = tmp_path / "in" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("t")
    want = [("A1", "A1/x.txt"), ("B 2", "B 2/sub/%41.txt"), (None, "top.txt")]
    for root in (f"{tmp_path}/in", f"{tmp_path}/in/", f"file:{tmp_path}/in", f"file://{tmp_path}/in/"):
        rows = inventory.inventory(spark, root).collect()
        assert sorted(((r["top_dir"], r["rel_path"]) for r in rows), key=str) == sorted(want, key=str), root
        assert {r["store"] for r in rows} == {"file:"}
        assert all(r["path"] == f"{tmp_path}/in/{r['rel_path']}" for r in rows)


def test_roots_in_a_store(spark):
    paths = ["s3a://bucket/in/A/x.txt", "hdfs://host:8020/in/B/y.txt", "file:/in/C/z.txt"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = files.select(inventory.local_path("path").alias("path"), inventory.store("path").alias("store"))
    for root in ("s3a://bucket/in", "hdfs://host:8020/in/", "/in", "file:///in"):
        got = [(r["store"], r["top_dir"], r["rel_path"]) for r in inventory.describe(rows, root).collect()]
        assert got == [("s3a://bucket", "A", "A/x.txt"), ("hdfs://host:8020", "B", "B/y.txt"), ("file:", "C", "C/z.txt")]


def test_listing_by_tasks(spark, tmp_path):
    """The rows of a scan and the empty files, for a tree with hidden names, deep and wide folders, and links."""
    root = tmp_path / "in"
    names = [f"wide{k}/a{k}.txt" for k in range(70)] + ["/".join("deep" for _ in range(12)) + "/x.txt", "B 2/sub/%41.txt", "top.txt", "zero.bin"]
    names += [".hidden/x.txt", "_temporary/x.txt", "_y=1/x.txt", "A/.x", "A/_x", "A/_metadata", "A/x._COPYING_", "A/größe #1?.txt"]
    for k, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"z" * (0 if name == "zero.bin" else k))
    (root / "empty").mkdir()
    (root / "link").symlink_to(root / "B 2")
    columns = ("path", "store", "rel_path", "top_dir", "name", "suffix", "length")
    want = inventory.inventory(spark, str(root)).select(*columns)
    assert want.count() > 70
    for form in (f"{root}", f"{root}/", f"file:{root}", f"file://{root}/"):
        got = inventory.listed(spark, form)
        assert sorted(got.columns) == sorted(columns)
        have, wanted = ({tuple(r) for r in d.select(*columns).collect()} for d in (got, want))
        assert not wanted - have, form
        # A scan has no rows for empty files.
        assert sorted((r[2], r[6]) for r in have - wanted) == [("wide0/a0.txt", 0), ("zero.bin", 0)], form
        assert got.count() == len(have)
    assert inventory.listed(spark, str(root / "empty")).collect() == []
    with pytest.raises(Exception, match="not exist|No such"):
        inventory.listed(spark, str(root / "missing")).collect()


def test_batches_of_bytes_are_bounded(spark):
    """Files reach Python in batches bounded by bytes, not by 10,000 rows of any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    files = spark.createDataFrame([("/a/x.docx", b"no file")], "path string, content binary")
    try:
        for job in (inventory.text_samples, inventory.expand_archives):
            spark.conf.unset(key)
            job(files)
            assert int(spark.conf.get(key)) <= 4 * 1024 * 1024
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
