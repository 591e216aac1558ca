"""Files under a folder, archive members and text samples.

File bytes never enter a shuffle: each job below is a map over ``binaryFile``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from procura.functions import text
from procura.operators.batches import release_memory, small_batches
from procura.operators.joins import checkpointed, lookup_join

# Bytes of members that are handed over at once.
_BATCH_BYTES = 4 * 1024 * 1024
_BATCH_ROWS = 1000
# Folders that one task lists, and tasks of a level at most.
_FOLDERS_PER_TASK, _LISTING_TASKS = 16, 4096
ARCHIVES = "*.[zZ][iI][pP]"
MEMBER_SCHEMA = "archive string, member string, path string, size long, content binary"


# Scheme and host in front of a path.
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?")


def local_path(c: Column) -> Column:
    """``file:/a`` and ``hdfs://host/a`` to ``/a``, percent signs kept as they are."""
    return F.regexp_replace(c, _SCHEME.pattern, "")


def store(c: Column) -> Column:
    """Scheme and host of a path, '' where it has none: ``s3a://bucket`` of ``s3a://bucket/a``."""
    return F.regexp_extract(c, _SCHEME.pattern, 0)


def describe(files: DataFrame, root: str) -> DataFrame:
    """Add ``rel_path, top_dir, name, suffix`` to a table with ``path``.

    ``top_dir`` is the folder directly below ``root``, NULL for files in ``root``. The root
    may be a path or a URI; ``path`` has no scheme and no host, as of ``local_path``.
    """
    base = _SCHEME.sub("", root).rstrip("/") + "/"
    rel = F.when(
        F.startswith(F.col("path"), F.lit(base)),
        F.substr(F.col("path"), F.lit(len(base) + 1)),
    ).otherwise(F.col("path"))
    return (
        files.withColumn("rel_path", rel)
        .withColumn(
            "top_dir",
            F.when(
                F.contains(F.col("rel_path"), F.lit("/")),
                F.substring_index("rel_path", "/", 1),
            ),
        )
        .withColumn("name", text.file_name(F.col("path")))
        .withColumn("suffix", F.lower(text.suffix(F.col("path"))))
    )


def binary_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root``, a path or a URI; the scan lists paths and reads no content.

    ``path`` begins with the folder; ``store`` is the scheme and host in front of it, which
    tell equal paths of two stores apart.
    """
    listed = binary_files(spark, root).select(
        local_path(F.col("path")).alias("path"), "length", store(F.col("path")).alias("store")
    )
    return describe(listed, root)


def _hidden(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def listed(spark: SparkSession, root: str, scheme: str | None = None) -> DataFrame:
    """The inventory of ``root`` (columns as of ``inventory``), listed by tasks, level by level.

    ``inventory`` leaves the listing to the driver, which then holds every path. Here a
    table of folders is dealt out, each is listed where it lands, and the folders found are
    the next level's table; the driver sees one flag a level. A folder with many folders
    below it so becomes the work of many tasks; a task holds the entries of one folder.
    ``root`` must be one that pyarrow can open on every executor; ``scheme`` replaces its
    scheme in ``store``, where Spark has another name for it (``s3a`` for ``s3``). The rows
    are those that Spark finds, and empty files, which its scan leaves out: hidden names
    (``.x``, ``_x`` without ``=``) are not listed, links are followed. A missing root raises an error; an empty one has no rows.
    """
    head = _SCHEME.match(root)
    head = head.group(0) if head else "file:"
    shown = head if scheme is None else scheme + head[head.index(":") :]
    # file://host and file:// are both the machine's own disk.
    shown = "file:" if shown.startswith("file:") else shown
    base = _SCHEME.sub("", root).rstrip("/")

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri = f"file://{base}" if head.startswith("file:") else head
        files = pyarrow.fs.LocalFileSystem() if head.startswith("file:") else pyarrow.fs.FileSystem.from_uri(uri)[0]
        bucket = head.partition("://")[2] if head.startswith(("s3", "gs", "abfs")) else ""
        for batch in batches:
            for folder in batch["folder"]:
                found = files.get_file_info(pyarrow.fs.FileSelector(f"{bucket}{folder}" or "/"))
                found = [i for i in found if not _hidden(i.base_name)]
                for start in range(0, len(found), _BATCH_ROWS):
                    part = found[start : start + _BATCH_ROWS]
                    yield pd.DataFrame({
                        "path": [f"{folder}/{i.base_name}" for i in part],
                        "is_folder": [i.type == pyarrow.fs.FileType.Directory for i in part],
                        "length": [i.size or 0 for i in part],
                    })

    folders, files = spark.createDataFrame([(base,)], "folder string"), []
    while True:
        found = checkpointed(folders.mapInPandas(entries, "path string, is_folder boolean, length long"))
        files.append(found.filter(~F.col("is_folder")).select("path", "length"))
        below = found.filter("is_folder").select(F.col("path").alias("folder"))
        n = below.count()
        if not n:
            break
        tasks = min(_LISTING_TASKS, -(-n // _FOLDERS_PER_TASK))
        folders = below.repartition(tasks)
    every = files[0]
    for level in files[1:]:
        every = every.unionByName(level)
    return describe(every.withColumn("store", F.lit(shown)), base)


def is_archive(path: Column) -> Column:
    return F.lower(text.suffix(path)) == ".zip"


def _members(path: str, content: bytes) -> Iterator[tuple[str, str, str, int, bytes]]:
    folder = path[: path.rfind(".")] + "__extracted/"
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        for member in archive.infolist():
            if member.is_dir():
                continue
            body = archive.read(member)
            parts = member.filename.split("/")
            inside = "/".join(p for p in parts if p not in ("", ".", ".."))
            yield path, member.filename, folder + inside, len(body), body
    except Exception:  # not an archive, encrypted or damaged: keep what was read
        return


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        yield from _expanded(batches)
    finally:
        release_memory()


def _expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["archive", "member", "path", "size", "content"]
    rows, held = [], 0
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            for row in _members(path, content):
                rows.append(row)
                held += row[3]
                # Hand over by bytes, so that large members never pile up.
                if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def expand_archives(archives: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Members of zip archives given as ``path, content``.

    Read them with ``binary_files(spark, root, ARCHIVES)``, so that no other file is
    opened.

    Unreadable archives give no rows. ``done`` (column ``archive``) names archives
    expanded earlier; they are left out before Python sees their bytes.
    """
    small_batches(archives.sparkSession)
    pending = archives.filter(is_archive(F.col("path"))).select("path", "content")
    if done is not None:
        seen = done.select(F.col("archive").alias("path")).distinct()
        pending = lookup_join(pending, seen, ["path"], "left_anti")
    return pending.mapInPandas(_expand, MEMBER_SCHEMA)


def _docx_text(content: bytes | None) -> str:
    """Text nodes of a word-processor file, joined by blanks; '' when unreadable."""
    if content is None:
        return ""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            tree = ElementTree.fromstring(archive.read("word/document.xml"))
    except Exception:
        return ""
    return " ".join(n.text or "" for n in tree.iter() if n.tag.endswith("}t"))


@F.pandas_udf(StringType())
def docx_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    try:
        for content in batches:
            yield content.map(_docx_text)
    finally:
        release_memory()


def plain_text(content: Column) -> Column:
    """UTF-8 text of raw bytes, with broken sequences left out."""
    whole = F.try_validate_utf8(content.cast("string"))
    # The replacement character marks broken bytes; only broken files pay for it.
    mended = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return F.coalesce(whole, mended)


def text_samples(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """``path, text_sample`` from ``path, content``.

    Plain text is decoded by built-in functions; only the bytes of word-processor
    files go through Python. Other kinds give ``''``. The whole text is kept unless
    ``max_chars`` is given.
    """
    small_batches(files.sparkSession)
    kind = F.lower(text.suffix(F.col("path")))
    # One pass over the bytes; Python gets NULL for all other kinds.
    from_docx = docx_text(F.when(kind == ".docx", F.col("content")))
    sample = (
        F.when(kind == ".docx", from_docx)
        .when(kind.isin(".txt", ".md"), plain_text(F.col("content")))
        .otherwise("")
    )
    out = files.select("path", sample.alias("text_sample"))
    if max_chars is not None:
        out = out.withColumn("text_sample", F.left("text_sample", F.lit(max_chars)))
    return out
