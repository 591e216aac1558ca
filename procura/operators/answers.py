"""Model calls that survive: bounded concurrency, retries, timeouts, and a store of answers."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.operators.joins import checkpointed, lookup_join

Scorer = Callable[[str, list[str]], str]

# Hexadecimal digits that name a folder of the store: 256 folders, of which each is one
# task's at a time. Answers that are stored together.
_DIGITS, _FLUSH = 2, 100
_STORED = pa.schema([("digest", pa.string()), ("response", pa.string())])


@dataclass(frozen=True)
class Calls:
    """How a scorer is called.

    ``attempts`` per prompt, with a pause of ``pause`` seconds that doubles from one to
    the next; ``timeout`` seconds for each (None: no limit); ``concurrency`` calls at once
    in a task. A call past its timeout is abandoned, not stopped: its thread ends by itself.
    """

    attempts: int = 1
    pause: float = 1.0
    timeout: float | None = None
    concurrency: int = 1

    def once(self, scorer: Scorer, prompt: str, files: list[str]) -> str:
        if self.timeout is None:
            return scorer(prompt, files)
        result: list = []

        def work() -> None:
            try:
                result.append((scorer(prompt, files), None))
            except Exception as problem:
                result.append((None, problem))

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        thread.join(self.timeout)
        if not result:
            raise TimeoutError(f"no answer in {self.timeout:g} s")
        answer, problem = result[0]
        if problem is not None:
            raise problem
        return answer

    def ask(self, scorer: Scorer, prompt: str, files: list[str]) -> tuple[str | None, str | None]:
        """``answer, error``; the error of the last attempt, None after an answer."""
        for attempt in range(max(1, self.attempts)):
            try:
                return self.once(scorer, prompt, files), None
            except Exception as problem:
                error = str(problem)
                if attempt + 1 < self.attempts:
                    time.sleep(self.pause * 2**attempt)
        return None, error

    def ask_all(self, scorer: Scorer, asked: list[tuple[str, list[str]]]) -> list[tuple[str | None, str | None]]:
        """Answers in order; at most ``concurrency`` calls run at once."""
        if self.concurrency <= 1:
            return [self.ask(scorer, *a) for a in asked]
        with ThreadPoolExecutor(self.concurrency) as pool:
            return list(pool.map(lambda a: self.ask(scorer, *a), asked))


def request_digest(version: str = "") -> Column:
    """What an answer depends on: the scorer's version, the prompt and the files."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), "prompt", "files")), 256)


def _folder(store: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(store if ":" in store.split("/")[0] else f"file://{store}")


def stored(files: pyarrow.fs.FileSystem, folder: str, wanted: set[str]) -> dict[str, str]:
    """The answers kept in ``folder`` to ``wanted`` digests."""
    found: dict[str, str] = {}
    for info in files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as source:
                table = pq.read_table(source, schema=_STORED)
            found |= {d: r for d, r in zip(*(c.to_pylist() for c in table.columns), strict=True) if d in wanted}
    return found


def keep(files: pyarrow.fs.FileSystem, base: str, folder: str, answers: list[tuple[str, str]]) -> None:
    """Store answers; a file appears whole or not at all."""
    if not answers:
        return
    name = f"{uuid.uuid4()}.parquet"
    for path in (f"{base}/_unfinished", folder):
        files.create_dir(path, recursive=True)
    table = pa.table([pa.array(c, pa.string()) for c in zip(*answers, strict=True)], _STORED)
    with files.open_output_stream(f"{base}/_unfinished/{name}") as target:
        pq.write_table(table, target)
    files.move(f"{base}/_unfinished/{name}", f"{folder}/{name}")


def answered(requests: DataFrame, make_scorer: Callable[[], Scorer], store: str, calls: Calls, version: str = "") -> DataFrame:
    """``requests`` with ``response, error``; every prompt is asked once, ever.

    Answers are kept in ``store``, a folder that all executors reach (a path or a URI that
    pyarrow can open), under the digest of what they depend on, ``_FLUSH`` at a time as
    they arrive. A task looks its digests up before it asks: a second run asks nothing
    that was answered, and a task that died midway, run again, only what its last unkept
    answers held. Equal requests are asked once and joined to their answer. Failures are
    not kept, so another run tries them again.
    """
    files, base = _folder(store)
    files.create_dir(base, recursive=True)
    marked = requests.withColumn("_digest", request_digest(version))
    # Folders are dealt out whole, so that none is another task's at the same time.
    shard = F.left("_digest", F.lit(_DIGITS))
    asked = marked.select("_digest", "prompt", "files").dropDuplicates(["_digest"])
    asked = asked.repartition(shard).sortWithinPartitions("_digest")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, base), scorer = _folder(store), make_scorer()
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for digits, some in groupby(rows, lambda r: r[0][:_DIGITS]):
                group, folder = list(some), f"{base}/{digits}"
                known = stored(files, folder, {r[0] for r in group})
                out = [(d, answer, None) for d, answer in known.items()]
                new = [r for r in group if r[0] not in known]
                for start in range(0, len(new), _FLUSH):
                    part = new[start : start + _FLUSH]
                    replies = calls.ask_all(scorer, [(prompt, paths or []) for _, prompt, paths in part])
                    keep(files, base, folder, [(r[0], a) for r, (a, e) in zip(part, replies, strict=True) if e is None and a is not None])
                    out += [(r[0], a, e) for r, (a, e) in zip(part, replies, strict=True)]
                columns = [pa.array(c, pa.string()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["_digest", "response", "error"])

    answers = checkpointed(asked.mapInArrow(call, "_digest string, response string, error string"))
    return lookup_join(marked, answers, ["_digest"]).drop("_digest")
