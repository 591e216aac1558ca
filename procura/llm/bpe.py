"""Byte-level BPE: merge ranks in a priority queue over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from procura.llm.common import release_memory

# What the vocabulary's pre-tokenizer cuts a text at. White space is the
# Unicode property, which differs from Python's own.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
# Pieces never cross from other characters to white space, so neither do these chunks.
_CHUNK = rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+"
# Encoded chunks and pieces that a worker keeps (some 200 bytes each); longer ones are not
# kept. Chunks of a text that are encoded at once, and bytes of text and ids that a task
# hands on at once.
KEPT, KEPT_CHARS, RUN, SLICE = 400_000, 64, 100_000, 4 * 1024 * 1024


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Vocabulary:
    """``pairs``: the rank of a pair of symbols (left * 2**32 + right); ``unions``: by rank."""

    pairs: dict[int, int]
    unions: list[int]
    of_byte: list[int]
    strings: dict[int, bytes]
    added: dict[str, int]
    known: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        """Ranks of all pairs of bytes, -1 for such that never merge."""
        first, self.of_bytes = np.full((256, 256), -1, np.int64), np.array(self.of_byte, np.int64)
        of = {symbol: byte for byte, symbol in enumerate(self.of_byte)}
        for pair, rank in self.pairs.items():
            left, right = of.get(pair >> 32), of.get(pair & 0xFFFFFFFF)
            if left is not None and right is not None:
                first[left, right] = rank
        self.first = first

    @classmethod
    def read(cls, text: str) -> Vocabulary:
        """From the JSON of a byte-level BPE tokenizer without normaliser or prefix space."""
        spec = json.loads(text)
        model, letters = spec["model"], _byte_letters()
        ids = model["vocab"]
        pairs, unions = {}, []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs.setdefault((ids[left] << 32) + ids[right], rank)
            unions.append(ids[left + right])
        strings = {i: bytes(letters[c] for c in s) for s, i in ids.items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        strings |= {i: s.encode() for s, i in added.items()}
        of_byte = [0] * 256
        for letter, byte in letters.items():
            of_byte[byte] = ids[letter]
        return cls(pairs, unions, of_byte, strings, added)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of some pieces, none of them empty, each as four little-endian bytes.

        All pieces are one linked list of symbols without links between pieces. The queue
        holds rank * 2**32 + place of the left symbol for neighbours that merge. An entry
        is stale, and skipped, when the pair at its place no longer has that rank.
        """
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, starts = len(data), np.cumsum([0, *map(len, pieces)])
        places = np.arange(-1, n + 1)
        before, after, symbols = places[:-2].copy(), places[2:].copy(), self.of_bytes[data].tolist()
        before[starts[:-1]], after[starts[1:] - 1] = -1, n
        rank_at = np.append(self.first[data[:-1], data[1:]], -1)
        rank_at[starts[1:] - 1] = -1
        at = np.flatnonzero(rank_at >= 0)
        queue = np.sort((rank_at[at] << 32) + at).tolist()  # a sorted list is a heap
        before, after, rank_at = before.tolist(), after.tolist(), rank_at.tolist()
        ranks, unions, push, pop = self.pairs.get, self.unions, heapq.heappush, heapq.heappop
        while queue:
            entry = pop(queue)
            k, rank = entry & 0xFFFFFFFF, entry >> 32
            if rank_at[k] != rank:
                continue
            next_ = after[k]
            symbols[k] = union = unions[rank]
            symbols[next_] = rank_at[next_] = -1
            following = after[k] = after[next_]
            if following < n:
                before[following] = k
                rank_at[k] = rank = ranks((union << 32) + symbols[following], -1)
                if rank >= 0:
                    push(queue, (rank << 32) + k)
            else:
                rank_at[k] = -1
            previous = before[k]
            if previous >= 0:
                rank_at[previous] = rank = ranks((symbols[previous] << 32) + union, -1)
                if rank >= 0:
                    push(queue, (rank << 32) + previous)
        symbols = np.array(symbols, np.int64)
        left = symbols >= 0
        cuts = np.append(0, 4 * np.cumsum(np.add.reduceat(left, starts[:-1], dtype=np.int64))).tolist()
        ids = symbols[left].astype("<u4").tobytes()
        return [ids[x:y] for x, y in zip(cuts, cuts[1:])]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of new chunks; chunks that differ in their signs share their pieces."""
        cut = {chunk: _pieces().findall(chunk) for chunk in chunks}
        new = list({p for found in cut.values() for p in found if p not in self.known})
        pieces = [p.encode("utf-8", "surrogatepass") for p in new]
        found = dict(zip(new, self.merged(pieces), strict=True)) if new else {}
        get = lambda p: found.get(p) or self.known[p]
        return found | {chunk: b"".join(map(get, some)) for chunk, some in cut.items()}

    def encode(self, text: str) -> bytes:
        """The ids of a text, each as four little-endian bytes; added tokens are matched first.

        Encoded chunks and pieces are kept in one store; when it is full, the older half goes.
        """
        known, out = self.known, []
        parts = _split(tuple(self.added))(text) if self.added else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            chunks = _chunks().findall(part)
            for start in range(0, len(chunks), RUN):
                run = chunks[start : start + RUN]
                ids = list(map(known.get, run))
                if None in ids:
                    new = self._learn({c for c, i in zip(run, ids, strict=True) if i is None})
                    ids = [new[c] if i is None else i for c, i in zip(run, ids, strict=True)]
                    known.update((c, i) for c, i in new.items() if len(c) <= KEPT_CHARS)
                    if len(known) > KEPT:
                        for c in list(islice(known, len(known) // 2)):
                            del known[c]
                out += ids
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: their strings in a row, bytes that are no UTF-8 replaced."""
        return b"".join(map(self.strings.__getitem__, array("I", ids))).decode("utf-8", "replace")


_compiled: dict = {}


def _chunks() -> re.Pattern:
    if "chunk" not in _compiled:
        _compiled["chunk"] = re.compile(_CHUNK)
    return _compiled["chunk"]


def _pieces() -> regex.Pattern:
    if "piece" not in _compiled:
        _compiled["piece"] = regex.compile(_PIECE)
    return _compiled["piece"]


def _split(tokens: tuple[str, ...]):
    if tokens not in _compiled:
        longest_first = sorted(tokens, key=len, reverse=True)
        _compiled[tokens] = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split
    return _compiled[tokens]


def vocabulary(spark: SparkSession, path: str):
    """The tokenizer file as text, sent to each executor once; it has a fixed size."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _vocabulary(text: str) -> Vocabulary:
    """The parsed vocabulary with what it encoded before, for the life of a Python worker.

    Functions travel by value, so their globals end with the task; this lives in a module
    of the worker. One vocabulary is kept at a time.
    """
    home = sys.modules.setdefault("_procura_vocabulary", types.ModuleType("_procura_vocabulary"))
    key = zlib.crc32(text.encode())
    if getattr(home, "key", None) != key:
        own = Vocabulary.read(text)
        # Plain values: a class that travelled with a function is another one in each task.
        home.key, home.values = key, {f.name: getattr(own, f.name) for f in fields(own)}
    return Vocabulary(**home.values)


def encoded(text: Column, sent) -> Column:
    """Ids of a text column as an array; null texts count as empty."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        v = _vocabulary(sent.value)
        return pd.Series([np.frombuffer(v.encode(t if isinstance(t, str) else ""), np.int32) for t in texts], dtype=object)

    return ids(text)


def decoded(ids: Column, sent) -> Column:
    """Texts of a column of ids; null stays null."""

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        v = _vocabulary(sent.value)
        return pd.Series([None if x is None else v.decode(np.asarray(x, np.uint32).tobytes()) for x in column], dtype=object)

    return texts(ids)


def _slices(batches: Iterator[pd.Series], sent, keep: bool = True) -> Iterator[tuple[list[bytes], list[str]]]:
    """Ids and digests of what they decode to, some ``SLICE`` bytes at once.

    Without ``keep`` the store ends with the task, for jobs whose next stages need the
    worker's memory for something else.
    """
    try:
        yield from _encoded_slices(batches, sent)
    finally:
        if not keep:
            sys.modules.pop("_procura_vocabulary", None)
        release_memory()


def _encoded_slices(batches: Iterator[pd.Series], sent) -> Iterator[tuple[list[bytes], list[str]]]:
    release_memory()
    v, ids, back, held = _vocabulary(sent.value), [], [], 0
    for texts in batches:
        for t in texts:
            ids.append(v.encode(t if isinstance(t, str) else ""))
            back.append(hashlib.sha256(v.decode(ids[-1]).encode("utf-8", "surrogatepass")).hexdigest())
            held += len(ids[-1])
            if held > SLICE:
                yield ids, back
                ids, back, held = [], [], 0
    yield ids, back


def digests(text: Column, sent) -> Column:
    """Struct of ``n_tokens, ids_sha256, decoded_sha256``, without the ids leaving the task.

    The text is encoded and what comes out is decoded again, so a row proves its own
    round trip. Null texts count as empty.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for ids, back in _slices(batches, sent):
            n, digest = [len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids]
            yield pd.DataFrame({"n_tokens": pd.Series(n, dtype="int64"), "ids_sha256": pd.Series(digest, dtype=object), "decoded_sha256": pd.Series(back, dtype=object)})

    return run(text)


def tokens(text: Column, sent) -> Column:
    """Struct of ``token_ids, n_tokens, decoded_sha256``; null texts count as empty.

    What was encoded is kept for one task only.
    """

    @F.pandas_udf("token_ids array<int>, n_tokens long, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for ids, back in _slices(batches, sent, keep=False):
            rows = pd.Series([np.frombuffer(i, np.int32) for i in ids], dtype=object)
            n = pd.Series([len(i) // 4 for i in ids], dtype="int64")
            yield pd.DataFrame({"token_ids": rows, "n_tokens": n, "decoded_sha256": pd.Series(back, dtype=object)})

    return run(text)
