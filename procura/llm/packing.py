"""Best-fit packing: token pieces into as few sequences of a fixed length as can be found.

There are no more kinds of piece than lengths, so a packing is a short list of patterns,
each a multiset of lengths and a number of copies. The search works on the counts of the
lengths, a table of one row per length at most, however many documents there are; the
pieces themselves are numbered and dealt out by Spark.
"""

from __future__ import annotations

import os
import sys
import types
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.operators.joins import checkpointed
from procura.operators.ordering import ordinal

CAPACITY, END = 2048, 0
# Nodes of the search, fillings tried at each, steps of looking for them, nodes of large
# counts between two best-fit packings of the rest.
NODES, WIDTH, STEPS, EVERY = 3000, 6, 300, 8
# Pieces that are few enough to be packed at each node.
SMALL = 64
# Bytes of encoded words that a worker keeps, the longest word kept, words encoded at once.
KEPT_BYTES, KEPT_WORD, RUN = 160 * 1024 * 1024, 64, 100_000
_ENTRY_BYTES = 200
# Signs that may end a word, and how many of them are looked at apart from it.
SIGNS, TAIL = b"!#$%&*,.:;?", 4

Pattern = tuple[int, tuple[int, ...]]


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best fit by falling size, on counts by size (``counts[s]``; the last is capacity).

    Open sequences are classes of equal contents. All pieces of a size are dealt out at
    once, to the fullest class that has room, as many to each sequence as fit.
    """
    capacity = len(counts) - 1
    classes: dict[int, list[list]] = {}  # by room: [copies, sizes]
    rooms: list[int] = []  # rooms in use, rising

    def put(room: int, copies: int, sizes: tuple[int, ...]) -> None:
        if room not in classes:
            classes[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        classes[room].append([copies, sizes])

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            at = bisect_right(rooms, size - 1)
            if at < len(rooms):
                room = rooms[at]
                copies, sizes = classes[room].pop()
                if not classes[room]:
                    del classes[room], rooms[at]
            else:
                room, copies, sizes = capacity, -(-left // (capacity // size)), ()
            each = room // size
            full = min(copies, left // each)
            if full:
                put(room - each * size, full, sizes + (size,) * each)
                left -= full * each
            if full < copies and left:
                put(room - left * size, 1, sizes + (size,) * left)
                left, full = 0, full + 1
            if full < copies and sizes:
                put(room, copies - full, sizes)
    return [(copies, sizes) for some in classes.values() for copies, sizes in some]


def waste_bound(counts: np.ndarray) -> int:
    """Room that any packing leaves empty.

    From the largest size down, what is left beside pieces of a size can only be filled
    by pieces no larger than it. Where those that were not counted for a larger size do
    not suffice, the difference is lost.
    """
    capacity = len(counts) - 1
    sums = np.cumsum(counts * np.arange(capacity + 1))
    waste = used = 0
    for size in np.flatnonzero(counts)[::-1].tolist():
        room = capacity - size
        if 2 * size <= capacity:
            break
        need = int(counts[size]) * room
        free = int(sums[min(room, size - 1)]) - used
        waste += max(0, need - free)
        used += min(need, free)
    return waste


def fillings(counts: np.ndarray, first: int, width: int = WIDTH, steps: int = STEPS) -> list[tuple[int, ...]]:
    """Undominated fillings around one piece of size ``first``, by falling sum.

    A filling is dominated when a piece left out would fit in place of one of its own
    (or of nothing) and leave less room. ``steps`` bounds the pieces tried, ``width`` the
    fillings returned; of equal sums those of few, large pieces come first.
    """
    capacity = len(counts) - 1
    have = counts.copy()
    have[first] -= 1
    sizes = np.flatnonzero(have).tolist()
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [steps]

    def undominated(chosen: tuple[int, ...], room: int) -> bool:
        taken = Counter(chosen)
        for own in (0, *taken):
            at = bisect_right(sizes, own + room) - 1
            while at >= 0 and sizes[at] > own:
                if have[sizes[at]] > taken[sizes[at]]:
                    return False
                at -= 1
        return True

    def fill(room: int, most: int, chosen: tuple[int, ...]) -> None:
        at, any_fits = bisect_right(sizes, min(room, most)) - 1, False
        while at >= 0 and budget[0] > 0:
            size = sizes[at]
            if have[size] > (chosen.count(size) if size == most else 0):
                any_fits = True
                budget[0] -= 1
                fill(room - size, size, (*chosen, size))
                if room == size:
                    break
            at -= 1
        if not any_fits and undominated(chosen, room):
            found.append((room, chosen))

    fill(capacity - first, capacity, ())
    best = sorted(set(found), key=lambda f: (f[0], len(f[1]), [-s for s in f[1]]))
    return [(first, *chosen) for _, chosen in best[:width]]


def pack(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns that hold ``counts[size]`` pieces of every size, as few as are found.

    Bin completion: a node takes the largest piece left and branches over the undominated
    fillings around it, as many copies at once as the counts allow and then one copy. The
    first incumbent is the best-fit packing; at every ``EVERY``-th node, and near the
    end at each, the rest is packed by best fit as well. Branches whose room lost so far, with the bound of what the rest must lose,
    does not allow a sequence less than the incumbent are pruned. The search ends when
    the incumbent meets the bound, when no branch is left (then the result is the
    least, as long as no list of fillings was cut) or after ``nodes`` nodes.
    """
    start = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        start[size] = n
    whole = [(int(start[capacity]), (capacity,))] if start[capacity] else []
    start[capacity] = 0
    total = int((start * np.arange(capacity + 1)).sum())
    best = best_fit(start)
    fewest = sum(c for c, _ in best)
    least = -(-(total + waste_bound(start)) // capacity)
    stack: list[tuple[np.ndarray, tuple, int, int]] = [(start, (), 0, 0)]  # rest, patterns (linked), sequences, waste
    while stack and fewest > least and nodes:
        rest, done, used, waste = stack.pop()
        nodes -= 1
        if waste + waste_bound(rest) > (fewest - 1) * capacity - total:
            continue
        tail = best_fit(rest) if nodes % EVERY == 0 or rest.sum() <= SMALL else None
        if tail is not None and used + sum(c for c, _ in tail) < fewest:
            fewest, best, link = used + sum(c for c, _ in tail), tail, done
            while link:
                best, link = [*best, link[0]], link[1]
        if not rest.any():
            continue
        children = []
        for filling in fillings(rest, int(np.flatnonzero(rest)[-1])):
            need = Counter(filling)
            most = min(int(rest[s]) // n for s, n in need.items())
            for copies in dict.fromkeys((most, 1)):
                left = rest.copy()
                for s, n in need.items():
                    left[s] -= n * copies
                lost = copies * (capacity - sum(filling))
                children.append((left, ((copies, filling), done), used + copies, waste + lost))
        stack += reversed(children)
    return whole + best


def _worker_store(tokenizer_json: str) -> types.ModuleType:
    """What a Python worker keeps from task to task: ``words``, encoded before, and the library.

    Functions travel by value, so their globals end with the task; this lives in a module
    of the worker. One tokenizer's words are kept at a time. ``library`` is the whole
    tokenizer, ``letters`` its model alone, for words of a-z; ``ends`` marks the ids that
    end a word (none does in a vocabulary without such a mark), ``tails`` the ids of signs
    at the end of a word.
    """
    home, key = sys.modules.setdefault("_procura_words", types.ModuleType("_procura_words")), zlib.crc32(tokenizer_json.encode())
    if getattr(home, "key", None) != key:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        library = Tokenizer.from_str(tokenizer_json)
        library.no_truncation()
        library.no_padding()
        vocabulary = library.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        letters = Tokenizer(library.model)
        letters.pre_tokenizer = WhitespaceSplit()
        home.words, home.tails, home.library, home.letters, home.ends = {}, {}, library, letters, ends
        home.key = key
    return home


def word_encoder(tokenizer_json: str):
    """``encode(text) -> bytes``: the ids of a text, four little-endian bytes each.

    For tokenizers that drop white space: no token spans it, so a text's ids are those of
    its words in a row, and the library is asked for words it was not asked before. Words
    are cut at ASCII white space only, which is white space to every tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    kept = _worker_store(tokenizer_json)
    library, known, tails, ends = kept.library, kept.words, kept.tails, kept.ends
    plain = ends.any()  # the vocabulary marks the ends of words

    def one_by_one(words: list[str]) -> list[bytes]:
        found = library.encode_batch_fast(words, add_special_tokens=False) if words else ()
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def in_a_row(words: list[str], library) -> list[bytes]:
        """Words of letters only, asked as one text: each ends at the one token that ends a word."""
        if not words:
            return []
        ids = np.array(library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(cuts) != len(words):
            return one_by_one(words)
        ids = ids.tobytes()
        return [ids[x:y] for x, y in zip([0, *cuts], cuts)]

    def letters_only(word: str) -> bool:
        """Whether a word is letters also in the form that the library cuts: some letters fall apart."""
        return unicodedata.normalize("NFC", word).lower().isalpha()

    def tail_ids(tail: bytes) -> bytes | None:
        """Ids of signs behind a word; None where they are not those that the signs have alone."""
        if tail not in tails:
            alone, word, both = one_by_one([tail.decode(), "a", f"a{tail.decode()}"])
            tails[tail] = alone if both == word + alone else None
        return tails[tail]

    def ask(words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words; such that differ in the signs behind them or in A-Z share their stem."""
        stems: dict[bytes, tuple[bytes, bytes]] = {}
        odd: dict[bytes, str] = {}
        for w in words:
            stem = w.rstrip(SIGNS)
            tail = w[len(stem) :]
            ids = b"" if not tail else tail_ids(tail) if plain and len(tail) <= TAIL else None
            if plain and ids is not None and stem.isalpha():  # bytes: ASCII letters
                stems[w] = stem.lower(), ids
            elif plain and ids is not None and letters_only(stem.decode("utf-8", "surrogatepass")):
                stems[w] = stem, ids
            else:
                odd[w] = w.decode("utf-8", "surrogatepass")
        new = {stem for stem, _ in stems.values() if stem not in known}
        few, others = [s for s in new if s.isascii()], [s for s in new if not s.isascii()]
        found = dict(zip(few, in_a_row([s.decode() for s in few], kept.letters), strict=True))
        found |= zip(others, in_a_row([s.decode("utf-8", "surrogatepass") for s in others], library), strict=True)
        found |= zip(odd, one_by_one(list(odd.values())), strict=True)
        for w, (stem, ids) in stems.items():
            found[w] = (found.get(stem) or known[stem]) + ids
        return found

    def encode(text: str | None) -> bytes:
        out, words = [], text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
        for start in range(0, len(words), RUN):
            run = words[start : start + RUN]
            ids = list(map(known.get, run))
            if None in ids:
                new = ask({w for w, i in zip(run, ids, strict=True) if i is None})
                ids = [new[w] if i is None else i for w, i in zip(run, ids, strict=True)]
                known.update((w, i) for w, i in new.items() if len(w) <= KEPT_WORD)
                if len(known) * _ENTRY_BYTES > KEPT_BYTES:  # the older half goes
                    for w in list(islice(known, len(known) // 2)):
                        del known[w]
            out += ids
        return b"".join(out)

    return encode


def cut(docs: DataFrame, sent, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``_id, piece, start, length, ids_crc32``: every document's tokens and ``end``, cut to pieces.

    ``_id`` is the id as text, as pandas has no whole numbers beside nulls.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_encoder(sent.value)
        for batch in batches:
            rows = []
            for n, text in enumerate(batch["_text"]):
                ids = encode(text) + end.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((n, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            n, *columns = np.array(rows, np.int64).reshape(-1, 5).T
            named = dict(zip(("piece", "start", "length", "ids_crc32"), columns, strict=True))
            yield pd.DataFrame({"_id": batch["_id"].to_numpy()[n]} | named)

    asked = docs.select(F.col(id_column).cast("string").alias("_id"), F.col(text_column).alias("_text"))
    return asked.mapInPandas(pieces, "_id string, piece int, start long, length long, ids_crc32 long")


def deal(pieces: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """``sequence_id, offset`` for pieces numbered from 1 within their length (``_rank``).

    A pattern with g pieces of a size and m copies has g * m places for the size; the
    pieces of a size take the places of all patterns in a row. The places are described
    by one row per pattern and size, of which there are few.
    """
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for copies, sizes in patterns:
        offset = 0
        for size, n in sorted(Counter(sizes).items(), reverse=True):
            places.setdefault(size, []).append((taken[size], n, sequence, offset))
            taken[size] += n * copies
            offset += n * size
        sequence += copies
    table = {size: np.array(rows, np.int64).T for size, rows in places.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch.pop("_rank").to_numpy() - 1
            sequences, offsets = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                first, n, base, offset = table[int(size)]
                at = np.searchsorted(first, rank[own], "right") - 1
                place = rank[own] - first[at]
                sequences[own] = base[at] + place // n[at]
                offsets[own] = offset[at] + place % n[at] * size
            yield batch.assign(sequence_id=sequences, offset=offsets)

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.drop("_rank").dtypes)
    return pieces.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, sent, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end: int = END, nodes: int = NODES
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    ``sent``: a broadcast tokenizer file (``bpe.vocabulary``). A document is its ids and
    ``end``; longer ones than ``capacity`` are cut. Pieces are written once without their
    text, their lengths counted, the counts packed (``pack``), and the pieces numbered
    within their length in range partitions, so that a length which most pieces have is
    spread over many tasks.

    Null and empty texts are one piece, of ``end`` alone. Null ids and rows that repeat
    an id, or id and text, are documents each. An empty table gives no rows. Other
    columns do not matter, whatever their names.
    """
    pieces = checkpointed(cut(docs, sent, id_column, text_column, capacity, end))
    counts = {size: n for size, n in pieces.groupBy("length").count().collect()}
    patterns = pack(counts, capacity, nodes)
    # The order within a length is that of the written rows, which no id can skew.
    numbered = ordinal(pieces.withColumn("_row", F.monotonically_increasing_id()), [F.col("_row")], "_rank", group="length")
    dealt = deal(numbered.drop("_row"), patterns)
    return dealt.select(F.col("_id").cast(docs.schema[id_column].dataType).alias(id_column), *dealt.columns[1:])
