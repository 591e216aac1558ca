"""Phrase collocations from a prefix-free parse.

Texts are cut into chunks at trigger words, which their own content chooses, so that equal
passages are cut alike wherever they stand. Chunks overlap by the words that a phrase may
reach into the next one; a phrase is counted in the chunk it starts in, in the part that
the chunk does not share with the next. The distinct chunks are the dictionary, and their
frequencies in the parse are the weights that phrases inside them are counted with: a
passage that a thousand documents share is looked at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.llm.common import mix, shared_table
from procura.operators.joins import checkpointed, lookup_join

LONGEST, LEAST, CONTAINED, TOP = 4, 30, 80, 2000
# One word in so many starts a chunk; bytes of chunks that a task gathers before it hands
# them on; words that are counted at once.
SPACING, GATHERED, WORDS = 16, 32 * 1024 * 1024, 2_000_000
# Bits of the filter of frequent phrases, 16 MB: its size does not depend on the data.
BITS = 1 << 27
SALTS = 64
_SCALE = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Pieces end at these bytes, words at blanks and tabs; A-Z are lower-cased.
_FOLD = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b | 32 if 65 <= b <= 90 else b for b in range(256))


def pieces(text: str | None) -> list[bytes]:
    """The words of every piece of a text, with a blank after each; pieces without a word are left out."""
    if not isinstance(text, str):
        return []
    found = (p.split() for p in text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b"\n"))
    return [b" ".join(words) + b" " for words in found if words]


def chunks(piece: bytes, longest: int = LONGEST, spacing: int = SPACING) -> Iterator[tuple[int, bytes]]:
    """``own, words``: the chunks of a piece, each with the number of words that are its own.

    A chunk begins at the start of the piece and at each trigger, a word whose checksum is
    a multiple of ``spacing``. It reaches ``longest - 1`` words into what follows.
    """
    words = piece.split()
    starts = [0, *(k for k, w in enumerate(words) if k and zlib.crc32(w) % spacing == 0), len(words)]
    for start, end in zip(starts, starts[1:]):
        yield end - start, b" ".join(words[start : end + longest - 1]) + b" "


def parse(docs: DataFrame, text_column: str, lang_column: str, longest: int = LONGEST, spacing: int = SPACING) -> DataFrame:
    """``lang, own, words, n``: the dictionary of distinct chunks and how often each occurs.

    Pieces of fewer than ``spacing`` words are a chunk each (``own`` is 0 for all of its
    words), longer ones are cut. Tasks count their chunks before the shuffle, so that a
    passage on a third of all rows sends one row from each.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[str, Counter] = {}
        parts: dict[str, Counter] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = pieces(text)
                long = [p for p in found if len(p) > 2 * spacing and p.count(b" ") > spacing]
                if long:
                    parts.setdefault(lang, Counter()).update(c for p in long for c in chunks(p, longest, spacing))
                    found = [p for p in found if p.count(b" ") <= spacing]
                whole.setdefault(lang, Counter()).update(found)
                held += len(text) if text else 0
                if held > GATHERED:
                    yield from tables(whole, parts)
                    whole, parts, held = {}, {}, 0
        yield from tables(whole, parts)

    def tables(whole: dict[str, Counter], parts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in whole.items():
            yield table(lang, [0] * len(found), found, found.values())
        for lang, found in parts.items():
            yield table(lang, [own for own, _ in found], [words for _, words in found], found.values())

    def table(lang: str, own: Sequence[int], words, n) -> pa.RecordBatch:
        columns = [pa.repeat(pa.scalar(lang), len(own)), pa.array(own, pa.int64()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(n), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "own", "words", "n"])

    lang = F.coalesce(F.col(lang_column), F.lit("und")).alias("lang")
    chunked = docs.select(lang, F.col(text_column).alias("_text")).mapInArrow(cut, "lang string, own long, words string, n long")
    return chunked.groupBy("lang", "own", "words").agg(F.sum("n").alias("n"))


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang))


def _hashes(words: np.ndarray, longest: int, seed: np.uint64) -> Iterator[np.ndarray]:
    """Hashes of the phrases of 1, 2, ... words that start at each place of ``words`` (hashed)."""
    h = mix(words + seed)
    for n in range(1, longest + 1):
        yield h
        if n < longest:
            h = mix(h[:-1] * _STEP + words[n:])


def _phrase_hash(lang: str, phrase: str) -> int:
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in phrase.split(" ")], np.uint64)
    *_, last = _hashes(words, len(words), _seed(lang))
    return int(last[0])


def phrase_filter(frequent: DataFrame) -> bytes:
    """A bit for every hash of a frequent phrase; ``BITS`` bits in all, however many there are."""

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [1 + _phrase_hash(a, b) % BITS for a, b in zip(batch["lang"], batch["phrase"], strict=True)]
            yield pd.DataFrame({"slot": np.array(found, np.int64)})

    table = frequent.select("lang", "phrase").mapInPandas(slots, "slot long")
    rows = table.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    whole = bytearray(BITS // 8)
    for bucket, bits in rows.collect():  # slots and buckets count from 1
        whole[(bucket - 1) * len(bits) : bucket * len(bits)] = bits
    return bytes(whole)


def count_phrases(dictionary: DataFrame, sizes: Sequence[int], sent, base: int, least: int) -> DataFrame:
    """``lang, phrase, f``: phrases of ``sizes`` words that occur ``least`` times or more.

    ``sent``: the broadcast filter of frequent phrases of ``base`` words, or None. A phrase
    that holds ``base`` words in a row which the filter does not know cannot be frequent
    and is left out; the filter may know too much, never too little, and counts are by the
    phrases themselves. Tasks count within some ``WORDS`` words before rows are formed, and
    Spark before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8) if sent else None
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("words").nbytes
            if size > 8 * WORDS:
                yield from counted(pa.Table.from_batches(held).combine_chunks(), bits)
                held, size = [], 0
        if held:
            yield from counted(pa.Table.from_batches(held).combine_chunks(), bits)

    def counted(rows: pa.Table, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for lang in pc.unique(rows["lang"]).to_pylist():
            some = rows.filter(pc.equal(rows["lang"], lang)).combine_chunks()
            column = some["words"].chunk(0).cast(pa.large_string())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            text = memoryview(column.buffers()[2])[offsets[0] : offsets[-1]]
            # Every word has a blank behind it, so the column's bytes are one list of words.
            lengths = np.diff(np.searchsorted(np.flatnonzero(np.frombuffer(text, np.uint8) == 32), offsets - offsets[0]))
            words = text.tobytes().split(b" ")
            words.pop()
            vocabulary = {w: k for k, w in enumerate(dict.fromkeys(words))}
            ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
            del words
            own = some["own"].to_numpy()
            place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            left = np.repeat(lengths, lengths) - place  # words from here to the chunk's end
            starts = place < np.repeat(np.where(own == 0, lengths, own), lengths)
            weights = np.repeat(some["n"].to_numpy(), lengths)
            names = np.array(list(vocabulary), object)
            if bits is not None:
                hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))[ids]
                *_, part = _hashes(hashed, base, _seed(lang))
                slot = part % np.uint64(BITS)
                there = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                there = np.append(there, np.zeros(len(ids) - len(there), bool))
            for n in sizes:
                kept = starts & (left >= n)
                if bits is not None:
                    for j in range(n - base + 1):
                        kept[: len(ids) - j] &= there[j:]
                at = np.flatnonzero(kept)
                if len(at):
                    yield grouped(lang, n, at, ids, weights[at], names)

    def grouped(lang: str, n: int, at: np.ndarray, ids: np.ndarray, weights: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        key = ids[at]
        for j in range(1, n):
            if int(key.max()) + 1 > (2**62) // len(names):
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(names) + ids[at + j]
        order = np.argsort(key)
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        f = np.add.reduceat(weights[order], first)
        one = at[order[first]]
        phrase = names[ids[one]]
        for j in range(1, n):
            phrase = phrase + b" " + names[ids[one + j]]
        columns = [pa.repeat(pa.scalar(lang), len(f)), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

    counts = dictionary.select("lang", "own", "words", "n").mapInArrow(count, "lang string, phrase string, f long")
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def score() -> Column:
    """floor(2000000 * a / (l + r)) in decimal numbers, so that no product overflows."""
    return F.expr(f"{_SCALE}BD * cast(a AS decimal(19,0)) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")


def _words(first: Column | int, n: Column | int) -> Column:
    """``n`` words of the column ``_words`` from the ``first`` (from 1), as a phrase."""
    return F.array_join(F.slice("_words", first, n), " ")


def collocations(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    least: int = LEAST,
    contained: int = CONTAINED,
    top: int = TOP,
    longest: int = LONGEST,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of a language that hold together.

    Candidates are phrases of 2 to ``longest`` words with ``a >= least`` occurrences within
    pieces. A cut after k words leaves parts with ``l`` and ``r`` occurrences, its score is
    floor(2000000 * a / (l + r)), and the lowest-scoring cut counts. Candidates inside a
    longer one with ``contained`` percent of their occurrences or more are dropped, and
    the ``top`` first of each language returned. ``n`` counts the words of the language.

    Counting goes by length: a phrase can only be frequent if all phrases inside it are,
    which a filter of fixed size tells; two lengths share a pass over the dictionary. Parts of candidates are found in the table of
    frequent phrases, as they occur at least as often.

    Null and empty texts hold nothing; a null language is ``und``, together with texts that
    say so. Repeated rows count each. Without a candidate there are no rows. Other columns
    do not matter, whatever their names.
    """
    with shared_table(parse(docs, text_column, lang_column, longest)) as dictionary:
        blanks = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit("")))
        words = F.sum(F.when(F.col("own") == 0, blanks).otherwise(F.col("own")) * F.col("n"))
        totals = checkpointed(dictionary.groupBy("lang").agg(words.alias("n")))
        found = checkpointed(count_phrases(dictionary, [1, 2], None, 0, least))
        for n in range(3, longest + 1, 2):
            base = found.where(F.size(F.split("phrase", " ")) == n - 1)
            sent = docs.sparkSession.sparkContext.broadcast(phrase_filter(base))
            sizes = range(n, min(n + 1, longest) + 1)
            found = found.unionByName(checkpointed(count_phrases(dictionary, sizes, sent, n - 1, least)))
            sent.destroy()
    split = F.split("phrase", " ")
    candidates = found.withColumn("_words", split).where(F.size("_words") > 1)
    size = F.size("_words")
    # Every cut of a candidate, with the counts of its parts.
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "_words", F.explode(F.sequence(F.lit(1), size - 1)).alias("_k"))
    cuts = cuts.select("lang", "phrase", "a", "_k", _words(F.lit(1), F.col("_k")).alias("_left"), _words(F.col("_k") + 1, size - F.col("_k")).alias("_right"))
    for side, count in (("_left", "l"), ("_right", "r")):
        cuts = lookup_join(cuts, found.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    scored = cuts.withColumn("score", score()).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_cut"))
    # Every shorter phrase of two words or more inside a candidate, with its count there.
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("_words", i, m), " ")),
        )
    )
    longer = candidates.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    own = scored.join(longer, ["lang", "phrase"], "left")
    free = F.col("_longer").isNull() | (100 * F.col("_longer").cast("decimal(19,0)") < contained * F.col("a").cast("decimal(19,0)"))
    kept = own.where(free).select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language may hold most phrases: its best are found in parts first.
    kept = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "_salt"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return lookup_join(kept, totals, ["lang"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
