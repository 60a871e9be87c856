"""Phrase collocations: longest windows counted once, shorter phrases summed from them by ROLLUP.

Every word of a text leads one window: itself and the words that follow it in its piece, up to
the longest phrase, padded with nulls. An occurrence of a phrase of j words is the prefix of
exactly one window, so ``ROLLUP`` over the window columns gives the counts of all phrases of all
lengths, and no n-grams are exploded order by order.

Only counts of at least ``least`` matter, and a phrase cannot be more frequent than its words,
shorter parts. So a window may end early, where it meets a word or sequence that is too rare.
Which ones are rare is told by bitmaps of bounded size, built from counts of hashed keys: a key
may look frequent by chance, never rare, so the counts of frequent phrases stay exact. Words
themselves are compared as text, not by hash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm import ngrams
from evenkeel.llm.common import stored

#: Words of one stored slice, and the most a task holds for slices of all its languages.
SLICE_WORDS, HELD_WORDS = 500_000, 1_000_000
#: Keys a task counts at once.
HELD_KEYS = 1_500_000
#: Window rows of one batch.
BATCH_ROWS = 20_000
#: Windows that a task adds up before it sends them.
HELD_WINDOWS = 400_000
#: Bits of a bitmap for each key it holds, and the most bits of one: 32 MB.
BITS_PER_KEY, MOST_BITS = 16, 2**28
#: Phrases of up to so many words, and the order up to which rare sequences end a window.
LONGEST = SIEVED = 5
#: A byte that no UTF-8 text holds stands for the end of a piece.
_BREAK = b"\xff"
_TABLE = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Places(dict):
    """Words numbered as they come; the break is 0."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


def slices(docs: DataFrame, lang: str = "lang", text: str = "text", none: str = "und") -> DataFrame:
    """(lang, words, n, size, ids): texts of one language and task, each word once, the texts as numbers of words.

    ``ids`` holds ``size`` unsigned 32-bit places in ``words``, compressed; 0 ends a piece. ``n`` counts the
    words. A null language is ``none``; a null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        total = 0

        def row(name: str) -> pa.RecordBatch:
            nonlocal total
            size, places, ids = held.pop(name)
            total -= size
            ids = np.concatenate(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([name]), pa.array([list(places)[1:]], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                pa.array([int((ids != 0).sum())]), pa.array([len(ids)]),
                pa.array([pa.compress(ids, codec="zstd", asbytes=True)], pa.binary())], ["lang", "words", "n", "size", "ids"])

        for batch in batches:
            for name, words in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                tokens = ((words.as_py() or b"") + _BREAK).translate(_TABLE).replace(_BREAK, b" \xff ").split()
                state = held.setdefault(name, [0, _Places(), []])
                state[2].append(np.fromiter(map(state[1].__getitem__, tokens), np.uint32, len(tokens)))
                state[0] += len(tokens)
                total += len(tokens)
                if state[0] >= SLICE_WORDS:
                    yield row(name)
                elif total >= HELD_WORDS:
                    yield row(max(held, key=lambda k: held[k][0]))
        for name in list(held):
            yield row(name)

    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(none)).alias("lang"), F.col(text).alias("text"))
    return stored(slim.mapInArrow(run, "lang string, words array<string>, n long, size long, ids binary"))


class Sieve:
    """Bitmap over the high bits of mixed keys: True for every key put in, and for few others.

    Keys count by the bits of ``mask`` alone: a few more than a number of all words has.
    """

    def __init__(self, bits: np.ndarray, mask: int):
        self.bits, self.mask = bits, np.uint64(mask)
        self.shift = np.uint64(64 - (8 * len(bits)).bit_length() + 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = ngrams.spread(keys & self.mask) >> self.shift
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def build_sieve(packed: DataFrame, least: int) -> np.ndarray:
    """Bits of the keys of ``packed`` with at least ``least`` counts; the bits lie in the order of the segments.

    At most ``MOST_BITS`` bits; with more keys than they serve the sieve lets more through.
    """
    n = sum(int(c) for level, (c, _) in ngrams.count_of_counts(packed).items() if level * 2 > least)
    size = min(MOST_BITS, 1 << max(16, (BITS_PER_KEY * n).bit_length()))
    shift = np.uint64(64 - size.bit_length() + 1)

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                keys = ngrams.unpack(keys)[np.frombuffer(counts, np.int64) >= least]
                if len(keys):
                    slot = ngrams.spread(keys) >> shift
                    first = int(slot.min()) >> 3
                    part = np.zeros((int(slot.max()) >> 3) - first + 1, np.uint8)
                    np.bitwise_or.at(part, (slot >> np.uint64(3)).astype(np.int64) - first,
                                     np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
                    yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([part.tobytes()], pa.binary())], ["first", "part"])

    bits = np.zeros(size // 8, np.uint8)
    # a segment's keys lie next to each other, so all parts together are about as long as the bitmap
    for row in packed.select("keys", "counts").mapInArrow(run, "first long, part binary").toLocalIterator():
        part = np.frombuffer(bytes(row.part), np.uint8)
        bits[row.first : row.first + len(part)] |= part
    return bits


def _mix(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = head * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)


def _levels(row: dict, sieves: list[Sieve], order: int):
    """Keys of the sequences of ``order`` words at each place, and for each order up to it where they may be frequent."""
    ids = np.frombuffer(pa.decompress(row["ids"], 4 * row["size"], codec="zstd"), np.uint32)
    base = xxhash.xxh64_intdigest(row["lang"].encode())
    keys = np.fromiter((xxhash.xxh64_intdigest(w.encode(), base) for w in row["words"]), np.uint64, len(row["words"]))
    keys = np.concatenate((np.zeros(1, np.uint64), keys))
    good = np.ones(len(keys), bool)
    good[0] = False
    if sieves:
        good &= sieves[0].has(keys)
    word = keys[ids]
    may, head = [good[ids]], word
    for j in range(2, order + 1):
        n = max(len(ids) - j + 1, 0)
        head = _mix(head[:n], word[len(ids) - n :])
        ok = may[-1][:n] & may[-1][1 : n + 1]
        if j <= len(sieves):
            at = np.flatnonzero(ok)
            ok = ok.copy()
            ok[at] = sieves[j - 1].has(head[at])
        may.append(ok)
    return ids, head, may


def _sieves(spark: SparkSession, parts: DataFrame, least: int, sieved: int):
    """Broadcast bitmaps of the words, pairs, ... up to ``sieved`` words that may occur ``least`` times in their language."""
    found: list[tuple[np.ndarray, int]] = []
    words = parts.agg(F.sum("size")).first()[0] or 0
    mask = (1 << min(64, 5 + words.bit_length())) - 1
    segments = max(ngrams.LEAST_SEGMENTS, 4 * words // ngrams.SEGMENT_BYTES)
    for order in range(1, sieved + 1):
        shared = spark.sparkContext.broadcast(list(found))

        def reader(order=order, shared=shared):
            held: list[Sieve] = []

            def keys(batch):
                held[:] = held or [Sieve(*x) for x in shared.value]
                out = [np.zeros(0, np.uint64)]
                for row in batch.rename_columns(["ids", "lang", "words", "size"]).to_pylist():
                    _, head, may = _levels(row, held, order)
                    out.append(head[may[-1]] & np.uint64(mask))
                return np.concatenate(out)

            return keys

        counted = ngrams.count_keys(parts.select(F.col("ids").alias("text"), "lang", "words", "size"), segments, reader, HELD_KEYS)
        found.append((build_sieve(counted, least), mask))
    return spark.sparkContext.broadcast(found)


def windows(parts: DataFrame, least: int, longest: int = LONGEST, sieved: int = SIEVED) -> DataFrame:
    """(lang, w1, ..., n): longest windows of words that may be frequent, with how often a slice holds them."""
    shared = _sieves(parts.sparkSession, parts, least, min(sieved, longest))
    names = [f"w{j}" for j in range(1, longest + 1)]

    def run(batches):
        held = [Sieve(*x) for x in shared.value]
        total: dict[str, Counter] = defaultdict(Counter)  # most windows are the same in all slices of a task

        def summed():
            for lang, of in total.items():
                keys, n = list(of), list(of.values())
                of.clear()
                for k in range(0, len(keys), BATCH_ROWS):
                    part = keys[k : k + BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array(part, pa.string()), pa.array(n[k : k + BATCH_ROWS], pa.int64())],
                        ["lang", "window", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, _, may = _levels(row, held, len(held))
                ids, lang = ids.astype(np.int64), row["lang"]
                # a window grows by a word while the longest sieved sequence that ends there may be frequent
                size = may[0].astype(np.int8)
                for j in range(2, longest + 1):
                    ok = may[min(j, len(may)) - 1]
                    ok = ok[max(j - len(may), 0) :]
                    more = np.zeros(len(ids), bool)
                    more[: len(ok)] = ok
                    size[(size == j - 1) & more] = j
                words = pa.array([None, *row["words"]], pa.string())
                for length in range(1, longest + 1):
                    at = np.flatnonzero(size == length)
                    group = ids[at]
                    for j in range(1, length):
                        group = np.unique(group, return_inverse=True)[1] * np.int64(len(row["words"]) + 1) + ids[at + j]
                    _, first, n = np.unique(group, return_index=True, return_counts=True)
                    columns = [words.take(pa.array(ids[at[first] + j])) for j in range(length)]
                    text = pc.binary_join_element_wise(*columns, " ") if length > 1 else columns[0]
                    for window, count in zip(text.to_pylist(), n.tolist()):
                        total[lang][window] += count
                    if sum(map(len, total.values())) >= HELD_WINDOWS:
                        yield from summed()
        yield from summed()

    found = parts.select("lang", "words", "size", "ids").mapInArrow(run, "lang string, window string, n long")
    split = F.split("window", " ")
    return found.select("lang", *[F.get(split, F.lit(j)).alias(c) for j, c in enumerate(names)], "n")


def phrase_counts(parts: DataFrame, least: int, longest: int = LONGEST, sieved: int = SIEVED) -> DataFrame:
    """(lang, phrase, size, f): words and phrases of up to ``longest`` words that occur ``least`` times or more."""
    names = [f"w{j}" for j in range(1, longest + 1)]
    sums = windows(parts, least, longest, sieved).rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("gone"))
    # a prefix of j words: the columns behind it are rolled up, its own last one is no padding
    size = F.coalesce(*[F.when((F.col("gone") == (1 << (longest - j)) - 1) & F.col(f"w{j}").isNotNull(), j)
                        for j in range(1, longest + 1)])
    rows = sums.where(F.col("f") >= least).withColumn("size", size).where("size is not null")
    return rows.select("lang", F.concat_ws(" ", *names).alias("phrase"), "size", "f")


def floored_score() -> Column:
    """floor(1000 a n / (l r)) of the columns of these names, in decimals of 38 digits."""
    return F.expr("(cast(a as decimal(16,0)) * cast(n as decimal(16,0)) * cast(1000 as decimal(4,0))) "
                  "div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = LONGEST, sieved: int = SIEVED,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at spaces and
    tabs into words. ``n`` counts the language's words, ``a`` the phrase's occurrences within pieces,
    overlaps included; phrases below ``least`` are no candidates. A cut after k words gives
    floor(1000 a n / (l r)) from the counts of both parts; the lowest counts, ties to the smallest k.
    A candidate goes if one that is a word longer and holds it occurs as often: counts never grow
    with the length, so any longer one that occurs as often has such a one between. Rank: score,
    then ``a``, both descending, then the phrase in byte order.

    A null text is empty, a null language ``und``; both are cases of a value like any other. Repeated
    rows count each. Other columns, under any name, are not read. No rows give no rows. Products are
    held in 38 decimal digits, so counts may have 16.
    """
    parts = slices(docs, lang, text)
    total = parts.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = stored(phrase_counts(parts, least, longest, sieved))
    words = F.split("phrase", " ")
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    ends = found.where("size > 2").select("lang", "a", F.explode(F.array(
        F.array_join(F.expr("slice(w, 1, size - 1)"), " "), F.array_join(F.expr("slice(w, 2, size - 1)"), " "))).alias("phrase"))
    inside = ends.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    found = found.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = found.select("lang", "phrase", "size", "a", "w", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"),
        F.array_join(F.expr("slice(w, k + 1, size - k)"), " ").alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    best = cuts.withColumn("score", floored_score()).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                         F.col("cut.score").cast("long").alias("score"))
