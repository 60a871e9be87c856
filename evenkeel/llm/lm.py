"""Language-model scores from a log-frequency Bloom filter that workers hold.

The filter stores each word and word pair of the training texts once per level of its
logarithmic count: level k stands for counts from 2^(k-1). A count is read back by asking for
level 1, 2, ... until one is missing. Every word and pair is held, at ten bits an entry, so the
filter grows with the training text.

Up to ``MOST_BITS`` one filter is broadcast. Beyond, the most frequent words and pairs, down to a
count at which they fit, make up the broadcast filter; the others lie in filters of a segment of
the keys each, and the keys of a chunk of texts that the broadcast one misses meet them in a shuffle. The
model is the same either way: no count level is left out.

The base score needs exact counts of all words. Frequent words have theirs in a bounded table
that workers hold too; the other words of each document go to their counts by a shuffle, so
no frequent word is ever shuffled by document.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm import ngrams
from evenkeel.llm.common import discard, sliced, stored, texts_of

#: Most bits of the filter that is broadcast, 128 MB; it has no more than its entries need, from 2 MB on.
MOST_BITS = 1 << 30
LEAST_BITS = 1 << 24
BITS_PER_ENTRY = 10
HASHES = 6
#: Words whose exact counts workers hold.
HEAD_WORDS = 200_000
#: Blocks of the filter; all bits of a key lie in one block, so blocks are built apart.
BLOCKS = 4096
#: Words have even keys of 63 hashed bits, pairs odd ones. Key of the end token: a word has it by chance of 2^-63 only.
END = np.uint64(0x5DEECE66D1234566)
_ODD = np.uint64(1)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
DISCOUNT = 0.75


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ngrams.spread(left * _PAIR + right) | _ODD


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Words lie in the first half of the segments, pairs in the second."""
    half = segments // 2
    return ngrams.segment_of(keys, half) + ((keys & _ODD) * np.uint64(half)).astype(np.int32)


def _probes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the probes of keys at a level."""
    a = ngrams.spread(keys ^ np.uint64((level * 0xA0761D6478BD642F) & (2**64 - 1)))
    return a, (a << np.uint64(32) | a >> np.uint64(32)) | _ODD


def _place(a: np.ndarray, b: np.ndarray, i: int, block_bits: int) -> np.ndarray:
    """Bit place of probe ``i`` inside a block of fewer than 2^32 bits."""
    return ((a + np.uint64(i) * b >> np.uint64(32)) * np.uint64(block_bits) >> np.uint64(32)).astype(np.int64)


class Filter:
    """Bytes of all blocks, one after another."""

    def __init__(self, data: np.ndarray, blocks: int | None = None):
        self.data = data
        self.blocks = blocks or BLOCKS
        self.block_bits = len(data) * 8 // self.blocks

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        a, b = _probes(keys, level)
        base = ngrams.segment_of(keys, self.blocks).astype(np.int64) * self.block_bits
        found = np.arange(len(keys))
        for i in range(HASHES):
            at = base + _place(a, b, i, self.block_bits)
            yes = np.flatnonzero((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            found, a, b, base = found[yes], a[yes], b[yes], base[yes]
        out = np.zeros(len(keys), bool)
        out[found] = True
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Highest level present, level by level; 0 if the key is missing."""
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        level = 1
        while len(left) and level < 64:
            left = left[self.has(keys[left], level)]
            out[left] = level
            level += 1
        return out


def counts_of(levels: np.ndarray) -> np.ndarray:
    """Representative count per level: 1 for level 1, else the geometric middle of 2^(k-1) to 2^k."""
    return np.where(levels == 0, 0.0, np.where(levels == 1, 1.0, 2.0 ** (levels - 0.5)))


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def block(keys: np.ndarray, tops: np.ndarray, block_bits: int) -> np.ndarray:
    """Bytes of a block that holds ``keys`` at all levels up to ``tops``."""
    bitmap = np.zeros(block_bits, np.uint8)
    for level in range(1, int(tops.max(initial=0)) + 1):
        a, b = _probes(keys[tops >= level], level)
        for i in range(HASHES):
            bitmap[_place(a, b, i, block_bits)] = 1
    return np.packbits(bitmap, bitorder="little")


def filter_bits(entries: int, most: int) -> int:
    """Bits of a filter of ``entries``, in whole bytes per block."""
    return min(most, max(LEAST_BITS, -(-entries * BITS_PER_ENTRY // (8 * BLOCKS)) * 8 * BLOCKS))


def build_filter(words: DataFrame, pairs: DataFrame, floor: int, bits: int) -> np.ndarray:
    """Filter over packed counts of words and pairs of at least ``floor``; blocks are built in tasks."""
    block_bits = bits // BLOCKS

    def entries(batches):
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                k, c = ngrams.unpack(k), np.frombuffer(c, np.int64)
                k, c = k[c >= floor], c[c >= floor]
                at = ngrams.segment_of(k, BLOCKS)
                order = np.argsort(at, kind="stable")
                k, top, at = k[order], level_of(c[order]), at[order]
                starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(k) else np.zeros(0, int)
                ends = np.append(starts[1:], len(k))
                yield pa.RecordBatch.from_arrays([
                    pa.array(at[starts]), pa.array([k[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([top[a:b].astype(np.uint8).tobytes() for a, b in zip(starts, ends)], pa.binary())], ["block", "keys", "tops"])

    def built(part: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in part["keys"].to_pylist()])
        tops = np.concatenate([np.frombuffer(c, np.uint8) for c in part["tops"].to_pylist()])
        return pa.table({"block": part["block"][:1].cast(pa.int32()), "data": pa.array([block(keys, tops, block_bits).tobytes()], pa.binary())})

    rows = words.union(pairs).select("keys", "counts").mapInArrow(entries, "block int, keys binary, tops binary")
    data = np.zeros(bits // 8, np.uint8)
    width = block_bits // 8
    for row in rows.groupBy("block").applyInArrow(built, "block int, data binary").collect():  # the filter: at most MOST_BITS
        data[row.block * width : (row.block + 1) * width] = np.frombuffer(bytes(row.data), np.uint8)
    return data


def _tokens(batch: pa.RecordBatch, memory: ngrams.Words) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of a slice, the end of each text included, and the tokens per text."""
    texts = [t.lower().split() for t in texts_of(batch)]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    words = memory.array([w for t in texts for w in t]) & ~_ODD
    out = np.full(int(sizes.sum()), END, np.uint64)
    out[np.delete(np.arange(len(out)), np.cumsum(sizes) - 1)] = words
    return out, sizes


def _before(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Token before each; the first of a text follows an end."""
    return np.concatenate(([END], tokens[:-1])) if len(tokens) else tokens


def _find_levels(floor: int):
    """Levels of a segment's wanted keys: probes of a filter over its counts below ``floor``, built where they lie."""

    def find(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        keys, tops = keys[counts < floor], level_of(counts[counts < floor])
        if not len(keys) or not len(wanted):
            return np.zeros(len(wanted), np.int64)
        bits = -(-max(int(tops.sum()) * BITS_PER_ENTRY, 64) // 8) * 8
        return Filter(block(keys, tops, bits), 1).levels(wanted)

    return find


def _chunked(slim: DataFrame) -> DataFrame:
    """``slim`` stored with ``chunk``, a random number that the texts of a slice share."""

    def run(batches):
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.repeat(pa.scalar(uuid.uuid4().int >> 65, pa.int64()), batch.num_rows)], [*batch.schema.names, "chunk"])

    return stored(slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField("chunk", T.LongType())])))


def _beyond(chunks: DataFrame, packed: DataFrame, segments: int, floor: int, shared) -> DataFrame:
    """(chunk, keys, levels) in parts: keys of a chunk that the broadcast filter misses and the others hold.

    A chunk asks once for each key. A key of at least ``floor`` occurrences in training is in the broadcast filter, so
    a key may be asked by very many chunks only if hardly any training text has it.
    """

    def run(batches):
        bloom, memory = Filter(shared.value["filter"]), ngrams.word_hashes()
        for batch in sliced(batches, "text"):
            tokens, sizes = _tokens(batch, memory)
            chunk, which = np.unique(batch.column("chunk").to_numpy(), return_inverse=True)
            of = np.repeat(which, sizes)
            asked = [np.zeros(0, np.int64)]
            pairs = pair_keys(_before(tokens, sizes), tokens)
            for k in range(len(chunk)):
                keys = np.unique(np.concatenate((tokens[of == k], pairs[of == k])))
                asked.append(keys[bloom.levels(keys) == 0].view(np.int64))
            at = np.cumsum([len(x) for x in asked]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(asked)))],
                                             ["uid", "asked"])

    def answer(chunks, keys, levels):
        held = levels > 0
        chunks, keys, levels = chunks[held], keys[held], levels[held].astype(np.uint8)
        order = np.lexsort((keys, chunks))
        chunks, keys, levels = chunks[order], keys[order], levels[order]
        starts = np.flatnonzero(np.diff(chunks, prepend=chunks[:1] - 1))
        ends = np.append(starts[1:], len(chunks))
        return pa.table({"chunk": pa.array(chunks[starts], pa.int64()),
                         "keys": pa.array([ngrams.pack(keys[x:y]) for x, y in zip(starts, ends)], pa.binary()),
                         "levels": pa.array([levels[x:y].tobytes() for x, y in zip(starts, ends)], pa.binary())})

    asked = chunks.select("chunk", "text").mapInArrow(run, "uid long, asked array<long>")
    return ngrams.look_up(asked, packed, segments, answer, "chunk long, keys binary, levels binary", segment_of, _find_levels(floor))


def score(docs: DataFrame, training: DataFrame, bits: int = MOST_BITS, head: int = HEAD_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` holds the texts to learn from, ``text`` being null or empty for a text of one
    end token. ``docs`` may hold further columns, which are ignored. Rows that repeat an id and a
    text get the same scores each. With no training text every token is unknown. ``bits`` bounds the
    filter that is broadcast; words and pairs that it has no room for are probed where they lie.
    """
    segments = 2 * ngrams.segments_for(training)
    spark = docs.sparkSession

    def both():
        memory = ngrams.word_hashes()

        def keys(batch):
            tokens, sizes = _tokens(batch, memory)
            return np.concatenate((tokens, pair_keys(_before(tokens, sizes), tokens)))

        return keys

    packed = ngrams.count_keys(training.select("text"), segments, both, place=segment_of)
    words, pairs = packed.where(F.col("seg") < segments // 2), packed.where(F.col("seg") >= segments // 2)
    word_levels, pair_levels = ngrams.count_of_counts(words), ngrams.count_of_counts(pairs)
    total, types = sum(t for _, t in word_levels.values()), sum(n for n, _ in word_levels.values())
    levels = {k: tuple(map(sum, zip(word_levels.get(k, (0, 0)), pair_levels.get(k, (0, 0))))) for k in {*word_levels, *pair_levels}}
    weight = lambda level: int(level_of(np.array([level]))[0])
    size = filter_bits(sum(n * weight(k) for k, (n, _) in levels.items()), bits)
    floor = ngrams.floor_for(levels, size // BITS_PER_ENTRY, weight)
    rest = 1 - sum(t - DISCOUNT * n for n, t in pair_levels.values()) / max(total, 1)
    keys, counts = ngrams.frequent(words, ngrams.floor_for(word_levels, 2 * head))
    if len(keys) > head:
        best = np.lexsort((keys, -counts))[:head]
        best.sort()
        keys, counts = keys[best], counts[best]
    shared = spark.sparkContext.broadcast({"filter": build_filter(words, pairs, floor, size), "keys": keys, "counts": counts})
    scale = total + 0.5 * (types + 1)

    def scored(batch: pa.RecordBatch, held: dict, more=None) -> pa.RecordBatch:
        """Scores of a slice; ``more``: sorted keys, and levels, that the broadcast filter misses."""
        bloom, keys, exact = Filter(held["filter"]), held["keys"], held["counts"]
        memory = held.setdefault("memory", ngrams.word_hashes())

        def read(asked):
            out = bloom.levels(asked)
            return out if more is None else np.where(out == 0, ngrams.counted(*more, asked), out)

        tokens, sizes = _tokens(batch, memory)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        sums = lambda x: np.add.reduceat(x, starts)
        unique, place = np.unique(tokens, return_inverse=True)
        count = ngrams.counted(keys, exact, unique)
        about = np.where(count > 0, count, counts_of(read(unique)))
        single = (about + 0.5) / scale
        before = np.concatenate((np.flatnonzero(unique == END)[:1], place[:-1]))
        pair = np.minimum(counts_of(read(pair_keys(unique[before], tokens))), about[place])
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.where(about[before] > 0, np.maximum(pair - DISCOUNT, 0) / np.maximum(about[before], 1), 0.0)
        share = np.where(about[before] > 0, rest, 1.0)
        model = np.log10(np.minimum(seen + share * single[place], 1.0))
        inside = count[place] > 0
        base = np.where(inside, np.log10((count[place] + 0.5) / scale), 0.0)
        row = np.repeat(np.arange(len(sizes)), sizes)[~inside]
        tail = tokens[~inside]
        tail_at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sizes))))).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("uid"), pa.array(sizes), pa.array(sums(inside.astype(np.int64))),
            pa.array(sums(base)), pa.array(sums(model)),
            pa.ListArray.from_arrays(pa.array(tail_at), pa.array(tail.view(np.int64)))],
            ["doc_id", "uid", "n_tokens", "head_known", "head_base", "score", "tail"])

    def run(batches):
        for batch in sliced(batches, "text"):
            yield scored(batch, shared.value)

    def chunk_scored(texts: pa.Table, found: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.uint64), *[ngrams.unpack(k) for k in found["keys"].to_pylist()]])
        levels = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(x, np.uint8) for x in found["levels"].to_pylist()]])
        keys, first = np.unique(keys, return_index=True)
        more = keys, levels[first].astype(np.int64)
        return pa.Table.from_batches([scored(b, shared.value, more) for b in texts.combine_chunks().to_batches()])

    slim = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, uid long, n_tokens long, head_known long, head_base double, score double, tail array<long>"
    if floor == 1:
        part = stored(slim.mapInArrow(run, schema))
    else:
        chunks = _chunked(slim)
        found = _beyond(chunks, packed, segments, floor, shared)
        part = stored(chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(chunk_scored, schema))
        discard(chunks)
    # the rare words of each text: rows that repeat have equal ids and equal tails, so one of them stands for all
    tails = part.where(F.size("tail") > 0).select("uid", F.explode("tail").alias("word"))
    tails = tails.groupBy("uid", "word").agg(F.count(F.lit(1)).alias("n"))
    rare = _rows(words)
    one = part.where(F.size("tail") > 0).groupBy("uid").agg(F.count(F.lit(1)).alias("copies"))
    found = tails.join(rare, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    found = found.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(float(scale)))).alias("rest"))
    found = found.join(one, "uid").select("uid", (F.col("more") / F.col("copies")).cast("long").alias("more"), (F.col("rest") / F.col("copies")).alias("rest"))
    out = part.drop("tail").join(found, "uid", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("head_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")


def _rows(packed: DataFrame) -> DataFrame:
    """(word, c) rows of packed counts."""

    def run(batches):
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ngrams.unpack(k).view(np.int64)), pa.array(np.frombuffer(c, np.int64))], ["word", "c"])

    return packed.select("keys", "counts").mapInArrow(run, "word long, c long")
