"""Quality rules: repetition and size rules, and bands of n-gram perplexity by language.

The language model is a modified Kneser-Ney bigram model over a closed vocabulary: the most
frequent words by 64-bit hash, all other words being one further word. Spark counts all
texts; the driver gets the most frequent pairs, and workers look them up in sorted arrays. The
other pairs of each document meet their counts in a shuffle, so every pair counts. The
text of a word outside the vocabulary costs as much as choosing it among all such words.

A document is rejected if its log-perplexity lies outside its language's band: beyond the
quartiles of the language's documents by more than ``reach`` times the distance from that
quartile to the median. Bands come from a histogram of all documents, so they are exact to a
bin of 0.01 and need no sort.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm import ngrams
from evenkeel.llm.common import discard, settled, sliced, stored, texts_of

#: Words of the vocabulary, and pairs that a worker holds at most: 16 MB a million pairs.
VOCABULARY = 32_768
PAIRS = 3_000_000
#: Documents with fewer words have no verdict by perplexity.
LEAST_WORDS = 10
_BIN = 0.01
_SPACES = (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 5
#: In place of the key of a pair that is held; no pair has it.
_HELD = np.uint64(2**64 - 1)


@dataclass
class Model:
    """Sorted arrays: word hashes (the place is the id), pair keys with probabilities, weights by id.

    Id 0 is the start of a text, ids from 1 the vocabulary, the last id every other word.
    """

    words: np.ndarray
    pairs: np.ndarray
    pair_p: np.ndarray
    back: np.ndarray
    single: np.ndarray
    outside: float
    total: np.ndarray
    cuts: tuple[float, float, float]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        return _ids(self.words, hashes)

    def log10(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 P(id | before) per token, pairs that are not held by the back-off alone."""
        return self.looked_up(ids, before)[0]

    def looked_up(self, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``log10`` per token, and the keys of the pairs that are not held."""
        key = (before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        p = self.back[before] * self.single[ids]
        held = np.zeros(len(key), bool)
        if len(self.pairs):
            held = self.pairs[at] == key
            p = p + np.where(held, self.pair_p[at], 0.0)
        return _log10(p) - np.where(ids == len(self.words) + 1, self.outside, 0.0), np.where(held, _HELD, key)


def _log10(p: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(p, 1e-12))


def _cut(counts: np.ndarray, cuts: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts == 1, cuts[0], np.where(counts == 2, cuts[1], cuts[2]))


def _ids(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.full(len(hashes), 1, np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at + 1, len(words) + 1)


def _word_ids(words: np.ndarray) -> ngrams.Words:
    import xxhash

    known = {int(h): i + 1 for i, h in enumerate(words)}
    return ngrams.Words(lambda w: known.get(xxhash.xxh64_intdigest(w), len(words) + 1))


def _texts(docs: list[list[bytes]], ids: ngrams.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words, the id before each (0 at a start), and the words per document."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = np.fromiter((i for d in docs for i in map(ids.__getitem__, d)), np.int64, int(sizes.sum()))
    before = np.concatenate(([0], flat[:-1])) if len(flat) else flat
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = 0
    return flat, before, sizes


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of keys seen once to four times."""
    n1, n2, n3, n4 = (max(x, 0) for x in n)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3)))


def fit(docs: DataFrame, vocabulary: int = VOCABULARY, pairs: int = PAIRS) -> Model:
    """Kneser-Ney model of all texts of ``docs``, with the pairs that a worker holds."""
    return fit_all(docs, vocabulary, pairs)[0]


def fit_all(docs: DataFrame, vocabulary: int = VOCABULARY, pairs: int = PAIRS) -> tuple[Model, DataFrame | None, int]:
    """The model; the counts of all pairs by segment, or None if the model holds them all; the number of segments."""
    segments = ngrams.segments_for(docs)

    def single():
        memory = ngrams.word_hashes()
        return lambda batch: memory.array([w for t in texts_of(batch) for w in t.lower().split()])

    counted = ngrams.count_keys(docs.select("text"), segments, single)
    levels = ngrams.count_of_counts(counted)
    words, _ = ngrams.most_frequent(counted, vocabulary)
    types = sum(n for n, _ in levels.values()) - len(words)
    discard(counted)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def double():
        ids = _word_ids(shared.value)

        def keys(batch):
            flat, before, _ = _texts([t.lower().split() for t in texts_of(batch)], ids)
            return (before.astype(np.uint64) << np.uint64(32)) | flat.astype(np.uint64)

        return keys

    counted = ngrams.count_keys(docs.select("text"), segments, double)
    levels = ngrams.count_of_counts(counted)
    floor = ngrams.floor_for(levels, pairs)
    return _model(counted, levels, words, types, floor), counted if floor > 1 else None, segments


def _model(counted: DataFrame, levels: dict[int, tuple[int, int]], words: np.ndarray, types: int, floor: int) -> Model:
    d1, d2, d3 = _discounts([levels.get(k, (0, 0))[0] for k in (1, 2, 3, 4)])
    size = len(words) + 2

    def stats(batches):
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                k, c = ngrams.unpack(k), np.frombuffer(c, np.int64)
                left, right = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
                cut = _cut(c, (d1, d2, d3))
                ids, at = np.unique(left, return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), pa.array(np.bincount(at, c, len(ids))), pa.array(np.bincount(at, cut, len(ids))),
                    pa.array(np.zeros(len(ids)))], ["id", "total", "freed", "met"])
                ids, n = np.unique(right, return_counts=True)
                zero = pa.array(np.zeros(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), zero, zero, pa.array(n.astype(float))], ["id", "total", "freed", "met"])

    # at most vocabulary + 2 rows
    rows = counted.mapInArrow(stats, "id long, total double, freed double, met double").groupBy("id").agg(
        F.sum("total").alias("total"), F.sum("freed").alias("freed"), F.sum("met").alias("met")).collect()
    total, freed, met = np.zeros(size), np.zeros(size), np.zeros(size)
    for r in rows:
        total[r.id], freed[r.id], met[r.id] = r.total, r.freed, r.met
    back = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
    # lower order: continuation counts, discounted by their own counts of counts, the rest uniform
    e = np.array([0.0, *_discounts([int((met == k).sum()) for k in (1, 2, 3, 4)])])
    less = e[np.minimum(met, 3).astype(int)]
    all_met = max(met.sum(), 1.0)
    single = (met - less) / all_met + less.sum() / all_met / (size - 1)
    if not met.sum():
        single = np.full(size, 1.0 / size)
    keys, counts = ngrams.frequent(counted, floor)
    left = (keys >> np.uint64(32)).astype(np.int64)
    kept = (counts - _cut(counts, (d1, d2, d3))) / np.maximum(total[left], 1)
    return Model(words, keys, kept, back, single, float(np.log10(max(types, 1))), total, (d1, d2, d3))


def _signals(text: bytes, words: list[bytes]) -> tuple[int, int, int]:
    """Characters in words, symbols, lines equal to an earlier line of the text."""
    chars = len(text) if text.isascii() else len(text.decode())
    chars -= sum(map(text.count, _SPACES))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    again = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                again += bool(line.split())
            else:
                seen.add(line)
    return chars, symbols, again


def _repeat_words(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words per document inside a window of five words that occurs more than once in the document."""
    total = len(hashes)
    out = np.zeros(len(sizes), np.int64)
    if total < _WINDOW:
        return out
    row = np.repeat(np.arange(len(sizes)), sizes)
    key = ngrams.spread(row.astype(np.uint64) + np.uint64(1))[: total - _WINDOW + 1]
    for k in range(_WINDOW):
        key = ngrams.spread(key ^ hashes[k : total - _WINDOW + 1 + k])
    inside = row[: total - _WINDOW + 1] == row[_WINDOW - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.concatenate((order[:-1][same], order[1:][same]))
    marked = np.zeros(total + 1, np.int64)
    twice = np.unique(twice)
    np.add.at(marked, twice, 1)
    np.add.at(marked, twice + _WINDOW, -1)
    return np.bincount(row[np.cumsum(marked)[:total] > 0], minlength=len(sizes))


def score(docs: DataFrame, model: Model, keep: list[str], counted: DataFrame | None = None, segments: int = 0) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the rule counts and ``surprise``: -log10 of the mean word probability.

    ``counted``: counts of all pairs, where the model does not hold them all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.__dict__)
    counted_too = counted is not None

    def run(batches):
        model = Model(**shared.value)
        hashes = ngrams.word_hashes()
        ids = _word_ids(model.words)
        row = (TaskContext.get().partitionId() << 40) if counted_too else 0
        for batch in sliced(batches, "text"):
            texts = texts_of(batch)
            plain = [t.split() for t in texts]
            flat, before, sizes = _texts([t.lower().split() for t in texts], ids)
            logs, missing = model.looked_up(flat, before)
            cost = np.concatenate(([0.0], np.cumsum(-logs)))
            ends = np.cumsum(sizes)
            surprise = (cost[ends] - cost[ends - sizes]) / np.maximum(sizes, 1)
            own = hashes.array([w for d in plain for w in d])
            signals = np.array([_signals(t, d) for t, d in zip(texts, plain)], np.int64).reshape(-1, 3)
            more, names = [], []
            if counted_too:
                out = missing != _HELD
                at = np.concatenate(([0], np.cumsum(out)))[np.concatenate(([0], ends))].astype(np.int32)
                # numbers of rows, in order: their differences are short on the way to the segments
                more = [pa.array(np.arange(row, row + len(texts))), pa.ListArray.from_arrays(pa.array(at), pa.array(missing[out].view(np.int64)))]
                names = ["uid", "asked"]
                row += len(texts)
            yield pa.RecordBatch.from_arrays(
                [*more, *[batch.column(c) for c in keep], pa.array(sizes), *[pa.array(signals[:, k].copy()) for k in range(3)],
                 pa.array(_repeat_words(own, sizes)), pa.array(surprise)],
                [*names, *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "surprise"])

    slim = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = [T.StructField(c, slim.schema[c].dataType) for c in keep]
    fields += [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields.append(T.StructField("surprise", T.DoubleType()))
    if not counted_too:
        return slim.mapInArrow(run, T.StructType(fields))
    asked = [T.StructField("uid", T.LongType()), T.StructField("asked", T.ArrayType(T.LongType()))]
    part = stored(slim.mapInArrow(run, T.StructType([*asked, *fields])))
    more = _more(part, model, counted, segments)
    out = part.drop("asked").join(more, "uid", "left").withColumn(
        "surprise", F.col("surprise") - F.coalesce("gain", F.lit(0.0)) / F.greatest("n_words", F.lit(1)))
    return out.select(*[f"`{c}`" for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "surprise")


def _more(part: DataFrame, model: Model, counted: DataFrame, segments: int) -> DataFrame:
    """(uid, gain): log10 that the pairs outside the model add per row."""
    shared = part.sparkSession.sparkContext.broadcast((model.back, model.single, model.total, model.cuts))

    def answer(uids, keys, counts):
        back, single, total, cuts = shared.value
        left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        p = back[left] * single[right]
        gain = _log10(p + np.where(counts > 0, (counts - _cut(counts, cuts)) / np.maximum(total[left], 1), 0.0)) - _log10(p)
        ids, at = np.unique(uids, return_inverse=True)
        return pa.table({"uid": ids, "gain": np.bincount(at, gain, len(ids))})

    return ngrams.look_up(part, counted, segments, answer, "uid long, gain double").groupBy("uid").agg(F.sum("gain").alias("gain"))


def bands(scored: DataFrame, reach: float) -> DataFrame:
    """(band_lang, low, high) of ``surprise`` by language, null being one; from documents of enough words."""
    bins = scored.where(F.col("n_words") >= LEAST_WORDS).groupBy(
        F.col("lang").alias("band_lang"), F.floor(F.col("surprise") / _BIN).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("band_lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy("band_lang")
    bins = bins.withColumn("share", F.sum("n").over(upto) / F.sum("n").over(all_))
    quartile = lambda q: F.min(F.when(F.col("share") >= q, F.col("bin"))) * F.lit(_BIN)
    found = bins.groupBy("band_lang").agg(*[quartile(q / 4).alias(f"q{q}") for q in (1, 2, 3)])
    least = F.lit(5 * _BIN)
    return found.select(
        "band_lang", (F.col("q1") - reach * F.greatest(F.col("q2") - F.col("q1"), least)).alias("low"),
        (F.col("q3") + reach * F.greatest(F.col("q3") - F.col("q2"), least)).alias("high"))


def judge(docs: DataFrame, keep: list[str], reach: float = 5.0, **bounds) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the counts, ``surprise``, ``base_failed`` and ``kept``.

    ``keep`` names columns other than those made here. Base rules: under 10 words, or more than
    20 of 100 words in repeated windows. A null text has no words and fails; languages that are
    null are one language; repeated rows repeat. The language is used for the band only.
    """
    def scores() -> DataFrame:
        model, counted, segments = fit_all(docs, **bounds)
        return score(docs, model, list(dict.fromkeys([*keep, "lang"])), counted, segments)

    scored = settled(docs.sparkSession, scores)
    band = stored(bands(scored, reach))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = scored.join(band, F.col("lang").eqNullSafe(F.col("band_lang")), "left").withColumn("base_failed", failed)
    inside = F.coalesce(F.col("surprise").between(F.col("low"), F.col("high")), F.lit(True))
    out = out.withColumn("kept", ~F.col("base_failed") & inside)
    return out.select(*[f"`{c}`" for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "surprise", "base_failed", "kept")
