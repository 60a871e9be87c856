"""Language identification by word-first backoff.

A word the model knows adds its log frequency in every language. An unseen word falls back to
its longest character n-grams that any language knows, then to shorter ones. The language with
the largest sum wins; the score is its share of the softmax over the languages.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import chosen, sliced

#: Documents per language that the model learns from, by hash of the id; words and n-grams per language and order it keeps.
FIT_ROWS = 3_000
WORDS = 30_000
GRAMS = 20_000
ORDER = 5
UNKNOWN = "und"
#: Tokens a worker remembers.
MEMORY = 500_000
_RUNS = re.compile(r"[^\W\d_]+")


def runs(token: str) -> list[str]:
    """Lower-case letter runs."""
    return [r for r in _RUNS.findall(token.lower()) if any(map(str.isalpha, r))]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between marks; single characters without them."""
    if n == 1:
        return list(word)
    w = f"_{word}_"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """Log frequencies per language of words (order 0) and of character n-grams (order 1 up)."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        place = {x: i for i, x in enumerate(self.langs)}
        totals = np.zeros((ORDER + 1, len(self.langs)))
        counts: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER + 1)]
        for lang, order, gram, n in rows:
            totals[order, place[lang]] += n
            counts[order].setdefault(gram, np.zeros(len(self.langs)))[place[lang]] += n
        self.tables = [
            {g: np.log(c + 0.5) - np.log(totals[k] + 0.5 * (len(t) + 1)) for g, c in t.items()} for k, t in enumerate(counts)]

    def word(self, word: str) -> np.ndarray:
        """Log frequency per language; zeros if not even a character is known."""
        known = self.tables[0].get(word)
        if known is not None:
            return known
        for n in range(ORDER, 0, -1):
            table = self.tables[n]
            found = [table[g] for g in grams(word, n) if g in table]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(self.langs))

    def token(self, token: str) -> tuple[np.ndarray, int]:
        """Sum over the letter runs of a token, and their number."""
        found = runs(token)
        return sum(map(self.word, found), np.zeros(len(self.langs))), len(found)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, words: int = WORDS, kept_grams: int = GRAMS) -> Model:
    """Model from ``docs`` (doc_id, text, lang), all of them for training; null languages and texts teach nothing."""
    ids = docs.where("lang is not null and text is not null").select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fit_rows).select("doc_id").distinct()
    rows = chosen(docs.where("lang is not null").select("doc_id", "text", "lang"), ids, "doc_id")

    def count(batches):
        seen: dict[str, Counter] = {}
        for batch in sliced(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update((text or "").split())
        for lang, tokens in seen.items():
            tables = [Counter() for _ in range(ORDER + 1)]
            for token, n in tokens.items():
                for word in runs(token):
                    tables[0][word] += n
            for word, n in tables[0].items():
                for k in range(1, ORDER + 1):
                    for g in grams(word, k):
                        tables[k][g] += n
            for k, t in enumerate(tables):
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(t)), pa.array([k] * len(t), pa.int32()), pa.array(list(t), pa.string()),
                    pa.array(list(t.values()), pa.int64())], ["lang", "k", "gram", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, k int, gram string, n long")
    counted = counted.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang", "k").orderBy(F.desc("n"), "gram")
    counted = counted.withColumn("place", F.row_number().over(best)).where(
        F.col("place") <= F.when(F.col("k") == 0, words).otherwise(kept_grams))
    return Model([(r.lang, r.k, r.gram, r.n) for r in counted.drop("place").collect()])  # bounded by the parameters


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``; null texts and texts without letters are ``und`` with score 0.

    Only ``text`` decides. Equal sums go to the language first in order. Without training rows all is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"langs": model.langs, "tables": model.tables})

    def run(batches):
        held = shared.value
        model = Model([])
        model.langs, model.tables = held["langs"], held["tables"]
        width = len(model.langs)
        table, places = np.zeros((1024, width + 1)), {}
        for batch in sliced(batches, "text"):
            docs = [(t or "").split() for t in batch.column("text").to_pylist()]
            if len(places) > MEMORY:
                places.clear()
            new = set().union(*docs) - places.keys()
            while len(places) + len(new) > len(table):
                table = np.concatenate((table, np.zeros_like(table)))
            for w in new:
                sums, n = model.token(w)
                table[len(places), :width], table[len(places), width] = sums, n
                places[w] = len(places)
            sizes = np.fromiter(map(len, docs), np.int64, len(docs))
            flat = np.fromiter(map(places.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
            total = np.zeros((len(docs), width + 1))
            filled = np.flatnonzero(sizes)
            if len(filled):
                total[filled] = np.add.reduceat(table[flat], (np.cumsum(sizes) - sizes)[filled], axis=0)
            pred, score = [None] * len(docs), np.zeros(len(docs))
            if width:
                sums = total[:, :width]
                at = sums.argmax(1)
                share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                pred = [model.langs[a] if n else UNKNOWN for a, n in zip(at, total[:, width])]
                score = np.where(total[:, width] > 0, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([p or UNKNOWN for p in pred], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
