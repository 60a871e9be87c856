"""Byte-level BPE by ranks: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import in_small_batches, sliced

#: Results a memory holds by default; chunks, and pre-tokens that are no chunk, that an encoder remembers.
MEMORY = 120_000
CHUNKS, PIECES = 200_000, 40_000
_MASK = (1 << 64) - 1
#: A space after white space: there a pre-token may reach over the cut.
_DOUBLE_SPACE = re.compile(r"\s ")
_DOUBLE_ASCII = tuple(c + " " for c in " \n\t\r\x0b\x0c")


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """Ranks of a ``base64 rank`` file, read by the driver; a vocabulary is small by definition."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys in n slots, found by one displacement per bucket.

    Buckets of several keys, largest first, try displacements until all their keys fall on free
    slots; buckets of one key point at a free slot directly (negative entries).
    """

    def __init__(self, values: dict[bytes, int]):
        n = len(values)
        self.n, self.buckets = n, max(1, n // 3)
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        self.shift = [0] * self.buckets
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in values:
            h = xxhash.xxh64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        used = bytearray(n)
        alone = []
        for b, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                alone.append((b, members[0][1]))
                continue
            d = 1
            while True:
                slots = {self._slot(h, d) for h, _ in members}
                if len(slots) == len(members) and not any(used[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for h, key in members:
                self._put(self._slot(h, d), key, values[key], used)
        free = (s for s in range(n) if not used[s])
        for b, key in alone:
            slot = next(free)
            self.shift[b] = -slot - 1
            self.keys[slot], self.values[slot] = key, values[key]

    def tables(self) -> dict:
        """Plain data for a broadcast."""
        return dict(self.__dict__)

    @classmethod
    def of(cls, tables: dict) -> PerfectHash:
        made = cls.__new__(cls)
        made.__dict__.update(tables)
        return made

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
        return ((x * 0xD6E8FEB86659FD93 & _MASK) >> 29) % self.n

    def _put(self, slot: int, key: bytes, value: int, used: bytearray) -> None:
        used[slot] = 1
        self.keys[slot], self.values[slot] = key, value

    def get(self, key: bytes) -> int:
        """Value of ``key``, -1 if it is none of the keys."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[slot] if self.keys[slot] == key else -1


class Encoder:
    """Ids of texts. What it remembers of one text, or one task of the same worker, serves the next."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash | None = None, chunks: int = CHUNKS):
        self.ranks = ranks
        self.whole = whole or PerfectHash(ranks)
        self.find = regex.compile(pattern).findall
        # ids as 32-bit bytes, which join fast and take little room
        self.after_space = Memory(lambda chunk: self._chunk(" " + chunk), chunks)
        self.pieces = Memory(lambda piece: np.array(self.piece(piece.encode()), np.uint32).tobytes(), PIECES)

    def _chunk(self, text: str) -> bytes:
        found = self.find(text)
        if len(found) == 1:  # remembered as a chunk already
            return np.array(self.piece(text.encode()), np.uint32).tobytes()
        first = found[0] if found else ""
        if first[:1] == " " and first[1:].isalpha():  # a word with its space is a chunk of its own
            return self.after_space[first[1:]] + b"".join([self.pieces[p] for p in found[1:]])
        return b"".join([self.pieces[p] for p in found])

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        known = self.whole.get(data)
        return [known] if known >= 0 else self.merge(data)

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals: a heap of candidate pairs over linked parts."""
        get, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        n = len(data)
        wide = n + 1  # a candidate (rank, start, end) is one number, in the same order
        ends = list(range(1, wide))  # end of the part that starts here; 0 once merged away
        before = list(range(-1, n - 1))
        heap = [(r * wide + i) * wide + i + 2 for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            at, end = divmod(pop(heap), wide)
            i = at % wide
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                stop = ends[end]
                r = get(data[i:stop])
                if r is not None:
                    push(heap, (r * wide + i) * wide + stop)
            j = before[i]
            if j >= 0:
                r = get(data[j:end])
                if r is not None:
                    push(heap, (r * wide + j) * wide + end)
        ranks = self.ranks
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def packed(self, text: str) -> bytes:
        """Ids of one text as 32-bit numbers.

        No pre-token reaches from a character that is no white space into a space after it. So a
        text whose spaces all follow such characters is cut before each space, and each chunk is
        looked up whole.
        """
        if cut_is_safe(text):
            first, *rest = text.split(" ")
            return self._chunk(first) + b"".join(map(self.after_space.__getitem__, rest))
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.uint32).tolist()


def cut_is_safe(text: str) -> bool:
    """No space of the text follows white space."""
    if text.isascii():
        return not any(c in text for c in _DOUBLE_ASCII)
    return _DOUBLE_SPACE.search(text) is None


class Memory(dict):
    """Results by key, computed once. Of two generations the older one goes when the newer is full."""

    def __init__(self, compute, most: int | None = None):
        super().__init__()
        self.compute, self.old, self.most = compute, {}, MEMORY if most is None else most

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) >= 100:
                return value
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value


def id_lists(packed: list[bytes]) -> pa.ListArray:
    """A list of ids per row from 32-bit bytes."""
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


class Decoder:
    """Bytes behind ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = {i: b for b, i in ranks.items()}
        self.sizes = np.zeros(max(self.pieces, default=0) + 1, np.int64)
        for i, b in self.pieces.items():
            self.sizes[i] = len(b)

    def rows(self, ids: pa.ListArray) -> pa.Array:
        """A binary value per list; null lists give no bytes."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(self.sizes[flat])))
        places = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
        data = b"".join(map(self.pieces.__getitem__, flat.tolist()))
        offsets = pa.py_buffer(ends[places].astype(np.int64))
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, offsets, pa.py_buffer(data)]).cast(pa.binary())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, decoded: bool = False, chunks: int = CHUNKS) -> DataFrame:
    """(doc_id, ids array<int>), a row for each row of ``docs``; a null text is empty and gets an empty list.

    ``decoded`` adds what the ids decode to, made from the ids in the same task. Needs all 256
    single bytes among the ranks. Rows are independent: repeated rows repeat, other columns are
    ignored, and a text is cut into batches only between rows. A worker remembers ``chunks`` chunks, about 0.27 KB each.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks, "tables": PerfectHash(ranks).tables()})

    def run(batches):
        box = shared.value  # stays with the worker process, and so do the objects put into it
        if "encoder" not in box:
            box["encoder"] = Encoder(box["ranks"], pattern, PerfectHash.of(box["tables"]), chunks)
        if decoded and "decoder" not in box:
            box["decoder"] = Decoder(box["ranks"])
        encoder = box["encoder"]
        for batch in sliced(batches, "text"):
            ids = id_lists([encoder.packed(t or "") for t in batch.column("text").to_pylist()])
            columns = {"doc_id": batch.column("doc_id"), "ids": ids}
            if decoded:
                columns["decoded"] = box["decoder"].rows(ids)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    slim = in_small_batches(docs).select("doc_id", "text")
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    return slim.mapInArrow(run, schema + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded`` (binary), the bytes behind the ids; null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast({"ranks": ranks})

    def run(batches):
        decoder = Decoder(shared.value["ranks"])
        for batch in batches:
            ids = batch.column("ids")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoder.rows(ids)], ["doc_id", "ids", "decoded"])

    slim = encoded.select("doc_id", "ids")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 of the decimal ids, decoded_sha256."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
