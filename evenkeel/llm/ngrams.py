"""Counting 64-bit keys over a corpus: sorted arrays per task, packed into rows, merged by segment.

Word and pair counts have long tails, so rows of single keys would cost more than the keys. A
task counts what it reads in sorted arrays and sends, per segment of the key space, one row of
packed differences and counts; a segment is merged in one task, and the number of segments
follows the size of the text, so a task's share stays the same on any corpus. A frequent key is
one entry per task, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import sliced, stored

#: Text bytes whose keys one segment holds.
SEGMENT_BYTES = 4_000_000
LEAST_SEGMENTS = 64
#: Keys a task holds before it counts and sends them: 20 MB.
HELD = 2_500_000
#: Words a task remembers by their bytes.
MEMORY = 200_000
#: Counts up to here are levels of their own; bins of a range of counts.
LEVELS = 64
BINS = 256
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "seg int, keys binary, counts binary"


class Words(dict):
    """Value per word, computed once and forgotten when full."""

    def __init__(self, compute: Callable[[bytes], int]):
        super().__init__()
        self.compute = compute

    def __missing__(self, word: bytes):
        if len(self) >= MEMORY:
            self.clear()
        value = self.compute(word)
        if len(word) < 100:
            self[word] = value
        return value

    def array(self, words: list[bytes], kind=np.uint64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), kind, len(words))


def word_hashes() -> Words:
    return Words(xxhash.xxh64_intdigest)


def spread(keys: np.ndarray) -> np.ndarray:
    """Keys with mixed bits, for segments and probes; one to one."""
    x = keys * _SPREAD
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((spread(keys) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int32)


def pack(sorted_keys: np.ndarray) -> bytes:
    """Differences, byte planes apart: the high planes are zeros and compress away."""
    steps = np.diff(sorted_keys, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def planes(keys: np.ndarray) -> bytes:
    """Keys in any order, byte planes apart."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(len(keys), 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)


def segments_for(docs: DataFrame) -> int:
    """Segments for the text of ``docs``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_SEGMENTS, int(size) // SEGMENT_BYTES)


def count_keys(docs: DataFrame, segments: int, reader: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], most: int = HELD,
               place: Callable[[np.ndarray, int], np.ndarray] = segment_of) -> DataFrame:
    """(seg, keys, counts) with one row per segment: all keys that ``reader()`` finds in slices of ``docs``.

    ``place(keys, segments)`` gives the segment of each key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of = reader()
        held: list[np.ndarray] = []
        size = 0

        def rows():
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counts = np.diff(np.append(starts, len(keys))).astype(np.uint32)
            keys = keys[starts]
            seg = place(keys, segments)
            order = np.argsort(seg, kind="stable")
            keys, counts, seg = keys[order], counts[order], seg[order]
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            ends = np.append(starts[1:], len(seg))
            for k in range(0, len(starts), 256):
                a, b = starts[k : k + 256], ends[k : k + 256]
                yield pa.RecordBatch.from_arrays([
                    pa.array(seg[a]), pa.array([pack(keys[x:y]) for x, y in zip(a, b)], pa.binary()),
                    pa.array([counts[x:y].tobytes() for x, y in zip(a, b)], pa.binary())], ["seg", "keys", "counts"])

        for batch in sliced(batches, "text"):
            found = keys_of(batch)
            held.append(found.astype(np.uint64, copy=False))
            size += len(found)
            if size >= most:
                yield from rows()
                size = 0
        if size:
            yield from rows()

    def whole(part: pa.Table) -> pa.Table:
        keys, counts = summed(
            np.concatenate([unpack(k) for k in part["keys"].to_pylist()]),
            np.concatenate([np.frombuffer(c, np.uint32).astype(np.int64) for c in part["counts"].to_pylist()]))
        return pa.table({"seg": part["seg"][:1].cast(pa.int32()), "keys": pa.array([pack(keys)], pa.binary()),
                         "counts": pa.array([counts.tobytes()], pa.binary())})

    parts = docs.mapInArrow(run, _SCHEMA)
    return stored(parts.groupBy("seg").applyInArrow(whole, _SCHEMA))


def count_of_counts(packed: DataFrame) -> dict[int, tuple[int, int]]:
    """{level: (keys, sum of counts)}; level: the count itself up to 64, then powers of two.

    A few dozen rows whatever the corpus.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                c = np.frombuffer(data, np.int64)
                level, at = np.unique(_level(c), return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(level), pa.array(np.bincount(at, minlength=len(level)).astype(np.int64)),
                    pa.array(np.bincount(at, weights=c, minlength=len(level)).astype(np.int64))], ["level", "n", "total"])

    rows = packed.select("counts").mapInArrow(run, "level long, n long, total long").groupBy("level").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    return {r.level: (r.n, r.total) for r in rows}


def _level(c: np.ndarray) -> np.ndarray:
    return np.where(c <= LEVELS, c, np.int64(1) << np.floor(np.log2(np.maximum(c, 1))).astype(np.int64))


def floor_for(levels: dict[int, tuple[int, int]], most: int, weight=lambda level: 1) -> int:
    """Smallest count from which on the keys, times ``weight``, are at most ``most``."""
    total, floor = 0, 2 * max(levels, default=1)
    for level in sorted(levels, reverse=True):
        total += levels[level][0] * weight(level)
        if total > most:
            return floor
        floor = level
    return 1


def frequent(packed: DataFrame, floor: int, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with at least ``floor`` counts, on the driver; the caller picked a floor that bounds them.

    Keys up to ``upto`` need one count less.
    """

    def run(batches):
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                k, c = unpack(k), np.frombuffer(c, np.int64)
                keep = c >= floor
                if upto is not None:
                    keep |= (c == floor - 1) & (k <= np.uint64(upto))
                yield pa.RecordBatch.from_arrays([pa.array([pack(k[keep])], pa.binary()),
                                                  pa.array([c[keep].tobytes()], pa.binary())], ["keys", "counts"])

    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for row in packed.select("keys", "counts").mapInArrow(run, "keys binary, counts binary").collect():
        keys.append(unpack(bytes(row.keys)))
        counts.append(np.frombuffer(bytes(row.counts), np.int64))
    return summed(np.concatenate(keys), np.concatenate(counts))


def _in_range(packed: DataFrame, low: int, high: int, width: int) -> dict[int, int]:
    """{lowest count of a bin: keys} for counts from ``low`` to below ``high``, in bins of ``width``."""

    def run(batches):
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                c = np.frombuffer(data, np.int64)
                found, n = np.unique((c[(c >= low) & (c < high)] - low) // width, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(low + found * width), pa.array(n.astype(np.int64))], ["bin", "n"])

    rows = packed.select("counts").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    return {r.bin: r.n for r in rows}


def most_frequent(packed: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Exactly the ``most`` keys of the highest counts, sorted by key; equal counts go by key, which is a hash.

    Ranges of counts are narrowed to the one count at which the number is passed, and that count
    to a range of keys, so about ``most`` keys reach the driver however many share a count.
    """
    bins, width, above = {level: n for level, (n, _) in count_of_counts(packed).items()}, 0, 0
    while True:
        for low in sorted(bins, reverse=True):
            if above + bins[low] > most:
                break
            above += bins[low]
        else:
            return frequent(packed, 1)
        high = min(low + width, high) if width else low + 1 if low < LEVELS else 2 * low
        if high - low == 1:
            break
        width = -(-(high - low) // BINS)
        bins = _in_range(packed, low, high, width)
    share = (most - above + 64) / bins[low]
    while True:
        keys, counts = frequent(packed, low + 1, min(int(share * 2.0**64), 2**64 - 1))
        if len(keys) >= most:
            keep = np.sort(np.lexsort((keys, -counts))[:most])
            return keys[keep], counts[keep]
        share *= 2


def counted(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Count of each wanted key; 0 if it is not among the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def look_up(asked: DataFrame, packed: DataFrame, segments: int, answer: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str,
            place: Callable[[np.ndarray, int], np.ndarray] = segment_of,
            find: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = counted) -> DataFrame:
    """Rows of ``answer(uids, keys, counts)`` per segment, for ``asked`` (uid long, asked array<long>); a key not in ``packed`` counts 0.

    ``place`` is the one that ``packed`` was counted with; ``find(keys, counts, wanted)`` gives what is answered for a
    segment's wanted keys. Keys travel packed to their segments, as the counts do, and uids as differences, which are
    short where ``asked`` is in order of small uids; a key asked for very often makes its segment's task large, so callers
    answer frequent keys before.
    """

    def dealt(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows():
            uids, keys = (np.concatenate(x) for x in zip(*held))
            held.clear()
            seg = place(keys, segments)
            order = np.argsort(seg, kind="stable")
            uids, keys, seg = uids[order], keys[order], seg[order]
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            ends = np.append(starts[1:], len(seg))
            for k in range(0, len(starts), 256):
                a, b = starts[k : k + 256], ends[k : k + 256]
                yield pa.RecordBatch.from_arrays([
                    pa.array(seg[a]), pa.array([pack(uids[x:y].view(np.uint64)) for x, y in zip(a, b)], pa.binary()),
                    pa.array([planes(keys[x:y]) for x, y in zip(a, b)], pa.binary())], ["seg", "uids", "asked"])

        for batch in batches:
            lists = batch.column("asked")
            keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            sizes = np.diff(lists.offsets.to_numpy())
            held.append((np.repeat(batch.column("uid").to_numpy(), sizes), keys))
            size += len(keys)
            if size >= HELD // 2:
                yield from rows()
                size = 0
        if size:
            yield from rows()

    def looked(left: pa.Table, right: pa.Table) -> pa.Table:
        join = lambda parts, read, kind: np.concatenate([np.zeros(0, kind), *map(read, parts.to_pylist())])
        uids = join(left["uids"], unpack, np.uint64).view(np.int64)
        wanted = join(left["asked"], from_planes, np.uint64)
        keys = join(right["keys"], unpack, np.uint64)
        counts = join(right["counts"], lambda x: np.frombuffer(x, np.int64), np.int64)
        return answer(uids, wanted, find(keys, counts, wanted))

    left = asked.select("uid", "asked").mapInArrow(dealt, "seg int, uids binary, asked binary")
    return left.groupBy("seg").cogroup(packed.groupBy("seg")).applyInArrow(looked, schema)
