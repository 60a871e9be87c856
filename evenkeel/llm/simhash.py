"""SimHash near-duplicates: segment popcounts, a grid range join under Manhattan distance, exact check.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan
distance of two such vectors is at most the Hamming distance of the fingerprints. The 32 axes
form six blocks; vectors within distance 3 agree on at least three of them, so they share a
grid cell of one of the twenty choices of three blocks. Pairs in a cell are checked by the
Manhattan distance of the whole vectors, then exactly. Equal fingerprints are one node, so
groups of copies cost nothing; a cell emits links that connect, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import components, in_small_batches, sliced, stored, texts_of

BITS = 3
#: Two-bit segments of each block of axes.
BLOCKS = (5, 5, 5, 5, 6, 6)
#: Most fingerprints of a cell that one task compares with each other.
CHUNK = 4096
_LOW = 0x5555555555555555
#: Runs up to this length are compared without the flood.
SHORT = 24


def fingerprint(words: list[bytes], n: int = 3) -> int:
    """SimHash of the ``n``-word shingles, repeats counted; a bit is 1 if set in over half of the hashes."""
    return int(_fingerprints([words], n)[0])


def _fingerprints(documents: list[list[bytes]], n: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(documents), np.uint64)
    hashes, rows, starts = [], [], []
    for row, words in enumerate(documents):
        if not words:
            continue
        rows.append(row)
        starts.append(len(hashes))
        line = b" ".join(words)
        if len(words) <= n:
            hashes.append(digest(line, 42))
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate(([0], ends[: -n] + 1)).tolist()
        hashes.extend([digest(line[a:b], 42) for a, b in zip(begins, ends[n - 1 :].tolist())])
    if rows:
        h = np.array(hashes, np.uint64)
        bounds = [*starts, len(h)]
        for row, a, b in zip(rows, bounds[:-1], bounds[1:]):
            counts = np.zeros(64, np.int64)
            for at in range(a, b, 65536):
                part = h[at : min(at + 65536, b)]
                bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
                counts += np.add.reduce(bits, axis=0, dtype=np.int64)
            bits = (2 * counts > b - a).astype(np.uint8)
            out[row] = np.packbits(bits, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row of ``docs``. Texts without words, and null, get fingerprint 0."""

    def run(batches):
        for batch in sliced(batches, "text"):
            fps = _fingerprints([t.lower().split() for t in texts_of(batch)], n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    slim = in_small_batches(docs).select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grid(bits: int) -> list[int]:
    """Masks of the axes that form a cell: every choice of all but ``bits`` blocks."""
    masks, at = [], 0
    for width in BLOCKS:
        masks.append(((1 << 2 * width) - 1) << at)
        at += 2 * width
    return [sum(c) for c in combinations(masks, len(BLOCKS) - bits)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def _embed(x: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, two bits each."""
    high, low = (x >> np.uint64(1)) & np.uint64(_LOW), x & np.uint64(_LOW)
    return ((high & low) << np.uint64(1)) | (high ^ low)


def _within(a, b: np.ndarray, ea, eb: np.ndarray, bits: int) -> np.ndarray:
    """Places of the pairs in range: Manhattan distance of the embeddings as a lower bound, then the exact distance.

    Segments differ by 0, 1 or 2: the low bit of a segment of ``ea ^ eb`` tells an odd difference,
    which is 1; an even one that is not 0 is 2 and shows in the high bit alone.
    """
    x = ea ^ eb
    odd = x & np.uint64(_LOW)
    two = (x >> np.uint64(1)) & np.uint64(_LOW) & ~odd
    near = np.flatnonzero(_popcount(odd) + 2 * _popcount(two) <= bits)
    return near[_popcount((a ^ b)[near]) <= bits]


def _links(cell: np.ndarray, fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Connecting links inside each run of equal ``cell`` values."""
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.append(starts, len(cell)))
    run = np.repeat(np.arange(len(starts)), sizes)
    emb = _embed(fps)
    out = []
    longest = int(min(sizes.max(), SHORT))
    short = sizes[run] <= SHORT
    for d in range(1, longest):
        at = np.flatnonzero((run[d:] == run[:-d]) & short[d:])
        ok = at[_within(fps[at], fps[at + d], emb[at], emb[at + d], bits)]
        out.append((fps[ok], fps[ok + d]))
    for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
        left = np.unique(fps[s : s + n])
        while len(left):  # one connected part after another
            front, left = list(left[:1]), left[1:]
            while front and len(left):
                a = front.pop()
                hit = np.zeros(len(left), bool)
                hit[_within(a, left, _embed(a), _embed(left), bits)] = True
                found = left[hit]
                out.append((np.full(len(found), a), found))
                front.extend(found)
                left = left[~hit]
    return out


def _linked(members: DataFrame, bits: int) -> DataFrame:
    """(a, b) from rows (proj, cell, chunk, fp); each (proj, cell, chunk) is compared within itself."""

    def run(batches):
        def emit(rows: list[tuple[np.ndarray, ...]]):
            key = [np.concatenate(c) for c in zip(*rows)]
            proj, cell, chunk, fp = key
            change = (proj[1:] != proj[:-1]) | (cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1])
            found = _links(np.concatenate(([0], np.cumsum(change))), fp.view(np.uint64), bits)
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("proj", "cell", "chunk", "fp"))
            last = tuple(c[-1] for c in cols[:3])
            # rows of the last group wait for the next batch
            same = np.logical_and.reduce([c == v for c, v in zip(cols[:3], last)])
            cut = len(same) - (int(np.argmin(same[::-1])) if not same.all() else len(same))
            if cut:
                yield from emit([*held, tuple(c[:cut] for c in cols)])
                held = []
            held.append(tuple(c[cut:] for c in cols))
        if held:
            yield from emit(held)

    keys = ["proj", "cell", "chunk"]
    rows = members.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "a long, b long")


def link(fps: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """(node, root) for the distinct values ``fp`` that have a link at ``bits`` or fewer differing bits.

    Cells of more than ``chunk`` values are dealt over chunks. What the first pass leaves outside
    a cell's largest component is then compared with every chunk of the cell: no pair that could
    join two components is left out.
    """
    if not 0 < bits < len(BLOCKS):
        raise ValueError(f"bits must be 1 to {len(BLOCKS) - 1}")
    high, low = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(_LOW)), F.col("fp").bitwiseAND(F.lit(_LOW))
    emb = F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))
    grid = F.array(*[F.struct(F.lit(i).alias("proj"), emb.bitwiseAND(F.lit(_signed(m))).alias("cell")) for i, m in enumerate(_grid(bits))])
    cells = fps.select("fp", F.explode(grid).alias("g")).select("fp", "g.proj", "g.cell")
    counts = cells.groupBy("proj", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    members = stored(cells.join(counts, ["proj", "cell"]).withColumn("parts", parts).withColumn(
        "chunk", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).drop("n"))
    first = stored(_linked(members, bits).distinct())
    large = members.where("parts > 1")
    if large.isEmpty():
        return components(first)
    roots = components(first)
    placed = large.join(roots, large["fp"] == roots["node"], "left").select(
        "proj", "cell", "chunk", "parts", "fp", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed)
    sizes = placed.groupBy("proj", "cell", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("proj", "cell").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rest = placed.join(main, ["proj", "cell"]).where("root <> main")
    sent = rest.select("proj", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), "fp")
    hit = sent.select("proj", "cell", "chunk").distinct()
    again = placed.join(hit, ["proj", "cell", "chunk"]).select("proj", "cell", "chunk", "fp").union(sent).distinct()
    return components(first.union(_linked(again, bits)))


def near_duplicates(docs: DataFrame, n: int = 3, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp long, component_id) for each row: the smallest doc_id reachable over links.

    Texts without words are linked by fingerprint 0 like any other. Repeated rows repeat. A null
    doc_id takes part but never names a component unless all of it are null.
    """
    prints = stored(fingerprints(docs, n))
    firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = stored(link(firsts.select("fp"), bits, chunk))
    named = firsts.join(roots, firsts["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named.select("fp", "root", "first"))
    best = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.select("fp", "root").join(best, "root").select("fp", "component_id")
    return prints.join(stored(classes), "fp").select("doc_id", "fp", "component_id")
