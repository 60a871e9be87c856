"""Plain Python counterparts of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def groups(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text: str | None) -> int:
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    shingles = [" ".join(words[i : i + 3]) for i in range(n)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def simhash_components(rows) -> dict:
    """{doc_id: (fingerprint, component)} from (doc_id, text)."""
    fps = {d: simhash(t) for d, t in rows}
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    links = []
    for k, v in enumerate(values):
        near = np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ v) <= 3) + k + 1
        links += [(ids[k], ids[int(j)]) for j in near]
    roots = groups(ids, links)
    return {i: (fps[i], roots[i]) for i in ids}


def mixing_targets(sizes: dict, share=1.5, epochs=2) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > epochs * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = epochs * sizes[s]
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return target


def embedding_links(rows, cosine=0.93):
    """{vec_id: (n_links, component)} from (vec_id, embedding, label)."""
    good = [(i, np.array(e, float), lab) for i, e, lab in rows
            if lab is not None and e is not None and None not in e and np.isfinite(e).all() and np.any(np.array(e, float))]
    links = []
    for k, (i, x, lab) in enumerate(good):
        for j, y, other in good[k + 1 :]:
            if lab == other and len(x) == len(y) and (x @ y) / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links.append((i, j))
    n = Counter(v for link in links for v in link)
    roots = groups([r[0] for r in rows], links)
    return {r[0]: (n[r[0]], roots[r[0]]) for r in rows}
