import random

import pytest
from brute import groups, simhash, simhash_components

from evenkeel.llm import queries, simhash as S


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "y", d) for d, t in rows], "doc_id long, text string, fp int, node string, root long")


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = simhash_components(rows)
    got = queries.QUERIES["op6_simhash_near_dedup"](spark, sf).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(len(r.fingerprint) == 16 for r in got)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo "), (6, "É A"), (7, long), (8, long + " end"), (8, long + " end")]
    got = S.near_duplicates(frame(spark, rows)).collect()
    want = simhash_components(rows)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, want[d][1]) for d, _ in rows)
    assert S.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("chunk", [2, 7, 4096])
def test_links_of_random_balls(spark, chunk):
    random.seed(chunk)
    values = set()
    for _ in range(12):
        centre = random.getrandbits(64)
        for _ in range(40):
            values.add(centre ^ sum(1 << b for b in {random.randrange(64) for _ in range(random.randint(0, 4))}))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    want = groups(signed, links)
    got = S.link(spark.createDataFrame([(v,) for v in signed], "fp long"), chunk=chunk).collect()
    got = {r.node: r.root for r in got}
    assert {v: got.get(v, v) for v in signed} == want


def test_small_fingerprint_cases():
    for t in ("", "a", "a b", "a b c", "a b c d a b c d"):
        assert S.fingerprint(t.encode().split()) == simhash(t)
