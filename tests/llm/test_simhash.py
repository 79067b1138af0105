import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm import simhash


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (id, fingerprint) -> smallest id that is not null of each row's component."""
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_fingerprint_is_as_defined(text):
    assert simhash.fingerprint(text.encode("utf-8", "ignore")) == brute_fingerprint(text.encode("utf-8", "ignore").decode())


def test_fingerprint_of_many_shingles():
    text = " ".join(f"a{i % 7}b{i % 11}" for i in range(3000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_bk_search_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 4)).astype(np.uint64)) for _ in range(400)], np.uint64)
    fp = np.unique(np.concatenate([base, rng.choice(base, 400) ^ flips]))
    group = rng.integers(0, 3, len(fp))
    group = np.unique(group, return_inverse=True)[1]
    roots, *tree = simhash.bk_forest(group, fp)
    found = set()
    for q, r in simhash.bk_search(fp, np.arange(len(fp)), roots[group], fp, *tree, 3):
        found |= set(zip(q.tolist(), r.tolist()))
    d = np.bitwise_count(fp[:, None] ^ fp[None])
    assert found == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if group[i] == group[j] and d[i, j] <= 3}


def test_search_follows_only_edges_within_the_radius(monkeypatch):
    """Nodes that a search looks at are few beside all of the tree's."""
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    roots, *tree = simhash.bk_forest(np.zeros(len(fp), int), fp)
    looked = 0

    def counted(x):
        nonlocal looked
        looked += len(x)
        return np.vectorize(lambda v: bin(v).count("1"))(x)

    monkeypatch.setattr(np, "bitwise_count", counted)
    found = list(simhash.bk_search(fp, np.arange(20), np.full(20, roots[0]), fp, *tree, 3))
    assert sum(len(q) for q, _ in found) == 20 and looked < 0.6 * 20 * len(fp)


@pytest.mark.parametrize(("tree", "wave"), [(5, 1 << 30), (5, 1000), (2048, 1 << 30)])
def test_links_keep_components_in_large_shards(spark, tree, wave):
    """Many fingerprints that share blocks, in one tree or many, broadcast at once or in waves."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), "fp", 3, tree, wave).collect()
    group = {v: v for v in signed}

    def find(v):
        while group[v] != v:
            v = group[v]
        return v

    for e in edges:
        assert find(e.a) is not None and e.a in group and e.b in group
        group[find(e.a)] = find(e.b)
    want = brute_components([(i, v & ((1 << 64) - 1)) for i, v in enumerate(signed)])
    mine = {}
    for i, v in enumerate(signed):
        mine.setdefault(find(v), []).append(i)
    assert all(want[i] == min(members) for members in mine.values() for i in members)


def test_components_against_brute_force(spark, odd):
    frame, rows = odd
    got = simhash.simhash_components(frame).collect()
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = sorted((str(d), f, str(c)) for (d, f), c in zip(fps, brute_components(fps)))
    assert sorted((str(r.doc_id), r.fp & ((1 << 64) - 1), str(r.component_id)) for r in got) == want


def test_near_dedup_keeps_one_of_each_component(spark, odd, empty):
    frame, rows = odd
    kept = simhash.near_dedup(frame)
    assert kept.columns == frame.columns
    fps = {brute_fingerprint(r[1]) for r in rows}
    got = [brute_fingerprint(r.text) for r in kept.collect()]
    listed = sorted(fps)
    assert len(got) == len(set(brute_components([(i, f) for i, f in enumerate(listed)])))
    assert simhash.near_dedup(empty).count() == 0
