import random
import re

import numpy as np
import pytest
import xxhash

from courseloom.llm import simhash
from courseloom.llm.common import components
from courseloom.llm.simhash import Shard, Tree, fingerprint, groups, near_links


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one  Two", "A b c D é É", "the the the the the", "x y z " * 70000,
                                  "\x1c a \x85 b 日本 c 😀 d"])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def near(rng, point, bits):
    for k in rng.sample(range(64), bits):
        point ^= 1 << k
    return point


def some_points(seed, n=600):
    rng = random.Random(seed)
    points = [rng.getrandbits(64) for _ in range(n // 3)]
    for _ in range(n // 3):
        points.append(near(rng, rng.choice(points), rng.randint(0, 4)))
    ball = rng.getrandbits(64)
    return points + [near(rng, ball, rng.randint(0, 2)) for _ in range(n // 3)] + [0, 1, 3, 7, (1 << 64) - 1]


def brute(points, radius):
    points = sorted(set(points))
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(points):
        for q in points[:i]:
            if (p ^ q).bit_count() <= radius:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in points}


def test_tree_loses_no_ball():
    points = np.unique(np.array(some_points(3), np.uint64))
    tree = Tree(points, 8)
    homes = {int(points[i]): leaf for leaf, at in enumerate(tree.leaves) for i in at}
    met = {(leaf, int(points[i])) for leaf, at in tree.meet(points, 2) for i in at}
    for p in homes:
        for q in homes:
            if (p ^ q).bit_count() <= 2:
                assert (homes[p], q) in met


@pytest.mark.parametrize("flush", [1, 1 << 20])
def test_shard_links(monkeypatch, flush):
    monkeypatch.setattr(simhash, "FLUSH", flush)
    points = np.unique(np.array(some_points(5), np.uint64))
    shard, links = Shard(points), []
    for part in np.array_split(points, 4):
        a, b = shard.link(part, 2)
        links += zip(a.tolist(), b.tolist())
    a, b = shard.inner()
    links += zip(a.tolist(), b.tolist())
    assert len(links) <= 2 * len(points)
    want = brute(points.tolist(), 2)
    root = {p: p for p in want}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    groups_of = lambda r: sorted(sorted(p for p in r if r[p] == x) for x in set(r.values()))
    assert groups_of(root) == groups_of(want)


@pytest.mark.parametrize("shard", [4, 100000])
def test_links_over_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    points = some_points(8)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in points})
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(near_links(df)).collect()}
    want = brute(points, 2)
    assert {p % (1 << 64) for p in got} == {p for p in want if list(want.values()).count(want[p]) > 1}
    same = {}
    for p, r in got.items():
        assert same.setdefault(want[p % (1 << 64)], r) == r


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(2)
    links = [(i, i - 1) for i in range(1, 60)] + [(1000 + i, 999) for i in range(300)] + [(5000 - i, 4999 - i) for i in range(40)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(60)} == {0} and {got[i] for i in range(999, 1300)} == {999}
    assert {got[i] for i in range(4960, 5001)} == {4960}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups(docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([2, 5, 200]))]
        rows.append((3 * i, " ".join(text)))
        if i % 3 == 0:
            rows.append((3 * i + 1, " ".join(text).upper()))
        if i % 4 == 0:
            rows.append((3 * i + 2, " ".join([*text, "tail"])))
    rows += [(900, ""), (901, None), (None, " "), (902, "same"), (902, "same"), (902, "other text"), (None, "alone here today")]
    got = [tuple(r) for r in groups(docs(rows)).collect()]
    prints = {t: slow_fingerprint(t) for _, t in rows}
    root = brute(list(prints.values()), 2)
    want = []
    for i, t in rows:
        ids = [j for j, u in rows if root[prints[u]] == root[prints[t]] and j is not None]
        p = prints[t]
        want.append((i, p - (1 << 64) if p >> 63 else p, min(ids) if ids else None))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert groups(docs([])).collect() == []
