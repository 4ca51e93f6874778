"""Exact and near deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import exact_dedup, simhash, vectors
from tessera.llm.common import components


class Union:
    def __init__(self):
        self.up = {}

    def top(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[normal(r["text"])].append(r["doc_id"])
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == want


def test_drop_copies(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in exact_dedup.exact_dedup(docs).filter("kept").collect()}
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
    before = {r["doc_id"]: r for r in docs.collect()}
    assert all(r == before[r["doc_id"]] for r in rows)


def test_exact_dedup_odd_rows(spark, empty):
    rows = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b"), (1, None), (2, "")], "doc_id long, text string")
    got = sorted((r["text_sha256"][:4], r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(rows).collect())
    kept = [g for g in got if g[4]]
    assert len(got) == 6 and len(kept) == 3 and {(g[1], g[2]) for g in kept} == {(3, 3), (-1, -1), (1, 1)}
    assert exact_dedup.drop_copies(rows).count() == 3
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def brute_print(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_groups(prints):
    u = Union()
    ids = sorted(prints)
    for k, a in enumerate(ids):
        u.top(a)
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                u.join(a, b)
    return {i: u.top(i) for i in ids}


def test_simhash(docs):
    prints = {r["doc_id"]: brute_print(r["text"]) for r in docs.collect()}
    want = brute_groups(prints)
    got = simhash.simhash_groups(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


@pytest.mark.parametrize("seed", range(3))
def test_links_connect_what_is_close(spark, seed):
    """Crowds of fingerprints: chains and balls, so that keys hold many of them."""
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    found = set(base)
    for b in base[:6]:
        x = b
        for _ in range(40):
            x ^= 1 << int(rng.integers(64))
            if rng.random() < 0.5:
                x ^= 1 << int(rng.integers(64))
            found.add(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in found}
    want = brute_groups({s: x for x, s in signed.items()})
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {s: got.get(s, s) for s in want} == want


def test_simhash_odd_rows(spark, empty):
    rows = spark.createDataFrame([(None, "a b c"), (None, "q r s t"), (4, "a b c"), (4, "a b c"), (7, None), (8, " \n")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(rows).collect())
    assert [g[2] for g in got if g[0] == 4] == [4, 4] and [g[2] for g in got if g[0] in (7, 8)] == [7, 7] and {g[2] for g in got if g[0] == -1} == {4, None}
    assert simhash.simhash_groups(empty).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Ids that repeat in several groups, null ids, and more columns with names used inside."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 7)))
    rows = []
    for g in range(40):
        t = " ".join(word() for _ in range(30))
        for k in range(int(rng.integers(1, 6))):
            i = None if rng.random() < 0.4 else int(rng.integers(0, 12))
            rows.append((i, t.replace(" ", " " * (k + 1)), g, k))  # equal fingerprints, different texts
    rows += [(None, rows[0][1], 0, 0), (None, None, 99, 0), (3, None, 99, 0), (3, "", 99, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root long, _gone_id int").repartition(4)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    groups = defaultdict(set)
    for i, t, g, _ in rows:
        groups[g].add((i is None, i or 0, t))
    got = defaultdict(set)
    for r in kept.collect():
        got[r["root"]].add((r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    assert set(got) == set(groups) and all(len(x) == 1 for x in got.values())
    assert all(min(groups[g])[:2] == min(x)[:2] for g, x in got.items() if g != 99) and min(got[99])[:2] == (False, 3)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 5)]
    u = Union()
    for a, b in pairs:
        if a != b:
            u.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: u.top(x) for x in u.up}


@pytest.mark.parametrize("block", [16, 2048])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 12))
    rows = [[float(x) for x in np.float32(b + rng.normal(size=12) * s)] for b in base for s in (0.0, 0.05, 0.3)]
    hot = [[float(x) for x in np.float32(base[0] + rng.normal(size=12) * 0.02)] for _ in range(80)]
    rows += hot + [rows[0], rows[0], [2 * x for x in rows[0]], rows[0][:5], rows[0][:5]]
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11]
    ids = list(range(len(rows) + len(odd)))
    rng.shuffle(ids)
    every = dict(zip(map(int, ids), rows + odd))
    fine = {i: np.array(v) for i, v in every.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    u, links = Union(), defaultdict(int)
    for a in every:
        u.top(a)
    for a in fine:
        for b in fine:
            if a < b and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] / np.sqrt((fine[a] @ fine[a]) * (fine[b] @ fine[b])) >= 0.95:
                u.join(a, b)
                links[a] += 1
                links[b] += 1
    df = spark.createDataFrame([(i, v, "x") for i, v in every.items()], "vec_id long, embedding array<double>, key string").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df, block=block).collect()}
    assert got == {i: (links[i], u.top(i), u.top(i) == i) for i in every}
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert [tuple(r) for r in vectors.near_vectors(spark.createDataFrame([(None, [1.0, 2.0])], df.schema["vec_id"].name + " long, embedding array<double>")).collect()] == [(None, 0, None, False)]


def test_one_of_two_units_sends():
    for u in range(7):
        for w in range(7):
            assert u == w or vectors.sends(np.int64(u), np.int64(w)) != vectors.sends(np.int64(w), np.int64(u))


@pytest.mark.parametrize("block", [7, 64])
def test_near_vectors_of_floats(spark, block):
    """Cosines on both sides of the limit, in single precision, in many small blocks."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16)).astype(np.float32)
    every = np.concatenate([base, *[(b + rng.normal(size=(12, 16)) * 0.08).astype(np.float32) for b in base[:12]], base[:5] * 2])
    x = every.astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    near = x @ x.T >= 0.95
    u = Union()
    for a, b in zip(*np.nonzero(near)):
        u.join(int(a), int(b))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<float>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df, block=block).collect()}
    assert got == {i: (int(near[i].sum()) - 1, u.top(i)) for i in range(len(every))}
