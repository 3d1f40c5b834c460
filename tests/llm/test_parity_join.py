"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from routeforge.llm import components, parity_join, queries
from routeforge.llm.similar_texts import Sets
from tests.llm.conftest import EDGE


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def brute_components(rows, percent=90):
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if not small or 100 * small < percent * large:
                continue
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    members = {}
    for k in range(len(rows)):
        members.setdefault(root(k), []).append(k)
    out = []
    for group in members.values():
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k]), min(ids) if ids else None) for k in group]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute_components(rows)
    assert len({c for _, _, c in expected}) < len(rows)
    assert rows_of(queries.QUERIES["op7_ngram_jaccard_join"](spark, folder)) == expected


def varied(seed, groups=12, copies=14):
    """Groups of texts around the threshold, some of them only linked through others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([1, 2, 3, 5, 12, 25, 60, 150, 400]))]
        at = base
        for _ in range(copies):
            near = list(at if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                near[rng.randrange(len(near))] = word()
            if rng.random() < 0.2:
                near += [word() for _ in range(len(near) // 15)]
            rows.append((len(rows), " ".join(near)))
            at = near
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_borderline_groups(spark, seed):
    rows = varied(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(parity_join.near_duplicates(docs)) == brute_components(rows)


def test_edges(edge, nothing):
    found = parity_join.near_duplicates(edge)
    assert rows_of(found) == brute_components(EDGE)
    kept = [r for r in found.collect() if r.keeps]
    roots = {(r.component_id, r.n_shingles) for r in found.collect() if r.n_shingles}
    assert len([r for r in kept if r.n_shingles]) == len(roots)
    assert sum(r.n_shingles == 0 for r in kept) == sum(not brute_set(t) for _, t in EDGE)
    assert parity_join.near_duplicates(nothing).count() == 0


def test_every_link_shares_a_key():
    """The bound itself: whatever differs within the threshold, a non-empty part is equal."""
    rng = np.random.default_rng(3)
    for size in (1, 2, 9, 10, 11, 19, 20, 40, 100, 101, 500, 3000):
        for _ in range(6):
            base = rng.integers(1, 2**63, size).astype(np.uint64)
            most = size // 10  # removed only: common >= 0.9 of all
            swap = (size + 18) // 19 if size > 1 else 0
            fewer = base[most:]
            other = np.concatenate([base[: size - min(swap, size // 20)], rng.integers(1, 2**63, min(swap, size // 20)).astype(np.uint64)])
            sets = [np.unique(x) for x in (base, fewer, other)]
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            keys, owner = parity_join.sketch_keys(parity_join.Sets(np.concatenate(sets), starts))
            by = [set(keys[owner == k].tolist()) for k in range(3)]
            for k in (1, 2):
                common = len(np.intersect1d(sets[0], sets[k]))
                if 100 * common >= 90 * (len(sets[0]) + len(sets[k]) - common):
                    assert by[0] & by[k], (size, k)


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (3, 1), (1, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 90: 90, 95: 90, 100: 90}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_of_short_and_repeating_texts():
    sets = parity_join.shingle_sets(pa.array(["", "a", "A", "a b", "a b c", "a b c a b c", "b a"]))
    assert sets.sizes.tolist() == [0, 1, 1, 1, 1, 3, 1]
    runs = [tuple(sets.hashes[a:b]) for a, b in zip(sets.starts, sets.starts[1:])]
    assert runs[1] == runs[2] and len(set(runs)) == 6


def test_large_sets_need_few_hashes_at_low_similarity():
    """Bands hold enough parts for the smallest set entered in them, so that keys stay below the set's size."""
    rng = np.random.default_rng(0)
    for n in (50, 1000, 8000, 20000):
        hashes = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keys, _ = parity_join.sketch_keys(Sets(hashes, np.array([0, len(hashes)])), 80)
        assert 0 < len(keys) < 1.5 * n


def test_long_sketches_never_rule_out_a_link(spark):
    """Of pairs of large sets those that link stay, and most that share half go; sketches of different lengths are folded."""
    import random

    from routeforge.llm.similar_texts import parity_sketches, possible_links

    rng = random.Random(11)
    texts, pairs, linked = [], [], []
    for size in (300, 600, 1000, 1030, 2100, 5000):
        base = [f"w{rng.randint(0, 10**9)}" for _ in range(size)]
        for share in (0.0, 0.03, 0.3):
            cut = int(size * (1 - share / 2))
            other = base[:cut] + [f"x{rng.randint(0, 10**9)}" for _ in range(int(size * share * 0.4))]
            texts += [(len(texts), " ".join(base)), (len(texts) + 1, " ".join(other))]
            pairs.append((len(texts) - 2, len(texts) - 1))
            a, b = brute_set(texts[-2][1]), brute_set(texts[-1][1])
            linked.append(100 * len(a & b) >= 80 * len(a | b))
    frame = spark.createDataFrame(texts, "id long, text string").repartition(3)
    sketches = parity_sketches(frame, parity_join.shingle_sets)
    kept = {tuple(r) for r in possible_links(spark.createDataFrame(pairs, "a long, b long"), sketches, 80).collect()}
    assert {p for p, link in zip(pairs, linked) if link} <= kept and sum(linked) >= 8
    unlike = [(2 * k, 2 * j + 1) for k in range(len(pairs)) for j in range(len(pairs)) if texts[2 * k][1][:40] != texts[2 * j + 1][1][:40]]
    passed = possible_links(spark.createDataFrame(unlike, "a long, b long"), sketches, 80).count()
    assert passed == 0
