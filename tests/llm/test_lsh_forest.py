"""The forest of word-shingle sets against all pairs."""

import random
import re

import numpy as np
import pytest

from routeforge.llm import lsh_forest, queries
from routeforge.llm.similar_texts import Sets
from tests.llm.conftest import EDGE


def brute_set(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent=85):
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
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
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


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute(rows)
    assert len({c for _, _, c in expected}) < len(rows)
    found = queries.QUERIES["op12_lsh_forest"](spark, folder)
    assert rows_of(found) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def crowd(rng, groups, each, words=120):
    """Groups of near copies, some links only just under or over the threshold, and texts that share half."""
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                copy[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows) * 3 % 1000, " ".join(copy)))
        for _ in range(each // 2):
            half = base[: words // 2] + [f"y{rng.randint(0, 10**6)}" for _ in range(words // 2)]
            rows.append((len(rows) * 3 % 1000, " ".join(half)))
    return rows


@pytest.mark.parametrize("limit", [2, 32])
def test_crowded_regions(spark, monkeypatch, limit):
    """With a crowd of 2, all levels of depth take part; the result is the same."""
    monkeypatch.setattr(lsh_forest, "CROWD", limit)
    rows = crowd(random.Random(9), 4, 50)
    assert rows_of(lsh_forest.near_duplicates(frame(spark, rows))) == brute(rows)


def test_other_thresholds(spark):
    rows = crowd(random.Random(2), 2, 25, words=60)
    for percent in (60, 100):
        assert rows_of(lsh_forest.near_duplicates(frame(spark, rows), percent=percent)) == brute(rows, percent)


def test_recall_at_the_threshold():
    """Pairs of sets at 0.85 and a little above share a prefix in some tree of each level as often as computed."""
    rng = np.random.RandomState(1)
    for level, pairs in ((0, 3000), (1, 1000)):
        depth = lsh_forest.DEPTHS[level]
        trees = lsh_forest.trees_for(depth, 85)
        for size in (17, 170):  # common elements of sets at 0.89 and 0.85
            missed, own = 0, size * 3 // 34
            common = rng.randint(0, 2**63, (pairs, size)).astype(np.uint64)
            sides = []
            for _ in range(2):
                more = rng.randint(0, 2**63, (pairs, own)).astype(np.uint64)
                hashes = np.concatenate([common, more], axis=1)
                starts = np.arange(pairs + 1) * hashes.shape[1]
                sides.append(lsh_forest.strings(Sets(hashes.reshape(-1), starts), trees, depth + lsh_forest.MORE, level)[0])
            same = (sides[0][:, :, : 1 + depth] == sides[1][:, :, : 1 + depth]).all(axis=2).any(axis=1)
            missed = int((~same).sum())
            assert missed <= max(3, 6 * lsh_forest.MISS * pairs), (level, size, missed)


def test_edges(spark, edge, nothing):
    assert rows_of(lsh_forest.near_duplicates(edge)) == brute(EDGE)
    assert lsh_forest.near_duplicates(nothing).collect() == []
    none = frame(spark, [(1, None), (2, ""), (3, " \n")])
    assert rows_of(lsh_forest.near_duplicates(none)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_long_texts_and_partitions(spark):
    rng = random.Random(6)
    long_ = [f"w{rng.randint(0, 10**7)}" for _ in range(150_000)]
    other = list(long_)
    for k in range(0, 150_000, 400):
        other[k] = "changed"
    rows = [(5, " ".join(long_)), (6, " ".join(other)), (7, "one two"), (8, "One  TWO"), (9, "one two three")]
    for parts in (1, 16):
        got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(frame(spark, rows, parts)).collect()}
        assert got == {5: 5, 6: 5, 7: 7, 8: 7, 9: 9}
