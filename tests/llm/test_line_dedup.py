"""Line dedup against all pairs of lines."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routeforge.llm import line_dedup, queries
from tests.llm.conftest import EDGE


def shingles(line):
    return frozenset(line[i : i + 9] for i in range(max(1, len(line) - 8)))


def has_word(text):
    return bool(re.search(r"[^\x20\x09-\x0D]", text))


def brute(rows):
    """Places of the lines that go, per row, and all linked pairs of different lines."""
    places = [(i, k, line) for i, (_, t) in enumerate(rows) for k, line in enumerate((t or "").split("\n")) if has_word(line)]
    distinct = list(dict.fromkeys(line for _, _, line in places))
    sets = [shingles(line) for line in distinct]
    parent = list(range(len(distinct)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    order = sorted(range(len(distinct)), key=lambda k: len(sets[k]))
    links = set()
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if len(sets[j]) * 0.8 > len(sets[i]):
                break
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                links.add(frozenset((distinct[i], distinct[j])))
                parent[root(i)] = root(j)
    number = {line: k for k, line in enumerate(distinct)}
    keeper = {}
    for i, k, line in sorted(places, key=lambda p: (rows[p[0]][0] is None, rows[p[0]][0] or 0, p[0], p[1])):
        keeper.setdefault(root(number[line]), (i, k))
    dropped = [[] for _ in rows]
    for i, k, line in places:
        if keeper[root(number[line])] != (i, k):
            dropped[i].append(k)
    return dropped, links


def text_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def cut(rows, dropped):
    out = []
    for (i, t), gone in zip(rows, dropped):
        if not gone:
            out.append((i, t))
            continue
        left = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone)
        if has_word(left):
            out.append((i, left))
    return sorted(out, key=repr)


def test_query_equals_all_pairs(spark, folder, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]
    dropped, links = brute(rows)
    assert links and any(dropped)
    got = {r.doc_id: r for r in queries.QUERIES["op5_line_dedup"](spark, folder).collect()}
    for (doc_id, text), gone in zip(rows, dropped):
        assert (got[doc_id].n_lines, got[doc_id].dropped, got[doc_id].n_dropped) == (len(text.split("\n")), gone, len(gone))
    deduped = line_dedup.dedup_lines(documents)
    assert deduped.schema.names == documents.schema.names
    assert text_rows(deduped) == cut(rows, dropped)
    assert deduped.where(F.char_length("text") != F.col("n_chars")).count() == 0


def test_recall_of_banding():
    """Lines just above the threshold share a band at the stated rate."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghijklmno ") for _ in range(300)) for _ in range(600)]
    near = []
    for line in base:
        at = rng.randrange(30, 200)
        near.append(line[:at] + "".join(rng.choice("ABCDEFGH") for _ in range(24)) + line[at + 24 :])  # 32 of 292 shingles differ on either side: Jaccard 0.803
    both = pa.array(base + near)
    hashes, owner = line_dedup._shingles(both, 9)
    keys = line_dedup.band_keys(line_dedup.signatures(hashes, owner, len(both)))
    assert 0.79 < len(shingles(base[0]) & shingles(near[0])) / len(shingles(base[0]) | shingles(near[0])) < 0.82
    assert np.mean((keys[:600] == keys[600:]).any(axis=1)) > 0.97
    assert np.mean((keys[:600] == np.roll(keys[600:], 1, axis=0)).any(axis=1)) == 0


def test_recall_is_the_computed_rate():
    """At the threshold one pair in 4,000 or fewer shares no band; 8 bands miss about 56 of 4,000, 10 bands about 19."""
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefghijklmno ", k=300)) for _ in range(4000)]
    near = [line[:40] + "".join(rng.choices("ABCDEFGH", k=24)) + line[64:] for line in base]
    hashes, owner = line_dedup._shingles(pa.array(base + near), 9)
    keys = line_dedup.band_keys(line_dedup.signatures(hashes, owner, 8000))
    assert (~(keys[:4000] == keys[4000:]).any(axis=1)).sum() <= 6


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_groups(spark, seed):
    rng = random.Random(seed)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    common = [sentence(n) for n in (1, 3, 20, 40, 80)]
    rows = []
    for k in range(60):
        lines = [sentence(rng.randint(1, 30)) for _ in range(3)]
        for c in common:
            if rng.random() < 0.5:
                words = c.split()
                if len(words) > 10:
                    words[rng.randrange(len(words))] = "zzzzz"
                lines.insert(rng.randrange(len(lines) + 1), " ".join(words))
        rows.append((k, "\n".join([*lines, ""])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dropped, links = brute(rows)
    assert len(links) > 100
    got = {r.doc_id: r.dropped for r in line_dedup.line_decisions(docs).collect()}
    assert [got[k] for k in range(60)] == dropped


def test_short_lines_of_equal_sets(spark):
    """Lines of 9 to 11 characters can have the same shingles as other lines: runs, and words said again and again."""
    lines = ["-" * n for n in (8, 9, 10, 11, 40)] + ["ab" * 5, "ab" * 5 + "a", "ab" * 20, "x" + "=" * 9, "x" + "=" * 10, "abcdefghi", "abcdefghij"]
    rows = list(enumerate(lines))
    dropped, links = brute(rows)
    assert len(links) == 10
    got = {r.doc_id: r.dropped for r in line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == dropped


def test_edges(spark, edge, nothing):
    got = line_dedup.dedup_lines(edge)
    assert got.columns == edge.columns
    once = list(dict.fromkeys(EDGE))  # equal rows come back once
    assert text_rows(got.where("text rlike '[a-z]'")) == cut([r for r in once if r[1] and has_word(r[1])], brute([r for r in once if r[1] and has_word(r[1])])[0])
    assert got.where("text is null").count() == 2
    assert line_dedup.line_decisions(edge).count() == len(EDGE)
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_names_equal_the_jvm(spark):
    import xxhash

    for text in ("", "a", "é漢" * 40, "x" * 1000):
        row = spark.sql("select 1").select(F.xxhash64(F.lit(text)).alias("h")).first()
        assert np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).view(np.int64) == row.h
