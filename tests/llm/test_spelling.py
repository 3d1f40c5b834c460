"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from routeforge.llm import queries, spelling
from tests.llm.conftest import EDGE


def brute_words(rows, part=199, shortest=6, rarest=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % part == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= rarest}


def apart(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, ratio=5, **limits):
    words = brute_words(rows, **limits)
    deleted = {}  # words by what is left without one letter: enough to find all pairs, which are then checked
    for w in words:
        for v in {w, *[w[:i] + w[i + 1 :] for i in range(len(w))]}:
            deleted.setdefault(v, set()).add(w)
    near = {w: set() for w in words}
    for group in deleted.values():
        for a in group:
            near[a] |= {b for b in group if apart(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute(rows)
    assert any(r[3] for r in expected)
    assert rows_of(queries.QUERIES["op13_spelling_variants"](spark, folder)) == expected


def test_edits_runs_and_ties(spark):
    texts = [
        "balloon " * 100, "baloon " * 10, "ballon " * 10, "ballooon " * 5, "baléoon " * 5, "xballoon balloonx " * 5,
        "aaaaaa " * 30, "aaaaaaa " * 6, "abaaaa " * 5, "×÷ÀÿÉé " * 5, "×÷ÀÿÉÈ " * 25, "short Short SHORT " * 9,
        "colour-Colour'COLOUR " * 3, "colours " * 5, "colourst " * 5, "rare12words " * 4, "pairings " * 50, "pairingz " * 50, "pairing " * 10,
    ]
    rows = list(enumerate(texts)) + [(3, texts[0]), (None, "balloon" + "\n" + "colour")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = rows_of(spelling.spelling_variants(df, part=10**9))
    assert got == brute(rows, part=10**9)
    by_word = {r[0]: r for r in got}
    assert by_word["pairing"][3] == "pairings" and by_word["ballooon"][3] == "balloon"


def test_random_words_of_few_letters(spark):
    rng = random.Random(4)
    rows = [(k, " ".join("".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(600))) for k in range(40)]
    rows += [(k, t) for k, t in rows[:5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for part in (2, 199):
        expected = brute(rows, part=part)
        assert max(r[2] for r in expected) > 10
        assert rows_of(spelling.spelling_variants(df, part=part)) == expected


def test_groups_over_batches(spark):
    words = spark.createDataFrame([("".join(p), k + 1) for k, p in enumerate(zip(*["abcdef"] * 1, strict=True))], "word string, n long")
    assert spelling.near_pairs(words).count() == 30
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert spelling.near_pairs(words).count() == 30
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_edges(spark, edge, nothing):
    assert rows_of(spelling.spelling_variants(edge, rarest=1)) == brute(EDGE, rarest=1)
    assert spelling.spelling_variants(nothing).collect() == []
    long_text = "accommodate " * 40_000 + "acommodate " * 9 + "z" * 300_000
    got = rows_of(spelling.spelling_variants(spark.createDataFrame([(1, long_text)], "doc_id long, text string")))
    assert got == brute([(1, long_text)])
