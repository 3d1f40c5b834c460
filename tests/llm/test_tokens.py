"""Encoding operators against the tokenizers library on whole texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from routeforge.llm import bpe, queries, token_counts, token_files
from routeforge.llm.library_bpe import LibraryEncoder, read_spec
from routeforge.llm.lexicon import Lexicon, compile_lexicon
from tests.llm.conftest import EDGE

SPEC = read_spec(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def odd_texts(n=400):
    rng = random.Random(5)
    letters = "abE ZÉéßΣσςİ́  '’sStTmMdD019 \t\n\r\x0b\x1c\x85-_=<|>ﬁ漢字かなЖж\U0001f600 endoftext"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return made + ["<|endoftext|>", "a<|startoftext|><|endoftext|>b", "'S 'LL", "I'll we've it'd", "́x", "aaaa" * 50]


def test_library_encoder_equals_whole_text_encoding():
    texts = odd_texts() + [t or "" for _, t in EDGE]
    got = LibraryEncoder(SPEC).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert got.ids[got.starts[k] : got.starts[k + 1]].tolist() == whole(text), repr(text)


def test_library_encoder_of_another_vocabulary_takes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = LibraryEncoder(read_spec(path)), Tokenizer.from_file(path)
    assert not encoder.by_word
    texts = ["Hello  world\n", "", "x y"]
    got = encoder.encode(pa.array(texts))
    assert [got.ids[a:b].tolist() for a, b in zip(got.starts, got.starts[1:])] == [
        library.encode(t, add_special_tokens=False).ids for t in texts
    ]


def test_own_merges_equal_the_library_with_and_without_lexicon():
    texts = odd_texts() + [t or "" for _, t in EDGE]
    vocabulary = bpe.Vocabulary(SPEC)
    words = sorted({p for t in texts for w in t.split() for p in vocabulary.pieces(w) if isinstance(p, bytes)})
    flat, sizes = vocabulary.merge(words)
    ends = np.cumsum(sizes)
    runs = {w: flat[e - s : e].tolist() for w, s, e in zip(words, sizes, ends)}
    for lexicon in (None, Lexicon(compile_lexicon({w: runs[w] for w in words[::2]}))):
        ids, starts = bpe.LexiconEncoder(vocabulary, lexicon).encode(pa.array(texts))
        for k, text in enumerate(texts):
            mine = ids[starts[k] : starts[k + 1]]
            assert mine.tolist() == whole(text), repr(text)
            assert vocabulary.decode(mine) == LIBRARY.decode(whole(text), skip_special_tokens=False)


def test_long_words_merge_like_short_ones():
    vocabulary = bpe.Vocabulary(SPEC)
    rng = random.Random(1)
    for n in (1, 2, 5, 30, 64, 65, 500):
        word = "".join(rng.choice("thenigorables") for _ in range(n)).encode()
        assert vocabulary.merge_long(word) == whole(word.decode())
        assert vocabulary.merge([word])[0].tolist() == whole(word.decode())


def test_lexicon_is_minimal_and_tells_words_apart(tmp_path):
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["a", "ab", "walked", "talked", "walking", "talking", "é"])}
    path = tmp_path / "lexicon.bin"
    path.write_bytes(compile_lexicon(words))
    lexicon = Lexicon.open(str(path))
    asked = [*words, b"", b"wal", b"walkedx", b"zzz", b"tal", b"b"]
    places = lexicon.places(asked)
    ends = np.cumsum(lexicon.sizes)
    for word, place in zip(asked, places):
        if word in words:
            assert lexicon.ids[ends[place] - lexicon.sizes[place] : ends[place]].tolist() == words[word]
        else:
            assert place == -1
    # walk-ed/ing and talk-ed/ing share all states behind their first letter: the root, 6 more of them for
    # [wt]alk(ed|ing) up to "ing", one of which also ends "ed", and those of "a", "ab" and é.
    assert len(lexicon.final) < sum(map(len, words)) / 2
    assert Lexicon(compile_lexicon({})).places([b"x", b""]).tolist() == [-1, -1]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_bpe_query(spark, folder, documents):
    expected = []
    for row in documents.select("doc_id", "text").collect():
        ids = whole(row.text)
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        expected.append(
            (row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256(text.encode()).hexdigest())
        )
    got = queries.QUERIES["op8_bpe"](spark, folder)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)


def test_bpe_edges(edge, nothing):
    name = bpe.ship_lexicon(edge, SPEC, most=3)
    got = bpe.encode_and_decode(edge, SPEC, name, keep=("doc_id", "text", "n_words"), with_ids=True).collect()
    assert len(got) == len(EDGE)
    for row in got:
        assert row.ids == whole(row.text)
        assert row.decoded == LIBRARY.decode(whole(row.text), skip_special_tokens=False)
    assert bpe.encode_and_decode(nothing, SPEC, bpe.ship_lexicon(nothing, SPEC)).count() == 0


def file_rows(rows, end=2):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for doc_id, text in ordered:
        ids = [*whole(text), end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_query(spark, folder, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = queries.QUERIES["op1_token_files"](spark, folder)
    assert rows_of(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(file_rows(rows), key=repr)


def test_token_files_edges(spark, edge, nothing):
    manifest = token_files.write_token_files(edge, SPEC, 2, shard_ids=50)
    got = rows_of(token_files.read_token_files(spark, manifest), "doc_id", "n_tokens", "ids_crc32", "start")
    expected = [(i, n, c) for i, _, n, c in file_rows(EDGE)]
    assert sorted((r[:3] for r in got), key=repr) == sorted(expected, key=repr)
    by_start = sorted(got, key=lambda r: r[3])
    assert [r[3] for r in by_start] == np.cumsum([0, *[r[1] for r in by_start]])[:-1].tolist()
    ids = [r[0] for r in by_start]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_files.read_token_files(spark, token_files.write_token_files(nothing, SPEC, 2)).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).choice(10**12, 20_000, replace=False).astype(np.int64)
    hashes = token_files._key_hashes(keys, np.zeros(len(keys), bool))
    table = token_files.PerfectHash.build(hashes)
    assert sorted(table.lookup(hashes)) == list(range(len(keys)))  # minimal: every slot once
    assert sum(8 * len(b) for b in table.levels) < 6 * len(keys)
    others = token_files._key_hashes(np.arange(10**12, 10**12 + 50_000), np.zeros(50_000, bool))
    assert (table.lookup(others) >= 0).sum() <= 2


def test_keyed_access(spark, documents):
    manifest = token_files.write_token_files(documents, SPEC, 2)
    texts = dict(tuple(r) for r in documents.select("doc_id", "text").collect())
    seen = 0
    for row in manifest.collect():
        shard = token_files.Shard.open(row.ids_path, row.index_path)
        for doc_id, places in zip(texts, shard.places(list(texts))):
            for place in places:
                assert shard.document(place).tolist() == [*whole(texts[doc_id]), 2]
                seen += 1
    assert seen == len(texts)
    with pytest.raises(ValueError):
        token_files._load(b"something else")


def test_token_counts(spark, folder, documents, edge, nothing):
    lengths = [len(whole(r.text)) for r in documents.select("text").collect()]
    got = queries.QUERIES["op9_token_counts"](spark, folder).collect()
    assert sorted(r.length for r in got) == sorted(set(lengths))
    for r in got:
        assert r.n_docs == lengths.count(r.length)
        assert r.tokens == r.length * r.n_docs
        assert r.docs_within == sum(n <= r.length for n in lengths)
        assert r.docs_cut == sum(n > r.length for n in lengths)
        assert r.tokens_within == sum(n for n in lengths if n <= r.length)
        assert r.truncated_total == sum(min(n, r.length) for n in lengths)
        assert r.tokens_lost == sum(max(n - r.length, 0) for n in lengths)
        assert r.quantile == pytest.approx(r.docs_within / len(lengths))
    histogram = token_counts.length_histogram(edge, SPEC)
    lengths = [len(whole(t)) for _, t in EDGE]
    assert {r.limit: (r.docs_cut, r.truncated_total) for r in token_counts.at_limits(histogram, [0, 5, 10**6]).collect()} == {
        n: (sum(x > n for x in lengths), sum(min(x, n) for x in lengths)) for n in (0, 5, 10**6)
    }
    assert token_counts.for_every_limit(token_counts.length_histogram(nothing, SPEC)).count() == 0
