"""Byte-pair encoding and decoding over a lexicon of frequent words.

Texts are normalised and split into words, each distinct word of a slice is looked up in the corpus lexicon (a minimal acyclic
transducer, mapped from a file that Spark ships to every executor), and words that it does not have are merged by
the vocabulary's rules, all of a slice at once. The lexicon only saves merges: any word gives the same ids
with or without it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from routeforge.llm.arrow_text import slices, spread, texts_of, words_of
from routeforge.llm.library_bpe import byte_letters
from routeforge.llm.lexicon import Lexicon, compile_lexicon
from routeforge.session import scratch_folder, stage_table

#: Words in the lexicon at most, the most frequent of the corpus; the rest is merged.
LEXICON_WORDS = 65_536
#: Bytes of text whose distinct words are encoded together, and of a word that is merged on its own.
SLICE = 12_000_000
LONG_WORD = 64
_NEVER = np.iinfo(np.int64).max


class Vocabulary:
    """Rules of a vocabulary file whose words end in a suffix and whose white space is dropped."""

    def __init__(self, spec: str):
        parts = json.loads(spec)
        model = parts["model"]
        split = parts["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in parts["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or parts["decoder"] is not None:
            raise ValueError("this vocabulary is normalised, split or decoded in another way")
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.tokens = np.full(max([*vocab.values(), *self.added.values()]) + 1, None, object)
        for token, i in (vocab | self.added).items():
            self.tokens[i] = token
        self.known = np.array([t is not None for t in self.tokens])
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = np.array([vocab[a] for a, _ in pairs], np.int64)
        second = np.array([vocab[b] for _, b in pairs], np.int64)
        joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (first << 32) | second
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.joined = keys[order], order.astype(np.int64), joined[order]
        # White space as Unicode lists it; the splitter's \s means the same.
        pattern = split["pattern"]["Regex"]
        self.splitter = regex.compile(pattern)
        self.cutter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def pieces(self, word: str) -> list[bytes | int]:
        """A white-space separated word as UTF-8 pieces, and ids of added tokens that stand in it."""
        if self.cutter is not None and self.cutter.search(word):
            out: list[bytes | int] = []
            for part in self.cutter.split(word):
                out += [self.added[part]] if part in self.added else self._plain(part)
            return out
        return self._plain(word)

    def _plain(self, word: str) -> list[bytes]:
        if not word.isascii():
            # One character at a time, so that a sigma at a word's end stays as it is.
            word = "".join(c.lower() for c in unicodedata.normalize("NFC", word))
        else:
            word = word.lower()
        return [piece.encode("utf-8", "surrogatepass") for piece in self.splitter.findall(word)]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NEVER), self.joined[at]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty pieces one after the other, and how many each has."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        short = [i for i, p in enumerate(pieces) if len(p) <= LONG_WORD]
        found_ids, found_owner = self._merge_together([pieces[i] for i in short])
        owners = [np.array(short, np.int64)[found_owner] if short else np.zeros(0, np.int64)]
        ids = [found_ids]
        for i, piece in enumerate(pieces):
            if len(piece) > LONG_WORD:
                run = self.merge_long(piece)
                ids.append(np.array(run, np.int64))
                owners.append(np.full(len(run), i, np.int64))
        owner, flat = np.concatenate(owners), np.concatenate(ids)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(pieces))

    def _merge_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges, in every piece, the leftmost pair of lowest rank; a piece without such a pair is done."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done_ids, done_owner = [], []
        while len(symbols):
            ranks = np.full(len(symbols), _NEVER, np.int64)
            joined = np.zeros(len(symbols), np.int64)
            pair = np.flatnonzero(owner[1:] == owner[:-1])
            ranks[pair], joined[pair] = self._find((symbols[pair] << 32) | symbols[pair + 1])
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(ranks, starts)
            runs = np.diff(np.append(starts, len(symbols)))
            each = np.repeat(lowest, runs)
            finished = each == _NEVER
            done_ids.append(symbols[finished])
            done_owner.append(owner[finished])
            at = np.flatnonzero((ranks == each) & ~finished)
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])] if len(at) else at
            symbols[at] = joined[at]
            keep = ~finished
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return np.concatenate(done_ids), np.concatenate(done_owner)

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for one piece of any length, with a heap of pairs over a linked list."""
        symbols = self.inner[np.frombuffer(piece, np.uint8)].tolist()
        symbols[-1] = int(self.last[piece[-1]])
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        ranks, _ = self._find((np.array(symbols[:-1], np.int64) << 32) | np.array(symbols[1:], np.int64))
        heap = [(int(r), i, symbols[i], symbols[i + 1]) for i, r in enumerate(ranks.tolist()) if r != _NEVER]
        heapq.heapify(heap)
        cache: dict[int, tuple[int, int]] = {}

        def find(a: int, b: int) -> tuple[int, int]:
            key = (a << 32) | b
            if key not in cache:
                rank, new = self._find(np.array([key], np.int64))
                cache[key] = (int(rank[0]), int(new[0]))
            return cache[key]

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j] = find(a, b)[1], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n:
                    rank, _ = find(symbols[left], symbols[right])
                    if rank != _NEVER:
                        heapq.heappush(heap, (rank, left, symbols[left], symbols[right]))
        return [s for s, here in zip(symbols, alive, strict=True) if here]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces, as the library does for a vocabulary without a decoder; unknown ids are left out."""
        ids = ids[ids < len(self.known)]
        return " ".join(self.tokens[ids[self.known[ids]]].tolist())


class _Pieces:
    """Distinct pieces of a slice, and each distinct word as codes of pieces."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        codes: dict[bytes | int, int] = {}
        flat: list[int] = []
        sizes: list[int] = []
        add = codes.setdefault
        split = vocabulary.pieces
        for word in words:
            found = split(word)
            sizes.append(len(found))
            for piece in found:
                flat.append(add(piece, len(codes)))
        self.distinct = list(codes)
        self.flat = np.array(flat, np.int64)
        self.sizes = np.array(sizes, np.int64)


class LexiconEncoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def _piece_ids(self, pieces: list[bytes | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has: lexicon first, then merges."""
        is_text = np.array([isinstance(p, bytes) for p in pieces], bool)
        texts = [p for p in pieces if isinstance(p, bytes)]
        places = self.lexicon.places(texts) if self.lexicon else np.full(len(texts), -1, np.int64)
        merged, merged_sizes = self.vocabulary.merge([t for t, p in zip(texts, places, strict=True) if p < 0])
        added = np.array([p for p in pieces if not isinstance(p, bytes)], np.int64)
        # One table of runs: the lexicon's, the merged ones, the added tokens.
        known = self.lexicon.sizes if self.lexicon else np.zeros(0, np.int64)
        known_ids = self.lexicon.ids.astype(np.int64) if self.lexicon else np.zeros(0, np.int64)
        sizes = np.concatenate([known, merged_sizes, np.ones(len(added), np.int64)])
        table = np.concatenate([known_ids, merged, added])
        places[places < 0] = len(known) + np.arange(len(merged_sizes))
        code = np.zeros(len(pieces), np.int64)
        code[is_text] = places
        code[~is_text] = len(known) + len(merged_sizes) + np.arange(len(added))
        ids, _ = spread(table, sizes, code)
        return ids, sizes[code]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's start (one more for the end)."""
        words = words_of(texts)
        pieces = _Pieces(self.vocabulary, words.distinct.to_pylist())
        ids, sizes = self._piece_ids(pieces.distinct)
        by_word, piece_ends = spread(ids, sizes, pieces.flat)
        ends = np.concatenate([[0], piece_ends])[np.concatenate([[0], np.cumsum(pieces.sizes)])]
        flat, word_ends = spread(by_word, np.diff(ends), words.codes)
        return flat.astype("<u4"), np.concatenate([[0], word_ends])[words.starts]


_vocabularies: dict[int, Vocabulary] = {}
_lexicons: dict[str, Lexicon] = {}


RESULTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def _vocabulary(spec: str) -> Vocabulary:
    key = hash(spec)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(spec)
    return _vocabularies[key]


def _lexicon(name: str) -> Lexicon:
    if name not in _lexicons:
        _lexicons.clear()
        _lexicons[name] = Lexicon.open(SparkFiles.get(name))
    return _lexicons[name]


def frequent_words(docs: DataFrame, spec: str, most: int = LEXICON_WORDS) -> DataFrame:
    """(word, n): the ``most`` most frequent normalised words of all texts, each counted over the whole table."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file, of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for table in slices(batches, "text", SLICE):
            words = words_of(texts_of(table))
            pieces = _Pieces(vocabulary, words.distinct.to_pylist())
            uses = np.bincount(words.codes, minlength=len(pieces.sizes))
            n = np.bincount(pieces.flat, np.repeat(uses, pieces.sizes), len(pieces.distinct)).astype(np.int64)
            kept = [i for i, p in enumerate(pieces.distinct) if isinstance(p, bytes) and len(p) <= LONG_WORD]
            yield pa.record_batch(
                [pa.array([pieces.distinct[i] for i in kept], pa.binary()), pa.array(n[kept])], ["word", "n"]
            )

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stage_table(counted.where("n > 1"), "word-counts")
    # Word counts by sixteenths of a power of two tell how frequent the words asked for are, so that few others are ordered.
    power = F.floor(F.log2("n") * 16)
    held = counted.groupBy(power.alias("power")).agg(F.count("*").alias("words")).orderBy(F.desc("power")).collect()
    total, least = 0, None
    for place, words in held:
        total, least = total + words, place
        if total >= most:
            break
    frequent = counted if least is None else counted.where(power >= least)
    return frequent.orderBy(F.col("n").desc(), "word").limit(most)


def ship_lexicon(docs: DataFrame, spec: str, most: int = LEXICON_WORDS) -> str:
    """Compile the lexicon of ``docs`` into the shared folder and have Spark bring it to every executor; its name there.

    The driver holds ``most`` words at most.
    """
    spark = docs.sparkSession
    words = [bytes(r["word"]) for r in frequent_words(docs, spec, most).select("word").toLocalIterator()]
    flat, sizes = Vocabulary(spec).merge(words)
    ends = np.cumsum(sizes)
    content = compile_lexicon(
        {w: flat[e - s : e].tolist() for w, s, e in zip(words, sizes.tolist(), ends.tolist(), strict=True)}
    )
    name = f"lexicon-{hashlib.sha256(content).hexdigest()[:16]}-{uuid.uuid4().hex}.bin"
    folder = scratch_folder(spark)
    system, place = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/{name}") as file:
        file.write(content)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def encode_and_decode(docs: DataFrame, spec: str, lexicon: str | None, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the columns in ``keep``, n_tokens, ids_sha256 (of little-endian 32-bit ids) and
    decoded_sha256 (of the decoded text); with ``with_ids`` also ``ids`` (array) and ``decoded``.

    ``lexicon`` is a name from :func:`ship_lexicon`, or None to merge every word. Null text is empty (no ids, an empty decoded
    text); equal rows stay apart; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    schema = docs.select(*keep).schema
    for name, kind in RESULTS.items():
        schema = schema.add(name, kind)
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        encoder = LexiconEncoder(vocabulary, _lexicon(lexicon) if lexicon else None)
        for table in slices(batches, "text", SLICE):
            flat, starts = encoder.encode(texts_of(table))
            hashes, decoded_hashes, decoded = [], [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                ids = flat[a:b]
                text = vocabulary.decode(ids)
                hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded_hashes.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    decoded.append(text)
            out = table.select(list(keep)).append_column("n_tokens", pa.array(np.diff(starts)))
            out = out.append_column("ids_sha256", pa.array(hashes, pa.string()))
            out = out.append_column("decoded_sha256", pa.array(decoded_hashes, pa.string()))
            if with_ids:
                ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat.astype(np.int32)))
                out = out.append_column("ids", ids).append_column("decoded", pa.array(decoded, pa.string()))
            yield from out.combine_chunks().to_batches()

    return docs.select(*keep, *[c for c in ("text",) if c not in keep]).mapInArrow(work, schema)
