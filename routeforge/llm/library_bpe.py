"""Encoding with the ``tokenizers`` library at corpus speed.

The library spends most of its time on normalising and splitting text it has seen before. Where the
vocabulary drops white space (its splitter removes everything between matches, and no match holds
white space), a text's ids are the ids of its white-space separated words one after the other, so each
distinct word goes through the library once per slice at most. Other vocabularies take whole texts.
"""

from __future__ import annotations

import json
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from routeforge.llm.arrow_text import Words, spread, words_of

#: Words whose ids a worker remembers in each of two generations. It bounds memory only.
REMEMBERED = 300_000


def read_spec(path: str) -> str:
    """The vocabulary file, read once on the driver; tasks get its content, not its path."""
    with open(path, encoding="utf-8") as file:
        return file.read()


@dataclass
class Encoded:
    """Ids of several texts: text i at starts[i]:starts[i+1]."""

    ids: np.ndarray
    starts: np.ndarray


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else the next
    character from U+0100 on."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


#: Words of ASCII characters that print and of the composed letters of Latin-1.
_LATIN = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
_ALPHABET = {b: c for b, c in enumerate(byte_letters()) if chr(b) != c}


class _Recent:
    """Ids by text, in two generations: what was asked for since the last turn stays, the rest goes."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, text: str) -> bytes | None:
        got = self.young.get(text)
        if got is None and (got := self.old.get(text)) is not None:
            self.put(text, got)
        return got

    def put(self, text: str, ids: bytes) -> None:
        self.young[text] = ids
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young


class LibraryEncoder:
    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(spec)
        self.added = [t["content"] for t in parts.get("added_tokens", [])]
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        kinds = [n["type"] for n in (parts.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (
            steps[0].get("behavior") == "Removed"
            and bool(steps[0].get("invert"))
            and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "")
            and kinds == ["NFC", "Replace", "Lowercase"]
            and not any(any(c.isspace() for c in t) for t in self.added)
        )
        if self.by_word:
            self.splitter = regex.compile(steps[0]["pattern"]["Regex"])
        self.words, self.pieces = _Recent(), _Recent()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()
            if len(piece) < 64:
                self.pieces.put(piece, got)
        return got

    def _word(self, word: str, may_be_added: bool) -> bytes:
        if may_be_added and any(t in word for t in self.added):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if word.isascii() and word.isprintable():
            # For printable ASCII the normaliser is lower case and the byte alphabet is the text itself.
            if word.isalpha():
                return self._piece(word.lower())
            return b"".join(map(self._piece, self.splitter.findall(word.lower())))
        if _LATIN(word):
            # Composed already, with simple lower case; only the byte alphabet is left to do.
            found = self.splitter.findall(word.lower())
            return b"".join([self._piece(p.encode().decode("latin-1").translate(_ALPHABET)) for p in found])
        tokenizer = self.tokenizer
        found = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(word))
        return b"".join([self._piece(piece) for piece, _ in found])

    def plain_words(self, texts: pa.Array) -> tuple[Words, bool]:
        """Words to encode, and whether an added token may stand in one.

        Capitals and punctuation at a word's end make many distinct words of one. ASCII capitals become lower case, and
        a space goes before punctuation that follows a letter or digit, where the splitter parts words in
        any case. Neither holds beside added tokens (which are matched first, as written) or combining marks (which
        may compose with a small letter only): such slices stay as they are.
        """
        low = pc.ascii_lower(texts)
        added = any(pc.any(pc.match_substring(low, t.lower())).as_py() for t in self.added)
        if not added and not pc.any(pc.match_substring_regex(texts, r"\p{M}")).as_py():
            texts = pc.replace_substring_regex(low, r"([a-z0-9])([.,;:!?|*$%#&])", r"\1 \2")
        return words_of(texts), added

    def encode(self, texts: pa.Array) -> Encoded:
        if not self.by_word:
            found = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            sizes = np.array([len(e.ids) for e in found], np.int64)
            ids = np.array([i for e in found for i in e.ids], "<u4")
            return Encoded(ids, np.concatenate([[0], np.cumsum(sizes)]))
        words, added = self.plain_words(texts)
        known = self.words
        distinct = words.distinct.to_pylist()
        runs = list(map(known.young.get, distinct))
        for k, run in enumerate(runs):
            if run is None:
                word = distinct[k]
                run = runs[k] = known.get(word) or self._word(word, added)
                if len(word) < 64:
                    known.put(word, run)
        lengths = np.array([len(r) for r in runs], np.int64) // 4
        ids, ends = spread(np.frombuffer(b"".join(runs), "<u4"), lengths, words.codes)
        return Encoded(ids, np.concatenate([[0], ends])[words.starts])


_encoders: dict[int, LibraryEncoder] = {}


def encoder_for(spec: str) -> LibraryEncoder:
    """One encoder in each Python worker, kept between tasks."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = LibraryEncoder(spec)
    return _encoders[key]
