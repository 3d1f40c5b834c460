"""Statistics of whole texts for quality rules, counted on byte and word arrays of a slice at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from routeforge.llm.arrow_text import mix, slices, texts_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

_BYTES = np.arange(256)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_IN_WORD = ((_BYTES & 0xC0) != 0x80) & ~_SPACE  # first bytes of code points outside white space
_SYMBOL = np.isin(_BYTES, [ord(c) for c in SYMBOLS])
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122))
_MARK = np.isin(_BYTES, [ord(c) for c in "!?"])

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct_words", "n_same_next",
)


def _per_text(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    return np.diff(sums[offsets])


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text.

    Words are ``[^\\x20\\x09-\\x0D]+``. n_repeat_words: words inside 5-word windows that the text has twice or more (windows
    are compared by 64-bit hash). n_dup_lines: lines with a word that equal an earlier line. n_same_next: words
    equal to the word before.
    """
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
    raw = texts.buffers()[2]
    first = int(offsets[0])
    data = np.frombuffer(raw, np.uint8, int(offsets[-1]) - first, first) if raw is not None and offsets[-1] > first else np.zeros(0, np.uint8)
    offsets = offsets - first
    out = {
        "word_chars": _per_text(_IN_WORD, data, offsets),
        "n_symbols": _per_text(_SYMBOL, data, offsets),
        "n_upper": _per_text(_UPPER, data, offsets),
        "n_letters": _per_text(_LETTER, data, offsets),
        "n_marks": _per_text(_MARK, data, offsets),
    }

    words = words_of(texts)
    owner = words.owners()
    out["n_words"] = words.counts
    size = len(words.distinct) + 1
    out["n_distinct_words"] = np.bincount(np.unique(owner * size + words.codes) // size, minlength=n)
    same = (words.codes[1:] == words.codes[:-1]) & (owner[1:] == owner[:-1])
    out["n_same_next"] = np.bincount(owner[1:][same], minlength=n)

    covered = np.zeros(len(owner) + 1, np.int64)
    if len(owner) >= WINDOW:
        inside = owner[WINDOW - 1 :] == owner[: len(owner) - WINDOW + 1]
        at = np.flatnonzero(inside)
        hashes = mix(owner[at].astype(np.uint64), 1)
        for k in range(WINDOW):
            hashes = mix(hashes ^ words.codes[at + k].astype(np.uint64), k + 2)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        equal = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    hit = np.cumsum(covered)[: len(owner)] > 0
    out["n_repeat_words"] = np.bincount(owner[hit], minlength=n)

    lines = pc.split_pattern(texts, "\n")
    sizes = np.diff(lines.offsets.to_numpy().astype(np.int64))
    coded = lines.flatten().dictionary_encode()
    worded = (pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)).to_numpy(zero_copy_only=False) > 0)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    line_owner = np.repeat(np.arange(n), sizes)
    real = worded[codes] if len(codes) else np.zeros(0, bool)
    out["n_lines"] = np.bincount(line_owner[real], minlength=n)
    size = len(worded) + 1
    kinds = np.unique(line_owner[real] * size + codes[real]) // size
    out["n_dup_lines"] = out["n_lines"] - np.bincount(kinds, minlength=n)
    return {name: out[name].astype(np.int64) for name in COUNTS}


def doc_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """COUNTS for every row of ``docs``, beside the columns in ``keep``; null text counts as without words."""
    out_schema = docs.select(*keep).schema
    for name in COUNTS:
        out_schema = out_schema.add(name, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "text"):
            found = count_texts(texts_of(table))
            kept = table.select(list(keep))
            for name in COUNTS:
                kept = kept.append_column(name, pa.array(found[name]))
            yield from kept.combine_chunks().to_batches()

    return docs.select(*keep, *[c for c in ("text",) if c not in keep]).mapInArrow(count, out_schema)
