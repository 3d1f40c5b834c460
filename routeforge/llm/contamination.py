"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows, each text scanned once.

Items and texts are normalised alike: A-Z become lower case and words are runs of ASCII letters, digits and non-ASCII
characters, joined by single spaces. A window is a run of ``width`` item words with a space on either side, so a match
in a normalised text always stands on word borders. Matches carry back to word places and from there to offsets in the original text.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeforge.llm.arrow_text import slices, texts_of

WIDTH = 10
#: Bytes of item text that one automaton takes. More items make more blocks, each scanned over all texts: a bound on a
#: worker's memory (about 100 bytes of automaton per window byte), never on the items.
BLOCK_BYTES = 200_000

# Bytes that part words (all ASCII but letters and digits) become spaces, A-Z become a-z.
_TABLE = bytes(
    (b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256)
)


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(words: list[bytes], width: int) -> list[list[bytes]]:
    """All runs of ``width`` words; one shorter run for an item that has fewer, none for one without words."""
    if not words:
        return []
    return [words[i : i + width] for i in range(max(1, len(words) - width + 1))]


class Matcher:
    """The automaton over the windows of some items."""

    def __init__(self, items: list[tuple[int | None, str]], width: int):
        found: dict[bytes, tuple[int, set]] = {}
        for item, text in items:
            for run in windows(normal_words(text), width):
                found.setdefault(b" " + b" ".join(run) + b" ", (len(run), set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, (n, owners) in found.items():
            # One character per byte of the UTF-8 form.
            self.automaton.add_word(pattern.decode("latin-1"), (len(pattern), n, tuple(owners)))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges (first, end) that windows cover, joined where they meet, and the items they belong to."""
        if self.empty or not words:
            return [], set()
        line = " " + b" ".join(words).decode("latin-1") + " "
        ends, spans, items = None, [], set()
        for end, (size, n, owners) in self.automaton.iter(line):
            if ends is None:
                ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            last = bisect.bisect_left(ends, end)
            items.update(owners)
            first = last + 1 - n
            if spans and first <= spans[-1][1]:
                while spans and first <= spans[-1][1]:
                    begin, stop = spans.pop()
                    first, last = min(first, begin), max(last, stop - 1)
            spans.append((first, last + 1))
        return spans, items


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Code-point offsets (start, end) of the normalised words in the original text."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    inside = np.frombuffer(data.translate(_TABLE), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return list(zip(points[starts].tolist(), points[ends].tolist(), strict=True))


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[int | None, str]], width: int) -> Matcher:
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, width)
    return _matchers[key]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded bytes, streamed to the driver; a longer item is a block of its own."""
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        n = len(row["text"].encode("utf-8", "surrogatepass"))
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += n
    if held:
        yield held


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, the word ranges that windows of ``benchmark`` (item_id, text) cover,
    and the item_ids they belong to; plus the columns named in ``keep``, unchanged (in place of doc_id and text, if named so).

    Null texts have no words. An item with a null id marks words but is not listed. Equal items and equal rows stay apart. An
    empty table on either side gives no hits.
    """
    given = list(keep) or ["doc_id"]
    out = docs.select(*given, *[c for c in ("text",) if c not in given]).withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "hit_spans": F.expr("CAST(array() AS array<struct<first:int,end:int>>)"),
            "hit_items": F.expr("CAST(array() AS array<long>)"),
        }
    )
    context = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, block_bytes)
    items = next(blocks, [])
    while items is not None:
        following = next(blocks, None)
        # The last scan has no further use for the texts.
        names = [c for c in out.columns if following is not None or c != "text" or c in given]
        out = out.mapInArrow(_scanner(context.broadcast(items), width, names), out.select(*names).schema)
        items = following
    return out


def _scanner(shared, width: int, names: list[str]):
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, shared.value, width)
        for table in slices(batches, "text"):
            before_spans = table.column("hit_spans").to_pylist()
            before_items = table.column("hit_items").to_pylist()
            counts, spans, items = [], [], []
            for text, was, had in zip(texts_of(table).to_pylist(), before_spans, before_items, strict=True):
                words = normal_words(text)
                hits, owners = matcher.scan(words)
                counts.append(len(words))
                if was:
                    hits = [(s["first"], s["end"]) for s in was] + hits
                spans.append([{"first": a, "end": b} for a, b in _joined(hits)])
                items.append(sorted(set(had) | {i for i in owners if i is not None}))
            for name, values, kind in (
                ("n_words", counts, pa.int64()),
                ("hit_spans", spans, _SPANS),
                ("hit_items", items, pa.list_(pa.int64())),
            ):
                table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, kind))
            yield from table.select(names).combine_chunks().to_batches()

    return scan
