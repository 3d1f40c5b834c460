"""N-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct word 3-shingles. Every hash toggles one bit of a sketch, so two
sketches differ in at most as many bits as the sets' symmetric difference has elements. With Jaccard similarity of at
least ``p/100`` and sizes below U the difference is at most D = 2(U - 1)(100 - p)/(100 + p), so among more than D parts of
the sketch at least one is equal in both: documents are joined on (size band, part, bits of the part) and then verified.

Size bands grow by a quarter; a document that can link to a larger one in the next band is entered there as well. A part that no shingle
falls into says nothing and is not entered. A band therefore has some parts more than D + 1; a document with more empty parts than
that is entered again under other hashes, until it has few enough. Of two documents, the one that stops first then has a non-empty equal part under a sketch
that both have.

A part of few shingles is equal by chance in the more documents, the more there are. Bands therefore have an eighth more parts than D + 1: all
non-empty parts but as many as the sets can differ in are equal in linked documents, so a document that has fewer in common with others is left out,
and as many but one of its most frequent keys are not needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeforge.llm.arrow_text import mix, slices, texts_of, words_of
from routeforge.llm.components import broadcast_if_small
from routeforge.llm.rows import unpacked, whole_row
from routeforge.llm.similar_texts import Sets, classes_by_keys, sets_by_owner
from routeforge.session import stage_scope, stage_table

SHINGLE = 3
PERCENT = 90
#: Bits in a part of a sketch.
PART_BITS = 4096
GROWTH = 1.25
#: A band has one part in so many more than the least number.
MORE_PARTS = 8
#: Bytes of text whose sets a worker makes at a time.
SLICE = 500_000


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Sets:
    """A-Z count as lower case; a text of fewer than ``width`` words is one shingle; one without words has none."""
    words = words_of(pc.ascii_lower(texts))
    n = len(texts)
    by_word = np.array([xxhash.xxh3_64_intdigest(w) for w in words.distinct.cast(pa.binary()).to_pylist()], np.uint64)
    hashes = by_word[words.codes] if len(by_word) else np.zeros(0, np.uint64)
    owner, counts = words.owners(), words.counts
    with np.errstate(over="ignore"):
        rolled = mix(hashes, 1)
        whole = rolled.copy()
        for k in range(1, width):
            rolled = mix(rolled[:-1] + hashes[k:], k + 1) if len(rolled) > 1 else rolled[:0]
        full = owner[: len(rolled)] == owner[width - 1 :][: len(rolled)]
        parts, owners = [rolled[full]], [owner[: len(rolled)][full]]
        for size in range(1, width):  # texts of that many words, hashed apart from longer shingles
            first = words.starts[:-1][counts == size]
            value = whole[first]
            for k in range(1, size):
                value = mix(value + hashes[first + k], k + 1)
            parts.append(mix(value, 1000 + size))
            owners.append(np.flatnonzero(counts == size))
    return sets_by_owner(np.concatenate(parts), np.concatenate(owners), n)


@lru_cache(maxsize=8)
def size_bands(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First sizes of the bands up to one above ``largest``, and the number of parts in each."""
    firsts = [1]
    while firsts[-1] <= largest:
        firsts.append(max(firsts[-1] + 1, int(np.ceil(firsts[-1] * GROWTH))))
    firsts.append(max(firsts[-1] + 1, int(np.ceil(firsts[-1] * GROWTH))))
    parts = []
    for first, end in zip(firsts[:-1], firsts[1:], strict=True):
        least = 2 * (end - 1) * (100 - percent) // (100 + percent) + 1
        # As many more as the smallest set entered here leaves empty, so that few sets need other hashes.
        more = least + least // MORE_PARTS
        smallest, m, before = max(1, -(-percent * first // 100)), more, 0
        while least > 1 and m != before:
            empty, before = m * np.exp(-smallest / m), m
            m = min(2 * least, max(m, more + int(empty + 3 * np.sqrt(empty))))  # small bands have no fixed point below
        parts.append(m)
    return np.array(firsts[:-1], np.int64), np.array(parts, np.int64)


def spare_parts(first: int, end: int, parts: int, percent: int) -> int:
    """Empty parts that a document of the band may have."""
    return parts - (2 * (end - 1) * (100 - percent) // (100 + percent) + 1)


def sketch_keys(sets: Sets, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of all sets, and the place of the set each belongs to (in order)."""
    return sketches_of(sets, percent)[:2]


def sketches_of(sets: Sets, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`sketch_keys`, and for each set how many of its even and how many of its odd keys it shares at least with any set
    that it links to through such keys. Keys of bands of even number are even, others odd; a set is in at most one band of each."""
    sizes = sets.sizes
    needs = np.full((len(sizes), 2), np.iinfo(np.int32).max, np.int32)
    if not len(sets.hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), needs
    firsts, parts = size_bands(int(sizes.max()), percent)
    ends = np.append(firsts[1:], max(firsts[-1] + 1, int(np.ceil(firsts[-1] * GROWTH))))
    spare = parts - (2 * (ends - 1) * (100 - percent) // (100 + percent) + 1)
    band = np.searchsorted(firsts, sizes, side="right") - 1
    keys, owners = [], []
    # In its own band, and in the next one where a set of that band can link to it.
    following = np.minimum(band + 1, len(firsts) - 1)
    above = (100 * sizes >= percent * firsts[following]) & (following > band)
    for where, chosen in ((sizes > 0, band), (above & (sizes > 0), following)):
        who, seed = np.flatnonzero(where), 0
        while len(who):
            m = parts[chosen[who]]
            base = np.cumsum(m) - m
            lengths = sizes[who]
            at = np.repeat(sets.starts[who] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            local = np.repeat(np.arange(len(who)), lengths)
            value = mix(sets.hashes[at], 50 + seed)
            part = base[local] + (value % m[local].astype(np.uint64)).astype(np.int64)
            bit = (value >> np.uint64(40)) % np.uint64(PART_BITS)
            # The parity bits of a part, as one word: toggling a bit twice undoes it.
            word = np.zeros(int(m.sum()), np.uint64)
            np.bitwise_xor.at(word, part, mix(bit, 900))
            filled = np.bincount(part, minlength=len(word)) > 0
            place = np.repeat(np.arange(len(who)), m)
            number = np.arange(len(word)) - base[place]
            name = mix((chosen[who][place].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64), 7000 + seed)
            kind = chosen[who] & 1
            key = mix(word[filled] ^ name[filled], 8)
            keys.append((key & ~np.uint64(1)) | kind[place[filled]].astype(np.uint64))
            owners.append(who[place[filled]])
            full = np.bincount(place[filled], minlength=len(who))
            # Linked sets differ in at most so many elements, and in no more parts.
            differ = (lengths + np.minimum(ends[chosen[who]] - 1, 100 * lengths // percent)) * (100 - percent) // (100 + percent)
            needs[who, kind] = np.minimum(needs[who, kind], np.maximum(full - differ, 1))
            empty = m - full
            who, seed = who[empty > spare[chosen[who]]], seed + 1
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return key[order], owner[order], needs


SKETCHES = "doc_id long, text_hash long, n long, h1 long, h2 long, keys array<long>, even int, odd int"


def _sketches(docs: DataFrame, percent: int, width: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "text", SLICE):
            sets = shingle_sets(texts_of(table), width)
            key, owner, needs = sketches_of(sets, percent)
            n = table.num_rows
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
            sums = []
            for seed in (1, 2):  # two sums of the set's hashes, equal for equal sets
                with np.errstate(over="ignore"):
                    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.hashes, seed), dtype=np.uint64)])
                    sums.append((running[sets.starts[1:]] - running[sets.starts[:-1]]).view(np.int64))
            yield pa.record_batch(
                [
                    table.column("doc_id").combine_chunks(),
                    table.column("text_hash").combine_chunks(),
                    pa.array(sets.sizes, pa.int64()),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key.view(np.int64))),
                    *[pa.array(np.ascontiguousarray(needs[:, k])) for k in (0, 1)],
                ],
                ["doc_id", "text_hash", "n", "h1", "h2", "keys", "even", "odd"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(sketch, SKETCHES)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, n_shingles, component_id and keeps (one row of each component).

    Documents link when 100 times the common shingles are at least ``percent`` times all. component_id is the least doc_id that
    links reach. Null or wordless texts link with nothing and are components of their own (component_id is their doc_id,
    and keeps holds). Null doc_ids take part and count as the largest; equal doc_ids stay rows of their own.
    Columns beyond the two are not read; an empty table gives none. Sets are compared by 64-bit hashes of shingles.
    """
    with stage_scope(docs.sparkSession):
        sketched = _sketches(docs, percent, width).withColumn("row", F.monotonically_increasing_id())
        sketched = stage_table(sketched, "sketches")  # the row numbers are fixed by writing them
        classes = stage_table(_set_classes(docs, sketched, percent, width), "classes", keep=True)
        rows = stage_table(sketched.drop("keys", "even", "odd"), "rows", keep=True)
    joined = rows.join(classes, ["n", "h1", "h2"], "left")
    alone = F.col("n") == 0
    return joined.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("kept_row"))).alias("keeps"),
    )


def _set_classes(docs: DataFrame, rows: DataFrame, percent: int, width: int) -> DataFrame:
    """(n, h1, h2, component_id, kept_row) of the sets of staged sketches."""
    named = rows.where("n > 0")
    equal = named.groupBy("n", "h1", "h2").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least"), F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "row")).alias("keeper")
    )
    equal = stage_table(equal, "equal-sets")
    copies = named.select("row", "n", "h1", "h2").join(equal, ["n", "h1", "h2"]).where("row <> node").select("row")
    distinct = named.join(broadcast_if_small(stage_table(copies, "copies")), "row", "left_anti")
    members = distinct.select(F.array("row").alias("ids"), "keys")

    def texts_of(ids: DataFrame) -> DataFrame:
        needed = rows.select(F.col("row").alias("id"), "doc_id", "text_hash").join(broadcast_if_small(ids), "id")
        needed = stage_table(needed, "candidates")
        asked = broadcast_if_small(needed.select("id", F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash")))
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
        same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash"))
        return source.join(asked, same).select("id", "text").dropDuplicates(["id"])

    needs = rows.select(F.col("row").alias("id"), "even", "odd")
    found = classes_by_keys(members, texts_of, lambda texts: shingle_sets(texts, width), percent, needs)
    classes = equal.join(found, equal["node"] == found["id"], "left").withColumn("root", F.coalesce("component", "node"))
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.min("keeper").alias("keeper"))
    return classes.join(roots, "root").select("n", "h1", "h2", "component_id", roots["keeper"]["row"].alias("kept_row"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`, all columns unchanged.

    Of rows equal in doc_id and text, which are one component unless they have no words, one stays.
    """
    with stage_scope(docs.sparkSession):
        judged = near_duplicates(docs, percent, width)
        gone = judged.groupBy(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash")).agg(
            F.max("keeps").alias("stays"), F.count("*").alias("copies"), F.min("n_shingles").alias("words")
        )
        gone = stage_table(gone.where("not stays or (copies > 1 and words > 0)"), "near-duplicates", keep=True)
    marked = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("its_id"), F.xxhash64("text").alias("its_hash"))
    listed = gone.select("l_id", "l_hash", "stays")
    joined = marked.join(broadcast_if_small(listed), F.expr("its_id <=> l_id and its_hash = l_hash"), "left")
    kept = joined.where("stays is null")
    if not gone.where("stays").isEmpty():
        kept = kept.unionByName(joined.where("stays").dropDuplicates(["its_id", "its_hash"]))
    return unpacked(kept, docs)
