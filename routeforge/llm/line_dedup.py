"""Fuzzy line dedup: character-shingle MinHash, banding, exact verification, one line kept of each component.

Lines are the parts of a text between line feeds; lines of white space only are left alone. Equal lines are one
node. A line of one or more whole shingles gets a one-permutation MinHash signature: its shingle hashes fall into
BANDS * ROWS bins and each bin keeps its least; an empty bin takes the value of the first filled bin in an order that depends on the bin alone.
Lines that agree in all rows of a band are candidates, and count as similar if the exact Jaccard similarity of their
shingle sets reaches the threshold. (A line shorter than a shingle is its own only one, so it has no similar line but its equals.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from routeforge.llm.arrow_text import mix, slices, texts_of
from routeforge.llm.components import broadcast_if_small
from routeforge.llm.rows import unused, whole_row
from routeforge.llm.similar_texts import Sets, classes_by_keys, sets_by_owner
from routeforge.session import stage_scope, stage_table

SHINGLE = 9
PERCENT = 80
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8 ** 4) ** 16 = 0.9998.
BANDS, ROWS = 16, 4
BINS = BANDS * ROWS  # a power of two
SLICE = 2_000_000
#: Characters hashed at a time.
BLOCK = 128_000
_EMPTY = np.uint64(2**64 - 1)
_BASE = 0x9E3779B97F4A7C15


def _shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` characters, and the text each is in; a shorter text that is not empty is one run."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        # Hashes of runs of 1, 2, 4, ... characters, put together to ``width``.
        rolled, have, power, out, done = points, 1, _BASE, None, 0
        while done < width:
            if width & have:
                if out is None:
                    out = rolled
                else:
                    n = min(len(out), max(0, len(rolled) - done))
                    factor = np.uint64(pow(_BASE, have, 2**64))
                    out = out[:n] * factor + rolled[done : done + n]
                done += have
            n = max(0, len(rolled) - have)
            rolled = rolled[:n] * np.uint64(power) + rolled[have : have + n]
            power, have = power * power % 2**64, have * 2
        counts = np.maximum(sizes - width + 1, 0)
        owner = np.repeat(np.arange(len(texts)), counts)
        at = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        hashes = mix(out[at], 3)
        short = np.flatnonzero((sizes > 0) & (sizes < width))
        if len(short):
            whole = np.array([xxhash.xxh3_64_intdigest(texts[int(k)].as_py().encode("utf-8", "surrogatepass")) for k in short], np.uint64)
            hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    return hashes, owner


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Sets:
    hashes, owner = _shingles(texts, width)
    return sets_by_owner(hashes, owner, len(texts))


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash of n sets, each with at least one hash: (n, BINS)."""
    least = np.full(n * BINS, _EMPTY, np.uint64)
    np.minimum.at(least, owner * BINS + (hashes & np.uint64(BINS - 1)).view(np.int64), hashes >> np.uint64(BINS.bit_length() - 1))
    table = least.reshape(n, BINS)
    own = table.copy()
    rows, bins = np.nonzero(own == _EMPTY)
    step = 1
    while len(rows):
        other = (mix(bins.astype(np.uint64), step) % np.uint64(BINS)).astype(np.int64)
        value = own[rows, other]
        filled = value != _EMPTY
        table[rows[filled], bins[filled]] = value[filled]
        rows, bins, step = rows[~filled], bins[~filled], step + 1
    return table


def band_keys(table: np.ndarray) -> np.ndarray:
    """(n, BANDS) join keys, which tell bands apart."""
    parts = table.reshape(len(table), BANDS, ROWS)
    keys = mix(np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy(), 11)
    for k in range(ROWS):
        keys = mix(keys ^ parts[:, :, k], 12 + k)
    return keys


def line_keys(lines: pa.Array) -> np.ndarray:
    """(n, BANDS) join keys of lines of one or more whole shingles, made for few lines at a time, so that they fit a core's cache."""
    sizes = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lines)]
    made = [np.zeros((0, BANDS), np.uint64)]
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        part = lines.slice(start, end - start)
        made.append(band_keys(signatures(*_shingles(part, SHINGLE), len(part))))
    return np.concatenate(made)


SIGNED = "doc_id long, text_hash long, lines array<long>, fresh array<long>, keys array<long>"


def _signed(docs: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "text", SLICE):
            n = table.num_rows
            lists = pc.split_pattern(texts_of(table), "\n")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            coded = lists.flatten().dictionary_encode()
            lines, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            # The JVM's xxhash64 of the same text.
            names = np.array([xxhash.xxh64_intdigest(b, seed=42) for b in lines.cast(pa.binary()).to_pylist()], np.uint64)
            blank = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) == 0
            sizes = pc.utf8_length(lines).to_numpy(zero_copy_only=False)
            long_ = np.flatnonzero((sizes >= SHINGLE) & ~blank)
            keys = line_keys(lines.take(pa.array(long_)))
            # A line's keys go with the first text of the slice that has it.
            line_of = np.repeat(np.arange(n), np.diff(offsets))
            first = np.zeros(len(lines), np.int64)
            first[codes[::-1]] = line_of[::-1]
            order = np.argsort(first[long_], kind="stable")
            counts = np.bincount(first[long_], minlength=n)
            ends = np.concatenate([[0], np.cumsum(counts)])
            per_line = pa.array(names.view(np.int64)[codes], mask=blank[codes])  # null: a line that is left alone
            yield pa.record_batch(
                [
                    table.column("doc_id").combine_chunks(),
                    table.column("text_hash").combine_chunks(),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), per_line),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names.view(np.int64)[long_[order]])),
                    pa.ListArray.from_arrays(pa.array(ends * BANDS, pa.int32()), pa.array(keys[order].reshape(-1).view(np.int64))),
                ],
                ["doc_id", "text_hash", "lines", "fresh", "keys"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(sign, SIGNED)


def _similar_lines(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(id, component) of the lines that are similar to others."""
    members = signed.select(F.col("fresh").alias("ids"), "keys")

    def texts_of(ids: DataFrame) -> DataFrame:
        lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("text")).withColumn("id", F.xxhash64("text"))
        return lines.join(broadcast_if_small(ids), "id").select("id", "text").dropDuplicates(["id"])

    return classes_by_keys(members, texts_of, shingle_sets, PERCENT)


def line_decisions(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): row (an id of its own), doc_id, text_hash, n_lines, and dropped, the places (from 0) of
    lines that are equal or similar to a line that is kept.

    Of a component the line of the least (doc_id, row, place) stays; a null doc_id counts as the largest. Null and empty
    texts have one blank line, which stays. Equal rows are rows of their own, so a copy loses all its lines. An
    empty table gives none; columns beyond the two are not read.
    """
    with stage_scope(docs.sparkSession):
        signed = stage_table(_signed(docs).withColumn("row", F.monotonically_increasing_id()), "signed-lines")
        similar = stage_table(_similar_lines(docs, signed), "similar-lines", keep=True)
        rows = stage_table(signed.select("row", "doc_id", "text_hash", "lines"), "lines-of-texts", keep=True)  # without the keys
    lines = rows.select("row", "doc_id", F.posexplode("lines").alias("place", "id")).where("id is not null")
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "row", "place")
    firsts = lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("held"))
    grouped = stage_table(firsts.join(similar, "id", "left").withColumn("component", F.coalesce("component", "id")), "lines")
    keepers = grouped.where("component <> id or held > 1").select("component").distinct().join(grouped, "component")
    keepers = keepers.groupBy("component").agg(F.min("first").alias("keeper"))
    doubtful = grouped.join(keepers, "component").select("id", F.col("keeper.row").alias("k_row"), F.col("keeper.place").alias("k_place"))
    gone = lines.join(stage_table(doubtful, "keepers"), "id").where("row <> k_row or place <> k_place")
    dropped = gone.groupBy("row").agg(F.array_sort(F.collect_list("place")).alias("dropped"))  # at most a text's lines
    none = F.expr("CAST(array() AS array<int>)")
    slim = rows.select("row", "doc_id", "text_hash", F.size("lines").cast("long").alias("n_lines"))
    return slim.join(dropped, "row", "left").withColumn("dropped", F.coalesce("dropped", none))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; rows that lose all of their words are left out.

    All columns stay; a numeric one named n_chars, if any, is counted again. Rows that lose nothing come back as
    they are, wordless and null texts among them; of rows equal in doc_id and text one comes back.
    """
    with stage_scope(docs.sparkSession):
        # Rows of equal doc_id and text are alike in all that this stage looks at: the one that loses least stands for all.
        listed = line_decisions(docs).groupBy(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash")).agg(
            F.min(F.struct(F.size("dropped").alias("lost"), "dropped")).alias("least"), F.count("*").alias("copies")
        )
        listed = stage_table(listed.where("least.lost > 0 or copies > 1"), "line-changes", keep=True)
    marked = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("its_id"), F.xxhash64("text").alias("its_hash"))
    joined = marked.join(listed, F.expr("its_id <=> l_id and its_hash = l_hash"), "left")
    worded = F.col("doc_.text").rlike("[^\\x20\\x09-\\x0D]")
    repeated = listed.where("copies > 1")
    if not repeated.isEmpty():
        copied = (F.coalesce("copies", F.lit(1)) > 1) & F.coalesce(worded, F.lit(False))
        joined = joined.where(~copied).unionByName(joined.where(copied).dropDuplicates(["its_id", "its_hash"]))
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*[F.col("doc_").getField(c).alias(c) for c in others], F.lit(None).cast("int").alias(unused(others, "none")))
    parts = joined.select(F.col("doc_.text").alias("text"), rest.alias("rest"), F.col("least.dropped").alias("dropped"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "text"):
            texts, stays = [], []
            for text, gone in zip(table.column("text").to_pylist(), table.column("dropped").to_pylist(), strict=True):
                if gone:
                    out = set(gone)
                    text = "\n".join([line for k, line in enumerate(text.split("\n")) if k not in out])
                    stays.append(bool(text.strip(" \t\n\r\x0b\x0c")))
                else:
                    stays.append(True)
                texts.append(text)
            place = table.schema.get_field_index("text")
            table = table.drop_columns(["dropped"]).set_column(place, table.schema.field(place), pa.array(texts, table.schema.field(place).type))
            yield from table.filter(pa.array(stays)).combine_chunks().to_batches()

    left = parts.mapInArrow(cut, parts.drop("dropped").schema)
    counted = {f.name: F.length("text").cast(f.dataType).alias(f.name) for f in docs.schema if f.name == "n_chars" and isinstance(f.dataType, NumericType)}
    return left.select(*[F.col(c) if c == "text" else counted.get(c, F.col("rest").getField(c).alias(c)) for c in docs.columns])
