"""Near duplicates by an LSH forest.

Documents are compared by their sets of word 5-shingles. A tree of the forest orders them by a string of MinHash values of its own;
two documents share a prefix of depth d in it with probability J ** d. Per tree all distinct sets are sorted by
their strings across the cluster, and one scan gives each its longest common prefix with its neighbours.

1. Neighbours that share a prefix of the level's depth or more are candidates: at most one pair per set and tree.
2. A region is what shares a prefix of that depth. Where all of its sets are in one component by now, it is settled. A region with few sets outside its
   largest component is settled by comparing these with those of other components.
3. A crowded region, with more of them, goes deeper: its sets get a forest of their own with a greater depth, in which what isn't similar parts sooner, and with
   as many more trees as that depth needs to find a pair at the threshold just as surely. Where the last level still finds
   a crowd, all its sets of different components are compared.

So depth follows the density of a region, no candidate is dropped, and the chance to miss a pair at the threshold is at most
MISS per level. Candidates are ruled out by sizes and parity sketches or confirmed on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeforge.llm.arrow_text import mix, slices, texts_of
from routeforge.llm.components import broadcast_if_small, components
from routeforge.llm.parity_join import shingle_sets
from routeforge.llm.similar_texts import Sets, confirm, may_link, parity_sketches, possible_links, send_pairs, with_sketch
from routeforge.session import stage_scope, stage_table

SHINGLE = 5
PERCENT = 85
#: Least depths of the levels; strings go on for MORE values, which order what shares a region.
DEPTHS = (4, 8, 12)
MORE = 4
MISS = 2e-4
#: Sets of a region outside its largest component up to which they are compared at once: so many sketches at most are held against one.
CROWD = 1024
SLICE = 2_000_000
_EMPTY = np.uint64(2**64 - 1)


def trees_for(depth: int, percent: int) -> int:
    """Trees in which a pair at the threshold shares a prefix of ``depth`` at least once, but for MISS."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** depth)))) if percent < 100 else 1


def strings(sets: Sets, trees: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Order strings of the sets that aren't empty, (sets, trees, 1 + depth) with the tree's number first, and their places.

    One-permutation MinHash: a set's hashes fall into trees * depth bins, and each bin keeps its least; an empty bin takes the value of
    the first filled one in an order that depends on the bin alone.
    """
    who = np.flatnonzero(sets.sizes > 0)
    bins = trees * depth
    place = np.repeat(np.arange(len(who)), sets.sizes[who])
    value = mix(sets.hashes, 4000 + seed)
    bin_, value = (value % np.uint64(bins)).astype(np.int64), value // np.uint64(bins)
    least = np.full(len(who) * bins, _EMPTY, np.uint64)
    np.minimum.at(least, place * bins + bin_, value)
    own = least.reshape(len(who), bins)
    table = own.copy()
    rows, at = np.nonzero(own == _EMPTY)
    step = 1
    while len(rows):
        other = (mix(at.astype(np.uint64), 500 + step) % np.uint64(bins)).astype(np.int64)
        lent = own[rows, other]
        filled = lent != _EMPTY
        table[rows[filled], at[filled]] = lent[filled]
        rows, at, step = rows[~filled], at[~filled], step + 1
    out = np.empty((len(who), trees, 1 + depth), ">u4")
    out[:, :, 0] = np.arange(trees)
    out[:, :, 1:] = mix(table).astype(np.uint32).reshape(len(who), trees, depth)
    return out, who


def _listed(made: np.ndarray, who: np.ndarray, n: int) -> pa.Array:
    """The strings of n sets as lists of binary values; sets without any have an empty list."""
    trees, width = made.shape[1], 4 * made.shape[2]
    each = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(who) * trees, [None, pa.py_buffer(np.ascontiguousarray(made))])
    counts = np.zeros(n, np.int64)
    counts[who] = trees
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), each.cast(pa.binary()))


FIRST = "doc_id long, text_hash long, n long, h1 long, h2 long, strings array<binary>"


def _first_level(docs: DataFrame, percent: int, width: int) -> DataFrame:
    trees, depth = trees_for(DEPTHS[0], percent), DEPTHS[0] + MORE

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "text", SLICE):
            sets = shingle_sets(texts_of(table), width)
            sums = []
            for seed in (21, 22):  # two sums of the set's hashes, equal for equal sets
                with np.errstate(over="ignore"):
                    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.hashes, seed), dtype=np.uint64)])
                    sums.append((running[sets.starts[1:]] - running[sets.starts[:-1]]).view(np.int64))
            made, who = strings(sets, trees, depth, 0)
            columns = [
                table.column("doc_id").combine_chunks(),
                table.column("text_hash").combine_chunks(),
                pa.array(sets.sizes, pa.int64()),
                *[pa.array(s) for s in sums],
                _listed(made, who, table.num_rows),
            ]
            yield pa.record_batch(columns, ["doc_id", "text_hash", "n", "h1", "h2", "strings"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(sign, FIRST)


def _later_level(texts: DataFrame, level: int, percent: int, width: int) -> DataFrame:
    trees, depth = trees_for(DEPTHS[level], percent), DEPTHS[level] + MORE

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "text", SLICE):
            made, who = strings(shingle_sets(texts_of(table), width), trees, depth, level)
            yield pa.record_batch([table.column("id").combine_chunks(), _listed(made, who, table.num_rows)], ["id", "strings"])

    return texts.select("id", "text").mapInArrow(sign, "id long, strings array<binary>").select("id", F.explode("strings").alias("string"))


def _prefixes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each string with its neighbour; -1 in different trees."""
    return np.cumprod(before == after, axis=1).sum(axis=1) - 1


def _neighbours(ordered: DataFrame, depth: int) -> DataFrame:
    """Per set and tree (part, first, last, id, string, before, common): the id before it in order and the length of their common
    prefix, in sorted partitions. Rows that share no prefix of ``depth`` with a neighbour are left out, but for the first and last of a partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None  # the last row so far, whose next neighbour isn't known, with what is known of it
        tail_before, tail_common, tail_first = 0, -1, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if tail is None else pa.concat_tables([tail, table])
            packed = table.column("string").combine_chunks()
            values = np.frombuffer(b"".join(packed.to_pylist()), ">u4").reshape(table.num_rows, -1)
            ids = table.column("id").to_numpy()
            common = np.concatenate([[tail_common], _prefixes(values[:-1], values[1:])])
            before = np.concatenate([[tail_before], ids[:-1]])
            first = np.zeros(len(ids), bool)
            first[0] = tail_first
            following = np.append(common[1:], -1)
            keep = (common >= depth) | (following >= depth) | first
            keep[-1] = False  # comes with the next batch
            yield _found(table, first, before, common, keep, False)
            tail, tail_before, tail_common = table.slice(table.num_rows - 1), int(before[-1]), int(common[-1])
            tail_first = bool(first[-1])
        if tail is not None:
            yield _found(tail, np.array([tail_first]), np.array([tail_before]), np.array([tail_common]), np.array([True]), True)

    schema = "part int, first boolean, last boolean, id long, string binary, before long, common int"
    return ordered.select("string", "id", F.spark_partition_id().alias("part")).mapInArrow(scan, schema)


def _found(table: pa.Table, first: np.ndarray, before: np.ndarray, common: np.ndarray, keep: np.ndarray, last: bool) -> pa.RecordBatch:
    at = pa.array(np.flatnonzero(keep))
    rows = table.take(at)
    columns = [
        rows.column("part").combine_chunks(),
        pa.array(first[keep]),
        pa.array(np.full(len(at), last)),
        rows.column("id").combine_chunks(),
        rows.column("string").combine_chunks(),
        pa.array(before[keep], pa.int64()),
        pa.array(common[keep], pa.int32()),
    ]
    return pa.record_batch(columns, ["part", "first", "last", "id", "string", "before", "common"])


def forest(rows: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """From (id, string) of all trees: the neighbours (a, b) that share a prefix of ``depth`` or more, and (region, id) of all
    sets that share their region with another. Both written."""
    ordered = rows.repartitionByRange("string", "id").sortWithinPartitions("string", "id")
    scanned = stage_table(_neighbours(ordered, depth), "forest-order")
    region = F.substring("string", 1, 4 * (1 + depth))
    # The last row of a partition and the first of the next one that has rows: two rows per partition.
    ends = scanned.where("first or last").select("part", "first", "last", "id", "string", "before")
    edges = Window.orderBy("part", F.col("last"))
    across = ends.select("id", region.alias("region"), F.lag("id").over(edges).alias("before"), F.lag(region).over(edges).alias("its_region"), "part", F.lag("part").over(edges).alias("its_part"))
    across = across.where("part <> its_part and region = its_region").select(F.col("before").alias("a"), F.col("id").alias("b"))
    pairs = scanned.where(F.col("common") >= depth).select(F.col("before").alias("a"), F.col("id").alias("b")).unionByName(across)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    places = scanned.select(F.xxhash64(region).alias("region"), "id")
    several = places.groupBy("region").agg(F.count("*").alias("held")).where("held > 1")
    return stage_table(pairs, "neighbours"), stage_table(places.join(several.select("region"), "region"), "regions")


def _classes(strings_: DataFrame, fetch, percent: int, width: int) -> DataFrame:
    """(id, component) of the sets linked with others, from the first level's (id, string)."""

    def sets_of(texts: pa.Array) -> Sets:
        return shingle_sets(texts, width)

    def linked(common: int, union: int) -> bool:
        return common > 0 and 100 * common >= percent * union

    texts = sketches = links = found = tested = None
    for level, depth in enumerate(DEPTHS):
        pairs, regions = forest(strings_, depth)
        if texts is None:
            texts = stage_table(fetch(stage_table(regions.select("id").distinct(), "candidate-ids")), "candidate-texts")
            sketches = stage_table(parity_sketches(texts, sets_of), "candidate-sketches")

        def confirmed(possible: DataFrame) -> DataFrame:
            possible = stage_table(possible, "possible-pairs")
            return stage_table(confirm(send_pairs(possible, texts), sets_of, linked), "links")

        def placed_in(regions: DataFrame) -> DataFrame:
            """The regions that hold several components: their sets with component, largest component (main) and how many are outside it."""
            known = regions.withColumn("component", F.col("id")) if found is None else regions.join(found, "id", "left")
            known = known.withColumn("component", F.coalesce("component", "id"))
            parts = known.groupBy("region", "component").agg(F.count("*").alias("held"))
            mains = parts.groupBy("region").agg(
                F.max_by("component", F.struct("held", "component")).alias("main"), (F.sum("held") - F.max("held")).alias("outside")
            )
            return known.join(mains.where("outside > 0"), "region")

        def joined(links: DataFrame | None, new: DataFrame) -> DataFrame:
            return new if links is None else links.unionByName(new)

        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        links = joined(links, confirmed(possible_links(pairs, sketches, percent)))
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = stage_table(components(links), "components")

        open_ = stage_table(placed_in(regions), "open-regions")
        few = open_ if level + 1 == len(DEPTHS) else open_.where(F.col("outside") <= CROWD)
        new = _across(few, sketches, percent).join(tested, ["a", "b"], "left_anti")
        links = joined(links, confirmed(possible_links(new, sketches, percent)))
        found = stage_table(components(links), "components")
        if level + 1 == len(DEPTHS):
            break
        crowded = placed_in(open_.where(F.col("outside") > CROWD).select("region", "id"))
        crowded = stage_table(crowded.select("id").distinct(), "crowded")
        if crowded.isEmpty():
            break
        strings_ = stage_table(_later_level(texts.join(crowded, "id"), level + 1, percent, width), "forest-strings")
    return found


def _across(placed: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a region's sets of different components that their sizes and sketches don't rule out, from (region, id, component,
    main). A pair has at least one member outside the region's largest component."""
    outside = placed.where("component <> main").select("region", F.col("id").alias("x"), F.col("component").alias("xc"))
    anyone = placed.select("region", F.col("id").alias("y"), F.col("component").alias("yc"))
    left, right = with_sketch(outside, sketches, "x", "x"), with_sketch(anyone, sketches, "y", "y")
    met = left.join(right, (left["region"] == right["region"]) & (F.col("xc") != F.col("yc")) & may_link("x", "y", percent))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id, the least doc_id that links reach.

    Documents link when 100 times the common shingles are at least ``percent`` times all; a text of fewer than ``width`` words is one
    shingle. Null and wordless texts have none and link with nothing: their component_id is their doc_id. Null doc_ids
    take part and count as the largest; rows of equal doc_id stay rows of their own. Columns beyond the two are not read; an empty table gives
    no rows. Sets are compared by 64-bit hashes of shingles.
    """
    rows = _first_level(docs, percent, width).withColumn("row", F.monotonically_increasing_id())
    rows = stage_table(rows, "signatures")  # the row numbers are fixed by writing them
    named = rows.where("n > 0")
    equal = named.groupBy("n", "h1", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    equal = stage_table(equal, "equal-sets")
    copies = named.select("row", "n", "h1", "h2").join(equal, ["n", "h1", "h2"]).where("row <> node").select("row")
    distinct = named.join(broadcast_if_small(stage_table(copies, "copies")), "row", "left_anti")

    def fetch(ids: DataFrame) -> DataFrame:
        needed = rows.select(F.col("row").alias("id"), "doc_id", "text_hash").join(broadcast_if_small(ids), "id")
        asked = needed.select("id", F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash"))
        asked = broadcast_if_small(stage_table(asked, "candidates"))
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
        same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash"))
        return source.join(asked, same).select("id", "text").dropDuplicates(["id"])

    with stage_scope(docs.sparkSession):
        found = _classes(distinct.select(F.col("row").alias("id"), F.explode("strings").alias("string")), fetch, percent, width)
        found = stage_table(found, "classes", keep=True)
    classes = equal.join(found, equal["node"] == found["id"], "left").withColumn("root", F.coalesce("component", "node"))
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stage_table(classes.join(roots, "root").select("n", "h1", "h2", "component_id"), "classes")
    joined = rows.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
