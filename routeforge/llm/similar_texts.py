"""Classes of a similarity relation among texts, found through shared keys and confirmed on whole sets.

Nothing is gathered in one task or on the driver: groups are reduced with map-side aggregates and joined back, so that a
key that holds a third of all rows is split like any other skewed join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeforge.llm.arrow_text import mix, slices, texts_of
from routeforge.llm.components import components, joined_components
from routeforge.session import stage_scope, stage_table

#: Pairs whose common member's text is sent once.
PAIRS_PER_TEXT = 256
#: 64-bit words of a candidate's parity sketch.
SKETCH_WORDS = 16
#: Sets of more elements have a long sketch as well, of at least a bit for each element: so many toggle all bits of a short one.
LONG_SETS = 500
#: Rounds in which the ids of a key are compared with few of them only, before the rest is compared: in the first, with the key's
#: least id; in later ones, with STAR_DRAWS ids drawn from the key's largest component. They end early when fewer than one pair
#: in STAR_YIELD is a link. All this settles only how much is found cheaply.
STAR_ROUNDS = 3
STAR_DRAWS = 4
STAR_YIELD = 10
SLICE = 2_000_000
#: Keys sorted at a time, and keys a task keeps (16 bytes each). They bound memory only.
KEYS_PER_SLICE = 250_000
KEYS_PER_TASK = 500_000


@dataclass
class Sets:
    """Distinct hashes of several texts, sorted within each: text i at starts[i]:starts[i+1]."""

    hashes: np.ndarray
    starts: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)


def sets_by_owner(hashes: np.ndarray, owner: np.ndarray, n: int) -> Sets:
    """The sets of n texts, given their elements' hashes in any order, with repeats, and the text each is in."""
    hashes = hashes[np.argsort(owner, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)
    # Sorting each text's run in place is ten times faster than sorting all by (owner, hash).
    for first, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        hashes[first:end].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[starts[:-1][np.diff(starts) > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)]).astype(np.int64)
    return Sets(hashes[new], kept[starts])


SetsOf = Callable[[pa.Array], Sets]


def send_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts (id, text) of ``pairs`` (a, b) side by side: rows (a, salt, b, text), a's own text first (b null).

    A common member's text goes out once per PAIRS_PER_TEXT pairs, and each such bundle is a group of its own.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_TEXT).alias("salts"))
    salted = stage_table(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt")), "salted-pairs")
    heads = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a"), "a")
    tails = salted.join(texts.withColumnRenamed("id", "b"), "b")
    rows = heads.select("a", "salt", F.lit(None).cast("long").alias("b"), "text").union(tails.select("a", "salt", "b", "text"))
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())


def confirm(sent: DataFrame, sets_of, links) -> DataFrame:
    """The pairs (a, b) of :func:`send_pairs` for which ``links`` holds of their sets, as ``sets_of`` makes them from texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for table in slices(batches, "text", SLICE):
            sets = sets_of(texts_of(table))
            a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
            out = []
            for k, other in enumerate(b):
                mine = sets.hashes[sets.starts[k] : sets.starts[k + 1]]
                if other is None:
                    head = mine
                    continue
                at = np.minimum(np.searchsorted(head, mine), max(len(head) - 1, 0))
                common = int((head[at] == mine).sum()) if len(head) and len(mine) else 0
                if links(common, len(head) + len(mine) - common):
                    out.append((a[k], other))
            yield pa.record_batch([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return sent.mapInArrow(check, "a long, b long")


def parity_sketches(texts: DataFrame, sets_of: SetsOf) -> DataFrame:
    """(id, n, s0, s1, ..., long) of texts (id, text): the set's size, and a bit sketch in which each element toggles one bit. ``long`` is a sketch of
    a power of two of bits, as many as elements or more; null for sets of up to LONG_SETS.

    Two sketches of equal length differ in at most as many bits as the symmetric difference has elements.
    """
    words = [f"s{k}" for k in range(SKETCH_WORDS)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "text", SLICE):
            sets = sets_of(texts_of(table))
            bits = mix(sets.hashes, 333) % np.uint64(64 * SKETCH_WORDS)
            owner = np.repeat(np.arange(table.num_rows), sets.sizes)
            made = np.zeros(table.num_rows * SKETCH_WORDS, np.uint64)
            place = owner * SKETCH_WORDS + (bits // np.uint64(64)).astype(np.int64)
            np.bitwise_xor.at(made, place, np.uint64(1) << (bits % np.uint64(64)))
            made = made.reshape(-1, SKETCH_WORDS).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(made[:, k])) for k in range(SKETCH_WORDS)]
            long_ = pa.array([_long_sketch(sets.hashes[a:b]) for a, b in zip(sets.starts[:-1].tolist(), sets.starts[1:].tolist(), strict=True)], pa.list_(pa.int64()))
            yield pa.record_batch([table.column("id").combine_chunks(), pa.array(sets.sizes, pa.int64()), *columns, long_], ["id", "n", *words, "long"])

    return texts.select("id", "text").mapInArrow(sketch, "id long, n long, " + ", ".join(f"{w} long" for w in words) + ", long array<long>")


def _long_sketch(hashes: np.ndarray) -> np.ndarray | None:
    if len(hashes) <= LONG_SETS:
        return None
    bits = 64 << max(0, int(len(hashes) - 1).bit_length() - 6)
    odd = np.bincount((mix(hashes, 334) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _long_difference(x: str, y: str) -> str:
    """SQL of the number of bits in which two long sketches differ. The longer one is folded to the length of the other, which toggles
    each bit as a sketch of that length would."""
    words = f"least(size({x}), size({y}))"

    def folded(v: str) -> str:
        turns = f"sequence(0, size({v}) div {words} - 1)"
        each = f"transform(sequence(0, {words} - 1), i -> aggregate({turns}, 0L, (s, j) -> s ^ {v}[CAST(i + j * {words} AS int)]))"
        return f"if(size({v}) = {words}, {v}, {each})"

    return f"aggregate(zip_with({folded(x)}, {folded(y)}, (a, b) -> bit_count(a ^ b)), 0L, (s, v) -> s + v)"


def may_link(x: str, y: str, percent: int) -> Column:
    """What sizes and sketches (columns with prefixes x and y) of linked sets always fulfil."""
    low, high = F.least(f"{x}n", f"{y}n"), F.greatest(f"{x}n", f"{y}n")
    differ = sum((F.bit_count(F.col(f"{x}s{k}").bitwiseXOR(F.col(f"{y}s{k}"))) for k in range(SKETCH_WORDS)), F.lit(0))
    return (100 * low >= percent * high) & ((100 + percent) * differ <= (100 - percent) * (low + high))


def with_sketch(table: DataFrame, sketches: DataFrame, name: str, prefix: str) -> DataFrame:
    """``table`` with the size and short sketch of the id in column ``name``, under names with ``prefix``."""
    fresh = [F.col("id").alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in sketches.columns if c not in ("id", "long")]]
    return table.join(sketches.select(*fresh), name)


def possible_links(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't rule out."""
    both = with_sketch(with_sketch(pairs, sketches, "a", "x"), sketches, "b", "y").where(may_link("x", "y", percent))
    left = stage_table(both.select("a", "b", (F.col("xn") + F.col("yn")).alias("sizes"), F.least("xn", "yn").alias("least")), "sketched-pairs")
    large = left.where(F.col("least") > LONG_SETS)
    for name, side in (("a", "xlong"), ("b", "ylong")):
        large = large.join(sketches.select(F.col("id").alias(name), F.col("long").alias(side)), name)
    near = large.where(f"{100 + percent} * {_long_difference('xlong', 'ylong')} <= {100 - percent} * sizes")
    return left.where(F.col("least") <= LONG_SETS).select("a", "b").unionByName(near.select("a", "b"))


def _pairs(batch: pa.RecordBatch) -> np.ndarray:
    """Rows (key, id) of a batch of (ids, keys), in which each id has an equal share of its row's keys, in order. Keys are mixed, so that
    they are spread evenly; only their last bit stays."""
    ids, keys = batch.column("ids"), batch.column("keys")
    n_ids, n_keys = (pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (ids, keys))
    flat_ids, flat_keys = (c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (ids, keys))
    share = np.repeat(n_keys // np.maximum(n_ids, 1), n_ids)
    mixed = (mix(flat_keys, 335) & ~np.uint64(1)) | (flat_keys & np.uint64(1))
    return np.stack([mixed, np.repeat(flat_ids, share)], axis=1)


def _by_key(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pairs`` in the order of their keys, and where each key starts."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] != pairs[:-1, 0]
    return pairs, np.flatnonzero(new)


def _packed(pairs: np.ndarray, buckets: np.ndarray, settled: bool) -> pa.RecordBatch:
    """One row (bucket, settled, pack) for each run of equal ``buckets``."""
    new = np.ones(len(buckets), bool)
    new[1:] = buckets[1:] != buckets[:-1]
    starts = np.flatnonzero(new)
    ends = pa.array(np.append(starts, len(pairs)) * 16, pa.int32())
    packs = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(pairs))])
    return pa.record_batch([pa.array(buckets[starts], pa.int32()), pa.array(np.full(len(starts), settled)), packs], ["bucket", "settled", "pack"])


def _in_planes(packed: pa.RecordBatch) -> pa.RecordBatch:
    """``packed`` with the first bytes of all pairs of a pack before the second ones, and so on: most bytes of sorted keys and of ids are alike, so
    a pack travels in little more than half its size."""
    packs = [np.frombuffer(p, np.uint8).reshape(-1, 16).T.tobytes() for p in packed.column("pack").to_pylist()]
    return pa.record_batch([packed.column("bucket"), packed.column("settled"), pa.array(packs, pa.binary())], ["bucket", "settled", "pack"])


def _from_planes(packs: list[bytes]) -> np.ndarray:
    """The rows (key, id) of packs in planes."""
    rows = [np.frombuffer(p, np.uint8).reshape(16, -1).T for p in packs]
    return np.ascontiguousarray(np.concatenate([np.zeros((0, 16), np.uint8), *rows])).view(np.uint64)


def shared_keys(members: DataFrame) -> DataFrame:
    """(key, id) of the keys of ``members`` (ids, keys) that more than one id has; rows may repeat.

    Most keys have one id only, so keys travel once, packed by key range. A pack's task has each of its keys' first id and lets the others
    through as they come. A key that several ids of one slice share is known to be shared there: only two of its ids
    go to the key's own task, and the others to any task, so that no task gets all rows of a frequent key.
    """
    rows = members.agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    buckets = max(rows // KEYS_PER_TASK + 1, members.sparkSession.sparkContext.defaultParallelism)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered((_pairs(b) for b in batches), KEYS_PER_SLICE):
            pairs, starts = _by_key(part)
            sizes = np.diff(np.append(starts, len(pairs)))
            group = np.repeat(np.arange(len(starts)), sizes)
            other = pairs[:, 1] != pairs[starts, 1][group]
            first_other = np.zeros(len(pairs), bool)
            places = np.flatnonzero(other)
            first_other[places[np.unique(group[places], return_index=True)[1]]] = True
            rest = pairs[other & ~first_other]
            first_other[starts] = True
            sent = pairs[first_other]
            yield _in_planes(_packed(sent, ((sent[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32), False))
            if len(rest):
                yield _in_planes(_packed(rest, np.arange(len(rest), dtype=np.int64) * buckets // len(rest), True))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros((0, 2), np.uint64)  # keys met, in order, each with its first id
        told = np.zeros(0, bool)  # whether that id was given out

        def given(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["key", "id"])

        def unpacked(batch: pa.RecordBatch, settled: bool) -> np.ndarray:
            return _from_planes(batch.filter(pc.equal(batch.column("settled"), settled)).column("pack").to_pylist())

        def open_pairs() -> Iterator[np.ndarray]:
            for batch in batches:
                ready.append(unpacked(batch, True))
                yield unpacked(batch, False)

        ready: list[np.ndarray] = []
        for part in _gathered(open_pairs(), KEYS_PER_SLICE):
            while ready:
                yield given(ready.pop())
            pairs, starts = _by_key(part)
            keys = pairs[starts]
            at = np.searchsorted(known[:, 0], keys[:, 0])
            old = np.zeros(len(keys), bool)
            inside = at < len(known)
            old[inside] = known[at[inside], 0] == keys[inside, 0]
            first = keys[:, 1].copy()
            first[old] = known[at[old], 1]
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pairs))))
            other = pairs[:, 1] != first[group]
            shared = np.zeros(len(keys), bool)
            shared[group[other]] = True
            untold = shared.copy()
            untold[old] &= ~told[at[old]]
            yield given(np.concatenate([pairs[other], np.stack([keys[untold, 0], first[untold]], axis=1)]))
            told[at[old & shared]] = True
            known = np.concatenate([known, np.stack([keys[~old, 0], first[~old]], axis=1)])
            told = np.concatenate([told, shared[~old]])
            order = np.argsort(known[:, 0], kind="stable")
            known, told = known[order], told[order]
        while ready:
            yield given(ready.pop())

    packs = members.select("ids", "keys").mapInArrow(pack, "bucket int, settled boolean, pack binary")
    return packs.repartition(buckets, "bucket").mapInArrow(several, "key long, id long")


def _gathered(parts: Iterator[np.ndarray], limit: int) -> Iterator[np.ndarray]:
    """The rows of ``parts``, about ``limit`` at a time."""
    held: list[np.ndarray] = []
    for part in parts:
        for at in range(0, len(part), limit):
            held.append(part[at : at + limit])
            if sum(map(len, held)) >= limit:
                yield np.concatenate(held)
                held = []
    if held:
        yield np.concatenate(held)


def _promising(shared: DataFrame, needs: DataFrame) -> DataFrame:
    """The rows (key, id) of ``shared`` through which linked ids still meet, if ids that link through keys of one kind (last bit of the key) have as many of
    these in common as ``needs`` (id, even, odd) says of each; rows may repeat.

    An id with fewer shared keys of a kind loses them. Of the others all but the most frequent ones are kept, one fewer than it needs: in an order of all keys
    the first one that linked ids have in common is among the kept ones of each.
    """
    odd = F.col("key").bitwiseAND(1) == 1
    held = shared.groupBy("id").agg(F.count_if(~odd).alias("evens"), F.count_if(odd).alias("odds")).join(needs, "id")
    enough = held.where("evens >= even or odds >= odd").select("id", *[F.when(F.col(f"{k}s") >= F.col(k), F.col(k)).alias(k) for k in ("even", "odd")])
    enough = stage_table(enough, "promising-ids")
    live = shared.join(enough, "id").select("key", "id", F.when(odd, F.col("odd")).otherwise(F.col("even")).alias("least")).where("least is not null")
    live = stage_table(live, "promising-keys")
    live = live.join(live.groupBy("key").agg(F.count("*").alias("ids")).where("ids > 1"), "key")
    kind = Window.partitionBy("id", odd)  # at most one text's keys
    place = F.row_number().over(kind.orderBy(F.col("ids").desc(), F.col("key").desc()))
    return live.withColumn("place", place).where("place >= least").select("key", "id")


def classes_by_keys(
    members: DataFrame, fetch: Callable[[DataFrame], DataFrame], sets_of: SetsOf, percent: int, needs: DataFrame | None = None
) -> DataFrame:
    """(id, component) over the pairs of ``members`` (ids, keys: arrays in which each id has an equal share of the keys, in order;
    ids may repeat) that share a key and whose sets have a Jaccard similarity of ``percent`` or more. ``fetch`` gives the texts (id, text) of a table of ids, and ``sets_of`` their sets.

    Every pair that shares a key is either ruled out by its sizes or sketches, or verified, or lies in one component already, so
    no component is split. ``needs`` (id, even, odd), if given, tells how many keys with an even and how many with an odd number an id has
    at least in common with any that it links to through such keys:

    1. In a few rounds, a key's ids outside its largest component (at first, all) are compared with few of them: the least, then some
       drawn from the largest component.
    2. Where a key then still holds several components, the ids outside the largest are compared with those of other components.
    """
    with stage_scope(members.sparkSession):
        return stage_table(_classes(members, fetch, sets_of, percent, needs), "classes", keep=True)


def _classes(members: DataFrame, fetch: Callable[[DataFrame], DataFrame], sets_of: SetsOf, percent: int, needs: DataFrame | None) -> DataFrame:
    live = shared_keys(members)
    if needs is not None:
        live = _promising(stage_table(live, "shared-keys"), needs)
    live = stage_table(live.distinct(), "live-keys")
    texts = stage_table(fetch(stage_table(live.select("id").distinct(), "candidate-ids")), "candidate-texts")
    sketches = stage_table(parity_sketches(texts, sets_of), "candidate-sketches")

    def links_of(pairs: DataFrame) -> DataFrame:
        possible = stage_table(pairs, "possible-pairs")
        return stage_table(
            confirm(
                send_pairs(possible, texts), sets_of, lambda common, union: common > 0 and 100 * common >= percent * union
            ),
            "links",
        )

    tested: DataFrame | None = None
    found = placed = None
    outside = live
    for turn in range(STAR_ROUNDS):
        if turn:
            draws = [F.min_by("id", F.xxhash64("id", F.lit(STAR_DRAWS * turn + k))) for k in range(STAR_DRAWS)]
            drawn = placed.where("component = main").groupBy("key").agg(F.array_distinct(F.array(*draws)).alias("drawn"))
            pairs = outside.join(drawn, "key").select(F.explode("drawn").alias("a"), F.col("id").alias("b"))
        else:
            pivots = outside.groupBy("key").agg(F.min("id").alias("a"))
            pairs = outside.join(pivots, "key").where("id <> a").select("a", F.col("id").alias("b"))
        pairs = pairs.distinct().withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
        if tested is not None:
            pairs = pairs.join(tested, ["lo", "hi"], "left_anti")
        pairs = stage_table(pairs, "pairs")
        tested = pairs.select("lo", "hi") if tested is None else tested.union(pairs.select("lo", "hi"))
        new = links_of(possible_links(pairs, sketches, percent))
        n_new = new.count()
        if found is None or n_new:
            found = stage_table(components(new) if found is None else joined_components(found, new), "components")
            placed = live.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
            sizes = placed.groupBy("key", "component").agg(F.count("*").alias("held"))
            main = sizes.groupBy("key").agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.count("*").alias("parts"), F.sum("held").alias("ids"))
            # A key of two ids is settled by its one pair.
            main = main.where("parts > 1 and ids > 2").select("key", "main")
            placed = stage_table(placed.join(main, "key"), "open-keys")
            live = placed.select("key", "id")  # components only grow, so a settled key stays settled
            outside = placed.where("component <> main").select("key", "id")
        if STAR_YIELD * n_new <= pairs.count():
            break

    left = with_sketch(placed.where("component <> main").select("key", F.col("id").alias("x"), F.col("component").alias("xc")), sketches, "x", "x")
    right = with_sketch(placed.select("key", F.col("id").alias("y"), F.col("component").alias("yc")), sketches, "y", "y")
    condition = (left["key"] == right["key"]) & (F.col("xc") != F.col("yc")) & may_link("x", "y", percent)
    rest = left.join(right, condition).select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()
    rest = rest.join(tested, ["lo", "hi"], "left_anti").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    new = links_of(possible_links(rest, sketches, percent))
    return found if new.isEmpty() else joined_components(found, new)
