"""Token-id files: raw id payloads, and a minimal perfect hash index from document keys to their ids.

A shard is two files. ``*.ids`` holds nothing but the ids, little-endian, two bytes each where the
vocabulary allows it and four otherwise. ``*.index`` holds the documents' keys and offsets in order,
and a minimal perfect hash over the distinct keys: levels of bit arrays, where a key belongs to the
first level in which no other remaining key shares its position, and its slot is the number of bits
set before it. A slot keeps a 32-bit fingerprint of its key, so that a key that is not in the shard is
told apart, and the place of the key's first document. A lookup reads one bit per level, one
fingerprint and one offset, whatever the size of the shard.

Tasks write straight to the shared folder through ``pyarrow.fs`` under names of their own attempt;
the manifest, a Parquet table that Spark commits, names the files that count. A lost or repeated
task leaves at most an orphan file, never a second copy in the manifest.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeforge.llm.arrow_text import mix, slices, texts_of
from routeforge.llm.library_bpe import encoder_for
from routeforge.session import scratch_folder, stage_table

#: Ids in one file before the task starts the next one.
SHARD_IDS = 32_000_000
#: Bits per remaining key in a level of the hash.
SPACE = 2.0
MANIFEST = "part int, piece int, ids_path string, index_path string, n_docs long, n_ids long, width int"


def _key_hashes(keys: np.ndarray, is_null: np.ndarray) -> np.ndarray:
    """Null is a key of its own, apart from 0."""
    hashes = mix(keys.astype(np.int64).view(np.uint64))
    hashes[is_null] = mix(np.zeros(1, np.uint64), 77)[0]
    return hashes


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit key hashes."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray, fingerprints: np.ndarray):
        self.levels, self.rest, self.fingerprints = levels, rest, fingerprints
        self.bits = [np.unpackbits(bits) for bits in levels]
        counts = [int(b.sum()) for b in self.bits]
        self.bases = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.ranks = [np.cumsum(b, dtype=np.int64) - b for b in self.bits]

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, remaining = [], hashes
        while len(remaining) and len(levels) < 40:
            size = -(-int(SPACE * len(remaining) + 8) // 8) * 8
            at = (mix(remaining, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            remaining = remaining[~alone[at]]
        made = cls(levels, np.sort(remaining), np.zeros(0, np.uint32))
        made.fingerprints = np.zeros(len(hashes), np.uint32)
        made.fingerprints[made._slots(hashes)] = made._prints(hashes)
        return made

    @staticmethod
    def _prints(hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes, 101) >> np.uint64(32)).astype(np.uint32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        slots = np.full(len(hashes), -1, np.int64)
        for k, bits in enumerate(self.bits):
            open_ = np.flatnonzero(slots < 0)
            if not len(open_):
                return slots
            at = (mix(hashes[open_], k + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            slots[open_[hit]] = self.bases[k] + self.ranks[k][at[hit]]
        if len(self.rest):  # keys that 40 levels did not part, if any
            open_ = np.flatnonzero(slots < 0)
            at = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            hit = self.rest[at] == hashes[open_]
            slots[open_[hit]] = self.bases[-1] + at[hit]
        return slots

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a key whose fingerprint is not the one stored."""
        slots = self._slots(hashes)
        found = slots >= 0
        found[found] = self.fingerprints[slots[found]] == self._prints(hashes[found])
        return np.where(found, slots, -1)


def _dump(parts: dict[str, np.ndarray], extra: dict) -> bytes:
    out = io.BytesIO()
    head = json.dumps(
        extra | {"arrays": [[n, a.dtype.str, len(a)] for n, a in parts.items()]}, sort_keys=True
    ).encode()
    out.write(b"RFIX\x01" + len(head).to_bytes(4, "little") + head)
    for a in parts.values():
        out.write(a.tobytes())
    return out.getvalue()


def _load(data: bytes) -> tuple[dict[str, np.ndarray], dict]:
    if data[:5] != b"RFIX\x01":
        raise ValueError("not an index file of this format")
    at = 9 + int.from_bytes(data[5:9], "little")
    head, parts = json.loads(data[9:at]), {}
    for name, kind, n in head["arrays"]:
        parts[name] = np.frombuffer(data, kind, n, at)
        at += parts[name].nbytes
    return parts, head


class Shard:
    """Read access to one shard: ids by place, or by key in constant time."""

    def __init__(self, ids: bytes, index: bytes):
        self.parts, self.head = _load(index)
        self.ids = np.frombuffer(ids, f"<u{self.head['width']}")
        self.starts = self.parts["starts"]
        self.hash = PerfectHash(
            [self.parts[f"level{k}"] for k in range(self.head["levels"])],
            self.parts["rest"],
            self.parts["fingerprints"],
        )

    @classmethod
    def open(cls, ids_path: str, index_path: str) -> Shard:
        return cls(_read(ids_path), _read(index_path))

    def places(self, keys: list[int | None]) -> list[list[int]]:
        """Places of each key's documents, found through the hash."""
        missing = np.array([k is None for k in keys], bool)
        values = np.array([0 if k is None else k for k in keys], np.int64)
        slots = self.hash.lookup(_key_hashes(values, missing))
        first, count = self.parts["first"], self.parts["count"]
        return [[] if s < 0 else list(range(int(first[s]), int(first[s]) + int(count[s]))) for s in slots]

    def document(self, place: int) -> np.ndarray:
        return self.ids[int(self.starts[place]) : int(self.starts[place + 1])].astype("<u4")


def build_index(keys: np.ndarray, is_null: np.ndarray, starts: np.ndarray, width: int) -> bytes:
    """Keys in order, equal keys next to each other."""
    hashes = _key_hashes(keys, is_null)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (is_null[1:] != is_null[:-1])
    firsts = np.flatnonzero(new)
    table = PerfectHash.build(hashes[firsts])
    slots = table.lookup(hashes[firsts])
    first, count = np.zeros(len(firsts), np.int64), np.zeros(len(firsts), np.int64)
    first[slots] = firsts
    count[slots] = np.diff(np.append(firsts, len(keys)))
    parts = {"keys": keys.astype("<i8"), "nulls": is_null.astype("u1"), "starts": starts.astype("<i8")}
    parts |= {f"level{k}": bits for k, bits in enumerate(table.levels)}
    parts |= {"rest": table.rest, "fingerprints": table.fingerprints, "first": first, "count": count}
    return _dump(parts, {"levels": len(table.levels), "width": width})


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _read(path: str) -> bytes:
    system, place = _open_folder(path)
    with system.open_input_stream(place) as file:
        return file.read()


def write_token_files(
    docs: DataFrame, spec: str, end_id: int | None, folder: str | None = None, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each, write files in ascending doc_id order.

    Returns the manifest, one row per shard. Null text is empty; rows with a null doc_id come first;
    rows with equal doc_id stay apart, ordered by a hash of their text; columns besides the two are not read. An
    empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_folder(spark)}/token-files-{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(spec)  # one vocabulary file, of fixed size

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value)
        highest = max(encoder.tokenizer.get_vocab_size() - 1, end_id or 0)
        width = 2 if highest < 65_536 else 4
        system, place = _open_folder(folder)
        system.create_dir(place, recursive=True)
        task = TaskContext.get()
        ids: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        piece = held = 0

        def flush() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            name = f"{task.partitionId():06d}-{piece:04d}-{task.taskAttemptId()}"
            with system.open_output_stream(f"{place}/{name}.ids") as file:
                for part in ids:
                    file.write(part.tobytes())
            with system.open_output_stream(f"{place}/{name}.index") as file:
                file.write(build_index(np.concatenate(keys), np.concatenate(nulls), starts, width))
            row = (task.partitionId(), piece, f"{folder}/{name}.ids", f"{folder}/{name}.index", len(starts) - 1, int(starts[-1]), width)
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for table in slices(batches, "text"):
            found = encoder.encode(texts_of(table))
            counts = np.diff(found.starts)
            if end_id is None:
                joined = found.ids
            else:
                joined = np.insert(found.ids, found.starts[1:], end_id)
                counts = counts + 1
            column = table.column("doc_id").combine_chunks()
            missing = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
            ids.append(joined.astype(f"<u{width}"))
            sizes.append(counts)
            nulls.append(missing)
            keys.append(np.asarray(column.fill_null(0).to_numpy(zero_copy_only=False), np.int64))
            held += len(joined)
            if held >= shard_ids:
                yield flush()
                ids, keys, nulls, sizes, held = [], [], [], [], 0
                piece += 1
        if keys:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage_table(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    Documents are found by key through each shard's hash, and their ids are read at the offset stored there.
    """
    earlier = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, place long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.open(row["ids_path"], row["index_path"])
                keys, nulls = shard.parts["keys"], shard.parts["nulls"].astype(bool)
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
                asked = [None if nulls[i] else int(keys[i]) for i in np.flatnonzero(new)]
                out: list[tuple] = []
                for key, places in zip(asked, shard.places(asked), strict=True):
                    for p in places:
                        ids = shard.document(p)
                        start = row["base"] + int(shard.starts[p])
                        out.append((key, start, len(ids), zlib.crc32(ids.tobytes()), p))
                columns = list(zip(*out, strict=True))
                yield pa.record_batch(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32", "place"]
                )

    spread = shards.repartition(spark.sparkContext.defaultParallelism * 4, "ids_path")
    return spread.mapInArrow(read, schema).drop("place")
