import numpy as np
import pyarrow as pa

from routeforge.llm import line_dedup, similar_texts


def _holders(rows):
    """Ids of each key that several ids have."""
    held = {}
    for ids, keys in rows:
        share = len(keys) // len(ids) if ids else 0
        for k, key in enumerate(keys):
            held.setdefault(key, set()).add(ids[k // share])
    return sorted(sorted(ids) for ids in held.values() if len(ids) > 1)


def test_shared_keys_are_those_of_several_ids(spark):
    """Single and repeated ids, empty rows, and a key that every row has, over several slices and tasks."""
    rng = np.random.default_rng(5)
    rows = [([int(i), int(i) + 10_000], [-1, int(rng.integers(900)), int(rng.integers(10**12)), int(rng.integers(40)) - 20]) for i in rng.integers(0, 500, 700)]
    rows += [([], []), ([7], [3, 3]), ([8], []), ([9], [5]), ([9], [5])]
    table = spark.createDataFrame(rows, "ids array<long>, keys array<long>").repartition(4)
    found = {}
    for r in similar_texts.shared_keys(table).collect():
        found.setdefault(r.key, set()).add(r.id)
    assert sorted(sorted(ids) for ids in found.values()) == _holders(rows)


def test_keys_travel_once_as_packs(spark):
    """One shuffle of packs stands before the keys that are left; no row of a single key is exploded, counted or joined."""
    table = spark.createDataFrame([([1], [5, 6]), ([2], [6, 7])], "ids array<long>, keys array<long>")
    plan = similar_texts.shared_keys(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Join" not in plan and "HashAggregate" not in plan


def test_a_frequent_key_is_shared_among_tasks():
    """All but two rows of a key in a slice go out settled, over all buckets, in runs of one bucket."""
    pairs = np.stack([np.zeros(1000, np.uint64), np.arange(1000, dtype=np.uint64)], axis=1)
    rest = similar_texts._packed(pairs, np.arange(1000) * 8 // 1000, True)
    assert rest.column("bucket").to_pylist() == list(range(8))
    assert b"".join(rest.column("pack").to_pylist()) == pairs.tobytes()


def test_keys_of_lines_do_not_depend_on_blocks(monkeypatch):
    lines = pa.array(["x" * n + "äöü line %d of many" % n for n in range(200)])
    whole = line_dedup.line_keys(lines)
    monkeypatch.setattr(line_dedup, "BLOCK", 100)
    assert (line_dedup.line_keys(lines) == whole).all()
    assert len(line_dedup.line_keys(lines.slice(0, 0))) == 0
