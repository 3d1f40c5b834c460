"""Keys that unlinked documents share by chance are left out before anything is compared."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routeforge.llm import decision_list, parity_join, similar_texts
from routeforge.llm.parity_join import Sets


def _sets(lists):
    lists = [np.unique(x) for x in lists]
    return lists, Sets(np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])]))


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_as_many_keys_as_they_need(percent):
    rng = np.random.default_rng(4)
    linked = 0
    for size in (1, 2, 5, 9, 20, 39, 40, 41, 100, 400, 3000):
        for share in (0.0, 0.03, 0.06, 0.1, 0.12, 0.2):
            base = rng.integers(1, 2**63, size).astype(np.uint64)
            fresh = rng.integers(1, 2**63, int(size * share)).astype(np.uint64)
            lists, sets = _sets([base, base[int(size * share) :], np.concatenate([base[len(fresh) // 2 :], fresh[: len(fresh) // 2]]), np.concatenate([base, fresh])])
            keys, owner, needs = parity_join.sketches_of(sets, percent)
            by = [set(keys[owner == k].tolist()) for k in range(4)]
            for k in (1, 2, 3):
                common = len(np.intersect1d(lists[0], lists[k]))
                if len(lists[k]) and 100 * common >= percent * (len(lists[0]) + len(lists[k]) - common):
                    linked += 1
                    both = by[0] & by[k]
                    shared = [sum(x % 2 == kind for x in both) for kind in (0, 1)]
                    assert any(shared[kind] >= max(needs[0, kind], needs[k, kind]) for kind in (0, 1)), (size, share, k)
    assert linked > 60


def test_chance_keys_go_and_keys_of_links_stay(spark):
    """Texts of a few common phrases share many keys by chance; of those only linked texts are looked at."""
    rng = np.random.default_rng(6)
    phrases = rng.integers(1, 2**63, (300, 2)).astype(np.uint64)
    lists = [np.concatenate([rng.integers(1, 2**63, 180).astype(np.uint64), phrases[rng.integers(0, 300, 20)].ravel()]) for _ in range(400)]
    lists += [np.concatenate([x[4:], rng.integers(1, 2**63, 3).astype(np.uint64)]) for x in lists[:5]]
    _, sets = _sets(lists)
    keys, owner, needs = parity_join.sketches_of(sets, 80)
    rows = [([k], keys[owner == k].view(np.int64).tolist()) for k in range(len(lists))]
    shared = similar_texts.shared_keys(spark.createDataFrame(rows, "ids array<long>, keys array<long>").repartition(4))
    asked = spark.createDataFrame([(k, *map(int, needs[k])) for k in range(len(lists))], "id long, even int, odd int")
    kept = {}
    for r in similar_texts._promising(shared, asked).collect():
        kept.setdefault(r.key, set()).add(r.id)
    assert shared.select("id").distinct().count() > 300
    assert len(set().union(*kept.values())) < 40
    for k in range(5):
        assert any({k, 400 + k} <= ids for ids in kept.values())


def test_packs_travel_in_planes():
    keys = np.sort(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64))
    pairs = np.stack([keys, np.arange(5000, dtype=np.uint64) % 900], axis=1)
    packed = similar_texts._packed(pairs, np.arange(5000) * 3 // 5000, False)
    sent = similar_texts._in_planes(packed)
    assert (similar_texts._from_planes(sent.column("pack").to_pylist()) == pairs).all()
    assert similar_texts._from_planes([]).shape == (0, 2)

    def compressed(batch):
        return sum(len(pa.compress(p, "lz4_raw", asbytes=True)) for p in batch.column("pack").to_pylist())

    assert compressed(sent) < 0.75 * compressed(packed)


def test_texts_are_not_written_to_be_judged(spark, monkeypatch):
    """Only counts are staged, whatever columns are kept; the verdicts are those of a judgement without texts."""
    staged = []
    stage_table = decision_list.stage_table
    monkeypatch.setattr(decision_list, "stage_table", lambda df, name: staged.append(df.columns) or stage_table(df, name))
    text = F.concat_ws(" ", F.expr("transform(sequence(1, 5 + id % 40), i -> concat('w', i * (id % 3 + 1) % 17))"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 > 0, text).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    whole = decision_list.judge_quality(docs, labels, keep=("doc_id", "text"))
    plain = decision_list.judge_quality(docs, labels)
    assert staged and not any("text" in columns for columns in staged)
    assert sorted(map(tuple, whole.drop("text").collect())) == sorted(map(tuple, plain.collect()))
    assert whole.select("doc_id", "text").exceptAll(docs).isEmpty() and whole.count() == 300
