import numpy as np
import pyarrow as pa
import pytest

from routeforge.llm import components, similar_texts
from routeforge.session import stage_table


def _smallest(links):
    """{id: smallest id that links reach}, by union-find in plain Python."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def _found(df):
    got = [(r.id, r.component) for r in df.collect()]
    assert len(got) == len(set(got))
    return dict(got)


def _links(spark, links):
    return spark.createDataFrame(links, "a long, b long")


@pytest.mark.parametrize("few", [0, 50_000])
def test_more_links_join_components(spark, monkeypatch, few):
    """Links within a component, between components, to new ids and among new ids only; with broadcast and shuffled rounds."""
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = np.random.default_rng(3)
    first = [(int(a), int(b)) for a, b in rng.integers(0, 300, (120, 2)) if a != b] + [(1000, 1001), (1001, 1002)]
    more = [(int(a), int(b)) for a, b in rng.integers(100, 500, (40, 2)) if a != b] + [(1002, 1000), (2000, 2001), (1001, -5)]
    found = stage_table(components.components(_links(spark, first)), "found")
    assert _found(found) == _smallest(first)
    assert _found(components.joined_components(found, _links(spark, more))) == _smallest(first + more)
    inside = _links(spark, [(1000, 1002)])
    assert _found(components.joined_components(found, inside)) == _smallest(first)


def test_links_are_contracted_once(spark, monkeypatch):
    """Rounds that find more links don't go through the links of earlier rounds again."""
    given = []
    real = components.components
    monkeypatch.setattr(similar_texts, "components", lambda links: given.append(links.count()) or real(links))
    # Each text shares a key with the next one; all share one key, of which the least id links with its neighbour only.
    texts = [(k, " ".join(f"{w:03d}" for w in range(k, k + 30))) for k in range(40)]
    table = spark.createDataFrame(texts, "id long, text string")
    members = spark.createDataFrame([([k], [7, 1000 + k, 1001 + k]) for k in range(40)], "ids array<long>, keys array<long>")

    def sets_of(values: pa.Array) -> similar_texts.Sets:
        words = [np.sort(np.array([int(w) for w in v.split()], np.uint64)) for v in values.to_pylist()]
        return similar_texts.Sets(np.concatenate([*words, np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, words)]))

    got = similar_texts.classes_by_keys(members, lambda ids: table.join(ids, "id"), sets_of, 90)
    assert _found(got) == dict.fromkeys(range(40), 0)
    assert len(given) == 1


def test_rows_go_to_python_in_bounded_batches(spark):
    """Rows of long texts and arrays come to a worker in batches of a few MB, not by thousands."""
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "sequence(id, id + 2000) AS keys")  # 16 kB each

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["size"])

    found = [r.size for r in stage_table(rows.mapInArrow(sizes, "size long"), "sizes").collect()]
    assert sum(found) > 40e6
    assert max(found) < 8e6
