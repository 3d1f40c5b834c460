"""Main texts of pages: boosted trees over the features of DOM elements, decoded along the tree.

The trees are learned from pages that mark their main part explicitly (article or main, without the menus, notices and the like inside it). Each labelled
element is learned four times, with the explicit markup, the kind of element, both or nothing hidden, so that pages without it are judged by
density, place and siblings; and every page is learned again with asides of all known kinds planted between its paragraphs, as few pages have
them there. Spark trains the trees on a bounded sample of pages; every page is then parsed, scored and decoded
in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeforge.llm.arrow_text import slices
from routeforge.llm.dom import EXPLICIT, FEATURES, KINDS, Page, decode, explicit_labels, features, main_text, with_asides
from routeforge.session import stage_table

#: Different pages that the trees are learned from at most: those with the least hashes. All of their elements count.
TRAINING_PAGES = 1_000
ROUNDS, DEPTH, STEP = 12, 4, 0.3
#: Log-odds beyond this count as this.
CLIP = 4.0
SLICE = 2_000_000


@dataclass
class Trees:
    """Boosted trees as flat arrays: feature (-1 at a leaf), threshold, children and value by node; roots and weights by tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, model: GBTClassificationModel) -> Trees:
        """The nodes of a trained model: at most ROUNDS trees of depth DEPTH."""
        rows: list[list] = []
        roots = []

        def add(node) -> int:
            k = len(rows)
            rows.append([-1, 0.0, k, k, float(node.prediction())])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[k][:2] = [split.featureIndex(), float(split.threshold())]
                rows[k][2] = add(node.leftChild())
                rows[k][3] = add(node.rightChild())
            return k

        for tree in model.trees:
            roots.append(add(tree._java_obj.rootNode()))
        columns = list(zip(*rows, strict=True))
        kinds = (np.int64, float, np.int64, np.int64, float)
        return cls(*[np.array(c, t) for c, t in zip(columns, kinds, strict=True)], np.array(roots), np.array(model.treeWeights))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                inner = self.feature[at] >= 0
                low = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
            out += weight * self.value[at]
        return 2 * out


def training_elements(pages: DataFrame, most_pages: int = TRAINING_PAGES) -> DataFrame:
    """FEATURES and label of the elements with text of sampled pages, as they are and with planted asides, and of both with explicit markup,
    kinds of element and both hidden. The sample depends on the pages alone, not on how they are stored; equal pages count once."""
    hashed = pages.select(F.xxhash64("page_id", "url", "html").alias("hash"), "html")
    least = hashed.select("hash").distinct().orderBy("hash").limit(most_pages)
    cut = least.agg(F.max("hash")).first()[0]
    sample = hashed.where(F.col("hash") <= F.lit(cut)).dropDuplicates(["hash"])
    hidden = [[FEATURES.index(f) for f in group] for group in (EXPLICIT, KINDS, (*EXPLICIT, *KINDS))]
    names = [*FEATURES, "label"]

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "html", SLICE):
            numbers = [h % 1_000_003 for h in table.column("hash").to_pylist()]
            htmls = [h or "" for h in table.column("html").to_pylist()]
            for html in [v for h, n in zip(htmls, numbers, strict=True) for v in (h, with_asides(h, n))]:
                x, _ = features(Page(html))
                y = explicit_labels(x)
                if not y.any():
                    continue
                with_text = x[:, FEATURES.index("text")] > 0
                x, y = x[with_text], y[with_text]
                views = [x]
                for columns in hidden:
                    views.append(x.copy())
                    views[-1][:, columns] = 0
                seen = np.concatenate(views)
                arrays = [pa.array(seen[:, k]) for k in range(len(FEATURES))]
                yield pa.record_batch([*arrays, pa.array(np.tile(y, len(views)).astype(float))], names)

    return sample.mapInArrow(elements, ", ".join(f"{n} double" for n in names))


def learn_trees(pages: DataFrame, most_pages: int = TRAINING_PAGES) -> Trees | None:
    """Trees of the pages' own explicit markup; None where no page has any, or nothing beside it."""
    elements = stage_table(training_elements(pages, most_pages), "dom-elements")
    if elements.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(elements)
    learner = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=STEP, seed=7, minInstancesPerNode=5)
    return Trees.of(learner.fit(assembled.select("features", "label")))


def _scores(trees: Trees | None, x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log-odds weighted by own text. Without trees everything outside asides is taken."""
    if trees is None:
        odds = np.where(x[:, FEATURES.index("in_aside")] > 0, -CLIP, CLIP)
    else:
        odds = np.clip(trees.log_odds(x), -CLIP, CLIP)
    return odds * (0.1 + np.log1p(own))


def extract(pages: DataFrame, trees: Trees | None, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Every page's main text and its code points (text, n_chars), beside the columns in ``keep``.

    Null or empty html, and pages without any text, give an empty text. Rows are judged one by one, equal rows alike; an empty
    table gives none; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)  # at most ROUNDS * 2 ** (DEPTH + 1) nodes
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "html", SLICE):
            parsed = [Page(html or "") for html in table.column("html").to_pylist()]
            made = [features(page) for page in parsed]
            sizes = [len(own) for _, own in made]
            joined = np.concatenate([x for x, _ in made])
            scores = _scores(shared.value, joined, np.concatenate([own for _, own in made]))
            texts, at = [], 0
            for page, size in zip(parsed, sizes, strict=True):
                texts.append(main_text(page, decode(page.parents, scores[at : at + size])))
                at += size
            out = table.select(list(keep)).append_column("text", pa.array(texts, pa.string()))
            out = out.append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))
            yield from out.combine_chunks().to_batches()

    return pages.select(*keep, *[c for c in ("html",) if c not in keep]).mapInArrow(work, schema)


def main_texts(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    return extract(pages, learn_trees(pages), keep)
