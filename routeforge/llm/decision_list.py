"""Quality rules learned as a decision list: sequential covering over labelled statistics.

Each round grows a conjunction of thresholds on two thirds of the labelled rows (greatest information gain per condition),
prunes conditions from its end on the other third, keeps it if it is precise enough there, and goes on with the rows it does not cover. The rules come out
in that order as one Spark ``when`` chain over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeforge.llm.doc_stats import COUNTS, doc_stats
from routeforge.session import stage_table

#: Labelled rows that the list is learned from at most: those with the least hashes of their id.
LABELLED_ROWS = 20_000
#: Bits of a hash by which the labelled rows are counted to find the least: 4,096 counts.
HASH_BITS = 12
#: A rule stays if at least this share of what it covers, in the rows it was grown on and pruned on alike, is bad.
PRECISION = 0.9
MIN_WORDS = 10
REPEAT_PERCENT = 20

#: Ratios the rules look at: (numerator, denominator). A text with a denominator of 0 has ratio 0.
RATIOS = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "marks_per_word": ("n_marks", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "same_next_share": ("n_same_next", "n_words"),
}
FEATURES = ("n_words", *RATIOS)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def covers(self, x: np.ndarray) -> np.ndarray:
        values = x[:, FEATURES.index(self.feature)]
        return values >= self.threshold if self.at_least else values <= self.threshold

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.threshold) if self.at_least else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.covers(x)
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the greatest gain: bad rows it keeps, times the rise in the log share of bad rows."""
    p0, n0 = int(bad.sum()), len(bad)
    base, best, found = np.log2(p0 / n0), 1e-9, None
    for k, name in enumerate(FEATURES):
        order = np.argsort(x[:, k], kind="stable")
        values, hits = x[order, k], np.cumsum(bad[order])
        cut = np.flatnonzero(values[1:] > values[:-1])
        if not len(cut):
            continue
        low_p, low_n = hits[cut], cut + 1
        middle = (values[cut] + values[cut + 1]) / 2
        for at_least, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - base), 0.0)
            top = int(np.argmax(gain))
            if gain[top] > best:
                best, found = float(gain[top]), Condition(name, at_least, float(middle[top]))
    return best, found


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    hit = covered(rule, x)
    p = int((hit & bad).sum())
    return (2 * p - int(hit.sum())) / max(1, int(hit.sum()))


def learn(x: np.ndarray, bad: np.ndarray, fold: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """Rules for bad rows. ``fold`` is True for the rows that prune. No bad rows, or no rows: no rules.

    Rules are sought until every bad row to grow on is covered, or was covered by a rule that is not precise enough: such a rule is left
    out, and the bad rows it covers are no longer asked for. Every round settles at least one of them.
    """
    rules: list[Rule] = []
    asked = bad & ~fold
    while asked.any():
        growing = ~fold & (asked | ~bad)
        grow_x, grow_bad = x[growing], asked[growing]
        rule: Rule = ()
        inside = np.ones(len(grow_x), bool)
        while not grow_bad[inside].all():
            _, condition = _best_condition(grow_x[inside], grow_bad[inside])
            if condition is None:
                break
            rule += (condition,)
            inside &= condition.covers(grow_x)
        if not rule:
            break  # nothing tells the bad rows that are left from the good ones
        prune_x, prune_bad = x[fold], bad[fold]
        if covered(rule, prune_x).any():
            # The longest prefix wins a tie: it says most about why a text goes.
            rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(r, prune_x, prune_bad), len(r)))
        hit = covered(rule, x)
        grown = hit & ~fold
        if (hit & bad).sum() < precision * hit.sum() or (grown & bad).sum() < precision * grown.sum():
            asked &= ~hit
            continue
        rules.append(rule)
        x, bad, fold, asked = x[~hit], bad[~hit], fold[~hit], asked[~hit]
    return rules


def with_ratios(stats: DataFrame) -> DataFrame:
    return stats.withColumns(
        {n: F.when(F.col(d) > 0, F.col(a) / F.col(d)).otherwise(F.lit(0.0)) for n, (a, d) in RATIOS.items()}
    )


def labelled_rows(stats: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """FEATURES, doc_id and ``bad`` of at most ``rows`` labelled documents, by least hash of the id. Rows that the base
    rule rejects have nothing to teach the list, which is asked about the others only.

    A document labelled more than once is bad if any label says so; null labels and ids are left out.
    """
    bad = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.min("quality") == 0).alias("bad"))
    )
    joined = with_ratios(stats).where(~base_failed()).join(bad, "doc_id").select("doc_id", "bad", *FEATURES)
    hashed = stage_table(joined.withColumn("hash", F.xxhash64("doc_id")), "labelled-rows")
    # Counts of the hashes' leading bits tell where the least ones end, so that few rows besides them are ordered.
    places = hashed.groupBy(F.shiftright("hash", 64 - HASH_BITS).alias("place")).agg(F.count("*").alias("n")).orderBy("place").collect()
    total, last = 0, None
    for place, n in places:
        total, last = total + n, place
        if total >= rows:
            break
    least = hashed if last is None else hashed.where(F.shiftright("hash", 64 - HASH_BITS) <= last)
    return least.orderBy("hash", "doc_id", *FEATURES).limit(rows).drop("hash")


def learn_from(stats: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[Rule]:
    """The rules of the labelled rows; every third of them, by place in the order of the hashes, prunes."""
    sample = labelled_rows(stats, labels, rows).toPandas()  # at most ``rows`` rows of numbers
    x = sample[list(FEATURES)].to_numpy(float).reshape(len(sample), len(FEATURES))
    return learn(x, sample["bad"].to_numpy(bool), np.arange(len(sample)) % 3 == 2)


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: False at the first rule that holds, True where none does."""
    if not rules:
        return F.lit(True)
    chain = None
    for rule in rules:
        condition = rule[0].column()
        for more in rule[1:]:
            condition &= more.column()
        chain = F.when(condition, F.lit(False)) if chain is None else chain.when(condition, F.lit(False))
    return chain.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judge_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), rows: int = LABELLED_ROWS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with COUNTS, base_failed and kept, beside the columns in ``keep``.

    Counts without texts go into a stage table, from which the list is learned. They are judged as well if no column but doc_id is kept; else
    texts are counted again on their way, so that they are never written here. kept is False where
    base_failed, else what the learned list says; without labels nothing else is rejected. Null text has no words,
    and fails; null doc_id is judged but never learned from; equal rows stay apart.
    """
    stats = stage_table(doc_stats(docs), "doc-stats")
    rules = learn_from(stats, labels, rows)
    judged = with_ratios(stats if set(keep) == {"doc_id"} else doc_stats(docs, keep)).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules))
    return judged.withColumn("kept", kept).select(*keep, *COUNTS, "base_failed", "kept")
