"""Spelling variants by permuterm rotations.

A word is marked by a terminator and turned through all its rotations. Where the word has code point c at place i, the rotation that
ends in c is w[i+1:] + END + w[:i] + c. Words that differ in c alone have such rotations with the same prefix, and the word
without c has that prefix as a whole rotation of its own. So, with all rotations sorted, replacements and indels of one place are
neighbours that share a prefix which skips the edited code point: one scan finds them. A group of a prefix has at most as many members as there are
letters, and one more, since the prefix and the letter determine the word.

Every pair is found once: a replacement has one place, and a letter deleted from a run of equal ones counts at the run's start.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeforge.llm.arrow_text import slices, texts_of
from routeforge.session import stage_table

#: Letters of the words, in UTF-8: A-Z, a-z and U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_LATER = bytes(range(0x80, 0xC0))
#: Comes in no word.
END = "$"
SHORTEST, RAREST = 6, 5
TYPO_PART = 199
FORM_RATIO = 5


def _written(run: bytes, check: int, part: int) -> bytes:
    """The run as counted: one code point is taken out where ``part`` divides the check number of document and run."""
    if check % part:
        return run
    letters = run.decode()
    at = check % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame, part: int = TYPO_PART, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) with at least ``shortest`` code points and ``rarest`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lowered; where ``part`` divides h, the unsigned crc32 of
    "<doc_id>:<run>", the run loses its code point h modulo its length. A null doc_id is written as nothing.
    Rows that repeat count each time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "text"):
            found: Counter[bytes] = Counter()
            for doc, text in zip(table.column("doc_id").to_pylist(), texts_of(table).cast(pa.binary()).to_pylist(), strict=True):
                start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for run, times in Counter(_RUN.findall(text.lower())).items():  # bytes: only A-Z are lowered
                    found[_written(run, zlib.crc32(run, start), part)] += times
            kept = [(w, n) for w, n in found.items() if len(w.translate(None, _LATER)) >= shortest]
            yield pa.record_batch([pa.array([w.decode() for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def _rotations(words: DataFrame) -> DataFrame:
    """(prefix, last, first_of_run, word, n): every rotation, whole (last empty) and without its last code point."""
    size = F.length("word")
    places = F.sequence(F.lit(0), size)

    def turned(i):
        # Without the code point at place i; and, whole, from place i on.
        without = F.concat(F.substring("word", i + 2, size), F.lit(END), F.substring("word", F.lit(1), i))
        whole = F.concat(F.substring("word", i + 1, size + 1), F.lit(END), F.substring("word", F.lit(1), i))
        letter, before = F.substring("word", i + 1, F.lit(1)), F.substring("word", i, F.lit(1))
        skipping = F.struct(without.alias("prefix"), letter.alias("last"), ((i == 0) | (letter != before)).alias("first_of_run"))
        complete = F.struct(whole.alias("prefix"), F.lit("").alias("last"), F.lit(True).alias("first_of_run"))
        return F.when(i < size, F.array(skipping, complete)).otherwise(F.array(complete))

    return words.select("word", "n", F.explode(F.flatten(F.transform(places, turned))).alias("r")).select("r.*", "word", "n")


_PAIRS = "word string, other string, other_n long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words, both ways round, from rotations sorted by prefix. A group that goes on in the next batch is held back."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = _last_group(held)
        yield from _pairs(held.slice(0, last))
        held = held.slice(last)
    if held is not None:
        yield from _pairs(held)


def _changes(table: pa.Table) -> np.ndarray:
    """Where a row's prefix is another than the row's before."""
    prefix = table.column("prefix").combine_chunks()
    return np.flatnonzero(pc.not_equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy(zero_copy_only=False)) + 1


def _last_group(table: pa.Table) -> int:
    changes = _changes(table) if table.num_rows > 1 else []
    return int(changes[-1]) if len(changes) else 0


def _pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if table.num_rows < 2:
        return
    starts = np.concatenate([[0], _changes(table), [table.num_rows]])
    sizes = np.diff(starts)
    groups = starts[:-1][sizes > 1]
    lengths = sizes[sizes > 1]
    if not len(groups):
        return
    at = np.repeat(groups - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    shared = table.take(pa.array(at))
    last, first_of_run, words, counts = (shared.column(c).to_pylist() for c in ("last", "first_of_run", "word", "n"))
    out: list[tuple[str, str, int]] = []
    done = 0
    for length in lengths.tolist():
        members = range(done, done + length)
        done += length
        for k, i in enumerate(members):
            for j in members[k + 1 :]:
                # Two letters in one place; or the word itself, of which a letter makes the longer word, once for each run.
                if (last[i] and last[j]) or (bool(last[i]) != bool(last[j]) and first_of_run[i] and first_of_run[j]):
                    out.append((words[i], words[j], counts[j]))
                    out.append((words[j], words[i], counts[i]))
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["word", "other", "other_n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, other_n): the pairs of ``words`` (word, n; distinct) one inserted, deleted or replaced code point apart, both ways round."""
    rotations = stage_table(_rotations(words), "rotations")
    ordered = rotations.repartitionByRange("prefix").sortWithinPartitions("prefix")  # equal prefixes lie in one range
    return ordered.mapInArrow(_scan, _PAIRS)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): forms followed to the last. Every round doubles the steps; counts rise by a factor along a way, so ways are short."""
    ways = stage_table(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = ways.join(further, "root", "left")
        after = stage_table(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ways")
        ways = after.drop("moved")
        if after.where("moved").isEmpty():
            return ways


def spelling_variants(
    docs: DataFrame, part: int = TYPO_PART, shortest: int = SHORTEST, rarest: int = RAREST, ratio: int = FORM_RATIO
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of :func:`word_counts`.

    n_near counts the words that are one code point inserted, deleted or replaced away. form is the most frequent of them
    (ties: least in code-point order) if it is ``ratio`` times as frequent, else null; root is the last of the word, its form, the form's
    form and so on. Null and empty texts have no words; columns beyond doc_id and text are not read; an empty table gives no rows.
    """
    words = stage_table(word_counts(docs, part, shortest, rarest), "words")
    near = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best")
    )
    judged = words.join(near, "word", "left").withColumn("form_n", -F.col("best.rank"))
    frequent = F.col("form_n") >= ratio * F.col("n")
    judged = judged.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.other")).alias("form"),
        F.when(frequent, F.col("form_n")).alias("form_n"),
    )
    judged = stage_table(judged, "near-words")
    roots = _roots(judged.where("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
