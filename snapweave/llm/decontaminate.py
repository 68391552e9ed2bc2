"""Benchmark decontamination: word n-grams seed candidate passages, Smith-Waterman alignment scores them.

Every n-gram of an item is a seed, however common; an item of fewer words is one seed. Seeds found in a document give diagonals; the windows around
them hold any alignment through the seed that reaches the threshold, so edited, shortened and reordered copies
score by how much of the item they still hold. Upper bounds on the score, from the words that document and item
share, leave few windows to align and lose none that could reach the threshold. Items are sent to the tasks in
slices of at most `slice_bytes`, each slice being one pass over the documents, so what is sent is bounded
whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .textbits import U64, bare_word, block_words, blocks, mix, text_buffers


@dataclass(frozen=True)
class DecontaminationConfig:
    """Words of a seed, share of an item's best score that marks a copy, alignment scores, and bytes of items sent at once."""

    seed_words: int = 3
    threshold: float = 0.5
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    slice_bytes: int = 1 << 23


class Items:
    """One slice of test items: their words as numbers, and where each n-gram of these stands."""

    def __init__(self, rows: list[tuple[int, str]], width: int) -> None:
        self.width, self.vocabulary, self.cache = width, {}, {}
        self.ids, self.words, self.grams, widths = [], [], [], {width}
        owner = []
        for item_id, text in rows:
            found = [w for w in (bare_word(x) for x in (text or "").encode().split()) if w]
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], np.int64)
            if not len(numbers):
                continue
            widths.add(min(width, len(numbers)))
            grams = gram_codes(numbers, min(width, len(numbers)))
            owner.append(np.full(len(grams), len(self.ids)))
            self.ids.append(item_id)
            self.words.append(numbers)
            self.grams.append(grams)
        self.widths = sorted(widths)
        self.codes = np.concatenate(self.grams) if self.grams else np.zeros(0, U64)
        order = np.argsort(self.codes, kind="stable")
        self.codes, self.owner = self.codes[order], (np.concatenate(owner) if owner else np.zeros(0, np.int64))[order]
        self.sizes = np.array([len(x) for x in self.words], np.int64)
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flags = np.zeros(len(self.vocabulary) + 1, bool)  # last: words of no item, whose number is -1

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def candidates(self, codes: np.ndarray, numbers: np.ndarray, least: float) -> list[int]:
        """Items that hold one of the distinct `codes` and of whose words at least the share `least` is in `numbers`."""
        low, high = np.searchsorted(self.codes, codes), np.searchsorted(self.codes, codes, "right")
        owners = np.unique(self.owner[ranges(low, high - low)])
        sizes = self.sizes[owners]
        self.flags[numbers] = True
        self.flags[-1] = False
        known = self.flags[self.flat[ranges(self.begins[owners], sizes)]]
        self.flags[numbers] = False
        found = np.add.reduceat(known.astype(np.int64), np.cumsum(sizes) - sizes)
        return owners[found / sizes >= least].tolist()

    def shared(self, owner: int, numbers: np.ndarray) -> np.ndarray:
        """Which of `numbers` are words of the item."""
        self.flags[self.words[owner]] = True
        out = self.flags[numbers]
        self.flags[self.words[owner]] = False
        return out

    def numbers(self, distinct: list[bytes]) -> np.ndarray:
        """Vocabulary numbers of raw words: -1 for other words, -2 for those without a letter or digit."""
        out = np.empty(len(distinct), np.int64)
        for k, word in enumerate(distinct):
            found = self.cache.get(word)
            if found is None:
                bare = bare_word(word)
                found = self.vocabulary.get(bare, -1) if bare else -2
                if len(self.cache) > 100_000:
                    self.cache.clear()
                self.cache[word] = found
            out[k] = found
        return out

    def documents(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, word numbers, places of the words in the text, first word and code of every seed found) of texts with seeds."""
        data, offsets = text_buffers(column)
        for i, j in blocks(offsets):
            distinct, inverse, owner, _, _ = block_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(distinct):
                continue
            numbers = self.numbers(distinct)[inverse]
            begin = np.searchsorted(owner, np.arange(j - i + 1))
            real = np.flatnonzero(numbers != -2)
            numbers, docs = numbers[real], owner[real]
            at = real - begin[docs]
            found, codes = [], []
            for width in self.widths:
                n = len(numbers) - width + 1
                if n < 1:
                    continue
                usable = docs[:n] == docs[width - 1 :]
                for k in range(width):
                    usable &= numbers[k : n + k] >= 0
                hits = np.flatnonzero(usable)
                grams = gram_codes(numbers, width)[hits]
                known = self.known(grams)
                found.append(hits[known])
                codes.append(grams[known])
            if not found:
                continue
            hits, codes = np.concatenate(found), np.concatenate(codes)
            bounds = np.searchsorted(docs, np.arange(j - i + 1))
            for doc in np.unique(docs[hits]):
                a, b = bounds[doc], bounds[doc + 1]
                mine = (hits >= a) & (hits < b)
                yield i + int(doc), numbers[a:b], at[a:b], hits[mine] - a, codes[mine]

    def known(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes), bool)
        return self.codes[np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)] == codes


def gram_codes(numbers: np.ndarray, width: int) -> np.ndarray:
    """Codes of the runs of `width` numbers; runs of other widths have other codes."""
    total = np.full(len(numbers) - width + 1, width, U64)
    for k in range(width):
        total = mix(total + (numbers[k : len(total) + k] + 2).astype(U64) * U64(0x9E3779B97F4A7C15))
    return total


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every range, one range after the other."""
    ends = np.cumsum(length)
    return np.repeat(begin - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)


def stretches(shared: np.ndarray, least: float, config: DecontaminationConfig) -> list[tuple[int, int]]:
    """Stretches (first word, end) outside which no alignment scores `least`, where `shared` tells the item's words.

    A word of the document adds at most `match` to a score if the item has it, and costs a mismatch or a gap
    if not; every alignment lies where the running sum of that, restarted at 0, is above 0.
    """
    total = np.concatenate([[0], np.cumsum(np.where(shared, config.match, max(config.mismatch, config.gap)))])
    rise = total - np.minimum.accumulate(total)
    cuts = np.append(np.flatnonzero(rise == 0), len(rise))
    peaks = np.maximum.reduceat(rise, cuts[:-1])
    return [(int(cuts[k]), int(cuts[k + 1]) - 1) for k in np.flatnonzero(peaks >= least)]


def align(item: np.ndarray, window: np.ndarray, config: DecontaminationConfig) -> tuple[int, int, int]:
    """Best local alignment (Smith-Waterman, linear gaps): (score, first and last window word)."""
    n = len(window)
    ramp = -config.gap * np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        step = np.where(window == word, config.match, config.mismatch)
        across = np.concatenate([[0], row[:-1] + step])
        down = row + config.gap
        top = np.maximum(np.maximum(across, down), 0)
        from_here = np.where(top == 0, np.arange(n + 1), np.where(top == across, np.concatenate([[0], begin[:-1]]), begin))
        reach = np.maximum.accumulate(top + ramp)
        fresh = np.ones(n + 1, bool)
        fresh[1:] = reach[1:] > reach[:-1]
        source = np.maximum.accumulate(np.where(fresh, np.arange(n + 1), 0))
        value = np.maximum(reach - ramp, 0)
        begin = np.where(value > top, from_here[source], from_here)
        row = value
        k = int(np.argmax(row))
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k - 1)
    return best


def _matches(items: Items, config: DecontaminationConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for row, numbers, at, hits, codes in items.documents(batch.column("text")):
                by_code = np.argsort(codes, kind="stable")
                order, codes = hits[by_code], codes[by_code]
                for owner in items.candidates(np.unique(codes), numbers, config.threshold):
                    words = items.words[owner]
                    size = len(words)
                    full = config.match * size
                    drift = int(full * (1 - config.threshold) / -config.gap) + 1  # more gaps cost too much
                    low, high = np.searchsorted(codes, items.grams[owner]), np.searchsorted(codes, items.grams[owner], "right")
                    starts = np.unique(order[ranges(low, high - low)] - np.repeat(np.arange(len(low)), high - low))
                    best = (0.0, 0, 0)
                    for group in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
                        a, b = max(0, int(group[0]) - drift), min(len(numbers), int(group[-1]) + size + drift)
                        for c, d in stretches(items.shared(owner, numbers[a:b]), config.threshold * full - 1e-9, config):
                            c, d = a + c, a + d
                            if np.isin(words, numbers[c:d]).sum() / size < config.threshold:
                                continue  # no alignment can score more than the item's words found here
                            score, first, last = align(words, numbers[c:d], config)
                            share = score / full
                            if share > best[0]:
                                best = (share, int(at[c + first]), int(at[c + last]) + 1)
                    if best[0] >= config.threshold:
                        out.append((ids[row], items.ids[owner], *best))
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return run


def _slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Items in order, at most about `limit` bytes of text at a time on the driver; one longer item is a slice of its own."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").orderBy("item_id").toLocalIterator():
        if held and size + len(row.text) > limit:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """Copies of `benchmark` (item_id, text) in `docs` (doc_id, text): doc_id, item_id, score, first_word, end_word.

    One row for each document and item with score >= threshold: the best alignment's share of the item's
    full score, and the words (counted between ASCII white space) it spans. Words are compared in lower case
    without punctuation at their ends. An edited copy is found if `seed_words` words of the item in a row have stayed,
    an item of fewer words if it stands there whole. Null ids, null or empty texts and items give no row; clean documents
    give none. Rows that repeat a doc_id give a row each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    found = spark.createDataFrame([], schema)
    for rows in _slices(benchmark, config.slice_bytes):
        items = Items(rows, config.seed_words)
        found = found.unionByName(scratch.save(source.mapInArrow(_matches(items, config), schema), "matches"))
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """`docs` without the documents that hold a copy of a test item; all columns and other rows stay."""
    bad = contaminated(docs, benchmark, config).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
