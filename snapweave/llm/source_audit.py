"""How far the sources of a language differ in their words: mergeable byte tries with a counter for each source.

Each task counts the terms of its documents in one trie for each language, whose leaves hold, by source, documents and
occurrences. A trie is kept flat, as its preorder walk: leaves in byte order. Cut into leaves, tries are dealt by
ranges of prefixes (of language and term bytes, bounds from a sample) and sorted, so that the leaves of one path stand
next to each other; a task merges the tries of its range as they stream by and holds one batch of them. Leaves in enough
documents go on, in branches whose terms are stored as the depth where a path leaves the one before and the bytes below.

With the sums by source known, the walk over the branches gives for every pair of sources the part of their
divergence that the branch has, and for every source its first terms by divergence from the language; terms come in
byte order, so ties fall in the order that is asked for. Sums and first rows of all branches give the result. Counts and
shares are integers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .textbits import LOWER, blocks, text_buffers


@dataclass(frozen=True)
class AuditConfig:
    """Documents of its language that a term needs, what is added to each count, units in which shares are given, terms listed by source; bytes of text and leaves that a task counts at a time."""

    least_documents: int = 30
    added: int = 5
    units: int = 1_000_000_000
    terms: int = 50
    block_bytes: int = 1 << 22
    trie_leaves: int = 1 << 19


#: Bytes of terms: ASCII letters and all of other characters.
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(are these bytes of terms, lengths of the terms, document numbers)."""
    inside = TERM[data]
    if not inside.any():
        return inside, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a term ends where its document does
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    return inside, np.flatnonzero(last) + 1 - start, np.searchsorted(offsets, start, "right") - 1


LEAVES = pa.schema([("group", pa.int32()), ("term", pa.large_binary()), ("documents", pa.int64()), ("occurrences", pa.int64())])


def block_leaves(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> pa.Table:
    """The leaves of a block of documents, whose (language, source) pairs are numbered in `group`; in no order."""
    inside, sizes, owner = term_spans(data, offsets)
    if not len(sizes):
        return LEAVES.empty_table()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    letters = LOWER[data[inside]]
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes())]).dictionary_encode()
    code, n = terms.indices.to_numpy(), len(terms.dictionary)
    key = group[owner].astype(np.int64) * n + code
    order = np.argsort(key, kind="stable")  # documents stay in order under each key
    key, owner = key[order], owner[order]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    documents = np.add.reduceat((new | np.append(True, owner[1:] != owner[:-1])).astype(np.int64), first)
    leaf = key[first]
    columns = [pa.array((leaf // n).astype(np.int32)), terms.dictionary.take(pa.array(leaf % n)), pa.array(documents), pa.array(np.diff(np.append(first, len(key))))]
    return pa.Table.from_arrays(columns, schema=LEAVES)


def merged_leaves(parts: list[pa.Table]) -> pa.Table:
    """One trie of several: leaves of equal group and term become one, in byte order of their terms."""
    table = pa.concat_tables(parts).combine_chunks()
    table = table.take(pc.sort_indices(table, sort_keys=[("term", "ascending"), ("group", "ascending")]))
    if table.num_rows < 2:
        return table
    group, term = table["group"].to_numpy(), table["term"].combine_chunks()
    new = np.append(True, (group[1:] != group[:-1]) | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False))
    first = np.flatnonzero(new)
    sums = [pa.array(np.add.reduceat(table[c].to_numpy(), first)) for c in ("documents", "occurrences")]
    return pa.Table.from_arrays([pa.array(group[first]), term.take(pa.array(first)), *sums], schema=LEAVES)


def _count(config: AuditConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def rows() -> Iterator[pa.RecordBatch]:
            names = list(numbers)
            table = merged_leaves(held)
            for batch in table.to_batches(max_chunksize=1 << 16):
                group = batch.column("group")
                pair = [pa.array([x[k] for x in names], pa.string()).take(group) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pair[0], batch.column("term").cast(pa.binary()), pair[1], batch.column("documents"), batch.column("occurrences")], names=["lang", "term", "source", "documents", "occurrences"])
            held.clear()
            numbers.clear()

        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            for i, j in blocks(offsets, config.block_bytes):
                group = np.array([numbers.setdefault(x, len(numbers)) for x in pairs[i:j]])
                held.append(block_leaves(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], group))
                if sum(x.num_rows for x in held) > config.trie_leaves:
                    held[:] = [merged_leaves(held)] if len(held) > 1 else held
                    if held[0].num_rows > config.trie_leaves // 2:
                        yield from rows()
        if held:
            yield from rows()

    return run


def branch_depths(terms: list[bytes]) -> list[int]:
    """For terms in byte order, the depth at which each leaves the path of the one before."""
    found = [0] * len(terms)
    for k in range(1, len(terms)):
        a, b = terms[k - 1], terms[k]
        low, high = 0, min(len(a), len(b))
        while low < high:  # by halving: common beginnings of long terms are compared as wholes
            middle = (low + high + 1) // 2
            if a[low:middle] == b[low:middle]:
                low = middle
            else:
                high = middle - 1
        found[k] = low
    return found


def path_terms(depths: list[int], rests: list[bytes]) -> list[bytes]:
    """The terms of a branch from its depths and the bytes below them."""
    found, term = [], b""
    for depth, rest in zip(depths, rests, strict=True):
        term = term[:depth] + rest
        found.append(term)
    return found


BRANCH = "lang string, depths array<int>, rests array<binary>, bounds array<int>, of array<int>, counts array<long>, sources array<string>, totals array<long>"
BRANCH_TYPE = pa.schema([("lang", pa.string()), ("depths", pa.list_(pa.int32())), ("rests", pa.list_(pa.binary())), ("bounds", pa.list_(pa.int32())), ("of", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))])


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of leaves with equal paths side by side: (first row of each path, path numbers, source names, source numbers, occurrences, documents of each path), summed by path and source."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in ("lang", "term"):
        column = table[c].combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    documents = np.add.reduceat(table["documents"].to_numpy(), first)
    source = table["source"].combine_chunks().dictionary_encode()
    names = source.dictionary.to_pylist()
    key = (np.cumsum(new) - 1) * len(names) + source.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return first, key[begin] // len(names), names, key[begin] % len(names), np.add.reduceat(table["occurrences"].to_numpy()[order], begin), documents


def _merge(config: AuditConfig):
    def branches(table: pa.Table) -> Iterator[pa.RecordBatch]:
        first, leaf, names, source, counts, documents = _summed(table)
        langs, terms = table["lang"].take(pa.array(first)).to_pylist(), table["term"].take(pa.array(first)).to_pylist()
        kept = np.flatnonzero(documents >= config.least_documents)
        bounds = np.searchsorted(leaf, np.arange(len(first) + 1))
        k = 0
        while k < len(kept):
            lang, after = langs[kept[k]], k + 1
            while after < len(kept) and langs[kept[after]] == lang:
                after += 1
            own = kept[k:after]
            words = [terms[x] for x in own.tolist()]
            depths = branch_depths(words)
            rows = np.concatenate([np.arange(bounds[x], bounds[x + 1]) for x in own.tolist()])
            used, of = np.unique(source[rows], return_inverse=True)  # only the language's own sources
            totals = np.zeros(len(used), np.int64)
            np.add.at(totals, of, counts[rows])
            cuts = np.concatenate([[0], np.cumsum(bounds[own + 1] - bounds[own])])
            row = [lang, depths, [w[d:] for w, d in zip(words, depths, strict=True)], cuts.tolist(), of.tolist(), counts[rows].tolist(), [names[x] for x in used.tolist()], totals.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BRANCH_TYPE, strict=True)], schema=BRANCH_TYPE)
            k = after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last path of the batches so far, summed by source
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last = pc.and_(pc.equal(table["lang"], table["lang"][-1]), pc.equal(table["term"], table["term"][-1])).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield from branches(table.slice(0, cut))
            held = table.slice(cut).group_by(["lang", "term", "source"]).aggregate([("documents", "sum"), ("occurrences", "sum")]).rename_columns(table.column_names)
        if held is not None:
            yield from branches(held)

    return run


def shares(count: np.ndarray, total: np.ndarray, units: int) -> np.ndarray:
    """floor(units * count / total) for 0 <= count <= total, total > 0 (both up to 2**62); exact."""
    if not count.size or int(count.max()) < (1 << 63) // units:
        return units * count // total
    exact = np.array([units * a // b for a, b in zip(*(x.ravel().tolist() for x in np.broadcast_arrays(count, total)), strict=True)], np.int64)
    return exact.reshape(np.broadcast(count, total).shape)


def _compare(config: AuditConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list[str], np.ndarray]] = {}

        def pairs() -> Iterator[pa.RecordBatch]:
            for lang, (names, matrix) in sums.items():
                for a in range(len(names) - 1):
                    yield result(lang, [names[a]] * (len(names) - a - 1), "pair", names[a + 1 :], matrix[a, a + 1 :])
            sums.clear()

        def result(lang: str, source: list[str], part: str, item: list, value: np.ndarray) -> pa.RecordBatch:
            n = len(source)
            items = pa.array([x.encode() if isinstance(x, str) else x for x in item], pa.binary()).view(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n), items, pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

        for batch in batches:
            for row in batch.to_pylist():
                names, own = row["all_sources"], dict(zip(row["all_sources"], row["all_totals"], strict=True))
                place = {x: k for k, x in enumerate(names)}
                smoothed = np.array([own[x] for x in names], np.int64) + config.added * row["n_terms"]
                whole = sum(own.values()) + config.added * row["n_terms"]
                terms = path_terms(row["depths"], row["rests"])
                bounds, of, counts = np.array(row["bounds"]), np.array([place[x] for x in row["sources"]])[np.array(row["of"], np.int64)], np.array(row["counts"], np.int64)
                if row["lang"] not in sums:
                    sums[row["lang"]] = (names, np.zeros((len(names), len(names)), np.int64))
                matrix = sums[row["lang"]][1]
                step = max(1, (1 << 21) // len(names))
                for a in range(0, len(terms), step):
                    b = min(a + step, len(terms))
                    low, high = bounds[a], bounds[b]
                    table = np.zeros((b - a, len(names)), np.int64)
                    table[np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1])), of[low:high]] = counts[low:high]
                    share = 1 + shares(table + config.added, smoothed[None, :], config.units)
                    for k in range(len(names) - 1):
                        matrix[k, k + 1 :] += np.abs(share[:, k + 1 :] - share[:, k, None]).sum(axis=0)
                    over = share - 1 - shares(table.sum(axis=1) + config.added, np.int64(whole), config.units)[:, None]
                    over[table == 0] = 0
                    for k, name in enumerate(names):
                        at = np.flatnonzero(over[:, k] > 0)
                        top = at[np.argsort(-over[at, k], kind="stable")[: config.terms]]  # of equal values the first in byte order
                        if len(top):
                            yield result(row["lang"], [name] * len(top), "term", [terms[a + x] for x in top.tolist()], over[top, k])
                if sum(m.size for _, m in sums.values()) > 1 << 22:
                    yield from pairs()
        yield from pairs()

    return run


def audit_sources(docs: DataFrame, config: AuditConfig, salts: int = 64) -> DataFrame:
    """How the sources of each language of `docs` (text, lang, source) differ: lang, source, part, item, value, rank.

    Null texts, languages and sources are read as ''. Rows are documents, also those that repeat a doc_id or have none. Terms are
    runs of ASCII letters and of all characters past ASCII, with A-Z in lower case; a language keeps those that are in
    at least `least_documents` of its documents. Part `pair` has a row for every other source of the language (0 where no
    term is kept), `term` the first `terms` by how far the source's share is over the language's, at least one unit. Equal
    values are in byte order of their items. Other columns are ignored; an empty table gives an empty result. The pairs of a
    language are as many as the square of its sources, since all are asked for; a branch's shares are held for 2**21 cells at a time.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    leaves = scratch.save(rows.mapInArrow(_count(config), "lang string, term binary, source string, documents long, occurrences long"), "leaves")
    dealt = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    kept = scratch.save(dealt.mapInArrow(_merge(config), BRANCH), "branches")
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
    sizes = kept.groupBy("lang").agg(F.sum(F.size("rests")).cast("long").alias("n_terms"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    by_lang = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("all"))
    languages = by_lang.join(sizes, "lang", "left").select("lang", F.col("all.source").alias("all_sources"), F.col("all.total").alias("all_totals"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    languages = scratch.save(languages, "languages")
    salted = languages.where("n_terms > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    walks = kept.withColumn("salt", F.pmod(F.xxhash64(F.col("rests")[0]), F.lit(salts)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    found = scratch.save(walks.mapInArrow(_compare(config), "lang string, source string, part string, item string, value long"), "parts")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = languages.where("n_terms = 0").select("lang", F.explode("all_sources").alias("source"), "all_sources").select("lang", "source", F.explode("all_sources").alias("item")).where("source < item").withColumn("value", F.lit(0).cast("long"))
    both = sums.unionByName(bare).select("lang", "value", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))
    term = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.terms)
    return pair.unionByName(term)
