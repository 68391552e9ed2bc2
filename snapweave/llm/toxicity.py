"""Toxicity by Levenshtein automata intersected with a lexicon trie, and scores of the hits' context windows.

The lexicon is learned from a bounded sample of labelled documents: whole words, and stems that stand for
all words that begin with them. The automaton reads a word along all branches of the trie at once, with an
edit budget for each term; its states are made when first reached and kept. A hit counts as quotation if it
stands between quotation marks, or if a cue comes just before: a word that the sample has there in clean documents
much more often than in toxic ones, in whatever language; else it counts as abuse. A logistic model of the counts
and their densities gives the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import pyarrow as pa

from .labels import fit_logistic, fold, labelled_sample, logistic
from .textbits import bare_word, block_words, blocks, text_buffers

#: Characters that open or close a quotation (fixed value); an apostrophe counts only at the end of a word in such marks.
QUOTES = '"“”„«»‘’'


@dataclass(frozen=True)
class ToxicityConfig:
    """Bounds of the sample, of the lexicon and of the context, the fold that is never learned from, and the decision threshold."""

    sample_rows: int = 5000
    sample_bytes: int = 1 << 15
    most_terms: int = 200
    least_docs: int = 4
    ratio: float = 10.0
    context: int = 6
    cue_words: int = 3
    cue_docs: int = 5
    modulus: int = 4
    held_out: int = 2
    threshold: float = 0.3


def edit_budget(term: str) -> int:
    """Misspellings allowed in a whole word; short words would meet too many others."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Terms (`word` or `stem*`) as a trie, read with edits; `match` gives (number of the term or -1, edits)."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.accept: list[dict[str, int]] = [{}]
        self.budget = [0]
        for number, term in enumerate(terms):
            stem = term.endswith("*")
            node, budget = 0, 0 if stem else edit_budget(term)
            self.budget[0] = max(self.budget[0], budget)
            for ch in term.rstrip("*"):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.accept.append({})
                    self.budget.append(0)
                node = self.children[node][ch]
                self.budget[node] = max(self.budget[node], budget)
            self.accept[node]["stem" if stem else "word"] = number
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._moves: list[dict[str, int]] = []
        self._final: list[tuple[int, int]] = []
        self._start = self._state({(0, 0)}, -1)

    def _state(self, pairs: set[tuple[int, int]], stem: int) -> int:
        todo, closed = list(pairs), set(pairs)
        while todo:  # letters of the term that the word leaves out
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.budget[child] and (child, edits + 1) not in closed:
                    closed.add((child, edits + 1))
                    todo.append((child, edits + 1))
        least: dict[int, int] = {}
        for node, edits in closed:
            least[node] = min(edits, least.get(node, edits))
        key = (tuple(sorted(least.items())), stem)
        if key not in self._ids:
            self._ids[key] = len(self._states)
            self._states.append(key)
            self._moves.append({})
            found = [(edits, self.accept[node]["word"]) for node, edits in key[0] if "word" in self.accept[node] and edits <= edit_budget(self.terms[self.accept[node]["word"]])]
            best = min(found, default=(0, stem))
            self._final.append((best[1], best[0]) if stem < 0 or (found and best[0] == 0) else (stem, 0))
        return self._ids[key]

    def _move(self, state: int, ch: str) -> int:
        pairs, stem = self._states[state]
        after: set[tuple[int, int]] = set()
        for node, edits in pairs:
            if edits < self.budget[node]:
                after.add((node, edits + 1))  # a letter too many
            for letter, child in self.children[node].items():
                if letter == ch:
                    after.add((child, edits))
                    if edits == 0 and "stem" in self.accept[child]:
                        stem = self.accept[child]["stem"]
                elif edits < self.budget[child]:
                    after.add((child, edits + 1))
        to = self._state(after, stem) if after or stem >= 0 else -1
        self._moves[state][ch] = to
        return to

    def match(self, word: str) -> tuple[int, int]:
        state = self._start
        for ch in word:
            to = self._moves[state].get(ch)
            if to is None:
                to = self._move(state, ch)
            if to < 0:
                return -1, 0
            state = to
        return self._final[state]


def learn_lexicon(sample: list[tuple[str, int]], config: ToxicityConfig) -> list[str]:
    """Words and stems that toxic documents of the sample use at least `ratio` times as often as the others."""
    used, docs, total = (Counter(), Counter()), Counter(), [1, 1]
    for text, label in sample:
        found = Counter(w for w in map(bare_word, text.encode().split()) if w)
        total[label] += sum(found.values())
        forms: Counter = Counter()
        for w, n in found.items():
            if len(w) >= 4:
                forms[w] += n
            for k in range(4, min(len(w), 8) + 1):
                forms[w[:k] + "*"] += n
        used[label].update(forms)
        if label:
            docs.update(forms.keys())
    candidates = []
    for term, n in docs.items():
        if n < config.least_docs:
            continue
        a, b = used[1][term], used[0][term]
        ratio = (a / total[1]) / ((b + 0.5) / total[0])
        if ratio >= config.ratio:
            whole = not term.endswith("*") and a >= 0.9 * used[1][term[:8] + "*"]
            candidates.append((a * np.log(ratio) * (1.5 if whole else 1.0), term))
    chosen: list[str] = []
    for _, term in sorted(candidates, key=lambda x: (-x[0], x[1])):
        bare = term.rstrip("*")
        if len(chosen) < config.most_terms and not any(bare.startswith(c.rstrip("*")) or c.startswith(bare) for c in chosen):
            chosen.append(term)
    return sorted(chosen)


N_FEATURES = 8


@dataclass
class ToxicityModel:
    """Lexicon, words that look like misspelled terms but aren't, cues of quotation, and the logistic model."""

    terms: list[str]
    config: ToxicityConfig
    common: frozenset = frozenset()
    cues: frozenset = frozenset()
    weights: tuple | None = None
    _automaton: LexiconAutomaton | None = field(default=None, repr=False)
    _cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_cache": {}}

    def hit(self, word: bytes) -> tuple[int, int]:
        found = self._cache.get(word)
        if found is None:
            if self._automaton is None:
                self._automaton = LexiconAutomaton(self.terms)
            bare = bare_word(word)
            found = self._automaton.match(bare)
            if found[1] and bare in self.common:
                found = (-1, 0)
            if len(self._cache) > 300_000:
                self._cache.clear()
            self._cache[word] = found
        return found

    def features(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """One row of counts and densities for every text of a block."""
        n = len(cuts) - 1
        distinct, inverse, owner, start, end = block_words(data, cuts)
        matches = np.array([self.hit(w) for w in distinct], np.int64).reshape(-1, 2)
        total = np.bincount(owner, minlength=n)
        counts = np.zeros((n, 4))  # abuse by words, by stems, misspelled, quoted
        kinds: dict[int, set[int]] = {}
        raw = data.tobytes()
        for at in np.flatnonzero(matches[inverse, 0] >= 0) if len(distinct) else ():
            doc = owner[at]
            term, edits = matches[inverse[at]]
            kinds.setdefault(int(doc), set()).add(int(term))
            first, last = at, at + 1
            while first > 0 and at - first < self.config.context and owner[first - 1] == doc:
                first -= 1
            while last < len(owner) and last - at <= self.config.context and owner[last] == doc:
                last += 1
            ahead, word, after = (raw[a:b].decode("utf-8", "replace") for a, b in ((start[first], start[at]), (start[at], end[at]), (end[at], end[last - 1])))
            told = bool(self.cues) and any(bare_word(x) in self.cues for x in ahead.encode().split()[-self.config.cue_words :])
            opened = sum(ahead.count(q) for q in QUOTES if q != "’") % 2 == 1 or word[0] in QUOTES
            marked = opened and any(q in QUOTES for q in word.rstrip(".,;:!?")[1:] + after)
            counts[doc, 3 if told or marked else 2 if edits else 1 if self.terms[term].endswith("*") else 0] += 1
        different = np.array([len(kinds.get(k, ())) for k in range(n)], float)
        abuse = counts[:, 0] + 0.8 * counts[:, 2]
        dense = 1000.0 / np.maximum(total, 20)
        return np.column_stack(
            [np.log1p(abuse), np.log1p(abuse * dense), np.log1p(counts[:, 1]), np.log1p(counts[:, 1] * dense), np.log1p(counts[:, 3]), different, np.log1p(total), (abuse + counts[:, 1] > 0) * np.log1p(total)]
        )


def learn_cues(sample: list[tuple[str, int]], model: ToxicityModel) -> frozenset:
    """Words that come just before a term in clean documents, `ratio` times as often as in toxic ones."""
    docs, total = (Counter(), Counter()), [0, 0]
    for text, label in sample:
        raw = text.encode().split()
        hits = [k for k, w in enumerate(raw) if model.hit(w)[0] >= 0]
        docs[label].update({bare_word(x) for k in hits for x in raw[max(0, k - model.config.cue_words) : k]} - {""})
        total[label] += bool(hits)
    often = {w: n for w, n in docs[0].items() if n >= model.config.cue_docs}
    return frozenset(w for w, n in often.items() if n / total[0] >= model.config.ratio * (docs[1][w] + 0.5) / (total[1] + 1))


def fit_toxicity(sample: list[tuple[str, int]], config: ToxicityConfig) -> ToxicityModel:
    """A model from (text, label) pairs; with no pair of some label, all scores are the share of label 1."""
    model = ToxicityModel(learn_lexicon(sample, config), config)
    near: Counter = Counter()
    for text, label in sample:
        if not label:
            near.update({bare_word(w) for w in set(text.encode().split()) if model.hit(w)[1]})
    model.common = frozenset(w for w, n in near.items() if n >= 2)
    model._cache.clear()
    model.cues = learn_cues(sample, model)
    y = np.array([label for _, label in sample], float)
    if 0 < y.sum() < len(y):
        texts = pa.array([text for text, _ in sample])
        data, offsets = text_buffers(texts)
        x = np.concatenate([model.features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets)])
        model.weights = fit_logistic(x, y)
    else:
        share = float(y.mean()) if len(y) else 0.0
        odds = np.log((share + 1e-6) / (1 - share + 1e-6))
        model.weights = (np.append(np.zeros(N_FEATURES), odds), np.zeros(N_FEATURES), np.ones(N_FEATURES))
    return model


def _scores(model: ToxicityModel, column: pa.Array) -> np.ndarray:
    data, offsets = text_buffers(column)
    found = [logistic(model.features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), model.weights) for i, j in blocks(offsets)]
    return np.concatenate(found) if found else np.zeros(0)


def score_with(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch.column("text")))], names=["doc_id", "score"])

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """`docs` without the rows that score at `threshold` or more; all columns and other rows stay, null texts too."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit_toxicity(labelled_sample(source, labels, "toxic", config.modulus, config.held_out, config.sample_rows, config.sample_bytes), config)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(_scores(model, text))

    return docs.where(score(F.col("text")) < config.threshold)


def toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts have no hits and score as such. A null doc_id is not held out. Rows that repeat a
    doc_id are scored each. Labels other than 0 and 1 are ignored; with none at all, every score is near 0.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit_toxicity(labelled_sample(source, labels, "toxic", config.modulus, config.held_out, config.sample_rows, config.sample_bytes), config)
    scored = source.mapInArrow(score_with(model), "doc_id long, score double")
    held = F.coalesce(fold(config.modulus) == config.held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))
