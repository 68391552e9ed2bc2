"""Language of documents as a mixture: expectation-maximisation over n-gram likelihoods.

Byte trigrams of letters and word bounds, hashed into `buckets`, are counted for each language over all
training documents. A document's proportions of all languages are estimated by EM; its languages are then
the leading set with the largest penalised likelihood, each set being estimated anew. The prediction is
the largest proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .labels import fold
from .textbits import LOWER, text_buffers


@dataclass(frozen=True)
class LanguageConfig:
    """Hash buckets, smoothing, EM rounds, least share of a language in a mixture, languages that a model may have, and the fold that is never learned from."""

    buckets: int = 1 << 15
    smoothing: float = 0.5
    rounds: int = 12
    least_share: float = 0.03
    most_languages: int = 1000
    modulus: int = 4
    held_out: int = 2


_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_FOLDED = np.where(_LETTERS, LOWER, 32).astype(np.uint8)


def trigram_buckets(text: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the trigrams of one text; runs of other bytes than letters count as one space."""
    b = _FOLDED[text]
    keep = b != 32
    if len(b) > 1:
        keep[1:] |= b[:-1] != 32
    b = np.concatenate([[32], b[keep], [32]]).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - int(buckets).bit_length() + 1)).astype(np.int64)


def _has_letter(raw: bytes) -> bool:
    return bool(_LETTERS[:128][np.frombuffer(raw, np.uint8) & 127][np.frombuffer(raw, np.uint8) < 128].any()) or any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def mixture(counts: np.ndarray, chances: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of a document: counts of its trigrams, and their chance in each language."""
    total, size = counts.sum(), chances.shape[1]
    share = np.full(size, 1.0 / size)
    for _ in range(rounds if size > 1 else 0):
        share *= (counts / (chances @ share)) @ chances / total
    return share, float(counts @ np.log(chances @ share))


def choose_languages(counts: np.ndarray, chances: np.ndarray, config: LanguageConfig) -> np.ndarray:
    """Proportions of all languages; zero for those outside the set of the best penalised likelihood."""
    size = chances.shape[1]
    share, _ = mixture(counts, chances, config.rounds)
    order = np.argsort(-share, kind="stable")
    single = counts @ np.log(chances)
    lead = int(np.argmax(single))
    penalty = 0.5 * np.log(max(counts.sum(), 2.0))
    best, best_value = np.eye(size)[lead], single[lead] - penalty
    for k in range(2, int((share >= config.least_share).sum()) + 1):
        some = order[:k]
        part, value = mixture(counts, chances[:, some], config.rounds)
        if value - k * penalty <= best_value:
            break
        best, best_value = np.zeros(size), value - k * penalty
        best[some] = part
    return best


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                found = np.bincount(trigram_buckets(data[offsets[k] : offsets[k + 1]], buckets), minlength=buckets)
                held[lang] = held[lang] + found if lang in held else found
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["lang", "bucket", "n"])

    return run


def _predict(names: list[str], chances: np.ndarray, config: LanguageConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            langs, scores, shares = [], [], []
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                if not names or not len(text) or not _has_letter(text.tobytes()):
                    langs.append("und")
                    scores.append(0.0)
                    shares.append([])
                    continue
                counts = np.bincount(trigram_buckets(text, config.buckets), minlength=config.buckets)
                used = np.flatnonzero(counts)
                share = choose_languages(counts[used].astype(np.float64), chances[used], config)
                top = int(np.argmax(share))
                langs.append(names[top])
                scores.append(float(min(share[top], 1.0)))
                shares.append([(names[i], float(share[i])) for i in np.flatnonzero(share)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "mixture"],
            )

    return run


def language_mixture(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score, mixture.

    Learns from the non-null `lang` of documents outside the held-out fold, all of them; the model has one
    count for each language and bucket and is what comes to the driver and to the tasks, 256 KB a language at the
    default size. More than `most_languages` values of `lang` raise: such a column doesn't hold languages. A null text, one with no letter, or
    an empty training set gives `und`, 0 and an empty mixture. A null doc_id is neither held out nor learned
    from. Rows that repeat a doc_id count and are predicted each.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    training = source.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(config.modulus) != config.held_out))
    counts = training.select("text", "lang").mapInArrow(_count(config.buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = Scratch(docs.sparkSession, "languages").save(counts, "counts")
    names = sorted(r.lang for r in counts.select("lang").distinct().limit(config.most_languages + 1).collect())
    if len(names) > config.most_languages:
        raise ValueError(f"lang has more than {config.most_languages} values")
    table = counts.toArrow()
    chances = np.full((config.buckets, len(names)), config.smoothing)
    place = {name: k for k, name in enumerate(names)}
    chances[table.column("bucket").to_numpy(), [place[x] for x in table.column("lang").to_pylist()]] += table.column("n").to_numpy()
    chances /= chances.sum(axis=0)
    held = F.coalesce(fold(config.modulus) == config.held_out, F.lit(False))
    predicted = source.select("doc_id", "text").mapInArrow(_predict(names, chances, config), "doc_id long, lang_pred string, score double, mixture map<string,double>")
    return predicted.select("doc_id", held.alias("held_out"), "lang_pred", "score", "mixture")
