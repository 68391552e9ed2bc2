"""The source audit against a plain version, edge cases included."""

import random
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa

from snapweave.llm import source_audit
from snapweave.llm.source_audit import AuditConfig, audit_sources

from .test_corpus import SCHEMA, empty

LETTERS = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | set(range(128, 256))


def plain_terms(text):
    return [bytes(g).lower() for inside, g in groupby((text or "").encode(), lambda b: b in LETTERS) if inside]


def plain_audit(rows, config):
    """rows: (lang, source, text)."""
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = plain_terms(text)
        counts[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = set()
    for lang, held in documents.items():
        kept = [t for t, n in held.items() if n >= config.least_documents]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        share = lambda c: {t: 1 + config.units * (c[t] + config.added) // (sum(c[x] for x in kept) + config.added * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((q[t] - p[s][t], t) for t in kept if groups[s][t] and p[s][t] > q[t])[: config.terms]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)}
    return out


def corpus(rng, n):
    words = ["the", "The", "of", "ofs", "often", "é", "És", "中文", "中", "x1y", "don't", "a" * 50, "a" * 49 + "b"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "b", "é", None, "z"])
        text = rng.choice([None, "", "12 ..", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))]) if i else "the of " * 20_000
        rows.append((lang, source, text))
    return rows + [("lonely", "one", "never in enough documents"), ("lonely", "two", None), ("lonely", None, "x"), ("single", "s", "the")]


def test_audit(spark):
    rows = corpus(random.Random(11), 400)
    frame = spark.createDataFrame([(None if i % 7 == 0 else i // 2, t, lang, s, 1, "x", "y", "z") for i, (lang, s, t) in enumerate(rows)], SCHEMA)
    for config in (AuditConfig(), AuditConfig(least_documents=3, terms=2, block_bytes=64, trie_leaves=20), AuditConfig(least_documents=1, added=1, units=1000)):
        for parts in (1, 5):
            found = audit_sources(frame.repartition(parts), config).collect()
            assert len(found) == len(set(map(tuple, found))) and {tuple(r) for r in found} == plain_audit(rows, config), config
    assert audit_sources(empty(spark), AuditConfig()).isEmpty()


def test_terms_end_where_documents_do():
    texts = ["ab", "cd", "", "é", "中x", "9", "z"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    inside, sizes, owner = source_audit.term_spans(data, offsets)
    assert sizes.tolist() == [2, 2, 2, 4, 1] and owner.tolist() == [0, 1, 3, 4, 6] and inside.sum() == 11


def test_a_path_over_many_batches_is_one_leaf():
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("documents", pa.int64()), ("occurrences", pa.int64())])
    rows = [("en", b"a", "s", 1, 2)] * 3 + [("en", b"ab", "s", 1, 1), ("en", b"ab", "t", 2, 5)] * 4 + [("fr", b"ab", "t", 40, 41)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[k : k + 2]], schema=schema) for k in range(0, len(rows), 2)]
    found = [r for b in source_audit._merge(AuditConfig(least_documents=12))(iter(batches)) for r in b.to_pylist()]
    assert [(r["lang"], source_audit.path_terms(r["depths"], r["rests"]), dict(zip(r["sources"], r["totals"], strict=True))) for r in found] == [("en", [b"ab"], {"s": 4, "t": 20}), ("fr", [b"ab"], {"t": 41})]


def test_branches_and_shares():
    rng = random.Random(3)
    terms = sorted({bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(1, 9))) for _ in range(200)} | {b"a" * 90_000, b"a" * 90_000 + b"b"})
    depths = source_audit.branch_depths(terms)
    assert source_audit.path_terms(depths, [t[d:] for t, d in zip(terms, depths, strict=True)]) == terms
    big = [1 << 61, (1 << 61) - 3, 5, 0]
    want = [10**9 * x // (1 << 62) for x in big]
    assert source_audit.shares(np.array(big, np.int64), np.int64(1 << 62), 10**9).tolist() == want
