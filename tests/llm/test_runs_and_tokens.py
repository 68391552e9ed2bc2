"""Periodic runs and token files against plain versions, edge cases included."""

import hashlib
import io
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from snapweave.llm import periodic_runs, queries, token_files
from snapweave.llm.queries import tokenizer_path

from .test_corpus import empty, with_edges

SF = "/root/testdata/sf0.001"


# 12: runs


def plain_runs(t, least, exponent):
    """All runs from all periods."""
    n, found = len(t), set()
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and t[k] == t[k + p]:
                k += 1
            length = k + p - i
            if k > i and length >= max(least, exponent * p):
                s = t[i : i + length]
                if not any(all(s[a] == s[a + q] for a in range(length - q)) for q in range(1, p)):
                    found.add((i, length, p))
            i = max(k, i + 1)
    return sorted(found, key=lambda x: (x[0], x[2]))


def plain_lyndon(t):
    n = len(t)
    following = [next((j for j in range(i + 1, n) if t[j:] < t[i:]), n) for i in range(n)]
    return following, [0 if j == n else next((k for k in range(n) if j + k >= n or t[i + k] != t[j + k])) for i, j in enumerate(following)]


def periodic_text(rng):
    kind, n, top = rng.randrange(4), rng.randrange(60), rng.choice([1, 2, 3, 5])
    if kind == 0:
        return [rng.randrange(top) for _ in range(n)]
    if kind == 1:
        return ([rng.randrange(top) for _ in range(rng.randrange(1, 9))] * 60)[:n]
    if kind == 2:
        word, out = [rng.randrange(top) for _ in range(rng.randrange(1, 6))], []
        while len(out) < n:
            out += word * rng.randrange(1, 7) + [rng.randrange(top) for _ in range(rng.randrange(3))]
        return out
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_lyndon_arrays_and_runs():
    rng = random.Random(12)
    for _ in range(700):
        t = periodic_text(rng)
        assert periodic_runs.lyndon_array(t) == plain_lyndon(t), t
        for least, exponent in ((6, 4), (1, 2), (3, 3)):
            config = periodic_runs.RunConfig(least, exponent)
            assert periodic_runs.runs(t, config) == plain_runs(t, least, exponent), (t, config)
            both = [[b"w%d" % x for x in t], [], [b"w%d" % x for x in t[::-1]]]
            assert periodic_runs.block_runs(both, config) == [plain_runs(x, least, exponent) for x in (t, [], t[::-1])], (t, config)
    with pytest.raises(ValueError):
        periodic_runs.RunConfig(exponent=1)


class Counted(int):
    """A number that counts how often it is compared."""

    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return int(self) == int(other)

    def __gt__(self, other):
        Counted.seen += 1
        return int(self) > int(other)

    __hash__ = int.__hash__


def test_comparisons_grow_linearly():
    n = 20_000
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    for t in ([0] * n, ([0] * (n // 2 - 1) + [1]) * 2, list(range(100)) * (n // 100), b[:n], [1 - x for x in b[:n]], ([0, 1] * 50 + [0]) * (n // 101)):
        Counted.seen = 0
        periodic_runs.lyndon_array([Counted(x) for x in t])
        assert Counted.seen < 8 * n, t[:20]


def test_find_runs(spark):
    texts = ["a b a b a b a b a b c", "x " * 7 + "\x0b\x0c\r" + "y", "", None, "no run here at all", "é é " * 9, " \t\n", "k l m n " * 30_000]
    config = periodic_runs.RunConfig()
    rows = periodic_runs.find_runs(with_edges(spark, texts), config).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        if r.doc_id is not None and r.doc_id < 900:
            words = (texts[r.doc_id] or "").encode().split()
            found = [tuple(x) for x in r.runs]
            if len(words) < 1000:
                assert found == plain_runs(words, 6, 4)
            gone = {k for s, n, p in found for k in range(s + p, s + n)}
            assert r.n_words == len(words) and r.collapsed == b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
    assert [tuple(x) for r in rows if r.doc_id == 7 for x in r.runs] == [(0, 120_000, 4)]
    assert periodic_runs.find_runs(empty(spark), config).isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are absent")
def test_query_of_runs_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert set(rows) == set(texts)
    some = 0
    for doc_id, text in texts.items():
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        r = rows[doc_id]
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        codes = np.array([number[w] for w in words])
        found = set()
        for p in range(1, n // 4 + 1):  # as `plain_runs`, with one comparison of whole arrays for each period
            at = np.flatnonzero(np.diff(np.concatenate([[0], codes[:-p] == codes[p:], [0]]).astype(np.int8)))
            for s, e in zip(at[::2].tolist(), at[1::2].tolist(), strict=True):
                if e - s + p >= max(6, 4 * p) and not any((codes[s : e + p - q] == codes[s + q : e + p]).all() for q in range(1, p)):
                    found.add((s, e - s + p, p))
        found = sorted(found, key=lambda x: (x[0], x[2]))
        gone = {k for s, m, p in found for k in range(s + p, s + m)}
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2])
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want, doc_id
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
        some += bool(found)
    assert some > 5


# 13: token files


def config(**more):
    return token_files.TokenFileConfig(tokenizer_path("byte_bpe_50k.json"), **more)


def plain_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(config().tokenizer).encode_batch(texts, add_special_tokens=False)]


def block_ids(texts):
    raw = [t.encode() for t in texts]
    return [x.tolist() for x in token_files.encode_block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]), config())]


def test_encoded_blocks_equal_the_tokenizer():
    rng = random.Random(13)
    signs = "''''stmdrevlaZ  \t\n\r  　 \x85\x1c12١².,!-_éé中\U0001f600‍<|>ǅʰⅠ̀"
    for k in range(400):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(4)]
        texts[k % 4] += rng.choice(["", "", "", "<|endoftext|>", "a<|endoftext|> b"])
        assert block_ids(texts) == plain_ids(texts), texts
    with pytest.raises(ValueError):
        token_files.check_words(token_files.TokenFileConfig(tokenizer_path("word_bpe_49k.json")))


@pytest.mark.parametrize("top", [1, 2, 50_000, 70_000, 2**32 - 1])
def test_files_give_back_their_ids(top):
    rng = random.Random(top)
    for n in (0, 1, 511, 512, 513, 30_000):
        ids = np.array([rng.randrange(top) if rng.random() < 0.95 else top for _ in range(n)], np.uint32)
        out, k, sizes = io.BytesIO(), 0, []
        writer = token_files.TokenFileWriter(out, 512, 0.9, 4)
        while k < n:
            sizes.append(min(n - k, rng.choice([0, 1, 30, 9000])))
            writer.add(None if k % 3 == 0 else -k, ids[k : k + sizes[-1]])
            k += sizes[-1]
        writer.close()
        file = token_files.TokenFile(pa.BufferReader(out.getvalue()))
        assert np.diff(file.doc_starts.astype(int)).tolist() == sizes
        assert np.concatenate([np.zeros(0, np.uint32), *(x for _, _, x in file.documents(1000))]).tolist() == ids.tolist()
        for _ in range(20):
            a = rng.randrange(n + 1)
            b = rng.randrange(a, n + 1)
            assert (file.ids(a, b) == ids[a:b]).all()


def test_outliers_are_exceptions_and_damage_is_seen():
    ids = np.arange(4096, dtype=np.uint32) % 16 + 1000
    ids[::100] = 2**32 - 1
    (block,) = token_files.encode_blocks(ids, 4096, 0.9)
    low, width, odd = token_files.HEAD.unpack_from(block)
    assert (low, width, odd) == (1000, 4, 41) and len(block) == token_files.HEAD.size + 4096 * 4 // 8 + 41 * 8
    out = io.BytesIO()
    writer = token_files.TokenFileWriter(out, 512, 0.9)
    writer.add(1, ids)
    writer.close()
    data = bytearray(out.getvalue())
    data[-40] ^= 1
    with pytest.raises(ValueError):
        token_files.TokenFile(pa.BufferReader(bytes(data)))


def test_token_files(spark):
    texts = ["Some text, it's here", "", None, "x\n\n  y 12 ", "word " * 40_000, "<|endoftext|>", "中文" * 500]
    docs = with_edges(spark, texts)
    files = token_files.write_token_files(docs, config(file_ids=1, block_ids=64))
    rows = files.documents().orderBy("start").collect()
    source = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    assert [r.doc_id for r in rows] == [x[1] if x[0] else None for x in source]
    ids = [x + [0] for x in plain_ids([x[2] for x in source])]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == ids
    assert [r.n_tokens for r in rows] == [len(x) for x in ids] and [r.start for r in rows] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert files.files.count() > 3
    assert token_files.write_token_files(empty(spark), config()).documents().isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are absent")
def test_query_of_token_files_against_the_tokenizer(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, start = [], 0
    for (doc_id, _), ids in zip(docs, plain_ids([t for _, t in docs]), strict=True):
        want.append((doc_id, start, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
        start += len(ids) + 1
    assert sorted(map(tuple, queries.op13_token_files(spark, SF).collect())) == want
