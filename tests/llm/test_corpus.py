"""Every operator against a plain version on small tables, edge cases included."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapweave.llm import decontaminate, embedding_dedup, language_id, license_scan, labels, line_dedup, near_dedup, packing, quality, substring_dedup, textbits, toxicity
from snapweave.llm.common import connected_components
from snapweave.llm.queries import tokenizer_path
from snapweave.storage import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lows string, label string, lost string"


def documents(spark, texts, sources=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, None if sources is None else sources[i % len(sources)], len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def with_edges(spark, texts):
    """Also a null id, a repeated row and a document that has everything null."""
    base = documents(spark, texts)
    extra = [(None, "a null id with some words in it", None, None, None, None, None, None), (0, texts[0], "en", None, 1, "x", "y", "z"), (900, None, None, None, None, None, None, None)]
    return base.unionByName(spark.createDataFrame(extra, SCHEMA))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.component for r in connected_components(Scratch(spark, "t"), frame).collect()}
    assert found == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(Scratch(spark, "t"), frame.limit(0)).isEmpty()


# 1: lines


def plain_lines(texts):
    """doc_id -> (lines, dropped, text) by the contract."""
    strip = " \t\n\x0b\x0c\r"
    lower = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(strip).translate(lower)
    owners = defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owners[key(line)].add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


LINES = ["A repeated LINE here\nown text of zero\nA repeated LINE here", "\t a repeated line HERE \x0b\nshort\nshort", "", None, "ééééééééé\nÉÉÉÉÉÉÉÉÉÉ\n\n\n", "ÉÉÉÉÉÉÉÉÉÉ\nééééééééé", "one line only, long enough", "x\n" * 3000 + "one line only, LONG enough"]


def test_line_dedup(spark):
    found = line_dedup.dedup_lines(with_edges(spark, LINES)).collect()
    want = plain_lines(dict(enumerate(LINES)) | {900: None})
    assert len(found) == len(LINES) + 3
    for r in found:
        if r.doc_id is not None:
            n, gone, text = want[r.doc_id]
            assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest()), r.doc_id
        else:
            assert r.n_dropped == 0
    assert line_dedup.dedup_lines(empty(spark)).isEmpty()
    docs = documents(spark, LINES)
    rows = {r.doc_id: r for r in line_dedup.loaded(docs).rewrite(docs).collect()}
    assert all(rows[i].text == (None if t is None else want[i][2]) and rows[i].lows == "x" for i, t in enumerate(LINES))


def test_line_dedup_is_reversible(spark):
    docs = documents(spark, LINES + [f"line number {i} of many\ncommon line of all" for i in range(40)])
    late = F.col("doc_id") % 3 == 0
    state = line_dedup.LineDedup(spark)
    state.insert(docs.where(~late))
    counts = lambda s: {(r.low, r.high): (r.documents, r.lines, r.first_doc) for r in s.reference_counts().collect()}
    view = lambda s, d: {tuple(r) for r in s.apply(d).collect()}
    before, seen = counts(state), view(state, docs.where(~late))
    state.insert(docs.where(late))
    assert view(state, docs) == {tuple(r) for r in line_dedup.dedup_lines(docs).collect()}
    state.delete(docs.where(late))
    assert counts(state) == before and view(state, docs.where(~late)) == seen
    fill = lambda s: sum(int((line_dedup.CuckooFilter.from_bytes(bytes(r.data)).table > 0).sum()) for r in s.filters.collect())
    assert fill(state) == len(before)


def probe(made, filters, kind, low, high, generation=None):
    """One shard through `_probe`: (filters, keys that may be known)."""
    n = len(low)
    lists = [[0] * n, [kind] * n, [generation] * n, low, high, [False] * n, [None] * n]
    keys = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(lists, line_dedup._KINDS.values(), strict=True)], names=list(line_dedup._KINDS))
    out = list(line_dedup._probe(made)(iter([*filters, keys])))
    kinds = [b.column("kind").to_pylist() for b in out]
    return [b for b, k in zip(out, kinds, strict=True) if k == [0]], sum(k.count(1) for k in kinds)


@pytest.mark.parametrize("bits", [16, 5])
def test_deletion_takes_no_other_fingerprint(monkeypatch, bits):
    """Also with fingerprints of a few bits, where every filter seems to hold most keys."""
    whole = line_dedup.CuckooFilter._places

    def short(self, low, high):
        mark, bucket = whole(self, low, high)
        return mark % np.uint16(1 << bits - 1) + np.uint16(1), bucket

    if bits < 16:
        monkeypatch.setattr(line_dedup.CuckooFilter, "_places", short)
    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(-(2**62), 2**62, (2, 400_000 if bits == 16 else 3000)) for _ in range(3))
    filters, _ = probe(1, [], 2, *a)
    for made, batch in ((2, b), (3, c)):
        filters, _ = probe(made, filters, 2, *batch)
    filters, _ = probe(4, filters, 3, *b, generation=2)
    filters, _ = probe(5, filters, 3, *c, generation=3)
    assert [f.column("generation").to_pylist() for f in filters] == [[1]]
    assert probe(6, filters, 1, *a)[1] == a.shape[1]


def test_line_dedup_insert_delete_insert(spark):
    rng = random.Random(30)
    texts = [f"{sentence(rng, 4, 30)}\n{sentence(rng, 3, 12)}\n{sentence(rng, 3, 12)}" for _ in range(200)]
    docs = documents(spark, texts)
    part = lambda k: docs.where(F.col("doc_id") % 4 == k)
    state = line_dedup.LineDedup(spark, most_generations=5)
    for k in range(4):
        state.insert(part(k))
    state.delete(part(0).union(part(2)))
    state.insert(part(2))
    state.delete(part(1))
    state.insert(part(0).unionByName(part(1)))
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in state.apply(docs).collect()}
    assert found == {i: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, (n, gone, t) in plain_lines(dict(enumerate(texts))).items()}
    keys = state.references.select("low", "high").distinct().count()
    assert sum(int((line_dedup.CuckooFilter.from_bytes(bytes(r.data)).table > 0).sum()) for r in state.filters.collect()) == keys
    state.compact()
    assert state.references.select("generation").distinct().count() == 1 and sum(int((line_dedup.CuckooFilter.from_bytes(bytes(r.data)).table > 0).sum()) for r in state.filters.collect()) == keys


def test_structured_strings_have_hashes_of_their_own():
    """The two strings whose difference has a high power of two as a factor at every odd base."""
    for n in (1024, 4096):
        turn = np.array([bin(k).count("1") % 2 for k in range(n)], np.uint8)
        data = np.concatenate([turn + 97, 98 - turn]).astype(np.uint8)
        hashes = textbits.word_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        _, _, _, low, high, _ = line_dedup.line_keys(data, np.array([0, n, 2 * n]), 10)
        assert len(set(hashes.tolist())) == len(set(low.tolist())) == len(set(high.tolist())) == 2


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    low, high = rng.integers(-(2**62), 2**62, (2, 20_000))
    one = line_dedup.CuckooFilter.of(low, high)
    assert one.has(low, high).all()
    assert one.has(*rng.integers(-(2**62), 2**62, (2, 20_000))).mean() < 0.002
    assert one.remove(low[:500], high[:500]).all() and one.has(low[500:], high[500:]).all()
    assert one.has(low[:500], high[:500]).mean() < 0.01


# 2: licences


def test_license_scan(spark):
    rng = random.Random(2)
    mit = license_scan.TEMPLATES["MIT"][1]
    edited = mit.replace("granted", "given")  # 5 of its 16 shingles change
    texts = [sentence(rng, 300) + "\nReleased under the MIT License.\n" + sentence(rng, 50), sentence(rng, 20) + " " + mit, edited, "Licensed under CC BY-NC 4.0.", "released under the MIT", "", None, sentence(rng, 5000), "RELEASED, under (the) mit license!"]
    found = {(r.doc_id, r.license): r for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    assert set(found) == {(0, "MIT"), (1, "MIT"), (3, "CC-BY-NC-4.0"), (8, "MIT")}
    assert found[(0, "MIT")].first_word == 300 and found[(1, "MIT")].containment == 1.0
    assert license_scan.scan_licenses(empty(spark)).isEmpty()
    assert license_scan.scan_licenses(with_edges(spark, texts)).count() == 5


def words_of(index, text):
    hashes = index.hashes([x.encode() for x in text.split()])
    return hashes[hashes != 0]


def test_license_windows_find_all_places():
    """Whatever surrounds a template, wherever it stands and with a word changed, its window is retrieved."""
    rng = random.Random(4)
    config = license_scan.LicenseScanConfig()
    index = license_scan.Index([(k, t) for k, ts in license_scan.TEMPLATES.items() for t in ts], config)
    for name, templates in license_scan.TEMPLATES.items():
        for template in templates:
            changed = template.split()
            if len(changed) > 60:
                changed[rng.randrange(len(changed))] = "changed"
            for _ in range(4):
                texts = [f"{sentence(rng, rng.randrange(60))} {' '.join(changed)} {sentence(rng, rng.randrange(60))}" for _ in range(3)]
                parts = [words_of(index, t) for t in texts]
                found = index.scan(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
                assert {(k, name) for k in range(3)} <= {x[:2] for x in found}, (name, texts)


def test_license_scan_equals_containment_at_every_place():
    """Against the shingle sets of all stretches of a template's length and a half, in edited copies of whole licences."""
    rng = random.Random(40)
    config = license_scan.LicenseScanConfig()
    index = license_scan.Index([(k, ts[-1]) for k, ts in license_scan.TEMPLATES.items()], config)
    for share in (0.0, 0.01, 0.02, 0.04, 0.3):
        for name, ts in license_scan.TEMPLATES.items():
            text = " ".join("edited" if rng.random() < share else w for w in ts[-1].split())
            hashes = words_of(index, f"{sentence(rng, rng.randrange(90))} {text} {sentence(rng, rng.randrange(90))}")
            found = {x[1]: x[2] for x in index.scan(hashes, np.array([0, len(hashes)]))}
            items = license_scan.shingles(hashes, config.width)
            for other, whole in zip(index.names, index.sets, strict=True):
                span = 3 * len(whole) // 2
                plain = max(np.isin(whole, items[k : k + span]).mean() for k in range(max(1, len(items) - span + 1)))
                assert other not in found or found[other] >= 0.8
                assert plain < 0.8 or other in found, (name, other, share, plain)
                assert other not in found or plain < 0.8 or found[other] >= plain - 1e-9


# 3: languages


def speech(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_mixture(spark):
    rng = random.Random(3)
    kinds = {"aa": ["ban", "dor", "kip"], "bb": ["lou", "éve", "mi"], "cc": ["zta", "sch", "öp"]}
    rows = [(i, speech(rng, kinds[k], 60), k) for i, k in enumerate(sorted(kinds) * 40)]
    rows += [(500, speech(rng, kinds["aa"], 120) + " " + speech(rng, kinds["bb"], 60), None), (501, None, "aa"), (502, "1234 --", None), (503, "", None), (504, "ba", None), (None, speech(rng, kinds["bb"], 9), "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.language_mixture(docs).collect()
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == k for i, _, k in rows[:120])
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows[:120])
    assert by[500].lang_pred == "aa" and set(by[500].mixture) == {"aa", "bb"} and by[500].mixture["aa"] == pytest.approx(2 / 3, abs=0.08)
    assert [by[i].lang_pred for i in (501, 502, 503)] == ["und"] * 3 and by[502].score == 0
    assert by[504].lang_pred in kinds and by[None].held_out is False and len(found) == len(rows)
    assert {r.lang_pred for r in language_id.language_mixture(docs.withColumn("lang", F.lit(None))).collect()} == {"und"}
    assert language_id.language_mixture(docs.limit(0)).isEmpty()
    clash = docs.union(docs.limit(3)).withColumn("bucket", F.lit("x")).withColumn("n", F.lit("y")).withColumn("score", F.lit("z"))
    assert language_id.language_mixture(clash).count() == len(rows) + 3
    with pytest.raises(ValueError, match="more than 2 values"):
        language_id.language_mixture(docs, language_id.LanguageConfig(most_languages=2))


def test_mixture_equals_plain_em():
    """Responsibilities trigram by trigram, and the best of all language sets that the ranking allows."""
    rng = np.random.default_rng(34)
    config = language_id.LanguageConfig(rounds=12)
    for _ in range(20):
        chances = rng.dirichlet(np.full(30, 0.5), 4).T + 1e-4
        chances /= chances.sum(0)
        counts = rng.poisson(40 * chances @ rng.dirichlet([0.4] * 4)).astype(float) + (rng.random(30) < 0.1)

        def em(some, chances=chances, counts=counts):
            share = [1 / len(some)] * len(some)
            for _ in range(config.rounds if len(some) > 1 else 0):
                new = [0.0] * len(some)
                for t, n in enumerate(counts):
                    whole = sum(share[k] * chances[t, s] for k, s in enumerate(some))
                    for k, s in enumerate(some):
                        new[k] += n * share[k] * chances[t, s] / whole
                share = [x / counts.sum() for x in new]
            return share, sum(n * math.log(sum(share[k] * chances[t, s] for k, s in enumerate(some))) for t, n in enumerate(counts))

        share, _ = em(range(4))
        assert np.allclose(language_id.mixture(counts, chances, config.rounds)[0], share)
        order = sorted(range(4), key=lambda k: -share[k])
        penalty = 0.5 * math.log(counts.sum())
        best, value = max((([k], em([k])[1] - penalty) for k in range(4)), key=lambda x: x[1])
        for k in range(2, sum(x >= config.least_share for x in share) + 1):
            now = em(order[:k])[1] - k * penalty
            if now <= value:
                break
            best, value = order[:k], now
        assert set(np.flatnonzero(language_id.choose_languages(counts, chances, config))) == set(best)


# 4: quality


def test_quality(spark):
    rng = random.Random(6)
    good = [sentence(rng, 60) for _ in range(90)]
    bad = [" ".join(x + "###" for x in sentence(rng, 40).split()) for _ in range(45)] + [("again " * 80).strip() for _ in range(45)]
    texts = [x for pair in zip(good, bad, strict=True) for x in pair] + ["", None, sentence(rng, 30_000)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(180)] + [(3, None, None), (777, 5, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = [i for i in range(180) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out for i in held) and sum(r.held_out for r in found.values() if r.doc_id < 180) == len(held)
    assert sum(found[i].predicted == 1 - i % 2 for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values()) and len(found) == len(texts)
    assert found[182].predicted == 1
    assert quality.quality(empty(spark), labels).isEmpty() and quality.quality(docs, labels.limit(0)).count() == len(texts)


def test_quality_network_equals_plain_convolution():
    """Scores by loops over filters, places and chunks, and gradients by differences."""
    config = quality.QualityConfig(filters=3, width=4, chunk=16, overlap=5)
    network = quality.ByteNetwork(config)
    rng = np.random.default_rng(8)
    texts = [rng.integers(97, 105, n).astype(np.uint8) for n in (0, 3, 16, 40, 90)]
    for name in ("taps", "bias", "out"):
        setattr(network, name, getattr(network, name).astype(np.float64))

    def plain(text):
        starts = range(0, max(len(text) - 5, 1), 11)
        padded = text.tolist() + [32] * 60
        best = [[max(sum(network.taps[k, padded[s + p + k], f] for k in range(4)) for p in range(16)) for f in range(3)] for s in starts]
        active = np.maximum(np.array(best) + network.bias, 0)
        return 1 / (1 + np.exp(-(np.concatenate([active.mean(0), active.max(0)]) @ network.out + network.shift)))

    assert all(network.score(t) == pytest.approx(plain(t), rel=1e-6) for t in texts)
    labels = np.array([0, 1, 1, 0, 1])
    loss = lambda: -np.mean([np.log(p if y else 1 - p) for p, y in zip(map(plain, texts), labels, strict=True)])
    grads = network.gradients([network.padded(t) for t in texts], labels)
    for name, at in (("taps", (1, 99, 0)), ("taps", (3, 100, 2)), ("taps", (0, 101, 1)), ("bias", (1,)), ("out", (0,)), ("out", (4,))):
        values, step = getattr(network, name), 1e-5
        values[at] += step
        up = loss()
        values[at] -= 2 * step
        down = loss()
        values[at] += step
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6), name


def test_quality_chunks_cover_the_text():
    network = quality.ByteNetwork(quality.QualityConfig())
    for n in (0, 1, 31, 32, 33, 255, 256, 257, 480, 481, 5000):
        starts = network.chunks(n)
        assert starts[0] == 0 and starts[-1] + 256 >= n and (np.diff(starts) == 224).all()


# 5: vectors


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(60):
        base = rng.standard_normal(32)
        rows += [(len(rows) + j, (base + 0.11 * j * rng.standard_normal(32)).astype(np.float32).tolist(), k % 3) for j in range(5)]
    rows += [(1000 + j, rows[3][1], 0) for j in range(6)] + [(2000, rows[3][1], None), (2001, None, 0), (2002, [0.0] * 32, 0), (2003, [float("nan")] * 32, 0), (2004, [1.0, None], 0), (2005, [], 0), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    usable = {i: np.array(v, float) for i, v, label in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    labels = {i: label for i, _, label in rows}
    links = defaultdict(set)
    for a, x in usable.items():
        for b, y in usable.items():
            if a != b and labels[a] == labels[b] and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98:
                links[a].add(b)
    want = {}
    for i in {r[0] for r in rows if r[0] is not None}:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        want[i] = (len(links[i]), min(seen))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    found = embedding_dedup.embedding_duplicates(frame, embedding_dedup.EmbeddingDedupConfig(block=4, bucket=8)).collect()
    assert len(found) == len(rows) and sum(x[0] > 0 for x in want.values()) > 50
    assert {r.vec_id: (r.n_links, r.component_id) for r in found if r.vec_id is not None} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)
    assert embedding_dedup.embedding_duplicates(frame.limit(0)).isEmpty()
    twice = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 2.0], 0), (3, [-1.0, 0.0], 0)]  # a repeated row, and an id with two vectors
    again = embedding_dedup.embedding_duplicates(spark.createDataFrame(twice, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(tuple(r) for r in again) == [(1, 1, 1, True)] * 3 + [(2, 1, 1, False), (3, 0, 3, True)]


# 6: substrings


def plain_repeats(texts, length):
    bodies = {i: (t or "").encode() for i, t in texts.items()}
    count = Counter(b[k : k + length] for b in bodies.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in bodies.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("block", [1 << 12, 200])
def test_substring_dedup(spark, block):
    """With blocks of 200 bytes nearly all anchors are split into pairs of starts."""
    rng = random.Random(8)
    passage = sentence(rng, 30)
    texts = [sentence(rng, 40) for _ in range(6)] + [sentence(rng, rng.randrange(20)) + passage + sentence(rng, rng.randrange(20)) for _ in range(9)]
    texts += ["For " * 200, "ab" * 300, "é" * 400, texts[0], texts[0], "", None, passage[:60], sentence(rng, 40) + passage[:70] + "X" + passage[71:]]
    whole = sentence(rng, 120)  # copied in a row, at two places of one text too
    texts += [whole + "\n" + sentence(rng, 9) + whole, sentence(rng, 7) + whole[40:500] + sentence(rng, 7), whole[100:]]
    config = substring_dedup.SubstringDedupConfig(length=50, seed=20, block_bytes=block, anchor_bytes=block, run_bytes=97)
    found = {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeats(documents(spark, texts), config).collect()}
    assert found == plain_repeats(dict(enumerate(texts)), 50)


def test_substring_edges(spark):
    texts = ["x" * 300, "short", "", None]
    rows = substring_dedup.remove_repeats(with_edges(spark, texts)).collect()
    assert len(rows) == len(texts) + 3 and all(r.n_removed == (300 if r.doc_id == 0 else 0) for r in rows)
    assert substring_dedup.remove_repeats(empty(spark)).isEmpty()


def test_interval_expansion():
    rng = random.Random(9)
    for trial in range(60):
        length = rng.choice([2, 3, 7])
        strings = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randrange(length, 40))) for _ in range(rng.randrange(1, 8))]
        count = Counter(s[k : k + length] for s in strings for k in range(len(s) - length + 1))
        want = [x for s in strings for x in [k <= len(s) - length and count[s[k : k + length]] > 1 for k in range(len(s))] + [False]]
        assert substring_dedup.repeated_starts(strings, length).tolist() == want


# 7: test items


def test_decontamination(spark):
    rng = random.Random(10)
    items = {k: sentence(rng, 30, 3000) for k in range(12)}
    edit = lambda t, every: " ".join("edited" if k % every == every - 1 else w for k, w in enumerate(t.split()))
    noise = lambda n: sentence(rng, n, 3000)
    texts = [noise(50) + " " + items[0] + " " + noise(9), items[1].upper().replace(" ", ", "), noise(20) + " " + edit(items[2], 6) + " " + noise(5), noise(400), "", None, " ".join(items[3].split()[:6]) + " " + noise(60), items[4] + " " + noise(100) + " " + items[5], noise(9000) + " " + items[6], noise(15) + " " + edit(" ".join(items[8].split()[:26]), 4) + " " + noise(15)]
    bench = spark.createDataFrame(list(items.items()) + [(50, None), (51, ""), (None, items[7]), (52, "--")], "item_id long, text string")
    want = {(0, 0), (1, 1), (2, 2), (7, 4), (7, 5), (8, 6), (9, 8)}
    docs = documents(spark, texts)
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) == want and found[(0, 0)].score == 1.0 and (found[(0, 0)].first_word, found[(0, 0)].end_word) == (50, 80)
    assert 0.5 <= found[(9, 8)].score < 0.6  # a quarter of the words edited, four left out
    small = decontaminate.DecontaminationConfig(slice_bytes=300)  # several slices
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, small).collect()} == want
    assert {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()} == set(range(10)) - {0, 1, 2, 7, 8, 9}
    assert decontaminate.contaminated(empty(spark), bench).isEmpty() and decontaminate.contaminated(docs, bench.limit(0)).isEmpty()
    assert decontaminate.contaminated(with_edges(spark, texts), bench).count() == len(want) + 1


def test_decontamination_of_exact_and_edited_copies_together(spark):
    rng = random.Random(21)
    items = {k: sentence(rng, n, 3000) for k, n in enumerate([30, 38, 48, 40])}
    edit = lambda t, every: " ".join("edited" if k % every == every - 1 else w for k, w in enumerate(t.split()))
    noise = lambda: sentence(rng, 40, 3000)
    texts, want = [], set()
    for k, item in items.items():
        for copy in [item, edit(item, 4), edit(item, 5)] + [edit(item, 4)] * 3 + [item] * (k % 2):
            want.add((len(texts), k))
            texts.append(noise() + " " + copy + " " + noise())
    texts += [noise() + " " + " ".join(items[0].split()[:8]) + " " + noise() for _ in range(5)]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, texts), bench).collect()} == want


def test_short_items_are_found_anywhere(spark):
    bench = spark.createDataFrame([(0, "photosynthesis"), (1, "water boils"), (2, "why water boils")], "item_id long, text string")
    texts = ["a word on Photosynthesis, and that water boils", "boils water", "photosynthesis", "Why water boils!", "nothing of it", "water boils"]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, texts), bench).collect()}
    assert found == {(0, 0), (0, 1), (2, 0), (3, 1), (3, 2), (5, 1)}


@pytest.mark.parametrize("size", [8, 16, 40, 120])
def test_decontamination_recall_on_edited_copies(size):
    """Against the alignment of whole texts: of the copies that reach the threshold, at least nine in ten are found, whatever the edits."""
    rng = random.Random(size)
    config = decontaminate.DecontaminationConfig()
    want = hit = 0
    for share in (0.05, 0.1, 0.2, 0.3):
        rows, texts = [], []
        for k in range(60):
            words = sentence(rng, size, 3000).split()
            rows.append((k, " ".join(words)))
            copy = []
            for w in words:  # words go, change, or have another put before them
                turn = rng.random() / share
                copy += [] if turn < 0.3 else ["changed"] if turn < 0.7 else ["extra", w] if turn < 1 else [w]
            texts.append(f"{sentence(rng, 30, 3000)} {' '.join(copy)} {sentence(rng, 30, 3000)}")
        items = decontaminate.Items(rows, config.seed_words)
        batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        found = {(r["doc_id"], r["item_id"]): r["score"] for b in decontaminate._matches(items, config)(iter([batch])) for r in b.to_pylist()}
        for k in range(60):
            numbers = np.array([items.vocabulary.get(w, -1) for w in texts[k].split()])
            score = decontaminate.align(items.words[k], numbers, config)[0] / (2 * size)
            if score >= 0.5:
                want += 1
                hit += found.get((k, k), 0) == score
        assert all(a == b for a, b in found)
    assert want > 100 and hit >= 0.9 * want


def test_decontamination_bounds_lose_no_alignment():
    rng = random.Random(22)
    config = decontaminate.DecontaminationConfig()
    for _ in range(300):
        item, text = (np.array([rng.randrange(9) for _ in range(rng.randrange(1, n))]) for n in (12, 60))
        score = decontaminate.align(item, text, config)[0]
        if score:
            parts = decontaminate.stretches(np.isin(text, item), score, config)
            assert max(decontaminate.align(item, text[a:b], config)[0] for a, b in parts) == score


def test_alignment_equals_plain():
    rng = random.Random(11)
    config = decontaminate.DecontaminationConfig()
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontaminate.align(np.array(a), np.array(b), config)[0] == max(map(max, h))


def test_odd_rows_of_labelled_and_packed_documents(spark):
    """Null ids, a repeated row, and columns whose names the operators use inside: a row each, scored and packed alike."""
    texts = [f"{sentence(random.Random(k), 20)}" for k in range(12)] + ["", None]
    docs = with_edges(spark, texts).withColumn("score", F.lit("x")).withColumn("held_out", F.lit("x")).withColumn("queue", F.lit("x")).withColumn("ids", F.lit("x"))
    marks = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)] + [(0, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for found in (quality.quality(docs, marks).collect(), toxicity.toxicity(docs, marks).collect()):
        assert len(found) == len(texts) + 3 and [r.held_out for r in found if r.doc_id is None] == [False]
        assert len({(r.score, r.predicted) for r in found if r.doc_id == 0}) == 1
    pieces = packing.pack(docs, packing.PackingConfig(tokenizer_path("word_bpe_49k.json"), window=64)).collect()
    whole = Counter()
    for r in pieces:
        whole[r.doc_id] += r.length
    assert set(whole) == {None, 900, *range(14)} and whole[900] == 1 and whole[13] == 1
    assert whole[0] == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 0)
    both = labels.labelled_sample(docs.select("doc_id", "text").limit(5), marks, "toxic", 4, 9, 99, 1 << 15)
    assert sorted(y for t, y in both if t == texts[0]) == [1]  # both labels are given: 1 counts


# 4, 8: labelled samples


def test_long_labelled_texts_are_learned_from_in_pieces(spark):
    long = " ".join(f"wörd{k}" for k in range(3000))
    docs = documents(spark, [long, "a short text", None] + [long] * 5)
    marks = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    sample = labels.labelled_sample(docs, marks, "toxic", 4, 9, 8, 4000)
    assert len(sample) == 7 and ("a short text", 1) in sample and sum(y for _, y in sample) == 4
    words = long.split()
    for text in (t for t, _ in sample if t != "a short text"):
        assert len(text.encode()) <= 4000 and set(text.split()) <= set(words) and text.split()[0] == words[0] and text.split()[-1] == words[-1]
        places = sorted(words.index(w) for w in text.split())
        assert max(b - a for a, b in zip(places, places[1:], strict=False)) < 500 and len(places) > 300
    huge = labels.labelled_sample(documents(spark, ["some words " * 30_000]), marks, "toxic", 4, 9, 8, 1 << 15)
    assert [(30_000 < len(t) <= 1 << 15, y) for t, y in huge] == [(True, 0)]
    assert (quality.fit_quality([], quality.QualityConfig()).out == 0).all()


# 8: toxicity


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = ["idiot", "pathetic", "scum", "worthless", "bad*"]
    automaton = toxicity.LexiconAutomaton(terms)
    rng = random.Random(12)
    for _ in range(3000):
        word = list(rng.choice(terms).rstrip("*"))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "x", "i", "t"])
        word = "".join(word)
        near = [(distance(word, t), k) for k, t in enumerate(terms[:4]) if distance(word, t) <= toxicity.edit_budget(t)]
        found = automaton.match(word)
        if near and min(near)[0] == 0:
            assert found == (min(near)[1], 0)
        elif word.startswith("bad"):
            assert found == (4, 0)
        else:
            assert found == ((min(near)[1], min(near)[0]) if near else (-1, 0)), word


def test_toxicity(spark):
    rng = random.Random(13)
    insult = ["blockhead", "nitwitted"]
    texts = [sentence(rng, 40) + (f" you {rng.choice(insult)} and {rng.choice(insult)} " + sentence(rng, 5) if i % 4 == 0 else "") for i in range(240)]
    texts += [sentence(rng, 30) + " you blokhead", sentence(rng, 30), "", None, sentence(rng, 20_000)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(found[i].predicted == (i % 4 == 0) for i in range(240)) and found[240].score > 10 * found[241].score
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in found)
    assert len(found) == len(texts) and all(0 <= r.score <= 1 for r in found.values()) and found[242].predicted == 0
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {i for i, r in found.items() if not r.predicted}
    assert toxicity.toxicity(empty(spark), labels).isEmpty()
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_quotation_counts_less():
    model = toxicity.ToxicityModel(["blockhead"], toxicity.ToxicityConfig(), cues=frozenset(["wort"]))
    of = lambda t: model.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    for text in ("she is a blockhead today", 'that "big old house" of a blockhead', 'a " blockhead with no end of it at all in sight'):
        assert of(text)[0] > 0 and of(text)[4] == 0, text
    for text in ('he said "you are a blockhead" yesterday', "das Wort blockhead ist alt", "« blockhead »", 'the "blockhead" then'):
        assert of(text)[0] == 0 and of(text)[4] > 0, text


def test_cues_are_learned():
    rng = random.Random(33)
    sample = [(f"{sentence(rng, 9)} vous blockhead {sentence(rng, 5)}", 1) for _ in range(60)] + [(f"{sentence(rng, 9)} le mot blockhead {sentence(rng, 5)}", 0) for _ in range(6)] + [(sentence(rng, 15), 0) for _ in range(900)]
    model = toxicity.fit_toxicity(sample, toxicity.ToxicityConfig(ratio=5.0))
    assert "blockhead" in model.terms and {"le", "mot"} <= model.cues and "vous" not in model.cues


# 9: near duplicates


def plain_near(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark):
    rng = random.Random(14)
    texts = []
    for _ in range(12):
        base = sentence(rng, 80, 9000).split()
        for step in range(5):
            copy = list(base)
            for _ in range(step):
                copy[rng.randrange(80)] = "changed"
            texts.append(" ".join(copy))
    texts += ["One two", "one  TWO", "one two three four", "", None, " \t\n", "É one two three", "é one two three", texts[0], texts[0]]
    config = near_dedup.NearDedupConfig(width=4, block=8)
    found = near_dedup.near_duplicates(documents(spark, texts), config).collect()
    want = plain_near(dict(enumerate(texts)), 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want and all(r.kept == (r.doc_id == r.component_id) for r in found)
    extra = near_dedup.near_duplicates(with_edges(spark, texts), config).collect()
    assert len(extra) == len(texts) + 3 and [r.kept for r in extra if r.doc_id is None] == [True]
    assert near_dedup.near_duplicates(empty(spark)).isEmpty()


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(15)
    items = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = items[:3000], items[1000:]
    left, right = (near_dedup.set_sketch(x, 1024, 1.001) for x in (a, b))
    assert (near_dedup.merge_sketches(left, right) == near_dedup.set_sketch(items, 1024, 1.001)).all()
    n = np.array([3000.0])
    estimate = near_dedup.joint_estimate(n, n, np.array([(left > right).sum()]), np.array([(left < right).sum()]), 1024, 1.001)
    assert estimate[0] == pytest.approx(0.5, abs=0.06)
    sizes = [rng.integers(1, 3000, 400).astype(float) for _ in range(2)]
    above, below = rng.multinomial(112, [0.25, 0.2, 0.55], 400)[:, :2].T
    best = near_dedup.joint_estimate(*sizes, above, below, 112, 1.001)
    told = near_dedup.joint_at_least(0.5, *sizes, above, below, 112, 1.001)
    assert (told == (best >= 0.5))[np.abs(best - 0.5) > 0.01].all() and 50 < told.sum() < 350


# 10: packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(16)
    texts = [sentence(rng, rng.randrange(200)) + rng.choice(["", ".", ", Don't stop. É, it's <|endoftext|> fine.", " A.B,c…. x"]) for _ in range(120)] + ["", None, sentence(rng, 9000)]
    docs = documents(spark, texts, ["a", "b", "b", "b", "c", None])
    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.pack(docs, packing.PackingConfig(path, window=256)).collect()
    ids = [x.ids + [2] for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    at, windows = Counter(), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        at[r.doc_id] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
    assert all(at[i] == len(x) for i, x in enumerate(ids))
    for pieces in windows.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
    sizes = [sum(n for _, n in windows[k]) for k in range(len(windows))]
    assert set(sizes[:-1]) == {256} and sizes[-1] <= 256
    assert packing.pack(empty(spark), packing.PackingConfig(path)).isEmpty()


@pytest.mark.parametrize("weights, first", [({"a": 1, "b": 1}, "ab"), ({"a": 1, "c": 1}, "ac"), ({"a": 1, "rest": 1}, "abc"), ({"a": 1, "b": 1, "rest": 0.0001}, "ab")])
def test_stated_weights_hold_beside_a_tiny_source(spark, weights, first):
    rng = random.Random(23)
    source = {k: "a" if k < 30 else "b" if k < 40 else "c" for k in range(41)}
    texts = [sentence(rng, 90) if k < 40 else "x" for k in range(41)]
    docs = documents(spark, texts).drop("source").join(spark.createDataFrame(list(source.items()), "doc_id long, source string"), "doc_id")
    rows = packing.pack(docs, packing.PackingConfig(tokenizer_path("word_bpe_49k.json"), window=256, weights=weights)).collect()
    sizes = {r.doc_id: r.doc_tokens for r in rows}
    assert sum(r.length for r in rows) == sum(sizes.values()) and sizes[40] * 256 < sum(sizes.values())
    window = Counter()
    for r in rows:
        if r.sequence_id == 0:
            window[source[r.doc_id]] += r.length
    assert set(window) == set(first)
    if "b" in first:
        assert abs(window["a"] - window["b"]) <= 2
    else:
        assert window["c"] == sizes[40]


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 1, "c": 2}, {"a": 0.5}])
def test_mixture_is_kept(weights):
    totals = {"a": 5000, "b": 20_000, "c": 1500}
    phases = packing.schedule(totals, weights)
    served = Counter()
    for p in phases:
        assert p.first == served.total() and [served[n] for n in p.names] == p.taken
        served.update(dict(zip(p.names, p.served, strict=True)))
    assert served == totals
    if weights == {"a": 1, "b": 1, "c": 2}:
        assert phases[0].served == [750, 750, 1500]


def plain_round_robin(totals, window):
    """Tokens of each queue by window: what is owed and carried, whole tokens first, then the largest remainders."""
    size, served, out = sum(totals.values()), Counter(), []
    for x in [*range(window, size, window), size]:
        owed = {k: n * x / size - served[k] for k, n in totals.items()}
        take = {k: max(int(v), 0) for k, v in owed.items()}
        room = x - served.total() - sum(take.values())
        for k in sorted(totals, key=lambda k: take[k] - owed[k])[: max(room, 0)]:
            take[k] += 1
        served.update(take)
        out.append(dict(take))
    return out


def test_placement_is_gapless_and_keeps_the_mixture():
    rng = random.Random(31)
    for trial in range(60):
        window = rng.choice([16, 64, 256, 4096])
        totals = {f"q{k}": max(1, int(10 ** rng.uniform(0, 4.5))) for k in range(rng.randrange(1, 7))}
        weights = None if trial % 3 == 0 else {k: round(10 ** rng.uniform(-4, 0), 5) for k in totals if rng.random() < 0.8}
        phases = packing.schedule(totals, weights)
        place = packing._placer(phases, window)
        windows = defaultdict(list)
        for k, n in totals.items():
            at = 0
            while at < n:  # documents of any length
                end = min(n, at + rng.choice([1, 7, 300, 5000]))
                here = at
                for length, w, offset in place(k, at, end):
                    windows[w].append((offset, length, k))
                    here += length
                assert here == end
                at = end
        total = sum(totals.values())
        for w in range(-(-total // window)):
            end = 0
            for offset, length, _ in sorted(windows[w]):
                assert offset == end and length > 0
                end += length
            assert end == min(window, total - w * window)
        for phase in phases:
            paths = phase.paths()
            for k, n in zip(phase.names, phase.served, strict=True):
                counts = [packing.had(paths[k], x) for x in range(0, phase.size + 1, max(1, phase.size // 500))] + [packing.had(paths[k], phase.size)]
                assert counts == sorted(counts) and counts[0] == 0 and counts[-1] == n
                assert all(abs(packing.had(paths[k], x) - n * x / phase.size) <= 1.5 for x in range(0, phase.size + 1, max(1, phase.size // 500)))
        if len(phases) == 1:
            for w, want in enumerate(plain_round_robin(totals, window)):
                got = Counter()
                for _, length, k in windows[w]:
                    got[k] += length
                assert all(abs(got[k] - want.get(k, 0)) <= 3 for k in totals)


def test_windows_hold_the_stated_mixture(spark):
    """`pack` itself with weights, one of them under a token a window, until a queue runs out."""
    rng = random.Random(32)
    sources = ["a", "b", "c", "d"]
    texts = [sentence(rng, rng.randrange(20, 200)) for _ in range(160)]
    docs = documents(spark, texts, sources)
    weights = {"a": 1, "b": 1, "c": 0.0002, "d": 1}
    rows = packing.pack(docs, packing.PackingConfig(tokenizer_path("word_bpe_49k.json"), window=128, weights=weights)).collect()
    total, windows = Counter(), defaultdict(lambda: defaultdict(list))
    for r in rows:
        total[sources[r.doc_id % 4]] += r.length
        windows[r.sequence_id][sources[r.doc_id % 4]].append((r.offset, r.length))
    first = 3 * min(total[k] for k in "abd") // 128 - 1
    for w, by in windows.items():
        pieces, end = sorted(p for found in by.values() for p in found), 0
        for offset, length in pieces:
            assert offset == end
            end += length
        assert end == 128 or w == max(windows)
        if w < first:
            assert all(abs(sum(n for _, n in by[k]) - 128 / 3.0002) <= 2 for k in "abd")
    assert set(windows) == set(range(len(windows)))


def test_another_word_splitter_is_refused():
    with pytest.raises(ValueError, match="cut words"):
        packing.check_words(packing.PackingConfig(tokenizer_path("byte_bpe_50k.json")))
