"""Every template among all others, and texts that differ in a word or a clause."""

import random

import pytest

from snapweave.llm import license_scan
from snapweave.llm.license_scan import TEMPLATES, scan_licenses

from .test_corpus import documents


APART = license_scan.LicenseScanConfig(tell_apart=True)


def filler(rng, n):
    return " ".join(f"word{rng.randrange(5000)}" for _ in range(n))


def test_each_template_has_its_own_label(spark):
    """The longest template of each licence, alone and inside other text; a few words changed in two of them."""
    rng, texts, names = random.Random(2), [], []
    for name, found in TEMPLATES.items():
        text = max(found, key=len)
        texts += [text, f"{filler(rng, 40)} {text} {filler(rng, 60)}", text.upper()]
        names += [name] * 3
    for name in ("GPL-2.0", "BSD-2-Clause"):
        words = max(TEMPLATES[name], key=len).split()
        words[3] = "changed"
        texts.append(" ".join(words))
        names.append(name)
    both = f"{max(TEMPLATES['MIT'], key=len)} {filler(rng, 300)} {max(TEMPLATES['BSD-2-Clause'], key=len)} {filler(rng, 300)} {max(TEMPLATES['GPL-2.0'], key=len)}"
    found = {}
    for r in scan_licenses(documents(spark, [*texts, both]), config=APART).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    assert {k: v for k, v in found.items() if k < len(texts)} == {k: {name} for k, name in enumerate(names)}
    assert found[len(texts)] == {"MIT", "BSD-2-Clause", "GPL-2.0"}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_short_templates_are_found_alone(name):
    index = license_scan.Index([(n, t) for n, texts in sorted(TEMPLATES.items()) for t in texts], APART)
    for text in TEMPLATES[name]:
        words = index.hashes([w.encode() for w in text.split()])
        words = words[words != 0]
        found = {x[1] for x in index.scan(words, license_scan.np.array([0, len(words)]))}
        assert name in found
