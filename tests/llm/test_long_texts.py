"""Texts that are read in pieces score as if they were read whole."""

import numpy as np
import pytest

from snapweave.llm import quality


@pytest.mark.parametrize("size", [(1 << 20) - 100, (1 << 20) + 5, 1_200_000, 2_300_001])
def test_quality_of_a_text_over_a_megabyte(size):
    rng = np.random.default_rng(size)
    network = quality.ByteNetwork(quality.QualityConfig())
    text = rng.integers(0, 256, size).astype(np.uint8)
    parts, windows = [], network.windows
    network.windows = lambda values: parts.append(windows(values).max(1)) or windows(values)
    network.score(text)
    network.windows = windows
    assert (np.concatenate(parts) == windows(network.responses(network.padded(text))).max(1)).all()
