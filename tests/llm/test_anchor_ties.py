import numpy as np
import pytest

from vulnspark.llm.suffix_dedup import GRAM, anchors


@pytest.mark.parametrize("edge", [1 << 24, 5000, 4096])
def test_equal_strings_pick_equal_places_across_16_mb(edge):
    rng = np.random.default_rng(1)
    piece = np.frombuffer(b"abc" * 500, np.uint8)
    picked = []
    for before in (edge - 700, 77):
        data = np.concatenate([rng.integers(0, 256, before, dtype=np.uint8), piece, rng.integers(0, 256, 900, dtype=np.uint8)])
        _, at, _, _ = anchors(data, np.array([0]), np.array([len(data)]), 400, GRAM)
        # Samples of windows that lie inside the piece: the gram and a whole window around it.
        at = at - before
        picked.append(at[(at >= 400) & (at < len(piece) - 400)].tolist())
    assert picked[0] == picked[1] and picked[0]
