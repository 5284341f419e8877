"""The words that the suffix sort compares are built once for all places, and windows are found as by brute force."""

import numpy as np

from firmlens.llm import op2_suffix_dedup as op2


def test_words_of_all_places():
    text = np.frombuffer(b"some bytes, and more\0", np.uint8)
    raw = text.tobytes() + bytes(40)
    want = [int.from_bytes(raw[i : i + 8], "big") for i in range(len(text) + 16)]
    assert op2._word_at_each(text, 16)[: len(want)].tolist() == want


def test_windows_by_brute_force():
    rng = np.random.default_rng(9)
    for width in (8, 11, 50):
        parts = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(1, 90, 14)]
        parts += [b"a" * 120, parts[0] * 3, b"\xc3\xa9" * 60]
        owners = rng.integers(0, 6, len(parts))
        seen: dict[bytes, int] = {}
        places = [(p, i, c[i : i + width]) for p, c in enumerate(parts) for i in range(len(c) - width + 1)]
        for p, _, window in places:
            seen[window] = min(seen.get(window, owners[p]), owners[p])
        found = sorted(zip(*(x.tolist() for x in op2.covered_windows(parts, owners, width)), strict=True))
        assert found == [(p, i) for p, i, window in places if seen[window] < owners[p]]
