"""Surface features of a whole text, counted in its UTF-8 bytes."""

from __future__ import annotations

from itertools import islice
from operator import eq

import numpy as np

SYMBOLS = b"#$%&*@^~<>{}[]\\=+_"


def surface(data: bytes) -> list[float]:
    """Numbers that tell prose from junk; an empty text gives zeros."""
    if not data:
        return [0.0] * len(NAMES)
    words, lines = data.split(), data.split(b"\n")
    n, size = max(1, len(words)), len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    symbols, bangs, pipes = int(counts[list(SYMBOLS)].sum()), int(counts[33]), int(counts[124])
    digits, stops = int(counts[48:58].sum()), int(counts[46])
    shouted = sum(map(bytes.isupper, words))
    again = sum(map(eq, words, islice(words, 1, None)))
    lines_again = len(lines) - len(set(lines))
    kinds = len(set(words))
    ratios = [shouted / n, again / n, symbols / size, bangs / n, pipes / n, digits / size, lines_again / len(lines)]
    counted = [shouted, again, symbols, bangs, pipes, digits, lines_again]
    return [
        float(np.log1p(n)),
        min(size / n, 40.0) / 10,
        kinds / n,
        kinds / n**0.8,
        upper / max(1, upper + lower),
        stops / n,
        len(lines) / n,
        *np.sqrt(ratios).tolist(),
        *np.log1p(counted).tolist(),
        *[c / (c + 3.0) for c in counted],
    ]


_COUNTED = ("shouted", "again", "symbols", "bangs", "pipes", "digits", "lines_again")
NAMES = ("log_words", "word_bytes", "kinds", "kinds_power", "upper", "stops", "lines", *(f"{k}_{c}" for k in ("rate", "log", "some") for c in _COUNTED))
