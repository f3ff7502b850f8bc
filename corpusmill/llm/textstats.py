"""Per-text counts used by the quality rules and the quality classifier. Words are runs of
bytes other than ASCII white space (0x20, 0x09-0x0D), which is what bytes.split() gives."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
IS_SYMBOL = np.array([chr(c) in SYMBOLS for c in range(256)])
IS_BLANK = np.array([chr(c) in SPACES for c in range(256)])


class Stats(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_distinct_words: int
    n_same_neighbours: int
    n_upper: int
    n_letters: int
    n_bangs: int
    n_pipes: int
    n_stops: int
    n_commas: int
    n_digits: int
    longest_word: int
    n_symbol_ends: int
    n_punctuation: int


def repeated_words(words: list[bytes]) -> int:
    """Words lying in a 3-word window that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered[i] = covered[i + 1] = covered[i + 2] = 1
    return sum(covered)


def stats(text: str | None) -> Stats:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    codes = np.frombuffer(raw, dtype=np.uint8)
    of = np.bincount(codes, minlength=256) if len(codes) else np.zeros(256, dtype=np.int64)
    upper, lower = int(of[65:91].sum()), int(of[97:123].sum())
    spaces = sum(int(of[ord(c)]) for c in SPACES)
    continuation = int(of[128:192].sum())
    return Stats(
        n_words=len(words),
        word_chars=len(raw) - continuation - spaces,
        n_symbols=sum(int(of[ord(c)]) for c in SYMBOLS),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated_words(words),
        n_lines=len(lines),
        n_distinct_words=len(set(words)),
        n_same_neighbours=sum(map(bytes.__eq__, words, words[1:])),
        n_upper=upper,
        n_letters=upper + lower,
        n_bangs=int(of[33]),
        n_pipes=int(of[124]),
        n_stops=int(of[46] + of[63]),
        n_commas=int(of[44]),
        n_digits=int(of[48:58].sum()),
        longest_word=max(map(len, words), default=0),
        n_symbol_ends=int(np.count_nonzero(IS_SYMBOL[codes] & np.concatenate([IS_BLANK[codes[1:]], [True]]))) if len(codes) else 0,
        n_punctuation=int(of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum()),
    )
