"""License scans by patience alignment.

A text and a template are aligned on the words that occur exactly once in both: the longest
increasing subsequence of these anchors is kept, and the gaps between them are aligned the same
way, until no anchor is left; equal words next to anchors are then taken greedily. The aligned
template words make the coverage. Words that name the licence (in braces in the template) must be
aligned whatever the coverage, so that a notice of one licence is not taken for its neighbour's.

The whole text is scanned for seeds, as many of a template's rarest words as any stretch of the
least coverage must hold one of; the stretch around a seed is aligned if it has enough of the
template's words. A notice given twice is found twice, since each stretch is aligned on its own;
of overlapping finds the one with most words stands, ties going to the earlier start, then to the
licence's name. Null or empty texts have no licence; a null id's notices are rows with a null id;
rows that repeat an id give their notices each; an empty table gives none. Other columns, whatever
their names, are not read. Templates are a parameter."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_batches, text_or_empty
from corpusmill.llm.license_texts import TEMPLATES

MIN_COVERAGE = 0.8
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
SCHEMA = "doc_id long, license string, coverage double, matched_words long, template_words long, start_word long, end_word long"

def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that rises in both, of pairs sorted by the first."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        i = bisect_left(tails, j)
        back[k] = at[i - 1] if i else -1
        if i == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[i], at[i] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        one_a, one_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if one_b[w] == 1}
        anchors = _increasing([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if one_a[w] == 1 and w in where])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p + 1, i, q + 1, j) for (p, q), (i, j) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, min_coverage: float) -> None:
        self.name, self.words, self.phrases = name, [], []
        for k, part in enumerate(re.split(r"[{}]", text)):
            words = words_of(part)
            if k % 2 and words:
                self.phrases.append((len(self.words), len(self.words) + len(words)))
            self.words += words
        self.known = set(self.words)
        self.need = next((m for m in range(1, len(self.words) + 1) if m / len(self.words) >= min_coverage), None)

    def named(self, pairs: list[tuple[int, int]]) -> bool:
        """If the words of each phrase are aligned, next to one another."""
        place = {j: i for i, j in pairs}
        return all(all(place.get(j, -1) == place.get(a, -9) + j - a for j in range(a, b)) for a, b in self.phrases)


class Scanner:
    def __init__(self, templates: dict[str, str] | tuple[tuple[str, str], ...], min_coverage: float) -> None:
        pairs = templates.items() if isinstance(templates, dict) else templates
        self.templates = [t for t in (Template(n, x, min_coverage) for n, x in pairs) if t.need is not None]
        shared = Counter(w for t in self.templates for w in t.known)
        self.rare: dict[str, list[int]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            times, spare = Counter(t.words), len(t.words) - t.need
            for w in sorted(times, key=lambda w: (shared[w], -len(w), w)):
                self.rare[w].append(k)
                spare -= times[w]
                if spare < 0:
                    break

    def scan(self, text: str) -> list[tuple[str, float, int, int, int, int]]:
        """(licence, coverage, matched, template words, start, end), best first where they overlap."""
        words = words_of(text)
        seeds = defaultdict(list)
        for i, w in enumerate(words):
            for k in self.rare.get(w, ()):
                seeds[k].append(i)
        found = []
        for k, at in seeds.items():
            t = self.templates[k]
            n = len(t.words)
            reach = n + n // 2 + 2
            lo, hi = max(0, at[0] - reach), min(len(words), at[-1] + reach)
            inside = list(accumulate((w in t.known for w in words[lo:hi]), initial=0))
            done = -1
            for i in at:
                if i < done:
                    continue
                a, b = max(0, i - reach, done), min(len(words), i + reach)
                if inside[b - lo] - inside[a - lo] < t.need:
                    continue
                pairs = align(words[a:b], t.words)
                if len(pairs) >= t.need and t.named(pairs):
                    # a stretch far longer than its words is chance, not a notice
                    start, end = a + pairs[0][0], a + pairs[-1][0] + 1
                    if end - start <= 2 * n:
                        found.append((t.name, len(pairs) / n, len(pairs), n, start, end))
                        done = end
        found.sort(key=lambda f: (-f[2] * f[1], f[4], f[0]))
        kept: list = []
        for f in found:
            if all(f[5] <= k[4] or f[4] >= k[5] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f[4])


def license_scan(docs: DataFrame, templates: dict[str, str] | tuple[tuple[str, str], ...] | None = None, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice found; positions are in words of letters and digits."""
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage)
        for batch in batches:
            rows = [(d, n, round(c, 6), m, t, s, e) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, c, m, t, s, e in scanner.scan(text)]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "license", "coverage", "matched_words", "template_words", "start_word", "end_word"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, SCHEMA)
