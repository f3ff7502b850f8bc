"""Packing of tokenised documents into sequences: length patterns by non-negative least squares.

The lengths' histogram (at most SEQUENCE rows whatever the corpus) goes to the driver. Patterns of
one to four documents are enumerated over coarse length classes, their repeat counts are fitted to
the histogram by non-negative least squares and rounded down. Each pattern is then filled with
exact lengths, its last document by best fit; what is left is packed best-fit decreasing. All of
this works on counts of equal lengths, so its cost does not follow the number of documents. The
result is a table of runs per length; each piece finds its place from its rank among the pieces of
its length, ranks being counted in groups of some GROUP pieces, so that no length is one task's work.

Null text is an empty text: the closing id alone. Null ids and repeated rows are pieces like any
other; pieces of equal length are interchangeable, and of those that tie in id and number too any
takes the next place. An empty table gives no rows. Only id and text are read, so that other
columns and their names do not matter."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import map_batches, materialize, text_or_empty
from corpusmill.llm.encoding import WordIds

SEQUENCE = 4096
CLASS = 64
END_ID = 1
#: Pieces of one length that are ranked in one group; longer lists of a length are salted apart.
GROUP = 250_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def patterns(parts: int, most: int = 4) -> list[tuple[int, ...]]:
    """The partitions of parts into 1 to most positive numbers, each in decreasing order."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, cap: int, have: tuple[int, ...]) -> None:
        if left == 0:
            out.append(have)
        elif len(have) < most:
            for x in range(min(left, cap), 0, -1):
                if x * (most - len(have)) < left:
                    break
                grow(left - x, x, (*have, x))

    grow(parts, parts, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Lawson and Hanson's active-set solution of min |a x - b|, x >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * (np.abs(a.T @ b).max() + 1)
    for _ in range(rounds):
        pull = a.T @ (b - a @ x)
        pull[active] = -np.inf
        j = int(pull.argmax())
        if pull[j] <= tolerance:
            break
        active[j] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 0)
            if not low.any():
                x = s
                break
            gap = x[low] - s[low]
            step = float(np.min(np.where(gap > 0, x[low] / np.where(gap > 0, gap, 1), 0)))
            x = x + step * (s - x)
            gone = active & (x <= 1e-12)
            gone |= low & (x <= 1e-12)
            if not gone.any():
                gone[np.flatnonzero(low)[0]] = True
            active &= ~gone
            x[~active] = 0
    return x


@lru_cache(maxsize=1)
def _design() -> tuple[list[tuple[int, ...]], np.ndarray]:
    found = patterns(SEQUENCE // CLASS)
    a = np.zeros((SEQUENCE // CLASS, len(found)))
    for j, p in enumerate(found):
        for x in p:
            a[x - 1, j] += 1
    return found, a


class Plan:
    """Runs per length: rank first..., sequence of the run's first copy, copies a sequence, offset."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.left)
        self.ranks = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.spaces: list[int] = []
        self.sequences = 0
        self._fit_patterns()
        self._best_fit()

    def _take(self, length: int, copies: int, sequences: int, first: int, offset: int) -> None:
        self.rows.append((length, self.ranks[length], first, copies, offset))
        self.ranks[length] += copies * sequences
        self.left[length] -= copies * sequences
        if not self.left[length]:
            self.lengths.pop(bisect_left(self.lengths, length))

    def _leave(self, space: int, first: int, sequences: int) -> None:
        if space and sequences:
            if space not in self.open:
                self.open[space] = []
                insort(self.spaces, space)
            self.open[space].append((first, sequences))

    def _largest(self, most: int, above: int = 0) -> int | None:
        i = bisect_left(self.lengths, most + 1)
        return self.lengths[i - 1] if i and self.lengths[i - 1] > above else None

    def _fit_patterns(self) -> None:
        b = np.zeros(SEQUENCE // CLASS)
        for n, c in self.left.items():
            b[-(-n // CLASS) - 1] += c
        if not b.any():
            return
        found, a = _design()
        weight = np.sqrt(np.arange(1, len(b) + 1))[:, None]
        repeats = np.floor(nnls(a * weight, b * weight[:, 0]) + 1e-6).astype(int)
        for j in sorted(np.flatnonzero(repeats), key=lambda j: found[j], reverse=True):
            todo = int(repeats[j])
            while todo:
                space, chosen, need = SEQUENCE, [], {}
                for k, x in enumerate(found[j]):
                    # classes are bounds from above; the last document takes the space they leave
                    last = k == len(found[j]) - 1
                    bound = space if last and k else min(space, x * CLASS)
                    n = next((n for n in self._down(bound) if self.left[n] > need.get(n, 0)), None)
                    if n is None or n <= (x - 1) * CLASS - (CLASS if last else 0):
                        chosen = []
                        break
                    chosen.append(n)
                    need[n] = need.get(n, 0) + 1
                    space -= n
                if not chosen:
                    break
                run = min([todo, *(self.left[n] // c for n, c in need.items())])
                offset = 0
                for n, same in groupby(sorted(chosen, reverse=True)):
                    c = len(list(same))
                    self._take(n, c, run, self.sequences, offset)
                    offset += n * c
                self._leave(space, self.sequences, run)
                self.sequences += run
                todo -= run

    def _down(self, most: int) -> Iterator[int]:
        for i in range(bisect_left(self.lengths, most + 1) - 1, -1, -1):
            yield self.lengths[i]

    def _best_fit(self) -> None:
        while self.lengths:
            n = self.lengths[-1]
            i = bisect_left(self.spaces, n)
            if i == len(self.spaces):
                copies = min(SEQUENCE // n, self.left[n])
                run = self.left[n] // copies
                first, self.sequences, space = self.sequences, self.sequences + run, SEQUENCE
            else:
                space = self.spaces[i]
                first, many = self.open[space].pop()
                copies = min(space // n, self.left[n])
                run = min(many, self.left[n] // copies)
                if many > run:
                    self.open[space].append((first + run, many - run))
                if not self.open[space]:
                    del self.open[space]
                    self.spaces.pop(i)
            self._take(n, copies, run, first, SEQUENCE - space)
            self._leave(space - copies * n, first, run)

    def lookup(self) -> dict[int, np.ndarray]:
        """By length, the runs as columns in the order of ranks."""
        by: dict[int, list] = {}
        for length, *rest in self.rows:
            by.setdefault(length, []).append(rest)
        return {n: np.array(rows, dtype=np.int64).T for n, rows in by.items()}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' ids with END_ID behind them, cut after every SEQUENCE ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(tokenizer)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * SEQUENCE)):
                    part = ids[at : at + 4 * SEQUENCE]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with the sequence it lies in and its offset there."""
    cut = materialize(pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), id_col, text_col), "pack-pieces")
    # at most SEQUENCE rows, then as many and one for each GROUP pieces, reach the driver
    salts = [1] * (SEQUENCE + 1)
    for r in cut.groupBy("length").count().collect():
        salts[r["length"]] = -(-r["count"] // GROUP)
    of_length = F.get(F.from_json(F.lit(json.dumps(salts)), "array<int>"), F.col("length").cast("int"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), of_length).cast("int"))
    cells = salted.groupBy("length", "salt").count().orderBy("length", "salt").collect()
    starts, counts = [], {}
    for r in cells:
        starts.append((r["length"], r["salt"], counts.get(r["length"], 0)))
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    table = Plan(counts).lookup()
    before = docs.sparkSession.createDataFrame(starts, "length long, salt int, before long")
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start"))
    ranked = salted.join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("before") + place - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, seq, copies, start = table[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                past = rank[at] - first[k]
                sequence[at] = seq[k] + past // copies[k]
                offset[at] = start[k] + past % copies[k] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), run, PIECES + ", sequence_id long, offset long")
