"""Repeated passages across documents by compact windows.

A token is the hash of 3 consecutive words (ASCII white space apart, A-Z lower-cased). Under each
of 6 hash functions the tokens of a text form a Cartesian tree; a node whose subtree spans a
passage of 50 words (WINDOW tokens) is a compact window (left, centre, right): all subsequences
within it that hold the centre share their min-hash. The functions make BANDS pairs. Within a text
an interval join of the two functions' windows gives the groups of passages that agree under both;
a group's key is made of both min-hashes and the distance between their centres. So texts that
share a key agree under two hash functions at one alignment, whatever words stand in between, and
an exact passage of 50 words has a common key in every band.

A key's members are never paired up: each is tied to the member of the least document. That
document may hold less of a passage than later ones share, in two ways:
- exact repeats: members of a key of band 0 whose surroundings (all passages of 50 words that hold
  both centres) differ from the least document's are grouped once more by each of these passages
  and tied to the first document that holds the passage. So exact repeats of 50 words and over are always found.
- near repeats: members whose tie gave no passage are grouped once more by two keys at once (four
  agreeing min-hashes), and tied to the least document of that group.
Ties give alignments (two documents, a shift and the places of its ties), whose words, by 16 bits
of their hashes, are compared from MARGIN words before the first tie to as many behind the last;
runs of RUN words that a substitution or a gap of up to GAP words separates are chained, and
chains of 50 words and over are the passages. What lies further off has ties of its own.

Null texts are empty; texts below 50 words have no window. Repeats within one document do not
count, nor rows without an id, which are neither cut nor partners. Rows that repeat an id and its
text give their passages again; rows that repeat an id with another text are compared with other
ids only, each with its own words. An empty table has no passage. Other columns do not matter,
whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_batches, materialize, text_or_empty

GRAM = 3
PASSAGE = 50
WINDOW = PASSAGE - GRAM + 1
BANDS = 3
BASE = np.uint64(0x5851F42D4C957F2D)
INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
#: A chain may cross this many words that differ, if runs of at least RUN words surround them.
GAP, RUN = 3, 6
MARGIN = 2 * PASSAGE
#: Two keys of a near repeat's second grouping begin at least this many words apart.
SPREAD = 12
#: Bytes of text whose words are hashed at once.
PART = 1 << 18
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER.tobytes()).split()


class _Powers:
    """BASE ** i and its inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            up, down = np.full(size, BASE), np.full(size, INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values[i] * BASE ** i, one longer than values."""
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.upto(len(values) + 1)[0][: len(values)], dtype=np.uint64, out=out[1:])
        return out

    def span(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each [start, end): alike wherever the same values stand."""
        return (sums[end] - sums[start]) * self.down[start]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, where each text's words begin and, last, their number)."""
    n = len(texts)
    buffers = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32, count=texts.offset + n + 1)[texts.offset :].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    codes = LOWER[np.frombuffer(buffers[2], dtype=np.uint8, count=size, offset=int(offsets[0]))]
    edges = offsets - offsets[0]
    ink = ~BLANK[codes]
    begins, ends = ink.copy(), np.concatenate([ink, [False]])
    cut = np.zeros(size + 1, dtype=bool)
    cut[edges] = True
    begins[1:] &= ~ink[:-1] | cut[1:size]
    ends[1:] = ink & np.concatenate([~ink[1:] | cut[1:size], [True]])
    ends[0] = False
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    h, at = np.empty(len(start), dtype=np.uint64), 0
    while at < len(start):  # in parts, as each byte takes some tens of bytes here
        stop = max(at + 1, int(np.searchsorted(start, start[at] + PART)))
        a, b = int(start[at]), int(end[stop - 1])
        h[at:stop] = powers.span(powers.sums(codes[a:b].astype(np.uint64) + np.uint64(1)), start[at:stop] - a, end[at:stop] - a)
        at = stop
    return _mixed(h + (end - start).astype(np.uint64), 7), np.searchsorted(start, edges)


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of width values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def _parents(values: np.ndarray, above) -> np.ndarray:
    """Of each value the nearest earlier one that is not above it, -1 if there is none: all jump
    at once, over what those that they meet have jumped already."""
    to = np.arange(-1, len(values) - 1)
    k = np.arange(len(values))
    while len(k := k[(to[k] >= 0) & above(values[to[k]], values[k])]):
        to[k] = to[to[k]]
    return to


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right), both ends included, of the Cartesian tree's nodes that span width
    values or more; of equal values the first is the parent. The neighbours that bound such a node
    span as much themselves, so the tree is built over these nodes alone."""
    n = len(values)
    if n < width:
        return (np.zeros(0, dtype=np.int64),) * 3
    least = _sliding(values, width, np.minimum)
    pad = np.zeros(width - 1, dtype=values.dtype)
    centres = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == values)
    of = values[centres]
    left = np.concatenate([[-1], centres])[_parents(of, np.greater) + 1] + 1
    right = np.concatenate([[n], centres[::-1]])[_parents(of[::-1], np.greater_equal) + 1][::-1] - 1
    wide = right - left + 1 >= width
    return left[wide], centres[wide], right[wide]


def _starts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The compact windows as (first, last, centre): from first to last begin the passages of
    WINDOW tokens that share the centre. The least value, 0, parts the texts and is no centre."""
    left, centre, right = compact_windows(values, WINDOW)
    first, last = np.maximum(left, centre - WINDOW + 1), np.minimum(centre, right - WINDOW + 1)
    ok = (values[centre] > 0) & (first <= last)
    return first[ok], last[ok], centre[ok]


def _joined(f: tuple[np.ndarray, ...], g: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The interval join of two functions' windows: the centres of those that share a passage."""
    if not len(f[0]) or not len(g[0]):
        return (np.zeros(0, dtype=np.int64),) * 2
    at = np.union1d(f[0], g[0])
    i, j = np.searchsorted(f[0], at, "right") - 1, np.searchsorted(g[0], at, "right") - 1
    ok = (i >= 0) & (j >= 0)
    at, i, j = at[ok], i[ok], j[ok]
    ok = (at <= f[1][i]) & (at <= g[1][j])
    return f[2][i[ok]], g[2][j[ok]]


def passage_keys(h: np.ndarray, edges: np.ndarray, powers: _Powers) -> tuple[np.ndarray, ...]:
    """(text, key, mark) of all keys. A mark packs where the first centre begins in its text, 28 bits
    of the surroundings' hash (band 0 only), how many words both centres take, and whether the text
    has the key for the first time here."""
    n, texts = len(h), np.zeros(0, dtype=np.int64)
    if n < PASSAGE:
        return texts, texts, texts
    sums = powers.sums(h)
    at = np.arange(n - GRAM + 1)
    tokens = np.zeros(n, dtype=np.uint64)
    tokens[: n - GRAM + 1] = powers.span(sums, at, at + GRAM)
    apart = np.zeros(n, dtype=bool)
    for k in range(1, GRAM):
        apart[(edges[1:] - k)[edges[1:] >= k]] = True
    out = []
    for band in range(BANDS):
        windows = []
        for salt in (2 * band + 1, 2 * band + 2):
            values = _mixed(tokens, salt) | np.uint64(1)
            values[apart] = 0
            windows.append(_starts(values))
        a, b = _joined(*windows)
        lo, hi = np.minimum(a, b), np.maximum(a, b) + GRAM
        key = _mixed(tokens[a] * np.uint64(0x2545F4914F6CDD1D) + _mixed(tokens[b], 99) + (b - a).astype(np.uint64), 100 + band)
        text = np.searchsorted(edges, lo, "right") - 1
        around = np.zeros(len(lo), dtype=np.int64)
        if band == 0:
            s, e = np.maximum(hi - PASSAGE, edges[text]), np.minimum(lo + PASSAGE, edges[text + 1])
            around = (_mixed(powers.span(sums, s, e) + ((lo - s) << 8 | (e - lo)).astype(np.uint64), 3) >> np.uint64(36)).view(np.int64)
        order = np.lexsort((lo, key, text))
        new = np.ones(len(lo), dtype=np.int64)
        new[order[1:]] = (key[order[1:]] != key[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
        out.append((text, key.view(np.int64), (lo - edges[text]) << 36 | around << 8 | (hi - lo) << 1 | new))
    return tuple(np.concatenate(x) for x in zip(*out))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _Powers()
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        text, key, mark = passage_keys(*word_hashes(batch.column(1), powers), powers)
        if len(text):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ids[text], mark)], names=["key", "doc", "mark"])


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _Powers()
    for batch in batches:
        h, edges = word_hashes(batch.column(1), powers)
        h = h.astype(np.uint16)
        rows = [h[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc", "hashes"])


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of PASSAGE words that hold both centres of one of the marks."""
    powers = _Powers()
    for batch in batches:
        ids, grams, places = [], [], []
        for doc, marks, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            h = np.frombuffer(hashes, dtype=np.uint16).astype(np.uint64)
            if len(h) < PASSAGE:
                continue
            sums = powers.sums(_mixed(h, 4))
            mark = np.array(marks, dtype=np.int64)
            lo = mark >> 36
            edge = np.zeros(len(h) + 2, dtype=np.int64)
            np.add.at(edge, np.maximum(lo + (mark >> 1 & 127) - PASSAGE, 0), 1)
            np.add.at(edge, lo + 1, -1)
            at = np.flatnonzero(np.cumsum(edge)[: len(h) - PASSAGE + 1] > 0)
            gram = _mixed(powers.span(sums, at, at + PASSAGE), 5)
            # of a passage that the text holds again at once, each PASSAGE words one is enough
            order = np.lexsort((at, gram))
            keep, last = np.ones(len(at), dtype=bool), {}
            again = np.flatnonzero(gram[order[1:]] == gram[order[:-1]]) + 1
            for k in order[np.union1d(again, again - 1)].tolist():
                g, p = int(gram[k]), int(at[k])
                if p - last.get(g, -PASSAGE) < PASSAGE:
                    keep[k] = False
                else:
                    last[g] = p
            new = np.ones(len(at), dtype=np.int64)
            new[order[again]] = 0
            ids.append(np.full(int(keep.sum()), doc, dtype=np.int64))
            grams.append(gram[keep].view(np.int64))
            places.append((at << 1 | new)[keep])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (grams, ids, places)], names=["gram", "doc", "at"])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of lists of structs of numbers: where each list begins and ends, and the fields' values."""
    return column.offsets.to_numpy(), [column.values.field(k).to_numpy(zero_copy_only=False) for k in range(column.values.type.num_fields)]


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of keys whose tie gave no passage at their place, each two within a passage as one key."""
    for batch in batches:
        out = []
        keys_at, (all_keys, all_starts) = _lists(batch.column(1))
        spans_at, (all_s, all_e) = _lists(batch.column(2))
        for n, doc in enumerate(batch.column(0).to_pylist()):
            key, start = all_keys[keys_at[n] : keys_at[n + 1]].view(np.uint64), all_starts[keys_at[n] : keys_at[n + 1]]
            s, e = all_s[spans_at[n] : spans_at[n + 1]], all_e[spans_at[n] : spans_at[n + 1]]
            if len(s):
                order = np.argsort(s)
                ends = np.maximum.accumulate(e[order])
                at = np.searchsorted(s[order], start, "right") - 1
                left = (at < 0) | (ends[at] <= start)
                key, start = key[left], start[left]
            order = np.lexsort((key, start))
            key, start = key[order], start[order]
            low, high = np.searchsorted(start, start + SPREAD), np.searchsorted(start, start + WINDOW)
            count = high - low
            if not count.sum():
                continue
            i = np.repeat(np.arange(len(start)), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + low[i]
            made = _mixed(key[i] * np.uint64(3) + _mixed(key[j], 11) + (start[j] - start[i]).astype(np.uint64), 12)
            made, first = np.unique(made, return_index=True)
            out.append((made.view(np.int64), np.full(len(made), doc, dtype=np.int64), start[i][first]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "doc", "start"])


def _runs(equal: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of at least RUN true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= RUN
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def shared_passages(a: np.ndarray, b: np.ndarray, shifts: list[int] | dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, partner start, partner end) in words: chains of at least PASSAGE words of a,
    over the alignments a[i] ~ b[i + shift]; a dict bounds i of each shift."""
    pieces = []
    ranges = shifts if isinstance(shifts, dict) else {}
    for shift in sorted(set(shifts)):
        least, most = ranges.get(shift, (0, len(a)))
        lo, hi = max(0, -shift, least), min(len(a), len(b) - shift, most)
        if hi > lo:
            pieces += [(lo + s, lo + e, shift) for s, e in _runs(a[lo:hi] == b[lo + shift : hi + shift])]
    pieces.sort()
    chains: list[list[int]] = []
    ends: dict[int, list[int]] = {}  # the open chains by the shift of their last piece
    for s, e, shift in pieces:
        best = -1
        for at in range(shift - RUN - GAP, shift + RUN + GAP + 1):
            if at in ends:
                ends[at] = [k for k in ends[at] if chains[k][1] >= s - GAP]  # no later piece starts before s
                for k in ends[at]:
                    c = chains[k]
                    if k > best and e > c[1] and s - c[1] >= -RUN and -RUN <= s + shift - c[3] <= GAP:
                        best = k
        if best >= 0:
            c = chains[best]
            ends[c[3] - c[1]].remove(best)
            c[1], c[3] = e, e + shift
        else:
            best = len(chains)
            chains.append([s, e, s + shift, e + shift])
        ends.setdefault(shift, []).append(best)
    out, covered = [], 0
    for c in sorted((c for c in chains if c[1] - c[0] >= PASSAGE), key=lambda c: (c[0], -c[1])):
        if c[1] > covered:  # a text that repeats itself has chains within chains
            out.append(tuple(c))
            covered = c[1]
    return out


#: Columns beside those of a caller's table, so named that they clash with none.
SPANS, OF, DIGEST = "corpusmill_spans", "corpusmill_of", "corpusmill_digest"
SPAN_SCHEMA = "doc long, start_word long, end_word long, other long, partner_start long, partner_end long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, other, lines, a0, b0, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = np.frombuffer(a, dtype=np.uint16), np.frombuffer(b, dtype=np.uint16)
            ranges = {x["shift"] + a0 - b0: (x["lo"] - a0 - MARGIN, x["hi"] - a0 + PASSAGE + MARGIN) for x in lines}
            out += [(doc, s + a0, e + a0, other, ps + b0, pe + b0) for s, e, ps, pe in shared_passages(a, b, ranges)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "start_word", "end_word", "other", "partner_start", "partner_end"])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) of all rows with an id, and (doc, doc_id) of the rows whose doc is not their id:
    rows of one id with several texts. These take numbers that no row has as its id."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text")).filter("doc IS NOT NULL")
    ids = texts.select("doc").groupBy("doc").count()
    again = ids.filter("count > 1").select("doc")
    if again.isEmpty():
        return texts, None
    again = materialize(again, "passage-again")
    several = texts.join(again.hint("shuffle_hash"), "doc", "left_semi").select("doc", F.xxhash64("text").alias("digest")).distinct()
    low = ids.agg(F.min("doc")).first()[0]
    free = low > -(2**62)  # numbers below all ids, else above all; in the order of the hash, not of the id
    base = low if free else ids.agg(F.max("doc")).first()[0]
    spot = F.monotonically_increasing_id() + 1
    names = materialize(several.select(F.col("doc").alias("doc_id"), "digest", (F.lit(base) - spot if free else F.lit(base) + spot).alias("number")), "passage-numbers")
    met = texts.withColumn("digest", F.xxhash64("text")).join(names.withColumnRenamed("doc_id", "doc").hint("shuffle_hash"), ["doc", "digest"], "left")
    return materialize(met.select(F.coalesce("number", "doc").alias("doc"), "text").distinct(), "passage-texts"), names


def _lines(ties: DataFrame) -> DataFrame:
    """ties (doc, other, shift, start) -> where each alignment has its first and last tie."""
    return ties.groupBy("doc", "other", "shift").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))


def _aligned(lines: DataFrame, hashed: DataFrame) -> DataFrame:
    """Alignments -> verified passages. Of both texts only the words around the ties travel."""
    low, high = F.greatest(F.lit(0), F.col("low") - MARGIN), F.col("high") + PASSAGE + MARGIN
    pairs = lines.groupBy("doc", "other").agg(
        F.collect_list(F.struct("shift", "lo", "hi")).alias("lines"), F.min("lo").alias("low"), F.max("hi").alias("high"),
        F.min(F.col("lo") + F.col("shift")).alias("other_low"), F.max(F.col("hi") + F.col("shift")).alias("other_high"),
    )
    pairs = pairs.select("doc", "other", "lines", low.alias("a0"), high.alias("a1"), F.greatest(F.lit(0), F.col("other_low") - MARGIN).alias("b0"), (F.col("other_high") + PASSAGE + MARGIN).alias("b1"))

    def part(lo: str, hi: str):
        return F.substring("hashes", (2 * F.col(lo) + 1).cast("int"), (2 * (F.col(hi) - F.col(lo))).cast("int"))

    met = pairs.join(hashed, "doc").select("doc", "other", "lines", "a0", "b0", "b1", part("a0", "a1").alias("a"))
    met = met.join(hashed.withColumnRenamed("doc", "other"), "other").select("doc", "other", "lines", "a0", "b0", "a", part("b0", "b1").alias("b"))
    return map_batches(met, _verify, SPAN_SCHEMA)


def _spans(texts: DataFrame, same: DataFrame | None) -> DataFrame:
    def windows() -> DataFrame:
        return map_batches(texts, _window_rows, "key long, doc long, mark long")

    start, around = (lambda m: F.shiftright(m, 36)), (lambda m: F.shiftright(m, 8).bitwiseAND(F.lit((1 << 28) - 1)))
    # the least document's first mark of the key: plain numbers, merged before the shuffle
    first = windows().groupBy("key").agg(F.min("doc").alias("other"), F.max("doc").alias("last"), F.expr("min_by(mark, doc) FILTER (WHERE mark & 1 = 1)").alias("other_mark"))
    first = materialize(first.filter("other < last").select("key", "other", "other_mark"), "passage-groups")
    tied = windows().join(first.hint("shuffle_hash"), "key").withColumn("apart", around("mark") != around("other_mark")).filter("doc <> other OR apart")
    tied = materialize(tied.select("key", "doc", "other", start("mark").alias("start"), (start("other_mark") - start("mark")).alias("shift"), F.when(F.col("apart"), F.col("mark")).alias("mark")), "passage-ties")
    aligned = tied.filter("doc <> other").select("doc", "other", "shift", "start")
    needed = tied.select("doc").unionByName(aligned.select(F.col("other").alias("doc"))).distinct()
    hashed = materialize(map_batches(texts.join(needed.hint("shuffle_hash"), "doc", "left_semi"), _hash_rows, "doc long, hashes binary"), "passage-words")
    marks = tied.filter("mark IS NOT NULL").groupBy("doc").agg(F.collect_set("mark").alias("marks"))
    grams = materialize(map_batches(hashed.join(marks, "doc").select("doc", "marks", "hashes"), _gram_rows, "gram long, doc long, mark long"), "passage-grams")
    holder = grams.groupBy("gram").agg(F.min("doc").alias("other"), F.max("doc").alias("last"), F.expr("min_by(mark, doc) FILTER (WHERE mark & 1 = 1)").alias("other_mark")).filter("other < last").drop("last")
    held = grams.join(holder.hint("shuffle_hash"), "gram").filter("doc <> other")
    held = held.select("doc", "other", (F.shiftright("other_mark", 1) - F.shiftright("mark", 1)).alias("shift"), F.shiftright("mark", 1).alias("start"))
    pairs = _lines(aligned.unionByName(held))
    if same is not None:
        pairs = _of_other_ids(pairs, same)
    pairs = materialize(pairs, "passage-pairs")
    spans = materialize(_aligned(pairs, hashed), "passage-found")
    # near repeats whose tie failed: two keys at once
    failed = tied.filter("doc <> other").groupBy("doc").agg(F.collect_set(F.struct("key", "start")).alias("keys"))
    found = spans.groupBy("doc").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    more = materialize(map_batches(failed.join(found, "doc", "left").select("doc", "keys", F.coalesce("spans", F.array().cast("array<struct<start_word:bigint,end_word:bigint>>")).alias("spans")), _pair_keys, "key long, doc long, start long"), "passage-double")
    least = more.groupBy("key").agg(F.min("doc").alias("other"), F.max("doc").alias("last"), F.min_by("start", "doc").alias("other_start")).filter("other < last")
    again = more.join(least.drop("last").hint("shuffle_hash"), "key").filter("doc <> other").select("doc", "other", (F.col("other_start") - F.col("start")).alias("shift"), "start")
    again = _lines(again).join(pairs, ["doc", "other", "shift"], "left_anti")
    if same is not None:
        again = _of_other_ids(again, same)
    return spans.unionByName(_aligned(again, hashed))


def _of_other_ids(pairs: DataFrame, same: DataFrame) -> DataFrame:
    """Without pairs of rows that share their id."""
    a, b = same.select(F.col("number").alias("doc"), F.col("doc_id").alias("id_a")), same.select(F.col("number").alias("other"), F.col("doc_id").alias("id_b"))
    return pairs.join(a, "doc", "left").join(b, "other", "left").filter("coalesce(id_a, doc) <> coalesce(id_b, other)").drop("id_a", "id_b")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages [start_word, end_word) of doc_id that partner_doc_id, an earlier document, holds
    too. Each later holder of a passage is tied to an earlier one, so the first holder alone has no
    row. Earlier is the smaller id, but rows that repeat an id with different texts come before all
    others; text_digest (null elsewhere) tells whose words their rows count."""
    texts, same = _numbered(docs, id_col, text_col)
    spans = _spans(texts, same)
    doc, other, digest = F.col("doc"), F.col("other"), F.lit(None).cast("long")
    if same is not None:
        spans = spans.join(same.select(F.col("number").alias("doc"), F.col("doc_id").alias("id_a"), "digest"), "doc", "left").join(same.select(F.col("number").alias("other"), F.col("doc_id").alias("id_b")), "other", "left")
        doc, other, digest = F.coalesce("id_a", "doc"), F.coalesce("id_b", "other"), F.col("digest")
    return spans.select(doc.alias("doc_id"), "start_word", "end_word", other.alias("partner_doc_id"), "partner_start", "partner_end", digest.alias("text_digest"))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    raw = text.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(raw, dtype=np.uint8)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out.append(raw[at : int(starts[s])])
        at = int(starts[e]) if e < len(starts) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass").rstrip(" \t\n\r\x0b\x0c")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents, their repeated passages cut out of every holder but the first; documents of
    which no word is left go. length_col, where it exists, follows the text. Rows without an id
    stay as they are; rows that repeat an id and its text are cut alike."""
    spans = repeated_passages(docs, id_col, text_col).groupBy("doc_id", "text_digest").agg(F.collect_set(F.struct("start_word", "end_word")).alias(SPANS))
    spans = materialize(spans.withColumnsRenamed({"doc_id": OF, "text_digest": DIGEST}), "passage-spans")
    met = docs[id_col].cast("long") == spans[OF]
    if not spans.filter(spans[DIGEST].isNotNull()).isEmpty():
        met = met & F.coalesce(spans[DIGEST] == F.xxhash64(F.coalesce(docs[text_col], F.lit(""))), F.lit(True))
    joined = docs.join(spans.hint("shuffle_hash"), met, "left").select(*[docs[c] for c in docs.columns], spans[SPANS])
    joined = joined.toDF(*docs.columns, SPANS + "_" * sum(map(len, docs.columns)))  # a name that is longer than any other
    columns, t = docs.columns, docs.columns.index(text_col)
    n = columns.index(length_col) if length_col in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(columns)).to_pylist()
            arrays = [batch.column(i) for i in range(len(columns))]
            if any(spans):
                texts, keep = arrays[t].to_pylist(), [True] * len(spans)
                lengths = arrays[n].to_pylist() if n is not None else None
                for i, s in enumerate(spans):
                    if s:
                        texts[i] = _cut(texts[i], [(x["start_word"], x["end_word"]) for x in s])
                        keep[i] = bool(texts[i])
                        if lengths:
                            lengths[i] = len(texts[i])
                arrays[t] = pa.array(texts, arrays[t].type)
                if lengths:
                    arrays[n] = pa.array(lengths, arrays[n].type)
                yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return map_batches(joined, run, docs.schema)
