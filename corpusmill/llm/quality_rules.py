"""Quality rules as weak supervision. Each rule judges one count of a text and votes good (+1), bad
(-1) or abstains (0); expectation-maximisation over the histogram of vote patterns estimates, of
each rule, how often its votes are bad on good and on bad documents, and a document is kept by its
posterior quality: one bad vote of a rule that is often wrong does not reject it, as all-must-pass
would, and several weak ones together do.

The histogram has at most 3^10 rows whatever the corpus, so the fit runs on the driver over
exact counts of all documents. Nulls count as empty texts (no words, base_failed, not kept); a
null id is a row like any other; repeated rows vote each time; a posterior of just the threshold
keeps; an empty table gives an empty result. Other columns, whatever their names, are not read;
keep_good returns them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusmill.llm.common import map_batches, materialize, text_or_empty
from corpusmill.llm.textstats import Stats, stats

RULES = ("symbols", "capitals", "bangs", "repeats", "variety", "neighbours", "sentences", "lines", "edges", "punctuation")
MIN_WORDS = 50
REPEAT_PERCENT = 50
ROUNDS = 500
#: Votes that stand for each rule and class before the corpus speaks, and how they are cast: good
#: texts mostly please a rule, bad ones displease a few of the rules only.
PRIOR_VOTES, PRIOR_GOOD, PRIOR_BAD, PRIOR_SHARE = 20, 0.97, 0.3, 0.8


def base_failed(s: Stats) -> bool:
    return s.n_words < MIN_WORDS or 100 * s.n_repeat_words > REPEAT_PERCENT * s.n_words


def votes(s: Stats) -> tuple[int, ...]:
    """Each rule by its own counts alone: bad above (or below) one mark, good on the other side of
    a second, no vote between them or where the text is too short to tell."""
    n = s.n_words
    if not n:
        return (0,) * len(RULES)

    def vote(bad: bool, good: bool, able: bool = True) -> int:
        return 0 if not able else -1 if bad else int(good)

    return (
        vote(s.n_symbols > 0.05 * n, s.n_symbols <= 0.01 * n),
        vote(s.n_upper > 0.15 * s.n_letters, s.n_upper <= 0.08 * s.n_letters, s.n_letters >= 20),
        vote(s.n_bangs > 0.05 * n, s.n_bangs <= 0.01 * n),
        vote(s.n_repeat_words > 0.2 * n, s.n_repeat_words <= 0.1 * n),
        vote(s.n_distinct_words < 0.25 * min(n, 300), s.n_distinct_words >= 0.4 * min(n, 300), n >= 40),
        vote(s.n_same_neighbours > 0.06 * n, s.n_same_neighbours <= 0.03 * n),
        vote(not 0.004 * n <= s.n_stops <= 0.4 * n, 0.02 * n <= s.n_stops <= 0.25 * n, n >= 40),
        vote(s.n_dup_lines > 0.3 * s.n_lines, s.n_dup_lines <= 0.1 * s.n_lines, s.n_lines >= 4),
        vote(s.n_symbol_ends > 0.1 * n, s.n_symbol_ends <= 0.02 * n),
        vote(s.n_punctuation > 0.12 * s.word_chars, s.n_punctuation <= 0.08 * s.word_chars),
    )


def pattern(vote: tuple[int, ...]) -> int:
    code = 0
    for v in vote:
        code = code * 3 + v + 1
    return code


def unpack(code: int) -> list[int]:
    out = []
    for _ in RULES:
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


class Model(NamedTuple):
    """share of good documents; by rule, how often a vote that it casts on a good (on a bad)
    document is bad."""

    share: float
    bad_of_good: np.ndarray
    bad_of_bad: np.ndarray

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        g, b = self.bad_of_good, self.bad_of_bad
        pull = (cast < 0) @ np.log(g / b) + (cast > 0) @ np.log((1 - g) / (1 - b))
        return 1 / (1 + np.exp(-np.clip(np.log(self.share / (1 - self.share)) + pull, -60, 60)))


def fit(counts: dict[int, int]) -> tuple[Model, dict[int, float]]:
    """The model and the posterior quality of each vote pattern. EM estimates both rates of each
    rule and the share of good documents; an abstention says nothing. The priors, worth
    PRIOR_VOTES votes a rule and class, tell which class is the good one."""
    codes = sorted(counts)
    weight = np.array([counts[c] for c in codes], dtype=float)
    cast = np.array([unpack(c) for c in codes]).reshape(-1, len(RULES))
    good, bad = (cast > 0).astype(float), (cast < 0).astype(float)
    model = Model(PRIOR_SHARE, np.full(len(RULES), 1 - PRIOR_GOOD), np.full(len(RULES), PRIOR_BAD))
    post = model.posterior(cast)
    for _ in range(ROUNDS):
        rates = []
        for w, prior in ((weight * post, 1 - PRIOR_GOOD), (weight * (1 - post), PRIOR_BAD)):
            rates.append((w @ bad + PRIOR_VOTES * prior) / (w @ (bad + good) + PRIOR_VOTES))
        model = Model((weight @ post + PRIOR_VOTES * PRIOR_SHARE) / (weight.sum() + PRIOR_VOTES), *rates)
        last, post = post, model.posterior(cast)
        if not len(codes) or np.abs(post - last).max() < 1e-9:
            break
    return model, {c: float(p) for c, p in zip(codes, post)}


STATS_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern int"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [stats(t) for t in batch.column(1).to_pylist()]
        ints = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *ints, pa.array([base_failed(r) for r in rows], pa.bool_()), pa.array([pattern(votes(r)) for r in rows], pa.int32())],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "pattern"],
        )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), _measure, STATS_SCHEMA)


def posteriors(measured: DataFrame) -> dict[int, float]:
    """Fitted over every document that is not base_failed; at most 3^10 rows reach the driver."""
    rows = measured.filter(~F.col("base_failed")).groupBy("pattern").count().collect()
    return fit({r["pattern"]: r["count"] for r in rows})[1]


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: counts, base_failed, posterior, kept."""
    measured = materialize(measure(docs, id_col, text_col), "quality-stats")
    fitted = posteriors(measured)
    spark = docs.sparkSession
    lookup = spark.createDataFrame(list(fitted.items()), "pattern int, posterior double") if fitted else None
    if lookup is None:
        out = measured.withColumn("posterior", F.lit(0.0))
    else:
        out = measured.join(F.broadcast(lookup), "pattern", "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= threshold)).alias("kept"),
        F.when(F.col("base_failed"), F.lit(0.0)).otherwise(F.coalesce("posterior", F.lit(0.0))).alias("posterior"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score_quality keeps, with all their columns. They are written once with
    their vote pattern beside them, which the verdicts then select, so that each text is measured
    once and none is shuffled."""
    position = docs.columns.index(text_col)
    mark = "corpusmill_pattern" + "_" * sum(map(len, docs.columns))  # a name that is longer than any other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [stats(t) for t in batch.column(position).to_pylist()]
            marks = pa.array([None if base_failed(r) else pattern(votes(r)) for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*batch.schema.names, mark])

    schema = StructType([*docs.schema.fields, StructField(mark, IntegerType())])
    marked = materialize(map_batches(docs, run, schema), "quality-marked")
    counts = marked.filter(F.col(mark).isNotNull()).groupBy(mark).count().collect()  # 3^10 rows at most
    good = [c for c, p in fit({r[mark]: r["count"] for r in counts})[1].items() if p >= threshold]
    return marked.filter(F.col(mark).isin(good)).drop(mark)
