"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, suspect, threat, target, negation, report, pause (a comma), other.
Insults are learned: whole words and word beginnings (of 3 to 8 letters) that are frequent among
toxic training documents and all but absent from the others, next to a short list of plain ones.
Suspects are terms that clean documents hold too, but far more seldom than toxic ones; one by
itself says little. The other classes are closed lists in four languages.

Five small transducers read the symbols of a clause: how strong its hits are, whether a threat
stands there, whether it names a target, whether its hits are negated, and whether they are
reported. Negation and report reach over a few words and end at a pause, so that they count for
the hit behind them and for no other; a threat without a target is none. Their composition is one
table of states, and the state at a clause's end names the matched pattern. A document's score is
a logistic function of its matched clauses: the patterns' weights start at a prior and are fitted
to the training documents.

The training sample is bounded by SAMPLE rows (least hashes of ids first), a parameter; all that
is learned from it is bounded by it. Scoring reads every text whole. Null or empty texts have no
clause and get the base rate. A null id is a row that is not held out; rows that repeat an id are
scored each, and all of them train under the id's label; of several labels of an id the largest
holds. Without labels the prior weights stand. An empty table gives no rows. Other columns, whatever
their names, are not read."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import crc_fold, map_batches, materialize, text_or_empty

SAMPLE = 20_000
LEAST_DOCS = 6
PURITY = 0.9
#: A suspect is so many standard deviations more frequent among toxic documents than by chance.
SURPRISE = 6.0
PREFIXES = (3, 4, 5, 6, 7, 8)
FOLDS, HELD = 4, 2
THRESHOLD = 0.3

SEEDS = {
    "insult": "idiot moron imbecile scumbag bastard asshole bitch loser idiota imbécil estúpido gilipollas connard crétin salaud imbécile dummkopf arschloch trottel vollidiot",
    "threat": "kill murder hurt destroy shoot stab strangle matar mataré tuer tuerai töten umbringen",
    "target": "you your yours u they them their he she him her du dich dir ihr euch sie tu te vous toi tú usted vosotros ellos",
    "negation": "not no never without isn't aren't nicht kein keine nie ne pas jamais sin nunca jamás",
    "report": "said says say wrote called calls claimed quoted told sagte schrieb nannte dit écrit appelé dijo dice escribió llamó",
}
CLASSES = {w: kind for kind in ("report", "negation", "target", "threat", "insult") for w in SEEDS[kind].split()} | {",": "pause"}
SYMBOLS = ("other", "insult", "suspect", "threat", "target", "negation", "report", "pause")
HITS = ("insult", "suspect", "threat")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|,")
_CLAUSE = re.compile(r"[.!?;:\n]+")

#: Prior weights of the patterns, as log odds; the flags add up.
PRIOR = {"insult": 3.0, "suspects": 1.0, "suspect": 0.2, "threat": 2.0, "aimed": 0.5, "negated": -2.5, "reported": -1.5}
PRIOR_BASE, PRIOR_STRENGTH = -3.0, 1.0
#: Words that a negation and a report reach over.
REACH = {"negation": 3, "report": 6}


class Machine:
    """A deterministic transducer over SYMBOLS: moves[state][symbol] is the next state, says[state]
    what a clause that ends there says."""

    def __init__(self, moves: list[list[int]], says: list[tuple[str, ...]]) -> None:
        self.moves, self.says = moves, says

    @staticmethod
    def of(states: list[tuple[str, ...]], moves: dict[tuple[int, str], int]) -> Machine:
        return Machine([[moves.get((s, x), s) for x in SYMBOLS] for s in range(len(states))], states)

    @staticmethod
    def scoped(opener: str, word: str) -> Machine:
        """Says word if all hits stand within reach of the opener, before any pause. A state is how
        far it still reaches, and whether a hit was met outside and inside."""
        reach = REACH[opener]
        states = [(k, out, inside) for k in range(reach + 1) for out in (0, 1) for inside in (0, 1)]
        at = {s: n for n, s in enumerate(states)}

        def move(s: tuple[int, int, int], symbol: str) -> int:
            k, out, inside = s
            if symbol in HITS:
                out, inside = (out, 1) if k else (1, inside)
            k = reach if symbol == opener else 0 if symbol == "pause" else max(k - 1, 0)
            return at[k, out, inside]

        return Machine([[move(s, x) for x in SYMBOLS] for s in states], [(word,) if inside and not out else () for _, out, inside in states])

    def compose(self, other: Machine) -> Machine:
        """Both read the same symbols; state a * |other| + b."""
        n = len(other.moves)
        return Machine([[x * n + y for x, y in zip(a, b)] for a in self.moves for b in other.moves], [a + b for a in self.says for b in other.says])


#: nothing, one suspect, several, an insult
STRENGTH = Machine.of([(), ("suspect",), ("suspects",), ("insult",)], {(0, "suspect"): 1, (1, "suspect"): 2, **{(s, "insult"): 3 for s in range(3)}})
THREAT = Machine.of([(), ("threat",)], {(0, "threat"): 1})
AIMED = Machine.of([(), ("aimed",)], {(0, "target"): 1})
GRAMMAR = STRENGTH.compose(THREAT).compose(AIMED).compose(Machine.scoped("negation", "negated")).compose(Machine.scoped("report", "reported"))


def pattern(said: tuple[str, ...]) -> str | None:
    """The pattern's name: the strongest hit and the flags; None if nothing was hit. A threat needs a target."""
    hit = next((h for h in ("insult", "suspects") if h in said), None) or ("threat" if "threat" in said and "aimed" in said else "suspect" if "suspect" in said else None)
    return None if hit is None else "-".join([hit, *(f for f in ("aimed", "negated", "reported") if f in said)])


ENDS = [pattern(s) for s in GRAMMAR.says]
PATTERNS = sorted({p for p in ENDS if p})
PLACE = {p: k for k, p in enumerate(PATTERNS)}
PRIOR_WEIGHTS = np.array([sum(PRIOR[x] for x in p.split("-")) for p in PATTERNS])


class Lexicon:
    def __init__(self, insults: set[str], suspects: set[str] = frozenset()) -> None:
        self.insults, self.suspects, self.known = insults, suspects, {}

    def symbol(self, word: str) -> int:
        s = self.known.get(word)
        if s is None:
            kind = CLASSES.get(word)
            forms = [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]
            if kind != "insult" and any(f in self.insults for f in forms):
                kind = "insult"
            elif kind is None and any(f in self.suspects for f in forms):
                kind = "suspect"
            s = SYMBOLS.index(kind or "other")
            if len(self.known) < 400_000:
                self.known[word] = s
        return s

    def clauses(self, text: str) -> Counter:
        """How many clauses match each pattern."""
        out: Counter = Counter()
        low = text.lower()
        hits = [w for w in set(_WORD.findall(low)) if SYMBOLS[self.symbol(w)] in HITS]
        if not hits:
            return out
        for clause in _CLAUSE.split(low):
            if not any(h in clause for h in hits):
                continue
            state = 0
            for word in _WORD.findall(clause):
                state = GRAMMAR.moves[state][self.symbol(word)]
            if kind := ENDS[state]:
                out[kind] += 1
        return out


def features(found: Counter) -> np.ndarray:
    x = np.zeros(len(PATTERNS))
    for kind, n in found.items():
        x[PLACE[kind]] = np.log1p(n) / np.log(2)
    return x


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and base (log odds) of the logistic score, drawn to their priors; x holds distinct
    rows, times how often each with its y was seen. Newton steps."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    prior = np.concatenate([PRIOR_WEIGHTS, [PRIOR_BASE]])
    pull = np.full(len(prior), PRIOR_STRENGTH)
    pull[-1] = 0.1
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (times * p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9), a.T @ (times * (y - p)) - pull * (w - prior))
        w += step * min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def terms_of(text: str) -> set[str]:
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= 3}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def sketch(text: str) -> int:
    """The least hash of the text's 3-word shingles: near copies mostly share it."""
    w = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) & (2**63 - 1)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sketch(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "text", "y", "sketch"])


def _count_terms(only: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(terms_of(text) if only is None else terms_of(text) & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return run


def learn(train: DataFrame) -> tuple[set[str], set[str], np.ndarray, float]:
    """train (doc_id, text, y, sketch) -> insults, suspects, pattern weights, base. Terms are counted
    once for near copies, so that a word of one much-copied text is no evidence."""
    one = materialize(train.join(train.groupBy("sketch").agg(F.min("doc_id").alias("keep")), "sketch").filter("doc_id = keep").select("text", "y"), "toxic-one")
    n_toxic, n_clean = one.filter("y = 1").count(), one.filter("y = 0").count()
    # at most the sample's terms over LEAST_DOCS
    frequent = map_batches(one.filter("y = 1").select("text"), _count_terms(None), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    toxic = {r["term"]: r["n"] for r in frequent.collect()}
    clean = {r["term"]: r["n"] for r in map_batches(one.filter("y = 0").select("text"), _count_terms(frozenset(toxic)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()} if toxic else {}
    insults, suspects = set(), set()
    rate = n_toxic / max(1, n_toxic + n_clean)
    for t, n in toxic.items():
        m = clean.get(t, 0)
        share, other = n / max(n_toxic, 1), (m + 0.25) / (n_clean + 0.5)
        if share / (share + other) >= PURITY and m <= 0.05 * n:
            insults.add(t)
        elif n - (n + m) * rate >= SURPRISE * ((n + m) * rate * (1 - rate)) ** 0.5:
            suspects.add(t)
    lexicon = Lexicon(insults, suspects)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[tuple(sorted(lexicon.clauses(text).items())), y] += 1
        kinds = [[p for p, _ in found] for found, _ in total]
        counts = [[n for _, n in found] for found, _ in total]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())), pa.array([y for _, y in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["kinds", "counts", "y", "n"])

    schema = "kinds array<string>, counts array<long>, y int, n long"
    rows = map_batches(train.select("text", "y"), seen, schema).groupBy("kinds", "counts", "y").agg(F.sum("n").alias("n")).orderBy("kinds", "counts", "y").collect()  # the sample's rows at most
    x = np.array([features(Counter(dict(zip(r["kinds"], r["counts"])))) for r in rows]).reshape(-1, len(PATTERNS))
    weights, base = fit(x, np.array([r["y"] for r in rows], dtype=float), np.array([r["n"] for r in rows], dtype=float))
    return insults, suspects, weights, base


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_clauses."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    marks = labels.filter(F.col(label_col).isNotNull() & (crc_fold(id_col, FOLDS) != HELD)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    # at most sample rows of two numbers: the one side here that may be broadcast
    chosen = materialize(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "toxic-sample")
    train = materialize(map_batches(texts.join(F.broadcast(chosen), "doc_id"), _sketches, "doc_id long, text string, y int, sketch long"), "toxic-train")
    insults, suspects, weights, base = learn(train)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(insults, suspects)
        for batch in batches:
            found = [lexicon.clauses(t) for t in batch.column(1).to_pylist()]
            s = 1 / (1 + np.exp(-np.clip(np.array([features(f) @ weights if f else 0.0 for f in found]) + base, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array([sum(f.values()) for f in found], pa.int64())], names=["doc_id", "score", "predicted", "n_clauses"])

    scored = map_batches(texts, score, "doc_id long, score double, predicted int, n_clauses long")
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", "predicted", "n_clauses")
