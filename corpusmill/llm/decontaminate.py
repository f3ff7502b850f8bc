"""Benchmark decontamination by spaced seeds; DataFrame functions only.

A seed hashes the words at the set positions of a fixed mask, so that a substituted word at an
ignored position does not hide a copy. Seeds of every position of every document are joined with
those of the benchmark. A bitmap of the benchmark's seeds, a literal in the scan, passes over
nearly all positions before that: it takes BITS bits a seed, MAX_BITS bits at most (beyond that more
positions survive it, and the result stays the same), so that one plan serves any benchmark. Only
documents with a hit are read a second time, for their words.

Each hit aligns the item with one place of the document. Alignments whose shifts follow one another
by at most SLACK words (insertions, deletions) are one place; the equal words of all alignments of a
place are counted over the item there, never together with those of another place. A document
holds an item if at one place min_coverage of the item's words stand, or, of a longer item, LOCAL
words within some LOCAL_SPAN of its consecutive words.

Items of fewer words than the first mask spans match as a whole sequence, those below MIN_ITEM
words only a document that has no other words. Null texts are empty, and items without a word
match nothing. Repeated items each give their own row (they are searched for once); repeated
documents too, and rows with a null id. Either table may be empty. Only ids and texts are read;
other columns and their names do not matter."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, text_or_empty

#: Offsets read by each mask; the others within the span are ignored.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 3, 5, 9))
MIN_COVERAGE = 0.5
LOCAL, LOCAL_SPAN = 24, 30
SLACK = 3
MIN_ITEM = 4
BITS, MAX_BITS = 64, 1 << 26
#: Positions of a text that are laid out at once.
CHUNK = 4096


def word_array(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def _rows(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(name, row, text): row is a hash of id and text, alike in every scan of the table."""
    text = text_or_empty(text_col)
    return df.select(F.col(id_col).cast("long").alias(name), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), text.alias("text"))


def _words(rows: DataFrame, name: str) -> DataFrame:
    # the generator keeps the split from being repeated inside lambdas
    return rows.select(name, "row", F.explode(F.array(word_array(F.col("text")))).alias("w"))


def _places(words: DataFrame, keys: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """(keys, n, at, s0, s1, ...): a row for each position of w, with the seed of each mask there, null
    where the words end before the mask does. Long texts come in pieces of CHUNK positions."""
    offsets = sorted({o for m in masks for o in m})
    hashed = words.select(*keys, F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    pieces = hashed.select(*keys, "n", "h", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(CHUNK))).alias("base"))
    shifted = pieces.select(*keys, "n", "base", *[F.slice("h", F.col("base") + 1 + o, F.lit(CHUNK)).alias(f"h{o}") for o in offsets])
    each = shifted.select(*keys, "n", "base", F.posexplode(F.arrays_zip(*[f"h{o}" for o in offsets])).alias("p", "z"))
    seeds = []
    for k, m in enumerate(masks):
        able = F.col(f"z.h{m[-1]}").isNotNull()
        if len(m) < MIN_ITEM:
            able = able & (F.col("n") == len(m))
        seeds.append(F.when(able, F.xxhash64(F.lit(k), *[F.col(f"z.h{o}") for o in m])).alias(f"s{k}"))
    return each.select(*keys, "n", (F.col("base") + F.col("p")).alias("at"), *seeds)


def _listed(places: DataFrame, keys: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """(keys, at, seed): one row a seed."""
    return places.select(*keys, "at", F.explode(F.array_compact(F.array(*[f"s{k}" for k in range(len(masks))]))).alias("seed"))


def _bitmap(hashes: DataFrame) -> tuple[Column, int]:
    """The bits of hashes (seed) as a literal array of longs, and how many bits it has."""
    size = 1024
    n = hashes.count()
    while size < min(BITS * n, MAX_BITS):
        size *= 2
    words = [0] * (size // 64)
    cell = F.shiftright(F.col("seed").bitwiseAND(F.lit(size - 1)), 6)
    bit = F.expr("shiftleft(1L, CAST(seed & 63 AS INT))")
    for r in hashes.groupBy(cell.alias("cell")).agg(F.bit_or(bit).alias("bits")).collect():  # size / 64 rows at most
        words[r["cell"]] = r["bits"]
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>"), size


def _known(seed: Column, bitmap: Column, size: int) -> Column:
    """The seed, or null if its bit says that it is none of the bitmap's."""
    held = F.get(bitmap, F.shiftright(seed.bitwiseAND(F.lit(size - 1)), 6).cast("int"))
    return F.when(F.getbit(held, seed.bitwiseAND(F.lit(63)).cast("int")) == 1, seed)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_matched, item_words, coverage, first_word): each item that a document
    holds, at the place that has the most of it."""
    named = materialize(_words(_rows(benchmark, item_col, item_text, "item_id"), "item_id").filter(F.size("w") > 0).select("item_id", "w"), "bench-items")
    items = materialize(named.select("w").distinct().withColumn("item", F.monotonically_increasing_id()), "bench-words")
    short = [r["n"] for r in items.select(F.size("w").alias("n")).filter(F.col("n") <= MASKS[0][-1]).distinct().collect()]  # a few small numbers
    masks = [*MASKS, *[tuple(range(n)) for n in sorted(short)]]
    own = [f"s{k}" if k < len(MASKS) else F.when((F.col("n") == len(m)) & (F.col("at") == 0), F.col(f"s{k}")).alias(f"s{k}") for k, m in enumerate(masks)]
    bench = materialize(_listed(_places(items, ["item"], masks).select("item", "at", *own), ["item"], masks).withColumnRenamed("at", "item_at"), "bench-seeds")
    bitmap, size = _bitmap(bench)
    keys = ["row", "doc_id"]
    seen = [_known(F.col(f"s{k}"), bitmap, size).alias(f"s{k}") for k in range(len(masks))]
    rows = _rows(docs, id_col, text_col, "doc_id")
    places = _places(_words(rows, "doc_id"), keys, masks).select(*keys, "at", *seen).filter(" OR ".join(f"s{k} IS NOT NULL" for k in range(len(masks))))
    hits = _listed(places, keys, masks).join(bench, "seed")
    aligned = materialize(hits.select(*keys, "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "bench-aligned")
    # documents with a hit, once for all rows alike in id and text; a bitmap again spares the others the join
    met_rows = materialize(aligned.select(F.col("row").alias("seed")).distinct(), "bench-rows")
    few = rows.filter(_known(F.col("row"), *_bitmap(met_rows)).isNotNull())
    held = _words(few, "doc_id").join(met_rows, F.col("row") == F.col("seed"), "left_semi")
    held = materialize(held.groupBy("row", "doc_id", "w").agg(F.count(F.lit(1)).alias("copies")), "bench-hits")
    pair = Window.partitionBy("row", "doc_id", "item").orderBy("shift")
    far = F.coalesce(F.col("shift") - F.lag("shift").over(pair) > SLACK, F.lit(False)).cast("int")
    lined = aligned.withColumn("far", far).withColumn("place", F.sum("far").over(pair)).drop("far")
    lined = lined.join(items.select("item", F.size("w").alias("item_words")), "item")
    skipped = F.greatest(F.lit(0), -F.col("shift"))  # words of the item before the document's begin
    stretch = F.slice("w", F.greatest(F.lit(0), F.col("shift")) + 1, F.col("item_words") - skipped)
    same_doc = (lined["row"] == held["row"]) & lined["doc_id"].eqNullSafe(held["doc_id"])
    met = lined.join(held, same_doc).select(lined["row"], lined["doc_id"], "copies", "item", "item_words", "place", "shift", skipped.alias("skipped"), stretch.alias("dw"))
    met = met.join(items, "item")
    same = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda j: F.get(F.col("dw"), F.when(j >= F.col("skipped"), j - F.col("skipped")).otherwise(F.lit(-1))) == F.get(F.col("w"), j))
    each = met.select("row", "doc_id", "copies", "item", "item_words", "place", "shift", F.explode(same).alias("j"))
    found = each.groupBy("row", "doc_id", "copies", "item", "item_words", "place").agg(F.array_sort(F.collect_set("j")).alias("held"), F.min(F.greatest(F.col("shift"), F.lit(0))).alias("first_word"))
    local = F.exists(F.sequence(F.lit(0), F.size("held") - LOCAL), lambda i: F.get(F.col("held"), i + LOCAL - 1) - F.get(F.col("held"), i) < LOCAL_SPAN)
    enough = (F.size("held") >= min_coverage * F.col("item_words")) | F.when(F.size("held") >= LOCAL, local).otherwise(F.lit(False))
    best = F.max(F.struct(F.size("held").alias("n"), (-F.col("first_word")).alias("at"))).alias("best")
    found = found.filter(enough).groupBy("row", "doc_id", "copies", "item", "item_words").agg(best)
    named = named.join(items, "w").select("item_id", "item")
    coverage = F.round(F.col("best.n") / F.col("item_words"), 6)
    found = found.join(named, "item").withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return found.select("doc_id", "item_id", F.col("best.n").cast("long").alias("n_matched"), F.col("item_words").cast("long"), coverage.alias("coverage"), (-F.col("best.at")).cast("long").alias("first_word"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, in which no item is found. Rows with a null id are
    judged by nothing and stay."""
    found = contaminated(docs, benchmark, id_col, text_col, **options).filter("doc_id is not null").select(F.col("doc_id").alias("corpusmill_gone")).distinct()
    found = materialize(found, "bench-found")
    return docs.join(found.hint("shuffle_hash"), docs[id_col].cast("long") == found["corpusmill_gone"], "left_anti")
