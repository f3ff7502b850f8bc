"""Small fixtures against brute force, with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing extra columns."""

import gzip
import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import classifier, decontaminate, licenses, packing, quality_rules, simhash, substring, tokencount, toxicity, warc

RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + (". " if i % 12 == 11 else "") for i in range(n)).replace("  ", " ")


PASSAGE = prose(70, 1)
ITEM = prose(30, 2)
TEXTS = [
    prose(300, 10), prose(300, 10), prose(300, 10).replace(" ", "  ", 1), None, "", "one", "Two Words", prose(200, 11) + " " + PASSAGE, PASSAGE.upper() + " " + prose(150, 12),
    prose(100, 13) + " " + PASSAGE + " " + prose(100, 14), prose(120, 15) + " " + ITEM + " " + prose(40, 16), prose(90, 17) + " " + ITEM.split(" ", 15)[0] + " " + " ".join(["zz" if i % 9 == 4 else w for i, w in enumerate(ITEM.split())]),
    prose(9000, 18), "\n".join(["same line here"] * 40), prose(60, 19) + "### " * 40, "été déjà vu " * 30, "x " * 200, prose(80, 20) + "\nReleased under the MIT License.\n" + prose(20, 21),
]
SCHEMA = "n_words string, doc_id long, text string, lang string, source string, n_chars long, component_id string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("7", i, t, "en", "s", len(t or ""), "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, ITEM), (1, None), (2, "too short"), (3, prose(40, 99))], "item_id long, text string")


def test_simhash_equals_brute_force(docs, none):
    def fp(t):
        w = [x for x in (t or "").translate(str.maketrans(simhash.AZ, simhash.AZ.lower())).encode().split()]
        hs = [xxhash.xxh64_intdigest(s, 42) for s in ([a + b" " + b for a, b in zip(w, w[1:])] or w[:1])]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))

    want = [fp(t) for t in TEXTS]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    group = list(range(len(want)))
    for _ in want:
        for i, a in enumerate(want):
            for j, b in enumerate(want):
                if (a ^ b).bit_count() <= 6:
                    group[i] = group[j] = min(group[i], group[j])
    for i, a in enumerate(want):
        assert got[i].fingerprint == f"{a:016x}"
        assert got[i].n_near == sum((a ^ b).bit_count() <= 6 for b in want) - 1
        assert got[i].component_id == group[i]
    assert simhash.near_duplicates(none).count() == 0
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {i for i, g in enumerate(group) if i == g}


def test_embedding_bounds_hamming(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    pairs = [(simhash._signed(r.getrandbits(64)), simhash._signed(r.getrandbits(64))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for row in df.select("a", "b", simhash.manhattan(simhash.embedding(F.col("a")), simhash.embedding(F.col("b"))).alias("m")).collect():
        a, b = row.a & (2**64 - 1), row.b & (2**64 - 1)
        want = sum(abs((a >> 2 * s & 3).bit_count() - (b >> 2 * s & 3).bit_count()) for s in range(32))
        assert row.m == want <= (a ^ b).bit_count()


def brute_contaminated(texts, items):
    """{(text, item)} by all alignments: places are runs of shifts with a seed hit."""
    import re

    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    out = set()
    for d, text in enumerate(texts):
        w = words(text)
        for k, item in enumerate(items):
            iw = words(item)
            masks = decontaminate.MASKS if len(iw) > 7 else [tuple(range(len(iw)))] if iw and (len(iw) >= 4 or len(w) == len(iw)) else []
            shifts = sorted({i - j for m in masks for j in range(len(iw) - m[-1]) for i in range(len(w) - m[-1]) if all(w[i + o] == iw[j + o] for o in m)})
            places = []
            for s in shifts:
                places.append([*places.pop(), s]) if places and s - places[-1][-1] <= decontaminate.SLACK else places.append([s])
            for place in places:
                held = sorted({j for s in place for j in range(len(iw)) if 0 <= j + s < len(w) and w[j + s] == iw[j]})
                if 2 * len(held) >= len(iw) or any(b - a < 30 for a, b in zip(held, held[23:])):
                    out.add((d, k))
    return out


def test_decontamination_equals_brute_force(spark, docs, none, bench):
    found = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) == {(10, 0), (11, 0)} and found[10, 0] == 1 and 0.8 < found[11, 0] < 1
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()} == set(range(len(TEXTS))) - {10, 11}
    r = random.Random(8)
    items = [prose(n, 700 + n) for n in (9, 12, 30, 59, 100, 150)] + ["five short words in here", "two words", "", None, prose(30, 730)]
    texts = [None, "", "Two, words!", "two words more", "and five short words in here too", prose(40, 1)]
    for k, item in enumerate(items[:6]):
        w = item.split()
        for piece in (w, w[: len(w) // 2], w[len(w) // 3 :][:40], [x if r.random() > 0.15 else "zz" for x in w], w[: len(w) // 2] + ["zz", "zz"] + w[len(w) // 2 :], w[:10] + prose(300, 40 + k).split() + w[10:20]):
            texts.append(" ".join([*prose(60, 800 + len(texts)).split(), *piece, *prose(60, 900 + len(texts)).split()]))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == brute_contaminated(texts, items)
    assert {k for _, k in got} >= {0, 1, 2, 3, 4, 5, 6, 7, 10}


def test_decontamination_equals_its_sql(spark):
    import duckdb

    from corpusmill.llm import queries

    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL["op7_decontamination"])
    names = [d[0] for d in want.description]
    df = queries.op7_decontamination(spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(want.fetchall())


def test_repeated_passages_are_covered_and_cut(docs, none):
    rows = substring.repeated_passages(docs).collect()
    spans = {}
    for r in rows:
        assert r.partner_doc_id < r.doc_id and r.end_word - r.start_word >= 50
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    first = {}
    for i, t in enumerate(TEXTS):
        w = substring.words_of(t or "")
        covered = {x for s, e in spans.get(i, ()) for x in range(s, e)}
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) != i:
                assert covered >= set(range(k, k + 50)), (i, k)
    kept = {r.doc_id: r for r in substring.without_repeats(docs).collect()}
    assert 1 not in kept and kept[0].text == TEXTS[0] and kept[8].n_chars == len(kept[8].text) and kept[7].text == TEXTS[7]
    assert substring.repeated_passages(none).count() == 0 and substring.without_repeats(none).count() == 0


def test_passages_are_found_where_the_least_document_holds_part(spark):
    texts = []
    for k in range(40):
        r = random.Random(400 + k)
        shared, part, at = prose(50 + k % 3 * 5, 200 + k).split(), 29 + r.randrange(21), 0
        at = r.randrange(len(shared) - part + 1)
        least = [*prose(60, 300 + k).split(), *shared[at : at + part], *prose(60, 500 + k).split()]
        if k % 4 == 0:  # the least document has the part twice
            least += [*shared[at : at + part], *prose(80, 600 + k).split()]
        later = [[*prose(70, 700 + 10 * k + j).split(), *shared, *prose(70, 900 + 10 * k + j).split()] for j in range(2)]
        texts += [" ".join(w) for w in (least, *later)]
    spans = {}
    for r in substring.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        spans.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    first = {}
    for i, t in enumerate(texts):
        w = substring.words_of(t)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) != i:
                assert spans.get(i, set()) >= set(range(k, k + 50)), (i, k)


def test_near_repeats_are_found(spark):
    r, rows, cases = random.Random(6), [], []
    for n in (60, 100, 200):
        for every in (12, 15, 20, 25, 0.05, 0.1):
            for _ in range(15):
                p = prose(n, r.random()).split()
                q = [r.choice(VOCAB) if (r.random() < every if every < 1 else i % every == every // 2) else w for i, w in enumerate(p)]
                a, b = ([*prose(r.randint(40, 120), r.random()).split(), *x, *prose(60, r.random()).split()] for x in (p, q))
                ids = {}
                x, y = (np.array([ids.setdefault(w, len(ids)) for w in substring.words_of(" ".join(t))], dtype=np.uint32) for t in (a, b))
                cases.append((len(rows) + 1, bool(substring.shared_passages(y, x, list(range(-len(y), len(x)))))))
                rows += [" ".join(a), " ".join(b)]
    found = {x.doc_id for x in substring.repeated_passages(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect()}
    there = [k for k, held in cases if held]
    assert len(there) > 200 and sum(k in found for k in there) >= 0.95 * len(there)
    assert not {k for k, held in cases if not held} & found


def test_passages_of_repeated_and_null_ids(spark):
    passages = [prose(60, 1000 + k) for k in range(4)]
    body = lambda k, *held: " ".join([prose(70, 1100 + k), *held, prose(70, 1200 + k)])
    rows = [(1, body(1, passages[0])), (1, body(2, passages[0], passages[1])), (2, body(3, passages[1])), (3, body(4, passages[2])), (3, body(4, passages[2])), (None, body(5, passages[2])), (4, body(6, passages[2], passages[3])), (4, body(7, passages[3])), (None, None), (5, ""), (6, None)]
    df = spark.createDataFrame([(7, i, t, "x") for i, t in rows], "corpusmill_of long, doc_id long, text string, corpusmill_spans string")
    got = {(r.doc_id, r.partner_doc_id) for r in substring.repeated_passages(df).collect()}
    assert got in ({(2, 1), (4, 3)}, {(2, 1), (3, 4)})  # 4 has two texts, which come before 3's
    kept = substring.without_repeats(df)
    assert kept.columns == df.columns and kept.count() == len(rows)
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert (1, rows[0][1]) in texts and (1, rows[1][1]) in texts and (None, rows[5][1]) in texts and (None, None) in texts and (5, "") in texts
    assert all(passages[1] not in t for i, t in texts if i == 2)
    assert sum(passages[2] in t for i, t in texts if i in (3, 4)) == (2 if (4, 3) in got else 1)


def test_chains_outlast_many_shifts():
    a = np.arange(61, dtype=np.uint32)
    b = np.concatenate([a, *[np.concatenate([a[k : k + 6], np.arange(1000 * k, 1000 * k + 14)]) for k in range(1, 25, 2)]]).astype(np.uint32)
    b[30] = 99999
    shifts = [0, *[61 + 20 * n - k for n, k in enumerate(range(1, 25, 2))]]
    assert substring.shared_passages(a, b, shifts) == [(0, 61, 0, 61)]


def test_compact_windows_equal_brute_force():
    r = np.random.default_rng(0)
    for n, width in ((60, 7), (40, 40), (5, 9), (50, 1)):
        v = r.integers(0, 12, n).astype(np.uint64)
        left, centre, right = substring.compact_windows(v, width)
        want = [(max([j for j in range(c) if v[j] <= v[c]], default=-1) + 1, c, min([j for j in range(c, n) if v[j] < v[c]], default=n) - 1) for c in range(n)]
        assert list(zip(left.tolist(), centre.tolist(), right.tolist())) == [w for w in want if w[2] - w[0] + 1 >= width]


def test_packing_round_trip(docs, none):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs).collect()
    places, pieces = {}, {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 4096
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            part = ids[4096 * k : 4096 * (k + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 4096 * k, len(part), zlib.crc32(part.tobytes()))
    assert packing.pack(none).count() == 0
    assert len(places) <= best_fit(sorted((r.length for r in rows), reverse=True))


def best_fit(lengths, size=4096):
    """How many sequences best-fit decreasing takes."""
    left = []
    for n in lengths:
        fits = [k for k, room in enumerate(left) if room >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(size - n)
    return len(left)


def test_packing_in_salted_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    texts = [(i, prose(5 + i % 4, 4000 + i % 7)) for i in range(200)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == 200 and all(sum(n for _, n in x) == max(o + n for o, n in x) <= 4096 and len({o for o, _ in x}) == len(x) for x in at.values())
    assert len(at) <= best_fit(sorted((r.length for r in rows), reverse=True))


def test_nnls_solves():
    a, x = np.abs(np.random.default_rng(1).normal(size=(12, 30))), np.zeros(30)
    x[[3, 9]] = 2.0, 5.0
    assert np.allclose(a @ packing.nnls(a, a @ x), a @ x, atol=1e-6)


def test_token_counts_and_cache(spark, docs, none, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = {r.doc_id: r for r in tokencount.token_counts(docs, cache).collect()}
        for i, text in enumerate(TEXTS):
            n = len(t.encode(text or "", add_special_tokens=False).ids)
            assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 512)
    assert tokencount.read_cache(spark, cache).count() == len({t or "" for t in TEXTS})
    assert len([p for p in (tmp_path / "cache").iterdir() if p.is_dir()]) == 2  # the second run added nothing
    assert tokencount.shared_cache(spark) == tokencount.shared_cache(spark)
    assert tokencount.token_counts(none).count() == 0


def test_quality_rules(docs, none):
    got = {r.doc_id: r for r in quality_rules.score_quality(docs).collect()}
    for i, text in enumerate(TEXTS):
        w = (text or "").encode().split()
        tri = list(zip(w, w[1:], w[2:]))
        rep = sum(any(tri.count(tri[j]) > 1 for j in range(max(0, k - 2), min(k + 1, len(tri)))) for k in range(len(w))) if len(w) < 400 else got[i].n_repeat_words
        lines = [x for x in (text or "").split("\n") if x.split()]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), rep, len(lines) - len(set(lines)))
        assert got[i].word_chars == sum(len(x.decode()) for x in w) and got[i].n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")
        assert got[i].base_failed == (len(w) < 50 or 100 * rep > 50 * len(w)) and not (got[i].kept and got[i].base_failed)
    assert got[0].kept and not got[14].kept
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.score_quality(none).count() == 0


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    for rows, col, least in ((classifier.quality_scores(docs, labels).collect(), "quality", 0.96), (toxicity.toxicity_scores(docs, labels).collect(), "toxic", 0.94)):
        held = [(r.predicted, truth[r.doc_id][col]) for r in rows if r.held_out and r.doc_id in truth]
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert sum(a == b for a, b in held) / len(held) >= least
        right = {y: [p == y for p, t in held if t == y] for y in (0, 1)}
        assert sum(sum(v) / len(v) for v in right.values()) / 2 >= 0.92


def test_classifiers_without_labels_and_rows(docs, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classifier.quality_scores(docs, labels).count() == len(TEXTS) and toxicity.toxicity_scores(docs, labels).count() == len(TEXTS)
    assert classifier.quality_scores(none, labels).count() == 0


def test_toxic_grammar_composes():
    lex = toxicity.Lexicon(set(), {"grubby", "sly*"})
    for text, want in (
        ("you are an idiot. Nothing here.", ["insult-aimed"]), ("he is not a moron", ["insult-aimed-negated"]), ("someone said scumbag", ["insult-reported"]),
        ("not smart, you idiot", ["insult-aimed"]), ("no doubt you are an idiot", ["insult-aimed"]), ("you are not an absolute idiot", ["insult-aimed-negated"]),
        ("no idiot but a moron", ["insult"]), ("they said it, moron", ["insult-aimed"]), ("I will kill you", ["threat-aimed"]), ("the cat killed time and will kill more", []),
        ("a grubby thing", ["suspect"]), ("a grubby slyness", ["suspects"]), ("", []),
    ):
        assert list(lex.clauses(text)) == want, text


def test_composed_grammar_equals_its_machines():
    r = random.Random(2)
    parts = [toxicity.STRENGTH, toxicity.THREAT, toxicity.AIMED, toxicity.Machine.scoped("negation", "negated"), toxicity.Machine.scoped("report", "reported")]
    for _ in range(300):
        read = [r.randrange(len(toxicity.SYMBOLS)) for _ in range(r.randrange(12))]
        state, each = 0, [0] * len(parts)
        for x in read:
            state = toxicity.GRAMMAR.moves[state][x]
            each = [m.moves[s][x] for m, s in zip(parts, each)]
        assert toxicity.GRAMMAR.says[state] == tuple(w for m, s in zip(parts, each) for w in m.says[s])


def test_toxic_fit_follows_labels_and_prior():
    x, w = np.zeros((2, len(toxicity.PATTERNS))), toxicity.PRIOR_WEIGHTS
    assert np.allclose(toxicity.fit(x[:0], np.zeros(0), np.zeros(0))[0], w)
    x[0, toxicity.PLACE["suspect"]] = 1
    fitted, base = toxicity.fit(x, np.array([1.0, 0.0]), np.array([500.0, 500.0]))
    assert fitted[toxicity.PLACE["suspect"]] + base > 2 > -2 > base


def test_license_alignment(docs, none):
    rows = licenses.license_scan(docs).collect()
    assert [(r.doc_id, r.license) for r in rows] == [(17, "MIT")]
    assert licenses.align("a x b c d".split(), "a b c y d".split()) == [(0, 0), (2, 1), (3, 2), (4, 4)]
    assert licenses.license_scan(none).count() == 0


def names(text, templates=licenses.TEMPLATES, least=licenses.MIN_COVERAGE):
    return [f[0] for f in licenses.Scanner(templates, least).scan(text)]


def test_notices_are_found_without_the_word_license():
    for name, text in licenses.TEMPLATES:
        broken = text.replace("{", "").replace("}", "").replace(" ", "\n")
        assert names(prose(80, 30) + "\n" + broken + "\n" + prose(80, 31)) == [name]
    assert names("Distributed under CC BY-NC 4.0") == ["CC-BY-NC-4.0"]
    body = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    assert names(prose(50, 32) + " " + body + " " + prose(50, 33), {"MIT body": body}) == ["MIT body"]
    words = [f"w{i}" for i in range(20)]
    for left in range(17):  # any four words may be missing
        assert names(prose(60, 34) + " " + " ".join(words[:left] + words[left + 4 :]) + " " + prose(60, 35), {"t": " ".join(words)}) == ["t"]
    assert names(body, {"t": body}, 1.1) == [] and names(body, {}) == [] and names(body, {"t": ""}) == []


def test_a_substituted_word_never_makes_another_licence():
    for name, text in licenses.TEMPLATES:
        t = licenses.Template(name, text, licenses.MIN_COVERAGE)
        naming = {j for a, b in t.phrases for j in range(a, b)}
        for k in range(0, len(t.words), max(1, len(t.words) // 25)):
            changed = [*t.words[:k], "zzzz", *t.words[k + 1 :]]
            got = names(prose(30, 36) + " " + " ".join(changed) + " " + prose(30, 37))
            if k not in naming:
                assert got == [name], (name, t.words[k], got)
            else:
                assert set(got) <= {name}, (name, t.words[k], got)
    r = random.Random(4)
    for name, text in licenses.TEMPLATES:  # one word in ten, none of the naming ones
        t = licenses.Template(name, text, licenses.MIN_COVERAGE)
        naming = {j for a, b in t.phrases for j in range(a, b)}
        free = [j for j in range(len(t.words)) if j not in naming]
        gone = set(r.sample(free, len(t.words) // 10))
        assert names(" ".join("zz" if j in gone else w for j, w in enumerate(t.words))) == [name]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/x", "<title>T</title><a href='/y#z'>l</a><p>Hé &amp; ho<script>no</script>"), (2, None, None), (3, "", "")], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages)).collect()
    source = {r.record_id: r for r in warc.responses(pages).collect()}
    assert len(made) == 6 and all(r.refers_to in source and dict(r.headers)["WARC-Source-Payload-Digest"] == source[r.refers_to].payload_digest for r in made)
    assert {bytes(r.block).decode() for r in made if r.warc_type == "conversion"} == {"T\nl\nHé & ho", ""}
    members = warc.write_files(warc.responses(pages), f"file://{tmp_path}/w")
    back = {r.record_id: r for r in warc.read_members(members).collect()}
    assert {k: bytes(r.block) for k, r in back.items()} == {k: bytes(r.block) for k, r in source.items()}
    assert len(list(warc.from_bytes(b"".join(r.member for r in members.collect())))) == pages.count()


def test_warc_files_are_read_in_ranges(spark, tmp_path):
    r = random.Random(3)
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", None if i == 5 else "<p>" + "".join(r.choice("abc<> \n") for _ in range(r.randrange(4000)))) for i in range(60)] + [(None, None, "x"), (7, "", "twice")], "page_id long, url string, html string")
    made = warc.responses(pages).unionByName(warc.derivatives(warc.responses(pages)))
    want = {(x.record_id, x.warc_type): (bytes(x.block), x.refers_to, dict(x.headers)) for x in made.collect()}
    written = warc.write_warc(made.repartition(3), f"file://{tmp_path}/out").collect()
    assert sum(x.n_records for x in written) == made.count() and len(written) == 3
    for size in (1000, 5000, 1 << 20):
        back = warc.read_files(spark, f"file://{tmp_path}/out/*.warc.gz", size).collect()
        assert len(back) == made.count() and {(x.record_id, x.warc_type): (bytes(x.block), x.refers_to, dict(x.headers)) for x in back} == want
    plain = b"".join(warc.to_bytes(x.asDict()) for x in made.collect())
    (tmp_path / "plain.warc").write_bytes(plain)
    (tmp_path / "cut.warc").write_bytes(plain[:-6])
    (tmp_path / "headless.warc").write_bytes(plain[:-40])
    (tmp_path / "empty.warc").write_bytes(b"")
    assert len(warc.read_files(spark, f"file://{tmp_path}/plain.warc", 1000).collect()) == made.count()
    for name in ("cut", "headless"):
        assert sum("WARC-Truncated" in dict(x.headers) for x in warc.read_files(spark, f"file://{tmp_path}/{name}.warc").collect()) == 1
    assert warc.read_files(spark, f"file://{tmp_path}/empty.warc").count() == 0
    assert len(list(warc.from_bytes(gzip.compress(plain)))) == made.count() and warc.derivatives(made.limit(0)).count() == 0


def test_warc_payloads_are_decoded_and_headers_kept():
    def source(payload, *lines):
        block = b"HTTP/1.1 200 OK\r\n" + b"".join(x.encode() + b"\r\n" for x in lines) + b"\r\n" + payload
        return {"record_id": "<urn:x>", "target_uri": "http://a/", "warc_date": None, "content_type": "application/http", "headers": [("WARC-IP-Address", "1.2.3.4")], "block": block, "block_digest": "sha1:B", "payload_digest": None}

    body = "<title>É</title><p>Grüße"
    zipped = gzip.compress(body.encode())
    chunked = b"5\r\n" + zipped[:5] + b"\r\n" + f"{len(zipped) - 5:x};x=y\r\n".encode() + zipped[5:] + b"\r\n0\r\n\r\n"
    for payload, lines in (
        (body.encode(), ["Content-Type: text/html"]), (body.encode("latin-1"), ["Content-Type: text/html; charset=ISO-8859-1"]), (body.encode("utf-16"), ["content-type: text/html"]),
        (chunked, ["Content-Type: text/html", "Content-Encoding: gzip", "Transfer-Encoding: chunked"]), (b"<meta charset=cp1252>" + body.encode("cp1252"), ["Content-Type: text/html"]), (body.encode(), ["Content-Type: text/html; charset=nonesuch"]),
    ):
        meta, text = warc.derive(source(payload, *lines))
        assert text["block"].decode() == "É\nGrüße" and json.loads(meta["block"])["title"] == "É"
        for x in (meta, text):
            kept = dict(x["headers"])
            assert x["refers_to"] == "<urn:x>" and kept["WARC-Source-WARC-IP-Address"] == "1.2.3.4" and kept["WARC-Source-Block-Digest"] == "sha1:B" and kept["WARC-Source-Payload-Digest"] == warc.sha1(payload)
            assert any(k.lower() == "http-content-type" for k in kept)
    assert [x["warc_type"] for x in warc.derive(source(b"\x89PNG", "Content-Type: image/png"))] == ["metadata"]


def brute_quality(texts):
    """Ids of the texts that the rules keep, EM in plain loops over documents."""
    from math import exp, log

    found = {i: quality_rules.stats(t) for i, t in texts.items()}
    cast = {i: quality_rules.votes(s) for i, s in found.items() if len((texts[i] or "").split()) >= 50 and 100 * s.n_repeat_words <= 50 * s.n_words}
    rules, k = range(len(quality_rules.RULES)), quality_rules.PRIOR_VOTES
    rate = {True: [1 - quality_rules.PRIOR_GOOD for _ in rules], False: [quality_rules.PRIOR_BAD for _ in rules]}
    share, post = quality_rules.PRIOR_SHARE, {}
    for _ in range(200):
        for i, v in cast.items():
            odds = log(share / (1 - share))
            for r in rules:
                g, b = rate[True][r], rate[False][r]
                odds += log(g / b) if v[r] < 0 else log((1 - g) / (1 - b)) if v[r] > 0 else 0
            post[i] = 1 / (1 + exp(-max(-60, min(60, odds))))
        share = (sum(post.values()) + k * quality_rules.PRIOR_SHARE) / (len(post) + k)
        for good, prior in ((True, 1 - quality_rules.PRIOR_GOOD), (False, quality_rules.PRIOR_BAD)):
            w = {i: p if good else 1 - p for i, p in post.items()}
            rate[good] = [(sum(w[i] for i, v in cast.items() if v[r] < 0) + k * prior) / (sum(w[i] for i, v in cast.items() if v[r]) + k) for r in rules]
    return {i for i, p in post.items() if p >= 0.5}


def brute_simhash(texts):
    prints = {}
    for i, t in texts.items():
        w = (t or "").translate(str.maketrans(simhash.AZ, simhash.AZ.lower())).encode().split()
        hs = [xxhash.xxh64_intdigest(x, 42) for x in ([a + b" " + b for a, b in zip(w, w[1:])] or w[:1])]
        prints[i] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))
    group = {i: i for i in prints}
    for _ in prints:
        for i, a in prints.items():
            for j, b in prints.items():
                if (a ^ b).bit_count() <= 6:
                    group[i] = group[j] = min(group[i], group[j])
    return {i for i, g in group.items() if g == i}


def brute_cut(texts):
    """Texts without the words of 50-word runs that an earlier text has."""
    seen, out = set(), {}
    for i in sorted(texts):
        words = texts[i].split()
        low = [x.lower() for x in words]
        runs = [tuple(low[k : k + 50]) for k in range(len(low) - 49)]
        gone = {x for k, r in enumerate(runs) if r in seen for x in range(k, k + 50)}
        seen |= set(runs)
        if kept := [x for k, x in enumerate(words) if k not in gone]:
            out[i] = " ".join(kept)
    return out


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline
    from corpusmill.llm.common import materialize

    shared, item = prose(64, 3000), prose(30, 3001)
    texts = {i: prose(120 + i % 50, 3100 + i) for i in range(40)}
    texts |= {40: texts[3], 41: texts[3].upper(), 42: texts[5] + " tail", 43: prose(30, 3200), 44: None, 45: "", 46: "same words again " * 40}
    texts |= {47 + k: " ".join(w + "###" for w in prose(90, 3300 + k).split()) for k in range(12)}
    texts |= {60 + k: " ".join([prose(70 + k, 3400 + k), shared, prose(60, 3500 + k)]) for k in range(5)}
    texts |= {70 + k: " ".join([prose(60, 3600 + k), item, prose(60, 3700 + k)]) for k in range(3)} | {80: shared + " " + prose(40, 3800)}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [item, "", None, prose(25, 3900)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    df, now, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), texts, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = materialize(stage(spark, df, str(tmp_path)), "test-stage")
        got = {r.doc_id: r for r in df.collect()}
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(got) == df.count()
        if name == "quality_rules":
            now = {i: texts[i] for i in brute_quality(texts)}
        elif name == "near_duplicates":
            now = {i: now[i] for i in brute_simhash(now)}
        elif name == "substring_dedup":
            now = brute_cut(now)
        else:
            keys = sorted(now)
            now = {i: now[i] for i in set(keys) - {keys[d] for d, _ in brute_contaminated([now[i] for i in keys], items)}}
        assert {i: r.text.split() for i, r in got.items()} == {i: t.split() for i, t in now.items()}, name
        assert all(r.lang == "en" and r.source == f"s{i % 3}" and r.n_chars == len(r.text) for i, r in got.items())
        counts.append(len(got))
    assert len(texts) > counts[0] > counts[1] >= counts[2] > counts[3] > 40
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in out) == sorted((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for i, r in got.items() for ids in [[*t.encode(r.text, add_special_tokens=False).ids, 1]])
    assert len({r.sequence_id for r in out}) <= best_fit(sorted((r.length for r in out), reverse=True))


def test_pipeline_of_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, corpusmill_gone long, seed long"
    bench = spark.createDataFrame([(None, ITEM), (1, None)], "item_id long, text string")
    odd = [(None, prose(80, 1)), (None, prose(80, 2)), (1, prose(80, 3)), (1, prose(80, 3)), (1, prose(90, 4)), (2, None), (3, ""), (4, prose(30000, 5)), (5, prose(60, 6) + " " + ITEM)]
    for k, rows in enumerate(([], odd)):
        d = f"{tmp_path}/{k}"
        spark.createDataFrame([(i, t, None, None, None, 7, 7, 7) for i, t in rows], schema).write.parquet(f"{d}/documents.parquet")
        bench.limit(0 if k == 0 else 2).write.parquet(f"{d}/benchmark.parquet")
        df = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, d)
            assert df.columns == [c.split()[0] for c in schema.split(", ")]
            df = corpus_pipeline.materialize(df, "odd")
        got = [r.doc_id for r in df.collect()]
        assert got == [] if k == 0 else sorted(got, key=str) == [1, 1, 4, None, None] or sorted(got, key=str) == [1, 1, 1, 4, None, None]
        assert corpus_pipeline.run(spark, d).count() >= len(got)
        for f in (quality_rules.score_quality, simhash.near_duplicates, substring.repeated_passages, tokencount.token_counts, licenses.license_scan):
            n = f(spark.read.parquet(f"{d}/documents.parquet")).count()
            assert n == len(rows) or f in (substring.repeated_passages, licenses.license_scan)
        labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
        for f in (classifier.quality_scores, toxicity.toxicity_scores):
            assert f(spark.read.parquet(f"{d}/documents.parquet"), labels).count() == len(rows)


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules"
    out = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in out.collect()}
    assert 0 < len(ids) < docs.count()


@pytest.mark.parametrize("zones", [9, 11])
def test_simhash_links_equal_all_pairs_for_any_zones(spark, zones):
    r = random.Random(zones)
    prints = {r.getrandbits(64) for _ in range(40)}
    for p in sorted(prints):
        for _ in range(3):
            prints.add(p ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 8))))
    want = {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for a in prints for b in prints if 0 < (a ^ b).bit_count() <= 6}
    got = simhash.linked_classes(spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long"), zones).collect()
    assert len(got) == len(want) and {(x.a, x.b) for x in got} == want


def test_simhash_zones_follow_the_number_of_classes():
    assert simhash.zones_for(1000) == 9 < simhash.zones_for(10**7) < simhash.zones_for(10**9)
    work = [simhash.comb(z, 6) * n * (simhash.CELL_COST + n * simhash.SAME_COUNT ** (32 * (z - 6) / z)) for n in (2**k for k in range(14, 34)) for z in [simhash.zones_for(n)]]
    assert all(b < 3 * a for a, b in zip(work, work[1:]))


def link_plans(monkeypatch):
    """The plans of the links of fingerprints, as they are about to be written."""
    plans, write = [], simhash.materialize

    def recorded(df, name):
        if name == "simhash-links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(simhash, "materialize", recorded)
    return plans


def test_pipeline_never_broadcasts_the_cells(spark, docs, monkeypatch):
    import corpus_pipeline

    plans = link_plans(monkeypatch)
    dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_op9_never_broadcasts_the_cells(spark, monkeypatch):
    from corpusmill.llm import queries

    plans = link_plans(monkeypatch)
    queries.QUERIES["op9_simhash"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_op9_broadcasts_no_table(spark, monkeypatch):
    from corpusmill.llm import components, queries

    plans = []

    def ran(df, name):
        df.collect()
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return df

    def recorded(module):
        write = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name: write(ran(df, name), name))

    recorded(simhash)
    recorded(components)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    ran(queries.QUERIES["op9_simhash"](spark, "/root/testdata/sf0.001"), "result")
    assert {"simhash-links", "cc", "result"} <= {n for n, p in plans if "SortMergeJoin" in p}
    assert [n for n, p in plans if "Broadcast" in p] == []


def test_intermediate_tables_are_shared_and_released(spark):
    from corpusmill.llm import common

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    df = common.materialize(spark.range(10).repartition(3).groupBy((F.col("id") % 3).alias("k")).count(), "x")
    assert df.count() == 3 and spark.conf.get(key) == before

    def session(master, root=None):
        conf = type("conf", (), {"get": staticmethod(lambda k, d=None: root)})
        return type("session", (), {"conf": conf, "sparkContext": type("sc", (), {"master": master, "applicationId": "app-1"}), "_jvm": spark._jvm, "_jsc": spark._jsc})

    with pytest.raises(RuntimeError):
        common.shared_root(session("spark://host:7077"))
    assert common.shared_root(session("spark://host:7077", "s3a://b/x/")) == "s3a://b/x" and common.shared_root(session("local[2]", "/tmp/given")) == "/tmp/given"
    alone = session("local[2]")
    folder = Path(common.shared_root(alone).removeprefix("file://"))
    assert folder.exists() and common.shared_root(alone) == f"file://{folder}"
    (folder / "corpusmill-app-1" / "t").mkdir(parents=True)
    common.release(alone)
    assert folder.exists() and not (folder / "corpusmill-app-1").exists() and df.count() == 3


def test_slices_bound_rows_and_bytes():
    from corpusmill.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 1000 + ["b" * common.SLICE_BYTES * 2] + ["c" * 1000] * 3000)], names=["t"])
    made = list(common.slices(iter([batch, batch.slice(0, 0)])))
    assert sum(b.num_rows for b in made) == batch.num_rows and all(b.num_rows <= common.SLICE_ROWS and (b.num_rows == 1 or b.nbytes <= 2 * common.SLICE_BYTES) for b in made)
    assert [x for b in made for x in b.column(0).to_pylist()] == batch.column(0).to_pylist()
