"""The corpus operators against brute force, round trips and held-out labels, on small fixtures and the smallest tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import ann, bpe, licenses, lm_scoring, near_dedup, packing, quality, substring_dedup, topk, toxicity
from kgspark.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = bpe.default_path()


def words(text):
    return (text or "").encode("utf-8", "replace").split()


@pytest.fixture(scope="module")
def texts():
    """Null, empty, blank, short, repeated, very long, near copies, odd characters; ids repeat and are null."""
    dice = random.Random(1)
    say = lambda n: " ".join(dice.choice("alpha beta gamma delta rho sigma tau phi one two three four five six".split()) + str(dice.randrange(40)) for _ in range(n))
    base, passage, long = say(120), say(60), say(30_000)
    near = base.split()
    near[60] = "other"
    rows = [None, "", " \n\t", "one", "a b c", "a b c", base, base, " ".join(near), say(40) + " " + passage + " " + say(40), say(50) + "\n" + passage, long, "naïve Ünïcode 漢字   x y <|endoftext|> " + "a" * 700, "  spaces   and\ttabs\n\n"]
    return [(None if k == 3 else k, t) for k, t in enumerate(rows)] + [(6, base), (6, say(5))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def count(df):
    return Counter(tuple(r) for r in df.collect())


# 1


def kept(rows, n=35):
    every = Counter(tuple(w[i : i + n]) for w in map(words, (t for _, t in rows)) for i in range(len(w) - n + 1))
    out = Counter()
    for doc_id, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if every[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out[doc_id, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def test_substrings(docs, texts, real, empty, spark):
    assert count(substring_dedup.digests(docs)) == kept(texts)
    assert count(substring_dedup.digests(real)) == kept([(r.doc_id, r.text) for r in real.collect()])
    assert substring_dedup.digests(empty).count() == 0
    clash = docs.withColumns({"id": F.lit(1), "size": F.lit("x"), "stretches": F.lit(None).cast("string")})
    assert substring_dedup.removed(clash).columns == clash.columns and substring_dedup.removed(clash).count() == len(texts)


def test_index_of_batches_with_compaction(spark, real):
    """After each batch all documents so far, old ones too, are judged as by brute force; compaction changes nothing; history is not shuffled."""
    index = substring_dedup.FingerprintIndex(spark)
    rows = sorted((r.doc_id, r.text) for r in real.select("doc_id", "text").collect())
    judged = {}
    for part in np.array_split(np.arange(len(rows)), 6):
        so_far = rows[: part[-1] + 1]
        known = substring_dedup.keyed(spark.createDataFrame(so_far, "doc_id long, text string"))
        met = index.met(index.add(known.filter(f"doc_id >= {so_far[part[0]][0]}")))
        for r in index.stretches(met, known).collect():
            judged.setdefault((r.text_hash, r.size), set()).update((s.start, s.n) for s in r.stretches)
        index.compact()
        every = Counter(tuple(w[i : i + 35]) for w in (words(t) for _, t in so_far) for i in range(len(w) - 34))
        for r in known.collect():
            w, gone = substring_dedup.kept_words(r.text, [{"start": s, "n": n} for s, n in judged.get((r.text_hash, r.size), ())], 35)
            starts = [i for i in range(len(w) - 34) if every[tuple(w[i : i + 35])] > 1]
            assert set(np.flatnonzero(gone)) == {i + j for i in starts for j in range(35)}, r.doc_id
    assert sorted(level for level, _ in index.runs) == [0, 0, 1]
    own, other = (run.select("anchor") for _, run in index.runs[:2])
    plan = own.join(other.hint("merge"), "anchor", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


# 2


def test_language_model(docs, texts, real, empty):
    for df in (docs, real):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        part = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
        tokens = lambda t: [*words((t or "").translate({c: c + 32 for c in range(65, 91)})), None]
        c = Counter(x for i, t in rows if part(i) != 2 for x in tokens(t))
        n, v = sum(c.values()), len(c)
        base = {(i, part(i) == 2, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in rows}
        found = lm_scoring.score(df).collect()
        assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found} == base and len(found) == len(rows)
        assert all(math.isfinite(r.score) and r.score <= 0 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scoring.score(empty).count() == 0


def test_end_token_is_no_word(spark):
    """A word that looks like an end does not count as one."""
    found = lm_scoring.score(spark.createDataFrame([(0, "a \x00end b")], "doc_id long, text string")).first()
    assert zlib.crc32(b"0") % 7 != 2 and (found.n_tokens, found.train_tokens) == (4, 4)
    assert found.base_score == pytest.approx(4 * math.log10(2 / (4 + 4 + 1)))


def interpolated(rows):
    """Scores by deleted interpolation, straight from the definition: no hashes, no bins."""
    part = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % lm_scoring.PARTS
    tokens = lambda t: [*words((t or "").translate({c: c + 32 for c in range(65, 91)})), None]
    every = [(part(i), tokens(t)) for i, t in rows]
    pairs_of = lambda w: list(zip([None, *w[:-1]], w, strict=True))
    bucket = lambda c: min(int(math.log2(c)) + 1, lm_scoring.CONTEXTS - 1) if c else 0

    def counts(keep):
        lists = [w for p, w in every if keep(p)]
        return Counter(x for w in lists for x in w), Counter(x for w in lists for x in pairs_of(w))

    one, two = counts(lambda p: p not in (lm_scoring.TEST_PART, lm_scoring.DELETED_PART))
    n, v = sum(one.values()), len(one)
    held = {}
    for p, w in every:
        if p == lm_scoring.DELETED_PART:
            for a, b in pairs_of(w):
                held.setdefault(bucket(one[a]), []).append((two[a, b] / max(one[a], 1), one[b] / max(n, 1), 1 / (v + 1)))
    weights, known = {}, np.array([0.0, 0.5, 0.5])
    for k in range(lm_scoring.CONTEXTS):
        if k in held:
            x, w = np.array(held[k]), np.full(3, 1 / 3)
            for _ in range(lm_scoring.ROUNDS):
                share = x * w
                w = (share / share.sum(1, keepdims=True)).mean(0)
            known = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
        weights[k] = known
    one, two = counts(lambda p: p != lm_scoring.TEST_PART)
    n, v = sum(one.values()), len(one)
    found = []
    for w in (w for _, w in every):
        total = 0.0
        for a, b in pairs_of(w):
            x = weights[bucket(one[a])]
            p = x[0] * two[a, b] / max(one[a], 1) + x[1] * one[b] / n + x[2] / (v + 1)
            total += math.log10(p if one[a] else p / (1 - x[0]))
        found.append(total)
    return found


def test_scores_against_the_definition(spark, real):
    """The bins of the estimation step shift a score by a hundredth at most."""
    rows = [(r.doc_id, r.text) for r in real.collect()]
    rows += [(1000 + k, t) for k, (_, t) in enumerate(rows[:40])] + [(None, "nothing new"), (5000, None), (5001, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("chunk", "part", "words", "bucket", "score")})
    mine = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in lm_scoring.score(df).collect())
    expected = sorted((i is None, i or 0, s) for (i, _), s in zip(rows, interpolated(rows), strict=True))
    assert [x[:2] for x in mine] == [x[:2] for x in expected]
    assert all(a[2] == pytest.approx(b[2], rel=0.01, abs=0.01) for a, b in zip(mine, expected, strict=True))


# 3 and 6


@pytest.fixture(scope="module")
def vectors(spark):
    dice = np.random.default_rng(5)
    rows = [(i, (dice.standard_normal(8) * 2).round(2).tolist()) for i in range(600)] + [(100, [9.0] * 8), (1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [1.0, None] * 4), (None, [1.0] * 8), (1400, [float("inf")] + [0.0] * 7)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)]  # ties with a query
    return rows + [(3000 + 50 * i, (dice.standard_normal(5) * 2).round(2).tolist()) for i in range(8)] + [rows[7], rows[50], rows[50]]  # another length, repeated rows


def usable(rows, nonzero):
    return [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (any(v) or not nonzero)]


def with_clashes(spark, rows):
    """The vectors, with columns named like those that the search uses."""
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("row", "dim", "part", "kind", "bound", "query_id", "rank", "score", "flat")}).repartition(4)


def by_query(rows):
    """The results of each query row, as sorted lists in rank order."""
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank, r.score, r.vec_id)):
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return found


@pytest.mark.parametrize("least", [2048, 64])
def test_neighbours(spark, vectors, monkeypatch, least):
    """Against brute force, in one shard and in many: nulls, ties, repeated ids and rows, two lengths, clashing columns."""
    monkeypatch.setattr("kgspark.llm.vectors.SHARD_LEAST", least)
    rows = ann.nearest(with_clashes(spark, vectors)).collect()
    v = usable(vectors, True)
    expected = {}
    for k, (q, x) in enumerate(v):
        if q % 100 == 0:
            expected.setdefault(q, []).append(sorted((math.dist(x, y), i) for j, (i, y) in enumerate(v) if j != k and len(y) == len(x))[:10])
    found = by_query(rows)
    assert found.keys() == {q for q, lists in expected.items() if any(lists)}
    hits = total = 0
    for q, lists in expected.items():
        assert sorted(x[0] for x in found[q]) == sorted(k for one in lists for k in range(1, len(one) + 1))
        total += sum(map(len, lists))
        hits += sum((Counter((i, round(d, 9)) for one in lists for d, i in one) & Counter((i, round(d, 9)) for _, i, d in found[q])).values())
    assert hits / total >= 0.9
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_tree_leaves_most_unread():
    """On vectors with few degrees of freedom the descent reads and verifies a small part, and still finds the neighbours."""
    dice = np.random.default_rng(8)
    x = dice.standard_normal((20_000, 4)) @ dice.standard_normal((4, 64)) + 0.01 * dice.standard_normal((20_000, 64))
    order, made = ann._index(None)(x)
    shard = ann.Shard({"vector": x[order], "vec_id": order, "row": order} | {c: y.tobytes() for c, y in made.items()})
    hits = 0
    for q in range(0, 20_000, 200):
        places, _ = ann.neighbours(shard, x[q], q, math.nan, 10)
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hits += len(set(shard.ids[places]) & set(np.argsort(d)[:10]))
    leaves = int((made["child"] == 0).sum())
    assert hits >= 900 and shard.leaves / (100 * leaves) < 0.2 and shard.verified / (100 * len(x)) < 0.05


def test_search_takes_few_steps(monkeypatch):
    """Where most leaves must be read, a query verifies them in a few steps on arrays, not leaf by leaf."""
    x = np.random.default_rng(9).standard_normal((2_048, 64))
    order, made = ann._index(None)(x)
    shard = ann.Shard({"vector": x[order], "vec_id": order, "row": order} | {c: y.tobytes() for c, y in made.items()})
    steps, lengths = [], ann._lengths
    monkeypatch.setattr(ann, "_lengths", lambda d: steps.append(len(d)) or lengths(d))
    hits = 0
    for q in range(0, 2_048, 64):
        places, _ = ann.neighbours(shard, x[q], q, math.nan, 10)
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hits += len(set(shard.ids[places]) & set(np.argsort(d)[:10]))
    assert hits >= 0.9 * 320 and len(steps) <= 10 * 32


@pytest.mark.parametrize("least", [2048, 64])
def test_products(spark, vectors, monkeypatch, least):
    monkeypatch.setattr("kgspark.llm.vectors.SHARD_LEAST", least)
    found = topk.best_products(with_clashes(spark, vectors))
    v = [(i, [math.floor(256 * x) for x in y]) for i, y in usable(vectors, False)]
    expected = Counter()
    for k, (q, x) in enumerate(v):
        if q % 50 == 0:
            every = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for j, (i, y) in enumerate(v) if j != k and len(y) == len(x))[:5]
            expected.update((q, n, i, -s) for n, (s, i) in enumerate(every, 1))
    assert count(found) == expected
    assert "op6_topk_inner_products" in oracle_sql()
    assert topk.best_products(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_products_of_huge_components(spark):
    """Squares beyond the range of doubles prune nothing."""
    rows = [(0, [1e200, 0.0, 0.0])] + [(i, [0.0, 1.0, float(i % 7)]) for i in range(1, 2001)]
    found = topk.best_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100_000)
    assert [r.vec_id for r in sorted(found.collect(), key=lambda r: r.rank)] == [1, 2, 3, 4, 5]


def test_partial_sums_prune():
    """Most products are left off before the end where the axes differ in size."""
    dice = np.random.default_rng(9)
    x = dice.standard_normal((8_000, 64)) * np.linspace(2, 0.1, 64)
    axes = np.linalg.eigh(topk.whole(x).T @ topk.whole(x))[1][:, ::-1]
    order, made = topk._index({64: axes})(x)
    shard = topk.Shard({"vector": x[order], "vec_id": order, "row": order} | {c: np.ascontiguousarray(y).tobytes() for c, y in made.items()})
    for q in range(0, 8_000, 200):
        places, scores = topk.best_in(shard, axes, topk.whole(x[q]), q, math.nan, 5)
        every = (topk.whole(x) @ topk.whole(x[q])).astype(np.int64)
        every[q] = -(2**62)
        assert sorted(scores.tolist()) == sorted(np.sort(every)[-5:].tolist())
    assert shard.multiplied < 0.2 * 40 * len(x)


# 4 and 9


@pytest.mark.parametrize(("name", "label", "module"), [("op4_quality_bradley_terry", "quality", quality), ("op9_toxicity_zstd", "toxic", toxicity)])
def test_classifiers(spark, docs, empty, name, label, module):
    sf = SF.replace("0.001", "0.01")
    found = {r.doc_id: r for r in queries()[name](spark, sf).collect()}
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(found[i].predicted, y) for i, y in known.items() if i in found and found[i].held_out and y is not None]
    assert sum(p == y for p, y in held) / len(held) >= 0.95 and all(0 <= r.score <= 1 for r in found.values())
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(14)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for df, marks in ((docs, labels), (docs, labels.limit(0)), (docs, labels.filter(f"{label} = 1")), (empty, labels)):
        rows = module.with_score(df, module.fit(df, marks), df.columns, "__score")
        assert rows.count() == df.count() and all(0 <= r["__score"] <= 1 for r in rows.collect())


def test_toxic_word_after_a_fixed_word(spark):
    """A toxic word that always follows the same word is learnt."""
    dice = random.Random(4)
    prose = lambda: " ".join(f"{dice.choice('river stone bread house light')}{dice.randrange(60)}" for _ in range(30))
    rows = [(i, prose() + (" you are welcome" if i % 6 else " you are vermin")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    bad, good = toxicity.scores(model, [prose() + " you are vermin", prose() + " you are welcome"], 2)
    assert bad >= toxicity.THRESHOLD > good


# 5


def test_licences(spark, empty):
    rows = [
        (0, None), (1, ""), (2, "nothing here\nLicensed under the Apache License, Version 2.0.\nmore"), (3, "This work is licensed under CC BY-SA 4.0."), (4, "He lost his driving licence."), (5, "x" * 100_000 + "\nSPDX-License-Identifier: MIT"),
        (6, "Released under the GNU General Public License, version 3."), (6, "Released under the GNU General Public License, version 3."), (7, "Apache helicopters flew over the valley."),
    ]
    found = licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, family int"))
    assert Counter((r.doc_id, r.paragraph, r.family) for r in found.collect()) == Counter({(2, 1, "Apache-2.0"): 1, (3, 0, "CC-BY-SA"): 1, (5, 1, "MIT"): 1, (6, 0, "GPL-3.0"): 2})
    assert licenses.scan(empty).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_proprietary_notices(spark):
    """The holder and the year are no part of what confirms a notice."""
    rows = [(1, "All rights reserved."), (2, "Copyright (c) 2021 Acme Ltd. All rights reserved."), (3, "some text\nCopyright 1987-2003 The Widget Makers of Leeds. All rights reserved.\nmore"), (4, "We reserve all rights in the matter to the court."), (5, "Copyright law protects authors.")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert count(found.select("doc_id", "paragraph", "family")) == Counter({(1, 0, "Proprietary"): 1, (2, 0, "Proprietary"): 1, (3, 1, "Proprietary"): 1})


def test_wrapped_and_several_notices(spark):
    """Notices over several lines, several families in a paragraph, and other characters between the words of a phrase."""
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights'
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"
    rows = [
        (1, "x\n\n" + mit), (2, bsd), (3, isc), (4, "Licensed under the MIT License or the Apache License, Version 2.0."), (5, "Creative-Commons  Attribution 4.0 International License"), (6, "all  rights\nreserved."),
        (7, "all rights\n\nreserved."), (8, "Released under the MIT license.\nReleased under the MIT license."), (9, "Distributed under the terms of the GNU Lesser General Public License, version 2.1."), (10, "License fees rose in May.\nTaxes redistribute income."), (11, "Mozilla Public License 2.0\nMozilla Public License 2.0"),
    ]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = [(1, 2, "MIT"), (2, 0, "BSD"), (3, 0, "ISC"), (4, 0, "MIT"), (4, 0, "Apache-2.0"), (5, 0, "CC-BY"), (6, 0, "Proprietary"), (8, 0, "MIT"), (8, 1, "MIT"), (9, 0, "LGPL"), (11, 0, "MPL-2.0"), (11, 1, "MPL-2.0")]
    assert count(found.select("doc_id", "paragraph", "family")) == Counter(expected)


# 7


def brute_classes(rows):
    sets = {}
    for t in {t for _, t in rows if words(t)}:
        w = words(t)
        sets[t] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)])
    parent = {t: t for t in sets}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    totals = {t: sum(c.values()) for t, c in sets.items()}
    for a, b in itertools.combinations(sorted(sets, key=totals.get), 2):
        if totals[a] < 0.8 * totals[b] or sets[a].keys().isdisjoint(sets[b]):
            continue
        both = sum(min(n, sets[b][g]) for g, n in sets[a].items())
        if both >= 0.8 * (totals[a] + totals[b] - both) - 1e-9:
            parent[root(a)] = root(b)
    out = {}
    for k, (_, t) in enumerate(rows):
        out.setdefault(root(t) if t in sets else ("blank", k), []).append(k)
    return sorted(out.values())


def numbered(df):
    rows = [(k, r.text) for k, r in enumerate(sorted(df.collect(), key=repr))]
    return rows, df.sparkSession.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicates(docs, real, empty, spark):
    dice = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    variants = []
    for _ in range(90):  # many variants of one text, some near-duplicates of it or of each other, most not
        w = base.copy()
        for k in dice.sample(range(150), dice.randrange(12)):
            w[k] = f"v{dice.randrange(30)}"
        variants.append((None, " ".join(w)))
    larger = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    for df in (docs, real, larger, spark.createDataFrame(variants, "doc_id long, text string")):
        rows, named = numbered(df)
        found = {}
        for r in near_dedup.grouped(named).collect():
            found.setdefault(r.class_id, []).append(r.doc_id)
        assert sorted(sorted(x) for x in found.values()) == brute_classes(rows)
        assert near_dedup.representatives(named).count() == len(found)
    assert near_dedup.grouped(empty).count() == 0 and near_dedup.grouped(docs).count() == docs.count()
    clash = docs.withColumns({"node": F.lit("x"), "class_id": F.lit(1)})
    assert near_dedup.representatives(clash).columns == clash.columns
    weighted = spark.createDataFrame([(1, "a b c d e " * 10), (2, "a b c d e " * 3)], "doc_id long, text string")
    assert {r.class_id for r in near_dedup.grouped(weighted, weighted=False).collect()} == {1} and {r.class_id for r in near_dedup.grouped(weighted).collect()} == {1, 2}


def test_open_pairs_in_blocks(spark, monkeypatch):
    """Every pair of different classes that the bounds leave open, whatever the blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    dice = np.random.default_rng(2)
    rows = [(b, k, int(dice.integers(4)) if k > 12 else 99, 10, 10.5, [0] * near_dedup.PARITY_WORDS) for b in range(3) for k in range(30)]
    found = near_dedup.open_pairs(spark.createDataFrame(rows, "bucket long, node long, comp long, total long, reach double, parity array<long>"), 0.8)
    expected = {(x[1], y[1]) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and x[2] != y[2]}
    assert {tuple(r) for r in found.collect()} == expected


def test_signatures_agree_like_the_sets():
    dice = np.random.default_rng(1)
    a = dice.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], dice.integers(0, 2**63, 60).astype(np.uint64)])
    one, two = near_dedup.signatures([a, b], [np.ones(300)] * 2, 2000)
    assert abs((one == two).mean() - 240 / 360) < 0.05


# 8 and 10


def test_clashing_columns(spark, docs, texts):
    """Columns named like those that the operators make change nothing."""
    clash = docs.withColumns({c: F.lit("x") for c in ("ids", "n_tokens", "start", "length", "rank", "part", "family", "paragraph", "words", "lines", "score", "held_out", "label", "hash")})
    for run in (lambda df: bpe.digests(df, PATH), lambda df: packing.pack(df, PATH).drop("sequence_id", "offset"), licenses.scan, substring_dedup.digests):
        assert count(run(clash)) == count(run(docs))
    marks = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(14)], "doc_id long, quality int, toxic int, text string")
    for module in (quality, toxicity):
        scored = module.with_score(clash, module.fit(clash, marks), clash.columns, "__score")
        assert scored.columns == [*clash.columns, "__score"] and scored.count() == len(texts)


def test_licence_of_a_null_id(spark):
    found = licenses.scan(spark.createDataFrame([(None, "Licensed under the Apache License, Version 2.0.")] * 2, "doc_id long, text string"))
    assert [(r.doc_id, r.family) for r in found.collect()] == [(None, "Apache-2.0")] * 2


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoding(docs, texts, real, empty, library):
    def digest(i, t):
        ids = ids_of(library, t)
        return (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())

    assert count(bpe.digests(docs, PATH)) == Counter(digest(i, t) for i, t in texts)
    assert count(bpe.digests(real, PATH)) == Counter(digest(r.doc_id, r.text) for r in real.collect())
    assert bpe.digests(empty, PATH).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(real, PATH), PATH).collect()}
    assert back == {r.doc_id: r.text or "" for r in real.collect()}


def test_packing(docs, texts, real, empty, library):
    for df in (docs, real):
        rows = Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        pieces = packing.pack(df, PATH).collect()
        expected = Counter()
        for (i, t), n in rows.items():
            ids = np.array([*ids_of(library, t), 1], "<u4")
            for start in range(0, len(ids), 2048):
                expected[i, start, len(ids[start : start + 2048]), zlib.crc32(ids[start : start + 2048].tobytes()), len(ids)] += n
        assert Counter(tuple(r)[:5] for r in pieces) == expected
        sequences = {}
        for r in pieces:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in sequences.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(r.length for r in pieces)
        assert len(sequences) <= math.ceil(total / 2048) * 1.05 + 1
    assert packing.pack(empty, PATH).count() == 0


def test_best_fill():
    dice = random.Random(2)
    for _ in range(30):
        counts = {dice.randrange(1, 40): dice.randrange(1, 4) for _ in range(4)}
        room = dice.randrange(1, 90)
        found = packing.best_fill(counts, room)
        sums = {sum(k * n for k, n in zip(counts, ns, strict=True)) for ns in itertools.product(*(range(n + 1) for n in counts.values()))}
        assert sum(k * n for k, n in found.items()) == max(s for s in sums if s <= room) and all(n <= counts[k] for k, n in found.items())
