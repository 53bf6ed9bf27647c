"""Cells of top-k overlaps, trigger joins, edit paths in little memory and vector search, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import similarity as S
from pairloom.functions import text as T
from pairloom.operators import factors, fuzzy, generate, lexicon, linguistic, overlap, vectors


# -- top-k overlaps ----------------------------------------------------------


def test_best_overlaps_equal_a_full_count():
    rng = np.random.default_rng(1)
    for _ in range(300):
        words = int(rng.integers(1, 60))
        lists = [np.sort(rng.choice(words, int(rng.integers(0, words + 1)), replace=False)) for _ in range(int(rng.integers(0, 9)))]
        k = int(rng.integers(1, 12))
        counts = np.zeros(words, int)
        for p in lists:
            counts[p] += 1
        expected = sorted((-c, w) for w, c in enumerate(counts) if c)[:k]
        best, shared = overlap.best_overlaps(lists, words, k)
        assert [(-c, w) for c, w in zip(shared.tolist(), best.tolist())] == expected


def word_tables(seed=3, n=60, m=90):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice("abxkhéñ") for _ in range(rng.randrange(1, 9)))
    words = sorted({make() for _ in range(m)})
    tokens = sorted({rng.choice(words)[:-1] + rng.choice("abk") for _ in range(n)} | {"a", "zzz"})
    return tokens, words


def brute_candidates(tokens, words, grams, signature, pool, gap):
    out = {}
    for t in tokens:
        shared = sorted((-len(grams[t] & grams[w]), w) for w in words if grams[t] & grams[w])[: 2 * pool]
        rank = {w: r for r, (_, w) in enumerate(shared, 1) if abs(len(t) - len(w)) <= gap}
        rank.update({w: 0 for w in words if signature[w] == signature[t]})
        out[t] = [w for _, w in sorted((r, w) for w, r in rank.items())[:pool]]
    return {(t, w) for t, ws in out.items() for w in ws}


@pytest.mark.parametrize("blocks", [(50_000, 20_000, 500), (7, 5, 5)])
def test_signature_candidates_equal_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("WORD_BLOCK", "TOKEN_BLOCK", "TOKEN_TASK"), blocks):
        monkeypatch.setattr(overlap, name, value)
    tokens, words = word_tables()
    every = spark.createDataFrame([(w,) for w in {*tokens, *words}], "w string").withColumn("s", T.signature(F.col("w"), "NFKC"))
    info = every.select("w", "s", T.character_ngrams(F.col("s")).alias("g")).collect()
    grams, signature = {r.w: set(r.g) for r in info}, {r.w: r.s for r in info}
    frame = lambda xs, name: spark.createDataFrame([(x,) for x in [*xs, xs[0], None]], f"{name} string").repartition(3)
    for pool in (3, 10):
        got = fuzzy.signature_candidates(frame(tokens, "token"), frame(words, "word"), pool, 2)
        assert {tuple(r) for r in got.collect()} == brute_candidates(tokens, words, grams, signature, pool, 2)
    assert fuzzy.signature_candidates(frame(tokens, "token").limit(0), frame(words, "word")).count() == 0


@pytest.mark.parametrize("block", [50_000, 4])
def test_mined_scores_equal_pairwise_scores(spark, monkeypatch, block):
    """The ranking of ``mine_variants`` against its parts put together pair by pair."""
    monkeypatch.setattr(overlap, "WORD_BLOCK", block)
    rng = random.Random(7)
    formal = ["xamal", "naala", "dafay", "mangi", "waaye", "ñaata"]
    noisy = [w.replace("x", "kh").replace("ñ", "gn") + s for w in formal for s in ("", "a", "h")]
    line = lambda vocabulary: " ".join(rng.choice(vocabulary) for _ in range(6))
    comments = spark.createDataFrame([(line(noisy),) for _ in range(60)], "text string")
    sentences = spark.createDataFrame([(line(formal),) for _ in range(60)], "text string")
    words = spark.createDataFrame([(w,) for w in formal], "word string")
    french = spark.createDataFrame([("bonjour",)], "word string")
    got = {r["token"]: r for r in fuzzy.mine_variants(comments, sentences, words, french, min_frequency=2, pool=5).collect()}
    tokens = spark.createDataFrame([(t,) for t in got], "token string").filter(F.length("token") > 2)
    alpha = lambda df: T.tokens(T.unicode_form(df["text"], "NFKC"), "alpha")
    pairs = fuzzy.signature_candidates(tokens, words, 5)
    near = lexicon.weighted_jaccard(lexicon.contexts(comments, alpha(comments), tokens), lexicon.contexts(sentences, alpha(sentences), words.select(F.col("word").alias("token"))), "token", "word")
    full = pairs.join(near.withColumnRenamed("similarity", "context_similarity"), ["token", "word"], "left").fillna(0.0)
    full = full.join(spark.createDataFrame([(t, r["frequency_score"]) for t, r in got.items()], "token string, frequency_score double"), "token")
    plain = fuzzy.rank_candidates(fuzzy.score_candidates(full)).collect()
    assert plain
    for r in plain:
        g = got[r["token"]]
        assert (g["word"], g["reason"]) == (r["word"], r["reason"]) or g["reason"] not in ("accepted", r["reason"])
        assert all(g[c] == pytest.approx(r[c]) for c in ("score", "second_score", "margin", "context_similarity", "char_similarity", "rule_similarity"))


# -- templates ---------------------------------------------------------------


def brute_template(token, t):
    framed = f"^{token}$"
    for at in range(1, len(framed) - len(t["old"])):
        end = at + len(t["old"])
        place = "prefix" if at == 1 else "suffix" if end == len(framed) - 1 else "internal"
        if framed[at:end] == t["old"] and framed[at - 1] == t["left"] and framed[end] == t["right"] and place == t["place"]:
            return (framed[:at] + t["new"] + framed[end:])[1:-1]
    return None


def test_templates_meet_words_on_their_triggers(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abé") for _ in range(rng.randrange(n)))
    words = sorted({(text(7), rng.choice("NV")) for _ in range(150)})
    templates = {(rng.choice("NV"), rng.choice("^abé"), text(3), rng.choice("abé$"), rng.choice(["prefix", "suffix", "internal"]), text(3)) for _ in range(120)}
    names = ["pos", "left", "old", "right", "place", "new"]
    expected = set()
    for w, pos in words:
        for t in templates:
            t = dict(zip(names, t))
            new = brute_template(w, t) if t["pos"] == pos else None
            if new is not None and new != w:
                expected.add((w, pos, new))
    frame = spark.createDataFrame(words + [(None, "N")], "token string, pos string")
    rules = spark.createDataFrame([(*t, 0.5, 3) for t in sorted(templates)], "pos string, left string, old string, right string, place string, new string, confidence double, count long")
    got = linguistic.changed_tokens(frame, rules)
    assert expected and {(r.token, r.pos, r.new) for r in got.collect()} == expected
    assert linguistic.changed_tokens(frame, rules.limit(0)).count() == 0
    tagged = frame.filter("token is not null").selectExpr("'s' AS source_id", "token", "pos", "cast(1 AS int) AS at")
    assert linguistic.template_candidates(tagged, rules).count() == got.count()


# -- edit paths --------------------------------------------------------------


def brute_path(a, b):
    table = [[i + j if not (i and j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j - 1] + (a[i - 1] != b[j - 1]), table[i - 1][j] + 1, table[i][j - 1] + 1)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            out.append(("keep" if a[i - 1] == b[j - 1] else "substitute", a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif i and table[i][j] == table[i - 1][j] + 1:
            out.append(("delete", a[i - 1], None))
            i -= 1
        else:
            out.append(("insert", None, b[j - 1]))
            j -= 1
    return out[::-1]


def test_edit_paths_equal_the_full_table():
    rng = random.Random(6)
    for _ in range(800):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(25))] for _ in range(2))
        assert S.backtrace(a, b) == brute_path(a, b)


def test_edit_paths_of_long_texts_take_little_memory():
    import tracemalloc

    rng = random.Random(6)
    a = [str(rng.randrange(500)) for _ in range(3_000)]
    b = [x for x in a if rng.random() > 0.05]
    tracemalloc.start()
    path = S.backtrace(a, b)
    assert tracemalloc.get_traced_memory()[1] < 40e6  # the full table takes 70 MB as packed numbers
    tracemalloc.stop()
    assert [s for o, s, _ in path if o != "insert"] == a and [t for o, _, t in path if o != "delete"] == b
    assert sum(o != "keep" for o, _, _ in path) == len(a) - len(b)


# -- vectors -----------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    x = centers[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, x[3].tolist()), (601, [0.0] * 16), (602, None), (603, [None] * 16)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def exact_neighbours(x, ids, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.vstack([unit, unit[3]])
    out = {}
    for q in ids:
        like = np.round(unit @ unit[q], 9)
        out[q] = [j for _, j in sorted((-s, j) for j, s in enumerate(like.tolist()) if j != q)[:k]]
    return out


@pytest.mark.parametrize("part", [20_000, 25])
def test_exact_neighbours_equal_brute_force(points, monkeypatch, part):
    x, frame = points
    monkeypatch.setattr(vectors, "PART", part)
    got = {}
    for r in vectors.neighbours(frame.filter("vec_id % 50 = 0"), frame, 7, cells=8, aim=None).collect():
        got.setdefault(r.query, []).append((r.rank, r.id))
    expected = exact_neighbours(x, range(0, 601, 50), 7)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == expected


def test_index_reaches_its_recall(points):
    x, frame = points
    queries = frame.filter("vec_id % 50 = 0")
    exact = vectors.neighbours(queries, frame, 10, cells=12, aim=None)
    assert vectors.recall(vectors.neighbours(queries, frame, 10, cells=12), exact) >= 0.9
    assert vectors.neighbours(queries, frame.limit(0), 10).count() == 0


# -- vectors by factorisation ------------------------------------------------


def brute_information(lists, window, least):
    from collections import Counter

    total = Counter(w for g in lists for w in g)
    n = Counter()
    for g in lists:
        for i, a in enumerate(g):
            for j in range(max(i - window, 0), min(i + window + 1, len(g))):
                if i != j and total[a] >= least and total[g[j]] >= least:
                    n[a, g[j]] += 1
    words = sorted({a for a, _ in n})
    m = np.zeros((len(words), len(words)))
    sums = Counter()
    for (a, _), c in n.items():
        sums[a] += c
    for (a, b), c in n.items():
        m[words.index(a), words.index(b)] = max(0.0, np.log(c * sum(sums.values()) / (sums[a] * sums[b])))
    return words, m


def test_vectors_span_the_information_matrix(spark):
    rng = random.Random(8)
    data = [(i, [rng.choice("abcdefg") + rng.choice("x ").strip() for _ in range(rng.randrange(1, 9))]) for i in range(80)] + [(99, [])]
    frame = spark.createDataFrame(data, "k long, s array<string>").repartition(3)
    words, m = brute_information([g for _, g in data], 2, 3)
    cells = factors.positive_information(factors.near_counts(frame, F.col("s"), 2, 3))
    got = np.zeros_like(m)
    for r in cells.collect():
        got[words.index(r.a), words.index(r.b)] = r.x
    assert np.allclose(got, m)
    # with as many directions as words the rows keep all their cosines
    full = {r.gram: np.array(r.vector) for r in factors.factor_vectors(cells, len(words) + 2, 2, 1).collect()}
    kept = [i for i, w in enumerate(words) if m[i].any()]
    v = np.array([full[words[i]] for i in kept])
    cos = lambda x: (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(cos(v), cos(m[kept]), atol=1e-6)
    # with fewer, nearly all that the directions of the largest eigenvalues hold
    most = np.sqrt(np.sort(np.linalg.eigvalsh(m) ** 2)[::-1][:3].sum())
    part = [r.vector for r in factors.factor_vectors(cells, 3, 6, 1).collect()]
    assert 0.95 * most <= np.linalg.norm(part) <= most * (1 + 1e-9)


def test_trained_vectors_agree_on_reruns(spark):
    pairs = spark.createDataFrame([(i, ["man", "xam", "ñu"], ["moi", "savoir", "nous"][: 1 + i % 3]) for i in range(9)], "k long, s array<string>, t array<string>")
    one, two = ({r.gram: r.vector for r in generate.train_vectors(p, F.col("s"), F.col("t"), 2, size=4, epochs=2).collect()} for p in (pairs, pairs.repartition(4)))
    assert one.keys() == two.keys() and "man_xam" in one
    assert all(np.allclose(one[g], two[g], atol=1e-6) or np.allclose(np.abs(one[g]), np.abs(two[g]), atol=1e-6) for g in one)
    assert generate.train_vectors(pairs.limit(0), F.col("s"), F.col("t"), 2, size=4).count() == 0
