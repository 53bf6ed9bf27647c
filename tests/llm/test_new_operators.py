"""Collocations, personal data and conversation repair against brute force and fixed cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter
from functools import lru_cache

import pytest

pytest.importorskip("pairloom.llm")
from pairloom.llm import collocations, conversation_repair, private_data  # noqa: E402

CONV = "conv_id long, turn long, role string, text string"


# -- conversation repair -----------------------------------------------------


def brute_plan(rows):
    """Cheapest (cost, audit) over all edits, by memoised search; ``rows`` are (role, text)."""
    seen, faults = set(), []
    for role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(maxsize=None)
    def rest(i, state, inserted):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            found.append((4 + rest(i + 1, state, 0)[0], "D" + rest(i + 1, state, 0)[1]))
            if faults[i] in ("", "truncated"):
                for cost, edit, initial in [(0, "K", rows[i][0][:1]), (3, "R", "u"), (3, "R", "a")]:
                    after = step.get((state, initial))
                    if after:
                        c, a = rest(i + 1, after, 0)
                        found.append((cost + c + 3 * (faults[i] == "truncated"), edit + a))
        if inserted < 2:
            for initial in "ua":
                after = step.get((state, initial))
                if after:
                    c, a = rest(i, after, inserted + 1)
                    found.append((3 + c, "I" + a))
        return min(found, default=(10**9, ""))

    return Counter(f for f in faults if f), *rest(0, "", 0)


def brute_repaired(rows, audit):
    out, at, state = [], 0, ""
    for e in audit:
        role, text = ("", "") if e == "I" else rows[at]
        at += e != "I"
        if e == "D":
            continue
        if e == "K":
            state = role[:1]
        else:
            role = "assistant" if state == "u" else "user"
            state = role[:1]
        out.append(f"{role}:{text}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], hashlib.md5((" " if r[3] is None else r[3]).encode()).digest()))


def random_conversations(seed, n=60):
    rng = random.Random(seed)
    out = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(["Good.", "No end", "", " \n", "What?", "Yes!", f"Text {turn}.", None])
            out.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), text))
    return out


def check_plans(spark, data):
    frame = spark.createDataFrame(data, CONV).repartition(3)
    rows = conversation_repair.as_rows(frame)
    plan = conversation_repair.plans(rows)
    got = {r.conv_id: r for r in conversation_repair._with_digests(rows, plan).collect()}
    texts = {}
    for r in conversation_repair.repaired(rows, plan).collect():
        texts.setdefault(r.conv_id, []).append((r.position, f"{r.role}:{r.text}"))
    assert set(got) == {r[0] for r in data}
    for conv, group in itertools.groupby(sorted(data, key=lambda r: (r[0] is None, r[0] or 0)), key=lambda r: r[0]):
        group = ordered(list(group))
        turns = [(" " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in group]
        faults, cost, audit = brute_plan(turns)
        r = got[conv]
        assert (r.cost, r.audit) == (cost, audit), (conv, turns)
        assert (r.blank, r.duplicate, r.truncated) == (faults["blank"], faults["duplicate"], faults["truncated"])
        numbers = [x[1] for x in group if x[1] is not None]
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        initials = [t[0][:1] for t in turns]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert r.repaired_sha256 == brute_repaired(turns, audit)
        whole = "\n".join(t for _, t in sorted(texts.get(conv, [])))
        assert hashlib.sha256(whole.encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for _, t in sorted(texts.get(conv, []))))


@pytest.mark.parametrize("seed", range(2))
def test_repair_equals_brute_force(spark, seed):
    check_plans(spark, random_conversations(seed))


def test_repair_of_a_conversation_over_many_partitions(spark, monkeypatch):
    rng = random.Random(5)
    data = [(1, t // 2, rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", f"No end {t}", "", f"Text {t}."])) for t in range(400)]
    data += [(2, 0, "user", "Hi."), (3, None, "user", "Hi."), (3, None, "user", "Hi.")]
    monkeypatch.setattr(conversation_repair, "FAN", 2)
    check_plans(spark, data)
    chunks = spark.createDataFrame(data, CONV).repartitionByRange(4, "conv_id", "turn")
    assert chunks.rdd.getNumPartitions() == 4


def test_products_are_associative():
    rng = random.Random(2)
    for _ in range(50):
        letters = "".join(rng.choice(conversation_repair.LETTERS) for _ in range(rng.randrange(2, 30)))
        cut = rng.randrange(1, len(letters))
        left = conversation_repair._turn(letters[0])
        for x in letters[1:]:
            left = conversation_repair.times(left, conversation_repair._turn(x))
        split = conversation_repair.times(conversation_repair.product(letters[:cut]), conversation_repair.product(letters[cut:]))
        assert left == split == conversation_repair.product(letters)


def test_damage_and_conversations_without_rows(spark):
    import zlib
    code = lambda c, t: zlib.crc32(f"{c}:{t}".encode()) % 20
    gone = next(c for c in range(1000) if code(c, 0) == 0)
    twice = next(c for c in range(1000) if code(c, 0) == 3)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.", 1), (twice, 0, "user", "Hi.", 1)], CONV + ", key int")
    got = {r.conv_id: r for r in conversation_repair.repair_rows(frame).collect()}
    assert (got[gone].cost, got[gone].audit, got[gone].gaps) == (0, "", 0)
    assert got[gone].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    # one of the two equal rows goes, an answer is added
    assert (got[twice].duplicate, got[twice].cost, got[twice].audit) == (1, 7, "KDI")
    assert conversation_repair.repair_rows(frame.limit(0)).count() == 0


# -- collocations ------------------------------------------------------------


def brute_collocations(docs, least, top):
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    key = (lang, tuple(words[i : i + n]))
                    counts[key] = counts.get(key, 0) + 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in found.items():
        inside = any(k[0] == lang and len(k[1]) > len(w) and 100 * b >= 80 * a and any(k[1][i : i + len(w)] == w for i in range(len(k[1]))) for k, b in found.items())
        if inside:
            continue
        score, k, l, r = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    result = set()
    for lang, group in itertools.groupby(sorted(out), key=lambda x: x[0]):
        for rank, (_, s, a, phrase, l, r) in enumerate(itertools.islice(group, top), 1):
            result.add((lang, rank, phrase.decode(), -a, l, r, totals[lang], -s))
    return result


@pytest.mark.parametrize("limit", [collocations.BROADCAST_NAMES, 0])
def test_collocations_equal_brute_force(spark, limit):
    rng = random.Random(3)
    vocabulary = ["new", "york", "city", "É", "Über", "a", "b", "c", "日本"]
    docs = [(rng.choice(["en", "de", None]), " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", "\t", "\n", "!"]) for _ in range(rng.randrange(60)))) for _ in range(200)]
    docs += [("en", None), ("en", ""), (None, "New York City, new york city \x0b NEW york" * 20), ("fr", "x " * 500), ("en", docs[0][1])]
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = collocations.collocation_rows(frame, min_count=8, top=40, limit=limit)
    assert {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()} == brute_collocations(docs, 8, 40)


def test_collocations_of_empty_tables_and_clashing_columns(spark):
    frame = spark.createDataFrame([("en", "a b " * 40, 1, 2)], "lang string, text string, name int, left int")
    assert collocations.collocation_rows(frame).count() > 0
    assert collocations.collocation_rows(frame.limit(0)).count() == 0


def test_scores_do_not_wrap_at_64_bits(spark):
    from pyspark.sql import functions as F
    big = 9 * 10**18
    row = spark.range(1).select(collocations._floor_score(F.lit(big), F.lit(big), F.lit(big)).alias("a"), collocations._floor_score(F.lit(big - 1), F.lit(big), F.lit(big)).alias("b")).first()
    assert (row.a, row.b) == (10**6, 2000000 * (big - 1) // (2 * big))


# -- personal data -----------------------------------------------------------


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(number):
        total = 0
        for i, c in enumerate(reversed(number)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    find = lambda pattern: [m for m in re.finditer(pattern, text)]
    return [
        [m.span() for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")],
        [m.span() for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in m.group().split("."))],
        [m.span() for m in find(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
        [m.span() for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(m.group())) <= 15]]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a", "@", ".", "-", "b", "1", "2", "255", "_", " ", "+", "(", ")", "é", "\n", "12345", "4111111111111111", "256", "0001"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert private_data.base_spans(text) == brute_spans(text), text


def test_base_spans_of_very_long_texts_take_linear_time():
    for unit in ("a", "1", "a@", "1.", "+1(", "@", "1 "):
        text = unit * 300_000
        private_data.base_spans(text)


def seeded_docs():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = []
    for i in range(12):
        docs.append((i, f"{filler(30)} please write to me at {word()}.{i}@mail.example.com today {filler(10)}"))
    for i in range(12, 20):
        docs.append((i, f"{filler(8)} mobile: +1 (555) 555-{1000 + i} {filler(20)}"))
    # unseen forms in the same places
    docs.append((100, f"{filler(9)} please write to me at jane_doe_77(at)mail today {filler(3)}"))
    docs.append((101, f"{filler(9)} mobile: 0049-555-7788, {filler(3)}"))
    # numbers elsewhere stay
    docs.append((102, f"{filler(9)} version 12345678 of {filler(9)}"))
    docs += [(200, None), (201, ""), (202, filler(5)), (0, docs[0][1])]
    return docs


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    docs = seeded_docs()
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, base int, row string").repartition(3)
    texts = dict(docs)
    got = private_data.private_spans(frame).collect()
    assert len(got) == len(docs)
    assert {"base", "row", "base_1", "added"} <= set(got[0].asDict())
    for r in got:
        assert [[(s.start, s.end) for s in r.base_1 if s.kind == k] for k in range(4)] == brute_spans(texts[r.doc_id] or "")
    added = {(r.doc_id, private_data.KINDS[s.kind], texts[r.doc_id][s.start : s.end]) for r in got for s in r.added}
    assert added == {(100, "email", "jane_doe_77(at)mail"), (101, "phone", "0049-555-7788")}


def test_private_rows_digest_their_spans(spark):
    docs = seeded_docs()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts = dict(docs)
    for r in private_data.private_rows(frame).collect():
        spans = brute_spans(texts[r.doc_id] or "")
        listed = ",".join(f"{k}:{s}:{e}" for k, kind in zip(private_data.KINDS, spans) for s, e in kind)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in spans]
        assert r.n_added > 0 or r.spans == listed
    assert private_data.private_rows(frame.limit(0)).count() == 0
    # without seeds nothing is learned
    assert private_data.private_rows(frame.filter("doc_id between 100 and 102")).agg({"n_added": "sum"}).first()[0] == 0


def test_plain_words_weigh_against_a_pattern(spark):
    docs = [(i, f"word of {i}.{i}@mail.example.com end") for i in range(5)] + [(i, "word of mouth end") for i in range(10, 40)] + [(99, "word of x12345 end")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert private_data.private_rows(frame).agg({"n_added": "sum"}).first()[0] == 0


def test_scores_equal_a_plain_graph(spark):
    """The patterns' scores after the rounds, recomputed with dictionaries over all contexts."""
    docs = seeded_docs()
    edges, seeds, plain = set(), {}, Counter()
    for _, text in docs:
        text = text or ""
        found, keys = private_data._slots(text, private_data.base_spans(text))
        for f, row in zip(found, keys.tolist()):
            for place, ctx in enumerate(row):
                edges.add((ctx, place, f[3]))
                if f[0] >= 0:
                    seeds.setdefault((ctx, f[0]), set()).add(f[3])
        words = private_data._framed(private_data._WORD.findall(text))
        hashes, flags = private_data.word_hashes(words)
        import numpy as np
        at = np.array([i for i in range(3, len(words) - 2) if flags[i]], dtype=int)
        plain.update(private_data.context_keys(hashes, at, at).ravel().tolist())
    known = {}
    for ctx, place, content in edges:
        known.setdefault(ctx, set()).add(content)
    patterns = {(c, k): len(known[c]) + plain[c] for (c, k), s in seeds.items() if len(s) >= 3 and len(known[c]) >= 0.7 * (len(known[c]) + plain[c])}
    place_of = {c: p for c, p, _ in edges}
    own = {(x, k) for (_, k), s in seeds.items() for x in s}
    weights = dict.fromkeys(own, 1.0)
    for _ in range(private_data.ROUNDS):
        scores = {(c, k): sum(weights.get((x, k), 0) for x in known[c]) / (n + 1) for (c, k), n in patterns.items()}
        best = {}
        for (c, k), v in scores.items():
            for x in known[c]:
                f = (x, k, private_data.FAMILIES[place_of[c]])
                best[f] = max(best.get(f, 0), v)
        weights = {}
        for (x, k, _), v in best.items():
            weights[x, k] = 1 - (1 - weights.get((x, k), 0)) * (1 - v)
        weights.update(dict.fromkeys(own, 1.0))
    expected = {k: v for k, v in scores.items() if v >= private_data.CONFIDENT}
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("coalesce(text, '') AS text", "monotonically_increasing_id() AS row")
    got = private_data.learned_patterns(frame.mapInArrow(private_data._scan, private_data._SCANNED), frame)
    got = {(r.ctx, r.kind): r.score for r in got.collect()}
    assert expected and got.keys() == expected.keys()
    assert all(abs(got[k] - v) < 1e-9 for k, v in expected.items())
