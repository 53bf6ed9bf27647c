"""The training-data operators against brute force, round trips and fixed cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("pairloom.llm")
from pairloom.llm import (  # noqa: E402
    chat_format, common, decontaminate, license_scan, line_dedup, mixing, ngram_join, quality_rules, token_counts, token_output, toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)] + ["Ünï", "ça", "日本"]


def make_docs(seed: int = 0, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out: list[tuple] = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            text = rng.choice([None, "", "   \n\t", "one", "two words"])
        elif kind < 0.45 and out and any(r[1] for r in out):
            words = rng.choice([r[1] for r in out if r[1]]).split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", "\n", "  ", "#"]) for _ in range(rng.choice([5, 40, 90, 600])))
        out.append((i, text, rng.choice(["en", None]), rng.choice(["a", "a", "b", "c", "é", None]), None))
    out.append(out[-1])  # a repeated row
    out.append((10_000, "long " * 30_000 + "tail", "en", "a", 1))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# -- quality rules -----------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(8)} if len(words) < 2000 else set(range(len(words) - 1))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_measures_match_brute_force(docs):
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    for r in rows(quality_rules.quality_rows(docs)):
        want = brute_quality(texts[r["doc_id"]])
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == want, r
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_host_verdict_takes_soft_failures_of_bad_hosts_only(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    noisy = clean + " ####################################################################"
    data = [(i, noisy, "en", "bad", 0) for i in range(60)] + [(100, clean, "en", "bad", 0)]
    data += [(200 + i, clean, "en", f"h{i % 6}", 0) for i in range(300)] + [(900, noisy, "en", "h1", 0), (901, noisy, "en", None, 0)]
    kept = {r["doc_id"]: r["kept"] for r in rows(quality_rules.quality_rows(spark.createDataFrame(data, DOCS)))}
    assert not any(kept[i] for i in range(60))
    assert kept[100] and kept[900] and kept[901] and kept[200]


def test_block_rate_rejects_a_whole_host_only_if_asked(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    data = [(i, "junk", "en", "spam", 0) for i in range(200)] + [(500, clean, "en", "spam", 0)]
    data += [(1000 + i, clean, "en", f"h{i % 9}", 0) for i in range(300)]
    df = spark.createDataFrame(data, DOCS)
    assert {r["doc_id"]: r["kept"] for r in rows(quality_rules.quality_rows(df))}[500]
    kept = {r["doc_id"]: r["kept"] for r in rows(quality_rules.quality_rows(df, block_rate=0.8))}
    assert not kept[500] and kept[1000]


@pytest.mark.parametrize("limit", [200_000, 2])
def test_verdicts_follow_the_posterior(spark, monkeypatch, limit):
    """Brute force over hosts, with the hosts' table broadcast and beyond the bound."""
    monkeypatch.setattr(quality_rules.size_checked, "__defaults__", (limit,))
    rng = random.Random(13)
    clean = " ".join(f"word{i}" for i in range(40))
    texts = {"clean": clean, "symbols": clean + " " + "#" * 90, "lines": "\n".join([clean, "one line", "one line", "one line"]), "base": "short"}
    data = []
    for h in range(12):
        for i in range(rng.choice([5, 40, 120])):
            kind = "clean" if rng.random() > (0.05, 0.4)[h % 6 == 0] else rng.choice(["symbols", "lines", "base"])
            data.append((1000 * h + i, texts[kind], kind, f"h{h}", 0))
    data += [(99_000, texts["symbols"], "symbols", None, 0)]
    fails = {"base": lambda k: k == "base", "symbols": lambda k: k == "symbols", "lines": lambda k: k == "lines"}
    hosts = sorted({r[3] for r in data if r[3]})
    above = {}
    for rule, failed in fails.items():
        n = {h: sum(r[3] == h for r in data) for h in hosts}
        k = {h: sum(r[3] == h and failed(r[2]) for r in data) for h in hosts}
        mean = min(max(sum(k.values()) / sum(n.values()), 1e-4), 1 - 1e-4)
        var = float(np.var([k[h] / n[h] for h in hosts]))
        weight = max(2.0, mean * (1 - mean) / min(max(var, 1e-6), mean * (1 - mean) * 0.99) - 1)
        for h in hosts:
            p = (k[h] + mean * weight) / (n[h] + weight)
            above[h, rule] = p - 1.2815515655446004 * (p * (1 - p) / (n[h] + weight + 1)) ** 0.5 > mean
    got = {r["doc_id"]: (r["kept"], r["host_rejected"]) for r in rows(quality_rules.quality_rows(spark.createDataFrame(data, DOCS)))}
    for id_, _, kind, host, _ in data:
        gone = kind in ("symbols", "lines") and host is not None and (above[host, kind] or above[host, "base"])
        assert got[id_] == (kind != "base" and not gone, gone)
    assert any(g for _, g in got.values())


def test_quality_keeps_columns_and_clashing_names(spark, empty):
    df = spark.createDataFrame([(1, " ".join(map(str, range(30))), "x", "s", 5, "mine")], DOCS + ", n_words string")
    assert quality_rules.keep_good(df).columns == df.columns
    assert quality_rules.keep_good(df).first()["n_words"] == "mine"
    assert quality_rules.keep_good(empty).count() == 0


# -- token counts ------------------------------------------------------------


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in rows(docs)}
    for r in rows(token_counts.token_count_rows(docs)):
        text = texts[r["doc_id"]]
        n = len(model.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    assert token_counts.token_count_rows(empty).count() == 0


@pytest.mark.parametrize("size", [1, 7, 40])
def test_pieces_are_cut_where_the_library_cuts(size):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))
    text = "I'll go  there, <|endoftext|> l'été où\n\n tabs\t x y9 9z don't " * 5
    parts = token_counts.pieces(text, size)
    assert "".join(parts) == text
    assert sum(len(model.encode(p, add_special_tokens=False).ids) for p in parts) == len(model.encode(text, add_special_tokens=False).ids)


def test_parts_only_where_the_definition_allows():
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    token = {"content": "<|end|>", "lstrip": False, "rstrip": False}
    assert token_counts.divisible({"pre_tokenizer": byte_level, "added_tokens": [token]})
    assert token_counts.divisible({"pre_tokenizer": {"type": "Sequence", "pretokenizers": [byte_level]}})
    for other in ({}, {"pre_tokenizer": {"type": "Metaspace"}}, {"pre_tokenizer": byte_level, "normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**byte_level, "add_prefix_space": True}},
                  {"pre_tokenizer": byte_level, "added_tokens": [{**token, "content": "a b"}]}, {"pre_tokenizer": byte_level, "added_tokens": [{**token, "lstrip": True}]}):
        assert not token_counts.divisible(other)


def test_texts_without_blanks_are_cut_and_counted_as_the_library_does():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))
    text = "日本語の文章です。次の文、これは！ж слово ещё一つ（例）" * 40
    parts = token_counts.pieces(text, 50)
    assert len(parts) > 10 and "".join(parts) == text
    assert token_counts.count_tokens([text], "byte_bpe_50k.json") == [len(model.encode(text, add_special_tokens=False).ids)]
    assert sum(token_counts.count_tokens(parts, "byte_bpe_50k.json")) == token_counts.count_tokens([text], "byte_bpe_50k.json")[0]


def test_special_string_in_a_text_counts_as_the_library_does(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in rows(token_counts.token_count_rows(df))}
    assert got == {1: 4, 2: 0}


# -- chat format -------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\</s>", "<\\/s>", "[/INST]\n</s>\n<s>[INST]", "<<SYS>> \\\\", "", None, "<", "</s", "日本"]
    rng = random.Random(3)
    data, want = [], {}
    for c in range(40):
        turns = [(rng.choice(["user", "assistant", "system", None, "[INST]x"]), rng.choice(nasty)) for _ in range(rng.randrange(1, 7))]
        data += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
        said = "".join(f"{r or ''}\n{x or ''}\n" for r, x in turns)
        loss = "".join(x or "" for r, x in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows(chat_format.chat_rows(chat_format.with_extra(df)))}
    assert got.pop(-7)[0] == 2
    assert got == want


def test_chat_examples_train_one_reply_each(spark):
    data = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "q3")]
    got = rows(chat_format.expand(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).orderBy("example"))
    assert [r["trainable"] for r in got] == [True, True, False]
    for r, reply in zip(got, ["a1", "a2"], strict=False):
        assert r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_chars"]] == reply
    assert "q1" in got[1]["formatted"] and "a1" in got[1]["formatted"] and "q3" not in got[1]["formatted"]
    assert chat_format.chat_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rows_without_a_conversation_stand_alone(spark):
    data = [(None, 0, "user", "x"), (None, 1, "assistant", "</s>y"), (None, 1, "assistant", "</s>y"), (5, None, "assistant", None), (5, 1, None, "z")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in rows(chat_format.chat_rows(df)))
    assert got == [(0, 1, 0), (0, 1, 5), (0, 1, 5), (5, 2, 0)]
    assert [r["formatted"] for r in rows(chat_format.expand(df).filter("conv_id is null and trainable"))] == ["<s>[INST]assistant[/INST]\n<\\/s>y</s>\n"] * 2


# -- decontamination ---------------------------------------------------------


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = word.findall((text or "").translate(low))
    hit, ids = set(), set()
    for id_, item in items:
        w = word.findall((item or "").translate(low))
        for k in range(max(1, len(w) - 12) if w else 0):
            win = w[k : k + 13]
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    ids.add(id_)
    return len(words), len(hit), ids


@pytest.mark.parametrize("group_chars", [32 << 20, 300])
def test_decontamination_matches_brute_force(spark, group_chars):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 13, 20, 40])))) for i in range(12)] + [(77, None), (78, "--"), (79, "w1")]
    data = []
    for i in range(40):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            source = rng.choice(items[:12])[1].split(" ")
            parts.append("; ".join(source[rng.randrange(3) :]).upper())
        data.append((i, " ".join(parts)))
    data += [(100, None), (101, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r["doc_id"]: r["contamination"] for r in rows(decontaminate.decontaminate(df, bench, group_chars=group_chars))}
    for i, text in data:
        n, hit, ids = brute_hits(text, items)
        c = out[i]
        assert (c["n_words"], c["n_hit"], set(c["items"])) == (n, hit, {str(x) for x in ids})
        assert c["contaminated"] == (hit > 0 and 20 * hit >= n)
        for s in c["spans"]:
            assert text[s["start"]].strip() and text[s["end"] - 1].strip()


def test_windows_inside_repetitive_items_are_found_exactly():
    rng = random.Random(21)
    items = [(str(i), " ".join(rng.choice("ab") if i % 2 else rng.choice("abc") for _ in range(rng.choice([1, 6, 7, 12, 13, 14, 26, 40])))) for i in range(25)]
    built = decontaminate.build(items)
    for _ in range(60):
        text = " ".join(rng.choice("ab") if rng.random() < 0.9 else rng.choice("abcz") for _ in range(rng.choice([5, 13, 60, 150])))
        n, ranges, ids = decontaminate.scan(text, built)
        want = brute_hits(text, items)
        assert (n, sum(b - a for a, b in ranges), set(ids)) == (want[0], want[1], want[2])


def test_a_worker_builds_each_group_once(spark, tmp_path, monkeypatch):
    items = [(i, " ".join(f"g{i}x{k}" for k in range(30))) for i in range(30)]
    groups = list(decontaminate.benchmark_groups(spark.createDataFrame(items, "item_id long, text string"), 1000))
    assert len(groups) >= 3 and sorted(int(i) for g in groups for i, _ in g) == list(range(30))
    built = []
    monkeypatch.setattr(decontaminate, "_AUTOMATA", {})
    monkeypatch.setattr(decontaminate, "build", lambda g: built.append(g) or (None, None, g, []))
    for _ in range(5):
        for k, g in enumerate(groups):
            decontaminate._automaton(str(k), g)
    assert built == groups


def test_decontamination_without_items(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert rows(decontaminate.decontamination_rows(df, bench))[0]["n_hit"] == 0
    assert decontaminate.decontamination_rows(empty, bench).count() == 0


# -- n-gram join -------------------------------------------------------------


def brute_components(data, n, percent):
    sets = {}
    for i, text in data:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        sets[i] = {tuple(w)} if w and len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent", "tile", "direct", "hot"), [(3, 90, 1024, 16, 20_000), (2, 60, 7, 16, 20_000), (5, 80, 4, 2, 5)])
def test_join_matches_brute_force(spark, monkeypatch, n, percent, tile, direct, hot):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "DIRECT", direct)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng = random.Random(n)
    bases = [[rng.choice(WORDS) for _ in range(rng.choice([2, 30, 80, 200]))] for _ in range(12)]
    data = []
    for i in range(220):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        data.append((i, " ".join(words)))
    data += [(900, None), (901, ""), (902, "one"), (903, "ONE")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in rows(ngram_join.link_documents(df, n, percent))}
    assert got == brute_components(data, n, percent)


def test_signature_tree_answers_as_all_pairs_do():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 120, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 120 - k % 14], rng.integers(0, 2**63, k % 9, dtype=np.uint64)])) for k in range(90)]
    sets += [np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64)) for _ in range(60)]
    big = np.unique(rng.integers(0, 2**63, 530, dtype=np.uint64))
    sets += [big[: 490 + 2 * k] for k in range(20)]  # both sides of a bitmap width
    roots = list(range(len(sets)))
    for a, b in ngram_join.group_edges(list(range(len(sets))), [len(s) for s in sets], [ngram_join.bitmap(s) for s in sets], 90, sets=sets):
        x, y = roots[a], roots[b]
        roots = [min(x, y) if r in (x, y) else r for r in roots]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                root[max(find(i), find(j))] = min(find(i), find(j))
    same = lambda f: {frozenset(k for k in range(len(sets)) if f(k) == f(i)) for i in range(len(sets))}
    assert same(find) == same(lambda i: roots[i])


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in rows(ngram_join.components(spark.createDataFrame(edges, "a long, b long")))}
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[i] == 100 for i in range(101, 150))


def test_rows_without_an_id_link_too(spark):
    words = [f"t{i}" for i in range(42)]
    chain = [" ".join(words[k : k + 40]) for k in (0, 1, 2)]
    data = [(5, chain[0]), (None, chain[1]), (9, chain[2]), (None, "alone " * 30), (None, None), (3, chain[2])]
    got = [(r["id"], r["component_id"]) for r in rows(ngram_join.link_documents(spark.createDataFrame(data, "doc_id long, text string"), 1, 94))]
    key = lambda p: (p[0] or 0, p[1] or 0)
    assert sorted(got, key=key) == sorted([(5, 3), (None, 3), (9, 3), (3, 3), (None, None), (None, None)], key=key)


def test_keep_one_keeps_one_and_all_columns(spark, empty):
    text = " ".join(f"t{i}" for i in range(50))
    data = [(3, text, "x", "s", 1), (1, text + " more", "x", "s", 1), (1, text + " more", "x", "s", 1), (None, text, "x", "s", 1), (9, "other text", "x", "s", 1)]
    got = rows(ngram_join.keep_one(spark.createDataFrame(data, DOCS)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 9), (True, 0)]
    assert ngram_join.keep_one(empty).count() == 0


@pytest.mark.parametrize("limit", [200_000, 0])
def test_keep_one_loses_no_text_where_ids_clash(spark, monkeypatch, limit):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    data = [(1, a), (7, a), (7, b), (9, c), (9, d), (9, d), (12, d + " more")]
    monkeypatch.setattr(ngram_join, "size_checked", lambda df, rows=200_000: (df, False) if limit == 0 else common.size_checked(df, rows))
    frame = spark.createDataFrame([(i, t, "key") for i, t in data], "doc_id long, text string, _key string")
    got = sorted((r["doc_id"], r["text"]) for r in rows(ngram_join.keep_one(frame)))
    assert got == sorted([(1, a), (7, b), (9, c), (9, d)])


# -- mixing ------------------------------------------------------------------


def brute_targets(words):
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(words.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 2 * words[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = 2.0 * words[s]
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    return target


def test_mix_targets_and_takes(docs, empty):
    texts = {r["doc_id"]: r for r in rows(docs)}
    got = rows(mixing.mix_rows(docs))
    assert len(got) == docs.count()
    words = {}
    for r in got:
        assert r["size"] == len((texts[r["doc_id"]]["text"] or "").split())
        words[texts[r["doc_id"]]["source"]] = words.get(texts[r["doc_id"]]["source"], 0) + r["size"]
    targets = brute_targets(words)
    taken = {}
    for r in got:
        s = texts[r["doc_id"]]["source"]
        assert r["source_size"] == words[s] and r["target"] == pytest.approx(targets[s])
        assert r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in targets.items():
        longest = max(r["size"] for r in got if texts[r["doc_id"]]["source"] == s)
        assert abs(taken[s] - t) <= longest
    again = rows(mixing.mix_rows(docs.repartition(7)))
    key = lambda r: (r["doc_id"], r["taken"], r["shards"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert all(len([x for x in r["shards"].split(",") if x]) * r["size"] == r["taken"] for r in got)
    assert mixing.mix_rows(empty).count() == 0


@pytest.mark.parametrize("digits", [1, 3])
def test_tree_splits_blocks_as_a_sort_of_the_marks_does(spark, monkeypatch, digits):
    monkeypatch.setattr(mixing, "RANK_DIGITS", digits)
    blocks = [("=s" if i % 3 else "", f"{i:03x}", 1 + i % 2) for i in range(83)]
    want = {b: 0 for b in blocks}
    for level in range(3):
        nodes = {}
        for b, shard in want.items():
            nodes.setdefault(shard, []).append(b)
        for shard, mine in nodes.items():
            mark = lambda b: hashlib.md5(f"mix-1/{level}|{shard}|{b[0]}|{b[1]}|{b[2]}".encode()).hexdigest()  # noqa: B023, E731
            for rank, b in enumerate(sorted(mine, key=mark), 1):
                want[b] = 2 * shard + (0 if 2 * rank <= len(mine) + 1 else 1)
    got = rows(mixing.split_tree(spark.createDataFrame(blocks, "name string, block string, pass int"), 3))
    assert {(r["name"], r["block"], r["pass"]): r["shard"] for r in got} == want and len(got) == 83
    sizes = [list(want.values()).count(s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2


def test_mix_is_the_same_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    key = lambda r: (r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"], r["shards"])
    want = sorted(map(key, rows(mixing.mix_rows(docs))))
    monkeypatch.setattr(mixing.lookup, "__defaults__", (1,))
    assert sorted(map(key, rows(mixing.mix_rows(docs)))) == want


def test_mixed_rows_come_in_the_order_of_the_mix(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "some words " * (1 + i % 5)) for i in range(300)], "doc_id long, source string, text string")
    mixed = rows(mixing.mix(docs).orderBy("mix_shard", "mix_slot"))
    assert [r["doc_id"] for r in rows(mixing.mixed_rows(docs))] == [r["_row"]["doc_id"] for r in mixed]
    assert [r["_row"]["doc_id"] for r in mixed] != sorted(r["_row"]["doc_id"] for r in mixed)


def test_mix_repeats_rows_and_writes_shards(spark, docs, tmp_path):
    mixed = mixing.mix(docs, levels=2)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in rows(mixing.mix_rows(docs)) if r["size"]}
    counts = {r["doc_id"]: r["count"] for r in rows(mixed.groupBy("_row.doc_id").count())}
    repeated = {r["doc_id"] for r in rows(docs.groupBy("doc_id").count().filter("count > 1"))}
    for i, n in taken.items():
        assert counts.get(i, 0) == n * (2 if i in repeated else 1)
    mixing.write_shards(mixed, str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == mixed.count()


# -- toxicity ----------------------------------------------------------------


def test_toxicity_learns_from_document_labels_and_locates(spark):
    rng = random.Random(8)
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ["lan", "mer", "sto"]]
    bad = ["vileword", "nastyterm"]

    def sentence(extra=None):
        w = [rng.choice(plain) for _ in range(8)]
        if extra:
            w.insert(4, extra)
        return " ".join(w) + "."

    data, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        s = [sentence() for _ in range(rng.randrange(2, 12))]
        if toxic:
            s.insert(rng.randrange(len(s)), sentence(rng.choice(bad)))
        data.append((i, " ".join(s)))
        labels.append((i, int(toxic)))
    data += [(9000, None), (9001, ""), (9002, "unknown things only")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = {r["doc_id"]: r for r in rows(toxicity.toxicity_rows(df, spark.createDataFrame(labels, "doc_id long, toxic int")))}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] for i, _ in held) and sum(r["held_out"] for r in out.values()) >= len(held)
    assert sum(out[i]["predicted"] == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[9000]["predicted"] == 0
    model = toxicity.fit([(t, y) for (_, t), (_, y) in zip(data, labels, strict=False)])
    text = sentence() + " " + sentence("vileword") + " " + sentence()
    spot = rows(toxicity.score_texts(spark.createDataFrame([(text,)], "text string"), model))[0]["toxicity"]["sentences"]
    assert len(spot) == 1 and "vileword" in text[spot[0]["start"] : spot[0]["end"]]


def brute_toxicity(text, model):
    """Noisy-or over sentences, word by word, and the spans of the bad ones."""
    clean, bad, at = 1.0 - model.leak, [], 0
    for part in re.split(r"(?<=[.!?\n])", text or ""):
        known = [sum(model.weights[f] for f in toxicity.features(w) if f in model.weights) for w in re.findall(r"[^\W\d_]+", part.lower()) if any(f in model.weights for f in toxicity.features(w))]
        if known:
            p = 1 / (1 + np.exp(-min(max(model.bias + sum(known), -30), 30)))
            clean *= 1 - p
            if p >= toxicity.THRESHOLD:
                bad.append((at, at + len(part)))
        at += len(part)
    return min(1.0, max(0.0, 1 - clean)), bad


def test_toxicity_scores_whole_texts_as_a_plain_noisy_or_does(spark):
    rng = random.Random(17)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "vile", "übel") for b in ("ra", "na", "st", "")]
    texts = [None, "", "...", "vile", "nothing here"] + ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", ". ", "!\n", "-", "1 "]) for _ in range(rng.choice([3, 60, 5000]))) for _ in range(40)]
    model = toxicity.Model({"vile": 2.0, "^vile": 1.5, "lo": -0.5, "^übel": 3.0, "kara": 0.25}, -3.0, 0.02)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    for r in rows(toxicity.score_texts(df, model)):
        score, bad = brute_toxicity(texts[r["i"]], model)
        assert r["toxicity"]["score"] == pytest.approx(score, abs=1e-12)
        assert [(s["start"], s["end"]) for s in r["toxicity"]["sentences"]] == bad


def test_toxicity_fit_does_not_hang_on_the_order_of_repeated_ids(spark):
    data = [(i, f"{'bad' if i % 2 else 'good'} text number {i}.") for i in range(40)] + [(1, "another text"), (2, "zz other")]
    labels = [(i, i % 2) for i in range(40)] + [(1, 1)]
    frames = [spark.createDataFrame(d, "doc_id long, text string").repartition(k) for d, k in ((data, 2), (data[::-1], 5))]
    a, b = (toxicity.training_rows(f, spark.createDataFrame(labels, "doc_id long, toxic int")) for f in frames)
    assert a == b and ("another text", 1) in a


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["predicted"] == 0 for r in rows(toxicity.toxicity_rows(docs, none)))


# -- license scan ------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            row[j + 1], prev = (prev + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_license_scan_finds_what_lcs_finds():
    rng = random.Random(2)
    templates = license_scan.TEMPLATES
    scanner = license_scan.Scanner()
    for _ in range(120):
        name = rng.choice(list(templates))
        words = templates[name].split(" ")
        for _ in range(rng.randrange(0, max(1, len(words) // 12) + 1)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        text = " ".join([rng.choice(WORDS) for _ in range(300)] + words + [rng.choice(WORDS) for _ in range(300)])
        tokens = [w.lower() for w in re.findall(r"[^\W_]+", text)]
        want = [w.lower() for w in re.findall(r"[^\W_]+", templates[name])]
        found = {m[0]: m for m in scanner.scan(text)}
        if lcs(want, tokens[290:-290]) >= 0.9 * len(want) and name not in ("Apache-2.0",):
            assert name in found or any(m[2] > len(want) for m in found.values()), (name, text)
        for m in found.values():
            assert m[1] <= lcs([w.lower() for w in re.findall(r"[^\W_]+", templates[m[0]])], tokens)


def test_license_prefilter_loses_no_window():
    """Every window of the text, aligned without any filter, gives the same matches."""
    rng = random.Random(23)
    for trial in range(60):
        template = [rng.choice("abcdefgh") for _ in range(rng.choice([3, 7, 12, 25]))]
        scanner = license_scan.Scanner({"T": " ".join(template)})
        text = []
        for _ in range(4):
            words = list(template)
            for _ in range(rng.randrange(1 + len(words) // 4)):
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(2)] = [rng.choice("abxyz")] * rng.randrange(2)
            text += words + [rng.choice("abxyz") for _ in range(rng.randrange(12))]
        size = int(license_scan.STRETCH * len(template)) + 3
        best = []
        for lo, w in enumerate(text):
            if w in template:
                pairs = license_scan.align(template, text, 0, len(template), lo, min(len(text), lo + size))
                if len(pairs) >= license_scan.COVERAGE * len(template):
                    best.append((-len(pairs), pairs[-1][1] - pairs[0][1], pairs[0][1], pairs[-1][1]))
        taken = []
        for missed, _, first, last in sorted(best):
            if all(last < x or first > y for x, y, _ in taken):
                taken.append((first, last, -missed))
        starts = [2 * i for i in range(len(text))]
        got = [(starts.index(s), starts.index(e - 1), m) for _, m, _, s, e in scanner.scan(" ".join(text))]
        whole = [t for t in taken if not any(u is not t and u[2] > t[2] and u[0] <= t[0] and t[1] <= u[1] for u in taken)]
        assert sorted(got) == sorted(whole), trial


def test_patience_and_spans(spark):
    seq = [random.Random(4).randrange(50) for _ in range(60)]
    got = license_scan.increasing(seq)
    assert all(seq[a] < seq[b] for a, b in zip(got, got[1:], strict=False))
    best = [1] * len(seq)
    for i in range(len(seq)):
        best[i] = max([best[j] + 1 for j in range(i) if seq[j] < seq[i]], default=1)
    assert len(got) == max(best)
    text = "Some words.\nReleased under the MIT License.\nMore; Released under the MIT License. end"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in rows(license_scan.scan_licenses(df))}
    assert [text[m["start"] : m["end"]] for m in out[1]["licenses"]] == ["Released under the MIT License"] * 2
    assert out[2]["licenses"] == [] and out[3]["licenses"] == []
    assert {r["doc_id"]: r["n_matches"] for r in rows(license_scan.license_rows(df))} == {1: 2, 2: 0, 3: 0}


# -- line dedup --------------------------------------------------------------


def brute_dedup(data, min_words, within=False):
    """{(id, text): (text left, removed spans)} for rows with ids; documents rank by id."""
    def cut(text):
        out, at = [], 0
        for i, c in enumerate(text):
            if c == "\n" or c in " \t\x0b\x0c\r" and i and text[i - 1] in ".!?":
                out.append((at, i + 1))
                at = i + 1
        out.append((at, len(text)))
        norm = lambda a, b: " ".join(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text[a:b])))
        return [(a, b, norm(a, b)) for a, b in out if norm(a, b)]

    docs = {r: cut(r[1] or "") for r in sorted(set(data), key=lambda r: r[0])}
    first, out = {}, {}
    for r, us in docs.items():
        for k, (_, _, n) in enumerate(us):
            first.setdefault(n, (r, k))
    for r, us in docs.items():
        repeat = [first[n] != (r, k) and (within or first[n][0] != r) for k, (_, _, n) in enumerate(us)]
        gone, k = [], 0
        while k < len(us):
            j = k
            while j < len(us) and repeat[j]:
                j += 1
            if sum(len(us[i][2].split(" ")) for i in range(k, j)) >= min_words and j > k:
                gone += [us[i][:2] for i in range(k, j)]
            k = max(j, k + 1)
        text = r[1]
        for a, b in reversed(gone):
            text = text[:a] + text[b:]
        out[r] = (text, gone)
    return out


@pytest.mark.parametrize(("within", "hot"), [(False, 5000), (True, 5000), (False, 1)])
def test_line_dedup_matches_brute_force(spark, within, hot):
    rng = random.Random(11)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + rng.choice(".!?")
    passages = [rng.choice(" \n").join(sentence(rng.choice([1, 4, 9, 15])) for _ in range(5)) for _ in range(4)]
    data = []
    for i in range(60):
        parts = [sentence(rng.choice([2, 8, 20])) for _ in range(6)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(7), rng.choice(passages).swapcase() if rng.random() < 0.3 else rng.choice(passages))
        data.append((i, "".join(p + rng.choice([" ", "\n", "  ", "\r\n", "\n\n"]) for p in parts)))
    data += [(100, None), (101, ""), (102, " \n. \n"), data[7], (103, "lone line without an end " * 4000)]
    want = brute_dedup([r for r in data if r[1] is not None], 12, within)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    gone = {(r["id"], r["hash"]): r["removed"] for r in rows(line_dedup.removals(df, 12, within=within, hot_share=1, hot_least=hot))}
    spans = {r["doc_id"]: [(x["start"], x["end"]) for x in gone.get((r["doc_id"], r["h"]), [])] for r in rows(df.selectExpr("doc_id", "xxhash64(text) as h"))}
    out = rows(line_dedup.dedup_lines(df, 12, within=within))
    assert len(out) == len(data)
    for r in out:
        before = next(t for i, t in data if i == r["doc_id"])
        if before is None:
            assert r["text"] is None and r["removed"] is None
            continue
        left, cut = want[r["doc_id"], before]
        assert (r["text"], [(x["start"], x["end"]) for x in r["removed"] or []], spans[r["doc_id"]]) == (left, cut, cut)
    assert any(cut for _, cut in want.values())


def test_line_dedup_keeps_every_unit_once_and_short_repeats(spark, empty):
    long = "the very same sentence of many words " * 4 + "ends."
    data = [(None, f"A.\n{long}"), (None, f"{long} B."), (7, f"Own words. {long.upper()}\nMore."), (7, "Short. All rights reserved."), (8, "Short. All rights reserved.")]
    out = rows(line_dedup.dedup_rows(spark.createDataFrame(data, "doc_id long, text string")))
    assert sorted(r["text"] for r in out) == sorted([f"A.\n{long}", "B.", "Own words. More.", data[3][1], data[4][1]]) or sorted(r["text"] for r in out) == sorted(
        ["A.\n", f"{long} B.", "Own words. More.", data[3][1], data[4][1]])
    for r in out:
        assert r["n_chars"] == len(r["text"]) and r["n_chars_before"] == r["n_chars"] + r["removed_chars"]
    assert line_dedup.dedup_rows(empty).count() == 0


# -- token output ------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_feistel_is_a_permutation(n):
    got = token_output.feistel(np.arange(n), n)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 64 or got.tolist() != list(range(n))


def test_token_output_round_trip(spark, docs, empty, tmp_path):
    import json

    folder = str(tmp_path / "order")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = token_output.written_order(docs, folder, length=64, shard_sequences=5)
    got = rows(out)
    total = len(got)
    assert sorted(r["slot"] for r in got) == list(range(total))
    encoding = token_output._encoding("byte_bpe_50k.tiktoken")
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    copies = {r["doc_id"]: r["count"] for r in rows(docs.groupBy("doc_id").count())}
    for i, text in texts.items():
        parts = sorted((r["seq"], r["tokens"]) for r in got if r["doc_id"] == i)
        ids = [x for k in range(0, len(parts), copies[i]) for x in np.frombuffer(parts[k][1], "<u2").tolist()]
        if not text:
            assert not parts
            continue
        assert ids[-1] == token_output.END and encoding.decode(ids[:-1]) == text
    # every slot is the keyed permutation of the sequence's number in the table's order
    numbers, at = {}, 0
    for r in docs.select("doc_id", "text").collect():
        n = -(-len(token_output.encode(r["text"], "byte_bpe_50k.tiktoken")) // 128)
        for seq in range(n):
            numbers.setdefault((r["doc_id"], seq), set()).add(int(token_output.feistel(np.array([at + seq]), total)[0]))
        at += n
    assert at == total
    for key in numbers:
        assert {r["slot"] for r in got if (r["doc_id"], r["seq"]) == key} == numbers[key]
    # the files: fixed stride, padded, whole, and read from any slot
    layout = token_output.read_layout(folder)
    assert layout == {"stride": 128, "per_shard": layout["per_shard"], "records": total, "shards": -(-total // layout["per_shard"])}
    end = token_output.END.to_bytes(2, "little")
    by_slot = {r["slot"]: bytes(r["tokens"]) + end * (64 - r["n_tokens"]) for r in got}
    for shard in range(layout["shards"]):
        data = (tmp_path / "order" / f"shard-{shard:08d}.bin").read_bytes()
        held = json.loads((tmp_path / "order" / f"shard-{shard:08d}.json").read_text())
        mine = range(shard * layout["per_shard"], min(total, (shard + 1) * layout["per_shard"]))
        assert data == b"".join(by_slot[s] for s in mine)
        assert held == {"shard": shard, "records": len(mine), "sha256": hashlib.sha256(data).hexdigest()}
    for first in (0, 1, total // 2, total):
        assert list(token_output.read_slots(folder, first)) == [(s, by_slot[s]) for s in range(first, total)]
        assert sorted(r["slot"] for r in rows(token_output.read_order(spark, folder, first))) == list(range(first, total))
    assert not [p for p in (tmp_path / "order").iterdir() if p.name.startswith(".shard")]
    again = {(r["slot"], r["doc_id"], r["seq"]) for r in rows(token_output.written_order(docs, length=64, shard_sequences=5, rounds=1))}
    assert again == {(r["slot"], r["doc_id"], r["seq"]) for r in got}
    with pytest.raises(FileExistsError):
        token_output.write_order(docs, folder)
    none = token_output.written_order(empty)
    assert none.count() == 0 and list(token_output.read_slots(none.written_to)) == []


# -- clashing names, nulls, ties ---------------------------------------------


CLASH = ", ".join(f"{c} string" for c in (
    "_row", "_k", "_block", "_s", "_b", "draws", "block", "digits", "size", "target", "contamination", "_scan0", "quality", "kept", "n_words", "_host", "_m",
    "component_id", "id", "cls", "token", "slot", "shard", "start", "copies", "score", "_y", "removed", "_id", "licenses", "toxicity", "n_tokens"))


def test_operators_pass_clashing_columns_by(spark):
    text = " ".join(f"q{i}" for i in range(60))
    more = ["mine"] * len(CLASH.split(", "))
    data = [(1, text, None, "a", None, *more), (2, text + " x", "en", None, 3, *more), (2, text + " x", "en", None, 3, *more), (None, "z " * 40, None, "a", 1, *more), (4, None, None, None, None, *more)]
    df = spark.createDataFrame(data, DOCS + ", " + CLASH)
    bench = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    for made in (quality_rules.keep_good(df), ngram_join.keep_one(df), decontaminate.keep_clean(df, bench), mixing.mixed_rows(df)):
        assert made.columns == df.columns
        assert all(r["kept"] == "mine" and r["draws"] == "mine" and r["contamination"] == "mine" for r in rows(made))
    assert decontaminate.keep_clean(df, bench).count() == 5
    model = toxicity.Model({}, 0.0, 0.5)
    for made, name in ((decontaminate.decontaminate(df, bench), "contamination_1"), (toxicity.score_texts(df, model), "toxicity_1"), (license_scan.scan_licenses(df), "licenses_1"),
                       (line_dedup.dedup_lines(df), "removed_1"), (token_counts.with_token_counts(df), "n_tokens_1")):
        assert made.columns == [*df.columns, name]
        assert all(r[c] == "mine" for r in rows(made) for c in CLASH.replace(" string", "").split(", "))
    for made in (quality_rules.quality_rows(df), mixing.mix_rows(df), token_counts.token_count_rows(df), decontaminate.decontamination_rows(df, bench),
                 ngram_join.link_rows(df), toxicity.toxicity_rows(df, labels), license_scan.license_rows(df), line_dedup.dedup_rows(df)):
        assert made.count() == 5
    assert token_output.written_order(df).count() == 4
