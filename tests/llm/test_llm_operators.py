"""Operators against brute force on small data with nulls, ties, repeats, long and empty texts, and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat, decontaminate, html, licenses, linededup, neardup, packing, quality, sharding, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXTS string, n long, lines string, s string, class string, rank string"


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def sample_docs(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    lines = [sentence(r, 12) for _ in range(12)]
    shared = "\n".join(lines[:4])
    base = sentence(r, 120)
    words = base.split()
    edited = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [None, "", "one", "two words", base, base, edited, shared, "x " + shared + " y", sentence(r, 30) + "\n" + shared + "\n" + sentence(r, 40), "a" * 700, "ab" * 400, "é" * 300, sentence(r, 4000), "\n".join(lines[2:9]), "\n".join(lines[6:12]), "\n\n\n", "line\nline\nline\nline"]
    texts += [sentence(r, r.randint(25, 90)) for _ in range(30)]
    rows = [(i, t, r.choice(["en", "de"]), "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, sentence(r, 50), None, None, 5), (4, base, "en", "s", len(base)), (4, base, "en", "s", len(base))]
    return [(*row, "x", 1, "y", "z", "c", "r") for row in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- chat


def chat_digest(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_are_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s>", "[TURN]", "[\\TURN]", "<<s>", "[ROLE]x[BODY]y[/ROLE]", "", None, "\\", "[OUT]", "日本 \U0001f600 </s>", "a$1\\2", "<s></s>", "x" * 5000]
    roles = ["user", "assistant", "assistant", "system", "tool", "user", "user", None, "[BODY]", "assistant"]
    r = random.Random(3)
    rows = [(c, t, r.choice(roles), r.choice(nasty)) for c in range(20) for t in range(r.randint(1, 9))]
    rows += [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (50, None, "assistant", "first"), (None, 0, "user", "q"), (None, 1, "assistant", "a")]
    df = spark.createDataFrame([(*x, "extra", 9) for x in rows], "conv_id long, turn long, role string, text string, turns string, starts int").repartition(4)
    out = chat.format_chats(df)
    got = {x[0]: tuple(x[1:5]) for x in chat.chat_digests(out).collect()}
    expected = {}
    for c in {x[0] for x in rows}:
        turns = sorted(((t, a or "", b or "") for i, t, a, b in rows if i == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        expected[c] = chat_digest(turns)
    assert got == expected
    for x in out.collect():
        for s in x["loss_spans"]:
            part = x["formatted"][s["start"] : s["start"] + s["length"]]
            assert "[TURN]" not in part and "</s>" not in part
    assert chat.chat_digests(chat.format_chats(df.limit(0))).count() == 0


def test_adjacent_turns_of_one_role_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).first()["formatted"] == "<s>[INST]a[TURN]b[/INST][OUT]c</s>"


# ---- suffixes


def brute_removed(rows, length):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    count = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("length", "k", "crowded"), [(200, 64, 2000), (40, 16, 2000), (200, 64, 1), (40, 16, 1)])
def test_repeats_are_removed_exactly(docs, length, k, crowded):
    got = suffixes.remove_repeats(docs, length=length, k=k, crowded=crowded).collect()
    assert Counter(map(tuple, got)) == brute_removed(sample_docs(), length)


def test_repeats_of_nothing(none):
    assert suffixes.remove_repeats(none).count() == 0


def test_suffixes_are_grouped_by_their_first_bytes():
    r = random.Random(5)
    parts = [bytes(r.choice(b"ab") for _ in range(60)) for _ in range(40)]
    parts += parts[:10] + [p[:50] + b"c" * 10 for p in parts[:10]]
    data = b"".join(parts) + bytes(60)
    at = np.arange(len(parts)) * 60
    cell = np.array([r.randint(0, 1) for _ in parts])
    got = suffixes.repeated_suffixes(data, at, cell, length=60, shallow=16)
    seen = Counter((c, p) for c, p in zip(cell.tolist(), parts, strict=True))
    assert got.tolist() == [seen[c, p] > 1 for c, p in zip(cell.tolist(), parts, strict=True)]


def test_runs_cover_every_window_of_a_long_text():
    r = random.Random(6)
    text = bytes(r.choice(b"abcdefgh") for _ in range((1 << 20) + 12345))
    found = [np.concatenate(c) for c in zip(*suffixes.runs([b"short", text]), strict=True)]
    starts = np.concatenate([np.arange(s, s + n) for s, n in zip(found[1], found[2], strict=True)])
    assert sorted(starts.tolist()) == list(range(len(text) - 199)) and set(found[0].tolist()) == {1}


# ---- lines


def brute_lines(rows, size=3):
    texts = sorted({(d is not None, d or 0, t) for d, t, *_ in rows if t is not None}, key=lambda x: (x[0], x[1], x[2]))
    seen, gone = {}, {}
    for key in texts:
        lines = key[2].split("\n")
        for i in range(len(lines) - size + 1):
            w = tuple(lines[i : i + size])
            if seen.setdefault(w, (key, i)) != (key, i):
                gone.setdefault(key, set()).update(range(i, i + size))
    out = []
    for d, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        g = gone.get((d is not None, d or 0, t), set())
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in g), len(lines), len(g)))
    return Counter(out)


def test_lines_of_repeated_windows_go(docs, none):
    got = linededup.dedup_lines(docs).collect()
    assert Counter(map(tuple, got)) == brute_lines(sample_docs())
    assert linededup.dedup_lines(none).count() == 0
    kept = linededup.dedup_documents(docs)
    assert kept.columns == docs.columns
    assert all(x["text"] is None or x["n_chars"] is not None for x in kept.collect())


# ---- quality


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if count[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_statistics_and_base_rules(docs, none):
    for x in quality.score(docs).collect():
        text = next(t for d, t, *_ in sample_docs() if d == x["doc_id"])
        expected = brute_stats(text)
        assert tuple(x[1:6]) == expected
        assert x["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (x["base_failed"] and x["kept"])
    assert quality.score(none).count() == 0
    assert quality.keep_documents(none).count() == 0


def test_repeat_words_exactly():
    r = random.Random(2)
    for n in (0, 5, 8, 9, 40, 300):
        words = [r.choice("ab") for _ in range(n)]
        assert quality.repeat_words(words) == brute_stats(" ".join(words))[4]


def test_outliers_are_rejected_and_the_rest_kept(spark):
    r = random.Random(4)
    rows = [(i, sentence(r, r.randint(20, 300)), "en", "a" if i % 3 else "b") for i in range(400)]
    rows += [(1000 + i, " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in sentence(r, 80).split()), "en", "a") for i in range(40)]
    rows += [(2000 + i, " ".join("x" * 40 for _ in range(30)) + sentence(r, 5), "en", "b") for i in range(1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {x["doc_id"]: x["kept"] for x in quality.score(df).collect()}
    assert all(kept[i] for i in range(400))
    assert not any(kept[1000 + i] for i in range(40)) and not kept[2000]
    assert {x["doc_id"] for x in quality.keep_documents(df).collect()} == {i for i, k in kept.items() if k}


def test_small_groups_are_judged_by_their_language_or_all_rows(spark):
    r = random.Random(5)
    bad = lambda: " ".join(w + "###" for w in sentence(r, 80).split())
    rows = [(i, sentence(r, 80), "en", "a") for i in range(60)] + [(100 + i, sentence(r, 80), lang, s) for i, (lang, s) in enumerate([("en", "b"), ("en", "b"), ("fr", "c"), (None, None), ("en", None)])]
    rows += [(200, bad(), "en", "b"), (201, bad(), "en", "d"), (202, bad(), "fr", "c"), (203, bad(), None, None), (204, bad(), "en", None), (205, bad(), "nl", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.score(df).collect()
    assert sorted(x["doc_id"] for x in got) == sorted(x[0] for x in rows)
    assert {x["doc_id"] for x in got if not x["kept"]} == set(range(200, 206))
    assert {x["doc_id"] for x in quality.keep_documents(df).collect()} == {x[0] for x in rows if x[0] < 200}


def test_concentration_ignores_a_quarter_of_far_rows(spark):
    r = np.random.default_rng(1)
    near, far = r.normal(0, [0.3, 0.2, 0.5, 0.4], (3000, 4)), r.normal(9, 0.1, (600, 4))
    df = spark.createDataFrame([("en", None, *map(float, x)) for x in np.concatenate([near, far])], "lang string, source string, x0 double, x1 double, x2 double, x3 double")
    model, _ = quality.fit(df)
    (m,) = model.collect()
    assert all(abs(m[f"m{i}"]) < 0.1 for i in range(4))
    inverse = np.zeros((4, 4))
    for i in range(4):
        for j in range(i, 4):
            inverse[i, j] = inverse[j, i] = m[f"q{i}{j}"]
    spread = np.sqrt(np.diag(np.linalg.inv(inverse)))
    floor = np.array([sd for _, sd in quality.FEATURES.values()])
    assert np.allclose(spread, np.sqrt(np.array([0.3, 0.2, 0.5, 0.4]) ** 2 + floor**2), rtol=0.2)


def brute_mcd(x, share=0.75, steps=50):
    """Minimum covariance determinant of one group in plain numpy: exact nearest rows, two starts, one reweighting."""
    floor = np.diag([sd**2 for _, sd in quality.FEATURES.values()])
    d2 = lambda mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    def estimate(part, p):
        return part.mean(axis=0), np.cov(part.T, bias=True) * p / quality.chi2_cdf(quality.chi2_quantile(p, 4), 6) + floor

    ends = []
    q = np.quantile(x, [0.25, 0.75], axis=0)
    for first in (np.diag(((q[1] - q[0]) / 1.349) ** 2) + floor, floor):
        mean, cov = np.median(x, axis=0), first
        for _ in range(steps):
            mean, cov = estimate(x[np.argsort(d2(mean, cov), kind="stable")[: int(share * len(x))]], share)
        ends.append((np.linalg.slogdet(cov)[1], mean, cov))
    _, mean, cov = min(ends, key=lambda e: e[0])
    mean, cov = estimate(x[d2(mean, cov) <= quality.chi2_quantile(0.975, 4)], 0.975)
    return d2(mean, cov)


def test_verdicts_are_those_of_the_determinant_estimate(spark):
    """Groups of unlike scatter with a fifth of far rows: distances and verdicts against numpy."""
    r = np.random.default_rng(5)
    groups = {}
    for k in range(3):
        mix = r.normal(0, 0.4, (4, 4)) + np.diag([0.3, 0.2, 0.5, 0.4])
        groups[f"s{k}"] = np.concatenate([r.normal(0, 1, (800, 4)) @ mix + k, r.normal(6, 0.5, (200, 4))])
    rows = [("en", s, *map(float, v)) for s, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double").repartition(5)
    model, few = quality.fit(df)
    got = quality._with_distance(df.withColumnsRenamed({"lang": "__l", "source": "__s"}), model, few, [F.col("__s"), F.col("x0"), F.col("x1")]).collect()
    cutoff = quality.chi2_quantile(quality.QUANTILE, 4)
    by = {(x["__s"], x["x0"], x["x1"]): x["d2"] for x in got}
    for s, x in groups.items():
        want = brute_mcd(x)
        have = np.array([by[s, float(v[0]), float(v[1])] for v in x])
        assert np.allclose(have, want, rtol=0.1, atol=0.1)
        sure = abs(want - cutoff) > 0.1 * cutoff
        assert ((have > cutoff) == (want > cutoff))[sure].all() and (want[800:] > cutoff).all() and sure.mean() > 0.95


def test_rows_at_one_distance_are_judged_alike(spark):
    """Ties at the edge of a bin, and a group in which nothing varies."""
    rows = [("en", "a", 1.0, 0.0, 0.0, 0.0)] * 60 + [("en", "a", 1.0, 0.0, 0.3, 0.0)] * 40 + [("en", "b", 2.0, 0.0, 0.0, 0.0)] * 20
    df = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double")
    model, few = quality.fit(df)
    got = quality._with_distance(df.withColumnsRenamed({"lang": "__l", "source": "__s"}), model, few, [F.col("__s"), F.col("x2")]).groupBy("__s", "x2").agg(F.count_distinct("d2").alias("n"), F.max("d2").alias("d2")).collect()
    assert len(got) == 3 and all(x["n"] == 1 and x["d2"] < quality.chi2_quantile(quality.QUANTILE, 4) for x in got)


# ---- licenses


def test_license_regions(spark, none):
    gpl = licenses.TEMPLATES["GPL-3.0-notice"]
    r = random.Random(8)
    reworded = gpl.replace("redistribute", "share").replace("version 3", "version 3.0")
    rows = [(1, sentence(r, 300) + " " + gpl + " " + sentence(r, 200)), (2, reworded), (3, "license " * 50), (4, None), (5, ""), (6, "Released under the MIT License.\nReleased under the MIT License."), (7, sentence(r, 5000) + " licensed under cc by-nc 4.0"), (7, "nothing"), (8, " ".join(reversed(gpl.split())))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["license"]): x for x in licenses.scan_licenses(df).collect()}
    assert (1, "GPL-3.0-notice") in got and got[1, "GPL-3.0-notice"]["first_word"] == 300
    assert 0.9 < got[2, "GPL-3.0-notice"]["coverage"] < 1
    assert (6, "MIT") in got and (7, "CC-BY-NC-4.0") in got
    assert not any(d in (3, 4, 5, 8) for d, _ in got)
    assert licenses.scan_licenses(none).count() == 0


def test_each_notice_is_found_and_families_are_told_apart():
    scan = licenses.Scanner(licenses.TEMPLATES).scan
    names = lambda text: [x[0] for x in scan(text)]
    for name, template in licenses.TEMPLATES.items():
        assert names("first words " + template + " and last words") == [name], name
    r = random.Random(12)
    every = list(licenses.TEMPLATES.items())
    r.shuffle(every)
    text = " ".join(sentence(r, r.randint(0, 40)) + " " + template for _, template in every * 2)
    assert names(text) == [name for name, _ in every * 2]
    assert [x[2:4] for x in scan(text)] == [(len(licenses.words_of(template)), 1.0) for _, template in every * 2]
    assert names("Released under the Zlib License. Licensed under the Apache License, Version 1.1.") == []
    assert names("Released under the MIT License.\nReleased under the MIT License.") == ["MIT", "MIT"]


def test_regions_are_bounded_in_texts_full_of_triggers():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    r = random.Random(13)
    words = sorted(set().union(*scanner.triggers))
    begun = time.monotonic()
    assert scanner.scan("license " * 300_000) == []
    scanner.scan(" ".join(r.choice(words) for _ in range(20_000)))
    assert time.monotonic() - begun < 60


def test_counting_words_loses_no_notice():
    scanner = licenses.Scanner({"one": "red green blue red one", "two": "green blue blue two white grey", "three": "a b c d e f g h"}, 0.6)
    r = random.Random(14)
    for _ in range(300):
        words = [r.choice("red green blue one two white grey a b c d e f g h".split()) for _ in range(r.randint(0, 60))]
        for k, (_, template) in enumerate(scanner.templates):
            reach, done, want = licenses.REACH * len(template), 0, []
            for i, w in enumerate(words):
                if i >= done and w in scanner.triggers[k]:
                    near = scanner.covered(k, words, max(done, i - len(template)), i + len(template) + 1)
                    if places := near or scanner.covered(k, words, max(done, i - reach), i + reach + 1):
                        places = scanner.settled(k, words, places, done)
                        want.append(places)
                        done = places[-1] + 1
            assert list(scanner.notices(k, words)) == want


def test_alignment_is_common_and_finds_unique_anchors():
    r = random.Random(9)
    for _ in range(200):
        a = [r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 25))]
        b = [w if r.random() < 0.8 else r.choice("xyz") for w in a]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) >= 0.6 * sum(x == y for x, y in zip(a, b, strict=True))


# ---- packing


def test_ids_of_letters_whose_lower_case_has_a_mark():
    words = packing._Ids(packing.default_vocabulary())
    r = random.Random(11)
    letters = "aAbIİıΣσςßẞéÉ.,!'-1_ \n中Ǆǅﬁ\u0301\u0307"
    texts = ["RESMİ,", "TAKSİ!", "İ.", "(İ)", *("".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(3000))]
    assert [t for t in texts if packing.ids_of(t, words) != words.encode(t)] == []


def test_pieces_and_sequences(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.pack(docs, length=256).collect()
    whole = Counter()
    for d, t, *_ in sample_docs():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        for s in range(0, len(ids), 256):
            part = ids[s : s + 256]
            whole[d, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter(tuple(x[:5]) for x in got) == whole
    by: dict = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(none).count() == 0


def test_ids_match_the_tokenizer_on_odd_texts():
    words = packing._Ids(packing.default_vocabulary())
    for text in ("it's don't 'll x'y", "Ünï—code ÀÉ naïve Straße İstanbul ß", "<|endoftext|> a<|startoftext|>b", "a\tb\r\nc  d\n\ne", "中文 кириллица ½² été", "word### a''s x_y 12ab", " \n ", "\x1c\x85 z"):
        assert packing.ids_of(text, words) == words.encode(text)


def test_ids_match_the_tokenizer_on_special_capitals():
    words = packing._Ids(packing.default_vocabulary())
    for text in ("ΟΔΟΣ", "ΣΟΦΟΣ ΟΔΟΣ, ΛΟΓΟΣ.", "ΑΣ", "Σ", "Σίσυφος", "ΟΔΟΣ́", "İSTANBUL Iı", "DİYARBAKIR", "ẞ STRASSE", "ΐ Ϊ́", "Å Å", "ǅ Ǆ ﬁ", "ПРИВЕТ"):
        assert packing.ids_of(text, words) == words.encode(text), text


def test_column_generation_is_near_the_bound():
    r = random.Random(1)
    size = np.array(sorted(r.sample(range(5, 64), 40)))
    demand = np.array([r.randint(20, 400) for _ in size], float)
    patterns, counts = packing.solve(size, demand, 128)
    assert (patterns @ size <= 128).all()
    assert (patterns.T @ counts >= demand - 1e-6).all()
    assert counts.sum() <= 1.02 * (size * demand).sum() / 128
    rows = packing.layout({int(s): int(d) for s, d in zip(size, demand, strict=True)} | {128: 7}, 128)
    given: dict = {}
    load: Counter = Counter()
    for c, low, high, first, slots, _ in rows:
        given.setdefault(c, []).append((low, high))
        for rank in range(low, high):
            load[first + (rank - low) // slots] += c
    assert max(load.values()) <= 128 and set(load) == set(range(len(load)))
    for c, parts in given.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][1] == (7 if c == 128 else demand[list(size).index(c)])


# ---- near-duplicates


def brute_classes(rows, least=0.8):
    def vector(t):
        words = re.findall(r"\w+", (t or "").lower())
        n = min(5, len(words))
        return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else None

    vectors = [vector(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if vectors[i] and vectors[j] and sum((vectors[i] & vectors[j]).values()) >= least * sum((vectors[i] | vectors[j]).values()):
                parent[find(i)] = find(j)
    out = Counter()
    for i, (d, *_) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        ids = [x for x in group if x is not None]
        out[d, min(ids) if ids else None, len(group)] += 1
    return out


def test_near_duplicates(docs, none):
    got = neardup.classes(docs)
    assert Counter((x["doc_id"], x["class_id"], x["class_rows"]) for x in got.collect()) == brute_classes(sample_docs())
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and 5 not in {x["doc_id"] for x in kept.collect()}
    assert neardup.classes(none).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark):
    r = random.Random(12)
    base = sentence(r, 200).split()
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(2):
            words[r.randrange(len(words))] = sentence(r, 1)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, sentence(r, 200)) for i in range(100)]
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(300)} == {0} and all(got[1000 + i] == 1000 + i for i in range(100))


def test_near_copies_far_from_every_hub_of_a_large_band(spark):
    r = random.Random(14)
    base = sentence(r, 240).split()

    def changed(words: list[str], n: int) -> list[str]:
        for k in r.sample(range(len(words)), n):
            words = [*words[:k], sentence(r, 1) + str(r.random())[2:], *words[k + 1 :]]
        return words

    rows = []
    for i in range(150):  # pairs of 0.9 or more, of a template to which all are at 0.7 and to each other at 0.6
        one = changed(base, 10)
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join([*one[:-2], f"end{i}"]))]
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=1).collect()}
    vectors = [np.unique(neardup.shingles(neardup.words_of(t), neardup.WordHashes()), return_counts=True) for _, t in rows]
    links = {(a, b) for a in range(len(rows)) for b in range(a) if neardup.weighted_jaccard(vectors[a], vectors[b]) >= 0.8}
    found = sum(got[a] == got[b] for a, b in links)  # nine in ten pairs share the one band
    assert len(links) == 150 and found > 0.8 * len(links) and len(set(got.values())) == 300 - found


def test_rare_edits_of_a_common_text_are_drawn_by_counts(spark):
    r = random.Random(16)
    base = sentence(r, 240).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 201):  # at 0.81 to the first row, whose shingles are common; their own ones are rare
        k = r.randrange(4, 216)
        rows.append((i, " ".join(base[:k] + [f"own{i}x{j}" for j in range(21)] + base[k + 21 :])))
    got = [x["class_id"] for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=4).collect()]
    assert got.count(0) > 0.8 * len(rows)


def test_rare_shingles_find_every_similar_pair(spark):
    r = random.Random(15)
    base = sentence(r, 60).split()
    texts = [" ".join(base[: r.randint(30, 60)] + sentence(r, r.randint(0, 12)).split() + base[:3] * r.randint(0, 4)) for _ in range(80)]
    rows = [(bytes([i]), bytes([i]) if i % 3 else b"x", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "node binary, label binary, text string")
    got = {(bytes(x["a"]), bytes(x["b"])) for x in neardup.rare_pairs(df.select("node", "label"), df.select("node", "text")).collect()}
    vectors = [np.unique(neardup.shingles(neardup.words_of(t), neardup.WordHashes()), return_counts=True) for t in texts]
    near = {(rows[b][0], rows[a][0]) for a in range(80) for b in range(a) if rows[a][1] != rows[b][1] and neardup.weighted_jaccard(vectors[a], vectors[b]) >= 0.8}
    assert len(near) > 10 and near <= got


def weighted_links(rows, least=0.8):
    """Pairs of rows whose damped TF-IDF vectors are similar enough, by comparing all; exact frequencies."""
    def grams(t):
        words = re.findall(r"\w+", t.lower())
        n = min(5, len(words))
        return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))

    counts = [grams(t) for t in rows]
    df, n = Counter(g for c in counts for g in c), len(rows)
    weigh = {g: 1 + neardup.RISE * round(neardup.STEPS * np.log(n / df[g]) / np.log(n)) / neardup.STEPS for g in df}
    own = [{g: k * weigh[g] for g, k in c.items()} for c in counts]
    total = [sum(v.values()) for v in own]
    out = {}
    for a in range(n):
        for b in range(a):
            same = sum(min(v, own[b][g]) for g, v in own[a].items() if g in own[b])
            if same >= (least - 0.01) * (total[a] + total[b] - same):
                out[a, b] = same / (total[a] + total[b] - same)
    return out


def test_recall_on_edited_copies_and_a_template(spark):
    """Copies with few and many edits, of their own texts and of one template that a third of the rows share, against all pairs."""
    r = random.Random(31)
    rows = []
    for kind in range(60):
        base = sentence(r, r.randint(40, 200)).split()
        for k in range(4):
            rows.append(" ".join(w if r.random() > 0.01 * k else sentence(r, 1) for w in base))
    template = sentence(r, 120).split()
    rows += [" ".join(w if r.random() > 0.02 else sentence(r, 1) for w in template) for _ in range(120)]
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    links = weighted_links(rows)
    sure = [p for p, s in links.items() if s >= 0.8]
    assert len(sure) > 300 and sum(got[a] == got[b] for a, b in sure) >= 0.99 * len(sure)
    # no class holds rows that no chain of links joins
    parent = {i: i for i in range(len(rows))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[find(a)] = find(b)
    assert all(find(i) == find(c) for i, c in got.items())


def test_one_row_of_each_class_stays(spark):
    """Ids that several rows share, null ids and repeated rows: removal goes by rows, not by ids."""
    r = random.Random(32)
    b, c, d = (sentence(r, 60) for _ in range(3))
    near = b.split()
    near[30] = "other"
    rows = [(0, b, "en"), (1, b, "en"), (1, c, "en"), (1, " ".join(near), "en"), (None, c, "en"), (None, d, "en"), (None, d, "en"), (None, d, "de"), (7, None, "en"), (7, "", "en"), (7, None, "en"), (None, "!", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = Counter(map(tuple, neardup.one_of_each(df).collect()))
    kept_d = [x for x in got if x[1] == d]
    assert len(kept_d) == 1 and got.pop(kept_d[0]) == 1
    assert got == Counter([(0, b, "en"), (1, c, "en"), (7, None, "en"), (7, None, "en"), (7, "", "en"), (None, "!", None)])
    maps = df.withColumn("m", F.create_map(F.lit("k"), F.col("lang")))
    assert neardup.one_of_each(maps).count() == 7


def test_damped_weights_are_those_of_the_formula(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e"), (3, "a b c d e g"), (4, None)]
    rare = neardup.rarities(spark.createDataFrame(rows, "doc_id long, text string"))
    hashes = neardup.WordHashes()
    first, last = (neardup.weigh(neardup.shingles(w.split(), hashes), rare)[0] for w in ("a b c d e", "b c d e f"))
    assert first == 640 and last == 640 + 64  # of all three texts, and of one


def test_links_in_a_chain_are_one_class(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(200)] + [(b"\xf0", b"\xf1"), (b"\xf1", b"\xf0")], "a binary, b binary").repartition(7)
    got = {bytes(x["node"]): bytes(x["label"]) for x in neardup.components(edges).collect()}
    assert got == {bytes([i]): bytes([0]) for i in range(201)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


def test_samples_agree_as_often_as_weighted_jaccard_says():
    r = np.random.default_rng(3)
    keys = r.integers(0, 2**63, 300).astype(np.uint64)
    a, b = r.uniform(0.5, 5, 300), r.uniform(0.5, 5, 300)
    sampler = neardup.Sampler(4000)
    same = (sampler.sample(keys, a) == sampler.sample(keys, b)).mean()
    assert abs(same - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


# ---- decontamination


def test_leaks_and_reordered_passages(spark, docs, none):
    r = random.Random(20)
    items = [(i, sentence(r, 30)) for i in range(6)] + [(7, None), (8, ""), (9, "two words")]
    w = items[1][1].split()
    texts = [(100, sentence(r, 50) + " " + items[0][1].upper() + " " + sentence(r, 50)), (101, " ".join(w[20:] + ["and", "so"] + w[:10] + ["on"] + w[10:20])), (102, " ".join(items[2][1].split()[:8])), (103, sentence(r, 200)), (104, None), (105, "")]
    df = spark.createDataFrame(texts + texts[:1], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(df, bench)
    assert sorted((x["doc_id"], x["item_id"], x["covered_words"], x["n_tiles"]) for x in got.collect()) == [(100, 0, 30, 1), (100, 0, 30, 1), (101, 1, 30, 3)]
    wide = decontaminate.leaks(df, bench, broadcast_chars=0)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, got.collect()))
    assert sorted(x["doc_id"] for x in decontaminate.clean_documents(df, bench).collect()) == [102, 103, 104, 105]
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_rows_are_judged_by_their_own_text_however_large_the_benchmark(spark):
    r = random.Random(22)
    item = sentence(r, 30)
    rows = [(None, item), (None, sentence(r, 40)), ("a", item), ("a", sentence(r, 40)), ("7", item), ("7", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    expected = Counter(x for x in rows if x[1] != item)
    for most in (0, decontaminate.BROADCAST_CHARS):
        assert Counter(map(tuple, decontaminate.clean_documents(df, bench, broadcast_chars=most).collect())) == expected


def test_tiles_by_brute_force():
    r = random.Random(21)
    for _ in range(200):
        a, b = [r.randint(1, 4) for _ in range(r.randint(0, 30))], [r.randint(1, 4) for _ in range(r.randint(0, 60))]
        found = decontaminate.tiles(a, b, least=3, search=4)
        used_a, used_b = Counter(), Counter()
        for i, t, n in found:
            assert n >= 3 and a[i : i + n] == b[t : t + n]
            used_a.update(range(i, i + n))
            used_b.update(range(t, t + n))
        assert all(v == 1 for v in used_a.values()) and all(v == 1 for v in used_b.values())
        rest = {tuple(a[i : i + 3]) for i in range(len(a) - 2) if not used_a.keys() & set(range(i, i + 3))}
        assert not rest & {tuple(b[i : i + 3]) for i in range(len(b) - 2) if not used_b.keys() & set(range(i, i + 3))}


def brute_tiles(item, text, least=4):
    """Greedy string tiling by comparing every place with every other one, again for each tile."""
    free_i, free_t, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                best = min(best, (-n, i, t))
        n, i, t = -best[0], *best[1:]
        if n < least:
            return out
        free_i[i : i + n] = free_t[t : t + n] = [False] * n
        out.append((i, t, n))


def test_tiles_are_those_of_greedy_tiling():
    r = random.Random(23)
    for k in range(300):
        item = [r.randint(1, 3 + k % 9) for _ in range(r.randint(0, 40))]
        text = [r.randint(1, 3 + k % 9) for _ in range(10)]
        for _ in range(r.randint(0, 4)):
            a = r.randint(0, len(item))
            text += item[a : a + r.randint(1, 25)] + [r.randint(1, 9)]
        assert sorted(decontaminate.tiles(item, text)) == sorted(brute_tiles(item, text)), (item, text)


def test_common_seeds_make_no_pairs_and_lose_none(spark):
    """Phrases that all texts share, items of tiles of the least length, items that repeat a seed: as without the join."""
    r = random.Random(24)
    phrases = [sentence(r, 6) for _ in range(3)]
    items, texts = [], []
    for i in range(30):
        own = [sentence(r, 4) for _ in range(8)]
        items.append((i, " ".join([*own[:4], r.choice(phrases), *own[4:]]) if i % 5 else " ".join(own[:1] * 6)))
        texts.append((i, " and ".join(r.sample([*own, *phrases], 8)) if i % 5 else own[0]))
        texts.append((100 + i, " ".join([sentence(r, 20), *phrases])))
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    near, far = (sorted(map(tuple, decontaminate.leaks(df, bench, broadcast_chars=n).collect())) for n in (10**6, 0))
    assert near == far and len(near) > 10
    assert decontaminate.spare_seeds(27, 24) == 4 and decontaminate.spare_seeds(27, 23) == 0


# ---- sharding


def test_shards_are_merged_and_versions_commit_once(spark, docs, none, tmp_path):
    table = sharding.ShardTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 20)
    for k in range(5):
        table.append(docs.withColumn("k", F.lit(k)))
    before = table.version()
    shards = table.manifest().count()
    assert before == 5 and shards >= 5
    assert table.compact() > before
    assert table.manifest().count() < shards
    assert table.read().count() == 5 * docs.count()
    assert table.read(version=2).count() == 2 * docs.count()
    rows = Counter(map(tuple, table.read().drop("shard", "k").collect()))
    assert rows == Counter({row: 5 * n for row, n in Counter(map(tuple, docs.collect())).items()})
    with pytest.raises(sharding.Conflict):
        table.commit(before, table.manifest())
    assert table.vacuum() >= shards and table.read().count() == 5 * docs.count()
    empty = sharding.shard(none, f"file://{tmp_path}/e")
    assert empty.read(schema=SCHEMA).count() == 0
    whole = sharding.shard(docs, f"file://{tmp_path}/w", target_bytes=1 << 20)
    assert whole.read().count() == docs.count() and whole.read().columns == [*docs.columns, "shard"]


def test_dead_writers_are_passed_by(spark, docs, tmp_path, monkeypatch):
    """A writer died after it took a number: below, or above while another one commits."""
    table = sharding.ShardTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 20, claim_seconds=0.3)
    table.append(docs)
    (tmp_path / "t/manifest/v00000002").touch()
    for _ in range(5):
        table.append(docs)
    assert table.version() == 7 and table.read().count() == 6 * docs.count()
    write, above = sharding.ShardTable._write, [9]

    def dying_above(self, file, name, base):
        if above:
            (tmp_path / f"t/manifest/v{above.pop():08d}").touch()
        write(self, file, name, base)

    monkeypatch.setattr(sharding.ShardTable, "_write", dying_above)
    assert table.append(docs) == 10 and not above  # 8 was written, and 10 settles that it counts
    last = table.compact()
    assert last > 10 and table.read().count() == 7 * docs.count()
    assert table.vacuum() > 0 and table.read().count() == 7 * docs.count() and table.version() == last
    with pytest.raises(ValueError, match="no version"):
        table.read(version=1)


@pytest.mark.parametrize("before", [True, False])
def test_a_writer_that_stalls_loses_no_rows(spark, docs, tmp_path, monkeypatch, before):
    """Others commit, compact and go on while a writer stands between taking its number and writing its line, or before it takes one."""
    table, other = (sharding.ShardTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 20, claim_seconds=0) for _ in range(2))
    for _ in range(3):
        table.append(docs)
    name = "_take" if before else "_write"
    step, stalls = getattr(sharding.ShardTable, name), [True]

    def stalling(self, *args):
        if self is table and stalls:
            stalls.pop()
            for _ in range(2):
                other.append(docs)
            other.compact()
        return step(self, *args)

    monkeypatch.setattr(sharding.ShardTable, name, stalling)
    version = table.append(docs)
    assert not stalls and version == table.version() == other.version()
    assert table.read().count() == 6 * docs.count()
    assert other.compact() >= version and table.read().count() == 6 * docs.count()


def test_only_batches_of_the_version_are_read(spark, docs, tmp_path):
    table = sharding.ShardTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 20)
    table.append(docs)
    (tmp_path / "t/data/batch-orphan").mkdir()
    (tmp_path / "t/data/batch-orphan/part-0.parquet").write_bytes(b"no parquet")
    assert table.read().count() == docs.count() and not any("orphan" in f for f in table.read().inputFiles())


def test_writers_that_race_lose_no_rows(spark, docs, tmp_path, monkeypatch):
    """Another writer commits between any writer's read of the version and its own commit."""
    table = sharding.ShardTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 20)
    for _ in range(3):
        table.append(docs)
    commit, late = sharding.ShardTable.commit, [docs] * 4

    def overtaken(self, base, shards):
        if late and self.version() == base:
            other = late.pop()
            batch = f"batch-other{len(late)}"
            other.write.parquet(f"{self.root}/data/{batch}")
            commit(self, base, self.manifest(base).unionByName(self._listed(batch, base + 1)))
        return commit(self, base, shards)

    monkeypatch.setattr(sharding.ShardTable, "commit", overtaken)
    table.append(docs)
    table.compact()
    assert not late and table.read().count() == 8 * docs.count()
    assert not table.full_tiers()
    # a merge whose shards another merge has replaced is dropped
    for _ in range(4):
        table.append(docs)

    def merged_before(self, base, shards):
        monkeypatch.setattr(sharding.ShardTable, "commit", commit)
        sharding.ShardTable(spark, self.root, self.target_bytes).compact()
        return commit(self, base, shards)

    monkeypatch.setattr(sharding.ShardTable, "commit", merged_before)
    table.compact()
    assert table.read().count() == 12 * docs.count()
    table.vacuum()
    assert table.read().count() == 12 * docs.count()


# ---- html


def test_unclosed_quotes_are_never_text():
    texts = lambda page: [b[0] for b in html.blocks(page)]
    assert texts('<p class="a>first</p><p>second') == ["first", "second"]
    assert texts("<p class=\"a>gone</p><p class=\"b\">second</p>x") == ["second", "x"]
    assert texts("<p title='x>y' id=a\"b>one<br>two</p><script>var a='</p>'</SCRIPT >three") == ["one two", "three"]
    assert texts("a < b <3 <svg x='1'/>c<svg><text>no</text></svg><!-- <p> --><math><mi>x</mi><annotation>no</annotation></math>") == ["a < b <3 cx"]
    assert [texts(p) for p in ('<p a="', "<p", "</p", "<!--", "<script>x", "<")] == [[], [], [], [], [], ["<"]]
    r = random.Random(2)
    for _ in range(300):
        page = "".join(r.choice(["<p class=\"", "\">", "'", "=", "<b x='", "word ", "</p>", "<br/>", "<", ">", "<!--", "-->"]) for _ in range(30))
        html.blocks(page)


def test_broken_pages_take_time_in_proportion():
    import time

    for part in ('<p class="', "<p a='\"", "<script>", "<!--", "<p ", "<svg><annotation>", '="<p', '</p class=">'):
        began = time.time()
        html.blocks(part * (1_000_000 // len(part)))
        assert time.time() - began < 10, part


@pytest.fixture(scope="module")
def field():
    return html.train([html.label_blocks(h, t) for h, t in html.labelled_pages()])


def test_main_text_of_held_out_pages(field):
    pages = html.labelled_pages(200, seed=1234)
    assert np.mean([html.main_text(h, field) == t for h, t in pages]) >= 0.95


def test_viterbi_finds_the_best_labels(field):
    import itertools

    for h, _ in html.labelled_pages(10, seed=3):
        page = html.blocks(h)[:8]
        scores = field.scores(page)

        def value(y, scores=scores):
            return sum(s for s, k in zip(scores, y, strict=True) if k) + sum(field.steps[a, b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=len(page)), key=value)
        assert abs(value(best) - value(field.decode(page))) < 1e-9


def test_pages_of_all_sorts(spark, field):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<article><p>One &amp;&#233;\n\t two<br>three &nbsp; four.</p><aside>no</aside><p>Next</article>"), (None, "u", "<p"), (4, "u", "<article>" + "<p>Long text here, and more of it." * 20000 + "</article>"), (4, "u", "<!-- <article><p>x</p> --><script>if (a<b) {}</script>")]
    df = spark.createDataFrame([(*x, "t") for x in rows], "page_id long, url string, html string, text string")
    got = html.extract(df, field=field).collect()
    assert len(got) == 6 and all(x["n_chars"] == len(x["text"]) for x in got)
    assert [x["text"] for x in got if x["page_id"] == 3] == ["One &é two three four.\n\nNext"]
    assert max(x["n_chars"] for x in got) == 20000 * 31 + 19999 * 2
    assert [x["text"] for x in got if x["page_id"] in (1, 2)] == ["", ""]
    assert html.extract(df.limit(0), field=field).count() == 0


def test_text_around_icons_and_in_formulas_stays():
    def texts(page):
        return [b[0] for b in html.blocks(page)]

    assert texts('<p>An <svg class="i" href="a>b"/> icon stays in line.</p><p>And more.</p>') == ["An icon stays in line.", "And more."]
    assert texts("<p>One <svg/> two <SVG viewBox='0 0 1 1' /> three</p><p>four <svg><title>x</title><path d='M0'/></svg>five</p>") == ["One two three", "four five"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='application/x-tex'>x=2</annotation></math> be given.</p>") == ["Let x=2 be given."]
    assert texts("<p>Let <math><mi>y</mi><annotation/><annotation-xml encoding='a'><ci>y</ci></annotation-xml></math> be, <math><mi>z</mi><annotation>z</math> too.</p><p>End.</p>") == ["Let y be, z too.", "End."]
    assert texts("<p>See <math/> this</p><p>A <object data='a.swf'><param name='a'>chart of sales</object> here</p>") == ["See this", "A chart of sales here"]


# ---- inputs that repeat themselves


def test_equal_rows_take_work_in_proportion(spark):
    r = random.Random(21)
    text = sentence(r, 60)
    lone = sentence(r, 60)
    for n in (1000, 4000):
        df = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("doc_id"), F.lit(text).alias("text")).unionAll(spark.createDataFrame([(1, lone)], "doc_id long, text string"))
        got = suffixes.remove_repeats(df).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
        size = len(text.encode())
        assert {tuple(x) for x in got} == {(7, size, size, 1, n // 2), (None, size, size, 1, n // 2), (1, len(lone.encode()), 0, 0, 1)}
    docs = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    assert suffixes.repeated_spans(docs).count() <= 2000 * 20


def tiles_one_by_one(item, text, open_, least):
    free_i, free_t, out = [True] * len(item), list(open_), []
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = n, i, t
        if best is None:
            return out
        n, i, t = best
        free_i[i : i + n] = free_t[t : t + n] = [False] * n
        out.append((i, t, n))


def test_both_ways_of_tiling_give_the_tiles_of_brute_force():
    r = random.Random(22)
    for _ in range(300):
        k = r.choice([1, 2, 3, 6])
        item, text = [r.randint(1, k) for _ in range(r.randint(0, 25))], [r.randint(1, k) for _ in range(r.randint(0, 45))]
        open_ = [r.random() < 0.9 for _ in text]
        want = tiles_one_by_one(item, text, open_, 4)
        assert decontaminate.tiles(item, text, open_) == want
        assert decontaminate._tiles_by_length(item, text, [True] * len(item), list(open_), 4) == want


@pytest.mark.parametrize("item", [[1] * 200, [1, 2] * 100, [1, 2, 3, 4] * 50])
def test_repeated_words_take_time_in_proportion(item):
    r = random.Random(23)
    for text in ([1] * 200_000, [r.choice([1, 1, 2]) for _ in range(200_000)], [1, 2, 3, 4] * 50_000):
        began = time.time()
        decontaminate.tiles(item, text)
        assert time.time() - began < 20


# ---- pages that are nested deeply or left open


@pytest.mark.parametrize("part", ["<div>", "<div>x ", "<ul><li>x", "<table><tr><td>x", "<div class='c%d'>y"])
def test_deep_pages_take_time_in_proportion(field, part):
    page = "".join(part.replace("%d", str(i)) for i in range(1_000_000 // (len(part) + 3)))
    began = time.time()
    found = html.blocks(page, field.tree())
    field.decode(found)
    assert time.time() - began < 60
    assert len(found) == (0 if part == "<div>" else page.count("x") + page.count("y"))


def test_scores_are_those_of_the_listed_features(field):
    for h, _ in html.labelled_pages(30, seed=11):
        page = html.blocks(h, field.tree())
        want = [sum(field.weights[k, 1] - field.weights[k, 0] for n in html.features(b) if (k := field.names.get(n)) is not None) for b in page]
        assert np.allclose(field.scores(page), want)


def test_elements_that_are_left_open_and_images_in_words():
    def texts(page):
        return [b[0] for b in html.blocks(page)]

    assert texts("<p>one <svg><path d='x'><p>two</p><div>three</div>") == ["one", "two", "three"]
    assert texts("<p>a <svg><g><text>no</text></g></svg>b</p>") == ["a b"]
    assert texts("<select><option>one</select>x<p>y <select><option>q<p>end") == ["x", "y", "q", "end"]
    assert texts("<select><option>1<select><option>2</select>z") == ["z"]
    assert texts("<p>wo<img src='i'>rd a<input>b one<br>two<wbr>three") == ["word ab one twothree"]
    assert texts("<script>if (a) { <p>no</p>") == []


def test_gradient_is_that_of_differences_and_likelihood_that_of_all_labellings():
    import itertools

    pages = [html.label_blocks(h, t) for h, t in html.labelled_pages(4, seed=5)]
    pages = [(b[:6], y[:6]) for b, y in pages] + [([], [])]
    batch, r = html.Batch(pages), np.random.default_rng(4)
    weights, steps = r.normal(0, 0.5, (len(batch.names), 2)), r.normal(0, 0.5, (2, 2))
    value, by_weights, by_steps = batch.gradient(weights, steps)

    def score(b, y):
        return sum(weights[batch.names[n], k] for x, k in zip(b, y, strict=True) for n in html.features(x)) + sum(steps[a, c] for a, c in zip(y, y[1:]))

    want = sum(score(b, y) - np.log(sum(np.exp(score(b, z)) for z in itertools.product((0, 1), repeat=len(b)))) for b, y in pages if b)
    assert abs(value - want) < 1e-8
    for array, gradient in ((weights, by_weights), (steps, by_steps)):
        for at in [np.unravel_index(k, array.shape) for k in r.choice(array.size, min(array.size, 25), replace=False)]:
            kept = array[at]
            array[at] = kept + 1e-5
            up = batch.gradient(weights, steps)[0]
            array[at] = kept - 1e-5
            down = batch.gradient(weights, steps)[0]
            array[at] = kept
            assert abs((up - down) / 2e-5 - gradient[at]) < 1e-5
