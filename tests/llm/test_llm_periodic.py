"""Periodic runs against a search of every period, and their digests against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import pytest

from siltstone.llm import periodic

SCHEMA = "doc_id long, text string, Text string, runs string, collapsed string"


def plain_runs(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and not any(all(words[k] == words[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_digest(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def some_words(r):
    n, k = r.randint(0, 90), r.choice([1, 2, 2, 3, 5, 30])
    words = [r.randint(0, k - 1) for _ in range(n)]
    if n and r.random() < 0.5:
        a = r.randrange(n)
        p = 1 + (n - a) // r.randint(3, 10)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_runs_are_those_of_a_search_of_every_period():
    r = random.Random(5)
    for _ in range(400):
        texts, least = [some_words(r) for _ in range(r.randint(1, 5))], r.choice([2, 5, 12])
        assert [[tuple(x) for x in g.tolist()] for g in periodic.runs_of_texts(texts, least)] == [plain_runs(t, least) for t in texts]


def test_time_grows_with_the_text():
    r = random.Random(6)
    for words in ([0] * 200_000, [i % 70_000 for i in range(200_000)], [r.randint(0, 1) for _ in range(200_000)]):
        began = time.time()
        assert len(periodic.runs_of_texts([words])[0])
        assert time.time() - began < 30


def test_digests_of_all_sorts_of_texts(spark):
    r = random.Random(7)
    texts = [None, "", " \t\n", "one", "a " * 11, "a " * 12, "a " * 13, "a b " * 6, "x y x y\x1cz " * 8, "é ß 日本 \U0001f600 " * 7, "\x0bw\x0cw\rw " * 9, "long words here " * 4000, " ".join(map(str, range(3000)))]
    texts += [" ".join(f"w{x}" for x in some_words(r)) for _ in range(250)]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(4, texts[4], "x", "y", "z")] * 2 + [(None, "a " * 12, "x", "y", "z"), (-3, "b c " * 9, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = periodic.run_digests(periodic.periodic_runs(periodic.with_planted_tails(df))).drop("n_words")
    want = [plain_digest(d, t) for d, t, *_ in rows]
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows) > 10
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_empty_table_and_collapsed_text(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert periodic.run_digests(periodic.periodic_runs(periodic.with_planted_tails(none))).count() == 0
    row = periodic.periodic_runs(spark.createDataFrame([(1, "s " + "a b c " * 5 + "e")], "doc_id long, text string")).first()
    assert (row["collapsed"], row["n_words"]) == ("s a b c e", 17)
    assert [tuple(x) for x in row["runs"]] == [(1, 15, 3)]


@pytest.mark.parametrize("words", [0, 1, 5])
def test_texts_too_short_for_a_run(words):
    assert [len(x) for x in periodic.runs_of_texts([[1] * words, []])] == [0, 0]
