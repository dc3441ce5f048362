"""The divergence audit against plain Python integers, on one tile and on many."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, Lang string, groups int, term string, n int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows, min_docs=10, top=10):
    uses, docs, out = defaultdict(Counter), defaultdict(Counter), []
    for _, text, lang, source, *_ in rows:
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        uses[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    for lang in {g for g, _ in uses}:
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        sources = [s for g, s in uses if g == lang]

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        p = {s: share(uses[lang, s]) for s in sources}
        q = share(sum((uses[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def some_rows():
    r = random.Random(3)
    words = [f"{a}{b}" for a in "abcdeéß日" for b in "xyzäQ"] + ["it's", "a-b", "\U0001f600", "É", "É", "x1y", "Ab\x00Cd"]
    rows = []
    for i in range(400):
        lang, source = r.choice(["en", "en", "de", None, ""]), r.choice(["s1", "s2", "S2", "é", "\U0001f600", "￮", None])
        rows.append((i, " ".join(r.choices(words, range(1, len(words) + 1), k=r.randint(0, 40))), lang, source))
    rows += [(1000, None, "en", "empty"), (1001, "", "fr", "a"), (1002, None, "fr", "b"), (1003, "rare words", "fr", "c"), (1004, "alone", "one", "s"), rows[5], rows[5]]
    return [(*x, "l", 1, "t", 2) for x in rows]


@pytest.mark.parametrize(("cells", "pairs"), [(divergence.CELLS, divergence.PAIRS), (30, divergence.PAIRS), (60, 9)])
def test_audit_is_that_of_plain_integers(spark, cells, pairs):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = divergence.audit(df, cells=cells, pairs=pairs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows)


def test_equal_values_rank_by_bytes_and_lists_are_cut(spark):
    rows = [(i, f"t{i % 15} u{i % 15} same", "en", f"s{i % 3}", "l", 1, "t", 2) for i in range(300)]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), top=4, cells=12)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, top=4)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tables_of_counts_are_passed_on_when_they_are_full(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "_ENTRIES", 7)
    rows = some_rows()
    batch = pa.record_batch([pa.array([x[k] or "" for x in rows], t) for k, t in ((2, pa.string()), (3, pa.string()), (1, pa.binary()))], ["lang", "source", "text"])
    n, docs = Counter(), Counter()
    for out in divergence._count(iter([batch])):
        assert out.num_rows < 60
        for x in out.to_pylist():
            n[x["lang"], x["source"], x["term"]] += x["n"]
            docs[x["lang"], x["term"]] += x["docs"]
    want, of = Counter(), Counter()
    for x in rows:
        terms = [t.decode() for t in divergence.terms_of((x[1] or "").encode())]
        want.update((x[2] or "", x[3] or "", t) for t in terms)
        of.update((x[2] or "", t) for t in set(terms))
    assert (n, docs) == (want, of)


def test_scaling_is_exact_for_very_large_counts():
    r = random.Random(1)
    for _ in range(2000):
        total = r.randint(1, 9 * 10**15)
        count = r.randint(0, total)
        assert divergence.scaled(np.array([count]), total)[0] == 1 + 10**9 * count // total
    assert divergence.divergence(np.array([1 + 10**9]), np.array([1]))[0] == 10**18 // (10**9 + 2)
