"""Toxicity: the label model against enumeration and known rates, mined terms against counting, held-out accuracy."""

from __future__ import annotations

import itertools
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from siltstone.llm import toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, TEXT string, lang string, tokens string, votes string, label int, held_out int"
LABELS = "doc_id long, toxic int, quality int, label string"


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def made(n=600, seed=2):
    """Texts of made-up words; toxic ones hold two words of two stems that occur nowhere else."""
    r = random.Random(seed)
    words = ["".join(r.choice("abdegiklmnorstu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.2
        text = r.choices(words, k=r.randint(5, 60))
        for _ in range(2 * toxic):
            text.insert(r.randrange(len(text)), r.choice(["qazw", "qoxel"]) + r.choice(["a", "er", "ung", "os", "it"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def frame(spark, docs, labels):
    return spark.createDataFrame([(*x, "x", "en", "t", "v", 1, 0) for x in docs], DOCS).repartition(3), spark.createDataFrame([(*x, 1, "l") for x in labels], LABELS)


def test_label_model_finds_rates_and_correlations():
    r = np.random.default_rng(1)
    y = r.random(60_000) < 0.15
    on = lambda p: r.random(len(y)) < p
    v = np.stack([np.where(y, on(0.8), on(0.05)), np.where(y, on(0.6), on(0.1)), np.where(y, on(0.7), on(0.02)), np.where(y, on(0.5), on(0.3))], axis=1)
    copy = np.where(on(0.9), v[:, 3], on(0.4))  # of the weak voter, whatever the class
    v = np.column_stack([v, copy]).astype(int)
    label = np.where(r.random(len(y)) < 0.02, y.astype(int), -1)
    model = toxicity.LabelModel().fit(v, np.ones(len(y)), label)
    assert abs(model.prior - 0.15) < 0.02
    assert np.abs(model.rates - np.stack([v[~y].mean(axis=0), v[y].mean(axis=0)])).max() < 0.05
    assert model.parent[4] == 3 or model.parent[3] == 4
    assert model.correlation(0)[3, 4] > 0.7 and abs(model.correlation(0)[0, 1]) < 0.05
    # the copied weak voter counts once: with both votes the odds are about those of one
    both, one = (model.posterior(np.array([x]), np.array([-1]))[0] for x in ([0, 0, 0, 1, 1], [0, 0, 0, 1, 0]))
    assert abs(both - one) < 0.05


def test_posteriors_are_those_of_enumeration():
    r = np.random.default_rng(3)
    v = (r.random((500, 4)) < 0.4).astype(int)
    model = toxicity.LabelModel().fit(v, np.ones(500), np.where(r.random(500) < 0.3, v[:, 0], -1))
    joint = {}
    for y, x in itertools.product((0, 1), itertools.product((0, 1), repeat=4)):
        p = (1 - model.prior, model.prior)[y]
        for k, a in enumerate(model.parent):
            t = model.pairs[y, k, a] if a >= 0 else None
            p *= t[x[k], x[a]] / (t[0, x[a]] + t[1, x[a]]) if a >= 0 else (1 - model.rates[y, k], model.rates[y, k])[x[k]]
        joint[y, x] = p
    assert abs(sum(joint.values()) - 1) < 1e-6
    for x in itertools.product((0, 1), repeat=4):
        got = model.posterior(np.array([x] * 2), np.array([-1, 1]))
        assert abs(got[0] - joint[1, x] / (joint[0, x] + joint[1, x])) < 1e-9
        a, b = joint[1, x] * model.accuracy, joint[0, x] * (1 - model.accuracy)
        assert abs(got[1] - a / (a + b)) < 1e-9


def test_mined_terms_are_those_of_counting(spark):
    docs, labels = made()
    rows = [(t, y, i % 3) for (i, t), (_, y) in zip(docs, labels, strict=True)]
    rows += rows[:50]  # equal texts count once
    got = dict(toxicity.mined_terms(spark.createDataFrame(rows, "text string, toxic int, slice int"), 50))
    held = defaultdict(lambda: [0, 0])
    for text, y, _ in rows[: len(docs)]:
        for t in toxicity.terms_of(text.split()):
            held[t][y] += 1
    n1 = sum(y for _, y in labels)
    n0 = len(labels) - n1

    def ratio(b, a):
        part = lambda k, n: (k * np.log(k / n / ((a + b) / (n1 + n0))) if k else 0) + ((n - k) * np.log((1 - k / n) / (1 - (a + b) / (n1 + n0))) if k < n else 0)
        return 2 * (part(a, n1) + part(b, n0)) if a * n0 > b * n1 else 0

    want = sorted(((-ratio(b, a), t) for t, (b, a) in held.items() if a >= toxicity.LEAST_ROWS and ratio(b, a) >= toxicity.LEAST_RATIO and a / n1 >= toxicity.LEAST_SHARE * (a / n1 + b / n0)))[:50]
    assert sorted(got) == sorted(t for _, t in want)
    assert {"qaz*", "qazw*", "qox*", "qoxe*", "qoxel*"} <= set(got) and got["qaz*"] == 7


def test_scores_of_all_sorts_of_rows(spark):
    docs, labels = made()
    docs += [(1001, None), (1002, ""), (1003, " \n"), (1004, "qazwer qoxelos " + "plain " * 30000), (None, "qazwer qoxelos here"), (None, None), docs[5], docs[5], (1005, "you are an id1ot and a m*ron, you i d i o t")]
    labels += [(None, 1), (3, None), (4, 7), (7, 0), (7, 1), (99999, 1)]
    out = toxicity.score(*frame(spark, docs, labels))
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == held_out(r["doc_id"]) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["score"])
    assert len({by[k][0] for k in (1001, 1002, 1003)}) == 1 and by[1001][0] < 0.2
    assert len(set(by[docs[5][0]])) == 1 and len(by[docs[5][0]]) == 3
    assert by[1004][0] > 0.5 and max(by[None]) > 0.5
    truth = dict(made()[1])
    wrong = [k for k, y in truth.items() if held_out(k) and (by[k][0] >= 0.5) != y]
    assert len(wrong) <= 2


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = made(300)
    turned = [(k, 1 - y if held_out(k) else y) for k, y in labels]
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(*frame(spark, docs, x)).collect()} for x in (labels, turned))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_without_labels_and_without_rows(spark):
    docs = [(i, t) for i, t in enumerate(["you stupid idiot", "nice day", "what a moron, pathetic", "the sea", "a tree"] * 20)]
    got = toxicity.score(*frame(spark, docs, [])).collect()
    toxic, clean = ([r["score"] for r in got if r["doc_id"] % 5 in ks] for ks in ((0, 2), (1, 3, 4)))
    assert min(toxic) > max(clean)
    empty = toxicity.score(*frame(spark, [], []))
    assert empty.count() == 0 and empty.columns[:4] == ["doc_id", "held_out", "score", "predicted"]


def test_hidden_spellings():
    listed = toxicity.ENGLISH
    assert all(toxicity._hidden(x, listed) for x in ("id1ot", "an 1diot here", "m0r0n!", "st*pid", "@sshole", "i d i o t", "l-o-s-e-r now"))
    assert not any(toxicity._hidden(x, listed) for x in ("idiot", "a b c d", "m1", "the*** and", "1 2 3", "", "t*****d", "h2o"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    right = np.mean([r["predicted"] == r["toxic"] for r in rows])
    assert right >= 0.93
