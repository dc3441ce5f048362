"""Toxicity by weak supervision: many voters, a label model of them, a linear classifier on its posteriors.

1. Lexicons of words and of stems (beginnings of words) are mined from a bounded sample
   of labelled rows, in three slices of it and as a whole: terms that toxic rows hold more
   often than the others do, by the log-likelihood ratio.
2. ``VOTERS`` vote on every whole text in one pass: each slice's lexicons, several hits,
   density, public word lists, address, hidden spellings, shouting.
3. A generative model of the votes is fitted by expectation maximization on the counts of
   vote patterns (2**16 at most, so they fit on the driver): a rate of each voter for each
   class, and correlations as a tree: each voter depends on the class and on the voter with
   which it shares most information given the class (Chow and Liu). The label of a sampled row is one
   more voter of a fixed accuracy.
4. A logistic regression on terms, votes and length is trained on the posterior labels of
   a bounded sample, and scores every row.

Labels are read only of rows whose crc32(doc_id) mod 5 is not 0. Language, source and doc_id are no inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import pick, store

#: Labelled rows of each class (about, by a hash of the id) from which lexicons are mined and the classifier is fitted; as many other rows join the latter.
FIT_ROWS = 10_000
#: Most terms of all lexicons.
TERMS = 2048
#: Least log-likelihood ratio and least number of toxic rows of a term, and its least share of toxic ones among the rows that hold it (classes weighed alike).
LEAST_RATIO, LEAST_ROWS, LEAST_SHARE = 12.0, 3, 0.8
#: Lengths of stems.
STEMS = (3, 4, 5, 6, 7)
SLICES = 3
#: Accuracy of a given label.
LABEL_ACCURACY = 0.98
#: What labelled rows weigh in the label model, as a share of all.
ANCHOR = 0.5
#: Rounds of expectation maximization at most, and the change of a posterior at which it ends.
ROUNDS, SETTLED = 60, 1e-4
#: L2 penalty of the classifier.
PENALTY = 1e-4

VOTERS = [
    *(f"words of slice {k}" for k in range(SLICES)), *(f"stems of slice {k}" for k in range(SLICES)), "two mined words", "two mined stems", "mined terms are 1 in 50",
    "list of English words", "list of other words", "address and a listed or mined word", "hidden spelling", "shouting", "three kinds of mined terms", "two listed words",
]

#: Public insults; plain lists of lower-case words.
ENGLISH = frozenset("idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile fool foolish loser losers pathetic worthless scum scumbag trash garbage disgusting clown clowns jerk creep freak pig bastard bitch asshole shit shitty fuck fucking crap cunt whore slut retard retarded vermin filth filthy lowlife coward liar ugly useless".split())
OTHERS = frozenset("idiotin dummkopf dumm blödmann arschloch trottel depp abschaum versager drecksack schwein miststück wichser hurensohn widerlich connard connasse crétin abruti débile imbécile salaud salope ordure minable raté pourriture merde putain idiota imbécil estúpido estúpida tonto tonta basura escoria perdedor patético asqueroso cabrón gilipollas puta mierda cerdo".split())
#: Words that address somebody.
ADDRESS = frozenset("you your youre u ur du dich dir dein deine ihr euch tu toi te vous votre tú te eres usted vos".split())

_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"(?<![a-z0-9])[a-z]*+[0-9@$!*][a-z0-9@$!*]*|(?<![a-z])(?:[a-z][ .\-]){3,}[a-z](?![a-z])")
_LEET = str.maketrans("013457@$!", "oieastasi", " .-")


def _training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def sampled_labels(labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, list[float]]:
    """About ``fit_rows`` training ids of each class, with label and slice, and the numbers of training ids of class 0 and 1. Ids with two different labels are left out."""
    known = pick(labels, doc_id="doc_id", toxic="toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & _training(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("other")).filter("toxic = other").drop("other")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n = [float(sizes.get(k, 0)) for k in (0, 1)]
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, min(1.0, fit_rows / max(n[1], 1))).otherwise(min(1.0, fit_rows / max(n[0], 1)))
    return known.filter(place < share * 1_000_000).withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.lit(SLICES)).cast("int")), n


def terms_of(words: Iterator[str]) -> set[str]:
    """Words as they are, and their stems, which end in a star."""
    out = set(words)
    return out | {f"{w[:k]}*" for w in out for k in STEMS if len(w) > k}


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial numbers of rows that hold a term, by slice and class."""
    held: list[Counter] = [Counter() for _ in range(2 * SLICES)]

    def flush() -> Iterator[pa.RecordBatch]:
        terms = list(set().union(*held))
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in held)], ["term", *(f"c{k}" for k in range(2 * SLICES))])
        for c in held:
            c.clear()

    for batch in batches:
        for text, toxic, part in zip(*(batch.column(i) for i in range(3)), strict=True):
            held[2 * part.as_py() + toxic.as_py()].update(terms_of(_WORD.findall((text.as_py() or "").lower())))
            if sum(map(len, held)) > 1 << 18:
                yield from flush()
    yield from flush()


def ratio(a: Column | float, b: Column | float, n1: float, n0: float) -> Column:
    """Log-likelihood ratio of a term in ``a`` of n1 toxic rows and ``b`` of n0 others, against one rate for both; 0 if not toxic ones hold it more often."""

    def part(k: Column, n: float) -> Column:
        p, q = k / n, (a + b) / (n1 + n0)
        return F.when(k > 0, k * F.log(p / q)).otherwise(0.0) + F.when(k < n, (n - k) * F.log((1 - p) / (1 - q))).otherwise(0.0)

    return F.when(a * n0 > b * n1, 2 * (part(a, n1) + part(b, n0))).otherwise(0.0)


def mined_terms(rows: DataFrame, terms: int = TERMS) -> list[tuple[str, int]]:
    """The ``terms`` terms of the greatest ratio, each with a mask of the slices (bits 0 to 2) in which it is significant by itself.

    ``rows`` has text, toxic and slice, a bounded sample; equal texts of one class count once.
    """
    rows = rows.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text"), F.min("slice").alias("slice")).drop("h").select("text", "toxic", "slice")
    rows = store(rows, "sample")
    size = {(r["slice"], r["toxic"]): float(r["count"]) for r in rows.groupBy("slice", "toxic").count().collect()}
    n = [[size.get((s, k), 0.0) for k in (0, 1)] for s in range(SLICES)]
    n0, n1 = (sum(x[k] for x in n) for k in (0, 1))
    if not n0 or not n1:
        return []
    names = [f"c{k}" for k in range(2 * SLICES)]
    counts = rows.mapInArrow(_mine, "term string, " + ", ".join(f"{c} long" for c in names)).groupBy("term").agg(*(F.sum(c).alias(c) for c in names))
    pos, neg = (sum(F.col(f"c{2 * s + k}") for s in range(SLICES)) for k in (1, 0))

    def good(a: Column, b: Column, m1: float, m0: float, least: float, rows_: int) -> Column:
        return (ratio(a, b, m1, m0) >= least) & (a >= rows_) & (a / m1 >= LEAST_SHARE * (a / m1 + b / m0)) if m1 and m0 else F.lit(False)

    mask = sum(F.when(good(F.col(f"c{2 * s + 1}"), F.col(f"c{2 * s}"), n[s][1], n[s][0], LEAST_RATIO / 2, 2), 1 << s).otherwise(0) for s in range(SLICES))
    counts = counts.filter(pos >= LEAST_ROWS).filter(good(pos, neg, n1, n0, LEAST_RATIO, LEAST_ROWS)).select("term", mask.alias("mask"), ratio(pos, neg, n1, n0).alias("ratio"))
    return [(r["term"], r["mask"]) for r in counts.orderBy(F.desc("ratio"), "term").limit(terms).collect()]


def _hidden(lower: str, listed: frozenset) -> bool:
    """Whether a listed word is written with digits, signs or gaps between its letters."""
    for token in {t.rstrip("!*") for t in set(_HIDDEN.findall(lower))}:
        if token.isalpha() or token.isdigit():
            continue
        if "*" in token:
            shape = re.compile("".join("." if c == "*" else re.escape(c) for c in token))
            if len(token) > 3 and token.count("*") * 2 < len(token) and any(len(w) == len(token) and shape.fullmatch(w) for w in listed):
                return True
        elif token.translate(_LEET) in listed:
            return True
    return False


def _voting(terms: list[tuple[str, int]]):
    known = {t: k for k, (t, _) in enumerate(terms)}
    masks = [m << (SLICES if t.endswith("*") else 0) for t, m in terms]
    stem = [t.endswith("*") for t, _ in terms]
    listed = ENGLISH | OTHERS | {t for t, _ in terms if not t.endswith("*") and len(t) > 3}
    of_word: dict[str, tuple[int, ...]] = {}

    def find(word: str) -> tuple[int, ...]:
        got = of_word.get(word)
        if got is None:
            if len(of_word) > 1 << 18:
                of_word.clear()
            got = of_word[word] = tuple(known[t] for t in terms_of([word]) if t in known)
        return got

    def vote(text: str) -> tuple[int, list[str]]:
        lower = text.lower()
        words = _WORD.findall(lower)
        hits, votes, two, listed_hits, mined, bad = Counter(), 0, [0, 0], [0, 0], 0, set()
        for w, k in Counter(words).items():
            got = find(w)
            for t in got:
                hits[t] += k
                votes |= masks[t]
            if got:
                mined += k
                bad.add(w)
                for s in {stem[t] for t in got}:
                    two[s] += k
            for e, words_ in enumerate((ENGLISH, OTHERS)):
                if w in words_:
                    listed_hits[e] += k
                    bad.add(w)
        kinds = len({terms[t][0] for t in hits if not stem[t]} or {terms[t][0][:4] for t in hits})
        address = bool(bad) and any(w in bad and not ADDRESS.isdisjoint(words[max(0, i - 3) : i]) for i, w in enumerate(words))
        shout = len(words) > 2 and (text != lower and text == text.upper() or text.count("!") * 10 > len(words))
        more = (two[0] > 1, two[1] > 1, mined * 50 >= len(words) > 0, listed_hits[0] > 0, listed_hits[1] > 0, address, _hidden(lower, listed), shout, kinds > 2, sum(listed_hits) > 1)
        votes |= sum(1 << 2 * SLICES + i for i, v in enumerate(more) if v)
        tokens = [f"v{k}" for k in range(len(VOTERS)) if votes >> k & 1] + [f"n{len(words).bit_length()}"]
        for t, k in hits.items():
            tokens += [f"t{t}", f"t{t}+"] if k > 1 else [f"t{t}"]
        return votes, tokens

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [vote(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([v for v, _ in found], pa.int32()), pa.array([t for _, t in found], pa.list_(pa.string()))], ["doc_id", "votes", "tokens"])

    return work


def _vocabulary(n_terms: int) -> list[str]:
    return [f"v{k}" for k in range(len(VOTERS))] + [f"n{k}" for k in range(64)] + [f"t{k}{s}" for k in range(n_terms) for s in ("", "+")]


class LabelModel:
    """A class, and votes that depend on it and, along a tree, on one another.

    ``fit(votes, weight, label)`` takes rows of 0 and 1 with their weights and labels (0, 1, or -1 for none).
    Afterwards: ``prior``, ``rates[y, k]`` (voter k votes given class y), ``parent[k]`` (-1: the root) and
    ``correlation(y)``, the voters' correlations within class y.
    """

    def __init__(self, accuracy: float = LABEL_ACCURACY, anchor: float = ANCHOR, start: float = 0.1):
        self.accuracy, self.anchor, self.start = accuracy, anchor, start

    def _count(self, votes: np.ndarray, weight: np.ndarray, y: np.ndarray) -> None:
        """Tables of all pairs of voters for each class, smoothed by one row that votes as all rows do on average."""
        self.prior = (weight @ y + self.start) / (weight.sum() + 1)

        def table(w: np.ndarray) -> np.ndarray:
            both, one = votes.T @ (votes * w[:, None]), w @ votes
            cells = [[w.sum() - one[:, None] - one[None, :] + both, one[None, :] - both], [one[:, None] - both, both]]
            return np.maximum(np.array(cells), 0).transpose(2, 3, 0, 1)

        mean = (table(weight) + 0.01) / (weight.sum() + 0.04)
        self.pairs = np.stack([(table(weight * share) + mean) / (weight @ share + 1) for share in (1 - y, y)])
        self.rates = np.stack([self.pairs[c].sum(axis=3)[:, 0, 1] for c in (0, 1)])

    def _tree(self) -> None:
        """Parents by a spanning tree of the greatest shared information given the class."""
        k = self.pairs.shape[1]
        shared = np.zeros((k, k))
        for c, p in ((0, 1 - self.prior), (1, self.prior)):
            t = self.pairs[c]
            shared += p * (t * np.log(t / (t.sum(axis=3, keepdims=True) * t.sum(axis=2, keepdims=True)))).sum(axis=(2, 3))
        self.parent, inside = np.full(k, -1), [0]
        while len(inside) < k:
            rest = [j for j in range(k) if j not in inside]
            a, b = max(((i, j) for i in inside for j in rest), key=lambda x: (shared[x], -x[0], -x[1]))
            self.parent[b] = a
            inside.append(b)

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        score = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        v = votes.astype(int)
        for c in (0, 1):
            for k, p in enumerate(self.parent):
                t = self.pairs[c, k, p] if p >= 0 else None
                score[:, c] += np.log(t[v[:, k], v[:, p]] / t.sum(axis=0)[v[:, p]]) if p >= 0 else np.log(np.where(v[:, k] == 1, self.rates[c, k], 1 - self.rates[c, k]))
            score[:, c] += np.where(label < 0, 0.0, np.log(np.where(label == c, self.accuracy, 1 - self.accuracy)))
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))

    def fit(self, votes: np.ndarray, weight: np.ndarray, label: np.ndarray) -> LabelModel:
        votes, weight = votes.astype(float), weight.astype(float)
        given = label >= 0
        if given.any() and (~given).any():  # labelled rows weigh their share, however few they are
            weight = np.where(given, weight * self.anchor / weight[given].sum(), weight * (1 - self.anchor) / weight[~given].sum()) * weight.sum()
        y = np.where(given, np.where(label == 1, self.accuracy, 1 - self.accuracy), np.where(votes.sum(axis=1) > 1, 0.9, 0.02))
        self._count(votes[given], weight[given], y[given]) if len({*label[given].tolist()}) == 2 else self._count(votes, weight, y)
        for _ in range(ROUNDS):
            self._tree()
            before, y = y, self.posterior(votes, label)
            if np.abs(y - before).max() < SETTLED:
                break
            self._count(votes, weight, y)
        return self

    def correlation(self, y: int) -> np.ndarray:
        p = self.rates[y]
        return (self.pairs[y, :, :, 1, 1] - p[:, None] * p[None, :]) / np.sqrt(np.maximum(p * (1 - p), 1e-12)[:, None] * np.maximum(p * (1 - p), 1e-12)[None, :])


def _bits(votes: list[int]) -> np.ndarray:
    return np.array([[v >> k & 1 for k in range(len(VOTERS))] for v in votes]).reshape(-1, len(VOTERS))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, terms: int = TERMS) -> DataFrame:
    """Every row of ``docs`` once: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), votes (mask of ``VOTERS``).

    Null and empty texts get the score of a text without words. Null doc_ids are held out. Equal
    texts get equal scores. Labels that are null or neither 0 nor 1, and ids with two labels, are not
    learned from; without labels of both classes the public lists and patterns alone decide. Empty table: no rows.
    Columns other than doc_id, text and the labels' doc_id and toxic are not read.
    """
    spark = docs.sparkSession
    docs = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known, n = sampled_labels(labels, fit_rows)
    known = F.broadcast(store(known.withColumn("doc_id", F.col("doc_id").cast("long")), "known"))  # about 2 * fit_rows ids at most
    lexicon = mined_terms(docs.join(known, "doc_id").select("text", "toxic", "slice"), terms)
    voted = store(docs.mapInArrow(_voting(lexicon), "doc_id long, votes int, tokens array<string>").withColumn("held_out", ~_training(F.col("doc_id"))), "votes")
    marked = voted.join(known.select("doc_id", "toxic"), "doc_id", "left").withColumn("label", F.coalesce("toxic", F.lit(-1)))
    patterns = marked.groupBy("votes", "label").agg(F.count("*").alias("n"), F.sum(F.when(~F.col("held_out"), 1).otherwise(0)).alias("training")).orderBy("votes", "label").collect()  # at most 3 * 2**16 rows
    if not patterns:
        return voted.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), "votes")
    label = np.array([r["label"] for r in patterns])
    bits, weight = _bits([r["votes"] for r in patterns]), np.array([float(r["n"]) for r in patterns])
    for k in (0, 1):  # the sample's classes weigh what they do among all training labels
        weight[label == k] *= n[k] / max(weight[label == k].sum(), 1)
    posterior = LabelModel().fit(bits, weight, label).posterior(bits, label)
    sampled = {k: max(1, sum(r["training"] for r in patterns if r["label"] == k)) for k in (-1, 0, 1)}
    rows = [(r["votes"], r["label"], float(p), n[r["label"]] / sampled[r["label"]] if r["label"] >= 0 else 1.0) for r, p in zip(patterns, posterior, strict=True)]
    soft = F.broadcast(spark.createDataFrame(rows, "votes int, label int, posterior double, weight double"))
    some = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < 1_000_000 * min(1.0, fit_rows / sampled[-1])
    train = marked.filter(~F.col("held_out") & ((F.col("label") >= 0) | some)).join(soft, ["votes", "label"])
    train = train.select("tokens", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), (F.col("posterior") * F.col("weight")).alias("w")), F.struct(F.lit(0.0).alias("y"), ((1 - F.col("posterior")) * F.col("weight")).alias("w")))).alias("x"))
    vector = CountVectorizerModel.from_vocabulary(_vocabulary(len(lexicon)), "tokens", "features")
    vector.setBinary(True)
    train = vector.transform(store(train.select("tokens", "x.*").filter("w > 1e-4"), "train"))
    if not train.head(1):  # only held-out rows: the voters' posteriors stand
        scored = marked.join(soft, ["votes", "label"]).withColumn("score", F.col("posterior"))
    else:
        fitted = LogisticRegression(labelCol="y", weightCol="w", featuresCol="features", regParam=PENALTY, standardization=False, maxIter=100).fit(train)
        scored = fitted.transform(vector.transform(voted)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "votes")
