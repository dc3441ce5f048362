"""Quality rules: text statistics and robust multivariate outliers.

Statistics of every whole text are made in Arrow batches. Documents that pass
the base rules form groups by language and source; each group gets a
minimum-covariance-determinant estimate (MCD) of location and scatter of a
transformed statistic vector by concentration steps over all its rows, from two
starts; the one that ends with the lesser determinant is reweighted: location and scatter
of all rows within the ``REWEIGHT`` quantile of it. Groups of under ``MIN_GROUP`` rows are judged by the estimate of their language, and if that
has too few rows as well, by that of all rows. A
document whose squared Mahalanobis distance is over the cut is rejected.

A concentration step is one aggregation with partial sums: rows are counted in
fixed bins of their distance, with the moments of each bin, so the nearest
``SUPPORT`` of a group's rows (to the width of a bin) is found without sorting or
gathering any group in one task. Rows of the last bin that is needed all count, so
rows at equal distances are never told apart.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import by_place, cut, pick, store

MIN_WORDS = 20
#: Share of words in repeated windows, in percent, over which the base rules reject.
MAX_REPEAT = 30
REPEAT_WINDOW = 8
#: Share of a group's rows on which the estimate rests.
SUPPORT = 0.75
#: Most concentration steps; they end when no group's determinant falls by more than ``SETTLED`` (of its logarithm).
STEPS = 8
SETTLED = 1e-2
#: Quantile of the distance within which rows count for the final estimate.
REWEIGHT = 0.975
#: Quantile of the chi-squared distribution, of as many degrees as FEATURES, at the cut.
QUANTILE = 0.9999
#: Fewest rows on which an estimate may rest.
MIN_GROUP = 8
#: Groups up to this many are sent to all executors; more are joined by shuffle.
BROADCAST_GROUPS = 10_000

#: Transformed statistics and the least standard deviation assumed of each.
FEATURES = {
    "x0": ("log of the mean length of a word", 0.12),
    "x1": ("root of the share of symbols among the characters of words", 0.05),
    "x2": ("root of the share of duplicate lines", 0.2),
    "x3": ("root of the share of words in repeated windows", 0.2),
}
_DIM = len(FEATURES)
_NAMES = list(FEATURES)
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i, _DIM)]

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines"]
_STATS_TYPE = pa.struct([(n, pa.int64()) for n in STATS])


def repeat_words(words: list[str], window: int = REPEAT_WINDOW) -> int:
    """How many words lie in windows of ``window`` words that the list holds twice or more (exact)."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # names of windows of doubling width; a pair of names has one new name
    names, width = ids, 1
    while width < window:
        step = min(width, window - width)
        pairs = names[: len(names) - step] * (len(ids) + 1) + names[step:]
        _, names, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(pairs):
            return 0  # no two are equal, so no longer ones are
        width += step
    hit = np.flatnonzero(counts[names] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS for one text; null has none of anything."""
    if not text:
        return (0,) * len(STATS)
    words = _WORD.findall(text)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), dup, repeat_words(words), lines


def _stats(texts: pa.Array) -> pa.Array:
    rows = np.array([text_stats(t.as_py()) for t in texts], np.int64).reshape(-1, len(STATS))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATS))], fields=list(_STATS_TYPE))


def stats_of(text: Column | str) -> Column:
    """The STATS of a text. Marked as not deterministic, so that Spark never works them out twice for a filter and what comes after it."""
    made = F.arrow_udf(_stats, returnType="struct<" + ",".join(f"{n}:bigint" for n in STATS) + ">")
    return made.asNondeterministic()(text)


def base_failed(stats: str = "s") -> Column:
    """The rules that need no other documents: too few words, or too many in repeated windows."""
    s = F.col(stats)
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT * s["n_words"])


def features(stats: str = "s") -> list[Column]:
    s, one = F.col(stats), F.lit(1.0)
    return [
        F.log(F.greatest(s["word_chars"], F.lit(1)) / F.greatest(s["n_words"], F.lit(1))).alias("x0"),
        F.sqrt(s["n_symbols"] / F.greatest(s["word_chars"] * one, one)).alias("x1"),
        F.sqrt(s["n_dup_lines"] / F.greatest(s["n_word_lines"] * one, one)).alias("x2"),
        F.sqrt(s["n_repeat_words"] / F.greatest(s["n_words"] * one, one)).alias("x3"),
    ]


def chi2_cdf(x: float, degrees: int) -> float:
    """Of an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, degrees) < p else (low, mid)
    return high


def _scatter(cov: np.ndarray) -> np.ndarray:
    """The least standard deviations are added to the scatter, which keeps it regular."""
    return cov + np.diag([sd**2 for _, sd in FEATURES.values()])


#: Distances are counted in bins of this many to a doubling.
_BINS = 16
_MODEL = "lang string, source string, start int, n bigint, det double, fall double, " + ", ".join(f"m{i} double" for i in range(_DIM)) + ", " + ", ".join(f"q{i}{j} double" for i, j in _PAIRS)
_MODEL_NAMES = [c.split()[0] for c in _MODEL.split(", ")]


def _row(lang, source, start: int, n: int, before: float, mean: np.ndarray, scatter: np.ndarray) -> list:
    """A row of _MODEL: det is the logarithm of the determinant, fall what it has fallen by since ``before``."""
    inverse, det = np.linalg.inv(scatter), float(np.linalg.slogdet(scatter)[1])
    return [lang, source, int(start), int(n), det, before - det, *map(float, mean), *(float(inverse[i, j]) for i, j in _PAIRS)]


def _starts(groups: pd.DataFrame) -> pd.DataFrame:
    """First estimates: medians, with median deviations and with the least standard deviations alone."""
    rows = []
    for g in groups.itertuples(index=False):
        mid = np.array([getattr(g, f"p{i}")[1] for i in range(_DIM)])
        sd = np.array([(getattr(g, f"p{i}")[2] - getattr(g, f"p{i}")[0]) / 1.349 for i in range(_DIM)])
        rows += [_row(g.lang, g.source, k, g.n, math.inf, mid, _scatter(np.diag(first**2))) for k, first in enumerate((sd, 0 * sd))]
    return pd.DataFrame(rows, columns=_MODEL_NAMES)


def _moments(part: pd.DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter from sums; the nearest ``share`` of a normal distribution has its scatter made too small, which is put right."""
    h = int(part["c"].sum())
    mean = np.array([part[f"s{i}"].sum() for i in range(_DIM)]) / h
    cov = np.zeros((_DIM, _DIM))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = part[f"t{i}{j}"].sum() / h - mean[i] * mean[j]
    values, vectors = np.linalg.eigh(cov * (share / chi2_cdf(chi2_quantile(share, _DIM), _DIM + 2) if share < 1 else 1.0))
    return mean, _scatter((vectors * np.clip(values, 0, None)) @ vectors.T)


def _group_of(bins: pd.DataFrame) -> tuple:
    first = bins.iloc[0]
    return (*(None if pd.isna(v) else v for v in (first["lang"], first["source"])), first["start"])


def _concentrate(bins: pd.DataFrame) -> pd.DataFrame:
    """Location and scatter of the nearest rows of one group and start, from its bins' moments."""
    bins = bins.sort_values("bin")
    n = int(bins["c"].sum())
    part = bins.iloc[: int(np.searchsorted(bins["c"].cumsum().to_numpy(), SUPPORT * n)) + 1]
    return pd.DataFrame([_row(*_group_of(bins), n, bins["before"].iloc[0], *_moments(part, int(part["c"].sum()) / n))], columns=_MODEL_NAMES)


def _reweighted(sums: pd.DataFrame) -> pd.DataFrame:
    """The final estimate of one group, from the moments of its rows within the REWEIGHT quantile (near) and beyond it."""
    near = sums[sums["near"]]
    n = int(sums["c"].sum())
    if near.empty:  # not even the nearest row: such an estimate rests on nothing
        near = sums
    return pd.DataFrame([_row(*_group_of(sums), n, math.inf, *_moments(near, REWEIGHT))], columns=_MODEL_NAMES)


def _with_distance(rows: DataFrame, model: DataFrame, few: bool, keep: list[Column]) -> DataFrame:
    """Rows with d2 and n, the rows that their model rests on; both null where the group has no model."""
    m = model.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    if few:
        m = F.broadcast(m)
    both = rows.join(m, rows["__l"].eqNullSafe(m["__lang"]) & rows["__s"].eqNullSafe(m["__source"]), "left")
    diff = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(_NAMES)]
    d2 = F.lit(0.0)
    for i, j in _PAIRS:
        d2 = d2 + diff[i] * diff[j] * F.col(f"q{i}{j}") * (1 if i == j else 2)
    return both.select(*keep, d2.alias("d2"), F.col("n").alias("group_rows"))


def _estimates(vectors: DataFrame) -> tuple[DataFrame, bool]:
    """The estimate of every (__l, __s) of ``vectors``, from its own rows; and whether there are few enough to broadcast."""
    groups = vectors.groupBy(F.col("__l").alias("lang"), F.col("__s").alias("source")).agg(
        F.count("*").alias("n"), *(F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"p{i}") for i, x in enumerate(_NAMES))
    )
    model = cut(groups.mapInPandas(lambda it: map(_starts, it), _MODEL))
    few = model.limit(2 * BROADCAST_GROUPS + 1).count() <= 2 * BROADCAST_GROUPS
    x = [F.col(name) for name in _NAMES]
    sums = [F.count("*").alias("c"), *(F.sum(x[i]).alias(f"s{i}") for i in range(_DIM)), *(F.sum(x[i] * x[j]).alias(f"t{i}{j}") for i, j in _PAIRS)]

    def far(model: DataFrame) -> DataFrame:
        return _with_distance(vectors, model, few, [F.col("__l").alias("lang"), F.col("__s").alias("source"), F.col("start"), F.col("det").alias("before"), *x])

    for _ in range(STEPS):
        nearness = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * _BINS).cast("int")
        bins = far(model).groupBy("lang", "source", "start", "before", nearness.alias("bin")).agg(*sums)
        model = cut(bins.groupBy("lang", "source", "start").applyInPandas(_concentrate, _MODEL))
        if model.filter(F.col("fall") > SETTLED).isEmpty():
            break
    model = model.groupBy("lang", "source").agg(F.min_by(F.struct(*model.columns), F.struct("det", "start")).alias("best")).select("best.*")
    near = (F.col("d2") <= chi2_quantile(REWEIGHT, _DIM)).alias("near")
    return cut(far(model).groupBy("lang", "source", "start", near).agg(*sums).groupBy("lang", "source").applyInPandas(_reweighted, _MODEL)), few


def fit(vectors: DataFrame) -> tuple[DataFrame, bool]:
    """The model by which each (lang, source) is judged: location, inverse scatter and n, the rows that it rests on; and whether there are few enough to broadcast.

    ``vectors`` has lang, source (null is a value of its own) and the FEATURES. A group of under
    MIN_GROUP rows has the model of its language, or else that of all rows.
    """
    vectors = cut(vectors.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), *_NAMES))
    model, few = _estimates(vectors)
    none = F.lit(None).cast("string")
    for wider in (F.col("__l"), none):
        small = model.filter(F.col("n") < MIN_GROUP)
        if small.isEmpty():
            break
        key = F.col("lang") if wider is not none else none
        wanted = small.select(key.alias("__k")).distinct()
        rows = vectors.select(wider.cast("string").alias("__l"), none.alias("__s"), *_NAMES).join(F.broadcast(wanted) if few else wanted, F.col("__l").eqNullSafe(F.col("__k")), "left_semi")
        instead = _estimates(rows)[0].withColumnRenamed("lang", "__k").drop("source")
        small = small.select("lang", "source", key.alias("__key")).join(F.broadcast(instead) if few else instead, F.col("__key").eqNullSafe(F.col("__k")))
        model = cut(model.filter(F.col("n") >= MIN_GROUP).unionByName(small.drop("__key", "__k")))
    return model, few


def _verdict() -> Column:
    """False if the base rules reject; else false if the model rests on enough rows and the distance is over the cut."""
    cutoff = chi2_quantile(QUANTILE, _DIM)
    return ~F.col("base_failed") & ~F.coalesce((F.col("group_rows") >= MIN_GROUP) & (F.col("d2") > cutoff), F.lit(False))


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Every row of ``df`` once: doc_id, the STATS but the last, base_failed, kept, distance.

    Null text: no words, so base_failed. Null lang or source: a group of its own.
    Repeated rows count as often as they occur. Groups under MIN_GROUP rows (of
    those that the base rules pass): judged by their language's rows, or else by all
    rows; if these are fewer too, the base rules alone decide. Empty table: no
    rows. Other columns are not read.
    """
    docs = pick(df, doc_id=doc_id, text=text, lang=lang, source=source)
    rows = cut(docs.select("doc_id", "lang", "source", stats_of("text").alias("s")))
    rows = rows.select(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("s"), base_failed().alias("base_failed"), *features())
    model, few = fit(rows.filter(~F.col("base_failed")))
    rows = rows.withColumnsRenamed({"lang": "__l", "source": "__s"})
    far = _with_distance(rows, model, few, [F.col("doc_id"), F.col("s"), F.col("base_failed")])
    return far.select("doc_id", *(F.col("s")[n].alias(n) for n in STATS[:-1]), "base_failed", _verdict().alias("kept"), F.when(~F.col("base_failed"), F.sqrt("d2")).alias("distance"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's form: the rows of ``docs`` that are kept, with all their columns. Rows that the base rules pass are written once with their statistics, and no text is shuffled."""

    def stage(flat: DataFrame, text: str, lang: str, source: str) -> DataFrame:
        own = flat.columns
        rows = flat.select("*", stats_of(text).alias("s")).filter(~base_failed()).select(*own, F.col(lang).alias("__l"), F.col(source).alias("__s"), *features())
        rows = store(rows, "scored")
        model, few = fit(rows.select(F.col("__l").alias("lang"), F.col("__s").alias("source"), *_NAMES))
        return _with_distance(rows, model, few, [*map(F.col, own), F.lit(False).alias("base_failed")]).filter(_verdict())

    return by_place(docs, stage, "text", "lang", "source")
