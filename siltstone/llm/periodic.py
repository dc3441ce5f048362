"""Periodic runs of words, by branching tandem repeats in a suffix tree.

A run is a stretch of words that are equal a period apart, at least ``MIN_LENGTH``
words and two periods long, and as long as it can be. Within each text:

1. Every word of a run stands in a window of ``MIN_LENGTH // 2`` words that the text
   holds twice: the run without its last period and without its first cover it all.
   Stretches of other words are left out by the windows' hashes; a collision only
   keeps a stretch that is not needed.
2. A suffix tree over the stretches, with a separator of its own after each: suffixes
   are sorted by doubling, neighbours' common prefixes give the inner nodes.
3. At a node of depth d, the leaves of all children but the largest are looked at
   (each leaf at most log n times): a leaf i with i + d or i - d below the same node
   and another word behind it is a branching tandem repeat (Stoye and Gusfield).
4. A repeat that ends a run is rotated to the left as long as the words agree. At each
   end, repeats of multiples of a period that are found in its run are merged into it.

Work is split by rows; a task holds the words of ``GROUP`` words of texts, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import pick

#: Fewest words of a run.
MIN_LENGTH = 12
#: Words of texts that are worked on together.
GROUP = 1 << 17

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def repeated_stretches(words: np.ndarray, owner: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches (first, end) of places covered by windows of ``width`` words that their text, of number ``owner``, holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return []
    with np.errstate(over="ignore"):
        mixed, h = _mixed(words.astype(_U) + _ODD), np.zeros(n, _U)
        for k in range(width):
            h = h * _ODD + mixed[k : k + n]
        h += _mixed(owner[:n].astype(_U) * _ODD)
    inside = owner[:n] == owner[width - 1 :]
    h = h[inside]
    sorted_ = np.sort(h)
    twice = np.unique(sorted_[1:][sorted_[1:] == sorted_[:-1]])
    if not len(twice):
        return []
    at = np.flatnonzero(inside)[twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    covered = np.cumsum(edge)[:-1] > 0
    starts = covered.copy()
    starts[1:] &= ~covered[:-1] | (owner[1:] != owner[:-1])
    ends = covered.copy()
    ends[:-1] &= ~covered[1:] | (owner[1:] != owner[:-1])
    return list(zip(np.flatnonzero(starts).tolist(), (np.flatnonzero(ends) + 1).tolist(), strict=True))


def suffix_order(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``s`` and each one's rank, by doubling."""
    n, k = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        if k < n:
            second[:-k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if k >= n or rank[order[-1]] == n - 1:
            return order, rank
        k *= 2


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """Length of the common prefix of each suffix, by rank, and the one before it."""
    text, before, place = [*s.tolist(), -1], order.tolist(), rank.tolist()
    n, h, out = len(before), 0, [0] * len(before)
    for i, r in enumerate(place):
        if r:
            j = before[r - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


class SuffixTree:
    """Inner nodes of the suffix tree: depth, first and last rank below, parent; and the parent of each leaf, by rank. Node 0 is the root."""

    def __init__(self, s: np.ndarray):
        self.s = s
        self.order, self.rank = suffix_order(s)
        common = common_prefixes(s, self.order, self.rank)
        n = len(s)
        depth, first, last, parent, leaf, open_ = [0], [0], [n - 1], [0], [0] * n, [0]
        for r in range(1, n + 1):
            here = common[r] if r < n else 0
            top, left, orphan = open_[-1], r - 1, -1
            leaf[r - 1] = top
            while depth[open_[-1]] > here:
                v = open_.pop()
                last[v], left, orphan = r - 1, first[v], -1
                if depth[open_[-1]] >= here:
                    parent[v] = open_[-1]
                else:
                    orphan = v
            if depth[open_[-1]] < here:
                new = len(depth)
                depth.append(here), first.append(left), last.append(n - 1), parent.append(open_[-1])
                if orphan >= 0:
                    parent[orphan] = new
                if depth[top] < here:
                    leaf[r - 1] = new
                open_.append(new)
        self.depth, self.first, self.last, self.parent, self.leaf = (np.array(x, np.int64) for x in (depth, first, last, parent, leaf))

    def _path_tops(self) -> np.ndarray:
        """For each node the topmost one from which a way of largest children leads to it."""
        size, nodes = self.last - self.first, np.arange(len(self.depth))
        by = np.lexsort((size, self.parent))
        by = by[by != 0]
        largest = by[np.append(self.parent[by][1:] != self.parent[by][:-1], True)] if len(by) else by
        up = nodes.copy()
        up[largest] = self.parent[largest]
        while True:
            further = up[up]
            if (further == up).all():
                return up
            up = further

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and period of every tandem repeat whose next word differs from the one a period before."""
        n, tops = len(self.s), self._path_tops()
        text = np.append(self.s, -1)
        place, node, found = self.order, self.leaf, []
        while True:
            live = self.depth[node] > 0
            if not live.any():
                break
            place, node = place[live], node[live]
            d, lo, hi = self.depth[node], self.first[node], self.last[node]
            for start, other in ((place, place + d), (place - d, place - d)):
                ok = np.flatnonzero((other >= 0) & (other < n))
                ok = ok[(self.rank[other[ok]] >= lo[ok]) & (self.rank[other[ok]] <= hi[ok])]
                i, by = start[ok], d[ok]
                end = text[i + 2 * by] != text[i + by]
                found.append(np.stack([i[end], by[end]]))
            node = self.parent[tops[node]]
        starts, periods = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        return starts, periods


def _rotated(s: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The leftmost start to which each repeat can be rotated."""
    start = start.copy()
    live = np.arange(len(start))
    for _ in range(16):
        live = live[start[live] > 0]
        live = live[s[start[live] - 1] == s[start[live] - 1 + period[live]]]
        start[live] -= 1
    for k in live.tolist():
        i, d, step = int(start[k]), int(period[k]), 64
        while i > 0:
            a = max(0, i - step)
            differ = np.flatnonzero(s[a:i] != s[a + d : i + d])
            if len(differ):
                i = a + int(differ[-1]) + 1
                break
            i, step = a, step * 2
        start[k] = i
    return start


def find_runs(s: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows of start, length and smallest period of every maximal run of ``s``, by start and period."""
    if len(s) < 2:
        return np.zeros((0, 3), np.int64)
    start, period = SuffixTree(s).branching_repeats()
    end, out = start + 2 * period, []
    by = np.lexsort((period, end))
    start, period, end = start[by], period[by], end[by]
    while len(end):
        ends, at = np.unique(end, return_index=True)  # the smallest period left of each end
        left = _rotated(s, start[at], period[at])
        length = ends - left
        out.append(np.stack([left, length, period[at]], axis=1)[length >= min_length])
        rest = 2 * period > length[np.searchsorted(ends, end)]  # the others are multiples of a period found
        start, period, end = start[rest], period[rest], end[rest]
    runs = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of_texts(texts: list[list], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """For each list of words its runs, as :func:`find_runs` gives them."""
    known: dict = {}
    words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner, begins = np.repeat(np.arange(len(texts)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    parts = repeated_stretches(words, owner, max(1, min_length // 2))
    if not parts:
        return out
    pieces, offsets, at = [], [], 0
    for k, (a, b) in enumerate(parts):
        pieces += [words[a:b], [len(known) + k]]
        offsets.append(at)
        at += b - a + 1
    runs = find_runs(np.concatenate(pieces).astype(np.int64), min_length)
    part = np.searchsorted(offsets, runs[:, 0], "right") - 1
    first = np.array([a for a, _ in parts])[part]
    texts_of = owner[first]
    runs[:, 0] += first - np.array(offsets)[part] - begins[texts_of]
    cuts = np.searchsorted(texts_of, np.arange(len(texts) + 1))
    for t in np.unique(texts_of).tolist():
        out[t] = runs[cuts[t] : cuts[t + 1]]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
    return b" ".join(words)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_MADE = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _finder(min_length: int):
    def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of_texts(texts, min_length)
        sizes = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
        flat = np.concatenate(found)
        runs = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUNS.value_type)))
        kept = pa.array([collapse(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), runs, kept], ["doc_id", "n_words", "runs", "collapsed"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()  # of bytes: at the six ASCII blanks alone
                ids.append(doc.as_py()), texts.append(words)
                held += len(words)
                if held >= GROUP or len(texts) >= 10_000:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
        if texts:
            yield flush(ids, texts)

    return find


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """Every row of ``df`` once: doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed (text without repeats).

    Words are parted by space, tab, line feed, vertical tab, form feed and carriage
    return. Null and empty texts have no words, no runs and an empty collapsed text.
    Repeated rows are worked on one by one, each alone; nothing is compared across
    rows. Empty table: no rows. Null doc_id stays. Other columns are not read.
    """
    docs = pick(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return docs.mapInArrow(_finder(min_length), _MADE)


def with_planted_tails(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, where the words of every tenth text, by the checksum h of its doc_id, repeat from a word on.

    With g = h div 10, word i from a = g mod n on becomes word a + (i - a) mod p,
    p = 1 + (n - a) div (3 + g mod 8). Texts without words and null doc_ids stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    docs = pick(df, doc_id=doc_id, text=text).withColumn("__h", h).withColumn("__w", F.when(F.col("__h") % 10 == 0, words))
    docs = docs.withColumn("__n", F.size("__w").cast("long")).withColumn("__g", F.expr("__h div 10"))
    docs = docs.withColumn("__a", F.expr("CASE WHEN __n > 0 THEN __g % __n END")).withColumn("__p", F.expr("1 + (__n - __a) div (3 + __g % 8)"))

    def planted(w: Column, i: Column) -> Column:
        return F.when(i < F.col("__a"), w).otherwise(F.get(F.col("__w"), (F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int")))

    return docs.select("doc_id", F.when(F.col("__a").isNotNull(), F.array_join(F.transform("__w", planted), " ")).otherwise(F.col("text")).alias("text"))


def run_digests(runs: DataFrame) -> DataFrame:
    """Digests of :func:`periodic_runs`: counts, the longest run (ties: smallest start, then period; null without a run), hashes."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return runs.withColumn("__l", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("__l.start")).alias("start"),
        F.col("__l.length").alias("length"),
        (-F.col("__l.period")).alias("period"),
        F.expr("1000 * __l.length div -__l.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
