"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on seeds, runs of ``TILE`` words that
both hold. Each joined pair is tiled: the longest common runs of words that no
tile covers yet are marked again and again, found by running Karp-Rabin hashing
of a search length that falls to ``TILE``. Tiles may lie in any order, so reordered
passages count. An item whose words are covered to ``COVERAGE`` or more is in the document.

The benchmark is sent to all executors if its texts are under ``BROADCAST_CHARS``
in all, which is counted first; a larger one is joined on seeds by shuffle. There each item
leaves out as many of its commonest seeds as any text that covers it holds beside another one,
so that phrases of most texts make no pairs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.llm._common import by_place, cut, pick, store

TILE = 4
COVERAGE = 0.6
BROADCAST_CHARS = 1_000_000
#: Search length at which tiling begins.
FIRST_SEARCH = 20
#: Pairs of places of equal windows, for each word of item and text, from which on tiles are found length by length.
MANY = 4
_ODD = 0x9E3779B97F4A7C15
_WORD = re.compile(r"\w+")
_MOD, _BASE = (1 << 61) - 1, 1_000_003


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _windows(ids: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Rolling hash and start of each window of ``length`` words that are all free."""
    drop = pow(_BASE, length, _MOD)
    h = n = 0
    for i, x in enumerate(ids):
        if not free[i]:
            h = n = 0
            continue
        h, n = (h * _BASE + x + 1) % _MOD, n + 1
        if n > length:
            h, n = (h - (ids[i - length] + 1) * drop) % _MOD, length
        if n == length:
            yield h, i - length + 1


class _Rolling:
    """Hashes of all windows of one sequence, for any length, and which of them are free."""

    def __init__(self, ids: list[int], free: list[bool]):
        self.ids, self.free = np.array(ids, np.int64), np.array(free, bool)
        n = len(self.ids)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.append(np.uint64(1), np.full(n, _ODD, np.uint64)), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n, pow(_ODD, -1, 2**64), np.uint64)), dtype=np.uint64)
            mixed = (self.ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            self.sums = np.append(np.uint64(0), np.cumsum(mixed * self.up[:-1], dtype=np.uint64))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of free words, and their hashes."""
        n = len(self.ids) - length + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.append(0, np.cumsum(~self.free))
        at = np.flatnonzero(taken[length:] == taken[:-length])
        with np.errstate(over="ignore"):
            return at, (self.sums[at + length] - self.sums[at]) * self.down[at]

    def holds(self, at: int, length: int) -> bool:
        return bool(self.free[at : at + length].all())


def _tiles_by_length(item: list[int], text: list[int], free_i: list[bool], free_t: list[bool], least: int) -> list[tuple[int, int, int]]:
    """The same tiles where a phrase stands in very many places: the greatest length of a common window is searched by halves, and all tiles of
    that length are marked at once, so work grows with item and text and not with their pairs of places."""
    a, b, found = _Rolling(item, free_i), _Rolling(text, free_t), []

    def common(length: int) -> bool:
        return bool(np.isin(a.windows(length)[1], b.windows(length)[1]).any())

    high = min(len(item), len(text))
    while high >= least and common(least):
        low, top = least, high
        while low < top:
            middle = (low + top + 1) // 2
            low, top = (middle, top) if common(middle) else (low, middle - 1)
        starts, hashes = b.windows(low)
        own = a.windows(low)
        wanted = np.isin(hashes, own[1])
        order = np.argsort(hashes[wanted], kind="stable")
        places, sorted_ = starts[wanted][order], hashes[wanted][order]
        next_: dict[int, int] = {}
        for i, h in zip(own[0].tolist(), own[1].tolist(), strict=True):
            first, end = np.searchsorted(sorted_, np.uint64(h), "left"), np.searchsorted(sorted_, np.uint64(h), "right")
            k = next_.get(h, int(first))
            if not a.holds(i, low):
                continue
            while k < end:
                t = int(places[k])
                k += 1
                if b.holds(t, low) and (a.ids[i : i + low] == b.ids[t : t + low]).all():
                    a.free[i : i + low] = b.free[t : t + low] = False
                    found.append((i, t, low))
                    break
            next_[h] = k
        high = low - 1
    return found


def tiles(item: list[int], text: list[int], open_: list[bool] | None = None, least: int = TILE, search: int = FIRST_SEARCH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length); ``open_`` are the words of text that a tile may cover. Of equally long ones the first in the item, then in the text, is marked first."""
    free_i, free_t = [True] * len(item), list(open_) if open_ is not None else [True] * len(text)
    found: list[tuple[int, int, int]] = []
    length = max(least, min(search, len(item)))
    places = Counter(h for h, _ in _windows(text, free_t, least))
    if sum(places[h] for h, _ in _windows(item, free_i, least)) > MANY * (len(item) + len(text)):
        return _tiles_by_length(item, text, free_i, free_t, least)
    while True:
        table: dict[int, list[int]] = {}
        for h, t in _windows(text, free_t, length):
            table.setdefault(h, []).append(t)
        matches: list[tuple[int, int, int]] = []
        for h, i in _windows(item, free_i, length):
            for t in table.get(h, ()):
                if item[i : i + length] != text[t : t + length]:
                    continue
                n = length
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                matches.append((n, i, t))
        longest = max((m[0] for m in matches), default=0)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-n, i, t) for n, i, t in matches]
        heapify(queue)
        while queue:
            n, i, t = heappop(queue)
            both = [a and b for a, b in zip(free_i[i : i - n], free_t[t : t - n], strict=True)]
            if all(both):
                free_i[i : i - n] = free_t[t : t - n] = [False] * -n
                found.append((i, t, -n))
                continue
            begin = 0  # what earlier tiles leave of it waits for its turn
            for k, free in enumerate([*both, False]):
                if not free:
                    if k - begin >= length:
                        heappush(queue, (begin - k, i + begin, t + begin))
                    begin = k + 1
        if length > 2 * least:
            length //= 2
        elif length > least:
            length = least
        else:
            return found


class Items:
    """The benchmark's items by their seeds."""

    def __init__(self, rows: list[tuple[int, str | None]], tile: int = TILE):
        self.tile = tile
        self.number: dict[str, int] = {}
        self.items = [(i, [self.number.setdefault(w, len(self.number) + 1) for w in words_of(t)]) for i, t in rows]
        self.seeds: dict[int, list[int]] = {}
        for k, (_, ids) in enumerate(self.items):
            for seed in dict.fromkeys(self._seeds(np.array(ids, np.int64)).tolist()):
                self.seeds.setdefault(seed, []).append(k)
        self.sorted = np.array(sorted(self.seeds), np.int64)

    def _seeds(self, ids: np.ndarray) -> np.ndarray:
        n = max(0, len(ids) - self.tile + 1)
        out = np.zeros(n, np.int64)
        with np.errstate(over="ignore"):
            for k in range(self.tile):
                out = out * np.int64(6364136223846793005) + ids[k : k + n]
        return out

    def pairs(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, words, words covered, tiles) of the items that share a seed with the text."""
        if not text or not len(self.sorted):
            return []
        words = words_of(text)
        ids = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        known = np.append(0, np.cumsum(ids > 0))
        start = np.flatnonzero(known[self.tile :] - known[: -self.tile] == self.tile) if len(ids) >= self.tile else np.zeros(0, np.int64)
        if not len(start):
            return []
        seeds = self._seeds(ids)[start]
        at = np.minimum(np.searchsorted(self.sorted, seeds), len(self.sorted) - 1)
        hit = self.sorted[at] == seeds
        shared: dict[int, list[int]] = {}
        for s, seed in zip(start[hit].tolist(), seeds[hit].tolist(), strict=True):
            for k in self.seeds[seed]:
                shared.setdefault(k, []).append(s)
        out = []
        for k, starts in sorted(shared.items()):
            cover = np.zeros(len(ids), bool)
            for j in range(self.tile):
                cover[np.array(starts) + j] = True
            # only words that a shared seed covers can lie in a tile; one gap parts the stretches
            keep = np.flatnonzero(cover)
            gap = np.flatnonzero(np.diff(keep) > 1) + 1
            part = np.insert(ids[keep], gap, 0)
            item = self.items[k][1]
            found = tiles(item, part.tolist(), (part > 0).tolist(), self.tile)
            out.append((self.items[k][0], len(item), sum(n for _, _, n in found), len(found)))
        return out


_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered_words", pa.int64()), ("n_tiles", pa.int64()), ("coverage", pa.float64())])
_PAIRS_DDL = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, coverage double"


def _rows(batch: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*batch, strict=True)) or [[]] * len(_PAIRS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAIRS, strict=True)], schema=_PAIRS)


def _scan(items: Items, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                out += [(d, i, n, c, k, c / n) for i, n, c, k in items.pairs(t.as_py()) if c >= coverage * n]
            yield _rows(out)

    return run


def spare_seeds(words: int, different: int, tile: int = TILE, coverage: float = COVERAGE) -> int:
    """How many of an item's seeds may be left out so that each text that covers it shares another one.

    ``coverage * words`` words lie in tiles of ``tile`` words or more, in which a seed starts at one word in ``tile`` at least:
    so many seeds of the item are shared. Of an item that repeats a seed they may be fewer; then nothing is left out.
    """
    if different < words - tile + 1:
        return 0
    return max(0, math.ceil(coverage * words / tile - 1e-9) - 1)


def _seed_rows(tile: int, coverage: float | None = None):
    """Seeds of each text as hashes, once each: key (a hash of the text), seed and, for items, how many may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(t.as_py())
                seeds = {xxhash.xxh3_64_intdigest(" ".join(words[i : i + tile])) - 2**63 for i in range(len(words) - tile + 1)}
                if seeds:
                    columns = {"key": pa.array([key] * len(seeds), pa.int64()), "seed": pa.array(list(seeds), pa.int64())}
                    if coverage is not None:
                        columns["spare"] = pa.array([spare_seeds(len(words), len(seeds), tile, coverage)] * len(seeds), pa.int32())
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def _tile_pairs(tile: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, i, text, item in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "item")), strict=True):
                out += [(d, i, n, c, k, c / n) for i, n, c, k in Items([(i, item)], tile).pairs(text) if c >= coverage * n]
            yield _rows(out)

    return run


def _collected(benchmark: DataFrame, most: int) -> list[tuple] | None:
    """The items if their texts are small enough in all, else None."""
    size = benchmark.agg(F.sum(F.length("text") + 16).alias("n")).first()["n"] or 0
    return [(r["item_id"], r["text"]) for r in benchmark.orderBy("item_id").collect()] if size <= most else None


def leaks(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", tile: int = TILE, coverage: float = COVERAGE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Pairs of a row and an item that it holds: doc_id, item_id, item_words, covered_words, n_tiles, coverage.

    Null or empty texts and items under ``tile`` words are in no pair. Repeated
    rows or items give repeated pairs. Null doc_id or item_id: kept as null.
    Empty tables: no rows. Other columns are not read.
    """
    docs = pick(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    items = pick(benchmark, item_id=item_id, text=item_text).select(F.col("item_id").cast("long"), "text")
    rows = _collected(items, broadcast_chars)
    if rows is not None:
        return docs.mapInArrow(_scan(Items(rows, tile), coverage), _PAIRS_DDL)
    docs, items = docs.withColumn("th", F.xxhash64("text")), items.withColumn("ih", F.xxhash64("text"))
    right = cut(items.select("ih", "text").distinct().mapInArrow(_seed_rows(tile, coverage), "key long, seed long, spare int").withColumnRenamed("key", "ih"))
    known = cut(right.select("seed").distinct())
    hits = store(docs.select("th", "text").mapInArrow(_seed_rows(tile), "key long, seed long").withColumnRenamed("key", "th").join(known.hint("merge"), "seed", "left_semi"), "hits")
    often = cut(hits.groupBy("seed").agg(F.count("*").alias("n")))
    commonest = F.row_number().over(W.partitionBy("ih").orderBy(F.desc("n"), "seed"))
    right = cut(right.join(often.hint("merge"), "seed").withColumn("turn", commonest).filter(F.col("turn") > F.col("spare")).select("seed", "ih"))
    pairs = cut(hits.join(right.hint("merge"), "seed").select("th", "ih").distinct())
    both = pairs.join(docs, "th").join(items.withColumnRenamed("text", "item"), "ih").select("doc_id", "item_id", "text", "item")
    return both.mapInArrow(_tile_pairs(tile, coverage), _PAIRS_DDL)


def clean_documents(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The pipeline's form: the rows of ``docs`` that hold no item, with all their columns."""
    items = pick(benchmark, item_id="item_id", text="text")
    rows = _collected(items, broadcast_chars)
    if rows is None:

        def far(flat: DataFrame, text: str) -> DataFrame:
            # each row is judged by its own text, whatever its doc_id
            hashed = flat.select(F.xxhash64(text).alias("__h"), F.col(text))
            found = leaks(hashed, benchmark, "__h", text, tile=tile, coverage=coverage, broadcast_chars=broadcast_chars)
            return flat.join(found.select(F.col("doc_id").alias("__d")).distinct(), F.xxhash64(flat[text]) == F.col("__d"), "left_anti")

        return by_place(docs, far, "text")
    index = Items(rows, tile)

    def holds(texts: pa.Array) -> pa.Array:
        return pa.array([any(c >= coverage * n for _, n, c, _ in index.pairs(t.as_py())) for t in texts], pa.bool_())

    def near(flat: DataFrame, text: str) -> DataFrame:
        return flat.select("*", F.arrow_udf(holds, returnType="boolean")(text).alias("__holds")).filter(~F.col("__holds"))

    return by_place(docs, near, "text")
