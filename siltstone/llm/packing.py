"""Sequence packing as a cutting-stock problem solved by column generation.

A document's ids are cut into full pieces of ``length`` ids and a rest. Rests are
counted in a histogram of ``length / GRAIN`` classes, which is all that the driver
gets. There a linear program over patterns (how many rests of each class share a
sequence) is solved by column generation: duals come from the basis, and a
knapsack by dynamic programming prices the best new pattern. Pattern counts are
rounded down and what is left over is packed best-fit. Documents of a class are
ranked, in salted parts so that no class falls to one task, and the ranks are
dealt to the patterns' slots.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.llm._common import cut, pick, shuffle_partitions

LENGTH = 2048
#: Rests are rounded up to a multiple of this many ids for the histogram.
GRAIN = 8
END_ID = 1
#: Words whose ids a task remembers before it forgets them all.
REMEMBER = 150_000
#: Relative gap between the program's value and its bound at which generation ends.
GAP = 1e-4


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters, then marks: two parts in the tokenizer's own split, if the letters' lower case is letters alone.
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@[-^`{-~]*)\Z")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    letters = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def lowered(word: str) -> str:
    """Lower case as the tokenizer makes it: letter by letter, so with no form of its own for a final sigma."""
    return word.lower() if word.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", word)))


class _Ids(dict):
    """Ids of a piece of text without blanks or line ends, as little-endian bytes. The last ``REMEMBER`` or more pieces are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.old: dict[str, bytes] = {}
        self[""] = b""

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, low: str) -> bytes:
        """Ids of a word of letters alone in lower case, which the tokenizer's split keeps whole: what its model makes of them."""
        if not low.isascii():
            low = "".join(map(self.letters.__getitem__, low.encode()))
        return array("I", [t.id for t in self.model.tokenize(low)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBER:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            found = _WORD_AND_MARKS.match(piece)
            low = lowered(found[1]) if found else ""
            if low.isalpha():  # the lower case of a dotted capital I ends in a mark that would join the marks after it
                ids = self[found[1]] + self[found[2]] if found[2] else self.word(low)
            else:
                ids = self.encode(piece)
        self[piece] = ids
        return ids


_known: dict[str, _Ids] = {}


def _ids(path: str) -> _Ids:
    """One for each worker process, which later tasks find filled."""
    if path not in _known:
        _known[path] = _Ids(path)
    return _known[path]


def ids_of(text: str | None, words: _Ids) -> bytes:
    """Ids of a whole text: it is cut at blanks and line ends, across which no token reaches."""
    return b"".join(map(words.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Full pieces and the rest of every row's ids: doc_id, start, length, ids_crc32, doc_tokens."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _ids(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(t.as_py(), words) + end
                n = len(ids) // 4
                view = memoryview(ids)
                rows += [(d, s, min(length, n - s), zlib.crc32(view[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), _PIECES, strict=True)] if rows else [pa.array([], k.type) for k in _PIECES], schema=_PIECES)

    docs = pick(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best value, and how often it takes each item."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size, kind="stable")
    s, v = size[order], value[order]
    upto = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            worth = best[c - s[: upto[c]]] + v[: upto[c]]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], took[c] = worth[k], k
    counts, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[order[took[c]]] += 1
            c -= int(s[took[c]])
    return float(best[capacity]), counts


def solve(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and their fractional counts that cover ``demand`` with few sequences."""
    m = len(size)
    fit = capacity // size
    basis = np.diag(fit).astype(float)  # a column for each pattern
    inverse = np.diag(1.0 / fit)
    x = demand / fit
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        best, pattern = price(np.maximum(duals, 0), size, capacity)
        if best <= 1 + 1e-9 or x.sum() * (1 - 1 / best) <= max(gap * x.sum(), 0.01):
            break
        enter = inverse @ pattern
        rise = enter > 1e-10
        if not rise.any():
            break
        ratio = np.full(m, np.inf)
        ratio[rise] = np.maximum(x[rise], 0) / enter[rise]
        leave = int(ratio.argmin())
        step = ratio[leave]
        x = x - step * enter
        x[leave] = step
        row = inverse[leave] / enter[leave]
        inverse = inverse - np.outer(enter, row)
        inverse[leave] = row
        basis[:, leave] = pattern
    return basis.T.round().astype(np.int64), np.maximum(x, 0)


def layout(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the ranks of each class go: (class, first rank, end rank, first sequence, slots in a sequence, first slot).

    Rank r of the class goes to sequence ``first + (r - first rank) // slots``.
    Every rank below the histogram's count is in exactly one row.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    given = dict.fromkeys(histogram, 0)
    sequence = 0
    if full := histogram.get(capacity, 0):
        out.append((capacity, 0, full, 0, 1, 0))
        given[capacity], sequence = full, full
    classes = np.array(sorted(c for c, n in histogram.items() if c != capacity and n), np.int64)
    if not len(classes):
        return out
    patterns, counts = solve(classes, np.array([histogram[int(c)] for c in classes], float), capacity)

    def deal(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        used, slot = 0, 0
        for c, k in sorted(pattern.items(), reverse=True):
            if (n := min(k * times, histogram[c] - given[c])) > 0:
                out.append((c, given[c], given[c] + n, sequence, k, slot))
                given[c] += n
                used = max(used, -(-n // k))
            slot += k
        sequence += used

    for pattern, count in sorted(zip(patterns.tolist(), counts.tolist(), strict=True), key=lambda p: -p[1]):
        if times := int(count + 1e-6):
            deal({int(c): k for c, k in zip(classes, pattern, strict=True) if k}, times)
    # what rounding left over, largest first, each into the fullest sequence that still holds it
    space: dict[int, list[dict[int, int]]] = {}
    for c in sorted(map(int, classes), reverse=True):
        for _ in range(histogram[c] - given[c]):
            room = min((r for r in space if r >= c and space[r]), default=None)
            load = space[room].pop() if room is not None else {}
            load[c] = load.get(c, 0) + 1
            space.setdefault((capacity if room is None else room) - c, []).append(load)
    for loads in space.values():
        for load in loads:
            deal(load, 1)
    return out


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text: the end id alone. A repeated row is packed as often as it
    occurs. Null doc_id: packed as any other, its pieces share the null. Empty
    table: no rows. Other columns are not read.
    """
    spark: SparkSession = df.sparkSession
    parts = max(64, shuffle_partitions(spark))
    rows = cut(pieces(df, doc_id, text, vocabulary, length).withColumn("class", F.ceil(F.col("length") / grain).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int")))
    counts = cut(rows.groupBy("class", "part").agg(F.count("*").alias("n")))
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # at most length / grain rows
    places = spark.createDataFrame(layout(histogram, length // grain) or [(0, 0, 0, 0, 1, 0)], "class int, low long, high long, first long, slots int, slot int")
    before = counts.select("class", "part", (F.sum("n").over(W.partitionBy("class").orderBy("part")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32")))
    ranked = ranked.join(before, ["class", "part"]).withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("before", "part")
    # the layout's rows number a few for each class, however many documents there are
    at = ranked.alias("r").join(F.broadcast(places).alias("p"), (F.col("r.class") == F.col("p.class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = at.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("slots"))).cast("long").alias("sequence_id"), (F.col("slot") + F.pmod(F.col("rank") - F.col("low"), F.col("slots"))).alias("slot"))
    offset = F.sum("length").over(W.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    return at.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
