"""Exact removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts anywhere
else. Sorting every suffix of a corpus would move each text many times, so the
suffixes that can have a partner are found first, exactly:

1. Each window of ``LENGTH`` bytes has an anchor, the least hash of its
   ``K``-byte substrings. Equal windows have equal anchors. Neighbouring windows of
   one anchor form a run, which is one row. Anchors that occur once are counted
   out; runs of equal bytes (128 bits of hash) are one kind, whose count is its weight.
2. The bytes of one run of each kind are fetched once and grouped by anchor, and the
   suffixes at each distance from the anchor are sorted: multikey quicksort, 8 bytes
   a character, to a shallow depth, then a blind trie for each group that still has a
   long common prefix. A suffix is repeated if those equal to it weigh more than one.
3. Groups of very many kinds are split first, so that none goes to one task: their
   runs are cut into pieces of ``WIDTHS`` distances, and a piece goes to the group of
   the bytes that all windows of its distances share. Equal pieces become one kind
   again. The last width is one window, whose group holds only windows equal to it.
4. What the sort found for a kind holds for all of its runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import cut, pick, store

LENGTH = 200
K = 64
#: Bytes to which the multikey quicksort goes.
SHALLOW = 32
#: Groups of more kinds than this (about 70 kB of bytes) are split by further bytes.
CROWDED = 250
#: Distances from the anchor that a piece of a split run covers, one split after another.
WIDTHS = (48, 8, 1)
#: Bytes that are hashed at a time; a longer text is cut into overlapping parts.
_BLOCK = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_tables: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, and a random value of each byte."""
    if "p" not in _tables:
        size = _BLOCK + 4096
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _BASE, _U)]), dtype=_U)
            down = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, pow(_BASE, -1, 2**64), _U)]), dtype=_U)
        byte = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), _U)
        _tables["p"] = up, down, byte
    up, down, byte = _tables["p"]
    return up[:n], down[:n], byte


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _MIX1
    h = (h ^ (h >> _U(27))) * _MIX2
    return h ^ (h >> _U(31))


def anchors(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes: its anchor's place and the anchor's hash."""
    n = len(data)
    up, down, byte = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, _U)
        np.cumsum(byte[data] * up[:n], dtype=_U, out=sums[1:])
        hashes = _mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])
    width = length - k + 1
    keys = (hashes & _U(~0xFFFFFF & (2**64 - 1))) | np.arange(len(hashes), dtype=_U)  # 40 bits of hash, then the place: the leftmost wins
    pad = -len(keys) % width
    rows = np.concatenate([keys, np.full(pad, 2**64 - 1, _U)]).reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    place = (np.minimum(after[:windows], before[width - 1 : width - 1 + windows]) & _U(0xFFFFFF)).astype(np.int64)
    return place, hashes[place]


def runs(texts: Iterable[bytes], length: int = LENGTH, k: int = K) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: arrays of text number, first start, count of starts, anchor's distance from the first, anchor hash, hash of the run's bytes."""
    block: list[tuple[int, int, bytes]] = []
    filled = 0

    def flush() -> tuple[np.ndarray, ...]:
        joined = b"".join(b for _, _, b in block)
        place, hashes = anchors(np.frombuffer(joined, np.uint8), length, k)
        sizes = np.array([len(b) for _, _, b in block])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        within = np.zeros(len(joined) + 1, np.int64)
        within[offsets[:-1]] += 1
        within[offsets[:-1] + sizes - length + 1] -= 1
        valid = np.cumsum(within)[: len(place)] > 0
        new[offsets[:-1]] = True
        first = np.flatnonzero(new & valid)
        stop = np.append(np.flatnonzero(new | ~valid), len(place))
        count = stop[np.searchsorted(stop, first, "right")] - first
        owner = np.searchsorted(offsets, first, "right") - 1
        view = memoryview(joined)
        content = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)), _U, len(first))
        number = np.array([i for i, _, _ in block])[owner]
        start = first - offsets[owner] + np.array([s for _, s, _ in block])[owner]
        return number, start, count, place[first] - first, hashes[first].view(np.int64), content.view(np.int64)

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), _BLOCK // 2):
            part = text[at : at + _BLOCK // 2 + length - 1]
            if len(part) < length:
                continue
            if filled + len(part) > _BLOCK:
                yield flush()
                block, filled = [], 0
            block.append((i, at, part))
            filled += len(part)
    if block:
        yield flush()


class BlindTrie:
    """Groups equal strings of one length; inner nodes hold only where their children first differ."""

    def __init__(self) -> None:
        self.root: list | None = None  # a leaf is [text, members], an inner node [depth, {byte: node}]

    def insert(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = [text, [member]]
            return
        node = self.root
        while type(node[0]) is int:  # blind: only the bytes at the branches are looked at
            children = node[1]
            node = children.get(text[node[0]]) or next(iter(children.values()))
        if node[0] == text:
            node[1].append(member)
            return
        differ = int.from_bytes(node[0], "big") ^ int.from_bytes(text, "big")
        depth = len(text) - (differ.bit_length() + 7) // 8
        byte, leaf = node[0][depth], [text, [member]]
        parent, node = None, self.root
        while type(node[0]) is int and node[0] < depth:
            parent, node = node, node[1][text[node[0]]]
        if type(node[0]) is int and node[0] == depth:
            node[1][text[depth]] = leaf
            return
        inner = [depth, {byte: node, text[depth]: leaf}]
        if parent is None:
            self.root = inner
        else:
            parent[1][text[parent[0]]] = inner

    def groups(self) -> Iterator[list[int]]:
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if type(node[0]) is int:
                stack += node[1].values()
            else:
                yield node[1]


def repeated_suffixes(data: bytes, at: np.ndarray, cell: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """Which suffixes have an equal first ``length`` bytes in their cell: a flag for each place in ``at``.

    Breadth-first multikey quicksort over all cells at once, a character being 8
    bytes, then a blind trie for each group that agrees to ``shallow`` bytes.
    """
    flags = np.zeros(len(at), bool)
    raw = np.frombuffer(data + bytes(8), np.uint8)
    chars = np.zeros(len(data), _U)
    for i in range(8):
        chars = (chars << _U(8)) | raw[i : i + len(data)].astype(_U)
    order = np.argsort(cell, kind="stable")
    _, part = np.unique(cell[order], return_inverse=True)
    depth = np.zeros(len(order), np.int64)
    deep_at: list[np.ndarray] = []
    deep_part: list[np.ndarray] = []
    done = 0
    while len(order):
        size = np.bincount(part)
        alone = size[part] < 2
        deep = (depth >= shallow) & ~alone
        if deep.any():
            deep_at.append(order[deep])
            deep_part.append(part[deep] + done)
            done += len(size)
        go = ~alone & ~deep
        order, part, depth = order[go], part[go], depth[go]
        if not len(order):
            break
        _, first, part, size = np.unique(part, return_index=True, return_inverse=True, return_counts=True)
        char = chars[at[order] + depth]
        pivot = char[first + size // 2][part]
        side = part * 3 + (char >= pivot).astype(np.int64) + (char > pivot)
        turn = np.argsort(side, kind="stable")
        depth = (depth + 8 * (char == pivot))[turn]
        order, part = order[turn], np.unique(side[turn], return_inverse=True)[1]
    if deep_at:
        members, parts = np.concatenate(deep_at), np.concatenate(deep_part)
        turn = np.argsort(parts, kind="stable")
        members, parts = members[turn], parts[turn]
        bounds = np.flatnonzero(np.diff(parts)) + 1
        places = at[members].tolist()
        for low, high in zip([0, *bounds.tolist()], [*bounds.tolist(), len(members)], strict=True):
            trie = BlindTrie()
            for j in range(low, high):
                trie.insert(data[places[j] : places[j] + length], j)
            for group in trie.groups():
                if len(group) > 1:
                    flags[members[group]] = True
    return flags


# A run's place in its text, or a piece's in its run, as one number: first start, count of starts, anchor's distance.
def _pack(start: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 20) | (count.astype(np.int64) << 10) | anchor.astype(np.int64)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 20, (place >> 10) & 1023, place & 1023


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_COUNTS = pa.schema([("m", pa.int64()), ("c", pa.int64())])
_RUNS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("place", pa.int64()), ("m", pa.int64()), ("w", pa.int64())])
_KINDS = pa.schema([("m", pa.int64()), ("w", pa.int64()), ("c", pa.int64()), ("crowd", pa.int64()), ("place", pa.int64()), ("part", pa.binary())])
_PIECES = pa.schema([("m", pa.int64()), ("w", pa.int64()), ("c", pa.int64()), ("m1", pa.int64()), ("w1", pa.int64()), ("place", pa.int64()), ("part", pa.binary())])
_HITS = pa.schema([("m", pa.int64()), ("w", pa.int64()), ("step", pa.int64()), ("n", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _each(column: pa.Array) -> Iterator:
    """The values one at a time, so that a batch's texts are not held twice."""
    return (x.as_py() for x in column)


def _count_anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, m, _ in runs(_each(batch.column("text")), length, k):
                yield _batch(list(np.unique(m, return_counts=True)), _COUNTS)

    return run


def _list_runs(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("th")
            for number, start, count, anchor, m, w in runs(_each(batch.column("text")), length, k):
                at = pa.array(number)
                yield pa.RecordBatch.from_arrays([ids.take(at), hashes.take(at), pa.array(_pack(start, count, anchor)), pa.array(m), pa.array(w)], schema=_RUNS)

    return run


#: Bytes of a batch that is handed back.
_FULL = 4 << 20


def _cut_bytes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for text, wanted in zip(_each(batch.column("text")), _each(batch.column("wanted")), strict=True):
                for x in wanted:
                    start, count, anchor = _unpack(x["place"])
                    part = text[start : start + count + length - 1]
                    out.append((x["m"], x["w"], x["c"], x["crowd"], (count << 10) | anchor, part))
                    size += len(part)
                    if size > _FULL:
                        yield _batch(list(zip(*out, strict=True)), _KINDS)
                        out, size = [], 0
        if out:
            yield _batch(list(zip(*out, strict=True)), _KINDS)

    return run


def _signed(data: bytes) -> int:
    return int.from_bytes(data, "big", signed=True)


def _split(length: int, width: int):
    """Cuts runs into pieces of ``width`` distances: (m, w) stays the run's kind, (m1, w1) is the piece's group and kind."""
    width = min(width, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for m, w, c, place, part in zip(*(_each(batch.column(x)) for x in ("m", "w", "c", "place", "part")), strict=True):
                _, count, anchor = _unpack(place)
                last = anchor - count + 1  # the last window's distance
                for low in range(last // width * width, anchor + 1, width):  # distances low to low + width - 1
                    high = min(anchor, low + width - 1)
                    step, n = anchor - high, high - max(low, last) + 1
                    piece = part[step : step + n + length - 1]
                    shared = part[anchor - low : anchor - low + length - width + 1]
                    group = xxhash.xxh3_64_digest(b"%d %d " % (m, low) + shared)
                    kind = xxhash.xxh3_64_digest(b"%d %d " % (high, n) + piece)
                    out.append((m, w, c, _signed(group), _signed(kind), (step << 20) | (n << 10) | high, piece))
                    size += len(piece)
                if size > _FULL:
                    yield _batch(list(zip(*out, strict=True)), _PIECES)
                    out, size = [], 0
        if out:
            yield _batch(list(zip(*out, strict=True)), _PIECES)

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of m, which come in order, of about ``rows`` rows."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.concat_tables(held)
        m = table.column("m").to_numpy()
        last = int(np.searchsorted(m, m[-1]))  # the last group may go on
        while last > 0:
            upto = last if last <= 2 * rows else int(np.searchsorted(m, m[rows]) or np.searchsorted(m, m[rows], "right"))
            yield table.slice(0, upto)
            table, m, last = table.slice(upto), m[upto:], last - upto
        held, n = [table], table.num_rows
    if held:
        table = pa.concat_tables(held)
        if table.num_rows:
            yield table


def _sort_suffixes(length: int, shallow: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 4000):
            parts = table.column("part").to_pylist()
            _, count, anchor = _unpack(table.column("place").to_numpy())
            data = b"".join(parts)
            base = np.cumsum([0, *map(len, parts)])[:-1]
            owner = np.repeat(np.arange(len(parts)), count)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            _, group = np.unique(table.column("m").to_numpy(), return_inverse=True)
            hit = repeated_suffixes(data, base[owner] + step, group[owner] * 1024 + (anchor[owner] - step), length, shallow)
            hit |= (table.column("c").to_numpy() > 1)[owner]  # equal to none here, but of a kind that weighs more than one
            if hit.any():
                first = np.flatnonzero(hit & ~(np.append(False, hit[:-1]) & (step > 0)))
                ends = np.flatnonzero(hit & ~(np.append(hit[1:], False) & (np.append(step[1:], 0) > 0)))
                at = pa.array(owner[first])
                yield pa.RecordBatch.from_arrays([table.column("m").combine_chunks().take(at), table.column("w").combine_chunks().take(at), pa.array(step[first]), pa.array(ends - first + 1)], schema=_HITS)

    return run


def merged(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of one text, from the starts of its repeated windows."""
    out: list[list[int]] = []
    for start, end in sorted((x["start"], x["start"] + x["n"] + length - 1) for x in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    keep, at = [], 0
    for a, b in ranges:
        keep.append(text[at:a])
        at = b
    keep.append(text[at:])
    return b"".join(keep)


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                ranges = merged(spans or [], length)
                out.append((d, len(text), sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(without(text, ranges)).hexdigest()))
            yield _batch(list(zip(*out, strict=True)) or [[]] * len(_RESULT), _RESULT)

    return run


def _crowds(kinds: DataFrame, crowded: int) -> DataFrame:
    """Groups (m) of more than ``crowded`` kinds, as a table whose size Spark knows."""
    return store(kinds.groupBy("m").agg(F.count("*").alias("d")).filter(F.col("d") > crowded).select("m", F.lit(1).cast("long").alias("crowd")), "crowds")


def _with_crowds(kinds: DataFrame, crowds: DataFrame) -> DataFrame:
    return kinds.join(crowds, "m", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0).cast("long")))


def _repeated(kinds: DataFrame, some_crowded: bool, length: int, crowded: int, widths: tuple[int, ...]) -> DataFrame:
    """m, w, step, n: the repeated windows of each kind, as ``n`` windows from its ``step``-th."""
    few = kinds.filter("crowd = 0") if widths else kinds
    out = few.repartition("m").sortWithinPartitions("m").mapInArrow(_sort_suffixes(length, SHALLOW), _ddl(_HITS))
    if not widths or not some_crowded:
        return out
    pieces = store(kinds.filter("crowd = 1").mapInArrow(_split(length, widths[0]), _ddl(_PIECES)), "pieces")
    alike = pieces.groupBy(F.col("m1").alias("m"), F.col("w1").alias("w")).agg(F.sum("c").alias("c"), F.any_value(F.struct(F.col("place").bitwiseAND(F.lit((1 << 20) - 1)).alias("place"), "part")).alias("one"))
    alike = store(alike.select("m", "w", "c", "one.*"), "kinds")
    crowds = _crowds(alike, crowded)
    split = _with_crowds(alike, crowds).select(*_KINDS.names)
    found = store(_repeated(split, not crowds.isEmpty(), length, crowded, widths[1:]), "found").withColumnsRenamed({"m": "m1", "w": "w1"})
    at = F.shiftright("place", 20)
    return out.unionByName(pieces.select("m", "w", "m1", "w1", at.alias("at")).join(found, ["m1", "w1"]).select("m", "w", (F.col("at") + F.col("step")).alias("step"), "n"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, crowded: int = CROWDED) -> DataFrame:
    """Starts of repeated windows: doc_id, th, start, n (so many starts in a row from ``start``).

    ``docs`` has doc_id, th (a hash of the text) and text as binary without nulls.
    """
    seen = docs.select("text").mapInArrow(_count_anchors(length, k), _ddl(_COUNTS)).groupBy("m").agg(F.sum("c").alias("c")).filter("c > 1").select("m")
    seen = cut(seen)  # so that both sides of the join are plain shuffles, of which Spark can split a skewed one
    runs_ = store(docs.mapInArrow(_list_runs(length, k), _ddl(_RUNS)).join(seen, "m", "left_semi"), "runs")
    kinds = store(runs_.groupBy("m", "w").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "place")).alias("one")).select("m", "w", "c", "one.*"), "kinds")
    crowds = _crowds(kinds, crowded)
    wanted = _with_crowds(kinds, crowds).groupBy("doc_id", "th").agg(F.collect_list(F.struct("m", "w", "c", "crowd", "place")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"doc_id": "__d", "th": "__h"})
    both = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("__d")) & (docs["th"] == F.col("__h"))).select("text", "wanted")
    parts = store(both.mapInArrow(_cut_bytes(length), _ddl(_KINDS)), "parts")
    if parts.count() > kinds.count():  # repeated rows give each kind once a row
        parts = store(parts.dropDuplicates(["m", "w"]), "parts")
    found = store(_repeated(parts, not crowds.isEmpty(), length, crowded, WIDTHS), "found")
    return runs_.join(found, ["m", "w"]).select("doc_id", "th", (F.shiftright("place", 20) + F.col("step")).alias("start"), "n")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, crowded: int = CROWDED) -> DataFrame:
    """Every row of ``df`` once: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null or empty text: no bytes. Texts under ``length`` bytes keep all. A
    repeated row counts as another place, so both lose what they share. Null
    doc_id: a document like others. Empty table: no rows. Other columns are not read.
    """
    docs = pick(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    spans = repeated_spans(docs, length, k, crowded).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    spans = cut(spans).withColumnsRenamed({"doc_id": "__d", "th": "__h"})
    both = docs.join(spans, docs["doc_id"].eqNullSafe(F.col("__d")) & (docs["th"] == F.col("__h")), "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_digest(length), _ddl(_RESULT))
