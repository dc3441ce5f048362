"""Near-duplicates by improved consistent weighted sampling.

Texts that agree word for word are one node. Each node's five-word shingles are
weighted by TF-IDF and sampled ``BANDS * ROWS`` times: a sample is drawn with
the same random numbers wherever a shingle occurs, so two nodes agree in one with the
probability of their weighted Jaccard similarity, the one that pairs are accepted by. Samples are banded; nodes that
share a band are compared with two of them, the band's hubs, by the exact weighted
Jaccard similarity of the same weights. Bands whose nodes do not all fall into
one class then have all their classes compared: small ones pair by pair, and the
nodes of large ones by an exact join on the rarest shingles of each (prefix,
length and position filters), which leaves out no pair that is similar enough.

Plain inverse frequencies would make the few shingles that an edit changes, which no
other text has, outweigh what copies share, the more the more copies there are: two
texts of a group that a third of a corpus belongs to agree to 0.5 if nine tenths of their
shingles are equal. So the inverse frequency is damped: a shingle weighs 1 to
``1 + RISE`` times its count, by the logarithm of how rare it is. Frequencies are
counted in ``CELLS`` cells by shingle hash: the table's size is fixed, where one by shingle
is larger than the corpus. Shingles that share a cell share their frequency.
"""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import by_place, cut, pick, store

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 12
ROWS = 3
CELLS = 1 << 16
#: By how much more a shingle of one document counts than one of all documents.
RISE = 0.1
#: Steps of the inverse frequency; weights are whole numbers of them, so that their sums are exact.
STEPS = 64
#: Hubs with which every node of a band is compared.
HUBS = 2
#: Bands of up to this many nodes have all their classes compared at the end; nodes of larger ones are joined on rare shingles.
SMALL = 32
#: Lengths in that join are in classes of this many to a factor of 1 / SIMILARITY.
LENGTHS = 8

_U = np.uint64
_WORD = re.compile(r"\w+")
_REMEMBER = 150_000
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _MIX1
    h = (h ^ (h >> _U(27))) * _MIX2
    return h ^ (h >> _U(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBER:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(words: list[str], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words, repeats included; a shorter text is one run."""
    h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    size = min(size, len(words))
    if not size:
        return h
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, _U)
        for i in range(size):
            out = out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
        return _mixed(out)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _gamma_table(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, the middle of each of ``n`` equal steps."""
    x = np.linspace(0, 40, 400_001)
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x)


class Sampler:
    """Improved consistent weighted sampling of a weighted set of hashes."""

    def __init__(self, samples: int):
        self.r = _gamma_table()
        self.log_c = np.log(self.r)
        self.seeds = _mixed(np.arange(1, samples + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
        self.samples = samples

    def sample(self, keys: np.ndarray, weights: np.ndarray, block: int = 4096) -> np.ndarray:
        """One 64-bit value a sample: of the chosen key and its quantized weight."""
        best = np.full(self.samples, np.inf)
        value = np.zeros(self.samples, _U)
        with np.errstate(over="ignore"):
            for low in range(0, len(keys), block):
                k, log_w = keys[low : low + block], np.log(weights[low : low + block])
                z = _mixed(k[None, :] ^ self.seeds[:, None])
                r = self.r[(z & _U(0xFFFF)).astype(np.int64)]
                beta = (z >> _U(32)).astype(np.float64) * 2.0**-32
                t = np.floor(log_w / r + beta)
                log_a = self.log_c[((z >> _U(16)) & _U(0xFFFF)).astype(np.int64)] - r * (t - beta) - r
                at = log_a.argmin(axis=1)
                row = np.arange(self.samples)
                better = log_a[row, at] < best
                best = np.where(better, log_a[row, at], best)
                value = np.where(better, _mixed(k[at] + t[row, at].astype(np.int64).view(_U) * _U(0xD6E8FEB86659FD93)), value)
        return value


def _frequencies(size: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, count, n = WordHashes(), np.zeros(cells, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                if words := words_of(t.as_py() or ""):
                    n += 1
                    found = np.unique(shingles(words, hashes, size))
                    count += np.bincount((found % _U(cells)).astype(np.int64), minlength=cells)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(count[at], n))], names=["cell", "n"])

    return run


def rarities(docs: DataFrame, size: int = SHINGLE, cells: int = CELLS) -> np.ndarray:
    """How rare each cell is, from 0 (in all documents) to STEPS (in one), by the logarithm of its frequency; the driver gets ``cells`` numbers, whatever the input."""
    rows = docs.select("text").mapInArrow(_frequencies(size, cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    count, n = np.zeros(cells), 1
    for r in rows:
        if r["cell"] < 0:
            n = max(r["n"], 1)
        else:
            count[r["cell"]] = r["n"]
    share = np.log(n / np.clip(count, 1, n)) / np.log(n) if n > 1 else np.ones(cells)
    return np.round(STEPS * share).astype(np.uint8)


def weigh(found: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """The weight of one occurrence of each shingle, in steps."""
    return round(STEPS / RISE) + rare[(found % _U(len(rare))).astype(np.int64)].astype(np.int64)


def vector_of(text: str | None, rare: np.ndarray, hashes: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles, sorted, and their weights."""
    found, count = np.unique(shingles(words_of(text or ""), hashes, size), return_counts=True)
    return found, count * weigh(found, rare)


def _signatures(rare: np.ndarray, size: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("node", pa.binary()), ("rank", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sampler = WordHashes(), Sampler(bands * rows)
        which = np.arange(1, bands + 1, dtype=_U)
        for batch in batches:
            nodes, ranks, keys = [], [], []
            for t in batch.column("text"):
                words = words_of(t.as_py() or "")
                if not words:
                    nodes.append(None)
                    ranks.append(None)
                    keys.append(None)
                    continue
                nodes.append(xxhash.xxh3_128_digest(" ".join(words)))
                found, count = np.unique(shingles(words, hashes, size), return_counts=True)
                weight = count * weigh(found, rare)
                ranks.append(int(1000 * weight.sum() // count.sum()))
                drawn = sampler.sample(found, weight.astype(np.float64))
                with np.errstate(over="ignore"):
                    key = which
                    for part in drawn.reshape(bands, rows).T:
                        key = _mixed(key * _U(0x9E3779B97F4A7C15) + part)
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "r1", "r2")), pa.array(nodes, pa.binary()), pa.array(ranks, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets of (sorted keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least)) if len(a[0]) or len(b[0]) else 0.0


def _similar(rare: np.ndarray, size: int, least: float):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: WordHashes = WordHashes()
        kept: OrderedDict[bytes, tuple] = OrderedDict()

        def vector(node: bytes, text: str) -> tuple:
            if node not in kept:
                kept[node] = vector_of(text, rare, hashes, size)
                if len(kept) > 64:
                    kept.popitem(last=False)
            else:
                kept.move_to_end(node)
            return kept[node]

        for batch in batches:
            out = [(a, b) for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True) if weighted_jaccard(vector(a, x), vector(b, y)) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], schema=schema)

    return run


def verified(pairs: DataFrame, texts: DataFrame, rare: np.ndarray, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Of pairs (a, b) of nodes those whose texts (node, text) are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_similar(rare, size, least), "a binary, b binary")


def _prefixes(rare: np.ndarray, size: int, least: float):
    """Of each node the shingles that it may share first with a similar one, rarest first: token, rest (the weight from it on), w (the weight of all).

    A shingle that a text repeats is a token for each time. Two nodes that are similar
    enough share tokens of ``least`` of the weight of each at least, so the first that they share has that much from it on in both.
    """
    schema = pa.schema([("node", pa.binary()), ("label", pa.binary()), ("token", pa.int64()), ("rest", pa.int64()), ("w", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for row, t in enumerate(batch.column("text")):
                found, count = np.unique(shingles(words_of(t.as_py()), hashes, size), return_counts=True)
                each = np.repeat(found, count)
                turn = np.arange(len(each), dtype=_U) - np.repeat((np.cumsum(count) - count).astype(_U), count)
                with np.errstate(over="ignore"):
                    token = _mixed(each + turn * _U(0x9E3779B97F4A7C15))
                weight = weigh(each, rare)
                order = np.lexsort((token, -weight))
                rest = np.cumsum(weight[order][::-1])[::-1]
                total = int(rest[0])
                n = int(np.count_nonzero(rest >= least * total - 1e-6))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(np.full(n, row))) for c in ("node", "label")), pa.array(token[order[:n]].view(np.int64)), pa.array(rest[:n]), pa.array(np.full(n, total, np.int64))], schema=schema)

    return run


def rare_pairs(named: DataFrame, texts: DataFrame, rare: np.ndarray | None = None, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of nodes of different labels; every pair that is similar enough is among them. ``named`` has each node once: node, label; without ``rare`` shingles weigh their counts.

    Nodes are joined on tokens of their prefixes and on classes of weight. A shared token
    counts if what follows it in both could still be enough, which holds for the first one of
    a similar pair. One side leaves out a label of each token, which is the
    commonest one as a rule: of two nodes of different labels one has another.
    """
    rare = np.zeros(1, np.uint8) if rare is None else rare
    own = texts.join(named.hint("merge"), "node").select("node", "label", "text")
    tokens = store(own.mapInArrow(_prefixes(rare, size, least), "node binary, label binary, token long, rest long, w long"), "tokens")
    one = F.min_by("label", F.xxhash64("node"))
    several = cut(tokens.groupBy("token").agg(one.alias("most"), F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") != F.col("high")).select("token", "most"))
    live = store(tokens.join(several.hint("merge"), "token"), "live")
    share, step = least / (1 + least), math.log(1 / least) / LENGTHS

    def weight_class(w: Column, add: float) -> Column:
        return F.floor(F.log(w) / step + F.lit(add)).cast("int")

    right = live.select("token", weight_class(F.col("w"), 0).alias("class"), F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("rest").alias("rest_b"), F.col("w").alias("w_b"))
    left = live.filter(F.col("label") != F.col("most"))
    heaviest = F.col("rest") / F.lit(share) - F.col("w")  # of a node that can still be similar
    left = left.select("token", F.explode(F.sequence(weight_class(least * F.col("w"), -1e-6), weight_class(heaviest, 1e-6))).alias("class"), F.col("node").alias("a"), "label", "rest", "w")
    both = left.join(right.hint("merge"), ["token", "class"]).filter(F.col("label") != F.col("label_b"))
    enough = F.least("rest", "rest_b") >= share * (F.col("w") + F.col("w_b")) - 1e-3
    return both.filter(enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


#: Links that a task joins at a time before it passes on what they have made.
FOREST = 100_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) with the same classes as those given, fewer and all to the least node of what a task has joined."""
    above: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while (up := above.get(x, x)) != top:
            above[x], x = top, up
        return top

    def flush() -> pa.RecordBatch:
        out = [(root(x), x) for x in above]
        above.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
        if len(above) > FOREST:
            yield flush()
    yield flush()


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """node, label: the least node that links lead to; only nodes that have a link.

    Each task first joins its own links by union-find, which leaves shallow trees.
    Labels then spread along their links and jump to their label's label, until none changes.
    Joins are merge joins on both sides' own shuffles, which Spark splits where a node has many links.
    """
    ends = F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x in "ab" for y in "ab"))
    links = cut(edges.mapInArrow(_forest, "a binary, b binary").select(F.explode(ends).alias("e")).select("e.*").distinct())
    labels = cut(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")))
    for _ in range(most):
        near = links.join(labels.withColumnRenamed("node", "v").hint("merge"), "v")
        near = near.groupBy(F.col("u").alias("node")).agg(F.min("label").alias("low"), F.max(F.when(F.col("u") == F.col("v"), F.col("label"))).alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        next_ = cut(near.join(jump.hint("merge"), "low").select("node", F.least("low", "far").alias("label"), "old"))
        labels = next_.select("node", "label")
        if next_.filter(F.col("label") != F.col("old")).isEmpty():
            return labels
    raise RuntimeError(f"classes are not settled after {most} rounds")


def _labels(members: DataFrame, texts: DataFrame, rare: np.ndarray, size: int, least: float, hubs: int, small: int) -> DataFrame:
    """node, label of the nodes that have a similar one in a band; ``members`` has key, node and rank, how rare its shingles are on average.

    First the nodes of every band are compared with its hubs. Then bands that still
    hold several classes have all of them compared: pair by pair if they are small,
    by rare_pairs if they are large. Each step is one set of pairs, verified at once:
    many small jobs would cost the driver more memory than the pairs cost time.
    """

    def bands(named: DataFrame) -> DataFrame:
        """Bands of several classes with their hubs. Written, so that Spark can split the rows of a large band that meet them.

        The first hub is the node of the commonest shingles: of a text and its edited copies, the one with the fewest edits. The others are the first in orders that are the band's own.
        """
        first = [F.min(F.struct((F.xxhash64(F.lit(t), "key", "node") if t else F.col("rank").cast("long")).alias("o"), F.col("node").alias("hub"), F.col("label").alias("hub_label"))) for t in range(hubs)]
        open_ = named.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.array(*first).alias("hubs"))
        return cut(open_.filter(F.col("low") != F.col("high")).select("key", "size", "hubs"))

    def with_hubs(named: DataFrame, open_: DataFrame) -> DataFrame:
        both = named.join(open_.hint("merge"), "key").select("node", "label", F.explode(F.array_distinct("hubs")).alias("h"))
        return both.filter(F.col("label") != F.col("h.hub_label")).select(F.least("node", "h.hub").alias("a"), F.greatest("node", "h.hub").alias("b"))

    def all_classes(named: DataFrame, open_: DataFrame) -> DataFrame:
        rest = named.join(open_.select("key").hint("merge"), "key").select("key", "node", "label")
        other = rest.select("key", F.col("node").alias("b"), F.col("label").alias("label_b"))
        return rest.withColumnRenamed("node", "a").join(other.hint("merge"), "key").filter((F.col("a") < F.col("b")) & (F.col("label") != F.col("label_b"))).select("a", "b")

    alone = members.withColumn("label", F.col("node"))
    edges = cut(verified(with_hubs(alone, bands(alone)).distinct(), texts, rare, size, least))
    named = cut(members.join(components(edges).hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")))
    open_ = bands(named)
    large = cut(named.join(open_.filter(F.col("size") > small).select("key").hint("merge"), "key", "left_semi").select("node", "label").distinct())
    pairs = all_classes(named, open_.filter(F.col("size") <= small))
    if not large.isEmpty():
        pairs = pairs.unionByName(cut(rare_pairs(large, texts, rare, size, least).distinct()))
    return components(edges.unionByName(verified(pairs.distinct(), texts, rare, size, least)))


def _classified(docs: DataFrame, size: int, least: float, bands: int, rows: int, hubs: int, small: int) -> DataFrame:
    """Each row's doc_id, r1, r2, node and label (both null without words); ``docs`` has doc_id as long, text, and r1 and r2, which differ between rows that are not repeats."""
    rare = rarities(docs, size)
    signed = store(docs.select("doc_id", "r1", "r2", "text").mapInArrow(_signatures(rare, size, bands, rows), "doc_id long, r1 long, r2 long, node binary, rank int, keys array<long>"), "signatures")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.first("rank").alias("rank"), F.first("keys").alias("keys"))  # all its rows have the same
    members = nodes.select("node", "rank", F.explode("keys").alias("key"))
    shared = cut(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    members = store(members.join(shared.hint("merge"), "key", "left_semi"), "members")
    # one row of each node brings its text; repeats of that very row are dropped by the aggregation
    owners = cut(signed.join(members.select("node").distinct().hint("merge"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("r1", "r2")).alias("o")).select("node", "o.*"))
    texts = docs.select("r1", "r2", "text").join(owners.hint("merge"), ["r1", "r2"]).groupBy("node").agg(F.first("text").alias("text"))
    labels = cut(_labels(members, store(texts, "texts"), rare, size, least, hubs, small))
    return signed.select("doc_id", "r1", "r2", "node").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, hubs: int = HUBS, small: int = SMALL) -> DataFrame:
    """Every row of ``df`` once: doc_id, text_id, class_id, class_rows.

    ``class_id`` is the least doc_id of the class, ``class_rows`` counts its rows
    and ``text_id`` is the text's node. Texts without words (null or empty
    ones too): text_id is null and the row is a class of its own. Repeated rows are of one
    class. A null doc_id is never the least one if there is another. Texts under
    ``size`` words are one shingle. Empty table: no rows. Other columns are not read.
    """
    docs = pick(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    docs = docs.select("doc_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("r1"), F.xxhash64("text", F.col("doc_id").isNull(), "doc_id").alias("r2"), "text")
    named = cut(_classified(docs, size, least, bands, rows, hubs, small))
    sizes = cut(named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows")))
    out = named.join(sizes.hint("merge"), "label", "left")
    return out.select("doc_id", F.col("node").alias("text_id"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"))


def _row_hashes(flat: DataFrame) -> tuple[Column, Column]:
    """128 bits of a row's content; maps, which Spark does not hash, by their JSON."""
    parts = []
    for field in flat.schema:
        c = F.col(field.name)
        parts += [c.isNull(), F.to_json(F.struct(c)) if "map<" in field.dataType.simpleString() else c]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts[::-1])


def one_of_each(docs: DataFrame) -> DataFrame:
    """The pipeline's form: every column of ``docs``; one row of each class, and all rows without words.

    The row of the least doc_id stays, a null one last; of several with that id
    the one of the least content hash, once if it is repeated. Rows of other
    classes stay whatever their doc_id. Texts move only where a repeated row is the one to stay.
    """

    def stage(flat: DataFrame, doc_id: str, text: str) -> DataFrame:
        own = flat.columns
        r1, r2 = _row_hashes(flat)
        rows = flat.select(F.col(doc_id).cast("long").alias("doc_id"), r1.alias("r1"), r2.alias("r2"), F.col(text).alias("text"))
        named = cut(_classified(rows, SHINGLE, SIMILARITY, BANDS, ROWS, HUBS, SMALL).filter("label is not null").groupBy("label", "doc_id", "r1", "r2").agg(F.count("*").alias("n")))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
        best = cut(named.groupBy("label").agg(F.min(order).alias("best")))
        told = named.join(best.hint("merge"), "label").select("r1", "r2", (order == F.col("best")).alias("__stays"), "n")
        # only rows that go, and those that stay but are repeated, are marked
        told = cut(told.filter(~F.col("__stays") | (F.col("n") > 1)).select(F.col("r1").alias("__m1"), F.col("r2").alias("__m2"), "__stays"))
        hashed = flat.withColumns({"__r1": r1, "__r2": r2})
        alike = (F.col("__r1") == F.col("__m1")) & (F.col("__r2") == F.col("__m2"))
        once = hashed.join(told, alike, "left_anti").select(*own)
        repeated = told.filter("__stays")
        if repeated.isEmpty():
            return once
        again = hashed.join(repeated, alike, "left_semi").groupBy("__r1", "__r2").agg(F.first(F.struct(*own)).alias("row"))
        return once.unionByName(again.select("row.*"))

    return by_place(docs, stage, "doc_id", "text")
