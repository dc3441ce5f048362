"""How the sources of a language differ in their use of terms, by dense blocks of terms.

1. Tasks count terms by language and source in bounded tables, and one shuffle by
   (language, term) adds them up. Terms in at least ``MIN_DOCS`` documents of their
   language stay.
2. The terms of a language are dealt by hash to blocks, so that a block's counts are a
   numpy int64 tile of at most ``BLOCK_TERMS`` terms and ``CELLS`` cells, sources by terms. The tile of scaled
   probabilities is compared by broadcasting each source's row over those after it;
   the partial matrix of pair sums and the highest terms of each source leave the task.
3. Partial sums are added by Spark, and each source's short lists merged into one.

Languages of very many sources also split the rows of a tile's pair matrix (``PAIRS``).
All arithmetic is exact in 64-bit integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._common import pick, store

#: Documents of a language in which a kept term stands at least.
MIN_DOCS = 10
#: Terms reported for a group.
TOP = 10
#: Most terms and most cells of a tile, and most pairs of sources that one task sums for a tile.
BLOCK_TERMS = 1024
CELLS = 1 << 22
PAIRS = 1 << 22
#: Probabilities are scaled to this.
SCALE = 1_000_000_000
#: Entries of a task's table of counts, after which it is passed on.
_ENTRIES = 1 << 18
#: Terms are stretches of letters of ASCII, lower-cased, and of all code points beyond it; other bytes part them.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text in UTF-8."""
    return text.translate(_FOLD).split()


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by (lang, source, term): occurrences, and documents that hold the term."""
    uses: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), held in docs.items():
            n, terms = uses[lang, source], list(held)
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array(list(held.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)
        uses.clear(), docs.clear()

    entries = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            terms = terms_of(text.as_buffer().to_pybytes())
            if terms:
                group = lang.as_py(), source.as_py()
                before = len(docs[group])
                uses[group].update(terms)
                docs[group].update(set(terms))
                entries += len(docs[group]) - before
                if entries >= _ENTRIES:
                    yield from flush()
                    entries = 0
    yield from flush()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Kept terms of each language: lang, term, uses (array of source, n). ``docs`` has lang, source and text without nulls."""
    counts = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    one = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = one.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("uses"))
    return terms.filter(F.col("docs") >= min_docs).select("lang", "term", "uses")


def scaled(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * counts / total) by long division in steps of 1,000, so that nothing exceeds 64 bits (total up to 9 * 10**15)."""
    out, rest = counts // total, counts % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)), element by element; below 2**63 for values up to SCALE + 1."""
    d = p - q
    return d * d // (p + q)


def _highest(values: np.ndarray, terms: list[bytes], at: np.ndarray, top: int) -> list[int]:
    """Places of the ``top`` greatest values among ``at``; ties by term."""
    if len(at) > top:
        at = at[values[at] >= np.partition(values[at], len(at) - top)[len(at) - top]]
    return sorted(at.tolist(), key=lambda t: (-int(values[t]), terms[t]))[:top]


_PARTS = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _tile(top: int):
    def work(key: tuple, tile: pa.Table, layout: pa.Table) -> pa.Table:
        if not layout.num_rows:
            return _PARTS.empty_table()
        lang, stripe, stripes, v = (layout.column(c)[0].as_py() for c in ("lang", "stripe", "stripes", "v"))
        known = layout.column("groups")[0].values
        sources, totals = known.field("source"), known.field("n").to_numpy().astype(np.int64)
        terms = tile.column("term").combine_chunks()
        uses = tile.column("uses").combine_chunks()
        of_term = pc.list_parent_indices(uses).to_numpy()
        flat = pc.list_flatten(uses)
        counts = np.zeros((len(totals), tile.num_rows), np.int64)
        if tile.num_rows:
            counts[pc.index_in(flat.field("source"), sources).to_numpy(), of_term] = flat.field("n").to_numpy()
        p = scaled(counts + 2, (totals + 2 * v)[:, None]) if tile.num_rows else counts
        of_lang = scaled(counts.sum(axis=0) + 2, int(totals.sum()) + 2 * v) if tile.num_rows else counts
        names, texts, out = sources.to_pylist(), [t.as_py().encode() for t in terms], []
        for i in range(stripe, len(names), stripes):
            sums = divergence(p[i + 1 :], p[i]).sum(axis=1)
            out.append(pa.table([[lang] * len(sums), ["pair"] * len(sums), [names[i]] * len(sums), names[i + 1 :], sums], schema=_PARTS))
            if len(texts):
                value = divergence(p[i], of_lang)
                best = _highest(value, texts, np.flatnonzero((counts[i] > 0) & (p[i] > of_lang)), top)
                out.append(pa.table([[lang] * len(best), ["term"] * len(best), [names[i]] * len(best), terms.take(pa.array(best, pa.int64())), value[best]], schema=_PARTS))
        return pa.concat_tables(out) if out else _PARTS.empty_table()

    return work


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS, pairs: int = PAIRS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its divergence from each other source of the language (part ``pair``, all ranks) and
    the terms that it uses more than its language does, by their divergence (part ``term``, the first ``top``).

    Null lang, source and text count as ''. A group without terms still is a group; a language
    without kept terms has values of 0. A language of one source has no pairs. Ties rank by the
    item's UTF-8 bytes. Repeated rows are documents of their own. Empty table: no rows. Other columns are not read.
    """
    docs = pick(df, lang=lang, source=source, text=text).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = store(kept_terms(docs, min_docs), "terms")
    totals = kept.select("lang", F.explode("uses").alias("u")).groupBy("lang", "u.source").agg(F.sum("u.n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill({"n": 0})
    layout = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"))
    layout = layout.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").na.fill({"v": 0})
    size = F.size("groups").cast("long")
    layout = store(layout.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS), F.ceil(F.col("v") * size / cells))).withColumn("stripes", F.greatest(F.lit(1), F.ceil(size * size / pairs))), "layout")
    # languages of more than one tile: as many rows as tiles' worth of counts at most, so they may be sent to all
    split = F.broadcast(layout.filter((F.col("blocks") > 1) | (F.col("stripes") > 1)).select("lang", "blocks", "stripes"))

    def number(n: str):
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)).cast("int") - 1))

    tiles = kept.join(split, "lang", "left").withColumn("block", F.pmod(F.xxhash64("term"), F.coalesce("blocks", F.lit(1))).cast("int"))
    tiles = tiles.select("lang", "block", number("stripes").alias("stripe"), "term", "uses")
    layouts = layout.withColumn("block", number("blocks")).withColumn("stripe", number("stripes")).select("lang", "block", "stripe", "stripes", "v", "groups")
    key = ["lang", "block", "stripe"]
    parts = tiles.groupBy(*key).cogroup(layouts.groupBy(*key)).applyInArrow(_tile(top), "lang string, part string, source string, item string, value long")
    parts = store(parts, "tiles")
    sums = parts.filter("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", "part", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    by_value = Window.partitionBy("lang", "part", "source").orderBy(F.desc("value"), "item")
    terms = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    ranked = both.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)
    return ranked.select("lang", "source", "part", "item", "value", "rank")
