"""Column profiles, diagnostics and the health score.

One wide aggregation over all columns gives counts, one more gives quartiles of
the numeric ones, and one long one (a row per column and value's hash) gives
distinct values and the commonest ones, whose texts are then fetched. Decisions are
made on the driver from those few rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import cells, names
from siltstone.functions.stats import nearest, round2
from siltstone.operators.quantiles import exact
from siltstone.operators.query import ROW, col

SHARE = 0.9
TOP_VALUES = 5
VARIANT_VALUES = 25
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass
class ColumnProfile:
    name: str
    dtype: str
    type: str = "string"
    rows: int = 0
    filled: int = 0
    unique: int = 0
    validity: float = 100.0
    has_space: bool = False
    is_broken: bool = False
    is_serial: bool = False
    is_index: bool = False
    mixed_case: bool = False
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    median: float | None = None
    std: float | None = None
    p25: float | None = None
    p75: float | None = None
    fences: tuple[float, float] | None = None
    outliers: int = 0
    date_min: str | None = None
    date_max: str | None = None
    top: list[tuple[str, int]] = field(default_factory=list)
    variants: dict[str, str] = field(default_factory=dict)

    @property
    def missing(self) -> int:
        return self.rows - self.filled

    @property
    def completeness(self) -> float:
        return round2(100 * self.filled / self.rows) if self.rows else 100.0


@dataclass(frozen=True)
class Diagnostic:
    id: str
    rule: str
    severity: str
    column: str | None
    message: str
    fix: tuple | None = None
    manual: bool = False
    skipped: bool = False


@dataclass
class Profile:
    rows: int
    columns: list[ColumnProfile]
    duplicates: int
    blank_rows: bool
    diagnostics: list[Diagnostic] = field(default_factory=list)
    health: dict[str, int] = field(default_factory=dict)

    def __getitem__(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def _hashed(name: str, dtype: str) -> list[Column]:
    """What stands for a cell in a hash: values of plain types as they are, others as text; null is no value, and 0 is told from -0 as in text."""
    c = col(name)
    if dtype in ("float", "double"):
        return [c, c.isNull(), F.when(c == 0, text_sign(c))]
    if dtype in (*_NUMBERS, "boolean", "date", "timestamp_ntz") or dtype.startswith("decimal"):
        return [c, c.isNull()]
    return [F.coalesce(cells.text_of(c), F.lit("\0"))]


def text_sign(c: Column) -> Column:
    return cells.text_of(c).startswith("-")


def duplicate_rows(df: DataFrame) -> int:
    """How many rows repeat an earlier one: rows are grouped by two hashes of all cells, so no text is shuffled."""
    types = dict(df.dtypes)
    parts = [x for c in data_columns(df) for x in _hashed(c, types[c])]
    groups = df.groupBy(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("b")).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]


def _facts(name: str, dtype: str) -> dict[str, Column]:
    """Counts from which the type and findings of a column that holds no text follow."""
    c = col(name)
    out = {"filled": F.count(c)}
    if dtype in _NUMBERS or dtype.startswith("decimal"):
        n = cells.finite(c)
        out |= {"numeric": F.count(n), "serials": F.count_if(cells.in_days(n))}
    return out


def _text_facts(df: DataFrame, columns: list[str]) -> dict[str, dict[str, int]]:
    """The same of columns of text. Their cells are stacked, so that the code does not grow with columns, and each step is worked out once for a cell."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), col(c).alias("c")) for i, c in enumerate(columns)))).alias("x")).select("x.i", "x.c")
    s, n, style = F.col("s"), F.col("n"), F.col("style")
    rows = rows.select("i", "c", cells.trim(F.col("c")).alias("s")).select("i", "c", "s", cells.style_of_trimmed(s).alias("style"))
    rows = cells.with_numbers(rows, {"n": "s"})
    found = rows.groupBy("i").agg(
        F.count_if(s != "").alias("filled"), F.count(n).alias("numeric"), F.count_if(F.lower(s).isin("true", "false")).alias("boolean"), F.count(cells.date_of_trimmed(s)).alias("dates"),
        F.count_if(cells.in_days(n)).alias("serials"), F.count_if(s.rlike(r"^0\d+$")).alias("zeros"), F.count_if((s != "") & (F.col("c") != cells.squeeze_trimmed(s))).alias("space"),
        F.count_if((s != "") & cells.is_broken(F.col("c"))).alias("broken"), F.count_if(style != "none").alias("letters"), F.count_if(style == "mixed").alias("mixed"), F.count_if(style.isin("lower", "upper")).alias("stray"),
    )
    got = {columns[r["i"]]: {k: v for k, v in r.asDict().items() if k != "i"} for r in found.collect()}
    return {c: got.get(c, {"filled": 0}) for c in columns}


def infer_type(name: str, dtype: str, facts: dict, unique: int) -> tuple[str, bool]:
    """The type that nine tenths of the cells have, and whether its dates are spreadsheet serials."""
    n = facts["filled"]
    share = lambda key: facts.get(key, 0) >= SHARE * n
    if not n:
        return "string", False
    if dtype == "boolean":
        return "boolean", False
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return "date", False
    if names.DATE_NAME.search(name) and share("numeric") and facts.get("serials", 0) >= SHARE * max(facts["numeric"], 1):
        return "date", True
    if share("boolean"):
        return "boolean", False
    if share("numeric") and not names.is_identifier(name) and not facts.get("zeros"):
        return "number", False
    if share("dates"):
        return "date", False
    return ("category" if unique < 15 and unique < 0.15 * n else "string"), False


def _conforming(kind: str, serial: bool, facts: dict) -> int:
    if kind == "number":
        return facts.get("numeric", facts["filled"])
    if kind == "boolean":
        return facts.get("boolean", facts["filled"])
    if kind == "date":
        return facts.get("serials" if serial else "dates", facts["filled"])
    return facts["filled"]


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (trimmed text), n, first row: one long aggregation over the given columns."""
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), cells.trim(col(c)).alias("value")) for c in columns)))
    rows = df.select(F.col(ROW), stacked.alias("x")).select("x.*", ROW).filter(F.col("value") != "")
    return rows.groupBy("column", "value").agg(F.count("*").alias("n"), F.min(ROW).alias("first"))


def hashed_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, h and t (hashes of the cell's text as it is and trimmed), n, first row: what distinct and top values are counted from, without moving any text."""
    types = dict(df.dtypes)

    def one(i: int, name: str) -> Column:
        c, parts = col(name), _hashed(name, types[name])
        if len(parts) > 1:
            h = t = F.when(c.isNotNull(), F.xxhash64(*parts))
        else:
            h, t = F.xxhash64(cells.text_of(c)), F.when(c.isNotNull(), F.xxhash64(cells.trim(c)))
        return F.struct(F.lit(i).alias("i"), h.alias("h"), t.alias("t"))

    rows = df.select(F.col(ROW), F.explode(F.array(*(one(i, c) for i, c in enumerate(columns)))).alias("x")).select("x.*", ROW).filter(F.col("t") != F.xxhash64(F.lit("")))
    counts = rows.groupBy("i", "h", "t").agg(F.count("*").alias("n"), F.min(ROW).alias("first"))
    return counts.select(F.get(F.array(*map(F.lit, columns)), F.col("i")).alias("column"), "h", "t", "n", "first")


def top_values(df: DataFrame, counts: DataFrame, most: int = VARIANT_VALUES) -> dict[str, list[tuple[str, int]]]:
    """Each column's commonest values, trimmed, with their rows; ties by first row.

    Spark keeps ``most`` rows of a column in each task before any shuffle. The
    texts come from the rows in which the values stand first.
    """
    order = W.partitionBy("column").orderBy(F.desc("n"), "first")
    best = counts.groupBy("column", "t").agg(F.sum("n").alias("n"), F.min("first").alias("first")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).collect()
    if not best:
        return {}
    wanted = df.sparkSession.createDataFrame([(r["first"], r["column"]) for r in best], "__row long, __column string")
    names_ = sorted({r["column"] for r in best})
    texts = F.create_map(*(x for c in names_ for x in (F.lit(c), cells.trim(col(c)))))
    found = df.select(F.col(ROW), texts.alias("t")).join(F.broadcast(wanted), F.col(ROW) == F.col("__row")).select("__column", "__row", F.element_at("t", F.col("__column")).alias("v"))
    text = {(r["__column"], r["__row"]): r["v"] for r in found.collect()}
    out: dict[str, list[tuple[str, int]]] = {}
    for r in sorted(best, key=lambda r: r["k"]):
        out.setdefault(r["column"], []).append((text[r["column"], r["first"]], r["n"]))
    return out


def variants(counts: list[tuple[str, int]]) -> dict[str, str]:
    """Rare spelling to common one, for values in order of count: the same key, a plural, or a typo of up to two letters."""
    def key(s: str) -> str:
        return " ".join(s.lower().replace(" - ", "-").split())

    def near(a: str, b: str) -> bool:
        if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 5:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1] <= 2

    out: dict[str, str] = {}
    for rare, n in counts:
        for common, m in counts:
            a, b = key(rare), key(common)
            if common != rare and m >= 2 and m >= 2 * n and common not in out and (a == b or a == b + "s" or b == a + "s" or near(a, b)):
                out[rare] = common
                break
    return out


#: Rows of one stretch in which an index column's order is looked at.
STRETCH = 1_000_000


def index_columns(df: DataFrame, candidates: list[str], rows: int) -> set[str]:
    """Whole numbers that never fall in row order, nearly all different, from 0 or 1 on without a gap at the end.

    Rows are compared with the row before them in stretches of up to a million, by the
    rows' numbers, and then the stretches' ends with each other; so no task has all rows.
    Only columns whose least value is 0 or 1 get here.
    """
    out: set[str] = set()
    types = dict(df.dtypes)
    for c in candidates if rows >= 5 else []:
        v = df.select(F.col(ROW), cells.as_number(col(c), types[c]).alias("v"))  # not filtered: a filter would be pushed below the steps and work each out again
        part, place = F.shiftright(ROW, 33), F.floor(F.pmod(F.col(ROW), F.lit(1 << 33)) / STRETCH)
        v = v.select("v", ROW, part.alias("p"), place.alias("s"))
        v = v.withColumn("before", F.last("v", True).over(W.partitionBy("p", "s").orderBy(ROW).rowsBetween(W.unboundedPreceding, -1)))
        at = F.when(F.col("v").isNotNull(), F.col(ROW))
        ends = v.groupBy("p", "s").agg(
            F.count("v").alias("n"), F.count_if(F.col("v") < F.col("before")).alias("falls"), F.count_if(F.col("v") > F.col("before")).alias("rises"),
            F.count_if(F.col("v") != F.floor("v")).alias("broken"), F.min_by("v", at).alias("first"), F.max_by("v", at).alias("last"),
        ).filter("n > 0")
        ends = ends.withColumn("before", F.lag("last").over(W.orderBy("p", "s")))  # a row for each stretch
        x = ends.agg(
            F.sum("n").alias("n"), F.sum("falls") + F.count_if(F.col("first") < F.col("before")), F.sum("rises") + F.count_if(F.col("first") > F.col("before")) + 1,
            F.sum("broken"), F.min_by("first", F.struct("p", "s")), F.max_by("last", F.struct("p", "s")),
        ).first()
        n, falls, unique, broken, first, last = x
        if (n or 0) >= 5 and not falls and not broken and unique >= 0.95 * n and first in (0, 1) and first + unique - 1 == last:
            out.add(c)
    return out


def profile(df: DataFrame, skipped: frozenset[str] = frozenset()) -> Profile:
    """The profile of a DataFrame that has ROW (see ``query.with_rows``)."""
    types = dict(df.dtypes)
    columns = [c for c in data_columns(df) if not types[c].startswith(("array", "map", "struct", "binary"))]
    texts = [c for c in columns if types[c] == "string"]
    wide = {f"{i}:{k}": v for i, c in enumerate(columns) if c not in texts for k, v in _facts(c, types[c]).items()}
    blank = F.lit(True)
    for c in columns:
        blank = blank & cells.is_blank(col(c), types[c])
    first = df.agg(F.count("*").alias("rows"), F.count_if(blank).alias("blank"), *(v.alias(k) for k, v in wide.items())).first().asDict()
    by_text = _text_facts(df, texts) if texts else {}
    rows = first["rows"]
    counts = hashed_counts(df, columns).persist() if columns else None
    per = {r["column"]: r["unique"] for r in counts.groupBy("column").agg(F.count("*").alias("unique")).collect()} if columns else {}
    out: list[ColumnProfile] = []
    for i, c in enumerate(columns):
        facts = by_text.get(c) or {k.split(":")[1]: v for k, v in first.items() if k.startswith(f"{i}:")}
        unique = per.get(c, 0)
        kind, serial = infer_type(c, types[c], facts, unique)
        p = ColumnProfile(c, types[c], kind, rows, facts["filled"], unique, is_serial=serial)
        p.validity = round2(100 * _conforming(kind, serial, facts) / facts["filled"]) if facts["filled"] else 100.0
        p.has_space, p.is_broken = bool(facts.get("space")), bool(facts.get("broken"))
        letters = facts.get("letters", 0)
        p.mixed_case = letters >= 5 and facts["mixed"] >= 0.6 * letters and facts["stray"] >= 1
        out.append(p)
    worded = [p for p in out if p.type not in ("number", "date")]
    top = top_values(df, counts.filter(F.col("column").isin(*(p.name for p in worded)))) if worded else {}
    for p in worded:
        p.top = top.get(p.name, [])[:TOP_VALUES]
        if p.dtype == "string" and 2 <= p.unique <= VARIANT_VALUES:
            p.variants = variants(top[p.name])
    if counts is not None:
        counts.unpersist()
    _numbers(df, types, out, rows)
    _dates(df, types, out)
    found = Profile(rows, out, duplicate_rows(df), bool(first["blank"]))
    found.diagnostics = diagnose(found, skipped)
    found.health = health(found)
    return found


def _as_numbers(df: DataFrame, types: dict[str, str], columns: list[str]) -> DataFrame:
    """ROW and the given columns as numbers, texts in steps that are worked out once each."""
    kept = [(cells.trim(col(c)) if types[c] == "string" else cells.as_number(col(c), types[c])).alias(f"x{i}") for i, c in enumerate(columns)]
    texts = {f"n{i}": f"x{i}" for i, c in enumerate(columns) if types[c] == "string"}
    rows = cells.with_numbers(df.select(F.col(ROW), *kept), texts) if texts else df.select(F.col(ROW), *kept)
    return rows.select(ROW, *(F.col(f"n{i}" if f"n{i}" in texts else f"x{i}").alias(c) for i, c in enumerate(columns)))


def _numbers(df: DataFrame, types: dict[str, str], columns: list[ColumnProfile], rows: int) -> None:
    nums = [p for p in columns if p.type == "number" or (types[p.name] in _NUMBERS)]
    if not nums:
        return
    df = _as_numbers(df, types, [p.name for p in nums])
    n = {p.name: col(p.name) for p in nums}
    aggs = [F.struct(F.min(x), F.max(x), F.avg(x), F.stddev_samp(x), F.count(x)) for x in n.values()]
    got = df.agg(*(a.alias(str(i)) for i, a in enumerate(aggs))).first()
    quartiles = exact(df, n, [0.25, 0.5, 0.75], {p.name: got[i][4] for i, p in enumerate(nums)})
    outside = []
    raw: dict[str, tuple[float, float]] = {}
    for i, p in enumerate(nums):
        low, high, mean, std, count = got[i]
        if not count:
            continue
        a, m, b = quartiles[p.name][0]
        p.min, p.max, p.mean, p.median, p.p25, p.p75, p.std = map(round2, (low, high, mean, m, a, b, std or 0.0))
        raw[p.name] = (a - 1.5 * (b - a), b + 1.5 * (b - a))
        if count >= 4:
            p.fences = raw[p.name]
        outside.append(F.count_if((n[p.name] < raw[p.name][0]) | (n[p.name] > raw[p.name][1])).alias(p.name))
    index = index_columns(df, [p.name for p in nums if p.min in (0, 1)], rows)
    counts = df.agg(*outside).first().asDict() if outside else {}
    for p in nums:
        p.is_index = p.name in index
        p.outliers = 0 if p.is_index or p.type != "number" else counts.get(p.name, 0)


def _dates(df: DataFrame, types: dict[str, str], columns: list[ColumnProfile]) -> None:
    from siltstone.operators.aggregates import when

    dates = [p for p in columns if p.type == "date"]
    if not dates:
        return
    texts = [i for i, p in enumerate(dates) if p.dtype == "string"]
    rows = df.select(*((cells.trim(col(p.name)) if i in texts else F.date_format(when(df, p.name), "yyyy-MM-dd")).alias(f"x{i}") for i, p in enumerate(dates)))
    rows = cells.with_numbers(rows, {f"n{i}": f"x{i}" for i in texts}) if texts else rows
    of_text = lambda s, n: F.coalesce(F.date_format(cells.date_of_trimmed(s), "yyyy-MM-dd"), F.when(cells.in_days(n), cells.day_of_serial(n)))
    rows = rows.select(*((of_text(F.col(f"x{i}"), F.col(f"n{i}")) if i in texts else F.col(f"x{i}")).alias(p.name) for i, p in enumerate(dates)))
    day = {p.name: col(p.name) for p in dates}
    got = rows.agg(*(F.min(x) for x in day.values()), *(F.max(x) for x in day.values())).first()
    for i, p in enumerate(dates):
        p.date_min, p.date_max = got[i], got[len(dates) + i]


def is_repeated_id(p: ColumnProfile) -> bool:
    return p.filled > 4 and p.unique < p.filled and (names.is_identifier(p.name) or p.is_index)


def diagnose(p: Profile, skipped: frozenset[str] = frozenset()) -> list[Diagnostic]:
    """Findings in the order in which they are repaired; a fix is a cleaning operation (see ``clean``)."""
    out: list[Diagnostic] = []

    def add(rule: str, severity: str, column: str | None, message: str, fix: tuple | None = None, manual: bool = False) -> None:
        ident = f"{rule}:{column}" if column else rule
        out.append(Diagnostic(ident, rule, severity, column, message, fix, manual, ident in skipped or rule in skipped))

    for c in p.columns:
        if c.is_index:
            add("index", "info", c.name, f"{c.name} only numbers the rows", ("dropColumn", c.name))
    if any(c.is_broken for c in p.columns):
        add("encoding", "warning", None, "text with broken characters", ("fixEncoding",))
    for c in p.columns:
        if c.is_serial:
            add("serial", "warning", c.name, f"{c.name} holds spreadsheet day numbers", ("convertExcelDates", c.name))
    if p.duplicates:
        add("duplicates", "warning", None, f"{p.duplicates} rows repeat an earlier one", ("dropDuplicates",))
    for c in p.columns:
        if is_repeated_id(c):
            add("repeatedId", "warning", c.name, f"{c.filled - c.unique} repeated values in {c.name}")
    if p.blank_rows:
        add("emptyRows", "info", None, "rows without any value", ("dropEmptyRows",))
    if any(c.has_space for c in p.columns):
        add("whitespace", "info", None, "spaces at edges or doubled", ("trimWhitespace",))
    for c in p.columns:
        if c.mixed_case:
            add("casing", "info", c.name, f"{c.name} mixes ways to write capitals", ("standardizeCase", c.name))
        if c.variants:
            add("variants", "info", c.name, f"{len(c.variants)} spellings in {c.name} look like others", ("mergeValues", c.name, c.variants))
    for c in p.columns:
        if c.missing:
            add("missing", "warning", c.name, f"{c.missing} cells of {c.name} are blank", ("fillMissing", c.name, "median" if c.type == "number" else "mode"))
    for c in p.columns:
        if c.outliers:
            add("outliers", "info", c.name, f"{c.outliers} values of {c.name} outside its fences", ("capOutliers", c.name), True)
    for c in p.columns:
        if c.validity < 100:
            add("typeMismatch", "warning", c.name, f"{c.name} holds values that are no {c.type}")
    return out


# What each kind of finding takes from consistency.
PENALTY = {"duplicates": 10, "whitespace": 5, "encoding": 15, "casing": 10, "variants": 10, "serial": 5, "repeatedId": 5}


def health(p: Profile) -> dict[str, int]:
    """overall, completeness, validity, accuracy, consistency from 0 to 100; skipped findings do not count."""
    skipped = {(d.rule, d.column) for d in p.diagnostics if d.skipped}
    share = [100 * c.filled / c.rows if c.rows and ("missing", c.name) not in skipped else 100.0 for c in p.columns]
    complete = sum(share) / len(share) if share else 100.0
    valid = sum(100.0 if ("typeMismatch", c.name) in skipped else c.validity for c in p.columns) / len(p.columns) if p.columns else 100.0
    nums = [c for c in p.columns if c.type == "number" and not c.is_index and c.filled]
    within = [100.0 if ("outliers", c.name) in skipped else 100 * (1 - c.outliers / c.filled) for c in nums]
    accurate = sum(within) / len(within) if within else 100.0
    found = {d.rule for d in p.diagnostics if not d.skipped}
    consistent = max(10, 100 - sum(v for k, v in PENALTY.items() if k in found))
    overall = 0.4 * complete + 0.2 * valid + 0.2 * accurate + 0.2 * consistent
    return {"overall": nearest(overall), "completeness": nearest(complete), "validity": nearest(valid), "accuracy": nearest(accurate), "consistency": nearest(consistent)}


def skip(p: Profile, what: str, skipped: bool = True) -> Profile:
    """The profile with a finding, or a rule's findings, left out of the score (or back in)."""
    marked = [replace(d, skipped=skipped) if what in (d.id, d.rule) else d for d in p.diagnostics]
    out = replace(p, diagnostics=marked)
    out.health = health(out)
    return out


def unskip(p: Profile, what: str) -> Profile:
    return skip(p, what, False)


def describe(name: str, p: Profile, changes: int = 0) -> str:
    """A dataset in one line: size, health, and whether it has been changed."""
    return f"{name}: {p.rows} rows, {len(p.columns)} columns, health {p.health.get('overall', 100)}" + (f", changed by {changes} steps" if changes else "")


def profile_table(p: Profile, spark) -> DataFrame:
    """One row per column."""
    rows = [(c.name, c.type, c.rows, c.filled, c.unique, c.completeness, c.validity, c.min, c.max, c.mean, c.median, c.std, c.p25, c.p75, c.outliers, c.date_min, c.date_max) for c in p.columns]
    return spark.createDataFrame(rows, "column string, type string, rows long, filled long, unique long, completeness double, validity double, min double, max double, mean double, median double, std double, p25 double, p75 double, outliers long, date_min string, date_max string")
