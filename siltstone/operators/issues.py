"""Problem cells with their addresses, and counts by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators.clean import repeated_positions
from siltstone.operators.profile import ColumnProfile, Profile
from siltstone.operators.query import ROW, col

MOST = 500


def column_letter(k: int) -> str:
    """A for 0, Z for 25, AA for 26."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _cells(df: DataFrame, p: Profile) -> DataFrame:
    """row, and for each column its cell (``c``), trimmed (``s``) and as a number (``n``), so that each is worked out once."""
    types = dict(df.dtypes)
    out = df.select(F.col(ROW).alias("row"), *(col(c.name).alias(f"c{i}") for i, c in enumerate(p.columns)))
    texts = [i for i, c in enumerate(p.columns) if c.dtype == "string"]
    out = out.select("*", *(cells.trim(F.col(f"c{i}")).alias(f"s{i}") for i in texts))
    plain = [(i, c) for i, c in enumerate(p.columns) if i not in texts]
    out = out.select("*", *(cells.as_number(F.col(f"c{i}"), types[c.name]).alias(f"n{i}") for i, c in plain))
    return cells.with_numbers(out, {f"n{i}": f"s{i}" for i in texts})


def _rules(i: int, c: ColumnProfile) -> list[tuple[str, Column, Column]]:
    """Name, condition and proposed value of each rule for a cell that is not blank."""
    x, s, n = F.col(f"c{i}"), F.col(f"s{i}"), F.col(f"n{i}")
    rules = []
    if c.dtype == "string":
        rules += [("encoding", cells.is_broken(x), cells.fix_encoding(x)), ("whitespace", x != cells.squeeze_trimmed(s), cells.squeeze_trimmed(s))]
        if c.mixed_case:
            rules.append(("casing", cells.style_of_trimmed(s).isin("lower", "upper"), cells.standard_case(x)))
        if c.variants:
            table = F.create_map(*(F.lit(v) for pair in c.variants.items() for v in pair))
            rules.append(("variants", F.element_at(table, s).isNotNull(), F.element_at(table, s)))
    if c.is_serial:
        rules.append(("serial", cells.in_days(n), cells.serial_day(x)))
    if c.outliers and c.fences:
        low, high = c.fences
        rules.append(("outliers", (n < low) | (n > high), F.when(n < low, F.lit(low)).otherwise(F.lit(high)).cast("string")))
    wrong = {"number": lambda: n.isNull(), "boolean": lambda: ~F.lower(s).isin("true", "false"), "date": lambda: cells.date_of_trimmed(s).isNull() & ~cells.in_days(n)}.get(c.type if c.dtype == "string" else "")
    return [*rules, ("typeMismatch", wrong(), F.lit(None).cast("string"))] if wrong else rules


def _blank(i: int, c: ColumnProfile) -> Column:
    return F.coalesce(F.col(f"s{i}") == "", F.lit(True)) if c.dtype == "string" else F.col(f"c{i}").isNull()


def _in_cells(df: DataFrame, p: Profile) -> DataFrame:
    parts = []
    for i, c in enumerate(p.columns):
        text = cells.text_of(F.col(f"c{i}"))
        issue = lambda rule, proposed, c=c, text=text: F.struct(F.lit(c.name).alias("column"), F.lit(rule).alias("rule"), text.alias("value"), proposed.alias("proposed"))
        blank, rules = F.array(issue("missing", F.lit(None).cast("string"))), _rules(i, c)
        hits = F.filter(F.array(*(F.when(F.coalesce(on, F.lit(False)), issue(rule, fix)) for rule, on, fix in rules)), lambda x: x.isNotNull()) if rules else F.slice(blank, 1, 0)
        parts.append(F.when(_blank(i, c), blank).otherwise(hits))
    return _cells(df, p).select("row", F.explode(F.flatten(F.array(*parts))).alias("i")).select("row", "i.*")


def _repeated(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return repeated_positions(df).select("row", none.alias("column"), F.lit("duplicates").alias("rule"), none.alias("value"), none.alias("proposed"))


def cell_issues(df: DataFrame, p: Profile) -> DataFrame:
    """row, column, rule, value, proposed: a blank cell has that rule alone; others may break several."""
    return _in_cells(df, p).unionByName(_repeated(df))


def counts_by_rule(df: DataFrame, p: Profile) -> dict[str, int]:
    """How many cells break each rule, in one aggregation that makes no row of a cell and no proposal; repeated rows are known from the profile."""
    found = []
    for i, c in enumerate(p.columns):
        blank = _blank(i, c)
        found += [("missing", F.count_if(blank)), *((rule, F.count_if(~blank & F.coalesce(on, F.lit(False)))) for rule, on, _ in _rules(i, c))]
    got = _cells(df, p).agg(*(n.alias(str(k)) for k, (_, n) in enumerate(found))).first() if found else []
    counts = {"duplicates": p.duplicates}
    for (rule, _), n in zip(found, got, strict=True):
        counts[rule] = counts.get(rule, 0) + n
    return {rule: n for rule, n in counts.items() if n}


def report(df: DataFrame, p: Profile, most: int = MOST) -> tuple[dict[str, int], list[dict]]:
    """Exact counts by rule, and the first cells by row and column with their addresses (the header is row 1)."""
    counts = counts_by_rule(df, p)
    order = {c.name: i for i, c in enumerate(p.columns)}
    found = _first(df, p, most)
    if p.duplicates:
        found = found.unionByName(_repeated(df).orderBy("row").limit(most))
    rows = [r.asDict() for r in found.orderBy("row", "column").limit(most).collect()]
    for r in rows:
        r["cell"] = f"{column_letter(order[r['column']]) if r['column'] else 'A'}{r['row'] + 2}"
    return counts, rows


def _first(df: DataFrame, p: Profile, most: int) -> DataFrame:
    """Cells with an issue up to the row in which the first ``most`` of them are reached; values and proposals are made for these rows alone."""
    hit = F.lit(False)
    for i, c in enumerate(p.columns):
        for on in [_blank(i, c), *(on for _, on, _ in _rules(i, c))]:
            hit = hit | F.coalesce(on, F.lit(False))
    rows = [r["row"] for r in _cells(df, p).filter(hit).select("row").orderBy("row").limit(most).collect()]
    return _in_cells(df.filter(F.col(ROW) <= (rows[-1] if rows else -1)), p)
