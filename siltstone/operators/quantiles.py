"""Exact quantiles whose last task holds a bounded number of values, however many distinct ones a column has."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that one task may hold; columns with no more go to Spark's own ``percentile``.
MOST_VALUES = 1_000_000
#: Accuracy of the sketches that narrow the others down: ranks are off by at most this part of the rows.
ACCURACY = 10_000


def _narrowed(rows: DataFrame, wanted: list[tuple[str, int, int]], most: int, accuracy: int) -> list[float]:
    """The value of each (column, rank from 0, count). Each round takes a sketch and a count of all that are still open.

    A round looks for a rank between two values of its column that lie just below and above it. It is one of them, or
    strictly between, where there are at most a few parts in ``accuracy`` of the rows left.
    """
    inside: list[Column] = [F.col(c) for c, _, _ in wanted]
    state = [(rank, n, 2 / accuracy) for _, rank, n in wanted]  # the rank among the n values inside, and the margin
    found: dict[int, float] = {}
    while open_ := [i for i in range(len(wanted)) if i not in found and state[i][1] > most]:
        asked: dict[str | int, list[int]] = {}  # one sketch serves all ranks of a column that is not narrowed yet
        for i in open_:
            asked.setdefault(wanted[i][0] if state[i][1] == wanted[i][2] else i, []).append(i)
        near = lambda rank, n, margin: [max(0.0, rank / n - margin), min(1.0, (rank + 1) / n + margin)]
        sketches = rows.agg(*(F.percentile_approx(inside[ranks[0]], F.array(*(F.lit(x) for i in ranks for x in near(*state[i]))), accuracy).alias(str(k)) for k, ranks in asked.items())).first()
        ends_of = {str(i): sketches[str(k)][2 * j : 2 * j + 2] for k, ranks in asked.items() for j, i in enumerate(ranks)}
        tallies = [F.struct(F.count_if(x < low), F.count_if(x <= low), F.count_if(x < high), F.count_if(x <= high)) for x, (low, high) in ((inside[i], ends_of[str(i)]) for i in open_)]
        tally = rows.agg(*(t.alias(str(i)) for i, t in zip(open_, tallies, strict=True))).first()
        for i in open_:
            rank, n, margin = state[i]
            (low, high), (under, to_low, to_high, upto) = ends_of[str(i)], tally[str(i)]
            if not under <= rank < upto:  # beside the ends: ask again for ones further off
                state[i] = (rank, n, 4 * margin)
            elif rank < to_low:
                found[i] = low
            elif rank >= to_high:
                found[i] = high
            else:
                inside[i] = F.when((inside[i] > low) & (inside[i] < high), inside[i])
                state[i] = (rank - to_low, to_high - to_low, margin)
    rest = [i for i in range(len(wanted)) if i not in found]
    if rest:
        got = rows.agg(*(F.get(F.sort_array(F.collect_list(inside[i])), F.lit(state[i][0])).alias(str(i)) for i in rest)).first()
        found |= {i: got[str(i)] for i in rest}
    return [found[i] for i in range(len(wanted))]


def exact(df: DataFrame, values: dict[str, Column], fractions: list[float], counts: dict[str, int] | None = None, most: int = MOST_VALUES, accuracy: int = ACCURACY) -> dict[str, tuple[list[float], int]]:
    """For each named numeric expression: its quantiles, interpolated as ``percentile`` does, and the count of its values that are not null.

    Without values there are no quantiles (an empty list). Give ``counts`` where they are known, which saves a pass.
    """
    names = list(values)
    rows = df.select(*(values[c].cast("double").alias(f"v{i}") for i, c in enumerate(names)))
    if counts is None:
        got = rows.agg(*(F.count(c).alias(c) for c in rows.columns)).first()
        counts = {c: got[i] for i, c in enumerate(names)}
    out: dict[str, tuple[list[float], int]] = {c: ([], counts[c]) for c in names}
    few = [i for i, c in enumerate(names) if 0 < counts[c] <= most]
    if few:
        got = rows.agg(*(F.percentile(f"v{i}", F.array(*map(F.lit, fractions))).alias(f"v{i}") for i in few)).first()
        out |= {names[i]: (list(got[f"v{i}"]), counts[names[i]]) for i in few}
    many = [i for i, c in enumerate(names) if counts[c] > most]
    wanted = {}
    for i in many:
        n = counts[names[i]]
        for f in fractions:
            low = floor(f * (n - 1))
            wanted |= {(f"v{i}", k, n): None for k in (low, min(low + 1, n - 1))}
    at = dict(zip(wanted, _narrowed(rows, list(wanted), most, accuracy), strict=True))
    for i in many:
        n, found = counts[names[i]], []
        for f in fractions:
            place = f * (n - 1)
            low = floor(place)
            a, b = at[f"v{i}", low, n], at[f"v{i}", min(low + 1, n - 1), n]
            found.append(a if a == b or place == low else (low + 1 - place) * a + (place - low) * b)
        out[names[i]] = found, n
    return out
