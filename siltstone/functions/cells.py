"""Cell policies as Column expressions: blanks, numbers, dates, booleans, text repair.

Every function takes a Column and stays inside Spark's code generation.
"""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that a spreadsheet user would not see, beyond what ``\\s`` matches; as a regular expression's class and one by one.
SPACES = "\\s\\u00a0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACE_CHARS = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def text_of(c: Column) -> Column:
    return c.cast("string")


def trim(c: Column) -> Column:
    """Without white space of any kind at the edges."""
    return F.btrim(text_of(c), F.lit(_SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Trimmed, and runs of white space inside made one blank."""
    return squeeze_trimmed(trim(c))


def squeeze_trimmed(s: Column) -> Column:
    """:func:`squeeze` of a text without white space at its edges."""
    return F.regexp_replace(s, f"[{SPACES}]{{2,}}", " ")


def is_blank(c: Column, dtype: str = "string") -> Column:
    """Null or nothing but white space; a value of another type than text is never made text to see that."""
    return c.isNull() | (trim(c) == "") if dtype == "string" else c.isNull()


def number(c: Column) -> Column:
    """The number that a cell shows, or null.

    ``(5)`` is -5; currency signs, thousands separators, percent signs and white
    space are dropped; other signs, infinities and NaN give null.
    """
    s = trim(c)
    value = value_of_bare(bare_of_trimmed(s))
    value = F.when(F.abs(value) < float("inf"), value)
    return F.when(_negative(s), -value).otherwise(value)


def _negative(s: Column) -> Column:
    return s.startswith("(") & s.endswith(")")


def bare_of_trimmed(s: Column) -> Column:
    """What is left of a trimmed cell without brackets and the signs that a number may have."""
    return F.translate(F.when(_negative(s), F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s), "$€£¥₦,%" + _SPACE_CHARS, "")


def value_of_bare(bare: Column) -> Column:
    return F.when(bare.rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"), bare.try_cast("double"))


def with_numbers(df: DataFrame, trimmed: dict[str, str]) -> DataFrame:
    """``df`` with the number of each trimmed column under a name of its own. What :func:`number` writes as one expression is worked out in steps here, each once."""
    kept = [F.col(c) for c in df.columns]
    df = df.select("*", *(bare_of_trimmed(F.col(s)).alias(f"__bare_{n}") for n, s in trimmed.items()))
    df = df.select(*kept, *(value_of_bare(F.col(f"__bare_{n}")).alias(f"__value_{n}") for n in trimmed))
    finite_ = lambda n, s: F.when(F.abs(F.col(f"__value_{n}")) < float("inf"), F.col(f"__value_{n}") * F.when(_negative(F.col(s)), -1.0).otherwise(1.0))
    return df.select(*kept, *(finite_(n, s).alias(n) for n, s in trimmed.items()))


def finite(c: Column) -> Column:
    """A typed number without NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def as_number(c: Column, dtype: str) -> Column:
    """``number`` for strings, ``finite`` for numeric types, null for all else."""
    if dtype == "string":
        return number(c)
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return finite(c)
    return F.lit(None).cast("double")


def is_boolean(c: Column) -> Column:
    return F.lower(trim(c)).isin("true", "false")


def is_truthy(c: Column) -> Column:
    return F.coalesce(F.lower(trim(c)).isin(*TRUTHY), F.lit(False))


def is_won(c: Column) -> Column:
    return F.coalesce(F.lower(trim(c)).isin(*WON), F.lit(False))


# Words that read as yes, and states that count as success.
TRUTHY = ["true", "yes", "y", "1", "active", "converted", "won", "paid", "completed", "complete", "success", "successful", "delivered", "approved", "renewed", "subscribed"]
WON = ["won", "converted", "closed won", "complete", "completed", "delivered", "paid", "success", "successful", "approved", "shipped", "fulfilled", "active", "subscribed", "renewed"]

# Shapes a date must have, with the formats that read it (month first).
DATE_SHAPES = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$", None),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.yyyy"),
]


def strict_date(c: Column) -> Column:
    """Timestamp of a cell of one of the known shapes, else null; days that no month has give null."""
    return date_of_trimmed(trim(c))


def date_of_trimmed(s: Column) -> Column:
    """:func:`strict_date` of a text without white space at its edges."""
    out = F.lit(None).cast("timestamp")
    for shape, form in reversed(DATE_SHAPES):
        read = F.try_to_timestamp(s, F.lit(form)) if form else s.try_cast("timestamp")
        out = F.when(s.rlike(shape), read).otherwise(out)
    return F.when(s.rlike(r"^\d{1,4}[-/.]\d"), out)  # what all shapes begin with


def is_serial(c: Column) -> Column:
    """A whole number from 20000 to 60000: a day as a spreadsheet counts it."""
    return in_days(number(c))


def in_days(n: Column) -> Column:
    """Whether a number is a whole one from 20000 to 60000."""
    return F.coalesce((n == F.floor(n)) & n.between(20000, 60000), F.lit(False))


def serial_day(c: Column) -> Column:
    """ISO day of a spreadsheet serial, counted from 1899-12-30; other cells as they are."""
    return F.when(is_serial(c), day_of_serial(number(c))).otherwise(text_of(c))


def day_of_serial(n: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int")), "yyyy-MM-dd")


def category_key(c: Column) -> Column:
    """What two spellings of a category share: case, spacing, and spaces around hyphens do not count."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim(c)), f"[{SPACES}]*-[{SPACES}]*", "-"), f"[{SPACES}]+", " ")


def case_style(c: Column) -> Column:
    """lower, upper, mixed, or none (no letter at the start)."""
    return style_of_trimmed(trim(c))


def style_of_trimmed(s: Column) -> Column:
    """:func:`case_style` of a text without white space at its edges."""
    return (
        F.when(~F.coalesce(s.rlike(r"^\p{L}"), F.lit(False)), "none").when(s == F.lower(s), "lower").when((s == F.upper(s)) & (F.length(s) > 1), "upper").otherwise("mixed")
    )


def title_case(c: Column) -> Column:
    """Capitals at the start and after a blank, hyphen, point, apostrophe or bracket; other letters small."""
    low = F.lower(text_of(c))
    letters = F.split(low, "")
    return F.array_join(F.transform(letters, lambda ch, i: F.when((i == 0) | F.get(letters, i - 1).isin(" ", "-", ".", "'", "("), F.upper(ch)).otherwise(ch)), "")


def standard_case(c: Column) -> Column:
    """Title case for values all in small or all in capital letters; others as they are."""
    return F.when(case_style(c).isin("lower", "upper"), title_case(c)).otherwise(text_of(c))


# Characters whose broken forms are repaired.
REPAIRED = "–—‘’“”…éèáíóúñüöäç°£ "
BROKEN = "â€|Ã[\u0080-ÿ€‘’“”‚ˆ‹Œ]|Â[\u0080-¿]"


# Signs that copies of broken text lose, with all control characters from 0x80 to 0x9f.
LOST = "€“”‘’…˜™ƒ„"

codecs.register_error("siltstone-latin", lambda e: (e.object[e.start : e.end].decode("latin-1"), e.end))


def _garbled(s: str) -> str:
    """UTF-8 read as code page 1252, or as Latin 1 where that has no character."""
    return s.encode().decode("cp1252", "siltstone-latin")


def repairs() -> list[tuple[str, str]]:
    """Broken form and repair, longest form first: UTF-8 read once or twice as code page 1252, with and without the signs that such copies lose."""
    gone = {ord(c): None for c in LOST} | dict.fromkeys(range(0x80, 0xA0))
    by_good: dict[str, list[str]] = {}
    for good in REPAIRED:
        forms, form = [], good
        for _ in range(2):
            form = _garbled(form)
            forms = [form, form.translate(gone), *forms]
        by_good[good.replace("\u00a0", " ")] = [f for f in forms if len(f) >= 2]
    # a form of two characters belongs to the first of them
    first = {form: good for good, forms in reversed(by_good.items()) for form in reversed(forms) if form != good}
    return sorted(first.items(), key=lambda x: (-len(x[0]), x[0]))


def is_broken(c: Column) -> Column:
    return F.coalesce(text_of(c).rlike(BROKEN), F.lit(False))


def fix_encoding(c: Column) -> Column:
    """Text with its broken characters repaired, in up to two passes."""
    out = text_of(c)
    for _ in range(2):
        fixed = out
        for bad, good in repairs():
            fixed = F.replace(fixed, F.lit(bad), F.lit(good))
        out = F.when(is_broken(out), fixed).otherwise(out)
    return out


def change(before: Column, after: Column) -> Column:
    """Change in percent of the size of ``before``; null if that is 0."""
    return F.when(before != 0, (after - before) / F.abs(before) * 100)
