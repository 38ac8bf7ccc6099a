"""Text column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace set of Python's ``str.split()`` with no argument
# (ASCII controls 09-0D and 1C-1F, space, 85, A0, 1680, 2000-200A, 2028,
# 2029, 202F, 205F, 3000), written as a Java regex class.
WHITESPACE_RUN = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Lower-case whitespace tokens: no empty tokens, null text gives null."""
    parts = F.split(F.lower(col_of(text)), WHITESPACE_RUN)
    return F.array_remove(parts, "")  # code-generated, unlike a lambda filter


def term_counts(toks) -> Column:
    """(term, tf) of each distinct token, in order, from the sorted tokens' runs: a text is counted within its own
    row, so nothing is shuffled or gathered for it.  Null or no tokens: null or no entries."""
    def runs(s):
        first = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: ~F.get(s, i - 2).eqNullSafe(F.get(s, i - 1)))
        # bound as a lambda's argument, so that it is computed once per row
        return F.transform(F.array(first), lambda f: F.transform(f, lambda i, j: F.struct(
            F.get(s, i - 1).alias("term"),
            (F.coalesce(F.get(f, j + 1), F.size(s) + 1) - i).cast("bigint").alias("tf"))))[0]

    some = F.when(F.size(toks) > 0, F.sort_array(toks))
    return F.transform(F.array(some), runs)[0]


def null_safe_ne(c, value) -> Column:
    """``c != value`` that keeps nulls (pandas semantics for ``!=``)."""
    return ~col_of(c).eqNullSafe(F.lit(value))


def null_safe_not_in(c, values) -> Column:
    """``~c.isin(values)`` that keeps nulls (pandas ``~isin`` semantics)."""
    return ~F.coalesce(col_of(c).isin(list(values)), F.lit(False))


def literal_replace_chain(c, pairs) -> Column:
    """Apply literal (non-regex) replacements in the given order."""
    out = col_of(c)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def preview(c, n: int, flatten_newlines: bool = False, ellipsis: bool = False) -> Column:
    """First ``n`` code points; optionally newline -> space and a trailing '...'."""
    out = F.substring(col_of(c), 1, n)
    if flatten_newlines:
        out = F.replace(out, F.lit("\n"), F.lit(" "))
    if ellipsis:
        out = F.concat(out, F.lit("..."))
    return out


def is_truthy_text(c) -> Column:
    """Python truthiness of an optional string: not null and not empty."""
    return F.coalesce(col_of(c), F.lit("")) != F.lit("")


def py_str(c) -> Column:
    """Python f-string rendering of an optional value (None prints as 'None')."""
    return F.coalesce(col_of(c).cast("string"), F.lit("None"))


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace (all kinds)."""
    return F.regexp_replace(col_of(c), f"^{WHITESPACE_RUN}|{WHITESPACE_RUN}$", "")


def require_columns(df, *cols: str):
    """Fail fast when a required input column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    return df


def label_or_row(df, label_col: str, id_col: str) -> Column:
    """The label column when the input has it (null label -> ``Row {id}``),
    otherwise ``Row {id}`` for every row."""
    fallback = F.concat(F.lit("Row "), F.col(id_col).cast("string"))
    return F.coalesce(F.col(label_col), fallback) if label_col in df.columns else fallback


def fixed_point(c, digits: int = 3) -> Column:
    """``%.{digits}f`` of a double as C prints it: the exact binary value is rounded, ties to even, not the shortest
    decimal.  Exact for magnitudes below 2^20, in decimal arithmetic on the value times 2^64."""
    x = F.abs(col_of(c))
    high = F.floor(x * float(2 ** 32))
    low = F.floor((x * float(2 ** 32) - high) * float(2 ** 32))         # what is cut off here is below 2^-64
    whole = (high.cast("decimal(20,0)") * F.lit(2 ** 32).cast("decimal(10,0)") + low.cast("decimal(11,0)")).cast("decimal(32,0)")
    scaled = (whole * F.lit(10 ** digits).cast("decimal(5,0)")).cast("decimal(38,0)")
    one = F.lit(str(2 ** 64)).cast("decimal(20,0)")
    q = F.call_function("div", scaled, one)
    r = (scaled - q.cast("decimal(20,0)") * one).cast("decimal(38,0)")
    twice = (r * F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)")
    q = q + F.when((twice > one) | ((twice == one) & (F.pmod(q, F.lit(2)) == 1)), 1).otherwise(0)
    unit = 10 ** digits
    text = F.concat(F.when(col_of(c) < 0, F.lit("-")).otherwise(F.lit("")), F.call_function("div", q, F.lit(unit).cast("long")).cast("string"),
                    F.lit("."), F.lpad(F.pmod(q, F.lit(unit)).cast("string"), digits, "0"))
    return F.when(x < float(2 ** 20), text).otherwise(F.format_string(f"%.{digits}f", col_of(c)))
