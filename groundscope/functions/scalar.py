"""The admitted scalar and aggregate functions with their documented edge cases as Spark columns.

Names follow the admitted list. Where a function of the same name differs in Spark (ASCII-only case
mapping, NULL-propagating two-argument max, total of no rows) the admitted meaning is kept.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


# Date format directives and their Spark patterns.
DATE_DIRECTIVES = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS",
}


def lower(value) -> Column:
    """Only A-Z change case."""
    return F.translate(_col(value), string.ascii_uppercase, string.ascii_lowercase)


def upper(value) -> Column:
    return F.translate(_col(value), string.ascii_lowercase, string.ascii_uppercase)


def like(value, pattern: str, escape: str | None = None) -> Column:
    """LIKE that ignores ASCII case."""
    escape = escape or "\\"
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        i += 1
    return _col(value).rlike(f"^(?is:{out})$")


def contains_ignoring_case(value, term: str) -> Column:
    """LIKE '%term%' with wildcards in the term taken literally."""
    return F.contains(lower(value), lower(F.lit(term)))


def glob(value, pattern: str) -> Column:
    """Case-sensitive GLOB with * ? and character classes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if close > 0:
            body = pattern[i + 1 : close]
            out += "[" + ("^" + body[1:] if body.startswith("^") else body).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return _col(value).rlike(f"^(?s:{out})$")


def substr(value, start: int, length: int | None = None) -> Column:
    """One-based; a negative start counts from the end; start 0 lies before the first character."""
    value = _col(value)
    if length is None:
        return F.substring(value, start or 1, 2147483647)
    if start == 0:
        return F.substring(value, 1, max(length - 1, 0))
    return F.substring(value, start, length)


def greatest(*values) -> Column:
    """Two-argument max: NULL as soon as one argument is NULL."""
    columns = [_col(v) for v in values]
    missing = F.greatest(*[c.isNull().cast("int") for c in columns])
    return F.when(missing == 0, F.greatest(*columns))


def least(*values) -> Column:
    columns = [_col(v) for v in values]
    missing = F.greatest(*[c.isNull().cast("int") for c in columns])
    return F.when(missing == 0, F.least(*columns))


def iif(condition, yes, no) -> Column:
    return F.when(condition, yes).otherwise(no)


def likelihood(condition: Column, probability: float) -> Column:
    """A planner hint: the condition itself."""
    return condition


def instr(value, part: str) -> Column:
    return F.instr(_col(value), part)


def unicode(value) -> Column:
    """Code point of the first character; NULL for an empty text."""
    value = _col(value)
    return F.when(F.length(value) > 0, F.ascii(value))


def typeof(value, storage: str) -> Column:
    """Storage class of a column's values; NULL values have a class of their own."""
    return F.when(_col(value).isNull(), "null").otherwise(storage)


def total(value) -> Column:
    """SUM that is 0.0 without rows."""
    return F.coalesce(F.sum(_col(value).cast("double")), F.lit(0.0))


def group_concat(value, separator: str = ",") -> Column:
    """Concatenation of the values of a group, in sorted order to be reproducible."""
    return F.array_join(F.sort_array(F.collect_list(_col(value))), separator)


def date(value) -> Column:
    return F.date_format(_col(value), "yyyy-MM-dd")


def time(value) -> Column:
    return F.date_format(_col(value), "HH:mm:ss")


def datetime(value) -> Column:
    return F.date_format(_col(value), "yyyy-MM-dd HH:mm:ss")


def unixepoch(value) -> Column:
    """Whole seconds since 1970 in UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _col(value).cast("timestamp_ntz"))


def julianday(value) -> Column:
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _col(value).cast("timestamp_ntz"))
    return micros / F.lit(86400.0 * 1e6) + F.lit(2440587.5)


def strftime(pattern: str, value) -> Column:
    """Directive format; %s (epoch) and %w (weekday, Sunday 0) have no date pattern and are computed."""
    pieces = []
    for part in re.split("(%.)", pattern):
        if part in DATE_DIRECTIVES:
            pieces.append(F.date_format(_col(value), DATE_DIRECTIVES[part]))
        elif part == "%w":
            pieces.append((F.dayofweek(_col(value)) - 1).cast("string"))
        elif part == "%s":
            pieces.append(unixepoch(value).cast("string"))
        elif part == "%%":
            pieces.append(F.lit("%"))
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


def integer_divide(left, right) -> Column:
    """Division of two integers truncates; division by zero is NULL."""
    right = _col(right)
    return F.when(right != 0, (_col(left) - F.try_mod(_col(left), right)) / right).cast("long")


def number(text_value) -> Column:
    """CAST of cleaned numeric text: separators and currency signs removed first."""
    return F.regexp_replace(_col(text_value), r"[$£€¥,%\s]", "").try_cast("double")


FUNCTIONS = {
    "abs": F.abs, "avg": F.avg, "coalesce": F.coalesce, "count": F.count, "date": date, "datetime": datetime,
    "glob": glob, "group_concat": group_concat, "hex": F.hex, "ifnull": F.ifnull, "iif": iif, "instr": instr,
    "julianday": julianday, "length": F.char_length, "like": like, "likelihood": likelihood, "lower": lower,
    "ltrim": F.ltrim, "max": F.max, "min": F.min, "nullif": F.nullif, "replace": F.replace, "round": F.round,
    "rtrim": F.rtrim, "strftime": strftime, "substr": substr, "substring": substr, "sum": F.sum, "time": time,
    "total": total, "trim": F.trim, "typeof": typeof, "unicode": unicode, "unixepoch": unixepoch, "upper": upper,
    "row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "lag": F.lag, "lead": F.lead,
    "first_value": F.first, "last_value": F.last, "ntile": F.ntile,
}
