"""Columns as text the way Python prints them, JSON strings, and shared prefixes; all but nested cells within Spark."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _digits(x: Column, text: Column) -> Column:
    """A struct of the significant digits of a finite double and the exponent of the first of them, from its text."""
    whole, part = F.regexp_extract(text, r"^-?([0-9]+)", 1), F.regexp_extract(text, r"\.([0-9]+)", 1)
    power = F.coalesce(F.regexp_extract(text, r"[Ee]([-+]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    first = F.when(F.regexp_like(whole, F.lit("[1-9]")), F.length(whole) - 1).otherwise(-1 - F.length(F.regexp_extract(part, "^(0*)", 1)))
    digits = F.regexp_replace(F.concat(whole, part), "^0+|0+$", "")
    zero = digits == ""
    return F.struct(F.when(zero, "0").otherwise(digits).alias("d"), F.when(zero, 0).otherwise(power + first).alias("e"))


def _shown(d: Column, e: Column) -> Column:
    n, rest = F.length(d), F.substring(d, F.lit(2), F.length(d))
    right = F.when(n > e + 1, F.substring(d, e + 2, n)).otherwise("0")
    size = F.lpad(F.abs(e).cast("string"), F.greatest(F.length(F.abs(e).cast("string")), F.lit(2)), F.lit("0"))
    raised = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(e < 0, "-").otherwise("+"), size)
    return F.when((e < -4) | (e >= 16), raised).when(e >= 0, F.concat(F.rpad(F.substring(d, F.lit(1), e + 1), e + 1, F.lit("0")), F.lit("."), right)).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))


def float_text(c: Column) -> Column:
    """A double as Python's repr: shortest digits, an exponent below 1e-4 and from 1e16 on.

    From 0.001 to 10 million the JVM prints the same. It gives more digits to some doubles than tell them apart; 16 and
    17 are tried. Where it cuts a tie the other way, beyond 1e17, and below the least normal double, the last digit may
    still differ.
    """
    c = c.cast("double")
    digits = lambda t: F.length(F.regexp_replace(t, "E.*$|[-.]", ""))
    best = lambda t, n: F.when((digits(t) > n) & (F.format_string(f"%.{n - 1}e", c).try_cast("double") == c), F.format_string(f"%.{n - 1}e", c))
    text = let(c.cast("string"), lambda t: F.coalesce(best(t, 16), best(t, 17), t))
    finite = let(_digits(c, text), lambda x: _shown(x["d"], x["e"]))
    sign = F.when(F.startswith(c.cast("string"), F.lit("-")), "-").otherwise("")
    plain = c.cast("string")
    usual = ~F.contains(plain, F.lit("E")) & (F.length(plain) < 18) & (F.abs(c) < 1e7)
    return F.when(usual, plain).when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(c.isNotNull(), F.concat(sign, finite))


def timestamp_text(c: Column) -> Column:
    """Seconds, and six decimals unless they are zero."""
    whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def text_cell(c: Column, kind: T.DataType) -> Column:
    """``str(cell)``; a null is ``None``."""
    if isinstance(kind, T.BooleanType):
        out = F.initcap(c.cast("string"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = float_text(c.cast("string").cast("double") if isinstance(kind, T.FloatType) else c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = timestamp_text(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit("None"))


def nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.StructType, T.MapType))


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; numbers that are not finite are refused."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _refuse(name: str):
    raise ValueError(f"not a finite number: {name}")


def canonical_cell(c: Column) -> Column:
    """Canonical JSON of a nested column."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "null" if x is None else canonical(json.loads(x, parse_constant=_refuse)))

    return F.pandas_udf(run, "string")(F.to_json(c, {"ignoreNullFields": "false"}))


#: Characters that JSON strings name by a letter; the other ones below space are named by number.
_NAMED = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_string(c: Column) -> Column:
    """``c`` as a JSON string; only quotes, backslashes and control characters are escaped."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for x in map(chr, range(32)):
        out = F.replace(out, F.lit(x), F.lit(_NAMED.get(x, f"\\u{ord(x):04x}")))
    quoted = F.when(F.regexp_like(c, F.lit('[\\x00-\\x1f"\\\\]')), out).otherwise(c)
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def shared_prefix(a: Column, b: Column) -> Column:
    """Bytes of UTF-8 that two texts begin with alike: bits of the length from high to low, each kept if the prefixes agree."""
    x, y = a.cast("binary"), b.cast("binary")
    most = F.least(F.octet_length(a), F.octet_length(b))
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= most) & (F.substring(x, F.lit(1), n + k) == F.substring(y, F.lit(1), n + k)), n + k).otherwise(n))
