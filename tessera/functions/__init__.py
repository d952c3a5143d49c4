"""Column functions with the semantics of JavaScript values and JSON text."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as String.prototype.trim has it.
_SPACE = r"[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{_SPACE}+|{_SPACE}+\z", "")


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


_DIGITS = {16: ("xX", "0-9a-fA-F"), 8: ("oO", "0-7"), 2: ("bB", "01")}


def _place_value(digits: Column, zero: Column, times: Column, kind: str) -> Column:
    return F.aggregate(digits, zero.cast(kind), lambda a, c: (a * times + F.conv(c, 16, 10).cast("int")).try_cast(kind))


def _radix(s: Column, kind: str) -> Column:
    """0x, 0o and 0b text of any length as double or decimal(38, 0), else null. A decimal is null from 127
    bits on, a double infinite beyond its range."""
    out, big = F.lit(None).cast(kind), "decimal(38,0)"
    for base, (letters, digits) in _DIGITS.items():
        text = F.regexp_replace(F.substring(s, 3, 2147483647), "^0+", "")
        each = F.filter(F.split(text, ""), lambda c: c != "")
        # Whole numbers under 2 ** 126 have 38 digits.
        total = F.when(F.length(text) <= {16: 31, 8: 42, 2: 126}[base], _place_value(each, F.lit(0), F.lit(base).cast("decimal(2,0)"), big))
        if kind == "double":
            total = F.coalesce(total.cast("double"), _place_value(each, F.lit(0), F.lit(float(base)), "double"))
        out = F.when(s.rlike(rf"^0[{letters}][{digits}]+\z"), total).otherwise(out)
    return out


def to_number(s: Column) -> Column:
    """Text to double: empty is 0, hexadecimal and the like count, null if it is no number."""
    return number_of(trimmed(s))


def number_of(t: Column) -> Column:
    """Trimmed text to double."""
    return (F.when(t == "", F.lit(0.0))
            .when(t.rlike(r"^[+-]?Infinity\z"), F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
            .when(t.rlike(_DECIMAL), t.try_cast("double"))
            .when(t.startswith("0"), _radix(t, "double")))


def to_bigint(s: Column) -> Column:
    """Text to decimal(38, 0): empty is 0, no fractions; null if it is none or beyond 38 digits."""
    t = trimmed(s)
    return (F.when(t == "", F.lit(0).cast("decimal(38,0)"))
            .when(t.rlike(r"^[+-]?\d+\z"), t.try_cast("decimal(38,0)"))
            .when(t.startswith("0"), _radix(t, "decimal(38,0)")))


def bound(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once: a one-item array binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits_text(found: Column) -> Column:
    """Digits d and the place n of the point, counted from the first digit, as JavaScript writes them."""
    d, n = found["d"], found["n"]
    k = F.length(d)
    rest = F.when(k > 1, F.concat(F.lit("."), d.substr(F.lit(2), k))).otherwise(F.lit(""))
    return (F.when((k <= n) & (n <= 21), F.rpad(d, n, F.lit("0")))
            .when((n > 0) & (n <= 21), F.concat(d.substr(F.lit(1), n), F.lit("."), d.substr(n + 1, k)))
            .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), d))
            .otherwise(F.concat(d.substr(F.lit(1), F.lit(1)), rest, F.when(n > 0, F.lit("e+")).otherwise(F.lit("e-")), F.abs(n - 1).cast("string"))))


def _parts(s: Column) -> Column:
    """Digits and point of a double's text."""
    whole, part = F.regexp_extract(s, r"^(\d+)", 1), F.regexp_extract(s, r"\.(\d+)", 1)
    exponent = F.coalesce(F.regexp_extract(s, r"E(-?\d+)", 1).try_cast("int"), F.lit(0))
    return bound(F.struct(F.concat(whole, part).alias("j"), (F.length(whole) + exponent).alias("n")), lambda p: F.struct(
        F.regexp_replace(F.regexp_replace(p["j"], r"0+\z", ""), "^0+", "").alias("d"),
        (p["n"] - F.length(F.regexp_extract(p["j"], "^(0*)", 1))).alias("n")))


def number_text(x: Column) -> Column:
    """Double to text: shortest digits, exponents only at 1e21 and below 1e-6."""
    size = F.abs(x)
    rare = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), bound(_parts(size.cast("string")), _digits_text))
    return (F.when((size >= 0.001) & (size < 1e7), F.regexp_replace(x.cast("string"), r"\.?0+\z", ""))
            .when(F.isnan(x), F.lit("NaN")).when(x == 0, F.lit("0"))
            .when(size == float("inf"), F.when(x > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity")))
            .otherwise(rare))


def quoted(s: Column) -> Column:
    """Text as a JSON string, control characters in lower-case hexadecimal."""
    named = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    plain = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = [(chr(i), named.get(chr(i), f"\\u{i:04x}")) for i in range(32)]
    table = F.from_json(F.lit(json.dumps([{"c": c, "e": e} for c, e in rare])), "array<struct<c:string,e:string>>")  # a constant, folded
    full = F.aggregate(table, plain, lambda a, r: F.replace(a, r["c"], r["e"]))
    return F.concat(F.lit('"'), F.when(s.rlike(r"[\x00-\x1f]"), full).otherwise(plain), F.lit('"'))


def indented(text: Column, width: int) -> Column:
    """Compact JSON text with a line per item, each level width spaces further in (10 at most, as in JavaScript)."""
    if width < 1:
        return text
    # Raw control characters can't be in JSON text, so two of them stand for escapes while strings are cut out.
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    tokens = F.regexp_extract_all(plain, F.lit(r'("[^"]*+"|[{}\[\],:]|[^{}\[\],:"\s]++)'), F.lit(1))

    def add(a: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        level = F.when(closes, a["level"] - 1).otherwise(a["level"])
        begun = a["last"].isin("{", "[")
        breaks = (begun | (a["last"] == ",")) & ~closes | closes & ~begun
        line = F.when(breaks, F.concat(F.lit("\n"), F.repeat(F.lit(" "), level * min(width, 10)))).otherwise(F.lit(""))
        return F.struct(F.concat(a["out"], line, t, F.when(t == ":", F.lit(" ")).otherwise(F.lit(""))).alias("out"),
                        F.when(opens, level + 1).otherwise(level).alias("level"), t.alias("last"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("level"), F.lit("").alias("last"))
    made = F.aggregate(tokens, start, add, lambda a: a["out"])
    return F.replace(F.replace(made, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


#: Stands behind the value when JSON text is parsed; no data can know it.
_END = uuid.uuid4().hex


def wrapped_json(s: Column) -> Column:
    """s as the first item of an array whose second is a mark. The built-in parser lets text after a value pass, so
    the mark says that s was one value and all of it."""
    return F.try_parse_json(F.concat(F.lit("["), s, F.lit(f',"{_END}"]')))


def json_in(wrapped: Column) -> Column:
    """The value of a text that wrapped_json() has parsed."""
    return F.try_variant_get(wrapped, "$[0]", "variant")


def alone(wrapped: Column) -> Column:
    """Was the text exactly one JSON value?"""
    return F.coalesce(F.try_variant_get(wrapped, "$[1]", "string") == _END, F.lit(False)) & F.try_variant_get(wrapped, "$[2]", "variant").isNull()


def strict_json(s: Column) -> Column:
    """Is s exactly one JSON value? Null if s is."""
    return F.when(s.isNotNull(), bound(wrapped_json(s), alone))


def iso_text(t: Column) -> Column:
    """Timestamp to YYYY-MM-DDTHH:MM:SS.mmmZ; the session's time zone must be UTC for timestamps with one."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def text_of_bytes(b: Column) -> Column:
    """UTF-8 bytes to text, malformed ones to U+FFFD."""
    return F.make_valid_utf8(b.cast("string"))


def is_multiple(x: Column, of: float) -> Column:
    """Exact for whole divisors; else the ratio is whole up to a relative epsilon."""
    if float(of).is_integer():
        return x % F.lit(of) == 0
    ratio = x / F.lit(of)
    return F.abs(ratio - F.round(ratio)) < 2.220446049250313e-16 * 4 * F.greatest(F.abs(ratio), F.lit(1.0))
