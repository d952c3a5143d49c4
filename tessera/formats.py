"""String formats as predicates on text columns, each from the rule of the document that defines it.

RFC 3339 (dates, times, durations), RFC 1123 and 5890 (host names), RFC 3986 and 3987 (URIs, IRIs),
RFC 4291 (IPv6), RFC 6570 (URI templates), RFC 6901 (JSON pointers). Texts are taken apart with built-in
functions and their parts are tested; only true grammars are patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as JavaScript's \s has it.
_SPACE = r"[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _is(s: Column, grammar: str) -> Column:
    """Is the whole text of this grammar? (Java's `$` lets a last line feed pass.)"""
    return s.rlike(rf"^(?:{grammar})\z")


def _number(s: Column, at: int) -> Column:
    return F.substring(s, at, 2).try_cast("int")


# --- RFC 3339 ----------------------------------------------------------------------------------
def _date(s: Column) -> Column:
    return _is(s, r"\d{4}-\d\d-\d\d") & s.try_cast("date").isNotNull()


def _clock(s: Column) -> Column:
    """HH:MM:SS with hours and minutes in range; second 60 is left to the caller."""
    return (_number(s, 1) < 24) & (_number(s, 4) < 60) & (_number(s, 7) <= 60)


def _date_time(s: Column) -> Column:
    """In UTC: the offset is Z. A leap second is one at 23:59 alone."""
    clock = F.substring(s, 12, 8)
    return (_is(s, r"\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(?:\.\d+)?[Zz]") & _date(F.substring(s, 1, 10)) & _clock(clock)
            & ((_number(clock, 7) < 60) | (clock == "23:59:60")))


def _time(s: Column) -> Column:
    """With an offset. A leap second is where 23:59 in UTC falls in local time."""
    zone = F.regexp_extract(s, r"([+\-]\d\d:\d\d)\z", 1)
    hours, minutes = F.coalesce(_number(zone, 2), F.lit(0)), F.coalesce(_number(zone, 5), F.lit(0))
    offset = F.when(zone.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes)
    leap = F.pmod(F.lit(23 * 60 + 59) + offset, F.lit(24 * 60)) == _number(s, 1) * 60 + _number(s, 4)
    return (_is(s, r"\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+\-]\d\d:\d\d)") & _clock(s) & (hours < 24) & (minutes < 60)
            & ((_number(s, 7) < 60) | leap))


def _durations() -> str:
    """The productions of appendix A, smaller units first."""
    second = r"\d+S"
    minute = rf"\d+M(?:{second})?"
    hour = rf"\d+H(?:{minute})?"
    time = rf"T(?:{hour}|{minute}|{second})"
    day = r"\d+D"
    month = rf"\d+M(?:{day})?"
    year = rf"\d+Y(?:{month})?"
    date = rf"(?:{day}|{month}|{year})(?:{time})?"
    return rf"P(?:{date}|{time}|\d+W)"


# --- names -------------------------------------------------------------------------------------
def _email(s: Column) -> Column:
    """One @; a local part of letters, digits and _ ' + - . with single, inner dots, whose last character is
    no apostrophe; domain labels that begin with a letter or digit; a last label of two letters or more."""
    local, domain = F.split_part(s, F.lit("@"), F.lit(1)), F.split_part(s, F.lit("@"), F.lit(2))
    return ((F.size(F.split(s, "@")) == 2) & _is(local, r"[A-Za-z0-9_'+.\-]+") & ~local.rlike(r"^\.|\.\.|[.']\z")
            & _is(domain, r"(?:[A-Za-z0-9][A-Za-z0-9\-]*\.)+[A-Za-z]{2,}"))


def _idn_email(s: Column) -> Column:
    """One @ with up to 64 characters before it and up to 255 behind it, no white space."""
    parts = F.split(s, "@")
    local, domain = F.char_length(F.get(parts, F.lit(0))), F.char_length(F.get(parts, F.lit(1)))
    return (F.size(parts) == 2) & local.between(1, 64) & domain.between(1, 255) & ~s.rlike(_SPACE)


def _labels(s: Column, separators: str, label: Callable[[Column], Column]) -> Column:
    """Labels of 1 to 63 characters that neither begin nor end with a hyphen, 253 characters in all."""
    return F.char_length(s).between(1, 253) & F.forall(
        F.split(s, separators), lambda x: F.char_length(x).between(1, 63) & ~x.startswith("-") & ~x.endswith("-") & label(x))


def _hostname(s: Column) -> Column:
    return _labels(s, r"\.", lambda x: _is(x, r"[A-Za-z0-9\-]+"))


def _idn_hostname(s: Column) -> Column:
    return _labels(s, r"[.\u3002\uff0e\uff61]", lambda x: ~x.rlike(_SPACE))


def _ipv4(s: Column) -> Column:
    """Four decimal octets without leading zeros."""
    octet = lambda x: _is(x, r"0|[1-9]\d{0,2}") & (x.try_cast("int") < 256)
    return (F.size(F.split(s, r"\.")) == 4) & F.forall(F.split(s, r"\."), octet)


# --- RFC 4291, 3986, 3987, 6570 ----------------------------------------------------------------
_HEX = "[0-9A-Fa-f]"
_PERCENT = f"%{_HEX}{_HEX}"


def _ipv6() -> str:
    """Eight groups, the last two perhaps as IPv4; `::` stands for one group or more, once."""
    group, octet = f"{_HEX}{{1,4}}", r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
    pair = rf"(?:{group}:{group}|{octet}(?:\.{octet}){{3}})"
    forms = [f"(?:{group}:){{6}}{pair}"]
    for after in range(7, -1, -1):  # groups behind `::`; at most 7 - after are before it
        before = f"(?:(?:{group}:){{0,{6 - after}}}{group})?" if after < 7 else ""
        tail = f"(?:{group}:){{{after - 2}}}{pair}" if after >= 2 else group if after else ""
        forms.append(f"{before}::{tail}")
    return f"(?:{'|'.join(forms)})"


def _uris(absolute: bool) -> str:
    """The grammar of RFC 3986, appendix A: a URI, or a relative reference."""
    name = rf"[A-Za-z0-9._~!$&'()*+,;=\-]|{_PERCENT}"
    pchar = f"(?:{name}|[:@])"
    authority = (rf"(?:(?:{name}|:)*@)?(?:\[(?:{_ipv6()}|v{_HEX}+\.[A-Za-z0-9._~!$&'()*+,;=:\-]+)\]|(?:{name})*)(?::\d*)?")
    more = f"(?:/{pchar}*)*"
    first = f"{pchar}+" if absolute else f"(?:{name}|@)+"  # a relative path's first segment has no colon
    hier = f"(?://{authority}{more}|/(?:{pchar}+{more})?|{first}{more}|)"
    scheme = r"[A-Za-z][A-Za-z0-9+.\-]*:" if absolute else ""
    return rf"{scheme}{hier}(?:\?(?:{pchar}|[/?])*)?(?:#(?:{pchar}|[/?])*)?"


def _template() -> str:
    """Literals and expressions {operator variable-list} of RFC 6570."""
    literal = rf"[^\x00-\x20\x7f-\x9f\"'<>%\\^`{{|}}]|{_PERCENT}"
    variable = rf"(?:[A-Za-z0-9_]|{_PERCENT})+(?::[1-9]\d{{0,3}}|\*)?"
    return rf"(?:{literal}|\{{[+#./;?&=,!@|]?{variable}(?:,{variable})*\}})*"


def _ascii(s: Column) -> Column:
    """Characters beyond ASCII percent-encoded; which octets these are does not matter to the grammar."""
    return F.regexp_replace(s, r"[^\x00-\x7f]", "%C3%A4")


_URI, _REFERENCE = _uris(True), f"{_uris(True)}|{_uris(False)}"
_POINTER = "(?:/(?:[^~/]|~[01])*)*"

_RULES: dict[str, Callable[[Column], Column]] = {
    "date-time": _date_time, "date": _date, "time": _time, "duration": lambda s: _is(s, _durations()),
    "email": _email, "idn-email": _idn_email, "hostname": _hostname, "idn-hostname": _idn_hostname,
    "uuid": lambda s: _is(s, rf"{_HEX}{{8}}-(?:{_HEX}{{4}}-){{3}}{_HEX}{{12}}"),
    "cuid": lambda s: _is(s, r"[Cc][^\s\-]{8,}"),
    "uri": lambda s: _is(s, _URI), "uri-reference": lambda s: _is(s, _REFERENCE),
    "iri": lambda s: _is(_ascii(s), _URI), "iri-reference": lambda s: _is(_ascii(s), _REFERENCE),
    "uri-template": lambda s: _is(s, _template()),
    "ipv4": _ipv4, "ipv6": lambda s: _is(s, _ipv6()),
    "json-pointer": lambda s: _is(s, _POINTER), "relative-json-pointer": lambda s: _is(s, rf"(?:0|[1-9]\d*)(?:#|{_POINTER})"),
}

NAMES = tuple(_RULES)


def matches(s: Column, name: str) -> Column:
    """Has the text s the format? Null stays null."""
    return _RULES[name](s)
