"""URLs by the URL Standard: text to its href, null where parsing fails; a composition of column functions.

Parsing is without a base. Special schemes (http, https, ws, wss, ftp, file), paths with dot segments, percent
encoding by the sets of each part, credentials, ports, IPv4 in all its spellings, IPv6 in its shortest form, opaque
hosts and opaque paths are covered. Not covered: host names beyond ASCII stay as they are, in lower case (no
Punycode), and drive letters of file URLs are plain path segments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import bound

# Default ports of special schemes, and the percent-encode sets of the URL Standard as classes.
PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21", "file": ""}
_C0 = r"\x00-\x1f\x7f-\x{10ffff}"
FRAGMENT = rf'[{_C0} "<>`]'
QUERY = rf'[{_C0} "#<>]'
SPECIAL_QUERY = rf"[{_C0} \"#<>']"
PATH = rf'[{_C0} "#<>?\^`{{}}]'
USERINFO = rf'[{_C0} "#<>?\^`{{}}/:;=@\[\\\]|]'
OPAQUE = rf"[{_C0}]"
_FORBIDDEN_HOST = r"[\x00\t\n\r #/:<>?@\[\\\]\^|]"
_FORBIDDEN_DOMAIN = r"[\x00-\x20#/:<>?@\[\\\]\^|%\x7f]"


def percent_encoded(s: Column, kind: str) -> Column:
    """s with the characters of a set as percent-encoded UTF-8."""
    octets = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    each = F.transform(F.split(s, ""), lambda c: F.when(c.rlike(kind), octets(c)).otherwise(c))
    return F.when(s.rlike(kind), F.array_join(each, "")).otherwise(s)


def percent_decoded(s: Column) -> Column:
    """Bytes of percent triplets read as UTF-8."""
    triplet = lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), F.unhex(F.substring(p, 2, 2))).otherwise(F.encode(p, "UTF-8"))
    parts = F.regexp_extract_all(s, F.lit("(%[0-9A-Fa-f]{2}|[^%]+|%)"), F.lit(1))
    joined = F.aggregate(F.transform(parts, triplet), F.lit(b""), lambda a, b: F.concat(a, b))
    return F.when(s.contains("%"), F.make_valid_utf8(joined.cast("string"))).otherwise(s)


def _ipv4(host: Column) -> Column:
    """Dotted text of a host that ends in a number; null if it is no address."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")

    def number(p: Column) -> Column:
        base = F.when(p.rlike("^0[xX]"), 16).when(p.rlike("^0."), 8).otherwise(10)
        digits = F.when(p.rlike("^0[xX]"), F.substring(p, 3, 99)).otherwise(p)
        ok = F.when(p.rlike("^0[xX]"), p.rlike("^0[xX][0-9A-Fa-f]{0,12}$")).when(p.rlike("^0."), p.rlike("^[0-7]{1,15}$")).otherwise(p.rlike("^[0-9]{1,12}$"))
        return F.when(ok, _based(digits, base))

    def whole(n: Column) -> Column:
        k = F.size(n)
        last = F.element_at(n, -1)
        front = F.slice(n, F.lit(1), k - 1)
        ok = (k <= 4) & ~F.exists(n, lambda x: x.isNull()) & ~F.exists(front, lambda x: x > 255) & (last < F.pow(F.lit(256.0), (5 - k).cast("double")))
        value = last + F.aggregate(F.transform(front, lambda x, i: F.call_function("shiftleft", x, (8 * (3 - i)).cast("int"))), F.lit(0).cast("long"), lambda a, x: a + x)
        octet = lambda shift: F.call_function("shiftright", value, F.lit(shift)).bitwiseAND(F.lit(255)).cast("string")
        return F.when(ok, F.concat_ws(".", *(octet(x) for x in (24, 16, 8, 0))))

    return bound(F.transform(parts, number), whole)


def _based(digits: Column, base: Column) -> Column:
    tens = lambda b: F.when(digits == "", F.lit(0).cast("long")).otherwise(F.conv(digits, b, 10).try_cast("long"))
    return F.when(base == 16, tens(16)).when(base == 8, tens(8)).otherwise(digits.try_cast("long"))


def _ipv6(text: Column) -> Column:
    """The shortest form of an IPv6 address; null if text is none."""
    from . import formats

    hexes = lambda q: F.concat(F.lower(F.hex(F.element_at(q, 1).cast("int") * 256 + F.element_at(q, 2).cast("int"))), F.lit(":"),
                               F.lower(F.hex(F.element_at(q, 3).cast("int") * 256 + F.element_at(q, 4).cast("int"))))
    tail = F.regexp_extract(text, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    plain = F.when(tail != "", F.concat(F.regexp_replace(text, r"\d+\.\d+\.\d+\.\d+$", ""), bound(F.split(tail, r"\."), hexes))).otherwise(text)

    def groups(t: Column) -> Column:
        side = lambda s: F.array_remove(F.split(s, ":"), "")
        left, right = side(F.substring_index(t, "::", 1)), side(F.when(t.contains("::"), F.substring_index(t, "::", -1)).otherwise(F.lit("")))
        zeros = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
        return F.transform(F.concat(left, zeros, right), lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", "")))

    def short(g: Column) -> Column:
        # The longest run of zeros, the first of equals, two groups at least.
        runs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(
            F.length(F.regexp_extract(F.array_join(F.transform(F.slice(g, i + 1, 8), lambda x: F.when(x == "0", "0").otherwise("x")), ""), "^(0*)", 1)).alias("n"), (-i).alias("at")))
        best = F.array_max(runs)
        cut = F.concat(F.array_join(F.slice(g, F.lit(1), -best["at"]), ":"), F.lit("::"), F.array_join(F.slice(g, -best["at"] + best["n"] + 1, 8), ":"))
        return F.when(best["n"] >= 2, cut).otherwise(F.array_join(g, ":"))

    return F.when(formats.matches(text, "ipv6"), F.concat(F.lit("["), bound(bound(plain, groups), short), F.lit("]")))


def _host(text: Column, special: Column) -> Column:
    domain = F.lower(percent_decoded(text))
    named = lambda d: F.when(d.rlike(_FORBIDDEN_DOMAIN) | (d == ""), F.lit(None)).when(
        F.element_at(F.split(F.regexp_replace(d, r"\.$", ""), r"\."), -1).rlike("^([0-9]+|0x[0-9a-f]*)$"), _ipv4(d)).otherwise(d)
    opaque = F.when(~text.rlike(_FORBIDDEN_HOST), percent_encoded(text, OPAQUE))
    return (F.when(text.startswith("["), F.when(text.endswith("]"), _ipv6(F.regexp_replace(text, r"^\[|\]$", ""))))
            .when(special, bound(domain, named)).otherwise(opaque))


def _path(text: Column) -> Column:
    """The path of `/`-separated text without its dot segments."""
    parts = F.split(F.regexp_replace(text, "^/", ""), "/")
    single, double = r"^(\.|%2[eE])$", r"^(\.|%2[eE]){2}$"

    def add(a: Column, p: Column) -> Column:
        up = p.rlike(double)
        kept = F.when(up, F.slice(a["out"], F.lit(1), F.greatest(F.size(a["out"]) - 1, F.lit(0)))).when(p.rlike(single), a["out"]).otherwise(F.concat(a["out"], F.array(p)))
        return F.struct(kept.alias("out"), (up | p.rlike(single)).alias("dot"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("dot"))
    whole = lambda a: F.concat(F.lit("/"), F.array_join(a["out"], "/"), F.when(a["dot"] & (F.size(a["out"]) > 0), F.lit("/")).otherwise(F.lit("")))
    return percent_encoded(F.aggregate(parts, start, add, whole), PATH)


def _authority(text: Column, scheme: Column, special: Column) -> Column:
    """credentials@host:port, null if it is invalid."""
    has = text.contains("@")
    name = F.when(has, F.regexp_extract(text, "(?s)^(.*)@", 1)).otherwise(F.lit(""))
    place = F.when(has, F.regexp_extract(text, "(?s)^.*@(.*)$", 1)).otherwise(text)
    port = F.regexp_extract(place, r"(?s):([^\]:]*)$", 1)
    host = F.regexp_replace(place, r"(?s):[^\]:]*$", "")
    user, word = F.substring_index(name, ":", 1), F.when(name.contains(":"), F.regexp_extract(name, "(?s)^[^:]*:(.*)$", 1)).otherwise(F.lit(""))
    said = F.when((user == "") & (word == ""), F.lit("")).otherwise(F.concat(
        percent_encoded(user, USERINFO), F.when(word != "", F.concat(F.lit(":"), percent_encoded(word, USERINFO))).otherwise(F.lit("")), F.lit("@")))
    default = F.element_at(F.create_map(*(F.lit(x) for k, v in PORTS.items() for x in (k, v))), scheme)
    number = F.regexp_replace(port, "^0+(?=.)", "")
    ok = (port == "") | port.rlike(r"^[0-9]+$") & (F.length(number) <= 5) & (number.try_cast("int") <= 65535)
    shown = F.when((port == "") | F.coalesce(number == default, F.lit(False)), F.lit("")).otherwise(F.concat(F.lit(":"), number))
    empty = (host == "") & ~special & (name == "") & ~place.contains(":")
    return F.when(empty, F.lit("")).when(F.coalesce(ok, F.lit(False)) & (host != ""), F.concat(said, _host(host, special), shown))


def href(text: Column) -> Column:
    """The serialized URL of a text, null if the text is none."""
    clean = F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")

    def parts(s: Column) -> Column:
        scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
        rest = F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
        before = F.substring_index(rest, "#", 1)
        return F.struct(scheme.alias("scheme"), F.substring_index(before, "?", 1).alias("body"),
                        F.when(before.contains("?"), F.regexp_replace(before, r"(?s)^[^?]*\?", "")).alias("query"),
                        F.when(rest.contains("#"), F.regexp_replace(rest, "(?s)^[^#]*#", "")).alias("fragment"), scheme.isin(*PORTS).alias("special"))

    def made(p: Column) -> Column:
        scheme, special = p["scheme"], p["special"]
        slashed = F.when(special, F.replace(p["body"], F.lit("\\"), F.lit("/"))).otherwise(p["body"])

        def body(b: Column) -> Column:
            net = F.regexp_replace(b, "^/*", "")
            authority = F.regexp_extract(net, "(?s)^([^/]*)", 1)
            file_host = F.when(b.startswith("//"), F.regexp_extract(b, "(?s)^//([^/]*)", 1)).otherwise(F.lit(""))
            file_path = F.when(b.startswith("//"), F.regexp_replace(b, "(?s)^//[^/]*", "")).otherwise(b)
            shown = F.when((file_host == "") | (F.lower(file_host) == "localhost"), F.lit("")).otherwise(_host(file_host, F.lit(True)))
            other = F.regexp_extract(b, "(?s)^//([^/]*)", 1)
            other_path = F.regexp_replace(b, "(?s)^//[^/]*", "")
            return (F.when(scheme == "file", F.concat(F.lit("//"), shown, _path(file_path)))
                    .when(special, F.concat(F.lit("//"), _authority(authority, scheme, special), _path(F.regexp_replace(net, "(?s)^[^/]*", ""))))
                    .when(b.startswith("//"), F.concat(F.lit("//"), _authority(other, scheme, special), F.when(other_path == "", F.lit("")).otherwise(_path(other_path))))
                    .when(b.startswith("/"), bound(_path(b), lambda t: F.when(t.startswith("//"), F.concat(F.lit("/."), t)).otherwise(t)))
                    .otherwise(percent_encoded(b, OPAQUE)))

        query = F.when(special, percent_encoded(p["query"], SPECIAL_QUERY)).otherwise(percent_encoded(p["query"], QUERY))
        return F.when(scheme != "", F.concat(
            scheme, F.lit(":"), bound(slashed, body), F.when(p["query"].isNotNull(), F.concat(F.lit("?"), query)).otherwise(F.lit("")),
            F.when(p["fragment"].isNotNull(), F.concat(F.lit("#"), percent_encoded(p["fragment"], FRAGMENT))).otherwise(F.lit(""))))

    return bound(bound(clean, parts), made)
