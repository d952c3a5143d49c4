"""Patterns in JavaScript's dialect: read by its grammar, written in Java's.

What the two dialects spell alike but mean differently is written out: `.` and `$`, classes, word boundaries, named
groups, escapes, braces that are no quantifier. What Java can't tell (a backreference to a group that need not have
taken part) or does not know raises SchemaError when the schema is made, never in a job.

Flags: i, m, s, u; g, y and d don't change a test from the start of the text. Texts are matched by code point also
without u, so a character outside the basic plane is one `.` and not two.
"""

from __future__ import annotations

import functools

from .errors import SchemaError

# The character sets of the language's specification.
_DIGIT = [(48, 57)]
_WORD = [(48, 57), (65, 90), (95, 95), (97, 122)]
_SPACE = [(9, 13), (32, 32), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
_LINE = [(10, 10), (13, 13), (0x2028, 0x2029)]
_CONTROL = {"t": 9, "n": 10, "v": 11, "f": 12, "r": 13}
_SYNTAX = "^$\\.*+?()[]{}|/"
_LAST = 0x10FFFF


def _without(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The code points in none of the ranges."""
    out, at = [], 0
    for low, high in sorted(ranges):
        if low > at:
            out.append((at, low - 1))
        at = max(at, high + 1)
    return [*out, (at, _LAST)] if at <= _LAST else out


_SETS = {"d": _DIGIT, "D": _without(_DIGIT), "w": _WORD, "W": _without(_WORD), "s": _SPACE, "S": _without(_SPACE)}


def _one(c: int) -> str:
    return chr(c) if chr(c).isascii() and chr(c).isalnum() else f"\\x{{{c:x}}}"


def _set(ranges: list[tuple[int, int]], more: str = "", negated: bool = False) -> str:
    if not ranges and not more:
        return f"[{_one(0)}-{_one(_LAST)}]" if negated else "(?!)"
    if not more and negated:
        return _set(_without(ranges))
    return f"[{'^' if negated else ''}{''.join(_one(a) if a == b else f'{_one(a)}-{_one(b)}' for a, b in ranges)}{more}]"


_BOUNDARY = f"(?:(?<={_set(_WORD)})(?!{_set(_WORD)})|(?<!{_set(_WORD)})(?={_set(_WORD)}))"


class _Reader:
    def __init__(self, pattern: str, flags: str) -> None:
        if len(set(flags)) < len(flags) or set(flags) - set("dgimsuy"):
            raise SchemaError(f"Invalid flags of a pattern: {flags}")
        self.text, self.at, self.flags = pattern, 0, flags
        self.unicode, self.lines = "u" in flags, "m" in flags
        self.groups, self.names = self.counted()
        self.named = bool(self.names) or self.unicode
        self.opened = 0
        self.sure: set[int] = set()  # groups that have taken part for certain
        self.maybe = 0  # alternatives, quantifiers and negations around

    def bad(self, why: str) -> SchemaError:
        return SchemaError(f"Invalid pattern /{self.text}/: {why}")

    def counted(self) -> tuple[int, dict[str, int]]:
        """The number of groups, and those with a name."""
        n, names, i, inside = 0, {}, 0, False
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 1
            elif inside:
                inside = c != "]"
            elif c == "[":
                inside = True
            elif c == "(" and (self.text[i + 1:i + 2] != "?" or self.text[i + 2:i + 3] == "<" and self.text[i + 3:i + 4] not in ("=", "!")):
                n += 1
                if self.text[i + 1:i + 2] == "?":
                    name = self.text[i + 3:self.text.find(">", i)]
                    if name in names or not name.replace("$", "_").isidentifier():
                        raise self.bad(f"group name {name!r}")
                    names[name] = n
            i += 1
        return n, names

    # --- the grammar, from the top ---------------------------------------------------------------
    def whole(self) -> str:
        out = self.alternatives()
        if self.at < len(self.text):
            raise self.bad("unmatched )")
        front = "".join(f for f, on in (("i", "i" in self.flags), ("u", "i" in self.flags)) if on)
        return f"(?{front})" + out if front else out

    def next(self) -> str:
        return self.text[self.at:self.at + 1]

    def takes(self, text: str) -> bool:
        found = self.text.startswith(text, self.at)
        self.at += len(text) * found
        return found

    def alternatives(self) -> str:
        several = self._several()
        self.maybe += several
        out = [self.terms()]
        while self.takes("|"):
            out.append(self.terms())
        self.maybe -= several
        return "|".join(out)

    def _several(self) -> bool:
        """Is there a bar before this group ends?"""
        depth, i, inside = 0, self.at, False
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 1
            elif inside:
                inside = c != "]"
            elif c == "[":
                inside = True
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth < 0:
                    return False
            elif c == "|" and not depth:
                return True
            i += 1
        return False

    def terms(self) -> str:
        out = ""
        while self.at < len(self.text) and self.next() not in "|)":
            out += self.term()
        return out

    def term(self) -> str:
        if self.takes("^"):
            return f"(?<!{_set(_without(_LINE))})" if self.lines else "\\A"
        if self.takes("$"):
            return f"(?!{_set(_without(_LINE))})" if self.lines else "\\z"
        if self.takes("\\b"):
            return _BOUNDARY
        if self.takes("\\B"):
            return f"(?!{_BOUNDARY})"
        before = (self.at, self.opened, set(self.sure))
        made = self.atom()
        times = self.times()
        if times is None:
            return made
        if times[0] == 0 or self.opened > before[1]:
            # Read again: what is in it may not take part, or takes part several times.
            self.at, self.opened, self.sure = before
            self.maybe += 1
            made = self.atom()
            self.maybe -= 1
            times = self.times()
        return f"(?:{made}){times[2]}"

    def times(self) -> tuple[int, int | None, str] | None:
        """Least, most and the text of a quantifier."""
        start = self.at
        if self.next() in ("*", "+", "?") and self.next():
            c = self.next()
            self.at += 1
            low, high, text = {"*": (0, None, "*"), "+": (1, None, "+"), "?": (0, 1, "?")}[c]
        elif self.takes("{"):
            low, high = self.digits(), None
            if low is not None:
                high = low if not self.takes(",") else self.digits()
            if low is None or not self.takes("}"):
                if self.unicode:
                    raise self.bad("incomplete quantifier")
                self.at = start
                return None
            exact = "," not in self.text[start:self.at]
            if high is not None and high < low:
                raise self.bad("numbers out of order in a quantifier")
            if max(low, high or 0) > 2**31 - 1:
                raise self.bad("a quantifier beyond what can be counted")
            text = f"{{{low}}}" if exact else f"{{{low},{'' if high is None else high}}}"
        else:
            return None
        return low, high, text + ("?" if self.takes("?") else "")

    def digits(self) -> int | None:
        start = self.at
        while self.next().isascii() and self.next().isdigit():
            self.at += 1
        return int(self.text[start:self.at]) if self.at > start else None

    def atom(self) -> str:
        if self.takes("."):
            return _set([(0, _LAST)]) if "s" in self.flags else _set(_without(_LINE))
        if self.takes("["):
            return self.klass()
        if self.takes("("):
            return self.group()
        if self.takes("\\"):
            return self.escape()
        c = self.next()
        if c in ("*", "+", "?") or c == "{" and (self.unicode or self.times() is not None):
            raise self.bad("nothing to repeat")
        if self.unicode and c in ("]", "}"):
            raise self.bad(f"a lone {c}")
        self.at += 1
        return _one(ord(c))

    def group(self) -> str:
        for start in ("?:", "?=", "?!", "?<=", "?<!"):
            if self.takes(start):
                negated = start.endswith("!")
                self.maybe += negated
                inner = self.alternatives()
                self.maybe -= negated
                return self.closed(f"({start}{inner})")
        if self.takes("?<"):
            self.at = self.text.index(">", self.at) + 1
        elif self.next() == "?":
            raise self.bad("invalid group")
        self.opened += 1
        number = self.opened
        inner = self.alternatives()
        if not self.maybe:
            self.sure.add(number)
        return self.closed(f"({inner})")

    def closed(self, made: str) -> str:
        if not self.takes(")"):
            raise self.bad("unterminated group")
        return made

    def back(self, number: int) -> str:
        if number not in self.sure:
            raise self.bad(f"group {number} need not have taken part where it is referred to, which can't be told in a job")
        return f"(?:\\{number})"

    def escape(self) -> str:
        c = self.next()
        if not c:
            raise self.bad("\\ at the end")
        if c in _SETS:
            self.at += 1
            return _set(_SETS[c])
        if c in "pP" and self.unicode:
            return self.property()
        if c == "k" and self.named:
            end = self.text.find(">", self.at)
            name = self.text[self.at + 2:end]
            if self.text[self.at + 1:self.at + 2] != "<" or name not in self.names:
                raise self.bad("invalid named reference")
            self.at = end + 1
            return self.back(self.names[name])
        if c in "123456789":
            start, number = self.at, self.digits()
            if self.unicode or number <= self.groups:
                if number > self.groups:
                    raise self.bad("a reference to no group")
                return self.back(number)
            self.at = start
        return _one(self.character(False))

    def character(self, in_class: bool) -> int:
        """The code point that stands behind a backslash."""
        c = self.next()
        self.at += 1
        if c in _CONTROL:
            return _CONTROL[c]
        if c == "b" and in_class:
            return 8
        if c == "-" and in_class and self.unicode:
            return 45
        if c == "c" and self.next().isascii() and self.next().isalpha():
            self.at += 1
            return ord(self.text[self.at - 1]) % 32
        if c == "x" and (n := self.hexadecimal(2)) is not None:
            return n
        if c == "u":
            if self.unicode and self.takes("{"):
                end = self.text.find("}", self.at)
                try:
                    n = int(self.text[self.at:end], 16)
                except ValueError:
                    n = _LAST + 1
                if end < 0 or n > _LAST:
                    raise self.bad("invalid code point")
                self.at = end + 1
                return n
            if (n := self.hexadecimal(4)) is not None:
                start = self.at
                if 0xD800 <= n < 0xDC00 and self.takes("\\u") and (m := self.hexadecimal(4)) is not None and 0xDC00 <= m < 0xE000:
                    return 0x10000 + (n - 0xD800) * 1024 + m - 0xDC00
                self.at = start
                return n
        if c == "0" and not self.next().isdigit():
            return 0
        if self.unicode and c not in _SYNTAX:
            raise self.bad(f"invalid escape \\{c}")
        if c in "01234567" and c:
            start = self.at - 1
            most = 3 if c in "0123" else 2
            while self.at - start < most and self.next() and self.next() in "01234567":
                self.at += 1
            return int(self.text[start:self.at], 8)
        if c == "c":  # the backslash itself
            self.at -= 1
            return 92
        if c == "k" and self.named:
            raise self.bad("invalid named reference")
        return ord(c)

    def hexadecimal(self, n: int) -> int | None:
        found = self.text[self.at:self.at + n]
        if len(found) < n or any(x not in "0123456789abcdefABCDEF" for x in found):
            return None
        self.at += n
        return int(found, 16)

    def property(self) -> str:
        c, end = self.next(), self.text.find("}", self.at)
        name = self.text[self.at + 2:end]
        if self.text[self.at + 1:self.at + 2] != "{" or end < 0:
            raise self.bad("invalid property")
        self.at = end + 1
        key, _, value = name.partition("=")
        if not value:
            if key == "Any":
                return _set([(0, _LAST)]) if c == "p" else "(?!)"
            return f"\\{c}{{{key if len(key) <= 2 else 'Is' + key}}}"
        if key in ("Script", "sc"):
            return f"\\{c}{{script={value}}}"
        if key in ("General_Category", "gc"):
            return f"\\{c}{{gc={value}}}"
        raise self.bad(f"the property {name} is not known")

    def klass(self) -> str:
        negated, ranges, more = self.takes("^"), [], ""
        while not self.takes("]"):
            if self.at >= len(self.text):
                raise self.bad("unterminated class")
            low, extra = self.member()
            more += extra or ""
            if self.next() == "-" and self.text[self.at + 1:self.at + 2] not in ("]", ""):
                self.at += 1
                high, other = self.member()
                more += other or ""
                if isinstance(low, int) and isinstance(high, int):
                    if high < low:
                        raise self.bad("range out of order in a class")
                    ranges.append((low, high))
                    continue
                if self.unicode:
                    raise self.bad("invalid class")
                ranges += [(45, 45), *self.spread(high)]
            ranges += self.spread(low)
        return _set(ranges, more, negated)

    @staticmethod
    def spread(x: int | list | None) -> list[tuple[int, int]]:
        return [] if x is None else [(x, x)] if isinstance(x, int) else x

    def member(self) -> tuple[int | list | None, str | None]:
        c = self.next()
        if c != "\\":
            self.at += 1
            return ord(c), None
        self.at += 1
        c = self.next()
        if not c:
            raise self.bad("\\ at the end")
        if c in _SETS:
            self.at += 1
            return _SETS[c], None
        if c in "pP" and self.unicode:
            return None, self.property()
        return self.character(True), None


def parted(pattern: str) -> tuple[str, str]:
    """Pattern and flags of a text that may start with `(?flags)`, which no pattern of the language does."""
    if pattern.startswith("(?") and pattern[2:3] in tuple("dgimsuy"):
        flags, _, rest = pattern[2:].partition(")")
        return rest, flags
    return pattern, ""


@functools.lru_cache(maxsize=1024)
def java(pattern: str, flags: str = "") -> str:
    """The pattern in Java's dialect; SchemaError if it is none."""
    return _Reader(pattern, flags).whole()


@functools.lru_cache(maxsize=1024)
def compiled(pattern: str, flags: str = "") -> str:
    """java(), after the engine's own compiler has taken it; in a session, before any job."""
    from pyspark.sql import SparkSession

    text = java(pattern, flags)
    session = SparkSession.getActiveSession()
    if session is not None and hasattr(session, "_jvm"):
        try:
            session._jvm.java.util.regex.Pattern.compile(text)
        except Exception as e:
            raise SchemaError(f"Invalid pattern /{pattern}/: {str(e).splitlines()[0]}") from None
    return text
