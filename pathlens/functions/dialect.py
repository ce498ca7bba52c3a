"""Patterns of a linear-time regular-expression dialect, rewritten for Java's engine.

The dialect: Unicode classes; ``^`` and ``$`` at the text's ends, at lines' with ``(?m)``; ``.`` everything but a
newline, with ``(?s)`` that too; named groups; POSIX classes, nested classes and the operators ``&&``, ``--`` and
``~~`` in classes; ``(?x)`` with comments; ``\\x{...}`` and ``\\u{...}``; ``\\<`` and ``\\>`` at words' ends. Literal
characters in classes are written as code points, so nothing in them has a meaning for Java. Look-around,
back-references and possessive parts, which the dialect doesn't have, are refused, as are escapes it doesn't know.
"""

from __future__ import annotations

import re

#: POSIX classes.
POSIX = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t\x20",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": r"\x20-~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r\x20",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
#: Long names of general categories, by their letters.
CATEGORIES = {"letter": "L", "lowercase_letter": "Ll", "uppercase_letter": "Lu", "titlecase_letter": "Lt", "mark": "M", "number": "N", "decimal_number": "Nd", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C"}
PLAIN_ESCAPES = {"d", "D", "s", "S", "w", "W", "a", "f", "n", "r", "t"}
OUTSIDE_ESCAPES = {"b": r"\b", "B": r"\B", "A": r"\A", "z": r"\z", "<": r"\b(?=\w)", ">": r"\b(?<=\w)"}


class RegexError(ValueError):
    def __init__(self, why: str):
        lines = [x.strip() for x in str(why).splitlines() if x.strip()]
        super().__init__(f"invalid regex: {lines[-1] if lines else 'empty'}")


def code_point(n: int) -> str:
    return rf"\x{{{n:X}}}"


class _Reader:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0
        self.out: list[str] = []
        self.flags = {"m": False, "x": False}
        self.above: list[dict] = []  # flags outside of each open group

    def peek(self, text: str) -> bool:
        return self.p.startswith(text, self.i)

    def match(self, pattern: str) -> re.Match | None:
        m = re.compile(pattern, re.S).match(self.p, self.i)
        if m:
            self.i = m.end()
        return m

    def translated(self) -> str:
        while self.i < len(self.p):
            ch = self.p[self.i]
            if self.flags["x"] and self.match(r"\s+|#[^\n]*"):
                continue
            if ch == "\\":
                self.out.append(self.escape(False))
            elif ch == "[":
                self.i += 1
                self.out.append(self.char_class())
            elif ch == "(":
                self.group()
            elif ch == ")":
                if not self.above:
                    raise RegexError("unopened group")
                self.flags = self.above.pop()
                self.one(")")
            elif ch == "^":
                self.one(r"(?:\A|(?<=\n))" if self.flags["m"] else r"\A")
            elif ch == "$":
                self.one(r"(?=\n|\z)" if self.flags["m"] else r"\z")
            elif m := self.match(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??"):
                if self.peek("+"):
                    raise RegexError("possessive parts are not supported")
                self.out.append(m[0])
            elif ch == "{":
                raise RegexError("a brace that repeats nothing")
            elif ch in "}]":
                self.one("\\" + ch)
            elif ch in ".|":
                self.one(ch)
            else:
                self.one(code_point(ord(ch)) if ch.isspace() or ch == "#" else ch)
        if self.above:
            raise RegexError("unclosed group")
        return "".join(self.out)

    def one(self, text: str) -> None:
        self.out.append(text)
        self.i += 1

    def group(self) -> None:
        outside = dict(self.flags)
        if self.match(r"\(\?P?<[A-Za-z_][\w.\[\]]*>"):
            self.out.append("(")
        elif m := self.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])"):
            java = self.set_flags(m[1], True) + (f"-{off}" if (off := self.set_flags((m[2] or "-")[1:], False)) else "")
            if not m[1] and not m[2] and m[3] == ")":
                raise RegexError("empty flags")
            if m[3] == ")":  # until the group around ends
                self.out.append(f"(?{java})" if java else "")
                return
            self.out.append(f"(?{java}:")
        elif self.peek("(?"):
            raise RegexError(f"look-around and unknown groups are not supported: {self.p[self.i : self.i + 4]}")
        else:
            self.one("(")
        self.above.append(outside)

    def set_flags(self, letters: str, on: bool) -> str:
        java = ""
        for f in letters:
            if f in "mx":
                self.flags[f] = on
            elif f in "is":
                java += "iu" if f == "i" and on else f
            elif f != "u" or not on:
                raise RegexError(f"flag {f} is not supported")
        return java

    def escape(self, in_class: bool) -> str:
        if m := self.match(r"\\(?:x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|U\{([0-9A-Fa-f]+)\}|U([0-9A-Fa-f]{8}))"):
            n = int(next(g for g in m.groups() if g), 16)
            if n > 0x10FFFF:
                raise RegexError("no such code point")
            return code_point(n)
        if m := self.match(r"\\([pP])(?:\{(\^?)([^}]+)\}|([A-Za-z]))"):
            name = (m[4] or re.split("[=:]", m[3])[-1]).strip()
            short = CATEGORIES.get(name.lower().replace(" ", "_"), name.capitalize() if len(name) <= 2 else None)
            not_ = (m[1] == "P") != bool(m[2])
            return rf"\{'P' if not_ else 'p'}{{{short or 'Is' + name}}}"
        if m := self.match(r"\\b\{(start|end)\}"):
            return OUTSIDE_ESCAPES["<" if m[1] == "start" else ">"]
        ch = self.p[self.i + 1 : self.i + 2]
        self.i += 2
        if ch in PLAIN_ESCAPES and ch:
            return "\\" + ch
        if ch == "v":
            return r"\x0B"
        if not in_class and ch in OUTSIDE_ESCAPES and ch:
            return OUTSIDE_ESCAPES[ch]
        if not ch or ch.isalnum() or ord(ch) > 127:
            raise RegexError(f"unknown escape \\{ch}" if not ch.isdigit() else "back-references are not supported")
        return code_point(ord(ch))

    def char_class(self) -> str:
        """What follows an opening bracket, up to the closing one, as a Java class."""
        negated = bool(self.match(r"\^"))
        sets: list[str] = []
        ops: list[str] = []
        items: list[str] = []
        first = True
        while True:
            if self.i >= len(self.p):
                raise RegexError("unclosed character class")
            if self.flags["x"] and self.match(r"\s+|#[^\n]*"):
                continue
            if self.peek("]") and not first:
                self.i += 1
                break
            if (m := self.match(r"&&|--|~~")) and not first:
                sets.append(self.union(items))
                ops.append(m[0])
                items = []
                continue
            if m:
                self.i -= 2
            if m := self.match(r"\[:(\^?)([a-z]+):\]"):
                if m[2] not in POSIX:
                    raise RegexError(f"unknown class [:{m[2]}:]")
                items.append(f"[{m[1]}{POSIX[m[2]]}]")
            elif self.peek("["):
                self.i += 1
                items.append(self.char_class())
            else:
                low = self.item()
                if self.peek("-") and not self.peek("--") and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                    self.i += 1
                    high = self.item()
                    if not (low.startswith(r"\x") and high.startswith(r"\x")) or int(low[3:-1], 16) > int(high[3:-1], 16):
                        raise RegexError("invalid character class range")
                    low = f"{low}-{high}"
                items.append(low)
            first = False
        made = self.union(items)
        if sets:
            made = sets[0] if not ops else self.combined([*sets, made], ops)
        return f"[^{made}]" if negated else made

    def item(self) -> str:
        if self.peek("\\"):
            made = self.escape(True)
            return {r"\a": code_point(7), r"\f": code_point(12), r"\n": code_point(10), r"\r": code_point(13), r"\t": code_point(9), r"\x0B": code_point(11)}.get(made, made)
        self.i += 1
        return code_point(ord(self.p[self.i - 1]))

    @staticmethod
    def union(items: list[str]) -> str:
        return "[" + "".join(items) + "]" if items else r"[\x{0}&&[^\x{0}]]"

    @staticmethod
    def combined(sets: list[str], ops: list[str]) -> str:
        made = sets[0]
        for op, other in zip(ops, sets[1:]):
            if op == "&&":
                made = f"[{made}&&{other}]"
            elif op == "--":
                made = f"[{made}&&[^{other}]]"
            else:
                made = f"[[{made}&&[^{other}]][{other}&&[^{made}]]]"
        return made


def java_regex(pattern: str, match_case: bool = False) -> str:
    """The pattern for Java's engine, which may still backtrack."""
    return f"(?dU{'' if match_case else 'iu'})" + _Reader(pattern).translated()
