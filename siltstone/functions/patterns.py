"""Search patterns in a dialect without look-around and back-references, made into Java's.

The dialect: Unicode classes; $ is the very end unless (?m), where lines end at \\n alone; . is all but \\n; [[:digit:]] and other named sets are ASCII; classes
nest, and know && (both), -- (without) and ~~ (one of); (?P<name>..); \\x{..}, \\u{..}; flags i, m, s, U (lazy first), u, x. What Java reads otherwise is spelt
out; what the dialect doesn't know, such as (?=, \\1 or \\Z, is a ValueError.
"""

from __future__ import annotations

import re

# The named sets and their members.
SETS = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": r"\x20-~",
    "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_PLAIN = {"t": r"\t", "n": r"\n", "r": r"\r", "f": r"\f", "v": r"\x0B", "a": r"\x07"}
_CLASSES = "dDwWsS"
_EDGES = {
    "A": r"\A", "z": r"\z", "b": r"\b", "B": r"\B", "<": r"\b(?=\w)", ">": r"\b(?<=\w)", "b{start}": r"\b(?=\w)", "b{end}": r"\b(?<=\w)", "b{start-half}": r"(?<!\w)", "b{end-half}": r"(?!\w)",
}
_REPEAT = re.compile(r"\*|\+|\?|\{\s*(\d*)\s*(?:(,)\s*(\d*)\s*)?\}")
_CODE = re.compile(r"x([0-9A-Fa-f]{2})|[xuU]\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})")
_PROPERTY = re.compile(r"([pP])(?:([A-Za-z])|\{(\^?)(?:(?:sc|Script|scx|Script_Extensions|gc|General_Category)[=:])?([A-Za-z_ ]+)\})")
_GROUP = re.compile(r"\?(?:P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>|([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)]))")


def java_pattern(pattern: str) -> str:
    """The pattern for Java, without flags from outside."""
    return "(?U)" + _Reader(pattern).whole()


def _literal(c: str) -> str:
    return f"\\{c}" if c.isascii() and not c.isalnum() and c.isprintable() and c != " " else f"\\x{{{ord(c):X}}}" if not c.isprintable() or c == " " else c


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def fail(self, why: str) -> None:
        raise ValueError(f"{why} at {self.at} of the pattern {self.text!r}")

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def match(self, pattern: re.Pattern[str]) -> re.Match[str] | None:
        found = pattern.match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def whole(self) -> str:
        out = self.alternatives(frozenset("u"))
        if self.at < len(self.text):
            self.fail("a ) without (")
        return out

    def skip(self, flags: frozenset[str]) -> None:
        """Blanks and comments under x."""
        while "x" in flags and self.at < len(self.text):
            if self.peek().isspace():
                self.at += 1
            elif self.peek() == "#":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end + 1
            else:
                return

    def alternatives(self, flags: frozenset[str]) -> str:
        """Up to the end or the ) of this group."""
        out: list[str] = []  # finished atoms, which repeats apply to
        repeatable = False
        while True:
            self.skip(flags)
            c = self.peek()
            if c in ("", ")"):
                return "".join(out)
            if repeat := self.match(_REPEAT):
                if not repeatable:
                    self.fail("nothing to repeat")
                out[-1] = f"(?:{out[-1]}{self.repeat(repeat, flags)})"
                continue
            self.at += 1
            repeatable = True
            if c == "|":
                out.append("|")
                repeatable = False
            elif c == "(":
                inner = flags
                head = "("
                if self.peek() == "?":
                    kind = self.match(_GROUP) or self.fail("no such group")
                    if not kind[1]:
                        inner = self.flagged(flags, kind[2], kind[3] or "")
                        if kind[4] == ")":  # up to the end of the group, alternatives included, in Java too
                            flags, repeatable = inner, False
                            out.append(f"(?{_java(flags)})")
                            continue
                        head = "(?:"
                body = self.alternatives(inner)
                if self.peek() != ")":
                    self.fail("a ( without )")
                self.at += 1
                out.append(f"{head}(?{_java(inner)}:{body}))" if inner != flags else f"{head}{body})")
            elif c == "[":
                out.append(self.set(flags))
            elif c == ".":
                out.append("(?s:.)" if "s" in flags else r"[^\n]")
            elif c == "^":
                out.append(r"(?:\A|(?<=\n))" if "m" in flags else r"\A")
            elif c == "$":
                out.append(r"(?=\n|\z)" if "m" in flags else r"\z")
            elif c == "\\":
                out.append(self.escape(False))
            elif c == "{":
                self.fail("a { that repeats nothing")
            else:
                out.append(_literal(c))

    def flagged(self, flags: frozenset[str], on: str, off: str) -> frozenset[str]:
        if set(on + off) - set("imsUux") or not on + off and self.text[self.at - 1] == ")":
            self.fail("no such flag")
        return (flags | set(on)) - set(off)

    def repeat(self, found: re.Match[str], flags: frozenset[str]) -> str:
        text = found[0]
        if text[0] == "{":
            low, comma, high = found[1], found[2], found[3]
            if not low and not high:
                self.fail("a { that repeats nothing")
            if comma and low and high and int(low) > int(high):
                self.fail("a repeat from more to less")
            text = "{" + (low or "0") + (f",{high}" if comma else "") + "}"
        lazy = self.peek() == "?"
        self.at += lazy
        return text + ("?" if lazy != ("U" in flags) else "")

    def code(self) -> str | None:
        if found := self.match(_CODE):
            value = int(next(x for x in found.groups() if x), 16)
            if value > 0x10FFFF or 0xD800 <= value < 0xE000:
                self.fail("no such character")
            return chr(value)
        return None

    def escape(self, in_set: bool) -> str:
        """What follows a backslash; in a set a character comes as it is."""
        for name in sorted(_EDGES, key=len, reverse=True):
            if not in_set and self.text.startswith(name, self.at):
                self.at += len(name)
                return _EDGES[name]
        if (char := self.code()) is not None:
            return _literal(char)
        if found := self.match(_PROPERTY):
            name = (found[2] or found[4]).replace(" ", "_")
            negative = (found[1] == "P") != bool(found[3])
            return f"\\{'P' if negative else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"
        c = self.peek()
        self.at += 1
        if c in _PLAIN and c:
            return _PLAIN[c]
        if c in _CLASSES and c:
            return f"\\{c}"
        if not c or c.isalnum() or not c.isascii():
            self.at -= 1
            self.fail("no such escape")
        return _literal(c)

    def set(self, flags: frozenset[str]) -> str:
        """A class, after its [. Its members are united; the operators bind less and from the left."""
        negative = self.peek() == "^"
        self.at += negative
        self.skip(flags)
        whole, members, operator = "", [], ""
        first = True

        def join() -> str:
            own = "".join(members) or None
            if not operator:
                return f"[{own}]" if own else ""
            if not own:
                return {"&&": NOTHING, "--": whole, "~~": whole}[operator]
            return {"&&": f"[{whole}&&[{own}]]", "--": f"[{whole}&&[^[{own}]]]", "~~": f"[[{whole}[{own}]]&&[^[{whole}&&[{own}]]]]"}[operator]

        while True:
            self.skip(flags)
            c = self.peek()
            if not c:
                self.fail("a [ without ]")
            if c == "]" and not first:
                self.at += 1
                out = join() or self.fail("an empty class")
                return f"[^{out}]" if negative else out
            first = False
            if self.peek(2) in ("&&", "--", "~~") and (self.peek(2) != "--" or members or operator):
                whole = join()
                if not whole:
                    self.fail("an operator without a left side")
                operator, members = self.peek(2), []
                self.at += 2
                continue
            named = re.compile(r"\[:(\^?)([a-z]+):\]").match(self.text, self.at)
            if named and named[2] in SETS:
                self.at = named.end()
                members.append(f"[{named[1]}{SETS[named[2]]}]")
                continue
            self.at += 1
            if c == "[":
                members.append(self.set(flags))
                continue
            low = self.escape(True) if c == "\\" else _literal(c)
            single = re.fullmatch(r"\\[^dDwWsSpP].*|[^\\]", low, re.S) is not None
            if single and self.peek() == "-" and self.peek(2) not in ("--", "-]"):
                self.at += 1
                self.skip(flags)
                d = self.peek()
                self.at += 1
                high = self.escape(True) if d == "\\" else _literal(d) if d and d != "[" else self.fail("a range without an end")
                if re.fullmatch(r"\\[dDwWsSpP].*", high, re.S):
                    self.fail("a range that ends in a class")
                low = f"{low}-{high}"
            members.append(low)


#: A class without members.
NOTHING = r"[a&&b]"


def _java(flags: frozenset[str]) -> str:
    on = "".join(j for r, j in (("i", "i"), ("u", "U")) if r in flags)
    off = "".join(j for r, j in (("i", "i"), ("u", "U")) if r not in flags)
    return on + (f"-{off}" if off else "")

