"""Members of C++ headers, read token by token: brackets are counted, and strings are one token each."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Strings and characters, which are kept, and comments and preprocessor lines, which are not.
STRINGS = r'R"(?P<mark>[^()\\\s]{0,16})\(.*?\)(?P=mark)"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
SKIPPED = re.compile(rf"(?P<string>{STRINGS})|//[^\n]*|/\*.*?\*/|(?m:^[ \t]*\#(?:[^\n\\]|\\.)*)", re.DOTALL)
TOKEN = re.compile(rf"{STRINGS}|\w+|::|\S", re.DOTALL)
OPEN, CLOSE = "([{", ")]}"
#: The marks of members, words of a declaration that are no part of its type, and module macros.
MARKS = {"UFUNCTION": "function", "UPROPERTY": "property"}
NO_TYPE = {"virtual", "static", "inline", "FORCEINLINE", "explicit"}
API = re.compile(r"[A-Z0-9_]+_API")
WORD = re.compile(r"[A-Za-z_]\w*")
QUALIFIERS = ("const", "override", "final", "noexcept")


def without_comments(text: str) -> str:
    """The text without comments and preprocessor lines; what looks like one in a string stays."""
    return SKIPPED.sub(lambda m: m["string"] or "\n" * m[0].count("\n") * m[0].lstrip().startswith("#"), text)


class Declarations:
    """A header's tokens, with their places in the text without comments."""

    def __init__(self, text: str):
        self.text = without_comments(text)
        found = list(TOKEN.finditer(self.text))
        self.tokens = [m[0] for m in found]
        self.starts = [m.start() for m in found]
        self.ends = [m.end() for m in found]

    def written(self, i: int, j: int) -> str:
        """Tokens i to j as they are written, with single spaces."""
        return " ".join(self.text[self.starts[i] : self.ends[j - 1]].split()) if i < j else ""

    def closing(self, i: int) -> int:
        """The place after the bracket that closes the one at i, or the end."""
        depth = 0
        for k in range(i, len(self.tokens)):
            depth += (self.tokens[k] in OPEN) - (self.tokens[k] in CLOSE)
            if depth == 0:
                return k + 1
        return len(self.tokens)

    def find(self, wanted: str, i: int, end: int) -> int:
        """The first token from i of one of these kinds outside of round, square and curly brackets, or the bracket
        that closes what i stands in, or end."""
        while i < end:
            if self.tokens[i] in wanted or self.tokens[i] in CLOSE:
                return i
            i = self.closing(i) if self.tokens[i] in OPEN else i + 1
        return end

    def angled(self, i: int, end: int) -> int:
        """The place after the angle bracket that closes the one at i, or after i where none does."""
        depth = 0
        for k in range(i, end):
            depth += (self.tokens[k] == "<") - (self.tokens[k] == ">" and self.tokens[k - 1] != "-")
            if depth == 0:
                return k + 1
            if self.tokens[k] in ";{":
                break
        return i + 1

    def opened(self, i: int, end: int) -> int:
        """The bracket of the parameters of a function declared from i on, or what ends the declaration."""
        while i < end and self.tokens[i] not in "(;{":
            i = self.angled(i, end) if self.tokens[i] == "<" and self.tokens[i - 1] != "operator" else i + 1
        return i

    def listed(self, i: int, j: int) -> list[str]:
        """What commas outside of all brackets part, angle brackets being brackets too."""
        out, depth, at = [], 0, i
        for k in range(i, j + 1):
            t = self.tokens[k] if k < j else ","
            if k == j or (t == "," and depth == 0):
                out.append(self.written(at, k))
                at = k + 1
            elif t in "([{<":
                depth += 1
            elif t in ")]}" or (t == ">" and self.tokens[k - 1] != "-"):
                depth -= 1
        return [x for x in out if x]

    def type_before(self, i: int, name: int) -> str | None:
        while i < name and (self.tokens[i] in NO_TYPE or API.fullmatch(self.tokens[i])):
            i += 1
        return self.written(i, name) or None

    def function(self, i: int) -> tuple[dict, int]:
        """The function declared from i on, and the place after it; its body is not part of it."""
        end = len(self.tokens)
        opened = self.opened(i, end)
        while opened < end and self.tokens[opened] == "(" and opened > i and self.tokens[opened - 1].isupper() and (after := self.closing(opened)) < end and WORD.fullmatch(self.tokens[after]) and self.tokens[after] not in QUALIFIERS:
            i = after  # a macro before the type
            opened = self.opened(i, end)
        if opened == end or self.tokens[opened] != "(" or opened == i:
            return {}, opened
        if self.tokens[opened - 1] == "operator":  # the call operator
            opened = self.closing(opened)
            if opened == end:
                return {}, opened
        closed = self.closing(opened)
        last = self.find(";{", closed, end)
        name = next((k for k in range(i, opened) if self.tokens[k] == "operator"), opened - 1)
        tail = self.tokens[closed:last]
        params = self.listed(opened + 1, closed - 1)
        member = {"name": self.written(name, opened), "type": self.type_before(i, name), "param_list": params, "is_virtual": "virtual" in self.tokens[i:name], "is_const": "const" in tail, "is_override": "override" in tail}
        return member, last

    def property(self, i: int) -> tuple[dict, int]:
        """The property declared from i on, and the place after it."""
        end = len(self.tokens)
        last = self.find(";", i, end)
        stop = self.find("=:{[", i, last)
        name = stop - 1
        if name < i or not WORD.fullmatch(self.tokens[name]):
            return {}, last
        size = ""
        while stop < last and self.tokens[stop] == "[":
            size += self.written(stop, self.closing(stop))
            stop = self.closing(stop)
        default = None
        if stop < last and self.tokens[stop] == "=":
            default = self.written(stop + 1, last)
        elif stop < last and self.tokens[stop] == "{":
            default = self.written(stop, last)
        kind = self.type_before(i, name)
        return {"name": self.tokens[name], "type": kind + size if kind else size or None, "default_value": default}, last

    def class_at(self, i: int) -> tuple[str | None, int]:
        """The name of the class or struct whose body opens next, and the place of its brace; None for others."""
        if i and self.tokens[i - 1] in ("enum", "friend", "<", ","):
            return None, i + 1
        k, name = i + 1, None
        while k < len(self.tokens) and (WORD.fullmatch(self.tokens[k]) or self.tokens[k] == "("):
            if self.tokens[k] == "(":
                k = self.closing(k)
                continue
            if self.tokens[k] in ("class", "struct", "enum"):
                return None, k
            if not API.fullmatch(self.tokens[k]) and self.tokens[k] not in ("final", "alignas"):
                name = self.tokens[k]
            k += 1
        if k < len(self.tokens) and self.tokens[k] == ":":
            k = self.find("{;", k, len(self.tokens))
        return (name, k) if k < len(self.tokens) and self.tokens[k] == "{" else (None, i + 1)

    def members(self) -> Iterator[dict]:
        """Functions and properties, each with the class in whose braces it stands, else the one declared last."""
        scopes: list[str | None] = []
        last_class, i, line, counted = None, 0, 1, 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t in ("class", "struct"):
                name, i = self.class_at(i)
                if name:
                    scopes.append(name)
                    last_class = name
                    i += 1
            elif t in MARKS and i + 1 < len(self.tokens) and self.tokens[i + 1] == "(":
                kind, closed = MARKS[t], self.closing(i + 1)
                member, after = (self.function if kind == "function" else self.property)(closed)
                if member:
                    line += self.text.count("\n", counted, self.starts[i])
                    counted = self.starts[i]
                    owner = next((s for s in reversed(scopes) if s), last_class)
                    yield {"kind": kind, "line": line, "owner": owner, "specifier_list": self.listed(i + 2, closed - 1)} | member
                i = max(after, closed)
            else:
                if t == "{":
                    scopes.append(None)
                elif t == "}" and scopes:
                    scopes.pop()
                i += 1
