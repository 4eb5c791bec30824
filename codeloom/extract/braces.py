"""Reading declarations of languages with braces, without a full parse.

Comments and literals are blanked out first, so that brackets and words can be trusted; then the pieces between
semicolons and blocks are taken one after the other and told apart by their heads.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

_BLANK = {
    "java": re.compile(r"//[^\n]*|/\*(?s:.*?)\*/|\"\"\"(?s:.*?)\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"),
    "csharp": re.compile(r"//[^\n]*|/\*(?s:.*?)\*/|\$*\"\"\"(?s:.*?)\"\"\"|\$?@\$?\"(?:[^\"]|\"\")*\"|\$?\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"),
    "script": re.compile(r"//[^\n]*|/\*(?s:.*?)\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\(?s:.))*`|(?<=[=(,:!&|?;\n])[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"),
}
_SIGN = re.compile(r"[(){}\[\];]")
_OPEN = {")": "(", "]": "[", "}": "{"}


class Piece(NamedTuple):
    """A head from `begin` to `head_end`, and a block from `body` to `body_end` (-1: none)."""

    begin: int
    head_end: int
    body: int
    body_end: int


class Source:
    def __init__(self, text: str, language: str) -> None:
        self.text = text
        self.clean = _BLANK[language].sub(lambda m: re.sub(r"[^\n]", "_" if m.group()[0] in "\"'`$@" else " ", m.group()), text)
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.match: dict[int, int] = {}
        self.opened: dict[int, int] = {}
        stack: list[int] = []
        self.balanced = True
        for m in _SIGN.finditer(self.clean):
            c = m.group()
            if c in "([{":
                stack.append(m.start())
            elif c != ";":
                if stack and self.clean[stack[-1]] == _OPEN[c]:
                    self.opened[m.start()] = stack[-1]
                    self.match[stack.pop()] = m.start()
                else:
                    self.balanced = False
        self.balanced = self.balanced and not stack

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def pieces(self, begin: int, end: int) -> Iterator[Piece]:
        """Declarations or statements between two places: up to a semicolon, or a block that ends them."""
        at, clean = begin, self.clean
        start = self.skip(begin, end)
        while True:
            m = _SIGN.search(clean, at, end)
            if m is None:
                if clean[start:end].strip():
                    yield Piece(start, end, -1, -1)
                return
            c, at = m.group(), m.end()
            if c == ";":
                if m.start() > start:
                    yield Piece(start, m.start(), -1, -1)
                start = self.skip(at, end)
            elif c in "([{":
                close = self.match.get(m.start(), end)
                at = close + 1
                if c == "{":
                    following = clean[at:end].lstrip()[:1]
                    if following in (",", ".", ")", "=", "?", ":") or re.search(r"=\s*$|=>\s*$", clean[start : m.start()]) and following == ";":
                        continue
                    yield Piece(start, m.start(), m.start() + 1, min(close, end))
                    start = self.skip(at, end)

    def skip(self, at: int, end: int) -> int:
        m = re.compile(r"[\s;]*").match(self.clean, at, end)
        return m.end()

    def doc_before(self, at: int) -> str | None:
        """The nearest /** */ before a place; line comments between are passed over, anything else is not."""
        head = re.sub(r"(?:^|\n)[ \t]*//[^\n]*(?=\n|$)", "\n", self.text[:at]).rstrip() if "//" in self.text[max(0, at - 400) : at] else self.text[:at].rstrip()
        if not head.endswith("*/"):
            return None
        begin = head.rfind("/*")
        raw = head[begin:]
        if not raw.startswith("/**"):
            return None
        lines = [re.sub(r"^\s*\*?\s?", "", x).rstrip() for x in raw[3:-2].split("\n")]
        return "\n".join(lines).strip()


def split_top(text: str, sign: str = ",") -> list[str]:
    """Parts of a list at its own level of brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1 : i] != "=":
            depth -= 1
        elif c == sign and depth <= 0:
            out.append(text[last:i])
            last = i + 1
    out.append(text[last:])
    return [x.strip() for x in out if x.strip()]


def bare(name: str) -> str:
    """A type without its arguments."""
    return name.split("<")[0].strip()
