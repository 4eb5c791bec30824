"""C# files: namespaces, types and members."""

from __future__ import annotations

import re

from codeloom.extract.base import Found
from codeloom.extract.braces import Piece, Source, bare, split_top

#: Attributes of tests.
TESTS = frozenset("Test TestCase TestCaseSource Theory Fact InlineData MemberData ClassData TestMethod DataTestMethod".split())
MODIFIERS = "public|private|protected|internal|static|abstract|sealed|virtual|override|readonly|const|volatile|extern|unsafe|new|partial|async|required"

_ATTRIBUTES = re.compile(r"\[([^\[\]]*(?:\[[^\]]*\][^\[\]]*)*)\]\s*")
_TYPE = re.compile(r"^(class|interface|enum|struct|record)\s+(\w+)\s*(?:<[^{:]*?>)?\s*(?:\([^)]*\))?\s*(?::\s*(.*?))?\s*(?:where\s.*)?$", re.S)
_NAMED = re.compile(r"^(?:(.+?)\s+|(.*[\])>?])\s*)?([\w.]+)\s*(?:<[^()]*>)?\s*$", re.S)


def _plain(text: str) -> str:
    return re.sub(r"\s*,\s*", ", ", re.sub(r"\s*([<>\[\]?])\s*", r"\1", " ".join(text.split())))


class _Reader:
    def __init__(self, found: Found, text: str) -> None:
        self.found = found
        self.s = Source(re.sub(r"(?m)^[ \t]*#\w+[^\n]*", lambda m: " " * len(m.group()), text), "csharp")

    def doc(self, at: int) -> str | None:
        """The /// lines before a place, without their tags."""
        lines = []
        for line in reversed(self.s.text[:at].rstrip().split("\n")):
            if not line.strip().startswith("///"):
                break
            lines.append(re.sub(r"</?(?:summary|returns|remarks|para|example|value|param|typeparam|exception)\b[^>]*>", "", line.strip()[3:]).strip())
        text = "\n".join(x for x in reversed(lines) if x)
        return text or None

    def split(self, piece: Piece) -> tuple[list[str], list[str], str, int]:
        at, names, modifiers = piece.begin, [], []
        while True:
            if m := _ATTRIBUTES.match(self.s.clean, at, piece.head_end):
                names += [re.split(r"[(\s]", x.split(":")[-1].strip())[0].split(".")[-1].removesuffix("Attribute") for x in split_top(m.group(1))]
            elif (m := re.compile(rf"(?:{MODIFIERS})\b\s*").match(self.s.clean, at, piece.head_end)) and self.followed(m.end(), piece.head_end):
                modifiers.append(m.group().strip())
            else:
                return names, modifiers, self.s.clean[at : piece.head_end].strip(), at
            at = m.end()

    def followed(self, at: int, end: int) -> bool:
        """Whether a word before this place is a modifier: a bracket after it holds a tuple type, not parameters."""
        clean = self.s.clean
        return at >= end or clean[at] != "(" or bool(re.compile(r"\s*[\w?\[]").match(clean, self.s.match.get(at, end) + 1, end))

    def parameters_at(self, at: int, end: int) -> int:
        """The bracket of a head that opens its parameters: at its own level, right after a name; -1: there is none."""
        clean, depth = self.s.clean, 0
        while at < end:
            c = clean[at]
            if c == "(" and not depth and re.search(r"[\w>]\s*$", clean[max(0, at - 80) : at]) and self.name_before(at):
                return at
            if c in "([":
                at = self.s.match.get(at, end)
            elif c == "=" and not depth:
                return -1
            depth += (c == "<") - (c == ">" and clean[at - 1] != "=")
            at += 1
        return -1

    def name_before(self, at: int) -> bool:
        return not re.search(rf"(?:^|\s)(?:{MODIFIERS})\s*$", self.s.clean[max(0, at - 80) : at])

    def scope(self, begin: int, end: int, space: str, outer: str | None, packages: list[str], top: bool) -> None:
        found, s = self.found, self.s
        for piece in s.pieces(begin, end):
            names, modifiers, head, at = self.split(piece)
            if m := re.match(r"namespace\s+([\w.]+)$", head):
                full = f"{space}.{m.group(1)}" if space else m.group(1)
                line = s.line(piece.begin)
                package = found.node("Package", f"{found.repository}::{full}", full.split(".")[-1], line, line)
                if piece.body >= 0:
                    self.scope(piece.body, piece.body_end, full, None, [package], top)
                else:
                    space, packages = full, [package]
                continue
            m = _TYPE.match(head) if piece.body >= 0 else None
            if m and m.group(1) in ("class", "interface", "enum"):
                self.type(piece, names, modifiers, m, space, outer, packages)
            elif outer:
                self.member(piece, names, modifiers, head, at, space, outer)

    def type(self, piece: Piece, names: list[str], modifiers: list[str], m: re.Match, space: str, outer: str | None, packages: list[str]) -> None:
        found, s = self.found, self.s
        kind, name = m.group(1), m.group(2)
        full = f"{space}.{name}" if space else name
        node_id = f"{found.repository}::{full}"
        code = None
        if kind == "class":
            first = next((p.begin for p in s.pieces(piece.body, piece.body_end) if p.body >= 0 and "(" in s.clean[p.begin : p.head_end]), piece.body_end)
            code = s.text[piece.begin : first].rstrip()
        signature = " ".join([*modifiers, *s.text[s.clean.find(kind, piece.begin) : piece.head_end].split()])
        found.node("Interface" if kind == "interface" else "Class", node_id, name, s.line(piece.begin), s.line(piece.body_end), code=code, signature=signature, docstring=self.doc(piece.begin), modifiers=modifiers, stereotypes=["enum"] if kind == "enum" else [])
        found.edge(found.file_id, node_id, "CONTAINS")
        for package in packages[-1:]:
            found.edge(node_id, package, "IN_PACKAGE")
        if outer:
            found.edge(outer, node_id, "DECLARES")
        extends = False
        for base in split_top(m.group(3) or "") if kind != "enum" else []:
            base = bare(re.sub(r"\(.*", "", base))
            is_class = kind == "class" and not extends and not re.match(r"I[A-Z]", base)
            extends = extends or is_class
            found.edge(node_id, f"external::{base}", "EXTENDS" if is_class else "IMPLEMENTS")
        if kind != "enum":
            self.scope(piece.body, piece.body_end, full, node_id, packages, False)

    def member(self, piece: Piece, names: list[str], modifiers: list[str], head: str, at: int, full: str, owner: str) -> None:
        found, s = self.found, self.s
        last = s.line(piece.body_end if piece.body >= 0 else piece.head_end)
        base = f"{found.repository}::{full}"
        common = {"modifiers": modifiers, "docstring": self.doc(piece.begin)}
        opens = self.parameters_at(at, piece.head_end)
        m = _NAMED.match(s.clean[at:opens]) if opens >= 0 else None
        if m:
            result, name = (m.group(1) or m.group(2) or "").strip(), m.group(3).split(".")[-1]
            if name in ("if", "for", "while", "return") or "operator" in result:
                return
            listed = []
            for x in split_top(s.clean[opens + 1 : s.match.get(opens, opens)]):
                x = re.sub(r"^(?:this|ref|out|in|params)\s+", "", _ATTRIBUTES.sub("", x).split("=")[0].strip())
                p = re.match(r"(.*)\s+(\w+)$", x, re.S)
                if p:
                    listed.append(f"{_plain(p.group(1))} {p.group(2)}")
            is_new = not result
            signature = f"{name}({', '.join(listed)})" if is_new else f"{_plain(result)} {name}({', '.join(listed)})"
            code = s.text[piece.begin : piece.body_end + 1] if piece.body >= 0 else s.text[piece.begin : piece.head_end + 1] if "=>" in head else None
            node_id = found.node("Constructor" if is_new else "Method", f"{base}.{name}", name, s.line(piece.begin), last, code=code, signature=signature, return_type=None if is_new else _plain(result), stereotypes=[] if is_new else ["test"] * bool(set(names) & TESTS), **common)
            found.edge(owner, node_id, "HAS_CONSTRUCTOR" if is_new else "HAS_METHOD")
            return
        accessors = re.search(r"\{[^{}]*\}\s*=", head)
        head = head.replace(accessors.group(), "=") if accessors else head
        left = re.split(r"=", head)[0].strip()
        p = re.match(r"(.+?)\s+(\w+)$", left, re.S)
        if not p or re.match(r"(?:using|event|delegate|return)\b", head):
            return
        is_property = bool(accessors) or piece.body >= 0 and "=" not in head or head[head.find("=") :][:2] == "=>"
        if is_property:
            common["modifiers"] = [*modifiers, "property"]
        for name in [p.group(2)] if is_property else [re.match(r"\w+", x).group() for x in split_top(head[len(p.group(1)) :]) if re.match(r"\w+", x)]:
            node_id = found.node("Field", f"{base}.{name}", name, s.line(piece.begin), last, return_type=_plain(p.group(1)), **common)
            found.edge(owner, node_id, "HAS_FIELD")


def extract(repository: str, path: str, text: str) -> Found:
    """Unbalanced brackets are reported, and what can be read is read."""
    found = Found(repository, path, "csharp")
    reader = _Reader(found, text.replace("\r\n", "\n").replace("\r", "\n"))
    if not reader.s.balanced:
        found.errors.append("syntax error: brackets do not match")
    reader.scope(0, len(reader.s.clean), "", None, [], True)
    return found
