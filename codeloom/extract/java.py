"""Java files: packages, types, members and calls."""

from __future__ import annotations

import re

from codeloom.extract.base import Found, first_of
from codeloom.extract.braces import Piece, Source, bare, split_top

#: Annotations by which methods and classes get a stereotype.
TESTS = ("Test", "ParameterizedTest", "RepeatedTest", "TestFactory")
ENDPOINTS = ("RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping")
CLASSES = {"Service": "service", "Repository": "repository", "Component": "component", "RestController": "rest_controller", "Controller": "controller", "Configuration": "configuration"}
MODIFIERS = "public|protected|private|static|final|abstract|native|synchronized|transient|volatile|strictfp|default|sealed|non-sealed"

_ANNOTATION = re.compile(r"@([\w.]+)(?:\s*\((?:[^()]|\([^()]*\))*\))?\s*")
_TYPE = re.compile(r"\b(class|interface|enum)\s+(\w+)\s*(<.*?>(?=\s*(?:extends|implements|permits|$)))?\s*(?:extends\s+(.*?))?\s*(?:implements\s+(.*?))?\s*(?:permits\s+.*)?$", re.S)
_METHOD = re.compile(r"^(?:([\w.<>\[\],?&\s]+?)\s+)?(\w+)\s*\(", re.S)
_RECORD = re.compile(r"record\s+\w+\s*[<(]")
_CALL = re.compile(r"\b(\w+)\s*\(")
_NO_CALL = frozenset("if for while switch catch return synchronized super this new assert throw try else do".split())


def _after_type_parameters(head: str) -> str:
    """A head without the type parameters that it begins with, which may be bounded by types with arguments."""
    depth = 0
    for i, c in enumerate(head if head.startswith("<") else ""):
        depth += (c == "<") - (c == ">")
        if not depth:
            return head[i + 1 :].lstrip()
    return head


def _plain(type_text: str) -> str:
    return re.sub(r"\s*([<>,\[\]])\s*", r"\1", " ".join(type_text.split()))


class _Reader:
    def __init__(self, found: Found, text: str) -> None:
        self.found, self.s = found, Source(text, "java")
        m = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", self.s.clean)
        self.package = m.group(1) if m else ""
        self.package_id = None
        if m:
            line = self.s.line(m.start(1))
            self.package_id = found.node("Package", f"{found.repository}::{self.package}", self.package, line, line)

    def split(self, piece: Piece) -> tuple[list[str], list[str], str, int]:
        """Annotations, modifiers, the rest of a head and where it begins."""
        at, names, modifiers = piece.begin, [], []
        while True:
            if (m := _ANNOTATION.match(self.s.clean, at, piece.head_end)) and m.group(1) != "interface":
                names.append(m.group(1).split(".")[-1])
            elif m := re.compile(rf"(?:{MODIFIERS})\b\s*").match(self.s.clean, at, piece.head_end):
                modifiers.append(m.group().strip())
            else:
                return names, modifiers, self.s.clean[at : piece.head_end].strip(), at
            at = m.end()

    def types(self, begin: int, end: int, prefix: str, outer: str | None) -> list[Piece]:
        """Reads the types between two places and gives the other pieces back."""
        rest = []
        for piece in self.s.pieces(begin, end):
            names, modifiers, head, at = self.split(piece)
            m = _TYPE.search(head) if piece.body >= 0 and "(" not in head.split("{")[0] else None
            if not m or not head.startswith(m.group(1)):
                rest.append(piece)
                continue
            self.type(piece, names, modifiers, m, at, prefix, outer)
        return rest

    def type(self, piece: Piece, names: list[str], modifiers: list[str], m: re.Match, at: int, prefix: str, outer: str | None) -> None:
        found, s = self.found, self.s
        kind, name = m.group(1), m.group(2)
        full = f"{prefix}.{name}" if prefix else name
        node_id = f"{found.repository}::{full}"
        kinds = [v for k, v in CLASSES.items() if k in names] + ["enum"] * (kind == "enum")
        signature = " ".join([*modifiers, *s.text[at : piece.head_end].split()])
        found.node("Interface" if kind == "interface" else "Class", node_id, name, s.line(piece.begin), s.line(piece.body_end), signature=signature, docstring=s.doc_before(piece.begin), modifiers=modifiers, stereotypes=kinds)
        found.edge(found.file_id, node_id, "CONTAINS")
        if self.package_id:
            found.edge(node_id, self.package_id, "IN_PACKAGE")
        if outer:
            found.edge(outer, node_id, "DECLARES")
        supers = [(x, "EXTENDS") for x in split_top(m.group(4) or "")] + [(x, "IMPLEMENTS") for x in split_top(m.group(5) or "")]
        for x, relation in supers:
            if "." not in bare(x):
                found.edge(node_id, f"{found.repository}::{self.package + '.' if self.package else ''}{bare(x)}", relation)
        begin = piece.body
        if kind == "enum":
            begin = next((i.end() for i in re.finditer(";", s.clean[piece.body : piece.body_end])), piece.body_end - piece.body) + piece.body
        members = self.types(begin, piece.body_end, full, node_id)
        self.members(members, name, full, node_id)

    def parameters(self, at: int) -> list[tuple[str, str]]:
        """(type, name) of each parameter in the brackets that open at a place; variable ones are left out."""
        out = []
        for x in split_top(self.s.clean[at + 1 : self.s.match.get(at, at)]):
            x = re.sub(r"\bfinal\s+", "", _ANNOTATION.sub("", x)).strip()
            m = re.match(r"(.*?)\s*(\w+)\s*((?:\[\s*\])*)$", x, re.S)
            if m and m.group(1) and "..." not in m.group(1):
                out.append((_plain(m.group(1) + m.group(3)), m.group(2)))
        return out

    def members(self, pieces: list[Piece], name: str, full: str, node_id: str) -> None:
        found, s = self.found, self.s
        methods: list[tuple[str, str, int, Piece]] = []
        for piece in pieces:
            names, modifiers, head, at = self.split(piece)
            if piece.body >= 0 and _RECORD.match(head):
                continue
            bare_head = _after_type_parameters(head)
            at += len(head) - len(bare_head)
            m = _METHOD.match(bare_head)
            opens = s.clean.find("(", at, piece.head_end)
            if m and opens >= 0 and "=" not in s.clean[at:opens] and m.group(2) not in _NO_CALL:
                parameters = self.parameters(opens)
                called, result = m.group(2), (m.group(1) or "").strip()
                is_new = not result
                member = f"{found.repository}::{full}.{called}({','.join(t for t, _ in parameters)})"
                listed = ", ".join(f"{t} {n}" for t, n in parameters)
                signature = f"{called}({listed})" if is_new else f"{_plain(result)} {called}({listed})"
                kinds = [] if is_new else ["test"] * any(x in TESTS for x in names) + ["endpoint"] * any(x in ENDPOINTS for x in names)
                code = s.text[piece.begin : (piece.body_end + 1 if piece.body >= 0 else piece.head_end + 1)] if piece.body >= 0 else None
                found.node(
                    "Constructor" if is_new else "Method", member, called, s.line(piece.begin), s.line(piece.body_end if piece.body >= 0 else piece.head_end), code=code, signature=signature,
                    return_type=None if is_new else _plain(result), docstring=s.doc_before(piece.begin), modifiers=modifiers, stereotypes=kinds,
                )
                found.edge(node_id, member, "HAS_CONSTRUCTOR" if is_new else "HAS_METHOD")
                if not is_new:
                    methods.append((called, member, len(parameters), piece))
            elif piece.body < 0 or "=" in head:
                left = re.split(r"=(?!=)", head)[0]
                f = re.match(r"(.+?)\s+(\w+(?:\s*(?:\[\s*\])*\s*(?:=.*?)?,\s*\w+)*)\s*((?:\[\s*\])*)$", left.strip(), re.S)
                if not f or re.match(r"(?:import|package|return|throw)\b", head):
                    continue
                for x in split_top(head[len(f.group(1)) :]):
                    field = re.match(r"\w+", x)
                    if field:
                        fid = found.node("Field", f"{found.repository}::{full}.{field.group()}", field.group(), s.line(piece.begin), s.line(piece.head_end), modifiers=modifiers, docstring=s.doc_before(piece.begin), properties={"field_type": _plain(f.group(1))})
                        found.edge(node_id, fid, "HAS_FIELD")
        self.calls(name, full, methods)

    def called_on(self, begin: int, at: int) -> str | None:
        """The text of what a call whose name begins at a place is made on: names, calls, indexes and literals joined by dots."""
        s, end, first = self.s, None, True
        while True:
            while at > begin and s.clean[at - 1].isspace():
                at -= 1
            if first or at > begin and s.clean[at - 1] == ".":
                if s.clean[at - 1] != ".":
                    return None
                at -= 1
                end = at if end is None else end
                while at > begin and s.clean[at - 1].isspace():
                    at -= 1
            else:
                break
            first = False
            while at > begin and s.clean[at - 1] in ")]":
                at = s.opened.get(at - 1, begin)
            while at > begin and (s.clean[at - 1].isalnum() or s.clean[at - 1] in "_$"):
                at -= 1
        if new := re.search(r"\bnew\s*$", s.clean[begin:at]):
            at = begin + new.start()
        return s.text[at:end].strip()

    def calls(self, owner: str, full: str, methods: list[tuple[str, str, int, Piece]]) -> None:
        """Calls of each method: of this class's methods by name and number of arguments, else of references."""
        found, s = self.found, self.s
        for _, member, _, piece in methods:
            if piece.body < 0:
                continue
            seen: set[str] = set()
            for m in _CALL.finditer(s.clean, piece.body, piece.body_end):
                called = m.group(1)
                if called in _NO_CALL or re.search(r"\bnew\s+[\w.<>]*$", s.clean[max(piece.body, m.start() - 60) : m.start(1)]):
                    continue
                of = self.called_on(piece.body, m.start(1))
                own = of in (None, "this", owner, full)
                text = f"{full if own else of}.{called}"
                opens = m.end() - 1
                n = len(split_top(s.clean[opens + 1 : s.match.get(opens, opens)]))
                if text in seen:
                    continue
                seen.add(text)
                if own:
                    exact = first_of([i for c, i, k, _ in methods if c == called and k == n])
                    named = first_of([i for c, i, _, _ in methods if c == called])
                    target = exact[0] if len(exact) == 1 else named[0] if len(named) == 1 else None
                    if target:
                        found.edge(member, target, "CALLS")
                        continue
                reference = f"{member}::ref:{text}"
                line = s.line(m.start(1))
                found.node("Reference", reference, text, line, line, properties={"symbol": text})
                found.edge(member, reference, "CALLS")


def extract(repository: str, path: str, text: str) -> Found:
    """Syntax errors are not reported; what can be read is."""
    found = Found(repository, path, "java")
    reader = _Reader(found, text.replace("\r\n", "\n").replace("\r", "\n"))
    reader.types(0, len(reader.s.clean), reader.package, None)
    return found
