"""JavaScript and TypeScript files: classes, functions, interfaces, namespaces, tests, exports and hooks."""

from __future__ import annotations

import re

from codeloom.extract.base import Found, first_of
from codeloom.extract.braces import Piece, Source

#: Calls that declare tests.
TESTS = ("describe", "it", "test", "beforeEach", "afterEach", "beforeAll", "afterAll")

_HEAD = re.compile(r"^(export\s+)?(default\s+)?(?:declare\s+)?(?:abstract\s+)?(async\s+)?(class|interface|function\s*\*?|namespace|module)(?![\w$])\s*([\w.$]*)")
_CONST = re.compile(r"^(export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::((?:=>|[^=])*?))?=(?!>)\s*(.*)$", re.S)
_ARROW = re.compile(r"(?:[\w.$]+\s*(?:<[^()]*>)?\(\s*)*(async\s+)?(?:(\()|([\w$]+)\s*=>|function\b\s*\*?\s*[\w$]*\s*(?:<[^()]*>)?\s*(\())")
_MEMBER = re.compile(r"(?:^|\n)\s*((?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*)\*?\s*(#?[\w$]+)\s*(?:<[^()]*>)?\s*\(")
_CLAUSE = re.compile(r"\bexport\s*\{([^}]*)\}")
_HOOK = re.compile(r"(?<![\w$.])(use[\w$]*)\s*(?:<[^()]*>)?\(")


class _Reader:
    def __init__(self, found: Found, text: str) -> None:
        self.found, self.s = found, Source(text, "script")
        self.hooks: set[str] = set()
        self.exports: dict[str, str] = {}
        for m in _CLAUSE.finditer(self.s.clean):
            for x in m.group(1).split(","):
                if name := re.match(r"\s*(?:type\s+)?([\w$]+)", x):
                    self.exports.setdefault(name.group(1), "named")
        for m in re.finditer(r"\bexport\s+(default\s+)?(?:abstract\s+|async\s+|declare\s+)*(?:class|function\*?|interface|const|let|var|namespace|enum|type)\s+([\w$]+)", self.s.clean):
            self.exports[m.group(2)] = "default" if m.group(1) or self.exports.get(m.group(2)) == "default" else "named"
        if m := re.search(r"\bexport\s+default\s+([\w$]+)\s*(?:;|\n|$)", self.s.clean):
            self.exports[m.group(1)] = "default"

    def parameters(self, at: int) -> str:
        return " ".join(self.s.text[at + 1 : self.s.match.get(at, at)].split())

    def result(self, at: int, end: int) -> str | None:
        m = re.compile(r"\s*:\s*(.+?)\s*(?:=>\s*)?$", re.S).match(self.s.text, self.s.match.get(at, at) + 1, end)
        return " ".join(m.group(1).split()) if m else None

    def add(self, label: str, path: str, name: str, piece: Piece, begin: int | None = None, **more) -> str:
        s, end = self.s, piece.body_end if piece.body >= 0 else piece.head_end
        line = s.line(piece.begin)
        more.setdefault("docstring", s.doc_before(piece.begin))
        more.setdefault("code", s.text[piece.begin if begin is None else begin : end + (piece.body >= 0)])
        return self.found.node(label, self.found.local_id(path, line), name, line, s.line(end), **more)

    def uses(self, source: str, begin: int, end: int) -> None:
        """Hooks called between two places, each once for the source and as one node for the file."""
        for name in first_of([m.group(1) for m in _HOOK.finditer(self.s.clean, begin, end)]):
            hook = f"{self.found.file_id}#{name}"
            if name not in self.hooks:
                self.hooks.add(name)
                line = self.s.line(next(m.start() for m in _HOOK.finditer(self.s.clean, begin, end) if m.group(1) == name))
                self.found.node("Hook", hook, name, line, line)
            self.found.edge(source, hook, "USES_HOOK")

    def top(self) -> None:
        found, s = self.found, self.s
        for piece in self.pieces():
            head = s.clean[piece.begin : piece.head_end].strip()
            head = re.sub(r"^(?:@[\w.]+(?:\([^)]*\))?\s*)+", "", head)
            if m := _HEAD.match(head):
                self.declared(piece, m)
            elif m := _CONST.match(s.clean[piece.begin : piece.head_end]):
                self.constant(piece, m)
            elif m := re.match(r"(\w+)(?:\.\w+)*\s*\(", head):
                if m.group(1) in TESTS:
                    said = re.search(r"\(\s*([\"'`])(.*?)\1", s.text[piece.begin : piece.head_end])
                    stem = self.found.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    path = "_".join(re.sub(r"\W+", "_", x) for x in (stem, m.group(1), said.group(2) if said else "") if x)
                    node = self.add("Method", path, said.group(2) if said else m.group(1), piece, stereotypes=["test"])
                    found.edge(found.file_id, node, "CONTAINS")
        for node in list(found.nodes):
            if kind := self.exports.get(node["name"]):
                found.edge(found.file_id, node["id"], "EXPORTS", {"export_type": kind})

    def pieces(self) -> list[Piece]:
        """Top-level statements. A line end also parts them where no bracket is open and the next line begins a statement."""
        out = []
        for p in self.s.pieces(0, len(self.s.clean)):
            at = p.begin
            for m in re.finditer(r"\n(?=(?:export|import|const|let|var|function|class|async|abstract|interface|namespace|type|enum|@|describe|it|test|before\w+|after\w+)\b)", self.s.clean[p.begin : p.head_end]):
                inside = self.s.clean[at : p.begin + m.start()]
                if inside.count("(") == inside.count(")") and inside.count("{") == inside.count("}") and not re.search(r"[=,(]\s*$", inside):
                    if not inside.lstrip().startswith("@"):
                        out.append(Piece(at, p.begin + m.start(), -1, -1))
                        at = p.begin + m.end()
            out.append(Piece(at, p.head_end, p.body, p.body_end))
        return out

    def declared(self, piece: Piece, m: re.Match) -> None:
        found, s = self.found, self.s
        kind, name = m.group(4).rstrip("* "), m.group(5) or "default"
        if kind in ("namespace", "module") and name.startswith("."):
            return  # a property of the module object
        if kind in ("namespace", "module"):
            found.edge(found.file_id, self.add("Package", name, name, piece, code=None), "CONTAINS")
        elif kind == "interface":
            found.edge(found.file_id, self.add("Interface", name, name, piece), "CONTAINS")
        elif kind == "class":
            members = [x for x in s.pieces(piece.body, piece.body_end) if x.body >= 0 and _MEMBER.search(s.clean[x.begin - 1 if x.begin else 0 : x.head_end])] if piece.body >= 0 else []
            stop = members[0].begin if members else piece.body_end
            node = self.add("Class", name, name, piece, code=s.text[piece.begin : stop].rstrip(), signature=" ".join(s.text[piece.begin : piece.head_end].split()))
            found.edge(found.file_id, node, "CONTAINS")
            for x in members:
                self.method(x, name, node)
        else:
            at = s.clean.find("(", piece.begin, piece.head_end)
            if piece.body < 0 or at < 0:
                return
            result = self.result(at, piece.head_end)
            node = self.add("Method", name, name, piece, signature=f"function {name}({self.parameters(at)})", return_type=result, modifiers=["async"] if m.group(3) else [])
            found.edge(found.file_id, node, "CONTAINS")
            self.uses(node, piece.body, piece.body_end)

    def method(self, piece: Piece, owner: str, owner_id: str) -> None:
        s = self.s
        found = list(_MEMBER.finditer("\n" + s.clean[piece.begin : piece.head_end]))
        m = next((x for x in found if x.group(2) not in ("if", "for", "while", "switch", "catch", "function")), None)
        if not m:
            return
        begin = piece.begin + m.start(1 if m.group(1) else 2) - 1
        name, at = m.group(2), s.clean.find("(", piece.begin + m.start(2) - 1, piece.head_end)
        piece = Piece(begin, piece.head_end, piece.body, piece.body_end)
        result = self.result(at, piece.head_end)
        modifiers = [x for x in m.group(1).split() if x in ("static", "async", "private", "public", "protected", "readonly", "abstract", "override")]
        node = self.add("Constructor" if name == "constructor" else "Method", f"{owner}.{name}", name, piece, signature=f"{name}({self.parameters(at)})" + (f": {result}" if result else ""), return_type=result, modifiers=modifiers)
        self.found.edge(owner_id, node, "HAS_CONSTRUCTOR" if name == "constructor" else "HAS_METHOD")
        self.uses(node, piece.body, piece.body_end)

    def constant(self, piece: Piece, m: re.Match) -> None:
        """A function kept in a constant, also within calls that wrap it."""
        s = self.s
        value = piece.begin + m.start(4)
        a = _ARROW.match(s.clean, value, piece.head_end)
        if not a:
            return
        at = a.start(2) if a.group(2) else a.start(4) if a.group(4) else -1
        after = s.clean[s.match.get(at, at) + 1 : piece.head_end] if at >= 0 else ""
        arrow = re.match(r"\s*(?::((?:=>|[^=])*?))?=>", after, re.S)
        if a.group(2) and not arrow:
            return
        result = self.result(at, piece.head_end) if a.group(4) else " ".join(arrow.group(1).split()) or None if arrow and arrow.group(1) else None
        result = result or (" ".join(m.group(3).split()) if m.group(3) else None)
        parameters = self.parameters(at) if at >= 0 else a.group(3) or ""
        begin = piece.begin + m.start(2)
        node = self.add("Method", m.group(2), m.group(2), piece, begin=begin, signature=f"const {m.group(2)} = ({parameters}) =>" + (f": {result}" if result else ""), return_type=result, modifiers=["async"] if a.group(1) else [])
        self.found.edge(self.found.file_id, node, "CONTAINS")
        self.uses(node, value, piece.body_end if piece.body >= 0 else piece.head_end)


def extract(repository: str, path: str, text: str) -> Found:
    found = Found(repository, path, "typescript" if path.endswith((".ts", ".tsx")) else "javascript")
    _Reader(found, text.replace("\r\n", "\n").replace("\r", "\n")).top()
    return found
