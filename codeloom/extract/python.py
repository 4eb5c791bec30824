"""Python files: classes, functions, fields and calls, by the standard syntax tree."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from codeloom.extract.base import Found, first_of

#: Names by which classes and functions get a stereotype.
ENUMS = ("Enum", "IntEnum", "StrEnum", "Flag", "IntFlag")
BASES = {
    "pydantic_model": ("BaseModel", "pydantic.BaseModel"),
    "django_model": ("Model", "models.Model", "django.db.models.Model"),
    "enum": (*ENUMS, *(f"enum.{x}" for x in ENUMS)),
}
TASKS = ("task", "app.task", "shared_task", "celery.shared_task")
ENDPOINTS = ("api_view", "require_http_methods", "require_GET", "require_POST", "require_safe")
MODIFIERS = {"abstractmethod": "abstract", "staticmethod": "static", "classmethod": "classmethod", "property": "property"}

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _nodes_in(node: ast.AST) -> Iterator[ast.AST]:
    """A node and all below it, level by level, without the marks of contexts and operators, which no reader needs."""
    todo = [node]
    for x in todo:
        yield x
        for name in x._fields:
            if name not in ("ctx", "op", "ops"):
                value = getattr(x, name, None)
                if isinstance(value, list):
                    todo += [y for y in value if isinstance(y, ast.AST)]
                elif isinstance(value, ast.AST):
                    todo.append(value)


class _Reader:
    def __init__(self, found: Found, source: str) -> None:
        self.found, self.lines = found, source.split("\n")
        self.by_path: dict[str, str] = {}

    def text(self, node: ast.AST, end: ast.AST | None = None) -> str:
        """The source of a node, or from its begin to the end of another."""
        a, b = node, end or node
        rows = [x.encode() for x in self.lines[a.lineno - 1 : b.end_lineno]]
        rows[-1] = rows[-1][: b.end_col_offset]
        rows[0] = rows[0][a.col_offset :]
        return b"\n".join(rows).decode()

    def header(self, node: ast.AST) -> str:
        """A definition up to the colon before its body."""
        rows = [x.encode() for x in self.lines[node.lineno - 1 : node.body[0].lineno]]
        rows[-1] = rows[-1][: node.body[0].col_offset] if len(rows) > 1 or node.body[0].lineno == node.lineno else rows[-1]
        rows[0] = rows[0][node.col_offset :]
        text = b"\n".join(rows).decode()
        depth = 0
        for m in re.finditer(r"\"[^\"\n]*\"|'[^'\n]*'|#[^\n]*|[()\[\]{}:]", text):
            c = m.group()
            depth += (c in "([{") - (c in ")]}")
            if c == ":" and depth == 0:
                return " ".join(text[: m.start()].split())
        return " ".join(text.split())

    def docstring(self, node: ast.AST) -> str | None:
        first = node.body[0] if node.body else None
        if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
            return None
        raw = self.text(first)
        quote = re.match(r"([A-Za-z]*)(\"\"\"|'''|\"|')", raw)
        if raw.count(quote.group(2)) > 2:  # several literals joined are no docstring
            return None
        body = raw[quote.end() : len(raw) - len(quote.group(2))]
        lines = [x.strip() for x in body.split("\n")]
        while lines and not lines[0]:
            lines.pop(0)
        while lines and not lines[-1]:
            lines.pop()
        return quote.group(1) + "\n".join(lines) if lines else None

    def decorators(self, node: ast.AST) -> list[str]:
        return [self.text(x.func if isinstance(x, ast.Call) else x) for x in node.decorator_list]

    def klass(self, node: ast.ClassDef, path: str, owner: str | None) -> None:
        found = self.found
        bases = [self.text(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        kinds = ["test"] if node.name.startswith("Test") or any(b.split(".")[-1] == "TestCase" for b in bases) else []
        kinds += [k for k in ("django_model", "pydantic_model", "enum") if any(b in BASES[k] for b in bases)]
        members = [x for x in node.body if isinstance(x, _DEFS)]
        before = [x for x in node.body if not members or x.lineno < members[0].lineno]
        signature = f"class {node.name}({', '.join(bases)})" if bases else f"class {node.name}"
        node_id = found.local_id(path, node.lineno)
        self.by_path.setdefault(path, node_id)
        code = self.text(node, before[-1]) if before else self.header(node) + ":"
        found.node("Class", node_id, node.name, node.lineno, node.end_lineno, code=code, signature=signature, docstring=self.docstring(node), stereotypes=kinds)
        found.edge(owner or found.file_id, node_id, "DECLARES" if owner else "CONTAINS")
        for x in node.body:
            if isinstance(x, ast.ClassDef):
                self.klass(x, f"{path}.{x.name}", node_id)
            elif isinstance(x, _DEFS):
                self.function(x, f"{path}.{x.name}", node_id, path)

    def function(self, node: ast.FunctionDef, path: str, owner: str | None, owner_path: str | None) -> None:
        found = self.found
        names = self.decorators(node)
        last = [x.split(".")[-1] for x in names]
        modifiers = first_of([MODIFIERS[x] for x in last if x in MODIFIERS]) + ["async"] * isinstance(node, ast.AsyncFunctionDef)
        kinds = ["test"] * node.name.startswith("test_")
        kinds += ["celery_task"] * any(x in TASKS or y in TASKS for x, y in zip(names, last)) + ["endpoint"] * any(x in ENDPOINTS for x in last)
        is_init = owner is not None and node.name == "__init__"
        node_id = found.local_id(path, node.lineno)
        self.by_path.setdefault(path, node_id)
        found.node(
            "Constructor" if is_init else "Method", node_id, node.name, node.lineno, node.end_lineno, code=self.text(node), signature=self.header(node),
            return_type=self.text(node.returns) if node.returns else None, docstring=self.docstring(node), modifiers=modifiers, stereotypes=kinds,
        )
        found.edge(owner or found.file_id, node_id, "HAS_CONSTRUCTOR" if is_init else "HAS_METHOD" if owner else "CONTAINS")
        if is_init:
            for x in _nodes_in(node):
                for target in x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, ast.AnnAssign) else []:
                    if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                        field = found.node("Field", found.local_id(f"{owner_path}.{target.attr}", x.lineno), target.attr, x.lineno, x.end_lineno)
                        found.edge(owner, field, "HAS_FIELD")
        calls = sorted((x for x in _nodes_in(node) if isinstance(x, ast.Call) and x.lineno >= node.body[0].lineno), key=lambda x: (x.lineno, x.col_offset))
        targets = []
        for x in calls:
            if isinstance(x.func, ast.Name):
                targets.append(x.func.id)
            elif isinstance(x.func, ast.Attribute):
                of = self.text(x.func.value)
                targets.append(f"{owner_path}.{x.func.attr}" if of == "self" and owner_path else f"{of}.{x.func.attr}")
        for name in first_of(targets):
            found.edge(node_id, name, "CALLS")


def extract(repository: str, path: str, text: str) -> Found:
    """A blank file has no entities; one with a syntax error has only the error."""
    found = Found(repository, path, "python")
    source = text.replace("\r\n", "\n").replace("\r", "\n")
    if not source.strip():
        return found
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as x:
        found.errors.append(f"syntax error: {x}")
        return found
    reader = _Reader(found, source)
    for x in tree.body:
        if isinstance(x, ast.ClassDef):
            reader.klass(x, x.name, None)
        elif isinstance(x, _DEFS):
            reader.function(x, x.name, None, None)
    # calls name local paths; those of this file become ids, the others stay names of the repository
    found.edges = [(s, reader.by_path.get(t, f"{repository}::{t}") if k == "CALLS" else t, k, p) for s, t, k, p in found.edges]
    return found
