"""What an extractor hands back, and the ids it gives."""

from __future__ import annotations


class Found:
    """Nodes and edges of one file, in the order in which they were met."""

    def __init__(self, repository: str, path: str, language: str) -> None:
        self.repository, self.path, self.language = repository, path, language
        self.nodes: list[dict] = []
        self.edges: list[tuple[str, str, str, dict | None]] = []
        self.errors: list[str] = []
        self.taken: set[str] = set()

    @property
    def file_id(self) -> str:
        return f"{self.repository}::{self.path}"

    def local_id(self, path: str, line: int) -> str:
        """The id of a local path: the first taker keeps it, later ones get @L and their line, then _2, _3 ..."""
        name, k = path, 1
        while name in self.taken:
            name = f"{path}@L{line}" + (f"_{k}" if k > 1 else "")
            k += 1
        self.taken.add(name)
        return f"{self.file_id}#{name}"

    def node(self, label: str, node_id: str, name: str, line: int, end: int | None, **more) -> str:
        row = {"label": label, "id": node_id, "name": name, "line_number": line, "line_end": end, "language": self.language}
        self.nodes.append(row | {k: v for k, v in more.items() if v not in (None, [], {})})
        return node_id

    def edge(self, source: str, target: str, kind: str, properties: dict | None = None) -> None:
        self.edges.append((source, target, kind, properties))


def first_of(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))
