"""Extractors by file suffix, and their distributed run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from codeloom.extract import csharp, java, python, script
from codeloom.extract.base import Found
from codeloom.schema import EDGE, NODE

Extractor = Callable[[str, str, str], Found]
_extractors: dict[str, Extractor] = {}


def register(suffix: str, extractor: Extractor) -> None:
    """Makes an extractor known for a suffix; the last one counts."""
    _extractors[suffix] = extractor


def extractor_for(path: str) -> Extractor | None:
    return _extractors.get("." + path.rpartition(".")[2]) if "." in path.rpartition("/")[2] else None


def supported() -> tuple[str, ...]:
    return tuple(_extractors)


for _suffixes, _extractor in ((".py", python.extract), (".java", java.extract), (".cs", csharp.extract), (".js .jsx .ts .tsx", script.extract)):
    for _suffix in _suffixes.split():
        register(_suffix, _extractor)

EXTRACTED = f"repository string, file_path string, errors array<string>, nodes array<struct<{NODE.replace(' ', ': ').replace(',:', ',')}>>, edges array<struct<{EDGE.replace(' ', ': ').replace(',:', ',')}>>"
_COLUMNS = [x.split()[0] for x in NODE.replace("map<string,string>", "map").split(", ")]


def extract_file(extractors: dict[str, Extractor], repository: str, path: str, content: bytes | None, content_hash: str | None) -> Found | None:
    """One file with its File node; None for suffixes without extractor."""
    extractor = extractors.get("." + path.rpartition(".")[2])
    if extractor is None:
        return None
    try:
        text = (content or b"").decode("utf-8-sig")
    except UnicodeDecodeError as x:
        found = Found(repository, path, "")
        found.errors.append(f"not UTF-8: {x.reason}")
        return found
    found = extractor(repository, path, text)
    if not found.errors:
        lines = text.count("\n") + 1
        found.nodes.insert(0, {"label": "File", "id": found.file_id, "name": path.rsplit("/", 1)[-1], "line_number": 1, "line_end": lines, "language": found.language, "content_hash": content_hash})
    return found


def extract(files: DataFrame) -> DataFrame:
    """(repository, file_path, errors, nodes, edges), a row for each file that has an extractor.

    A file with errors hands on no nodes and no edges. Null contents count as blank; rows without path are left out.
    """
    extractors = dict(_extractors)
    columns = list(_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(at, 256).to_pylist():
                    if r["file_path"] is None:
                        continue
                    found = extract_file(extractors, r["repository"] or "", r["file_path"], r["content"], r["content_hash"])
                    if found is None:
                        continue
                    bad = bool(found.errors)
                    nodes = [] if bad else [{c: x.get(c) for c in columns} | {"repository": r["repository"], "file_path": r["file_path"], "properties": list((x.get("properties") or {}).items()) or None} for x in found.nodes]
                    edges = [] if bad else [
                        {"source_id": s, "target_id": t, "rel_type": k, "properties": list(p.items()) if p else None, "file_path": r["file_path"], "ordinal": n} for n, (s, t, k, p) in enumerate(found.edges)
                    ]
                    rows.append({"repository": r["repository"], "file_path": r["file_path"], "errors": found.errors, "nodes": nodes, "edges": edges})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kind = StructType.fromDDL(EXTRACTED)
    return files.select("repository", "file_path", "content", "content_hash").mapInArrow(run, EXTRACTED)
