"""Functions paired with their documentation (problem 6).

A function's description is its recorded docstring or, where that is null, the documentation that its own code holds: for
Python the docstring of the function node of its abstract syntax tree, for the other languages the documentation comment
before the declaration. Marks and tags without text are taken away; what is then empty, a placeholder, a reminder or only the
function's name again is no description.

`documented_sources` reads the functions from the source files themselves: Python by its syntax tree, the other languages by their
declarations, which are found by matching brackets; each with the range of characters that it takes in its file.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.extract import registry

#: Labels of nodes that are functions.
FUNCTIONS = ("Method", "Constructor")

#: Whole texts that stand for a missing description.
PLACEHOLDERS = frozenset(
    {
        "n a", "na", "none", "nil", "null", "empty", "undocumented", "not documented", "no documentation", "no docs", "documentation", "docs", "description",
        "method description", "function description", "class description", "constructor description", "add description", "add docs", "add documentation",
        "description here", "auto generated method stub", "auto generated constructor stub", "auto generated", "autogenerated", "generated", "method stub",
        "stub", "to be documented", "to be done", "to do", "tbd", "tba", "todo", "fixme", "xxx", "document this", "document me", "missing docs",
        "missing documentation", "see above", "see below", "placeholder", "inheritdoc", "inherited", "wip", "work in progress", "summary", "javadoc", "docstring",
    }
)
_REMINDER = re.compile(r"(?im)^\W*(?:todo|fixme|xxx|hack|tbd|tba)\b.*$")
_FILLER = frozenset("a an the this that of to for and in is it its s method function constructor ctor procedure routine".split())
_MARKS = re.compile(r"(?m)^[ \t]*(?:/\*\*+|/\*!|\*+/|\*(?!\*)|///+|//!|//|#+!?)?[ \t]?|[ \t]*\*+/[ \t]*$")
_INHERIT = re.compile(r"(?i)\{@inheritDoc\}|<inheritdoc[^>]*/?>(?:\s*</inheritdoc>)?|@inheritdoc\b")
_SEE = re.compile(r"(?im)^\W*(?:@see|see also:?|:see:|\\see)\b.*$|<see(?:also)?\b[^>]*/>|\{@link[^}]*\}")
_PARAM = re.compile(r"(?im)^([ \t]*)(?:@|:|\\)(?:param|arg|argument|throws|exception|raises?|type|property|typeparam|template|tparam)\b(?:[ \t]+\{[^}]*\})?(?:[ \t]+[\w.$\[\]*]+)?[ \t]*:?")
_RETURN = re.compile(r"(?im)^([ \t]*)(?:@|:|\\)(?:returns?|rtype|yields?|since|author|version|deprecated|override|public|private|static|async|constructor|class|memberof|name|function|method)\b[ \t]*:?")
_XML = re.compile(r"</?\w+[^<>]*/?>")
_HEADER = re.compile(r"(?im)^[ \t]*(?:args|arguments|parameters|params|returns?|yields|raises|throws|examples?|notes?|attributes)[ \t]*:?[ \t]*$")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def clean(doc: str) -> str:
    """The text of a documentation without comment marks, and without tags that carry no text."""
    text = doc.strip()
    text = re.sub(r"^(?:[rRuUbB]{0,2})(?:\"\"\"|''')|(?:\"\"\"|''')$", "", text)
    text = _MARKS.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    text = text.replace("*/", " ")
    text = _SEE.sub("", _INHERIT.sub("", text))
    text = _RETURN.sub(r"\1", _PARAM.sub(r"\1", text))
    text = _HEADER.sub("", _XML.sub(" ", text))
    return "\n".join(x.rstrip() for x in text.split("\n")).strip()


def _stem(word: str) -> str:
    for end in ("ies", "ing", "ed", "es", "s", "e", "y"):
        if word.endswith(end) and len(word) - len(end) >= 2:
            return word[: -len(end)]
    return word


def name_words(name: str) -> set[str]:
    return {_stem(w.lower()) for part in _WORD.findall(name or "") for w in _CAMEL.split(part)} | {w.lower() for part in _WORD.findall(name or "") for w in _CAMEL.split(part)}


def informative(doc: str | None, name: str | None) -> bool:
    """Whether a documentation says more than the function's name does."""
    if not doc:
        return False
    text = _REMINDER.sub("", clean(doc))
    words = [w.lower() for w in _WORD.findall(text)]
    if not words or " ".join(words) in PLACEHOLDERS:
        return False
    own = name_words(name or "")
    split = [w.lower() for part in _WORD.findall(text) for w in _CAMEL.split(part) if w]
    return any(len(w) > 1 and w not in _FILLER and w not in own and _stem(w) not in own for w in split)


def python_docstring(code: str) -> str | None:
    """The docstring of the first function of a piece of Python, by its syntax tree."""
    first = re.search(r"(?m)^([ \t]+)(?:async[ \t]+def|def)\b", code)
    for source in (code, f"if 1:\n{first.group(1) if first else '    '}{code}"):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                return ast.get_docstring(node, clean=False)
        return None
    m = re.match(r"(?s)(?:@[^\n]*\n\s*)*(?:async\s+)?def\s+\w+\s*\(.*?\)[^:\n]*:\s*(?:#[^\n]*\n\s*)*(\"\"\"(?:.*?)\"\"\"|'''(?:.*?)''')", code)
    return m.group(1) if m else None


def comment_before(code: str) -> str | None:
    """The documentation comment that stands before a declaration, other comments and annotations aside."""
    at, n, found = 0, len(code), None
    while at < n:
        if code[at].isspace():
            at += 1
        elif code.startswith("/*", at):
            end = code.find("*/", at + 2)
            end = n if end < 0 else end + 2
            found = code[at:end] if code.startswith("/**", at) and not code.startswith("/**/", at) else found
            at = end
        elif code.startswith("//", at):
            end = code.find("\n", at)
            end = n if end < 0 else end
            if code.startswith("///", at):
                found = (found + "\n" if found and found.startswith("///") else "") + code[at:end]
            at = end
        elif code[at] == "@" or code[at] == "[":
            m = re.compile(r"@[\w.]+\s*(\()?|\[").match(code, at)
            at, depth = m.end(), 1 if m.group().endswith(("(", "[")) else 0
            while at < n and depth:
                text = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'").match(code, at)
                depth += 0 if text else (code[at] in "([") - (code[at] in ")]")
                at = text.end() if text else at + 1
        else:
            break
    return found


def documentation(docstring: str | None, code: str, language: str | None) -> str | None:
    if docstring is not None:
        return docstring
    return python_docstring(code) if language == "python" else comment_before(code)


def documented_functions(nodes: DataFrame) -> DataFrame:
    """(id, language, signature, code, description): one row for each documented function.

    Nodes without id or code, and other labels, give no row; a node with several rows counts once; an empty table gives an
    empty result. A null name is taken from the id, a null language is read as one with comments before declarations.
    """
    columns = ["id", "name", "language", "signature", "docstring", "code"]
    usable = nodes.filter(F.col("label").isin(*FUNCTIONS) & F.col("id").isNotNull() & F.col("code").isNotNull()).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for i, (key, name, language, docstring, code) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5)))):
                doc = documentation(docstring, code, language)
                if informative(doc, name or re.split(r"[.#:]", key.split("(")[0])[-1]):
                    keep.append(i)
                    texts.append(clean(doc))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), rows.column(5), pa.array(texts, pa.string())], names=["id", "language", "signature", "code", "description"])

    return usable.mapInArrow(run, "id string, language string, signature string, code string, description string")


_SOURCES = "repository string, file_path string, id string, language string, begin_char long, end_char long, line_number int, line_end int, signature string, code string, description string"


def _range(text: str, starts: list[int], code: str, line: int) -> tuple[int | None, int | None]:
    """Where a function's code, which begins in a line, stands in its file."""
    at = text.find(code, starts[min(line, len(starts)) - 1])
    return (at, at + len(code)) if at >= 0 else (None, None)


def documented_sources(files: DataFrame) -> DataFrame:
    """(repository, file_path, id, language, begin_char, end_char, line_number, line_end, signature, code, description): the documented functions of source files.

    Characters count from 0, without a byte order mark and with line ends as \\n, so that the slice from begin_char to end_char is `code`. Files that do
    not parse, null and blank contents and other suffixes give no row; files delivered twice count once; functions of equal id in
    one file each have a row; an empty table gives an empty result.
    """
    extractors = {suffix: registry.extractor_for("x" + suffix) for suffix in registry.supported()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SOURCES.split(", ")]
        for batch in batches:
            rows = []
            for repository, path, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = registry.extract_file(extractors, repository or "", path, content, None) if path and content else None
                if found is None or found.errors:
                    continue
                text = content.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")
                starts = [0] + [m.end() for m in re.finditer("\n", text)]
                for x in found.nodes:
                    if x["label"] not in FUNCTIONS or not x.get("code"):
                        continue
                    doc = documentation(x.get("docstring"), x["code"], x["language"])
                    if informative(doc, x["name"]):
                        begin, end = _range(text, starts, x["code"], x["line_number"])
                        rows.append((repository, path, x["id"], x["language"], begin, end, x["line_number"], x["line_end"], x.get("signature"), x["code"], clean(doc)))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [pa.int64() if n.endswith("char") else pa.int32() if n.startswith("line_") else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    found = files.select("repository", "file_path", "content").mapInArrow(run, _SOURCES)
    return found.dropDuplicates(["repository", "file_path", "id", "begin_char"])
