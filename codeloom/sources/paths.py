"""Predicates and names over paths and sources, as columns."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = (".py", ".java", ".js", ".jsx", ".ts", ".tsx", ".cs")
#: Paths that are left out unless asked for.
DEFAULT_EXCLUSIONS = ("node_modules", "venv", "__pycache__", "build", "dist", "target", ".git", "**/generated-sources/**", "**/migrations/**", ".venv", "*.min.js", "*.min.css")


def suffix(path: Column) -> Column:
    """The last extension of the file name with its point, or "" for none; a leading point begins no extension."""
    return F.regexp_extract(path, r"(?:^|/)[^/]+(\.[^./]+)$", 1)


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*EXTENSIONS)


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over the whole path; * and ? also match /."""
    out = []
    for c in pattern:
        out.append(".*" if c == "*" else "." if c == "?" else "\\" + c if c in ".+()^$|{}[]\\" else c)
    return "^" + "".join(out) + "$"


def is_excluded(path: Column, patterns: tuple[str, ...] = DEFAULT_EXCLUSIONS) -> Column:
    """Whether a relative path matches a glob as a whole, or has a literal pattern among its parts. Null paths give null."""
    literals = [p for p in dict.fromkeys(patterns) if "*" not in p]
    globs = [p for p in dict.fromkeys(patterns) if "*" in p]
    hit = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, literals))) if literals else F.lit(False)
    return hit | path.rlike("|".join(map(glob_regex, globs))) if globs else hit


def matches(path: str, pattern: str) -> bool:
    """The same for one path, for listings on the driver."""
    return fnmatch.fnmatchcase(path, pattern) if "*" in pattern else pattern in path.split("/")


def is_hosted(source: Column) -> Column:
    return source.startswith("https://github.com/") | source.startswith("git@github.com:")


def repository_name(source: Column) -> Column:
    """`owner/name` of a hosted source, else the last part of the path."""
    hosted = F.regexp_replace(F.regexp_replace(source, r"^(https://github\.com/|git@github\.com:)", ""), r"/+$", "")
    local = F.element_at(F.split(F.regexp_replace(source, r"/+$", ""), "/"), -1)
    return F.when(is_hosted(source), F.regexp_replace(hosted, r"\.git$", "")).otherwise(local)


def relative_path(path: Column, root: Column) -> Column:
    """The path below a root; paths outside stay."""
    base = F.concat(F.regexp_replace(root, r"/+$", ""), F.lit("/"))
    return F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)
