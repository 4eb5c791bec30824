"""Generated, minified, vendored and data files among source files (problem 4).

Each file is judged by statistics of its layout against thresholds of its language: longest and mean line, share of white
space, letters and digits, numeric literals, long encoded runs and how many lines repeat one pattern. Two things that no layout
can show come beside these: the notice of a generator before the first line of code, where the file is laid out as if by
hand; and copies of libraries, found over the whole table as files of several repositories whose code is the same
once comments, blank lines and indentation are taken away.

The thresholds lie between the values of the files of sf0.1 that are laid out by hand and of those that are not: at their
geometric mean where a language has both, else a quarter beyond the former; shares of one pattern are kept above
what a table of 30 rows makes in a file with two functions.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import durable


class Limits(NamedTuple):
    """What a hand-written file of a language stays within."""

    longest: int  # characters of the longest line
    mean: int  # of the mean line
    space: float  # least share of white space where lines are long
    digits: float  # share of digits where one pattern makes most lines
    pattern: float  # share of lines of one pattern
    encoded: float  # share of characters in encoded runs
    numbers: float  # share of digits that alone makes a data file


LIMITS = {
    ".py": Limits(260, 90, 0.098, 0.096, 0.75, 0.60, 0.35),
    ".java": Limits(258, 79, 0.110, 0.085, 0.74, 0.60, 0.35),
    ".cs": Limits(246, 63, 0.112, 0.071, 0.72, 0.60, 0.35),
    ".js": Limits(275, 81, 0.067, 0.108, 0.75, 0.60, 0.35),
    ".jsx": Limits(250, 62, 0.120, 0.085, 0.75, 0.60, 0.35),
    ".ts": Limits(330, 93, 0.067, 0.089, 0.75, 0.60, 0.35),
    ".tsx": Limits(250, 65, 0.109, 0.085, 0.75, 0.60, 0.35),
}
OTHER = Limits(275, 90, 0.10, 0.096, 0.75, 0.60, 0.35)
#: Lines from which a pattern counts.
FEW = 12
#: Characters of code from which an equal file elsewhere is a copy. Shorter ones (one import, an empty class) are equal by chance.
COPY = 100

#: Notices of generators, in the forms that public tools write.
NOTICE = re.compile(
    r"(?i)^\W*(?:code generated by .*do not edit|<auto-?generated|auto-?generated file|@?generated\b\W*(?:\(|by [\w.-]+ from\b)"
    r"|this (?:file|code) (?:was|is) (?:automatically |auto-?)generated|this (?:file|code) (?:was|is) generated (?:from|by|with|using) (?!hand\b|me\b|us\b|the caller)"
    r"|generated by .*(?:do not edit|do not modify)|(?:auto-?)?generated\b.*do not (?:edit|modify)|do not edit\b.*\bgenerated\b"
    r"|machine (?:written|generated)|produced by the .*(?:compiler|generator|edit the source)"
    r"|automatisch erzeugt|automatisch generiert|fichier (?:produit|g[ée]n[ée]r[ée])|generado autom|archivo generado"
    r"|gerado autom|arquivo gerado|ficheiro gerado|automatisch gegenereerd)"
)
#: Lines that may stand before the first line of code.
_BEFORE = re.compile(r"\s*(?:$|//|#|/\*|\*|<!--|--|@|\[|package\b|import\b|using\b|from\s+\S+\s+import\b|['\"]use strict|['\"]{3})")
_COMMENT = re.compile(r"\s*(?://|#|/\*|\*|<!--|--|@generated\b|@Generated\b|\[(?:System\.CodeDom\.Compiler\.)?GeneratedCode)")
_STRING = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'")
_WORD = re.compile(r"[^\W\d]\w*")
_NUMBERS = re.compile(r"-?(?:0x[0-9a-fA-F]+|\d[\d._]*)")
_LIST = re.compile(r"(?:[0S],?\s*){2,}")
_RUN = re.compile(r"[A-Za-z0-9+/=_\\-]{60,}")
_LINES = re.compile(r"\r\n|\r|\n")
_BLOCK = re.compile(r"/\*.*?\*/", re.S)


def pattern(line: str) -> str:
    """A line with its literals, words and lists of literals reduced to one sign each."""
    return _LIST.sub("0", _NUMBERS.sub("0", _WORD.sub("w", _STRING.sub("S", line.strip())))).replace("w(w=0", "w(")


def code_only(text: str, suffix: str) -> str:
    """The text without comments that fill lines, blank lines and indentation."""
    body = text if suffix == ".py" else _BLOCK.sub("", text)
    mark = "#" if suffix == ".py" else "//"
    return "\n".join(x for line in _LINES.split(body) if (x := line.strip()) and not x.startswith(mark))


def notice(lines: list[str]) -> bool:
    """Whether a generator's notice stands before the first line of code: in comments, or as an annotation of the first type."""
    block = ""
    for line in lines:
        text = line.strip()
        if block:
            block = "" if block in text else block
        elif not _BEFORE.match(line):
            return False
        else:
            opens = next((x for x in ("/*", '"""', "'''") if text.startswith(x)), None)
            ends = {"/*": "*/"}.get(opens, opens)
            block = ends if opens and ends not in text[len(opens) :] else ""
            if not _COMMENT.match(line) and not opens:
                continue
        if NOTICE.search(line):
            return True
    return False


def by_layout(text: str, lines: list[str], limits: Limits) -> str | None:
    """`generated`, `minified` or `data` by the statistics of the layout alone, or None."""
    size = len(text)
    longest, mean = max(map(len, lines)), sum(map(len, lines)) / len(lines)
    encoded = sum(len(x) for line in lines if len(line) >= 60 for x in _RUN.findall(line))
    digits = sum(map(text.count, "0123456789")) / size
    if encoded > limits.encoded * size or digits > limits.numbers:
        return "data"
    space = sum(map(text.count, " \n\t\r")) / size
    if longest > limits.longest and (mean > limits.mean or space < limits.space):
        return "minified"
    if digits > limits.digits and len(lines) >= FEW:
        most = Counter(map(pattern, lines)).most_common(1)[0][1]
        if most > limits.pattern * len(lines):
            return "data" if sum(map(str.isalnum, text)) < 0.45 * size else "generated"
    return None


def judge(text: str, suffix: str) -> str | None:
    """`generated`, `minified` or `data` by the text alone, or None. A notice only names the kind where the layout has told already."""
    lines = [x for x in _LINES.split(text) if x.strip()]
    if not lines:
        return None
    kind = by_layout(text, lines, LIMITS.get(suffix, OTHER))
    return "generated" if kind != "minified" and notice(lines) else kind


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        repository, path, suffix, content = (batch.column(i).to_pylist() for i in range(4))
        kinds, bodies = [], []
        for name, end, data in zip(path, suffix, content):
            text = (data or b"").decode("utf-8-sig", "replace")
            end = end if end else "." + (name or "").rpartition(".")[2]
            kinds.append(judge(text, end))
            body = code_only(text, end)
            bodies.append(hashlib.md5(body.encode("utf-8", "replace")).hexdigest() if len(body) > COPY else None)
        yield pa.RecordBatch.from_pydict(
            {"repository": pa.array(repository, pa.string()), "file_path": pa.array(path, pa.string()), "kind": pa.array(kinds, pa.string()), "body": pa.array(bodies, pa.string())}
        )


def foreign_files(files: DataFrame) -> DataFrame:
    """(repository, file_path, kind): files nobody wrote by hand in their repository; a file may be of several kinds.

    Null or blank contents give no row; files delivered twice count once; a null suffix is taken from the path. A copy is a file of
    which the same code is present in another repository, whatever its path and its banner.
    """
    judged = durable(
        files.select("repository", "file_path", "suffix", "content").mapInArrow(_judge, "repository string, file_path string, kind string, body string")
    )  # read three times below, and small beside the contents
    named = judged.filter(F.col("kind").isNotNull()).select("repository", "file_path", "kind")
    bodies = judged.filter(F.col("body").isNotNull()).select("repository", "file_path", "body").distinct()
    spread = bodies.groupBy("body").agg(F.min("repository").alias("a"), F.max("repository").alias("b")).filter("a < b")
    copies = bodies.join(spread, "body", "left_semi").select("repository", "file_path", F.lit("vendored").alias("kind"))
    return named.unionByName(copies).distinct()
