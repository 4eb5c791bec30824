"""Credentials embedded in source code (problem 3): where they begin, and the code with their values masked.

A dictionary of words with their counts is gathered from all code. Each literal is segmented into dictionary words by
Viterbi; the characters that no word explains are its residual. A literal with a long residual becomes a credential where
the name, key or header beside it says so, or where its own form does (issued token, URL or connection string
with a password, private key block). Formats of checksums and ids only count under an unmistakable name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the dictionary, and rows of code a word must occur in per million words of it (at least LEAST in all).
VOCABULARY, LEAST, PER_MILLION = 50_000, 5, 2.0
#: Characters that must stay unexplained in a value beside a telling name, in one that tells by its form, and in one that its
#: place alone marks as a password (of a URL, a connection string or a note about a login).
RESIDUAL, RESIDUAL_FORM, RESIDUAL_PLACE = 4, 8, 3

#: Words of names that hold credentials, alone or after one of QUALIFIERS.
SECRET = frozenset("password passwd pwd pass pw passphrase passcode secret secrets token credential credentials apikey auth authorization secretkey privatekey accesskey authkey psk pin".split())
KEYED = frozenset("api access private encryption signing auth secret client webhook license licence master service account deploy admin shared hmac session maps storage write read app crypto cipher s3 aws".split())
#: Words of names that hold something else, whatever stands beside them.
PLAIN = frozenset("public checksum digest etag sha sha1 sha256 sha512 md5 md5sum hash integrity fingerprint commit revision uuid guid tenant request trace correlation icon image".split())
#: Last words of names that name, describe or lead to a credential, and hold none.
NAMING = frozenset("name names field fields label labels url uri link page route endpoint path file filename dir type kind length size count header prefix suffix column table param parameter hint placeholder title text message error help policy rule pattern regex format provider store manager service class version ttl expiry expires lifetime timeout".split())
#: Placeholders.
PLACEHOLDER = re.compile(
    r"(?i)^(?:[*x.\-_?#]+|<[^>]*>|\[[^\]]*\]|\$\{.*\}?|\$\(.*|\{\{.*|%\(?\w+\)?s?%?|\$[A-Z_]+"
    r"|(?:your|my|replace|change|insert|enter|put|add|set)[-_ ]?(?:me|this|here|your|my|the|an?|in|with)?(?:[-_ ]?(?:api|key|token|password|passwd|secret|value|here|access|auth|client|id))*"
    r"|(?:dummy|example|sample|placeholder|redacted|hidden|masked|todo|fixme|tbd|none|null|nil|undefined|empty|changeme|default|test|testing|foobar|foo|bar|secret|password|token|key)(?:[-_ ]?(?:key|token|password|secret|value))?)$"
)
#: Forms of issued tokens, how they begin and go on.
ISSUED_FORMS = {
    "gh[pousr]_": "[A-Za-z0-9]{20,}", "github_pat_": r"\w{20,}", "glpat-": r"[\w-]{16,}", "xox[abeprs]-": r"[\w-]{10,}", "[srp]k_(?:live|test)_": r"\w{10,}",
    "AKIA": "[0-9A-Z]{16}", "AIza": r"[\w-]{30,}", r"SG\.": r"[\w-]{16,}\.[\w-]{16,}", "npm_": r"\w{20,}", "hf_": r"\w{20,}", "pypi-": r"\w{20,}",
    "dop_v1_": r"\w{20,}", "shpat_": r"\w{20,}", r"ya29\.": r"[\w-]{20,}", "sk-": r"[\w-]{20,}", "eyJ": r"[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}",
}
ISSUED = re.compile(r"\b(?:" + "|".join(begin + rest for begin, rest in ISSUED_FORMS.items()) + ")")
#: Words of headers, of parameters of URLs, and of notes about logins.
HEADERS = ("basic", "bearer", "token", "apikey")
PARAMS, SHORT_PARAMS = ("token", "secret", "password", "passwd", "signature", "apikey", "api_key", "access_key", "auth"), ("sig", "key", "pwd")
LOGINS = ("log-?in", "sign-?in", "credentials?", "creds?", "account", "access")
#: Ends of names that tell, however the name is parted.
ENDS = ("password", "apikey", "secretkey")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?=\s*$|\\n|\\r|[\"'`])")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_URL_LOGIN = re.compile(r"\b[a-zA-Z][\w+.\-]*://[^\s/:@\"'`]*:([^\s/@\"'`]+)@")
_URL_PARAM = re.compile(rf"(?i)[?&;](?:\w*(?:{'|'.join(PARAMS)})|{'|'.join(SHORT_PARAMS)})=([^\s&;\"'`#]+)")
_CONNECTION = re.compile(r"(?i)(?:^|[;\"'\s])(?:password|pwd)\s*=\s*([^;\"'`\s]+)(?=;|$|\s)")
_HEADER = re.compile(rf"(?i)^(?:{'|'.join(HEADERS)})\s+(\S+)$")
_FLAG = re.compile(r"(?i)--?(?:[\w-]*(?:password|passwd|pwd|pass|secret|token|api-?key|auth-?key|access-?key))[= ]([^\s\"'`]+)")
_PIECE = re.compile(r"\s*([+.]?)\s*(?:[rRbBuU$@]{0,2})(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|`((?:[^`\\]|\\.)*)`)")
_LITERAL = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|`((?:[^`\\]|\\.)*)`")
_NOTE = re.compile(r"(?i)\b((?:[a-z]+[_-])*(?:password|passwd|passphrase|pwd|pass|pw|secret|token|apikey|api[_ -]?key|access[_ -]?key|key|credentials?))\s*(?:[:=]|\bis\b)\s*([^\s\"'`,;<>(){}]+)")
_LOGIN_NOTE = re.compile(rf"(?i)\b(?:{'|'.join(LOGINS)})\b[^:\"'`]*:\s*[^\s/]+\s*/\s*(\S+)")
_COMMENT = re.compile(r"(?:^\s*(?:\*|\"\"\"|''')|//|/\*|(?:^|\s)#)(.*)$")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+\d*|[A-Z]+(?![a-z])\d*|\d+")
_CODE_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RUN = re.compile(r"[A-Za-z0-9]+")
_SIGNS = re.compile(r"[!#$%^&*@?~]")
_HASHES = re.compile(r"(?i)^(?:(?:md5|sha\d+)[:-])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|sha\d+-[A-Za-z0-9+/]+=*)$")
_PREFIXES = re.compile(r"(?i)^(?:data:|ssh-(?:rsa|ed25519|dss)\b|ecdsa-|-----)")
#: A call that fetches what its argument names.
_LOOKUP = re.compile(r"(?i)\b(?:read|get|fetch|load|look_?up|resolve|require)_?\w*\(\s*$|\benv\w*[.\[]?\w*[(\[]\s*$")


def _least(words: set[str]) -> list[bytes]:
    """Letters that a line must hold, one of these at least, to hold one of the words; without those that hold another."""
    bare = {w.replace("-?", "").replace("s?", "").replace("_", "") for w in words}
    return [w.encode() for w in sorted(bare) if not any(v != w and v in w for v in bare)]


_SHORT_WORDS = sorted(w for w in SECRET if len(w) <= 3)
_LEAST = _least({w for w in SECRET if len(w) > 3} | {"key", "pwd", "begin", *ENDS, *HEADERS, *PARAMS, *LOGINS})
_LEAST_SHORT = _least(set(_SHORT_WORDS))
#: A short word as a word of a name, or as the name itself, which may be parted.
_SHORT = re.compile(
    "|".join(
        rf"(?<![A-Za-z]){w}(?![a-z])|{w.title()}(?![a-z])|(?<![A-Z]){w.upper()}(?![a-z])|(?i:(?<![A-Za-z]){'[^A-Za-z0-9]*'.join(w)}(?![A-Za-z0-9]))"
        for w in _SHORT_WORDS
    )
)
_BEGINS = re.compile("|".join(ISSUED_FORMS))
_SHORT_PARAM = re.compile(rf"(?i)[?&;](?:{'|'.join(SHORT_PARAMS)})=")
_OTHERS = bytes(set(range(128)) - set(b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: Letters beyond ASCII that a pattern without regard to case takes for one of ASCII.
_ALIKE = str.maketrans("\u017f\u212a\u0130\u0131", "skii")


def may_hold(line: str) -> bool:
    """Whether any rule can find something in a line; made of the rules' own words. Names may be parted within a word."""
    if not line.isascii():
        line = line.translate(_ALIKE)
    letters = line.lower().encode("ascii", "ignore").translate(None, _OTHERS)
    if any(w in letters for w in _LEAST) or "://" in line or _BEGINS.search(line):
        return True
    return "=" in line and bool(_SHORT_PARAM.search(line)) or any(w in letters for w in _LEAST_SHORT) and bool(_SHORT.search(line))


class Words:
    """The dictionary, and the segmentation of a run of letters and digits by it."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=0)
        self.unknown = math.log(total) / 2 + 2  # a single unexplained character
        self.residual = lru_cache(200_000)(self._residual)

    def _residual(self, run: str) -> int:
        """Characters of the run that the best segmentation leaves unexplained."""
        if run.isdigit():
            return 0 if len(run) <= 6 else len(run)
        left = self._segment(run, 3)
        return left if left == 0 else self._segment(run, 4)  # chance hits of short words explain nothing

    def _segment(self, run: str, least: int) -> int:
        text, n = run.lower(), len(run)
        best, left = [0.0] + [math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            best[end], left[end] = best[end - 1] + self.unknown, left[end - 1] + 1
            for begin in range(max(0, end - self.longest), end - least + 1):
                c = self.cost.get(text[begin:end])
                if c is not None and best[begin] + c < best[end]:
                    best[end], left[end] = best[begin] + c, left[begin]
        return left[n]

    def unexplained(self, value: str) -> int:
        return sum(map(self.residual, _RUN.findall(value)))

    def left(self, value: str) -> int:
        """Characters of a value that no word explains: those of its runs, all digits, and the signs that passwords have."""
        return sum(len(x) if x.isdigit() else self.residual(x) for x in _RUN.findall(value)) + len(_SIGNS.findall(value))


def gather_words(records: DataFrame, text: str = "code") -> dict[str, int]:
    """The dictionary: words of all code that are neither rare nor short, at most VOCABULARY of the most frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                seen.update(_CODE_WORDS.findall(x))
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
                seen = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = records.filter(F.col(text).isNotNull()).select(text).mapInArrow(count, "word string, n long")
    words = counted.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")).filter(F.length("word") >= 3)
    total = words.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, round(total / 1e6 * PER_MILLION))
    return {r.word: r.n for r in words.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()}


def _names(text: str) -> list[str]:
    return [w.lower() for w in _NAME_WORDS.findall(text)]


def telling(name: str) -> bool:
    """Whether a name says that its value grants access."""
    words = _names(name)
    if set(words) & PLAIN or words and words[-1] in NAMING:
        return False
    joined = "".join(words)
    if set(words) & SECRET or joined in SECRET:
        return True
    return any(w == "key" and i and words[i - 1] in KEYED for i, w in enumerate(words)) or joined.endswith(("password", "apikey", "secretkey"))


def _near_name(left: str) -> str:
    """The name a literal is assigned to, its key, or the flag or argument before it."""
    m = re.search(r"([A-Za-z_][\w.\-]*)[\"'`]?\]?\s*(?::\s*[\w<>\[\]|. ]+)?(?:=>|:=|==?|:|,|\()\s*\(?\s*(?:\[|\{)?\s*$", left)
    return m.group(1) if m else ""


class Finder:
    """Finds the values of credentials in one text."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.words = Words(counts)

    def _real(self, value: str, least: int) -> bool:
        """A value that is no placeholder and not made of words alone."""
        if len(value) < 4 or PLACEHOLDER.match(value):
            return False
        return self.words.unexplained(value) >= least

    def _password(self, value: str) -> bool:
        """A value beside a telling name of which enough stays unexplained."""
        if len(value) < 5 or " " in value or PLACEHOLDER.match(value) or _PREFIXES.match(value):
            return False
        if re.search(r"[(){}]|^https?://|^[\w.]+\.[a-z]+\($|->|::", value):
            return False
        return self.words.left(value) >= RESIDUAL

    def in_line(self, line: str, following: list[str] | None = None) -> list[tuple[int, int]]:
        """Begin and end of each credential's value in a line. The opening of a key block counts if its body, here and in the following
        lines, stays unexplained; without lines that follow, for the opening itself.
        """
        if not may_hold(line):
            return []
        block = self.block_in(line, following)
        out: list[tuple[int, int]] = [block] if block else []
        out += [m.span() for m in ISSUED.finditer(line) if self.words.unexplained(m.group()) >= RESIDUAL_FORM]
        out += [m.span(1) for m in _URL_LOGIN.finditer(line) if self._url_password(m.group(1))]
        out += [m.span(1) for m in _URL_PARAM.finditer(line) if self._real(m.group(1), RESIDUAL_FORM)]
        out += [m.span(1) for m in _FLAG.finditer(line) if self._password(m.group(1))]
        quoted = []
        for m in _LITERAL.finditer(line):
            k = m.lastindex or 1
            value, (a, b) = m.group(k), m.span(k)
            quoted.append((a, b))
            if len(value) < 5:
                continue
            if (c := _CONNECTION.search(value)) and ("=" in value[: c.start()] or ";" in value) and self._connection(c.group(1)):
                out.append((a + c.start(1), a + c.end(1)))
            elif (h := _HEADER.match(value)) and self._real(h.group(1), RESIDUAL_FORM):
                out.append((a + h.start(1), a + h.end(1)))
            elif self._named(line, m.start(), value):
                out.append((a, b))
        if note := _COMMENT.search(line):
            for pattern, g in ((_NOTE, 2), (_LOGIN_NOTE, 1)):
                for m in pattern.finditer(line, note.start(1)):
                    a, b = m.span(g)
                    value = line[a:b].rstrip(".")
                    if not any(x <= a < y for x, y in quoted) and self._noted(value):
                        out.append((a, a + len(value)))
        return sorted(set(out))

    def _url_password(self, value: str) -> bool:
        return len(value) >= 3 and not PLACEHOLDER.match(value) and not re.search(r"[${}<>]", value) and self.words.left(value) >= RESIDUAL_PLACE

    def _connection(self, value: str) -> bool:
        return len(value) >= 4 and not PLACEHOLDER.match(value) and not re.search(r"[{}<>]|^\$", value) and self.words.left(value) >= RESIDUAL_PLACE

    def _noted(self, value: str) -> bool:
        if len(value) < 6 or PLACEHOLDER.match(value) or _HASHES.match(value) or re.search(r"[${}<>()\[\]]", value):
            return False
        return bool(re.search(r"[A-Za-z]", value)) and self.words.left(value) >= (RESIDUAL_PLACE if re.search(r"\d", value) else RESIDUAL + 2)

    def _named(self, line: str, at: int, value: str) -> bool:
        left = line[:at]
        if _LOOKUP.search(left):
            return False
        near = _near_name(left)
        if telling(near):
            if set(_names(near)) == {"token"} and self.words.unexplained(value) < RESIDUAL:
                return False
            return self._password(value)
        if set(_names(near)) & PLAIN or _HASHES.match(value) or _PREFIXES.match(value):
            return False
        # further left: another argument, a fallback of an environment variable, a header's name
        return telling(left[-80:]) and not re.search(r"\s|://", value) and len(value) >= 12 and self.words.unexplained(value) >= max(RESIDUAL_FORM, len(value) // 2)

    def block_in(self, line: str, following: list[str] | None) -> tuple[int, int] | None:
        block = _KEY_BLOCK.search(line) if "-----BEGIN" in line else None
        if block and following is not None:
            body = " ".join([line[block.end() :], *following[:3]]).split("-----END")[0]
            if sum(map(self.words.unexplained, _KEY_BODY.findall(body))) < RESIDUAL_FORM:
                return None
        return block.span() if block else None

    def find(self, code: str) -> list[tuple[int, int, int]]:
        """(line from 1, begin, end) of each credential; a block or a value in pieces is known by its first line."""
        lines = code.split("\n")
        return [(n, a, b) for n, line in enumerate(lines, 1) for a, b in self.in_line(line, lines[n : n + 3])]

    def mask(self, code: str) -> str:
        """The code with each value replaced by asterisks of the same length; key blocks lose their body.

        The pieces of a value go with it where they are joined to it: by a sign of joining at the end of a line or at the
        beginning of the next, or by standing alone one below the other within an open bracket.
        """
        lines, out, inside, joined = code.split("\n"), [], False, False
        for n, line in enumerate(lines):
            block = self.block_in(line, lines[n + 1 : n + 4])
            spans = [x for x in self.in_line(line, lines[n + 1 : n + 4]) if x != block]
            begin = block[1] if block else 0
            body_end = line.find("-----END", begin) if inside or block else -1
            hidden = list(spans)
            if inside or block:
                hidden += [m.span() for m in _KEY_BODY.finditer(line, begin, body_end if body_end >= 0 else len(line))]
            last = max((b for _, b in spans), default=None)
            if joined and (m := _PIECE.match(line)) and (m.group(1) or joined == "open" or joined == "sign"):
                a, b = m.span(m.lastindex or 2)
                hidden.append((a, b))
                last = max(b, last or 0)
            masked = list(line)
            for a, b in hidden:
                masked[a:b] = "*" * (b - a)
            out.append("".join(masked))
            if inside or block:
                inside, joined = body_end < 0, False
            elif last is None:
                joined = False
            else:
                rest = line[last + 1 :].strip()
                bracket = joined == "open" or line[:last].count("(") > line[:last].count(")")
                joined = "sign" if rest in ("+", ".", "\\", "..") else ("open" if bracket else "value") if not rest else False
        return "\n".join(out)


def find_credentials(records: DataFrame, key: str = "id", text: str = "code") -> DataFrame:
    """(id, line_no): each line of each record's text on which a credential begins, once.

    Null texts give no row, and rows with a null key are left out; repeated rows count once; an empty table gives an empty result.
    """
    counts = gather_words(records, text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(counts)
        for batch in batches:
            rows = [(k, n) for k, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n in {n for n, _, _ in finder.find(code)}]
            yield pa.RecordBatch.from_pydict({"id": pa.array([k for k, _ in rows], pa.string()), "line_no": pa.array([n for _, n in rows], pa.int64())})

    usable = records.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string"), text)
    return usable.mapInArrow(find, "id string, line_no long").distinct()


def redact(records: DataFrame, key: str = "id", text: str = "code") -> DataFrame:
    """(id, n_masked, code): every record whose text holds credentials, with only their values masked."""
    counts = gather_words(records, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(counts)
        for batch in batches:
            rows = []
            for k, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := finder.find(code):
                    rows.append((k, len(found), finder.mask(code)))
            ids, n, code = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "n_masked": pa.array(n, pa.int64()), "code": pa.array(code, pa.string())})

    usable = records.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string"), text)
    return usable.mapInArrow(run, "id string, n_masked long, code string").distinct()
