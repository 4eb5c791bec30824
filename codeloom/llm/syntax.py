"""Source files that do not parse (problem 5).

A file is cut into tokens of its language, and every bracketed part, from the inside out, is recognised by a generalised LL parser with
a graph-structured stack (module gll): all nonterminals that may stand in such a bracket, and all dialects of the language, run
together on it. To what encloses it the part is then one terminal, known by the nonterminals that accepted it. Lists of statements are
taken piece by piece. Code repeats its shapes, so each worker remembers what it has recognised; the memory is bounded and only
saves time. A file that no dialect of its language accepts is flagged.
"""

from __future__ import annotations

import re
import sys
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import grammars
from codeloom.llm.gll import Grammar

#: Shapes that a worker remembers for each language.
REMEMBER = 100_000
#: Language and whether it has JSX, by suffix.
SUFFIXES = {".py": ("python", False), ".java": ("java", False), ".cs": ("csharp", False), ".js": ("javascript", True), ".jsx": ("javascript", True), ".mjs": ("javascript", True), ".ts": ("typescript", False), ".tsx": ("typescript", True)}
_CLOSER = {"(": ")", "[": "]", "{": "}"}


class Invalid(Exception):
    """The source is not valid."""


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


class Shapes:
    """A grammar with what has been recognised by it so far."""

    def __init__(self, grammar: str, lists: tuple[str, ...], tops: tuple[str, ...]) -> None:
        self.grammar = Grammar(grammar)
        if "JsxExpr" in self.grammar.rules:
            self.grammar.groups["{"].add("JsxExpr")
        self.starts = {b: tuple(sorted(names)) for b, names in self.grammar.groups.items()} | {"": tops}
        self.lists = frozenset(lists)
        self.match: dict[str, frozenset[str]] = {}
        self.known: dict[tuple[str, tuple[str, ...]], frozenset[str]] = {}
        self.groups: dict[tuple[str, frozenset[str]], str] = {}

    def token(self, bracket: str, accepted: frozenset[str]) -> str:
        """The terminal that a recognised bracket becomes."""
        key = (bracket, accepted)
        name = self.groups.get(key)
        if name is None:
            name = self.groups[key] = f"{bracket}{len(self.groups)}"
            self.match[name] = frozenset(f"{bracket}:{x}:{_CLOSER[bracket]}" for x in accepted)
        return name

    def kinds(self, tokens: tuple[str, ...]) -> list[frozenset[str]]:
        match = self.match
        out = []
        for t in tokens:
            m = match.get(t)
            if m is None:
                m = match[t] = frozenset((t,))
            out.append(m)
        return out

    def recognise(self, tokens: tuple[str, ...], starts: tuple[str, ...], bracket: str) -> frozenset[str]:
        key = (bracket, tokens)
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            got = self.known[key] = self.grammar.accepts(self.kinds(tokens), starts) if starts else frozenset()
        return got

    def shortened(self, tokens: tuple[str, ...], starts: tuple[str, ...], bracket: str) -> frozenset[str]:
        """The same by the shorter form of a long list, which only saves time: where that is not accepted, the whole list decides."""
        short = _short(tokens)
        return self.recognise(short, starts, bracket) or (self.recognise(tokens, starts, bracket) if len(short) < len(tokens) else frozenset())

    def accepted(self, bracket: str, tokens: tuple[str, ...], cut) -> frozenset[str]:
        """The nonterminals of this bracket that derive its content; `cut` parts lists of statements."""
        starts = self.starts[bracket]
        if bracket == "(" or bracket == "[":
            return self.shortened(tokens, starts, bracket)
        pieces = cut(tokens)
        if len(pieces) <= 1:
            return self.shortened(tokens, starts, bracket)
        lists = tuple(s for s in starts if s in self.lists)
        left = frozenset(lists)
        for piece in pieces:
            left &= self.shortened(piece, lists, bracket + ";")
            if not left:
                break
        others = tuple(s for s in starts if s not in self.lists)
        if others:
            left |= self.shortened(tokens, others, bracket + "!")
        return left


def _short(tokens: tuple[str, ...]) -> tuple[str, ...]:
    """A long list has the form of the list without items that repeat earlier ones; its first and last items stay.

    Items are what commas part; those that hold a part of a lambda's parameters are no whole elements and stay. Where angle
    brackets may hold commas, only an item equal to the two before it is left out.
    """
    if len(tokens) < 40 or "," not in tokens:
        return tokens
    items: list[list[str]] = [[]]
    for t in tokens:
        items[-1].append(t)
        if t == ",":
            items.append([])
    angles = "<" in tokens or ">" in tokens
    out: list[str] = []
    seen: dict[tuple[str, ...], int] = {}
    lambdas = "lambda" in tokens
    waiting = 0  # lambdas without their colon
    for i, item in enumerate(items):
        inner = 2 < i < len(items) - 2
        if lambdas:
            inner = inner and not waiting
            for t in item:
                if t == "lambda":
                    waiting += 1
                elif t == ":" and waiting:
                    waiting -= 1
            inner = inner and not waiting
        key = tuple(item)
        seen[key] = seen.get(key, 0) + 1
        if inner and (item == items[i - 1] == items[i - 2] if angles else seen[key] > 3):
            continue
        out += item
    return tuple(out)


# --- languages with braces -----------------------------------------------------------------------------------------

_TRIVIA = r"((?:[ \t\f\v\u00a0\ufeff\r\n\u2028\u2029]+|//[^\r\n]*|/\*(?s:.*?)\*/)*)"
_NAME = r"(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})(?:\w|\$|\\u[0-9a-fA-F]{4})*"
#: In C# the dollar sign begins a literal.
_PLAIN_NAME = r"(?:[^\W\d]|_|\\u[0-9a-fA-F]{4})(?:\w|\\u[0-9a-fA-F]{4})*"
_DIGITS = r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
_STRING = r"\"(?:[^\"\\\r\n]|\\(?:\r\n|(?s:.)))*\""
_PLAIN_STRING = r"\"(?:[^\"\\\r\n]|\\.)*\""


class Language:
    """Tokens of one language with braces."""

    def __init__(self, grammar: str, lists: tuple[str, ...], tops: tuple[str, ...], literals: str, signs: str, keywords: str, contextual: str, classes: dict[str, str], starters: str, ecma: bool = False) -> None:
        self.shapes = Shapes(grammar, lists, tops)
        name = _NAME if "$" not in literals else _PLAIN_NAME
        self.pattern = re.compile(_TRIVIA + rf"(?:({name})|({literals})|({signs}))")
        self.trivia = re.compile(_TRIVIA)
        self.keywords, self.starters, self.ecma = _words(keywords), _words(starters), ecma
        self.class_of: dict[str, str] = {}
        match = self.shapes.match
        for w in self.keywords:
            match[w] = frozenset((w, "KW")) if ecma else frozenset((w,))
        for w in _words(contextual):
            match[w] = frozenset((w, "ID"))
        self.own = self.keywords | _words(contextual)
        for kind, members in classes.items():
            for w in members.split():
                self.class_of[w] = kind
        #: words of a class that are also keywords of their own keep both terminals
        for w, kind in list(self.class_of.items()):
            if w in self.own:
                match[w] = match[w] | {kind}
                del self.class_of[w]
        if ecma:
            for kind in set(self.class_of.values()):
                if kind in ("LIT", "MOD"):
                    match[kind] = frozenset((kind, "KW", *(("ID",) if kind == "MOD" else ())))
            match["UN"] = frozenset(("UN", "!"))
        else:
            match["UN"] = frozenset(("UN", "!"))

    def cut(self, tokens: tuple[str, ...]) -> list[tuple[str, ...]]:
        """Pieces of a list of statements: after a semicolon, and after a block before what can only begin another statement."""
        out, begin, n = [], 0, len(tokens)
        for i in range(n - 1):
            t, after = tokens[i], tokens[i + 1]
            if t == ";" and after not in ("else", "while", "NL") or t[0] == "{" and after in self.starters or self.ecma and t == "NL" and i > begin and tokens[i - 1][0] == "{" and after != "else":
                out.append(tokens[begin : i + 1])
                begin = i + 1
        if begin < n:
            out.append(tokens[begin:])
        return out


_OPERAND_END = frozenset(("ID", "NUM", "STR", "CHR", "LIT", "TPL", "REGEX", "JSX", "this", "super", "PRIVATE", "INC"))
_NO_NL_BEFORE = frozenset("catch finally while in of instanceof as satisfies extends implements from is".split())


class Scanner:
    """Reads one text; brackets are recognised as they close."""

    def __init__(self, language: Language, text: str, jsx: bool) -> None:
        self.lang, self.text, self.jsx = language, text, jsx
        self.pattern = language.pattern.match

    def parse(self) -> frozenset[str]:
        tokens, _ = self.run(0, False)
        return self.lang.shapes.accepted("", tuple(tokens), self.lang.cut)

    def close(self, bracket: str, tokens: list[str]) -> str:
        shapes = self.lang.shapes
        got = shapes.accepted(bracket, tuple(tokens), self.lang.cut)
        if not got:
            raise Invalid(f"no rule for the content of {bracket}")
        return shapes.token(bracket, got)

    def hole(self, at: int, kind: str) -> int:
        """An expression in braces within a literal: where it ends."""
        tokens, at = self.run(at, True)
        if kind not in self.lang.shapes.accepted("{", tuple(tokens), self.lang.cut):
            raise Invalid("no expression in braces")
        return at

    def run(self, at: int, inner: bool) -> tuple[list[str], int]:
        lang, text, match = self.lang, self.text, self.pattern
        own, class_of, ecma = lang.own, lang.class_of, lang.ecma
        tokens: list[str] = []
        stack: list[tuple[str, list[str]]] = []
        n = len(text)
        while True:
            m = match(text, at)
            if m is None:
                end = lang.trivia.match(text, at).end()
                if end >= n:
                    if stack or inner:
                        raise Invalid("open bracket at the end")
                    return tokens, end
                at = self.other(text, end, tokens, m_newline=ecma and ("\n" in text[at:end] or "\r" in text[at:end]))
                continue
            kind = m.lastindex
            last = tokens[-1] if tokens else ""
            value = m.group(kind)
            begin = m.start(kind)
            if ecma and begin > at and last:
                gap = m.group(1)
                if ("\n" in gap or "\r" in gap) and (last in _OPERAND_END or last[0] in "([{" or last in ("ID", "return", "break", "continue") or lang.shapes.match.get(last, ()) and "ID" in lang.shapes.match[last]):
                    if kind == 2 and value not in _NO_NL_BEFORE or kind == 3 or value in ("@", "#", "!", "~", "++", "--") or value == "{" and last == "NL":
                        tokens.append("NL")
                        last = "NL"
            at = m.end()
            if kind == 2:
                if value in own:
                    tokens.append(value)
                else:
                    tokens.append(class_of.get(value, "ID"))
            elif kind == 3:
                first = value[0]
                if first.isdigit() or first == ".":
                    if at < n and (text[at].isalnum() or text[at] in "_$"):
                        raise Invalid("bad number")
                    tokens.append("NUM")
                elif first == "'" and not ecma:
                    tokens.append("CHR")
                else:
                    tokens.append("STR")
            else:
                first = value[0]
                if value in "([{":
                    stack.append((value, tokens))
                    tokens = []
                elif value in ")]}":
                    if not stack:
                        if inner and value == "}":
                            return tokens, at
                        raise Invalid("bracket without begin")
                    bracket, outer = stack.pop()
                    if _CLOSER[bracket] != value:
                        raise Invalid("brackets do not match")
                    token = self.close(bracket, tokens)
                    tokens = outer
                    tokens.append(token)
                elif ecma and (first in "/<`#") and (self.special(value, begin, last)):
                    at = self.literal(value, begin, tokens)
                else:
                    tokens.append(class_of.get(value, value))

    def special(self, value: str, begin: int, last: str) -> bool:
        """Whether a sign begins a regular expression, a template, an element or a private name."""
        if value[0] == "`" or value[0] == "#":
            return True
        operand = last in _OPERAND_END or last[:1] in ("(", "[", "{") and last != "" or last in ("ID",) or "ID" in self.lang.shapes.match.get(last, ())
        if value[0] == "/":
            return not operand
        if not self.jsx or operand and last != "NL":
            return False
        after = self.text[begin + 1 : begin + 2]
        if not (after.isalpha() or after in (">", "_", "$")):
            return False
        return not re.compile(r"<\s*(?:const\s+)?\w+\s*(?:,|extends\b)").match(self.text, begin)

    def literal(self, value: str, begin: int, tokens: list[str]) -> int:
        if value[0] == "`":
            tokens.append("TPL")
            return self.template(begin + 1)
        if value[0] == "/":
            m = _REGEX.match(self.text, begin)
            if not m:
                raise Invalid("bad regular expression")
            tokens.append("REGEX")
            return m.end()
        if value[0] == "#":
            m = re.compile(r"#" + _NAME).match(self.text, begin)
            if not m:
                raise Invalid("bad character")
            tokens.append("PRIVATE")
            return m.end()
        tokens.append("JSX")
        return self.element(begin)

    def other(self, text: str, at: int, tokens: list[str], m_newline: bool) -> int:
        raise Invalid(f"bad character {text[at]!r}")

    def template(self, at: int) -> int:
        while True:
            m = _TEMPLATE.match(self.text, at)
            at = m.end()
            if self.text.startswith("`", at):
                return at + 1
            if not self.text.startswith("${", at):
                raise Invalid("open template")
            at = self.hole(at + 2, "JsxExpr")

    def element(self, at: int) -> int:
        """An element of JSX with its attributes and children."""
        text = self.text
        m = _TAG.match(text, at)
        if not m:
            raise Invalid("bad element")
        name, at = m.group(1) or "", m.end()
        while True:
            at = _SPACE.match(text, at).end()
            if text.startswith("/>", at):
                if not name:
                    raise Invalid("bad element")
                return at + 2
            if text.startswith(">", at):
                at += 1
                break
            if text.startswith("{", at):
                at = self.hole(at + 1, "JsxExpr")
                continue
            m = _ATTRIBUTE.match(text, at)
            if not m:
                raise Invalid("bad attribute")
            at = m.end()
            if m.group(1):
                if text.startswith("{", at):
                    at = self.hole(at + 1, "JsxExpr")
                elif v := _ATTRIBUTE_VALUE.match(text, at):
                    at = v.end()
                elif text.startswith("<", at):
                    at = self.element(at)
                else:
                    raise Invalid("bad attribute")
        while True:
            at = _JSX_TEXT.match(text, at).end()
            if text.startswith("{", at):
                at = self.hole(at + 1, "JsxExpr")
            elif m := _TAG_END.match(text, at):
                if (m.group(1) or "") != name:
                    raise Invalid("elements do not match")
                return m.end()
            elif text.startswith("<", at):
                at = self.element(at)
            else:
                raise Invalid("open element")


_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*")
_SPACE = re.compile(r"(?:\s|/\*(?s:.*?)\*/|//[^\n]*\n)*")
_TAG = re.compile(r"<\s*([\w$][\w$.:\-]*)?")
_TAG_END = re.compile(r"<\s*/\s*([\w$][\w$.:\-]*)?\s*>")
_ATTRIBUTE = re.compile(r"[\w$][\w$:\-]*(?:\s*(=)\s*)?")
_ATTRIBUTE_VALUE = re.compile(r"\"[^\"]*\"|'[^']*'")
_JSX_TEXT = re.compile(r"[^<{>}]*")

_JAVA = dict(
    grammar=grammars.JAVA, lists=grammars.LISTS["java"], tops=("Unit",),
    literals=rf"\"\"\"(?:[^\\\"]|\\(?s:.)|\"(?!\"\"))*\"\"\"|{_PLAIN_STRING}|'(?:[^'\\\r\n]|\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)'|{_DIGITS}[lLfFdD]?",
    signs=r">>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|[+\-*/%&|^]=|[()\[\]{};,.@?:=<>!~+\-*/%&|^]",
    keywords="abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while",
    contextual="record permits yield when module sealed",
    classes={"MOD": "public private protected static final abstract native synchronized transient volatile strictfp default sealed", "PRIM": "boolean byte char short int long float double", "LIT": "true false null", "PM": "+ -", "UN": "! ~", "INC": "++ --", "BIN": "/ % ^ && || == != <= >=", "AUG": "+= -= *= /= %= &= |= ^= <<= >>= >>>="},
    starters="if for return throw try switch int long double float boolean char byte short class public private protected static final abstract interface enum ID @ MOD PRIM do break continue synchronized case default new this",
)
_CSHARP = dict(
    grammar=grammars.CSHARP, lists=grammars.LISTS["csharp"], tops=("Unit",),
    literals=rf"\$*\"\"\"+(?s:.*?)\"\"\"+|\$?@\$?\"(?:[^\"]|\"\")*\"|\$\"(?:[^\"\\{{}}\r\n]|\\.|\{{\{{|\}}\}}|\{{(?:[^{{}}\"'\r\n]|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|\{{[^{{}}]*\}})*\}})*\"|{_PLAIN_STRING}(?:u8)?|'(?:[^'\\\r\n]|\\[xuU][0-9a-fA-F]+|\\.)'|{_DIGITS.replace(chr(92) + '.?', '(?:' + chr(92) + '.(?=' + chr(92) + 'd))?')}(?:[uU][lL]?|[lL][uU]?|[fFdDmM])?",
    signs=r">>=|<<=|\?\?=|\?\.(?!\d)|\?\?|\.\.|=>|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|[+\-*/%&|^]=|[()\[\]{};,.?:=<>!~+\-*/%&|^]",
    keywords="as base break case catch checked class continue default delegate do else enum event explicit extern finally fixed for foreach goto if implicit in interface is lock namespace new operator out params ref return sizeof stackalloc static struct switch this throw try typeof unchecked unsafe using void while",
    contextual="get set init add remove when where global record yield await nameof and or not var with from select group by into let join on equals orderby ascending descending async partial required file scoped",
    classes={"MOD": "public private protected internal static abstract sealed virtual override readonly const volatile extern unsafe new partial async required file ref", "PRIM": "bool byte sbyte char decimal double float int uint long ulong short ushort object string", "LIT": "true false null", "PM": "+ -", "UN": "! ~", "INC": "++ --", "BIN": "/ % ^ && || == != <= >= ??", "AUG": "+= -= *= /= %= &= |= ^= <<= >>= ??="},
    starters="if for foreach return throw try switch class public private protected static abstract interface enum struct MOD PRIM do break continue lock case default ID var using namespace void",
)
_ECMA_WORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with enum"
_ECMA = dict(
    tops=("Module", "Script"), lists=grammars.LISTS["ecma"], ecma=True,
    literals=rf"{_STRING}|'(?:[^'\\\r\n]|\\(?:\r\n|(?s:.)))*'|{_DIGITS}n?",
    signs=r">>>=|\*\*=|\?\?=|&&=|\|\|=|<<=|>>=|===|!==|\.\.\.|>>>(?=[^>])|\?\.(?!\d)|=>|\*\*|\?\?|&&|\|\||\+\+|--|<<|==|!=|<=|>=|[+\-*/%&|^]=|[()\[\]{};,.?:=<>!~+\-*/%&|^@`#]",
    starters="NL",
)
_ECMA_CLASSES = {"LIT": "true false null", "PM": "+ -", "UN": "! ~", "INC": "++ --", "BIN": "/ % ^ && || ?? == != === !== <= >= << ** >>>", "AUG": "+= -= *= /= %= &= |= ^= <<= >>= >>>= **= ??= &&= ||="}
_JS = dict(_ECMA, grammar=grammars.ecma(False), keywords=_ECMA_WORDS, contextual="let static async await yield of get set from as assert", classes=_ECMA_CLASSES)
_TS = dict(
    _ECMA, grammar=grammars.ecma(True), keywords=_ECMA_WORDS,
    contextual="let static async await yield of get set from as assert type interface namespace module declare abstract readonly override keyof unique infer is asserts satisfies implements require global out",
    classes=_ECMA_CLASSES | {"MOD": "public private protected accessor"},
)

# --- Python --------------------------------------------------------------------------------------------------------

_PY_KEYWORDS = _words("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield")
_PY_SOFT = _words("match case type")
_PY_TOKEN = re.compile(
    r"([ \t\f]*(?:\\\r?\n[ \t\f]*)*)(?:(#[^\n]*)|(\n)|([rRuUbBfF]{0,2}(?:\"\"\"(?:[^\"\\]|\\(?s:.)|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\(?s:.)|'(?!''))*'''|\"(?:[^\"\\\n]|\\(?s:.))*\"|'(?:[^'\\\n]|\\(?s:.))*'))"
    r"|([^\W\d]\w*)|((?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[1-9](?:_?\d)*|0(?:_?0)*)(?:\.(?:\d(?:_?\d)*)?)?|\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\d(?:_?\d)*(?=[eEjJ])|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))"
    r"|(\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|<<|>>|<=|>=|==|[+\-*/%&|^@]=|[()\[\]{},:;.=@+\-*/%&|^~<>]))"
)
_PY_SIGNS = {x: kind for kind, members in {"PM": "+ -", "UN": "~", "BIN": "/ // % & | ^ << >>", "CMP": "== != < > <= >=", "AUG": "+= -= *= /= //= %= &= |= ^= <<= >>= **= @="}.items() for x in members.split()}
_PY_BREAK = frozenset("Elif1 HElif Else1 HElse Except1 HExcept Finally1 HFinally".split())


class Python:
    """Lines are recognised first, then their suites as blocks of lines."""

    def __init__(self) -> None:
        self.lines = Shapes(grammars.PYTHON_LINE, (), tuple(sorted(x for x in Grammar(grammars.PYTHON_LINE).rules if re.fullmatch(r"H[A-Z]\w+|[A-Z][a-z]+1|Simple", x) and x != "Primary1")))
        self.blocks = Shapes(grammars.PYTHON, grammars.LISTS["python"], ("Unit",))
        for w in _PY_KEYWORDS:
            self.lines.match[w] = frozenset((w,))
        for w in _PY_SOFT:
            self.lines.match[w] = frozenset((w, "ID"))

    def cut(self, tokens: tuple[str, ...]) -> list[tuple[str, ...]]:
        """Pieces of a suite: each line with its block and what continues it."""
        out, begin = [], 0
        for i in range(1, len(tokens)):
            t = tokens[i]
            kinds = self.blocks.match.get(t, frozenset((t,)))
            if t[0] != "{" and not (kinds & _PY_BREAK) and "HDecor" not in self.blocks.match.get(tokens[i - 1], ()):
                out.append(tokens[begin:i])
                begin = i
        if tokens:
            out.append(tokens[begin:])
        return out

    def line(self, tokens: tuple[str, ...]) -> str:
        got = self.lines.recognise(_short(tokens), self.lines.starts[""], "")
        if not got:
            raise Invalid("no rule for a line")
        name = "L" + " ".join(sorted(got))
        if name not in self.blocks.match:
            self.blocks.match[name] = got
        return name

    def parse(self, text: str) -> frozenset[str]:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if not text.endswith("\n"):
            text += "\n"
        at, n = 0, len(text)
        tokens: list[str] = []
        stack: list[tuple[str, list[str]]] = []
        indents, suites = [0], [[]]
        fresh = True
        while at < n:
            m = _PY_TOKEN.match(text, at)
            if m is None:
                if not text[at:].strip(" \t\f\n"):
                    break
                raise Invalid(f"bad character {text[at:].lstrip()[:1]!r}")
            kind, value = m.lastindex, m.group(m.lastindex)
            if kind == 2:
                at = m.end()
                continue
            if kind == 3:
                at = m.end()
                if not stack and tokens:
                    suites[-1].append(self.line(tuple(tokens)))
                    tokens = []
                fresh = not stack and not tokens
                continue
            if fresh and not stack:
                fresh = False
                width = self.indent(m.group(1))
                if width > indents[-1]:
                    indents.append(width)
                    suites.append([])
                else:
                    while width < indents[-1]:
                        self.dedent(indents, suites)
                    if width != indents[-1]:
                        raise Invalid("indentation")
            at = m.end()
            if kind == 4:
                tokens.append("STR")
            elif kind == 5:
                tokens.append(value if value in _PY_KEYWORDS or value in _PY_SOFT else "LIT" if value in ("None", "True", "False") else "ID")
            elif kind == 6:
                if at < n and (text[at].isalnum() or text[at] == "_"):
                    if not re.match(r"(?:and|or|if|else|in|is|for|not)\b", text[at:]):
                        raise Invalid("bad number")
                tokens.append("NUM")
            elif value in "([{":
                stack.append((value, tokens))
                tokens = []
            elif value in ")]}":
                if not stack or _CLOSER[stack[-1][0]] != value:
                    raise Invalid("brackets do not match")
                bracket, outer = stack.pop()
                got = self.lines.accepted(bracket, tuple(tokens), lambda t: [t])
                if not got:
                    raise Invalid("no rule for the content of a bracket")
                outer.append(self.lines.token(bracket, got))
                tokens = outer
            else:
                tokens.append(_PY_SIGNS.get(value, value))
        if stack or tokens:
            raise Invalid("open bracket at the end")
        while len(indents) > 1:
            self.dedent(indents, suites)
        return self.blocks.accepted("", tuple(suites[0]), self.cut)

    def indent(self, space: str) -> int:
        width = 0
        for c in space.rsplit("\n", 1)[-1]:
            width = (width // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else width + 1
        return width

    def dedent(self, indents: list[int], suites: list[list[str]]) -> None:
        indents.pop()
        inner = tuple(suites.pop())
        got = self.blocks.accepted("{", inner, self.cut)
        if not got:
            raise Invalid("no rule for a block")
        suites[-1].append(self.blocks.token("{", got))


_LANGUAGES: dict[str, object] = {}


def _language(name: str):
    if name not in _LANGUAGES:
        _LANGUAGES[name] = Python() if name == "python" else Language(**{"java": _JAVA, "csharp": _CSHARP, "javascript": _JS, "typescript": _TS}[name])
    return _LANGUAGES[name]


_DIRECTIVE = re.compile(r"(?m)^[ \t]*#[ \t]*(?:region|endregion|if|else|elif|endif|define|undef|pragma|nullable|warning|error|line)\b[^\r\n]*")


def why_invalid(text: str, suffix: str) -> str | None:
    """Why no dialect of the suffix's language accepts a text; None if one does, for blank texts and for other suffixes."""
    try:
        return _why_invalid(text, suffix)
    except RecursionError:
        return _in_deep_thread(text, suffix)


def _why_invalid(text: str, suffix: str) -> str | None:
    if suffix not in SUFFIXES:
        return None
    name, jsx = SUFFIXES[suffix]
    text = text.removeprefix("\ufeff")
    if not text.strip():
        return None
    if "\0" in text:
        return "null character"
    language = _language(name)
    try:
        if name == "python":
            got = language.parse(text)
        else:
            if name == "csharp":
                text = _DIRECTIVE.sub("", text)
            elif language.ecma and text.startswith("#!"):
                text = "//" + text
            got = Scanner(language, text, jsx).parse()
    except Invalid as x:
        return str(x)
    return None if got else "no rule for the file"


#: Bytes of the stack of a thread for deeply nested files, and calls that it may hold.
STACK, DEPTH = 512 << 20, 200_000


def _in_deep_thread(text: str, suffix: str) -> str | None:
    """`why_invalid` with room for DEPTH nested calls."""
    answer: list = []

    def run() -> None:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(DEPTH)
        try:
            answer.append(_why_invalid(text, suffix))
        except RecursionError:
            answer.append("nested too deeply")
        finally:
            sys.setrecursionlimit(limit)

    before = threading.stack_size(STACK)
    try:
        thread = threading.Thread(target=run)
        thread.start()
        thread.join()
    finally:
        threading.stack_size(before)
    return answer[0]


def invalid_files(files: DataFrame) -> DataFrame:
    """(repository, file_path, suffix, reason) of each file that is not valid in the language of its suffix, once.

    Null and blank contents are valid, contents that are not UTF-8 are not; other suffixes are left out; a null suffix is taken from the path.
    Files delivered twice count once. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repository, path, suffix, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                end = suffix or "." + (path or "").rpartition(".")[2]
                try:
                    why = why_invalid((content or b"").decode("utf-8"), end)
                except UnicodeDecodeError:
                    why = "not UTF-8"
                if why:
                    rows.append((repository, path, end, why))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["repository", "file_path", "suffix", "reason"])

    found = files.select("repository", "file_path", "suffix", "content").mapInArrow(run, "repository string, file_path string, suffix string, reason string")
    return found.dropDuplicates(["repository", "file_path"])


def invalid_rates(files: DataFrame) -> DataFrame:
    """(repository, suffix, n_files, n_invalid, rate): files of each repository and language suffix, and how many do not parse."""
    keys = ["repository", "suffix"]
    own = F.coalesce("suffix", F.concat(F.lit("."), F.substring_index("file_path", ".", -1)))
    known = files.withColumn("suffix", own).filter(F.col("suffix").isin(*SUFFIXES)).select(*keys, "file_path").distinct().groupBy(*keys).agg(F.count("*").alias("n_files"))
    bad = invalid_files(files).groupBy(*keys).agg(F.count("*").alias("n_invalid"))
    n = F.coalesce("n_invalid", F.lit(0).cast("long"))
    return known.join(bad, keys, "left").select(*keys, "n_files", n.alias("n_invalid"), F.round(n / F.col("n_files"), 6).alias("rate"))
