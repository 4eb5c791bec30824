"""Generalised LL recognition with a graph-structured stack.

Grammars are written as text. `Name = …` defines a nonterminal; alternatives are parted by |; a word in quotes or in capitals is a terminal;
( … ) groups, and ?, * and + follow what they repeat. (:Name:), [:Name:] and {:Name:} are terminals as well: a whole bracketed part of
the source whose content derives from Name. Any context-free grammar may be used, left-recursive or ambiguous.

The recogniser keeps descriptors (place in a rule, stack node, position). Stack nodes are shared by all that call one
nonterminal at one position, and so by all start symbols that run together on one input, such as the dialects of a language.
"""

from __future__ import annotations

import re
from functools import lru_cache

_SYMBOL = re.compile(r"'([^']+)'|([(\[{]:\w+:[)\]}])|([A-Z][A-Z0-9_]+\b)|(\w+)|([()|?*+=;])")


class _Slot:
    """A place in a rule: before a terminal, before a nonterminal, or at the end."""

    __slots__ = ("name", "terminal", "next")

    def __init__(self, name: str | None, terminal: bool, following: "_Slot | None") -> None:
        self.name, self.terminal, self.next = name, terminal, following


class _Node:
    """A node of the graph-structured stack: a nonterminal called at a position."""

    __slots__ = ("edges", "pops")

    def __init__(self) -> None:
        self.edges: list[tuple[_Slot, _Node]] = []
        self.pops: list[int] = []


class Grammar:
    def __init__(self, text: str) -> None:
        self.rules: dict[str, list[tuple[tuple[str, bool], ...]]] = {}
        self.groups: dict[str, set[str]] = {"(": set(), "[": set(), "{": set()}
        for rule in re.split(r"\n(?=\w+ =)", text.strip()):
            name, body = re.match(r"(\w+) =(.*)", rule, re.S).groups()
            tokens = [m.groups() for m in _SYMBOL.finditer(body)]
            at, alternatives = self._choice(tokens, 0)
            assert at == len(tokens), rule
            self.rules.setdefault(name.strip(), []).extend(alternatives)
        called = {s for alts in self.rules.values() for alt in alts for s, t in alt if not t}
        called |= {x for names in self.groups.values() for x in names}
        assert called <= set(self.rules), called - set(self.rules)
        self._close()

    def _choice(self, tokens: list, at: int) -> tuple[int, list]:
        out, sequence = [], []
        while at < len(tokens):
            quoted, group, capital, word, sign = tokens[at]
            if sign == ")":
                break
            at += 1
            if sign == "|":
                out.append(tuple(sequence))
                sequence = []
                continue
            if sign == "(":
                at, inner = self._choice(tokens, at)
                at += 1
                item = (self._helper(inner), False)
            elif group:
                self.groups[group[0]].add(group[2:-2])
                item = (group, True)
            elif quoted or capital:
                item = (quoted or capital, True)
            else:
                item = (word, False)
            if at < len(tokens) and tokens[at][4] in ("?", "*", "+"):
                item = (self._repeat(item, tokens[at][4]), False)
                at += 1
            sequence.append(item)
        out.append(tuple(sequence))
        return at, out

    def _helper(self, alternatives: list) -> str:
        name = f"_{len(self.rules)}"
        self.rules[name] = list(alternatives)
        return name

    def _repeat(self, item: tuple[str, bool], sign: str) -> str:
        if sign == "?":
            return self._helper([(item,), ()])
        name = self._helper([])
        self.rules[name] = [(item, (name, False)), ()]
        return name if sign == "*" else self._helper([(item, (name, False))])

    def _close(self) -> None:
        """Nullable symbols, first sets and slots."""
        empty: set[str] = set()
        first: dict[str, set[str]] = {x: set() for x in self.rules}
        changed = True
        while changed:
            changed = False
            for name, alts in self.rules.items():
                for alt in alts:
                    got: set[str] = set()
                    for s, t in alt:
                        got |= {s} if t else first[s]
                        if t or s not in empty:
                            break
                    else:
                        if name not in empty:
                            empty.add(name)
                            changed = True
                    if not got <= first[name]:
                        first[name] |= got
                        changed = True
        self.table: dict[str, list[tuple[frozenset, bool, _Slot]]] = {}
        for name, alts in self.rules.items():
            rows = []
            for alt in alts:
                got, void = set(), True
                for s, t in alt:
                    got |= {s} if t else first[s]
                    if t or s not in empty:
                        void = False
                        break
                slot = _Slot(None, False, None)
                for s, t in reversed(alt):
                    slot = _Slot(s, t, slot)
                rows.append((frozenset(got), void, slot))
            self.table[name] = rows
        self.predict = lru_cache(None)(self._predict)

    def _predict(self, name: str, seen: frozenset | None) -> tuple[_Slot, ...]:
        """Alternatives that may begin with a token of these terminals (None: at the end of the input)."""
        return tuple(slot for got, void, slot in self.table[name] if void or seen is not None and not got.isdisjoint(seen))

    def accepts(self, tokens: list[frozenset], starts: tuple[str, ...]) -> frozenset[str]:
        """The start symbols that derive the input. Each token is the set of terminals it can be."""
        n, predict = len(tokens), self.predict
        input_ = [*tokens, None]
        nodes: dict[tuple[str, int], _Node] = {}
        todo: list[tuple[_Slot, _Node, int]] = []
        done: set[tuple[int, int, int]] = set()
        for start in starts:
            nodes[start, 0] = node = _Node()
            todo += [(slot, node, 0) for slot in predict(start, input_[0])]
        while todo:
            slot, node, i = todo.pop()
            while True:
                name = slot.name
                if name is None:
                    if i not in node.pops:
                        node.pops.append(i)
                        for back, parent in node.edges:
                            key = (id(back), id(parent), i)
                            if key not in done:
                                done.add(key)
                                todo.append((back, parent, i))
                    break
                if slot.terminal:
                    if i == n or name not in input_[i]:
                        break
                    i += 1
                    slot = slot.next
                    continue
                options = predict(name, input_[i])
                if not options:
                    break
                child = nodes.get((name, i))
                back = slot.next
                if child is None:
                    nodes[name, i] = child = _Node()
                    child.edges.append((back, node))
                    todo += [(option, child, i) for option in options]
                else:
                    edge = (back, node)
                    if edge not in child.edges:
                        child.edges.append(edge)
                        for j in child.pops:
                            key = (id(back), id(node), j)
                            if key not in done:
                                done.add(key)
                                todo.append((back, node, j))
                break
        return frozenset(s for s in starts if n in nodes[s, 0].pops)
