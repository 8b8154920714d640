"""Memoised parsing with derivatives over token streams.

The derivative of a grammar by a token is what may still follow once that token was read.  A parse state is a
set of stacks of symbols still expected; ``derive`` replaces every stack by its derivatives.  Stacks and states
are interned, so each derivative is worked out once per worker and afterwards costs one dictionary look-up:
the grammar turns into a lazily built automaton.  An empty derivative marks the exact failing token; a state
that is not nullable when the tokens end means that the text was cut off.
"""

from __future__ import annotations

import re

_LEX = re.compile(r"'[^']+'|[A-Za-z_]\w*|[\[\](){}|]")


class Grammar:
    """EBNF rules, one per line: ``name = alternatives``; ``[x]`` is optional, ``{x}`` repeats.

    Quoted strings and names in capitals are terminals.  Rules must not be left-recursive.
    """

    MAX_STATES = 200_000

    def __init__(self, text: str) -> None:
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        joined = re.sub(r"\n\s+", " ", text.strip())
        for line in joined.split("\n"):
            if "=" not in line:
                continue
            name, body = line.split("=", 1)
            self._items = _LEX.findall(body)
            rule = "<" + name.strip()
            self.rules[rule] = self._alternatives(rule)
        missing = {s for ps in self.rules.values() for p in ps for s in p if len(s) > 1 and s[0] == "<" and s[1].islower() and s not in self.rules}
        if missing:
            raise ValueError(f"undefined rules: {sorted(missing)}")
        self.nullable = self._nullable()
        self.reset()

    # -- reading the rules

    def _alternatives(self, hint: str) -> list[tuple[str, ...]]:
        out, seq = [], []
        while self._items and self._items[0] not in (")", "]", "}"):
            item = self._items.pop(0)
            if item == "|":
                out.append(tuple(seq))
                seq = []
            elif item in "([{":
                inner = self._alternatives(hint)
                self._items.pop(0)
                aux = f"{hint}~{len(self.rules)}"
                while aux in self.rules:
                    aux += "~"
                self.rules[aux] = inner
                if item == "[":
                    self.rules[aux] = [*inner, ()]
                elif item == "{":
                    self.rules[aux] = [*[(*p, aux) for p in inner], ()]
                seq.append(aux)
            else:
                seq.append(item.strip("'") if item[0] == "'" else item if item.isupper() else "<" + item)
        out.append(tuple(seq))
        return out

    def _nullable(self) -> set[str]:
        found: set[str] = set()
        while True:
            more = {n for n, ps in self.rules.items() if n not in found and any(all(s in found for s in p) for p in ps)}
            if not more:
                return found
            found |= more

    # -- derivatives

    def reset(self) -> None:
        self._node = {}  # (symbol, rest) -> id; 0 is the finished stack
        self._sym, self._rest = [""], [0]
        self._state: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._delta: dict[tuple[str, str], frozenset] = {}
        self._of_node: dict[tuple[int, str], frozenset] = {}
        self.trans: list[dict[str, int]] = []
        self.memo: dict = {}  # longer steps, kept by callers
        self.dead = self._intern(frozenset())

    def _push(self, symbols: tuple[str, ...], rest: int) -> int:
        for s in reversed(symbols):
            key = (s, rest)
            node = self._node.get(key)
            if node is None:
                node = self._node[key] = len(self._sym)
                self._sym.append(s)
                self._rest.append(rest)
            rest = node
        return rest

    def _intern(self, stacks: frozenset) -> int:
        state = self._state.get(stacks)
        if state is None:
            state = self._state[stacks] = len(self._sets)
            self._sets.append(stacks)
            self.trans.append({})
        return state

    def start(self, symbol: str) -> int:
        """The state that expects ``symbol``; forgets everything first if the memory is full."""
        if len(self._sets) > self.MAX_STATES:
            self.reset()
        return self._intern(frozenset([self._push(("<" + symbol,), 0)]))

    def _of_symbol(self, name: str, token: str) -> frozenset:
        key = (name, token)
        got = self._delta.get(key)
        if got is None:
            out = set()
            for production in self.rules[name]:
                for i, s in enumerate(production):
                    tail = production[i + 1 :]
                    if s not in self.rules:
                        if s == token:
                            out.add(tail)
                        break
                    out.update(left + tail for left in self._of_symbol(s, token))
                    if s not in self.nullable:
                        break
            got = self._delta[key] = frozenset(out)
        return got

    def _of_stack(self, node: int, token: str) -> frozenset:
        key = (node, token)
        got = self._of_node.get(key)
        if got is None:
            out: set[int] = set()
            at = node
            while at:
                s, rest = self._sym[at], self._rest[at]
                if s not in self.rules:
                    if s == token:
                        out.add(rest)
                    break
                out.update(self._push(left, rest) for left in self._of_symbol(s, token))
                if s not in self.nullable:
                    break
                at = rest
            got = self._of_node[key] = frozenset(out)
        return got

    def derive(self, state: int, token: str) -> int:
        """The derivative of ``state`` by ``token``; ``dead`` if nothing may follow."""
        row = self.trans[state]
        nxt = row.get(token)
        if nxt is None:
            out: set[int] = set()
            for node in self._sets[state]:
                out |= self._of_stack(node, token)
            nxt = row[token] = self._intern(frozenset(out))
        return nxt

    def is_nullable(self, state: int) -> bool:
        """Whether the text may end in ``state``."""
        for node in self._sets[state]:
            while node and self._sym[node] in self.nullable:
                node = self._rest[node]
            if not node:
                return True
        return False
