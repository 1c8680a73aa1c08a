"""Regular expressions over bytes as minimal deterministic automata.

A small expression language (literals, ``\\xHH``, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``)
is turned into a nondeterministic automaton, several of these into one deterministic automaton by subset construction,
and that into the minimal one by partition refinement. Bytes that no expression tells apart share a column.
"""

from __future__ import annotations

from functools import lru_cache

ANY = frozenset(range(256))


class _Parser:
    """Expression text to a tree of ('set', bytes), ('cat', parts), ('alt', parts), ('rep', part, least, most)."""

    def __init__(self, text: str, any_case: bool):
        self.text, self.at, self.any_case = text, 0, any_case

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.atom()
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at:end].partition(",")
                self.at = end + 1
                least, most = int(low), int(high) if high else (None if comma else int(low))
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            part = ("rep", part, least, most)
        return part

    def atom(self):
        c = self.take()
        if c == "(":
            part = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text}")
            return part
        if c == "[":
            return ("set", self.members())
        return ("set", self.cases({ord(self.escaped() if c == "\\" else c)}))

    def escaped(self) -> str:
        c = self.take()
        if c == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2:self.at], 16))
        return c

    def members(self) -> frozenset[int]:
        found: set[int] = set()
        negated = self.peek() == "^" and bool(self.take())
        while self.peek() != "]":
            c = self.take()
            low = ord(self.escaped() if c == "\\" else c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                c = self.take()
                high = ord(self.escaped() if c == "\\" else c)
            found.update(range(low, high + 1))
        self.take()
        return ANY - self.cases(found) if negated else self.cases(found)

    def cases(self, found: set[int]) -> frozenset[int]:
        if self.any_case:
            found = {ord(x) for c in found if c < 128 for x in (chr(c).lower(), chr(c).upper())} | {c for c in found if c > 127}
        return frozenset(found)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """States for ``node`` from ``start``; gives its end."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            if self.moves[start] is not None:
                hop = self.state()
                self.empty[start].append(hop)
                start = hop
            self.moves[start] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(part, first)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.add(part, start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        for _ in range(most - least):
            self.empty[start].append(end)
            first = self.state()
            self.empty[start].append(first)
            start = self.add(part, first)
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class Automaton:
    """Transition array ``table[state + column]`` with states premultiplied by the number of columns.

    ``columns`` maps bytes to columns (for ``bytes.translate``). State 0 is the start. States from ``accepting`` on are
    those in which some expression has just matched; ``matched[state]`` is the set of these as a bit mask. ``dead`` is the
    state without a way on, or -1.
    """

    def __init__(self, expressions: tuple[tuple[str, bool], ...], anywhere: bool):
        nfa = _Nfa()
        begin = nfa.state()
        ends = {}
        for i, (text, any_case) in enumerate(expressions):
            parser = _Parser(text, any_case)
            tree = parser.alternatives()
            if parser.peek():
                raise ValueError(f"unexpected {parser.peek()!r} in {text}")
            first = nfa.state()
            nfa.empty[begin].append(first)
            ends[nfa.add(tree, first)] = 1 << i
        signature = [tuple(b in m[0] for m in nfa.moves if m) for b in range(256)]
        kinds = {s: k for k, s in enumerate(dict.fromkeys(signature))}
        self.columns = bytes(kinds[s] for s in signature)
        sample = [self.columns.index(k) for k in range(len(kinds))]
        rows, accepts = self._subsets(nfa, begin, ends, sample, anywhere)
        self._number(*self._minimal(rows, accepts))

    @staticmethod
    def _subsets(nfa, begin, ends, sample, anywhere):
        start = nfa.closure([begin])
        number, todo, rows, accepts = {start: 0}, [start], [], []
        for states in todo:
            moves = [nfa.moves[s] for s in states if nfa.moves[s]]
            row = []
            for byte in sample:
                reached = nfa.closure({t for allowed, t in moves if byte in allowed})
                if anywhere:
                    reached |= start
                if reached not in number:
                    number[reached] = len(todo)
                    todo.append(reached)
                row.append(number[reached])
            rows.append(row)
            accepts.append(sum(ends.get(s, 0) for s in states))
        return rows, accepts

    @staticmethod
    def _minimal(rows, accepts):
        block = list(accepts)
        parts = len(set(block))
        while True:
            keys: dict = {}
            block = [keys.setdefault((block[s], *[block[t] for t in row]), len(keys)) for s, row in enumerate(rows)]
            if len(keys) == parts:
                break
            parts = len(keys)
        chosen = {}
        for s, b in enumerate(block):
            chosen.setdefault(b, s)
        return [[block[t] for t in rows[chosen[b]]] for b in range(parts)], [accepts[chosen[b]] for b in range(parts)]

    def _number(self, rows, accepts):
        order = sorted(range(len(rows)), key=lambda s: (accepts[s] != 0, s))
        width = len(rows[0])
        place = {s: i * width for i, s in enumerate(order)}
        self.table = [place[t] for s in order for t in rows[s]]
        self.accepting = width * sum(not a for a in accepts)
        self.matched = {place[s]: accepts[s] for s in order}
        self.states = len(rows)
        self.dead = next((place[s] for s in order if not accepts[s] and set(rows[s]) == {s}), -1)

    def found(self, data: bytes) -> int:
        """Bit mask of the expressions that match somewhere in ``data``: one pass over the bytes."""
        state, mask, table, accepting = 0, 0, self.table, self.accepting
        for column in data.translate(self.columns):
            state = table[state + column]
            if state >= accepting:
                mask |= self.matched[state]
        return mask

    def longest(self, columns: bytes, start: int) -> int:
        """End of the longest match that begins at ``start``, or -1. ``columns`` is the translated text."""
        state, end, table, accepting, dead = 0, -1, self.table, self.accepting, self.dead
        for i in range(start, len(columns)):
            state = table[state + columns[i]]
            if state == dead:
                break
            if state >= accepting:
                end = i + 1
        return end

    def first_bytes(self) -> frozenset[int]:
        return frozenset(b for b in range(256) if self.table[self.columns[b]] != self.dead)


@lru_cache(maxsize=None)
def compiled(expressions: tuple[tuple[str, bool], ...], anywhere: bool) -> Automaton:
    return Automaton(expressions, anywhere)
