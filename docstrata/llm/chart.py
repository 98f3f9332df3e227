"""Error-correcting chart parsing of token kinds, with bracket groups as single tokens.

A grammar is written in extended BNF: rules in capitals are constituents of the chart, rules in small letters are put in
where they are named. ``'word'`` is a token, a capital name without a rule a class of tokens, ``'(ARGS)'`` a bracket group
whose content reads as ARGS. Rules become finite automata over tokens, groups and constituents; the chart (``least``) is
Earley's over their states, with edits: to insert, delete or replace a token costs 1, to insert an empty group 2, to delete
a group or put another in its place GROUP. ``longest`` is the same chart without edits.
"""

from __future__ import annotations

import re
from collections import defaultdict

#: What it costs to delete a bracket group, or to put one with other content in its place.
GROUP = 3
#: What it costs to drop a whole statement: one that fewer token edits can't mend is dropped.
DROP = 4
#: Entries of a memo of the charts before it is emptied, and the longest text that is remembered.
MEMO, LONG = 200_000, 2_000
OPENERS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_FAR = 1 << 20
_REPEATED = re.compile(r"([\s\S]{1,8}?)\1{%d,}" % (2 * DROP))


def shortened(kinds: str) -> str:
    """``kinds`` with at most twice DROP copies of what is repeated one after the other.

    Repetition in the rules is free of any count, so a list of so many items is read, or mended with fewer than DROP
    edits, as a longer one is.
    """
    return _REPEATED.sub(lambda m: m[1] * (2 * DROP), kinds) if len(kinds) > 40 else kinds


class Grammar:
    """``rules`` in extended BNF. ``lists[rule]`` is the element rule of a rule that is just a list of statements."""

    def __init__(self, rules: str, lists: dict[str, str], end: str = ""):
        self.lists, self.end_mark = lists, end
        self.codes: dict[str, str] = {}
        self._text = dict(re.findall(r"^(\w+) = ((?:.*)(?:\n[ \t]+.*)*)", rules, re.M))
        self.names = [name for name in self._text if name[0].isupper()]
        self._eps: list[list[int]] = []
        self._edges: list[list[tuple[object, int]]] = []
        self.owner: list[str] = []
        self.accepting: list[bool] = []
        self.moves: list[dict[object, int]] = []
        self.start: dict[str, int] = {}
        for name in self.names:
            self._automaton(name)
        self.inside: dict[str, list[str]] = defaultdict(list)  # bracket -> rules its content may have
        for moves in self.moves:
            for symbol in moves:
                if isinstance(symbol, tuple) and symbol[1] not in self.inside[symbol[0]]:
                    self.inside[symbol[0]].append(symbol[1])
        self.steps = [[(s, t) for s, t in m.items() if isinstance(s, str) and s in self.start] for m in self.moves]
        self.words = [{s: t for s, t in m.items() if isinstance(s, str) and s not in self.start} for m in self.moves]
        self.groups = [[(s, t) for s, t in m.items() if isinstance(s, tuple)] for m in self.moves]
        self.owns = [name if ok else None for name, ok in zip(self.owner, self.accepting, strict=True)]
        self._insertions()
        self._firsts()
        self.readings: dict[str, dict[tuple[str, str], int]] = {}  # group kind -> rule -> extra cost
        self._classes: dict[tuple, str] = {}
        self._next: list[dict[str, tuple[int, ...]]] = [{} for _ in self.moves]
        self._opens: dict[tuple[str, str], bool] = {}
        self._cuts: dict[tuple[str, str], int] = {}
        self._whole: dict[tuple[str, str], bool] = {}
        self._costs: dict[tuple[str, str], int] = {}

    def code(self, token: str) -> str:
        """The one character that stands for a token or a class of tokens."""
        if token not in self.codes:
            self.codes[token] = chr(0x100 + len(self.codes))
        return self.codes[token]

    # From rules to automata ------------------------------------------------------------------------------------------
    def _node(self) -> int:
        self._eps.append([])
        self._edges.append([])
        return len(self._eps) - 1

    def _automaton(self, name: str) -> None:
        self._eps, self._edges = [], []
        start, end = self._node(), self._node()
        tokens = [*re.findall(r"'[^']+'|\w+|[()|?*+]", self._text[name]), ""]
        self._parse(tokens, 0, start, end)
        self._determinize(name, start, end)

    def _parse(self, tokens: list[str], at: int, start: int, end: int) -> int:
        """Adds the alternatives that begin at ``tokens[at]`` between two nodes; returns where they end."""
        while True:
            here = self._node()
            self._eps[start].append(here)
            while tokens[at] not in ("|", ")", ""):
                token, at = tokens[at], at + 1
                before, after = self._node(), self._node()
                self._eps[here].append(before)
                if token == "(":
                    at = self._parse(tokens, at, before, after) + 1
                elif token[0] == "'":
                    word = token[1:-1]
                    group = re.fullmatch(r"([(\[{<])([A-Z]+)[)\]}>]", word)
                    self._edges[before].append(((group[1], group[2]) if group else self.code(word), after))
                elif token[0].islower():
                    self._parse([*re.findall(r"'[^']+'|\w+|[()|?*+]", self._text[token]), ""], 0, before, after)
                else:
                    self._edges[before].append((token if token in self._text else self.code(token), after))
                here = self._node()
                self._eps[after].append(here)
                if tokens[at] in ("?", "*", "+"):
                    if tokens[at] != "+":
                        self._eps[before].append(here)
                    if tokens[at] != "?":
                        self._eps[after].append(before)
                    at += 1
            self._eps[here].append(end)
            if tokens[at] != "|":
                return at
            at += 1

    def _closure(self, nodes: set[int]) -> frozenset[int]:
        found, stack = set(nodes), list(nodes)
        while stack:
            for n in self._eps[stack.pop()]:
                if n not in found:
                    found.add(n)
                    stack.append(n)
        return frozenset(n for n in found if self._edges[n] or n == 1)  # node 1 is the end

    def _determinize(self, name: str, start: int, end: int) -> None:
        first = self._closure({start})
        sets, found, moves = {first: 0}, [first], []
        closed: dict[frozenset[int], frozenset[int]] = {}
        for here in found:  # grows while it is read
            goals = defaultdict(set)
            for n in here:
                for symbol, to in self._edges[n]:
                    goals[symbol].add(to)
            moves.append({})
            for symbol, nodes in goals.items():
                key = frozenset(nodes)
                if key not in closed:
                    closed[key] = self._closure(nodes)
                if closed[key] not in sets:
                    sets[closed[key]] = len(found)
                    found.append(closed[key])
                moves[-1][symbol] = sets[closed[key]]
        block = [int(end in s) for s in found]
        while True:  # states that read the same go together
            keys = [(block[i], frozenset((s, block[t]) for s, t in m.items())) for i, m in enumerate(moves)]
            number: dict[object, int] = {}
            new = [number.setdefault(k, len(number)) for k in keys]
            if len(number) == len(set(block)):
                break
            block = new
        base, kept = len(self.moves), {}
        for i, b in enumerate(block):
            kept.setdefault(b, i)
        order = {b: base + k for k, b in enumerate(kept)}
        for b, i in kept.items():
            self.moves.append({s: order[block[t]] for s, t in moves[i].items()})
            self.owner.append(name)
            self.accepting.append(end in found[i])
        self.start[name] = order[block[0]]

    def _insertions(self) -> None:
        """The least cost to end each rule from each state with nothing left to read."""
        cost = [0 if ok else _FAR for ok in self.accepting]
        changed = True
        while changed:
            changed = False
            for s, moves in enumerate(self.moves):
                for symbol, t in moves.items():
                    c = cost[t] + self._price(symbol, cost)
                    if c < cost[s]:
                        cost[s], changed = c, True
        self.price = {name: cost[self.start[name]] for name in self.names}
        self.inserted = []
        for moves in self.moves:
            best: dict[int, int] = {}
            for symbol, t in moves.items():
                best[t] = min(best.get(t, _FAR), self._price(symbol, cost))
            self.inserted.append([(t, c) for t, c in best.items() if c <= DROP])
        self.replaced = [list({t for t in words.values()}) for words in self.words]

    def _price(self, symbol: object, cost: list[int]) -> int:
        if isinstance(symbol, tuple):
            return min(_FAR, 2 + cost[self.start[symbol[1]]])
        return cost[self.start[symbol]] if symbol in self.start else 1

    def _firsts(self) -> None:
        self.first: dict[str, set] = {n: set() for n in self.names}
        changed = True
        while changed:
            changed = False
            for n in self.names:
                found = set()
                for symbol in self.moves[self.start[n]]:
                    found |= self.first[symbol] if isinstance(symbol, str) and symbol in self.start else {symbol}
                if not found <= self.first[n]:
                    self.first[n] |= found
                    changed = True

    # Groups ----------------------------------------------------------------------------------------------------------
    def group(self, bracket: str, costs: dict[str, int]) -> str:
        """The kind of a group whose content reads as each rule at a cost above the least one's."""
        known = {(bracket, rule): c for rule, c in costs.items() if c < GROUP}
        key = (bracket, *sorted(known.items()))
        kind = self._classes.get(key)
        if kind is None:
            kind = self._classes[key] = chr(0xF0000 + len(self._classes))
            self.readings[kind] = known
        return kind

    def _goals(self, s: int, kind: str) -> tuple[int, ...]:
        """The states after a token or group that stands where state ``s`` wants it."""
        known = self._next[s].get(kind)
        if known is None:
            if kind in self.readings:
                known = tuple(t for symbol, t in self.groups[s] if self.readings[kind].get(symbol) == 0)
            else:
                known = (self.words[s][kind],) if kind in self.words[s] else ()
            self._next[s][kind] = known
        return known

    def _may_open(self, rule: str, kind: str) -> bool:
        known = self._opens.get((rule, kind))
        if known is None:
            if kind in self.readings:
                known = any(self.readings[kind].get(f) == 0 for f in self.first[rule] if isinstance(f, tuple))
            else:
                known = kind in self.first[rule]
            self._opens[rule, kind] = known
        return known

    # Charts ----------------------------------------------------------------------------------------------------------
    def longest(self, kinds: str, at: int, rule: str) -> tuple[int, int]:
        """The end of the longest text of ``rule`` from ``at`` on (-1: none) and how far the chart had to look."""
        steps, owns, start, goals = self.steps, self.owns, self.start, self._goals
        best, pos, n = -1, at, len(kinds)
        waiting: dict[int, dict[str, list[tuple[int, int]]]] = {}
        items = [(start[rule], at)]
        while True:
            kind = kinds[pos] if pos < n else ""
            here: dict[str, list[tuple[int, int]]] = {}
            waiting[pos] = here
            seen, after = set(items), []
            for s, o in items:  # grows while it is read
                name = owns[s]
                if name is not None and o < pos:
                    if o == at and name == rule:
                        best = pos
                    for item in waiting[o].get(name, ()):
                        if item not in seen:
                            seen.add(item)
                            items.append(item)
                for name, t in steps[s]:
                    if name in here:
                        here[name].append((t, o))
                    else:
                        here[name] = [(t, o)]
                        if kind and self._may_open(name, kind):
                            item = (start[name], pos)
                            if item not in seen:
                                seen.add(item)
                                items.append(item)
                if kind:
                    for t in goals(s, kind):
                        after.append((t, o))
            if not after:
                return best, pos
            items = list(dict.fromkeys(after))
            pos += 1

    def reads(self, kinds: str, rule: str) -> bool:
        """Whether all of ``kinds`` is a text of ``rule``."""
        key = (rule, kinds)
        known = self._whole.get(key)
        if known is None:
            if len(self._whole) > MEMO:
                self._whole.clear()
            if rule not in self.lists:
                kinds = shortened(kinds)
            if rule in self.lists:
                known = not self.pieces(kinds, rule, True)[1]
            elif not kinds:
                known = self.accepting[self.start[rule]]
            else:
                known = self.longest(kinds, 0, rule)[0] == len(kinds)
            if len(kinds) <= LONG:
                self._whole[key] = known
        return known

    def pieces(self, kinds: str, rule: str, first: bool = False) -> tuple[list[int], list[tuple[int, int]]]:
        """Cuts a list of statements: where they begin, and from where to where no statement can be read.

        A statement is as long as it can be; one that can't be read ends where a statement would (``;``, a brace group).
        ``first`` stops at the first that can't.
        """
        element = self.lists[rule]
        kinds += self.end_mark
        starts, bad, at, n = [], [], 0, len(kinds)
        semicolon = self.codes.get(";", "")
        while at < n - len(self.end_mark):
            starts.append(at)
            end, look = -1, 0
            for stop in range(at, min(n, at + 400)):  # known statements are looked up by their text and the kind after it
                if kinds[stop] == semicolon or kinds[stop] >= "\U000f0000" or kinds[stop] == self.end_mark:
                    known = self._cuts.get((element, kinds[at : stop + 2]))
                    if known is not None:
                        end = at + known
                        break
            if end < 0:
                end, look = self.longest(kinds, at, element)
                if end > 0 and look <= end:
                    if len(self._cuts) > MEMO:
                        self._cuts.clear()
                    self._cuts[element, kinds[at : end + 1]] = end - at
            if end < 0:
                end = self._stop(kinds, at, look)
                bad.append((at, min(end, n - len(self.end_mark))))
                if first:
                    break
            at = end
        return starts, bad

    def _stop(self, kinds: str, at: int, look: int) -> int:
        semicolon = self.codes.get(";", "")
        for i in range(max(at, look - 1), len(kinds)):
            kind = kinds[i]
            if kind == semicolon or kind in self.readings and next(iter(self.readings[kind] or [("", "")]))[0] in ("{", "<"):
                return i + 1
        return len(kinds)

    def least(self, kinds: str, rule: str, limit: int) -> int:
        """The least cost of edits that make ``kinds`` a text of ``rule``, ``limit`` if it isn't less."""
        if rule in self.lists:
            return self._least_list(kinds, rule, limit)
        kinds = shortened(kinds)
        key = (rule, kinds)
        known = self._costs.get(key)  # a cost, or -b if it is known to be b or more
        if known is not None and (known >= 0 or -known >= limit):
            return min(limit, abs(known))
        if len(self._costs) > MEMO:
            self._costs.clear()
        if self.reads(kinds, rule):
            self._costs[key] = 0
            return 0
        for bound in range(max(1, -(known or 0)), limit):
            cost = self._chart(kinds, rule, bound)
            if cost <= bound:
                self._costs[key] = cost
                return cost
        self._costs[key] = -limit
        return limit

    def _least_list(self, kinds: str, rule: str, limit: int) -> int:
        cost = 0
        for a, b in self.pieces(kinds, rule)[1]:
            cost += self.statement(kinds[a:b], rule)
            if cost >= limit:
                return limit
        return cost

    def statement(self, kinds: str, rule: str) -> int:
        """The cost to mend a piece of a list of statements; DROP if it takes as much."""
        return self.least(kinds + self.end_mark, self.lists[rule] + "ELEMENTS", DROP)

    def _chart(self, kinds: str, rule: str, bound: int) -> int:
        """Earley's chart with edits, up to ``bound``: an item is a state and where its constituent began, with its least cost.

        Columns are filled from left to right, each in order of the cost of the whole text up to there, which is what
        the bound is put to.
        """
        steps, owns, start, owner, readings, price = self.steps, self.owns, self.start, self.owner, self.readings, self.price
        n = len(kinds)
        before: list[dict[str, int]] = [{} for _ in range(n + 1)]  # least cost of the text before a constituent that begins here
        before[0][rule] = 0
        waiting: list[dict[str, list[tuple[int, int, int]]]] = []
        coming: dict[tuple[int, int], int] = {(start[rule], 0): 0}
        root = start[rule]
        for pos in range(n + 1):
            heap: list[list[tuple[int, int, int]]] = [[] for _ in range(bound + 1)]
            for (s, o), c in coming.items():
                heap[before[o][owner[s]] + c].append((s, o, c))
            coming, done = {}, {}
            here: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
            opened = before[pos]
            kind = kinds[pos] if pos < n else ""
            group = readings.get(kind)
            drop = GROUP if group is not None else 1
            for total in range(bound + 1):
                for s, o, c in heap[total]:  # grows while it is read
                    if (s, o) in done:
                        continue
                    done[s, o] = c
                    room = bound - total
                    name = owns[s]
                    if name is not None and o < pos:
                        for t, p, d in waiting[o].get(name, ()):
                            g = before[p][owner[t]] + d + c
                            if g <= bound and (t, p) not in done:
                                heap[g].append((t, p, d + c))
                    for name, t in steps[s]:
                        here[name].append((t, o, c))
                        if name not in opened:
                            opened[name] = total
                            heap[total].append((start[name], pos, 0))
                    if room:
                        for t, d in self.inserted[s]:
                            if d <= room and (t, o) not in done:
                                heap[total + d].append((t, o, c + d))
                    if kind:
                        for t in self._goals(s, kind):
                            if coming.get((t, o), _FAR) > c:
                                coming[t, o] = c
                        if room:
                            if group is None:
                                for t in self.replaced[s]:
                                    if coming.get((t, o), _FAR) > c + 1:
                                        coming[t, o] = c + 1
                            else:
                                for symbol, t in self.groups[s]:
                                    d = group.get(symbol, GROUP)
                                    if 0 < d <= room and coming.get((t, o), _FAR) > c + d:
                                        coming[t, o] = c + d
                            if drop <= room and (o < pos or s == root) and coming.get((s, o), _FAR) > c + drop:
                                coming[s, o] = c + drop
            waiting.append(here)
            if not coming and pos < n:
                return bound + 1
        ends = [c for (s, o), c in done.items() if o == 0 and owns[s] == rule]
        return min([*ends, *([price[rule]] if not n else []), bound + 1])
