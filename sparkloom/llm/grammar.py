"""Grammars over token classes, and what is derived from them.

A grammar is written as productions with regular right sides. Terminals are token classes, written in quotes or as the names
of ``SPECIAL``; names in capitals stand for a bracket group of one reading of its contents, as ``groups`` gives it; other names are
productions. From a grammar come (a) the pairs of adjacent tokens that it permits, by first and last sets, and (b) patterns
over strings in which each token is one character and each bracket group that was already reduced is one character that tells
its possible readings. Choices are ordered and committed to, as in a parsing expression grammar.
"""

from __future__ import annotations

from functools import lru_cache

import regex

#: First character for terminals, and for reduced groups: GROUP + 512 * kind of bracket + mask of readings; the kind after the last is a segment.
TERMINAL, GROUP = 0x100, 0xF0000
#: The last kind are blocks by indentation, whose brackets the lexer makes.
OPEN, CLOSE = "([{«", ")]}»"
SEGMENT = len(OPEN)
_LEX = regex.compile(r"\s*(?:'([^'\s]+)'|([A-Za-z_]\w*)|([()|?*+!&$]))")


class Grammar:
    """productions: name -> right side. groups: name in capitals -> (opening bracket, right side of the contents)."""

    def __init__(self, productions: str, groups: str, segments: str = "", ends: str = ";", start: str = "start"):
        self.rules = dict(self._lines(productions))
        self.segments, self.ends = dict(self._lines(segments)) if segments else {}, ends
        self.groups: dict[str, tuple[str, str]] = {}
        for name, side in self._lines(groups):
            self.groups[name] = side[0], side[1:]
        self.start, self.terminals = start, {}
        for t in OPEN + CLOSE:
            self.char(t)
        for t in ends:
            self.char(t)
        self.trees = {n: self._parse(s) for n, s in self.rules.items()}
        self.parts = {n: self._parse(s) for n, s in self.segments.items()}
        self.inner = {n: self._parse(s) for n, (_, s) in self.groups.items()}
        self.bits = {}
        for o in OPEN:
            for i, n in enumerate(n for n, (b, _) in self.groups.items() if b == o):
                self.bits[n] = i
        self.bits |= {n: i for i, n in enumerate(self.segments)}

    @staticmethod
    def _lines(text: str):
        for part in regex.split(r"\n(?=\w+:)", text.strip()):
            name, _, side = part.partition(":")
            yield name.strip(), side.strip()

    def char(self, terminal: str) -> str:
        return self.terminals.setdefault(terminal, chr(TERMINAL + len(self.terminals)))

    def _parse(self, side: str):
        tokens, at = [], 0
        side = side.rstrip()
        while at < len(side):
            m = _LEX.match(side, at)
            if not m:
                raise ValueError(f"{side[at:at + 20]!r}")
            tokens.append(("t", m[1]) if m[1] else ("n", m[2]) if m[2] else ("o", m[3]))
            at = m.end()
        pos = 0

        def alt():
            nonlocal pos
            options = [seq()]
            while pos < len(tokens) and tokens[pos] == ("o", "|"):
                pos += 1
                options.append(seq())
            return ("alt", options) if len(options) > 1 else options[0]

        def seq():
            nonlocal pos
            items = []
            while pos < len(tokens) and tokens[pos] not in (("o", "|"), ("o", ")")):
                kind, v = tokens[pos]
                pos += 1
                if (kind, v) in (("o", "!"), ("o", "&")):
                    items.append(("look", v, atom()))
                    continue
                pos -= 1
                items.append(atom())
            return ("seq", items)

        def atom():
            nonlocal pos
            kind, v = tokens[pos]
            pos += 1
            if kind == "o" and v == "(":
                node = alt()
                pos += 1
            elif kind == "o" and v == "$":
                node = ("end",)
            elif kind == "t":
                self.char(v)
                node = ("t", v)
            else:
                node = ("n", v)
            while pos < len(tokens) and tokens[pos][0] == "o" and tokens[pos][1] in "?*+":
                node = ("rep", tokens[pos][1], node)
                pos += 1
            return node

        return alt()

    # Patterns.
    def _group_class(self, name: str) -> str:
        bit = self.bits[name]
        base = GROUP + 512 * (SEGMENT if name in self.segments else OPEN.index(self.groups[name][0]))
        return "[" + "".join(chr(base + m) for m in range(512) if m >> bit & 1) + "]"

    def _pattern(self, node, used: set[str]) -> str:
        kind = node[0]
        if kind == "t":
            return regex.escape(self.char(node[1]))
        if kind == "n":
            if node[1] in self.groups or node[1] in self.segments:
                return self._group_class(node[1])
            if node[1] not in self.rules:
                raise KeyError(node[1])
            used.add(node[1])
            return f"(?&{node[1]})"
        if kind == "end":
            return r"\Z"
        if kind == "look":
            return ("(?!" if node[1] == "!" else "(?=") + self._pattern(node[2], used) + ")"
        if kind == "rep":
            return "(?:" + self._pattern(node[2], used) + ")" + node[1] + "+"
        if kind == "seq":
            return "".join(self._pattern(x, used) for x in node[1])
        return "(?>" + "|".join(self._pattern(x, used) for x in node[1]) + ")"

    def _compile(self, tree) -> regex.Pattern:
        used, defined = set(), {}
        main = self._pattern(tree, used)
        while used - defined.keys():
            n = min(used - defined.keys())
            more: set[str] = set()
            defined[n] = self._pattern(self.trees[n], more)
            used |= more
        define = "".join(f"(?P<{n}>(?>{p}))" for n, p in defined.items())
        return regex.compile(f"(?(DEFINE){define}){main}\\Z")

    @property
    def matchers(self) -> dict:
        """The compiled patterns: of the start, and of each opening bracket a list of (bit, pattern)."""
        if not hasattr(self, "_matchers"):
            self._matchers = {"start": self._compile(self.trees[self.start])} | {o: [(self.bits[n], self._compile(self.inner[n])) for n, (b, _) in self.groups.items() if b == o] for o in OPEN} | {"segment": [(self.bits[n], self._compile(t)) for n, t in self.parts.items()]}
        return self._matchers

    # First and last sets and the pairs.
    @lru_cache(maxsize=1)  # noqa: B019
    def pairs(self) -> frozenset[tuple[str, str]]:
        """The pairs of terminals that can be adjacent."""
        # A segment is a shorthand for tokens that its neighbours in the productions derive as well, so it adds no pairs.
        info = {n: [False, set(), set()] for n in [*self.trees, *self.groups, *self.segments]}
        for n, (o, _) in self.groups.items():
            info[n] = [False, {o}, {CLOSE[OPEN.index(o)]}]
        found: set[tuple[str, str]] = set()

        def walk(node):
            """(may be empty, first, last); notes the pairs inside."""
            kind = node[0]
            if kind == "t":
                return False, {node[1]}, {node[1]}
            if kind == "n":
                return tuple(info[node[1]])
            if kind in ("end", "look"):
                return True, set(), set()
            if kind == "rep":
                empty, first, last = walk(node[2])
                if node[1] != "?":
                    found.update((a, b) for a in last for b in first)
                return empty or node[1] != "+", first, last
            if kind == "alt":
                parts = [walk(x) for x in node[1]]
                return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
            empty, first, last = True, set(), set()
            for x in node[1]:
                e, f, la = walk(x)
                found.update((a, b) for a in last for b in f)
                if empty:
                    first = first | f
                last = la | (last if e else set())
                empty = empty and e
            return empty, first, last

        size = -1
        while size != len(found) + sum(len(v[1]) + len(v[2]) + v[0] for v in info.values()):
            size = len(found) + sum(len(v[1]) + len(v[2]) + v[0] for v in info.values())
            for n, tree in self.trees.items():
                e, f, la = walk(tree)
                info[n] = [e, info[n][1] | f, info[n][2] | la]
            for n, tree in self.inner.items():
                o = self.groups[n][0]
                c = CLOSE[OPEN.index(o)]
                e, f, la = walk(tree)
                found.update((o, x) for x in f)
                found.update((x, c) for x in la)
                if e:
                    found.add((o, c))
        return frozenset(found)


class Reducer:
    """Recognises strings of a grammar's terminals by reducing windows of them, innermost first.

    A bracket group becomes the character of its readings. In braces and at the outermost level, segments up to the end of a
    statement are reduced before that. Readings of windows are remembered, since most code repeats few forms.
    """

    def __init__(self, g: Grammar, most: int = 200_000):
        self.g, self.most = g, most
        self.memo: dict[str, str] = {}
        self.seen: dict[str, str] = {}
        self.bodies: dict[str, int] = {}
        self.bad = self.crossed = False
        o, c = "".join(map(g.char, OPEN)), "".join(map(g.char, CLOSE))
        self.pair = {g.char(x): g.char(CLOSE[OPEN.index(x)]) for x in OPEN}
        self.kind = {g.char(x): OPEN.index(x) for x in OPEN}
        self.inner, self.any = regex.compile(f"[{o}][^{o}{c}]*+[{c}]"), regex.compile(f"[{o}{c}]")
        ends = "".join(map(g.char, g.ends))
        self.segment = regex.compile(f"[^{ends}]*+[{ends}]")
        # A list of many literals reads as a list of two.
        lit = "".join(g.terminals[t] for t in ("num", "str") if t in g.terminals)
        comma = g.char(",")
        sign = regex.escape(g.terminals["-"]) + "?" if "-" in g.terminals else ""
        self.list = regex.compile(f"({sign}[{lit}]{comma})(?:{sign}[{lit}]{comma}){{2,}}+")
        self.short = r"\1\1"

    def _segments(self, body: str) -> str:
        """The body with its segments reduced, or as it is if one of them has no reading."""
        if not self.g.segments:
            return body
        seen, out, at = self.seen, [], 0
        for m in self.segment.finditer(body):
            text = m[0]
            at = m.end()
            r = seen.get(text)
            if r is None:
                mask = 0
                for bit, p in self.g.matchers["segment"]:
                    if p.match(text):
                        mask |= 1 << bit
                r = chr(GROUP + 512 * SEGMENT + mask) if mask else ""
                if len(seen) > self.most:
                    seen.clear()
                seen[text] = r
            if not r:
                return body
            if not out or out[-1] != r:
                out.append(r)
        return "".join(out) + body[at:]

    def _readings(self, kind: int, body: str) -> int:
        key = OPEN[kind] + body
        mask = self.bodies.get(key)
        if mask is None:
            mask = 0
            for bit, p in self.g.matchers[OPEN[kind]]:
                if p.match(body):
                    mask |= 1 << bit
            if len(self.bodies) > self.most:
                self.bodies.clear()
            self.bodies[key] = mask
        return mask

    def _group(self, m) -> str:
        text = m[0]
        r = self.memo.get(text)
        if r is None:
            kind = self.kind[text[0]]
            mask = 0
            if self.pair[text[0]] != text[-1]:
                self.crossed = True
            else:
                whole = text[1:-1]
                body = self._segments(whole) if kind >= 2 else whole
                mask = self._readings(kind, body)
                if not mask and body != whole:  # a statement that goes on after the end of a segment, as with else
                    mask = self._readings(kind, whole)
            r = chr(GROUP + 512 * kind + mask) if mask else ""
            if len(self.memo) > self.most:
                self.memo.clear()
            if not self.crossed:
                self.memo[text] = r
        if not r:
            self.bad = True
        return r

    def rejects(self, s: str) -> str | None:
        """Why the grammar does not derive the string of terminals: nesting or structure; None if it does."""
        self.bad = self.crossed = False
        s = self.list.sub(self.short, s)
        while True:
            s, n = self.inner.subn(self._group, s)
            if self.bad:
                return "nesting" if self.crossed else "structure"
            if not n:
                break
        if self.any.search(s):
            return "nesting"
        short = self._segments(s)
        p = self.g.matchers["start"]
        return None if p.match(short) is not None or short != s and p.match(s) is not None else "structure"

    def accepts(self, s: str) -> bool:
        """Whether the grammar derives the string of terminals."""
        return self.rejects(s) is None
