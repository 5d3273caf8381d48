"""Symbols and imports of languages with braces: JavaScript, TypeScript, Go and Rust.

A scanner blanks comments and strings out of a copy of the source, so that braces pair up; declarations are then found at the
depths at which a language has them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from sparkloom.sources.parsers.model import Import, Parsed, Symbol, parameter

_SKIP = {
    "js": re.compile(rb"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S),
    "go": re.compile(rb"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)'", re.S),
    "rust": re.compile(rb"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|b?r(#*)\".*?\"\1|b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\.[^']{0,8})'", re.S),
}


class Source:
    """A source with a copy in which only code is left, and the partner of each brace."""

    def __init__(self, source: bytes, family: str):
        self.source = source
        self.code = _SKIP[family].sub(lambda m: re.sub(rb"[^\n]", b" ", m[0]), source)
        self.partner: dict[int, int] = {}
        self.depth_at: list[tuple[int, int]] = []
        self.line_ends: list[int] | None = None
        self.balanced = True
        stack = []
        for m in re.finditer(rb"[{}]", self.code):
            if m[0] == b"{":
                stack.append(m.start())
            elif stack:
                self.partner[stack.pop()] = m.start()
            else:
                self.balanced = False
        self.balanced = self.balanced and not stack

    def text(self, a: int, b: int) -> str:
        return self.source[a:b].decode("utf-8", "replace")

    def line(self, at: int) -> int:
        """Line ends before a place, from a table made once."""
        if self.line_ends is None:
            self.line_ends = [m.start() for m in re.finditer(rb"\n", self.source)]
        return bisect_left(self.line_ends, at)

    def close(self, at: int, opening: bytes = b"(", closing: bytes = b")") -> int:
        """The end of the bracket group that opens at a place."""
        level = 0
        for m in re.compile(re.escape(opening) + b"|" + re.escape(closing)).finditer(self.code, at):
            level += 1 if m[0] == opening else -1
            if not level:
                return m.end()
        return len(self.code)

    def body(self, at: int) -> tuple[int, int] | None:
        """The block after a place, if it comes before the statement ends."""
        m = re.compile(rb"[{;]").search(self.code, at)
        if not m or m[0] == b";" or m.start() not in self.partner:
            return None
        return m.start(), self.partner[m.start()] + 1

    def comment_before(self, at: int) -> str | None:
        """The comment lines or the block comment directly before a declaration."""
        lines, out = self.text(0, self.source.rfind(b"\n", 0, at) + 1).split("\n")[:-1], []
        for x in reversed(lines):
            x = x.strip()
            if x.startswith(("//", "*", "/*")):
                out.append(x)
                if x.startswith("/*"):
                    break
            elif not (x.startswith(("#[", "@")) and not out):
                break
        text = "\n".join(re.sub(r"^(?:/{2,}!?|/\*+|\*+(?!/))\s?|\*/$", "", x).strip() for x in reversed(out)).strip()
        return text or None

    def symbol(self, name: str, kind: str, start: int, end: int, head: int, **more) -> Symbol:
        return Symbol(name, kind, start, end, self.line(start), self.line(max(start, end - 1)), " ".join(self.text(start, head).split()).rstrip("{ "), self.comment_before(start), **more)


def split_list(text: str) -> list[str]:
    """The parts between commas that are in no bracket."""
    parts, level, now = [], 0, ""
    for c in text:
        level += (c in "([{<") - (c in ")]}>")
        if c == "," and level <= 0:
            parts.append(now)
            now = ""
        else:
            now += c
    return [p.strip() for p in [*parts, now] if p.strip()]


def _js_parameters(text: str) -> list[dict]:
    out = []
    for p in split_list(text):
        left, _, default = p.partition("=") if "=>" not in p else (p, "", "")
        name, _, annotation = left.partition(":")
        name, annotation = name.strip(), annotation.strip() or None
        if name.endswith("?"):
            name, annotation = name[:-1], f"{annotation or 'any'} | undefined"
        out.append(parameter(re.sub(r"^(?:public|private|protected|readonly)\s+", "", name), annotation, default.strip() or None))
    return out


_JS_DECL = re.compile(
    rb"(?m)(?P<export>\bexport[ \t]+(?:default[ \t]+)?)?(?:\bdeclare[ \t]+)?(?:(?P<fn>(?:async[ \t]+)?function[ \t]*\*?)[ \t]*(?P<fname>[\w$]+)|(?:abstract[ \t]+)?\b(?P<class>class)[ \t]+(?P<cname>[\w$]+)|\b(?P<iface>interface)[ \t]+(?P<iname>[\w$]+)|\b(?P<enum>enum)[ \t]+(?P<ename>[\w$]+)|\btype[ \t]+(?P<tname>[\w$]+)[^=;\n]*=|\b(?:const|let|var)[ \t]+(?P<vname>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?P<arrow>(?:async[ \t]*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)[ \t]*(?::[^=\n{]+)?=>|[\w$]+[ \t]*=>)))"
)
_JS_METHOD = re.compile(rb"(?m)^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)[ \t]+)*\*?(?P<name>#?[\w$]+)[ \t]*(?:<[^>(]*>)?\(")
_JS_IMPORT = re.compile(rb"(?ms)^[ \t]*import\b(?P<clause>[^'\";]*?)(?:\bfrom\b)?[ \t]*['\"](?P<module>[^'\"\n]+)['\"]|\brequire\([ \t]*['\"](?P<required>[^'\"\n]+)['\"]")
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "constructor_"}


def javascript(path: str, source: bytes) -> Parsed:
    s, out = Source(source, "js"), Parsed()
    tops = _top_level(s)
    for m in _JS_DECL.finditer(s.code):
        if not tops(m.start()):
            continue
        exported = bool(m["export"])
        if m["fn"] or m["arrow"]:
            name = (m["fname"] or m["vname"]).decode()
            at = s.code.find(b"(", m.end("fname") if m["fn"] else m.start("arrow"))
            close = s.close(at) if at >= 0 else m.end()
            block = s.body(close if m["fn"] else m.end("arrow"))
            end = block[1] if block else (s.code.find(b"\n", m.end()) + len(s.code) + 1) % (len(s.code) + 1)
            returns = re.match(r"\s*:\s*([^{=]+)", s.text(close, (block or (end,))[0]))
            out.symbols.append(s.symbol(name, "function", m.start(), end, block[0] if block else end, return_type=returns[1].strip() if returns else None, parameters=_js_parameters(s.text(at + 1, close - 1)) if 0 <= at < end else [], is_exported=exported))
        elif m["tname"]:
            end = s.code.find(b";", m.end())
            end = end + 1 if end >= 0 else len(source)
            out.symbols.append(s.symbol(m["tname"].decode(), "type_alias", m.start(), end, end, is_exported=exported))
        else:
            kind = "class" if m["class"] else "interface" if m["iface"] else "enum"
            name = (m["cname"] or m["iname"] or m["ename"]).decode()
            block = s.body(m.end())
            if not block:
                continue
            out.symbols.append(s.symbol(name, kind, m.start(), block[1], block[0], is_exported=exported))
            if kind == "class":
                _js_methods(s, name, block, out)
    for m in _JS_IMPORT.finditer(source):
        module = (m["module"] or m["required"]).decode("utf-8", "replace")
        clause = (m["clause"] or b"").decode("utf-8", "replace")
        named = re.search(r"\{([^}]*)\}", clause)
        default = re.match(r"\s*(?:type\s+)?([\w$]+)", clause.split("{")[0])
        names = ([default[1]] if default else []) + [x.split(" as ")[0].replace("type ", "").strip() for x in split_list(named[1])] if named or default else []
        star = re.search(r"\*\s*as\s+([\w$]+)", clause)
        out.imports.append(Import(module, [n for n in names if n], star[1] if star else None, module.startswith(".")))
    _flag(s, out)
    return out


def _top_level(s: Source):
    """A test whether a place is in no block."""
    spans = []
    for a, b in sorted(s.partner.items()):
        if not spans or a > spans[-1][1]:
            spans.append((a, b))
    starts = [a for a, _ in spans]

    def test(at: int) -> bool:
        i = bisect_right(starts, at) - 1
        return i < 0 or at > spans[i][1]

    return test


def _js_methods(s: Source, parent: str, block: tuple[int, int], out: Parsed) -> None:
    at = block[0] + 1
    while True:
        m = _JS_METHOD.search(s.code, at, block[1])
        if not m:
            return
        close = s.close(m.end() - 1)
        body = s.body(close)
        name = m["name"].decode()
        if name in _NOT_METHODS or not body or body[1] > block[1]:
            at = m.end()
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        returns = re.match(r"\s*:\s*([^{]+)", s.text(close, body[0]))
        out.symbols.append(s.symbol(name, "method", start, body[1], body[0], parent=parent, return_type=returns[1].strip() if returns else None, parameters=_js_parameters(s.text(m.end(), close - 1)), is_exported=not name.startswith("#")))
        at = body[1]


_GO_FUNC = re.compile(rb"(?m)^func[ \t]*(?:\([ \t]*(?:\w+[ \t]+)?\*?(?P<recv>\w+)[^)]*\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?\(")
_GO_TYPE = re.compile(rb"(?m)^type[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*=?[ \t]*(?P<what>struct|interface)?")
_GO_VALUE = re.compile(rb"(?m)^(?P<kind>const|var)[ \t]+(?P<name>\w+)")
_GO_IMPORT = re.compile(r'(?m)^\s*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?"(?P<module>[^"\n]+)"')


def go(path: str, source: bytes) -> Parsed:
    s, out = Source(source, "go"), Parsed()
    for m in _GO_FUNC.finditer(s.code):
        close = s.close(m.end() - 1)
        block = s.body(close)
        end = block[1] if block else close
        name, recv = m["name"].decode(), m["recv"].decode() if m["recv"] else None
        ps = [parameter(*(p.split(None, 1) + [None])[:2]) for p in split_list(s.text(m.end(), close - 1))]
        returns = s.text(close, block[0]).strip() if block else ""
        out.symbols.append(s.symbol(name, "method" if recv else "function", m.start(), end, block[0] if block else end, parent=recv, return_type=returns or None, parameters=ps, is_exported=name[:1].isupper()))
    for m in _GO_TYPE.finditer(s.code):
        block = s.body(m.end()) if m["what"] else None
        end = block[1] if block else (s.code.find(b"\n", m.end()) + len(source) + 1) % (len(source) + 1)
        name = m["name"].decode()
        out.symbols.append(s.symbol(name, {b"struct": "struct", b"interface": "interface"}.get(m["what"], "type_alias"), m.start(), end, block[0] if block else end, is_exported=name[:1].isupper()))
    for m in _GO_VALUE.finditer(s.code):
        end = (s.code.find(b"\n", m.end()) + len(source) + 1) % (len(source) + 1)
        name = m["name"].decode()
        out.symbols.append(s.symbol(name, "constant" if m["kind"] == b"const" else "variable", m.start(), end, end, is_exported=name[:1].isupper()))
    for m in re.finditer(rb"(?ms)^import[ \t]*(?:\((.*?)^[ \t]*\)|([^\n(]+))", source):
        for x in _GO_IMPORT.finditer((m[1] or m[2]).decode("utf-8", "replace")):
            out.imports.append(Import(x["module"], [], x["alias"]))
    out.symbols.sort(key=lambda x: (x.start_byte, -x.end_byte))
    _flag(s, out)
    return out


_RUST_ITEM = re.compile(rb"(?m)(?P<vis>\bpub(?:\([^)]*\))?[ \t]+)?(?:(?P<fn>(?:const[ \t]+|async[ \t]+|unsafe[ \t]+|extern[ \t]+)*\bfn)[ \t]+(?P<fname>\w+)|\b(?P<kind>struct|enum|trait|union)[ \t]+(?P<name>\w+)|\b(?P<impl>impl)\b[^{;\n]*?(?:\bfor[ \t]+)?(?:[\w:]+::)?(?P<iname>\w+)[ \t]*(?:<[^{;]*>)?[ \t]*(?:where[^{]*)?(?=\{))")


def rust(path: str, source: bytes) -> Parsed:
    s, out = Source(source, "rust"), Parsed()

    def items(lo: int, hi: int, parent: str | None) -> None:
        at = lo
        while True:
            m = _RUST_ITEM.search(s.code, at, hi)
            if not m:
                return
            if m["impl"]:
                block = s.body(m.end() - 1)
                if block and block[1] <= hi:
                    items(block[0] + 1, block[1] - 1, m["iname"].decode())
                    at = block[1]
                else:
                    at = m.end()
                continue
            if m["fn"]:
                opening = s.code.find(b"(", m.end())
                close = s.close(opening) if opening >= 0 else m.end()
                block = s.body(close)
                end = block[1] if block else s.code.find(b";", close) + 1 or hi
                ps = [parameter(*[x.strip() for x in (p.split(":", 1) + [""])[:2]]) for p in split_list(s.text(opening + 1, close - 1))]
                returns = re.match(r"\s*->\s*([^{;]+?)\s*(?:where\b.*)?$", s.text(close, block[0] if block else end).rstrip(";"), re.S)
                out.symbols.append(s.symbol(m["fname"].decode(), "method" if parent else "function", m.start(), end, block[0] if block else end, parent=parent, return_type=returns[1].strip() if returns else None, parameters=ps, is_exported=bool(m["vis"])))
                at = max(end, m.end())
            else:
                block = s.body(m.end())
                end = block[1] if block else s.code.find(b";", m.end()) + 1 or hi
                kind = {b"struct": "struct", b"enum": "enum", b"trait": "interface", b"union": "struct"}[m["kind"]]
                out.symbols.append(s.symbol(m["name"].decode(), kind, m.start(), end, block[0] if block else end, parent=parent, is_exported=bool(m["vis"])))
                at = max(end, m.end())

    items(0, len(s.code), None)
    for m in re.finditer(rb"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([^;]+);", s.code):
        text = " ".join(m[1].decode("utf-8", "replace").split())
        head, brace, rest = text.partition("::{")
        if brace:
            out.imports.append(Import(head, [x.split(" as ")[0] for x in split_list(rest.rsplit("}", 1)[0])], None, head.startswith(("self", "super"))))
        else:
            head, _, alias = text.partition(" as ")
            module, _, name = head.rpartition("::")
            out.imports.append(Import(head, [name] if module else [], alias or None, head.startswith(("self", "super"))))
    _flag(s, out)
    return out


def _flag(s: Source, out: Parsed) -> None:
    if not s.balanced:
        out.has_syntax_errors = True
        out.errors.append("braces do not pair up")
