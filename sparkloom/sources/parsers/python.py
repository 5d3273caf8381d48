"""Symbols and imports of Python, from the syntax tree; of broken files, from the lines that still tell."""

from __future__ import annotations

import ast
import re
import warnings

from sparkloom.sources.parsers.model import Import, Parsed, Symbol, parameter


class _Spans:
    """Byte offsets of (line, byte column) places."""

    def __init__(self, source: bytes):
        self.source = source
        self.starts = [0]
        for i, b in enumerate(source):
            if b == 10:
                self.starts.append(i + 1)

    def text(self, node) -> str | None:
        """The source of a node as it is written."""
        if node is None:
            return None
        a, b, *_ = self.of(node)
        return self.source[a:b].decode("utf-8", "replace")

    def of(self, node) -> tuple[int, int, int, int]:
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset, node.lineno - 1, node.end_lineno - 1


def _parameters(a: ast.arguments, text) -> list[dict]:
    positional = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(positional) - len(a.defaults)) + list(a.defaults)
    out = [parameter(p.arg, text(p.annotation), text(d)) for p, d in zip(positional, defaults)]
    if a.vararg:
        out.append(parameter("*" + a.vararg.arg, text(a.vararg.annotation)))
    out += [parameter(p.arg, text(p.annotation), text(d)) for p, d in zip(a.kwonlyargs, a.kw_defaults)]
    if a.kwarg:
        out.append(parameter("**" + a.kwarg.arg, text(a.kwarg.annotation)))
    return out


def _shown(p: dict) -> str:
    return p["name"] + (f": {p['type_annotation']}" if p["type_annotation"] else "") + (f" = {p['default_value']}" if p["default_value"] else "")


def _walk(body, spans: _Spans, parent: str | None, out: Parsed) -> None:
    for n in body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            ps = _parameters(n.args, spans.text)
            returns = spans.text(n.returns)
            signature = f"{'async ' if isinstance(n, ast.AsyncFunctionDef) else ''}def {n.name}({', '.join(map(_shown, ps))})" + (f" -> {returns}" if returns else "")
            out.symbols.append(Symbol(n.name, "method" if parent else "function", *spans.of(n), signature, ast.get_docstring(n), returns, parent, ps, [spans.text(d) for d in n.decorator_list], is_exported=not n.name.startswith("_")))
        elif isinstance(n, ast.ClassDef):
            bases = ", ".join(map(spans.text, n.bases))
            out.symbols.append(Symbol(n.name, "class", *spans.of(n), f"class {n.name}" + (f"({bases})" if bases else ""), ast.get_docstring(n), None, parent, [], [spans.text(d) for d in n.decorator_list], is_exported=not n.name.startswith("_")))
            _walk(n.body, spans, n.name, out)
        elif parent is None and isinstance(n, ast.Import):
            out.imports += [Import(a.name, [], a.asname) for a in n.names]
        elif parent is None and isinstance(n, ast.ImportFrom):
            out.imports.append(Import("." * n.level + (n.module or ""), [a.name for a in n.names], n.names[0].asname if len(n.names) == 1 else None, n.level > 0))


_DEF = re.compile(rb"(?m)^([ \t]*)(async[ \t]+def|def|class)[ \t]+(\w+)[ \t]*([^\n:]*)")
_IMPORT = re.compile(rb"(?m)^(?:import[ \t]+([\w.]+)(?:[ \t]+as[ \t]+(\w+))?|from[ \t]+([\w.]+)[ \t]+import[ \t]+([^\n#(]+))")


def _by_lines(source: bytes, out: Parsed) -> None:
    """Definitions by their lines; a definition ends before the next line that is indented no deeper."""
    lines = source.split(b"\n")
    starts, at = [], 0
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    stack: list[tuple[int, str]] = []
    for m in _DEF.finditer(source):
        depth = len(m[1].expandtabs(4))
        first = source.count(b"\n", 0, m.start())
        last = first
        for i in range(first + 1, len(lines)):
            if lines[i].strip() and len(lines[i].expandtabs(4)) - len(lines[i].expandtabs(4).lstrip()) <= depth:
                break
            if lines[i].strip():
                last = i
        while stack and stack[-1][0] >= depth:
            stack.pop()
        name, parent = m[3].decode("utf-8", "replace"), stack[-1][1] if stack else None
        is_class = m[2] == b"class"
        if is_class or depth == 0 or parent:
            out.symbols.append(Symbol(name, "class" if is_class else "method" if parent else "function", starts[first] + len(m[1]), starts[last] + len(lines[last]), first, last, m[0].decode("utf-8", "replace").strip(), parent=parent, is_exported=not name.startswith("_")))
        if is_class:
            stack.append((depth, name))
    for m in _IMPORT.finditer(source):
        if m[1]:
            out.imports.append(Import(m[1].decode(), [], m[2].decode() if m[2] else None))
        else:
            module = m[3].decode()
            out.imports.append(Import(module, [x.split()[0] for x in m[4].decode("utf-8", "replace").split(",") if x.strip()], None, module.startswith(".")))


def extract(path: str, source: bytes) -> Parsed:
    out = Parsed()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        out.has_syntax_errors = True
        line = getattr(e, "lineno", None) or 1
        text = source.split(b"\n")[line - 1 : line]
        out.errors.append(f"line {line}: {text[0].decode('utf-8', 'replace').strip()[:120] if text else ''}")
        _by_lines(source, out)
        return out
    _walk(tree.body, _Spans(source), None, out)
    return out
