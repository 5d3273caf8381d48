"""What an extractor returns for one file."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass
class Symbol:
    name: str
    kind: str
    start_byte: int
    end_byte: int
    start_line: int
    end_line: int
    signature: str | None = None
    docstring: str | None = None
    return_type: str | None = None
    parent: str | None = None
    parameters: list[dict] = field(default_factory=list)
    decorators: list[str] = field(default_factory=list)
    children: list[str] = field(default_factory=list)
    is_exported: bool = True


@dataclass
class Import:
    module: str
    imported_names: list[str] = field(default_factory=list)
    alias: str | None = None
    is_relative: bool = False


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    has_syntax_errors: bool = False
    errors: list[str] = field(default_factory=list)

    def rows(self) -> dict:
        children: dict[str, list[str]] = {}
        for s in self.symbols:
            if s.parent:
                children.setdefault(s.parent, []).append(s.name)
        for s in self.symbols:
            if s.kind in CONTAINERS and not s.children:
                s.children = children.get(s.name, [])
        return {"symbols": [asdict(s) for s in self.symbols], "imports": [asdict(i) for i in self.imports], "has_syntax_errors": self.has_syntax_errors, "errors": self.errors}


CONTAINERS = ("class", "interface", "struct", "enum", "type_alias")


def parameter(name: str, annotation: str | None = None, default: str | None = None) -> dict:
    return {"name": name, "type_annotation": annotation, "default_value": default}
