"""Writing documents: a few rows of text, one file each, so the driver writes them."""

from __future__ import annotations

import html
import json
import os
import re
import tempfile
from collections.abc import Callable

STYLE = "body{max-width:52rem;margin:2rem auto;font-family:sans-serif;line-height:1.5}pre{background:#f4f4f4;padding:1rem;overflow:auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3rem .6rem}"


def write_atomically(path: str, data: bytes | str) -> None:
    """The file appears whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, beside = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)
    os.replace(beside, path)


def _inline(text: str) -> str:
    parts = re.split(r"(`[^`]+`)", text)
    out = []
    for p in parts:
        if p.startswith("`") and p.endswith("`") and len(p) > 1:
            out.append(f"<code>{html.escape(p[1:-1])}</code>")
            continue
        p = html.escape(p, quote=False)
        p = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", p)
        p = re.sub(r"(?<!\w)[*_](.+?)[*_](?!\w)", r"<em>\1</em>", p)
        out.append(re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', p))
    return "".join(out)


def blocks(markdown: str) -> list[tuple[str, object]]:
    """(kind, content) of the blocks of a Markdown text: h1 to h6, p, ul, ol, pre, table, hr."""
    out: list[tuple[str, object]] = []
    lines, i = markdown.splitlines(), 0
    while i < len(lines):
        x = lines[i]
        if x.strip().startswith("```"):
            j = i + 1
            while j < len(lines) and not lines[j].strip().startswith("```"):
                j += 1
            out.append(("pre", "\n".join(lines[i + 1 : j])))
            i = j + 1
        elif m := re.match(r"(#{1,6}) +(.*?)#*$", x):
            out.append((f"h{len(m[1])}", m[2].strip()))
            i += 1
        elif re.fullmatch(r"\s*(?:---+|\*\*\*+|___+)\s*", x):
            out.append(("hr", ""))
            i += 1
        elif x.lstrip().startswith("|") and i + 1 < len(lines) and re.fullmatch(r"\s*\|[\s:|-]+\|\s*", lines[i + 1]):
            j = i
            while j < len(lines) and lines[j].lstrip().startswith("|"):
                j += 1
            out.append(("table", [[c.strip() for c in re.split(r"(?<!\\)\|", r.strip().strip("|"))] for k, r in enumerate(lines[i:j]) if k != 1]))
            i = j
        elif re.match(r"\s*(?:[-*+]|\d+\.) +", x):
            ordered = bool(re.match(r"\s*\d+\.", x))
            items = []
            while i < len(lines) and (m := re.match(r"\s*(?:[-*+]|\d+\.) +(.*)", lines[i])):
                items.append(m[1])
                i += 1
            out.append(("ol" if ordered else "ul", items))
        elif x.strip():
            j = i
            while j < len(lines) and lines[j].strip() and not re.match(r"#{1,6} |```|\s*\||\s*(?:[-*+]|\d+\.) +", lines[j]):
                j += 1
            j = max(j, i + 1)
            out.append(("p", " ".join(y.strip() for y in lines[i:j])))
            i = j
        else:
            i += 1
    return out


def to_html(markdown: str, title: str = "") -> str:
    body = []
    for kind, content in blocks(markdown):
        if kind == "pre":
            body.append(f"<pre><code>{html.escape(content)}</code></pre>")
        elif kind in ("ul", "ol"):
            body.append(f"<{kind}>" + "".join(f"<li>{_inline(x)}</li>" for x in content) + f"</{kind}>")
        elif kind == "table":
            rows = ["<tr>" + "".join(f"<{'td' if i else 'th'}>{_inline(c)}</{'td' if i else 'th'}>" for c in r) + "</tr>" for i, r in enumerate(content)]
            body.append("<table>" + "".join(rows) + "</table>")
        elif kind == "hr":
            body.append("<hr>")
        else:
            anchor = re.sub(r"\s", "-", re.sub(r"[^\w\s-]", "", content.lower())) if kind != "p" else ""
            body.append(f"<{kind}{f' id={chr(34)}{anchor}{chr(34)}' if anchor else ''}>{_inline(content)}</{kind}>")
    return f"<!doctype html>\n<html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body>\n" + "\n".join(body) + "\n</body></html>\n"


def _wrapped(text: str, width: int) -> list[str]:
    out, now = [], ""
    for w in text.split():
        while len(w) > width:
            out += [now] if now else []
            out.append(w[:width])
            w, now = w[width:], ""
        if now and len(now) + 1 + len(w) > width:
            out.append(now)
            now = w
        else:
            now = f"{now} {w}".strip()
    return out + ([now] if now else [])


def to_pdf(markdown: str) -> bytes:
    """A plain PDF of headings, paragraphs, lists and code; an empty document says so. Characters beyond Latin-1 become question marks."""
    lines: list[tuple[str, int, str]] = []
    plain = lambda t: re.sub(r"[*`]|\[([^\]]+)\]\([^)]+\)", lambda m: m[1] or "", t)
    for kind, content in blocks(markdown) or [("p", "(empty document)")]:
        if kind == "pre":
            lines += [("F3", 9, y) for x in content.split("\n") for y in ([x[i : i + 95] for i in range(0, len(x), 95)] or [""])]
        elif kind in ("ul", "ol"):
            for n, x in enumerate(content, 1):
                w = _wrapped(plain(x), 85)
                lines += [("F1", 11, f"{'-' if kind == 'ul' else f'{n}.'} {w[0] if w else ''}")] + [("F1", 11, "   " + y) for y in w[1:]]
        elif kind == "table":
            lines += [("F3", 9, y) for r in content for x in ["  ".join(plain(c) for c in r)] for y in ([x[i : i + 95] for i in range(0, len(x), 95)] or [""])]
        elif kind.startswith("h") and kind != "hr":
            lines += [("F2", {"h1": 20, "h2": 16, "h3": 13}.get(kind, 12), x) for x in _wrapped(plain(content), 55)]
        elif kind == "p":
            lines += [("F1", 11, x) for x in _wrapped(plain(content), 90)]
        lines.append(("F1", 6, ""))
    pages, page, y = [], [], 800
    for font, size, text in lines:
        if y < 60:
            pages.append(page)
            page, y = [], 800
        y -= int(size * 1.4)
        escaped = re.sub(r"([\\()])", r"\\\1", text).encode("latin-1", "replace")
        page.append(b"BT /%s %d Tf 50 %d Td (%s) Tj ET" % (font.encode(), size, y, escaped))
    pages.append(page)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (6 + 2 * i) for i in range(len(pages))))]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % f for f in (b"Helvetica", b"Helvetica-Bold", b"Courier")]
    for i, p in enumerate(pages):
        stream = b"\n".join(p)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R /F2 4 0 R /F3 5 0 R >> >> /Contents %d 0 R >>" % (7 + 2 * i))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)


#: What is told of a run, null where it is not known.
STATISTICS = ["files_total", "files_changed", "chunks_documented", "embeddings_generated", "vectors_persisted", "tokens_used", "duration_seconds"]


def structured(path: str, summary: str | None, documents: dict[str, str], reviews: list[dict], statistics: dict) -> dict:
    """All that is known of a documented repository."""
    review = [{"doc_name": r["name"], "passed": r["passed"], "issues": list(r["issues"] or []), "error": r["error"]} for r in reviews]
    return {"repository_path": path, "repo_summary": summary, "generated_docs": dict(documents), "review": review, "statistics": {s: statistics.get(s) for s in STATISTICS}}


def to_json(documents: dict[str, str], **more) -> str:
    return json.dumps({"generated_docs": documents} | more, indent=2, ensure_ascii=False, default=str)


#: Format -> (ending, text -> content); others can be added.
FORMATS: dict[str, tuple[str, Callable]] = {"md": ("md", lambda t, name: t), "html": ("html", to_html), "pdf": ("pdf", lambda t, name: to_pdf(t))}


def export(documents: dict[str, str], formats: list[str], folder: str, **more) -> list[str]:
    """The paths written: each document in each format, and one JSON file if asked for. Unknown formats raise before anything is written."""
    unknown = [f for f in formats if f not in FORMATS and f != "json"]
    if unknown:
        raise ValueError(f"unknown formats: {', '.join(unknown)}")
    out = []
    if not documents:
        return out
    for f in formats:
        if f == "json":
            path = os.path.join(folder, "documentation.json")
            write_atomically(path, to_json(documents, **more))
            out.append(path)
            continue
        ending, make = FORMATS[f]
        for name, text in documents.items():
            path = os.path.join(folder, f"{name}.{ending}")
            write_atomically(path, make(text, name))
            out.append(path)
    return out
