"""Generated, minified or vendored source files, lock files and data saved as code.

Token sequences of files are compressed by Re-Pair. A file most of whose tokens stand below long rules is machine-made; literals that hold most of
a file and that a grammar of their characters hardly shortens mark data; phrases below rules that a file shares with known third-party files or with files of
other repositories, found by joins on the rules, mark copies. Statements about a file in its own comments and its place in the tree complete this.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.licenses import comments
from sparkloom.llm.repair import grammars
from sparkloom.session import cut_lineage, spread

#: Share of a file's tokens below long rules from which it is machine-made, if it has NUMBERED different numbers or more.
REUSED, NUMBERED = 0.85, 12
#: Share of a file's phrases from one known library, and from other repositories; a copy shares at least so many of them.
KNOWN, LEAST_KNOWN, SHARED, LEAST_SHARED = 0.1, 3, 0.6, 10
#: Literals whose grammar takes at least this share of their bits are hardly compressible.
DENSE = 0.8
#: Share of a text in literals from which it is data.
DATA = 0.5
#: A phrase in more than one in HOT_PARTS places is hot: there are at most HOT_PARTS of them.
HOT_PARTS = 10_000
#: Tokens that are compressed at once, about; a file is never divided.
AT_ONCE = 200_000

# Words that are structure, not names; places and statements that mark files nobody wrote by hand.
_WORDS = frozenset(
    "if else for while return def class function var let const import from export async await new switch case default break try catch finally throw func type struct package range go defer map fn pub impl use match mut self static in not and or is None null nil true false True False with as raise except del yield lambda assert".split()
)
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|(?<=[\[({,=:\s])-?\d[\w.]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|[^\w\s]")
_CODE = re.compile(r"\.(?:py|pyi|jsx?|mjs|cjs|tsx?|mts|go|rs|java|kt|c|cc|cpp|h|hpp|cs|rb|php|swift|scala|sh|lua|r|dart|css|scss)$", re.I)
_VENDOR = re.compile(r"(?:^|/)(?:vendor|third[_-]party|_vendor|node_modules|bower_components|external|deps|Godeps|site-packages)/(?=.*/|.)")
_GENERATED_PATH = re.compile(r"(?:^|/)(?:gen|__generated__|generated)/|_pb2(?:_grpc)?\.pyi?$|_pb\.(?:js|ts|d\.ts)$|\.pb\.(?:go|cc|h)$|\.g\.(?:ts|dart|cs|js)$|\.gen\.\w+$|[._]generated\.\w+$|\.designer\.\w+$", re.I)
_MINIFIED_PATH = re.compile(r"\.(?:min|bundle)\.(?:m?js|css)$|(?:^|/)chunk-[0-9a-f]{6,}\.m?js$", re.I)
_LOCK_PATH = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum|[\w.-]*[.-]lock(?:\.json)?|[\w-]+-lock\.(?:json|ya?ml)|[\w.-]+\.lock\.(?:json|ya?ml))$", re.I)
_SAYS_GENERATED = re.compile(
    r"(?im)^\W*(?:code generated\b|(?:this (?:file|code|module) (?:is|was|has been) )?(?:auto-?generated|automatically (?:generated|created|written))\b|@generated\b|<auto-generated|this (?:file|code) (?:is|was|has been) (?:generated|written|created|produced) (?:automatically|by)|generated (?:by|from) [\w.-]+|diese datei wurde automatisch|ce fichier a été (?:généré|créé) automatiquement|este archivo (?:fue|se ha) generado|source: \S+; changes will be overwritten|do not edit\b)"
)
_SAYS_COPIED = re.compile(r"(?im)^\W*(?:vendored from|copied (?:unchanged |verbatim )?from (?:upstream|https?:)|.*\bbundled third-party copy\b|(?:third-party|upstream) (?:file|copy|code)[:,]|imported (?:unchanged )?from upstream)")
#: Each of the statements has one of these in lower case.
_HINTS = ("generat", "génér", "automati", "overwritten", "do not edit", "vendored", "copied", "third-party", "upstream")
_NOT_SOURCE = re.compile(r"(?i)(?:^|/)(?:licen[sc]e|copying|notice|readme|changelog|contributing)[^/]*$|\.(?:md|rst|txt)$|(?:^|/)(?:package\.json|pyproject\.toml|cargo\.toml|go\.mod|setup\.cfg)$")


class Classes(dict):
    """Token -> number of its text, whose last 16 bits tell its class: structural words and punctuation are classes of their own, names, numbers and strings one each. Filled as tokens come."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, t: str) -> int:
        c = t[0]
        k = t if t in _WORDS else "i" if c.isalpha() or c in "_$" else "0" if c.isdigit() or len(t) > 1 and c == "-" else "s" if c in "\"'" and len(t) > 1 else c
        if len(self) > self.most:
            self.clear()
        self[t] = x = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=5).digest()) << 16 | zlib.crc32(k.encode("utf-8", "replace")) & 0xFFFF
        return x


def tokens(text: str, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the tokens of a text, and the numbers of their texts."""
    found = _TOKEN.findall(text)
    both = np.fromiter(map(classes.__getitem__, found), np.int64, len(found))
    return both & 0xFFFF, both


_COMMENT = ("//", "#", "*", "/*")


_NUMBERS = re.compile(r"(?:-?(?:0x[0-9a-fA-F]++|\d++(?:\.\d++)?),\s*+){16,}+")
_BLOB = re.compile(r"[\"'`]([A-Za-z0-9+/=_\\-]{120,}+)[\"'`]")
_BLOB_LINE = re.compile(r"(?m)^[ \t]*+[\"'`]?([A-Za-z0-9+/=]{60,}+)[\"'`]?[ \t]*[,+\\]?$")
_NUMBER = re.compile(r"\d+")
_HASHED = re.compile(r"(?:integrity|checksum|resolved|sha512|sha256)[\"']?\s*[:=]")


def incompressible(literals: str) -> bool:
    """Whether a grammar of the characters hardly shortens them: its symbols, two for each rule, take at least DENSE of their bits."""
    chars = np.frombuffer(literals.encode("utf-32-le", "replace"), np.uint32)
    g, alphabet = grammars([chars]), max(2, len(np.unique(chars)))
    return (g.left[0] + 2 * g.rules[0]) * np.log2(alphabet + g.rules[0]) >= DENSE * len(chars) * np.log2(alphabet)


def literal_share(text: str) -> float:
    """The share of a text in literals that hardly compress: numbers in long lists and long strings without spaces."""
    numbers = sum(map(len, _NUMBERS.findall(text)))
    blobs = "".join(_BLOB.findall(text)) + "".join(_BLOB_LINE.findall(text))
    if numbers + len(blobs) <= DATA * len(text) or blobs and not incompressible(blobs):
        blobs = ""
    return (numbers + len(blobs)) / max(1, len(text))


def dense_share(text: str) -> float:
    """The share of a text in lines of more than 200 characters with few spaces."""
    long = (x for x in text.splitlines() if len(x) > 200)
    return sum(len(x) for x in long if x.count(" ") < 0.06 * len(x) and x.isascii() and not x.lstrip().startswith(_COMMENT)) / max(1, len(text))


def signs(path: str, text: str | None) -> list[str]:
    """Why a file of this path and text is not written by hand, as far as the file alone tells without its grammar; text None: only its path is known."""
    out, unread = [], text is None
    text = text or ""
    if _VENDOR.search(path):
        out.append("vendored")
    if _GENERATED_PATH.search(path):
        out.append("generated")
    dense, literals = dense_share(text), literal_share(text)
    code = bool(_CODE.search(path))
    if code and (dense > 0.6 and literals < 0.3 or _MINIFIED_PATH.search(path) and (dense > 0.3 or unread)):
        out.append("minified")
    if code and literals > DATA:
        out.append("data")
    if _LOCK_PATH.search(path) and not _CODE.search(path) or re.search(r"\.(?:json|ya?ml|lock)$", path) and len(_HASHED.findall(text)) >= 5:
        out.append("lock")
    low = text.lower()
    if any(h in low for h in _HINTS) and (_SAYS_GENERATED.search(text) or _SAYS_COPIED.search(text)):
        ending = path.rsplit(".", 1)[-1].lower()
        if ending in ("sql", "html", "htm", "xml", "css"):
            own = re.findall(r"(?s)<!--(.*?)-->|/\*(.*?)\*/|(?m:^[ \t]*--([^\n]*))", text)
            said = ["".join(x) for x in own]
        else:
            said = list(comments(text, "py" if ending in ("py", "yaml", "yml", "toml", "rb", "sh", "r") else ending))
        if any(_SAYS_GENERATED.search(c) for c in said):
            out.append("generated")
        if any(_SAYS_COPIED.search(c) for c in said):
            out.append("vendored")
    return out


def examined(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, signs, rules) of every row of (repo_id, file_path, source): why it is not written by hand, as far as the file tells alone,
    and, of code, the phrases below the rules of its grammar."""

    def examine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = Classes()
        for b in batches:
            rows, sequences, size = [], [], 0

            def out(rows=rows, sequences=sequences):
                g = grammars([c for c, _ in sequences], [w for _, w in sequences])
                for i, (repo, path, signs_, numbers) in enumerate(rows):
                    n = len(sequences[i][0])
                    # Machine-made phrases count: what repeats without numbers that differ may be a hand's habit.
                    if n and g.long[i] >= REUSED * n and numbers >= NUMBERED:
                        signs_.append("generated")
                    yield repo, path, sorted({*signs_}), g.phrases(i)

            for repo, path, s in zip(b["repo_id"], b["file_path"], b["source"]):
                read = None if s is None or b"\0" in s[:8192] else s.decode("utf-8", "replace").removeprefix("\ufeff").replace("\r\n", "\n")
                found = signs(path, read) if not _NOT_SOURCE.search(path) else []
                code = read if read and _CODE.search(path) else ""
                rows.append((repo, path, found, len({*_NUMBER.findall(code)})))
                sequences.append(tokens(code, classes))
                size += len(sequences[-1][0])
                if size >= AT_ONCE:
                    yield pd.DataFrame(list(out()), columns=_COLUMNS)
                    rows.clear()
                    sequences.clear()
                    size = 0
            yield pd.DataFrame(list(out()), columns=_COLUMNS)

    repo = files.schema["repo_id"].dataType.simpleString()
    rows = files.where("file_path IS NOT NULL").select("repo_id", "file_path", "source")
    return spread(rows).mapInPandas(examine, f"repo_id {repo}, file_path string, signs array<string>, rules array<bigint>")


_COLUMNS = ["repo_id", "file_path", "signs", "rules"]


def known_rules(known: DataFrame) -> DataFrame:
    """(rule, library) of the phrases of known files (library, file_name, content); phrases that more than two libraries have are no sign of one of them."""
    files = known.select(F.col("library").alias("repo_id"), F.col("file_name").alias("file_path"), F.encode("content", "UTF-8").alias("source"))
    each = examined(files).select(F.explode("rules").alias("rule"), F.col("repo_id").alias("library")).distinct()
    few = each.groupBy("rule").agg(F.min("library").alias("a"), F.max("library").alias("z"), F.count("*").alias("n")).where("n <= 2")
    return few.select("rule", F.explode(F.array_distinct(F.array("a", "z"))).alias("library"))


def not_by_hand(sources: DataFrame, known: DataFrame) -> DataFrame:
    """(repo_id, file_path, kinds) of the files that nobody in their repository wrote by hand.

    kinds are of generated, minified, lock, vendored and data. Licence files, readmes, manifests and other documents are never among
    them. Null, empty and binary contents (a NUL in the first 8,192 bytes) have the signs of their path only; rows that repeat a file give one row. An empty table of known
    files finds copies across repositories only.
    """
    files = cut_lineage(examined(sources))
    counts = files.select("repo_id", F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min("repo_id").alias("a"), F.max("repo_id").alias("z"))
    # A row for each rule that tells anything: library is null for sharing across repositories.
    told = counts.where("a < z").select("rule", "n", F.lit(None).cast("string").alias("library")).unionByName(known_rules(known).join(counts, "rule").select("rule", "n", "library"))
    told = cut_lineage(told)
    total = files.agg(F.coalesce(F.sum(F.size("rules")), F.lit(0))).first()[0]
    # Hot rules, at most HOT_PARTS of them, meet their places by broadcast, so no key of the shuffled join is hot.
    is_hot = F.col("n") * HOT_PARTS >= F.lit(total)
    hot, cold = F.broadcast(told.where(is_hot).select("rule", "library")), told.where(~is_hot).select("rule", "library")
    exploded = files.select("repo_id", "file_path", F.size("rules").alias("all"), F.explode("rules").alias("rule"))
    met = exploded.join(hot.select("rule").distinct(), "rule", "left_anti").join(cold, "rule").unionByName(exploded.join(hot, "rule"))
    hits = met.groupBy("repo_id", "file_path", "library").agg(F.count("*").alias("hits"), F.max("all").alias("all"))
    least, share = (F.when(F.col("library").isNull(), x).otherwise(y) for x, y in ((LEAST_SHARED, LEAST_KNOWN), (SHARED, KNOWN)))
    copies = hits.where((F.col("hits") >= least) & (F.col("hits") >= share * F.col("all"))).select("repo_id", "file_path", F.array(F.lit("vendored")).alias("kinds"))
    own = files.where(F.size("signs") > 0).select("repo_id", "file_path", F.col("signs").alias("kinds"))
    return own.unionByName(copies).groupBy("repo_id", "file_path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))
