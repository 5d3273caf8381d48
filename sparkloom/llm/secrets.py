"""Credentials embedded in source code.

Candidate values are found by their surroundings or format, and beyond them as any literal without spaces that holds letters and digits, in one pass over all contents, which
also counts byte pairs of everything for a character Markov model. A logistic regression on the Markov likelihood of the value, its make-up, the
surrounding identifier and the path is trained on candidates that patterns label weakly, calibrated on labelled candidates held out, and what it scores high is redacted.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage, spread

#: At most so many weakly labelled candidates train the regression; they are those of least hash. Counts cover all data.
TRAINED = 20_000
#: A candidate counts from this calibrated score; one that no pattern proposes, of kinds LOOSE, from the second.
THRESHOLD, LOOSE_THRESHOLD = 0.8, 0.9
LOOSE = ("shaped", "literal")
#: One in so many labelled candidates is held out of the training for the calibration.
HELD_OUT, PULL = 4, 10.0
MASK = "*"

# Formats of common access tokens.
FORMATS = r"ghp_[A-Za-z0-9]{12,}|AKIA[0-9A-Z]{6,16}|sk_live_[A-Za-z0-9]{8,}|xox[abp]-\d+-[A-Za-z0-9]{3,}|eyJ[\w-]{8,}\.eyJ[\w-]+(?:\.[\w-]+)?|glpat-[\w-]{12,}|AIza[\w-]{20,}"
_IDENT = r"[A-Za-z_][\w.-]*"
_CANDIDATES = [
    ("pem", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?P<i>PRIVATE KEY)(?: BLOCK)?-----(?P<v>)")),
    ("url", re.compile(r"(?P<i>[A-Za-z][\w+.-]*)://[^\s:/@\"'`]*:(?P<v>[^\s@/\"'`]+)@")),
    ("hook", re.compile(r"https?://(?P<i>[\w.-]*hooks?\b[\w.-]*)/(?P<v>[^\s\"'`]{12,})")),
    ("header", re.compile(r"(?P<i>[Aa]uthorization|[Xx]-[\w-]*(?:[Kk]ey|[Tt]oken))[\"']?\s*[:=,]\s*[\"'`]?(?:Bearer|Basic|Token|bearer|basic|token)?\s*(?P<v>[^\s\"'`]{6,})")),
    ("connection", re.compile(r"(?i)(?P<i>password|pwd)=(?P<v>[^;\"'`\s]{4,});")),
    ("prose", re.compile(r"(?i)\b(?P<i>password|passwd|passphrase|pw|pwd|secret|token|key)\s+(?:is|was|=>)\s+(?P<v>[^\s\"'`]{6,})|\b(?P<i2>pw|pwd|passphrase)\s*[:=]\s+(?P<v2>[^\s\"'`]{6,})")),
    ("login", re.compile(r"(?i)\b(?P<i>login|logins|account|credentials?|creds)\s+(?:(?:is|was|are|were)\s+)?:?\s*[\w.@-]+\s*/\s*(?P<v>[^\s\"'`/]{6,})|(?:-u|--user)[ =][\"']?[\w.@-]+:(?P<v2>[^\s\"'`]{4,})")),
    ("call", re.compile(r"(?i)\b(?P<i>log_?in|sign_?in|connect|open_?session|auth(?:enticate|orize)?)\(\s*[\"'`][^\"'`\n]{1,60}[\"'`]\s*,\s*[\"'`](?P<v>[^\"'`\n]{6,})[\"'`]")),
    ("attribute", re.compile(rf"(?i)\b(?:name|id|key)=[\"'](?P<i>{_IDENT})[\"']\s+(?:content|value)=[\"'](?P<v>[^\"'\n]{{4,}})[\"']")),
    ("quoted", re.compile(rf"(?i)(?P<i>(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|credential|hook|auth\w*)s?(?:[_-]?\d+)?)[\"']?\s*(?::\s*[&'\w<>\[\] ]{{1,30}}?)?\s*(?::=|=>|=|:)\s*(?:[\w.]*\(\s*)?(?P<q>[\"'`])(?P<v>[^\"'`\n]{{4,}})(?P=q)")),
    ("format", re.compile(rf"(?P<i>)(?<![\w+/=.-])(?P<v>{FORMATS})")),
]
_PLAIN = ("plain", re.compile(rf"(?m)^[ \t]*(?:--|#|//|\*|-)?[ \t]*(?:export[ \t]+)?(?P<i>{_IDENT})[ \t]*[:=][ \t]*(?P<v>[^\s\"'`#;,(){{}}\[\]][^\s\"'`(){{}}\[\],]{{5,}})[ \t\r]*$"))
#: Beyond the patterns: a short prefix with a separator and a run of mixed letters and digits, and any literal of letters and digits without spaces.
_RUN = r"(?=[\w-]*\d)(?=[\w-]*[A-Z])(?=[\w-]*[a-z])[\w-]{12,}+"
_SHAPED = re.compile(rf"(?<![\w./@-])(?P<i>)(?P<v>[A-Za-z]{{2,8}}[._-]{_RUN}(?:\.[\w-]+)*+)(?![\w(])")
_LITERAL = re.compile(r"[\"'`](?P<i>)(?P<v>[A-Za-z0-9+/=_.~!@#$%^&*-]{12,200}+)[\"'`]")
_ASSIGNED = re.compile(r"([A-Za-z_][\w.-]*)[\"']?\s*(?:[:=(,]|=>|:=)\s*[\w.]*\(?\s*[\"'`]?\Z")
_WORDY = re.compile(r"[a-z]{5,}|[A-Z][a-z]{4,}")
#: A kind's pattern is only tried where one of these is in the content in lower case; each match of the kind has one of them.
_GATES = {
    "pem": ("private key",), "url": ("://",), "hook": ("hook",), "header": ("authorization", "x-"), "connection": ("password=", "pwd="), "prose": ("password", "passwd", "passphrase", "pw", "secret", "token", "key"),
    "login": ("login", "account", "cred", "-u", "--user"), "call": ("log_in(", "login(", "signin(", "sign_in(", "connect(", "session(", "auth(", "authenticate(", "authorize("), "attribute": ("content=", "value="),
    "quoted": ("pass", "pwd", "secret", "token", "key", "cred", "hook", "auth"), "format": ("ghp_", "akia", "sk_live_", "xox", "eyj", "glpat-", "aiza"), "plain": ("pass", "pwd", "secret", "token", "key", "cred", "hook", "auth"),
}
_SECRET = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|(?:access|signing|private|encryption|secret)[_-]?key|credential|hook)s?(?:[_-]?\d+)?$|^auth")
_HASH = re.compile(r"(?i)(?:hash|sum|digest|integrity|etag|commit|sha\d*|uuid|guid|revision|version|(?:^|[_-])id|[a-z]Id|fingerprint|public[_-]?key|certificate|field|count|name|label|url|path)(?:[_-]?\d+)?$")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:<.*>?|\$\{?.*|\{+.*\}*|%\w.*|%\(.*|\*+|x+|\.+|\?+|-+|(?:env|vault|store|ref|secret|file|ssm|arn|kms):.*|.*(?:change[_-]?me|replace[_-]?me|your[_-]|example|placeholder|dummy|todo|set[ _-]?me|insert|redacted).*|(?:user|input|my|the|test|new|old|db|admin)?[_-]?(?:pass(?:word|wd)?|secret|token|key|credentials?)(?:[_-]?\w{0,8})?|os\.environ.*|process\.env.*|none|null|true|false|undefined)$"
)
_FORMAT = re.compile(rf"^(?:{FORMATS})")
_CONFIG = re.compile(r"(?i)\.(?:ya?ml|toml|ini|cfg|conf|env|properties|md|txt|sh|bash|rst|sql|tf)$|(?:^|/)[^./]*$|\.env")
_COMMENT = re.compile(r"^[ \t]*(?:--|#|//|\*)")
#: What may stand around a line of a key; a line of a key, of which a short one is the last; what of a key is on the BEGIN line.
_AROUND = " \t\r\n\"'`#*>|;+,\\()[]/-"
_KEY_LINE = re.compile(r"(?=.*[A-Z0-9+/=])[A-Za-z0-9+/=]+|(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset): .*")
_KEY_REST = re.compile(r"(?:[A-Za-z0-9+/=]|\\[nr])*")
_BEFORE = re.compile(r"[\w.-]*\Z")
KINDS = [k for k, _ in _CANDIDATES] + ["plain", *LOOSE]
FEATURES = ["one", "likelihood", "length", "digits", "upper", "symbols", "classes", "spaces", "secret", "hash", "placeholder", "format", "shaped", "wordy", "doc", "hex", *KINDS]


def key_run(content: str, at: int, begun: bool) -> tuple[int, bool]:
    """(end of the key lines from an offset, whether they go on to the end of the content without an END line); begun: the offset is on the BEGIN line."""
    end, short = at, False
    if begun:
        end = at = _KEY_REST.match(content, at).end()
        stop = content.find("\n", at)
        if content[at : stop if stop >= 0 else len(content)].strip(_AROUND):
            return end, False
        at = stop + 1 if stop >= 0 else len(content)
    while at < len(content):
        stop = content.find("\n", at)
        stop = stop if stop >= 0 else len(content)
        body, mark, _ = content[at:stop].partition("-----END")
        body = body.replace("\\n", "").replace("\\r", "").strip(_AROUND)
        if body and (short or not _KEY_LINE.fullmatch(body)):
            return end, False
        if mark:
            return stop, False
        if body:
            end, short = stop, len(body) < 16
        at = stop + 1
    return end, True


def candidates(content: str, path: str) -> list[tuple[str, str, int, int]]:
    """(kind, identifier, from, to) of each candidate value in a content; the first kind that finds a place has it."""
    low = content.lower()
    found: dict[int, tuple[str, str, int, int]] = {}
    spans: list[tuple[int, int]] = []
    config = bool(_CONFIG.search(path))
    for kind, p in [*_CANDIDATES, _PLAIN, ("shaped", _SHAPED), ("literal", _LITERAL)]:
        if kind in _GATES and not any(x in low for x in _GATES[kind]) or kind == "plain" and not config and "#" not in low and "//" not in low and "--" not in low and "*" not in low:
            continue
        for m in p.finditer(content):
            second = m["v"] is None
            a, b = m.span("v2" if second else "v")
            ident = (m.groupdict().get("i2") if second else m["i"]) or ""
            if kind == "pem":
                a, b = m.start(), m.end()
                end, other = content.find("-----END", b), content.find("-----BEGIN", b)
                if end < 0 or 0 <= other < end:  # open: its key lines, however many
                    b = key_run(content, b, True)[0]
                else:
                    b = content.find("\n", end) if content.find("\n", end) > 0 else len(content)
            value = content[a:b]
            if kind in LOOSE:
                if not re.search(r"\d", value) or not re.search(r"[A-Za-z]", value):
                    continue
                before = _ASSIGNED.search(content, max(0, a - 80), a)
                ident = before[1] if before else ""
            if kind == "attribute" and not _SECRET.search(ident):
                continue
            if kind == "quoted":  # the identifier begins before its last word
                ident = _BEFORE.search(content, max(0, m.start("i") - 80), m.start("i"))[0] + ident
            if kind in ("quoted", "plain"):
                named = _SECRET.search(ident)
                if not named and not (len(value) >= 16 and " " not in value and _FORMAT.match(value)):
                    continue
                if kind == "plain" and not config and not _COMMENT.match(m[0]):
                    continue
            at = bisect_left(spans, (a, b))
            if at < len(spans) and spans[at][0] < b or at and spans[at - 1][1] > a:
                continue
            spans.insert(at, (a, b))
            found[a] = (kind, ident, a, b)
    return [found[a] for a in sorted(found)]


def features(kind: str, ident: str, value: str, path: str, model: np.ndarray) -> list[float]:
    """The features of a candidate; model: log-probability of each byte after another in all contents."""
    raw = np.frombuffer(value.encode("utf-8", "replace"), np.uint8)
    like = float(model[raw[:-1].astype(int) * 256 + raw[1:]].mean()) if len(raw) > 1 else 0.0
    n = max(1, len(value))
    digits, upper, lower = sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n, sum(c.islower() for c in value) / n
    symbols = sum(not c.isalnum() and not c.isspace() for c in value) / n
    f = [1, like + 4, min(4.0, np.log2(n) - 3), digits, upper, symbols, sum(x > 0 for x in (digits, upper, lower, symbols)) - 2, " " in value]
    f += [bool(_SECRET.search(ident)) or kind in ("url", "header", "connection", "prose", "login", "call"), bool(_HASH.search(ident)), bool(_PLACEHOLDER.match(value)), bool(_FORMAT.match(value)), bool(_SHAPED.fullmatch(value)), sum(map(len, _WORDY.findall(value))) / n, bool(re.search(r"(?i)(?:^|/)(?:docs?|examples?|tests?|fixtures?)/|\.md$", path)), bool(re.fullmatch(r"[0-9a-f]{32,}|[0-9a-f-]{36}", value))]
    return [float(x) for x in [*f, *(kind == k for k in KINDS)]]


def weak_label(kind: str, ident: str, value: str) -> int:
    """1 or 0 where a pattern is sure, else -1."""
    if _PLACEHOLDER.match(value) or _HASH.search(ident) or " " in value and kind != "pem" and not re.search(r"\d", value):
        return 0
    if kind == "pem" or _FORMAT.match(value) or kind == "hook" and re.search(r"sig=|[A-Za-z0-9]{20,}", value):
        return 1
    mixed = sum(bool(re.search(x, value)) for x in ("[a-z]", "[A-Z]", r"\d", r"[^\w\s]"))
    if kind in LOOSE and (re.fullmatch(r"[0-9a-fA-F-]+|[\d.:TZ+-]+", value) or not _SECRET.search(ident)):
        # What is not named as a secret is no proof of anything, but hexadecimal numbers, dates and versions are none.
        return 0 if re.fullmatch(r"[0-9a-fA-F-]+|[\d.:TZ+-]+|v?\d+(?:\.\d+)+[\w.-]*", value) or sum(map(len, _WORDY.findall(value))) > 0.6 * len(value) else -1
    if kind not in ("format", "hook") and len(value) >= 8 and mixed >= 2 and re.search(r"\d", value):
        return 1
    if re.fullmatch(r"[a-z_ -]+", value):
        return 0
    if kind in LOOSE and sum(map(len, _WORDY.findall(value))) > 0.6 * len(value):
        return 0
    return -1


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method, classes weighted alike."""
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-6:
            break
    return w


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) by which a logit becomes that of the share of positives at it, fitted on candidates held out and drawn to (1, 0), which a handful of them hardly leaves."""
    if len({*y.tolist()}) < 2:
        return 1.0, 0.0
    a, b = 1.0, 0.0
    # Labels a little inside 0 and 1, so that a clean separation does not make the slope endless.
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(p - t) @ z, (p - t).sum()]) + PULL * np.array([a - 1, b])
        w = p * (1 - p) + 1e-9
        h = np.array([[w @ (z * z) + PULL, w @ z], [w @ z, w.sum() + PULL]])
        d = np.linalg.solve(h, g)
        d /= max(1.0, np.abs(d).max() / 0.5)  # no step beyond where the curve is like its tangent
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _first_pass(chunks: DataFrame) -> DataFrame:
    """Candidates (code null) and, of each batch, counts of byte pairs (code not null)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(65_536, np.int64)
        for b in batches:
            rows = []
            raw = np.frombuffer("\0".join(b["content"]).encode("utf-8", "replace"), np.uint8)
            if len(raw) > 1:
                counts += np.bincount((raw[:-1].astype(np.uint16) << 8) | raw[1:], minlength=65_536)
            for no, repo, path, start, header, content in zip(b["chunk_no"], b["repo_id"], b["file_path"], b["start_line"], b["header"], b["content"]):
                path = path or ""
                for kind, ident, x, y in candidates(content, path):
                    line = None if start is None or start != start else int(start) + content.count("\n", 0, x) - int(header)
                    rows.append((no, repo, path, line, x, y, kind, ident, content[x:y], None, None))
            yield pd.DataFrame(rows, columns=_COLUMNS)
        codes = np.flatnonzero(counts)
        yield pd.DataFrame({c: None for c in _COLUMNS[:-2]} | {"code": codes, "n": counts[codes]}, columns=_COLUMNS)

    repo = chunks.schema["repo_id"].dataType.simpleString()
    rows = chunks.where(F.col("content").isNotNull()).select("chunk_no", "repo_id", "file_path", "start_line", F.col("context_header").isNotNull().alias("header"), "content")
    return spread(rows).mapInPandas(scan, f"chunk_no long, repo_id {repo}, file_path string, line_no int, begin int, end int, kind string, ident string, value string, code int, n long")


_COLUMNS = ["chunk_no", "repo_id", "file_path", "line_no", "begin", "end", "kind", "ident", "value", "code", "n"]


def _model(found: DataFrame, trained: int) -> tuple[np.ndarray, np.ndarray, tuple[float, float], pd.DataFrame]:
    """(Markov model, weights, calibration, the candidates held out with their label and calibrated score) from what _first_pass found."""
    pairs = {r["code"]: r["s"] for r in found.where("code IS NOT NULL").groupBy("code").agg(F.sum("n").alias("s")).collect()}  # at most 65,536 rows
    counts = np.ones((256, 256))
    for code, n in pairs.items():
        counts[code >> 8, code & 255] += n
    model = np.log(counts / counts.sum(axis=1, keepdims=True)).ravel().astype("f4")
    rows = found.where("code IS NULL").select("kind", "ident", "value", "file_path").dropDuplicates(["kind", "ident", "value"])
    loose = F.col("kind").isin(*LOOSE)
    rows = cut_lineage(rows.withColumn("h", F.pmod(F.xxhash64("kind", "ident", "value"), F.lit(1 << 30))))

    def least(df: DataFrame) -> pd.DataFrame:
        """The candidates of least hash. What cannot be among them is left out first, so partitions send no more than about that many in all."""
        n = df.count()
        near = df.where(F.col("h") < F.lit(int((1 << 30) * (1.2 * trained + 1000) / max(1, n))))
        return near.orderBy("h", "kind", "ident", "value").limit(trained).drop("h").toPandas()

    sample = pd.concat([least(rows.where(~loose)), least(rows.where(loose))], ignore_index=True)
    sample["label"] = np.array([weak_label(k, i, v) for k, i, v in zip(sample["kind"], sample["ident"], sample["value"])], int)
    x = np.array([features(k, i, v, p, model) for k, i, v, p in zip(sample["kind"], sample["ident"], sample["value"], sample["file_path"])]).reshape(-1, len(FEATURES))
    y, held = sample["label"].to_numpy(), np.arange(len(sample)) % HELD_OUT == HELD_OUT - 1
    w = fit(x[(y >= 0) & ~held], y[(y >= 0) & ~held])
    own = (y >= 0) & held
    z = x @ w
    a, b = calibration(z[own], y[own])
    # Held-out candidates only tell how scores relate to labels; the weights that are used come from all.
    final = fit(x[y >= 0], y[y >= 0])
    out = sample[held].assign(score=1 / (1 + np.exp(-np.clip(a * z[held] + b, -30, 30))))
    return model, final, (a, b), out


def scored(chunks: DataFrame, trained: int = TRAINED) -> DataFrame:
    """(chunk_no, repo_id, file_path, line_no, begin, end, kind, ident, value, score) of every candidate in every content.

    line_no is the line of the file on which the value begins; a context header is no line of it, and a null start_line
    gives a null line. begin and end are offsets in content. Null contents have no candidates; an empty table gives none.
    Rows that repeat give rows that repeat.
    """
    found = cut_lineage(_first_pass(chunks))
    model, w, (a, b), _ = _model(found, trained)
    rows = found.where("code IS NULL").drop("code", "n")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            z = np.array([features(k, i, v, p, model) for k, i, v, p in zip(g["kind"], g["ident"], g["value"], g["file_path"])]).reshape(-1, len(FEATURES)) @ w
            yield g.assign(score=1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))))

    return rows.mapInPandas(score, rows.schema.simpleString()[7:-1].replace(":", " ") + ", score double")


def calibrated(chunks: DataFrame, trained: int = TRAINED) -> DataFrame:
    """(kind, bin, candidates, score, labelled, positive): the candidates held out of the training, by kind and tenth of the score: their mean score and, of those with a weak label,
    the share that is positive."""
    held = _model(cut_lineage(_first_pass(chunks)), trained)[3]
    out = chunks.sparkSession.createDataFrame(list(zip(held["kind"], held["label"].astype(int).tolist(), held["score"].astype(float).tolist())), "kind string, label int, score double")
    sure = F.col("label") >= 0
    return out.groupBy("kind", F.least(F.floor(F.col("score") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("candidates"), F.avg("score").alias("score"), F.count_if(sure).alias("labelled"), F.avg(F.when(sure, F.col("label"))).alias("positive"))


def credentials(chunks: DataFrame, threshold: float = THRESHOLD, loose: float = LOOSE_THRESHOLD) -> DataFrame:
    """The candidates that score at least threshold, those that no pattern proposes at least loose."""
    return scored(chunks).where(F.col("score") >= F.when(F.col("kind").isin(*LOOSE), loose).otherwise(threshold))


def continued(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(chunk_no, begin, end, value) of the key lines that carry on a private key block left open by the chunk before them in the file.

    Chunks without start_line have no place in their file and carry on nothing.
    """

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for no, repo, path, start, header, content in zip(b["chunk_no"], b["repo_id"], b["file_path"], b["start_line"], b["header"], b["content"]):
                at = content.find("\n") + 1 if header else 0
                end, through = key_run(content, at, False)
                blocks = [m.end() for m in _CANDIDATES[0][1].finditer(content)]
                opens = bool(blocks) and "-----END" not in content[blocks[-1] :] and key_run(content, blocks[-1], True)[1]
                if end > at or through or opens:
                    lines = content.count("\n", at) + (not content.endswith("\n"))
                    rows.append((no, repo, path, int(start), int(start) + lines, None if through else opens, at, end, content[at:end]))
            yield pd.DataFrame(rows, columns=["chunk_no", "repo_id", "file_path", "first", "next", "opens", "begin", "end", "value"])

    opened = found.where("kind = 'pem' AND NOT contains(value, '-----END')").select("repo_id", "file_path").distinct()
    rows = chunks.where("content IS NOT NULL AND start_line IS NOT NULL").select("chunk_no", "repo_id", "file_path", "start_line", F.col("context_header").isNotNull().alias("header"), "content").join(opened, ["repo_id", "file_path"], "left_semi")
    repo = chunks.schema["repo_id"].dataType.simpleString()
    seen = cut_lineage(rows.mapInPandas(edges, f"chunk_no long, repo_id {repo}, file_path string, first long, next long, opens boolean, begin int, end int, value string"))
    # Few rows without texts: a chunk of key lines alone passes on what the chunk before it left, a gap between lines ends it.
    file, places = ["repo_id", "file_path"], seen.select("repo_id", "file_path", "chunk_no", "first", "next", "opens", "begin", "end")
    before = Window.partitionBy(*file).orderBy("first").rangeBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*file).orderBy("first").rangeBetween(Window.unboundedPreceding, 0)
    places = places.withColumn("gap", (F.col("first") > F.coalesce(F.max("next").over(before), F.lit(-1))).cast("long"))
    places = places.withColumn("start", F.max(F.when(F.col("gap") == 1, F.col("first"))).over(upto))
    last = F.max(F.when(F.col("opens").isNotNull(), F.struct("first", "next", "opens"))).over(before)
    places = places.withColumn("last", last).where("end > begin AND last.opens AND last.first >= start")
    return seen.join(places.select("chunk_no", "begin", "end").distinct(), ["chunk_no", "begin", "end"], "left_semi").select("chunk_no", "begin", "end", "value")


def redact(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(chunk_no, content) of the chunks with credentials, each value masked character by character but for line ends, everything else unchanged.

    A private key block that a chunk leaves open is masked in the chunks that carry it on, too.
    """
    places = found.select("chunk_no", "begin", "end", "value").unionByName(continued(chunks, found)).distinct()

    def mask(content: str, begins, ends, values) -> str:
        for a, b, v in zip(begins, ends, values):
            if content[a:b] == v:  # places belong to one of the versions of a chunk
                content = content[:a] + re.sub(r"[^\r\n]", MASK, v) + content[b:]
        return content

    @F.pandas_udf("string")
    def masked(content: pd.Series, begins: pd.Series, ends: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([mask(*x) for x in zip(content, begins, ends, values)])

    lists = places.groupBy("chunk_no").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "value"))).alias("x"))
    joined = chunks.where(F.col("content").isNotNull()).select("chunk_no", "content").distinct().join(lists, "chunk_no")
    return joined.select("chunk_no", masked("content", "x.begin", "x.end", "x.value").alias("content")).distinct()


def report(found: DataFrame, runs: DataFrame) -> DataFrame:
    """(repo_id, files_with_credentials, credentials, files_skipped_secret) of each repository with either; skipped files are those of its last run."""
    own = found.select("repo_id", "file_path", "line_no").distinct().groupBy("repo_id").agg(F.countDistinct("file_path").alias("files_with_credentials"), F.count("*").alias("credentials"))
    last = runs.groupBy("repo_id").agg(F.max_by("files_skipped_secret", F.struct("started_at", "run_id")).alias("files_skipped_secret"))
    return own.join(last, "repo_id", "full").select("repo_id", F.coalesce("files_with_credentials", F.lit(0)).alias("files_with_credentials"), F.coalesce("credentials", F.lit(0)).alias("credentials"), "files_skipped_secret")
