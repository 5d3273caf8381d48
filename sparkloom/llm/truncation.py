"""Texts cut off by field limits or on the way.

A backward n-gram model over the characters of a folded alphabet tells how a text may end: letters are kept where they belong to words
with few neighbours (the corpus's own phrases), other words, unknown words and numbers are folded to one character each. For
each text the longest context before its end that the corpus knows is compared: how often does it stand anywhere, as it would
before a random cut, and how often before the end of a text or line. These log-odds are combined with other signs of a cut (a mark, a broken
character, an open fence, a length at which texts of the source pile up), whose weights are fitted by expectation and maximisation, and thresholded at
priors estimated per source and language. Each text is tokenised once; what follows works on the numbers of its tokens.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage, spread

#: Longest context, in folded characters.
DEPTH = 7
#: Lengths of contexts of raw characters, which tell a word that was cut inside.
RAW = (6, 8, 12, 16)
#: Only contexts that stand before the end of some text are counted: a filter of BITS bits for each of them, and of at most MOST_BITS in all, keeps most others from the shuffle. It drops none of these.
BITS, MOST_BITS = 64, 1 << 30
#: A word is a phrase word if two of its places have the same neighbour on one side more often than with so many equally frequent neighbours, the
#: same at every size of the corpus; kept are words in at least one in WORDS places, and in LEAST.
NEIGHBOURS, WORDS, LEAST = 6, 200_000, 8
#: Lengths within SPREAD of a length tell how often it is expected; a pile is at least PILE texts and FACTOR times that.
SPREAD, PILE, FACTOR = 30, 5, 6.0
HOT_PARTS = 10_000
#: No source is taken to cut fewer texts than this; a text is reported from this probability.
LEAST_PRIOR, THRESHOLD = 0.02, 0.1
#: Signs of a cut beside the context, and the number of texts of all sources that count beside those of one source.
SIGNS = ("mark", "broken", "fence", "pile")
OWN = 5
#: Places whose contexts are counted at once, about.
AT_ONCE = 400_000

_TOKEN = re.compile(r"[\u2e80-\U0010ffff]|[^\W\d_\u2e80-\U0010ffff]+(?:['’][^\W\d_\u2e80-\U0010ffff]+)*|\d+|[^\w\s]|_|\n+")
_MARK = re.compile(r"\s*(?:…|\.\.\.)?\s*(?:[\[(<{]\s*(?:truncated|cut(?: off)?|more|continued|cont\.?|snip(?:ped)?|shortened|abgeschnitten|gekürzt|tronqué|cortado|…|\.\.\.)[^\])>}\n]{0,20}[\])>}])?\s*$")
#: Each mark ends with one of these.
_MARK_ENDS = ("…", "...", "]", ")", ">", "}")
_FENCE = re.compile(r"(?m)^[ \t]*```")
#: Tokens as numbers: words are below OTHER (30 bits of a checksum of their lower case, so among a billion words few share one), then numbers, line ends and single characters.
OTHER = 1 << 30
NUMBER, LINE = OTHER, OTHER + 1
#: Folded characters: padding before a text, line ends, known words, rare words; others are the numbers of their tokens.
PAD, KNOWN, RARE = OTHER + 2, OTHER + 3, OTHER + 4
_FIRST = OTHER + 5
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_INVERSE = np.uint64(pow(int(_A), -1, 2**64))


class _Numbers(dict):
    """Token -> its number; filled as tokens come."""

    def __missing__(self, t: str) -> int:
        c = t[0]
        if c == "\n":
            n = LINE
        elif c.isdigit():
            n = NUMBER
        elif c.isalpha() and ord(c) < 0x2E80:
            n = zlib.crc32(t.lower().encode()) & (OTHER - 1)
        else:
            n = _FIRST + ord(c)
        if len(self) > 300_000:
            self.clear()
        self[t] = n
        return n


def _clean(text: str) -> str:
    return text.replace("\r\n", "\n").rstrip()


def _bare(whole: str) -> str:
    """The text without a mark of a cut or a broken character at its end."""
    whole = whole.rstrip("\ufffd")
    if not whole.endswith(_MARK_ENDS):
        return whole.rstrip()
    tail = whole[-160:]
    return (whole[: len(whole) - len(tail)] + _MARK.sub("", tail)).rstrip()


def _last_word(text: str) -> int:
    """The length of the word at the very end, 0 if there is none; of long ones it does not matter how long."""
    n = 0
    for c in reversed(text[-64:]):
        if not c.isalpha():
            break
        n += 1
    return n


_READ = "ids binary, marks int, marked boolean, broken boolean, fence boolean, raw string, bare string, word int, bare_word int, pair long, n long"


def tokenised(rows: DataFrame) -> DataFrame:
    """rows and the columns of _READ: of each text (pair null) the numbers of its tokens and what its end looks like, and, of batches, counts of pairs of neighbours."""
    names = [f.name for f in rows.schema.fields if f.name != "text"]
    told = [c.split()[0] for c in _READ.split(", ")][:-2]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Numbers()
        for b in batches:
            out, parts = [], []
            for t in b["text"]:
                whole = _clean(t)
                found = _TOKEN.findall(whole)
                ids = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
                bare = _bare(whole)
                marked = bare != whole
                parts.append(ids)
                out.append((ids.astype("<u4").tobytes(), len(_TOKEN.findall(whole[len(bare) :])) if marked else 0, marked, whole.endswith("\ufffd"), "```" in whole and len(_FENCE.findall(whole)) % 2 == 1, whole[-max(RAW) :], bare[-max(RAW) :], _last_word(whole), _last_word(bare)))
            done = dict(zip(told, map(list, zip(*out)))) if out else {c: [] for c in told}
            yield pd.DataFrame({c: pd.Series(b[c].tolist(), dtype=object) for c in names} | {c: pd.Series(x, dtype=object) for c, x in done.items()} | {"pair": None, "n": None})
            flat = np.concatenate([x for p in parts for x in (p, np.array([-1]))]) if parts else np.zeros(0, np.int64)
            inside = (flat[:-1] >= 0) & (flat[1:] >= 0)
            codes, n = np.unique((flat[:-1][inside] << 31) | flat[1:][inside], return_counts=True)
            nothing = pd.Series([None] * len(codes), dtype=object)
            yield pd.DataFrame({c: nothing for c in (*names, *told)} | {"pair": codes, "n": n})

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInPandas(read, f"{types}, {_READ}")


def vocabulary(read: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of words in order, whether each is a phrase word) of the words that make up at least one in WORDS of all places, of which there are at most WORDS."""
    pairs = cut_lineage(read.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).select(F.shiftright("pair", 31).alias("a"), F.col("pair").bitwiseAND(2**31 - 1).alias("b"), "n"))
    # The share of pairs of a word's places that have the same neighbour, estimated without bias.
    n = F.col("n").cast("double")
    same = F.try_divide(F.sum(n * (n - 1)), F.sum(n) * (F.sum(n) - 1))
    right = pairs.where(F.col("a") < OTHER).groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("n"), same.alias("r"))
    left = pairs.where(F.col("b") < OTHER).groupBy(F.col("b").alias("w")).agg(same.alias("l"))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = right.where((F.col("n") >= LEAST) & (F.col("n") * WORDS >= F.lit(total))).join(left, "w", "left").collect()
    phrase = lambda r: max(r["r"] or 0, r["l"] or 0) * NEIGHBOURS > 1 or r["n"] > total * 0.004
    rows.sort(key=lambda r: r["w"])
    return np.array([r["w"] for r in rows], np.int64), np.array([phrase(r) for r in rows], bool)


def folded(ids: np.ndarray, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The folded characters of tokens: phrase words, single characters and the rest are themselves, other words are KNOWN or RARE."""
    known, phrase = words
    out = ids.astype(np.int64)
    if not len(known):
        return np.where(out < OTHER, RARE, out)
    at = np.minimum(np.searchsorted(known, out), len(known) - 1)
    there = known[at] == out
    return np.where(out >= OTHER, out, np.where(there, np.where(phrase[at], out, KNOWN), RARE))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _B
    h = h ^ (h >> np.uint64(27))
    h = h * _C
    return h ^ (h >> np.uint64(31))


def _symbols(x: np.ndarray, raw: bool) -> np.ndarray:
    return _mixed(x.astype(np.uint64) * _A + np.uint64(77 if raw else 1))


def _raw(text: str) -> np.ndarray:
    """Code points, digits as 0 and line ends as LINE."""
    x = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    x[(x >= 48) & (x < 58)] = 48
    x[x == 10] = LINE
    return x


def last_contexts(tails: np.ndarray, depths, raw: bool) -> np.ndarray:
    """(texts, depths): the contexts that end at the last place of each row of symbols, padded on the left."""
    with np.errstate(over="ignore"):
        h, power, out = np.zeros(len(tails), np.uint64), np.uint64(1), []
        s = _symbols(tails, raw)
        for q in range(1, s.shape[1] + 1):
            h = h + s[:, -q] * power
            power = power * _INVERSE
            if q in depths:
                out.append(_mixed(h + np.uint64(q)))
        return np.stack(out, axis=1) if out else np.zeros((len(tails), 0), np.uint64)


def contexts(texts: list[np.ndarray], depths, raw: bool) -> tuple[Iterator[np.ndarray], np.ndarray]:
    """(of each depth the context that ends at each place, as last_contexts gives it; what follows a place: -1 padding, 0 more, 1 line end, 2 text end)."""
    deepest = max(depths)
    pad = np.full(deepest, PAD, np.int64)
    flat = np.concatenate([x for t in texts for x in (pad, t)])
    size = np.array([len(t) + deepest for t in texts], np.int64)
    last = np.cumsum(size) - 1
    follow = np.zeros(len(flat), np.int8)
    follow[:-1][flat[1:] == LINE] = 1
    follow[last] = 2
    follow[((last - size + 1)[:, None] + np.arange(deepest)).ravel()] = -1

    def each() -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            power, inverse = np.ones(len(flat), np.uint64), np.ones(len(flat), np.uint64)
            power[1:], inverse[1:] = np.cumprod(np.full(len(flat) - 1, _A)), np.cumprod(np.full(len(flat) - 1, _INVERSE))
            sums = np.zeros(len(flat) + 1, np.uint64)
            sums[1:] = np.cumsum(_symbols(flat, raw) * power)
            for q in depths:
                h = np.zeros(len(flat), np.uint64)
                h[q - 1 :] = _mixed((sums[q:] - sums[:-q]) * inverse[q - 1 :] + np.uint64(q))
                yield h

    return each(), follow


def _ends(read: DataFrame, words: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Of each text (part 0) and of each marked text without its mark (part 1) the contexts before its end, by depth, and inside: the last word is unknown or very short, so
    the cut may be inside a word. Depths are 1 to DEPTH, then RAW."""
    shared = read.sparkSession.sparkContext.broadcast(words)
    kept = ["key", "source", "lang", "same", "chars", "bytes", "marks", "marked", "broken", "fence"]
    order = [f.name for f in read.schema.fields if f.name in kept]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [np.frombuffer(x, "<u4") for x in b["ids"]]
            for part in (0, 1):
                own = np.flatnonzero(b["marked"].to_numpy(bool)) if part else np.arange(len(b))
                if not len(own):
                    continue
                tails, raw, left = np.full((len(own), DEPTH), PAD, np.int64), np.full((len(own), max(RAW)), PAD, np.int64), np.zeros(len(own), np.int64)
                cut, texts = b["marks"].to_numpy(), b["bare" if part else "raw"].tolist()
                for i, j in enumerate(own):
                    x = ids[j][: len(ids[j]) - int(cut[j])] if part else ids[j]
                    while len(x) and x[-1] == LINE:
                        x = x[:-1]
                    left[i] = len(x)
                    if len(x):
                        tails[i, -min(DEPTH, len(x)) :] = x[-DEPTH:]
                    t = _raw(texts[j])
                    if len(t):
                        raw[i, -len(t) :] = t
                f = folded(tails, shared.value)
                last = f[:, -1]
                length = b["bare_word" if part else "word"].to_numpy()[own]
                inside = (length > 0) & ((length <= 2) | (last == RARE))
                h = np.concatenate([last_contexts(f, range(1, DEPTH + 1), False), last_contexts(raw, RAW, True)], axis=1).view(np.int64)
                out = pd.DataFrame({c: pd.Series([x for x, on in zip(b[c].iloc[own].tolist(), left > 0) if on], dtype=object) for c in order})
                yield out.assign(part=part, inside=inside[left > 0], contexts=list(h[left > 0]))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields if f.name in kept)
    return read.where("pair IS NULL").select(*kept, "ids", "raw", "bare", "word", "bare_word").mapInPandas(find, f"{types}, part int, inside boolean, contexts array<bigint>")


def ngrams(read: DataFrame, rows: DataFrame, words: tuple[np.ndarray, np.ndarray], ends: DataFrame) -> DataFrame:
    """(context, n, lines, ends) of each context that stands before the end of a text: its places, and those before a line's and a text's end."""
    distinct = ends.select(F.explode("contexts").alias("context")).agg(F.approx_count_distinct("context")).first()[0]
    size = 1 << int(np.clip(np.ceil(np.log2(max(1, distinct) * BITS)), 16, np.log2(MOST_BITS)))
    words_of = ends.select(F.explode("contexts").alias("context")).selectExpr(f"shiftright(context & {size - 1}, 6) AS w", "shiftleft(1L, CAST(context & 63 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most MOST_BITS / 64 rows
    bits = np.zeros(size // 64, np.uint64)
    bits[words_of["w"].to_numpy(np.int64)] = words_of["b"].to_numpy(np.int64).view(np.uint64)
    shared = read.sparkSession.sparkContext.broadcast((words, bits.view(np.uint8)))

    def counted(texts: Iterator[np.ndarray], depths, raw: bool) -> Iterator[pd.DataFrame]:
        passed = shared.value[1]
        held, places = [], 0

        def out():
            each, follow = contexts(held, depths, raw)
            real = follow >= 0
            kinds = follow[real]
            for h in each:
                h = h[real]
                low = h & np.uint64(size - 1)
                on = (passed[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
                own = kinds[on]
                at, u = pd.factorize(h[on])  # hashed, not sorted
                yield pd.DataFrame({"context": u.view(np.int64), "n": np.bincount(at, minlength=len(u)), "lines": np.bincount(at, own == 1, len(u)).astype(np.int64), "ends": np.bincount(at, own == 2, len(u)).astype(np.int64)})

        for t in texts:
            if len(t):
                held.append(t)
                places += len(t)
            if places >= AT_ONCE:
                yield from out()
                held, places = [], 0
        if held:
            yield from out()

    def of_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value[0]

        def texts() -> Iterator[np.ndarray]:
            for b in batches:
                for x in b["ids"]:
                    yield folded(np.frombuffer(x, "<u4"), own)

        return counted(texts(), tuple(range(1, DEPTH + 1)), False)

    def of_letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return counted((_raw(_clean(t)) for b in batches for t in b["text"]), RAW, True)

    schema = "context long, n long, lines long, ends long"
    found = read.where("pair IS NULL").select("ids").mapInPandas(of_tokens, schema).unionByName(rows.select("text").mapInPandas(of_letters, schema))
    return found.groupBy("context").agg(F.sum("n").alias("n"), F.sum("lines").alias("lines"), F.sum("ends").alias("ends"))


def piles(docs: DataFrame) -> DataFrame:
    """(source, length, unit, odds) of the lengths in characters or bytes at which texts of a source pile up."""
    out = None
    for unit in ("chars", "bytes"):
        # Copies of one text are no pile.
        counts = docs.select("source", F.col(unit).alias("length"), "same").distinct().groupBy("source", "length").agg(F.count("*").alias("c"))
        near = Window.partitionBy("source").orderBy("length").rangeBetween(-SPREAD, SPREAD)
        # Long texts are rare, so what is near a length is few rows; the source's lengths, not its texts, are in one window.
        near_by = counts.withColumn("e", (F.sum("c").over(near) - F.col("c")) / (2 * SPREAD)).withColumn("e", F.greatest("e", F.lit(0.25)))
        beyond = Window.partitionBy("source").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
        near_by = near_by.withColumn("longer", F.coalesce(F.sum("c").over(beyond), F.lit(0)))
        own = near_by.where((F.col("longer") <= 0.2 * F.col("c")) & (F.col("c") >= PILE) & (F.col("c") >= FACTOR * F.col("e")) & (F.col("length") >= 64)).select("source", "length", F.lit(unit).alias("unit"), (F.col("c") / F.col("e") - 1).alias("odds"))
        out = own if out is None else out.unionByName(own)
    return out


def scored(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(key, source, lang, ratio, mark, broken, fence, pile) of each text that is not blank: the likelihood ratio of being cut by the context of its end, and the other signs.

    Null, empty and blank texts have no row. Texts repeated under other keys have equal ratios; their own ends are left out of the
    counts they are compared with. A null source or language is one of its own.
    """
    rows = df.where(F.col(text).rlike(r"\S")).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"), F.lower(F.coalesce(F.col(lang), F.lit("und"))).alias("lang"))
    rows = spread(rows).select("*", F.xxhash64("text").alias("same"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    read = cut_lineage(tokenised(rows))
    words = vocabulary(read)
    ends = cut_lineage(_ends(read, words))
    counts = cut_lineage(ngrams(read, rows, words, ends))
    shape = read.where("pair IS NULL").select("source", "same", "chars", "bytes", "marked", F.octet_length("ids").alias("tokens"))
    total = shape.agg(F.count("*").alias("texts"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
    texts, places, letters = total["texts"], total["tokens"] // 4, total["chars"]
    copies = shape.groupBy("same").agg(F.count("*").alias("copies"))
    state = ["key", "source", "lang", "same", "chars", "bytes", "marks", "marked", "broken", "fence", "part", "inside"]
    each = ends.select("key", "same", "part", "marked", F.posexplode("contexts").alias("at", "context"))
    # Contexts at the end of many texts, part 0 or 1: at most twice DEPTH + len(RAW) times HOT_PARTS.
    often = each.groupBy("context").agg(F.count("*").alias("c")).where(F.col("c") * HOT_PARTS >= F.lit(texts)).select("context")
    hot = F.broadcast(counts.join(F.broadcast(often), "context"))
    marked = each.join(hot, "context", "left")
    cold = marked.where("n IS NULL").drop("n", "lines", "ends").join(counts, "context", "left")
    looked = marked.where("n IS NOT NULL").unionByName(cold.select(marked.columns)).join(copies, "same")

    # The deepest context that stands in at least five places besides the text's own; of folded and of raw characters.
    told, letter = F.col("n") - F.col("copies") >= 5, F.col("at") >= DEPTH
    found = F.struct("n", "lines", "ends")
    per = looked.groupBy("key", "same", "part").agg(
        F.max_by(F.struct(found.alias("c"), (F.col("at") + 1).alias("d")), F.when(told & ~letter, F.col("at"))).alias("b"),
        F.max_by(found, F.when(told & letter, F.col("at"))).alias("w"),
        F.min_by(found, F.when(~letter, F.col("at"))).alias("first"),
        F.max("copies").alias("copies"),
        F.collect_list(F.when(F.col("marked") & ~letter, F.struct("at", "n", "ends"))).alias("each"),
    )
    per = ends.select(*state).distinct().join(per, ["key", "same", "part"])

    def ratio_of(b, of: int):
        """How much likelier the context is before a random cut than before an end; the text's own end and its copies' do not count."""
        own = F.when(F.col("part") == 0, F.col("copies")).otherwise(0)
        here = F.greatest(F.coalesce(b["n"], F.lit(0)) - own, F.lit(0)) + 0.5
        ended = F.greatest(F.coalesce(b["ends"], F.lit(0)) - own, F.lit(0)) + F.coalesce(b["lines"], F.lit(0)) * F.lit(0.05) + F.lit(0.5 * texts / max(1, of))  # as one place in two would have by chance
        return (here / F.lit(float(max(1, of)))) / (ended / F.lit(float(max(1, texts))))

    best = F.coalesce(F.col("b.c"), F.col("first"))
    inner = F.when(F.col("inside") & F.col("w").isNotNull(), ratio_of(F.col("w"), letters))
    per = per.withColumn("r", F.coalesce(inner, ratio_of(best, places)))  # folding an unknown word says less than its letters
    one = per.groupBy("key", "same").agg(*(F.first(x).alias(x) for x in ("source", "lang", "chars", "bytes", "marks", "marked", "broken", "fence", "copies")),
        F.max(F.when(F.col("part") == 0, F.col("r"))).alias("whole"), F.max(F.when(F.col("part") == 1, F.col("r"))).alias("bare"), *(F.max(F.when(F.col("part") == i, F.col("each"))).alias(x) for i, x in enumerate(("with_mark", "before_mark"))))
    heaps = piles(shape)
    for unit in ("chars", "bytes"):
        own_unit = heaps.where(F.col("unit") == unit).select(F.col("source").alias("_s"), F.col("length").alias(unit), F.col("odds").alias(f"odds_{unit}"))
        one = one.join(own_unit, one["source"].eqNullSafe(own_unit["_s"]) & (one[unit] == own_unit[unit]), "left").drop("_s").drop(own_unit[unit])
    # A mark speaks for a cut unless texts end with it regularly after the same words: more often, of the places of these words, than marks after any words of the source would have it.
    # The words are the deepest context before the mark that is told and that fits before it.
    rate = shape.groupBy("source").agg((F.sum(F.col("marked").cast("int")) * 4 / F.sum("tokens")).alias("rate")).withColumnRenamed("source", "_s")
    one = one.join(rate, one["source"].eqNullSafe(rate["_s"]), "left").drop("_s")
    before = F.array_max(F.filter("before_mark", lambda x: (x["at"] + F.col("marks") < DEPTH) & (x["n"] - F.col("copies") >= 5)))
    one = one.withColumn("before", before)
    after = F.get(F.filter("with_mark", lambda x: x["at"] == F.col("before.at") + F.col("marks")), F.lit(0))["ends"] - F.col("copies")
    usual = F.coalesce((after >= 3) & (after > FACTOR * F.col("rate") * F.col("before.n")), F.lit(False))
    mark = F.col("marked") & ~F.col("broken") & ~usual
    ratio = F.when(mark | F.col("broken"), F.greatest("whole", "bare")).otherwise(F.col("whole"))
    return one.select(F.col("key").alias(key), "source", "lang", F.greatest(F.least(ratio, F.lit(1e9)), F.lit(1e-9)).alias("ratio"), mark.alias("mark"), "broken", "fence", (F.coalesce(F.greatest("odds_chars", "odds_bytes"), F.lit(0.0)) > 0).alias("pile"))


def fitted(ratios: DataFrame, steps: int = 60) -> dict[tuple[str | None, str], tuple[float, dict[str, tuple[float, float]]]]:
    """(source, lang) -> share of cut texts, and of each sign the log-odds of a cut where it is there and where not, by expectation and maximisation.

    A text is cut or not; given that and its source, the ratio of its context and its signs are taken as independent. The ratio is known, the share of cut
    texts with each sign, of whole ones with it, and the shares of cut texts are estimated on ratios binned by their logarithm. What a source alone says
    counts beside OWN texts of all sources.
    """
    bins = ratios.groupBy("source", "lang", F.round(F.log("ratio") * 4).alias("b"), *SIGNS).agg(F.count("*").alias("n")).collect()  # at most 166 x 2 ** len(SIGNS) for each source and language
    if not bins:
        return {}
    x, n = np.array([r["b"] for r in bins]) / 4, np.array([r["n"] for r in bins], float)
    f = np.array([[r[s] for s in SIGNS] for r in bins], float)
    sources = {s: i for i, s in enumerate(dict.fromkeys(r["source"] for r in bins))}
    pairs = {p: i for i, p in enumerate(dict.fromkeys((r["source"], r["lang"]) for r in bins))}
    of_source, of_pair = np.array([sources[r["source"]] for r in bins]), np.array([pairs[r["source"], r["lang"]] for r in bins])
    share = np.full(len(sources), LEAST_PRIOR)
    there, absent = np.zeros((len(sources), len(SIGNS))), np.zeros((len(sources), len(SIGNS)))

    def posterior(p: np.ndarray) -> np.ndarray:
        z = x + (f * there[of_source] + (1 - f) * absent[of_source]).sum(axis=1) + np.log(p / (1 - p))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def rates_of(w: np.ndarray) -> np.ndarray:
        """The share of each sign among texts of these weights, by source, drawn to that of all sources."""
        all_ = (w @ f + 0.5) / (w.sum() + 1)
        own = np.stack([np.bincount(of_source, w * f[:, j], len(sources)) for j in range(len(SIGNS))], axis=1)
        return (own + OWN * all_) / (np.bincount(of_source, w, len(sources)) + OWN)[:, None]

    for _ in range(steps):
        q = posterior(share[of_source])
        share = np.clip((np.bincount(of_source, n * q) + LEAST_PRIOR) / (np.bincount(of_source, n) + 1), LEAST_PRIOR, 0.9)
        cut, whole = rates_of(n * q), rates_of(n * (1 - q))
        there, absent = np.log(cut / whole), np.log((1 - cut) / (1 - whole))
    start = share[[sources[s] for s, _ in pairs]]
    own = start.copy()
    for _ in range(30):
        q = posterior(own[of_pair])
        own = np.clip((np.bincount(of_pair, n * q) + 50 * start) / (np.bincount(of_pair, n) + 50), LEAST_PRIOR, 0.9)
    return {p: (float(own[i]), {s: (float(there[sources[p[0]], j]), float(absent[sources[p[0]], j])) for j, s in enumerate(SIGNS)}) for p, i in pairs.items()}


def truncated(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(key, source, lang, probability) of the texts whose probability of being cut exceeds THRESHOLD."""
    ratios = cut_lineage(scored(df, key, text, source, lang))
    columns = [f"{s}_{w}" for s in SIGNS for w in ("there", "absent")]
    told = [(s, la, p, *(w for x in SIGNS for w in signs[x])) for (s, la), (p, signs) in fitted(ratios).items()]  # a row for each source and language
    table = df.sparkSession.createDataFrame(told, "_s string, _l string, p double, " + ", ".join(f"{c} double" for c in columns))
    joined = ratios.join(F.broadcast(table), ratios["source"].eqNullSafe(table["_s"]) & (ratios["lang"] == table["_l"]))
    prior = F.log(F.col("p") / (1 - F.col("p")))
    for s in SIGNS:
        prior = prior + F.when(F.col(s), F.col(f"{s}_there")).otherwise(F.col(f"{s}_absent"))
    # A source that leaves a sign on its own cuts still has texts that were cut on the way, without it.
    odds = F.log("ratio") + F.greatest(prior, F.lit(math.log(LEAST_PRIOR / (1 - LEAST_PRIOR))))
    return joined.select(key, "source", "lang", (1 / (1 + F.exp(-odds))).alias("probability")).where(F.col("probability") > THRESHOLD)


def rates(df: DataFrame, found: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(source, documents, truncated, share) of every source; documents without text count among its documents."""
    all_ = df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("documents"))
    cut = found.select(key, "source").distinct().groupBy("source").agg(F.count("*").alias("truncated"))
    joined = all_.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return joined.select("source", "documents", F.coalesce("truncated", F.lit(0)).alias("truncated"), (F.coalesce("truncated", F.lit(0)) / F.col("documents")).alias("share"))
