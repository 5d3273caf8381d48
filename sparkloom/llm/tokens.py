"""Encoding a corpus with a public byte-level BPE tokenizer.

Texts are cut into pre-tokens in the JVM. Each distinct pre-token of the corpus is encoded once; its ids are joined back to
the places where it occurs and put together by position. Pre-tokens that make up at least one in ``HOT_PARTS`` of all places
are at most ``HOT_PARTS`` in number and so are broadcast; the rest, none of which is hot, is joined by a shuffle.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage, spread

#: Where the files of the public tokenizers are.
TOKENIZERS = os.environ.get("SPARKLOOM_TOKENIZERS", "/opt/tokenizers")
#: The pattern by which byte_bpe_50k splits text, as fixed by the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for Java, whose \\s is that of ASCII: Unicode's white space is spelled out.
_SPACE = r"\t-\r\x85\p{Z}"
JAVA_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
HOT_PARTS = 10_000
#: Longer pre-tokens are never broadcast, which bounds the broadcast in bytes too.
HOT_CHARS = 64


def rank_file(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoding_of(ranks: dict[bytes, int]):
    """The tokenizer of ranks. Strings of special tokens are ordinary text."""
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file."""
    return encoding_of(_ranks(path))


#: The tokenizers of a worker by rank file.
_encodings: dict = {}


def pretokens(text: Column) -> Column:
    """The pre-tokens of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))


#: Between the pre-tokens of a text, once it is cut; where a text holds this character or the next one, they are written as the two of ESCAPED.
_END, _ESCAPE = "\x01", "\x02"
ESCAPED = {_ESCAPE: _ESCAPE + "b", _END: _ESCAPE + "a"}


def cut(text: Column) -> Column:
    """The text with an end mark after each pre-token: cut once, it is split again at the mark for next to nothing."""
    plain = F.regexp_replace(text, JAVA_PATTERN, "$0" + _END)
    escaped = lambda w: F.replace(F.replace(w, F.lit(_ESCAPE), F.lit(ESCAPED[_ESCAPE])), F.lit(_END), F.lit(ESCAPED[_END]))
    marked = F.array_join(F.transform(pretokens(text), lambda w: F.concat(escaped(w), F.lit(_END))), "")
    return F.when(text.contains(_END) | text.contains(_ESCAPE), marked).otherwise(plain)


def _places(kept: DataFrame) -> DataFrame:
    """(_key, _pos, _word) of every pre-token of texts that are cut (_key, _cut)."""
    word = F.col("_w")
    whole = F.when(word.contains(_ESCAPE), F.replace(F.replace(word, F.lit(ESCAPED[_END]), F.lit(_END)), F.lit(ESCAPED[_ESCAPE]), F.lit(_ESCAPE))).otherwise(word)
    return kept.select("_key", F.posexplode(F.split("_cut", _END)).alias("_pos", "_w")).where("_w != ''").select("_key", "_pos", whole.alias("_word"))


def dictionary(places: DataFrame, path: str) -> DataFrame:
    """Each distinct pre-token (_word) with the number of its places (_n) and its ids (_ids). The rank file, of fixed size, is read on the driver alone."""
    ranks = places.sparkSession.sparkContext.broadcast(_ranks(path))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encodings.get(path)
        if enc is None:
            enc = _encodings[path] = encoding_of(ranks.value)
        for b in batches:
            # A pre-token is one piece of the pattern, so its ids do not depend on its neighbours.
            yield b.assign(_ids=[enc.encode_ordinary(w) for w in b["_word"]])

    words = places.select("_word").groupBy("_word").agg(F.count("*").alias("_n"))
    return words.mapInPandas(encode, "_word string, _n long, _ids array<int>")


def one_text(rows: DataFrame) -> DataFrame:
    """(_k, _t) with each key once: of several texts of a key the longest counts, of equally long ones that of the larger hash. A null key is a key."""
    seen = rows.select(F.col("_k").alias("_k2"), F.coalesce(F.length("_t"), F.lit(-1)).alias("_n"), F.xxhash64("_t").alias("_h"))
    again = seen.groupBy("_k2").agg(F.count("*").alias("_c"), F.max(F.struct("_n", "_h")).alias("_x")).where("_c > 1").select("_k2", "_x.*")
    again = cut_lineage(again)
    alone = rows.join(again, F.col("_k").eqNullSafe(F.col("_k2")), "left_anti")
    best = rows.join(again, F.col("_k").eqNullSafe(F.col("_k2")) & (F.coalesce(F.length("_t"), F.lit(-1)) == F.col("_n")) & (F.xxhash64("_t") == F.col("_h")))
    return alone.unionByName(best.select("_k", "_t").dropDuplicates(["_k"]))


def _kept(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _cut): each key's text, cut; an empty or null one is null."""
    rows = one_text(spread(df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))))
    return cut_lineage(rows.select(F.col("_k").alias("_key"), F.when(F.length("_t") > 0, cut(F.col("_t"))).alias("_cut")))


def _joined(kept: DataFrame, path: str) -> tuple[DataFrame, int]:
    """((_key, _pos, _ids) of every pre-token of every text, the most ids that one of them has)."""
    words = cut_lineage(dictionary(_places(kept), path))
    told = words.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.max(F.size("_ids")), F.lit(1)).alias("most")).first()
    is_hot = (F.col("_n") * HOT_PARTS >= F.lit(told["n"])) & (F.length("_word") <= HOT_CHARS)
    hot = F.broadcast(words.where(is_hot).select("_word", "_ids"))
    places = _places(kept)
    cold = places.join(hot, "_word", "left_anti").join(words.where(~is_hot).select("_word", "_ids"), "_word")
    return places.join(hot, "_word").select("_key", "_pos", "_ids").unionByName(cold.select("_key", "_pos", "_ids")), told["most"]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every text.

    Null and empty texts give the empty list; texts of any length are encoded whole. Each key gives one row: of several texts
    of a key the longest counts, of equally long ones that of the larger hash. A null key is a key like any other. Other columns of df do not matter.
    """
    path = path or rank_file()
    kept = _kept(df, key, text)
    found, most = _joined(kept, path)
    # An id and its place in one number, so that a list of them is sorted and shuffled as plain numbers: the place of its pre-token, its place in it, itself.
    bits = max(_ranks(path).values()).bit_length()
    room = 1 << (63 - bits)
    each = found.select("_key", "_pos", F.posexplode("_ids").alias("_sub", "_id"))
    place = F.col("_pos").cast("long") * most + F.col("_sub")
    code = F.when(F.col("_pos") < room // most, F.shiftleft(place, bits).bitwiseOR(F.col("_id").cast("long"))).otherwise(F.raise_error(F.lit("a text of too many pre-tokens")).cast("long"))
    codes = each.select("_key", code.alias("_code")).unionByName(kept.select("_key", F.lit(None).cast("long").alias("_code")))
    lists = codes.groupBy("_key").agg(F.sort_array(F.collect_list("_code")).alias("_all"))
    return lists.select(F.col("_key").alias(key), F.transform("_all", lambda x: x.bitwiseAND((1 << bits) - 1).cast("int")).alias("ids"))


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens): as encode_corpus, but only the number of ids, so no list is ever built."""
    kept = _kept(df, key, text)
    found, _ = _joined(kept, path or rank_file())
    counts = found.select("_key", F.size("_ids").alias("_n")).unionByName(kept.select("_key", F.lit(0).alias("_n")))
    return counts.groupBy(F.col("_key").alias(key)).agg(F.sum("_n").alias("n_tokens"))


def token_table(spark, path: str | None = None) -> DataFrame:
    """(token, bytes): the vocabulary, of fixed size."""
    rows = [(rank, bytearray(token)) for token, rank in _ranks(path or rank_file()).items()]
    return spark.createDataFrame(rows, "token int, bytes binary")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text) from lists of ids: each id is joined to its bytes, which are put together by position.

    An empty or null list gives the empty text. Ids that are not in the vocabulary give no bytes.
    """
    places = encoded.select(F.col(key).alias("_k"), F.posexplode(ids).alias("_pos", "token"))
    joined_ = places.join(F.broadcast(token_table(encoded.sparkSession, path)), "token")
    parts = joined_.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_pos", F.hex("bytes").alias("h")))).alias("_all"))
    text = F.decode(F.unhex(F.array_join(F.transform("_all", lambda x: x["h"]), "")), "UTF-8")
    texts = parts.select(F.col("_k").alias("_k2"), text.alias("text"))
    return encoded.select(F.col(key).alias("_k")).distinct().join(texts, F.col("_k").eqNullSafe(F.col("_k2")), "left").select(F.col("_k").alias(key), F.coalesce("text", F.lit("")).alias("text"))
