import os

import pytest

from sparkloom.llm import packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.rank_file()), reason="no tokenizer files")
TEXTS = [None, "", " ", "Hello  world\r\n\tfoo", "naïve 漢字 🚀👩‍💻 ١٢٣ don't", "<|endoftext|> a", "a" * 30_000, "\u00a0\u2003x \u200b", "the the the " * 500, "x\n\n\n  y", "a\x01b \x02\x02a\x02b\x01", "\x01"]


def frame(spark):
    return spark.createDataFrame([(i, t, "k", 1, "w") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "k", 1, "w")], "doc_id long, text string, _key string, _pos int, ids string")


def test_ids_equal_the_tokenizer_and_come_back(spark):
    enc = tokens.encoding(tokens.rank_file())
    encoded = tokens.encode_corpus(frame(spark))
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert encoded.count() == len(TEXTS)
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_a_hot_word_and_rare_ones_join_alike(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HOT_PARTS", 3)
    enc = tokens.encoding(tokens.rank_file())
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(frame(spark)).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}


def test_of_several_texts_of_a_key_one_counts(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b c"), (1, "a b c"), (1, None), (None, "x"), (None, None), (2, None), (2, None)], "doc_id long, text string")
    enc = tokens.encoding(tokens.rank_file())
    want = {1: enc.encode_ordinary("a b c"), None: enc.encode_ordinary("x"), 2: []}
    assert {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()} == want and tokens.encode_corpus(df).count() == 3
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()} == {k: len(v) for k, v in want.items()}


def test_empty_table(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_corpus(e).count() == 0 and tokens.count_tokens(e).count() == 0


def test_packing_is_whole_and_tight(spark):
    sizes = [None, 0, 0, 5000, 2048, 4096] + [(i * 37) % 700 + 1 for i in range(4000)]
    items = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id long, n_tokens long, container_id string")
    rows = packing.pack(items).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["n_tokens"]
        if r["container_id"] is not None:
            by_bin.setdefault(r["container_id"], []).append((r["start"], r["n_tokens"], r["container_tokens"]))
    assert by_doc == {i: n or 0 for i, n in enumerate(sizes)}
    total = 0
    for parts in by_bin.values():
        parts.sort()
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        assert parts[-1][0] + parts[-1][1] <= parts[0][2] <= 2048
        total += parts[0][2]
    assert sum(by_doc.values()) / total > 0.99
    whole = [r for r in rows if r["doc_id"] not in (3, 5)]
    assert len({r["doc_id"] for r in whole}) == len(whole)


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
    assert [r["container_id"] for r in packing.pack(spark.createDataFrame([(1, 0)], "doc_id long, n_tokens long")).collect()] == [None]


def test_equal_sizes_are_ranked_over_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    rows = packing.pack(spark.createDataFrame([(i, 512) for i in range(1001)], "doc_id long, n_tokens long")).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["container_id"], []).append(r["start"])
    assert len(rows) == 1001 and len(bins) == 251 and all(sorted(s) == [512 * i for i in range(len(s))] for s in bins.values())
