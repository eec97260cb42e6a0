import base64
import random
import string
import time
from pathlib import Path

import pytest

from threadloom.llm import packing, tokens

pytestmark = pytest.mark.skipif(not Path(tokens.TOKENIZERS).exists(), reason="no tokenizers")
TEXTS = ["Hello  world\n\tfoo's bar 12345 don't", "aaaa aaa aa", "a" * 3001, " " * 500, "é ü ß 漢字 😀 \x00\x7f", "<|endoftext|> x", "", None, "the the the", "\n\n \n"]


def _reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids(spark):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "doc_id BIGINT, text STRING, ids ARRAY<INT>")
    got = {r.doc_id: list(r.ids) for r in tokens.token_ids(df).collect()}
    assert [got[i] for i in range(len(TEXTS))] == _reference(TEXTS)
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_cache_can_be_cleared(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "QUERY_BYTES", 10)
    e = tokens.Encoder()
    for _ in range(3):
        assert e.encode(TEXTS) == _reference(TEXTS)


def _words():
    rng = random.Random(3)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    return [some(20_000, string.ascii_lowercase), some(8_000, string.digits), base64.b64encode(rng.randbytes(20_000)).decode(), some(3_000, "漢字日本語中文"), "abc" * 3_333 + "th" * 500 + "0" * 777, "-" * 9_001, some(1_000_000, string.ascii_letters)]


def test_long_words_are_exact_and_take_linear_time():
    words = _words()
    e = tokens.Encoder()
    began = time.process_time()
    got = e.encode(words)
    assert time.process_time() - began < 60 and not Path(".tmp").exists()
    assert got == _reference(words)


def test_blocks_that_share_no_token(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 5)
    monkeypatch.setattr(tokens, "OVERLAP", 3)
    monkeypatch.setattr(tokens, "LONG", 10)
    monkeypatch.setattr(tokens, "ROUNDS", 2)
    words = [w[:700] for w in _words()] + ["internationalization" * 9]
    assert tokens.Encoder().encode(words) == _reference(words)


def _packed(spark, sizes, capacity=10, **more):
    df = spark.createDataFrame([(i, " a" * n if n is not None else None) for i, n in enumerate(sizes)], "doc_id BIGINT, text STRING").repartition(3)
    kinds = spark.createDataFrame([("short", capacity), ("none", None), ("zero", 0)], "container_kind STRING, capacity_tokens INT")
    return packing.pack(df, kinds, **more).collect(), kinds


def test_packing(spark):
    random.seed(2)
    sizes = [random.randint(0, 14) for _ in range(400)] + [None, 35, 30]
    rows, kinds = _packed(spark, sizes, windows=4)
    load, parts = {}, {}
    for r in rows:
        assert r.container_kind == "short"
        load[r.container] = load.get(r.container, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    assert max(load.values()) <= 10 and set(parts) == set(range(len(sizes)))
    for i, n in enumerate(sizes):
        got = sorted(parts[i])
        assert sum(k for _, k in got) == (n or 0) and (len(got) == 1 or n > 10)
        assert [s for s, _ in got] == [10 * k for k in range(len(got))]
    assert sum(load.values()) / (10 * len(load)) > 0.9


def test_more_kinds_than_one_pass_takes(spark, monkeypatch):
    monkeypatch.setattr(packing, "KINDS", 3)
    df = spark.createDataFrame([(i, " a" * (i % 9)) for i in range(40)], "doc_id BIGINT, text STRING")
    kinds = spark.createDataFrame([(f"k{i % 4}", 5 + i) for i in range(8)] + [(None, 7)], "container_kind STRING, capacity_tokens INT")
    got = packing.pack(df, kinds.where("capacity_tokens < 9")).groupBy("container_kind").count().collect()
    assert {r.container_kind: r["count"] >= 40 for r in got} == {f"k{i}": True for i in range(4)}


def test_packing_nothing(spark):
    rows, kinds = _packed(spark, [])
    assert rows == [] and packing.fill(spark.createDataFrame([], packing.ROWS), kinds).count() == 0
