"""Tokenization automaton against the tokenizers library and against merges applied in order."""

import hashlib
import pickle
import random

import numpy as np
import pytest

from formweave.llm import bpe, q_bpe
from formweave.llm.bpe_automaton import TokenAutomaton

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(q_bpe.TOKENIZER)


@pytest.fixture(scope="module")
def codec():
    return pickle.loads(pickle.dumps(bpe.codec(PATH)))


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


def left_to_right(word, merges):
    """Merges one after the other, each from left to right without overlaps."""
    tokens = list(word)
    for u, v in merges:
        out, k = [], 0
        while k < len(tokens):
            if tokens[k : k + 2] == [u, v]:
                out.append(u + v)
                k += 2
            else:
                out.append(tokens[k])
                k += 1
        tokens = out
    return tokens


def test_automaton_accepts_what_the_merges_give():
    rng = random.Random(5)
    for _ in range(30):
        merges, made = [], ["a", "b", "c"]
        text = "".join(rng.choice("aab" "abc") for _ in range(400))
        while len(merges) < 25:  # as training does: a pair that occurs, in a token that is new
            now = left_to_right(text, merges)
            pairs = [(x, y) for x, y in zip(now, now[1:], strict=False) if x + y not in made and len(x + y) < 9]
            if not pairs:
                break
            merges.append(rng.choice(pairs))
            made.append("".join(merges[-1]))
        a = TokenAutomaton(["a", "b", "c"], merges)
        place = {t: k for k, t in enumerate(a.tokens)}
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(200)] + ["a" * 13, "ab" * 7]
        want = [left_to_right(w, merges) for w in words]
        assert [[a.tokens[t] for t in a.encode(w)] for w in words] == want
        tokens, counts = a.encode_many(words)
        assert [a.tokens[t] for t in tokens] == [t for w in want for t in w] and counts.tolist() == [len(w) for w in want]
        for w in want:  # a state has the arc of a token exactly where the two stay apart
            assert all(a.follows(place[x], place[y]) for x, y in zip(w, w[1:], strict=False))
        for x in made:
            for y in made:
                assert a.follows(place[x], place[y]) == (left_to_right(x + y, merges) == [x, y])


def test_improper_merges_are_refused():
    with pytest.raises(ValueError):
        TokenAutomaton(["a", "b"], [("ab", "a"), ("a", "b")][::-1] + [("a", "b")])
    with pytest.raises(ValueError):
        TokenAutomaton(["a", "b"], [("a", "b"), ("a", "b")])


POOL = [*"aaabcdeeinthsr's 0129.,!?-_<|>", "'ll", "'re", "<|endoftext|>", "<|startoftext|>", "the", "ing", "é", "é", "İ", "Σ", "ß", "\xa0", " ", "\x85",
        "\x1c", "\t", "\n", "中", "\U0001f600", "؀", "ก", "ſ", "K", "Å", "\x00", "\x7f", "²", "½", "١", "ª", "º", "µ", "×", "÷", "ͅ", "ǅ", "ﬁ", "​", "가"]


def test_same_as_the_library(codec, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["", None, "a" * 30000, "haha" * 9000, "!" * 20000, "".join(rng.choice("etaoinshr") for _ in range(40000)), "x" * 63 + " " + "é" * 65]
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
    assert got == [w.ids for w in want]
    assert [codec.decode(x) for x in got] == [library.decode(w.ids, skip_special_tokens=False) for w in want]
    assert codec.decode([320, 10**6, 320]) == library.decode([320, 10**6, 320], skip_special_tokens=False)


def test_kept_chunks_do_not_matter(codec, monkeypatch):
    texts = [f"word{k} other{k % 7}, 'll é{k}" for k in range(300)]
    want = codec.encode(texts)
    monkeypatch.setattr(bpe, "KNOWN", 20)
    monkeypatch.setattr(bpe, "PORTION", 100)
    monkeypatch.setattr(bpe, "WORDS", 3)
    fresh = pickle.loads(pickle.dumps(codec))
    assert fresh.encode(texts) == want and fresh.encode(texts[::-1]) == want[::-1]


def test_query(spark, tmp_path, library):
    rows = [(1, "The Quick, brown fox", "x"), (1, "The Quick, brown fox", "x"), (None, None, None), (2, "", "y"), (3, "naïve <|endoftext|> Σας " * 3000, None), (4, "a" * 20000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, q_bpe.op13(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_columns_empty_tables_and_clashes(spark, codec):
    df = spark.createDataFrame([(1, "a b", 2.5), (2, None, None)], "k int, text string, other double")
    out = bpe.decoded(bpe.encoded(df, codec), codec)
    assert out.columns == ["k", "text", "other", "ids", "decoded"]
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, "a b", 2.5, [320, 321], "a</w> b</w>"), (2, None, None, [], "")]
    assert bpe.encoded(df.limit(0), codec).collect() == []
    with pytest.raises(ValueError):
        bpe.encoded(df.withColumnRenamed("other", "ids"), codec)
