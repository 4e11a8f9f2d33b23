"""op11's work follows what changes: pairs are counted when they arise, words are encoded when they are new, nothing is marked in the plan."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import __spark_entry__
from advisorium.llm import repair

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def alone(docs):
    """How often each pair stands in documents without overlaps."""
    counts: Counter = Counter()
    for own in docs:
        i = 0
        while i < len(own) - 1:
            counts[own[i], own[i + 1]] += 1
            i += 2 if own[i : i + 3] == [own[i]] * 3 else 1
    return counts


def replaced(own, pair, symbol):
    out, i = [], 0
    while i < len(own):
        hit = tuple(own[i : i + 2]) == pair
        out.append(symbol if hit else own[i])
        i += 2 if hit else 1
    return out


@pytest.mark.parametrize("base", [300, 65_530, 1 << 30])
def test_rules_are_those_of_pairs_replaced_one_by_one(base):
    rng = np.random.default_rng(base)
    for letters in ([3, 3, 3, 3, 5], [1, 2, 3, 4, 5, 6, 7, 8], list(range(40)), None):
        sizes = rng.integers(1, 90, 12)
        # without letters: rising symbols, each pair of which overlaps the next
        docs = [rng.choice(letters, n).tolist() if letters else [*range(n), *range(n // 2)] for n in sizes.tolist()] + [[3, 3, 3]]
        ids, ends = np.array(sum(docs, []), np.uint32), np.cumsum([len(x) for x in docs])
        rules, symbols, bounds = repair.grammar(ids, ends, base)
        for number, pair in enumerate(map(tuple, rules.tolist())):
            counts = alone(docs)
            assert counts[pair] >= 2 and 2 * counts[pair] >= max(counts.values())
            docs = [replaced(x, pair, base + number) for x in docs]
        assert symbols.tolist() == sum(docs, []) and bounds.tolist() == np.cumsum([len(x) for x in docs]).tolist()
        assert max(alone(docs).values(), default=0) < 2


def test_a_run_that_holds_a_pair_once_makes_no_rule():
    rules, symbols, _ = repair.grammar(np.array([4, 4, 4], np.uint32), np.array([3]), 100)
    assert not len(rules) and symbols.tolist() == [4, 4, 4]


def test_places_are_counted_when_they_change(monkeypatch):
    seen = []
    for name in ("apart", "picked"):
        own = getattr(repair, name)
        monkeypatch.setattr(repair, name, lambda *x, own=own, at=name == "apart": (seen.append(len(x[int(at)])), own(*x))[1])
    ids = np.minimum(np.random.default_rng(2).zipf(1.3, 200_000), 40_000).astype(np.uint32)
    repair.grammar(ids, np.array([len(ids)]), 50_000)
    assert len(seen) > 60 and sum(seen) < 8 * len(ids)


def test_a_word_is_encoded_once(monkeypatch):
    words, seen = repair.Words(WORDS), []
    own = words.plain
    monkeypatch.setattr(words, "plain", lambda x: (seen.extend(x.split(" ")), own(x))[1])
    texts = ["the cat, the hat", None, "", "The cat\nsat  on\tthe hat", "日本語 the été <|endoftext|>", "x" * 100 + " cat", " "]
    for _ in range(3):
        got = words.encode_all(pa.array(texts))
        assert [x.tolist() for x in got] == [words.of(x or "").tolist() for x in texts]
    assert Counter(seen) - Counter(set(seen)) == {"x" * 100: 2}  # too long to be remembered
    monkeypatch.setattr(repair, "REMEMBERED", 3)
    for text in ["a b c d e", "f a", "g h a 日本", "a"]:
        assert words.encode_all(pa.array([text]))[0].tolist() == words.of(text).tolist()
    assert words.encode_all(pa.array([], pa.string())) == []
    words.ranks = None
    assert words.encode_all(pa.array(["the new cat"]))[0].tolist() == words.of("the new cat").tolist()


def test_texts_are_not_marked_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = repair.shards(docs, WORDS)._jdf.queryExecution().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()
    assert "op11_repair" in __spark_entry__.queries()


def test_pieces_of_words_without_apostrophes():
    words, rng = repair.Words(WORDS), np.random.default_rng(3)
    letters = np.array([*"abzABZ019.,;-!<>|\t\r", " ", " ", "\n", "é", "É", "ß", "ÿ", "the", "ing"], object)
    for more in ([], ["'", "'s"]):
        texts = ["".join(rng.choice([*letters, *more], rng.integers(0, 30))) for _ in range(1500)]
        assert [x.tolist() for x in words.encode_all(pa.array(texts))] == [words.of(x).tolist() for x in texts]
