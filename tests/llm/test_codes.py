"""Shards of token ids, vector codes and spelling variants against brute force, and on nulls, ties, repeats and empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from advisorium.llm import annular, repair, variants

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (5, "Some words, and some words again: it's the l'été of '95s ÿ"), (2, None), (3, ""), (None, "no id"), (None, "no id"), (1, "日本語 😀 Ａé x́ <|endoftext|> İstanbul"), (4, "a b " * 6000), (4, "a b " * 6000), (4, "other"),
    (7, "x\x01y \x1c 1½ ª"), (8, "'s's 's x''s don'T THE'RE -'m"), (9, "z" * 5000), (-3, " \n\t "),
]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(WORDS)
    return lambda text: np.array(found.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def told(rows, library):
    """doc_id, start, n_tokens, crc in order of id, nulls first."""
    out, start = [], 0
    for doc, ids in sorted(((d, library(t)) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((doc, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_shards_give_back_the_librarys_ids(spark, library, monkeypatch, tmp_path):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for name in ("part", "start", "body", "doc", "hash", "row"):
        docs = docs.withColumn(name, F.lit("clash"))
    files = repair.written(docs, WORDS, str(tmp_path / "shards"))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in repair.read_back(files).collect()))
    want = told(TEXTS, library)
    assert sorted((x[1:] for x in got), key=str) == sorted(want, key=str)
    assert [x[1] for x in got] == [x[0] for x in want]
    ends = np.cumsum([0] + [x[2] for x in got])
    assert [x[0] for x in got] == ends[:-1].tolist()
    assert repair.read_back(repair.written(docs.where("1 = 0"), WORDS)).count() == 0


def test_shards_of_whole_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: library(r.text) for r in docs.collect()}
    got = __spark_entry__.queries()["op11_repair"](spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {d: (len(x), zlib.crc32(x.tobytes())) for d, x in want.items()}
    start = 0
    for r in sorted(got, key=lambda r: r.doc_id):
        assert r.start == start
        start += r.n_tokens


def test_random_texts_are_encoded_as_the_library_does(library):
    words = repair.words_of(WORDS)
    assert words.by_word and words.ranks
    rng = np.random.default_rng(5)
    plain = np.array([*"abcxyzABC019'.,;-!?|<>\n\t", " ", " ", "é", "ÀÉ", "ß", "'s", "'re", "the ", "ing"], object)
    odd = np.array([*map(chr, range(0x250)), "日", "😀", "½", "\u2028", "\u3000", "<|endoftext|>", "<|startoftext|>", "<|endof", "Σ", "ς"], object)
    for letters, sure in ((plain, True), (odd, False)):
        for text in ("".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(2000)):
            marked = re.sub(repair.PIECE, "\\g<0>\x01", text.lower()) if re.fullmatch(repair.PLAIN, text) and "<|" not in text else None
            assert marked is not None or not sure or "<|" in text
            assert np.array_equal(words.encode(text, marked), library(text)[:-1]), text


def test_grammars_expand_to_what_they_were_made_of():
    rng = np.random.default_rng(7)
    for base, least in ((300, 2), (300, 16), (70_000, 2)):
        sizes = rng.integers(1, 400, 50)
        ids = [rng.choice([3, 3, 3, 5, 7, 299, 0], n).astype(np.uint32) for n in sizes]
        row = repair.packed_shard(0, 0, list(range(50)), ids, base)
        rules, symbols, ends = repair.grammar(np.concatenate(ids), np.cumsum(sizes), base, least)
        assert len(rules) and len(symbols) < sizes.sum() and len(ends) == 50
        shard = repair.Shard(row)
        assert all(np.array_equal(a, b) for a, (_, b) in zip(ids, shard.documents(), strict=True))
        for _ in range(200):
            k = int(rng.integers(50))
            start = int(rng.integers(sizes[k]))
            length = int(rng.integers(1, sizes[k] - start + 1))
            assert np.array_equal(shard.stretch(k, start, length), ids[k][start : start + length])


def test_runs_of_one_symbol_are_paired_from_their_start():
    ids = np.array([4, 4, 4, 4, 4, 9, 4, 4], np.uint32)
    rules, symbols, ends = repair.grammar(ids, np.array([5, 8]), 100, least=2, sweeps=1)
    assert rules.tolist() == [[4, 4]] and symbols.tolist() == [100, 100, 4, 9, 100] and ends.tolist() == [3, 5]


def coded(rows, parts=16, entries=64):
    """Codes by comparing every part with every entry."""
    kept = sorted((i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    x = np.array([v for _, v in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(3):
        far = ((x[:, :, None] - books[None].transpose(0, 1, 2, 3)) ** 2).sum(axis=3)
        near = far.argmin(axis=2)
        if turn == 2:
            return {i: ("".join(f"{c:02x}" for c in near[k]), int(far[k].min(axis=1).sum())) for k, (i, _) in enumerate(kept)}, hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (own := x[near[:, p] == e, p]).size:
                    books[p, e] = np.floor_divide(own.sum(axis=0), len(own))


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 48)).round(2)
    x[50:60] = x[0]  # ties among entries
    rows = [(i, v.tolist(), [0, 1, None][i % 3]) for i, v in enumerate(x)] + [(900, None, 1), (901, [None] + [0.0] * 47, 1), (902, [float("nan")] * 48, 1), (903, [float("-inf")] * 48, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("error", F.lit(2))
    want, digest = coded(rows)
    got = annular.compressed(vectors).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}
    by_label = Counter()
    for i, _, label in rows[:400]:
        by_label[label] += want[i][1]
    assert all(r.label_error == by_label[rows[r.vec_id][2]] for r in got)
    assert annular.compressed(vectors.where("1 = 0")).count() == 0
    few = annular.compressed(spark.createDataFrame([(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (None, [0.25] * 16, None), (3, [0.5] * 8, 1), (4, [1e30] * 16, 1)], vectors.select("vec_id", "embedding", "label").schema))
    assert sorted((r.vec_id or 0, r.code, r.error) for r in few.collect()) == [(0, "03" * 16, 0), (1, "00" * 16, 0), (1, "00" * 16, 0), (4, "02" * 16, 0)]


def test_annuli_are_searched_exactly_and_in_part():
    rng = np.random.default_rng(1)
    some = lambda n: (rng.normal(size=(n, 4)) * 10 ** rng.uniform(0, 3, (n, 1))).astype(int)
    entries = some(64)
    entries[10] = entries[40]
    x = np.concatenate([some(3000), entries])
    index, far, evaluated = annular.Book(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert np.array_equal(index, every.argmin(axis=1)) and np.array_equal(far, every.min(axis=1))
    assert evaluated < 0.6 * every.size


def near_words(words):
    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    return {w: [v for v in words if one(w, v)] for w in words}


def test_variants_against_brute_force(spark):
    rng = np.random.default_rng(2)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 6))): int(rng.integers(1, 40)) for _ in range(250)}
    near = near_words(words)
    want = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * words[w] else None
        want[w] = (form, words[w], len(own), words[form] if form is not None else None)
    rows = variants.variants(spark.createDataFrame([*words.items(), (None, 7)], "word string, n int")).collect()
    assert {r.word: (r.form, r.n, r.n_near, r.form_n) for r in rows} == want
    for r in rows:
        at = r.word
        while want[at][0] is not None:
            at = want[at][0]
        assert r.root == at


def test_words_lose_a_letter_by_their_documents_id(spark):
    rows = [(i, "Hello worlds, hello ÉTÉ été×x12y " * 3) for i in range(300)] + [(None, "Hello"), (7, None), (8, ""), (9, "123 ??"), (10, "long " * 20_000), (5, "worlds"), (5, "worlds")]
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want.pop("", None)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("word", "run", "id", "h", "n", "key"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert {r.word: r.n for r in variants.noted_words(docs).collect()} == want
    assert len(want) > 8
    assert variants.spelling_variants(docs.where("1 = 0")).count() == 0
    found = {r.word: r for r in variants.spelling_variants(docs).collect()}
    assert set(found) == {w for w, n in want.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("name", ["op12_annular", "op13_variants"])
def test_codes_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(found.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(map(str, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(str, want.select(*[f'"{c}"' for c in columns]).fetchall()))
