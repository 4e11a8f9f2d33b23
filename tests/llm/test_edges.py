"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from advisorium.llm import hnsw, langid, minhash, packing, pii, quality, secrets, sentencepiece_codec, topk, url_filter
from advisorium.llm.common import connected_components
from advisorium.llm.spans import joined, matches, with_touches

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word and more of it " * 3000
TEXTS = [(1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "日本語 😀\n\tx"), (6, LONG), (7, "same text here for you"), (7, "same text here for you"), (7, "another text"), (None, "no id"), (8, "x" * 5000), (9, "▁ <s> \x00 <0x0A>"), (10, "a <|endoftext|> b<|endoftext|><|endoftext|>\n  c")]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns whose names the operators use within."""
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for name in ("row", "digest", "kind", "value", "rep", "label", "score", "ids", "length", "g", "key", "a", "b"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows.withColumn("lang", F.lit("en"))


def none_of(docs):
    return docs.where("1 = 0")


def test_url_filter(spark):
    urls = [(1, "http://A.Example.NET/en/x?q#f"), (2, None), (3, "no scheme"), (4, "http://net"), (5, "http://x.net/"), (6, "ftp://example.com/de/a"), (7, "http://notexample.com/de/"), (8, "http://a.org/fr/"), (8, "http://a.org/fr/"), (9, "x://" + "a." * 20000 + "net/" + "b/" * 20000), (10, "")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    found = defaultdict(list)
    for r in url_filter.url_filter(pages, rules).collect():
        found[r.page_id].append((r.host[-13:], r.path[:5], r.rule, r.verdict))
    assert found[1] == [("a.example.net", "/en/x", "example.net/en/", "allow")]
    assert found[2] == found[3] == found[10] == [("", "", None, "allow")]
    assert found[4] == [("net", "", None, "allow")]
    assert found[5][0][2:] == ("net/", "block") and found[6][0][2:] == ("example.com/de/", "block")
    assert found[7][0][2:] == (None, "allow") and [x[2:] for x in found[8]] == [("org/fr/", "allow")] * 2 and found[9][0][2:] == ("net/", "block")
    by_shuffle = url_filter.url_filter(pages, rules, broadcast_rules=0)
    assert sorted(map(str, by_shuffle.collect())) == sorted(map(str, url_filter.url_filter(pages, rules).collect()))
    assert {r.verdict for r in url_filter.url_filter(pages, none_of(rules)).collect()} == {"allow"}
    assert url_filter.url_filter(none_of(pages), rules).count() == 0
    with pytest.raises(ValueError, match="slash"):
        url_filter.url_filter(pages, spark.createDataFrame([("block", "a", "/x")], rules.schema))


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(1)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(300, None, ""), (301, [None] * 8, ""), (302, [float("nan")] * 8, ""), (None, [1.0] * 8, ""), (303, x[5].tolist(), ""), (5, x[5].tolist(), "")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    w = {i: np.floor(1024 * np.float32(v).astype(float)).astype(int) for i, v, _ in rows[:300]} | {303: np.floor(1024 * np.float32(x[5]).astype(float)).astype(int)}
    want = {}
    for q in range(0, 300, 100):
        best = sorted((-int(w[q] @ w[i]), i) for i in w if i != q)[:10]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(vectors, "vec_id % 100 = 0").collect()} == want
    assert topk.top_k(none_of(vectors), "vec_id % 100 = 0").count() == 0


def test_sentencepiece_is_the_library(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((i or -1, len(ids := library.encode(t or "") + [2]), sha(" ".join(map(str, ids))), sha(library.decode(ids))) for i, t in TEXTS)
    rows = sentencepiece_codec.encoded(docs, PIECES).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert all(r.agrees and len(r.ids) == r.n_tokens for r in rows)
    codec = sentencepiece_codec.codec(PIECES)
    assert all(codec.decode(r.ids) == library.decode(r.ids) for r in rows)
    assert sentencepiece_codec.encoded(none_of(docs), PIECES).count() == 0


def test_quality(spark, docs):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "of", "the"]
    rows = [(i, " ".join(rng.choice(words, 60)) + ".", 1) if i % 2 else (i, "| ".join(["buy"] * 50), 0) for i in range(200)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.quality_scores(learned.select("doc_id", "text"), learned.select("doc_id", "quality")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.held_out]) > 0.95
    assert all(r.score == 0.5 for r in quality.quality_scores(docs, none_of(learned)).collect())
    assert quality.quality_scores(docs, learned.select("doc_id", "quality")).count() == len(TEXTS)
    assert quality.quality_scores(none_of(docs), learned.select("doc_id", "quality")).count() == 0


def test_language(spark, docs):
    rows = [(i, "der und die mit von einer schule " * 3, "de") if i % 2 else (i, "the and of with a school and that " * 3, "en") for i in range(80)]
    rows += [(100, None, "de"), (101, "123 ...", "en"), (102, "the school", None), (103, "½ ① Ⅳ ²", "en")]
    found = {r.doc_id: r for r in langid.languages_of(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    assert all(found[i].lang_pred == ("de" if i % 2 else "en") for i in range(80)) and found[102].lang_pred == "en"
    assert found[103].lang_pred == "und" and found[103].score == 0
    assert (found[100].lang_pred, found[101].lang_pred, found[101].score) == ("und", "und", 0.0)
    assert langid.languages_of(docs, PIECES).count() == len(TEXTS)
    assert {r.lang_pred for r in langid.languages_of(docs.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()} == {"und"}
    assert langid.languages_of(none_of(docs), PIECES).count() == 0


def test_forward_sum_is_the_sum_over_segmentations():
    own = langid.vocabulary(PIECES)
    chance = np.random.default_rng(0).random((len(own.pieces), 2)) / 100
    place = {p: i for i, p in enumerate(own.pieces)}

    def total(rest):
        if not rest:
            return np.ones(2)
        found = sum((chance[place[rest[:n]]] * total(rest[n:]) for n in range(1, len(rest) + 1) if rest[:n] in place), np.zeros(2))
        return found + (langid.STRANGE * total(rest[1:]) if rest[0] not in place else 0)

    words = ["school", "étre", "xq", "ß", "日本"]
    assert np.allclose(own.log_chances(words, chance), np.log([total(langid.SPACE + w) for w in words]))
    # words far beyond the range of doubles: no piece spans two strange characters, so logs add up
    one = own.log_chances(["日"], chance)[0] - own.log_chances([""], chance)[0]
    assert np.allclose(own.log_chances(["日" * 3000], chance)[0], own.log_chances([""], chance)[0] + 3000 * one)


def test_expected_uses_are_the_slopes_of_the_forward_sum():
    own = langid.vocabulary(PIECES)
    chance = np.random.default_rng(0).random((len(own.pieces), 2)) / 100
    words, languages, weights = ["school", "house", "日a"], np.array([0, 1, 0]), np.array([2.0, 3.0, 1.0])
    uses = own.expected(words, languages, weights, chance)
    for piece, language in np.argwhere(uses > 1e-9)[:20]:
        more = chance.copy()
        more[piece, language] *= 1.0001
        slope = sum(w * (own.log_chances([x], more) - own.log_chances([x], chance))[0, k] for x, k, w in zip(words, languages, weights, strict=True)) / np.log(1.0001)
        assert abs(slope - uses[piece, language]) < 1e-4


def test_numbers_are_no_letters():
    assert langid.words_of("½ ² ① Ⅳ 12 _ a½b É") == ["a", "b", "é"]


def test_secrets_and_personal_data_against_regular_expressions(spark, docs):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    texts = ["token: secret: abcdefghijklmnop", "😀 API_KEY='abcdefghijkl' AKIAABCDEFGHIJKLMN x 0123456789abcdef", "a@b.c+d@e.f x@y x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 00000000000255.0.0.0", "4111 1111 1111 1111 22, +49 (30) 123-456 7", "9" * 3000, "a" * 3000 + "@x.y", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def six(t):
        out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        return ",".join(f"{secrets.NAMES[k]}:{s}:{e}" for s, k, e in sorted(out))

    def luhn(x):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(x))) % 10 == 0

    def seven(t):
        out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
        out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
        return ",".join(f"{pii.NAMES[k]}:{s}:{e}" for k, s, e in sorted(out))

    for operator, names, base in ((secrets.secret_spans, secrets.NAMES, six), (pii.personal_spans, pii.NAMES, seven)):
        found = {r.doc_id: r.b for r in operator(rows).select("doc_id", joined(F.col("base"), names).alias("b")).collect()}
        assert found == {i: base(t or "") for i, t in enumerate(texts)}
        assert operator(docs).count() == len(TEXTS)
        assert operator(none_of(docs)).count() == 0


def test_markov_finds_an_unlabelled_random_string(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789"), n))
    rows = [(i, f"token = {draw(30)} and internationalization_of_the_words") for i in range(200)] + [(900, f"see {draw(32)} there"), (901, "counterrevolutionaries")]
    found = {r.doc_id: [s["kind"] for s in r.spans] for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[900] == [secrets.MARKOV] and found[901] == [] and found[0] == [0]


def test_bootstrapping_finds_identifiers_in_seeded_contexts(spark):
    rows = [(i, f"please call phone: +1 555 010 {1000 + i} or write to mail: user{i}@example.com today") for i in range(30)] + [(99, "write to mail: user99@localhost today"), (98, "version 12 of 2020")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.personal_spans(docs).collect()}
    assert [(s["kind"], s["begin"], s["finish"]) for s in found[99].spans] == [(pii.FOUND, 15, 31)] and found[98].spans == []
    clean = docs.join(pii.personal_spans(docs).select("doc_id", "spans"), "doc_id").select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in clean.collect()}[99] == "write to mail: <found> today"


def test_bootstrapping_goes_on_to_its_fixed_point(spark):
    # t1 and t2 rise a second time without a token being added; only then Q is trusted, and finds late
    rows = [(f"s{i}", True, ["P", "Q"] if i < 3 else ["P"]) for i in range(8)] + [("t1", False, ["P", "Q"]), ("t2", False, ["P", "Q"]), ("late", False, ["Q"])]
    mentions = spark.createDataFrame(rows, "token string, seed boolean, patterns array<string>")
    assert {r.token for r in pii.bootstrap(mentions).collect()} == {"t1", "t2", "late"}
    assert pii.bootstrap(none_of(mentions)).count() == 0


def test_contexts_reach_over_the_whole_text(spark):
    far = " " * 300
    rows = [(0, f"call{far}now 12{far}34 x"), (1, "q" * 100 + " 55"), (2, "77 a@b.c"), (3, "one 5")]
    found = matches(spark.createDataFrame(rows, "doc_id long, text string"), pii.KINDS, "doc_id", "text", pii.shape).where(F.col("kind") == pii.FOUND)
    got = {(r.doc_id, r.value): list(r.left) for r in found.collect()}
    assert got == {(0, "12"): ["call", "now"], (0, "34"): ["now", "0"], (1, "55"): [hashlib.md5(b"q" * 100).hexdigest()], (2, "77"): [], (2, "a@b.c"): ["0"], (3, "5"): ["one"]}


def test_touching_spans_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(11)
    rows = [(int(r), int(k), int(b), int(b + rng.integers(1, 9))) for r, k, b in zip(rng.integers(0, 8, 400), rng.integers(0, 2, 400), rng.integers(0, 120, 400), strict=True)]
    placed = spark.createDataFrame(rows, "row long, kind int, begin long, finish long")
    for r in with_touches(placed, F.col("kind") == 0).where("kind = 1").collect():
        assert r.touches == any(row == r.row and k == 0 and b < r.finish and r.begin < f for row, k, b, f in rows)


def test_quality_is_the_plain_discriminant(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "|", "Gamma!!!", "12"], int(rng.integers(1, 80)), p=[0.5, 0.2, 0.1, 0.1, 0.1] if i % 2 else [0.2, 0.2, 0.3, 0.2, 0.1])), int(i % 2)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(docs.select("doc_id", "text"), docs.select("doc_id", "quality")).collect()}
    x, y = np.array([quality.statistics(t) for _, t, _ in rows]), np.array([q for _, _, q in rows])
    learn = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows])
    own = [np.cov(x[learn & (y == c)].T, bias=True) for c in (0, 1)]
    share = [np.mean(y[learn] == c) for c in (0, 1)]
    pooled = share[0] * own[0] + share[1] * own[1]
    density = []
    for c in (0, 1):
        shrunk = 0.98 * (0.8 * own[c] + 0.2 * pooled) + 0.02 * np.diag(np.diag(pooled) + 1e-6)
        away = x - x[learn & (y == c)].mean(axis=0)
        density.append(np.log(share[c]) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * np.einsum("ij,ij->i", away, np.linalg.solve(shrunk, away.T).T))
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / 2, -500, 500)))
    assert np.allclose([got[i] for i in range(300)], want, atol=1e-6)


def test_packing_is_whole(spark, docs):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = packing.packed(docs, BYTES, size=64, ranked=50).collect()
    at, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id, r.doc_tokens].append(r)
    padded = sum(64 - sum(n for _, n in places) for places in at.values() if sum(n for _, n in places) not in (1, 2, 4, 8, 16, 32))
    assert padded <= 0.1 * 64 * len(at)
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    total = 0
    for doc, text in TEXTS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = seen[doc, len(ids)]
        total += len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
        assert sum(r.length for r in own) % len(ids) == 0 and {r.start for r in own} >= {0}
    assert sum(r.length for r in rows) == total
    assert packing.packed(none_of(docs), BYTES).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.packed(docs, BYTES, size=100)


def test_patterns_use_up_any_histogram():
    rng = np.random.default_rng(0)
    for demand in (np.eye(128, dtype=int)[74] * 1001, rng.integers(0, 30, 128), rng.integers(0, 30, 128) * (np.arange(128) > 80), np.zeros(128, int)):
        slots, used = packing.plan(demand, 128), np.zeros(128, int)
        for length, _, ranks, _, ids, *_ in slots:
            used[length - 1] += ranks * ids
        assert (used == demand * np.arange(1, 129)).all()


def test_programme_in_a_running_session(spark):
    assert spark.range(1).count() == 1
    demand = np.random.default_rng(1).integers(1, 100_000, 1024)
    sequences = max(s + -(-(j + ranks) // share) for _, _, ranks, _, _, share, j, s, _ in packing.plan(demand, 1024))
    assert sequences * 1024 <= 1.01 * (demand * np.arange(1, 1025)).sum()


def test_ids_are_those_of_the_library():
    library, ids = Tokenizer.from_file(BYTES), packing.ids_of(BYTES)
    assert ids.of.__name__ == "fast"
    rng = np.random.default_rng(5)
    letters = np.array([*map(chr, range(0x250)), "日", "😀", "½", "\u2028", "\u3000", " ", "  ", "\n ", "'s", "<|endoftext|>", "<|endof"], object)
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    assert list(ids.encode(texts)) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    spec = packing.json.load(open(BYTES))
    assert not packing.Ids.ranks(spec | {"pre_tokenizer": {"type": "Whitespace"}})


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.concatenate((base, base[:20] + 0.05 * rng.normal(size=(20, 16)), base[:3], 2 * base[:2]))
    rows = [(i, v.tolist(), int(i % 20) // 10) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("inf")] * 16, 1), (903, base[0].tolist(), None), (904, [1.0], 1), (0, base[0].tolist(), 0), (None, [1.0] * 16, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    got = {r.vec_id: r for r in hnsw.near_duplicates(vectors).collect() if r.vec_id is not None}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[: len(x)]])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.array([low[near[i]].min() for i in range(len(x))])
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(x))] == [(near[i].sum() - 1, low[i], low[i] == i) for i in range(len(x))]
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (900, 901, 902, 903, 904))
    assert hnsw.near_duplicates(none_of(vectors)).count() == 0


def never(*_):
    raise AssertionError("the exact product was called")


def true_pairs(a, b):
    return {(i, j) for i, j in np.argwhere(a @ b.T >= 0.93).tolist() if a is not b or i != j}


def test_graph_recall_without_the_product(monkeypatch):
    monkeypatch.setattr(hnsw, "product", never)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24))
    x[750:] = x[:750] + 0.1 * rng.normal(size=(750, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    again = hnsw.unpack(hnsw.pack(hnsw.Graph(x)), x)
    found, beams = hnsw.link_pairs(x, again, None, None, 0.93)
    true = true_pairs(x, x)
    assert {tuple(p) for p in found.tolist()} <= true and len(found) >= 0.98 * len(true) and beams[0] >= hnsw.BEAM


def test_sparse_pairs_across_two_shards_without_the_product(monkeypatch):
    monkeypatch.setattr(hnsw, "product", never)
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2000, 32)), rng.normal(size=(1500, 32))
    b[::50] = a[:30] + 0.2 * rng.normal(size=(30, 32))
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    found, beams = hnsw.link_pairs(a, hnsw.Graph(a), b, hnsw.Graph(b), 0.93)
    true = true_pairs(a, b)
    assert len(true) >= 30 and {tuple(p) for p in found.tolist()} <= true and len(found) >= 0.98 * len(true) and len(beams) == 2


def test_links_of_a_node_that_the_graph_lost():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    x[7] = x[300] + 0.02 * rng.normal(size=16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    for layer in graph.layers:  # as where pruning leaves no link to a node
        for i, near in layer.items():
            layer[i] = near[near != 7]
    found, _ = hnsw.link_pairs(x, hnsw.unpack(hnsw.pack(graph), x), None, None, 0.93)
    assert {tuple(p) for p in found.tolist()} == true_pairs(x, x)  # met from its other end


def test_audits_widen_the_beam_and_give_up_a_broken_graph():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 16))
    x[200:] = x[:200] + 0.05 * rng.normal(size=(200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    assert hnsw.passing_beam(graph, x, x, 0.93, beam=1) >= 1
    for layer in graph.layers:
        for i in layer:
            layer[i] = np.zeros(0, np.int64)
    graph.near[:] = -1
    assert hnsw.passing_beam(graph, x, x, 0.93) == 0
    found, beams = hnsw.link_pairs(x, graph, None, None, 0.93)
    assert beams == [0] and {tuple(p) for p in found.tolist()} == true_pairs(x, x)


def test_sparse_pairs_across_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 150)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 24))
    x[880:] = x[:20] + 0.05 * rng.normal(size=(20, 24))
    vectors = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    widths = {}
    found = hnsw.near_duplicates(vectors, report=lambda df: widths.update({r.beam: r.searches for r in df.collect()}))
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    assert near.sum() == 900 + 2 * 20
    assert got == {i: (near[i].sum() - 1, np.flatnonzero(near[i]).min()) for i in range(900)}
    assert 0 not in widths and sum(widths.values()) == 6 * 6  # each of 6 shards meets itself once and each other from both sides


def near_brute(texts, words=5, percent=75):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()
    low = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    return {i: (len(s), low[i], low[i] == i) for i, s in sets.items()}


def test_near_duplicate_texts(spark, docs):
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(500)
    base = [[word() for _ in range(60)] for _ in range(12)]
    texts = [(i, " ".join(x)) for i, x in enumerate(base)]
    for i, x in enumerate(base * 3):
        y = list(x)
        for _ in range(int(rng.integers(0, 4))):
            y[int(rng.integers(60))] = word()
        texts.append((100 + i, "\n".join(y).upper()))
    texts += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c"), (906, " ".join(base[0] + base[1])), (907, "x " * 5000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect()}
    assert found == near_brute(texts)
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == len(TEXTS)
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert minhash.near_duplicates(none_of(docs)).count() == 0


def test_a_bucket_larger_than_a_block_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 3)
    rng = np.random.default_rng(6)
    common = ["c%d" % i for i in range(60)]
    texts = [(i, " ".join(common + ["u%d_%d" % (i // 2, k) for k in range(40 + int(rng.integers(2)))])) for i in range(24)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect()}
    assert found == near_brute(texts)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(8)
    passed = {}
    for common in (771, 600, 300):  # of 900 each: similarities of 0.75, 0.5 and 0.2
        flipped = []
        for _ in range(60):
            x = rng.integers(0, 2**64, 1800, dtype=np.uint64)
            a, b = (minhash.odd_sketch(np.sort(s)) for s in (x[:900], np.concatenate((x[:common], x[900 : 1800 - common]))))
            flipped.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()))
        passed[common] = np.mean(np.array(flipped) <= minhash.most_flipped([1800], 0.75)[0])
    assert passed[771] == 1 and passed[600] == 0 and passed[300] == 0


def test_limits_hold_for_sets_of_all_sizes():
    rng = np.random.default_rng(9)
    table = minhash.limits(0.75)
    for union in (8, 40, 180, 900, 5000):
        shared = -(-3 * union // 4)
        for one in (0, (union - shared) // 2):  # shingles that only the first set has
            for _ in range(200):
                x = rng.integers(0, 2**64, union, dtype=np.uint64)
                a, b = np.sort(x[: shared + one]), np.sort(np.concatenate((x[:shared], x[shared + one :])))
                flipped = int(np.bitwise_count((minhash.odd_sketch(a) ^ minhash.odd_sketch(b)).view(np.uint64)).sum())
                assert flipped <= table[int(np.log2(len(a) + len(b)) * minhash.STEPS)]
