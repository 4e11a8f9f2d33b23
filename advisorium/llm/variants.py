"""Operator 13, grouping of spelling variants by pairless wildcard groups.

Words that differ in one replaced letter share exactly one wildcard, a word with one position left open. A
group of words under a wildcard keeps its size and its two most frequent words: that is enough to tell each
member how many others there are and which of them is the most frequent. For inserted and deleted letters,
what is left of a word without one letter meets the vocabulary in the same grouping. A group is bounded by the
alphabet, times the word's length for deletions, and no pair of near words is ever a row. The chain from a word
to its last form is followed by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.llm.common import bounded_batches, cut, portions, table

RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Distinct words that a task holds before it passes their counts on, and characters of a text that are read at once.
HELD, AT_ONCE = 300_000, 1 << 20


def runs_of(text: str) -> Counter:
    """The letter runs of a text, lower-cased in A-Z, with their counts."""
    found: Counter = Counter()
    start = 0
    while start < len(text):
        end = start + AT_ONCE
        if rest := RUN.match(text, end):  # a run is never cut
            end = rest.end()
        part = text[start:end]
        found.update(RUN.findall(part.lower() if part.isascii() else part.translate(LOWER)))
        start = end
    return found


def noted_words(docs: DataFrame, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the letter runs of all texts, lower-cased in A-Z, and how often each occurs.

    Where every divides h, the crc32 of `<id>:<run>`, the run's code point number h % length is left out, as a
    misspelling; what becomes empty is no word. Rows without an id lose no letter; null texts have no words.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

        for batch in (part for whole in batches for part in portions(whole, 1)):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = runs_of(text) if text else {}
                if doc is not None:
                    seed = zlib.crc32(f"{doc}:".encode())
                    for word in [w for w in own if zlib.crc32(w.encode(), seed) % every == 0]:
                        at = zlib.crc32(word.encode(), seed) % len(word)
                        # another run of the text may be what is left of this one
                        counts[word[:at] + word[at + 1 :]] += own.pop(word)
                counts.update(own)
                if len(counts) > HELD:
                    yield passed()
                    counts.clear()
        if counts:
            yield passed()

    texts = bounded_batches(docs).select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return texts.mapInArrow(run, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary of distinct words with their counts n.

    Near words differ by one inserted, deleted or replaced code point. form is the near word of largest n (ties: the
    smallest in code-point order) if that is at least ratio times the word's n, else null; root follows forms to the
    last. Null words are left out, and an empty vocabulary gives no rows. ratio is at least 2, so that chains end.
    """
    known = cut(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null"), "vocabulary")
    size = F.length("word")
    places = F.when(size > 0, F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    without = lambda i, mark: F.concat(F.substring("word", F.lit(1), i), F.lit(mark), F.substring("word", i + 2, size))
    # a word's keys: itself (0), what is left without one letter (1), and its wildcards (2), whose open place no word can fill
    keyed = lambda kind: lambda x: F.struct(x.alias("key"), F.lit(kind).alias("kind"))
    keys = F.concat(
        F.array(keyed(0)(F.col("word"))), F.transform(F.array_distinct(F.transform(places, lambda i: without(i, ""))), keyed(1)),
        F.transform(F.transform(places, lambda i: without(i, "\u0000")), keyed(2)),
    )
    spread = known.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.key", "k.kind")
    # members of a group differ in one letter at one place, or left one out: the alphabet bounds them
    member = F.struct((-F.col("n")).alias("m"), F.col("word").alias("w"))
    groups = spread.groupBy("key").agg(F.max(F.when(F.col("kind") == 0, member)).alias("self"), F.array_sort(F.collect_list(F.when(F.col("kind") > 0, member))).alias("members"), F.max("kind").alias("kind"))
    members, count = F.col("members"), F.size("members").cast("long")
    told = lambda w, near, best: F.struct(w.alias("word"), near.alias("near"), best.alias("best"))
    replaced = F.transform(members, lambda x: told(x["w"], count - 1, F.when(x["w"] == members[0]["w"], F.get(members, F.lit(1))).otherwise(members[0])))
    changed = F.concat(F.array(told(F.col("self.w"), count, F.get(members, F.lit(0)))), F.transform(members, lambda x: told(x["w"], F.lit(1).cast("long"), F.col("self"))))
    answers = groups.where(((F.col("kind") == 2) & (count > 1)) | ((F.col("kind") == 1) & F.col("self").isNotNull())).select(F.explode(F.when(F.col("kind") == 2, replaced).otherwise(changed)).alias("a"))
    near = answers.select("a.*").groupBy(F.col("word").alias("of")).agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.m") >= F.col("n") * ratio
    found = known.join(near, F.col("word") == F.col("of"), "left")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "forms")

    # only words with a form move; each step doubles how far a word has followed its chain
    chains = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = chains.select(F.col("word").alias("a_word"), F.col("root").alias("a_root"))
        stepped = cut(chains.join(ahead, F.col("root") == F.col("a_word"), "left").select("word", F.coalesce("a_root", "root").alias("root"), F.col("a_root").isNotNull().alias("moved")), "chains")
        chains = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    roots = chains.select(F.col("word").alias("r_word"), "root")
    return found.join(roots, F.col("word") == F.col("r_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variants() of the words of all texts that have least_length code points and occur least_count times.

    Null and empty texts have no words, repeated rows each count, other columns aren't read, and an empty table
    gives no rows.
    """
    return variants(noted_words(docs, every, id_col, text_col).where((F.length("word") >= least_length) & (F.col("n") >= least_count)))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


#: crc32 bit by bit over the UTF-8 bytes of `<doc_id>:<run>`; its letters have at most two bytes.
SQL = """
WITH RECURSIVE runs AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'), lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY doc_id, run),
coded AS (SELECT *,
  flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM each),
hashed AS (SELECT doc_id, run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda b: b::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END)), 4294967295::BIGINT) AS h FROM coded),
spelt AS (SELECT CASE WHEN doc_id IS NOT NULL AND h % 97 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
v AS (SELECT word, sum(times)::BIGINT AS n FROM spelt GROUP BY word HAVING length(word) >= 5 AND sum(times) >= 3),
opened AS (SELECT word, n, i, substring(word, 1, i) AS a, substring(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM v) t),
pairs AS (SELECT x.word, y.word AS other, y.n AS other_n FROM opened x JOIN opened y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, v.word, v.n FROM opened x JOIN v ON v.word = x.a || x.b
  UNION SELECT v.word, x.word, x.n FROM opened x JOIN v ON v.word = x.a || x.b),
near AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS best FROM pairs GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 2 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END::BIGINT AS form_n FROM v LEFT JOIN near USING (word)),
chain AS (SELECT word, form, word AS at FROM forms UNION ALL SELECT c.word, f.form, f.word FROM chain c JOIN forms f ON f.word = c.form)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
