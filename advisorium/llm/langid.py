"""Operator 5, language ID by segmentation-marginalised unigrams.

Every language has a chance for each piece of a fixed public vocabulary. A word's chance in a language is
the sum over all its segmentations into pieces, by a forward algorithm; a text's is the product over its
words. The chances are learnt by expectation maximisation with the same forward sums and backward ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.llm.common import bounded_batches, cut, portions, table, text_crc

SPACE = "▁"
#: Runs of characters that make up words, among them numbers such as ½ and Ⅳ, which are no letters.
RUNS = re.compile(r"[^\W\d_]+")
#: Words that a worker remembers before it starts anew, about 200 bytes each.
REMEMBERED = 250_000
#: Characters of words that are worked on at once.
AT_ONCE = 65_536
#: Chance of a character that is no piece itself.
STRANGE = 1e-7
#: Forward sums are scaled anew after so many characters, so that words of any length stay within doubles.
SCALED = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L), in lower case."""
    found = RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for run in found for x in "".join(c if c.isalpha() else " " for c in run).split()]


class Vocabulary:
    """Pieces of a sentencepiece model made of letters, found in many words at once by rolling hashes."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        every = (library.id_to_piece(i) for i in range(library.get_piece_size()))
        self.pieces = sorted({p for p in every if p == p.lower() and p.removeprefix(SPACE).isalpha()})
        self.longest = max(map(len, self.pieces), default=1)
        codes = [self.hashed(np.array([[ord(c) for c in p]], np.uint64))[0] for p in self.pieces]
        order = np.argsort(np.array(codes, np.uint64))
        self.keys, self.ids = np.array(codes, np.uint64)[order], order

    @staticmethod
    def hashed(codes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            total = total * _BASE + codes[:, k] + np.uint64(1)
        return total ^ (total >> np.uint64(29))

    def of_hashes(self, total: np.ndarray) -> np.ndarray:
        """The pieces of rolling hashes, or -1."""
        if not len(self.keys):
            return np.full(len(total), -1)
        key = total ^ (total >> np.uint64(29))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], -1)

    def steps(self, codes: np.ndarray) -> Iterator[list[tuple[int, np.ndarray]]]:
        """For every end in words of one length: the starts within reach, and in each word the piece between, or -1."""
        held: list[tuple[int, np.ndarray]] = []
        for end in range(1, codes.shape[1] + 1):
            held = [*held[-(self.longest - 1) :] * (self.longest > 1), (end - 1, np.zeros(len(codes), np.uint64))]
            held = [(start, total * _BASE + codes[:, end - 1] + np.uint64(1)) for start, total in held]
            yield [(start, self.of_hashes(total)) for start, total in held]

    def by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in words, and the characters of a space mark and the word, of words of one length."""
        sizes = np.array([len(x) for x in words])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            for part in np.array_split(at, len(at) * (n + 1) // AT_ONCE + 1):
                text = "".join(SPACE + words[i] for i in part)
                yield part, np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").reshape(len(part), n + 1).astype(np.uint64)

    def log_chances(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """The log of each word's summed chance over all its segmentations, by language. Only a window of sums is held."""
        out = np.zeros((len(words), chance.shape[1]))
        padded = np.vstack((chance, np.zeros(chance.shape[1])))
        for at, codes in self.by_length(words):
            sums, scale = [np.ones((len(at), chance.shape[1]))], np.zeros((len(at), chance.shape[1]))
            for end, reach in enumerate(self.steps(codes), 1):
                sums = sums[-len(reach) :]
                now = np.zeros_like(scale)
                for (_, ids), before in zip(reach, sums, strict=True):
                    if (ids >= 0).any():
                        now += before * padded[ids]
                # a character that is no piece; the space mark before a word always counts
                lacking = reach[-1][1] < 0
                now[lacking] += sums[-1][lacking] * STRANGE
                if end % SCALED == 0:
                    sums = [x / now for x in sums]
                    scale += np.log(now)
                    now = np.ones_like(now)
                sums.append(now)
            out[at] = scale + np.log(sums[-1])
        return out

    def expected(self, words: list[str], languages: np.ndarray, weights: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by language, over weighted words of known language; in logs, by forward and backward sums."""
        total, width = np.zeros(chance.size), chance.shape[1]
        logs = np.vstack((np.log(chance), np.full(width, -np.inf)))
        for at, codes in self.by_length(words):
            n, length = codes.shape
            own, reach = languages[at], list(self.steps(codes))
            alpha, beta = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
            alpha[0] = beta[length] = 0
            step = [[(start, logs[ids, own]) for start, ids in ends] for ends in reach]
            for ends in step:
                # a character that is no piece
                start, single = ends[-1]
                ends[-1] = (start, np.where(np.isneginf(single), np.log(STRANGE), single))
            for end, ends in enumerate(step, 1):
                alpha[end] = np.logaddexp.reduce([alpha[start] + x for start, x in ends], axis=0)
            for end in range(length, 0, -1):
                for start, x in step[end - 1]:
                    beta[start] = np.logaddexp(beta[start], beta[end] + x)
            places, uses = [], []
            for end, (ends, found) in enumerate(zip(step, reach, strict=True), 1):
                for (start, x), (_, ids) in zip(ends, found, strict=True):
                    if (has := ids >= 0).any():
                        places.append(ids[has] * width + own[has])
                        uses.append(np.exp(alpha[start] + x + beta[end] - alpha[length])[has] * weights[at][has])
            if places:
                total += np.bincount(np.concatenate(places), np.concatenate(uses), len(total))
        return total.reshape(chance.shape)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def learn(samples: DataFrame, languages: list[str], model_path: str, rounds: int = 3) -> np.ndarray:
    """chance[piece, language] from rows (text, lang): counts of words by language, then rounds of expectation maximisation.

    Word counts stay distributed; only expected uses, at most pieces times languages numbers, come to the driver.
    """
    bounded_batches(samples)
    schema = pa.schema([("word", pa.string()), ("lang", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 0)):
            found: dict[tuple[str, str], int] = {}
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word in words_of(text or ""):
                    found[word, lang] = found.get((word, lang), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([x for _, x in found], pa.string()), pa.array(found.values(), pa.int64())], schema=schema)

    counted = samples.select("text", "lang").mapInArrow(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counted = cut(counted, "words")
    place = {x: i for i, x in enumerate(languages)}
    size = len(vocabulary(model_path).pieces)
    chance = np.full((size, len(languages)), 1.0 / max(size, 1))
    uses_schema = pa.schema([("piece", pa.int32()), ("language", pa.int32()), ("uses", pa.float64())])
    for _ in range(rounds):
        now = chance

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            own, total = vocabulary(model_path), np.zeros_like(now)
            for batch in batches:
                words, langs, n = (c.to_pylist() for c in batch.columns)
                total += own.expected(words, np.array([place[x] for x in langs], int), np.array(n, float), now)
            at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], schema=uses_schema)

        uses = np.zeros_like(chance)
        for r in counted.mapInArrow(expect, "piece int, language int, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses")).toLocalIterator():
            uses[r["piece"], r["language"]] = r["uses"]
        chance = (uses + 0.02) / (uses + 0.02).sum(axis=0)
    return chance


def languages_of(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, learn_from: int = 4000) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (the chance of lang_pred, all languages being likely alike).

    Learns from text and non-null lang of rows whose crc32(doc_id as text) mod folds is not held; about
    learn_from documents a language at most, taken by a hash of their id. Rows of remainder held are held out.

    A null text, or one without letters (Unicode category L, so ½ is none), is und with score 0; so is every text
    when nothing can be learnt. Texts and words of any length are read whole and counted in logs. Rows with a null id are never learnt from and not held
    out. Equal scores go to the first language in order of name. Repeated rows are each returned; other
    columns are not read; an empty table gives no rows.
    """
    fold = F.coalesce(text_crc(F.col(id_col)) % folds, F.lit(held))
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), fold.alias("fold")).where(f"lang is not null and text is not null and fold <> {held}")
    number = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(number)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1_000_000)) / 1e6
    share = F.lit(0.0)
    for lang, n in number.items():
        share = F.when(F.col("lang") == lang, learn_from / n).otherwise(share)
    chance = learn(known.where(drawn < share), languages, model_path) if languages else None
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        place: dict[str, int] = {}
        logs = np.zeros((1024, len(languages)))
        for batch in (part for whole in batches for part in portions(whole, 1)):
            texts = [words_of(x or "") for x in batch.column(1).to_pylist()]
            new = list(dict.fromkeys(w for words in texts for w in words if w not in place)) if languages else []
            if len(place) + len(new) > REMEMBERED:
                place = {}
                new = list(dict.fromkeys(w for words in texts for w in words))
            if new:
                start = len(place)
                place.update(zip(new, range(start, start + len(new)), strict=True))
                if len(logs) < len(place):
                    logs = np.concatenate((logs[:start], np.zeros((2 * len(place) - start, len(languages)))))
                logs[start : len(place)] = own.log_chances(new, chance)
            out: list[tuple] = []
            for words in texts:
                if not words or not languages:
                    out.append(("und", 0.0))
                    continue
                total = logs[[place[w] for w in words]].sum(axis=0)
                best = int(total.argmax())
                out.append((languages[best], float(1 / np.exp(total - total[best]).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], schema=schema)

    found = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(text_crc("doc_id") % folds == held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    import public_tokenizers

    return languages_of(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"))
