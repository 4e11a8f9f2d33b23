"""Operator 8, packing by cutting-stock column generation.

A document's ids are cut into whole sequences and a rest. The histogram of piece lengths is the demand of a
cutting-stock problem: a linear program over patterns, for which knapsack dynamic programming prices new
columns. Patterns are rounded down and given, through prefix counts, to the pieces in rank order. What
rounding leaves over is filled longest first, cutting a piece where none fits, so that no padding remains.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from advisorium.llm.common import bounded_batches, cut, portions, table

#: The splitting rule of byte-level vocabularies (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents up to this many are looked up by broadcast ids (8 bytes each) when a piece of theirs is cut again.
BROADCAST_IDS = 200_000
#: Pieces of a length that are ranked together: so many at least, and else so few that there are about GROUPS groups.
RANKED, GROUPS = 500, 100_000


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the tokenizers library gives them by default.

    A plain byte-level BPE file, whose ids rise with the order of its merges, is the same encoding as a table of
    ranks, for which tiktoken is several times as fast. That is checked when the file is loaded, on the texts of the
    vocabulary in a row; if the two differ, or the file is of another kind, the library encodes everything. Added
    tokens are cut out of a text first, where their file says that they match as they stand.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.of = lambda text: library.encode(text, add_special_tokens=False).ids
        added = spec.get("added_tokens") or []
        ranks = {} if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added) else self.ranks(spec)
        if not ranks:
            return
        encoder = tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        own = {x["content"]: x["id"] for x in added}
        parted = re.compile("|".join(re.escape(x) for x in sorted(own, key=len, reverse=True)) or r"(?!)")

        def fast(text: str) -> np.ndarray:
            if not any(x in text for x in own):
                return encoder.encode_to_numpy(text, disallowed_special=())
            marks, parts = parted.findall(text), parted.split(text)
            ids = [encoder.encode_ordinary(parts[0])]
            for mark, part in zip(marks, parts[1:], strict=True):
                ids += [[own[mark]], encoder.encode_ordinary(part)]
            return np.concatenate([np.array(x, "<u4") for x in ids])

        every = [x for raw in ranks if (x := raw.decode("utf-8", "ignore")).encode() == raw]
        probe = " ".join(every) + "".join(every[::5]) + "".join(x + "a " + x for x in own)
        if self.of(probe) == fast(probe).tolist():
            self.of = fast

    @staticmethod
    def ranks(spec: dict) -> dict[bytes, int]:
        """Token bytes and their ids, or nothing if the file isn't a plain byte-level BPE."""
        model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not spec.get("normalizer") and not model.get("dropout")
        if not plain or model.get("ignore_merges"):
            return {}
        made = [model["vocab"]["".join(x if isinstance(x, list) else x.split(" "))] for x in model.get("merges", [])]
        if made != sorted(made):
            return {}
        # printable bytes stand for themselves, the others for the code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            yield np.asarray(self.of(text), "<u4").tobytes() if text else b""


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    return Ids(path)


def pieces(docs: DataFrame, tokenizer_path: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document's ids and an end id 0, cut after each size ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer_path)
        for batch in (part for whole in batches for part in portions(whole, 1)):
            out: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), ids.encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                raw += b"\0\0\0\0"
                n = len(raw) // 4
                out += [(doc, at, min(size, n - at), zlib.crc32(raw[4 * at : 4 * (at + size)]), n) for at in range(0, n, size)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    return bounded_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(value: np.ndarray, size: int) -> np.ndarray:
    """How often each length (1 to size) is in the fullest-valued sequence of at most size ids; value[l - 1] >= 0."""
    best, choice = np.zeros(size + 1), np.zeros(size + 1, dtype=int)
    for room in range(1, size + 1):
        total = value[:room] + best[room - 1 :: -1][:room]
        k = int(total.argmax())
        if total[k] > best[room - 1] + 1e-12:
            best[room], choice[room] = total[k], k + 1
        else:
            best[room] = best[room - 1]
    found, room = np.zeros(size, dtype=int), size
    while room > 0:
        if choice[room]:
            found[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return found


def first_fit(demand: np.ndarray, size: int) -> tuple[list[np.ndarray], list[int]]:
    """Longest-first patterns that use up the demand, and the length (less one) that each uses up: no later pattern has it, so they are a basis."""
    left = demand * (1 + 1e-7 * np.arange(1, size + 1) / size)  # no two lengths run out together
    patterns, spent = [], []
    while (open_ := np.flatnonzero(left > 0)).size:
        own, room = np.zeros(size, dtype=int), size
        while len(open_ := open_[open_ < room]):
            own[open_[-1]] = room // (open_[-1] + 1)
            room %= open_[-1] + 1
        at = np.flatnonzero(own)
        ratio = left[at] / own[at]
        n, out = ratio.min(), at[ratio.argmin()]
        left[at] -= n * own[at]
        left[out] = 0
        patterns.append(own)
        spent.append(int(out))
    return patterns, spent


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The product of a matrix and a vector, without the threaded library behind @, which can lock up beside a running JVM."""
    return (matrix * vector).sum(axis=1)


def triangular_inverse(patterns: list[np.ndarray], spent: list[int], lengths: np.ndarray) -> np.ndarray:
    """The inverse of the matrix whose columns are first-fit patterns over lengths, by substitution.

    The row of a pattern's spent length has entries of this pattern and earlier ones only.
    """
    inverse = np.zeros((len(patterns), len(patterns)))
    column = {int(x): k for k, x in enumerate(lengths)}
    basis = np.array(patterns, dtype=float)
    for k, out in enumerate(spent):
        inverse[k, column[out]] = 1
        for j in np.flatnonzero(basis[:k, out]):
            inverse[k] -= basis[j, out] * inverse[j]
        inverse[k] /= basis[k, out]
    return inverse


def cutting_stock(demand: np.ndarray, size: int, gap: float = 1e-3, most: int = 300) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used (fractional), from the linear program by column generation.

    demand[l - 1] is the number of pieces of length l. The revised simplex method starts from first-fit
    patterns; the knapsack prices columns until the number of sequences is within gap of a lower bound
    (Farley's, or all ids without padding), or after most columns. The work depends on size only. It also
    ends if the updated inverse has lost its precision: the patterns then are the last ones before that.
    """
    lengths = np.flatnonzero(demand)
    if not len(lengths):
        return []
    patterns, spent = first_fit(demand, size)
    inverse = triangular_inverse(patterns, spent, lengths)
    wanted = demand[lengths].astype(float)
    basis = np.array([p[lengths] for p in patterns], dtype=float)
    ids, value = float((demand * np.arange(1, size + 1)).sum()), np.zeros(size)
    use = np.maximum(times(inverse, wanted), 0)
    for _ in range(most):
        dual = inverse.sum(axis=0)
        value[:] = 0
        value[lengths] = np.maximum(dual, 0)
        column = knapsack(value, size)[lengths]
        worth = float((dual * column).sum())
        # Farley: the optimum is at least the present number of sequences over the best column's worth
        if use.sum() <= (1 + gap) * max(ids / size, use.sum() / max(worth, 1)):
            break
        direction = times(inverse, column)
        ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / direction[out]
        trial = inverse - direction[:, None] * pivot
        trial[out] = pivot
        fresh = np.maximum(times(trial, wanted), 0)
        before = basis[out].copy()
        basis[out] = column
        if np.abs((basis * fresh[:, None]).sum(axis=0) - wanted).max() > 1e-6 * wanted.max():
            basis[out] = before
            break
        inverse, use = trial, fresh
    found = []
    for pattern, n in zip(basis, use, strict=True):
        full = np.zeros(size, dtype=int)
        full[lengths] = pattern
        found.append((full, float(n)))
    return found


class Stock:
    """Pieces still to be placed, as rank ranges of their length, and the slots given to them so far."""

    def __init__(self, demand: np.ndarray, size: int):
        self.size, self.left = size, demand.astype(np.int64)
        #: by present length: [length at first, first rank, ranks, ids before it that are placed elsewhere]
        self.pools = {n: [[n, 0, int(k), 0]] for n, k in enumerate(demand, 1) if k}
        self.slots: list[tuple] = []
        self.sequence = 0

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        self.left[length - 1] -= n
        found, pool = [], self.pools[length]
        while n:
            first, rank, ranks, inside = pool[0]
            k = min(n, ranks)
            found.append((first, rank, k, inside))
            pool[0][1:3] = rank + k, ranks - k
            if ranks == k:
                pool.pop(0)
            n -= k
        return found

    def place(self, own: dict[int, int], n: int, cut_from: int = 0, room: int = 0) -> None:
        """n sequences of own[length] pieces of a length each, then the first room ids of pieces of length cut_from."""
        at = 0
        for length, share in [*own.items(), *([(0, 1)] if room else [])]:
            j = 0
            for first, rank, k, inside in self.take(length or cut_from, n * share):
                self.slots.append((first, rank, k, inside, length or room, share, j, self.sequence, at))
                j += k
                if not length:
                    rest = cut_from - room
                    self.pools.setdefault(rest, []).append([first, rank, k, inside + room])
                    self.left[rest - 1] += k
            at += share * (length or room)
        self.sequence += n


def plan(demand: np.ndarray, size: int, slack: int = 32) -> list[tuple]:
    """Slots for all pieces: (length, first rank, ranks, ids before, ids, a sequence's share, number before, first sequence, offset).

    A pattern used x times in the linear program fills floor(x) sequences, if it lacks at most slack ids.
    What is left over is filled longest first; where more than slack ids are lacking, a piece is cut. Fewer ids than a sequence are left at
    the end; they go to sequences of powers of two, which need no padding.
    """
    stock = Stock(demand, size)
    for pattern, use in sorted(cutting_stock(demand, size), key=lambda x: -x[1]):
        own = np.flatnonzero(pattern)
        n = int(min(np.floor(use + 1e-6), (stock.left[own] // pattern[own]).min()))
        if n > 0 and (own + 1) @ pattern[own] >= size - slack:
            stock.place({int(i) + 1: int(pattern[i]) for i in own[::-1]}, n)
    left = stock.left
    while (total := int(left @ np.arange(1, size + 1))) > 0:
        goal = size if total >= size else 1 << (total.bit_length() - 1)
        own, room, trial = {}, goal, left.copy()
        while room and len(fits := np.flatnonzero(trial[:room])):
            length = int(fits[-1]) + 1
            share = int(min(trial[length - 1], room // length))
            own[length] = share
            trial[length - 1] -= share
            room -= share * length
        n = int(min((left[k - 1] // v for k, v in own.items()), default=total)) if goal == size else 1
        if room > (slack if goal == size else 0):
            cut_from = int(trial.argmax()) + 1
            n = min(n, int(left[cut_from - 1] // (own.get(cut_from, 0) + 1)))
            stock.place(own, n, cut_from, room)
        else:
            stock.place(own, n)
    return stock.slots


SLOT = ("first", "ranks", "inside", "ids", "share", "before", "sequence", "at")


def packed(docs: DataFrame, tokenizer_path: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", ranked: int = RANKED, groups: int = GROUPS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id is in one piece and sequences are filled from offset 0 without gaps. All have size ids or up to
    slack fewer, but for the last few, which are split by powers of two and so need no padding. Ids are those
    that the tokenizers library gives by default: the text of an added token is that token. sequence_id tells
    sequences apart; the numbers have gaps. Pieces are numbered by Spark's row ids as they are first written;
    all later steps read that table, so a task that is run again finds the same numbers.

    A null or empty text is its end id alone. A null id stays null. Repeated rows are each packed. Texts of
    any length are cut; other columns are not read; an empty table gives no rows. size is a power of two
    (else ValueError). Pieces of a length are ranked in groups of about ranked pieces, or more if there would be more than
    about groups of them, as the groups' counts are broadcast.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    found = cut(pieces(docs, tokenizer_path, size, id_col, text_col).withColumn("number", F.monotonically_increasing_id()), "pieces")
    # at most size rows, whatever the number of pieces
    demand = np.zeros(size, dtype=np.int64)
    for r in found.groupBy("length").agg(F.count("*").alias("n")).collect():
        demand[r["length"] - 1] = r["n"]
    # a full piece is a sequence of its own and needs no rank
    rest = demand.copy()
    rest[size - 1] = 0
    by_length: dict[int, list] = {}
    cuts = sequences = 0
    for length, *slot in plan(rest, size):
        by_length.setdefault(length, []).append(tuple(slot))
        cuts += slot[1] * (slot[3] < length)
        sequences = max(sequences, slot[6] - (-(slot[5] + slot[1]) // slot[4]))
    full = found.where(F.col("length") == size).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(sequences) + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    slot_type = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in SLOT]))
    slots = docs.sparkSession.createDataFrame(sorted(by_length.items()), T.StructType([T.StructField("length", T.LongType()), T.StructField("slots", slot_type)]))

    # groups of a length in proportion to its pieces; rows of one repeated document are spread too
    ranked = max(ranked, int(rest.sum()) // groups)
    shares = F.element_at(F.lit([int(-(-n // ranked)) or 1 for n in rest]), F.col("length").cast("int"))
    shorter = found.where(F.col("length") < size).withColumn("g", F.pmod(F.xxhash64("number"), shares).cast("int"))
    counts = shorter.groupBy("length", "g").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(counts.select("length", "g", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")))
    within = F.row_number().over(Window.partitionBy("length", "g").orderBy("number")) - 1
    ranks = shorter.withColumn("within", within).join(before, ["length", "g"]).withColumn("rank", F.col("before") + F.col("within")).join(F.broadcast(slots), "length")
    own = F.filter("slots", lambda s: (F.col("rank") >= s["first"]) & (F.col("rank") < s["first"] + s["ranks"]))
    placed = ranks.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", F.explode(own).alias("s"))
    j = F.col("s.before") + F.col("rank") - F.col("s.first")
    placed = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "s.inside", "s.ids",
        (F.col("s.sequence") + F.floor(j / F.col("s.share"))).alias("sequence_id"), (F.col("s.at") + j % F.col("s.share") * F.col("s.ids")).alias("offset"),
    )
    placed = cut(placed, "placed")
    whole = placed.where("ids = length").select(*full.columns)
    return full.unionByName(whole).unionByName(recut(docs, placed.where("ids < length"), cuts, tokenizer_path, id_col, text_col))


def recut(docs: DataFrame, parts: DataFrame, cuts: int, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """The parts (cuts of them) of pieces that are cut once more, with their own start, length and digest, from the texts they are of."""
    texts = docs.select(F.col(id_col).cast("long").alias("t_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t_text"))
    wanted = parts.select(F.col("doc_id").alias("w_id")).distinct()
    if cuts <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    # equal rows of a document are read once: each part names its own place
    texts = texts.join(wanted, F.col("t_id").eqNullSafe(F.col("w_id")), "left_semi").dropDuplicates(["t_id", "t_text"])
    both = parts.join(texts, F.col("t_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "inside", "ids", "t_text")
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer_path)
        last, raw = None, b""
        for batch in (part for whole in batches for part in portions(whole, 9)):
            out = []
            for *row, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                doc, start, length, crc, tokens, sequence, offset, inside, n = row
                if text != last:
                    last, (raw,) = text, ids.encode([text])
                    raw += b"\0\0\0\0"
                # rows of one id can differ in text: only the text that the piece came from is cut
                if len(raw) == 4 * tokens and zlib.crc32(raw[4 * start : 4 * (start + length)]) == crc:
                    at = start + inside
                    out.append((doc, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), tokens, sequence, offset))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 7)], schema=schema)

    return both.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
