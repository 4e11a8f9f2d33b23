"""Operator 11, token ids as binary shards under Re-Pair grammars.

Documents are dealt by ranges of their id, encoded, and gathered in order into shards of about a million ids.
Each shard has a grammar of its own: the most frequent pairs of neighbouring symbols become nonterminals, sweep by
sweep, until no pair occurs twice. A sweep replaces pairs one after the other, the most frequent first, none of them left with less than
half as many places as any other pair has; only pairs that arise by that are counted anew. No pair crosses a document's end. A shard keeps
its rules, the length that each symbol expands to, its shortened sequence and where documents
start in it, so any stretch of ids is decoded from the symbols that cover it.

A shard is a row of a Parquet table; numbers in its binary columns are little-endian:
docs int64 ids of documents (named: whether each has one), ends uint32 symbols up to each document's end, base
the first nonterminal, rules a pair of symbols per nonterminal, lengths uint32 expansions of the nonterminals,
symbols the sequence; symbols are uint16 where all of the shard's fit, else uint32 (width).
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
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from advisorium.llm.common import bounded_batches, cut, portions, table

#: Ids of a shard, but for a single document that is longer.
SHARD = 1 << 20
#: Least occurrences of a pair in a shard that becomes a rule: Re-Pair ends when no pair occurs twice.
LEAST = 2
#: What stands in a place whose symbol a nonterminal has taken in.
GONE = np.uint32(0xFFFFFFFF)
#: How often a sweep's places are dealt anew without the pairs that too few are left for.
RESOLVED = 4
#: Words that a worker remembers (about 200 bytes each at most), and their greatest length.
REMEMBERED, WORD = 150_000, 64
#: Text bytes that are cut into words at once.
TOGETHER = 4_000_000
#: Texts that need no normalising but lower case, and the pieces that the file's own pattern finds in those (fixed values).
PLAIN = r"[\t\n\r -~À-ÖØ-öø-ÿ]*+"
PIECE = r"[a-zß-öø-ÿ]++|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^a-zß-öø-ÿ0-9\t\n\r ]++"
PIECES, ONLY_PLAIN = re.compile(PIECE + "| "), re.compile(PLAIN).fullmatch
#: Kinds of plain letters by code point: white space, letters, digits (each a piece), others; without apostrophes a piece is a run of one kind.
KINDS = np.array([0 if x in "\t\n\r " else 1 if re.match("[a-zß-öø-ÿ]", x) else 2 if x in "0123456789" else 3 for x in map(chr, range(256))], np.uint8)


class Words(dict):
    """The library's ids of texts, as numpy arrays of uint32; words with the bytes of their ids.

    If the library drops white space, a batch of texts is cut into words by Arrow, and only those that aren't remembered are encoded.
    Plain ones, whose pieces are then marked by the byte 1, are encoded by a table of ranks, which is several times as
    fast; that is checked against the library on loading, on the whole vocabulary and on mixed texts. If the two differ, or the
    file is of another kind, and for all other words, the library encodes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.of = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        self.size = library.get_vocab_size()
        vocabulary = library.get_vocab()
        shown = [x.removesuffix("</w>") for x in sorted(vocabulary, key=vocabulary.get)][::3]
        marks = [x["content"] for x in spec.get("added_tokens") or []]
        odd = " Ａé é x́\ny  \x1cz <|a|> 12,5\t\r\n ς Σ ÿß×÷ªº½ \x01 " + " ".join(marks) + "a".join(marks)
        plain = " don't It'S we'll--- x's' 'd''s ''s -'re 1'm  é'vel\n\tÀÉ'Tß ###'s. " + " ".join(x for x in shown if re.fullmatch(PLAIN, x) and "<|" not in x) + " ".join(x.upper() + "," + y for x, y in zip(shown[::5], shown[1::5], strict=False) if re.fullmatch(PLAIN, x + y) and "<|" not in x + y)
        probe = " ".join(shown) + odd
        self.by_word = np.array_equal(self.worded(probe), self.of(probe))
        self.clear()
        #: remembered words, their ids, where each one's start and how many they are
        self.known = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ranks = None
        if ranks := self.ranked(spec):
            table = tiktoken.Encoding(path, pat_str=r"[^\s\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
            if np.array_equal(table.encode_to_numpy(re.sub(PIECE, "\\g<0>\x01", plain.lower()), disallowed_special=()), self.of(plain)):
                self.ranks = table
                #: which ids end a piece
                self.final = np.zeros(self.size, bool)
                self.final[[i for x, i in ranks.items() if x.endswith(b"\x01")]] = True

    @staticmethod
    def ranked(spec: dict) -> dict[bytes, int]:
        """Token bytes and their ids, the byte 1 for a word's end; nothing if the file isn't a BPE with word ends whose ids rise with its merges."""
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout") or model.get("ignore_merges"):
            return {}
        made = [model["vocab"]["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
        if made != sorted(made) or min(made, default=512) < 512:
            return {}
        # printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        added = {x["content"] for x in spec.get("added_tokens") or []}
        return {bytes(byte[c] for c in x.removesuffix("</w>")) + (b"\x01" if x.endswith("</w>") else b""): i for x, i in model["vocab"].items() if x not in added}

    def __missing__(self, word: str) -> bytes:
        ids = self.of(word).tobytes()
        if len(word) <= WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def worded(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([self[w] for w in text.replace("\n", " ").split(" ") if w]), np.uint32)

    def plain(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, joined by spaces, by the table of ranks; and how many there are up to each word's end."""
        words = words.lower()
        # spaces stay as they are between the marked pieces of two words
        if "'" in words:
            words = "\x01".join([*PIECES.findall(words), ""]).replace(" \x01", " ")
            letters = np.frombuffer(words.encode("latin-1"), np.uint8)
        else:
            letters = np.frombuffer(words.encode("latin-1"), np.uint8)
            kinds = KINDS[letters]
            last = (kinds > 0) & ((kinds == 2) | (np.append(kinds[1:], 0) != kinds))
            letters = np.insert(letters, np.flatnonzero(last) + 1, 1)
            words = letters.tobytes().decode("latin-1")
        upto = np.concatenate(([0], np.cumsum(letters == 1)))[np.append(np.flatnonzero(letters == 32), len(letters))]
        ids = self.ranks.encode_to_numpy(words, disallowed_special=())
        return ids.astype(np.uint32, copy=False), np.concatenate(([0], np.flatnonzero(self.final[ids]) + 1))[upto]

    def learnt(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many there are up to each word's end."""
        joined = " ".join(words.to_numpy(zero_copy_only=False))
        if self.ranks and len(words) and ONLY_PLAIN(joined) and "<|" not in joined:
            return self.plain(joined)
        own = {w: self.of(w) for w in words.to_pylist() if not self.ranks or not ONLY_PLAIN(w) or "<|" in w}
        rest = [w for w in words.to_pylist() if w not in own]
        if rest:
            ids, upto = self.plain(" ".join(rest))
            own.update(zip(rest, np.split(ids, upto[:-1]), strict=True))
        each = [own[w] for w in words.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.cumsum([len(x) for x in each], dtype=np.int64)

    def told(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each word start and how many they are. Words are remembered until there are too many; then those of this call stay."""
        known, ids, starts, sizes = self.known
        at = pc.index_in(words, known).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        short = pc.less_equal(pc.binary_length(words), WORD).to_numpy(zero_copy_only=False)
        # new words that aren't remembered come last
        new = np.concatenate([np.flatnonzero((at < 0) & short), np.flatnonzero((at < 0) & ~short)])
        own, upto = self.learnt(words.take(pa.array(new)))
        each = np.diff(upto, prepend=0)
        at[new] = len(known) + np.arange(len(new))
        starts, sizes, ids = np.concatenate([starts, len(ids) + upto - each]), np.concatenate([sizes, each]), np.concatenate([ids, own])
        held = len(known) + int(short[new].sum())
        if held <= REMEMBERED:
            upto = int((starts[:held] + sizes[:held]).max(initial=0))
            self.known = pa.concat_arrays([known, words.take(pa.array(new[: held - len(known)]))]), ids[:upto], starts[:held], sizes[:held]
        else:
            own = sizes[at[short]]
            upto = np.cumsum(own)
            self.known = words.filter(pa.array(short)), ids[np.repeat(starts[at[short]] - upto + own, own) + np.arange(own.sum())], upto - own, own
        return ids, starts[at], sizes[at]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts, as the library gives them; none for nulls."""
        if not self.by_word:
            return [self.encode(x) for x in texts.to_pylist()]
        parts = pc.split_pattern(pc.replace_substring(texts.cast(pa.string()).fill_null(""), "\n", " "), " ")
        words = parts.flatten().dictionary_encode()
        ids, starts, sizes = self.told(words.dictionary)
        number = words.indices.to_numpy()
        lengths = sizes.take(number)
        upto = np.concatenate(([0], np.cumsum(lengths)))
        ids = ids.take(np.repeat(starts.take(number) - upto[:-1], lengths) + np.arange(upto[-1]))
        bounds = upto[np.cumsum(pc.list_value_length(parts).to_numpy())].tolist()
        return [ids[a:b] for a, b in zip([0, *bounds], bounds, strict=False)]

    def encode(self, text: str | None, marked: str | None = None) -> np.ndarray:
        """Ids of a whole text, as the library gives them; none for null. marked is the text in lower case, byte 1 after each of its pieces, if it is plain."""
        if not text:
            return np.zeros(0, np.uint32)
        if marked is not None and self.ranks:
            return self.ranks.encode_to_numpy(marked, disallowed_special=())
        return self.worded(text) if self.by_word else self.of(text)


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    return Words(path)


def apart(sizes: np.ndarray, at: np.ndarray, same: np.ndarray, after: np.ndarray) -> np.ndarray:
    """In how many places that don't overlap each pair stands; at are the places pair by pair, ascending for each, sizes how many it has.

    Places overlap in runs of one symbol only, where every second one counts from the run's start; same says which pairs are of equal symbols.
    """
    if not same.any():
        return sizes
    pair = np.repeat(np.flatnonzero(same), sizes[same])
    own = at[np.repeat(same, sizes)]
    fresh = np.concatenate(([True], (after[own[:-1]] != own[1:]) | (pair[:-1] != pair[1:])))
    step = np.arange(len(own))
    odd = (step - np.maximum.accumulate(np.where(fresh, step, 0))) % 2 == 1
    return sizes - np.bincount(pair[odd], minlength=len(sizes))


def picked(at: np.ndarray, rank: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which places are replaced if pairs are taken by rank, in a run of one symbol from its start; at is ascending.

    Of places that overlap in a row, each better than both its neighbours is taken, and from there on every second one
    for as long as they get worse. The worst of a stretch lies between two such and must be free from both.
    """
    joined = after.take(at[:-1]) == at[1:]
    worse = joined & (rank[:-1] <= rank[1:])
    step = np.arange(len(at))
    first, last = np.concatenate(([True], ~worse)), np.concatenate((worse | ~joined, [True]))
    since = step - np.maximum.accumulate(np.where(first, step, 0))
    until = np.minimum.accumulate(np.where(last, step, len(at))[::-1])[::-1] - step
    return (since | until) & 1 == 0


def grammar(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST, sweeps: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, symbols, ends): ids with repeated pairs replaced, until no pair occurs least times; ends are where documents end, in ids and then in symbols.

    Nonterminals are numbered from base on, in the order of rules; symbols have 16 bits if all of them fit, else 32. A pair across
    two documents is neither counted nor replaced. sweeps ends it after so many; by default only the lack of pairs does.

    Pairs wait in levels by their number of places: the first level goes down to half the greatest number, each other to half the
    one before. No pair gets more places once both its symbols are there, so one is counted when it arises and when its level's turn
    comes, and one with too few places is dropped. In a sweep a level's pairs are taken, the most frequent first, where better ones
    leave their places; one that these leave fewer places than the level asks for isn't taken, but counted again after the sweep.
    """
    n, ends = len(ids), ends.astype(np.int64)
    wide, deep = (np.uint64(int(x).bit_length()) for x in (base + n // 2, n))
    right, place = ((np.uint64(1) << x) - np.uint64(1) for x in (wide, deep))
    symbols = np.append(ids.astype(np.uint32), GONE)
    # the neighbours of each place within its document, n for none
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1] = before[ends] = before[0] = n
    levels: list[int] = []
    waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def wait(pairs: np.ndarray, sizes: np.ndarray, at: np.ndarray, counts: np.ndarray, first: int) -> None:
        """Pairs (two columns) and their places to the levels of their counts, from first on."""
        if not levels:
            levels.append(max((int(counts.max()) + 1) // 2, least))
            while levels[-1] > least:
                levels.append(max(levels[-1] // 2, least))
        if (stay := counts >= least).any():
            at, pairs, sizes = at[np.repeat(stay, sizes)], pairs[stay], sizes[stay]
            level = np.maximum(np.searchsorted(-np.array(levels), -counts[stay]), first).astype(np.uint8)
            order, places = np.argsort(level, kind="stable"), np.argsort(np.repeat(level, sizes), kind="stable")
            i = j = 0
            for k, m in enumerate(np.bincount(level).tolist()):  # all within levels, whose last is least
                if m:
                    own = order[i : i + m]
                    more = int(sizes[own].sum())
                    waiting.setdefault(k, []).append((pairs[own], sizes[own], at.take(places[j : j + more])))
                    i, j = i + m, j + more

    def arise(at: np.ndarray, first: int) -> None:
        """Counts the pairs in places that hold no pair counted before."""
        if not len(at):
            return
        keys = symbols.take(at).astype(np.uint64)
        keys <<= wide
        keys |= symbols.take(after.take(at))
        if 2 * int(wide) + int(deep) <= 64:
            keys <<= deep
            keys |= at.view(np.uint64)
            keys.sort()
            at = (keys & place).view(np.int64)
            keys >>= deep
        else:
            order = np.lexsort((at, keys))
            keys, at = keys[order], at[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(starts, append=len(keys))
        pairs = np.stack([keys[starts] >> wide, keys[starts] & right], axis=1).astype(np.uint32)
        wait(pairs, sizes, at, apart(sizes, at, pairs[:, 0] == pairs[:, 1], after), first)

    arise(np.flatnonzero(after[:n] < n), 0)
    rules, made, level, done = [np.zeros((0, 2), np.uint32)], base, 0, 0
    while level < len(levels) and done != sweeps:
        if level not in waiting:
            level += 1
            continue
        pairs, sizes, at = (np.concatenate(x) for x in zip(*waiting.pop(level), strict=True))
        # places that other pairs have changed since are left out
        there = (symbols.take(at) == np.repeat(pairs[:, 0], sizes)) & (symbols.take(after.take(at)) == np.repeat(pairs[:, 1], sizes))
        sizes = np.add.reduceat(there, np.cumsum(sizes) - sizes, dtype=np.int64)
        at = at[there]
        counts = apart(sizes, at, pairs[:, 0] == pairs[:, 1], after)
        if not (enough := counts >= levels[level]).all():
            each = np.repeat(enough, sizes)
            wait(pairs[~enough], sizes[~enough], at[~each], counts[~enough], level + 1)
            pairs, sizes, at, counts = pairs[enough], sizes[enough], at[each], counts[enough]
        if not len(at):
            continue
        order = np.argsort(-counts, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        found = np.sort(at << 32 | np.repeat(rank, sizes))
        spots, ranks = found >> 32, found & 0xFFFFFFFF
        for turn in range(RESOLVED):
            taken = picked(spots, ranks, after)
            left = np.bincount(ranks[taken], minlength=len(pairs))
            good = left >= levels[level]
            stay = good.take(ranks)
            if stay.all():
                break
            if turn == RESOLVED - 1:
                # those that lose no place; the first pair is among them
                good = left == counts[order]
            else:
                spots, ranks = spots[stay], ranks[stay]
        taken &= good.take(ranks)
        start, made = made, made + int(good.sum())
        rules.append(pairs[order[good]])
        own = spots[taken]
        gone = after.take(own)
        later = after.take(gone)
        symbols[own], symbols[gone] = (np.cumsum(good) - 1 + start).take(ranks[taken]), GONE
        after[own], before[later] = later, own
        if (rest := ~good.take(rank)).any():
            waiting.setdefault(level, []).append((pairs[rest], sizes[rest], at[np.repeat(rest, sizes)]))
        earlier = before.take(own)
        earlier = earlier[earlier < n]
        arise(np.concatenate([earlier[symbols.take(earlier) < start], own[later < n]]), level)
        done += 1
    there = symbols[:n] != GONE
    fits = np.uint16 if made <= 1 << 16 else np.uint32
    return np.concatenate(rules).astype(fits), symbols[:n][there].astype(fits), np.concatenate(([0], np.cumsum(there)))[ends]


def depths(rules: np.ndarray, base: int) -> Iterator[np.ndarray]:
    """Numbers of rules, those whose symbols are ids first, then those whose symbols are ids or of rules given before."""
    known = np.arange(base + len(rules)) < base
    left = np.arange(len(rules))
    while len(left):
        ready = known[rules[left]].all(axis=1)
        if not ready.any():
            raise ValueError("rules that name one another")
        yield left[ready]
        known[base + left[ready]] = True
        left = left[~ready]


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each nonterminal expands to."""
    out = np.ones(base + len(rules), np.int64)
    for now in depths(rules, base):
        out[base + now] = out[rules[now]].sum(axis=1)
    return out[base:]


class Shard:
    """A shard read back: whole documents or any stretch of one."""

    def __init__(self, row: dict):
        kind = "<u2" if row["width"] == 2 else "<u4"
        self.base = row["base"]
        named = np.frombuffer(row["named"], bool).tolist()
        self.docs = [d if n else None for d, n in zip(np.frombuffer(row["docs"], "<i8").tolist(), named, strict=True)]
        self.symbols = np.frombuffer(row["symbols"], kind)
        self.ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
        own = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        #: how many ids each symbol expands to, and where they stand among all expansions
        self.lengths = np.concatenate([np.ones(self.base, np.int64), own])
        self.places = np.cumsum(self.lengths) - self.lengths
        rules = np.frombuffer(row["rules"], kind).reshape(-1, 2)
        self.ids = np.empty(int(self.lengths.sum()), np.uint32)
        self.ids[: self.base] = np.arange(self.base)
        for now in depths(rules, self.base):
            self.ids[self.spread(now + self.base)] = self.expanded(rules[now].ravel())

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        return self.ids[self.spread(symbols)].astype("<u4", copy=False)

    def spread(self, symbols: np.ndarray) -> np.ndarray:
        """Where the ids of symbols stand among all expansions."""
        lengths = self.lengths[symbols]
        upto = np.cumsum(lengths)
        return np.repeat(self.places[symbols] - upto + lengths, lengths) + np.arange(upto[-1] if len(upto) else 0)

    def stretch(self, number: int, start: int, length: int) -> np.ndarray:
        """length ids of the shard's document of that number from start on: only the symbols that cover them are opened."""
        own = self.symbols[(self.ends[number - 1] if number else 0) : self.ends[number]]
        upto = np.cumsum(self.lengths[own])
        first, beyond = np.searchsorted(upto, start, "right"), np.searchsorted(upto, start + length, "left") + 1
        before = int(upto[first - 1]) if first else 0
        return self.expanded(own[first:beyond])[start - before : start - before + length]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ids = self.expanded(self.symbols)
        bounds = np.cumsum(self.lengths[self.symbols])[self.ends - 1].tolist()
        for doc, a, b in zip(self.docs, [0, *bounds], bounds, strict=False):
            yield doc, ids[a:b]


SHARDS = "part long, start long, n_docs long, n_ids long, base long, width int, docs binary, named binary, ends binary, rules binary, lengths binary, symbols binary"


def packed_shard(part: int, start: int, docs: list[int | None], own: list[np.ndarray], base: int) -> dict:
    """A row of SHARDS: documents with their ids."""
    rules, symbols, ends = grammar(np.concatenate(own), np.cumsum([len(x) for x in own]), base)
    kind = "<u2" if base + len(rules) <= 1 << 16 else "<u4"
    return {
        "part": part, "start": start, "n_docs": len(docs), "n_ids": sum(map(len, own)), "base": base, "width": 2 if kind == "<u2" else 4,
        "docs": np.array([d or 0 for d in docs], "<i8").tobytes(), "named": np.array([d is not None for d in docs]).tobytes(), "ends": ends.astype("<u4").tobytes(),
        "rules": rules.astype(kind).tobytes(), "lengths": lengths_of(rules, base).astype("<u4").tobytes(), "symbols": symbols.astype(kind).tobytes(),
    }


def shards(docs: DataFrame, tokenizer_path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of all documents, in ascending order of id: by part, then by start (ids before it in its part).

    Null texts are empty and hold the end id alone. Documents without an id come first; rows of one id are
    ordered by their text's hash, equal rows in any order. Other columns are not read. An empty table has no shards.
    """
    schema = pa.schema([("part", pa.int64()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("base", pa.int64()), ("width", pa.int32())] + [(x, pa.binary()) for x in ("docs", "named", "ends", "rules", "lengths", "symbols")])
    tail = np.array([end], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = words_of(tokenizer_path), TaskContext.get().partitionId()
        base, start, held, each, ids = max(words.size, end + 1), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([packed_shard(part, start, held, each, base)], schema=schema)

        for batch in (piece for whole in batches for piece in portions(whole, 1, TOGETHER)):
            for doc, found in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1)), strict=True):
                own = np.concatenate([found, tail])
                if held and ids + len(own) > SHARD:
                    yield shard()
                    start, held, each, ids = start + ids, [], [], 0
                held.append(doc)
                each.append(own)
                ids += len(own)
        if held:
            yield shard()

    # equal rows of one id may be many: a row's own number, the same on every run over the files, parts them
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("body"))
    rows = rows.withColumn("hash", F.xxhash64("body")).withColumn("row", F.monotonically_increasing_id())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc", "hash", "row"]
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return sorted_rows.select("doc", "body").mapInArrow(run, SHARDS)


def written(docs: DataFrame, tokenizer_path: str, path: str | None = None, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards, written to path (by default, to a new table in the shared folder) and read back."""
    found = shards(docs, tokenizer_path, end, id_col, text_col)
    if path is None:
        return cut(found, "shards")
    found.write.parquet(path)
    return docs.sparkSession.read.schema(SHARDS).parquet(path)


def read_back(files: DataFrame) -> DataFrame:
    """One row per document of written shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Ids are decoded from the grammars. Only the number of ids of each part, one row a partition, goes through the driver.
    """
    schema = pa.schema([("d_part", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at, out = row["start"], []
                for doc, ids in Shard(row).documents():
                    out.append((row["part"], doc, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    spark, before, total = files.sparkSession, [], 0
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_ids")).collect()):
        before.append((part, total))
        total += n
    known = spark.createDataFrame(before, "part long, before long")
    each = files.mapInArrow(run, "d_part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return each.join(F.broadcast(known), F.col("d_part") == F.col("part")).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in Re-Pair shards, read back."""
    return read_back(written(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))
