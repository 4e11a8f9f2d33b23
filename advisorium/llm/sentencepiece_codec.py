"""Operator 3, SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised, cut where no vocabulary piece can reach across, and each part is merged by an agenda
of adjacent symbol pairs in score order. Everything new in an Arrow batch is also encoded and decoded by
the sentencepiece library and compared; where the two differ, the library's ids count and the text's
agrees flag is false.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.llm.common import bounded_batches, portions, table

SPACE = "▁"
#: Chunks that a worker remembers (about 150 bytes each) before it starts anew.
REMEMBERED = 400_000


class Codec:
    """A BPE vocabulary with byte fallback, and what has been encoded with it."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.piece = [sp.id_to_piece(i) for i in every]
        self.hidden = {i for i in every if sp.is_control(i)}
        self.byte = {i: int(self.piece[i][1:-1], 16) for i in every if sp.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.id = {self.piece[i]: i for i in every if i not in self.hidden and i not in self.byte and not sp.is_unknown(i)}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.joined = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.parts: dict[str, list[int]] = {}
        self.known: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def merge(self, part: str) -> list[int]:
        """Ids of a part: the best-scored adjacent pair is merged first, of equal scores the leftmost."""
        symbols: list[str] = list(part)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        score, agenda = self.score, []
        for i in range(len(part) - 1):
            if (s := score.get(pair := symbols[i] + symbols[i + 1])) is not None:
                agenda.append((-s, i, i + 1, len(pair)))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, n = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != n:
                continue  # one of the two has been merged with another since
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = following = after[right]
            if following < len(symbols):
                before[following] = left
                if (s := score.get(pair := symbols[left] + symbols[following])) is not None:
                    heapq.heappush(agenda, (-s, left, following, len(pair)))
            if (previous := before[left]) >= 0 and (s := score.get(pair := symbols[previous] + symbols[left])) is not None:
                heapq.heappush(agenda, (-s, previous, left, len(pair)))
        ids: list[int] = []
        for x in symbols:
            if x in self.id:
                ids.append(self.id[x])
            elif x:
                ids += [self.of_byte[b] for b in x.encode()] if self.of_byte else [self.unknown]
        return ids

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk, merged part by part: parts end where two characters stand side by side in no piece."""
        ids, start = [], 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in self.joined:
                part = chunk[start:i]
                if (found := self.parts.get(part)) is None:
                    found = self.parts[part] = self.merge(part)
                ids += found
                start = i
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces with their space marks as spaces, runs of byte pieces as UTF-8; the prefix space goes."""
        out, raw = [], bytearray()
        for n, i in enumerate(ids):
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i not in self.hidden:
                piece = self.piece[i]
                out.append(piece[1:] if n == 0 and piece[0] == SPACE else piece)
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut before each run of space marks, which no piece has after other characters."""
        marked = text.replace(" ", SPACE)
        if SPACE + SPACE not in marked and marked[:1] != SPACE and marked[-1:] != SPACE:
            return marked.split(SPACE)
        found, run = [], ""
        parts = marked.split(SPACE)
        for n, x in enumerate(parts):
            if x or n == len(parts) - 1:
                found.append(run + x)
                run = ""
            else:
                run += SPACE
        return found

    def learn(self, new: list[str]) -> None:
        """Encode chunks (each stands for a space mark and itself), check them against the library, remember them."""
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.parts = {}, {}
        ids = [self.encode_chunk(SPACE + x) for x in new]
        plain = [x.replace(SPACE, " ") for x in new]
        checked = self.library.encode(plain, num_threads=1)
        back = self.library.decode(ids, num_threads=1)
        for chunk, text, own, other, other_back in zip(new, plain, ids, checked, back, strict=True):
            # the library gives nothing for an empty text, which as a chunk is one space mark
            if text and own != other or other_back != text or self.decode(own) != text:
                self.odd[chunk] = own = other if text else own
            self.known[chunk] = " ".join(map(str, own))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[str], str]]:
        """Of each text its chunks, and its ids with spaces between."""
        cut = [self.chunks(x) if x else [] for x in texts]
        known = self.known
        new = list(dict.fromkeys(x for chunks in cut for x in chunks if x not in known))
        if len(known) + len(new) > REMEMBERED:
            new = list(dict.fromkeys(x for chunks in cut for x in chunks))
        for at in range(0, len(new), REMEMBERED):
            self.learn(new[at : at + REMEMBERED])
        for chunks in cut:
            try:
                yield chunks, " ".join(map(self.known.__getitem__, chunks))
            except KeyError:  # a batch with more new chunks than are remembered
                self.learn([x for x in dict.fromkeys(chunks)])
                yield chunks, " ".join(map(self.known.__getitem__, chunks))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, ids (with the end id; only if with_ids), n_tokens, ids_sha256, decoded_sha256, agrees.

    model_path must hold on every executor. A null or empty text has the end id only and decodes to the
    empty text. A text is worked on whole, however long; repeated rows are each returned, a null id stays
    null, other columns are not read, and an empty table gives no rows.
    """
    kinds = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("agrees", pa.bool_())]
    schema = pa.schema([x for x in kinds if with_ids or x[0] != "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model_path)
        sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
        for batch in (part for whole in batches for part in portions(whole, 1)):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            out: dict[str, list] = {k: [] for k in schema.names}
            for text, (chunks, ids) in zip(texts, code.encode(texts), strict=True):
                ids = f"{ids} {code.end}" if ids else str(code.end)
                odd = bool(code.odd) and not code.odd.keys().isdisjoint(chunks)
                if odd or not text.strip(" " + SPACE):
                    back = code.library.decode([int(x) for x in ids.split()])
                else:  # every chunk decodes to itself
                    back = text.replace(SPACE, " ")
                row = {"n_tokens": ids.count(" ") + 1, "ids_sha256": sha(ids), "decoded_sha256": sha(back), "agrees": not odd}
                if with_ids:
                    row["ids"] = [int(x) for x in ids.split()]
                for k, v in row.items():
                    out[k].append(v)
            out["doc_id"] = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) if k != "doc_id" else out[k] for k, t in zip(schema.names, schema.types, strict=True)], schema=schema)

    ddl = "doc_id long, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
