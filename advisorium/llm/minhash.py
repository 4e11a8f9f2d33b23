"""Operator 10, MinHash near-duplicates with odd sketches.

Whole texts become sets of word shingles. MinHash samples of many hash functions give bands for candidate
search. MinHash samples of one permutation, the smallest of each of its bins, are folded into a parity bitmap
(odd sketch) whose XOR population count estimates how alike two candidates are; only likely ones are confirmed,
on the full sets. Equal sets are one class from the start, so that copies make no pairs. In each bucket all
members are first compared with the smallest. After that, only members that are still in different components
are compared, their likeliest partners first and then ever more of them, until none is left untried: a large
group of near copies joins early and never makes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advisorium.llm.common import bounded_batches, connected_components, cut, only, portions, table

BANDS, ROWS = 45, 5
SKETCH_BITS = 2048
#: Bins of the one permutation whose samples are folded into the sketch.
SKETCH_BINS = 2048
#: Members of a bucket that are compared in one block.
GROUP = 4096
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_RANDOM.integers(2**62)) * 2 + 1)
_PLACE = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_MULTIPLY = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_SAMPLE = np.uint64(int(_RANDOM.integers(2**62)))
#: Steps of a doubling of two sets' summed sizes in the table of limits; beyond the last the limit stays.
STEPS, LAST_STEP = 16, 16 * 16


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8").translate(LOWER), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate(([False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # a polynomial in the place within the word, so that a word hashes alike wherever it stands
    longest = int((ends - starts).max())
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(longest, _BASE))))
    place = np.arange(len(raw))
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(raw))))
    value = _BYTE[raw] * power[np.minimum(place, longest)]
    value[~inside[1:-1]] = 0
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; with fewer words all of them as one, without words none."""
    own = word_hashes(text or "")
    if not len(own):
        return own
    n = min(words, len(own))
    total = np.zeros(len(own) - n + 1, np.uint64)
    for k in range(n):
        total += own[k : len(own) - n + 1 + k] * _PLACE[k]
    # sequences of fewer words differ from shingles of all by their number
    return np.unique(mix(total + np.uint64(n)))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over the set."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(_MULTIPLY), 2**32 - 1, np.uint32)
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        value = part[None, :] * _MULTIPLY[:, None]  # shingles are random already, so products by random odd numbers do
        value += _ADD[:, None]
        np.minimum(least, value.min(axis=1), out=least)
    return least


def odd_sketch(shingles: np.ndarray, bins: int = SKETCH_BINS, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap in which each bin's smallest shingle flips one bit. shingles: sorted, as a permutation has them."""
    own = shingles // np.uint64(2**64 // bins)
    samples = shingles[np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1)))]
    at = mix(samples ^ _SAMPLE) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def _flips(shared: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean flips of a bin, and their mean square, by the mean numbers of its shared shingles and those of one set only."""
    rate = shared + one + two
    differ = (one + two) / rate * -np.expm1(-rate)
    single = np.exp(-shared - two) * -np.expm1(-one) + np.exp(-shared - one) * -np.expm1(-two)
    return 2 * differ - single, 4 * differ - 3 * single


def most_flipped(total: np.ndarray, similarity: float, bins: int = SKETCH_BINS, bits: int = SKETCH_BITS, deviations: float = 4.5) -> np.ndarray:
    """XOR bits that sketches of sets this similar, or more, exceed with a chance of about 3e-6, by the sets' summed sizes.

    A bin flips two places if both sets have a sample there and these differ, one if only one set has. Its
    numbers of shingles are nearly Poisson; as all bins' sum is fixed, what follows from that sum's variation
    is taken off. The number of odd places then varies with places that are hit twice.
    """
    total = np.asarray(total, float)
    union = total / (1 + similarity)
    shared, rest, most = similarity * union / bins, (1 - similarity) * union / bins, np.zeros(len(total))
    for part in (1e-9, 0.25, 0.5):  # how the shingles that differ are split between the sets
        rates = [shared, rest * part, rest * (1 - part)]
        mean, square = _flips(*rates)
        taken = np.zeros(len(total))
        for k in range(3):
            nudged = [r * (1 + 1e-4 * (j == k)) for j, r in enumerate(rates)]
            taken += ((_flips(*nudged)[0] - mean) / (rates[k] * 1e-4)) ** 2 * rates[k]
        flips, varies = bins * mean, bins * np.maximum(square - mean**2 - taken, 0)
        even, pairs = (1 - 2 / bits) ** flips, (1 - 4 / bits) ** flips
        twice = np.maximum((bits + bits * (bits - 1) * pairs - bits**2 * even**2) / 4, 0)
        slope = -bits / 2 * np.log(1 - 2 / bits) * even
        most = np.maximum(most, bits * (1 - even) / 2 + deviations * np.sqrt(twice + slope**2 * varies))
    return np.ceil(most).astype(int) + 1


def limits(similarity: float) -> np.ndarray:
    """The most flipped bits of two sets by steps of their summed sizes, the larger end of each step counting."""
    ends = 2 ** ((np.arange(LAST_STEP + 1) + 1) / STEPS)
    return np.maximum.accumulate(most_flipped(ends, similarity))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), bands (one hash a band), sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in (part for whole in batches for part in portions(whole, 1)):
            out: list[list] = [[] for _ in range(4)]
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, words)
                if len(own):
                    least = min_hashes(own)
                    grouped = least.reshape(BANDS, ROWS).astype(np.uint64)
                    key = np.arange(BANDS, dtype=np.uint64)
                    for k in range(ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, k])
                    row = (len(own), blake2b(own.tobytes(), digest_size=16).digest(), key.view(np.int64), odd_sketch(own))
                else:
                    row = (0, None, None, None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, schema.types[1:], strict=True))], schema=schema)

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def sets_of(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id and shingles: the full sets."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 1)):
            sets = [shingle_set(x, words).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, schema.types[1])], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, shingles array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, rounds: int = 40) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Two documents are linked if 100 times their common shingles is at least percent times all their shingles,
    confirmed on full sets. A pair that similar shares no band with a chance under 6e-6 (at 75).

    Null or empty texts and texts without words have no shingles and are linked with nothing. Rows with a
    null id keep their shingle count, get a null component and are kept. Repeated rows of an id are each
    returned, in the component that any of its texts reaches. Texts of any length are read whole, other
    columns are not read, and an empty table gives no rows.
    """
    found = cut(signatures(docs, id_col, text_col, words), "signatures")
    able = found.where("doc_id is not null and digest is not null")
    repeats = not able.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    # a class has one set; its smallest id stands for it, and signatures are the same for all its rows
    classes = able.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    leads = cut(able.join(classes, "digest").where("doc_id = rep").dropDuplicates(["digest"]).select("rep", "digest", "n_shingles", "bands", "sketch"), "leads")
    members = able.select("digest", "doc_id").join(leads.select("digest", "rep"), "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()

    bucket = Window.partitionBy("key")
    buckets = leads.select("rep", F.explode("bands").alias("key"))
    # one representative can be that of several classes only if its id is repeated; it then meets itself, which the pair filter drops
    buckets = cut(buckets.withColumn("n", F.count("*").over(bucket)).withColumn("lead", F.min("rep").over(bucket)).where("n > 1").select("key", "rep", "lead"), "buckets")

    sketches = leads.select("rep", "digest", "n_shingles", "sketch", "bands")
    stars = buckets.where("rep > lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    tried = cut(probable(stars, sketches, percent), "likely")
    links = cut(confirmed(tried, docs, repeats, id_col, text_col, words, percent), "links")
    width = 1
    for _ in range(rounds):
        component = cut(connected_components(links), "component")
        # buckets that lie in one component have nothing more to tell
        held = buckets.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        held = held.withColumn("low", F.min("component").over(bucket)).withColumn("high", F.max("component").over(bucket)).withColumn("m", F.count("*").over(bucket)).where("low < high")
        pairs = cut(open_pairs(held.select("key", "rep", "component", "m"), sketches, percent, width), "open")
        fresh = cut(pairs.where("a is not null").distinct().join(tried, ["a", "b"], "left_anti"), "fresh")
        links = links.unionByName(cut(confirmed(fresh, docs, repeats, id_col, text_col, words, percent), "links"))
        if pairs.where("a is null").isEmpty():
            break
        tried, width = tried.unionByName(fresh), width * 64
    else:
        raise RuntimeError(f"candidate pairs were left after {rounds} rounds")

    # links between classes and of classes to their members, which need no check
    component = cut(connected_components(links.select("a", "b").unionByName(members)), "component")
    out = found.join(component, found["doc_id"] == component["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def open_pairs(held: DataFrame, sketches: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) in one bucket and different components whose set sizes and odd sketches allow the similarity.

    Each member gets its width likeliest partners of other components; where it has more, a row of nulls tells
    that the bucket must be asked again, with a larger width, once these pairs have joined what they can. With
    more than one partner a pair counts only in the first of the buckets that its members share.

    held has key, rep, component and m, the number of its bucket's members. Members are compared by sketch in
    blocks of about GROUP, larger buckets by pairs of blocks in tasks of their own; only likely pairs are written.
    """
    blocks = F.ceil(F.col("m") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    rows = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "key", "rep", "component", (F.col("own") > F.col("other")).alias("upper"), (F.col("own") == F.col("other")).alias("inner"))
    rows = rows.join(sketches.select("rep", "n_shingles", "sketch", *["bands"] * (width > 1)), "rep")
    rows = rows.select("g", "rep", "component", "upper", "inner", "n_shingles", "sketch", *["key", "bands"] * (width > 1))
    table = limits(percent / 100)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def likely(short: list[bool], rep: np.ndarray, component: np.ndarray, upper: np.ndarray, inner: np.ndarray, n: np.ndarray, sketch: np.ndarray, key: np.ndarray | None, bands: np.ndarray | None) -> list[np.ndarray]:
        # every pair across components has a member outside the largest one: those members ask for partners
        names, counts = np.unique(component, return_counts=True)
        left, found = np.flatnonzero(component != names[counts.argmax()]), []
        for part in np.array_split(left, len(left) * len(rep) // 500_000 + 1):
            flipped = np.bitwise_count(sketch[part][:, None] ^ sketch[None]).sum(axis=2, dtype=np.int32)
            x, y = n[part][:, None], n[None]
            fit = (flipped <= table[np.minimum(np.log2(x + y) * STEPS, LAST_STEP).astype(int)]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (component[part][:, None] != component[None])
            if not inner[0]:
                fit &= upper[part][:, None] != upper[None]
            if bands is not None:
                i, j = np.nonzero(fit)
                for at in range(0, len(i), 100_000):
                    p, q = i[at : at + 100_000], j[at : at + 100_000]
                    first = (bands[part[p]] == bands[q]).argmax(axis=1)
                    fit[p, q] = bands[q, first] == key[0]
            if (many := fit.sum(axis=1) > width).any():
                likeliest = np.argsort(np.where(fit[many], flipped[many], SKETCH_BITS + 1), axis=1, kind="stable")[:, :width]
                kept = np.zeros_like(fit[many])
                np.put_along_axis(kept, likeliest, True, axis=1)
                fit[many] = kept
                short.append(True)
            i, j = np.nonzero(fit)
            pair = np.sort(np.stack((rep[part][i], rep[j])), axis=0)
            found.append(pair[:, pair[0] < pair[1]])
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in _with_end(batches):
            whole = pa.Table.from_batches([batch]) if batch is not None else None
            both = whole if rest is None else rest if whole is None else pa.concat_tables([rest, whole])
            if both is None or not both.num_rows:
                continue
            g = both.column("g").to_numpy()
            edges = np.flatnonzero(np.diff(g)) + 1
            last = len(g) if batch is None else int(edges[-1]) if len(edges) else 0
            rest = both.slice(last)
            done = both.slice(0, last).combine_chunks()
            if not done.num_rows:
                continue
            columns = [done.column(k).to_numpy() for k in ("rep", "component", "upper", "inner", "n_shingles")]
            key = done.column("key").to_numpy() if width > 1 else None
            bands = pc.list_flatten(done.column("bands")).to_numpy().reshape(done.num_rows, -1) if width > 1 else None
            # unsigned: numpy counts the bits of a negative number's absolute value
            sketch = pc.list_flatten(done.column("sketch")).to_numpy().view(np.uint64).reshape(done.num_rows, -1)
            found, short = [], []
            for start, end in zip([0, *edges[edges < last]], [*edges[edges < last], last], strict=True):
                if end - start > 1:
                    found += likely(short, *(x[start:end] for x in columns), sketch[start:end], *(None if x is None else x[start:end] for x in (key, bands)))
            pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            pairs = np.unique(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], schema=schema)
            if short:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 2, schema=schema)

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def probable(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity and whose odd sketches differ in few enough bits."""
    one = sketches.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"), F.col("digest").alias("da"))
    two = sketches.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"), F.col("digest").alias("db"))
    both = pairs.join(one, "a").where("a <> b").join(two, "b").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("da") != F.col("db")))
    flipped = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    step = F.least(F.floor(F.log2((F.col("na") + F.col("nb")).cast("double")) * STEPS).cast("int"), F.lit(LAST_STEP))
    return both.where(flipped <= F.element_at(F.lit(limits(percent / 100).tolist()), step + 1)).select("a", "b").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, repeats: bool, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the similarity on their full sets, made anew from the texts of the documents in pairs."""
    wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b"))
    texts = only(docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")), wanted, "d")
    if repeats:
        texts = texts.dropDuplicates(["d", "t"])
    sets = sets_of(texts, "d", "t", words)
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM w),
k AS (SELECT list_sort(shingles) AS l, min(doc_id) AS rep, len(any_value(shingles)) AS n FROM s WHERE len(shingles) > 0 GROUP BY 1),
e AS (SELECT rep, n, unnest(l) AS x FROM k),
f AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
g AS (SELECT a, b FROM f UNION ALL SELECT b, a FROM f),
r AS (SELECT rep AS node, rep AS low FROM k UNION SELECT g.b, r.low FROM r JOIN g ON g.a = r.node),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN k ON list_sort(s.shingles) = k.l LEFT JOIN c ON c.node = k.rep
"""
