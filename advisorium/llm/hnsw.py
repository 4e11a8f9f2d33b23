"""Operator 9, embedding near-duplicates with navigable small-world graphs.

Vectors of one label and dimension are dealt into shards of bounded size, each with its own hierarchical
graph. Every vector queries every shard of its label: a beam finds the neighbourhood, which is then followed
along the graph as far as links go, and cosines are verified in double precision. For each pair of shards a recall audit
of stored and of planted queries widens the beam until it misses nothing; only where it still does at full width the
pair's exact product answers. Components are joined from each pair's local ones. Equal vectors are one point throughout.
"""

from __future__ import annotations

import heapq
import math
import random
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.llm.common import connected_components, cut, table

SHARD, DEGREE, BUILD_BEAM, BEAM, MARGIN, TILE, AUDITS = 8192, 16, 48, 32, 0.03 + 1e-5, 256, 32


class Graph:
    """A hierarchical navigable small-world graph of unit vectors, by inner product."""

    def __init__(self, vectors: np.ndarray):
        self.x = vectors.astype(np.float32)
        draw = random.Random(7)
        self.layers: list[dict[int, np.ndarray]] = [{}]
        self.entry = -1
        for i in range(len(vectors)):
            self.insert(i, int(-math.log(1 - draw.random()) / math.log(DEGREE)))
        n = len(vectors)
        self.near = np.full((n, 2 * DEGREE), -1, np.int32)
        for i, own in self.layers[0].items():
            self.near[i, : len(own)] = own

    def beam(self, q: np.ndarray, entries: list[int], width: int, layer: dict[int, np.ndarray], seen: np.ndarray) -> list[tuple[float, int]]:
        """The width best nodes of a layer that a best-first walk from the entries meets, best first."""
        seen[entries] = True
        first = [(float(s), i) for s, i in zip(self.x[entries] @ q, entries, strict=True)]
        top, ahead = list(first), [(-s, i) for s, i in first]
        heapq.heapify(top)
        heapq.heapify(ahead)
        while ahead:
            s, i = heapq.heappop(ahead)
            if len(top) >= width and -s < top[0][0]:
                break
            near = layer[i]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for t, j in zip((self.x[near] @ q).tolist(), near.tolist(), strict=True):
                if len(top) < width:
                    heapq.heappush(top, (t, j))
                elif t > top[0][0]:
                    heapq.heapreplace(top, (t, j))
                else:
                    continue
                heapq.heappush(ahead, (-t, j))
        return sorted(top, reverse=True)

    def descend(self, q: np.ndarray, upto: int) -> int:
        """The nearest node by greedy steps from the top layer down to the one above upto."""
        at, best = self.entry, float(self.x[self.entry] @ q)
        for layer in self.layers[:upto:-1]:
            while len(near := layer[at]):
                scores = self.x[near] @ q
                k = int(scores.argmax())
                if scores[k] <= best:
                    break
                at, best = int(near[k]), float(scores[k])
        return at

    def chosen(self, i: int, near: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, those nearer to i than to any chosen before, then the nearest others, up to most."""
        scores = self.x[near] @ self.x[i]
        order = np.argsort(-scores, kind="stable")
        near, scores = near[order], scores[order]
        if len(near) <= most:
            return near
        between = self.x[near] @ self.x[near].T
        own: list[int] = []
        for k in range(len(near)):
            if not own or scores[k] > between[k, own].max():
                own.append(k)
                if len(own) == most:
                    break
        rest = [k for k in range(len(near)) if k not in set(own)]
        return near[np.array((own + rest)[:most])]

    def insert(self, i: int, level: int) -> None:
        q, top = self.x[i], len(self.layers) - 1
        if self.entry < 0:
            self.layers = [{i: np.zeros(0, np.int64)} for _ in range(level + 1)]
            self.entry = i
            return
        at = [self.descend(q, min(level, top))]
        for k in range(min(level, top), -1, -1):
            layer, most = self.layers[k], 2 * DEGREE if k == 0 else DEGREE
            found = self.beam(q, at, BUILD_BEAM, layer, np.zeros(len(self.x), bool))
            at = [j for _, j in found]
            layer[i] = self.chosen(i, np.array(at), DEGREE)
            for j in layer[i].tolist():
                layer[j] = np.append(layer[j], i)
                if len(layer[j]) > most:
                    layer[j] = self.chosen(j, layer[j], most)
            at = at[:1]
        if level > top:
            self.layers += [{i: np.zeros(0, np.int64)} for _ in range(level - top)]
            self.entry = i

    def within(self, q: np.ndarray, least: float, width: int, margin: float) -> np.ndarray:
        """Nodes met with a score of least at least: those of a beam, and what hangs on them within the margin."""
        seen = np.zeros(len(self.x), bool)
        found = self.beam(q, [self.descend(q, 0)], width, self.layers[0], seen)
        held = [j for s, j in found if s >= least - margin]
        all_, ahead = [np.array(held, np.int64)], np.array(held, np.int64)
        while len(ahead):
            near = self.near[ahead].ravel()
            near = np.unique(near[near >= 0])
            near = near[~seen[near]]
            seen[near] = True
            ahead = near[self.x[near] @ q >= least - margin]
            all_.append(ahead)
        return np.concatenate(all_)


def pack(graph: Graph) -> bytes:
    """Neighbours of every layer, as numbers: layers, entry, then of each layer its nodes, degrees and neighbours."""
    parts = [np.array([len(graph.layers), graph.entry])]
    for layer in graph.layers:
        keys = np.array(list(layer), np.int64)
        parts += [np.array([len(keys)]), keys, np.array([len(layer[k]) for k in layer], np.int64), *layer.values()]
    return np.concatenate(parts).astype(np.int32).tobytes()


def unpack(raw: bytes, vectors: np.ndarray) -> Graph:
    graph, data = Graph.__new__(Graph), np.frombuffer(raw, np.int32)
    graph.x, graph.layers, graph.entry, at = vectors.astype(np.float32), [], int(data[1]), 2
    for _ in range(int(data[0])):
        n = int(data[at])
        keys, degrees = data[at + 1 : at + 1 + n], data[at + 1 + n : at + 1 + 2 * n]
        at += 1 + 2 * n
        ends = np.cumsum(degrees)
        graph.layers.append({int(k): data[at + e - d : at + e] for k, d, e in zip(keys, degrees, ends, strict=True)})
        at += int(ends[-1]) if n else 0
    graph.near = np.full((len(vectors), 2 * DEGREE), -1, np.int32)
    for i, own in graph.layers[0].items():
        graph.near[i, : len(own)] = own
    return graph


def planted(targets: np.ndarray, least: float, n: int) -> np.ndarray:
    """Unit vectors each moved from a target, spread over all of them, to a cosine between least and halfway from there to 1."""
    own = targets[np.linspace(0, len(targets) - 1, n).astype(int)]
    aside = np.random.default_rng(len(targets)).normal(size=own.shape)
    aside -= (aside * own).sum(axis=1, keepdims=True) * own
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    cosine = np.linspace(least + 1e-6, (1 + least) / 2, n)[:, None]
    moved = cosine * own + np.sqrt(1 - cosine**2) * aside
    return moved / np.linalg.norm(moved, axis=1, keepdims=True)


def search(graph: Graph, queries: np.ndarray, targets: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
    """For each query the targets that the graph leads to and whose cosine, in double precision, is least at least."""
    found = []
    for q in queries:
        met = graph.within(q.astype(np.float32), least, beam, MARGIN)
        found.append(np.sort(met[targets[met] @ q >= least]))
    return found


def passing_beam(graph: Graph, queries: np.ndarray, targets: np.ndarray, least: float, beam: int = BEAM, audits: int = AUDITS) -> int:
    """The first width, doubled from beam on, at which a recall audit misses nothing; 0 if it still does with all targets.

    The audit's queries are some of those at hand and as many vectors planted near targets; what they should find is told by their
    exact product.
    """
    n = min(audits, len(queries))
    asked = np.concatenate([queries[np.linspace(0, len(queries) - 1, n).astype(int)], planted(targets, least, audits)])
    true = [np.flatnonzero(t) for t in asked @ targets.T >= least]
    while True:
        missed = [i for i, (t, f) in enumerate(zip(true, search(graph, asked, targets, least, beam), strict=True)) if np.setdiff1d(t, f, assume_unique=True).size]
        if not missed:
            return beam
        if beam >= len(targets):
            return 0
        beam = min(2 * beam, len(targets))


def product(queries: np.ndarray, targets: np.ndarray, least: float) -> list[np.ndarray]:
    """For each query all targets with a cosine of least at least, by blocks of the exact product."""
    return [np.flatnonzero(t) for start in range(0, len(queries), TILE) for t in queries[start : start + TILE] @ targets.T >= least]


def linked(queries: np.ndarray, graph: Graph, targets: np.ndarray, least: float) -> tuple[list[np.ndarray], int]:
    """(targets linked with each query, beam): by the graph at the width that passed its audit; by the product, with beam 0, where none did."""
    beam = passing_beam(graph, queries, targets, least)
    return (search(graph, queries, targets, least, beam) if beam else product(queries, targets, least)), beam


def link_pairs(a: np.ndarray, a_graph: Graph, b: np.ndarray | None, b_graph: Graph | None, least: float) -> tuple[np.ndarray, list[int]]:
    """(rows of two numbers, beams): links between two shards, or within one, found from either end. Of a link within one both orders are returned."""
    met, first = linked(a, a_graph if b is None else b_graph, a if b is None else b, least)
    near = np.concatenate([np.stack([np.full(len(m), i), m], axis=1) for i, m in enumerate(met)])
    if b is None:
        near = near[near[:, 0] != near[:, 1]]
        return np.unique(np.concatenate([near, near[:, ::-1]]), axis=0), [first]
    met, second = linked(b, a_graph, a, least)
    back = np.concatenate([np.stack([m, np.full(len(m), i)], axis=1) for i, m in enumerate(met)])
    return np.unique(np.concatenate([near, back]), axis=0), [first, second]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, report: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    Vectors are linked if their labels are equal and not null, they have one dimension, and their cosine in
    double precision is least at least. Null vectors, null ids, zero vectors and those that hold null or
    non-finite components are linked with nothing: no links, their own component, kept.

    A link is found if the graph search from either of its ends meets it; recall is audited for each pair of shards, as in passing_beam().
    report is given how many searches ran at each width (beam, searches), those by the exact product under width 0.

    Repeated rows of an id are one vector, each returned with the same values. Other columns are not read; an
    empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    able = rows.where("vec_id is not null and v is not null and label is not null").where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    classes = able.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("members"))
    points = cut(classes.withColumn("dim", F.size("v")), "points")
    members = cut(able.join(points.select("label", "v", "rep", "members"), ["label", "v"]).select("vec_id", "rep", "members").distinct(), "members")
    counts = points.groupBy("label", "dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    shard = F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")
    dealt = points.join(counts, ["label", "dim"]).withColumn("shard", shard)
    built_schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("shards", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("members", pa.binary()), ("x", pa.binary()), ("graph", pa.binary())])

    def build(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("rep").to_numpy(), kind="stable")
        x = np.array(group.column("v").to_pylist(), float)[order]
        x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        row = {k: group.column(k)[0].as_py() for k in ("label", "dim", "shards", "shard")}
        row |= {"ids": group.column("rep").to_numpy()[order].tobytes(), "members": group.column("members").to_numpy()[order].tobytes(), "x": x.tobytes(), "graph": pack(Graph(x))}
        return pa.Table.from_pylist([row], schema=built_schema)

    built = cut(dealt.groupBy("label", "dim", "shard").applyInArrow(build, "label string, dim int, shards int, shard int, ids binary, members binary, x binary, graph binary"), "graphs")
    # every shard meets itself and each later shard of its label; links are looked for from both sides
    left = built.select("label", "dim", "shards", *[F.col(c).alias(f"a_{c}") for c in ("shard", "ids", "members", "x", "graph")], F.explode(F.sequence("shard", F.col("shards") - 1)).alias("shard"))
    # each pair of shards is a task of its own, however few bytes it has: its work is what counts
    tasks = built.agg(F.sum((F.col("shards") + 1) / 2).cast("int")).first()[0] or 1
    both = left.join(built.drop("shards"), ["label", "dim", "shard"]).repartitionByRange(tasks, "label", "dim", "a_shard", "shard")
    pairs = both.select("dim", (F.col("a_shard") == F.col("shard")).alias("own"), "a_ids", "a_members", "a_x", "a_graph", "ids", "members", "x", "graph")
    found_schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("beam", pa.int32())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]

                def side(prefix: str, row: dict = row) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
                    ids, size = np.frombuffer(row[prefix + "ids"], np.int64), np.frombuffer(row[prefix + "members"], np.int64)
                    x = np.frombuffer(row[prefix + "x"]).reshape(len(ids), row["dim"])
                    return ids, size, x, unpack(row[prefix + "graph"], x)

                a_ids, a_size, a, a_graph = side("a_")
                if row["own"]:
                    b_ids, b_size = a_ids, a_size
                    near, beams = link_pairs(a, a_graph, None, None, least)
                else:
                    b_ids, b_size, b, b_graph = side("")
                    near, beams = link_pairs(a, a_graph, b, b_graph, least)
                root: dict[int, int] = {}

                def top(i: int, root: dict[int, int] = root) -> int:
                    while (j := root.setdefault(i, i)) != i:
                        root[i] = i = root[j]
                    return i

                links: dict[int, int] = defaultdict(int)
                for i, j in near.tolist():
                    one, two = int(a_ids[i]), int(b_ids[j])
                    links[one] += int(b_size[j])
                    if not row["own"]:
                        links[two] += int(a_size[i])
                    if (p := top(one)) != (q := top(two)):
                        root[max(p, q)] = min(p, q)
                # the widths that passed are rows without a node
                nodes = [*root, *[None] * len(beams)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(nodes, pa.int64()), pa.array([None if i is None else top(i) for i in nodes], pa.int64()), pa.array([None if i is None else links[i] for i in nodes], pa.int64()), pa.array([None] * len(root) + beams, pa.int32()),
                ], schema=found_schema)

    met = cut(pairs.mapInArrow(meet, "node long, root long, links long, beam int"), "found")
    if report:
        report(met.where("node is null").groupBy("beam").agg(F.count("*").alias("searches")))
    found = met.where("node is not null").drop("beam")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(members.select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    component = cut(connected_components(edges), "component")
    each = members.join(links, F.col("rep") == F.col("node"), "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n")).groupBy("vec_id").agg(F.max("n").alias("n"))
    out = rows.select("vec_id").join(each.withColumnRenamed("vec_id", "e_id"), F.col("vec_id") == F.col("e_id"), "left").join(component, F.col("vec_id") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings within labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""
