"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Rows are dealt to shards by a hash, as many as a bound of rows for each asks for.  A shard's vectors are inserted into a layered graph: a vector close to
one already there joins that one's group instead, so dense groups don't crowd the links; others are linked to
neighbours picked for their diversity.  Every vector then queries every shard by beam search over the groups' leaders;
all members of the groups that could hold a link are compared in double precision.  A stated sample of rows is also
compared with all rows, in blocks; while the graphs find too few of their links, beams are widened.  If the widest beam
fails the audit too, every vector is compared with all leaders, which is exact.  Searches of many vectors advance
together, one hop at a time, so that the work is in matrix operations.

A task holds one shard at a time and a few hundred of the rows that query it: graphs are written in small pieces, which
are sorted before the rows that query them, and both are read as a stream.  Vectors given in single precision stay so
until they're compared.

A query reports how many members it links to and one edge per group: members join a leader only if they are linked to
it for certain, by more than single precision can be wrong, so groups are connected, and edges stay few however dense a
group is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, in_small_batches, load

#: Least cosine of a link; least number of shards and most rows of one; neighbours per vector (twice that on the lowest
#: layer); beam at insertion.
LINK, SHARDS, SHARD_ROWS, DEGREE, BUILD_BEAM = 0.95, 6, 200_000, 12, 48
#: Most numbers in the vectors of a shard: long vectors need more shards.
SHARD_NUMBERS = 1 << 24
#: First beam of the queries, the widest one, rows of the audit sample and the recall that it must show.
BEAM, WIDEST, AUDIT_ROWS, RECALL = 32, 1024, 2000, 0.995
#: What a cosine in single precision may be off by.
SLACK = 1e-5
#: Vectors that search together, and vectors of one query block.
TOGETHER, QUERY_BLOCK = 512, 1 << 18
#: Bytes that tell which leaders a search has seen; bytes of a piece of a graph, and of a row group of pieces.
SEEN, PIECE, PIECES = 1 << 26, 1 << 16, 8 << 20


class Graph:
    """Layers of a shard: `links[k]` has each leader's neighbours on layer k, -1 where there are fewer."""

    def __init__(self, dim: int, degree: int = DEGREE, beam: int = BUILD_BEAM, join: float = LINK + SLACK, seed: int = 0):
        self.degree, self.beam, self.join, self.rng = degree, beam, join, np.random.default_rng(seed)
        self.x = np.empty((0, dim), np.float32)  # leaders
        self.links: list[np.ndarray] = []
        self.entry, self.depth = -1, 0  # the leader that searches start from, and how many layers have links

    def search(self, queries: np.ndarray, entries: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the best `beam` leaders found for each query, best first, -1 where there are fewer."""
        n, links, x = len(queries), self.links[layer], self.x
        most = max(1, SEEN // len(x))
        if n > most:
            parts = [self.search(queries[k : k + most], entries[k : k + most], beam, layer) for k in range(0, n, most)]
            return tuple(np.concatenate(a) for a in zip(*parts))
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        done = np.zeros((n, beam), bool)
        seen = np.zeros((n, len(x)), bool)
        width = min(beam, entries.shape[1])
        ids[:, :width] = entries[:, :width]
        sims[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("qkd,qd->qk", x[ids[:, :width]], queries), -np.inf)
        rows = np.arange(n)
        seen[np.repeat(rows, width), ids[:, :width].ravel()] = True
        while len(rows):
            open_ = np.where(done[rows] | (ids[rows] < 0), -np.inf, sims[rows])
            j = open_.argmax(axis=1)
            live = open_[np.arange(len(rows)), j] > -np.inf
            rows, j = rows[live], j[live]
            if not len(rows):
                break
            done[rows, j] = True
            near = links[ids[rows, j]]
            fresh = (near >= 0) & ~seen[rows[:, None], near]
            seen[rows[:, None], near] |= near >= 0
            near_sims = np.where(fresh, np.einsum("qkd,qd->qk", x[near], queries[rows]), -np.inf).astype(np.float32)
            better = near_sims > sims[rows].min(axis=1, keepdims=True)
            hit = better.any(axis=1)
            if hit.any():
                r = rows[hit]
                all_sims = np.concatenate([sims[r], near_sims[hit]], axis=1)
                best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                take = lambda a, b: np.take_along_axis(np.concatenate([a, b], axis=1), best, axis=1)
                ids[r], done[r] = take(ids[r], near[hit]), take(done[r], np.zeros_like(near[hit], bool))
                sims[r] = np.take_along_axis(all_sims, best, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, axis=1)
        return np.where(np.isfinite(sims), np.take_along_axis(ids, order, axis=1), -1), sims

    def descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """Entry points on layer `down_to`: from the top, the nearest leader of each layer."""
        at = np.full((len(queries), 1), self.entry, np.int64)
        for layer in range(len(self.links) - 1, down_to, -1):
            at = self.search(queries, at, 1, layer)[0]
        return at

    def near(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return self.search(queries, self.descend(queries, 0), beam, 0)

    def insert(self, batch: np.ndarray) -> np.ndarray:
        """Adds unit vectors; the leader of each.  Those of one batch see the graph before it and one another."""
        n, first = len(batch), len(self.x)
        own = batch @ batch.T
        if first:
            old_ids, old_sims = self.near(batch, self.beam)
        else:
            old_ids, old_sims = np.full((n, 1), -1, np.int64), np.full((n, 1), -np.inf, np.float32)
        leader = np.full(n, -1, np.int64)
        new: list[int] = []
        for i in range(n):
            if old_sims[i, 0] >= self.join:
                leader[i] = old_ids[i, 0]
            elif new and own[i, new].max() >= self.join:
                leader[i] = first + int(own[i, new].argmax())
            else:
                leader[i] = first + len(new)
                new.append(i)
        if not new:
            return leader
        self.x = np.concatenate([self.x, batch[new]])
        levels = np.floor(-np.log(self.rng.random(len(new))) / math.log(self.degree)).astype(int)
        top = int(levels.max())
        for k, links in enumerate(self.links):
            self.links[k] = np.concatenate([links, np.full((len(new), links.shape[1]), -1, np.int32)])
        while len(self.links) <= top:
            self.links.append(np.full((len(self.x), self.degree * (1 + (not self.links))), -1, np.int32))
        for k in range(top + 1):
            at = np.nonzero(levels >= k)[0]
            if k == 0:
                ids, sims = old_ids[new], old_sims[new]
            elif first and k < self.depth:
                ids, sims = self.search(self.x[first + at], self.descend(self.x[first + at], k), self.beam, k)
            else:
                ids, sims = np.full((len(at), 1), -1, np.int64), np.full((len(at), 1), -np.inf, np.float32)
            among = self.x[first + at] @ self.x[first + at].T
            np.fill_diagonal(among, -np.inf)
            width = min(len(at), self.beam)
            peers = np.argpartition(-among, width - 1, axis=1)[:, :width]
            peer_sims = np.take_along_axis(among, peers, axis=1)
            ids = np.concatenate([ids, np.where(np.isfinite(peer_sims), first + at[peers], -1)], axis=1)
            sims = np.concatenate([sims, peer_sims], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            chosen = self.diverse(self.x[first + at], ids, sims, self.degree)
            self.links[k][first + at, : chosen.shape[1]] = chosen
            self.link_back(k, first + at, chosen)
        if top + 1 > self.depth:
            self.entry, self.depth = first + int(levels.argmax()), top + 1
        return leader

    def diverse(self, of: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row up to `most` of its candidates, best first: one that is nearer to a chosen one than to the row
        gives way; places left over go to the best that gave way."""
        n, width = ids.shape
        width = min(width, 3 * most)
        ids, sims = ids[:, :width], sims[:, :width]
        x = self.x[np.maximum(ids, 0)]
        among = np.einsum("nid,njd->nij", x, x)
        kept = np.zeros((n, width), bool)
        for i in range(width):
            rival = (np.where(kept[:, :i], among[:, i, :i], -np.inf)).max(axis=1, initial=-np.inf)
            kept[:, i] = (ids[:, i] >= 0) & (rival < sims[:, i]) & (kept[:, :i].sum(axis=1) < most)
        rank = np.where(kept, 0, 1) * width + np.arange(width) + np.where(ids < 0, 4 * width, 0)
        order = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(np.where(ids >= 0, ids, -1), order, axis=1)

    def link_back(self, layer: int, rows: np.ndarray, chosen: np.ndarray) -> None:
        """The chosen neighbours link back; a row of links that overflows is chosen anew."""
        links = self.links[layer]
        src, dst = np.repeat(rows, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, at, count = np.unique(dst, return_index=True, return_counts=True)
        full = []
        for node, a, c in zip(nodes.tolist(), at.tolist(), count.tolist()):
            have = links[node]
            have = have[have >= 0]
            both = np.unique(np.concatenate([have, src[a : a + c]]))
            if len(both) <= links.shape[1]:
                links[node, : len(both)] = both
            else:
                full.append((node, both))
        for k in range(0, len(full), TOGETHER // 4):
            some = full[k : k + TOGETHER // 4]
            width = max(len(b) for _, b in some)
            ids = np.full((len(some), width), -1, np.int64)
            for j, (_, b) in enumerate(some):
                ids[j, : len(b)] = b
            nodes = np.array([node for node, _ in some])
            sims = np.where(ids >= 0, np.einsum("nkd,nd->nk", self.x[np.maximum(ids, 0)], self.x[nodes]), -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")
            picked = self.diverse(self.x[nodes], np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1), links.shape[1])
            links[nodes] = -1
            links[nodes, : picked.shape[1]] = picked


def unit(vectors: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which of the vectors have a direction: not null, zero or with a null or
    non-finite component.  Vectors of another length than `dim` can't be compared and count as having none."""
    dim = max((len(v) for v in vectors if v is not None), default=0) if dim is None else dim
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim and None not in v:
            out[i] = v
    peak = np.abs(out).max(axis=1, initial=0)
    ok = np.isfinite(peak) & (peak > 0)
    out[ok] /= peak[ok, None]
    out[~ok] = 0
    out[ok] /= np.linalg.norm(out[ok], axis=1)[:, None]
    return out, ok


def sizes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `unit` divides each row by, the peak first; vectors in double precision are unit vectors already."""
    peak, norm = np.ones(len(x)), np.ones(len(x))
    if x.dtype == np.float32:
        for k in range(0, len(x), 4096):
            y = x[k : k + 4096].astype(np.float64)
            peak[k : k + 4096] = np.abs(y).max(axis=1, initial=0)
            norm[k : k + 4096] = np.linalg.norm(y / peak[k : k + 4096, None], axis=1)
    return peak, norm


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision of vectors that have a direction."""
    peak, norm = sizes(x)
    return x / peak[:, None] / norm[:, None]


def build(ids: np.ndarray, x: np.ndarray, link: float = LINK) -> dict[str, np.ndarray]:
    """The graph of a shard with its members, grouped by leader."""
    g, leader, at = Graph(x.shape[1], join=link + SLACK), np.empty(len(x), np.int64), 0
    order = np.argsort(ids, kind="stable")
    while at < len(x):
        n = min(TOGETHER, max(16, at // 4), len(x) - at)
        leader[at : at + n] = g.insert(directions(x[order[at : at + n]]).astype(np.float32))
        at += n
    ids = ids[order]
    by = np.argsort(leader, kind="stable")
    first = np.searchsorted(leader[by], np.arange(len(g.x) + 1))
    heads = np.full(len(g.x), 0, np.int64)
    heads[leader[::-1]] = ids[::-1]  # the first member of a group is its leader
    links = {f"links{k}": v for k, v in enumerate(g.links)}
    return {"ids": ids[by], "x": x[order[by]], "first": first, "heads": heads, "leaders": g.x, "top": np.array([g.entry, len(g.links)]), **links}


class Shard:
    """A built graph, ready to be queried."""

    def __init__(self, z: dict[str, np.ndarray]):
        self.ids, self.x, self.first, self.heads = z["ids"], z["x"], z["first"], z["heads"]
        self.peak, self.norm = sizes(self.x)
        self.graph = Graph(self.x.shape[1])
        self.graph.x, self.graph.entry = z["leaders"], int(z["top"][0])
        self.graph.links = [z[f"links{k}"] for k in range(int(z["top"][1]))]

    def links(self, ids: np.ndarray, x: np.ndarray, beam: int | None, link: float = LINK):
        """For each query how many members it links to, itself left out, and edges: queries' ids and leaders' ids.
        Without a beam all leaders are compared, as they are where the widest beam may have missed some.

        A member of at least cosine `link` to the query is within the angles of link and group of the leader.
        """
        reach = math.cos(min(math.pi, 2 * math.acos(link))) - 1e-4
        counts, edges = np.zeros(len(x), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if not len(self.x):
            return counts, edges[0]
        leaders = self.graph.x

        def verify(q, qi, rows, groups):
            """Compares queries with the members of groups in double precision."""
            by = np.argsort(groups, kind="stable")
            rows, groups = rows[by], groups[by]
            cut = np.nonzero(np.diff(groups, prepend=-1))[0]
            for a, b in zip(cut, [*cut[1:], len(groups)]):
                g, r = groups[a], rows[a:b]
                lo, hi = self.first[g], self.first[g + 1]
                some = np.zeros(len(r), bool)
                for m in range(lo, hi, 4096):
                    to = slice(m, min(hi, m + 4096))
                    linked = q[r] @ (self.x[to] / self.peak[to, None] / self.norm[to, None]).T >= link
                    linked &= qi[r][:, None] != self.ids[None, to]
                    counts[at + r] += linked.sum(axis=1)
                    some |= linked.any(axis=1)
                if some.any():
                    edges.append((qi[r[some]], np.full(some.sum(), self.heads[g])))

        for at in range(0, len(x), TOGETHER):
            q, qi = x[at : at + TOGETHER], ids[at : at + TOGETHER]
            todo, width = np.arange(len(q)), min(beam or 0, len(leaders))
            while beam is not None and len(todo):  # a beam whose last leader is still within reach may have missed others
                near, sims = self.graph.near(q[todo].astype(np.float32), width)
                short = (sims[:, -1] >= reach) & (near[:, -1] >= 0) & (width < len(leaders))
                r, c = np.nonzero((sims >= reach) & (near >= 0) & ~short[:, None])
                verify(q, qi, todo[r], near[r, c])
                todo = todo[short]
                if 2 * width > WIDEST:
                    break
                width = min(2 * width, len(leaders))
            for k in range(0, len(leaders) if len(todo) else 0, 1 << 13):
                r, c = np.nonzero(q[todo].astype(np.float32) @ leaders[k : k + (1 << 13)].T >= reach)
                verify(q, qi, todo[r], c + k)
        return counts, tuple(np.concatenate(a) for a in zip(*edges))


def _unit_rows(dim: int, single: bool):
    """Vectors with a direction as bytes: unit vectors, or as they are where they're in single precision."""

    def run(batches):
        for b in batches:
            given = b.column(1).to_pylist()
            x, ok = unit(given, dim)
            kept = [(np.array(v, np.float32) if single else u).tobytes() if k else None for v, u, k in zip(given, x, ok)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], names=["id", "unit"])

    return run


def _matrix(column, single: bool) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32 if single else np.float64).reshape(len(column), -1)


def pieces(arrays: dict[str, np.ndarray]):
    """(name, type, length, width, bytes) of arrays, a few rows of one at a time; width 0 for a flat one."""
    for name, a in arrays.items():
        step = max(1, PIECE // (a.itemsize * math.prod(a.shape[1:])))
        for k in range(0, len(a), step):
            yield name, a.dtype.str, len(a), a.shape[1] if a.ndim > 1 else 0, a[k : k + step].tobytes()


class Pieces:
    """Arrays that are put together from their pieces, which come in order."""

    def __init__(self):
        self.arrays: dict[str, np.ndarray] = {}
        self.at: dict[str, int] = {}

    def add(self, name: str, kind: str, length: int, width: int, data: bytes) -> None:
        if name not in self.arrays:
            self.arrays[name], self.at[name] = np.empty((length, width) if width else length, kind), 0
        piece = np.frombuffer(data, kind).reshape((-1, width) if width else -1)
        self.arrays[name][self.at[name] : self.at[name] + len(piece)] = piece
        self.at[name] += len(piece)


GRAPHS = "shard int, seq int, name string, kind string, length long, width int, data binary"


def _build(link: float, single: bool):
    """Rows of (shard, id, unit), sorted by shard, to pieces of graphs."""

    def graph(shard, parts):
        ids, x = (np.concatenate(a) for a in zip(*parts))
        parts.clear()
        for k, p in enumerate(pieces(build(ids, x, link))):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, k, *p), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()))], names=["shard", "seq", "name", "kind", "length", "width", "data"])

    def run(batches):
        shard, parts = None, []
        for b in batches:
            of = b.column(0).to_numpy()
            cut = [0, *(np.nonzero(np.diff(of))[0] + 1).tolist(), len(of)]
            for lo, hi in zip(cut, cut[1:]):
                if hi == lo:
                    continue
                if parts and of[lo] != shard:
                    yield from graph(shard, parts)
                shard = int(of[lo])
                parts.append((b.column(1).slice(lo, hi - lo).to_numpy().copy(), _matrix(b.column(2).slice(lo, hi - lo).to_pylist(), single)))
        if parts:
            yield from graph(shard, parts)

    return run


def _query(beam: int | None, link: float):
    """Answers some rows (id, unit: their directions) that query a shard."""

    def run(key, shard, rows):
        import pandas as pd

        ids = rows["id"].to_numpy()
        counts, (a, b) = shard.links(ids, np.stack(rows["unit"]), beam, link)
        a, b = a[a != b], b[a != b]
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        some = counts > 0
        heads = [np.unique(b[lo:hi]) for lo, hi in zip(np.searchsorted(a, ids[some]), np.searchsorted(a, ids[some], "right"))]
        return pd.DataFrame({"id": ids[some], "n": counts[some], "heads": pd.Series(heads, dtype=object)})

    return run


def _serve(query, single: bool):
    """Pieces of graphs, each graph's followed by the rows that query it, to answers of `query`."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("heads", pa.list_(pa.int64()))])

    def run(batches):
        import pandas as pd

        key, graph, shard = None, Pieces(), None
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            heads = list(zip(*(b.column(k).to_pylist() for k in (3, 4, 5, 6))))
            at = 0
            while at < len(keys):
                if keys[at] != key:
                    key, graph, shard = keys[at], Pieces(), None
                if heads[at][0] is not None:
                    graph.add(*heads[at], b.column(7)[at].as_py())
                    at += 1
                    continue
                end = at + 1
                while end < min(len(keys), at + TOGETHER) and keys[end] == key:
                    end += 1
                if graph.arrays:
                    shard = shard or Shard(graph.arrays)
                    x = directions(_matrix(b.column(7).slice(at, end - at).to_pylist(), single))
                    rows = pd.DataFrame({"id": b.column(8).slice(at, end - at).to_numpy(), "unit": list(x)})
                    out = query(key, shard, rows)
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name].tolist(), f.type) for f in schema], schema=schema)
                at = end

    return run


def _exact(sample_ids: np.ndarray, sample: np.ndarray, link: float, single: bool):
    def run(batches):
        total = np.zeros(len(sample_ids), np.int64)
        for b in batches:
            if b.num_rows:
                ids, x = b.column(0).to_numpy(), directions(_matrix(b.column(1).to_pylist(), single))
                total += ((sample @ x.T >= link) & (sample_ids[:, None] != ids[None, :])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(sample_ids), pa.array(total)], names=["id", "n"])

    return run


def link_embeddings(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", link: float = LINK, shards: int = SHARDS, beam: int | None = BEAM, widest: int = WIDEST) -> DataFrame:
    """One row per row: id, n_links, component_id, kept (id = component_id).

    Vectors that are null, zero or hold null or non-finite components link with nothing, like those whose length is
    not the commonest of the table (of equally common ones the longest).  Ids are taken as unique; rows that repeat one
    are compared with others but not with each other.  A null id keeps its row, unlinked.  An empty table gives no
    rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "hnsw")
    in_small_batches(spark, 2 * TOGETHER)
    base = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    lengths = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).where("dim > 0").orderBy(F.desc("n"), F.desc("dim")).first()
    dim, single = lengths["dim"] if lengths else 0, base.schema["v"].dataType.elementType.typeName() == "float"
    rows = scratch.keep(base.mapInArrow(_unit_rows(dim, single), "id long, unit binary"), "units")
    sound = rows.where("id is not null and unit is not null")
    n = sound.count()
    shards = max(shards, -(-n // SHARD_ROWS), -(-n * dim // SHARD_NUMBERS))
    dealt = sound.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    ordered = dealt.select("shard", "id", "unit").repartition("shard").sortWithinPartitions("shard")
    graphs = scratch.keep(ordered.mapInArrow(_build(link, single), GRAPHS), "graphs", **{"parquet.block.size": PIECES})
    blocks = max(1, -(-n // QUERY_BLOCK))
    in_blocks = lambda df: df.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("to")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))
    served = graphs.select(F.col("shard").alias("to"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "seq", "name", "kind", "length", "width", "data", F.lit(None).cast("long").alias("id"))

    def ask(queries: DataFrame, width: int | None) -> DataFrame:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("kind", "string"), ("length", "long"), ("width", "int"))]
        asked = in_blocks(queries).select("to", "block", F.lit((1 << 31) - 1).alias("seq"), *none, F.col("unit").alias("data"), "id")  # after all pieces
        both = served.unionByName(asked).repartition("to", "block").sortWithinPartitions("to", "block", "seq")
        return both.mapInArrow(_serve(_query(width, link), single), "id long, n long, heads array<long>")

    # the audit: a bounded random sample of rows against all rows; those that have links must find theirs
    sample = sound.orderBy(F.xxhash64("id", F.lit(2))).limit(AUDIT_ROWS).collect()
    if sample and beam is not None:
        ids, x = np.array([r["id"] for r in sample], np.int64), directions(_matrix([r["unit"] for r in sample], single))
        true = {r["id"]: r["n"] for r in sound.mapInArrow(_exact(ids, x, link, single), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where("n > 0").collect()}
        picked = sound.join(F.broadcast(spark.createDataFrame([(int(i),) for i in true], "id long")), "id", "left_semi")
        while true and beam is not None:
            found = {r["id"]: r["n"] for r in ask(picked, beam).groupBy("id").agg(F.sum("n").alias("n")).collect()}
            shares = [min(found.get(i, 0), k) / k for i, k in true.items()]
            if sum(shares) >= RECALL * len(shares) and sum(min(found.get(i, 0), k) for i, k in true.items()) >= RECALL * sum(true.values()):
                break
            beam = 2 * beam if beam < widest else None
    found = scratch.keep(ask(sound, beam), "links")
    edges = found.select(F.col("id").alias("a"), F.explode("heads").alias("b"))
    parts = connected_components(spark, edges, scratch)
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    return (
        rows.select("id")
        .join(counts, "id", "left")
        .join(parts.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
        )
    )


def op1_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(load(spark, sf_dir, "embeddings"))
