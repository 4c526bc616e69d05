"""Approximate nearest neighbours: NN-descent builds a graph by joins, queries search it greedily."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import discard, written

#: Nodes that one task compares or merges together.
BLOCK = 512
#: Nodes of the random blocks that first lists come from.
FIRST = 128
#: Nodes that every search may start from, beside the query's own neighbours: a fixed number.
ENTRIES = 64
#: Queries whose pools one task advances together.
TOGETHER = 16
#: Rounds after which a graph or a search that goes on is an error; no result is cut short.
GUARD = 1000


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _coded(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors back from their codes: a scale in double precision, then a byte for each component."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return raw[:, 8:].view(np.int8) * np.ascontiguousarray(raw[:, :8]).view(np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision; where squares leave its range, of rows scaled first."""
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt(((a - b) ** 2).sum(1))
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
        if len(odd):
            # halves cannot overflow
            half = a[odd] / 2 - b[odd] / 2
            most = np.abs(half).max(axis=1, initial=0)
            unit = np.where(most > 0, most, 1)
            out[odd] = np.where(most > 0, np.sqrt(((half / unit[:, None]) ** 2).sum(1)) * unit * 2, 0)
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _lists(node: np.ndarray, ids: np.ndarray, ds: np.ndarray, k: int, age: np.ndarray | None = None) -> pa.Table:
    """(node, ids, ds, age) with each node's k nearest distinct others, nearest first, ties to the smaller id.

    age: FRESH for a neighbour that a round has found, WAITING for one that has not told of itself yet, else DONE.
    """
    age = np.full(len(node), FRESH, np.int8) if age is None else age
    order = np.lexsort((ds, age, ids, node))
    node, ids, ds, age = node[order], ids[order], ds[order], age[order]
    keep = (node != ids) & np.concatenate([[True], (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])])
    node, ids, ds, age = node[keep], ids[keep], ds[keep], age[keep]
    order = np.lexsort((ids, ds, node))
    node, ids, ds, age = node[order], ids[order], ds[order], age[order]
    names, first = np.unique(node, return_index=True)
    near = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node)))) < k
    node, ids, ds, age = node[near], ids[near], ds[near], age[near]
    off = pa.array(np.append(np.searchsorted(node, names), len(node)).astype(np.int32))
    listed = {"ids": ids, "ds": ds.astype(np.float64), "age": age.astype(np.int8)}
    return pa.table({"node": names} | {c: pa.ListArray.from_arrays(off, pa.array(v)) for c, v in listed.items()})


DONE, WAITING, FRESH = range(3)
_GRAPH = "node long, ids array<long>, ds array<double>, age array<tinyint>"


def classes(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rows: key, node; nodes: node, vec), a node for each distinct usable vector, named by its least key."""
    usable = F.expr(f"`{vector}` is not null and size(`{vector}`) > 0 and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(`{vector}`, x -> x <> 0)")
    rows = vectors.where(usable & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vec"))
    # vectors of another length than most have no distance to them
    sizes = rows.groupBy(F.size("vec").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
    rows = rows.where(F.size("vec") == (sizes[0]["s"] if sizes else 0))
    nodes = written(rows.groupBy("vec").agg(F.min("key").alias("node")).select("node", "vec"), "nodes")
    return written(rows.join(nodes, "vec").select("key", "node"), "members"), nodes


class Graph:
    """A neighbour graph over nodes (node, vec). Rounds of NN-descent replace neighbours by neighbours of neighbours.

    They go on until a round changes no more than the share settled of all neighbours; rounds has their number, searched that
    of the last search.
    """

    def __init__(self, nodes: DataFrame, k: int = 32, sample: int = 16, starts: int = 2, settled: float = 0.002):
        self.nodes, self.k, self.rounds, self.searched = nodes, k, 0, 0
        self.size = nodes.count()
        if not self.size:
            self.links = nodes.sparkSession.createDataFrame([], _GRAPH)
            return
        # components become parts of the largest one, so that squares of distances stay within range
        unit = nodes.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))))).first()[0]
        self.coded = written(nodes.mapInArrow(_encoder(unit), "node long, code binary"), "codes")
        near = self._first(0)
        for salt in range(1, starts):
            near = near.unionByName(self._first(salt))
        links = written(self._merged(near), "graph")
        changed = math.inf
        while changed > settled * self.size * k:
            if self.rounds == GUARD:
                raise RuntimeError("neighbour graph did not settle")
            told = self._descend(links, sample, self.rounds)
            # those that have told of themselves now need not do so again, but to new ones
            rest = F.transform("age", lambda a, i: F.when(i < sample, DONE).otherwise(F.least(a, F.lit(WAITING))).cast("tinyint"))
            better = written(self._merged(links.withColumn("age", rest).unionByName(told)), "graph")
            changed = better.agg(F.sum(F.size(F.filter("age", lambda a: a == FRESH)))).first()[0] or 0
            discard(links)
            links, self.rounds = better, self.rounds + 1
        self.links = links

    def _blocks(self, per: int) -> int:
        return max(1, math.ceil(self.size / per))

    def _first(self, salt: int) -> DataFrame:
        """Each node's nearest in a block that a hash deals it to."""
        k = self.k

        def near(block: pa.Table) -> pa.Table:
            node, x = block.column("node").to_numpy(), _coded(block.column("code"))
            d = _squares(x, x)
            np.fill_diagonal(d, np.inf)
            m = min(k, len(node) - 1)
            if m < 1:
                return _lists(node[:0], node[:0], d[0, :0], k)
            at = np.argpartition(d, m - 1, axis=1)[:, :m]
            return _lists(np.repeat(node, m), node[at].ravel(), np.take_along_axis(d, at, 1).ravel(), k)

        dealt = self.coded.withColumn("block", F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(self._blocks(FIRST))))
        return dealt.groupBy("block").applyInArrow(near, _GRAPH)

    def _merged(self, lists: DataFrame) -> DataFrame:
        k = self.k

        def merge(part: pa.Table) -> pa.Table:
            ids = part.column("ids").combine_chunks()
            flat = [part.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "ds", "age")]
            return _lists(np.repeat(part.column("node").to_numpy(), ids.value_lengths().to_numpy()), flat[0], flat[1], k, flat[2])

        return lists.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(self._blocks(BLOCK)))).groupBy("part").applyInArrow(merge, _GRAPH)

    def _descend(self, links: DataFrame, sample: int, number: int, told: int = 8) -> DataFrame:
        """Around every node, its neighbours and those it is a neighbour of tell each other how near they are, but for two that have
        met before: only nodes with a new one around them take part."""
        near = F.arrays_zip(F.slice("ids", 1, sample).alias("u"), F.slice("age", 1, sample).alias("age"))
        out = links.select(F.col("node").alias("v"), F.inline(near)).select("v", "u", (F.col("age") != DONE).alias("new"))
        # a node that is everyone's neighbour keeps a sample of them, new ones first and others by chance, another one each round
        some = Window.partitionBy("u").orderBy(F.desc("new"), F.xxhash64("v", "u", F.lit(number)))
        back = out.withColumn("r", F.row_number().over(some)).where(F.col("r") <= 2 * sample).select(F.col("u").alias("v"), F.col("v").alias("u"), "new")
        both = out.unionByName(back).groupBy("v", "u").agg(F.max("new").alias("new"))
        busy = both.withColumn("any", F.max("new").over(Window.partitionBy("v"))).where("any").drop("any")
        around = busy.join(self.coded.withColumnRenamed("node", "u"), "u")

        def tell(part: pa.Table) -> pa.Table:
            part = part.sort_by([("v", "ascending"), ("u", "ascending")])
            v, u, new, x = part.column("v").to_numpy(), part.column("u").to_numpy(), part.column("new").to_numpy(), _coded(part.column("code"))
            edge = np.append(np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])), len(v))
            nodes, ids, ds = [], [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                d = _squares(x[a:b], x[a:b])
                np.fill_diagonal(d, np.inf)
                d[~(new[a:b, None] | new[None, a:b])] = np.inf
                m = min(told, b - a - 1)
                if m > 0:
                    at = np.argpartition(d, m - 1, axis=1)[:, :m]
                    far = np.take_along_axis(d, at, 1).ravel()
                    met = np.isfinite(far)
                    nodes.append(np.repeat(u[a:b], m)[met])
                    ids.append(u[a:b][at].ravel()[met])
                    ds.append(far[met])
            if not nodes:
                return _lists(v[:0], v[:0], x[:0].ravel()[:0], told)
            # what a task tells of one node goes on as one list
            return _lists(np.concatenate(nodes), np.concatenate(ids), np.concatenate(ds), 4 * told)

        return around.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(self._blocks(BLOCK)))).groupBy("part").applyInArrow(tell, _GRAPH)

    def neighbours(self, back: int = 32) -> DataFrame:
        """(node, near): a node's neighbours and a sample of those it is a neighbour of."""
        out = self.links.select("node", F.explode("ids").alias("to"))
        some = Window.partitionBy("to").orderBy(F.xxhash64("node", "to"))
        rest = out.withColumn("r", F.row_number().over(some)).where(F.col("r") <= back).select(F.col("to").alias("node"), F.col("node").alias("to"))
        return written(out.unionByName(rest).groupBy("node").agg(F.collect_set("to").alias("near")), "neighbours")

    def search(self, queries: DataFrame, pool: int = 256, step: int = 128) -> DataFrame:
        """(query, ids, ds) for queries (query: the node of its vector, vec): the pool nearest nodes found, by exact distance.

        A greedy search keeps each query's pool of nearest nodes seen and always asks the neighbours of the nearest step
        ones that it has not asked yet, all queries together in each round, until every pool has been asked.
        """
        near = self.neighbours()
        starts = [r["node"] for r in self.nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES).collect()]
        entries = F.explode(F.array(*map(F.lit, starts)).cast("array<long>")).alias("id")
        own = self.links.select(F.col("node").alias("query"), F.explode("ids").alias("id"))
        wanted = queries.select("query", F.col("query").alias("id")).unionByName(queries.select("query", entries)).unionByName(queries.select("query").join(own, "query")).distinct()
        none = lambda kind: F.array().cast(f"array<{kind}>")
        state = queries.select("query", F.col("vec").alias("q"), none("long").alias("ids"), none("double").alias("ds"), none("boolean").alias("asked"), none("long").alias("ask"), none("long").alias("met"))
        schema = state.schema
        part = F.pmod(F.xxhash64("query"), F.lit(max(1, math.ceil(queries.count() / TOGETHER)))).alias("part")

        def advance(old: pa.Table, new: pa.Table) -> pa.Table:
            """The pools of one block of queries with what has been measured for them."""
            if not old.num_rows:
                return old.select(schema.names)
            query, q = old.column("query").to_numpy(), _matrix(old.column("q")).astype(np.float64)
            held = {c: old.column(c).combine_chunks() for c in ("ids", "ds", "asked", "met")}
            of = np.repeat(np.arange(len(query)), held["ids"].value_lengths().to_numpy())
            met_of = np.repeat(np.arange(len(query)), held["met"].value_lengths().to_numpy())
            ids, ds, asked, met = (held[c].flatten().to_numpy(zero_copy_only=False) for c in ("ids", "ds", "asked", "met"))
            if new.num_rows:
                order = np.argsort(query)
                to = order[np.searchsorted(query[order], new.column("query").to_numpy())]
                fresh = new.column("id").to_numpy()
                of, ids, asked = np.concatenate([of, to]), np.concatenate([ids, fresh]), np.concatenate([asked.astype(bool), np.zeros(len(to), bool)])
                ds = np.concatenate([ds, distances(_matrix(new.column("vec")).astype(np.float64), q[to])])
                met_of, met = np.concatenate([met_of, to]), np.concatenate([met, fresh])
            place = lambda of: np.arange(len(of)) - np.searchsorted(of, of)
            best = np.lexsort((ids, ds, of))
            best = best[place(of[best]) < pool]
            of, ids, ds, asked = of[best], ids[best], ds[best], asked[best].astype(bool)
            open_ = np.flatnonzero(~asked)
            now = open_[place(of[open_]) < step]
            asked[now] = True
            by = np.argsort(met_of, kind="stable")
            lists = {"ids": (of, pa.array(ids, pa.int64())), "ds": (of, pa.array(ds, pa.float64())), "asked": (of, pa.array(asked, pa.bool_()))}
            lists |= {"ask": (of[now], pa.array(ids[now], pa.int64())), "met": (met_of[by], pa.array(met[by], pa.int64()))}
            edges = lambda of: pa.array(np.searchsorted(of, np.arange(len(query) + 1)).astype(np.int32))
            cols = {"query": old.column("query"), "q": old.column("q")} | {c: pa.ListArray.from_arrays(edges(of), v) for c, (of, v) in lists.items()}
            return pa.table({c: cols[c] for c in schema.names})

        def unmet(old: pa.Table, new: pa.Table) -> pa.Table:
            """The wanted pairs of one block of queries that have not been measured."""
            query, ids = old.column("query").to_numpy(), new.column("id").to_numpy()
            held = old.column("met").combine_chunks()
            met = held.flatten().to_numpy()
            order = np.argsort(query)
            to = order[np.searchsorted(query[order], new.column("query").to_numpy())] if new.num_rows else np.zeros(0, np.int64)
            names, code = np.unique(np.concatenate([met, ids]), return_inverse=True)
            key = np.concatenate([np.repeat(np.arange(len(query)), held.value_lengths().to_numpy()), to]) * len(names) + code
            fresh = ~np.isin(key[len(met) :], key[: len(met)])
            return pa.table({"query": new.column("query").filter(pa.array(fresh)), "id": new.column("id").filter(pa.array(fresh))})

        blocks = lambda rows: rows.withColumn("part", part).groupBy("part")
        self.searched = 0
        while True:
            if self.searched == GUARD:
                raise RuntimeError("search did not end")
            self.searched += 1
            # each pair is measured once
            fresh = wanted if self.searched == 1 else blocks(state.select("query", "met")).cogroup(blocks(wanted.toDF("query", "id"))).applyInArrow(unmet, "query long, id long")
            measured = fresh.join(self.nodes.withColumnRenamed("node", "id"), "id")
            measured = measured.toDF(*measured.columns)  # columns of its own, apart from those of state
            after = written(blocks(state).cogroup(blocks(measured)).applyInArrow(advance, schema), "search")
            if self.searched > 1:
                discard(state)
            state = after
            ask = state.select("query", F.explode("ask").alias("node"))
            if not ask.limit(1).count():
                break
            wanted = ask.join(near, "node").select("query", F.explode("near").alias("id")).distinct()
        return state.select("query", "ids", "ds")


def _encoder(unit: float):  # noqa: ANN202
    def encode(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(batch.schema.get_field_index("vec"))).astype(np.float64) / unit
                scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
                codes = np.concatenate([scale[:, None].view(np.uint8), np.round(x / scale[:, None]).astype(np.int8).view(np.uint8)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("node")), pa.array([c.tobytes() for c in codes], pa.binary())], names=["node", "code"])

    return encode


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, **graph: float) -> DataFrame:
    """(query_id, rank, key, score): the k nearest other rows found for rows whose key is divisible by every.

    score is the Euclidean distance of the original vectors in double precision; nearest first, ties to the smaller key.
    Equal vectors are one node of the graph and come back as rows: a query's own copies count at distance 0. Null and zero
    vectors, vectors with null or non-finite components or of another length than most, and null keys take no part. Finite
    components may be of any size; in the graph, distances below some 1e-150 of the largest component count as 0. Rows with
    one key and equal vectors are one row. With k or fewer candidates all are returned; empty tables give empty ones.
    """
    rows, nodes = classes(vectors, key, vector)
    asked = rows.where(F.col("key") % every == 0).distinct()
    index = Graph(nodes, **graph)
    queries = nodes.join(asked.select("node").distinct(), "node").select(F.col("node").alias("query"), "vec")
    found = index.search(queries).select(F.col("query").alias("node"), F.explode(F.arrays_zip(F.slice("ids", 1, k + 1).alias("ids"), F.slice("ds", 1, k + 1).alias("ds"))).alias("x"))
    found = found.select("node", F.col("x.ids").alias("near"), F.col("x.ds").alias("score"))
    # of a node's rows no result needs more than k and the query itself
    some = Window.partitionBy("node").orderBy("key")
    members = rows.distinct().withColumn("r", F.row_number().over(some)).where(F.col("r") <= k + 1).select(F.col("node").alias("near"), F.col("key").alias("member"))
    best = Window.partitionBy("query_id").orderBy("score", "member")
    listed = found.join(members, "near").join(asked.withColumnRenamed("key", "query_id"), "node").where("member <> query_id")
    ranked = listed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("member").alias(key), "score")
