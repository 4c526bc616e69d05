"""Prefix trie of conversations: succinct level-order tries per prefix shard, heavy upper levels merged by sums along paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import discard, resident, text_or_empty, written

#: Turns below a prefix up to which one shard takes all of them, and nodes of a shard, about.
SHARD_ROWS = 100_000
#: Conversations of a group that share opening turns; openings taken from it are shorter than this.
GROUP, OPENINGS = 20, 4
_NODE = ["d", "p1", "p2"]


def running(rows: DataFrame, key: str, order: list[str], totals: list[str], marks: list[str], name: str) -> DataFrame:
    """rows with totals as running sums and marks as running exclusive-ors within key, in order.

    Rows are dealt by ranges of (key, order), so that a key with very many rows is several tasks' work; what a key has
    before a range comes from the ends of ranges, two rows of each at most.
    """
    first, rest = order[:2], order[2:]
    laid = rows.repartitionByRange(F.col(key), *(F.col(c).asc_nulls_first() for c in first)).sortWithinPartitions(key, *(F.col(c).asc_nulls_first() for c in [*first, *rest]))
    kept = [c for c in rows.columns if c not in rest]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, dict.fromkeys([*totals, *marks, "_row"], np.int64(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            starts = np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]])
            group = np.cumsum(starts)
            begin = np.concatenate([[0], np.flatnonzero(starts)])[group]
            data = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            for c in before:
                own = np.ones(len(keys), np.int64) if c == "_row" else data[c].to_numpy()
                if c in marks:
                    run = np.concatenate([[0], np.bitwise_xor.accumulate(own)])
                    out = run[1:] ^ run[begin] ^ np.where(group == 0, before[c], 0)
                else:
                    run = np.concatenate([[0], np.cumsum(own)])
                    out = run[1:] - run[begin] + np.where(group == 0, before[c], 0)
                before[c], data[c] = out[-1], pa.array(out)
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(list(data.values()), names=list(data))

    kinds = dict(laid.dtypes)
    body = laid.select(*kept, F.spark_partition_id().alias("_part"))
    # what the sort needs beyond kept is dropped only after it
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), "_part int", "_row long"])
    table = written(body.mapInArrow(sums, schema), name)
    sums_of = [*totals, *marks]
    ends = table.groupBy("_part", key).agg(F.max_by(F.struct("_row", *sums_of), "_row").alias("_sum"))
    shared = ends.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    pieces = ends.join(shared, key).select("_part", key, "_sum.*").toPandas().sort_values([key, "_part"])
    offsets, have = [], {}
    for row in pieces.to_dict("records"):
        before = have.setdefault(row[key], dict.fromkeys(sums_of, 0))
        offsets.append((int(row["_part"]), row[key], *(int(before[c]) for c in sums_of)))
        have[row[key]] = {c: before[c] ^ int(row[c]) if c in marks else before[c] + int(row[c]) for c in sums_of}
    if not offsets:
        return table.drop("_part", "_row")
    more = rows.sparkSession.createDataFrame(offsets, ", ".join(["_part int", f"{key} {kinds[key]}", *(f"_before_{c} long" for c in sums_of)]))
    joined = table.join(F.broadcast(more), ["_part", key], "left")
    full = {c: F.col(c).bitwiseXOR(F.coalesce(f"_before_{c}", F.lit(0).cast("long"))) if c in marks else F.col(c) + F.coalesce(f"_before_{c}", F.lit(0)) for c in sums_of}
    return joined.select(*(full.get(c, F.col(c)).alias(c) for c in kept))


def rebuilt(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their group's first one: (c, length), and (c, d, t1, t2, w, length) of each turn.

    Turns stand in the order of turn (null first), then role and text. t1, t2 name a turn's role and text, w counts its words.
    """
    body = conversations.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("c"), F.col(turn).alias("turn"), text_or_empty(role).alias("role"), text_or_empty(text).alias("text"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    named = body.select("c", "turn", "role", "text", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"), words.alias("w"), F.lit(1).cast("long").alias("at"))
    turns = running(named, "c", ["turn", "role", "text"], ["at"], [], "turns").select("c", "at", "t1", "t2", "w")
    sizes = turns.groupBy("c").agg(F.max("at").alias("n"))
    shift = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(OPENINGS))
    own = sizes.select("c", "n", shift.alias("h"), (F.col("c") - F.col("c") % GROUP).alias("base"))
    known = own.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    known = written(known.select("c", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    heads = turns.where(F.col("at") < OPENINGS).withColumnRenamed("c", "base").join(known, "base").where(F.col("at") <= F.col("h"))
    tails = turns.join(known, "c").where(F.col("at") > F.col("h"))
    columns = ["t1", "t2", "w", "length"]
    rows = heads.select("c", F.col("at").alias("d"), *columns).unionByName(tails.select("c", (F.col("at") - F.col("h") + F.col("taken")).alias("d"), *columns))
    return known.select("c", "length"), rows


class Louds:
    """Tries in level order: bits hold for each node a 1 for every child, then a 0; labels follow the nodes. Node 0 is a root above all."""

    def __init__(self, level: np.ndarray, names: np.ndarray, parents: np.ndarray):
        """level: from 1 for those below node 0; names, parents: two rows of 64 bits each, what a node and its parent are called."""
        n = len(level)
        at = np.full(n, -1, np.int64)
        deep = np.flatnonzero(level > 1)
        if len(deep):
            at[deep] = pd.MultiIndex.from_arrays(list(names)).get_indexer(pd.MultiIndex.from_arrays(list(parents[:, deep])))
        rank = np.zeros(n + 1, np.int64)  # the last one is node 0, where -1 points
        by_level = np.argsort(level, kind="stable")
        self.levels = np.concatenate([[0], 1 + np.searchsorted(level[by_level], np.arange(1, int(level.max(initial=0)) + 2))])
        self.order = np.empty(n, np.int64)
        for a, b in zip(self.levels[1:-1], self.levels[2:], strict=True):
            some = by_level[a - 1 : b - 1]
            some = some[np.lexsort((names[0][some], rank[at[some]]))]
            rank[some] = np.arange(a, b)
            self.order[a - 1 : b - 1] = some
        self.degree = np.bincount(rank[at], minlength=n + 1)
        self.bits = np.ones(n + self.degree.sum() + 1, np.uint8)
        self.bits[np.cumsum(self.degree + 1) - 1] = 0
        self.labels = names[0][self.order]

    def parent(self) -> np.ndarray:
        """The parent of each node but node 0: how many 0 stand before the node's 1."""
        return np.cumsum(self.bits == 0)[np.flatnonzero(self.bits)]

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums of values (by node, node 0 first) over subtrees, from the deepest level up."""
        out, parent = values.copy(), self.parent()
        for a, b in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            np.add.at(out, parent[a - 1 : b - 1], out[a:b])
        return out


def _tries(light: DataFrame, columns: list[str], make, schema: str) -> DataFrame:  # noqa: ANN001
    """make(shard, columns of its nodes) for every shard."""
    ordered = light.select("shard", *columns).repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        now, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if parts:
                table = pa.Table.from_batches(parts).combine_chunks()
                yield make(int(now), {c: table[c].to_numpy() for c in columns})

        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                if a == b:
                    continue
                if shard[a] != now:
                    yield from done()
                    now, parts = shard[a], []
                parts.append(batch.slice(a, b - a))
        yield from done()

    return ordered.mapInArrow(run, schema)


def _louds(x: dict[str, np.ndarray]) -> Louds:
    return Louds(x["d"] - x["above"], np.stack([x["p1"], x["p2"]]), np.stack([x["q1"], x["q2"]]))


class Trie:
    """Nodes of the rebuilt conversations' prefixes, dealt to shards below the heavy upper levels."""

    def __init__(self, conversations: DataFrame, shard_rows: int = SHARD_ROWS, **names: str):
        self.shard_rows = shard_rows
        self.convs, turns = rebuilt(conversations, **names)
        marked = turns.select("c", "d", F.xxhash64("t1", "d").alias("p1"), F.xxhash64("t2", "d").alias("p2"), F.xxhash64("t1", "d").alias("g1"), F.xxhash64("t2", "d").alias("g2"), "w", "length")
        # a prefix is named by the exclusive or of its turns' hashes, each of a turn and its place
        self.paths = running(marked, "c", ["d"], [], ["p1", "p2"], "paths")
        below = F.sum(F.col("length") - F.col("d") + 1).alias("below")
        nodes = self.paths.groupBy(*_NODE).agg(F.count("*").alias("n_convs"), F.min("c").alias("conv"), F.max("w").alias("w"), F.max("g1").alias("g1"), F.max("g2").alias("g2"), below)
        nodes = nodes.withColumns({"q1": F.col("p1").bitwiseXOR(F.col("g1")), "q2": F.col("p2").bitwiseXOR(F.col("g2"))}).drop("g1", "g2")
        zero = F.lit(0).cast("long")
        top = self.convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv")).where("n_convs > 0")
        root = top.select(zero.alias("d"), zero.alias("p1"), zero.alias("p2"), "n_convs", "conv", zero.alias("w"), F.lit(None).cast("long").alias("below"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
        self.nodes = written(nodes.unionByName(root), "nodes")
        self.heavy = self.nodes.where(F.col("below").isNull() | (F.col("below") > shard_rows))
        self._deal()

    def _deal(self) -> None:
        """The shard of every light node: that of its path's first light prefix."""
        heavy = self.heavy.where("d > 0").select(*_NODE)
        depth = self.paths.join(heavy, _NODE, "left_semi").groupBy("c").agg(F.max("d").alias("above"))
        tops = self.paths.join(depth, "c", "left").withColumn("above", F.coalesce("above", F.lit(0))).where(F.col("d") == F.col("above") + 1)
        tops = tops.select(F.col("c").alias("conv"), "above", F.xxhash64("p1", "p2").alias("top"))
        light = self.nodes.where(F.col("below") <= self.shard_rows).join(tops, "conv")
        light = written(light, "light")
        shards = 1 + light.count() // max(1, self.shard_rows)
        self.light = light.withColumn("shard", F.pmod("top", F.lit(shards)).cast("int"))

    def tries(self) -> DataFrame:
        """(shard, n_nodes, louds, labels) of every shard: bits packed eight to a byte, and the nodes' names, node 0 left out."""

        def make(shard: int, x: dict[str, np.ndarray]) -> pa.RecordBatch:
            found = _louds(x)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(x["d"])], pa.int64()), pa.array([np.packbits(found.bits).tobytes()], pa.binary()), pa.array([found.labels.tobytes()], pa.binary())], names=["shard", "n_nodes", "louds", "labels"])

        return _tries(self.light, ["d", "above", "p1", "p2", "q1", "q2"], make, "shard int, n_nodes long, louds binary, labels binary")

    def _below(self) -> DataFrame:
        """(d, p1, p2, n_children, n_leaves, saved) of light nodes."""

        def make(_: int, x: dict[str, np.ndarray]) -> pa.RecordBatch:
            found = _louds(x)
            degree = found.degree[1:]
            put = lambda v: np.concatenate([[0], v])
            leaves = found.rolled_up(put((degree == 0).astype(np.int64)))[1:]
            saved = found.rolled_up(put(((x["n_convs"] - 1) * x["w"])[found.order]))[1:]
            cols = [x[c][found.order] for c in _NODE] + [degree, leaves, saved]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*_NODE, "n_children", "n_leaves", "saved"])

        return _tries(self.light, ["d", "above", "p1", "p2", "q1", "q2", "n_convs", "w"], make, "d long, p1 long, p2 long, n_children long, n_leaves long, saved long")

    def _above(self, below: DataFrame) -> DataFrame:
        """The same of heavy nodes: every node's own share is added along the path of its smallest conversation, then by node."""
        children = self.nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
        heavy = self.heavy.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        heavy = written(heavy.select(*_NODE, "conv", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("w")).alias("own")), "heavy")
        tops = self.light.where(F.col("d") == F.col("above") + 1).select(*_NODE, "conv").join(below, _NODE)
        shares = heavy.select("conv", "d", "leaf", "own").unionByName(tops.select("conv", "d", F.col("n_leaves").alias("leaf"), F.col("saved").alias("own")))
        shares = written(shares, "shares")
        total = shares.agg(F.sum("leaf").alias("n_leaves"), F.sum("own").alias("saved"))
        root = heavy.where("d = 0").crossJoin(total).select(*_NODE, "n_children", "n_leaves", "saved")  # one row beside one row
        inner = heavy.where("d > 0")
        members = shares.select(F.col("conv").alias("c")).distinct()
        steps = self.paths.join(inner.select(*_NODE), _NODE, "left_semi").join(members, "c", "left_semi").select("c", *_NODE)
        zero = F.lit(0).cast("long")
        both = steps.select("c", "d", "p1", "p2", zero.alias("leaf"), zero.alias("own")).unionByName(shares.where("d > 0").select(F.col("conv").alias("c"), "d", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), "leaf", "own"))
        # of one depth the share comes before the node that it counts for
        both = both.select("c", (-F.col("d")).alias("back"), F.col("p1").isNotNull().alias("step"), "d", "p1", "p2", "leaf", "own")
        summed = running(both, "c", ["back", "step"], ["leaf", "own"], [], "shares").where("step")
        rolled = summed.groupBy(*_NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("own").alias("saved"))
        return inner.join(rolled, _NODE).select(*_NODE, "n_children", "n_leaves", "saved").unionByName(root)

    def ends(self) -> DataFrame:
        """(d, p1, p2, ends_sha256): the hash of the conversations that end at a node; their ids are joined in runs of 4096 numbers."""
        last = self.paths.where(F.col("d") == F.col("length")).select(*_NODE, "c")
        zero = F.lit(0).cast("long")
        last = last.unionByName(self.convs.where("length = 0").select(zero.alias("d"), zero.alias("p1"), zero.alias("p2"), "c"))
        ids = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",")
        joined = last.groupBy(*_NODE, F.expr("shiftright(c, 12)").alias("run")).agg(ids.alias("ids"))

        def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, sha = None, None
            row = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], names=[*_NODE, "ends_sha256"])
            for batch in batches:
                out = []
                for *node, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                    if node != now:
                        if now is not None:
                            out.append(row())
                        now, sha = node, hashlib.sha256(ids.encode())
                    else:
                        sha.update(b"," + ids.encode())
                if out:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            if now is not None:
                yield row()

        ordered = joined.select(*_NODE, "run", "ids").repartition(*_NODE).sortWithinPartitions(*_NODE, "run")
        return ordered.mapInArrow(hashes, "d long, p1 long, p2 long, ends_sha256 string")

    def table(self) -> DataFrame:
        below = written(self._below(), "below")
        rolled = written(below.unionByName(self._above(below)), "rolled")
        discard(below)
        up = self.nodes.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent_conv_id"))
        every = self.nodes.join(up, ["d", "q1", "q2"], "left").join(rolled, _NODE).join(self.ends(), _NODE, "left")
        none = F.lit(hashlib.sha256(b"").hexdigest())
        return every.select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, **names: str) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie.

    A node is a distinct sequence of first turns (role, text) of rebuilt conversations, its members those that begin with it;
    names may say what key, turn, role and text are called. Turns go by turn, null first, then by role and text; equal turns
    count as often as they come; null roles and texts are empty; rows without a conversation take no part. A table without
    conversations has no nodes; other columns are not looked at. The integer division behind a group's first conversation
    rounds towards zero.

    Prefixes with more than shard_rows turns below them are heavy: each stays a row of its own, and what its subtree sums up
    comes from sums along paths. Below them whole subtrees share shards, where succinct tries in level order are rolled up.
    Prefixes are named by 128 bits.
    """
    return Trie(conversations, shard_rows, **names).table()
