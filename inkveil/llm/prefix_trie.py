"""Prefix trie of conversations: a global range sort of turn arrays, adjacent LCPs, a stack sweep of LCP intervals.

A turn is 16 bytes of its digest, a conversation one binary key of its turns, so that byte order is turn order and a
prefix sorts before what extends it. Keys are range-sorted with the conversation's id behind (copies of one conversation
spread over partitions like anything else). Each partition sweeps its sorted keys with a stack: neighbours' common
prefixes open and close intervals, an interval being a branching node and the chain of nodes above it. The Python loop
runs over conversations; chains are spread out into their nodes by numpy.

Nodes on the path of a partition's first or last key may go on in its neighbours: their stacks are left open. What such a
node needs is a sum over rows, so partitions add up their shares by the prefix's digest; what two neighbours both counted
(the path that they share, a last key that the next one extends) is taken off by one row for each shared depth. The final
digest of a node's own ids runs over sorted rows as a stream. Nothing but the neighbours' two keys passes one task.

Defined results: rows without a conversation id belong to no conversation. Turns are ordered null first, equal turns by
the digest of (role, text); repeated rows are turns of their own. A null role or text is empty. A conversation may be left
without turns; it ends at the root. Very long texts are hashed whole. A conversation is one row of 16 bytes a turn, so its
turns, not their texts, must fit a task. An empty table has no nodes, no root either. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import Scratch

TURN = 16
FAMILY = 5
HEADS = 9

SWEPT = "kind string, part int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, summed long, dist long, ends string, sizes array<long>"
FIELDS = pa.schema([
    ("kind", pa.string()), ("part", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("summed", pa.int64()),
    ("dist", pa.int64()), ("ends", pa.string()), ("sizes", pa.list_(pa.int64())),
])
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations(df: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (digest and UTF-8 bytes of the text, in order), family."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    turn = F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = df.where("conv_id is not null").select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), "conv_id", turn.alias("turn"))
    return rows.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(df: DataFrame) -> DataFrame:
    """Conversations after the first turns of their family's first one: conv_id, key, sizes."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    first = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, HEADS - 1))).over(Window.partitionBy("family"))
    rows = conversations(df).select("conv_id", "turns", head.alias("head"), first.alias("first"))
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("first", none), F.lit(1), F.col("head")), F.slice("turns", F.col("head") + 1, F.size("turns")))
    return rows.select("conv_id", turns.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"),
        F.transform("turns", lambda t: t["bytes"]).alias("sizes"),
    )


def common_turns(a: bytes, b: bytes) -> int:
    """How many leading turns two keys share."""
    a, b, low, high = memoryview(a), memoryview(b), 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN] else (low, mid - 1)
    return low


def prefix_digests(key: bytes) -> list[bytes]:
    """The digest of each prefix, from the empty one on."""
    state = hashlib.sha256()
    out = [state.digest()[:TURN]]
    for at in range(0, len(key), TURN):
        state.update(key[at : at + TURN])
        out.append(state.copy().digest()[:TURN])
    return out


class Sweep:
    """The LCP intervals of sorted keys. An interval closes as a chain of nodes, depths above + 1 to depth."""

    def __init__(self, keys: list[bytes], ids: list[int], sizes: np.ndarray):
        self.keys, self.ids = keys, ids
        self.lens = [len(k) // TURN for k in keys]
        self.starts = np.concatenate([[0], np.cumsum(self.lens)]).astype(np.int64)
        self.flat, self.before = sizes, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.closed: list[list[int]] = []
        self._run()

    def _run(self) -> None:
        starts, before, closed, open_ = self.starts.tolist(), self.before.tolist(), self.closed, []
        for i in range(len(self.keys) + 1):
            shared = common_turns(self.keys[i - 1], self.keys[i]) if 0 < i < len(self.keys) else -1
            while open_ and open_[-1][0] > shared:
                # depth, first row, smallest id, children, leaves, summed and distinct bytes below, children's places
                depth, row, least, kids, leaves, summed, dist, places = open_.pop()
                above = max(shared, open_[-1][0] if open_ else -1)
                chain = before[starts[row] + depth] - before[starts[row] + max(above, 0)]
                for place in places:
                    closed[place][9] = len(closed)
                closed.append([depth, above, row, i, least, kids, max(leaves, 1), summed, dist, -1])
                if above < 0:
                    continue
                if not open_ or open_[-1][0] != above:
                    open_.append([above, row, least, 0, 0, 0, 0, []])
                parent = open_[-1]
                parent[2] = min(parent[2], least)
                parent[3] += 1
                parent[4] += max(leaves, 1)
                parent[5] += summed + (i - row) * chain
                parent[6] += dist + chain
                parent[7].append(len(closed) - 1)
            if i == len(self.keys):
                break
            if open_ and open_[-1][0] == self.lens[i]:
                open_[-1][2] = min(open_[-1][2], self.ids[i])
            else:
                open_.append([self.lens[i], i, self.ids[i], 0, 0, 0, 0, []])

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        """Nodes that are finished, shares of those that may go on in a neighbour, their ids, and the two edge keys."""
        n = len(self.keys)
        depth, above, row, end, least, kids, leaves, summed, dist, parent = np.array(self.closed, dtype=np.int64).T
        lens = np.array(self.lens)
        opened = (row == 0) | (end == n)
        own = [self._own(int(row[j]), int(end[j]), int(depth[j])) for j in range(len(depth))]
        ends = np.array([NO_ENDS if not e or o else hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e, o in zip(own, opened, strict=True)])
        paths = prefix_digests(self.keys[0]), prefix_digests(self.keys[-1])
        # spread out the chains
        count = depth - above
        j = np.repeat(np.arange(len(depth)), count)
        at = above[j] + 1 + np.arange(len(j)) - np.repeat(np.cumsum(count) - count, count)
        deep, top = at == depth[j], at == above[j] + 1
        base = self.starts[row[j]]
        below = self.before[base + depth[j]] - self.before[base + np.maximum(at - 1, 0)]
        members = (end - row)[j]
        all_summed, all_dist = summed[j] + members * below, dist[j] + below
        up = np.where(top, np.where(parent[j] < 0, 0, least[np.maximum(parent[j], 0)]), least[j])
        parent_open = top & (parent[j] >= 0) & opened[np.maximum(parent[j], 0)]
        of_first = lambda k: row[k] == 0

        def path_key(k: int, d: int) -> bytes:
            return paths[0 if of_first(k) else 1][d]

        keep = np.flatnonzero(~opened[j])
        for some in np.array_split(keep, max(1, len(keep) // 50_000)):
            if not len(some):
                continue
            hidden = parent_open[some]
            keys = [path_key(parent[j[x]], at[x] - 1) if h else None for x, h in zip(some, hidden, strict=True)]
            yield self._batch("node", part, keys, [None] * len(some), least[j][some], at[some], pa.array(up[some], mask=hidden), members[some],
                              np.where(deep, kids[j], 1)[some], leaves[j][some], all_summed[some], all_dist[some], np.where(deep[some], ends[j][some], NO_ENDS))
        wide = np.flatnonzero(opened[j])
        yield self._batch("open", part, [path_key(j[x], at[x]) for x in wide], [path_key(j[x], at[x] - 1) if at[x] else None for x in wide], least[j][wide], at[wide],
                          pa.nulls(len(wide), pa.int64()), members[wide], np.where(deep, kids[j], 1)[wide], leaves[j][wide], all_summed[wide], all_dist[wide], None)
        last = [k for k in np.flatnonzero(opened) if own[k]]
        if last:
            yield self._batch("end", part, [path_key(k, int(depth[k])) for k in last], None, *[None] * 8, [",".join(map(str, own[k])) for k in last])
        edge = self._batch("edge", part, [self.keys[0]], [self.keys[-1]], sizes=[self.flat[: lens[0]].tolist()])
        yield edge

    def _own(self, row: int, end: int, depth: int) -> list[int]:
        """The ids that end at the interval's lowest node: its first rows, since a prefix sorts before the rest."""
        to = row
        while to < end and self.lens[to] == depth:
            to += 1
        return self.ids[row:to]

    @staticmethod
    def _batch(kind, part, keys, parents, *numbers, sizes=None) -> pa.RecordBatch:
        n = len(keys)
        columns = [pa.array([kind] * n), pa.array([part] * n, pa.int32()), pa.array(keys, pa.binary()), pa.array(parents or [None] * n, pa.binary())]
        for field, values in zip(list(FIELDS)[4:13], [*numbers, *[None] * (9 - len(numbers))], strict=True):
            columns.append(pa.nulls(n, field.type) if values is None else values if isinstance(values, pa.Array) else pa.array(values, field.type))
        return pa.RecordBatch.from_arrays([*columns, pa.array(sizes or [None] * n, FIELDS[13].type)], schema=FIELDS)


def sweep_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, ids, sizes, part = [], [], [], None
    for batch in batches:
        if batch.num_rows:
            part = batch["part"][0].as_py()
            keys += batch["key"].to_pylist()
            ids += batch["conv_id"].to_pylist()
            sizes.append(np.asarray(batch["sizes"].flatten()))
    if keys:
        yield from Sweep(keys, ids, np.concatenate(sizes)).rows(part)


def shared_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a partition and the one before it both counted, to be taken off: a row for each depth of the shared path."""
    for batch in batches:
        for row in batch.to_pylist():
            if row["prev"] is None:
                continue
            depth = common_turns(row["prev"], row["key"])
            digests = prefix_digests(row["key"][: depth * TURN])
            sizes = np.array([0, *row["sizes"][:depth]], dtype=np.int64)
            leaf = -int(len(row["prev"]) == depth * TURN)
            zeros = np.zeros(depth + 1, dtype=np.int64)
            yield Sweep._batch("open", row["part"], digests, None, pa.nulls(depth + 1, pa.int64()), np.arange(depth + 1), pa.nulls(depth + 1, pa.int64()),
                               zeros, np.where(np.arange(depth + 1) < depth, -1, 0), zeros + leaf, zeros, -np.cumsum(sizes[::-1])[::-1])


def ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the ids of each key as a stream of the partitions' shares, in their order; no group is held."""
    key, state = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])

    for batch in batches:
        for k, ids in zip(batch["key"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    yield told()
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
    if key is not None:
        yield told()


def prefix_trie(df: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(df.sparkSession)
    built = scratch.table(rebuilt(df))
    ordered = built.orderBy("key", "conv_id").withColumn("part", F.spark_partition_id())
    swept = scratch.table(ordered.mapInArrow(sweep_partition, SWEPT))
    scratch.release(built)
    edges = swept.where("kind = 'edge'").select("part", "key", "parent_key", "sizes")
    edges = edges.withColumn("prev", F.lag("parent_key").over(Window.orderBy("part"))).drop("parent_key")
    opens = swept.where("kind = 'open'")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "summed", "dist")]
    shares = opens.unionByName(edges.mapInArrow(shared_edges, SWEPT))
    merged = shares.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), *sums)
    merged = scratch.table(merged)
    own = swept.where("kind = 'end'").select("key", "part", "ends").repartition("key").sortWithinPartitions("key", "part")
    own = own.mapInArrow(ends_digest, "key binary, ends string")
    ids = merged.select("key", "conv_id")
    wide = merged.join(own, "key", "left").join(ids.toDF("parent_key", "parent_conv_id"), "parent_key", "left")
    # a partition's nodes meet their open parents by (partition, prefix): the root's children stay spread
    here = opens.select("part", "key").distinct().join(ids.toDF("key", "parent_found"), "key")
    nodes = swept.where("kind = 'node'")
    below = nodes.where("key is not null").drop("parent_conv_id").join(here, ["part", "key"]).withColumnRenamed("parent_found", "parent_conv_id")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "summed", "dist", "ends"]
    out = nodes.where("key is null").select(*columns).unionByName(below.select(*columns)).unionByName(wide.select(*columns))
    return out.select(
        *columns[:6], (F.col("summed") - F.col("dist")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    )
