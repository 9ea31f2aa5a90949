"""A prefix trie of conversations: one row for every distinct beginning, with figures of its subtree.

A conversation is a path: 16 bytes a turn (the MD5 of role and text), put end to end, so
that byte order is the order of paths and a beginning is a prefix.  Paths are dealt out in
ranges of (path, id).  Where two ranges meet, the path that splits them and the one before
it share a prefix; only nodes on such prefixes can have members in more than one range.
They form the *skeleton*, a trie with at most one path a range, which is broadcast.  Every
other node is finished within its sorted range by one walk with a stack; the skeleton's
nodes get a partial row from each range that meets them, and are put together by a sum, a
minimum, and a walk up the skeleton.

A range is read row by row; what a task holds is one path, its open nodes, and their
children that wait for the node's least member.  A hash over members streams them in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut, partitions

WIDTH = 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ("skeleton int, conv_id bigint, depth bigint, parent_conv_id bigint, parent int, n_convs bigint, "
        "n_children bigint, n_leaves bigint, saved_tokens bigint, own_bytes bigint, ends_sha256 string")


# ---- paths ---------------------------------------------------------------------
def paths(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and ``turns`` (an array of (key, bytes) in order): a row a conversation.

    Turns are ordered by number, null first, equal numbers by key, so any order of the rows
    gives the same; null roles and texts count as empty; rows without a conversation are
    left out.  Only 16 bytes and a size go along for a turn, never its text.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    key = F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"))
    one = F.struct(F.col(turn).alias("turn"), key.alias("key"), F.octet_length(t).alias("bytes"))
    return (turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv_id"), one.alias("t"))
            .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
            .withColumn("turns", F.transform("turns", lambda x: F.struct(x["key"].alias("key"), x["bytes"].alias("bytes")))))


def forked(p: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Paths whose first ``head`` turns (``most`` at most) are those of the conversation ``base``.

    All of its turns, if it has fewer; none, if it is absent; then come the own turns after the first ``head``.
    """
    heads = p.select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most).alias("__turns"))
    d = p.withColumns({"__b": base, "__h": F.least(head, F.lit(most)).cast("int")}).join(heads, F.col("__b") == F.col("__base"), "left")
    none = F.slice("turns", 1, 0)
    before = F.when(F.col("__h") > 0, F.coalesce(F.expr("slice(__turns, 1, __h)"), none)).otherwise(none)
    return d.select("conv_id", F.concat(before, F.expr("slice(turns, __h + 1, size(turns))")).alias("turns"))


# ---- the skeleton ----------------------------------------------------------------
def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that the beginnings of two paths have in common."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: mid * WIDTH] == b[: mid * WIDTH] else (lo, mid - 1)
    return lo


class Skeleton:
    """Trie of the prefixes on which ranges meet; node 0 is the root, a parent comes before its children."""

    def __init__(self, splitters: list[bytes]):
        self.child: dict = {}
        self.parent, self.depth, self.path = [-1], [0], [b""]
        for s in splitters:
            at = 0
            for d in range(0, len(s), WIDTH):
                step = (at, s[d: d + WIDTH])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(d // WIDTH + 1)
                    self.path.append(s[: d + WIDTH])
                at = self.child[step]

    def along(self, path: bytes) -> list[int]:
        """Skeleton nodes on a path, from the root."""
        out = [0]
        for d in range(0, len(path), WIDTH):
            at = self.child.get((out[-1], path[d: d + WIDTH]))
            if at is None:
                break
            out.append(at)
        return out


def ranges(p: DataFrame) -> DataFrame:
    """(path, bytes, conv_id) dealt out in sorted ranges and written down once."""
    rows = p.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path"),
                    F.transform("turns", lambda t: t["bytes"]).alias("bytes"), "conv_id")
    n = partitions(p.sparkSession)
    return cut(rows.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id"))


def skeleton(rows: DataFrame) -> Skeleton:
    """From the first and the last path of every range: two rows a partition."""
    def edges(batches):
        first = last = None
        for b in batches:
            if b.num_rows:
                col = b.column("path")
                first, last = (col[0].as_py() if first is None else first), col[b.num_rows - 1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([first]), pa.array([last])],
                                             names=["part", "first", "last"])
    met = rows.select("path").mapInArrow(edges, "part bigint, first binary, last binary").orderBy("part").collect()
    return Skeleton([bytes(b.first[: WIDTH * shared_turns(a.last, b.first)]) for a, b in zip(met, met[1:])])


# ---- one range -------------------------------------------------------------------
class _Node:
    __slots__ = ("skeleton", "depth", "bytes", "least", "convs", "children", "leaves", "saved", "sha", "ends", "waiting")

    def __init__(self, skeleton, depth: int, size: int):
        self.skeleton, self.depth, self.bytes = skeleton, depth, size
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.sha, self.ends, self.waiting = None, 0, []

    def end(self, conv: int) -> None:
        """A member that ends here; they come in ascending order."""
        if self.skeleton is None:
            if self.sha is None:
                self.sha = hashlib.sha256()
            self.sha.update(b",%d" % conv if self.ends else b"%d" % conv)
            self.ends += 1
        self.convs += 1
        self.least = conv if self.least is None else min(self.least, conv)


class _Walk:
    """The nodes of one sorted range, from (path, sizes, conv) after (path, sizes, conv)."""

    def __init__(self, s: Skeleton):
        self.skeleton, self.path, self.open, self.out = s, None, [_Node(0, 0, 0)], []

    def add(self, path: bytes, sizes: list[int], conv: int) -> None:
        if path != self.path:
            if self.path is not None:
                self.close(shared_turns(self.path, path))
            known = self.skeleton.along(path)
            for d in range(len(self.open), len(path) // WIDTH + 1):
                self.open.append(_Node(known[d] if d < len(known) else None, d, sizes[d - 1]))
            self.path = path
        self.open[-1].end(conv)

    def close(self, depth: int) -> None:
        """Ends the open nodes below ``depth``."""
        while len(self.open) > depth + 1:
            n, up = self.open.pop(), self.open[-1]
            up.convs += n.convs
            up.least = n.least if up.least is None else min(up.least, n.least)
            if n.skeleton is None:
                n.saved += (n.convs - 1) * n.bytes
                n.leaves = n.leaves or 1
                up.children += 1
                up.leaves += n.leaves
                up.saved += n.saved
                row = [None, n.least, n.depth, None, up.skeleton, n.convs, n.children, n.leaves, n.saved, n.bytes,
                       n.sha.hexdigest() if n.sha else EMPTY]
                (self.out if up.skeleton is not None else up.waiting).append(row)
            else:
                self.partial(n)
            for row in n.waiting:
                row[3] = n.least
            self.out += n.waiting

    def partial(self, n: _Node) -> None:
        self.out.append([n.skeleton, n.least, n.depth, None, None, n.convs, n.children, n.leaves, n.saved, n.bytes, None])

    def finish(self) -> None:
        if self.path is not None:
            self.close(0)
            self.partial(self.open[0])


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_SCHEMA = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[t])
                     for n, t in (f.split() for f in NODE.split(", "))])


def _shards(rows: DataFrame, s: Skeleton) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(s)

    def run(batches):
        w = _Walk(shared.value)
        for b in batches:
            for path, sizes, conv in zip(b.column("path").to_pylist(), b.column("bytes").to_pylist(), b.column("conv_id").to_pylist()):
                w.add(path, sizes, conv)
                if len(w.out) > 20_000:
                    yield _batch(w.out, _SCHEMA)
                    w.out = []
        w.finish()
        if w.out:
            yield _batch(w.out, _SCHEMA)
    return rows.mapInArrow(run, NODE)


def _ends(rows: DataFrame, s: Skeleton) -> DataFrame:
    """Hash over the members that end at each skeleton node: only their ids move, and stream in order."""
    spark = rows.sparkSession
    known = spark.createDataFrame(list(enumerate(map(bytearray, s.path))), "skeleton int, path binary")
    ids = rows.join(F.broadcast(known), "path").select("skeleton", "conv_id").repartition("skeleton").sortWithinPartitions("skeleton", "conv_id")

    def run(batches):
        at, sha, done = None, None, ([], [])
        for b in batches:
            for node, conv in zip(b.column("skeleton").to_pylist(), b.column("conv_id").to_pylist()):
                if node != at:
                    if at is not None:
                        done[0].append(at), done[1].append(sha.hexdigest())
                    at, sha = node, hashlib.sha256(b"%d" % conv)
                else:
                    sha.update(b",%d" % conv)
        if at is not None:
            done[0].append(at), done[1].append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int32()), pa.array(done[1], pa.string())], names=["skeleton", "ends"])
    return ids.mapInArrow(run, "skeleton int, ends string")


def _whole(s: Skeleton, partial: DataFrame, ends: DataFrame) -> list[tuple]:
    """The skeleton's nodes from the partial rows of all ranges: (conv_id, depth, parent_conv_id, n_convs, ...), one a node."""
    got = {r.skeleton: r for r in partial.groupBy("skeleton").agg(
        F.min("conv_id").alias("least"), F.max("own_bytes").alias("size"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).collect()}
    sha = {r.skeleton: r.ends for r in ends.collect()}
    n = len(s.parent)
    children, leaves, saved = ([got[k][c] for k in range(n)] for c in ("n_children", "n_leaves", "saved_tokens"))
    for k in range(n - 1, -1, -1):          # children have larger numbers
        leaves[k] = leaves[k] or 1
        saved[k] += (got[k].n_convs - 1) * got[k].size
        if k:
            up = s.parent[k]
            children[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]
    return [(got[k].least, s.depth[k], got[s.parent[k]].least if k else None, got[k].n_convs, children[k], leaves[k], saved[k], sha.get(k, EMPTY))
            for k in range(n)]


def trie(p: DataFrame) -> DataFrame:
    """Every distinct beginning of the paths of ``p`` (conv_id, turns), from the empty one.

    conv_id: its least member; depth; parent_conv_id: its parent's conv_id (root: null);
    n_convs: members; n_children; n_leaves: nodes without children in its subtree, itself
    included; saved_tokens: sum over its subtree of (members - 1) times the bytes of the
    node's last text; ends_sha256: hash over the ids of the members that end here.
    Conversations without turns are members of the root; no conversations give no rows.
    """
    spark = p.sparkSession
    rows = ranges(p)
    s = skeleton(rows)
    out = cut(_shards(rows, s))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    schema = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    partial = out.filter("skeleton IS NOT NULL")
    if partial.isEmpty():
        return spark.createDataFrame([], schema)
    whole = _whole(s, partial, _ends(rows, s))
    parents = spark.createDataFrame([(k, w[0]) for k, w in enumerate(whole)], "parent int, __least bigint")
    local = (out.filter("skeleton IS NULL").join(F.broadcast(parents), "parent", "left")
             .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__least")).select(names))
    return local.unionByName(spark.createDataFrame(whole, schema))
