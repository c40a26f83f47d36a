"""Prefix trie of conversations, built of z-fast tries.

A conversation is a sequence of turns; a node stands for a distinct sequence of first turns.  A prefix is named
by 128 bits: the exclusive or of hashes of (depth, role, text) of its turns, so names need no text and can be
continued from any turn on.

* Each task inserts its conversations, in batches, into a z-fast trie.  A compacted node (a branching or an
  end) covers the depths between its parent's and its own; its handle is its prefix at the two-fattest depth
  among them (the one divisible by the highest power of two).  Handles are hashed, so the node in whose depths
  a conversation leaves the trie is found by fat binary search, in as many look-ups as the length has binary
  digits.  The edge is split there, or a leaf is hung below.
* Edges are expanded into one row per depth, with members counted up from the ends.  A task's trie is emitted
  and begun anew beyond ``HELD`` turns; a group by name adds up what tasks found, so neither memory nor the
  share of conversations that begin alike matters.
* A node is called by its smallest member.  The nodes called by one conversation are the lower end of its path,
  so subtree sums need no recursion: along such a chain they are running sums from its end, and a whole chain's
  total goes to each node above it on that conversation's path, one row per turn at most.

A conversation is held in pieces of ``PIECE`` turn numbers, so one with very many turns is spread over tasks.
Lists of the conversations that end at a node are digested in pieces of ids, in order.

Defined results: turns are ordered by turn (null first), then by hashes of role and text; null role or text
counts as empty.  Rows without conv_id are ignored.  Repeated rows are repeated turns.  An empty table gives
an empty table.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import MIX_A, MIX_B, U64, mixed, text_or_empty, written
from tallyloom.operators.joins import salted_join
from tallyloom.operators.ordered import Scan, prefix_scan

PIECE = 4096
HELD = 1 << 19
ID_BITS = 12  # ids that differ in lower bits only are digested together
BLOCK = 100
MOST = 5  # turns that a rebuilt conversation takes from the first of its block


def fattest(a: int, b: int) -> int:
    """The number in (a, b] that is divisible by the highest power of two."""
    return b & -(1 << ((a ^ b).bit_length() - 1))


class Path:
    """Names of the prefixes of a conversation from depth ``start`` on, and the sizes of its turns."""

    __slots__ = ("start", "p", "q", "sizes")

    def __init__(self, start: int, p: np.ndarray, q: np.ndarray, sizes: np.ndarray):
        self.start, self.p, self.q, self.sizes = start, p, q, sizes


class ZFastTrie:
    """Compacted tries of conversations that begin at the same or at other prefixes (``roots``)."""

    def __init__(self):
        self.roots: dict[tuple, int] = {}
        self.handles: dict[tuple, int] = {}
        self.children: dict[tuple, int] = {}
        self.low: list[int] = []
        self.high: list[int] = []
        self.path: list[Path] = []
        self.parent: list[int] = []
        self.root: list[int] = []
        self.ends: list[int] = []
        self.least: list[int | None] = []
        self.turns = 0

    def _node(self, low: int, high: int, path: Path, parent: int) -> int:
        node = len(self.low)
        root = self.root[parent] if parent >= 0 else node
        for values, value in ((self.low, low), (self.high, high), (self.path, path), (self.parent, parent), (self.root, root), (self.ends, 0), (self.least, None)):
            values.append(value)
        return node

    def name(self, node: int, depth: int) -> tuple:
        path = self.path[node]
        return int(path.p[depth - path.start]), int(path.q[depth - path.start])

    def _enter(self, node: int) -> None:
        """Hash the node by its handle, and below its parent by its first turn."""
        low = self.low[node]
        # the tries of different roots may have the same names
        self.handles[self.root[node], self.name(node, fattest(low, self.high[node]))] = node
        self.children[self.root[node], self.name(node, low + 1)] = node

    def exit(self, root: int, names: list[tuple], start: int) -> tuple[int, int | None, int]:
        """The last node whose prefix begins the conversation, the node in whose depths it leaves, and where."""
        node, end = root, start + len(names) - 1
        a, b, inside = start, end, None
        while a < b and inside is None:
            f = fattest(a, b)
            found = self.handles.get((root, names[f - start]))
            if found is None:
                b = f - 1
            elif (high := self.high[found]) <= end and self.name(found, high) == names[high - start]:
                node, a = found, high
            else:
                inside, a = found, f
        while inside is None and (high := self.high[node]) < end:
            found = self.children.get((root, names[high + 1 - start]))
            if found is None:
                return node, None, high
            if (below := self.high[found]) <= end and self.name(found, below) == names[below - start]:
                node = found
            else:
                inside, a = found, high + 1
        if inside is None:
            return node, None, self.high[node]
        b = min(self.high[inside], end)
        while a < b:  # the last depth at which both have the same name
            middle = (a + b + 1) // 2
            if self.name(inside, middle) == names[middle - start]:
                a = middle
            else:
                b = middle - 1
        return self.parent[inside], inside, a

    def insert(self, conv: int, path: Path) -> None:
        names, start = list(zip(path.p.tolist(), path.q.tolist(), strict=True)), path.start
        end = start + len(names) - 1
        root = self.roots.get(names[0])
        if root is None:
            root = self.roots[names[0]] = self._node(start, start, path, -1)
            self.turns += 1
        node, inside, depth = self.exit(root, names, start)
        if inside is not None:
            # split the edge at the exit
            node = self._node(self.low[inside], depth, self.path[inside], self.parent[inside])
            self.low[inside], self.parent[inside] = depth, node
            self._enter(node)
            self._enter(inside)
        if depth < end:
            node = self._node(depth, end, path, node)
            self._enter(node)
            self.turns += end - depth
        self.ends[node] += 1
        least = self.least[node]
        self.least[node] = conv if least is None else min(least, conv)

    def expanded(self) -> pa.RecordBatch:
        """One row per depth of every node."""
        count, least = list(self.ends), list(self.least)
        for node in sorted(range(len(count)), key=self.high.__getitem__, reverse=True):
            # a root is as deep as its start, so it comes after all below it
            up = self.parent[node]
            if up >= 0:
                count[up] += count[node]
                if least[up] is None or least[node] < least[up]:
                    least[up] = least[node]
        kept = [n for n in range(len(count)) if self.high[n] > self.low[n]]
        roots = [n for n in self.roots.values() if self.high[n] == 0]
        none = np.zeros(0, U64)
        cut = lambda which, shift: np.concatenate(
            [none, *(which(p := self.path[n])[self.low[n] + 1 - shift - p.start : self.high[n] + 1 - shift - p.start] for n in kept)]
        )
        spans = np.array([self.high[n] - self.low[n] for n in kept], np.int64)
        depth = np.concatenate([np.zeros(0, np.int64), *(np.arange(self.low[n], self.high[n]) + 1 for n in kept)])
        zero = np.zeros(len(roots), np.int64)
        each = lambda values: np.repeat(np.array([values[n] for n in kept], np.int64), spans)
        head = lambda values: np.array([values[n] for n in roots], np.int64)
        columns = {
            "p1": np.append(cut(lambda p: p.p, 0).view(np.int64), zero),
            "p2": np.append(cut(lambda p: p.q, 0).view(np.int64), zero),
            "q1": np.append(cut(lambda p: p.p, 1).view(np.int64), zero),
            "q2": np.append(cut(lambda p: p.q, 1).view(np.int64), zero),
            "depth": np.append(depth, zero),
            "size": np.append(cut(lambda p: p.sizes, 0).view(np.int64), zero),
            "conv": np.append(each(least), head(least)),
            "convs": np.append(each(count), head(count)),
        }
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})


TURN = "array<struct<turn:bigint,h1:bigint,h2:bigint,size:bigint>>"
NODES = "p1 long, p2 long, q1 long, q2 long, depth long, size long, conv long, convs long"


def turn_pieces(conversations: DataFrame) -> DataFrame:
    """conv, piece, turns (hashed, in order), before (turns in earlier pieces), last (no later piece)."""
    role, text = text_or_empty("role"), text_or_empty("text")
    number = F.col("turn").cast("long")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.coalesce(F.floor(number / PIECE).cast("long"), F.lit(-(1 << 62))).alias("piece"),
        F.struct(
            number.alias("turn"),
            F.xxhash64(role, text).alias("h1"),
            F.xxhash64(F.lit("other"), text, role).alias("h2"),
            F.length(text).cast("long").alias("size"),
        ).alias("t"),
    )
    pieces = written(rows.groupBy("conv", "piece").agg(F.sort_array(F.collect_list("t")).alias("turns")), "turns")
    along = W.partitionBy("conv").orderBy("piece")
    places = pieces.select("conv", "piece", F.size("turns").cast("long").alias("n")).select(
        "conv",
        "piece",
        F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lead("piece").over(along).isNull().alias("last"),
    )
    return pieces.join(places, ["conv", "piece"])


def as_given(pieces: DataFrame) -> DataFrame:
    """The conversations as they are: conv, piece, start (depth before the piece), turns, last."""
    return pieces.select("conv", "piece", F.col("before").alias("start"), "turns", "last")


def rebuilt(pieces: DataFrame) -> DataFrame:
    """The contract's conversations: the first turns come from the first conversation of the block."""
    h = F.crc32(F.col("conv").cast("string")) % (MOST + 1)
    first = (
        pieces.filter((F.col("conv") % BLOCK == 0) & (F.col("before") < MOST))
        .select(F.col("conv").alias("base"), F.struct("before", F.expr(f"slice(turns, 1, int({MOST} - before))").alias("t")).alias("s"))
        .groupBy("base")
        .agg(F.flatten(F.sort_array(F.collect_list("s"))["t"]).alias("opening"))
    )
    rows = pieces.withColumns({"h": h.cast("int"), "base": F.col("conv") - F.col("conv") % BLOCK}).join(first, "base", "left")
    rows = rows.withColumn("opening", F.expr(f"slice(coalesce(opening, cast(array() as {TURN})), 1, h)"))
    own = "slice(turns, int(greatest(h - before, 0)) + 1, size(turns))"
    return rows.select(
        "conv",
        "piece",
        F.expr("if(before = 0, 0, size(opening) + greatest(before - h, 0))").cast("long").alias("start"),
        F.expr(f"if(before = 0, concat(opening, {own}), {own})").alias("turns"),
        "last",
    ).filter("size(turns) > 0 OR last")  # a piece left without turns would begin where the next one does


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Place in the batch, start, two hashes per turn (depth, role, text) and size of each row's turns."""
    starts = batch.column("start").to_pylist()
    lists = batch.column("turns")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    h1, h2, size = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for i in (1, 2, 3))
    counts = np.diff(offsets)
    offsets -= offsets[0]
    depth = np.arange(len(flat)) - np.repeat(offsets[:-1] - np.array(starts, np.int64), counts) + 1
    salt = mixed(depth.astype(U64) * MIX_A)
    x, y = mixed(h1 ^ salt), mixed(h2 + salt * MIX_B)
    for n, start in enumerate(starts):
        a, b = offsets[n], offsets[n + 1]
        yield n, start, x[a:b], y[a:b], size[a:b]


def _named(batch: pa.RecordBatch) -> Iterator[tuple[int, Path]]:
    """Place in the batch and path of each row."""
    s1, s2 = (batch.column(c).to_numpy().view(U64) for c in ("s1", "s2"))
    for n, start, x, y, size in _hashed(batch):
        p = np.bitwise_xor.accumulate(np.concatenate([s1[n : n + 1], x]))
        q = np.bitwise_xor.accumulate(np.concatenate([s2[n : n + 1], y]))
        yield n, Path(start, p, q, np.concatenate([np.zeros(1, U64), size]))


def _with_names(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pieces with the name of the prefix before each, and (conv, e1, e2): the name of each whole conversation."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [(np.bitwise_xor.reduce(x), np.bitwise_xor.reduce(y)) for _, _, x, y, _ in _hashed(batch)]
            xs, ys = (np.array([s[i] for s in sums], U64).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("piece"), batch.column("last"), pa.array(xs), pa.array(ys)],
                names=["conv", "piece", "last", "x", "y"],
            )

    sums = sequences.mapInArrow(total, "conv long, piece long, last boolean, x long, y long")
    along = W.partitionBy("conv").orderBy("piece")
    before, here = along.rowsBetween(W.unboundedPreceding, -1), along.rowsBetween(W.unboundedPreceding, 0)
    names = sums.select(
        "conv",
        "piece",
        "last",
        F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("s1"),
        F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("s2"),
        F.bit_xor("x").over(here).alias("e1"),
        F.bit_xor("y").over(here).alias("e2"),
    )
    names = written(names, "prefixes")
    wholes = names.filter("last").select("conv", "e1", "e2")
    return sequences.join(names.select("conv", "piece", "s1", "s2"), ["conv", "piece"]), wholes


def _task_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = ZFastTrie()
    for batch in batches:
        convs = batch.column("conv").to_pylist()
        for n, path in _named(batch):
            trie.insert(convs[n], path)
            if trie.turns >= HELD:
                yield trie.expanded()
                trie = ZFastTrie()
    if trie.low:
        yield trie.expanded()


def _above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals of chains, once for each node above them on their conversation's path."""
    for batch in batches:
        tops, totals, leaves = (batch.column(c).to_numpy() for c in ("top", "total", "leaf"))
        p, q, n_rows = [np.zeros(0, U64)], [np.zeros(0, U64)], np.zeros(batch.num_rows, np.int64)
        for n, path in _named(batch):
            first = 0 if path.start == 0 else 1  # the name before a later piece belongs to the piece before
            stop = max(min(len(path.p), int(tops[n]) - path.start), first)
            p.append(path.p[first:stop])
            q.append(path.q[first:stop])
            n_rows[n] = stop - first
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.view(np.int64) if x.dtype == U64 else x) for x in (np.concatenate(p), np.concatenate(q), np.repeat(totals, n_rows), np.repeat(leaves, n_rows))],
            names=["p1", "p2", "total", "leaf"],
        )


def trie_nodes(sequences: DataFrame) -> DataFrame:
    """All nodes: p1, p2 (name), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    sequences = written(sequences, "sequences")
    named, wholes = _with_names(sequences)
    named = written(named, "paths")
    name = ["p1", "p2"]
    nodes = (
        named.mapInArrow(_task_tries, NODES)
        .groupBy(*name)
        .agg(F.min("conv").alias("conv"), F.sum("convs").alias("convs"), *[F.first(c).alias(c) for c in ("q1", "q2", "depth", "size")])
    )
    nodes = written(nodes, "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("children"))
    nodes = nodes.join(children, name, "left").withColumns(
        {
            "children": F.coalesce("children", F.lit(0)),
            "leaf": F.col("children").isNull().cast("long"),
            "own": (F.col("convs") - 1) * F.col("size"),
            "up": -F.col("depth"),
        }
    )
    nodes = written(nodes, "trie-children")
    # along a chain, from its end up; then the chains' totals on the paths above them
    chains = prefix_scan(nodes, ["conv"], "up", {"below": Scan("sum", "own"), "leaves": Scan("sum", "leaf")})
    tops = nodes.groupBy("conv").agg(
        F.sum("own").alias("total"), F.sum("leaf").alias("leaf"), F.min("depth").alias("top"), F.min_by(F.struct("p1", "p2", "q1", "q2"), "depth").alias("k")
    )
    tops = written(tops.filter("top > 0"), "trie-chains")
    paid = named.join(tops.select("conv", "total", "leaf", "top"), "conv").filter("start < top")
    above = paid.mapInArrow(_above, "p1 long, p2 long, total long, leaf long").groupBy(*name).agg(
        F.sum("total").alias("total"), F.sum("leaf").alias("more")
    )
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"))
    hung = salted_join(tops.select("k.*"), parents, ["q1", "q2"], F.col("p1")).select(*name, "parent")
    ends = end_digests(wholes)
    return chains.join(above, name, "left").join(hung, name, "left").join(ends, name, "left").select(
        *name,
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"),
        F.col("convs").alias("n_convs"),
        F.col("children").alias("n_children"),
        (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("n_leaves"),
        (F.col("below") + F.coalesce("total", F.lit(0))).alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def end_digests(wholes: DataFrame) -> DataFrame:
    """p1, p2, sha: the digest of the ids of the conversations that end there, ascending, joined by commas.

    Ids are joined by ranges of ids first; a digest takes the pieces of its node in order, one at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            done = []
            for p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids")), strict=True):
                if (p1, p2) == last:
                    sha.update(b",")
                else:
                    if last:
                        done.append((*last, sha.hexdigest()))
                    last, sha = (p1, p2), hashlib.sha256()
                sha.update(ids.encode())
            yield _digests(done)
        if last:
            yield _digests([(*last, sha.hexdigest())])

    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = wholes.groupBy(F.col("e1").alias("p1"), F.col("e2").alias("p2"), F.shiftright("conv", ID_BITS).alias("range")).agg(ids.alias("ids"))
    dealt = pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "range")
    return dealt.mapInArrow(digest, "p1 long, p2 long, sha string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["p1", "p2", "sha"])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the conversations as they are, with the role and text of each node's last turn."""
    pieces = turn_pieces(conversations)
    nodes = trie_nodes(as_given(pieces)).drop("p1", "p2")
    turns = pieces.select(
        F.col("conv").alias("conv_id"), "before", F.posexplode("turns").alias("i", "t")
    ).select("conv_id", (F.col("before") + F.col("i") + 1).alias("depth"), "t.h1", "t.h2")
    role, text = text_or_empty("role"), text_or_empty("text")
    texts = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit("other"), text, role).alias("h2"),
        role.alias("role"),
        text.alias("text"),
    ).dropDuplicates(["conv_id", "h1", "h2"])
    return nodes.join(turns, ["conv_id", "depth"], "left").join(texts, ["conv_id", "h1", "h2"], "left").drop("h1", "h2")


def trie_query(conversations: DataFrame) -> DataFrame:
    return trie_nodes(rebuilt(turn_pieces(conversations))).drop("p1", "p2")


def oracle_sql() -> str:
    """The same nodes by plain SQL: every prefix as a row, subtrees by a join of prefixes."""
    return f"""
        WITH RECURSIVE turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        crcs(conv_id, s, i, c) AS (
            SELECT DISTINCT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM turns
            UNION ALL
            SELECT conv_id, s, i + 1, {_crc_step()} FROM crcs WHERE i < length(s)),
        ids AS (
            SELECT c.conv_id, xor(c, 4294967295) % 6 AS h, conv_id - conv_id % 100 AS base,
                   (SELECT count(*) FROM turns t WHERE t.conv_id = c.conv_id - c.conv_id % 100) AS n_base
            FROM crcs c WHERE i = length(s)),
        rebuilt AS (
            SELECT i.conv_id, t.pos AS depth, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.pos <= i.h
            UNION ALL
            SELECT i.conv_id, t.pos - i.h + least(i.h, i.n_base), t.role, t.text
            FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > i.h),
        paths AS (
            SELECT conv_id, 0 AS depth, '' AS key, NULL::VARCHAR AS up, 0::BIGINT AS size FROM ids
            UNION ALL
            SELECT conv_id, depth, sha256(names) AS key,
                   CASE WHEN depth = 1 THEN '' ELSE sha256(lag(names) OVER (PARTITION BY conv_id ORDER BY depth)) END, size
            FROM (SELECT conv_id, depth, length(text) AS size,
                         string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS names FROM rebuilt)),
        nodes AS (
            SELECT key, depth, any_value(up) AS up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs
            FROM paths GROUP BY key, depth),
        kids AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
        full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (key)),
        below AS (
            SELECT p.key, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
                   sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
            FROM full_nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.key),
        ends AS (
            SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
            FROM (SELECT conv_id, key FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY key)
        SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children,
               b.n_leaves, b.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM full_nodes n LEFT JOIN full_nodes u ON u.key = n.up JOIN below b ON b.key = n.key LEFT JOIN ends e ON e.key = n.key"""


def _crc_step() -> str:
    """One byte of the checksum: eight shifts."""
    c = "xor(c, ord(substr(s, i + 1, 1))::BIGINT)"
    return f"list_reduce([{c}, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
