"""Near-duplicate documents by b-bit MinHash, with every link confirmed on the full shingle sets.

* A document's set are its distinct shingles.  Documents with equal sets are one class, named by its
  smallest id, so exact copies never meet each other again.
* A signature keeps the low ``BITS`` bits of ``HASHES`` minima, packed.  Bands of ``ROWS`` whole minima
  propose candidates: at a similarity of 0.8 a pair escapes all bands with probability (1 - 0.8 ** 4) ** 24,
  about 3 in a million.
* The share of equal lanes, counted by bit operations and corrected for chance collisions (1 in
  2 ** BITS), estimates the similarity.  Pairs far below the threshold (four standard errors) go.
* First round: each class is paired with the smallest class of each of its buckets, so a bucket yields
  as many pairs as members.  Pairs are confirmed on their whole sets, and links become components.
* Second round: buckets whose members still lie in more than one component compare those members, in
  blocks of ``BLOCK``: first on packed signatures, to find the documents that could be linked at all,
  then, for these, on the full sets too.  A pair is looked at in the first band it shares, and only
  links that join two components leave the task.  After it, every candidate pair lies within a
  component or is refuted.

Components come from alternating large-star and small-star joins on the link table; links of the second round
join components, so only components meet again.  Joins are merge joins: no side passes the driver.

Defined results: null texts and texts without words have an empty set, no links, and are their own
component.  Rows with equal id are one document;
``keep_one`` keeps the one whose columns have the smallest hash.  A row with a null id takes part, sorts after all ids,
has a null component only if its whole group has null ids, and is kept only then.  An empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import MIX_A, U64, bounded, mixed, ranges, shingles, slices, text_or_empty, word_hashes, written, written_with

HASHES = 96
ROWS = 4
BANDS = HASHES // ROWS
BITS = 4
PERCENT = 80
BLOCK = 1000
BLOCK_BYTES = 1 << 20
LOWEST_LANE = U64(0x1111111111111111)
LARGEST = (1 << 63) - 1
NO_ID = LARGEST - (1 << 40)  # stands, with a hash below it, for a null id


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(1, HASHES + 1, dtype=U64)
    return mixed(base * MIX_A) | U64(1), mixed(base + MIX_A)


def sets_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of the texts, one after the other, and how many each has."""
    words, counts = word_hashes([t.lower() for t in texts])
    values, n = shingles(words, counts, size)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.bincount(owner[fresh], minlength=len(texts))


def minima(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The minima of HASHES hash functions over each non-empty set."""
    a, b = _seeds()
    full = np.flatnonzero(counts)
    starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    out = np.empty((len(full), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(((values * a[j] + b[j]) >> U64(32)).astype(np.uint32), starts)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, packed into 64-bit words."""
    lanes = 64 // BITS
    words = (low & np.uint32((1 << BITS) - 1)).astype(U64).reshape(len(low), -1, lanes)
    return np.bitwise_or.reduce(words << (np.arange(lanes, dtype=U64) * U64(BITS)), axis=2)


def estimate(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (last axis: words)."""
    differ = one ^ other
    shift = 1
    while shift < BITS:
        differ = differ | (differ >> U64(shift))
        shift *= 2
    unequal = np.bitwise_count(differ & LOWEST_LANE).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def lowest_estimate(percent: int) -> float:
    s = percent / 100
    return s - 4 * (s * (1 - s) / HASHES) ** 0.5 / (1 - 1 / (1 << BITS))


def _batches(batches: Iterator[pa.RecordBatch], column: int):
    for batch in slices(batches):
        texts = [(t or "").encode("utf-8", "replace") for t in batch.column(column).to_pylist()]
        for a, b in bounded([len(t) for t in texts], BLOCK_BYTES):
            yield batch, a, b, texts[a:b]


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """id, n, h1 and h2 (hashes of the set), sig (packed) and bands of every row; null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, texts in _batches(batches, 1):
            values, counts = sets_of(texts, size)
            full = np.flatnonzero(counts)
            at = np.full(b - a, -1)
            at[full] = np.arange(len(full))
            if len(full):
                starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                low = minima(values, counts)
                sig = packed(low).view(np.uint8).reshape(len(full), -1)
                h1 = np.add.reduceat(mixed(values), starts).view(np.int64)
                h2 = np.bitwise_xor.reduceat(mixed(values + MIX_A), starts).view(np.int64)
                keys = np.zeros((len(full), BANDS), U64)
                for j in range(ROWS):
                    keys = mixed(keys + MIX_A) ^ low[:, j::ROWS].astype(U64)
                keys = mixed(keys).view(np.int64)
            pick = lambda f: [f(i) if i >= 0 else None for i in at]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(counts, pa.int64()),
                    pa.array(pick(lambda i: int(h1[i])), pa.int64()),
                    pa.array(pick(lambda i: int(h2[i])), pa.int64()),
                    pa.array(pick(lambda i: sig[i].tobytes()), pa.binary()),
                    pa.array(pick(lambda i: keys[i]), pa.list_(pa.int64())),
                ],
                names=["id", "n", "h1", "h2", "sig", "bands"],
            )

    return docs.mapInArrow(sign, "id long, n long, h1 long, h2 long, sig binary, bands array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """id, h1 and the sorted shingle hashes of every row with words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, texts in _batches(batches, 1):
            values, counts = sets_of(texts, size)
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "items"])

    return docs.mapInArrow(cut, "id long, items array<long>").filter(F.size("items") > 0)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as links of each node to the smallest node it is joined with in this batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, right = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[left], label[right])
            best = label.copy()
            for end in (label[left], label[right]):
                np.minimum.at(best, end, low)
            best = best[label]
            while (best != (further := best[best])).any():
                best = further
            if (best == label).all():
                break
            label = best
        moved = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) for every node of the undirected links (a, b); component is the smallest node.

    Alternating large-star and small-star joins, one written table per round; tasks contract their links
    before they write them, so chains that lie in one task take no rounds.  A round's number of links and
    their checksum are observed while it is written; they stay when all links are stars.
    """

    def kept(df: DataFrame) -> tuple[DataFrame, dict]:
        rows = df.mapInArrow(_contracted, "a long, b long")
        return written_with(rows, purpose, n=F.count(F.lit(1)), sum=F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 40)), F.lit(0)))

    edges, seen = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while seen["n"]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = down.join(least.hint("merge"), F.col("a") == F.col("u")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges, now = kept(small.filter("a <> b").distinct())
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b"), F.col("b")).distinct())


def relabelled(df: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """``df`` with the component of ``column`` in its place, where it has one."""
    names = found.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    joined = df.join(names.hint("merge"), F.col(column) == F.col("__node"), "left")
    return joined.withColumn(column, F.coalesce("__component", column)).drop("__node", "__component")


def sets_among(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The full sets of the documents with these ids; the texts are shuffled once."""
    return written(full_sets(docs.join(ids.hint("merge"), "id", "left_semi"), size), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    other = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    met = pairs.join(one.hint("merge"), "a").join(other.hint("merge"), "b").withColumn("common", F.size(F.array_intersect("x", "y")).cast("long"))
    alike = 100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))
    return met.filter(alike).select("a", "b").distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures are similar enough to be worth confirming."""
    lowest = lowest_estimate(percent)
    one = classes.select(F.col("rep").alias("a"), F.col("sig").alias("s"))
    other = classes.select(F.col("rep").alias("b"), F.col("sig").alias("t"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(i).to_pylist()), U64).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(estimate(s, t) >= lowest))

    rows = pairs.join(one.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "s", "t")
    return rows.mapInArrow(score, "a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """Bucket members dealt to pairs of blocks: a bucket of n members has n / BLOCK blocks."""
    sizes = members.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(sizes.hint("merge"), ["band", "key"]).withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    rows = rows.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"lo": F.least("mine", "theirs"), "hi": F.greatest("mine", "theirs")})


def _candidates(table: pa.Table, comp: np.ndarray, lowest: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each member with those it may be linked with; ``comp`` may change on the way."""
    mine, hi = table.column("mine").to_numpy(), table.column("hi").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), U64).reshape(len(comp), -1)
    same_block = bool((table.column("lo").to_numpy() == hi).all())
    left = np.arange(len(comp)) if same_block else np.flatnonzero(mine != hi)
    right = left if same_block else np.flatnonzero(mine == hi)
    for n, i in enumerate(left):
        near = right[n + 1 :] if same_block else right
        near = near[comp[near] != comp[i]]
        if len(near):
            yield i, near[estimate(sig[near], sig[i]) >= lowest]


def _still_apart(members: DataFrame, lowest: float) -> DataFrame:
    """The ids of members with a similar signature in another component of their bucket."""

    def find(table: pa.Table) -> pa.Table:
        rep, seen = table.column("rep").to_numpy(), np.zeros(table.num_rows, bool)
        for i, near in _candidates(table, table.column("comp").to_numpy(), lowest):
            seen[near] = True
            seen[i] |= len(near) > 0
        return pa.table({"id": pa.array(rep[seen], pa.int64())})

    return _blocks(members).groupBy("band", "key", "lo", "hi").applyInArrow(find, "id long").distinct()


def _links_between(members: DataFrame, lowest: float, percent: int) -> DataFrame:
    """Links (a, b) that join components of a bucket, confirmed on the members' full sets."""

    def link(table: pa.Table) -> pa.Table:
        rep, comp = table.column("rep").to_numpy(), table.column("comp").to_numpy().copy()
        band = table.column("band")[0].as_py()
        keys = np.stack(table.column("bands").to_pylist()).astype(np.int64)[:, :band]
        items = table.column("items").combine_chunks()
        sizes = np.diff(items.offsets.to_numpy()).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        values, item = np.unique(items.flatten().to_numpy(), return_inverse=True)
        flag = np.zeros(len(values), np.int64)
        a, b = [], []
        for i, near in _candidates(table, comp, lowest):
            near = near[~(keys[near] == keys[i]).any(axis=1)]  # else an earlier band has the pair
            if not len(near):
                continue
            own = item[starts[i] : starts[i] + sizes[i]]
            flag[own] = 1
            at = item[ranges(starts[near], sizes[near])]
            common = np.add.reduceat(flag[at], np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            flag[own] = 0
            for j in near[100 * common >= percent * (sizes[i] + sizes[near] - common)]:
                if comp[j] != comp[i]:
                    a.append(min(rep[i], rep[j]))
                    b.append(max(rep[i], rep[j]))
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _blocks(members).groupBy("band", "key", "lo", "hi").applyInArrow(link, "a long, b long").distinct()


def _members(met: DataFrame, found: DataFrame) -> DataFrame:
    """Bucket members (band, key, rep, sig) with their component, in buckets of more than one component."""
    labelled = relabelled(met.withColumn("comp", F.col("rep")), "comp", found).select("band", "key", "rep", "sig", "comp")
    several = labelled.groupBy("band", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y")
    return labelled.join(several.select("band", "key").hint("merge"), ["band", "key"])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id (surrogate for null), n and component of every row of ``docs``."""
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))
    hidden = F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(1 << 39))
    rows = rows.select(F.coalesce("id", hidden).alias("id"), "text")
    signed = written(signatures(rows, size), "signatures")
    classes = (
        signed.filter("n > 0")
        .groupBy("h1", "h2")
        .agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    )
    classes = written(classes, "classes")
    buckets = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    pivots = buckets.groupBy("band", "key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"))
    met = buckets.join(pivots.filter("pivot < last").hint("merge"), ["band", "key"]).select("band", "key", "rep", "pivot")
    met = written(met, "buckets")
    pairs = met.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    tried = written(_estimated(pairs, classes, percent), "pairs")
    ids = tried.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = written(confirmed(tried, sets_among(ids, rows, size), percent), "links")
    found = components(links)
    # second round: buckets that lie in more than one component
    members = _members(met.select("band", "key", "rep").join(classes.select("rep", "sig").hint("merge"), "rep"), found)
    members = written(members, "members")
    lowest = lowest_estimate(percent)
    ids, apart = written_with(_still_apart(members, lowest), "still-apart", n=F.count(F.lit(1)))
    named = relabelled(classes.select("h1", "h2", F.col("rep").alias("component")), "component", found)
    if apart["n"]:
        sets = sets_among(ids, rows, size).dropDuplicates(["id"]).withColumnRenamed("id", "rep")
        whole = members.join(classes.select("rep", "bands").hint("merge"), "rep").join(sets.hint("merge"), "rep")
        fresh, more = written_with(_links_between(whole, lowest, percent), "more-links", n=F.count(F.lit(1)))
        if more["n"]:
            # new links join whole components: only those meet again
            between = relabelled(relabelled(fresh, "a", found), "b", found)
            named = relabelled(named, "component", components(between))
    # rows -> classes -> components
    named = named.select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), "component")
    same = (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2"))
    joined = signed.select("id", "n", "h1", "h2").join(named.hint("merge"), same, "left")
    return joined.select("id", "n", F.coalesce("component", "id").alias("component"))


def near_duplicate_query(documents: DataFrame) -> DataFrame:
    rows = near_duplicates(documents.select("doc_id", "text"), size=4)
    shown = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return rows.select(
        shown("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        shown("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def keep_one(docs: DataFrame, size: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stand for their group, with their columns; repeated rows stay once."""
    found = near_duplicates(docs, size, PERCENT, text, key)
    gone = found.filter("id <> component").select("id").distinct()
    hidden = F.lit(NO_ID) + F.pmod(F.xxhash64(text_or_empty(text)), F.lit(1 << 39))
    ids = F.coalesce(F.col(key).cast("long"), hidden)
    kept = docs.withColumn("__id", ids).join(gone.withColumnRenamed("id", "__id").hint("merge"), "__id", "left_anti")
    # of different rows with one id the one with the smallest hash stays
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.groupBy("__id").agg(F.min_by(whole, F.xxhash64(*hashed)).alias("__row"))
    return one.select("__row.*")
