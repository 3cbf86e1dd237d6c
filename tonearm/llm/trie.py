"""Prefix trie of conversations, packed as double arrays shard by shard.

1. Turns get their place in their conversation, conversations are rebuilt, and
   every prefix gets a name: its depth and running sums of its turns' hashes.
   Both are running sums over ranges of rows, so a conversation may be of any
   length.
2. Below a prefix stand as many rows as its members have turns from there on.
   A prefix with more than a task's share is an *upper* node.  What hangs below
   the upper nodes is dealt to shards, whole prefixes at a time.
3. A shard packs its prefixes into one double array over the shard's own dense
   turn ids: the child of slot s by turn t is slot BASE[s] + t, if CHECK there
   is s.  All conversations walk the array together, one turn a step, and
   their counts add up in the slots.
4. Upper nodes are merged globally.  Every node belongs to its smallest member;
   a conversation's own values run as a sum from its last turn up, and the sum
   over a node's members is the sum over its subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .segments import running
from .text import count_words

SPACE = r"[\x20\x09-\x0D]"
#: Prefixes that are rebuilt from another conversation: those of a block of ``BLOCK`` ids, up to ``SHARED`` - 1 turns.
BLOCK, SHARED = 20, 4
#: Rows that a shard should hold at most, when there are more than enough tasks.
SHARD_ROWS = 500_000

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
EMPTY = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """BASE and CHECK over dense labels, built level by level.

    A base may be negative, so that any free slot can take an only child.
    Slot 0 is the root; a free slot's CHECK is -1.
    """

    def __init__(self, expected: int):
        self.base = np.zeros(expected + 16, np.int64)
        self.check = np.full(expected + 16, -1, np.int64)
        self.check[0] = 0
        self.low = 1  # no free slot below

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1, np.int64)))

    def _free(self, count: int, start: int) -> np.ndarray:
        """At least ``count`` free slots from ``start`` on, ascending."""
        span = max(64, 2 * count)
        while True:
            self._grow(start + span)
            free = np.flatnonzero(self.check[start : start + span] < 0)
            if len(free) >= count:
                return free + start
            span *= 2

    def add_level(self, parents: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Slots of the children (parents[i], labels[i]); pairs are distinct and sorted."""
        slots = np.empty(len(parents), np.int64)
        heads = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
        sizes = np.diff(np.append(heads, len(parents)))
        for lo, n in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            own, start = labels[lo : lo + n], self.low
            while True:
                tries = self._free(1, start)
                if start == self.low:
                    self.low = int(tries[0])
                bases = tries - own[0]
                self._grow(int(tries[-1] + own[-1] - own[0]) + 1)
                fits = np.ones(len(bases), bool)
                for label in own.tolist()[1:]:
                    fits &= self.check[bases + label] < 0
                    if not fits.any():
                        break
                if fits.any():
                    break
                start = int(tries[-1]) + 1
            self.base[parents[lo]] = base = bases[np.argmax(fits)]
            slots[lo : lo + n] = base + own
            self.check[base + own] = parents[lo]
        alone = heads[sizes == 1]
        if len(alone):
            free = self._free(len(alone), self.low)[: len(alone)]
            slots[alone] = free
            self.base[parents[alone]] = free - labels[alone]
            self.check[free] = parents[alone]
            self.low = int(free[-1]) + 1
        return slots


def _nodes(roots: np.ndarray, convs: np.ndarray, lengths: np.ndarray, turns: np.ndarray, words: np.ndarray, starts: np.ndarray):
    """Nodes of a shard: arrays per node, and the parent's node number (-1: an upper node).

    Conversation i has the shard's prefix ``roots[i]``, whose last turn is its
    first row, at depth ``starts[i]``, and ``lengths[i]`` rows in ``turns`` and
    ``words``.  ``turns`` are dense ids.
    """
    offsets = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    trie = DoubleArray(int(lengths.sum()) + int(roots.max(initial=0)) + 1)
    cap = len(trie.check)
    count, depth, told = np.zeros(cap, np.int64), np.zeros(cap, np.int64), np.zeros(cap, np.int64)
    owner, ends = np.full(cap, np.iinfo(np.int64).max), np.zeros(len(convs), np.int64)
    where, alive = np.zeros(len(convs), np.int64), np.arange(len(convs))
    levels, step = [], 0
    while len(alive):
        # The first step leads from the array's root to the shard's prefixes, the next ones follow the turns.
        label = roots[alive] if step == 0 else turns[offsets[alive] + step]
        pair, inverse = np.unique(np.stack((where[alive], label)), axis=1, return_inverse=True)
        made = trie.add_level(pair[0], pair[1])
        if len(trie.check) > cap:
            more = len(trie.check) - cap
            count, depth, told = (np.concatenate((x, np.zeros(more, np.int64))) for x in (count, depth, told))
            owner, cap = np.concatenate((owner, np.full(more, np.iinfo(np.int64).max))), cap + more
        walked = trie.base[where[alive]] + label
        if not (trie.check[walked] == where[alive]).all() or not (walked == made[inverse.ravel()]).all():
            raise ValueError("a conversation left the array")
        np.add.at(count, walked, 1)
        np.minimum.at(owner, walked, convs[alive])
        depth[walked] = starts[alive] + step
        told[walked] = words[offsets[alive] + step]
        where[alive] = ends[alive] = walked
        levels.append(made)
        step += 1
        alive = alive[lengths[alive] > step]
    children = np.bincount(trie.check[trie.check >= 0], minlength=cap)
    leaves, saved = (children == 0).astype(np.int64), (count - 1) * told
    for made in reversed(levels[1:]):
        np.add.at(leaves, trie.check[made], leaves[made])
        np.add.at(saved, trie.check[made], saved[made])
    slots = np.concatenate(levels) if levels else np.zeros(0, np.int64)
    number = np.full(cap, -1, np.int64)
    number[slots] = np.arange(len(slots))
    number[0] = -1
    columns = [x[slots] for x in (owner, depth, count, children, leaves, saved)]
    return columns, number[trie.check[slots]], number[ends]


def _ends(node_of: np.ndarray, convs: np.ndarray, n: int) -> list[str]:
    """Per node the hash of the ids of the conversations that end there."""
    out = [EMPTY] * n
    order = np.lexsort((convs, node_of))
    node_of, convs = node_of[order], convs[order]
    heads = np.flatnonzero(np.concatenate(([True], node_of[1:] != node_of[:-1]))) if len(convs) else []
    for lo, hi in zip(heads, [*heads[1:], len(convs)]):
        out[node_of[lo]] = hashlib.sha256(",".join(map(str, convs[lo:hi].tolist())).encode()).hexdigest()
    return out


_SHARD = NODE + ", above binary"


def _shard(table: pa.Table) -> pa.Table:
    """All nodes of a shard; ``above`` names the upper node that a shard's prefix hangs from."""
    n = table.num_rows
    lists = table.column("turns").combine_chunks()
    rows = lists.flatten()
    lengths = np.diff(lists.offsets.to_numpy())
    dense = rows.field("turn").dictionary_encode()
    turns = dense.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    roots = table.column("prefix").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    convs = table.column("conv_id").to_numpy()
    words, starts = rows.field("words").to_numpy(zero_copy_only=False), table.column("first").to_numpy()
    (owner, depth, count, children, leaves, saved), parent, ends = _nodes(roots, convs, lengths, turns, words, starts)
    hung = np.append(owner, 0)[parent]
    above = dict(zip(convs.tolist(), table.column("above").to_pylist())) if n else {}
    return pa.table(
        [
            pa.array(owner), pa.array(depth), pa.array(hung, mask=parent < 0), pa.array(count), pa.array(children), pa.array(leaves), pa.array(saved),
            pa.array(_ends(ends, convs, len(owner)), pa.string()),
            pa.array([above[c] if p < 0 else None for c, p in zip(owner.tolist(), parent.tolist())], pa.binary()),
        ],
        names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "above"],
    )


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its block's first one."""
    return (F.crc32(F.encode(conv_id.cast("string"), "UTF-8")) % SHARED).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, at, turn, words) with ``at`` from 1, and (conv_id, length) of every conversation.

    The first h turns of conversation c - c % 20 come first (all if it has
    fewer, none if it is absent), then c's own turns after its first h;
    h = crc32(c) % 4.  ``turn`` is a 128-bit hash of role and text.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turns = conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("_turn"), digest.alias("turn"), count_words(text, SPACE).alias("words")
    )
    placed = running(turns, ["conv_id"], [F.col("_turn"), F.col("turn")], {"k": F.lit(1).cast("bigint")})
    placed = materialize(placed.select("conv_id", "k", "turn", "words"), "trie-turns")
    convs = placed.groupBy("conv_id").agg(F.max("k").alias("own")).select(
        "*", shared_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("first")
    )
    convs = materialize(convs, "trie-convs")
    bases = convs.select(F.col("conv_id").alias("first"), F.col("own").alias("there"))
    convs = convs.join(bases, "first", "left").select(
        "conv_id", "first", "h", F.least(F.col("h"), F.coalesce("there", F.lit(0))).cast("bigint").alias("taken"), "own"
    )
    length = F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))
    convs = materialize(convs.select("conv_id", "first", "h", "taken", length.alias("length")), "trie-convs")
    kept = placed.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").filter("k > h")
    kept = kept.select("conv_id", (F.col("taken") + F.col("k") - F.col("h")).alias("at"), "turn", "words", "length")
    heads = placed.filter(F.col("k") < SHARED).select(F.col("conv_id").alias("first"), F.col("k").alias("at"), "turn", "words")
    given = convs.filter("taken > 0").join(heads, "first").filter("at <= taken").select("conv_id", "at", "turn", "words", "length")
    return kept.unionByName(given), convs.select("conv_id", "length")


def _name(depth: Column, *sums: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums]), "UTF-8")))


def _long_ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id) for nodes of any size.

    Ids are sorted and joined range by range; only the joined pieces, in order
    and one at a time, pass through the one task that a hash over all needs.
    """
    ranged = ends.repartitionByRange("node", "conv_id").withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "trie-ends")
    ids = F.sort_array(F.collect_list("conv_id"))
    pieces = ranged.groupBy("node", "_part").agg(F.array_join(F.transform(ids, lambda c: c.cast("string")), ",").alias("ids"))
    sorted_ = pieces.repartition("node").sortWithinPartitions("node", "_part").select("node", "ids")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        out = lambda: pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": [state.hexdigest()]})
        for batch in batches:
            for i in range(batch.num_rows):
                one, ids = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode()
                if one == node:
                    state.update(b"," + ids)
                else:
                    if state:
                        yield out()
                    node, state = one, hashlib.sha256(ids)
        if state:
            yield out()

    return sorted_.mapInArrow(hashed, "node binary, ends_sha256 string")


def build(turns: DataFrame, convs: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """All nodes of the trie over rebuilt ``turns`` (conv_id, at, turn, words, length) and ``convs`` (conv_id, length).

    ``shard_rows`` is the number of rows below a prefix from which on it is an
    upper node; by default a task's share of all rows, at most ``SHARD_ROWS``.
    It changes how the work is dealt, not the result.
    """
    spark = turns.sparkSession
    named = running(
        turns, ["conv_id"], [F.col("at")],
        {f"s{i}": F.xxhash64(F.lit(i), "at", "turn").cast("decimal(38,0)") for i in (1, 2)},
    )
    before = [F.col(f"s{i}") - F.xxhash64(F.lit(i), "at", "turn").cast("decimal(38,0)") for i in (1, 2)]
    named = materialize(
        named.select(
            "conv_id", "at", "turn", "words", "length", _name(F.col("at"), F.col("s1"), F.col("s2")).alias("node"), _name(F.col("at") - 1, *before).alias("above")
        ),
        "trie-prefixes",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = named.count()
    share = shard_rows or max(1, min(SHARD_ROWS, total // parts))
    below = named.groupBy("node").agg(F.sum(F.col("length") - F.col("at") + 1).alias("below"))
    marked = named.join(below.filter(F.col("below") > share).select("node", F.lit(True).alias("upper")), "node", "left")
    marked = materialize(marked.select(*named.columns, F.coalesce("upper", F.lit(False)).alias("upper")), "trie-marked")

    lists = marked.filter("not upper").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "words", "node", "above"))).alias("turns"))
    head = F.get("turns", F.lit(0))
    shards = max(parts, -(-total // SHARD_ROWS))
    lists = lists.select(
        "conv_id", head["at"].alias("first"), head["node"].alias("prefix"), head["above"].alias("above"), F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["words"].alias("words"))).alias("turns"),
    )
    dealt = lists.withColumn("shard", F.pmod(F.xxhash64("prefix"), F.lit(shards)))
    lower = materialize(dealt.groupBy("shard").applyInArrow(_shard, _SHARD), "trie-shards")

    # The textless root is an upper node that all conversations pass.
    zero = F.lit(0).cast("decimal(38,0)")
    root = _name(F.lit(0).cast("bigint"), zero, zero)
    rows = marked.filter("upper").select("conv_id", "at", "words", "length", "node", "above")
    rows = rows.unionByName(convs.select("conv_id", F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("words"), "length", root.alias("node"), F.lit(None).cast("binary").alias("above")))
    upper = rows.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("at").alias("depth"), F.first("above").alias("above"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"),
    )
    children = lower.filter("above is not null").select("above").unionByName(upper.filter("above is not null").select("above"))
    children = children.groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    upper = upper.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    upper = materialize(upper, "trie-upper")
    own = upper.select(
        "conv_id", F.col("depth").alias("at"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    ).unionByName(lower.filter("above is not null").select("conv_id", F.col("depth").alias("at"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    # From the last turn up, what a conversation owns at a depth stands in front of its own row there.
    events = own.withColumn("node", F.lit(None).cast("binary")).unionByName(
        rows.select("conv_id", "at", F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved"), "node")
    )
    summed = running(events, ["conv_id"], [F.col("at").desc(), F.col("node").isNotNull()], {"n_leaves": "leaves", "saved_tokens": "saved"})
    sums = summed.filter("node is not null").groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = _long_ends(rows.filter("at = length").select("node", "conv_id"))
    top = upper.join(sums, "node").join(ends, "node", "left").select(
        "conv_id", "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "above",
    )
    # Parents of what hangs below an upper node; the root's member is one number, so that its many children meet no key.
    hung = top.unionByName(lower.filter("above is not null"))
    least = convs.agg(F.min("conv_id")).first()[0]
    parents = upper.filter("depth > 0").select(F.col("node").alias("above"), F.col("conv_id").alias("_parent"))
    first = hung.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least).cast("bigint")))
    deep = hung.filter("depth > 1").join(parents, "above").withColumn("parent_conv_id", F.col("_parent")).drop("_parent")
    columns = [c.split()[0] for c in NODE.split(", ")]
    return lower.filter("above is null").select(columns).unionByName(first.select(columns)).unionByName(deep.select(columns))


def prefix_trie(conversations: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations, see ``rebuilt`` and ``build``.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256, the hash of the ids
    that end at the node.  Turns stand in the order of turn (null first),
    equal turns in the order of a hash of role and text; repeated rows are
    turns of their own.  Null role and text are empty.  Rows without a conv_id
    are of no conversation.  Further columns are ignored; an empty table gives
    an empty result.
    """
    turns, convs = rebuilt(conversations)
    return build(turns, convs, shard_rows)
