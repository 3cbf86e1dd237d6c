"""N-gram Jaccard join with vertical partitioning, and the classes its links form.

1. Texts with the same shingle set are one class; a class is compared once.
2. A class can link only if four fifths of its shingles occur in other classes.
   One pass over the texts deals short fingerprints of the shingles out by hash
   range and counts, per class, those that some other class has too.  What
   passes (few classes, unless the corpus is made of copies) is read again.
3. The shingles of these classes stand in one global order, rare first.  Two
   linked classes share one of the first shingles of each (the prefix).
4. The order is cut into fragments.  A pair's overlap is counted fragment by
   fragment and summed.
5. Pairs are not all formed.  In each of two turns a prefix shingle has one
   hub, and a class is paired with the hub it meets most often.  Links make
   components; then all pairs that share a prefix shingle across components
   are formed.  Every pair left out lies within one component, so no component
   changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .shingles import Hasher, digest

#: Links need SHARE_NUM * union <= SHARE_DEN * intersection, that is 80 %.
SHARE_NUM, SHARE_DEN = 80, 100
#: Bytes of a set's digest that name it while shared shingles are counted.  Two sets with one name would
#: count as one; that loses a link only if they are each other's partners, one chance in 2**64 per linked pair.
NAME = 8
MOST = 2**16 - 1
#: Fingerprints of a hash range that are unpacked and sorted at a time.
SLICE = 2_000_000
#: Shuffle partitions per hash range: what a range holds of a text should outweigh the bytes that name the text.
PARTITIONS_PER_RANGE = 3
#: Bits of the map that says which texts are read again: 8 MB at most.
MAP_BITS = 2**26
#: Fragments of the global order: classes of the frequency (powers of 4) times cuts of the hash.
FREQUENCY_CLASSES, CUTS = 4, 2

_MARKS = "part int, doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, names binary, counts binary, prints binary"
_FOUND = "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, name binary, shared bigint, counted bigint"


def _mark(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Per document one row with its set's digest; per batch and hash range one row of packed fingerprints."""
    hasher = Hasher()
    schema = pa.schema(
        [("part", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64())]
        + [(c, pa.binary()) for c in ("digest", "names", "counts", "prints")]
    )

    def packed(rows, sets):
        if sets:
            names = list(sets)
            sizes = np.array([len(sets[d]) for d in names])
            tokens = np.concatenate([sets[d] for d in names])
            owner = np.repeat(np.arange(len(names)), sizes)
            # The high half deals out, the low half is the fingerprint inside its range.
            part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, owner, prints = part[order], owner[order], tokens[order].astype(np.uint32)
            cuts = np.flatnonzero(np.diff(part)) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(part)]))):
                who, counts = np.unique(owner[lo:hi], return_counts=True)
                pieces = -(-counts // MOST)  # a count of two bytes: larger ones are cut
                who, left = np.repeat(who, pieces), np.repeat(counts, pieces)
                left = np.minimum(left - MOST * (np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)), MOST)
                rows.append((int(part[lo]), None, None, None, None, b"".join(names[i][:NAME] for i in who), left.astype(np.uint16).tobytes(), prints[lo:hi].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        rows, sets, held = [], {}, 0
        ids, hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for i, (doc_id, text_hash) in enumerate(zip(ids, hashes)):
            tokens = hasher(texts[i].as_py())
            name = digest(tokens) if len(tokens) else None
            rows.append((text_hash % parts, doc_id, text_hash, len(tokens), name, None, None, None))
            if name is not None and name not in sets:
                sets[name] = tokens
                held += len(tokens)
            if held > 2_000_000:
                yield packed(rows, sets)
                rows, sets, held = [], {}, 0
        if rows:
            yield packed(rows, sets)


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents pass; per hash range and set, how many fingerprints another set has too, and how many there are.

    Only where at least half are shared: elsewhere the half is taken for granted, see ``link``.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("name", pa.binary())]
        + [("shared", pa.int64()), ("counted", pa.int64())]
    )
    ranges: dict[int, list] = {}
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        is_doc = col["prints"].is_null()
        docs = [col[c] for c in ("doc_id", "text_hash", "n_shingles", "digest")] + [pa.nulls(batch.num_rows, t) for t in schema.types[4:]]
        docs = pa.RecordBatch.from_arrays(docs, schema=schema).filter(is_doc)
        if docs.num_rows:
            yield docs
        for i in np.flatnonzero(~np.asarray(is_doc.to_pylist(), bool)):
            ranges.setdefault(col["part"][i].as_py(), []).append(tuple(col[c][i].as_py() for c in ("names", "counts", "prints")))
    while ranges:
        _, pieces = ranges.popitem()
        distinct, number = np.unique(np.frombuffer(b"".join(p[0] for p in pieces), np.uint64), return_inverse=True)
        ends = np.cumsum([len(p[0]) // NAME for p in pieces])
        owners = [number[end - len(p[0]) // NAME : end].astype(np.uint64) for end, p in zip(ends, pieces)]
        total, all_ = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        # Equal fingerprints fall into one slice; only one slice at a time is unpacked and sorted.
        slices = 1 << (sum(len(p[2]) for p in pieces) // 4 // SLICE).bit_length()
        for slice_ in range(slices):
            keyed = []
            for who, (_, counts, prints) in zip(owners, pieces):
                prints = np.frombuffer(prints, np.uint32)
                inside = (prints & np.uint32(slices - 1)) == slice_
                owner = np.repeat(who, np.frombuffer(counts, np.uint16))[inside]
                keyed.append((prints[inside].astype(np.uint64) << np.uint64(32)) | owner)
            # One row per (fingerprint, set): copies of a set that came from several batches count once.
            keyed = np.unique(np.concatenate(keyed))
            print_, owner = keyed >> np.uint64(32), (keyed & np.uint64(0xFFFFFFFF)).astype(np.int64)
            same = print_[1:] == print_[:-1]
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
            total += np.bincount(owner[shared], minlength=len(distinct))
            all_ += np.bincount(owner, minlength=len(distinct))
        some = np.flatnonzero((total > 0) & (2 * total >= all_))
        if len(some):
            empty = [pa.nulls(len(some), t) for t in schema.types[:4]]
            names = pa.array([distinct[i].tobytes() for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([*empty, names, pa.array(total[some], pa.int64()), pa.array(all_[some], pa.int64())], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        texts = batch.column(1)
        for lo in range(0, batch.num_rows, 500):  # bounded output batches
            some = [hasher(texts[i].as_py()).view(np.int64) for i in range(lo, min(lo + 500, batch.num_rows))]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in some]))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(some)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(some)), tokens], ["digest", "tokens"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node reachable.

    Alternating large-star and small-star steps, each a few aggregates and
    joins on a node, until nothing changes; the number of steps follows the
    logarithm of the longest path.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "star")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was, state = None, mark(now)
    while state != was and state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "star")
        was, state = state, mark(now)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return materialize(roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")


def _reaches(overlap: Column, a: Column, b: Column) -> Column:
    return overlap * SHARE_DEN >= (a + b - overlap) * SHARE_NUM


def _verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs (a, b) that link: overlaps counted per fragment, then summed."""
    left = segments.select(F.col("sid").alias("a"), F.col("n").alias("na"), "fragment", F.col("tokens").alias("ta"))
    right = segments.select(F.col("sid").alias("b"), F.col("n").alias("nb"), "fragment", F.col("tokens").alias("tb"))
    part = F.size(F.array_intersect("ta", "tb")).alias("part")
    counted = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", part)
    summed = counted.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("part").alias("overlap"))
    return summed.filter(_reaches(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest) of every document and the class table, written: see ``link``."""
    spark = documents.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_PER_RANGE)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    marked = texts.mapInArrow(lambda batches: _mark(batches, parts), _MARKS)
    dealt = marked.repartitionById(parts, F.col("part"))
    return materialize(dealt.mapInArrow(_count_shared, _FOUND), "jaccard-marks")


def link(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable over links; documents
    link when their 5-word shingle sets have a Jaccard similarity of 0.8 or
    more.  Null, empty and wordless texts have no shingle, link with nothing
    and are their own component.  Repeated rows link with each other like any
    copies; a null doc_id takes part but never names a component unless all of
    it are null.  Further columns are ignored, an empty table gives an empty
    result.
    """
    docs, grouped, roots = _linked(documents)
    renamed = roots.join(grouped.select("digest", "first_id"), "digest")
    named = renamed.join(renamed.groupBy("root").agg(F.min("first_id").alias("component")), "root").select("digest", "component")
    every = grouped.select("digest", "first_id").join(named, "digest", "left")
    every = every.select(F.col("digest").alias("_digest"), F.coalesce("component", "first_id").alias("component"))
    return docs.join(every, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def _linked(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, text_hash, n_shingles, digest), their classes, and (digest, root) of the classes that link with others."""
    marks = classes(documents)
    docs = marks.filter("n_shingles is not null").select("doc_id", "text_hash", "n_shingles", "digest")
    grouped = docs.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("n_shingles").alias("n"), F.min("doc_id").alias("first_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("one"),
    )
    shared = marks.filter("shared is not null").groupBy("name").agg(F.sum("shared").alias("shared"), F.sum("counted").alias("counted"))
    # Of the ranges that sent nothing, less than half of the shingles are shared.
    most = F.col("shared") + (F.greatest(F.col("n"), F.col("counted")) - F.col("counted")) / 2
    able = grouped.withColumn("name", F.substring("digest", 1, NAME)).join(shared, "name").filter(most * SHARE_DEN >= F.col("n") * SHARE_NUM)
    able = materialize(able.select("digest", "n", "first_id", "one.doc_id", "one.text_hash"), "jaccard-able")
    return docs, grouped, _roots(documents, able)


def one_each(documents: DataFrame) -> DataFrame:
    """Of each component of near copies one row, with all its columns as they are.

    Rows are told apart by id and text, not by id alone: the row with the
    smallest id (null last), then the smallest text hash, stays; of rows equal
    in both, the one with the smallest hash of all columns.  Rows without a
    shingle link with nothing, so each of them stays.  Columns may have any
    names; an empty table stays empty.
    """
    docs, _, roots = _linked(documents)
    # Equal rows are counted first, so that a hot one is a single row from here on.
    rows = docs.groupBy("digest", "doc_id", "text_hash").agg(F.min("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash", "copies")).alias("one")
    least = rows.filter("n > 0").groupBy("digest").agg(first).join(roots, "digest", "left")
    # A root is a number of its own table; a class that links with none goes by its digest.
    ones = least.groupBy("root", F.when(F.col("root").isNull(), F.col("digest"))).agg(F.min("one").alias("one"))
    kept = ones.select("one.doc_id", "one.text_hash", (F.col("one.copies") > 1).alias("several"))
    kept = kept.unionByName(rows.filter("n = 0").select("doc_id", "text_hash", F.lit(False).alias("several")))
    kept = kept.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "several")
    # A row travels as one column, so that no name of its own meets one of this join.
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    text_hash = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    met = packed.join(kept, F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("id")) & (text_hash == F.col("hash")))
    equal = met.filter("several").groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return met.filter("not several").select("row").unionByName(equal.select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def _perhaps(rows: DataFrame, hash_: Column, wanted: DataFrame) -> DataFrame:
    """The rows whose hash may be among the ``wanted`` ones; keeps the other texts out of the shuffle that follows.

    A map of ``MAP_BITS`` bits, broadcast; where more hashes are wanted than it
    tells apart it lets more rows pass, never fewer.
    """
    bit = lambda h: F.pmod(h, F.lit(MAP_BITS)) + 1
    maps = wanted.select(bit(F.col("text_hash")).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_map"))
    place = F.bitmap_bit_position(bit(hash_))
    byte = F.conv(F.hex(F.substring("_map", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(bit(hash_)) == F.col("_bucket"))
    return met.filter(F.getbit(byte, (place % 8).cast("int")) == 1).drop("_bucket", "_map")


def _roots(documents: DataFrame, able: DataFrame) -> DataFrame:
    """(digest, root) of the classes that link with others."""
    ids = able.select("digest", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    found = _perhaps(documents.select("doc_id", "text"), text_hash, able.select("text_hash"))
    found = found.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_hash == F.col("_hash")))
    read = found.select("digest", "text").dropDuplicates(["digest"]).mapInArrow(_sets, "digest binary, tokens array<bigint>")
    sets = materialize(read.withColumn("sid", F.monotonically_increasing_id()), "jaccard-sets")
    sets = sets.select("digest", "sid", F.size("tokens").alias("n"), "tokens")
    # The global order: by power of two of the frequency, then by hash.  Shingles of one class stand first and link nothing.
    tokens = sets.select("sid", "n", F.explode("tokens").alias("token"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = tokens.join(df.select("token", F.floor(F.log2("df")).cast("int").alias("rank")), "token")
    ranked = materialize(ranked, "jaccard-tokens")
    own = Window.partitionBy("sid")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("rank", "token"))
    needed = F.ceil(F.col("n") * SHARE_NUM / SHARE_DEN)
    prefix = materialize(
        ranked.withColumn("place", place.cast("int")).withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own))
        .filter(F.col("place") <= F.col("n") - needed + 1).select("token", "sid", "n", "place", "alone"),
        "jaccard-prefix",
    )
    fragment = F.least(F.floor(F.col("rank") / 2), F.lit(FREQUENCY_CLASSES - 1)) * CUTS + F.pmod(F.shiftrightunsigned("token", 40), F.lit(CUTS))
    segments = materialize(
        ranked.groupBy("sid", "n", fragment.cast("int").alias("fragment")).agg(F.collect_list("token").alias("tokens")), "jaccard-segments"
    )

    def able_pair(na, nb, pa_, pb):
        """Sizes that can reach the threshold, and enough shingles behind the shared one if it is the first that they share."""
        reach = F.least(na - pa_, nb - pb) + 1
        return (F.least(na, nb) * SHARE_DEN >= F.greatest(na, nb) * SHARE_NUM) & _reaches(reach, na, nb)

    def star(placed: DataFrame, turn: int) -> DataFrame:
        """Every class with the one hub that it shares most prefix shingles with.

        A hub is of the main component of a shingle and has the fewest shingles
        of its own there: of near copies, the text they were made from.
        """
        hub = F.min(F.struct("alone", F.xxhash64(F.lit(turn), "sid").alias("h"), "sid", "n"))
        hubs = placed.filter("root = main").groupBy("token").agg(hub.alias("hub")).select("token", F.col("hub.sid").alias("b"), F.col("hub.n").alias("nb"))
        alike = F.least("n", "nb") * SHARE_DEN >= F.greatest("n", "nb") * SHARE_NUM
        met = placed.join(hubs, "token").filter((F.col("sid") != F.col("b")) & alike & ((F.col("root") != F.col("main")) | F.lit(turn == 0)))
        votes = met.groupBy("sid", "b").agg(F.count(F.lit(1)).alias("k")).groupBy("sid").agg(F.max(F.struct("k", "b")).alias("best"))
        return votes.select(F.least("sid", "best.b").alias("a"), F.greatest("sid", "best.b").alias("b")).distinct()

    def placed_by(roots: DataFrame) -> DataFrame:
        """Prefix shingles that more than one component has, with the largest of them."""
        rows = prefix.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        sizes = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
        main = sizes.groupBy("token").agg(F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
        return materialize(rows.join(main.select("token", F.col("top.root").alias("main")), "token"), "jaccard-open")

    own_root = F.col("sid").alias("root"), F.col("sid").alias("main")
    tried = materialize(star(prefix.select("*", *own_root), 0), "jaccard-star")
    roots = components(_verified(tried, segments))
    open_ = placed_by(roots)
    second = materialize(star(open_, 1).join(tried, ["a", "b"], "left_anti"), "jaccard-star")
    tried = tried.unionByName(second)
    roots = _merged(roots, _verified(second, segments))
    open_ = placed_by(roots)
    outer = open_.filter("root <> main").select("token", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("root").alias("ra"))
    other = open_.select("token", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("root").alias("rb"), "main")
    once = (F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))
    rest = outer.join(other, "token").filter(
        (F.col("ra") != F.col("rb")) & once & able_pair(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"))
    )
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    roots = _merged(roots, _verified(materialize(rest, "jaccard-rest"), segments))
    return sets.select("sid", "digest").join(roots.withColumnRenamed("node", "sid"), "sid").select("digest", "root")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b) are added to the components so far."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    edges = materialize(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct(), "jaccard-edges")
    last = components(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = roots.unionByName(nodes.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    return materialize(every.join(last, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "components")
