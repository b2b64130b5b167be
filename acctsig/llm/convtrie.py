"""Prefix trie of conversations by fixed-length block hashing.

Turns are known by a 128-bit digest of role and text, so texts are read once
and never shuffled. A conversation is cut into blocks of ``BLOCK`` turns (the
last may be shorter), and a block is known by the chained digest of all turns
up to its end. Conversations are first grouped by those block digests. Where a
block has one successor only, its inner turns have the successor's members and
need no grouping; turn boundaries are worked out, by grouping the distinct
successors' chained turn digests, only where siblings diverge.

Sums over subtrees come by doubling: after round k a node holds the sum over
its descendants less than 2^k below it, and adds those of the descendants
exactly 2^k below. The rounds are logarithmic in the depth; each is written to
the checkpoint folder.

Hot groups. Groups of equal conversations or a first turn that a third of the
rows share are partial aggregates before any shuffle. Joins that look a parent
or ancestor up split off the keys that hold more than one row in ``HOT`` (so
fewer than ``HOT`` keys) and broadcast those. The ids that end at one node are
packed into strings within a range partitioning, and only the strings meet in the
task that hashes them in order. The turns of one conversation are streamed
through one task, as the chain is sequential, with no more than a block held.

Defined results. A null role or text is the empty text; null turns come first;
equal turn numbers follow each other by digest, repeated rows each count as a
turn. Rows with a null conversation id belong to no conversation. Without
conversations there are no nodes, not even the root. Depth 0 is the root; its
text is empty. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctsig.llm.common import prepare, saved, scratch

BLOCK = 4
HOT = 200
DIGITS = 32  # hexadecimal, of a digest
ROOT = "0" * DIGITS
NO_ENDS = hashlib.sha256(b"").hexdigest()

_TAKEN = "array<struct<digest:string,chars:bigint>>"
_BLOCKS = "before string, after string, turns string, chars array<bigint>, depth bigint, conv bigint, last boolean"


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, DIGITS)


def digested(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``(conv, turn, digest, chars)`` of every turn, written to the shared folder."""
    prepare(df)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    # The length of the role makes the joined text stand for one pair only.
    t = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("chars"))
    path = scratch(df.sparkSession, "turns")
    t.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def own_beginnings(turns: DataFrame) -> DataFrame:
    """``(conv, skip, taken)`` under which every conversation is as it is."""
    return turns.select("conv").distinct().select("conv", F.lit(0).alias("skip"), F.array().cast(_TAKEN).alias("taken"))


def shared_beginnings(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """``(conv, skip, taken)``: the first h turns are those of conversation c - c % ``every``.

    h is crc32 of the decimal id, modulo ``most``; conversations whose own
    first h turns are skipped take as many of the other's as there are, none
    if it is absent.
    """
    by = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    first = (turns.filter(F.col("conv") % every == 0).withColumn("nth", F.row_number().over(by)).filter(F.col("nth") < most)
             .groupBy(F.col("conv").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("nth", "digest", "chars"))).alias("first")))
    c = turns.select("conv").distinct().select(
        "conv", (F.col("conv") - F.col("conv") % every).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int").alias("skip"))
    taken = F.transform(F.slice("first", F.lit(1), F.col("skip")), lambda x: F.struct(x["digest"], x["chars"]))
    return (c.join(first, "base", "left")
            .select("conv", "skip", F.coalesce(taken, F.array()).cast(_TAKEN).alias("taken")))


def _chained(batches, size: int = BLOCK):
    """Blocks of conversations that arrive row by row, each after a row with its beginning."""
    out, conv, skip, before, depth, block = [], None, 0, ROOT, 0, []

    def end(last: bool):
        nonlocal before, depth, block
        joined = "".join(d for d, _ in block)
        after = hashlib.sha256((before + joined).encode()).hexdigest()[:DIGITS] if block else before
        out.append((before, after, joined, [n for _, n in block], depth, conv, last))
        before, depth, block = after, depth + len(block), []

    def flushed():
        cols = list(zip(*out))
        types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          names=["before", "after", "turns", "chars", "depth", "conv", "last"])

    for b in batches:
        for c, kind, digest, chars, n, taken in zip(*(b.column(x).to_pylist() for x in
                                                      ("conv", "kind", "digest", "chars", "skip", "taken"))):
            if kind == 0:
                if conv is not None:
                    end(True)
                conv, skip, before, depth, block = c, n, ROOT, 0, []
                new = [(x["digest"], x["chars"]) for x in taken]
            elif skip:
                skip -= 1
                continue
            else:
                new = [(digest, chars)]
            for t in new:
                if len(block) == size:  # there is more, so it is not the last
                    end(False)
                block.append(t)
        if out:
            yield flushed()
    if conv is not None:
        end(True)
        yield flushed()


def blocks(turns: DataFrame, beginnings: DataFrame, size: int = BLOCK) -> DataFrame:
    """The blocks of every conversation, chained; one without turns ends in a block without turns."""
    heads = beginnings.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("digest"),
                              F.lit(None).cast("long").alias("chars"), "skip", "taken")
    own = turns.select("conv", F.lit(1).alias("kind"), F.col("turn").cast("long"), "digest", "chars",
                       F.lit(None).cast("int").alias("skip"), F.lit(None).cast(_TAKEN).alias("taken"))
    return (heads.unionByName(own).repartition("conv")
            .sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "digest")
            .mapInArrow(lambda batches: _chained(batches, size), _BLOCKS))


def looked_up(rows: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """``rows`` with the other columns of ``facts(key, ..)``, which has a row per key, where there are any.

    Fewer than ``HOT`` keys hold more than one row in ``HOT``; their facts are
    broadcast, so such a key's rows stay where they are.
    """
    total = rows.count()
    hot = [r[0] for r in rows.groupBy(key).count().filter(F.col("count") * HOT > total).select(key).collect()]
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    cold = rows.filter(~is_hot).join(facts, key, "left")
    return cold.unionByName(rows.filter(is_hot).join(F.broadcast(facts.filter(F.col(key).isin(hot))), key, "left")) if hot else cold


def nodes(found: DataFrame) -> DataFrame:
    """``(key, parent, depth, conv_id, n_convs, chars)`` of every node, from all conversations' blocks."""
    distinct = saved(found.filter(F.size("chars") > 0).groupBy("before", "after").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("turns").alias("turns"),
        F.first("chars").alias("chars"), F.first("depth").alias("depth")))
    successors = distinct.groupBy("before").agg(F.count("*").alias("n_next"))
    spread = looked_up(distinct, "before", successors)
    upto = lambda i: F.when(i == 0, F.col("before")).when(i == F.size("chars"), F.col("after")).otherwise(
        _digest(F.concat("before", F.substring(F.col("turns"), F.lit(1), i * DIGITS))))
    turn = F.explode(F.transform(F.sequence(F.lit(1), F.size("chars")), lambda i: F.struct(
        upto(i).alias("key"), upto(i - 1).alias("parent"), (F.col("depth") + i).alias("depth"),
        F.element_at("chars", i).alias("chars"))))
    inner = spread.select("n_next", "conv_id", "n_convs", turn.alias("t")).select("n_next", "conv_id", "n_convs", "t.*")
    columns = ["key", "parent", "depth", "conv_id", "n_convs", "chars"]
    alone = inner.filter("n_next = 1").select(columns)
    refined = inner.filter("n_next > 1").groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.first("chars").alias("chars")).select(columns)
    root = (found.filter("last").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
            .select(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
                    "conv_id", "n_convs", F.lit(0).cast("long").alias("chars")))
    return alone.unionByName(refined).unionByName(root)


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """``(key, ..values)`` summed over each node's subtree, from ``tree(key, parent, depth, ..values)``."""
    state = tree.select("key", F.col("parent").alias("up"), "depth", *values)
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step <= deepest:
        below = state.filter("up is not null").groupBy(F.col("up").alias("key")).agg(*(F.sum(v).alias(f"{v}_below") for v in values))
        added = state.join(below, "key", "left").select(
            "key", "up", "depth", *((F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values))
        # Nodes at depth 2 * step are that far from the root; those above have no ancestor there.
        far = added.filter(F.col("depth") > 2 * step)
        near = added.filter(F.col("depth") <= 2 * step).withColumn("up", F.when(F.col("depth") == 2 * step, F.lit(ROOT)))
        if step * 2 < deepest:
            ups = state.select(F.col("key").alias("up"), F.col("up").alias("next"))
            keys = looked_up(state.filter(F.col("depth") > 2 * step).select("key", "up"), "up", ups).select("key", F.col("next").alias("up"))
            near = near.unionByName(far.drop("up").join(keys, "key").select(near.columns))
        state = saved(near)
        step *= 2
    return state.select("key", *values)


def _packed(batches):
    """Runs of equal keys as one string of their ids."""
    for b in batches:
        keys, ids = b.column("key").to_pylist(), b.column("conv").to_pylist()
        out, i = [], 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            out.append((keys[i], ids[i], ",".join(map(str, ids[i:j]))))
            i = j
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["key", "least", "ids"])


def _hashed(batches):
    """SHA-256 of each key's strings, joined by commas."""
    key, h = None, None
    for b in batches:
        out = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` from ``(key, conv)``."""
    packed = (ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
              .mapInArrow(_packed, "key string, least bigint, ids string"))
    return packed.repartition("key").sortWithinPartitions("key", "least").mapInArrow(_hashed, "key string, ends_sha256 string")


def trie(turns: DataFrame, beginnings: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """A row per node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (code points stored once instead of for each member), ends_sha256.

    ``turns`` come from ``digested``; ``beginnings(conv, skip, taken)`` may
    replace the first turns of conversations.
    """
    found = saved(blocks(turns, own_beginnings(turns) if beginnings is None else beginnings, size))
    tree = saved(nodes(found))
    children = tree.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    tree = saved(tree.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    sums = subtree_sums(tree.select("key", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                                    ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = end_digests(found.filter("last").select(F.col("after").alias("key"), "conv"))
    parents = tree.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (looked_up(tree, "parent", parents).join(sums, "key").join(ends, "key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))
