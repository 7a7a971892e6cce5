"""The trie of conversations by their turns, built from its deepest level upwards by stripping last turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmill.llm.common import WHITE_SPACE, saved, work_folder

#: First depth at which long conversations are asked whether they still share their turns with another one.
FIRST_RUNG = 8
#: Conversation ids that are joined to one text before they are hashed.
IDS_PER_CHUNK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = b""


def ordered_turns(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv, turns array<struct<digest binary, words long>>``: a conversation's turns in order.

    A turn's digest tells its role and text; texts go no further. Turns without a number come first; equal numbers
    are ordered by role, then by the digest of the text. Null roles and texts are empty. Rows without a key belong to
    no conversation and are left out. A row of the result holds 40 bytes per turn of its conversation.
    """
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    speaker = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    named = F.md5(F.concat_ws(":", F.md5(speaker.cast("binary")), F.md5(value.cast("binary"))).cast("binary"))
    trimmed = F.regexp_replace(F.regexp_replace(value, f"^{WHITE_SPACE}", ""), f"{WHITE_SPACE}$", "")
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, WHITE_SPACE)))
    number = F.col(f"`{turn}`").cast("long")
    rows = conversations.filter(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("conv"),
        F.struct(
            number.isNotNull().alias("numbered"),
            number.alias("turn"),
            speaker.alias("role"),
            F.md5(value.cast("binary")).alias("text"),
            F.unhex(named).alias("digest"),
            words.cast("long").alias("words"),
        ).alias("t"),
    )
    listed = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("conv", F.transform("t", lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


def with_shared_openings(turns: DataFrame, family: int = 20, choices: int = 4) -> DataFrame:
    """Conversations rebuilt on their family's opening: ``conv, turns``.

    Conversation c takes its first h turns from conversation ``c - c % family`` (fewer if that has fewer, none if it
    is absent) and goes on with its own turns after its first h; ``h = crc32(decimal c) % choices``. As in SQL, a
    remainder has the sign of c, so the families of negative ids lie below zero. At most
    ``choices - 1`` turns of a conversation are joined to at most ``family`` others.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % choices).cast("int")
    opening = turns.select(F.col("conv").alias("base"), F.slice("turns", 1, choices - 1).alias("opening"))
    own = turns.withColumn("base", F.col("conv") - F.col("conv") % family).withColumn("h", h)
    given = F.slice(F.coalesce("opening", F.array().cast(opening.schema["opening"].dataType)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(opening, "base", "left").select("conv", F.concat(given, rest).alias("turns"))


def _chain(digests: Column) -> Column:
    """For each turn, a digest of all turns up to it."""

    def one(row: Iterable[bytes]) -> list[bytes]:
        out, last = [], ROOT
        for digest in row:
            last = hashlib.md5(last + bytes(digest)).digest()
            out.append(last)
        return out

    @F.pandas_udf("array<binary>")
    def chain(rows: pd.Series) -> pd.Series:
        return rows.map(one)

    return chain(digests)


def _hash_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined chunks of each key; rows come sorted by key and chunk, one chunk is held at a time."""
    key = state = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]}, schema)

    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        for one, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if one != key:
                if state is not None:
                    yield done()
                key, state = one, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield done()


def _end_hashes(paths: DataFrame) -> DataFrame:
    """``key, ends_sha256`` for the nodes at which conversations end.

    SHA-256 needs the ids of a node one after the other. They are sorted and joined in chunks of neighbouring ids on
    all executors; a node's chunks are then hashed as a stream, so a node with very many ids is never held.
    """
    chunk = F.floor(F.col("conv") / IDS_PER_CHUNK).cast("long")
    listed = paths.groupBy("key", chunk.alias("chunk")).agg(F.array_sort(F.collect_set("conv")).alias("ids"))
    texts = listed.select("key", "chunk", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))
    ordered = texts.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids")
    return ordered.mapInArrow(_hash_in_order, "key binary, ends_sha256 string")


def _tops(groups: DataFrame) -> DataFrame:
    """Adds ``top``: a depth below which no other group has the same turns, at most about twice the deepest shared one.

    Groups longer than ``FIRST_RUNG`` look at depths 8, 16, 32, ... only, so a group of n turns sends log n keys.
    """
    size = F.size("path")
    rungs = F.expr(
        f"filter(transform(sequence(0, 40), i -> {FIRST_RUNG} * shiftleft(1L, i)), d -> d <= size(path))"
    )
    asked = groups.filter(size >= FIRST_RUNG).select("key", "path", F.explode(rungs).alias("rung"))
    asked = asked.select("key", "rung", F.expr("path[cast(rung - 1 as int)].key").alias("at"))
    shared = asked.groupBy("at").agg(F.count("*").alias("n")).filter("n > 1").select("at")
    deepest = asked.join(shared, "at").groupBy("key").agg(F.max("rung").alias("rung"))
    limit = F.coalesce(F.col("rung") * 2, F.lit(FIRST_RUNG)) - 1
    return groups.join(deepest, "key", "left").withColumn("top", F.least(size, limit).cast("int")).drop("rung")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns(conv, turns)``, one row per distinct run of first turns, the root included.

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the node above (null at the root), ``n_convs``
    counts members, ``n_children`` the nodes one turn longer, ``n_leaves`` the childless nodes of the subtree (the
    node itself counts), ``saved_tokens`` sums ``(n_convs - 1) *`` words of the last turn over the subtree, and
    ``ends_sha256`` is the SHA-256 of the ids of conversations that end here, in order and joined by commas.

    Equal conversations first become one group. Turns that only one group has are stripped from it at once. From the
    deepest level that is left the trie is then peeled: the groups that end at a level join the nodes that survive
    from the level below, each stripped of its last turn, and one aggregation with partial sums gives the level's
    nodes with all that is known of their subtrees. A level is written before the next, so the job goes on from there
    if executors are lost. The number of levels is at most twice that of turns shared by different conversations;
    what a node carries is 24 bytes for each turn above it.

    A conversation without turns is a member of the root. Without conversations there is no node at all.
    """
    spark = turns.sparkSession
    chained = turns.select("conv", "turns", _chain(F.transform("turns", lambda t: t["digest"])).alias("keys"))
    path = F.transform("turns", lambda t, i: F.struct(F.get("keys", i).alias("key"), t["words"].alias("words")))
    last = F.coalesce(F.get("path", F.size("path") - 1)["key"], F.lit(ROOT))
    paths = saved(chained.select("conv", path.alias("path")).withColumn("key", last))
    ends = saved(_end_hashes(paths))
    groups = paths.groupBy("key").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.first("path").alias("path"))
    folder = work_folder(spark)
    _tops(saved(groups)).write.partitionBy("top").parquet(folder)
    groups = spark.read.schema(
        "key binary, conv long, n long, path array<struct<key:binary,words:long>>, top int"
    ).parquet(folder)

    # what is below the top: one node per turn, each with the one below it as only child
    size = F.size("path")
    words_from = F.expr("aggregate(slice(path, depth, size(path)), 0L, (sum, t) -> sum + t.words)")
    runs = groups.filter(size > F.col("top")).withColumn("depth", F.explode(F.sequence(F.col("top") + 1, size)))
    runs = runs.select(
        F.expr("path[depth - 1].key").alias("key"),
        F.coalesce(F.expr("get(path, depth - 2).key"), F.lit(ROOT)).alias("above"),
        F.when(F.col("depth") > F.col("top") + 1, F.col("conv")).alias("parent"),
        "conv",
        "depth",
        "n",
        (F.col("depth") < size).cast("long").alias("children"),
        F.lit(1).cast("long").alias("leaves"),
        ((F.col("n") - 1) * words_from).alias("saved"),
    )

    deepest = groups.agg(F.max("top")).first()[0]
    goes_on = (size > F.col("top")).cast("long")
    below = F.expr("aggregate(slice(path, top + 1, size(path)), 0L, (sum, t) -> sum + t.words)")
    levels, survivors = [], None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        ending = groups.filter(F.col("top") == depth).select(
            F.slice("path", 1, depth).alias("path") if depth else F.lit(None).cast(groups.schema["path"].dataType).alias("path"),
            "conv",
            "n",
            goes_on.alias("children"),
            goes_on.alias("leaves"),
            ((F.col("n") - 1) * F.when(size > F.col("top"), below).otherwise(0)).alias("saved"),
        )
        meeting = ending if survivors is None else ending.unionByName(survivors)
        here = F.get("path", F.lit(depth - 1)) if depth else F.lit(None).cast("struct<key:binary,words:long>")
        nodes = (
            meeting.withColumn("key", F.coalesce(here["key"], F.lit(ROOT)))
            .groupBy("key")
            .agg(
                F.first("path").alias("path"),
                F.min("conv").alias("conv"),
                *(F.sum(name).alias(name) for name in ("n", "children", "leaves", "saved")),
            )
        )
        own = (F.col("n") - 1) * F.coalesce(here["words"], F.lit(0))
        level = saved(
            nodes.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")))
            .withColumn("saved", F.col("saved") + own)
            .withColumn("depth", F.lit(depth))
        )
        levels.append(level)
        survivors = level.select(
            F.slice("path", 1, depth - 1).alias("path") if depth > 1 else F.lit(None).cast(level.schema["path"].dataType).alias("path"),
            "conv",
            "n",
            F.lit(1).cast("long").alias("children"),
            "leaves",
            "saved",
        )

    shape = ["key", "above", "parent", "conv", "depth", "n", "children", "leaves", "saved"]
    above = F.when(F.col("depth") > 0, F.coalesce(F.expr("get(path, depth - 2).key"), F.lit(ROOT)))
    peeled = [
        level.withColumn("above", above).withColumn("parent", F.lit(None).cast("long")).select(*shape) for level in levels
    ]
    nodes, inner = runs.select(*shape), None
    for level in peeled:
        nodes = nodes.unionByName(level)
        named = level.select(F.col("key").alias("above"), F.col("conv").alias("above_conv"))
        inner = named if inner is None else inner.unionByName(named)
    if inner is not None:
        # the runs' own turns have their parent already, so only tops of runs and peeled nodes look it up
        lookup = F.when(F.col("parent").isNull(), F.col("above"))
        nodes = nodes.withColumn("above", lookup).join(inner, "above", "left")
        nodes = nodes.withColumn("parent", F.coalesce("parent", "above_conv"))
    result = nodes.join(ends, "key", "left").select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    return result
