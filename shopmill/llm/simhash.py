"""Near-duplicate texts by SimHash fingerprints, found through a grid over segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmill.llm.common import key_type, saved, whole_text
from shopmill.llm.components import components

#: Bits of a segment; its bit count is one coordinate of the embedding. 64 / 2 = 32 coordinates of 0, 1 or 2.
SEGMENT_BITS = 2
SEGMENTS = 64 // SEGMENT_BITS
#: Fingerprints of one cell that a task compares with each other at once; larger cells are cut into blocks.
BLOCK = 2048
#: Bytes of a text that are split into words at once.
CHUNK = 1 << 20


def _chunks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded list at a time."""
    rest = b""
    for start in range(0, len(data), CHUNK):
        piece = rest + data[start : start + CHUNK]
        words = piece.split()
        rest = b""
        if words and start + CHUNK < len(data) and not piece[-1:].isspace():
            rest = words.pop()
        yield words
    if rest:
        yield [rest]


def fingerprint(text: str, size: int = 4) -> int:
    """SimHash over shingles of ``size`` words, as an unsigned 64-bit number; 0 for a text without words.

    A text of fewer words has one shingle, all of them. Repeated shingles count each time. A bit is set where it is
    set in more than half of the XXH64 hashes (seed 42). Only ASCII letters are lower-cased.
    """
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in _chunks(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        if len(words) >= size:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts, ends = (ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
            digest = xxhash.xxh64_intdigest
            hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))
            for at in range(0, len(hashes), 1 << 15):
                block = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(starts)
        tail = words[len(words) - size + 1 :] if len(words) >= size else words
    if not total and tail:
        value = xxhash.xxh64_intdigest(b" ".join(tail), 42)
        return value
    bits = 2 * ones > total
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, size: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, bits``: the fingerprint of each row's whole text as a signed 64-bit number."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            values = [fingerprint(value.as_py(), size) for value in batch.column(1)]
            signed = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], ["key", "bits"])

    schema = T.StructType([T.StructField("key", key_type(docs, key)), T.StructField("bits", T.LongType())])
    narrow = docs.select(F.col(f"`{key}`").alias("key"), whole_text(text).alias("text"))
    return narrow.mapInArrow(batches, schema).withColumnRenamed("key", key)


def cells(bits: Column, blocks: int, distance: int) -> Column:
    """The grid cells of a fingerprint, as an array of numbers.

    The embedding's coordinates are the bit counts of the segments. Their Manhattan distance never exceeds the number
    of differing bits. Its coordinates are cut into ``blocks`` blocks; a Manhattan distance of at most ``distance``
    spreads over at most that many blocks, so two such points agree in at least ``blocks - distance`` whole blocks.
    A cell is one choice of that many blocks with the counts in them: points in range share at least one cell.
    """
    cuts = [SEGMENTS * i // blocks for i in range(blocks + 1)]
    codes = []
    for first, last in zip(cuts, cuts[1:]):
        code = F.lit(0).cast("long")
        for segment in range(first, last):
            part = F.shiftrightunsigned(bits, segment * SEGMENT_BITS).bitwiseAND((1 << SEGMENT_BITS) - 1)
            code = code * (SEGMENT_BITS + 1) + F.bit_count(part)
        codes.append(code)
    width = (SEGMENT_BITS + 1) ** max(b - a for a, b in zip(cuts, cuts[1:]))
    numbers = []
    for number, chosen in enumerate(combinations(codes, blocks - distance)):
        value = F.lit(number).cast("long")
        for code in chosen:
            value = value * width + code
        numbers.append(value)
    return F.array(*numbers)


def _links_in_groups(distance: int):
    """Links inside groups of consecutive rows with one (cell, i, j), as a forest that keeps who is connected."""

    def compare(bits: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ends``: for each row, the end of its group. Rows are compared with the next, the one after it, and so on."""
        counts = np.zeros((len(bits), SEGMENTS), np.int8)
        for segment in range(SEGMENTS):
            part = (bits >> np.uint64(segment * SEGMENT_BITS)) & np.uint64((1 << SEGMENT_BITS) - 1)
            counts[:, segment] = np.bitwise_count(part)
        label, rows, found = np.arange(len(bits)), np.arange(len(bits)), []
        step = 1
        rows = rows[rows + step < ends]
        while len(rows):
            others = rows + step
            open_ = label[rows] != label[others]  # already connected rows need no further link
            a, b = rows[open_], others[open_]
            near = np.abs(counts[a] - counts[b]).sum(axis=1) <= distance  # a lower bound of the bit distance
            a, b = a[near], b[near]
            exact = np.bitwise_count(bits[a] ^ bits[b]) <= distance
            a, b = a[exact], b[exact]
            if len(a):
                found.append((a, b))
                low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
                np.minimum.at(label, high, low)
                while True:
                    flat = label[label]
                    if (flat == label).all():
                        break
                    label = flat
            step += 1
            rows = rows[rows + step < ends[rows]]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = (np.concatenate(x) for x in zip(*found))
        return bits[a].view(np.int64), bits[b].view(np.int64)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None

        def done(table: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((table[1:, :3] != table[:-1, :3]).any(axis=1)) + 1
            bounds = np.concatenate([[0], new, [len(table)]])
            a, b = compare(table[:, 3].copy().view(np.uint64), np.repeat(bounds[1:], np.diff(bounds)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in stream:
            if not batch.num_rows:
                continue
            table = np.stack([column.to_numpy() for column in batch.columns], axis=1)
            table = table if held is None else np.concatenate([held, table])
            last = np.flatnonzero((table[:, :3] != table[-1, :3]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            held = table[cut:]
            if cut:
                yield done(table[:cut])
        if held is not None and len(held):
            yield done(held)

    return batches


def links(points: DataFrame, distance: int = 4, blocks: int = 6) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``bits``) that differ in at most ``distance`` bits.

    Not every such pair is listed, but a forest within each compared block, so a large group of near copies gives
    about as many links as it has members; two fingerprints are connected exactly if they are by all pairs.
    A cell of more than ``BLOCK`` fingerprints is cut into blocks by a hash of the fingerprint, and each pair of
    blocks is compared by a task of its own; whatever the cell, a task holds two blocks at most.
    ``blocks`` sets the width of cells: at 6 a cell fixes about 21 bits; take 8 (four blocks, 32 bits) for 10^10 rows.
    """
    keyed = points.select("bits", F.explode(cells(F.col("bits"), blocks, distance)).alias("cell"))
    sizes = keyed.groupBy("cell").agg(F.count("*").alias("size")).filter("size > 1")
    cut = keyed.join(sizes, "cell").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("long"))
    own = F.pmod(F.xxhash64("bits"), "parts")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    blocked = cut.select("cell", "bits", own.alias("own"), other.alias("other")).select(
        "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "bits"
    )
    grouped = blocked.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "bits")
    return grouped.mapInArrow(_links_in_groups(distance), "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = 4, distance: int = 4, blocks: int = 6, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, fingerprint, component_id, is_kept`` for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest key that links of at most ``distance``
    differing bits reach. Copies meet as one fingerprint before any comparison, so thousands of copies cost one point.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other. Rows with a
    null key get a component, but cannot name one: it is null where no row of the component has a key. Repeated rows
    are each returned, all with the same values. Other columns are ignored; an empty table gives an empty result.
    """
    prints = saved(fingerprints(docs, size, key, text))
    points = saved(prints.groupBy("bits").agg(F.min(key).alias("first")))
    groups = components(links(points, distance, blocks)).withColumnRenamed("node", "bits")
    joined = points.join(groups, "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(smallest, "component").select("bits", "component_id")
    return prints.join(named, "bits").select(
        key,
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)).alias("is_kept"),
    )
