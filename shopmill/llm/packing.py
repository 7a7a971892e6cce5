"""Pack tokenised documents into sequences of bounded length by first-fit decreasing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from shopmill.llm.common import key_type, whole_text

PATTERN = public_tokenizers.PATTERN
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
END_ID = 1
#: Tokens that are packed together: what a task holds, 4 bytes each.
GROUP_TOKENS = 1 << 23
#: A blank between two other characters: it belongs to the token behind it, so a text can be cut before it.
INNER_BLANK = re.compile(r"(?<=\S)(?= \S)")
#: Characters of a text that are encoded at once.
BLOCK = 1 << 18


def _blocks(text: str) -> Iterator[str]:
    """A long text in bounded blocks, cut where no token reaches across."""
    start = 0
    while len(text) - start > BLOCK and (found := INNER_BLANK.search(text, start + BLOCK)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class Encoder:
    """Token ids of whole texts as little-endian 32-bit numbers.

    The byte-pair ranks are read from the tokenizer's own vocabulary, whose ids follow the order of its merges, and
    applied by a faster library with the same ids; a text that contains a special token goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        letters = {letter: byte for byte, letter in _byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(letters[c] for c in word): rank for word, rank in vocabulary.items() if word not in self.special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if any(special in text for special in self.special):
            found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            return np.array(found, "<u4").tobytes()
        return b"".join(np.array(self.ranks.encode_ordinary(part), "<u4").tobytes() for part in _blocks(text))


def _byte_letters() -> dict[int, str]:
    """The printable letter that the vocabulary file writes for each byte: itself, or the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in own]
    return {byte: chr(byte) for byte in own} | {byte: chr(256 + i) for i, byte in enumerate(others)}


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Bins:
    """Bins of equal capacity in a tournament tree: a node holds the largest free space below it."""

    def __init__(self, count: int, capacity: int):
        self.leaves = 1 << max(0, count - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """The first bin with room for ``size``, which it takes; there must be one."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        free[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            larger = max(free[2 * node], free[2 * node + 1])
            if free[node] == larger:
                break
            free[node] = larger
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; sizes are taken from the largest down, equal ones in their order."""
    bins, where = Bins(len(sizes), capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        where[i] = bins.put(sizes[i])
    return where


def pack_group(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents with the given lengths.

    Whole sequences are cut from long documents; the rests and the short documents go first-fit decreasing. What is
    then in the emptiest bins is cut into the room left in the fullest ones, which leaves one partly filled bin at
    most. That one is cut at powers of two, a length that needs no padding.
    """
    full, rests = [], []
    for document, length in enumerate(lengths):
        end = length - length % capacity
        full.extend((document, at, capacity) for at in range(0, end, capacity))
        if end < length:
            rests.append((document, end, length - end))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for piece, where in zip(rests, first_fit_decreasing([size for _, _, size in rests], capacity)):
        bins.setdefault(where, []).append(piece)
    packed = [[piece] for piece in full]
    filled = sorted(bins.values(), key=lambda pieces: -sum(size for _, _, size in pieces))
    room = [capacity - sum(size for _, _, size in pieces) for pieces in filled]
    low, high = 0, len(filled) - 1
    while low < high:
        if not room[low]:
            low += 1
            continue
        document, start, size = filled[high].pop()
        moved = min(size, room[low])
        filled[low].append((document, start + size - moved, moved))
        if moved < size:
            filled[high].append((document, start, size - moved))
        room[low] -= moved
        room[high] += moved
        if not filled[high]:
            high -= 1
    packed.extend(filled[: high + 1])
    if packed and room and room[high]:
        packed.extend(_powers(packed.pop()))
    return [
        (document, start, size, number, offset)
        for number, pieces in enumerate(packed)
        for document, start, size, offset in _offsets(pieces)
    ]


def _offsets(pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    offset = 0
    for document, start, size in pieces:
        yield document, start, size, offset
        offset += size


def _powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are powers of two, the longest first."""
    left, pieces = sum(size for _, _, size in pieces), pieces[::-1]
    while left:
        need = 1 << (left.bit_length() - 1)
        left, sequence = left - need, []
        while need:
            document, start, size = pieces.pop()
            taken = min(size, need)
            sequence.append((document, start, taken))
            if taken < size:
                pieces.append((document, start + taken, size - taken))
            need -= taken
        yield sequence


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 7,
) -> DataFrame:
    """``key, start, length, ids, doc_tokens, sequence_id, offset``: the pieces of all documents, each with its ids.

    A document's ids are those of its whole text and ``end_id``; each id is in exactly one piece. ``ids`` are
    little-endian unsigned 32-bit numbers. A sequence is padded to ``capacity``, unless its length is a power of two.
    Documents are dealt to tasks by a seeded hash of key and row, so a task's groups are random ones; a group ends
    when it has ``GROUP_TOKENS`` tokens, whatever the task holds. Texts are shuffled once. Rows are sorted by their
    hash, so that a task that runs again packs alike, and a sequence is numbered by its task and place.

    Null and empty texts are documents of one id. Rows with a null key and repeated rows are documents like others.
    Other columns are ignored; an empty table gives an empty result.
    """

    def packed(keys: list, ids: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        pieces = pack_group([len(i) // 4 for i in ids], capacity)
        columns = list(zip(*pieces)) if pieces else [()] * 5
        document, start, size, number, offset = columns
        task = TaskContext.get().partitionId() << 36
        arrays = [
            pa.array([keys[d] for d in document], kind),
            pa.array(start, pa.int64()),
            pa.array(size, pa.int64()),
            pa.array([ids[d][4 * a : 4 * (a + n)] for d, a, n in zip(document, start, size)], pa.binary()),
            pa.array([len(ids[d]) // 4 for d in document], pa.int64()),
            pa.array([task + first + n for n in number], pa.int64()),
            pa.array(offset, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names), first + (number[-1] + 1 if number else 0)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, tokens, first = [], [], 0, 0
        end = np.array([end_id], "<u4").tobytes()
        encode = encoder(vocabulary)
        for batch in stream:
            for one, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = encode.ids(value.as_py())
                keys.append(one)
                ids.append(found + end)
                tokens += len(found) // 4 + 1
                if tokens >= GROUP_TOKENS:
                    part, first = packed(keys, ids, first)
                    yield part
                    keys, ids, tokens = [], [], 0
        if keys:
            yield packed(keys, ids, first)[0]

    kind = to_arrow_type(key_type(docs, key))
    names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    longs = [T.StructField(n, T.LongType()) for n in names]
    schema = T.StructType(
        [T.StructField(key, key_type(docs, key)), *longs[1:3], T.StructField("ids", T.BinaryType()), *longs[4:]]
    )
    # the place in the input splits repeated rows, which would otherwise all meet in one task
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole_text(text).alias("text"))
    order = F.xxhash64(F.lit(seed), "key", F.monotonically_increasing_id())
    dealt = rows.withColumn("order", order).repartition("order").sortWithinPartitions("order")
    return dealt.select("key", "text").mapInArrow(batches, schema)
