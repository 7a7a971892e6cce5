"""Collocations: frequent phrases whose words meet more often than their parts would by chance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmill.llm.common import saved, whole_text

MAX_WORDS = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"
#: Most bits of the map of frequent fingerprints that tasks get (64 MB), and bits for each fingerprint below that.
MAP_BITS, BITS_EACH = 1 << 29, 32
#: Which bits of a fingerprint give its slots in a map, and in that of the proofs, which has to be surer.
SLOTS, SURER_SLOTS = (0, 17, 34), (0, 9, 18, 27, 36, 45)
#: Different fingerprints that a task holds (a quarter of that comes in before equal ones are added up), rows that it hands
#: over together, and characters of a text that are hashed together. They bound a task's memory, not its results.
HELD, ROWS, BLOCK = 2_000_000, 100_000, 1 << 18

# Rabin-Karp polynomials modulo 2**64: an odd base has an inverse, so a prefix sum gives every substring's value.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
OTHER_BASE = 0xD6E8FEB86659FD93

PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
IS_SPACE, IS_END = np.zeros(256, bool), np.zeros(256, bool)
IS_SPACE[[0x20, 0x09]] = True
IS_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    """The first ``size`` powers of a base, or more of them: a task keeps the longest table only."""
    if len(_POWERS.get(base, ())) < size:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base]


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial values, whose low bits depend on little of the text."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of some texts of one language, one after the other, and the fingerprints of their n-grams.

    ``ends[i]`` is the first word after word i that is in another piece or text.
    """

    def __init__(self, texts: list[bytes], bits: int = 64):
        self.bits = bits
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        is_end = IS_END[data]
        inside = ~(IS_SPACE[data] | is_end)
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, stop = edge[::2], edge[1::2]  # in the texts as they are
        piece = np.cumsum(is_end)[self.start] if len(data) else self.start
        self.ends = np.searchsorted(piece, piece, side="right")
        # words alone, each with one space after it, so that spacing in the text does not matter
        length = stop - self.start + 1
        self.close = np.cumsum(length)  # just after the space that follows the word
        self.open = self.close - length
        self.flat = np.full(int(self.close[-1]) if len(length) else 0, 32, np.uint8)
        letters = np.ones(len(self.flat), bool)
        letters[self.close - 1] = False
        self.flat[letters] = data[inside]
        self.size = 1 << max(10, len(self.flat).bit_length())
        self.prefix = self._prefix(BASE)
        self.inverse = _powers(INVERSE, self.size)

    def _prefix(self, base: int) -> np.ndarray:
        out = np.zeros(len(self.flat) + 1, np.uint64)
        np.cumsum((self.flat + np.uint64(1)) * _powers(base, self.size)[: len(self.flat)], out=out[1:])
        return out

    def starts(self, n: int) -> np.ndarray:
        """Where an n-gram begins: words with n - 1 more in their piece."""
        return np.flatnonzero(self.ends - np.arange(len(self.ends)) >= n)

    def fingerprints(self, at: np.ndarray, n: int, seed: int) -> np.ndarray:
        """Of the n-grams that begin with the given words, by two looks at the prefix sums each."""
        first = self.open[at]
        values = (self.prefix[self.close[at + n - 1]] - self.prefix[first]) * self.inverse[first]
        return _mix(values + np.uint64(seed)) & np.uint64((1 << self.bits) - 1)

    @cached_property
    def _other(self) -> tuple[np.ndarray, np.ndarray]:
        return self._prefix(OTHER_BASE), _powers(pow(OTHER_BASE, -1, 1 << 64), self.size)

    def proofs(self, at: np.ndarray, n: int, seed: int, prints: np.ndarray) -> np.ndarray:
        """Fingerprints that also hold a second polynomial, of another base, over the same bytes."""
        first, (prefix, inverse) = self.open[at], self._other
        values = (prefix[self.close[at + n - 1]] - prefix[first]) * inverse[first]
        return _mix(values * np.uint64(2 * n + 1) + np.uint64(seed)) ^ prints

    def phrase(self, at: int, n: int) -> str:
        return bytes(self.flat[self.open[at] : self.close[at + n - 1] - 1]).decode("utf-8", "replace")


class Map:
    """A few bits per fingerprint; one of which a bit is not set is not in the set that the map was made of."""

    def __init__(self, bits: np.ndarray, shifts: tuple[int, ...] = SLOTS):
        self.bits, self.mask, self.shifts = bits, np.uint64(len(bits) * 64 - 1), shifts

    def has(self, prints: np.ndarray) -> np.ndarray:
        found = np.ones(len(prints), bool)
        for shift in self.shifts:
            slot = prints >> np.uint64(shift) & self.mask
            found &= (self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _seed(lang: str) -> int:
    value = 0
    for byte in lang.encode("utf-8", "surrogatepass"):
        value = (value * BASE + byte + 1) % (1 << 64)
    return value


def _blocks(frame: pd.DataFrame) -> Iterator[tuple[str, list[int], list[bytes]]]:
    """Lower-case texts of one language, some at a time; a long text is cut where a piece ends."""
    for lang, group in frame.groupby("lang", sort=False):
        held, marks, size = [], [], 0
        for mark, text in zip(group["mark"], group["text"]):
            data, first = text.encode("utf-8", "surrogatepass").lower(), 0  # of bytes, this lowers A-Z only
            while first <= len(data):
                cut = PIECE_END.search(data, first + BLOCK)
                last = cut.start() if cut else len(data)
                held.append(data[first:last])
                marks.append(mark)
                size += last - first + 1
                first = last + 1
                if size >= BLOCK:
                    yield lang, marks, held
                    held, marks, size = [], [], 0
        if held:
            yield lang, marks, held


def _marks(words: Words, marks: list[int], texts: list[bytes]) -> np.ndarray:
    """The mark of the text of each word."""
    text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    return np.array(marks, np.int64)[text_of[words.start]]


def _level(n: int) -> int:
    """Words are counted first, then pairs, then all longer phrases."""
    return min(n, 3)


def _may_be_frequent(words: Words, n: int, seed: int, known: dict[int, Map]) -> np.ndarray:
    """Beginnings of the n-grams of which all parts of the level before may be frequent; no other can be frequent."""
    at, part = words.starts(n), _level(n) - 1
    if part in known:
        ok = np.zeros(len(words.ends), bool)
        first = words.starts(part)
        ok[first] = known[part].has(words.fingerprints(first, part, seed))
        for step in range(n - part + 1):
            at = at[ok[at + step]]
    return at


def _tally(lengths: tuple[int, ...], known: dict[int, Map], bits: int = 64):
    """Rows ``print, n, mark``: how often a fingerprint occurs in a task's texts, and the smallest mark of such a text."""

    def add_up(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        # a column at a time; the fingerprints held so far are in order, which a stable sort makes use of
        prints = np.concatenate([part[0] for part in held])
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        prints = prints[first]
        n = np.add.reduceat(np.concatenate([part[1] for part in held])[order], first)
        return prints, n, np.minimum.reduceat(np.concatenate([part[2] for part in held])[order], first)

    def batches(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        summed, fresh, size = [], [], 0
        for frame in stream:
            for lang, marks, texts in _blocks(frame):
                words, seed = Words(texts, bits), _seed(lang)
                mark_of = _marks(words, marks, texts)
                for n in lengths:
                    at = _may_be_frequent(words, n, seed, known)
                    if len(at):
                        fresh.append((words.fingerprints(at, n, seed), np.ones(len(at), np.int64), mark_of[at]))
                        size += len(at)
                if size > HELD // 4:
                    fresh = [add_up(fresh)]
                    summed, fresh, size = [add_up(summed + fresh)], [], 0
                    if len(summed[0][0]) > HELD:
                        yield from _frames(*summed.pop())
        if summed or fresh:
            yield from _frames(*add_up(summed + fresh))

    def _frames(prints: np.ndarray, n: np.ndarray, marks: np.ndarray) -> Iterator[pd.DataFrame]:
        for at in range(0, len(prints), ROWS):
            part = slice(at, at + ROWS)
            yield pd.DataFrame({"print": prints[part].view(np.int64), "n": n[part], "mark": marks[part]})

    return batches


def _at_pointer(prints: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """One key of a fingerprint and the text that its pointer names; `_pointers` gives the same in Spark."""
    return prints ^ marks.view(np.uint64) << np.uint64(20)


def _pointers(phrases: DataFrame) -> DataFrame:
    return phrases.select(F.col("print").bitwiseXOR(F.shiftleft("mark", 20)).alias("print"))


def _read_texts(known: dict[int, Map], chosen: Map, as_pointers: bool, bits: int = 64):
    """Rows ``print, lang, words, phrase, n, proof`` of n-grams whose fingerprint may be frequent.

    With ``as_pointers`` those in the texts that ``chosen`` points to, so nearly one row per fingerprint, and with 0
    words the number of words of a language. Otherwise ``chosen`` has the proofs of the phrases that were read so, and
    the rows are the n-grams that are not among them: other texts with a frequent fingerprint.
    """

    def batches(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, int] = {}
        found: dict[tuple[int, str, int, str, int], int] = {}
        for frame in stream:
            for lang, marks, texts in _blocks(frame):
                words, seed = Words(texts, bits), _seed(lang)
                totals[lang] = totals.get(lang, 0) + len(words.start)
                mark_of = _marks(words, marks, texts)
                for n in known:
                    at = _may_be_frequent(words, n, seed, known)
                    prints = words.fingerprints(at, n, seed)
                    hit = known[n].has(prints)
                    if as_pointers:
                        hit[hit] = chosen.has(_at_pointer(prints[hit], mark_of[at[hit]]))
                    at, prints = at[hit], prints[hit]
                    proofs = words.proofs(at, n, seed, prints)
                    if not as_pointers:
                        other = ~chosen.has(proofs)
                        at, prints, proofs = at[other], prints[other], proofs[other]
                    values = zip(prints.view(np.int64).tolist(), at.tolist(), proofs.view(np.int64).tolist())
                    for value, place, proof in values:
                        entry = (value, lang, n, words.phrase(place, n), proof)
                        found[entry] = found.get(entry, 0) + 1
            if len(found) > READ_HELD:
                yield rows(found, {})
                found = {}
        yield rows(found, totals)

    def rows(found: dict, totals: dict) -> pd.DataFrame:
        out = [(*entry, n) for entry, n in found.items()]
        out += [(0, lang, 0, "", 0, n) for lang, n in totals.items() if as_pointers]
        return pd.DataFrame(out, columns=["print", "lang", "words", "phrase", "proof", "n"])

    return batches


#: Phrases that a task holds while it reads them.
READ_HELD = 375_000
READ = "print long, lang string, words int, phrase string, proof long, n long"


def _map_of(prints: DataFrame, shifts: tuple[int, ...] = SLOTS) -> Map:
    """The bits of a table of fingerprints: put together on the executors, at most ``MAP_BITS`` of them reach the driver."""
    size = min(MAP_BITS, 1 << max(10, (prints.count() * BITS_EACH * len(shifts) // len(SLOTS)).bit_length()))
    slots = F.array(*(F.shiftrightunsigned("print", shift).bitwiseAND(F.lit(size - 1)) for shift in shifts))
    spots = prints.select(F.explode(slots).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    parts = spots.groupBy(F.shiftright("slot", 6).alias("place")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[parts["place"].to_numpy(np.int64)] = parts["bits"].to_numpy(np.int64).view(np.uint64)
    return Map(bits, shifts)


def frequent_phrases(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = MAX_WORDS,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    bits: int = 64,
) -> DataFrame:
    """``lang, words, phrase, n``: every phrase of up to ``longest`` words that occurs ``least`` times.

    A language's row with 0 words has the number of all its words.

    N-grams are fingerprints until the end: a prefix polynomial over a block of text gives each by two looks, tasks
    add equal ones up, and one shuffle sums fingerprint, count and the pointer to a text, the smallest key of those
    that have it. Words come first, then pairs, then longer phrases; what contains a rarer part cannot be frequent and
    is not sent, which tasks see in a map of bits of the frequent parts. Such a map may say yes wrongly, which costs a
    row, and never no. Phrases are read from the texts that the pointers name, frequent ones only. A last pass holds
    every occurrence of a frequent fingerprint against the phrase that was read for it, by a second polynomial: texts
    that only share the fingerprint are counted by themselves and taken off its count. (Such a text is overlooked if
    the map of the second polynomials says yes wrongly, for one in ten thousand of the accidents of 64 bits.) ``bits``
    is the size of fingerprints; small ones make many accidents.

    Null texts are empty, a null language is ``und``; rows with a null key are pointed to by a hash of their text.
    Repeated rows count each; rows that share a key may be read in place of each other. Empty tables have no row.
    """
    content = whole_text(text)
    rows = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(f"`{key}`").cast("long"), F.xxhash64(content)).alias("mark"),
        content.alias("text"),
    )
    known: dict[int, Map] = {}
    levels = []
    for level in range(1, _level(longest) + 1):
        lengths = tuple(n for n in range(1, longest + 1) if _level(n) == level)
        tallied = rows.mapInPandas(_tally(lengths, known, bits), "print long, n long, mark long")
        summed = tallied.groupBy("print").agg(F.sum("n").alias("n"), F.min("mark").alias("mark"))
        levels.append(saved(summed.filter(F.col("n") >= least).withColumn("level", F.lit(level))))
        known |= dict.fromkeys(lengths, _map_of(levels[-1]))
    prints = reduce(DataFrame.unionByName, levels)

    read = saved(rows.mapInPandas(_read_texts(known, _map_of(_pointers(prints)), True, bits), READ))
    sizes = read.filter("words = 0").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    key, level = ["print", "level"], F.least("words", F.lit(_level(longest))).alias("level")
    read = read.filter("words > 0").withColumn("level", level)
    texts = read.groupBy(*key).agg(F.min(F.struct("lang", "words", "phrase", "proof")).alias("t"))
    phrases = saved(prints.join(texts, key).select(*key, "n", "t.*"))
    proofs = _map_of(phrases.select(F.col("proof").alias("print")), SURER_SLOTS)
    others = rows.mapInPandas(_read_texts(known, proofs, False, bits), READ).withColumn("level", level)
    others = saved(others.groupBy(*key, "lang", "words", "phrase").agg(F.sum("n").alias("n")))
    others = others.join(prints.select(*key), key, "left_semi")
    strange = others.groupBy(*key).agg(F.sum("n").alias("strange"))
    own = phrases.join(strange, key, "left").withColumn("n", F.col("n") - F.coalesce("strange", F.lit(0)))
    names = ["lang", "words", "phrase", "n"]
    return own.select(*names).unionByName(others.select(*names)).filter(F.col("n") >= least).unionByName(sizes)


def _whole(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(19,0)")


def collocations(phrases: DataFrame, top: int | None = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` from `frequent_phrases`, the best ``top`` of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of the cut with the lowest ``floor(1000 a n / (l r))``, the
    earliest of equal ones; ``n`` counts the language's words. Parts of a frequent phrase are frequent, so they are in
    the table. Products are decimals of 38 digits, enough for counts up to 10**15 of a phrase and 10**18 words.
    Phrases of which a longer one has as many occurrences are left out; it is enough to look one word further, since
    all phrases between the two have that number too. Equal scores are ordered by ``a``, then by the bytes of the text.
    """
    phrases = saved(phrases)
    sizes = phrases.filter("words = 0").select("lang", F.col("n").alias("total"))
    counts = phrases.filter("words > 0").select("lang", "words", "phrase", F.col("n").alias("count"))
    whole = phrases.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))

    inner = whole.filter("words > 2").select("lang", "a", F.split("phrase", " ").alias("w"))
    parts = F.array(
        F.array_join(F.expr("slice(w, 1, size(w) - 1)"), " "), F.array_join(F.expr("slice(w, 2, size(w) - 1)"), " ")
    )
    covered = inner.select("lang", F.explode(parts).alias("phrase"), "a").distinct()
    left = whole.join(covered, ["lang", "phrase", "a"], "left_anti")

    split = left.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cut = split.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.expr("slice(w, 1, k)"), " ").alias("head"),
        F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("count").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("count").alias("r"))
    scored = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(F.broadcast(sizes), "lang")
    above, below = _whole(F.col("a") * 1000) * _whole("total"), _whole("l") * _whole("r")
    exact = scored.withColumn("above", above).withColumn("below", below).withColumn("score", F.expr("above div below"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("best")
    best = exact.groupBy("lang", "phrase", "a", "total").agg(lowest)
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select(
        "lang", "rank", "phrase", "a", "best.l", "best.r", F.col("total").alias("n"), "best.score"
    )
