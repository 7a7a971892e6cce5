"""The language of texts by unigram pieces, all segmentations of a word counted."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmill.llm.common import fold, saved, whole_text

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
FOLDS, HELD_OUT = 4, 2
#: Most texts that the probabilities are learned from (those with the smallest key hashes).
TRAIN_ROWS = 8_000
ROUNDS = 4
UNKNOWN = "und"
#: Probability of a letter that the vocabulary does not have, in any language.
STRANGE = 1e-7
#: Longest word, in letters, that the probabilities are learned from. Texts are scored by words of any length.
LEARNED = 1_000
#: Characters of a text, and letters of a word, that are looked at together.
BLOCK, STRETCH = 1 << 20, 4_096
#: Words, and their letters, whose scores a worker remembers before it forgets them all.
REMEMBERED, REMEMBERED_LETTERS = 600_000, 12_000_000
#: Words of several texts that are scored together.
TOGETHER = 400_000


#: A word begins with a letter; marks, such as vowel signs, belong to it. Numbers of any kind are not letters.
LETTERS, PART, NO_LETTER = (regex.compile(p) for p in (r"\p{L}[\p{L}\p{M}]*", r"[\p{L}\p{M}]+", r"[^\p{L}\p{M}]"))
#: The same words, found faster, in texts without marks and without numbers that are not decimal digits.
PLAIN = re.compile(r"[^\W\d_]+")
MARKS = "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Nl", "No"))
NOT_PLAIN = re.compile(f"[{re.escape(MARKS)}\U00010000-\U0010ffff]")


@cache
def pieces(path: str) -> dict[str, int]:
    """Lower-case pieces of letters, with or without the mark of a word's beginning, numbered."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = dict.fromkeys(model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    fit = [p for p in found if p == "▁" or PART.fullmatch(p) or (p[0] == "▁" and LETTERS.fullmatch(p[1:]))]
    return {piece: number for number, piece in enumerate(fit)}


def words(text: str) -> Iterator[list[str]]:
    """The lower-case words of a text, whole runs of letters, those of about ``BLOCK`` characters at a time."""
    start = 0
    while start < len(text):
        cut = NO_LETTER.search(text, start + BLOCK)
        end = cut.start() if cut else len(text)
        block = text[start:end].lower()
        yield (PLAIN if block.isascii() or not NOT_PLAIN.search(block) else LETTERS).findall(block)
        start = end


def _steps(group: list[str], vocabulary: dict[str, int], longest: int) -> Iterator[list[np.ndarray]]:
    """For words of one length, letter by letter: the pieces with 1, 2, … letters that end there, a number per word.

    -1 is no piece, -2 a letter that is no piece.
    """
    size, get = len(group[0]), vocabulary.get
    for first in range(0, size, STRETCH):
        ends = range(first + 1, min(first + STRETCH, size) + 1)
        spans = [(end - m, end) for end in ends for m in range(1, min(end, longest) + 1)]
        flat = [get(word[a:b], -1) for word in group for a, b in spans]
        ids = np.ascontiguousarray(np.array(flat, np.int32).reshape(len(group), -1).T)
        at = 0
        for end in ends:
            step = list(ids[at : at + min(end, longest)])
            step[0][step[0] == -1] = -2
            at += len(step)
            yield step


def _sums(steps: Iterable[list[np.ndarray]], table: np.ndarray) -> Iterator[np.ndarray]:
    """Logarithms of the probabilities of growing parts of words, all segmentations summed, per word and language.

    Only as many parts are kept as a piece has letters at most, each as its share of the last one, so that words of
    any length neither fill the memory nor underflow. ``table`` ends with the rows for -2 and -1.
    """
    total, before = 0.0, [1.0]
    for step in steps:
        grown = sum(share * table[ids] for share, ids in zip(before, step))
        total = total + np.log(grown)
        before = [1.0] + [share / grown for share in before[: len(step)]]
        yield total


def _by_length(found: list[str], letters: int) -> Iterator[list[int]]:
    """Places of words of one length, with about ``letters`` letters together."""
    places: dict[int, list[int]] = {}
    for at, word in enumerate(found):
        places.setdefault(len(word), []).append(at)
    for size, group in places.items():
        most = max(1, letters // min(size, STRETCH))
        for first in range(0, len(group), most):
            yield group[first : first + most]


def _table(probabilities: np.ndarray) -> np.ndarray:
    edge = np.array([[STRANGE], [0.0]]) * np.ones((1, probabilities.shape[1]))
    return np.concatenate([probabilities, edge])


def log_likelihoods(found: list[str], vocabulary: dict[str, int], table: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of each word in each language, all segmentations summed."""
    out = np.zeros((len(found), table.shape[1]))
    marked = ["▁" + word for word in found]
    longest = max(map(len, vocabulary))
    for group in _by_length(marked, 200_000):
        total = 0.0
        for total in _sums(_steps([marked[i] for i in group], vocabulary, longest), table):
            pass
        out[group] = total
    return out


def expected(found: list[str], counts: np.ndarray, vocabulary: dict[str, int], table: np.ndarray) -> np.ndarray:
    """How often each piece is used in the words, whose counts per language are given, by the present probabilities."""
    out = np.zeros_like(table)
    marked = ["▁" + word for word in found]
    longest = max(map(len, vocabulary))
    for group in _by_length(marked, 50_000):
        steps = list(_steps([marked[i] for i in group], vocabulary, longest))
        size, start = len(steps), np.zeros((len(group), table.shape[1]))
        back = [[steps[at + m][m] for m in range(min(longest, size - at))] for at in range(size - 1, -1, -1)]
        before, after = [start, *_sums(steps, table)], [start, *_sums(back, table)][::-1]
        for end, step in enumerate(steps, 1):
            for m, at in enumerate(step, 1):
                has = at >= 0
                share = np.exp((before[end - m] + after[end] - before[size])[has])
                used = share * table[at[has]] * counts[group][has]
                for language in range(table.shape[1]):
                    out[:, language] += np.bincount(at[has], used[:, language], len(out))
    return out


@dataclass(frozen=True)
class Languages:
    names: tuple[str, ...]
    table: np.ndarray
    vocabulary: str
    token: str


class _Scorer:
    """Scores of a worker's words; it outlives a task, since most words return in the next."""

    def __init__(self, model: Languages):
        self.model, self.vocabulary = model, pieces(model.vocabulary)
        self.forget()

    def forget(self) -> None:
        self.known, self.letters, self.scores = {}, 0, np.zeros((0, len(self.model.names)))

    def add(self, waiting: list[tuple[int, Counter]], totals: np.ndarray, letters: np.ndarray) -> None:
        """Add the words' logarithms to the rows of ``totals``; new words of all texts are scored together."""
        if len(self.known) > REMEMBERED or self.letters > REMEMBERED_LETTERS:
            self.forget()
        if new := list(set().union(*(tally for _, tally in waiting)).difference(self.known)):
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.letters += sum(map(len, new))
            self.scores = np.concatenate([self.scores, log_likelihoods(new, self.vocabulary, self.model.table)])
        for row, tally in waiting:
            at = np.fromiter(map(self.known.__getitem__, tally), np.int64, len(tally))
            totals[row] += np.fromiter(tally.values(), float, len(tally)) @ self.scores[at]
            letters[row] = True


_scorers: dict[str, _Scorer] = {}


def _scorer(model: Languages) -> _Scorer:
    if model.token not in _scorers:
        _scorers.clear()
        _scorers[model.token] = _Scorer(model)
    return _scorers[model.token]


def train(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    rows: int = TRAIN_ROWS,
    rounds: int = ROUNDS,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> Languages:
    """Piece probabilities per language by expectation maximisation over the words of at most ``rows`` texts.

    Texts of the held-out fold, texts without a language and words of more than ``LEARNED`` letters are not learned
    from; a language with no other words is not learned. The sample is drawn on keys, whose
    list is small enough to broadcast (under 1 MB). Word counts stay in Spark; each round sums expected counts per
    piece and language, of which there are vocabulary times languages at most, and only those reach the driver.
    """
    known = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").cast("string").alias("lang"))
    known = known.filter("key is not null and lang is not null").filter(fold("key", FOLDS) != HELD_OUT)
    known = known.groupBy("key").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = docs.select(F.col(f"`{key}`").alias("key"), whole_text(text).alias("text"))
    sample = texts.join(F.broadcast(known), "key").select("lang", "text")

    def count(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in stream:
            for language, group in frame.groupby("lang"):
                found = (word for value in group["text"] for block in words(value) for word in block)
                tally = Counter(word for word in found if len(word) <= LEARNED)
                if tally:
                    yield pd.DataFrame({"lang": language, "word": list(tally), "n": list(tally.values())})

    counted = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = saved(counted.repartition("word"))
    names = tuple(sorted(row[0] for row in counted.select("lang").distinct().collect()))
    numbers = pieces(vocabulary)
    table = _table(np.full((len(numbers), len(names)), 1 / len(numbers)))

    def maximise(present: np.ndarray) -> np.ndarray:
        def sums(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(present)
            for frame in stream:
                for language, group in frame.groupby("lang"):
                    one = names.index(language)
                    column = present[:, one : one + 1]
                    total[:, one : one + 1] += expected(
                        group["word"].tolist(), group[["n"]].to_numpy(float), pieces(vocabulary), column
                    )
            piece, language = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": language, "n": total[piece, language]})

        got = counted.mapInPandas(sums, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        frame, new = got.toPandas(), np.full((len(numbers), len(names)), 0.01)
        new[frame["piece"], frame["lang"]] += frame["n"]
        return _table(new / new.sum(axis=0))

    if names:
        for _ in range(rounds):
            table = maximise(table)
    return Languages(names, table, vocabulary, uuid.uuid4().hex)


def identify(docs: DataFrame, model: Languages, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, lang_pred, score`` for every row of ``docs``, from its whole text.

    Words are runs of letters and marks as Unicode classes them, of any length. ``score`` is the probability of the predicted language among the learned ones, each as likely beforehand. Texts
    that are null or have no letter, and all texts if nothing could be learned, are ``und`` with score 0. Equal scores
    give the language that is first in the alphabet. Rows with a null key are not held out; repeated rows get the same
    result each. Other columns are ignored; an empty table gives an empty result.
    """

    def batches(stream: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(model)
        for texts in stream:
            totals, letters = np.zeros((len(texts), len(model.names))), np.zeros(len(texts), bool)
            waiting: list[tuple[int, Counter]] = []
            size = 0
            for at, value in enumerate(texts):
                for found in words(value):
                    if found and model.names:
                        waiting.append((at, Counter(found)))
                        size += len(found)
                    if size > TOGETHER:
                        scorer.add(waiting, totals, letters)
                        waiting, size = [], 0
            scorer.add(waiting, totals, letters)
            if not model.names:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0})
                continue
            best = totals.argmax(axis=1)
            share = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
            names = np.array(model.names, object)[best]
            yield pd.DataFrame({"lang_pred": np.where(letters, names, UNKNOWN), "score": np.where(letters, share, 0.0)})

    predict = F.pandas_udf(lambda stream: batches(stream), "lang_pred string, score double", F.PandasUDFType.SCALAR_ITER)
    held_out = F.coalesce(fold(key, FOLDS) == HELD_OUT, F.lit(False))
    found = docs.select(F.col(f"`{key}`").alias(key), held_out.alias("held_out"), predict(whole_text(text)).alias("found"))
    return found.select(key, "held_out", "found.lang_pred", "found.score")
