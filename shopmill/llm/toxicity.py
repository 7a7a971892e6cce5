"""Toxicity of texts: a bidirectional gated recurrent network with attention pooling over words and their characters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmill.llm.common import fold, whole_text

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Words in a window and from one window to the next: every window overlaps its neighbours by half.
WINDOW, STRIDE = 64, 32
#: Most labelled rows of either label that a model is fitted on (those with the smallest key hashes), and most windows
#: of one of them: the ones whose words say most. A window takes 1 KB.
TOXIC_ROWS, CLEAN_ROWS, WINDOWS_EACH = 4_000, 8_000, 4
#: Slots of hashed words and of hashed character n-grams, and the lengths of these.
SLOTS, GRAMS = 1 << 18, (3, 4, 5, 6)
#: Rows without the feature, as many as this, are believed in before any are seen.
PRIOR = 10.0
HIDDEN, INPUTS = 8, len(GRAMS) + 4
#: Steps of gradient descent, taken in as many passes over the rows as that needs.
UPDATES, RATE, BATCH = 480, 0.02, 256
#: Windows that are scored together, characters of a text that are taken apart together, and words remembered.
TOGETHER, BLOCK, REMEMBERED = 1_024, 1 << 20, 500_000

WORD = re.compile(r"[^\W\d_]+")
NO_LETTER = re.compile(r"[\W\d_]")
PAD = 0


def words(text: str) -> Iterator[list[str]]:
    """The lower-case runs of letters of a whole text, a bounded list at a time."""
    start = 0
    while start < len(text):
        cut = NO_LETTER.search(text, start + BLOCK)
        end = cut.start() if cut else len(text)
        yield WORD.findall(text[start:end].lower())
        start = end


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _slots(found: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The slot of each word, and per n-gram length the slots at each character and which of them are inside a word.

    A word is taken with a mark before and after it, so n-grams know where a word begins and ends.
    """
    marked = "".join(f"\x02{w}\x03" for w in found)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, found), np.int64, len(found)) + 2
    start = np.cumsum(length) - length
    left = np.repeat(start + length, length) - np.arange(len(codes))  # characters to the end of the word
    base, grams = np.uint64(0x9E3779B97F4A7C15), []
    value = codes.copy()
    for n in range(2, max(GRAMS) + 1):
        value = value * base
        value[: max(0, len(codes) - n + 1)] += codes[n - 1 :]
        if n in GRAMS:
            grams.append((_mix(value + np.uint64(n)) >> np.uint64(46), left >= n))
    place = (length.max(initial=0) > 0) * (np.arange(len(codes)) - np.repeat(start, length))
    power = np.full(int(length.max(initial=1)), base, np.uint64)
    power[0] = 1
    whole = codes * np.cumprod(power, dtype=np.uint64)[place]
    whole = np.add.reduceat(whole, start) if len(found) else np.zeros(0, np.uint64)
    return _mix(whole) >> np.uint64(46), grams


@dataclass(frozen=True)
class Evidence:
    """How much a word, or a character n-gram of it, speaks for label 1: logarithms of odds against those of all rows."""

    words: np.ndarray
    grams: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, rows: np.ndarray) -> Evidence:
        """From the numbers of rows per kind (words, n-grams), label and slot, and the numbers of rows per label."""
        share = (rows[1] + 1) / (rows.sum() + 2)
        odds = (counts[:, 1] + PRIOR * share) / (counts[:, 0] + PRIOR * (1 - share))
        return Evidence(*(np.log(odds) - np.log(share / (1 - share))).astype(np.float32))

    def inputs(self, found: list[str]) -> np.ndarray:
        """The network's inputs of each word: word and character evidence, whether the word is known, its length."""
        slot, grams = _slots(found)
        length = np.fromiter(map(len, found), np.int64, len(found))
        start = np.cumsum(length + 2) - length - 2
        columns, total = [self.words[slot]], np.zeros(len(found), np.float32)
        for at, inside in grams:
            value = np.where(inside, self.grams[at], 0)
            columns.append(np.maximum.reduceat(value, start))
            total += np.add.reduceat(value, start)
        columns += [total / (len(GRAMS) * (length + 2)), self.words[slot] != 0, np.log1p(length) / 3]
        return np.stack(columns, axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """Gated recurrent units in both directions, attention over their states, and a logistic output.

    Per direction: ``w`` (inputs to the gates r, z and the candidate), ``u`` (states to them) and ``b``.
    """

    weights: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 5) -> Network:
        draw = np.random.default_rng(seed)
        weights = {}
        for side in "fb":
            weights[f"w{side}"] = draw.normal(0, INPUTS**-0.5, (INPUTS, 3 * HIDDEN))
            weights[f"u{side}"] = draw.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
            weights[f"b{side}"] = np.zeros(3 * HIDDEN)
        weights |= {"a": draw.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "v": draw.normal(0, 0.3, HIDDEN)}
        weights |= {"o": draw.normal(0, 0.3, 2 * HIDDEN), "c": np.zeros(1)}
        return Network({k: x.astype(np.float32) for k, x in weights.items()})

    def _run(self, side: str, x: np.ndarray, real: np.ndarray, keep: list | None) -> np.ndarray:
        """States per step: ``x`` is (steps, windows, inputs); where ``real`` is 0 the state stays as it is."""
        w, u, b = (self.weights[k + side] for k in "wub")
        steps, n, _ = x.shape
        state, states = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            # one step's products are too small to be worth more than one thread
            given, inner = x[t] @ w + b, state @ u
            gates = _sigmoid(given[:, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:] * real[t][:, None]
            new = np.tanh(given[:, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, state, inner[:, 2 * HIDDEN :], r, gates[:, HIDDEN:], z, new))
            state = state + z * (new - state)
            states[t] = state
        return states

    def logits(self, x: np.ndarray, real: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """One number per window; a window without words has a context of zeros."""
        tapes = {side: [] if kept is not None else None for side in "fb"}
        h = np.concatenate([self._run(side, x, real, tapes[side]) for side in "fb"], axis=2)
        looked = np.tanh(h @ self.weights["a"])
        weight = np.where(real > 0, looked @ self.weights["v"], -1e9)
        weight = np.exp(weight - weight.max(axis=0)) * real
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        context = np.einsum("tn,tnh->nh", weight, h)
        if kept is not None:
            kept |= {"tapes": tapes, "h": h, "looked": looked, "weight": weight, "context": context}
        return context @ self.weights["o"] + self.weights["c"][0]

    def gradients(self, x: np.ndarray, real: np.ndarray, error: np.ndarray, kept: dict) -> dict[str, np.ndarray]:
        """Derivatives of the loss by the weights, from its derivatives by the logits, backwards through time."""
        p, h, looked, weight = self.weights, kept["h"], kept["looked"], kept["weight"]
        out = {"o": kept["context"].T @ error, "c": np.array([error.sum()])}
        d_context = error[:, None] * p["o"]
        d_h = weight[:, :, None] * d_context
        d_weight = np.einsum("tnh,nh->tn", h, d_context)
        d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
        out["v"] = np.einsum("tnk,tn->k", looked, d_weight)
        d_looked = d_weight[:, :, None] * p["v"] * (1 - looked**2)
        out["a"] = np.einsum("tnh,tnk->hk", h, d_looked)
        d_h += d_looked @ p["a"].T
        for number, side in enumerate("fb"):
            w, u = p["w" + side], p["u" + side]
            d_w, d_u, d_b, carried = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * HIDDEN), 0
            for t, state, inner, r, gate, z, new in reversed(kept["tapes"][side]):
                d_state = d_h[t, :, number * HIDDEN : (number + 1) * HIDDEN] + carried
                d_new = d_state * z * (1 - new**2)
                d_gate = d_state * (new - state) * real[t][:, None] * gate * (1 - gate)
                d_r = d_new * inner * r * (1 - r)
                d_given = np.concatenate([d_r, d_gate, d_new], axis=1)
                d_inner = np.concatenate([d_r, d_gate, d_new * r], axis=1)
                d_w += x[t].T @ d_given
                d_u += state.T @ d_inner
                d_b += d_given.sum(axis=0)
                carried = d_state * (1 - z) + d_inner @ u.T
            out |= {"w" + side: d_w, "u" + side: d_u, "b" + side: d_b}
        return out


@dataclass(frozen=True)
class Model:
    evidence: Evidence
    network: Network


def fit(x: np.ndarray, real: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray, updates: int = UPDATES) -> Network:
    """Train on windows (``x``: windows, steps, inputs) of rows with labels ``y``, by Adam on the logistic loss.

    A row is as toxic as its most toxic window, so each epoch learns from the window of each row that has the highest
    score at its beginning. Without rows nothing is learned; with one label the network learns to give that.
    """
    network = Network.new()
    if not len(y):
        return network
    steps = [{k: np.zeros_like(v, dtype=float) for k, v in network.weights.items()} for _ in range(2)]
    network.weights["c"][0] = np.log((weight @ y + 1) / (weight @ (1 - y) + 1))
    draw, count = np.random.default_rng(7), 0
    epochs = -(-updates // -(-len(y) // BATCH))

    def view(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[at].transpose(1, 0, 2).astype(np.float32), real[at].T.astype(np.float32)

    for epoch in range(epochs):
        scores = np.concatenate([network.logits(*view(np.arange(i, min(i + TOGETHER, len(x))))) for i in range(0, len(x), TOGETHER)])
        order = np.lexsort((-scores, row))
        chosen = order[np.flatnonzero(np.diff(row[order], prepend=-1))]  # the first of each row
        draw.shuffle(chosen)
        for first in range(0, len(chosen), BATCH):
            at, kept = chosen[first : first + BATCH], {}
            xs, rs = view(at)
            error = (_sigmoid(network.logits(xs, rs, kept)) - y[row[at]]) * weight[row[at]] / weight[row[at]].sum()
            count += 1
            rate = RATE * (1 - epoch / epochs) + RATE / 20
            for name, g in network.gradients(xs, rs, error.astype(np.float32), kept).items():
                m, v = (s[name] for s in steps)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                move = rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.999**count)) + 1e-6)
                network.weights[name] -= move.astype(np.float32)
    return network


def _windows(ids: np.ndarray) -> np.ndarray:
    """The overlapping windows of a text's word numbers, the last ones filled up with `PAD`; one for an empty text."""
    count = 1 + max(0, -(-(len(ids) - WINDOW) // STRIDE))
    padded = np.full((count - 1) * STRIDE + WINDOW, PAD, np.int32)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    key: str = "doc_id",
    text: str = "text",
    toxic_rows: int = TOXIC_ROWS,
    clean_rows: int = CLEAN_ROWS,
) -> Model:
    """Fit on at most ``toxic_rows`` and ``clean_rows`` labelled rows outside the held-out fold.

    Which rows is decided on the narrow label table, by the hash of the key; their list (under 1 MB) is broadcast to
    the scan of the texts. Their words and n-grams are counted by Spark in hashed slots. The rows are halved for that:
    the evidence that a row's windows are made with comes from the other half, so that the network learns how far
    evidence holds on texts that it did not come from. The windows that reach the driver are at most `WINDOWS_EACH` a
    row, those with the most evidence. Rows count so that both labels weigh as in all labelled rows.

    Labels other than 0 and 1 and rows without a key are left out; keys with several labels have the largest.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & F.col("key").isNotNull() & (fold("key", FOLDS) != HELD_OUT))
    known = known.groupBy("key").agg(F.max("y").alias("y"))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("key"), "key"]
    taken = [known.filter(F.col("y") == y).orderBy(*order).limit(n) for y, n in ((1, toxic_rows), (0, clean_rows))]
    taken = taken[0].unionByName(taken[1]).withColumn("half", F.pmod(F.hash(F.lit("half"), "key"), F.lit(2)))
    texts = docs.select(F.col(f"`{key}`").alias("key"), whole_text(text).alias("text"))
    sample = texts.join(F.broadcast(taken), "key").select("key", "y", "half", "text")

    def count(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 2, 2, SLOTS), np.int32)  # kind, label, half, slot
        for frame in stream:
            for y, half, value in zip(frame["y"], frame["half"], frame["text"]):
                seen = np.zeros((2, SLOTS), bool)
                for found in words(value):
                    if found:
                        slot, grams = _slots(list(set(found)))
                        seen[0, slot] = True
                        for at, inside in grams:
                            seen[1, at[inside]] = True
                for kind in (0, 1):
                    total[kind, y, half, np.flatnonzero(seen[kind])] += 1
        kind, slot = np.nonzero(total.sum(axis=(1, 2)))
        found = total[kind, :, :, slot].reshape(len(kind), 4)
        yield pd.DataFrame({"kind": kind, "slot": slot} | {name: found[:, i] for i, name in enumerate(sides)})

    sides = ["clean_0", "clean_1", "toxic_0", "toxic_1"]
    schema = "kind int, slot int, " + ", ".join(f"{name} int" for name in sides)
    counted = sample.mapInPandas(count, schema).groupBy("kind", "slot")
    # at most 2 * SLOTS rows of sums, whatever the texts
    sums = counted.agg(*(F.sum(name).cast("int").alias(name) for name in sides)).toArrow()
    rows = np.zeros((2, 2))
    for r in taken.groupBy("y", "half").agg(F.count("*").alias("n")).collect():
        rows[r["y"], r["half"]] = r["n"]
    counts = np.zeros((2, SLOTS, 4), np.float32)
    place = (sums.column("kind").to_numpy(), sums.column("slot").to_numpy())
    counts[place] = np.stack([sums.column(name).to_numpy() for name in sides], axis=1)
    counts = counts.transpose(0, 2, 1).reshape(2, 2, 2, SLOTS)  # kind, label, half, slot
    halves = [Evidence.of(counts[:, :, half], rows[:, half]) for half in (0, 1)]

    def cut(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in stream:
            out = []
            for k, y, half, value in zip(frame["key"], frame["y"], frame["half"], frame["text"]):
                found = [w for block in words(value) for w in block]
                names = list(dict.fromkeys(found))
                number = {w: i + 1 for i, w in enumerate(names)}
                table = np.zeros((len(names) + 1, INPUTS), np.float32)
                if names:
                    table[1:] = halves[1 - half].inputs(names)
                ids = _windows(np.fromiter((number[w] for w in found), np.int32, len(found)))
                said = np.sort(table[:, 0] + table[:, 1 : 1 + len(GRAMS)].max(axis=1))[0]
                value_of = np.maximum(table[:, : 1 + len(GRAMS)].max(axis=1), said)[ids].max(axis=1)
                for at in np.argsort(-value_of, kind="stable")[:WINDOWS_EACH].tolist():
                    window = table[ids[at]].astype(np.float16)
                    out.append((k, y, int((ids[at] != PAD).sum()), window.tobytes()))
            yield pd.DataFrame(out, columns=["key", "y", "size", "x"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, y int, size int, x binary"
    got = sample.mapInPandas(cut, schema).toArrow().to_pandas().sort_values(["key", "x"], kind="stable")
    numbers, row = np.unique(got["key"].to_numpy(), return_inverse=True)
    y = np.zeros(len(numbers))
    y[row] = got["y"]
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), WINDOW, INPUTS)
    real = np.arange(WINDOW)[None, :] < got["size"].to_numpy()[:, None]
    all_rows = sum(share.values())
    weight = np.where(y == 1, share.get(1, 0) / max(1, y.sum()), share.get(0, 0) / max(1, (1 - y).sum())) / max(1, all_rows)
    return Model(Evidence.of(counts.sum(axis=2), rows.sum(axis=1)), fit(x, real, row, y, weight * len(y)))


class _Scorer:
    """Scores texts; remembers the inputs of words."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number, self.table = {}, np.zeros((1, INPUTS), np.float32)

    def ids(self, found: list[str]) -> np.ndarray:
        number = self.number
        if new := list(set(found).difference(number)):
            first = len(number) + 1
            end = first + len(new)
            number.update(zip(new, range(first, end)))
            if end > len(self.table):  # twice as long, so that a row is copied a bounded number of times
                longer = np.zeros((max(end, 2 * len(self.table)), INPUTS), np.float32)
                longer[:first] = self.table[:first]
                self.table = longer
            self.table[first:end] = self.model.evidence.inputs(new)
        return np.fromiter(map(number.__getitem__, found), np.int32, len(found))

    def scores(self, texts: list[str]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        held, owner, size = [], [], 0
        for at, text in enumerate(texts):
            left = np.zeros(0, np.int32)  # words of the text that later windows still need
            done = False
            for found in words(text):
                ids = np.concatenate([left, self.ids(found)])
                whole = max(0, (len(ids) - WINDOW) // STRIDE)
                if whole > TOGETHER:  # a long text is scored on the way, up to its last window
                    cut = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[::STRIDE][:whole]
                    best[at] = max(best[at], self.logits(cut).max())
                    ids, done = ids[whole * STRIDE :], True
                left = ids
            if len(left) or not done:
                windows = _windows(left)
                held.append(windows)
                owner += [at] * len(windows)
                size += len(windows)
            if size >= TOGETHER or at == len(texts) - 1:
                if size:
                    np.maximum.at(best, owner, self.logits(np.concatenate(held)))
                held, owner, size = [], [], 0
                if len(self.number) > REMEMBERED:
                    self.forget()
        return _sigmoid(best)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for first in range(0, len(windows), TOGETHER):
            ids = windows[first : first + TOGETHER].T
            parts.append(self.model.network.logits(self.table[ids], (ids != PAD).astype(np.float32)))
        return np.concatenate(parts)


def score(model: Model, text: str = "text") -> Column:
    """The score of each whole text, 0 to 1: that of its most toxic window. Null texts count as empty."""

    def batches(stream: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(model)
        for texts in stream:
            yield pd.Series(scorer.scores(texts.tolist()) if len(texts) else [], dtype=float)

    return F.pandas_udf(lambda stream: batches(stream), "double", F.PandasUDFType.SCALAR_ITER)(whole_text(text))


def classify(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, held_out, score, predicted`` for every row of ``docs``, from all overlapping windows of its whole text.

    ``held_out`` marks the fold whose labels no model saw, ``predicted`` is 1 for scores of at least ``threshold``.
    Null texts and texts without letters have the score of a window without words. Rows with a null key are scored
    and counted as not held out; repeated rows get the same score each. Only the key and the text are read; an empty
    table gives an empty result.
    """
    held_out = F.coalesce(fold(key, FOLDS) == HELD_OUT, F.lit(False))
    scored = docs.select(F.col(f"`{key}`").alias(key), held_out.alias("held_out"), score(model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
