"""Collocations against counting every phrase one by one."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shopmill.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, print string"


def plain_counts(rows, longest=5):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        text, lang = re.sub("[A-Z]", lambda m: m[0].lower(), text or ""), lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, " ".join(words[i : i + n])) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    return counts, totals


def plain_collocations(rows, least, top):
    counts, totals = plain_counts(rows)
    frequent = {(lang, tuple(p.split(" "))): a for (lang, p), a in counts.items() if a >= least}
    out = []
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        inside = any(
            other == lang and len(longer) > len(words) and b == a
            and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
            for (other, longer), b in frequent.items()
        )
        if inside:
            continue
        cuts = [(1000 * a * totals[lang] // (frequent[lang, words[:k]] * frequent[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, frequent[lang, words[:k]], frequent[lang, words[k:]], totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    for row in out:
        ranks[row[0]] += 1
        if ranks[row[0]] <= top:
            yield (row[0], ranks[row[0]], *row[1:])


def texts(seed, n=120):
    draw = random.Random(seed)
    vocabulary = ["a", "Bb", "ccc", "é", "x y", "the", "of", "\xa0z", "Ü-1", "a b c"]
    gaps = [" ", "  ", "\t", ", ", ". ", "\n", " ", "\r\n", "\x0b"]
    made = ["".join(draw.choice(vocabulary) + draw.choice(gaps) for _ in range(draw.randrange(60))) for _ in range(n)]
    return [*made, None, "", " \t", ".", made[0], made[0]]


def docs(spark, values):
    rows = [(i if i % 7 else None, t, ["en", "de", None][i % 3], 1, "own", "own") for i, t in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


# with few bits most phrases share their fingerprint with others
@pytest.mark.parametrize("bits", [64, 9])
def test_collocations_equal_plain_version(spark, bits):
    table = docs(spark, texts(bits))
    rows = [(r.text, r.lang) for r in table.collect()]
    found = collocations.frequent_phrases(table, least=4, bits=bits)
    counts, totals = plain_counts(rows)
    got = {(r.lang, r.phrase): r.n for r in found.filter("words > 0").collect()}
    assert got == {p: n for p, n in counts.items() if n >= 4}
    assert {r.lang: r.n for r in found.filter("words = 0").collect()} == dict(totals)
    best = collocations.collocations(found, top=15).collect()
    assert sorted(tuple(r) for r in best) == sorted(plain_collocations(rows, 4, 15))


def test_long_texts_are_cut_between_pieces(monkeypatch):
    import pandas as pd

    values = [t or "" for t in texts(5)]
    frame = pd.DataFrame({"lang": "en", "mark": range(len(values)), "text": values})
    whole = pd.concat(collocations._tally((1, 2, 3), {})(iter([frame])))
    monkeypatch.setattr(collocations, "BLOCK", 40)
    monkeypatch.setattr(collocations, "HELD", 300)
    cut = pd.concat(collocations._tally((1, 2, 3), {})(iter([frame])))
    assert len(cut) > len(whole)
    assert cut.groupby("print").n.sum().to_dict() == whole.groupby("print").n.sum().to_dict()
    assert cut.groupby("print").mark.min().to_dict() == whole.groupby("print").mark.min().to_dict()


def test_tasks_hand_over_few_rows_at_a_time(monkeypatch):
    import pandas as pd

    values = [t or "" for t in texts(5)]
    frame = pd.DataFrame({"lang": "en", "mark": range(len(values)), "text": values})
    (whole,) = collocations._tally((1, 2, 3), {})(iter([frame]))
    monkeypatch.setattr(collocations, "ROWS", 50, raising=False)
    parts = list(collocations._tally((1, 2, 3), {})(iter([frame])))
    assert max(map(len, parts)) <= 50 < len(whole)
    assert pd.concat(parts, ignore_index=True).equals(whole)


def test_one_long_piece_and_empty_table(spark):
    table = docs(spark, ["in good faith " * 30_000])
    got = {r.phrase: (r.a, r.l, r.r) for r in collocations.collocations(collocations.frequent_phrases(table)).collect()}
    assert got["good faith in good faith"] == (29999, 30000, 29999) or "in good faith in good" in got
    none = collocations.frequent_phrases(docs(spark, ["x"]).filter(F.lit(False)))
    assert none.count() == 0 and collocations.collocations(none).count() == 0


def test_exact_where_products_pass_64_bits(spark):
    rows = [("en", 0, "", 9 * 10**15), ("en", 1, "a", 3 * 10**12), ("en", 1, "b", 3 * 10**12), ("en", 2, "a b", 2 * 10**12 + 1)]
    phrases = spark.createDataFrame(rows, "lang string, words int, phrase string, n long")
    (row,) = collocations.collocations(phrases).collect()
    assert row.score == 1000 * (2 * 10**12 + 1) * 9 * 10**15 // (9 * 10**24)
