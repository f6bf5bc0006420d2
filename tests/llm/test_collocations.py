"""Collocations: against SQL and a plain count of all phrases, with prefixes cut at every depth."""

import re
from collections import Counter

import numpy as np
from compare import connect, rows

from skyweave.llm import collocations, queries
from skyweave.llm.sql import ORACLES

FOLDER = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = np.random.default_rng(12)


def plain(table: list, least: int, top: int) -> list:
    total, counts = Counter(), Counter()
    for lang, text in table:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(ws)
            counts.update((lang or "und", tuple(ws[i : i + m])) for m in range(1, 6) for i in range(len(ws) - m + 1))
    phrases = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, ws), a in phrases.items():
        if any(x == lang and b >= a and any(longer[i : i + len(ws)] == ws for i in range(len(longer) - len(ws) + 1)) for (x, longer), b in phrases.items() if len(longer) > len(ws)):
            continue
        n = total[lang]
        score, _, left, right = min((1000 * a * n // (counts[lang, ws[:k]] * counts[lang, ws[k:]]), k, counts[lang, ws[:k]], counts[lang, ws[k:]]) for k in range(1, len(ws)))
        out.append((lang, -score, -a, " ".join(ws).encode(), left, right, n))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


def found(docs, least: int, top: int) -> list:
    return sorted(map(tuple, collocations.collocations(docs, least, top).collect()))


def table_of_texts() -> list:
    """Skewed words, a passage that most texts share, and one pair that is everywhere."""
    words = ["the", "of", "É", "zu", *(f"w{i}" for i in range(30))]
    share = 1 / np.arange(1, len(words) + 1)
    out = []
    for i in range(120):
        text = " ".join(RNG.choice(words, 60, p=share / share.sum()))
        text = text.replace(" w3 ", ". W3 ").replace(" w5 ", ",\tw5 ").replace(" w7 ", "\nw7\r")
        out.append((["en", "de", None][i % 3], text + (" a b c d e f g a b c d e" if i % 4 else "") + " x y" * 30))
    return [*out, out[0], out[0], ("en", None), ("en", ""), (None, " ,. "), ("und", "x y " * 9), ("fr", "q" * 50_000 + " x y")]


def test_against_sql(spark):
    got, want = queries.QUERIES["op12_collocations"](spark, FOLDER).toPandas(), connect(FOLDER).execute(ORACLES["op12_collocations"]).df()
    assert len(got) > 50 and rows(got) == rows(want)


def test_subtrees_cut_at_every_depth(spark, monkeypatch):
    table = table_of_texts()
    docs = spark.createDataFrame([(*r, None, 3, 1) for r in table], "lang string, text string, w1 string, n int, doc_id long").repartition(6)
    want = plain(table, 4, 40)
    for budget in (200_000, 6):
        monkeypatch.setattr(collocations, "GROUP_ROWS", budget)
        assert found(docs, 4, 40) == want
    assert found(docs.limit(0), 4, 40) == []


def test_rows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "mixed", lambda columns: columns[0] & np.uint64(1))
    a, b = RNG.integers(0, 4, 200).astype(np.uint64), RNG.integers(0, 4, 200).astype(np.uint64)
    pick, n = collocations.combined([a, b])
    assert {(int(a[i]), int(b[i])): int(k) for i, k in zip(pick, n)} == Counter(zip(a.tolist(), b.tolist()))


def test_tables_hold_what_they_were_given(spark):
    keys = RNG.integers(-(2**63), 2**63 - 1, 5000)
    table = collocations.table_of(spark.createDataFrame([(int(k),) for k in keys], "k long"), collocations.F.col("k"))
    assert table.may_hold(keys.view(np.uint64)).all()
    assert table.may_hold(RNG.integers(0, 2**64 - 1, 5000, dtype=np.uint64)).mean() < 0.01
