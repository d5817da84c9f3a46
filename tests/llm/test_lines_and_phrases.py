"""Operators 11 and 12 against plain Python."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from corvine.llm import op11_lines as op11
from corvine.llm import op12_phrases as op12

from .helpers import ODD, SCHEMA, lower, words


# 11 ------------------------------------------------------------------------------------------------------------------
def brute_figures(text):
    """The contract's figures, window by window and line by line."""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def brute_lost(text):
    lost, seen = 0, []
    for line in (text or "").split("\n"):
        w = words(line)
        if not w:
            continue
        chars = "".join(w)
        symbols = sum(c in "#*$%&|<>" for c in chars)
        separators = sum(all(c in "|»›·•/<>" for c in x) and len(x.encode()) <= 8 for x in w)
        menu = sum(lower(x) in op11.MENU for x in w)
        bad = w[-1][-1] not in op11.ENDS or 10 * symbols > len(chars)
        bad |= (separators >= 2 and separators / len(w) >= 0.15) or 2 * menu >= len(w)
        bad |= line in seen or (len(w) <= 40 and any(p in lower(line) for p in op11.PHRASES))
        seen.append(line)
        lost += len(chars) if bad else 0
    return lost


def odd_texts():
    rng = random.Random(7)
    parts = ["one two three four five six.", "home | about | contact", "Click here for more.", "home search login.", "a b", "é😀 word.", "|||", "» ·", "x " * 60 + "cookie y.", "price $$$ %%% &&& now.", "\t", "the end. \r", "\x0b", "nbsp joins these.", "\x1c", "a | b | c d e f g h i j k l."]
    return [None, "", "\n", "word " * 30000 + "end.", *[rng.choice(["\n", "\n\n", " "]).join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]]


def test_figures_and_losses_equal_brute_force():
    for text in [*odd_texts(), *[r[1] for r in ODD]]:
        figures, _ = op11.judge(text)
        assert tuple(figures[:5]) == brute_figures(text) and figures[-1] == brute_lost(text), text


@pytest.mark.parametrize("distinct", [3, 40, 9000])
def test_repeated_windows_of_small_and_large_vocabularies(distinct):
    rng = random.Random(distinct)
    w = [str(rng.randrange(distinct)) for _ in range(12000 if distinct > 40 else 300)]
    w[100:120] = w[200:220]
    w[205:230] = w[206:231]
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = len({j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})
    assert op11.repeated_words([x.encode() for x in w]) == want > 0


def test_rules_and_cleaned_text(spark):
    good = "This is a sentence of quite some words that says something."
    other = "Another one stands here for itself and goes on for long!"
    text = f"Home | About | Contact\n{good}\n\nAll rights reserved.\nno end here\nA short one.\nA short one.\n{other}"
    rows = spark.createDataFrame([(1, text, "x"), (2, good, "x"), (2, None, "x"), (3, "Home | About\n" * 9 + good, "x")], "doc_id int, text string, KEPT string")
    got = {(r["doc_id"], r["text"]): r for r in op11.clean_lines(rows).collect()}
    r = got[1, text]
    assert (r["n_punctuation"], r["n_navigation"], r["n_boilerplate"], r["kept"]) == (2, 0, 2, True)
    assert r["cleaned"] == f"{good}\n\nA short one.\n{other}"
    assert got[2, good]["kept"] and got[2, good]["cleaned"] == good and not got[2, None]["kept"] and got[2, None]["cleaned"] is None
    assert not got[3, "Home | About\n" * 9 + good]["kept"] and got[3, "Home | About\n" * 9 + good]["cleaned"] == good
    assert op11.judge("a » b » c » d.")[0][7] == 1 and op11.judge("Next page.")[0][7] == 1


def test_clean_documents_stay(spark, sf):
    """Of documents that the fixed rules leave, the good ones stay and the others go."""
    d = "/root/testdata/sf0.01"
    rows = op11.op11_line_rules(spark, d).where("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("quality", "toxic", "kept").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.995 * len(good) > 100 and sum(bad) <= 0.05 * len(bad) and bad


# 12 ------------------------------------------------------------------------------------------------------------------
def brute_phrases(rows, max_n, least, most):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], a)
    found = {}
    for (lang, p), a in candidates.items():
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if 100 * inside[lang, p] < 50 * a:
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, some in found.items() for i, (s, a, p, l, r) in enumerate(sorted(some)[:most], 1))


def made_rows(n, seed, langs=("en", "en", "en", None, "und", "", "é f")):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "É", "zz", "x y", "\x1c", "0", "new", "york", "city"]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choice([*vocabulary, "the", "new york city", "of the", ".", ",\t", "\n", "!", "\r\n"]) for _ in range(rng.randrange(80)))
        rows.append((rng.choice(langs), rng.choice([text, text, text, None, ""])))
    return rows


@pytest.mark.parametrize("flush,max_n,least,most", [(200, 3, 3, 2000), (1 << 20, 3, 2, 7), (500, 4, 2, 50), (300, 2, 1, 2000)])
def test_phrases_equal_brute_force(spark, monkeypatch, flush, max_n, least, most):
    """Small tasks and many ranges, so that nearly every first word reaches over borders."""
    monkeypatch.setattr(op12, "FLUSH", flush)
    monkeypatch.setattr(op12, "PER_BORDER", 4)
    rows = made_rows(150, flush)
    df = spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, RANK int").repartition(3)
    got = op12.collocations(df, max_n, least, most)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, max_n, least, most)


def test_a_word_that_is_most_of_the_corpus_lies_in_many_ranges(spark):
    rng = random.Random(2)
    rows = [("en", " ".join(x for _ in range(40) for x in ("the", f"w{rng.randrange(500)}"))) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    texts = df.selectExpr("lang", "cast(text as binary) as text")
    borders = op12.find_borders(texts, 40000, 3)
    own = [b for b in borders if b[1] == b"the"]
    assert len(own) >= 3
    dealt = op12.dealt(texts, borders, 3).select("range").distinct().count()
    assert dealt >= len(borders) // 2
    assert sorted(map(tuple, op12.collocations(df, 3, 2, 100).collect())) == brute_phrases(rows, 3, 2, 100)


def test_exact_scores_beyond_64_bits(spark, tmp_path):
    """Counts as of a corpus of 10^13 words go through the same joins."""
    big = 4_000_000_000_000
    counts = [("en", "", 0, 3 * big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 3), ("en", "a b", 2, big - 7)]
    frame = spark.createDataFrame(counts, "lang string, phrase string, size int, f long")
    real = op12.phrase_counts
    op12.phrase_counts = lambda docs, max_n, least: frame
    try:
        got = op12.collocations(frame).collect()
    finally:
        op12.phrase_counts = real
    assert [(r["a"], r["score"]) for r in got] == [(big - 7, 10**6 * (big - 7) ** 2 // ((big + 1) * (big + 3)))]


def test_packing_and_dense_numbers():
    import numpy as np

    rng = np.random.default_rng(1)
    for most in (1, 200, 70000, 1 << 40):
        x = rng.integers(0, most, 1000)
        assert (op12.unpack(op12.pack(x)) == x).all()
    assert len(op12.unpack(op12.pack(np.zeros(0, np.int64)))) == 0
    rows = rng.integers(0, 5, (400, 4)) * 400_000_000
    got, n = op12.summed(rows, np.ones(400, np.int64), 2_000_000_000)
    want = sorted(Counter(map(tuple, rows.tolist())).items())
    assert [(tuple(r), c) for r, c in zip(got.tolist(), n.tolist())] == want


def test_odd_documents(spark, tmp_path):
    spark.createDataFrame(ODD, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12.op12_collocations(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == brute_phrases([(r[2], r[1]) for r in ODD], 3, 10, 2000)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12.op12_collocations(spark, f"{tmp_path}/none").count() == 0
    assert pa.schema(op12.PACKED)
