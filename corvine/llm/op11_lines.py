"""Operator 11, quality rules: line-first cleaning.

Every line (between line feeds) with a word is judged by itself, in this order:
  punctuation  its last character is none that ends a sentence or a quotation, or more than a tenth of its characters are symbols;
  navigation   at least two words, and 15 % of all, are separators alone, or half of its words name parts of a menu;
  boilerplate  it equals an earlier line of the text, or has SHORT words at most and a phrase that pages carry around their texts.
Lines that fail go; a text that loses more than MAX_LOST % of the code points in its words with them is rejected. ``clean_lines`` gives
the lines that stay (and lines without a word between them) as a column, and what each rule took.

Beside them stand figures of the whole text: words, their code points, symbols, repeated lines, and the words within five-word windows that
occur twice or more. Texts with fewer than MIN_WORDS words or with more than MAX_REPEAT % of such words fail whatever their lines are.

Scale: one pass, nothing is shuffled; a task holds a few texts of a batch with the numbers of their words. Windows are compared as exact numbers, not as hashes.

Defined results: a null text is an empty text, whose cleaned text is null; it has no words, so it fails; each row is judged by itself, so repeated rows and ids have equal results;
a null id is carried along; texts of any length are read whole; other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append_columns, table

WINDOW = 5
MIN_WORDS, MAX_REPEAT, MAX_LOST, SHORT = 10, 20, 60, 40
#: Symbols of the contract, and what the rules look for.
SYMBOLS = "#*$%&|<>"
ENDS = [".", "!", "?", "…", '"', "'", "”", "’", ")", "]", "»", "。", "！", "？"]
SEPARATORS = "|»›·•/<>"
MENU = "home menu login logout register search contact about next previous sitemap help faq share print back archive categories tags startseite suche kontakt impressum accueil recherche inicio buscar contacto".split()
PHRASES = ["cookie", "javascript", "lorem ipsum", "all rights reserved", "copyright", "licensed under", "released under", "privacy policy", "terms of use", "terms of service", "sign up", "subscribe", "newsletter", "click here", "read more", "powered by"]

END_BYTES = tuple(c.encode() for c in ENDS)
SYMBOL_BYTES = SYMBOLS.encode()
SEPARATOR_WORD = re.compile("[" + re.escape(SEPARATORS) + "]+")
MENU_BYTES = frozenset(w.encode() for w in MENU)
PHRASE = re.compile("|".join(PHRASES).encode())
RULES = ("punctuation", "navigation", "boilerplate")


def failed_rule(line: bytes, words: list[bytes], seen: set[bytes]) -> int | None:
    """The first rule that a line (with these words) fails; ``seen`` are the earlier lines."""
    whole = b"".join(words)
    if not words[-1].endswith(END_BYTES):
        return 0
    symbols = len(whole) - len(whole.translate(None, SYMBOL_BYTES))
    if symbols and 10 * symbols > len(whole.decode()):
        return 0
    n = len(words)
    separators = sum(SEPARATOR_WORD.fullmatch(w.decode()) is not None for w in words if len(w) <= 8)
    if separators >= 2 and 100 * separators >= 15 * n:
        return 1
    if 2 * sum(w.lower() in MENU_BYTES for w in words) >= n:
        return 1
    if line in seen or (n <= SHORT and PHRASE.search(line.lower())):
        return 2
    return None


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    number = dict(zip(words, range(n), strict=True))
    code = np.fromiter(map(number.__getitem__, words), np.int64, n)
    if width * n.bit_length() < 63:
        windows = sum((code[i : n - width + 1 + i] << i * n.bit_length() for i in range(1, width)), code[: n - width + 1])
    else:  # numbers of windows one word longer at a time
        windows = code
        for i in range(1, width):
            windows = np.unique(windows[: n - i] * np.int64(n) + code[i:], return_inverse=True)[1]
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    if not same.any():
        return 0
    change = np.zeros(n + 1, np.int64)
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    change[starts] += 1
    change[starts + width] -= 1
    return int((np.cumsum(change) > 0).sum())


def judge(text: str | None, cleaned: bool = False) -> tuple[list[int], str | None]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, lines lost to each rule, word code points lost; and the text without those lines."""
    data = (text or "").encode()
    words, seen, lost, stays = [], set(), [0, 0, 0], []
    n_lines = n_dup = lost_chars = 0
    for line in data.split(b"\n"):
        own = line.split()
        if own:
            n_lines += 1
            n_dup += line in seen
            rule = failed_rule(line, own, seen)
            seen.add(line)
            words += own
            if rule is not None:
                lost[rule] += 1
                lost_chars += len(b"".join(own).decode())
                continue
        if cleaned:
            stays.append(line)
    symbols = len(data) - len(data.translate(None, SYMBOL_BYTES))
    figures = [len(words), len(b"".join(words).decode()), symbols, n_dup, repeated_words(words), n_lines, *lost, lost_chars]
    return figures, b"\n".join(stays).decode() if cleaned and text is not None else None


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", *[f"n_{r}" for r in RULES], "lost_chars")


def clean_lines(docs: DataFrame, text: str = "text", cleaned: str | None = "cleaned") -> DataFrame:
    """docs with the figures NAMES, base_failed, kept and, unless it is None, the column ``cleaned``. Columns of these names give way."""
    fields = [T.StructField(n, T.LongType()) for n in NAMES] + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")] + ([T.StructField(cleaned, T.StringType())] if cleaned else [])

    def make():
        def run(texts):
            made = [judge(t.as_py(), cleaned is not None) for t in texts]
            columns = [list(c) for c in zip(*[f for f, _ in made], strict=True)] if made else [[] for _ in NAMES]
            by = dict(zip(NAMES, columns, strict=True))
            failed = [n < MIN_WORDS or 100 * r > MAX_REPEAT * n for n, r in zip(by["n_words"], by["n_repeat_words"], strict=True)]
            kept = [not f and 100 * x <= MAX_LOST * all_ for f, x, all_ in zip(failed, by["lost_chars"], by["word_chars"], strict=True)]
            return [*columns, failed, kept, *([[c for _, c in made]] if cleaned else [])]

        return run

    return append_columns(docs, [text], fields, make)


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs, cleaned=None).select("doc_id", *NAMES, "base_failed", "kept")
