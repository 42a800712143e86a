"""Evaluation texts leaking into a corpus.

Method: numbers, names, units and identifiers become typed placeholders; windows of the
resulting template words are hash-joined between the test items and the corpus; for every
document and item with enough shared windows the words are aligned in a band around each run
they share, and the slots behind the placeholders are held against each other: a passage whose
slots agree is a copy, one whose template agrees under a consistent change of slots is a
re-parameterised question.

Case tells nothing about a copy, so a name is what the items themselves write with a capital
within a sentence, in any case it has in the corpus; for other names a text is also looked up
with its own capitalised words as names.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import Scratch

PASSAGE = 15  # consecutive words of an item that make a leak
EDITS = 10  # one word in so many may be replaced, dropped or added
#: Words of a window. A passage of n >= 15 words with n // 10 edits has an unbroken run of at
#: least 7 words, and its windows of 6 number at least 3: no leak can escape the join.
WINDOW, SHARED = 6, 3
PLACE = 128  # words of a block by which places of hits are kept, so that long documents are aligned piece by piece
#: Words, so windows, of test items in one broadcast (about 16 bytes each, their names as much again); more items are met in blocks.
BLOCK_WINDOWS = 1_000_000

# Words of measure that count as units after a number.
UNITS = {"%", "ms", "s", "sec", "secs", "second", "seconds", "min", "mins", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "kb", "mb", "gb", "tb", "usd", "eur", "gbp", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "mile", "miles", "meter", "meters", "metre", "metres", "inch", "inches", "foot", "feet", "pound", "pounds"}

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|code|font|mark|small|sub|sup|tt)(?:\s[^<>]*)?>", re.I)
_BLOCK = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_TARGET = re.compile(r"\]\([^()\s]*\)")
_WRAPPED = re.compile(r"(?<=\w)[-‐]\n[ \t]*(?:[#>*/|]+[ \t]*)?(?=\w)")
_MARKS = re.compile(r"[\W_]+")


def plain_text(text: str) -> str:
    """Text without markup, entities, invisible characters and broken words."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "<" in text:
        text = _BLOCK.sub(" ", _INLINE.sub("", text))
    if "](" in text:
        text = _TARGET.sub("] ", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if "-\n" in text or "‐\n" in text:
        text = _WRAPPED.sub("", text)
    return text


def word_of(token: str) -> str:
    """A token in lower case without punctuation; an identifier is one word."""
    return _MARKS.sub("", token).casefold()


def template_of(token: str) -> str:
    """The typed placeholder of a number, name or unit, else the word."""
    word = word_of(token)
    if not word:
        return ""
    if word.isdigit():
        return "\x01n"
    core = token.strip("*`'\"()[]{}.,;:!?#>")
    if "_" in core.strip("_") or (any(c.isdigit() for c in word) and not word[0].isdigit()):
        return "\x01i"
    return "\x01u" if word in UNITS else word


NAME = "\x01p"


def is_capital(token: str) -> bool:
    """True for a word written like a name: one capital, then small letters."""
    core = token.strip("*`'\"()[]{}.,;:!?#>«»“”„")
    return len(core) > 1 and core[0].isupper() and core[1:].islower() and core.isalpha()


def ends_sentence(token: str) -> bool:
    return token.rstrip("*`'\")]}»”")[-1:] in (".", "!", "?", ":", "。")


def mid_capitals(tokens: list[str]) -> list[bool]:
    """For each token whether it is written like a name within a sentence."""
    return [i > 0 and is_capital(t) and not ends_sentence(tokens[i - 1]) for i, t in enumerate(tokens)]


def templates(tokens: list[str], names: set[str]) -> list[str]:
    """The template words of tokens, names being those of the items and words written like one."""
    out = []
    for t, cap in zip(tokens, mid_capitals(tokens)):
        x = template_of(t)
        out.append(NAME if x[:1] != "\x01" and (cap or x in names) else x)
    return out


class _Codes(dict):
    """Token to (hash of its template word, known names replaced), 0 where nothing is left of it."""

    def __init__(self, names: set[str]):
        super().__init__()
        self.names = names

    def __missing__(self, token: str) -> int:
        t = template_of(token)
        code = _code(NAME if t in self.names else t)
        if len(self) > 500_000:
            self.clear()
        self[token] = code
        return code


class _Shapes(dict):
    """Token to 1 if it is written like a name and can become one, plus 2 if a sentence ends with it."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = v = (is_capital(token) and template_of(token)[:1] != "\x01") + 2 * ends_sentence(token)
        return v


def _code(t: str) -> int:
    code = 0
    for ch in t.encode():
        code = ((code ^ ch) * 1099511628211 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return code or int(bool(t))


def _windows(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WINDOW codes."""
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(WINDOW):
        h = (h ^ codes[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _tokens(text: str | None) -> list[str]:
    """The tokens of a text that hold a word."""
    return [t for t in plain_text(text).split() if word_of(t)] if text else []


def _item_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(i, _tokens(t)) for i, t in zip(batch["item_id"], batch["text"])], columns=["item_id", "itokens"])


def _item_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of items by whether they are written like a name within a sentence."""
    for batch in batches:
        seen = {(word_of(t), cap) for tokens in batch["itokens"] for t, cap, first in zip(tokens, mid_capitals(list(tokens)), range(len(tokens))) if cap or (first and t[:1].islower())}
        yield pd.DataFrame(sorted(seen), columns=["word", "name"])


def _item_windows(names: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Codes(names)
        for batch in batches:
            rows = []
            for item, tokens in zip(batch["item_id"], batch["itokens"]):
                codes = np.fromiter((cache[t] for t in tokens), dtype=np.uint64, count=len(tokens))
                rows.append((item, list(tokens), _windows(codes).tolist()))
            yield pd.DataFrame(rows, columns=["item_id", "itokens", "hs"])

    return run


def _probe(sent):
    """Documents with at least SHARED windows among the sorted hashes of sent (hashes, names): their tokens, windows and places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, names = sent.value
        cache, shapes, name = _Codes(names), _Shapes(), np.uint64(_code(NAME))

        def met(h: np.ndarray) -> np.ndarray:
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            return np.flatnonzero(known[at] == h)

        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                tokens = plain_text(text).split() if text else []
                codes = np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
                real = codes != 0
                if np.count_nonzero(real) < PASSAGE - 1 or not len(known):
                    continue
                shape = np.fromiter(map(shapes.__getitem__, tokens), dtype=np.int8, count=len(tokens))[real]
                codes = codes[real]
                h = _windows(codes)
                hit = met(h)
                hs, ps = h[hit], hit
                like = (shape & 1).astype(bool)
                like[0] = False
                like[1:] &= ~(shape[:-1] >= 2)
                if like.any():  # once more with the text's own names as names
                    other = _windows(np.where(like, name, codes))
                    more = met(other)
                    more = more[other[more] != h[more]]
                    hs, ps = np.concatenate([hs, other[more]]), np.concatenate([ps, more])
                if len(hs) >= SHARED:
                    rows.append((doc, [t for t, r in zip(tokens, real) if r], hs.tolist(), ps.tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "dtokens", "hs", "ps"])

    return run


def _reach(item: list[str], doc: list[str], most: int) -> list[int]:
    """For 0 to `most` edits the words of item, from its start, that an alignment with the start of doc covers up to a match."""
    far = most + 1
    reach = [0] * far
    row = {j: j for j in range(min(most, len(doc)) + 1)}  # edits by words of doc, at the words of item so far
    for i in range(1, len(item) + 1):
        last, row = row, {}
        for j in range(max(0, i - most), min(len(doc), i + most) + 1):
            if j and item[i - 1] == doc[j - 1]:
                d = last.get(j - 1, far)
                if d < far:
                    reach[d] = i
            else:
                d = 1 + min(last.get(j - 1, far), last.get(j, far), row.get(j - 1, far))
            if d < far:
                row[j] = d
        if not row:
            break
    return list(itertools.accumulate(reach, max))


def shared_passage(doc: list[str], item: list[str]) -> tuple[int, int]:
    """(words of the item, edits) of its longest passage in doc with no more than one edit in EDITS words; (0, 0) if none reaches PASSAGE.

    Every unbroken run of WINDOW words, which no passage lacks, is extended to both sides from its first and its last window.
    """
    most = len(item) // EDITS
    at: dict[tuple[str, ...], list[int]] = {}
    for a in range(len(item) - WINDOW + 1):
        at.setdefault(tuple(item[a : a + WINDOW]), []).append(a)
    best = (0, 0)
    for b in range(len(doc) - WINDOW + 1):
        for a in at.get(tuple(doc[b : b + WINDOW]), ()):
            if a and b and item[a - 1] == doc[b - 1]:
                continue  # within a run that was met before
            size = WINDOW
            while a + size < len(item) and b + size < len(doc) and item[a + size] == doc[b + size]:
                size += 1
            if size == len(item) >= PASSAGE:
                return size, 0
            for c in {0, size - WINDOW}:  # words repeated at the end of a run may as well belong to what follows an edit
                x, y = a + c, b + c
                left = _reach(item[:x][::-1], doc[max(0, y - x - most) : y][::-1], most)
                right = _reach(item[x + WINDOW :], doc[y + WINDOW : y + len(item) - x + most], most)
                for i, j in itertools.product(range(most + 1), repeat=2):
                    length = left[i] + WINDOW + right[j]
                    if length >= PASSAGE and i + j <= length // EDITS:
                        best = max(best, (length, i + j), key=_rank)
    return best


def _rank(passage: tuple[int, int]) -> tuple[int, int]:
    """Longer passages first, then those with fewer edits."""
    return passage[0], -passage[1]


def _walk(item: list[str], doc: list[str], most: int) -> tuple[list[tuple[int, tuple[int, int]]], dict]:
    """_reach with the cell that each reach ends in, and for every cell of the band the one before it."""
    far = most + 1
    cost, back = {(0, j): j for j in range(min(most, len(doc)) + 1)}, {(0, j): (0, j - 1) for j in range(1, min(most, len(doc)) + 1)}
    reach: list[tuple[int, tuple[int, int]]] = [(0, (0, 0))] * far
    for i in range(1, len(item) + 1):
        for j in range(max(0, i - most), min(len(doc), i + most) + 1):
            same = j > 0 and item[i - 1] == doc[j - 1]
            ways = [(cost.get((i - 1, j - 1), far) + (not same), (i - 1, j - 1)), (cost.get((i - 1, j), far) + 1, (i - 1, j)), (cost.get((i, j - 1), far) + 1, (i, j - 1))]
            d, before = ways[0] if same else min(ways)
            if d < far:
                cost[i, j], back[i, j] = d, before
                if same and i > reach[d][0]:
                    reach[d] = (i, (i, j))
    for d in range(1, far):
        reach[d] = max(reach[d], reach[d - 1])
    return reach, back


def _matches(cell: tuple[int, int], back: dict, item: list[str], doc: list[str]) -> list[tuple[int, int]]:
    out = []
    while cell in back:
        before = back[cell]
        if before == (cell[0] - 1, cell[1] - 1) and item[cell[0] - 1] == doc[cell[1] - 1]:
            out.append((cell[0] - 1, cell[1] - 1))
        cell = before
    return out


def reparameterised(doc_tokens: list[str], item_tokens: list[str], names: set[str] = frozenset()) -> bool:
    """True if a passage has the item's template and its slots (numbers, names, units, identifiers) were changed consistently: equal slots stay equal.

    The templates are aligned in a band around every run of WINDOW template words they share,
    with at most one edit in EDITS. The passage needs PASSAGE words, half of them outside slots, and more
    changed slots than a copy may have edits.
    """
    item, doc = templates(item_tokens, names), templates(doc_tokens, names)
    iwords, dwords = [word_of(t) for t in item_tokens], [word_of(t) for t in doc_tokens]
    most = len(item) // EDITS
    at: dict[tuple[str, ...], list[int]] = {}
    for a in range(len(item) - WINDOW + 1):
        at.setdefault(tuple(item[a : a + WINDOW]), []).append(a)
    for b in range(len(doc) - WINDOW + 1):
        for a in at.get(tuple(doc[b : b + WINDOW]), ()):
            if a and b and item[a - 1] == doc[b - 1]:
                continue  # within a run that was met before
            size = WINDOW
            while a + size < len(item) and b + size < len(doc) and item[a + size] == doc[b + size]:
                size += 1
            before = (item[:a][::-1], doc[max(0, b - a - most) : b][::-1])
            after = (item[a + size :], doc[b + size : b + len(item) - a + most])
            left, lback = _walk(*before, most)
            right, rback = _walk(*after, most)
            fits = [(left[i][0] + size + right[j][0], -i - j, i, j) for i, j in itertools.product(range(most + 1), repeat=2)]
            fits = [f for f in fits if f[0] >= PASSAGE and -f[1] <= f[0] // EDITS]
            if not fits:
                continue
            length, _, i, j = max(fits)
            pairs = [(a - 1 - x, b - 1 - y) for x, y in _matches(left[i][1], lback, *before)] + [(a + k, b + k) for k in range(size)] + [(a + size + x, b + size + y) for x, y in _matches(right[j][1], rback, *after)]
            slots: dict[tuple[str, str], str] = {}
            changed = consistent = plain = 0
            for x, y in pairs:
                if item[x][0] != "\x01":
                    plain += 1
                    continue
                consistent += slots.setdefault((item[x], iwords[x]), dwords[y]) == dwords[y]
                changed += iwords[x] != dwords[y]
            if consistent == len(pairs) - plain and plain >= PASSAGE // 2 and changed * EDITS > length:
                return True
    return False


def stretches(places: list[int], item_words: int) -> list[tuple[int, int]]:
    """Word ranges (from, to) around sorted blocks of PLACE words with hits; blocks further apart than the item is long fall into different ranges."""
    out: list[list[int]] = []
    for p in places:
        lo, hi = p * PLACE - item_words, (p + 1) * PLACE + WINDOW + item_words
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([max(0, lo), hi])
    return [(a, b) for a, b in out]


def _verify(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = sent.value[1]
        for batch in batches:
            rows, last, dwords = [], None, []
            for doc, item, dtokens, itokens, places in zip(batch["doc_id"], batch["item_id"], batch["dtokens"], batch["itokens"], batch["places"]):
                if last is not dtokens:
                    last, dwords = dtokens, [word_of(t) for t in dtokens]
                itokens = list(itokens)
                iwords = [word_of(t) for t in itokens]
                best, changed = (0, 0), False
                ranges = stretches([int(p) for p in places], len(iwords) + len(iwords) // EDITS)
                for lo, hi in ranges:
                    best = max(best, shared_passage(dwords[lo:hi], iwords), key=_rank)
                if not best[0]:
                    changed = any(reparameterised(list(dtokens[lo:hi]), itokens, names) for lo, hi in ranges)
                if best[0] or changed:
                    rows.append((doc, item, *best, "copy" if best[0] else "reparameterised"))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "edits", "kind"])

    return run


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words, edits, kind) of the items of items(item_id, text) found in docs(doc_id, text).

    kind is copy (a passage of PASSAGE words with at most one edit in EDITS) or
    reparameterised. Null and empty texts hold and leak nothing; items with less than PASSAGE
    words can't leak; rows without id are left out; repeated doc_ids give their rows once.
    """
    spark: SparkSession = docs.sparkSession
    tmp = Scratch(spark, "leakage")
    item_rows = items.where("item_id is not null").select("item_id", "text").mapInPandas(_item_tokens, "item_id int, itokens array<string>")
    item_rows = tmp.save(item_rows, "items")
    sizes = item_rows.agg(F.sum(F.size("itokens")).alias("n")).first().n or 0
    blocks = max(1, -(-sizes // BLOCK_WINDOWS))
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for b in range(blocks):  # one block unless the items have over BLOCK_WINDOWS words
        some = item_rows.where(part == b)
        written = some.mapInPandas(_item_names, "word string, name boolean").groupBy("word").agg(F.min("name").alias("name")).where("name")
        names = {r.word for r in written.select("word").collect()}
        some = tmp.save(some.mapInPandas(_item_windows(names), "item_id int, itokens array<string>, hs array<long>"), "windows")
        windows = some.select("item_id", F.posexplode("hs").alias("ip", "h"))
        known = np.unique(np.array([r.h for r in windows.select("h").distinct().collect()], dtype=np.int64))
        sent = spark.sparkContext.broadcast((known, names))
        probed = tmp.save(texts.mapInPandas(_probe(sent), "doc_id long, dtokens array<string>, hs array<long>, ps array<int>"), "probed")
        hits = probed.select("doc_id", F.explode(F.arrays_zip("hs", "ps")).alias("x")).select("doc_id", F.col("x.hs").alias("h"), F.floor(F.col("x.ps") / PLACE).alias("place")).distinct()
        pairs = hits.join(F.broadcast(windows), "h").groupBy("doc_id", "item_id").agg(F.countDistinct("ip").alias("n"), F.array_sort(F.collect_set("place")).alias("places")).where(F.col("n") >= SHARED)
        cands = tmp.save(pairs, "pairs").join(probed.select("doc_id", "dtokens"), "doc_id").join(F.broadcast(some.select("item_id", "itokens")), "item_id")
        rows = cands.mapInPandas(_verify(sent), "doc_id long, item_id int, words int, edits int, kind string")
        found = rows if found is None else found.unionByName(rows)
    tmp.keep_only("windows", "probed", "pairs")
    return found.distinct()


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    got = leaked_items(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/eval_items.parquet"))
    return got.where("kind = 'copy'").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Copies and re-parameterised items with the length and edits of their passage."""
    return leaked_items(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/eval_items.parquet"))
