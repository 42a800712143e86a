"""Keyword-stuffed pages and link lists.

Method: words and neighbouring pairs are counted over the whole corpus, and every passage of
every page gets the mean pointwise mutual information (PMI) of its neighbours. What is too
little for language is read off the corpus itself: far below the lower quantiles of the passages
of all pages, an upper quantile for strings of short items, whose neighbours have to
belong together like set phrases to be more than tags. Pairs that a page repeats beyond what the
corpus lets expect are excessive collocations. A passage counts as stuffing if it is a list of
links without explanations, repeats its collocations, or is incoherent by its PMI. A page is
reported if more than half of its words stand in such passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.runtime import Scratch

CHUNK = 24  # words of a passage that is judged as a whole
BLOCK = 600_000  # words whose passages and pairs are judged together
#: A pair is an excessive collocation of a page if it stands there at least so often, for this share of the page's words, and beats what the rest of the corpus lets expect by so many nats of a Poisson count.
REPEATED, REPEATED_SHARE, SURPRISE = 3, 0.008, 2.0
#: A passage whose words stand in such pairs for this part, and of which no more than this part are different words, is stuffing; looser with short items.
COVER, VARIETY = 0.5, 0.54
COVER_LIST, VARIETY_LIST, LIST_WORDS = 0.55, 0.8, 5.3
ITEM_WORDS, ITEMS = 3.4, 5  # mean words and number of items that make a passage a string of items
SMOOTH = 0.5  # added to the counts of words and pairs
#: By the mean PMI of all passages that aren't stuffing or items by themselves, any passage is word salad that lies so many times the distance from quartile to median below the median (a quarter of salad in the corpus doesn't move that), and a string of items is under this quantile.
SALAD_SPREAD, ITEMS_QUANTILE = 6.0, 0.85
#: What the two limits are taken to be before any passage is seen, and the number of passages that this counts as.
PRIOR, PRIOR_WEIGHT = (1.5, 6.5), 200
BINS = 1024  # steps of a bit in which passages are counted before the quantiles are looked up within a step
SALAD_WORDS = 12  # words that a passage needs for its PMI to tell anything
LINK_WORDS = 6  # words of explanation a link needs

_CJK = re.compile(r"[\u3400-\u9fff\u3040-\u30ff]")
_CJK_RUN = re.compile(r"[\u3400-\u9fff\u3040-\u30ff]+")
_WORD = re.compile(r"[^\W_]+(?:[_'’-][^\W_]+)*")
_TAG = re.compile(r"<[^>]+>")
_CODE = re.compile(r"(?:def |class |return\b|import \S+(?: as \w+| from \S+)?;?\s*$|from \S+ import|const |let |var |func |fn |public |private |export |if \(|for \(|while \(|@\w+|#include|Traceback|File \"|at \S+\(|[}\])];?\s*$)")
_CALL = re.compile(r"\w\([^()]*\)[;:]?$")
_STATEMENT = re.compile(r"[=(){}]|^(?:return|break|continue|import|package|use|using|goto|throw)\b|^\w+ \w+;$")
_LOG = re.compile(r"\W{0,3}\d{4}[-/]\d\d[-/]\d\d|\W{0,3}\d\d:\d\d|[0-9a-f]{7,40} |@@ ")
_LEVEL = re.compile(r"\b(?:INFO|WARN|WARNING|DEBUG|ERROR|TRACE)\b")
_LINK = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)|<a\s[^>]*>.*?</a>|https?://\S+|www\.\S+|(?<![\w/.@])(?:[a-z0-9-]+\.)+[a-z]{2,10}/\S*|(?<![\w/.@])(?:[a-z0-9-]+\.)+(?:com|net|org|info|biz|io|test|example|invalid)\b", re.I)
_DOTTED = re.compile(r"\.[a-z]|www\.", re.I)  # in every link that has no mark of its own
_GOODS = re.compile(r"\d[.,]\d\d\s?(?:[€$£¥]|EUR|USD|GBP|RUB)?$|[€$£¥]\s?\d+(?:[.,]\d+)?$")
_NUMBER = re.compile(r"^[\W\d_]*\d[\W\d]*$")
_ITEM = re.compile(r"[,;#|/·•!?:。！？，；：、\n]+\s*|\.\s+|\.$| [-–—] ")
_MEASURE = re.compile(r"\d|_")


def _spaced(text: str) -> str:
    """Runs of Chinese or Japanese in pairs of characters."""
    return _CJK_RUN.sub(lambda m: " " + " ".join(m[0][i : i + 2] for i in range(0, len(m[0]), 2)) + " ", text)


class _Ids(dict):
    """Word to its number in a block; identifiers and numbers are all the same word."""

    def __init__(self):
        super().__init__()
        self.names = ["#"]
        self["#"] = 0

    def __missing__(self, word: str) -> int:
        if word.isalpha():
            n = len(self.names)
            self.names.append(word)
        else:
            n = 0
        self[word] = n
        return n


def passages(text: str) -> tuple[int, int, list[tuple[int, str]]]:
    """(words of the page, words in unexplained links and priced goods, passages of other text as (words, text)).

    Code, logs and tables of figures count as words only. Links that are explained are taken
    out and the words around them are judged like any others.
    """
    total = links = 0
    out, cur, size, fenced, told = [], [], 0, False, set()
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            continue
        if s.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        words = s.split()
        n = len(words)
        total += n
        if fenced:
            continue
        if ("](" in s or "<a" in s or ("." in s and ("://" in s or _DOTTED.search(s)))) and (found := len(_LINK.findall(s))):
            s = _LINK.sub(" ", s)
            rest = (_TAG.sub(" ", s) if "<" in s else s).split()
            if sum(1 for w in rest if _WORD.search(w) and not _NUMBER.match(w)) < LINK_WORDS * found:
                links += n
                continue
            words = rest
            s = " ".join(rest)
            if s in told:  # an explanation that stands beside several links is judged once
                continue
            told.add(s)
            n = len(rest)
        last = s[-1]
        if n <= 12 and (last.isdigit() or last in "€$£¥RDPB") and "|" not in s and _GOODS.search(s):
            links += n
            continue
        if last == "{" or (last == ";" and _STATEMENT.search(s)) or _CODE.match(s) or (last in ");:" and _CALL.search(s)) or _LOG.match(s):
            continue
        if ("INFO" in s or "WARN" in s or "DEBUG" in s or "ERROR" in s or "TRACE" in s) and _LEVEL.search(s):
            continue
        bars = s.count("|")
        if bars >= 2 and sum(1 for c in s.split("|") if _MEASURE.search(c)) * 2 >= bars - 1:
            continue
        for i in range(0, n, CHUNK):  # long lines are cut; short ones join
            part = " ".join(words[i : i + CHUNK]) if n > CHUNK else s
            k = min(CHUNK, n - i)
            if size + k > CHUNK + CHUNK // 2 and cur:
                out.append((size, "\n".join(cur)))
                cur, size = [], 0
            cur.append(part)
            size += k
            if size >= CHUNK:
                out.append((size, "\n".join(cur)))
                cur, size = [], 0
    if cur and size < CHUNK // 2 and out:
        out[-1] = (out[-1][0] + size, out[-1][1] + "\n" + "\n".join(cur))
    elif cur:
        out.append((size, "\n".join(cur)))
    return total, links, out


def _hash(*words: str) -> int:
    h = xxhash.xxh64_intdigest("\x1f".join(words))
    return h - (1 << 64) if h >= 1 << 63 else h


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).astype(np.int64)


NUMBERS = int(_mix(np.array([_hash("#")]), np.array([_hash("#")]))[0])  # the pair of two numbers or identifiers, which is no collocation
#: kind 0: count c of the word h in a block; kind 1: count c of the pair h (of words h1, h2), in slot; kind 2: a page, its passages' words (ns), words told apart (ws), different words (vs), items, and flat pair slots.
NOTES = "kind int, block long, slot int, h long, h1 long, h2 long, c long, doc_id long, total int, links int, ns array<int>, ws array<int>, vs array<int>, items array<int>, slots array<int>"
_COLS = [c.split()[0] for c in NOTES.split(", ")]


def _block_rows(block: int, pages: list[tuple], flat: list[int], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of NOTES of one block of pages (doc_id, total, links, ns, ws, vs, items) whose passages' words follow each other in flat."""
    hashes = np.fromiter(map(_hash, names), dtype=np.int64, count=len(names))
    ids = np.array(flat, dtype=np.int64)
    ends = np.cumsum([w for p in pages for w in p[4]], dtype=np.int64)
    inside = np.ones(max(len(ids) - 1, 0), dtype=bool)
    inside[ends[:-1] - 1] = False  # no pair spans two passages
    pairs, slot, c = np.unique(((ids[:-1] << 32) | ids[1:])[inside], return_inverse=True, return_counts=True)
    left, right = hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF]
    yield _notes(0, h=hashes, c=np.bincount(ids, minlength=len(names)))
    yield _notes(1, block=block, slot=np.arange(len(pairs), dtype=np.int32), h=_mix(left, right), h1=left, h2=right, c=c)
    doc, total, links, ns, ws, vs, items = zip(*pages)
    cuts = np.cumsum([sum(w) - len(w) for w in ws])[:-1]
    yield _notes(2, block=block, doc_id=doc, total=total, links=links, ns=ns, ws=ws, vs=vs, items=items, slots=np.split(slot.astype(np.int32), cuts))


def _notes(kind: int, **cols) -> pd.DataFrame:
    n = len(next(c for c in cols.values() if not isinstance(c, int)))
    arrays = {c: pd.Series(list(cols.get(c, [None] * n)), dtype=object) for c in ("ns", "ws", "vs", "items", "slots")}
    return pd.DataFrame({**dict.fromkeys(_COLS, 0), "kind": kind, **cols, **arrays}, index=range(n))


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words and pairs of each block of pages, and its pages with the pairs of their passages."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    number, pages, flat, known = 0, [], [], _Ids()
    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"]):
            if not text:
                continue
            if "\r" in text:
                text = text.replace("\r\n", "\n").replace("\r", "\n")
            if not text.isascii() and _CJK.search(text):
                text = _spaced(text)
            total, links, parts = passages(text)
            if not total:
                continue
            ns, ws, vs, items = [], [], [], []
            for n, p in parts:
                at = len(flat)
                flat.extend(map(known.__getitem__, _WORD.findall((_TAG.sub(" ", p) if "<" in p else p).lower())))
                w = len(flat) - at
                if w:
                    ns.append(n)
                    ws.append(w)
                    vs.append(len(set(flat[at:])))
                    k = len(_ITEM.findall(p)) + 1  # items that may be without words
                    items.append(k if k * LIST_WORDS < w else sum(1 for x in _ITEM.split(p) if _WORD.search(x)))
            pages.append((doc, total, links, ns, ws, vs, items))
            if len(flat) > BLOCK:
                yield from _block_rows((part << 32) | number, pages, flat, known.names)
                number, pages, flat, known = number + 1, [], [], _Ids()
    if pages:
        yield from _block_rows((part << 32) | number, pages, flat, known.names)


JUDGED = "doc_id long, page long, total int, links int, n int, words int, sure boolean, items boolean, pmi double"


def _judge_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The passages of one block's pages (left): surely stuffing or not, strings of items or not, and their mean PMI, by the bits and rates of the block's pairs (right)."""
    pmi, rate = np.zeros(len(right)), np.zeros(len(right))
    at = right["slot"].to_numpy()
    pmi[at], rate[at] = right["pmi"].to_numpy(), right["rate"].to_numpy()
    join = lambda c: np.concatenate([np.asarray(x, dtype=np.int64) for x in left[c]]) if len(left) else np.zeros(0, dtype=np.int64)
    n, w, v, k, slots = (join(c) for c in ("ns", "ws", "vs", "items", "slots"))
    page = np.repeat(np.arange(len(left)), [len(x) for x in left["ns"]])
    length = np.bincount(page, weights=w, minlength=len(left))
    of = np.repeat(np.arange(len(w)), w - 1)  # the passage of each pair
    ends = np.concatenate([[0], np.cumsum(w - 1)])
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])  # noqa: E731  # per passage
    # pairs that their page repeats beyond what the corpus lets expect
    seen, where, times = np.unique((page[of] << 32) | slots, return_inverse=True, return_counts=True)
    expected = np.maximum(rate[seen & 0xFFFFFFFF] * length[seen >> 32], 1e-3)
    beyond = times * np.log(times / expected) - (times - expected)
    often = (times >= np.maximum(REPEATED, REPEATED_SHARE * length[seen >> 32])) & (times > expected) & (beyond >= SURPRISE)
    hit = often[where]
    opens = hit.copy()
    opens[1:] &= ~(hit[:-1] & (of[1:] == of[:-1]))
    cover, variety, each = (total(hit) + total(opens)) / w, v / w, w / np.maximum(k, 1)
    sure = ((cover >= COVER) & (variety <= VARIETY)) | ((cover >= COVER_LIST) & (variety <= VARIETY_LIST) & (each <= LIST_WORDS))
    with np.errstate(invalid="ignore"):
        mean = total(pmi[slots]) / (w - 1)
    head = left.iloc[page]
    out = pd.DataFrame({"doc_id": head["doc_id"].to_numpy(), "page": page, "total": head["total"].to_numpy(), "links": head["links"].to_numpy(), "n": n, "words": w, "sure": sure, "items": (each <= ITEM_WORDS) & (k >= ITEMS), "pmi": mean})
    bare = left.iloc[np.flatnonzero(length == 0)]  # pages without passages
    none = pd.DataFrame({"doc_id": bare["doc_id"], "page": np.flatnonzero(length == 0), "total": bare["total"], "links": bare["links"], "n": 0, "words": 0, "sure": False, "items": False, "pmi": np.nan})
    return pd.concat([out, none]) if len(none) else out


def quantiles(values: DataFrame, col: str, parts: list[float]) -> DataFrame:
    """One row: k, the number of values (none of them NaN), and q, for each part the smallest value with at least that part of them up to itself, null without values.

    Exact, from every value: they are counted in steps, and only the steps that hold a quantile are sorted.
    """
    values = values.where(F.col(col).isNotNull()).select(F.floor(F.col(col) * BINS).alias("bin"), F.col(col).alias("v"))
    upto = F.sum("c").over(W.orderBy("bin"))  # as many rows as steps
    bins = values.groupBy("bin").agg(F.count("*").alias("c")).select("bin", "c", upto.alias("upto"), F.sum("c").over(W.partitionBy()).alias("k"))
    ranks = F.array(*(F.greatest(F.ceil(F.col("k") * F.lit(p)), F.lit(1)) for p in parts))
    wanted = bins.select("bin", "k", (F.col("upto") - F.col("c")).alias("before"), "upto", F.posexplode(ranks).alias("i", "rank")).where("rank > before and rank <= upto")
    held = values.join(F.broadcast(wanted.select("bin").distinct()), "bin").withColumn("place", F.row_number().over(W.partitionBy("bin").orderBy("v")))
    found = held.join(F.broadcast(wanted), "bin").where("place = rank - before")
    return found.agg(F.coalesce(F.max("k"), F.lit(0)).alias("k"), F.array(*(F.max(F.when(F.col("i") == i, F.col("v"))) for i in range(len(parts)))).alias("q"))


def stuffed_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, words, stuffed) of the pages of docs(doc_id, text) that are stuffed for more than half.

    Null, empty and blank texts, and documents without doc_id, are never reported; rows that
    repeat a doc_id are judged one by one and reported once. No rows give no rows. Salad of
    words that the corpus hardly knows has no PMI to speak of and is only told by its repeats.
    """
    tmp = Scratch(docs.sparkSession, "stuffing")
    notes = tmp.save(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_survey, NOTES), "notes")
    words = notes.where("kind = 0 and c > 0").groupBy("h").agg(F.sum("c").alias("c"))
    slots = notes.where("kind = 1").select("block", "slot", "h", "h1", "h2", "c")
    pairs = slots.groupBy("h").agg(F.sum("c").alias("c"), F.any_value("h1").alias("h1"), F.any_value("h2").alias("h2"))
    size = notes.where("kind = 1").agg(F.greatest(F.sum("c"), F.lit(1)).alias("all"))

    def look(key: str, name: str) -> DataFrame:
        return words.select(F.col("h").alias(key), F.col("c").alias(name))

    pmi = pairs.join(look("h1", "c1"), "h1").join(look("h2", "c2"), "h2").crossJoin(F.broadcast(size))
    bits = F.log2((F.col("c") + SMOOTH) * F.col("all") / ((F.col("c1") + SMOOTH) * (F.col("c2") + SMOOTH)))
    pmi = pmi.select("h", bits.alias("pmi"), F.when(F.col("h") == NUMBERS, 1.0).otherwise(F.col("c") / F.col("all")).alias("rate"))
    told = slots.select(F.col("block").alias("at"), "slot", "h").join(pmi, "h").select("at", "slot", "pmi", "rate")
    pages = notes.where("kind = 2").select("block", "doc_id", "total", "links", "ns", "ws", "vs", "items", "slots")
    judged = tmp.save(pages.groupBy("block").cogroup(told.groupBy("at")).applyInPandas(_judge_block, JUDGED), "judged")
    tmp.keep_only("judged")
    # what is usual is read off the passages of all pages
    usual = quantiles(judged.where((F.col("words") >= SALAD_WORDS) & ~F.col("sure") & ~F.col("items")), "pmi", [0.25, 0.5, ITEMS_QUANTILE])
    shrunk = lambda q, prior: (F.col("k") * F.coalesce(q, F.lit(0.0)) + PRIOR_WEIGHT * prior) / (F.col("k") + PRIOR_WEIGHT)
    usual = usual.select(shrunk(F.col("q")[1] - SALAD_SPREAD * (F.col("q")[1] - F.col("q")[0]), PRIOR[0]).alias("low"), shrunk(F.col("q")[2], PRIOR[1]).alias("low_items"))
    bad = F.col("sure") | (F.col("items") & (F.col("pmi") < F.col("low_items"))) | ((F.col("words") >= SALAD_WORDS) & (F.col("pmi") < F.col("low")))
    per = judged.crossJoin(F.broadcast(usual)).groupBy("doc_id", "page", "total", "links").agg(F.sum(F.when(F.coalesce(bad, F.lit(False)), F.col("n")).otherwise(0)).alias("extra"))
    out = per.groupBy("doc_id").agg(F.max(F.struct((F.col("links") + F.col("extra")).cast("int").alias("stuffed"), F.col("total").alias("words"))).alias("m"))
    return out.select("doc_id", "m.words", "m.stuffed").where("2 * stuffed > words")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return stuffed_pages(spark.read.parquet(f"{root}/documents.parquet")).select("doc_id")
