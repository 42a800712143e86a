"""Missing or wrong language labels of texts, and texts that mix languages.

Method: a bidirectional gated recurrent network over bytes (bigru.py) labels every position;
positions are pooled into parts of a text and into the text, each with a confidence. It is
trained on a bounded sample of the labelled rows, whose own noise is removed by leaving out
what the half-trained network contradicts.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.keys import plain_key
from codeloom.llm.bigru import ByteGRU, pack
from codeloom.runtime import Scratch, shared_dir

CODES = ["en", "de", "fr", "es", "pt", "ru", "uk", "zh"]
NO_LANGUAGE = "zxx"
#: Bounds of the training sample: rows per language, parts of texts per language, bytes of a part, epochs before and after the noise is removed.
ROWS, PARTS, PART_BYTES, EPOCHS = 500, 640, 96, (4, 9)
MIXED = 3  # texts for each mixture of two that is trained on as well
CHUNK_BYTES = 480  # longer parts are labelled piece by piece
WINDOW = 20  # bytes in a row that tell of a switch
LETTERS, SURE, SWITCH = 8, 0.96, 20.0  # letters and confidence of a part in another language; log odds of a switch inside a part
CLAUSE, CLAUSE_LETTERS = 0.88, 30  # confidence and letters that do as well for a run between switches, whose ends the switch blurs

# Codes and English names of the languages.
_NAMES = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish castilian", "pt": "pt por portuguese", "ru": "ru rus russian",
    "uk": "uk ukr ukrainian", "zh": "zh zho chi chinese cmn mandarin", "zxx": "zxx",
}
LABELS = {name: code for code, names in _NAMES.items() for name in names.split()}
# Labels that say nothing.
UNKNOWN = ["", "und", "undefined", "undetermined", "unknown", "n/a", "na", "none", "null", "nil", "nan", "?", "??", "-", "--", "unk", "mis", "tbd", "other", "any", "auto", "unspecified", "not known"]

#: Tokens of code: with path or name separators, brackets of a call, digits, or capitals inside.
_CODE = re.compile(r"::|[/\\_@#$%^&*+=<>~{}\[\]]|\d|\w\(|[^\W\d_][a-z0-9]*\.[a-z]{1,5}\b|[a-z][A-Z][a-z]")
_QUOTED = re.compile(r"```.*?```|`[^`]*`", re.S)
_ASCII = re.compile(r"[!-~]+")
_TOKEN = re.compile(r"\S+")
_INNER = re.compile(r"[。！？；]+")
_END = re.compile(r"[.!?;:。！？；][\"')\]»”]*$|^[|—–/-]+$")
_LETTER = re.compile(r"[^\W\d_]")
_BLANKS = re.compile(r"[\W\d_]+")


def label_code(c: Column) -> Column:
    """The language a label names in any usual spelling; null if it names none of the known ones."""
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+)"), F.lit(1))
    return F.get(F.filter(F.transform(words, lambda w: table[w]), lambda x: x.isNotNull()), F.lit(0))


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(UNKNOWN) | (F.regexp_replace(c, r"[\s\p{Z}]+", "") == "")


class _Tokens(dict):
    """Token to its pieces: (word in lower case or "", whether a part ends behind it)."""

    def __missing__(self, token: str) -> tuple[tuple[str, bool], ...]:
        pieces = []
        for piece in _INNER.split(token):
            if _CODE.search(piece):
                piece = _ASCII.sub(" ", piece) if not piece.isascii() else ""
            pieces.append((_BLANKS.sub(" ", piece).strip().lower(), False))
            pieces.append(("", True))
        if not _END.search(token):
            pieces.pop()
        if len(self) > 300_000:
            self.clear()
        self[token] = out = tuple(pieces)
        return out


_TOKENS = _Tokens()


def text_parts(text: str) -> list[str]:
    """The sentences and lines of a text in lower case, without code and numbers."""
    if "`" in text:
        text = _QUOTED.sub(" ", text)
    out, words = [], []
    look = _TOKENS.__getitem__
    for line in text.split("\n"):
        for token in line.split():
            for word, end in look(token):
                if word:
                    words.append(word)
                if end and words:
                    out.append(" ".join(words))
                    words = []
        if words:
            out.append(" ".join(words))
            words = []
    return out


def part_places(text: str) -> list[list[tuple[int, int, int]]]:
    """For each part of text_parts its words as (letters and blanks of the word, start, end of its token in the text)."""
    if "`" in text:
        text = _QUOTED.sub(lambda m: "\n".join(" " * len(x) for x in m[0].split("\n")) if "\n" in m[0] else " " * len(m[0]), text)
    out, words, line_at = [], [], 0
    for line in text.split("\n"):
        for m in _TOKEN.finditer(line):
            for word, end in _TOKENS[m[0]]:
                if word:
                    words.append((len(word), line_at + m.start(), line_at + m.end()))
                if end and words:
                    out.append(words)
                    words = []
        if words:
            out.append(words)
            words = []
        line_at += len(line) + 1
    return out


def _fold(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


def fit(rows: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """Weights from (text, language) rows; a part of the texts is repeated without accents."""
    rng = np.random.default_rng(11)
    parts: dict[str, list[str]] = {c: [] for c in CODES}
    seen: set[tuple[str, str]] = set()
    for text, code in rows:
        for part in text_parts(text):
            if len(_LETTER.findall(part)) >= LETTERS and (part, code) not in seen and len(parts[code]) < 4 * PARTS:
                seen.add((part, code))
                parts[code].append(part)
    data, labels = [], []
    for k, code in enumerate(CODES):
        mine = parts[code]
        rng.shuffle(mine)
        mine = mine[:PARTS]
        if code in ("de", "fr", "es", "pt"):
            mine = mine + [_fold(x) for x in mine[: PARTS // 4]]
        for x in mine:
            raw = x.encode()
            at = int(rng.integers(0, max(1, len(raw) - PART_BYTES + 1)))
            data.append(raw[at : at + PART_BYTES])
            labels.append(k)
    net = ByteGRU(len(CODES))
    if not data:
        return net.state()
    y = np.array(labels)
    net.train(data, y, EPOCHS[0])
    good = np.array([scores[k] > 0.5 for scores, k in zip(_pooled(net, data), y)])
    kept, y = [d for d, g in zip(data, good) if g], y[good]
    mixed = _mixtures(kept, y, rng)
    each = [np.full(len(d), k) for d, k in zip(kept, y)] + [m[1] for m in mixed]
    net.train(kept + [m[0] for m in mixed], each, EPOCHS[1], seed=5, rate=0.012)
    return net.state()


def _slice(raw: bytes, size: int, rng: np.random.Generator) -> bytes:
    """Whole words of raw, about size bytes of them."""
    words = raw.split(b" ")
    at = int(rng.integers(len(words)))
    out = words[at]
    for w in words[at + 1 :]:
        if len(out) + len(w) > size:
            break
        out += b" " + w
    return out


def _mixtures(data: list[bytes], y: np.ndarray, rng: np.random.Generator) -> list[tuple[bytes, np.ndarray]]:
    """Texts that change language between words, labelled byte by byte: one for every MIXED texts of data, half of them a clause within another language."""
    out = []
    for _ in range(len(data) // MIXED if len(set(y.tolist())) > 1 else 0):
        i, j = int(rng.integers(len(data))), int(rng.integers(len(data)))
        while y[j] == y[i]:
            j = int(rng.integers(len(data)))
        parts = [(_slice(data[i], 40, rng), y[i]), (_slice(data[j], 40, rng), y[j])]
        if rng.random() < 0.5:
            parts.append((_slice(data[i], 40, rng), y[i]))
        text = b" ".join(p for p, _ in parts)
        out.append((text, np.concatenate([np.full(len(p) + 1, k) for p, k in parts])[: len(text)]))
    return out


def _batches(texts: list[bytes]):
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        n = 320  # what a step works on stays in the processor's cache
        yield order[at : at + n]
        at += n


def _pooled(net: ByteGRU, texts: list[bytes]) -> list[np.ndarray]:
    out: list = [None] * len(texts)
    for group in _batches(texts):
        ids, mask = pack([texts[i] for i in group])
        p = net.probabilities(ids, mask) * mask[:, :, None]
        mean = p.sum(axis=0) / np.maximum(mask.sum(axis=0), 1)[:, None]
        for j, i in enumerate(group):
            out[i] = mean[j]
    return out


def _split(logs: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int]]:
    """Runs (start, end) of positions in one language, by the likeliest path through the words: a switch must gain SWITCH in log odds and fall between words."""
    starts = np.concatenate([[0], cuts + 1])
    starts = starts[starts < len(logs)]
    score = np.add.reduceat(logs, starts, axis=0)
    best, back = score[0], []
    for row in score[1:]:
        k = int(best.argmax())
        stay = best >= best[k] - SWITCH
        back.append(np.where(stay, np.arange(len(best)), k))
        best = np.where(stay, best, best[k] - SWITCH) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    edges = [0, *(int(starts[i]) for i in range(1, len(path)) if path[i] != path[i - 1]), len(logs)]
    return list(zip(edges, edges[1:]))


def label_parts(net: ByteGRU, parts: list[str]) -> list[list[tuple[int, float, int, int, int]]]:
    """For each part its runs as (class, confidence, letters, first byte, end).

    A piece is one run if no WINDOW of bytes in it is likelier in another language than in the
    piece's; else the likeliest path through its words is taken.
    """
    pieces: list[bytes] = []
    owner: list[tuple[int, int]] = []
    for i, part in enumerate(parts):
        raw = part.encode()
        for a in range(0, len(raw), CHUNK_BYTES):
            pieces.append(raw[a : a + CHUNK_BYTES])
            owner.append((i, a))
    runs: list[list[tuple[int, float, int, int, int]]] = [[] for _ in parts]
    for group in _batches(pieces):
        ids, mask = pack([pieces[i] for i in group])
        p = net.probabilities(ids, mask)
        mean = (p * mask[:, :, None]).sum(axis=0) / mask.sum(axis=0)[:, None]
        best = mean.argmax(axis=1)
        conf = mean.max(axis=1).tolist()
        own = np.where(mask > 0, np.take_along_axis(p, best[None, :, None], axis=2)[:, :, 0], 1.0)
        if len(own) > WINDOW:
            c = np.cumsum(own, axis=0)
            low = (np.minimum((c[WINDOW:] - c[:-WINDOW]).min(axis=0), c[WINDOW - 1]) / WINDOW).tolist()
        else:
            low = own.mean(axis=0).tolist()
        best = best.tolist()
        for j, i in enumerate(group):
            raw, (part, at) = pieces[i], owner[i]
            if low[j] >= 0.5 or len(raw) <= 30:
                runs[part].append((best[j], conf[j], _letters(raw), at, at + len(raw)))
                continue
            mine = p[: len(raw), j]
            for a, b in _split(np.log(mine + 1e-4), np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32)):
                m = mine[a:b].mean(axis=0)
                k = int(m.argmax())
                runs[part].append((k, float(m[k]), _letters(raw[a:b]), at + a, at + b))
    return runs


def _letters(raw: bytes) -> int:
    """Letters of a part, which holds nothing but letters and blanks."""
    text = raw.decode("utf-8", "ignore")
    return len(text) - text.count(" ")


def languages_of(parts: list[str], runs: dict[str, list[tuple[int, float, int, int, int]]]) -> list[tuple[str, float, float]]:
    """(language, confidence, share) of a text from the runs of its parts, the main language first.

    confidence is the mean posterior of the language over the letters labelled with it, share
    their part of all letters. A second language needs a run with LETTERS letters (2 in
    Chinese) labelled with SURE confidence; within a part that changes
    language CLAUSE_LETTERS with CLAUSE do as well. Texts without any letters outside code are zxx.
    """
    weight = np.zeros(len(CODES))
    letters = np.zeros(len(CODES))
    sure = np.zeros(len(CODES))
    for part in parts:
        several = len({r[0] for r in runs[part]}) > 1
        for k, conf, n, _, _ in runs[part]:
            weight[k] += n * conf
            letters[k] += n
            if (conf >= SURE and n >= (2 if CODES[k] == "zh" else LETTERS)) or (several and conf >= CLAUSE and n >= CLAUSE_LETTERS):
                sure[k] += n
    if not weight.any():
        return [(NO_LANGUAGE, 1.0, 1.0)]
    main = int(weight.argmax())
    found = [main] + [k for k in np.argsort(-weight) if k != main and sure[k]]
    return [(CODES[k], float(weight[k] / letters[k]), float(letters[k] / letters.sum())) for k in found]


def detect(texts: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """The columns of texts(..., text) and its languages as array<struct<lang, confidence, share>>.

    A text without letters outside code and numbers is zxx; null and blank texts have an empty
    array. Whole texts are read; equal parts of a batch are labelled once.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.drop("text").schema.fields) + ", langs array<struct<lang:string,confidence:double,share:double>>"
    sent = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = ByteGRU.from_state(sent.value)
        cache: dict[str, list] = {}
        for batch in batches:
            cut = [text_parts(t) if isinstance(t, str) else [] for t in batch["text"]]
            new = [p for p in dict.fromkeys(p for parts in cut for p in parts) if p not in cache]
            if len(cache) > 200_000:
                cache.clear()
                new = list(dict.fromkeys(p for parts in cut for p in parts))
            cache.update(zip(new, label_parts(net, new)))
            langs = [[] if not isinstance(t, str) or not t.strip() else [{"lang": a, "confidence": b, "share": c} for a, b, c in languages_of(parts, cache)] for t, parts in zip(batch["text"], cut)]
            yield batch.drop(columns=["text"]).assign(langs=langs)

    return texts.mapInPandas(run, schema)


def training_rows(texts: DataFrame) -> list[tuple[str, str]]:
    """At most ROWS labelled texts per language, chosen by hash."""
    known = texts.select("text", label_code(F.col("label")).alias("code")).where(F.col("code").isin(CODES) & F.col("text").isNotNull())
    ranked = known.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy(F.xxhash64("text"), "text"))).where(F.col("n") <= ROWS)
    return [(r.text, r.code) for r in sorted(ranked.select("text", "code", "n").collect(), key=lambda r: (r.code, r.n))]


def labelled_texts(spark: SparkSession, root: str) -> DataFrame:
    """(tbl, record_id, text, label): the row delivered last of each record, functions of their project's newest snapshot only."""

    def last(rows: DataFrame, tbl: str, key: str, when: str, text: str) -> DataFrame:
        r = rows.select(plain_key(F.col(key)).alias("record_id"), F.struct(F.col(when).alias("w"), F.col(text).alias("text"), F.col("text_lang").alias("label")).alias("s"))
        r = r.where("record_id is not null").groupBy("record_id").agg(F.max("s").alias("s"))
        return r.select(F.lit(tbl).alias("tbl"), "record_id", "s.text", "s.label")

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{name}.parquet")

    newest = read("graph_files").groupBy(F.trim("project").alias("project")).agg(F.max("snapshot_id").alias("snapshot_id"))
    functions = read("graph_functions").withColumn("project", F.trim("project")).join(newest, ["project", "snapshot_id"])
    return (
        last(functions, "graph_functions", "id", "loaded_at", "intent")
        .unionByName(last(read("impact_reports"), "impact_reports", "fn_id", "generated_at", "description"))
        .unionByName(last(read("units"), "units", "id", "updated_at", "description"))
    )


def label_cases(found: DataFrame) -> DataFrame:
    """Rows (tbl, record_id, lang, confidence, share) of found(tbl, record_id, label, langs) whose label is missing or wrong, or whose text mixes languages."""
    right = F.coalesce(label_code(F.col("label")) == F.col("langs")[0]["lang"], F.lit(False)) & ~is_missing(F.col("label"))
    cases = found.where((F.size("langs") > 0) & (~right | (F.size("langs") > 1)))
    return cases.select("tbl", "record_id", F.explode("langs").alias("x")).select("tbl", "record_id", F.col("x.lang").alias("lang"), F.col("x.confidence").alias("confidence"), F.col("x.share").alias("share"))


def _run_segments(parts: list[str], places: list[list[tuple[int, int, int]]], runs: dict[str, list], size: int) -> list[list]:
    """[language, sum of posterior by letters, letters, start, end] of the segments of one text; neighbouring runs in one language are one."""
    if not parts:
        return [[NO_LANGUAGE, 1.0, 1, 0, size]]
    found = [x[0] for x in languages_of(parts, runs)]
    out: list[list] = []
    for part, words in zip(parts, places):
        raw = part.encode() if not part.isascii() else None
        ends = np.cumsum([n + 1 for n, _, _ in words])
        for k, conf, n, a, b in runs[part]:
            if raw is not None:
                a, b = len(raw[:a].decode("utf-8", "ignore")), len(raw[:b].decode("utf-8", "ignore"))
            first, last = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b - 1, side="right"))
            first, last = min(first, len(words) - 1), min(max(first, last), len(words) - 1)
            code = CODES[k] if CODES[k] in found else found[0]
            if out and out[-1][0] == code:
                out[-1][1] += conf * n
                out[-1][2] += n
                out[-1][4] = words[last][2]
            else:
                out.append([code, conf * n, n, words[first][1], words[last][2]])
    return out


def segments(texts: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """One row per part of each text in one language: the columns of texts but text, pos, lang, confidence (mean posterior), share (of the text's letters) and the characters [start_at, end_at) of the text it fills.

    Every run of positions in one language is a segment, so a switch within a sentence is one
    too; neighbouring runs in the same language are one, and a run that isn't sure of its
    language (see languages_of) has its text's main one. Texts of code only have a single zxx
    row; null and blank texts have none.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.drop("text").schema.fields) + ", pos int, lang string, confidence double, share double, start_at int, end_at int"
    sent = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = ByteGRU.from_state(sent.value)
        for batch in batches:
            cut = [text_parts(t) if isinstance(t, str) else [] for t in batch["text"]]
            every = list(dict.fromkeys(p for parts in cut for p in parts))
            runs = dict(zip(every, label_parts(net, every)))
            head, rows = batch.drop(columns=["text"]), []
            for values, text, parts in zip(head.itertuples(index=False, name=None), batch["text"], cut):
                if isinstance(text, str) and text.strip():
                    segs = _run_segments(parts, part_places(text), runs, len(text))
                    total = sum(x[2] for x in segs)
                    rows += [(*values, i, code, conf / max(n, 1), n / max(total, 1), a, b) for i, (code, conf, n, a, b) in enumerate(segs)]
            yield pd.DataFrame(rows, columns=[*head.columns, "pos", "lang", "confidence", "share", "start_at", "end_at"])

    return texts.mapInPandas(run, schema)


def fitted(spark: SparkSession, rows: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """fit(rows), kept in the shared folder under the hash of the sample and the parameters, so that equal samples are learnt once."""
    name = hashlib.sha256(repr((rows, CODES, ROWS, PARTS, PART_BYTES, EPOCHS, MIXED, ByteGRU.VERSION)).encode()).hexdigest()[:24]
    where = f"{shared_dir(spark)}/languages-weights-{name}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        kept = spark.read.parquet(where).collect()
        return {r.name: np.frombuffer(r.raw, dtype=r.kind).reshape(r.shape) for r in kept}
    weights = fit(rows)
    table = [(k, str(v.dtype), list(v.shape), v.tobytes()) for k, v in weights.items()]
    spark.createDataFrame(table, "name string, kind string, shape array<int>, raw binary").coalesce(1).write.mode("overwrite").parquet(where)
    return weights


def _prepared(spark: SparkSession, root: str) -> tuple[DataFrame, dict[str, np.ndarray]]:
    texts = Scratch(spark, "languages").save(labelled_texts(spark, root).where("text is not null"), "texts")
    return texts, fitted(spark, training_rows(texts))


def p4_segments(spark: SparkSession, root: str) -> DataFrame:
    """Every text's segments with language, confidence, share and place."""
    return segments(*_prepared(spark, root)).drop("label")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return label_cases(detect(*_prepared(spark, root))).select("tbl", "record_id", "lang")
