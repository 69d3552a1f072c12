"""Evaluation texts that turn up in a corpus, by latent semantic retrieval.

Texts are read as words (markup, case, quoting and spacing aside). Passages of
the corpus are windows of words; those that hold too few words of the items to
be a case are left out by an exact bound. TF-IDF vectors of the passages, with
document frequencies of the whole corpus, go through a distributed randomised
SVD; the items' passages lie in balls of the latent space, and a passage is
compared by cosine with those of the balls it can reach. Candidates above the
threshold are held to a longest common subsequence; what has one long enough
for a case is aligned word by word, and what is none by that is held to the
stricter subsequence and the answer check of a paraphrase.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.runtime import staged

WORDS = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһԛԝοαν", "aeopcyxijsdhqwoav", "­​‌‍⁠﻿")

#: Stretches of text that a task compares; they are small, but take milliseconds each.
STRETCHES = 1_000
#: Partial matrices that are added up at once, and the most numbers in a piece of one.
FAN_IN, PIECE = 16, 1 << 18


@dataclass(frozen=True)
class Leak:
    """Parameters. A case is a run of at least ``words`` words of an item with
    at most one error (word changed, left out, put in, or split in two) in
    ``per_error`` words, that begins and ends with a word that is the same."""

    words: int = 20
    per_error: int = 10
    window: int = 18
    known: int = 13
    #: Steps between passages of a document, and of an item.
    stride: int = 4
    item_stride: int = 6
    rank: int = 192
    cosine: float = 0.7
    seed: int = 17
    #: Least cosine of a ball's passages to its middle.
    ball: float = 0.9
    #: Words of items held at once by driver and tasks; more are taken in blocks. What is sent to a task, and the
    #: matrix that comes back, take about 1,000 bytes a word of the block at most.
    block: int = 100_000


def _uncommented(text: str) -> str:
    """A text without HTML comments, in one pass; one that isn't closed is text."""
    kept, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        kept.append(text[at:begin])
        at = end + 3
    return " ".join([*kept, text[at:]])


def words_of(text: str) -> list[str]:
    """The words of a text, in small letters, without markup."""
    if "<" in text:
        text = TAG.sub(" ", _uncommented(text))
    if "&" in text:
        text = html.unescape(text)
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).casefold().translate(LOOKALIKES)
    return WORDS.findall(text)


class Items:
    """The items of a block: their words as numbers, and their passages."""

    def __init__(self, rows: list[tuple], how: Leak):
        texts = [(k, words_of(t)) for k, t in rows if t]
        texts = [(k, w) for k, w in texts if len(w) >= how.words]
        self.keys = [k for k, _ in texts]
        self.ids: dict[str, int] = {}
        self.words = [[self.ids.setdefault(w, len(self.ids)) for w in ws] for _, ws in texts]
        starts = [(i, s) for i, ws in enumerate(self.words) for s in sorted({*range(0, len(ws) - how.window + 1, how.item_stride), len(ws) - how.window})]
        self.owner = np.array([i for i, _ in starts], dtype=np.int64)
        self.windows = np.array([self.words[i][s : s + how.window] for i, s in starts], dtype=np.int64).reshape(-1, how.window)

    @property
    def size(self) -> int:
        return len(self.ids)


def regions(docs: DataFrame, key: str, text: str, items: Items, how: Leak) -> DataFrame:
    """A row per stretch of a text that may hold a case: ``ids`` (words as
    numbers, -1 for others) and ``joined`` (the number of each word together
    with the next one); and per batch a row with the document frequencies
    (``df``) of the items' words and the number of texts (``n``).

    A case of 20 words has at most two errors, each of which takes at most two
    words of the text out of the items' words, so that 14 of its 18 words at
    least are known; ``known`` = 13 leaves one to spare.
    """
    ids, size = items.ids, items.size
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pad = how.window // 3
        for pdf in batches:
            df, n, rows = np.zeros(size + 1, dtype=np.int64), 0, []
            for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                if not isinstance(t, str):
                    continue
                n += 1
                ws = words_of(t)
                at = np.fromiter((ids.get(w, -1) for w in ws), dtype=np.int64, count=len(ws))
                df[np.unique(at)] += 1  # the last place is for other words
                if len(at) < how.window:
                    continue
                run_ = np.concatenate([[0], (at >= 0).cumsum()])
                good = np.flatnonzero(run_[how.window :] - run_[: -how.window] >= how.known)
                if not len(good):
                    continue
                cuts = np.flatnonzero(np.diff(good) > how.window + 2 * pad)
                for a, b in zip(good[np.r_[0, cuts + 1]], good[np.r_[cuts, len(good) - 1]], strict=True):
                    a, b = max(0, a - pad), min(len(ws), b + how.window + pad)
                    joined = [ids.get(ws[i] + ws[i + 1], -1) for i in range(a, b - 1)] + [-1]
                    rows.append((k, at[a:b].astype(np.int32).tolist(), joined, None, 0))
            rows.append((None, None, None, df[:size].tolist(), n))
            yield pd.DataFrame(rows, columns=["key", "ids", "joined", "df", "n"]).astype({"key": object})

    return docs.select(F.col(key), F.col(text).cast("string")).mapInPandas(run, f"key {kind}, ids array<int>, joined array<int>, df array<bigint>, n bigint")


def _windows(ids: np.ndarray, how: Leak) -> np.ndarray:
    """The passages of a stretch, at every stride and at its end."""
    last = len(ids) - how.window
    starts = np.unique(np.r_[np.arange(0, last + 1, how.stride), last])
    return ids[starts[:, None] + np.arange(how.window)]


def _tfidf(windows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Passages as rows of unit length over the items' words."""
    v = len(idf)
    n = len(windows)
    hit = windows >= 0
    at = (np.arange(n)[:, None] * v + windows)[hit]
    out = np.bincount(at, idf[windows[hit]], minlength=n * v).reshape(n, v).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _blocks(windows: np.ndarray, v: int) -> Iterator[np.ndarray]:
    step = max(16, 8_000_000 // max(v, 1))
    for i in range(0, len(windows), step):
        yield windows[i : i + step]


class Balls:
    """An index of unit vectors: each lies in the ball of the first middle that
    is near enough, itself if there is none. A vector within the angle ``reach``
    of a member is within that angle and the ball's radius of its middle, so
    looking only into such balls loses nothing."""

    def __init__(self, vectors: np.ndarray, least: float):
        middles, n = np.empty_like(vectors), 0
        home = np.empty(len(vectors), dtype=np.int64)
        radius: list[float] = []
        for i, v in enumerate(vectors):
            near = middles[:n] @ v
            k = int(np.argmax(near)) if n else -1
            if k < 0 or near[k] < least:
                k = n
                middles[n] = v
                n += 1
                radius.append(0.0)
            else:
                radius[k] = max(radius[k], float(np.arccos(min(1.0, near[k]))))
            home[i] = k
        self.middles = middles[:n].copy()
        self.radius = np.array(radius)
        order = np.argsort(home, kind="stable")
        self.members = np.split(order, np.cumsum(np.bincount(home, minlength=n))[:-1]) if len(vectors) else []

    def near(self, z: np.ndarray, cosine: float) -> np.ndarray:
        """The members of all balls that one of ``z`` can reach."""
        most = z @ self.middles.T
        # A hair more than the bound, for rounding.
        bound = np.cos(np.minimum(np.pi, np.arccos(cosine) + self.radius + 1e-3))
        hit = np.flatnonzero(most.max(axis=0) >= bound)
        return np.concatenate([self.members[k] for k in hit]) if len(hit) else np.zeros(0, dtype=np.int64)


def _gram_times(stretches: DataFrame, parts: int, idf: np.ndarray, basis: np.ndarray, own: np.ndarray, how: Leak) -> np.ndarray:
    """A'(A basis) for the matrix A of all passages. Each of the ``parts`` tasks
    sums up its own; the sums are added up in rounds of :data:`FAN_IN`, piece by
    piece, so that no task holds more than so many pieces and the driver gets
    one matrix, whatever the corpus."""
    v, r = basis.shape
    rows = max(1, PIECE // r)

    def part(windows: np.ndarray) -> np.ndarray:
        out = np.zeros((v, r), dtype=np.float32)
        for w in _blocks(windows, v):
            a = _tfidf(w, idf)
            out += a.T @ (a @ basis)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, any_ = np.zeros((v, r), dtype=np.float32), None
        for pdf in batches:
            if any_ is None and len(pdf):
                any_ = int(pdf["part"].iloc[0])
            for ids in pdf["ids"]:
                total += part(_windows(np.asarray(ids, dtype=np.int64), how)) if len(ids) > 400 else 0
            short = [_windows(np.asarray(x, dtype=np.int64), how) for x in pdf["ids"] if len(x) <= 400]
            if short:
                total += part(np.concatenate(short))
        if any_ is not None:
            for k, at in enumerate(range(0, v, rows)):
                yield pd.DataFrame({"part": [any_], "piece": [k], "m": [total[at : at + rows].tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["m"].iloc[0], dtype=np.float32).copy()
        for m in pdf["m"].iloc[1:]:
            total += np.frombuffer(m, dtype=np.float32)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "piece": pdf["piece"].iloc[:1], "m": [total.tobytes()]})

    kind = "part int, piece int, m binary"
    sums = stretches.select("ids", F.spark_partition_id().alias("part")).mapInPandas(run, kind)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part", "piece").applyInPandas(add, kind)
    out = part(own).astype(np.float64)
    for row in sums.select("piece", "m").collect():
        at = row["piece"] * rows
        m = np.frombuffer(row["m"], dtype=np.float32).reshape(-1, r)
        out[at : at + len(m)] += m
    return out


def latent_basis(stretches: DataFrame, parts: int, items: Items, idf: np.ndarray, how: Leak) -> np.ndarray:
    """The leading right singular vectors of all passages' TF-IDF matrix, by a
    randomised SVD with one power iteration (two passes over the passages)."""
    v = items.size
    r = min(v, how.rank + 16)
    start = np.random.default_rng(how.seed).standard_normal((v, r)).astype(np.float32)
    q, _ = np.linalg.qr(_gram_times(stretches, parts, idf, start, items.windows, how))
    q = q.astype(np.float32)
    b = q.T @ _gram_times(stretches, parts, idf, q, items.windows, how)
    value, vector = np.linalg.eigh((b + b.T) / 2)
    best = np.argsort(value)[::-1][: min(how.rank, r)]
    return (q @ vector[:, best]).astype(np.float32)


# --- exact checks ------------------------------------------------------------


def aligned(item: list[int], text: list[int], joined: list[int], how: Leak) -> bool:
    """Whether ``text`` holds a run of the item (see :class:`Leak`): a banded
    edit distance from every pair of equal words that begins a run."""
    n, m = len(item), len(text)
    where = defaultdict(list)
    for j, w in enumerate(text):
        if w >= 0:
            where[w].append(j)
    band = max(2, how.words // how.per_error) + 3
    for i0 in range(n - how.words + 1):
        most = (n - i0) // how.per_error
        for j0 in where.get(item[i0], ()):
            if i0 and j0 and item[i0 - 1] == text[j0 - 1]:
                continue
            near = set(text[j0 : j0 + how.words + band]) | set(joined[j0 : j0 + how.words + band])
            if sum(w in near for w in item[i0 : i0 + how.words]) < how.words * 3 // 4:
                continue
            now = {0: 0}
            for i in range(i0, n):
                for d in range(-band, band):  # words put in
                    if d in now and now[d] + 1 < now.get(d + 1, n):
                        now[d + 1] = now[d] + 1
                then: dict[int, int] = {}
                w, length = item[i], i + 1 - i0
                for d, e in now.items():
                    j = j0 + i - i0 + d
                    if 0 <= j < m:
                        same = text[j] == w
                        if same and length >= how.words and e * how.per_error <= length:
                            return True
                        c = e + (not same)
                        if c < then.get(d, n):
                            then[d] = c
                        if joined[j] == w and d < band and e + 1 < then.get(d + 1, n):
                            then[d + 1] = e + 1  # a word split in two
                    if d > -band and e + 1 < then.get(d - 1, n):
                        then[d - 1] = e + 1  # a word left out
                now = {d: e for d, e in then.items() if e <= most}
                if not now:
                    break
    return False


def common_subsequence(a: list[int], b: list[int], joined: list[int] | None = None) -> int:
    """Length of the longest common subsequence, in bits of a whole number.
    A word of ``b`` also stands for what it makes with the next one, ``joined``."""
    mask: dict[int, int] = defaultdict(int)
    for i, w in enumerate(a):
        mask[w] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for j, w in enumerate(b):
        met = mask.get(w, 0)
        if joined is not None and joined[j] >= 0:
            met |= mask.get(joined[j], 0)
        met &= row
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def answered(item: list[int], text: list[int], idf: np.ndarray) -> bool:
    """Whether the text has nine in ten of the words that carry the item's
    answer: its rarest quarter (names and numbers, by corpus frequency)."""
    words = sorted(set(item), key=lambda w: (-idf[w], w))
    key = words[: max(1, len(words) // 4)]
    have = set(text)
    return sum(w in have for w in key) * 10 >= 9 * len(key)


def leaks(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", doc_text: str = "text", item: str = "item_id", item_text: str = "text", how: Leak = Leak()) -> DataFrame:
    """(doc, item, kind, cosine) of documents and the items they hold.

    ``kind`` is ``passage`` for a case by :class:`Leak`, or ``paraphrase``
    where no such run stands, but six in ten of the item's words stand in
    order and the answer check holds. Every document is read in whole; no
    candidate above the cosine is dropped. The items are the stated query set:
    they are held in blocks of about ``how.block`` words, for each of which the
    documents are read once. Null and empty texts hold
    nothing; items of fewer than ``how.words`` words can't be found. Repeated
    documents are each reported; a pair is reported once. Empty tables give an
    empty result.
    """
    kind_d, kind_i = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"`{doc}` {kind_d}, `{item}` {kind_i}, kind string, cosine double"
    spark = docs.sparkSession
    total = items.agg(F.sum(F.size(F.split(F.trim(item_text), r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // how.block))
    out = None
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == b) if blocks > 1 else items
        found = _leaks_of_block(docs, doc, doc_text, [tuple(r) for r in mine.select(item, item_text).collect()], schema, how)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _leaks_of_block(docs: DataFrame, doc: str, doc_text: str, rows: list[tuple], schema: str, how: Leak) -> DataFrame | None:
    items = Items(sorted(rows, key=lambda r: str(r[0])), how)
    if not items.keys:
        return None
    found = staged(regions(docs, doc, doc_text, items, how), "stretches")
    stretches = found.where("ids IS NOT NULL")
    parts = max(1, -(-stretches.count() // STRETCHES))
    stretches = stretches.repartition(parts)  # sized by rows, which take time, not by bytes
    counts = found.where("df IS NOT NULL").select("n", F.posexplode("df").alias("at", "df")).where("df > 0 OR at = 0").groupBy("at").agg(F.sum("df").alias("df"), F.sum(F.when(F.col("at") == 0, F.col("n"))).alias("n")).collect()
    df, n = np.zeros(items.size), 0
    for r in counts:  # at most a row per word of the items
        df[r["at"]] = r["df"]
        n = r["n"] if r["at"] == 0 else n
    idf = np.log((1 + (n or 0)) / (1 + df)) + 1
    basis = latent_basis(stretches, parts, items, idf, how)
    mine = np.concatenate([_tfidf(w, idf) @ basis for w in _blocks(items.windows, items.size)])
    mine = (mine / np.maximum(np.linalg.norm(mine, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    balls = Balls(mine, how.ball)
    owner = items.owner
    least = how.words - how.words // how.per_error  # an error takes a word out of the subsequence, at most
    names = schema.split(", ")
    columns = [names[0].split("`")[1], names[1].split("`")[1], "kind", "cosine"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, ids, joined in zip(pdf["key"], pdf["ids"], pdf["joined"], strict=True):
                ids = np.asarray(ids, dtype=np.int64)
                best: dict[int, float] = {}
                for w in _blocks(_windows(ids, how), items.size):
                    z = _tfidf(w, idf) @ basis
                    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
                    some = balls.near(z, how.cosine)
                    most = (z @ mine[some].T).max(axis=0) if len(some) else np.zeros(0)
                    for at in np.flatnonzero(most >= how.cosine):
                        i = int(owner[some[at]])
                        best[i] = max(best.get(i, -1.0), float(most[at]))
                text, joined = ids.tolist(), list(joined)
                for i, cosine in sorted(best.items()):
                    a = items.words[i]
                    long = common_subsequence(a, text, joined)
                    if long >= least and aligned(a, text, joined, how):
                        out.append((k, items.keys[i], "passage", cosine))
                    elif long * 10 >= 6 * len(a) and answered(a, text, idf):
                        out.append((k, items.keys[i], "paraphrase", cosine))
            yield pd.DataFrame(out, columns=columns)

    pairs = stretches.select("key", "ids", "joined").mapInPandas(run, schema)
    return pairs.groupBy(*columns[:2]).agg(F.min("kind").alias("kind"), F.max("cosine").alias("cosine"))
