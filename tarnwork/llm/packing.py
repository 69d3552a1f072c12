"""Texts packed into windows of fixed size, by vector bin packing.

A text's size is a vector: tokens of a public tokenizer, segments (one), and
loss-bearing tokens, which are those of its author's own words: quoted lines,
log lines, table rows and code blocks are copied matter and bear none. Texts longer than a window are cut into whole windows and
a rest; everything else stays whole. Pieces are dealt to shards of bounded
size by a hash of their key; in each shard windows are filled one by one with
the piece whose size has the largest dot product with the room left, each
dimension weighted by how scarce it is. The pieces of ill-filled windows of
all shards are packed again together, round by round.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.runtime import staged

#: The folder of public tokenizers, and the vocabulary used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Tasks of a round; each packs one shard, or several one after the other. Their
#: number is set, as shards are small in bytes and would be put together in one.
MOST_TASKS = 20_000
#: Loss is rounded up to multiples of this, so that few sizes differ.
STEP = 8
# Fixed value: how that vocabulary cuts a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Window:
    """Limits of a window, and how it is packed: ``shard`` is the most pieces
    packed at once, ``full`` the share of tokens from which a window isn't
    packed again, ``rounds`` how often the others are. A piece that alone
    passes the limit of loss takes all of it and shares its window with pieces
    of no loss only."""

    tokens: int = 2048
    segments: int = 24
    loss: int = 1984
    shard: int = 8192
    full: float = 0.98
    rounds: int = 2


#: A line of copied matter: a quote, a table row, or a log line.
_COPIED = r"[^\S\n]*(?:>|\||\[?(?:\d{4}-\d\d-\d\d[T ])?\d{1,2}:\d\d(?::\d\d(?:[.,]\d+)?)?Z?\]?[^\S\n].*?\w=)"
COPIED, COPIED_AT = re.compile(_COPIED), re.compile("^" + _COPIED, re.M)


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, at in ranks.items():
        size[at] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def copied_bytes(text: str) -> np.ndarray:
    """Where copied matter begins and ends in the UTF-8 form of a text, in turn."""
    if "```" not in text and not COPIED_AT.search(text):
        return np.zeros(0, dtype=np.int64)
    out, at, fence, before = [], 0, False, False
    for line in text.split("\n"):
        mark = line.lstrip()[:3] == "```"
        now = fence or mark or COPIED.match(line) is not None
        fence ^= mark
        if now != before:
            out.append(at)
            before = now
        at += len(line.encode("utf-8", "replace")) + 1
    return np.array(out, dtype=np.int64)


def loss_of(ids: list[int], size: np.ndarray, text: str, window: int) -> list[int]:
    """Loss-bearing tokens of each piece of ``window`` tokens: those that begin
    in no copied matter, but for a piece's first, which nothing foretells."""
    edges = copied_bytes(text)
    if not len(edges):  # all are own words
        return [min(window, len(ids) - at) - 1 for at in range(0, len(ids), window)] or [0]
    begins = np.r_[0, np.cumsum(size[ids])[:-1]] if ids else np.zeros(0, dtype=np.int64)
    own = np.searchsorted(edges, begins, side="right") % 2 == 0
    own[::window] = False
    return np.add.reduceat(own, np.arange(0, len(own), window)).tolist() if len(own) else [0]


def token_counts(docs: DataFrame, key: str, text: str, size: int = Window.tokens, *, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``key``, ``tokens``, ``losses``) of every text: its tokens, and the
    loss-bearing ones of each piece of ``size``. Null texts have nulls. The
    vocabulary's file must be in ``folder`` on every executor."""
    path = f"{folder.rstrip('/')}/{vocabulary}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sizes = _encoder(path)
        for pdf in batches:
            tokens, losses = [], []
            for t in pdf.iloc[:, 1]:
                ids = encoder.encode_ordinary(t) if isinstance(t, str) else None
                tokens.append(None if ids is None else len(ids))
                losses.append(None if ids is None else loss_of(ids, sizes, t, size))
            yield pd.DataFrame({"key": pdf.iloc[:, 0], "tokens": pd.array(tokens, dtype="Int64"), "losses": losses})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInPandas(run, f"key {kind}, tokens bigint, losses array<bigint>").select(F.col("key").alias(key), "tokens", "losses")


def pieces(counts: DataFrame, key: str, size: int) -> DataFrame:
    """One row per piece: ``piece`` (from 0), ``first`` (its first token),
    ``tokens``, ``loss``. A text that fits is one piece; a longer one gives whole
    windows and a rest. Texts of no tokens give one piece of none."""
    cut = F.posexplode("losses").alias("piece", "loss")
    first = F.col("piece").cast("long") * size
    return counts.where("tokens IS NOT NULL").select(key, "tokens", cut).select(key, "piece", first.alias("first"), F.least(F.col("tokens") - first, F.lit(size)).alias("tokens"), "loss")


def fill(sizes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The window number of each piece, by the dot-product heuristic.

    ``sizes``: (pieces, dimensions), each at most ``room``. A window takes,
    again and again, the piece that fits and has the largest product of its
    size and the room left (both as shares), weighted by the total demand of
    each dimension; of pieces of one size the one that stands first goes first.
    """
    out = np.full(len(sizes), -1, dtype=np.int64)
    if not len(sizes):
        return out
    # Pieces of one size are one entry with a count.
    kinds, which = np.unique(sizes, axis=0, return_inverse=True)
    members = np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1])
    count = np.array([len(m) for m in members])
    share = kinds / room
    weight = (share * count[:, None]).sum(axis=0)
    weighted = share * (weight / weight.max())
    open_, bin_ = np.arange(len(kinds)), 0
    while len(open_):
        rest, at = room.astype(np.float64), open_
        while True:
            at = at[(kinds[at] <= rest).all(axis=1)]
            if not len(at):
                break
            best = at[np.argmax(weighted[at] @ (rest / room))]
            count[best] -= 1
            out[members[best][-1 - count[best]]] = bin_
            rest = rest - kinds[best]
            if not count[best]:
                at, open_ = at[at != best], open_[open_ != best]
        if (rest == room).all():
            raise ValueError("a piece is larger than a window")
        bin_ += 1
    return out


def _packer(key: list[str], cols: list[str], room: np.ndarray, how: Window, round_: int, again: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # In order of the key, so that a task that is run again packs alike.
        pdf = pdf.sort_values([*key, "tokens", "loss"], kind="stable").reset_index(drop=True)
        sizes = np.column_stack([pdf["tokens"], np.ones(len(pdf), dtype=np.int64), np.minimum(-(-pdf["loss"] // STEP) * STEP, how.loss)])
        at = fill(sizes, room)
        used = np.bincount(at, pdf["tokens"])
        shard = pdf["shard"].iloc[0]
        pdf["window"] = [f"{round_}-{shard}-{b}" for b in at]
        pdf["again"] = (used[at] < how.full * how.tokens) & again
        return pdf[[*cols, "window", "again"]]

    return run


def pack(items: DataFrame, key: list[str], how: Window = Window()) -> DataFrame:
    """The items (columns ``key``, ``tokens``, ``loss``) with their ``window``
    (text, the same for all pieces of a window).

    Items of no tokens take no room and get a null window. Every other item
    gets exactly one; for one of more tokens than a window that is its own.
    Equal items are all placed. An empty table gives an empty result.
    """
    room = np.array([how.tokens, how.segments, how.loss])
    cols = [*key, "tokens", "loss"]
    todo = items.select(*cols)
    none = todo.where("tokens = 0").select(*cols, F.lit(None).cast("string").alias("window"))
    # A piece of a whole window is one on its own.
    whole = todo.where(F.col("tokens") >= how.tokens).select(*cols, F.concat(F.lit("whole-"), F.concat_ws("-", *(F.col(k).cast("string") for k in key))).alias("window"))
    todo = todo.where((F.col("tokens") > 0) & (F.col("tokens") < how.tokens))
    done = none.unionByName(whole)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema.fields)
    for r in range(how.rounds + 1):
        count = todo.count()
        if not count:
            break
        shards = -(-count // how.shard)
        last = r == how.rounds or (r > 0 and shards == 1)
        again = not last and shards > 1

        salted = F.pmod(F.xxhash64(*key, F.lit(r)), F.lit(shards)).cast("int")
        packed = staged(todo.withColumn("shard", salted).repartition(min(shards, MOST_TASKS), "shard").groupBy("shard").applyInPandas(_packer(key, cols, room, how, r, again), f"{kinds}, window string, again boolean"), "packed")
        done = done.unionByName(packed.where("NOT again").select(*cols, "window"))
        todo = packed.where("again").select(*cols)
        if not again:
            break
    return done


def windows(docs: DataFrame, key: str, text: str, how: Window = Window(), *, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``key``, ``piece``, ``first``, ``tokens``, ``loss``, ``window``) of every
    text that isn't null. Texts that only repeat are packed each."""
    counts = staged(token_counts(docs, key, text, how.tokens, folder=folder, vocabulary=vocabulary), "tokens")
    packed = pack(pieces(counts, key, how.tokens), [key, "piece"], how)
    return packed.withColumn("first", F.col("piece").cast("long") * how.tokens).select(key, "piece", "first", "tokens", "loss", "window")


def filling(packed: DataFrame, size: int) -> DataFrame:
    """One row: ``windows``, ``tokens``, the ``least`` windows that could hold
    them, and the ``unused`` share of the windows' room."""
    n = packed.groupBy("window").agg(F.sum("tokens").alias("t")).where("window IS NOT NULL")
    s = n.agg(F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    return s.select("windows", "tokens", F.ceil(F.col("tokens") / size).alias("least"), F.round(1 - F.col("tokens") / (F.col("windows") * size), 6).alias("unused"))


def broken_limits(docs: DataFrame, key: str, text: str, packed: DataFrame, how: Window = Window()) -> DataFrame:
    """One row that tells whether a packing is right: ``texts``, ``missing`` and
    ``repeated`` pieces, pieces ``cut_short``, windows that pass a limit
    (``over_tokens``, ``over_segments``, ``over_loss``), and whether fewer than
    one window in fifty could have been saved (``tight``)."""
    mine = packed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("kinds"), F.max("piece").alias("last"), F.count_if(F.col("tokens") < how.tokens).alias("rests"))
    met = docs.where(F.col(text).isNotNull()).select(key).join(mine, key, "left")
    of_texts = met.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.coalesce(F.col("last") + 1 - F.col("kinds"), F.lit(1))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.col("n") - F.col("kinds")), F.lit(0)).alias("repeated"), F.count_if(F.col("rests") > 1).alias("cut_short"))
    w = packed.where("window IS NOT NULL").groupBy("window").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("s"), F.sum(F.least("loss", F.lit(how.loss))).alias("l"))
    of_windows = w.agg(F.count_if(F.col("t") > how.tokens).alias("over_tokens"), F.count_if(F.col("s") > how.segments).alias("over_segments"), F.count_if(F.col("l") > how.loss).alias("over_loss"), (F.coalesce(F.sum("t"), F.lit(0)) >= F.lit(0.98 * how.tokens) * (F.count(F.lit(1)) - 1)).alias("tight"))
    return of_texts.crossJoin(of_windows)  # one row each
