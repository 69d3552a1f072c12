import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import packing as pk


def used(rows):
    out = {}
    for r in rows:
        if r.window is not None:
            t, s, loss = out.get(r.window, (0, 0, 0))
            out[r.window] = (t + r.tokens, s + 1, loss + r.loss)
    return out


def test_fill_keeps_all_limits_and_is_close_to_the_bound():
    r = np.random.default_rng(5)
    t = np.clip(r.lognormal(5.5, 1, 3000).astype(int), 1, 2047)
    sizes, room = np.column_stack([t, np.ones(3000, int), t // 2]), np.array([2048, 24, 1023])
    at = pk.fill(sizes, room)
    total = np.zeros((at.max() + 1, 3), int)
    np.add.at(total, at, sizes)
    assert (total <= room).all() and (at >= 0).all()
    assert at.max() + 1 <= 1.08 * max(sizes.sum(axis=0) / room) + 1
    assert len(pk.fill(sizes[:0], room)) == 0
    with pytest.raises(ValueError):
        pk.fill(np.array([[3000, 1, 1]]), room)


def test_pack_in_shards_and_rounds(spark):
    r = np.random.default_rng(6)
    rows = [(i, int(x), max(0, int(x) - 1)) for i, x in enumerate(np.clip(r.lognormal(5.5, 1, 2000).astype(int), 0, 2048))] + [(9001, 0, 0), (9002, 2048, 2047)]
    df = spark.createDataFrame(rows, "id long, tokens long, loss long").withColumns({"shard": F.lit("x"), "window": F.lit("y"), "again": F.lit(1)})
    how = pk.Window(shard=300, segments=12, loss=2048)
    got = pk.pack(df, ["id"], how).collect()
    assert sorted(x.id for x in got) == sorted(x[0] for x in rows)
    u = used(got)
    assert all(t <= 2048 and s <= 12 and loss <= 2048 for t, s, loss in u.values())
    assert len(u) <= 1.08 * sum(x[1] for x in rows) / 2048 + 2
    assert {x.id for x in got if x.window is None} == {x[0] for x in rows if x[1] == 0}
    assert pk.pack(df.limit(0), ["id"], how).count() == 0


def test_texts_whole_or_cut_into_full_windows(spark):
    texts = ["short", None, "", "  ", "word " * 5000, "短い文。" * 50, "<|endoftext|> x", "same", "same", "a" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit(1)).withColumn("key", F.lit(2))
    got = pk.windows(df, "doc_id", "text", pk.Window(tokens=512, loss=512)).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    count = {r.doc_id: r.tokens for r in pk.token_counts(df, "doc_id", "text").collect()}
    assert 1 not in by and count[1] is None and by[2][0].window is None and count[6] > 1
    for i, xs in by.items():
        xs.sort(key=lambda x: x.piece)
        assert sum(x.tokens for x in xs) == count[i] and [x.first for x in xs] == [512 * k for k in range(len(xs))]
        assert all(x.tokens == 512 for x in xs[:-1]) and (len(xs) == 1 or count[i] > 512)
    assert all(t <= 512 for t, _, _ in used(got).values())
    fill = pk.filling(spark.createDataFrame(got), 512).first()
    assert fill.windows == len(used(got)) and fill.tokens == sum(c or 0 for c in count.values())


def test_loss_is_borne_by_own_words_only():
    encoder, size = pk._encoder(f"{pk.TOKENIZERS}/{pk.VOCABULARY}")
    text = "It ran über Nacht.\n> quoted words of another\nThen it ended.\n```\nselect 1\n```\n| a | b |\n12:30:01.5 level=info n=3\nDone 時計.\n"
    ids = encoder.encode_ordinary(text)
    assert b"".join(encoder.decode_single_token_bytes(i) for i in ids).decode() == text
    begins, at = [], 0
    for i in ids:
        begins.append(at)
        at += size[i]
    own = [(a, b) for a, b in ((text.encode().find(x.encode()), text.encode().find(x.encode()) + len(x.encode()) + 1) for x in ("It ran über Nacht.", "Then it ended.", "Done 時計."))]
    want = [any(a <= x < b for a, b in own) or x >= len(text.encode()) for x in begins]
    for window in (7, 1000):
        flags = [w and i % window > 0 for i, w in enumerate(want)]
        assert pk.loss_of(ids, size, text, window) == [sum(flags[i : i + window]) for i in range(0, len(ids), window)]
    assert pk.loss_of([], size, "", 7) == [0] and sum(pk.loss_of(ids, size, text, 1000)) < len(ids) - 20


@pytest.mark.parametrize(("limit", "how"), [("segments", pk.Window(segments=8)), ("loss", pk.Window(loss=1400))])
def test_each_limit_binds(spark, limit, how):
    """Without the limit windows would pass it; with it none does, and little room is lost."""
    r = np.random.default_rng(8)
    t = np.clip(r.lognormal(5.5, 1, 1500).astype(int), 1, 1300)
    loss = np.where(r.random(1500) < 0.4, 0, t)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(t, loss, strict=True))], "id long, tokens long, loss long")
    free = used(pk.pack(df, ["id"], pk.Window(segments=10**6, loss=2048)).collect())
    held = used(pk.pack(df, ["id"], how).collect())
    at, most = {"segments": (1, how.segments), "loss": (2, how.loss)}[limit]
    assert sum(u[at] > most for u in free.values()) > len(free) / 20
    assert all(u[at] <= most for u in held.values())
    assert len(held) <= 1.2 * max(t.sum() / 2048, loss.sum() / how.loss, 1500 / how.segments) + 1


def test_broken_limits_are_told(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "doc_id long, text string")
    rows = [(1, 0, 0, 2048, 2047, "w"), (1, 1, 2048, 30, 20, "v"), (2, 0, 0, 2030, 5, "v"), (2, 0, 0, 2030, 5, "u"), (4, 1, 2048, 9, 9, None)]
    packed = spark.createDataFrame(rows, "doc_id long, piece int, first long, tokens long, loss long, window string")
    got = pk.broken_limits(docs, "doc_id", "text", packed).first()
    assert (got.texts, got.missing, got.repeated, got.over_tokens, got.over_segments, got.over_loss) == (3, 1, 1, 1, 0, 0)
