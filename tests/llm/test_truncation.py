import random

import pytest
from pyspark.sql import functions as F

from tarnwork.llm import truncation as tr

SUBJECTS = ["The scheduler", "A slow worker", "Our night shift", "The retry clock", "One tenant", "The cleaner"]
VERBS = ["restarted", "inspected", "released", "postponed", "discarded", "measured"]
OBJECTS = ["the payment queue", "every stalled lease", "forty rows", "the broken outbox", "its own backlog"]
ENDS = ["after the failover", "before midnight", "without further notice", "during the import", "as planned"]


def sentence(r):
    return f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)} {r.choice(ENDS)}."


def corpus(n=400, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        body = " ".join(sentence(r) for _ in range(r.randint(3, 8)))
        lists = "\n".join(f"- {r.choice(['stale', 'nested', 'late'])} rows of {r.choice(['email_send', 'lead_score'])}" for _ in range(3))
        if i % 20 == 0:
            body = f"時計がずれていた。原因はまだ分からない。{body}"
        out.append((i, r.choice([body, f"{body}\n\n{lists}", f"{body}\n\nThanks, the ops team", f"{body}\n\nMore after the review..."]), "wiki"))
    return out


CASES = [
    ("The scheduler restarted the payment que", True),
    ("The scheduler restarted the payment", True),
    ("One tenant measured forty rows before mid", True),
    ("One tenant measured forty rows before midnight.", False),
    ("One tenant measured the...", True),
    ("One tenant measured the brok…", True),
    ("It was late. One tenant measured [...]", True),
    ("It was late. One tenant measured forty rows (truncated)", True),
    ("It ran.\n```\nselect 1", True),
    ("It ran.\n```\nselect 1\n```", False),
    ("It ran.\n\n- stale rows of email_send\n- nested rows of lead_score", False),
    ("It ran.\n\n- stale rows of email_send\n- nested rows of lead_sc", True),
    ("It ran.\n\n- stale rows of email_send\n- nested rows of", True),
    ("It ran.\n\nThanks, the ops team", False),
    ("It ran.\n\nMore after the review...", False),
    ("It ran.\n\n| a | b |\n|---|---|\n| 1 | 2 |", False),
    ("It ran.\n\n| a | b |\n|---|---|\n| 1 | 2", True),
    ('12:30:01.123 level=info queue=a msg="one two" n=12', False),
    ('12:30:01.123 level=info queue=a msg="one tw', True),
    ("It ran.\n\nDone 👍", False),
    ("It ran.\n\n-- the rota", False),
    ("時計がずれていた。", False),
    ("時計がずれていた。原因はまだ", True),
    ("(The scheduler restarted forty rows as planned.)", False),
    ("", False), ("   \n", False), (None, None), ("x" * 100_000, None),
    ("The scheduler restarted " + "forty rows and " * 20_000, True),
]


def judged(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"kind": F.lit("end"), "word": F.lit("w"), "cut": F.lit(1), "shape": F.lit("s"), "n": F.lit(1), "a": F.lit(1)})
    return {r.doc_id: r for r in tr.judge(df, "doc_id", "text", "source").collect()}


def test_endings(spark):
    rows = corpus() + [(10_000 + i, t, "mail") for i, (t, _) in enumerate(CASES)] + [(20_000 + i, "The scheduler restarted the payment", "copy") for i in range(30)]
    got = judged(spark, rows)
    wrong = [(t[:80] if t else t, want) for i, (t, want) in enumerate(CASES) if want is not None and got[10_000 + i].cut != want]
    assert wrong == []
    assert 10_000 + [t for t, _ in CASES].index(None) not in got
    assert all(got[20_000 + i].cut for i in range(30))  # copies don't make an ending known
    assert not any(got[i].cut for i in range(400))


def test_random_cuts_are_found_and_whole_texts_left_alone(spark):
    r = random.Random(5)
    whole = corpus(600, 3)
    cut = []
    for i, t, _ in whole[:200]:
        at = r.randint(20, len(t) - 2)
        cut.append((1000 + i, t[:at], "forum", t[at : at + 1], t[at - 1]))
    inside = [c for c in cut if not c[1].rstrip().endswith(".") and c[3] not in ".\n" and c[4] != "\n"]
    got = judged(spark, whole + [c[:3] for c in cut])
    assert sum(got[c[0]].cut for c in inside) >= 0.95 * len(inside)
    assert sum(got[i].cut for i, _, _ in whole) == 0


def test_limits(spark):
    rows = [(i, "x" * (100 + i % 37) + str(i), "a") for i in range(100)] + [(1000 + i, f"{i:04d}" + "y" * 496, "a") for i in range(20)] + [(2000 + i, "z" * 300, "a") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ends = tr.gather(df, "doc_id", "text", "source").where("kind = 'end'")
    assert [(r.source, r.chars) for r in tr.limits(ends, "chars").collect()] == [("a", 500)]


def test_by_source_and_empty(spark):
    df = spark.createDataFrame([(1, "It ran wild and", None), (2, "It ran and slept.", None)], "doc_id long, text string, source string")
    r = tr.by_source(tr.judge(df, "doc_id", "text", "source")).first()
    assert (r.source, r.docs, r.cut, r.share) == (None, 2, 1, 0.5)
    assert tr.judge(df.limit(0), "doc_id", "text", "source").count() == 0


@pytest.mark.parametrize(("line", "want"), [("- 12 rows of lead_score", "- 0 rows of K"), ("a\t b", "a b"), ("media_hiの71686件", "Kの0件")])
def test_shape(line, want):
    assert tr.shape(line) == want


def test_flags_come_from_the_tries_and_the_limits(spark, monkeypatch):
    """Without both tries and the limits only open forms are left."""
    r = random.Random(5)
    cut = [(1000 + i, t[: r.randint(20, len(t) - 2)], "forum") for i, t, _ in corpus(200, 3)]
    rows = corpus() + cut + [(3000, "It ran.\n```\nselect 1", "forum")]
    whole = {k for k, x in judged(spark, rows).items() if x.cut}
    none = lambda finals, known, name, head=4, few=False: finals.select(name, F.lit(1).alias("below")).limit(0)
    monkeypatch.setattr(tr, "continued", none)
    half = {k for k, x in judged(spark, rows).items() if x.cut}
    assert len(half) < len(whole) * 0.7  # no trie of letters
    monkeypatch.setattr(tr, "GOES_ON", 0)
    monkeypatch.setattr(tr, "limits", lambda ends, length: ends.select("source", length).limit(0))
    gather = tr.gather
    monkeypatch.setattr(tr, "gather", lambda *a: gather(*a).withColumns({c: F.lit(0).cast("bigint") for c in "abc"}))
    assert {k for k, x in judged(spark, rows).items() if x.cut} == {3000}


def test_fragments_that_recur_are_no_whole_lines(spark):
    """Many texts cut behind the same words don't make these known; a sign-off is."""
    r = random.Random(8)
    rows = corpus(300, 2)
    for i in range(400):
        t = f"It ran on day {i}.\n\nThe scheduler restarted forty rows during the import."
        at = r.randint(t.index("The"), len(t) - 2)
        rows.append((1000 + i, t[:at].rstrip() if r.random() < 0.9 else t, "mail"))
    rows += [(5000 + i, f"It ran on day {i}.\n\nBest from the night shift", "mail") for i in range(12)]
    got = judged(spark, rows)
    cut = {k for k, t, _ in rows if 1000 <= k < 5000 and not t.endswith(".")}
    assert sum(got[k].cut for k in cut) >= 0.99 * len(cut)
    assert not any(got[5000 + i].cut for i in range(12))


def test_long_words_and_lines(spark):
    word, line = "ab" * 60, "- " + " ".join(f"row{chr(97 + i % 26)}" for i in range(120))
    rows = corpus(100, 4) + [(1000 + i, f"It saw {word} and {line[2:]} run. {i}\n{line}\n{line}\nAll of {word} ran.", "wiki") for i in range(4)]
    rows += [(2000, f"It ran.\n\n{line}", "wiki"), (2001, f"It saw {word[:80]}", "wiki"), (2002, f"It ran.\n\n{line[:300]}", "wiki")]
    got = judged(spark, rows)
    assert (got[2000].cut, got[2001].cut, got[2001].evidence, got[2002].cut) == (False, True, "word", True)


def test_length_evidence_overrules_a_known_line(spark):
    """A text as long as its source's limit that ends on a line others have whole."""
    rows = corpus(200, 6) + [(900 + i, f"It ran {i}.\nstale rows\nstale rows\nIt did. The stale rows were {i}.", "wiki") for i in range(30)]
    pad = lambda i: f"Row {i:04d} is here. " + "It ran. " * 30 + "\n\nstale rows"
    rows += [(2000 + i, pad(i), "short") for i in range(12)] + [(3000, "It ran.\n\nstale rows", "wiki")]
    got = judged(spark, rows)
    assert all(got[2000 + i].at_limit for i in range(12)) and not got[3000].at_limit
    assert all(got[2000 + i].cut == (got[2000 + i].evidence is not None) for i in range(12)) and not got[3000].cut


def test_long_lines_take_time_in_proportion():
    for line in ("a" * 400_000, "a-" * 200_000, "_" * 400_000, "a1" * 200_000):
        tr.shape(line)
