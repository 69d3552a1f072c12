"""Texts that were cut off, by a corpus vocabulary trie and length evidence.

One pass over the texts gathers, batch by batch and summed up over all, the
corpus vocabulary (each word but the last of a text, with how often it goes on
within its line, ends a sentence, or ends a line bare), abbreviations, and the
shapes of lines that stand without a full stop; and for every text how it ends.

A text is flagged on evidence only, of which there are four kinds:

- ``word``: the vocabulary's trie of letters. The final word stands nowhere
  else and is a proper prefix of known words.
- ``phrase``: the trie's next level, of words. The final word is known and
  goes on in the corpus more often than lines end on it, or the last line is a
  proper prefix of a known line that is at least as frequent; and the line is
  not known to be whole.
- ``length``: the text is as long as its source's limit, which is a length that
  the source has far more often than lengths nearby.
- ``open``: a mark of the cut, or a code block, table row or log line not closed.

The form of an ending only excuses: a full stop, a closed row, block or log
line, a sign-off, an item among items, a link, an emoji, or a whole line that
other texts have too.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.runtime import staged

# Marks that tools leave where they cut a text.
CUT_MARK = re.compile(r"(?:[\[(<{]\s*(?:\.{2,}|…|truncated|cut|snip|clipped|more|continued|gekürzt|tronqué|truncado|省略)\.{0,3}\s*[\])>}])\s*$", re.I)
DOTS = re.compile(r"(?:\.{2,}|…)[\"'”»)\]]*\s*$")
TERMINAL = re.compile(r"[.!?。！？؟][\"'”’»)\]」』*_`]*$")
CLOSERS = "\"'”’»)]」』*_`"
BULLET = re.compile(r"^\s*(?:[-+*•–]|\d{1,3}[.)])\s+")
LOG_LINE = re.compile(r"^\s*\[?(?:\d{4}-\d\d-\d\d[T ])?\d{1,2}:\d\d(?::\d\d(?:[.,]\d+)?)?Z?\]?\s.*\b\w+=")
SIGN_OFF = re.compile(r"^\s*(?:--|—|–)\s?\S")
#: Where a token falls apart that no space divides: paths and values, and clauses of scripts without spaces.
WITHIN, CLAUSE = re.compile(r"[/\\=]"), re.compile(r"([。、！？])")
WORD = re.compile(r"[^\W_](?:[\w'’-]*\w)?")
# Each run of letters is tried once, from its start, so that long lines take time in proportion.
DIGITS, NAMES = re.compile(r"\d+"), re.compile(r"(?<![A-Za-z0-9-])[A-Za-z0-9-]*+_[\w-]*|(?<![A-Za-z])(?<![A-Za-z]-)[A-Za-z]++(?:-[A-Za-z]++)*+-?\d[\w-]*", re.A)
#: Longer lines are known by a digest of their shape (and have no place in the trie of lines).
WHOLE_LINE = 400
#: Abbreviations and limits up to which they are broadcast.
FEW = 50_000
#: A line is known to be whole if it stands within other texts at least twice, and once for so many times that its
#: last word goes on; or if at least five different texts end on it, and so many times more than end one word
#: before or after it, as texts cut anywhere do.
GOES_ON, SPIKE = 20_000, 4


def shape(line: str) -> str:
    """A line with numbers and names of things (held together by _ or with digits)
    blanked; a digest of that for a very long one."""
    out = DIGITS.sub("0", NAMES.sub("K", " ".join(line.split())))
    return out if len(out) <= WHOLE_LINE else f"\x00{xxhash.xxh128_hexdigest(out.encode('utf-8', 'replace'))}"


def core(token: str) -> str:
    """The word in a token, lower case; empty if there is none."""
    m = WORD.search(token)
    return token[m.start() :].rstrip(".,;:!?。！？…\"'”’»)]」』*`").lower() if m else ""


def ending(text: str) -> dict:
    """How a text ends; see the fields of :data:`ENDINGS`."""
    body = text.rstrip()
    lines = body.split("\n")
    fences = sum(1 for x in lines if x.lstrip().startswith("```"))
    last = lines[-1].strip()
    out = {"settled": None, "dots": False, "form": "line", "word": "", "shape": "", "abbr": ""}
    if not body:
        return out | {"settled": False}
    if fences % 2:
        return out | {"settled": True}
    if last.startswith("```"):
        return out | {"settled": False}
    if CUT_MARK.search(body):
        return out | {"settled": True}
    if last.startswith("|"):
        return out | {"settled": not last.endswith("|")}
    end = body[-1]
    if unicodedata.category(end) in ("So", "Sk", "Cs") or end in "️‍":
        return out | {"settled": False}
    tokens = last.split()
    final = tokens[-1]
    out["dots"] = bool(DOTS.search(body))
    if out["dots"]:
        bare = DOTS.sub("", last).rstrip()
        return out | {"word": core(CLAUSE.split(bare.split()[-1])[-1]) if bare.split() else "", "shape": shape(last)}
    if LOG_LINE.match(last):
        closed = last.count('"') % 2 == 0 and re.search(r"\w=(?:\"[^\"]*\"|[^\s\"=]+)$", last[last.rfind(" ", 0, max(0, last.rfind("="))) + 1 :])
        if not closed:
            return out | {"settled": True}
        return out | {"form": "log", "word": core(final.rpartition("=")[2]) if '"' not in final else ""}
    if TERMINAL.search(last):
        stripped = final.rstrip(CLOSERS)
        return out | {"form": "closed", "abbr": stripped.lower() if stripped.endswith(".") else ""}
    out["word"], out["shape"] = core(CLAUSE.split(WITHIN.split(final)[-1])[-1]), shape(last)
    item = BULLET.match(last)
    if item and last[item.end() : item.end() + 1].islower() and any((m := BULLET.match(x)) and not TERMINAL.search(x.rstrip()) for x in lines[-12:-1]):
        out["form"] = "item"
    elif SIGN_OFF.match(last) and len(tokens) <= 8:
        out["form"] = "sign-off"
    elif len(tokens) <= 4 and re.search(r"(?:https?://|\w/\w+/)\S+$", last):
        out["form"] = "link"
    return out


FOUND = "kind string, name string, a bigint, b bigint, c bigint, doc_id {id}, source string, chars bigint, bytes bigint, digest bigint, settled boolean, dots boolean, form string, word string, shape string, abbr string"


def gather(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row per text (kind ``end``; ``settled``: cut or not by open or closed
    form alone) and, per batch, counts: ``word`` (a: goes on in its line, b: at
    a sentence's end, c: at a bare line's end), ``abbr`` (a: a small letter or
    digit follows, b: anything else) and ``line`` (a: within a text)."""
    src = docs.select(F.col(key), F.col(text).cast("string"), F.col(source).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf.columns = ["doc_id", "text", "source"]
            tokens: Counter = Counter()
            bare: Counter = Counter()
            lines: Counter = Counter()
            abbr: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            ends = []
            for doc, t, s in zip(pdf["doc_id"], pdf["text"], pdf["source"], strict=True):
                if t is None or not isinstance(t, str):
                    continue
                raw = t.encode("utf-8", "replace")
                ends.append({"doc_id": doc, "source": s, "chars": len(t), "bytes": len(raw), "digest": xxhash.xxh64_intdigest(raw) - (1 << 63), **ending(t)})
                toks = t.split()
                tokens.update(toks[:-1])
                for x, y in zip(toks, toks[1:]):
                    if x[-1] == "." and x[0].isalpha():
                        abbr[x.lower()][not (y[0].islower() or y[0].isdigit())] += 1
                fence = False
                for x in t.rstrip().split("\n")[:-1]:
                    x = x.strip()
                    if x.startswith("```"):
                        fence = not fence
                    elif x and not fence and x[0] != "|" and not TERMINAL.search(x, max(0, len(x) - 16)) and not LOG_LINE.match(x):
                        lines[x] += 1
                        bare[x.rsplit(None, 1)[-1]] += 1
            words: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
            for x, n in tokens.items():
                if not x.isascii() and CLAUSE.search(x):
                    *clauses, x = CLAUSE.split(x)  # clauses and the marks behind them in turn
                    for clause, mark in zip(clauses[::2], clauses[1::2], strict=True):
                        if w := core(clause):
                            words[w][mark != "、"] += n
                w = core(x)
                if w:
                    mine, ended = words[w], bare[x]
                    mine[2] += ended
                    mine[1 if TERMINAL.search(x, max(0, len(x) - 16)) else 0] += n - ended
                    if "/" in w or "=" in w or "\\" in w or '"' in w:
                        for part in re.split(r"[/\\=\"]", w):
                            if part and part != w:
                                words[part.strip(".,;:!?)]")][0] += n
            shapes: Counter = Counter()
            for x, n in lines.items():
                shapes[shape(x)] += n
            rows = [("word", w, *n) for w, n in words.items() if w] + [("abbr", w, *n, 0) for w, n in abbr.items() if n[0]] + [("line", x, n, 0, 0) for x, n in shapes.items()]
            out = pd.concat([pd.DataFrame(ends).assign(kind="end", name=None, a=0, b=0, c=0) if ends else pd.DataFrame(), pd.DataFrame(rows, columns=["kind", "name", "a", "b", "c"])], ignore_index=True)
            if len(out):
                out = out.reindex(columns=[c.split()[0] for c in FOUND.split(", ")])
                for c in ("chars", "bytes", "digest"):
                    out[c] = out[c].astype("Int64")
                out["settled"], out["dots"] = out["settled"].astype("boolean"), out["dots"].astype("boolean")
                yield out

    return src.mapInPandas(run, FOUND.format(id=docs.schema[key].dataType.simpleString()))


def limits(ends: DataFrame, length: str) -> DataFrame:
    """(source, length) that far more different texts of a source have than
    lengths nearby (within 16): eight times their mean, and at least five."""
    own = ends.select("source", length, "digest").distinct().groupBy("source", length).agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("source").orderBy(length).rangeBetween(-16, 16)
    around = (F.sum("n").over(near) - F.col("n")) / 32
    return own.withColumn("around", around).where((F.col("n") >= 5) & (F.col("n") >= 8 * F.greatest("around", F.lit(0.25)))).select("source", length)


def _few(df: DataFrame) -> bool:
    """Whether a (written) table has so few rows that it, and what is made of them, is broadcast."""
    return df.count() <= FEW


def _hinted(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def continued(finals: DataFrame, known: DataFrame, name: str, head: int = 4, few: bool = False) -> DataFrame:
    """(``name``, ``below``) of those ``finals`` that are inner nodes of the trie
    of ``known`` (``name``, ``n``): proper prefixes of its entries, with the
    count of the most frequent entry below.

    The trie is built only where a final can meet it: of entries that begin
    like a final, and of those the prefixes as long as a final of that beginning.
    With ``few`` finals their beginnings go to the entries, not the other way.
    """
    heads = finals.select(F.substring(name, 1, head).alias("head"), F.length(name).alias("size")).distinct()
    short = heads.where(F.col("size") < head).select("head", F.array("size").alias("sizes"))
    heads = heads.where(F.col("size") >= head).groupBy("head").agg(F.collect_set("size").alias("sizes"))  # lengths of words or lines
    meets = known.select(name, "n", F.substring(name, 1, head).alias("head")).join(_hinted(heads, few), "head")
    nodes = meets.select(F.explode(F.filter("sizes", lambda i: i < F.length(name))).alias("size"), name, "n")
    by_start = [F.struct(F.substring(name, 1, i).alias("head"), F.lit(i).alias("size")) for i in range(1, head)]
    brief = known.where(F.length(name) > 1).select(F.explode(F.array(*by_start)).alias("p"), name, "n").where(F.col("p.size") < F.length(name)).select("p.head", "n")
    brief = brief.join(_hinted(short.select("head"), few), "head", "left_semi").groupBy(F.col("head").alias(name)).agg(F.max("n").alias("below"))
    deep = nodes.select(F.expr(f"substring({name}, 1, size)").alias(name), "n").groupBy(name).agg(F.max("n").alias("below"))
    return deep.unionByName(brief).join(_hinted(finals.select(name).distinct(), few), name, "left_semi")


def whole_lines(ends: DataFrame, within: DataFrame) -> DataFrame:
    """(shape, as_last, within, before, after) of the shapes on which texts end:
    how many different texts do, how often they are lines within texts, and how
    many different texts end a word before or a word after."""
    last = ends.where("shape != ''").select("shape", "digest").distinct().groupBy("shape").agg(F.count(F.lit(1)).alias("as_last"))
    parent = F.when(F.col("shape").contains(" "), F.regexp_replace("shape", " [^ ]*$", ""))
    last = last.withColumn("parent", parent)
    after = last.where("parent IS NOT NULL").groupBy(F.col("parent").alias("shape")).agg(F.sum("as_last").alias("after"))
    before = last.select(F.col("shape").alias("parent"), F.col("as_last").alias("before"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return last.join(before, "parent", "left").join(after, "shape", "left").join(within, "shape", "left").select("shape", "as_last", zero("within"), zero("before"), zero("after"))


def judge(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """A row per text that isn't null: ``key``, ``source``, ``at_limit`` (its
    length is a limit of its source), ``cut_word`` (verdict of the trie of
    letters), ``evidence`` (see the module; the first that holds) and ``cut``.

    Blank texts are never cut. Repeated texts count once as evidence, so
    copies of a cut text don't make its ending known; each document is judged.
    Words count in any case of letters, words and lines of any length. Extra
    columns aren't read; an empty table gives an empty result.
    """
    all_ = staged(gather(docs, key, text, source), "endings")
    ends = all_.where("kind = 'end'").drop("kind", "name", "a", "b", "c")
    counts = all_.where("kind != 'end'").groupBy("kind", "name").agg(*(F.sum(c).alias(c) for c in "abc"))
    counts = staged(counts, "vocabulary")
    words = counts.where("kind = 'word'").select(F.col("name").alias("word"), (F.col("a") + F.col("b") + F.col("c")).alias("n"), "a", "b", "c")
    # Names and numbers that are seen once are judged as names and numbers: two rows at most.
    named, number = F.col("word").rlike("_|[0-9]"), F.col("word").rlike("^[0-9.,:]+$")
    kind_of = F.when(number, "0").when(named, "K")
    kinds = words.where(named).groupBy(kind_of.alias("word_kind")).agg(F.sum("a").alias("kind_a"), F.sum("b").alias("kind_b"), F.sum("c").alias("kind_c"))
    # What isn't settled by its form; the others, most texts, take no part in the joins on words and lines.
    looked_up = F.col("settled").isNull() & (F.col("dots") | F.col("form").isin("line", "item", "sign-off", "link"))
    open_ = ends.where(looked_up).select("doc_id", "word", "shape", "digest")

    finals = staged(open_.where("word != ''").select("word").distinct(), "words")
    few = _few(finals)
    there = words.join(_hinted(finals, few), "word")
    known = staged(finals.join(there, "word", "left").withColumn("word_kind", kind_of), "finals")
    trie = continued(known.where("n IS NULL").select("word"), words.select("word", "n"), "word", few=few)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    known = known.join(F.broadcast(kinds), "word_kind", "left").join(trie, "word", "left").select("word", zero("n"), *(F.coalesce(x, F.when(F.col("n").isNull(), F.col(f"kind_{x}")), F.lit(0)).alias(x) for x in "abc"), F.col("below").isNotNull().alias("goes_on"))

    within = counts.where("kind = 'line'").select(F.col("name").alias("shape"), F.col("a").alias("within"))
    lines = staged(whole_lines(open_, within), "lines")
    listed = within.where("within >= 2 AND length(shape) >= 2").select("shape", F.col("within").alias("n"))
    few_lines = _few(lines)
    below = continued(lines.select("shape"), listed, "shape", 12, few_lines)
    line = lines.join(below, "shape", "left").select("shape", "as_last", "within", ((F.col("as_last") >= 5) & (F.col("as_last") >= SPIKE * F.greatest("before", "after"))).alias("spike"), (F.coalesce("below", F.lit(0)) >= F.col("as_last") + F.col("within")).alias("carried_on"), F.col("below").isNotNull().alias("line_goes_on"))

    abbr = counts.where("kind = 'abbr' AND a >= 2 AND a > b").select(F.col("name").alias("abbr"), F.lit(True).alias("is_abbr"))
    by_chars = limits(ends, "chars").select("source", F.col("chars").alias("length"), F.lit("chars").alias("of"))
    by_bytes = limits(ends.where("bytes > chars"), "bytes").select("source", F.col("bytes").alias("length"), F.lit("bytes").alias("of"))
    limit = staged(by_chars.unionByName(by_bytes), "limits")
    abbr = staged(abbr, "abbreviations")

    # Texts without a final word or line meet nothing; a key of their own each keeps them out of one task.
    own = F.concat(F.lit("\x00"), F.xxhash64("doc_id").cast("string"))
    keyed = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise(own).alias(c)
    judged = ends.where(looked_up).withColumns({c: keyed(c) for c in ("word", "shape")}).join(_hinted(known, few), "word", "left").join(_hinted(line, few_lines), "shape", "left")
    rest = ends.where(~looked_up)
    full = judged.unionByName(rest.withColumns({f.name: F.lit(None).cast(f.dataType) for f in judged.schema.fields if f.name not in rest.columns}))
    full = full.withColumn("abbr", keyed("abbr"))
    # Broadcast only if counted and few; else a join, whose hot keys adaptive execution splits.
    full = full.join(_hinted(abbr, _few(abbr)), "abbr", "left")
    few_limits = _few(limit)
    for of in ("chars", "bytes"):
        mine = limit.where(F.col("of") == of).select("source", F.col("length").alias(of), F.lit(True).alias(f"by_{of}"))
        full = full.join(_hinted(mine, few_limits), ["source", of], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n", "a", "b", "c", "within", "as_last")}
    at_limit = yes(F.coalesce("by_chars", "by_bytes"))
    cut_word = F.col("settled").isNull() & ~F.col("word").startswith("\x00") & (n["n"] == 0) & yes(F.col("goes_on")) & ~F.col("word").rlike("^[0-9.,:]+$")
    known_line = ((n["within"] >= 2) & (n["within"] * GOES_ON >= n["a"]) | yes(F.col("spike"))) & ~yes(F.col("carried_on"))
    plain = F.col("form") == "line"
    # A line that is known to be whole, but also to go on, was cut if the text is as long as its source's limit.
    overruled = at_limit & yes(F.col("line_goes_on"))
    # Before dots, a word on which sentences mostly end is the end of a thought.
    goes_on = F.when(F.col("dots"), n["a"] >= n["b"]).otherwise(plain & (n["a"] + n["b"] > n["c"]) | yes(F.col("carried_on")) | overruled)
    phrase = (~known_line | overruled) & goes_on & (n["a"] + n["b"] > 0)
    evidence = (
        F.when(F.col("settled"), "open")
        .when(F.col("settled").isNotNull() | (F.col("form") == "log"), None)
        .when(F.col("form") == "closed", F.when(yes(F.col("is_abbr")), "phrase"))
        .when(cut_word, "word")
        .when(phrase, "phrase")
        .when(F.col("form").isin("line", "item") & at_limit & ~known_line, "length")
    )
    out = full.withColumn("__evidence", evidence)
    return out.select(F.col("doc_id").alias(key), "source", at_limit.alias("at_limit"), cut_word.alias("cut_word"), F.col("__evidence").alias("evidence"), F.col("__evidence").isNotNull().alias("cut"), "form", "dots")


def by_source(judged: DataFrame) -> DataFrame:
    """How often each source cuts: ``docs``, ``cut``, ``at_limit`` and ``share``."""
    n = judged.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if("cut").alias("cut"), F.count_if("at_limit").alias("at_limit"))
    return n.withColumn("share", F.round(F.col("cut") / F.col("docs"), 6))
