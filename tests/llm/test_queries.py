import pytest
from pyspark.sql import functions as F

from tarnwork.llm import leakage as lk
from tarnwork.llm import queries as q
from tests.conftest import DATA
from tests.oracle import assert_same

SMALL = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_matches_sql(spark, name):
    assert_same(q.QUERIES[name](spark, str(SMALL)), q.SQL[name], SMALL)


def test_queries_without_sql_are_known():
    assert set(q.QUERIES) - set(q.SQL) == {"p6_windows", "p6_filling", "p7_found", "p7_paraphrases", "p7_items", "p8_found", "p8_sources"}


def test_bounded_percentiles_keep_their_bound(spark):
    key = ["level", "queue", "day"]
    exact, near = (q.QUERIES[n](spark, str(SMALL)) for n in ("p2_wait_percentiles", "p2_wait_bounded"))
    met = exact.alias("a").join(near.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key])
    off = F.greatest(*(F.abs(F.col(f"a.{t}") - F.col(f"b.{t}")) - 0.005 * F.abs(F.col(f"a.{t}")) for t in q.TARGETS))
    assert met.count() == exact.count() == near.count() and met.where((off > 0.5) | (F.col("a.n") != F.col("b.n"))).count() == 0


def test_windows_are_filled(spark):
    got = q.p6_filling(spark, str(SMALL)).first()
    windows = q.p6_windows(spark, str(SMALL))
    assert got.windows == windows.select("window").distinct().where("window IS NOT NULL").count()
    assert got.least <= got.windows <= 1.05 * got.least + 1


def test_leaks_match_an_alignment_of_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect()
    items = lk.Items([tuple(r) for r in spark.read.parquet(f"{SMALL}/eval_item.parquet").select("item_id", "text").collect()], lk.Leak())
    want = set()
    for d in docs:
        words = lk.words_of(d.text)
        ids, joined = [items.ids.get(w, -1) for w in words], [items.ids.get(a + b, -1) for a, b in zip(words, words[1:])] + [-1]
        want |= {(d.doc_id, k) for k, ws in zip(items.keys, items.words, strict=True) if lk.aligned(ws, ids, joined, lk.Leak())}
    assert {tuple(r) for r in q.p7_found(spark, str(SMALL)).collect()} == want and want
    per_item = {r.item_id: r.documents for r in q.p7_items(spark, str(SMALL)).collect()}
    assert len(per_item) == 320 and sum(per_item.values()) == len(want) and all(per_item[k] for _, k in want)
    assert not {tuple(r)[:2] for r in q.p7_paraphrases(spark, str(SMALL)).collect()} & want


def test_cut_texts_add_up_by_source(spark):
    found = q.p8_found(spark, str(SMALL))
    sources = q.p8_sources(spark, str(SMALL)).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("text IS NOT NULL")
    assert sum(r.docs for r in sources) == docs.count() and sum(r.cut for r in sources) == found.count() == found.distinct().count() > 0
    by = {r.source: r.cut for r in found.join(docs, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("cut")).collect()}
    assert by == {r.source: r.cut for r in sources if r.cut}
