import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import bisect, mixing, packing, tokens
from folioframe.sources.records import DOCUMENT, FILE, METADATA


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text_below_the_limit(text, limit, overlap):
    ps = bisect.bisect_text(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e in ps) == text
    for i, (s, c, e) in enumerate(ps):
        assert e - s <= limit and c - s == (min(overlap, c) if i else 0)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 200), st.lists(st.booleans(), max_size=200))
def test_page_pieces(n, strong):
    ps = bisect.bisect_pages(n, strong)
    assert [x for _, c, e in ps for x in range(c, e)] == list(range(n))
    assert all(e - s <= 15 and (c - s == 1) == (i > 0) for i, (s, c, e) in enumerate(ps))


def test_cut_takes_the_strongest_boundary_near_the_middle():
    text = "a" * 40 + "\n\n" + "b" * 10 + ". " + "c" * 40
    assert bisect.bisect_text(text, 80, 5)[1][1] == 42


def test_sizes_decide_by_text_blocks_pages_and_count(spark):
    page = lambda t, b=None: (1, None, t, b, None, None, None)
    blk = lambda t: (t, None)
    meta = lambda n: (None, n) + (None,) * 8
    rows = [
        (1, meta(1), ("d", [page("x" * 1501), page("x" * 1500), page("", [blk("y" * 800), blk(None), blk("y" * 700)]), page(None, [blk("y" * 800), blk("y" * 699)]), None]), None),
        (1, meta(1), ("d", [page("x" * 1501), page("x" * 1500), page("", [blk("y" * 800), blk(None), blk("y" * 700)]), page(None, [blk("y" * 800), blk("y" * 699)]), None]), None),
        (2, meta(16), ("d", []), None),
        (3, meta(99), ("d", [page("a")] * 15), None),
        (4, meta(1), ("d", [page("a")] * 16), None),
        (5, meta(99), None, [(None, None, meta(16), None), None, (None, None, None, ("d", [page("\U0001f600" * 1501)]))]),
        (6, None, None, None),
        (7, meta(-5), None, []),
    ]
    df = spark.createDataFrame([r + ("clash", 1) for r in rows], f"env_id long, metadata {METADATA}, document_data {DOCUMENT}, files array<{FILE}>, body string, file_idx int")
    assert {tuple(r) for r in bisect.found(df).collect()} == {(1, 0, 0), (1, 0, 2), (2, 0, -1), (4, 0, -1), (5, 1, -1), (5, 3, 0)}
    assert bisect.found(df).count() == 6 and bisect.found(df.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=120))
def test_packing_places_every_token_once(sizes):
    placed = packing.pack(sizes, 64)
    fill = {}
    for size, parts in zip(sizes, placed, strict=True):
        assert sum(n for _, _, n in parts) == size and (len(parts) == 1 or size > 64)
        for w, offset, n in parts:
            fill.setdefault(w, []).append((offset, n))
    for spans in fill.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64


def brute_pack(sizes, capacity):
    """The rule without level arrays: try every open window and a new one, keep the smallest sum of squares."""
    bins = []
    for s in sizes:
        best = None
        for h in sorted({b for b in bins if b + s <= capacity} | {0}, reverse=True):
            new = list(bins)
            if h:
                new.remove(h)
            new.append(h + s)
            count = {}
            for b in new:
                if b < capacity:
                    count[b] = count.get(b, 0) + 1
            cost = sum(v * v for v in count.values())
            if best is None or cost < best[0]:
                best = (cost, new)
        bins = best[1]
    return sorted(bins)


def test_packing_follows_the_sum_of_squares_rule():
    rng = random.Random(3)
    for _ in range(20):
        sizes = [rng.randint(1, 20) for _ in range(40)]
        fill = {}
        for parts in packing.pack(sizes, 20):
            for w, _, n in parts:
                fill[w] = fill.get(w, 0) + n
        assert sorted(fill.values()) == brute_pack(sizes, 20)


def test_assigned_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = packing.assign(docs).toPandas()
    counts = tokens.with_counts(docs.select("doc_id", "text")).where("n_tokens > 0").toPandas().set_index("doc_id").n_tokens
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == counts.to_dict()
    assert got.groupby(["group_no", "window_no"]).n_tokens.sum().max() <= packing.CAPACITY
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a", 5), (3, "a " * 5000, 5), (3, "a " * 5000, 5)], "doc_id long, text string, n_tokens int")
    assert packing.assign(odd).groupBy("doc_id").sum("n_tokens").collect()[0][1] == 2 * tokens.with_counts(odd.where("doc_id = 3")).first().n_tokens
    assert packing.assign(odd.limit(0)).count() == 0


def test_quotas():
    plan, tau = mixing.solve([("a", 0.5, 1, 1000), ("b", 0.5, 3, 100), ("c", 0.2, 1, 0)])
    q = {p.source: p for p in plan}
    assert tau == 1 and math.isclose(q["a"].quota, 300) and math.isclose(q["b"].quota, 300) and q["c"].quota == 0
    plan, tau = mixing.solve([("a", 0.5, 1, 1000), ("b", 0.5, 3, 100)], budget=1000)
    assert 0 < tau < 1 and math.isclose(sum(p.quota for p in plan), 1000, rel_tol=1e-6) and all(p.quota <= p.repeats * p.tokens * (1 + 1e-9) for p in plan)
    assert mixing.solve([("a", 0.5, 1, 1000), ("b", 0.5, 3, 100)], budget=100)[1] == 1.0
    q = {p.source: p.quota for p in mixing.solve([("a", 0.5, 1, 1000), ("b", 0.25, 3, 100), ("c", 0.25, 0, 500)])[0]}
    assert q["c"] == 0 and math.isclose(q["a"], 600) and math.isclose(q["b"], 300)  # one source without repeats empties no other


def test_mixture_keeps_targets_and_repeats(spark):
    rng = random.Random(1)
    docs = [(i, s, "word " * rng.randint(5, 60), "x") for i, s in enumerate(["big"] * 600 + ["small"] * 40 + [None] * 5 + ["other"] * 5)] + [(None, "big", "a", "x"), (9999, "big", None, "x"), (9998, "big", "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, rest string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    items = mixing.counted(df, targets)
    plan, _ = mixing.quotas(items, targets)
    got = mixing.realise(items, plan, blocks=8).toPandas()
    assert not got.duplicated(["doc_id", "pass_no"]).any()
    assert got[got.source == "small"].pass_no.max() <= 4 and got[got.source == "big"].pass_no.max() == 1
    share = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    assert abs(share["big"] - 2 / 3) < 0.02 and set(share.index) == {"big", "small"}
    report = {r.source: r for r in mixing.shares(df, targets).collect()}
    assert report["gone"].mixed_tokens == 0 and report["small"].most_repeats == 4
    full = {r.source: r for r in mixing.shares(df, targets, budget=mixing.ALL).collect()}
    assert 0 <= full["big"].tau < 1 and full["big"].most_repeats == 1 and full["small"].most_repeats <= 4
    assert sum(r.mixed_tokens for r in full.values()) > sum(r.mixed_tokens for r in report.values())
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


def test_quota_of_a_pass_is_met_between_documents(spark):
    items = spark.createDataFrame([(i, "a", 3 + i % 5) for i in range(4000)], "doc_id long, source string, n_tokens int")
    for left in (1.0, 2.9, 3.0, 77.0, 9001.0, 19_999.0):
        got = mixing.realise(items, [mixing.Quota("a", 1.0, 20_000, 1, left)], blocks=8).toPandas()
        assert abs(got.n_tokens.sum() - left) <= 3.5 and not got.doc_id.duplicated().any()


@pytest.mark.parametrize("text,n", [("", 0), (None, 0)])
def test_counts_of_nothing(spark, text, n):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tokens.with_counts(df).first().n_tokens == n
