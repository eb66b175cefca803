"""Span sets against plain Python."""

import random

from pyspark.sql import functions as F

from spanveil.functions import spans as sp


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[4], s[2] - s[3], s[2], s[5])):
        if all(s[3] <= k[2] or k[3] <= s[2] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[2])


def test_resolution_is_greedy_by_rank(spark):
    rng = random.Random(3)
    rows = []
    for n in range(400):
        spans = []
        for seq in range(rng.randint(0, 12)):
            a = rng.randint(0, 30)
            spans.append((rng.choice("AB"), "t", a, a + rng.randint(1, 9), rng.choice([1.0, 0.97, 0.9, 0.85]), seq))
        rows.append((n, spans))
    df = spark.createDataFrame(rows, f"n int, s {sp.SPANS}")
    for r in df.select("n", F.expr(sp.resolve("s")).alias("k")).collect():
        assert [tuple(x) for x in r.k] == greedy(rows[r.n][1])


def test_a_chain_keeps_both_ends(spark):
    df = spark.createDataFrame([([("A", "t", 0, 4, 1.0, 0), ("B", "t", 3, 8, 0.97, 1), ("C", "t", 7, 9, 0.9, 2)],)], f"s {sp.SPANS}")
    assert [x.entity_type for x in df.select(F.expr(sp.resolve("s")).alias("k")).first().k] == ["A", "C"]


def luhn(v):
    d = [int(c) for c in v if c in "0123456789"]
    return len(d) >= 12 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def test_checksums(spark):
    cards = ["4111111111111111", "5500 0000 0000 0004", "3782 822463 10005", "6011 1111 1111 1117", "4532015112830366", "4111111111111112", "4-1"]
    ids = ["12345678950", "10000000078", "99999999990", "10000000079", "00000000000", "123"]
    ibans = ["TR330006100519786457841326", "DE89 3704 0044 0532 0130 00", "de89370400440532013000", "TR330006100519786457841327", "ZZ330006100519786457841326", "TR3", "GB82WEST12345698765432"]
    c = spark.createDataFrame([(x,) for x in cards], "v string").select(F.expr(sp.luhn("v")).alias("ok")).collect()
    assert [r.ok for r in c] == [luhn(x) for x in cards]
    t = spark.createDataFrame([(x,) for x in ids], "v string").select(F.coalesce(F.expr(sp.tc_id("v")), F.lit(False)).alias("ok")).collect()
    assert [r.ok for r in t] == [True, True, True, False, True, False]
    i = spark.createDataFrame([(x,) for x in ibans], "v string").select(F.expr(sp.iban("v")).alias("ok")).collect()
    assert [r.ok for r in i] == [True, True, True, False, False, False, True]


def test_runs_of_ibans_split_only_exactly(spark):
    rows = ["TR330006100519786457841326DE89370400440532013000", "TR330006100519786457841326XX", "TR330006100519786457841326", "TR330006100519786457841326" * 3]
    got = spark.createDataFrame([(x,) for x in rows], "v string").select(F.size(F.expr(sp.iban_run("v"))).alias("n")).collect()
    assert [r.n for r in got] == [2, 0, 0, 3]


def test_folding_keeps_length(spark):
    df = spark.createDataFrame([("ali@tеst.com ４１ ٣ Ａｂ",)], "t string").select(sp.fold(F.col("t")).alias("f"), "t").first()
    assert df.f == "ali@test.com 41 3 Ab" and len(df.f) == len(df.t)


def test_denied_values_overlap(spark):
    df = spark.createDataFrame([("aaaa baa",), ("x",), ("",)], "t string")
    got = [[(s.start, s.end) for s in r.s] for r in df.select(F.expr(sp.value_spans("t", "aa", "D", 0)).alias("s")).collect()]
    assert got == [[(0, 2), (1, 3), (2, 4), (6, 8)], [], []]
