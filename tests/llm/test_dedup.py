"""Exact and near-duplicates, and repeated byte strings, against brute force."""

from pathlib import Path
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil.llm import exact_dedup, near_dedup, suffix_dedup
from spanveil.llm.common import shared_dir
from spanveil.llm.components import components
from spanveil.llm.exact_dedup import as_stream, distinct_documents, groups, keyed, op8_exact_dedup, state_of
from spanveil.llm.near_dedup import near_duplicates, one_of_each_group
from spanveil.llm.suffix_dedup import build_bwt, least_by_interval, without_repeats

DATA = Path("/root/testdata")


def texts_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(str(DATA / sf / "documents.parquet")).select("doc_id", "text").collect()]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[norm(t)].append(i)
    key = lambda i: (i is None, i or 0)
    return [(i, min(by[norm(t)], key=key), len(by[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows]


def state(spark, docs, **more):
    path = f"{shared_dir(spark)}-in"
    docs.write.parquet(path)
    return state_of(as_stream(path, docs.schema, spark), f"{shared_dir(spark)}-state", **more)


def test_exact_groups(spark, documents, odd_rows, empty):
    docs = documents(odd_rows)
    got = groups(docs, state(spark, docs)).collect()
    order = lambda rows: sorted(map(repr, rows))
    assert order([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]) == order(brute_groups(odd_rows))
    assert groups(empty, state(spark, empty)).count() == 0
    kept = distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted({(k is None, k or 0) for _, k, _, _ in brute_groups(odd_rows)})


def test_exact_groups_of_the_documents(spark):
    got = op8_exact_dedup(spark, str(DATA / "sf0.001")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(brute_groups(texts_of(spark, "sf0.001")))


def test_hits_are_not_trusted(spark, documents):
    """With a digest of one letter most hits are of different texts."""
    rng = random.Random(2)
    rows = [(i, f"text {rng.randint(0, 30)}") for i in range(120)]
    weak = lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)
    docs = documents(rows)
    got = groups(docs, state(spark, docs, digest=weak), weak).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(brute_groups(rows))


def test_locators_say_where_the_first_is(spark, documents, monkeypatch):
    """Also where the table's rows share a doc_id, and where a group is compared in many parts."""
    monkeypatch.setattr(exact_dedup, "PART", 3)
    rows = [(i // 2, f"text {i % 5}") for i in range(60)] + [(7, None), (7, "")]
    path = f"{shared_dir(spark)}-in"
    documents(rows).repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    found = state_of(as_stream(path, docs.schema, spark), f"{shared_dir(spark)}-state")
    at = docs.select("text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    texts = found.join(at, (F.col("locator.file") == at["file"]) & (F.col("locator.row") == at["row"])).collect()
    assert {hashlib.sha256(norm(r.text).encode()).hexdigest() for r in texts} == {r.digest for r in texts} and len(texts) == 6
    for state_table in (found, found.withColumn("locator", F.struct(F.lit("nowhere").alias("file"), F.lit(0).cast("long").alias("row")))):
        got = groups(docs, state_table).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(brute_groups(rows))
        assert sum(r.first for r in got) == 6
    assert distinct_documents(docs).count() == 6


def test_the_stream_goes_on_from_its_state(spark, documents):
    path, at = f"{shared_dir(spark)}-grow", f"{shared_dir(spark)}-state"
    first, more = documents([(5, "a"), (6, "b")]), documents([(1, "a "), (2, "a"), (7, "c")])
    first.write.parquet(path)
    assert state_of(as_stream(path, first.schema, spark), at).count() == 2
    more.write.mode("append").parquet(path)
    got = {r.keep_id: r.group_size for r in state_of(as_stream(path, first.schema, spark), at).collect()}
    assert got == {5: 1 + 1, 6: 1, 7: 1, 1: 1} or got == {2: 2, 6: 1, 7: 1, 1: 1}


def test_exact_dedup_is_native(spark, documents):
    plan = keyed(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if 75 * max(len(sets[a]), len(sets[b])) <= 100 * min(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def compare_near(docs, rows):
    got = near_duplicates(docs).collect()
    expected = brute_near([(i, t) for i, t in rows if i is not None])
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert len(got) == len(rows)
    return got


def test_near_duplicates_of_the_documents(spark, documents):
    rows = texts_of(spark, "sf0.01")
    compare_near(documents(rows), rows)


def test_near_duplicates_of_odd_rows(documents, odd_rows, empty):
    got = compare_near(documents(odd_rows), odd_rows)
    assert [r.kept for r in got if r.doc_id is None] == [True] and [r.component_id for r in got if r.doc_id is None] == [None]
    assert near_duplicates(empty).count() == 0
    kept = one_of_each_group(documents(odd_rows))
    assert "doc_id" in kept.columns and 5 not in {r.doc_id for r in kept.collect()}


def test_strayed_copies_and_chains(documents, monkeypatch):
    """Copies at all distances from a text that itself comes late, chains of edits, and short texts; with few holders of a light shingle."""
    monkeypatch.setattr(near_dedup, "LIGHT", 4)
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randint(0, 9999))
    base = [word() for _ in range(80)]
    rows = [(900, " ".join(base))]
    for i in range(140):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(["p", "q", word()])
        rows.append((i, " ".join(w)))
    w = list(base)
    for i in range(200, 260):
        w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(300 + i, " ".join(rng.choice("xyz") for _ in range(rng.randint(1, 9)))) for i in range(60)]
    compare_near(documents(rows), rows)


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        off = []
        for _ in range(60):
            common = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
            n = int(2000 * (1 - share) / share / 2)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n, dtype=np.uint64)]) * np.uint64(2)) for _ in range(2))
            similar, _ = near_dedup.estimates(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
            off.append(similar[0] - share)
        assert abs(np.mean(off)) < 0.03


# repeated byte strings


def brute_removed(rows, length):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = []
    for i, t in rows:
        covered = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if i is not None and first[t[k : k + length]] < i:
                covered[k : k + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~covered]) if t else b""
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((i, len(t), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def compare_removed(docs, rows, length=50):
    got = without_repeats(docs).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == brute_removed([(i, (t or "").encode()) for i, t in rows], length)


def test_removed_strings_of_the_documents(spark, documents):
    rows = texts_of(spark, "sf0.001")
    compare_removed(documents(rows), rows)


def test_removed_strings_of_odd_rows(documents, odd_rows, empty):
    rows = [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t in odd_rows]
    compare_removed(documents(rows), rows)
    assert without_repeats(empty).count() == 0


def test_removed_strings_with_few_letters(documents):
    """Texts of two letters repeat themselves and each other at all offsets."""
    rng = random.Random(6)
    block = ["".join(rng.choice("ab") for _ in range(70)) for _ in range(4)]
    rows = [(i, "".join(rng.choice([*block, "".join(rng.choice("ab") for _ in range(20)), "é"]) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    compare_removed(documents(rows), rows)


@pytest.mark.parametrize("most", [None, 100])
def test_removed_strings_around_common_lines(documents, monkeypatch, most):
    """A line that all texts hold, each with other text around it, lines of dashes, and few letters; with all anchors cut up, and with none."""
    if most:
        monkeypatch.setattr(suffix_dedup, "MERGED", most)
    rng = random.Random(8)
    line = "This line is in every one of the texts, whatever else they hold, é and all."
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 12))) + line + rng.choice(["", "-" * rng.randint(40, 130)]) + " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(60 + i, rng.choice(["ab", "abc", "-"]) * rng.randint(10, 60)) for i in range(12)]
    compare_removed(documents(rows), rows)


def test_merged_transforms():
    rng = random.Random(1)
    old = suffix_dedup.SHARD
    try:
        for _ in range(150):
            strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 12))]
            docs, length = np.array([rng.randint(0, 20) for _ in strings]), rng.choice([2, 4, 6])
            suffix_dedup.SHARD = rng.choice([5, 40, 1000])
            for s, least in zip(strings, least_by_interval(strings, docs, length), strict=True):
                for i in range(len(s) - length + 1):
                    assert least[i] == min(d for t, d in zip(strings, docs, strict=True) if s[i : i + length] in t)
    finally:
        suffix_dedup.SHARD = old


@pytest.mark.parametrize("length", [3, 5, 10, 50])
def test_merged_transforms_at_other_lengths(length):
    rng = random.Random(length)
    # long enough strings of few letters, and more groups of letters than 16 bits tell apart
    few = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 90))) * 2 for _ in range(40)]
    many = few + [rng.randbytes(3000) for _ in range(30)]
    for strings in (few, many + [s[500:1500] for s in many]):
        docs = np.array([rng.randint(0, 20) for _ in strings])
        plain: dict[bytes, int] = {}
        for s, d in zip(strings, docs, strict=True):
            for i in range(len(s) - length + 1):
                plain[s[i : i + length]] = min(d, plain.get(s[i : i + length], d))
        for s, least in zip(strings, least_by_interval(strings, docs, length), strict=True):
            assert least.tolist() == [plain[s[i : i + length]] for i in range(len(s) - length + 1)]


@pytest.mark.parametrize("strings", [[b"banana"], [b"abab", b"ab", b"b"], [b"a"]])
def test_a_shards_transform(strings):
    _, owner, offset = build_bwt(strings)
    ends = [(list(s[i:]) + [-1], n) for n, s in enumerate(strings) for i in range(len(s) + 1)]
    assert [list(strings[n][i:]) + [-1] for n, i in zip(owner, offset, strict=True)] == [x for x, _ in sorted(ends)]


@pytest.mark.parametrize("name", ["op6_near_dedup", "op8_exact_dedup"])
def test_registered_sql(spark, name):
    import duckdb

    from spanveil.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.001/documents.parquet'")
    sql = con.execute(oracle_sql()[name])
    columns = [c[0] for c in sql.description]
    df = queries()[name](spark, str(DATA / "sf0.001"))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, sql.fetchall()))
