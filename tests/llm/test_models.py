"""Mixing, quality, toxicity, media and the pipeline."""

import hashlib
import math
import os
import random
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanveil.llm import media, mixing, quality, toxicity
from spanveil.llm.queries import oracle_sql, queries

DATA = Path("/root/testdata")


@pytest.fixture(scope="module")
def small(spark):
    d = str(DATA / "sf0.01")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


# mixing


def brute_rates(n, q, targets, rounds=mixing.ITERATIONS):
    """The same projected gradient, over documents instead of sums."""
    p = q / np.maximum(q.sum(axis=1, keepdims=True), 1)
    total, goal = n.sum(), np.asarray(list(targets.values())) / sum(targets.values())
    r = y = np.ones(len(n))
    step, momentum, before = 1.0, 1.0, math.inf
    for k in range(rounds):
        at = (n * y) @ p
        if not k:
            step = 1 / (((n * r) @ p).max() / total + mixing.PULL)
        off = at / total - goal
        miss = float(off @ off)
        if miss > before:
            momentum = 1.0
        elif before - miss < mixing.CLOSE**2:
            break
        before, after = miss, (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        beta, momentum = (momentum - 1) / after, after
        new = np.maximum(0, y - step * (p @ off + mixing.PULL * (y - 1)))
        y, r = new + beta * (new - r), new
    return r


def test_rates_are_those_of_single_documents(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(0, 500, 200)
    q = rng.multinomial(1000, [0.7, 0.2, 0.1], 200)
    q[:80] = [1000, 0, 0]
    targets = {"a": 0.3, "b": 0.5, "c": 0.2}
    table = spark.createDataFrame([(i, int(a), [int(x) for x in b]) for i, (a, b) in enumerate(zip(n, q, strict=True))], "doc_id long, n_tokens long, q array<int>")
    rates, expected = mixing.fit_rates(table, targets)
    got = {r.doc_id: r.rate for r in table.join(rates, "q").collect()}
    assert np.allclose([got[i] for i in range(200)], brute_rates(n.astype(float), q.astype(float), targets), atol=1e-6)
    assert min(got.values()) >= 0


def test_mixing_meets_its_targets(small):
    docs, labels = small
    rows = mixing.mixing_rates(docs, labels).collect()
    assert len(rows) == docs.count()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([lang[r.doc_id] == r.domain for r in rows]) > 0.95
    tokens = Counter()
    for r in rows:
        tokens[r.domain] += r.rate * r.n_tokens
        assert r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and r.rate >= 0
    shares = {k: v / sum(tokens.values()) for k, v in tokens.items()}
    assert all(abs(shares[k] - t) < 0.03 for k, t in mixing.TARGETS.items())


@pytest.mark.parametrize("shares", [(0.95, 0.03, 0.015, 0.005), (0.97, 0.02, 0.009, 0.001)])
def test_rare_domains_meet_their_targets(spark, shares):
    one_hot = [[1000 * (i == j) for i in range(4)] for j in range(4)]
    rows = [(int(s * 1e6), q) for s, q in zip(shares, one_hot, strict=True)] + [(1000, [700, 100, 100, 100])]
    table = spark.createDataFrame(rows, "n_tokens long, q array<int>")
    rates, expected = mixing.meet_targets(table, mixing.TARGETS)
    total = sum(n for n, _ in rows)
    assert all(abs(e / total - t) <= mixing.TOLERANCE * t for e, t in zip(expected, mixing.TARGETS.values(), strict=True))
    rate = {tuple(r.q): r.rate for r in rates.collect()}
    got = [sum(n * rate[tuple(q)] * q[j] / 1000 for n, q in rows) for j in range(4)]
    assert np.allclose(got, expected) and min(rate.values()) >= 0


def test_targets_that_no_rates_meet_are_told(spark, caplog):
    table = spark.createDataFrame([(100, [1000, 0]), (50, [900, 100])], "n_tokens long, q array<int>")
    _, expected = mixing.meet_targets(table, {"a": 0.5, "b": 0.5})
    assert "no rates meet the targets" in caplog.text and expected[1] < 70


def test_posteriors_against_plain_counts(spark, small):
    docs, labels = small
    labelled = docs.join(labels, "doc_id").select(F.col("lang").alias("domain"), "text")
    domains = list(mixing.TARGETS)
    model, priors = mixing.classifier(labelled, domains)
    rows = labelled.collect()
    assert np.allclose(priors, [math.log((sum(r.domain == d for r in rows) + 1) / (len(rows) + 4)) for d in domains])
    totals = [0] * 4
    for r in rows:
        totals[domains.index(r.domain)] += sum(bool(w) for w in r.text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
    w = model.select(*[F.sum(F.exp(f"w{j}")) for j in range(4)]).first()
    assert np.allclose(list(w), 1.0)  # likelihoods over all buckets
    assert model.count() == mixing.BUCKETS


def test_mixing_of_odd_rows(spark, documents, odd_rows, empty):
    none = spark.createDataFrame([], "doc_id long")
    docs = documents(odd_rows)
    got = {r.doc_id: r for r in mixing.mixing_rates(docs, none).collect()}
    assert len(got) == len({i for i, _ in odd_rows}) and got[1].n_tokens == 0 and got[10].n_tokens == 10
    out = mixing.mixed(docs, none)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter({i: got[i].copies * n for i, n in Counter(i for i, _ in odd_rows).items() if got[i].copies})
    assert mixing.mixing_rates(empty, none).count() == 0
    assert mixing.mixing_rates(documents([(1, ""), (2, None)]), none).filter("rate != 1").count() == 0


def test_mixing_is_native(small):
    docs, labels = small
    plan = mixing.mixing_rates(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


# quality


def grams_of(text, order=quality.ORDER):
    padded = chr(quality.BEGIN) * (order - 1) + text
    return [padded[k : k + order] for k in range(len(text))]


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney with dictionaries."""
    full = Counter()
    for t in texts:
        full.update(grams_of(t, order))
    levels = [full]
    for _ in range(order, 1, -1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    out = {0: lambda g: 1 / (len(levels[-1]) + 1)}
    for k, counts in enumerate(levels[::-1], 1):
        n = [sum(c == i for c in counts.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
        d = [min(max(i - (i + 1) * y * b / a, 0), i - 0.01) if a else 0.5 for i, a, b in ((1, n[0], n[1]), (2, n[1], n[2]), (3, n[2], n[3]))]
        total, taken = Counter(), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            taken[g[:-1]] += d[min(c, 3) - 1]

        def p(g, k=k, counts=counts, d=d, total=total, taken=taken):
            below = out[k - 1](g[1:])
            if not total[g[:-1]]:
                return below
            c = counts.get(g, 0)
            return (c - d[min(c, 3) - 1] if c else 0) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * below

        out[k] = p
    return out[order]


def test_perplexities_against_dictionaries(documents, monkeypatch):
    # several blocks, and texts longer than what is looked at together
    monkeypatch.setattr(quality, "block_count", lambda size: 5)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc ,.Dé9漢🔒\n") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    docs = documents(list(enumerate(texts)))
    got = {r.doc_id: r.perplexity for r in quality.quality(docs, docs.filter("doc_id < 30").select("doc_id")).collect()}
    learned = [t for i, t in enumerate(texts[:30]) if not quality.held_out(i)]
    assert 0 < len(learned) < 30
    p = brute_model(learned, quality.ORDER)
    for i, t in enumerate(texts):
        assert math.isclose(got[i], math.exp(-sum(math.log(p(g)) for g in grams_of(t)) / len(t)), rel_tol=1e-5)


def test_pieces_of_long_texts(monkeypatch):
    texts = ["abcdefghijk", "", "xy", "0123456789" * 3]
    whole = quality.distinct_grams(texts, [True, True, False, True])
    monkeypatch.setattr(quality, "PIECE", 4)
    parts = quality.distinct_grams(texts, [True, True, False, True])
    assert whole.equals(parts) and dict(zip(parts["gram"], parts["n"], strict=True)) == Counter(g for t in (texts[0], texts[3]) for g in grams_of(t)) | {g: 0 for g in grams_of("xy")}
    scores = np.arange(len(parts), dtype=np.float32)
    place = dict(zip(parts["gram"], parts["j"], strict=True))
    assert quality.sums_of(texts, scores).tolist() == [sum(place[g] for g in grams_of(t)) for t in texts]


def test_ngrams_become_strings_once(monkeypatch):
    texts = [f"the same few words come again, {i % 3}" for i in range(200)]
    made = []
    strings = quality.gram_strings
    monkeypatch.setattr(quality, "PIECE", 500)
    monkeypatch.setattr(quality, "gram_strings", lambda x, starts, order: made.append(len(starts)) or strings(x, starts, order))
    found = quality.distinct_grams(texts, [i % 2 == 0 for i in range(200)])
    plain, learned = Counter(), Counter()
    for i, t in enumerate(texts):
        plain.update(grams_of(t))
        learned.update(grams_of(t) if i % 2 == 0 else [])
    assert dict(zip(found["gram"], found["n"], strict=True)) == {g: learned[g] for g in plain}
    assert sum(made) == len(found)


def test_places_of_hashes():
    known = np.unique(np.concatenate([np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64), np.arange(40, dtype=np.uint64), (1 << 64) - 1 - np.arange(40, dtype=np.uint64)]))
    h = np.random.default_rng(4).choice(known, 20_000)
    assert (quality.places_in(known)(h) == np.searchsorted(known, h)).all()
    wanted = np.unique(h[::7])
    assert (h[quality.some_places_of(wanted, h)] == wanted).all()


def test_probabilities_add_up(spark):
    texts = ["some text to learn from, twice over.", "and Another one 123"]
    counts = Counter(g for t in texts for g in grams_of(t))
    signs = sorted({c for t in texts for c in t})
    contexts = sorted({g[:-1] for g in counts})
    asked = {c + x for c in contexts for x in [*signs, "?"]}
    rows = spark.createDataFrame([(g, counts.get(g, 0)) for g in asked | set(counts)], "gram string, n long")
    sums = defaultdict(float)
    for r in quality.probabilities(rows).collect():
        sums[r.gram[:-1]] += r.p
    assert all(math.isclose(sums[c], 1, abs_tol=1e-9) for c in contexts)


def test_the_model_grows_with_the_texts():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2000)) for _ in range(40)]
    few, many = (len(quality.distinct_grams(texts[:n], [True] * n)) for n in (4, 40))
    assert many > 8 * few


def test_good_documents_are_kept(small):
    docs, labels = small
    rows = quality.quality(docs, labels.filter("quality = 1")).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_junk_is_told_from_good(spark):
    d = str(DATA / "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.quality(docs, labels.filter("quality = 1")).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    print(f"kept {sum(good)} of {len(good)} good, {sum(bad)} of {len(bad)} junk")
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.06


def test_quality_of_odd_rows(spark, documents, odd_rows, empty):
    docs = documents(odd_rows)
    got = quality.quality(docs, docs.filter("doc_id in (0, 5)").select("doc_id")).collect()
    assert len(got) == len(odd_rows) and all(r.kept and r.perplexity is None for r in got if r.doc_id in (1, 2, 13))
    none = docs.filter("false").select("doc_id")
    assert all(r.kept for r in quality.quality(docs, none).collect()) and quality.quality(empty, none).count() == 0


# toxicity


def test_folding_and_matching():
    lexicon = toxicity.Lexicon({"idiot$": 5.0, "lowei": 4.0, "low": 1.0}, frozenset({("dear", "idiot")}), (-3.0, 1.0, 1.0))
    assert toxicity.fold("1D10T ѕсum $CUM ｓcum") == "idiot scum scum scum"
    assert lexicon.weigh("An 1D1OT, idiots, xidiot, Loweisch lowly")[:2] == (10.0, 3)
    assert lexicon.weigh("my dear idiot")[:2] == (0.0, 0)
    assert lexicon.weigh("") == (0.0, 0, 0)
    assert lexicon.score(10.0, 5) > lexicon.score(10.0, 500) > lexicon.score(0.0, 500)


@pytest.mark.parametrize(
    "text", ["7rash", "s7upid", "c1own", "1oser", "1d1ot", "sc0undre1", "i11iterate", "id!ot", "!diot", "Тrash", "тrash", "Мoron", "мoron", "ΜΟRΟΝ", "Ηalfwit", "Кnave", "Вoor", "8oor", "9oon", "a note!Idiot"]
)
def test_disguised_spellings_are_found(text):
    words = ("trash", "stupid", "clown", "loser", "idiot$", "scoundrel", "illiterate", "moron", "halfwit", "knave", "boor", "goon")
    assert toxicity.Lexicon(dict.fromkeys(words, 1.0)).weigh(text)[1] == 1


def test_other_readings_find_nothing_else():
    lexicon = toxicity.Lexicon({"clown": 1.0, "lime$": 1.0}, frozenset({("a", "clown")}))
    assert all(lexicon.weigh(t)[1] == 0 for t in ("ciown", "ime 1", "1imes", "a clown 1", "Stop!1", "!", "wow! 11"))
    assert lexicon.weigh("clown! 1 clown")[1] == 2


def test_held_out_rows_are_told_right(spark):
    d = str(DATA / "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    hit = np.mean([r.predicted for r in out if r.toxic])
    false = np.mean([r.predicted for r in out if not r.toxic])
    assert hit > 0.85 and false < 0.01, (hit, false)


def test_held_out_labels_are_not_learned_from(spark, documents):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = documents([(i, f"nasty{i} words" if i in held else "plain words here") for i in range(300)])
    labels = spark.createDataFrame([(i, int(i in held)) for i in range(300)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels).weights == {}


def test_entries_and_exceptions_have_no_limit(spark, documents):
    spell = lambda k, first: first + "".join(chr(97 + k // 26**i % 26) for i in range(7))
    ids = iter(i for i in range(10_000) if zlib.crc32(str(i).encode()) % 3 != 1)
    bad = [f"{spell(7_919 * k, 'x')} {spell(7 * k + j, 'q')} words" for k in range(450) for j in range(7)] + [f"nasty {spell(9_000 + j, 'q')} words" for j in range(300)]
    # clean rows that use the entry nasty in 10,100 phrases, each in eight rows
    clean = [" ".join(f"nasty {spell(k, 'w')} {spell(j, 'u')}" for k in range(10_100)) for j in range(8)] + [f"plain {spell(j, 'v')} words" for j in range(1_000)]
    rows = [(next(ids), t, int(k < len(bad))) for k, t in enumerate(bad + clean)]
    lexicon = toxicity.learn(documents([r[:2] for r in rows]), spark.createDataFrame([(i, n) for i, _, n in rows], "doc_id long, toxic int"))
    print(len(lexicon.weights), "entries,", len(lexicon.exceptions), "exceptions")
    assert len(lexicon.weights) > 400 and all(lexicon.weigh(spell(7_919 * k, "x"))[1] for k in range(450))
    assert len([p for p in lexicon.exceptions if p[0] == "nasty"]) == 10_100


def test_toxicity_of_odd_rows(spark, documents, odd_rows, empty):
    labels = spark.createDataFrame([(0, 1), (5, None), (None, 1), (6, 0), (6, 1)], "doc_id long, toxic int")
    docs = documents(odd_rows)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(odd_rows) and {r.held_out for r in got if r.doc_id is None} == {False}
    assert toxicity.without_toxic(docs, labels.filter("false")).count() == len(odd_rows)
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity(empty, labels).count() == 0


# media


def test_payloads_come_back(documents, odd_rows, empty):
    rng = random.Random(1)
    for n in (64, 128, 64 * 15, 64 * 16, 64 * 17, 64 * 100):
        payload = rng.randbytes(n)
        assert media.read_back(media.to_avi(payload)).payload == payload
    payload = b"\xff" * 640
    assert media.read_back(media.to_avi(payload)).payload == payload
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    for r, (i, t) in zip(sorted(media.media_digests(documents(odd_rows)).collect(), key=key), sorted(odd_rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        data = (t or "").encode()
        whole = media.padded(data)
        assert r.doc_id == i and r.n_bytes == len(data) and r.payload_bytes == len(whole) > 0 and len(whole) % 64 == 0
        assert r.payload_sha256 == hashlib.sha256(whole).hexdigest() and r.tail_crc32 == zlib.crc32(whole[-64:])
    assert media.media_digests(empty).count() == 0


def plain_frame(parts, mcus_x, mcus_y, every, rng):
    """A baseline frame of random coefficients, coded a bit at a time, and the first component's blocks as rows of the picture.
    parts: blocks across and down in a unit of each component."""
    dc_table, dc = media._canonical({s: 2 + s // 2 for s in range(10)})
    ac_table, ac = media._canonical({0: 3, 0xF0: 8, **{r << 4 | s: 4 if r < 1 else 10 for r in range(16) for s in range(1, 6)}})
    most = max(h for h, _ in parts), max(v for _, v in parts)
    frame = struct.pack(">BHHB", 8, 8 * mcus_y * most[1], 8 * mcus_x * most[0], len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts))
    head = b"\xff\xd8" + media._segment(0xDB, b"\x00" + bytes(range(1, 65))) + media._segment(0xC0, frame) + media._segment(0xC4, b"\x00" + dc_table + b"\x10" + ac_table)
    head += media._segment(0xDD, struct.pack(">H", every)) + media._segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + b"\x00\x3f\x00")
    put = lambda code: format(code[0], f"0{code[1]}b")
    amplitude = lambda x, n: format(x if x > 0 else x + (1 << n) - 1, f"0{n}b") if n else ""
    across = mcus_x * parts[0][0]
    blocks, bits, data, marks = {}, "", b"", 0

    def flushed(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")

    before = [0] * len(parts)
    for m in range(mcus_x * mcus_y):
        if every and m and m % every == 0:
            data, bits, before, marks = data + flushed(bits) + bytes([0xFF, 0xD0 + marks % 8]), "", [0] * len(parts), marks + 1
        for i, (h, v) in enumerate(parts):
            for y in range(v):
                for x in range(h):
                    block = [rng.randint(-200, 200)] + [rng.choice((0,) * rng.randint(1, 40) + (rng.randint(-31, 31),)) for _ in range(63)]
                    if i == 0:
                        blocks[(m // mcus_x * v + y) * across + m % mcus_x * h + x] = block
                    step, before[i] = block[0] - before[i], block[0]
                    bits += put(dc[abs(step).bit_length()]) + amplitude(step, abs(step).bit_length())
                    run = 0
                    for k, c in enumerate(block[1:], 1):
                        if not any(block[k:]):
                            bits += put(ac[0])
                            break
                        if not c:
                            run += 1
                            continue
                        bits += put(ac[0xF0]) * (run // 16) + put(ac[run % 16 << 4 | abs(c).bit_length()]) + amplitude(c, abs(c).bit_length())
                        run = 0
    return head + data + flushed(bits) + b"\xff\xd9", [blocks[k] for k in range(len(blocks))]


@pytest.mark.parametrize("parts", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("every", [0, 1, 2, 5])
def test_frames_against_a_plain_encoder(parts, every):
    rng = random.Random(every)
    made = [plain_frame(parts, 3, 2, every, rng) for _ in range(4)]
    for frame, blocks in made:
        units, scale, across, down = media.decode_frame(frame)
        assert units.tolist() == blocks and across * down == len(blocks) and scale.tolist() == list(range(1, 65))
    # many at once, frames of another head among them
    other = media.parse_avi(media.to_avi(b"other" * 64)).frames
    found = {k: u.tolist() for keys, _, units in media.decode_frames([*enumerate([f for f, _ in made]), *((-1 - k, f) for k, f in enumerate(other))]) for k, u in zip(keys, units, strict=True)}
    assert [found[k] for k in range(4)] == [b for _, b in made] and len(found) == 4 + len(other)


def test_segments_of_long_files():
    rng = random.Random(2)
    payload = bytes(rng.choice(b"abc` \x00\xff") for _ in range(64 * 170))
    whole, cut = media.to_avi(payload), media.to_avi(payload, segment=3000)
    assert whole.count(b"AVIX") == 0 and cut.count(b"AVIX") > 2
    assert media.read_back(cut).payload == media.read_back(whole).payload == payload
    assert media.parse_avi(cut).frames == media.parse_avi(whole).frames
    # without the indexes of 64 bits the old index and the chunks of the further segments give the same
    assert media.parse_avi(cut.replace(b"indx", b"JUNK")).frames == media.parse_avi(whole).frames
    assert media.parse_avi(whole.replace(b"idx1", b"JUNK")).frames == media.parse_avi(whole).frames


def test_broken_frames_are_told():
    frame = media.parse_avi(media.to_avi(os.urandom(64 * 16))).frames[0]
    for bad in (frame[:-2], frame[:-40] + b"\xff\xd9", frame.replace(b"\xff\xd0", b"", 1), frame[:100], b"\xff\xd8"):
        with pytest.raises(ValueError, match="."):
            media.decode_frame(bad)


def test_few_samples_of_text_are_cut_off():
    units = np.frombuffer(b"An ordinary text of words, read as coefficients, 1234 of them. " * 64, dtype=np.uint8)[: 64 * 60].reshape(-1, 64).astype(int) - media.CENTRE
    samples = media.luma(units, np.ones(64))
    assert ((samples == 0) | (samples == 255)).mean() < 0.05


def test_frames_of_other_makers_and_broken_ones():
    """A frame with end-of-block codes and runs of zeros, without restart markers, made by hand."""
    bits = "0" + "00" + "10" + "1" + "1"  # category 0; run 2 of category 1, value 1; end of block
    bits = "0" + "0" + "1" + "11"
    dc = bytes([1] + [0] * 15) + b"\x00"
    ac = bytes([1, 1] + [0] * 14) + b"\x21\x00"
    head = b"\xff\xd8" + media._segment(0xDB, b"\x00" + b"\x02" * 64) + media._segment(0xC0, b"\x08\x00\x08\x00\x08\x01\x01\x11\x00") + media._segment(0xC4, b"\x00" + dc + b"\x10" + ac) + media._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    body = "0" + "0" + "1" + "10"
    data = int(body.ljust(8, "1"), 2).to_bytes(1, "big")
    units, scale, across, down = media.decode_frame(head + data + b"\xff\xd9")
    assert (across, down) == (1, 1) and units[0, 3] == 1 and np.count_nonzero(units) == 1 and scale[3] == 2 and bits
    assert media.luma(np.zeros((1, 64)), np.ones(64)).tolist() == [[128] * 64]
    for bad in (b"", b"RIFF0000WAVE"):
        with pytest.raises(ValueError, match="no AVI"):
            media.parse_avi(bad)
    with pytest.raises(ValueError, match="baseline"):
        media.decode_frame(b"\xff\xd8" + media._segment(0xC2, b"\x08\x00\x08\x00\x08\x01\x01\x11\x00"))


def test_shots_and_clips(spark):
    dark, light = np.tile([100, 0, 0, 0], (6, 1)), np.tile([0, 0, 0, 100], (5, 1))
    assert [(a, b) for a, b, _ in media.shots(np.vstack([dark, light, dark]))] == [(0, 6), (6, 11), (11, 17)]
    payload = b"\x00" * 1024 * 6 + b"\x80" * 1024 * 6
    df = spark.createDataFrame([(1, bytearray(media.to_avi(payload))), (2, None)], "doc_id long, media binary")
    clips = media.clip_rows(df).orderBy("clip").collect()
    assert [(r.first_frame, r.frames) for r in clips] == [(0, 6), (6, 6)] and math.isclose(clips[1].starts_s, 6 / media.FPS)
    assert media.as_media(spark.createDataFrame([(1, "x")], "doc_id long, text string")).first().media[:4] == b"RIFF"


# the pipeline


def brute_pipeline(spark, d, monkeypatch):
    """Each stage on single machines' terms, from the learned lexicon and rates."""
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if lexicon.score(*lexicon.weigh(r["text"])[::2]) < toxicity.THRESHOLD]
    from test_dedup import brute_groups, brute_near

    keep = {k for _, k, _, _ in brute_groups([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if r["doc_id"] in keep]
    near = brute_near([(r["doc_id"], r["text"]) for r in rows])
    return [r for r in rows if near[r["doc_id"]][1] == r["doc_id"]]


def test_pipeline_against_brute_force(spark, monkeypatch):
    d = str(DATA / "sf0.001")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.cut(stage(spark, docs, d), name)
        kept[name] = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(x.columns == spark.read.parquet(f"{d}/documents.parquet").columns for x in kept.values())
    expected = brute_pipeline(spark, d, monkeypatch)
    assert sorted(r.doc_id for r in kept["near_dedup"].collect()) == sorted(r["doc_id"] for r in expected)
    copies = {r.doc_id: r.copies for r in mixing.mixing_rates(kept["near_dedup"], spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert Counter(r.doc_id for r in kept["mixing"].collect()) == Counter({i: n for i, n in copies.items() if n})
    packed = corpus_pipeline.packing(spark, docs, d).collect()
    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.length
    assert set(whole) == {i for i, n in copies.items() if n} and sorted(corpus_pipeline.run(spark, d).columns) == sorted(corpus_pipeline.packing(spark, docs, d).columns)


def test_pipeline_of_odd_rows(spark, documents, odd_rows, empty):
    d = str(DATA / "sf0.001")
    for docs in (documents(odd_rows), empty):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns
            docs = corpus_pipeline.cut(out, "t")
        corpus_pipeline.packing(spark, docs, d).count()


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11)) and set(oracle_sql()) <= set(queries())


def test_toxicity_does_not_depend_on_partitions(small):
    docs, labels = small
    one, seven, many = (toxicity.learn(docs.repartition(n) if n > 1 else docs.coalesce(1), labels) for n in (1, 7, 61))
    assert one == seven == many and one.weights


def plain_matches(lexicon, text):
    """The longest entry at each beginning of a word, by comparing every entry with every place."""
    folded, found = toxicity.fold(toxicity.visible(text)), []
    for k in range(len(folded)):
        if k and toxicity.is_letter(folded[k - 1]):
            continue
        fits = [w for w in lexicon.weights if folded.startswith(w.rstrip("$"), k)]
        fits = [w for w in fits if w[-1] != "$" or not folded[k + len(w) - 1 : k + len(w)].isalnum()]
        if fits:
            found.append((k, max(len(w.rstrip("$")) for w in fits)))
    return found


def test_matches_against_plain_search():
    rng = random.Random(4)
    for _ in range(300):
        entries = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + rng.choice(["", "$"]): 1.0 for _ in range(5)}
        lexicon = toxicity.Lexicon(entries)
        text = "".join(rng.choice("abcABC \u0430 \u0441.\u0301\u200b_4") for _ in range(40))
        shown = toxicity.visible(text)
        assert [(s, e - s) for s, e, _ in lexicon.matches(toxicity.fold(shown), shown)] == plain_matches(lexicon, text)


def test_words_around_a_match_are_whole():
    long = "x" * 100
    folded = f"{long} bad {long}"
    assert toxicity.Lexicon.around(folded, 101) == (long, "bad", long)
    assert toxicity.Lexicon.around("bad", 0) == ("", "bad", "")


def test_disguised_words_are_folded():
    for text in ("tra\u0301sh".replace("\u0301", "\u0336"), "tr\u200bash", "\uff54rash", "\U0001d42d\U0001d42b\U0001d41a\U0001d42c\U0001d421", "7rash", "tr@sh", "\u0422rash"):
        assert toxicity.fold(toxicity.visible(text)).startswith("trash") or "trash" in toxicity.fold(toxicity.visible(text)), text
