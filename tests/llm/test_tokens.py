"""Packing, token counts and training order."""

from pathlib import Path
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from spanveil.llm.packing import best_fit, op2_packing, pack, pieces
from spanveil.llm.token_counts import Machine, count_tokens
from spanveil.llm.training_order import SHARD, bucket_count, export_shards, materialise, permute, read_from, sequences, slotted, starts_of_buckets
from spanveil.llm.words import WordEncoder, word_encoder

DATA = Path("/root/testdata")

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [*"abcdefghi THE the ing  \n\t.,!?éñ漢字🔒0123456789▁", "    ", "▁▁", "\r\n", "\x00", "<s>", "<|endoftext|>", "'s", "'LL", "İ", "Σ", "\x1c", "\x85", "\xa0", "́", "ŉ", "ſ", "K", "​"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_word_ids_are_the_librarys():
    own, lib = WordEncoder(WORDS, keep=50), Tokenizer.from_file(WORDS)
    texts = [*odd_texts(3000), "word " * 300_000, "y" * 3000]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(t) == np.asarray(e.ids, dtype="<u4").tobytes(), t[:80]


def test_machine_counts_as_the_library_whatever_the_chunks():
    own, lib = Machine(PIECES, keep=200), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in odd_texts(3000):
        n = len(lib.encode(t))
        assert own.count(t) == n and own.count(t, 7) == n and own.count(t, 1) == n, t


def test_the_vocabulary_is_compiled_ahead():
    own = Machine(PIECES)
    ahead = len(own.states)
    assert 30_000 < ahead <= own.keep
    assert all(own.run(t)[1] == 1 for t in own.ids) and len(own.states) == ahead
    # a machine that must forget counts as one that needn't
    tight = Machine(PIECES, keep=500)
    assert len(tight.states) < 500
    text = " ".join(odd_texts(50))
    assert tight.count(text) == own.count(text) == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text))


def test_token_counts(spark, documents, odd_rows, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = count_tokens(documents(odd_rows), limit=50).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = [(i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 50) for i, t in odd_rows]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert count_tokens(empty).count() == 0


def brute_fit(counts, window):
    fill = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            room = [(window - f, i) for i, f in enumerate(fill) if window - f >= length]
            if room:
                fill[min(room)[1]] += length
            else:
                fill.append(length)
    return sorted(fill)


def test_best_fit_is_the_sequential_one():
    rng = random.Random(11)
    for _ in range(150):
        window = rng.choice([16, 31, 64])
        counts = {rng.randint(1, window): rng.randint(1, 30) for _ in range(rng.randint(1, 10))}
        plan = best_fit(counts, window)
        plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
        inside = defaultdict(list)
        for length, n in counts.items():
            own = plan[plan[:, 0] == length]
            for rank in range(n):
                _, first, each, start, fill = own[own[:, 1] <= rank][-1]
                inside[start + (rank - first) // each].append((fill + (rank - first) % each * length, length))
        for parts in inside.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= window
        assert sorted(sum(x for _, x in parts) for parts in inside.values()) == brute_fit(counts, window)


def check_packing(rows, ids_of, window=2048):
    places, ids = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        ids[r.doc_id].append(r)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    for doc_id, parts in ids.items():
        all_ids = ids_of[doc_id] + [1]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(all_ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(all_ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(all_ids)
    return places


def test_packing_of_documents(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).collect()
    lib = Tokenizer.from_file(WORDS)
    ids = {d.doc_id: e.ids for d, e in zip(docs, lib.encode_batch([d.text for d in docs], add_special_tokens=False), strict=True)}
    rows = op2_packing(spark, str(DATA / "sf0.001")).collect()
    places = check_packing(rows, ids)
    used = sum(len(v) + 1 for v in ids.values())
    assert len(places) * 2048 - used < 2 * 2048  # next to no padding


def test_packing_of_odd_rows(documents, odd_rows, empty):
    lib = Tokenizer.from_file(WORDS)
    rows = [r for i, r in enumerate(odd_rows) if odd_rows.index(r) == i]
    got = pack(documents(rows)).collect()
    check_packing(got, {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in rows})
    assert pack(documents([(1, "a b"), (1, "a b")])).count() == 2
    assert pack(empty).count() == 0
    assert pack(documents([(1, "a b c")]), with_ids=True).first().ids[-4:] == b"\x01\x00\x00\x00"


def test_workers_keep_no_words_after_their_tasks(spark, documents):
    def kept(batches):
        for pdf in batches:
            pdf["id"] = len(word_encoder(WORDS).words) + len(word_encoder(WORDS).tokens)
            yield pdf

    docs = documents([(i, f"some words of row {i}") for i in range(40)])
    assert len(pieces(docs.repartition(4), WORDS).collect()) == 40
    # the same workers take these tasks
    assert {r[0] for r in spark.range(0, 40, 1, 8).mapInPandas(kept, "id long").collect()} == {0}


def test_permutation_is_one():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        p = permute(np.arange(n), n)
        assert sorted(p) == list(range(n)) and (permute(p, n, inverse=True) == np.arange(n)).all()
    assert (permute(np.arange(1000), 1000, key=1) != permute(np.arange(1000), 1000, key=2)).any()


def test_training_order(spark, documents, odd_rows, empty, tmp_path):
    lib, docs = Tokenizer.from_file(WORDS), documents(odd_rows)
    path = str(tmp_path / "shards")
    manifest = materialise(docs, path, length=64, per_shard=10, least=1 << 10).collect()
    stored = spark.read.schema(SHARD).parquet(path)
    slots = sorted({r.slot for r in manifest})
    assert slots == list(range(len(slots))) and sorted({r["index"] for r in manifest}) == slots
    back = {r.slot: bytes(r.ids) for r in read_from(stored).collect()}
    assert all(zlib.crc32(back[r.slot]) == r.crc32 for r in manifest)
    # the pieces of a sequence lie side by side and the rest is padding; those of a document, read in order, are the document
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [49407] for i, t in odd_rows}
    whole, filled = defaultdict(list), defaultdict(int)
    for r in sorted(manifest, key=lambda r: (r.slot, r.offset)):
        assert r.offset == filled[r.slot]
        filled[r.slot] += r.length
    for r in manifest:
        row = np.frombuffer(back[r.slot], dtype="<u2").tolist()
        assert filled[r.slot] == r.n_tokens and row[r.n_tokens :] == [65535] * (64 - r.n_tokens) and 65535 not in row[: r.n_tokens]
    for r in sorted(manifest, key=lambda r: r.start):
        assert r.doc_id == 10 or len(whole[r.doc_id]) == r.start
        whole[r.doc_id] += np.frombuffer(back[r.slot], dtype="<u2")[r.offset : r.offset + r.length].tolist()
    assert all(whole[i] == x for i, x in ids.items() if i != 10) and len(whole[10]) == 2 * len(ids[10])
    # only the last sequence of a bucket is filled up
    size = sum(len((t or "").encode()) for _, t in odd_rows)
    assert sum(n < 64 for n in filled.values()) <= bucket_count(size, 1 << 10) and bucket_count(size, 1 << 10) > 5
    # reading goes on from any slot, and plain files hold the same bytes
    assert sorted(r.slot for r in read_from(stored, 23).collect()) == slots[23:]
    out = tmp_path / "bin"
    out.mkdir()
    assert export_shards(stored, str(out)) == -(-len(slots) // 10)
    r = next(r for r in manifest if r.slot == 13)
    assert (out / f"shard-{r.shard:09d}.bin").read_bytes()[r.byte_offset : r.byte_offset + 128] == back[13]
    assert materialise(empty, str(tmp_path / "none"), length=64).count() == 0


def test_order_does_not_depend_on_partitions(documents, odd_rows):
    def order(df):
        table = sequences(df, WORDS, 64, least=1 << 10)
        return sorted((r.slot, bytes(r.ids)) for r in slotted(table, starts_of_buckets(table)).collect())

    docs = documents(odd_rows)
    assert order(docs.repartition(5)) == order(docs.coalesce(1))


def test_buckets_grow_in_number_and_size():
    sizes = [10**k for k in range(3, 18)]
    numbers = [bucket_count(n) for n in sizes]
    assert numbers[0] == 1 and numbers == sorted(numbers) and numbers[-1] < 10**8 and 10**14 / bucket_count(10**14) < 10**8
