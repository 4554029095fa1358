"""Operators 1, 2, 6 and 8 against brute force, round trips and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("varispark.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from varispark.llm import bpe, packing, simhash, tokens  # noqa: E402
from varispark.llm.common import components, new_path  # noqa: E402

ODD = [None, "", "   \n\t", "a", "a b", "A b\x0bC", "naïve café " * 3, "x" * 3000, "the same text again", "the same text again", "don't we'll 'sx 12 345\n\n  é b", "a \x02 b", "<|endoftext|> x"]
SCHEMA = "doc_id long, text string, lang string, fp long, u long, ids binary, k int"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", 1, 2, b"", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def reference_simhash(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("limit", [0, 48])
def test_simhash_groups_match_brute_force(spark, limit, monkeypatch):
    rng = random.Random(4)
    base = [" ".join(rng.choices("alpha beta gamma delta eps zeta eta theta".split(), k=120)) for _ in range(12)]
    texts = ODD + base + [b.replace("alpha", "alpho", 1) for b in base] + [base[0] + " x"] * 3 + [base[1].upper()]
    monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (2, limit))
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs(spark, texts)).collect()}
    fps = [reference_simhash(t) for t in texts]
    assert [got[i]["fp"] % 2**64 for i in range(len(texts))] == fps
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {i: r["component_id"] for i, r in got.items()} == closure(pairs, range(len(texts)))


@pytest.mark.parametrize("limit", [0, 1000])
def test_links_of_random_fingerprints(spark, limit):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(4):
            g = f
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    sign = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    links = simhash.fingerprint_links(spark.createDataFrame([(sign[f],) for f in fps], "fp long"), 2, limit)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    want = closure([(sign[a], sign[b]) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], sign.values())
    assert {f: got.get(f, f) for f in sign.values()} == want


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_simhash_empty_table_and_dedup(spark):
    assert simhash.simhash_groups(docs(spark, []).limit(0)).count() == 0
    kept = simhash.simhash_dedup(docs(spark, ["a b c d e", "a b c d e", "z y x w"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2] and kept.columns[:2] == ["doc_id", "text"]


def test_varint_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = tokens.encode_varint(x)
        assert len(control) == -(-n // 4) and (tokens.decode_varint(control, data, n) == x).all()


def test_token_table(spark):
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    ids = [7, 3, 3, 9, 50, 12, 1, 2, 80, 81, 82, 83, 84]
    out = new_path(spark, "test")
    tokens.write_tokens(docs(spark, ODD, ids), out, path, 1)
    got = sorted(tokens.read_tokens(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(ids)
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    want = sorted((i, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in zip(ids, ODD, strict=True))
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in got) == want
    empty = new_path(spark, "test")
    tokens.write_tokens(docs(spark, ODD).limit(0), empty, path, 1)
    assert tokens.read_tokens(spark, empty).count() == 0


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 2)
    enc = tokens.WordEncoder(tokens.vocabulary("word_bpe_49k.json"))
    texts = [x.encode() for x in ("one two three one", "four five", "ΑΣ Σ ΣΑΣ é", "The THING, it's Straße!! ÀÉ.. w\u030a W\u030a a'b ''s <|endoftext|> 12 x1 ÿ× ª")]
    want = [enc.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want
    assert enc.short and len(enc) <= 2


def test_packing_pieces_cover_everything(spark):
    got = packing.pack(docs(spark, [*ODD, "word " * 9000]), tokens.vocabulary("word_bpe_49k.json"), 2).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(ODD) + 1))
    enc = tokens.word_encoder(tokens.vocabulary("word_bpe_49k.json"))
    for i, rows in by_doc.items():
        rows.sort(key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
        whole = np.frombuffer(b"".join(r["ids"] for r in rows), "<u4").tolist()
        assert whole == [*enc.tokenizer.encode([*ODD, "word " * 9000][i] or "", add_special_tokens=False).ids, 2] and len(whole) == rows[0]["doc_tokens"]
    for rows in by_seq.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
        total = sum(r["length"] for r in rows)
        assert total <= 4096 and (total == 4096 or total & (total - 1) == 0)


def test_packing_keeps_all_limits():
    rng = np.random.default_rng(2)
    n = rng.integers(0, 900, 400)
    loss = np.floor(n * rng.random(400)).astype(np.int64)
    limits = packing.Limits(tokens=1000, segments=6, loss_tokens=500)
    out = packing.pack_window(n, loss, limits)
    seen = np.zeros(400, np.int64)
    for pieces in out:
        assert sum(k for *_, k in pieces) <= 1000 and len(pieces) <= 6
        assert sum(k * loss[i] / n[i] for i, _, k in pieces) <= 500 + 1e-6
        for i, s, k in pieces:
            assert s == seen[i] and k > 0
            seen[i] += k
    assert (seen == n).all()
    assert packing.pack_window(np.array([], int), np.array([], int), limits) == []


@pytest.mark.parametrize("chunk,overlap", [(40, 20), (64, 24), (1 << 16, 1 << 10)])
def test_bpe_matches_tiktoken(spark, chunk, overlap):
    path = bpe.vocabulary("byte_bpe_multi_50k.tiktoken")
    enc = bpe.coder(path, public_tokenizers.PATTERN)[0]
    rng = random.Random(3)
    mixed = ["".join(rng.choices(["ab", " ", "  ", "\n", "'ll", "'", "é", "12", "!?", "中文", "\t"], k=150)) for _ in range(30)]
    texts = [*ODD, *mixed]
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, texts), path, public_tokenizers.PATTERN, chunk, overlap).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == enc.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()
    assert bpe.encode_documents(docs(spark, texts).limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_query(spark, tmp_path):
    docs(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    r = {x["doc_id"]: x for x in bpe.op8_query(spark, str(tmp_path)).collect()}
    assert r[0]["n_tokens"] == 0 and r[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert r[6]["decoded_sha256"] == hashlib.sha256(ODD[6].encode()).hexdigest()
    for x in packing.op6_query(spark, str(tmp_path)).where("doc_id = 1").collect():
        assert x["ids_crc32"] == zlib.crc32(np.array([2], "<u4").tobytes())


def test_short_examples_need_no_padding():
    n = np.full(4096, 3)
    out = packing.pack_window(n, n, packing.Limits())
    totals = [sum(k for *_, k in pieces) for pieces in out]
    assert sum(totals) == 3 * 4096 and all(t & (t - 1) == 0 for t in totals) and max(map(len, out)) <= 256


def test_packing_counts_loss_bearing_tokens_of_each_piece():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 3000, 200)
    marks = [rng.random(k) < p for k, p in zip(n, rng.random(200), strict=True)]
    bears = [np.concatenate(([0], np.cumsum(m))) for m in marks]
    limits = packing.Limits(tokens=1000, segments=8, loss_tokens=300)
    seen, binding = np.zeros(200, np.int64), 0
    for pieces in packing.pack_window(n, np.array([b[-1] for b in bears]), limits, bears):
        loss = sum(int(marks[i][s : s + k].sum()) for i, s, k in pieces)
        assert sum(k for *_, k in pieces) <= 1000 and len(pieces) <= 8 and loss <= 300
        binding += loss == 300
        for i, s, k in pieces:
            assert s == seen[i] and k > 0
            seen[i] += k
    assert (seen == n).all() and binding > 0


def test_conversations_bear_loss_in_replies_alone(spark):
    turns = [(1, 0, "user", "some question " * 40, 9), (1, 1, "assistant", "the answer " * 30, 9), (2, 1, "assistant", "words " * 300, 9), (2, 0, None, None, 9), (None, 0, "user", "alone", 9), (None, 0, "user", "alone", 9)]
    rows = spark.createDataFrame(turns * 1, "conv_id long, turn long, role string, text string, ids int")
    path = tokens.vocabulary("word_bpe_49k.json")
    limits = packing.Limits(tokens=256, segments=4, loss_tokens=64)
    enc = tokens.word_encoder(path).tokenizer
    want, bears = {}, {}
    for c in (1, 2):
        own = [(enc.encode(t or "", add_special_tokens=False).ids + [7], r == "assistant") for _, _, r, t, _ in sorted((x for x in turns if x[0] == c), key=lambda x: x[1])]
        want[c], bears[c] = sum((i for i, _ in own), []), sum(([b] * len(i) for i, b in own), [])
    got = packing.pack_conversations(rows, path, 7, limits).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for c in (1, 2):
        own = sorted(by_doc[c], key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == want[c]
    assert len(by_doc[None]) == 2
    for own in by_seq.values():
        assert len(own) <= 4 and sum(r["length"] for r in own) <= 256
        assert sum(sum(bears[r["doc_id"]][r["start"] : r["start"] + r["length"]]) for r in own if r["doc_id"]) <= 64
    assert packing.pack_conversations(rows.limit(0), path, 7, limits).count() == 0


def test_queries_of_tokens_and_packing_by_column_and_type(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [*ODD, "Words, words and more words. " * 300]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    ids = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    out = tokens.op2_query(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    start = 0
    for i, r in enumerate(sorted(out.collect(), key=lambda r: r["doc_id"])):
        assert tuple(r) == (i, start, len(ids[i]) + 1, zlib.crc32(np.array([*ids[i], 1], "<u4").tobytes()))
        start += r["n_tokens"]
    out = packing.op6_query(spark, str(tmp_path))
    assert dict(out.dtypes) == dict.fromkeys(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "bigint")
    assert sum(r["length"] for r in out.collect()) == sum(map(len, ids)) + len(texts)


def test_dedup_tells_texts_of_one_doc_id_apart(spark):
    texts, ids = ["a b c d e f", "a b c d e f", "some text found nowhere else", "a b c d e f", "q r s t u v", "q r s t u v"], [1, 5, 5, None, None, None]
    kept = simhash.simhash_dedup(docs(spark, texts, ids)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "q r s t u v")] * 2 + [(1, "a b c d e f"), (5, "some text found nowhere else")]
    assert simhash.simhash_dedup(docs(spark, []).limit(0)).count() == 0


def test_simhash_query_by_column_and_type(spark, tmp_path):
    docs(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    out = simhash.op1_query(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    assert {r["doc_id"]: r["fingerprint"] for r in out.collect()} == {i: f"{reference_simhash(t):016x}" for i, t in enumerate(ODD)}
