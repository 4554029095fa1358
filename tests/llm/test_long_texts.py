"""Operators 3, 4 and 10 on very long texts: same results as in one piece, in time that grows with the text."""

import itertools
import random
import time

import numpy as np
import pytest

pytest.importorskip("varispark.llm")

from test_quality_sharding import brute_counts  # noqa: E402
from varispark.llm import crf, lines, rules  # noqa: E402
from varispark.llm.textarrays import of_texts, segment_hash  # noqa: E402

WORDS = "the of and to in is é日 #x !! 12 ABC foo bar |".split()


def made(rng, n):
    return "\n".join(" ".join(rng.choices(WORDS, k=rng.randrange(9))) for _ in range(n))


def field(rng):
    """A field of random weights over plausible bounds, far from certain of anything."""
    cuts = [np.sort(rng.normal(1, 1, 4)) for _ in range(39)]
    return crf.Field(cuts, [rng.normal(0, 0.15, 5) for _ in cuts], rng.normal(size=(2, 2)), rng.normal(size=2))


def test_pieces_of_a_chain_give_the_same_marginals(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = [1, 30, 7, 0, 64, 2]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    score, trans, begin = rng.normal(size=len(owner)), rng.normal(size=(2, 2)), rng.normal(size=2)
    want = crf.forward_backward(score, owner, len(sizes), trans, begin)
    for straight in (1, 3, 20):
        monkeypatch.setattr(crf, "STRAIGHT", straight)
        for a, b in zip(crf.forward_backward(score, owner, len(sizes), trans, begin), want, strict=True):
            assert np.allclose(a, b, atol=1e-12)
    assert 0.05 < want[0].std()


@pytest.mark.parametrize("piece", [1, 9, 200])
def test_quality_in_pieces(monkeypatch, piece):
    rng = random.Random(1)
    f = field(np.random.default_rng(4))
    texts = [x.encode() for x in [*(made(rng, n) for n in (1, 2, 5, 40, 300)), "", "\n", "\n\n\n", "\n\nabc\n\n", "x", " \n \nfoo\nfoo\n", "foo\n \nfoo"]]
    want = crf.quality(texts, f)
    assert len(set(want.round(6))) > 6
    monkeypatch.setattr(crf.line_pieces, "__defaults__", (piece,))
    assert np.allclose([crf.long_quality(x, f) for x in texts], want, atol=1e-9)
    monkeypatch.setattr(crf, "LINES", 8)
    assert np.allclose(crf.quality(texts, f), want, atol=1e-9)


@pytest.mark.parametrize("piece", [1, 5, 64, 1000])
def test_rules_in_pieces(monkeypatch, piece):
    rng = random.Random(6)
    model = rules.NgramModel(np.random.default_rng(1).normal(size=(3, 1 << rules.BITS)).astype(np.float32), 0.3, 1.0, 0.0)
    texts = [made(rng, n) for n in (1, 3, 60, 200)] + ["a", " ", "日本語" * 50, "one two three four five " * 9, "x\n" * 40, " lead", "tail ", "a" * 700]
    monkeypatch.setattr(rules, "PIECE_BYTES", piece)
    for x in texts:
        c, z = rules.long_text(x.encode(), model)
        assert tuple(c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(x), x[:20]
        assert abs(z - model.raw(of_texts([x.encode()]))[0]) < 1e-9
    c, p = rules.measured([x.encode() for x in texts], model)
    assert np.allclose(p, model.probability(of_texts([x.encode() for x in texts])))


def test_segment_hashes_do_not_depend_on_pieces(monkeypatch):
    from varispark.llm import textarrays

    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 9000).astype(np.uint8)
    start = np.sort(rng.choice(9000, 40, replace=False))
    size = np.minimum(np.diff(np.append(start, 9000)), rng.integers(0, 400, 40))
    want = segment_hash(data, start, size)
    for n in (1, 7, 1000):
        monkeypatch.setattr(textarrays, "HASHED", n)
        assert (segment_hash(data, start, size) == want).all()


def seconds(run):
    began = time.process_time()
    run()
    return time.process_time() - began


def test_time_grows_with_the_text():
    f = field(np.random.default_rng(4))
    model = rules.fit([])
    for shape in (b"a\n", b"the same line of a log\n", b"abcdefgh "):
        for run in (lambda x: crf.quality([x], f), lambda x: rules.measured([x], model)):
            run(shape * 1000)
            small, large = seconds(lambda: run(shape * (400_000 // len(shape)))), seconds(lambda: run(shape * (1_600_000 // len(shape))))
            assert large < 8 * small + 1


def brute_removed(text):
    rows = text.split("\n")
    seen, keep = [], []
    for y in rows:
        if y.strip() and y in seen:
            continue
        seen.append(y)
        keep.append(y)
    return "\n".join(keep)


def test_line_removal_is_one_pass(spark):
    text = "\n".join(["the same line of a very long log"] * 30_000 + ["", "another line that is the only one here"])
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).select("doc_id", "text").collect()}
    assert got == {1: brute_removed("the same line of a very long log\n\nanother line that is the only one here"), 2: "short", 3: None}
    assert time.time() - began < 120


@pytest.mark.parametrize("least", [3, 4, 6])
def test_short_lines_link_down_to_the_number_of_segments(spark, least):
    rng = random.Random(least)
    every = ["".join(t) for n in (2, 3, 4, 5) for t in itertools.product("ab", repeat=n)] + ["".join(rng.choices("abcd", k=rng.randrange(3, 9))) for _ in range(40)]
    docs = spark.createDataFrame([(i, "\n".join(every[i::4])) for i in range(4)], "doc_id long, text string")
    got = {(r["u"], r["v"]) for r in lines.line_links(docs, 2, least).collect()}
    names = {y: int(h) for y, h in zip(every, lines.line_hashes(every)[:, 0], strict=True)}
    long = sorted({y for y in every if len(y) >= least})
    want = {(max(names[a], names[b]), min(names[a], names[b])) for a, b in itertools.combinations(long, 2) if lines.edit_within(a, b, 2)}
    assert got == want
    with pytest.raises(ValueError):
        lines.line_links(docs, 2, 2)


