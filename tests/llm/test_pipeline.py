"""The pipeline against a plain version of every stage."""

import zlib

import numpy as np
import pytest

pytest.importorskip("varispark.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_lines import brute  # noqa: E402
from test_quality_sharding import brute_counts  # noqa: E402
from test_tokens_dedup import closure, reference_simhash  # noqa: E402

from varispark.llm import crf, rules, tokens  # noqa: E402
from varispark.llm.common import read  # noqa: E402
from varispark.llm.textarrays import of_texts  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect())
    ngrams, field = rules.trained(spark, SF), crf.trained(spark, SF)
    kept = []
    for i, t in docs:
        n = brute_counts(t)
        if n[0] >= 10 and 100 * n[4] <= 20 * n[0] and ngrams.probability(of_texts([t.encode()]))[0] >= rules.KEEP and crf.quality([t.encode()], field)[0] >= crf.GOOD:
            kept.append((i, t))
    _, gone = brute([t for _, t in kept])
    short = [(i, "\n".join(y for j, y in enumerate(t.split("\n")) if j not in g)) for (i, t), g in zip(kept, gone, strict=True)]
    fp = {i: reference_simhash(t) for i, t in short}
    groups = closure([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], fp)
    last = {i: t for i, t in short if groups[i] == i}
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(last) and 0 < len(last) < len(kept) < len(docs)
    enc = tokens.word_encoder(tokens.vocabulary("word_bpe_49k.json"))
    for i, rows in pieces.items():
        ids = np.array([*enc.tokenizer.encode(last[i], add_special_tokens=False).ids, 2], "<u4")
        for r in rows:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes())
        assert sum(r["length"] for r in rows) == len(ids)


def test_stages_keep_the_columns(spark):
    docs = read(spark, SF, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0
