"""The pipeline against a brute-force version of all its stages."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from obsline.llm import toxicity
from tests.llm.test_text_operators import slow_components, slow_ftrl

SF = "/root/testdata/sf0.001"


def slow_toxic(spark, rows, labels):
    """Scores by FTRL over dictionaries, one shard, in the operator's order of rows."""
    s = toxicity.Settings()
    features = toxicity.Features(s.bits, s.stem)
    marks = {}
    for r in labels:
        if r.doc_id is not None and r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            marks[r.doc_id] = max(r.toxic, marks.get(r.doc_id, 0))
    found = {i: np.unique(features((t or "").encode())).tolist() for i, t in rows}
    order = [r.i for r in spark.createDataFrame([(i,) for i in marks if i in found], "i long").orderBy(F.xxhash64("i", F.lit(1)), "i").collect()]
    weights, squares = {}, {}
    for _ in range(s.rounds):
        weights, squares = slow_ftrl([(found[i], marks[i]) for i in order], weights, squares, s)
        squares = {i: squares[i] for i in weights}
    return {i: 1 / (1 + np.exp(-sum(weights.get(x, 0.0) for x in [*f, -1]))) for i, f in found.items()}


def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline as c

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    scores = slow_toxic(spark, rows, spark.read.parquet(f"{SF}/labels.parquet").collect())
    assert all(abs(s - toxicity.THRESHOLD) > 1e-3 for s in scores.values())
    rows = [(i, t) for i, t in rows if scores[i] < toxicity.THRESHOLD]
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    rows = [(i, t) for i, t in rows if i in set(first.values())]
    leaders = {component for _, _, component in slow_components(rows)}
    rows = [(i, t) for i, t in rows if i in leaders]
    tokenizer, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    found = c.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    ends = Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
