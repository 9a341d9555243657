"""Operators 1, 3, 6, 7, 8, 10 on small tables, against brute force and for edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from obsline.llm import bpe, chat, exact_dedup, packing, simhash, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " "), (4, "one"), (5, "a" * 5000), (6, "one  two\n\n three　four's 123 don't"), (7, "one"), (7, "one"), (None, "one two three"), (9, "x " * 3000),
       (10, "ONE two\tthree four"), (11, "one two three four"), (12, "\x1c \x85 \xa0 é中🙂"), (13, "a <|endoftext|> b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1, "x") for r in ODD], DOCS + ", ids string, fp int, content string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


# ---- 1

def slow_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted((doc if doc is not None else -1, f"{fp:016x}", least[find(i)]) for i, (doc, fp) in enumerate(fps))


@pytest.mark.parametrize("name", ["odd", "corpus"])
def test_simhash_matches_brute_force(name, request):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted((d if d is not None else -1, f, c) for d, f, c in found) == slow_components(rows)


def test_simhash_links_all_within_two_bits(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + [b ^ 7 for b in base]
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in set(values)]
    links = {(r.a, r.b) for r in simhash.ball_links(spark.createDataFrame(signed, "fp long")).collect()}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
    seen = {x for link in links for x in link}
    for (a,) in signed:
        near = [b for (b,) in signed if 0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
        assert (a in seen) == bool(near)


def test_simhash_takes_even_radii_only(spark):
    fps = spark.createDataFrame([(0,), (1,), (15,), (255,)], "fp long")
    assert {(r.a, r.b) for r in simhash.ball_links(fps, 4).collect()} >= {(0, 1), (0, 15)}
    for radius in (1, 3, -2):
        with pytest.raises(ValueError):
            simhash.ball_links(fps, radius)


def test_simhash_of_an_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_components_of_long_chains_and_hubs(spark):
    from obsline.llm.common import connected_components

    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1300), 1000)}


# ---- 3

def slow_digest(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "", None, "\\", "\\\\", "</turn>\n### user: x", "####", "a</turn", "{{ m }}", "x" * 50_000, "é🙂\r\n"]
    rows = [(c, t, ("user", "assistant", None, "sys: a")[t % 4], hard[((c or 0) + t) % len(hard)], "clash") for c in (1, 2, 3, None) for t in range(9)]
    rows += [(2, 3, "assistant", "tie", "clash"), (2, 3, "assistant", "tie", "clash"), (3, None, "user", "first", "clash")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    found = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert found == {c: slow_digest([(r, x) for *_, r, x in sorted(v)]) for c, v in by.items()}
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


def test_chat_long_conversation_comes_in_parts(spark):
    df = spark.range(60).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("word "), 20_000).alias("text"))
    parts = chat.format_conversations(df)
    assert parts.count() > 1
    (row,) = chat.read_back(parts).collect()
    assert (row.n_turns, row.loss_chars) == (60, 60 * 100_000)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_chat_ids_of_other_types(spark, kind):
    df = spark.createDataFrame([("1", 0, "user", "a"), ("1", 1, "assistant", "b"), ("2", 0, "user", "c")], "conv_id string, turn int, role string, text string")
    found = chat.read_back(chat.format_conversations(df.withColumn("conv_id", F.col("conv_id").cast(kind))))
    assert found.schema["conv_id"].dataType.simpleString() == kind
    assert sorted((str(r.conv_id), r.n_turns) for r in found.collect()) == [("1", 2), ("2", 1)]


def test_template_trims_at_dashes_and_names_bad_constants():
    assert "".join(t for t, _ in chat.compile_template("a {%- if x %} b {% endif -%} c")(x=1)) == "a b c"
    for bad in ("{{ 1 < 'a' }}", "{% if 'a' in 1 %}x{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert list(chat.read_turns("### user: " + chat.escape("<\\#" * 300_000) + "</turn>\n")) == [("user", "<\\#" * 300_000)]


def test_template_compiler_folds_and_rejects():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% elif 'q' in 'pq' %}y{% else %}z{% endif %}d").body)
    assert len(tree) == 1 and tree[0].value in ("aBCyd", "abCyd")
    render = chat.compile_template("{% for m in ms %}{% if m.a == 'x' %}X{% elif loop.first %}F{% else %}{% generation %}{{ m.a | escape }}{% endgeneration %}{% endif %}{% endfor %}")
    assert list(render(ms=[{"a": "p"}, {"a": "x"}, {"a": "#"}])) == [("F", False), ("X", False), ("#", True)]
    for bad in ("{{ f(1) }}", "{{ m.__class__ }}", "{{ [1] }}", "{% if %}", "{% endif %}", "{% for x in y %}", "{{ a | open }}", "{% include 'x' %}", "{% for x in y %}{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


# ---- 6

def test_toxicity_learns_and_scores_every_row(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(300)]

    def text(toxic):
        t = rng.choices(words, k=40)
        if toxic:
            t[rng.randrange(40)] = rng.choice(["vilezz", "vilest", "vileko"])
        return " ".join(t)

    marks = [(i, int(rng.random() < 0.3)) for i in range(800)]
    docs = spark.createDataFrame([(i, text(y), "x") for i, y in marks] + [(9000, None, "x"), (9001, "", "x"), (9001, "", "x"), (None, "vilest", "x")], DOCS + ", score string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None), (7, 3)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 804 and all(0 <= r.score <= 1 for r in rows)
    truth = dict(marks)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def slow_ftrl(rows, weights, squares, s):
    """One coordinate after the other, in dictionaries; -1 is the intercept."""
    z = {i: -w * ((s.beta + squares.get(i, 0.0) ** 0.5) / s.alpha + (s.l2 if i >= 0 else 0)) - ((w > 0) - (w < 0)) * (s.l1 if i >= 0 else 0) for i, w in weights.items()}
    n = dict(squares)

    def weight(i):
        zi, root = z.get(i, 0.0), (s.beta + n.get(i, 0.0) ** 0.5) / s.alpha
        if i < 0:
            return -zi / root
        return 0.0 if abs(zi) <= s.l1 else -(zi - ((zi > 0) - (zi < 0)) * s.l1) / (root + s.l2)

    for _ in range(s.epochs):
        for features, label in rows:
            w = {i: weight(i) for i in [*features, -1]}
            g = float(1 / (1 + np.exp(-sum(w.values())))) - label
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / s.alpha * wi
                n[i] = old + g * g
    return {i: w for i in n if (w := weight(i)) != 0}, n


def test_ftrl_matches_a_slow_version():
    rng, s = random.Random(2), toxicity.Settings(bits=8, l1=0.4)
    rows = [(np.array(sorted({rng.randrange(40) for _ in range(8)}), np.int32), int(rng.random() < 0.4)) for _ in range(120)]
    weights, squares = {}, {}
    start, sums = np.zeros(257, np.float32), np.zeros(257, np.float32)
    for _ in range(2):
        weights, squares = slow_ftrl([(f.tolist(), y) for f, y in rows], weights, squares, s)
        held, w, n = toxicity.fit_shard(rows, start, sums, s)
        start, sums = np.zeros(257, np.float32), np.zeros(257, np.float32)
        start[held], sums[held] = w, n
        squares = {i: squares[i] for i in weights}
        assert {256 if i < 0 else i for i in weights} == set(held.tolist())
        assert all(abs(start[i] - v) < 1e-3 for i, v in weights.items()) and all(abs(sums[i] / v - 1) < 1e-3 for i, v in squares.items())


def test_toxicity_reads_no_clashing_columns_and_takes_repeated_rows(spark):
    rows = [(i, "vile scum" if i % 3 == 0 else "kind words here") for i in range(300)] * 2
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(300)] + [(1, 0, 1)], "doc_id long, toxic int, shard int")
    plain = spark.createDataFrame(rows, DOCS)
    clash = plain.withColumns({"toxic": F.lit(1), "shard": F.lit(7), "score": F.lit("x"), "feature": F.lit(None).cast("int")})
    a, b = (Counter((r.doc_id, round(r.score, 4)) for r in toxicity.toxicity(d.repartition(n), labels).collect()) for d, n in ((plain, 1), (clash, 5)))
    assert a == b and sum(a.values()) == 600 and set(a.values()) == {2}


def test_toxicity_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 6) for r in toxicity.toxicity(odd, none).collect()} == {0.009952}
    assert toxicity.toxicity(empty, none).collect() == []


# ---- 7

@pytest.mark.parametrize("name", ["odd", "corpus"])
def test_bpe_matches_the_library_and_round_trips(name, request):
    docs = request.getfixturevalue(name)
    enc = encoding()
    rows = docs.select("doc_id", "text").collect()
    found = bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = sorted((r.doc_id or -1, np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in rows)
    assert sorted((r.doc_id or -1, bytes(r.ids), bytes(r.decoded)) for r in found) == want


def test_bpe_random_pieces():
    enc, (own, _) = encoding(), bpe.matrix_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    alphabet = [" ", "  ", "\n", " \n", "\t", "a", "the", "é", "'s", "'", "12", "٣", "\x1c", "　", "\xa0", "-", "<|endoftext|>", "🙂", "\r\n", "\x85"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(1500)] + ["ab" * 4000, " " * 3000, "a" * 30_001, "x" + "é" * 999]
    texts += ["".join(rng.choices("abcdefghi", k=n)) for n in (65, 500, 1023, 5000, 40_000)] + ["".join(rng.choices("ab", k=300)) for _ in range(200)]
    ids, cuts = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [enc.encode_ordinary(t) for t in texts]


def test_store_starts_anew_and_keeps_within_its_bytes():
    enc, (own, _) = encoding(), bpe.matrix_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    small = bpe.ChunkEncoder(own.encode_chunks, store_bytes=20_000)
    rng, most = random.Random(6), 0
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abc,", k=rng.randrange(1, 9))) for _ in range(40)) for _ in range(5)]
        ids, cuts = small.encode(pa.array(texts))
        most = max(most, small.slots)
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [enc.encode_ordinary(t) for t in texts]
    assert most < 500


def test_added_tokens_are_the_librarys():
    own, tokenizer = packing.library_encoder(P.path("byte_bpe_50k.json"), P.PATTERN), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x ", "plain text", "", "<|endof<|endoftext|>text|>", "x  <|endoftext|>\n y"]
    ids, cuts = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# ---- 8

def slow_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i if i is not None else -1, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [exact_dedup.TABLE_BYTES, 2000, 1])
@pytest.mark.parametrize("name", ["odd", "corpus"])
def test_exact_dedup_matches_brute_force_with_any_memory(name, budget, request):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted(((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, budget).collect()), key=str)
    assert found == slow_groups(rows)


def test_exact_dedup_of_an_empty_table(empty):
    assert exact_dedup.exact_groups(empty).collect() == []


def test_grace_compares_contents_when_hashes_agree(tmp_path):
    rows = [(42, i, i, i, 1, b"same" if i % 2 else b"other") for i in range(40)]
    found = sorted(exact_dedup.grace(rows, str(tmp_path), budget=1))
    assert found == [(i, i % 2, i % 2, 20) for i in range(40)]
    assert list(tmp_path.iterdir()) == []


# ---- 10

def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 2048
    return len(places), sum(r.length for r in rows)


@pytest.mark.parametrize("name", ["odd", "corpus"])
def test_packing_places_every_piece(name, request):
    docs = request.getfixturevalue(name)
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    sequences, tokens = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sequences <= 1.03 * tokens / 2048 + 1


def test_packing_of_an_empty_table(empty):
    assert packing.pack(empty, P.path("byte_bpe_50k.json"), P.PATTERN).collect() == []


def test_plan_is_near_the_bound_and_complete():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, np.maximum(1, rng.lognormal(6.3, 1.0, 50_000)).astype(int))
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.plan_packing(histogram)
    taken = defaultdict(int)
    for length, first, n, _, _ in plan:
        assert first == taken[length]
        taken[length] += n
    assert taken == histogram
    assert max(p[3] + p[2] for p in plan) < 1.002 * lengths.sum() / 2048

