"""Operators 11 to 13, and what round 3 mended in 5, 7, 8 and 9."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from obsline.llm import ann, bpe, exact_dedup, language_model, merkle, token_counts, vector_codes
from obsline.llm.common import table

SF = "/root/testdata/sf0.001"


# ---- 11

def digest(text):
    return sha256(text.encode()).hexdigest()


def slow_tree(leaves):
    """The levels of a tree, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def slow_manifest(rows):
    """(id, group, digest) to id, digest, subroot, root and path."""
    groups = {}
    for ident, group, leaf in rows:
        groups.setdefault(group, []).append((ident is not None, ident or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: slow_tree([leaf for *_, leaf in sorted(groups[g])]) for g in order}
    top = slow_tree([trees[g][-1][0] for g in order])

    def path(levels, at):
        for level in levels[:-1]:
            start = at - at % 8
            yield at - start, level[start:at] + level[at + 1 : start + 8]
            at //= 8

    out = []
    for n, g in enumerate(order):
        for at, (there, ident, leaf) in enumerate(sorted(groups[g])):
            out.append((ident if there else None, leaf, trees[g][-1][0], top[-1][0], [*path(trees[g], at), *path(top, n)]))
    return out


def made(found):
    return sorted(((r.i, r.leaf, r.subroot, r.root, [(s.place, s.others) for s in r.path]) for r in found.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_matches_a_slow_tree(spark, levels):
    """Blocks of 8 and 64 leaves, so that butterflies have several rounds and ghosts; lone leaves, null ids and groups, many groups."""
    rows = [(i, g, digest(f"{g}{i}")) for g, n in ((None, 3), ("", 1), ("a", 700), ("é", 65), ("z", 64), *((f"m{k}", 2) for k in range(15))) for i in random.Random(n).sample(range(5000), n)]
    rows += [(None, "a", digest("x")), (None, "a", digest("y"))]
    df = spark.createDataFrame(rows, "i long, g string, d string").repartition(5)
    assert made(merkle.manifest(df, "i", "g", "d", levels=levels)) == sorted(slow_manifest(rows), key=repr)


def test_manifest_edges(spark):
    kind = "i long, g string, d string, root string, leaf int"
    assert merkle.manifest(spark.createDataFrame([], kind), "i", "g", "d").collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, None, "ab", "clash", 2)], kind), "i", "g", "d").first()
    assert (one.leaf, one.subroot, one.root, one.path) == ("ab", "ab", "ab", [])
    same = [(7, "g", digest("s"), "", 1)] * 20
    assert made(merkle.manifest(spark.createDataFrame(same, kind), "i", "g", "d", levels=1)) == sorted(slow_manifest([r[:3] for r in same]), key=repr)


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}", digest(str(i))) for i in range(300)], "i long, g string, d string")
    found = merkle.manifest(df.withColumn("other", F.sha2(F.col("d"), 256)), "i", "g", "d", carry=("other",))
    good, bad = merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"), merkle.fold(F.col("other"), F.col("path")) == F.col("root")
    assert found.agg(F.count_if(good), F.count_if(bad)).first() == (300, 0)


def test_leaves_and_tampering(spark, tmp_path):
    rows = [(1, "Ab", "en", None, 2), (2, None, None, "s", None), (3, "", "en", "", 0), (-4, "Éa", "en", "s", 2), (None, "X", "de", "s", 1), (6, "x", "de", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()}

    def told(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    for i, text, lang, source, n in rows:
        assert got[i].leaf == digest("".join(map(told, (i, source, lang, n, text))))
        changes = i is not None and crc32(str(i).encode()) % 3 == 0 and text is not None and any("A" <= c <= "Z" for c in text)
        assert got[i].verified != changes


# ---- 12

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def counter():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return token_counts.Tokens(file.read())


def counts(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_odd_texts(library, counter):
    texts = ["don't we'll they've they're 'tis ''s !'s 'r 've 'lx 'll 'e i'm he'd 're 'l 'v", "", " ", "\x1c\x85\xa0", "Σίσυφος ΟΔΥΣΣΕΥΣ İstanbul ſ K", "a<|endoftext|>'s <|startoftext|><|endoftext|",
             "日本語テキスト한국어 é 123 ½²", "Ᲊx՘y \U00010d50", "é ́x Å", "'", "''", "a'", "-'s-", "x" * 5000, "ab" * 3000, "😀" * 300]
    assert counter.count(texts).tolist() == counts(library, texts)


def test_token_counts_of_random_texts(library, counter):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choice(a) for _ in range(rng.choice([3, 10, 50, 300])))
             for a in (letters, "ab", "aeiou'srtl ", letters + " '!?.0123ÉßΣſK日本語́̇\x85\xa0", "".join(map(chr, range(32, 127)))) for _ in range(60)]
    vocabulary = [bytes({c: b for b, c in enumerate(token_counts._byte_chars())}[c] for c in w.replace("</w>", "")) for w in list(library.get_vocab())[:20_000] if "<|" not in w]
    texts += [b"".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 8]))).decode("utf-8", "ignore") for _ in range(400)]
    assert counter.count(texts).tolist() == counts(library, texts)


def test_token_counts_cut_and_forget(library, counter, monkeypatch):
    """Small chunks, streams and stores: chunks start inside words, long texts are read in pieces, states are made anew."""
    for name, value in (("CHARS", 3), ("BYTES", 4), ("STREAM", 40), ("TEXT_BYTES", 64), ("MOST_STATES", 50), ("KEPT", 5)):
        monkeypatch.setattr(token_counts, name, value)
    rng = random.Random(6)
    texts = ["".join(rng.choice("the quick brown fox's  don't jump") for _ in range(300)), "internationalisation" * 20, "a" * 200, "x y" * 100, "<|endoftext|>" * 30]
    assert counter.count(texts).tolist() == counts(library, texts)


def test_token_counts_rows(spark, library):
    rows = [(1, "a b", 5), (None, None, 6), (2, "", 7), (1, "a b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert sorted(token_counts.token_counts(df, path).collect(), key=str) == sorted([(1, 3, 2), (None, 0, 0), (2, 0, 0), (1, 3, 2)], key=str)
    assert token_counts.token_counts(df.limit(0), path).collect() == []
    with pytest.raises(ValueError):
        token_counts.Tokens(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_op12_is_what_the_library_counts(spark, library):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op12_token_counts(spark, SF).collect()}
    want = dict(zip(docs, counts(library, list(docs.values())), strict=True))
    assert got == {i: (len(t.encode()), want[i], want[i] > 2048) for i, t in docs.items()}


# ---- 13

def slow_codes(vectors, s):
    whole = vector_codes.integers(vectors, s)
    books = [whole[: s.entries, p].copy() for p in range(s.parts)]

    def nearest(p):
        gaps = ((whole[:, p, None] - books[p][None]) ** 2).sum(axis=2)
        return gaps.argmin(axis=1), gaps.min(axis=1)

    for _ in range(s.rounds):
        for p in range(s.parts):
            code, _ = nearest(p)
            books[p] = np.array([whole[code == k, p].sum(axis=0) // (code == k).sum() if (code == k).any() else books[p][k] for k in range(len(books[p]))])
    found = [nearest(p) for p in range(s.parts)]
    return books, np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)


@pytest.mark.parametrize("cell", [4, 64, 100_000])
def test_codes_match_every_distance(spark, cell):
    """Cells that hold one part and cells that hold all; copies, ties, negative values, a width that four does not divide."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 10)).round(1) * 0.1
    vectors[100:150] = vectors[5]
    s = vector_codes.Settings(entries=16, cell=cell, rows=64, most_cells=40)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    books, coded = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, codes string").repartition(4), s=s)
    want_books, want_codes, want_errors = slow_codes(vectors, s)
    assert all((a == b).all() for a, b in zip(books, want_books, strict=True))
    got = sorted(coded.collect())
    assert [r.codes for r in got] == want_codes.tolist() and [r.error for r in got] == want_errors.tolist()
    back = vector_codes.decode(coded.filter("vec_id = 7"), books, s).first().vector
    assert back == [x / 1024 for p in range(4) for x in want_books[p][want_codes[7][p]].tolist()]


def test_cells_leave_out_dominated_entries():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (256, 16))
    parts = centres[rng.integers(0, 256, 5000)] + rng.integers(-20, 20, (5000, 16))
    cells = vector_codes.Cells(centres, vector_codes.Settings(cell=256))
    code, gap = cells.nearest(parts)
    gaps = ((parts[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (code == gaps.argmin(axis=1)).all() and (gap == gaps.min(axis=1)).all()
    assert cells.evaluated < 10 * cells.asked and cells.made < cells.asked


def test_vectors_that_are_left_out(spark):
    rows = [(1, [1.0, float("nan")] * 4), (2, None), (3, [None, 1.0] * 4), (4, []), (5, [0.5] * 8), (5, [0.5] * 8), (6, [0.1] * 4), (None, [1e300] * 8), (7, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    books, coded = vector_codes.compress(df)
    assert sorted((r.vec_id or 0, r.codes) for r in coded.collect()) == [(0, [2] * 4), (5, [0] * 4), (5, [0] * 4)]
    assert [b.shape for b in books] == [(3, 2)] * 4
    assert vector_codes.compress(df.limit(0))[1].collect() == [] == vector_codes.compress(df.filter("vec_id = 2"))[1].collect()


def test_totals_of_hot_and_rare_keys(spark):
    rows = [(None if i % 3 == 0 else i % 3 if i % 2 else i, i) for i in range(6000)]
    want = {}
    for k, v in rows:
        want[k] = want.get(k, 0) + v
    got = vector_codes.with_total(spark.createDataFrame(rows, "k long, v long"), "k", "v", "total").collect()
    assert sorted((r.v, r.total) for r in got) == sorted((v, want[k]) for k, v in rows)


# ---- 5, 7, 8, 9

def test_the_start_of_texts_is_split(spark):
    s = language_model.Settings(bucket_tokens=2000)
    docs = spark.createDataFrame([(f"w{i} v{i * 7 % 5000}",) for i in range(20_000)], "text string").select(F.lit(True).alias("train"), F.encode("text", "utf-8").alias("text"))
    common, n, tokens = language_model.common_words(docs, s)
    plan = language_model.lay_out(common, n, tokens, s)
    start = np.uint64(language_model.START)
    assert start in plan.split and tokens == 60_000
    dishes = np.array([xxhash.xxh3_64_intdigest(f"w{i}".encode()) for i in range(20_000)], np.uint64)
    load = np.bincount(plan.bucket(np.full(len(dishes), start), dishes), minlength=plan.buckets)
    assert load.max() <= 2 * s.bucket_tokens


def test_wide_rows_with_pairs_of_falling_rank():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert bpe.merges_go_together(ranks)
    falling = [t for t, r in ranks.items() if any(max(ranks.get(t[:c], -1), ranks.get(t[c:], -1)) > r for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks)]
    assert len(falling) > 10_000
    rng = random.Random(2)
    pieces = [b"".join(rng.choice(falling) for _ in range(rng.randint(20, 60))) for _ in range(300)]
    whole = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for piece, ids in zip(pieces, bpe.MatrixBpe(ranks).encode(pieces), strict=True):
        assert len(piece) > bpe.SINGLE_MERGE and np.frombuffer(ids, "<u4").tolist() == whole._encode_single_piece(piece)


def test_ranks_for_which_merges_do_not_go_together():
    ranks = {**{bytes([b]): b for b in range(256)}, b"aba": 299, b"ab": 300}
    assert not bpe.merges_go_together(ranks)
    piece = b"ab" * 50
    assert np.frombuffer(bpe.MatrixBpe(ranks).encode([piece])[0], "<u4").tolist() == [299, 98] * 25


def test_ids_that_are_no_integers(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARE", 3)
    rows = [("b", "x  y"), ("a", "x y"), (None, "x y"), ("c", "z"), ("c", "z"), (None, None), ("d", ""), *[(f"k{i:02}", "hot") for i in range(40)]]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in got) == sorted(
        [("b", "a", 3), ("a", "a", 3), ("None", "a", 3), ("c", "c", 2), ("c", "c", 2), ("None", "d", 2), ("d", "d", 2), *[(f"k{i:02}", "k00", 40) for i in range(40)]])
    assert sorted(str(r.doc_id) for r in got if r.kept) == ["a", "c", "d", "k00"]
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("50", [1.0, 0.0]), ("7", [0.0, 1.0])], "vec_id string, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(vectors, vectors.filter("vec_id = '50'")).collect()] == [(50, 7)]
