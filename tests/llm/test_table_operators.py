"""Operators 2, 5, 9 and the pipeline on small tables, against brute force and for edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from obsline.llm import ann, language_model, url_filter

SF = "/root/testdata/sf0.001"


# ---- 2

def page(i, url, html="<p>x</p>"):
    return (i, url, html, "clash", "clash")


PAGES = [
    page(1, "https://a.example.com/de/1"), page(2, "https://b.example.org/x", '<LINK rel="canonical" href="https://a.example.com/de/1#top">'),
    page(3, "https://c.example.org/y", "<meta http-equiv='refresh' content='0; url=https://b.example.org/x'>"), page(4, "https://d.example.org/fr/z", '<link href="https://a.example.com/de/1" rel="canonical">'),
    page(5, "https://E.Example.NET/en/q?x#y"), page(6, "http://plain.net"), page(7, "http://plain.net/"), page(8, None), page(9, "no scheme"), page(10, "https://f.example.org/rel/a", '<link rel=canonical href="b">'),
    page(11, "https://f.example.org/rel/b"), page(12, "https://b.example.org/x", None), page(12, "https://b.example.org/x", None), page(13, "https://net.example.com/de"), page(14, "ftp://x.net/?u=http://y.org/fr/"),
    page(15, "https://g.example.org/1", '<link rel="canonical" href="/2"><link rel="stylesheet" href="https://a.example.com/de/1">'), page(16, "https://g.example.org/2", '<link rel="canonical" href="https://bad.net/z">'), page(17, ""),
]


def test_url_filter_follows_aliases_and_matches_sql(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, host string, key string")
    rows = url_filter.judge(pages).collect()
    verdict = {r.page_id: (r.rule, r.verdict) for r in rows}
    assert len(rows) == len(PAGES)
    # 1-2-3 hold an explicit allow (4), so only the page with a rule of its own is blocked.
    assert verdict[1] == ("example.com/de/", "block") and verdict[2] == (None, "allow") and verdict[4] == ("org/fr/", "allow")
    assert verdict[15] == (None, "block") and verdict[16] == (None, "block") and verdict[10] == (None, "allow")
    assert verdict[5] == ("example.net/en/", "allow") and verdict[6] == (None, "allow") and verdict[7] == ("net/", "block")
    assert verdict[8] == verdict[9] == verdict[17] == (None, "allow") and verdict[14] == ("net/", "block")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [p[:3] for p in PAGES])
    sql = con.execute(f"SELECT DISTINCT page_id, host, path, rule, verdict FROM ({url_filter.OP2_SQL})").fetchall()
    assert sorted(set(map(tuple, rows)), key=str) == sorted(sql, key=str)


def test_url_filter_with_known_redirects_and_empty(spark):
    pages = spark.createDataFrame([page(1, "https://ok.org/a"), page(2, "https://ok.org/b")], "page_id long, url string, html string, host string, key string")
    edges = spark.createDataFrame([("https://ok.org/a", "https://other.org/1"), ("https://other.org/1", "https://spam.net/x")], "a string, b string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, edges=edges).collect()} == {1: "block", 2: "allow"}
    assert url_filter.judge(pages.limit(0)).collect() == []


# ---- 5

def folds(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check_counts(rows, texts):
    words = [(i, (t or "").encode().lower().split()) for i, t in texts]
    c = Counter(w for i, ws in words if not folds(i) for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, ws in words:
        tokens = [*ws, None]
        want[i, folds(i), len(tokens), sum(c[w] > 0 for w in tokens), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert all(r.score < 0 for r in rows)


def test_language_model_counts_and_beats_its_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_model.language_model(docs).collect()
    check_counts(rows, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_edges(spark):
    odd = [(1, None), (2, ""), (3, "A b"), (3, "a b"), (None, "a b c"), (5, "x " * 5000), (10, "never seen before"), (12, "a")]
    docs = spark.createDataFrame([(*r, "clash") for r in odd], "doc_id long, text string, held string")
    check_counts(language_model.language_model(docs).collect(), odd)
    assert language_model.language_model(docs.limit(0)).collect() == []


def lm_texts(n=60, seed=4):
    rng = random.Random(seed)
    after = {i: rng.sample(range(20), 4) for i in range(20)}
    out = []
    for _ in range(n):
        w, words = rng.randrange(20), []
        for _ in range(rng.randrange(5, 40)):
            words.append(f"w{w}")
            w = rng.choice(after[w]) if rng.random() < 0.8 else int(20 * rng.random() ** 3)
        out.append(" ".join(words))
    return out


def test_language_model_does_not_depend_on_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    layouts = [(1, language_model.Settings()), (8, language_model.Settings(bucket_tokens=20_000, block_bytes=50_000)), (64, language_model.Settings(bucket_tokens=2_000, common=50))]
    found = [sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in language_model.language_model(docs.repartition(n), s).collect()) for n, s in layouts]
    assert found[0] == found[1] == found[2]


def test_language_model_splits_hot_contexts(spark):
    rows = [(i, " ".join(f"hot x{(i * 7 + j) % 50}" for j in range(40))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    s = language_model.Settings(bucket_tokens=500)
    common, counts, tokens = language_model.common_words(docs.select(F.lit(True).alias("train"), F.col("text").cast("binary").alias("text")), s)
    assert len(language_model.lay_out(common, counts, tokens, s).split) and not len(language_model.lay_out(common, counts, tokens, language_model.Settings()).split)
    a, b = (sorted((r.doc_id, round(r.score, 3)) for r in language_model.language_model(docs, x).collect()) for x in (s, language_model.Settings()))
    assert a == b and a[0][0] == "0"


class SlowModel:
    """Restaurants with tables in lists; one customer after the other leaves and is seated again."""

    def __init__(self, docs):
        self.rng = random.Random(9)
        self.theta, self.d = [10.0, 1.0], [0.5, 0.5]
        self.types = len({w for d in docs for w in [*d, "</s>"]})
        self.rooms = defaultdict(lambda: defaultdict(list))  # context: dish: sizes of tables; None is the root
        self.customers = [(u, w) for d in docs for u, w in zip(["<s>", *d], [*d, "</s>"], strict=True)]
        self.parents = {}
        for u, w in self.customers:
            self.add(u, w)

    def p(self, u, w):
        level = 0 if u is None else 1
        room = self.rooms[u]
        below = 1 / (self.types + 1) if u is None else self.p(None, w)
        n, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        own = room.get(w, [])
        return (sum(own) - self.d[level] * len(own) + (self.theta[level] + self.d[level] * t) * below) / (self.theta[level] + n)

    def add(self, u, w):
        level = 0 if u is None else 1
        room, sizes = self.rooms[u], self.rooms[u][w]
        below = 1 / (self.types + 1) if u is None else self.p(None, w)
        new = (self.theta[level] + self.d[level] * sum(map(len, room.values()))) * below
        at = self.rng.choices(range(len(sizes) + 1), [*(x - self.d[level] for x in sizes), new])[0]
        if at < len(sizes):
            sizes[at] += 1
        else:
            sizes.append(1)
            if u is not None:
                self.add(None, w)

    def remove(self, u, w):
        sizes = self.rooms[u][w]
        at = self.rng.choices(range(len(sizes)), sizes)[0]
        sizes[at] -= 1
        if not sizes[at]:
            del sizes[at]
            if u is not None:
                self.remove(None, w)

    def sweep(self):
        for u, w in self.customers:
            self.remove(u, w)
            self.add(u, w)
        for level in (0, 1):
            rooms = [r for u, r in self.rooms.items() if (u is None) == (level == 0)]
            held = [sum(x) for r in rooms for x in r.values() if x]
            d = language_model._discount(held.count(1), held.count(2))
            sums = language_model.strength_stats(self.theta[level], self.d[level], np.array([sum(map(sum, r.values())) for r in rooms]), np.array([sum(map(len, r.values())) for r in rooms]))
            self.theta[level] = language_model._strength(sums, self.theta[level])
            if level == 0 or not hasattr(self, "fixed"):
                self.d[level] = d
        self.fixed = True


def test_language_model_agrees_with_slow_gibbs(spark):
    texts = lm_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ours = {r.doc_id: r for r in language_model.language_model(docs, language_model.Settings(burn_in=6, samples=12)).collect()}
    slow = SlowModel([t.split() for i, t in enumerate(texts) if not folds(i)])
    total = defaultdict(float)
    for n in range(24):
        slow.sweep()
        if n >= 8:
            for u, w in {(u, w) for t in texts for u, w in zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True)}:
                total[u, w] += slow.p(u, w) / 16
    gaps = [sum(math.log10(total[u, w]) for u, w in zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True)) / ours[i].n_tokens - ours[i].score / ours[i].n_tokens for i, t in enumerate(texts)]
    assert abs(np.mean(gaps)) < 0.01 and np.max(np.abs(gaps)) < 0.05, gaps


def test_probabilities_sum_to_one(spark):
    """All dishes and one unknown after one context, each asked for by a held-out text."""
    ids = [i for i in range(2000) if folds(i)]
    words = [f"w{i}" for i in range(20)] + ["unknown"]
    train = [(i, t) for i, t in enumerate(lm_texts(200)) if not folds(i)]
    asks = [(i, f"w3 {w}") for i, w in zip(ids, words, strict=False)] + [(ids[-1], "w3")]
    found = {r.doc_id: r.score for r in language_model.language_model(spark.createDataFrame(train + asks, "doc_id long, text string")).collect()}
    end = {r.doc_id: r.score for r in language_model.language_model(spark.createDataFrame(train + [(i, w) for i, w in zip(ids, words, strict=False)] + [(ids[-1], "")], "doc_id long, text string")).collect()}
    # log p(w3 | start) + log p(w | w3) + log p(end | w) less log p(w | start) + log p(end | w)
    start = {w: end[i] for i, w in zip(ids, words, strict=False)}
    first = 10 ** end[ids[-1]]
    after = {w: found[i] - start[w] for i, w in zip(ids, words, strict=False)}
    assert all(math.isfinite(x) for x in after.values()) and 0 < first < 1
    model = SlowModel([t.split() for _, t in train])
    assert abs(sum(model.p("w3", w) for w in [*words, "</s>"]) - 1) < 1e-9


def test_draws_match_seat_by_seat_gibbs():
    rng = random.Random(5)
    for c, a, d in ((6, 0.4, 0.6), (40, 3.0, 0.7)):
        sizes, seen = [c], []
        for n in range(4000):
            at = rng.choices(range(len(sizes)), sizes)[0]
            sizes[at] -= 1
            sizes = [x for x in sizes if x]
            at = rng.choices(range(len(sizes) + 1), [*(x - d for x in sizes), a])[0]
            sizes = [*sizes, 1] if at == len(sizes) else [x + (i == at) for i, x in enumerate(sizes)]
            if n > 200:
                seen.append(len(sizes))
        keys = language_model.mixed(np.arange(20_000, dtype=np.uint64))
        drawn = language_model.draw_tables(np.full(20_000, c), np.full(20_000, a), d, keys, 1)
        assert abs(drawn.mean() - np.mean(seen)) < 0.35, (c, drawn.mean(), np.mean(seen))


def test_limit_draws_match_stirling_numbers():
    exact = language_model.stirling(0.7, 600)
    keys = language_model.mixed(np.arange(20_000, dtype=np.uint64))
    for c, a in ((200, 0.5), (600, 3.0), (600, 80.0), (600, 2000.0)):
        t = np.arange(1, c + 1)
        p = np.exp((w := np.log(a) * t + exact[c, 1 : c + 1]) - w.max())
        mean = (p * t).sum() / p.sum()
        drawn = language_model.draw_tables(np.full(20_000, c), np.full(20_000, a), 0.7, keys, 2)
        assert abs(drawn.mean() / mean - 1) < 0.03
        assert abs(drawn.std() / math.sqrt((p * t * t).sum() / p.sum() - mean**2) - 1) < 0.1
    assert (language_model.draw_tables(np.ones(5, np.int64), np.full(5, 1e9), 0.7, keys[:5], 1) == 1).all()


# ---- 9

def slow_nearest(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 50 == 0:
            scored = {j: float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v))) for j, v in good if j != i}
            out[i] = sorted(((-round(s, 9), j) for j, s in scored.items()))[:k]
    return out


def test_ann_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = ann.nearest(rows, rows.filter("vec_id % 50 = 0")).collect()
    want = slow_nearest([(r.vec_id, r.embedding) for r in rows.collect()])
    got = {q: sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q) for q in want}
    hits = sum(len({v for _, v, _ in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all([r for r, _, _ in g] == list(range(1, len(g) + 1)) and [s for *_, s in g] == sorted((s for *_, s in g), reverse=True) for g in got.values())


def test_ann_recall_where_the_share_is_many_lists(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).standard_normal((6000, 256)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(df, df.filter("vec_id % 100 = 0"), ann.Settings(per_list=6)).collect()  # 600 of 1000 lists are probed
    want = slow_nearest(rows)
    assert len(found) == 60 * 5
    assert sum(r.vec_id in {j for _, j in want[r.query_id]} for r in found) >= 0.95 * len(found)


def test_ann_recall_on_many_vectors_without_clusters(spark, tmp_path):
    """Fifty lists at the production settings, twenty of which a query passes over."""
    v = np.random.default_rng(8).standard_normal((50_000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 64).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    found = ann.nearest(df, df.filter("vec_id % 250 = 0")).collect()
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(v), 250):
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(set(np.argsort(-scores)[:5].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert len(found) == 200 * 5 and hits >= 0.9 * len(found), hits / len(found)


def test_ann_of_very_large_and_small_components(spark):
    rng = np.random.default_rng(11)
    rows = [(i, (rng.standard_normal(16) * (1e200 if i % 7 == 2 else 1e-200 if i % 7 == 3 else 1)).tolist()) for i in range(140)]
    found = ann.nearest(df := spark.createDataFrame(rows, "vec_id long, embedding array<double>"), df.filter("vec_id % 50 = 0")).collect()
    want = {q: [j for _, j in x] for q, x in slow_nearest([(i, (np.array(v) / max(map(abs, v))).tolist()) for i, v in rows]).items()}
    assert {q: [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in want} == want


def test_ann_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    same = rng.standard_normal(8).tolist()
    rows = [(i, same) for i in range(0, 120)] + [(i, rng.standard_normal(8).tolist()) for i in range(200, 260)]
    rows += [(300, None), (350, [0.0] * 8), (400, [float("nan")] * 8), (450, [1.0, None] * 4), (500, []), (550, [1.0] * 3), (None, same), (0, same)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, v string")
    found = ann.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [j for _, j in v] for q, v in slow_nearest([r for r in rows if not (r[1] and len(r[1]) == 3)]).items()}
    assert got.pop(0) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]  # asked twice
    want.pop(0)
    assert got == want
    assert ann.nearest(df.limit(0), df).collect() == [] and ann.nearest(df, df.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 1)]


def test_bounds_hold_for_nearly_all():
    rng = np.random.default_rng(2)
    v, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.standard_normal((2000, 64)), rng.standard_normal((40, 64))))
    turn = ann.rotation(64, 1)
    shelf = ann.Shelf(v, *ann.encode(v, turn), np.zeros(len(v), np.int32))
    of, at = shelf.search(q, np.zeros((1, 64)), turn, 1, 5, 2.5)
    best = np.argsort(-(q @ v.T), axis=1)[:, :5]
    assert np.mean([len(set(b) & set(at[of == i])) / 5 for i, b in enumerate(best)]) > 0.95
    assert shelf.measured < 0.6 * len(v) * len(q)


# ---- pipeline

def test_pipeline_stages_keep_columns_and_clean_rows(spark, tmp_path):
    import corpus_pipeline as c

    clean = [" ".join(f"w{(i * 37 + j * j) % 997}" for j in range(60)) for i in range(300)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(400 + i, clean[i].replace(" ", "  "), "en", "copy", 1) for i in range(20)] + [(500 + i, clean[i] + " idiot vile scum", "en", "toxic", 1) for i in range(100)] + [(0, clean[0], "en", "s0", len(clean[0]))]
    rows += [(700, None, "en", "none", 0), (None, "a null id", "en", "none", 9)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, stage_mark int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(500 + i, 1, 1) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in c.STAGES[:-1]:
        now = c.materialise(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns, name
        seen.append(Counter(r.source for r in now.collect()))
    assert seen[0]["toxic"] == 0 and seen[0]["copy"] == 20 and seen[0]["s0"] == 101
    assert seen[1]["copy"] == 0 and sum(seen[1][s] for s in ("s0", "s1", "s2")) == 300 and seen[1]["none"] == 2
    ids = [r.doc_id for r in now.collect()]
    assert len(ids) == len(set(ids)) and set(range(300)) - set(ids) == set() and None in ids
    pieces = c.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(ids)


def test_pipeline_runs_on_documents(spark):
    import corpus_pipeline as c

    out = c.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    assert [n for n, _ in c.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]


def test_words_are_ascii_words():
    text = "A\x0bb\x1cC　d É"
    assert text.encode().lower().split() == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]


@pytest.mark.parametrize("name", ["op2_url_filter", "op3_chat_format", "op8_exact_dedup"])
def test_registered_queries_with_sql(spark, name):
    from obsline.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=str) == sorted(con.execute(ORACLE_SQL[name]).fetchall(), key=str)


def test_near_stage_keeps_one_row_of_each_component_whatever_the_ids(spark):
    import corpus_pipeline as c

    text = [" ".join(f"w{(i * 37 + j * j) % 997}" for j in range(60)) for i in range(20)]
    clean = [(None, t) for t in text[:10]] + [(7, t) for t in text[10:14]] + [(1, text[14]), (8, text[15]), (9, text[16])]
    copies = [(2, text[14].upper()), (8, text[14].title()), (None, text[14] + " "), (9, text[16]), (None, text[16].upper())]
    docs = spark.createDataFrame([(i, t, "x") for i, t in clean + copies], "doc_id long, text string, source string")
    found = c.near_stage(spark, docs, "")
    assert found.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(clean)


def test_language_model_without_training_text(spark):
    ids = [i for i in range(200) if folds(i)][:4]
    odd = [(ids[0], "a b"), (ids[1], None), (ids[2], "a " * 200), (ids[3], "A")]
    rows = language_model.language_model(spark.createDataFrame(odd, "doc_id int, text string")).collect()
    assert {r.doc_id: (r.held_out, r.n_known, r.train_tokens, r.base_score, abs(r.score)) for r in rows} == {i: (True, 0, 0, 0.0, 0.0) for i in ids}
