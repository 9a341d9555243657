"""Operator 4 against its SQL and brute force, and edge cases."""

from __future__ import annotations

import duckdb
import pytest

from obsline.llm import license_scan as L


def slow(rows):
    """The best window of each class by comparing all windows with all templates."""
    best = {}
    for doc, text in rows:
        words = L.plain_words(text or "")
        for _, window, stride, _, members in L.classes(L.TEMPLATES):
            for at in range(0, max(len(words) - window + stride - 1, 0) + 1, stride) if words else []:
                have = L.shingles_of(words[at : at + window])
                for i in members:
                    name, want = L.TEMPLATES[i][0], L.shingles_of(L.plain_words(L.TEMPLATES[i][1]))
                    share = len(have & want) / len(want)
                    if share >= L.CONTAINED:
                        s, a = best.get((doc, name), (0, 1 << 60))
                        best[doc, name] = (max(s, share), min(a, at))
    return {(d, n, s, a) for (d, n), (s, a) in best.items()}


def texts():
    filler = " ".join(f"wort{i}" for i in range(37))
    rows = [(100 + i, f"{filler} {t} {filler}") for i, (_, t) in enumerate(L.TEMPLATES)]
    rows += [(200 + i, t.upper().replace(" ", "\n  ")) for i, (_, t) in enumerate(L.TEMPLATES)]
    for i, (_, t) in enumerate(L.TEMPLATES):  # a changed word near the end, and then every fourth word
        words = t.split()
        rows.append((300 + i, filler + " " + " ".join([*words[:-1], "changed"])))
        rows.append((400 + i, " ".join("other" if k % 4 == 3 else w for k, w in enumerate(words))))
    rows += [(1, None), (2, ""), (3, "license"), (4, "Released under the MIT"), (5, "é " * 3000 + "Released under the MIT License." + " ü" * 3000), (None, "Released under the MIT License."),
             (6, "Released under the MIT License. " * 50), (6, "Released under the MIT License.")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 0) for r in texts()], "doc_id long, text string, license string, at int")


def test_scan_matches_brute_force(docs):
    assert {tuple(r) for r in L.scan(docs).collect()} == slow(texts())


def test_every_template_is_found_whole(docs):
    found = {(r.doc_id, r.license) for r in L.scan(docs).collect() if r.containment == 1.0}
    assert all((base + i, name) in found for i, (name, _) in enumerate(L.TEMPLATES) for base in (100, 200))


def test_scan_matches_sql(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in texts() if r[0] is not None and r[0] != 6])
    want = sorted(con.execute(L.OP4_SQL).fetchall())
    assert sorted(tuple(r) for r in L.scan(docs.filter("doc_id <> 6")).collect()) == want


def test_empty_table_and_uncovered_template(docs):
    assert L.scan(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        L.scan(docs, [("x", "a text without such words at all")])


def test_bands_guarantee():
    for _, window, _, bands, members in L.classes(L.TEMPLATES):
        for i in members:
            n = len(L.shingles_of(L.plain_words(L.TEMPLATES[i][1])))
            kept = -(-n * 8 // 10)
            least = kept / (window - L.SHINGLE + 1 + n - kept)
            assert (1 - least) ** bands <= L.MISS


def test_windows_of_very_long_texts_are_cut_in_segments(spark):
    notice = dict(L.TEMPLATES)["MPL-2.0"]
    size = len(L.plain_words(notice))
    rows = []
    for i, at in enumerate((0, 1, L.SEGMENT - size, L.SEGMENT - 20, L.SEGMENT - 1, L.SEGMENT, 2 * L.SEGMENT + 7)):
        rows.append((i, " ".join([*(f"w{j}" for j in range(at)), notice, *(f"v{j}" for j in range(3 * L.SEGMENT - at))])))
    found = {r.doc_id: (r.license, r.containment, r.first_word) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in found.items()} == dict.fromkeys(range(len(rows)), "MPL-2.0")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted((k, *v) for k, v in found.items()) == sorted(con.execute(L.OP4_SQL).fetchall())
