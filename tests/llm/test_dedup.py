"""Exact dedup, substring dedup and the Jaccard join against brute force."""

import re

import pytest
from brute import DOCUMENT, awkward, components, copies, documents, passages, sha, without_repeats

from passbook.llm import jaccard
from passbook.llm.components import components as connected
from passbook.llm.exact_dedup import OpenTable, exact_dedup
from passbook.llm.jaccard import jaccard_join
from passbook.llm.substring import substring_dedup


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def groups(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    out = []
    for i, n in norm.items():
        same = [j for j, m in norm.items() if m == n]
        out.append((i, min(same), len(same), i == min(same), sha(n)))
    return sorted(out)


@pytest.mark.parametrize("room", [64 << 20, 900])
def test_exact_groups(spark, room):
    """Small tables are split again and again; the result is the same."""
    docs = documents(spark, [*copies(1, 150), *copies(1, 40), "a\tb", "a b", "a  b"])
    found = sorted(tuple(r) for r in exact_dedup(docs, table_bytes=room).collect())
    assert found == groups(rows_of(docs))


def test_exact_awkward(spark):
    found = exact_dedup(awkward(spark)).collect()
    assert len(found) == 9
    kept = [(r.doc_id, r.group_size) for r in found if r.kept]
    assert sorted(kept) == [(1, 3), (2, 3), (4, 1), (5, 1), (6, 1)]


def test_table_compares_content():
    table = OpenTable()
    assert [table.put(7, "a"), table.put(7, "b"), table.put(7, "a")] == [0, 1, 0]
    assert [table.put(k, str(k)) for k in range(5000)] == [*range(2, 5002)]


def test_substrings(spark):
    docs = documents(spark, passages(2, 150))
    found = sorted(tuple(r) for r in substring_dedup(docs, with_text=False).collect())
    assert found == without_repeats(rows_of(docs))
    assert sum(r[2] for r in found) > 1000


def test_substrings_awkward(spark):
    found = substring_dedup(awkward(spark)).collect()
    assert sorted(r.n_words for r in found) == [0, 0, 0, 0, 6, 6, 6, 6, 30_000]
    assert sum(r.n_removed for r in found) == 0


def test_jaccard(spark):
    docs = documents(spark, copies(5, 250))
    found = sorted(tuple(r) for r in jaccard_join(docs).collect())
    assert found == components(rows_of(docs))


def test_jaccard_tiles(spark, monkeypatch):
    """Blocks that are cut into tiles give the same links."""
    monkeypatch.setattr(jaccard, "TILE", 500)
    docs = documents(spark, copies(6, 120))
    found = sorted(tuple(r) for r in jaccard_join(docs).collect())
    assert found == components(rows_of(docs))


def test_jaccard_awkward(spark):
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(awkward(spark)).collect()), key=str)
    want = [(1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 0, 5), (6, 2, 1), (None, 0, None), (None, 2, None)]
    assert found == sorted(want, key=str)


def two_words_of_one_sum():
    """Different words that collide in every polynomial hash modulo 2^64."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    return a, b


def test_words_that_collide_in_polynomial_hashes(spark):
    a, b = two_words_of_one_sum()
    assert a != b and len(a) == len(b)
    text = lambda w: " ".join(f"{w} {i}" for i in range(40))
    docs = documents(spark, [text(a), text(b), text(a) + " end"])
    assert sorted(tuple(r) for r in substring_dedup(docs, with_text=False).collect()) == without_repeats(rows_of(docs))
    assert sorted(tuple(r) for r in jaccard_join(docs).collect()) == components(rows_of(docs))


def test_one_id_with_several_texts_is_one_document(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "xyz")
    rows = [(0, a), (1, a), (1, b), (2, b + " near"), (5, c), (9, c), (9, a + " more"), (7, None), (7, c + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENT).repartition(3)
    found = sorted((r.doc_id, r.component_id) for r in jaccard_join(docs).collect())
    assert found == [(0, 0), (1, 0), (1, 0), (2, 0), (5, 0), (7, 0), (7, 7), (9, 0), (9, 0)]


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r.id: r.low for r in connected(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("operator", [exact_dedup, substring_dedup, jaccard_join])
def test_no_rows(spark, operator):
    assert operator(documents(spark, ["a"]).limit(0)).count() == 0
