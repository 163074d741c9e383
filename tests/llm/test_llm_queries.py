"""The queries of the llm problems against their SQL, or against brute force over whole tables."""

from __future__ import annotations

from collections import defaultdict

import pytest
from conftest import plain, rows

from tarn.llm.leakage import words
from tarn.llm.mail import readable_texts
from tarn.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, data, name):
    mine, other = QUERIES[name](spark, data), duck.sql(ORACLES[name])
    columns = sorted(mine.columns)
    at = [list(other.columns).index(c) for c in columns]
    assert columns == sorted(other.columns)
    assert rows(mine, *columns) == sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=str)


def test_p7_found_is_every_run_of_twelve_words(spark, duck, data):
    runs = defaultdict(set)
    for item, text in duck.sql("SELECT item_id, text FROM eval_items").fetchall():
        w = words(text)
        for k in range(len(w) - 11):
            runs[tuple(w[k : k + 12])].add(item)
    expected = set()
    for doc, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        for part in readable_texts(text):
            w = words(part)
            for k in range(len(w) - 11):
                expected |= {(doc, item) for item in runs.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in QUERIES["p7_found"](spark, data).collect()} == expected


def test_p2_splits_keep_groups_together(spark, data):
    found = QUERIES["p2_splits"](spark, data).collect()
    of = defaultdict(set)
    for r in found:
        of[r["group_id"]].add(r["split"])
    assert found and all(len(s) == 1 for s in of.values())


def test_p6_every_document_has_its_tokens_in_containers(spark, data):
    from tarn.llm.queries import document_sizes
    from tarn.sources.tables import table

    size = {r["doc_id"]: r["n_tokens"] for r in document_sizes(table(spark, data, "documents")).collect()}
    placed, load = defaultdict(int), defaultdict(int)
    for r in QUERIES["p6_containers"](spark, data).collect():
        placed[r["doc_id"]] += r["n_tokens"]
        load[r["container"]] += r["n_tokens"]
    assert placed == size and max(load.values()) <= 4096


def test_p8_pieces_cover_every_oversized_text(spark, duck, data):
    texts, whole = dict(duck.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()), defaultdict(str)
    for r in QUERIES["p8_pieces"](spark, data).orderBy("doc_id", "piece_no").collect():
        assert r["n_tokens"] <= 1024 and texts[r["doc_id"]][r["start_char"] : r["end_char"]] == r["piece"]
        whole[r["doc_id"]] = whole[r["doc_id"]][: r["start_char"]] + r["piece"]
    assert whole and all(texts[d] == t for d, t in whole.items())


def test_p3_pairs_has_pairs_of_one_shared_hand(spark, data):
    assert QUERIES["p3_pairs"](spark, data).agg({"n_ab": "min"}).first()[0] == 1


def test_p7_join_finds_what_the_index_finds(spark, data):
    assert rows(QUERIES["p7_joined"](spark, data)) == rows(QUERIES["p7_overlaps"](spark, data))


def test_p6_containers_hold_no_source_twice(spark, data):
    from tarn.sources.tables import table

    source = {r["doc_id"]: r["source"] for r in table(spark, data, "documents").collect()}
    held = defaultdict(list)
    for r in QUERIES["p6_containers"](spark, data).collect():
        if source[r["doc_id"]] is not None:
            held[r["container"]].append((source[r["doc_id"]], r["doc_id"]))
    rare = {s for s in source.values() if 4 * sum(x == s for x in source.values()) <= len(held)}
    assert all(len({d for x, d in own if x == s}) <= 1 for own in held.values() for s in rare)
