from __future__ import annotations

import base64
import quopri
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import chunking, leakage, mail, packing, splits, subsequences, tokens, topn
from tarn.llm.cooccurrence import item_pairs

# Problem 1


def patterns_by_force(seqs, least, low, high):
    has = defaultdict(set)
    for part, who, items in seqs:
        if part is None or who is None or items is None:
            continue
        items = [i for i in items if i is not None]
        for n in range(low, high + 1):
            for c in combinations(items, n):
                has[part, c].add(who)
    return {(p, c, len(w)) for (p, c), w in has.items() if len(w) >= least}


@pytest.mark.parametrize(("chunk", "task"), [(1, 10**6), (4, 20), (1000, 10**6), (50, 1)])
def test_subsequences_against_brute_force(spark, chunk, task):
    r = random.Random(chunk)
    hot = lambda: 0 if r.random() < 0.4 else r.randrange(1, 4)
    seqs = [(hot(), r.randrange(25), [r.choice("abcd") for _ in range(r.randrange(0, 8))]) for _ in range(300)]
    seqs += seqs[:20] + [(None, 1, ["a", "b", "c"]), (0, None, ["a", "b", "c"]), (0, 1, None), (0, 2, ["a", None, "b", "c"])]
    df = spark.createDataFrame(seqs, "t int, w int, s array<string>").withColumns({"part": F.lit(1), "who": F.lit("x"), "db": F.lit(2)})
    found = subsequences.frequent_subsequences(df, "t", "w", "s", 7, 2, 4, chunk_sequences=chunk, least_local=2, task_sequences=task)
    assert {(p[0], tuple(p[1]), p[2]) for p in found.select("t", "pattern", "support").collect()} == patterns_by_force(seqs, 7, 2, 4)


def test_subsequences_of_nothing(spark):
    df = spark.createDataFrame([], "t int, w int, s array<string>")
    assert subsequences.frequent_subsequences(df, "t", "w", "s", 2).count() == 0


def sequences(entities):
    """Entities of one partition, each a list of sequences, as the miner sees them."""
    rows = [(1, 0, None, None, i, s) for i, own in enumerate(entities) for s in own]
    names = [*subsequences.KEYS, "who", "s"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
    return subsequences.Sequences(pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names))


def mined(entities, least, low, high):
    data = sequences(entities)
    words = data.words.to_pylist()
    return {tuple(words[i] for i in p) for _, grown in subsequences.mine(data, np.array([least]), low, high) for p in grown}


def test_long_sequences_do_not_explode():
    long = [["x"] * 400 + [str(i) for i in range(300)]]
    assert mined([long, [["x", "x", "x"]]], 2, 3, 5) == {("x", "x", "x")}


def test_a_chunk_is_mined_alike_in_small_runs(monkeypatch):
    r = random.Random(3)
    entities = [[[r.choice("abcde") for _ in range(r.randrange(3, 9))] for _ in range(r.randrange(1, 4))] for _ in range(40)]
    every = mined(entities, 6, 2, 4)
    has = Counter(c for own in entities for c in {c for s in own for n in (2, 3, 4) for c in combinations(s, n)})
    assert every == {c for c, n in has.items() if n >= 6}
    monkeypatch.setattr(subsequences, "EXTENDED", 10)
    assert mined(entities, 6, 2, 4) == every
    data = sequences(entities)
    code = {w: i for i, w in enumerate(data.words.to_pylist())}
    asked = [*sorted(every)[:50], ("a", "a", "a", "a")]
    found = subsequences.count(data, np.zeros(len(asked), np.int64), [np.array([code[w] for w in p]) for p in asked])
    assert found.tolist() == [has[p] for p in asked]


def test_a_wrong_local_support_would_lose_patterns(spark):
    """Twelve entities have the pattern, spread over chunks that are mined one by one: no chunk alone has it twelve times."""
    rows = [(0, w, [1, 2, 3]) for w in range(12)] + [(0, w, [4, 5, 6 + w]) for w in range(12, 60)]
    df = spark.createDataFrame(rows, "t int, w int, s array<int>")
    found = subsequences.frequent_subsequences(df, "t", "w", "s", 12, chunk_sequences=5).collect()
    assert [(r["pattern"], r["support"]) for r in found] == [([1, 2, 3], 12)]


# Problem 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(1, 7))
def test_differencing_places_every_weight(weights, bins):
    out = splits.largest_differencing(weights, bins)
    assert len(out) == len(weights) and all(0 <= b < bins for b in out)


def test_differencing_balances():
    w = np.random.default_rng(1).integers(1, 1000, 3000).tolist()
    sums = Counter()
    for x, b in zip(w, splits.largest_differencing(w, 20)):
        sums[b] += x
    assert max(sums.values()) - min(sums.values()) <= 3


def test_balanced_splits_follow_the_shares(spark):
    df = spark.range(5000).selectExpr("id as g", "1 + id % 7 as w", "'x' as part", "1 as slot")
    df = df.unionByName(spark.createDataFrame([(None, 5, "x", 1)], "g bigint, w bigint, part string, slot int")).withColumn("w", F.when(F.col("g") == 3, None).otherwise(F.col("w")))
    out = splits.balanced_splits(df, "g", "w", {"a": 0.8, "b": 0.1, "c": 0.1}, 50, task_rows=600)
    total = dict(rows(out.groupBy("split").agg(F.sum("w").alias("w"))))
    whole = sum(total.values())
    assert out.count() == 5000 and all(abs(total[s] / whole - share) < 0.015 for s, share in {"a": 0.8, "b": 0.1, "c": 0.1}.items())
    assert splits.balanced_splits(df.limit(0), "g", "w", {"a": 1.0}).count() == 0


def test_sums_are_combined_over_several_levels(spark):
    df = spark.range(4000).selectExpr("id as g", "1 + id % 5 as w")
    out = splits.balanced_splits(df, "g", "w", {"a": 0.7, "b": 0.3}, 10, task_rows=40).cache()
    per_bin = [r["w"] for r in out.groupBy("bin").agg(F.sum("w").alias("w")).collect()]
    assert out.count() == 4000 and len(per_bin) == 10 and max(per_bin) - min(per_bin) <= 5
    assert abs(out.filter("split = 'a'").agg(F.sum("w")).first()[0] / 12000 - 0.7) < 0.01


def test_a_group_with_a_third_of_all_records_stays_whole(spark):
    links = spark.range(300).selectExpr("cast(id as int) as r", "case when id < 100 then 'hot' else concat('p', id div 2) end as p")
    out = splits.related_splits(links.select("r"), "r", links, "p", {"train": 0.8, "validation": 0.1, "test": 0.1})
    per = out.groupBy("group_id").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0]
    assert out.count() == 300 and per == 1 and out.filter("group_id = 0").count() == 100


def test_torn_groups(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "r int, group_id int")
    folds = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (3, None), (4, 1), (4, 1), (None, 3)], "r int, f int")
    assert rows(splits.torn_groups(members, "r", folds, "f"), "r", "group_id") == [(1.0, 1.0), (2.0, 1.0)]


# Problem 3


def test_pairs_against_brute_force(spark):
    r = random.Random(4)
    baskets = [(r.choice([0, 0, 1, None]), [r.choice([None, *range(6)]) for _ in range(r.randrange(0, 5))]) for _ in range(200)] + [(1, None)]
    n, one, two = Counter(), Counter(), Counter()
    for s, items in baskets:
        items = sorted({i for i in items or [] if i is not None})
        if s is None or not items:
            continue
        n[s] += 1
        one.update((s, i) for i in items)
        two.update((s, *p) for p in combinations(items, 2))
    expected = sorted((s, a, b, c, one[s, a], one[s, b], n[s], c * n[s] / (one[s, a] * one[s, b])) for (s, a, b), c in two.items())
    df = spark.createDataFrame(baskets, "s int, items array<int>").withColumns({"scope": F.lit(9), "w": F.lit("x"), "n": F.lit(0)})
    found = sorted(tuple(r) for r in item_pairs(df, "s", "items").select("s", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", "lift").collect())
    assert [f[:7] for f in found] == [e[:7] for e in expected]
    assert np.allclose([f[7] for f in found], [e[7] for e in expected])
    assert item_pairs(df.limit(0), "s", "items").count() == 0


def test_a_large_basket_is_cut_into_blocks(spark):
    df = spark.createDataFrame([(0, list(range(57))), (0, [3, 9]), (1, list(range(10, 33)))], "s int, items array<int>")
    whole = sorted(map(tuple, item_pairs(df, "s", "items").collect()), key=str)
    assert sorted(map(tuple, item_pairs(df, "s", "items", block=10).collect()), key=str) == whole and len(whole) == 57 * 28 + 23 * 11


# Problem 4


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_top_n_against_brute_force(spark, batch):
    r = random.Random(5)
    data = [(r.choice(["hot", "hot", None, *"abcdefg"]), r.choice([None, 1, 2, 3]), r.randrange(40), r.choice(["u", None])) for _ in range(500)]
    data += data[:30]
    df = spark.createDataFrame(data, "g string, s int, i int, place string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = topn.top_n(df, ["g"], [F.col("s").desc_nulls_last()], ["i"], 4).select("g", "place", "s", "i").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = defaultdict(list)
    for g, s, i, _ in data:
        groups[g].append((-(s if s is not None else -99), i, s))
    expected = {(g, k + 1, s, i) for g, own in groups.items() for k, (_, i, s) in enumerate(sorted(own, key=lambda x: x[:2])[:4])}
    assert {tuple(r) for r in found} == expected and len(found) == sum(min(4, len(v)) for v in groups.values())
    assert topn.top_n(df.limit(0), ["g"], [F.col("s")], ["i"], 2).count() == 0


# Problem 6


def check_packing(sizes, clusters, capacity, out):
    load, holds = Counter(), defaultdict(list)
    for i, own in enumerate(out):
        at = 0
        for b, start, length in own:
            assert start == at and length <= capacity
            at += length
            load[b] += length
            if clusters[i] is not None:
                holds[b].append((clusters[i], i))
        assert at == sizes[i] and (len(own) == 1 or sizes[i] > capacity)
    assert all(v <= capacity for v in load.values())
    for own in holds.values():
        for c in {c for c, _ in own}:
            assert len({i for d, i in own if d == c}) == 1
    return load


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from([None, "a", "b"]), st.sampled_from([None, "x", "y", "z"])), max_size=40))
def test_packing_rules(items):
    sizes, sources, clusters = [i[0] for i in items], [i[1] for i in items], [i[2] for i in items]
    check_packing(sizes, clusters, 10, packing.pack(sizes, sources, clusters, 10))


def test_packing_is_nearly_full():
    r = random.Random(6)
    sizes = [int(r.lognormvariate(6.8, 0.8)) for _ in range(6000)]
    sources = [r.choice(["hot", *map(str, range(20))]) if r.random() > 0.3 else "hot" for _ in sizes]
    load = check_packing(sizes, [None] * 6000, 4096, packing.pack(sizes, sources, [None] * 6000, 4096))
    assert sum(sizes) / (len(load) * 4096) > 0.99


def test_sources_are_kept_apart_unless_one_is_too_common():
    r = random.Random(9)
    sizes = [r.randrange(50, 900) for _ in range(2000)]
    sources = [r.choice("abcdefghijklmnopqrst") for _ in sizes]
    def shared(s, strict=None):
        held = Counter((b, x) for x, own in zip(s, packing.pack(sizes, s, [None] * 2000, 2048, strict)) for b, _, _ in own)
        return {x for (_, x), n in held.items() if n > 1}
    assert shared(sources) == set() and shared(sources, False)
    hot = [x if i % 3 else "hot" for i, x in enumerate(sources)]
    assert shared(hot) == {"hot"} and shared(hot, True) == set()


def test_a_cluster_with_a_third_of_all_rows(spark):
    df = spark.range(3000).selectExpr("id", "100 + id % 50 as n", "'s' as source", "case when id % 3 = 0 then 'copies' end as c", "1 as container")
    out = packing.containers(df, "id", "n", "source", "c", 1000, shard_items=700)
    copies = out.join(df.filter("c is not null").select("id"), "id").groupBy("container").count()
    assert out.count() == 3000 and copies.agg(F.max("count")).first()[0] == 1


def test_containers_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, -5, "a", "c"), (3, 25, "a", "c"), (3, 7, "a", "c"), (None, 4, "a", "c"), (4, 0, "a", "c")], "i int, n int, s string, c string")
    out = packing.containers(df, "i", "n", "s", "c", 10)
    assert rows(out.groupBy("i").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("k"))) == [(1.0, 0.0, 1.0), (2.0, 0.0, 1.0), (3.0, 25.0, 3.0), (4.0, 0.0, 1.0)]
    assert packing.containers(df.limit(0), "i", "n", "s", "c", 10).count() == 0


# Problem 7


def test_masks_cover_every_two_substitutions():
    seeds = leakage.masks(12, 4, 2)
    assert len(seeds) == 6
    for off in combinations(range(12), 2):
        assert any(not set(off) & set(m.tolist()) for m in seeds)


def overlaps_by_force(docs, items, window, most):
    out = {}
    for d, text in docs:
        w = leakage.words(text or "")
        for i, body in items:
            v = leakage.words(body or "")
            best = min((sum(a != b for a, b in zip(w[x : x + window], v[y : y + window])) for x in range(len(w) - window + 1) for y in range(len(v) - window + 1)), default=99)
            if d is not None and i is not None and best <= most:
                out[d, i] = best
    return out


@pytest.mark.parametrize("block", [10**6, 0])
def test_leaks_against_brute_force(spark, block):
    r = random.Random(7)
    text = lambda n: " ".join(r.choice("abcdefgh") + r.choice("01") for _ in range(n))
    items = [(i, text(r.randrange(5, 30))) for i in range(12)] + [(99, None), (98, ""), (None, text(20))]
    docs = []
    for d in range(40):
        body = text(40).split()
        for _ in range(2):
            part = r.choice(items[:12])[1].split()[:14]
            for _ in range(r.randrange(0, 4)):
                part[r.randrange(len(part))] = "new"
            body[10:10] = part
        docs.append((d, ", ".join(body).upper()))
    docs += [(200, None), (201, ""), (None, items[0][1])]
    find = lambda a, b: leakage.leaked_items(
        spark.createDataFrame(a, "d bigint, t string").withColumn("item", F.lit(3)), "d", "t", spark.createDataFrame(b, "i bigint, x string").withColumn("doc", F.lit(1)), "i", "x", block_words=block
    )
    assert {(r["d"], r["i"]): r["substitutions"] for r in find(docs, items).collect()} == overlaps_by_force(docs, items, 12, 2)
    assert find([], items).count() == 0 and find(docs, []).count() == 0


def test_many_items_share_a_passage_with_many_documents(spark):
    shared = " ".join(f"w{i}" for i in range(14))
    items = spark.range(300).select("id", F.concat(F.lit(shared), F.lit(" own"), "id").alias("x"))
    docs = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, F.lit(shared.replace("w5", "new"))).otherwise("none of it").alias("t"))
    out = leakage.leaked_items(docs, "id", "t", items.withColumnRenamed("id", "i"), "i", "x", block_words=0)
    assert out.count() == 67 * 300 and {r[0] for r in out.select("substitutions").distinct().collect()} == {1}


def test_readable_texts_of_a_nested_message():
    passage = "The second loom of Belonna isn't far and the brewers know it well by now"
    html = f"<html><style>p{{}}</style><body><p>{passage.replace(' ', '&nbsp; ').replace(chr(39), '&rsquo;')}</p></body></html>"
    attached = base64.encodebytes(passage.encode("utf-16-le")).decode()
    quoted = quopri.encodestring(("\n".join("AB> > " + line for line in (passage[:30], passage[30:]))).encode()).decode()
    word = base64.b64encode(passage[:40].encode()).decode()
    message = (
        f"Subject: =?utf-8?B?{word}?=\n =?utf-8?Q?{passage[40:].replace(' ', '_')}?=\nContent-Type: multipart/mixed; boundary=\"b 1\"\n\npreamble\n--b 1\n"
        f"Content-Type: multipart/alternative;\n\tboundary=in\n\n--in\nContent-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\n{quoted}\n--in\nContent-Type: text/html\n\n{html}\n--in--\n"
        f"--b 1\nContent-Type: text/csv; charset=utf-16-le\nContent-Disposition: attachment\nContent-Transfer-Encoding: base64\n\n{attached}\n"
        f"--b 1\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\n{base64.b64encode(passage.encode()).decode()}\n--b 1--\n"
    ).replace("\n", "\r\n")
    texts = mail.readable_texts(message)
    wanted = " ".join(leakage.words(passage))
    assert len(texts) == 4
    assert [" ".join(leakage.words(t)) for t in texts[1:]] == [wanted] * 3
    assert " ".join(leakage.words(texts[0])) == wanted


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aZ:=-<>&?\r\n \t;\"/09é漢", max_size=300), st.sampled_from(["", "Subject: x\n\n", "Content-Type: multipart/mixed; boundary=a\n\n--a\n", "Content-Transfer-Encoding: base64\n\n", "Content-Type: text/html\n\n"]))
def test_broken_messages_never_raise(text, head):
    assert all(isinstance(t, str) for t in mail.readable_texts(head + text))


def test_no_text():
    assert mail.readable_texts(None) == [] and mail.readable_texts("") == []


# Problem 8


def split(text, limit=128, overlap=16):
    return chunking.pieces(text, limit, 40, overlap, 24, 8, 12, tokens.VOCABULARY)


def whole(pieces):
    out = ""
    for p in pieces:
        out = out[: p[3]] + p[8]
    return out


ODD = ["a" * 3000, "漢字仮名" * 400, "😀" * 600, "\n" * 3000, " " * 3000, "." * 50_000, "abc. Def! " * 500, "> > quoted\r\n" * 300, "é́" * 900, "AB> x\n\n" * 400]


@pytest.mark.parametrize("text", ODD)
def test_pieces_of_odd_texts(text):
    found = split(text)
    assert not found or whole(found) == text
    assert all(len(tokens.encode(p[8], tokens.VOCABULARY)) == p[5] <= 128 for p in found)
    assert all(16 <= p[6] <= 19 for p in found[1:]) and [p[0] for p in found] == list(range(len(found)))


def test_token_counts_are_exact():
    r = random.Random(10)
    text = "".join(r.choice(["word", " ", "  \n", "don't", "12", "é", "漢", "...", "\t", " Aa"]) for _ in range(3000))
    whole_text = chunking.Pieces(text, tokens.VOCABULARY)
    for _ in range(200):
        a, b = sorted(r.sample(range(len(whole_text.ids)), 2))
        part = whole_text.data[whole_text.offsets[a] : whole_text.offsets[b]].decode("utf-8", "replace")
        assert whole_text.tokens(a, b) == len(tokens.encode(part, tokens.VOCABULARY))


def test_cuts_lie_at_boundaries_where_there_are_any():
    text = "\n\n".join(" ".join(f"Sentence {i} of part {j} says little." for i in range(6)) for j in range(60))
    assert {p[7] for p in split(text)} <= {"paragraph", "sentence", "line", "end"}


def test_an_edit_alters_only_neighbouring_pieces():
    r = random.Random(8)
    lines = [" ".join(r.choice(["lamp", "stone", "river", "cloud", "seven", "door"]) for _ in range(9)) + "." for _ in range(400)]
    before = {p[8] for p in split("\n".join(lines))}
    lines[200] = "A new line stands here now."
    after = [p[8] for p in split("\n".join(lines))]
    assert sum(p not in before for p in after) <= 6


def test_split_oversized_rows(spark):
    df = spark.createDataFrame([(1, "word " * 400), (2, "short"), (3, None), (4, ""), (1, "word " * 400), (None, "x. " * 500)], "d bigint, t string").withColumns({"ident": F.lit(1), "text": F.lit("no")})
    out = chunking.split_oversized(df, "d", "t", 128, 16)
    assert {r["d"] for r in out.collect()} == {1, None} and out.agg(F.max("n_tokens")).first()[0] <= 128
    assert chunking.split_oversized(df.limit(0), "d", "t", 128, 16).count() == 0
    with pytest.raises(ValueError):
        chunking.split_oversized(df, "d", "t", 30, 16)
