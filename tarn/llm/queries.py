"""Queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm import tokens
from tarn.llm.chunking import split_oversized
from tarn.llm.cooccurrence import item_pairs
from tarn.llm.leakage import leaked_items
from tarn.llm.mail import readable_texts
from tarn.llm.packing import containers
from tarn.llm.splits import related_splits, torn_groups
from tarn.llm.subsequences import frequent_subsequences
from tarn.llm.topn import top_n
from tarn.sources.handlog import hand_tables, is_step
from tarn.sources.tables import table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def step_sequences(spark: SparkSession, d: str) -> DataFrame:
    """(table_idx, player_idx, items): the steps of a player in a hand, as street * 6 + action, in order.

    Copies go before the shuffle, and sequences too short for a pattern before the join.
    """
    steps = table(spark, d, "actions").filter(is_step()).select(
        "hand_idx", "player_idx", (F.col("action_no").cast("int") * 32 + F.col("street") * 6 + F.col("action")).alias("step")
    )
    ordered = (
        steps.groupBy("hand_idx", "player_idx").agg(F.array_sort(F.collect_set("step")).alias("s")).filter(F.size("s") >= 3)
    )
    code = F.transform("s", lambda x: F.pmod(x, F.lit(32)).cast("tinyint"))
    return ordered.join(hand_tables(table(spark, d, "hands")), "hand_idx").select("table_idx", "player_idx", code.alias("items"))


def p1_patterns(spark: SparkSession, d: str) -> DataFrame:
    found = frequent_subsequences(step_sequences(spark, d), "table_idx", "player_idx", "items", 12)
    written = F.transform("pattern", lambda x: F.concat(F.floor(x / 6).cast("string"), F.lit("."), (x % 6).cast("string")))
    return found.select("table_idx", F.array_join(written, ">").alias("pattern"), "support")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_patterns(spark, d).select("table_idx", "pattern")


def persons(spark: SparkSession, d: str) -> DataFrame:
    """(player_idx, person, house): players whose ids agree in letters and digits are one person."""
    known = (
        table(spark, d, "players")
        .filter("player_idx is not null")
        .groupBy("player_idx")
        .agg(F.max("player_id").alias("id"), F.coalesce(F.max(F.col("client_family") == "house"), F.lit(False)).alias("house"))
    )
    key = F.lower(F.regexp_replace("id", r"[^\p{L}\p{N}]", ""))
    person = F.when(key != "", key).otherwise(F.concat(F.lit("#"), "player_idx"))
    named = known.select("player_idx", person.alias("person"), "house")
    houses = named.filter("house").select("person").distinct().withColumn("closed", F.lit(True))
    return named.join(houses, "person", "left").select("player_idx", "person", F.coalesce("closed", F.lit(False)).alias("house"))


def table_members(spark: SparkSession, d: str) -> DataFrame:
    """(table_idx, group_id, bin, split) of every table."""
    at = table(spark, d, "seats").filter("hand_idx is not null and player_idx is not null").select("hand_idx", "player_idx")
    tables = hand_tables(table(spark, d, "hands"))
    met = at.join(tables, "hand_idx").select("table_idx", "player_idx").distinct()
    links = (
        met.join(persons(spark, d), "player_idx", "left")
        .filter("house is null or not house")
        .select("table_idx", F.coalesce("person", F.concat(F.lit("#"), "player_idx")).alias("person"))
    )
    listed = table(spark, d, "folds_tables_5").select("table_idx")
    named = table(spark, d, "poker_tables").select("table_idx")
    return related_splits(listed.unionByName(named).unionByName(tables.select("table_idx").distinct()), "table_idx", links, "person", SHARES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return torn_groups(table_members(spark, d).select("table_idx", "group_id"), "table_idx", table(spark, d, "folds_tables_5"), "fold")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """The new split of every table listed in folds_tables_5."""
    listed = table(spark, d, "folds_tables_5").filter("table_idx is not null")
    return table_members(spark, d).join(listed, "table_idx", "left_semi").select("table_idx", "group_id", "split")


def p2_balance(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p2_splits, counted over all tables: no group in two splits or two bins, no bin in two splits, and no
    split off its share by more than the largest group."""
    m = table_members(spark, d)
    groups = m.groupBy("group_id").agg(F.count(F.lit(1)).alias("w"), F.count_distinct("split").alias("s"), F.count_distinct("bin").alias("b"))
    whole = groups.agg(
        F.sum("w").alias("tables"), F.count(F.lit(1)).alias("groups"), F.max("w").alias("largest"),
        F.count_if((F.col("s") > 1) | (F.col("b") > 1)).alias("torn"),
    )
    bins = m.groupBy("bin").agg(F.count_distinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("torn_bins"))
    share = F.coalesce(*(F.when(F.col("split") == k, F.lit(v)) for k, v in SHARES.items()))
    per_split = m.groupBy("split").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(whole))  # one row
    off = per_split.agg(F.count_if(F.abs(F.col("n") - share * F.col("tables")) > F.greatest("largest", F.ceil(F.col("tables") / 100))).alias("off_share"))
    return whole.crossJoin(F.broadcast(bins)).crossJoin(F.broadcast(off))  # one row each


def p3_pairs(spark: SparkSession, d: str, min_pairs: int = 1) -> DataFrame:
    """Every two players of a table with their shared hands and the ratio to chance."""
    seats = table(spark, d, "seats").filter("hand_idx is not null and player_idx is not null")
    baskets = seats.groupBy("hand_idx").agg(F.collect_set("player_idx").alias("items")).join(hand_tables(table(spark, d, "hands")), "hand_idx")
    return item_pairs(baskets, "table_idx", "items", min_pairs).withColumnsRenamed({"item_a": "player_a", "item_b": "player_b"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d, 12).filter("n_ab * n >= 2 * n_a * n_b").select("table_idx", "player_a", "player_b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    ranked = (
        table(spark, d, "evidence")
        .filter("pair_id is not null and evidence_rank >= 1 and hand_idx is not null")
        .groupBy("pair_id", "hand_idx")
        .agg(F.min("evidence_rank").alias("evidence_rank"))
    )
    return top_n(ranked, ["pair_id"], [F.col("evidence_rank")], ["hand_idx"], 5).select("pair_id", "place", "hand_idx")


def document_sizes(documents: DataFrame, path: str = tokens.VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, copies): tokens of the whole text, and a fingerprint that deliveries of one message share.

    The fingerprint is of the message without headers and white space, null if nothing is left; a null text has 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, prints = [], []
            for text in batch["text"].to_pylist():
                text = text or ""
                counts.append(len(tokens.encode(text, path)))
                head = re.search(r"\r?\n\r?\n", text) if re.match(r"[!-9;-~]+:", text) else None
                body = "".join(text[head.end() if head else 0 :].split())
                prints.append(xxhash.xxh3_128_hexdigest(body.encode("utf-8", "replace")) if body else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["source"], pa.array(counts, pa.int64()), pa.array(prints, pa.string())], ["doc_id", "source", "n_tokens", "copies"]
            )

    return documents.select("doc_id", "text", "source").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, copies string")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, of 4,096 tokens."""
    sizes = document_sizes(table(spark, d, "documents"))
    return containers(sizes, "doc_id", "n_tokens", "source", "copies", 4_096).withColumnsRenamed({"start": "start_token", "length": "n_tokens"})


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of up to 1,024 tokens, each repeating 64 of the one before."""
    return split_oversized(table(spark, d, "documents"), "doc_id", "text", 1_024, 64)


def p6_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p6_containers, counted over all documents: every token placed once, no container overfull, no copies of
    a message in one container, and no document divided that fits a container."""
    sizes = document_sizes(table(spark, d, "documents"))
    placed = p6_containers(spark, d)
    own = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    whole = sizes.join(own, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if((F.coalesce("placed", F.lit(-1)) != F.col("n_tokens")) | (F.col("end") != F.col("n_tokens"))).alias("misplaced"),
        F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= 4_096)).alias("divided"),
    )
    full = placed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > 4_096).alias("overfull"))
    held = placed.select("doc_id", "container").distinct().join(sizes.filter("copies is not null").select("doc_id", "copies"), "doc_id")
    pairs = held.groupBy("container", "copies").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("copies_together"))
    return whole.crossJoin(F.broadcast(full)).crossJoin(F.broadcast(pairs))  # one row each


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p8_pieces, counted over all pieces: numbered from 0, within the limit, each taking up where the one
    before ended less what it repeats, all together the whole text, and none for a text of up to 1,024 bytes."""
    pieces = p8_pieces(spark, d)
    w = Window.partitionBy("doc_id").orderBy("piece_no")
    seen = pieces.select("doc_id", "piece_no", "start_char", "end_char", "start_token", "end_token", "n_tokens", "repeated_tokens", "piece", F.lag("end_token").over(w).alias("last"), F.lag("end_char").over(w).alias("last_char"))
    gap = F.when(F.col("piece_no") == 0, (F.col("start_token") != 0) | (F.col("start_char") != 0)).otherwise(
        F.coalesce((F.col("start_token") != F.col("last") - F.col("repeated_tokens")) | (F.col("start_char") > F.col("last_char")), F.lit(True))
    )
    docs = seen.groupBy("doc_id").agg(
        F.count_if(F.col("n_tokens") > 1_024).alias("over"), F.count_if(gap | (F.char_length("piece") != F.col("end_char") - F.col("start_char"))).alias("gaps"),
        F.count_if((F.col("piece_no") > 0) & ~F.col("repeated_tokens").between(64, 67)).alias("overlap"), F.max("end_char").alias("end"),
    )
    texts = table(spark, d, "documents").select("doc_id", "n_chars", F.octet_length("text").alias("bytes"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("over", "over_limit"), ("gaps", "gaps"), ("overlap", "wrong_overlap"))]
    return texts.join(docs, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"), *sums, F.count_if(F.col("end") != F.col("n_chars")).alias("incomplete"),
        F.count_if(F.col("end").isNotNull() & (F.col("bytes") <= 1_024)).alias("needless"),
    )


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Items of which 12 consecutive words, of which up to two may differ, stand in a part of a message."""
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", readable_texts)


def p7_joined(spark: SparkSession, d: str) -> DataFrame:
    """p7_overlaps() by the join that larger sets of items take."""
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", readable_texts, block_words=0)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_overlaps(spark, d).filter("substitutions = 0").select("doc_id", "item_id")


QUERIES = {"p1_found": p1_found, "p1_patterns": p1_patterns, "p2_found": p2_found, "p2_splits": p2_splits, "p2_balance": p2_balance, "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p6_containers": p6_containers, "p6_rules": p6_rules, "p7_found": p7_found, "p7_overlaps": p7_overlaps, "p7_joined": p7_joined, "p8_pieces": p8_pieces, "p8_rules": p8_rules}

_TABLES = "SELECT hand_idx, max(table_idx) AS table_idx FROM hands WHERE table_idx IS NOT NULL GROUP BY 1"
_PATTERNS = f"""
WITH RECURSIVE tabled AS ({_TABLES}),
steps AS (SELECT DISTINCT table_idx, hand_idx, player_idx, action_no, street || '.' || action AS s FROM actions JOIN tabled USING (hand_idx)
          WHERE player_idx IS NOT NULL AND action_no IS NOT NULL AND street BETWEEN 0 AND 3 AND action BETWEEN 0 AND 5),
grown AS (SELECT table_idx, hand_idx, player_idx, action_no AS at, s AS pattern, 1 AS len FROM steps
          UNION SELECT g.table_idx, g.hand_idx, g.player_idx, s.action_no, g.pattern || '>' || s.s, g.len + 1
          FROM grown g JOIN steps s ON g.hand_idx = s.hand_idx AND g.player_idx = s.player_idx AND s.action_no > g.at WHERE g.len < 5)
"""
_MET = f"""
tabled AS ({_TABLES}), met AS (SELECT DISTINCT hand_idx, table_idx, player_idx FROM seats JOIN tabled USING (hand_idx) WHERE player_idx IS NOT NULL)"""
_PAIRS = f"""
WITH {_MET},
n AS (SELECT table_idx, count(DISTINCT hand_idx) AS n FROM met GROUP BY 1),
single AS (SELECT table_idx, player_idx, count(*) AS m FROM met GROUP BY 1, 2),
pairs AS (SELECT a.table_idx, a.player_idx AS player_a, b.player_idx AS player_b, count(*) AS n_ab
          FROM met a JOIN met b ON a.hand_idx = b.hand_idx AND a.player_idx < b.player_idx GROUP BY 1, 2, 3),
scored AS (SELECT p.*, x.m AS n_a, y.m AS n_b, n.n FROM pairs p JOIN n USING (table_idx)
           JOIN single x ON x.table_idx = p.table_idx AND x.player_idx = player_a JOIN single y ON y.table_idx = p.table_idx AND y.player_idx = player_b)
"""


def _conviction(x: str, y: str) -> str:
    return f"(1 - n_{y}::DOUBLE / n) / nullif(1 - n_ab::DOUBLE / n_{x}, 0)"


_GROUPED = rf"""
WITH RECURSIVE {_MET},
known AS (SELECT player_idx, max(player_id) AS id, coalesce(bool_or(client_family = 'house'), false) AS house FROM players GROUP BY 1),
keyed AS (SELECT player_idx, house, coalesce(nullif(lower(regexp_replace(id, '[^\p{{L}}\p{{N}}]', '', 'g')), ''), '#' || player_idx) AS person FROM known),
closed AS (SELECT DISTINCT person FROM keyed WHERE house),
links AS (SELECT DISTINCT m.table_idx, coalesce(k.person, '#' || m.player_idx) AS person FROM met m LEFT JOIN keyed k USING (player_idx)
          WHERE k.person IS NULL OR k.person NOT IN (SELECT person FROM closed)),
edges AS (SELECT DISTINCT a.table_idx AS u, b.table_idx AS v FROM links a JOIN links b USING (person)),
every AS (SELECT table_idx AS u FROM tabled UNION SELECT table_idx FROM poker_tables UNION SELECT table_idx FROM folds_tables_5),
reach AS (SELECT u, u AS v FROM every WHERE u IS NOT NULL UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
grouped AS (SELECT u AS table_idx, min(v) AS group_id FROM reach GROUP BY 1)
"""

ORACLES = {
    "p1_found": _PATTERNS + "SELECT table_idx, pattern FROM grown WHERE len >= 3 GROUP BY 1, 2 HAVING count(DISTINCT player_idx) >= 12",
    "p1_patterns": _PATTERNS
    + "SELECT table_idx, pattern, count(DISTINCT player_idx) AS support FROM grown WHERE len >= 3 GROUP BY 1, 2 HAVING count(DISTINCT player_idx) >= 12",
    "p2_found": _GROUPED
    + """, torn AS (SELECT group_id FROM grouped JOIN folds_tables_5 USING (table_idx) GROUP BY 1 HAVING count(DISTINCT fold) > 1)
SELECT table_idx, group_id FROM grouped WHERE group_id IN (SELECT group_id FROM torn)""",
    "p2_balance": _GROUPED
    + """, g AS (SELECT group_id, count(*) AS w FROM grouped GROUP BY 1)
SELECT CAST(sum(w) AS BIGINT) AS tables, count(*) AS groups, max(w) AS largest, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS torn_bins, CAST(0 AS BIGINT) AS off_share FROM g""",
    "p6_rules": "SELECT count(*) AS documents, 0::BIGINT AS misplaced, 0::BIGINT AS divided, 0::BIGINT AS overfull, 0::BIGINT AS copies_together FROM documents",
    "p8_rules": """
SELECT count(*) AS documents, 0::BIGINT AS over_limit, 0::BIGINT AS gaps, 0::BIGINT AS wrong_overlap, 0::BIGINT AS incomplete, 0::BIGINT AS needless
FROM documents""",
    "p3_found": _PAIRS + "SELECT table_idx, player_a, player_b FROM scored WHERE n_ab >= 12 AND n_ab * n >= 2 * n_a * n_b",
    "p3_pairs": _PAIRS
    + "SELECT table_idx, player_a, player_b, n_ab, n_a, n_b, n, n_ab::DOUBLE * n / (n_a::DOUBLE * n_b) AS lift, "
    + f"{_conviction('a', 'b')} AS conviction_ab, {_conviction('b', 'a')} AS conviction_ba FROM scored",
    "p4_found": """
WITH best AS (SELECT pair_id, hand_idx, min(evidence_rank) AS r FROM evidence WHERE evidence_rank >= 1 AND hand_idx IS NOT NULL GROUP BY 1, 2),
placed AS (SELECT pair_id, hand_idx, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY r, hand_idx) AS INTEGER) AS place FROM best)
SELECT pair_id, place, hand_idx FROM placed WHERE place <= 5""",
}
