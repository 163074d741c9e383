"""Scans, sinks, filters, joins, aggregates, windows, ranks, sets and scalar functions on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators import ordered, pairing, ranking, shaping
from tarn.queries.base import ACTIONS, HANDS, SEATS, actions, hands, seats
from tarn.sources import io
from tarn.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


R6 = lambda c: F.round(c, 6)


# Scans and sinks


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def scan_pruned(spark: SparkSession, d: str) -> DataFrame:
    return io.read_columns(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"]).filter("l_quantity >= 45")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (0, 1, 2) UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def scan_many(spark: SparkSession, d: str) -> DataFrame:
    """A folder, a glob and a list of folders."""
    path = io.write_parquet(table(spark, d, "nation"), io.scratch(spark, "nations"), partition_by=["n_regionkey"])
    read = lambda paths: io.read_columns(spark, paths, ["n_nationkey", "n_name"])
    listed = [f"{path}/n_regionkey={k}" for k in (1, 3)]
    return read(path).unionByName(read(f"{path}/n_regionkey=[0-2]")).unionByName(read(listed))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return io.read_csv(spark, io.write_csv(table(spark, d, "nation"), io.scratch(spark, "csv")), "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    return io.read_csv(spark, io.write_csv(table(spark, d, "nation"), io.scratch(spark, "csv")))


@query("SELECT r_regionkey, r_name FROM region")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.schema("r_regionkey int, r_name string").json(io.write_json(table(spark, d, "region"), io.scratch(spark, "json")))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def sql_over_files(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT n_regionkey, count(*) AS n FROM parquet.`{d}/nation.parquet` GROUP BY ALL")


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def sql_over_view(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY ALL", orders=table(spark, d, "orders"))


@query("SELECT n_regionkey, count(*) AS n, (SELECT count(*) FROM nation) AS whole FROM nation GROUP BY 1")
def cached_view(spark: SparkSession, d: str) -> DataFrame:
    """A named view, kept in memory while two queries read it."""
    name = f"nations_{uuid.uuid4().hex}"
    table(spark, d, "nation").createOrReplaceTempView(name)
    spark.catalog.cacheTable(name)
    try:
        counts = spark.sql(f"SELECT n_regionkey, count(*) AS n FROM {name} GROUP BY 1").collect()  # five regions
        whole = spark.sql(f"SELECT count(*) AS n FROM {name}").first()["n"]
    finally:
        spark.catalog.uncacheTable(name)
        spark.catalog.dropTempView(name)
    return spark.createDataFrame([(r["n_regionkey"], r["n"], whole) for r in counts], "n_regionkey int, n bigint, whole bigint")


@query("SELECT o_orderstatus, o_orderkey, o_custkey FROM orders")
def partitioned_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Parts written twice replace themselves."""
    path, rows = io.scratch(spark, "parts"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    io.write_parquet(rows, path, partition_by=["o_orderstatus"])
    io.write_parquet(rows.filter("o_orderstatus = 'F'"), path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path).withColumn("o_orderstatus", F.col("o_orderstatus").cast("string"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 100 AND 400")
def clustered_write(spark: SparkSession, d: str) -> DataFrame:
    path = io.write_clustered(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), io.scratch(spark, "clustered"), ["l_orderkey", "l_linenumber"])
    return spark.read.parquet(path).filter(F.col("l_orderkey").between(100, 400))


@query("SELECT p_partkey, p_size FROM part")
def write_once(spark: SparkSession, d: str) -> DataFrame:
    path, source = io.scratch(spark, "once"), f"{d}/part.parquet"
    rows = table(spark, d, "part").select("p_partkey", "p_size")
    assert io.write_once(rows, path, [source]) and not io.write_once(rows, path, [source])
    return spark.read.parquet(path)


@query("SELECT * FROM (VALUES ('high', 0.9), ('low', 0.1)) t(name, threshold)")
def metadata_file(spark: SparkSession, d: str) -> DataFrame:
    read = io.read_metadata(spark, io.write_metadata(spark, io.scratch(spark, "meta"), {"high": 0.9, "low": 0.1}))
    return spark.createDataFrame(sorted(read.items()), "name string, threshold double")


@query("SELECT column_name AS name FROM (DESCRIBE SELECT * FROM hands)")
def schema_only(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in io.schema_of(spark, f"{d}/hands.parquet").names], "name string")


# Projection, filters, shaping


@query("SELECT o_orderkey, CAST(o_orderkey % 100 AS SMALLINT) AS small, round(o_totalprice / 1000, 6) AS thousands FROM orders WHERE o_totalprice > 1000 AND (o_orderstatus = 'F' OR o_orderpriority LIKE '1%')")
def project_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").filter((F.col("o_totalprice") > 1000) & ((F.col("o_orderstatus") == "F") | F.col("o_orderpriority").startswith("1")))
    return rows.select("o_orderkey", (F.col("o_orderkey") % 100).cast("smallint").alias("small"), R6(F.col("o_totalprice") / 1000).alias("thousands"))


@query("SELECT hand_idx, action_no, amount FROM actions WHERE amount BETWEEN 100 AND 300 AND action IN (3, 4)")
def between_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "actions").filter(F.col("amount").between(100, 300) & F.col("action").isin(3, 4)).select("hand_idx", "action_no", "amount")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (ts IS NULL) AS BIGINT) AS no_ts, CAST(count(*) FILTER (isnan(ts)) AS BIGINT) AS nan_ts, CAST(count(*) FILTER (table_idx IS NULL) AS BIGINT) AS no_table FROM hands")
def null_tests(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return table(spark, d, "hands").agg(
        F.count(F.lit(1)).alias("n"), n(F.col("ts").isNull()).alias("no_ts"), n(F.isnan("ts")).alias("nan_ts"), n(F.col("table_idx").isNull()).alias("no_table")
    )


@query(f"WITH {ACTIONS} SELECT k, count(*) AS n FROM (SELECT CASE WHEN action IN (3, 4) OR (action = 5 AND amount > to_call) THEN 'aggressive' WHEN action = 2 OR action = 5 THEN 'call' WHEN action = 1 THEN 'check' ELSE 'fold' END AS k FROM a) GROUP BY 1")
def action_classes(spark: SparkSession, d: str) -> DataFrame:
    """All-in counts as aggressive if it exceeds what is to call."""
    a = F.col("action")
    k = F.when(a.isin(3, 4) | ((a == 5) & (F.col("amount") > F.col("to_call"))), "aggressive").when(a.isin(2, 5), "call").when(a == 1, "check").otherwise("fold")
    return actions(spark, d).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT hand_idx, hand_id, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY hand_idx ORDER BY loaded_at DESC NULLS LAST, hand_id NULLS FIRST) AS r FROM hands) WHERE r = 1")
def latest_load(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hands").select("hand_idx", "hand_id", "loaded_at")
    return shaping.first_per_key(rows, ["hand_idx"], [F.col("loaded_at").desc_nulls_last(), F.col("hand_id").asc_nulls_first()])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def global_top(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


_U = "CAST(('0x' || substr(md5({k} || '|' || ''), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query(f"SELECT o_orderkey FROM orders WHERE {_U.format(k='o_orderkey')} < CASE o_orderstatus WHEN 'F' THEN 0.1 ELSE 0.3 END")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rate = F.when(F.col("o_orderstatus") == "F", 0.1).otherwise(0.3)
    return shaping.sample_rate(table(spark, d, "orders"), rate, "o_orderkey").select("o_orderkey")


@query(f"SELECT c_custkey FROM customer ORDER BY {_U.format(k='c_custkey')}, c_custkey LIMIT 50")
def sample_of_50(spark: SparkSession, d: str) -> DataFrame:
    return shaping.sample_n(table(spark, d, "customer").select("c_custkey"), 50, "c_custkey")


@query(f"SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_U.format(k='c_custkey')}, c_custkey) AS r FROM customer) WHERE r <= 3")
def sample_per_nation(spark: SparkSession, d: str) -> DataFrame:
    return shaping.sample_n_per_group(table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", 3, "c_custkey")


@query(f"SELECT p_partkey, round({_U.format(k='p_partkey')}, 6) AS u FROM part")
def uniform_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", R6(shaping.uniform("p_partkey")).alias("u"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS BIGINT) AS row FROM orders")
def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    return ordered.row_index(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"]).select("o_orderkey", F.col("row").cast("bigint").alias("row"))


@query("SELECT player_id, CAST(row_number() OVER (ORDER BY player_id) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT player_id FROM players WHERE player_id IS NOT NULL)")
def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary encoding of different keys."""
    keys = table(spark, d, "players").select("player_id").filter("player_id is not null").distinct()
    return ordered.row_index(keys, ["player_id"], "code").select("player_id", F.col("code").cast("bigint").alias("code"))


@query("SELECT hand_idx, CAST(pos AS INTEGER) AS pos, card FROM (SELECT hand_idx, generate_subscripts(board, 1) - 1 AS pos, unnest(board) AS card FROM hands WHERE board IS NOT NULL AND len(board) > 0)  WHERE card IS NOT NULL")
def exploded_board(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hands").select("hand_idx", F.posexplode("board").alias("pos", "card")).filter("card is not null")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem")
def drop_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    return shaping.drop_matching(table(spark, d, "lineitem"), "(price|quantity|discount|tax|date)$")


@query("SELECT o_orderkey, o_custkey FROM orders")
def drop_constants(spark: SparkSession, d: str) -> DataFrame:
    return shaping.drop_constant(table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(7).alias("seven")))


# Joins


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def inner_join(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_join_default(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS BIGINT) AS place, o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def ordered_left_join(spark: SparkSession, d: str) -> DataFrame:
    """A left join that keeps the left side's order, as a carried place."""
    left = ordered.row_index(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], "place")
    return left.join(table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left").select("place", "o_orderkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT DISTINCT hand_idx FROM actions WHERE hand_idx NOT IN (SELECT hand_idx FROM hands WHERE hand_idx IS NOT NULL)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Hands that the actions name and the log lost."""
    return pairing.uncovered(table(spark, d, "actions").filter("hand_idx is not null"), table(spark, d, "hands"), ["hand_idx"])


@query("SELECT p.table_idx, CAST(count(h.hand_idx) AS BIGINT) AS n FROM hands h RIGHT JOIN poker_tables p ON h.table_idx = p.table_idx GROUP BY 1")
def right_join(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "hands").select("hand_idx", "table_idx").join(table(spark, d, "poker_tables"), "table_idx", "right")
    return joined.groupBy("table_idx").agg(F.count("hand_idx").alias("n"))


@query(f"WITH {ACTIONS} SELECT st.street, ac.action, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(4) st(street) CROSS JOIN range(6) ac(action) LEFT JOIN (SELECT street, action, count(*) AS n FROM a GROUP BY 1, 2) c ON c.street = st.street AND c.action = ac.action")
def context_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every street with every action, also those that never came: a cross join of two fixed lists."""
    grid = spark.range(4).toDF("street").crossJoin(spark.range(6).toDF("action"))
    n = actions(spark, d).groupBy("street", "action").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(F.broadcast(n), ["street", "action"], "left").select("street", "action", F.coalesce("n", F.lit(0)).alias("n"))  # 24 rows at most


@query("SELECT l.pair_id, coalesce(l.label, 0) AS label FROM labels l JOIN (SELECT DISTINCT least(p1, p2) AS x, greatest(p1, p2) AS y FROM labels WHERE p1 IS NOT NULL AND p2 IS NOT NULL) k ON least(l.p2, l.p1) = k.x AND greatest(l.p1, l.p2) = k.y")
def expression_keys(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels")
    k = l.filter("p1 is not null and p2 is not null").select(F.least("p1", "p2").alias("x"), F.greatest("p1", "p2").alias("y")).distinct()
    return l.join(k, (F.least("p2", "p1") == k.x) & (F.greatest("p1", "p2") == k.y)).select("pair_id", F.coalesce("label", F.lit(0)).alias("label"))


_PC = "SELECT a.l_suppkey AS x, b.l_suppkey AS y, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey {op} b.l_suppkey GROUP BY 1, 2"


@query(_PC.format(op="<"))
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_counts(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query(_PC.format(op="<>"))
def directed_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_counts(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", directed=True)


_LP = "lp AS (SELECT DISTINCT p1, p2 FROM labels WHERE p1 IS NOT NULL AND p2 IS NOT NULL)"


@query(f"WITH {SEATS}, {_LP} SELECT p1, p2, x.hand_idx FROM lp JOIN s x ON x.player_idx = p1 JOIN s y ON y.player_idx = p2 AND x.hand_idx = y.hand_idx")
def double_membership(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "labels").select("p1", "p2").filter("p1 is not null and p2 is not null").distinct()
    return pairing.both_present(pairs, "p1", "p2", seats(spark, d), "hand_idx", "player_idx").select("p1", "p2", "hand_idx")


@query(f"WITH {_LP} SELECT p1, p2, false AS swapped FROM lp UNION ALL SELECT p2, p1, true FROM lp")
def orientation_union(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "labels").select("p1", "p2").filter("p1 is not null and p2 is not null").distinct()
    return pairing.both_orientations(pairs, "p1", "p2")


_FACING = f"""WITH {ACTIONS}, {_LP}, f AS (SELECT *, last_value(CASE WHEN action IN (3, 4) OR (action = 5 AND amount > to_call) THEN player_idx END IGNORE NULLS)
OVER (PARTITION BY hand_idx, street ORDER BY action_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS aggressor FROM a)"""


def facing(spark: SparkSession, d: str) -> DataFrame:
    """Steps with the last aggressor of the street before them."""
    raised = F.col("action").isin(3, 4) | ((F.col("action") == 5) & (F.col("amount") > F.col("to_call")))
    return actions(spark, d).withColumn("aggressor", ordered.last_event(F.when(raised, F.col("player_idx")), ["hand_idx", "street"], ["action_no"]))


@query(_FACING + " SELECT hand_idx, action_no, aggressor FROM f")
def last_aggressor(spark: SparkSession, d: str) -> DataFrame:
    return facing(spark, d).select("hand_idx", "action_no", "aggressor")


@query(_FACING + " SELECT p1, p2, count(*) AS n, CAST(sum((action = 0)::INT) AS BIGINT) AS folds FROM f JOIN lp ON player_idx = p1 AND aggressor = p2 WHERE to_call > 0 GROUP BY 1, 2")
def facing_partner(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "labels").select("p1", "p2").filter("p1 is not null and p2 is not null").distinct()
    joined = facing(spark, d).join(pairs, (F.col("player_idx") == F.col("p1")) & (F.col("aggressor") == F.col("p2"))).filter("to_call > 0")
    return joined.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("action") == 0).cast("bigint")).alias("folds"))


_RATE = "round(sum((action = 0)::INT)::DOUBLE / count(*), 6)"


@query(f"""WITH {ACTIONS}, fine AS (SELECT player_idx, street, {_RATE} AS r, count(*) AS n FROM a GROUP BY 1, 2), coarse AS (SELECT street, {_RATE} AS r FROM a GROUP BY 1),
k AS (SELECT DISTINCT player_idx, street FROM a) SELECT k.player_idx, k.street, CASE WHEN fine.n >= 150 THEN fine.r ELSE coarse.r END AS r
FROM k LEFT JOIN fine USING (player_idx, street) LEFT JOIN coarse ON coarse.street = k.street""")
def back_off_rates(spark: SparkSession, d: str) -> DataFrame:
    """A player's fold rate on a street, or the street's if there are fewer than 150 steps."""
    a = actions(spark, d)
    r = R6(F.avg((F.col("action") == 0).cast("double"))).alias("r")
    fine = a.groupBy("player_idx", "street").agg(r, F.count(F.lit(1)).alias("n"))
    return pairing.back_off(fine.select("player_idx", "street"), fine, ["player_idx", "street"], a.groupBy("street").agg(r), ["street"], "r", "n", 150).select("player_idx", "street", "r")


_LINEUP = f"""WITH {HANDS}, {SEATS}, q AS (SELECT hand_idx, table_idx, row_number() OVER (PARTITION BY table_idx ORDER BY t NULLS FIRST, hand_idx) AS seq FROM h WHERE table_idx IS NOT NULL),
m AS (SELECT table_idx, seq, player_idx FROM s JOIN q USING (hand_idx))"""


def lineups(spark: SparkSession, d: str) -> DataFrame:
    """(table_idx, seq, player_idx): who sits at the table's hands, numbered by time."""
    w = Window.partitionBy("table_idx").orderBy(F.col("t").asc_nulls_first(), "hand_idx")
    q = hands(spark, d).filter("table_idx is not null").select("hand_idx", "table_idx", F.row_number().over(w).alias("seq"))
    return seats(spark, d).select("hand_idx", "player_idx").join(q, "hand_idx").select("table_idx", "seq", "player_idx")


@query(_LINEUP + """ SELECT n.table_idx, n.seq, n.player_idx, 'joined' AS change FROM m n LEFT JOIN m p ON p.table_idx = n.table_idx AND p.player_idx = n.player_idx AND p.seq = n.seq - 1 WHERE p.seq IS NULL
UNION ALL SELECT p.table_idx, p.seq + 1, p.player_idx, 'left' FROM m p LEFT JOIN m n ON p.table_idx = n.table_idx AND p.player_idx = n.player_idx AND p.seq = n.seq - 1
JOIN (SELECT table_idx, max(seq) AS e FROM m GROUP BY 1) e ON e.table_idx = p.table_idx WHERE n.seq IS NULL AND p.seq + 1 <= e""")
def lineup_diff(spark: SparkSession, d: str) -> DataFrame:
    return ordered.lineup_changes(lineups(spark, d), "table_idx", "seq", "player_idx")


@query(_LINEUP + """, j AS (SELECT n.* FROM m n LEFT JOIN m p ON p.table_idx = n.table_idx AND p.player_idx = n.player_idx AND p.seq = n.seq - 1 WHERE p.seq IS NULL)
SELECT x.player_idx AS x, y.player_idx AS y, count(*) AS n FROM j x JOIN j y ON x.table_idx = y.table_idx AND x.player_idx < y.player_idx AND abs(x.seq - y.seq) <= 2 GROUP BY 1, 2""")
def band_co_events(spark: SparkSession, d: str) -> DataFrame:
    """Players who join a table within two hands of each other."""
    j = ordered.lineup_changes(lineups(spark, d), "table_idx", "seq", "player_idx").filter("change = 'joined'")
    x, y = j.select("table_idx", F.col("seq").alias("at"), F.col("player_idx").alias("x")), j.select("table_idx", F.col("seq").alias("other"), F.col("player_idx").alias("y"))
    return pairing.band_join(x, y, ["table_idx"], "at", "other", 2).filter("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


# Aggregates


@query(f"WITH {SEATS} SELECT player_idx, count(*) AS n, CAST(sum(net_chips) AS BIGINT) AS net, round(avg(net_chips), 6) AS mean, min(net_chips) AS low, max(net_chips) AS high, count(DISTINCT seat_no) AS seats, coalesce(bool_or(folded), false) AS any_fold, coalesce(bool_and(folded), true) AS all_fold, CAST(count(*) FILTER (net_chips > 0) AS BIGINT) AS wins, arg_max(hand_idx, starting_stack * 4294967296 + hand_idx) AS richest FROM s GROUP BY 1")
def player_totals(spark: SparkSession, d: str) -> DataFrame:
    richest = F.max_by("hand_idx", F.col("starting_stack").cast("bigint") * 4294967296 + F.col("hand_idx"))
    return seats(spark, d).groupBy("player_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_chips").alias("net"), R6(F.avg("net_chips")).alias("mean"), F.min("net_chips").alias("low"), F.max("net_chips").alias("high"),
        F.count_distinct("seat_no").alias("seats"), F.coalesce(F.bool_or("folded"), F.lit(False)).alias("any_fold"), F.coalesce(F.bool_and("folded"), F.lit(True)).alias("all_fold"),
        F.count(F.when(F.col("net_chips") > 0, 1)).alias("wins"), richest.alias("richest"),
    )


@query("WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_custkey, round(avg(o_totalprice) FILTER (r <= 3), 4) AS top3, max(o_totalprice) FILTER (r = 2) AS second FROM r GROUP BY 1")
def top_k_stats(spark: SparkSession, d: str) -> DataFrame:
    top = ranking.top_k(table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    return top.groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 4).alias("top3"), F.max(F.when(F.col("place") == 2, F.col("o_totalprice"))).alias("second"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_tax), 6) AS var, median(l_quantity) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY 1")
def distribution_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        R6(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("weighted"), R6(F.stddev_samp("l_quantity")).alias("sd"), R6(F.var_samp("l_tax")).alias("var"),
        F.percentile("l_quantity", 0.5).alias("med"), F.round(F.percentile("l_extendedprice", 0.9), 4).alias("q90"), R6(F.corr("l_quantity", "l_extendedprice")).alias("corr"),
    )


@query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, first(o_orderpriority ORDER BY n DESC, o_orderpriority) AS mode FROM c GROUP BY 1")
def mode_value(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value, the smallest among equals: counts first, so that a hot group moves one row per value."""
    c = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), F.col("o_orderpriority"))).alias("mode"))


@query("SELECT CAST(floor(l_quantity / 10) AS INTEGER) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT pair_id, hand_idx, min(evidence_rank) AS r FROM evidence WHERE evidence_rank >= 1 AND hand_idx IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY r, hand_idx) AS i FROM b) SELECT pair_id, string_agg(hand_idx::VARCHAR, ',' ORDER BY i) AS hands FROM p WHERE i <= 5 GROUP BY 1")
def top_ids_list(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "evidence").filter("evidence_rank >= 1 and hand_idx is not null").groupBy("pair_id", "hand_idx").agg(F.min("evidence_rank").alias("r"))
    top = ranking.top_k(b, ["pair_id"], [F.col("r"), F.col("hand_idx")], 5)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "hand_idx"))), lambda x: x["hand_idx"].cast("string"))
    return top.groupBy("pair_id").agg(F.array_join(ids, ",").alias("hands"))


@query("SELECT o_custkey, max(n) FILTER (o_orderstatus = 'F') AS F_n, max(v) FILTER (o_orderstatus = 'F') AS F_v, max(n) FILTER (o_orderstatus = 'O') AS O_n, max(v) FILTER (o_orderstatus = 'O') AS O_v FROM (SELECT o_custkey, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2) GROUP BY 1")
def pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("v"))
    return shaping.pivot(long, ["o_custkey"], "o_orderstatus", ["F", "O"], {"n": F.col("n"), "v": F.col("v")})


@query("SELECT p_partkey, k AS measure, v AS value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR k IN (size, price))")
def unpivot_long(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return wide.unpivot("p_partkey", ["size", "price"], "measure", "value")


#: Overlapping windows over a table's clock.
WINDOWS = {"all": (0, None), "early": (0, 80), "late": (40, None)}


@query(f"WITH {HANDS}, w AS (SELECT * FROM (VALUES ('all', 0, NULL), ('early', 0, 80), ('late', 40, NULL)) v(\"window\", low, high)) SELECT table_idx, \"window\", count(*) AS n, CAST(sum(final_pot) AS BIGINT) AS pot FROM h JOIN w ON hand_seq >= low AND (high IS NULL OR hand_seq < high) WHERE table_idx IS NOT NULL GROUP BY 1, 2")
def overlapping_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = pairing.window_rows(hands(spark, d).filter("table_idx is not null"), "hand_seq", WINDOWS)
    return rows.groupBy("table_idx", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("final_pot").alias("pot"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, true AS orders_near, true AS parts_near FROM lineitem")
def approximate_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Exact numbers, and whether estimates with a relative deviation of 2 % lie within three of these."""
    exact = {"orders": "l_orderkey", "parts": "l_partkey"}
    both = table(spark, d, "lineitem").agg(*(F.approx_count_distinct(c, 0.02).alias(f"{n}_near") for n, c in exact.items()), *(F.count_distinct(c).alias(n) for n, c in exact.items()))
    return both.select(*exact, *((F.abs(F.col(f"{n}_near") - F.col(n)) <= 0.06 * F.col(n)).alias(f"{n}_near") for n in exact))


@query("WITH r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS x, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2 AS y FROM customer) SELECT round(corr(x, y), 6) AS spearman FROM r")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    ranks = ordered.global_average_rank(ordered.global_average_rank(c.select("c_acctbal", "c_nationkey"), "c_acctbal", "x"), "c_nationkey", "y")
    return ranks.agg(R6(F.corr("x", "y")).alias("spearman"))


# Windows


@query("SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER w, 6) AS share, count(*) OVER w AS n, round(stddev_samp(o_totalprice) OVER w, 4) AS sd FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def partition_aggregates(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey", R6(F.col("o_totalprice") / F.sum("o_totalprice").over(w)).alias("share"), F.count(F.lit(1)).over(w).alias("n"), F.round(F.stddev_samp("o_totalprice").over(w), 4).alias("sd")
    )


@query(f"WITH {HANDS} SELECT hand_idx, table_idx, CAST(row_number() OVER (PARTITION BY table_idx ORDER BY t NULLS LAST, hand_idx) - 1 AS INTEGER) AS clock FROM h WHERE table_idx IS NOT NULL")
def logical_clock(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("table_idx").orderBy(F.col("t").asc_nulls_last(), "hand_idx")
    return hands(spark, d).filter("table_idx is not null").select("hand_idx", "table_idx", (F.row_number().over(w) - 1).alias("clock"))


@query("SELECT o_orderkey, rank() OVER w - 1 AS better, dense_rank() OVER w AS dense, rank() OVER w + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2 AS average, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey) AS INTEGER) AS ordinal FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority DESC)")
def rank_kinds(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderpriority").desc())
    return table(spark, d, "orders").select(
        "o_orderkey", (F.rank().over(w) - 1).alias("better"), F.dense_rank().over(w).alias("dense"), ranking.average_rank(F.col("o_orderpriority"), "o_custkey", descending=True).alias("average"),
        F.row_number().over(w.orderBy(F.col("o_orderpriority").desc(), "o_orderkey")).alias("ordinal"),
    )


@query(f"WITH {ACTIONS} SELECT hand_idx, action_no, CAST(coalesce(sum((action IN (3, 4))::INT) OVER w, 0) AS BIGINT) AS raises_before, CAST(coalesce(sum((action = 2)::INT) OVER w, 0) AS BIGINT) AS calls_before FROM a WINDOW w AS (PARTITION BY hand_idx, street ORDER BY action_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def exclusive_prefix(spark: SparkSession, d: str) -> DataFrame:
    before = lambda c: ordered.prefix_sum(c.cast("bigint"), ["hand_idx", "street"], ["action_no"])
    return actions(spark, d).select("hand_idx", "action_no", before(F.col("action").isin(3, 4)).alias("raises_before"), before(F.col("action") == 2).alias("calls_before"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM events")
def as_of_last_purchase(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, d, "events").select("event_id", ordered.last_event(bought, ["user_id"], ["ts", "event_id"]).alias("last_purchase"), R6(F.col("value") - F.lag("value").over(w)).alias("step"))


@query("""WITH e AS (SELECT *, epoch_us(ts) / 1000000 AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600 THEN 1 ELSE 0 END AS new FROM e),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n, round(sum(value), 4) AS value, CAST(coalesce(sum(count(*)) OVER (PARTITION BY user_id ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before, lag(count(*)) OVER (PARTITION BY user_id ORDER BY session) AS n_last FROM s GROUP BY 1, 2""")
def sessionize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    s = ordered.sessions(e, ["user_id"], "t", ["t", "event_id"], 3600)
    per = s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    before = ordered.prefix_sum(F.col("n"), ["user_id"], ["session"])
    return per.withColumns({"n_before": before, "n_last": F.lag("n").over(Window.partitionBy("user_id").orderBy("session"))})


@query("""WITH g AS (SELECT *, CASE WHEN l_quantity < lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) THEN 1 ELSE 0 END AS d FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2))
SELECT l_orderkey, l_linenumber, CAST(sum(d) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g""")
def inversion_segments(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return ordered.inversion_segments(lines, ["l_orderkey"], ["l_linenumber"], "l_quantity").select("l_orderkey", "l_linenumber", "segment")


@query("SELECT o_orderkey, round((row_number() OVER w - 0.5) / count(*) OVER (PARTITION BY o_custkey), 6) AS position, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS cumulative, CAST(min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS BIGINT) AS first_f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def relative_position(spark: SparkSession, d: str) -> DataFrame:
    w, whole = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey", R6((F.row_number().over(w) - 0.5) / F.count(F.lit(1)).over(whole)).alias("position"),
        R6(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("o_totalprice").over(whole)).alias("cumulative"),
        F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).over(whole).alias("first_f"),
    )


# Ranks and sets


@query("SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS place FROM orders) WHERE place <= 2")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderdate"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "place")


@query("SELECT l_orderkey, l_linenumber, CAST(least(a, b, c) AS INTEGER) AS best_place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC NULLS LAST, l_linenumber) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber) AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC NULLS LAST, l_linenumber) AS c FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2)) WHERE least(a, b, c) <= 1")
def union_top_k(spark: SparkSession, d: str) -> DataFrame:
    scores = ["l_quantity", "l_extendedprice", "l_discount"]
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in scores))
    return ranking.union_top_k(lines, ["l_orderkey"], scores, "l_linenumber", 1).select("l_orderkey", "l_linenumber", "best_place")


@query("SELECT c_custkey, round(1 - row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::DOUBLE / (count(*) OVER () + 1), 9) AS risk FROM customer")
def unit_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.unit_rank(table(spark, d, "customer"), [F.col("c_acctbal").desc(), F.col("c_custkey")], "risk").select("c_custkey", F.round("risk", 9).alias("risk"))


@query("SELECT count(*) AS rows, CAST(count(*) - count(DISTINCT (c_mktsegment, c_nationkey)) AS BIGINT) AS tied_by_two, CAST(count(*) - count(DISTINCT (c_mktsegment, c_nationkey, c_acctbal)) AS BIGINT) AS tied_by_three FROM customer")
def unresolved_ties(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a ranking by two keys, and by three, leaves without a place of their own."""
    keys = ["c_mktsegment", "c_nationkey", "c_acctbal"]
    c = table(spark, d, "customer")
    return c.agg(F.count(F.lit(1)).alias("rows"), *((F.count(F.lit(1)) - F.count_distinct(F.struct(*keys[:n]))).alias(f"tied_by_{w}") for n, w in ((2, "two"), (3, "three"))))


@query("SELECT p_partkey, CASE WHEN a = greatest(a, b, c) THEN 'a' WHEN b = greatest(a, b, c) THEN 'b' ELSE 'c' END AS label FROM (SELECT p_partkey, p_partkey % 7 AS a, p_partkey % 5 AS b, p_partkey % 3 AS c FROM part)")
def argmax_label(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", *((F.col("p_partkey") % m).alias(c) for c, m in (("a", 7), ("b", 5), ("c", 3))))
    return rows.select("p_partkey", ranking.argmax_label(["a", "b", "c"]).alias("label"))


@query("WITH l AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS i FROM part), r AS (SELECT p_retailprice AS mapped, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS i FROM part) SELECT p_partkey, mapped FROM l JOIN r USING (i)")
def quantile_map(spark: SparkSession, d: str) -> DataFrame:
    return ranking.map_quantiles(table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey", "mapped").select("p_partkey", "mapped")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS i, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS g FROM part), k AS (SELECT p_partkey, p_brand, i = 1 AS lead, g, row_number() OVER (ORDER BY i > 1, g) AS place FROM r) SELECT p_partkey, lead FROM k WHERE place <= 40")
def best_of_each_then_fill(spark: SparkSession, d: str) -> DataFrame:
    """The best of every brand, filled up to 40 from the global order."""
    price = [F.col("p_retailprice").desc(), F.col("p_partkey")]
    rows = table(spark, d, "part").withColumn("lead", F.row_number().over(Window.partitionBy("p_brand").orderBy(*price)) == 1)
    return rows.orderBy(F.col("lead").desc(), *price).limit(40).select("p_partkey", "lead")


@query("SELECT c_custkey AS key, c_acctbal AS balance, NULL AS brand FROM customer UNION ALL SELECT p_partkey, NULL, p_brand FROM part")
def diagonal_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand")), allowMissingColumns=True)


@query("SELECT CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_retailprice FROM part")
def widened_union(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_size").alias("v")).union(p.select("p_retailprice"))


@query("SELECT hand_idx FROM hands WHERE hand_idx IS NOT NULL UNION SELECT hand_idx FROM seats WHERE hand_idx IS NOT NULL")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t: table(spark, d, t).select("hand_idx").filter("hand_idx is not null")
    return of("hands").union(of("seats")).distinct()


@query("(SELECT hand_idx FROM hands WHERE hand_idx IS NOT NULL UNION SELECT hand_idx FROM seats WHERE hand_idx IS NOT NULL) EXCEPT SELECT hand_idx FROM evidence")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Hands that no evidence names."""
    of = lambda t: table(spark, d, t).select("hand_idx").filter("hand_idx is not null")
    return of("hands").union(of("seats")).distinct().subtract(of("evidence"))


@query("SELECT DISTINCT player_idx FROM seats WHERE player_idx IS NOT NULL INTERSECT SELECT player_idx FROM actions")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t: table(spark, d, t).select("player_idx").filter("player_idx is not null")
    return of("seats").intersect(of("actions"))


# Scalar functions


@query("SELECT p_partkey, round(ln(p_retailprice), 6) AS ln, round(ln(1 + p_size), 6) AS log1p, round(exp(-p_size / 50.0), 6) AS e, round(sqrt(p_size), 6) AS root, abs(p_size - 25) AS dist, CAST(floor(p_retailprice / 7) AS BIGINT) AS div, p_size % 4 AS rest, CAST(sign(p_size - 25) AS INTEGER) AS sign, least(greatest(p_size, 10), 40) AS clipped, round(power(p_size, 1.5), 4) AS power FROM part")
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    s, p = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        "p_partkey", R6(F.ln(p)).alias("ln"), R6(F.log1p(s)).alias("log1p"), R6(F.exp(-s / 50.0)).alias("e"), R6(F.sqrt(s)).alias("root"), F.abs(s - 25).alias("dist"),
        F.floor(p / 7).alias("div"), (s % 4).alias("rest"), F.signum(s - 25).cast("int").alias("sign"), F.least(F.greatest(s, F.lit(10)), F.lit(40)).alias("clipped"), F.round(F.pow(s, 1.5), 4).alias("power"),
    )


@query("SELECT p_partkey, CASE WHEN p_size >= 30 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END AS bin, round(CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN (p_size - 10) * 0.05::DOUBLE WHEN p_size < 40 THEN 0.5 + (p_size - 20) * 0.025::DOUBLE ELSE 1 END, 6) AS curve FROM part")
def binning(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", shaping.bins(s, [10, 20, 30]).alias("bin"), R6(shaping.interpolate(s, [10, 20, 40], [0, 0.5, 1])).alias("curve"))


@query("SELECT p_partkey, CAST((p_size & 7) AS INTEGER) AS low, CAST((p_size << 2) AS INTEGER) AS up, CAST(bit_count(p_size) AS INTEGER) AS ones, substr(p_name, 1, 4) AS head, split_part(p_type, ' ', 1) AS kind, p_brand || '/' || CAST(p_size AS VARCHAR) AS tag, upper(trim(p_type)) AS loud, starts_with(p_brand, 'Brand#1') AS first FROM part")
def bits_and_strings(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", s.bitwiseAND(F.lit(7)).alias("low"), F.shiftleft(s, 2).alias("up"), F.bit_count(s).alias("ones"), F.substring("p_name", 1, 4).alias("head"),
        F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), F.concat_ws("/", "p_brand", s.cast("string")).alias("tag"), F.upper(F.trim("p_type")).alias("loud"), F.col("p_brand").startswith("Brand#1").alias("first"),
    )


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(embedding)::DOUBLE, 3) AS total, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS top, embedding[1] AS head, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive FROM embeddings")
def list_functions(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.size(e).cast("bigint").alias("n"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.array_position(e, F.array_max(e)).alias("top"),
        F.get(e, F.lit(0)).alias("head"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"),
    )


@query("SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS INTEGER) AS code, epoch_us(ts) AS micros, date_trunc('hour', ts) AS hour, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def codes_dates_json(spark: SparkSession, d: str) -> DataFrame:
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in (("view", 0), ("click", 1), ("purchase", 2)) for x in pair)), F.col("event_type")), F.lit(-1))
    return table(spark, d, "events").select(
        "event_id", code.alias("code"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


@query("""WITH q AS (SELECT p_partkey, 1 + p_partkey % 5 AS a, 1 + p_partkey % 3 AS b, 1 + p_partkey % 2 AS c, CAST(p_size % 8 AS INTEGER) AS mask FROM part),
k AS (SELECT p_partkey, mask, CASE WHEN mask & 1 > 0 THEN a ELSE 0 END AS a, CASE WHEN mask & 2 > 0 THEN b ELSE 0 END AS b, CASE WHEN mask & 4 > 0 THEN c ELSE 0 END AS c FROM q)
SELECT p_partkey, round(a / nullif(a + b + c, 0), 6) AS a, round(b / nullif(a + b + c, 0), 6) AS b, round(c / nullif(a + b + c, 0), 6) AS c FROM k""")
def masked_renormalisation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = shaping.renormalised([(1 + k % m).cast("double") for m in (5, 3, 2)], (F.col("p_size") % 8).cast("int"), [1, 2, 4])
    return table(spark, d, "part").select("p_partkey", *(R6(p).alias(c) for p, c in zip(parts, "abc")))
