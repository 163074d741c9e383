"""More of the hand log's analyses: directed events, counterfactuals, nulls, list building and nested fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators import cards, listing, models, ordered, ranking, shaping
from tarn.queries.base import ACTIONS, HANDS, actions, hands, seats
from tarn.queries.domain import FEATURES, _EV, _KEY, _LABELLED, _PAIRHAND, _SC, AGGR, CALL, KEY, class_scores, labelled, listed, model_rows, pair_hands, rowcol
from tarn.queries.relational import R6
from tarn.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


EVENTS = {"shared": ("1", "true"), "both_vol": ("1", "both_vol"), "fold_to": ("face", "fold > 0"), "lose_to": ("1", "net_x < 0 AND net_y > 0"), "lose_big_to": ("1", "net_x <= -20 AND net_y >= 20"), "showdown": ("both_flop::INT", "sd_both")}
_BOTH = """, bo AS (SELECT a AS x, b AS y, both_vol, both_flop, sd_both, face_ab AS face, fold_ab AS fold, net_ab AS net_x, net_ba AS net_y FROM ph UNION ALL SELECT b, a, both_vol, both_flop, sd_both, face_ba, fold_ba, net_ba, net_ab FROM ph)"""


@query(_PAIRHAND + _BOTH + " SELECT x, y, event, opp, hit FROM (" + " UNION ALL ".join(f"SELECT x, y, '{e}' AS event, CAST(sum({o}) AS BIGINT) AS opp, CAST(sum((({h}) AND ({o}) > 0)::INT) AS BIGINT) AS hit FROM bo GROUP BY 1, 2" for e, (o, h) in EVENTS.items()) + ") WHERE opp > 0")
def directed_events(spark: SparkSession, d: str) -> DataFrame:
    """For each player and co-player, the chances for each event and how often it came: one aggregate, then long form."""
    ph = pair_hands(spark, d)
    side = lambda x, y, s, t: ph.select(F.col(x).alias("x"), F.col(y).alias("y"), "both_vol", "both_flop", "sd_both", F.col(f"face_{s}").alias("face"), F.col(f"fold_{s}").alias("fold"), F.col(f"net_{s}").alias("net_x"), F.col(f"net_{t}").alias("net_y"))
    both = side("a", "b", "ab", "ba").unionByName(side("b", "a", "ba", "ab"))
    measures = []
    for e, (o, h) in EVENTS.items():
        o = o.replace("::INT", "").replace("both_flop", "CAST(both_flop AS INT)")
        measures += [F.expr(f"CAST(sum({o}) AS BIGINT)").alias(f"{e}_opp"), F.expr(f"count_if(({h}) AND ({o}) > 0)").alias(f"{e}_hit")]
    wide = both.groupBy("x", "y").agg(*measures)
    long = F.explode(F.array(*(F.struct(F.lit(e).alias("event"), F.col(f"{e}_opp").alias("opp"), F.col(f"{e}_hit").alias("hit")) for e in EVENTS)))
    return wide.select("x", "y", long.alias("e")).select("x", "y", "e.*").filter("opp > 0")


@query(_PAIRHAND + " SELECT hand_idx, a, b, CASE WHEN net_ab < 0 AND net_ba > 0 THEN 'a' WHEN net_ba < 0 AND net_ab > 0 THEN 'b' WHEN fold_ab > fold_ba THEN 'a' WHEN fold_ab < fold_ba THEN 'b' WHEN net_ab <= net_ba THEN 'a' ELSE 'b' END AS donor, greatest(face_ab, face_ba) AS face_most, least(face_ab, face_ba) AS face_least FROM ph")
def donor_orientation(spark: SparkSession, d: str) -> DataFrame:
    """Who gives to whom: by the flow of money, else by folds, else by the result."""
    ab, ba = F.col("net_ab"), F.col("net_ba")
    donor = F.when((ab < 0) & (ba > 0), "a").when((ba < 0) & (ab > 0), "b").when(F.col("fold_ab") > F.col("fold_ba"), "a").when(F.col("fold_ab") < F.col("fold_ba"), "b").when(ab <= ba, "a").otherwise("b")
    return pair_hands(spark, d).select("hand_idx", "a", "b", donor.alias("donor"), F.greatest("face_ab", "face_ba").alias("face_most"), F.least("face_ab", "face_ba").alias("face_least"))


@query(_PAIRHAND + " SELECT hand_idx, a, b, count(*) OVER w AS shared, round(avg(both_vol::INT) OVER w, 6) AS vol_rate, round((rank() OVER (PARTITION BY a, b ORDER BY abs(transfer)) + (count(*) OVER (PARTITION BY a, b, abs(transfer)) - 1) / 2) / count(*) OVER w, 6) AS percentile, rank() OVER (PARTITION BY a, b ORDER BY abs(transfer) DESC) - 1 AS better FROM ph WINDOW w AS (PARTITION BY a, b)")
def pair_context(spark: SparkSession, d: str) -> DataFrame:
    """Where a hand's transfer stands among its pair's."""
    w = Window.partitionBy("a", "b")
    size = F.abs("transfer")
    n = F.count(F.lit(1)).over(w)
    return pair_hands(spark, d).withColumn("size", size).select(
        "hand_idx", "a", "b", n.alias("shared"), R6(F.avg(F.col("both_vol").cast("int")).over(w)).alias("vol_rate"), R6(ranking.average_rank(F.col("size"), "a", "b") / n).alias("percentile"),
        (F.rank().over(w.orderBy(F.col("size").desc())) - 1).alias("better"),
    )


@query(_EV + ", g AS (SELECT *, CASE WHEN r < lag(r) OVER (PARTITION BY pair_id ORDER BY hand_idx) THEN 1 ELSE 0 END AS dr FROM ev), sg AS (SELECT *, CAST(sum(dr) OVER (PARTITION BY pair_id ORDER BY hand_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g) SELECT pair_id, hand_idx, segment, CAST(row_number() OVER (PARTITION BY pair_id, segment ORDER BY hand_idx) - 1 AS INTEGER) AS before FROM sg")
def evidence_segments(spark: SparkSession, d: str) -> DataFrame:
    """Runs of growing ranks in time, and how many of the run came before."""
    from tarn.operators.ordered import inversion_segments

    s = inversion_segments(listed(spark, d), ["pair_id"], ["hand_idx"], "r")
    return s.select("pair_id", "hand_idx", "segment", (F.row_number().over(Window.partitionBy("pair_id", "segment").orderBy("hand_idx")) - 1).alias("before"))


_STEP = f"""WITH {ACTIONS}, {HANDS}, k AS (SELECT a.hand_idx, action_no, a.player_idx, street, amount::DOUBLE / nullif(bb, 0) AS paid, phase,
CASE WHEN action IN (3, 4) OR (action = 5 AND coalesce(amount > to_call, false)) THEN 'agg' WHEN action = 2 OR (action = 5 AND coalesce(amount <= to_call, false)) THEN 'call' WHEN action = 1 THEN 'check' ELSE 'fold' END AS c FROM a JOIN h USING (hand_idx))"""


def classed(spark: SparkSession, d: str) -> DataFrame:
    """Steps with their class and what was paid in big blinds."""
    c = F.when(AGGR(), "agg").when(CALL(), "call").when(F.col("action") == 1, "check").otherwise("fold")
    return actions(spark, d).join(hands(spark, d).select("hand_idx", "bb", "phase"), "hand_idx").select(
        "hand_idx", "action_no", "player_idx", "street", F.try_divide(F.col("amount").cast("double"), F.col("bb").cast("double")).alias("paid"), "phase", c.alias("c")
    )


@query(_STEP + """, p AS (SELECT street, c, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY street) AS p, avg(paid) AS v FROM k GROUP BY 1, 2), e AS (SELECT street, sum(p * coalesce(v, 0)) AS ex FROM p GROUP BY 1)
SELECT player_idx, k.street, count(*) AS n, round(sum(coalesce(paid, 0) - ex), 4) AS delta FROM k JOIN e ON k.street = e.street GROUP BY 1, 2""")
def counterfactual_delta(spark: SparkSession, d: str) -> DataFrame:
    """What a player paid beyond what the population's choice among the alternatives would have cost on that street."""
    k = classed(spark, d)
    cells = k.groupBy("street", "c").agg(F.count(F.lit(1)).alias("n"), F.avg("paid").alias("v"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("street"))
    e = cells.withColumn("p", p).groupBy("street").agg(F.sum(F.col("p") * F.coalesce("v", F.lit(0.0))).alias("ex"))
    delta = F.round(F.sum(F.coalesce("paid", F.lit(0.0)) - F.col("ex")), 4)
    return k.join(F.broadcast(e), "street").groupBy("player_idx", "street").agg(F.count(F.lit(1)).alias("n"), delta.alias("delta"))  # four streets


@query(_STEP + """, f AS (SELECT player_idx, street, phase, c, count(*) AS m FROM k WHERE phase IS NOT NULL GROUP BY 1, 2, 3, 4), t AS (SELECT player_idx, street, phase, sum(m) AS n FROM f GROUP BY 1, 2, 3),
x AS (SELECT k.hand_idx, k.player_idx, -ln((coalesce(f.m, 0) + 1.0) / (coalesce(t.n, 0) + 4.0)) AS s FROM k LEFT JOIN t ON t.player_idx = k.player_idx AND t.street = k.street AND t.phase = 1 - k.phase LEFT JOIN f ON f.player_idx = k.player_idx AND f.street = k.street AND f.phase = 1 - k.phase AND f.c = k.c WHERE k.phase IS NOT NULL)
SELECT hand_idx, player_idx, round(sum(s), 5) AS total, round(max(s), 5) AS most FROM x GROUP BY 1, 2""")
def cross_phase_surprise(spark: SparkSession, d: str) -> DataFrame:
    """Surprise of a player's choices under his own rates in the other phase."""
    k = classed(spark, d).filter("phase is not null")
    f = k.groupBy("player_idx", "street", "phase", "c").agg(F.count(F.lit(1)).alias("m"))
    t = f.groupBy("player_idx", "street", "phase").agg(F.sum("m").alias("n"))
    other = lambda x: x.withColumn("phase", (1 - F.col("phase")).cast("tinyint"))
    x = k.join(other(t), ["player_idx", "street", "phase"], "left").join(other(f), ["player_idx", "street", "phase", "c"], "left")
    s = -F.ln((F.coalesce("m", F.lit(0)) + 1.0) / (F.coalesce("n", F.lit(0)) + 4.0))
    return x.withColumn("s", s).groupBy("hand_idx", "player_idx").agg(F.round(F.sum("s"), 5).alias("total"), F.round(F.max("s"), 5).alias("most"))


@query(_LABELLED + f", e AS (SELECT a, b, pos, (1.0 + count(*) FILTER (NOT pos) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING)) / (1 + count(*) FILTER (NOT pos) OVER ()) AS p1, (1.0 + count(*) FILTER (NOT pos) OVER (ORDER BY score2 DESC RANGE UNBOUNDED PRECEDING)) / (1 + count(*) FILTER (NOT pos) OVER ()) AS p2 FROM y) SELECT a, b, round(-ln(p1), 6) AS e1, round(-ln(p2), 6) AS e2, round((-2 * (ln(p1) + ln(p2)) - 4) / sqrt(8), 6) AS fisher_z FROM e")
def exceedance(spark: SparkSession, d: str) -> DataFrame:
    """How rare a score this high is among negatives, for two scores, and both together by Fisher's sum."""
    y = labelled(spark, d)
    for s, name in (("score", "p1"), ("score2", "p2")):
        cells = y.groupBy(s).agg(F.count(F.when(~F.col("pos"), 1)).alias("q"))
        above = ordered.global_prefix(cells, [F.col(s).desc()], {"t": F.col("q")}).crossJoin(F.broadcast(cells.agg(F.sum("q").alias("all"))))  # one row
        y = y.join(above.select(s, ((1.0 + F.col("t")) / (1 + F.col("all"))).alias(name)), s)
    return y.select("a", "b", R6(-F.ln("p1")).alias("e1"), R6(-F.ln("p2")).alias("e2"), R6((-2 * (F.ln("p1") + F.ln("p2")) - 4) / F.sqrt(F.lit(8.0))).alias("fisher_z"))


@query()
def binomial_surprise(spark: SparkSession, d: str) -> DataFrame:
    """-ln P(X >= hits) under the expected rate, exact through log-gamma sums, for each directed pair."""
    r = rowcol(spark, d).withColumn("p", F.least(F.greatest(F.col("expected") / F.col("n"), F.lit(1e-9)), F.lit(1 - 1e-9)))
    return r.select("table_idx", "x", "y", models.binomial_surprise(F.col("hit"), F.col("n"), F.col("p")).alias("surprise"))


@query()
def permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of positives against 200 relabelings, each drawing as many rows by a hash of row and replicate."""
    y = labelled(spark, d).withColumn("key", KEY())
    m = y.agg(F.avg(F.when(F.col("pos"), F.col("score"))).alias("seen"), F.count(F.when(F.col("pos"), 1)).alias("k"))
    drawn = y.select("key", "score", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("rep")).withColumn("u", shaping.uniform("key", "rep"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("u", "key"))
    null = drawn.withColumn("i", place).crossJoin(F.broadcast(m)).filter("i <= k").groupBy("rep").agg(F.avg("score").alias("null"), F.max("seen").alias("seen"))  # one row
    return null.agg(F.max("seen").alias("seen"), F.avg("null").alias("null_mean"), F.stddev_samp("null").alias("null_sd"), F.avg((F.col("null") >= F.col("seen")).cast("int")).alias("p"))


@query(_PAIRHAND + _SC + ", pr AS (SELECT pair_id, max(CASE WHEN behavior_family = 'soft_play' THEN 'b' ELSE 'a' END) AS cls FROM labels WHERE pair_id IS NOT NULL GROUP BY 1), k AS (SELECT pair_id, cls, hand_idx, row_number() OVER (PARTITION BY pair_id ORDER BY CASE cls WHEN 'a' THEN s_a ELSE s_b END DESC, hand_idx) AS i FROM sc JOIN pr USING (pair_id)) SELECT pair_id, cls, max(hand_idx) FILTER (i = 1) AS h1, max(hand_idx) FILTER (i = 2) AS h2, max(hand_idx) FILTER (i = 3) AS h3 FROM k GROUP BY 1, 2")
def routed_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three best hands by the score of the class that is predicted for the pair."""
    p = table(spark, d, "labels").filter("pair_id is not null").groupBy("pair_id").agg(F.max(F.when(F.col("behavior_family") == "soft_play", "b").otherwise("a")).alias("cls"))
    s = class_scores(spark, d).join(p, "pair_id").withColumn("s", F.when(F.col("cls") == "a", F.col("s_a")).otherwise(F.col("s_b")))
    top = ranking.top_k(s, ["pair_id"], [F.col("s").desc(), F.col("hand_idx")], 3)
    return top.groupBy("pair_id", "cls").agg(*(F.max(F.when(F.col("place") == i, F.col("hand_idx"))).alias(f"h{i}") for i in (1, 2, 3)))


@query(_EV + ", q AS (SELECT pair_id, hand_idx, r, ntile(10) OVER (PARTITION BY pair_id ORDER BY hand_idx) AS decile FROM ev) SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n, round(avg((r <= 3)::INT), 6) AS listed FROM q GROUP BY 1")
def listed_by_decile(spark: SparkSession, d: str) -> DataFrame:
    q = listed(spark, d).withColumn("decile", F.ntile(10).over(Window.partitionBy("pair_id").orderBy("hand_idx")))
    return q.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), R6(F.avg((F.col("r") <= 3).cast("int"))).alias("listed"))


@query("SELECT table_idx, CAST(CAST(('0x' || substr(md5(CAST(table_idx AS VARCHAR) || '|fold'), 1, 13)) AS BIGINT) % 5 AS INTEGER) AS fold FROM poker_tables")
def frozen_folds(spark: SparkSession, d: str) -> DataFrame:
    """A table's fold depends on its id alone, so it never changes as tables are added."""
    digest = F.conv(F.substring(F.md5(F.concat(F.col("table_idx").cast("string"), F.lit("|fold"))), 1, 13), 16, 10).cast("bigint")
    return table(spark, d, "poker_tables").select("table_idx", (digest % 5).cast("int").alias("fold"))


@query()
def best_lists(spark: SparkSession, d: str) -> DataFrame:
    """For each pair the ordered five of greatest expected precision on its ten likeliest hands, a greedy list that discounts
    repeated kinds, over all hands, and the chances of all hands, likeliest first, shifted to sum to five."""
    s = class_scores(spark, d).withColumn("kind", F.col("hand_idx") % 3).select("pair_id", "hand_idx", "s_a", "kind")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["s_a", "hand_idx"], ascending=[False, True], ignore_index=True)
        p, h, kind = frame["s_a"].to_numpy(float), frame["hand_idx"].to_numpy(), frame["kind"].to_numpy()
        best = listing.best_order(p[:10], np.outer(p[:10], p[:10]))
        few = listing.greedy_candidates(p, kind, 5)
        greedy = few[listing.greedy_slots(p[few], kind[few], 5, 0.6)]
        return pd.DataFrame({"pair_id": [key[0]], "best": [[int(h[i]) for i in best]], "greedy": [[int(h[i]) for i in greedy]], "shifted": [listing.logit_shift(p, min(5, len(p) * 0.9)).tolist()]})

    return s.groupBy("pair_id").applyInPandas(run, "pair_id string, best array<int>, greedy array<int>, shifted array<double>")


@query()
def exposure_law(spark: SparkSession, d: str) -> DataFrame:
    """Rate of listed hands of a family's pairs, of which no more than five are seen: from counts of counts."""
    n = listed(spark, d).groupBy("family", "pair_id").agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("k")).groupBy("family", "k").agg(F.count(F.lit(1)).alias("m"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"family": [key[0]], "pairs": [int(frame["m"].sum())], "rate": [listing.censored_poisson_rate(np.repeat(frame["k"], frame["m"]))]})

    return n.groupBy("family").applyInPandas(run, "family string, pairs bigint, rate double")


@query()
def board_equity(spark: SparkSession, d: str) -> DataFrame:
    """Exact shares of the players left at the turn and the river, for hands whose cards are all known: one computation for each
    hand, street and set of live players."""
    board = table(spark, d, "hands").filter("hand_idx is not null and size(board) >= 4").groupBy("hand_idx").agg(F.max("board").alias("board"))
    folds = actions(spark, d).groupBy("hand_idx", "player_idx").agg(F.min(F.when(F.col("action") == 0, F.col("street"))).alias("left"))
    s = seats(spark, d).join(folds, ["hand_idx", "player_idx"], "left").join(board, "hand_idx")
    live = s.select("hand_idx", "player_idx", "c1", "c2", "board", F.coalesce("left", F.lit(9)).alias("left"), F.explode(F.array(F.lit(2), F.lit(3))).alias("street"))
    live = live.filter((F.col("left") >= F.col("street")) & (F.size("board") >= F.col("street") + 2))
    hand = F.struct("player_idx", F.col("c1").cast("int").alias("c1"), F.col("c2").cast("int").alias("c2"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # fixed: the work is in the runouts, not in the bytes
    spots = live.repartition(tasks, "hand_idx", "street").groupBy("hand_idx", "street").agg(F.array_sort(F.collect_list(hand)).alias("h"), F.max("board").alias("board")).filter("size(h) >= 2 and forall(h, x -> x.c1 is not null and x.c2 is not null)")

    @F.pandas_udf("array<double>")
    def share(h: pd.Series, b: pd.Series, street: pd.Series) -> pd.Series:
        out = []
        for own, board, k in zip(h, b, street):
            holes, known = [(int(x["c1"]), int(x["c2"])) for x in own], [int(c) for c in board[: k + 2]]
            every = [c for p in holes for c in p] + known
            out.append(cards.equity(holes, known).tolist() if len(set(every)) == len(every) else None)
        return pd.Series(out)

    valued = spots.withColumn("share", share("h", "board", "street")).filter("share is not null")
    return valued.select("hand_idx", "street", F.explode(F.arrays_zip(F.col("h.player_idx").alias("player_idx"), "share")).alias("x")).select("hand_idx", "street", F.col("x.player_idx").alias("player_idx"), F.col("x.share").alias("share"))


@query()
def self_trained(spark: SparkSession, d: str) -> DataFrame:
    """Pairs without a label that a first model takes for positive join a second one at a low weight; every pair is scored."""
    rows = model_rows(spark, d, "left")
    first = models.cross_fit(rows, FEATURES, "fold", 2, "label", "logistic", "w").withColumn("p", F.get("probability", F.lit(1))).drop("probability")
    extra = models.pseudo_positives(first, "p", "label", "w", 0.2)
    second = models.cross_fit(first.withColumn("own", F.lit(True)).unionByName(extra.withColumn("own", F.lit(False))), FEATURES, "fold", 2, "label", "logistic", "w")
    return second.filter("own").select("a", "b", "p", F.get("probability", F.lit(1)).alias("q"))


@query()
def nested_fit(spark: SparkSession, d: str) -> DataFrame:
    """A second stage sees only first-stage scores that were made without the outer fold."""
    rows = model_rows(spark, d).withColumn("inner", F.pmod(F.xxhash64("at", F.lit("inner")), F.lit(2)).cast("int"))
    return models.nested_cross_fit(rows, FEATURES, "fold", "inner", 2, "label", "logistic", "w").select("a", "b", F.get("probability", F.lit(1)).alias("p"))


@query()
def greedy_blend(spark: SparkSession, d: str) -> DataFrame:
    """Hill-climbing on average precision: at each of four steps the score whose addition helps most; a step is one job over all."""
    from tarn.operators.metrics import average_precision

    y = labelled(spark, d).withColumns({"key": KEY(), "s1": F.col("score"), "s2": F.col("score2"), "s3": F.ln(F.col("n"))})
    for s in ("s1", "s2", "s3"):
        y = ordered.global_average_rank(y, s, f"{s}_rank").drop(s).withColumnRenamed(f"{s}_rank", s)
    y = y.select("key", "pos", "s1", "s2", "s3").persist()
    weights, steps = {"s1": 0, "s2": 0, "s3": 0}, []
    for step in range(4):
        trials = F.explode(F.array(*(F.struct(F.lit(s).alias("add"), sum((F.col(t) * (w + (t == s)) for t, w in weights.items()), F.lit(0.0)).alias("v")) for s in weights)))
        best = average_precision(y.select("key", "pos", trials.alias("x")).select("key", "pos", "x.*"), "v", "pos", "key", ["add"]).orderBy(F.col("ap").desc(), "add").first()
        weights[best["add"]] += 1
        steps.append((step, best["add"], best["ap"]))
    return spark.createDataFrame(steps, "step int, added string, ap double")


@query("SELECT p_partkey, CAST(ntile(4) OVER (ORDER BY p_retailprice, p_partkey) AS INTEGER) AS quarter FROM part")
def equal_bins(spark: SparkSession, d: str) -> DataFrame:
    """Four bins of equal size, the first ones one larger where the number is not divisible."""
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    i, n = F.col("i"), F.col("n")
    small, large = F.floor(n / 4), n % 4
    quarter = F.when(i < large * (small + 1), F.floor(i / (small + 1))).otherwise(large + F.floor((i - large * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    rows = ordered.row_index(part, ["p_retailprice", "p_partkey"], "i").crossJoin(F.broadcast(part.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return rows.select("p_partkey", quarter.cast("int").alias("quarter"))


@query("SELECT key, " + ", ".join(f"max(v) FILTER (s = '{x}') AS {x}" for x in ("F", "O", "P")) + " FROM (SELECT o_orderstatus AS s, 'n' AS key, count(*)::DOUBLE AS v FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, 'mean', round(avg(o_totalprice), 2) FROM orders GROUP BY 1) GROUP BY 1")
def transposed(spark: SparkSession, d: str) -> DataFrame:
    """A small report turned on its side."""
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean")).transpose("o_orderstatus")
