"""Problem 2: train, validation and test splits that keep related records together (largest-differencing balance)."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.graph import connected_components
from tarn.operators.skew import salted_join
from tarn.plans.lineage import cut


def largest_differencing(weights: list[float], bins: int) -> list[int]:
    """The bin of each weight, so that bin sums are nearly equal.

    Sorted weights are laid out in tuples of `bins` entries; the tuple with the largest difference is combined again and
    again with the one next to it in difference, its heaviest slots joining the other's lightest.
    """
    order = sorted(range(len(weights)), key=lambda i: (-weights[i], i))
    heap = []
    for t, at in enumerate(range(0, len(order), bins)):
        own = order[at : at + bins]
        slots = [(weights[i], [i]) for i in own] + [(0, []) for _ in range(bins - len(own))]
        heap.append((slots[-1][0] - slots[0][0], t, slots))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, t, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        slots = []
        for (wa, ia), (wb, ib) in zip(a, reversed(b)):
            if len(ia) < len(ib):
                ia, ib = ib, ia
            ia.extend(ib)
            slots.append((wa + wb, ia))
        slots.sort(key=lambda s: -s[0])
        heapq.heappush(heap, (slots[-1][0] - slots[0][0], t, slots))
    out = [0] * len(weights)
    for slot, (_, own) in enumerate(heap[0][2] if heap else []):
        for i in own:
            out[i] = slot
    return out


def allocate(sums: list[float], shares: dict[str, float]) -> list[str]:
    """The split of each bin: heaviest first, to the split that lacks most of its share."""
    whole = sum(sums)
    lack = {s: share * whole for s, share in shares.items()}
    out = [""] * len(sums)
    for i in sorted(range(len(sums)), key=lambda i: (-sums[i], i)):
        split = max(lack, key=lambda s: lack[s])
        out[i] = split
        lack[split] -= sums[i]
    return out


def balanced_splits(groups: DataFrame, group: str, weight: str, shares: dict[str, float], bins: int = 100, task_rows: int = 100_000) -> DataFrame:
    """(group, weight, bin, split): whole groups in `bins` bins of nearly equal weight, whole bins in splits of the given shares.

    groups has one row per group. A null group does not count; a null weight counts as 0; other columns are ignored; an
    empty input gives no rows. Equal weights are taken in the order of the group, so the result is repeatable.

    Groups are hashed to tasks of about task_rows, each of which differences its own into `bins` sums; the sums of about
    task_rows / bins tasks are differenced again in the same way, level by level, until one task holds them all and gives the
    bins to the splits. So no task holds more than about task_rows weights at any number of groups.
    """
    clean = groups.select(F.col(group).alias("g"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w")).filter("g is not null")
    clean = cut(clean)
    parts = max(1, -(-clean.count() // task_rows))
    kind = clean.schema["g"].dataType.simpleString()

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("g", ignore_index=True)
        return frame.assign(slot=largest_differencing(frame["w"].tolist(), bins))

    placed = cut(
        clean.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts)).cast("int"))
        .groupBy("part")
        .applyInPandas(local, f"g {kind}, w double, part int, slot int")
    )

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "slot"], ignore_index=True)
        return frame.assign(next_slot=largest_differencing(frame["w"].tolist(), bins))

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "slot"], ignore_index=True)
        total = [0.0] * bins
        for w, b in zip(frame["w"], frame["slot"]):
            total[b] += w
        split = allocate(total, shares)
        return frame.assign(bin=frame["slot"], split=[split[b] for b in frame["slot"]])[["part", "slot", "bin", "split"]]

    fan = max(2, task_rows // bins)
    sums, maps = placed.groupBy("part", "slot").agg(F.sum("w").alias("w")), []
    while parts > 1:
        parts = -(-parts // fan)
        merged = cut(
            sums.withColumn("next_part", F.pmod(F.col("part"), F.lit(parts)).cast("int"))
            .groupBy("next_part")
            .applyInPandas(merge, "part int, slot int, w double, next_part int, next_slot int")
        )
        maps.append(merged.drop("w"))
        sums = merged.groupBy(F.col("next_part").alias("part"), F.col("next_slot").alias("slot")).agg(F.sum("w").alias("w"))
    whole = sums.groupBy().applyInPandas(last, "part int, slot int, bin int, split string")
    for m in reversed(maps):
        back = m.join(whole.withColumnsRenamed({"part": "next_part", "slot": "next_slot"}), ["next_part", "next_slot"])
        whole = back.select("part", "slot", "bin", "split")
    return placed.join(whole, ["part", "slot"]).select(F.col("g").alias(group), F.col("w").alias(weight), "bin", "split")


def related_splits(records: DataFrame, record: str, links: DataFrame, via: str, shares: dict[str, float], bins: int = 100) -> DataFrame:
    """(record, group_id, bin, split): every record's split; records tied by links, over any number of steps, share it.

    records may repeat a record; each counts once. Records without links are groups of their own; links to records not
    listed still tie the others and get rows too. Nulls do not count.
    """
    tied = connected_components(links, record, via).withColumnRenamed("component", "group_id")
    alone = records.select(record).filter(F.col(record).isNotNull()).distinct().join(tied, record, "left_anti")
    members = cut(tied.unionByName(alone.withColumn("group_id", F.col(record))))
    sizes = cut(members.groupBy("group_id").agg(F.count(F.lit(1)).alias("w")))
    placed = balanced_splits(sizes, "group_id", "w", shares, bins)
    return salted_join(members, placed, ["group_id"], "w", [record]).select(record, "group_id", "bin", "split")


def torn_groups(members: DataFrame, record: str, folds: DataFrame, fold: str) -> DataFrame:
    """(record, group_id) of every group whose records hold more than one different filled fold."""
    span = folds.filter(F.col(fold).isNotNull()).groupBy(record).agg(F.min(fold).alias("low"), F.max(fold).alias("high"))
    known = cut(members.select(record, "group_id").join(span, record, "left"))
    torn = known.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("l"), F.max("high").alias("h"))
    return salted_join(known, torn.filter("l < h").select("group_id", "n"), ["group_id"], "n", [record]).select(record, "group_id")
