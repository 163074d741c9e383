"""Problem 1: ordered patterns, gaps allowed, that many entities of one partition share (two-phase partition mining)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.lineage import cut

#: Rows gathered before whole groups are mined together, and positions extended at once; both bound memory, not results.
GATHERED = 100_000
EXTENDED = 1_000_000

KEYS = ["part", "chunk", "h1", "h2"]


def _codes(column: pa.Array) -> np.ndarray:
    """Small integers for the values of a column, -1 for null."""
    return pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _changes(columns: list[np.ndarray], n: int) -> np.ndarray:
    """True for the rows that differ from the one before in any column."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups out of a stream that is sorted by KEYS: about GATHERED rows, or one group if that is larger."""
    held, rows, wanted = [], 0, GATHERED
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = int(np.flatnonzero(_changes([_codes(table[k].combine_chunks()) for k in KEYS], rows))[-1])
        if last:
            yield table.slice(0, last)
        held, rows = table.slice(last).to_batches(), rows - last
        wanted = max(GATHERED, 2 * rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Sequences:
    """The sequences of several groups, flat: items as codes, and for every place the one before with the same item.

    table is sorted by KEYS and who. Groups and entities are numbered in that order.
    """

    def __init__(self, table: pa.Table):
        n = table.num_rows
        column = {k: table[k].combine_chunks() for k in [*KEYS, "who", "s"]}
        flat = pc.list_flatten(column["s"])
        every = pc.dictionary_encode(pa.concat_arrays([flat, *(column[h].cast(flat.type) for h in ("h1", "h2"))]))
        self.words = every.dictionary
        self.size = max(1, len(self.words))
        codes = pc.fill_null(every.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.items, self.h1, self.h2 = codes[: len(flat)], codes[len(flat) : len(flat) + n], codes[len(flat) + n :]
        lengths = pc.list_value_length(column["s"]).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        keys = [_codes(column[k]) for k in KEYS]
        self.group = np.cumsum(_changes(keys, n)) - 1
        self.entity = np.cumsum(_changes([self.group, _codes(column["who"])], n)) - 1
        self.first = np.flatnonzero(np.diff(self.group, prepend=-1))  # a row of every group
        row = np.repeat(np.arange(n), lengths)
        order = np.lexsort((row * self.size + self.items,))
        same = (row[order][1:] == row[order][:-1]) & (self.items[order][1:] == self.items[order][:-1])
        self.before = np.full(len(self.items), -1, np.int64)
        self.before[order[1:][same]] = order[:-1][same]

    def extend(self, node: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple:
        """All first next items: (node * size + item, place, row), sorted by the first, then by row."""
        more = self.ends[row] - 1 - at
        of = np.repeat(np.arange(len(at)), more)
        place = at[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more)
        good = self.before[place] <= at[of]
        of, place = of[good], place[good]
        key = node[of] * self.size + self.items[place]
        order = np.argsort(key, kind="stable")
        return key[order], place[order], row[of[order]]

    def supports(self, key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different keys, entities of each, index of every row's key)."""
        fresh = _changes([key], len(key))
        counted = _changes([key, self.entity[row]], len(key))
        return key[fresh], np.add.reduceat(counted, np.flatnonzero(fresh)), np.cumsum(fresh) - 1

    def slices(self, node: np.ndarray, at: np.ndarray, row: np.ndarray) -> Iterator[slice]:
        """Places, sorted by node, in runs of whole nodes with about EXTENDED next items each."""
        work = np.cumsum(self.ends[row] - 1 - at)
        edges = np.append(np.flatnonzero(_changes([node], len(node))), len(node))
        low = 0
        while low < len(node):
            far = np.searchsorted(work, (work[low - 1] if low else 0) + EXTENDED)
            high = int(edges[max(np.searchsorted(edges, low) + 1, np.searchsorted(edges, far, side="right") - 1)])
            yield slice(low, high)
            low = high


def mine(data: Sequences, least: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(group of each pattern, patterns as rows of item codes): those that `least` entities of the group have, at least.

    Prefixes of all groups grow together, breadth first inside a bounded run of them; only frequent ones go on, so the work
    follows the number of frequent patterns, not of possible ones.
    """
    rows = np.arange(len(data.starts))
    stack = [(np.arange(len(data.first)), np.empty((len(data.first), 0), np.int64), data.group, data.starts - 1, rows)]
    while stack:
        group, prefix, node, at, row = stack.pop()
        for run in data.slices(node, at, row):
            key, place, own = data.extend(node[run], at[run], row[run])
            if not len(key):
                continue
            keys, support, of = data.supports(key, own)
            parent, item = keys // data.size, keys % data.size
            often = support >= least[group[parent]]
            if not often.any():
                continue
            grown = np.column_stack([prefix[parent[often]], item[often]])
            if grown.shape[1] >= shortest:
                yield group[parent[often]], grown
            if grown.shape[1] < longest:
                on = often[of]
                number = np.cumsum(often) - 1
                stack.append((group[parent[often]], grown, number[of[on]], place[on], own[on]))


def count(data: Sequences, group: np.ndarray, patterns: list[np.ndarray]) -> np.ndarray:
    """For each pattern (item codes; -1 is an item that no sequence has) of a group, the number of entities that have it.

    All patterns are matched at once along their common prefixes.
    """
    total = np.zeros(len(patterns), np.int64)
    longest = max(map(len, patterns), default=0)
    if not longest:
        return total
    items = np.full((len(patterns), longest), -1, np.int64)
    length = np.array([len(p) for p in patterns])
    for i, p in enumerate(patterns):
        items[i, : len(p)] = p
    order = np.argsort(group, kind="stable")
    stack = [(0, order, group[order], data.group, data.starts - 1, np.arange(len(data.starts)))]
    while stack:
        depth, mine, branch, node, at, row = stack.pop()
        for run in data.slices(node, at, row):
            low, high = np.searchsorted(branch, [node[run.start], node[run.stop - 1] + 1])
            own, wanted = mine[low:high], branch[low:high] * data.size + items[mine[low:high], depth]
            good = items[own, depth] >= 0
            own, wanted = own[good], wanted[good]
            key, place, rows = data.extend(node[run], at[run], row[run])
            if not len(own) or not len(key):
                continue
            kept = np.isin(key, wanted)
            key, place, rows = key[kept], place[kept], rows[kept]
            if not len(key):
                continue
            keys, support, of = data.supports(key, rows)
            child = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[child] == wanted
            own, child = own[found], child[found]
            ends = length[own] == depth + 1
            total[own[ends]] = support[child[ends]]
            own, child = own[~ends], child[~ends]
            if len(own):
                order = np.argsort(child, kind="stable")
                on = np.isin(of, child)
                stack.append((depth + 1, own[order], child[order], of[on], place[on], rows[on]))
    return total


def _lists(rows: np.ndarray, words: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), words.take(pa.array(rows.ravel())))


def _candidates(min_support: int, shortest: int, longest: int, schema: pa.Schema):
    """Sorted units -> (part, pattern): what is frequent in a chunk at its share of the support."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            data = Sequences(table)
            one = lambda c: table[c].combine_chunks().take(pa.array(data.first))
            n, own = one("n").to_numpy().astype(np.int64), one("n_chunk").to_numpy().astype(np.int64)
            least = np.maximum(1, -(-min_support * own // n))
            heads = np.column_stack([data.h1[data.first], data.h2[data.first]])
            deep = (heads >= 0).sum(axis=1)
            part = one("part")
            for group, grown in mine(data, least, 1, longest):
                for d in np.unique(deep[group]):
                    mine_ = (deep[group] == d) & (grown.shape[1] + d >= shortest) & (grown.shape[1] + d <= longest)
                    if mine_.any():
                        whole = np.column_stack([heads[group[mine_], :d], grown[mine_]])
                        yield pa.RecordBatch.from_arrays([part.take(pa.array(group[mine_])), _lists(whole, data.words)], schema=schema)

    return run


def _counts(schema: pa.Schema):
    """Sorted units, each group's candidates after its sequences -> (part, pattern, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            data = Sequences(table)
            asked = np.flatnonzero(table["asked"].to_numpy())
            if not len(asked):
                continue
            patterns = [data.items[data.starts[r] : data.ends[r]] for r in asked]
            group = data.group[asked]
            data.ends = data.ends.copy()
            data.ends[asked] = data.starts[asked]  # candidates are not searched themselves
            total = count(data, group, patterns)
            kept = asked[total > 0]
            if len(kept):
                whole = table.take(pa.array(kept)).combine_chunks()
                yield pa.RecordBatch.from_arrays([whole["part"].combine_chunks(), whole["whole"].combine_chunks(), pa.array(total[total > 0])], schema=schema)

    return run


def frequent_subsequences(
    sequences: DataFrame,
    partition: str,
    entity: str,
    items: str,
    min_support: int,
    min_length: int = 3,
    max_length: int = 5,
    chunk_sequences: int = 500,
    least_local: int = 3,
    task_sequences: int = 500_000,
) -> DataFrame:
    """(partition, pattern, support): patterns of min_length to max_length items, in order with any gaps, that at least
    min_support different entities of the partition have in one of their sequences.

    sequences has one row per sequence; items is its array, in order, of strings or numbers. Rows with a null partition,
    entity or items do not count, null items are left out of a sequence, repeated sequences of an entity count once, other
    columns are ignored; an empty input gives no rows. Supports are exact; there are no ties to break.

    Phase 1 mines chunks of whole entities. A pattern with support s among n entities has at least s * n_i / n in one
    chunk of n_i entities, so mining each chunk at ceil(min_support * n_i / n) finds every candidate. A partition has a chunk
    for every chunk_sequences different sequences, as long as local supports stay at least_local or more: with more chunks
    than the support, a chunk would have to offer whatever occurs in it. Phase 2 counts the union of the candidates exactly
    over every sequence.

    Where that leaves more than task_sequences in a chunk, the chunk is divided further by the first one or two items of the
    patterns: a unit then holds what follows their first occurrence in each sequence, so a partition or an entity with a
    third of all rows is spread over many tasks without changing a support. Only different sequences are shuffled.
    """
    kind = sequences.schema[partition].dataType
    item = sequences.schema[items].dataType.elementType
    clean = sequences.select(
        F.col(partition).alias("part"), F.col(entity).alias("who"), F.filter(items, lambda x: x.isNotNull()).alias("s")
    ).filter(F.col("part").isNotNull() & F.col("who").isNotNull() & (F.size("s") >= min_length))
    distinct = cut(clean.distinct())
    per_entity = distinct.groupBy("part", "who").agg(F.count(F.lit(1)).alias("c"))
    sizes = per_entity.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("all")).filter(F.col("n") >= min_support)
    chunks = F.greatest(F.lit(1), F.least(F.lit(min_support // least_local), F.ceil(F.col("all") / chunk_sequences))).cast("int")
    sizes = sizes.select("part", "n", chunks.alias("chunks"))
    chunk = F.pmod(F.xxhash64("who"), F.col("chunks")).cast("int")
    unit = per_entity.join(sizes, "part").groupBy("part", chunk.alias("chunk")).agg(
        F.first("n").alias("n"), F.first("chunks").alias("chunks"), F.count(F.lit(1)).alias("n_chunk"), F.sum("c").alias("own")
    )
    most = min(2, min_length - 1)
    depth = F.when(F.col("own") <= task_sequences, 0).when(F.col("own") <= task_sequences * 10, min(1, most)).otherwise(most)
    units = cut(unit.select("part", "chunk", "chunks", "n", "n_chunk", depth.alias("depth")))
    own = F.map_from_entries(F.collect_list(F.struct("chunk", F.struct("n_chunk", "depth"))))  # as many entries as chunks
    per_part = units.groupBy("part").agg(F.first("chunks").alias("chunks"), F.first("n").alias("n"), own.alias("own"))

    none = F.lit(None).cast(item)
    after = lambda s, x: F.slice(s, F.array_position(s, x).cast("int") + 1, F.size(s))
    head = lambda a, b, rest: F.struct(a.alias("h1"), b.alias("h2"), rest.alias("s"))

    def projected(s):
        one = lambda f: F.transform(F.array_distinct(s), f)
        two = lambda x: F.transform(F.array_distinct(after(s, x)), lambda y: head(x, y, after(after(s, x), y)))
        return (
            F.when(F.col("depth") == 0, F.array(head(none, none, s)))
            .when(F.col("depth") == 1, one(lambda x: head(x, none, after(s, x))))
            .otherwise(F.flatten(one(two)))
        )

    placed = distinct.join(per_part, "part").withColumn("chunk", chunk).withColumn("own", F.element_at("own", F.col("chunk")))
    placed = placed.select("part", "chunk", "n", "who", "s", "own.*")
    placed = placed.select("part", "chunk", "n", "n_chunk", "who", F.explode(projected(F.col("s"))).alias("x"))
    placed = placed.select("part", "chunk", "n", "n_chunk", "who", "x.*").filter(F.size("s") > 0)
    sorted_units = placed.repartition(*KEYS).sortWithinPartitions(*KEYS, "who")
    kinds = pa.schema([("part", to_arrow(kind)), ("pattern", pa.list_(to_arrow(item)))])
    text, array = kind.simpleString(), f"array<{item.simpleString()}>"
    mined = sorted_units.mapInArrow(_candidates(min_support, min_length, max_length, kinds), f"part {text}, pattern {array}")
    candidates = mined.distinct()

    spread = candidates.join(units.select("part", "chunk", "depth"), "part")
    deep = lambda i: F.when(F.col("depth") >= i, F.get("pattern", F.lit(i - 1)))
    asked = spread.select(
        "part", "chunk", F.lit(None).cast(placed.schema["who"].dataType).alias("who"), deep(1).alias("h1"), deep(2).alias("h2"),
        F.slice("pattern", F.col("depth") + 1, F.size("pattern")).alias("s"), F.lit(True).alias("asked"), F.col("pattern").alias("whole"),
    )
    searched = placed.select("part", "chunk", "who", "h1", "h2", "s", F.lit(False).alias("asked"), F.lit(None).cast(array).alias("whole"))
    together = searched.unionByName(asked).repartition(*KEYS).sortWithinPartitions(*KEYS, "asked", "who")
    exact = together.mapInArrow(_counts(kinds.append(pa.field("n", pa.int64()))), f"part {text}, pattern {array}, n bigint")
    return (
        exact.groupBy(F.col("part").alias(partition), "pattern").agg(F.sum("n").alias("support")).filter(F.col("support") >= min_support)
    )


def to_arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
