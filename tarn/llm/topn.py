"""Problem 4: the first N items of every group (secondary sort, streamed)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stream(group: list[str], n: int):
    """Arrow batches sorted by group -> the first n rows of each group, with their place; holds one batch and one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch[g] for g in group]
            new = pa.array([True] * batch.num_rows)
            if batch.num_rows > 1:
                same = None
                for k in keys:
                    x, y = k.slice(1), k.slice(0, batch.num_rows - 1)
                    equal = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
                    same = equal if same is None else pc.and_(same, equal)
                new = pa.concat_arrays([pa.array([True]), pc.invert(same)])
            starts = pc.indices_nonzero(new).to_numpy()
            run_of = pc.cumulative_sum(pc.cast(new, pa.int64())).to_numpy() - 1
            first = tuple(k[0].as_py() for k in keys)
            place = pa.array(range(batch.num_rows)).to_numpy() - starts[run_of] + 1
            if first == last:
                place = place + (run_of == 0) * carried
            last, carried = tuple(k[batch.num_rows - 1].as_py() for k in keys), int(place[-1])
            keep = pa.array(place <= n)
            yield pa.RecordBatch.from_arrays(
                [*batch.filter(keep).columns, pa.array(place, pa.int32()).filter(keep)], [*batch.schema.names, "__place"]
            )

    return run


def top_n(rows: DataFrame, group: list[str], by: list, ident: list[str], n: int, place: str = "place") -> DataFrame:
    """The first n rows of every group in the order of `by` (sort columns), then of ident, with their place from 1.

    Hash-partitioned by group, sorted inside the partitions, streamed in Arrow batches that keep one key and a counter, so
    no group is held in memory. A hot group is first spread over all partitions by a hash of ident, each of which sends at
    most n of its rows on. All columns are kept; a null group is a group of its own; nulls sort where `by` and ident put them
    (ident ascending, nulls first); rows equal in everything named are ordered by the hash of all their columns, so a
    repeated row takes as many places as it has copies. A column named like `place` is replaced. An empty input gives no rows.
    """
    rows = rows.drop("__place", *([place] if place not in [*group, *ident] else []))
    hashed = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    order = [F.col(g).asc() for g in group] + list(by) + [F.col(i).asc() for i in ident] + [F.xxhash64(*hashed)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", `__place` int"
    spread = rows.repartition(*group, *ident).sortWithinPartitions(*order).mapInArrow(_stream(group, n), schema).drop("__place")
    return (
        spread.repartition(*group)
        .sortWithinPartitions(*order)
        .mapInArrow(_stream(group, n), schema)
        .withColumnRenamed("__place", place)
    )
