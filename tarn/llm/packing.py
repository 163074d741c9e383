"""Problem 6: items in containers of fixed capacity (conflict-constrained best fit)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.lineage import cut


class Bins:
    """Open bins by residual capacity; a bin carries one bitmap of the sources and one of the clusters it holds."""

    def __init__(self, capacity: int):
        self.capacity, self.residual, self.sources, self.clusters = capacity, [], [], []
        self.level: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.filled = 0  # bit r: some bin has residual r

    def compatible(self, size: int, source: int, cluster: int) -> Iterator[int]:
        """Bins with room that hold none of the given bits, tightest first, oldest first among equals."""
        r = size
        while rest := self.filled >> r:
            r += (rest & -rest).bit_length() - 1
            for b in list(self.level[r]):
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    yield b
            r += 1

    def open(self) -> int:
        self.residual.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self.level[self.capacity][len(self.residual) - 1] = None
        self.filled |= 1 << self.capacity
        return len(self.residual) - 1

    def put(self, b: int, size: int, source: int, cluster: int) -> None:
        old = self.residual[b]
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if size:
            del self.level[old][b]
            if not self.level[old]:
                self.filled &= ~(1 << old)
            self.residual[b] = old - size
            self.level[old - size][b] = None
            self.filled |= 1 << (old - size)


def pack(sizes: list[int], sources: list, clusters: list, capacity: int, strict: bool | None = None) -> list[list[tuple[int, int, int]]]:
    """For each item its pieces (bin, start, length). Items come largest first, equal clusters together.

    Two items of one cluster never share a bin, nor two of one source: the tightest bin with room that holds neither is taken,
    else a new one is opened. A source with more than half as many items as all sizes fill bins cannot be kept apart without
    waste: where every bin with room holds it, the tightest without the cluster is taken instead. strict keeps all sources
    apart (True) or none (False). An item above the capacity is divided: full bins of its own, and a last piece packed like any item.
    """
    bins, out = Bins(capacity), [[] for _ in sizes]
    bit_of_source = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    copies = Counter(c for c in clusters if c is not None)
    bit_of_cluster = {c: 1 << i for i, c in enumerate(c for c, n in copies.items() if n > 1)}
    per_source = Counter(sources)
    apart = lambda s: strict if strict is not None else 2 * per_source[s] * capacity <= sum_of_sizes
    sum_of_sizes = max(sum(sizes), 2 * capacity)
    hard = {bit for s, bit in bit_of_source.items() if apart(s)}
    work = []
    for i, size in enumerate(sizes):
        start = 0
        while size - start > capacity:
            b = bins.open()
            bins.put(b, capacity, bit_of_source.get(sources[i], 0), bit_of_cluster.get(clusters[i], 0))
            out[i].append((b, start, capacity))
            start += capacity
        work.append((start - size, i, start))
    order = sorted(work, key=lambda w: (w[0], bit_of_cluster.get(clusters[w[1]], 0), bit_of_source.get(sources[w[1]], 0)))
    last, free, loose = None, iter(()), iter(())
    for negative, i, start in order:
        size, source, cluster = -negative, bit_of_source.get(sources[i], 0), bit_of_cluster.get(clusters[i], 0)
        if last != (size, source, cluster) or not (cluster or source in hard):
            free, loose = bins.compatible(size, source, cluster), bins.compatible(size, 0, cluster)
        last = (size, source, cluster)
        # Equal items in a row go on with the same search: the bins it passed hold their cluster or source for good.
        b = next((b for b in free if not (bins.clusters[b] & cluster or bins.sources[b] & source) and bins.residual[b] >= size), None)
        if b is None and source not in hard:
            b = next((b for b in loose if not bins.clusters[b] & cluster and bins.residual[b] >= size), None)
        if b is None:
            b = bins.open()
        bins.put(b, size, source, cluster)
        out[i].append((b, start, size))
    return out


def containers(items: DataFrame, ident: str, size: str, source: str, cluster: str, capacity: int, strict: bool | None = None, shard_items: int = 20_000) -> DataFrame:
    """(ident, piece_no, start, length, container): the container of every item, or of every piece of an item above capacity.

    A container holds at most `capacity`, never two items of one cluster nor of one source, unless that is too common; see pack(). A null ident does
    not count; a repeated ident is one item, of its largest size; a null or negative size is 0, and such items go to a container like the others; a null source or cluster conflicts with nothing. Ties go by ident.
    Other columns are ignored; an empty input gives no rows.

    Items are hashed to shards of about shard_items, packed independently: a shard leaves only its last containers partly
    filled, and every item is packed, at any number of shards. container is shard * 2**32 + the number in the shard.
    """
    clean = (
        items.select(
            F.col(ident).alias("i"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"),
            F.col(source).cast("string").alias("s"), F.col(cluster).cast("string").alias("c"),
        )
        .filter("i is not null")
        .groupBy("i")
        .agg(F.max(F.struct("n", "s", "c")).alias("x"))
        .select("i", "x.*")
    )
    clean = cut(clean)
    shards = max(1, -(-clean.count() // shard_items))
    kind = clean.schema["i"].dataType.simpleString()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i", ignore_index=True)
        none = lambda column: [None if pd.isna(x) else x for x in frame[column]]
        placed = pack(frame["n"].tolist(), none("s"), none("c"), capacity, strict)
        rows = [(i, k, start, length, (int(key[0]) << 32) + b) for i, pieces in zip(frame["i"], placed) for k, (b, start, length) in enumerate(pieces)]
        return pd.DataFrame(rows, columns=["i", "piece_no", "start", "length", "container"])

    return (
        clean.groupBy(F.pmod(F.xxhash64("i"), F.lit(shards)).alias("shard"))
        .applyInPandas(run, f"i {kind}, piece_no int, start bigint, length bigint, container bigint")
        .withColumnRenamed("i", ident)
    )
