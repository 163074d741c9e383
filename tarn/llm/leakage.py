"""Problem 7: evaluation texts inside training texts (spaced-seed hashing)."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.lineage import cut

_WORDS = re.compile(r"[a-z0-9]+")
SEGMENT = 1_000


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def masks(window: int, groups: int, ignored: int) -> list[np.ndarray]:
    """Positions that each seed looks at: all but those of `ignored` of the `groups` residue classes.

    Any substitutions at up to `ignored` positions of a window lie in the ignored classes of some seed, so no window with
    so few substitutions is missed.
    """
    at = np.arange(window)
    return [at[~np.isin(at % groups, off)] for off in itertools.combinations(range(groups), ignored)]


class Seeds:
    """A block of evaluation texts, indexed by the hashes of its windows under every mask."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, groups: int, ignored: int):
        self.window, self.vocabulary = window, {}
        ids, owner, starts = [], [], []
        for item, text in items:
            at = len(ids)
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text]
            owner += [item] * len(text)
            starts += range(at, at + len(text) - window + 1)
        self.ids, self.owner = np.array(ids, np.int64), np.array(owner, np.int64)
        starts = np.array(starts, np.int64)
        factors = np.random.default_rng(7).integers(1, 2**63 - 1, window, np.int64) | 1
        self.seeds = []
        for mask in masks(window, groups, ignored):
            hashes = self._hash(self.ids, starts, mask, factors)
            order = np.argsort(hashes, kind="stable")
            self.seeds.append((mask, factors[mask], hashes[order], starts[order]))

    @staticmethod
    def _hash(ids: np.ndarray, starts: np.ndarray, mask: np.ndarray, factors: np.ndarray) -> np.ndarray:
        total = np.zeros(len(starts), np.int64)
        for p in mask:
            total += (ids[starts + p] + 1) * factors[p]
        return total ^ (total >> np.int64(29))

    def search(self, text: list[str]) -> dict[int, int]:
        """For each item that overlaps the text, the fewest substitutions of any window."""
        n = len(text) - self.window + 1
        if n <= 0:
            return {}
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in text), np.int64, len(text))
        known = (ids >= 0).astype(np.int32)
        total = np.concatenate([[0], np.cumsum(known)])
        least = min(len(s[0]) for s in self.seeds)
        places = np.flatnonzero(total[self.window :] - total[:n] >= least)
        if not len(places):
            return {}
        found: dict[int, int] = {}
        for mask, factors, hashes, starts in self.seeds:
            at = places[np.all(known[places[:, None] + mask], axis=1)]
            if not len(at):
                continue
            wide = np.zeros(self.window, np.int64)
            wide[mask] = factors
            h = self._hash(ids, at, mask, wide)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hits = high - low
            if not hits.any():
                continue
            mine = np.repeat(at, hits)
            theirs = starts[np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)]
            subs = np.zeros(len(mine), np.int64)
            for p in range(self.window):
                subs += ids[mine + p] != self.ids[theirs + p]
            owners = self.owner[theirs]
            for item in np.unique(owners):
                fewest = int(subs[owners == item].min())
                if fewest < found.get(int(item), self.window):
                    found[int(item)] = fewest
        return found


def _segments(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                w = words(text or "")
                cuts = range(0, max(1, len(w) - window + 1), SEGMENT)
                rows = [w[c : c + SEGMENT + window - 1] for c in cuts if len(w) >= window]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))],
                    ["item", "segment", "words"],
                )

    return run


def _mix(total: np.ndarray) -> np.ndarray:
    """Spreads a sum over the low bits, by which windows are sifted and joined."""
    total = total ^ (total >> np.int64(31))
    total *= np.int64(0x4F1BBCDCBFA53E0B)
    return total ^ (total >> np.int64(29))


class Hasher:
    """Hashes of every window of a text under every seed, equal in all tasks: words are hashed themselves, not numbered."""

    def __init__(self, window: int, groups: int, ignored: int):
        self.window, self.known = window, {}
        drawn = np.random.default_rng(7)
        factors = drawn.integers(1, 2**63 - 1, window, np.int64) | 1
        self.seeds = [(mask, factors[mask], drawn.integers(2**63 - 1)) for mask in masks(window, groups, ignored)]

    def ids(self, text: list[str]) -> np.ndarray:
        if len(self.known) > 1_000_000:  # a cache, not a vocabulary
            self.known.clear()
        known = self.known
        for w in text:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w) >> 1
        return np.fromiter((known[w] for w in text), np.int64, len(text))

    def windows(self, text: list[str]) -> list[np.ndarray]:
        """For every seed the hash of each window."""
        n = len(text) - self.window + 1
        if n <= 0:
            return []
        ids = self.ids(text)
        out = []
        for mask, factors, salt in self.seeds:
            total = np.full(n, salt, np.int64)
            for p, f in zip(mask, factors):
                total += ids[p : p + n] * f
            out.append(_mix(total))
        return out


BITS = 27


def _sieve(hashes: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** BITS bits, 16 MB at any number of items, with the low bits of every hash."""
    low = F.col("h").bitwiseAND(F.lit(2**BITS - 1))
    words = hashes.select(low.alias("b")).groupBy(F.shiftright("b", 6).alias("word"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    out = np.zeros(2 ** (BITS - 6), np.int64)
    for part in rows.toLocalIterator():
        out[part["word"]] = part["bits"]
    return out


def _joined(corpus: DataFrame, segments: DataFrame, parts: Callable, window: int, groups: int, substitutions: int) -> DataFrame:
    """(doc, item, substitutions) by a join of the hashes of both sides, in one pass over the documents.

    Different windows of the items are hashed under every seed. Windows of the documents go to the join only if their hash is
    in a bitmap of fixed size of the items' hashes. A pair that meets is verified word by word, and only then is a window's
    list of items attached, so a passage that many items share is compared once.
    """
    spark = corpus.sparkSession
    runs = segments.select("item", F.explode(F.sequence(F.lit(1), F.size("words") - window + 1)).alias("at"), "words")
    theirs = runs.select("item", F.array_join(F.slice("words", F.col("at"), window), " ").alias("theirs")).distinct()
    theirs = cut(theirs)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(window, groups, substitutions)
        for batch in batches:
            texts = batch["theirs"].to_pylist()
            every = [hasher.windows(t.split(" ")) for t in texts]
            for i in range(len(hasher.seeds)):
                yield pa.RecordBatch.from_arrays([batch["theirs"], pa.array([e[i][0] for e in every], pa.int64())], ["theirs", "h"])

    wanted = cut(theirs.select("theirs").distinct().mapInArrow(hashed, "theirs string, h bigint"))
    sieve = spark.sparkContext.broadcast(_sieve(wanted))

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Hasher(window, groups, substitutions), sieve.value
        for batch in batches:
            docs, texts, found = [], [], []
            for doc, body in zip(batch["doc"].to_pylist(), batch["text"].to_pylist()):
                for part in parts(body):
                    text = words(part)
                    for h in hasher.windows(text):
                        b = h & np.int64(2**BITS - 1)
                        hit = np.flatnonzero(bits[b >> np.int64(6)] >> (b & np.int64(63)) & 1)
                        docs += [doc] * len(hit)
                        texts += [" ".join(text[i : i + window]) for i in hit.tolist()]
                        found += h[hit].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.string()), pa.array(found, pa.int64())], ["doc", "own", "h"])

    own = corpus.mapInArrow(sifted, "doc bigint, own string, h bigint")
    differ = F.aggregate(F.zip_with(F.split("own", " "), F.split("theirs", " "), lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)
    met = own.distinct().join(wanted, "h").select("doc", "theirs", differ.alias("substitutions")).filter(F.col("substitutions") <= substitutions)
    least = met.groupBy("doc", "theirs").agg(F.min("substitutions").alias("substitutions"))
    return least.join(theirs, "theirs").groupBy("doc", "item").agg(F.min("substitutions").alias("substitutions"))


def leaked_items(
    documents: DataFrame,
    doc_id: str,
    text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    parts: Callable[[str | None], list[str]] = lambda t: [t] if t else [],
    window: int = 12,
    groups: int = 4,
    substitutions: int = 2,
    block_words: int = 200_000,
) -> DataFrame:
    """(doc_id, item_id, substitutions): every item of which `window` consecutive words stand in one part of a document,
    with the fewest words that differ in such a window, up to `substitutions`.

    parts gives the texts of a document that are searched one by one. Words are runs of a-z and 0-9 after lower-casing.
    Ids are bigint. Null ids and texts, and texts of fewer than `window` words, give no rows; a repeated id gives one row
    per row of documents; other columns are ignored; empty tables give no rows.

    Items are cut into overlapping segments. Up to block_words of them, their index has a bounded size and is sent to the
    tasks, and the documents are read once without a shuffle. More of them meet the documents in a join of hashes, see
    _joined(), again in one pass over the documents. Both ways give the same rows. Seeds are exact for the tolerance: see
    masks(). Every hit is verified word by word.
    """
    spark = documents.sparkSession
    segments = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("text")).filter("item is not null")
    segments = segments.mapInArrow(_segments(window), "item bigint, segment int, words array<string>")
    total = segments.agg(F.sum(F.size("words"))).first()[0] or 0
    corpus = documents.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null")
    schema = "doc bigint, item bigint, substitutions int"
    named = lambda found: found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "substitutions")
    if total > block_words:
        return named(_joined(corpus, segments, parts, window, groups, substitutions))

    def scan(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = index.value
            for batch in batches:
                rows = []
                for doc, body in zip(batch["doc"].to_pylist(), batch["text"].to_pylist()):
                    best: dict[int, int] = {}
                    for part in parts(body):
                        for item, subs in seeds.search(words(part)).items():
                            if subs < best.get(item, substitutions + 1):
                                best[item] = subs
                    rows += [(doc, item, subs) for item, subs in best.items()]
                columns = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())],
                    ["doc", "item", "substitutions"],
                )

        return run

    seeds = Seeds(sorted((r["item"], r["words"]) for r in segments.select("item", "words").toLocalIterator()), window, groups, substitutions)
    return named(corpus.mapInArrow(scan(spark.sparkContext.broadcast(seeds)), schema))
