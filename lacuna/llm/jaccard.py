"""N-gram Jaccard join by parity sketches.

A document's set is its distinct n-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a text of fewer words, but
not none, is one shingle; without words the set is empty and linked with nothing). Two documents link when
|A & B| / |A | B| reaches the threshold, exactly.

1. Sketch: every shingle flips one bit of a parity sketch, so the Hamming distance of two sketches is at most the
   symmetric difference. Two sets of a size band can differ in at most D shingles if they link; the sketch of the band has
   more than D blocks, so linked sets agree in at least one block (pigeonhole). A set is sketched for its own band and,
   near the band's lower end, for the band below.
2. Classes: documents of equal sets are one class, so copies are never paired.
3. Buckets (band, block, bits) with two or more classes: each bucket names one of four representatives by a map-side
   minimum, every other class of the bucket is paired with it; pairs are distinct, their number is linear in the rows. A
   bitmap of the keys that two classes share keeps all other bucket rows from a second shuffle.
4. Pairs survive if sizes and a second parity sketch allow a link. That sketch has at least two bits for each shingle, so
   it tells sets apart at every size, and the wider of two is folded. Only for the pairs left are the sets of their classes
   made again from the texts, and the pairs verified on them.
5. Connected components by minimum labels. Buckets of two classes, and those whose classes all lie in one component, are
   done: no further link could change the result. For the others step 3 is repeated with other representatives while they
   are large, and then all their pairs across components go through step 4, so that no link across components is lost;
   a bucket of many classes is split into blocks, and each two of its blocks are compared at once on their sketches.
6. Links: a link lies within a component, so all pairs of classes of each component are verified on their sets and counted
   by class. A component of many classes is split into blocks of `BLOCK`, and each two of its blocks are one task.

A set is known by a hash of 128 bits. A row is known by a hash of doc_id and text, so rows without a doc_id link and are
verified like all others.

Rows: a null text is an empty set; repeated rows and equal doc_ids are each kept; a null doc_id is kept (and is never
the smallest id unless a component has no other); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED, Bitmap, Words, arrow_limits, batches, materialize, mix, utf8

#: Rows of 8 to 32 bytes, and bytes of sketches, that are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 100_000
BROADCAST_SKETCHES = 8 << 20
#: Classes of a component, or of a bucket, that meet those of another block at once.
BLOCK = 512
#: Classes of a bucket up to which its pairs are made by a join.
NARROW = 16
#: Orders of classes by which a bucket can name its representative: the minimum of the id under exclusive or.
ORDERS = (0x0000000000000000, 0x7FFFFFFFFFFFFFFF, 0x2AAAAAAAAAAAAAAA, 0x5555555555555555)


@dataclass(frozen=True)
class Join:
    percent: int = 90
    shingle: int = 3

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of linked sets whose sizes sum up to `total`."""
        p = self.percent
        return total - 2 * -(-p * total // (100 + p))

    @property
    def ratio(self) -> float:
        """Of the ends of a size band: twice the ratio, in steps, that the sizes of linked sets can have."""
        return max((100 / self.percent) ** 2, 1.02)

    def band(self, n: int) -> int:
        """Band t holds the sizes from edge(t) to below edge(t + 1)."""
        t = int(math.log(max(n, 1)) / math.log(self.ratio))
        while self.edge(t + 1) <= n:
            t += 1
        while self.edge(t) > n:
            t -= 1
        return t

    @lru_cache
    def edge(self, t: int) -> int:
        return math.ceil(self.ratio**t - 1e-9)

    @lru_cache
    def blocks(self, t: int) -> int:
        """Linked sets of which the smaller is in band t differ in fewer shingles than this."""
        largest = self.edge(t + 1) - 1
        total = largest + largest * 100 // self.percent
        return max(self.most_apart(total), self.most_apart(total - 1)) + 1

    @lru_cache
    def spare(self, t: int) -> int:
        """Empty blocks that a set of the band may leave out: one more than the smallest sets are expected to have."""
        k = self.blocks(t)
        return 1 + math.ceil(k * math.exp(-self.edge(t) / k))


def shingles(words: Words, i: int, grams: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of text i."""
    a, b = int(words.first[i]), int(words.last[i])
    if b - a >= n:
        return np.unique(grams[a : b - n + 1])
    if a == b:
        return np.zeros(0, np.uint64)
    h = np.array([b - a], np.uint64)
    for k in range(a, b):
        h = mix(h + words.hash[k])
    return h


def bucket_keys(found: np.ndarray, join: Join) -> np.ndarray:
    """Keys (signed) of the blocks of all bands that a set takes part in; sets that link with equal ones only have none.

    A block has a bit for every hash of a shingle and is kept as an exclusive-or hash of its set bits, which is zero for an
    empty block, so unrelated shingles don't agree by chance however many documents there are. Blocks that
    are empty in both sets agree without saying anything: the sketch has `spare` blocks more than the pigeonhole needs,
    and a set with at most so many empty blocks leaves them out, since some other block must then agree as well.
    """
    n, out = len(found), []
    t = join.band(n) if n else 0
    for band in (t, t - 1):
        if band < 0 or n == 0 or (band < t and n * join.percent > (join.edge(t) - 1) * 100):
            continue
        k = join.blocks(band)
        if k < 2:
            continue
        k += join.spare(band)
        h = mix(found ^ np.uint64(0xA5A5_0000 + band))
        block = ((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        bits = np.zeros(k, np.uint64)
        np.bitwise_xor.at(bits, block.astype(np.int64), mix(h + np.uint64(0x51ED_0000)))
        places = np.arange(k)
        if np.count_nonzero(bits == 0) <= join.spare(band):
            places = places[bits != 0]
        out.append(mix(mix(bits[places]) + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band << 40)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def sketch_words(n: int) -> int:
    """64-bit words of the second sketch of a set: a power of two with at least two bits for each shingle."""
    return max(4, 1 << max(0, (2 * n - 1) >> 6).bit_length())


def parity_sketch(found: np.ndarray) -> np.ndarray:
    """The two halves of a sketch, combined by exclusive or, are the sketch of half the width."""
    h, words = mix(found ^ np.uint64(0x5EED)), sketch_words(len(found))
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, ((h >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out.view(np.int64)


def set_hash(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; zeros for the empty one."""
    if not len(found):
        return 0, 0
    halves = [mix(mix(found ^ np.uint64(salt)).sum(keepdims=True) + np.bitwise_xor.reduce(found, keepdims=True) + np.uint64(len(found))) for salt in (0, 0x3C6EF372FE94F82B)]
    first, second = (int(h.view(np.int64)[0]) for h in halves)
    return first or 1, second


def _per_text(texts: pa.Array, join: Join) -> Iterator[np.ndarray]:
    whole = utf8(texts.to_pylist())
    for lo, hi in batches(whole):
        words = Words(whole[lo:hi], SPACED)
        grams = words.grams(join.shingle)
        for i in range(hi - lo):
            yield shingles(words, i, grams, join.shingle)


def _row_key() -> Column:
    """Where a text stands: rows of equal key have equal doc_id and text (a chance hit is told apart by the set's hash)."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text").cast("string")).alias("row")


def sketched(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, row, n (size of the set), h1, h2 (hash of the set), keys (of its buckets), sketch; the last two once a batch and set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, hashes, keys, sketches, seen = [], [], [], [], set()
            for found in _per_text(batch.column(2), join):
                n.append(len(found))
                hashes.append(set_hash(found))
                fresh = hashes[-1] not in seen  # a copy's buckets are those of its class
                seen.add(hashes[-1])
                keys.append(bucket_keys(found, join) if fresh else np.zeros(0, np.int64))
                sketches.append(parity_sketch(found) if len(keys[-1]) else keys[-1])
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in held])]), pa.int32()), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64), pa.int64())) for held in (keys, sketches)]
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *(pa.array([h[k] for h in hashes], pa.int64()) for k in (0, 1)), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n", "h1", "h2", "keys", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), _row_key(), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row long, n long, h1 long, h2 long, keys array<long>, sketch array<long>")


def classed(held: DataFrame) -> DataFrame:
    """The sketched rows with `cls`, the id of a set: its first hash, or a mixture of both where two sets share the first one."""
    clash = materialize(held.groupBy("h1").agg(F.min("h2").alias("least"), F.max("h2").alias("most")).where("least < most").select("h1", F.lit(True).alias("clash")), "clash")
    if clash.isEmpty():
        return held.withColumn("cls", F.col("h1"))
    # of 10**11 sets some hundred are expected here
    return held.join(F.broadcast(clash), "h1", "left").withColumn("cls", F.when(F.col("clash"), F.xxhash64("h1", "h2")).otherwise(F.col("h1"))).drop("clash")


def _sets(docs: DataFrame, owners: DataFrame, join: Join) -> DataFrame:
    """cls, members (sorted hashes as bytes) of owners (row, cls, h1, h2), made again from the texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in it:
            want = list(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True))
            kept = []
            for (cls, *hashes), found in zip(want, _per_text(batch.column(0), join), strict=True):
                if cls not in done and set_hash(found) == tuple(hashes):  # repeated rows give a set once
                    done.add(cls)
                    kept.append((cls, found.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.int64()), pa.array([m for _, m in kept], pa.binary())], names=["cls", "members"])

    few = owners.count() <= BROADCAST_IDS
    texts = docs.select(_row_key(), F.col("text").cast("string"))
    made = texts.join(F.broadcast(owners) if few else owners, "row").select("text", "cls", "h1", "h2").mapInArrow(run, "cls long, members binary")
    made = materialize(made, "sets")
    return made if made.count() == owners.count() else materialize(made.dropDuplicates(["cls"]), "sets")  # rows that repeat in other tasks


def _apart(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ; the wider one is folded first. Sizes of linked sets allow one fold at most."""

    def fold(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))

    def bits(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, c: s + c)

    return F.when(F.size(a) > F.size(b), bits(fold(a), b)).when(F.size(a) < F.size(b), bits(a, fold(b))).otherwise(bits(a, b))


def _plausible(join: Join) -> Column:
    """Sizes and sketches of sides a and b allow a link."""
    p = join.percent
    apart = F.col("a_n") + F.col("b_n") - 2 * F.ceil((F.col("a_n") + F.col("b_n")) * p / float(100 + p) - 1e-9)
    return F.when(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * p, _apart(F.col("a_sketch"), F.col("b_sketch")) <= apart).otherwise(F.lit(False))


def _side(sets: DataFrame, side: str, *columns: str) -> DataFrame:
    return sets.select([F.col(c).alias(f"{side}_{c}" if c != "cls" else side) for c in ("cls", *columns)])


def _verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    p = join.percent

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for x, y in zip(batch.column("a_members"), batch.column("b_members"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([u, v])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= p * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(_side(sets, "b", "members"), "b").join(_side(sets, "a", "members"), "a").select("a", "b", "a_members", "b_members").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """cls, comp (smallest class reachable) of the classes that have a link: minimum labels with pointer jumping."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["cls"]).groupBy("a").agg(F.min("comp").alias("near"))
        nearest = labels.join(near, labels["cls"] == near["a"], "left").select("cls", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = labels.select(F.col("cls").alias("at"), F.col("comp").alias("to"))
        fresh = materialize(nearest.join(jump, nearest["comp"] == jump["at"], "left").select("cls", "old", F.least("comp", F.coalesce("to", "comp")).alias("comp")), "labels")
        labels = fresh.select("cls", "comp")
        if fresh.where("comp <> old").isEmpty():
            return labels


def _order(turn: int) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in ORDERS)), (F.pmod(F.col("key") + turn, F.lit(len(ORDERS))) + 1).cast("int"))


def _shared(rows: DataFrame) -> DataFrame:
    """key, low of the buckets of two classes or more; rows: key, cls."""
    x = F.col("cls").bitwiseXOR(_order(0))
    return materialize(rows.groupBy("key").agg(F.min(x).alias("low"), F.max(x).alias("high")).where("low < high").select("key", "low"), "shared-keys")


def _in_shared(held: DataFrame, shared: DataFrame) -> DataFrame:
    """key, cls of the buckets in `shared` and of some by chance: a bitmap of their keys, of at most 64 MB, saves
    the other rows the shuffle."""
    sent = held.sparkSession.sparkContext.broadcast(Bitmap(shared, "key"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in it:
            keys = batch.column(1)
            flat, owner = keys.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), keys.value_lengths().to_numpy())
            kept = bitmap.has(flat)
            yield pa.RecordBatch.from_arrays([pa.array(flat[kept]), pa.array(owner[kept])], names=["key", "cls"])

    return held.select("cls", "keys").mapInArrow(run, "key long, cls long")


def _with_low(rows: DataFrame, low: DataFrame, turn: int) -> DataFrame:
    """key, cls, rep: each class of a bucket with the bucket's representative."""
    return rows.join(F.broadcast(low) if low.count() <= BROADCAST_IDS else low, "key").select("key", "cls", F.col("low").bitwiseXOR(_order(turn)).alias("rep"))


def _representatives(rows: DataFrame, turn: int) -> DataFrame:
    x = F.col("cls").bitwiseXOR(_order(turn))
    return _with_low(rows, materialize(rows.groupBy("key").agg(F.min(x).alias("low")), "lows"), turn)


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of a class and its bucket's representative; rows: key, cls, rep."""
    return rows.where("cls <> rep").select(F.least("cls", "rep").alias("a"), F.greatest("cls", "rep").alias("b")).distinct()


def _across(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """key, cls, comp of the buckets of three classes or more that lie in two components or more."""
    held = rows.select("key", "cls").join(labels, "cls", "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
    mixed = held.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("rows")).where("least < most and rows > 2").select("key")
    return held.join(mixed, "key", "left_semi")


def close_in_tile(sizes: np.ndarray, sketches: list[np.ndarray], comps: np.ndarray, second: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different components whose sizes and sketches allow a link; if any is `second`, pairs across only."""
    width = min(map(len, sketches))  # sets of a band differ in width by one fold at most
    held = np.stack([np.bitwise_xor.reduce(s.view(np.uint64).reshape(-1, width), axis=0) for s in sketches])
    p, found = join.percent, []
    left = np.flatnonzero(~second)
    right = np.flatnonzero(second) if second.any() else left
    for i in left.tolist():
        other = right[comps[right] != comps[i]]
        if right is left:
            other = other[other > i]
        other = other[(np.minimum(sizes[other], sizes[i]) * 100 >= np.maximum(sizes[other], sizes[i]) * p)]
        total = sizes[other] + sizes[i]
        apart = np.bitwise_count(held[other] ^ held[i]).sum(axis=1, dtype=np.int64)
        found.append((i, other[apart <= total - 2 * -(-p * total // (100 + p))]))
    a = np.concatenate([np.full(len(o), i) for i, o in found]) if found else np.zeros(0, np.int64)
    return a.astype(np.int64), np.concatenate([o for _, o in found]) if found else np.zeros(0, np.int64)


def _wide_pairs(rows: DataFrame, sketches: DataFrame, wide: DataFrame, join: Join) -> DataFrame:
    """Plausible pairs (a, b) across components of the buckets in `wide` (key, blocks); rows: key, cls, comp.

    A bucket is cut into blocks of about `BLOCK` classes and each two of its blocks are one task's group, so no group grows
    with the bucket.
    """
    placed = rows.join(wide, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("key", "cls", "comp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("second"))

    def run(tile: pa.Table) -> pa.Table:
        columns = {c: tile[c].combine_chunks() for c in ("cls", "comp", "n", "second", "sketch")}
        cls, comps, sizes, second = (columns[c].to_numpy(zero_copy_only=False) for c in ("cls", "comp", "n", "second"))
        ends = columns["sketch"].value_lengths().to_numpy().cumsum()
        parts = np.split(columns["sketch"].flatten().to_numpy(), ends[:-1])
        if tile["x"][0].as_py() < tile["y"][0].as_py() and (second.all() or not second.any()):
            a = b = np.zeros(0, np.int64)
        else:
            a, b = close_in_tile(sizes, parts, comps, second, join)
        return pa.table({"a": np.minimum(cls[a], cls[b]), "b": np.maximum(cls[a], cls[b])})

    return tiles.join(sketches, "cls").select("key", "x", "y", "second", "cls", "comp", "n", "sketch").groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def linked_within(members: list[np.ndarray], n_first: int, join: Join) -> np.ndarray:
    """Links of each set with the others; if n_first is not their number, only those between the first ones and the rest."""
    sizes = np.array([len(m) for m in members], np.int64)
    owner = np.repeat(np.arange(len(members)), sizes)
    _, at, often = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)  # no other shingle counts in an intersection
    place = np.full(len(often), -1)
    place[shared] = np.arange(len(shared))
    column = place[at]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    cross = n_first < len(members)
    left, right = (slice(0, n_first), slice(n_first, None)) if cross else (slice(None), slice(None))
    common = np.zeros((len(sizes[left]), len(sizes[right])), np.int64)
    for lo in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        held = np.zeros((len(members), min(4096, len(shared) - lo)), np.float32)
        held[owner[a:b], column[a:b] - lo] = 1
        common += (held[left] @ held[right].T).astype(np.int64)
    link = 100 * common >= join.percent * (sizes[left][:, None] + sizes[right][None, :] - common)
    if cross:
        return np.concatenate([link.sum(1), link.sum(0)])
    np.fill_diagonal(link, False)
    return link.sum(1)


def _degrees(labels: DataFrame, sets: DataFrame, join: Join, block: int) -> DataFrame:
    """cls, n_links (other classes that it links with) of the classes that have a link; labels: cls, comp."""
    large = labels.groupBy("comp").count().where(F.col("count") > block).select("comp", F.ceil(F.col("count") / block).alias("blocks"))
    large = materialize(large, "large-components")
    placed = labels.join(F.broadcast(large) if large.count() <= BROADCAST_IDS else large, "comp", "left").select("cls", "comp", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    tiles = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("cls", "comp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("second"))

    def run(tile: pa.Table) -> pa.Table:
        held = {c: (s, np.frombuffer(m.as_buffer(), np.uint64)) for c, s, m in zip(tile["cls"].to_pylist(), tile["second"].to_pylist(), tile["members"].combine_chunks(), strict=True)}
        kept = sorted(held, key=lambda c: held[c][0])
        n_first = sum(not held[c][0] for c in kept) if tile["x"][0].as_py() < tile["y"][0].as_py() else len(kept)
        if n_first in (0, len(kept)) and tile["x"][0].as_py() < tile["y"][0].as_py():
            return pa.table({"cls": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
        return pa.table({"cls": pa.array(kept, pa.int64()), "n_links": pa.array(linked_within([held[c][1] for c in kept], n_first, join), pa.int64())})

    counts = tiles.join(sets, "cls").select("cls", "comp", "x", "y", "second", "members").groupBy("comp", "x", "y").applyInArrow(run, "cls long, n_links long")
    return counts.groupBy("cls").agg(F.sum("n_links").alias("n_links"))


def grouped(docs: DataFrame, join: Join = Join(), links_too: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, row (key), n (size of the set), cls, comp (of the class) and, if `links_too`, n_links (other classes linked)."""
    arrow_limits(docs.sparkSession)
    held = classed(materialize(sketched(docs, join), "sketches"))
    shared = _shared(held.select("cls", F.explode("keys").alias("key")))
    named = materialize(_with_low(_in_shared(held, shared), shared, 0).distinct(), "buckets")  # only buckets of two classes or more
    sketches = materialize(held.where(F.size("sketch") > 0).join(named.select("cls").distinct(), "cls", "left_semi").select("cls", "n", "sketch").dropDuplicates(["cls"]), "sketches-paired")
    few = (sketches.agg(F.sum(F.size("sketch") + 4)).first()[0] or 0) * 8 <= BROADCAST_SKETCHES
    sets: list[DataFrame] = []

    def every() -> DataFrame:
        return reduce(DataFrame.union, sets)

    def linked(pairs: DataFrame) -> DataFrame:
        """The verified ones of plausible pairs; sets that no earlier call made are made now."""
        pairs = materialize(pairs, "plausible")
        need = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        for have in sets:
            need = need.join(have.select("cls"), "cls", "left_anti")
        owners = materialize(held.join(need, "cls", "left_semi").groupBy("cls", "h1", "h2").agg(F.min("row").alias("row")).select("row", "cls", "h1", "h2"), "owners")
        sets.append(_sets(docs, owners, join))
        return materialize(_verified(pairs, every(), join), "verified")

    def plausible(pairs: DataFrame) -> DataFrame:
        sides = [_side(sketches, s, "n", "sketch") for s in "ab"]
        for s, side in zip("ab", sides, strict=True):
            pairs = pairs.join(F.broadcast(side) if few else side, s)
        return pairs.where(_plausible(join)).select("a", "b")

    links = linked(plausible(_pairs(named)))
    labels = components(links)
    rows, before = named.select("key", "cls"), None
    for turn in range(1, len(ORDERS)):
        rows = materialize(_across(rows, labels), "across")
        size = rows.groupBy("key").agg(F.count("*").alias("c")).agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("pairs")).first()
        if not size["rows"]:
            break
        # another turn of representatives is for large buckets that the last one has made smaller
        last = turn == len(ORDERS) - 1 or size["pairs"] <= BLOCK * size["rows"] or before is not None and size["rows"] > 0.9 * before
        before = size["rows"]
        if last:  # what is left in several components, all of it
            counts = rows.groupBy("key").agg(F.count("*").alias("c"))
            wide = materialize(counts.where(F.col("c") > NARROW).select("key", F.ceil(F.col("c") / BLOCK).alias("blocks")), "wide")
            narrow = rows.join(F.broadcast(wide) if wide.count() <= BROADCAST_IDS else wide, "key", "left_anti")
            side = lambda s: narrow.select("key", F.col("cls").alias(s), F.col("comp").alias(f"{s}_comp")).join(_side(sketches, s, "n", "sketch"), s)
            wanted = side("a").join(side("b"), "key").where(F.col("a_comp") < F.col("b_comp")).where(_plausible(join)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            wanted = wanted.union(_wide_pairs(rows, sketches, wide, join)).distinct()
        else:
            wanted = plausible(_pairs(_representatives(rows.select("key", "cls"), turn)))
        more = linked(wanted)
        if not more.isEmpty():
            links = links.union(more).distinct()
            labels = components(links)
        if last:
            break
    labels = labels.withColumnRenamed("comp", "found")
    if links_too:
        labels = labels.join(_degrees(labels.select("cls", F.col("found").alias("comp")), every(), join, block), "cls", "left")
    columns = ["doc_id", "row", "n", "cls", F.coalesce("found", "cls").alias("comp")] + [F.coalesce("n_links", F.lit(0)).alias("n_links")] * links_too
    return held.select("doc_id", "row", "n", "cls").join(labels, "cls", "left").select(columns)


def similar_components(docs: DataFrame, join: Join = Join(), block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), cls and n_links (other classes linked)."""
    found = materialize(grouped(docs, join, True, block), "grouped")
    least = found.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    joined = found.join(least, (found["comp"] == least["comp"]) & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "cls", "n_links")


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One row of each component, with its own columns: that of the smallest doc_id (null last), then of the smallest row key.

    Rows without words are never in a group and all stay. Of rows that share doc_id and text the first one by the other
    columns (as JSON) stays. Texts are shuffled once, by the row key, for the join and the choice among repeated rows.
    """
    found = grouped(docs.select("doc_id", "text"), join)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    chosen = found.where("n > 0").groupBy("comp").agg(first.alias("first")).select(F.col("first.row").alias("_lacuna_row"), F.lit(False).alias("_lacuna_wordless"))
    chosen = chosen.union(found.where("n = 0").select("row", F.lit(True)).distinct())
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    once = F.row_number().over(Window.partitionBy("_lacuna_row").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0)))
    held = docs.select("*", _row_key().alias("_lacuna_row")).join(chosen, "_lacuna_row")
    return held.withColumn("_lacuna_rank", once).where("_lacuna_wordless or _lacuna_rank = 1").select(docs.columns)
