"""Near-duplicate groups: exact set similarity behind a pivot table of fingerprint distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.words import sequence_hashes, words_of
from casewright.operators.components import connected_components
from casewright.plans.session import cut, stored

#: Bits of a fingerprint, reference fingerprints, and fingerprints from which the references are chosen (bounds by design).
BITS, PIVOTS, PIVOT_SAMPLE = 512, 32, 512
#: Members of a posting from which it is split by a further shingle before its classes are paired, and shingles by which
#: it is split at most; what is then still that large is paired block by block.
CROWD, LEVELS = 256, 4


def odd_sketches(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Bit k of a row is the parity of its values that fall on k; so two rows differ in at most as many bits as their sets in elements."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    spot = rows * BITS + (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    return (np.bincount(spot, minlength=(len(offsets) - 1) * BITS) & 1).astype(np.uint8).reshape(-1, BITS)


def choose_pivots(bits: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """The empty fingerprint and then, again and again, the row farthest from all chosen ones."""
    chosen = [np.zeros(BITS, np.uint8)]
    far = bits.sum(1).astype(np.int64)
    while len(chosen) < count:
        if len(bits) and far.max() > 0:
            chosen.append(bits[far.argmax()])
            far = np.minimum(far, (bits != chosen[-1]).sum(1))
        else:
            chosen.append(chosen[0])
    return np.array(chosen)


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy()[offsets[0] : offsets[-1]]


def _rows(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))


def fingerprints(sets: DataFrame) -> DataFrame:
    """Of sets (``rep``, ``s``) the size ``n`` and the fingerprint ``fp`` (8 longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                offsets, values = _arrays(batch.column(1))
                packed = np.packbits(odd_sketches(offsets, values), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int32()), _rows(packed)], names=["rep", "n", "fp"])

    return sets.select("rep", "s").mapInArrow(run, "rep bigint, n int, fp array<bigint>")


def with_pivot_table(marks: DataFrame) -> DataFrame:
    """Fingerprints (``rep``, ``n``, ``fp``) with ``pv``, their Hamming distances to the reference fingerprints."""
    sample = np.array([r[0] for r in marks.orderBy(F.xxhash64("fp"), "rep").select("fp").limit(PIVOT_SAMPLE).collect()], np.int64)
    pivots = choose_pivots(np.unpackbits(sample.view(np.uint8).reshape(-1, BITS // 8), axis=1))
    share = marks.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = share.value.astype(np.float32)
        for batch in batches:
            if batch.num_rows:
                bytes_ = _arrays(batch.column(2))[1].astype(np.int64).view(np.uint8).reshape(-1, BITS // 8)
                x = np.unpackbits(bytes_, axis=1).astype(np.float32)
                distances = (x.sum(1)[:, None] + p.sum(1)[None, :] - 2 * x @ p.T).round().astype(np.int16)
                yield pa.RecordBatch.from_arrays([*batch.columns, _rows(distances)], names=["rep", "n", "fp", "pv"])

    return marks.select("rep", "n", "fp").mapInArrow(run, "rep bigint, n int, fp array<bigint>, pv array<smallint>")


def _may_link(threshold: float, level: int, a: str = "a", b: str = "b") -> Column:
    """What a linked pair fulfils where its first ``level`` shared shingles meet: bounds by size and by position."""
    col = lambda t, n: F.col(f"{t}.{n}")
    total = col(a, "n") + col(b, "n")
    most = F.least(col(a, "n") - col(a, "pos"), col(b, "n") - col(b, "pos")) + (level - 1)
    size = F.least(col(a, "n"), col(b, "n")) >= threshold * F.greatest(col(a, "n"), col(b, "n")) - 1e-6
    return size & (most >= threshold / (1 + threshold) * total - 1e-6)


def _verify(pairs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """The pairs of ``a``, ``b`` whose sets are similar enough: by pivots, by fingerprints, by exact intersection.

    Pairs that pass the first two (both lossless) are intersected; shingles of one set only can't be in any intersection,
    so the lists of shared ones suffice."""
    side = lambda x: table.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "fp", "pv", "l"))).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    total = F.col("na") + F.col("nb")
    apart = (1 - threshold) / (1 + threshold) * total + 1e-6
    pivot = F.greatest(*(F.abs(F.col("pva")[k].cast("int") - F.col("pvb")[k].cast("int")) for k in range(PIVOTS))) <= apart
    bits = sum((F.bit_count(F.col("fpa")[k].bitwiseXOR(F.col("fpb")[k])) for k in range(BITS // 64)), F.lit(0)) <= apart
    exact = F.size(F.array_intersect("la", "lb")) * (1 + threshold) >= threshold * total - 1e-6
    return both.where(pivot).where(bits).where(exact).select("a", "b")


def _pairs(near: DataFrame) -> DataFrame:
    return near.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()


def _across(placed: DataFrame, crowd: int, threshold: float, level: int) -> DataFrame:
    """Pairs of members of different classes of a posting. A posting beyond ``crowd`` members is cut into blocks: each member
    meets one block after the other, each in its own place."""
    blocks = F.ceil(F.col("m") / crowd).cast("int")
    cell = placed.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    left = placed.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    meet = left.alias("a").join(cell.hint("merge").alias("b"), ["key", "block"])
    return _pairs(meet.where("a.comp < b.comp").where(_may_link(threshold, level)))


def near_duplicates(df: DataFrame, key: str, text: Column, shingle: int = 5, threshold: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """Class of every record that has a near-duplicate or copy: columns ``key``, ``first_id``, ``links``.

    Records are linked when the sets of their ``shingle``-word sequences have a Jaccard similarity of at least
    ``threshold``; classes are the connected components; ``first_id`` is the smallest key of the class and ``links``
    the number of different texts the record's text is seen linked to.

    Exact, for every link decides or implies the class. Equal texts are collapsed first. Candidates share a shingle of
    their prefixes (rarest first, rarity over the whole corpus; a set of n has a prefix of n - ceil(threshold * n) + 1).
    Candidates are discarded by size, by position, and by pivot table: every set has a fingerprint of parity bits,
    whose Hamming distance is at most the size of the symmetric difference; distances to 32 reference fingerprints are
    precomputed, and a pair whose distances to any reference differ by more than a linked pair's can is no link. What
    survives its own fingerprints' distance is verified on the sets.

    A class of texts that all resemble each other may hold a third of all records, so not all pairs of a posting are
    made: first every text is paired with the posting's smallest only, and the links found are joined to provisional
    classes; then only pairs from different classes of a posting are made (a pair inside a class can't change it).
    A posting of several classes and more than ``crowd`` members is first split: a linked pair shares at least
    ceil(threshold * n) shingles, its first k of them within prefixes longer by k - 1, so members meet again only where
    they share a second (third, fourth) one. A pair that needs to share no more than it met by is joined through the
    smallest set, to which both are linked then. What ``LEVELS`` shingles don't split is paired block by block.
    Sets, postings and links are joined by sorted shuffles; only the references (32 * 512 bits) are broadcast.

    Nulls: records with null key or null text take no part. Texts with fewer than ``shingle`` words have no sequences
    and no links, not even to copies. A key that arrives again with the same text is one record. Hashes of sequences
    have 64 bits. An empty table gives an empty result. Columns other than those named are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    rec = df.select(F.col(key).alias("_k"), text.alias("_t")).where("_k IS NOT NULL AND _t IS NOT NULL")
    rec = rec.select("_k", "_t", F.unhex(F.md5(F.lower("_t"))).alias("_d"))
    keyed = rec.groupBy("_d").agg(F.min("_k").alias("_least"), F.max("_k").alias("_most"), F.first("_t").alias("_t"))
    s = F.array_distinct(sequence_hashes(words_of(F.col("_t")), shingle))
    # one number for each distinct text: it is written here, so it stays the same, and is what all joins below carry
    keyed = stored(keyed.select("_d", "_least", "_most", s.alias("s")).where(F.size("s") > 0).withColumn("rep", F.monotonically_increasing_id()))

    flat = keyed.select("rep", F.explode("s").alias("h"))
    common = flat.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    listed = flat.join(common.hint("merge"), "h").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "h")))["h"].alias("l"))
    marks = cut(fingerprints(keyed))
    alone = F.col("n") - F.size("l")
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-6).cast("int") + 1 - alone
    table = with_pivot_table(marks).join(listed.hint("merge"), "rep").withColumn("alone", alone).withColumn("p", prefix)
    table = cut(table.where("p > 0"))  # a set without a posting has no link
    member = table.select("rep", "n", "alone", F.posexplode(F.slice("l", 1, F.col("p"))).alias("at", "key"))
    member = cut(member.select("key", "rep", "n", (F.col("alone") + F.col("at")).alias("pos")))

    links = classes = None
    for level in range(1, LEVELS + 1):
        lead = member.groupBy("key").agg(F.min(F.struct("n", "rep", "pos")).alias("l"), F.count("*").alias("m")).where("m > 1").select("key", "l.*")
        star = member.alias("b").join(lead.hint("merge").alias("a"), "key").where(F.col("a.rep") != F.col("b.rep")).where(_may_link(threshold, level))
        found = cut(_verify(_pairs(star), table, threshold))
        links = found if links is None else links.union(found).distinct()
        classes = cut(connected_components(links, "a", "b", "rep", "comp"))

        placed = member.join(classes.hint("merge"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        mixed = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        placed = cut(placed.join(mixed.select("key", "m").hint("merge"), "key"))
        crowded = placed.where(F.col("m") > crowd) if level < LEVELS else placed.limit(0)
        few = placed.where(F.col("m") <= crowd) if level < LEVELS else placed
        more = cut(_verify(_across(few, crowd, threshold, level), table, threshold))
        if not more.isEmpty():
            links = links.union(more)
            classes = cut(connected_components(links, "a", "b", "rep", "comp"))
        if crowded.isEmpty():
            break
        begin = F.col("pos") - F.col("alone")
        rest = F.slice("l", begin + 2, F.greatest(F.lit(0), F.col("p") + (level - 1) - begin))
        split = crowded.select("key", "rep", "pos").join(table.select("rep", "n", "alone", "p", "l").hint("merge"), "rep")
        split = split.select("key", "rep", "n", "pos", F.posexplode(rest).alias("at", "h"))
        member = cut(split.select(F.xxhash64("key", "h").alias("key"), "rep", "n", (F.col("pos") + 1 + F.col("at")).alias("pos")))

    degree = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    home = keyed.select("_d", "rep", "_least", "_most").join(classes.hint("merge"), "rep", "left").join(degree.hint("merge"), "rep", "left")
    home = home.where("comp IS NOT NULL OR _least < _most").withColumn("comp", F.coalesce("comp", "rep"))
    first = home.groupBy("comp").agg(F.min("_least").alias("first_id"))
    home = home.join(first.hint("merge"), "comp").select("_d", "first_id", F.coalesce("links", F.lit(0)).alias("links"))
    return rec.select("_k", "_d").join(home.hint("merge"), "_d").groupBy(F.col("_k").alias(key)).agg(F.min("first_id").alias("first_id"), F.max("links").alias("links"))
