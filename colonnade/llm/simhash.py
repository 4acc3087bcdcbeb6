"""SimHash near-duplicates: 64-bit fingerprints, links of at most three differing bits, components.

Links come by multi-index hashing. A fingerprint has two halves of 32 bits; of three differing bits at most one lies in
one of the halves. A table holds every fingerprint under both halves. Each fingerprint looks up, for either half, the
half itself and its neighbours at one bit, and the whole fingerprints that it meets are compared. Of two halves that
differ in one bit, the one without that bit looks up the other, so only zero bits are flipped.

Equal fingerprints are one entry, so copies make no pairs. A table key under which very many different fingerprints stand
(texts that share most of their words) is refined: the fingerprints that meet there differ in at most three bits of
the other half, hence in at most one bit of one of its two quarters, which is looked up in the same way. A refined key
holds at most 2^16 fingerprints, and a fingerprint has at most 43,744 others within three bits, so links and comparisons
grow with the number of different fingerprints.

Joins of fingerprints are merge joins by hint: a file of a few MB of them is a large table of keys, which Spark would
otherwise send whole through the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.components import components
from colonnade.llm.runtime import ship, stored, text_of

RUN, SEED, DISTANCE = 3, 42, 3
CROWDED = 1000  # fingerprints under a table key beyond which it is refined
PIECE = 1 << 20  # bytes of a text that are split into words at once
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, the lowest first."""
    sums = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i:i + (1 << 15)]
        sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sums


def _hashes(words: list[bytes]) -> np.ndarray:
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.fromiter([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[:len(words) - RUN + 1].tolist(), ends[RUN - 1:].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes) -> int:
    """The bits that more than half of the shingles' hashes have; 0 without words.

    Shingles are all runs of three words, lower-cased in A-Z; fewer words are one shingle. A long text is split piece by
    piece, each with the last two words of the one before.
    """
    sums, total, last, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        stop = SPACE.search(text, at + PIECE)
        end = stop.start() if stop else len(text)
        words = last + text[at:end].lower().split()
        if len(words) >= RUN:
            hashes = _hashes(words)
            sums, total = sums + _bit_sums(hashes), total + len(hashes)
            words = words[1 - RUN:]
        last, at = words, end
    if not total and last:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED)
    return int(np.packbits(2 * sums > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of every row, the print as a signed 64-bit number."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1).cast(pa.large_binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, print long")


def _part(column: str, number: Column, width: int) -> Column:
    """A segment of `width` bits, the 0th the highest, with its number in the bits above."""
    shift = (64 // width - 1 - number) * width
    return F.call_function("shiftright", F.col(column), shift.cast("int")).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(number.cast("long") * (1 << width))


def _ball(key: Column, width: int, only_zeros: bool) -> Column:
    """The key and its neighbours at one of the lowest `width` bits; only_zeros: those with one bit more."""
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    free = key.bitwiseAND(flip) == 0 if only_zeros else F.lit(True)
    return F.when(F.col("bit") < 0, key).when(free, key.bitwiseXOR(flip))


def _bits(width: int) -> Column:
    return F.explode(F.sequence(F.lit(-1), F.lit(width - 1)))


def _close(pairs: DataFrame) -> DataFrame:
    near = pairs.filter((F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= DISTANCE))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """The pairs (a, b) of different fingerprints, column `print` without repeats, that differ in at most three bits."""
    halves = F.explode(F.array(F.lit(0), F.lit(1)))
    entries = prints.select(F.col("print").alias("y"), halves.alias("half")).select("y", _part("y", F.col("half"), 32).alias("key"))
    probes = (prints.select(F.col("print").alias("x"), halves.alias("half")).select("x", "half", _bits(32).alias("bit"))
              .select("x", "half", _ball(_part("x", F.col("half"), 32), 32, True).alias("key")).filter("key IS NOT NULL"))
    hot = stored(entries.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select("key"), "crowded")
    if not hot.take(1):
        return _close(probes.join(entries.hint("merge"), "key")).distinct()
    found = _close(probes.join(entries.join(hot, "key", "left_anti").hint("merge"), "key"))
    # in the other half x and y differ in at most one bit of one quarter: quarters 2 and 3 where half 0 is the key
    quarter = F.explode(F.when(F.col("half") == 0, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(0), F.lit(1))))
    inner = entries.join(hot, "key", "left_semi").withColumn("half", F.call_function("shiftright", F.col("key"), F.lit(32)))
    inner = inner.select("key", "y", quarter.alias("quarter")).select("key", "y", _part("y", F.col("quarter"), 16).alias("sub"))
    outer = probes.join(hot, "key", "left_semi").select("key", "x", quarter.alias("quarter")).select("key", "x", "quarter", _bits(16).alias("bit"))
    outer = outer.select("key", "x", _ball(_part("x", F.col("quarter"), 16), 16, False).alias("sub"))
    return found.unionByName(_close(outer.join(inner.hint("merge"), ["key", "sub"]))).distinct()


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest doc_id among the rows whose fingerprints are connected by links, itself included; null
    if none of them has an id. Texts without words, null ones too, have fingerprint zero and link like any other. Rows
    that share a doc_id stay rows of their own. Extra columns are not read; an empty table gives no rows.
    """
    own = stored(fingerprints(docs), "prints")
    entries = stored(own.groupBy("print").agg(F.min("doc_id").alias("least")), "entries")
    roots = components(stored(links(entries.select("print"), crowded), "links"), "a", "b")
    placed = entries.join(roots.hint("merge"), F.col("print") == F.col("vertex"), "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")).hint("merge"), "root").select("print", "component_id")
    return own.join(named.hint("merge"), "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
