"""Near copies by exact Jaccard similarity of word shingles: two texts are linked if it is `threshold` or more.

A text's words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; its set is the upper 62 bits of the XXH64 of its 5-word shingles
(fewer words: all of them), empty for a text without words. Equal sets are one node, so copies take part in the search once.

Candidates that the caller proposes (those of fingerprints, see simhash) come first. What these miss is found by prefixes:
in any one order of all hashes, two sets of similarity t share one of the first n - ceil(t n) + 1 hashes of each, n being
the set's own size. So every linked pair meets under a key, and none is missed. The order is that of the hashes, but those
frequent in a sample come last: a passage that many texts hold is then in the prefix of few.

A pair is tested by bounds that no similar pair fails before it is verified on the whole sets: the sizes, then parity
bitmaps, of which no more bits differ than hashes do. A bitmap of 512 bits is held of each set; of a larger set one with
a bit for each hash or more as well, as sets that fill a small one can't be told apart. Two sizes of bitmaps are compared
by folding the larger.

Components need not have all links. Each set is first compared with two leaders of each of a few of its keys, which is linear
in the keys and joins most of a large group: the set of which the largest share of the keys is in other sets too (an
original among edited copies), and one drawn anew for each key. Then all pairs that meet and aren't yet in one
component are compared; of a key's sets, those of its most common component aren't compared with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesift.llm.common import checkpointed, chunks, id_field, ship
from treesift.llm.components import components
from treesift.llm.shingles import fingerprint, shingle_hashes

WIDTH, THRESHOLD, SEED = 5, 0.8, 42
#: 64-bit words of every set's parity bitmap.
LANES = 8
#: Rows of the sample, how often a hash must be in it to come last, and how many do at most.
SAMPLE_ROWS, FREQUENT, MOST_FREQUENT = 5_000, 5, 100_000
#: Keys of a set that are compared with their leaders.
LED = 16
#: Rows and bytes up to which a table is sent to all executors.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
#: Added to a frequent hash, which puts it behind all others.
_LAST = 1 << 62


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles, ascending, each once."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(h >> np.uint64(2)) for h in shingle_hashes(text, WIDTH, SEED))]))


def set_id(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def prefix(hashes: np.ndarray, frequent: np.ndarray, threshold: float) -> np.ndarray:
    """The hashes one of which each similar set has in its own prefix too, ascending; `frequent` is sorted, and its hashes are raised by _LAST."""
    n = len(hashes)
    if len(frequent) and n:
        last = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last] + np.uint64(_LAST)])
    return hashes[: n - int(np.ceil(threshold * n - 1e-9)) + 1]


def bitmap(hashes: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """For each of 64 * lanes residues, whether an odd number of hashes has it."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * lanes), minlength=64 * lanes) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def wide_bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bitmap whose lanes, a power of two, have a bit for each hash; empty where LANES are enough."""
    lanes = 1 << max(0, len(hashes) - 1).bit_length() >> 6
    return bitmap(hashes, lanes) if lanes > LANES else np.zeros(0, np.int64)


def _lists(made: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*made, np.zeros(0, np.uint64)]).view(np.int64)))


def whole_sets(texts: DataFrame) -> DataFrame:
    """(sid, hashes) of every row of texts(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treesift.llm.near_copies import _lists, set_id, shingle_set

        for b in chunks(batches, "text"):
            made = list(map(shingle_set, b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(set_id, made), np.uint64, len(made)).view(np.int64)), _lists(made)], names=["sid", "hashes"])

    return texts.select("text").mapInArrow(run, "sid bigint, hashes array<bigint>")


def sketches(texts: DataFrame, frequent: np.ndarray, threshold: float) -> DataFrame:
    """(doc, txt, sid, fp, n, bits, wide, keys) of every row of texts(doc, txt, text); fp is the set's fingerprint."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treesift.llm.near_copies import _lists, bitmap, prefix, set_id, shingle_set, wide_bitmap
        from treesift.llm.shingles import fingerprint

        for b in chunks(batches, "text"):
            ids, fps, sizes, bits, wide, keys = [], [], [], [], [], []
            for t in b.column(2).to_pylist():
                own = shingle_set(t)
                ids.append(set_id(own))
                fps.append(fingerprint([own << np.uint64(2)]))
                sizes.append(len(own))
                bits.append(bitmap(own).view(np.uint64))
                wide.append(wide_bitmap(own).view(np.uint64))
                keys.append(prefix(own, sent.value, threshold))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, fps)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *signed, pa.array(sizes, pa.int32()), *map(_lists, (bits, wide, keys))], names=["doc", "txt", "sid", "fp", "n", "bits", "wide", "keys"])

    return texts.mapInArrow(run, f"doc {id_field(texts, 'doc')}, txt bigint, sid bigint, fp bigint, n int, bits array<bigint>, wide array<bigint>, keys array<bigint>")


def frequent_hashes(texts: DataFrame) -> np.ndarray:
    """Hashes that are frequent in a sample, ascending; which these are changes the cost, not the result."""
    rows = texts.count()
    part = texts.sample(fraction=min(1.0, SAMPLE_ROWS / max(1, rows)), seed=7)
    counts = whole_sets(part).select(F.explode("hashes").alias("h")).groupBy("h").count().where(f"count >= {FREQUENT}")
    found = counts.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).collect()  # MOST_FREQUENT rows
    return np.sort(np.array([r.h for r in found], np.int64).view(np.uint64))


def _differ_little(differ: Column, threshold: float) -> Column:
    """Whether sets of n_a and n_b hashes can be similar if at least `differ` hashes are in one of them only."""
    return differ * (1 + threshold) <= (F.col("n_a") + F.col("n_b")) * (1 - threshold) + 1e-9


def may_match(threshold: float) -> Column:
    """Whether sets with sizes n_a, n_b and bitmaps bits_a, bits_b, wide_a, wide_b can be similar enough."""
    differ = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(LANES)), F.lit(0))
    sizes = (F.col("n_a") >= F.col("n_b") * threshold - 1e-9) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-9)
    # sizes within 0.5 of each other differ by one doubling of lanes at most
    fold = "if(size({0}) > size({1}), {0}[i] ^ {0}[i + size({1})], {0}[i])"
    folded = f"aggregate(sequence(0, least(size(wide_a), size(wide_b)) - 1), 0, (n, i) -> n + int(bit_count({fold.format('wide_a', 'wide_b')} ^ {fold.format('wide_b', 'wide_a')})))"
    comparable = "size(wide_a) > 0 and size(wide_b) > 0 and size(wide_a) <= 2 * size(wide_b) and size(wide_b) <= 2 * size(wide_a)"
    wide = F.expr(f"case when {comparable} then {folded} else 0 end")
    return sizes & _differ_little(differ, threshold) & _differ_little(wide, threshold)


def _side(df: DataFrame, s: str, names: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{s}") for c in names])


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) of similar sets. Texts are read of the sets' first rows only."""
    pairs = checkpointed(pairs)
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("u").alias("e_sid")).unionByName(pairs.select(F.col("v").alias("e_sid"))).distinct()
    reps = checkpointed(sets.join(ends, F.col("sid") == F.col("e_sid"), "left_semi").select(F.col("rep.doc").alias("r_doc"), F.col("rep.txt").alias("r_txt"), "n"))
    n, hashes = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    reps = F.broadcast(reps) if n <= BROADCAST_ROWS else reps
    found = texts.join(reps, (F.col("doc") == F.col("r_doc")) & (F.col("txt") == F.col("r_txt")), "left_semi")
    whole = checkpointed(whole_sets(found).dropDuplicates(["sid"]))
    whole = F.broadcast(whole) if 8 * hashes <= BROADCAST_BYTES else whole
    both = pairs.join(_side(whole, "a", ("sid", "hashes")), F.col("u") == F.col("sid_a")).join(_side(whole, "b", ("sid", "hashes")), F.col("v") == F.col("sid_b"))
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return checkpointed(both.where(shared >= (F.size("hashes_a") + F.size("hashes_b") - shared) * threshold - 1e-9).select("u", "v"))


def linked(sets: DataFrame, rows: DataFrame, texts: DataFrame, proposed: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the sets of more than one to a component, without the components' smallest nodes.

    Tables that others are joined with by key are checkpointed first: then both sides of the join are plain exchanges, of
    which Spark splits a key's that many sets have.
    """
    keyed = checkpointed(rows.groupBy("sid").agg(F.first("keys").alias("keys"))).select("sid", F.explode("keys").alias("key"))
    shared = checkpointed(keyed.groupBy("key").count().where("count > 1").select(F.col("key").alias("s_key")))
    met = checkpointed(keyed.join(shared, F.col("key") == F.col("s_key")).select("key", "sid"))

    own = Window.partitionBy("sid")
    placed = met.join(sets.select(F.col("sid").alias("n_sid"), "n"), F.col("sid") == F.col("n_sid")).withColumn("place", F.row_number().over(own.orderBy("key"))).withColumn("share", F.count(F.lit(1)).over(own) / F.col("n"))
    few = checkpointed(placed.where(f"place <= {LED}").select("key", "sid", "share"))
    drawn, central = F.min(F.struct(F.xxhash64("key", "sid"), "sid")), F.max(F.struct("share", "sid"))
    leads = checkpointed(few.groupBy("key").agg(F.array(drawn["sid"], central["sid"]).alias("leads")).select(F.col("key").alias("l_key"), "leads"))
    led = few.join(leads, F.col("key") == F.col("l_key")).select("sid", F.explode(F.array_distinct("leads")).alias("lead")).where("sid != lead").select(F.least("sid", "lead").alias("u"), F.greatest("sid", "lead").alias("v"))
    tried = led.unionByName(proposed.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()
    known = ("sid", "n", "bits", "wide")
    near = tried.join(_side(sets, "a", known), F.col("u") == F.col("sid_a")).join(_side(sets, "b", known), (F.col("v") == F.col("sid_b")) & may_match(threshold)).select("u", "v")
    edges = verified(near, sets, texts, threshold)

    first = components(edges)
    named = met.join(first, F.col("sid") == F.col("node"), "left").select("key", "sid", F.coalesce("component", "sid").alias("of"))
    by_key = named.groupBy("key", "of").count().groupBy("key").agg(F.max(F.struct("count", "of")).alias("m"), F.count(F.lit(1)).alias("n_of")).where("n_of > 1")
    by_key = checkpointed(by_key.select(F.col("key").alias("m_key"), F.col("m.of").alias("major")))
    mixed = named.join(by_key, F.col("key") == F.col("m_key")).select("key", F.col("sid").alias("s"), "of", "major")
    mixed = checkpointed(mixed.join(sets.select(*known), F.col("s") == F.col("sid")).select("key", "of", "major", *known))
    a, b = _side(mixed.where("of != major"), "a", ("key", "of", *known)), _side(mixed, "b", ("key", "of", *known))
    # the tests are part of the join: what fails them is never a row
    across = a.join(b, (F.col("key_a") == F.col("key_b")) & (F.col("of_a") != F.col("of_b")) & may_match(threshold))
    more = verified(across.select(F.least("sid_a", "sid_b").alias("u"), F.greatest("sid_a", "sid_b").alias("v")).distinct(), sets, texts, threshold)
    return first if more.isEmpty() else components(edges.unionByName(more))


def near_copies(df: DataFrame, propose: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc, txt, component_id, component_txt) of every row: its id, the hash of its text, and those of the component's first row, by id and hash.

    `propose` gets the distinct sets (sid, fp, ...) and returns pairs (u, v) of them to verify first.
    """
    ship(df.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    texts = df.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("txt"), text.alias("text"))
    rows = checkpointed(sketches(texts, frequent_hashes(texts), threshold))
    sets = checkpointed(rows.groupBy("sid").agg(F.min(F.struct("doc", "txt")).alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide")))
    named = linked(sets, rows, texts, propose(sets), threshold)
    grouped = sets.join(named, F.col("sid") == F.col("node"), "left").select("sid", "rep", F.coalesce("component", "sid").alias("of"))
    least = grouped.groupBy("of").agg(F.min("rep").alias("least")).withColumnRenamed("of", "l_of")
    by_set = checkpointed(grouped.join(least, F.col("of") == F.col("l_of")).select(F.col("sid").alias("k"), "least"))
    return rows.join(by_set, F.col("sid") == F.col("k")).select("doc", "txt", F.col("least.doc").alias("component_id"), F.col("least.txt").alias("component_txt"))
