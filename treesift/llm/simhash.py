"""SimHash near-dedup: 64-bit fingerprints, linked at `radius` or fewer differing bits by the generalised pigeonhole principle.

Fingerprint: the text with A-Z lower-cased, its words `[^\\x20\\x09-\\x0D]+`, its 3-word shingles with repeats, joined by a
space (fewer words: all of them), XXH64 with seed 42 of each; a bit is set if it is set in over half the hashes. A text
without words, or null, has fingerprint zero and is linked like any other.

Search works on distinct fingerprints. Bits are grouped into m partitions, correlated bits together, from the agreement
counts of all fingerprints. If the thresholds T of the partitions sum to radius - m + 1, a pair within the radius differs
in at most T[i] bits of some partition i, so T is free to be uneven: a dynamic program allots it (-1: not probed) to
minimise the estimated candidates and probes, and m is chosen by the same cost. An exact key of each partition indexes
a fingerprint, keys within T[i] bits probe, and the join verifies the whole distance.

A key under which many fingerprints meet would cost the square of their number. The fingerprints of such keys leave
that path: they are linked through balls instead. If two lie within 2 bits, they share a point within 1 bit of both; if
3 bits apart, there is a point within 1 bit of one and 2 of the other. All members of one point's inner ball are truly
linked, and so is each member of its outer ball to them, so a star around the smallest member holds all links' components
with a number of rows that is linear in the fingerprints. Radii other than 3 have no such path and keep all keys.

The component of a document is the smallest doc_id it can reach. Rows that share a doc_id are separate documents with
the same name. Null ids are kept, and never name a component unless all its ids are null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm import near_copies, shingles
from treesift.llm.common import checkpointed, chunks, id_field, ship
from treesift.llm.components import components

BITS, RADIUS, WIDTH, SEED = 64, 3, 3, 42
#: Keys whose index rows times probes are over the square of this are left to the balls.
BUCKET = 128
#: Rows that cost as much as one candidate.
PROBE_COST = 1.0


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, in bounded steps."""
    return shingles.fingerprint(shingles.shingle_hashes(text, WIDTH, SEED))


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, fp) of every row; fp as a signed 64-bit number."""
    ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treesift.llm.simhash import fingerprint

        for b in chunks(batches, "text"):
            fps = np.fromiter(map(fingerprint, b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc", "fp"])

    return source.mapInArrow(run, f"doc {id_field(df, id_col)}, fp bigint")


def bit_statistics(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """How often bits i and j are both set, over all fingerprints (64 x 64), and the number of fingerprints."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            fps = b.column(0).to_numpy().astype("<i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(fps)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,097 rows
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r.cell] = r.n
    return flat[:-1].reshape(BITS, BITS), int(flat[-1])


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of about 64 / m bits, each grown from a free bit by the free bits that correlate most with it."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, parts = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        part = [max(free, key=lambda b: corr[b, free].max())] if len(free) > 1 else list(free)
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: corr[b, part].sum()))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def masks(parts: Sequence[Sequence[int]]) -> list[int]:
    return [_signed(sum(1 << b for b in part)) for part in parts]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def estimate(pairs: float, bits: Sequence[int], p: np.ndarray, most: int) -> list[float]:
    """Estimated candidates at thresholds 0 to most, from the pairs that agree on the whole partition: differing bits multiply them by the odds that a bit differs."""
    poly = [1.0] + [0.0] * most
    for b in bits:
        agree = max(p[b] ** 2 + (1 - p[b]) ** 2, 1e-9)
        odds = (1 - agree) / agree
        for t in range(most, 0, -1):
            poly[t] += poly[t - 1] * odds
    return list(np.cumsum(poly) * pairs)


def probes(width: int, threshold: int) -> int:
    return sum(_choose(width, t) for t in range(threshold + 1))


def _choose(n: int, k: int) -> int:
    return len(list(combinations(range(n), k)))


def allot(costs: Sequence[Sequence[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, -1 or more for each partition, that sum to `total` at the least cost; costs[i][t + 1] is that of threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, len(own) - 1):
                now = (cost + own[t + 1], [*chosen, t])
                if spent + t not in step or now[0] < step[spent + t][0]:
                    step[spent + t] = now
        best = step
    return best[total]


def plan_partitions(distinct: DataFrame, radius: int = RADIUS) -> list[tuple[int, int, list[int]]]:
    """(mask, threshold, flips) of each partition to probe; flips are the masks to XOR for all keys within the threshold."""
    both, n = bit_statistics(distinct)
    p = np.diag(both) / max(1, n)
    options = {m: group_bits(both, n, m) for m in range(2, radius + 2)}
    every = [(m, k, mask) for m, parts in options.items() for k, mask in enumerate(masks(parts))]
    keyed = distinct.select(F.explode(F.array(*[F.struct(F.lit(f"{m}/{k}").alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for m, k, mask in every])).alias("x")).select("x.*")
    sums = keyed.groupBy("part", "key").count().groupBy("part").agg((F.sum(F.col("count").cast("double") * (F.col("count") - 1)) / 2).alias("pairs")).collect()  # a row for each partition
    pairs = {r.part: r.pairs for r in sums}
    best: tuple[float, list[int], int] | None = None
    for m, parts in options.items():
        most, costs = min(2, radius), []
        for k, part in enumerate(parts):
            guess = estimate(pairs.get(f"{m}/{k}", 0.0), part, p, most)
            costs.append([0.0] + [guess[t] + PROBE_COST * n * (probes(len(part), t) + (t > 0)) for t in range(most + 1)])
        try:
            cost, chosen = allot(costs, radius - m + 1)
        except KeyError:
            continue
        if best is None or cost < best[0]:
            best = (cost, chosen, m)
    _, chosen, m = best
    out = []
    for part, mask, t in zip(options[m], masks(options[m]), chosen, strict=True):
        if t >= 0:
            out.append((mask, t, [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(part, k)]))
    return out


def _balls(hot: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all of hot(fp) within 3 bits, in stars; see above."""
    one = [_signed(1 << b) for b in range(BITS)]
    flips1 = "array(0L, " + ", ".join(f"{x}L" if x > -(1 << 63) else "shiftleft(1L, 63)" for x in one) + ")"
    inner = hot.select("fp", F.explode_outer(F.expr(f"transform({flips1}, f -> fp ^ f)")).alias("point"))
    lead = checkpointed(inner.groupBy("point").agg(F.min("fp").alias("lead")))
    near = inner.join(lead, "point").where("fp != lead").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
    twice = F.expr("flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> fp ^ shiftleft(1L, i) ^ shiftleft(1L, j))))")
    outer = hot.select("fp", F.explode_outer(twice).alias("point"))
    far = outer.join(lead, "point").where("fp != lead").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
    return near.unionByName(far).distinct()


def linked(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between fingerprints of distinct(fp) that give the components of all links within `radius` bits."""
    parts = plan_partitions(distinct, radius)
    rows = []
    for k, (mask, _, flips) in enumerate(parts):
        key = f"(fp & {_literal(mask)})"
        flipped = ", ".join(_literal(f) for f in flips)
        rows.append(distinct.select("fp", F.lit(k).alias("part"), F.explode(F.expr(f"transform(array({flipped}), f -> named_struct('key', {key} ^ f, 'exact', f = 0L))")).alias("x")).select("fp", "part", "x.key", "x.exact"))
    keyed = rows[0]
    for r in rows[1:]:
        keyed = keyed.unionByName(r)
    sizes = keyed.groupBy("part", "key").agg(F.sum(F.col("exact").cast("long")).alias("n_exact"), F.count(F.lit(1)).alias("n_all")).where("n_exact > 0 and n_all > 1")
    is_hot = F.col("n_exact") * F.col("n_all") > bucket * bucket if radius == RADIUS else F.lit(False)
    sizes = checkpointed(sizes.select(F.col("part").alias("s_part"), F.col("key").alias("s_key"), is_hot.alias("hot")))
    of_key = (F.col("part") == F.col("s_part")) & (F.col("key") == F.col("s_key"))
    n_hot = sizes.where("hot").count()
    if 0 < n_hot <= near_copies.BROADCAST_ROWS:  # the rows of hot keys are marked where they are; only those of other keys meet by key
        marked = keyed.join(F.broadcast(sizes.where("hot").select("s_part", "s_key", "hot")), of_key, "left")
        meet = marked.where("hot is null").drop("s_part", "s_key", "hot").join(sizes.where("not hot"), of_key)
        met = checkpointed(marked.where("hot").select("fp", "part", "key", "exact", "hot").unionByName(meet.select("fp", "part", "key", "exact", "hot")))
    else:  # more hot keys than can be sent: a large one is split by Spark, as the join is all that this exchange is for
        met = checkpointed(keyed.join(sizes, of_key).select("fp", "part", "key", "exact", "hot"))
    cold = met.where("not hot")
    a, b = cold.select(F.col("fp").alias("a"), "part", "key"), cold.where("exact").select(F.col("fp").alias("b"), F.col("part").alias("b_part"), F.col("key").alias("b_key"))
    # the distance is part of the join: what fails it is never a row
    near = (F.col("part") == F.col("b_part")) & (F.col("key") == F.col("b_key")) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    edges = a.join(b, near).select("a", "b")
    hot = checkpointed(met.where("hot").select("fp").distinct())
    if not hot.isEmpty():
        edges = edges.unionByName(_balls(hot))
    return edges


def _literal(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "shiftleft(1L, 63)"


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of every row. Copies share a fingerprint and take part in the search once."""
    docs = checkpointed(fingerprints(df, id_col, text_col))
    distinct = checkpointed(docs.groupBy("fp").agg(F.min("doc").alias("rep")))
    edges = linked(distinct.select("fp"), radius)
    named = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # components of fingerprints; their name is the smallest doc_id of any of their fingerprints
    grouped = distinct.join(named, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))
    least = grouped.groupBy("group").agg(F.min("rep").alias("component_id")).withColumnRenamed("group", "of")
    by_fp = grouped.join(least, F.col("group") == F.col("of")).select(F.col("fp").alias("k"), "component_id")
    return docs.join(by_fp, F.col("fp") == F.col("k")).select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def proposed(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (u, v) of sets(sid, fp) that connect all whose fingerprints are equal or linked within `radius` bits."""
    distinct = checkpointed(sets.groupBy("fp").agg(F.min("sid").alias("lead")))
    same = sets.join(distinct.withColumnRenamed("fp", "d_fp"), F.col("fp") == F.col("d_fp")).where("sid != lead").select(F.col("sid").alias("u"), F.col("lead").alias("v"))
    a, b = (distinct.select(F.col("fp").alias(f"fp_{s}"), F.col("lead").alias(s)) for s in "uv")
    far = linked(distinct.select("fp"), radius).join(a, F.col("a") == F.col("fp_u")).join(b, F.col("b") == F.col("fp_v")).select("u", "v")
    return same.unionByName(far)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = near_copies.THRESHOLD) -> DataFrame:
    """One row of each component, all columns as they are: that with the smallest id, of several such that whose text has the smallest hash, of rows equal in both any one.

    Rows without an id stay. A link is a Jaccard similarity of 5-word shingles of `threshold` or more. Pairs that fingerprints
    of these shingles link within RADIUS bits are proposed and verified; near_copies finds the pairs whose fingerprints
    differ in more bits.
    """
    found = checkpointed(near_copies.near_copies(df.where(F.col(f"`{id_col}`").isNotNull()), proposed, id_col, text_col, threshold))
    first = (F.col("doc") == F.col("component_id")) & (F.col("txt") == F.col("component_txt"))
    marked = df.withColumn("__txt", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    gone = checkpointed(found.where(~first).select(F.col("doc").alias("__gone"), F.col("txt").alias("__gone_txt")).distinct())
    gone = F.broadcast(gone) if gone.count() <= near_copies.BROADCAST_ROWS else gone
    stay = marked.join(gone, (F.col(f"`{id_col}`") == F.col("__gone")) & (F.col("__txt") == F.col("__gone_txt")), "left_anti")
    again = checkpointed(found.where(first).groupBy("doc", "txt").count().where("count > 1").select(F.col("doc").alias("__doc"), F.col("txt").alias("__of")))
    if not again.isEmpty():
        repeated = (F.col(f"`{id_col}`") == F.col("__doc")) & (F.col("__txt") == F.col("__of"))
        stay = stay.join(again, repeated, "left_anti").unionByName(stay.join(again, repeated, "left_semi").dropDuplicates([id_col, "__txt"]))
    return stay.drop("__txt")
