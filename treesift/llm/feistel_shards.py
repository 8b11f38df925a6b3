"""Sharding by a Feistel permutation over global row numbers, in DataFrame functions only. Law: `rows`.

Rows are numbered 0 to N-1 in the order of (id, text checksum, size). A Feistel network over Z_a x Z_b, the smallest
such rectangle that holds N, permutes the numbers; a value of N or more is walked on through the permutation until it
falls below N. Fewer than a, so than sqrt(N) + 1, values are N or more: where the walk of each ends is computed beforehand,
to whatever length, and sent to all executors as a table. Row number i then has place p(i): its shard is p mod shards and
its slot p div shards, so shards differ by one row at most and slots have no gaps. `place` computes the same from a row
number alone, without any data.

Null texts have no bytes and the checksum of the empty string. Rows repeated in all of id, text and size are
interchangeable; each gets its own place. Null ids come first. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesift.llm.common import checkpointed

N_SHARDS = 24
ROUNDS = 6
SEED = 20_240_601
_MUL = 0x9E3779B1
_MASK = (1 << 32) - 1


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _keys(seed: int) -> list[int]:
    """Round keys of 31 bits from a 64-bit linear congruential sequence."""
    keys, x = [], seed & ((1 << 64) - 1)
    for _ in range(ROUNDS):
        x = (x * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
        keys.append(x >> 33)
    return keys


def _mix(x, key: int):
    """The round function on 32 bits, of a number or an array; every product stays below 2**63, so SQL's bigint computes the same."""
    x = (x ^ key) & _MASK
    x = ((x ^ (x >> 15)) * (_MUL >> 1)) & _MASK
    x = ((x ^ (x >> 13)) * (0x85EBCA6B >> 1)) & _MASK
    return x ^ (x >> 16)


def _network(x, n: int, seed: int):
    """One pass of a number, or an array of them, through the network."""
    a, b = sides(n)
    left, right = x % a, x // a
    for k, key in enumerate(_keys(seed)):
        if k % 2:
            right = (right + _mix(left, key)) % b
        else:
            left = (left + _mix(right, key)) % a
    return left + a * right


def permute(x: int, n: int, seed: int = SEED) -> int:
    """The place of row number x among n; the walk returns to x < n at the latest, so it ends."""
    x = _network(x, n, seed)
    while x >= n:
        x = _network(x, n, seed)
    return x


def exits(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The values from n on, fewer than sqrt(n) + 1, and where their walks end."""
    a, b = sides(n)
    values = np.arange(n, a * b, dtype=np.int64)
    ends = _network(values, n, seed)
    while len(on := np.flatnonzero(ends >= n)):
        ends[on] = _network(ends[on], n, seed)
    return values, ends


def place(row_number: int, n: int, shards: int = N_SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = permute(row_number, n, seed)
    return p % shards, p // shards


def _mix_sql(x: str, key: int) -> str:
    x = f"(({x}) ^ {key}L)"
    x = f"transform(array({x}), v -> ((v ^ shiftright(v, 15)) * {_MUL >> 1}L) & {_MASK}L)"
    x = f"transform({x}, v -> ((v ^ shiftright(v, 13)) * {0x85EBCA6B >> 1}L) & {_MASK}L)"
    return f"transform({x}, v -> v ^ shiftright(v, 16))[0]"


def network_column(column: str, n: int, seed: int = SEED) -> Column:
    """One pass through the network as a Column."""
    a, b = sides(n)
    rounds = f"array(named_struct('l', {column} % {a}L, 'r', {column} div {a}L))"
    for k, key in enumerate(_keys(seed)):
        if k % 2:
            step = f"named_struct('l', s.l, 'r', (s.r + {_mix_sql('s.l', key)}) % {b}L)"
        else:
            step = f"named_struct('l', (s.l + {_mix_sql('s.r', key)}) % {a}L, 'r', s.r)"
        rounds = f"transform({rounds}, s -> {step})"
    return F.expr(f"transform({rounds}, s -> s.l + {a}L * s.r)[0]")


def with_places(df: DataFrame, column: str, n: int, seed: int = SEED) -> DataFrame:
    """df with __p, the place permute(row number in `column`, n)."""
    once = df.withColumn("__once", network_column(column, n, seed))
    values, ends = exits(n, seed)
    if not len(values):
        return once.withColumnRenamed("__once", "__p")
    walks = df.sparkSession.createDataFrame(list(zip(values.tolist(), ends.tolist(), strict=True)), "__value long, __end long")
    done = once.join(F.broadcast(walks), F.col("__once") == F.col("__value"), "left")  # fewer than sqrt(n) + 1 rows
    return done.withColumn("__p", F.coalesce("__end", "__once")).drop("__once", "__value", "__end")


def row_numbers(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with __row, its rank in `order` from 0, and the number of rows.

    Rows are range-partitioned and sorted; monotonically_increasing_id then has the partition and the rank in it. The
    result is checkpointed before partitions are counted, so both uses see the same partitions. Only one row for each
    partition goes through the unpartitioned window.
    """
    sorted_ = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    local = checkpointed(sorted_.withColumn("__mid", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__mid", 33)))
    sizes = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    total = offsets.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    rank = F.col("__mid") - F.shiftleft(F.col("__part"), 33) + F.col("__before")
    return local.join(F.broadcast(offsets.select("__part", "__before")), "__part").withColumn("__row", rank).drop("__mid", "__part", "__before"), int(total)


def feistel_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; only these narrow columns are shuffled."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    narrow = df.select(F.col(f"`{id_col}`"), (F.octet_length(text) + 8).cast("bigint").alias("__size"), F.crc32(text.cast("binary")).alias("__crc"))
    numbered, n = row_numbers(narrow.withColumnsRenamed({id_col: "__id"}), ["__id", "__crc", "__size"])
    placed = with_places(numbered, "__row", max(1, n), seed)
    return placed.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        (F.col("__p") % shards).cast("int").alias("shard"),
        F.expr(f"__p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
