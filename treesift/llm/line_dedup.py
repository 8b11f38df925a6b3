"""Line dedup over a corpus, in DataFrame functions only.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z lower-cased. A key of at least
`min_chars` code points that at least two documents hold loses all its lines except those in the smallest doc_id that
holds it. What is kept comes back as a compressed bitmap for each document that loses lines: words of 64 lines, a bit set
for each line that stays, without the words that keep all their lines. No text is in it, and none is shuffled for it.

Keys are hashed once, to 128 bits, and these narrow rows are checkpointed. The hashes are range-partitioned and sorted by
(hash, document, position); a running window then streams over them and carries the first document of each hash along. A
key that very many lines share would meet in one range, so the heaviest keys of a sample (at most `hot_keys` of them,
which bounds their broadcast) leave that path: their first document comes from a partial aggregate over all rows, which
is exact as well. The sample only decides which path a key takes.

To apply the bitmaps, they are sent to all executors while they have at most BROADCAST_BYTES; beyond that they are joined
by document.

Null and empty texts are one empty line. Repeated rows with one doc_id count as one document: they keep or lose the
same lines, as positions of the same key are judged by doc_id. Rows of a doc_id with different texts are told apart by
a hash of the text. Rows with a null doc_id lose no line and take none from others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesift.llm.common import checkpointed

MIN_CHARS = 10
#: At most so many keys take the aggregate's path; a key needs so many lines in the sample.
HOT_KEYS, HOT_LINES, SAMPLE = 10_000, 8, 0.02
BROADCAST_BYTES = 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\f\r"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased; where all is ASCII, by the faster lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def _lines(c: Column) -> Column:
    return F.split(F.coalesce(c.cast("string"), F.lit("")), "\n", -1)


def _keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, h1, h2, pos) of every line whose key is long enough; positions from 0."""
    line = docs.select("doc", "txt", F.posexplode_outer(_lines(F.col("text"))).alias("pos", "line")).where(F.char_length("line") >= min_chars)
    key = line.select("doc", "txt", "pos", F.btrim("line", F.lit(_BLANK)).alias("line")).where(F.char_length("line") >= min_chars)
    low = key.select("doc", "txt", "pos", ascii_lower(F.col("line")).alias("key"))
    return low.select("doc", "txt", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(m_doc, m_txt, keep) for each document of docs(doc, txt, text) that loses lines; keep is array<struct<word, bits>>, sorted, and lacks the words whose lines all stay."""
    spark = docs.sparkSession
    keyed = checkpointed(_keyed(docs.where("doc is not null"), min_chars))
    heavy = keyed.sample(SAMPLE, seed=7).groupBy("h1", "h2").count().where(F.col("count") >= HOT_LINES).orderBy(F.desc("count"), "h1", "h2").limit(hot_keys).select("h1", "h2")
    heavy = checkpointed(heavy)
    if heavy.isEmpty():
        rows = keyed.withColumn("gone", F.lit(False))
    else:
        firsts = checkpointed(keyed.join(F.broadcast(heavy), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("doc").alias("own")).withColumn("hot", F.lit(True)))
        rows = keyed.join(F.broadcast(firsts), ["h1", "h2"], "left").withColumn("gone", F.col("hot").isNotNull()).where("not gone or doc > own")
        # what a hot key loses is settled here; these rows spread over the ranges by document and position
        rows = rows.select("doc", "txt", "pos", "gone", F.when(F.col("gone"), F.xxhash64("doc", "pos")).otherwise(F.col("h1")).alias("h1"), "h2")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, "gone", "h1", "h2").sortWithinPartitions("gone", "h1", "h2", "doc", "pos")
    stream = Window.partitionBy("gone", "h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dropped = ranged.withColumn("first", F.first("doc", ignorenulls=True).over(stream)).where("gone or doc > first").select("doc", "txt", "pos")
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = dropped.groupBy("doc", "txt", F.expr("int(pos div 64)").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    words = words.withColumnsRenamed({"doc": "m_doc", "txt": "m_txt"})
    return words.groupBy("m_doc", "m_txt").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def _dense(keep: Column, n_lines: Column) -> Column:
    """The bitmap's words with those filled in that keep all lines."""
    held = F.map_from_entries(keep)
    return F.transform(F.sequence(F.lit(0), F.floor(n_lines / 64).cast("int")), lambda w: F.coalesce(held[w], F.lit(-1).cast("bigint")))


def _with_bitmaps(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs(doc, txt, text, ...) with keep, null where no line goes."""
    maps = checkpointed(keep_bitmaps(docs.select("doc", "txt", "text"), min_chars))
    n, words = maps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("keep")), F.lit(0))).first()
    maps = F.broadcast(maps) if 64 * n + 40 * words <= BROADCAST_BYTES else maps
    return docs.join(maps, (F.col("doc") == F.col("m_doc")) & (F.col("txt") == F.col("m_txt")), "left").drop("m_doc", "m_txt")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, n_lines, n_dropped, keep, kept): counts, the bitmap (null: nothing dropped) and the text that stays, one row for each row of df."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(f"`{text_col}`").alias("txt"), F.col(f"`{text_col}`").alias("text"))
    return _applied(_with_bitmaps(docs, min_chars)).select(F.col("doc").alias(id_col), "n_lines", "n_dropped", "keep", "kept")


def _applied(joined: DataFrame) -> DataFrame:
    """joined with n_lines, n_dropped and kept; only texts that lose lines are cut and put together again."""
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    loses = F.col("keep").isNotNull()
    cut = joined.withColumn("ls", F.when(loses, _lines(F.col("text"))))
    cut = cut.withColumn("dense", F.when(loses, _dense(F.col("keep"), F.size("ls"))))
    # lines and words are each used twice here, so the optimiser keeps them as columns and doesn't compute them again for each line
    return cut.select(
        *joined.columns,
        F.when(loses, F.size("ls")).otherwise(F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.when(loses, F.aggregate("keep", F.lit(0).cast("bigint"), lambda a, w: a + 64 - F.bit_count(w["bits"]))).otherwise(0).cast("bigint").alias("n_dropped"),
        F.when(loses, F.expr("array_join(filter(ls, (x, i) -> getbit(dense[int(i div 64)], i % 64) = 1), '\\n')")).otherwise(whole).alias("kept"),
    )


def with_kept_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """df with its text column replaced by the text that stays; all its other columns as they are."""
    own = df.select(*[F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(df.columns)], F.col(f"`{id_col}`").alias("doc"), F.xxhash64(f"`{text_col}`").alias("txt"), F.col(f"`{text_col}`").alias("text"))
    done = _applied(_with_bitmaps(own, min_chars))
    return done.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"__c{k}").alias(c) for k, c in enumerate(df.columns)])


def oracle_sql() -> str:
    upper, lower = _UPPER, _LOWER
    trim = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH cut AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {trim}), '{upper}', '{lower}') AS key FROM cut
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key
), judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first, FALSE) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
