"""Benchmark decontamination: containment search for short test items in long documents, in DataFrame functions only.

A text's words are `[^\\x20\\x09-\\x0D]+` of its lower-cased form; its shingles are its 5-word windows as a set. A document
holds an item if at least `threshold` of the item's shingles are among the document's.

Sketches are MinHash values in bottom-k form, sized by the partition of set size that an item falls in: of an item with
n shingles, n - ceil(threshold * n) + 1 of the smallest hashes. A document that holds enough of the item has at least
one of these, whichever shingles it lacks, so the search misses nothing; banded signatures of whole long documents can't
promise that (README). A document is probed only by items whose need its length can meet. Candidate documents are then
verified by exact containment: their windows, with their strings, meet the items' shingles, and equal strings are counted
for each document and item, each once.

Documents' hashes are probed as they are generated, against the sketch as a broadcast table while it has at most
BROADCAST_ROWS rows; beyond that both sides are shuffled by hash. The items' shingles go to the candidates' windows by
broadcast while the items' texts have at most BROADCAST_BYTES, else by hash as well. No join is by item, so one that
very many documents hold is spread over its shingles, and counts are summed before they are shuffled. A document's hashes
take eight bytes a word; where strings are made, long documents are cut into pieces of PIECE words that overlap by a window.

Items with fewer than five words are one shingle of all their words, sought among the document windows of that length.
Null or wordless texts hold nothing and are held by nothing. Items are told apart by their words, so repeated items, and
several texts under one id, each count by themselves; of rows that share both ids one result row stays, with the most
shingles shared. Rows without an id are named by no result row. Empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import checkpointed

WIDTH, THRESHOLD = 5, 0.8
#: At 24 bytes a row this is a table of 12 MB.
BROADCAST_ROWS = 500_000
#: Items' texts of so many bytes make shingle strings of at most WIDTH times as many.
BROADCAST_BYTES = 8 << 20
#: Words of one piece of a document.
PIECE = 1 << 16


def words_of(c: Column) -> Column:
    """The words of a text, lower-cased; one empty word for null or a text without words."""
    low = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return F.split(F.btrim(low, F.lit(" \t\n\x0b\f\r")), "[\\x20\\x09-\\x0D]+", -1)


def _windows(words: str, width: int, make: str, kind: str) -> str:
    """SQL for the array of `make`, an expression over the words {w} of each window of `width`, named {k} where it isn't WIDTH; empty if there are too few words."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(width))
    named = "" if width == WIDTH else f"{width}, "  # windows of other widths don't share hashes
    return f"if(size({words}) >= {width} and {words}[0] != '', transform(sequence(0, size({words}) - {width}), i -> {make.format(w=parts, k=named)}), cast(array() as array<{kind}>))"


def _hashes(words: str, width: int) -> str:
    return _windows(words, width, "xxhash64({k}{w})", "bigint")


def _shingles(words: str, width: int) -> str:
    return _windows(words, width, "struct(xxhash64({k}{w}) as hash, concat_ws(' ', {w}) as shingle)", "struct<hash: bigint, shingle: string>")


def _pieces(docs: DataFrame) -> DataFrame:
    """docs(..., text) with the words of each piece, w, in place of text."""
    others = [c for c in docs.columns if c != "text"]
    cut = docs.select(*others, words_of(F.col("text")).alias("all"))
    parts = F.expr(f"if(size(all) <= {PIECE}, array(all), transform(sequence(0, size(all) - 1, {PIECE}), a -> slice(all, a + 1, {PIECE + WIDTH - 1})))")
    return cut.select(*others, F.explode_outer(parts).alias("w"))


def _all(make: Callable[[str, int], str], widths: list[int]) -> str:
    """SQL for the windows of all widths in one array."""
    every = [make("w", k) for k in widths or [WIDTH]]
    return every[0] if len(every) == 1 else f"concat({', '.join(every)})"


def item_units(items: DataFrame, threshold: float) -> DataFrame:
    """(u, width, n, need, shingles) of each distinct text of items(text) that has words; u names it by its words."""
    units = items.select(words_of(F.col("text")).alias("w")).where("w[0] != ''").select(F.md5(F.array_join("w", " ")).alias("u"), "w").dropDuplicates(["u"])
    sized = units.withColumn("width", F.least(F.lit(WIDTH), F.size("w")))
    sets = [f"array_distinct({_shingles('w', k)})" for k in range(1, WIDTH + 1)]
    made = sized.withColumn("shingles", F.expr("case width " + " ".join(f"when {k} then {e}" for k, e in enumerate(sets, 1)) + " end")).withColumn("n", F.size("shingles"))
    return made.select("u", "width", "n", F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int").alias("need"), "shingles")


def sketches(units: DataFrame) -> DataFrame:
    """(u, need, hash) for the hashes in each item's sketch; a document with fewer than `need` shingles can't hold it."""
    smallest = F.slice(F.array_sort(F.expr("transform(shingles, s -> s.hash)")), F.lit(1), F.col("n") - F.col("need") + 1)
    return units.select("u", "need", F.explode(smallest).alias("hash"))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _held(docs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """(doc, txt, u, n_shared, n): documents of docs(doc, txt, text), named by id and hash of the text, that hold enough of an item."""
    sketch = checkpointed(sketches(units))
    widths = [r.width for r in units.select("width").distinct().orderBy("width").collect()]  # 1 to 5
    probe = _sent(sketch.select("u", "need", F.col("hash").alias("i_hash")), sketch.count())
    hashes = docs.select("doc", "txt", words_of(F.col("text")).alias("w")).select("doc", "txt", F.expr(f"array_distinct({_all(_hashes, widths)})").alias("hs"))
    # outer: a plain explode filters its array first, and so would compute it twice; nulls join nothing
    each = hashes.select("doc", "txt", F.size("hs").alias("n_doc"), F.explode_outer("hs").alias("hash"))
    found = each.join(probe, (F.col("hash") == F.col("i_hash")) & (F.col("need") <= F.col("n_doc"))).select(F.col("doc").alias("c_doc"), F.col("txt").alias("c_txt"))
    candidates = checkpointed(found.distinct())
    named = F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("txt") == F.col("c_txt"))
    near = _pieces(docs.join(_sent(candidates, candidates.count()), named, "left_semi"))
    windows = near.select("doc", "txt", F.explode_outer(F.expr(_all(_shingles, widths))).alias("x")).select("doc", "txt", "x.hash", "x.shingle")
    own = units.select("u", "n", "need", F.posexplode("shingles").alias("k", "s")).select("u", "n", "need", "k", F.col("s.hash").alias("i_hash"), F.col("s.shingle").alias("i_shingle"))
    size = units.agg(F.coalesce(F.sum(F.expr("aggregate(shingles, 0L, (a, s) -> a + octet_length(s.shingle))")), F.lit(0))).first()[0]
    own = F.broadcast(own) if size <= WIDTH * BROADCAST_BYTES else own
    shared = windows.join(own, (F.col("hash") == F.col("i_hash")) & (F.col("shingle") == F.col("i_shingle"))).select("doc", "txt", "u", "n", "need", "k").distinct()
    counted = shared.groupBy("doc", "txt", "u", "n", "need").agg(F.count(F.lit(1)).alias("n_shared"))
    return counted.where("n_shared >= need").select("doc", "txt", "u", "n_shared", F.col("n").cast("bigint").alias("n"))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return df.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("txt"), text.alias("text"))


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): every pair in which the document holds at least `threshold` of the item."""
    item_rows = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held = _held(_rows(docs, doc_id, text_col).where("doc is not null"), checkpointed(item_units(item_rows, threshold)), threshold)
    names = item_rows.where("item is not null").select("item", F.md5(F.array_join(words_of(F.col("text")), " ")).alias("i_u")).distinct()
    best = held.join(names, F.col("u") == F.col("i_u")).groupBy("doc", "item").agg(F.max(F.struct("n_shared", "n")).alias("m"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("m.n_shared").alias("n_shared"), F.col("m.n").alias("n_item"))


def without_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text holds no item, all columns as they are; rows without an id are judged too, and of an id's texts each by itself."""
    units = checkpointed(item_units(items.select(F.col(f"`{text_col}`").cast("string").alias("text")), threshold))
    bad = checkpointed(_held(_rows(docs, doc_id, text_col), units, threshold).select(F.col("doc").alias("__bad"), F.col("txt").alias("__bad_txt")).distinct())
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__bad")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("__bad_txt"))
    return docs.join(_sent(bad, bad.count()), same, "left_anti")


def oracle_sql() -> str:
    blank = "[\\x20\\x09-\\x0D]+"
    words = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{blank}'), lambda x: x <> '')"

    def shingles(name: str, id_col: str, table: str) -> str:
        window = " || ' ' || ".join(f"w[i + {k}]" for k in range(WIDTH))
        return f"{name} AS (SELECT DISTINCT id, {window} AS s FROM (SELECT id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM (SELECT {id_col} AS id, {words} AS w FROM {table})))"

    return f"""
WITH {shingles('i', 'item_id', 'benchmark')}, {shingles('d', 'doc_id', 'documents')},
n AS (SELECT id, count(*) AS n_item FROM i GROUP BY id),
m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM d JOIN i ON d.s = i.s GROUP BY 1, 2)
SELECT m.doc_id, m.item_id, m.n_shared, n.n_item FROM m JOIN n ON n.id = m.item_id WHERE m.n_shared >= n.n_item * {THRESHOLD} - 1e-9"""
