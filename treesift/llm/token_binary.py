"""Token ids in binary files: Simple-8b words with escapes and per-block offsets.

A file is a row of segments. Each has a head, the documents' ids (with a byte each for whether there is one) and token counts, the offset of each block of BLOCK
tokens, then 64-bit little-endian words, and ends in a newline (the line separator of Spark's text writer, which stores
the segments through its committer). A word's low four bits select how many values of how many bits follow (SELECTORS);
selector 0 is an escape: the next word is one whole 64-bit value. A block starts at a word of its own, so blocks decode
independently, and all words with one selector decode in one array step.

Documents are range-partitioned and sorted by (id, text), so a file holds a range of ids. Null and empty texts have the
end id alone. Rows that share an id are ordered by text; equal rows are interchangeable. Null ids come first. A text
of any length is one document of one segment. An empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treesift.llm.common import by_row, checkpointed, chunks, compact, gather, read_model, shared_dir, ship, worker_cache

MAGIC = b"TS8B"
_HEAD = struct.Struct("<4sIIQQI")  # magic, block size, documents, ids, words, blocks
BLOCK = 256
END_ID = 1
#: (values, bits) of selectors 1 to 14, most values first.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 0
#: Segments of one file at most; a segment has about ENCODE_BYTES of text.
SEGMENTS_PER_FILE = 16
#: Pre-tokens that a worker remembers between chunks.
REMEMBERED = 300_000
#: Text that is encoded at a time.
ENCODE_BYTES = 10 << 20


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each value takes; 64 for one that needs an escape."""
    limits = np.array([1 << b for _, b in SELECTORS], np.uint64)
    place = np.searchsorted(limits, ids, side="right")
    return np.array([b for _, b in SELECTORS] + [64], np.uint8)[place]


def encode_blocks(ids: np.ndarray, block: int = BLOCK, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word at which each block starts. In a block, each word takes as many values as it can; `at_once` blocks are encoded at a time."""
    words, starts, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], 0
    for first in range(0, len(ids), at_once * block):
        w, s = _encode_some(ids[first : first + at_once * block], block)
        words.append(w)
        starts.append((s + before).astype(np.uint32))
        before += len(w)
    return np.concatenate(words), np.concatenate(starts)


def _encode_some(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    ids = ids.astype(np.uint64)
    n_blocks = -(-len(ids) // block)
    values = np.zeros((n_blocks, block + 60), np.uint64)  # zeros behind a block fill its last word
    padded = np.zeros(n_blocks * block, np.uint64)
    padded[: len(ids)] = ids
    values[:, :block] = padded.reshape(n_blocks, block)
    width = _widths(values.reshape(-1)).reshape(values.shape)
    choice = np.zeros(values.shape, np.uint8)  # 0: escape
    widest = {1: width}  # by n: the widest of the n values from each place on
    for n in sorted({n for n, _ in SELECTORS} | {2, 4, 8, 16, 32}):
        if n == 1:
            continue
        half = max(k for k in widest if k < n and 2 * k >= n)
        a = widest[half]
        shift = n - half
        window = a.copy()
        window[:, : a.shape[1] - shift] = np.maximum(a[:, : a.shape[1] - shift], a[:, shift:])
        widest[n] = window
    for k in range(len(SELECTORS) - 1, -1, -1):
        n, bits = SELECTORS[k]
        choice[widest[n] <= bits] = k + 1
    counts = np.array([1] + [n for n, _ in SELECTORS], np.int64)
    rows = np.arange(n_blocks)
    size = np.full(n_blocks, block, np.int64)
    size[-1] = len(ids) - block * (n_blocks - 1)
    at, row_of, pos_of, order = np.zeros(n_blocks, np.int64), [], [], []
    step = 0
    while len(rows):
        row_of.append(rows)
        pos_of.append(at[rows])
        order.append(np.full(len(rows), step))
        at[rows] += counts[choice[rows, at[rows]]]
        rows = rows[at[rows] < size[rows]]
        step += 1
    row, pos, order = np.concatenate(row_of), np.concatenate(pos_of), np.concatenate(order)
    sort = np.lexsort((order, row))
    row, pos = row[sort], pos[sort]
    sel = choice[row, pos]
    length = 1 + (sel == ESCAPE).astype(np.int64)
    place = np.cumsum(length) - length
    words = np.zeros(int(length.sum()), np.uint64)
    flat, first = values.reshape(-1), row * values.shape[1] + pos
    escaped = sel == ESCAPE
    words[place[escaped] + 1] = flat[first[escaped]]
    for k, (n, bits) in enumerate(SELECTORS, 1):
        own = np.flatnonzero(sel == k)
        if len(own):
            word = np.full(len(own), k, np.uint64)
            for j in range(n):
                word |= flat[first[own] + j] << np.uint64(4 + j * bits)
            words[place[own]] = word
    starts = place[np.searchsorted(row, np.arange(n_blocks))]
    return words, starts


def decode_blocks(words: np.ndarray, starts: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The values; every selector's words in one step."""
    out = np.zeros(n_ids, np.uint64)
    if not n_ids:
        return out
    starts = starts.astype(np.int64)
    sel = (words & np.uint64(15)).astype(np.int64)
    # a word behind an escape is a value, not a head; escapes are rare, so these are walked
    is_head = np.ones(len(words), bool)
    last = -2
    for k in np.flatnonzero(sel == ESCAPE).tolist():
        if last != k - 1:
            is_head[k + 1] = False
            last = k
    heads = np.flatnonzero(is_head)
    s = sel[heads]
    n = np.array([1] + [n for n, _ in SELECTORS], np.int64)[s]
    total = np.cumsum(n) - n
    block_of = np.searchsorted(starts, heads, side="right") - 1
    base = total[np.searchsorted(heads, starts)]
    to = block_of * block + total - base[block_of]
    limit = np.minimum((block_of + 1) * block, n_ids)
    escaped = s == ESCAPE
    out[to[escaped]] = words[heads[escaped] + 1]
    for k, (count, bits) in enumerate(SELECTORS, 1):
        own = np.flatnonzero(s == k)
        if not len(own):
            continue
        w, start, end = words[heads[own]], to[own], limit[own]
        for j in range(count):
            on = start + j < end
            out[(start + j)[on]] = (w[on] >> np.uint64(4 + j * bits)) & np.uint64((1 << bits) - 1)
    return out


def write_segment(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    named = pc.is_valid(doc_ids).to_numpy(zero_copy_only=False).astype(np.uint8)
    names = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)
    words, starts = encode_blocks(ids)
    head = _HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(ids), len(words), len(starts))
    return b"".join([head, names.astype("<i8").tobytes(), named.tobytes(), counts.astype("<u8").tobytes(), starts.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def read_segments(data: memoryview) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(document ids, token counts, ids) of each segment of a file."""
    at = 0
    while at < len(data):
        magic, block, n_docs, n_ids, n_words, n_blocks = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("no segment starts here")
        at += _HEAD.size
        parts = []
        for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u4", n_blocks), ("<u8", n_words)):
            end = at + n * np.dtype(kind).itemsize
            parts.append(np.frombuffer(data[at:end], kind))
            at = end
        if data[at : at + 1] != b"\n":
            raise ValueError("a segment's end is missing")
        at += 1
        yield pa.array(parts[0].astype(np.int64), mask=parts[1] == 0), parts[2].astype(np.int64), decode_blocks(parts[4], parts[3], n_ids, block)


class WordEncoder:
    """Encodes words that white space separates with a model of the tokenizers library.

    The model drops white space, so a text's ids are those of its words. Words of plain letters, digits and marks up to
    U+024F, in lower case too, are cut into pre-tokens as the model's pattern does, and the library's model encodes each
    distinct pre-token once; any other word goes through the whole library.
    """

    #: Without capitals whose lower forms are above U+024F, such as U+018F: _cut would take those for symbols.
    _plain = "^[!-~" + "".join(c for c in map(chr, range(0xC0, 0x250)) if c not in "×÷" and max(c.lower()) <= "ɏ") + "]+$"
    #: The characters that byte-level models show bytes as: printable ones of Latin-1 as themselves, the others from U+0100 on in turn.
    _shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    _bytes = {b: c for b, c in [*zip(_shown, _shown, strict=True), *zip(sorted(set(range(256)) - set(_shown)), range(256, 512), strict=False)]}
    #: The model's pattern, as far as such words need it.
    _cut = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^a-zß-öø-ɏ0-9]+)"

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(model.decode())
        spec = json.loads(model)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        pattern = (steps[0].get("pattern") or {}).get("Regex")
        self.fast = kinds == ["NFC", "Replace", "Lowercase"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and all("<|" in t["content"] for t in spec["added_tokens"]) and steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space") and spec["model"]["type"] == "BPE"
        if not self.fast and "Replace" not in kinds:
            raise ValueError("this model may not drop white space")
        self.pieces = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": steps[-1], "added_tokens": []})).model if self.fast else None
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _encoded(model, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in model.encode_batch_fast(words, add_special_tokens=False)] if words else []

    def _encoded_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each pre-token by the library's model itself, to which its byte-level step would give the characters of _bytes."""
        cut, table = self.pieces.tokenize, self._bytes
        return [array("I", [t.id for t in cut(w if w.isascii() else w.encode().decode("latin-1").translate(table))]).tobytes() for w in pieces]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's ids start, how many they are, and all ids joined."""
        plain = pc.and_not(pc.match_substring_regex(words, self._plain), pc.match_substring(words, "<|")) if self.fast else pa.array(np.zeros(len(words), bool))
        parts = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), self._cut, "\\1\x01"), "\x01")
        coded = parts.flatten().dictionary_encode()
        lens, flat = self._joined(self._pretokens(coded.dictionary.to_pylist()))
        codes = coded.indices.to_numpy()
        own = by_row(lens[codes], parts.offsets.to_numpy().astype(np.int64))
        own_flat = gather(np.cumsum(lens) - lens, lens, codes, flat)
        is_plain = plain.to_numpy(zero_copy_only=False)
        rest, rest_flat = self._joined(self._encoded(self.whole, words.filter(pc.invert(plain)).to_pylist()))
        n, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        n[is_plain], n[~is_plain] = own, rest
        starts[is_plain], starts[~is_plain] = np.cumsum(own) - own, len(own_flat) + np.cumsum(rest) - rest
        return starts, n, np.concatenate([own_flat, rest_flat])

    @staticmethod
    def _joined(made: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(map(len, made), np.int64, len(made)) // 4, np.frombuffer(b"".join(made), "<u4")

    def _pretokens(self, distinct: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known[""] = b""
        collecting = gc.isenabled()
        gc.disable()  # hundreds of thousands of short lists, none in a cycle
        try:
            made = list(map(self.known.get, distinct))
            new = [k for k, v in enumerate(made) if v is None]
            names = [distinct[k] for k in new]
            ids = self._encoded_pieces(names)
        finally:
            if collecting:
                gc.enable()
        for k, v in zip(new, ids, strict=True):
            made[k] = v
        self.known.update(zip(names, ids, strict=True))
        return made

    def texts(self, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) joined, each with the end id behind it, and how many each has."""
        split = pc.ascii_split_whitespace(text)
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        starts, lens, flat = self.words(coded.dictionary)
        starts, lens, flat = np.append(starts, len(flat)), np.append(lens, 1), np.append(flat, np.uint32(end_id))
        codes = np.insert(coded.indices.to_numpy().astype(np.int64), offsets[1:], len(lens) - 1)
        return gather(starts, lens, codes, flat), by_row(lens[codes], offsets + np.arange(len(offsets)))


def word_encoder(model: bytes) -> WordEncoder:
    held, key = worker_cache(), ("word encoder", hashlib.sha1(model).digest())
    if key not in held:
        held[key] = WordEncoder(model)
    return held[key]


def write_token_files(df: DataFrame, path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every row and write the files to `path`, in ascending order of ids."""
    spark = df.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(read_model(model_path))  # a model file: 49,000 words, 1.7 MB
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the bounds are sampled from the ids alone; equal ids meet in one partition
    ordered = rows.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id").sortWithinPartitions("id", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from treesift.llm.token_binary import ENCODE_BYTES, word_encoder, write_segment

        encoder = word_encoder(model.value)
        for b in chunks(batches, "text", ENCODE_BYTES):
            ids, counts = encoder.texts(compact(b.column(1)), end_id)
            yield pa.RecordBatch.from_arrays([pa.array([write_segment(b.column(0), counts, ids)], pa.binary())], names=["segment"])

    made = ordered.mapInArrow(segments, "segment binary").select(F.col("segment").cast("string").alias("value"))
    made.write.option("lineSep", "\n").option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(file, seq, doc_id, local_start, n_tokens, ids_crc32[, ids]) of every document of the files in `path`; local_start counts from the file's start."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    schema = "file string, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treesift.llm.token_binary import read_segments

        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                start = 0
                for docs, counts, ids in read_segments(memoryview(content.as_buffer())):
                    raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                    first = np.concatenate([[0], np.cumsum(counts)])
                    crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                    arrays = [pa.array([name.as_py()] * len(docs), pa.string()), docs, pa.array(first[:-1] + start), pa.array(counts), pa.array(crc, pa.int64())]
                    names = ["file", "doc_id", "local_start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        arrays.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    start += int(first[-1])

    return files.mapInArrow(rows, schema)


def token_file_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files in `path`; start counts the ids of all documents before.

    The files are decoded once and the narrow result is checkpointed; then one row for each file gives the files' offsets.
    """
    docs = checkpointed(read_token_files(spark, path))
    sizes = docs.groupBy("file").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("trail"), F.sum("n_tokens").alias("size"))
    before = Window.orderBy(F.asc_nulls_first("lead"), "trail", "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("file").alias("of"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return docs.join(offsets, F.col("file") == F.col("of")).select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/tokens"
    write_token_files(df, path, model_path, id_col, text_col)
    return token_file_index(df.sparkSession, path)
