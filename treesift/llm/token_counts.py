"""Token counts under a SentencePiece BPE model, with a shortcut for words that are one token.

A text is cut before each run of spaces. No piece of the model has a space mark behind another character (this is
checked when the model is loaded), so no merge crosses a cut, and a text's count is the sum over its pre-tokens. Which
words are one token is proved at load: a piece `▁word` counts as whole if the library encodes `word` alone as that one
token. Pre-tokens in that table count 1; the others are merged by the library, once for each distinct word of a chunk.
Texts that hold the mark `▁` itself go through the library whole.

Null and empty texts have no bytes and no tokens. Repeated rows are counted alike. Texts are counted whole, as the
library's default treats them: no begin or end token, and strings like `<s>` are plain text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import by_row, chunks, compact, id_field, read_model, ship, worker_cache

LIMIT = 4096
MARK = "▁"
_PRETOKEN = re.compile(r"^[^ ]+| +[^ ]*")


class Counter:
    """Counts tokens of texts; holds the table of whole-token words."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = self.library.id_to_piece(list(range(self.library.get_piece_size())))
        #: Whether pre-tokens are independent of each other.
        self.separable = all(MARK not in p.lstrip(MARK) for p in pieces) and self._keeps_spaces()
        words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        self.whole = frozenset(w for w, ids in zip(words, self.library.encode(words), strict=True) if len(ids) == 1)

    def _keeps_spaces(self) -> bool:
        """The normaliser puts one mark before the text, keeps every space and changes no other character."""
        probe = "a  b\u3000\u00a0\t\uff21e\u0301\n c "
        return "".join(self.library.encode("a  b ", out_type=str)) == "▁a▁▁b▁" and self.library.decode(self.library.encode(probe)) == probe

    def words(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, with the space mark before it."""
        counts = np.ones(len(words), np.int64)
        rest = [k for k, w in enumerate(words) if w not in self.whole]
        counts[rest] = [len(x) for x in self.library.encode([words[k] for k in rest], num_threads=1)] if rest else []
        return counts

    def spaced(self, texts: list[str]) -> list[int]:
        """Tokens of texts with runs of spaces or spaces at an end, by pre-tokens with their spaces.

        The library puts a mark before a text, so a pre-token of k spaces and a word is encoded as k - 1 spaces and the word.
        """
        cut = [_PRETOKEN.findall(t) for t in texts]
        # the mark before the text joins the spaces that it starts with
        for parts in cut:
            if parts:
                parts[0] = " " + parts[0]
        distinct = sorted({p for parts in cut for p in parts})
        counts = dict(zip(distinct, (len(x) for x in self.library.encode([p[1:] for p in distinct], num_threads=1)), strict=True))
        # a lone mark: the library encodes an empty string as nothing
        counts = {p: n if p != " " else 1 for p, n in counts.items()}
        return [sum(counts[p] for p in parts) for parts in cut]

    def texts(self, text: pa.Array) -> np.ndarray:
        if not self.separable:
            return np.array([len(x) for x in self.library.encode(text.to_pylist(), num_threads=1)], np.int64)
        odd = pc.match_substring(text, MARK).to_numpy(zero_copy_only=False)
        spaced = pc.match_substring_regex(text, "^ |  | $").to_numpy(zero_copy_only=False)
        plain = ~odd & ~spaced & (pc.binary_length(text).to_numpy(zero_copy_only=False) > 0)
        out = np.zeros(len(text), np.int64)
        if plain.any():
            split = pc.split_pattern(text.filter(pa.array(plain)), " ")
            coded = split.flatten().dictionary_encode()
            counts = self.words(coded.dictionary.to_pylist())
            out[plain] = by_row(counts[coded.indices.to_numpy()], split.offsets.to_numpy().astype(np.int64))
        for which, count in ((odd, lambda x: [len(i) for i in self.library.encode(x, num_threads=1)]), (spaced & ~odd, self.spaced)):
            if which.any():
                out[which] = count(text.filter(pa.array(which)).to_pylist())
        return out


def counter(model: bytes) -> Counter:
    held, key = worker_cache(), ("token counter", hashlib.sha1(model).digest())
    if key not in held:
        held[key] = Counter(model)
    return held[key]


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; no shuffle."""
    ship(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))  # a model file: 32,000 pieces, 0.5 MB
    source = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treesift.llm.token_counts import counter

        tokens = counter(model.value)
        for b in chunks(batches, "__text"):
            text = compact(b.column(1))
            n = tokens.texts(text)
            size = pc.cast(pc.binary_length(text), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], names=["__id", "n_bytes", "n_tokens", "over_limit"])

    done = source.mapInArrow(count, f"__id {id_field(df, id_col)}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return done.withColumnRenamed("__id", id_col)
