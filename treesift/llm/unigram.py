"""SentencePiece encoding and decoding with a unigram model: Viterbi over a double-array trie of pieces with log scores.

Encoding puts one space mark before the text and writes each space as a mark. The best split of the text into pieces is
the one with the largest sum of log scores; among equal sums the one that reaches each place first wins, earlier starts
before later ones. A character that no piece covers alone may be taken as unknown at the lowest score less 10, and is
written as its UTF-8 bytes' pieces. Decoding joins pieces, turns bytes back and marks into spaces, and drops the mark that encoding put
first.

Pieces and scores are read from a model file; nothing is trained. A unigram file holds log scores. A BPE file holds minus
the rank of each merge instead, which is no log score and would make a split of many frequent pieces better than one
whole word; its ranks become log scores by Zipf's law, p(piece) = 1 / (1 + rank) over the sum of these. The ids are then
those of the library for a unigram file with the same pieces and log scores, not those of the BPE merges.

If no piece has a mark behind another character, the text is cut before each run of marks and each distinct pre-token
of a chunk is split once; all pre-tokens of one length are split at the same time, array by array. A long pre-token, as of
a language without spaces, is split alone: all its matches are found depth by depth, then one pass goes over them.

Null and empty texts have no pieces. A mark character `▁` in a text comes back as a space, the only change a round trip
makes; `round_trip` compares with the text so normalised. Repeated rows are encoded alike. Texts are handled whole. An
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import by_row, chunks, compact, gather, id_field, read_model, ship, worker_cache

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Text that is encoded and decoded at a time.
CODE_BYTES = 2 << 20
#: Bytes from which a pre-token is split alone, and how many of its starts are matched at a time.
LONG, STARTS = 192, 1 << 16
_NORMAL, _UNKNOWN, _BYTE, _USER = 1, 2, 6, 4
_PRETOKEN = re.compile(r"^[^ ]+| +[^ ]*")


def load_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, log score, type) of a SentencePiece model file, by id."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
    return zipf_scores(pieces) if proto.trainer_spec.model_type == proto.trainer_spec.BPE else pieces


def zipf_scores(pieces: Sequence[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """The pieces with log scores in single precision in place of minus their merge ranks; bytes and others that no merge makes keep theirs."""
    whole = sum(1 / (1 - s) for _, s, kind in pieces if kind == _NORMAL)
    return [(p, float(np.float32(-np.log(1 - s) - np.log(whole))) if kind == _NORMAL else s, kind) for p, s, kind in pieces]


class DoubleArray:
    """A trie over byte strings in two arrays: the child of state s by byte c is t = base[s] + c, if check[t] = s."""

    def __init__(self, keys: Sequence[tuple[bytes, int]]):
        size = 8192 + 4 * sum(len(k) for k, _ in keys)
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        self.check[0] = 0
        first_free = 1
        ordered = sorted(keys)
        todo = [(0, 0, 0, len(ordered))]
        while todo:
            state, depth, lo, hi = todo.pop()
            if lo < hi and len(ordered[lo][0]) == depth:
                self.value[state] = ordered[lo][1]
                lo += 1
            if lo == hi:
                continue
            groups, at = [], lo
            while at < hi:
                c, to = ordered[at][0][depth], at
                while to < hi and ordered[to][0][depth] == c:
                    to += 1
                groups.append((c, at, to))
                at = to
            while not free[first_free]:
                first_free += 1
            codes = np.array([c for c, _, _ in groups])
            base = max(1, first_free - int(codes[0]))
            while len(codes) > 1 or not free[base + codes[0]]:
                fits = free[base + codes[0] : base + codes[0] + 1024].copy()
                for c in codes[1:]:
                    fits &= free[base + c : base + c + 1024]
                if fits.any():
                    base += int(fits.argmax())
                    break
                base += 1024
            self.base[state] = base
            for c, a, b in groups:
                free[base + c] = False
                self.check[base + c] = state
                todo.append((base + c, depth + 1, a, b))
        used = int(np.flatnonzero(~free)[-1]) + 257
        self.base, self.check, self.value = self.base[:used].copy(), self.check[:used].copy(), self.value[:used].copy()


class Unigram:
    """Encoder and decoder for a list of pieces."""

    def __init__(self, pieces: Sequence[tuple[str, float, int]]):
        normal = [(p.encode(), k) for k, (p, _, kind) in enumerate(pieces) if kind in (_NORMAL, _USER)]
        self.trie = DoubleArray(normal)
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        self.unknown = min((s for _, s, kind in pieces if kind == _NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.byte_id = np.zeros(256, np.int32)
        for k, (p, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                self.byte_id[int(p[3:5], 16)] = k
        spelled = [bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(MARK, " ").encode() if kind in (_NORMAL, _USER) else b"" for p, _, kind in pieces]
        self.is_byte = np.array([kind == _BYTE for _, _, kind in pieces])
        self.spelled_len = np.array([len(b) for b in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.separable = all(MARK not in p.lstrip(MARK) for p, _, _ in pieces)

    def split_all(self, tokens: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of every byte string (marks already in place): starts, lengths and the ids joined."""
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        order = np.argsort(lens, kind="stable")
        counts, found = np.zeros(len(tokens), np.int64), []
        at = 0
        while at < len(order):
            length = int(lens[order[at]])
            to = int(np.searchsorted(lens[order], length, side="right"))
            to = min(to, at + max(1, (1 << 21) // max(1, length)))
            group = order[at:to]
            if length >= LONG:
                to = at + 1
                ids = self._split_long(tokens[order[at]])
                counts[order[at]] = len(ids)
                found.append(ids)
            elif length:
                text = np.frombuffer(b"".join([tokens[k] for k in group]), np.uint8).reshape(len(group), length)
                ids, n = self._split_group(text)
                counts[group] = n
                found.append(ids)
            at = to
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        starts = np.zeros(len(tokens), np.int64)
        n = counts[order]
        starts[order] = np.cumsum(n) - n
        return starts, counts, flat

    def _split_group(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi for rows of one length: ids of all rows joined, and how many each has."""
        n, length = text.shape
        t = self.trie
        best = np.full((length + 1, n), -np.inf)  # in doubles: in single precision an unknown's score would drown the pieces'
        best[0] = 0
        back, piece = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
        lead = (text & 0xC0) != 0x80
        for i in range(length):
            live = np.flatnonzero(lead[:, i] & (best[i] > -np.inf))
            if not len(live):
                continue
            lead_byte = text[live, i]
            width = 1 + (lead_byte >= 0xC0).astype(np.int32) + (lead_byte >= 0xE0) + (lead_byte >= 0xF0)
            width = np.minimum(width, length - i)
            alone = np.zeros(len(live), bool)
            rows, state, local = live, np.zeros(len(live), np.int64), np.arange(len(live))
            for j in range(i, length):
                to = t.base[state] + text[rows, j]
                ok = (t.check[to] == state) & (t.base[state] > 0)
                if not ok.any():
                    break
                rows, state, local = rows[ok], to[ok].astype(np.int64), local[ok]
                value = t.value[state]
                has = value >= 0
                if has.any():
                    r, v = rows[has], value[has]
                    alone[local[has]] |= width[local[has]] == j - i + 1
                    score = best[i, r] + self.score[v]
                    wins = score > best[j + 1, r]
                    w = r[wins]
                    best[j + 1, w], back[j + 1, w], piece[j + 1, w] = score[wins], i, v[wins]
            lost = np.flatnonzero(~alone)
            if len(lost):
                r, end = live[lost], i + width[lost]
                score = best[i, r] + self.unknown
                wins = score > best[end, r]
                r, end = r[wins], end[wins]
                best[end, r] = score[wins]
                for k in range(1, 5):  # a chain of byte pieces, one for each byte
                    on = i + k <= end
                    if not on.any():
                        break
                    back[i + k, r[on]] = i + k - 1
                    piece[i + k, r[on]] = self.byte_id[text[r[on], i + k - 1]]
        at, rows, steps = np.full(n, length), np.arange(n), []
        while len(rows):
            steps.append((rows, piece[at[rows], rows]))
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        row, ids = np.concatenate([r for r, _ in steps]), np.concatenate([p for _, p in steps])
        counts = np.bincount(row, minlength=n)
        order = np.lexsort((-np.arange(len(row)), row))
        return ids[order], counts

    def _matches(self, text: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of every piece that begins at first..last - 1, by start and length."""
        t, n = self.trie, len(text)
        start = first + np.flatnonzero((text[first:last] & 0xC0) != 0x80)
        state, depth, found = np.zeros(len(start), np.int64), 0, []
        while len(start):
            base = t.base[state]
            to = base + text[start + depth]
            ok = (t.check[to] == state) & (base > 0)
            start, state, depth = start[ok], to[ok].astype(np.int64), depth + 1
            value = t.value[state]
            has = value >= 0
            found.append((start[has], np.full(int(has.sum()), depth), value[has]))
            inside = start + depth < n
            start, state = start[inside], state[inside]
        at, size, ids = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort((size, at))
        return at[order], size[order], ids[order]

    def _split_long(self, token: bytes) -> np.ndarray:
        """Viterbi for one token: the same split as that of _split_group."""
        text, n = np.frombuffer(token, np.uint8), len(token)
        best, back, piece = array("d", bytes(8 * (n + 1))), array("i", bytes(4 * (n + 1))), array("i", bytes(4 * (n + 1)))
        none = float("-inf")
        for k in range(1, n + 1):
            best[k] = none
        width = 1 + (text >= 0xC0).astype(np.int64) + (text >= 0xE0) + (text >= 0xF0)
        scores, unknown = self.score, self.unknown
        for first in range(0, n, STARTS):
            last = min(n, first + STARTS)
            at, size, ids = self._matches(text, first, last)
            m_end, m_id, m_score = (at + size).tolist(), ids.tolist(), scores[ids].tolist()
            leads = first + np.flatnonzero((text[first:last] & 0xC0) != 0x80)
            bounds = np.searchsorted(at, leads).tolist() + [len(at)]
            ends = np.minimum(leads + width[leads], n).tolist()
            for k, i in enumerate(leads.tolist()):
                here = best[i]
                if here == none:
                    continue
                alone = False
                for m in range(bounds[k], bounds[k + 1]):
                    end, score = m_end[m], here + m_score[m]
                    alone |= end == ends[k]
                    if score > best[end]:
                        best[end], back[end], piece[end] = score, i, m_id[m]
                if not alone and here + unknown > best[ends[k]]:
                    best[ends[k]], back[ends[k]], piece[ends[k]] = here + unknown, i, -1
        out, at = [], n
        while at > 0:
            i = back[at]
            out += [piece[at]] if piece[at] >= 0 else [int(self.byte_id[c]) for c in reversed(token[i:at])]
            at = i
        return np.array(out[::-1], np.int32)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) joined, and how many each has."""
        size = pc.binary_length(text).to_numpy(zero_copy_only=False)
        if not self.separable:
            tokens = [(MARK + t.replace(" ", MARK)).encode() if t else b"" for t in text.to_pylist()]
            starts, n, flat = self.split_all(tokens)
            return gather(starts, n, np.arange(len(tokens)), flat), n
        odd = pc.match_substring(text, MARK).to_numpy(zero_copy_only=False) | pc.match_substring_regex(text, "^ |  | $").to_numpy(zero_copy_only=False)
        plain = ~odd & (size > 0)
        words = pc.split_pattern(text.filter(pa.array(plain)), " ")
        coded = words.flatten().dictionary_encode()
        tokens = [(MARK + w).encode() for w in coded.dictionary.to_pylist()]
        n_pre = np.zeros(len(text), np.int64)
        n_pre[plain] = np.diff(words.offsets.to_numpy())
        place = {t: k for k, t in enumerate(tokens)} if odd.any() else {}
        other: dict[int, list[int]] = {}
        for k in np.flatnonzero(odd):
            parts = _PRETOKEN.findall(text[int(k)].as_py().replace(MARK, " "))
            parts[0] = " " + parts[0]
            other[int(k)] = [place.setdefault(p, len(place)) for p in (x.replace(" ", MARK).encode() for x in parts)]
            n_pre[k] = len(parts)
        tokens += list(place)[len(tokens) :] if place else []
        first = np.concatenate([[0], np.cumsum(n_pre)])
        codes = np.zeros(int(first[-1]), np.int64)
        is_plain = np.repeat(plain, n_pre)
        codes[is_plain] = coded.indices.to_numpy()
        for k, own in other.items():
            codes[first[k] : first[k + 1]] = own
        starts, lens, flat = self.split_all(tokens)
        return gather(starts, lens, codes, flat), by_row(lens[codes], first)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of rows of ids, as bytes: a row's first space is the one that encoding put there."""
        data = gather(self.spelled_at, self.spelled_len, ids, self.spelled).tobytes()
        ends = np.cumsum(by_row(self.spelled_len[ids], np.concatenate([[0], np.cumsum(counts)])))
        out, at = [], 0
        for end in ends.tolist():
            out.append(data[at:end].removeprefix(b" "))
            at = end
        return out


def unigram(model: bytes) -> Unigram:
    """The coder of a pickled Unigram, loaded once for each worker."""
    held, key = worker_cache(), ("unigram", hashlib.sha1(model).digest())
    if key not in held:
        held[key] = pickle.loads(model)
    return held[key]


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_pieces, n_byte_pieces, ids_crc32, text_crc32, round_trip[, piece_ids]) of every row; no shuffle.

    ids_crc32 is of the ids as little-endian unsigned 32-bit integers, text_crc32 of the decoded text in UTF-8.
    """
    ship(df.sparkSession)
    coder = pickle.dumps(Unigram(load_pieces(read_model(model_path))))  # the trie is built once, here
    model = df.sparkSession.sparkContext.broadcast(coder)  # 32,000 pieces: 12 bytes for each of the trie's states, some MB
    source = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    schema = f"__id {id_field(df, id_col)}, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, text_crc32 bigint, round_trip boolean" + ", piece_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treesift.llm.unigram import CODE_BYTES, MARK, unigram

        coder = unigram(model.value)
        for b in chunks(batches, "__text", CODE_BYTES):
            text = compact(b.column(1))
            ids, n = coder.encode(text)
            ids = ids.astype("<u4")
            first = np.concatenate([[0], np.cumsum(n)])
            back = coder.decode(ids, n)
            raw = memoryview(ids).cast("B")
            same = [d.decode("utf-8", "replace") == t.replace(MARK, " ") for d, t in zip(back, text.to_pylist(), strict=True)]
            arrays = [
                b.column(0),
                pa.array(n),
                pa.array(by_row(coder.is_byte[ids].astype(np.int64), first)),
                pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.int64()),
                pa.array([zlib.crc32(d) for d in back], pa.int64()),
                pa.array(same, pa.bool_()),
            ]
            names = ["__id", "n_pieces", "n_byte_pieces", "ids_crc32", "text_crc32", "round_trip"]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("piece_ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
