"""The ten operators against brute-force versions, with nulls, empty and odd texts, ties, repeats, clashing columns and empty tables."""

import base64
import hashlib
import io
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treesift.llm import decontam, feistel_shards, line_dedup, quality, queries, simhash, token_binary, token_counts, unigram, url_filter, warc

SF = "/root/testdata/sf0.001"
LONG = "a long line that repeats"
TEXTS = [None, "", " ", "\n", "one", f"{LONG}\nshort\nshort", f"  {LONG.upper()}\t\nother words in here", f"{LONG}\n{LONG}", "Übergrößen ÀÉ sind da\nund ähnlich", "é́ 😀 　x", "a  b   c ", "▁ mark", "<s> don't <|endoftext|> I'LL 12³", "x" * 5000, "w " * 3000, "Clean words make a clean line of text, as it should be.\nAnd a second line has more of the same kind."]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "hash", k) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", 0), (None, LONG, "no id", 0), (99, TEXTS[5], "copy", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, doc string, n_lines long").repartition(3)


def empty(docs):
    return docs.where("false")


def plain(docs, *names):
    return [tuple(r) for r in docs.select(*names).collect()]


def keyed(x):
    return sorted(x, key=lambda r: tuple((v is not None, v) for v in r))


def test_warc_round_trip(spark):
    rows = [(k, f"http://x.org/{k}\nq", t) for k, t in enumerate(TEXTS)] + [(70, None, TEXTS[5]), (71, "u", TEXTS[5]), (None, "u", TEXTS[5]), (71, "u", TEXTS[5])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    last = {}
    for k, _, t in rows:
        if k is not None:
            last[t or ""] = max(k, last.get(t or "", -1))
    want = []
    for k, _, t in rows:
        raw, lead = (t or "").encode(), last[t or ""]
        again = k is not None and k < lead
        want.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", lead if again else None))
    got = plain(warc.warc_round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert keyed(got) == keyed(want)
    assert warc.warc_round_trip(df.where("false")).count() == 0


def test_warc_format_with_dictionary(spark):
    import zstandard

    samples = [f"<html><body>page {k} with a common text {k * 7}</body></html>".encode() for k in range(400)]
    trained = zstandard.train_dictionary(4096, samples).as_bytes()
    encoder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    records = [warc.record(k, "u", s, None) for k, s in enumerate(samples[:50])]
    archive = warc.dictionary_frame(trained) + warc.EMPTY_FRAME + b"".join(encoder.compress(r) + warc.EMPTY_FRAME for r in records)
    assert list(warc.read_frames(io.BytesIO(archive))) == records
    packed = warc.dictionary_frame(zstandard.compress(trained)) + encoder.compress(records[0])
    assert list(warc.read_frames(io.BytesIO(packed))) == records[:1]
    for broken in (archive[:-20], archive[:9], b"nonsense bytes"):
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(io.BytesIO(broken)))


@pytest.mark.parametrize(
    "change",
    [
        (b"WARC/1.1", b"WARC/9"),
        (b"WARC-Date", b"X-Date"),
        (b"WARC-Date: 2024", b"WARC-Date: 24"),
        (b"Content-Length: 4", b"Content-Length: 5"),
        (b"Content-Length: 4", b"Content-Length: x"),
        (b"Content-Length: 4", b"Content-Length: 4\r\nContent-Length: 4"),
        (b"WARC-Payload-Length: 4", b"WARC-Payload-Length: 999"),
        (b"WARC-Payload-Length: 4", b"WARC-Payload-Length: -4"),
        (b"Digest: sha1:", b"Digest: sha1:A"),
        (b"Digest: sha1:", b"Digest: "),
        (b"<urn:page:1>", b"<urn page>"),
        (b"WARC-Target-URI: u", b"WARC-Target-URI: \xff"),
        (b"WARC-Target-URI: u", b"no colon"),
        (b"WARC-Type: response", b"WARC-Type: revisit"),
        (b"WARC-Type: response\r\n", b""),
        (b"text/html; charset=utf-8", b"application/http"),
        (b"\r\n\r\nbody", b"\r\n\r\nbodY"),
        (b"body\r\n\r\n", b"body\r\n"),
    ],
)
def test_warc_rejects(change):
    good = warc.record(1, "u", b"body", None)
    assert warc.parse_record(good)[1] == b"body"
    bad = good.replace(*change)
    assert bad != good
    with pytest.raises(warc.WarcError):
        warc.parse_record(bad)


def warc_record(headers, block, version="WARC/1.0"):
    return "\r\n".join([version, *headers, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def test_warc_reads_archives_of_others(spark, tmp_path):
    import zstandard

    body = b"<html>hi</html>"
    sha1, sha256 = hashlib.sha1(body), hashlib.sha256(body)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nf\r\n" + body + b"\r\n0\r\n\r\n"
    uuid = "<urn:uuid:9a4f21c0-0000-4000-8000-00000000000{}>"
    common = ["WARC-Date: 2020-02-03T04:05:06Z"]
    records = [
        warc_record(["WARC-Type: warcinfo", f"WARC-Record-ID: {uuid.format(0)}", *common, "Content-Type: application/warc-fields"], b"software: x\r\n"),
        warc_record(["WARC-Type: response", f"WARC-Record-ID: {uuid.format(1)}", *common, "Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://a/", "WARC-Concurrent-To: <urn:x:1>", "WARC-Concurrent-To: <urn:x:2>", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1.digest()).decode()}"], http),
        warc_record(["WARC-Type: response", f"WARC-Record-ID: {uuid.format(2)}", *common, "Content-Type: application/http", "X-Folded: one", " two", f"WARC-Payload-Digest: sha256:{sha256.hexdigest()}"], http, "WARC/1.1"),
        warc_record(["WARC-Type: response", f"WARC-Record-ID: {uuid.format(3)}", *common, "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1.digest()).decode()}"], chunked),
        warc_record(["WARC-Type: revisit", f"WARC-Record-ID: {uuid.format(4)}", *common, "WARC-Profile: p", f"WARC-Refers-To: {uuid.format(1)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1.digest()).decode()}"], b""),
        warc_record(["WARC-Type: metadata", f"WARC-Record-ID: {uuid.format(5)}", *common], b"a: b"),
    ]
    (tmp_path / "part-0.warc.zst").write_bytes(b"".join(map(zstandard.compress, records)))
    got = {r.record_id[-1]: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert [got[str(k)].record_type for k in range(6)] == ["warcinfo", "response", "response", "response", "revisit", "metadata"]
    assert [got[str(k)].payload_bytes for k in (1, 2, 4, 5)] == [len(body), len(body), None, 4]
    assert got["4"].refers_to_id == uuid.format(1).strip("<>") and got["4"].refers_to is None
    assert all(r.page_id is None for r in got.values())


@pytest.mark.parametrize(("sizes", "archives"), [([3, 3, 3], 1), ([10] * 9, 3), ([3, 95, 3, 3], 3), ([31, 3], 2), ([], 0)])
def test_warc_archives_are_bounded(sizes, archives):
    rows = list(warc.archive_rows((bytes([65 + k]) * n for k, n in enumerate(sizes)), b"dict", unit=10, units=4))
    head = warc.dictionary_frame(b"dict")
    files = [rows[k : k + 4] for k in range(0, len(rows), 4)]
    assert len(files) == archives and all(f[0].startswith(head) for f in files)
    assert b"".join(b"".join(f).removeprefix(head) for f in files) == b"".join(bytes([65 + k]) * n for k, n in enumerate(sizes))
    assert all(sum(map(len, f)) - len(head) <= 40 or sum(map(bool, f)) == 1 for f in files)


def test_warc_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(warc, "HEAVY", 3)
    texts = ["hot"] * 20 + ["warm"] * 3 + ["", "", "lone", None]
    df = spark.createDataFrame([(k, "u", t, "x", "y") for k, t in enumerate(texts)], "page_id long, url string, html string, digest string, last string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.warc_round_trip(df).collect()}
    last = {t or "": k for k, t in enumerate(texts)}
    assert got == {k: ("revisit", last[t or ""]) if k < last[t or ""] else ("response", None) for k, t in enumerate(texts)}


def brute_line_dedup(rows):
    def key(x):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))

    first = {}
    for k, t in rows:
        if k is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 10:
                    first[key(x)] = min(k, first.get(key(x), k))
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if k is None or not (len(key(x)) >= 10 and first[key(x)] < k)]
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("hot", "size"), [(1, 0), (8, 16 << 20)])
def test_line_dedup(spark, docs, monkeypatch, hot, size):
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", size)
    monkeypatch.setattr(line_dedup, "SAMPLE", 1.0)
    got = plain(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept")
    assert keyed(got) == keyed(brute_line_dedup(plain(docs, "doc_id", "text")))
    kept = line_dedup.with_kept_text(docs)
    assert kept.columns == docs.columns
    assert keyed(plain(kept, "doc_id", "text")) == keyed([(r[0], r[3]) for r in got])
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def test_line_dedup_many_lines(spark):
    rows = [(1, "\n".join(f"the line number {k}" for k in range(300))), (2, "\n".join(f"the line number {3 * k}" for k in range(300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert keyed(plain(line_dedup.dedup_lines(df), "doc_id", "n_lines", "n_dropped", "kept")) == keyed(brute_line_dedup(rows))
    keep = {r.doc_id: r.keep for r in line_dedup.dedup_lines(df).collect()}
    assert keep[1] is None  # bits are set for lines that stay
    gone = [k for w in keep[2] for k in range(w.word * 64, w.word * 64 + 64) if not w.bits >> (k % 64) & 1]
    assert gone == list(range(100)) and [w.word for w in keep[2]] == [0, 1]


@pytest.mark.parametrize("small", [0, 10**9])
def test_components(spark, monkeypatch, small):
    from treesift.llm import components

    monkeypatch.setattr(components, "SMALL", small)
    monkeypatch.setattr(components, "HUBS", 8)
    edges = [(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(25)] + [(300, 301), (301, 302), (302, 300), (7, 7)]
    got = dict(plain(components.components(spark.createDataFrame(edges, "u long, v long")), "node", "component"))
    assert got == {k: 0 for k in range(1, 60)} | {k: 100 for k in range(101, 126)} | {301: 300, 302: 300}


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.model_path(queries.WORD_MODEL))
    rows = sorted(plain(docs, "doc_id", "text"), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for k, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = plain(token_binary.token_files(docs, queries.model_path(queries.WORD_MODEL)), "doc_id", "start", "n_tokens", "ids_crc32")
    assert keyed(got) == keyed(want)
    assert token_binary.token_files(empty(docs), queries.model_path(queries.WORD_MODEL)).count() == 0


def test_shortcut_takes_every_character_as_the_library_does():
    from tokenizers import Tokenizer

    path = queries.model_path(queries.WORD_MODEL)
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        encoder = token_binary.WordEncoder(f.read())
    assert encoder.fast
    words = [form.format(chr(c)) for c in range(0x21, 0x300) if not chr(c).isspace() for form in ("a{}b", "{}li", "A{}")] + ["Əli", "Ɓangare"]
    starts, n, flat = encoder.words(pa.array(words))
    got = {w: flat[a : a + k].tolist() for w, a, k in zip(words, starts, n, strict=True)}
    assert got == {w: library.encode(w, add_special_tokens=False).ids for w in words}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=900), st.sampled_from([16, 256]))
def test_simple8b(values, block):
    ids = np.array(values, np.uint64)
    words, starts = token_binary.encode_blocks(ids, block, at_once=2)
    assert (token_binary.decode_blocks(words, starts, len(ids), block) == ids).all()
    assert len(starts) == -(-len(ids) // block)


def test_token_counts(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path(queries.PIECE_MODEL))
    want = []
    for k, t in plain(docs, "doc_id", "text"):
        n = len(library.encode(t or ""))
        want.append((k, len((t or "").encode()), n, n > 4096))
    got = plain(token_counts.token_counts(docs, queries.model_path(queries.PIECE_MODEL)), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert keyed(got) == keyed(want)
    assert token_counts.token_counts(empty(docs), queries.model_path(queries.PIECE_MODEL)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .,▁é\n　日t"), max_size=12), min_size=1, max_size=6))
def test_token_counts_odd(texts):
    made = token_counts.Counter(_PIECES) if not hasattr(test_token_counts_odd, "held") else test_token_counts_odd.held
    test_token_counts_odd.held = made
    assert made.texts(pa.array(texts)).tolist() == [len(x) for x in made.library.encode(texts)]


with open(queries.model_path(queries.PIECE_MODEL), "rb") as f:
    _PIECES = f.read()


def test_shards(spark, docs):
    rows = plain(feistel_shards.feistel_shards(docs), "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    raw = [((t or "").encode(), k) for k, t in plain(docs, "doc_id", "text")]
    assert keyed([r[:3] for r in rows]) == keyed([(k, len(b) + 8, zlib.crc32(b)) for b, k in raw])
    assert {(r[3], r[6]) for r in rows} == {("rows", None)}
    n = len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    assert Counter((r[4], r[5]) for r in order) == Counter(feistel_shards.place(k, n) for k in range(n))
    assert feistel_shards.feistel_shards(empty(docs)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 25, 100, 1009])
def test_permutation(n):
    assert sorted(feistel_shards.permute(k, n) for k in range(n)) == list(range(n))


def test_permutation_in_sql(spark):
    for n in (5, 1000):
        got = feistel_shards.with_places(spark.range(n), "id", n).collect()
        assert {r.id: r["__p"] for r in got} == {k: feistel_shards.permute(k, n) for k in range(n)}


def test_walks_end():
    for n in (2, 5, 90, 1009, 123_457):
        values, ends = feistel_shards.exits(n)
        assert len(values) <= n**0.5 + 1
        for v, e in zip(values.tolist()[:200], ends.tolist(), strict=False):
            assert feistel_shards.permute(v, n) == e < n


def brute_quality(t):
    t = t or ""
    words = WORD.findall(t)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    twice, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if twice[w] > 1:
            hit.update(range(k, k + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    lost = sum(sum(map(len, WORD.findall(x))) for x in t.split("\n") if quality.line_failure(x))
    chars = sum(map(len, words))
    return (len(words), chars, sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed, not failed and lost <= quality.MAX_LOSS * chars)


def test_quality(spark, docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    own = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text").unionByName(docs.select("doc_id", "text"))
    got = plain(quality.quality(own), "doc_id", *names)
    assert keyed(got) == keyed([(k, *brute_quality(t)) for k, t in plain(own, "doc_id", "text")])
    assert quality.quality(empty(docs)).count() == 0


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("Home | About us | Contact | Imprint", "navigation"),
        ("Home About Products Services Contact Login Register", "navigation"),
        ("word%%% and*** more$$$ junk### here.", "punctuation"),
        ("a long line of many words that never comes to any end of its own", "punctuation"),
        ("Two words", "punctuation"),
        ("We use cookies to improve this site.", "boilerplate"),
        ("Alle Rechte vorbehalten. Datenschutzerklärung und Impressum hier.", "boilerplate"),
        ("Ce site UTILISE DES COOKIES pour son bon fonctionnement.", "boilerplate"),
        ("Todos los derechos reservados, 2020.", "boilerplate"),
        ("This is a plain sentence, with a | in it.", None),
        ("He said: “It ends well.”", None),
        ("The list has three parts:", None),
        ("日本語の文です。", None),
        ("No.", None),
        (" \t", None),
        ("click here " + "and then many more words follow " * 20 + "to the end.", None),
    ],
)
def test_quality_lines(line, rule):
    assert quality.line_failure(line) == rule
    assert quality.judge_lines(f"A clean line comes first.\n{line}")[2] == ("A clean line comes first." if rule else f"A clean line comes first.\n{line}")


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return [find(k) for k in range(len(fps))]


def brute_fingerprint(t):
    import xxhash

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_shingles_come_in_steps(monkeypatch, step):
    from treesift.llm import shingles

    monkeypatch.setattr(shingles, "STEP", step)
    for t in [*TEXTS, "a b", "a b c", " Ab\tc  d\x0be ", "x" * 50 + " y"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        assert sum(map(len, shingles.shingle_hashes(t, 5, 1))) == (max(1, len(words) - 4) if words else 0)


def test_simhash(spark, docs):
    own = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text").unionByName(docs.select("doc_id", "text"))
    rows = plain(own, "doc_id", "text")
    fps = [brute_fingerprint(t) for _, t in rows]
    group = brute_components(fps)
    least = {}
    for (k, _), g in zip(rows, group, strict=True):
        if k is not None:
            least[g] = min(k, least.get(g, k))
    want = [(k, f"{f:016x}", least.get(g)) for (k, _), f, g in zip(rows, fps, group, strict=True)]
    assert keyed(plain(simhash.near_duplicates(own), "doc_id", "fingerprint", "component_id")) == keyed(want)
    assert simhash.near_duplicates(empty(docs)).count() == 0
    stay = simhash.one_of_each(docs)
    assert stay.columns == docs.columns


def brute_near_components(texts):
    """For each text, the places of all that it reaches at Jaccard 0.8 of 5-word shingles."""
    sets = []
    for t in texts:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and 10 * len(a & b) >= 8 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def edited_copies(spark):
    """Documents and copies of some, with 1 to 8 words changed in each; a large group has one base."""
    rng = np.random.default_rng(3)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = [t for _, t in rows if 150 <= len(t.split()) <= 300]
    for k in range(120):
        words = base[0 if k < 60 else k % len(base)].split()
        for at in rng.choice(len(words), rng.integers(1, 9), replace=False):
            words[at] = f"changed{k}"
        rows.append((10_000 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize(("led", "frequent"), [(16, 5), (1, 2), (0, 10**9)])
def test_one_of_each_links_at_similarity(spark, docs, monkeypatch, led, frequent):
    monkeypatch.setattr(simhash.near_copies, "LED", led)
    monkeypatch.setattr(simhash.near_copies, "FREQUENT", frequent)
    rows = edited_copies(spark) + [(k + 20_000, t) for k, t in enumerate(TEXTS)]
    group = brute_near_components([t for _, t in rows])
    least = {}
    for (k, _), g in zip(rows, group, strict=True):
        least[g] = min(k, least.get(g, k))
    stay = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(r.doc_id for r in stay.collect()) == sorted(least.values())
    assert simhash.one_of_each(empty(docs)).count() == 0


def test_one_of_each_goes_by_row(spark):
    near = [" ".join(f"word{k}" for k in range(100)), " ".join(f"word{k}" for k in range(101))]
    rows = [(1, near[0], 0), (5, near[1], 1), (5, "a text of its own that no other row has", 2), (5, near[1], 3), (7, "said twice under one id", 4), (7, "said twice under one id", 5), (8, "Said twice under one id", 6), (8, "said  twice under one id", 7), (None, near[0], 8), (None, near[0], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    stay = sorted(r.n for r in simhash.one_of_each(df).collect())
    assert stay in ([0, 2, 4, 8, 9], [0, 2, 5, 8, 9])


@pytest.mark.parametrize("bucket", [1, 128])
def test_links_with_and_without_balls(spark, bucket):
    rng = np.random.default_rng(5)
    fps = list({int(x) for x in rng.integers(0, 2**64, 30, dtype=np.uint64)})
    for _ in range(120):
        x = fps[rng.integers(len(fps))]
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    edges = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.linked(df, bucket=bucket).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    named = {x: x for x in fps}

    def find(x):
        while named[x] != x:
            x = named[x]
        return x

    for a, b in edges:
        named[find(a)] = find(b)
    group = brute_components(fps)
    assert len(set(map(find, fps))) == len(set(group))
    assert len({(find(x), g) for x, g in zip(fps, group, strict=True)}) == len(set(group))


def test_thresholds_are_allotted():
    cost, chosen = simhash.allot([[0, 5, 50], [0, 100, 1000], [0, 5, 20]], 1)
    assert (chosen, cost) == ([1, -1, 1], 70)


def brute_unigram(coder, text):
    """Viterbi over all pieces, one character at a time."""
    pieces = {p: (s, k) for k, (p, s, kind) in enumerate(_ALL) if kind in (1, 4)}
    text = unigram.MARK + text.replace(" ", unigram.MARK)
    best = [(0.0, None, None)] + [None] * len(text)
    for i in range(len(text)):
        if best[i] is None:
            continue
        for j in range(i + 1, min(len(text), i + 50) + 1):
            found = pieces.get(text[i:j])
            score = found[0] if found else coder.unknown if j == i + 1 else None
            if score is not None and (best[j] is None or best[i][0] + score > best[j][0]):
                best[j] = (best[i][0] + score, i, found[1] if found else None)
    ids, at = [], len(text)
    while at:
        _, i, k = best[at]
        ids[:0] = [k] if k is not None else [int(coder.byte_id[b]) for b in text[i:at].encode()]
        at = i
    return ids


_ALL = unigram.load_pieces(_PIECES)


def test_unigram():
    coder = unigram.Unigram(_ALL)
    texts = [t or "" for t in TEXTS if len(t or "") < 500] + ["the other hested thing"]
    ids, n = coder.encode(pa.array(texts))
    ends = np.concatenate([[0], np.cumsum(n)])
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == (brute_unigram(coder, t) if t else [])
    assert [b.decode() for b in coder.decode(ids, n)] == [t.replace("▁", " ") for t in texts]


def test_unigram_long_tokens():
    coder = unigram.Unigram(_ALL)
    texts = ["日本語の長い文章です。空白はありません。" * 12, "x" * 500, "Donaudampfschifffahrt" * 12 + "😀" * 50 + "\U0001f9ff", "a▁▁▁b" * 60, "é́" * 200]
    ids, n = coder.encode(pa.array(texts))
    ends = np.concatenate([[0], np.cumsum(n)])
    assert [ids[ends[k] : ends[k + 1]].tolist() for k in range(len(texts))] == [brute_unigram(coder, t.replace("▁", " ")) for t in texts]
    assert [b.decode() for b in coder.decode(ids, n)] == [t.replace("▁", " ") for t in texts]


def test_scores_are_log_scores():
    import math

    normal = [s for _, s, kind in _ALL if kind == 1]
    assert math.isclose(sum(map(math.exp, normal)), 1, rel_tol=1e-4)
    assert {p: k for k, (p, _, _) in enumerate(_ALL)}["▁international"] == unigram.Unigram(_ALL).encode(pa.array(["international"]))[0].tolist()[0]


def unigram_library():
    """The library with a unigram file of the same pieces and scores."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(_PIECES)
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    for piece, (_, score, _) in zip(proto.pieces, _ALL, strict=True):
        piece.score = score
    return SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_unigram_query(spark, docs):
    """Ids over all of sf0.001 are the library's; where they differ, both splits have the same score, which the library adds up in single precision."""
    own = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text").unionByName(docs.select("doc_id", "text"))
    got = unigram.encode_decode(own, queries.model_path(queries.PIECE_MODEL), with_ids=True)
    rows = got.collect()
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) and r.ids_crc32 == zlib.crc32(np.array(r.piece_ids, "<u4").tobytes()) for r in rows)
    assert Counter(r.doc_id for r in rows) == Counter(k for (k,) in plain(own, "doc_id"))
    library, score = unigram_library(), np.array([s for _, s, _ in _ALL])
    texts = dict(plain(own.where("doc_id >= 1000"), "doc_id", "text"))
    pairs = [(r.piece_ids, library.encode(texts[r.doc_id])) for r in rows if r.doc_id in texts]
    assert sum(a == b for a, b in pairs) >= 0.97 * len(pairs)
    assert all(abs(score[a].sum() - score[b].sum()) < 1e-2 for a, b in pairs)
    coder = unigram.Unigram(_ALL)
    few = [r for r in rows if r.doc_id in texts][:25]
    assert all(r.piece_ids == brute_unigram(coder, texts[r.doc_id].replace("▁", " ")) for r in few if texts[r.doc_id])
    assert unigram.encode_decode(empty(docs), queries.model_path(queries.PIECE_MODEL)).count() == 0


def test_urls(spark):
    rows = [(1, "https://A.example.org/es/x"), (2, "http://example.org/en/1"), (3, "http://other.com/fr/a?b"), (4, "http://x.com/de/"), (5, None), (6, "no scheme xxx"), (7, "http://site.net/casino-poker"), (8, "http://site.net/casinos-pokers"), (9, "http://site.net/adult"), (10, "ftp://org"), (11, ""), (1, "https://A.example.org/es/x"), (12, "http://site.net/adult/adult"), (13, "http://site.net/" + "a/" * 50_000 + "Porn"), (None, "http://com/fr/")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(df).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block")
    assert got[3] == ("other.com", "/fr/a", "com/fr/", "allow")
    assert got[4][2:] == ("com/de/", "block")
    assert got[5] == ("", "", None, "allow")
    assert [got[k][3] for k in (6, 7, 8, 9, 10, 11, 12, 13)] == ["block", "block", "allow", "allow", "allow", "allow", "allow", "block"]
    assert got[10][:3] == ("org", "", None) and got[None][2] == "com/fr/"
    assert url_filter.url_verdicts(df.where("false")).count() == 0
    own = {r.page_id: r.verdict for r in url_filter.url_verdicts(df, rules=(), terms=(("adult", False, 0.2), ("site", False, 0.8))).collect()}
    assert (own[9], own[8], own[6]) == ("block", "allow", "allow")


def test_url_terms():
    strict = {t for t, is_strict, _ in url_filter.default_terms() if is_strict}
    assert len(strict) >= 50 and len(url_filter.default_terms()) >= 100
    assert url_filter.read_terms("# x\na\tsoft\t0.5\n\nb\tstrict\t1\n") == (("a", False, 0.5), ("b", True, 1.0))
    for bad in ("a\tsoft", "a\tother\t1", "a\tsoft\t1\na\tsoft\t1", "A\tsoft\t1", "a\tsoft\tx"):
        with pytest.raises(ValueError):
            url_filter.read_terms(bad)
    # urls of either kind made for the purpose: what is caught, and what is left alone
    bad_urls = [f"http://{a}-{b}.net/{c}" for a in ("free", "best") for b in ("porn", "xvideos", "keygen", "hentai") for c in ("", "a/b")] + ["http://x.net/online-casino/poker", "http://x.net/payday/loans?x", "http://hot.net/nude-webcams"]
    good_urls = ["http://essex.ac.uk/middlesex", "http://x.net/cracker-recipes", "http://x.net/adult-education", "http://x.net/scunthorpe/therapist", "http://x.net/classic/cocktails", "http://x.net/dating-rocks", "http://pornic.fr/ville", "http://x.net/poker-face-album"]
    words = url_filter.Vocabulary(url_filter.default_terms())
    blocked = [words.hits(u)[0] > 0 or words.hits(u)[2] >= 1 for u in bad_urls + good_urls]
    assert blocked == [True] * len(bad_urls) + [False] * len(good_urls)


def brute_contained(docs, items):
    """The pairs, of several rows with the same ids that with the most shingles shared; and the documents' rows that hold any item."""

    def shingles(t, n):
        w = [x for x in WORD.findall((t or "").lower())]
        return {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()

    best, bad = {}, set()
    for i, t in items:
        n = min(5, len(WORD.findall(t or "")))
        own = shingles(t, n)
        for at, (d, x) in enumerate(docs):
            shared = len(own & shingles(x, n))
            if own and shared >= 0.8 * len(own) - 1e-9:
                bad.add(at)
                if i is not None and d is not None:
                    best[d, i] = max(best.get((d, i), (0, 0)), (shared, len(own)))
    return [(d, i, *m) for (d, i), m in best.items()], bad


@pytest.mark.parametrize(("rows", "size", "piece"), [(500_000, 8 << 20, 1 << 16), (0, 0, 1 << 16), (500_000, 8 << 20, 7), (0, 0, 1)])
def test_decontamination(spark, monkeypatch, rows, size, piece):
    for name, value in (("BROADCAST_ROWS", rows), ("BROADCAST_BYTES", size), ("PIECE", piece)):
        monkeypatch.setattr(decontam, name, value)
    passage = " ".join(f"word{k}" for k in range(30))
    items = [(1, passage), (2, "tiny item"), (3, None), (4, ""), (5, "five words are just enough"), (6, "repeat " * 12), (None, passage), (1, "two words"), (7, passage), (8, " ".join(f"word{k}" for k in range(14)))]
    texts = [(1, f"before\n{passage.upper()} after"), (2, passage.replace("word4 ", "other ")), (3, passage.replace("word12 ", "x ").replace("word20 ", "y ")), (4, "a tiny item here"), (5, None), (6, ""), (7, "so five words are just enough now"), (8, "repeat " * 40), (9, "clean text of many other words"), (None, passage), (1, f"before\n{passage.upper()} after"), (1, "a clean text under an id that is not"), (10, " ".join(f"word{k}" for k in range(14)).replace("word7 ", "x ")), (11, "filler " * 3000 + passage + " filler" * 3000), (12, "two words")]
    d = spark.createDataFrame([(*t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, n long, w string")
    i = spark.createDataFrame([(*t, 0) for t in items], "item_id long, text string, hash long")
    want, bad = brute_contained(texts, items)
    assert keyed(plain(decontam.contained_items(d, i), "doc_id", "item_id", "n_shared", "n_item")) == keyed(want)
    stay = decontam.without_contaminated(d, i)
    assert stay.columns == d.columns
    assert keyed(plain(stay, "doc_id", "text", "n", "w")) == keyed([(*t, k, "x") for k, t in enumerate(texts) if k not in bad])
    assert decontam.contained_items(d.where("false"), i).count() == 0
    assert decontam.contained_items(d, i.where("false")).count() == 0
    assert decontam.without_contaminated(d, i.where("false")).count() == len(texts)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert keyed(plain(df, *names)) == keyed(want)
