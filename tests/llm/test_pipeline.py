"""Each stage of the pipeline, and all of them, against brute force: with nulls, repeated rows, extra and clashing columns, and an empty table."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_operators import SF, WORD, brute_contained, brute_line_dedup, brute_near_components, brute_quality, brute_unigram, edited_copies
from treesift.llm import quality, unigram

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, doc string, txt long, keep int, n int, hash string, sid long"
ITEMS = [(1, " ".join(f"item{k} of the test" for k in range(9))), (2, None), (3, "five words of one item"), (1, "another text under the same id as the first")]


def made_rows(spark):
    """Documents of sf0.001, edited copies of some, and rows that hold items, shared lines, nothing or nulls."""
    shared = "This very line is shared by several of the documents here.\n"
    clean = "The {} sentence comes first and has a word of its own. Then {} thoughts go on in plain order. In the end {} is said once more."
    texts = [(k, t) for k, t in edited_copies(spark) if k >= 10_000 or k % 3 == 0]
    texts += [(20_000 + k, shared + clean.replace("{}", f"number{k}") + (f"\n{ITEMS[0][1]}." if k % 4 == 0 else "")) for k in range(12)]
    texts += [(30_000, None), (30_001, ""), (30_002, "Home | About | Contact | Login\n" * 5 + clean.replace("{}", "menu")), (20_003, texts[-9][1]), (None, clean.replace("{}", "nameless")), (30_003, clean.replace("{}", "five words of one item"))]
    return [(k, t, "en", f"s{at % 3}", len(t or ""), "hot", at, 1, 2, "h", 5) for at, (k, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def rows(spark):
    return made_rows(spark)


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def recounted(row, text):
    return (row[0], text, *row[2:4], len(text), *row[5:])


def brute_rules(rows):
    out = []
    for r in rows:
        if brute_quality(r[1])[-1]:
            out.append(recounted(r, "\n".join(x for x in r[1].split("\n") if not quality.line_failure(x))))
    return out


def brute_lines(rows):
    return [recounted(r, kept[3]) for r, kept in zip(rows, brute_line_dedup([r[:2] for r in rows]), strict=True)]


def brute_copies(rows):
    """(rows that stay for certain, groups of equal rows of which any one stays)."""
    named = [r for r in rows if r[0] is not None]
    group = brute_near_components([r[1] for r in named])
    least = {}
    for r, g in zip(named, group, strict=True):
        least[g] = min(least.get(g, r[0]), r[0])
    stay = {}
    for r, g in zip(named, group, strict=True):
        if r[0] == least[g]:
            stay.setdefault(g, []).append(r)
    assert all(len({x[1] for x in own}) == 1 for own in stay.values())  # else the hash of the text would decide
    return [r for r in rows if r[0] is None], list(stay.values())


def brute_items(rows):
    _, bad = brute_contained([r[:2] for r in rows], ITEMS)
    return [r for k, r in enumerate(rows) if k not in bad]


def tuples(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def pieces():
    from treesift.llm.common import read_model
    from treesift.llm.queries import PIECE_MODEL, model_path

    return unigram.Unigram(unigram.load_pieces(read_model(model_path(PIECE_MODEL))))


STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark, rows, sf, pieces):
    """Every stage over what brute force leaves of the one before."""

    def frame(some):
        return spark.createDataFrame(some, COLUMNS).repartition(4)

    got = STAGES["quality_rules"](spark, frame(rows), sf)
    after_rules = brute_rules(rows)
    assert got.columns == frame(rows).columns and tuples(got) == Counter(after_rules)
    got = STAGES["line_dedup"](spark, frame(after_rules), sf)
    after_lines = brute_lines(after_rules)
    assert tuples(got) == Counter(after_lines)
    got = tuples(STAGES["simhash_near_dedup"](spark, frame(after_lines), sf))
    unnamed, groups = brute_copies(after_lines)
    assert got.total() == len(unnamed) + len(groups) and all(any(got[r] for r in own) for own in groups)
    after_copies = list(got.elements())
    got = STAGES["benchmark_decontamination"](spark, frame(after_copies), sf)
    after_items = brute_items(after_copies)
    assert len(after_items) < len(after_copies) and tuples(got) == Counter(after_items)
    ids = {r.doc_id: r for r in STAGES["sentencepiece_encoding"](spark, frame(after_items), sf).collect()}
    for k, t, *_ in after_items:
        if len(t) < 1500:
            want = brute_unigram(pieces, t) if t else []
            assert ids[k].piece_ids == want and ids[k].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert ids[k].round_trip


def test_run(spark, rows, sf):
    """All stages; rows that are equal in id and text may stand for each other."""
    want_ids = Counter(r[0] for r in brute_items([x for part in (lambda c: [c[0], [own[0] for own in c[1]]])(brute_copies(brute_lines(brute_rules(rows)))) for x in part]))
    got = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in got.collect()) == want_ids
    assert sum(len(WORD.findall(r[1] or "")) for r in rows) > 10_000


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_over_nothing(spark, sf, name):
    none = spark.createDataFrame([], COLUMNS)
    got = STAGES[name](spark, none, sf)
    assert got.count() == 0 and (name == "sentencepiece_encoding" or got.columns == none.columns)


def test_sf_documents_exist(spark):
    assert spark.read.parquet(f"{SF}/documents.parquet").columns == ["doc_id", "text", "lang", "source", "n_chars"]
