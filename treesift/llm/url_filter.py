"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A term counts only between boundaries (start, end or a character outside a-z and 0-9 of the lower-cased url). One
strict term blocks, and so do distinct soft terms whose weights add up to 1 (with the weights of the file, two of them).
Terms come from a versioned file, `url_terms.tsv`, or from the caller. The automaton is made once for each worker.

Of rules that fit, the longest wins; of equally long ones the first in the list. A null url, or one without '://', has an
empty host and path and no rule; its whole string is still searched for terms. Repeated rows each get the same answer.
Urls are handled whole, whatever their length. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import id_field, ship, worker_cache

#: Fixed values: (host, path, verdict) of the rules.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
TERMS_FILE = Path(__file__).with_name("url_terms.tsv")
#: The sum of weights from which a url is blocked.
LIMIT = 1.0


def read_terms(text: str) -> tuple[tuple[str, bool, float], ...]:
    """(term, whether it is strict, weight) of each line `term<TAB>strict|soft<TAB>weight`; `#` starts a comment. ValueError for another line, or a term given twice."""
    found: dict[str, tuple[str, bool, float]] = {}
    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        term, kind, weight = line.split("\t")
        if kind not in ("strict", "soft") or term in found or term != term.lower() or not term:
            raise ValueError(f"bad line {line!r}")
        found[term] = (term, kind == "strict", float(weight))
    return tuple(found.values())


@cache
def default_terms() -> tuple[tuple[str, bool, float], ...]:
    """The terms of the file; read on the driver only, as executors have this package in an archive."""
    return read_terms(TERMS_FILE.read_text(encoding="utf-8"))
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end].translate(_ASCII_LOWER), rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host, tail[:stop]


class Rules:
    """Rules by host; looks only at the suffixes of a url's host that start at a label."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, str, str] | None = None
        labels = host.split(".")
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start) and (best is None or len(suffix) + len(start) > best[0]):
                    best = (len(suffix) + len(start), suffix + start, verdict)
        return (best[1], best[2]) if best else (None, None)


class Vocabulary:
    """Counts of strict and weights of soft terms in a url."""

    def __init__(self, terms: Sequence[tuple[str, bool, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, is_strict, weight in terms:
            self.automaton.add_word(term, (term, is_strict, weight))
        self.empty = not terms
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, url: str | None) -> tuple[int, int, float]:
        """Occurrences of strict terms, distinct soft terms and the sum of their weights."""
        if not url or self.empty:
            return 0, 0, 0.0
        low, strict, soft = url.translate(_ASCII_LOWER), 0, {}
        for last, (term, is_strict, weight) in self.automaton.iter(low):
            first = last - len(term) + 1
            if (first and low[first - 1] in _ALNUM) or (last + 1 < len(low) and low[last + 1] in _ALNUM):
                continue
            if is_strict:
                strict += 1
            else:
                soft[term] = weight
        return strict, len(soft), sum(soft.values())


def vocabulary(terms: Sequence[tuple[str, bool, float]]) -> Vocabulary:
    held, key = worker_cache(), ("url vocabulary", tuple(terms))
    if key not in held:
        held[key] = Vocabulary(terms)
    return held[key]


def url_verdicts(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    terms: Sequence[tuple[str, bool, float]] | None = None,
    limit: float = LIMIT,
) -> DataFrame:
    """(id, host, path, rule, verdict, n_strict, n_soft, soft_weight) of every row; no shuffle, only the two columns are read."""
    ship(df.sparkSession)
    terms = default_terms() if terms is None else tuple(terms)
    schema = f"__id {id_field(df, id_col)}, host string, path string, rule string, verdict string, n_strict int, n_soft int, soft_weight double"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treesift.llm.url_filter import Rules, split_url, vocabulary

        table, words = Rules(rules), vocabulary(terms)
        for b in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [], [])
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                name, said = table.find(host, path)
                strict, soft, weight = words.hits(url)
                row = (host, path, name, said or ("block" if strict or weight >= limit - 1e-9 else "allow"), strict, soft, weight)
                for values, value in zip(columns, row, strict=True):
                    values.append(value)
            kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["__id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"])

    return df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").cast("string").alias("url")).mapInArrow(judge, schema).withColumnRenamed("__id", id_col)


def oracle_sql() -> str:
    """The whole query in SQL, for the default rules and terms."""

    def any_of(terms: Sequence[str]) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9])({'|'.join(terms)})($|[^a-z0-9])')"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in ordered]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, ordered, strict=True))
    said = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, ordered, strict=True))
    strict = [t for t, is_strict, _ in default_terms() if is_strict]
    # of the soft terms that a url has anywhere, those between boundaries
    soft = " + ".join(f"CASE WHEN contains(low, '{t}') AND {any_of([t])} THEN {w} ELSE 0 END" for t, is_strict, w in default_terms() if not is_strict)
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
       CASE {said} WHEN {any_of(strict)} OR ({soft}) >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""
