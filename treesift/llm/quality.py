"""Quality rules, line first: each line is judged on its own, failing lines go, and a document that loses too much text is rejected.

A line without a word is neutral. Else it fails, by the first of these that applies:
- navigation: at least two separators (`|`, `»`, `›`, `·`, `•` or `>` as words of their own), and at most NAV_WORDS words
  between two on average; or a menu: MENU_WORDS or more words, all with a capital or digit first, and no sentence mark;
- punctuation: at least SYMBOL_SHARE of its words end in one of `#*$%&|<>`, or it has no sentence mark and
  either fewer than MIN_LINE_WORDS words or no end that may be one of a sentence, such as a colon;
- boilerplate: it holds a phrase of BOILERPLATE (any case, in four languages) and is shorter than BOILERPLATE_CHARS. Lines
  that many documents share are the line dedup's task.
A document is rejected if the failing lines hold more than MAX_LOSS of its word characters, or if base rules fail: fewer
than 10 words, or over 20 % of its words in repeated 5-word windows.

Null and empty texts have no words, so they fail the base rules. Repeated rows are judged alike. A document that loses
exactly MAX_LOSS stays. Texts are handled whole; a very long one is a chunk of its own. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import by_row, chunks, compact, id_field, ship, worker_cache

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
NAV_SEPARATORS = frozenset(["|", "»", "›", "·", "•", ">"])
NAV_WORDS, MENU_WORDS = 4, 4
SYMBOL_SHARE = 0.3
MIN_LINE_WORDS = 3
MAX_LOSS = 0.3
#: Phrases of site furniture, by language.
BOILERPLATE = {
    "en": ("all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "we use cookies", "uses cookies", "accept cookies", "cookie settings", "enable javascript", "click here", "read more", "sign up for our newsletter", "subscribe to our", "lorem ipsum", "back to top", "skip to content", "powered by", "follow us on", "share this", "leave a comment", "log in to", "forgot your password", "page not found"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "impressum", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "cookie-einstellungen", "verwendet cookies", "verwenden cookies", "cookies akzeptieren", "hier klicken", "klicken sie hier", "weiterlesen", "zum newsletter anmelden", "newsletter abonnieren", "nach oben", "zum inhalt springen", "passwort vergessen", "folgen sie uns", "jetzt anmelden", "javascript aktivieren"),
    "fr": ("tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "conditions générales", "gestion des cookies", "utilise des cookies", "utilisons des cookies", "accepter les cookies", "cliquez ici", "lire la suite", "en savoir plus", "abonnez-vous à", "inscrivez-vous à", "retour en haut", "aller au contenu", "mot de passe oublié", "suivez-nous", "partager cet article", "activer javascript"),
    "es": ("todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "condiciones de uso", "términos y condiciones", "política de cookies", "utiliza cookies", "utilizamos cookies", "aceptar cookies", "haga clic aquí", "haz clic aquí", "leer más", "suscríbete a", "suscríbase a", "volver arriba", "saltar al contenido", "olvidaste tu contraseña", "síguenos en", "habilitar javascript"),
}
BOILERPLATE_CHARS = 300
_MARKS = re.compile(r"[.!?…。！？]")
#: What a sentence may end in, and what may come behind it.
_ENDS = (".", "!", "?", "…", ":", ";", "。", "！", "？", "؟", "।")
_CLOSERS = " \t\n\x0b\x0c\r\"'”’»)]}*_"
_SYMBOL_ENDS = ("#", "*", "$", "%", "&", "|", "<", ">")
_SUSPECT = re.compile(r"[#*$%&|<>»›·•]")
_BLANK = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Bytes that begin a code point of a word.
_LETTER = ~_SPACE
_LETTER[0x80:0xC0] = False


def _phrases():
    """The automaton of all phrases, made once for each worker."""
    held = worker_cache()
    if "boilerplate" not in held:
        import ahocorasick

        made = ahocorasick.Automaton()
        for phrase in sorted({p for phrases in BOILERPLATE.values() for p in phrases}):
            made.add_word(phrase, phrase)
        made.make_automaton()
        held["boilerplate"] = made
    return held["boilerplate"]


def has_phrase(text: str) -> bool:
    return next(_phrases().iter(text.lower()), None) is not None


def ends_well(line: str) -> bool:
    return line.rstrip(_CLOSERS).endswith(_ENDS)


def line_failure(line: str) -> str | None:
    """The rule that a line fails: navigation, punctuation, boilerplate, or None."""
    words = _WORD.findall(line)
    n = len(words)
    if not n:
        return None
    separators = sum(w in NAV_SEPARATORS for w in words)
    if separators >= 2 and (n - separators) <= NAV_WORDS * (separators + 1):
        return "navigation"
    marked = _MARKS.search(line)
    if n >= MENU_WORDS and not marked and all(w[0].isupper() or w[0].isdigit() for w in words):
        return "navigation"
    if sum(w.endswith(_SYMBOL_ENDS) for w in words) >= SYMBOL_SHARE * n or (not marked and (n < MIN_LINE_WORDS or not ends_well(line))):
        return "punctuation"
    return "boilerplate" if len(line) < BOILERPLATE_CHARS and has_phrase(line) else None


def judge_lines(text: str) -> tuple[int, int, str]:
    """Duplicate lines, word characters in failing lines, and the text without them."""
    lines = text.split("\n")
    filled = [x for x in lines if x.strip(_BLANK)]
    duplicates = len(filled) - len(set(filled))
    # without a symbol or phrase anywhere, only a line without a sentence mark can fail
    suspect = bool(_SUSPECT.search(text)) or has_phrase(text)
    failing = [k for k, x in enumerate(lines) if (suspect or not _MARKS.search(x)) and line_failure(x)]
    if not failing:
        return duplicates, 0, text
    lost = sum(sum(map(len, _WORD.findall(lines[k]))) for k in failing)
    gone = set(failing)
    return duplicates, lost, "\n".join(x for k, x in enumerate(lines) if k not in gone)


def repeated_words(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row of words (codes), how many lie in a 5-word window that the row has at least twice."""
    n = len(codes)
    lens = np.diff(offsets)
    starts_ok = np.zeros(n, bool)
    if n:
        row = np.repeat(np.arange(len(lens)), lens)
        left = offsets[1:][row] - np.arange(n)
        starts_ok = left >= WINDOW
    at = np.flatnonzero(starts_ok)
    if not len(at):
        return np.zeros(len(lens), np.int64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    h = row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    wide = codes.astype(np.uint64)
    for k in range(WINDOW):
        h = (h ^ wide[at + k]) * mul
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    a, b = at[order[1:][same]], at[order[:-1][same]]
    equal = row[a] == row[b]
    for k in range(WINDOW):
        equal &= codes[a + k] == codes[b + k]
    twice = np.zeros(len(at), bool)
    if equal.all():
        twice[1:][same] = True
        twice[:-1][same] = True
        found = at[order[twice]]
    else:  # two windows share a hash: compare them whole
        whole = np.stack([row[at], *[codes[at + k] for k in range(WINDOW)]], axis=1)
        _, inverse, counts = np.unique(whole, axis=0, return_inverse=True, return_counts=True)
        found = at[counts[inverse.ravel()] > 1]
    step = np.bincount(found, minlength=n + 1) - np.bincount(found + WINDOW, minlength=n + 1)
    return by_row((np.cumsum(step[:-1]) > 0).astype(np.int64), offsets)


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The base figures of a chunk of texts (no nulls)."""
    split = pc.ascii_split_whitespace(text)
    flat = split.flatten()
    offsets = split.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    words = flat.filter(pa.array(real)).dictionary_encode().indices.to_numpy() if len(flat) else np.zeros(0, np.int64)
    n_words = by_row(real.astype(np.int64), offsets)
    word_offsets = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
    buffers = text.buffers()
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    ends = np.frombuffer(buffers[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    base = data[ends[0] : ends[-1]] if len(ends) else data[:0]
    ends = ends - ends[0]
    return {
        "n_words": n_words,
        "word_chars": by_row(_LETTER[base].astype(np.int64), ends),
        "n_symbols": by_row(_SYMBOL[base].astype(np.int64), ends),
        "n_repeat_words": repeated_words(words, word_offsets),
    }


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept, clean_text, carried columns) of every row; no shuffle."""
    ship(df.sparkSession)
    other = [c for c in df.columns if c in carry and c not in (id_col, text_col)]
    source = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *[F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(other)])
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = ", ".join([f"__id {id_field(df, id_col)}", *[f"{c} bigint" for c in figures], "base_failed boolean", "lost_chars bigint", "kept boolean", "clean_text string", *[f"__c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(other)]])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treesift.llm.quality import MAX_LOSS, MAX_REPEAT_PERCENT, MIN_WORDS, judge_lines, measure

        for b in chunks(batches, "__text"):
            text = compact(b.column(1))
            m = measure(text)
            duplicates, lost, clean = zip(*map(judge_lines, text.to_pylist()), strict=True)
            lost = np.array(lost, np.int64)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
            kept = ~failed & (lost <= MAX_LOSS * m["word_chars"])
            arrays = [b.column(0), *[pa.array(m[c]) if c in m else pa.array(np.array(duplicates, np.int64)) for c in figures]]
            arrays += [pa.array(failed), pa.array(lost), pa.array(kept), pa.array(clean, pa.string()), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["__id", *figures, "base_failed", "lost_chars", "kept", "clean_text", *b.schema.names[2:]])

    done = source.mapInArrow(judge, schema)
    return done.select(F.col("__id").alias(id_col), *figures, "base_failed", "lost_chars", "kept", "clean_text", *[F.col(f"__c{k}").alias(c) for k, c in enumerate(other)])
