"""Quality rules, line first: lines that fail a rule are removed, then documents that lose too much are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.shared import rows_of
from lintel.llm.words import parts, shingles, texts, word_hashes

SYMBOLS = b"#*$%&|<>"
#: Lower-case parts, in ASCII, of lines that frame a page instead of saying something: English, French, German, Spanish.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our newsletter", "click here to", "sign up for", "skip to content",
    "politique de confidentialit", "politique de cookies", "mentions l.gales", "conditions d.utilisation", "tous droits r.serv", "activer javascript", "cliquez ici", "aller au contenu",
    "datenschutzerkl", "cookie-richtlinie", "nutzungsbedingungen", "alle rechte vorbehalten", "impressum", "javascript aktivieren", "hier klicken", "zum inhalt springen",
    "de privacidad", "de cookies", "aviso legal", "rminos de uso", "condiciones de uso", "todos los derechos reservados", "active javascript", "haga clic", "saltar al contenido",
)
#: What separates entries of a menu, and what a sentence ends with.
BARS, ENDS = "|\u203a\u2022\u00b7", ".!?:;,)]\"'\u2026\u00bb\u201d\u2019\u3002\uff01\uff1f"
#: Words from which a line is prose, however it ends.
PROSE = 20
#: Percent of the characters of lines with a word that a document may lose.
MOST_LOST = 40
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_lines_removed long, lost_chars long, line_chars long, kept boolean, cleaned string"

_phrases = re.compile("|".join(BOILERPLATE))
_bars = re.compile(f"[{re.escape(BARS)}]")


def line_fails(line: bytes) -> bool:
    """The rules for a line with a word. Punctuation: under PROSE words, and no mark at its end that ends a sentence,
    a part of one or a quote. Symbols: more than one for two words. Exclamations: more than one run of '!!' for two words. Navigation: two bars or
    more, and one for every four words. Boilerplate: one of the phrases, where letters beyond ASCII may be any."""
    words = len(line.split())
    written = line.decode()
    return (
        words < PROSE and written.rstrip(" \t\x0b\x0c\r")[-1:] not in ENDS
        or 2 * (len(line) - len(line.translate(None, SYMBOLS))) > words
        or 2 * line.count(b"!!") > words
        or (bars := len(_bars.findall(written))) >= 2 and 4 * bars >= words
        or _phrases.search(written.lower()) is not None
    )


def judge(raw: bytes) -> tuple:
    """The measures and verdict for one text."""
    words = raw.split()
    n = len(words)
    chars = len(raw.decode()) - len(raw) + sum(map(len, words))
    lines = raw.split(b"\n")
    full = [x for x in lines if x.split(None, 1)]
    repeated = 0
    if n > 3:
        grams = shingles(word_hashes(raw), 3)
        _, which, times = np.unique(grams, return_inverse=True, return_counts=True)
        twice = times[which] >= 2
        if twice.any():
            hit = np.zeros(n, bool)
            for i in range(3):
                hit[i : i + len(grams)] |= twice
            repeated = int(hit.sum())
    failed = n < 50 or 100 * repeated > 50 * n
    bad = {x for x in set(full) if line_fails(x)}
    gone = [x for x in full if x in bad]
    lost, total = (len(b"".join(x).decode()) for x in (gone, full))
    cleaned = raw if not gone else b"\n".join(x for x in lines if x not in bad)
    kept = not failed and 100 * lost <= MOST_LOST * total
    return n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(full) - len(set(full)), repeated, failed, len(full), len(gone), lost, total, kept, cleaned


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs with its measures, `kept`, and the `cleaned` text (what is left of the lines).

    Words are `[^\\x20\\x09-\\x0D]+`. A null text counts as an empty one: no words, base_failed, not kept. A null key stays
    null; repeated rows are judged each. Very long texts are read whole. Other columns, whatever their names, stay out; an
    empty table gives no rows. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = SCHEMA.replace(",", "").split()[::2]
        types = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.binary()}[x] for x in SCHEMA.replace(",", "").split()[1::2]]
        for batch in parts(batches):
            found = [*zip(*map(judge, texts(batch)), strict=True)]
            arrays = [batch.column(0), *(pa.array(list(x), kind) for x, kind in zip(found, types[1:], strict=True))]
            arrays[-1] = arrays[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows_of(docs, key, text).mapInArrow(run, SCHEMA)


def apply_quality(docs: DataFrame) -> DataFrame:
    """The pipeline stage: rejected documents (all with a null text among them) go, the others keep all their columns, and
    the text that is left of their lines. Repeated rows and rows without an id are judged each; an empty table stays empty."""
    # The verdict travels with the row, so that no join is needed to take the other columns along.
    fields = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at, size = fields.index("text"), fields.index("n_chars") if "n_chars" in fields else None
            raw = batch.column(at).cast(pa.binary()).to_pylist()
            seen = [judge(x or b"") for x in raw]
            keep = pa.array([x[-2] for x in seen], pa.bool_())
            arrays = list(batch.columns)
            arrays[at] = pa.array([x[-1] for x in seen], pa.binary()).cast(pa.string())
            if size is not None:
                arrays[size] = pa.array([len(x[-1].decode()) for x in seen], pa.int64())
            yield pa.RecordBatch.from_arrays(arrays, fields).filter(keep)

    kinds = docs.withColumn("text", F.coalesce("text", F.lit("")))
    if "n_chars" in fields:
        kinds = kinds.withColumn("n_chars", F.col("n_chars").cast("long"))
    return kinds.mapInArrow(run, kinds.schema)
