"""Toxicity by weak supervision: many voters, a label model of their accuracies and correlations, a linear classifier."""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.shared import stored
from lintel.llm.words import columns, parts

#: Most labelled rows of a fold that entries of a lexicon are learned from, and most rows that the classifier is fitted on.
MOST_LABELLED, MOST_FITTED = 12_000, 20_000
#: An entry has to be so many times as frequent in toxic rows, and to be in so many of them.
LIFT, LEAST_ROWS = 40, 4
#: Toxic rows are covered by so many entries each; an entry has to help this share of them (and two rows).
COVER, HELPS = 4, 0.002
#: Rows with one crc32 remainder are held out: their labels are not read.
FOLDS, HELD_OUT = 3, 1
#: How many times a labelled row counts against an unlabelled one in the label model.
TRUST = 5
#: English insults.
INSULTS = ("idiot", "moron", "stupid", "pathetic", "worthless", "loser", "scum", "trash", "disgusting", "clown", "imbecile", "dumb", "vermin", "filthy", "bastard", "coward", "pig", "freak", "creep", "jerk", "fool", "ugly", "garbage", "parasite", "subhuman", "retard")
PATTERNS = (r"\byou (?:are|re) (?:such )?an? \w+ (?:and|piece)", r"\bshut up\b", r"\bhate (?:you|them)\b", r"\bgo (?:die|kill yourself)\b", r"\bkill (?:yourself|them all)\b")
#: Lengths of the beginnings of words that make up the pattern voters which are learned.
BEGINNINGS = (4, 5, 6, 7)
VOTERS = ("insults", "several insults", "phrases", "words, even", "words, odd", *(f"beginnings of {n}" for n in BEGINNINGS), "a beginning of several words", "several entries", "nothing found")
#: The folds that may be learned from: each gives entries, and tells how far to trust voters with the other's entries.
USABLE = tuple(x for x in range(FOLDS) if x != HELD_OUT)

_MARKS = {i: " " for i in [*range(33, 65), *range(91, 97), *range(123, 127)]}
_phrases = re.compile("|".join(PATTERNS))


def words_of(text: str) -> set[str]:
    return set(text.lower().translate(_MARKS).split())


def features(words: set[str]) -> set[str]:
    """All that may become an entry: words, beginnings of longer words, and beginnings that two words or more share."""
    out = set(words)
    for n in BEGINNINGS:
        times = Counter(w[:n] for w in words if len(w) > n)
        out.update(f"{n}:{x}" for x in times)
        out.update(f"2x{n}:{x}" for x, k in times.items() if k > 1)
    return out


@dataclass
class Lexicon:
    """Entries with their places, and what each voter says of a text."""

    entries: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.by = {n: ({x.partition(":")[2] for x in self.entries if x.startswith(f"{n}:")}, {x.partition(":")[2] for x in self.entries if x.startswith(f"2x{n}:")}) for n in BEGINNINGS}

    def found(self, text: str) -> tuple[list[int], int]:
        """Places of the entries in a text, and the votes, three to each voter, as one number."""
        words = words_of(text)
        own = [w for w in words if w in self.entries]
        hits, begun, several = [*own], [], False
        for n in BEGINNINGS:
            one, two = self.by[n]
            begins = {w[:n] for w in words if len(w) > n} if one or two else set()
            begun.append(bool(begins & one))
            hits += [f"{n}:{x}" for x in begins & one]
            for x in begins & two:
                if sum(w.startswith(x) and len(w) > n for w in words) > 1:
                    several = True
                    hits.append(f"2x{n}:{x}")
        insults = len(words & _INSULTS)
        toxic = [insults > 0, insults > 1, _phrases.search(text.lower()) is not None, *(any(zlib.crc32(w.encode()) % 2 == i for w in own) for i in (0, 1)), *begun, several, len(own) > 1 or len(hits) > 3]
        votes = [*map(int, toxic), 0 if any(toxic) else 2]
        return [self.entries[w] for w in hits], sum(v * 3**i for i, v in enumerate(votes))


_INSULTS = set(INSULTS)


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, fold): rows with a label that may be learned from, MOST_LABELLED of a fold at most, chosen by a
    hash of the id."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").withColumn("fold", fold)
    some = [known.where(F.col("fold") == x).orderBy(F.xxhash64("doc_id"), "toxic").limit(MOST_LABELLED) for x in USABLE]
    rows = functools.reduce(DataFrame.union, some).groupBy("doc_id", "fold").agg(F.max("toxic").alias("toxic"))
    return docs.where("doc_id is not null").where(~held_out(F.col("doc_id"))).join(F.broadcast(rows), "doc_id").select("doc_id", "text", "toxic", "fold")


def learn_lexicon(rows: DataFrame) -> tuple[Lexicon, int, int]:
    """Entries that mark toxic rows among labelled ones (text, toxic), and the numbers of toxic and of clean rows.

    Of the words and beginnings with enough lift, a greedy cover picks entries while they help rows that have fewer than
    COVER; words that only copies of one text share help no row that the true marks cover already.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for batch in parts(batches):
            for text, label in zip(*columns(batch, "text", "toxic"), strict=True):
                n[label] += 1
                (toxic if label else clean).update(features(words_of(text)))
        names = [*toxic, *(x for x in clean if x not in toxic), ""]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*(toxic[x] for x in names[:-1]), n[1]], pa.int64()), pa.array([*(clean[x] for x in names[:-1]), n[0]], pa.int64())], ["entry", "toxic", "clean"])

    counts = rows.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    some = counts.where(f"toxic >= {LEAST_ROWS} or entry = ''").where("entry = '' or clean * 20 <= toxic").collect()  # of MOST_LABELLED rows at most
    total = next((r for r in some if not r["entry"]), None)
    if not total or not total["toxic"] or not total["clean"]:
        return Lexicon(), total["toxic"] if total else 0, total["clean"] if total else 0
    able = {r["entry"] for r in some if r["entry"] and r["toxic"] / total["toxic"] >= LIFT * (r["clean"] + 0.5) / total["clean"]}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [sorted(able & features(words_of(text))) for text in columns(batch, "text")[0]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["found"])

    having: dict[str, list[int]] = defaultdict(list)
    for i, r in enumerate(rows.where("toxic = 1").select("text").distinct().mapInArrow(keep, "found array<string>").collect()):
        for x in r["found"]:
            having[x].append(i)
    need: dict[int, int] = defaultdict(lambda: COVER)
    chosen: dict[str, int] = {}
    least = max(2, HELPS * total["toxic"])
    gain = {x: len(r) for x, r in having.items()}
    while gain:
        x = max(gain, key=lambda y: (gain[y], len(y), y))
        now = sum(need[i] > 0 for i in having[x])
        if now < gain[x]:
            if now >= least:
                gain[x] = now
            else:
                del gain[x]
            continue
        del gain[x]
        if now < least:
            continue
        chosen[x] = len(chosen)
        for i in having[x]:
            need[i] -= 1
    return Lexicon(chosen), total["toxic"], total["clean"]


def merged(lexicons: list[Lexicon]) -> Lexicon:
    names = dict.fromkeys(x for lexicon in lexicons for x in lexicon.entries)
    return Lexicon({x: i for i, x in enumerate(names)})


def label_model(patterns: dict[int, int], known: dict[tuple[int, int], int], prior: float, rounds: int = 60) -> dict[int, float]:
    """The probability of label 1 for each pattern of votes, from how often each pattern occurs: in all rows, and
    with each label in `known` (rows that gave no entries; they count TRUST times).

    Expectation and maximisation over each voter's chances of its three votes under either label. Voters that agree more
    than their accuracies explain (correlated given the label) share their weight.
    """
    m = len(VOTERS)
    codes = np.asarray(sorted(patterns))
    votes = codes[:, None] // 3 ** np.arange(m) % 3
    n = np.asarray([patterns[c] for c in codes.tolist()], float)
    q = np.clip(np.where((votes[:, :-1] == 1).any(1), 0.6 + 0.05 * (votes == 1).sum(1), prior / 4), 0.001, 0.999)
    known_n = np.asarray([[known.get((c, y), 0) for c in codes.tolist()] for y in (0, 1)], float) * TRUST
    weight, share = np.ones(m), max(prior, 1e-4)
    for step in range(rounds):
        chance = np.empty((2, m, 3))
        for y, w in enumerate((n * (1 - q) + known_n[0], n * q + known_n[1])):
            for v in range(3):
                chance[y, :, v] = ((votes == v) * w[:, None]).sum(0) + (0.5 if v != 2 or y == 0 else 0.05)
        chance /= chance.sum(2, keepdims=True)
        log = np.log(chance)
        score = sum(weight[j] * (log[1, j, votes[:, j]] - log[0, j, votes[:, j]]) for j in range(m)) + np.log(share / (1 - share))
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if step % 10 == 9:
            corr = np.zeros((m, m))
            for w in (n * (1 - q), n * q):
                hit = (votes == 1).astype(float)
                mean = (hit * w[:, None]).sum(0) / max(w.sum(), 1e-9)
                cov = ((hit - mean) * w[:, None]).T @ (hit - mean) / max(w.sum(), 1e-9)
                scale = np.sqrt(np.clip(np.diag(cov), 1e-6, None))
                corr = np.maximum(corr, cov / scale[:, None] / scale)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.clip(corr, 0, 1).sum(1))
    return {int(c): float(x) for c, x in zip(codes, q, strict=True)}


def fit_linear(rows: list[tuple[list[int], int, float]], width: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression, by gradient steps, of posteriors on entries and votes (in columns behind the entries)."""
    cols = [[*hits, *_vote_columns(code, width)] for hits, code, _ in rows]
    at = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    col, y = np.asarray([x for c in cols for x in c], np.int64), np.asarray([r[2] for r in rows])
    size = width + 3 * len(VOTERS)
    w, b = np.zeros(size), 0.0
    m1, m2, g = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[col], len(rows)) + b, -30, 30)))
        e = (p - y) / max(len(rows), 1)
        g[:-1] = np.bincount(col, e[at], size) + 1e-5 * w
        g[-1] = e.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.1 * m1 / (1 - 0.9**t) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _vote_columns(code: int, width: int) -> list[int]:
    return [width + 3 * i + code // 3**i % 3 for i in range(len(VOTERS))]


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, posterior) for each row of docs.

    Labels (doc_id, toxic) are read only of rows that aren't held out. Each of the two folds that remain gives entries; its
    labels also tell how far to trust voters that have the other fold's entries, so that no row tells of what it was
    learned from. The votes of all rows, with the entries of both, are counted by pattern (3 ** voters at most), the label
    model turns patterns into posteriors, and a linear classifier fitted on posteriors of at most MOST_FITTED rows gives
    the score. Whole texts are scored, very long ones too; null and empty ones like any text without entries. A null
    doc_id is not held out. Repeated rows are scored each; a doc_id with labels 0 and 1 is toxic. Other columns, whatever
    their names, stay out; an empty table gives no rows. Without usable labels the fixed voters remain, with a prior of
    0.05. No text is shuffled.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known_rows = stored(labelled(docs, labels), "labelled")
    learned = {x: learn_lexicon(known_rows.where(F.col("fold") == x)) for x in USABLE}
    lexicon = merged([x for x, _, _ in learned.values()])
    toxic, every = sum(x[1] for x in learned.values()), sum(x[1] + x[2] for x in learned.values())
    prior = toxic / every if 0 < toxic < every else 0.05
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # entries of MOST_LABELLED rows a fold at most
    others = {x: merged([learned[y][0] for y in USABLE if y != x]) for x in USABLE}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [held.value.found(text) for text in columns(batch, "text")[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "hits", "code"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            codes = [others[fold].found(text)[1] for text, fold in zip(*columns(batch, "text", "fold"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), batch.column(batch.schema.get_field_index("toxic"))], ["code", "toxic"])

    votes = stored(docs.mapInArrow(vote, "doc_id long, hits array<int>, code long").withColumn("held_out", held_out(F.col("doc_id"))), "votes")
    patterns = {r["code"]: r["n"] for r in votes.groupBy("code").agg(F.count("*").alias("n")).collect()}
    trusted = known_rows.mapInArrow(judge, "code long, toxic int").groupBy("code", "toxic").agg(F.count("*").alias("n"))
    known = {(r["code"], r["toxic"]): r["n"] for r in trusted.collect()}  # of 3 ** voters at most
    # A pattern that only labelled rows show, with the other fold's entries, counts for the chances of votes as well.
    patterns |= {code: 0 for code, _ in known if code not in patterns} if patterns else {}
    posterior = label_model(patterns, known, prior) if patterns else {}
    part = int(1_000_000 * min(1.0, 0.9 * MOST_FITTED / max(1, sum(patterns.values()))))
    chosen = votes.where("doc_id is not null and not held_out").where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < part)
    sample = [(r["hits"], r["code"], posterior.get(r["code"], prior)) for r in chosen.select("hits", "code").limit(MOST_FITTED).collect()]
    width = len(lexicon.entries)
    w, b = fit_linear(sample or [([], c, q) for c, q in posterior.items()], width)
    model = docs.sparkSession.sparkContext.broadcast((w, b, posterior, prior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, posterior, prior = model.value
        for batch in parts(batches):
            hits, codes = columns(batch, "hits", "code")
            z = [b + w[[*x, *_vote_columns(code, width)]].sum() for x, code in zip(hits, codes, strict=True)]
            p = 1 / (1 + np.exp(-np.clip(np.asarray(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "held_out")), pa.array(p), pa.array((p >= 0.7).astype(np.int32)), pa.array([posterior.get(c, prior) for c in codes], pa.float64())], ["doc_id", "held_out", "score", "predicted", "posterior"])

    return votes.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, posterior double")
