import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lintel.llm import chat, chunks, decontam, line_dedup, ngram_join, packing, quality, suffixes, toxicity, warc
from lintel.llm.shared import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and long texts, ties, repeated rows.
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", None, "s", 5), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (4, "word " * 20000, "en", "t", 100000), (5, " \n\t\n", "en", "s", 4), (None, None, None, None, None)]
CLASH = ["id", "h", "n", "items", "at", "a", "b", "line", "component", "rank", "part", "site", "n_lines", "starts", "kept"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).select("*", *(F.lit("x").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def texts(n, seed, words=60):
    rnd = random.Random(seed)
    base = [" ".join("".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(5, words))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = rnd.choice(["zz", "yy", w[0]])
        out.append((i, " ".join(w)))
    return out


def linked(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, k, percent):
    rows = [*texts(160, k), (900, "one two"), (901, "ONE two"), (902, ""), (903, "one"), (904, "a b c " * 5000)]
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == linked(rows, k, percent)


def test_ngram_join_odd(spark, odd, none):
    got = sorted(((r[0] or 0), r[1], r[2]) for r in ngram_join.ngram_components(odd).collect())
    assert got == [(0, 0, None), (0, 1, 3), (1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (4, 1, 4), (5, 0, 5)]
    assert ngram_join.ngram_components(none).count() == 0
    assert ngram_join.one_of_each(spark.createDataFrame(ODD, DOCS)).columns == [x.split()[0] for x in DOCS.split(", ")]


def test_one_of_each(spark, none):
    rnd = random.Random(13)
    a, b, c, d = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(4))
    rows = [(7, a, "en", "s", 1), (7, a, "en", "s", 1), (7, a, "en", "t", 1), (8, a + " more", "en", "s", 1), (None, a, None, None, None), (None, b, "en", "s", 1), (None, b, "en", "s", 1), (None, b + " more", "en", "s", 1), (9, c, "en", "s", 1), (2**40, d, "en", "s", 1), (None, d, "en", "s", 1), (3, "", "en", "s", 0), (4, None, "en", "s", 0), (None, "", "en", "s", 0), (None, "", "en", "s", 0)]
    got = Counter(tuple(r) for r in ngram_join.one_of_each(spark.createDataFrame(rows, DOCS)).collect())
    assert Counter(r[0] for r in got.elements()) == {7: 1, 9: 1, 2**40: 1, 3: 1, 4: 1, None: 3} and set(got) <= set(rows)
    assert sum(n for r, n in got.items() if r[0] is None and r[1]) == 1 and got[None, "", "en", "s", 0] == 2
    assert Counter(r["doc_id"] for r in ngram_join.one_of_each(spark.createDataFrame(ODD, DOCS)).collect()) == Counter([1, 2, 3, 4, 5, None])
    assert ngram_join.one_of_each(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 260)}


def test_suffix_array():
    rnd = random.Random(4)
    for _ in range(200):
        d = bytes(rnd.choice(b"ab" if rnd.random() < 0.5 else b"abcz\xff\x00") for _ in range(rnd.randrange(90)))
        assert suffixes.suffix_array(d, 1000).tolist() == sorted(range(len(d)), key=lambda i: d[i:])


def brute_repeats(rows, length):
    seen = Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), len(t) - len(kept), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1 << 20, 500])
def test_suffix_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_BYTES", most)
    rnd = random.Random(most)
    passage = "".join(rnd.choice("abcdefgh é") for _ in range(700))
    rows = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 600))) + passage[rnd.randrange(200) : rnd.randrange(400, 700)] + "".join(rnd.choice("xyz ") for _ in range(300)) for _ in range(25)]
    rows += [passage, passage, "q" * 900, "ab" * 500, "", "short"]
    got = suffixes.repeats(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute_repeats([x.encode() for x in rows], 400)


def brute_shared(rows, length):
    held = defaultdict(set)
    for n, t in rows:
        for i in range(len(t) - length + 1):
            held[t[i : i + length]].add(n)
    return [len({j for i in range(len(t) - length + 1) if len(held[t[i : i + length]]) > 1 for j in range(i, i + length)}) for _, t in rows]


@pytest.mark.parametrize("most", [1 << 20, 500])
def test_suffix_shared(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_BYTES", most)
    rnd = random.Random(most + 1)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(3, 7))) for _ in range(n))
    short, long, line = words(51), words(120), words(16)  # of under 400 bytes, of more, no passage
    assert 256 <= len(short.encode()) < 400 < len(long.encode()) and len(line.encode()) < 256
    rows = [(i, " ".join(x)) for i, x in enumerate([(words(30), short, words(40)), (words(50), short), (short, words(9), line, words(20))])]
    rows += [(3, f"{long} {words(3)} {long}"), (4, f"{words(30)} {line} {words(60)}"), (5, "ab" * 500), (6, "q" * 300), (7, "q" * 300)]
    rows += [(8, f"{words(20)} {long[50:]} {words(20)}"), (9, words(80)), (9, rows[0][1][:280] + words(50)), (10, words(90) + "q" * 257)]
    rows += [(11 + i, long[rnd.randrange(200) :][: rnd.randrange(200, 460)] + words(40)) for i in range(12)] + [(40, ""), (41, line), (42, words(50)), (42, rows[4][1])]
    rows += [(43, long), (44, long), (45, short[:255]), (46, "z" + short[:256])]
    got = suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    raw = [(i, t.encode()) for i, t in rows]
    want = [(i, *x, n) for (i, _), x, n in zip(raw, brute_repeats([t for _, t in raw], 400), brute_shared(raw, 256), strict=True)]
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    verdict = {r["doc_id"]: (r["n_removed"] > 0, r["n_shared"] > 0) for r in got}
    assert [verdict[i] for i in (0, 1, 2, 5, 41)] == [(False, True)] * 3 + [(True, False), (False, False)]


def test_suffix_anchors():
    rnd = random.Random(9)
    for length, raw in [(60, bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(60, 400)))) for _ in range(60)] + [(60, b"q" * 200), (60, b"abc" * 60), (256, rnd.randbytes(3000)), (60, b"q" * 60)]:
        start, number, value, at, twice = suffixes.anchors(raw, length)
        assert sum(number) == len(raw) - length + 1
        whole = lambda b: suffixes.anchors(b, 32)[2][0]  # noqa: E731  the only hash of 32 bytes
        h = [int(whole(raw[i : i + 32])) for i in range(len(raw) - 31)]
        for s, n, v, a, t in zip(start.tolist(), number.tolist(), value.tolist(), at.tolist(), twice.tolist(), strict=True):
            assert all(min(h[i : i + length - 31]) == v for i in range(s, s + n))
            span = h[s : s + n + length - 32]
            assert span.index(v) == a and t == (span.count(v) > 1)


def test_spans_odd(odd, none):
    for f in (suffixes.repeats, chunks.dedupe_chunks):
        got = f(odd).collect()
        assert len(got) == len(ODD) and f(none).count() == 0
        assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] and hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)
        assert [r["n_removed"] for r in got if r["doc_id"] in (1, 2, 3, 5)] == [0] * 5


def test_chunks(spark):
    rnd = random.Random(7)
    raw = rnd.randbytes(5000)
    h, want = 0, []
    for b in raw:
        h = (2 * h + int(chunks._GEAR[b])) % 2**32
        want.append(h)
    assert chunks.gear(raw).tolist() == want
    ends = chunks.bounds(raw)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == 5000 and max(sizes) <= chunks.MOST and min(sizes[:-1]) >= chunks.LEAST
    shifted = {raw[:77][:0] + x for x in (raw,)}
    inserted = b"!" * 13 + raw
    cut = lambda d: {d[a:b] for a, b in zip([0, *chunks.bounds(d)], chunks.bounds(d), strict=False)}
    assert shifted and len(cut(raw) & cut(inserted)) >= 0.9 * len(cut(raw))


def brute_chunks(rows, least):
    """{row: (n_bytes, n_removed, n_spans, sha256, n_shared)} from sets of pairs of chunks, byte by byte."""
    place = lambda i, d: d if d is not None else -(2**62)
    held = defaultdict(set)
    pairs = {}
    for i, (d, t) in enumerate(rows):
        raw = (t or "").encode()
        ends = chunks.bounds(raw)
        cut = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        pairs[i] = [(sum(map(len, cut[:j])), cut[j] + cut[j + 1]) for j in range(len(cut) - 1)] if len(cut) > 1 else [(0, x) for x in cut]
        for _, x in pairs[i]:
            held[x].add(place(i, d))
    out = []
    for i, (d, t) in enumerate(rows):
        raw = (t or "").encode()
        flags = {}
        for name, test in (("gone", lambda x: min(held[x]) < place(i, d)), ("shared", lambda x: len(held[x]) > 1)):
            hit = bytearray(len(raw))
            for at, x in pairs[i]:
                if test(x):
                    hit[at : at + len(x)] = b"x" * len(x)
            runs = bytes(hit).replace(b"\0", b" ").split(b" ")
            for run in runs:
                if 0 < len(run) < least:
                    at = bytes(hit).index(b"\0" + run + b"\0") + 1 if b"\0" + run + b"\0" in hit else 0 if hit.startswith(run + b"\0") or len(run) == len(hit) else len(hit) - len(run)
                    hit[at : at + len(run)] = bytes(len(run))
            flags[name] = hit
        kept = bytes(c for c, g in zip(raw, flags["gone"], strict=True) if not g)
        out.append((d, len(raw), len(raw) - len(kept), len(bytes(flags["gone"]).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest(), flags["shared"].count(b"x")))
    return out


def test_chunk_dedup(spark):
    rnd = random.Random(7)
    word = lambda c, n: " ".join(f"{c}{rnd.randrange(10**6)}" for _ in range(n))
    passage, line, junk = word("w", 80), word("l", 9), word("j", 40)
    rows = [(i, word("v", 60) + " " + passage[: rnd.choice([len(passage), 300])] + " " + word("v", 20)) for i in range(6)]
    rows += [(9, "clean " + word("u", 60)), (10, f"{line}\n{word('u', 30)}"), (11, f"{line}\n{word('u', 30)}"), (12, f"{junk} " * 5), (None, passage), (None, passage), (13, None), (14, "")]
    rows += [(15, rows[1][1]), (15, word("u", 30) + passage), (16, "short copy"), (17, "short copy"), (18, rows[0][1] * 50)]
    got = Counter(tuple(r)[:6] for r in chunks.dedupe_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(brute_chunks(rows, chunks.LEAST_RUN))
    by = {r[0]: r for r in got}
    assert all(by[i][2] == 0 and by[i][5] == 0 for i in (9, 10, 11, 12)) and all(by[i][2] > 100 for i in range(6)) and by[15][5] > 0


def test_packing(spark, odd, none):
    path = vocabulary()
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(path).encode
    rnd = random.Random(5)
    ids = packing.ChunkIds(path)
    for _ in range(500):
        t = "".join(rnd.choice("aB é ß\n\t 's't12,.!Σς́日\x1c\u0085e") for _ in range(rnd.randrange(30)))
        assert ids.of(t) == ids.whole(t)
    rows = packing.pack(odd, path).collect()
    by, want = defaultdict(list), Counter()
    for d, t, *_ in ODD:
        whole = [*encode(t or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(whole), 2048):
            part = whole[i : i + 2048]
            want[d, i // 2048, i, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, path).count() == 0


def test_plan_is_whole_and_tight():
    rnd = random.Random(6)
    for n in (0, 1, 7, 300, 20000):
        counts = Counter(min(2048, max(1, int(rnd.lognormvariate(6, 1)))) for _ in range(n))
        runs, sequences = packing.plan(dict(counts))
        placed, used = Counter(), Counter()
        for length, rank, k, first, offset in runs:
            placed[length] += k
            if n <= 300:
                for i in range(k):
                    used[first + i] += length
        assert placed == counts and all(x <= 2048 for x in used.values())
        assert sequences <= 1.02 * sum(k * v for k, v in counts.items()) / 2048 + 2


def test_line_dedup(spark, odd, none):
    line = "all these words are on every page"
    rows = [(i, f"own {i} text that is long enough to stay\n{line}", "en", f"s{i % 6}", None) for i in range(12)] + [(50, line, "en", None, None), (51, f"{line}\n{line}", "en", "s1", None), (52, "near the threshold line", "en", "s1", None), *((60 + i, f"only here {i} and a few more words\nfour sites have this", "en", f"s{i}", None) for i in range(4))]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i]["text"] == f"own {i} text that is long enough to stay" and got[i]["n_removed"] == 1 for i in range(12))
    assert got[50]["text"] == "" and got[51]["text"] == "" and got[51]["n_removed"] == 2 and got[51]["lost_chars"] == 2 * len(line) + 1 and got[60]["n_removed"] == 0
    assert line_dedup.line_dedup(odd).count() == len(ODD) and line_dedup.line_dedup(none).count() == 0
    assert [r["text"] for r in line_dedup.line_dedup(odd).where("doc_id = 1").collect()] == [None]


def test_line_dedup_stage_leaves_only_copies_whole(spark, odd, none):
    rnd = random.Random(12)
    words = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    menu, foot, copy, edited = words(20), words(20), [words(12) for _ in range(3)], [words(12) for _ in range(20)]
    near = ["\n".join([*edited[:i], edited[i] + " edited", *edited[i + 1 :]]) for i in range(6)]
    rows = [*(f"{menu}\nown words of page {i}\n{foot}" for i in range(6)), *["\n".join(copy)] * 6, *near, f"{menu}\n{foot}"]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 6}", len(t)) for i, t in enumerate(rows)], DOCS)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.apply_line_dedup(docs).collect()}
    want = [*(f"own words of page {i}" for i in range(6)), *rows[6:18], ""]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}
    assert line_dedup.apply_line_dedup(odd).count() == len(ODD) and line_dedup.apply_line_dedup(none).count() == 0


def test_quality(odd, none):
    got = {r["doc_id"]: r for r in quality.quality(odd).collect()}
    assert got[4]["base_failed"] and got[4]["n_repeat_words"] == 20000 and got[1]["n_words"] == 0 and not got[5]["kept"]
    n, chars, symbols, dup, rep, failed, *_, kept, cleaned = quality.judge(("a b c x\na b c x\nmenu | home | about\n" + "é" * 3 + " word" * 3).encode())
    assert (n, symbols, dup, rep, failed, kept) == (17, 2, 1, 8, True, False) and chars == 38 and b"menu" not in cleaned
    good = " ".join(f"word{i}" for i in range(60)) + "."
    assert all(quality.line_fails(x.encode()) for x in ("A heading without an end", "Startseite \u203a Hilfe \u203a Suche.", "Alle Rechte vorbehalten.", "Todos los derechos reservados.", "Mentions l\u00c9gales et tout le reste.", "Buy!! now!!"))
    assert not any(quality.line_fails(x.encode()) for x in ("A sentence.", "\u00ab Oui. \u00bb", "so it goes," , "word " * 20, "\u4f60\u597d\u3002", "One bar | here it is, on its own."))
    assert quality.judge(good.encode())[-2] and not quality.judge((good + "\n" + "Buy!! now!! " * 60).encode())[-2]
    assert quality.quality(none).count() == 0 and quality.apply_quality(none).count() == 0


def test_decontamination(spark, odd, none):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 50)))) for i in range(30)] + [(98, ""), (99, None), (None, "an item without id here now")]
    docs = []
    for i in range(60):
        own = [rnd.choice(words) for _ in range(80)]
        if i % 3 == 0:
            part = items[i % 30][1].split()
            if i % 2 and len(part) > 40:
                part[3] = "edited"
            own[20:20] = part
        docs.append((i, " ".join(own).upper() + "."))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert all((i % 30 in got[i]["item_ids"]) == (i % 3 == 0) for i in range(60)) and not any(got[i]["contaminated"] for i in range(60) if i % 3)
    assert decontam.decontaminate(odd, bench).count() == len(ODD) and decontam.decontaminate(none, bench).count() == 0
    assert decontam.apply_decontamination(odd, bench.where("false")).count() == len(ODD)


def brute_items(rows, items):
    """(row, item) with a window as long as the item that holds 0.8 of its weighted shingles: every window of every text."""
    split = lambda t: "".join(" " if ord(c) < 127 and not c.isalnum() else c for c in t.lower()).split()
    grams = lambda w, k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
    words = {i: split(t or "") for i, t in items}
    words = {i: w for i, w in words.items() if w}
    sets = {i: grams(w, min(5, len(w))) for i, w in words.items()}
    held = Counter(g for x in sets.values() for g in set(x))
    weight = {g: math.log(1 + len(words) / n) for g, n in held.items()}
    out = set()
    for d, t in rows:
        w = split(t or "")
        for i, own in words.items():
            m, k, total = len(own), min(5, len(own)), sum(weight[g] for g in set(sets[i]))
            if 2 * len(w) >= m and len(w) >= k:
                for s in range(max(1, len(w) - m + 1)):
                    if sum(weight[g] for g in set(grams(w[s : s + m], k)) & set(sets[i])) >= 0.8 * total - 1e-12:
                        out.add((d, i))
                        break
    return out


@pytest.mark.parametrize("most", [decontam.ITEM_BYTES, 12_000])
def test_decontamination_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "ITEM_BYTES", most)
    rnd = random.Random(14)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 12, 25, 25, 40, 60])))) for i in range(40)]
    items += [(40, items[5][1]), (41, items[7][1] + " w1"), (42, "la la la la la la la la la")]
    rows = []
    for d in range(240):
        own = [rnd.choice(words) for _ in range(rnd.randrange(90))]
        for _ in range(rnd.randrange(3)):
            part = rnd.choice(items)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                kind, at = rnd.randrange(3), rnd.randrange(len(part))
                part[at : at + (kind != 0)] = [] if kind == 1 else ["edited"]
            own[len(own) // 2 : len(own) // 2] = part
        rows.append((d, " ".join(own)))
    rows += [(500, None), (501, ""), (502, "la " * 4000), (503, " ".join(words * 30) + " " + items[3][1])]
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found, want = {(r["doc_id"], i) for r in got for i in r["item_ids"]}, brute_items(rows, items)
    assert found <= want and len(found) >= 0.98 * len(want) and len(want) > 100


def test_fingerprint_blocks_find_all_within_the_radius():
    rnd = random.Random(9)
    rows = [(i, 9, [rnd.getrandbits(63) for _ in range(5)], [1.0] * 5) for i in range(50)]
    items = decontam.Items(rows, 1.0)
    prints = items.of_size[9][1]
    for _ in range(300):
        i = rnd.randrange(50)
        mine = prints[i].copy()
        for bit in rnd.sample(range(decontam.BITS), rnd.choice([0, 5, decontam.RADIUS])):
            mine[bit // decontam.BLOCK] ^= 1 << bit % decontam.BLOCK
        assert items.alike(9, mine) == [j for j in range(50) if sum(map(int.bit_count, (prints[j] ^ mine).tolist())) <= decontam.RADIUS]


def test_toxicity(spark, odd, none):
    rnd = random.Random(10)
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 9 == 0
        w = [f"w{rnd.randrange(400)}" for _ in range(40)]
        if toxic:
            w[5] = rnd.choice(["idiot", "grolfa", "grolfo", "grolfi"])
            w[9] = rnd.choice(["moron", "grolfe", "grolfu"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    right = [r["predicted"] == int(r["doc_id"] % 9 == 0) for r in got if r["held_out"]]
    assert sum(right) / len(right) > 0.97 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert toxicity.toxicity(odd, known).count() == len(ODD) and toxicity.toxicity(none, known).count() == 0
    assert toxicity.toxicity(docs, known.where("false")).count() == 1500


def test_warc_salvage():
    recs = [warc.record(f"urn:x:{i}", f"http://h/{i}", f"<p>{i}</p>".encode() * 9, None) for i in range(4)]
    packed = [*map(warc.member, recs)]
    kinds = lambda data: [(f["kind"], f.get("record_id")) for _, _, f in warc.salvage(data)]
    every = [("response", f"urn:x:{i}") for i in range(4)]
    assert kinds(b"".join(packed)) == every and kinds(b"".join(recs)) == every and kinds(warc.member(b"".join(recs))) == every and kinds(b"") == []
    torn = bytearray(packed[1])
    torn[len(torn) // 2] ^= 255
    got = [*warc.salvage(packed[0] + bytes(torn) + packed[2] + packed[3][:-9])]
    assert [(f["kind"], f.get("record_id")) for _, _, f in got] == [every[0], ("gap", None), every[2], ("gap", None)]
    assert got[1][:2] == (len(packed[0]), len(packed[0]) + len(torn)) and got[3][1] == len(packed[0] + torn + packed[2]) + len(packed[3]) - 9
    bad = recs[1].replace(b"<p>1</p>", b"<p>!</p>", 1)
    assert kinds(recs[0] + bad + recs[2]) == [every[0], ("gap", None), every[2]]
    assert kinds(b"junk\n" + recs[0] + recs[1][:50]) == [("gap", None), every[0], ("gap", None)]


def test_warc_salvage_behind_a_tear():
    page = b"<p>cut here, says WARC/1.1\r\n</p>" * 3
    recs = [warc.record(f"urn:x:{i}", f"http://h/{i}", page + b"%d" % i, "urn:x:0" if i == 1 else None) for i in range(4)]
    for torn in (recs[1], recs[2]):
        for cut in range(1, len(torn)):
            data = recs[0] + torn[:cut] + recs[3] + recs[2]
            want = [(0, len(recs[0]), "urn:x:0"), (len(recs[0]) + cut, len(recs[0]) + cut + len(recs[3]), "urn:x:3"), (len(data) - len(recs[2]), len(data), "urn:x:2")]
            assert [(a, b, f["record_id"]) for a, b, f in warc.salvage(data) if f["kind"] != "gap"] == want
            got = [f["record_id"] for _, _, f in warc.salvage(warc.member(recs[0]) + warc.member(data)) if f["kind"] != "gap"]
            assert got == ["urn:x:0", "urn:x:0", "urn:x:3", "urn:x:2"]


def test_warc_round_trip(spark):
    pages = [(1, "http://a/ b\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70000), (None, "u", "<p>same</p>"), (6, "u", "six")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("first", F.lit(1)).withColumn("sha", F.lit(1))
    got = {r["page_id"]: r for r in warc.round_trip(rows).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 2)}
    assert all(r["payload_digest"] == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() and r["payload_bytes"] == len((h or "").encode()) for k, _, h in pages for r in [got[k]])
    assert warc.round_trip(rows.where("false")).count() == 0


CONV = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    call = lambda i, name, **a: f'<tool_call>{{"id":"{i}","name":"{name}","arguments":{chat.canonical(a)}}}</tool_call>'
    rows = [(1, 0, "user", "hi"), (1, 1, "tool", '{"tool_call_id":"a","content":5.0}'), (1, 2, "assistant", "ok " + call("a", "search", query="x")), (1, 3, "assistant", call("b", "calculate", expression={"$result": "c"}) + call("c", "search", query="q")), (1, 4, "tool", '{"tool_call_id":"c"}'), (1, 5, "assistant", call("a", "search", query="again")), (1, 6, "tool", '{"tool_call_id":"zz"}'), (1, 7, "tool", "no json"), (1, 8, "assistant", "<tool_call>{</tool_call>"), (1, 9, "assistant", call("d", "search", limit=0)), (None, None, None, None), (2, 0, "assistant", call("x", "search", query={"$result": "y"}) + call("y", "search", query={"$result": "x"}))]
    got = chat.chat(spark.createDataFrame(rows, CONV).withColumn("rank", F.lit(1))).collect()
    status = {(r["conv_id"], r["turn"], r["part"]): r["status"] for r in got if r["kind"] != "message"}
    assert status == {(1, 1, 0): "ok", (1, 2, 1): "ok", (1, 3, 1): "unanswered", (1, 3, 2): "ok", (1, 4, 0): "ok", (1, 5, 1): "duplicate", (1, 6, 0): "orphan", (1, 7, 0): "invalid", (1, 8, 1): "invalid", (1, 9, 1): "invalid", (2, 0, 1): "cycle", (2, 0, 2): "cycle"}
    order = [(r["kind"], r["call_id"]) for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["place"])]
    assert order.index(("call", "a")) < order.index(("result", "a")) and order.index(("call", "c")) < order.index(("call", "b")) and order.index(("call", "c")) < order.index(("result", "c"))
    assert chat.canonical({"b": 1.0, "a": [True, "é"]}) == '{"a":[true,"é"],"b":1}'
    assert chat.chat(spark.createDataFrame([], CONV)).count() == 0


@pytest.mark.parametrize(("most", "n"), [(200_000, 130), (0, 12)])
def test_chat_long_chains_and_cycles(spark, monkeypatch, most, n):
    monkeypatch.setattr(chat, "MOST_GATHERED", most)
    call = lambda i, *refs: f'<tool_call>{{"id":"{i}","name":"calculate","arguments":{{"expression":[{",".join(chr(123) + chr(34) + "$result" + chr(34) + ":" + chr(34) + str(r) + chr(34) + chr(125) for r in refs)}]}}}}</tool_call>'
    rows = [
        (1, 3, "assistant", "".join(call(i, *([i + 1] if i < n else [])) for i in range(n + 1))),
        *((2, n - i, "assistant", call(i, *([i - 1] if i else []))) for i in range(n + 1)),
        (3, 1, "assistant", call("a", "b") + call("b", "c") + call("c", "a", "z") + call("z") + call("own", "own")),
        (3, 2, "assistant", call("d", "e") + call("e", "a", "z") + call("f", "z", "nobody")),
        *((4, None, "assistant", call(i, *([i + 1] if i < n else []))) for i in range(n + 1)),
    ]
    tools = {"calculate": {"type": "object"}}
    got = [r for r in chat.chat(spark.createDataFrame(rows, CONV), tools).collect() if r["kind"] == "call"]
    assert {r["call_id"] for r in got if r["status"] == "cycle"} == set("abcde") | {"own"} and {r["conv_id"] for r in got if r["status"] == "cycle"} == {3}
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in got if r["conv_id"] in (1, 4)} == {(c, str(i)): n - i for c in (1, 4) for i in range(n + 1)}
    for c, want in ((1, range(n, -1, -1)), (2, range(n + 1)), (4, range(n, -1, -1))):
        assert [r["call_id"] for r in sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["place"])] == [str(i) for i in want]


def test_pipeline_keeps_what_is_clean(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(11)
    base = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(120)) + "."
    clean = [base() for _ in range(12)]
    item = " ".join(f"q{rnd.randrange(10**6)}" for _ in range(30))
    rows = [*clean, clean[0], clean[1].replace("w1", "w1", 1), clean[2] + " and one more", "short", "Bad*** text### " * 80, f"{base()} {item} {base()}", None]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    vocabulary()
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert got == set(range(12))
