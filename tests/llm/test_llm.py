"""The training-data operators against brute-force versions, on tables with hard cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, texts
from pyspark.sql import functions as F

import corpus_pipeline
from cyclespark.llm import ann, bpe, chat, licenses, line_dedup, near, packing, pii, quality, queries, suffix_dedup

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_queries_are_named():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


# --- 1: line dedup ---------------------------------------------------------------------


def test_line_dedup(spark, docs, rows, empty):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(unique, min_lines=3, min_words=50).collect()}
    seen, gone = set(), defaultdict(set)
    given = {r["doc_id"]: r["text"] for r in unique.collect()}
    for k in sorted(given):
        lines = given[k].split("\n") if given[k] is not None else []
        for i in range(len(lines)):
            for n in (1, 2, 3):
                w = tuple(lines[i : i + n])
                if len(w) == n and (n == 3 or sum(x.count(" ") + 1 for x in w) >= 50):
                    if w in seen:
                        gone[k].update(range(i, i + n))
                    seen.add(w)
    for k, t in given.items():
        lines = t.split("\n") if t is not None else []
        want = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone[k])
        spans = sum(i - 1 not in gone[k] for i in gone[k])
        assert (got[k]["text"], got[k]["n_lines"], got[k]["n_removed"], got[k]["n_spans"]) == (want, len(lines), len(gone[k]), spans)
    assert sum(map(len, gone.values())) > 20
    assert line_dedup.dedup_lines(docs).count() == len(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_suffix_array(spark):
    """Order and common prefixes of suffixes against brute force, on runs of 1 to 40 repeated lines."""
    rng = np.random.default_rng(8)
    text = {}
    base = [f"line {k % 23} of {k % 7}" for k in range(40)]
    for k in range(40):
        at = int(rng.integers(0, 40 - k))
        text[k] = [*[f"own {k} {j}" for j in range(k % 3)], *base[at : at + k + 1], *(["end"] if k % 2 else []), *(base[:5] if k % 5 == 0 else [])]
    text[40] = text[41] = base
    text[42] = ["same"] * 30
    rows = [(k, k, i, x) for k, lines in text.items() for i, x in enumerate(lines)]
    lines = spark.createDataFrame(rows, "place long, row long, line int, x string").repartition(3)
    lines = lines.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x"), "words": F.lit(1)})
    order = {r["x"]: (r["h1"], r["h2"]) for r in lines.collect()}
    often = Counter(x for lines_ in text.values() for x in lines_)
    suffixes = []
    for k, lines_ in text.items():
        for i, x in enumerate(lines_):
            if often[x] > 1:
                stop = next((j for j in range(i, len(lines_)) if often[lines_[j]] == 1), len(lines_))
                suffixes.append(([order[y] for y in lines_[i:stop]], k, k, i))
    suffixes.sort()
    tables = line_dedup.Tables(spark, "test")
    got = line_dedup.with_common_prefix(tables, line_dedup.suffix_order(tables, line_dedup.repeated_lines(tables, lines))).orderBy("at").collect()
    assert [(r["row"], r["line"]) for r in got] == [(k, i) for _, _, k, i in suffixes]
    common = lambda a, b: next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert [r["lcp"] for r in got[1:]] == [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    assert max(r["lcp"] for r in got[1:]) == 40


# --- 2: nearest neighbours ----------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    data = [(k, x.tolist(), 0) for k, x in enumerate(v)] + [(600, None, 0), (620, [0.0] * 16, 0), (640, [float("nan")] * 16, 0), (660, [None] + [1.0] * 15, 0), (680, [1.0] * 3, 0), (601, v[0].tolist(), 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in ann.nearest(df, k=10, keep=80, block=200, query_block=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids, x = np.append(np.arange(600), 601), np.concatenate([v, v[:1]]).astype(float)
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:10]]
        hits += len(set(best) & {a for a, _ in found})
        assert all(math.isclose(b, float((x[list(ids).index(a)] * x[q]).sum()), rel_tol=1e-12) for a, b in found)
        assert found == sorted(found, key=lambda y: (-y[1], y[0])) and len(found) == 10
    assert hits >= 0.9 * 10 * len(got)
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in few) == [(0, 1), (0, 2)]


def test_nearest_ties(spark):
    """Of equal vectors those of smallest id are found."""
    df = spark.createDataFrame([(k, [1.0, 2.0, 3.0, 4.0]) for k in range(600)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert len(got) == 30 and all(found == [k for k in range(21) if k != q][:20] for q, found in got.items())


# --- 3: licences ------------------------------------------------------------------------------

SIGNED = [
    (900, "Licensed under the MIT License. cc by nc, CC BY-NC; CC BY NC SA 4.0"),
    (901, "SPDX-License-Identifier: GPL-3.0-only\nApache License, Version 2.0 and apache license version 2"),
    (902, "under the mitt license apache license version 22 xunder the mit license"),
    (903, "cc by nc " * 3000),
    (904, "All rights reserved. Copyright (c) 2020"),
    (905, "UNDER THE MİT LICENSE Under the MIT License"),
]


def test_licenses(spark, docs, rows, empty):
    extra = spark.createDataFrame(SIGNED, "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    got = licenses.scan(df).collect()
    assert len(got) == df.count() and licenses.scan(empty).count() == 0 and len(licenses.rules()) > 200
    for r in got:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | set()
        assert 0 <= r["score"] <= 1
        # brute force of the rules: all matches, then containment by priority
        found = []
        joined = " ".join(words)
        for label, keyword, e, p, score in licenses.rules():
            if keyword in joined:
                for m in re.finditer(rf"(?<![^ ])((?:{e}))(?![^ ])", joined):
                    found.append((m.start(), m.end(), p, label, score))
        if found:
            assert licenses.gated(r["text"])
        if len(found) < 50:
            kept = [d for d in found if not any(x[2] < d[2] and x[0] <= d[0] and x[1] >= d[1] for x in found)]
            assert set(filter(None, r["labels"].split(","))) == labels | {d[3] for d in kept}
            assert r["score"] == max([0.7 * bool(labels), *[d[4] for d in kept]])
    assert {r["doc_id"]: r["labels"] for r in got}[901] == "apache-2,gpl-3"


def spellings(expression: str) -> list[str]:
    """All strings that a rule's name matches, its look-aheads aside."""
    from re import _constants as c
    from re import _parser

    def of(parsed) -> list[str]:
        out = [""]
        for op, arg in parsed:
            if op is c.LITERAL:
                part = [chr(arg)]
            elif op is c.IN:
                part = [chr(k) for o, a in arg for k in (range(a[0], a[1] + 1) if o is c.RANGE else [a])]
            elif op is c.MAX_REPEAT:
                assert arg[:2] == (0, 1)
                part = ["", *of(arg[2])]
            elif op is c.SUBPATTERN:
                part = of(arg[-1])
            elif op is c.BRANCH:
                part = [x for branch in arg[1] for x in of(branch)]
            else:
                assert op is c.ASSERT_NOT
                part = [""]
            out = [x + y for x in out for y in part]
        return out

    return of(_parser.parse(expression))


def test_license_keywords():
    """A rule's keyword and the text gate occur in all that the rule matches."""
    names = [(k, x) for _, k, name, _ in licenses.FAMILIES for x in spellings(name)]
    names += [(k, x) for _, k, e, _, _ in licenses.SIGNATURES + licenses.GENERIC for x in spellings(e)]
    assert len(names) > 400
    assert [x for k, x in names if k not in x] == []
    for joint in (" ", "-", "\n", ", "):
        assert [x for _, x in names if not licenses.gated(x.replace(" ", joint))] == []


UNGATED = [
    *[max(spellings(e), key=len) for _, _, e, _, _ in licenses.SIGNATURES], "creative commons zero", "Released under the Creative Commons Zero 1.0", "psf license", "subject to the PSF licence version 2",
    "do what the fuck you want to public license", "covered under the Do What The Fuck You Want To Public Licence", "MIT No-Attribution", "mit no\nattribution", "MIT No  Attribution",
    "cc0", "wtfpl", "Python Software Foundation License 2", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Python-2.0, WTFPL", "no attribution needed",
]


def test_licenses_without_gates(spark):
    """All rules are matched with no gate before them."""
    df = spark.createDataFrame(list(enumerate(UNGATED)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for k, t in enumerate(UNGATED):
        joined = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
        found = [(m.start(), m.end(), p, label, s) for label, _, e, p, s in licenses.rules() for m in re.finditer(rf"(?<![^ ])((?:{e}))(?![^ ])", joined)]
        kept = [d for d in found if not any(x[2] < d[2] and x[0] <= d[0] and x[1] >= d[1] for x in found)]
        assert (got[k]["labels"], got[k]["score"]) == (",".join(sorted({d[3] for d in kept})), max([0, *[d[4] for d in kept]]))
    at = len(licenses.SIGNATURES)
    assert all(label in got[k]["labels"].split(",") for k, (label, *_) in enumerate(licenses.SIGNATURES))
    assert [got[at + k]["labels"] for k in (0, 2, 4, 6, 14)] == ["cc0-1", "python-2", "wtfpl", "mit-0", ""]


# --- 4: BPE ----------------------------------------------------------------------------------------


def test_bpe(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    extra = spark.createDataFrame([(800, "a <|endoftext|> b<|endoftext|>"), (801, "it's WE'LL  12 ½²\n\n  x"), (802, "aaaa" * 2000)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    library = Tokenizer.from_file(path)
    want = Counter()
    for r in df.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df, path).collect())
    assert got == want
    assert bpe.round_trip(empty.select("doc_id", "text"), path).count() == 0


def test_keys_beside_nulls(spark):
    """Keys beyond 2^53 keep their value beside a null key."""
    big = 9007199254740993
    df = spark.createDataFrame([(None, "a b"), (big, "c d")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in bpe.round_trip(df, P.path("byte_bpe_50k.json")).collect()} == {None, big}
    assert {r["doc_id"] for r in packing.packed_documents(df, P.path("word_bpe_49k.json")).collect()} == {None, big}
    turns = df.select(F.col("doc_id").alias("conv_id"), F.lit(big).alias("turn"), F.lit("user").alias("role"), "text")
    formatted = chat.format_turns(turns)
    assert {(r["conv_id"], r["turn"]) for r in formatted.collect()} == {(None, big), (big, big)}
    assert {r["conv_id"] for r in chat.read_back(formatted).collect()} == {None, big}


def test_bpe_pairs():
    """Speculation with verification and exact merging agree on random words."""
    model = bpe.SpeculativeBpe(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(2)
    words = [bytes(rng.choice(list(b"abcdehinorst ' "), rng.integers(1, 30)).tolist()) for _ in range(3000)] + ["é中".encode() * 40]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.words(words)] == [model.exact(w) for w in words]
    long = b"abcabdthe" * 60
    assert model._exact_long([model.byte_id[b] for b in long]) == model.exact(long)


# --- 5: packing --------------------------------------------------------------------------------------


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for r in rows:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[r["doc_id"], k // 256, k, len(part), zlib.crc32(part.tobytes())] += 1
    cuts = packing.pieces(docs, path, size=256).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = packing.pack(cuts, size=256, block=60).collect()
    key = lambda d: None if d is None or d != d else int(d)
    assert Counter((key(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in packed)
    assert len(by) <= math.ceil(total / 256) * 1.1 + 8
    assert packing.packed_documents(empty, path).count() == 0


def test_packing_of_repeated_rows(spark):
    """Copies of one row are dealt over the blocks."""
    rows = spark.createDataFrame([(1, 0, 0, 100, 7)] * 2000, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(rows, size=256, block=100).collect()
    per_block = Counter(r["sequence_id"] >> 32 for r in packed)
    assert len(packed) == 2000 and len(per_block) == 20 and max(per_block.values()) < 200
    assert all(r["offset"] + r["length"] <= 256 for r in packed)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_vector_capacities(score):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 200, 400)
    bins, offsets = packing.best_fit(lengths, (512, 6, 60_000), (1.0, 0.5, 0.5), score)
    for b in np.unique(bins):
        own = bins == b
        assert lengths[own].sum() <= 512 and own.sum() <= 6 and (lengths[own] ** 2).sum() <= 60_000
        order = np.argsort(offsets[own])
        assert (offsets[own][order] == np.cumsum(lengths[own][order]) - lengths[own][order]).all()


# --- 6: near-duplicates ----------------------------------------------------------------------------------


def brute_components(pairs_of: dict[int, set], percent: int) -> dict[int, int]:
    ids = sorted(pairs_of)
    parent = {k: k for k in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = pairs_of[a], pairs_of[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {k: root(k) for k in ids}


def test_near_duplicates(spark, docs, empty):
    # chains, a hub with many variants, and texts that share a long passage only
    base = [f"t{k}" for k in range(60)]
    extra = []
    for k in range(25):
        extra.append((2000 + k, " ".join([*base[:k], *[f"n{k}_{j}" for j in range(2)], *base[k + 2 :]])))
    for k in range(25):
        extra.append((2100 + k, " ".join([*[f"q{j}" for j in range(70)], *[f"own{k}_{j}" for j in range(12 + k % 8)]])))
    for k in range(12):
        extra.append((2200 + k, " ".join(f"chain{j}" for j in range(6 * k, 6 * k + 90))))
    table = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in near.near_duplicates(table, width=4).collect()}

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in table.collect()}
    want = brute_components(sets, 80)
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[k]) and r["kept"] == (want[k] == k) for k, r in got.items())
    assert near.near_duplicates(docs).count() == docs.count()
    assert near.near_duplicates(empty).count() == 0


def test_a_key_with_several_texts_hides_no_link(spark):
    # the smallest and the largest set of a bucket are of one key, the set between them is of another
    w = [f"w{k}" for k in range(3000)]
    rows = [(5, w[1:]), (5, [*w, "w3000"]), (7, w), (9, [f"v{k}" for k in range(3000)])]
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near.near_duplicates(table).collect()}
    assert got == {(5, 5), (7, 5), (9, 9)}


def test_near_pairs_stay_few(spark):
    """Near copies of one text and texts that share a passage are compared a few times each, not with one another."""
    rng = np.random.default_rng(14)
    base, passage = [f"b{k}" for k in range(150)], [f"p{k}" for k in range(60)]
    texts = [base]
    for _ in range(2000):
        own = list(base)
        for at in rng.integers(0, 150, rng.integers(1, 9)):
            own[at] = f"w{rng.integers(0, 60)}"
        texts.append(own)
    texts += [[*passage, *(f"o{k}_{j}" for j in range(60))] for k in range(2000)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, text string")
    t = near.Tables(spark, "test")
    sets = t.write(near.full_sets(docs, docs.select("id", F.col("id").alias("c")), "id", "text", 4), "sets")
    links = near.prefix_links(t, sets, 80)
    compared = sum(spark.read.parquet(f"{t.path}/{name}").count() for name in ("prefix-pairs", "spokes"))
    assert compared < 10 * len(texts)
    joined = {r["id"]: r["component"] for r in near.components(t, links, "test").collect()}
    first = {tuple(x[i : i + 4]) for x in [base] for i in range(147)}
    for k in range(1, 2001):
        own = {tuple(texts[k][i : i + 4]) for i in range(147)}
        if 100 * len(own & first) >= 80 * len(own | first):
            assert joined[k] == 0
    assert not any(k in joined for k in range(2001, 4001))


def test_index_guarantee():
    """Any two signatures within the distance share a key."""
    plan = near.index_plan(64, 27, 14)
    rng = np.random.default_rng(4)
    for _ in range(2000):
        differs = set(rng.choice(64, 27, replace=False).tolist())
        assert any(not differs & set(kept) for kept in plan)


# --- 7: quality -------------------------------------------------------------------------------------------


def test_quality(docs, rows, empty):
    def counts(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        windows = defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)

    got = quality.verdicts(docs, carry=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        n = counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.verdicts(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_hosts(spark):
    """A document that breaks a soft rule goes only where its host does so by habit."""
    clean, noisy = " ".join(f"word{k}" for k in range(40)), " ".join(f"word{k}###" for k in range(40))
    data = [(k, noisy, "bad") for k in range(60)] + [(100 + k, clean, "bad") for k in range(20)]
    data += [(200 + k, clean, "good") for k in range(80)] + [(300, noisy, "good"), (301, noisy, None)]
    data += [(400 + k, clean, f"h{k % 5}") for k in range(50)]
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert not any(got[k] for k in range(60)) and all(got[k] for k in range(100, 120)) and got[300]


# --- 8: chat --------------------------------------------------------------------------------------------------


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", None, "", "a\\b <s>\\<s>", "[ROLE]x[TEXT]", "\\", "<", "[INST", "é🙂\n"]
    data = [(1, k, r, t) for k, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "user", "assistant", "user", "assistant"], said, strict=True))]
    data += [(2, 0, "assistant", "x"), (2, 1, "user", "y"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, None, None, None), (4, 1, "[ROLE]odd", "z"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)
    formatted = chat.format_turns(df)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    groups = defaultdict(list)
    for c, k, r, t in data:
        groups[c].append((-1 if k is None else k, r or "", t or ""))
    for c, turns in groups.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(turns) and g["loss_chars"] == len(learnt)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    assert {c: got[c]["valid"] for c in (1, 2, 3, 4, None)} == {1: True, 2: False, 3: False, 4: False, None: True}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
    # turns come from the text alone: the same text cut into other rows reads alike
    whole = formatted.where("conv_id = 1").orderBy("turn").collect()
    parts = [(s["text"], s["loss"]) for r in whole for s in r["segments"]]
    cut = [(t[i : i + 3], k) for t, k in parts for i in range(0, len(t), 3)] if not any("\\" in t for t, _ in parts) else parts
    rows = [(1, [{"text": t, "loss": k} for t, k in cut[i : i + 2]], True, True) for i in range(0, len(cut), 2)]
    again = spark.createDataFrame(rows, f"conv_id long, segments {chat.SEGMENTS}, valid boolean, complete boolean").coalesce(1)
    assert chat.read_back(again).drop("valid", "complete").collect() == chat.read_back(formatted.where("conv_id = 1")).drop("valid", "complete").collect()
    template = chat.Template()
    turns = [("system", "s</s>"), ("odd[ROLE]", "\\"), ("user", ""), ("assistant", " [/INST]\n")]
    text = "".join(t for who, said in turns for t, _ in template.segments(who, said))
    for at in range(len(text)):
        first, rest = template.read(text[:at])
        more, rest = template.read(rest + text[at:])
        assert first + more == turns and rest == ""


# --- 9: substrings -----------------------------------------------------------------------------------------------


def test_suffix_ranks():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 17, 120):
        for _ in range(10):
            t = rng.integers(1, 4, n)
            want = sorted(range(n), key=lambda i: t[i:].tolist())
            assert np.argsort(suffix_dedup.suffix_ranks(t)).tolist() == want


def test_substrings(docs, rows, empty):
    first = {}
    for r in rows:
        b = (r["text"] or "").encode()
        for i in range(len(b) - 49 if r["doc_id"] is not None else 0):
            w = b[i : i + 50]
            first[w] = min(first.get(w, r["doc_id"]), r["doc_id"])
    want = Counter()
    for r in rows:
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49 if r["doc_id"] is not None else 0):
            if first[b[i : i + 50]] < r["doc_id"]:
                gone[i : i + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[r["doc_id"], len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup_substrings(docs, batch=7).collect())
    assert got == want
    assert suffix_dedup.dedup_substrings(empty).count() == 0


# --- 10: personal data --------------------------------------------------------------------------------------------

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t: str) -> list[tuple]:
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark, docs, empty):
    odd = ["a@b.c%d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "é 4111 1111 1111 1111 4111-1111-1111-1112", "+1 (017) 555-7713. +12", "1" * 500, "+" * 50, "é1 2 3 " * 200]
    learn = [f"now my phone number is +1 555 010 {1000 + i} ok {i}" for i in range(12)] + ["now my phone number is 555-0199-x7 ok"]
    extra = spark.createDataFrame([(700 + k, t) for k, t in enumerate(odd + learn)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    found = pii.find(df)
    assert found.count() == df.count() and pii.find(empty).count() == 0
    for r in found.collect():
        assert [(x["k"], x["s"], x["e"]) for x in r["seeds"]] == brute_spans(r["text"] or "")
    report = {r["doc_id"]: r for r in pii.report(found).collect()}
    last = 700 + len(odd + learn) - 1
    text = learn[-1]
    at = text.index("555")
    assert report[last]["spans"] == f"phone:{at}:{at + 11}" and report[last]["n_phone"] == 0
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert redacted[last] == "now my phone number is [PHONE] ok" and redacted[700] == "[EMAIL][EMAIL] x@y"


def test_pii_generations(spark):
    """Values that a pattern finds support a further pattern without a seed; long words don't hide a pattern."""
    seeds = [f"please call my desk +1 555 010 {1000 + i} soon" for i in range(120)]
    found = [f"please call my desk ext-{2000 + i}-x soon" for i in range(12)]
    second = [f"reach reception via ext-{2000 + i}-x always" for i in range(12)] + ["reach reception via ext-9999-z always"]
    other = [f"order batch {3000 + i} shipped" for i in range(8)]
    word = "y" * 60
    long = [f"{word} {word} +1 555 011 {1000 + i} {word}" for i in range(12)] + [f"{word} {word} 555-0177-q {word}"]
    said = seeds + found + second + other + long
    got = {r["doc_id"]: r["extra"] for r in pii.find(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()}
    for k, t in enumerate(said):
        want = [(t.index(w), t.index(w) + len(w)) for w in re.findall(r"ext-[0-9]+-[xz]|555-0177-q", t)]
        assert [(x["s"], x["e"]) for x in got[k]] == want and all(x["k"] == "phone" for x in got[k])


def test_clashing_columns(spark):
    """Columns named like those that operators make on the way come through."""
    names = ["seeds", "extra", "n_removed", "n_lines", "n_spans", "_scan", "_starts", "_labels", "_text", "_row", "_rest", "_doc", "row", "place", "found", "component_id", "kept", "_key"]
    said = "licensed under the mit license mail a@b.co " + " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(k, said + str(k % 2), "s0") for k in range(4)], "doc_id long, text string, source string").withColumns({n: F.lit(7) for n in names})
    assert all(r[n] == 7 for r in licenses.scan(df).collect() for n in names)
    rows = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.cut(stage(spark, rows, ""), "test")
        assert rows.columns == df.columns and rows.count() > 0
        assert all(r[n] == 7 for r in rows.collect() for n in names), name


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "personal data", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    given = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == given.columns
        docs = corpus_pipeline.cut(out, "test")
        assert docs.count() > 0
    whole = corpus_pipeline.run(spark, small)
    assert {r[0] for r in whole.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run.__doc__


def test_pipeline_on_hard_cases(spark, docs):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.cut(stage(spark, rows, ""), "test")
    assert rows.count() > 0
    empty = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.cut(stage(spark, empty, ""), "test")
    assert empty.count() == 0
    assert len(texts()) > 50


def brute_quality(rows):
    """Rows that the quality rules keep, with the host rates in plain Python."""
    made = []
    for r in rows:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        windows = defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        again = len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        length = sum(map(len, w)) / max(len(w), 1)
        soft = (len(re.findall(r"[#*$%&|<>]", t)) > 0.1 * len(w), len(lines) - len(set(lines)) > 0.3 * len(lines), length < 2 or length > 12)
        made.append((len(w) < 20 or 100 * again > 30 * len(w), soft))
    hosts = defaultdict(list)
    for r, (_, soft) in zip(rows, made, strict=True):
        hosts[r["source"]].append(soft)
    bad = set()
    for k in range(3):
        n = {h: len(x) for h, x in hosts.items()}
        f = {h: sum(s[k] for s in x) for h, x in hosts.items()}
        m = sum(f.values()) / sum(n.values())
        spread = max(np.var([f[h] / n[h] for h in n]) - m * (1 - m) * np.mean([1 / n[h] for h in n]), 1e-9)
        weight = min(max(m * (1 - m) / spread - 1, 1.0), 1e6)
        bad |= {(h, k) for h in n if (f[h] + m * weight) / (n[h] + weight) >= 0.5}
    return [r for r, (base, soft) in zip(rows, made, strict=True) if not base and not any(s and (r["source"], k) in bad for k, s in enumerate(soft))]


def brute_lines(rows):
    seen, out = set(), []
    for r in rows:
        lines, gone = (r["text"] or "").split("\n"), set()
        for i in range(len(lines)):
            for n in (1, 2, 3):
                w = tuple(lines[i : i + n])
                if len(w) == n and (n == 3 or sum(x.count(" ") + 1 for x in w) >= 50):
                    if w in seen:
                        gone.update(range(i, i + n))
                    seen.add(w)
        if len(gone) < len(lines):
            out.append(r | {"text": "\n".join(x for i, x in enumerate(lines) if i not in gone)} if gone else r)
    return out


def brute_near(rows):
    sets = defaultdict(set)
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] |= {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = brute_components(sets, 80)
    best = {}
    for r in rows:
        if root[r["doc_id"]] == r["doc_id"] and (r["doc_id"] not in best or r["text"] < best[r["doc_id"]]["text"]):
            best[r["doc_id"]] = r
    return list(best.values())


def brute_redaction(rows):
    out = []
    for r in rows:
        t, at, parts = r["text"] or "", 0, []
        for s, e, k in sorted((s, e, k) for k, s, e in brute_spans(t)):
            if s >= at:
                parts += [t[at:s], f"[{k.upper()}]"]
            at = max(at, e)
        out.append(r | {"text": "".join([*parts, t[at:]]) if parts else r["text"]})
    return out


def test_pipeline_against_brute_force(spark):
    """The rows after every stage against plain Python: hosts, copies, repeated rows, personal data."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(12)
    words = [f"{a}{b}" for a in ("al", "be", "ga", "de", "ep", "ze", "th", "ka") for b in ("pha", "ta", "mma", "lon", "ro", "x")]
    said = lambda n: " ".join(rng.choice(words, n))
    texts = [said(int(rng.integers(15, 90))) for _ in range(50)]
    passage = "\n".join(said(8) for _ in range(4))
    texts += [f"{said(30)}\n{passage}\n{said(25)}" for _ in range(6)] + [passage, texts[3], texts[4].upper()]
    texts += [" ".join([*texts[7 + k].split()[:-1], "changed"]) for k in range(6)]
    texts += [f"{said(30)} mail a{k}@b.example or 10.0.0.{k} {said(12)}" for k in range(4)] + [f"{said(40)} ### ### $$$ ### ### %%" for _ in range(30)]
    texts += [f"{said(30)}\n{said(22)}\n\n\n{said(6)}", None, "", f"{said(24)} {'z' * 200}"]
    host = lambda k, t: "noisy" if t and "###" in t and k % 10 else ["news", "blog", None][k % 3]
    rows = [{"doc_id": k, "text": t, "source": host(k, t), "seeds": k} for k, t in enumerate(texts)]
    rows += [rows[0], dict(rows[0])] if len(texts[0].split()) in range(20, 50) else [dict(next(r for r in rows if r["text"] and 20 <= len(r["text"].split()) < 50 and "\n" not in r["text"]))]
    rows.sort(key=lambda r: r["doc_id"])
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, source string, seeds int").coalesce(1)
    key = lambda r: (r["doc_id"], r["text"] or "", r["source"] or "", r["seeds"])
    sizes = [len(rows)]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (brute_quality, brute_lines, brute_near, brute_redaction), strict=False):
        docs = corpus_pipeline.cut(stage(spark, docs, ""), "test").coalesce(1)
        rows = brute(rows)
        assert sorted(map(key, (r.asDict() for r in docs.collect()))) == sorted(map(key, rows)), name
        docs = docs.orderBy("doc_id").coalesce(1)
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] and any("[EMAIL]" in r["text"] for r in rows)
    library, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for r in rows:
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        want[r["doc_id"], 0, 0, len(ids), zlib.crc32(ids.tobytes())] += 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    placed = defaultdict(list)
    for r in packed:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(o == sum(n for p, n in parts if p < o) for parts in placed.values() for o, _ in parts)
    assert len(placed) == math.ceil(sum(r["length"] for r in packed) / 2048)
