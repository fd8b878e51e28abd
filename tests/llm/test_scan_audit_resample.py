"""Secret scans, filter audit and resampling against brute-force versions."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import lzma
import math
import random
import re
import urllib.parse
import zlib
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest
import zstandard
from helpers import documents, texts

from cyclespark.llm import filter_audit, resampling, secret_scan

SECRET = 'password = "hunter2hunter2"'
KEY = "AKIA" + "Q7" * 8


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def b64(x: bytes | str) -> str:
    return base64.b64encode(x.encode() if isinstance(x, str) else x).decode()


# --- 11: secret scans ------------------------------------------------------------------


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append(("assign", m.start(), m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append(("access", m.start(), m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append(("hex", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


SECRETS = [
    SECRET, f"é🙂 {KEY} x", "token: token: abcdefgh", "ſecret=abcdefgh toKen=abcdefgh Token=abcdefgh", "AKIAAKIA" + "A" * 14, "AKIA" + "B" * 15, "f" * 24 + "g" + "e" * 23,
    "api_key='x' apikey = 0123456789abcdef0123456789", f'secret"="{"ab" * 20}"', "password=\nabcdefgh", "passwd==abcdef", "token=" + "z" * 100_000,
]


def test_secret_forms(spark, docs):
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(SECRETS)], "doc_id long, text string"))
    got = {(r["doc_id"], r["text"]): r["secrets"] for r in secret_scan.scan(rows).collect()}
    for (_, text), found in got.items():
        assert [(x["kind"], x["start"], x["end"]) for x in found if x["path"] == ""] == plain_spans(text or "")
        assert all(x["value"] == text[x["start"] : x["end"]] for x in found if x["path"] == "")
    assert secret_scan.scan(docs.limit(0)).collect() == []
    assert secret_scan.scan(docs).columns == [*docs.columns, "secrets", "n_packed"]
    named = secret_scan.scan(docs.withColumnsRenamed({"batch": "secrets", "lang": "_text"}))
    assert sorted(named.columns) == sorted(["doc_id", "text", "_text", "source", "n_chars", "n_removed", "secrets", "n_packed"])
    assert named.count() == docs.count()


CODECS = {"gzip": gzip.compress, "zlib": zlib.compress, "bzip2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress}


def inside(text: str) -> list[tuple]:
    return [x for x in secret_scan.secrets(text)[0] if x[4]]


@pytest.mark.parametrize("codec", sorted(CODECS))
def test_layers_are_unwrapped(codec):
    blob = b64(CODECS[codec](SECRET.encode()))
    text = f"é before {blob} after"
    assert inside(text) == [("assign", 9, 9 + len(blob), SECRET[:-1], f"base64>{codec}")]
    twice = b64(CODECS[codec](f"x {b64(SECRET)} y".encode()))
    assert inside(f"-- {twice} --") == [("assign", 3, 3 + len(twice), SECRET[:-1], f"base64>{codec}>base64")]
    quoted = urllib.parse.quote(blob, safe="")
    got = inside(f"a%20b {quoted}%20")
    assert got == [("assign", 6, 6 + len(quoted), SECRET[:-1], ("url>" if "%" in quoted else "") + f"base64>{codec}")]


def test_escapes_map_to_their_places():
    assert inside("x token%3Dabc%64efg y") == [("assign", 2, 19, "token=abcdefg", "url")]
    assert inside("x token%253Dabcdefg") == [("assign", 2, 19, "token=abcdefg", "url>url")]
    deep = "token=abcdefg"
    for _ in range(6):
        deep = deep.replace("%", "%25").replace("=", "%3D")
    assert inside(f"é {deep}") == [("assign", 2, 2 + len(deep), "token=abcdefg", ">".join(["url"] * 6))]
    assert inside("\\u0074oken=abcdefg") == [("assign", 0, 18, "token=abcdefg", "unicode")]
    assert inside("&#116;oken\\x3d\\u{61}bcdefg") == [("assign", 0, 26, "token=abcdefg", "unicode")]
    assert inside("\\U00000074oken=abcdefg") == [("assign", 0, 22, "token=abcdefg", "unicode")]
    assert inside("%C3%A9\\ud83d\\ude00 token%3Dabcdefg") == [("assign", 19, 34, "token=abcdefg", "unicode+url")]
    line = secret_scan.unwrapped("%C3%A9\\ud83d\\ude00%FFz\n%41")[0]
    assert sorted(x.text for x in line) == ["A", "é😀%FFz"]
    one = next(x for x in line if len(x.text) > 1)
    assert [one.place(k, k + 1) for k in range(6)] == [(0, 6), (6, 18), (18, 19), (19, 20), (20, 21), (21, 22)]
    # escapes that stand for nothing stay
    for odd in ("%zz %4", "\\ud800 \\u12", "&#99999999; &#0x; \\U99999999", "\\u{110000}", "%"):
        assert secret_scan.secrets(odd)[0] == []


def test_layers_end():
    assert secret_scan.secrets(b64(b64(b64("nothing here at all"))))[0] == []
    big = b64(zlib.compress(b"z" * 100_000 + SECRET.encode()))
    assert secret_scan.secrets(big, largest=1000) == ([], 1)
    assert [x[0] for x in secret_scan.secrets(big)[0]] == ["assign"]
    many = " ".join(b64(f"token={k:08d}") for k in range(2000))
    assert len(inside(many)) == 2000
    assert len(inside(f"{b64('token=abcdefgh')} {b64('token=abcdefgh')}")) == 2  # one content at two places
    broken = b64(gzip.compress(SECRET.encode())[:-12])
    assert secret_scan.secrets(broken)[1] == 0


def test_cycles_end(monkeypatch):
    """A stream that unfolds to itself, and two that unfold to each other."""
    one, two = b"\x1f\x8b\x08" + b"1" * 20, b"\x1f\x8b\x08" + b"2" * 20
    for into in ({one: one}, {one: two, two: one}):
        monkeypatch.setattr(secret_scan, "_unpacked", lambda raw, largest, into=into: ("gzip", into[raw]) if raw in into else None)
        assert secret_scan.unwrapped(f"x {b64(one)} {b64(one)}") == ([], 0)


def test_secret_report(spark):
    rows = [(1, f"{SECRET} {KEY} {b64(SECRET)} {'0a' * 13}"), (2, None), (2, None), (None, SECRET)]
    got = secret_scan.report(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    first = next(r for r in got if r["doc_id"] == 1)
    base = plain_spans(rows[0][1])
    say = lambda spans: ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
    assert (first["n_assign"], first["n_access"], first["n_hex"]) == (1, 1, 1)
    assert first["base_sha256"] == hashlib.sha256(say(base).encode()).hexdigest()
    blob = rows[0][1].index(b64(SECRET))
    assert first["spans"] == say(sorted([*base, ("assign", blob, blob + len(b64(SECRET)))], key=lambda x: x[1]))
    assert sum(r["spans"] == "" and r["n_hex"] == 0 for r in got) == 2 and len(got) == 4


# --- 12: filter audit ------------------------------------------------------------------


def plain_audit(rows, labels) -> dict:
    given = [(i, t or "", s or "") for i, t, s in rows]
    masks = []
    for i, t, s in given:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and t == u for j, u, _ in given)
        good = any(k == i and q == 1 for k, q, _ in labels if k is not None)
        toxic = any(k == i and x == 1 for k, _, x in labels if k is not None)
        masks.append((s, {f for f in fails if fails[f]}, good, toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                goes = [m for m in own if f in m[1] and not m[1] & before]
                out[part, "".join(order), k + 1] = [
                    sum(not m[1] & (before | {f}) for m in own), len(goes), sum(f in m[1] and bool(m[1] & before) for m in own),
                    sum(m[1] == {f} for m in own), sum(m[2] for m in goes), sum(m[3] for m in goes),
                ]
    shapley = Counter()
    for (part, order, step), x in out.items():
        shapley[part, order[step - 1]] += x[1]
    return {k: (*x, shapley[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def test_filter_audit(spark, docs):
    rng = random.Random(3)
    copies = [(500 + k, rng.choice(["one copy of many", "", None, "TWO COPIES #", " ".join(f"n{i}" for i in range(60))]), "en", rng.choice(["s0", "hot", None]), 1, "b", 0) for k in range(300)]
    more = docs.union(spark.createDataFrame(copies, docs.schema))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in more.collect()]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 800, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.interactions(more, frame).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got} == plain_audit(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_filter_audit_edges(spark, docs):
    assert filter_audit.interactions(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    alone = filter_audit.interactions(docs.withColumnsRenamed({"batch": "part", "n_removed": "mask"}))
    assert alone.agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[:] == (0, 0)
    null = spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, source string")
    got = filter_audit.interactions(null).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""}
    assert {r["removed"] for r in got if r["filter_order"] == "EABCD" and r["step"] == 1} == {0}
    assert {r["removed"] for r in got if r["filter_order"] == "EABCD" and r["step"] == 2} == {3}


def test_hash_collisions_are_no_copies(spark, monkeypatch):
    """Copies are told by their texts where all hashes are equal."""
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: filter_audit.F.lit(7).cast("long"))
    rows = [(k, f"text {k % 4}", "s") for k in range(40)]
    got = filter_audit.interactions(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("filter_order = 'EABCD' and step = 1").first()
    assert (got["removed"], got["kept"]) == (36, 4)


# --- 13: resampling --------------------------------------------------------------------


def features(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, buckets, least, percent, seed):
    at = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(at(f) for _, x in rows for f in features(x)), Counter(at(f) for x in target for f in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        fs = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[at(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, (len(fs) + 3) // 3 if len(fs) > 1 else len(fs)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(-1 if x is None else x for x in r[:5]) for r in out))


@pytest.mark.parametrize(("buckets", "least", "percent", "seed"), [(10_000, 20, 5, 42), (97, 3, 50, 1), (10_000, 0, 100, 42)])
def test_resample(spark, docs, buckets, least, percent, seed):
    long = [(900, "z" * 70_000 + " end " + "Y" * 70_000), (901, "A\x00b\x7fC_d É é"), (902, "a.b.c" * 4000)]
    rows = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).union(spark.createDataFrame(long, "doc_id long, text string"))
    target = ["alpha beta gamma", "Delta 1234 λ the of", "", None, "passage1 passage2 passage3 é"]
    got = resampling.resample(rows, spark.createDataFrame([(x,) for x in target], "text string"), carry=[], buckets=buckets, least_words=least, percent=percent, seed=seed)
    want = plain_resample([(r["doc_id"], r["text"]) for r in rows.collect()], target, buckets, least, percent, seed)
    assert sorted(tuple(-1 if r[c] is None else r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()) == want


def test_resample_edges(spark, docs):
    target = spark.createDataFrame([("alpha beta",)], "text string")
    none = resampling.resample(docs.limit(0), target.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "lang", "source", "n_chars", "batch", "n_removed", "n_words", "n_features", "weight", "score", "rank"]
    # repeated and null keys: each row counts, ranks have no gaps
    odd = docs.withColumnsRenamed({"batch": "rank", "n_removed": "_id"})
    got = resampling.resample(odd, target, least_words=0, percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, docs.count() + 1))
    by = sorted(got, key=lambda r: r["rank"])
    assert [r["score"] for r in by] == sorted((r["score"] for r in got), reverse=True)
    drawn = resampling.drawn_documents(docs, target, least_words=5, percent=20)
    assert 0 < drawn.count() < docs.count() and drawn.columns == docs.columns


def test_check_sums_are_joined():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé9λ") for _ in range(n)) for n in (1, 2, 3, 17, 255, 256, 1000, 70_000)]
    texts_ = [" ".join(rng.choice(words) for _ in range(40)), "", None, "x", "x y", *[t for t in texts() if t is None or len(t) < 500]]
    n_words, grams = resampling.ngrams(pa.array(texts_), 1 << 31)
    want = [[[zlib.crc32(f.encode()) % (1 << 31) for f in features(t) if f.count(" ") == n] for n in range(3)] for t in texts_]
    for n, (of, bucket) in enumerate(grams):
        assert [bucket[of == k].tolist() for k in range(len(texts_))] == [w[n] for w in want]
    assert n_words.tolist() == [len(w[0]) for w in want]


def test_many_distinct_words():
    """A batch in which distinct pairs times distinct words pass 2^31."""
    rng = random.Random(6)
    texts_ = [" ".join(f"w{rng.randrange(40_000)}" for _ in range(1000)) for _ in range(100)]
    _, grams = resampling.ngrams(pa.array(texts_), 1 << 31)
    for n, (of, bucket) in enumerate(grams):
        for k in (0, 50, 99):
            assert bucket[of == k].tolist() == [zlib.crc32(f.encode()) % (1 << 31) for f in features(texts_[k]) if f.count(" ") == n]
