"""Stages share nothing: results of several runs hold side by side, and what a written copy has replaced goes."""

from __future__ import annotations

import os
import random
import re
import time

import pytest
from helpers import documents
from test_llm import brute_spans

import corpus_pipeline
from cyclespark.llm import pii
from cyclespark.llm.common import READS, cut, naming, release, shared_folder

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).select("doc_id", "text", "lang", "source", "n_chars").cache()


def folders(spark) -> set[str]:
    at = shared_folder(spark).removeprefix("file://")
    return set(os.listdir(at)) if os.path.isdir(at) else set()


@pytest.mark.parametrize("at", range(5))
def test_two_results_of_a_stage(spark, docs, at):
    stage = corpus_pipeline.STAGES[at][1]
    one = stage(spark, docs, "")
    n = one.count()
    two = stage(spark, docs.where("doc_id < 40"), "")
    three = stage(spark, cut(docs.where("doc_id > 30"), "copy"), "")
    assert two.count() < n and three.count() < n
    assert one.count() == n


def test_two_runs(spark, small):
    one, two = corpus_pipeline.run(spark, small), corpus_pipeline.run(spark, small)
    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"])
    assert sorted(map(key, one.collect())) == sorted(map(key, two.collect())) != []


def test_a_written_copy_frees_its_stage(spark, docs):
    before = folders(spark)
    first = corpus_pipeline.STAGES[1][1](spark, docs, "")
    tables = {p.rsplit("/", 1)[-1] for p in first.schema[0].metadata[READS]}
    assert tables and tables <= folders(spark) - before
    other = corpus_pipeline.STAGES[1][1](spark, docs, "")
    copy = cut(first, "copy")
    assert copy.count() == first.count() == other.count()
    corpus_pipeline.STAGES[3][1](spark, copy, "").count()
    assert not tables & folders(spark)
    assert copy.count() == other.count()


def test_stages_without_a_copy(spark, docs):
    """A stage that gets an unwritten result leaves the tables that it still reads."""
    out = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, "")
    assert out.count() > 0


def shuffled(spark) -> int:
    """Bytes that the session's tasks have written for shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_texts_that_stay_are_not_shuffled(spark, tmp_path):
    """Also where no table is small enough to be broadcast; keys may be narrower than the operator's."""
    rng = random.Random(4)
    text = lambda: " ".join(f"{rng.getrandbits(64):x}" for _ in range(10_000))
    rows = [(k, text()) for k in range(40)]
    copy, again = text(), text()
    rows += [(100, copy), (101, copy), (102, again), (102, f"{again} more"), (None, copy)]
    spark.createDataFrame(rows, "doc_id int, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    was, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
        out.write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    moved = shuffled(spark) - before
    got = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=str) == sorted([*rows[:40], (100, copy), (102, again), (None, copy)], key=str)
    assert moved < sum(len(t) for _, t in rows[:40]) / 2


def test_names_of_other_folders_are_left(spark, docs, tmp_path):
    kept = tmp_path / ("mine-" + "0" * 32)
    kept.mkdir()
    for path in (f"file://{kept}", str(kept), "/", shared_folder(spark), f"{shared_folder(spark)}/../{kept.name}", 7):
        assert release(naming(docs, [path])) == []
    assert kept.is_dir() and os.path.isdir(shared_folder(spark).removeprefix("file://"))


# --- personal data in long texts -------------------------------------------------------------


def plain_graph(said: dict, rounds: int = 3, support: int = 5, confidence: float = 0.9) -> dict:
    """Spans that patterns of high confidence enclose, by plain loops over patterns and values."""
    spots = []
    for k, text in said.items():
        seeds = brute_spans(text)
        free = [
            (None, m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0d]+", text)
            if re.search("[0-9@]", m[0]) and (len(re.findall("[0-9]", m[0])) >= 4 or "@" in m[0]) and not any(a < m.end() and m.start() < z for _, a, z in seeds)
        ]
        for kind, a, z in [*seeds, *free]:
            left, right = text[max(0, a - 1000) : a], re.match(r"[.,;:!?)\"']*[\x20\x09-\x0d]*([^\x20\x09-\x0d]+)", text[z : z + 1000])
            one = re.search(r"(?:^|[\x20\x09-\x0d])([^\x20\x09-\x0d]+)[\x20\x09-\x0d]*$", left)
            two = re.search(r"(?:^|[\x20\x09-\x0d])([^\x20\x09-\x0d]+[\x20\x09-\x0d]+[^\x20\x09-\x0d]+)[\x20\x09-\x0d]*$", left)
            patterns = [("L", two[1].lower())] if two else []
            patterns += [("B", one[1].lower(), right[1].lower())] if one and right else []
            spots += [(k, kind, a, z, text[a:z], p) for p in patterns]
    edges: dict = {}
    for _, kind, _, _, v, p in spots:
        edges.setdefault(p, {}).setdefault(v, set()).add(kind)
    edges = {p: vs for p, vs in edges.items() if len(vs) >= support}
    kinds = ("email", "ip", "card", "phone")
    seed = {(v, kd): 1.0 for vs in edges.values() for v, got in vs.items() for kd in got if kd}
    belief = {(p, v, kd): 1.0 if kd in edges[p][v] else 0.0 for p in edges for v in edges[p] for kd in kinds}
    good: dict = {}
    for _ in range(rounds):
        score = {}
        for p, vs in edges.items():
            for kd in kinds:
                held = [belief[p, v, kd] for v in vs]
                score[p, kd] = sum(held) / len(vs) if sum(b >= confidence for b in held) >= support else 0.0
        good = {p: {kd: score[p, kd] for kd in kinds} for p in edges if max(score[p, kd] for kd in kinds) >= confidence}
        doubt: dict = {}
        for p, c in good.items():
            for v in edges[p]:
                for kd in kinds:
                    doubt[v, kd] = doubt.get((v, kd), 1.0) * max(1 - (c[kd] if c[kd] >= confidence else 0.0), 1e-9)
        belief = {(p, v, kd): max(1.0 if kd in edges[p][v] else 0.0, 1 - doubt.get((v, kd), 1.0)) for p in edges for v in edges[p] for kd in kinds}
    out: dict = {k: {} for k in said}
    for k, kind, a, z, _, p in spots:
        if kind is None and p in good:
            best = max(good[p].values())
            name = next(kd for kd in kinds if good[p][kd] == best)
            out[k][a, z] = max(out[k].get((a, z), (0.0, "")), (best, name))
    assert seed or not edges
    return {k: sorted((a, z, name) for (a, z), (_, name) in v.items()) for k, v in out.items()}


def test_pattern_graph(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "call", "desk", "mail", "me", "at", "now", "Ref"]
    value = [
        lambda: f"a{rng.randrange(400)}@b.org", lambda: f"10.0.{rng.randrange(200)}.1", lambda: f"+1 555 010 {1000 + rng.randrange(400)}",
        lambda: f"ext-{2000 + rng.randrange(6)}", lambda: f"id{7000 + rng.randrange(3)}", lambda: f"({rng.randrange(3)})-4455-1@",
    ]
    frames = [("call my desk {} soon", (2, 2, 2, 2, 3)), ("mail me at {} now.", (0, 0, 0, 5)), ("ref {}, then", (3, 4)), ("reach by {} always", (3,)), ("host at {} up", (1, 1, 1, 4))]
    said = {}
    for k in range(240):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            frame, kinds = rng.choice(frames)
            parts += [frame.format(value[rng.choice(kinds)]()), " ".join(rng.choice(words) for _ in range(rng.randrange(3)))]
        said[k] = rng.choice([" ", "\n", "  "]).join(parts)
    said[500] = " ".join(said[k] for k in range(0, 240, 2)) + " " + "w" * 1500 + " " + " ".join(said[k] for k in range(1, 240, 2))  # cut into blocks
    said[501] = "é🙂 " * 900 + said[500]
    got = {r["doc_id"]: [(x["s"], x["e"], x["k"]) for x in r["extra"]] for r in pii.find(spark.createDataFrame(list(said.items()), "doc_id long, text string")).collect()}
    want = plain_graph(said)
    assert sum(map(len, want.values())) > 100
    assert got == want


@pytest.mark.parametrize("kind", ["addresses", "numbers"])
def test_a_text_of_a_megabyte(spark, kind):
    one = (lambda k: f"a{k}@b{k % 7}.org") if kind == "addresses" else (lambda k: f"id {100_000 + k}")
    text = " ".join(one(k) for k in range(80_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.find(df, carry=["doc_id"]).first()
    clean = pii.redact(df).first()["text"]
    took = time.time() - began
    at, want = 0, []
    for k in range(80_000):
        want.append((at, at + len(one(k))))
        at += len(one(k)) + 1
    if kind == "addresses":
        assert [(x["s"], x["e"]) for x in row["seeds"]] == want
        assert clean == " ".join(["[EMAIL]"] * 80_000)
    else:
        assert row["seeds"] == row["extra"] == [] and clean == text
    assert took < 240, took  # quadratic steps would take an hour
