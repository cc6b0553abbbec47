"""The byte automaton and the draw against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from assayframe.llm import resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n long, bucket long, rank long, score double"


def words_of(text):
    return WORD.findall(re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (text or "").encode()))


def runs_of(text, runs):
    w = words_of(text)
    return [zlib.crc32(b" ".join(w[i : i + k])) % resample.BUCKETS for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def some_texts():
    rng = random.Random(2)
    edge = resample.STEPS
    out = [None, "", "a", "Ab1 c", " x ", "é", "日本 É_b", "x y z", "!!", "\x00a\x00", "end", "begin"]
    out += ["w" * n for n in (edge - 1, edge, edge + 1, 4 * edge)] + ["a" * 200 + " b" + "ç" * 100, "L" * 100_000]
    return out + ["".join(rng.choices("aB1é _.Z\n日", k=rng.randint(0, 300))) for _ in range(200)]


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_automaton(runs):
    texts = some_texts()
    whole = pa.array(texts)
    for array, own in ((whole, texts), (whole.slice(5, 40), texts[5:45]), (pa.array(texts, pa.large_string()), texts), (pa.array([], pa.string()), []), (pa.array([None, ""]), [None, ""])):
        row, bucket, counts = resample.features(array, runs)
        got = [Counter(bucket[row == i].tolist()) for i in range(len(own))]
        assert got == [Counter(runs_of(t, runs)) for t in own]
        assert counts.tolist() == [len(words_of(t)) for t in own]


def expected(docs, target, percent=10, least=20, seed=2024, runs=1):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(runs_of(text, runs))
    for text in target:
        t.update(runs_of(text, runs))
    all_s, all_t, n = sum(s.values()), sum(t.values()), resample.BUCKETS
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000.0) / ((s[b] + 1.0) * (all_t + 10000.0)))) for b in range(n)]
    rows = []
    for doc_id, text in docs:
        own = runs_of(text, runs)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in rows)


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 0.5) for r in rows], SCHEMA).repartition(5)


def documents():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary[: rng.choice((50, 400))], k=rng.randint(0, 120)))) for i in range(900)]
    rows += [(2000 + i, rows[3][1]) for i in range(300)] + [(7, rows[7][1])] * 3  # copies and repeated rows
    rows += [(None, rows[5][1]), (None, None), (3000, None), (3001, ""), (3002, "word " * 60_000), (3003, "x" * 1_000_000)]
    return rows, [" ".join(rng.choices(vocabulary[:60], k=30)) for _ in range(40)] + [None, ""]


@pytest.mark.parametrize(("runs", "percent", "least"), [(1, 10, 20), (2, 33, 1), (1, 100, 0)])
def test_draw(spark, runs, percent, least):
    rows, target = documents()
    held = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")
    got = Counter(tuple(r) for r in resample.resample(make(spark, rows), held, percent, least, runs=runs).collect())
    assert got == expected(rows, target, percent, least, runs=runs)


def test_drawn_are_nearer_to_the_target(spark):
    rows, target = documents()
    held = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample.resample(make(spark, rows), held).collect()
    drawn = [r.weight for r in out if r.rank]
    assert np.mean(drawn) > np.mean([r.weight for r in out if r.n_features >= 20])
    kept = resample.keep(make(spark, rows), held)
    assert kept.columns == make(spark, rows).columns
    ids = {r.doc_id for r in out if r.rank}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in rows if d in ids)


def test_empty_tables(spark):
    none, rows = make(spark, []), [(i, "some words of text " * 10) for i in range(30)]
    target = spark.createDataFrame([("words",)], "text string")
    assert resample.resample(none, target).count() == 0
    assert Counter(tuple(r) for r in resample.resample(make(spark, rows), target.limit(0)).collect()) == expected(rows, [])
