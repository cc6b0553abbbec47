"""The pipeline's stages against brute force on the small documents."""

import random

import corpus_pipeline
import public_tokenizers
from assayframe.llm import langid, quality, simhash
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    known = langid.keep(docs)
    assert known.columns == docs.columns
    rejected = {r.doc_id for r in langid.identify(docs).where("rejected").collect()}
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in docs.collect()} - rejected
    good = quality.keep(docs, labels)
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in quality.judge(docs, labels).where("kept").collect())


def test_near_copies(spark):
    base = [f"w{i}a w{i}b " + " ".join(f"x{(i * 37 + j * j) % 5003}" for j in range(200)) for i in range(30)]
    near = [t.replace(" x", " y", 1) for t in base[:10]]  # similarity about 0.95
    far = [" ".join(t.split()[:100]) for t in base[10:15]]  # about a half
    texts = [*base, *near, *base[:5], *far, None, "", "short"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, base[3], 1), (7, base[7], 1)], "doc_id long, text string, sig int")
    kept = sorted((r.doc_id for r in simhash.keep_one(docs).collect()), key=lambda d: (d is None, d))
    alike = lambda a, b: len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))
    want = [i for i, t in enumerate(texts) if not any(alike(t, u) for u in texts[:i])]
    assert kept == want
    assert simhash.keep_one(docs.limit(0)).count() == 0


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in simhash.keep_one(docs).collect())


def brute_force(texts):
    """Pairs of similarity 0.8 or more, and the rows that stay: the least of each connected group."""
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    root = list(range(len(texts)))
    for i, j in pairs:
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    return pairs, sorted(set(root))


def test_near_copies_are_of_sets(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    texts = []
    for _ in range(5):  # different texts that share a line, which is repeated in both
        line = " ".join([words(10)] * 20)
        texts += [f"{words(500)} {line}", f"{words(500)} {line}"]
    base = words(500)
    texts += [f"{base} {' '.join([words(10)] * 20)}" for _ in range(5)]  # one text, each time with another repeated line
    _, want = brute_force(texts)
    assert want == list(range(11))
    assert kept_of(spark, texts) == want


def test_links_are_exact(spark):
    rng = random.Random(12)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]

    def cut(base, similarity):  # a text that shares a prefix with base, at this similarity
        same = round(2 * similarity / (1 + similarity) * len(base))
        return " ".join(base[:same] + words(len(base) - same))

    texts = []
    for similarity in (0.6, 0.7, 0.74, 0.78, 0.85, 0.9):
        for _ in range(20):
            base = words(400)
            texts += [" ".join(base), cut(base, similarity)]
    for _ in range(5):  # around one text: revisions that link to each other but not to it
        base = words(400)
        revised = base[:345] + words(55)
        texts += [" ".join(base), *(" ".join(revised[: 390 - k] + words(10 + k)) for k in range(4))]
    _, want = brute_force(texts)
    kept = kept_of(spark, texts)
    assert not set(want) - set(kept), "documents without a link at the threshold are deleted"
    assert len(set(kept) - set(want)) <= 2, "at 0.85 and above nearly all pairs are found"


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got and all(n == len(coder.encode(text[d], add_special_tokens=False).ids) + 1 for d, n in got.items())


def test_dense_group_near_the_threshold(spark, monkeypatch):
    """Revisions of one text, most of them just below the threshold: every link counts, whatever blocks they fall into."""
    rng = random.Random(13)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for _ in range(120):
        own = list(base)
        for at in rng.sample(range(300), rng.randint(3, 9)):
            own[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"z{k}_{i}" for i in range(100)) for k in range(20)]
    pairs, want = brute_force(texts)
    assert len(pairs) > 100 and len(want) > 25
    assert kept_of(spark, texts) == want
    monkeypatch.setattr(simhash, "BLOCK_WEIGHT", 10)
    monkeypatch.setattr(simhash, "COLUMNS", 50)
    assert kept_of(spark, texts) == want


def test_common_counts():
    import numpy as np

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(-50, 50, n) * 2**55) for n in (0, 1, 5, 60, 60, 200)]
    got = simhash.common_counts(sets, sets[1:])
    assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[1:]] for x in sets]


def test_clashing_columns_and_hot_texts(spark):
    one = "one text that a third of all rows hold word for word"
    rows = [(i, one if i % 3 else f"another text number {i} of its own words {i}", f"c{i}", i) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_copy_row_0 string, near_copy_check_0 long")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted([r for r in rows if r[0] % 3 == 0] + [rows[1]])


def test_every_removed_row_is_near_its_group(spark):
    """Over whole tables: a removed row has a similar text in its group, and no two rows that stay are similar."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = {d: shingles(t) for d, t in rows}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    kept, removed = {r.doc_id for r in simhash.keep_one(docs).collect()}, 0
    for d, s in sets.items():
        met = {}
        for x in s:
            for e in where[x]:
                met[e] = met.get(e, 0) + 1
        similar = [e for e, n in met.items() if e != d and n >= 0.8 * (len(s) + len(sets[e]) - n)]
        if d in kept:
            assert not set(similar) & kept
        else:
            assert similar
            removed += 1
    assert removed > 50
