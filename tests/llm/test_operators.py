"""The ten operators against brute force on small fixtures with nulls, ties, repeats and odd columns."""

import base64
import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from assayframe.llm import ann, bpe, html_main, langid, packing, quality, sharding, simhash, tokenfile, warc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, size long, k string, h long"


def words_of(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [words_of(rng, rng.randint(1, 400)) for _ in range(120)]
    texts += [t.replace(" ", "  ", 1) for t in texts[:20]] + texts[:30]  # near copies and copies
    texts += [words_of(rng, 30000), None, None, "", " \n\t ", "a", "Don't  \n\n   stop\x1c now É́ ﬁ 日本語 <|endoftext|> ΑΣ", "x\x01 y   ", "퟿ end  ", "L'été où ÀÉÎõü ß÷× naïve's µ ªº"]
    out = [(i, t, "en", "s", 7, "z", 1) for i, t in enumerate(texts)]
    out += [(3, "repeated id", "en", "s", 7, "z", 1), (3, "repeated id", "en", "s", 7, "z", 1), (None, "no id", None, None, None, None, None), (None, "no id", None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    docs.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(text):
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def u4(ids):
    return np.array(ids, "<u4").tobytes()


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs, 5).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total, big = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in by:
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r["size"] for r in by[s]) - total / 5) <= big + 0.01 * total / 5
    assert sharding.shard(empty).count() == 0


def test_equal_texts_share_a_shard(spark, empty):
    """Small groups stay whole, a hot one is cut, and both hold for null keys and repeated rows."""
    rng = random.Random(8)
    texts = [words_of(rng, rng.randint(5, 60)) for _ in range(2000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3000 + i, t) for i, t in enumerate(texts[:400])] + [(None, texts[5]), (None, texts[5]), (7, texts[7])]
    rows += [(10_000 + i, "hot " * 40) for i in range(1200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 6).collect()
    shards, sizes = defaultdict(set), Counter()
    for r in got:
        shards[r.text_crc32, r["size"]].add(r.shard)
        sizes[r.shard] += r["size"]
    hot = zlib.crc32(b"hot " * 40)
    assert len(got) == len(rows) and all(len(s) == 1 for (crc, _), s in shards.items() if crc != hot)
    assert len(shards[hot, 168]) > 1
    mean = sum(sizes.values()) / 6
    assert all(abs(n - mean) <= 0.03 * mean for n in sizes.values())


def test_differencing():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (2, 5), (50, 7), (400, 60)):
        sizes = rng.integers(1, 500, n)
        sets = packing.difference(sizes, k)
        assert sorted(i for s in sets for i in s) == list(range(n)) and len(sets) <= max(k, 1)
    assert sorted(int(np.array([8, 7, 6, 5, 4])[s].sum()) for s in packing.difference(np.array([8, 7, 6, 5, 4]), 2)) == [14, 16]
    assert max(len(s) for s in packing.pack_group(np.array([1500] * 5), 2048)) == 1  # more windows as capacity needs


def test_packing(docs, rows, empty):
    got = packing.pack(docs, WORD, group_tokens=20_000, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(u4(r.ids)) == r.ids_crc32 and len(r.ids) == r.length
    want = defaultdict(Counter)
    for d, t, *_ in rows:
        want[d].update([tuple(ids_of(t))])
    for d, texts in want.items():
        if sum(texts.values()) == 1:
            whole = [i for r in sorted(pieces[d], key=lambda r: r.start) for i in r.ids]
            assert tuple(whole) in texts and all(r.doc_tokens == len(whole) for r in pieces[d])
    assert sum(r.length for r in got) == sum(len(t) * n for c in want.values() for t, n in c.items())
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(empty, WORD).count() == 0


def test_token_files(spark, docs, rows, empty, tmp_path):
    path = str(tmp_path / "store")
    tokenfile.write(docs, WORD, path)
    got = tokenfile.lookup(spark, path, docs.select("doc_id")).collect()
    want = sorted(((-1 if d is None else d), tuple(ids_of(t))) for d, t, *_ in rows)
    start, expected = 0, Counter()
    by_key = defaultdict(list)
    for d, ids in want:
        by_key[d].append(ids)
    ordered = sorted(got, key=lambda r: r.start)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in ordered] == [d for d, _ in want]
    for r in ordered:
        assert r.start == start and r.n_tokens == len(r.ids_raw) // 4 and r.ids_crc32 == zlib.crc32(r.ids_raw)
        start += r.n_tokens
        expected[(-1 if r.doc_id is None else r.doc_id), tuple(np.frombuffer(r.ids_raw, "<u4").tolist())] += 1
    assert expected == Counter(want)
    some = spark.createDataFrame([(5,), (99999,), (5,), (-4,)], "doc_id long")
    assert [r.doc_id for r in tokenfile.lookup(spark, path, some).collect()] == [5]
    assert tokenfile.write_and_read(empty, WORD).count() == 0


def test_token_files_of_wide_keys(spark, tmp_path, monkeypatch):
    keys = [2**53 + 1, 2**53 + 3, None, -(2**62) - 1, 2**63 - 1]
    docs = spark.createDataFrame([(k, f"text of {k}") for k in keys], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 4)  # a segment for each document, all in one task
    monkeypatch.setattr(tokenfile, "BUCKET_KEYS", 1)
    monkeypatch.setattr(tokenfile, "text_slices", lambda batch, column: (batch.slice(i, 1) for i in range(len(batch))))
    path = str(tmp_path / "store")
    tokenfile.write(docs, WORD, path)
    assert spark.read.parquet(f"{path}/segments").count() == 5 and spark.read.parquet(f"{path}/index").count() > 1
    got = tokenfile.lookup(spark, path, docs.select("doc_id")).collect()
    assert {r.doc_id: r.ids_raw for r in got} == {k: u4(ids_of(f"text of {k}")) for k in keys}


def test_other_tokenizer_files_use_the_library(tmp_path):
    from assayframe.llm.tokens import BlockTokenizer

    parts = json.loads(open(WORD).read())
    parts["normalizer"] = None
    path = str(tmp_path / "cased.json")
    open(path, "w").write(json.dumps(parts))
    texts = ["The Cat's OUT", None, "", "ÀÉ  x\n"]
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    offsets, ids = BlockTokenizer(path).encode(pa.array(texts), 1)
    assert not BlockTokenizer(path).by_words and BlockTokenizer(WORD).by_words
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]


def test_mph():
    for n in (1, 2, 3, 10, 997):
        h = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        seeds, slots = tokenfile.build_mph(h)
        assert sorted(slots) == list(range(n)) and (tokenfile.probe_mph(h, seeds, n) == slots).all()


def brute_fingerprint(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = regex.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, budget):
    near = lambda a, b: (a ^ b).bit_count() <= budget
    seen, out = {}, {}
    nodes = sorted(set(fps))
    for a in nodes:
        if a in seen:
            continue
        seen[a], todo = a, [a]
        while todo:
            x = todo.pop()
            for b in nodes:
                if b not in seen and near(x, b):
                    seen[b] = a
                    todo.append(b)
    return seen or out


def test_simhash(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t, 3) for _, t, *_ in rows]
    root = brute_components(fps, 2)
    least = {}
    for (d, *_), fp in zip(rows, fps, strict=True):
        if d is not None:
            least[root[fp]] = min(d, least.get(root[fp], d))
    want = Counter((d, f"{fp:016x}", least.get(root[fp])) for (d, *_), fp in zip(rows, fps, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_trie_walk_finds_every_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))]
    keys = np.unique(np.concatenate([base, np.array(near, np.uint64), np.arange(200, dtype=np.uint64)]))
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    for top, budget in ((0, 2), (0, 3), (5, 2)):
        got = [(int(i), int(j)) for a, b in simhash.trie_pairs(keys, top, budget) for i, j in zip(a, b, strict=True)]
        want = {
            (i, j) for i in range(len(keys)) for j in range(i + 1, len(keys))
            if (int(keys[i]) ^ int(keys[j])).bit_count() <= budget and int(keys[i]) >> (64 - top) == int(keys[j]) >> (64 - top)
        }
        assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want
    table = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    roots = {r.id: r.root for r in simhash.components(simhash.links(table)).collect()}
    want = brute_components([int(k) for k in keys], 2)
    groups = defaultdict(set)
    for k in keys:
        groups[roots.get(int(k.view(np.int64)), int(k.view(np.int64)))].add(int(k))
    brute = defaultdict(set)
    for k, r in want.items():
        brute[r].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_components_of_stars_paths_and_random_graphs(spark):
    edges = [(0, i) for i in range(100, 5100)]  # one centre holds most edges
    edges += [(10_000 + i, 10_001 + i) for i in range(200)]  # a long path
    rng = np.random.default_rng(5)
    edges += [tuple(map(int, e)) for e in rng.integers(20_000, 20_400, (260, 2))]
    edges += [(7, 7), (100, 0), (-5, 10_150)]  # a loop, a repeated edge turned round, a negative id
    forest = {v: v for e in edges for v in e}

    def find(v):
        while forest[v] != v:
            v = forest[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        forest[b] = a
    got = {r.id: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in forest if find(v) != v}


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body class='has-sidebar'>"
    "<nav><ul><li><a href='/x'>Menu</a></li></ul></nav><div class='cookie-notice'>We use cookies</div><div class=ad>Buy this</div>"
    "<div class='post-{n}'><h1>Head &amp; line</h1><p>First  para&nbsp;graph {n} with a good number of words in it.<p>Second <b>bold<br>text</b> here &lt;ok&gt; a < b.</div>"
    "<aside>Side text</aside><div id='comments'><p>A reader comment that is quite long, as comments at times are, on and on it goes.</p></div>"
    "<form><label>Mail</label></form><footer>&copy; site</footer>"
)


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.replace("{n}", str(i)), "x", "y") for i in range(6)]
    rows += [(6, None, None, "x", "y"), (7, "http://[bad", "", "x", "y"), (None, "http://h0.org", "just text &amp;am", "x", "y"), (0, rows[0][1], rows[0][2], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, paths string")
    got = html_main.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    for i in range(6):
        assert text[i] == f"Head & line First para graph {i} with a good number of words in it. Second bold text here <ok> a < b."
    assert text[6] == "" and text[7] == "" and text[None] == "just text &am"
    assert html_main.extract(pages.limit(0)).count() == 0


def brute_stats(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", line)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality(spark, docs, rows, empty):
    rng = random.Random(2)
    more = [(1000 + i, "\n".join([words_of(rng, 20), "a b a b a b", "a b a b a b", "  ", "\x0b|#"] * rng.randint(1, 3)) + " $$$" * (40 * (i % 2)), "en", "s", 1, "z", 1) for i in range(120)]
    table = docs.union(spark.createDataFrame(more, DOCS))
    labels = spark.createDataFrame([(1000 + i, 1 - i % 2, 0, "q") for i in range(120)] + [(None, 1, 0, "q"), (1000, None, 0, "q"), (5, 1, 0, "q")], "doc_id long, quality int, toxic int, text string")
    got = quality.judge(table, labels).collect()
    want = Counter((d, *brute_stats(t)) for d, t, *_ in rows + more)
    assert Counter(tuple(r[:6]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (r.kept is False or not r.base_failed)
    assert all((r.rule > 0) == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and r.doc_id >= 1000)
    assert all(r.kept for r in quality.judge(docs, labels.limit(0)).collect() if not r.base_failed)
    assert quality.judge(empty, labels).count() == 0


def test_warc(spark, tmp_path, monkeypatch):
    pages = [(i, f"http://a/{i}", "é" * (i % 7) + "text\r\n" * i) for i in range(300)] + [(None, None, None), (5, "http://a/5", "again"), (5, "http://a/5", "again")]
    table = spark.createDataFrame([(*p, "f", 1) for p in pages], "page_id long, url string, html string, file string, offset long")
    stored = warc.store(table, 64)
    broken = stored.selectExpr("file", "part", "page_id", "offset", "CASE WHEN page_id IN (5, 7, 250) THEN replace(record, 'e', 'i') ELSE record END AS record")
    a, b = warc.records(stored), warc.records(broken)
    got = warc.audit(a, b, 4).collect()
    assert len(got) == len(pages) and sorted(r.page_id for r in got if r.corrupt) == [5, 5, 5, 7, 250]
    assert not any(r.corrupt for r in warc.audit(a, a, 4).collect())
    light = warc.index(table, 64, other=F.when(F.col("page_id").isin(5, 7, 250), F.replace("record", F.lit("e"), F.lit("i"))).otherwise(F.col("record")))
    assert sorted(map(str, light.drop("other").select(*a.columns).collect())) == sorted(map(str, a.collect()))
    assert sorted(map(str, light.drop("digest").withColumnRenamed("other", "digest").select(*b.columns).collect())) == sorted(map(str, b.collect()))
    short = warc.records(warc.store(table.where("page_id < 299"), 64))
    assert 299 in [r.page_id for r in warc.audit(a, short, 4).collect() if r.corrupt]
    for f in {r.file for r in got}:
        own, at = sorted((r for r in got if r.file == f), key=lambda r: r.offset), 0
        for r in own:
            assert r.offset == at
            at += r.length
    assert warc.audit(a.limit(0), b.limit(0)).count() == 0
    # Through real files and back.
    path = str(tmp_path / "warc")
    warc.write_files(stored, path)
    back = warc.read_files(spark, path)
    assert Counter((r.uri, r.body) for r in back.collect()) == Counter((u or "", h or "") for _, u, h in pages)
    assert sorted(map(tuple, back.select("file", "part", "offset", "record").collect())) == sorted(map(tuple, stored.select("file", "part", "offset", "record").collect()))
    assert not any(r.corrupt for r in warc.audit(warc.records(back), a.drop("page_id"), 4).collect())
    # An id that a large part of the pages share goes on in further parts.
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 50)
    hot = warc.store(table.withColumn("page_id", table.page_id * 0 + 1), 64)
    sizes = [r["count"] for r in hot.where("file = 0").groupBy("file", "part").count().collect()]
    assert len(sizes) > 3 and sum(sizes) == len(pages) - 1 and warc.audit(warc.records(hot), warc.records(hot), 4).where("corrupt").count() == 0


def test_warc_format():
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n"
    good = head + b"Content-Length: 4\r\n\r\na\r\nb\r\n\r\n"
    assert [(at, body) for at, *_, body in warc.parse(good * 2)] == [(0, "a\r\nb"), (len(good), "a\r\nb")] and list(warc.parse(b"")) == []
    for bad in (good[:-1], good + b"x", good.replace(b": 4", b": 3"), good.replace(b": 4", b": x"), good.replace(b"WARC-Date", b"Date"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"-Type:", b"-Type")):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_bpe(stored, rows, empty):
    got = bpe.encode(stored, BYTE, public_tokenizers.PATTERN).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((d, u4(t.encode_ordinary(x or "")), (x or "").encode()) for d, x, *_ in rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    d = bpe.digests(stored, BYTE, public_tokenizers.PATTERN).where("doc_id = 1").first()
    assert d.decoded_sha256 == hashlib.sha256(rows[1][1].encode()).hexdigest()
    assert bpe.encode(empty, BYTE, public_tokenizers.PATTERN).count() == 0


def test_bpe_over_blocks(stored, rows, monkeypatch):
    """Many blocks and runs share their words."""
    coder, finish = bpe.encoding(BYTE, public_tokenizers.PATTERN), lambda ids, decoded: [ids, decoded]
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(bpe, "RUN_CODES", 300)
    table = stored.toArrow().select(["doc_id", "text"])
    made = [r for b in bpe._split_rows(iter(table.to_batches(max_chunksize=7)), public_tokenizers.PATTERN, 5) for r in b.to_pylist()]
    words = [r for r in made if r["lot"] >= 0]
    assert len({r["owner"] for r in words}) > 20 and max(Counter(r["block"] for r in made if r["lot"] < 0).values()) > 1
    coded = [c for lot in range(5) for b in bpe._coded_rows(iter([pa.RecordBatch.from_pylist([r for r in words if r["lot"] == lot], schema=bpe._ROW)]), coder) for c in b.to_pylist()]
    kind, got = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_binary()), ("decoded", pa.large_binary())]), []
    for block in {r["owner"] for r in words}:
        own = pa.Table.from_pylist([r for r in made if r["block"] == block], schema=bpe._ROW)
        back = pa.Table.from_pylist([c for c in coded if c["block"] == block])
        got += bpe._laid_out(own, back, BYTE, finish, kind).to_pylist()
        with pytest.raises(ValueError, match="changed"):
            bpe._laid_out(own, back.slice(1), BYTE, finish, kind)
    assert Counter((r["doc_id"], r["ids"], r["decoded"]) for r in got) == Counter((d, u4(coder.encode_ordinary(x or "")), (x or "").encode()) for d, x, *_ in rows)


def test_codes_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 400000000])
    assert (bpe.unpack_codes(bpe.pack_codes(x)) == x).all() and len(bpe.unpack_codes(b"")) == 0


def test_language(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    want = {r.doc_id: (r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()}
    assert len(got) == len(want)
    held = [d for d in want if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sorted(d for d in got if got[d].held_out) == sorted(held)
    assert sum(got[d].lang_pred == want[d][1] for d in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 34 !", "en"), (3, "", "en"), (None, "the of and", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text", "lang").union(odd.selectExpr("doc_id + 100000", "text", "lang"))).collect()}
    assert [out[100000 + i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(empty).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 1, "c") for i, v in enumerate(x)]
    rows += [(1000, None, 1, "c"), (1020, [0.0] * 16, 1, "c"), (1040, [float("nan")] * 16, 1, "c"), (1060, [None] * 16, 1, "c"), (None, x[0].tolist(), 1, "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int, cell string")
    got = defaultdict(list)
    for r in ann.search(table).collect():
        got[r.query_id].append(r)
    d, hits = x.astype(np.float64), 0
    assert sorted(got) == list(range(0, 900, 20))
    for q, found in got.items():
        s = (d * d[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21))
        hits += len({r.vec_id for r in found} & set(want))
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
    assert hits >= 0.9 * 20 * len(got)
    few = ann.search(table.where("vec_id < 5")).collect()
    assert len(few) == 4 and ann.search(table.limit(0)).count() == 0


def test_neighbours_of_odd_vectors(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(30)] + [(40, [1.0, 2.0, 3.0]), (60, [1.0]), (80, [float("inf"), 1.0]), (100, []), (20, [5.0, 5.0, 5.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted({r.query_id for r in got}) == [0, 20] and not {40, 60, 80, 100} & {r.vec_id for r in got}
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == list(range(29, 9, -1))
    assert ann.search(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")).count() == 0


def test_neighbours_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(600, 8)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, ann.search(table).collect()))
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(ann, "CELLS", 150)
    assert sorted(map(tuple, ann.search(table).collect())) == whole


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 8))
    x[[7, 9, 11, 13]] = np.outer([3, 3.1, 3.2, 3.3], x[0])  # the nearest to 0, each stored 60 times
    x[20:100] = np.outer(np.linspace(2.5, 2.9, 80), x[0])  # near ones in all cells
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[i].tolist()) for i in (7, 9, 11, 13)] * 59
    rows += [(8, (2 * x[0] + 0.01 * k).tolist()) for k in range(5)]  # one id, other vectors: a candidate with each
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), target=1.0).where("query_id = 0").collect()
    each = sorted({(i, tuple(v)) for i, v in rows if i != 0}, key=lambda r: (-float(np.dot(r[1], x[0])), r[0]))[:20]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [i for i, _ in each]
