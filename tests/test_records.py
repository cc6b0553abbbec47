"""Row assembly, expressions, reports and incremental scoring on small fixtures."""

import math
from fractions import Fraction

import pytest
from assayframe.functions import probability as P
from assayframe.functions import text as T
from assayframe.operators import records, report
from assayframe.streaming import shards
from pyspark.sql import functions as F


def test_prompt_keeps_braces_of_a_passage(spark):
    df = spark.createDataFrame([("a {question} b", "why?"), (None, "q")], "p string, q string")
    got = [r.x for r in df.select(records.prompt(F.col("p"), F.col("q"), system="S").alias("x")).collect()]
    assert got == ["S\nPassage: a {question} b\nQuestion: why?\nAnswer:", None]


def test_runtime_and_prediction_rows(spark):
    inputs = spark.createDataFrame([(1, "q", "one two"), (2, "q", "x " * 20)], "doc_id long, question string, passage string")
    degraded = spark.createDataFrame(
        [(1, "c", "ok", None, "one two"), (2, "c", "ok", None, "x " * 20), (1, "d", "not_applicable", "no_sentence", None), (2, "d", "ok", None, "x")],
        "doc_id long, condition string, status string, reason string, transformed string",
    )
    rows = records.runtime_rows(inputs, degraded, most=10)
    got = {(r.doc_id, r.condition): (r.status, r.reason, r.prompt_tokens, r.changed) for r in rows.collect()}
    assert got[1, "c"] == ("ok", None, 6, False) and got[2, "c"] == ("too_long", "prompt_over_limit", 24, False)
    assert got[1, "d"] == ("not_applicable", "no_sentence", None, None) and got[2, "d"] == ("ok", None, 5, True)
    assert not {"passage", "question", "transformed"} & set(rows.columns)
    scores = spark.createDataFrame([(1, "c", "m", 0.0, " No\nConfidence: 7"), (2, "c", "m", 3.0, "x")], "doc_id long, condition string, method string, margin double, completion string")
    out = {(r.doc_id, r.condition): (r.run_status, r.run_reason, r.p_yes, r.answer) for r in records.prediction_rows(rows, scores).collect()}
    assert out[1, "c"] == ("ok", None, 0.5, "Yes") and out[2, "c"] == ("not_run", "prompt_over_limit", None, None)
    assert out[1, "d"][:2] == ("not_run", "no_sentence") and out[2, "d"] == ("missing", None, None, None)


def test_counts_and_identities(spark):
    rows = spark.createDataFrame([("a", None), ("a", "x"), ("b", "x")], "method string, reason string")
    assert sorted(map(tuple, records.prediction_counts(rows, ["method", "reason"]).collect())) == [("method", "a", 2), ("method", "b", 1), ("reason", "none", 1), ("reason", "x", 2)]
    kept = records.envelope(rows, [("a", "id")])
    assert {(r.method, r.adapter_id) for r in kept.collect()} == {("a", "id")}
    assert [r.method for r in records.identities(kept.withColumn("adapter_id", F.coalesce("reason", F.lit("y"))), "method", "adapter_id").collect()] == ["a"]
    assert records.prediction_counts(rows.limit(0), ["method"]).count() == 0


def test_optimizer_steps():
    assert records.optimizer_steps(800, 4, 8, 3) == 75
    with pytest.raises(ValueError):
        records.optimizer_steps(801, 4, 8, 3)


def test_warmup_ends_at_one_and_decay_at_zero(spark):
    f = [r.f for r in spark.range(11).orderBy("id").select(P.warmup_cosine(F.col("id"), 10, 2).alias("f")).collect()]
    assert f[:3] == [0.5, 1.0, 1.0] and f[10] == pytest.approx(0, abs=1e-12)
    assert [r.f for r in spark.range(1).select(P.warmup_cosine(F.col("id"), 10, 0).alias("f")).collect()] == [1.0]


def test_reduced(spark):
    pairs = [(a, b) for a in range(0, 30) for b in range(1, 30)] + [(832040, 1346269), (0, 0), (1 << 19, 1 << 20)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", P.reduced(F.col("a"), F.col("b"), 1 << 21).alias("f")).collect()
    for r in got:
        want = Fraction(r.a, r.b) if r.b else Fraction(0, 1)
        assert r.f == f"{want.numerator}/{want.denominator}"


def test_logits(spark):
    x = [[1000.0, 1001.0, 1001.0], [-5.0], [0.0, math.log(3)]]
    got = spark.createDataFrame([(v,) for v in x], "x array<double>").select(P.log_sum_exp(F.col("x")).alias("l"), P.argmax(F.col("x")).alias("a"), P.softmax_entropy(F.col("x")).alias("h")).collect()
    for v, r in zip(x, got, strict=True):
        p = [math.exp(a - max(v)) for a in v]
        assert r.l == pytest.approx(max(v) + math.log(sum(p))) and r.a == v.index(max(v))
        assert r.h == pytest.approx(-sum(a / sum(p) * math.log(a / sum(p)) for a in p), abs=1e-12)


def test_text_expressions(spark):
    text = '  One. "Two!"  three\n\n 😀 four? '
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = [[text[s.start : s.stop] for s in r.s] for r in df.select(T.spans(F.col("t")).alias("s")).collect()]
    assert got == [["One.", '"Two!"', "three", "😀 four?"], [], []]
    ids = spark.createDataFrame([([4, 5, 1, 2],), ([1, 2],), ([7],), ([],)], "i array<int>").select(T.trim_ids(F.col("i"), 1, 2).alias("i"))
    assert [r.i for r in ids.collect()] == [[4, 5], [], [7], []]
    one = spark.createDataFrame([("--A  b/C!", "x\n y" + "z" * 600)], "a string, b string").select(T.slug(F.col("a")).alias("a"), T.sanitized(F.col("b")).alias("b")).first()
    assert one.a == "a-b-c" and one.b == ("x y" + "z" * 600)[:500]


def test_report(spark, monkeypatch):
    df = spark.createDataFrame([("b", 0.5, None), ("a", 1.0, 3)], "k string, v double, n int")
    assert report.markdown(df, ["k"]) == "| k | v | n |\n|---|---|---|\n| a | 1.0000 | 3 |\n| b | 0.5000 | n/a |\n"
    assert (report.percent(0.12345), report.signed(0.5, 2), report.decimal(None), report.interval(1, 2)) == ("12.35%", "+0.50", "n/a", "[1.00, 2.00]")
    monkeypatch.setattr(report, "MOST_ROWS", 1)
    with pytest.raises(ValueError):
        report.markdown(df, ["k"])


def test_new_files_are_scored_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    score = lambda df: df.select("id", (F.col("id") * 2).alias("twice"))
    for start in (0, 10):
        spark.range(start, start + 5).write.mode("append").parquet(source)
        shards.score_new_files(spark, source, "id long", score, target, mark)
    shards.score_new_files(spark, source, "id long", score, target, mark)  # nothing new
    got = sorted((r.id, r.twice) for r in spark.read.parquet(target).collect())
    assert got == [(i, 2 * i) for i in [*range(5), *range(10, 15)]]


def test_marks_and_white_space_of_a_text(spark):
    texts = ["Then\x01 left. \x01e and\x01c on", "No break. Next one ", "a.\x1cb", "x\x0b.\n\ny\x85"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.sentences(F.col("t")).alias("s"), T.spans(F.col("t")).alias("p"), T.words(F.col("t")).alias("w"), T.segments(F.col("t")).alias("cut")).collect()
    for r in rows:
        assert r.s == [r.t[p.start : p.stop] for p in r.p] and r.w == r.t.split() and "".join(r.cut) == r.t
    assert rows[0].s == ["Then\x01 left.", "\x01e and\x01c on"] and rows[1].s == ["No break.", "Next one"]


def test_distractor_over_chunks(spark, monkeypatch):
    from hashlib import sha256

    from assayframe.operators import degrade
    from assayframe.operators.validation import ContractError

    docs = spark.createDataFrame([(i, f"what w{i % 5} is", f"w{i % 7} w{i % 3} text {i}") for i in range(40)] + [(50, "q", ""), (51, "w1", "  ")], "doc_id long, question string, passage string")
    rows = {r.doc_id: r for r in docs.collect()}
    donors = degrade.donors_of(docs)
    want = {}
    for d, r in rows.items():
        found = []
        for e, o in rows.items():
            if e != d and o.passage != r.passage and o.passage.split():
                q, t = set(r.question.split()), set(o.passage.split())
                tie = sha256(f'{{"candidate_example_id":"{e}","condition_version":"{degrade.VERSION}","seed":7,"target_example_id":"{d}"}}'.encode()).hexdigest()
                found.append((len(q & t) / len(q | t), tie, str(e)))
        want[d] = (*min(found), len(found))
    for chunk in (8192, 3):
        monkeypatch.setattr(degrade, "CHUNK_DONORS", chunk)
        got = {r.doc_id: r for r in degrade.distractor(docs, donors, 7).collect()}
        assert {d: (r.overlap, r.tie, str(r.donor_id), r.eligible) for d, r in got.items()} == want
    assert got[50].transformed == "\n\n" + " ".join(rows[got[50].donor_id].passage.split())
    alone = degrade.distractor(docs.where("doc_id = 1"), donors.where("donor_id = 1"), 7).first()
    assert (alone.status, alone.reason, alone.transformed, alone.eligible) == ("not_applicable", "no_eligible_donor", None, 0)
    assert degrade.distractor(docs.limit(0), donors, 7).count() == 0
    with pytest.raises(ContractError):
        degrade.distractor(docs, donors.unionByName(donors.where("donor_id = 4")), 7)
    whole = degrade.all_conditions(docs, donors, 7)
    assert whole.count() == 6 * docs.count()


def test_labels_join_by_key(spark):
    from assayframe.operators import calibration, ensemble, metrics
    from assayframe.operators.validation import ContractError

    scores = spark.createDataFrame([(1, 0.5), (2, 0.1), (1, 0.2)], "doc_id long, margin double")
    labels = spark.createDataFrame([(2, 0), (1, 1), (3, 1)], "doc_id long, quality int")
    got = metrics.attach_labels(scores, labels)
    assert sorted((r.doc_id, r.margin, r.quality) for r in got.collect()) == [(1, 0.2, 1), (1, 0.5, 1), (2, 0.1, 0)]
    with pytest.raises(Exception, match="no label for 2"):
        metrics.attach_labels(scores, labels.where("doc_id <> 2")).collect()
    with pytest.raises(Exception, match="two labels for 1"):
        metrics.attach_labels(scores, labels.unionByName(labels)).where("doc_id = 1").collect()
    with pytest.raises(ContractError):
        metrics.attach_labels(got, labels)
    with pytest.raises(ContractError):
        calibration.aligned(labels, scores, "doc_id")
    members = spark.createDataFrame([(1, "c", True, f"seed_{i}", 0.4, True) for i in (1, 2)], "doc_id long, condition string, truth boolean, method string, p_cal double, says_yes boolean")
    with pytest.raises(Exception, match="ensemble members of input 1"):
        ensemble.combine(members).collect()


def test_multinomial_weights(spark):
    from assayframe.operators import bootstrap

    clusters = spark.range(50).withColumnRenamed("id", "doc_id")
    rows = bootstrap.multinomial_weights(clusters, "doc_id", 300, 3).collect()
    per = [sum(r.weight for r in rows if r.replicate == k) for k in range(300)]
    assert per == [50] * 300
    each = [sum(r.weight for r in rows if r.doc_id == d) / 300 for d in range(50)]
    assert all(0.7 < m < 1.3 for m in each)
    twos = sum(r.weight * (r.weight - 1) for r in rows) / (300 * 50)
    assert twos == pytest.approx(49 / 50, abs=0.05)  # of a multinomial: n (n - 1) p squared


def test_contract_helpers(spark):
    from assayframe.operators import contracts, validation
    from assayframe.operators.validation import ContractError

    df = spark.createDataFrame([(1, ["a", None], ("b",))], "n int, l array<string>, s struct<t: string>")
    assert validation.exact_columns(df, {"n", "l", "s"}) is df
    with pytest.raises(ContractError):
        validation.exact_columns(df, {"n"})
    with pytest.raises(ContractError):
        validation.without_columns(df, {"t"})
    assert validation.require(df, {"positive": F.col("n") > 0}) is df
    with pytest.raises(ContractError, match="positive"):
        validation.require(df, {"positive": F.col("n") > 1})
    told = df.withColumn("raw", F.lit("b"))
    assert contracts.raw_text_leaks(told, ["raw"]).count() == 1 and contracts.raw_text_leaks(told.withColumn("raw", F.lit("")), ["raw"]).count() == 0
    with pytest.raises(ContractError):
        contracts.parameter_rules(spark.createDataFrame([((1.5,),)], "parameters struct<x: double>"))


def test_exact_prefixes():
    from assayframe.functions import sequences

    class Odd(sequences.Words):
        """A word that ends in "-" takes the next one with it when it is read again."""

        def encode(self, text):
            return text.replace("- ", "-").split()

        def decode(self, ids):
            return " ".join(ids).replace("-", "- ")

    assert sequences.longest_prefix(sequences.Words(), " a  b c ", 2) == ("a b", 2, 3)
    assert sequences.longest_prefix(sequences.Words(), "  ", 2) is None and sequences.longest_prefix(sequences.Words(), "a", 0) is None
    assert sequences.longest_prefix(Odd(), "a b- c d", 2) == ("a b- c", 2, 3)
    memo = sequences.Memo(sequences.Words(), most=1)
    assert [memo.encode(t) for t in ("a b", "a b", "c")] == [["a", "b"], ["a", "b"], ["c"]] and len(memo.known) == 1


def test_vector_digest(spark):
    import hashlib
    import struct

    from assayframe.operators import identity

    rows = [([1.0, -2.5],), ([],), (None,), ([1.0, None],), ([1.0, -2.5],)]
    got = [r.d for r in spark.createDataFrame(rows, "v array<double>").select(identity.vector_digest(F.col("v")).alias("d")).collect()]
    want = hashlib.sha256(struct.pack("<q2d", 2, 1.0, -2.5)).hexdigest()
    assert got == [want, hashlib.sha256(bytes(8)).hexdigest(), None, None, want]


def test_replicates_against_resampled_rows(spark, monkeypatch):
    """All measures of every replicate from rows repeated by their cluster's weight; several blocks and several buckets."""
    import random
    from collections import Counter

    from assayframe.operators import bootstrap

    monkeypatch.setattr(bootstrap, "BLOCK_CLUSTERS", 9)
    monkeypatch.setattr(bootstrap, "BLOCK_SCORES", 40)
    monkeypatch.setattr(bootstrap, "BLOCK_REPLICATES", 7)
    rng = random.Random(9)
    data = [(m, s, i, rng.random() < 0.6, round(rng.random(), 1), rng.random(), rng.random(), rng.random()) for m in ("a", "b") for s in ("x|1", "y") for i in range(30) for _ in range(3)]
    rows = spark.createDataFrame(data, "method string, scope string, doc_id long, correct boolean, error_score double, conf_cal double, nll_cal double, brier_cal double")
    clusters = spark.range(30).withColumnRenamed("id", "doc_id")
    weight = Counter({(r.replicate, r.doc_id): r.weight for r in bootstrap.multinomial_weights(clusters, "doc_id", 20, 5).collect()})
    got = bootstrap.replicate_measures(rows, "doc_id", bootstrap.weight_vectors(clusters, "doc_id", 20, 5)).collect()
    assert len(got) == 2 * 2 * 20
    for r in got:
        own = [d for d in data if d[:2] == (r.method, r.scope) for _ in range(weight[r.replicate, d[2]])]
        pos, neg = [d[4] for d in own if not d[3]], [d[4] for d in own if d[3]]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert (r.accuracy, r.nll, r.auroc) == pytest.approx((len(neg) / len(own), sum(d[6] for d in own) / len(own), wins), abs=1e-12)


def _few(spark):
    """Inputs of which one has no donor, since all others have its passage or none, and one has no question."""
    return spark.createDataFrame([(i, "what w1 is" if i else "?", "w1 here. w2 there.") for i in range(8)] + [(8, "w1", "w3 alone"), (9, "w2", "")], "doc_id long, question string, passage string")


def test_states_without_choosing_donors(spark, monkeypatch):
    from assayframe.operators import degrade

    docs = _few(spark)
    fields = ["doc_id", "condition", "condition_index", "status", "reason"]
    for own in (docs, docs.where("doc_id < 8")):
        donors = degrade.donors_of(own)
        want = degrade.all_conditions(own, donors, 7).select(*fields).collect()
        with monkeypatch.context() as m:
            m.setattr(degrade, "chosen_donors", None)
            assert sorted(map(str, degrade.all_states(own, donors).select(*fields).collect())) == sorted(map(str, want))
    donors = degrade.donors_of(docs)
    want = {r.doc_id: r.eligible for r in degrade.distractor(docs, donors, 7).collect()}
    assert {r.doc_id: r.eligible for r in degrade.eligible_donors(docs, donors).collect()} == want


def _without_pairs(spark, monkeypatch, name):
    """The query's rows, with the choice of donors taken away."""
    from assayframe.operators import degrade
    from assayframe.plans import catalog

    monkeypatch.setattr(degrade, "chosen_donors", None)
    return catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()


def test_status_counts_meet_no_pairs(spark, monkeypatch):
    rows = _without_pairs(spark, monkeypatch, "status_counts")
    assert {r.condition for r in rows} == {"original", "lexical_evidence_removal", "prefix_truncation_50", "irrelevant_distractor", "lexical_contradiction", "no_passage"}


def test_incomplete_inputs_meet_no_pairs(spark, monkeypatch):
    assert all(r.doc_id % 31 == 8 for r in _without_pairs(spark, monkeypatch, "incomplete_inputs"))


def test_condition_sizes_meet_no_pairs(spark, monkeypatch):
    assert {r.condition for r in _without_pairs(spark, monkeypatch, "condition_sizes")} <= {"original", "no_passage", "unknown"}


def test_blocks_and_chunks_are_written_once(spark, monkeypatch):
    """No copy of a donor for each block, nor of a target for each chunk, on the way to the pairs."""
    from assayframe.operators import degrade

    plans = []
    monkeypatch.setattr(degrade, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    monkeypatch.setattr(degrade, "CHUNK_DONORS", 3)
    docs = _few(spark)
    degrade.distractor(docs, degrade.donors_of(docs), 7)
    assert len(plans) == 1 and "Generate" not in plans[0] and ("CartesianProduct" in plans[0] or "BroadcastNestedLoopJoin" in plans[0])


def test_scores_are_not_broadcast(spark):
    from assayframe.operators import records
    from assayframe.sources import fixtures

    runtime = spark.createDataFrame([(1, "original", "ok", None, "x", 1)], "doc_id long, condition string, status string, reason string, prompt_sha string, prompt_tokens long")
    plan = records.prediction_rows(runtime, fixtures.predictions(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


#: Queries that choose donors.
CHOOSING = ("degradation_summary", "degraded_faults", "degraded_tokens", "donor_reuse", "flag_counts", "prediction_faults", "runtime_rows", "distractor_by_tokens", "prompt_deltas", "runtime_records", "donor_fragments",)


@pytest.mark.parametrize("name", CHOOSING)
def test_donors_are_chosen_once_and_copied_nowhere(spark, monkeypatch, name):
    from assayframe.operators import degrade
    from assayframe.plans import catalog

    plans, staged = {}, degrade.staged
    monkeypatch.setattr(degrade, "staged", lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, name), raising=False)
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert list(plans) == ["chosen"] and len(plans["chosen"]) == 1 and "Generate" not in plans["chosen"][0]


#: Queries that meet pairs of inputs and donors.
PAIRED = ("prediction_faults", "prediction_rows", "runtime_records", "flag_counts", "donor_reuse", "donor_fragments", "distractor_by_tokens", "degraded_tokens", "degraded_faults", "degradation_summary", "runtime_rows", "prompt_deltas", "distractor_top1",)


@pytest.mark.parametrize("name", PAIRED)
def test_pairs_are_hashed_where_they_meet(spark, monkeypatch, name):
    """A pair is never written out: one row of a target and chunk leaves a task, with the least hash, and no array of candidates."""
    from assayframe.operators import degrade
    from assayframe.plans import catalog

    plans, staged = [], degrade.staged
    monkeypatch.setattr(degrade, "staged", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or staged(df, name))
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    met = next(x for x in plans[0].splitlines() if "MapInArrow" in x)
    assert len(plans) == 1 and "tie#" in met and "candidates" not in plans[0] and "lambda" not in plans[0].split("MapInArrow")[0]


def test_least_hash_of_a_target():
    from hashlib import sha256

    from assayframe.operators import degrade

    donors = [1, 22, 333, 4444, 55555, 666666, 7777777, 10**18]
    for target in (0, 9, 10**6, 10**18 + 1):
        texts = [f'{{"candidate_example_id":"{d}","condition_version":"{degrade.VERSION}","seed":7,"target_example_id":"{target}"}}' for d in donors]
        hashes = [sha256(t.encode()).hexdigest() for t in texts]
        assert degrade._least_tie(degrade._begun(donors, 7).tolist(), target) == (min(hashes), hashes.index(min(hashes)))


def test_labels_are_never_broadcast(spark):
    """Documents meet labels by the same join at any size; only the benchmark's few rows are broadcast."""
    from assayframe.sources import fixtures

    plan = fixtures.documents_with_questions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1 and plan.count("BroadcastExchange") == 1


def test_incomplete_inputs_stage_inputs_without_broadcast_labels(spark, monkeypatch):
    from assayframe.plans import catalog

    plans, staged = [], catalog.shared.staged
    monkeypatch.setattr(catalog.shared, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, name))
    catalog.queries()["incomplete_inputs"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and plans[0].count("ShuffledHashJoin") == 1 and plans[0].count("BroadcastExchange") == 1


@pytest.mark.parametrize("name", ["degradation_summary", "degraded_faults", "degraded_tokens"])
def test_conditions_carry_their_input(spark, monkeypatch, name):
    """Two joins, of donors and of inputs with them; none that brings the input's text to its conditions a second time."""
    from assayframe.operators import describe
    from assayframe.plans import catalog

    frames = []
    monkeypatch.setattr(describe, "staged", lambda df, name: frames.append(df) or df)
    if name == "degraded_faults":
        monkeypatch.setattr(catalog.contracts, "check", lambda df, rules: df)
    made = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    plan = (frames or [made])[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_conditions_work_out_a_text_once(spark, monkeypatch):
    """The passage is split into words once, for the length, the half and its comparison, and the generator of six rows only reads columns."""
    from assayframe.operators import degrade

    docs = _few(spark)
    assert degrade.prefix_truncation(docs)._jdf.queryExecution().optimizedPlan().toString().count("split(passage") == 1
    monkeypatch.setattr(degrade, "staged", lambda df, name: df)
    plan = degrade.all_conditions(docs, degrade.donors_of(docs), 7)._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "Generate inline" in x)
    assert "regexp" not in line and "slice" not in line and "split(" not in line


def test_bitmap_holds_every_key(spark, monkeypatch):
    """No key is lost, of whatever type, nor with a bitmap that is too small; of other keys few pass."""
    from assayframe.sources import fixtures

    keys = spark.createDataFrame([(i * 7 - 3000,) for i in range(1000)], "doc_id int")
    rows = spark.range(-5000, 5000).withColumnRenamed("id", "doc_id")
    passed = {r.doc_id for r in rows.where(fixtures.may_hold(keys, "doc_id")).collect()}
    own = {r.doc_id for r in keys.collect()}
    assert own <= passed and len(passed - own) < 9000 / 10
    assert rows.where(fixtures.may_hold(keys.limit(0), "doc_id")).count() == 0
    monkeypatch.setattr(fixtures, "MOST_WORDS", 2)
    assert own <= {r.doc_id for r in rows.where(fixtures.may_hold(keys, "doc_id")).collect()}


@pytest.mark.parametrize("name", ["incomplete_inputs", "donor_reuse", "flag_counts", "runtime_rows", "distractor_by_tokens", "donor_fragments", "prediction_faults", "prompt_deltas", "runtime_records"])
def test_texts_without_label_are_not_shuffled(spark, monkeypatch, name):
    """The documents are cut down to those that may have a label below the join that deals them."""
    from assayframe.plans import catalog

    class Staged(Exception):
        pass

    def stop(df, name):
        raise Staged(df._jdf.queryExecution().optimizedPlan().toString(), name)

    monkeypatch.setattr(catalog.shared, "staged", stop)
    with pytest.raises(Staged) as told:
        catalog.queries()[name](spark, "/root/testdata/sf0.001")
    plan, of = told.value.args
    lines = plan.splitlines()
    texts = next(i for i, line in enumerate(lines) if "Relation" in line and "text#" in line and "lang#" in line)
    join = max(i for i, line in enumerate(lines[:texts]) if "Join " in line)
    assert of == "inputs" and any("getbit" in line for line in lines[join + 1 : texts])
