"""Row assembly: prompts, runtime rows of degraded inputs, prediction rows, envelopes and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probability as P
from ..functions import text as T
from .identity import row_hash, text_id
from .parser import parse
from .validation import ContractError

# The user turn and the answer prefix of a prompt.
USER_TEMPLATE = "Passage: {passage}\nQuestion: {question}"
PREFIX = "Answer:"
#: What rows say of how they were made.
PROTOCOL, RENDERER = "evidence-v1", "plain-v1"
#: White-space tokens that a prompt may have.
MOST_TOKENS = 768
METRICS = ("accuracy", "nll", "brier")


def prompt(passage: Column, question: Column, system: str = "", template: str = USER_TEMPLATE, prefix: str = PREFIX) -> Column:
    """System text, user turn and answer prefix. Marks of a chat format, which belong to a tokenizer, go into the three
    texts. Only the template is scanned for fields: braces in a passage are plain text. Null in, null out."""
    fields = {"{passage}": passage, "{question}": question}
    parts, rest = [F.lit(f"{system}\n" if system else "")], template
    while rest:
        at = {f: rest.find(f) for f in fields if f in rest}
        if not at:
            parts.append(F.lit(rest))
            break
        field = min(at, key=at.get)
        parts += [F.lit(rest[: at[field]]), fields[field]]
        rest = rest[at[field] + len(field) :]
    return F.concat(*parts, F.lit("\n" + prefix))


def _runtime(inputs: DataFrame, degraded: DataFrame, most: int) -> DataFrame:
    original = prompt(F.col("passage"), F.col("question"))
    own = inputs.select(
        "doc_id", "question", F.sha2("passage", 256).alias("passage_sha"), F.length("passage").alias("passage_chars"), F.sha2(F.concat_ws("\n", "question", "passage"), 256).alias("input_sha256"),
        F.size(T.words(F.col("passage"))).cast("long").alias("passage_tokens"), F.sha2(original, 256).alias("original_prompt_sha256"), F.size(T.words(original)).cast("long").alias("original_prompt_tokens"),
    )
    rows = degraded.join(own, "doc_id")
    made = prompt(F.col("transformed"), F.col("question"))
    rows = rows.select(
        "*", F.size(T.words(made)).alias("n"), F.sha2(made, 256).alias("made_sha"), F.length(made).cast("long").alias("made_chars"),
        text_id("runtime", F.col("doc_id"), F.col("condition")).alias("row_id"),
    )
    ok = F.col("status") == "ok"
    fits = ok & (F.col("n") <= most)
    return rows.withColumns({
        "question_sha": F.sha2("question", 256), "text_sha": F.sha2("transformed", 256), "text_chars": F.length("transformed").cast("long"),
        "text_tokens": F.size(T.words(F.col("transformed"))).cast("long"), "text_ppm": P.ratio_ppm(F.length("transformed"), F.greatest(F.col("passage_chars"), F.lit(1))),
        "prompt_chars": F.when(ok, F.col("made_chars")), "runs": fits,
        "run_status": F.when(ok & ~fits, "too_long").otherwise(F.col("status")), "run_reason": F.when(ok & ~fits, "prompt_over_limit").otherwise(F.col("reason")),
        "prompt_tokens": F.when(ok, F.col("n").cast("long")), "prompt_sha": F.when(ok, F.col("made_sha")), "changed": F.when(ok, F.sha2("transformed", 256) != F.col("passage_sha")),
    })


def runtime_rows(inputs: DataFrame, degraded: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """One row for each degraded input (doc_id, condition, status, reason, transformed) without its raw text: hash and length of the
    text and of the prompt, and the status. A prompt over ``most`` tokens turns ``ok`` into ``too_long``."""
    return _runtime(inputs, degraded, most).select(
        "row_id", "doc_id", "condition", "passage_sha", "question_sha", "text_sha", "text_chars", "text_tokens", "text_ppm", "prompt_chars", "runs", F.col("run_status").alias("status"),
        F.col("run_reason").alias("reason"), "prompt_tokens", "prompt_sha", "changed",
    )


def runtime_records(inputs: DataFrame, degraded: DataFrame, seed: int, fragment_tokens: int, source_split: str = "validation", most: int = MOST_TOKENS) -> DataFrame:
    """The rows as they are stored: versions, id, origin, the input's and the transformed text's hashes and sizes, both states, flags, parameters and the hash of all that.

    Of the parameters a row has those that its condition takes. No raw text is in it.
    """
    takes = lambda value, *conditions: F.when(F.col("condition").isin(*conditions), F.lit(value))
    parameters = F.struct(
        takes(fragment_tokens, "irrelevant_distractor", "lexical_contradiction").cast("long").alias("fragment_tokens"), takes(seed, "irrelevant_distractor").cast("long").alias("seed"),
        takes("1/2", "prefix_truncation_50").alias("share"),
    )
    rows = _runtime(inputs, degraded, most).select(
        F.lit(1).cast("long").alias("schema_version"), F.lit(PROTOCOL).alias("protocol_version"), F.col("row_id").alias("transformation_id"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("input_id"),
        F.lit("test").alias("research_split"), F.lit(source_split).alias("source_split"), F.col("doc_id").alias("source_index"), "input_sha256", F.col("passage_sha").alias("original_passage_sha256"),
        F.col("passage_tokens").alias("original_passage_tokens"), "original_prompt_sha256", "original_prompt_tokens", F.col("condition_index").cast("long").alias("condition_index"), "condition",
        F.col("status").alias("transformation_status"), F.col("reason").alias("transformation_reason_code"), F.when(F.col("status") == "ok", F.when(F.col("runs"), "ok").otherwise("failed")).otherwise("not_run").alias("runtime_status"),
        F.when(F.col("status") != "ok", "transformation_not_applicable").when(~F.col("runs"), "prompt_over_limit").alias("runtime_reason_code"), F.col("flags").alias("quality_flags"),
        F.col("text_sha").alias("transformed_passage_sha256"), F.when(F.col("status") == "ok", F.col("text_tokens")).alias("transformed_passage_tokens"), F.col("changed").alias("changed_from_original"),
        F.col("prompt_sha").alias("rendered_prompt_sha256"), "prompt_tokens", F.lit(most).cast("long").alias("runtime_maximum_prompt_tokens"), F.lit(RENDERER).alias("renderer_version"), parameters.alias("parameters"),
    )
    return row_hash(rows)


def evaluation_records(rows: DataFrame, temperature_digests: dict[str, str]) -> DataFrame:
    """Evaluated and parsed predictions as they are stored: versions, id, truth and answer, logits, raw and calibrated probabilities, confidences and entropies, the temperature and
    the digest of the file that it came from, the hash of the prediction's row, the stated confidence with its distances, and the hash of all that.

    ``rows`` are those of ``metrics.evaluate`` with the parse (valid, stated, reason); ``temperature_digests`` has one digest a method.
    """
    digest = F.create_map(*(F.lit(x) for pair in temperature_digests.items() for x in pair))[F.col("method")]
    said = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "condition", "method", "completion"), 256)
    stated = F.when(F.col("valid"), F.col("stated").cast("long"))
    name = lambda c: F.when(c, "Yes").otherwise("No")
    out = rows.select(
        F.lit(1).cast("long").alias("schema_version"), F.lit(PROTOCOL).alias("protocol_version"), "method", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("input_id"), F.col("doc_id").alias("source_index"),
        "condition", F.col("condition_index").cast("long").alias("condition_index"), F.array(F.lit("No"), F.lit("Yes")).alias("class_order"), name(F.col("truth")).alias("ground_truth"), name(F.col("says_yes")).alias("token_prediction"),
        "correct", F.col("margin").alias("yes_logit"), F.lit(0.0).alias("no_logit"), F.col("p_raw").alias("raw_p_yes"), (1 - F.col("p_raw")).alias("raw_p_no"), F.col("p_cal").alias("calibrated_p_yes"),
        (1 - F.col("p_cal")).alias("calibrated_p_no"), F.col("conf_raw").alias("raw_confidence"), F.col("conf_cal").alias("calibrated_confidence"), P.entropy(F.col("p_raw")).alias("raw_entropy"),
        F.col("entropy_cal").alias("calibrated_entropy"), "temperature", digest.alias("temperature_artifact_sha256"), said.alias("source_prediction_row_sha256"), F.col("valid").alias("expressed_parser_valid"),
        F.col("reason").alias("expressed_parser_reason_code"), stated.alias("expressed_confidence"), F.abs(stated / 100.0 - F.col("conf_raw")).alias("expressed_raw_absolute_divergence"),
        F.abs(stated / 100.0 - F.col("conf_cal")).alias("expressed_calibrated_absolute_divergence"),
    )
    identity = ("input_id", "condition", "method", "protocol_version", "source_prediction_row_sha256", "temperature_artifact_sha256")
    return row_hash(out.withColumn("evaluation_id", text_id("evaluation", *(F.col(c) for c in identity))))


def prompt_deltas(runtime: DataFrame) -> DataFrame:
    """Prompt tokens of each condition against those of the original of the same input, where both are there: count, sum, least and most."""
    own = runtime.where("condition = 'original'").select("doc_id", F.col("prompt_tokens").alias("before"))
    rows = runtime.where("condition <> 'original'").join(own, "doc_id").select("condition", (F.col("prompt_tokens") - F.col("before")).alias("d"))
    return rows.where("d IS NOT NULL").groupBy("condition").agg(F.count("*").alias("n"), F.sum("d").alias("total"), F.min("d").alias("least"), F.max("d").alias("most"))


def prediction_rows(runtime: DataFrame, scores: DataFrame) -> DataFrame:
    """Runtime rows with the scores (doc_id, condition, method, margin) of every method. A row that isn't ``ok`` was not run: its scores
    are null and its reason stays. A row that is ``ok`` and has no score keeps nulls under the status ``missing``."""
    ok = F.col("status") == "ok"
    p = P.sigmoid(F.col("margin"))
    had = F.col("margin").isNotNull()
    stated = parse(scores).select("doc_id", "condition", "method", "margin", "completion", "valid", F.col("answer").alias("stated_answer"), "stated", F.col("reason").alias("parse_reason"))
    shown = lambda c: F.when(ok & had, c)
    own = runtime.select("doc_id", "condition", "status", "reason", "prompt_sha", "prompt_tokens")
    # Scores that a generator makes of a small table look small to the planner, which would broadcast them through the driver.
    return own.join(stated.hint("merge"), ["doc_id", "condition"], "left").select(
        text_id("prediction", F.col("doc_id"), F.col("condition"), F.col("method")).alias("row_id"), "doc_id", "condition", "method", "prompt_sha", "prompt_tokens",
        shown(F.col("margin")).alias("yes_logit"), shown(F.lit(0.0)).alias("no_logit"), shown(1 - p).alias("p_no"), shown(P.confidence(p)).alias("confidence"),
        shown(F.sha2("completion", 256)).alias("completion_sha"), shown(F.length("completion").cast("long")).alias("completion_chars"), shown(F.col("valid")).alias("parser_valid"),
        shown(F.col("parse_reason")).alias("parser_reason"), shown(F.col("stated_answer")).alias("stated_answer"), shown(F.col("stated")).alias("stated"),
        shown(F.when(F.col("valid"), F.col("stated_answer") == F.when(F.col("margin") >= 0, "Yes").otherwise("No"))).alias("answers_agree"),
        F.when(~ok, "not_run").when(had, "ok").otherwise("missing").alias("run_status"),
        F.when(~ok, F.coalesce("reason", "status")).alias("run_reason"),
        F.when(ok & had, p).alias("p_yes"),
        F.when(ok & had, F.when(F.col("margin") >= 0, "Yes").otherwise("No")).alias("answer"),
        F.when(ok & had, P.entropy(p)).alias("entropy"),
    )


def envelope(rows: DataFrame, adapters: list[tuple[str, str]]) -> DataFrame:
    """Adds the adapter's identity to the rows of each method of ``adapters`` (method, adapter id); others drop out. The list
    is a literal of the plan, so nothing is joined."""
    ids = F.create_map(*(F.lit(x) for pair in adapters for x in pair))
    return rows.where(F.col("method").isin(*(m for m, _ in adapters))).withColumn("adapter_id", ids[F.col("method")])


def calibration_rows(scores: DataFrame, adapters: list[tuple[str, str]]) -> DataFrame:
    """Label-blind rows that a temperature may be fitted on: logits, probabilities of both classes, adapter and row hash."""
    if taken := {"quality", "truth", "label", "answer"} & set(scores.columns):
        raise ContractError(f"scores hold label columns: {sorted(taken)}")
    ids = F.create_map(*(F.lit(x) for pair in adapters for x in pair))
    p = P.sigmoid(F.col("margin"))
    rows = scores.select(
        "doc_id", "method", "condition", F.lit("train").alias("source_split"), F.col("margin").alias("yes_logit"), F.lit(0.0).alias("no_logit"),
        p.alias("p_yes"), (1 - p).alias("p_no"), F.when(F.col("margin") >= 0, "Yes").otherwise("No").alias("prediction"), P.confidence(p).alias("confidence"),
        P.entropy(p).alias("entropy"), ids[F.col("method")].alias("adapter_id"),
    )
    return row_hash(rows.withColumn("row_id", text_id("calibration", F.col("doc_id"), F.col("method"))))


#: What an adapter's envelope says of it, besides the hash and id of the row inside.
ADAPTER_FACTS = ("stage", "training_seed", "checkpoint_path", "checkpoint_ledger_sha256", "weights_sha256", "semantic_config_sha256")


def sealed(rows: DataFrame, adapters: dict[str, dict[str, str | int]], row_id: list[str]) -> DataFrame:
    """Rows of the methods of ``adapters`` in their envelope: ADAPTER_FACTS as adapter_ columns, the hash of the row as it was, an id of row and
    adapter, and the hash of all of it. The facts are literals of the plan; a missing or unknown one is an error."""
    if broken := [m for m, facts in adapters.items() if set(facts) != set(ADAPTER_FACTS)]:
        raise ContractError(f"adapter facts of {broken}")
    fact = lambda name: F.create_map(*(x for m, f in adapters.items() for x in (F.lit(m), F.lit(f[name]))))[F.col("method")]
    inner = row_hash(rows.where(F.col("method").isin(*adapters)), "core_row_sha256")
    named = inner.select("*", *(fact(f).alias(f"adapter_{f}") for f in ADAPTER_FACTS))
    return row_hash(named.withColumn("adapter_row_id", text_id("adapted", *(F.col(c) for c in row_id), F.col("adapter_weights_sha256"))), "adapter_row_sha256")


def identities(rows: DataFrame, group: str, identity: str) -> DataFrame:
    """Groups that carry more than one identity, or none."""
    return rows.groupBy(group).agg(F.count_distinct(identity).alias("n")).where("n <> 1")


def dependent_seeds(rows: DataFrame, seed: str, digest: str) -> DataFrame:
    """Digests that more than one seed has, and seeds with more than one digest: runs that aren't independent, as (kind, value, n)."""
    shared = rows.groupBy(digest).agg(F.count_distinct(seed).alias("n")).select(F.lit("digest").alias("kind"), F.col(digest).cast("string").alias("value"), "n")
    split = rows.groupBy(seed).agg(F.count_distinct(digest).alias("n")).select(F.lit("seed").alias("kind"), F.col(seed).cast("string").alias("value"), "n")
    return shared.unionByName(split).where("n > 1")


def prediction_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows by each of several columns, as (field, value, n); a null value is counted as ``none``."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in by))
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def member_variation(rows: DataFrame) -> DataFrame:
    """Per condition: inputs whose members give more than one probability, and inputs whose members disagree."""
    per = rows.where("method <> 'baseline'").groupBy("condition", "doc_id").agg(
        F.min("p_cal").alias("lo"), F.max("p_cal").alias("hi"), F.min("says_yes").alias("a"), F.max("says_yes").alias("b")
    )
    return per.groupBy("condition").agg(
        F.count("*").alias("n"), F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("n_varied"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("n_disagree")
    )


def comparisons(metrics: DataFrame, pairs: list[tuple[str, str]], keys: tuple[str, ...] = ("scope",)) -> DataFrame:
    """Candidate minus reference of METRICS, for (candidate, reference) method pairs; ``metrics`` has a row for each method and scope."""
    dim = F.explode(F.array(*(F.struct(F.lit(c).alias("candidate"), F.lit(r).alias("reference")) for c, r in pairs))).alias("pair")
    held = metrics.select(*keys, "method", *METRICS)
    wanted = held.select(*keys).distinct().select(*keys, dim).select(*keys, "pair.*")
    side = lambda role: held.select(*keys, F.col("method").alias(role), *(F.col(m).alias(f"{role}_{m}") for m in METRICS))
    both = wanted.join(side("candidate"), [*keys, "candidate"]).join(side("reference"), [*keys, "reference"])
    return both.select(*keys, "candidate", "reference", *((F.col(f"candidate_{m}") - F.col(f"reference_{m}")).alias(f"d_{m}") for m in METRICS))


def optimizer_steps(examples: int, batch: int, accumulate: int, epochs: int) -> int:
    """Updates of a training run whose examples fill its batches exactly."""
    if min(examples, batch, accumulate, epochs) <= 0 or examples % (batch * accumulate):
        raise ValueError("examples must fill whole batches")
    return examples // (batch * accumulate) * epochs
