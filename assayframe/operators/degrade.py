"""Label-blind text degradations."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import text as T
from ..sources.fixtures import CONDITIONS
from ..sources.shared import staged
from .validation import ContractError

FRAGMENT_WORDS = 64
# The contradiction's template and the version that tie hashes carry.
TEMPLATE = "However, it is not true that "
VERSION = "boolq-evidence-degradation-v1"


def best_sentence(inputs: DataFrame) -> DataFrame:
    """Adds segs (raw cuts) and best: place among the cuts, overlap and text of the sentence nearest the question.

    The highest Jaccard overlap wins, the earliest of equals. Null where the question has no token or the passage no
    sentence. All inside the row: no explode, no shuffle.
    """
    asked = inputs.withColumn("q", T.tokens(F.col("question"))).withColumn("segs", T.segments(F.col("passage")))
    # Nested transforms bind what a lambda would compute again at each use: tokens, then the shared count.
    cut = F.transform("segs", lambda s, i: F.struct((-i).alias("earlier"), T.tokens(s).alias("t"), T.strip(s).alias("sentence")))
    met = F.transform(
        F.filter(cut, lambda c: c["sentence"] != ""),
        lambda c: F.struct(c["earlier"].alias("earlier"), F.size(c["t"]).alias("n"), T.shared(F.col("q"), c["t"]).alias("shared"), c["sentence"].alias("sentence")),
    )
    cand = F.transform(
        met,
        lambda c: F.struct(
            T.overlap(c["shared"], F.size("q"), c["n"]).alias("overlap"), c["earlier"].alias("earlier"), c["shared"].alias("shared"), c["sentence"].alias("sentence")
        ),
    )
    rows = asked.withColumn("cand", cand)
    return rows.withColumn("n_sentences", F.size("cand")).withColumn("best", F.when(F.size("q") > 0, F.array_max("cand"))).drop("cand")


def _reason(rows: DataFrame) -> Column:
    return F.when(F.size("q") == 0, "no_question_lexical_tokens").when(F.col("n_sentences") == 0, "no_sentence")


def _around(rows: DataFrame) -> DataFrame:
    """Rows of :func:`best_sentence` with what stands before and after the sentence: columns, so that several uses make them once."""
    at = -F.col("best.earlier")
    left = T.strip_right(F.array_join(F.slice("segs", F.lit(1), at), ""))
    right = T.strip_left(F.array_join(F.slice("segs", at + 2, F.size("segs")), ""))
    return rows.withColumns({"left": left, "right": right})


def _removed(rows: DataFrame) -> dict[str, Column]:
    """Columns of the removal, on rows of :func:`_around`."""
    left, right = F.col("left"), F.col("right")
    made = F.when((left != "") & (right != ""), F.concat(left, F.lit(" "), right)).otherwise(F.concat(left, right))
    return {
        "status": F.when(F.col("best").isNotNull(), "ok").otherwise("not_applicable"),
        "reason": _reason(rows),
        "transformed": F.when(F.col("best").isNotNull(), made),
        "flags": flags((F.col("best.shared") == 0, "zero_lexical_overlap"), (F.col("best").isNotNull() & (left == "") & (right == ""), "whole_passage_removed")),
    }


def evidence_removal(inputs: DataFrame) -> DataFrame:
    """The passage without the sentence nearest the question; what stands around it is joined by one space."""
    rows = _around(best_sentence(inputs))
    return rows.select("doc_id", *(c.alias(n) for n, c in _removed(rows).items()))


def flags(*pairs) -> Column:
    """Sorted names of the conditions that hold."""
    given = F.array(*(F.when(c, F.lit(n)) for c, n in pairs))
    return F.array_sort(F.filter(given, lambda x: x.isNotNull()))


def _half(inputs: DataFrame) -> DataFrame:
    """Inputs with n_words, keep and half, the first ``keep`` words: the passage is split once."""
    cut = inputs.withColumn("w", T.words(F.col("passage"))).withColumn("n_words", F.size("w")).withColumn("keep", F.floor((F.col("n_words") + 1) / 2).cast("int"))
    return cut.withColumn("half", F.array_join(F.slice("w", F.lit(1), F.col("keep")), " ")).drop("w")


def _halved() -> dict[str, Column]:
    """Columns of the truncation, on rows of :func:`_half`."""
    n, keep, text = (F.col(c) for c in ("n_words", "keep", "half"))
    reason = F.when(n == 0, "empty_passage_tokenization").when(text == F.col("passage"), "unchanged_result")
    return {
        "status": F.when(reason.isNull(), "ok").otherwise("not_applicable"),
        "reason": reason,
        "transformed": F.when(reason.isNull(), text),
        "original_tokens": n,
        "target_tokens": keep,
    }


def prefix_truncation(inputs: DataFrame) -> DataFrame:
    """The first half of the white-space tokens, rounded up."""
    return _half(inputs).select("doc_id", *(c.alias(n) for n, c in _halved().items()))


def _denied(rows: DataFrame) -> dict[str, Column]:
    """Columns of the contradiction, on rows of :func:`best_sentence`."""
    fragment = F.array_join(T.leading(F.col("best.sentence"), FRAGMENT_WORDS), " ")
    used = F.size(T.leading(F.col("best.sentence"), FRAGMENT_WORDS))
    ok = F.col("best").isNotNull()
    return {
        "status": F.when(ok, "ok").otherwise("not_applicable"),
        "reason": _reason(rows),
        "transformed": F.when(ok, F.concat(T.strip_right(F.col("passage")), F.lit("\n\n" + TEMPLATE), fragment)),
        "flags": flags((ok & (F.col("best.shared") == 0), "zero_lexical_overlap"), (ok & (used < FRAGMENT_WORDS), "fragment_shorter_than_requested")),
    }


def contradiction(inputs: DataFrame) -> DataFrame:
    """The passage and, after a blank line, a denial of the start of the sentence nearest the question."""
    rows = best_sentence(inputs)
    return rows.select("doc_id", *(c.alias(n) for n, c in _denied(rows).items()))


# ---- the same cuts by a tokenizer's ids; ``make`` opens it in the worker


def truncation_by(inputs: DataFrame, make: Callable[[], S.Tokenizer]) -> DataFrame:
    """The longest prefix of at most half of the tokens that has those very tokens."""
    rows = inputs.select("doc_id", "passage", S.exact_half(F.col("passage"), make).alias("p"))
    reason = F.when(F.col("p.whole").isNull(), "empty_passage_tokenization").when(F.col("p.prefix") == F.col("passage"), "unchanged_result")
    return rows.select(
        "doc_id", F.when(reason.isNull(), "ok").otherwise("not_applicable").alias("status"), reason.alias("reason"), F.when(reason.isNull(), F.col("p.prefix")).alias("transformed"),
        F.col("p.whole").alias("original_tokens"), F.col("p.kept").alias("kept_tokens"),
    )


def contradiction_by(inputs: DataFrame, make: Callable[[], S.Tokenizer]) -> DataFrame:
    """As :func:`contradiction`, with a fragment of FRAGMENT_WORDS tokens at most."""
    rows = best_sentence(inputs).drop("segs")
    cut = rows.withColumn("p", S.exact_prefix(F.col("best.sentence"), F.lit(FRAGMENT_WORDS), make))
    ok = F.col("p.prefix").isNotNull()
    return cut.select(
        "doc_id",
        F.when(ok, "ok").otherwise("not_applicable").alias("status"),
        F.coalesce(_reason(cut), F.when(~ok, "no_fragment")).alias("reason"),
        F.when(ok, F.concat(T.strip_right(F.col("passage")), F.lit("\n\n" + TEMPLATE), F.col("p.prefix"))).alias("transformed"),
        flags((ok & (F.col("best.shared") == 0), "zero_lexical_overlap"), (ok & (F.col("p.kept") < FRAGMENT_WORDS), "fragment_shorter_than_requested")).alias("flags"),
        F.col("p.kept").alias("fragment_tokens"),
    )


def donors_by(docs: DataFrame, make: Callable[[], S.Tokenizer]) -> DataFrame:
    """As :func:`donors_of`, with fragments of FRAGMENT_WORDS tokens at most; ``donor_words`` counts those."""
    cut = docs.select(F.col("doc_id").alias("donor_id"), F.sha2("passage", 256).alias("donor_sha"), S.exact_prefix(F.col("passage"), F.lit(FRAGMENT_WORDS), make).alias("p"))
    made = cut.select("donor_id", "donor_sha", F.col("p.prefix").alias("fragment"), F.col("p.kept").alias("donor_words")).where(F.col("fragment").rlike(T.OTHER))
    return made.withColumn("donor_tokens", T.tokens(F.col("fragment")))


#: Donors that a chunk holds, and targets of a block at most: they bound what a task holds.
CHUNK_DONORS, BLOCK_TARGETS = 8192, 1024
#: Chunks that a task meets one after another, on average; one row of a target and chunk leaves it.
CHUNKS_OF_TASK = 4


def donors_of(docs: DataFrame) -> DataFrame:
    """Every document with a leading fragment as a donor: donor_id, donor_sha, fragment, donor_tokens, donor_words."""
    # A test for any word, instead of one on the fragment, which would be made again for it.
    cut = docs.where(F.col("passage").rlike(T.OTHER)).select(
        F.col("doc_id").alias("donor_id"), F.sha2("passage", 256).alias("donor_sha"), T.leading(F.col("passage"), FRAGMENT_WORDS).alias("words")
    )
    made = cut.select("donor_id", "donor_sha", F.array_join("words", " ").alias("fragment"), F.size("words").alias("donor_words"))
    return made.withColumn("donor_tokens", T.tokens(F.col("fragment")))


#: What :func:`_least_of_chunk` gives.
_LEAST = pa.schema([("doc_id", pa.int64()), ("overlap", pa.float64()), ("tie", pa.string()), ("donor_id", pa.int64()), ("shared", pa.int64()), ("eligible", pa.int64())])


def _begun(donors: list[int], seed: int) -> np.ndarray:
    """For each donor, what copies the hash of a pair's text as far as the target: a donor's part is hashed once, and not for each pair."""
    # Fixed value: the canonical JSON of the pair.
    middle = f'","condition_version":"{VERSION}","seed":{seed},"target_example_id":"'
    return np.array([sha256(f'{{"candidate_example_id":"{d}{middle}'.encode()).copy for d in donors], object)


def _least_tie(begun: list[Callable], target: int) -> tuple[str, int]:
    """The least hash of a target's pairs, from :func:`_begun` of their donors, and its place."""
    after, found = f'{target}"}}'.encode(), []
    for copy in begun:
        pair = copy()
        pair.update(after)
        found.append(pair.digest())
    least = min(found)
    return least.hex(), found.index(least)


def _least_of_chunk(targets: pa.Table, donors: pa.Table, seed: int) -> pa.Table:
    """For each target that has any, the donor of one chunk that overlaps its question least, of equals that of the least hash, and how many are eligible.

    Each question token of the block has a bitmap of the donors that hold it. The complement of the union of a question's bitmaps are
    its donors without any overlap; only where that is empty are shared tokens counted.
    """
    n, asked = len(donors), targets["q"].combine_chunks()
    flat = donors["donor_tokens"].combine_chunks()
    known = pc.unique(pc.list_flatten(asked))
    code = pc.index_in(pc.list_flatten(flat), value_set=known)
    held = pc.is_valid(code).to_numpy(zero_copy_only=False)
    holds = np.zeros((len(known), n), bool)
    holds[code.drop_null().to_numpy(), pc.list_parent_indices(flat).to_numpy()[held]] = True
    bitmaps = np.packbits(holds, axis=1)
    sizes = pc.list_value_length(flat).to_numpy(zero_copy_only=False)
    codes, lengths = pc.index_in(pc.list_flatten(asked), value_set=known).to_numpy(), pc.list_value_length(asked).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    ids = donors["donor_id"].to_numpy()
    begun = _begun(ids.tolist(), seed)
    # The input itself and donors of its passage, as positions of sorted keys.
    own = pa.concat_arrays([a.combine_chunks() for a in (targets["own_sha"], donors["donor_sha"])]).dictionary_encode().indices.to_numpy()
    own, shas = own[: len(targets)], own[len(targets) :]
    by_sha, by_id = np.argsort(shas, kind="stable"), np.argsort(ids, kind="stable")
    keys = targets["doc_id"].to_numpy()
    spans = [np.searchsorted(x[o], k, side) for x, o, k in ((shas, by_sha, own), (ids, by_id, keys)) for side in ("left", "right")]
    rows = []
    for i in range(len(targets)):
        q = codes[starts[i] : starts[i] + lengths[i]]
        free = np.ones(n, bool)
        free[by_sha[spans[0][i] : spans[1][i]]] = False
        free[by_id[spans[2][i] : spans[3][i]]] = False
        eligible = int(free.sum())
        if not eligible:
            continue
        union = np.bitwise_or.reduce(bitmaps[q], axis=0) if len(q) else np.zeros(-(-n // 8), np.uint8)
        at = np.flatnonzero(free & ~np.unpackbits(union, count=n).view(bool))
        least, shared = 0.0, None
        if not len(at):
            shared = holds[q].sum(axis=0)
            overlap = np.where(free, shared / np.maximum(lengths[i] + sizes - shared, 1), np.inf)
            least = float(overlap.min())
            at = np.flatnonzero(overlap == least)
        tie, place = _least_tie(begun[at].tolist(), keys[i])
        common = 0 if shared is None else int(shared[at[place]])
        rows.append({"doc_id": int(keys[i]), "overlap": least, "tie": tie, "donor_id": int(ids[at[place]]), "shared": common, "eligible": eligible})
    return pa.Table.from_pylist(rows, schema=_LEAST)


def _least_of_pairs(batches, seed: int):
    """:func:`_least_of_chunk` of each pair of a block of targets and a chunk of donors."""
    for batch in batches:
        for at in range(batch.num_rows):
            targets, donors = (pa.Table.from_struct_array(batch.column(c).slice(at, 1).flatten()) for c in ("targets", "donors"))
            yield from _least_of_chunk(targets, donors, seed).to_batches()


def _donor_count(donors: DataFrame) -> int:
    """How many donors there are. Repeated donor ids are an error."""
    n = donors.groupBy("donor_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    if (n["most"] or 0) > 1:
        raise ContractError("duplicate donor id")
    return n["all"] or 0


def chosen_donors(inputs: DataFrame, donors: DataFrame, seed: int) -> DataFrame:
    """doc_id, donor_id, overlap, tie, shared, eligible, fragment and donor_words of the donor whose fragment overlaps the question of an
    input least, ties by a seeded hash of the pair and then by id as text.

    Every donor but the input itself and those of the same passage is met. The tie hash depends on the pair, so the work grows
    with the pairs: donors come in chunks of about CHUNK_DONORS and targets in blocks, one row each, and a cross join brings every block to every chunk,
    so that neither is written more than once. Bitmaps of a pair of them find the donors of least overlap, which are hashed where they are found,
    and one row of a target and chunk leaves the task. What is chosen is staged, so that nothing chooses
    again. Repeated donor ids are an error. An input without a donor has no row. ``donors`` is as :func:`donors_of` gives it.
    """
    chunks = max(1, -(-_donor_count(donors) // CHUNK_DONORS))
    asked = inputs.select("doc_id", T.tokens(F.col("question")).alias("q"), F.sha2("passage", 256).alias("own_sha"))
    n_asked = inputs.count()
    tasks = int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = max(1, -(-n_asked // BLOCK_TARGETS), min(2 * tasks, n_asked // 256))
    dealt = lambda df, key, n: df.select(F.pmod(F.xxhash64(*key), F.lit(n)).cast("int").alias("of"), F.struct(*df.columns).alias("row"))
    left = dealt(asked, ("doc_id", F.lit(1)), blocks).repartition(blocks, "of").groupBy("of").agg(F.collect_list("row").alias("targets"))
    right = dealt(donors.select("donor_id", "donor_sha", "donor_tokens"), ("donor_id",), chunks).groupBy("of").agg(F.collect_list("row").alias("donors"))
    pairs = left.select("targets").crossJoin(right.select("donors").coalesce(-(-chunks // CHUNKS_OF_TASK)))
    per_chunk = pairs.mapInArrow(lambda batches: _least_of_pairs(batches, seed), "doc_id long, overlap double, tie string, donor_id long, shared long, eligible long")
    name = F.col("donor_id").cast("string").alias("name")
    best = per_chunk.groupBy("doc_id").agg(F.min(F.struct("overlap", "tie", name, "donor_id", "shared")).alias("d"), F.sum("eligible").alias("eligible"))
    picked = staged(best.select("doc_id", "d.donor_id", "d.overlap", "d.tie", "d.shared", "eligible"), "chosen")
    return picked.join(donors.select("donor_id", "fragment", "donor_words"), "donor_id")


def eligible_donors(inputs: DataFrame, donors: DataFrame) -> DataFrame:
    """doc_id and eligible, the donors that :func:`chosen_donors` would choose from, counted without meeting them: all but those of the input's passage and the
    input itself."""
    alike = donors.groupBy("donor_sha").agg(F.count("*").alias("alike"))
    self = donors.select(F.col("donor_id").alias("doc_id"), F.col("donor_sha").alias("self_sha"))
    n = _donor_count(donors)
    rows = inputs.select("doc_id", F.sha2("passage", 256).alias("donor_sha")).join(alike, "donor_sha", "left").join(self, "doc_id", "left")
    own = (F.col("self_sha").isNotNull() & ~F.col("self_sha").eqNullSafe(F.col("donor_sha"))).cast("long")
    return rows.select("doc_id", (F.lit(n) - F.coalesce("alike", F.lit(0)) - own).cast("long").alias("eligible"))


def _distracted(ok: Column | None = None) -> dict[str, Column]:
    """Columns of the distractor, on inputs with their :func:`chosen_donors`; state and reason need no more than ``ok``, whether there is one."""
    ok = F.col("donor_id").isNotNull() if ok is None else ok
    return {
        "status": F.when(ok, "ok").otherwise("not_applicable"),
        "reason": F.when(~ok, "no_eligible_donor"),
        "transformed": F.when(ok, F.concat(T.strip_right(F.col("passage")), F.lit("\n\n"), F.col("fragment"))),
        "flags": flags((ok & (F.col("shared") == 0), "zero_lexical_overlap"), (ok & (F.col("donor_words") < FRAGMENT_WORDS), "fragment_shorter_than_requested")),
    }


def distractor(inputs: DataFrame, donors: DataFrame, seed: int) -> DataFrame:
    """The passage and, after a blank line, the fragment of :func:`chosen_donors`. An input without a donor is ``not_applicable``."""
    rows = inputs.select("doc_id", "passage").join(chosen_donors(inputs, donors, seed), "doc_id", "left")
    return rows.select(
        "doc_id", *(c.alias(n) for n, c in _distracted().items()), "donor_id", "overlap", "tie", F.coalesce("eligible", F.lit(0).cast("long")).alias("eligible"),
        F.sha2("fragment", 256).alias("fragment_sha"),
    )


def fragment_hashes(chosen: DataFrame, donors: DataFrame) -> DataFrame:
    """Rows of ``chosen`` (doc_id, donor_id, fragment_sha) whose donor is unknown or has another fragment."""
    told = donors.select("donor_id", F.sha2("fragment", 256).alias("told"))
    return chosen.where("donor_id IS NOT NULL").join(told, "donor_id", "left").where("NOT (fragment_sha <=> told)").select("doc_id", "donor_id")


def _parts(rows: DataFrame) -> dict[str, dict[str, Column]]:
    """Columns of every condition but the distractor, on rows of :func:`_around` and :func:`_half`."""
    plain = lambda text: {"status": F.lit("ok"), "transformed": text}
    return {
        "original": plain(F.col("passage")),
        "lexical_evidence_removal": _removed(rows),
        "prefix_truncation_50": _halved(),
        "lexical_contradiction": _denied(rows),
        "no_passage": plain(F.lit("")),
    }


def _structs(parts: dict[str, dict[str, Column]], *fields: str) -> list[Column]:
    """A column for each condition of ``parts``, with ``fields``. The generator reads columns: of what it works out itself it shares nothing between uses."""
    absent = {"reason": F.lit(None).cast("string"), "flags": F.array().cast("array<string>")}
    return [F.struct(*((absent | part)[f].alias(f) for f in fields)).alias(name) for name, part in parts.items()]


def _six(*fields: str) -> Column:
    """A generator of six rows from the columns of :func:`_structs`: condition, condition_index and ``fields``."""
    return F.inline(F.array(*(
        F.struct(F.lit(name).alias("condition"), F.lit(at).alias("condition_index"), *(F.col(f"{name}.{f}").alias(f) for f in fields)) for at, name in enumerate(CONDITIONS)
    )))


def all_conditions(inputs: DataFrame, donors: DataFrame, seed: int, *keep: str) -> DataFrame:
    """Six rows for each input, one for every condition: doc_id, condition, condition_index, status, reason, transformed, flags, and the columns ``keep`` of the
    input, so that nobody joins its text again.

    An input is read once with its donor, its sentences are cut once, and a generator inside the row makes the six.
    """
    fields = ("status", "reason", "transformed", "flags")
    rows = _half(_around(best_sentence(inputs.join(chosen_donors(inputs, donors, seed), "doc_id", "left"))))
    return rows.select("doc_id", *keep, *_structs(_parts(rows) | {"irrelevant_distractor": _distracted()}, *fields)).select("doc_id", *keep, _six(*fields))


def all_states(inputs: DataFrame, donors: DataFrame) -> DataFrame:
    """The rows of :func:`all_conditions` without text and flags. Whether there is a donor is counted, so no pair of input and donor is met, and states
    are worked out before the join, so no passage is shuffled."""
    fields = ("status", "reason")
    rows = _half(_around(best_sentence(inputs)))
    stated = rows.select("doc_id", *_structs(_parts(rows), *fields)).join(eligible_donors(inputs, donors), "doc_id")
    return stated.select("*", *_structs({"irrelevant_distractor": _distracted(F.col("eligible") > 0)}, *fields)).select("doc_id", _six(*fields))


def donor_reuse(chosen: DataFrame, donors: DataFrame) -> DataFrame:
    """How often each donor was used; donors never used have 0."""
    used = chosen.where("donor_id IS NOT NULL").groupBy("donor_id").agg(F.count("*").alias("uses"))
    return donors.select("donor_id").join(used, "donor_id", "left").select("donor_id", F.coalesce("uses", F.lit(0).cast("long")).alias("uses"))
