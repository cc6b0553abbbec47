"""DuckDB statements that give the rows of the catalogue's queries."""

from __future__ import annotations

from ..functions.text import TOKEN
from ..operators.degrade import FRAGMENT_WORDS, TEMPLATE, VERSION
from ..operators.records import MOST_TOKENS, PREFIX, PROTOCOL, RENDERER
from ..sources.fixtures import CONDITIONS, METHODS

_COND = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CONDITIONS))
_METH = ", ".join(f"({i}, '{m}', {t}e0)" for i, (m, t) in enumerate(METHODS))
_PRED = f"""
cond(condition_index, condition) AS (VALUES {_COND}),
meth(method_index, method, temperature) AS (VALUES {_METH}),
pred0 AS (SELECT doc_id, quality, condition_index, condition, method_index, method, temperature,
  CAST((doc_id * 7919 + condition_index * 104729 + method_index * 15485863) % 4001 - 2000 AS DOUBLE) / 500e0
   + CAST((2 * quality - 1) * (6 - condition_index) AS DOUBLE) / 4e0 AS margin,
  (doc_id * 104723 + condition_index * 7907 + method_index * 1299709) % 997 AS v FROM labels, cond, meth),
pred AS (SELECT *, CASE WHEN v < 300 THEN ' Yes' || chr(10) || 'Confidence: ' || (v % 101)
  WHEN v < 600 THEN ' No' || chr(10) || 'Confidence: ' || (v % 101) || chr(10) WHEN v < 700 THEN ''
  WHEN v < 800 THEN 'Yes' || chr(10) || 'Confidence: ' || (v % 101) WHEN v < 900 THEN ' No' || chr(10) || (v % 101)
  ELSE ' Yes' || chr(10) || 'Confidence: 0' || (v % 101) END AS completion FROM pred0),
prob AS (SELECT *, 1 / (1 + exp(-margin)) AS p_raw, 1 / (1 + exp(-margin / temperature)) AS p_cal, quality = 1 AS truth,
  margin >= 0 AS says_yes FROM pred),
ev AS (SELECT *, says_yes = truth AS correct, greatest(p_raw, 1 - p_raw) AS conf_raw, greatest(p_cal, 1 - p_cal) AS conf_cal,
  -ln(greatest(CASE WHEN truth THEN p_raw ELSE 1 - p_raw END, 1e-15)) AS nll_raw,
  -ln(greatest(CASE WHEN truth THEN p_cal ELSE 1 - p_cal END, 1e-15)) AS nll_cal,
  (p_raw - truth::INT) * (p_raw - truth::INT) AS brier_raw, (p_cal - truth::INT) * (p_cal - truth::INT) AS brier_cal,
  -p_cal * ln(p_cal) - (1 - p_cal) * ln(1 - p_cal) AS entropy_cal, round(1 - greatest(p_cal, 1 - p_cal), 12) AS error_score FROM prob),
scoped AS (SELECT *, condition AS scope FROM ev UNION ALL SELECT *, 'overall' FROM ev),
ens0 AS (SELECT doc_id, condition, truth, avg(p_cal) AS p_mean, var_pop(p_cal) AS variance, avg(entropy_cal) AS expected_entropy,
  CAST(sum(says_yes::INT) AS BIGINT) AS yes_votes, count(*) AS members FROM ev WHERE method <> 'baseline' GROUP BY ALL),
ens AS (SELECT *, -p_mean * ln(p_mean) - (1 - p_mean) * ln(1 - p_mean) AS predictive_entropy,
  greatest(0, -p_mean * ln(p_mean) - (1 - p_mean) * ln(1 - p_mean) - expected_entropy) AS information_gap,
  1 - greatest(yes_votes, members - yes_votes) / CAST(members AS DOUBLE) AS disagreement,
  (round(p_mean, 12) >= 0.5) = truth AS correct, greatest(p_mean, 1 - p_mean) AS confidence FROM ens0),
sig AS (SELECT doc_id, condition, correct, signal, round(score, 12) AS score FROM (
  SELECT doc_id, condition, correct, 'confidence_gap' AS signal, 1 - confidence AS score FROM ens
  UNION ALL SELECT doc_id, condition, correct, 'predictive_entropy', predictive_entropy FROM ens
  UNION ALL SELECT doc_id, condition, correct, 'information_gap', information_gap FROM ens
  UNION ALL SELECT doc_id, condition, correct, 'variance', variance FROM ens
  UNION ALL SELECT doc_id, condition, correct, 'disagreement', disagreement FROM ens))"""


def _ranking(rows: str, keys: str, positive: str, score: str = "score") -> str:
    return f"""by_score AS (SELECT {keys}, {score} AS s, CAST(sum(({positive})::INT) AS DOUBLE) AS pos, CAST(sum((NOT ({positive}))::INT) AS DOUBLE) AS neg
  FROM {rows} GROUP BY ALL),
run AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(pos) OVER (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(neg) OVER (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp FROM by_score),
rank_of AS (SELECT {keys}, round(sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0), 9) AS auroc,
  round(sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / nullif(sum(pos), 0), 9) AS average_precision FROM run GROUP BY ALL)"""


def _ece(bins: int) -> str:
    return f"""bin AS (SELECT method, scope, least(greatest(CAST(ceil(round(conf_cal, 12) * {bins}) AS INT) - 1, 0), {bins - 1}) AS b, count(*) AS n,
  avg(conf_cal) AS mc, avg(correct::INT) AS acc FROM scoped GROUP BY ALL),
ece AS (SELECT method, scope, round(sum(n * abs(acc - mc)) / sum(n), 9) AS ece FROM bin GROUP BY ALL)"""


_STRATA = "s AS (SELECT doc_id, CAST(quality AS INT) AS quality FROM labels)"
_QUOTA = """quota_{name} AS (SELECT quality, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, quality) <= {size} - sum(whole) OVER () THEN 1 ELSE 0 END AS q
  FROM (SELECT quality, (count(*) * {size}) // (SELECT count(*) FROM s) AS whole, (count(*) * {size}) % (SELECT count(*) FROM s) AS rest FROM s GROUP BY 1))"""
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY rank_sha, doc_id) AS place FROM
  (SELECT *, sha256('sha256-stratified-v1|20260803|split|' || doc_id) AS rank_sha FROM s))"""
_SPLIT = f"""{_STRATA}, {', '.join(_QUOTA.format(name=n, size=k) for n, k in (('train', 80), ('calibration', 20), ('test', 40)))}, {_RANKED},
chosen AS (SELECT doc_id, quality, rank_sha, CAST(place AS INT) AS place, CASE WHEN place <= a.q THEN 'train' WHEN place <= a.q + b.q THEN 'calibration'
  WHEN place <= a.q + b.q + c.q THEN 'test' END AS split FROM ranked JOIN quota_train a USING (quality) JOIN quota_calibration b USING (quality)
  JOIN quota_test c USING (quality))"""


def _tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '{TOKEN.replace(chr(39), chr(39) * 2)}'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _segs(x: str) -> str:
    return f"string_split(regexp_replace({x}, '(?:[.!?][\"'')\\]]*)(?:\\s+|$)|\\n+', '\\0' || chr(1), 'g'), chr(1))"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


_INPUTS = """inp AS (SELECT d.doc_id, l.quality, b.text AS question, d.text AS passage FROM documents d JOIN labels l USING (doc_id)
  JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""
_BEST = f"""{_INPUTS}, asked AS (SELECT *, {_tokens('question')} AS q, {_segs('passage')} AS segs FROM inp),
cut AS (SELECT doc_id, generate_subscripts(segs, 1) AS i, unnest(segs) AS seg, q FROM asked),
scored AS (SELECT doc_id, i, {_strip('seg')} AS sentence, len(list_intersect(q, {_tokens('seg')})) AS shared,
  len(list_distinct(list_concat(q, {_tokens('seg')}))) AS either FROM cut WHERE {_strip('seg')} <> ''),
counted AS (SELECT doc_id, count(*) AS n_sentences FROM scored GROUP BY 1),
top AS (SELECT * FROM (SELECT *, CASE WHEN either > 0 THEN shared / CAST(either AS DOUBLE) ELSE 0 END AS overlap,
  row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN either > 0 THEN shared / CAST(either AS DOUBLE) ELSE 0 END DESC, i) AS place FROM scored) WHERE place = 1),
best AS (SELECT a.doc_id, a.passage, a.segs, len(a.q) AS nq, coalesce(c.n_sentences, 0) AS n_sentences, t.i, t.sentence, t.shared, t.overlap
  FROM asked a LEFT JOIN counted c USING (doc_id) LEFT JOIN top t ON t.doc_id = a.doc_id AND len(a.q) > 0)"""
_REASON = "CASE WHEN nq = 0 THEN 'no_question_lexical_tokens' WHEN n_sentences = 0 THEN 'no_sentence' END"
_REMOVED = f"""{_BEST}, sides AS (SELECT *, regexp_replace(array_to_string(segs[1:i-1], ''), '\\s+$', '') AS l, regexp_replace(array_to_string(segs[i+1:], ''), '^\\s+', '') AS r FROM best),
removed AS (SELECT *, CASE WHEN i IS NOT NULL THEN CASE WHEN l <> '' AND r <> '' THEN l || ' ' || r ELSE l || r END END AS transformed FROM sides)"""
_PREFIX = f"""pre AS (SELECT doc_id, passage, {_words('passage')} AS w FROM inp),
half AS (SELECT doc_id, passage, len(w) AS n, array_to_string(w[1:(len(w) + 1) // 2], ' ') AS cut FROM pre),
halved AS (SELECT *, CASE WHEN n = 0 THEN 'empty_passage_tokenization' WHEN cut = passage THEN 'unchanged_result' END AS reason FROM half)"""
_DENIED = f"""denied AS (SELECT *, CASE WHEN i IS NOT NULL THEN regexp_replace(passage, '\\s+$', '') || chr(10) || chr(10) || '{TEMPLATE}' ||
  array_to_string(({_words('sentence')})[1:{FRAGMENT_WORDS}], ' ') END AS transformed, len({_words('sentence')}) AS used FROM best)"""
_DONORS = f"""{_INPUTS}, pool AS (SELECT doc_id AS donor_id, sha256(passage) AS donor_sha, array_to_string(({_words('passage')})[1:{FRAGMENT_WORDS}], ' ') AS fragment,
  len(({_words('passage')})[1:{FRAGMENT_WORDS}]) AS used FROM inp),
don AS (SELECT *, {_tokens('fragment')} AS t FROM pool WHERE fragment <> ''),
pairs AS (SELECT doc_id, donor_id, fragment, used, len(list_intersect(q, t)) AS shared, CASE WHEN len(list_concat(q, t)) > 0 THEN len(list_intersect(q, t)) / CAST(len(list_distinct(list_concat(q, t))) AS DOUBLE) ELSE 0 END AS overlap,
  sha256('{{"candidate_example_id":"' || donor_id || '","condition_version":"{VERSION}","seed":20260803,"target_example_id":"' || doc_id || '"}}') AS tie
  FROM (SELECT doc_id, {_tokens('question')} AS q, sha256(passage) AS own FROM inp) i JOIN don ON i.doc_id <> donor_id AND own <> donor_sha),
picked AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS eligible, row_number() OVER (PARTITION BY doc_id ORDER BY overlap, tie, CAST(donor_id AS VARCHAR)) AS k FROM pairs) WHERE k = 1),
distracted AS (SELECT i.doc_id, i.passage, CASE WHEN k IS NULL THEN 'not_applicable' ELSE 'ok' END AS status, CASE WHEN k IS NULL THEN 'no_eligible_donor' END AS reason, donor_id, overlap, tie,
  coalesce(eligible, 0) AS eligible, sha256(fragment) AS fragment_sha, regexp_replace(i.passage, '\\s+$', '') || chr(10) || chr(10) || fragment AS transformed, shared, used FROM inp i LEFT JOIN picked USING (doc_id))"""
_DELTA = "round(avg(a.{0} - o.{0}), 9) AS d_{1}"
_FEAT = "feat AS (SELECT vec_id, CAST(label >= 5 AS INT) AS target, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), flat AS (SELECT vec_id, target, generate_subscripts(x, 1) - 1 AS dim, unnest(x) AS v FROM feat)"


def statements() -> dict[str, str]:
    from .catalog import BOOT_SEED, DRAW_SEED, DRAWS, GRID, PRIMARY, REPLICATES

    with_pred = lambda more, select: f"WITH {_PRED}{', ' + more if more else ''} {select}"
    r9 = lambda *names: ", ".join(f"round({n}, 9) AS {n}" for n in names)
    rank_scoped = _ranking("scoped", "method, scope", "NOT correct", "error_score")
    curve = """curve AS (SELECT method, doc_id, condition, conf_cal, correct, row_number() OVER w AS k, CAST(sum((NOT correct)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e,
      count(*) OVER (PARTITION BY method) AS n FROM ev WINDOW w AS (PARTITION BY method ORDER BY round(conf_cal, 12) DESC, doc_id, condition)),
      rc AS (SELECT method, doc_id, condition, k AS retained, round(k / CAST(n AS DOUBLE), 9) AS coverage, e AS errors, round(e / CAST(k AS DOUBLE), 9) AS risk,
      round(1 - e / CAST(k AS DOUBLE), 9) AS selective_accuracy, round(conf_cal, 9) AS threshold FROM curve)"""
    form = r"^ (Yes|No)\nConfidence: (100|[1-9][0-9]?|0)\n?$"
    parsed = f"""fit AS (SELECT *, regexp_full_match(completion, '{form}') AS valid FROM ev),
      parsed AS (SELECT *, CASE WHEN valid THEN regexp_extract(completion, '{form}', 1) END AS answer,
      CASE WHEN valid THEN CAST(regexp_extract(completion, '{form}', 2) AS INT) END AS stated,
      CASE WHEN valid THEN NULL WHEN completion = '' THEN 'empty_completion'
      WHEN NOT (starts_with(completion, ' Yes' || chr(10)) OR starts_with(completion, ' No' || chr(10))) THEN 'answer_line_invalid'
      WHEN NOT contains(completion, chr(10) || 'Confidence: ') THEN 'confidence_line_missing' ELSE 'format_mismatch' END AS reason FROM fit)"""
    boot = """wts AS (SELECT doc_id, replicate, CAST(('0x' || substr(sha256(replicate || '|' || doc_id), 1, 8)) AS BIGINT) % 3 AS w FROM labels, range(20) r(replicate)),
      sums AS (SELECT method, doc_id, count(*) AS n, sum(correct::INT) AS accuracy, sum(nll_cal) AS nll, sum(brier_cal) AS brier FROM ev GROUP BY ALL),
      rep AS (SELECT method, replicate, sum(accuracy * w) / sum(n * w) AS accuracy, sum(nll * w) / sum(n * w) AS nll, sum(brier * w) / sum(n * w) AS brier FROM sums JOIN wts USING (doc_id) GROUP BY ALL),
      diff AS (SELECT a.method, CAST(a.replicate AS INT) AS replicate, a.accuracy - b.accuracy AS d_accuracy, a.nll - b.nll AS d_nll, a.brier - b.brier AS d_brier
      FROM rep a JOIN rep b ON a.replicate = b.replicate AND b.method = 'baseline' WHERE a.method <> 'baseline')"""
    draws = f"""cl AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR))) - 1 AS pl, count(*) OVER () AS k FROM (SELECT DISTINCT doc_id FROM labels)),
      dr AS (SELECT r.replicate, CAST(('0x' || substr(sha256('{BOOT_SEED}|' || r.replicate || '|' || d.draw), 1, 12)) AS BIGINT) % (SELECT count(*) FROM cl) AS pl
        FROM range({REPLICATES}) r(replicate), range((SELECT count(*) FROM cl)) d(draw)),
      wt AS (SELECT CAST(replicate AS INT) AS replicate, doc_id, count(*) AS weight FROM dr JOIN cl USING (pl) GROUP BY ALL)"""
    measured = f"""{draws}, wr AS (SELECT s.*, replicate, weight, least(greatest(CAST(ceil(round(conf_cal, 12) * 10) AS INT) - 1, 0), 9) AS bin FROM scoped s JOIN wt USING (doc_id)),
      wb AS (SELECT method, scope, replicate, bin, sum(weight) AS n, sum(weight * nll_cal) AS nll, sum(weight * brier_cal) AS brier, sum(weight * correct::INT) AS good, sum(weight * conf_cal) AS conf FROM wr GROUP BY ALL),
      wm AS (SELECT method, scope, replicate, sum(good) / sum(n) AS accuracy, sum(nll) / sum(n) AS nll, sum(brier) / sum(n) AS brier, sum(abs(good - conf)) / sum(n) AS ece FROM wb GROUP BY ALL),
      ws AS (SELECT method, scope, replicate, error_score, sum(weight * (1 - correct::INT)) AS pos, sum(weight * correct::INT) AS neg FROM wr GROUP BY ALL),
      wl AS (SELECT *, sum(neg) OVER (PARTITION BY method, scope, replicate ORDER BY error_score ROWS UNBOUNDED PRECEDING) - neg AS below FROM ws),
      wa AS (SELECT method, scope, replicate, sum(pos * (below + 0.5e0 * neg)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM wl GROUP BY ALL),
      ms AS (SELECT * FROM wm JOIN wa USING (method, scope, replicate))"""
    five = ("accuracy", "nll", "brier", "ece", "auroc")
    seeds = f"""{measured}, sc AS (SELECT scope, replicate, {', '.join(f'avg({m}) AS {m}' for m in five)} FROM ms WHERE method <> 'baseline' GROUP BY ALL),
      sd AS (SELECT sc.scope, sc.replicate, {', '.join(f'sc.{m} - b.{m} AS d_{m}' for m in five)} FROM sc JOIN ms b ON b.scope = sc.scope AND b.replicate = sc.replicate AND b.method = 'baseline')"""
    entropy = lambda p: f"(CASE WHEN {p} > 0 THEN -{p} * ln({p}) ELSE 0 END + CASE WHEN {p} < 1 THEN -(1 - {p}) * ln(1 - {p}) ELSE 0 END)"
    family = lambda name, p: f"""{name}0 AS (SELECT doc_id, condition, truth, avg({p}) AS p, var_pop({p}) AS variance, avg({entropy(p)}) AS expected_entropy,
      1 - greatest(sum(says_yes::INT), 3 - sum(says_yes::INT)) / 3e0 AS disagreement FROM ev WHERE method <> 'baseline' GROUP BY ALL),
      {name} AS (SELECT *, {entropy('p')} AS predictive_entropy, greatest(0, {entropy('p')} - expected_entropy) AS information_gap, (round(p, 12) >= 0.5) = truth AS correct, greatest(p, 1 - p) AS confidence FROM {name}0)"""  # noqa: E731
    clipped = "-ln(CASE WHEN truth THEN least(greatest({0}, 1e-12), 1 - 1e-12) ELSE 1 - least(greatest({0}, 1e-12), 1 - 1e-12) END)"

    def grouped_metrics(source: str, keys: str, means: tuple[str, ...], more: str = "") -> str:
        """Metrics of ``source`` (keys, correct, confidence, error_score) by keys."""
        return f"""gb AS (SELECT {keys}, least(greatest(CAST(ceil(round(confidence, 12) * 10) AS INT) - 1, 0), 9) AS bin, count(*) AS k, avg(confidence) AS mc, avg(correct::INT) AS acc FROM {source} GROUP BY ALL),
          ge AS (SELECT {keys}, round(sum(k * abs(acc - mc)) / sum(k), 9) AS ece FROM gb GROUP BY ALL), {_ranking(source, keys, 'NOT correct', 'error_score')},
          gm AS (SELECT {keys}, count(*) AS n{more}, {', '.join(f'round(avg({m}), 9) AS {m}' for m in means)} FROM {source} GROUP BY ALL)"""

    both_families = f"""{family('fr', 'p_raw')}, {family('fc', 'p_cal')}, fam AS (SELECT 'raw' AS family, * FROM fr UNION ALL SELECT 'calibrated', * FROM fc),
      fs AS (SELECT *, {clipped.format('p')} AS nll, (p - truth::INT) * (p - truth::INT) AS brier, round(1 - confidence, 12) AS error_score, unnest([condition, 'overall']) AS scope FROM fam)"""
    posterior_part = f"""{_FEAT}, z AS (SELECT vec_id, target, d, sum(v * (((dim * 5 + d * 3) % 11 - 5) / 8e0)) + ((64 * 5 + d * 3) % 11 - 5) / 8e0 AS z FROM flat, range(8) r(d) GROUP BY vec_id, target, d),
      pd AS (SELECT vec_id, target, 1 / (1 + exp(-z)) AS p FROM z), pa AS (SELECT vec_id, target, avg(p) AS p_mean, var_pop(p) AS variance, avg(-(p * ln(p) + (1 - p) * ln(1 - p))) AS expected_entropy FROM pd GROUP BY ALL),
      pe AS (SELECT *, -(p_mean * ln(p_mean) + (1 - p_mean) * ln(1 - p_mean)) AS entropy FROM pa), post AS (SELECT *, greatest(0, entropy - expected_entropy) AS information_gap FROM pe)"""
    sources = f"""{family('fr', 'p_raw')}, {family('fc', 'p_cal')}, {posterior_part}, un AS (
      SELECT method || '_raw' AS variant, CAST(doc_id AS VARCHAR) AS input_id, condition, truth, p_raw AS p_yes, {entropy('p_raw')} AS predictive_entropy, CAST(NULL AS DOUBLE) AS expected_entropy, CAST(NULL AS DOUBLE) AS information_gap, CAST(NULL AS DOUBLE) AS variance FROM ev
      UNION ALL SELECT method || '_calibrated', CAST(doc_id AS VARCHAR), condition, truth, p_cal, {entropy('p_cal')}, NULL, NULL, NULL FROM ev
      UNION ALL SELECT 'ensemble_raw', CAST(doc_id AS VARCHAR), condition, truth, p, predictive_entropy, expected_entropy, information_gap, variance FROM fr
      UNION ALL SELECT 'ensemble_calibrated', CAST(doc_id AS VARCHAR), condition, truth, p, predictive_entropy, expected_entropy, information_gap, variance FROM fc
      UNION ALL SELECT 'linear_head', 'vec-' || vec_id, 'original', target = 1, p_mean, entropy, expected_entropy, information_gap, variance FROM post),
      us AS (SELECT *, p_yes >= 0.5 AS says_yes, (p_yes >= 0.5) = truth AS correct, greatest(p_yes, 1 - p_yes) AS confidence FROM un)"""
    unified_scopes = f"{sources}, ux AS (SELECT *, {clipped.format('p_yes')} AS nll, (p_yes - truth::INT) * (p_yes - truth::INT) AS brier, round(1 - confidence, 12) AS error_score, correct::INT AS accuracy, unnest([condition, 'overall']) AS scope FROM us)"
    primary = ", ".join(f"'{v}'" for v in PRIMARY)
    all_signals = f"""{sources}, gs AS (SELECT variant, 'predictive_entropy' AS signal, correct, round(predictive_entropy, 12) AS score FROM us WHERE variant IN ({primary})
      UNION ALL SELECT variant, 'variance', correct, round(variance, 12) FROM us WHERE variant IN ('ensemble_calibrated', 'linear_head')
      UNION ALL SELECT variant, 'information_gap', correct, round(information_gap, 12) FROM us WHERE variant IN ('ensemble_calibrated', 'linear_head'))"""

    def broken(table: str, rules: dict[str, str], more: str = "") -> str:
        counts = ", ".join(f"CAST(coalesce(sum((NOT coalesce({c}, false))::INT), 0) AS BIGINT)" for c in rules.values())
        names = ", ".join(f"'{r}'" for r in rules)
        return f"SELECT unnest([{names}]) AS rule, unnest([{counts}]) AS n{more} FROM {table}"

    in_place = f"(list_position([{', '.join(repr(c) for c in CONDITIONS)}], condition) - 1) = condition_index"
    known = f"condition IN ({', '.join(repr(c) for c in CONDITIONS)})"
    unit = lambda p: f"(isfinite({p}) AND {p} BETWEEN 0 AND 1)"

    grid = ", ".join(f"({t}e0)" for t in GRID)
    nearest = lambda p, n: f"list_sort(list(v))[{n} + 1] AS p{p}"
    ppm = "(length(transformed) * 1000000 + greatest(length(passage), 1) // 2) // greatest(length(passage), 1)"
    made = f"'Passage: ' || {{0}} || chr(10) || 'Question: ' || question || chr(10) || '{PREFIX}'"
    canon = """c0 AS (SELECT doc_id, CAST(quality AS INT) AS quality, doc_id / 8e0 AS part, CASE WHEN doc_id % 3 <> 0 THEN doc_id + 9007199254740993 END AS wide FROM labels),
      c AS (SELECT *, '{"doc_id":' || doc_id || ',"part":' || CAST(part AS VARCHAR) || ',"quality":' || quality || ',"wide":' || coalesce(CAST(wide AS VARCHAR), 'null') || '}' AS j FROM c0)"""
    short, zero = "'fragment_shorter_than_requested'", "'zero_lexical_overlap'"
    degraded = f"""{_REMOVED}, {_PREFIX}, {_DENIED}, {_DONORS[len(_INPUTS) + 2 :]}, r AS (
      SELECT doc_id, passage, 'original' AS condition, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason, passage AS transformed, CAST([] AS VARCHAR[]) AS flags FROM inp
      UNION ALL SELECT doc_id, passage, 'lexical_evidence_removal', CASE WHEN i IS NULL THEN 'not_applicable' ELSE 'ok' END, {_REASON}, transformed,
        [CASE WHEN transformed = '' THEN 'whole_passage_removed' END, CASE WHEN shared = 0 THEN {zero} END] FROM removed
      UNION ALL SELECT doc_id, passage, 'prefix_truncation_50', CASE WHEN reason IS NULL THEN 'ok' ELSE 'not_applicable' END, reason, CASE WHEN reason IS NULL THEN cut END, [] FROM halved
      UNION ALL SELECT doc_id, passage, 'irrelevant_distractor', status, reason, transformed, [CASE WHEN used < {FRAGMENT_WORDS} THEN {short} END, CASE WHEN shared = 0 THEN {zero} END] FROM distracted
      UNION ALL SELECT doc_id, passage, 'lexical_contradiction', CASE WHEN i IS NULL THEN 'not_applicable' ELSE 'ok' END, {_REASON}, transformed,
        [CASE WHEN i IS NOT NULL AND used < {FRAGMENT_WORDS} THEN {short} END, CASE WHEN shared = 0 THEN {zero} END] FROM denied
      UNION ALL SELECT doc_id, passage, 'no_passage', 'ok', NULL, '', [] FROM inp)"""
    runtime = f"""{degraded},
      made AS (SELECT r.*, sha256(r.passage) AS passage_sha, sha256(question) AS question_sha, {made.format('transformed')} AS p FROM r JOIN inp USING (doc_id)),
      runtime AS (SELECT 'runtime-' || sha256(doc_id || '|' || condition) AS row_id, doc_id, condition, passage_sha, question_sha, sha256(transformed) AS text_sha, length(transformed) AS text_chars,
      len({_words('transformed')}) AS text_tokens, {ppm} AS text_ppm, CASE WHEN status = 'ok' THEN length(p) END AS prompt_chars, status = 'ok' AND len({_words('p')}) <= {MOST_TOKENS} AS runs,
      CASE WHEN status = 'ok' AND len({_words('p')}) > {MOST_TOKENS} THEN 'too_long' ELSE status END AS status,
      CASE WHEN status = 'ok' AND len({_words('p')}) > {MOST_TOKENS} THEN 'prompt_over_limit' ELSE reason END AS reason,
      CASE WHEN status = 'ok' THEN len({_words('p')}) END AS prompt_tokens, CASE WHEN status = 'ok' THEN sha256(p) END AS prompt_sha,
      CASE WHEN status = 'ok' THEN sha256(transformed) <> passage_sha END AS changed FROM made)"""
    posterior = f"""WITH {_FEAT}, z AS (SELECT vec_id, target, d, sum(v * (((dim * 5 + d * 3) % 11 - 5) / 8e0)) + ((64 * 5 + d * 3) % 11 - 5) / 8e0 AS z FROM flat, range(8) r(d) GROUP BY vec_id, target, d),
      pd AS (SELECT vec_id, target, 1 / (1 + exp(-z)) AS p FROM z), pa AS (SELECT vec_id, target, avg(p) AS p_mean, var_pop(p) AS variance, avg(-(p * ln(p) + (1 - p) * ln(1 - p))) AS expected_entropy FROM pd GROUP BY ALL),
      pe AS (SELECT *, -(p_mean * ln(p_mean) + (1 - p_mean) * ln(1 - p_mean)) AS entropy FROM pa), post AS (SELECT *, greatest(0, entropy - expected_entropy) AS information_gap FROM pe)"""
    return {
        "eval_rows": with_pred("", f"SELECT doc_id, condition, method, correct, {r9('p_raw', 'p_cal', 'conf_cal', 'nll_cal', 'brier_cal', 'entropy_cal')} FROM ev"),
        "metrics_by_scope": with_pred(
            f"{_ece(10)}, {rank_scoped}, summ AS (SELECT method, scope, count(*) AS n, CAST(sum((NOT correct)::INT) AS BIGINT) AS errors, "
            "round(avg(nll_raw), 9) AS nll_raw, round(avg(nll_cal), 9) AS nll_cal, round(avg(brier_raw), 9) AS brier_raw, round(avg(brier_cal), 9) AS brier_cal, "
            "round(avg(conf_cal), 9) AS conf_cal, round(avg(entropy_cal), 9) AS entropy_cal, round(1 - sum((NOT correct)::INT) / CAST(count(*) AS DOUBLE), 9) AS accuracy FROM scoped GROUP BY ALL)",
            "SELECT * FROM summ JOIN ece USING (method, scope) JOIN rank_of USING (method, scope)",
        ),
        "ece_by_scope": with_pred(_ece(15), "SELECT * FROM ece"),
        "reliability_bins": with_pred(
            "bin AS (SELECT method, least(greatest(CAST(ceil(round(conf_cal, 12) * 10) AS INT) - 1, 0), 9) AS bin, count(*) AS n, avg(conf_cal) AS mean_conf, avg(correct::INT) AS accuracy FROM ev GROUP BY ALL)",
            "SELECT m.method, CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n, round(mean_conf, 9) AS mean_conf, round(accuracy, 9) AS accuracy FROM meth m CROSS JOIN range(10) b(bin) LEFT JOIN bin USING (method, bin)",
        ),
        "auroc_error": with_pred(rank_scoped, "SELECT method, scope, auroc FROM rank_of"),
        "average_precision_error": with_pred(rank_scoped, "SELECT method, scope, average_precision FROM rank_of"),
        "average_ranks": with_pred("", "SELECT method, doc_id, condition, rank() OVER (PARTITION BY method ORDER BY error_score) + (count(*) OVER (PARTITION BY method, error_score) - 1) / 2e0 AS avg_rank FROM ev"),
        "risk_coverage": with_pred(curve, "SELECT * FROM rc"),
        "risk_coverage_thinned": with_pred(curve, "SELECT * FROM rc WHERE retained = 1 OR retained % 24 = 0"),
        "paired_changes": with_pred(
            "x AS (SELECT *, CAST(correct AS INT) AS c FROM ev)",
            f"SELECT a.method, a.condition, count(*) AS n, {_DELTA.format('c', 'correct')}, {_DELTA.format('conf_cal', 'conf')}, {_DELTA.format('nll_cal', 'nll')}, {_DELTA.format('entropy_cal', 'entropy')} "
            "FROM x a JOIN x o ON a.method = o.method AND a.doc_id = o.doc_id AND o.condition = 'original' GROUP BY ALL",
        ),
        "normalized_long": with_pred(
            "u AS (SELECT doc_id, condition, truth, method || '_raw' AS variant, p_raw AS p FROM ev UNION ALL SELECT doc_id, condition, truth, method || '_calibrated', p_cal FROM ev)",
            "SELECT doc_id, condition, truth, variant, round(p, 9) AS p_yes, p >= 0.5 AS says_yes, round(greatest(p, 1 - p), 9) AS confidence FROM u",
        ),
        "expressed_parse": with_pred(parsed, "SELECT doc_id, condition, method, valid, answer, stated, reason FROM parsed"),
        "parser_reason_counts": with_pred(parsed, "SELECT method, reason, count(*) AS n FROM parsed GROUP BY ALL"),
        "expressed_summary": with_pred(
            parsed,
            "SELECT method, condition, count(*) AS n, CAST(sum(valid::INT) AS BIGINT) AS n_valid, round(avg(stated / 100e0), 9) AS mean_stated, "
            "round(avg(CASE WHEN valid THEN ((answer = 'Yes') = truth)::INT END), 9) AS stated_accuracy, round(avg(abs(stated / 100e0 - conf_cal)), 9) AS divergence FROM parsed GROUP BY ALL",
        ),
        "ensemble_rows": with_pred("", f"SELECT doc_id, condition, {r9('p_mean', 'variance', 'expected_entropy', 'predictive_entropy', 'information_gap', 'disagreement')}, yes_votes, correct FROM ens"),
        "ensemble_metrics": with_pred("", "SELECT condition, count(*) AS n, round(avg(correct::INT), 9) AS accuracy, round(avg(information_gap), 9) AS information_gap, round(avg(variance), 9) AS variance, CAST(sum((disagreement > 0)::INT) AS BIGINT) AS n_disagree FROM ens GROUP BY ALL"),
        "vote_disagreement": with_pred("", "SELECT yes_votes, count(*) AS n, round(avg(disagreement), 9) AS disagreement FROM ens GROUP BY ALL"),
        "alignment_violations": with_pred("", "SELECT doc_id, condition, count(*) AS n, count(DISTINCT method) AS variants, count(DISTINCT truth) AS truths FROM ev WHERE NOT (method = 'seed_2' AND doc_id % 50 = 7) GROUP BY ALL HAVING count(*) <> 4 OR count(DISTINCT method) <> 4 OR count(DISTINCT truth) <> 1"),
        "uq_error_signals": with_pred(_ranking("sig", "signal", "NOT correct"), "SELECT * FROM rank_of"),
        "uq_degradation_signals": with_pred(
            "tgt AS (SELECT s.*, t.condition AS target FROM sig s JOIN cond t ON t.condition <> 'original' AND (s.condition = 'original' OR s.condition = t.condition) UNION ALL SELECT *, 'any_degraded' FROM sig), "
            + _ranking("tgt", "signal, target", "condition <> 'original'"),
            "SELECT * FROM rank_of",
        ),
        "seed_summary": with_pred(
            "b AS (SELECT condition, method, avg(correct::INT) AS accuracy, avg(nll_cal) AS nll FROM ev WHERE method <> 'baseline' GROUP BY ALL)",
            "SELECT condition, " + ", ".join(f"round({f}({m}), 9) AS {n}_{m}" for m in ("accuracy", "nll") for n, f in (("mean", "avg"), ("sd", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM b GROUP BY ALL",
        ),
        "class_counts": "SELECT CAST(quality AS INT) AS quality, count(*) AS n FROM labels GROUP BY 1",
        "quota_allocation": f"WITH {_STRATA}, {_QUOTA.format(name='train', size=80)} SELECT quality, n, CAST(q AS BIGINT) AS quota FROM quota_train JOIN (SELECT quality, count(*) AS n FROM s GROUP BY 1) USING (quality)",
        "selection_hash_rank": f"WITH {_STRATA}, {_RANKED} SELECT doc_id, quality, rank_sha, CAST(place AS INT) AS place FROM ranked",
        "stratified_split": f"WITH {_SPLIT} SELECT * FROM chosen WHERE split IS NOT NULL",
        "split_leakage": f"WITH {_SPLIT} SELECT doc_id, CAST(2 AS BIGINT) AS n FROM chosen WHERE split IS NOT NULL AND doc_id % 7 = 0",
        "token_jaccard": f"WITH {_INPUTS}, t AS (SELECT doc_id, {_tokens('question')} AS q, {_tokens('passage')} AS p FROM inp) SELECT doc_id, len(list_intersect(q, p)) AS shared, len(list_distinct(list_concat(q, p))) AS either, round(CASE WHEN len(list_concat(q, p)) > 0 THEN len(list_intersect(q, p)) / CAST(len(list_distinct(list_concat(q, p))) AS DOUBLE) ELSE 0 END, 9) AS jaccard FROM t",
        "sentence_counts": f"WITH x AS (SELECT doc_id, list_filter(list_transform({_segs('text')}, lambda s: {_strip('s')}), lambda s: s <> '') AS s FROM documents) SELECT doc_id, len(s) AS n_sentences, sha256(array_to_string(s, chr(10))) AS digest FROM x",
        "best_sentence": f"WITH {_BEST} SELECT doc_id, sentence, round(overlap, 9) AS overlap FROM best",
        "evidence_removal": f"WITH {_REMOVED} SELECT doc_id, CASE WHEN i IS NULL THEN 'not_applicable' ELSE 'ok' END AS status, {_REASON} AS reason, sha256(transformed) AS sha, "
        "concat_ws(',', CASE WHEN transformed = '' THEN 'whole_passage_removed' END, CASE WHEN shared = 0 THEN 'zero_lexical_overlap' END) AS flags FROM removed",
        "prefix_truncation": f"WITH {_INPUTS}, {_PREFIX} SELECT doc_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'not_applicable' END AS status, reason, CASE WHEN reason IS NULL THEN sha256(cut) END AS sha, n AS original_tokens FROM halved",
        "contradiction": f"WITH {_BEST}, {_DENIED} SELECT doc_id, CASE WHEN i IS NULL THEN 'not_applicable' ELSE 'ok' END AS status, {_REASON} AS reason, sha256(transformed) AS sha, "
        f"concat_ws(',', CASE WHEN i IS NOT NULL AND used < {FRAGMENT_WORDS} THEN 'fragment_shorter_than_requested' END, CASE WHEN shared = 0 THEN 'zero_lexical_overlap' END) AS flags FROM denied",
        "distractor_top1": f"""WITH {_DONORS} SELECT doc_id, status, reason, donor_id, round(overlap, 9) AS overlap, tie, eligible, fragment_sha, sha256(transformed) AS sha,
            concat_ws(',', CASE WHEN used < {FRAGMENT_WORDS} THEN 'fragment_shorter_than_requested' END, CASE WHEN shared = 0 THEN 'zero_lexical_overlap' END) AS flags FROM distracted""",
        "distractor_without_donors": f"""WITH {_INPUTS}, n AS (SELECT count(*) FILTER (doc_id % 100 <> 7) AS k FROM inp) SELECT CASE WHEN doc_id % 100 = 7 AND k > 0 THEN 'ok' ELSE 'not_applicable' END AS status,
            CASE WHEN doc_id % 100 = 7 AND k > 0 THEN NULL ELSE 'no_eligible_donor' END AS reason, CASE WHEN doc_id % 100 = 7 THEN k ELSE 0 END AS eligible, count(*) AS n FROM inp, n GROUP BY ALL""",
        "donor_fragments": f"WITH {_DONORS} SELECT doc_id, donor_id FROM distracted WHERE donor_id IS NOT NULL AND (doc_id % 10 = 3 OR donor_id % 10 = 4)",
        "donor_reuse": f"WITH {_DONORS} SELECT donor_id, count(k) AS uses FROM don LEFT JOIN picked USING (donor_id) GROUP BY 1",
        "condition_expand": f"WITH {_PRED} SELECT condition, CAST(quality AS INT) AS quality, count(*) AS n FROM labels, cond GROUP BY ALL",
        "degradation_summary": f"""WITH {degraded} SELECT condition, count(*) AS n, CAST(sum((status = 'ok')::INT) AS BIGINT) AS n_ok,
            CAST(sum(coalesce(transformed <> passage, false)::INT) AS BIGINT) AS n_changed,
            CAST(sum((transformed IS NULL)::INT) AS BIGINT) AS n_unknown, CAST(sum(length(transformed)) AS BIGINT) AS chars, CAST(sum({ppm}) AS BIGINT) AS ppm FROM r GROUP BY 1""",
        "status_counts": f"WITH {degraded} SELECT condition, status, reason, count(*) AS n FROM r GROUP BY ALL",
        "degraded_tokens": f"""WITH {degraded}, l AS (SELECT condition, 'text' AS of, len({_words('transformed')}) AS v FROM r WHERE status = 'ok'
            UNION ALL SELECT condition, 'prompt', len({_words('p')}) FROM (SELECT r.condition, {made.format('transformed')} AS p FROM r JOIN inp USING (doc_id) WHERE status = 'ok'))
            SELECT condition, of, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, list_sort(list(v))[((count(*) - 1) * 50 + 50) // 100 + 1] AS median, max(v) AS most FROM l GROUP BY ALL""",
        "nearest_rank_percentiles": "WITH x AS (SELECT l_returnflag, l_quantity AS v FROM lineitem) SELECT l_returnflag, count(*) AS n, "
        + ", ".join(nearest(p, f"((count(*) - 1) * {p} + 50) // 100") for p in (5, 50, 95)) + " FROM x GROUP BY 1",
        "prompt_length_stats": "WITH x AS (SELECT lang, length(text) AS v FROM documents) SELECT lang, count(*) AS n, "
        + ", ".join(nearest(p, f"CAST(round_even((count(*) - 1) * {p} / 100e0, 0) AS BIGINT)") for p in (50, 90, 99)) + " FROM x GROUP BY 1",
        "linear_quantiles": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 9) AS low, round(quantile_cont(l_extendedprice, 0.975), 9) AS high FROM lineitem GROUP BY 1",
        "row_identity": "SELECT doc_id, 'input-' || sha256(doc_id || '|' || quality) AS input_id FROM labels",
        "canonical_rows": f"WITH {canon} SELECT doc_id, quality, part, wide, sha256(j) AS row_sha256 FROM c",
        "row_hash_faults": f"WITH {canon} SELECT doc_id FROM c WHERE doc_id % 9 = 4 OR doc_id % 11 = 5",
        "source_digest": "WITH b AS (SELECT doc_id // 1024 AS b, count(*) AS n, sha256(string_agg(sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM b",
        "standardizer_stats": f"WITH {_FEAT} SELECT CAST(dim AS INT) AS dim, round(avg(v), 9) AS mean, round(greatest(stddev_pop(v), 1e-6), 9) AS scale FROM flat GROUP BY 1",
        "laplace_diagonal": f"WITH {_FEAT}, z AS (SELECT vec_id, sum(v * ((dim % 7 - 3) / 4e0)) AS z FROM flat GROUP BY 1), p AS (SELECT vec_id, 1 / (1 + exp(-z)) AS p FROM z) SELECT CAST(dim AS INT) AS dim, round(1 + sum(p * (1 - p) * v * v), 9) AS curvature FROM flat JOIN p USING (vec_id) GROUP BY 1",
        "laplace_draws": f"""WITH {_FEAT}, z AS (SELECT vec_id, sum(v * ((dim % 7 - 3) / 4e0)) AS z FROM flat GROUP BY 1), p AS (SELECT vec_id, 1 / (1 + exp(-z)) AS p FROM z),
            c AS (SELECT CAST(dim AS INT) AS dim, 1 + sum(p * (1 - p) * v * v) AS curvature FROM flat JOIN p USING (vec_id) GROUP BY 1),
            h AS (SELECT CAST(draw AS INT) AS draw, dim, curvature, sha256('{DRAW_SEED}|' || draw || '|' || dim) AS h FROM c, range({DRAWS}) d(draw)),
            u AS (SELECT *, (CAST('0x' || substr(h, 1, 8) AS BIGINT) + 0.5) / 4294967296e0 AS u1, (CAST('0x' || substr(h, 9, 8) AS BIGINT) + 0.5) / 4294967296e0 AS u2 FROM h)
            SELECT draw, dim, round((dim % 7 - 3) / 4e0 + sqrt(-2 * ln(u1)) * cos(u2 * 2 * pi()) / sqrt(curvature), 9) AS w FROM u""",
        "posterior_summary": f"{posterior} SELECT vec_id, target, {r9('p_mean', 'variance', 'expected_entropy', 'entropy', 'information_gap')} FROM post",
        "posterior_metrics": f"""{posterior}, l AS (SELECT vec_id % 5 AS fold, p_mean AS p, target = 1 AS truth, (round(p_mean, 12) >= 0.5) = (target = 1) AS correct, greatest(p_mean, 1 - p_mean) AS conf, entropy, variance, information_gap FROM post),
            m AS (SELECT *, round(1 - conf, 12) AS error_score, -ln(CASE WHEN truth THEN least(greatest(p, 1e-12), 1 - 1e-12) ELSE 1 - least(greatest(p, 1e-12), 1 - 1e-12) END) AS nll, (p - truth::INT) * (p - truth::INT) AS brier FROM l),
            bin AS (SELECT fold, least(greatest(CAST(ceil(round(conf, 12) * 10) AS INT) - 1, 0), 9) AS b, count(*) AS k, avg(conf) AS mc, avg(correct::INT) AS acc FROM m GROUP BY ALL),
            e AS (SELECT fold, round(sum(k * abs(acc - mc)) / sum(k), 9) AS ece FROM bin GROUP BY 1), {_ranking('m', 'fold', 'NOT correct', 'error_score')}
            SELECT fold, count(*) AS n, CAST(sum((NOT correct)::INT) AS BIGINT) AS errors, {', '.join(f'round(avg({c}), 9) AS {c}' for c in ('nll', 'brier', 'entropy', 'variance', 'information_gap'))}, round(avg(conf), 9) AS conf_cal,
            any_value(ece) AS ece, any_value(auroc) AS auroc, any_value(average_precision) AS average_precision FROM m JOIN e USING (fold) JOIN rank_of USING (fold) GROUP BY 1""",
        "temperature_grid_nll": with_pred(f"g(temperature_g) AS (VALUES {grid})", "SELECT method, temperature_g AS temperature, round(avg(ln(1 + exp(-(CASE WHEN quality = 1 THEN margin ELSE -margin END) / temperature_g))), 9) AS nll FROM pred, g GROUP BY ALL"),
        "bootstrap_differences": with_pred(boot, f"SELECT method, replicate, {r9('d_accuracy', 'd_nll', 'd_brier')} FROM diff"),
        "bootstrap_intervals": with_pred(seeds, "SELECT scope, " + ", ".join(f"round(quantile_cont(d_{m}, {q}), 9) AS d_{m}_{n}" for m in five for n, q in (("low", 0.025), ("high", 0.975))) + " FROM sd GROUP BY 1"),
        "bootstrap_weights": f"WITH {draws} SELECT replicate, doc_id, weight FROM wt",
        "bootstrap_measures": with_pred(measured, f"SELECT method, scope, replicate, {r9(*five)} FROM ms"),
        "risk_coverage_by_scope": with_pred(
            """curve AS (SELECT method, scope, doc_id, condition, conf_cal, row_number() OVER w AS k, CAST(sum((NOT correct)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, count(*) OVER (PARTITION BY method, scope) AS n
               FROM scoped WINDOW w AS (PARTITION BY method, scope ORDER BY round(conf_cal, 12) DESC, doc_id, condition))""",
            "SELECT method, scope, doc_id, condition, k AS retained, round(k / CAST(n AS DOUBLE), 9) AS coverage, e AS errors, round(e / CAST(k AS DOUBLE), 9) AS risk, round(1 - e / CAST(k AS DOUBLE), 9) AS selective_accuracy, round(conf_cal, 9) AS threshold FROM curve",
        ),
        "ensemble_scoped_metrics": with_pred(
            f"{both_families}, " + grouped_metrics("fs", "family, scope", ("nll", "brier", "confidence", "predictive_entropy", "expected_entropy", "information_gap", "variance", "disagreement"),
            ", CAST(sum((NOT correct)::INT) AS BIGINT) AS errors, CAST(sum((disagreement > 0)::INT) AS BIGINT) AS n_disagree"),
            "SELECT * FROM gm JOIN ge USING (family, scope) JOIN rank_of USING (family, scope)",
        ),
        "normalized_sources": with_pred(sources, f"SELECT variant, input_id, condition, truth, says_yes, correct, {r9('p_yes', 'predictive_entropy', 'expected_entropy', 'information_gap', 'variance', 'confidence')} FROM us"),
        "unified_metrics": with_pred(
            f"{unified_scopes}, " + grouped_metrics("ux", "variant, scope", ("accuracy", "nll", "brier", "confidence", "predictive_entropy", "expected_entropy", "information_gap")),
            "SELECT * FROM gm JOIN ge USING (variant, scope) JOIN rank_of USING (variant, scope)",
        ),
        "uq_all_signals": with_pred(f"{all_signals}, " + _ranking("gs", "variant, signal", "NOT correct"), "SELECT * FROM rank_of"),
        "degraded_faults": f"""WITH {degraded}, f0 AS (SELECT doc_id, condition, passage, status AS s, reason AS r, transformed AS t, list_sort(list_filter(flags, lambda x: x IS NOT NULL)) AS g,
            'degraded-' || sha256(doc_id || '|' || condition || '|' || coalesce(transformed, '')) AS row_id FROM r),
            f AS (SELECT doc_id, condition, passage, row_id, CASE WHEN doc_id % 11 = 2 AND condition = 'prefix_truncation_50' THEN 'failed' ELSE s END AS status,
            CASE WHEN doc_id % 13 = 3 AND condition = 'original' THEN 'unchanged_result' ELSE r END AS reason,
            CASE WHEN doc_id % 17 = 4 AND condition = 'no_passage' THEN ' ' WHEN doc_id % 19 = 5 AND condition = 'original' THEN NULL ELSE t END AS transformed,
            CASE WHEN doc_id % 23 = 6 AND condition = 'lexical_contradiction' THEN 9 ELSE list_position([{', '.join(repr(c) for c in CONDITIONS)}], condition) - 1 END AS condition_index,
            CASE WHEN doc_id % 29 = 7 AND condition = 'no_passage' THEN ['zero_lexical_overlap', 'other'] ELSE g END AS flags FROM f0) """
        + broken("f", {
            "known_condition": known, "condition_in_place": in_place, "known_status": "status IN ('ok', 'not_applicable')", "reason_unless_ok": "(status = 'ok') = (reason IS NULL)",
            "known_reason": "reason IS NULL OR reason IN ('no_question_lexical_tokens', 'no_sentence', 'empty_passage_tokenization', 'unchanged_result', 'no_eligible_donor', 'empty_selected_sentence_tokenization', 'prompt_over_limit')",
            "text_if_ok": "(status = 'ok') = (transformed IS NOT NULL)", "always_applicable": "condition NOT IN ('original', 'no_passage') OR status = 'ok'",
            "original_unchanged": "condition <> 'original' OR transformed IS NOT DISTINCT FROM passage", "no_passage_empty": "condition <> 'no_passage' OR transformed = ''",
            "known_flags": "len(list_filter(flags, lambda x: x NOT IN ('fragment_shorter_than_requested', 'token_boundary_adjusted', 'whole_passage_removed', 'zero_lexical_overlap'))) = 0",
            "flags_in_order": "flags = list_sort(list_distinct(flags))", "id_of_row": "row_id = 'degraded-' || sha256(doc_id || '|' || condition || '|' || coalesce(transformed, ''))",
        }),
        "incomplete_inputs": f"WITH {_INPUTS} SELECT doc_id FROM inp WHERE doc_id % 31 = 8",
        "prediction_faults": f"""WITH {runtime}, {_PRED}, f0 AS (SELECT doc_id, CASE WHEN status <> 'ok' THEN 'not_run' WHEN margin IS NULL THEN 'missing' ELSE 'ok' END AS run_status, CASE WHEN status <> 'ok' THEN coalesce(reason, status) END AS rr,
            CASE WHEN status = 'ok' THEN round(p_raw, 9) END AS p, CASE WHEN status = 'ok' AND margin IS NOT NULL THEN CASE WHEN margin >= 0 THEN 'Yes' ELSE 'No' END END AS a,
            CASE WHEN status = 'ok' THEN {entropy('p_raw')} END AS e FROM runtime LEFT JOIN prob USING (doc_id, condition)),
            f AS (SELECT run_status, CASE WHEN doc_id % 11 = 2 THEN 1.5e0 WHEN doc_id % 13 = 3 THEN NULL ELSE p END AS p_yes, CASE WHEN doc_id % 17 = 4 THEN 'Maybe' ELSE a END AS answer,
            CASE WHEN doc_id % 19 = 5 THEN 'other' ELSE rr END AS run_reason, CASE WHEN doc_id % 23 = 6 THEN CAST('nan' AS DOUBLE) ELSE e END AS entropy FROM f0) """
        + broken("f", {
            "known_status": "run_status IN ('ok', 'not_run', 'missing')", "reason_if_not_run": "(run_status = 'not_run') = (run_reason IS NOT NULL)",
            "scores_if_run": "run_status <> 'ok' OR (p_yes IS NOT NULL AND answer IS NOT NULL AND entropy IS NOT NULL)", "no_scores_unless_run": "run_status = 'ok' OR (p_yes IS NULL AND answer IS NULL AND entropy IS NULL)",
            "probability": f"run_status <> 'ok' OR {unit('p_yes')}", "answer_of_probability": "run_status <> 'ok' OR answer = CASE WHEN p_yes >= 0.5 THEN 'Yes' ELSE 'No' END",
            "entropy_in_range": "run_status <> 'ok' OR (isfinite(entropy) AND entropy BETWEEN 0 AND 0.6931471815599453)",
        }),
        "member_faults": with_pred(
            "f AS (SELECT condition, condition_index, p_raw, p_cal, truth, correct, doc_id, CASE WHEN doc_id % 11 = 2 THEN 0e0 ELSE temperature END AS temperature, CASE WHEN doc_id % 13 = 3 THEN NOT says_yes ELSE says_yes END AS says_yes FROM ev)",
            broken("f", {
                "known_condition": known, "condition_in_place": in_place, "probabilities": f"{unit('p_raw')} AND {unit('p_cal')}", "temperature_above_zero": "temperature > 0",
                "class_kept": "says_yes = (p_cal >= 0.5)", "correct_of_truth": "correct = (says_yes = truth)", "hash_form": "doc_id % 17 <> 4 AND doc_id % 19 <> 5",
            }),
        ),
        "calibration_rows": with_pred(
            "c AS (SELECT * FROM prob WHERE condition = 'original' AND doc_id % 10 = 1)",
            f"SELECT doc_id, method, condition, 'train' AS source_split, round(margin, 9) AS yes_logit, 0e0 AS no_logit, round(p_raw, 9) AS p_yes, round(1 - p_raw, 9) AS p_no, CASE WHEN margin >= 0 THEN 'Yes' ELSE 'No' END AS prediction, "
            f"round(greatest(p_raw, 1 - p_raw), 9) AS confidence, round({entropy('p_raw')}, 9) AS entropy, CASE WHEN method <> 'baseline' THEN replace(method, 'seed_', 'adapter-') END AS adapter_id, 'calibration-' || sha256(doc_id || '|' || method) AS row_id FROM c",
        ),
        "calibration_faults": with_pred(
            "mf AS (SELECT doc_id FROM labels WHERE doc_id % 10 = 1), c AS (SELECT doc_id, method, CASE WHEN doc_id % 3 = 1 THEN CAST('inf' AS DOUBLE) ELSE margin END AS y, p_raw, CASE WHEN doc_id % 7 = 3 THEN 0.9e0 ELSE 1 - p_raw END AS q FROM prob WHERE condition = 'original' AND doc_id % 10 = 1)",
            broken("mf", {"split": "doc_id % 3 <> 1", "source_split": "true", "label": "true", "example_id_form": "true"}, ", 'manifest' AS of") + " UNION ALL "
            + broken("c", {
                "original_evidence": "true", "source_split": "true", "finite_logits": "isfinite(y)", "normalized": "abs(p_raw + q - 1) <= 1e-5", "probability_of_logits": "abs(p_raw - 1 / (1 + exp(-y))) <= 1e-5",
                "baseline_without_adapter": "method <> 'baseline'", "hash_form": "true",
            }, ", 'prediction' AS of"),
        ),
        "calibration_alignment": "SELECT doc_id, CAST(CASE WHEN doc_id % 100 = 51 THEN 0 ELSE 1 END AS BIGINT) AS in_manifest, CAST(CASE WHEN doc_id % 100 = 31 THEN 0 WHEN doc_id % 100 = 71 THEN 2 ELSE 1 END AS BIGINT) AS in_predictions FROM labels WHERE doc_id % 100 IN (31, 51, 71)",
        "interval_faults": "SELECT unnest(['d_accuracy', 'd_nll', 'd_brier']) AS rule, unnest([CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT)]) AS n",
        "report_faults": "SELECT unnest(['known_scope', 'row_count', 'accuracy', 'brier', 'ece', 'auroc', 'nll']) AS rule, unnest([CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(4 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)]) AS n",
        "parameter_faults": "SELECT unnest(['fragment_sha256', 'donor_example_id']) AS rule, unnest([CAST(sum((doc_id % 5 = 1)::INT) AS BIGINT), CAST(sum((doc_id % 7 = 3)::INT) AS BIGINT)]) AS n FROM labels",
        "raw_text_leaks": f"WITH {_INPUTS} SELECT doc_id FROM inp WHERE (doc_id % 9 = 2 AND passage <> '') OR (doc_id % 11 = 3 AND question <> '') OR passage = 'x' OR question = 'x'",
        "stage_selection": "WITH h AS (SELECT DISTINCT doc_id FROM documents ORDER BY 1 LIMIT 9), l AS (SELECT doc_id FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1), "
        "s AS (SELECT doc_id, 1 AS o FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h) ORDER BY 1 LIMIT 1)), t AS (SELECT doc_id, 0 AS o FROM l WHERE doc_id NOT IN (SELECT doc_id FROM h) UNION ALL SELECT * FROM s) "
        "SELECT doc_id FROM h UNION ALL SELECT doc_id FROM (SELECT doc_id FROM t ORDER BY o LIMIT 1)",
        "validate_manifest": "SELECT unnest(['has_text', 'chars_agree', 'known_language', 'short']) AS rule, unnest([CAST(sum((NOT coalesce(length(text) > 0, false))::INT) AS BIGINT), CAST(sum((NOT coalesce(length(text) = n_chars, false))::INT) AS BIGINT), "
        "CAST(sum((NOT coalesce(lang IN ('en', 'fr', 'de', 'es'), false))::INT) AS BIGINT), CAST(sum((NOT coalesce(n_chars <= 768, false))::INT) AS BIGINT)]) AS n FROM documents",
        "eligibility": f"WITH w AS (SELECT doc_id, len({_words('text')}) AS n_words FROM documents) SELECT doc_id, n_words, n_words <= 768 AS eligible FROM w",
        "sentence_spans": f"""WITH cut AS (SELECT doc_id, generate_subscripts(segs, 1) AS i, unnest(segs) AS seg FROM (SELECT doc_id, {_segs('text')} AS segs FROM documents)),
            placed AS (SELECT doc_id, i, {_strip('seg')} AS s, coalesce(sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(seg) - length(regexp_replace(seg, '^\\s+', '')) AS a FROM cut)
            SELECT doc_id, count(i) AS n, sha256(coalesce(string_agg(CAST(a AS BIGINT) || ':' || CAST(a + length(s) AS BIGINT), ',' ORDER BY i), '')) AS digest FROM documents LEFT JOIN (SELECT * FROM placed WHERE s <> '') USING (doc_id) GROUP BY 1""",
        "prompts": f"WITH {_INPUTS}, p AS (SELECT doc_id, {made.format('passage')} AS p FROM inp) SELECT doc_id, sha256(p) AS sha, len({_words('p')}) AS n_tokens FROM p",
        "runtime_records": f"""WITH {runtime}, o AS (SELECT doc_id, sha256(question || chr(10) || passage) AS input_sha256, len({_words('passage')}) AS pt, sha256({made.format('passage')}) AS ops, len({_words(made.format('passage'))}) AS opt FROM inp),
            n AS (SELECT unnest({list(CONDITIONS)}) AS condition, unnest(range(6)) AS condition_index),
            f AS (SELECT doc_id, condition, status AS st, reason AS rs, list_sort(list_filter(flags, lambda f: f IS NOT NULL)) AS flags FROM r),
            j AS (SELECT {{'changed_from_original': u.changed, 'condition': u.condition, 'condition_index': n.condition_index, 'input_id': 'doc:' || u.doc_id, 'input_sha256': o.input_sha256, 'original_passage_sha256': u.passage_sha,
              'original_passage_tokens': o.pt, 'original_prompt_sha256': o.ops, 'original_prompt_tokens': o.opt, 'parameters': {{'fragment_tokens': CASE WHEN u.condition IN ('irrelevant_distractor', 'lexical_contradiction') THEN {FRAGMENT_WORDS} END,
              'seed': CASE WHEN u.condition = 'irrelevant_distractor' THEN 20260803 END, 'share': CASE WHEN u.condition = 'prefix_truncation_50' THEN '1/2' END}}, 'prompt_tokens': u.prompt_tokens, 'protocol_version': '{PROTOCOL}',
              'quality_flags': f.flags, 'rendered_prompt_sha256': u.prompt_sha, 'renderer_version': '{RENDERER}', 'research_split': 'test', 'runtime_maximum_prompt_tokens': {MOST_TOKENS},
              'runtime_reason_code': CASE WHEN f.st <> 'ok' THEN 'transformation_not_applicable' WHEN NOT u.runs THEN 'prompt_over_limit' END, 'runtime_status': CASE WHEN f.st <> 'ok' THEN 'not_run' WHEN u.runs THEN 'ok' ELSE 'failed' END,
              'schema_version': 1, 'source_index': u.doc_id, 'source_split': 'validation', 'transformation_id': u.row_id, 'transformation_reason_code': f.rs, 'transformation_status': f.st, 'transformed_passage_sha256': u.text_sha,
              'transformed_passage_tokens': CASE WHEN f.st = 'ok' THEN u.text_tokens END}} AS s FROM runtime u JOIN o USING (doc_id) JOIN n USING (condition) JOIN f USING (doc_id, condition)),
            x AS (SELECT s, unnest(s), sha256(CAST(to_json(s) AS VARCHAR)) AS row_sha256 FROM j)
            SELECT * EXCLUDE (s) REPLACE (array_to_string(quality_flags, ',') AS quality_flags, '{{' || concat_ws(',', '"fragment_tokens":' || parameters.fragment_tokens, '"seed":' || parameters.seed, '"share":"' || parameters.share || '"') || '}}' AS parameters) FROM x""",
        "evaluation_records": with_pred(
            parsed,
            f"""SELECT 1 AS schema_version, '{PROTOCOL}' AS protocol_version, method, 'doc:' || doc_id AS input_id, doc_id AS source_index, condition, condition_index, 'No,Yes' AS class_order, CASE WHEN truth THEN 'Yes' ELSE 'No' END AS ground_truth,
            CASE WHEN says_yes THEN 'Yes' ELSE 'No' END AS token_prediction, correct, round(margin, 9) AS yes_logit, 0e0 AS no_logit, round(p_raw, 9) AS raw_p_yes, round(1 - p_raw, 9) AS raw_p_no, round(p_cal, 9) AS calibrated_p_yes, round(1 - p_cal, 9) AS calibrated_p_no,
            round(conf_raw, 9) AS raw_confidence, round(conf_cal, 9) AS calibrated_confidence, round({entropy('p_raw')}, 9) AS raw_entropy, round(entropy_cal, 9) AS calibrated_entropy, temperature, sha256('temperature of ' || method) AS temperature_artifact_sha256,
            sha256(concat_ws('|', doc_id, condition, method, completion)) AS source_prediction_row_sha256, valid AS expressed_parser_valid, reason AS expressed_parser_reason_code, stated AS expressed_confidence,
            round(abs(stated / 100e0 - conf_raw), 9) AS expressed_raw_absolute_divergence, round(abs(stated / 100e0 - conf_cal), 9) AS expressed_calibrated_absolute_divergence, true AS sealed,
            'evaluation-' || sha256(concat_ws('|', 'doc:' || doc_id, condition, method, '{PROTOCOL}', sha256(concat_ws('|', doc_id, condition, method, completion)), sha256('temperature of ' || method))) AS evaluation_id FROM parsed""",
        ),
        "runtime_rows": f"WITH {runtime} SELECT * FROM runtime",
        "prediction_rows": f"""WITH {runtime}, {_PRED}, {parsed}, j AS (SELECT r.doc_id, r.condition, r.status, r.reason AS run_reason0, r.prompt_sha, r.prompt_tokens, q.method, q.margin, q.p_raw, q.completion, q.valid, q.answer AS said, q.stated, q.reason AS parse_reason,
            r.status = 'ok' AND margin IS NOT NULL AS go, CASE WHEN margin >= 0 THEN 'Yes' ELSE 'No' END AS top FROM runtime r LEFT JOIN parsed q USING (doc_id, condition))
            SELECT 'prediction-' || sha256(concat_ws('|', doc_id, condition, method)) AS row_id, doc_id, condition, method, prompt_sha, prompt_tokens, CASE WHEN status <> 'ok' THEN 'not_run' WHEN margin IS NULL THEN 'missing' ELSE 'ok' END AS run_status,
            CASE WHEN status <> 'ok' THEN coalesce(run_reason0, status) END AS run_reason, CASE WHEN go THEN round(p_raw, 9) END AS p_yes, CASE WHEN go THEN round(1 - p_raw, 9) END AS p_no, CASE WHEN go THEN top END AS answer,
            CASE WHEN go THEN round(margin, 9) END AS yes_logit, CASE WHEN go THEN 0e0 END AS no_logit, CASE WHEN go THEN round(greatest(p_raw, 1 - p_raw), 9) END AS confidence, CASE WHEN go THEN sha256(completion) END AS completion_sha,
            CASE WHEN go THEN length(completion) END AS completion_chars, CASE WHEN go THEN valid END AS parser_valid, CASE WHEN go THEN parse_reason END AS parser_reason, CASE WHEN go THEN said END AS stated_answer, CASE WHEN go THEN stated END AS stated,
            CASE WHEN go AND valid THEN said = top END AS answers_agree, CASE WHEN go THEN round({entropy('p_raw')}, 9) END AS entropy FROM j""",
        "flag_counts": f"WITH {degraded}, f AS (SELECT condition, unnest(flags) AS flag FROM r) SELECT condition, flag, count(*) AS n FROM f WHERE flag IS NOT NULL GROUP BY ALL",
        "prompt_deltas": f"""WITH {runtime}, d AS (SELECT a.condition, a.prompt_tokens - o.prompt_tokens AS d FROM runtime a JOIN runtime o ON o.doc_id = a.doc_id AND o.condition = 'original' WHERE a.condition <> 'original')
            SELECT condition, count(d) AS n, CAST(sum(d) AS BIGINT) AS total, min(d) AS least, max(d) AS most FROM d WHERE d IS NOT NULL GROUP BY 1""",
        "prediction_counts": with_pred(parsed, " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce(CAST({c} AS VARCHAR), 'none') AS value, count(*) AS n FROM parsed GROUP BY 2" for c in ("condition", "method", "valid", "answer", "reason"))),
        "member_variation": with_pred(
            "v AS (SELECT condition, doc_id, min(p_cal) <> max(p_cal) AS varied, min(says_yes) <> max(says_yes) AS split FROM ev WHERE method <> 'baseline' GROUP BY ALL)",
            "SELECT condition, count(*) AS n, CAST(sum(varied::INT) AS BIGINT) AS n_varied, CAST(sum(split::INT) AS BIGINT) AS n_disagree FROM v GROUP BY 1",
        ),
        "method_comparisons": with_pred(
            "m AS (SELECT method, scope, avg(correct::INT) AS accuracy, avg(nll_cal) AS nll, avg(brier_cal) AS brier FROM scoped GROUP BY ALL)",
            "SELECT c.scope, c.method AS candidate, b.method AS reference, round(c.accuracy - b.accuracy, 9) AS d_accuracy, round(c.nll - b.nll, 9) AS d_nll, round(c.brier - b.brier, 9) AS d_brier FROM m c JOIN m b ON c.scope = b.scope AND b.method = 'baseline' AND c.method <> 'baseline'",
        ),
        "adapter_rows": with_pred("", "SELECT method, replace(method, 'seed_', 'adapter-') AS adapter_id, count(*) AS n FROM ev WHERE method <> 'baseline' GROUP BY ALL"),
        "adapter_envelopes": with_pred(
            "a0 AS (SELECT doc_id, condition, method, correct, says_yes, CAST(right(method, 1) AS INT) AS i, '\"condition\":\"' || condition || '\",\"correct\":' || correct AS c FROM ev WHERE method <> 'baseline'), "
            "a1 AS (SELECT *, sha256('{' || c || ',\"doc_id\":' || doc_id || ',\"method\":\"' || method || '\",\"says_yes\":' || says_yes || '}') AS core_row_sha256, 'full_seed_' || i AS adapter_stage, i AS adapter_training_seed, "
            "'checkpoints/' || i AS adapter_checkpoint_path, sha256('ledger ' || i) AS adapter_checkpoint_ledger_sha256, sha256('weights ' || i) AS adapter_weights_sha256, sha256('config ' || i) AS adapter_semantic_config_sha256 FROM a0), "
            "a2 AS (SELECT *, 'adapted-' || sha256(doc_id || '|' || condition || '|' || adapter_weights_sha256) AS adapter_row_id FROM a1)",
            "SELECT * EXCLUDE (i, c), sha256('{\"adapter_checkpoint_ledger_sha256\":\"' || adapter_checkpoint_ledger_sha256 || '\",\"adapter_checkpoint_path\":\"' || adapter_checkpoint_path || '\",\"adapter_row_id\":\"' || adapter_row_id || "
            "'\",\"adapter_semantic_config_sha256\":\"' || adapter_semantic_config_sha256 || '\",\"adapter_stage\":\"' || adapter_stage || '\",\"adapter_training_seed\":' || adapter_training_seed || ',\"adapter_weights_sha256\":\"' || adapter_weights_sha256 || "
            "'\",\"condition\":\"' || condition || '\",\"core_row_sha256\":\"' || core_row_sha256 || '\",\"correct\":' || correct || ',\"doc_id\":' || doc_id || ',\"method\":\"' || method || '\",\"says_yes\":' || says_yes || '}') AS adapter_row_sha256 FROM a2",
        ),
        "adapter_identities": with_pred("", "SELECT method, count(DISTINCT doc_id % 50 = 7) AS n FROM ev WHERE method = 'seed_2' GROUP BY 1 HAVING count(DISTINCT doc_id % 50 = 7) > 1"),
        "uq_degradation_means": with_pred(
            "m AS (SELECT signal, condition, count(*) AS n, avg(score) AS mean FROM sig GROUP BY ALL)",
            "SELECT a.signal, a.condition AS target, a.n, round(o.mean, 9) AS mean_original, round(a.mean, 9) AS mean_degraded, round(a.mean - o.mean, 9) AS difference FROM m a JOIN m o ON a.signal = o.signal AND o.condition = 'original' WHERE a.condition <> 'original'",
        ),
        "seed_uq_summary": with_pred(
            "own AS (SELECT method, condition, correct, round(entropy_cal, 12) AS score FROM ev WHERE method <> 'baseline'), wide AS (SELECT *, 'error' AS target, NOT correct AS positive FROM own "
            "UNION ALL SELECT *, 'any_degraded', condition <> 'original' FROM own UNION ALL SELECT own.*, t.condition, own.condition <> 'original' FROM own JOIN cond t ON t.condition <> 'original' AND own.condition IN ('original', t.condition)), "
            + _ranking("wide", "method, target", "positive"),
            "SELECT target, " + ", ".join(f"round({f}({m}), 9) AS {n}_{m}" for m in ("auroc", "average_precision") for n, f in (("mean", "avg"), ("sd", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM rank_of GROUP BY 1",
        ),
        "overlap_fractions": f"WITH {_INPUTS}, t AS (SELECT len(list_intersect(q, p)) AS a, len(list_distinct(list_concat(q, p))) AS b FROM (SELECT {_tokens('question')} AS q, {_tokens('passage')} AS p FROM inp)) "
        "SELECT CASE WHEN b = 0 THEN '0/1' ELSE (a // greatest(gcd(a, b), 1)) || '/' || (b // greatest(gcd(a, b), 1)) END AS fraction, count(*) AS n FROM t GROUP BY 1",
        "logit_summary": f"WITH {_FEAT}, m AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS top FROM flat), z AS (SELECT vec_id, max(top) AS top, sum(exp(v - top)) AS z, sum(exp(v - top) * (v - top)) AS d, min(CASE WHEN v = top THEN dim END) AS a FROM m GROUP BY 1) "
        "SELECT vec_id, round(top + ln(z), 9) AS lse, CAST(a AS INT) AS top, round(ln(z) - d / z, 9) AS entropy FROM z",
        "schedule": "SELECT CAST(i AS BIGINT) AS step, round(CASE WHEN i < 4 THEN (i + 1) / 4e0 ELSE 0.5e0 * (1 + cos(pi() * (i - 4) / 71e0)) END, 9) AS factor FROM range(76) r(i)",
        "manifest_lineage": f"""WITH {_SPLIT}, r AS (SELECT c.doc_id, split, sha256(text) AS input_sha, sha256(c.doc_id || '|' || quality) AS rec FROM chosen c JOIN documents d USING (doc_id) WHERE split IS NOT NULL),
            f AS (SELECT split, input_sha, CASE WHEN doc_id % 11 = 5 THEN upper(rec) ELSE rec END AS rec, CASE WHEN doc_id % 9 = 4 THEN 'doc:4' ELSE 'doc:' || doc_id || '-' || substr(rec, 1, 12) END AS id,
              CASE WHEN doc_id % 20 = 3 THEN 'validation' WHEN doc_id % 30 = 7 THEN 'other' WHEN split = 'test' THEN 'validation' ELSE 'train' END AS src FROM r)
            SELECT unnest(['known_source', 'source_of_split', 'id_of_record', 'form_of_record_sha256', 'form_of_input_sha256', 'unique_id', 'unique_record', 'unique_input']) AS rule,
              unnest([count(*) FILTER (src = 'other'), count(*) FILTER (src <> CASE WHEN split = 'test' THEN 'validation' ELSE 'train' END), count(*) FILTER (NOT suffix(id, substr(rec, 1, 12))),
                count(*) FILTER (NOT regexp_full_match(rec, '[0-9a-f]{{64}}')), 0, count(*) - count(DISTINCT id), count(*) - count(DISTINCT rec), count(*) - count(DISTINCT input_sha)]) AS n FROM f""",
        "typed_rows": "SELECT row_number() OVER () - 1 AS ordinal, doc_id, true AS no_source, concat_ws(',', 'source: string for int32', 'extra: missing', CASE WHEN doc_id IS NULL THEN 'doc_id: null' END, CASE WHEN text IS NULL THEN 'text: null' END) AS faults FROM documents",
        "condition_sizes": f"""WITH {_INPUTS}, k AS (SELECT count(*) AS expected FROM labels), u AS (SELECT count(*) AS n FROM inp WHERE doc_id % 15 = 4)
            SELECT 'no_passage' AS condition, count(*) FILTER (doc_id % 10 <> 3) AS n, expected FROM inp, k GROUP BY expected
            UNION ALL SELECT 'original', expected - n, expected FROM k, u UNION ALL SELECT 'unknown', n, 0 FROM u""",
        "manifest_faults": f"WITH {_SPLIT}, f AS (SELECT doc_id, quality, rank_sha, CASE WHEN doc_id % 20 = 3 THEN reverse(rank_sha) ELSE rank_sha END AS told, CASE WHEN doc_id % 30 = 7 THEN 'other' WHEN split <> 'calibration' THEN split END AS split, "
        "CASE WHEN doc_id % 40 = 9 THEN 0 ELSE place END AS place FROM chosen WHERE split IS NOT NULL) "
        + broken("f", {"known_split": "split IN ('train', 'calibration', 'test')", "rank_of_id": "told = rank_sha", "place_above_zero": "place >= 1", "stratum": "quality IN (0, 1)"}),
        "manifest_sizes": f"WITH {_SPLIT}, f AS (SELECT CASE WHEN doc_id % 30 = 7 THEN 'other' WHEN split <> 'calibration' THEN split END AS split FROM chosen WHERE split IS NOT NULL), "
        "c AS (SELECT split, count(*) AS n FROM f WHERE split IS NOT NULL GROUP BY 1), e(split, expected) AS (VALUES ('train', 80), ('calibration', 20), ('test', 40)) "
        "SELECT coalesce(c.split, e.split) AS split, coalesce(n, 0) AS n, CAST(coalesce(expected, 0) AS BIGINT) AS expected FROM c FULL JOIN e ON c.split = e.split WHERE coalesce(n, 0) <> coalesce(expected, 0)",
        "capped_parse": with_pred(
            f"cp AS (SELECT *, doc_id % 4 = 1 AS capped, regexp_full_match(completion, '{form}') AS fits FROM pred WHERE condition = 'original')",
            f"""SELECT doc_id, method, fits AND NOT capped AS valid, CASE WHEN fits AND NOT capped THEN regexp_extract(completion, '{form}', 1) END AS answer,
            CASE WHEN fits AND NOT capped THEN CAST(regexp_extract(completion, '{form}', 2) AS INT) END AS stated,
            CASE WHEN capped THEN 'generation_max_new_tokens_reached' WHEN fits THEN NULL WHEN completion = '' THEN 'empty_completion'
            WHEN NOT (starts_with(completion, ' Yes' || chr(10)) OR starts_with(completion, ' No' || chr(10))) THEN 'answer_line_invalid'
            WHEN NOT contains(completion, chr(10) || 'Confidence: ') THEN 'confidence_line_missing' ELSE 'format_mismatch' END AS reason FROM cp""",
        ),
        "stored_row_differences": with_pred("", """SELECT CASE WHEN d.sign < 0 THEN -doc_id ELSE doc_id END AS doc_id, condition,
            CASE WHEN d.sign < 0 THEN 'unknown' WHEN doc_id % 40 = 3 THEN 'missing' WHEN doc_id % 70 = 13 THEN 'repeated' ELSE 'different' END AS kind
            FROM ev, (VALUES (1), (-1)) d(sign) WHERE method = 'baseline' AND ((d.sign > 0 AND (doc_id % 40 = 3 OR doc_id % 70 = 13 OR doc_id % 50 = 7)) OR (d.sign < 0 AND doc_id % 60 = 11 AND doc_id % 40 <> 3))"""),
        "frozen_order": "SELECT doc_id FROM labels WHERE doc_id % 30 = 9",
        "padded_batches": """WITH n AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE doc_id % 9 + 1 END AS n FROM labels), k AS (SELECT doc_id, n, least(n, 6) AS k FROM n)
            SELECT doc_id, array_to_string(list_concat(list_transform(range(6 - k), lambda i: 99), list_transform(range(n - k + 1, n + 1), lambda i: (doc_id * 7 + i) % 50)), ',') AS ids,
            array_to_string(list_concat(list_transform(range(6 - k), lambda i: 0), list_transform(range(k), lambda i: 1)), ',') AS mask,
            array_to_string(list_concat(list_transform(range(6 - k), lambda i: 0), range(k)), ',') AS positions, CAST(CASE WHEN k > 0 THEN 5 END AS INT) AS last FROM k""",
        "exact_prefixes": f"WITH {_INPUTS}, w AS (SELECT doc_id, {_words('passage')} AS w FROM inp) SELECT doc_id, CASE WHEN len(w) > 0 THEN sha256(array_to_string(w[1:(len(w) + 1) // 2], ' ')) END AS sha, "
        "CAST(CASE WHEN len(w) > 0 THEN (len(w) + 1) // 2 END AS INT) AS kept, CAST(CASE WHEN len(w) > 0 THEN len(w) END AS INT) AS whole FROM w",
        "dependent_seeds": "SELECT 'digest' AS kind, sha256('seed_1') AS value, CAST(2 AS BIGINT) AS n",
        "key_differences": "SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'right' ELSE 'left' END AS side FROM labels WHERE doc_id % 50 IN (7, 11)",
        "trimmed_ids": "WITH x AS (SELECT doc_id, i, (doc_id * 31 + i * doc_id * 17 + i * i) % 11 AS v FROM labels, range(1, 13) r(i)), e AS (SELECT doc_id, min(CASE WHEN v IN (3, 5) THEN i END) AS stop FROM x GROUP BY 1) "
        "SELECT doc_id, count(*) FILTER (stop IS NULL OR i < stop) AS n, coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) FILTER (stop IS NULL OR i < stop), '') AS ids FROM x JOIN e USING (doc_id) GROUP BY 1",
        "source_slugs": "SELECT doc_id, regexp_replace(regexp_replace(lower('  Set / ' || source || ' (v1)'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS slug FROM documents",
        "turn_gaps": "WITH t AS (SELECT conv_id, turn FROM conversations WHERE NOT (conv_id % 40 = 3 AND turn = 1)) SELECT conv_id FROM t GROUP BY 1 HAVING min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*)",
        "duplicate_texts": "SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    }
