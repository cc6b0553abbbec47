"""DuckDB SQL of the URL filter, the conversation repair and the resampling."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: CRC-32 by bytes: a table of 256 steps made by rule, then one step for each byte of each distinct text.
_CRC_STEPS = """
    crc_steps AS (
        SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step
        FROM (SELECT unnest(range(256)) AS i)
    )
"""


def _crc(text: str) -> str:
    """The CRC-32 of a text; ``step`` of crc_steps must be in scope."""
    byte = f"CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT)"
    bytes_ = f"list_transform(range(strlen({text})), lambda i: {byte})"
    return f"xor(list_reduce(list_concat([4294967295], {bytes_}), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295)"


def url_filter(rules: list[tuple[str, str]], suffixes: tuple[str, ...], limit: float, deviations: float) -> str:
    whens = {"rule": "", "ruled": ""}
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, path = rule.split("/", 1)
        test = f"(host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '/{path}')"
        whens["rule"] += f" WHEN {test} THEN '{rule}'"
        whens["ruled"] += f" WHEN {test} THEN '{verdict}'"
    bare = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')"
    last = lambda n: f"array_to_string(list_slice(string_split(bare, '.'), greatest(len(string_split(bare, '.')) - {n - 1}, 1), len(string_split(bare, '.'))), '.')"
    address = r"regexp_matches(bare, '^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\[')"
    known = ", ".join(f"'{s}'" for s in suffixes)

    def level(name: str, groups: str) -> str:
        """The same shrinkage at each level: ``groups`` has a key, n, bad, prior and spread."""
        return f"""
            {name}_in AS ({groups}),
            {name}_fit AS (
                SELECT 1 / least(0.99, greatest(0.01, CASE WHEN sum(prior * (1 - prior) * (n - 1)) > 0
                    THEN sum(n * pow(bad / n - prior, 2) - prior * (1 - prior)) / sum(prior * (1 - prior) * (n - 1)) ELSE 0.5 END)) - 1 AS weight
                FROM {name}_in WHERE n > 0
            ),
            {name}_mean AS (SELECT *, (bad + weight * prior) / (n + weight) AS mean FROM {name}_in, {name}_fit),
            {name} AS (SELECT *, mean * (1 - mean) / (n + weight + 1) + pow(weight / (n + weight), 2) * spread AS variance FROM {name}_mean)
        """

    return f"""
        WITH read AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_LOWER}), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ),
        found AS (SELECT *, CASE{whens["rule"]} END AS rule, CASE{whens["ruled"]} END AS ruled FROM read),
        bares AS (SELECT host, {bare} AS bare, count(ruled) AS n, count(*) FILTER (WHERE ruled = 'block') AS bad FROM found GROUP BY 1, 2),
        parts AS (
            SELECT *, CASE WHEN {address} THEN bare WHEN {last(2)} IN ({known}) THEN {last(3)} ELSE {last(2)} END AS domain,
                   CASE WHEN {address} THEN bare WHEN {last(2)} IN ({known}) THEN {last(2)} ELSE {last(1)} END AS suffix
            FROM bares
        ),
        top AS (SELECT prior, prior * (1 - prior) / (n + 3) AS spread FROM (SELECT (sum(bad) + 1) / (sum(n) + 2) AS prior, sum(n) AS n FROM parts)),
        {level("suffixes", "SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(top.prior) AS prior, any_value(top.spread) AS spread FROM parts, top GROUP BY 1")},
        {level("domains", '''SELECT p.domain, sum(p.n) AS n, sum(p.bad) AS bad, any_value(s.mean) AS prior, any_value(s.variance) AS spread
                             FROM parts p JOIN suffixes s ON p.suffix = s.suffix GROUP BY 1''')},
        {level("hosts", "SELECT p.host, p.n, p.bad, d.mean AS prior, d.variance AS spread FROM parts p JOIN domains d ON p.domain = d.domain")},
        bounds AS (SELECT host, n, bad, mean - {deviations} * sqrt(variance) AS bound FROM hosts)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bound > {limit} THEN 'block' ELSE 'allow' END) AS verdict,
               CAST(n AS BIGINT) AS outcomes, CAST(bad AS BIGINT) AS blocked, round(bound, 4) AS bound
        FROM found JOIN bounds USING (host)
    """


def conversations() -> str:
    """Damage, faults, then the states of all conversations turn by turn."""
    word = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    last = "rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    move = lambda e, cost, edit, line: f"CASE WHEN {e} IS NOT NULL THEN {{'c': {e}.c + {cost}, 'a': {e}.a || '{edit}', 't': {e}.t || {line}}} END"
    insert = lambda e, role: move(e, 2, "I", f"chr(10) || '{role}:'")
    delete = lambda e: move(e, 3, "D", "''")
    stays = "mark NOT IN ('blank', 'duplicate')"

    def edited(e: str, role: str) -> str:
        """A turn kept in, or given, a role of the initial of ``role``."""
        kept = move(e, "extra", "K", "chr(10) || role || ':' || text")
        given = move(e, "2 + extra", "R", f"chr(10) || '{role}:' || text")
        if role == "system":
            return f"CASE WHEN {stays} AND initial = 's' THEN {kept} END"
        return f"CASE WHEN {stays} THEN CASE WHEN initial = '{role[0]}' THEN {kept} ELSE {given} END END"

    element = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    least = lambda *es: f"list_min([{', '.join(es)}])"

    def closed(inner: str, keys: str) -> str:
        """Inserted turns after the states s0 to s3."""
        return f"""
            SELECT {keys}, s0, s1, u AS s2, {least('s3', insert('u', 'assistant'))} AS s3
            FROM (SELECT *, {least('s2', insert('s0', 'user'), insert('s1', 'user'), insert('s3', 'user'))} AS u FROM ({inner}))
        """

    start = f"SELECT conv_id, 0 AS k, CAST({{'c': 0, 'a': '', 't': ''}} AS {element}) AS s0, CAST(NULL AS {element}) AS s1, CAST(NULL AS {element}) AS s2, CAST(NULL AS {element}) AS s3 FROM conv"
    step = f"""
        SELECT w.conv_id, w.k + 1 AS k, {delete('s0')} AS s0, {least(delete('s1'), edited('s0', 'system'))} AS s1,
               {least(delete('s2'), edited('s0', 'user'), edited('s1', 'user'), edited('s3', 'user'))} AS s2, {least(delete('s3'), edited('s2', 'assistant'))} AS s3
        FROM w JOIN marked m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.n = w.k + 1
    """
    return f"""
        WITH RECURSIVE {_CRC_STEPS},
        keyed AS (SELECT *, {word('conv_id')} || ':' || {word('turn')} AS key FROM conversations),
        hashed AS (SELECT key, {_crc('key')} % 20 AS kind FROM (SELECT DISTINCT key FROM keyed), crc_steps),
        hurt AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE {word('role')} END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate({word('text')}, '.!?', '') ELSE {word('text')} END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again
            FROM keyed JOIN hashed USING (key)
        ),
        turns AS (
            SELECT *, left(role, 1) AS initial,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text), again) AS n
            FROM hurt
        ),
        judged AS (
            SELECT *, CASE WHEN {last} = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                           WHEN right({last}, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS mark,
                   lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair
            FROM turns
        ),
        marked AS (SELECT *, CASE WHEN mark = 'truncated' THEN 1 ELSE 0 END AS extra FROM judged),
        conv AS (SELECT DISTINCT conv_id FROM conversations),
        counts AS (
            SELECT c.conv_id, count(m.n) AS rows, coalesce(max(m.turn) - min(m.turn) + 1 - count(DISTINCT m.turn), 0) AS gaps, count(*) FILTER (WHERE mark = 'blank') AS blank,
                   count(*) FILTER (WHERE mark = 'duplicate') AS duplicate, count(*) FILTER (WHERE mark = 'truncated') AS truncated,
                   count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM conv c LEFT JOIN marked m ON c.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY c.conv_id
        ),
        w AS ({closed(start, 'conv_id, k')} UNION ALL {closed(step, 'conv_id, k')}),
        ended AS (SELECT c.*, {least('s0', 's3')} AS best FROM counts c JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.k = c.rows)
        SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated,
               CAST(illegal AS BIGINT) AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
        FROM ended
    """


def resampling(percent: int, least_words: int, seed: int, buckets: int) -> str:
    words = rf"regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH {_CRC_STEPS},
        docs AS (SELECT row_number() OVER () AS row, doc_id, unnest(coalesce({words}, [])) AS word FROM documents),
        target AS (SELECT unnest(coalesce({words}, [])) AS word FROM benchmark),
        buckets AS (SELECT word, {_crc('word')} % {buckets} AS bucket FROM (SELECT word FROM docs UNION SELECT word FROM target), crc_steps),
        s AS (SELECT bucket, count(*) AS n FROM docs JOIN buckets USING (word) GROUP BY 1),
        t AS (SELECT bucket, count(*) AS n FROM target JOIN buckets USING (word) GROUP BY 1),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets}.0::DOUBLE)
                / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets}.0::DOUBLE)))) AS BIGINT) AS gain
            FROM s FULL JOIN t USING (bucket)
        ),
        weights AS (SELECT row, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM docs JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY 1),
        scored AS (
            SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) LEFT JOIN weights USING (row)
        ),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
                   {percent} * count(*) FILTER (WHERE n_features >= {least_words}) OVER () // 100 AS most
            FROM scored
        )
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= {least_words} AND place <= most THEN place END AS rank
        FROM placed
    """
