"""DuckDB SQL with the rows of those operators' queries that SQL can express."""

from __future__ import annotations

from tidewatch.llm import quality_rules

WHITE = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{WHITE}'), lambda w: w <> '')"


def _components(nodes: str, links: str) -> str:
    """CTEs reach and component (node, component) from tables nodes (node) and links (a, b), each link once."""
    return f"""
    ends AS (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}),
    reach(a, b) AS (SELECT a, b FROM ends UNION SELECT r.a, l.b FROM reach r JOIN ends l ON r.b = l.a),
    component AS (SELECT n.node, least(n.node, coalesce(min(r.b), n.node)) AS component FROM {nodes} n LEFT JOIN reach r ON r.a = n.node GROUP BY n.node)"""


SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS text, count(*) AS n FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
    FROM d
),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets),
links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM each x JOIN each y ON x.k = y.k AND x.doc_id < y.doc_id
    WHERE 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
    GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
nodes AS (SELECT doc_id AS node FROM d), {_components("nodes", "links")}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component AS component_id FROM sets JOIN component ON node = doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
usable AS (
    SELECT *, list_inner_product(x, x) AS square FROM v
    WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
),
links AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x)
    WHERE list_inner_product(p.x, q.x) / sqrt(p.square * q.square) >= 0.93
),
nodes AS (SELECT vec_id AS node FROM v), {_components("nodes", "links")},
counts AS (SELECT a, count(*) AS n FROM ends GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component AS component_id, vec_id = component AS kept
FROM v JOIN component ON node = vec_id LEFT JOIN counts ON a = vec_id
"""

#: The checksum is worked out byte by byte, once for each distinct feature.
IMPORTANCE = """
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
own AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
target AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
hexed AS (SELECT f, hex(f) AS h FROM (SELECT f FROM own UNION SELECT f FROM target)),
bytes AS (SELECT f, list_transform(range(1, len(h), 2), lambda i: (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1) AS x FROM hexed),
bucket AS (SELECT f, xor(list_reduce(list_concat([4294967295], x), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k FROM bytes, crc),
seen AS (SELECT k, count(*) AS s FROM own JOIN bucket USING (f) GROUP BY k),
wanted AS (SELECT k, count(*) AS t FROM target JOIN bucket USING (f) GROUP BY k),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM seen)::DOUBLE AS s, (SELECT coalesce(sum(t), 0) FROM wanted)::DOUBLE AS t),
gain AS (
    SELECT k, floor(1000 * ln(((coalesce(wanted.t, 0) + 1)::DOUBLE * (totals.s + 10000)) / ((coalesce(seen.s, 0) + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS g
    FROM (SELECT unnest(range(10000)) AS k) LEFT JOIN seen USING (k) LEFT JOIN wanted USING (k), totals
),
sums AS (SELECT r, count(*)::BIGINT AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN bucket USING (f) JOIN gain USING (k) GROUP BY r),
scored AS (
    SELECT d.r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        list_reduce(list_concat([0::BIGINT], list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', sha256('7:' || coalesce(doc_id::VARCHAR, ''))[i]) - 1)), lambda a, c: a * 16 + c) AS h
    FROM d LEFT JOIN sums ON sums.r = d.r
),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM scored),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_words DESC) AS place, count(*) OVER () AS n FROM noisy WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM noisy LEFT JOIN placed ON placed.r = noisy.r
"""


def quality() -> str:
    """The rules' features and votes, the estimation as a recursive query, and the verdicts."""
    k = len(quality_rules.RULES)

    def vote(feature: str, good_from: float, good_to: float, bad_below: float, bad_above: float) -> str:
        top, bottom = feature.split(" / ")
        x = f"({top}::DOUBLE / nullif({bottom}, 0))"
        return f"CASE WHEN {x} < {bad_below} OR {x} > {bad_above} THEN -1 WHEN {x} >= {good_from} AND {x} <= {good_to} THEN 1 ELSE 0 END"

    def odds(votes: str, of: str) -> str:
        each = f"CASE WHEN {votes}[j] = 1 THEN ln({of}.good[j] / (1 - {of}.bad[j])) WHEN {votes}[j] = -1 THEN ln((1 - {of}.good[j]) / {of}.bad[j]) ELSE 0.0::DOUBLE END"
        return f"(ln({of}.prior / (1 - {of}.prior)) + list_sum(list_transform(range(1, {k + 1}), lambda j: {each})))"

    def share(right: int, weight: str, guess: float) -> str:
        hit, voted = (f"coalesce(list_sum(list_transform(list_filter(e, lambda x: {test}), lambda x: x.n * {weight})), 0)" for test in (f"x.v[j] = {right}", "x.v[j] <> 0"))
        return f"list_transform(range(1, {k + 1}), lambda j: ({hit} + {quality_rules.SMOOTH * guess}) / ({voted} + {quality_rules.SMOOTH}))"

    s = quality_rules.SMOOTH
    lists = [f"list_transform(range({k}), lambda j: {x}::DOUBLE)" for x in (quality_rules.RIGHT_GOOD, quality_rules.RIGHT_BAD)]
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_words("text")} AS w FROM documents),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
runs AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM runs WHERE n > 1) GROUP BY r),
features AS (
    SELECT d.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '\\p{{Lu}}'))::BIGINT AS n_capitals,
        len(regexp_extract_all(t, '[.!?]'))::BIGINT AS n_marks, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(again.n, 0)::BIGINT AS n_repeat_words
    FROM d JOIN lines ON lines.r = d.r LEFT JOIN again ON again.r = d.r
),
voted AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{", ".join(vote(*rule[1:]) for rule in quality_rules.RULES)}] AS v FROM features),
patterns AS (SELECT coalesce(list(struct_pack(v := v, n := n)), []) AS p FROM (SELECT v, count(*)::DOUBLE AS n FROM voted WHERE NOT base_failed GROUP BY v ORDER BY v)),
em(i, m) AS (
    SELECT 0, struct_pack(prior := {quality_rules.PRIOR}::DOUBLE, good := {lists[0]}, bad := {lists[1]})
    UNION ALL
    SELECT i + 1, struct_pack(
        prior := (coalesce(list_sum(list_transform(e, lambda x: x.n * x.q)), 0) + {s * quality_rules.PRIOR}) / (coalesce(list_sum(list_transform(e, lambda x: x.n)), 0) + {s}),
        good := {share(1, "x.q", quality_rules.RIGHT_GOOD)}, bad := {share(-1, "(1 - x.q)", quality_rules.RIGHT_BAD)})
    FROM (SELECT i, list_transform(p, lambda x: struct_pack(v := x.v, n := x.n, q := 1 / (1 + exp(-{odds("x.v", "m")})))) AS e FROM em, patterns WHERE i < {quality_rules.ROUNDS})
),
rated AS (SELECT voted.*, 1 / (1 + exp(-{odds("v", "m")})) AS q FROM voted, em WHERE i = {quality_rules.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept, round(q, 6) AS posterior FROM rated
"""
