"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contextmix, decontaminate, flac, jaccard, licenses, mixing, negatives, substrings, toolcalls, toxicity, urlgraph, warc, whitening
from .common import fold, read, scratch


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence notices."""
    return licenses.judge(read(spark, sf_dir, "documents"), licenses.templates(spark))


def op9_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a tool call with its result."""
    schemas = spark.createDataFrame([("reply", "text", "string", True), ("reply", "turn", "integer", True)], "tool string, field string, type string, required boolean")
    calls, results = toolcalls.from_turns(read(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, schemas)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class."""
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload"))
    back = warc.store_and_read(pages, scratch(spark, "warc"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op2_contextmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the model of the nine training folds of ten."""
    docs = read(spark, sf_dir, "documents")
    return contextmix.score(docs, contextmix.learn(docs.filter(fold(folds=10) != 0)))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word passages that start earlier."""
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's uses in a mixture of 97 % of the largest entropy, no source read more than four times."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontaminate.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored FLAC stream, read back, decoded and described."""
    return flac.read_media(flac.store(flac.to_media(read(spark, sf_dir, "documents"))))


#: the rules of op13: host, path, action
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor's hard negatives among all rows; of every seventh row the label is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.prepared(read(spark, sf_dir, "embeddings"), label=label))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four whitened components."""
    rows = read(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit(rows))


def op13_urlgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by the rules, or by its host's trust and distrust."""
    return urlgraph.judge(read(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {"op1_toxicity": op1_toxicity, "op2_contextmix": op2_contextmix, "op3_substrings": op3_substrings, "op4_mixing": op4_mixing, "op5_flac": op5_flac, "op6_decontaminate": op6_decontaminate, "op7_licenses": op7_licenses, "op8_jaccard": op8_jaccard, "op9_toolcalls": op9_toolcalls, "op10_warc": op10_warc, "op11_negatives": op11_negatives, "op12_whitening": op12_whitening, "op13_urlgraph": op13_urlgraph}

_OP6 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item, w[s : s + 9] AS words, array_to_string(w[s : s + 9], ' ') AS win, least(len(w), 10) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS items_sha256 FROM hit GROUP BY doc_id),
o AS MATERIALIZED (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM d),
c AS (SELECT term, count(*) AS k FROM o GROUP BY term),
a AS MATERIALIZED (SELECT item, words, arg_min(term, (k, term)) AS term FROM (SELECT item, words, t.term, coalesce(k, 0) AS k FROM (SELECT item, words, unnest(words) AS term FROM bw) t LEFT JOIN c ON t.term = c.term) GROUP BY item, words),
nr AS (SELECT o.doc_id, count(DISTINCT a.item) AS n_near FROM o JOIN a USING (term) JOIN d USING (doc_id) WHERE list_has_all(d.w[greatest(o.p - 9, 1) : o.p + 9], a.words) GROUP BY o.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nr USING (doc_id)
"""

_OP4 = r"""
WITH RECURSIVE sized AS MATERIALIZED (SELECT doc_id, source, coalesce('s' || source, 'n') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
sources AS MATERIALIZED (SELECT key, CAST(sum(n_tokens) AS DOUBLE) AS t, ln(sum(n_tokens)) - ln(max(sum(n_tokens)) OVER ()) AS l FROM sized GROUP BY key HAVING sum(n_tokens) > 0),
be AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL
  SELECT i + 1, CASE WHEN ok THEN m ELSE lo END, CASE WHEN ok THEN hi ELSE m END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m, (SELECT ln(sum(exp((lo + hi) / 2 * l))) - sum(exp((lo + hi) / 2 * l) * (lo + hi) / 2 * l) / sum(exp((lo + hi) / 2 * l)) >= 0.97 * ln(count(*)) - 1e-12 FROM sources) AS ok FROM be WHERE i < 24)),
br AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m, (SELECT max(t / exp((lo + hi) / 2 * l)) * max(exp((lo + hi) / 2 * l) / t) <= 4.0 + 1e-9 FROM sources) AS ok FROM br WHERE i < 24)),
a AS MATERIALIZED (SELECT round(greatest((SELECT CASE WHEN (SELECT -sum(t / z * ln(t / z)) >= 0.97 * ln(count(*)) - 1e-12 FROM (SELECT t, sum(t) OVER () AS z FROM sources)) THEN 1 ELSE lo END FROM be WHERE i = 24), (SELECT CASE WHEN (SELECT max(t) / min(t) <= 4.0 + 1e-9 FROM sources) THEN 0 ELSE hi END FROM br WHERE i = 24)), 6) AS alpha),
w AS (SELECT key, t, exp(alpha * l) AS p, alpha FROM sources, a),
planned AS MATERIALIZED (SELECT key, CAST(t AS BIGINT) AS t, alpha, p / (SELECT sum(p) FROM w) AS weight, CAST(floor((SELECT max(t / p) FROM w) * p + 0.001) AS BIGINT) AS budget FROM w),
used AS (SELECT s.doc_id, s.source, s.key, s.n_tokens, p.alpha, p.weight, p.budget, p.budget // p.t AS fulls, p.budget % p.t AS rest, unnest(range(0, CASE WHEN s.n_tokens = 0 THEN 1 WHEN p.budget % p.t > 0 THEN p.budget // p.t + 1 ELSE p.budget // p.t END)) AS epoch FROM sized s JOIN planned p USING (key)),
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY key, epoch ORDER BY md5(doc_id || ':' || epoch || ':0'), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tokens_before FROM used)
SELECT doc_id, source, n_tokens, epoch, CAST(tokens_before // 1048576 AS BIGINT) AS block, md5(key || ':' || epoch || ':' || CAST(tokens_before // 1048576 AS BIGINT) || ':0') AS block_key, CAST(tokens_before AS BIGINT) AS tokens_before, alpha, weight, budget AS budget_tokens
FROM placed WHERE epoch < fulls OR tokens_before < rest OR n_tokens = 0
"""

_TEMPLATES = ", ".join("('%s', '%s')" % (k, t.replace("'", "''")) for k, t in licenses.known_templates())

_OP7 = rf"""
WITH t AS (SELECT license_id, template, list_filter(regexp_split_to_array(translate(template, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM (VALUES {_TEMPLATES}) v(license_id, template)),
tg AS (SELECT DISTINCT license_id, template, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT license_id, template, w, unnest(range(1, len(w))) AS i FROM t)),
tb AS (SELECT license_id, template, gram, count(*) OVER (PARTITION BY license_id, template) AS b FROM tg),
p AS (SELECT doc_id, string_split_regex(text, '\n\n+') AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, 'l' || unnest(range(len(string_split(text, chr(10))))) AS unit, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, unit, x FROM (SELECT doc_id, 'p' || unnest(range(len(parts))) AS unit, unnest(parts) AS x FROM p) WHERE contains(x, chr(10))
  UNION ALL SELECT doc_id, 'w', text FROM documents WHERE contains(text, chr(10) || chr(10))),
u AS (SELECT doc_id, unit, list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda y: y <> '') AS w FROM l),
ug AS (SELECT DISTINCT doc_id, unit, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, unit, w, unnest(range(1, len(w))) AS i FROM u)),
ub AS (SELECT doc_id, unit, gram, count(*) OVER (PARTITION BY doc_id, unit) AS a FROM ug),
m AS (SELECT doc_id, unit, license_id, round(2 * count(*) / (a + b), 6) AS dice FROM ub JOIN tb USING (gram) GROUP BY doc_id, unit, a, license_id, template, b HAVING round(2 * count(*) / (a + b), 6) >= 0.9),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license_id) AS k FROM m),
q AS (SELECT doc_id, count(*) AS n_matches, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS licenses, arg_min(license_id, (-dice, license_id)) AS best_license, max(dice) AS best_dice FROM r WHERE k = 1 GROUP BY doc_id)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, best_license, best_dice FROM documents LEFT JOIN q USING (doc_id)
"""

_OP9 = r"""
WITH RECURSIVE c AS MATERIALIZED (SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id, text, CASE WHEN length(text) % 3 = 0 THEN turn + 2 WHEN turn >= 2 THEN turn - 2 END AS need FROM conversations WHERE role = 'user'),
e AS MATERIALIZED (SELECT c.conv_id, c.turn, c.need, d.turn IS NULL AS missing, d.need = c.turn AS ring FROM c LEFT JOIN c d ON d.conv_id = c.conv_id AND d.turn = c.need WHERE c.need IS NOT NULL),
walk AS (SELECT conv_id, turn, turn AS here, 0 AS steps FROM c UNION ALL SELECT walk.conv_id, walk.turn, e.need, steps + 1 FROM walk JOIN e ON e.conv_id = walk.conv_id AND e.turn = walk.here WHERE NOT e.missing AND NOT coalesce(e.ring, false)),
pos AS (SELECT conv_id, turn, max(here + steps) AS position FROM walk GROUP BY conv_id, turn),
r AS (SELECT 'call_' || conv_id || '_' || (turn - 1) AS call_id, arg_min(text, (turn, text)) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT c.conv_id, c.call_id, c.turn AS seq, pos.position, 'reply' AS name, c.text IS NOT NULL AS valid, coalesce(r.n, 0) AS n_results,
  CAST(CASE WHEN e.missing THEN 1 ELSE 0 END AS BIGINT) AS missing, coalesce(e.ring, false) AS cyclic, false AS repeated,
  '{"arguments":{"text":' || coalesce(CAST(to_json(c.text) AS VARCHAR), 'null') || ',"turn":' || c.turn || '},"id":"' || c.call_id || '","name":"reply","result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS json
FROM c JOIN pos ON pos.conv_id = c.conv_id AND pos.turn = c.turn LEFT JOIN e ON e.conv_id = c.conv_id AND e.turn = c.turn LEFT JOIN r ON r.call_id = c.call_id
"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP3 = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
again AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM again),
each AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_OP8 = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) m USING (doc_id)
"""

_OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST(('0x' || substr(h, CAST(i // 8 * 10 + 1 AS BIGINT), 10)) AS BIGINT) >> CAST(35 - i % 8 * 5 AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM m
"""

_OP11 = r"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY rank <= 10
"""


def _op13() -> str:
    rules = sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    case = lambda at: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{at(h + p, a)}'" for h, p, a in rules) + " END"
    low = lambda x: f"translate({x}, '{urlgraph.UPPER}', '{urlgraph.LOWER}')"
    anchor = urlgraph.ANCHOR.replace("'", "''")
    ranks = "".join(f", r{k + 1} AS MATERIALIZED (SELECT host, kind, sum(rank) AS rank FROM (SELECT s.dest AS host, kind, CAST(floor(r.rank * s.share) AS BIGINT) AS rank FROM r{k} r JOIN steps s USING (host, kind) UNION ALL SELECT host, kind, rank FROM r0) WHERE rank > 0 GROUP BY ALL)" for k in range(urlgraph.ROUNDS))
    return f"""
WITH a AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS MATERIALIZED (SELECT page_id, html, {low("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
j AS MATERIALIZED (SELECT *, {case(lambda rule, act: rule)} AS rule, {case(lambda rule, act: act)} AS action FROM h),
e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{anchor}', 1), lambda x: {low(f"regexp_extract(x, '{urlgraph.FAR}', 1)")}))) AS dst FROM h) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
steps AS MATERIALIZED (SELECT src AS host, 't' AS kind, dst AS dest, {urlgraph.DAMPING} * n / sum(n) OVER (PARTITION BY src) AS share FROM e UNION ALL SELECT dst, 'd', src, {urlgraph.DAMPING} * n / sum(n) OVER (PARTITION BY dst) FROM e),
r0 AS MATERIALIZED (SELECT host, CASE action WHEN 'allow' THEN 't' ELSE 'd' END AS kind, count(*) * {urlgraph.UNIT} AS rank FROM j WHERE action IS NOT NULL AND host <> '' GROUP BY ALL){ranks},
bad AS (SELECT host FROM (SELECT host, coalesce(sum(rank) FILTER (kind = 't'), 0) AS t, coalesce(sum(rank) FILTER (kind = 'd'), 0) AS d FROM r{urlgraph.ROUNDS} GROUP BY host) WHERE d > 0 AND d >= {urlgraph.BLOCK_AT} * (t + d))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""


ORACLES: dict[str, str] = {"op11_negatives": _OP11, "op13_urlgraph": _op13(), "op3_substrings": _OP3, "op8_jaccard": _OP8, "op10_warc": _OP10, "op7_licenses": _OP7.replace("\\\\", "\\"), "op9_toolcalls": _OP9, "op4_mixing": _OP4.replace("\\\\", "\\"), "op6_decontaminate": _OP6.replace("\\\\", "\\")}
