"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, forest, license_scan, lines, mixing, pii, quality, resample, substring, suffix, toxicity, warc
from .store import cut, table

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.clusters(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents")).drop("lang", "source", "n_chars")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("clean_text")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.train(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    out = codes.by_label(cut(coded))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_decontamination, op4_minhash_forest, op5_mixing, op6_toxicity, op7_pii, op8_suffix_array, op9_substring, op10_warc, op11_resampling, op12_vector_codes, op13_line_dedup)}


def _op1() -> str:
    rows = []
    for name, text in license_scan.TEMPLATES:
        g = license_scan.grams(license_scan.normal(text))
        lo, hi = license_scan.bounds(len(g), license_scan.THRESHOLD)
        rows.append(f"('{name}', {len(g)}, {lo}, {hi}, [{', '.join(repr(x) for x in g)}])")
    return rf"""
WITH t(license_id, n, lo, hi, g) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '{license_scan.BLANK}'), [text]))) AS u FROM d),
w AS (SELECT r, doc_id, u, list_filter(regexp_split_to_array(lower(u), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM u),
b AS (SELECT r, doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b, len(b) AS s FROM w WHERE len(w) > 1),
m AS (SELECT r, doc_id, u, license_id, max(2.0::DOUBLE * len(list_intersect(g, b)) / (n + s)) AS dice FROM b JOIN t ON s BETWEEN lo AND hi GROUP BY ALL)
SELECT doc_id, license_id, max(dice) AS dice, count(*)::BIGINT AS n_units FROM m WHERE dice >= {license_scan.THRESHOLD} GROUP BY r, doc_id, license_id"""


def _op2() -> str:
    held = [f"contains(n, ' {p} ')::INT" for p in quality.BOILERPLATE]
    count, size = " + ".join(held), " + ".join(f"{len(p.split())} * {h}" for p, h in zip(quality.BOILERPLATE, held, strict=True))
    words = lambda x: f"len(list_filter(regexp_split_to_array({x}, '[\\x20\\x09-\\x0D]+'), lambda y: y <> ''))"
    # a blank after each separator may open the next: it is doubled, since there is no looking ahead here
    items = rf"len(regexp_extract_all(regexp_replace(l, '([\x20\x09])', '\1\1', 'g'), '[\x20\x09][{quality.SEPARATORS}]+[\x20\x09]'))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT r, doc_id, text, {WORDS} AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS ls FROM d),
k AS (SELECT r, unnest(range(1, greatest(len(w) - 3, 1))) AS i, w FROM a WHERE len(w) >= 5),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM k),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(5, coalesce(i - p, 5)))::BIGINT AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM t) GROUP BY r),
m AS (SELECT r, j, l, {items} AS k, ' ' || trim(regexp_replace(lower(l), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS n FROM (SELECT r, unnest(ls) AS l, unnest(range(len(ls))) AS j FROM a)),
l AS (SELECT r, j, l, (2 * (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) > length(l) - length(replace(l, ' ', '')) + 1
  OR 2 * (length(l) - length(replace(l, '!!', '!'))) > length(l) - length(replace(l, ' ', '')) + 1
  OR (k >= {quality.LEAST_SEPARATORS} AND {words("l")} - k <= {quality.ITEM_WORDS} * (k + 1))
  OR (length(l) <= {quality.PHRASE_CHARS} AND ({count} >= 2 OR ({count} = 1 AND 2 * ({size}) >= length(n) - length(replace(n, ' ', '')) - 1)))) AS bad FROM m),
b AS (SELECT r, sum(len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')))::BIGINT AS lost FROM l WHERE bad GROUP BY r),
s AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_words FROM a LEFT JOIN c USING (r) LEFT JOIN b USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_words <= floor({quality.MAX_LOST}::DOUBLE * n_words) AS kept, lost_words FROM f"""


def _op3() -> str:
    w = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    run = lambda k: f"list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))"
    return rf"""
WITH i AS (SELECT item_id, {w} AS w FROM benchmark), j AS (SELECT item_id, w, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
q AS (SELECT item_id, k, s, count(*) OVER (PARTITION BY item_id) AS n FROM (SELECT DISTINCT item_id, k, unnest({run("k")}) AS s FROM j)),
d AS (SELECT row_number() OVER () AS r, doc_id, {w} AS w FROM documents),
x AS (SELECT DISTINCT r, doc_id, k, unnest({run("k")}) AS s FROM d CROSS JOIN (SELECT DISTINCT k FROM q) WHERE len(w) >= k),
m AS (SELECT r, doc_id, item_id, n, count(*) AS c FROM x JOIN q USING (k, s) GROUP BY ALL HAVING count(*) >= {decontam.THRESHOLD} * n - 1e-9)
SELECT doc_id, item_id, max(c)::BIGINT AS n_shared, any_value(n)::BIGINT AS n_item, max(c::DOUBLE / n) AS containment FROM m GROUP BY doc_id, item_id"""


OP5 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, len({WORDS})::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
o AS (SELECT source, s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM p),
z AS (SELECT *, 3.0 * s / w AS ratio, sum(s) OVER () AS total FROM o),
h AS (SELECT *, total - 3 * coalesce(sum(s) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS den FROM z
  WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rest, den FROM h WHERE (w * rest)::DOUBLE / den::DOUBLE <= 3 * s ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, s, CASE WHEN (w * l.rest)::DOUBLE / l.den::DOUBLE > 3 * s THEN (3 * s)::DOUBLE ELSE (w * l.rest)::DOUBLE / l.den::DOUBLE END AS target FROM o CROSS JOIN l),
e AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), 3)::BIGINT ELSE 0 END AS e FROM t),
c AS (SELECT d.*, s, target, e, floor(target - e * s)::BIGINT AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, s AS source_size, target, (e * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM c"""


OP4 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
e AS (SELECT r, unnest(s) AS g FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN s x ON x.r = p.a JOIN s y ON y.r = p.b WHERE 100 * n >= {forest.PERCENT} * (len(x.s) + len(y.s) - n)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(r, q) AS (SELECT r, r FROM s UNION SELECT c.r, m.b FROM c JOIN m ON m.a = c.q),
k AS (SELECT c.r, min(t.doc_id) AS component_id FROM c JOIN s t ON t.r = c.q GROUP BY c.r)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN k USING (r)"""

OP10 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= {warc.REVISIT_BYTES}) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM t"""


OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY md5(g)) AS n FROM g) WHERE n > 1),
b AS (SELECT r, list(i) AS s FROM (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM t) GROUP BY r),
k AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(s), 0)::BIGINT AS n_removed,
  CASE WHEN s IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(s, x[2])), lambda x: x[1]) END AS k FROM d LEFT JOIN b USING (r))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM k"""


#: Bytes as pairs of hexadecimal digits; windows are taken from chunks, since a long text's middle is dear to reach.
OP8 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT r, doc_id, h, length(h) // 2 AS n FROM d),
k AS (SELECT r, a, n, substr(h, 2 * a + 1, 2 * 1199) AS s FROM (SELECT r, h, n, unnest(range(0, greatest(n - 199, 0), 1000)) AS a FROM n)),
w AS (SELECT r, a + i AS i, md5(substr(s, 2 * i + 1, 400)) AS g FROM (SELECT r, a, s, unnest(range(0, least(1000, n - 199 - a))) AS i FROM k)),
t AS (SELECT r, i FROM w JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)),
b AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM t),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM b) GROUP BY r, run),
p AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM s),
q AS (SELECT r, count(*) AS spans, sum(z - a) AS removed, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS k, max(z) AS past FROM p JOIN n USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN past IS NULL THEN h ELSE k || substr(h, 2 * past + 1) END)) AS kept_sha256 FROM n LEFT JOIN q USING (r)"""


#: The check sum's table by its rule, bytes as pairs of hexadecimal digits.
OP11 = rf"""
WITH t AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1))) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
x AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{resample.UPPER}', '{resample.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM x),
f AS (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
c AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {resample.BUCKETS} AS b FROM u CROSS JOIN t),
g AS (SELECT side, r, b FROM f JOIN c USING (f)),
n AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM g GROUP BY b),
z AS (SELECT sum(s)::DOUBLE + {resample.BUCKETS} AS s, sum(t)::DOUBLE + {resample.BUCKETS} AS t FROM n),
l AS (SELECT b, floor(1000 * ln(((n.t + 1)::DOUBLE * z.s) / ((n.s + 1)::DOUBLE * z.t)))::BIGINT AS gain FROM n CROSS JOIN z),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM g JOIN l USING (b) WHERE side = 0 GROUP BY r),
k AS (SELECT doc_id, len(w) AS n, (len(w) + greatest(len(w) - 1, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('{resample.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (r) WHERE side = 0),
o AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS score, n >= {resample.LEAST_WORDS} AS may FROM k),
p AS (SELECT *, CASE WHEN may THEN row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id NULLS FIRST) END AS p, count(*) FILTER (may) OVER () AS total FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= {resample.PERCENT} * total // 100 THEN p::BIGINT END AS rank FROM p"""


def _op12() -> str:
    per = f"(len(x) // {codes.PARTS})"
    out = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, p, x[p * {per} + 1:(p + 1) * {per}] AS x FROM v, (SELECT unnest(range({codes.PARTS})) AS p))",
        f"c0 AS MATERIALIZED (SELECT p, e, p.x AS y FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM v ORDER BY vec_id, x LIMIT {codes.ENTRIES}) USING (r))",
    ]
    for i in range(codes.ROUNDS + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT r, p, e, d, x FROM (SELECT r, p.p, e, x, d, row_number() OVER (PARTITION BY r, p.p ORDER BY d, e) AS k
  FROM (SELECT r, p.p, e, x, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{i} USING (p)) AS p) WHERE k = 1)""")
        out.append(f"""c{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, y) AS y FROM c{i} LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS m FROM (SELECT p, e, j, floor(sum(v)::DOUBLE / count(*))::BIGINT AS m
  FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS j FROM a{i}) GROUP BY p, e, j) GROUP BY p, e) USING (p, e))""")
    return f"""WITH {", ".join(out[:-1])},
s AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{codes.ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS h FROM c{codes.ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN s USING (r) CROSS JOIN h"""


OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, j, l, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{resample.UPPER}', '{resample.LOWER}') AS k FROM (SELECT r, unnest(ls) AS l, unnest(range(len(ls))) AS j FROM d)),
f AS (SELECT k FROM l WHERE length(k) >= {lines.LEAST_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {lines.LEAST_DOCS}),
k AS (SELECT r, count(*) FILTER (f.k IS NOT NULL) AS n, string_agg(l, chr(10) ORDER BY j) FILTER (f.k IS NULL) AS t FROM l LEFT JOIN f USING (k) GROUP BY r)
SELECT doc_id, len(ls)::BIGINT AS n_lines, n::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d JOIN k USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1(), "op2_quality_rules": _op2(), "op3_decontamination": _op3(), "op4_minhash_forest": OP4, "op5_mixing": OP5, "op8_suffix_array": OP8, "op9_substring": OP9, "op10_warc": OP10, "op11_resampling": OP11, "op12_vector_codes": _op12(), "op13_line_dedup": OP13}
