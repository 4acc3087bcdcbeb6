"""One registered query per operator, over its whole table and with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colonnade.llm import (
    fingerprints, html_text, lexical_search, licenses, mixing, near_copies, packing, pairwise_quality, rules, simhash, token_counts, turn_repair, url_filter,
)
from colonnade.llm.tokens import public_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1 = r"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
led AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text FROM docs
  WINDOW o AS (ORDER BY doc_id NULLS FIRST, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edits AS (SELECT *, length(text) // 2 AS half,
  substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM led),
bodies AS (SELECT DISTINCT text AS body FROM docs UNION SELECT edited FROM edits),
words AS (SELECT body, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM bodies),
runs AS (SELECT body, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' ')))
  WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END AS h FROM words),
prints AS (SELECT body, CASE WHEN len(list_distinct(h)) <= 128 THEN '1:' || coalesce(array_to_string(list_sort(list_distinct(list_transform(h, lambda x: x[1:16]))), ','), '')
  ELSE '8:' || coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(h, lambda x: x < '2'), lambda x: x[1:16]))), ','), '') END AS fp FROM runs),
three AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, a.fp AS x, b.fp AS y, c.fp AS z FROM edits
  JOIN prints a ON a.body = text JOIN prints b ON b.body = edited JOIN prints c ON c.body = next_text),
lists AS (SELECT *, list_filter(string_split(x[3:], ','), lambda h: h <> '') AS hx, list_filter(string_split(y[3:], ','), lambda h: h <> '') AS hy,
  list_filter(string_split(z[3:], ','), lambda h: h <> '') AS hz FROM three),
cut AS (SELECT *, CASE WHEN x[1] = '1' AND y[1] = '1' THEN hx ELSE list_filter(hx, lambda h: h < '2') END AS ex, CASE WHEN x[1] = '1' AND y[1] = '1' THEN hy ELSE list_filter(hy, lambda h: h < '2') END AS ey,
  CASE WHEN x[1] = '1' AND z[1] = '1' THEN hx ELSE list_filter(hx, lambda h: h < '2') END AS nx, CASE WHEN x[1] = '1' AND z[1] = '1' THEN hz ELSE list_filter(hz, lambda h: h < '2') END AS nz FROM lists),
sized AS (SELECT *, len(list_intersect(ex, ey)) AS es, least(len(ex), len(ey)) AS em, len(ex) + len(ey) AS eb,
  len(list_intersect(nx, nz)) AS ns, least(len(nx), len(nz)) AS nm, len(nx) + len(nz) AS nb FROM cut)
SELECT doc_id, n_chars, edited_sha256, x AS fingerprint, y AS edited_fingerprint,
  CASE WHEN x = y THEN 1.0::DOUBLE WHEN em = 0 THEN 0.0::DOUBLE ELSE es::DOUBLE / em END AS near_edited,
  CASE WHEN x = z THEN 1.0::DOUBLE WHEN nm = 0 THEN 0.0::DOUBLE ELSE ns::DOUBLE / nm END AS near_next,
  CASE WHEN x = y THEN 1.0::DOUBLE WHEN em = 0 THEN 0.0::DOUBLE ELSE es::DOUBLE / (eb - es) END AS resemblance_edited,
  CASE WHEN x = z THEN 1.0::DOUBLE WHEN nm = 0 THEN 0.0::DOUBLE ELSE ns::DOUBLE / (nb - ns) END AS resemblance_next FROM sized"""


@query("op1_fingerprints", OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_table(table(spark, sf_dir, "documents"))


@query("op2_near_copies")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"))


@query("op3_harmonic_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


OP5 = r"""WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5(coalesce(doc_id::VARCHAR, '')) AS o, md5(coalesce(text, '')) AS tie FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM sizes),
weighted AS (SELECT *, rk % 3 + 1 AS weight, 3 * source_size AS cap FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighted WINDOW w AS (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT level FROM levels WHERE cap >= level * weight ORDER BY cap::DOUBLE / weight, rk LIMIT 1),
aims AS (SELECT source, source_size, rk % 3 AS cycle, CASE WHEN source_size = 0 THEN 0.0::DOUBLE
  ELSE least(cap::DOUBLE, weight * coalesce((SELECT level FROM common), 0.0::DOUBLE)) END AS target FROM weighted),
lined AS (SELECT d.*, a.source_size, a.cycle, a.target, round(a.target)::BIGINT AS whole,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
shares AS (SELECT *, CASE WHEN target > 0 THEN before::DOUBLE / target END AS share FROM lined)
SELECT doc_id, source, size, source_size, target,
  CASE WHEN source_size > 0 THEN (whole // source_size) * size + greatest(0, least(size, whole - (whole // source_size) * source_size - before)) ELSE 0 END::BIGINT AS taken,
  coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE cycle WHEN 0 THEN (sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE + -2.0::DOUBLE * share)) - 1.5::DOUBLE) / -1.0::DOUBLE
    WHEN 1 THEN share / 1.0::DOUBLE ELSE (sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + 2.0::DOUBLE * share)) - 0.5::DOUBLE) / 1.0::DOUBLE END)), 0.0::DOUBLE) AS position FROM shares"""


@query("op5_curriculum_mix", OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op7_url_filter")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.fit(url_filter.seeded(pages)))


@query("op8_pairwise_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11 = r"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
fates AS (SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda t, z: CASE WHEN t % 2 = 1 THEN xor(t >> 1, 3988292384::BIGINT) ELSE t >> 1 END))) % 20 AS fate FROM src),
damaged AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fates),
numbered AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
seen AS (SELECT cid, turn, role, text, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  row_number() OVER (PARTITION BY cid, role, text ORDER BY turn NULLS FIRST) AS nth
  FROM damaged d JOIN numbered n ON d.conv_id IS NOT DISTINCT FROM n.conv_id),
faults AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM seen),
placed AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, CASE fault WHEN 'blank' THEN 0 WHEN 'duplicate' THEN 2 ELSE 1 END, text) AS i FROM faults),
turns AS (SELECT cid, i, turn, role, text, fault, role[1:1] AS c, fault IN ('blank', 'duplicate') AS bad, (fault = 'truncated')::INT AS cut,
  role[1:1] <> '' AND lag(role[1:1]) OVER w || role[1:1] NOT IN ('su', 'ua', 'au') OR role[1:1] = '' AND i > 1 AS illegal FROM placed WINDOW w AS (PARTITION BY cid ORDER BY i)),
sizes AS (SELECT cid, coalesce(max(i), 0) AS n FROM numbered LEFT JOIN turns USING (cid) GROUP BY cid),
values_of AS (SELECT cid, n + 1 AS i, [0, 4, 2, 0] AS v FROM sizes
  UNION ALL
  SELECT cid, i, [least(e[1], 2 + e[3], 4 + e[4]), least(e[2], 2 + e[3], 4 + e[4]), least(e[3], 2 + e[4]), least(e[4], 2 + e[3])] AS v FROM (
    SELECT t.cid, t.i, CASE WHEN bad THEN [3 + v[1], 3 + v[2], 3 + v[3], 3 + v[4]] ELSE [
      least(3 + v[1], 2 + cut + v[3], CASE c WHEN 's' THEN cut + v[2] WHEN 'u' THEN cut + v[3] ELSE 1000000000 END),
      least(3 + v[2], 2 + cut + v[3], CASE c WHEN 'u' THEN cut + v[3] ELSE 1000000000 END),
      least(3 + v[3], 2 + cut + v[4], CASE c WHEN 'a' THEN cut + v[4] ELSE 1000000000 END),
      least(3 + v[4], 2 + cut + v[3], CASE c WHEN 'u' THEN cut + v[3] ELSE 1000000000 END)] END AS e
    FROM values_of b JOIN turns t ON t.cid = b.cid AND t.i = b.i - 1)),
walk AS (SELECT cid, 1::BIGINT AS i, 1 AS s, 0 AS step, '' AS letter, NULL::VARCHAR AS role, NULL::VARCHAR AS text FROM sizes
  UNION ALL
  SELECT cid, CASE letter WHEN 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN s WHEN 'K' THEN kept ELSE [3, 3, 4, 3][s] END, step + 1, letter,
    CASE letter WHEN 'K' THEN role WHEN 'D' THEN NULL ELSE ['user', 'user', 'assistant', 'user'][s] END, CASE letter WHEN 'I' THEN '' WHEN 'D' THEN NULL ELSE text END FROM (
    SELECT *, CASE WHEN 3 + behind[s] = front[s] THEN 'D' WHEN 2 + front[[3, 3, 4, 3][s]] = front[s] THEN 'I' WHEN NOT bad AND cut + behind[kept] = front[s] THEN 'K' ELSE 'R' END AS letter FROM (
      SELECT w.cid, w.i, w.s, w.step, t.role, t.text, t.bad, t.cut, a.v AS front, b.v AS behind,
        CASE WHEN w.s = 1 AND t.c = 's' THEN 2 WHEN w.s IN (1, 2, 4) AND t.c = 'u' THEN 3 WHEN w.s = 3 AND t.c = 'a' THEN 4 END AS kept
      FROM walk w JOIN values_of a ON a.cid = w.cid AND a.i = w.i LEFT JOIN values_of b ON b.cid = w.cid AND b.i = w.i + 1 LEFT JOIN turns t ON t.cid = w.cid AND t.i = w.i
      WHERE b.v IS NOT NULL OR a.v[w.s] > 0))),
audits AS (SELECT cid, string_agg(letter, '' ORDER BY step) AS audit, string_agg(role || ':' || text, chr(10) ORDER BY step) FILTER (letter NOT IN ('', 'D')) AS body FROM walk GROUP BY cid),
counts AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM turns GROUP BY cid)
SELECT n.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, v[1]::BIGINT AS cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM numbered n JOIN audits USING (cid) JOIN values_of f ON f.cid = n.cid AND f.i = 1 LEFT JOIN counts c ON c.cid = n.cid"""


@query("op11_turn_repair", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.summary(turn_repair.damaged(turns), turns)


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = rf"""WITH docs AS (SELECT doc_id, row_number() OVER () AS place, {TERMS} AS terms FROM documents),
used AS (SELECT doc_id, place, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM used),
held AS (SELECT place, doc_id, n, term, count(*) AS tf FROM (SELECT place, doc_id, n, unnest(terms) AS term FROM used) GROUP BY ALL),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
weighted AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM held WHERE term IN (SELECT term FROM wanted) GROUP BY term), totals),
scores AS (SELECT item_id, place, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // length)))))::BIGINT AS score
  FROM held JOIN wanted USING (term) JOIN weighted USING (term), totals GROUP BY item_id, place, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""


@query("op12_lexical_search", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
