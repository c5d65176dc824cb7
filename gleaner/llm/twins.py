"""DuckDB twins of the operators that SQL can say."""

from __future__ import annotations


def _steps() -> list[int]:
    """The 16 values by which crc32 moves on by half a byte."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def crc(text: str) -> str:
    """Unsigned crc32 of a string's UTF-8 bytes, half a byte at a time, lower half first."""
    digits = f"hex(encode({text}))"
    halves = (f"list_transform(range(0, length({digits})), lambda i: CAST(instr('0123456789ABCDEF', "
              f"substr({digits}, CAST(xor(i, 1) + 1 AS BIGINT), 1)) - 1 AS BIGINT))")
    step = f"xor(list_extract(CAST({_steps()} AS BIGINT[]), CAST((xor(c, x) & 15) + 1 AS BIGINT)), c >> 4)"
    return f"xor(list_reduce({halves}, lambda c, x: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


#: Words of the resampling, from lower-cased texts.
_RESAMPLED_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

TARGET_RESAMPLING = f"""
WITH texts AS (
  SELECT 'd' AS side, doc_id, {_RESAMPLED_WORDS} AS w FROM documents
  UNION ALL
  SELECT 'b', NULL, {_RESAMPLED_WORDS} FROM benchmark),
features AS (
  SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
counted AS (SELECT side, doc_id, f, count(*) AS n FROM features GROUP BY ALL),
codes AS (
  SELECT f, {crc('f')} % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted)),
sums AS (
  SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS t
  FROM counted JOIN codes USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS a, sum(t) AS b FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (a + 10000)::DOUBLE / ((s + 1)::DOUBLE * (b + 10000)::DOUBLE))) AS gain FROM sums, totals),
weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
  FROM counted JOIN codes USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts d LEFT JOIN weights USING (doc_id) WHERE side = 'd'),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS k FROM scored WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.rank <= r.k THEN r.rank END AS rank FROM scored s LEFT JOIN drawn r USING (doc_id)
"""

PERIODIC_RUNS = f"""
WITH codes AS (
  SELECT doc_id, text, {crc('CAST(doc_id AS VARCHAR)')} AS h
  FROM documents),
plain AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM codes),
shaped AS (
  SELECT doc_id, h, w, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a, CASE WHEN len(w) > 0 THEN 1 + (len(w) - g % len(w)) // (3 + g % 8) END AS p FROM plain),
docs AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i:
    w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE w END AS w FROM shaped),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM docs),
equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM equal),
stretches AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM islands GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, e, min(q) AS q FROM stretches GROUP BY doc_id, s, e),
per AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
best AS (
  SELECT doc_id, s, e - s AS length, q, row_number() OVER (PARTITION BY doc_id ORDER BY (e - s)::DOUBLE / q DESC, s, q) AS place FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS held FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.length, b.q AS period, 1000 * b.length // b.q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(held, '')) AS collapsed_sha256
FROM docs d LEFT JOIN per USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SORTED_PROJECTIONS = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (
  SELECT vec_id, e FROM vectors WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM vectors UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
components AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM components c LEFT JOIN counts USING (vec_id)
"""

SUFFIX_REPEATS = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
starts AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM docs WHERE n >= 200)),
twice AS (SELECT doc_id, i FROM starts JOIN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1) USING (k)),
parted AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS new FROM twice WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM parted),
spans AS (SELECT doc_id, span, min(i) AS s, max(i) + 200 AS e FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans
         UNION ALL SELECT d.doc_id, n, coalesce(max(e), 0) FROM docs d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id, n),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s, before) AS held FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(held)) AS kept_sha256
FROM docs d JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
