"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, htmldiff, linededup, media, minhash, packing, secrets, substring, suffix, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"), with_text=False)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), 2048)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(_table(spark, sf_dir, "documents"), with_media=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmldiff.main_text(_table(spark, sf_dir, "pages"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_word_windows(_table(spark, sf_dir, "documents"), 35, with_text=False)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_byte_strings(_table(spark, sf_dir, "documents"), 200, with_bytes=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_html_extraction": op4_html_extraction,
    "op6_secret_scan": op6_secret_scan,
    "op8_telephony_audio": op8_telephony_audio,
    "op9_toxicity": op9_toxicity,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

SQL: dict[str, str] = {
    "op5_minhash_near_dedup": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT u, v FROM pr JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT DISTINCT u, u AS v FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u),
comp AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON u = d.doc_id
""",
    "op10_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, hash(x[2 * i - 1:2 * i + 398]) AS h FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 - 198)) AS i FROM d WHERE len(x) >= 400)),
often AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM often)),
new AS (SELECT *, CASE WHEN i > lag(i) OVER w + 200 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, g, min(i) AS a, max(i) + 199 AS b FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM new) GROUP BY ALL),
piece AS (SELECT doc_id, a AS o, x[2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1:2 * (a - 1)] AS p FROM run JOIN d USING (doc_id)
 UNION ALL SELECT doc_id, 1099511627776, x[2 * max(b) + 1:] FROM run JOIN d USING (doc_id) GROUP BY doc_id, x),
kept AS (SELECT doc_id, string_agg(p, '' ORDER BY o) AS k FROM piece GROUP BY doc_id), gone AS (SELECT doc_id, sum(b - a + 1) AS n, count(*) AS m FROM run GROUP BY doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, CASE WHEN n IS NULL THEN x ELSE '' END))) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op2_line_dedup": """
WITH RECURSIVE line AS (SELECT doc_id, p - 1 AS n, l[p] AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(p)),
own AS (SELECT * FROM line WHERE strlen(x) >= 40 OR regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
each AS (SELECT x, min((doc_id, n)) AS head FROM own GROUP BY x),
one AS (SELECT x, head FROM each WHERE strlen(x) >= 40),
seg AS (SELECT x, head, length(x) AS l, i, CASE i WHEN 0 THEN x[:length(x) // 3] WHEN 1 THEN x[length(x) // 3 + 1:2 * (length(x) // 3)] ELSE x[2 * (length(x) // 3) + 1:] END AS s FROM one, unnest([0, 1, 2]) AS t(i)),
probe AS (SELECT x AS y, head AS head2, l, i, substring(x, i * (l // 3) + 1 + sh, CASE i WHEN 2 THEN l - 2 * (l // 3) ELSE l // 3 END) AS s FROM one, unnest([0, 1, 2]) AS t(i), unnest(range(-2, 3)) AS u(sh), unnest(range(length(x) - 2, length(x) + 3)) AS w(l) WHERE i * (l // 3) + 1 + sh > 0),
pair AS (SELECT DISTINCT x, head, y, head2 FROM seg JOIN probe USING (l, i, s) WHERE x <> y),
link AS MATERIALIZED (SELECT head AS u, head2 AS v FROM pair WHERE abs(strlen(x) - strlen(y)) <= 2 AND levenshtein(x, y) <= 2),
edge AS MATERIALIZED (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT head AS u, head AS v FROM one WHERE head IN (SELECT u FROM edge) UNION SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u),
class AS (SELECT u, min(v) AS first FROM reach GROUP BY u),
gone AS (SELECT doc_id, n, coalesce(first, head) AS first FROM own JOIN each USING (x) LEFT JOIN class ON head = u WHERE (doc_id, n) <> coalesce(first, head)),
said AS (SELECT doc_id, count(*) AS k, string_agg(n::VARCHAR || '>' || first[1]::VARCHAR || ':' || first[2]::VARCHAR, ',' ORDER BY n) AS t FROM gone GROUP BY doc_id)
SELECT d.doc_id, (strlen(coalesce(text, '')) - strlen(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS n_lines, coalesce(k, 0)::BIGINT AS n_removed, coalesce(t, '') AS removed
FROM documents d LEFT JOIN said USING (doc_id)
""",
    "op1_decontamination": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
pat AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM pat) WHERE len(w) >= n)),
occ AS (SELECT doc_id, item_id, win.n, i FROM win JOIN pat ON win.s = pat.s AND win.n = pat.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS m, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_hit, coalesce(m, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(k, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
""",
    "op7_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
often AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE s IN (SELECT s FROM often)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
}
