"""Queries of the corpus operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op3_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, source, i, list_extract(l, i) AS line,
         regexp_replace(list_extract(l, i), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))),
bad AS (
  SELECT bare FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10)
SELECT d.doc_id, count(*)::BIGINT AS n_lines,
       count(bad.bare)::BIGINT AS n_removed_lines,
       coalesce(string_agg(d.line, chr(10) ORDER BY d.i) FILTER (WHERE bad.bare IS NULL), '') AS text
FROM lines d LEFT JOIN bad USING (bare) GROUP BY d.doc_id
""")
def op3_line_dedup(spark, sf_dir):
    from tabulon.llm.line_dedup import dedup_lines
    out = dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "text")


@query("op9_source_mixing", r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS seed
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS most,
         [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM src),
steps AS (
  -- in order of cap per weight: the first source whose cap is above the level of the rest
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM w WINDOW o AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)),
level AS (
  SELECT lvl FROM steps WHERE most > lvl * weight ORDER BY most::DOUBLE / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN source_size = 0 THEN 0.0
              ELSE least(most::DOUBLE, coalesce((SELECT lvl FROM level), 1e300) * weight) END AS target FROM w),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(d.seed, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
""")
def op9_source_mixing(spark, sf_dir):
    from tabulon.llm.mixing import mix_plan
    plan = mix_plan(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).alias("taken"))


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    from tabulon.llm.language_id import identify
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_simhash_dedup")
def op5_simhash_dedup(spark, sf_dir):
    from tabulon.llm.simhash import near_duplicates
    found = near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_substring_dedup")
def op7_substring_dedup(spark, sf_dir):
    from tabulon.llm.substring_dedup import dedup_substrings
    out = dedup_substrings(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf_dir):
    from tabulon.llm.suffix_dedup import dedup_suffixes
    out = dedup_suffixes(_read(spark, sf_dir, "documents"), keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op6_quality_rules")
def op6_quality_rules(spark, sf_dir):
    from tabulon.llm.quality_rules import quality
    out = quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "score")


@query("op4_embedding_dedup")
def op4_embedding_dedup(spark, sf_dir):
    from tabulon.llm.vector_dedup import near_vectors
    return near_vectors(_read(spark, sf_dir, "embeddings"))


@query("op2_packing")
def op2_packing(spark, sf_dir):
    from tabulon.llm.packing import pack
    return pack(_read(spark, sf_dir, "documents"))


@query("op1_license_scan")
def op1_license_scan(spark, sf_dir):
    from tabulon.llm.license_scan import scan
    found = scan(_read(spark, sf_dir, "documents"))
    best = F.sort_array(F.transform("licenses", lambda x: F.struct(
        x["matched"].alias("matched"), x["coverage"].alias("coverage"), x["license"].alias("license"))), asc=False)
    return found.select(
        "doc_id", "n_words", F.size("licenses").cast("long").alias("n_licenses"),
        F.get(best, F.lit(0))["license"].alias("license"), F.get(best, F.lit(0))["coverage"].alias("coverage"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(
            ":", x["license"], x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("places"))


@query("op11_quality_neighbours")
def op11_quality_neighbours(spark, sf_dir):
    from tabulon.llm.quality_neighbours import classify
    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query("op12_phrase_mining", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (
  SELECT lang, ws FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces) WHERE len(ws) > 0),
total AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
one AS (
  SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY ALL),
two AS (
  SELECT lang, x, y, count(*) AS f
  FROM (SELECT lang, unnest(ws[:-2]) AS x, unnest(ws[2:]) AS y FROM w WHERE len(ws) >= 2) GROUP BY ALL HAVING count(*) >= 10),
three AS (
  SELECT lang, x, y, z, count(*) AS f
  FROM (SELECT lang, unnest(ws[:-3]) AS x, unnest(ws[2:-2]) AS y, unnest(ws[3:]) AS z FROM w WHERE len(ws) >= 3)
  GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r
  FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, q.f
  FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, q.f
  FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z),
scored AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f
  FROM (SELECT lang, x || ' ' || y AS phrase, f FROM three UNION ALL SELECT lang, y || ' ' || z, f FROM three)
  GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE g.f IS NULL OR 100 * g.f < 50 * b.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""")
def op12_phrase_mining(spark, sf_dir):
    from tabulon.llm.phrases import mine
    found = mine(_read(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("op13_filter_audit", r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END)
             + (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
             + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS fails,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN g USING (doc_id)),
cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
steps AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, s.step,
         [a.bit, b.bit, c.bit, d.bit, e.bit][s.step] AS bit,
         list_sum([a.bit, b.bit, c.bit, d.bit, e.bit][1:s.step - 1]) AS before
  FROM letters a JOIN letters b ON b.bit <> a.bit JOIN letters c ON c.bit NOT IN (a.bit, b.bit)
       JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit),
       (SELECT unnest(range(1, 6)) AS step) s),
audit AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN fails & (coalesce(before, 0)::INT | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails & bit <> 0 AND fails & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails & bit <> 0 AND fails & coalesce(before, 0)::INT <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails & bit <> 0 AND fails & coalesce(before, 0)::INT = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails & bit <> 0 AND fails & coalesce(before, 0)::INT = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM audit
""")
def op13_filter_audit(spark, sf_dir):
    from tabulon.llm.filter_audit import audit
    return audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
