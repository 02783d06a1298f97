"""Queries of the core over the library's tables: name -> (spark, directory) -> DataFrame, and their SQL for a reference engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import text as X
from glosswork.operators import alignment, attribution, furniture, grading, issues, measurements, reports, rules, sections, timestamps, versions
from glosswork.session import cut_lineage
from glosswork.sources import files, sinks
from glosswork.sources.tables import table
from glosswork.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
STATUSES = ["PENDING", "PROCESSING", "PASS", "PARTIAL", "FAIL", "REVIEW_REQUIRED", "ERROR"]
GRADED = ["PASS", "PARTIAL", "FAIL", "REVIEW_REQUIRED"]
# The reference engine's own statement of the scripts, not the operators'.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{2F800}-\x{2FA1F}\x{3005}\x{3007}"
KANA = r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}"
ONCE = "(SELECT DISTINCT * FROM segments)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- problem 5 ----


@query()
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    names = ("documents", "document_versions", "scan_logs", "document_sources")
    return timestamps.library_instants(*(table(spark, root, n) for n in names))


# ---- text functions ----


@query(r"""
SELECT kind, count(*) AS segments, CAST(sum(length(regexp_replace(text, '[^\p{L}]', '', 'g'))) AS BIGINT) AS letters,
  CAST(sum(len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> ''))) AS BIGINT) AS words
FROM (SELECT DISTINCT * FROM segments) GROUP BY kind""")
def letters_and_words(spark: SparkSession, root: str) -> DataFrame:
    counts = F.length(X.letters(F.col("text"))).alias("letters"), F.size(X.words(F.col("text"))).alias("words")
    s = table(spark, root, "segments").select("seg_id", "kind", *counts).distinct()  # numbers: no text is shuffled
    return s.groupBy("kind").agg(F.count("*").alias("segments"), F.sum("letters").cast("bigint").alias("letters"), F.sum("words").cast("bigint").alias("words"))


@query(rf"""
WITH s AS (SELECT doc_id, regexp_matches(text, '[{KANA}]') AS other, length(regexp_replace(text, '[^{HAN}]', '', 'g')) AS h,
  length(regexp_replace(regexp_replace(text, '[{HAN}]', '', 'g'), '[^\p{{L}}]', '', 'g')) AS l FROM {ONCE})
SELECT doc_id, CAST(sum(CASE WHEN other THEN 0 ELSE h END) AS BIGINT) AS han_characters, CAST(sum(l) AS BIGINT) AS other_letters,
  CAST(count(*) FILTER (other) AS BIGINT) AS rejected FROM s GROUP BY doc_id""")
def script_split(spark: SparkSession, root: str) -> DataFrame:
    return attribution.script_split(table(spark, root, "segments"))


@query(r"""
SELECT doc_id, sha256(lower(file_path)) AS item_id,
  coalesce(nullif(trim(regexp_replace(translate(regexp_replace(file_name, '\.[^.]*$', ''), '_-', '  '), '\s+', ' ', 'g')), ''), file_name) AS title,
  CASE WHEN regexp_matches(lower(file_name), 'wi-|wi_|work instruction|instruksi kerja') THEN 'WORK_INSTRUCTION'
    WHEN regexp_matches(lower(file_name), 'guideline|panduan|pedoman') THEN 'GUIDELINE' WHEN regexp_matches(lower(file_name), 'policy|kebijakan') THEN 'POLICY'
    WHEN regexp_matches(lower(file_name), 'manual|buku panduan') THEN 'MANUAL' WHEN regexp_matches(lower(file_name), 'report|laporan') THEN 'REPORT'
    WHEN regexp_matches(lower(file_name), 'record|rekaman|catatan') THEN 'RECORD' WHEN regexp_matches(lower(file_name), 'sop|standard operating') THEN 'SOP'
    WHEN regexp_matches(lower(file_name), 'form|formulir|frm-|frm_') THEN 'FORM' ELSE 'OTHER' END AS type
FROM documents""")
def file_identity(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    return d.select("doc_id", X.item_id(F.col("file_path")).alias("item_id"), X.title_from_name(F.col("file_name")).alias("title"), X.guess_type(F.col("file_name")).alias("type"))


@query(r"""
SELECT doc_id, CASE WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN printf('%.1f KB', round(file_size / 1024, 1))
  WHEN file_size < 1073741824 THEN printf('%.1f MB', round(file_size / 1048576, 1)) ELSE printf('%.1f GB', round(file_size / 1073741824, 1)) END AS size
FROM documents""")
def human_sizes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", X.human_size(F.col("file_size")).alias("size"))


@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]'), 1) AS i,
  unnest(string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]')) AS line FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(max(i) AS BIGINT) AS last_line, CAST(sum(length(trim(line))) AS BIGINT) AS characters FROM l WHERE trim(line) <> '' GROUP BY doc_id""")
def text_lines(spark: SparkSession, root: str) -> DataFrame:
    lines = files.text_lines(table(spark, root, "documents"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), (F.max("seg_index") + 1).cast("bigint").alias("last_line"), F.sum(F.length("text")).alias("characters"))


# ---- furniture ----

_KEY = r"trim(regexp_replace(lower(regexp_replace(text, '[^\p{L}\s\p{Z}]', '', 'g')), '[\s\p{Z}]+', ' ', 'g'))"
_LINES = rf"""p AS (SELECT doc_id, page, CASE WHEN length(text) + 2 * length(regexp_replace(text, '[^{HAN}]', '', 'g')) <= 120 THEN {_KEY} END AS key FROM segments WHERE page IS NOT NULL),
long_enough AS (SELECT doc_id FROM p GROUP BY doc_id HAVING count(DISTINCT page) >= 3),
lines AS (SELECT doc_id, key, count(DISTINCT page) AS pages FROM p WHERE key <> '' AND doc_id IN (SELECT doc_id FROM long_enough) GROUP BY doc_id, key HAVING count(DISTINCT page) >= 3)"""
_VOCABULARY = rf"""vocabulary AS (SELECT DISTINCT doc_id, w AS word FROM (SELECT doc_id, unnest(string_split(key, ' ')) AS w FROM
  (SELECT doc_id, key FROM lines UNION ALL SELECT doc_id, {_KEY} FROM segments WHERE kind IN ('header', 'footer'))) WHERE length(w) >= 4)"""


@query(f"WITH {_LINES} SELECT doc_id, key, pages FROM lines")
def furniture_lines(spark: SparkSession, root: str) -> DataFrame:
    return furniture.furniture_lines(table(spark, root, "segments"))


@query(f"WITH {_LINES}, {_VOCABULARY} SELECT doc_id, word FROM vocabulary")
def furniture_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    return furniture.furniture_vocabulary(table(spark, root, "segments"))


@query(rf"""WITH {_LINES}, {_VOCABULARY}, v AS (SELECT doc_id, list(word) AS words FROM vocabulary GROUP BY doc_id),
rest AS (SELECT s.* FROM (SELECT *, {_KEY} AS key FROM segments WHERE kind NOT IN ('header', 'footer')) s WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = s.doc_id AND l.key = s.key)),
cut AS (SELECT seg_id, CASE WHEN words IS NULL THEN text ELSE array_to_string(list_filter(string_split_regex(trim(text), '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}]', '', 'g') = '' OR
  len(list_filter(words, lambda x: x = lower(regexp_replace(w, '[^\p{{L}}]', '', 'g')) OR (length(x) >= 6 AND length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) >= 6
  AND (contains(x, lower(regexp_replace(w, '[^\p{{L}}]', '', 'g'))) OR contains(lower(regexp_replace(w, '[^\p{{L}}]', '', 'g')), x))))) = 0), ' ') END AS text
  FROM rest LEFT JOIN v USING (doc_id))
SELECT seg_id, text FROM cut WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]')""")
def content_segments(spark: SparkSession, root: str) -> DataFrame:
    return furniture.content_segments(table(spark, root, "segments")).select("seg_id", "text")


@query(r"""
WITH p AS (SELECT doc_id, page, trim(regexp_replace(text, '[0-9]+', '', 'g')) AS key, row_number() OVER (PARTITION BY doc_id, page ORDER BY seg_index, text) AS t,
  row_number() OVER (PARTITION BY doc_id, page ORDER BY seg_index DESC, text DESC) AS b FROM (SELECT DISTINCT * FROM segments) WHERE page IS NOT NULL),
n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM p GROUP BY doc_id),
e AS (SELECT doc_id, 'header' AS edge, key FROM p WHERE t <= 2 UNION ALL SELECT doc_id, 'footer', key FROM p WHERE b <= 2)
SELECT doc_id, edge, key, count(*) AS times FROM e JOIN n USING (doc_id) WHERE length(key) >= 8 GROUP BY doc_id, edge, key, pages HAVING count(*) >= greatest(2, floor(pages * 0.6))""")
def repeated_edge_lines(spark: SparkSession, root: str) -> DataFrame:
    return furniture.edge_lines(sections.once(table(spark, root, "segments")))


# ---- sections ----

_ISLANDS = """o AS (SELECT *, kind = 'heading' AS heading, coalesce(section, CASE WHEN kind = 'heading' THEN text END) AS own,
  row_number() OVER (PARTITION BY doc_id ORDER BY seg_index, seg_id) AS rn FROM (SELECT DISTINCT * FROM segments)),
c AS (SELECT *, CASE WHEN rn > 1 THEN coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg_index, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '(document body)') END AS cur FROM o),
q AS (SELECT *, 1 + sum(CASE WHEN rn > 1 AND (heading OR (section IS NOT NULL AND section IS DISTINCT FROM cur)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg_index, seg_id ROWS UNBOUNDED PRECEDING) AS seq,
  bool_or(own IS NOT NULL) OVER (PARTITION BY doc_id) AS structured, bool_or(page IS NOT NULL) OVER (PARTITION BY doc_id) AS paged FROM c),
n AS (SELECT *, CASE WHEN NOT structured AND paged THEN dense_rank() OVER (PARTITION BY doc_id ORDER BY coalesce(page, 0)) ELSE seq END AS sequence,
  CASE WHEN NOT structured AND paged THEN 'Page ' || coalesce(page, 0) ELSE coalesce(first_value(own) OVER (PARTITION BY doc_id, seq ORDER BY seg_index, seg_id), '(document body)') END AS section_name FROM q)"""


@query(rf"""WITH {_ISLANDS} SELECT doc_id, CAST(sequence AS BIGINT) AS sequence, min_by(section_name, (seg_index, seg_id)) AS name, coalesce(arg_min_null(page, (seg_index, seg_id)), 0) AS page,
  count(*) AS segment_count, CAST(sum(length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))) AS BIGINT) AS total_characters FROM n GROUP BY doc_id, sequence""")
def section_islands(spark: SparkSession, root: str) -> DataFrame:
    return sections.sections(sections.once(table(spark, root, "segments"))).withColumns({"sequence": F.col("sequence").cast("bigint"), "page": F.coalesce("page", F.lit(0))})


@query("""SELECT doc_id, CASE WHEN bool_or(kind = 'heading') THEN 'heading' WHEN bool_or(kind = 'sheet_cell') THEN 'worksheet'
  WHEN bool_or(page IS NOT NULL) AND NOT bool_or(section IS NOT NULL) THEN 'page' WHEN bool_or(section IS NOT NULL) THEN 'heading' ELSE 'document' END AS origin FROM segments GROUP BY doc_id""")
def section_origin(spark: SparkSession, root: str) -> DataFrame:
    return sections.origins(table(spark, root, "segments"))


@query("""WITH e AS (SELECT DISTINCT doc_id, sequence, characters FROM document_sections), u AS (SELECT doc_id, sequence, unnest(map_entries(characters)) AS x FROM e)
SELECT doc_id, sequence, x.key AS language, x.value AS characters, round(100.0 * x.value / nullif(sum(x.value) OVER (PARTITION BY doc_id, sequence), 0), 2) AS share FROM u""")
def section_coverage(spark: SparkSession, root: str) -> DataFrame:
    return sections.coverage(table(spark, root, "document_sections").dropDuplicates(["doc_id", "sequence"]))


@query("""WITH a AS (SELECT doc_id, sequence, total_characters >= 120 AS ev, coalesce(characters['en'], 0) AS en, coalesce(characters['id'], 0) AS id, coalesce(characters['zh'], 0) AS zh FROM (SELECT DISTINCT doc_id, sequence, total_characters, characters FROM document_sections)),
b AS (SELECT *, greatest(en, id, 3.0 * zh) AS longest, (en > 0)::INT + (id > 0)::INT + (zh > 0)::INT AS present FROM a)
SELECT doc_id, sequence, ev AS evaluated, concat_ws(',', CASE WHEN ev AND en = 0 THEN 'en' END, CASE WHEN ev AND id = 0 THEN 'id' END, CASE WHEN ev AND zh = 0 THEN 'zh' END) AS missing,
  concat_ws(',', CASE WHEN ev AND present >= 2 AND en > 0 AND en < 0.35 * longest THEN 'en' END, CASE WHEN ev AND present >= 2 AND id > 0 AND id < 0.35 * longest THEN 'id' END,
  CASE WHEN ev AND present >= 2 AND zh > 0 AND 3.0 * zh < 0.35 * longest THEN 'zh' END) AS short FROM b""")
def section_gaps(spark: SparkSession, root: str) -> DataFrame:
    found = sections.gaps(table(spark, root, "document_sections").dropDuplicates(["doc_id", "sequence"]), ("en", "id", "zh"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("missing", "short")})


@query("""SELECT unnest(missing) AS language, count(*) AS sections FROM (SELECT DISTINCT * REPLACE (CAST(map_entries(characters) AS VARCHAR) AS characters) FROM document_sections) WHERE evaluated AND (len(missing) > 0 OR len(short) > 0) GROUP BY 1""")
def sections_missing(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "document_sections").dropDuplicates(["doc_id", "sequence"]).filter(F.col("evaluated") & ((F.size("missing") > 0) | (F.size("short") > 0)))
    return rows.select(F.explode("missing").alias("language")).groupBy("language").agg(F.count("*").alias("sections"))


@query("SELECT doc_id, sequence, name FROM document_sections WHERE list_contains(missing, 'zh')")
def sections_without_chinese(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "document_sections").filter(F.array_contains("missing", "zh")).select("doc_id", "sequence", "name")


# ---- attribution, alignment ----


@query("""SELECT language, CAST(sum(characters) AS BIGINT) AS characters, round(least(1.0, sum(least(greatest(confidence, 0), 1) * characters) / sum(CASE WHEN confidence IS NOT NULL THEN characters END)), 4) AS confidence,
  count(DISTINCT doc_id) AS documents FROM (SELECT DISTINCT * FROM language_tallies) GROUP BY language""")
def weighted_confidence(spark: SparkSession, root: str) -> DataFrame:
    known = F.when(F.col("confidence").isNotNull(), F.col("characters"))
    sure = F.greatest(F.least(F.col("confidence"), F.lit(1.0)), F.lit(0.0))
    return table(spark, root, "language_tallies").distinct().groupBy("language").agg(
        F.sum("characters").alias("characters"), F.round(F.least(F.lit(1.0), F.sum(F.when(F.col("confidence").isNotNull(), sure) * F.col("characters")) / F.sum(known)), 4).alias("confidence"),
        F.count_distinct("doc_id").alias("documents"),
    )


@query("""WITH t AS (SELECT doc_id, language, sum(characters) AS n FROM (SELECT DISTINCT * FROM language_tallies) WHERE language IN ('en', 'id', 'zh') GROUP BY 1, 2)
SELECT doc_id, arg_max(language, (n, CASE language WHEN 'en' THEN 2 WHEN 'id' THEN 1 ELSE 0 END)) AS language FROM t GROUP BY doc_id""")
def dominant_language(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "language_tallies").distinct().filter(F.col("language").isin("en", "id", "zh")).groupBy("doc_id", "language").agg(F.sum("characters").alias("n"))
    first = F.when(F.col("language") == "en", 2).when(F.col("language") == "id", 1).otherwise(0)
    return t.groupBy("doc_id").agg(F.max_by("language", F.struct(F.col("n"), first)).alias("language"))


# The classifier as SQL: trigrams of words with their borders, naive Bayes over the labelled documents.
_MODEL = r"""tw AS (SELECT lang, w, count(*) AS n FROM (SELECT lower(lang) AS lang, unnest(string_split_regex(lower(substring(text, 1, 5000)), '[^\p{L}]+')) AS w FROM documents WHERE lower(lang) IN ('en', 'id')) WHERE w <> '' GROUP BY 1, 2),
tg AS (SELECT lang, substring(' ' || w || ' ', i, 3) AS gram, sum(n) AS n FROM (SELECT *, unnest(range(1, length(w) + 1)) AS i FROM tw) GROUP BY 1, 2 HAVING sum(n) >= 2),
tt AS (SELECT lang, sum(n) + count(*) + 1 AS total FROM tg GROUP BY 1),
gain AS (SELECT gram, lang, ln((n + 1) / total) - ln(1 / total) AS gain FROM tg JOIN tt USING (lang))"""


def _scored(rows: str, key: str) -> str:
    """CTEs that score the texts of `rows` (key, latin): scored (key, lang, confidence)."""
    return rf"""sw AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(string_split_regex(lower(latin), '[^\p{{L}}]+')) AS w FROM {rows}) WHERE w <> '' GROUP BY ALL),
ww AS (SELECT w, length(w) AS size, lang, coalesce(sum(gain), 0) AS gain FROM (SELECT w, tt.lang, substring(' ' || w || ' ', i, 3) AS gram FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT DISTINCT w FROM sw)), tt) LEFT JOIN gain USING (gram, lang) GROUP BY ALL),
ss AS (SELECT {key}, lang, sum(n * (size * ln(1 / total) + gain)) AS score FROM sw JOIN ww USING (w) JOIN tt USING (lang) GROUP BY ALL),
pp AS (SELECT *, exp(score - max(score) OVER (PARTITION BY {key})) / sum(exp(score - top)) OVER (PARTITION BY {key}) AS p FROM (SELECT *, max(score) OVER (PARTITION BY {key}) AS top FROM ss)),
scored AS (SELECT {key}, CASE WHEN max(p) >= 0.8 THEN arg_max(lang, p) END AS lang, max(p) AS confidence FROM pp GROUP BY ALL)"""


_SPLIT = rf"""CASE WHEN regexp_matches(text, '[{KANA}]') THEN 0 ELSE length(regexp_replace(text, '[^{HAN}]', '', 'g')) END AS h,
  regexp_replace(text, '[{HAN}]', '', 'g') AS latin, length(regexp_replace(regexp_replace(text, '[{HAN}]', '', 'g'), '[^\p{{L}}]', '', 'g')) AS l"""
_LANGUAGE = rf"""{_MODEL}, x AS (SELECT *, {_SPLIT} FROM {ONCE}), {_scored("x", "seg_id")},
named AS (SELECT x.*, CASE WHEN h > 0 AND h * 3 > l THEN 'zh' WHEN l > 0 THEN scored.lang END AS language FROM x LEFT JOIN scored USING (seg_id))"""


def _model(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").filter(F.lower("lang").isin("en", "id"))
    return attribution.train(docs.select(F.lower("lang").alias("lang"), F.col("text")))


def _named(spark: SparkSession, root: str) -> DataFrame:
    """Segments once, with the language each is mostly written in."""
    return attribution.with_language(sections.once(table(spark, root, "segments")), _model(spark, root))


@query(rf"""WITH {_MODEL}, x0 AS (SELECT *, {_SPLIT} FROM {ONCE} WHERE text IS NOT NULL),
x AS (SELECT doc_id, CAST(seg_id AS VARCHAR) AS part, latin, l AS n FROM x0 WHERE l >= 12 UNION ALL SELECT doc_id, 'pool', string_agg(latin, ' ' ORDER BY seg_index, seg_id), sum(l) FROM x0 WHERE l > 0 AND l < 12 GROUP BY doc_id),
{_scored("x", "doc_id, part")}
SELECT doc_id, 'zh' AS language, CAST(sum(h) AS BIGINT) AS characters, CAST(NULL AS BIGINT) AS words, 1.0::DOUBLE AS confidence FROM x0 GROUP BY doc_id HAVING sum(h) > 0
UNION ALL SELECT doc_id, lang, CAST(sum(n) AS BIGINT), CAST(sum(len(list_filter(string_split_regex(trim(latin), '\s+'), lambda w: w <> ''))) AS BIGINT), round(least(1.0, sum(confidence * n) / sum(n)), 4) FROM x JOIN scored USING (doc_id, part) GROUP BY doc_id, lang""")
def language_profile(spark: SparkSession, root: str) -> DataFrame:
    """Tallies of every document by the n-gram classifier, trained on labelled documents."""
    return attribution.tallies(sections.once(table(spark, root, "segments")), ["doc_id"], _model(spark, root)).withColumn("characters", F.col("characters").cast("bigint"))


@query(f"WITH {_LANGUAGE} SELECT seg_id, language FROM named")
def segment_languages(spark: SparkSession, root: str) -> DataFrame:
    return _named(spark, root).select("seg_id", "language")


_DOMINANT = rf"""CASE WHEN l = 0 THEN CASE WHEN h > 0 THEN 'zh' ELSE 'unassigned' END WHEN h * 3 > l THEN 'zh' ELSE 'latin' END"""


@query(rf"""WITH {_ISLANDS}, s AS (SELECT n.doc_id, n.sequence, n.text, CASE WHEN regexp_matches(n.text, '[{KANA}]') THEN 0 ELSE length(regexp_replace(n.text, '[^{HAN}]', '', 'g')) END AS h,
  length(regexp_replace(regexp_replace(n.text, '[{HAN}]', '', 'g'), '[^\p{{L}}]', '', 'g')) AS l FROM n WHERE trim(n.text) <> '')
SELECT doc_id, CAST(sequence AS BIGINT) AS sequence, {_DOMINANT} AS language, count(*) AS segments, CAST(sum(length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))) AS BIGINT) AS characters FROM s GROUP BY 1, 2, 3""")
def aligned_blocks(spark: SparkSession, root: str) -> DataFrame:
    return alignment.aligned_blocks(sections.once(table(spark, root, "segments"))).select("doc_id", F.col("sequence").cast("bigint"), "language", "segments", "characters")


@query("""WITH b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seg_index, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM (SELECT DISTINCT * FROM segments))
SELECT doc_id, CAST(count(*) FILTER (spent < 1000) AS BIGINT) AS kept, CAST(sum(length(text)) FILTER (spent < 1000) AS BIGINT) AS characters, bool_or(spent >= 1000 AND trim(text) <> '') AS truncated FROM b GROUP BY doc_id""")
def alignment_budget(spark: SparkSession, root: str) -> DataFrame:
    """How a budget of 1,000 characters cuts; `aligned_blocks` has the production budget."""
    rows = alignment.budgeted(sections.once(table(spark, root, "segments")), 1000)
    return rows.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("text")).alias("characters"), F.max("truncated").alias("truncated"))


# ---- measurements, rules ----


_N = r"[0-9]{1,3}(?:[.,\s\p{Z}][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?"
_U = (
    r"立方米|摄氏度|ms/cm|µs/cm|us/cm|mg/l|mg/kg|meq/l|毫米|厘米|千米|公里|毫克|千克|公斤|毫升|千帕|兆帕|ppm|ppb|phr|kpa|mpa|bar|psi|atm|ntu|rpm|lpm|gpm|g/l|m/s|°c|°f|mg|kg|µg|ug|ml|m3|mm|cm|km|kw|kwh|mw|hp|kv|ma|hz|"
    r"米|克|吨|升|度|帕|巴|℃|℉|%|‰|g|t|l|m|v|a"
)
_W = r"\p{L}\p{N}_"
# Without looking back: a mark before every place where a measurement may begin, and one in front of it for what ends before.
_MEASURED = rf"""f0 AS (SELECT seg_id, translate(coalesce(text, ''), '０１２３４５６７８９，．、％：／　⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉μ', '0123456789,.,%:/ 01234567890123456789µ') AS t FROM {ONCE}),
f AS (SELECT seg_id, {"replace(" * 18}t, '℃', '°C'), '℉', '°F'), '㎎', 'mg'), '㎏', 'kg'), '㎍', 'µg'), '㎜', 'mm'), '㎝', 'cm'), '㎞', 'km'), '㎡', 'm2'), '㎥', 'm3'), '㎖', 'ml'), 'ℓ', 'l'), '㎾', 'kW'), '㎸', 'kV'), '㎃', 'mA'), '㎐', 'Hz'), '㎪', 'kPa'), '㎫', 'MPa') AS t FROM f0),
p AS (SELECT seg_id, regexp_replace(t, '(^|[^{_W}])([pP][hH])', '\1⟧⟦\2', 'g') AS t FROM f),
q AS (SELECT seg_id, regexp_extract_all(t, '(?i)⟦(ph[\s\p{{Z}}]*(?:{_N}))(?:$|[^A-Za-z0-9])', 1) AS ph, replace(replace(regexp_replace(t, '(?i)⟦ph[\s\p{{Z}}]*(?:{_N})($|[^A-Za-z0-9])', ' \1', 'g'), '⟧', ''), '⟦', '') AS t FROM p),
r AS (SELECT seg_id, ph, regexp_extract_all(regexp_replace(t, '(^|[^{_W}.,])([0-9])', '\1⟧⟦\2', 'g'), '(?i)⟦((?:{_N})[\s\p{{Z}}]*(?:{_U}))(?:$|[^A-Za-z0-9])', 1) AS rest FROM q),
m AS (SELECT seg_id, unnest(list_concat(list_transform(ph, lambda x: {{'raw': x, 'unit': 'ph'}}), list_transform(rest, lambda x: {{'raw': x, 'unit': lower(trim(regexp_replace(x, '^(?:{_N})[\s\p{{Z}}]*', '')))}}))) AS x, generate_subscripts(list_concat(ph, rest), 1) - 1 AS no FROM r),
n AS (SELECT seg_id, no, x.raw AS raw, x.unit AS unit, regexp_replace(regexp_extract(x.raw, '{_N}'), '[\s\p{{Z}}]', '', 'g') AS n FROM m),
d AS (SELECT *, length(n) - length(replace(n, '.', '')) AS dots, length(n) - length(replace(n, ',', '')) AS commas, replace(replace(n, '.', ''), ',', '') AS joined, replace(n, ',', '.') AS point FROM n),
v AS (SELECT seg_id, CAST(no AS INT) AS no, raw, CASE WHEN dots > 0 AND commas > 0 THEN [TRY_CAST(CASE WHEN instr(reverse(n), ',') < instr(reverse(n), '.') THEN replace(replace(n, '.', ''), ',', '.') ELSE replace(n, ',', '') END AS DOUBLE)]
  WHEN dots + commas = 0 THEN [TRY_CAST(n AS DOUBLE)] WHEN dots + commas > 1 THEN [TRY_CAST(joined AS DOUBLE)] WHEN regexp_matches(n, '[.,][0-9]{{3}}$') THEN [TRY_CAST(joined AS DOUBLE), TRY_CAST(point AS DOUBLE)] ELSE [TRY_CAST(point AS DOUBLE)] END AS values, unit FROM d)"""


@query(f"WITH {_MEASURED} SELECT seg_id, no, raw, values, unit FROM v")
def found_measurements(spark: SparkSession, root: str) -> DataFrame:
    """Every measurement of every segment with the values it may denote."""
    rows = table(spark, root, "segments").dropDuplicates(["seg_id"]).select("seg_id", F.posexplode(measurements.measurements(F.col("text"))).alias("no", "m"))
    return rows.select("seg_id", "no", "m.raw", "m.values", "m.unit")


def _judged(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """What the rules read: segments once with their language, written once for all rules; facts of the documents."""
    scanned = table(spark, root, "ocr_pages").select("doc_id").distinct().withColumn("scanned", F.lit(True))
    docs = table(spark, root, "documents").select("doc_id", (F.lower("extension") == "docx").alias("is_docx")).join(scanned, "doc_id", "left").na.fill({"scanned": False})
    rows = _named(spark, root).select("doc_id", "seg_id", "seg_index", "text", "kind", "page", "section", "font_colors", "language")
    return cut_lineage(rows), docs


@query()
def numeric_mismatches(spark: SparkSession, root: str) -> DataFrame:
    return rules.numeric_mismatches(_named(spark, root))


@query()
def rule_outcomes(spark: SparkSession, root: str) -> DataFrame:
    segments, facts = _judged(spark, root)
    return rules.run(segments, facts=facts)


_FACTS = "facts AS (SELECT doc_id, lower(extension) = 'docx' AS is_docx FROM documents)"
_OUTCOME = "doc_id, applicable, CASE WHEN applicable THEN n = 0 END AS passed, CAST(CASE WHEN applicable THEN n ELSE 0 END AS BIGINT) AS findings"


def _outcome(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "applicable", "passed", "findings")


@query(f"""WITH {_LANGUAGE}, f AS (SELECT doc_id, section, language, min((seg_index, seg_id)) AS place FROM named WHERE coalesce(kind, '') <> 'heading' AND length(text) >= 25 AND language IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, section, list(language ORDER BY place) AS seen FROM f WHERE section IS NOT NULL GROUP BY ALL),
w AS (SELECT doc_id, count(*) AS n FROM s WHERE len(seen) >= 2 AND seen <> list_filter(['en', 'id', 'zh'], lambda c: list_contains(seen, c)) GROUP BY doc_id),
o AS (SELECT doc_id, CASE WHEN bool_or(kind = 'heading') OR bool_or(kind = 'sheet_cell') OR bool_or(section IS NOT NULL) THEN true ELSE false END AS applicable FROM {ONCE} GROUP BY doc_id)
SELECT {_OUTCOME} FROM (SELECT doc_id, applicable, coalesce(n, 0) AS n FROM o LEFT JOIN w USING (doc_id))""")
def language_order(spark: SparkSession, root: str) -> DataFrame:
    """Sections whose languages do not first appear in the panel's order."""
    return _outcome(rules.language_order(_named(spark, root)))


@query(f"""WITH {_FACTS}, d AS (SELECT doc_id, max((kind = 'header')::INT) AS h, max((kind = 'footer')::INT) AS f, count(DISTINCT page) AS pages FROM segments GROUP BY doc_id),
p AS (SELECT doc_id, page, trim(regexp_replace(text, '[0-9]+', '', 'g')) AS key, row_number() OVER (PARTITION BY doc_id, page ORDER BY seg_index, text) AS t,
  row_number() OVER (PARTITION BY doc_id, page ORDER BY seg_index DESC, text DESC) AS b FROM {ONCE} WHERE page IS NOT NULL),
e AS (SELECT doc_id, 'header' AS edge, key FROM p WHERE t <= 2 UNION ALL SELECT doc_id, 'footer', key FROM p WHERE b <= 2),
r AS (SELECT doc_id, count(DISTINCT edge) AS edges FROM (SELECT doc_id, edge, key FROM e JOIN d USING (doc_id) WHERE length(key) >= 8 GROUP BY doc_id, edge, key, pages HAVING count(*) >= greatest(2, floor(pages * 0.6))) GROUP BY doc_id)
SELECT {_OUTCOME} FROM (SELECT doc_id, is_docx OR (pages >= 3 AND coalesce(edges, 0) = 2) AS applicable, CASE WHEN is_docx THEN 2 - h - f ELSE 0 END AS n FROM d JOIN facts USING (doc_id) LEFT JOIN r USING (doc_id))""")
def header_footer(spark: SparkSession, root: str) -> DataFrame:
    facts = table(spark, root, "documents").select("doc_id", (F.lower("extension") == "docx").alias("is_docx"), F.lit(False).alias("scanned"))
    return _outcome(rules.header_footer(sections.once(table(spark, root, "segments")), facts))


@query(f"""WITH r AS (SELECT *, CASE WHEN page IS NULL THEN row_number() OVER (PARTITION BY doc_id, page IS NULL ORDER BY seg_index, seg_id) END AS rn FROM {ONCE} WHERE text IS NOT NULL),
o AS (SELECT doc_id, text, page IS NOT NULL AS p FROM r WHERE page = 1 OR rn <= 15), b AS (SELECT *, bool_or(p) OVER (PARTITION BY doc_id) AS best FROM o),
c AS (SELECT doc_id, bool_or(regexp_matches(text, '(?:^|[^A-Za-z0-9-])[A-Z]{{2,6}}(?:-[A-Z0-9]{{2,8}}){{1,4}}-?[0-9]{{1,4}}(?:$|[^A-Za-z0-9-])')) AS code, bool_or(length(text) >= 10) AS title FROM b WHERE p = best GROUP BY doc_id)
SELECT {_OUTCOME} FROM (SELECT doc_id, code IS NOT NULL AS applicable, (NOT code)::INT + (NOT title)::INT AS n FROM (SELECT DISTINCT doc_id FROM segments) LEFT JOIN c USING (doc_id))""")
def cover_page(spark: SparkSession, root: str) -> DataFrame:
    return _outcome(rules.cover_page(sections.once(table(spark, root, "segments"))))


@query(f"""WITH {_FACTS}, c AS (SELECT doc_id, upper(regexp_replace(unnest(font_colors), '^#+', '')) AS colour FROM segments), n AS (SELECT doc_id, count(DISTINCT colour) AS n FROM c WHERE colour <> '000000' GROUP BY doc_id),
a AS (SELECT doc_id, bool_or(len(font_colors) > 0) AS has FROM segments GROUP BY doc_id)
SELECT {_OUTCOME} FROM (SELECT doc_id, has AND is_docx AS applicable, coalesce(n, 0) AS n FROM a JOIN facts USING (doc_id) LEFT JOIN n USING (doc_id))""")
def font_color(spark: SparkSession, root: str) -> DataFrame:
    facts = table(spark, root, "documents").select("doc_id", (F.lower("extension") == "docx").alias("is_docx"), F.lit(False).alias("scanned"))
    return _outcome(rules.font_color(table(spark, root, "segments"), facts))


@query(r"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_index, seg_id) AS rn, kind IN ('header', 'footer') OR page IS NULL OR page = 1 AS near FROM segments),
a AS (SELECT *, bool_or(near) OVER (PARTITION BY doc_id) AS any_near FROM r),
c AS (SELECT doc_id, seg_index, seg_id, nullif(regexp_extract(text, '(?:^|[^A-Za-z0-9-])([A-Z]{2,6}(?:-[A-Z0-9]{2,8}){1,4}-?[0-9]{1,4})(?:$|[^A-Za-z0-9-])', 1), '') AS code,
  nullif(regexp_extract(text, '(?:^|[^A-Za-z0-9])[Rr][Ee][Vv](?:[Ii][Ss][Ii][Oo][Nn])?\.?\s*([0-9]{1,4})(?:$|[^A-Za-z0-9_])', 1), '') AS rev FROM a WHERE near OR (NOT any_near AND rn <= 40))
SELECT doc_id, arg_min(code, (seg_index, seg_id)) FILTER (code IS NOT NULL) AS document_code, arg_min(rev, (seg_index, seg_id)) FILTER (rev IS NOT NULL) AS revision
FROM c WHERE code IS NOT NULL OR rev IS NOT NULL GROUP BY doc_id""")
def document_codes(spark: SparkSession, root: str) -> DataFrame:
    return rules.code_and_revision(table(spark, root, "segments"))


@query("""WITH c AS (SELECT doc_id, seg_index, seg_id, text, upper(regexp_replace(unnest(font_colors), '^#+', '')) AS colour FROM (SELECT DISTINCT * FROM segments))
SELECT doc_id, colour, count(*) AS times, substring(arg_min(text, (seg_index, seg_id)), 1, 60) AS example FROM (SELECT DISTINCT * FROM c) WHERE colour <> '000000' GROUP BY doc_id, colour""")
def colour_offenders(spark: SparkSession, root: str) -> DataFrame:
    return rules.colour_offenders(table(spark, root, "segments"))


# ---- scores ----

_WIDE = """w AS (SELECT doc_id, coalesce(sum(characters) FILTER (language = 'en'), 0) AS en, coalesce(sum(characters) FILTER (language = 'id'), 0) AS id, coalesce(sum(characters) FILTER (language = 'zh'), 0) AS zh FROM (SELECT DISTINCT * FROM language_tallies) GROUP BY doc_id),
s AS (SELECT *, (en + id + 3.0 * zh) / 3 AS mean FROM w),
g AS (SELECT *, CASE WHEN mean > 0 THEN round((least(least(en / 100.0, 1), least(en / (mean * 0.5), 1)) + least(least(id / 100.0, 1), least(id / (mean * 0.5), 1)) + least(least(zh / 50.0, 1), least(3.0 * zh / (mean * 0.5), 1))) * 100 / 3, 2) ELSE 0 END AS score FROM s)"""


@query(f"""WITH {_WIDE}, v AS (SELECT doc_id, en, id, zh, CAST(score AS DOUBLE) AS score, CASE WHEN en = 0 AND id = 0 AND zh = 0 THEN 'REVIEW_REQUIRED' WHEN en = 0 OR id = 0 OR zh = 0 THEN 'FAIL'
  WHEN en < 100 OR id < 100 OR zh < 50 OR score < 80 THEN 'PARTIAL' ELSE 'PASS' END AS status FROM g)
SELECT doc_id, score, status, concat_ws(',', CASE WHEN en = 0 THEN 'LANGUAGE_MISSING:en' WHEN en < 100 THEN 'LOW_LANGUAGE_COVERAGE:en' END, CASE WHEN id = 0 THEN 'LANGUAGE_MISSING:id' WHEN id < 100 THEN 'LOW_LANGUAGE_COVERAGE:id' END,
  CASE WHEN zh = 0 THEN 'LANGUAGE_MISSING:zh' WHEN zh < 50 THEN 'LOW_LANGUAGE_COVERAGE:zh' END, CASE WHEN status = 'PARTIAL' AND en >= 100 AND id >= 100 AND zh >= 50 THEN 'UNBALANCED_LANGUAGES' END) AS issues FROM v""")
def document_scores(spark: SparkSession, root: str) -> DataFrame:
    return grading.verdicts(table(spark, root, "language_tallies").distinct()).select("doc_id", "score", "status", F.array_join("issues", ",").alias("issues"))


@query("""WITH w AS (SELECT doc_id, p.language, p.threshold, coalesce(sum(t.characters) FILTER (t.language = p.language), 0) AS n FROM (SELECT DISTINCT * FROM language_tallies) t CROSS JOIN (VALUES ('en', 100), ('id', 100), ('zh', 50)) p(language, threshold) GROUP BY 1, 2, 3)
SELECT language, count(*) AS documents, CAST(sum(CASE WHEN n > 0 AND n >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS meeting FROM w GROUP BY language""")
def language_compliance(spark: SparkSession, root: str) -> DataFrame:
    results = grading.threshold_results(table(spark, root, "language_tallies").distinct())
    return results.groupBy("language").agg(F.count("*").alias("documents"), F.count_if("meets").alias("meeting"))


@query(r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 20")
def ocr_required(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").filter(F.length(X.letters(F.col("text"))) < 20).select("doc_id")


# ---- counts and lists ----


@query("""WITH d(position, analysis_status) AS (VALUES (0, 'PENDING'), (1, 'PROCESSING'), (2, 'PASS'), (3, 'PARTIAL'), (4, 'FAIL'), (5, 'REVIEW_REQUIRED'), (6, 'ERROR'))
SELECT position, d.analysis_status, count(t.doc_id) AS n FROM d LEFT JOIN (SELECT * FROM documents WHERE is_active) t ON t.analysis_status = d.analysis_status GROUP BY 1, 2""")
def status_counts(spark: SparkSession, root: str) -> DataFrame:
    return reports.count_by(table(spark, root, "documents").filter("is_active"), "analysis_status", STATUSES)


@query("""SELECT round(100.0 * count(*) FILTER (analysis_status = 'PASS') / nullif(count(*) FILTER (analysis_status IN ('PASS', 'PARTIAL', 'FAIL', 'REVIEW_REQUIRED')), 0), 1) AS percent FROM documents WHERE is_active""")
def compliance_percent(spark: SparkSession, root: str) -> DataFrame:
    return reports.share(table(spark, root, "documents").filter("is_active"), "analysis_status", "PASS", GRADED)


@query("SELECT document_type, count(*) AS n FROM documents WHERE is_active AND document_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, document_type LIMIT 10")
def top_types(spark: SparkSession, root: str) -> DataFrame:
    return reports.top(table(spark, root, "documents").filter("is_active"), "document_type")


@query("SELECT s.name, count(*) AS n FROM documents d JOIN document_sources s ON s.id = d.document_source_id WHERE d.is_active GROUP BY 1 ORDER BY n DESC, s.name LIMIT 10")
def top_sources(spark: SparkSession, root: str) -> DataFrame:
    # counted before the join, so a hot source is one row in it
    counts = table(spark, root, "documents").filter("is_active").groupBy("document_source_id").agg(F.count("*").alias("n"))
    names = table(spark, root, "document_sources").select(F.col("id").alias("document_source_id"), "name")
    return counts.join(names, "document_source_id").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(10)


@query("SELECT document_id, max(id) AS id, arg_max(version_number, id) AS version_number FROM document_versions GROUP BY document_id")
def latest_versions(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "document_versions").select("document_id", "id", "version_number")
    return changes.latest(v, ["document_id"]).select("document_id", "id", "version_number")


@query("""WITH v AS (SELECT DISTINCT id, document_id, version_number, file_hash FROM document_versions)
SELECT id, document_id, version_number, row_number() OVER (PARTITION BY document_id ORDER BY version_number DESC, id DESC) = 1 AS current,
  file_hash IS DISTINCT FROM lag(file_hash) OVER (PARTITION BY document_id ORDER BY version_number, id) AS changed FROM v""")
def current_versions(spark: SparkSession, root: str) -> DataFrame:
    return versions.current_versions(table(spark, root, "document_versions"))


@query("""SELECT v.id FROM document_versions v WHERE v.id IN (SELECT max(id) FROM document_versions GROUP BY document_id) AND EXISTS (SELECT 1 FROM rule_findings f WHERE f.doc_id = v.document_id AND f.severity IN ('WARNING', 'ERROR', 'CRITICAL')) GROUP BY v.id""")
def latest_with_findings(spark: SparkSession, root: str) -> DataFrame:
    last = table(spark, root, "document_versions").groupBy("document_id").agg(F.max("id").alias("id"))
    bad = table(spark, root, "rule_findings").filter(F.col("severity").isin("WARNING", "ERROR", "CRITICAL")).select(F.col("doc_id").alias("document_id"))
    return last.join(bad, "document_id", "left_semi").select("id")


@query("""SELECT document_source_id AS source_id, count(*) AS scans, CAST(sum(total_found) AS BIGINT) AS total_found, CAST(sum(new_files) AS BIGINT) AS new_files, CAST(sum(modified_files) AS BIGINT) AS modified_files,
  CAST(sum(unchanged_files) AS BIGINT) AS unchanged_files, count(*) FILTER (error_count > 0) AS with_errors FROM (SELECT DISTINCT * FROM scan_logs) GROUP BY 1""")
def scan_totals(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "scan_logs").dropDuplicates(["id"])
    sums = [F.sum(c).alias(c) for c in ("total_found", "new_files", "modified_files", "unchanged_files")]
    return s.groupBy(F.col("document_source_id").alias("source_id")).agg(F.count("*").alias("scans"), *sums, F.count_if(F.col("error_count") > 0).alias("with_errors"))


_LISTED = """prev AS (SELECT document_source_id AS source_id, source_item_id AS item_id, source_etag AS etag, file_size AS size, TIMESTAMP '2024-01-01 00:00:00' AS modified, file_hash AS hash, is_active FROM documents),
new AS (SELECT source_id, item_id, etag, size + (doc_id % 7 = 0)::INT AS size, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id % 2) AS modified, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE hash END AS hash, doc_id % 17 = 0 AS is_remote FROM (SELECT document_source_id AS source_id, source_item_id AS item_id,
  CASE WHEN doc_id % 3 = 0 THEN source_etag || 'x' ELSE source_etag END AS etag, file_size AS size, file_hash AS hash, doc_id FROM documents) WHERE doc_id % 11 <> 0
  UNION ALL SELECT document_source_id, 'new-' || doc_id, NULL, file_size, TIMESTAMP '2024-01-01 00:00:00', file_hash, false FROM documents WHERE doc_id % 13 = 0)"""


def _listing(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The index as the documents table has it, and a later listing derived from it by arithmetic on the key."""
    d = table(spark, root, "documents")
    when = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    later = when + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("doc_id") % 2).cast("decimal(18,6)"))
    index = d.select(
        F.col("document_source_id").alias("source_id"), F.col("source_item_id").alias("item_id"), F.col("source_etag").alias("etag"), F.col("file_size").alias("size"),
        when.alias("modified"), F.col("file_hash").alias("hash"), F.col("is_active").alias("active"),
    )
    etag = F.when(F.col("doc_id") % 3 == 0, F.concat("source_etag", F.lit("x"))).otherwise(F.col("source_etag"))
    kept = d.filter(F.col("doc_id") % 11 != 0).select(
        F.col("document_source_id").alias("source_id"), F.col("source_item_id").alias("item_id"), etag.alias("etag"),
        (F.col("file_size") + (F.col("doc_id") % 7 == 0).cast("int")).alias("size"), later.alias("modified"),
        F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("file_hash")).alias("hash"), (F.col("doc_id") % 17 == 0).alias("is_remote"),
    )
    fresh = d.filter(F.col("doc_id") % 13 == 0).select(
        F.col("document_source_id").alias("source_id"), F.concat(F.lit("new-"), "doc_id").alias("item_id"), F.lit(None).cast("string").alias("etag"), F.col("file_size").alias("size"),
        when.alias("modified"), F.col("file_hash").alias("hash"), F.lit(False).alias("is_remote"),
    )
    return kept.unionByName(fresh), index


_OUTCOMES = f"""WITH {_LISTED}, j AS (SELECT coalesce(n.source_id, p.source_id) AS source_id, coalesce(n.item_id, p.item_id) AS item_id, CASE WHEN p.item_id IS NULL THEN 'NEW' WHEN n.item_id IS NULL THEN CASE WHEN p.is_active THEN 'MISSING' END
  WHEN n.etag IS NOT NULL AND p.etag IS NOT NULL THEN CASE WHEN n.etag <> p.etag THEN 'MODIFIED' ELSE 'UNCHANGED' END WHEN n.size = p.size AND date_trunc('second', n.modified) = date_trunc('second', p.modified) THEN 'UNCHANGED'
  WHEN n.is_remote THEN CASE WHEN n.size IS DISTINCT FROM p.size THEN 'MODIFIED' ELSE 'UNCHANGED' END WHEN n.hash IS NULL THEN 'UNCHANGED' WHEN p.hash IS NULL OR n.hash <> p.hash THEN 'MODIFIED' ELSE 'UNCHANGED' END AS outcome
  FROM new n FULL JOIN prev p ON n.source_id = p.source_id AND n.item_id = p.item_id)"""


@query(f"{_OUTCOMES} SELECT source_id, item_id, outcome FROM j WHERE outcome IS NOT NULL")
def snapshot_diff(spark: SparkSession, root: str) -> DataFrame:
    return versions.snapshot_diff(*_listing(spark, root))


@query(f"""{_OUTCOMES} SELECT source_id, count(*) FILTER (outcome <> 'MISSING') AS total_found, count(*) FILTER (outcome = 'NEW') AS new_files, count(*) FILTER (outcome = 'MODIFIED') AS modified_files,
  count(*) FILTER (outcome = 'UNCHANGED') AS unchanged_files, count(*) FILTER (outcome = 'MISSING') AS deleted_files, count(*) FILTER (outcome IN ('NEW', 'MODIFIED')) AS queued_for_analysis FROM j WHERE outcome IS NOT NULL GROUP BY source_id""")
def scan_counters(spark: SparkSession, root: str) -> DataFrame:
    return versions.scan_counters(versions.snapshot_diff(*_listing(spark, root)))


@query("""SELECT id, name FROM document_sources WHERE enabled AND deleted_at IS NULL AND type <> 'UPLOAD' AND (last_scan_at IS NULL OR last_scan_at <= TIMESTAMP '2026-07-01 00:00:00' - to_minutes(scan_interval_minutes))""")
def due_sources(spark: SparkSession, root: str) -> DataFrame:
    return reports.due(table(spark, root, "document_sources"), F.lit("2026-07-01 00:00:00").cast("timestamp_ntz")).select("id", "name")


@query("SELECT id, document_source_id FROM scan_logs WHERE status = 'FAILED' OR completed_at IS NULL ORDER BY id DESC LIMIT 5")
def last_failed_scans(spark: SparkSession, root: str) -> DataFrame:
    failed = table(spark, root, "scan_logs").filter((F.col("status") == "FAILED") | F.col("completed_at").isNull())
    return failed.orderBy(F.desc("id")).limit(5).select("id", "document_source_id")


@query("""SELECT document_source_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_source_id ORDER BY id DESC) AS r FROM (SELECT DISTINCT id, document_source_id, status FROM scan_logs)) WHERE r <= 3""")
def last_scans_by_source(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "scan_logs").select("id", "document_source_id", "status").distinct()
    return reports.latest_per(s, "document_source_id", "id", 3).select("document_source_id", "id", "status")


@query("SELECT doc_id, compliance_score FROM documents WHERE is_active ORDER BY compliance_score DESC NULLS FIRST, doc_id DESC LIMIT 25 OFFSET 25")
def document_list_page(spark: SparkSession, root: str) -> DataFrame:
    return reports.list_page(table(spark, root, "documents").filter("is_active").select("doc_id", "compliance_score"), "compliance_score", True, "doc_id", page=2)


@query("SELECT doc_id, document_title FROM documents WHERE contains(lower(document_code), 'qa-0') OR contains(lower(document_title), 'qa-0') OR contains(lower(file_name), 'qa-0')")
def search_contains(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").filter(reports.contains_term("QA-0", "document_code", "document_title", "file_name")).select("doc_id", "document_title")


@query("""SELECT finding_id, severity, CASE severity WHEN 'INFO' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'CRITICAL' THEN 4 END AS rank FROM rule_findings GROUP BY ALL ORDER BY rank DESC, finding_id""")
def findings_by_severity(spark: SparkSession, root: str) -> DataFrame:
    s = F.col("severity")
    rank = F.when(s == "INFO", 1).when(s == "WARNING", 2).when(s == "ERROR", 3).when(s == "CRITICAL", 4)
    return table(spark, root, "rule_findings").select("finding_id", "severity", rank.alias("rank")).distinct().orderBy(F.desc("rank"), "finding_id")


@query("SELECT DISTINCT department FROM documents WHERE department IS NOT NULL ORDER BY department")
def departments(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").filter(F.col("department").isNotNull()).select("department").distinct().orderBy("department")


@query("SELECT s.id, count(d.doc_id) AS documents FROM document_sources s LEFT JOIN documents d ON d.document_source_id = s.id GROUP BY s.id")
def documents_by_source(spark: SparkSession, root: str) -> DataFrame:
    counts = table(spark, root, "documents").groupBy(F.col("document_source_id").alias("id")).agg(F.count("*").alias("documents"))
    return table(spark, root, "document_sources").select("id").join(counts, "id", "left").na.fill({"documents": 0})


@query("""SELECT d.doc_id FROM documents d WHERE d.is_active AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM ocr_pages o WHERE o.doc_id = d.doc_id)""")
def documents_without_pages(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").filter("is_active").select("doc_id")
    return d.join(table(spark, root, "segments").select("doc_id"), "doc_id", "left_anti").join(table(spark, root, "ocr_pages").select("doc_id"), "doc_id", "left_anti")


@query("SELECT id, last_scan_at + INTERVAL 8 HOUR AS last_scan_at FROM document_sources")
def shifted_timestamps(spark: SparkSession, root: str) -> DataFrame:
    return reports.shifted(table(spark, root, "document_sources").select("id", "last_scan_at"), ["last_scan_at"], 480)


@query("""SELECT id, array_to_string(list_sort(list_transform(map_entries(configuration), lambda e: e.key || '=' || CASE WHEN contains(e.key, 'zone') THEN '[redacted]' ELSE e.value END)), ';') AS configuration FROM document_sources""")
def redacted_configuration(spark: SparkSession, root: str) -> DataFrame:
    entries = F.transform(F.map_entries(X.redact(F.col("configuration"), ["zone"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, root, "document_sources").select("id", F.array_join(F.sort_array(entries), ";").alias("configuration"))


@query(r"""WITH c AS (SELECT doc_id, nullif(trim(document_code), '') AS old, coalesce(nullif(trim(current_revision), ''), nullif(regexp_extract(file_name, '(?i)(?:^|[^A-Za-z0-9])Rev(?:ision)?\.?\s*([0-9]{1,4})(?:$|[^A-Za-z0-9_])', 1), '')) AS revision FROM documents)
SELECT doc_id, old AS document_code, revision FROM c""")
def metadata_fill(spark: SparkSession, root: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, root, "documents").select("doc_id", grading.fill(F.col("document_code"), none).alias("document_code"), grading.fill(F.col("current_revision"), X.revision(F.col("file_name"))).alias("revision"))


# ---- issues ----


@query(rf"""WITH s AS (SELECT doc_id, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS l, regexp_matches(text, '[{KANA}]') AS o FROM {ONCE}), t AS (SELECT doc_id, sum(l) AS l, count(*) FILTER (o) AS o FROM s GROUP BY doc_id)
SELECT doc_id, 'OCR_REQUIRED' AS issue_type, 'WARNING' AS severity,
  'Almost no readable text could be extracted. This is most likely a scanned document and needs to be reviewed by hand, or re-processed once OCR is enabled.' AS description FROM t WHERE l < 20
UNION ALL SELECT doc_id, 'PARSER_ERROR', 'INFO', o || ' segment(s) contained Japanese or Korean script; their Han characters were not counted as Chinese.' FROM t WHERE o > 0""")
def document_issues(spark: SparkSession, root: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, root, "segments").select("doc_id", "seg_id", F.length(X.letters(t)).alias("l"), X.is_cjk_other(t).alias("o")).distinct()
    totals = rows.groupBy("doc_id").agg(F.sum("l").alias("letters"), F.count_if("o").alias("rejected"))
    return issues.document_issues(totals).select("doc_id", "issue_type", "severity", "description")


@query("""WITH a AS (SELECT DISTINCT doc_id, sequence, name, total_characters, coalesce(characters['en'], 0) AS en, coalesce(characters['id'], 0) AS id, coalesce(characters['zh'], 0) AS zh FROM document_sections WHERE total_characters >= 120),
b AS (SELECT *, greatest(en, id, 3 * zh) AS top, (en > 0)::INT + (id > 0)::INT + (zh > 0)::INT AS present, CASE WHEN en = greatest(en, id, 3 * zh) THEN 'en' WHEN id = greatest(en, id, 3 * zh) THEN 'id' ELSE 'zh' END AS best FROM a),
l AS (SELECT b.*, p.* FROM b, (VALUES ('en', 'English'), ('id', 'Indonesian'), ('zh', 'Chinese')) p(language, label)),
m AS (SELECT *, CASE language WHEN 'en' THEN en WHEN 'id' THEN id ELSE zh END AS n, CASE language WHEN 'en' THEN en WHEN 'id' THEN id ELSE 3 * zh END AS normal,
  CASE best WHEN 'en' THEN 'English' WHEN 'id' THEN 'Indonesian' ELSE 'Chinese' END AS best_label, CASE best WHEN 'en' THEN en WHEN 'id' THEN id ELSE zh END AS best_n FROM l WHERE present > 0)
SELECT doc_id, sequence, 'MISSING_SECTION_TRANSLATION' AS issue_type, 'WARNING' AS severity, language, 'Section ' || chr(39) || name || chr(39) || ' has no ' || label || ' text, although other languages are present in it.' AS description FROM m WHERE n = 0
UNION ALL SELECT doc_id, sequence, 'SHORT_TRANSLATION', 'INFO', language, 'Section ' || chr(39) || name || chr(39) || ' has ' || n || ' characters of ' || label || ' against ' || best_n || ' of ' || best_label || '. Allowing for script density, ' || label ||
  ' is comparable to ' || normal || ' characters of Latin text against ' || top || ' for ' || best_label || '. The translation may be incomplete.' FROM m WHERE present >= 2 AND n > 0 AND normal < 0.35 * top""")
def section_issues(spark: SparkSession, root: str) -> DataFrame:
    found = issues.section_issues(table(spark, root, "document_sections").dropDuplicates(["doc_id", "sequence"]))
    return found.select("doc_id", "sequence", "issue_type", "severity", "language", "description")


@query(f"""WITH {_WIDE}, l AS (SELECT g.doc_id, p.*, CASE p.language WHEN 'en' THEN en WHEN 'id' THEN id ELSE zh END AS n FROM g, (VALUES ('en', 'English', 100), ('id', 'Indonesian', 100), ('zh', 'Chinese', 50)) p(language, label, threshold))
SELECT doc_id, 'LANGUAGE_MISSING' AS issue_type, 'CRITICAL' AS severity, language, label || ' was not detected in this document.' AS description FROM l WHERE n = 0
UNION ALL SELECT doc_id, 'LOW_LANGUAGE_COVERAGE', 'WARNING', language, label || ' is present but has only ' || n || ' of the required ' || threshold || ' characters.' FROM l WHERE n > 0 AND n < threshold
UNION ALL SELECT doc_id, 'UNBALANCED_LANGUAGES', 'WARNING', NULL, 'Every language clears its minimum, but the document scores ' || rtrim(rtrim(printf('%.2f', score), '0'), '.') || ' against the required 80. One language carries most of the content.'
  FROM g WHERE en >= 100 AND id >= 100 AND zh >= 50 AND score < 80""")
def derived_issues(spark: SparkSession, root: str) -> DataFrame:
    return issues.derived_issues(table(spark, root, "language_tallies").distinct()).select("doc_id", "issue_type", "severity", "language", "description")


@query(f"""WITH {_WIDE}, t AS (SELECT doc_id, sum(characters) AS total FROM (SELECT DISTINCT * FROM language_tallies) GROUP BY doc_id)
SELECT doc_id, CASE WHEN total < 20 THEN 'REVIEW_REQUIRED' WHEN en > 0 AND id > 0 AND zh > 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN total > 0 THEN round(((en > 0)::INT + (id > 0)::INT + (zh > 0)::INT) / 3 * 100, 2) END AS score FROM g JOIN t USING (doc_id)""")
def advisory_status(spark: SparkSession, root: str) -> DataFrame:
    return issues.advisory(table(spark, root, "language_tallies").distinct())


@query("""SELECT doc_id, language, CAST(characters AS BIGINT) AS characters, CAST(words AS BIGINT) AS words, CASE WHEN confidence IS NOT NULL THEN least(greatest(confidence, 0), 1) END AS confidence FROM (SELECT DISTINCT * FROM language_tallies) WHERE language IS NOT NULL""")
def payload_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Tallies written into payloads with sections and issues, and read back."""
    tallies, report = table(spark, root, "language_tallies").distinct(), table(spark, root, "document_sections").dropDuplicates(["doc_id", "sequence"])
    return sinks.languages_of(sinks.payload(tallies, report, issues.derived_issues(tallies)))


# ---- listings over time ----


@query(f"""{_OUTCOMES}, i AS (SELECT document_source_id AS source_id, source_item_id AS item_id, document_title AS title, file_hash AS hash, is_active FROM documents)
SELECT j.source_id, j.item_id, i.title, CASE WHEN j.outcome IN ('NEW', 'MODIFIED') THEN n.hash ELSE i.hash END AS hash, CASE WHEN j.outcome = 'MISSING' THEN false WHEN j.outcome IS NOT NULL THEN true ELSE i.is_active END AS active,
  CASE WHEN j.outcome = 'MISSING' THEN TIMESTAMP '2026-07-01 00:00:00' END AS missing_since
FROM j LEFT JOIN i ON i.source_id = j.source_id AND i.item_id = j.item_id LEFT JOIN new n ON n.source_id = j.source_id AND n.item_id = j.item_id""")
def next_index(spark: SparkSession, root: str) -> DataFrame:
    """The index after a complete listing."""
    listing, index = _listing(spark, root)
    titles = table(spark, root, "documents").select(F.col("document_source_id").alias("source_id"), F.col("source_item_id").alias("item_id"), F.col("document_title").alias("title"), F.col("document_code").alias("code"))
    known = index.join(titles, ["source_id", "item_id"]).withColumn("missing_since", F.lit(None).cast("timestamp_ntz"))
    found = versions.next_index(listing, known, F.lit("2026-07-01 00:00:00").cast("timestamp_ntz"))
    return found.select("source_id", "item_id", "title", "hash", "active", "missing_since")


@query(f"""{_OUTCOMES}, i AS (SELECT document_source_id AS source_id, source_item_id AS item_id, is_active, doc_id % 19 = 0 AS deleted FROM documents)
SELECT j.source_id, j.item_id, outcome, outcome <> 'MISSING' AND coalesce(deleted, false) AS restored, outcome = 'UNCHANGED' AND NOT coalesce(i.is_active, true) AS reactivated FROM j LEFT JOIN i ON i.source_id = j.source_id AND i.item_id = j.item_id WHERE outcome IS NOT NULL""")
def lifecycle(spark: SparkSession, root: str) -> DataFrame:
    """Outcomes of a listing, with what came back."""
    listing, index = _listing(spark, root)
    gone = table(spark, root, "documents").select(F.col("document_source_id").alias("source_id"), F.col("source_item_id").alias("item_id"), (F.col("doc_id") % 19 == 0).alias("deleted"))
    return versions.lifecycle(listing, index.join(gone, ["source_id", "item_id"]))


@query("""WITH v AS (SELECT DISTINCT id, document_id, version_number, is_current FROM document_versions), c AS (SELECT doc_id FROM documents WHERE doc_id % 9 = 0)
SELECT document_id, version_number, is_current AND c.doc_id IS NULL AS is_current FROM v LEFT JOIN c ON c.doc_id = v.document_id
UNION ALL SELECT doc_id, coalesce(max(version_number), 0) + 1, true FROM c LEFT JOIN v ON v.document_id = c.doc_id GROUP BY doc_id""")
def appended_versions(spark: SparkSession, root: str) -> DataFrame:
    """The versions after some documents changed."""
    changed = table(spark, root, "documents").filter(F.col("doc_id") % 9 == 0).select(F.col("doc_id").alias("document_id"), F.col("current_revision").alias("revision_label"), "file_hash")
    return versions.append_versions(table(spark, root, "document_versions"), changed).select("document_id", "version_number", "is_current")


@query(f"""{_OUTCOMES}, c AS (SELECT source_id, count(*) FILTER (outcome <> 'MISSING') AS a, count(*) FILTER (outcome = 'NEW') AS b, count(*) FILTER (outcome = 'MODIFIED') AS c, count(*) FILTER (outcome = 'UNCHANGED') AS d,
  count(*) FILTER (outcome = 'MISSING') AS e, count(*) FILTER (outcome IN ('NEW', 'MODIFIED')) AS f, source_id % 3 AS g FROM j WHERE outcome IS NOT NULL GROUP BY source_id)
SELECT source_id, CASE WHEN g > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status, a || ' found · ' || b || ' new · ' || c || ' modified · ' || d || ' unchanged · ' || e || ' missing · ' || f || ' queued · ' || g || ' errors' AS message FROM c""")
def scan_log(spark: SparkSession, root: str) -> DataFrame:
    counters = versions.scan_counters(versions.snapshot_diff(*_listing(spark, root)))
    return versions.scan_log(counters.withColumns({"error_count": F.col("source_id") % 3, "duration_ms": F.lit(0)})).drop("duration_ms")


@query("SELECT doc_id, document_title FROM documents WHERE analysis_status = 'PENDING' AND created_at < TIMESTAMP '2026-06-01 00:00:00' - INTERVAL 24 HOUR")
def stalled_documents(spark: SparkSession, root: str) -> DataFrame:
    return changes.stalled(table(spark, root, "documents"), "PENDING", "created_at", 24, F.lit("2026-06-01 00:00:00").cast("timestamp_ntz"), "analysis_status").select("doc_id", "document_title")


# ---- order, sections, names ----


@query(f"SELECT seg_id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(page, 0), seg_index, seg_id) AS position FROM {ONCE}")
def page_order(spark: SparkSession, root: str) -> DataFrame:
    return sections.in_page_order(table(spark, root, "segments").select("seg_id", "doc_id", "page", "seg_index").distinct()).select("seg_id", F.col("position").cast("bigint"))


@query(f"""WITH r AS (SELECT DISTINCT doc_id, sequence, coalesce(name, '') AS name, page FROM document_sections), s AS (SELECT DISTINCT doc_id, seg_id, page, coalesce(section, '') AS section FROM {ONCE}),
p AS (SELECT r.doc_id, sequence, seg_id FROM r JOIN s ON s.doc_id = r.doc_id AND s.page = r.page)
SELECT * FROM p UNION ALL SELECT r.doc_id, r.sequence, seg_id FROM r JOIN s ON s.doc_id = r.doc_id AND s.section = r.name WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = r.doc_id AND p.sequence = r.sequence)""")
def section_segments(spark: SparkSession, root: str) -> DataFrame:
    return sections.segments_of(table(spark, root, "document_sections"), table(spark, root, "segments"))


@query(rf"""WITH {_ISLANDS}, s AS (SELECT n.doc_id, n.sequence, n.text, CASE WHEN regexp_matches(n.text, '[{KANA}]') THEN 0 ELSE length(regexp_replace(n.text, '[^{HAN}]', '', 'g')) END AS h,
  length(regexp_replace(regexp_replace(n.text, '[{HAN}]', '', 'g'), '[^\p{{L}}]', '', 'g')) AS l FROM n WHERE trim(n.text) <> ''),
b AS (SELECT doc_id, sequence, {_DOMINANT} AS language, count(*) AS n FROM s GROUP BY ALL)
SELECT doc_id, CAST(sequence AS BIGINT) AS sequence, max(n) AS rows FROM b GROUP BY ALL""")
def compared_rows(spark: SparkSession, root: str) -> DataFrame:
    """How many rows each section takes side by side."""
    blocks = alignment.aligned_blocks(sections.once(table(spark, root, "segments")))
    return alignment.compared_rows(blocks).select("doc_id", F.col("sequence").cast("bigint"), F.col("rows").cast("bigint"))


@query(r"""SELECT doc_id, nullif(trim(regexp_extract(file_name, '([A-Z]{2,4})-([0-9]+)', 2)), '') AS number, CAST(NULL AS VARCHAR) AS broken, CAST(NULL AS VARCHAR) AS beyond FROM documents""")
def user_patterns(spark: SparkSession, root: str) -> DataFrame:
    """First matches of users' patterns; one that does not compile and a group too many give null."""
    name, pattern = F.col("file_name"), "([A-Z]{2,4})-([0-9]+)"
    return table(spark, root, "documents").select("doc_id", X.first_match(name, pattern, 2).alias("number"), X.first_match(name, "([A-Z").alias("broken"), X.first_match(name, pattern, 3).alias("beyond"))


@query(r"""SELECT doc_id, sha256(text) AS hash, regexp_extract(replace(file_path, '\', '/'), '([^/]*)$', 1) AS base, regexp_extract(replace(file_path, '\', '/'), '^(.*)/[^/]*$', 1) AS parent,
  regexp_replace(regexp_extract(replace(file_name, '\', '/'), '([^/]*)$', 1), '[<>:"|?*]', '_', 'g') AS safe, substring(document_title, 1, 32) AS title FROM documents""")
def content_and_paths(spark: SparkSession, root: str) -> DataFrame:
    name = F.col("file_name")
    return table(spark, root, "documents").select(
        "doc_id", X.content_hash(F.encode("text", "UTF-8")).alias("hash"), X.base_name(F.col("file_path")).alias("base"), X.parent(F.col("file_path")).alias("parent"),
        X.safe_file_name(name).alias("safe"), X.truncated(F.col("document_title"), 32).alias("title"),
    )


@query("SELECT id, CASE WHEN duration_ms IS NULL THEN '—' WHEN duration_ms < 1000 THEN duration_ms || ' ms' ELSE printf('%.1f s', round(duration_ms / 1000, 1)) END AS took FROM (SELECT DISTINCT id, duration_ms FROM scan_logs)")
def scan_durations(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "scan_logs").select("id", "duration_ms").distinct().select("id", X.human_duration(F.col("duration_ms")).alias("took"))


@query("""SELECT document_id, max(version_number) + 1 AS version_number FROM document_versions GROUP BY document_id""")
def next_version_numbers(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "document_versions").groupBy("document_id").agg((F.max("version_number") + 1).alias("version_number"))


@query("""WITH s AS (SELECT DISTINCT id, started_at, status FROM scan_logs), n AS (SELECT status AS key, CAST(count(*) AS VARCHAR) AS value, max(id) AS id FROM s GROUP BY status)
SELECT 'old' AS key, 'kept' AS value UNION ALL SELECT key, value FROM n""")
def settings_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Stored settings after changes: one key kept, one overwritten, the others new."""
    n = table(spark, root, "scan_logs").select("id", "status").distinct().groupBy(F.col("status").alias("key")).agg(F.count("*").cast("string").alias("value"), F.max("id").alias("id"))
    stored = spark.createDataFrame([("old", "kept"), ("FAILED", "stale")], "key string, value string")
    return reports.settings_after(stored, n)


@query("""SELECT file_hash, min(extension) AS extension, count(*) AS files FROM documents WHERE file_hash IS NOT NULL GROUP BY file_hash""")
def contents_once(spark: SparkSession, root: str) -> DataFrame:
    """One row a content: what is computed from it is computed once."""
    return reports.once_by_hash(table(spark, root, "documents"), "file_hash", "extension")
