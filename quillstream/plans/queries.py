"""A query for each operator, over stand-in observations, beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.config import Detection, Gate, Grammar, Layout, Region, Resolution, Settings
from quillstream.functions import distance, geometry, text
from quillstream.operators import consolidate, detect, gate, grammar, layout, read, resolve, start, vocabulary
from quillstream.plans import adapters, markers, report
from quillstream.plans.adapters import BOXES, DPI, LINES, SHEETS, TURNS, table
from quillstream.schema import VOCABULARY_ENTRIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


# ---- texts -----------------------------------------------------------------------------------


def _texts(spark, sf_dir):
    return adapters.lines(spark, sf_dir).select("raw", (F.col("box")["x"] <= 4).alias("edge")).distinct()


TEXTS = f"{LINES}, texts AS (SELECT DISTINCT raw, x <= 4 AS edge FROM lines)"
#: Prefixes in their fixed order, longest first.
_KNOWN = grammar.prefixes(Grammar())
_EXACT = " ".join(f"WHEN letters = '{p}' THEN '{p}'" for p in _KNOWN)
_ENDS = " ".join(f"WHEN letters LIKE '%{p}' AND length(letters) - {len(p)} <= 2 THEN '{p}'" for p in _KNOWN)
_VALID = "(regexp_full_match(t, '[0-9]+') AND length(t) <= 2 OR regexp_full_match(t, '[A-Za-z]+') AND (length(t) = 1 OR regexp_full_match(t, '(?:x{0,3})(?:ix|iv|v?i{0,3})')))"
_SEPARATOR = "strpos('().-:_,/[]{}''\"`~;', t) > 0"
PARSED = rf"""{TEXTS},
tok AS (SELECT *, regexp_extract_all(raw, '[0-9]+|[A-Za-z]+|\S') AS tokens FROM texts),
fst AS (SELECT *, coalesce(list_position(list_transform(tokens, lambda t: regexp_full_match(t, '[0-9]+')), true), 0) AS fi FROM tok),
hed AS (SELECT *, upper(array_to_string(list_filter(CASE WHEN fi > 0 THEN tokens[1:fi - 1] ELSE tokens END, lambda t: regexp_full_match(t, '[A-Za-z]+')), '')) AS letters,
  CASE WHEN fi > 0 THEN tokens[fi] END AS number, CASE WHEN fi > 0 THEN tokens[fi + 1:] ELSE [] END AS rest FROM fst),
pre AS (SELECT *, CASE WHEN letters = '' THEN NULL {_EXACT} {_ENDS} END AS prefix,
  coalesce(list_position(list_transform(rest, lambda t: NOT ({_SEPARATOR} OR {_VALID})), true), len(rest) + 1) AS stop FROM hed),
seg AS (SELECT *, list_concat([number], list_transform(list_filter(rest[1:stop - 1], lambda t: NOT ({_SEPARATOR})), lambda t: lower(t))) AS all_segments,
  array_to_string(rest[stop:], '') AS tail,
  CASE WHEN letters <> '' AND prefix IS NULL THEN letters WHEN prefix IS NULL THEN '' ELSE letters[1:length(letters) - length(prefix)] END AS left_over FROM pre),
knd AS (SELECT *, CASE WHEN fi = 0 THEN CASE WHEN prefix IS NOT NULL THEN 'PREFIX_ONLY' ELSE 'NOT_A_MARKER' END
  WHEN letters <> '' AND prefix IS NULL AND length(letters) > 2 THEN 'NOT_A_MARKER'
  WHEN length(number) > 4 OR length(number) > 3 AND NOT edge THEN 'NOT_A_MARKER' ELSE 'MARKER' END AS kind FROM seg),
parsed AS (SELECT raw, edge, kind, CASE WHEN kind <> 'NOT_A_MARKER' THEN prefix END AS prefix, CASE WHEN kind = 'MARKER' THEN left_over ELSE '' END AS residue,
  CASE WHEN kind = 'MARKER' THEN all_segments ELSE []::VARCHAR[] END AS segments, CASE WHEN kind = 'MARKER' THEN tail ELSE '' END AS after_text,
  CASE WHEN kind = 'MARKER' THEN list_filter([CASE WHEN left_over <> '' THEN 'PREFIX_RESIDUE' END, CASE WHEN regexp_matches(tail, '[\p{{L}}\p{{N}}]') THEN 'LINE_TRIMMED' END], lambda f: f IS NOT NULL) ELSE []::VARCHAR[] END AS parse_flags FROM knd)"""


def _parsed(spark, sf_dir):
    return grammar.parse(_texts(spark, sf_dir), Grammar(), F.col("edge"), "raw")


@query(rf"WITH {TEXTS} SELECT DISTINCT raw, array_to_string(regexp_extract_all(raw, '[0-9]+|[A-Za-z]+|\S'), '|') AS tokens FROM texts")
def g02_tokenise(spark, sf_dir):
    return _texts(spark, sf_dir).select("raw", F.array_join(text.tokens(F.col("raw")), "|").alias("tokens")).distinct()


@query(f"WITH {PARSED} SELECT DISTINCT raw, kind, prefix, residue FROM parsed")
def g04_prefix_match(spark, sf_dir):
    return _parsed(spark, sf_dir).select("raw", "kind", "prefix", "residue").distinct()


@query(f"WITH {PARSED} SELECT raw, edge, kind, array_to_string(segments, '|') AS segments, after_text, array_to_string(parse_flags, ',') AS parse_flags FROM parsed")
def g09_segments(spark, sf_dir):
    return _parsed(spark, sf_dir).select("raw", "edge", "kind", F.array_join("segments", "|").alias("segments"), F.col("trailing").alias("after_text"), F.array_join("parse_flags", ",").alias("parse_flags"))


VARIANTS = f"""{PARSED},
variants AS (
  SELECT raw, edge, s.s AS noise_stripped, t.t AS trimmed, list_concat([segments[1][s.s + 1:]], segments[2:len(segments) - t.t]) AS variant,
    s.s * len(segments) + t.t AS pos
  FROM parsed, unnest(range(2)) AS s(s), unnest(range(len(segments)::BIGINT)) AS t(t)
  WHERE kind = 'MARKER' AND s.s <= CASE WHEN edge THEN least(1, length(segments[1]) - 1) ELSE 0 END)"""


@query(f"WITH {VARIANTS} SELECT raw, edge, noise_stripped::INT AS noise_stripped, trimmed::INT AS trimmed, pos::INT AS pos, array_to_string(variant, '|') AS variant FROM variants")
def g11_variants(spark, sf_dir):
    v = _parsed(spark, sf_dir).select("raw", "edge", F.posexplode("variants").alias("pos", "v"))
    return v.select("raw", "edge", F.col("v.noise_stripped").alias("noise_stripped"), F.col("v.trimmed").alias("trimmed"), "pos", text.key(F.col("v.segments")).alias("variant"))


@query(f"""WITH {PARSED} SELECT DISTINCT array_to_string(segments, '|') AS key, array_to_string(segments, '') AS flat,
segments[1] || array_to_string(list_transform(segments[2:], lambda s: '(' || s || ')'), '') AS display FROM parsed WHERE kind = 'MARKER'""")
def g13_forms(spark, sf_dir):
    s = F.col("segments")
    return _parsed(spark, sf_dir).where("kind = 'MARKER'").select(text.key(s).alias("key"), text.flat(s).alias("flat"), text.display(s).alias("display")).distinct()


@query(r"""SELECT DISTINCT lower(w) AS word, w <> '' AND regexp_matches(lower(w), '^(?:x{0,3})(?:ix|iv|v?i{0,3})$') AS is_roman
FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT unnest(['i', 'iv', 'xxxix', 'iiii', '', 'xl', 'v']))""")
def g14_is_roman(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    words = words.unionAll(spark.createDataFrame([(x,) for x in ("i", "iv", "xxxix", "iiii", "", "xl", "v")], "w string"))
    return words.select(F.lower("w").alias("word")).distinct().withColumn("is_roman", text.is_roman(F.col("word")))


@query(r"""SELECT DISTINCT p_brand, array_to_string(list_transform(regexp_extract_all(p_brand, '[0-9]+|[A-Za-z]+'), lambda s: lower(s)), '|') AS segments,
regexp_full_match(p_brand, '[0-9A-Za-z()\[\].\-\s]+') AS allowed FROM part""")
def g15_split_segments(spark, sf_dir):
    b = F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_brand", text.key(text.split_segments(b)).alias("segments"), text.allowed_id(b).alias("allowed")).distinct()


@query(None)
def g01_normal_form(spark, sf_dir):
    return text.normalised(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "normal").select("doc_id", F.sha2("normal", 256).alias("digest"), F.length("normal").alias("n"))


# ---- resolution ------------------------------------------------------------------------------

_SETTINGS = Resolution()
_SUBS, _DELS = distance.folded_costs(_SETTINGS.confusions)
_SUB = "CASE o || t " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _SUBS.items()) + " ELSE 1.0::DOUBLE END"
_DEL = "CASE o " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _DELS.items()) + " ELSE 1.0::DOUBLE END"


def _distance_sql(pairs: str) -> str:
    """CTE distances(a, b, d) from a CTE of distinct pairs (a, b), a row of the table for each observed character."""
    base = f"list_transform(range(0, length(b) + 1), lambda k: CASE WHEN k = 0 THEN cost[1] + del ELSE least(cost[k + 1] + del, cost[k] + CASE WHEN o = b[k] THEN 0 ELSE {_SUB.replace('o || t', 'o || b[k]')} END) END)"
    return f"""
steps(a, b, i, cost) AS (
  SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda j: j::DOUBLE) FROM {pairs}
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k: low[k + 1] + (j - k)))) FROM (
    SELECT a, b, i, {base} AS low FROM (SELECT *, a[i + 1] AS o, {_DEL.replace('CASE o ', 'CASE a[i + 1] ')} AS del FROM steps WHERE i < length(a)))),
distances AS (SELECT a, b, cost[length(b) + 1] AS d FROM steps WHERE i = length(a))"""


_WORDS = ", ".join(f"('{x}')" for x in adapters.IDENTIFIERS)
VOCABULARY = rf"""
vocab AS (
  SELECT w AS raw, (row_number() OVER () - 1)::INT AS ord, list_transform(regexp_extract_all(w, '[0-9]+|[A-Za-z]+'), lambda s: lower(s)) AS segments FROM (VALUES {_WORDS}) v(w)),
words AS (SELECT *, array_to_string(segments, '|') AS key, array_to_string(segments, '') AS flat, segments[1] || array_to_string(list_transform(segments[2:], lambda s: '(' || s || ')'), '') AS canonical FROM vocab),
targets AS (SELECT ord, key, flat, canonical FROM words w WHERE NOT EXISTS (SELECT 1 FROM words c WHERE starts_with(c.key, w.key || '|')))"""
SCORES = f"""{VARIANTS}, {VOCABULARY},
pairs AS (SELECT DISTINCT array_to_string(variant, '') AS a, flat AS b FROM variants, targets),
{_distance_sql('pairs')},
scored AS (
  SELECT raw, edge, canonical AS question, ord, pos, noise_stripped, trimmed, array_to_string(variant, '|') AS vkey, array_to_string(variant, '|') = key AS exact,
    CASE WHEN array_to_string(variant, '|') = key THEN 1.0 ELSE greatest(0.0, 1 - d / greatest(length(a), length(b), 1)) END - (noise_stripped * 0.15::DOUBLE + trimmed * 0.1::DOUBLE) AS score
  FROM variants, targets, distances WHERE a = array_to_string(variant, '') AND b = flat),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY raw, edge, question ORDER BY score DESC, exact DESC, pos) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY raw, edge ORDER BY score DESC, exact DESC, ord) AS rank FROM best),
tops AS (SELECT raw, edge, max(CASE WHEN rank = 1 THEN score END) AS s1, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS s2, bool_or(rank = 1 AND exact) AS e1, bool_or(rank = 2 AND exact) AS e2,
  max(CASE WHEN rank = 1 THEN question END) AS q1, max(CASE WHEN rank = 1 THEN vkey END) AS vkey, max(CASE WHEN rank = 1 THEN noise_stripped END) AS ns, max(CASE WHEN rank = 1 THEN trimmed END) AS tr,
  string_agg(CASE WHEN rank <= 5 THEN question END, ',' ORDER BY rank) AS candidates FROM ranked GROUP BY ALL),
decided AS (SELECT *, greatest(0.0, s1 - s2) AS margin, e1 AND NOT (e2 AND s2 = s1) AS sure FROM tops),
resolved AS (SELECT raw, edge, CASE WHEN sure THEN 'RESOLVED' WHEN s1 >= 0.6 AND margin >= 0.2 THEN 'RESOLVED' WHEN s1 >= 0.6 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS outcome,
  CASE WHEN sure THEN 'EXACT_UNIQUE' WHEN s1 >= 0.6 AND margin >= 0.2 THEN 'CONSTRAINED_UNIQUE' ELSE 'NONE' END AS method,
  CASE WHEN sure OR s1 >= 0.6 AND margin >= 0.2 THEN q1 END AS question, least(1.0, greatest(0.0, s1)) AS confidence, margin, candidates, vkey, ns, tr FROM decided)"""


def _resolved(spark, sf_dir):
    parsed = _parsed(spark, sf_dir).withColumn("exam_id", F.lit("EXAM"))
    return resolve.resolve(parsed, adapters.identifiers(spark), _SETTINGS)


@query(f"WITH RECURSIVE {PARSED}, {VOCABULARY}, pairs AS (SELECT DISTINCT array_to_string(segments, '') AS a, flat AS b FROM parsed, targets WHERE kind = 'MARKER'), {_distance_sql('pairs')} SELECT a AS observed, b AS target, round(d, 6) AS distance FROM distances")
def a01_weighted_distance(spark, sf_dir):
    seen = _parsed(spark, sf_dir).where("kind = 'MARKER'").select(text.flat(F.col("segments")).alias("observed")).distinct()
    targets = adapters.identifiers(spark).where("is_target").select(F.col("flat").alias("target")).distinct()
    pairs = seen.withColumn("_k", F.lit(1)).join(F.broadcast(targets.withColumn("_k", F.lit(1))), "_k")
    return pairs.select("observed", "target", F.round(distance.weighted_distance(F.col("observed"), F.col("target"), _SETTINGS), 6).alias("distance")).distinct()


@query(f"WITH RECURSIVE {SCORES} SELECT raw, edge, question, round(score, 6) AS score, exact FROM best")
def a04_best_variant(spark, sf_dir):
    parsed = _parsed(spark, sf_dir).where("kind = 'MARKER'").withColumn("exam_id", F.lit("EXAM")).withColumn("reading", F.struct("raw", "edge"))
    s = resolve.scores(parsed, adapters.identifiers(spark), _SETTINGS)
    return s.select("reading.raw", "reading.edge", "question", F.round("score", 6).alias("score"), "exact")


@query(f"WITH RECURSIVE {SCORES} SELECT raw, edge, candidates, round(margin, 6) AS margin FROM resolved")
def a06_top_candidates(spark, sf_dir):
    r = _resolved(spark, sf_dir).where("kind = 'MARKER'")
    return r.select("raw", "edge", F.array_join(F.transform("candidates", lambda c: c["question_id"]), ",").alias("candidates"), F.round("resolution_margin", 6).alias("margin"))


@query(f"WITH RECURSIVE {SCORES} SELECT raw, edge, outcome, method, question, round(confidence, 6) AS confidence, vkey AS matched_key FROM resolved")
def a08_decision(spark, sf_dir):
    r = _resolved(spark, sf_dir).where("kind = 'MARKER'")
    return r.select("raw", "edge", "outcome", "method", "question", F.round("resolution_confidence", 6).alias("confidence"), "matched_key")


@query(
    "SELECT lower(o) || lower(e) AS pair, min(cost) AS cost FROM (VALUES "
    + ", ".join(f"('{o}', '{e}', {c}::DOUBLE)" for o, e, c in _SETTINGS.confusions)
    + ") v(o, e, cost) GROUP BY ALL"
)
def a10_confusion_folding(spark, sf_dir):
    substitute, delete = distance.folded_costs(_SETTINGS.confusions)
    return spark.createDataFrame(list({**substitute, **delete}.items()), "pair string, cost double")


# the whole way from observation to gate
_GATED = f"""{SCORES},
facts AS (
  SELECT l.*, p.kind, p.parse_flags, r.outcome, r.method, r.question, r.confidence, r.margin, r.ns, r.tr,
    coalesce(r.question IN ('1(1)', '11'), false) AS confusable,
    CASE WHEN p.kind = 'NOT_A_MARKER' THEN 'NOT_A_MARKER_PATTERN' WHEN length(regexp_replace(l.raw, '[^\\p{{L}}\\p{{N}}]', '', 'g')) = 1 AND l.width > 1.3 * l.height THEN 'IMPLAUSIBLE_SHAPE' END AS odd,
    CASE WHEN y + height / 2.0 < 235 THEN -1 ELSE least(34, floor((y + height / 2.0 - 235) / 74))::INT END AS band
  FROM lines l JOIN parsed p ON l.raw = p.raw AND (l.x <= 4) = p.edge LEFT JOIN resolved r ON r.raw = p.raw AND r.edge = p.edge),
headed AS (SELECT f.*, CASE WHEN odd IS NULL AND kind = 'PREFIX_ONLY' AND EXISTS (SELECT 1 FROM facts o WHERE o.script_id = f.script_id AND o.page_index = f.page_index AND o.odd IS NULL AND o.kind = 'MARKER' AND o.y >= f.y AND abs(o.band - f.band) <= 2) THEN 'HEADER_TOKEN' ELSE odd END AS discard_reason FROM facts f),
gated AS (SELECT *, list_distinct_ordered FROM (SELECT *, [] AS list_distinct_ordered FROM headed))"""
GATED = _GATED.rsplit(",\ngated AS", 1)[0]


def _pages(spark, observations):
    ruled = F.array(*(F.lit(235 + 74 * i) for i in range(35)))
    shape = F.struct(F.lit(True).alias("found"), F.lit(100).alias("margin_rule_x"), F.lit(235).alias("header_y"), ruled.alias("ruled_line_ys"), F.lit(74.0).alias("line_pitch_px"))
    ink = F.transform(F.sequence(F.lit(0), F.lit(34)), lambda i: F.when((i + F.col("page_index")) % 4 == 0, 0.01).otherwise(0.001))
    pages = observations.select("script_id", "page_index").distinct()
    return pages.select("*", F.lit(DPI).alias("dpi"), (F.col("page_index") % 5 != 0).alias("is_colour"), shape.alias("layout"), ink.alias("band_ink"), F.lit(1488).alias("image_width"), F.lit(2800).alias("image_height"), geometry.identity().alias("work_to_canonical"))


def _classified(spark, sf_dir):
    observations = adapters.lines(spark, sf_dir)
    return markers.classified(observations, _pages(spark, observations), adapters.identifiers(spark), Settings())


START = f"""{GATED},
nexts AS (SELECT *, CASE WHEN discard_reason IS NULL THEN lead(band) OVER (PARTITION BY script_id, page_index, discard_reason IS NULL ORDER BY y, candidate_pos) END AS next_band FROM headed),
found AS (SELECT *, list_min(list_filter([0, 1, 2, 3], lambda o: (o = 0 OR next_band IS NULL OR greatest(0, band) + o < next_band) AND greatest(0, band) + o < 35 AND (greatest(0, band) + o + page_index) % 4 = 0)) AS lines_below FROM nexts),
starts AS (SELECT *, 235 + 74 * (greatest(0, band) + coalesce(lines_below, 0)) AS start_y, CASE WHEN lines_below IS NULL THEN 0.3 WHEN lines_below = 0 THEN 0.95 WHEN lines_below <= 2 THEN 0.85 ELSE 0.7 END AS start_confidence FROM found),
reasoned AS (SELECT *, list_filter([
    CASE WHEN outcome = 'AMBIGUOUS' THEN 'AMBIGUOUS' END,
    CASE WHEN recognition_confidence < greatest(0.8, CASE WHEN list_contains(parse_flags, 'LINE_TRIMMED') OR ns > 0 OR tr > 0 THEN 0.92 ELSE 0 END, CASE WHEN page_index % 5 = 0 THEN 0.9 ELSE 0 END) THEN 'LOW_RECOGNITION_CONFIDENCE' END,
    CASE WHEN confusable AND outcome IS DISTINCT FROM 'AMBIGUOUS' THEN 'AMBIGUOUS' END,
    CASE WHEN start_confidence < 0.6 THEN 'START_UNCERTAIN' END], lambda r: r IS NOT NULL) AS why FROM starts),
done AS (SELECT *, CASE WHEN discard_reason IS NOT NULL THEN 'DISCARDED' WHEN kind = 'PREFIX_ONLY' OR outcome = 'NO_MATCH' THEN 'UNRESOLVED' WHEN len(why) > 0 THEN 'REVIEW_REQUIRED' ELSE 'ACCEPTED' END AS status,
  CASE WHEN discard_reason IS NOT NULL THEN '' WHEN kind = 'PREFIX_ONLY' THEN 'PREFIX_WITHOUT_ID' WHEN outcome = 'NO_MATCH' THEN 'NO_MATCH' ELSE array_to_string(why, ',') END AS reasons FROM reasoned)"""


@query(f"WITH RECURSIVE {START} SELECT script_id, page_index, candidate_pos, kind, discard_reason, status, reasons FROM done")
def d01_gate(spark, sf_dir):
    return _classified(spark, sf_dir).select("script_id", "page_index", "candidate_pos", "kind", "discard_reason", "status", F.array_join("review_reasons", ",").alias("reasons"))


@query(f"WITH RECURSIVE {START} SELECT script_id, page_index, candidate_pos, lines_below::INT AS lines_below, start_y::INT AS start_y, start_confidence::DOUBLE AS start_confidence FROM starts WHERE discard_reason IS NULL")
def d04_question_start(spark, sf_dir):
    rows = _classified(spark, sf_dir).where("discard_reason is null")
    return rows.select("script_id", "page_index", "candidate_pos", "lines_below", "start_y", "start_confidence")


@query(f"WITH RECURSIVE {START} SELECT script_id, page_index, count(*) FILTER (status <> 'DISCARDED')::INT AS marker_count FROM done GROUP BY ALL")
def a13_marker_counts(spark, sf_dir):
    pages = _pages(spark, adapters.lines(spark, sf_dir)).select("script_id", "page_index")
    return consolidate.page_counts(pages, _classified(spark, sf_dir))


@query(f"WITH RECURSIVE {START} SELECT coalesce(question, '-') AS question, status, count(*) AS n FROM done GROUP BY ALL")
def a14_status_counts(spark, sf_dir):
    rows = _classified(spark, sf_dir).withColumn("question", F.coalesce("question", F.lit("-")))
    return report.status_counts(rows, "question")


@query(f"WITH RECURSIVE {START} SELECT r AS reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS r FROM done WHERE status = 'REVIEW_REQUIRED') GROUP BY ALL")
def x04_review_rates(spark, sf_dir):
    return report.review_rates(_classified(spark, sf_dir))


_VERSION = Settings().processing_version()
_CONSTANTS = {
    "ocr_engine": "scripted", "ocr_model": "none", "ocr_model_version": "0", "preprocessing_version": markers.PREPROCESSING_VERSION, "grammar_version": Grammar().version,
    "parser_version": markers.PARSER_VERSION, "question_list_version": "unversioned", "config_version": _VERSION, "processing_version": _VERSION, "source": "AUTOMATIC",
}


@query(f"""WITH RECURSIVE {START}, d AS (
  SELECT d.*, r.candidates, r.vkey, p.segments, format('{{}}-P{{:03d}}', d.script_id, d.page_index) AS page_id, coalesce(d.method, 'NONE') AS resolution_method
  FROM done d JOIN parsed p ON p.raw = d.raw AND p.edge = (d.x <= 4) LEFT JOIN resolved r ON r.raw = d.raw AND r.edge = (d.x <= 4))
SELECT sha1(script_id || '|' || page_id || '|{_VERSION}|' || band || '|' || (x // 39) || '|' || y)[1:16] AS marker_result_id, script_id, exam_id, page_id, page_index, candidate_pos, band AS line_index,
  raw AS raw_ocr_text, CASE WHEN kind = 'MARKER' THEN segments[1] || array_to_string(list_transform(segments[2:], lambda s: '(' || s || ')'), '') END AS parsed_marker, vkey AS normalized_marker, question, coalesce(candidates, '') AS candidates,
  resolution_method, array_to_string(list_concat(parse_flags, list_filter([CASE WHEN ns > 0 THEN 'NOISE_STRIPPED' END, CASE WHEN tr > 0 AND NOT list_contains(parse_flags, 'LINE_TRIMMED') THEN 'LINE_TRIMMED' END], lambda f: f IS NOT NULL)), ',') AS parse_flags,
  round_even(detection_confidence, 4) AS detection_confidence, round_even(recognition_confidence, 4) AS recognition_confidence, round_even(recognition_confidence, 4) AS recognition_confidence_raw,
  round_even(confidence, 4)::DOUBLE AS resolution_confidence, round_even(margin, 4)::DOUBLE AS resolution_margin, 1488 AS image_width, 2800 AS image_height, 200.0::DOUBLE AS dpi,
  x AS marker_x, y AS marker_y, width AS marker_width, height AS marker_height, CASE WHEN discard_reason IS NULL THEN 100 END AS question_start_x, CASE WHEN discard_reason IS NULL THEN start_y::INT END AS question_start_y,
  CASE WHEN discard_reason IS NULL THEN 'LANDMARK_LINE' END AS question_start_method, CASE WHEN discard_reason IS NULL THEN start_confidence::DOUBLE END AS question_start_confidence, status, reasons AS review_reasons, discard_reason,
  {", ".join(f"'{v}' AS {k}" for k, v in _CONSTANTS.items())} FROM d""")
def d12_marker_rows(spark, sf_dir):
    observations = adapters.lines(spark, sf_dir)
    pages = _pages(spark, observations)
    rows = markers.assembled(markers.classified(observations, pages, adapters.identifiers(spark), Settings()), pages, Settings()).drop("marker_polygon")
    named = F.array_join(F.transform("candidate_list", lambda c: c["question_id"]), ",").alias("candidates")
    lists = [F.array_join(c, ",").alias(c) for c in ("parse_flags", "review_reasons")]
    return rows.select(*(c for c in rows.columns if c not in ("candidate_list", "parse_flags", "review_reasons")), named, *lists)


# ---- geometry and scalars --------------------------------------------------------------------


def _pairs(spark, sf_dir):
    b = adapters.boxes(spark, sf_dir).select("candidate_pos", F.col("box").alias("a"))
    other = F.col("candidate_pos") * 7 % 997
    return b.withColumn("b", geometry.box(other % 150, other % 97 * 20, 1 + other % 41, 1 + other % 31))


PAIRS = f"""{BOXES},
pairs AS (SELECT candidate_pos, x AS ax, y AS ay, width AS aw, height AS ah, (o % 150)::INT AS bx, (o % 97 * 20)::INT AS b_y, (1 + o % 41)::INT AS bw, (1 + o % 31)::INT AS bh
  FROM (SELECT *, candidate_pos * 7 % 997 AS o FROM boxes))"""


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity * (150 + 25 * l_linenumber) / 25.4, 0)::INT AS px FROM lineitem")
def p01_mm_to_px(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", geometry.mm_to_px(F.col("l_quantity"), 150.0 + 25 * F.col("l_linenumber")).alias("px"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9._-]+', '_', 'g') AS script_id,
regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9._-]+', '_', 'g') || '-P' || lpad((page_id % 40)::VARCHAR, 3, '0') AS page FROM pages""")
def p02_script_and_page_id(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", text.script_id(F.col("url")).alias("script_id"))
    return df.withColumn("page", text.page_id(F.col("script_id"), (F.col("page_id") % 40).cast("int")))


@query(f"""WITH {LINES} SELECT script_id, page_index, candidate_pos, sha1(script_id || '|P' || page_index || '|v1|' || CASE WHEN candidate_pos % 3 = 0 THEN 'None' ELSE candidate_pos::VARCHAR END || '|' || (x // 39) || '|' || y)[1:16] AS id FROM lines""")
def p04_marker_id(spark, sf_dir):
    band = F.when(F.col("candidate_pos") % 3 != 0, F.col("candidate_pos"))
    page = F.concat(F.lit("P"), F.col("page_index").cast("string"))
    return adapters.lines(spark, sf_dir).select("script_id", "page_index", "candidate_pos", geometry.marker_id(F.col("script_id"), page, F.lit("v1"), band, F.col("box"), F.lit(DPI)).alias("id"))


@query(f"WITH {BOXES} SELECT candidate_pos, x + width AS x2, y + height AS y2, x + width / 2.0::DOUBLE AS cx, y + height / 2.0::DOUBLE AS cy FROM boxes")
def p06_box_accessors(spark, sf_dir):
    b = F.col("box")
    return adapters.boxes(spark, sf_dir).select("candidate_pos", geometry.x2(b).alias("x2"), geometry.y2(b).alias("y2"), geometry.centre_x(b).alias("cx"), geometry.centre_y(b).alias("cy"))


@query(f"""WITH {BOXES} SELECT candidate_pos, floor(x * 0.5)::INT AS x, floor(y * 0.5)::INT AS y, greatest(1, ceil((x + width) * 0.5) - floor(x * 0.5))::INT AS width, greatest(1, ceil((y + height) * 0.5) - floor(y * 0.5))::INT AS height FROM boxes""")
def p08_polygon_box(spark, sf_dir):
    halved = F.transform(geometry.corners(F.col("box")), lambda p: F.transform(p, lambda v: v * 0.5))
    return adapters.boxes(spark, sf_dir).select("candidate_pos", geometry.polygon_box(halved).alias("b")).select("candidate_pos", "b.*")


@query(f"""WITH {BOXES}, c AS (SELECT candidate_pos, x, y, width, height, least(greatest(x - 20, 0), 99) AS l, least(greatest(y - 20, 0), 899) AS t FROM boxes)
SELECT candidate_pos, l::INT AS x, t::INT AS y, (greatest(l + 1, least(x - 20 + width, 100)) - l)::INT AS width, (greatest(t + 1, least(y - 20 + height, 900)) - t)::INT AS height FROM c""")
def p09_clamp(spark, sf_dir):
    b = F.col("box")
    moved = geometry.box(b["x"] - 20, b["y"] - 20, b["width"], b["height"])
    return adapters.boxes(spark, sf_dir).select("candidate_pos", geometry.clamp(moved, F.lit(100), F.lit(900)).alias("b")).select("candidate_pos", "b.*")


@query(f"""WITH {PAIRS}, i AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, b_y + bh) - greatest(ay, b_y)) AS n FROM pairs)
SELECT candidate_pos, round(CASE WHEN aw * ah + bw * bh - n <= 0 THEN 0 ELSE n / (aw * ah + bw * bh - n)::DOUBLE END, 6) AS iou,
least(ax, bx) AS ux, greatest(ax + aw, bx + bw) - least(ax, bx) AS uw, round((least(ay + ah, b_y + bh) - greatest(ay, b_y)) / greatest(1, least(ah, bh))::DOUBLE, 6) AS overlap FROM i""")
def p10_iou_union_overlap(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    h = geometry.hull(a, b)
    return _pairs(spark, sf_dir).select("candidate_pos", F.round(geometry.iou(a, b), 6).alias("iou"), h["x"].alias("ux"), h["width"].alias("uw"), F.round(geometry.vertical_overlap(a, b), 6).alias("overlap"))


@query(f"""WITH {BOXES}, m AS (SELECT candidate_pos, x, y, 0.8::DOUBLE AS a, -0.6::DOUBLE AS b, 5.0::DOUBLE AS tx, 0.6::DOUBLE AS c, 0.8::DOUBLE AS d, -7.0::DOUBLE AS ty FROM boxes)
SELECT candidate_pos, round(a * x + b * y + tx, 4) AS fx, round(c * x + d * y + ty, 4) AS fy, round(x::DOUBLE, 4) AS bx, round(y::DOUBLE, 4) AS b_y FROM m""")
def p12_affine(spark, sf_dir):
    m = F.array(*map(F.lit, (0.8, -0.6, 5.0, 0.6, 0.8, -7.0)))
    b = F.col("box")
    there = geometry.affine(m, b["x"], b["y"])
    back = geometry.affine(geometry.compose(geometry.inverse(m), m), b["x"], b["y"])
    rows = adapters.boxes(spark, sf_dir).select("candidate_pos", there.alias("t"), back.alias("u"))
    return rows.select("candidate_pos", *(F.round(c, 4).alias(n) for c, n in (("t.x", "fx"), ("t.y", "fy"), ("u.x", "bx"), ("u.y", "b_y"))))


@query(f"""WITH {BOXES}, b AS (SELECT *, list_filter([100, 300, 700, 1500], lambda v: v <= y) AS under FROM boxes)
SELECT candidate_pos, len(under)::INT - 1 AS band, CASE WHEN candidate_pos % 2 = 0 THEN abs(len(under)::INT - 2) WHEN abs(y - 300) < 3 * greatest(height, 1) THEN 0 ELSE 99 END AS distance FROM b""")
def p14_bands(spark, sf_dir):
    b = F.col("box")
    lines = F.array(*map(F.lit, (100, 300, 700, 1500)))
    rows = adapters.boxes(spark, sf_dir).withColumn("band", geometry.band_index(b["y"], lines))
    other = F.when(F.col("candidate_pos") % 2 == 0, F.lit(1))
    return rows.select("candidate_pos", "band", geometry.band_distance(F.col("band"), other, b["y"], F.lit(300), b["height"]).alias("distance"))


@query(f"""WITH {LINES} SELECT script_id, page_index, candidate_pos, round(CASE WHEN r <= 0.5 THEN 0.1 WHEN r <= 0.8 THEN 0.1 + (r - 0.5) * (0.4 / 0.3) WHEN r <= 0.95 THEN 0.5 + (r - 0.8) * (0.4 / 0.15) ELSE 0.9 END, 6) AS calibrated
FROM (SELECT *, recognition_confidence AS r FROM lines)""")
def p17_calibration(spark, sf_dir):
    points = [(0.5, 0.1), (0.8, 0.5), (0.95, 0.9)]
    return adapters.lines(spark, sf_dir).select("script_id", "page_index", "candidate_pos", F.round(distance.calibrated(F.col("recognition_confidence"), points), 6).alias("calibrated"))


@query("SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'COVER' WHEN 2 THEN 'DO_NOT_WRITE' ELSE 'ANSWER' END AS page_role, CASE WHEN doc_id % 10 % 2 <> 0 THEN 'odd' ELSE 'even' END AS parity FROM documents")
def p18_role_and_parity(spark, sf_dir):
    from quillstream.config import Booklet

    settings = Settings(booklet=Booklet(page_roles={1: "COVER", 2: "DO_NOT_WRITE"}))
    pages = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10).cast("int").alias("page_index"))
    return markers.with_roles(pages, settings).select("doc_id", "page_role", layout.parity(F.col("page_index")).alias("parity"))


@query("SELECT doc_id, CASE WHEN n IS NULL THEN 0.3 WHEN n = 0 THEN 0.95 WHEN n <= 2 THEN 0.85 ELSE 0.7 END::DOUBLE AS level FROM (SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN doc_id % 5 END AS n FROM documents)")
def p22_start_level(spark, sf_dir):
    n = F.when(F.col("doc_id") % 5 < 4, F.col("doc_id") % 5)
    return table(spark, sf_dir, "documents").select("doc_id", start.level(n).alias("level"))


@query("SELECT o_orderkey, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') AS flags FROM (SELECT o_orderkey, [o_orderstatus, o_orderpriority[1], o_orderstatus, (o_orderkey % 3)::VARCHAR] AS l FROM orders)")
def p24_ordered_flags(spark, sf_dir):
    first = F.array(F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1))
    more = F.array(F.col("o_orderstatus"), (F.col("o_orderkey") % 3).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.in_order_once(first, more), ",").alias("flags"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, 'sha256:' || sha256(coalesce(text, ''))[1:12] AS version FROM documents")
def s02_digests(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), text.content_version(t).alias("version"))


@query(f"""WITH {BOXES}, objects AS (SELECT *, candidate_pos - (candidate_pos % 5 = 0)::INT AS page FROM boxes WHERE candidate_pos % 7 <> 0)
SELECT 'S' AS script_id, page AS page_index, round_even(width / ((width + height)::DOUBLE / 72), 2) AS dpi FROM objects
QUALIFY count(*) OVER (PARTITION BY page) = 1 AND area >= 20 AND candidate_pos % 11 <> 0 AND candidate_pos % 13 <> 0""")
def s05_embedded_pages(spark, sf_dir):
    """Pages of one object or two, some turned, some mirrored, some nested too deep to count."""
    b, at = F.col("box"), F.col("candidate_pos")
    unlike = lambda n, other: F.when(at % n == 0, other)
    objects = adapters.boxes(spark, sf_dir).select(
        F.lit("S").alias("script_id"), unlike(5, at - 1).otherwise(at).alias("page_index"), F.lit(1.0).alias("a"), unlike(11, 0.01).otherwise(0.0).alias("b"), F.lit(0.0).alias("c"),
        unlike(13, -1.0).otherwise(1.0).alias("d"), F.col("area").alias("coverage"), b["width"].alias("px_width"), F.lit(0.0).alias("left_pt"),
        (b["width"] + b["height"]).cast("double").alias("right_pt"), unlike(7, 3).otherwise(1).alias("depth"),
    )
    from quillstream.sources.files import embedded_pages

    return embedded_pages(objects, 20.0)


# ---- filters and detection -------------------------------------------------------------------


@query(f"WITH {SHEETS} SELECT script_id, page_index, page_role, CASE WHEN page_role = 'ANSWER' THEN 'DECODE' ELSE 'SKIPPED_BY_ROLE' END AS path FROM sheets")
def f01_role_pruning(spark, sf_dir):
    read, skipped = markers.pruned(adapters.sheets(spark, sf_dir))
    keys = ("script_id", "page_index", "page_role")
    return read.select(*keys, F.lit("DECODE").alias("path")).unionAll(skipped.select(*keys, F.col("processing_status").alias("path")))


@query(f"WITH {BOXES} SELECT candidate_pos FROM boxes WHERE area >= 0.4 * (200 / 25.4) ** 2 AND height <= 197 AND NOT (width <= 5 AND height >= 79) AND x < 100")
def f02_component_filter(spark, sf_dir):
    return detect.component_filter(adapters.boxes(spark, sf_dir), DPI, Detection(), F.lit(100)).select("candidate_pos")


@query(f"WITH {BOXES} SELECT candidate_pos FROM boxes WHERE height >= 20 AND width >= 2 AND NOT (x <= 1 AND width <= 12)")
def f03_merged_filter(spark, sf_dir):
    return detect.merged_filter(adapters.boxes(spark, sf_dir), DPI, Detection()).select("candidate_pos")


@query(f"WITH {BOXES} SELECT candidate_pos FROM boxes WHERE x < 112 AND height <= 27 AND x < 110")
def f04_margin_filter(spark, sf_dir):
    return detect.margin_filter(adapters.boxes(spark, sf_dir), DPI, F.lit(120), F.lit(15.0), F.lit(110)).select("candidate_pos")


@query(f"""WITH {BOXES}, r AS (SELECT *, CASE WHEN candidate_pos % 7 = 0 THEN NULL ELSE 60 END AS rule FROM boxes)
SELECT candidate_pos, coalesce(x >= rule, false) AS inside, coalesce(x + width / 2.0 < rule + 47 / 2.0 OR x < rule AND rule <= x + width, true) AS valid FROM r""")
def f05_position(spark, sf_dir):
    b, rule = F.col("box"), F.when(F.col("candidate_pos") % 7 != 0, F.lit(60))
    inside, valid = gate.position(b["x"], b["width"], rule, gate.spill(F.lit(DPI), Region()))
    return adapters.boxes(spark, sf_dir).select("candidate_pos", inside.alias("inside"), valid.alias("valid"))


@query(rf"""WITH {LINES} SELECT script_id, page_index, candidate_pos, length(regexp_replace(raw, '[^\p{{L}}\p{{N}}]', '', 'g')) = 1 AND width > 1.3 * height AS implausible FROM lines""")
def f06_implausible_shape(spark, sf_dir):
    b = F.col("box")
    return adapters.lines(spark, sf_dir).select("script_id", "page_index", "candidate_pos", gate.implausible(F.col("raw"), b["width"], b["height"], Detection()).alias("implausible"))


@query(f"WITH RECURSIVE {GATED} SELECT coalesce(discard_reason, 'LIVE') AS reason, count(*) AS n FROM headed GROUP BY ALL")
def f07_discard_ladder(spark, sf_dir):
    rows = _classified(spark, sf_dir)
    return rows.groupBy(F.coalesce("discard_reason", F.lit("LIVE")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BOXES} SELECT candidate_pos FROM boxes WHERE area >= 2.0 * (200 / 25.4) ** 2")
def f10_valuer_filter(spark, sf_dir):
    return detect.valuer_filter(adapters.boxes(spark, sf_dir), DPI).select("candidate_pos")


@query(f"""WITH {BOXES},
w AS (SELECT *, max(x + width) OVER (PARTITION BY script_id, page_index, band ORDER BY x, x + width, y, height ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes),
s AS (SELECT *, sum(CASE WHEN reach IS NULL OR x - reach > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY script_id, page_index, band ORDER BY x, x + width, y, height ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT script_id, page_index, band, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, min(detection_confidence) AS confidence, count(*) AS fragments
FROM s GROUP BY script_id, page_index, band, island""")
def w03_merge_fragments(spark, sf_dir):
    rows = detect.merge_by_line(adapters.boxes(spark, sf_dir), 6)
    return rows.select("script_id", "page_index", "band", "box.*", F.col("detection_confidence").alias("confidence"), "fragments")


@query(f"""WITH RECURSIVE {BOXES}, pages AS (SELECT script_id, page_index, list(struct_pack(x := x, y := y, w := width, h := height, c := detection_confidence, n := 1) ORDER BY y, x, candidate_pos) AS items FROM boxes GROUP BY ALL),
walk(script_id, page_index, items, go) AS (
  SELECT script_id, page_index, items, true FROM pages
  UNION ALL
  SELECT script_id, page_index, CASE WHEN p IS NULL THEN items ELSE list_concat(items[1:p.i - 1], [struct_pack(x := least(items[p.i].x, items[p.j].x), y := least(items[p.i].y, items[p.j].y),
      w := greatest(items[p.i].x + items[p.i].w, items[p.j].x + items[p.j].w) - least(items[p.i].x, items[p.j].x), h := greatest(items[p.i].y + items[p.i].h, items[p.j].y + items[p.j].h) - least(items[p.i].y, items[p.j].y),
      c := least(items[p.i].c, items[p.j].c), n := items[p.i].n + items[p.j].n)], items[p.i + 1:p.j - 1], items[p.j + 1:]) END, p IS NOT NULL
  FROM (SELECT *, list_filter(flatten(list_transform(range(1, len(items) + 1), lambda i: list_transform(range(i + 1, len(items) + 1), lambda j:
      CASE WHEN (least(items[i].y + items[i].h, items[j].y + items[j].h) - greatest(items[i].y, items[j].y)) / greatest(1, least(items[i].h, items[j].h))::DOUBLE >= 0.3
        AND greatest(items[i].x, items[j].x) - least(items[i].x + items[i].w, items[j].x + items[j].w) <= 6 THEN struct_pack(i := i, j := j) END))), lambda q: q IS NOT NULL)[1] AS p FROM walk WHERE go))
SELECT script_id, page_index, o.x::INT AS x, o.y::INT AS y, o.w::INT AS width, o.h::INT AS height, o.c AS detection_confidence, o.n AS fragments
FROM (SELECT script_id, page_index, unnest(items) AS o FROM walk WHERE NOT go)""")
def w03_merge_by_overlap(spark, sf_dir):
    return detect.merge_by_overlap(adapters.boxes(spark, sf_dir), 6).select("script_id", "page_index", "box.*", "detection_confidence", "fragments")


@query(f"""WITH RECURSIVE {BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY script_id, page_index ORDER BY detection_confidence DESC, candidate_pos) AS k FROM boxes),
walk(script_id, page_index, k, kept, pick) AS (
  SELECT script_id, page_index, k, [struct_pack(bx := x, b_y := y, bw := width, bh := height)], candidate_pos FROM r WHERE k = 1
  UNION ALL
  SELECT script_id, page_index, k, CASE WHEN clash THEN kept ELSE list_append(kept, struct_pack(bx := x, b_y := y, bw := width, bh := height)) END, CASE WHEN NOT clash THEN candidate_pos END FROM (
    SELECT r.*, w.kept, len(list_filter(list_transform(w.kept, lambda b: struct_pack(n := greatest(0, least(b.bx + b.bw, r.x + r.width) - greatest(b.bx, r.x)) * greatest(0, least(b.b_y + b.bh, r.y + r.height) - greatest(b.b_y, r.y)), u := b.bw * b.bh + r.width * r.height)),
      lambda o: o.n / (o.u - o.n)::DOUBLE >= 0.3)) > 0 AS clash
    FROM walk w JOIN r ON r.script_id = w.script_id AND r.page_index = w.page_index AND r.k = w.k + 1))
SELECT script_id, page_index, pick AS candidate_pos FROM walk WHERE pick IS NOT NULL""")
def j06_suppression(spark, sf_dir):
    return detect.suppressed(adapters.boxes(spark, sf_dir), Detection()).select("script_id", "page_index", "candidate_pos")


@query(f"WITH {LINES} SELECT script_id, page_index, candidate_pos, row_number() OVER (PARTITION BY script_id, page_index ORDER BY y, x, candidate_pos) AS number FROM lines")
def w05_candidate_numbers(spark, sf_dir):
    return detect.numbered(adapters.lines(spark, sf_dir)).select("script_id", "page_index", "candidate_pos", "number")


@query(f"WITH RECURSIVE {START} SELECT script_id, page_index, candidate_pos, next_band FROM nexts WHERE discard_reason IS NULL")
def j08_next_band(spark, sf_dir):
    return _classified(spark, sf_dir).where("discard_reason is null").select("script_id", "page_index", "candidate_pos", "next_band")


# ---- layout ----------------------------------------------------------------------------------


def _signal(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "v")).withColumn("v", F.abs("v").cast("double"))


SIGNAL = "signal AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, abs(unnest(embedding))::DOUBLE AS v FROM embeddings)"


@query(f"""WITH {BOXES}, w AS (SELECT page_index, y, coalesce((y - lag(y) OVER (PARTITION BY page_index ORDER BY y) > 40)::INT, 1) AS n FROM boxes),
r AS (SELECT *, sum(n) OVER (PARTITION BY page_index ORDER BY y ROWS UNBOUNDED PRECEDING) AS run FROM w) SELECT page_index, round_even(avg(y), 0)::INT AS centre FROM r GROUP BY page_index, run""")
def a19_row_clusters(spark, sf_dir):
    rows = adapters.boxes(spark, sf_dir).select("page_index", F.col("box")["y"].alias("y"))
    return layout.clusters(rows, ("page_index",), "y", 40)


@query(f"""WITH {BOXES}, d AS (SELECT page_index, y - lag(y) OVER (PARTITION BY page_index ORDER BY y) AS d FROM boxes)
SELECT page_index, CASE WHEN count(*) FILTER (d BETWEEN 20 AND 400) >= 3 THEN quantile_cont(d, 0.5) FILTER (d BETWEEN 20 AND 400) END::DOUBLE AS pitch FROM d GROUP BY page_index""")
def a18_median_pitch(spark, sf_dir):
    rows = adapters.boxes(spark, sf_dir).select("page_index", F.col("box")["y"].alias("y"))
    return layout.median_pitch(rows, ("page_index",), "y", 20, 400)


@query(f"""WITH {SIGNAL}, m AS (SELECT vec_id, pos, sum(v) OVER w AS s, sum(v * pos) OVER w AS mo FROM signal WINDOW w AS (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, pos) = 1) SELECT vec_id, pos AS peak, round(mo / s, 6) AS centre FROM b""")
def a20_rule_position(spark, sf_dir):
    return layout.rule_position(_signal(spark, sf_dir), ("vec_id",), "at", "v", 5).select("vec_id", "peak", F.round("centre", 6).alias("centre"))


@query(f"WITH {SIGNAL} SELECT vec_id, round(degrees(atan(regr_slope(v, pos))), 6) AS skew_deg FROM signal GROUP BY vec_id")
def a21_skew(spark, sf_dir):
    return layout.skew(_signal(spark, sf_dir), ("vec_id",), "v", "at", 2).select("vec_id", F.round("skew_deg", 6).alias("skew_deg"))


@query(f"WITH {SIGNAL} SELECT vec_id, round(avg((v > 0.1)::INT), 6) AS ink, avg((v > 0.1)::INT) >= 0.5 AS enough FROM signal GROUP BY vec_id")
def a22_ink_ratio(spark, sf_dir):
    rows = layout.ink_ratio(_signal(spark, sf_dir), ("vec_id",), F.col("v") > 0.1)
    return rows.select("vec_id", F.round("ink", 6).alias("ink"), (F.col("ink") >= 0.5).alias("enough"))


@query(f"""WITH RECURSIVE {BOXES}, pages AS (SELECT page_index, list_sort(list_distinct(list(y))) AS seen, CASE WHEN page_index % 3 = 0 THEN 20 END AS header, CASE WHEN page_index % 2 = 0 THEN 1500 END AS height FROM boxes GROUP BY page_index),
ends AS (SELECT page_index, seen, coalesce(header, seen[1]) AS first, least(list_max(seen) + 18.5, height - 0.3 * 74) AS stop FROM pages),
walk(page_index, i, here, line) AS (
  SELECT page_index, 0, first::DOUBLE, first::INT FROM ends
  UNION ALL
  SELECT page_index, i + 1, coalesce(pick, here + 74), coalesce(pick, round_even(here + 74, 0))::INT FROM (
    SELECT w.*, list_sort(list_transform(list_filter(e.seen, lambda v: abs(v - (w.here + 74)) <= 18.5), lambda v: struct_pack(d := abs(v - (w.here + 74)), v := v)))[1].v AS pick
    FROM walk w JOIN ends e USING (page_index) WHERE w.here + 74 <= e.stop))
SELECT page_index, string_agg(line::VARCHAR, ',' ORDER BY i) AS lines FROM walk GROUP BY page_index""")
def w06_line_grid(spark, sf_dir):
    rows = adapters.boxes(spark, sf_dir).groupBy("page_index").agg(F.sort_array(F.collect_set(F.col("box")["y"])).alias("seen"))
    header, height = F.when(F.col("page_index") % 3 == 0, F.lit(20)), F.when(F.col("page_index") % 2 == 0, F.lit(1500))
    return rows.select("page_index", F.array_join(layout.completed_grid(F.col("seen"), F.lit(74.0), Layout(), header, height), ",").alias("lines"))


@query(f"WITH {SHEETS} SELECT script_id, page_index, CASE WHEN components <= 2 THEN 'BLANK' WHEN components <= 40 THEN 'SPARSE' ELSE 'NORMAL' END AS content_class FROM sheets")
def a17_content_class(spark, sf_dir):
    return adapters.sheets(spark, sf_dir).select("script_id", "page_index", layout.content_class(F.col("components"), 2, 40).alias("content_class"))


@query(f"""WITH {BOXES}, l AS (SELECT candidate_pos, CASE WHEN candidate_pos % 7 <> 0 THEN x END AS rule, CASE WHEN candidate_pos % 3 <> 0 THEN y END AS header, CASE WHEN candidate_pos % 5 = 0 THEN []::INT[] ELSE [y, y + 74, y + 148] END AS lines FROM boxes)
SELECT candidate_pos, round_even(0.8::DOUBLE * rule + -0.6::DOUBLE * coalesce(lines[len(lines) // 2 + 1], 0) + 5.0::DOUBLE, 0)::INT AS margin_rule_x,
  round_even(0.6::DOUBLE * coalesce(rule, 0) + 0.8::DOUBLE * header + -7.0::DOUBLE, 0)::INT AS header_y,
  array_to_string(list_transform(lines, lambda v: round_even(0.6::DOUBLE * coalesce(rule, 0) + 0.8::DOUBLE * v + -7.0::DOUBLE, 0)::INT), ',') AS lines, 74.13::DOUBLE AS line_pitch_px, 0.124::DOUBLE AS skew_deg FROM l""")
def p21_layout_to_canonical(spark, sf_dir):
    at, b = F.col("candidate_pos"), F.col("box")
    lines = F.when(at % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(b["y"], b["y"] + 74, b["y"] + 148))
    shape = F.struct(
        F.lit(True).alias("found"), F.when(at % 7 != 0, b["x"]).alias("margin_rule_x"), F.when(at % 3 != 0, b["y"]).alias("header_y"), lines.alias("ruled_line_ys"),
        F.lit(74.126).alias("line_pitch_px"), F.lit(0.1239).alias("skew_deg"),
    )
    m = F.array(*map(F.lit, (0.8, -0.6, 5.0, 0.6, 0.8, -7.0)))
    rows = adapters.boxes(spark, sf_dir).select("candidate_pos", shape.alias("shape")).select("candidate_pos", layout.to_canonical(F.col("shape"), m).alias("c"))
    return rows.select("candidate_pos", "c.margin_rule_x", "c.header_y", F.array_join("c.ruled_line_ys", ",").alias("lines"), "c.line_pitch_px", "c.skew_deg")


# ---- pixels ----------------------------------------------------------------------------------
# Embeddings stand in for pictures of 8 x 8 cells, of which the brightness is the value's size.


def _per_picture(spark, sf_dir, kernel_of, schema: str):
    """kernel_of(picture) gives rows; schema names them after vec_id. The kernels of quillstream.image run in workers."""

    def run(batches):
        import numpy as np
        import pandas as pd

        names = ["vec_id", *(x.split()[0] for x in schema.split(", "))]
        for df in batches:
            rows = [(i, *r) for i, v in zip(df["vec_id"], df["embedding"]) for r in kernel_of(np.floor(np.abs(np.asarray(v, float)) * 400).reshape(8, 8))]
            yield pd.DataFrame(rows, columns=names)

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInPandas(run, f"vec_id long, {schema}")


CELLS = """cells AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, floor(abs(e::DOUBLE) * 400) AS v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS e FROM embeddings))"""


@query(f"""WITH {CELLS}, edges AS (SELECT *, CASE WHEN v > 30 AND NOT coalesce(lag(v > 30) OVER (PARTITION BY vec_id, r ORDER BY c), false) THEN 1 ELSE 0 END AS new FROM cells),
runs AS (SELECT *, sum(new) OVER (PARTITION BY vec_id, r ORDER BY c) AS run FROM edges),
long AS (SELECT *, count(*) OVER (PARTITION BY vec_id, r, run) AS n FROM runs WHERE v > 30)
SELECT vec_id, r::INT AS y, c::INT AS x FROM long WHERE n >= 3""")
def i02_opening(spark, sf_dir):
    from quillstream.image import kernel

    return _per_picture(spark, sf_dir, lambda g: zip(*(a.tolist() for a in kernel.open_runs(g > 30, 3, 1).nonzero())), "y int, x int")


@query(f"WITH {CELLS} SELECT vec_id, (r // 2)::INT AS y, (c // 2)::INT AS x, avg(v)::DOUBLE AS mean FROM cells GROUP BY ALL")
def i11_area_resize(spark, sf_dir):
    from quillstream.image import kernel

    return _per_picture(spark, sf_dir, lambda g: [(y, x, float(m)) for y, row in enumerate(kernel.block_mean(g, 2)) for x, m in enumerate(row)], "y int, x int, mean double")


@query(f"""WITH {CELLS}, near AS (SELECT a.vec_id, a.r, a.c, a.v, sum(b.v) AS s FROM cells a, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc), cells b
  WHERE b.vec_id = a.vec_id AND b.r = least(7, greatest(0, a.r + dr)) AND b.c = least(7, greatest(0, a.c + dc)) GROUP BY ALL)
SELECT vec_id, r::INT AS y, c::INT AS x FROM near WHERE 9 * v < s - 9 * 15.5""")
def i01_adaptive_ink(spark, sf_dir):
    from quillstream.image import kernel

    return _per_picture(spark, sf_dir, lambda g: zip(*(a.tolist() for a in kernel.adaptive_ink(g, 3, 15.5).nonzero())), "y int, x int")


@query(f"""WITH RECURSIVE {CELLS}, ink AS (SELECT vec_id, r, c FROM cells WHERE v > 60),
near AS (SELECT a.vec_id, a.r * 8 + a.c AS p, b.r * 8 + b.c AS q FROM ink a JOIN ink b ON a.vec_id = b.vec_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
reached AS (SELECT vec_id, p, p AS q FROM near UNION SELECT t.vec_id, t.p, n.q FROM reached t JOIN near n ON n.vec_id = t.vec_id AND n.p = t.q),
named AS (SELECT vec_id, p, min(q) AS root FROM reached GROUP BY ALL)
SELECT vec_id, min(p % 8)::INT AS x, min(p // 8)::INT AS y, (max(p % 8) - min(p % 8) + 1)::INT AS width, (max(p // 8) - min(p // 8) + 1)::INT AS height, count(*)::INT AS area FROM named GROUP BY vec_id, root""")
def a16_components(spark, sf_dir):
    from quillstream.image import kernel

    return _per_picture(spark, sf_dir, lambda g: kernel.components(g > 60).tolist(), "x int, y int, width int, height int, area int")


@query(f"""WITH {BOXES}, c AS (SELECT candidate_pos, least(160, x + width + 8) - greatest(0, x - 8) AS w, least(1900, y + height + 8) - greatest(0, y - 8) AS h FROM boxes WHERE x < 152 AND y < 1892)
SELECT candidate_pos, (w + 2 * greatest(4, h // 4))::INT AS crop_width, (h + 2 * (greatest(4, h // 4) // 2))::INT AS crop_height FROM c""")
def p16_crops(spark, sf_dir):
    schema = "candidate_pos int, crop_width int, crop_height int"

    def run(batches):
        import numpy as np
        import pandas as pd

        from quillstream.image import kernel

        strip = np.zeros((1900, 160), np.uint8)
        for df in batches:
            shapes = [kernel.crop(strip, (b["x"], b["y"], b["width"], b["height"]), DPI, Detection().padding_mm).shape for b in df["box"]]
            yield pd.DataFrame({"candidate_pos": df["candidate_pos"], "crop_width": [w for _, w in shapes], "crop_height": [h for h, _ in shapes]})

    return adapters.boxes(spark, sf_dir).where("box.x < 152 and box.y < 1892").select("candidate_pos", "box").mapInPandas(run, schema)


@query(f"""WITH {SHEETS}, t AS (SELECT script_id, page_index, (200 + components % 900 * 3)::INT AS h, CASE WHEN page_index % 4 = 0 THEN 296 ELSE 4 * (60 + page_index) END AS tall,
  CASE WHEN page_index % 4 = 0 THEN 222 ELSE 3 * (60 + page_index) END AS step FROM sheets)
SELECT script_id, page_index, k::INT AS tile, (k * step)::INT AS top, least(h, k * step + tall)::INT AS bottom FROM t, unnest(range(ceil(greatest(0, h - tall) / step::DOUBLE)::BIGINT + 1)) AS r(k) WHERE least(h, k * step + tall) - k * step >= 10""")
def i10_tiles(spark, sf_dir):
    pages = adapters.sheets(spark, sf_dir).select(
        "script_id", "page_index", F.lit(DPI).alias("dpi"), (200 + F.col("components") % 900 * 3).cast("int").alias("region_height"),
        F.when(F.col("page_index") % 4 != 0, (60 + F.col("page_index")).cast("double")).alias("line_pitch_px"),
    )
    return detect.tiles(pages, Detection())


_STATES = ("QUEUED", "PROCESSING", "COMPLETED", "FAILED_RETRYABLE", "FAILED_PERMANENT", "PROCESSING", "FAILED_RETRYABLE")


@query(f"""WITH RECURSIVE e AS (SELECT event_id // 6 AS job_id, event_id % 6 AS seq, {adapters._picked(_STATES, "(event_id * 5 + event_id // 6)")} AS s FROM events),
walk(job_id, seq, status, attempts, rejected) AS (
  SELECT DISTINCT job_id, (SELECT min(seq) FROM e) - 1, 'QUEUED', 0, 0 FROM e
  UNION ALL
  SELECT job_id, seq, CASE WHEN fits AND s = 'FAILED_RETRYABLE' AND attempts >= 2 THEN 'FAILED_PERMANENT' WHEN fits THEN s ELSE status END, attempts + (fits AND s = 'PROCESSING')::INT, rejected + (NOT fits AND s <> status)::INT FROM (
    SELECT w.job_id, e.seq, w.status, w.attempts, w.rejected, e.s, CASE w.status WHEN 'QUEUED' THEN e.s = 'PROCESSING' WHEN 'PROCESSING' THEN e.s IN ('COMPLETED', 'FAILED_RETRYABLE', 'FAILED_PERMANENT')
      WHEN 'FAILED_RETRYABLE' THEN e.s IN ('QUEUED', 'FAILED_PERMANENT') ELSE false END AS fits FROM walk w JOIN e ON e.job_id = w.job_id AND e.seq = w.seq + 1))
SELECT job_id, status, attempts, rejected FROM walk QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1""")
def x02_job_states(spark, sf_dir):
    from quillstream.streaming import tracker

    at = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.expr("event_id div 6").alias("job_id"), (at % 6).alias("seq"), F.get(F.array(*map(F.lit, _STATES)), ((at * 5 + F.expr("event_id div 6")) % len(_STATES)).cast("int")).alias("status")
    )
    return tracker.job_states(events, 2)


# ---- scripts ---------------------------------------------------------------------------------


def _placed(spark, sf_dir):
    places = spark.createDataFrame([(str(i + 1), i) for i in range(8)], "question string, ord int")
    return consolidate.ordered(adapters.turns(spark, sf_dir)).join(F.broadcast(places), "question", "left")


@query(f"WITH {TURNS} SELECT script_id, page_index, question, seq FROM ordered")
def o01_order(spark, sf_dir):
    return _placed(spark, sf_dir).select("script_id", "page_index", "question", F.col("seq").cast("long").alias("seq"))


@query(f"""WITH {TURNS} SELECT script_id, question, count(*) AS n, 'Question ' || question || ' appears ' || count(*) || ' times (pages ' || string_agg(page_index::VARCHAR, ', ' ORDER BY seq) || ')' AS detail
FROM ordered GROUP BY script_id, question HAVING count(*) > 1""")
def a11_duplicates(spark, sf_dir):
    rows = consolidate.duplicates(_placed(spark, sf_dir)).where("is_duplicate")
    pages = F.transform(F.sort_array(F.collect_list(F.struct("seq", "page_index"))), lambda x: x["page_index"].cast("string"))
    rows = rows.groupBy("script_id", "question").agg(F.count(F.lit(1)).alias("n"), F.array_join(pages, ", ").alias("on"))
    return rows.select("script_id", "question", "n", F.format_string("Question %s appears %d times (pages %s)", "question", "n", "on").alias("detail"))


@query(f"WITH {TURNS} SELECT script_id, count(DISTINCT question) AS n_questions, count(DISTINCT question) < 3 OR count(DISTINCT question) > 5 AS is_mismatch FROM ordered GROUP BY ALL")
def a12_answer_counts(spark, sf_dir):
    rules = spark.createDataFrame([("EXAM", 3, 5)], "exam_id string, min_answers int, max_answers int")
    return consolidate.answer_counts(_placed(spark, sf_dir), rules).select("script_id", "n_questions", "is_mismatch")


LATE = f"""{TURNS},
tops AS (SELECT *, max(ord * 100000 - seq) OVER (PARTITION BY script_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ordered),
late AS (SELECT *, coalesce(ord < ceil(top / 100000.0), false) AS is_late FROM tops),
named AS (SELECT *, CASE WHEN is_late THEN (ceil(top / 100000.0) * 100000 - top)::BIGINT END AS after_seq FROM late)"""


@query(f"""WITH {LATE} SELECT script_id, seq, is_late, after_seq, EXISTS (SELECT 1 FROM named o WHERE o.script_id = n.script_id AND o.after_seq = n.seq) AS is_passed FROM named n""")
def w01_out_of_order(spark, sf_dir):
    rows = consolidate.out_of_order(_placed(spark, sf_dir))
    return rows.select("script_id", F.col("seq").cast("long").alias("seq"), "is_late", F.col("after_seq").cast("long").alias("after_seq"), "is_passed")


@query(f"WITH {SHEETS} SELECT script_id, min(page_index) AS first_page FROM sheets WHERE page_role = 'ANSWER' AND processing_status = 'PROCESSED' AND content_class IN ('NORMAL', 'SPARSE') GROUP BY ALL")
def w04_first_written_page(spark, sf_dir):
    return consolidate.first_written(adapters.sheets(spark, sf_dir))


@query(f"WITH {SHEETS} SELECT script_id, bool_or(processing_status LIKE 'FAILED%') AS is_incomplete, coalesce(string_agg(CASE WHEN processing_status LIKE 'FAILED%' THEN page_index::VARCHAR END, ',' ORDER BY page_index), '') AS failed FROM sheets GROUP BY ALL")
def d08_failed_pages(spark, sf_dir):
    rows = consolidate.failed_pages(adapters.sheets(spark, sf_dir))
    return rows.select("script_id", "is_incomplete", F.array_join(F.col("failed_pages").cast("array<string>"), ",").alias("failed"))


FLAGS = f"""{LATE},
twice AS (SELECT script_id, question FROM ordered GROUP BY ALL HAVING count(*) > 1),
counts AS (SELECT script_id, count(DISTINCT question) < 3 OR count(DISTINCT question) > 5 AS is_mismatch FROM ordered GROUP BY ALL),
more AS (SELECT n.script_id, n.page_index, n.candidate_pos, array_to_string(list_filter([
    CASE WHEN EXISTS (SELECT 1 FROM twice t WHERE t.script_id = n.script_id AND t.question = n.question) THEN 'DUPLICATE_IN_SCRIPT' END,
    CASE WHEN is_late OR EXISTS (SELECT 1 FROM named o WHERE o.script_id = n.script_id AND o.after_seq = n.seq) THEN 'OUT_OF_ORDER' END,
    CASE WHEN c.is_mismatch THEN 'ANSWER_COUNT_MISMATCH' END], lambda r: r IS NOT NULL), ',') AS reasons
  FROM named n JOIN counts c USING (script_id))"""


@query(f"""WITH {FLAGS} SELECT t.script_id, t.page_index, t.question, CASE WHEN t.status = 'ACCEPTED' AND coalesce(m.reasons, '') <> '' THEN 'REVIEW_REQUIRED' ELSE t.status END AS status, coalesce(m.reasons, '') AS reasons
FROM turns t LEFT JOIN more m USING (script_id, page_index, candidate_pos)""")
def d05_consolidate(spark, sf_dir):
    words = vocabulary.build(spark.createDataFrame([("EXAM", "1", i, str(i + 1), None) for i in range(8)], VOCABULARY_ENTRIES))
    rules = spark.createDataFrame([("EXAM", 3, 5)], "exam_id string, min_answers int, max_answers int")
    rows = consolidate.flagged(adapters.turns(spark, sf_dir), words, rules)
    return rows.select("script_id", "page_index", "question", "status", F.array_join("review_reasons", ",").alias("reasons"))


@query(f"""WITH {LATE}, {SHEETS.strip()},
own AS (SELECT * REPLACE (replace(script_id, 'D', 'C') AS script_id) FROM sheets),
scripts AS (SELECT DISTINCT script_id FROM own),
firsts AS (SELECT script_id, min(page_index) AS first_page FROM own WHERE page_role = 'ANSWER' AND processing_status = 'PROCESSED' AND content_class IN ('NORMAL', 'SPARSE') GROUP BY ALL),
looked AS (SELECT *, EXISTS (SELECT 1 FROM ordered o WHERE o.script_id = f.script_id) AS marked,
  EXISTS (SELECT 1 FROM turns t WHERE t.script_id = f.script_id AND t.page_index = f.first_page AND t.status IN ('ACCEPTED', 'REVIEW_REQUIRED', 'UNRESOLVED')) AS here FROM firsts f),
found AS (
  SELECT script_id, 0 AS phase, min(seq) AS seq, 'DUPLICATE_QUESTION' AS flag, 'Question ' || question || ' appears ' || count(*) || ' times (pages ' || string_agg(page_index::VARCHAR, ', ' ORDER BY seq) || ')' AS detail
  FROM ordered GROUP BY script_id, question HAVING count(*) > 1
  UNION ALL SELECT n.script_id, 1, n.seq, 'OUT_OF_ORDER', 'Question ' || n.question || ' (page ' || n.page_index || ') after ' || h.question || ' (page ' || h.page_index || ')' FROM named n JOIN ordered h ON h.script_id = n.script_id AND h.seq = n.after_seq
  UNION ALL SELECT script_id, 2, 0, 'ANSWER_COUNT_MISMATCH', count(DISTINCT question) || ' distinct questions found; rules allow 3..5' FROM scripts LEFT JOIN ordered USING (script_id) GROUP BY script_id HAVING count(DISTINCT question) NOT BETWEEN 3 AND 5
  UNION ALL SELECT script_id, 3, 0, CASE WHEN marked THEN 'POSSIBLE_MISSED_MARKER' ELSE 'NO_MARKERS' END, CASE WHEN marked THEN 'First written answer page (' || first_page || ') has no marker' ELSE 'Answer pages contain writing but no question markers were found' END FROM looked WHERE NOT (marked AND here)
  UNION ALL SELECT script_id, 4, 0, 'INCOMPLETE', 'Pages failed: [' || string_agg(page_index::VARCHAR, ', ' ORDER BY page_index) || ']' FROM own WHERE processing_status LIKE 'FAILED%' GROUP BY script_id),
flags AS (SELECT script_id, string_agg(flag, ',' ORDER BY phase) AS flags FROM (SELECT DISTINCT script_id, phase, flag FROM found) GROUP BY script_id),
details AS (SELECT script_id, string_agg(detail, '; ' ORDER BY phase, seq, flag, detail) AS flag_details FROM found GROUP BY script_id)
SELECT script_id, coalesce(flags, '') AS flags, coalesce(flag_details, '') AS flag_details FROM scripts LEFT JOIN flags USING (script_id) LEFT JOIN details USING (script_id)""")
def d07_script_flags(spark, sf_dir):
    words = vocabulary.build(spark.createDataFrame([("EXAM", "1", i, str(i + 1), None) for i in range(8)], VOCABULARY_ENTRIES))
    rules = spark.createDataFrame([("EXAM", 3, 5)], "exam_id string, min_answers int, max_answers int")
    pages = adapters.sheets(spark, sf_dir).withColumn("script_id", F.regexp_replace("script_id", "D", "C"))
    found = consolidate.script_flags(pages, adapters.turns(spark, sf_dir), words, rules)
    return found.select("script_id", F.array_join("flags", ",").alias("flags"), F.array_join("flag_details", "; ").alias("flag_details"))


# ---- vocabulary ------------------------------------------------------------------------------


def _entries(spark, sf_dir):
    """Identifiers n, n(a) and n(a)(k) from keys, several of them equal or of the same characters."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    letter = F.get(F.array(*map(F.lit, ("a", "b", "i", "ii", "x9"))), k % 5)
    raw = F.when(k % 3 == 0, F.concat((k % 90).cast("string"), F.lit("("), letter, F.lit(")"))).when(k % 3 == 1, (k % 70).cast("string")).otherwise(F.concat((k % 40).cast("string"), F.lit("."), letter, F.lit("."), (k % 4).cast("string")))
    return s.select(F.concat(F.lit("E"), (k % 3).cast("string")).alias("exam_id"), F.lit("1").alias("version"), k.cast("int").alias("ord"), raw.alias("raw"), F.lit(None).cast("boolean").alias("explicit_target"))


ENTRIES = r"""
entries AS (
  SELECT 'E' || (k % 3) AS exam_id, k::INT AS ord, CASE WHEN k % 3 = 0 THEN (k % 90) || '(' || letter || ')' WHEN k % 3 = 1 THEN (k % 70)::VARCHAR ELSE (k % 40) || '.' || letter || '.' || (k % 4) END AS raw
  FROM (SELECT s_suppkey AS k, ['a', 'b', 'i', 'ii', 'x9'][(s_suppkey % 5 + 1)::INT] AS letter FROM supplier)),
ids AS (SELECT *, array_to_string(segments, '|') AS key, array_to_string(segments, '') AS flat, segments[1] || array_to_string(list_transform(segments[2:], lambda s: '(' || s || ')'), '') AS canonical
  FROM (SELECT *, list_transform(regexp_extract_all(raw, '[0-9]+|[A-Za-z]+'), lambda s: lower(s)) AS segments FROM entries))"""


@query(f"WITH {ENTRIES} SELECT DISTINCT exam_id, array_to_string(segments[1:i], '|') AS key FROM ids, unnest(range(1, len(segments)::BIGINT)) AS r(i)")
def j09_parents(spark, sf_dir):
    return vocabulary.parents(vocabulary.parsed(_entries(spark, sf_dir)))


@query(f"WITH {ENTRIES} SELECT exam_id, ord, canonical, coalesce((SELECT string_agg(DISTINCT o.canonical, ',' ORDER BY o.canonical) FROM ids o WHERE o.exam_id = i.exam_id AND o.flat = i.flat AND o.canonical <> i.canonical), '') AS others FROM ids i")
def j10_collisions(spark, sf_dir):
    rows = vocabulary.confusable(vocabulary.parsed(_entries(spark, sf_dir)))
    return rows.select("exam_id", "ord", "canonical", F.array_join("confusable_with", ",").alias("others"))


@query(f"WITH {ENTRIES} SELECT exam_id, ord, raw, 'DUPLICATE' AS error FROM ids QUALIFY row_number() OVER (PARTITION BY exam_id, key ORDER BY ord) > 1")
def d09_validation(spark, sf_dir):
    return vocabulary.errors(_entries(spark, sf_dir))


@query(rf"""WITH {ENTRIES}, e AS (SELECT exam_id, ord, i AS depth, segments[i + 1] AS seg, array_to_string(segments[1:i], '|') AS parent FROM ids, unnest(range(len(segments)::BIGINT)) AS r(i)),
t AS (SELECT *, CASE WHEN depth = 0 THEN false ELSE coalesce(bool_and(CASE WHEN regexp_full_match(seg, '[A-Za-z]+') THEN regexp_full_match(seg, '(?:x{{0,3}})(?:ix|iv|v?i{{0,3}})') END) OVER g AND bool_or(length(seg) > 1) OVER g, false) END AS roman FROM e WINDOW g AS (PARTITION BY exam_id, parent, depth))
SELECT exam_id, ord, string_agg(CASE WHEN regexp_full_match(seg, '[0-9]+') THEN 'NUM' WHEN roman OR length(seg) > 1 THEN 'ROMAN' ELSE 'ALPHA' END, ',' ORDER BY depth) AS types FROM t GROUP BY exam_id, ord""")
def d10_segment_types(spark, sf_dir):
    rows = vocabulary.segment_types(vocabulary.parsed(_entries(spark, sf_dir)))
    return rows.select("exam_id", "ord", F.array_join("segment_types", ",").alias("types"))


@query(f"WITH {ENTRIES} SELECT exam_id, ord, canonical, NOT EXISTS (SELECT 1 FROM ids c WHERE c.exam_id = i.exam_id AND starts_with(c.key, i.key || '|')) AS is_target FROM ids i")
def d11_targets(spark, sf_dir):
    return vocabulary.build(_entries(spark, sf_dir)).select("exam_id", "ord", "canonical", "is_target")


# ---- more of the way to the gate -------------------------------------------------------------


@query(f"WITH RECURSIVE {SCORES} SELECT raw, edge, question, rank::INT AS rank FROM ranked WHERE rank <= 5")
def a05_ranking(spark, sf_dir):
    rows = _resolved(spark, sf_dir).where("kind = 'MARKER'").select("raw", "edge", F.posexplode("candidates").alias("at", "c"))
    return rows.select("raw", "edge", F.col("c.question_id").alias("question"), (F.col("at") + 1).alias("rank"))


@query(f"WITH RECURSIVE {SCORES} SELECT raw, edge, concat_ws(',', CASE WHEN ns > 0 THEN 'NOISE_STRIPPED' END, CASE WHEN tr > 0 THEN 'LINE_TRIMMED' END) AS flags FROM resolved")
def a09_variant_flags(spark, sf_dir):
    return _resolved(spark, sf_dir).where("kind = 'MARKER'").select("raw", "edge", F.array_join("resolution_flags", ",").alias("flags"))


@query(f"WITH RECURSIVE {SCORES} SELECT raw, edge, question FROM best WHERE exact")
def j02_exact_key_match(spark, sf_dir):
    parsed = _parsed(spark, sf_dir).where("kind = 'MARKER'").withColumn("exam_id", F.lit("EXAM")).withColumn("reading", F.struct("raw", "edge"))
    return resolve.scores(parsed, adapters.identifiers(spark), _SETTINGS).where("exact").select("reading.raw", "reading.edge", "question")


@query(f"WITH RECURSIVE {GATED} SELECT script_id, page_index, candidate_pos, coalesce(discard_reason = 'HEADER_TOKEN', false) AS is_header FROM headed WHERE kind = 'PREFIX_ONLY'")
def j05_header_lookahead(spark, sf_dir):
    return _classified(spark, sf_dir).where("kind = 'PREFIX_ONLY'").select("script_id", "page_index", "candidate_pos", "is_header")


@query(f"WITH RECURSIVE {START} SELECT script_id, page_index, candidate_pos, greatest(0.8, CASE WHEN list_contains(parse_flags, 'LINE_TRIMMED') OR ns > 0 OR tr > 0 THEN 0.92 ELSE 0 END, CASE WHEN page_index % 5 = 0 THEN 0.9 ELSE 0 END)::DOUBLE AS threshold FROM done WHERE kind = 'MARKER'")
def d02_threshold(spark, sf_dir):
    rows = _classified(spark, sf_dir).where("kind = 'MARKER'")
    return rows.select("script_id", "page_index", "candidate_pos", gate.threshold(F.col("flags"), F.col("is_colour"), Gate()).alias("threshold"))


@query(f"WITH RECURSIVE {START} SELECT script_id, count(*) FILTER (status = 'DISCARDED') AS n_discarded FROM done GROUP BY ALL")
def a15_discarded(spark, sf_dir):
    return report.discarded(_classified(spark, sf_dir))


@query(f"WITH RECURSIVE {START} SELECT script_id, page_index, candidate_pos, CASE WHEN question IS NOT NULL THEN question WHEN status <> 'DISCARDED' AND candidates IS NOT NULL THEN '?' || string_split(candidates, ',')[1] ELSE '-' END AS shown FROM (SELECT d.*, r.candidates FROM done d LEFT JOIN resolved r ON r.raw = d.raw AND r.edge = (d.x <= 4))")
def p23_shown_question(spark, sf_dir):
    best = F.get("candidates", F.lit(0))["question_id"]
    return _classified(spark, sf_dir).select("script_id", "page_index", "candidate_pos", report.shown_question(F.col("question"), best, F.col("status")).alias("shown"))


@query("""SELECT exam_id, ord, raw, 'DUPLICATE' AS error FROM (
  SELECT 'E' || (s_suppkey % 2) AS exam_id, s_suppkey::INT AS ord, (s_suppkey % 3 + 1) || CASE WHEN s_suppkey % 4 = 0 THEN '(a)' ELSE '' END AS raw FROM supplier)
QUALIFY row_number() OVER (PARTITION BY exam_id, raw ORDER BY ord) > 1""")
def o08_repeated_keys(spark, sf_dir):
    k = F.col("s_suppkey")
    raw = F.concat((k % 3 + 1).cast("string"), F.when(k % 4 == 0, "(a)").otherwise(""))
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("E"), (k % 2).cast("string")).alias("exam_id"), F.lit("1").alias("version"), k.cast("int").alias("ord"), raw.alias("raw"), F.lit(None).cast("boolean").alias("explicit_target")
    )
    return vocabulary.errors(rows)


@query(f"WITH {BOXES} SELECT candidate_pos, round(x * 72 / 200.0::DOUBLE, 6) AS px, round(800 - y * 72 / 200.0::DOUBLE, 6) AS py FROM boxes")
def x09_pdf_points(spark, sf_dir):
    b = F.col("box")
    p = geometry.pdf_points(b["x"], b["y"], F.lit(DPI), F.lit(800.0))
    return adapters.boxes(spark, sf_dir).select("candidate_pos", F.round(p["x"], 6).alias("px"), F.round(p["y"], 6).alias("py"))


@query(f"""WITH {BOXES} SELECT script_id, page_index, count(*) AS n, min(x) AS x, max(x + width) - min(x) AS width, min(y) AS y, max(y + height) - min(y) AS height FROM boxes GROUP BY ALL""")
def p11_union_of_a_page(spark, sf_dir):
    rows = adapters.boxes(spark, sf_dir).groupBy("script_id", "page_index").agg(F.count(F.lit(1)).alias("n"), F.collect_list("box").alias("_all"))
    return rows.select("script_id", "page_index", "n", geometry.union(F.col("_all")).alias("u")).select("script_id", "page_index", "n", "u.*")


@query("""SELECT count(*) AS n, count(predicted) / count(*)::DOUBLE AS recall, avg((predicted = truth)::INT) AS resolved_right,
count(*) FILTER (accepted AND predicted <> truth) / count(*) FILTER (accepted)::DOUBLE AS wrong_auto_accept, count(*) FILTER (NOT accepted) / count(*)::DOUBLE AS review_rate
FROM (SELECT quality::VARCHAR AS truth, (CASE WHEN doc_id % 7 = 0 THEN toxic ELSE quality END)::VARCHAR AS predicted, doc_id % 3 > 0 AS accepted FROM labels)""")
def x04_acceptance(spark, sf_dir):
    df = table(spark, sf_dir, "labels")
    key = F.col("doc_id").cast("string").alias("marker_result_id")
    guess = F.when(F.col("doc_id") % 7 == 0, F.col("toxic")).otherwise(F.col("quality")).cast("string")
    rows = df.select(key, guess.alias("question"), F.when(F.col("doc_id") % 3 > 0, "ACCEPTED").otherwise("REVIEW_REQUIRED").alias("status"))
    return report.acceptance(rows, df.select(key, F.col("quality").cast("string").alias("true_question")))


@query("""WITH auto AS (SELECT doc_id::VARCHAR AS id, (doc_id % 5)::VARCHAR AS question, CASE WHEN doc_id % 3 > 0 THEN 'ACCEPTED' ELSE 'REVIEW_REQUIRED' END AS status FROM labels),
reviews AS (SELECT doc_id::VARCHAR AS id, ['CONFIRM', 'CORRECT', 'REJECT', 'ADD'][(doc_id // 4 % 4 + 1)::INT] AS action, (doc_id % 6)::VARCHAR AS q, doc_id % 7 AS t FROM labels WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id::VARCHAR, ['CORRECT', 'REJECT'][(doc_id // 8 % 2 + 1)::INT], (doc_id % 4)::VARCHAR, 3 FROM labels WHERE doc_id % 8 = 0),
last AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY id ORDER BY t DESC, action) = 1)
SELECT a.id AS marker_result_id, CASE WHEN action = 'CORRECT' THEN q ELSE question END AS question, CASE WHEN action = 'REJECT' THEN 'REJECTED' WHEN action IS NOT NULL THEN 'ACCEPTED' ELSE status END AS status,
  CASE WHEN action = 'CORRECT' THEN 'REVIEWER_CORRECTED' WHEN action = 'ADD' THEN 'REVIEWER_ADDED' ELSE 'AUTOMATIC' END AS source, CASE WHEN action = 'CORRECT' AND q <> question THEN 'HUMAN_VS_REPROCESS_CONFLICT' ELSE '' END AS reasons
FROM auto a LEFT JOIN last l USING (id)""")
def x03_human_override(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id")
    at, key = F.col("doc_id"), F.col("doc_id").cast("string").alias("marker_result_id")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (n % len(names)).cast("int"))
    auto = df.select(
        key, (at % 5).cast("string").alias("question"), F.when(at % 3 > 0, "ACCEPTED").otherwise("REVIEW_REQUIRED").alias("status"),
        F.array().cast("array<string>").alias("review_reasons"), F.lit("AUTOMATIC").alias("source"),
    )
    one = df.where("doc_id % 4 = 0").select(key, pick(("CONFIRM", "CORRECT", "REJECT", "ADD"), F.expr("doc_id div 4")).alias("action"), F.create_map(F.lit("question"), (at % 6).cast("string")).alias("corrected"), (at % 7).alias("reviewed_at"))
    two = df.where("doc_id % 8 = 0").select(key, pick(("CORRECT", "REJECT"), F.expr("doc_id div 8")).alias("action"), F.create_map(F.lit("question"), (at % 4).cast("string")).alias("corrected"), F.lit(3).cast("long").alias("reviewed_at"))
    rows = markers.effective(auto, one.unionByName(two))
    return rows.select("marker_result_id", "question", "status", "source", F.array_join("review_reasons", ",").alias("reasons"))


@query("""SELECT CASE WHEN d <> '1' THEN d END AS question, CASE WHEN d = '1' THEN 'UNRESOLVED' WHEN c < 0.92 THEN 'REVIEW_REQUIRED' ELSE 'ACCEPTED' END AS status, count(*) AS n
FROM (SELECT o_orderpriority[1] AS d, (70 + o_orderkey % 31) / 100.0 AS c FROM orders) GROUP BY ALL""")
def flagship(spark, sf_dir):
    """Order priorities as markers, parsed, resolved and gated; every one has trailing text. 1 is a parent, so no target."""
    df = table(spark, sf_dir, "orders")
    df = df.select(F.col("o_orderpriority").alias("raw"), F.lit("EXAM").alias("exam_id"), ((70 + F.col("o_orderkey") % 31) / F.lit(100.0)).alias("recognition_confidence"))
    rows = read.read(df, adapters.identifiers(spark), Settings(), F.lit(False))
    rows = rows.withColumn("flags", text.in_order_once(F.col("parse_flags"), F.coalesce("resolution_flags", F.array().cast("array<string>"))))
    known = {"discard_reason": F.lit(None).cast("string"), "position_valid": F.lit(True), "landmarks_found": F.lit(True), "is_colour": F.lit(True), "start_method": F.lit("LANDMARK_LINE"), "start_confidence": F.lit(0.95)}
    rows = gate.decide(rows.withColumns(known), Gate())
    return rows.groupBy("question", "status").agg(F.count(F.lit(1)).alias("n"))
