"""Registered queries over the driver's tables, each beside the SQL that checks it.

Stand-ins: a candidate is a line item (utt its order, wer the discount, sim the tax, cm the
quantity where the return flag is N), a frame is an event (clip its user, in order of time), a
task is a document, a finished utterance is a labelled document, a hypothesis is a later turn
of a conversation, a vector is an embedding. Doubles are rounded at the end on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import metrics, normalize, numerals, text
from .operators import completeness, selection, sentences, waves
from .operators import frames as fr
from .operators import ranged
from .plans import jobs
from .sources import clips as wav
from .sources import runs as rn
from .sources import tasks as src

HOP, PAD, SR = 160, 320, 1600
CLIP = 6000  # samples; the 60 seconds to which the reference trims
BACKENDS = (("primary", 2), ("clone", 1), ("fallback", 1))
H, S = text.HARD, text.SOFT

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows by a key over all shuffle partitions, however few files and bytes they come from."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    cm = F.when(F.col("l_returnflag") == "N", F.col("l_quantity") / 50)
    named = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("utt"), *order, F.col("l_discount").alias("wer"), F.col("l_tax").alias("sim"), cm.alias("cm"))
    return selection.by_group(named).select(  # under the name of the group, by which all windows after it find the rows dealt and sorted
        "utt",
        (F.row_number().over(Window.partitionBy("utt").orderBy(*order)) - 1).alias("cand_idx"),
        F.concat(F.lit("m_"), F.col("l_linenumber").cast("string")).alias("tag"),
        "wer",
        "sim",
        "cm",
    )


CAND = """
cand AS (
  SELECT l_orderkey AS utt, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INTEGER) AS cand_idx,
    'm_' || l_linenumber AS tag, l_discount AS wer, l_tax AS sim, CASE WHEN l_returnflag = 'N' THEN l_quantity / 50 END AS cm FROM lineitem
)"""


def _norm(c: str, flat: str) -> str:
    return f"CASE WHEN max({c}) OVER g > min({c}) OVER g THEN ({c} - min({c}) OVER g) / (max({c}) OVER g - min({c}) OVER g) ELSE {flat} END AS {c}_norm"


NORM0 = f"n AS (SELECT *, {_norm('wer', '0e0')}, {_norm('sim', '0e0')}, {_norm('cm', '0e0')}, coalesce(max(cm) OVER g > min(cm) OVER g, false) AS varied FROM cand WINDOW g AS (PARTITION BY utt))"
NORMN = f"n AS (SELECT *, {_norm('wer', 'NULL')}, {_norm('sim', 'NULL')}, {_norm('cm', 'NULL')} FROM cand WINDOW g AS (PARTITION BY utt))"
DYNAMIC = f"""{CAND}, {NORMN}, w AS (
  SELECT *, coalesce(0.4e0 * (1 - wer_norm), 0e0) + coalesce(0.4e0 * sim_norm, 0e0) + coalesce(0.2e0 * cm_norm, 0e0) AS total,
    CASE WHEN wer_norm IS NULL THEN 0e0 ELSE 0.4e0 END + CASE WHEN sim_norm IS NULL THEN 0e0 ELSE 0.4e0 END + CASE WHEN cm_norm IS NULL THEN 0e0 ELSE 0.2e0 END AS weight FROM n
), s AS (SELECT * EXCLUDE (total, weight), CASE WHEN weight > 0 THEN total / weight END AS score FROM w),
b AS (SELECT *, CASE WHEN count(score) OVER g > 0 THEN coalesce(score, -1e0) WHEN count(sim) OVER g > 0 THEN coalesce(sim, -1e0) ELSE 0e0 END AS by_score FROM s WINDOW g AS (PARTITION BY utt)),
chosen AS (SELECT * EXCLUDE (by_score), row_number() OVER (PARTITION BY utt ORDER BY by_score DESC, cand_idx) = 1 AS chosen FROM b)"""
LOG = ("utt", "cand_idx", "tag", "wer", "sim", "cm", "wer_norm", "sim_norm", "cm_norm", "score", "chosen")
_R = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)


@query("score_log", f"WITH {DYNAMIC} SELECT utt, cand_idx, tag, {_R('wer', 'sim', 'cm', 'wer_norm', 'sim_norm', 'cm_norm', 'score')}, chosen FROM chosen")
def _(spark, d):
    return rounded(selection.score_log(candidates(spark, d)).select(*LOG))


def _runner_sql(term: str) -> str:
    return f"""WITH {CAND}, {NORM0}, s AS (SELECT *, CASE WHEN cm IS NULL OR NOT varied THEN 0.5e0 * ((1 - wer_norm) + sim_norm)
      ELSE 0.4e0 * (1 - wer_norm) + 0.4e0 * sim_norm + 0.2e0 * {term} END AS score FROM n)
    SELECT utt, cand_idx, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY score DESC NULLS LAST, cand_idx) AS r FROM s) WHERE r = 1"""


@query("best_penalize_spoof", _runner_sql("(1 - cm_norm)"))
def _(spark, d):
    return rounded(selection.pick_best(selection.score_penalize_spoof(candidates(spark, d))).select("utt", "cand_idx", "score"))


@query("best_constant_spoof", _runner_sql("0.5e0"))
def _(spark, d):
    return rounded(selection.pick_best(selection.score_constant_spoof(candidates(spark, d))).select("utt", "cand_idx", "score"))


@query("minmax_clipped", f"WITH {CAND}, {NORMN} SELECT utt, cand_idx, {_R('wer_norm', 'sim_norm', 'cm_norm')} FROM n")
def _(spark, d):
    out = selection.minmax_in_group(candidates(spark, d), ["wer", "sim", "cm"], flat=None, clip=True)
    return rounded(out.select("utt", "cand_idx", "wer_norm", "sim_norm", "cm_norm"))


@query("single_or_best", f"""WITH {CAND}, k AS (SELECT *, count(*) OVER (PARTITION BY utt) = 1 AS lone, max(CASE WHEN wer = 0.07e0 THEN 1 ELSE 0 END) OVER (PARTITION BY utt) AS broken FROM cand),
  b AS (SELECT utt, cand_idx, CASE WHEN NOT lone THEN wer END AS wer, CASE WHEN NOT lone THEN sim END AS sim, row_number() OVER (PARTITION BY utt ORDER BY CASE WHEN broken = 0 AND NOT lone THEN sim END DESC NULLS LAST, cand_idx) AS r FROM k)
  SELECT utt, cand_idx, wer, sim FROM b WHERE r = 1""")
def _(spark, d):
    df = candidates(spark, d).withColumn("failed", F.col("wer") == 0.07)
    df = selection.single_candidate_shortcut(df, asr_on=False, spoof_on=False)
    best, _ = selection.first_on_scoring_failure(df.withColumn("score", F.col("sim")))
    return best.select("utt", "cand_idx", "wer", "sim")


@query("scoring_errors", "SELECT DISTINCT l_orderkey AS utt, 'Scoring' AS stage FROM lineitem WHERE l_discount = 0.07e0")
def _(spark, d):
    df = candidates(spark, d).withColumn("failed", F.col("wer") == 0.07).withColumn("score", F.col("sim"))
    return selection.first_on_scoring_failure(df)[1].select("utt", "stage")


@query("losers", f"WITH {DYNAMIC} SELECT utt, cand_idx, tag FROM chosen WHERE NOT chosen")
def _(spark, d):
    return selection.losing_candidates(selection.score_dynamic_weights(candidates(spark, d))).select("utt", "cand_idx", "tag")


@query("scored_lines", f"""WITH {DYNAMIC} SELECT utt, cand_idx, 'utt=' || utt || ' | model=' || tag || ' | WER=' || printf('%.3f', wer) || ' | SIM=' || printf('%.3f', sim)
  || ' | AASIST=' || CASE WHEN cm IS NULL THEN 'NA' ELSE printf('%.3f', cm) END || ' | TOTAL=' || CASE WHEN score IS NULL THEN 'NA' ELSE printf('%.3f', round(score, 6) + 1e-9) END AS line FROM s""")
def _(spark, d):
    scored = selection.score_dynamic_weights(candidates(spark, d))
    return selection.score_lines(scored.withColumn("score", F.round("score", 6) + 1e-9))  # halves go up in both engines


@query("score_lines", f"""WITH {CAND} SELECT utt, cand_idx, 'utt=' || utt || ' | model=' || tag || ' | WER=' || printf('%.3f', wer) || ' | SIM=' || printf('%.3f', sim)
  || ' | AASIST=' || CASE WHEN cm IS NULL THEN 'NA' ELSE printf('%.3f', cm) END || ' | TOTAL=NA' AS line FROM cand""")
def _(spark, d):
    return selection.score_lines(candidates(spark, d).withColumn("score", F.lit(None).cast("double")))


@query("score_log_text", f"""WITH {DYNAMIC} SELECT CAST(utt AS VARCHAR) AS utt, tag, printf('%.6f', wer) AS wer, printf('%.6f', sim) AS sim, coalesce(printf('%.6f', cm), '') AS cm,
  CASE WHEN chosen THEN '1' ELSE '0' END AS chosen FROM chosen""")
def _(spark, d):
    return src.format_score_log(selection.score_log(candidates(spark, d)).select("utt", "tag", "wer", "sim", "cm", "chosen"))


_PLAN = [(i, b, s) for i, (b, s) in enumerate((b, s) for b, k in BACKENDS for s in range(k))]


@query("candidate_plan", "SELECT doc_id AS utt, p.* FROM documents CROSS JOIN (VALUES " + ", ".join(f"({i}, '{b}', {s}, '{b}_{s}')" for i, b, s in _PLAN) + ") AS p(cand_idx, backend, seed, tag)")
def _(spark, d):
    tasks = documents(spark, d)
    plan = selection.plan_candidates(spark, tasks, BACKENDS)
    # Planned backend by backend and put together again.
    return selection.union_candidates(*[plan.where(F.col("backend") == b) for b, _ in BACKENDS])


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("utt"), "text", F.col("n_chars").alias("size"), "source")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("utt"), "quality", "toxic")


@query("pending", "SELECT doc_id AS utt FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return completeness.pending_tasks(documents(spark, d).select("utt"), labels(spark, d))


@query("progress", "SELECT count(DISTINCT doc_id) AS n_done, greatest(0, (SELECT count(*) FROM documents) - count(DISTINCT doc_id)) AS n_left FROM labels")
def _(spark, d):
    return completeness.progress(labels(spark, d), documents(spark, d).agg(F.count("*")).scalar())


@query("missing_ids", "SELECT range AS utt FROM range(1, 1 + (SELECT count(*) FROM documents)) WHERE range NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return completeness.missing_by_bits(spark, documents(spark, d).agg(F.count("*")).scalar(), completeness.done_bitmaps(labels(spark, d)))


@query("pending_bits", "SELECT doc_id AS utt, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return completeness.pending_by_bits(documents(spark, d).select("utt", "source"), completeness.done_bitmaps(labels(spark, d)))


@query("progress_bits", "SELECT count(DISTINCT o_custkey) AS n_done, greatest(0, (SELECT count(*) FROM customer) - count(DISTINCT o_custkey)) AS n_left FROM orders")
def _(spark, d):
    bitmaps = completeness.done_bitmaps(table(spark, d, "orders").select(F.col("o_custkey").alias("utt")))
    return completeness.progress_by_bits(bitmaps, table(spark, d, "customer").agg(F.count("*")).scalar())


def listing(spark: SparkSession, d: str) -> DataFrame:
    odd = F.pmod("utt", F.lit(5))
    name = F.when(odd == 0, F.concat("utt", F.lit(".WAV"))).when(odd == 1, F.concat(F.lit("_tmp_"), F.col("utt"), F.lit(".wav"))).when(odd == 2, F.concat(F.lit("0"), F.col("utt"), F.lit(".wav")))
    rows = documents(spark, d).select("utt", F.coalesce(name, F.concat("utt", F.lit(".wav"))).alias("name"), (F.col("size") * 2).alias("size"), (F.col("size") / 4000).alias("duration_s"))
    return rows.select(F.concat(F.lit("/out/"), "name").alias("path"), "name", "size", "duration_s")


LISTING = """
listing AS (SELECT '/out/' || name AS path, name, size, duration_s FROM (SELECT CASE doc_id % 5 WHEN 0 THEN doc_id || '.WAV' WHEN 1 THEN '_tmp_' || doc_id || '.wav'
  WHEN 2 THEN '0' || doc_id || '.wav' ELSE doc_id || '.wav' END AS name, n_chars * 2 AS size, n_chars / 4000 AS duration_s FROM documents)),
official AS (SELECT CAST(regexp_extract(name, '^([0-9]+)', 1) AS BIGINT) AS utt, min(path) AS path, min_by(name, path) AS name, min_by(size, path) AS size FROM listing
  WHERE regexp_matches(name, '(?i)^[0-9]+\\.wav$') AND NOT contains(lower(name), 'tmp') AND size >= 4096 AND coalesce(duration_s >= 0.1e0, true) GROUP BY 1)"""


@query("official_outputs", f"WITH {LISTING} SELECT * FROM official")
def _(spark, d):
    return completeness.official_outputs(listing(spark, d))


@query("needs_fill", f"WITH {LISTING} SELECT t.doc_id AS utt FROM documents t LEFT JOIN official o ON t.doc_id = o.utt WHERE o.size IS NULL OR o.size <= 6000")
def _(spark, d):
    return completeness.needs_fill(documents(spark, d).select("utt"), completeness.official_outputs(listing(spark, d)), 6000)


_ROUTES = """routes AS (SELECT t.doc_id AS utt, CASE WHEN l.doc_id IS NOT NULL AND t.doc_id % 4 > 0 THEN 'best' WHEN t.doc_id % 3 = 0 THEN 'piper' WHEN l.doc_id IS NOT NULL THEN 'collage' ELSE 'tone' END AS route,
  CASE WHEN t.doc_id % 3 = 0 THEN 'piper' WHEN l.doc_id IS NOT NULL THEN 'collage' ELSE 'tone' END AS sweep FROM documents t LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON t.doc_id = l.doc_id)"""


def routes(spark: SparkSession, d: str) -> DataFrame:
    own = documents(spark, d).select("utt").join(labels(spark, d).select("utt", F.lit(True).alias("has")).distinct(), "utt", "left")
    has, piper = F.coalesce("has", F.lit(False)), F.pmod("utt", F.lit(3)) == 0
    return own.select("utt", completeness.main_route(F.pmod("utt", F.lit(4)), has, piper).alias("route"), completeness.sweep_route(has, piper).alias("sweep"))


@query("routes", f"WITH {_ROUTES} SELECT * FROM routes")
def _(spark, d):
    return routes(spark, d)


@query("run_counters", f"WITH {_ROUTES} SELECT CAST(count_if(route = 'piper') AS BIGINT) AS n_piper, CAST(count_if(route = 'collage') AS BIGINT) AS n_collage, CAST(count_if(route = 'tone') AS BIGINT) AS n_tone, CAST(count_if(route <> 'best') AS BIGINT) AS n_filled FROM routes")
def _(spark, d):
    return completeness.run_counters(routes(spark, d), F.col("route") != "best")


@query("final_table", f"""WITH {DYNAMIC}, c AS (SELECT utt, tag AS wav_path FROM chosen WHERE chosen)
  SELECT t.doc_id AS utt, t.doc_id || '.wav' AS synthesized_speech, coalesce(c.wav_path, 'tone:' || t.doc_id) AS wav_path, CASE WHEN c.utt IS NULL THEN 'fill' ELSE 'chosen' END AS origin
  FROM documents t LEFT JOIN c ON t.doc_id = c.utt""")
def _(spark, d):
    tasks = src.result_manifest(documents(spark, d).select("utt"))
    best = selection.pick_best_with_fallback(selection.score_dynamic_weights(candidates(spark, d))).select("utt", F.col("tag").alias("wav_path"))
    fills = tasks.select("utt", F.concat(F.lit("tone:"), "utt").alias("wav_path"))
    return completeness.final_table(tasks, best, fills)


@query("first_tasks", "SELECT doc_id AS utt, n_chars AS size FROM documents ORDER BY doc_id LIMIT 10")
def _(spark, d):
    return src.limit_tasks(documents(spark, d).select("utt", "size"), 10)


@query("error_summary", "SELECT event_id, event_type, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 5")
def _(spark, d):
    return completeness.error_summary(table(spark, d, "events").where("event_type = 'error'").select("event_id", "event_type"), "event_id")


@query("missing_references", "SELECT doc_id AS utt, 'MissingRef' AS stage, doc_id || '.wav' AS error FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    tasks = documents(spark, d).select("utt", F.concat("utt", F.lit(".wav")).alias("reference_speech"))
    return completeness.missing_references(tasks, labels(spark, d).select(F.concat("utt", F.lit(".wav")).alias("name")))


@query("cache_keys", """SELECT page_id, substr(sha1(url || '|' || length(html) || '|' || page_id), 1, 12) AS cut, 'p' || page_id || '__trim60s__' || substr(sha1(url || '|' || length(html) || '|' || page_id), 1, 12) || '.wav' AS trimmed,
  'p' || page_id || '.' || substr(sha1(url || 'hop=160'), 1, 10) || '.embed.wav' AS embed FROM pages""")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.char_length("html").alias("size"))
    key = completeness.cache_key(F.col("url"), F.col("size"), F.col("page_id"))
    stem = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    embed = completeness.embed_name(stem, completeness.config_key(F.col("url"), F.lit("hop=160")))
    return pages.select("page_id", key.alias("cut"), completeness.trimmed_name(stem, key).alias("trimmed"), embed.alias("embed"))


SENTENCES = f"""
cut AS (SELECT doc_id AS utt, list_filter(list_transform(regexp_extract_all(text, '([^{H}]{{79,}}?[{S}]|[^{H}]*[{H}]|[^{H}]+)', 1), lambda s: regexp_replace(s, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda s: s <> '') AS l FROM documents),
sent AS (SELECT utt, i - 1 AS pos, l[i] AS sentence, CASE WHEN i > 1 THEN right(l[i - 1], 8) END AS context FROM (SELECT utt, l, unnest(range(1, len(l) + 1)) AS i FROM cut))"""


@query("sentences", f"WITH {SENTENCES} SELECT utt, CAST(pos AS INTEGER) AS pos, sentence FROM sent")
def _(spark, d):
    return sentences.explode_sentences(documents(spark, d).select("utt", "text"))


@query("sentence_plan", f"WITH {SENTENCES} SELECT utt, CAST(pos AS INTEGER) AS pos, sentence, context, coalesce(context, '') || sentence AS in_text FROM sent")
def _(spark, d):
    return sentences.sentence_plan(documents(spark, d).select("utt", "text"))


@query("lookback", f"WITH {SENTENCES} SELECT utt, CAST(pos AS INTEGER) AS pos, context, coalesce(context, '') || sentence AS in_text FROM sent")
def _(spark, d):
    return sentences.lookback_context(sentences.explode_sentences(documents(spark, d).select("utt", "text"))).drop("sentence")


_DURATION = f"least(greatest(length(regexp_replace(sentence, '[\\s\\p{{Z}}]', '', 'g')) * 0.18e0 + (length(sentence) - length(regexp_replace(sentence, '[{H}]', '', 'g'))) * 0.2e0, 0.6e0), 15e0)"


@query("durations", f"WITH {SENTENCES} SELECT utt, CAST(pos AS INTEGER) AS pos, round({_DURATION}, 6) AS duration_s, round(CASE WHEN context IS NULL THEN 0.6e0 ELSE greatest(0.4e0, least(1e0, 0.2e0 + 0.1e0 * length(context))) END, 6) AS tail_s FROM sent")
def _(spark, d):
    plan = sentences.sentence_plan(documents(spark, d).select("utt", "text"))
    return rounded(plan.select("utt", "pos", text.estimate_duration(F.col("sentence")).alias("duration_s"), text.tail_window_seconds(F.col("context")).alias("tail_s")))


@query("timeline", f"""WITH {SENTENCES}, p AS (SELECT utt, pos, 1500 * length(sentence) AS n FROM sent)
  SELECT utt, CAST(pos AS INTEGER) AS pos, CAST(coalesce(sum(n - 1440) OVER w, 0) AS BIGINT) AS start, CAST(coalesce(sum(n - 1440) OVER w, 0) + n AS BIGINT) AS "end" FROM p
  WINDOW w AS (PARTITION BY utt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    pieces = documents(spark, d).select("utt", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence"))
    lengths = pieces.select("utt", "pos", (F.length("sentence") * 1500).alias("n"))
    return sentences.timeline_rows(lengths, "n", 1440).drop("n")


@query("timeline_linear", f"""WITH RECURSIVE {SENTENCES}, p AS (SELECT utt, pos, 300 * length(sentence) AS n FROM sent),
  laid AS (SELECT utt, pos, CAST(0 AS BIGINT) AS start, CAST(n AS BIGINT) AS stop FROM p WHERE pos = 0
    UNION ALL SELECT p.utt, p.pos, CASE WHEN l.stop > 1440 AND n > 1440 THEN l.stop - 1440 ELSE l.stop END, CASE WHEN l.stop > 1440 AND n > 1440 THEN l.stop - 1440 ELSE l.stop END + n FROM laid l JOIN p ON p.utt = l.utt AND p.pos = l.pos + 1)
  SELECT utt, CAST(pos AS INTEGER) AS pos, start, stop AS "end" FROM laid""")
def _(spark, d):
    """Pieces of 300 samples a character: the short ones are put after one another without an overlap."""
    pieces = documents(spark, d).select("utt", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence"))
    lengths = pieces.select("utt", "pos", (F.length("sentence") * 300).alias("n"))
    return sentences.timeline_rows(lengths, "n", 1440, equal_power=False).drop("n")


_D = "'零一二三四五六七八九点'"


@query("numerals", f"""SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '零一二三四五六七八九') AS spelled,
  translate(printf('%.2f', o_totalprice), '0123456789.', {_D}) AS price,
  CASE WHEN o_custkey % 100 < 10 THEN substr('零一二三四五六七八九', CAST(o_custkey % 100 AS INTEGER) + 1, 1)
    ELSE replace(CASE WHEN o_custkey % 100 < 20 THEN '' ELSE substr('零一二三四五六七八九', CAST(o_custkey % 100 // 10 AS INTEGER) + 1, 1) END || '十' || substr('零一二三四五六七八九', CAST(o_custkey % 10 AS INTEGER) + 1, 1), '零', '') END AS small,
  CASE WHEN o_orderkey >= 10000 THEN 'digits' ELSE 'number' END AS reading,
  CASE o_orderkey % 3 WHEN 0 THEN '千克' WHEN 1 THEN '千克' ELSE 'zz' END AS unit FROM orders""")
def _(spark, d):
    orders = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    unit = F.element_at(F.array(F.lit("kg"), F.lit("KG"), F.lit("zz")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return orders.select(
        "o_orderkey",
        numerals.digits_to_chinese(key).alias("spelled"),
        numerals.digits_to_chinese(F.format_string("%.2f", "o_totalprice")).alias("price"),
        numerals.int_to_chinese(F.col("o_custkey") % 100).alias("small"),
        numerals.number_reading(key, F.lit(""), F.lit("")).alias("reading"),
        numerals.canonical_unit(unit).alias("unit"),
    )


def _said_digits(x: str) -> str:
    return f"translate(CAST({x} AS VARCHAR), '0123456789.', '零一二三四五六七八九点')"


def _said(n: str) -> str:
    """SQL of the numeral of a whole number below 10^16."""
    parts = []
    for power, name in ((12, "兆"), (8, "亿"), (4, "万"), (0, "")):
        four = f"lpad(CAST(({n}) // {10**power} % 10000 AS VARCHAR), 4, '0')"
        placed = f"regexp_replace({_said_digits(four)}, '^(.)(.)(.)(.)$', '\\1千\\2百\\3十\\4')"
        group = f"trim(regexp_replace(regexp_replace({placed}, '零[千百十]', '零', 'g'), '零+', '零', 'g'), '零')"
        parts.append(f"CASE WHEN {group} = '' THEN '' ELSE {group} || '{name}' END")
    return f"CASE WHEN ({n}) = 0 THEN '零' ELSE regexp_replace({' || '.join(parts)}, '^一十', '十') END"


@query("spoken_prices", f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 1000003 AS k, printf('%.2f', o_totalprice) AS p FROM orders)
  SELECT o_orderkey, {_said("k")} AS key, {_said("CAST(split_part(p, '.', 1) AS BIGINT)")} || '点' || {_said_digits("split_part(p, '.', 2)")} AS price FROM o""")
def _(spark, d):
    price = F.format_string("%.2f", "o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", numerals.int_to_chinese(F.col("o_orderkey") * 1000003).alias("key"), numerals.number_to_chinese(price).alias("price"))


# SQL of the normaliser. RE2 has no look-around, so marks say where a number may begin or end; each rule's numbers are said at once.
_M, _Z, _Y = "", "", ""
_ALNUM = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._-"
_HELD = "".join(chr(0xE010 + k) for k in range(len(_ALNUM)))
_SP, _N, _RUN = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]*", "[0-9]+(?:\\.[0-9]+)?", f"{_Z}[0-9A-Za-z]+(?:_[0-9A-Za-z]+)*{_Y}"
_UNIT_SQL = "|".join(sorted(numerals.UNIT_NAMES, key=len, reverse=True))


def _swap(t: str, pattern: str, by: str) -> str:
    return f"regexp_replace({t}, '{pattern}', '{by}', 'g')"


def _words(t: str) -> str:
    """Both ends of every run of word characters are marked."""
    return _swap(t, "([\\p{L}\\p{N}_]+)", f"{_Z}\\1{_Y}")


def _kept(k: str) -> str:
    return f"(regexp_matches({k}, '[A-Za-z]') AND regexp_matches({k}, '[0-9]') AND NOT regexp_matches({k}, '^[0-9]+(\\.[0-9]+)?[A-Za-z]+$'))"


def _folded(t: str, say: str) -> str:
    """Every second piece `p` is said; the marks of starts and ends go."""
    return f"replace(replace(array_to_string(list_transform(string_split({t}, '{_M}'), lambda p, i: CASE WHEN i % 2 = 0 THEN {say} ELSE p END), ''), '{_Z}', ''), '{_Y}', '')"


def _said_text(x: str) -> str:
    whole = _said(f"TRY_CAST(split_part({x}, '.', 1) AS BIGINT)")
    return f"""CASE WHEN regexp_matches({x}, '^0*[1-9][0-9]{{16}}') THEN {_said_digits(x)} WHEN contains({x}, '.') THEN {whole} || '点' || {_said_digits(f"split_part({x}, '.', 2)")} ELSE {whole} END"""


def _normalized(table: str) -> str:
    """CTEs from (utt, text) of `table` to (utt, t) of `spoken`."""
    bare = lambda k: f"split_part(p, '|', {k})"
    names = lambda u: f"CASE {u} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in numerals.UNIT_NAMES.items()) + " END"
    x, plain = "substr(p, 2)", "replace(replace(p, '" + _Z + "', ''), '" + _Y + "', '')"
    say = f"""CASE left(p, 1) WHEN 'n' THEN {_said_text(x)} WHEN 'd' THEN {_said_digits(x)} ELSE coalesce({names(x)}, {names(f"lower({x})")}, {x}) END"""
    say_bare = f"""CASE WHEN {bare(3)} = '' AND ({bare(1)} <> '' OR length({bare(2)}) > 4 OR contains({bare(2)}, '.')) THEN {_said_digits(bare(2))} ELSE {_said_text(bare(2))} END"""
    n = lambda k: f"{_M}n\\{k}{_M}"
    unlettered = lambda t: _swap(t, "([A-Za-z])([0-9])", f"\\1\\2{_Z}")
    ended = lambda t, more="": _swap(t, f"([0-9])([A-Za-z{more}])", f"{_Y}\\1\\2")
    begun = lambda t: _swap(t, f"(^|[^A-Za-z_0-9{_Y}])([0-9]+)", f"\\1{_Z}\\2")
    number, unit = f"({_N}){_SP}", f"{n(1)}{_M}u\\2{_M}"
    steps = [
        _folded(_swap(_words("text"), f"({_RUN}(?:[.-]{_RUN})*)", f"{_M}\\1{_M}"), f"CASE WHEN {_kept(plain)} THEN translate({plain}, '{_ALNUM}', '{_HELD}') ELSE p END"),
        _folded(_swap(_words("t"), f"{_Z}([0-9]{{4}}){_Y}-{_Z}([0-9]{{1,2}}){_Y}-{_Z}([0-9]{{1,2}}){_Y}", f"{_M}d\\1{_M}年{n(2)}月{n(3)}日"), say),
        _folded(_swap(unlettered("t"), "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", f"{_M}d\\1{_M}年{n(2)}月{n(3)}日"), say),
        _folded(_swap(unlettered("t"), "([0-9]{1,2})月([0-9]{1,2})日", f"{n(1)}月{n(2)}日"), say),
        _folded(_swap(unlettered("t"), "([0-9]{1,2})时([0-9]{1,2})分", f"{n(1)}时{n(2)}分"), say),
        _folded(_swap("t", f"{number}%", f"百分之{n(1)}"), say),
        _folded(_swap(unlettered(ended("t")), f"{number}[-~—–]{_SP}({_N})", "\\1到\\2"), "p"),
        _folded(_swap("t", f"(?i)[-−]{_SP}{number}({_UNIT_SQL})", f"负{unit}"), say),
        _folded(_swap("t", f"(?i){number}({_UNIT_SQL})", unit), say),
        _folded(_swap(ended(_swap("t", "([A-Za-z0-9_])-", f"\\1-{_Z}"), "%"), f"-({_N})", f"负{n(1)}"), say),
        _folded(_swap(begun(ended("t", "%")), f"([{numerals.ID_MARKS}])?{_Z}([0-9]+)(?:(\\.){_Z}([0-9]+))?({'|'.join(sorted(numerals.MEASURE_WORDS, key=len, reverse=True))})?", f"\\1{_M}\\1|\\2\\3\\4|\\5{_M}\\5"), say_bare),
    ]
    ctes = [f"step{k} AS (SELECT utt, {s} AS t FROM {f'step{k - 1}' if k else table})" for k, s in enumerate(steps)]
    return ", ".join([*ctes, f"spoken AS (SELECT utt, translate(t, '{_HELD}', '{_ALNUM}') AS t FROM step{len(steps) - 1})"])


_TEXTS = "texts AS (SELECT doc_id AS utt, text FROM documents)"


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _rule_texts() -> list[tuple[list[str], dict[str, Column]]]:
    """Texts for the rules of the normaliser, beside the columns that they are written from."""
    n, day, month, dom, hour, minute = map(F.col, ("n", "day", "month", "dom", "hour", "minute"))
    return [
        (["day"], {"dashed": F.date_format(day, "'发于 'yyyy-MM-dd'。'"), "dated": _text(F.year(day), "年", F.month(day), "月", F.dayofmonth(day), "日发布")}),
        (["month", "dom", "hour", "minute"], {"timed": _text("于", month, "月", dom, "日", hour, "时", minute, "分")}),
        (["n"], {
            "share": _text("约", n, "%左右"), "span": _text("需要", n, "-", n + 3, "天"), "signed": _text("气温-", n, "℃"), "amount": _text("重", n, "kg，长", n, "KM"),
            "negative": _text("得分为 -", n, "。"), "counted": _text("共", n, "人"), "known": _text("编号：", n, "。"), "long": _text("房间 ", n + 10000, "。"),
            "price": _text("付", n, ".25元"), "ratio": _text("比率 ", n, ".25，"), "kept": _text("见 A", n, "-B 与 v", n, " 和 ", n, "kg。"),
        }),
    ]


def _rule_values(orders: DataFrame) -> DataFrame:
    """An order's numbers and date, around which the texts are written."""
    n, day = (F.col("o_orderkey") % 9990).cast("int"), F.col("o_orderdate").cast("date")
    return orders.select("o_orderkey", n.alias("n"), day.alias("day"), F.month(day).alias("month"), F.dayofmonth(day).alias("dom"), (n % 24).alias("hour"), (n % 60).alias("minute"))


def written_rules(spark: SparkSession, d: str) -> DataFrame:
    """A text for each rule of the normaliser, around an order's numbers and date. Orders are few bytes for that work, so they are dealt first."""
    o = _rule_values(dealt(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey"))
    return o.select("o_orderkey", *[text.alias(c) for _, texts in _rule_texts() for c, text in texts.items()])


def said_rules(spark: SparkSession, d: str) -> DataFrame:
    """The texts of `written_rules`, normalised. What is written from the same values is the same, so it is said once, and each order looks it up.

    The values are few whatever the orders: remainders by 9,990, days of the calendar, days of a year by hour and minute.
    """
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    out = _rule_values(dealt(orders, "o_orderkey"))
    for keys, texts in _rule_texts():
        written = _rule_values(orders).select(*keys).distinct().select(*keys, F.array(*texts.values()).alias("texts"))
        said = written.select(*keys, F.transform("texts", normalize.normalize_text).alias("said"))  # one expression for all, as each takes long to plan
        out = out.join(F.broadcast(said.select(*keys, *[F.col("said")[k].alias(c) for k, c in enumerate(texts)])), keys, "left")
    return out.select("o_orderkey", *[c for _, texts in _rule_texts() for c in texts])


@query("spoken_rules", f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 9990 AS INTEGER) AS n, CAST(o_orderdate AS DATE) AS d FROM orders),
  p AS (SELECT *, {_said("n")} AS s, {_said_digits("n")} AS spelled, {_said_digits("year(d)")} || '年' || {_said("month(d)")} || '月' || {_said("day(d)")} || '日' AS dated FROM o)
  SELECT o_orderkey, '发于 ' || dated || '。' AS dashed, dated || '发布' AS dated, '于' || split_part(dated, '年', 2) || {_said("n % 24")} || '时' || {_said("n % 60")} || '分' AS timed,
    '约百分之' || s || '左右' AS share, '需要' || s || '到' || {_said("n + 3")} || '天' AS span, '气温负' || s || '摄氏度' AS signed, '重' || s || '千克，长' || s || '千米' AS amount,
    '得分为 负' || s || '。' AS negative, '共' || s || '人' AS counted, '编号：' || spelled || '。' AS known, '房间 ' || {_said_digits("n + 10000")} || '。' AS long,
    '付' || s || '点二五元' AS price, '比率 ' || spelled || '点二五，' AS ratio, '见 A' || n || '-B 与 v' || n || ' 和 ' || s || '千克。' AS kept FROM p""")
def _(spark, d):
    return said_rules(spark, d)


@query("kept_tokens", """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 9990 AS INTEGER) AS n FROM orders)
  SELECT o_orderkey, 0 AS token_pos, 'A' || n || '-B' AS token FROM o UNION ALL SELECT o_orderkey, 1, 'v' || n FROM o""")
def _(spark, d):
    return normalize.protected_tokens(written_rules(spark, d).select("o_orderkey", F.col("kept").alias("text")))


@query("number_readings", """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '元' WHEN 1 THEN '，' ELSE '公里' END AS r, CASE WHEN o_custkey % 2 = 0 THEN '编号：' ELSE '约' END AS l, o_orderkey % 4 = 0 AS pointed FROM orders)
  SELECT o_orderkey, CASE WHEN r <> '，' THEN 'number' WHEN l = '编号：' OR pointed OR o_orderkey >= 10000 THEN 'digits' ELSE 'number' END AS reading FROM o""")
def _(spark, d):
    key = F.col("o_orderkey")
    right = F.element_at(F.array(F.lit("元"), F.lit("，"), F.lit("公里")), (key % 3 + 1).cast("int"))
    left = F.when(F.col("o_custkey") % 2 == 0, "编号：").otherwise("约")
    number = F.concat(key.cast("string"), F.when(key % 4 == 0, ".5").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", numerals.number_reading(number, left, right).alias("reading"))


@query("protected_tokens", f"""WITH found AS (SELECT doc_id AS utt, list_filter(list_transform(regexp_extract_all({_words("text")}, '{_RUN}(?:[.-]{_RUN})*'), lambda k: replace(replace(k, '{_Z}', ''), '{_Y}', '')), lambda k: {_kept("k")}) AS l FROM documents)
  SELECT utt, CAST(i - 1 AS INTEGER) AS token_pos, l[i] AS token FROM (SELECT utt, l, unnest(range(1, len(l) + 1)) AS i FROM found)""")
def _(spark, d):
    return normalize.protected_tokens(documents(spark, d).select("utt", "text"))


@query("ranges", """SELECT doc_id AS utt, regexp_replace(doc_id || ' - ' || n_chars || '天', '([0-9]+(?:\\.[0-9]+)?)\\s*[-~—–]\\s*([0-9]+(?:\\.[0-9]+)?)', '\\1到\\2', 'g') AS said FROM documents""")
def _(spark, d):
    spoken = F.concat(F.col("utt").cast("string"), F.lit(" - "), F.col("size").cast("string"), F.lit("天"))
    return documents(spark, d).select("utt", normalize.ranges_to_words(spoken).alias("said"))


@query("normalize_documents", f"WITH {_TEXTS}, {_normalized('texts')} SELECT utt, t AS spoken FROM spoken")
def _(spark, d):
    return documents(spark, d).select("utt", normalize.normalize_text("text").alias("spoken"))


def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Later turns against the first, whole texts."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    ref = c.where("turn = 0").groupBy("conv_id").agg(F.min("t").alias("ref"))
    return c.where("turn > 0").join(ref, "conv_id").select("conv_id", "turn", "ref", F.col("t").alias("hyp"))


def _signs(own: str, only: int) -> str:
    """SQL of a list as a string of one byte an item: DuckDB's levenshtein counts bytes.

    Items that both lists have get a sign each; the others of a side match nothing, so one sign does for all.
    """
    return f"array_to_string(list_transform({own}, lambda x: chr(CASE WHEN list_contains(shared, x) THEN CAST(list_position(shared, x) AS INTEGER) + 2 ELSE {only} END)), '')"


_WHITE = r"[\s\v\p{Z}\x{85}]"
#: Over 125 shared items there are no more signs of one byte, and the SQL's distance is null.
_EDITS = f"CASE WHEN len(shared) <= 125 THEN levenshtein({_signs('a', 1)}, {_signs('b', 2)}) END"
_SHARED = "list_distinct(list_intersect(a, b)) AS shared"

HYP = rf"""
h AS (SELECT c.conv_id, c.turn, r.ref, c.text AS hyp FROM conversations c JOIN (SELECT conv_id, min(text) AS ref FROM conversations WHERE turn = 0 GROUP BY conv_id) r ON c.conv_id = r.conv_id WHERE c.turn > 0),
l AS (SELECT *, regexp_extract_all(regexp_replace(ref, '{_WHITE}', '', 'g'), '(?s).') AS a, regexp_extract_all(regexp_replace(hyp, '{_WHITE}', '', 'g'), '(?s).') AS b FROM h),
e AS (SELECT *, CASE WHEN len(a) = 0 THEN CASE WHEN len(b) = 0 THEN 0e0 ELSE 1e0 END ELSE {_EDITS} / len(a) END AS cer FROM (SELECT *, {_SHARED} FROM l))"""
CER = f"WITH {HYP} SELECT conv_id, turn, round(cer, 6) AS cer FROM e"


def cer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hypotheses(spark, d).select("conv_id", "turn", metrics.cer(F.col("ref"), F.col("hyp")).alias("cer")))


# Two names, one query: `cer` once left out what is not ASCII.
query("cer", CER)(cer)
query("cer_whole", CER)(cer)


_STATUS = "CASE turn % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'failed' ELSE 'ok' END"


POLICY = f"""WITH {HYP}, p AS (SELECT *, {_STATUS} AS status, regexp_replace(hyp, '{_WHITE}', '', 'g') = '' AS nothing FROM e) SELECT conv_id, turn,
  round(CASE WHEN status <> 'ok' THEN 0.5e0 WHEN nothing THEN 1e0 ELSE cer END, 6) AS neutral, round(CASE WHEN status = 'ok' AND NOT nothing THEN cer END, 6) AS nullable FROM p"""


def asr_policy(spark: SparkSession, d: str) -> DataFrame:
    part = F.pmod("turn", F.lit(5))
    h = hypotheses(spark, d).withColumn("status", F.when(part == 0, "off").when(part == 1, "failed").otherwise("ok"))
    h = h.withColumn("cer", metrics.cer(F.col("ref"), F.col("hyp")))
    neutral, nullable = (f(F.col("cer"), F.col("hyp"), F.col("status")) for f in (metrics.asr_error, metrics.asr_error_nullable))
    return rounded(h.select("conv_id", "turn", neutral.alias("neutral"), nullable.alias("nullable")))


query("asr_policy", POLICY)(asr_policy)
query("asr_policy_whole", POLICY)(asr_policy)


@query("wer", rf"""WITH {HYP.split("l AS (")[0]} w AS (SELECT conv_id, turn, list_filter(string_split_regex(ref, '{_WHITE}+'), lambda x: x <> '') AS a, list_filter(string_split_regex(hyp, '{_WHITE}+'), lambda x: x <> '') AS b FROM h)
  SELECT conv_id, turn, round(CASE WHEN len(a) > 0 THEN {_EDITS} / len(a) END, 6) AS wer FROM (SELECT *, {_SHARED} FROM w)""")
def _(spark, d):
    return rounded(hypotheses(spark, d).select("conv_id", "turn", metrics.wer("ref", "hyp").alias("wer")))


@query("wer_letters", r"""WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '~', 'g'), '\s', '', 'g') AS t FROM conversations),
  h AS (SELECT c.conv_id, c.turn, r.ref, c.t FROM c JOIN (SELECT conv_id, min(t) AS ref FROM c WHERE turn = 0 GROUP BY conv_id) r ON c.conv_id = r.conv_id WHERE c.turn > 0)
  SELECT conv_id, turn, round(CASE WHEN length(ref) > 0 THEN levenshtein(ref, t) / length(ref) END, 6) AS wer FROM h""")
def _(spark, d):
    """Each character a word of its own, what isn't ASCII as ~."""
    letters = F.regexp_replace(F.regexp_replace("text", r"[^\x00-\x7F]", "~"), r"\s", "")
    c = table(spark, d, "conversations").select("conv_id", "turn", letters.alias("t"))
    apart = lambda c: F.trim(F.regexp_replace(c, "(.)", "$1 "))
    ref = c.where("turn = 0").groupBy("conv_id").agg(F.min("t").alias("ref"))
    both = c.where("turn > 0").join(ref, "conv_id").select("conv_id", "turn", apart("ref").alias("ref"), apart("t").alias("hyp"))
    return rounded(both.select("conv_id", "turn", metrics.wer("ref", "hyp").alias("wer")))


@query("hypotheses", r"SELECT conv_id, regexp_replace(string_agg(text, '' ORDER BY turn, text), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS hypothesis FROM conversations GROUP BY conv_id")
def _(spark, d):
    return selection.hypothesis_from_segments(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("similarity", """WITH f AS (SELECT label, min(vec_id) AS ref FROM embeddings GROUP BY label), v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  n AS (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_sum(list_transform(e, lambda y: y * y))) + 1e-9)) AS e FROM v)
  SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])), 6) AS sim FROM n a JOIN f ON a.label = f.label JOIN n b ON b.vec_id = f.ref""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    refs = e.groupBy(F.col("label").alias("utt")).agg(F.min_by("embedding", "vec_id").alias("ref_vector"))
    cands = e.select("vec_id", F.col("label").alias("utt"), F.col("embedding").alias("vector"))
    return rounded(selection.speaker_similarity(cands, refs).select("vec_id", "sim"))


_HOT_LABEL = "CASE WHEN vec_id % 2 = 0 THEN 0 ELSE label END"


@query("hot_similarity", f"""WITH f AS (SELECT {_HOT_LABEL} AS label, min(vec_id) AS ref FROM embeddings GROUP BY 1), v AS (SELECT vec_id, {_HOT_LABEL} AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  n AS (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_sum(list_transform(e, lambda y: y * y))) + 1e-9)) AS e FROM v)
  SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])), 6) AS sim FROM n a JOIN f ON a.label = f.label JOIN n b ON b.vec_id = f.ref""")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("utt", F.expr(_HOT_LABEL))  # half of all vectors have one label
    refs = e.groupBy("utt").agg(F.min_by("embedding", "vec_id").alias("ref_vector"))
    cands = e.select("vec_id", "utt", F.col("embedding").alias("vector"))
    return rounded(selection.speaker_similarity(cands, refs, held=200).select("vec_id", "sim"))


@query("spoof_prob", """WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)
  SELECT vec_id, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS last, round(exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS first,
    round(1 / (1 + exp(-a)), 6) AS one, round(1 - 1 / (1 + exp(-a)), 6) AS one_first, CAST(NULL AS DOUBLE) AS bona FROM v""")
def _(spark, d):
    two, one = F.slice("embedding", 1, 2), F.slice("embedding", 1, 1)
    p = metrics.spoof_probability
    e = table(spark, d, "embeddings")
    return rounded(e.select("vec_id", p(two).alias("last"), p(two, "first").alias("first"), p(one).alias("one"), p(one, "first").alias("one_first"), metrics.bonafide_probability(F.slice("embedding", 1, 0)).alias("bona")))


@query("bonafide_prob", """WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)
  SELECT vec_id, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS two, round(1 / (1 + exp(-a)), 6) AS one, CAST(NULL AS DOUBLE) AS none FROM v""")
def _(spark, d):
    p = lambda n: metrics.bonafide_probability(F.slice("embedding", 1, n))
    return rounded(table(spark, d, "embeddings").select("vec_id", p(2).alias("two"), p(1).alias("one"), p(0).alias("none")))


@query("score_replies", """WITH r AS (SELECT event_id, value, event_id % 7 AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events)
  SELECT event_id, round(CASE WHEN k IN (0, 1) THEN n / 100 WHEN k = 2 THEN 0.5e0 ELSE n / 100 END, 6) AS score, CASE WHEN k = 2 THEN 'fallback' WHEN k = 0 THEN 'regex' ELSE 'repo' END AS backend,
    CASE WHEN k = 2 THEN 'boom' END AS error FROM r""")
def _(spark, d):
    k, n = F.pmod("event_id", F.lit(7)), F.get_json_object("props", "$.k").cast("bigint") / 100
    body = F.format_string('{"cm_score": %.2f, "backend": "repo"}', n)
    reply = F.when(k == 0, F.concat(F.lit("x "), body, F.lit(" y\nbye"))).when(k == 2, "boom").otherwise(F.concat(F.lit("log\n"), body, F.lit("\n")))
    out = table(spark, d, "events").select("event_id", metrics.score_reply_or_neutral(reply).alias("r"))
    return rounded(out.select("event_id", "r.score", "r.backend", "r.error"))


def frame_rows(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("clip_id"), (F.row_number().over(order) - 1).alias("frame_idx"), F.col("value").alias("energy"), "event_type"
    )


FRM = """
frm AS (SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx, value AS energy, event_type FROM events),
med AS (SELECT *, energy >= greatest(1e-4, 0.6e0 * median(energy) OVER (PARTITION BY clip_id)) AS is_speech FROM frm)"""
RUNS = f"""{FRM}, isl AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS k FROM med WHERE is_speech),
runs AS (SELECT clip_id, CAST(min(frame_idx) * {HOP} AS BIGINT) AS start, CAST(max(frame_idx) * {HOP} + {HOP} AS BIGINT) AS "end" FROM isl GROUP BY clip_id, k)"""
MERGED = f"""{RUNS}, sizes AS (SELECT clip_id, CAST((max(frame_idx) + 1) * {HOP} AS BIGINT) AS length FROM frm GROUP BY clip_id),
padded AS (SELECT clip_id, greatest(0, start - {PAD // 4}) AS start, least(length, "end" + {PAD // 4}) AS "end" FROM runs JOIN sizes USING (clip_id)),
apart AS (SELECT *, coalesce(CAST(start > lag("end") OVER w + {PAD // 4} AS INTEGER), 1) AS fresh FROM padded WINDOW w AS (PARTITION BY clip_id ORDER BY start, "end")),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY clip_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS seg FROM apart),
merged AS (SELECT clip_id, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end" FROM numbered GROUP BY clip_id, seg)"""
SEGS = f"""{MERGED}, segs AS (SELECT s.clip_id, s.start, s."end", avg(f.energy) AS energy FROM frm f JOIN merged s ON f.clip_id = s.clip_id AND f.frame_idx * {HOP} >= s.start AND f.frame_idx * {HOP} < s."end" GROUP BY ALL),
scored AS (SELECT *, round(0.7e0 * ("end" - start) / {HOP} + 0.3e0 * energy, 9) AS score FROM segs WHERE "end" - start >= {int(0.1 * SR)})"""


def runs(spark, d):
    return fr.speech_runs(fr.voiced_by_median(frame_rows(spark, d), "energy"), HOP)


def clip_sizes(spark, d):
    return frame_rows(spark, d).groupBy("clip_id").agg(((F.max("frame_idx") + 1) * HOP).cast("long").alias("length"))


def merged(spark, d):
    return fr.pad_and_merge(runs(spark, d).join(clip_sizes(spark, d), "clip_id"), PAD // 4, "length")


def scored(spark, d):
    energy = fr.segment_energy(frame_rows(spark, d), merged(spark, d), HOP).withColumn("hnr", (F.col("end") - F.col("start")) / HOP)
    return fr.segment_score(energy, SR, "hnr").withColumn("score", F.round("score", 9))


@query("voiced_median", f"WITH {FRM} SELECT clip_id, frame_idx, is_speech FROM med")
def _(spark, d):
    return fr.voiced_by_median(frame_rows(spark, d), "energy").select("clip_id", "frame_idx", "is_speech")


@query("voiced_peak", f"""WITH {FRM}, loud AS (SELECT clip_id, frame_idx FROM (SELECT *, max(energy) OVER (PARTITION BY clip_id) AS peak FROM frm) WHERE energy >= peak * {10 ** -0.6!r} AND energy > 0),
  runs AS (SELECT clip_id, CAST(min(frame_idx) * {HOP} AS BIGINT) AS start, CAST(max(frame_idx) * {HOP} + {HOP} AS BIGINT) AS "end" FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS k FROM loud) GROUP BY clip_id, k),
  kept AS (SELECT * FROM runs WHERE "end" - start > {int(0.2 * SR)}), n AS (SELECT clip_id, (max(frame_idx) + 1) * {HOP} AS n FROM frm GROUP BY clip_id)
  SELECT * FROM kept UNION ALL SELECT clip_id, CAST(greatest(0, n // 2 - {6 * SR}) AS BIGINT), CAST(least(n, greatest(0, n // 2 - {6 * SR}) + {12 * SR}) AS BIGINT) FROM n WHERE clip_id NOT IN (SELECT clip_id FROM kept)""")
def _(spark, d):
    return fr.voiced_by_peak(frame_rows(spark, d), HOP, SR, top_db=6.0)


@query("speech_runs", f"WITH {RUNS} SELECT * FROM runs")
def _(spark, d):
    return runs(spark, d)


@query("merged", f"WITH {MERGED} SELECT * FROM merged")
def _(spark, d):
    return merged(spark, d)


@query("segment_energy", f"""WITH {SEGS} SELECT clip_id, start, "end", round(energy, 9) AS energy FROM segs""")
def _(spark, d):
    return rounded(fr.segment_energy(frame_rows(spark, d), merged(spark, d), HOP), 9)


@query("segment_scores", f"""WITH {SEGS} SELECT clip_id, start, "end", score FROM scored""")
def _(spark, d):
    return scored(spark, d).select("clip_id", "start", "end", "score")


@query("top_segments", f"""WITH {SEGS}, r AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, coalesce(sum("end" - start) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM scored WINDOW w AS (PARTITION BY clip_id ORDER BY score DESC, start))
  SELECT clip_id, rank, start, CAST(least("end", start + 3200 - before) AS BIGINT) AS "end" FROM r WHERE before < 3200
  UNION ALL SELECT clip_id, 1, 0, least(3200, length) FROM sizes WHERE clip_id NOT IN (SELECT clip_id FROM scored)""")
def _(spark, d):
    return fr.pick_top_segments(scored(spark, d), 3200, clip_sizes(spark, d))


@query("stitched", f"""WITH {MERGED}, p AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY clip_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM merged),
  u AS (SELECT * FROM p WHERE before < 9600), e AS (SELECT clip_id, sum("end" - start) AS got, max_by(start, start) AS s, max_by("end", start) AS t, count(*) AS n FROM u GROUP BY clip_id HAVING got < 9600)
  SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY start) AS INTEGER) AS part, 'segment' AS kind, start, "end" FROM u
  UNION ALL SELECT clip_id, CAST(n + 1 AS INTEGER), 'repeat', s, CAST(s + least(9600 - got, t - s) AS BIGINT) FROM e
  UNION ALL SELECT clip_id, CAST(n + 2 AS INTEGER), 'pad', 0, CAST(9600 - got - least(9600 - got, t - s) AS BIGINT) FROM e WHERE 9600 - got > least(9600 - got, t - s)""")
def _(spark, d):
    return fr.stitch_in_order(merged(spark, d), 9600)


SNR = f"""{MERGED}, m AS (SELECT f.*, EXISTS (SELECT 1 FROM merged s WHERE s.clip_id = f.clip_id AND f.frame_idx * {HOP} >= s.start AND f.frame_idx * {HOP} < s."end") AS inside FROM frm f),
sides AS (SELECT clip_id, count_if(inside) * {HOP} AS sp, count_if(NOT inside) * {HOP} AS ns, avg(energy) FILTER (inside) + 1e-12 AS ps, avg(energy) FILTER (NOT inside) + 1e-12 AS pn,
  quantile_cont(sqrt(energy), 0.8) AS q80, quantile_cont(sqrt(energy), 0.2) + 1e-8 AS q20 FROM m GROUP BY clip_id),
snr AS (SELECT clip_id, CASE WHEN sp < {0.2 * SR} OR ns < {0.2 * SR} THEN 20 * log10(q80 / q20) ELSE 10 * log10(ps / pn) END AS snr_db FROM sides)"""


@query("snr", f"WITH {SNR} SELECT clip_id, round(snr_db, 6) AS snr_db FROM snr")
def _(spark, d):
    return rounded(fr.snr_from_speech(frame_rows(spark, d), merged(spark, d), HOP, SR))


@query("denoise", f"""WITH {SNR} SELECT clip_id, CASE WHEN snr_db >= 15 THEN NULL WHEN snr_db >= 8 THEN 0.4e0 ELSE 0.2e0 END AS embed, 0.9e0 AS asr,
  CASE WHEN snr_db < 10 OR clip_id % 30 < 15 THEN 0.12e0 END AS auto, 0.1e0 AS light FROM snr""")
def _(spark, d):
    snr = fr.snr_from_speech(frame_rows(spark, d), merged(spark, d), HOP, SR)
    db, hnr = F.col("snr_db"), F.pmod("clip_id", F.lit(30))
    return snr.select("clip_id", fr.denoise_policy_dual(db).alias("embed"), fr.denoise_policy_dual(db, "asr").alias("asr"), fr.denoise_policy_auto(db, hnr).alias("auto"), fr.denoise_policy_auto(db, hnr, "light").alias("light"))


def bins(spark, d):
    kind = F.col("event_type")
    freq = F.when(kind == "view", 50.0).when(kind == "click", 60.0).otherwise(F.col("frame_idx") % 7 * 10.0)
    return frame_rows(spark, d).select("clip_id", "frame_idx", freq.alias("freq_hz"), (F.col("energy") / 100).alias("mag"))


BINS = f"{FRM}, bins AS (SELECT clip_id, frame_idx, CASE event_type WHEN 'view' THEN 50e0 WHEN 'click' THEN 60e0 ELSE frame_idx % 7 * 10e0 END AS freq_hz, energy / 100 AS mag FROM frm)"


@query("spectrum_snr", f"""WITH {BINS}, q AS (SELECT clip_id, freq_hz, quantile_cont(mag, 0.1) AS a, quantile_cont(mag, 0.9) AS b FROM bins GROUP BY ALL)
  SELECT clip_id, round(20 * log10(avg(b + 1e-9) / avg(a + 1e-9) + 1e-9), 6) AS snr_db FROM q GROUP BY clip_id""")
def _(spark, d):
    return rounded(fr.snr_from_percentiles(bins(spark, d)))


@query("hum", f"""WITH {BINS}, p AS (SELECT clip_id, round(coalesce(avg(mag) FILTER (freq_hz BETWEEN 47 AND 53), 0e0), 9) AS p50, round(coalesce(avg(mag) FILTER (freq_hz BETWEEN 57 AND 63), 0e0), 9) AS p60 FROM bins GROUP BY clip_id)
  SELECT clip_id, CASE WHEN greatest(p50, p60) < 0.001 THEN NULL WHEN p50 >= p60 THEN 50 ELSE 60 END AS hum_hz FROM p""")
def _(spark, d):
    return fr.hum_decision(bins(spark, d))


@query("spectral_floor", f"""WITH {BINS}, q AS (SELECT *, quantile_cont(mag + 1e-8, 0.1) OVER (PARTITION BY clip_id, freq_hz) AS f FROM bins)
  SELECT clip_id, frame_idx, freq_hz, round(greatest(mag + 1e-8 - 0.9e0 * f, 0e0), 6) AS floored FROM q""")
def _(spark, d):
    return rounded(fr.spectral_floor(bins(spark, d)).select("clip_id", "frame_idx", "freq_hz", "floored"))


@query("clip_report", f"""WITH {MERGED} SELECT clip_id, length, string_agg(start || '-' || "end", ' ' ORDER BY start) AS segments FROM sizes LEFT JOIN merged USING (clip_id) GROUP BY clip_id, length""")
def _(spark, d):
    report = fr.clip_report(merged(spark, d), clip_sizes(spark, d))
    shown = F.transform("segments", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return report.select("clip_id", "length", F.when(F.size("segments") > 0, F.array_join(shown, " ")).alias("segments"))


CLEAN = f"""{SNR}, segs AS (SELECT s.clip_id, s.start, s."end", avg(f.energy) AS energy FROM frm f JOIN merged s ON f.clip_id = s.clip_id AND f.frame_idx * {HOP} >= s.start AND f.frame_idx * {HOP} < s."end" GROUP BY ALL),
scored AS (SELECT *, energy AS score FROM segs WHERE "end" - start >= {int(0.1 * SR)}),
r AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY clip_id ORDER BY score DESC, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM scored),
top AS (SELECT clip_id, start, CAST(least("end", start + {2 * SR} - before) AS BIGINT) AS stop FROM r WHERE before < {2 * SR}
  UNION ALL SELECT clip_id, 0, least({2 * SR}, length) FROM sizes WHERE clip_id NOT IN (SELECT clip_id FROM scored)),
lists AS (SELECT clip_id, '[' || string_agg('{{"start":' || start || ',"end":' || stop || '}}', ',' ORDER BY start, stop) || ']' AS segments FROM top GROUP BY clip_id)"""


@query("clean_clips", f"""WITH {CLEAN} SELECT clip_id, length, round(snr_db, 6) AS snr_db, CASE WHEN snr_db >= 15 THEN NULL WHEN snr_db >= 8 THEN 0.4e0 ELSE 0.2e0 END AS denoise, coalesce(segments, '[]') AS segments
  FROM sizes LEFT JOIN snr USING (clip_id) LEFT JOIN lists USING (clip_id)""")
def _(spark, d):
    report = jobs.clean_clips(frame_rows(spark, d), jobs.ClipConfig(HOP, PAD // 4, SR, 2.0))
    return rounded(report.withColumn("segments", F.to_json("segments")))


@query("text_plan", f"""WITH {_TEXTS}, {_normalized("texts")}, {SENTENCES.replace("doc_id AS utt", "utt").replace("(text,", "(t,").replace("FROM documents", "FROM spoken")}
  SELECT utt, CAST(pos AS INTEGER) AS pos, sentence, context, coalesce(context, '') || sentence AS in_text, round({_DURATION}, 6) AS duration_s FROM sent""")
def _(spark, d):
    return rounded(jobs.text_plan(documents(spark, d).select("utt", "text")))


@query("finish_run", f"""WITH {DYNAMIC}, c AS (SELECT utt, tag FROM chosen WHERE chosen), {LISTING.strip()},
  t AS (SELECT doc_id AS utt, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), f AS (SELECT t.utt, 'collage:' || t.utt AS p FROM t LEFT JOIN official o USING (utt) WHERE o.size IS NULL OR o.size <= 2048)
  SELECT t.utt, t.source AS reference_speech, coalesce(c.tag, f.p) AS wav_path, CASE WHEN c.tag IS NOT NULL THEN 'chosen' WHEN f.p IS NOT NULL THEN 'fill' END AS origin FROM t LEFT JOIN c USING (utt) LEFT JOIN f USING (utt)""")
def _(spark, d):
    tasks = documents(spark, d).select("utt", F.col("source").alias("reference_speech"))
    cands = candidates(spark, d).withColumn("wav_path", F.col("tag"))
    return jobs.finish_run(tasks, labels(spark, d), cands, completeness.official_outputs(listing(spark, d)))


def clips(spark, d, overlap: int = 0):
    """A user's values in order, as samples: clips of at most CLIP, `part` by `part`, so no row grows with a user.
    With an overlap, a part also holds so many samples of the next."""
    part, place = F.floor(F.col("frame_idx") / CLIP), F.col("frame_idx") % CLIP
    both = F.when((place < overlap) & (part > 0), F.array(part - 1, part)).otherwise(F.array(part))
    rows = frame_rows(spark, d).withColumn("part", F.explode(both) if overlap else part).groupBy("clip_id", "part")
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("frame_idx", "energy")))["energy"].alias("v"))
    return rows.select("clip_id", "part", F.lit(100).alias("sr"), F.transform("v", lambda x: (F.sin(x) * 0.9).cast("float")).alias("samples"))


def summary(df: DataFrame, *names: str) -> DataFrame:
    kept = [c for c in df.columns if c not in names]
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4)
    return df.select(*kept, *[x for c in names for x in (F.size(c).alias(f"{c}_n"), total(c).alias(f"{c}_energy"))])


WAVE = f"""{FRM}, wav AS (SELECT clip_id, frame_idx // {CLIP} AS part, frame_idx % {CLIP} AS i, CAST(CAST(sin(energy) * 0.9e0 AS FLOAT) AS DOUBLE) AS y, frame_idx FROM frm)"""


def _square(x: str) -> str:
    """SQL of the energy of samples, stored in single precision."""
    return f"round(sum(CAST(CAST({x} AS FLOAT) AS DOUBLE) ** 2), 4)"


@query("wave_gains", f"""WITH {WAVE}, m AS (SELECT *, avg(y * y) OVER w AS power, max(abs(y)) OVER w + 1e-9 AS peak, count(*) OVER w AS n, lead(y) OVER (w ORDER BY i) AS after FROM wav WINDOW w AS (PARTITION BY clip_id, part))
  SELECT clip_id, part, CAST(max(n) AS INTEGER) AS gain_n, {_square(f"greatest(-1, least(1, y * {10 ** -1.15!r} / sqrt(power + 1e-9)))")} AS gain_energy, CAST(max(n) AS INTEGER) AS norm_n, {_square(f"y * {10 ** -1.15!r} / (sqrt(power) + 1e-12)")} AS norm_energy,
    CAST(max(n) AS INTEGER) AS limit_n, {_square(f"CASE WHEN peak > {10 ** -0.15!r} THEN y * {10 ** -0.15!r} / peak ELSE y END")} AS limit_energy,
    CAST(max(n) // 2 AS INTEGER) AS mono_n, coalesce(round(sum(CAST(CAST((y + after) / 2 AS FLOAT) AS DOUBLE) ** 2) FILTER (i % 2 = 0 AND after IS NOT NULL), 4), 0) AS mono_energy FROM m GROUP BY clip_id, part""")
def _(spark, d):
    y = F.col("samples")
    out = clips(spark, d).select("clip_id", "part", waves.rms_gain(y).alias("gain"), waves.rms_normalize(y).alias("norm"), waves.peak_limit(y).alias("limit"), waves.to_mono(y, F.lit(2)).alias("mono"))
    return summary(out, "gain", "norm", "limit", "mono")


@query("wave_levels")
def _(spark, d):
    y = F.col("samples")
    out = clips(spark, d).select("clip_id", "part", waves.rms_gain(y).alias("gain"), waves.rms_normalize(y).alias("norm"), waves.peak_limit(y).alias("limit"), waves.dither(y, F.col("clip_id")).alias("dither"), waves.to_mono(y, F.lit(2)).alias("mono"))
    return summary(out, "gain", "norm", "limit", "dither", "mono")


@query("wave_cuts", f"""WITH {FRM}, n AS (SELECT clip_id, count(*) AS n FROM frm GROUP BY clip_id)
  SELECT clip_id, CAST(CASE WHEN n > 50 THEN 50 ELSE n END AS INTEGER) AS trimmed, CAST(CASE WHEN n > 65 THEN n - 65 ELSE n END AS INTEGER) AS headless, n / 100 AS seconds, CASE WHEN n > 65 THEN 65 ELSE 0 END AS cut FROM n""")
def _(spark, d):
    y, sr = F.col("samples"), F.col("sr")
    first = F.col("part") == 0  # what goes at the head goes from the first part, which is the longest
    trimmed = F.when(first, F.size(waves.trim_seconds(y, sr, 0.5)))
    headless = F.when(first, F.size(waves.trim_head_by_chars(y, sr, F.lit(5)))).otherwise(F.size(y))
    c = clips(spark, d).select("clip_id", "sr", trimmed.alias("trimmed"), headless.alias("headless"), F.size(y).alias("n"))
    c = c.groupBy("clip_id", "sr").agg(F.max("trimmed").alias("trimmed"), F.sum("headless").alias("headless"), F.sum("n").alias("n"))
    cut = waves.lookback_cut(F.lit(None).cast("long"), sr, F.lit(5), F.col("n"))
    return c.select("clip_id", F.col("trimmed").cast("int").alias("trimmed"), F.col("headless").cast("int").alias("headless"), (F.col("n") / sr).alias("seconds"), cut.cast("int").alias("cut"))


@query("wave_cut_values", f"""WITH {WAVE}, m AS (SELECT *, count(*) OVER (PARTITION BY clip_id, part) AS n, clip_id % 90 - 10 AS aligned FROM wav)
  SELECT clip_id, part, CAST(least(max(n), 50) AS INTEGER) AS trimmed_n, round(sum(y * y) FILTER (i < 50), 4) AS trimmed_energy, CAST(CASE WHEN max(n) > 65 THEN max(n) - 65 ELSE max(n) END AS INTEGER) AS headless_n,
    round(sum(y * y) FILTER (n <= 65 OR i >= 65), 4) AS headless_energy, CAST(CASE WHEN max(aligned) > 0 AND max(aligned) < max(n) THEN max(aligned) WHEN max(n) > 65 THEN 65 ELSE 0 END AS BIGINT) AS cut FROM m GROUP BY clip_id, part""")
def _(spark, d):
    y, sr = F.col("samples"), F.col("sr")
    cut = waves.lookback_cut(F.col("clip_id") % 90 - 10, sr, F.lit(5), F.size(y).cast("long"))
    out = clips(spark, d).select("clip_id", "part", waves.trim_seconds(y, sr, 0.5).alias("trimmed"), waves.trim_head_by_chars(y, sr, F.lit(5)).alias("headless"), cut.alias("cut"))
    return summary(out, "trimmed", "headless")


def _faded(n: str, y: str = "y", i: str = "i", m: str = "n") -> str:
    """SQL of a sample under ramps of n samples at both ends."""
    return f"({y}) * CASE WHEN ({n}) <= 0 THEN 1 WHEN {i} < ({n}) THEN {i} / greatest(({n}) - 1, 1) ELSE 1 END * CASE WHEN ({n}) <= 0 THEN 1 WHEN {i} >= {m} - ({n}) THEN ({m} - 1 - {i}) / greatest(({n}) - 1, 1) ELSE 1 END"


@query("wave_fades", f"""WITH {WAVE}, m AS (SELECT *, count(*) OVER (PARTITION BY clip_id, part) AS n FROM wav), tones AS (SELECT k, t AS i, k * 200 AS n, CAST(CAST(0.1e0 * sin(2 * pi() * 440 * t / 400) AS FLOAT) AS DOUBLE) AS y FROM range(0, 3) a(k), range(0, 400) b(t) WHERE t < k * 200),
  tone AS (SELECT k, CAST(count(*) AS INTEGER) AS tone_n, {_square(_faded("20"))} AS tone_energy FROM tones GROUP BY k)
  SELECT clip_id, part, CAST(max(n) AS INTEGER) AS skip_n, {_square(_faded("CASE WHEN n < 20 THEN 0 ELSE 10 END"))} AS skip_energy, CAST(max(n) AS INTEGER) AS half_n, {_square(_faded("least(10, n // 2)"))} AS half_energy,
    CAST(max(n) AS INTEGER) AS third_n, {_square(_faded("least(10, n // 3)"))} AS third_energy, coalesce(max(tone_n), 0) AS tone_n, coalesce(max(tone_energy), 0) AS tone_energy
  FROM m LEFT JOIN tone ON k = clip_id % 3 GROUP BY clip_id, part""")
def _(spark, d):
    y, sr = F.col("samples"), F.col("sr")
    out = clips(spark, d).select("clip_id", "part", *[waves.fade(y, sr, 100, m).alias(m) for m in ("skip", "half", "third")], waves.tone(F.col("clip_id") % 3 / 2, 400).alias("tone"))
    return summary(out, "skip", "half", "third", "tone")


_T = "({at}) / greatest({n} - 1, 1)"
_OVERLAP = "CASE WHEN l.mode = 'power' THEN least(10, l.stop, p.len) WHEN l.stop > 10 AND p.len > 10 THEN 10 ELSE 0 END"
_RISE, _FALL = _T.format(at="w.i", n="l.n"), _T.format(at="o.p - q.start", n="q.n")


@query("wave_joins", f"""WITH RECURSIVE {WAVE}, sized AS (SELECT concat_ws('-', clip_id // 10, part) AS utt, clip_id, part, count(*) AS len FROM wav GROUP BY ALL), pcs AS (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY clip_id) AS k FROM sized),
  laid AS (SELECT mode, utt, k, clip_id, part, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS start, CAST(len AS BIGINT) AS stop FROM pcs, (VALUES ('linear'), ('power')) m(mode) WHERE k = 1
    UNION ALL SELECT l.mode, p.utt, p.k, p.clip_id, p.part, {_OVERLAP}, l.stop - {_OVERLAP}, l.stop - {_OVERLAP} + p.len FROM laid l JOIN pcs p ON p.utt = l.utt AND p.k = l.k + 1),
  own AS (SELECT l.mode, l.utt, l.k, l.start + w.i AS p, w.y * CASE WHEN w.i >= l.n THEN 1 WHEN l.mode = 'power' THEN sin({_RISE} * pi() / 2) ELSE {_RISE} END AS y FROM laid l JOIN wav w ON w.clip_id = l.clip_id AND w.part = l.part),
  put AS (SELECT o.mode, o.utt, o.p, o.k, max(o.y) * product(CASE WHEN q.k IS NULL THEN 1 WHEN q.mode = 'power' THEN cos({_FALL} * pi() / 2) ELSE 1 - {_FALL} END) AS y
    FROM own o LEFT JOIN laid q ON q.mode = o.mode AND q.utt = o.utt AND q.k > o.k AND o.p >= q.start AND o.p < q.start + q.n GROUP BY o.mode, o.utt, o.p, o.k),
  out AS (SELECT mode, utt, p, greatest(-1, least(1, sum(y))) AS y FROM put GROUP BY ALL), e AS (SELECT mode, utt, CAST(count(*) AS INTEGER) AS n, {_square("y")} AS energy FROM out GROUP BY ALL)
  SELECT a.utt, a.n AS linear_n, a.energy AS linear_energy, b.n AS power_n, b.energy AS power_energy FROM e a JOIN e b ON a.utt = b.utt WHERE a.mode = 'linear' AND b.mode = 'power'""")
def _(spark, d):
    group = F.concat_ws("-", F.floor(F.col("clip_id") / 10), "part")
    rows = clips(spark, d).select(group.alias("utt"), F.col("clip_id").alias("pos"), "samples")
    linear = summary(waves.join_linear(rows, 100, 100).withColumnRenamed("samples", "linear"), "linear")
    return linear.join(summary(waves.join_equal_power(rows, 100, 100).withColumnRenamed("samples", "power"), "power"), "utt")


_JOINED = 500  # samples in a row of a joined clip
_BEFORE = "OVER (PARTITION BY utt ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("joined_blocks", f"""WITH {WAVE}, pcs AS (SELECT clip_id % 3 AS utt, clip_id, count(*) AS len FROM wav GROUP BY ALL),
  laps AS (SELECT 'power' AS mode, *, least(10, coalesce(max(len) {_BEFORE}, 0), len) AS n FROM pcs UNION ALL SELECT 'linear', *, CASE WHEN sum(len) {_BEFORE} > 10 AND len > 10 THEN 10 ELSE 0 END FROM pcs),
  laid AS (SELECT *, coalesce(sum(len - n) OVER (PARTITION BY mode, utt ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - n AS start FROM laps),
  w AS (SELECT clip_id, frame_idx AS i, y FROM wav),
  own AS (SELECT l.mode, l.utt, l.clip_id AS k, l.start + w.i AS p, w.y * CASE WHEN w.i >= l.n THEN 1 WHEN l.mode = 'power' THEN sin({_RISE} * pi() / 2) ELSE {_RISE} END AS y FROM laid l JOIN w USING (clip_id)),
  put AS (SELECT o.mode, o.utt, o.p, o.k, max(o.y) * product(CASE WHEN q.clip_id IS NULL THEN 1 WHEN q.mode = 'power' THEN cos({_FALL} * pi() / 2) ELSE 1 - {_FALL} END) AS y
    FROM own o LEFT JOIN laid q ON q.mode = o.mode AND q.utt = o.utt AND q.clip_id > o.k AND o.p >= q.start AND o.p < q.start + q.n GROUP BY o.mode, o.utt, o.p, o.k),
  out AS (SELECT mode, utt, p, greatest(-1, least(1, sum(y))) AS y FROM put GROUP BY ALL)
  SELECT mode, utt, CAST(p // {_JOINED} AS BIGINT) AS block, CAST(count(*) AS INTEGER) AS samples_n, {_square("y")} AS samples_energy FROM out GROUP BY ALL""")
def _(spark, d):
    # All users of a third make one clip; a user's samples come part by part.
    rows = clips(spark, d).select((F.col("clip_id") % 3).alias("utt"), F.col("clip_id").alias("pos"), (F.col("part") * CLIP).alias("at"), "samples")
    made = [summary(waves.joined_blocks(rows, 100, 100, mode == "power", _JOINED), "samples").withColumn("mode", F.lit(mode)) for mode in ("power", "linear")]
    return made[0].unionByName(made[1])


@query("wave_alignment", f"""WITH {WAVE}, m AS (SELECT *, count(*) OVER (PARTITION BY clip_id, part) AS n FROM wav), b AS (SELECT clip_id, part, i - 10 AS j, y AS own FROM m WHERE i BETWEEN 10 AND 19),
  dots AS (SELECT m.clip_id, m.part, m.i - b.j AS pos, sum(m.y * own) AS dot, sqrt(sum(m.y * m.y)) * sqrt(sum(own * own)) AS size FROM m JOIN b ON m.clip_id = b.clip_id AND m.part = b.part AND m.i >= b.j AND m.i - b.j <= n - 10 WHERE n >= 20 GROUP BY ALL),
  best AS (SELECT clip_id, part, arg_max({{'pos': pos, 'sim': dot / (size + 1e-8)}}, {{'dot': dot, 'early': -pos}}) AS x FROM dots GROUP BY clip_id, part)
  SELECT clip_id, part, CAST(n AS INTEGER) AS n, CAST(CASE WHEN n >= 20 AND x.sim >= 0.35 THEN greatest(0, least(x.pos + 18, n - 1)) END AS BIGINT) AS cut FROM (SELECT clip_id, part, count(*) AS n FROM wav GROUP BY ALL) LEFT JOIN best USING (clip_id, part)""")
def _(spark, d):
    c = clips(spark, d).withColumn("n", F.size("samples"))
    before, head = F.slice("samples", 11, 10), F.col("samples")
    cut = waves.align_cut(before, head, F.lit(1), F.lit(20), F.col("sr"), F.col("n"))
    return c.select("clip_id", "part", "n", cut.alias("cut"))


@query("frames_rms", f"""WITH {WAVE}, m AS (SELECT *, count(*) OVER w AS n, lead(y) OVER (w ORDER BY frame_idx) AS after FROM wav WINDOW w AS (PARTITION BY clip_id))
  SELECT clip_id, frame_idx, round(sqrt(CASE WHEN after IS NULL THEN y * y ELSE (y * y + after * after) / 2 END + 1e-9), 6) AS rms FROM m WHERE frame_idx < greatest(1, n - 2)""")
def _(spark, d):
    reach = 2  # samples in a frame; a last part of no more holds no frame of its own
    c = clips(spark, d, reach).where((F.col("part") == 0) | (F.size("samples") > reach))
    found = fr.frames(c.withColumn("clip_id", F.concat_ws(":", "part", "clip_id")))
    part, clip = (F.get(F.split("clip_id", ":", 2), k).cast("long") for k in (0, 1))
    return rounded(found.select(clip.alias("clip_id"), (part * CLIP + F.col("frame_idx")).cast("int").alias("frame_idx"), "rms"))


# ---- one clip with a third of all frames -----------------------------------

_HOT_USER = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END"
#: Groups of more rows than this are narrowed by counts.
HELD = 2000


def hot(sql: str) -> str:
    return sql.replace("user_id", _HOT_USER)


def hot_frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.expr(_HOT_USER).alias("clip_id"), "ts", "event_id", F.col("value").alias("energy"), "event_type")
    return ranged.numbered(e, ["clip_id"], ["ts", "event_id"], "frame_idx").withColumn("frame_idx", F.col("frame_idx").cast("int"))


def hot_merged(frames: DataFrame) -> DataFrame:
    runs = ranged.speech_runs(ranged.voiced_by_median(frames, "energy", HELD), HOP)
    sizes = frames.groupBy("clip_id").agg(((F.max("frame_idx") + 1) * HOP).cast("long").alias("length"))
    return ranged.pad_and_merge(runs.join(sizes, "clip_id"), PAD // 4, "length")


def hot_bins(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    freq = F.when(kind == "view", 50.0).when(kind == "click", 60.0).otherwise(F.col("frame_idx") % 7 * 10.0)
    return hot_frames(spark, d).select("clip_id", "frame_idx", freq.alias("freq_hz"), (F.col("energy") / 100).alias("mag"))


@query("hot_voiced", f"WITH {hot(FRM)} SELECT clip_id, frame_idx, is_speech FROM med")
def _(spark, d):
    return ranged.voiced_by_median(hot_frames(spark, d), "energy", HELD).select("clip_id", "frame_idx", "is_speech")


@query("hot_runs", f"WITH {hot(RUNS)} SELECT * FROM runs")
def _(spark, d):
    return ranged.speech_runs(ranged.voiced_by_median(hot_frames(spark, d), "energy", HELD), HOP)


@query("hot_merged", f"WITH {hot(MERGED)} SELECT * FROM merged")
def _(spark, d):
    return hot_merged(hot_frames(spark, d))


@query("hot_energy", f"""WITH {hot(SEGS)} SELECT clip_id, start, "end", round(energy, 9) AS energy FROM segs""")
def _(spark, d):
    frames = hot_frames(spark, d)
    return rounded(ranged.segment_energy(frames, hot_merged(frames), HOP), 9)


@query("hot_snr", f"WITH {hot(SNR)} SELECT clip_id, round(snr_db, 6) AS snr_db FROM snr")
def _(spark, d):
    frames = hot_frames(spark, d)
    return rounded(ranged.snr_from_speech(frames, hot_merged(frames), HOP, SR, HELD))


@query("hot_spectrum", f"""WITH {hot(BINS)}, q AS (SELECT clip_id, freq_hz, quantile_cont(mag, 0.1) AS a, quantile_cont(mag, 0.9) AS b FROM bins GROUP BY ALL)
  SELECT clip_id, round(20 * log10(avg(b + 1e-9) / avg(a + 1e-9) + 1e-9), 6) AS snr_db FROM q GROUP BY clip_id""")
def _(spark, d):
    return rounded(ranged.snr_from_percentiles(hot_bins(spark, d), held=HELD // 4))


@query("hot_floor", f"""WITH {hot(BINS)}, q AS (SELECT *, quantile_cont(mag + 1e-8, 0.1) OVER (PARTITION BY clip_id, freq_hz) AS f FROM bins)
  SELECT clip_id, frame_idx, freq_hz, round(greatest(mag + 1e-8 - 0.9e0 * f, 0e0), 6) AS floored FROM q""")
def _(spark, d):
    return rounded(ranged.spectral_floor(hot_bins(spark, d), held=HELD // 4).select("clip_id", "frame_idx", "freq_hz", "floored"))


# ---- files: written to the shared folder, read back, removed -----------------


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{rn.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_and_removed(df: DataFrame, folder: str) -> DataFrame:
    out = ranged.checkpointed(df)
    rn.Store(df.sparkSession, folder).delete()
    return out


@query("score_log_runs", f"""WITH {DYNAMIC} SELECT 'main' AS run_id, CAST(utt AS VARCHAR) AS utt, tag, printf('%.6f', wer) AS wer, printf('%.6f', sim) AS sim, coalesce(printf('%.6f', cm), '') AS cm,
  CASE WHEN chosen THEN '1' ELSE '0' END AS chosen FROM chosen""")
def _(spark, d):
    """The log written twice under one run id, beside an attempt that never came to its commit: read once."""
    folder, columns = fresh_folder(spark, "score-log"), ("utt", "tag", "wer", "sim", "cm", "chosen")
    log = src.format_score_log(selection.score_log(candidates(spark, d)).select(*columns))
    form = {"fmt": "csv", "header": "true", "emptyValue": ""}
    rn.stage(log.where("chosen = '1'"), folder, "main", **form)
    for _ in range(2):
        rn.write_run(log, folder, "main", **form)
    found = rn.read_runs(spark, folder, ", ".join(f"{c} string" for c in columns), fmt="csv", header="true")
    return read_and_removed(found.select("run_id", *[F.coalesce(c, F.lit("")).alias(c) for c in columns]), folder)


@query("manifest_files", "SELECT doc_id AS utt, source AS reference_speech, nullif(text, '') AS text, doc_id || '.wav' AS synthesized_speech FROM documents")
def _(spark, d):
    """Every document as a task, its manifest written and read again; the format has no empty text beside null."""
    folder = fresh_folder(spark, "manifest")
    tasks = documents(spark, d).select("utt", F.col("source").alias("reference_speech"), "text")
    out = src.write_manifest(src.result_manifest(tasks), folder)
    read = src.result_manifest(src.read_tasks(spark, out, f"{src.TASK_SCHEMA}, synthesized_speech STRING").drop("synthesized_speech"))
    return read_and_removed(read.withColumn("text", F.when(F.col("text") != "", F.col("text"))), out)


def written_waves(spark: SparkSession, d: str) -> str:
    """A user's values in order as a file of samples."""
    folder = fresh_folder(spark, "waves")
    wav.write_waves(frame_rows(spark, d).select("clip_id", F.col("frame_idx").alias("at"), (F.sin("energy") * 0.9).alias("value")), folder, SR)
    return folder


PCM = f"{FRM}, pcm AS (SELECT clip_id, frame_idx AS place, round(sin(energy) * 0.9e0 * 32768) / 32768 AS y FROM frm)"


@query("output_files", "SELECT user_id || '.wav' AS name, 44 + 2 * count(*) AS size FROM events GROUP BY user_id")
def _(spark, d):
    folder = written_waves(spark, d)
    return read_and_removed(src.list_outputs(spark, folder).select("name", "size"), folder)


@query("clip_samples", f"""WITH {PCM} SELECT clip_id, CAST(place AS BIGINT) AS "at", round(y, 6) AS value FROM pcm""")
def _(spark, d):
    """Samples of the files, which are cut every 64 kB into partitions and blocks of 4,096."""
    folder = written_waves(spark, d)
    found = wav.samples_of(wav.load_blocks(spark, folder, 1 << 16, 1 << 12))
    return read_and_removed(rounded(found.withColumn("clip_id", F.col("clip_id").cast("long"))), folder)


@query("clip_frames", f"""WITH {PCM}, n AS (SELECT clip_id, count(*) AS n FROM pcm GROUP BY clip_id), f AS (SELECT clip_id, n, unnest(range(0, greatest(1, n - 32), 16)) AS since FROM n)
  SELECT f.clip_id, CAST(since // 16 AS BIGINT) AS frame_idx, round(sqrt(avg(y * y) + 1e-9), 6) AS rms FROM f JOIN pcm p ON p.clip_id = f.clip_id AND p.place >= since AND p.place < since + 32 GROUP BY ALL""")
def _(spark, d):
    """Frames of 32 samples every 16, from blocks of 40 that know the 32 after them."""
    folder = written_waves(spark, d)
    found = wav.block_frames(wav.load_blocks(spark, folder, 1 << 16, 40, 32), 32, 16)
    return read_and_removed(rounded(found.withColumn("clip_id", F.col("clip_id").cast("long"))), folder)
