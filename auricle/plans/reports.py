"""Queries over reports and the library: a part is a report, a customer a client, an order a check, its lines findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from auricle.functions import shared
from auricle.functions.measures import decibels
from auricle.operators import document, export, library, rules

c = F.col


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark, sf_dir):
    """A report for each part; its fields follow from key, size and price, with unknowns among them."""
    p = table(spark, sf_dir, "part")
    k, s = c("k"), c("s")
    rate = F.get(F.array(*map(F.lit, [44100, 48000, 47952, 96000, 12345])), (k % 5).cast("int")).cast("long")
    peak = F.when(k % 13 > 0, (k % 240) / 200.0)
    out = p.select(c("p_partkey").alias("k"), c("p_size").cast("long").alias("s"), "p_retailprice")
    return out.select(
        k.alias("report_id"),
        F.when(k % 17 > 0, rate).alias("sample_rate"),
        F.when(k % 19 > 0, "pcm").alias("codec"),
        F.when(k % 3 == 0, "pcm-float").when(k % 3 == 1, "pcm-int").otherwise("compressed").alias("codec_family"),
        F.get(F.array(*map(F.lit, [8, 16, 24, 12])), (s % 4).cast("int")).cast("long").alias("bit_depth"),
        (F.get(F.array(*map(F.lit, [8, 16, 24, 12])), (s % 4).cast("int")) - (k % 11 == 0).cast("int")).cast("long").alias("valid_bits"),
        (1 + s % 7).alias("channels"),
        F.when(k % 2 == 0, F.bit_count(s)).cast("long").alias("mask_channels"),
        (s > 40).alias("undefined_bits"),
        (k * 100).alias("byte_rate"),
        (s % 7).alias("block_align"),
        F.when(k % 23 > 0, (k % 50) / 10.0).alias("seconds"),
        (k % 4 > 0).alias("exact"),
        (k % 29 == 0).alias("truncated"),
        F.when(k % 6 > 0, k % 31 - 29).alias("shortfall"),
        F.when(k % 6 > 0, k % 7 > 0).alias("size_matches"),
        F.when(k % 5 > 0, k * 10).alias("declared_size"),
        (k * 10 - k % 3).alias("actual_size"),
        (k % 37 == 0).cast("long").alias("errors"),
        F.array_repeat(F.lit("odd chunk"), (k % 41 == 0).cast("int") * 2).alias("warnings"),
        (k % 9 > 0).alias("measured"),
        (k % 8 > 0).alias("complete"),
        F.when(k % 43 == 0, 5).otherwise(0).cast("long").alias("non_finite"),
        peak.alias("peak"),
        decibels(peak).alias("peak_dbfs"),
        F.when(k % 13 > 0, k % 240 == 0).alias("digital_silence"),
        F.array(k % 240 == 0, F.when(k % 10 > 0, k % 15 == 0)).alias("channel_silence"),
        F.when(k % 13 > 0, k % 5).alias("longest_run"),
        F.when(k % 13 > 0, decibels(peak) + 0.3).alias("true_peak"),
        F.array((k % 100) / 50000.0, F.lit(None).cast("double")).alias("dc_offsets"),
        F.when(k % 3 == 2, "decoded").otherwise("container").alias("source"),
        (k % 3 < 2).alias("lossless"),
        ((k % 50) / 10.0 + F.when(k % 7 == 0, 0.01).otherwise(0.0)).alias("decoded_seconds"),
        (k % 47 == 0).alias("manifest"),
        F.when(k % 53 == 0, "declared").when(k % 59 == 0, "possible").otherwise("none").alias("origin_flag"),
        F.when(k % 61 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("tools"),
    )


R_SQL = """r AS (SELECT k AS report_id, CASE WHEN k % 17 > 0 THEN ([44100, 48000, 47952, 96000, 12345])[k % 5 + 1]::BIGINT END AS sample_rate, CASE WHEN k % 19 > 0 THEN 'pcm' END AS codec,
  CASE k % 3 WHEN 0 THEN 'pcm-float' WHEN 1 THEN 'pcm-int' ELSE 'compressed' END AS codec_family, ([8, 16, 24, 12])[s % 4 + 1]::BIGINT AS bit_depth, ([8, 16, 24, 12])[s % 4 + 1]::BIGINT - (k % 11 = 0)::BIGINT AS valid_bits,
  1 + s % 7 AS channels, CASE WHEN k % 2 = 0 THEN bit_count(s)::BIGINT END AS mask_channels, s > 40 AS undefined_bits, k * 100 AS byte_rate, s % 7 AS block_align, CASE WHEN k % 23 > 0 THEN (k % 50) / 10.0::DOUBLE END AS seconds,
  k % 4 > 0 AS exact, k % 29 = 0 AS truncated, CASE WHEN k % 6 > 0 THEN k % 31 - 29 END AS shortfall, CASE WHEN k % 6 > 0 THEN k % 7 > 0 END AS size_matches, CASE WHEN k % 5 > 0 THEN k * 10 END AS declared_size, k * 10 - k % 3 AS actual_size,
  (k % 37 = 0)::BIGINT AS errors, CASE WHEN k % 41 = 0 THEN 2 ELSE 0 END AS warnings, k % 9 > 0 AS measured, k % 8 > 0 AS complete, CASE WHEN k % 43 = 0 THEN 5 ELSE 0 END AS non_finite,
  CASE WHEN k % 13 > 0 THEN (k % 240) / 200.0::DOUBLE END AS peak, k % 240 = 0 AS silent, k % 10 > 0 AND k % 15 = 0 AS silent2, CASE WHEN k % 13 > 0 THEN k % 5 END AS longest_run, (k % 100) / 50000.0::DOUBLE AS dc,
  k % 3 = 2 AS decoded, (k % 50) / 10.0::DOUBLE + CASE WHEN k % 7 = 0 THEN 0.01::DOUBLE ELSE 0 END AS decoded_seconds, k % 47 = 0 AS manifest, CASE WHEN k % 53 = 0 THEN 'declared' WHEN k % 59 = 0 THEN 'possible' ELSE 'none' END AS origin_flag, k % 61 = 0 AS tools
  FROM (SELECT p_partkey AS k, p_size::BIGINT AS s FROM part)),
q AS (SELECT *, CASE WHEN peak > 0 THEN 20 * log10(peak) WHEN peak = 0 THEN '-inf'::DOUBLE END AS db, peak IS NOT NULL AND silent AS digital_silence,
  CASE WHEN sample_rate IS NULL OR channels IS NULL OR codec IS NULL THEN 'failed' WHEN coalesce(errors > 0 OR seconds IS NULL OR truncated OR shortfall > 0, false) THEN 'partial' ELSE 'ok' END AS status FROM r)"""

#: (rule, severity, predicate, observations per row, name)
_KNOWN = "coalesce({0} <> 0, false)"
_HEARD = "measured AND db IS NOT NULL AND NOT digital_silence"
_RULES_SQL = [
    ("parse-failed", "attention", "status = 'failed'"), ("parse-partial", "attention", "status = 'partial'"), ("parse-warnings", "notice", "warnings > 0"),
    ("data-truncated", "attention", "shortfall > 0"), ("container-size-mismatch", "notice", "NOT size_matches AND declared_size IS NOT NULL"),
    ("sample-rate-nonstandard", "notice", f"sample_rate <> 0 AND sample_rate NOT IN {tuple(rules.STANDARD_RATES)}"), ("bit-depth-nonstandard", "notice", f"bit_depth <> 0 AND bit_depth NOT IN {tuple(rules.STANDARD_DEPTHS)}"),
    ("valid-bits-differ", "info", "valid_bits <> 0 AND bit_depth <> 0 AND valid_bits <> bit_depth"), ("channel-count-unusual", "notice", "channels > 2 AND channels NOT IN (4, 6, 8)"), ("channel-mask-disagrees", "notice", "mask_channels <> 0 AND channels <> 0 AND mask_channels <> channels"),
    ("channel-mask-undefined-bits", "info", "undefined_bits"), ("byte-rate-inconsistent", "notice", "codec_family IN ('pcm-int', 'pcm-float') AND byte_rate <> 0 AND sample_rate <> 0 AND block_align <> 0 AND byte_rate <> sample_rate * block_align"), ("duration-very-short", "notice", "seconds < 1"),
    ("duration-inexact", "info", "NOT exact AND seconds IS NOT NULL"), ("samples-not-finite", "attention", "measured AND non_finite > 0"), ("digital-silence", "attention", "measured AND db IS NOT NULL AND digital_silence"),
    ("channel-silence", "attention", f"{_HEARD} AND (silent OR silent2)"), ("full-scale-run", "attention", f"{_HEARD} AND longest_run >= 3 AND NOT (decoded AND peak > 1)"),
    ("true-peak-over", "attention", "db > '-inf'::DOUBLE AND db + 0.3 > 0"), ("peak-at-ceiling", "notice", f"{_HEARD} AND longest_run < 3 AND db >= -0.1"), ("float-above-full-scale", "notice", "measured AND db IS NOT NULL AND codec_family = 'pcm-float' AND peak > 1"),
    ("level-very-low", "info", f"{_HEARD} AND db < -40"), ("dc-offset", "notice", f"{_HEARD} AND dc > 0.001"), ("decoded-above-full-scale", "attention", "measured AND db IS NOT NULL AND decoded AND peak > 1"), ("decoded-measurement-note", "info", "measured AND decoded"),
    ("partial-scan", "info", "measured AND NOT complete"), ("provenance-manifest", "info", "manifest"), ("possible-ai-generated", "CASE", "origin_flag <> 'none'"), ("ai-assisted-processing", "info", "tools"), ("not-measured", "info", "NOT measured"),
]
_DB_TEXT = "CASE WHEN {0} IS NULL THEN '—' WHEN {0} = '-inf'::DOUBLE THEN '-∞' WHEN {0} > 0 THEN printf('+%.2f', {0}) ELSE printf('%.2f', {0}) END"
_NEAREST = "arg_min(x, (abs(sample_rate - x), list_position(" + str(rules.STANDARD_RATES) + ", x)))"
#: What the templates of titles and details name besides columns.
_FIGURES_SQL = {
    "nearest": f"(SELECT {_NEAREST} FROM (SELECT unnest({rules.STANDARD_RATES}) AS x))", "expected_rate": "sample_rate * block_align", "size_gap": "abs(declared_size - actual_size)",
    "peak_text": _DB_TEXT.format("db"), "true_peak_text": _DB_TEXT.format("(db + 0.3)"), "seconds_text": "printf('%.3f', seconds)", "silent_channels": "silent::INT + silent2::INT", "all_channels": "2",
    "offsets": "'channel 1: ' || printf('%.3f', dc * 100) || ' %'", "drift_text": f"CASE WHEN abs(seconds - decoded_seconds) > {rules.DRIFT} THEN ' The decoded audio differs from the stated length by ' || printf('%.3f', abs(seconds - decoded_seconds)) || ' seconds.' ELSE '' END",
}


def _filled_sql(template: str, each: str) -> str:
    parts = []
    for i, part in enumerate(template.replace("}", "{").split("{")):
        value = each if part == "each" else _FIGURES_SQL.get(part, part)
        parts.append(f"coalesce(({value})::VARCHAR, '—')" if i % 2 else "'" + part.replace("'", "''") + "'")
    return " || ".join(parts)


def _o_sql() -> str:
    parts, texts_of = [], {r.id: (r.title, r.detail) for r in rules.RULES}
    for i, (name, severity, when) in enumerate(_RULES_SQL):
        sev = "CASE WHEN origin_flag = 'declared' THEN 'attention' ELSE 'notice' END" if severity == "CASE" else f"'{severity}'"
        obs = {"duration-very-short": "CASE WHEN seconds = 0 THEN 'duration-zero' ELSE 'duration-very-short' END", "decoded-measurement-note": f"CASE WHEN abs(seconds - decoded_seconds) > {rules.DRIFT} THEN 'decoded-length-differs' ELSE 'decoded-measurement-note' END"}.get(name, f"'{name}'")
        many = "(SELECT *, unnest(range(2)) AS nth FROM q)" if name in ("parse-warnings", "ai-assisted-processing") else "(SELECT *, 0::BIGINT AS nth FROM q)"
        each = {"parse-warnings": "'odd chunk'", "ai-assisted-processing": "chr(97 + nth::INT)"}.get(name, "NULL")
        title, detail = (_filled_sql(t, each) for t in texts_of[name])
        parts.append(f"SELECT report_id, {i} AS rule_ord, nth, '{name}' AS rule_id, {obs} AS obs_id, {sev} AS severity, {title} AS title, {detail} AS detail FROM {many} WHERE {when}")
    return "o AS (" + " UNION ALL ".join(parts) + ")"


RANK_SQL = "CASE severity WHEN 'attention' THEN 0 WHEN 'notice' THEN 1 ELSE 2 END"


def _observed(spark, sf_dir):
    return rules.observe(rules.status(reports(spark, sf_dir)))


def rules_observations(spark, sf_dir):
    """All 30 rules: every observation with its place in the report."""
    o = _observed(spark, sf_dir).select("report_id", F.posexplode("observations").alias("place", "o"))
    return o.select("report_id", c("place").cast("long").alias("place"), "o.rule_id", "o.obs_id", "o.severity", "o.title", "o.detail")


def severity_pivot(spark, sf_dir):
    return rules.severities(_observed(spark, sf_dir)).select("report_id", "attention", "notice", "info", "top", "findings_rank")


def report_text(spark, sf_dir):
    return export.report_text(_observed(spark, sf_dir))


def report_cells(spark, sf_dir):
    """The table of reports, all columns."""
    return export.report_table(_observed(spark, sf_dir))


def batch_list(spark, sf_dir):
    """What a batch's list shows of each report, and what its columns are sorted by."""
    out = export.batch_columns(_observed(spark, sf_dir))
    finite = lambda name: F.when(F.abs(c(name)) < float("inf"), F.round(name, 6)).alias(name)
    return out.select(*(finite(name) if name in ("peak_sort", "true_peak_sort") else c(name) for name in out.columns))


def batch_counts(spark, sf_dir):
    return export.batch_counts(_observed(spark, sf_dir))


def status_derivation(spark, sf_dir):
    return rules.status(reports(spark, sf_dir)).select("report_id", "status")


def status_counts(spark, sf_dir):
    return rules.severities(_observed(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("reports"), F.count_if(c("attention") > 0).alias("with_attention"))


def summary_projection(spark, sf_dir):
    """The compact row of a report; levels only where they were measured."""
    r = rules.status(reports(spark, sf_dir))
    m = lambda x: F.when(c("measured"), c(x)).alias(x)
    return r.select("report_id", "status", "sample_rate", "bit_depth", "channels", "seconds", m("peak"), m("longest_run"), m("digital_silence"))


def nearest_standard_rate(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (c("p_size").cast("long") * 7919 % 100000).alias("rate"))
    near = rules.nearest_rate(c("rate"))
    return p.select("p_partkey", "rate", near.alias("nearest"), F.round((c("rate") - near) / near * 100, 4).alias("percent"))


def clients(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(c("c_custkey").alias("client_id"), c("c_name").alias("name"))


def projects(spark, sf_dir):
    """A project for each client and priority that has orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(c("o_custkey").alias("client_id"), F.concat_ws("/", c("o_custkey").cast("string"), "o_orderpriority").alias("project_id"), c("o_orderpriority").alias("project")).distinct()


def entries(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat_ws("/", c("o_custkey").cast("string"), "o_orderpriority").alias("project_id"), c("o_orderkey").alias("entry_id"), c("o_orderkey").alias("ord"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), c("o_totalprice").alias("measure"), c("o_orderstatus").alias("status"))


def client_stats(spark, sf_dir):
    return library.client_stats(clients(spark, sf_dir), projects(spark, sf_dir), entries(spark, sf_dir))


def sorted_clients(spark, sf_dir):
    """Clients by last activity, those without any last: one order of all, by ranges."""
    s = client_stats(spark, sf_dir).select("client_id", "last_activity")
    return library.ranked(s, [F.desc_nulls_last("last_activity"), F.asc("client_id")])


def project_stats(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.groupBy("project_id").agg(F.count("*").alias("checks"), F.max("timestamp").alias("last_activity"), F.max_by("timestamp", "ord").alias("last_checked"), F.round(F.avg("measure"), 4).alias("mean_measure"))


def library_stats(spark, sf_dir):
    """Library, client and project level by one rollup."""
    e = entries(spark, sf_dir).join(projects(spark, sf_dir), "project_id")
    r = e.rollup("client_id", "project").agg(F.count("*").alias("checks"), F.max("timestamp").alias("last_activity"), F.grouping_id().alias("level"))
    return r.withColumn("level", c("level").cast("long"))


def history_flatten(spark, sf_dir):
    h = library.history(clients(spark, sf_dir), projects(spark, sf_dir), entries(spark, sf_dir))
    return h.select("client_id", "name", "project", "entry_id", "timestamp", "status", F.round("measure", 2).alias("measure"))


def history_latest(spark, sf_dir):
    return library.latest(entries(spark, sf_dir), 2).select("project_id", "nth", "entry_id", "timestamp")


def log_append(spark, sf_dir):
    """The older checks, with the newer ones appended behind them."""
    e = entries(spark, sf_dir)
    out = library.append(e.where("entry_id % 4 > 0"), e.where("entry_id % 4 = 0").drop("ord"))
    return out.select("project_id", "entry_id", "ord")


def merge_measurements(spark, sf_dir):
    """Sums of lines take the place of an order's measure where there are lines over a limit."""
    new = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(c("l_orderkey").alias("entry_id")).agg(F.sum("l_extendedprice").alias("measure"))
    out = library.merge_measurements(entries(spark, sf_dir), new, "entry_id", ["measure"])
    return out.select("entry_id", F.round("measure", 2).alias("measure"))


def summary_fallback(spark, sf_dir):
    """A history row takes its figures from the report, and from the summary where the report is missing."""
    e = entries(spark, sf_dir)
    r = rules.status(reports(spark, sf_dir)).select(c("report_id"), c("status").alias("report_status"), "sample_rate")
    out = e.withColumn("report_id", c("entry_id") % 5000).join(r, "report_id", "left")
    return out.select("entry_id", F.coalesce("report_status", F.concat(F.lit("summary "), "status")).alias("status"), "sample_rate")


def duplicate_names(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), F.concat(F.lit(" Name "), (c("s_suppkey") % 7 * (c("s_suppkey") % 3)).cast("string")).alias("name"))
    k = table(spark, sf_dir, "customer").select((-c("c_custkey")).alias("id"), F.concat(F.lit("NAME "), c("c_custkey").cast("string"), F.lit("  ")).alias("name"))
    return library.duplicates(s.unionByName(k), "name").select("id", library.name_key(c("name")).alias("key"))


def _batch(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = F.when(c("o_orderkey") % 11 == 0, F.lit(float("nan"))).when(c("o_orderkey") % 13 == 0, F.lit(float("-inf"))).when(c("o_orderkey") % 17 > 0, F.round(c("o_totalprice"), -3))
    return o.select(c("o_custkey").alias("batch"), c("o_orderkey").alias("check_ord"), v.alias("v"))


def batch_sort_asc(spark, sf_dir):
    return library.positions(_batch(spark, sf_dir), "v", "check_ord", False, ["batch"]).select("batch", "check_ord", "pos")


def batch_sort_desc(spark, sf_dir):
    return library.positions(_batch(spark, sf_dir), "v", "check_ord", True, ["batch"]).select("batch", "check_ord", "pos")


def library_document(spark, sf_dir):
    """Each customer's orders as a client of an older document with fields of its own: migrated, published, loaded, published again and loaded again."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("rush")).alias("e"))
    logs = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("e")).alias("log"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(logs, F.col("c_custkey") == F.col("o_custkey"), "left")
    project = F.struct(F.concat(F.lit("p"), "c_custkey").alias("id"), F.coalesce("log", F.array().cast("array<struct<id:string,status:string,rush:string>>")).alias("log"), F.struct(F.col("c_nationkey").alias("nation")).alias("place"))
    fields = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.lit("2020-01-01").alias("created"), F.col("c_mktsegment").alias("colour"), F.array(project).alias("projects"))
    path = shared.folder(spark, "library")
    document.publish(document.migrated(c.select(F.to_json(fields).alias("value")), 0), path)
    document.publish(document.load(spark, path), path)
    r = document.load(spark, path).withColumn("p", F.get("projects", F.lit(0)))
    extra = lambda of, name, where="$", kind="string": F.variant_get(F.try_element_at(of, F.lit(name)), where, kind)
    rushed = F.size(F.filter("p.log", lambda e: extra(e["extras"], "rush") == "1-URGENT")).cast("long")
    return r.select("id", "name", "created_at", extra(F.col("extras"), "colour").alias("colour"), F.col("p.id").alias("project"), F.size("p.log").cast("long").alias("entries"), rushed.alias("rushed"), extra(F.col("p.extras"), "place", "$.nation", "long").alias("nation"), F.get("p.log", F.lit(0))["status"].alias("first_status"))


QUERIES = {f.__name__: f for f in (library_document, 
    rules_observations, severity_pivot, report_text, report_cells, batch_list, batch_counts, status_derivation, status_counts, summary_projection, nearest_standard_rate, client_stats, sorted_clients, project_stats, library_stats,
    history_flatten, history_latest, log_append, merge_measurements, summary_fallback, duplicate_names, batch_sort_asc, batch_sort_desc)}

E_SQL = "e AS (SELECT o_custkey || '/' || o_orderpriority AS project_id, o_custkey AS client_id, o_orderpriority AS project, o_orderkey AS entry_id, strftime(o_orderdate, '%Y-%m-%d') AS ts, o_totalprice AS measure, o_orderstatus AS status FROM orders)"
ST_SQL = f"{E_SQL}, st AS (SELECT c_custkey AS client_id, c_name AS name, count(DISTINCT project_id) AS projects, count(entry_id) AS checks, max(ts) AS last_activity, arg_max(ts, entry_id) AS last_checked FROM customer LEFT JOIN e ON client_id = c_custkey GROUP BY ALL)"
BATCH_SQL = "b AS (SELECT o_custkey AS batch, o_orderkey AS check_ord, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN NULL ELSE round(o_totalprice, -3) END AS v FROM orders)"
COUNT_SQL = f"""n AS (SELECT report_id, count(*) FILTER (severity = 'attention') AS attention, count(*) FILTER (severity = 'notice') AS notice, count(*) FILTER (severity = 'info') AS info, arg_min(severity, {RANK_SQL}) AS top FROM o GROUP BY 1),
 m AS (SELECT q.report_id, status, coalesce(attention, 0) AS attention, coalesce(notice, 0) AS notice, coalesce(info, 0) AS info, top, coalesce(attention, 0) * 1000 + coalesce(notice, 0) AS findings_rank FROM q LEFT JOIN n USING (report_id))"""
_RATES = "(VALUES " + ", ".join(f"({r}, {i})" for i, r in enumerate(rules.STANDARD_RATES)) + ") t(std, o)"

_YES = "CASE WHEN {0} THEN 'yes' WHEN NOT ({0}) THEN 'no' END"
_CELL = "CASE WHEN {0} = '-inf'::DOUBLE THEN '-inf' WHEN {0} IS NOT NULL THEN printf('%.2f', {0}) END"
_CELLS_SQL = {
    "File": "report_id::VARCHAR", "Read result": "CASE status WHEN 'ok' THEN 'fully read' WHEN 'partial' THEN 'partly read' ELSE 'could not be read' END", "Codec": "codec", "Sample rate (Hz)": "sample_rate::VARCHAR",
    "Bit depth": "bit_depth::VARCHAR", "Valid bits": "valid_bits::VARCHAR", "Channels": "channels::VARCHAR", "Duration (s)": "printf('%.6f', seconds)",
    "Duration (h:mm:ss)": "printf('%d:%02d:%06.3f', floor(seconds / 3600)::INT, floor(seconds / 60)::INT % 60, seconds - floor(seconds / 60) * 60)", "File size (bytes)": "actual_size::VARCHAR",
    "Peak (dBFS)": f"CASE WHEN measured THEN {_CELL.format('db')} END", "Longest full-scale run": "CASE WHEN measured THEN longest_run::VARCHAR END", "All silent": f"CASE WHEN measured AND peak IS NOT NULL THEN {_YES.format('silent')} END",
    "Lossless": _YES.format("NOT decoded"), "Origin flag": "CASE origin_flag WHEN 'declared' THEN 'declares AI generation' WHEN 'possible' THEN 'possible AI generation' END",
    "Content Credentials": "CASE WHEN manifest THEN 'present (signature not checked)' END", "Tools named": "CASE WHEN tools THEN 'a; b' END",
    "Level measurement source": "CASE WHEN measured THEN CASE WHEN decoded THEN 'decoded' ELSE 'the file''s own samples' END END", "True peak (dBTP)": _CELL.format("(db + 0.3)"),
    "Observations": "coalesce(n, 0)::VARCHAR", "Needs a look": "coalesce(look, '')", "Worth noting": "coalesce(worth, '')", "Samples not readable": "CASE WHEN measured THEN non_finite::VARCHAR END",
}

_SHOWN_DB = "CASE WHEN {0} IS NULL THEN '—' WHEN {0} = '-inf'::DOUBLE THEN '-∞' WHEN {0} > 0 THEN printf('+%.2f', {0}) ELSE printf('%.2f', {0}) END"
_FINITE = "CASE WHEN {0} > '-inf'::DOUBLE THEN round({0}, 6) END"

ORACLE = {
    "library_document": """WITH e AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS rushed, arg_min(o_orderstatus, o_orderkey::VARCHAR) AS st FROM orders GROUP BY 1)
      SELECT c_custkey::VARCHAR AS id, c_name AS name, '2020-01-01' AS created_at, c_mktsegment AS colour, 'p' || c_custkey AS project, coalesce(n, 0) AS entries, coalesce(rushed, 0) AS rushed, c_nationkey AS nation, st AS first_status FROM customer LEFT JOIN e ON o_custkey = c_custkey""",
    "batch_list": f"""WITH {R_SQL}, {_o_sql()}, {COUNT_SQL}, y AS (SELECT q.*, m.attention, m.notice, floor(seconds * 1000 + 0.5)::BIGINT AS ms FROM q JOIN m USING (report_id))
      SELECT report_id, coalesce(rtrim(rtrim(printf('%.3f', sample_rate / 1000), '0'), '.') || ' kHz', '—') AS rate, sample_rate AS rate_sort, coalesce(bit_depth::VARCHAR, '—') AS depth, bit_depth AS depth_sort,
        coalesce(channels::VARCHAR, '—') AS channels, channels AS channels_sort, coalesce(printf('%d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000), '—') AS duration, seconds AS duration_sort,
        CASE WHEN measured THEN {_SHOWN_DB.format("db")} ELSE '—' END AS peak, CASE WHEN measured THEN {_FINITE.format("db")} END AS peak_sort,
        CASE WHEN db > '-inf'::DOUBLE THEN {_SHOWN_DB.format("(db + 0.3)")} ELSE '—' END AS true_peak, {_FINITE.format("(db + 0.3)")} AS true_peak_sort,
        CASE WHEN attention + notice = 0 THEN '—' ELSE concat_ws(', ', CASE WHEN attention > 0 THEN attention || ' to look at' END, CASE WHEN notice > 0 THEN notice || ' to note' END) END AS findings, attention * 1000 + notice AS findings_sort FROM y""",
    "report_cells": f"""WITH {R_SQL}, {_o_sql()}, x AS (SELECT report_id, count(*) AS n, string_agg(title, ' | ' ORDER BY rule_ord, nth) FILTER (severity = 'attention') AS look, string_agg(title, ' | ' ORDER BY rule_ord, nth) FILTER (severity = 'notice') AS worth FROM o GROUP BY 1)
      SELECT {", ".join(f'{_CELLS_SQL.get(name, "NULL::VARCHAR")} AS "{name}"' for name in export.COLUMNS)} FROM q LEFT JOIN x USING (report_id)""",
    "rules_observations": f"WITH {R_SQL}, {_o_sql()} SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY {RANK_SQL}, rule_ord, nth) - 1 AS place, rule_id, obs_id, severity, title, detail FROM o",
    "severity_pivot": f"WITH {R_SQL}, {_o_sql()}, {COUNT_SQL} SELECT report_id, attention, notice, info, top, findings_rank FROM m",
    "report_text": f"""WITH {R_SQL}, {_o_sql()}, x AS (SELECT report_id, count(*) AS n, string_agg('  [' || severity || '] ' || title || chr(10) || '      ' || detail, chr(10) ORDER BY {RANK_SQL}, rule_ord, nth) AS t FROM o GROUP BY 1),
      y AS (SELECT *, floor(seconds * 1000 + 0.5)::BIGINT AS ms FROM q LEFT JOIN x USING (report_id))
      SELECT report_id, concat_ws(chr(10), 'REPORT ' || report_id || ' - ' || status, '  Sample rate     ' || coalesce(sample_rate::VARCHAR, '—'), '  Channels        ' || coalesce(channels::VARCHAR, '—'),
        '  Length          ' || coalesce(printf('%d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000), '—'), '  Peak            ' || CASE WHEN NOT measured THEN '—' WHEN db IS NULL THEN '— dBFS' WHEN db = '-inf'::DOUBLE THEN '-∞ dBFS' WHEN db > 0 THEN printf('+%.2f dBFS', db) ELSE printf('%.2f dBFS', db) END,
        'OBSERVATIONS ' || coalesce(n, 0), coalesce(t, '')) AS text FROM y""",
    "batch_counts": f"""WITH {R_SQL}, {_o_sql()}, {COUNT_SQL}, e AS (SELECT status, obs_id, count(*) AS n FROM o JOIN q USING (report_id) GROUP BY ALL), t AS (SELECT status, arg_min(obs_id, (-n, obs_id)) AS commonest FROM e GROUP BY 1)
      SELECT status, count(*) AS reports, count(*) FILTER (attention + notice > 0) AS with_findings, any_value(commonest) AS commonest FROM m LEFT JOIN t USING (status) GROUP BY status""",
    "status_derivation": f"WITH {R_SQL} SELECT report_id, status FROM q",
    "status_counts": f"WITH {R_SQL}, {_o_sql()}, {COUNT_SQL} SELECT status, count(*) AS reports, count(*) FILTER (attention > 0) AS with_attention FROM m GROUP BY status",
    "summary_projection": f"WITH {R_SQL} SELECT report_id, status, sample_rate, bit_depth, channels, seconds, CASE WHEN measured THEN peak END AS peak, CASE WHEN measured THEN longest_run END AS longest_run, CASE WHEN measured AND peak IS NOT NULL THEN silent END AS digital_silence FROM q",
    "nearest_standard_rate": f"""WITH p AS (SELECT p_partkey, p_size::BIGINT * 7919 % 100000 AS rate FROM part), n AS (SELECT p_partkey, rate, arg_min(std, (abs(rate - std), o))::BIGINT AS nearest FROM p, {_RATES} GROUP BY ALL)
      SELECT *, round((rate - nearest) / nearest * 100, 4) AS percent FROM n""",
    "client_stats": f"WITH {ST_SQL} SELECT * FROM st",
    "sorted_clients": f"WITH {ST_SQL} SELECT client_id, last_activity, row_number() OVER (ORDER BY last_activity DESC NULLS LAST, client_id) AS pos FROM st",
    "project_stats": f"WITH {E_SQL} SELECT project_id, count(*) AS checks, max(ts) AS last_activity, arg_max(ts, entry_id) AS last_checked, round(avg(measure), 4) AS mean_measure FROM e GROUP BY 1",
    "library_stats": f"WITH {E_SQL} SELECT client_id, project, count(*) AS checks, max(ts) AS last_activity, grouping_id(client_id, project) AS level FROM e GROUP BY ROLLUP (client_id, project)",
    "history_flatten": f"WITH {E_SQL} SELECT client_id, c_name AS name, project, entry_id, ts AS \"timestamp\", status, round(measure, 2) AS measure FROM e JOIN customer ON c_custkey = client_id",
    "history_latest": f"WITH {E_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY entry_id DESC) AS nth FROM e) SELECT project_id, nth, entry_id, ts AS \"timestamp\" FROM n WHERE nth <= 2",
    "log_append": f"""WITH {E_SQL}, l AS (SELECT project_id, max(entry_id) AS last FROM e WHERE entry_id % 4 > 0 GROUP BY 1)
      SELECT project_id, entry_id, entry_id AS ord FROM e WHERE entry_id % 4 > 0 UNION ALL
      SELECT project_id, entry_id, coalesce(last, 0) + row_number() OVER (PARTITION BY project_id ORDER BY ts, entry_id) FROM e LEFT JOIN l USING (project_id) WHERE entry_id % 4 = 0""",
    "merge_measurements": f"WITH {E_SQL}, m AS (SELECT l_orderkey AS entry_id, sum(l_extendedprice) AS s FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT entry_id, round(coalesce(s, measure), 2) AS measure FROM e LEFT JOIN m USING (entry_id)",
    "summary_fallback": f"WITH {R_SQL}, {E_SQL} SELECT entry_id, coalesce(q.status, 'summary ' || e.status) AS status, sample_rate FROM e LEFT JOIN q ON report_id = entry_id % 5000",
    "duplicate_names": """WITH a AS (SELECT s_suppkey AS id, ' Name ' || (s_suppkey % 7 * (s_suppkey % 3)) AS name FROM supplier UNION ALL SELECT -c_custkey, 'NAME ' || c_custkey || '  ' FROM customer),
      k AS (SELECT id, lower(trim(name)) AS key FROM a) SELECT id, key FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)""",
    "batch_sort_asc": f"WITH {BATCH_SQL} SELECT batch, check_ord, row_number() OVER (PARTITION BY batch ORDER BY v ASC NULLS LAST, check_ord) AS pos FROM b",
    "batch_sort_desc": f"WITH {BATCH_SQL} SELECT batch, check_ord, row_number() OVER (PARTITION BY batch ORDER BY v DESC NULLS LAST, check_ord) AS pos FROM b",
}
