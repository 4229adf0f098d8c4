"""Queries over figures, names and cells as they are shown or stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from auricle.functions import display

c = F.col


def shown_formats(spark, sf_dir):
    """Sizes, rates, depths, channels and offsets of parts, with unknowns among them."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(c("p_partkey").alias("k"), c("p_size").cast("long").alias("s"))
    some = lambda m, x: F.when(c("k") % m > 0, x)
    return p.select(
        "k",
        display.exact_bytes(some(5, c("k") * c("s") * 1000)).alias("bytes"),
        display.rate(some(7, c("s") * 125 + c("k") % 3 * 100)).alias("rate"),
        display.depth(some(6, c("s")), c("k") % 2 == 0).alias("depth"),
        display.channel_count(some(4, c("k") % 4)).alias("channels"),
        display.share(some(8, (c("s") - 20) / 1024)).alias("offset"),
        display.decoded_bytes(c("s") / 8, some(9, F.lit(44100)), c("k") % 3 + 1).alias("decoded_bytes"),
    )


def speaker_layouts(spark, sf_dir):
    """Speakers of masks of up to 20 bits, and those that channels imply without one."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(c("p_partkey").alias("k"), (c("p_partkey") * 7919 % (1 << 20) * (c("p_partkey") % 3)).alias("mask"), (c("p_partkey") % 9).alias("channels"))
    return p.select("k", F.array_join(display.speakers(c("mask"), c("channels")), " ").alias("speakers"), display.undefined_positions(c("mask")).alias("undefined"))


def dates_and_gaps(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(c("o_orderkey").alias("k"))
    text = F.concat(F.lit(" 00000000 "), F.lpad(F.hex(c("k") % 4096), 8, "0"), F.lit(" "), F.lpad(F.hex(c("k") % 97), 8, "0"), F.when(c("k") % 5 > 0, F.concat(F.lit(" "), F.lpad(F.hex(c("k") * 1000), 16, "0"))).otherwise(""))
    gap = display.gapless(text)
    return o.select("k", display.mac_date(F.when(c("k") % 6 > 0, display.MAC_EPOCH + c("k") * 5000).otherwise(0)).alias("date"), gap["delay"].alias("delay"), gap["padding"].alias("padding"), gap["samples"].alias("samples"))


def stored_numbers(spark, sf_dir):
    """Prices as JSON numbers and back, with those that JSON cannot write."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x = F.when(c("o_orderkey") % 7 == 0, F.lit(float("nan"))).when(c("o_orderkey") % 7 == 1, F.lit(float("-inf"))).when(c("o_orderkey") % 7 == 2, F.lit(float("inf"))).when(c("o_orderkey") % 7 > 3, F.floor("o_totalprice") / 4)
    o = o.select(c("o_orderkey").alias("k"), x.cast("double").alias("x")).withColumn("json", display.tagged_number(c("x")))
    back = display.untagged_number(c("json"))
    return o.select("k", F.coalesce(F.regexp_extract("json", r'"([-A-Za-z]+)"\}$', 1), F.lit("")).alias("tag"), (back.isNull() & c("x").isNull() | F.isnan(back) & F.isnan("x") | (back == c("x"))).alias("same"))


def safe_names(spark, sf_dir):
    """File names of the documents' whole first lines, cells of their sources, and texts in lines."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    line = F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))
    return d.select("doc_id", display.file_name(line).alias("file_name"), display.cell(F.coalesce("text", F.lit("")), 24).alias("cell"), display.wrapped(line, 30).alias("wrapped"))


def key_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(c("p_partkey").alias("k"))
    minor = c("k") % 5 < 2
    return p.select("k", display.key_name(c("k") % 12, minor).alias("name"), display.key_signature(c("k") % 12, minor).alias("signature"))


def origin_cells(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(c("p_partkey").alias("k"), "p_name")
    flag = F.get(F.array(*map(F.lit, ["none", "possible", "declared"])), (c("k") % 3).cast("int"))
    return p.select("k", display.origin_cell(flag, c("k") % 4 == 0, F.array("p_name", F.lit("x"))).alias("cell"))


QUERIES = {f.__name__: f for f in (shown_formats, speaker_layouts, dates_and_gaps, stored_numbers, safe_names, key_names, origin_cells)}

_ACCENTS = ("ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñ", "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNn")
ORACLE = {
    "shown_formats": """WITH p AS (SELECT p_partkey AS k, p_size::BIGINT AS s FROM part), q AS (SELECT *, (s * 125 + k % 3 * 100) / 1000 AS khz FROM p)
      SELECT k, CASE WHEN k % 5 > 0 THEN format('{:,}', k * s * 1000) || ' bytes' ELSE '—' END AS bytes, CASE WHEN k % 7 > 0 THEN rtrim(rtrim(printf('%.3f', khz), '0'), '.') || ' kHz' ELSE '—' END AS rate,
        CASE WHEN k % 6 > 0 THEN s || '-bit' || CASE WHEN k % 2 = 0 THEN ' float' ELSE '' END ELSE '—' END AS depth, CASE WHEN k % 4 = 0 THEN '—' WHEN k % 4 = 1 THEN 'mono' WHEN k % 4 = 2 THEN 'stereo' ELSE '3 channels' END AS channels,
        CASE WHEN k % 8 > 0 THEN printf('%.4f', round(((s - 20) / 1024 * 100)::DECIMAL(18, 9), 4)::DOUBLE) || ' %' ELSE '—' END AS "offset", CASE WHEN k % 9 > 0 THEN floor(s / 8 * 44100 * (k % 3 + 1) * 4 + 0.5)::BIGINT END AS decoded_bytes FROM q""",
    "speaker_layouts": f"""WITH p AS (SELECT p_partkey AS k, p_partkey * 7919 % 1048576 * (p_partkey % 3) AS mask, p_partkey % 9 AS channels FROM part)
      SELECT k, CASE WHEN mask > 0 THEN array_to_string(list_filter(list_transform(range(18), lambda i: CASE WHEN mask & (1 << i) > 0 THEN ({display.SPEAKERS})[i + 1] END), lambda x: x IS NOT NULL), ' ')
        ELSE CASE channels {" ".join(f"WHEN {n} THEN '{' '.join(v)}'" for n, v in display.IMPLIED.items())} END END AS speakers, bit_count(mask >> 18)::BIGINT AS undefined FROM p""",
    "dates_and_gaps": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 > 0 THEN strftime(make_timestamp(o_orderkey::BIGINT * 5000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS date, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4096 END AS delay,
      CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 97 END AS padding, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey * 1000 END AS samples FROM orders""",
    "stored_numbers": "SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'NaN' WHEN 1 THEN '-Infinity' WHEN 2 THEN 'Infinity' ELSE '' END AS tag, true AS same FROM orders",
    "safe_names": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10))[1] AS line FROM documents),
      e AS (SELECT *, regexp_replace(regexp_replace(translate(line, '{_ACCENTS[0]}', '{_ACCENTS[1]}'), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')[1:80] AS f FROM d),
      w AS (SELECT doc_id, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM d),
      r AS (SELECT doc_id, list_reduce(ws, lambda a, b: CASE WHEN length(a) - coalesce(nullif(length(a) - instr(reverse(a), chr(10)) + 1, length(a) + 1), 0) + 1 + length(b) <= 30 THEN a || ' ' || b ELSE a || chr(10) || b END) AS wrapped FROM w WHERE len(ws) > 0)
      SELECT e.doc_id, CASE WHEN f = '' THEN 'untitled' ELSE f END AS file_name, CASE WHEN length(t) > 24 THEN t[1:23] || '…' ELSE rpad(t, 24, ' ') END AS cell, coalesce(wrapped, '') AS wrapped FROM e LEFT JOIN r USING (doc_id)""",
    "key_names": f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 12 AS pc, p_partkey % 5 < 2 AS minor FROM part), n AS (SELECT *, ({display.SIGNATURES})[(pc + CASE WHEN minor THEN 3 ELSE 0 END) % 12 + 1] AS n FROM p)
      SELECT k, CASE WHEN minor THEN ({display.MINOR_NAMES})[pc + 1] || ' minor' ELSE ({display.MAJOR_NAMES})[pc + 1] || ' major' END AS name,
        CASE WHEN n = 0 THEN 'no sharps or flats' ELSE abs(n) || CASE WHEN n > 0 THEN ' sharp' ELSE ' flat' END || CASE WHEN abs(n) = 1 THEN '' ELSE 's' END END AS signature FROM n""",
    "origin_cells": "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 2 THEN 'declared: ' || p_name || ', x' WHEN p_partkey % 4 = 0 THEN 'credentials' WHEN p_partkey % 3 = 1 THEN 'possible' ELSE '' END AS cell FROM part",
}
