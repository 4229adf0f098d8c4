"""Queries over audio files that Spark makes from the events: each user's samples are written as containers, read back, measured and checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auricle.functions import shared
from auricle.operators import export, provenance, reports, rules, signal
from auricle.plans import streams
from auricle.plans import text as text_plans
from auricle.sources import containers, tags

RATE, ODD_RATE = 8000, 47952
c = F.col


def _number(value: Column, width: int, little: bool) -> Column:
    """An unsigned integer as bytes."""
    digits = F.lpad(F.hex(value), 2 * width, "0")
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))))
    return F.unhex(digits)


#: Frames of a file at most: a stream makes as many files as it needs.
FILE_FRAMES = 4096
#: Bytes that a cut file states and does not have.
MISSING = 20


def files(spark, sf_dir):
    """Mono 16-bit files of FILE_FRAMES frames at most for each stream; samples are round(x * 32767), loud ones at full scale. By the stream's remainder they are
    WAV, AIFF, CAF, big-endian WAV, WAV that ends too soon, or WAV with a stale byte rate and a rate out of use."""
    s = streams.framed(spark, sf_dir).withColumn("q", F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(F.col("x") * 40000 + 0.5))).cast("long"))
    lists = s.groupBy("stream", F.floor(F.col("frame") / FILE_FRAMES).alias("part")).agg(F.array_sort(F.collect_list(F.struct("frame", "q"))).alias("v"))

    def samples(little: bool) -> Column:
        four = lambda x: F.lpad(F.hex(F.pmod(x["q"], F.lit(65536))), 4, "0")
        each = (lambda x: F.concat(F.substring(four(x), 3, 2), F.substring(four(x), 1, 2))) if little else four
        return F.unhex(F.array_join(F.transform("v", each), ""))

    n, text = F.size("v").cast("long"), lambda t: F.lit(t.encode("latin-1"))
    u = lambda v, w, little=False: _number(v if isinstance(v, Column) else F.lit(v).cast("long"), w, little)

    def wav(name: str = "RIFF", rate: int = RATE, byte_rate: int = RATE * 2, missing: int = 0, little: bool = True) -> Column:
        return F.concat(text(name), u(n * 2 + 36, 4, little), text("WAVEfmt "), u(16, 4, little), u(1, 2, little), u(1, 2, little), u(rate, 4, little), u(byte_rate, 4, little), u(2, 2, little), u(16, 2, little), text("data"), u(n * 2 + missing, 4, little), samples(little))

    # 8000 as an 80-bit number: exponent 16383 + 12, mantissa 8000 * 2^51
    aiff = F.concat(text("FORM"), u(n * 2 + 46, 4), text("AIFFCOMM"), u(18, 4), u(1, 2), u(n, 4), u(16, 2), F.unhex(F.lit("400BFA00000000000000")), text("SSND"), u(n * 2 + 8, 4), u(0, 4), u(0, 4), samples(False))
    caf = F.concat(text("caff"), u(1, 2), u(0, 2), text("desc"), u(32, 8), F.unhex(F.lit("40BF400000000000")), text("lpcm"), u(0, 4), u(2, 4), u(1, 4), u(1, 4), u(16, 4), text("data"), u(n * 2 + 4, 8), u(0, 4), samples(False))
    kind = F.col("stream") % 6
    content = F.when(kind == 0, wav()).when(kind == 1, aiff).when(kind == 2, caf).when(kind == 3, wav("RIFX", little=False)).when(kind == 4, wav(missing=MISSING)).otherwise(wav(rate=ODD_RATE))
    return lists.select(F.concat_ws("-", "stream", "part").alias("report_id"), content.alias("content"))


def container_formats(spark, sf_dir):
    out = containers.formats(containers.chunks(files(spark, sf_dir)))
    return out.select("report_id", "kind", "codec", "codec_family", "sample_rate", "channels", "bit_depth", "frames", F.round("seconds", 6).alias("seconds"), "exact", "shortfall")


def container_levels(spark, sf_dir):
    found = files(spark, sf_dir)
    out = containers.channel_levels(found, containers.formats(containers.chunks(found)))
    return out.select("report_id", F.col("channel").cast("long").alias("channel"), "frames", "non_finite", F.round("peak", 6).alias("peak"), "peak_frame", F.round("rms", 6).alias("rms"), F.round("dc_offset", 6).alias("dc_offset"), "full_scale", "longest_run", "digital_silence")


def _checked(spark, sf_dir):
    return rules.observe(rules.status(reports.from_files(shared.stored(files(spark, sf_dir), "files"))))


def file_observations(spark, sf_dir):
    """From files to observations: containers, samples, status, rules with titles and details."""
    o = _checked(spark, sf_dir).select("report_id", "status", F.posexplode("observations").alias("place", "o"))
    return o.select("report_id", "status", F.col("place").cast("long").alias("place"), "o.obs_id", "o.severity", "o.title", "o.detail")


def file_reports(spark, sf_dir):
    """The text of each file's report."""
    return export.report_text(_checked(spark, sf_dir))


def tagged_files(spark, sf_dir):
    """A file for each customer whose metadata are its name and phone: by the key's remainder WAV with an INFO list, cue points and labels, MP3 with ID3 2.3 (and
    frames), FLAC with Vorbis comments, or AIFF with text chunks."""
    p = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    text, key = lambda t: F.lit(t.encode("latin-1")), F.col("c_custkey")
    name, phone = F.encode("c_name", "UTF-8"), F.encode("c_mktsegment", "UTF-8")
    u = lambda v, w, little=False: _number(v if isinstance(v, Column) else F.lit(v).cast("long"), w, little)
    odd = lambda b: F.when(F.length(b) % 2 == 1, F.concat(b, F.lit(b"\0"))).otherwise(b)
    chunk = lambda n, b, little: F.concat(text(n), u(F.length(b), 4, little), odd(b))
    # what made each file: one of the tools that are known, or none
    tools_ = [t.match.title() for t in provenance.TOOLS]
    maker = F.encode(F.concat(F.when(key % 5 == 0, "Made with ").otherwise("Desk "), F.when(key % 3 > 0, F.get(F.array(*map(F.lit, tools_)), (key % len(tools_)).cast("int"))).otherwise("x")), "UTF-8")
    info = F.concat(text("INFO"), chunk("INAM", name, True), chunk("IART", phone, True), chunk("INAM", phone, True), chunk("ISFT", maker, True))
    point = lambda i, at: F.concat(u(i, 4, True), u(0, 4, True), text("data"), u(0, 4, True), u(0, 4, True), u(at, 4, True))
    cue = F.concat(u(2, 4, True), point(1, key % 1000), point(2, key % 7))
    labels = F.concat(text("adtl"), chunk("labl", F.concat(u(1, 4, True), phone), True), chunk("labl", F.concat(u(1, 4, True), name), True))
    # extensible: 24 bits, of which fewer may be audio, and a mask that may name other speakers than there are channels, or none
    valid, mask = F.when(key % 8 == 0, 20).otherwise(24).cast("long"), F.when(key % 3 == 0, 3).when(key % 3 == 1, 4).otherwise(3 + (1 << 20)).cast("long")
    fmt = F.concat(u(65534, 2, True), u(2, 2, True), u(44100, 4, True), u(264600, 4, True), u(6, 2, True), u(24, 2, True), u(22, 2, True), u(valid, 2, True), u(mask, 4, True), u(1, 2, True), F.lit(bytes.fromhex("000000001000800000aa00389b71")))
    claim = F.when(key % 5 == 0, chunk("C2PA", text("....jumb c2pa.claim trainedAlgorithmicMedia"), True)).when(key % 5 == 1, chunk("C2PA", text("....jumb c2pa.claim of a camera"), True)).otherwise(F.lit(b""))
    body = F.concat(text("WAVE"), chunk("fmt ", fmt, True), chunk("LIST", info, True), chunk("cue ", cue, True), chunk("LIST", labels, True), claim, chunk("data", F.lit(bytes(60)), True))
    wav = F.concat(text("RIFF"), u(F.length(body), 4, True), body)
    frame = lambda n, b: F.concat(text(n), u(F.length(b) + 1, 4), u(0, 2), F.lit(b"\0"), b)
    id3 = F.concat(frame("TIT2", phone), frame("TPE1", phone), frame("TIT2", name), frame("TXXX", F.concat(text("mood"), F.lit(b"\0"), phone)), frame("TSSE", phone), frame("TSSE", maker))
    safe = lambda n: F.concat(*(u(F.shiftright(n, 7 * i) % 128, 1) for i in (3, 2, 1, 0)))
    # frames of 417 bytes: version 1, layer 3, 128 kilobits, 44.1 kHz
    mp3 = F.concat(text("ID3"), F.lit(b"\3\0\0"), safe(F.length(id3)), id3, F.unhex(F.repeat(F.lit("FFFB9000" + "00" * 413), (key % 40 + 2).cast("int"))))
    comment = lambda b: F.concat(u(F.length(b), 4, True), b)
    comments = F.concat(comment(text("x")), u(4, 4, True), comment(F.concat(text("encoder="), maker)), comment(F.concat(text("title="), name)), comment(F.concat(text("ARTIST="), phone)), comment(F.concat(text("artist="), name)))
    flac = F.concat(text("fLaC"), u(4 + 128, 1), u(F.length(comments), 3), comments)
    forms = F.concat(text("AIFF"), chunk("NAME", name, False), chunk("AUTH", phone, False), chunk("ANNO", maker, False))
    aiff = F.concat(text("FORM"), u(F.length(forms), 4), forms)
    # a projection for each kind, each small enough to be compiled
    parts = [p.where(key % 4 == i).select(key.cast("string").alias("report_id"), content.alias("content")) for i, content in enumerate((wav, mp3, flac, aiff))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def file_fields(spark, sf_dir):
    """Titles and artists, whatever the scheme."""
    return tags.fields(tags.tags(tagged_files(spark, sf_dir))).where("field IN ('title', 'artist')")


def file_tags(spark, sf_dir):
    """How often each scheme has each key, and the least and greatest value."""
    t = tags.tags(tagged_files(spark, sf_dir))
    return t.groupBy("scheme", "key").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def file_origins(spark, sf_dir):
    """What each file's metadata say of what made it."""
    out = provenance.assess_files(provenance.origin_fields(tags.tags(tagged_files(spark, sf_dir))))
    return out.select("report_id", F.array_join("tools", ", ").alias("tools"), "phrases", "flag", F.col("weight").cast("long").alias("weight"), "summary")


def report_origins(spark, sf_dir):
    """Origin, format and structure observations of the customers' files, from their bytes to the rules."""
    r = rules.observe(rules.status(reports.from_files(shared.stored(tagged_files(spark, sf_dir), "files"))))
    seen = F.array_join(F.array_sort(F.transform(F.filter("observations", lambda o: o["rule_id"].isin(*ORIGIN_RULES)), lambda o: F.concat(o["obs_id"], F.lit(": "), o["title"]))), " | ")
    return r.select("report_id", "status", "valid_bits", "mask_channels", "manifest", "origin_flag", "origin_confidence", "origin_headline", F.array_join("origin_reasons", "; ").alias("reasons"), F.array_join("tools", ", ").alias("processing"), provenance.summary_line(c("outcome"), c("tools_named")).alias("summary"), seen.alias("observations"))


def cue_points(spark, sf_dir):
    return tags.labelled_cues(tags.tags(tagged_files(spark, sf_dir)))


def mpeg_lengths(spark, sf_dir):
    """Lengths of the MP3 files by walking their frames."""
    out = containers.formats(containers.chunks(tagged_files(spark, sf_dir))).where("kind = 'mp3'")
    return out.select("report_id", "sample_rate", "channels", "codec", "frames", F.round("seconds", 6).alias("seconds"))


#: Rules that report_origins shows.
ORIGIN_RULES = ["valid-bits-differ", "channel-mask-disagrees", "channel-mask-undefined-bits", "provenance-manifest", "possible-ai-generated", "ai-assisted-processing"]
QUERIES = {f.__name__: f for f in (container_formats, container_levels, file_observations, file_reports, file_fields, file_tags, file_origins, report_origins, cue_points, mpeg_lengths)}
_TAPS = signal.interpolator(signal.phases_of(RATE)).tolist()
_Q = f"""WITH {streams.S_SQL}, q AS (SELECT stream, stream || '-' || frame // {FILE_FRAMES} AS report_id, frame % {FILE_FRAMES} AS frame, greatest(-32768, least(32767, floor(x * 40000 + 0.5))) / 32768 AS y FROM s),
  m AS (SELECT report_id, any_value(stream) % 6 AS kind, count(*) AS n, max(abs(y)) AS peak, sqrt(avg(y * y)) AS rms, avg(y) AS dc, count(*) FILTER (abs(y) >= 32767 / 32768) AS full_scale, bool_and(y = 0) AS silent FROM q GROUP BY 1),
  u AS (SELECT report_id, abs(y) >= 32767 / 32768 AS loud, sum((abs(y) < 32767 / 32768)::INT) OVER (PARTITION BY report_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM q),
  lr AS (SELECT report_id, max(k) AS longest_run FROM (SELECT report_id, run, count(*) FILTER (loud) AS k FROM u GROUP BY 1, 2) GROUP BY 1),
  ta(p, j, w) AS (VALUES {", ".join(f"({p}, {j}, {w!r}::DOUBLE)" for p, row in enumerate(_TAPS) for j, w in enumerate(row))}), tq AS (SELECT report_id, max(abs(v)) AS between FROM (SELECT report_id, p, frame + j AS at, sum(y * w) AS v FROM q, ta GROUP BY ALL) GROUP BY 1),
  f AS (SELECT *, CASE WHEN greatest(peak, between) > 0 THEN 20 * log10(greatest(peak, between)) ELSE '-inf'::DOUBLE END AS tp, CASE WHEN kind = 5 THEN {ODD_RATE} ELSE {RATE} END AS rate, CASE WHEN kind = 4 THEN {MISSING} ELSE 0 END AS shortfall,
    CASE WHEN peak > 0 THEN 20 * log10(peak) ELSE '-inf'::DOUBLE END AS db FROM m JOIN lr USING (report_id) JOIN tq USING (report_id)),
  g AS (SELECT *, n / rate AS seconds, CASE WHEN db = '-inf'::DOUBLE THEN '-∞' WHEN db > 0 THEN printf('+%.2f', db) ELSE printf('%.2f', db) END AS pt, CASE WHEN shortfall > 0 THEN 'partial' ELSE 'ok' END AS status FROM f),
  o AS (
    SELECT report_id, status, 0 AS r, 1 AS k, 'parse-partial' AS obs_id, 'attention' AS severity, 'The file could be read in part' AS title, 'Some of it could not be interpreted, so figures may be missing.' AS detail FROM g WHERE shortfall > 0
    UNION ALL SELECT report_id, status, 1, 2, 'parse-warnings', 'notice', 'Note on the file''s structure', 'the chunk at byte 36 states ' || (n * 2 + {MISSING}) || ' bytes, ' || n * 2 || ' are there' FROM g WHERE shortfall > 0
    UNION ALL SELECT report_id, status, 0, 18, 'true-peak-over', 'attention', 'Peak of ' || printf('+%.2f', tp) || ' dBTP between samples', 'The curve through the samples reaches ' || printf('+%.2f', tp) || ' dBTP; the samples reach ' || pt || ' dBFS.' FROM g WHERE tp > 0
    UNION ALL SELECT report_id, status, 0, 3, 'data-truncated', 'attention', 'Audio data are shorter than stated', shortfall || ' bytes of the stated audio data are missing. Lengths describe what is there.' FROM g WHERE shortfall > 0
    UNION ALL SELECT report_id, status, 1, 5, 'sample-rate-nonstandard', 'notice', 'Sample rate {ODD_RATE} Hz', '{ODD_RATE} Hz is no rate in common use; the nearest is 48000 Hz.' FROM g WHERE kind = 5
    UNION ALL SELECT report_id, status, 1, 11, 'byte-rate-inconsistent', 'notice', 'Header figures disagree', '{RATE * 2} bytes a second are stated; rate and block size give {ODD_RATE * 2}.' FROM g WHERE kind = 5
    UNION ALL SELECT report_id, status, 1, 12, 'duration-very-short', 'notice', printf('%.3f', round(seconds::DECIMAL(18, 9), 3)::DOUBLE) || ' seconds long', 'The file holds ' || printf('%.3f', round(seconds::DECIMAL(18, 9), 3)::DOUBLE) || ' seconds of audio.' FROM g WHERE seconds < 1
    UNION ALL SELECT report_id, status, 2, 13, 'duration-inexact', 'info', 'Length is approximate', 'The audio data are not whole frames, or part of them is missing.' FROM g WHERE shortfall > 0
    UNION ALL SELECT report_id, status, 0, 15, 'digital-silence', 'attention', 'The file is silent', 'Every sample that was measured is zero.' FROM g WHERE silent
    UNION ALL SELECT report_id, status, 0, 17, 'full-scale-run', 'attention', 'Flat peaks at full scale', 'Up to ' || longest_run || ' samples in a row stand at full scale.' FROM g WHERE NOT silent AND longest_run >= 3
    UNION ALL SELECT report_id, status, 1, 19, 'peak-at-ceiling', 'notice', 'Peak at ' || pt || ' dBFS', 'The loudest sample stands at ' || pt || ' dBFS, without a long run there.' FROM g WHERE NOT silent AND longest_run < 3 AND db >= -0.1
    UNION ALL SELECT report_id, status, 2, 21, 'level-very-low', 'info', 'Low peak of ' || pt || ' dBFS', 'The loudest sample stands at ' || pt || ' dBFS, far below full scale.' FROM g WHERE NOT silent AND db < -40
    UNION ALL SELECT report_id, status, 1, 22, 'dc-offset', 'notice', 'Offset from zero', 'channel 1: ' || printf('%.3f', round((dc * 100)::DECIMAL(18, 9), 3)::DOUBLE) || ' % of full scale.' FROM g WHERE NOT silent AND abs(dc) > 0.001)"""
_MAKERS = [t.match.title() for t in provenance.TOOLS]
_C = f"""WITH c AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS report_id, c_custkey % 4 AS kind, c_name AS name, c_mktsegment AS phone,
  CASE WHEN c_custkey % 5 = 0 THEN 'Made with ' ELSE 'Desk ' END || CASE WHEN c_custkey % 3 > 0 THEN ({_MAKERS})[c_custkey % {len(_MAKERS)} + 1] ELSE 'x' END AS maker FROM customer)"""
ORACLE = {
    "file_fields": f"""{_C} SELECT report_id, 'title' AS field, name AS value FROM c UNION ALL
      SELECT report_id, 'artist', CASE WHEN kind = 2 THEN phone || '; ' || name ELSE phone END FROM c""",
    "file_tags": f"""{_C}, t AS (SELECT 'info' AS scheme, 'INAM' AS key, name AS v FROM c WHERE kind = 0 UNION ALL SELECT 'info', 'INAM', phone FROM c WHERE kind = 0 UNION ALL SELECT 'info', 'IART', phone FROM c WHERE kind = 0
      UNION ALL SELECT 'c2pa', 'evidence', 'labelled box' FROM c WHERE kind = 0 AND k % 5 < 2 UNION ALL SELECT 'c2pa', 'source_type', unnest(['trainedalgorithmicmedia', 'algorithmicmedia']) FROM c WHERE kind = 0 AND k % 5 = 0
      UNION ALL SELECT 'cue', '1', (k % 1000)::VARCHAR FROM c WHERE kind = 0 UNION ALL SELECT 'cue', '2', (k % 7)::VARCHAR FROM c WHERE kind = 0 UNION ALL SELECT 'adtl', '1', unnest([phone, name]) FROM c WHERE kind = 0
      UNION ALL SELECT 'id3v2', 'TIT2', unnest([phone, name]) FROM c WHERE kind = 1 UNION ALL SELECT 'id3v2', 'TPE1', phone FROM c WHERE kind = 1 UNION ALL SELECT 'id3v2', 'TXXX:mood', phone FROM c WHERE kind = 1
      UNION ALL SELECT ['info', 'id3v2', 'vorbis', 'aiff'][kind + 1], ['ISFT', 'TSSE', 'ENCODER', 'ANNO'][kind + 1], maker FROM c UNION ALL SELECT 'id3v2', 'TSSE', phone FROM c WHERE kind = 1
      UNION ALL SELECT 'vorbis', 'VENDOR', 'x' FROM c WHERE kind = 2 UNION ALL SELECT 'vorbis', 'TITLE', name FROM c WHERE kind = 2 UNION ALL SELECT 'vorbis', 'ARTIST', unnest([phone, name]) FROM c WHERE kind = 2
      UNION ALL SELECT 'aiff', 'NAME', name FROM c WHERE kind = 3 UNION ALL SELECT 'aiff', 'AUTH', phone FROM c WHERE kind = 3)
      SELECT scheme, key, count(*) AS n, min(v) AS least, max(v) AS greatest FROM t GROUP BY ALL""",
    "file_origins": text_plans._assessed_sql(_C.removeprefix("WITH ") + ", r AS (SELECT report_id AS id, maker AS text FROM c)") + """, w AS (SELECT id, string_agg(name, ', ' ORDER BY name) AS names FROM tm GROUP BY 1)
      SELECT id AS report_id, coalesce(names, '') AS tools, phrases, flag, weight, CASE WHEN tools > 0 THEN 'Names ' || names || ' in its metadata' ELSE 'Records what made it, and none of the known tools' END AS summary FROM a LEFT JOIN w USING (id)""",
    "report_origins": text_plans._assessed_sql(_C.removeprefix("WITH ") + ", r AS (SELECT report_id AS id, maker AS text FROM c)") + f""", fl AS (SELECT report_id AS id, kind, k, kind = 0 AND k % 5 < 2 AS manifest, kind = 0 AND k % 5 = 0 AS claimed, ['Software (INFO ISFT)', 'Encoder settings (ID3 TSSE)', 'Encoder (Vorbis ENCODER)', 'AIFF annotation'][kind + 1] AS label FROM c),
      tn AS (SELECT tm.*, first_ord FROM tm JOIN (SELECT id, name, min(ord) AS first_ord FROM hit GROUP BY 1, 2) USING (id, name)),
      rs AS (SELECT id, 0 AS a, 0 AS b, 3 AS w, 'Content Credentials claim trainedalgorithmicmedia' AS t FROM fl WHERE claimed UNION ALL SELECT id, 0, 0, 1, 'Content Credentials are there and claim no generation' FROM fl WHERE manifest AND NOT claimed
        UNION ALL SELECT id, 1, first_ord, weight, label || CASE WHEN weight = 1 THEN ' has the word ' ELSE ' names ' END || name FROM tn JOIN fl USING (id) WHERE tn.kind IN ('music', 'model', 'speech')),
      ra AS (SELECT id, string_agg(t, '; ' ORDER BY a, b) AS reasons, max(w) AS w FROM (SELECT rs.* FROM rs) GROUP BY 1),
      ns AS (SELECT id, string_agg(name, ', ' ORDER BY first_ord) AS names, string_agg(name, ', ' ORDER BY first_ord) FILTER (kind NOT IN ('music', 'model', 'speech')) AS processing, arg_min(name, first_ord) FILTER (kind IN ('music', 'model', 'speech') AND NOT common) AS made FROM tn GROUP BY 1),
      z AS (SELECT fl.id, fl.kind, fl.k, manifest, claimed, reasons, ra.w, names, processing, made, claimed OR made IS NOT NULL AS settled FROM fl LEFT JOIN ra USING (id) LEFT JOIN ns USING (id)),
      y AS (SELECT *, CASE WHEN w IS NULL THEN 'none' WHEN settled THEN 'declared' ELSE 'possible' END AS flag, CASE WHEN kind = 0 AND k % 8 = 0 THEN 20 WHEN kind = 0 THEN 24 END AS vb, CASE WHEN kind = 0 THEN CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END END AS mc FROM z)
      SELECT id AS report_id, CASE WHEN kind > 1 THEN 'failed' ELSE 'ok' END AS status, vb AS valid_bits, mc AS mask_channels, manifest, flag AS origin_flag, CASE WHEN w IS NULL THEN NULL WHEN settled THEN 'declared by the file' ELSE ['weak', 'moderate', 'strong'][w] END AS origin_confidence,
        CASE WHEN w IS NULL THEN 'No signs of generation in the metadata' WHEN claimed THEN 'The file declares that it was generated' WHEN settled THEN 'The file says that it was made with ' || made WHEN w = 3 THEN 'Strong signs of generation' WHEN w = 2 THEN 'Possibly generated' ELSE 'Faint signs of generation' END AS origin_headline,
        coalesce(reasons, '') AS reasons, coalesce(processing, '') AS processing, CASE WHEN manifest THEN 'Has a Content Credentials manifest (signature not checked)' WHEN names IS NOT NULL THEN 'Names ' || names || ' in its metadata' ELSE 'Records what made it, and none of the known tools' END AS summary,
        array_to_string(list_sort(list_filter(list_concat([CASE WHEN vb = 20 THEN 'valid-bits-differ: 20 bits of audio in 24' END, CASE WHEN mc <> 2 THEN 'channel-mask-disagrees: Channels and speaker mask differ' END, CASE WHEN mc = 3 THEN 'channel-mask-undefined-bits: Speaker mask with undefined positions' END,
          CASE WHEN manifest THEN 'provenance-manifest: The file has Content Credentials' END, CASE WHEN flag <> 'none' THEN 'possible-ai-generated: Origin: ' || flag END], list_transform(string_split(processing, ', '), lambda x: 'ai-assisted-processing: Metadata name ' || x)), lambda x: x IS NOT NULL)), ' | ') AS observations FROM y""",
    "cue_points": f"{_C} SELECT report_id, '1' AS cue, k % 1000 AS sample, name AS label FROM c WHERE kind = 0 UNION ALL SELECT report_id, '2', k % 7, NULL FROM c WHERE kind = 0",
    "mpeg_lengths": f"{_C} SELECT report_id, 44100 AS sample_rate, 2 AS channels, 'mp3' AS codec, (k % 40 + 2) * 1152 AS frames, round((k % 40 + 2) * 1152 / 44100, 6) AS seconds FROM c WHERE kind = 1",
    "container_formats": f"{_Q} SELECT report_id, ['wav', 'aiff', 'caf', 'wav', 'wav', 'wav'][kind + 1] AS kind, 'pcm' AS codec, 'pcm-int' AS codec_family, rate AS sample_rate, 1 AS channels, 16 AS bit_depth, n AS frames, round(seconds, 6) AS seconds, shortfall = 0 AS exact, shortfall FROM g",
    "container_levels": f"{_Q}, p AS (SELECT report_id, min(frame) FILTER (abs(y) = peak) AS peak_frame FROM q JOIN m USING (report_id) GROUP BY 1) SELECT report_id, 0 AS channel, n AS frames, 0 AS non_finite, round(peak, 6) AS peak, peak_frame, round(rms, 6) AS rms, round(dc, 6) AS dc_offset, full_scale, longest_run, silent AS digital_silence FROM g JOIN p USING (report_id)",
    "file_observations": f"{_Q} SELECT report_id, status, row_number() OVER (PARTITION BY report_id ORDER BY r, k) - 1 AS place, obs_id, severity, title, detail FROM o",
    "file_reports": f"""{_Q}, x AS (SELECT report_id, count(*) AS c, string_agg('  [' || severity || '] ' || title || chr(10) || '      ' || detail, chr(10) ORDER BY r, k) AS t FROM o GROUP BY 1), y AS (SELECT *, floor(seconds * 1000 + 0.5)::BIGINT AS ms FROM g LEFT JOIN x USING (report_id))
      SELECT report_id, concat_ws(chr(10), 'REPORT ' || report_id || ' - ' || status, '  Sample rate     ' || rate, '  Channels        1', '  Length          ' || printf('%d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000), '  Peak            ' || pt || ' dBFS', 'OBSERVATIONS ' || coalesce(c, 0), coalesce(t, '')) AS text FROM y""",
}
