"""Reports as tables and text: CSV cells that no spreadsheet runs, one text for each report, counts of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions import display, texts
from auricle.functions.measures import decibels
from auricle.operators import harmony


# The columns of a table of reports, in their order; new ones are only ever put at the end.
COLUMNS = [
    "File", "Folder path", "Read result", "Container", "Codec", "Sample rate (Hz)", "Bit depth", "Valid bits", "Channels", "Channel layout", "Layout name", "Duration (s)", "Duration (h:mm:ss)",
    "Sample frames", "File size (bytes)", "Peak (dBFS)", "RMS (dBFS)", "Full-scale samples", "Longest full-scale run", "All silent", "Levels measured from", "BWF description", "BWF originator",
    "BWF origination date", "BWF origination time", "BWF timecode", "iXML project", "iXML scene", "iXML take", "INFO title", "INFO artist", "Lossless", "Bitrate (kbps)", "Bitrate mode", "Profile",
    "Encoder", "Byte order", "Duration source", "Title", "Artist", "Album", "Track", "ISRC", "ISRC found in", "Gapless true length (s)", "Encoded peak (dBFS)", "Audio MD5", "Origin flag",
    "Origin confidence", "Origin headline", "Origin reasons", "Content Credentials", "Tools named", "Level measurement source", "Integrated loudness (LUFS)", "Loudness range (LU)", "True peak (dBTP)",
    "Short-term max (LUFS)", "Momentary max (LUFS)", "Stated BPM", "Stated BPM source", "Measured BPM", "Tempo confidence", "Tempo steady", "Tempo low BPM", "Tempo high BPM", "Key signature",
    "Key notes", "Likely key", "Other keys, same notes", "Key confidence", "How tonal", "Observations", "Needs a look", "Worth noting", "Checked at", "Samples not readable",
]
# What a table says of a report's status and origin.
READ = {"ok": "fully read", "partial": "partly read", "failed": "could not be read"}
ORIGIN = {"declared": "declares AI generation", "possible": "possible AI generation"}


def yes_no(x: Column) -> Column:
    """yes, no, or nothing where it is not known."""
    return F.when(x, "yes").when(~x, "no")


def clock(seconds: Column) -> Column:
    """h:mm:ss.mmm with hours always."""
    s = seconds - F.floor(seconds / 60) * 60
    return F.when(seconds.isNotNull() & ~F.isnan(seconds), F.format_string("%d:%02d:%06.3f", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, s))


def decibel_cell(db: Column) -> Column:
    return F.when(db == float("-inf"), "-inf").when(~F.isnan(db) & (F.abs(db) < float("inf")), F.format_string("%.2f", db))


def report_table(reports: DataFrame) -> DataFrame:
    """The table of reports under COLUMNS, as text; a column that the reports do not have is empty. It goes to write_csv as it is."""
    has = set(reports.columns)
    c = lambda name: F.col(name) if name in has else F.lit(None)
    measured = lambda x: F.when(F.col("measured"), x) if "measured" in has else F.lit(None)
    named = lambda of: F.create_map(*(F.lit(x) for pair in of.items() for x in pair))
    titles = lambda severity: F.array_join(F.transform(F.filter("observations", lambda o: o["severity"] == severity), lambda o: o["title"]), " | ")
    text = lambda name: c(name).cast("string")
    known = {
        "File": text("report_id"), "Read result": F.try_element_at(named(READ), c("status").cast("string")), "Container": text("kind"), "Codec": text("codec"), "Sample rate (Hz)": text("sample_rate"),
        "Bit depth": text("bit_depth"), "Valid bits": text("valid_bits"), "Channels": text("channels"), "Duration (s)": F.format_string("%.6f", c("seconds").cast("double")) if "seconds" in has else F.lit(None),
        "Duration (h:mm:ss)": clock(c("seconds").cast("double")), "Sample frames": text("frames"), "File size (bytes)": text("actual_size"), "Peak (dBFS)": measured(decibel_cell(c("peak_dbfs").cast("double"))),
        "Full-scale samples": measured(text("full_scale")), "Longest full-scale run": measured(text("longest_run")), "All silent": measured(yes_no(c("digital_silence").cast("boolean"))),
        "Lossless": yes_no(c("lossless").cast("boolean")), "Origin flag": F.try_element_at(named(ORIGIN), c("origin_flag").cast("string")), "Content Credentials": F.when(c("manifest").cast("boolean"), "present (signature not checked)"),
        "Tools named": F.nullif(F.array_join(F.array_distinct(c("tools").cast("array<string>")), "; "), F.lit("")), "Level measurement source": measured(F.when(c("source") == "decoded", "decoded").otherwise("the file's own samples")),
        "True peak (dBTP)": decibel_cell(c("true_peak").cast("double")), "Observations": F.size("observations").cast("string") if "observations" in has else F.lit(None),
        "Needs a look": titles("attention") if "observations" in has else F.lit(None), "Worth noting": titles("notice") if "observations" in has else F.lit(None), "Samples not readable": measured(text("non_finite")),
    }
    list_ = lambda name, by: F.nullif(F.array_join(c(name).cast("array<string>"), by), F.lit(""))
    fixed = lambda name, places: F.when(c(name).isNotNull(), F.format_string(f"%.{places}f", c(name).cast("double"))) if name in has else F.lit(None)
    known |= {
        "RMS (dBFS)": measured(decibel_cell(decibels(c("rms").cast("double")))), "Levels measured from": measured(F.format_string("%.1f%%", c("coverage").cast("double") * 100)) if "coverage" in has else F.lit(None), "Channel layout": list_("layout", " "), "Bitrate (kbps)": fixed("bitrate_kbps", 1), "Encoder": text("software"),
        "Byte order": F.when(c("little").cast("boolean"), "little-endian").when(~c("little").cast("boolean"), "big-endian"), "Title": text("title"), "Artist": text("artist"), "Album": text("album"), "Track": text("track"), "ISRC": texts.isrc(c("isrc").cast("string")) if "isrc" in has else F.lit(None),
        "BWF description": text("bext_description"), "BWF originator": text("bext_originator"), "BWF origination date": text("bext_date"), "BWF origination time": text("bext_time"),
        "BWF timecode": texts.timecode(c("bext_samples").cast("long"), c("sample_rate")) if "bext_samples" in has else F.lit(None), "Stated BPM": text("tempo"),
        "Origin confidence": text("origin_confidence"), "Origin headline": F.when(c("origin_flag").cast("string") != "none", text("origin_headline")), "Origin reasons": list_("origin_reasons", " | "),
        "Integrated loudness (LUFS)": decibel_cell(c("integrated").cast("double")), "Loudness range (LU)": fixed("loudness_range", 2), "Short-term max (LUFS)": decibel_cell(c("short_term_max").cast("double")), "Momentary max (LUFS)": decibel_cell(c("momentary_max").cast("double")),
        "Audio MD5": text("audio_md5"), "Measured BPM": fixed("measured_bpm", 1), "Tempo confidence": text("tempo_confidence"), "Tempo steady": yes_no(c("tempo_steady").cast("boolean")), "Tempo low BPM": fixed("tempo_low", 1), "Tempo high BPM": fixed("tempo_high", 1),
        "Likely key": text("key_name"), "Other keys, same notes": list_("key_alternatives", " | "), "Key confidence": text("key_confidence"), "How tonal": harmony.strength(c("key_concentration").cast("double")),
        "Tools named": F.nullif(F.array_join(F.array_distinct(F.coalesce(c("tools_named").cast("array<string>"), c("tools").cast("array<string>"))), "; "), F.lit("")),
    }
    seconds = known["Duration (s)"]
    known["Duration (s)"] = F.when(c("seconds").isNotNull(), seconds)
    return reports.select(*(known.get(name, F.lit(None)).cast("string").alias(name) for name in COLUMNS))


def batch_columns(reports: DataFrame) -> DataFrame:
    """report_id and, for each column of a batch's list, what it shows and what it is sorted by (name and name_sort): rate, depth, channels, duration, peak, true peak and
    findings. What is not known shows a dash and sorts as unknown; findings sort by those that need a look before those that are worth noting."""
    c, dash = F.col, F.lit(texts.UNKNOWN)
    measured = lambda x: F.when(c("measured"), x)
    many = lambda severity: F.size(F.filter("observations", lambda o: o["severity"] == severity))
    look, note = many("attention"), many("notice")
    said = F.concat_ws(", ", F.when(look > 0, F.concat(look.cast("string"), F.lit(" to look at"))), F.when(note > 0, F.concat(note.cast("string"), F.lit(" to note"))))
    peak = measured(c("peak_dbfs"))
    over = F.when(~F.isnan("true_peak") & (F.abs("true_peak") < float("inf")), c("true_peak"))
    return reports.select(
        "report_id",
        display.rate(c("sample_rate")).alias("rate"), c("sample_rate").alias("rate_sort"),
        F.coalesce(F.nullif(c("bit_depth"), F.lit(0).cast("long")).cast("string"), dash).alias("depth"), c("bit_depth").alias("depth_sort"),
        F.coalesce(F.nullif(c("channels"), F.lit(0).cast("long")).cast("string"), dash).alias("channels"), c("channels").alias("channels_sort"),
        texts.duration(c("seconds")).alias("duration"), c("seconds").alias("duration_sort"),
        F.when(c("measured"), texts.signed_db(c("peak_dbfs"), 2)).otherwise(dash).alias("peak"), peak.alias("peak_sort"),
        F.coalesce(F.when(over.isNotNull(), texts.signed_db(over, 2)), dash).alias("true_peak"), c("true_peak").alias("true_peak_sort"),
        F.when((look > 0) | (note > 0), said).otherwise(dash).alias("findings"), (look * 1000 + note).cast("long").alias("findings_sort"),
    )


def shown(value: Column, kind: str) -> Column:
    """A value as a cell: NULL is empty, minus infinity is -inf, text is guarded against formulas."""
    text = value.cast("string")
    if kind in ("double", "float"):
        text = F.when(value == float("-inf"), "-inf").when(~F.isnan(value) & (F.abs(value) < float("inf")), text)
    return F.coalesce(texts.guarded(text) if kind == "string" else text, F.lit(""))


def write_csv(df: DataFrame, path: str) -> None:
    """One file part for each partition, RFC 4180 with a header; columns keep their order. Line ends within cells become CRLF like those of rows."""
    cells = df.select(*(shown(F.col(c), kind).alias(c) for c, kind in df.dtypes))
    cells.write.csv(path, header=True, nullValue="", emptyValue="", escape='"', lineSep="\r\n")


def line(label: str, value: Column) -> Column:
    return F.concat(F.rpad(F.lit(f"  {label}"), 18, " "), F.coalesce(value, F.lit(texts.UNKNOWN)))


def report_text(reports: DataFrame) -> DataFrame:
    """report_id and text: what was read, its format, length, levels, and the observations in order of severity."""
    number = lambda c: F.col(c).cast("string")
    found = F.transform("observations", lambda o: F.concat(F.lit("  ["), o["severity"], F.lit("] "), o["title"], F.lit("\n      "), o["detail"]))
    sections = [
        F.concat(F.lit("REPORT "), number("report_id"), F.lit(" - "), F.col("status")),
        line("Sample rate", number("sample_rate")),
        line("Channels", number("channels")),
        line("Length", F.nullif(texts.duration(F.col("seconds")), F.lit(texts.UNKNOWN))),
        line("Peak", F.when(F.col("measured"), F.concat(texts.signed_db(F.col("peak_dbfs"), 2), F.lit(" dBFS")))),
        F.concat(F.lit("OBSERVATIONS "), F.size("observations").cast("string")),
    ]
    return reports.select("report_id", F.concat_ws("\n", *sections, F.array_join(found, "\n")).alias("text"))


def batch_counts(reports: DataFrame) -> DataFrame:
    """Of each status: reports, those with anything graver than information, and the commonest observation (the first by name on ties)."""
    graver = F.exists("observations", lambda o: o["severity"] != "info")
    sums = reports.groupBy("status").agg(F.count("*").alias("reports"), F.count_if(graver).alias("with_findings"))
    each = reports.select("status", F.explode("observations").alias("o")).groupBy("status", F.col("o.obs_id").alias("obs_id")).agg(F.count("*").alias("n"))
    top = each.groupBy("status").agg(F.min(F.struct(-F.col("n"), F.col("obs_id"))).alias("t")).select("status", F.col("t.obs_id").alias("commonest"))
    return sums.join(top, "status", "left")
