"""Reports of files: what the containers say and what the samples measure, as the row that the rules read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auricle.functions import shared
from auricle.functions.measures import decibels
from auricle.operators import provenance, signal, spectra
from auricle.sources import containers, decoders, samples, tags

c = F.col


#: Fields of all schemes that a report has, and those of a broadcast extension.
FIELDS = ["title", "artist", "album", "track", "isrc", "tempo", "software"]
BEXT = {"description": "bext_description", "originator": "bext_originator", "origination_date": "bext_date", "origination_time": "bext_time", "time_reference": "bext_samples"}


def fields_of(found: DataFrame) -> DataFrame:
    """One row a file: FIELDS as the schemes agree on them, and what a broadcast extension says; NULL where nothing does. found: rows of tags."""
    common = tags.fields(found).groupBy("report_id").agg(*(F.first(F.when(c("field") == x, c("value")), ignorenulls=True).alias(x) for x in FIELDS))
    bext = found.where("scheme = 'bext'").groupBy("report_id").agg(*(F.first(F.when(c("key") == k, c("value")), ignorenulls=True).alias(name) for k, name in BEXT.items()))
    return common.join(bext, "report_id", "full")


def from_files(found: DataFrame) -> DataFrame:
    """A report for each file (report_id, content) that is a known container. What is not established is NULL; files without readable samples are not measured, and where
    that is a decoder's word, `reason` has it. Compressed files that a registered decoder takes are measured as decoded.

    One pass over the contents lists chunks and metadata, one sums the samples, one filters them; a content meets its format, of one row a file, and no other content."""
    own = tags.inventory(found)
    listed = own.where("what = 'chunk'")
    described = shared.stored(containers.formats(listed), "formats")
    head = c("head")
    riff = F.when(F.substring(head, 1, 4).isin(bytearray(b"RIFF")), containers.unsigned(head, 4, 4, True)).when(F.substring(head, 1, 4).isin(bytearray(b"RIFX"), bytearray(b"FORM")), containers.unsigned(head, 4, 4))
    sizes = own.where("what = 'file' AND kind IS NOT NULL").select("report_id", "kind", c("length").alias("actual_size"), (riff + 8).alias("declared_size"))
    warned = listed.groupBy("report_id").agg(F.array_sort(F.collect_set("stopped")).alias("warnings"))
    origin = provenance.origins(own.where("what = 'tag'")).withColumnRenamed("processing", "tools")
    heard, plain, told = decoders.opened(found, described)
    told = told.select("report_id", "decoder", "reason", c("md5_stated").alias("audio_md5"), "md5_holds", F.when(c("reason").isNull(), F.try_divide(c("frames").cast("double"), "rate")).alias("decoded_seconds"))
    filtered = signal.analysed(samples.from_contents(heard, plain))
    peaks = signal.true_peak_of(filtered).select("report_id", c("true_peak_dbtp").alias("true_peak"))
    loud = signal.loudness_of(filtered).select("report_id", *(c(x).alias(y) for x, y in (("integrated", "integrated"), ("range", "loudness_range"), ("momentary_max", "momentary_max"), ("short_term_max", "short_term_max"))))
    per = containers.channel_levels(heard, plain)
    channels = F.array_sort(F.collect_list(F.struct("channel", "digital_silence", "dc_offset")))  # one element a channel
    levels = per.groupBy("report_id").agg(
        F.max("peak").alias("peak"), F.max("longest_run").alias("longest_run"), F.sum("full_scale").alias("full_scale"), F.sum("non_finite").alias("non_finite"),
        F.sqrt(F.avg(c("rms") * c("rms"))).alias("rms"), F.when(F.count("digital_silence") == F.count("*"), F.bool_and("digital_silence")).alias("digital_silence"), channels.alias("own"),
    )
    out = sizes  # a file without any chunk has a report too
    for more in (described.drop("kind"), levels, told, warned, origin, peaks, loud, fields_of(own.where("what = 'tag'"))):
        out = out.join(more, "report_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({
        "measured": c("own").isNotNull(),
        "complete": F.when(c("own").isNotNull(), F.lit(True)), "coverage": F.when(c("own").isNotNull(), F.lit(1.0)),
        "source": F.when(c("own").isNotNull(), F.when(c("decoder").isNotNull(), "decoded").otherwise("container")),
        "peak_dbfs": decibels(c("peak")),
        "channel_silence": F.transform("own", lambda x: x["digital_silence"]),
        "dc_offsets": F.transform("own", lambda x: x["dc_offset"]),
        "lossless": F.when(c("codec_family").startswith("pcm") | (c("kind") == "flac"), F.lit(True)),
        "size_matches": c("declared_size") == c("actual_size"),
        "truncated": c("shortfall") > 0,
        # a walk that an error ended is an error; one that the file's own figures ended is a warning
        "errors": F.size(F.filter("warnings", lambda w: w.rlike(r"^[A-Za-z]+(Error|Exception) behind "))).cast("long"),
        "warnings": F.coalesce("warnings", none),
        "mask_channels": F.when(c("channel_mask") > 0, F.bit_count("channel_mask").cast("long")), "undefined_bits": F.shiftright("channel_mask", 18) > 0,
        # metadata were read, and say nothing where there are none
        "manifest": F.coalesce("manifest", F.lit(False)), "origin_flag": F.coalesce("origin_flag", F.lit("none")), "tools": F.coalesce("tools", none), "tools_named": F.coalesce("tools_named", none), "outcome": F.coalesce("outcome", F.lit("nothing-recorded")),
    }).drop("own")


def with_music(reports: DataFrame, found: DataFrame, notes: int = spectra.NOTES, section: int = spectra.SECTION) -> DataFrame:
    """The reports with the tempo and the key that spectra.spectra() of the same files establish; NULL where nothing is established."""
    t = spectra.tempos(found).select("report_id", c("bpm").alias("measured_bpm"), c("confidence").alias("tempo_confidence"), c("steady").alias("tempo_steady"), c("least").alias("tempo_low"), c("greatest").alias("tempo_high"))
    k = spectra.keys(found, notes, section).where("established").select("report_id", c("name").alias("key_name"), c("alternatives").alias("key_alternatives"), c("confidence").alias("key_confidence"), c("concentration").alias("key_concentration"))
    return reports.join(t, "report_id", "left").join(k, "report_id", "left")
