"""Observation rules as column expressions over report rows.

A rule is a predicate, a severity, a title and a detail; it says what is there and judges nothing. A row's observations come out as an array
sorted by severity and then by the rules' order, without any shuffle. Own rules join in as further entries of the list. Titles and details
are templates: {name} stands for a column of the report, or for one of FIGURES, as text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions import texts
from auricle.functions.measures import finite

RANK = {"attention": 0, "notice": 1, "info": 2}
# Sample rates and bit depths in common use.
STANDARD_RATES = [8000, 11025, 16000, 22050, 32000, 44100, 48000, 64000, 88200, 96000, 176400, 192000, 352800, 384000]
STANDARD_DEPTHS = [8, 16, 20, 24, 32, 64]
# Samples of a run, decibels near and far below full scale, seconds of a short file, share of an offset, seconds of drift.
RUN, NEAR, VERY_LOW, SHORT, OFFSET, DRIFT = 3, -0.1, -40.0, 1.0, 0.001, 0.005

c = F.col


@dataclass(frozen=True)
class Rule:
    """when: its predicate; severity: a name or a Column; each: if given, an array whose elements are an observation each and its {each}."""

    id: str
    severity: str | Column
    when: Callable[[], Column]
    each: Callable[[], Column] | None = None
    name: Callable[[], Column] | None = None
    title: str = ""
    detail: str = ""


def _levels() -> Column:
    return c("measured") & c("peak_dbfs").isNotNull()


def _some_silent() -> Column:
    return _heard() & F.exists("channel_silence", lambda s: F.coalesce(s, F.lit(False)))


def _heard() -> Column:
    """Levels are established and not those of silence."""
    return _levels() & ~F.coalesce(c("digital_silence"), F.lit(False))


def _known(*names: str) -> Column:
    """None of the columns is NULL or zero."""
    out = F.lit(True)
    for name in names:
        out = out & F.coalesce(c(name) != 0, F.lit(False))
    return out


#: What templates may name besides columns: figures made from them.
FIGURES: dict[str, Callable[[], Column]] = {
    "nearest": lambda: nearest_rate(c("sample_rate")),
    "expected_rate": lambda: c("sample_rate") * c("block_align"),
    "size_gap": lambda: F.abs(c("declared_size") - c("actual_size")),
    "peak_text": lambda: texts.signed_db(c("peak_dbfs"), 2),
    "true_peak_text": lambda: texts.signed_db(c("true_peak"), 2),
    "seconds_text": lambda: F.format_string("%.3f", c("seconds")),
    "silent_channels": lambda: F.size(F.filter("channel_silence", lambda s: F.coalesce(s, F.lit(False)))),
    "all_channels": lambda: F.size("channel_silence"),
    "offsets": lambda: F.array_join(F.filter(F.transform("dc_offsets", lambda d, i: F.when(F.abs(d) > OFFSET, F.concat(F.lit("channel "), (i + 1).cast("string"), F.lit(": "), F.format_string("%.3f", d * 100), F.lit(" %")))), lambda x: x.isNotNull()), "; "),
    "drift_text": lambda: F.when(F.abs(c("seconds") - c("decoded_seconds")) > DRIFT, F.concat(F.lit(" The decoded audio differs from the stated length by "), F.format_string("%.3f", F.abs(c("seconds") - c("decoded_seconds"))), F.lit(" seconds."))).otherwise(""),
}


RULES = [
    Rule("parse-failed", "attention", lambda: c("status") == "failed", title="The file could not be read", detail="Sample rate, channels or coding could not be established."),
    Rule("parse-partial", "attention", lambda: c("status") == "partial", title="The file could be read in part", detail="Some of it could not be interpreted, so figures may be missing."),
    Rule("parse-warnings", "notice", lambda: F.size("warnings") > 0, each=lambda: c("warnings"), title="Note on the file's structure", detail="{each}"),
    Rule("data-truncated", "attention", lambda: c("shortfall") > 0, title="Audio data are shorter than stated", detail="{shortfall} bytes of the stated audio data are missing. Lengths describe what is there."),
    Rule("container-size-mismatch", "notice", lambda: (c("size_matches") == F.lit(False)) & c("declared_size").isNotNull(), title="Stated size and file size differ", detail="The header states {declared_size} bytes, which is {size_gap} off."),
    Rule("sample-rate-nonstandard", "notice", lambda: _known("sample_rate") & ~c("sample_rate").isin(*STANDARD_RATES), title="Sample rate {sample_rate} Hz", detail="{sample_rate} Hz is no rate in common use; the nearest is {nearest} Hz."),
    Rule("bit-depth-nonstandard", "notice", lambda: _known("bit_depth") & ~c("bit_depth").isin(*STANDARD_DEPTHS), title="Bit depth {bit_depth}", detail="{bit_depth} bits a sample are an uncommon width."),
    Rule("valid-bits-differ", "info", lambda: _known("valid_bits", "bit_depth") & (c("valid_bits") != c("bit_depth")), title="{valid_bits} bits of audio in {bit_depth}", detail="Samples have {bit_depth} bits, of which {valid_bits} are stated to be audio."),
    Rule("channel-count-unusual", "notice", lambda: (c("channels") > 2) & ~c("channels").isin(4, 6, 8), title="{channels} channels", detail="{channels} channels are none of the common layouts."),
    Rule("channel-mask-disagrees", "notice", lambda: _known("mask_channels", "channels") & (c("mask_channels") != c("channels")), title="Channels and speaker mask differ", detail="There are {channels} channels, but the speaker mask names {mask_channels}."),
    Rule("channel-mask-undefined-bits", "info", lambda: c("undefined_bits"), title="Speaker mask with undefined positions", detail="The mask sets bits that stand for no speaker."),
    Rule("byte-rate-inconsistent", "notice", lambda: c("codec_family").isin("pcm-int", "pcm-float") & _known("byte_rate", "sample_rate", "block_align") & (c("byte_rate") != c("sample_rate") * c("block_align")), title="Header figures disagree", detail="{byte_rate} bytes a second are stated; rate and block size give {expected_rate}."),
    Rule("duration-very-short", "notice", lambda: c("seconds") < SHORT, name=lambda: F.when(c("seconds") == 0, "duration-zero").otherwise("duration-very-short"), title="{seconds_text} seconds long", detail="The file holds {seconds_text} seconds of audio."),
    Rule("duration-inexact", "info", lambda: (c("exact") == F.lit(False)) & c("seconds").isNotNull(), title="Length is approximate", detail="The audio data are not whole frames, or part of them is missing."),
    Rule("samples-not-finite", "attention", lambda: c("measured") & (c("non_finite") > 0), title="{non_finite} samples are no numbers", detail="{non_finite} samples are not finite; levels describe the others."),
    Rule("digital-silence", "attention", lambda: _levels() & c("digital_silence"), title="The file is silent", detail="Every sample that was measured is zero."),
    Rule("channel-silence", "attention", _some_silent, title="{silent_channels} of {all_channels} channels silent", detail="{silent_channels} of {all_channels} channels hold zeros alone."),
    Rule("full-scale-run", "attention", lambda: _heard() & (c("longest_run") >= RUN) & ~((c("source") == "decoded") & (c("peak") > 1)), title="Flat peaks at full scale", detail="Up to {longest_run} samples in a row stand at full scale."),
    Rule("true-peak-over", "attention", lambda: finite(c("true_peak")) > 0, title="Peak of {true_peak_text} dBTP between samples", detail="The curve through the samples reaches {true_peak_text} dBTP; the samples reach {peak_text} dBFS."),
    Rule("peak-at-ceiling", "notice", lambda: _heard() & (c("longest_run") < RUN) & (c("peak_dbfs") >= NEAR), title="Peak at {peak_text} dBFS", detail="The loudest sample stands at {peak_text} dBFS, without a long run there."),
    Rule("float-above-full-scale", "notice", lambda: _levels() & (c("codec_family") == "pcm-float") & (c("peak") > 1), title="Peak of {peak_text} dBFS, above full scale", detail="A floating point file can hold such samples; whole numbers cannot."),
    Rule("level-very-low", "info", lambda: _heard() & (c("peak_dbfs") < VERY_LOW), title="Low peak of {peak_text} dBFS", detail="The loudest sample stands at {peak_text} dBFS, far below full scale."),
    Rule("dc-offset", "notice", lambda: _heard() & F.exists("dc_offsets", lambda d: F.abs(d) > OFFSET), title="Offset from zero", detail="{offsets} of full scale."),
    Rule("decoded-above-full-scale", "attention", lambda: _levels() & (c("source") == "decoded") & ~c("lossless") & (c("peak") > 1), title="Decoded peak of {peak_text} dBFS, above full scale", detail="Decoded, the file goes to {peak_text} dBFS, which a lossy coding does not show in its header."),
    Rule("decoded-measurement-note", "info", lambda: c("measured") & (c("source") == "decoded"), name=lambda: F.when(F.abs(c("seconds") - c("decoded_seconds")) > DRIFT, "decoded-length-differs").otherwise("decoded-measurement-note"), title="Levels of the decoded audio", detail="Levels describe what a decoder makes of the file.{drift_text}"),
    Rule("partial-scan", "info", lambda: c("measured") & ~c("complete"), title="Levels of a part of the file", detail="Levels come from sections spread over the file; peaks between them are not seen."),
    Rule("provenance-manifest", "info", lambda: c("manifest"), title="The file has Content Credentials", detail="A signed manifest is embedded. Its signature is not checked here."),
    Rule("possible-ai-generated", "notice", lambda: c("origin_flag") != "none", title="Origin: {origin_flag}", detail="Metadata give reason to think that the audio was generated."),
    Rule("ai-assisted-processing", "info", lambda: F.size("tools") > 0, each=lambda: F.array_distinct("tools"), title="Metadata name {each}", detail="{each} processes audio that exists; it is not said to have made it."),
    Rule("not-measured", "info", lambda: ~c("measured"), title="Levels were not measured", detail="No samples could be read."),
]
_PLACES = re.compile(r"\{(\w+)\}")


def filled(template: str, each: Column) -> Column:
    """A template with its places filled; what is unknown there is a dash."""
    parts = []
    for i, part in enumerate(_PLACES.split(template)):
        if i % 2 == 0:
            parts.append(F.lit(part))
        else:
            value = each if part == "each" else FIGURES[part]() if part in FIGURES else c(part)
            parts.append(F.coalesce(value.cast("string"), F.lit(texts.UNKNOWN)))
    return F.concat(*parts)


def _severity(rule: Rule) -> Column:
    if rule.id == "possible-ai-generated":
        return F.when(c("origin_flag") == "declared", "attention").otherwise("notice")
    return F.lit(rule.severity) if isinstance(rule.severity, str) else rule.severity


def _entries(rule: Rule, number: int) -> Column:
    """The rule's observations: none, one, or one for each element."""

    def one(each: Column, nth: Column) -> Column:
        severity = _severity(rule)
        rank = F.when(severity == "attention", 0).when(severity == "notice", 1).otherwise(2)
        return F.struct(rank.alias("rank"), F.lit(number).alias("rule_ord"), nth.alias("nth"), F.lit(rule.id).alias("rule_id"), (rule.name() if rule.name else F.lit(rule.id)).alias("obs_id"), severity.alias("severity"), filled(rule.title, each).alias("title"), filled(rule.detail, each).alias("detail"))

    nothing = F.lit(None).cast("string")
    found = F.transform(rule.each(), lambda d, i: one(d.cast("string"), i)) if rule.each else F.array(one(nothing, F.lit(0)))
    return F.when(rule.when(), found)


def broken(reports: DataFrame, rules: list[Rule], tried: bool = False) -> dict[str, str]:
    """Rules that cannot run on these reports, each with the reason: those that the plan refuses (a column that is not there, a type that does not fit), and, if they are to be tried, those whose
    own pass over the reports fails. Each is looked at by itself."""
    out = {}
    for i, rule in enumerate(rules):
        try:
            own = reports.select(_entries(rule, i).alias("entries"))
            if tried:
                own.write.format("noop").mode("overwrite").save()
        except Exception as e:  # any failure of a rule is the rule's alone
            out[rule.id] = str(e).strip().split("\n")[0][:300]
    return out


def _unfinished(rule: Rule, number: int, reason: str) -> Column:
    """What is observed in place of a rule that cannot run."""
    detail = f"The check {rule.id} failed ({reason}). The rest of the report does not depend on it."
    said = Rule(rule.id, "notice", lambda: F.lit(True), each=lambda: F.array(F.lit(detail)), name=lambda: F.lit(f"rule-error:{rule.id}"), title="A check could not be completed", detail="{each}")
    return _entries(said, number)


def observe(reports: DataFrame, rules: list[Rule] | None = None, tried: bool = False) -> DataFrame:
    """Adds observations, sorted by severity; a predicate that is unknown observes nothing.

    A rule of one's own that cannot run costs no report: it gives one notice with the reason. What the plan refuses is found without a job; `tried` runs each own rule once
    over the reports beforehand, so that one that fails on some row is found as well."""
    listed = rules or RULES
    own = [r for r in listed if r not in RULES]
    failed = broken(reports, own, tried) if own else {}
    entries = [_unfinished(r, i, failed[r.id]) if r.id in failed else _entries(r, i) for i, r in enumerate(listed)]
    return reports.withColumn("observations", F.array_sort(F.flatten(F.filter(F.array(*entries), lambda e: e.isNotNull()))))


def severities(reports: DataFrame) -> DataFrame:
    """Adds the number of observations of each severity, the gravest, and a rank that sorts reports by what was found."""
    n = lambda name: F.size(F.filter("observations", lambda o: o["severity"] == name)).cast("long")
    out = reports.withColumns({name: n(name) for name in RANK})
    return out.withColumns({"top": F.when(F.size("observations") > 0, F.get("observations", F.lit(0))["severity"]), "findings_rank": c("attention") * 1000 + c("notice")})


def status(reports: DataFrame, errors: str = "errors") -> DataFrame:
    """Adds status: failed without rate, channels or codec; partial with errors, without length, or cut short; else ok."""
    failed = c("sample_rate").isNull() | c("channels").isNull() | c("codec").isNull()
    partial = (c(errors) > 0) | c("seconds").isNull() | c("truncated") | (c("shortfall") > 0)
    return reports.withColumn("status", F.when(failed, "failed").when(F.coalesce(partial, F.lit(False)), "partial").otherwise("ok"))


def nearest_rate(rate: Column) -> Column:
    """The standard rate next to a rate; the first of equals."""
    options = F.array(*(F.struct(F.abs(rate - r).alias("far"), F.lit(i).alias("i"), F.lit(r).alias("rate")) for i, r in enumerate(STANDARD_RATES)))
    return F.when(rate.isNotNull(), F.array_min(options)["rate"].cast("long"))
