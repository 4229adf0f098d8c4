"""Figures, names and cells as they are shown or stored; NULL is a dash where something is shown and stays NULL where something is stored."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from auricle.functions.texts import UNKNOWN

# Speaker positions by bit of a channel mask, and layouts that a number of channels implies.
SPEAKERS = ["FL", "FR", "FC", "LFE", "BL", "BR", "FLC", "FRC", "BC", "SL", "SR", "TC", "TFL", "TFC", "TFR", "TBL", "TBC", "TBR"]
IMPLIED = {1: ["FC"], 2: ["FL", "FR"], 4: ["FL", "FR", "BL", "BR"], 6: ["FL", "FR", "FC", "LFE", "BL", "BR"], 8: ["FL", "FR", "FC", "LFE", "BL", "BR", "SL", "SR"]}
# Names of the major and minor keys by pitch class, and sharps (positive) or flats of the major ones.
MAJOR_NAMES = ["C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
MINOR_NAMES = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "G#", "A", "Bb", "B"]
SIGNATURES = [0, -5, 2, -3, 4, -1, 6, 1, -4, 3, -2, 5]
#: Seconds from 1904 to 1970.
MAC_EPOCH = 2082844800


def or_dash(text: Column) -> Column:
    return F.coalesce(text, F.lit(UNKNOWN))


def grouped(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n, 0)


def exact_bytes(n: Column) -> Column:
    return or_dash(F.concat(grouped(n), F.lit(" bytes")))


def rate(hz: Column) -> Column:
    """Kilohertz without needless zeros."""
    khz = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", hz / 1000), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return or_dash(F.when(hz.isNotNull(), F.concat(khz, F.lit(" kHz"))))


def depth(bits: Column, is_float: Column) -> Column:
    return or_dash(F.concat(bits.cast("string"), F.lit("-bit"), F.when(is_float, " float").otherwise("")))


def channel_count(n: Column) -> Column:
    named = F.when(n == 1, "mono").when(n == 2, "stereo").otherwise(F.concat(n.cast("string"), F.lit(" channels")))
    return or_dash(F.when(n.isNotNull(), named))


def share(x: Column) -> Column:
    """A share of full scale as a percentage."""
    return or_dash(F.when(x.isNotNull(), F.concat(F.format_string("%.4f", x * 100), F.lit(" %"))))


def speakers(mask: Column, channels: Column) -> Column:
    """Names of a mask's positions; without a mask, those that the number of channels implies, if any."""
    named = F.filter(F.array(*(F.when(mask.bitwiseAND(1 << i) != 0, s) for i, s in enumerate(SPEAKERS))), lambda s: s.isNotNull())
    implied = F.create_map(*(x for n, names in IMPLIED.items() for x in (F.lit(n), F.array(*map(F.lit, names)))))
    return F.when(mask > 0, named).otherwise(F.try_element_at(implied, channels.cast("int")))


def undefined_positions(mask: Column) -> Column:
    """How many bits of a mask stand for no speaker."""
    return F.bit_count(mask.bitwiseAND(~((1 << len(SPEAKERS)) - 1) & 0xFFFFFFFF)).cast("long")


def mac_date(seconds: Column) -> Column:
    """A time since 1904 in ISO form; zero is unknown."""
    return F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds - MAC_EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def gapless(text: Column) -> Column:
    """Start delay, padding and samples of a gapless comment: hexadecimal numbers after a first one; NULL if there are fewer than four."""
    parts = F.split(F.trim(text), r"\s+")
    number = lambda i: F.conv(F.get(parts, F.lit(i)), 16, 10).cast("long")
    return F.when(F.size(parts) >= 4, F.struct(number(1).alias("delay"), number(2).alias("padding"), number(3).alias("samples")))


def file_name(name: Column, limit: int = 80) -> Column:
    """A name that any file system takes: letters, digits and -_. of ASCII, runs of others as one dash, without outer dashes and dots."""
    plain = F.regexp_replace(F.translate(name, "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñ", "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNn"), r"[^A-Za-z0-9._-]+", "-")
    kept = F.substring(F.regexp_replace(plain, r"^[-.]+|[-.]+$", ""), 1, limit)
    return F.when(F.length(kept) > 0, kept).otherwise("untitled")


def wrapped(text: Column, width: int) -> Column:
    """Lines of words of at most a width; longer words stand alone. One walk over the words, whatever the length of the text."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        out = []
        for value in values.to_pylist():
            lines, used = [], 0
            for word in (value or "").split(" "):
                if not word:
                    continue
                if lines and used + 1 + len(word) <= width:
                    lines[-1].append(word)
                    used += 1 + len(word)
                else:
                    lines.append([word])
                    used = len(word)
            out.append(None if value is None else "\n".join(map(" ".join, lines)))
        return pa.array(out, pa.string())

    return run(text)


def cell(text: Column, width: int) -> Column:
    """Text of exactly a width: cut with an ellipsis, or filled with blanks."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(F.rpad(text, width, " "))


def tagged_number(x: Column) -> Column:
    """A number as JSON, with those that JSON cannot write as text in an object."""
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
    return F.when(special.isNotNull(), F.concat(F.lit('{"$number":"'), special, F.lit('"}'))).when(x.isNull(), "null").otherwise(F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6))


def untagged_number(json: Column) -> Column:
    special = F.get_json_object(json, "$.$number")
    special = F.coalesce(special, F.nullif(F.regexp_extract(json, r'^\{"\$number":"([^"]*)"\}$', 1), F.lit("")))
    return F.coalesce(special, json).try_cast("double")


def decoded_bytes(seconds: Column, rate_: Column, channels: Column) -> Column:
    """What decoded audio of 32-bit samples would take; NULL if anything is unknown."""
    return F.floor(seconds * rate_ * channels * 4 + 0.5).cast("long")


def origin_cell(flag: Column, manifest: Column, tools: Column) -> Column:
    """What a list says of a file's origin: declared before credentials before possible; nothing found is blank."""
    return F.when(flag == "declared", F.concat(F.lit("declared: "), F.array_join(tools, ", "))).when(manifest, "credentials").when(flag == "possible", "possible").otherwise("")


def key_name(pitch_class: Column, minor: Column) -> Column:
    of = lambda names: F.get(F.array(*map(F.lit, names)), pitch_class.cast("int"))
    return F.when(minor, F.concat(of(MINOR_NAMES), F.lit(" minor"))).otherwise(F.concat(of(MAJOR_NAMES), F.lit(" major")))


def key_signature(pitch_class: Column, minor: Column) -> Column:
    """Sharps or flats of a key; a minor key has those of the major one three steps above."""
    n = F.get(F.array(*map(F.lit, SIGNATURES)), F.pmod(pitch_class + F.when(minor, 3).otherwise(0), F.lit(12)).cast("int"))
    count = lambda word: F.concat(F.abs(n).cast("string"), F.lit(f" {word}"), F.when(F.abs(n) == 1, "").otherwise("s"))
    return F.when(n == 0, "no sharps or flats").when(n > 0, count("sharp")).otherwise(count("flat"))
