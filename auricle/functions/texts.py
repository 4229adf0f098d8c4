"""Column expressions over metadata text: identifiers, tempo fields, tags, figures for display, table cells, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "—"


def isrc(raw: Column) -> Column:
    """The twelve characters of a valid recording code, else NULL."""
    clean = F.upper(F.trim(raw))
    parts = r"^([A-Z]{2})[- ]?([A-Z0-9]{3})[- ]?([0-9]{2})[- ]?([0-9]{5})$"
    return F.when(clean.rlike(parts), F.regexp_replace(clean, "[- ]", ""))


def isrc_for_display(code: Column) -> Column:
    return F.concat_ws("-", F.substring(code, 1, 2), F.substring(code, 3, 3), F.substring(code, 6, 2), F.substring(code, 8, 5))


def stated_bpm(raw: Column) -> Column:
    """The leading number of a field if it can be a tempo (20 to 400)."""
    n = F.regexp_extract(F.trim(raw), r"^[-+]?(\d+\.?\d*|\.\d+)", 0).try_cast("double")
    return F.when(n.between(20, 400), n)


def any_tag(id3: Column, itunes: Column, vorbis: Column, fallback: Column) -> Column:
    """The first scheme that says something; repeated comments are joined."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(some(id3), some(itunes), some(F.array_join(vorbis, "; ")), some(fallback))


def duration(seconds: Column) -> Column:
    """h:mm:ss.mmm, without hours below one; a thousandth that rounds up to a second stays 999."""
    s = F.abs(seconds)
    ms = F.least(F.floor((s - F.floor(s)) * 1000 + 0.5), F.lit(999))
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), F.floor(s % 60)
    text = F.when(h > 0, F.format_string("%d:%02d:%02d.%03d", h, m, sec, ms)).otherwise(F.format_string("%d:%02d.%03d", m, sec, ms))
    return F.when(seconds.isNull(), UNKNOWN).otherwise(F.concat(F.when(seconds < 0, "-").otherwise(""), text))


def short_bytes(n: Column) -> Column:
    def scaled(power: int, unit: str) -> Column:
        v = n / float(1024**power)
        return F.when(v >= 100, F.format_string("%.0f " + unit, v)).otherwise(F.format_string("%.1f " + unit, v))

    steps = F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).when(n < 1024**4, scaled(3, "GB"))
    return F.when(n.isNull(), UNKNOWN).otherwise(steps.otherwise(scaled(4, "TB")))


def timecode(samples: Column, rate: Column) -> Column:
    """hh:mm:ss.mmm since midnight of a sample count; NULL without a rate."""
    ms = F.floor(F.try_divide(samples * 1000, rate))
    return F.when(rate > 0, F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000))


def signed_db(db: Column, digits: int = 1) -> Column:
    text = F.format_string(f"%.{digits}f", db)
    return F.when(db.isNull() | F.isnan(db), UNKNOWN).when(db == float("-inf"), "-∞").when(db > 0, F.concat(F.lit("+"), text)).otherwise(text)


def guarded(cell: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe; plain numbers do not."""
    risky = cell.rlike(r"^[=+\-@\t\r]") & ~cell.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    return F.when(risky, F.concat(F.lit("'"), cell)).otherwise(cell)


def csv_cell(cell: Column) -> Column:
    """RFC 4180: NULL is empty; quotes where there are commas, quotes or line ends."""
    g = guarded(F.coalesce(cell, F.lit("")))
    return F.when(g.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(g, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(g)


def glossary_term(raw: Column) -> Column:
    """Lower case, without brackets' contents and punctuation, single blanks."""
    out = F.regexp_replace(F.lower(raw), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[:?.,]", ""), r"[ \t\n\r]+", " "))


def element(xml: Column, tag: str) -> Column:
    """The text of the first element of a name, unescaped (the ampersand last); NULL without one."""
    found = F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return unescaped(F.get(found, F.lit(0)))


def unescaped(text: Column) -> Column:
    # The five entities of XML, the ampersand last.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def file_kind(head: Column) -> Column:
    """Container family by the first bytes (binary), in the order in which readers are asked; NULL if none knows it."""
    four, kind = F.substring(head, 1, 4), F.substring(head, 9, 4)
    is_ = lambda col, *texts: col.isin(*[bytes(t, "latin-1") for t in texts])
    second = F.conv(F.hex(F.substring(head, 2, 1)), 16, 10).cast("int")
    sync = (F.hex(F.substring(head, 1, 1)) == "FF") & (second >= 0xE0)
    return (
        F.when(is_(four, "RIFF", "RF64", "BW64", "RIFX") & is_(kind, "WAVE"), "wav")
        .when(is_(four, "FORM") & is_(kind, "AIFF", "AIFC"), "aiff")
        .when(is_(F.substring(head, 5, 4), "ftyp", "moov", "mdat"), "mp4")
        .when(is_(four, "fLaC"), "flac")
        .when(is_(four, "caff"), "caf")
        .when(is_(four, "OggS"), "ogg")
        .when(is_(F.substring(head, 1, 3), "ID3") | sync, "mp3")
    )
