"""Evidence of origin in free-text metadata: tools and phrases that fields name, how far they can be trusted, what they add up to.

Lists of names are fixed and small, so a field is matched by array expressions in place: no join, no shuffle, the first match wins by
position. Names match as whole words; `whole_words=False` matches them anywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions import shared


@dataclass(frozen=True)
class Tool:
    match: str
    name: str
    kind: str = "music"
    common: bool = False


# Tools that metadata may name, as (text, name, kind, whether the text is also an everyday word).
TOOLS = [
    Tool("suno", "Suno", "music"),
    Tool("udio", "Udio", "music"),
    Tool("riffusion", "Riffusion", "music"),
    Tool("boomy", "Boomy", "music", True),
    Tool("soundraw", "Soundraw", "music"),
    Tool("mubert", "Mubert", "music"),
    Tool("aiva", "AIVA", "music"),
    Tool("beatoven", "Beatoven", "music"),
    Tool("loudly", "Loudly", "music", True),
    Tool("stable audio", "Stable Audio", "music"),
    Tool("stableaudio", "Stable Audio", "music"),
    Tool("musicgen", "MusicGen", "model"),
    Tool("audiocraft", "AudioCraft", "model"),
    Tool("audiogen", "AudioGen", "model"),
    Tool("audioldm", "AudioLDM", "model"),
    Tool("musiclm", "MusicLM", "model"),
    Tool("jukebox", "Jukebox", "model", True),
    Tool("bark", "Bark", "model", True),
    Tool("elevenlabs", "ElevenLabs", "speech"),
    Tool("eleven_", "ElevenLabs", "speech"),
    Tool("play.ht", "PlayHT", "speech"),
    Tool("playht", "PlayHT", "speech"),
    Tool("resemble.ai", "Resemble AI", "speech"),
    Tool("murf.ai", "Murf", "speech"),
    Tool("wellsaid", "WellSaid", "speech"),
    Tool("descript overdub", "Descript Overdub", "speech"),
    Tool("tortoise-tts", "Tortoise TTS", "speech"),
    Tool("coqui", "Coqui TTS", "speech"),
    Tool("openai-tts", "OpenAI text-to-speech", "speech"),
    Tool("lalal.ai", "LALAL.AI", "separation"),
    Tool("izotope rx", "iZotope RX", "separation"),
    Tool("spleeter", "Spleeter", "separation"),
    Tool("demucs", "Demucs", "separation"),
    Tool("landr", "LANDR", "mastering"),
    Tool("cloudbounce", "CloudBounce", "mastering"),
    Tool("emastered", "eMastered", "mastering"),
]
GENERATIVE = ("music", "model", "speech")
# Words that attribute, and text that only generators write, with its weight.
AUTHORSHIP = ["made with", "made using", "made by", "created with", "created using", "created by", "generated with", "generated by", "produced with", "produced by", "written with", "composed with", "rendered with", "powered by"]
PHRASES = [("ai-generated", 2), ("ai generated", 2), ("generated by ai", 2), ("generated with ai", 2), ("text-to-music", 2), ("text-to-speech", 1), ("text to speech", 1), ("synthetic voice", 2), ("voice clone", 2), ("prompt:", 1), ("generated audio", 1)]
# Marks of a machine, a time stamp and a unique identifier (in either case).
TIME_STAMP = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
IDENTIFIER = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
STRONG, MODERATE, WEAK = 3, 2, 1


def _names(value: Column, match: str, whole_words: bool) -> Column:
    low = F.lower(value)
    if not whole_words or match.endswith("_"):
        return F.contains(low, F.lit(match))
    # the cheap test first, the word boundaries only where it holds
    return F.contains(low, F.lit(match)) & low.rlike(rf"(?<![a-z0-9_]){re.escape(match)}(?![a-z0-9_])")


def tools_named(value: Column, tools: list[Tool] = TOOLS, whole_words: bool = True) -> Column:
    """Array of (ord, name, kind, weight) of the tools that a field names, each name once, graded."""
    attributed = lambda t: F.exists(F.array(*map(F.lit, AUTHORSHIP)), lambda p: F.contains(F.lower(value), F.concat(p, F.lit(f" {t.match}"))))
    marked = value.rlike(TIME_STAMP) | value.rlike(IDENTIFIER)

    def entry(i: int, t: Tool) -> Column:
        weight = F.lit(STRONG)
        if t.common:
            author = attributed(t)
            weight = F.when(author & marked, STRONG).when(author | marked, MODERATE).otherwise(WEAK)
        return F.when(_names(value, t.match, whole_words), F.struct(F.lit(i).alias("ord"), F.lit(t.name).alias("name"), F.lit(t.kind).alias("kind"), weight.alias("weight")))

    found = F.filter(F.array(*(entry(i, t) for i, t in enumerate(tools))), lambda x: x.isNotNull())
    return F.filter(found, lambda x, i: ~F.exists(F.slice(found, 1, i), lambda y: y["name"] == x["name"]))


def phrases_found(value: Column, phrases: list[tuple[str, int]] = PHRASES) -> Column:
    """Array of (ord, phrase, weight)."""
    entries = (F.when(F.contains(F.lower(value), F.lit(p)), F.struct(F.lit(i).alias("ord"), F.lit(p).alias("phrase"), F.lit(w).alias("weight"))) for i, (p, w) in enumerate(phrases))
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


# The fields that say what made a file, in the order in which they are read (label, scheme, key).
ORIGIN_FIELDS = [
    ("Encoder settings (ID3 TSSE)", "id3v2", "TSSE"),
    ("Encoded by (ID3 TENC)", "id3v2", "TENC"),
    ("Comment (ID3)", "id3v2", "COMM"),
    ("User text (ID3 TXXX)", "id3v2", "TXXX"),
    ("ID3v1 comment", "id3v1", "comment"),
    ("Encoder (MP4 ©too)", "itunes", "©too"),
    ("Encoded by (MP4 ©enc)", "itunes", "©enc"),
    ("Comment (MP4)", "itunes", "©cmt"),
    ("Description (MP4)", "itunes", "desc"),
    ("Encoder (Vorbis ENCODER)", "vorbis", "ENCODER"),
    ("Encoder vendor", "vorbis", "VENDOR"),
    ("Software (Vorbis)", "vorbis", "SOFTWARE"),
    ("Comment (Vorbis)", "vorbis", "COMMENT"),
    ("Description (Vorbis)", "vorbis", "DESCRIPTION"),
    ("Software (INFO ISFT)", "info", "ISFT"),
    ("Comment (INFO ICMT)", "info", "ICMT"),
    ("Technician (INFO ITCH)", "info", "ITCH"),
    ("BWF originator", "bext", "originator"),
    ("BWF coding history", "bext", "coding_history"),
    ("BWF description", "bext", "description"),
    ("iXML note", "ixml", "NOTE"),
    ("AIFF annotation", "aiff", "ANNO"),
    ("CAF encoder", "caf", "encoder"),
    ("LAME encoder", "lame", "encoder"),
    ("Encoder", "format", "encoder"),
]


def origin_fields(tags: DataFrame) -> DataFrame:
    """report_id, ord, label and value of the fields that say what made a file, from tags (report_id, scheme, ord, key, value). Of a repeated ID3 frame the last
    counts, of others the first; blank ones are left out; a note of iXML is taken out of its text."""
    spark = tags.sparkSession
    listed = spark.createDataFrame([(i, *x) for i, x in enumerate(ORIGIN_FIELDS)], "field_ord int, label string, scheme string, key string")
    note = F.regexp_extract("value", r"(?is)<NOTE>(.*?)</NOTE>", 1)
    keyed = tags.withColumns({"value": F.trim(F.when(F.col("scheme") == "ixml", note).otherwise(F.col("value"))), "key": F.when(F.col("scheme") == "ixml", "NOTE").when(F.col("key").startswith("TXXX:"), "TXXX").otherwise(F.col("key"))})
    met = keyed.where("value <> ''").join(F.broadcast(listed), ["scheme", "key"])
    value = F.when(F.first("scheme") == "id3v2", F.max_by("value", "ord")).otherwise(F.min_by("value", "ord"))
    return met.groupBy("report_id", F.col("field_ord").alias("ord"), "label").agg(value.alias("value"))


def assess_files(fields: DataFrame, tools: list[Tool] = TOOLS, phrases: list[tuple[str, int]] = PHRASES) -> DataFrame:
    """For each file with origin fields: the tools named (each once, by its strongest mention, in the order of fields), the phrases, flag, weight of the strongest reason
    and a sentence. A file's few fields are matched where they stand, then combined by one aggregation."""
    common = [t.name for t in tools if t.common]
    rows = fields.withColumns({"t": tools_named(F.col("value"), tools), "p": phrases_found(F.col("value"), phrases)})
    named = rows.select("report_id", F.col("ord").alias("field_ord"), F.explode_outer("t").alias("t"))
    per_tool = named.groupBy("report_id", F.col("t.name").alias("name"), F.col("t.kind").alias("kind")).agg(F.min(F.struct("field_ord", "t.ord")).alias("first"), F.max("t.weight").alias("weight"))
    generator = F.col("kind").isin(*GENERATIVE)
    made = per_tool.groupBy("report_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("first", "name")))), lambda x: x["name"]).alias("tools"),
        F.max(F.when(generator, F.col("weight"))).alias("tool_weight"), F.coalesce(F.bool_or(generator & ~F.col("name").isin(*common)), F.lit(False)).alias("declared"),
    )
    said = rows.select("report_id", F.explode_outer("p").alias("p")).groupBy("report_id").agg(F.max("p.weight").alias("phrase_weight"), F.countDistinct("p.phrase").alias("phrases"))
    out = made.join(said, "report_id")
    weight = F.greatest("tool_weight", "phrase_weight")
    flag = F.when(F.col("declared"), "declared").when(weight.isNotNull(), "possible").otherwise("none")
    sentence = F.when(F.size("tools") > 0, F.concat(F.lit("Names "), F.array_join("tools", ", "), F.lit(" in its metadata"))).otherwise("Records what made it, and none of the known tools")
    return out.select("report_id", "tools", "phrases", flag.alias("flag"), weight.alias("weight"), sentence.alias("summary"))


# Kinds of source that a manifest's claims name and that mean generation, with the strength of that.
GENERATED = [("trainedalgorithmicmedia", STRONG), ("compositewithtrainedalgorithmicmedia", STRONG), ("algorithmicmedia", MODERATE)]


def manifests(tags: DataFrame) -> DataFrame:
    """For each file with a provenance manifest: the most specific kinds of source that it claims, whether one of them means generation, and what made the claim."""
    own = tags.where("scheme = 'c2pa'")
    kinds = F.array_sort(F.collect_set(F.when(F.col("key") == "source_type", F.col("value"))))
    out = own.groupBy("report_id").agg(kinds.alias("kinds"), F.min(F.when(F.col("key") == "generator", F.col("value"))).alias("generator"), F.min(F.when(F.col("key") == "evidence", F.col("value"))).alias("evidence"))
    out = out.withColumn("kinds", most_specific(F.col("kinds")))
    return out.withColumn("generative", F.arrays_overlap("kinds", F.array(*(F.lit(k) for k, _ in GENERATED))))


def most_specific(terms: Column) -> Column:
    """The terms that no other term contains."""
    return F.filter(terms, lambda t: ~F.exists(terms, lambda o: (F.length(o) > F.length(t)) & F.contains(o, t)))


def assess(df: DataFrame, value: str, tools: list[Tool] = TOOLS, phrases: list[tuple[str, int]] = PHRASES) -> DataFrame:
    """Adds tools, phrases, flag (none, possible, declared), weight of the strongest reason, and outcome."""
    common = [t.name for t in tools if t.common]
    out = df.withColumns({"tools": tools_named(F.col(value), tools), "phrases": phrases_found(F.col(value), phrases)})
    made = F.filter("tools", lambda t: t["kind"].isin(*GENERATIVE))
    declared = F.exists(made, lambda t: ~t["name"].isin(*common)) if common else F.size(made) > 0
    weight = F.array_max(F.concat(F.transform(made, lambda t: t["weight"]), F.transform("phrases", lambda p: p["weight"])))
    flag = F.when(declared, "declared").when(weight.isNotNull(), "possible").otherwise("none")
    outcome = F.when(F.size("tools") > 0, "tool-named").when(F.trim(F.coalesce(F.col(value), F.lit(""))) == "", "nothing-recorded").otherwise("no-known-tool")
    return out.withColumns({"flag": flag, "weight": weight, "outcome": outcome})


# The words for the strength of reasons, from none on.
WEIGHTS = ["none", "weak", "moderate", "strong"]


def origins(tags: DataFrame, tools: list[Tool] = TOOLS, phrases: list[tuple[str, int]] = PHRASES) -> DataFrame:
    """For each file with any sign of what made it: origin_flag (none, possible, declared), origin_confidence, origin_headline, origin_reasons (the strongest kinds of evidence first: the manifest's claims,
    then tools, then phrases, in the order of fields), processing (tools named that process audio), tools_named (all), outcome, and manifest.

    A manifest's claim of generation and the name of a generator that is no everyday word settle it; all else is possible at most."""
    common = [t.name for t in tools if t.common]
    # a few short fields a file, matched once and read by all that follows
    rows = shared.stored(origin_fields(tags).withColumns({"t": tools_named(F.col("value"), tools), "p": phrases_found(F.col("value"), phrases)}), "origin-fields")
    mention = F.struct(F.col("ord").alias("field"), F.col("t.ord").alias("tool"))
    named = rows.select("report_id", "ord", "label", F.explode("t").alias("t")).groupBy("report_id", F.col("t.name").alias("name"), F.col("t.kind").alias("kind"))
    named = named.agg(F.min(mention).alias("first"), F.max("t.weight").alias("weight"), F.min_by("label", mention).alias("label"))
    generator = F.col("kind").isin(*GENERATIVE)
    tool_text = F.when(F.col("weight") == WEAK, F.concat("label", F.lit(" has the word "), "name")).otherwise(F.concat("label", F.lit(" names "), "name"))
    reason = lambda rank, a, b, weight, text: F.struct(F.lit(rank).alias("rank"), a.cast("int").alias("a"), b.cast("int").alias("b"), weight.cast("int").alias("weight"), text.alias("text"))
    of_tools = named.where(generator).select("report_id", reason(1, F.col("first.field"), F.col("first.tool"), F.col("weight"), tool_text).alias("r"), (~F.col("name").isin(*common)).alias("settled"), "name")
    said = rows.select("report_id", "ord", "label", F.explode("p").alias("p")).groupBy("report_id", "p.ord", "p.phrase", "p.weight").agg(F.min("ord").alias("field"), F.min_by("label", rows["ord"]).alias("label"))
    of_phrases = said.select("report_id", reason(2, F.col("field"), F.col("ord"), F.col("weight"), F.concat("label", F.lit(" says '"), "phrase", F.lit("'"))).alias("r"), F.lit(False).alias("settled"), F.lit(None).cast("string").alias("name"))
    m = manifests(tags)
    strength = F.create_map(*(F.lit(x) for pair in GENERATED for x in pair))
    claims = m.where("generative").select("report_id", F.posexplode(F.filter("kinds", lambda k: k.isin(*(k for k, _ in GENERATED)))).alias("i", "k"))
    of_claims = claims.select("report_id", reason(0, F.lit(0), F.col("i"), F.try_element_at(strength, F.col("k")), F.concat(F.lit("Content Credentials claim "), "k")).alias("r"), F.lit(True).alias("settled"), F.lit("").alias("name"))
    by = m.where("generative AND generator IS NOT NULL").select("report_id", reason(0, F.lit(1), F.lit(0), F.lit(MODERATE), F.concat(F.lit("Content Credentials name "), "generator")).alias("r"), F.lit(True).alias("settled"), F.lit("").alias("name"))
    silent = m.where("NOT coalesce(generative, false)").select("report_id", reason(0, F.lit(0), F.lit(0), F.lit(WEAK), F.lit("Content Credentials are there and claim no generation")).alias("r"), F.lit(False).alias("settled"), F.lit(None).cast("string").alias("name"))
    reasons = of_claims.unionByName(by).unionByName(silent).unionByName(of_tools).unionByName(of_phrases)
    sums = reasons.groupBy("report_id").agg(
        F.array_sort(F.collect_list("r")).alias("r"), F.max("r.weight").alias("weight"), F.bool_or("settled").alias("settled"), F.bool_or(F.expr("name = '' AND settled")).alias("claimed"),
        F.min_by("name", F.when(F.col("settled") & (F.col("name") != ""), F.struct("r.a", "r.b"))).alias("by"),
    )
    listed = named.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("tools_named"), F.transform(F.array_sort(F.collect_list(F.when(~generator, F.struct("first", "name")))), lambda x: x["name"]).alias("processing"))
    all_ = rows.select("report_id").union(m.select("report_id")).distinct()
    out = all_.join(sums, "report_id", "left").join(listed, "report_id", "left").join(m.select("report_id", F.lit(True).alias("manifest")), "report_id", "left")
    c, none = F.col, F.array().cast("array<string>")
    flag = F.when(c("weight").isNull(), "none").when(c("settled"), "declared").otherwise("possible")
    word = F.get(F.array(*map(F.lit, WEIGHTS)), c("weight"))
    headline = F.when(c("weight").isNull(), "No signs of generation in the metadata").when(c("claimed"), "The file declares that it was generated").when(c("settled"), F.concat(F.lit("The file says that it was made with "), c("by")))
    headline = F.coalesce(headline, F.when(c("weight") == STRONG, "Strong signs of generation").when(c("weight") == MODERATE, "Possibly generated").otherwise("Faint signs of generation"))
    outcome = F.when(c("manifest"), "manifest").when(F.size("tools_named") > 0, "tool-named").otherwise("no-known-tool")
    return out.select(
        "report_id", flag.alias("origin_flag"), F.when(c("settled"), "declared by the file").otherwise(F.when(c("weight").isNotNull(), word)).alias("origin_confidence"), headline.alias("origin_headline"),
        F.coalesce(F.transform("r", lambda x: x["text"]), none).alias("origin_reasons"), F.coalesce("processing", none).alias("processing"), F.coalesce("tools_named", none).alias("tools_named"), outcome.alias("outcome"), F.coalesce("manifest", F.lit(False)).alias("manifest"),
    )


def summary_line(outcome: Column, tools: Column) -> Column:
    """One line on what a file says of what made it."""
    named = F.concat(F.lit("Names "), F.array_join(tools, ", "), F.lit(" in its metadata"))
    return F.when(outcome == "manifest", "Has a Content Credentials manifest (signature not checked)").when(outcome == "tool-named", named).when(outcome == "no-known-tool", "Records what made it, and none of the known tools").otherwise("Records nothing of what made it")
