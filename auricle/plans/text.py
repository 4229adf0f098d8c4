"""Queries over text: documents as free-text metadata, pages as markup, parts as identifiers, conversations as markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from auricle.functions import texts
from auricle.operators import provenance
from auricle.operators.provenance import Tool

c = F.col
#: Words of the corpus stand for tools here: the real names hardly occur in it.
STAND_INS = [Tool("stupid", "Alpha"), Tool("idiot", "Alpha"), Tool("trash", "Beta", "model", True), Tool("license", "Gamma", "mastering"), Tool("scum", "Delta", "speech")]
STAND_IN_PHRASES = [("released under", 2), ("licensed under", 1), ("of the", 1)]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), c("p_size").cast("long").alias("s"))
    five, two = F.lpad((c("k") % 100000).cast("string"), 5, "0"), F.lpad(c("s").cast("string"), 2, "0")
    forms = [F.concat(F.lit("us-s1z-"), two, F.lit("-"), five), F.concat(F.lit(" GBAYE"), two, five), F.concat(F.lit("FR Z03 "), two, F.lit(" "), five), F.concat(F.lit("DE-12-"), two, five), F.lit(None).cast("string")]
    return p.select("k", "s", F.get(F.array(*forms), (c("k") % 5).cast("int")).alias("raw"), F.get(F.array(*forms), ((c("k") + 1) % 5).cast("int")).alias("raw2"))


def isrc_normalise(spark, sf_dir):
    code = F.coalesce(texts.isrc(c("raw")), texts.isrc(c("raw2")))
    out = codes(spark, sf_dir).withColumn("code", code)
    return out.select("k", "code", F.when(c("code").isNotNull(), texts.isrc_for_display(c("code"))).alias("shown"))


def stated_tempo(spark, sf_dir):
    p = codes(spark, sf_dir)
    first = F.when(c("k") % 3 == 0, F.concat(F.lit("  "), (c("s") * 5).cast("string"), F.lit(" bpm")))
    second = F.when(c("k") % 4 > 0, F.concat((c("s") * 9).cast("string"), F.lit(".5")))
    p = p.withColumns({"a": texts.stated_bpm(first), "b": texts.stated_bpm(second), "d": texts.stated_bpm(F.lit("fast"))})
    return p.select("k", F.coalesce("d", "a", "b").alias("bpm"), F.when(c("a").isNotNull(), "first").when(c("b").isNotNull(), "second").alias("source"))


def tempo_disagreement(spark, sf_dir):
    """Noted where a stated tempo is further from a measured one than the larger of 1 and the resolution."""
    p = stated_tempo(spark, sf_dir).withColumns({"measured": F.when(c("k") % 6 > 0, c("bpm") + (c("k") % 5) - 2), "resolution": (c("k") % 4) * 0.5})
    return p.select("k", F.coalesce(F.abs(c("measured") - c("bpm")) > F.greatest(F.lit(1.0), "resolution"), F.lit(False)).alias("noted"))


def any_tag(spark, sf_dir):
    p = codes(spark, sf_dir)
    some = lambda m, name: F.when(c("k") % m == 0, F.concat(F.lit(name), c("s").cast("string"))).when(c("k") % m == 1, "")
    vorbis = F.when(c("k") % 5 == 0, F.array(F.lit("x"), c("s").cast("string"))).when(c("k") % 5 == 1, F.array(F.lit("one")))
    return p.select("k", texts.any_tag(some(4, "id3 "), some(3, "mp4 "), vorbis, some(2, "info ")).alias("tag"))


def tool_match(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(provenance.tools_named(c("text"), STAND_INS)).alias("t"))
    return d.select("doc_id", "t.name", "t.kind", c("t.weight").cast("long").alias("weight"))


def phrase_hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(provenance.phrases_found(c("text"), STAND_IN_PHRASES)).alias("p"))
    return d.select("doc_id", "p.phrase", c("p.weight").cast("long").alias("weight"))


def provenance_assess(spark, sf_dir):
    d = provenance.assess(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", STAND_INS, STAND_IN_PHRASES)
    return d.select("doc_id", F.size("tools").cast("long").alias("tools"), "flag", c("weight").cast("long").alias("weight"), "outcome")


def real_tools(spark, sf_dir):
    """Conversations that name one of the real tools or use one of the real phrases."""
    d = provenance.assess(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")
    return d.groupBy("flag", "outcome").agg(F.count("*").alias("turns"))


def planted(spark, sf_dir):
    """Documents whose whole text follows a remark that names one of the real tools, with or without attribution, time stamp and phrase."""
    names, phrases = [t.match.upper() for t in provenance.TOOLS], [p for p, _ in provenance.PHRASES]
    d, k = table(spark, sf_dir, "documents"), c("doc_id")
    name = F.when(k % 4 > 0, F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))).otherwise("nothing")
    remark = F.concat(F.when(k % 3 == 0, "Made with ").otherwise("About "), name, F.when(k % 5 == 0, " on 2024-01-02T03:04:05").when(k % 5 == 1, " id 0123ABCD-0123-4567-89ab-0123456789ab").otherwise(""))
    phrase = F.when(k % 7 == 0, F.concat(F.lit(", "), F.get(F.array(*map(F.lit, phrases)), (k % len(phrases)).cast("int")))).otherwise("")
    return d.select("doc_id", F.concat(remark, phrase, F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"))


def planted_tools(spark, sf_dir):
    d = planted(spark, sf_dir).select("doc_id", F.explode(provenance.tools_named(c("text"))).alias("t"))
    return d.select("doc_id", "t.name", "t.kind", c("t.weight").cast("long").alias("weight"))


def planted_origins(spark, sf_dir):
    d = provenance.assess(planted(spark, sf_dir), "text")
    return d.select("doc_id", F.size("tools").cast("long").alias("tools"), F.size("phrases").cast("long").alias("phrases"), "flag", c("weight").cast("long").alias("weight"), "outcome")


TERMS = ["the", "other", "er", "ere", "there", "an", "and"]


def most_specific_terms(spark, sf_dir):
    held = F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.lower("text"), t))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(provenance.most_specific(held)).alias("term"))


def markup_extract(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    links = F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long")
    return p.select("page_id", texts.element(c("html"), "title").alias("title"), links.alias("links"))


def glossary_terms(spark, sf_dir):
    """Terms of the parts' types, looked up in a glossary of the first of each."""
    p = table(spark, sf_dir, "part").select("p_partkey", texts.glossary_term(F.concat(c("p_type"), F.lit(" (Old):  "), c("p_brand"), F.lit("?"))).alias("term"))
    known = p.groupBy("term").agg(F.min("p_partkey").alias("entry")).where("entry % 2 = 0")
    return p.join(known, "term", "left").select("p_partkey", "term", "entry")


def marker_labels(spark, sf_dir):
    """Turns with the label of their marker, the last label of a marker winning; markers without one stay."""
    t = table(spark, sf_dir, "conversations")
    last = t.where("role = 'assistant'").groupBy("conv_id", (c("turn") % 3).alias("marker")).agg(F.max_by("turn", "turn").alias("label_turn"))
    out = t.withColumn("marker", c("turn") % 3).join(last, ["conv_id", "marker"], "left")
    return out.select("conv_id", "turn", "label_turn")


def csv_cells(spark, sf_dir):
    """Whole texts as cells, as they are and behind what a spreadsheet takes for a formula, and plain negative numbers."""
    d = table(spark, sf_dir, "documents")
    formula = F.concat(F.get(F.array(*map(F.lit, ["=", "+", "@", "\t", "-"])), (c("doc_id") % 5).cast("int")), "text")
    return d.select("doc_id", texts.csv_cell(c("text")).alias("cell"), texts.csv_cell(formula).alias("formula"), texts.csv_cell(F.concat(F.lit("-"), c("n_chars").cast("string"))).alias("number"))


def figures(spark, sf_dir):
    """Lengths, sizes, timecodes and levels as they are shown."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("s"), F.sum(F.round(c("l_quantity") * 37).cast("long")).alias("q"))
    bytes_ = F.when(c("l_orderkey") % 4 > 0, c("q") * c("q") * (c("l_orderkey") % 5 * 1000 + 1))
    level = F.when(c("l_orderkey") % 9 == 0, F.lit(float("-inf"))).when(c("l_orderkey") % 9 > 1, (c("q") % 400 - 300) / 8.0)
    return line.select("l_orderkey", texts.duration(F.when(c("l_orderkey") % 10 > 0, c("q") / 8.0)).alias("length"), texts.short_bytes(bytes_).alias("size"), texts.timecode(c("q") * 4800, F.when(c("l_orderkey") % 3 > 0, F.lit(48000))).alias("timecode"), texts.signed_db(level, 3).alias("level"))


SPEAKERS = ["FL", "FR", "FC", "LFE", "BL", "BR"]


def channel_mask_explode(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", c("p_size").cast("long").alias("mask"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: c("mask").bitwiseAND(F.pow(F.lit(2), i).cast("long")) > 0)
    return p.select("p_partkey", F.explode(bits).alias("bit")).select("p_partkey", c("bit").cast("long").alias("bit"), F.get(F.array(*map(F.lit, SPEAKERS)), c("bit")).alias("speaker"))


def sniff_priority(spark, sf_dir):
    """Kinds of files by their first bytes: pages' markup behind the heads of real containers."""
    heads = ["RIFF....WAVE", "FORM....AIFC", "....ftypM4A ", "fLaC", "caff", "OggS", "ID3", ""]
    p = table(spark, sf_dir, "pages").withColumn("head", F.encode(F.concat(F.get(F.array(*map(F.lit, heads)), (c("page_id") % 8).cast("int")), F.substring("html", 1, 40)), "UTF-8"))
    return p.select("page_id", texts.file_kind(c("head")).alias("kind"), F.hex(F.substring("head", 1, 8)).alias("first_bytes"))


def extension_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("name", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.get(F.array(*map(F.lit, ["", ".WAV", ".mp3", ".txt"])), (c("page_id") % 4).cast("int"))))
    wanted = F.lower("name").rlike(r"\.(wav|bwf|rf64|aif|aiff|aifc|mp4|m4a|flac|caf|ogg|oga|opus|mp3)$")
    return p.groupBy(wanted.alias("wanted")).agg(F.count("*").alias("files"), F.min("name").alias("first_name"))


def props_json(spark, sf_dir):
    """JSON properties of events by key: read with a fixed schema, so unknown keys cost nothing."""
    e = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return e.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.countDistinct("v").alias("values"))


QUERIES = {f.__name__: f for f in (
    isrc_normalise, stated_tempo, tempo_disagreement, any_tag, tool_match, phrase_hits, provenance_assess, real_tools, planted_tools, planted_origins, most_specific_terms, markup_extract, glossary_terms, marker_labels, csv_cells,
    figures, channel_mask_explode, sniff_priority, extension_filter, props_json)}

K_SQL = """k AS (SELECT p_partkey AS k, p_size::BIGINT AS s, lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS five, lpad(p_size::VARCHAR, 2, '0') AS two FROM part),
 f AS (SELECT *, ['us-s1z-' || two || '-' || five, ' GBAYE' || two || five, 'FR Z03 ' || two || ' ' || five, 'DE-12-' || two || five, NULL] AS forms FROM k)"""
ISRC_SQL = "CASE WHEN regexp_matches(upper(trim({0})), '^([A-Z]{{2}})[- ]?([A-Z0-9]{{3}})[- ]?([0-9]{{2}})[- ]?([0-9]{{5}})$') THEN regexp_replace(upper(trim({0})), '[- ]', '', 'g') END"
T_SQL = f"""{K_SQL}, t AS (SELECT k, CASE WHEN k % 3 = 0 AND s * 5 BETWEEN 20 AND 400 THEN (s * 5)::DOUBLE END AS a, CASE WHEN k % 4 > 0 AND s * 9 + 0.5 BETWEEN 20 AND 400 THEN s * 9 + 0.5::DOUBLE END AS b FROM k),
 st AS (SELECT k, coalesce(a, b)::DOUBLE AS bpm, CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' END AS source FROM t)"""
W = lambda w: f"regexp_matches(lower(text), '(^|[^a-z0-9_]){w}($|[^a-z0-9_])')"
_AUTHOR = " OR ".join(f"contains(lower(text), '{p} trash')" for p in provenance.AUTHORSHIP)
_MARK = r"regexp_matches(text, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}|(?i:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})')"
TM_SQL = f"""tm AS (SELECT doc_id, 'Alpha' AS name, 'music' AS kind, 3 AS weight FROM documents WHERE {W('stupid')} OR {W('idiot')}
 UNION ALL SELECT doc_id, 'Beta', 'model', CASE WHEN ({_AUTHOR}) AND {_MARK} THEN 3 WHEN ({_AUTHOR}) OR {_MARK} THEN 2 ELSE 1 END FROM documents WHERE {W('trash')}
 UNION ALL SELECT doc_id, 'Gamma', 'mastering', 3 FROM documents WHERE {W('license')} UNION ALL SELECT doc_id, 'Delta', 'speech', 3 FROM documents WHERE {W('scum')})"""
PH_SQL = "ph AS (" + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS phrase, {w} AS weight FROM documents WHERE contains(lower(text), '{p}')" for p, w in STAND_IN_PHRASES) + ")"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TOOLS_SQL = "tl(ord, match, name, kind, common) AS (VALUES " + ", ".join(f"({i}, {_lit(t.match)}, {_lit(t.name)}, '{t.kind}', {t.common})" for i, t in enumerate(provenance.TOOLS)) + ")"
_PHRASES_SQL = "pl(phrase, weight) AS (VALUES " + ", ".join(f"({_lit(p)}, {w})" for p, w in provenance.PHRASES) + ")"


def _assessed_sql(rows: str) -> str:
    """From r (id, text): the tools named in each, each name once, and what they add up to."""
    author = " OR ".join(f"contains(lower(text), '{p} ' || match)" for p in provenance.AUTHORSHIP)
    whole = "(match LIKE '%\\_' ESCAPE '\\' OR regexp_matches(lower(text), '(^|[^a-z0-9_])' || regexp_escape(match) || '($|[^a-z0-9_])'))"
    return f"""WITH {rows}, {_TOOLS_SQL}, {_PHRASES_SQL},
      hit AS (SELECT id, ord, name, kind, common, CASE WHEN NOT common THEN 3 WHEN ({author}) AND {_MARK} THEN 3 WHEN ({author}) OR {_MARK} THEN 2 ELSE 1 END AS weight FROM r JOIN tl ON contains(lower(text), match) AND {whole}),
      tm AS (SELECT id, name, arg_min(kind, ord) AS kind, arg_min(weight, ord) AS weight, bool_or(common) AS common FROM hit GROUP BY id, name),
      n AS (SELECT id, count(*) AS tools, max(weight) FILTER (kind IN ('music', 'model', 'speech')) AS w, bool_or(kind IN ('music', 'model', 'speech') AND NOT common) AS declared FROM tm GROUP BY 1),
      p AS (SELECT id, count(*) AS phrases, max(weight) AS w FROM r JOIN pl ON contains(lower(text), phrase) GROUP BY 1),
      a AS (SELECT r.id, coalesce(tools, 0) AS tools, coalesce(phrases, 0) AS phrases, CASE WHEN declared THEN 'declared' WHEN n.w IS NOT NULL OR p.w IS NOT NULL THEN 'possible' ELSE 'none' END AS flag, greatest(n.w, p.w) AS weight,
        CASE WHEN tools > 0 THEN 'tool-named' WHEN trim(coalesce(text, '')) = '' THEN 'nothing-recorded' ELSE 'no-known-tool' END AS outcome FROM r LEFT JOIN n USING (id) LEFT JOIN p USING (id))"""


_R_SQL = f"""r AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'Made with ' ELSE 'About ' END || CASE WHEN doc_id % 4 > 0 THEN ({[t.match.upper() for t in provenance.TOOLS]})[doc_id % {len(provenance.TOOLS)} + 1] ELSE 'nothing' END
  || CASE doc_id % 5 WHEN 0 THEN ' on 2024-01-02T03:04:05' WHEN 1 THEN ' id 0123ABCD-0123-4567-89ab-0123456789ab' ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN ', ' || ({[p for p, _ in provenance.PHRASES]})[doc_id % {len(provenance.PHRASES)} + 1] ELSE '' END || '. ' || coalesce(text, '') AS text FROM documents)"""
_KINDS = "CASE page_id % 8 WHEN 0 THEN 'wav' WHEN 1 THEN 'aiff' WHEN 2 THEN 'mp4' WHEN 3 THEN 'flac' WHEN 4 THEN 'caf' WHEN 5 THEN 'ogg' WHEN 6 THEN 'mp3' END"

ORACLE = {
    "real_tools": _assessed_sql("r AS (SELECT row_number() OVER () AS id, text FROM conversations)") + " SELECT flag, outcome, count(*) AS turns FROM a GROUP BY ALL",
    "planted_tools": _assessed_sql(_R_SQL) + " SELECT id AS doc_id, name, kind, weight FROM tm",
    "planted_origins": _assessed_sql(_R_SQL) + " SELECT id AS doc_id, tools, phrases, flag, weight, outcome FROM a",
    "isrc_normalise": f"WITH {K_SQL}, r AS (SELECT k, forms[k % 5 + 1] AS raw, forms[(k + 1) % 5 + 1] AS raw2 FROM f), d AS (SELECT k, coalesce({ISRC_SQL.format('raw')}, {ISRC_SQL.format('raw2')}) AS code FROM r) SELECT k, code, CASE WHEN code IS NOT NULL THEN code[1:2] || '-' || code[3:5] || '-' || code[6:7] || '-' || code[8:12] END AS shown FROM d",
    "stated_tempo": f"WITH {T_SQL} SELECT * FROM st",
    "tempo_disagreement": f"WITH {T_SQL} SELECT k, coalesce(CASE WHEN k % 6 > 0 THEN abs(k % 5 - 2) > greatest(1.0, (k % 4) * 0.5) AND bpm IS NOT NULL END, false) AS noted FROM st",
    "any_tag": f"""WITH {K_SQL} SELECT k, coalesce(CASE WHEN k % 4 = 0 THEN 'id3 ' || s END, CASE WHEN k % 3 = 0 THEN 'mp4 ' || s END, CASE WHEN k % 5 = 0 THEN 'x; ' || s WHEN k % 5 = 1 THEN 'one' END, CASE WHEN k % 2 = 0 THEN 'info ' || s END) AS tag FROM k""",
    "tool_match": f"WITH {TM_SQL} SELECT * FROM tm",
    "phrase_hits": f"WITH {PH_SQL} SELECT * FROM ph",
    "provenance_assess": f"""WITH {TM_SQL}, {PH_SQL}, n AS (SELECT doc_id, count(*) AS tools, bool_or(name IN ('Alpha', 'Delta')) AS declared, max(weight) FILTER (kind <> 'mastering') AS w FROM tm GROUP BY 1), p AS (SELECT doc_id, max(weight) AS w FROM ph GROUP BY 1)
      SELECT d.doc_id, coalesce(tools, 0) AS tools, CASE WHEN declared THEN 'declared' WHEN n.w IS NOT NULL OR p.w IS NOT NULL THEN 'possible' ELSE 'none' END AS flag, greatest(n.w, p.w) AS weight,
        CASE WHEN tools > 0 THEN 'tool-named' WHEN trim(coalesce(text, '')) = '' THEN 'nothing-recorded' ELSE 'no-known-tool' END AS outcome FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN p USING (doc_id)""",
    "most_specific_terms": f"WITH h AS (SELECT doc_id, term FROM documents, (SELECT unnest({TERMS}) AS term) WHERE contains(lower(text), term)) SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND length(o.term) > length(h.term) AND contains(o.term, h.term))",
    "markup_extract": r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title>', 1)[1] AS t, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links FROM pages)
      SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS title, links FROM t""",
    "glossary_terms": r"""WITH p AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_type || ' (Old):  ' || p_brand || '?'), '\([^)]*\)', ' ', 'g'), '[:?.,]', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS term FROM part),
      k AS (SELECT term, min(p_partkey) AS entry FROM p GROUP BY 1 HAVING entry % 2 = 0) SELECT p_partkey, term, entry FROM p LEFT JOIN k USING (term)""",
    "marker_labels": "WITH l AS (SELECT conv_id, turn % 3 AS marker, max(turn) AS label_turn FROM conversations WHERE role = 'assistant' GROUP BY ALL) SELECT t.conv_id, turn, label_turn FROM conversations t LEFT JOIN l ON l.conv_id = t.conv_id AND marker = turn % 3",
    "csv_cells": r"""WITH d AS (SELECT doc_id, unnest([0, 1, 2]) AS i, unnest([coalesce(text, ''), coalesce(['=', '+', '@', chr(9), '-'][doc_id % 5 + 1] || text, ''), '-' || n_chars]) AS s FROM documents),
      g AS (SELECT doc_id, i, CASE WHEN regexp_matches(s, '^[=+\-@\t\r]') AND NOT regexp_matches(s, '^-?\d+(\.\d+)?([eE][+-]?\d+)?$') THEN '''' || s ELSE s END AS s FROM d),
      q AS (SELECT doc_id, i, CASE WHEN regexp_matches(s, '[",\r\n]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS s FROM g)
      SELECT doc_id, min(s) FILTER (i = 0) AS cell, min(s) FILTER (i = 1) AS formula, min(s) FILTER (i = 2) AS number FROM q GROUP BY 1""",
    "figures": """WITH l AS (SELECT l_orderkey, sum(round(l_quantity * 37)::BIGINT)::BIGINT AS q FROM lineitem GROUP BY 1),
      v AS (SELECT *, CASE WHEN l_orderkey % 10 > 0 THEN q / 8.0::DOUBLE END AS d, CASE WHEN l_orderkey % 4 > 0 THEN q * q * (l_orderkey % 5 * 1000 + 1) END AS b, CASE WHEN l_orderkey % 9 > 1 THEN (q % 400 - 300) / 8.0::DOUBLE END AS db FROM l),
      m AS (SELECT *, least(floor((d - floor(d)) * 1000 + 0.5), 999)::INT AS ms, floor(d / 3600)::INT AS h, floor(d % 3600 / 60)::INT AS mi, floor(d % 60)::INT AS se, q * 100 AS tc FROM v)
      SELECT l_orderkey, CASE WHEN d IS NULL THEN '—' WHEN h > 0 THEN printf('%d:%02d:%02d.%03d', h, mi, se, ms) ELSE printf('%d:%02d.%03d', mi, se, ms) END AS length,
        CASE WHEN b IS NULL THEN '—' WHEN b < 1024 THEN printf('%d B', b) WHEN b < 1048576 THEN CASE WHEN b / 1024 >= 100 THEN printf('%.0f KB', b / 1024) ELSE printf('%.1f KB', b / 1024) END
          WHEN b < 1073741824 THEN CASE WHEN b / 1048576 >= 100 THEN printf('%.0f MB', b / 1048576) ELSE printf('%.1f MB', b / 1048576) END
          WHEN b < 1099511627776 THEN CASE WHEN b / 1073741824 >= 100 THEN printf('%.0f GB', b / 1073741824) ELSE printf('%.1f GB', b / 1073741824) END
          ELSE CASE WHEN b / 1099511627776 >= 100 THEN printf('%.0f TB', b / 1099511627776) ELSE printf('%.1f TB', b / 1099511627776) END END AS size,
        CASE WHEN l_orderkey % 3 > 0 THEN printf('%02d:%02d:%02d.%03d', tc // 3600000, tc // 60000 % 60, tc // 1000 % 60, tc % 1000) END AS timecode,
        CASE WHEN l_orderkey % 9 = 0 THEN '-∞' WHEN db IS NULL THEN '—' WHEN db > 0 THEN printf('+%.3f', db) ELSE printf('%.3f', db) END AS level FROM m""",
    "channel_mask_explode": f"WITH p AS (SELECT p_partkey, p_size AS mask, unnest(range(6)) AS bit FROM part) SELECT p_partkey, bit, ({SPEAKERS})[bit + 1] AS speaker FROM p WHERE mask & (1 << bit) > 0",
    "sniff_priority": f"WITH p AS (SELECT *, (['RIFF....WAVE', 'FORM....AIFC', '....ftypM4A ', 'fLaC', 'caff', 'OggS', 'ID3', ''])[page_id % 8 + 1] || html[1:40] AS head FROM pages) SELECT page_id, {_KINDS} AS kind, hex(encode(head))[1:16] AS first_bytes FROM p",
    "extension_filter": r"""WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') || (['', '.WAV', '.mp3', '.txt'])[page_id % 4 + 1] AS name FROM pages)
      SELECT regexp_matches(lower(name), '\.(wav|bwf|rf64|aif|aiff|aifc|mp4|m4a|flac|caf|ogg|oga|opus|mp3)$') AS wanted, count(*) AS files, min(name) AS first_name FROM p GROUP BY 1""",
    "props_json": "WITH k AS (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events) SELECT event_type, key, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || key)) AS \"values\" FROM k GROUP BY 1, 2",
}
