"""The registered queries of the moderation engine, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura import constants as C
from murmura.functions import patterns, scores
from murmura.functions.lookalikes import AFTER, letters
from murmura.functions.normalize import normalize, normalize_ascii, normalizer
from murmura.operators import archive, context, detect, folds, moderation, monitor, stats
from murmura.plans import sql as Q
from murmura.sources import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Words of the toxic documents among the test tables, as a test configuration.
BANNED = ["trash", "worthless", "scum", "moron", "idiot", "pathetic", "clown", "disgusting", "loser", "stupid"]
#: A test dictionary of common tokens, since real ones hardly occur in the tables.
HOT = {"the": 0.02, "and": 0.03, "for": 0.05, "with": 0.1, "that": 0.04, "est": 0.05, "und": 0.03}
BOUNDARY = r"\p{L}\p{Nd}"
SAFE = {"on": -0.02, "of": -0.03, "le": -0.02}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(lit, x)) + "]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"


def r6(x: str) -> str:
    return f"round({x} + 1e-10::DOUBLE, 6)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: near(F.col(c)) for c in columns})


def near(x: Column) -> Column:
    """Six places; the nudge settles ties and the sign of zero alike in both engines."""
    return F.round(x + 1e-10, 6)


# --- scores of documents ----------------------------------------------------------------------------------


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as messages: the source is the channel, the language the server."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").withColumn("keywords", detect.keyword_heat(normalize_ascii(t), HOT, SAFE)).withColumn("heat", scores.heat_index(t, F.col("keywords")))


DOC_HEAT = Q.heat("text", "keywords")
SCORED = f"(SELECT *, {DOC_HEAT} AS heat FROM (SELECT doc_id, source, lang, text, {Q.keyword_heat(Q.normalized('text'), HOT, SAFE)} AS keywords FROM documents))"


@query(f"""
SELECT source, {r6('avg(heat)')} AS average_heat, count(heat) AS message_count, {r6('greatest(0, max(heat))')} AS record_high,
  count(*) FILTER (heat > 0.3 AND heat <= 0.8) AS moderate_messages, {r6('coalesce(avg(heat) FILTER (heat > 0.3 AND heat <= 0.8), 0)')} AS moderate_average,
  count(*) FILTER (heat > 0.8 AND heat <= 1.4) AS high_messages, {r6('coalesce(avg(heat) FILTER (heat > 0.8 AND heat <= 1.4), 0)')} AS high_average,
  count(*) FILTER (heat > 1.4) AS extreme_messages
FROM (SELECT source, round(heat, 9) AS heat FROM {SCORED}) GROUP BY source""")
def heat_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: heat of every document, then the bucketed statistics of each source."""
    scored = scored_documents(spark, sf_dir).select("source", F.round("heat", 9).alias("heat"))
    return rounded(stats.member_stats(scored, ["source"]), "average_heat", "record_high", "moderate_average", "high_average")


@query(f"""
SELECT doc_id, {r6(Q.caps('text'))} AS caps, {r6(Q.size('text'))} AS length, {r6(Q.punctuation('text'))} AS punctuation, {r6(Q.debate('text'))} AS debate,
  {r6('keywords')} AS keywords, {r6(DOC_HEAT)} AS heat
FROM (SELECT doc_id, text, {Q.keyword_heat(Q.normalized('text'), HOT, SAFE)} AS keywords FROM documents)""")
def heat_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    out = scored_documents(spark, sf_dir).select(
        "doc_id", scores.caps_score(t).alias("caps"), scores.length_score(t).alias("length"), scores.punctuation_score(t).alias("punctuation"), scores.debate_score(t).alias("debate"), "keywords", "heat"
    )
    return rounded(out, "caps", "length", "punctuation", "debate", "keywords", "heat")


@query(f"SELECT doc_id, {r6(Q.keyword_heat(Q.normalized('text'), HOT, SAFE))} AS keywords FROM documents")
def keyword_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = normalize_ascii(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", near(detect.keyword_heat(t, HOT, SAFE)).alias("keywords"))


@query(f"""
SELECT doc_id, len(list_filter({Q.words(Q.normalized('text'))}, lambda t: t IN ({", ".join(f"'{w}'" for w in HOT)})))::INT AS whole,
  {" + ".join(f"contains({Q.normalized('text')}, '{w}')::INT" for w in HOT)} AS contained,
  regexp_matches({Q.normalized('text')}, '{"|".join(HOT)}') AS any_keyword
FROM documents""")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, w = normalize_ascii(F.col("text")), list(HOT)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(detect.keyword_hits(t, w, "whole")).alias("whole"), F.size(detect.contained_keywords(t, w)).alias("contained"), detect.any_keyword(t, w).alias("any_keyword"))


@query(f"SELECT doc_id, md5({Q.normalized('text')}) AS norm FROM documents")
def unicode_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalize(F.col("text"))).alias("norm"))


LOOKALIKES = [
    (1, "𝗕𝗮𝗱 𝕎𝕠𝕣𝕕", "bad word"), (2, "🇧🇦🇩", "bad"), (3, "ⓑⓐⓓ", "bad"), (4, "Wörd's", "words"), (5, "h3ll0", "hello"), (6, "a​b", "ab"),
    (7, "ｆｕｌｌ", "full"), (8, "ﬁx", "fix"), (9, "вад", "baa"), (10, "💀ok😭", "ok"), (11, "𝚀𝚉", "qz"), (12, "ñandú", "nandu"),
]


@query(f"SELECT id, norm FROM {sql_values([(i, n) for i, _, n in LOOKALIKES], 'id, norm')}")
def unicode_lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, [(i, t) for i, t, _ in LOOKALIKES], "id int, text string")
    return rows.select("id", normalize(F.col("text")).alias("norm"))


def letter_rules() -> list[tuple[int, str, str]]:
    """Code point, letter and replacement of every listed letter, and of every form that Unicode data give."""
    rules = AFTER | letters()
    for first in (0x1F1E6, 0x1F110, 0x1F170, 0x1D41A, 0x1D482, 0x1D4EA, 0x1D5BA, 0x1D5EE, 0x1D622, 0x1D656, 0x1D68A, 0x1D670, 0x24D0):
        rules |= {chr(first + i): chr(97 + i) for i in range(26)}
    return [(ord(c), c, by) for c, by in sorted(rules.items())]


@query(f"SELECT code, latin FROM {sql_values([(n, by) for n, _, by in letter_rules()], 'code, latin')}")
def unicode_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, [(n, c) for n, c, _ in letter_rules()], "code int, letter string")
    return rows.select("code", normalize(F.col("letter")).alias("latin"))


MARKED = [
    (1, "**bold** and __also__"), (2, "*it* _al_"), (3, "~~gone~~ ||hidden||"), (4, "a ```code\nblock``` b `c`"), (5, "# Head"), (6, "> quote"),
    (7, "[text](http://x.y)"), (8, "plain * star"), (9, ""), (10, "x\n# not first"), (11, "**a\nb**"),
]


def marked_sql(t: str) -> str:
    for pattern, by in scores.MARKDOWN:
        pattern = pattern.replace("(.+?)", r"([^\n]+?)")
        t = f"regexp_replace({t}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return t


@query(f"""
SELECT 'd' || doc_id AS id, md5({marked_sql('text')}) AS plain FROM documents
UNION ALL SELECT 'v' || id, md5({marked_sql('text')}) FROM {sql_values(MARKED, 'id, text')}""")
def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    rows = docs.union(values(spark, MARKED, "id int, text string").select(F.concat(F.lit("v"), "id"), "text"))
    return rows.select("id", F.md5(scores.strip_markdown(F.col("text"))).alias("plain"))


LINKS = [(1, "see https://a.b/c now", 0), (2, "http://x.y", 0), (3, "http://x.y", 1), (4, "", 1), (5, "", 0), (6, " plain ", 0), (7, "HTTP://x", 0)]


@query(f"""
SELECT id, analysed FROM (SELECT *, trim(regexp_replace(text, 'https?://\\S+', '', 'g'), ' ') AS analysed FROM {sql_values(LINKS, 'id, text, images')})
WHERE text <> '' AND (analysed <> '' OR images > 0)
UNION ALL SELECT 100 + page_id, trim(regexp_replace('at ' || url || ' it', 'https?://\\S+', '', 'g'), ' ') FROM pages""")
def url_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, LINKS, "id int, text string, images int").select(F.col("id").cast("bigint"), "text", F.when(F.col("images") > 0, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")).alias("image_urls"))
    kept = moderation.scored_messages(rows, "text").select("id", "analysed")
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 100).alias("id"), scores.strip_urls(F.concat(F.lit("at "), "url", F.lit(" it"))).alias("analysed"))
    return kept.union(pages)


# --- banned words --------------------------------------------------------------------------------------------


def banned_rows() -> list[tuple[str, str, int]]:
    return patterns.pattern_rows(BANNED, normalizer())


def banned_sql(norm: str) -> str:
    """The first configured word with a spelling between boundaries."""
    whens = " ".join(f"WHEN regexp_matches({norm}, '(^|[^\\p{{L}}\\p{{Nd}}]){patterns.word_regex(w)}([^\\p{{L}}\\p{{Nd}}]|$)') THEN '{w}'" for w in BANNED)
    return f"(CASE {whens} END)"


def spelling_sql(norm: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({norm}, '(^|[^{BOUNDARY}]){patterns.word_regex(w)}([^{BOUNDARY}]|$)') THEN regexp_extract({norm}, '(^|[^{BOUNDARY}])({patterns.word_regex(w)})([^{BOUNDARY}]|$)', 2)" for w in BANNED)
    return f"(CASE {whens} END)"


@query(f"SELECT doc_id, word FROM (SELECT doc_id, {banned_sql(Q.normalized('text'))} AS word FROM documents) WHERE word IS NOT NULL")
def banned_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", detect.first_match(normalize_ascii(F.col("text")), banned_rows()).alias("word")).where("word is not null")


@query(f"""
SELECT toxic, count(*) AS n, count(word) AS found, {r6('count(word)::DOUBLE / count(*)')} AS share
FROM (SELECT toxic, {banned_sql(Q.normalized('text'))} AS word FROM documents JOIN labels USING (doc_id)) GROUP BY toxic""")
def banned_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    found = docs.select("toxic", detect.first_match(normalize_ascii(F.col("text")), banned_rows()).alias("word"))
    return found.groupBy("toxic").agg(F.count("*").alias("n"), F.count("word").alias("found"), near(F.count("word") / F.count("*")).alias("share"))


@query(f"""
WITH p(server, ordinal, word) AS (VALUES ('de', 0, 'idiot'), ('en', 0, 'moron'), ('en', 1, 'trash'), ('fr', 0, 'clown'))
SELECT doc_id, lang, arg_min(word, ordinal) AS word FROM documents JOIN p ON server = lang AND (
{" OR ".join(f"(word = '{w}' AND regexp_matches({Q.normalized('text')}, '(^|[^{BOUNDARY}]){patterns.word_regex(w)}([^{BOUNDARY}]|$)'))" for w in ('idiot', 'moron', 'trash', 'clown'))}
) GROUP BY 1, 2""")
def banned_by_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-server dictionaries: a broadcast join on the server, then on the pattern."""
    words = {"de": ["idiot"], "en": ["moron", "trash"], "fr": ["clown"]}
    config = values(spark, [(k, (v,)) for k, v in words.items()], "id string, config struct<banned_words: array<string>>")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("lang").alias("server_id"), normalize_ascii(F.col("text")).alias("norm"))
    hits = detect.detect_by_server(docs, detect.patterns_table(spark, config))
    return hits.select("doc_id", "lang", F.col("original_word").alias("word"))


VARIED = ["grab", "love", "at", "box", "trash"]


def variant_list() -> list[tuple[str, int, str]]:
    return [(w, i, v) for w in VARIED for i, v in enumerate(patterns.grammar_variants(w))]


@query(r"""
WITH w(word) AS (VALUES ('grab'), ('love'), ('at'), ('box'), ('trash')),
v AS (SELECT word, unnest([word, word || 's', word || '''s', word || 's''', CASE WHEN word LIKE '%e' THEN word || 'd' ELSE word || 'ed' END, word || 'ing']
  || CASE WHEN regexp_matches(word, '[b-df-hj-np-tv-z][aeiou][b-df-hj-np-tv-z]$') THEN [word || word[-1:] || 'ing', word || word[-1:] || 'ed'] ELSE [] END) AS variant FROM w)
SELECT word, variant, (1 << (length(variant) - 1))::BIGINT AS spellings FROM v""")
def grammar_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, [(w, v) for w, _, v in variant_list()], "word string, variant string")
    return rows.select("word", "variant", F.pow(F.lit(2.0), F.length("variant") - 1).cast("bigint").alias("spellings"))


@query("""
WITH m AS (SELECT range AS mask FROM range(8)), w(word) AS (VALUES ('abcd'), ('wxyz'))
SELECT word, mask, word[1] || CASE WHEN mask & 1 > 0 THEN ' ' ELSE '' END || word[2] || CASE WHEN mask & 2 > 0 THEN ' ' ELSE '' END || word[3]
  || CASE WHEN mask & 4 > 0 THEN ' ' ELSE '' END || word[4] AS variant FROM w, m""")
def space_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spacings of a word as an exploded sequence of bit masks."""
    w = values(spark, [("abcd",), ("wxyz",)], "word string").withColumn("mask", F.explode(F.expr("sequence(0L, shiftleft(1L, length(word) - 1) - 1)")))
    letters = F.expr("transform(sequence(1, length(word)), i -> concat(substring(word, i, 1), if(i < length(word) and (shiftright(mask, i - 1) & 1) = 1, ' ', '')))")
    return w.select("word", "mask", F.array_join(letters, "").alias("variant"))


@query("""
WITH w(word) AS (VALUES ('grab'), ('love'), ('at'), ('box'), ('trash')),
v AS (SELECT word, unnest([length(word), length(word) + 1, length(word) + 2, length(word) + 2, CASE WHEN word LIKE '%e' THEN length(word) + 1 ELSE length(word) + 2 END, length(word) + 3]
  || CASE WHEN regexp_matches(word, '[b-df-hj-np-tv-z][aeiou][b-df-hj-np-tv-z]$') THEN [length(word) + 4, length(word) + 3] ELSE [] END) AS n FROM w),
s AS (SELECT word, count(*) AS grammar, sum(1 << (n - 1))::BIGINT AS spaced FROM v GROUP BY word)
SELECT word, grammar, spaced, spaced * 5 AS passes, (spaced * 5 * least(100, floor(ln(spaced) * 20)))::BIGINT AS total FROM s""")
def keyspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, [(w, v) for w, _, v in variant_list()], "word string, variant string")
    s = rows.groupBy("word").agg(F.count("*").alias("grammar"), F.sum(F.pow(F.lit(2.0), F.length("variant") - 1)).cast("bigint").alias("spaced"))
    paths = F.least(F.lit(100), F.floor(F.log("spaced") * 20))
    return s.withColumn("passes", F.col("spaced") * 5).withColumn("total", (F.col("passes") * paths).cast("bigint"))


HIDDEN = [
    (1, "what a trash day", True), (2, "t r a s h", True), (3, "t.r.a.s.h", True), (4, "tr4sh", True), (5, "trashing", True), (6, "ashtray", False), (7, "trashcan", False),
    (8, "t♥r♥a♥s♥h", True), (9, "TRASH", True), (10, "x" * 60 + " nothing", False), (11, "some words around dHJhc2ggdHJhc2ggdHJhc2ggdHJhc2gg here", True),
    (12, "01110100 01110010 01100001 01110011 01101000 and 0111010001110010011000010111001101101000", True), (13, "trash_can", False), (14, "", False), (15, "𝕥𝕣𝕒𝕤𝕙", True),
]


@query(f"SELECT id, found FROM {sql_values([(i, f) for i, _, f in HIDDEN], 'id, found')}")
def multipass_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, [(i, t) for i, t, _ in HIDDEN], "id int, text string")
    return detect.multipass(rows, "text", "trash").select("id", "found")


@query()
def multipass_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in which a pass or a decoding finds the word; no SQL, brute force in the tests."""
    found = detect.multipass(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "trash")
    return found.select("doc_id", "found")


@query(f"""
SELECT count(*) AS n, count(*) FILTER (live) AS live, count(*) FILTER (multi) AS multipass, count(*) FILTER (live AND multi) AS both, count(*) FILTER (live <> multi) AS differ
FROM (SELECT *, id IN (1, 2, 4, 5, 9, 13, 15) AS live FROM {sql_values([(i, f) for i, _, f in HIDDEN], 'id, multi')})""")
def detector_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, [(i, t) for i, t, _ in HIDDEN], "id int, text string").withColumn("norm", normalize(F.col("text")))
    return detect.compare(rows, "text", "norm", "trash")


@query(r"""
SELECT doc_id, length(text) >= 50 AND (regexp_full_match(text, '[^\n]*[A-Za-z0-9+/]{20,}={0,2}[^\n]*') OR regexp_full_match(text, '[^\n]*[01]{30,}[^\n]*')) AS suspicious FROM documents""")
def suspicious_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scores.suspicious_encoding(F.col("text")).alias("suspicious"))


# --- context windows -------------------------------------------------------------------------------------------

CHAT = [
    (1, 1, "u1", "tr"), (1, 2, "u1", "ash"), (1, 3, "u2", "fine day to all"), (1, 4, "u1", "sc"), (1, 5, "u3", "um"), (1, 6, "u1", "um"),
    (2, 1, "u1", "m"), (2, 2, "u2", "o"), (2, 3, "u3", "r"), (2, 4, "u1", "o"), (2, 5, "u2", "n"), (2, 6, "u2", "hello"), (2, 7, "u4", "trash"),
    (3, 1, "u5", "lo"), (3, 2, "u6", "s"), (3, 3, "u5", "er"), (3, 4, "u5", "long enough not to be gated"), (3, 5, "u7", ""), (3, 6, "u7", "id"), (3, 7, "u7", "iot"),
]


def chat(spark: SparkSession) -> DataFrame:
    rows = values(spark, CHAT, "channel int, n int, author_id string, content string")
    return rows.select(F.lit("s").alias("server_id"), F.col("channel").cast("string").alias("channel_id"), (F.col("channel") * 100 + F.col("n")).cast("bigint").alias("message_id"), F.timestamp_seconds("n").alias("ts"), "author_id", "content")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as messages; a turn replies to the one before."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select(
        F.lit("s").alias("server_id"), F.col("conv_id").cast("string").alias("channel_id"), (F.col("conv_id") * 1048576 + F.col("turn")).alias("message_id"),
        F.timestamp_seconds("turn").alias("ts"), F.col("role").alias("author_id"), F.col("text").alias("content"), F.lag(F.col("conv_id") * 1048576 + F.col("turn")).over(w).alias("reply_to_message_id"),
    )


DEPTH = "CASE WHEN length(content) < 4 THEN 8 WHEN length(content) < 6 THEN 6 WHEN length(content) < 10 THEN 4 ELSE 0 END"
CONTEXT = f"""
SELECT m.channel, m.n, m.author_id, m.content, string_agg(h.content, ' ' ORDER BY h.n) AS past
FROM (SELECT *, {DEPTH} AS depth FROM {sql_values(CHAT, 'channel, n, author_id, content')}) m
LEFT JOIN {sql_values(CHAT, 'channel, n, author_id, content').replace(' AS v(', ' AS h(')} ON h.channel = m.channel AND h.n < m.n AND h.n >= m.n - m.depth AND h.author_id = m.author_id AND h.content <> ''
GROUP BY ALL"""


@query(f"SELECT (channel * 100 + n)::BIGINT AS message_id, length(content) < 10 AS gated, CASE WHEN past IS NULL THEN content ELSE past || ' ' || content END AS context FROM ({CONTEXT})")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.with_context(chat(spark)).select("message_id", "gated", "context")


@query(f"""
SELECT message_id, phase, coalesce(a, b, c) AS word FROM (
  SELECT *, CASE WHEN a IS NOT NULL THEN 'message' WHEN b IS NOT NULL THEN 'context' WHEN c IS NOT NULL THEN 'packed' END AS phase FROM (
    SELECT (channel * 100 + n)::BIGINT AS message_id, {banned_sql(Q.normalized('content'))} AS a,
      CASE WHEN length(content) < 10 AND past IS NOT NULL THEN {banned_sql(Q.normalized("past || ' ' || content"))} END AS b,
      CASE WHEN length(content) < 10 AND past IS NOT NULL THEN {banned_sql(Q.normalized("regexp_replace(past || ' ' || content, '[[:space:]]+', '', 'g')"))} END AS c
    FROM ({CONTEXT}))) WHERE phase IS NOT NULL""")
def split_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.with_context(chat(spark)).withColumns({"a": normalize(F.col("plain")), "b": normalize(F.col("context")), "c": normalize(context.packed(F.col("context")))})
    longer = F.col("gated") & (F.length("context") > F.length("plain"))
    phase, word = detect.three_phases(F.col("a"), F.col("b"), F.col("c"), longer, F.lit(True), banned_rows())
    return rows.select("message_id", phase.alias("phase"), word.alias("word")).where("phase is not null")


@query("""
SELECT * FROM (VALUES (205::BIGINT, 'm o r o n', 5, ['u1', 'u2', 'u3']), (206, 'm o r o n', 5, ['u1', 'u2', 'u3']), (207, 'm o r o n', 5, ['u1', 'u2', 'u3']),
  (303, 'lo s er', 3, ['u5', 'u6']), (305, 'lo s er', 3, ['u5', 'u6']), (306, 'lo s er', 3, ['u5', 'u6']), (307, 'lo s er', 3, ['u5', 'u6'])) v(message_id, spelling, messages, authors)""")
def collaborative_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat(spark).withColumn("packed_norm", normalize(context.packed(scores.strip_markdown(F.col("content")))))
    configs = values(spark, [("s", (BANNED,))], "id string, config struct<banned_words: array<string>>")
    found = context.collaborative(rows, detect.patterns_table(spark, configs))
    return found.select("message_id", "spelling", F.size("involved_messages").alias("messages"), F.col("involved_authors").alias("authors"))


@query("SELECT conv_id * 1048576 + turn AS message_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS depth FROM conversations")
def reply_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.reply_depth(conversations(spark, sf_dir))


@query(f"""
SELECT message_id, {r6(f"greatest(0, {Q.heat('content')} + (depth - 1) * 0.1::DOUBLE)")} AS heat
FROM (SELECT conv_id * 1048576 + turn AS message_id, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM conversations)""")
def event_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = conversations(spark, sf_dir)
    rows = messages.join(context.reply_depth(messages), "message_id")
    return rows.select("message_id", near(scores.event_heat(scores.heat_index(F.col("content")), F.col("depth"))).alias("heat"))


@query("""
SELECT conv_id * 1048576 + turn AS message_id, count(*) OVER w AS history, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS history_chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.with_history(conversations(spark, sf_dir))
    chars = F.aggregate("history", F.lit(0).cast("bigint"), lambda s, h: s + F.length(h["content"]))
    return rows.select("message_id", F.size("history").cast("bigint").alias("history"), chars.alias("history_chars"))


# --- statistics of events --------------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as scored messages: the type is the channel, the user the member."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("s").alias("server_id"), F.col("event_type").alias("channel_id"), F.col("user_id").alias("member_id"), F.col("event_id").alias("message_id"), "ts", (F.col("value") / 100.0).alias("heat"))


RECURSIVE = f"""
WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS us, value / 100.0::DOUBLE AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT event_type, n, event_id, us, x, x AS a, [x] AS ring, FALSE AS hot, FALSE AS alert, NULL::BIGINT AS last FROM e WHERE n = 1
  UNION ALL
  SELECT event_type, n, event_id, us, x, a, ring, hot, hot AND (last IS NULL OR us - last >= 3600000000) AS alert, CASE WHEN hot AND (last IS NULL OR us - last >= 3600000000) THEN us ELSE last END AS last
  FROM (SELECT *, a > 0.35 AND len(ring) >= 3 AND list_avg(ring) >= 1.0 AS hot FROM (
    SELECT event_type, n, event_id, us, x, a, (ring || [a])[-10:] AS ring, last FROM (
      SELECT e.event_type, e.n, e.event_id, e.us, e.x, r.ring, r.last, (CASE WHEN r.a = 0 THEN e.x WHEN e.x > r.a THEN 0.75::DOUBLE * e.x + 0.25::DOUBLE * r.a ELSE 0.5::DOUBLE * r.a + 0.5::DOUBLE * e.x END) AS a
      FROM r JOIN e ON e.event_type = r.event_type AND e.n = r.n + 1))))
"""


@query(f"{RECURSIVE} SELECT event_id AS message_id, {r6('a')} AS average, {r6('list_avg(ring)')} AS ring_mean, len(ring)::INT AS samples, hot FROM r")
def channel_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.channel_heat(events(spark, sf_dir), ["channel_id"], ["ts", "message_id"], cooldown=3600)
    return rounded(out.select("message_id", "average", "ring_mean", "samples", "hot"), "average", "ring_mean")


@query(f"{RECURSIVE} SELECT event_id AS message_id, event_type AS channel_id, {r6('a')} AS average, CASE WHEN a > 0.8 THEN 'orange-red' WHEN a > 0.5 THEN 'orange' ELSE 'yellow' END AS color FROM r WHERE alert")
def heat_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.channel_heat(events(spark, sf_dir), ["channel_id"], ["ts", "message_id"], cooldown=3600)
    return rounded(moderation.alerts(out).select("message_id", "channel_id", "average", "color"), "average")


@query(f"{RECURSIVE} SELECT event_type AS channel_id, {r6('arg_max(a, n)')} AS average FROM r GROUP BY 1")
def final_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.final_average(events(spark, sf_dir), ["channel_id"], ["ts", "message_id"])
    return rounded(out.select("channel_id", "average"), "average")


@query(f"{RECURSIVE} SELECT event_id AS message_id FROM r WHERE hot")
def sustained_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring's rule as windows over the averages."""
    out = folds.channel_heat(events(spark, sf_dir), ["channel_id"], ["ts", "message_id"]).select("channel_id", "message_id", "ts", "average")
    w = Window.partitionBy("channel_id").orderBy("ts", "message_id")
    return out.withColumn("sustained", folds.sustained(F.col("average"), w)).where("sustained").select("message_id")


@query("""
WITH RECURSIVE e AS (SELECT event_type, epoch(ts)::BIGINT AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_type, n, s, s AS last, 1::BIGINT AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.event_type, e.n, e.s, CASE WHEN e.s - r.last >= 86400 THEN e.s ELSE r.last END, r.kept + CASE WHEN e.s - r.last >= 86400 THEN 1 ELSE 0 END FROM r JOIN e ON e.event_type = r.event_type AND e.n = r.n + 1)
SELECT event_type AS channel_id, max(kept)::INT AS kept FROM r GROUP BY 1""")
def cooldown_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = folds.thinned(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], 86400)
    return kept.groupBy(F.col("event_type").alias("channel_id")).agg(F.count("*").cast("int").alias("kept"))


MEMBERS = f"""
SELECT user_id AS member_id, {r6('avg(heat)')} AS average_heat, count(heat) AS message_count, {r6('greatest(0, max(heat))')} AS record_high,
  count(*) FILTER (heat > 0.3 AND heat <= 0.8) AS moderate_messages, {r6('coalesce(avg(heat) FILTER (heat > 0.3 AND heat <= 0.8), 0)')} AS moderate_average,
  count(*) FILTER (heat > 0.8 AND heat <= 1.4) AS high_messages, {r6('coalesce(avg(heat) FILTER (heat > 0.8 AND heat <= 1.4), 0)')} AS high_average,
  count(*) FILTER (heat > 1.4) AS extreme_messages
FROM (SELECT user_id, value / 100.0::DOUBLE AS heat FROM events) GROUP BY user_id"""


@query(MEMBERS)
def member_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.member_stats(events(spark, sf_dir), ["member_id"]), "average_heat", "record_high", "moderate_average", "high_average")


@query(f"SELECT event_id AS message_id, {r6('avg(value / 100.0::DOUBLE) OVER w')} AS running_mean, count(*) OVER w AS running_count FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.running_mean(events(spark, sf_dir), ["member_id"], ["ts", "message_id"]).select("message_id", "running_mean", "running_count"), "running_mean")


@query("SELECT event_type AS channel_id, count(*) AS n, count(DISTINCT user_id) AS authors FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*), count(DISTINCT user_id) FROM events")
def server_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    counts = [F.count("*").alias("n"), F.count_distinct("member_id").alias("authors")]
    return e.groupBy("channel_id").agg(*counts).union(e.agg(F.lit("all"), *counts))


@query("""
SELECT *, CASE WHEN level_before <= 0 THEN 0 WHEN level_before > 20 THEN 86400 ELSE least(factorial(least(level_before, 20)::INT), 86400) * 0 + least(factorial(least(level_before, 8)::INT) * 60, 86400) END::BIGINT AS seconds FROM (
  SELECT event_id AS message_id, event_type = 'error' AS punished, count(*) FILTER (event_type = 'error') OVER w AS level_before
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def infraction_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.infractions(events(spark, sf_dir), ["member_id"], ["ts", "message_id"], F.col("channel_id") == "error")
    return stats.timeouts(rows, "factorial", 60).select("message_id", "punished", "level_before", "seconds")


@query("""
SELECT user_id AS member_id, count(*) AS infraction_level, count(*) AS total_infractions, strftime(max(ts), '%Y-%m-%d') AS last_date, strftime(max(ts)::DATE + 14, '%Y-%m-%d') AS reduction_date
FROM events WHERE event_type = 'error' GROUP BY 1""")
def infraction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.infraction_totals(events(spark, sf_dir).where("channel_id = 'error'"), ["member_id"])


LEVELS = [(level, mode, base) for level in (0, 1, 2, 3, 5, 9, 21) for mode in ("flat", "factorial", "exponential", "Other") for base in (0, 7, 60)]


@query(f"""
SELECT level, mode, base, seconds, CASE WHEN seconds <= 0 THEN '0s' ELSE array_to_string(list_filter([CASE WHEN seconds // 86400 > 0 THEN (seconds // 86400) || 'd' END, CASE WHEN seconds % 86400 // 3600 > 0 THEN (seconds % 86400 // 3600) || 'h' END,
  CASE WHEN seconds % 3600 // 60 > 0 THEN (seconds % 3600 // 60) || 'm' END, CASE WHEN seconds % 60 > 0 THEN (seconds % 60) || 's' END], lambda x: x IS NOT NULL), ' ') END AS shown
FROM (SELECT *, (CASE WHEN level <= 0 OR base <= 0 THEN 0 WHEN lower(mode) = 'factorial' THEN CASE WHEN level > 12 THEN 86400 ELSE least(factorial(least(level, 12)) * base, 86400) END
  WHEN lower(mode) = 'exponential' THEN least(pow(base::DOUBLE, level::DOUBLE), 86400) ELSE base END)::BIGINT AS seconds FROM {sql_values(LEVELS, 'level, mode, base')})""")
def timeout_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, LEVELS, "level int, mode string, base int")
    out = rows.withColumn("seconds", scores.timeout_seconds(F.col("level"), F.col("mode"), F.col("base")))
    return out.withColumn("shown", scores.format_duration(F.col("seconds")))


PAIRS = """
SELECT user_id::VARCHAR AS src_id, lead(user_id::VARCHAR) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst_id, ts,
  CASE event_type WHEN 'purchase' THEN 0.12 WHEN 'click' THEN 0.03 WHEN 'error' THEN -0.05 ELSE 0.01 END::DOUBLE AS affection FROM events"""


def affection_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user reacts to the author of the channel's next event; the type picks the emoji."""
    e = events(spark, sf_dir)
    emoji = F.when(F.col("channel_id") == "purchase", "💗").when(F.col("channel_id") == "click", "👍").when(F.col("channel_id") == "error", "👎").otherwise("🎉")
    nxt = F.lead(F.col("member_id").cast("string")).over(Window.partitionBy("channel_id").orderBy("ts", "message_id"))
    rows = e.select("server_id", F.col("member_id").cast("string").alias("src_id"), nxt.alias("dst_id"), "ts", scores.reaction_affection(emoji).alias("affection"))
    return rows.where("dst_id is not null and dst_id != src_id")


@query(f"""
WITH c AS (SELECT * FROM ({PAIRS}) WHERE dst_id IS NOT NULL AND dst_id <> src_id), f AS (SELECT user_id::VARCHAR AS m, min(ts) AS t FROM events GROUP BY 1)
SELECT src_id, dst_id, {r6('sum(affection)')} AS affection FROM c JOIN f a ON a.m = src_id AND a.t < ts JOIN f b ON b.m = dst_id AND b.t < ts GROUP BY 1, 2""")
def relation_affection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    first = e.groupBy("server_id", F.col("member_id").cast("string").alias("member_id")).agg(F.min("ts").alias("first_ts"))
    return rounded(stats.pair_affection(affection_changes(spark, sf_dir), first).select("src_id", "dst_id", "affection"), "affection")


@query(f"""
WITH r AS (SELECT src_id, dst_id, {r6('sum(affection) * 100')} AS affection FROM ({PAIRS}) WHERE dst_id IS NOT NULL AND dst_id <> src_id GROUP BY 1, 2)
SELECT * FROM (SELECT a.src_id, a.dst_id, a.affection, coalesce(b.affection, 0) AS mutual,
  CASE WHEN a.affection > 5 AND coalesce(b.affection, 0) > 5 THEN 'mutual' WHEN a.affection > 5 AND coalesce(b.affection, 0) <= 1 THEN 'one-sided' WHEN a.affection < -5 OR coalesce(b.affection, 0) < -5 THEN 'negative' END AS class
  FROM r a LEFT JOIN r b ON a.src_id = b.dst_id AND a.dst_id = b.src_id) WHERE class IS NOT NULL""")
def relation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.pair_affection(affection_changes(spark, sf_dir)).withColumn("affection", near(F.col("affection") * 100))
    members = events(spark, sf_dir).select("server_id", F.col("member_id").cast("string").alias("member_id")).distinct()
    return stats.classified_relations(r, members).select("src_id", "dst_id", "affection", "mutual", "class")


EMOJI = [("💗", 0.12), ("❤️", 0.12), ("👍", 0.03), ("💀", 0.0), ("☠️", 0.0), ("👎", -0.05), (":Heart_eyes:", 0.12), ("🎉", 0.01)]
REPLIES = [("YES", 0.15), ("YASSS", 0.15), ("yesss", 0.1), ("yes", None), ("YES!", None), ("yAsSSs", 0.1)]


@query(f"SELECT text, affection::DOUBLE AS affection FROM {sql_values(EMOJI + REPLIES, 'text, affection')}")
def affection_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = values(spark, [(t,) for t, _ in EMOJI], "text string").withColumn("affection", scores.reaction_affection(F.col("text")))
    b = values(spark, [(t,) for t, _ in REPLIES], "text string").withColumn("affection", scores.reply_affection(F.col("text")))
    return a.union(b)


DAMPED = [(0.0, 1.0), (2.0, 1.0), (-4.0, 2.0), (9.9, 5.0), (0.1, 5.0), (-0.1, -5.0)]


@query(f"SELECT a, b, {r6('greatest(-10, least(10, CASE WHEN a = 0 THEN a + b ELSE a + b / abs(a) END))')} AS damped FROM (SELECT a::DOUBLE AS a, b::DOUBLE AS b FROM {sql_values(DAMPED, 'a, b')})")
def affection_damping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, DAMPED, "a double, b double").withColumn("damped", near(scores.damped_affection(F.col("a"), F.col("b"))))


@query("""
SELECT o_custkey::VARCHAR AS src, o_orderkey, coalesce(c_name, 'Unknown_User_' || (o_custkey + o_orderkey % 3)) AS target_name
FROM orders LEFT JOIN customer ON c_custkey = o_custkey + o_orderkey % 3""")
def name_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("src"), "o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 3).cast("string").alias("dst_id"))
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("member_id"), F.col("c_name").alias("member_name"))
    return stats.named_targets(o, members)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def live_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return stats.live_only(c, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k").select("c_custkey", F.col("k").alias("c_nationkey"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"""
WITH h AS (SELECT event_type, hour(ts)::INT AS h, count(*) AS n, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2)
SELECT h.event_type AS channel_id, {r6('sum(n) / greatest(1, (epoch_us(max(b)) - epoch_us(min(a))) / 60e6)')} AS messages_per_minute, max(n) AS peak_messages,
  arg_max(h, n * 100 - h) AS peak_hour, {r6('any_value(d)')} AS diversity
FROM h JOIN (SELECT event_type, count(DISTINCT user_id) / count(*)::DOUBLE AS d FROM events GROUP BY 1) USING (event_type) GROUP BY 1""")
def channel_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumnRenamed("member_id", "author_id")
    return rounded(stats.channel_activity(e, ["channel_id"]), "messages_per_minute", "diversity")


BACKFILL = [(5, 1, 1, 1, 0.5), (0, 1, 2, 3, 0.5), (0, 0, 0, 0, 0.2), (0, 0, 0, 0, 0.0)]


@query(f"SELECT count, average, CASE WHEN count <> 0 THEN count WHEN a + b + c > 0 THEN a + b + c WHEN average > 0 THEN 1 ELSE 0 END AS filled FROM (SELECT count, a, b, c, average::DOUBLE AS average FROM {sql_values(BACKFILL, 'count, a, b, c, average')})")
def count_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, BACKFILL, "count int, a int, b int, c int, average double")
    return rows.select("count", "average", stats.backfilled_count(*[F.col(c) for c in ("count", "a", "b", "c", "average")]).alias("filled"))


# --- moderation ------------------------------------------------------------------------------------------------


@query(f"""
WITH h AS (SELECT doc_id, source, text, {banned_sql(Q.normalized('text'))} AS word, {spelling_sql(Q.normalized('text'))} AS spelling FROM documents),
j AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS level,
  ({" OR ".join(f"(word = '{w}' AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])' || spelling || '([^A-Za-z0-9_]|$)'))" for w in BANNED)}) AS punished FROM h WHERE word IS NOT NULL)
SELECT doc_id AS message_id, source AS author_id, 'timeout' AS action, least(pow(60::DOUBLE, level), 86400)::BIGINT AS seconds FROM j WHERE level > 0
UNION ALL SELECT doc_id, source, 'delete', 0 FROM j UNION ALL SELECT doc_id, source, 'punish', 0 FROM j WHERE punished""")
def moderation_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions on documents with a banned word; the source is the author, earlier hits set the level."""
    docs = table(spark, sf_dir, "documents").select(F.lit("s").alias("server_id"), F.col("doc_id").alias("message_id"), F.col("source").alias("author_id"), F.col("text").alias("shown"))
    norm = normalize_ascii(F.col("shown"))
    hits = docs.withColumn("word", detect.first_match(norm, banned_rows())).withColumn("spelling", detect.spellings(norm, banned_rows())[0]).where("word is not null")
    level = F.row_number().over(Window.partitionBy("author_id").orderBy("message_id")) - 1
    hits = hits.withColumns({"level_before": level, "timeout_mode": F.lit("exponential"), "timeout_base_seconds": F.lit(60), "timeout_for_filtered_messages": F.lit(True), "delete_filtered_messages": F.lit(True), "warning_channel_id": F.lit("w")})
    return moderation.actions(moderation.violations(hits)).select("message_id", "author_id", "action", "seconds")


# --- archives --------------------------------------------------------------------------------------------------

LINE = "'[' || strftime(make_timestamp((turn * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') || '] ' || role || ': ' || text"
OPEN = f"SELECT conv_id, turn, {LINE} AS line FROM conversations"
REPLAY = f"SELECT *, substring(line, instr(line, ': ') + 2) AS message FROM ({OPEN}) WHERE instr(line, '] ') > 0 AND instr(line, ': ') > instr(line, '] ')"


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as archive lines."""
    m = conversations(spark, sf_dir)
    return m.select(F.col("channel_id").cast("bigint").alias("conv_id"), F.col("message_id").alias("line_no"), "ts", scores.archive_line(F.col("ts"), F.col("author_id"), F.col("content")).alias("line"))


@query(f"SELECT conv_id * 1048576 + turn AS line_no, md5(message) AS message FROM ({REPLAY})")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.replayed(archive_rows(spark, sf_dir)).select("line_no", F.md5("message").alias("message"))


@query(f"""
WITH m AS (SELECT conv_id, round({Q.heat('message')}, 9) AS heat FROM ({REPLAY})), s AS (SELECT conv_id, list_sort(list(heat)) AS l, count(*) AS n FROM m GROUP BY 1)
SELECT m.conv_id, count(*) AS n, {r6('avg(heat)')} AS mean, {r6('median(heat)')} AS median, {r6('stddev_pop(heat)')} AS deviation, {r6('greatest(0, max(heat))')} AS maximum,
  {r6('any_value(l[floor((s.n - 1) * 0.25)::INT + 1])')} AS q1, {r6('any_value(l[floor((s.n - 1) * 0.75)::INT + 1])')} AS q3, {r6('any_value(l[floor((s.n - 1) * 0.75)::INT + 1] - l[floor((s.n - 1) * 0.25)::INT + 1])')} AS iqr
FROM m JOIN s USING (conv_id) GROUP BY m.conv_id""")
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.replayed(archive_rows(spark, sf_dir)).select("conv_id", F.round(scores.heat_index(F.col("message")), 9).alias("heat"))
    return rounded(archive.order_statistics(rows, "heat", ["conv_id"]), "mean", "median", "deviation", "maximum", "q1", "q3", "iqr")


ARCHIVED = "'[2024-01-01 00:00:00] u: ' || replace(replace(text, chr(10), ' '), chr(13), ' ')"


def archived_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    line = F.concat(F.lit("[2024-01-01 00:00:00] u: "), F.translate("text", "\n\r", "  "))
    return d.select("doc_id", F.when(F.col("doc_id") % 50 == 0, "no archive line").otherwise(line).alias("line"))


PHRASES = " + ".join("contains(lower(m), '" + p.replace("'", "''") + "')::INT" for p in C.DEBATE_PHRASES)
CONDITIONALS = " + ".join(Q.parts("lower(m)", c) for c in C.CONDITIONALS if c != " may ")
SCORED_LINES = f"""
SELECT *, CASE WHEN m IS NOT NULL THEN {PHRASES} + (CASE WHEN {Q.chars('m', '?')} > 1 THEN {Q.chars('m', '?')} * 0.5 ELSE 0 END)::DOUBLE + (CASE WHEN {Q.chars('m', '.?!')} > 2 AND length(m) > 100 THEN 1 ELSE 0 END)
  + (CASE WHEN {CONDITIONALS} > 1 THEN ({CONDITIONALS}) * 0.3 ELSE 0 END)::DOUBLE + (CASE WHEN {Q.chars('m', '"')} >= 2 THEN 0.5 ELSE 0 END)::DOUBLE END AS score
FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE rtrim(replace(replace(text, chr(10), ' '), chr(13), ' '), ' ') END AS m FROM documents)"""


@query(f"SELECT doc_id, {r6('score')} AS score, coalesce(score <= 1.5, TRUE) AS kept FROM ({SCORED_LINES})")
def archive_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(archive.scored_lines(archived_documents(spark, sf_dir)).select("doc_id", "score", "kept"), "score")


@query(f"""
SELECT count(*) AS lines, count(*) FILTER (score <= 1.5) AS kept, count(*) FILTER (score > 1.5) AS removed, round(count(*) FILTER (score > 1.5)::DOUBLE / count(*) * 100, 1) AS removed_percent FROM ({SCORED_LINES})""")
def archive_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.cleaning_report(archive.scored_lines(archived_documents(spark, sf_dir)))


@query("""
SELECT channel_id, position, message_id FROM (SELECT event_type AS channel_id, event_id AS message_id, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
WHERE position % greatest(1, n // least(100, n)) = 0""")
def graph_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive.sampled(events(spark, sf_dir), ["channel_id"], ["ts", "message_id"])
    return out.select("channel_id", F.col("position").cast("bigint").alias("position"), "message_id")


@query("SELECT event_id AS message_id FROM (SELECT * FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 100)")
def newest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of one channel; the limit is the feature."""
    return archive.newest(events(spark, sf_dir).where("channel_id = 'view'"), 100).select("message_id")


# --- monitor and image text ------------------------------------------------------------------------------------

BAR = "'[' || repeat('█', greatest(0, least(20, floor(heat * 20)::INT))) || repeat('░', 20 - greatest(0, least(20, floor(heat * 20)::INT))) || ']'"
CHANNELS = f"SELECT (row_number() OVER (ORDER BY heat, name))::INT AS rank, name, heat, {BAR} AS bar FROM (SELECT event_type AS name, {r6('avg(value / 500.0::DOUBLE)')} AS heat FROM events GROUP BY 1)"
USERS = f"SELECT (row_number() OVER (ORDER BY heat, name))::INT AS rank, name, heat, {BAR} AS bar FROM (SELECT user_id::VARCHAR AS name, {r6('avg(value / 500.0::DOUBLE)')} AS heat FROM events GROUP BY 1)"


def monitor_table(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    means = events(spark, sf_dir).groupBy(F.col(key).cast("string").alias("name")).agg(near(F.avg(F.col("heat") / 5)).alias("average"))
    return monitor.ranked(means, "name", "average")


@query(CHANNELS)
def monitor_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor_table(spark, sf_dir, "channel_id")


@query(USERS)
def monitor_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor_table(spark, sf_dir, "member_id")


@query(f"""
SELECT coalesce(c.rank, u.rank) AS rank, c.name AS channel, c.heat AS channel_heat, c.bar AS channel_bar, u.name AS user, u.heat AS user_heat, u.bar AS user_bar
FROM ({CHANNELS}) c FULL JOIN ({USERS}) u ON c.rank = u.rank""")
def monitor_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.side_by_side(monitor_table(spark, sf_dir, "channel_id"), monitor_table(spark, sf_dir, "member_id"))


TRIGRAMS = "len(list_filter(range(1, length({t}) - 1), lambda i: substr({t}, i, 3) IN (" + ", ".join(f"'{t}'" for t in C.TRIGRAMS) + ")))"
CLEAN = "trim(regexp_replace(regexp_replace({t}, '[^a-zA-Z0-9 \\n]', '', 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(10))"
A, B = CLEAN.format(t="text"), CLEAN.format(t="reverse(text)")


@query(f"SELECT doc_id, a_n AS color_trigrams, md5(CASE WHEN a_n >= b_n THEN a ELSE b END) AS chosen FROM (SELECT *, {TRIGRAMS.format(t='lower(a)')} AS a_n, {TRIGRAMS.format(t='lower(b)')} AS b_n FROM (SELECT doc_id, {A} AS a, {B} AS b FROM documents))")
def ocr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading with more English trigrams; the reversed text stands for a second reading."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", scores.trigram_count(scores.ocr_clean(t)).cast("bigint").alias("color_trigrams"), F.md5(scores.best_ocr(t, F.reverse(t))).alias("chosen"))


@query(r"""
SELECT doc_id, hit FROM (SELECT doc_id, coalesce(nullif(regexp_extract(text, 'scum\w*', 0), ''), nullif(regexp_extract(text, '[Tt]rash', 0), '')) AS hit FROM documents) WHERE hit IS NOT NULL""")
def ocr_offensive(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = detect.offensive_ocr(F.col("text"), [r"scum\w*", "[Tt]rash"])
    return table(spark, sf_dir, "documents").select("doc_id", hit.alias("hit")).where("hit is not null")
