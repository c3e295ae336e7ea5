"""Detection of banned words and keywords in normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura import constants as C
from murmura.functions import patterns as P
from murmura.functions.normalize import normalizer
from murmura.functions.scores import let, suspicious_encoding


#: Configured servers, at most: their patterns and settings travel to every task.
MOST_SERVERS = 100_000


def keyword_hits(norm: Column, words: list[str], kind: str) -> Column:
    """Array of keywords found in normalised text, one entry for each occurrence.

    ``whole``: between boundaries; ``start`` and ``end``: with a boundary on that
    side only.  Overlapping occurrences all count.
    """
    out = F.array().cast("array<string>")
    for layer in P.prefix_free_layers(words):
        starts = P.first_letters(w[0] for w in layer)
        body = P.trie_regex(layer)
        regex = starts + {
            "whole": f"(?=({body}){P.AFTER}){P.BEFORE}",
            "start": f"(?=({body}){C.ALNUM}){P.BEFORE}",
            "end": f"(?=({body}){P.AFTER})(?<={C.ALNUM})",
        }[kind]
        out = F.concat(out, F.regexp_extract_all(norm, F.lit(regex), F.lit(1)))
    return out


def any_keyword(norm: Column, words: list[str]) -> Column:
    """Whether any of the words occurs anywhere."""
    return norm.rlike(P.trie_regex(words)) if words else F.lit(False)


def contained_keywords(norm: Column, words: list[str]) -> Column:
    """The distinct words that occur anywhere, in the order given."""
    return F.array_compact(F.array(*[F.when(norm.contains(w), F.lit(w)) for w in words])) if words else F.array().cast("array<string>")


def heat_of(hits: Column, heats: dict[str, float]) -> Column:
    """Sum of the heats of an array of keywords."""
    if not heats:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for pair in heats.items() for x in pair])
    return F.aggregate(hits, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))


def keyword_heat(norm: Column, heats: dict[str, float], safe: dict[str, float] | None = None) -> Column:
    """Heat of keywords and safe words, never below zero.

    Whole words count with multiplicity.  A keyword without a whole occurrence,
    but with one that has a boundary on one side, adds a flat heat once.
    """
    words = list(heats)

    def score(v: Column) -> Column:
        partial = F.array_except(F.array_distinct(F.concat(v["starts"], v["ends"])), v["whole"])
        return F.greatest(F.lit(0.0), heat_of(v["whole"], heats) + F.size(partial) * C.PARTIAL_HEAT + heat_of(v["calm"], safe or {}))

    def hits(v: Column) -> Column:
        kinds = {"whole": (words, "whole"), "starts": (words, "start"), "ends": (words, "end"), "calm": (list(safe or {}), "whole")}
        return let({k: keyword_hits(v["norm"], w, kind) for k, (w, kind) in kinds.items()}, score)

    return let({"norm": norm}, hits)


def first_match(norm: Column, rows: list[tuple[str, str, int]]) -> Column:
    """The original word of the first configured pattern that occurs, or null.

    One alternation settles texts without any; only the others try each word.
    """
    if not rows:
        return F.lit(None).cast("string")
    some = norm.rlike(P.any_of([r[0] for r in rows]))
    each = F.coalesce(*[F.when(norm.rlike(regex), F.lit(word)) for regex, word, _ in sorted(rows, key=lambda r: r[2])])
    return F.when(some, each)


def spellings(norm: Column, rows: list[tuple[str, str, int]]) -> Column:
    """The first matched spelling of every pattern that occurs, in configured order."""
    each = [F.when(norm.rlike(regex), F.regexp_extract(norm, regex, 0)) for regex, _, _ in sorted(rows, key=lambda r: r[2])]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


def patterns_table(spark, configs: DataFrame) -> DataFrame:
    """One row per server: ``some``, an alternation of all its patterns, and ``patterns`` in configured order.

    The table is broadcast; it has ``MOST_SERVERS`` rows at most.
    """
    normalize = normalizer()
    rows = []
    servers = configs.select("id", "config.banned_words").limit(MOST_SERVERS + 1).collect()
    if len(servers) > MOST_SERVERS:
        raise ValueError(f"more than {MOST_SERVERS} configured servers")
    for r in servers:
        found = sorted(P.pattern_rows([w for w in r["banned_words"] or [] if w], normalize), key=lambda p: p[2])
        if found:
            rows.append((r["id"], P.any_of([p[0] for p in found]), [(p[0], p[1]) for p in found]))
    return spark.createDataFrame(rows, "server_id string, some string, patterns array<struct<regex: string, word: string>>")


def server_spellings(norm: str) -> Column:
    """The first matched spelling of every one of a row's ``patterns`` that the text holds, in configured order."""
    t = F.col(norm)
    held = F.filter("patterns", lambda p: F.rlike(t, p["regex"]))
    return F.when(F.expr(f"{norm} rlike some"), F.transform(held, lambda p: F.regexp_substr(t, p["regex"])))


def server_match(norm: str) -> Column:
    """``(spelling, word)`` of the first of a row's ``patterns`` that the text holds, or null.

    Only texts that the alternation ``some`` finds try the patterns one by one.
    """
    t = F.col(norm)
    first = F.filter("patterns", lambda p: F.rlike(t, p["regex"]))[0]
    found = F.struct(F.regexp_substr(t, first["regex"]).alias("spelling"), first["word"].alias("word"))
    return F.when(F.expr(f"{norm} rlike some"), found)


def detect_by_server(messages: DataFrame, patterns: DataFrame, norm: str = "norm") -> DataFrame:
    """Messages that hold one of their server's patterns, with the first one's ``original_word``.

    The configurations are broadcast and messages stay where they are.
    """
    found = messages.join(F.broadcast(patterns), "server_id").withColumn("_found", server_match(norm)).where("_found is not null")
    return found.withColumn("original_word", F.col("_found.word")).drop("some", "patterns", "_found")


def three_phases(norm: Column, context_norm: Column, packed_norm: Column, longer: Column, deletes: Column, rows) -> tuple[Column, Column]:
    """``(phase, word)`` of the first phase that finds a word: message, context, context without spaces."""
    a, b, c = (first_match(x, rows) for x in (norm, context_norm, packed_norm))
    b, c = F.when(longer & deletes, b), F.when(longer, c)
    phase = F.when(a.isNotNull(), "message").when(b.isNotNull(), "context").when(c.isNotNull(), "packed")
    return phase, F.coalesce(a, b, c)


def swapped(text: Column, source: str, target: str) -> Column:
    """The text with letters exchanged, or null where it has none of them."""
    return F.when(text.rlike(f"[{source}]"), F.translate(text, source, target))


def passes(text: Column) -> list[Column]:
    """The text as each pass of the multi-pass detector sees it, before normalisation; null skips a pass."""
    no_symbols = F.regexp_replace(F.regexp_replace(text, f"[{C.SYMBOLS_DROPPED}]", ""), f"[{C.SYMBOLS_SPACED}]", " ")
    return [
        text,
        swapped(text, "lL", "iI"),
        swapped(text, "iI", "lL"),
        swapped(text, "σΣς", "eee"),
        F.when(text.rlike(rf"\A.*[{C.SYMBOL_MARKS}].*\z"), no_symbols),
        F.when(text.rlike(rf"\A.*{C.SEPARATORS}.*\z"), F.regexp_replace(text, C.SEPARATORS, "")),
    ]


def decoded_base64(text: Column) -> Column:
    """Texts that base64-like runs decode to; invalid ones are left out."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/]{4,}={0,2}"), F.lit(0))
    return F.filter(F.transform(runs, lambda x: F.make_valid_utf8(F.try_to_binary(x, F.lit("base64")).cast("string"))), lambda x: x.isNotNull())


def decoded_binary(text: Column) -> Column:
    """Texts that runs of eight binary digits spell in printable ASCII."""
    runs = F.regexp_extract_all(text, F.lit(r"[01]{8}(?:[\s\-,]*[01]{8})*"), F.lit(0))

    def spell(run: Column) -> Column:
        bits = F.regexp_replace(run, r"[\s\-,]", "")
        codes = F.transform(F.sequence(F.lit(0), (F.length(bits) / 8).cast("int") - 1), lambda i: F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 10).cast("int"))
        return F.array_join(F.transform(F.filter(codes, lambda c: c.between(32, 126)), lambda c: F.char(c)), "")

    return F.transform(runs, spell)


def normalized_readings(df: DataFrame, columns: list[str]) -> DataFrame:
    """Array columns with every text normalised, in one Arrow pass."""

    def run(batches):
        f = normalizer()
        for pdf in batches:
            yield pdf.assign(**{c: pdf[c].map(lambda row: None if row is None else [f(t) for t in row]) for c in columns})

    return df.mapInPandas(run, df.schema)


def multipass(df: DataFrame, text: str, word: str) -> DataFrame:
    """Adds ``found``: whether any pass or suspicious decoding of the text holds the word.

    All readings of a text are normalised in one Arrow pass.
    """
    plain = normalizer()(word) or ""
    t = F.col(text)
    full = P.BEFORE_WORD + P.word_regex(plain, r"\s*") + P.AFTER_WORD
    bare = P.BEFORE_WORD + P.spaced(plain, r"\s*") + P.AFTER_WORD
    hidden = F.when(suspicious_encoding(t), F.concat(decoded_base64(t), decoded_binary(t))).otherwise(F.array().cast("array<string>"))
    seen = normalized_readings(df.withColumn("_seen", F.array(*passes(t))).withColumn("_hidden", hidden), ["_seen", "_hidden"])
    found = F.exists("_seen", lambda x: F.coalesce(x.rlike(full), F.lit(False))) | F.exists("_hidden", lambda x: F.coalesce(x.rlike(bare), F.lit(False)))
    return seen.withColumn("found", F.coalesce(found, F.lit(False)) & F.lit(bool(plain))).drop("_seen", "_hidden")


def offensive_ocr(text: Column, regexes: list[str]) -> Column:
    """What the first of the configured patterns matches in recognised text, or null."""
    each = [F.when(text.rlike(r), F.regexp_extract(text, r, 0)) for r in regexes]
    return F.coalesce(*each) if each else F.lit(None).cast("string")


def compare(messages: DataFrame, text: str, norm: str, word: str) -> DataFrame:
    """One row: how many messages the boundary matcher, the multi-pass detector, both and only one find."""
    rows = P.pattern_rows([word], normalizer())
    both = multipass(messages.withColumn("_live", first_match(F.col(norm), rows).isNotNull()), text, word)
    return both.agg(
        F.count("*").alias("n"),
        F.count_if("_live").alias("live"),
        F.count_if("found").alias("multipass"),
        F.count_if(F.col("_live") & F.col("found")).alias("both"),
        F.count_if(F.col("_live") != F.col("found")).alias("differ"),
    )
