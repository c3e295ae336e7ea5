"""Scalar scores of a message, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmura import constants as C
from murmura.functions.patterns import first_letters, trie_regex


def lit(x: float) -> Column:
    return F.lit(x)


def u16_len(text: Column) -> Column:
    """Length in UTF-16 code units; every length rule is written in these."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def count_char(text: Column, chars: str) -> Column:
    """Occurrences of any of some ASCII characters."""
    return sum((count_text(text, c) for c in chars), F.lit(0))


def count_text(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a non-empty ASCII substring, by the bytes that its removal saves."""
    saved = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))
    return saved if len(part) == 1 else (saved / len(part)).cast("int")


def strip_markdown(text: Column) -> Column:
    """Bold, italic, struck, spoiler and code marks, a leading header or quote mark, and link targets go."""
    for pattern, by in MARKDOWN:
        text = F.regexp_replace(text, pattern, by)
    return text


# The markup that is removed, in this order.
MARKDOWN = [
    (r"\*\*(.+?)\*\*", "$1"),
    (r"__(.+?)__", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"_([^_]+)_", "$1"),
    (r"~~(.+?)~~", "$1"),
    (r"\|\|(.+?)\|\|", "$1"),
    (r"```[\s\S]*?```", ""),
    (r"`([^`]+)`", "$1"),
    (r"^#+\s+", ""),
    (r"^>\s+", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
]


def java_trim(text: Column) -> Column:
    """Characters up to U+0020 go from both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\A[\x00-\x20]+", ""), r"[\x00-\x20]+\z", "")


def strip_urls(text: Column) -> Column:
    return java_trim(F.regexp_replace(text, r"https?://\S+", ""))


def is_image_url(url: Column) -> Column:
    return url.rlike(C.IMAGE_URL)


def png_url(url: Column) -> Column:
    """Asks for PNG where a URL names a format."""
    return F.regexp_replace(url, "format=[^&]*", "format=png")


def let(values: dict[str, Column], body) -> Column:
    """``body`` of a struct of values, each of which is computed once per row.

    Spark evaluates this outside generated code.  Written out instead, with its
    values repeated, the expression was level or slower: the texts' scans count,
    not the arithmetic around them.
    """
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def caps_score(text: Column) -> Column:
    upper = F.length(F.regexp_replace(text, r"[^\p{IsUppercase}&&[\x{0}-\x{FFFF}]]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}&&[\x{0}-\x{FFFF}]]+", ""))

    def score(v: Column) -> Column:
        r, n = F.when(v["letters"] > 0, v["upper"] / v["letters"]).otherwise(lit(0.0)), v["n"]
        return (
            F.when((n > 35) & (r > 0.06) & (r < 0.4), 0.1)
            .when((n > 10) & (r > 0.2) & (r < 0.4), 0.05)
            .when((r > 0.7) | (r <= 0.0), -0.1)
            .otherwise(0.0)
        )

    return let({"upper": upper, "letters": letters, "n": u16_len(text)}, score)


def length_score(text: Column) -> Column:
    n = u16_len(text)
    return F.when(n > 2000, 0.3).when(n > 500, 0.05).when(n > 300, 0.02).otherwise(0.0)


def punctuation_score(text: Column) -> Column:
    # several sentences: something follows a terminator
    several = text.rlike(r"[.?!][^.?!]")
    # a match of the whole text in which no line may end
    doubled = F.when(text.contains("??") | text.contains("!!"), text.rlike(r"\A.*(\?{2,}|!{2,}).*\z")).otherwise(text.isNull())

    def score(v: Column) -> Column:
        ends = v["periods"] + v["others"]
        many_periods = F.when(v["several"] & (ends > 1) & (v["periods"] > 0) & (v["periods"] / ends > 0.75), 0.15).otherwise(0.0)
        apostrophes = F.when(v["quotes"] >= 3, F.least(lit(0.2), v["quotes"] * 0.05)).otherwise(0.0)
        newlines = v["lines"] * 0.1 + v["lines"] * (v["lines"] - 1) / 2 * 0.05
        return many_periods + F.least(lit(0.1), v["commas"] * 0.01) + apostrophes + F.when(v["doubled"], 0.1).otherwise(0.0) + newlines

    counts = {k: count_char(text, c) for k, c in {"periods": ".", "others": "?!", "commas": ",", "quotes": "'", "lines": "\n"}.items()}
    return let({"several": several, "doubled": doubled, **counts}, score)


def debate_score(text: Column) -> Column:
    questions = F.least(lit(0.2), count_char(text, "?") * 0.08)
    conditionals = let({"lower": F.lower(text)}, lambda v: sum((count_text(v["lower"], c) for c in C.CONDITIONALS), F.lit(0)))
    structured = F.when((count_char(text, ".?!") > 2) & (u16_len(text) > 80), 0.1).otherwise(0.0)
    quoted = F.when(count_char(text, '"') >= 2, 0.1).otherwise(0.0)
    return questions + F.least(lit(0.15), conditionals * 0.05) + structured + quoted


def heat_index(text: Column, keyword_heat: Column | float = 0.0) -> Column:
    """The additive heat of a message, never below zero."""
    keywords = keyword_heat if isinstance(keyword_heat, Column) else lit(keyword_heat)
    return F.greatest(lit(0.0), keywords + caps_score(text) + length_score(text) + punctuation_score(text) + debate_score(text))


def event_heat(heat: Column, reply_depth: Column) -> Column:
    """Heat with the bonus for replies; no reply has depth 0 and loses 0.1."""
    return F.greatest(lit(0.0), heat + (reply_depth - 1) * 0.1)


def context_depth(length: Column) -> Column:
    out = None
    for below, depth in C.CONTEXT_DEPTHS:
        out = F.when(length < below, depth) if out is None else out.when(length < below, depth)
    return out.otherwise(0)


def timeout_seconds(level: Column, mode: Column, base: Column) -> Column:
    """Length of a timeout by infraction level and mode; unknown modes are flat.

    Factorial and exponential lengths stop at a day, also where they would
    overflow.
    """
    cap = F.lit(C.TIMEOUT_CAP).cast("long")
    product = F.when(level > 20, cap).otherwise(F.least(F.factorial(F.least(level, F.lit(20)).cast("int")), cap) * F.least(base, cap))
    power = F.least(F.pow(base.cast("double"), level.cast("double")), F.lit(float(C.TIMEOUT_CAP))).cast("long")
    length = F.when(F.lower(mode) == "factorial", F.least(product, cap)).when(F.lower(mode) == "exponential", power).otherwise(base.cast("long"))
    return F.when((level <= 0) | (base <= 0), F.lit(0).cast("long")).otherwise(length)


def format_duration(seconds: Column) -> Column:
    """``1d 2h 3m 4s`` without zero parts."""
    parts = [(86400, None, "d"), (3600, 86400, "h"), (60, 3600, "m"), (1, 60, "s")]
    shown = []
    for unit, within, mark in parts:
        n = F.floor((seconds if within is None else seconds % within) / unit)
        shown.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(mark))))
    return F.when(seconds <= 0, "0s").otherwise(F.concat_ws(" ", *shown))


def reaction_affection(emoji: Column) -> Column:
    out = F.when(emoji.isin(C.HEARTS), C.HEART_AFFECTION)
    for mark, value in C.REACTIONS.items():
        out = out.when(emoji == mark, value)
    return out.when(F.lower(emoji).contains("heart"), C.HEART_AFFECTION).otherwise(C.DEFAULT_AFFECTION)


def reply_affection(text: Column) -> Column:
    """Affection of an enthusiastic reply; null if it is none."""
    return F.when(text.rlike(r"\AY[EA]S+\z"), 0.15).when(text.rlike(r"\A(?i)y[ea]sss+\z"), 0.1)


def damped_affection(now: Column, incoming: Column) -> Column:
    """Affection after a damped change, held within the limits."""
    raw = F.when(now == 0, now + incoming).otherwise(now + incoming / F.abs(now))
    return F.greatest(lit(-C.AFFECTION_LIMIT), F.least(lit(C.AFFECTION_LIMIT), raw))


def alert_color(average: Column) -> Column:
    return F.when(average > 0.8, "orange-red").when(average > 0.5, "orange").otherwise("yellow")


def shorten(text: Column, most: int = C.SHORTEN_TO) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def heat_bar(heat: Column, cells: int = C.BAR_CELLS) -> Column:
    n = F.greatest(F.lit(0), F.least(F.lit(cells), F.floor(heat * cells).cast("int")))
    return F.concat(F.lit("["), F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(cells) - n), F.lit("]"))


def archive_line(ts: Column, author: Column, content: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), author, F.lit(": "), content)


def ocr_clean(text: Column) -> Column:
    return java_trim(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9 \n]", ""), "[ \t]+", " "))


def trigram_count(text: Column) -> Column:
    """Overlapping occurrences of common English trigrams, all in one scan."""
    at = first_letters(t[0] for t in C.TRIGRAMS) + "(?=" + trie_regex(list(C.TRIGRAMS)) + ")"
    return F.regexp_count(F.lower(text), F.lit(at))


def best_ocr(color: Column, gray: Column) -> Column:
    """The cleaned reading with more English trigrams; colour wins ties."""
    readings = {"a": ocr_clean(F.coalesce(color, F.lit(""))), "b": ocr_clean(F.coalesce(gray, F.lit("")))}
    return let(readings, lambda v: F.when(trigram_count(v["a"]) >= trigram_count(v["b"]), v["a"]).otherwise(v["b"]))


def archive_debate_score(text: Column) -> Column:
    """How much an archived message reads like a debate."""

    def score(v: Column) -> Column:
        lower, questions = v["lower"], v["questions"]
        phrases = sum((lower.contains(p).cast("int") for p in C.DEBATE_PHRASES), F.lit(0))
        conditionals = let({"n": sum((count_text(lower, c) for c in C.CONDITIONALS if c != " may "), F.lit(0))}, lambda w: F.when(w["n"] > 1, w["n"] * 0.3).otherwise(0.0))
        return (
            phrases.cast("double")
            + F.when(questions > 1, questions * 0.5).otherwise(0.0)
            + F.when((v["ends"] > 2) & (v["n"] > 100), 1.0).otherwise(0.0)
            + conditionals
            + F.when(v["quotes"] >= 2, 0.5).otherwise(0.0)
        )

    return let({"lower": F.lower(text), "questions": count_char(text, "?"), "ends": count_char(text, ".?!"), "quotes": count_char(text, '"'), "n": F.length(text)}, score)


def isolated_word(text: Column, word: str) -> Column:
    """Whether the raw text holds the word between word boundaries, in any ASCII case."""
    return text.rlike(rf"(?i)\b\Q{word}\E\b")


def suspicious_encoding(text: Column) -> Column:
    """A long text with a run that looks like base64 or binary digits."""
    return (u16_len(text) >= 50) & (text.rlike(r"\A.*[A-Za-z0-9+/]{20,}={0,2}.*\z") | text.rlike(r"\A.*[01]{30,}.*\z"))
