"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from murmura import constants as C


def chars(text: str, some: str) -> str:
    return f"(length({text}) - length(translate({text}, '{some}', '')))"


def parts(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, '{part}', ''))) // {len(part)})"


def caps(text: str) -> str:
    ratio = f"(length(regexp_replace({text}, '[^\\p{{Lu}}]+', '', 'g'))::DOUBLE / nullif(length(regexp_replace({text}, '[^\\p{{L}}]+', '', 'g')), 0))"
    return f"""(CASE WHEN length({text}) > 35 AND {ratio} > 0.06 AND {ratio} < 0.4 THEN 0.1
      WHEN length({text}) > 10 AND {ratio} > 0.2 AND {ratio} < 0.4 THEN 0.05
      WHEN coalesce({ratio}, 0) > 0.7 OR coalesce({ratio}, 0) <= 0 THEN -0.1 ELSE 0 END)::DOUBLE"""


def size(text: str) -> str:
    return f"(CASE WHEN length({text}) > 2000 THEN 0.3 WHEN length({text}) > 500 THEN 0.05 WHEN length({text}) > 300 THEN 0.02 ELSE 0 END)::DOUBLE"


def punctuation(text: str) -> str:
    periods, ends, commas, quotes, lines = chars(text, "."), chars(text, ".?!"), chars(text, ","), chars(text, "''"), chars(text, "\n").replace("'\n'", "chr(10)")
    return f"""((CASE WHEN len(string_split_regex(regexp_replace({text}, '[.?!]+$', ''), '[.?!]')) > 1 AND {ends} > 1 AND {periods} > 0
        AND {periods}::DOUBLE / {ends} > 0.75 THEN 0.15 ELSE 0 END)::DOUBLE
      + least(0.1::DOUBLE, {commas} * 0.01::DOUBLE)
      + (CASE WHEN {quotes} >= 3 THEN least(0.2::DOUBLE, {quotes} * 0.05::DOUBLE) ELSE 0 END)::DOUBLE
      + (CASE WHEN regexp_full_match({text}, '[^\\n]*(\\?{{2,}}|!{{2,}})[^\\n]*') THEN 0.1 ELSE 0 END)::DOUBLE
      + {lines} * 0.1::DOUBLE + {lines} * ({lines} - 1) / 2 * 0.05::DOUBLE)"""


def debate(text: str) -> str:
    conditionals = " + ".join(parts(f"lower({text})", c) for c in C.CONDITIONALS)
    return f"""(least(0.2::DOUBLE, {chars(text, '?')} * 0.08::DOUBLE) + least(0.15::DOUBLE, ({conditionals}) * 0.05::DOUBLE)
      + (CASE WHEN {chars(text, '.?!')} > 2 AND length({text}) > 80 THEN 0.1 ELSE 0 END)::DOUBLE
      + (CASE WHEN {chars(text, '"')} >= 2 THEN 0.1 ELSE 0 END)::DOUBLE)"""


def heat(text: str, keywords: str = "0") -> str:
    return f"greatest(0::DOUBLE, {keywords}::DOUBLE + {caps(text)} + {size(text)} + {punctuation(text)} + {debate(text)})"


def normalized(text: str) -> str:
    """``normalize`` for ASCII and accented Latin letters."""
    return f"translate(strip_accents(lower({text})), '01345678@$!|*:''', 'oieasgtbasiiai')"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[\\p{{L}}\\p{{Nd}}]+')"


def keyword_heat(norm: str, heats: dict[str, float], safe: dict[str, float]) -> str:
    """For keywords of one word each."""
    w, out = words(norm), []
    for k, v in heats.items():
        n = f"len(list_filter({w}, lambda t: t = '{k}'))"
        part = f"len(list_filter({w}, lambda t: t <> '{k}' AND (starts_with(t, '{k}') OR ends_with(t, '{k}')))) > 0"
        out.append(f"(CASE WHEN {n} > 0 THEN {n} * {v}::DOUBLE WHEN {part} THEN {C.PARTIAL_HEAT}::DOUBLE ELSE 0::DOUBLE END)")
    out += [f"len(list_filter({w}, lambda t: t = '{k}')) * ({v})::DOUBLE" for k, v in safe.items()]
    return f"greatest(0::DOUBLE, {' + '.join(out)})"


AVERAGE_STEP = "CASE WHEN a = 0 THEN x WHEN x > a THEN 0.75::DOUBLE * x + 0.25::DOUBLE * a ELSE 0.5::DOUBLE * a + 0.5::DOUBLE * x END"
