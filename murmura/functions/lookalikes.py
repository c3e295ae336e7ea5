"""Letters of other scripts and signs, and the Latin letters that they stand for.

Each table is in code point order.  ``RUNS`` gives the first code point of a
script and what its letters stand for, one after the other.  Mathematical,
circled, accented and other forms with a compatibility decomposition follow from
Unicode data and aren't listed.
"""

# Whole runs of letters.
RUNS = {
    # U+13A0 to U+13EF; the small letters from U+AB70 on stand for the same
    "cherokee": (0x13A0, "aeiouiggggggggh" "hhhhlllgllmmmmmo" "nnnnnppppppgeqsq" "sssrrtttttwwwwww" "yyyzzzzzzzzzzzzzz"),
    # U+10300 to U+1031B
    "old italic": (0x10300, "abgdeqzhhijlmnnopfrstufhwooy"),
    # U+10330 to U+10348
    "gothic": (0x10330, "abgdeqzhhijlmnjupfrstufhw"),
    # U+1100 to U+1112
    "jamo": (0x1100, "ggnddrmbbssojjcktph"),
}
SMALL_CHEROKEE = 0xAB70

# Single letters, before decomposition.
LETTERS = {
    "latin": {
        "Ø": "o", "ø": "o", "ŋ": "n", "Ɓ": "b", "Ɔ": "c", "Ɖ": "d", "Ɗ": "d", "Ə": "e", "Ɠ": "g", "Ɩ": "i", "Ƙ": "k", "ƙ": "k", "Ɲ": "n",
        "Ƥ": "p", "ƥ": "p", "Ʃ": "s", "Ƭ": "t", "ƭ": "t", "Ʊ": "u", "Ƹ": "e", "ƹ": "e", "Ʌ": "v", "ɍ": "r", "Ɽ": "r", "Ʇ": "t",
    },
    "phonetic": {
        "ɒ": "o", "ɓ": "b", "ɔ": "o", "ɖ": "d", "ɗ": "d", "ə": "e", "ɚ": "e", "ɛ": "e", "ɜ": "e", "ɝ": "e", "ɞ": "e", "ɟ": "j", "ɠ": "g",
        "ɡ": "g", "ɢ": "g", "ɣ": "g", "ɥ": "h", "ɦ": "h", "ɧ": "h", "ɨ": "i", "ɩ": "i", "ɪ": "i", "ɬ": "l", "ɭ": "l", "ɮ": "l", "ɯ": "u",
        "ɰ": "m", "ɱ": "m", "ɲ": "n", "ɳ": "n", "ɴ": "n", "ɵ": "o", "ɶ": "o", "ɸ": "f", "ɹ": "r", "ɺ": "r", "ɻ": "r", "ɼ": "r", "ɽ": "r",
        "ɾ": "r", "ɿ": "r", "ʀ": "r", "ʁ": "r", "ʂ": "s", "ʃ": "s", "ʄ": "j", "ʅ": "r", "ʆ": "s", "ʇ": "t", "ʈ": "t", "ʉ": "u", "ʊ": "u",
        "ʋ": "v", "ʌ": "u", "ʍ": "w", "ʎ": "l", "ʏ": "y", "ʐ": "z", "ʑ": "z", "ʒ": "z", "ʓ": "z", "ʝ": "j", "ᶦ": "i",
    },
    "greek": {
        "Ί": "i", "Α": "a", "Β": "b", "Γ": "g", "Ε": "e", "Ζ": "z", "Η": "n", "Ι": "i", "Κ": "k", "Λ": "l", "Ν": "n", "Ο": "o", "Π": "n",
        "Ρ": "p", "Σ": "s", "Τ": "t", "ί": "i", "α": "a", "β": "b", "γ": "g", "ε": "e", "ζ": "z", "η": "n", "ι": "i", "κ": "k", "λ": "l",
        "ν": "n", "ο": "o", "π": "n", "ρ": "p", "ς": "s", "σ": "s", "τ": "t",
    },
    "cyrillic": {
        "Є": "e", "А": "a", "В": "b", "Г": "g", "Д": "a", "Е": "e", "З": "z", "И": "i", "Й": "y", "К": "k", "Л": "l", "М": "m", "Н": "h",
        "О": "o", "П": "n", "Р": "p", "С": "c", "Т": "t", "У": "y", "Ф": "f", "Х": "x", "Ъ": "b", "Ы": "y", "Ь": "b", "Я": "r", "а": "a",
        "в": "b", "г": "g", "д": "a", "е": "e", "з": "z", "й": "y", "к": "k", "л": "l", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p",
        "с": "c", "т": "t", "у": "y", "ф": "f", "х": "x", "ъ": "b", "ы": "y", "ь": "b", "я": "r", "є": "e", "ҁ": "j", "ғ": "f", "ҕ": "g",
        "җ": "j", "ҙ": "z", "қ": "k", "ҡ": "k", "ң": "n", "ҥ": "n", "ҧ": "p", "ҩ": "s", "ҫ": "s", "ҭ": "t", "ҳ": "h", "ҵ": "c", "ҷ": "c",
        "ҹ": "j", "һ": "h", "ҽ": "e", "ҿ": "g",
    },
    "armenian": {
        "Ա": "a", "Բ": "b", "Գ": "g", "Ե": "e", "Ի": "r", "Կ": "k", "Ո": "o", "Ռ": "n", "Ս": "s", "Տ": "t", "Ր": "r", "Ւ": "u", "ա": "a",
        "բ": "b", "գ": "g", "ե": "e", "ի": "i", "կ": "k", "ո": "o", "ռ": "n", "ս": "s", "տ": "t", "ր": "r", "ւ": "u",
    },
    "thai": {"ภ": "n", "ั": "a", "ิ": "i", "ึ": "u", "ุ": "u", "เ": "e", "์": "a"},
    "arabic": {"ﻮ": "r"},
    "tibetan": {
        "ཀ": "k", "ག": "g", "ང": "n", "ཅ": "c", "ཆ": "c", "ཇ": "j", "ཉ": "n", "ཊ": "n", "ཎ": "n", "ཏ": "t", "ཐ": "t", "ད": "d", "ན": "n",
        "པ": "p", "ཕ": "p", "བ": "b", "མ": "m", "ཙ": "z", "ཚ": "z", "ཛ": "z", "ཝ": "w", "ཞ": "r", "ཟ": "z", "འ": "a", "ཡ": "y", "ར": "r",
        "ལ": "l", "ཤ": "s", "ཥ": "s", "ས": "s", "ཨ": "a", "ཱ": "a", "ི": "i", "ུ": "u", "ེ": "e", "ོ": "o",
    },
    "ethiopic": {
        "ሐ": "h", "ሑ": "h", "ሒ": "h", "ሓ": "h", "ር": "r", "ስ": "s", "ሸ": "s", "ኢ": "i", "ኣ": "a", "ኤ": "e", "እ": "o", "ኦ": "o", "ኧ": "a",
        "ኸ": "n", "ወ": "w", "ዪ": "i",
    },
    "cherokee": {"Ᏽ": "g"},
    "syllabics": {"ᐃ": "i", "ᐄ": "i", "ᐅ": "i", "ᑎ": "n", "ᑓ": "n", "ᑕ": "n", "ᑖ": "n", "ᕓ": "r", "ᕗ": "r", "ᖇ": "r"},
    "lisu": {"ꓔ": "e", "ꓕ": "e", "ꓞ": "r", "ꓣ": "g", "ꓧ": "n", "ꓰ": "a", "ꓱ": "i", "ꓲ": "i"},
    "cuneiform": {"\U000121a9": "e", "\U000121aa": "r"},
}

# Letters and signs that are replaced once more after decomposition.
AFTER = {
    "¡": "i", "ł": "l", "ƞ": "n", "Ǥ": "g", "ǥ": "g", "Ƞ": "n", "ɛ": "e", "ɢ": "g", "ɨ": "i", "ɳ": "n", "ʀ": "r", "Η": "n", "η": "n",
    "є": "e", "ന": "n", "സ": "n", "൩": "n", "ᴋ": "d", "ᴌ": "d", "₦": "n", "€": "e", "₲": "g", "℟": "r", "∃": "e", "∊": "e", "❡": "g",
}

#: Letters without a fixed value that look like Latin ones all the same.
MORE = {
    "cyrillic": {"ѕ": "s", "і": "i", "ј": "j", "ү": "y", "ԁ": "d", "ԛ": "q", "ԝ": "w"},
    "greek": {"υ": "u", "χ": "x", "ω": "w"},
    "armenian": {"հ": "h", "յ": "j", "ց": "g", "օ": "o"},
    "phonetic": {"ɑ": "a", "ʙ": "b", "ʜ": "h", "ʟ": "l", "ᴄ": "c", "ᴅ": "d", "ᴊ": "j", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z"},
    "signs": {"£": "l", "¥": "y", "đ": "d", "ħ": "h", "ŧ": "t", "₩": "w", "₵": "c"},
}


def letters() -> dict[str, str]:
    """Every letter that is replaced before decomposition."""
    out = {chr(first + i): c for first, row in RUNS.values() for i, c in enumerate(row)}
    first, row = RUNS["cherokee"]
    out |= {chr(SMALL_CHEROKEE + i): c for i, c in enumerate(row)}
    for table in LETTERS.values():
        out |= table
    return out


def more() -> dict[str, str]:
    """The letters of ``MORE`` in both cases."""
    small = {k: v for table in MORE.values() for k, v in table.items()}
    return small | {k.upper(): v for k, v in small.items() if len(k.upper()) == 1}
