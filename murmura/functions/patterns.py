"""Patterns of banned words: grammar variants, spaced-out letters and word boundaries."""

from __future__ import annotations

import math
import re
from itertools import islice

from murmura import constants as C

BEFORE, AFTER = rf"(?<!{C.ALNUM})", rf"(?!{C.ALNUM})"
# the multi-pass detector counts the underscore as part of a word
BEFORE_WORD, AFTER_WORD = r"(?<![\p{L}\p{Nd}_])", r"(?![\p{L}\p{Nd}_])"


def grammar_variants(word: str) -> list[str]:
    """The word, its plural, possessives, past and -ing forms, with doubled consonants where they fit."""
    out = [word, word + "s", word + "'s", word + "s'", word + ("d" if word.endswith("e") else "ed"), word + "ing"]
    vowels = set("aeiou")
    if len(word) >= 3:
        a, b, c = word[-3:].lower()
        consonant = [x in "abcdefghijklmnopqrstuvwxyz" and x not in vowels for x in (a, c)]
        if all(consonant) and b in vowels:
            out += [word + c + "ing", word + c + "ed"]
    return out


def space_variants(word: str):
    """All ``2 ** (n - 1)`` ways to put single spaces between letters, the first gap as the lowest bit."""
    for mask in range(1 << max(0, len(word) - 1)):
        yield "".join(c + (" " if i < len(word) - 1 and mask >> i & 1 else "") for i, c in enumerate(word))


def quoted(text: str) -> str:
    """The text as a regex, in the dialects of Java, Python and RE2."""
    return re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", text)


def spaced(word: str, gap: str = " ?") -> str:
    """A regex for the language of ``space_variants``; ``\\s*`` as gap also takes other white space."""
    return gap.join(quoted(c) for c in word)


def word_regex(word: str, gap: str = " ?") -> str:
    """One regex for all variants of a normalised word.  Apostrophes never survive normalisation."""
    forms = dict.fromkeys(v for v in grammar_variants(word) if "'" not in v)
    return "(?:" + "|".join(spaced(v, gap) for v in forms) + ")"


def bounded(regex: str) -> str:
    return BEFORE + regex + AFTER


def first_letters(letters) -> str:
    """A look-ahead for the first characters; most places of a text fail here, before any look-behind."""
    return "(?=[" + "".join("\\" + c if c in r"^-[]\&" else c for c in sorted(set(letters))) + "])"


def any_of(regexes: list[str]) -> str:
    """One regex for several of ``pattern_rows``."""
    bodies = [r.removeprefix(BEFORE).removesuffix(AFTER) for r in regexes]
    letters = [b.removeprefix("(?:").removeprefix("\\")[0] for b in bodies]
    return first_letters(letters) + BEFORE + "(?:" + "|".join(bodies) + ")" + AFTER


def pattern_rows(words: list[str], normalize) -> list[tuple[str, str, int]]:
    """``(regex, original word, ordinal)`` of each configured word, in order of the configuration.

    A later word takes a variant from an earlier one with the same spelling, so
    among equal normalised words the last original is reported.
    """
    last: dict[str, tuple[str, int]] = {}
    for i, word in enumerate(words):
        plain = normalize(word)
        if plain:
            last[plain] = (word, last.get(plain, ("", i))[1])
    return [(bounded(word_regex(plain)), word, i) for plain, (word, i) in last.items()]


def trie_regex(words: list[str]) -> str:
    """An alternation that shares prefixes, so a scan tests one branch per character."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def render(node: dict) -> str:
        parts = [quoted(c) + render(child) for c, child in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return f"(?:{body})?" if "" in node else body

    return render(root)


def prefix_free_layers(words: list[str]) -> list[list[str]]:
    """Groups in which no word begins another one."""
    layers: list[list[str]] = []
    for word in sorted(dict.fromkeys(words), key=lambda w: (len(w), w)):
        for layer in layers:
            if not any(word.startswith(w) for w in layer):
                layer.append(word)
                break
        else:
            layers.append([word])
    return layers


def keyspace(words: list[str], normalize) -> list[dict]:
    """How many spellings each word's detection covers."""
    rows = []
    for word in words:
        variants = grammar_variants(normalize(word) or "")
        n = sum(1 << max(0, len(v) - 1) for v in variants)
        factor = min(100, int(math.log(n) * 20))
        rows.append({"word": word, "grammar": len(variants), "spaced": n, "passes": n * 5, "total": n * 5 * factor})
    return rows


def first_variants(word: str, n: int) -> list[str]:
    return list(islice(space_variants(word), n))
