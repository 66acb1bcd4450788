"""Text columns: cleaning, folding to plain ASCII words, whole-phrase matching."""

from __future__ import annotations

import json
import string
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmosaic.functions.rules import COMPANY_NOISE, NOT_TOLD, REMOTE, WORKPLACE_EXACT, WORKPLACE_PARTS

#: What Python calls white space in a text, as a Java character class.
_WHITE = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
SPACES = rf"[{_WHITE}]+"


def _each(codes: Iterable[int], but: str = "") -> str:
    """Characters up to U+00FF one by one: of those Java makes one table for a class, of ranges a chain of comparisons that takes
    several times as long; and more again for a class with ^, or for a pattern with | in it."""
    return "".join(f"\\x{n:02x}" for n in codes if chr(n) not in but)


#: White space but for the plain space, in texts of ASCII alone and in others.
_ASCII_WHITE = _each([*range(0x9, 0xE), *range(0x1C, 0x20)])
_OTHER_WHITE = _ASCII_WHITE + _each([0x85, 0xA0]) + r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
#: All but letters, digits and the space, by what else is kept.
_NO_WORD = {keep: _each(range(0x100), f" {string.ascii_letters}{string.digits}{keep}") + r"\x{100}-\x{10ffff}" for keep in ("", "#+")}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values: list[str]) -> Column:
    """A constant array. Given as one text, as a call for each value makes plans slow to build; Spark folds it to a literal."""
    return F.split(F.lit("\x01".join(values)), "\x01") if values else F.array().cast("array<string>")


def mapping(pairs: dict[str, str]) -> Column:
    """A constant map, given in the same way."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def strip_ws(c: Column | str) -> Column:
    """No white space (Unicode) at the ends; null stays."""
    return F.regexp_replace(_col(c), f"^{SPACES}|{SPACES}$", "")


def squash_ws(c: Column | str) -> Column:
    """Each run of white space (Unicode) becomes one space, none at the ends; null becomes ''."""
    spaced = lambda text: F.when(_ascii(text), _spaced(text, _ASCII_WHITE)).otherwise(_spaced(text, _OTHER_WHITE))
    return F.trim(bound(F.coalesce(_col(c), F.lit("")), spaced))


def _spaced(text: Column, others: str) -> Column:
    """Runs of other characters (a class without the space) and spaces as one space."""
    single = lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, "  +", " ")).otherwise(t)
    return bound(F.regexp_replace(text, f"[{others}][{others} ]*", " "), single)


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def character(code: Column) -> Column:
    """The character of a code point (a long)."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numbered(code: Column) -> Column:
    """What a numeric reference stands for: 0x80 to 0x9F are read as Windows letters, what is no character becomes U+FFFD, and
    control characters and noncharacters vanish."""
    letters = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    gone = code.between(0x1, 0x8) | code.between(0xE, 0x1F) | (code == 0xB) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE).cast("long")) == 0xFFFE)
    letter = F.try_element_at(mapping(letters), code.cast("string"))
    return F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").when(letter.isNotNull(), letter).when(gone, "").otherwise(character(code))


#: What an entity begins with, after its ampersand; other ampersands stand alone.
_STARTS = "[A-Za-z][A-Za-z0-9]|#[0-9xX]"


def _entity(piece: Column) -> Column:
    """What follows an ampersand, with the entity it starts with (if it does) decoded."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        by_letter.setdefault(name[0], {})[name] = value
    table = F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")
    old = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)  # names that need no semicolon
    name = F.regexp_extract(piece, "^[^\\t\\n\\f <&#;]{1,32};?", 0)
    known = F.try_element_at(F.try_element_at(table, F.substring(name, 1, 1)), name)
    part = F.regexp_extract(name, f"^(?:{'|'.join(old)})", 0)
    short = F.try_element_at(F.try_element_at(table, F.substring(part, 1, 1)), part)
    rest = lambda used: F.substring(piece, F.length(used) + 1, F.length(piece))
    named = F.when(known.isNotNull(), F.concat(known, rest(name))).when(part != "", F.concat(short, rest(part))).otherwise(F.concat(F.lit("&"), piece))
    decimal, hexadecimal = F.regexp_extract(piece, "^#[0-9]+;?", 0), F.regexp_extract(piece, "^#[xX][0-9a-fA-F]+;?", 0)
    digits = lambda c: F.regexp_replace(c, "^#[xX]?0*|;$", "")
    code = lambda c, base, most: F.when(F.length(digits(c)) > most, None).otherwise(F.conv(F.concat(F.lit("0"), digits(c)), base, 10).cast("long"))  # noqa: E731  longer ones are beyond all characters
    spelled = lambda c, base, most: F.concat(F.transform(F.array(code(c, base, most)), _numbered)[0], rest(c))
    return F.when(decimal != "", spelled(decimal, 10, 7)).when(hexadecimal != "", spelled(hexadecimal, 16, 6)).otherwise(named)


def unescape(c: Column | str) -> Column:
    """Entities decoded once, as HTML says: names with and without semicolon, decimal and hexadecimal numbers."""
    text = _col(c)
    pieces = F.split(text, f"&(?={_STARTS})")
    decoded = bound(pieces, lambda p: F.concat(F.element_at(p, 1), F.array_join(F.transform(F.slice(p, 2, F.size(p)), _entity), "")))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def strip_tags(c: Column | str) -> Column:
    """Tags become spaces, then entities are decoded; null becomes ''."""
    untagged = lambda text: F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, "<[^>]+>", " ")).otherwise(text)
    return bound(bound(F.coalesce(_col(c), F.lit("")), untagged), unescape)


def strip_html(c: Column | str) -> Column:
    """Tags become spaces, then entities are decoded, then white space is squashed."""
    return squash_ws(strip_tags(c))


@lru_cache(maxsize=1)
def folding() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one plain character, those characters (then characters to delete), and what folds to several.

    Worked out from the Unicode data: compatibility decomposition without combining marks, in lower case."""
    single, target, delete, several = [], [], [], {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or char in "abcdefghijklmnopqrstuvwxyz0123456789":
            continue
        folded = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()
        if not folded:
            delete.append(char)
        elif folded != char and any(c.isascii() and c.isalnum() or c in "#+" for c in folded):
            if len(folded) == 1:
                single.append(char)
                target.append(folded)
            else:
                several[char] = folded
    return "".join(single + delete), "".join(target), several


#: A text with more different letters to fold is folded character by character.
MOST_LETTERS = 64


def _letters(text: Column) -> Column:
    """A text with its letters folded, but for A-Z. Each of its letters that folds is replaced in the whole text at once: there are
    few different ones in a text, and a table takes long for each character."""
    source, target, several = folding()
    table = mapping(several)
    own = F.array_distinct(F.split(F.regexp_replace(text, r"[\x00-\x7f]+", ""), ""))
    known = F.filter(own, lambda ch: F.contains(F.lit(source + "".join(several)), ch))
    to = lambda ch: F.when(F.contains(F.lit("".join(several)), ch), F.try_element_at(table, ch)).otherwise(F.translate(ch, source, target))
    one_by_one = F.array_join(F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    rare = F.length(F.translate(text, "".join(several), "")) < F.length(text)
    many = F.translate(F.when(rare, one_by_one).otherwise(text), source, target)
    # nothing that a letter folds to folds on, so their order doesn't matter
    folded = bound(known, lambda found: F.when(F.size(found) > MOST_LETTERS, many).otherwise(F.aggregate(found, text, lambda t, ch: F.replace(t, ch, to(ch)))))
    return F.when(_ascii(text), text).otherwise(folded)


def _fold(c: Column | str, keep: str) -> Column:
    folded = bound(F.coalesce(_col(c), F.lit("")), _letters)
    return F.lower(F.trim(_spaced(folded, _NO_WORD[keep])))


def normalize(c: Column | str) -> Column:
    """Plain words: no accents, lower case, anything but a-z and 0-9 as one space; null becomes ''."""
    return _fold(c, "")


def normalize_tech(c: Column | str) -> Column:
    """As normalize, but # and + stay."""
    return _fold(c, "#+")


def without_marks(norm_tech: Column | str) -> Column:
    """normalize of a text, from its normalize_tech."""
    marked = lambda t: F.contains(t, F.lit("#")) | F.contains(t, F.lit("+"))
    return bound(_col(norm_tech), lambda t: F.when(marked(t), F.trim(_spaced(t, "#+"))).otherwise(t))


def normalize_workplace(c: Column | str, folded: bool = False) -> Column:
    """The label of a work mode: exact names first, then parts of names; anything else is not told."""
    key = _col(c) if folded else normalize(c)
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in WORKPLACE_EXACT.items() for x in pair]), key)
    for part, label in WORKPLACE_PARTS:
        found = F.coalesce(found, F.when(F.contains(key, F.lit(part)), F.lit(label)))
    return F.coalesce(found, F.lit(NOT_TOLD))


def remote_if(c: Column | str, *parts: str) -> Column:
    """Remote if the plain text contains one of the parts, else not told."""
    key, says = normalize(c), F.lit(False)
    for part in parts:
        says = says | F.contains(key, F.lit(part))
    return F.when(says, F.lit(REMOTE)).otherwise(F.lit(NOT_TOLD))


def fingerprint(title: Column | str, company: Column | str) -> Column:
    return F.sha1(F.concat_ws("|", normalize(title), normalize(company)).cast("binary"))


def source_key(source: Column | str, external_id: Column | str) -> Column:
    return F.concat(F.coalesce(_col(source), F.lit("")), F.lit(":"), F.coalesce(_col(external_id), F.lit("")))


def searchable_text(title: Column | str, description: Column | str) -> Column:
    return normalize(F.concat_ws(" ", F.coalesce(_col(title), F.lit("")), F.coalesce(_col(description), F.lit(""))))


def slugify_term(term: Column | str) -> Column:
    return F.replace(normalize(term), F.lit(" "), F.lit("-"))


def company_identity(company: Column | str, folded: bool = False) -> Column:
    """The words that tell a company from others: at least three letters, no noise words, each once, in order of the alphabet."""
    words = F.split(_col(company) if folded else normalize(company), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*COMPANY_NOISE))
    return F.array_sort(F.array_distinct(kept))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def phrase_hits(text: Column | str, phrases: list[str]) -> Column:
    """The phrases that stand in a plain text as whole words, each once.

    The text's words are met with the phrases' first words; only phrases that begin with a word of the text are
    looked for. No row is exploded and no shuffle is needed."""
    by_first: dict[str, list[str]] = {}
    for phrase in dict.fromkeys(phrases):
        by_first.setdefault(phrase.split(" ")[0], []).append(phrase)
    table = mapping({first: "\x03".join(own) for first, own in by_first.items()})
    firsts = strings(list(by_first))

    def within(padded: Column) -> Column:
        candidates = F.flatten(F.transform(F.array_intersect(F.split(padded, " "), firsts), lambda w: F.split(F.try_element_at(table, w), "\x03")))
        return F.filter(candidates, lambda p: F.contains(padded, F.concat(F.lit(" "), p, F.lit(" "))))

    return bound(F.concat(F.lit(" "), _col(text), F.lit(" ")), within)


def has_phrase(hits: Column, phrases: list[str]) -> Column:
    return F.arrays_overlap(hits, strings(phrases))
