"""HTML and prose as Column expressions over the whole text."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers 128 to 159 mean the characters of this code page, as browsers read them.
C1_PAGE = "cp1252"
REPLACEMENT = "\ufffd"
#: The standard library's table of names; those that may stand without a semicolon have 2 to 6 characters.
NAMED = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
OPEN_NAMES = {name: value for name, value in html5.items() if not name.endswith(";")}
_SHORTEST, _LONGEST = min(map(len, OPEN_NAMES)), max(map(len, OPEN_NAMES))
#: A map is searched entry by entry, so names are dealt into many small ones.
_MAPS, _MARK = 128, "\x1f"


def _dealt(table: dict[str, str]) -> Column:
    """The table as an array of maps, which the optimizer folds to a constant."""
    maps: list[list[str]] = [[] for _ in range(_MAPS)]
    for name in table:
        maps[(ord(name[0]) * 7 + ord(name[-1]) * 3 + len(name) * 11) % _MAPS].append(name)
    return F.array(*[F.map_from_arrays(F.split(F.lit(_MARK.join(["", *own])), _MARK), F.split(F.lit(_MARK.join(["", *[table[n] for n in own]])), _MARK))
                     for own in maps])


def _found(table: Column, name: Column) -> Column:
    """The characters of a name; null where the table has none."""
    place = (F.ascii(name) * 7 + F.ascii(F.right(name, F.lit(1))) * 3 + F.length(name) * 11) % _MAPS
    return F.when(F.length(name) > 0, F.try_element_at(F.get(table, place), name))


def _reference(part: Column) -> Column:
    """What follows an ampersand, with the reference at its start decoded; unknown ones stay.

    Of names the whole one before a semicolon counts, else the longest that may stand without one.
    Numbers need no semicolon.
    """
    decimal = F.regexp_extract(part, "^#([0-9]+)", 1)
    hexadecimal = F.regexp_extract(part, "^#[xX]([0-9A-Fa-f]+)", 1)
    after = F.regexp_replace(part, "^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", "")
    digits = F.regexp_replace(F.concat(decimal, hexadecimal), "^0+(?=.)", "")
    code = F.when(F.length(digits) > 9, 0).when(decimal != "", digits.try_cast("long")).when(hexadecimal != "", F.conv(digits, 16, 10).try_cast("long"))
    page = F.array(*[F.lit(bytes([n]).decode(C1_PAGE, "replace")) for n in range(128, 160)])
    wrong = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    char = (F.when(wrong, REPLACEMENT).when(code.between(128, 159), F.get(page, (code - 128).cast("int")))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
    closed = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*);", 1)
    named = _found(_dealt(NAMED), closed)
    word = F.regexp_extract(part, f"^[A-Za-z][A-Za-z0-9]{{{_SHORTEST - 1},{_LONGEST - 1}}}", 0)
    lengths = F.sequence(F.length(word), F.lit(_SHORTEST - 1), F.lit(-1))
    prefixes = F.when(F.length(word) >= _SHORTEST, F.transform(lengths, lambda n: F.substr(word, F.lit(1), n)))
    prefix = F.get(F.filter(prefixes, lambda p: _found(_dealt(OPEN_NAMES), p).isNotNull()), 0)
    return F.when(code.isNotNull(), F.concat(char, after)) \
            .when(named.isNotNull(), F.concat(named, F.substr(part, F.length(closed) + 2))) \
            .when(prefix.isNotNull(), F.concat(_found(_dealt(OPEN_NAMES), prefix), F.substr(part, F.length(prefix) + 1))) \
            .otherwise(F.concat(F.lit("&"), part))


def decode_entities(text: Column) -> Column:
    """Text with its character references decoded once: by name, decimal and hexadecimal."""
    parts = F.split(text, "&", -1)
    decoded = F.transform(parts, lambda part, n: F.when(n == 0, part).otherwise(_reference(part)))
    return F.array_join(decoded, "")


LINE_BREAK = "[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"
# What stands between quotes in a tag may hold a >; a quote left open holds nothing, and the tag ends at the first >.
_REST = r"""(?:(?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+'|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\z))"""
# The markup of a page in the order a reader meets it, each alternative a state that it is in: comments (also those that end
# at once, or never), elements whose content is no markup and not shown, tags, and other things in angle brackets. What
# begins inside one of them is part of it, so all are found in one pass from left to right. A < before other characters is text.
MARKUP = ("(?is)<!---?>|<!--.*?(?:--!?>|\\z)"
          rf"|<(script|style)(?=[\s/>]){_REST}.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)"
          rf"|<[a-z]{_REST}|</[a-z][^>]*+(?:>|\z)|<[!?/][^>]*+(?:>|\z)")
OUTER_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, OUTER_SPACE, "")


def html_to_text(html: Column) -> Column:
    """Visible text of a document: one stripped, non-blank line per line of every text node.

    Markup is read as a browser's tokenizer does, broken or not: unclosed comments, scripts and tags reach
    to the end, stray < are text, names of references may lack their semicolon where HTML allows it.
    """
    body = F.regexp_replace(html, MARKUP, "\n")
    lines = F.transform(F.split(decode_entities(body), LINE_BREAK), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def keyword_score(text: Column, keywords: Column) -> Column:
    """Sum over the keywords of their non-overlapping, case-insensitive occurrences.

    Removing a word shortens the text by its length per occurrence. The lowered text and its
    length are bound once as a one-element array, not computed again for every keyword.
    """
    lowered = F.lower(text)
    bound = F.array(F.struct(lowered.alias("text"), F.length(lowered).alias("length")))

    def hits(body: Column, word: Column) -> Column:
        left = F.length(F.replace(body["text"], word, F.lit("")))
        return ((body["length"] - left) / F.length(word)).cast("int")

    return F.transform(bound, lambda body: F.aggregate(
        keywords, F.lit(0), lambda total, word: total + hits(body, F.lower(word))))[0]
