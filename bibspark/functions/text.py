"""Column expressions over names, ids, years, tokens and markup."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words never counted as topics.
STOPWORDS = [
    "the", "and", "for", "with", "this", "that", "from", "are",
    "was", "were", "into", "their", "have", "has", "had", "using",
    "use", "used", "paper", "study", "method", "results", "based",
    "a", "in", "is", "of", "to", "on", "as", "by", "at", "an", "be",
]
# Fixed value: a topic word has at least so many letters.
MIN_TOKEN_LENGTH = 4


def year_from_date(date: Column) -> Column:
    """Year of a date string, null where its first four characters are no number."""
    return F.substring(date, 1, 4).try_cast("int")


def join_name_lists(authors: Column) -> Column:
    """[[last, first, suffix], ...] to ["last first suffix", ...]."""
    return F.transform(authors, lambda x: F.trim(F.concat_ws(" ", x)))


def join_name_structs(authors: Column) -> Column:
    """[{first, last}, ...] to ["first last", ...]; null parts are skipped."""
    return F.transform(authors, lambda x: F.trim(F.concat_ws(" ", x["first"], x["last"])))


def _name_words(name: Column) -> tuple[Column, Column, Column]:
    words = F.split(name, " ", -1)
    last = F.element_at(words, -1)
    first = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.size(words) >= 2, first, last


def split_name_list(name: Column) -> Column:
    """"A B C" to [C, "A B", ""]; a single word keeps its place as last name."""
    many, first, last = _name_words(name)
    return F.when(many, F.array(last, first, F.lit(""))).otherwise(
        F.array(name, F.lit(""), F.lit(""))
    )


def split_name_struct(name: Column) -> Column:
    """"A B C" to {first: "A B", last: C}; a single word becomes the first name."""
    many, first, last = _name_words(name)
    return F.struct(
        F.when(many, first).otherwise(name).alias("first"),
        F.when(many, last).otherwise(F.lit("")).alias("last"),
    )


def paper_key(title: Column, year: Column) -> Column:
    return F.sha2(F.concat_ws("", title, year.cast("string")), 256)


def strip_blanks(text: Column) -> Column:
    """Trim every Unicode blank and separator control, not only spaces."""
    blank = r"[\s\x{1c}-\x{1f}]+"
    return F.regexp_replace(text, f"(?U)^{blank}|{blank}$", "")


def non_blank(text: Column) -> Column:
    """The text, or null where it holds only blanks."""
    return F.when(strip_blanks(text) != "", text)


def tokens(text: Column) -> Column:
    """Lower-cased text split at each single space (blank tokens are kept)."""
    return F.split(F.lower(text), " ", -1)


def is_topic(token: Column, stopwords: list[str] = STOPWORDS) -> Column:
    return ~token.isin(stopwords) & (F.length(token) >= MIN_TOKEN_LENGTH)


def topic_tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """The topic words of a text as an array, without a shuffle."""
    return F.filter(tokens(text), lambda t: is_topic(t, stopwords))


def rebuild_text(inverted: Column) -> Column:
    """{word: [positions]} to text in position order; gaps are skipped.

    Where two words claim one position the later entry wins.
    """
    entries = F.map_entries(inverted)
    placed = F.flatten(
        F.transform(
            entries,
            lambda e, i: F.transform(
                e["value"],
                lambda p: F.struct(p.alias("pos"), i.alias("rank"), e["key"].alias("word")),
            ),
        )
    )
    # sort_array compares natively; array_sort would run a comparator lambda per pair.
    ordered = F.sort_array(placed)
    following = F.slice(ordered, 2, 1 << 30)
    pairs = F.arrays_zip(ordered.alias("here"), following.alias("next"))
    kept = F.filter(pairs, lambda x: x["next"].isNull() | (x["next"]["pos"] != x["here"]["pos"]))
    return F.array_join(F.transform(kept, lambda x: x["here"]["word"]), " ")


def _code_point(number: Column) -> Column:
    """The character of a numeric reference, by the rules HTML has for wrong ones."""
    wrong = {0: "\ufffd", 13: "\r"}
    for n in range(0x80, 0xA0):  # meant as Windows-1252
        try:
            wrong[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            wrong[n] = chr(n)
    table = F.create_map(*[F.lit(x) for n, c in wrong.items() for x in (n, c)])
    none = (
        number.between(1, 8) | number.between(0xE, 0x1F) | (number == 0xB) | (number == 0x7F)
        | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (
        F.when(number.isin(*wrong), F.element_at(table, number.cast("int")))
        .when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd")
        .when(none, "")
        .otherwise(plain)
    )


# The references of ordinary text come first: a lookup goes through the names in order.
_NAMES = dict.fromkeys(["amp;", "quot;", "lt;", "gt;", "nbsp;", "copy;", "middot;", "apos;"]) | html5
_NAMES = {name: html5[name] for name in _NAMES}
_NAMES_JSON = json.dumps(_NAMES)
# Names that count without a semicolon, also when more letters follow; longest first.
_OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def decode_references(text: Column) -> Column:
    """Character references of HTML replaced by their characters."""
    part = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
    # one literal, read once while the query is planned, instead of one for each name
    names = F.from_json(F.lit(_NAMES_JSON), "map<string,string>")

    def one(x: Column) -> Column:
        digits = F.regexp_replace(x, r"^&#[xX]?0*|;$", "")
        base16 = F.lower(F.substring(x, 3, 1)) == "x"
        value = F.when(base16, F.conv(digits, 16, 10)).otherwise(digits)
        number = F.when(F.length(digits) > 8, 0x110000).when(digits == "", 0).otherwise(value.cast("bigint"))
        name = F.substring(x, 2, 40)
        opening = F.regexp_extract(name, "^(" + "|".join(_OPEN_NAMES) + ")", 1)
        named = F.coalesce(
            F.try_element_at(names, name),
            F.when(
                opening != "",
                F.concat(F.try_element_at(names, opening), F.substr(name, F.length(opening) + 1)),
            ),
            x,
        )
        return F.when(~F.startswith(x, F.lit("&")) | (x == "&"), x).when(
            F.startswith(x, F.lit("&#")) & (F.length(x) > 2), _code_point(number)
        ).otherwise(named)

    found = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(part), F.lit(0)), one), "")
    return F.when(F.contains(text, F.lit("&")), found).otherwise(text)


def strip_markup(markup: Column) -> Column:
    """Visible text of HTML or JATS markup: each piece stripped, pieces joined.

    Tags, character references and blanks are all handled in the JVM.
    """
    body = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>", "")
    pieces = F.split(body, r"</?[a-zA-Z!?][^>]*>", -1)
    blank = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    return F.array_join(F.transform(pieces, lambda p: F.regexp_replace(decode_references(p), blank, "")), "")


def issued_year(issued: Column) -> Column:
    """First number of the first date part, if there is one."""
    return F.get(F.get(issued["date-parts"], F.lit(0)), F.lit(0))


def title_case(text: Column) -> Column:
    return F.initcap(text)
