"""Text to tokens, as column expressions only.

The patterns use no look-around except in the ``FAST_`` forms, no back-reference except in ``shorten_runs``, and
nested repetition only where it is possessive, so that long texts cannot exhaust the
regex engine's stack. No branch limits a token's length.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable
from html.entities import html5, name2codepoint

from pyspark.sql import Column, functions as F

NUMBER_TOKEN = "$NUM$"

# --- fixed values -----------------------------------------------------------------
# Unicode classes spelled out, because \w, \d and \s are ASCII-only in Java.
_W = r"\p{L}\p{N}_"  # word character
_A = r"\p{L}\p{Nl}\p{No}"  # word character that is neither decimal digit nor underscore
_D = r"\p{Nd}"
_S = r"\s\x0B\x1C-\x1F\x85\p{Z}"  # white space

# Alternatives of the social-text tokeniser, tried in this order.
TOKEN_BRANCHES = {
    "url": r"(?:https?:/{1,3}|www\p{Nd}{0,3}\.|[a-z0-9.\-]+\.[a-z]{2,13}/)"
    rf"[^{_S}()<>{{}}\[\]]*[^{_S}()<>{{}}\[\]`!;:'\".,?«»“”‘’]",
    "phone": rf"(?:\+?[01][ *\-.)]*)?(?:\(?{_D}{{3}}[ *\-.)]*)?{_D}{{3}}[ *\-.)]*{_D}{{4}}",
    "emoticon": r"[<>]?[:;=8][\-o*']?[)\](\[dDpP/:}{@|\\]"
    r"|[)\](\[dDpP/:}{@|\\][\-o*']?[:;=8][<>]?|</?3",
    "html_tag": rf"<[^<>{_S}]+>",
    "arrow": r"-+>|<-+",
    "at_name": rf"@[{_W}]+",
    "hash_tag": rf"#+[{_W}]+[{_W}'\-]*[{_W}]+",
    "email": rf"[{_W}.+\-]+@[{_W}\-]+\.(?:[{_W}\-][{_W}\-]+|[{_W}\-]\.[{_W}\-]+)(?:\.[{_W}\-]+)*",
    "joined_word": rf"[{_A}][{_A}'\-_]+[{_A}]",
    "number": rf"[+\-]?{_D}+[,/.:\-]{_D}+[+\-]?",
    "word": rf"[{_W}]+",
    "ellipsis": rf"\.[{_S}.]*\.",
    "other": rf"[^{_S}]",
}
TOKEN_PATTERN = "|".join(f"(?:{p})" for p in TOKEN_BRANCHES.values())
# What Spark matches: letters up to white space, a comma or a last full stop are one token whatever branch is tried,
# and no token starts with white space, so most positions are settled without trying the branches.
FAST_TOKEN_PATTERN = "|".join(
    rf"{letters}++(?=,|\.?(?:[{_S}]|\z))" for letters in ("[a-z]", f"[{_A}]")
) + rf"|(?![{_S}])(?:{TOKEN_PATTERN})"

RUN_PATTERN = r"([^a-zA-Z0-9])\1{3,}"
# The same runs: Java tests a negated class of several ranges far slower than a look-ahead and any character.
FAST_RUN_PATTERN = r"(?s)(?![a-zA-Z0-9])(.)\1{3,}"
ENTITY_PATTERN = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
# ----------------------------------------------------------------------------------

#: References of an HTML text, which may end without a semicolon.
HTML_ENTITY_PATTERN = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?"


def html_pattern(only: str = "+") -> str:
    """Everything in an HTML string that is no text: tags, comments, and elements whose content is hidden.

    A quoted attribute value may hold ``>``; a quote elsewhere is a plain sign. What isn't closed reaches to the
    end of the string, so that no start is tried in vain and a scan stays linear. ``only`` makes quantifiers
    possessive, which keeps Java's matcher from recursing; as every first choice leads to a match, they match
    the same without it.
    """
    blank = r"[\t\n\f\r ]"
    value = rf"\"[^\"]*{only}(?:\"|\z)|'[^']*{only}(?:'|\z)|[^\t\n\f\r >\"'][^\t\n\f\r >]*{only}"
    inside = rf"(?:[^>=]+{only}|={blank}*{only}(?:{value})?{only})*{only}"
    after_name = rf"(?:[\t\n\f\r /]{inside})?{only}"
    hidden = "|".join(rf"<{n}{after_name}(?:>.*?(?:</{n}{after_name}(?:>|\z)|\z)|\z)" for n in ("script", "style", "template"))
    comment = r"<!--(?:-?>|.*?(?:--!?>|\z))"
    tag = rf"</?[a-z][^\t\n\f\r />]*{only}{inside}(?:>|\z)"
    return rf"(?is){hidden}|{comment}|{tag}|</>|<(?:[!?]|/[^a-z>])[^>]*{only}(?:>|\z)"


HTML_PATTERN = html_pattern()


@functools.lru_cache(maxsize=None)
def numeric_class() -> str:
    """Regex class of characters that count as numeric: \\p{N} and the letters with a numeric value."""
    letters = [
        chr(c)
        for c in range(0x110000)
        if chr(c).isnumeric() and not unicodedata.category(chr(c)).startswith("N")
    ]
    return r"[\p{N}" + "".join(letters) + "]"


@functools.lru_cache(maxsize=None)
def open_names() -> tuple[str, ...]:
    """Named references that hold even if other letters follow instead of a semicolon; longer ones first."""
    return tuple(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


@functools.lru_cache(maxsize=None)
def entity_map() -> dict[str, str]:
    """Character of every named entity, and of the numeric references that mean code page 1252."""
    chars = {name: chr(cp) for name, cp in name2codepoint.items()}
    chars["apos"] = "'"
    chars |= {name: html5[name] for name in open_names()}
    for byte in range(0x80, 0xA0):
        char = bytes([byte]).decode("cp1252", errors="ignore")
        if char:
            chars[f"#{byte}"] = char
    return chars


# The English stop words of Spark's StopWordsRemover, in its order.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
"""


def default_stop_words() -> tuple[str, ...]:
    """Spark's English stop words, sorted."""
    return tuple(sorted(set(ENGLISH_STOP_WORDS.split())))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decode_entities(text: Column, html: bool = True) -> Column:
    """Entities to characters in one pass, so ``&amp;lt;`` becomes ``&lt;``.

    As HTML, a reference needs no semicolon: a known name or number counts, else the longest name that may be left
    open, and the rest stays as written. Otherwise a reference needs one, and unknown references vanish.
    """
    return _bind(text, lambda t: F.when(t.contains("&"), _decode_all(t, html)).otherwise(t))


def _decode_all(text: Column, html: bool) -> Column:
    named = F.create_map(*[F.lit(x) for pair in entity_map().items() for x in pair])
    pattern = HTML_ENTITY_PATTERN if html else ENTITY_PATTERN

    def one(entity: Column) -> Column:
        body = F.regexp_extract(entity, "^&(.*?);?$", 1)
        hexadecimal = F.regexp_extract(body, "^#[xX]0*([0-9A-Fa-f]{1,8})$", 1)
        digits = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).otherwise(
            F.regexp_extract(body, "^#([0-9]+)$", 1)
        )
        point = digits.try_cast("int")
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        by_point = F.when(
            valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        )
        key = F.when(point.isNotNull(), F.concat(F.lit("#"), point.cast("string"))).otherwise(body)
        return F.coalesce(F.try_element_at(named, key), by_point, opened(entity) if html else F.lit(""))

    def opened(entity: Column) -> Column:
        name = F.regexp_extract(entity, f"^&({'|'.join(open_names())})", 1)
        rest = F.substr(entity, F.length(name) + 2)
        return F.when(name != "", F.concat(F.try_element_at(named, name), rest)).otherwise(entity)

    between = F.split(text, pattern, -1)
    entities = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(
        F.zip_with(
            between,
            entities,
            lambda plain, entity: F.concat(
                plain, F.when(entity.isNull(), F.lit("")).otherwise(one(entity))
            ),
        ),
        "",
    )


def strip_html(text: Column, sep: str = "") -> Column:
    """Text nodes of an HTML string joined by ``sep``; scripts, styles and comments vanish."""
    return decode_entities(F.regexp_replace(text, HTML_PATTERN, sep))


def display_text(text: Column) -> Column:
    """HTML as readable text: tags become line breaks, blank lines collapse."""
    lines = F.regexp_replace(strip_html(text, "\n"), r"[ \t\r\f]*\n[ \t\r\f\n]*", "\n")
    return F.regexp_replace(lines, r"^\n+|\n+$", "")


def shorten_runs(text: Column) -> Column:
    """Runs of four or more equal characters other than ASCII letters and digits become three."""
    return F.regexp_replace(text, FAST_RUN_PATTERN, "$1$1$1")


def tokenize(text: Column) -> Column:
    """Social-text tokens: entities decoded, long runs cut, then one alternation over the text."""
    clean = shorten_runs(decode_entities(text, html=False))
    return F.regexp_extract_all(clean, F.lit(FAST_TOKEN_PATTERN), F.lit(0))


def mark_numbers(tokens: Column) -> Column:
    """Tokens of numeric characters only become one marker.

    Numeric letters are all ideographs, so most tokens are settled by their first character.
    """
    first = min(c for c in numeric_class()[6:-1])
    candidate = rf"^[\p{{N}}{first}-\x{{10FFFF}}]"
    numeric = f"^{numeric_class()}+$"
    return F.transform(
        tokens,
        lambda t: F.when(t.rlike(candidate) & t.rlike(numeric), F.lit(NUMBER_TOKEN)).otherwise(t),
    )


def remove_stop_words(tokens: Column, words: tuple[str, ...] | None = None) -> Column:
    words = default_stop_words() if words is None else tuple(words)
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def unigrams_and_bigrams(tokens: Column) -> Column:
    """All tokens, then all pairs of neighbours joined by a blank."""

    def grams(ts: Column) -> Column:
        pairs = F.greatest(F.size(ts) - 1, F.lit(0))
        left, right = F.slice(ts, F.lit(1), pairs), F.slice(ts, F.lit(2), pairs)
        return F.concat(ts, F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b)))

    return _bind(tokens, grams)


def title_tokens(title: Column) -> Column:
    return mark_numbers(tokenize(F.lower(title)))


def description_tokens(description: Column, sep: str = "") -> Column:
    """Lower-casing comes before the HTML is stripped, so ``$NUM$`` keeps its case."""
    return mark_numbers(tokenize(strip_html(F.lower(description), sep)))
