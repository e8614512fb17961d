"""Tokens, n-grams and predicates on strings, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stopwords and the separators between tokens.
_WORDS = "a an and are as at by for has in is it of on or that the they this to with".split()
#: The set as it is applied by default: lower-case "in" is not in it, "In" is.
STOPWORDS = sorted({w for w in _WORDS if w != "in"} | {w.capitalize() for w in _WORDS})
STOPWORDS_FIXED = sorted({*_WORDS, *STOPWORDS})

_MARKS = "\\s\\u00a0!\"#$%&/'()*+,\\-.:;<=>?@\\[\\]^_`{|}"
SEPARATOR = f"[{_MARKS}]"
_SOLID = f"[^{_MARKS}]"
_PROTOCOLS = "https|http|ftps|ftp|file|mailto|rtsp"
_URL = r"[:/\p{Alnum}.\-*_+%?&=~]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(content: Column | str) -> Column:
    """Text of bytes; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(_col(content).cast("string"))


def tokenise(text: Column | str, regex: str | None = None, stop: bool = True, url: bool = True, stopwords: list[str] | None = None) -> Column:
    """Array of tokens: the pieces between separators, without stopwords; null stays null.

    With ``url`` a token that is a protocol takes in the whole URL that follows it.
    """
    text = _col(text)
    solid, sep = (_SOLID, SEPARATOR) if regex is None else (None, regex)
    if url and solid:
        # The URL's run also eats what is glued to it; that is cut off again.
        found = F.regexp_extract_all(text, F.lit(rf"((?<!{solid})(?:{_PROTOCOLS})(?!{solid}){_URL}*{solid}*|{solid}+)"), F.lit(1))
        tokens = F.transform(found, lambda t: F.when(t.rlike(rf"\A(?:{_PROTOCOLS}){sep}"), F.regexp_extract(t, rf"\A{_URL}+", 0)).otherwise(t))
    else:
        tokens = F.filter(F.split(text, sep), lambda t: t != "")
    return drop_stopwords(tokens, stopwords) if stop else tokens


def drop_stopwords(tokens: Column, stopwords: list[str] | None = None) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(stopwords or STOPWORDS))


def builtin_tokenise(text: Column | str) -> Column:
    """Pieces between white space, double quotes, commas, parentheses and asterisks."""
    return F.filter(F.split(_col(text), r"""[\s",()*]+"""), lambda t: t != "")


def find_url(text: Column | str, at: int | Column = 0) -> Column:
    """The longest run of URL characters from ``at`` on."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.regexp_extract(F.substring(_col(text), at + 1, F.length(_col(text))), rf"\A{_URL}+", 0)


def first_url(text: Column | str) -> Column:
    """The first URL of a known protocol, or null."""
    found = F.regexp_extract(_col(text), rf"(?:{_PROTOCOLS}):{_URL}+", 0)
    return F.when(found != "", found)


def plain_words(text: Column | str) -> Column:
    """Pieces between characters other than ASCII letters, digits and underscore."""
    # Java matches \W, the same set, some thirty times faster than the negated class written out.
    return F.filter(F.split(_col(text), r"\W+"), lambda t: t != "")


def ngrams(words: Column, n: int = 2, down_to: int | None = None, distinct: bool = False) -> Column:
    """Comma-joined runs of ``n`` words (and of fewer, down to ``down_to``); none if there are fewer words.

    A run that holds a null word is null.
    """

    def of(w: Column, k: int) -> Column:
        out = w
        for i in range(1, k):
            n = F.greatest(F.size(w) - i, F.lit(0))
            out = F.zip_with(F.slice(out, F.lit(1), n), F.slice(w, F.lit(i + 1), n), lambda a, b: F.concat(a, F.lit(","), b))
        return out

    sizes = [n] if down_to is None else list(range(n, down_to - 1, -1))
    # As a lambda's variable the words are computed once, not once an n-gram.
    out = F.get(F.transform(F.array(words), lambda w: F.concat(*[of(w, k) for k in sizes])), 0)
    return F.array_distinct(out) if distinct else out


def is_content_word(word: Column | str, stopwords: list[str] | None = None) -> Column:
    """True for words that are not stopwords; null stays null."""
    return ~_col(word).isin(stopwords or STOPWORDS)


def has_stopword(*fields: Column | str, stopwords: list[str] | None = None) -> Column:
    """Whether any of up to five word fields, or any part of one comma-joined string, is a stopword."""
    words = F.split(_col(fields[0]), ",") if len(fields) == 1 else F.array(*map(_col, fields))
    return F.exists(words, lambda w: w.isin(stopwords or STOPWORDS))


def lengths_between(least: int, most: int, *fields: Column | str) -> Column:
    """Whether all words have lengths within inclusive bounds; -1 leaves a bound open."""
    if least == 0 or most == 0:
        raise ValueError("a bound of 0 makes no sense; -1 leaves it open")
    words = F.split(_col(fields[0]), ",") if len(fields) == 1 else F.array(*map(_col, fields))
    ok = lambda w: (F.lit(True) if least == -1 else F.length(w) >= least) & (F.lit(True) if most == -1 else F.length(w) <= most)
    return F.forall(words, ok)


def only_letters(text: Column | str) -> Column:
    return _col(text).rlike(r"\A[a-zA-Z,]+\z")


def fields_numeric(text: Column | str) -> Column:
    return _col(text).rlike(r"\A[,.\-+\p{Nd}]*\z")


def is_number(text: Column | str) -> Column:
    return _col(text).rlike(r"\A[.\-+\p{Nd}]*\z")


def fields_at_most(text: Column | str, most: int) -> Column:
    return F.forall(F.split(_col(text), ","), lambda w: F.length(w) <= most)


def fields_between(text: Column | str, least: int, most: int) -> Column:
    ok = lambda w: (F.lit(True) if least == -1 else F.length(w) >= least) & (F.lit(True) if most == -1 else F.length(w) <= most)
    return F.forall(F.split(_col(text), ","), ok)


LEFT, RIGHT, BOTH = 0, 1, 2


def chop(text: Column | str, side: int = BOTH, suffix: str | None = None) -> Column:
    """Without punctuation on the given side, unless there is punctuation inside; or without a literal suffix."""
    text = _col(text)
    if suffix is not None:
        return F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)
    pattern = r"\A(\p{Punct}*)([^\p{Punct}]*)(\p{Punct}*)\z"
    part = lambda i: F.regexp_extract(text, pattern, i)
    kept = {LEFT: F.concat(part(2), part(3)), RIGHT: F.concat(part(1), part(2)), BOTH: part(2)}[side]
    return F.when(text.rlike(pattern), kept).otherwise(text)


def split_date_time(text: Column | str, regex: str = r"\s") -> Column:
    """Struct of date and time, the first two non-empty pieces."""
    parts = F.filter(F.split(_col(text), regex), lambda x: x != "")
    return F.struct(F.get(parts, 0).alias("date"), F.get(parts, 1).alias("time"))


def remove_links(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"\b(http://|https://)\S*\b", "")


def log10(x: Column | str) -> Column:
    """As in IEEE arithmetic: minus infinity at zero, NaN below."""
    x = _col(x).cast("double")
    return F.when(x > 0, F.log10(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(x)
