"""Text functions: columns in, columns out.

Patterns spell out Unicode classes, so Java here and RE2 in the SQL oracles read them alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token, by kind.
MARKER = r"<[A-Z]+>"
WORD = r"\p{L}+(?:[-']\p{L}+)*"
NUMBER = r"\p{Nd}+(?:[.,:]\p{Nd}+)*"
SIGN = r"[^\s\p{Z}\p{L}\p{N}_]"
TOKEN = f"{MARKER}|{WORD}|{NUMBER}|{SIGN}"
WORD_OR_NUMBER = r"\p{L}+|\p{Nd}+(?:[.,]\p{Nd}+)*"
JOINED_WORD = r"\p{L}+(?:['’-]\p{L}+)*"
SENTENCE_END = r"[.!?\n]+"

# Noise patterns and the markers that stand for them, in this order.
URL = r"https?://\S+|www\.\S+"
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.]+\b"
MENTION = r"(?U)(?<!\w)@\w+"
HASHTAG = r"(?U)(?<!\w)#(\w+)"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{200d}\x{fe0f}]+"
DATE = r"(?<!\p{Nd})\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{2,4}(?!\p{Nd})"
BARE_NUMBER = r"(?U)(?<![\w<])\p{Nd}+(?:[.,:]\p{Nd}+)*(?![\w>])"
AGENCY = r"^.{0,120}?\((?:EFE[\p{L}\p{N}_]*|AFP|AP|Reuters)\)\s*\.?\s*-?\s*"
#: Letters that may be doubled in Spanish.
DOUBLED = "clrCLR"
# Spanish articles and the signs that answers are compared without.
ARTICLES = ("el", "la", "los", "las", "un", "una", "unos", "unas", "lo", "al", "del")
ANSWER_SIGNS = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~¿¡«»…—–]"""
KERAS_FILTERS = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n]"""
NEGATIONS = ("no", "ni", "nunca", "jamás", "tampoco", "nada", "nadie", "ninguno", "ninguna", "sin")


def found(text: Column, pattern: str) -> Column:
    """All matches of the pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# ---- tokens


def blank_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s\p{Z}]+"), lambda x: x != "")


def tokens(text: Column) -> Column:
    return found(text, TOKEN)


def is_word(token: Column) -> Column:
    return token.rlike(f"^(?:{WORD})$")


def content_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-case words and numbers, without the given stop words."""
    low = F.transform(found(text, WORD_OR_NUMBER), lambda x: F.lower(x))
    return F.filter(low, lambda x: ~x.isin(*stop)) if stop else low


def joined_words(text: Column) -> Column:
    return found(F.lower(text), JOINED_WORD)


def sentences(text: Column) -> Column:
    """Pieces between sentence ends that hold a word."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda x: F.trim(x)), lambda x: x.rlike(r"\p{L}"))


def keras_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), KERAS_FILTERS, " "), " "), lambda x: x != "")


def pad_left(ids: Column, length: int) -> Column:
    """The last `length` ids, filled up with 0 on the left."""
    kept = F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), length)
    return F.concat(F.array_repeat(F.lit(0).cast("long"), length - F.size(kept)), kept)


def cut_right(ids: Column, length: int) -> Column:
    """The first `length` ids, filled up with 0 on the left."""
    return pad_left(F.slice(ids, 1, length), length)


# ---- characters


def normal_form(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form; Spark has none of its own."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.str.normalize(form)

    return run(text)


def without_accents(text: Column, keep_enye: bool = True) -> Column:
    """Letters without their marks; ñ and Ñ are letters of their own unless `keep_enye` is false."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        marks = regex.compile(r"(?<![nN])\p{Mn}|(?<=[nN])(?!̃)\p{Mn}" if keep_enye else r"\p{Mn}")
        for part in parts:
            yield part.str.normalize("NFD").map(lambda x: marks.sub("", x), na_action="ignore").str.normalize("NFC")

    return run(text)


# Latin letters with marks and the letters below them.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇýÿÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucAAAAAAEEEEIIIIOOOOOUUUUCyyY"


def plain_letters(text: Column, keep_enye: bool = True) -> Column:
    """`without_accents` for Latin-1 letters in normal form C, inside generated code."""
    return F.translate(text, MARKED + ("" if keep_enye else "ñÑ"), PLAIN + ("" if keep_enye else "nN"))


def squeeze(text: Column) -> Column:
    """Three or more equal letters become one, or two of a letter that Spanish doubles."""
    once = F.regexp_replace(text, rf"([\p{{L}}&&[^{DOUBLED}]])\1{{2,}}", "$1")
    return F.regexp_replace(once, rf"([{DOUBLED}])\1{{2,}}", "$1$1")


def mark_noise(text: Column, numbers: bool = True) -> Column:
    """Addresses, mentions, tags, emoji and, with `numbers`, dates and numbers become markers; a tag keeps its word."""
    out = F.regexp_replace(text, URL, " <URL> ")
    out = F.regexp_replace(out, EMAIL, " <EMAIL> ")
    out = F.regexp_replace(out, MENTION, " <USUARIO> ")
    # a tag's words in camel case are parted while the sign still marks them
    out = F.regexp_replace(out, r"(?U)(?<=#\w{1,60}(?<=[a-záéíóúüñ]))(?=[A-ZÁÉÍÓÚÜÑ])", " ")
    out = F.regexp_replace(out, HASHTAG, " $1 ")
    out = F.regexp_replace(out, EMOJI, " <EMOJI> ")
    if numbers:
        out = F.regexp_replace(F.regexp_replace(out, DATE, " <FECHA> "), BARE_NUMBER, " <NUM> ")
    return F.trim(F.regexp_replace(out, r"[\s\p{Z}]+", " "))


def lower_but_markers(token: Column) -> Column:
    return F.when(token.rlike(f"^{MARKER}$"), token).otherwise(F.lower(token))


def without_agency(text: Column) -> Column:
    return F.regexp_replace(text, AGENCY, "")


def normalized(
    text: Column,
    agency: bool = True,
    lower: bool = True,
    accents: bool = True,
    numbers: bool = True,
    squeezed: bool = True,
    words_only: bool = True,
    form: bool = False,
) -> Column:
    """The whole chain in its fixed order, as an array of tokens. `accents` keeps them; `form` first makes normal form C."""
    out = normal_form(text) if form else text
    if agency:
        out = without_agency(out)
    if squeezed:
        out = squeeze(out)
    out = tokens(mark_noise(out, numbers))
    if lower:
        out = F.transform(out, lower_but_markers)
    if not accents:
        out = F.transform(out, lambda t: plain_letters(t))
    return F.filter(out, lambda t: is_word(t) | t.startswith("<")) if words_only else out


# ---- answers


def answer_form(text: Column) -> Column:
    """Lower case, without signs, articles and doubled blanks; null is empty."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ANSWER_SIGNS, " ")
    return F.array_join(F.filter(blank_tokens(low), lambda x: ~x.isin(*ARTICLES)), " ")


def aliases(text: Column) -> Column:
    """Forms parted by a bar, trimmed; one empty form where there is none."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)


# ---- words put together again

# Signs without a blank before or after them.
NO_BLANK_BEFORE = ",.;:)]}?!»%…"
NO_BLANK_AFTER = "([{¿¡«"


def detokenized(words: Column) -> Column:
    """Running text of an array of tokens; quotation marks open and close in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("open"), F.lit(True).alias("glue"))

    def step(state: Column, token: Column) -> Column:
        quote = token == '"'
        closing = quote & state["open"]
        tight = state["glue"] | closing | (~quote & F.lit(NO_BLANK_BEFORE).contains(F.substring(token, 1, 1)) & (F.length(token) > 0))
        return F.struct(
            F.concat(state["out"], F.when(tight | (state["out"] == ""), F.lit("")).otherwise(F.lit(" ")), token).alias("out"),
            (state["open"] != quote).alias("open"),
            (F.when(quote, ~state["open"]).otherwise((F.length(token) == 1) & F.lit(NO_BLANK_AFTER).contains(token))).alias("glue"),
        )

    return F.aggregate(words, start, step, lambda s: s["out"])


# ---- n-grams


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, where inner functions see the value computed once and not again for every element."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def ngrams(words: Column, n: int) -> Column:
    """Runs of n tokens, each an array."""
    none = F.array().cast("array<array<string>>")
    return once(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.slice(w, i + 1, n))).otherwise(none))


def with_borders(words: Column, n: int, first: str = "<inicio>", last: str = "<fin>") -> Column:
    return F.concat(F.array_repeat(F.lit(first), n - 1), words, F.array(F.lit(last)))
