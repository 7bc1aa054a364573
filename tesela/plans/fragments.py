"""Pieces of SQL that the oracles share. Every oracle is written on its own terms; only the first cuts are common."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover

from tesela.functions import text as T

_WORD = r"\p{L}+(?:[-'']\p{L}+)*"
_TOKEN = r"<[A-Z]+>|\p{L}+(?:[-'']\p{L}+)*|\p{Nd}+(?:[.,:]\p{Nd}+)*|[^\s\p{Z}\p{L}\p{N}_]"

#: Tokens with their place, and lower-case words of documents.
TOK = f"""tok AS (
  SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS l FROM documents)),
word AS (SELECT doc_id, pos, lower(token) AS term FROM tok WHERE regexp_full_match(token, '{_WORD}'))"""

TF = TOK + """,
tf AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM documents)"""

COUNTS = TOK + """,
counts AS (SELECT term, count(*) AS c FROM word GROUP BY ALL)"""

#: Sentences with their place among those that hold a word.
SENT = r"""sent AS (
  SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS sent_id
  FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: regexp_matches(x, '\p{L}')) AS l FROM documents))"""

LANGUAGES = ("english", "german", "french", "spanish")


def stop_words(language: str) -> list[str]:
    """Spark's list for a language; needs a running session."""
    return sorted(set(StopWordsRemover.loadDefaultStopWords(language)))


def quoted(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# Short stop word lists for the queries whose oracle names them.
COMMON = ("a", "and", "au", "das", "de", "der", "des", "die", "du", "e", "el", "en", "et", "for", "in", "is", "it", "la", "las", "le", "les", "los", "of", "or", "que", "qui", "the", "to", "un", "una", "und", "une", "with", "y", "zu")

#: The normal form of a text: lower case, without signs, articles and doubled blanks.
FORM = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~¿¡«»…—–]', ' ', 'g'), '[\\s\\p{{Z}}]+'), lambda x: x <> '' AND x NOT IN (" + quoted(T.ARTICLES) + ")), ' ')"
