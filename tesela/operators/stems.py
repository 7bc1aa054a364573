"""Spanish stemming after the published Snowball algorithm (snowballstem.org). Each type of a vocabulary is stemmed once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOWELS = frozenset("aeiouáéíóúü")
# The suffix lists of the published algorithm.
PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
GERUND_ACCENTED = "iéndo ándo ár ér ír".split()
GERUND_PLAIN = "ando iendo ar er ir".split()
STANDARD = {
    "delete": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "ic": "adora ador ación adoras adores aciones ante antes ancia ancias acion".split(),
    "log": "logía logías".split(),
    "u": "ución uciones ucion".split(),
    "ente": "encia encias".split(),
    "amente": ["amente"],
    "mente": ["mente"],
    "idad": "idad idades".split(),
    "iv": "iva ivo ivas ivos".split(),
}
VERB_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
VERB_EN = "en es éis emos".split()
VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL = "os a o á í ó".split()
_ACUTE = str.maketrans("áéíóú", "aeiou")


def _longest(word: str, suffixes: list[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _after(word: str, start: int) -> int:
    """Place after the first consonant that follows a vowel, from `start`."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _regions(word: str) -> tuple[int, int, int]:
    r1 = _after(word, 0)
    r2 = _after(word, r1)
    n = len(word)
    rv = n
    if n > 2:
        if word[1] not in VOWELS:
            rv = next((i + 1 for i in range(2, n) if word[i] in VOWELS), n)
        elif word[0] in VOWELS:
            rv = next((i + 1 for i in range(2, n) if word[i] not in VOWELS), n)
        else:
            rv = 3
    return rv, r1, r2


def stem(word: str) -> str:
    """The stem of a word; markers in angle brackets stay."""
    if word.startswith("<"):
        return word
    w = word.lower()
    rv, r1, r2 = _regions(w)
    # attached pronouns
    if pronoun := _longest(w[rv:], PRONOUNS):
        base = w[: len(w) - len(pronoun)]
        if _longest(base[rv:], GERUND_ACCENTED):
            end = _longest(base[rv:], GERUND_ACCENTED)
            w = base[: len(base) - len(end)] + end.translate(_ACUTE)
        elif _longest(base[rv:], GERUND_PLAIN) or (base[rv:].endswith("yendo") and base.endswith("uyendo")):
            w = base
    changed = _standard(w, r1, r2)
    if changed == w:
        changed = _verb(w, rv)
    w = changed
    # residual suffix
    if end := _longest(w[rv:], RESIDUAL):
        w = w[: len(w) - len(end)]
    elif w[rv:].endswith(("e", "é")):
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ACUTE)


def _cut(w: str, start: int, *ends: str) -> str:
    """Without the first of the endings that lies after `start`."""
    for end in ends:
        if w.endswith(end) and len(w) - len(end) >= start:
            return w[: len(w) - len(end)]
    return w


def _standard(w: str, r1: int, r2: int) -> str:
    end = _longest(w, [s for group in STANDARD.values() for s in group])
    kind = next((k for k, group in STANDARD.items() if end in group), None)
    at = len(w) - len(end)
    if not end or at < (r1 if kind == "amente" else r2):
        return w
    base = w[:at]
    if kind == "ic":
        return _cut(base, r2, "ic")
    if kind == "log":
        return base + "log"
    if kind == "u":
        return base + "u"
    if kind == "ente":
        return base + "ente"
    if kind == "amente":
        if (less := _cut(base, r2, "iv")) != base:
            return _cut(less, r2, "at")
        return _cut(base, r2, "os", "ic", "ad")
    if kind == "mente":
        return _cut(base, r2, "ante", "able", "ible")
    if kind == "idad":
        return _cut(base, r2, "abil", "ic", "iv")
    if kind == "iv":
        return _cut(base, r2, "at")
    return base


def _verb(w: str, rv: int) -> str:
    end = _longest(w[rv:], VERB_Y)
    if end and w[: len(w) - len(end)].endswith("u"):
        return w[: len(w) - len(end)]
    end = _longest(w[rv:], VERB + VERB_EN)
    if not end:
        return w
    w = w[: len(w) - len(end)]
    return w[:-1] if end in VERB_EN and w.endswith("gu") else w


def stem_counts(counts: DataFrame) -> DataFrame:
    """Adds `stem` to a vocabulary."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(stem)

    return counts.withColumn("stem", run("term"))


def merged_share(counts: DataFrame, source: str, target: str) -> DataFrame:
    """Share of tokens whose target form several source values share."""
    several = counts.groupBy(target).agg(F.count_distinct(source).alias("values"), F.sum("c").alias("c"))
    return several.agg((F.sum(F.when(F.col("values") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("merged"))


def dispersed(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Lemmas with at least so many different stems. Needs `lemma`, `stem`."""
    return pairs.groupBy("lemma").agg(F.array_sort(F.collect_set("stem")).alias("stems")).filter(F.size("stems") >= least)
