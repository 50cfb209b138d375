"""Text normalisation as columns. What has no built-in (Unicode folding) is an Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Function words in folded form that carry no meaning of their own in a query.
STOPWORDS = (
    "a an and as at by do for i in is it my of on or the to when with should must have need can am me next week latest "
    "no not e s z does what where which who how why this that these those you your are was were be been there they "
    "their will would could from into about correct right der die das den dem des und oder ich sie er es wir ihr ihre "
    "ihrer ihrem ihren bei beim mit von vom vor nach auf aus an zu zur zum im um uber unter durch gegen ohne ab bis als "
    "wie wenn dass so nur auch noch schon wann was wer wo ein eine einer einem einen kein keine keinen nicht ist sind "
    "hat haben wird werden kann konnen muss mussen sich sein seine diese dieser dieses dies bin habe darf welche "
    "welcher welches will wollen mochte mochten soll sollen gilt gelten braucht brauche damit dafur dann denn doch hier "
    "dort jetzt man mich mir uns ihn ihm mein meine meiner meinem meinen unser unsere de la le les du et en au aux un "
    "une pour avec sur dans della delle del di il lo gli una che per con"
).split()
# Words for a property of a subject (address, opening hours), not for a subject.
FACET_WORDS = (
    "address addresses opening hours open phone telephone email e-mail contact "
    "Adresse Anschrift Öffnungszeiten Öffnungszeit geöffnet offen Telefon Telefonnummer E-Mail Kontakt "
    "Wegbeschreibung Anfahrt"
).split()
STEM = 6


def _folded(s: str | None) -> str | None:
    return None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))


def _normal(s: str | None) -> str | None:
    return None if s is None else " ".join(unicodedata.normalize("NFKC", s).replace("\u00ad", "").casefold().split())


def _arrow(one):
    """A function of strings as a vectorised column function."""

    def apply(text: pd.Series) -> pd.Series:
        return text.map(one)

    return F.pandas_udf(apply, T.StringType())


def fold(text: Column) -> Column:
    """Case folded, decomposed, without combining marks."""
    return _arrow(_folded)(text)


def normalise(text: Column) -> Column:
    """NFKC, no soft hyphens, case folded, single spaces."""
    return _arrow(_normal)(text)


def collapse_umlauts(token: Column) -> Column:
    """ae, oe and ue written out, in that order, become one letter."""
    for pair, letter in (("ae", "a"), ("oe", "o"), ("ue", "u")):
        token = F.replace(token, F.lit(pair), F.lit(letter))
    return token


def stem(token: Column) -> Column:
    return F.substring(token, 1, STEM)


def words(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0))


def tokens_of(folded: Column) -> Column:
    """Set of query tokens of folded text: elisions go, stop words go, then umlauts collapse, then stems."""
    plain = F.regexp_replace(folded, "\\b[a-z]['\u2019]", " ")
    kept = F.filter(words(plain), lambda w: ~w.isin(STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: stem(collapse_umlauts(w)))))


def tokens(text: Column) -> Column:
    return tokens_of(fold(text))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def line_key(line: Column) -> Column:
    """Lines that differ in spaces, case or digits only have one key."""
    return F.regexp_replace(F.lower(one_line(line)), "[0-9]", "#")


def join_soft_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=\\w)[\u0002\u00ad](?=\\w)", "")


def slug(label: Column, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def place_key(folded: Column) -> Column:
    return F.array_join(words(folded), " ")


def zone_key(zone: Column) -> Column:
    """Zones compare without case, spaces, hyphens, dots and underscores, and without a leading word for zone."""
    return F.regexp_replace(F.regexp_replace(F.lower(zone), r"[\s\-._]+", ""), "^(zone|kreis|gebiet)", "")


def contains_phrase(normal_text: Column, normal_phrase: Column) -> Column:
    return F.contains(normal_text, normal_phrase)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), F.trim), lambda p: p != "")


def missing_terms(terms: Column, excerpt: Column) -> Column:
    """Terms that the excerpt does not hold, ignoring case and spacing."""
    body = F.lower(one_line(excerpt))
    return F.filter(terms, lambda t: ~F.contains(body, F.lower(one_line(t))))


def question_language(text: Column, lists: dict[str, list[str]]) -> Column:
    """The language with most function words; null at a tie or without any."""
    found = F.split(F.lower(text), r"[^\p{L}]+")

    def votes(own: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(own)))

    counts = {k: votes(v) for k, v in lists.items()}
    best = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    winners = F.array_compact(F.array(*(F.when(n == best, F.lit(k)) for k, n in counts.items())))
    return F.when((best > 0) & (F.size(winners) == 1), winners[0])
