"""Full-text search with BM25.

An index is lazy: a search counts the tokens of each document in place and takes only occurrences of
words that can have a term of the query through a shuffle. ``build`` keeps all postings as a table, dealt
by term, for many searches. Stemmers: ``english`` (Snowball's revision of Porter's algorithm) and
``porter`` (the original); asking for another of the dialect's is an error, not a silent no-op.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.expr import col
from ..plans.session import cut

# Names of the stemmers that indexes of the dialect may ask for
STEMMERS = (
    "arabic basque catalan danish dutch english finnish french german greek hindi hungarian indonesian irish italian lithuanian "
    "nepali norwegian porter portuguese romanian russian serbian spanish swedish tamil turkish none"
).split()
IMPLEMENTED = ("english", "porter", "none")

# Common English function words
STOPWORDS = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing "
    "down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me "
    "more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the "
    "their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who "
    "whom why will with you your yours yourself yourselves".split()
)

VOWELS = "aeiou"


def _is_vowel(w: str, i: int) -> bool:
    return w[i] in VOWELS or (w[i] == "y" and i > 0 and not _is_vowel(w, i - 1))


def _measure(w: str) -> int:
    """Number of vowel-consonant sequences."""
    shape = "".join("v" if _is_vowel(w, i) else "c" for i in range(len(w)))
    return len(re.findall("v+c+", shape))


def _has_vowel(w: str) -> bool:
    return any(_is_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _is_vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _is_vowel(w, n - 3) and _is_vowel(w, n - 2) and not _is_vowel(w, n - 1) and w[-1] not in "wxy"


# Suffixes of steps 2, 3 and 4 of the published algorithm
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The stem of an English word by Porter's algorithm."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for rule in sorted(table, key=lambda r: -len(r.split(":")[0])):
            old, new = rule.split(":")
            if w.endswith(old):
                if _measure(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + new
                break
    for old in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(old):
            stem = w[: -len(old)]
            if _measure(stem) > 1 and (old != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w


# Endings, doubles and words of the published revision of the algorithm
_SNOWBALL_FIXED = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_SNOWBALL_AFTER_1A = "inning outing canning herring earring proceed exceed succeed".split()
_SNOWBALL_R1 = "gener commun arsen".split()
_SNOWBALL_2 = "ational:ate tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:".split()
_SNOWBALL_3 = "ational:ate tional:tion alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split()
_SNOWBALL_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"


def _region(w: str, begin: int) -> int:
    """Where the part behind the first consonant that follows a vowel begins."""
    m = re.compile("[aeiouy][^aeiouy]").search(w, begin)
    return m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search("(^|[^aeiouy])[aeiouy][^aeiouywxY]$", w) and len(w) > 2) or bool(re.fullmatch("[aeiouy][^aeiouy]", w))


def snowball(word: str) -> str:
    """The stem of an English word by the revised algorithm."""
    if len(word) <= 2:
        return word
    if word in _SNOWBALL_FIXED:
        return _SNOWBALL_FIXED[word]
    w = re.sub("(?<=[aeiouy])y", "Y", "Y" + word[1:] if word[0] == "y" else word)
    head = next((x for x in _SNOWBALL_R1 if w.startswith(x)), None)
    r1 = len(head) if head else _region(w, 0)
    r2 = _region(w, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _SNOWBALL_AFTER_1A:
        return w
    if w.endswith(("eed", "eedly")):
        cut_at = len(w) - (3 if w.endswith("eed") else 5)
        if cut_at >= r1:
            w = w[:cut_at] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                stem = w[: -len(end)]
                if re.search("[aeiouy]", stem):
                    if stem.endswith(("at", "bl", "iz")):
                        stem += "e"
                    elif stem.endswith(_DOUBLES):
                        stem = stem[:-1]
                    elif len(stem) <= r1 and _short_end(stem):
                        stem += "e"
                    w = stem
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for rule in sorted(_SNOWBALL_2, key=lambda r: -len(r.split(":")[0])):
        old, new = rule.split(":")
        if w.endswith(old):
            at = len(w) - len(old)
            if at >= r1 and (old != "ogi" or w[at - 1 : at] == "l") and (old != "li" or w[at - 1 : at] in list(_LI)):
                w = w[:at] + new
            break
    for rule in sorted(_SNOWBALL_3, key=lambda r: -len(r.split(":")[0])):
        old, new = rule.split(":")
        if w.endswith(old):
            at = len(w) - len(old)
            if at >= (r2 if old == "ative" else r1):
                w = w[:at] + new
            break
    for old in sorted(_SNOWBALL_4, key=len, reverse=True):
        if w.endswith(old):
            at = len(w) - len(old)
            if at >= r2 and (old != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def plain_text(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@dataclass(frozen=True)
class Analyzer:
    stemmer: str = "english"
    stopwords: str | Sequence[str] = "english"
    strip_accents: bool = True
    lower: bool = True

    def __post_init__(self) -> None:
        if self.stemmer not in STEMMERS:
            raise ValueError(f"unknown stemmer {self.stemmer!r}")
        if self.stemmer not in IMPLEMENTED:
            raise ValueError(f"the stemmer {self.stemmer!r} is not implemented, only {', '.join(IMPLEMENTED)}")

    @property
    def stem(self):
        return {"english": snowball, "porter": porter, "none": None}[self.stemmer]

    @property
    def stops(self) -> frozenset[str]:
        if isinstance(self.stopwords, str):
            return STOPWORDS if self.stopwords == "english" else frozenset()
        return frozenset(self.stopwords)

    def query_terms(self, text: str) -> list[str]:
        t = plain_text(text) if self.strip_accents else text
        t = t.lower() if self.lower else t
        words = [w for w in re.split(r"[^a-z]+", t) if w and w not in self.stops]
        return sorted(set(map(self.stem, words)) if self.stem else set(words))


class FtsIndex:
    """``words`` (id, field, words: the tokens that count), and postings (id, field, term, tf) once built."""

    def __init__(self, df: DataFrame, id_col: str, text_cols: Sequence[str], analyzer: Analyzer):
        self.df, self.id_col, self.text_cols, self.analyzer = df, id_col, list(text_cols), analyzer
        long = df.select(col(id_col).alias("__id"), *[col(c).alias(c) for c in text_cols]).unpivot(["__id"], list(text_cols), "field", "text")
        text = F.col("text")
        if analyzer.strip_accents:
            text = _strip_accents(text)
        if analyzer.lower:
            text = F.lower(text)
        words, stops = F.split(text, "[^a-z]+"), sorted(analyzer.stops)
        counts = (lambda w: (w != "") & ~w.isin(stops)) if stops else (lambda w: w != "")
        self.words = long.where("text IS NOT NULL").select("__id", "field", F.filter(words, counts).alias("words"))
        self.kept: DataFrame | None = None
        self.kept_lengths: DataFrame | None = None

    def _postings(self, words: DataFrame) -> DataFrame:
        counted = words.select("__id", "field", F.explode("words").alias("term")).groupBy("__id", "field", "term").agg(F.count("*").alias("tf"))
        if self.analyzer.stem is None:
            return counted
        # each distinct (document, word) is stemmed once
        return counted.withColumn("term", _stem(self.analyzer.stemmer)(F.col("term"))).groupBy("__id", "field", "term").agg(F.sum("tf").alias("tf"))

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """Occurrences of ``terms`` (of all terms by default)."""
        if self.kept is not None:
            return self.kept if terms is None else self.kept.where(F.col("term").isin(list(terms)))
        if terms is None:
            return self._postings(self.words)
        if self.analyzer.stem is None:
            may = lambda w: w.isin(list(terms))
        else:  # a stem begins as its words do, but for its last letter
            heads = sorted({t[: max(1, len(t) - 2)] for t in terms})
            may = lambda w: reduce(or_, [w.startswith(h) for h in heads])
        some = self.words.withColumn("words", F.filter("words", may)).where(F.size("words") > 0)
        return self._postings(some).where(F.col("term").isin(list(terms)))

    @property
    def lengths(self) -> DataFrame:
        if self.kept_lengths is not None:
            return self.kept_lengths
        return self.words.groupBy("__id").agg(F.sum(F.size("words")).alias("len")).where("len > 0")

    def build(self) -> FtsIndex:
        """Keep postings, dealt by term, and lengths as tables in the shared folder."""
        if self.kept is None:
            self.kept, self.kept_lengths = cut(self._postings(self.words).repartition("term").sortWithinPartitions("term")), cut(self.lengths)
        return self

    def close(self) -> None:
        self.kept = self.kept_lengths = None


def _stem(stemmer: str):
    own = {"english": snowball, "porter": porter}[stemmer]

    @F.pandas_udf(StringType())
    def stem(words: pd.Series) -> pd.Series:
        return words.map({w: own(w) for w in words.unique()})

    return stem


@F.pandas_udf(StringType())
def _strip_accents(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else plain_text(t))


def create_index(df: DataFrame, id_col: str, text_cols: Sequence[str] | str, build: bool = False, **options: object) -> FtsIndex:
    cols = [text_cols] if isinstance(text_cols, str) else list(text_cols)
    missing = [c for c in [id_col, *cols] if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    index = FtsIndex(df, id_col, cols, Analyzer(**options))
    return index.build() if build else index


def search(index: FtsIndex | None, text: str, limit: int | None = None, fields: Sequence[str] | None = None, k: float = 1.2, b: float = 0.75) -> DataFrame:
    """Matching rows with ``fts_score``, best first. The query's terms are few; postings are filtered by them."""
    if not isinstance(index, FtsIndex):
        raise ValueError("no index: call create_index first")
    terms = index.analyzer.query_terms(text)
    hits = index.postings(terms) if terms else index.postings().where("false")
    if fields:
        hits = hits.where(F.col("field").isin(list(fields)))
    per = hits.groupBy("__id", "term").agg(F.sum("tf").alias("tf"))
    df = per.groupBy("term").agg(F.count("*").alias("df"))
    lengths = index.lengths
    total = index.df.agg(F.count("*").alias("n")).crossJoin(lengths.agg(F.sum("len").alias("words")))  # single rows
    scored = per.join(F.broadcast(df), "term").join(lengths, "__id").crossJoin(F.broadcast(total))  # one row per query term; a single row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") + k * (1 - b + b * F.col("len") / (F.col("words") / F.col("n")))
    scores = scored.groupBy("__id").agg(F.sum(idf * F.col("tf") * (k + 1) / norm).alias("fts_score"))
    out = index.df.join(scores, col(index.id_col) == F.col("__id")).drop("__id").orderBy(F.desc("fts_score"), col(index.id_col))
    return out.limit(limit) if limit is not None else out
