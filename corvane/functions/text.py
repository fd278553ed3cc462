"""Text functions as built-in column expressions; only the stemmer runs Python (Arrow batches)."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a search question loses.
SEARCH_STOP = (
    "a an and are as at be by do does for from has have how i if in is it its of on or so that the this to was we what when where which who why will with you"
).split()
# Words that say nothing about paths or symbols, and what is added for symbols.
PATH_NOISE = "how does implement what handle manage function method class module file code work used using create make define call return type data value".split()
SYMBOL_NOISE = [*PATH_NOISE, *"show find look search describe explain this that with from into have been where which when will also each some".split()]
# Words that a context question loses.
QUERY_STOP = [*PATH_NOISE, *"the and for with from this that show find".split()]
STEM_SUFFIXES = "ors ers ing tion ment ness ity ies ous".split()
# Words a keyword list loses.
KEYWORD_STOP = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need must ought "
    "i me my we our you your he she it they them their this that these those what which who whom how where when why if then than but "
    "and or not no nor so yet both each all any few more most some such only own same too very just about above after again also as at "
    "before below between by down during for from in into of off on out over to up with"
).split()
# Words of an architecture question and what they stand for in code.
SYNONYMS = {
    "pipeline": ["workflow", "chain", "process", "pipe", "stage"],
    "middleware": ["handler", "interceptor", "filter", "hook"],
    "registry": ["register", "catalog", "factory", "provider"],
    "adapter": ["plugin", "connector", "driver", "bridge"],
    "injection": ["inject", "resolve", "depend", "wire"],
    "routing": ["route", "router", "dispatch", "endpoint", "path"],
    "indexing": ["index", "reindex", "delta", "catalog"],
    "dependency": ["depend", "resolve", "inject", "require"],
    "query": ["search", "retrieve", "lookup", "find", "fetch"],
    "session": ["connection", "pool", "client", "transport"],
    "hook": ["callback", "listener", "subscriber", "event"],
    "orm": ["model", "schema", "mapper", "table", "entity"],
    "task": ["job", "worker", "celery", "dispatch", "execute"],
    "runtime": ["scheduler", "executor", "loop", "spawn"],
}

TOKEN = r"[\p{L}\p{N}]+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits (an underscore separates)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), 0)


def fragments(names: Column) -> Column:
    """Sorted distinct lower-case camel and snake parts (two or more characters) of identifiers that have more than one part."""
    spaced = F.regexp_replace(F.regexp_replace(F.array_join(names, " "), "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    parts = F.flatten(F.transform(F.split(spaced, " "), lambda w: F.when(w.contains("_"), F.split(F.lower(w), "_")).otherwise(F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: F.length(p) > 1)))


def expanded(text: Column) -> Column:
    """Text with the fragments of its identifiers appended."""
    return F.concat_ws(" ", text, F.array_join(fragments(identifiers(text)), " "))


def search_terms(question: Column) -> Column:
    """Words of a question without stop words; other characters than letters, digits, _ and . go."""
    cleaned = F.transform(words(question), lambda w: F.regexp_replace(w, r"[^A-Za-z0-9_.]", ""))
    return F.filter(cleaned, lambda w: (w != "") & ~F.lower(w).isin(SEARCH_STOP))


def path_terms(question: Column) -> Column:
    """Distinct lower-case identifiers of four or more characters that are no noise, then their stems by suffix."""
    base = F.filter(F.transform(identifiers(question), F.lower), lambda w: (F.length(w) >= 4) & ~w.isin(PATH_NOISE))

    def stems(w: Column) -> Column:
        return F.array(*[F.when(w.endswith(s) & (F.length(w) - len(s) >= 4), F.substring(w, F.lit(1), F.length(w) - len(s))) for s in STEM_SUFFIXES])

    return F.array_distinct(F.concat(base, F.array_compact(F.flatten(F.transform(base, stems)))))


def compound_parts(word: Column) -> Column:
    """The word, and its snake parts or camel parts (lower case, two or more characters)."""
    snake = F.split(F.lower(word), "_")
    camel = F.split(F.lower(F.regexp_replace(word, "([a-z0-9])([A-Z])", "$1_$2")), "_")
    parts = F.filter(F.when(word.contains("_"), snake).otherwise(camel), lambda p: F.length(p) > 1)
    return F.array_distinct(F.concat(F.array(F.lower(word)), parts))


def query_terms(question: Column) -> Column:
    """Sorted set of a question's words (three or more characters, no stop words), neighbours joined by _, and synonyms."""
    plain = F.filter(F.flatten(F.transform(identifiers(question), compound_parts)), lambda w: (F.length(w) > 2) & ~w.isin(QUERY_STOP))
    neighbours = F.arrays_zip(plain.alias("a"), F.slice(plain, F.lit(2), F.greatest(F.size(plain), F.lit(1))).alias("b"))
    pairs = F.transform(F.filter(neighbours, lambda p: p["b"].isNotNull()), lambda p: F.concat_ws("_", p["a"], p["b"]))
    synonyms = F.array_compact(F.flatten(F.array(*[F.when(F.array_contains(plain, k), F.array(*map(F.lit, v))).otherwise(F.array(F.lit(None).cast("string"))) for k, v in SYNONYMS.items()])))
    return F.array_sort(F.array_distinct(F.concat(plain, pairs, synonyms)))


def is_architecture_question(question: Column) -> Column:
    return F.exists(F.array(*map(F.lit, SYNONYMS)), lambda k: F.contains(F.lower(question), k))


def keywords(text: Column, extra: list[str] | None = None) -> Column:
    """Distinct lower-case words of more than two letters without common ones, in order, then the extras."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0), lambda w: (F.length(w) > 2) & ~w.isin(KEYWORD_STOP))
    return F.array_distinct(F.concat(found, F.array(*map(F.lit, extra)))) if extra else F.array_distinct(found)


def anchors(text: Column, n: int = 8) -> Column:
    """The first distinct identifiers of three or more characters."""
    return F.slice(F.array_distinct(identifiers(text)), 1, n)


def import_line(module: Column, names: Column, alias: Column) -> Column:
    """An import as a line of code: names (array of name, alias) from a module, or the module itself."""
    one = lambda n: F.concat(n["name"], F.when(n["alias"].isNotNull(), F.concat(F.lit(" as "), n["alias"])).otherwise(""))
    whole = F.concat(F.lit("import "), module, F.when(alias.isNotNull(), F.concat(F.lit(" as "), alias)).otherwise(""))
    return F.when(F.size(names) > 0, F.concat(F.lit("from "), module, F.lit(" import "), F.array_join(F.transform(names, one), ", "))).otherwise(whole)


def once(rows: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """keep and the new columns, each computed once a row: a generated row is a step the optimizer does not copy expressions through."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def estimated_tokens(text: Column) -> Column:
    """Whole part of 1.3 tokens a word."""
    return F.floor(F.size(words(text)) * F.lit(13) / F.lit(10)).cast("long")


def _measure(stem: str) -> int:
    kinds, last = 0, False
    for i, c in enumerate(stem):
        vowel = c in "aeiou" or c == "y" and i > 0 and not last
        kinds += last and not vowel
        last = vowel
    return kinds


def _vowel(stem: str) -> bool:
    return any(c in "aeiou" or c == "y" and i > 0 and stem[i - 1] not in "aeiou" for i, c in enumerate(stem))


def _cvc(w: str) -> bool:
    v = [c in "aeiou" or c == "y" and i > 0 and w[i - 1] not in "aeiou" for i, c in enumerate(w)]
    return len(w) > 2 and not v[-1] and v[-2] and not v[-3] and w[-1] not in "wxy"


# The suffix tables of the published Porter algorithm.
_STEP2 = dict(zip("ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti".split(), "ate tion ence ance ize able al ent e ous ize ate ate al ive ful ous al ive ble".split(), strict=True))
_STEP3 = dict(zip("icate ative alize iciti ical ful ness".split(), ["ic", "", "al", "ic", "ic", "", ""], strict=True))
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """Stem by the published Porter (1980) algorithm."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEP2, _STEP3):
        end = max((s for s in steps if w.endswith(s)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + steps[end]
    end = max((s for s in [*_STEP4, "ion"] if w.endswith(s)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in "st"):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def folded(word: str) -> str:
    """The word without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)) if not word.isascii() else word


@F.arrow_udf(T.ArrayType(T.StringType()))
def folded_stems(tokens: pa.Array) -> pa.Array:
    """Stems of the tokens without their accents; a different word of a batch is stemmed once."""
    coded = tokens.flatten().dictionary_encode()
    stems = pa.array([w if w is None else porter(folded(w)) for w in coded.dictionary.to_pylist()], pa.string())
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pa.ListArray.from_arrays(ends, stems.take(coded.indices), mask=tokens.is_null())


def analysed(text: Column) -> Column:
    """What the index of code holds of a text, and what a question is asked by."""
    return folded_stems(tokens(text))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def stem(w: str) -> str:
        if w not in known:
            known[w] = porter(w)
        return known[w]

    return tokens.map(lambda ws: [stem(w) for w in ws])
