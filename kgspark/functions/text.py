"""String functions of lookup and indexing, as Column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The common English stop words of text processing libraries, those with an apostrophe in both spellings.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself "
    "it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has "
    "had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn "
    "couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()


def clean(s: Column) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), r"(?U)\s+", " "))


def tokens(s: Column) -> Column:
    """Words between single blanks of a cleaned string; empty ones are kept, as in counts of blank-separated parts."""
    return F.split(s, " ")


def analysed(s: Column) -> Column:
    """What the name index holds: lower-case words between white space, none empty."""
    return F.filter(F.split(F.lower(s), r"(?U)\s+"), lambda t: t != "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length; two empty strings are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the larger set (at least 1); a and b are arrays, counted as sets."""
    most = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)), F.lit(1))
    return F.size(F.array_intersect(a, b)) / most


def token_set(s: Column) -> Column:
    """Words of a string in lower case, as a set."""
    return F.array_distinct(analysed(s))


def trigrams(s: Column, n: int = 3) -> Column:
    """Character n-grams within words; words shorter than n give none."""
    grams = F.transform(analysed(s), lambda t: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(grams))


def knowledge_graph(entity: Column) -> Column:
    """Which family of identifiers an id belongs to."""
    return F.when(entity.rlike(r"^[QP]\d+$"), "wikidata").otherwise("dbpedia")


def numeric_id(entity: Column) -> Column:
    """The number of an id such as Q42; null for other ids."""
    return F.when(entity.rlike(r"^[A-Z]\d+$"), F.substring(entity, F.lit(2), F.length(entity)).try_cast("long"))


def abbreviations(name: Column) -> Column:
    """Dotted forms of a person's name: the i-th abbreviates the first i words; the last word never, the 0-th is the name."""
    words = F.split(name, " ")
    last = F.size(words) - 1
    short = lambda i: F.array_join(F.transform(words, lambda w, j: F.when((j < i) & (j < last), F.concat(F.substring(w, 1, 1), F.lit("."))).otherwise(w)), " ")
    return F.transform(F.sequence(F.lit(0), last), short)


def round_half_even(x: Column, digits: int = 2) -> Column:
    return F.bround(x, digits)


def bag_of_words(s: Column, stopwords: list[str]) -> Column:
    """Distinct lower-case alphanumeric words without stop words."""
    words = F.filter(F.split(F.lower(F.trim(s)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in stopwords]))
