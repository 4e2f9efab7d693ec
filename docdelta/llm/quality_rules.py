"""Quality rules by distribution divergence (native).

Base rules: too few words, or too many words in repeated three-word windows.
The method: a histogram over character classes and one over common words are
compared with references of the document's language by Jensen-Shannon distance
(the square root of the divergence, base 2, from 0 to 1). A document is dropped
where a distance is above its limit. Each histogram has its own guard: it is not
judged in texts shorter than that.

References: the mean histograms over all documents of a language which pass the
base rules and the guard, so every document counts once however long it is. A
language with fewer than ``min_support`` such documents has no reference of its
own. Its characters are then compared with the mean over all documents of all
languages, to which ``min_support`` documents of ordinary prose are added (fixed
shares, PROSE; letters of any script are one class, so they hold for any
alphabet with blanks), so that a few documents are never their own measure. Its
common words, closed-class words listed by frequency, are compared with the mean
shares by rank over the languages that have a reference; without any such, and
for a language without word list, common words are not judged.

Defined cases
    null text: no words, fails the base rules; null lang: a language of its own
    (the same as an empty one) without word list; repeated rows: judged alike, each counts; empty table:
    no rows; extra columns are ignored whatever their names.

Scale: text is read once, into a table of counts and histograms (some 30 numbers
a document, in the shared folder); nothing but one histogram per language (a few dozen
numbers) crosses a shuffle, summed on the map side, so a hot language costs no
more than another one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docdelta.llm.exprs import let
from docdelta.plans.scratch import materialize

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent closed-class words.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "was", "with", "as", "by", "on", "be", "this", "are", "from", "at"],
    "fr": ["le", "la", "de", "et", "les", "des", "du", "un", "une", "en", "que", "qui", "dans", "pour", "par", "sur", "est", "au"],
    "de": ["der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "im", "des", "dem", "nicht", "ein", "eine", "auf", "als", "auch"],
    "es": ["el", "la", "de", "que", "y", "en", "los", "del", "las", "se", "un", "una", "con", "no", "por", "para", "es", "al"],
}
# What is removed after lower-case letters, class by class.
_LEFT = (r"[\x20\x09-\x0D]+", r"\p{Lu}+", "[0-9]+", r"[#*$%&|<>=+~^_@\\{}\[\]/!]+", "[.,;:?'\"()-]+", r"\p{L}+")
CLASSES = ["letter", "space", "upper", "digit", "symbol", "stop", "rest"]
# Shares of the classes in ordinary prose.
PROSE = [0.79, 0.16, 0.025, 0.003, 0.001, 0.02, 0.001]


def words_of(text: Column) -> Column:
    """Maximal runs of anything but the six white-space characters."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _gone(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def measures(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every document, with its words.

    Repeated windows: hashes of three words carry their position in the low bits
    and are sorted as plain longs; equal neighbours are confirmed word by word.
    """
    t = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = let(t, words=words_of(F.col("text")), lines=F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    t = let(t, n=F.size("words"), bits=F.length(F.bin(F.size("words").cast("long"))))
    hashed = F.transform(
        F.sequence(F.lit(0), F.col("n") - 3),
        lambda i: F.call_function("shiftleft", F.xxhash64(*(F.get("words", i + k) for k in range(3))), F.col("bits")).bitwiseOR(i.cast("long")),
    )
    t = let(t, keyed=F.when(F.col("n") < 3, F.array().cast("array<bigint>")).otherwise(F.sort_array(hashed)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    place = lambda a: a.bitwiseAND(mask).cast("int")
    alike = lambda a, b: (F.call_function("shiftright", a.bitwiseXOR(b), F.col("bits")) == 0) & (F.slice("words", place(a) + 1, 3) == F.slice("words", place(b) + 1, 3))
    repeats = F.filter(
        "keyed",
        lambda a, i: F.when((i > 0) & alike(a, F.get("keyed", i - 1)), True).otherwise(
            (i + 1 < F.size("keyed")) & F.coalesce(alike(a, F.get("keyed", i + 1)), F.lit(False))
        ),
    )
    t = let(t, hits=F.sort_array(F.transform(repeats, place)))
    covers = F.transform("hits", lambda p, i: F.when(i + 1 < F.size("hits"), F.least(F.lit(3), F.get("hits", i + 1) - p)).otherwise(3))
    symbols = sum((F.octet_length("text") - F.octet_length(F.replace("text", F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    return t.select(
        "doc_id", "lang", "text", "words",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covers, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
    )


def _histograms(t: DataFrame) -> DataFrame:
    """Adds chars (shares of CLASSES) and common (shares of the common words, the rest last)."""
    length = F.length("text")
    a = let(t, t1=_gone(F.col("text"), "[a-z]+"))
    for i, pattern in enumerate(_LEFT, 2):
        a = let(a, **{f"t{i}": _gone(F.col(f"t{i - 1}"), pattern)})
    steps = ["text", *(f"t{i}" for i in range(1, len(_LEFT) + 2))]
    lower, *middle, other, rest = [F.length(x) - F.length(y) for x, y in zip(steps, steps[1:])] + [F.length(steps[-1])]
    counts = [lower + other, *middle, rest]
    chars = F.array(*((c / F.greatest(F.length("text"), F.lit(1))).cast("double") for c in counts))
    # Double blanks, so that neighbouring hits do not share one.
    spaced = F.concat(F.lit(" "), F.lower(F.array_join("words", "  ")), F.lit(" "))
    lists = F.create_map(*(x for code, ws in COMMON.items() for x in (F.lit(code), F.array(*(F.lit(w) for w in ws)))))
    listed = F.try_element_at(lists, F.col("lang"))
    a = let(a.select(*t.columns, chars.alias("chars"), F.when(listed.isNotNull(), spaced).alias("spaced_"), listed.alias("listed_")), spaced=F.col("spaced_"), listed=F.col("listed_"))
    hits = F.transform(
        "listed",
        lambda w: (F.octet_length("spaced") - F.octet_length(F.replace(F.col("spaced"), F.concat(F.lit(" "), w, F.lit(" "))))) / (F.octet_length(w) + 2) / F.greatest(F.col("n_words"), F.lit(1)),
    )
    a = let(a, h=hits)
    rest = F.greatest(F.lit(0.0), 1 - F.aggregate("h", F.lit(0.0), lambda x, y: x + y))
    return a.select(*t.columns, "chars", F.concat("h", F.array(rest)).alias("common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length, base 2; rounded to 9 places."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.round(F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2)), 9)


def references(fit: DataFrame, min_support: int) -> tuple[dict[str, list[float]], dict[str, list[float]], list[float], list[float] | None]:
    """Character and word references by language, those of all languages, and word shares by rank.

    One row a language code reaches the driver, and only of languages with support.
    """
    width = max(map(len, COMMON.values())) + 1
    parts = {"chars": (len(CLASSES), F.col("fits_chars")), "common": (width, F.col("fits_words"))}
    sums = [F.sum(F.when(test, F.get(name, F.lit(i)))).alias(f"{name}{i}") for name, (n, test) in parts.items() for i in range(n)]
    by = fit.groupBy("code").agg(*sums, *(F.count_if(test).alias(f"n_{name}") for name, (_, test) in parts.items()))
    every = by.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in by.columns if c != "code")).first()
    own = by.filter((F.col("n_chars") >= min_support) | (F.col("n_common") >= min_support)).collect()
    mean = lambda r, name, n: [(r[f"{name}{i}"] or 0.0) / r[f"n_{name}"] for i in range(n)]
    chars = {r["code"]: mean(r, "chars", len(CLASSES)) for r in own if r["n_chars"] >= min_support}
    worded = [r for r in own if r["code"] in COMMON and r["n_common"] >= min_support]
    words = {r["code"]: mean(r, "common", width) for r in worded}
    star = [(every[f"chars{i}"] + min_support * p) / (every["n_chars"] + min_support) for i, p in enumerate(PROSE)]
    support = sum(r["n_common"] for r in worded)
    ranks = [sum(r[f"common{i}"] for r in worded) / support for i in range(width)] if worded else None
    return chars, words, star, ranks


def judge(
    docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, char_limit: float = 0.22, word_limit: float = 0.3, char_guard: int = 200, word_guard: int = 100, min_support: int = 50
) -> DataFrame:
    """Counts, distances and verdict of every document."""
    t = _histograms(measures(docs))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    t = t.select("*", failed.alias("base_failed"), (F.col("word_chars") >= char_guard).alias("judged_chars"), ((F.col("n_words") >= word_guard) & F.col("common").isNotNull()).alias("judged_words"))
    t = materialize(t.drop("text", "words").withColumn("code", F.coalesce("lang", F.lit(""))), "histograms")
    fit = t.filter(~F.col("base_failed")).withColumn("fits_chars", F.col("judged_chars")).withColumn("fits_words", F.col("judged_words"))
    chars, words, star, ranks = references(fit, min_support)
    listed = lambda by: F.from_json(F.lit(json.dumps(by)), "map<string,array<double>>")
    arr = lambda xs: F.lit(None).cast("array<double>") if xs is None else F.array(*(F.lit(float(x)) for x in xs))
    char_ref = F.coalesce(F.try_element_at(listed(chars), F.col("code")), arr(star))
    word_ref = F.coalesce(F.try_element_at(listed(words), F.col("code")), arr(ranks))
    t = t.select("*", distance(F.col("chars"), char_ref).alias("char_distance"), distance(F.col("common"), word_ref).alias("word_distance"))
    far = (F.col("judged_chars") & (F.col("char_distance") > char_limit)) | F.coalesce(F.col("judged_words") & (F.col("word_distance") > word_limit), F.lit(False))
    return t.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance",
    )
