"""Scalar rules of the diff and of the classifier as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docdelta.functions import patterns as P
from docdelta.functions.textnorm import alignment_key, dashed, literal_key, squeeze, strip


def full(text: Column, pattern: str) -> Column:
    """Whether the whole string matches."""
    return text.rlike(rf"^(?:{pattern})\z")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clip(text: Column, most: int) -> Column:
    """C4: squeezed; cut with an ellipsis where longer."""
    t = squeeze(text)
    cut = F.rtrim(F.substring(t, 1, most - 1), F.lit(P.SPACES))
    return F.when(F.length(t) > most, F.concat(cut, F.lit("…"))).otherwise(t)


def tokens(text: Column) -> Column:
    """Words and single other signs."""
    return F.regexp_extract_all(text, F.lit(P.TOKEN), F.lit(0))


def _tags(*pairs: tuple[Column, str]) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(test, F.lit(tag)) for test, tag in pairs))))


def change_tags(a: Column, b: Column) -> Column:
    """What kind of signs differ; case and the prefixes «не», «без» apart."""
    both = F.concat(a, b)
    bare = F.struct(*(F.replace(F.lower(literal_key(x)), F.lit(" "), F.lit("")).alias(n) for n, x in (("a", a), ("b", b))))
    prefixed = lambda k, p: (F.concat(F.lit(p), k["b"]) == k["a"]) | (F.concat(F.lit(p), k["a"]) == k["b"])
    return let(bare, lambda k: _tags(
        (F.lit(True), "literal"),
        (both.rlike(r"\p{L}"), "word"),
        (both.rlike(r"[\p{Nd}²³¹]"), "digit"),
        (both.rlike(rf"[^\p{{L}}\p{{N}}\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]"), "punctuation"),
        ((a != b) & (F.lower(a) == F.lower(b)), "case"),
        (prefixed(k, "не"), "prefix_ne"),
        (prefixed(k, "без"), "prefix_bez"),
    ))


def change_position(n1: Column, n2: Column, i1: Column, i2: Column, j1: Column, j2: Column) -> Column:
    """Whether a change stands at the start, the end, both or between."""
    start = F.least(i1, j1) <= 3
    end = (n1 - i2 <= 2) & (n2 - j2 <= 2)
    return F.when(start & end, "whole_block").when(start, "start").when(end, "end").otherwise("middle")


def block_kind(line: Column) -> Column:
    """table_row, list_item, heading or null."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    loud = (letters > 0) & (upper / F.greatest(letters, F.lit(1)) >= 0.7) & ~line.rlike(P.SENTENCE_END)
    return (
        F.when(F.contains(line, F.lit("|")), "table_row")
        .when(line.rlike(P.LIST_ITEM), "list_item")
        .when((F.length(line) <= 120) & (line.rlike(P.NUMBERED_HEADING) | loud), "heading")
    )


def split_long(text: Column, most: int = P.BLOCK_CAP) -> Column:
    """C11: whole sentences packed up to a cap; longer sentences sliced."""
    empty = F.array().cast("array<string>")
    slices = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: F.substring(s, i * most + 1, F.lit(most)))
    close = lambda acc: F.concat(acc["done"], F.when(acc["open"] != "", F.array(acc["open"])).otherwise(empty))
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))

    def step(acc: Column, s: Column) -> Column:
        longer = strip(F.concat(acc["open"], F.lit(" "), s))
        return (
            F.when(F.length(s) > most, state(F.concat(close(acc), slices(s)), F.lit("")))
            .when((acc["open"] != "") & (F.length(longer) > most), state(F.concat(acc["done"], F.array(acc["open"])), s))
            .otherwise(state(acc["done"], longer))
        )

    packed = F.aggregate(F.split(text, rf"(?<=[.!?…;:]){P.S}+", -1), state(empty, F.lit("")), step, close)
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)


def dash_equivalent(a: Column, b: Column) -> Column:
    """Different, but equal once dashes are hyphens."""
    return (a != b) & (dashed(a) == dashed(b))


def is_numbering(value: Column) -> Column:
    """C13"""
    return full(value, P.NUMBERING)


def technical_type(a: Column, b: Column) -> Column:
    """C14: the kind of a change that leaves the content equal."""
    both = F.concat(a, b)
    return (
        F.when(dash_equivalent(a, b), "dash")
        .when(F.contains(both, F.lit("**")) | F.contains(both, F.lit("#")), "markdown")
        .when(is_numbering(a) | is_numbering(b), "numbering")
        .when(literal_key(a) == literal_key(b), "line_wrap")
        .otherwise("numbering")
    )


def _digits(value: Column) -> Column:
    return full(value, r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]+")


def _either(a: str, b: str) -> Column:
    return F.when(F.col(a) != "", F.col(a)).otherwise(F.col(b))


def is_page_number() -> Column:
    """C15, over the candidate columns."""
    value = strip(_either("changed1", "changed2"))
    evidence = F.filter(F.array(literal_key(F.col("evidence1")), literal_key(F.col("evidence2"))), lambda x: x != "")
    edge = lambda s: F.coalesce((F.col(f"file{s}_block") <= 2) | (F.col(f"file{s}_block") >= F.greatest(F.lit(1), F.col(f"file{s}_page_block_count") - 1)), F.lit(False))
    return _digits(value) & (F.col("change_position") == "whole_block") & (F.size(evidence) > 0) & F.forall(evidence, _digits) & (edge(1) | edge(2))


def is_header_artifact() -> Column:
    """C16, over the candidate columns."""
    value = strip(_either("changed1", "changed2"))
    block = F.coalesce(F.when(F.col("file1_block") != 0, F.col("file1_block")), F.col("file2_block"))
    page = F.coalesce(F.when(F.col("file1_page") != 0, F.col("file1_page")), F.col("file2_page"))
    near = (F.col("change_position") == "whole_block") & (F.length(value) <= 80) & F.coalesce((page == 1) & (block <= 3), F.lit(False))
    letters = F.length(F.regexp_replace(value, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(value, r"[^\p{Lu}]", ""))
    loud = (letters > 0) & (upper / F.greatest(letters, F.lit(1)) >= 0.8)
    around = F.lower(F.concat_ws(" ", *(F.col(c) for c in ("evidence1", "evidence2", "previous1", "previous2", "next1", "next2"))))
    low = F.lower(value)
    at = F.call_function("locate", low, around)
    rest = F.when(at > 0, F.concat(F.substring(around, F.lit(1), at - 1), F.substring(around, at + F.length(low), F.length(around)))).otherwise(around)
    again = F.contains(rest, low)
    return near & (((value != "") & ~value.rlike(r"[\p{L}\p{N}]")) | (loud & (again | (F.col("file1_was_ocr") != F.col("file2_was_ocr")))))


def protection_tags(a: Column, b: Column) -> Column:
    """C17: what may not be hidden as technical."""
    both = F.concat(a, F.lit(" "), b)
    left, right = (F.regexp_extract_all(x, F.lit(P.PLAIN_WORD), F.lit(0)) for x in (a, b))
    low1, low2 = (F.transform(x, F.lower) for x in (left, right))
    apart = F.array_union(F.array_except(low1, low2), F.array_except(low2, low1))
    return _tags(
        (F.arrays_overlap(apart, F.array(F.lit("не"), F.lit("без"))), "negation"),
        (left != right, "word_change"),
        (both.rlike(r"[\p{Nd}²³¹]") & ~(is_numbering(a) | is_numbering(b)), "body_number"),
        (both.rlike(P.DATE), "date"),
        (both.rlike(P.AMOUNT), "amount"),
        (both.rlike(P.ABBREVIATION), "abbreviation"),
        ((F.size(left) > 1) | (F.size(right) > 1), "phrase"),
    )


def technical_rule() -> Column:
    """E5: the first deterministic rule that makes a candidate technical; else null."""
    left, right = strip(F.col("changed1")), strip(F.col("changed2"))
    some = F.when(left != "", left).otherwise(right)
    return (
        F.when(dash_equivalent(left, right), "dash")
        .when(is_numbering(left) | is_numbering(right), "numbering")
        .when((F.col("change_position") == "start") & full(some, P.LIST_MARKER), "list_marker")
        .when(full(some, P.MARKDOWN), "markdown")
        .when(is_page_number(), "page_number")
        .when(is_header_artifact(), "header_footer")
        .when((left != "") & (right != "") & (alignment_key(left) == alignment_key(right)), technical_type(left, right))
    )


def unfenced(text: Column) -> Column:
    """A model's answer without code fences; null as empty."""
    t = strip(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(t, rf"^```(?:{P.W}+)?{P.S}*", ""), rf"{P.S}*```\z", "")
    return F.when(t.startswith("```"), strip(bare)).otherwise(t)


DECISIONS = "struct<decisions:array<struct<candidate_id:string,category:string,technical_type:string,left_change:string,right_change:string,reason:string,confidence:double>>>"


def decisions(text: Column) -> Column:
    """The decisions of a model's answer; null where it is no such object."""
    return F.from_json(unfenced(text), DECISIONS)["decisions"]
