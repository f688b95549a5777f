"""Quality verdicts by weak supervision, in built-in expressions only.

Rules look at one document each and vote good, bad, or abstain. How often each rule is right about good and about bad
documents is estimated from the votes alone by expectation-maximisation; a document is kept when the posterior
probability that it is good reaches one half. Documents enter the estimate as counts per vote pattern (at most
3 ** rules of them), so one pass reads the texts and every round of the estimate is a small aggregate.

Abstaining is no evidence. A rule is held to be no worse than chance: its bad vote never speaks for a document and its
good vote never against one. The first round takes documents with a bad vote for bad ones.

Defined results: null text is empty and has no words; rows are judged one by one, so repeated rows get equal verdicts;
an empty table gives an empty result; columns other than id and text are not read, and ``judge`` hands them through
unchanged whatever they are called. Repeated windows are found by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceworks.llm.common import SPACES, boxed, keyed, written

SYMBOLS = "#*$%&|<>"
ROUNDS = 25
#: Least words, and the most words in repeated windows per hundred, of the plain base rules.
LEAST_WORDS, MOST_REPEATED = 20, 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(ordered, lambda s: F.sort_array(F.transform(F.filter(
            s, lambda e, k: (F.get(s, k - 1)["x"] == e["x"]) | (F.get(s, k + 1)["x"] == e["x"])), lambda e: e["i"])))

    def total(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, k: acc + F.least(
            F.lit(width), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(width))))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(places(h), total))))


def measures(text: Column) -> Column:
    """Struct of all counts the rules look at, for one text."""
    per_word = let(F.filter(F.split(text, SPACES + "+"), lambda w: w != ""), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        _repeat_words(w, 8).alias("n_repeat_words")))
    per_line = let(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(per_word.alias("w"), per_line.alias("l"),
                    F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
                    (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    F.length(F.regexp_replace(text, "\\P{L}+", "")).cast("long").alias("n_letters"),
                    F.length(F.regexp_replace(text, "\\P{Lu}+", "")).cast("long").alias("n_capitals"))


def _share(part: str, whole: str, good: float, bad: float, least: int, high_is_bad: bool = True) -> Column:
    """Vote on ``part / whole``: 1 good, 0 bad, null (abstain) between the bounds or when ``whole`` is below ``least``."""
    share = F.col(part) / F.col(whole)
    is_bad, is_good = (share > bad, share <= good) if high_is_bad else (share < bad, share >= good)
    return F.when(F.col(whole) < least, None).when(is_bad, 0).when(is_good, 1)


def rules() -> dict[str, Column]:
    """The voting rules by name."""
    return {
        "symbols": _share("n_symbols", "n_words", 0.01, 0.1, 5),
        "symbol_chars": _share("n_symbols", "word_chars", 0.002, 0.02, 20),
        "capitals": _share("n_capitals", "n_letters", 0.15, 0.4, 20),
        "letters": _share("n_letters", "word_chars", 0.9, 0.7, 20, high_is_bad=False),
        "lines": _share("n_dup_lines", "n_lines", 0.1, 0.4, 3),
        "windows": _share("n_repeat_words", "n_words", 0.05, 0.3, 30),
        "vocabulary": _share("n_distinct", "n_words", 0.45, 0.3, 20, high_is_bad=False),
        "word_length": F.when(F.col("n_words") < 10, None).when(
            (F.col("word_chars") > 12 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")), 0).when(
            F.col("word_chars").between(4 * F.col("n_words"), 8 * F.col("n_words")), 1),
    }


def _estimate(patterns: DataFrame, names: list[str]) -> tuple[float, dict[str, tuple[float, float]]]:
    """Share of good documents, and per rule the chance of a bad vote on a good and on a bad document.

    Expectation-maximisation over the vote patterns, of which there are at most 3 to the number of rules: they are one
    array of one row, and the rounds are a fold over it.
    """
    rules_ = F.sequence(F.lit(0), F.lit(len(names) - 1))

    def total(weights: Column, what: Callable[[Column], Column]) -> Column:
        return F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + what(w))

    def learnt(weights: Column, before: Column) -> Column:
        """Maximisation: shares and chances from patterns weighted by how good and how bad they are."""
        def chance(side: str) -> Column:
            def of(rule: Column) -> Column:
                bad = total(weights, lambda w: F.when(F.get(w["votes"], rule) == 0, w[side]).otherwise(F.lit(0.0)))
                cast = total(weights, lambda w: F.when(F.get(w["votes"], rule).isNotNull(), w[side]).otherwise(F.lit(0.0)))
                return (bad + 1) / (cast + 2)

            return F.transform(rules_, of)

        def pair(good: Column, bad: Column) -> Column:
            # A rule that speaks against good documents more than against bad ones says nothing.
            return F.when(good > bad, F.struct(((good + bad) / 2).alias("good"), ((good + bad) / 2).alias("bad"))).otherwise(
                F.struct(good.alias("good"), bad.alias("bad")))

        prior = (total(weights, lambda w: w["g"]) + 1) / (total(weights, lambda w: w["g"] + w["b"]) + 2)
        return let(prior, lambda p: F.struct(p.alias("prior"), F.zip_with(chance("g"), chance("b"), pair).alias("chances"),
                                             (F.abs(p - before) < 1e-9).alias("done")))

    def weighted(good: Callable[[Column], Column]) -> Column:
        return F.transform("p", lambda p: let(good(p["votes"]), lambda g: F.struct(
            p["votes"].alias("votes"), (p["n"] * g).alias("g"), (p["n"] * (1 - g)).alias("b"))))

    def step(state: Column, _: Column) -> Column:
        """Expectation with what is known, then maximisation."""
        terms = F.transform(state["chances"], lambda c: F.struct(
            F.log(c["good"] / c["bad"]).alias("bad"), F.log((1 - c["good"]) / (1 - c["bad"])).alias("good")))

        def good(t: Column) -> Callable[[Column], Column]:
            def of(votes: Column) -> Column:
                said = F.zip_with(votes, t, lambda v, x: F.when(v == 0, x["bad"]).when(v == 1, x["good"]).otherwise(F.lit(0.0)))
                odds = F.aggregate(said, F.log(state["prior"]) - F.log(1 - state["prior"]), lambda acc, x: acc + x)
                return 1 / (1 + F.exp(-odds))

            return of

        new = let(terms, lambda t: let(weighted(good(t)), lambda w: learnt(w, state["prior"])))
        return F.when(state["done"], state).otherwise(new)

    start = let(weighted(lambda votes: F.when(F.array_contains(votes, 0), F.lit(0.05)).otherwise(F.lit(0.95))),
                lambda w: learnt(w, F.lit(0.5)))
    found = patterns.agg(F.collect_list(F.struct(
        F.array(*[F.col(n).cast("int") for n in names]).alias("votes"), F.col("n").cast("double").alias("n"))).alias("p"))
    last = found.where(F.size("p") > 0).select(
        F.aggregate(F.sequence(F.lit(2), F.lit(ROUNDS)), start, step).alias("s")).select("s.*").first()
    if last is None:
        return 1.0, {name: (0.5, 0.5) for name in names}
    return last["prior"], {name: (c["good"], c["bad"]) for name, c in zip(names, last["chances"])}


def posterior(prior: float, chances: dict[str, tuple[float, float]]) -> Column:
    """Probability of a good document, from the votes."""
    odds = F.lit(math.log(prior) - math.log(1 - prior) if prior < 1 else 50.0)
    for name, (on_good, on_bad) in chances.items():
        odds = odds + F.when(F.col(name) == 0, math.log(on_good / on_bad)).when(
            F.col(name) == 1, math.log((1 - on_good) / (1 - on_bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _judged(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ..) with measures, votes, base_failed, quality and ``kept`` instead of the text, written once."""
    others = [c for c in docs.columns if c != "text"]
    m = docs.select(*others, measures(F.col("text")).alias("m")).select(
        *others, "m.w.*", "m.l.*", "m.word_chars", "m.n_symbols", "m.n_letters", "m.n_capitals")
    names = list(rules())
    measured = written(m.withColumns(rules()), "quality")
    patterns = measured.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    prior, chances = _estimate(patterns, names)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("quality", posterior(prior, chances)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its measures, the rules' votes, base_failed, the posterior quality and ``kept``."""
    return _judged(keyed(docs, id_col, text_col))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is kept, with all their columns; they go along with their measures."""
    return _judged(boxed(docs, id_col, text_col).select("text", "row")).where("kept").select("row.*")
