"""Quality rules, line first: lines that fail a rule go, then documents that fail as a whole or lost too much text.

DataFrame functions only. Everything about a document is computed inside its row, so there is no shuffle at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateweave.llm.common import BLANKS, blank_words, text_or_empty

SYMBOLS = "[#*$%&|<>]"
HAS_WORD = "[^ \\t-\\r]"


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules and of the document verdict.

    ``sentence_end`` has to close a line of fewer than ``short_line`` words. A line with at least ``menu_marks``
    menu separators and at most ``menu_words`` words between two of them is navigation. More than ``most_noise`` noise
    marks (symbols, doubled ``!`` or ``?``) a word are broken punctuation. ``boilerplate`` is matched in lower case. A document goes when more than ``most_lost`` of its word characters were in removed lines.
    """

    short_line: int = 4
    sentence_end: str = "[.!?;:…。！？][\"'”’»)\\]]*$"
    noise: str = "[#*$%&|<>]+|[!?]{2,}"
    most_noise: float = 0.3
    menu_marks: int = 3
    menu_words: int = 3
    menu_separator: str = "[|»›·•>]"
    boilerplate: str = ("(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept cookies"
                        "|enable javascript|released under the|licensed under the|spdx-license-identifier"
                        "|^copyright|^\\(c\\) [0-9]{4}|©|click here to|sign up for our|subscribe to our)")
    most_lost: float = 0.5
    fewest_words: int = 20
    most_repeated: int = 30


DEFAULT_RULES = LineRules()


RUN = 8


def run_keys(words: Column) -> Column:
    """A 64-bit hash of every run of ``RUN`` words."""
    def runs(hashes):
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (RUN - 1)), lambda i: F.xxhash64(F.slice(hashes, i, RUN)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < RUN, F.array().cast("array<bigint>")).otherwise(_let(hashes, runs))


def repeated_words(words: Column, keys: Column) -> Column:
    """How many words lie in a run of ``RUN`` words that occurs twice or more, the first time included.

    Runs are compared by ``run_keys``; runs whose hash repeats are compared word by word. The long way is taken only by
    texts in which a hash repeats.
    """
    def same(z):
        def run(side):
            return F.slice(words, z[side]["i"] + 1, RUN)

        return (z["a"]["h"] == z["b"]["h"]) & (run("a") == run("b"))

    def starts(order):
        # equal runs are neighbours after the sort; a run repeats if it equals the one before or after it
        pairs = F.filter(F.zip_with(F.slice(order, 2, F.size(order)), F.slice(order, 1, F.size(order) - 1),
                                    lambda a, b: F.struct(a.alias("a"), b.alias("b"))), same)
        found = F.flatten(F.transform(pairs, lambda z: F.array(z["a"]["i"], z["b"]["i"])))
        return F.array_sort(F.array_distinct(found))

    def covered(at):
        after = F.concat(F.slice(at, 2, F.size(at)), F.array(F.lit(2**31 - 1)))
        return F.aggregate(F.zip_with(after, at, lambda y, x: F.least(F.lit(RUN), y - x)), F.lit(0),
                           lambda total, x: total + x)

    order = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(
        _let(_let(order, starts), lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(covered(at))))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def line_fails(line: Column, rules: LineRules = DEFAULT_RULES) -> Column:
    """Whether a line with at least one word breaks a line rule."""
    def fails(trimmed):
        n_words = F.regexp_count(trimmed, F.lit("[^ \\t-\\r]+"))
        marks = F.regexp_count(trimmed, F.lit(rules.menu_separator))
        unfinished = (n_words < rules.short_line) & ~trimmed.rlike(rules.sentence_end)
        noisy = F.regexp_count(trimmed, F.lit(rules.noise)) > F.greatest(F.lit(1.0), rules.most_noise * n_words)
        menu = (marks >= rules.menu_marks) & (n_words - marks <= rules.menu_words * (marks + 1))
        return unfinished | noisy | menu | F.lower(trimmed).rlike(rules.boilerplate)

    return _let(F.btrim(line, F.lit(BLANKS)), fails)


def measured(docs: DataFrame, text: str = "text", rules: LineRules = DEFAULT_RULES) -> DataFrame:
    """``docs`` with the struct column ``quality``: counts, verdicts and the cleaned text.

    Fields: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines`` (with a word),
    ``n_removed_lines``, ``lost_chars`` (word characters in removed lines), ``base_failed``, ``kept``, ``clean_text``.

    A null text counts as an empty one; it has no words and is rejected. A text without a failing line keeps its exact
    characters; otherwise the remaining lines are joined by newlines, blank lines included. Rows do not influence each
    other, so ties, repeated rows and null ids need no rule; an empty table gives an empty table. Other columns are
    passed through; one called ``quality`` is replaced.
    """
    # one column per projection: Catalyst merges a struct's parts into their uses, and would split texts again per word
    work = {n: f"_quality_{n}" for n in ("text", "words", "lines", "filled", "failed", "keys")}
    t, w, lines, filled, failed = (F.col(work[n]) for n in ("text", "words", "lines", "filled", "failed"))
    step = docs.select(*[c for c in docs.columns if c != "quality"], text_or_empty(text).alias(work["text"]))
    step = step.withColumns({work["words"]: blank_words(t), work["lines"]: F.split(t, "\n")})
    step = step.withColumns({work["filled"]: F.filter(lines, lambda x: x.rlike(HAS_WORD)), work["keys"]: run_keys(w)})
    step = step.withColumn(work["failed"], F.filter(filled, lambda x: line_fails(x, rules)))

    def word_chars(c):
        return F.length(F.regexp_replace(F.array_join(c, ""), "[ \\t-\\r]+", ""))

    cleaned = F.when(F.size(failed) == 0, t).otherwise(F.array_join(
        F.filter(lines, lambda x: ~F.array_contains(failed, x)), "\n"))
    step = step.withColumn("quality", F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(filled) - F.size(F.array_distinct(filled))).cast("long").alias("n_dup_lines"),
        repeated_words(w, F.col(work["keys"])).cast("long").alias("n_repeat_words"),
        F.size(filled).cast("long").alias("n_lines"),
        F.size(failed).cast("long").alias("n_removed_lines"),
        F.when(F.size(failed) == 0, F.lit(0)).otherwise(word_chars(failed)).cast("long").alias("lost_chars"),
        cleaned.alias("clean_text"))).drop(*work.values())
    base = ((F.col("quality.n_words") < rules.fewest_words)
            | (100 * F.col("quality.n_repeat_words") > rules.most_repeated * F.col("quality.n_words")))
    lost_too_much = F.col("quality.lost_chars") > rules.most_lost * F.col("quality.word_chars")
    return step.withColumn("quality", F.col("quality").withField("base_failed", base)
                                                      .withField("kept", ~base & ~lost_too_much))


def clean(docs: DataFrame, text: str = "text", rules: LineRules = DEFAULT_RULES) -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of ``docs``, one called ``quality`` included."""
    columns = {c: "_given_quality" if c.lower() == "quality" else c for c in docs.columns}
    text = next(c for c in columns if c.lower() == text.lower())
    out = measured(docs.withColumnsRenamed({c: to for c, to in columns.items() if c != to}), columns[text], rules)
    changed = F.col("quality.n_removed_lines") > 0
    new = {text: F.when(changed, F.col("quality.clean_text")).otherwise(F.col(columns[text]))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("quality.clean_text")).otherwise(
            F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    row = F.struct(*[new.get(c, F.col(to)).alias(c) for c, to in columns.items()])
    # A filter on the verdict would be pushed below all that it is computed from and repeat that for every word; rows are
    # dropped by a generator instead, which stays where it is.
    return out.select(F.inline(F.when(F.col("quality.kept"), F.array(row)).otherwise(F.slice(F.array(row), 1, 0))))
