"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Null and empty texts have no words, so they fail the base rule (too few words). Every input row gives one
result row, repeated rows too; other columns of the input pass through ``keep`` and never clash, since
working columns start with ``_q_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Frequent words of English, German, French and Spanish prose.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on that the this to was were will with "
    "au aux avec ce ces dans de des du elle en et il je la le les leur lui ma mais me ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "auf aus bei das dem den der des die ein eine einer er es für im in ist mit nicht sich sie und von war zu "
    "al con del el ella en es esta este la las lo los no para pero por que se sin su sus un una y"
).split()

#: rule name -> (ratio column, lowest accepted value, highest accepted value); None: no bound.
RULES: dict[str, tuple[str, float | None, float | None]] = {
    "length": ("mean_word_chars", 2.0, 15.0),
    "symbols": ("symbol_ratio", None, 0.3),
    "shouting": ("exclamation_ratio", None, 0.5),
    "stop_words": ("stop_word_ratio", 0.03, None),
    "lines": ("dup_line_ratio", None, 0.4),
}
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once: lambda variables are bound, repeated expressions inside lambdas are not."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column, n: Column, window: int) -> Column:
    """Number of words that lie in a window of ``window`` words occurring at least twice in the text.

    Windows are sorted by a hash of their words, and neighbours of equal hash compare their words, so a long text is held
    as one number and one place a window."""

    def covered(spots: Column) -> Column:  # sorted start positions of repeated windows
        return F.aggregate(
            spots,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
            lambda acc, p: F.struct((p + window).alias("end"), (acc["sum"] + (p + window) - F.greatest(p, acc["end"])).alias("sum")),
        )["sum"]

    def windows(w: Column) -> Column:  # words are bound, so that a plan that inlines them doesn't split the text at every window
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.struct(F.xxhash64(F.slice(w, i, window)).alias("h"), i.alias("i")))

    def exact(w: Column, found: Column) -> Column:  # found: windows sorted by hash
        at = lambda j: F.get(found, j)
        same = lambda a, b: (at(a)["h"] == at(b)["h"]) & (F.slice(w, at(a)["i"], window) == F.slice(w, at(b)["i"], window))
        met = lambda j: ((j > 0) & same(F.greatest(j - 1, F.lit(0)), j)) | ((j + 1 < F.size(found)) & same(j, F.least(j + 1, F.size(found) - 1)))
        return _let(F.sort_array(F.filter(F.transform(found, lambda x, j: F.when(met(j), x["i"])), lambda p: p.isNotNull())), covered)

    def counted(w: Column) -> Column:
        # Equal windows have equal hashes: a text whose hashes all differ has no repeat, and only the others compare words.
        return _let(windows(w), lambda x: F.when(F.size(F.array_distinct(x["h"])) < F.size(x), _let(F.sort_array(x), lambda found: exact(w, found))).otherwise(0))

    return F.when(n < window, 0).otherwise(_let(words, counted))


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns of keep, the base measures, the rules' ratios, base_failed and kept."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, t.alias("_q_text"))
    df = df.withColumns({"_q_words": F.filter(F.split("_q_text", SPACE), lambda w: w != "")})
    words, n = F.col("_q_words"), F.size("_q_words")
    lines = F.filter(F.split("_q_text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    plain = F.regexp_replace(F.lower("_q_text"), r"[^\p{L}\p{N}\s]", "")
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate("_q_text", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length("_q_text") - F.length(F.translate("_q_text", SYMBOLS, ""))).cast("long"),
            "_q_lines": F.size(lines),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeated_words(words, n, WINDOW).cast("long"),
            "_q_marks": F.length("_q_text") - F.length(F.translate("_q_text", "!", "")),
            "_q_stops": F.size(F.filter(F.split(plain, SPACE), lambda w: w.isin(STOP_WORDS))),
        }
    )
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    ratios = {
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "exclamation_ratio": over("_q_marks", "n_words"),
        "stop_word_ratio": over("_q_stops", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "_q_lines"),
    }
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(v.alias(k) for k, v in ratios.items()), base.alias("base_failed")).withColumn("kept", ~F.col("base_failed") & verdict(RULES))


def verdict(rules: dict[str, tuple[str, float | None, float | None]]) -> Column:
    """The threshold table as one boolean expression over the ratio columns."""
    out = F.lit(True)
    for column, low, high in rules.values():
        if low is not None:
            out = out & (F.col(column) >= low)
        if high is not None:
            out = out & (F.col(column) <= high)
    return out


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_q_row")
    judged = measures(docs.select(row, F.col("text").alias("_q_in")), "_q_in", ("_q_row",))
    # As a filter, the verdict would be pushed below the projections and evaluate each of them again. It decides instead
    # whether an array holds the row, and of an outer explode Spark infers no filter on the array's size.
    kept = judged.select(F.when(F.col("kept"), F.array("_q_row")).alias("_q_kept"))
    return kept.select(F.explode_outer("_q_kept").alias("_q_row")).where(F.col("_q_row").isNotNull()).select("_q_row.*")
