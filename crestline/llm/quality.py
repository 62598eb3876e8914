"""Quality of documents by weak supervision, in SQL functions only.

Seven rules look at counts of a text; each votes good (1), bad (-1) or abstains (0). A rule's accuracies (how often it
votes good on good documents, and bad on bad ones) and the share of good documents aren't known beforehand:
expectation-maximisation fits them to how often each pattern of votes occurs (at most 3 ** 7 patterns, whatever the
number of documents), and a document's posterior probability of being good replaces the demand that it pass every rule.
An abstention says nothing. The fit is a fold over the aggregated patterns within one expression.

Null and empty texts have no words: all counts are 0, and base_failed holds. Rows that repeat are each judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import narrow, written

#: Steps of expectation-maximisation, and where it begins.
STEPS, PRIOR, ON_GOOD, ON_BAD = 30, 0.9, 0.95, 0.6
#: Bounds of the fitted share, and of the accuracies on good and on bad documents: a rule is held to be better than chance.
#: The share's lower bound says which of the two groups is the good one, the larger; a crawl that is mostly bad needs another.
SHARE, GOOD_BOUNDS, BAD_BOUNDS = (0.5, 0.99), (0.7, 0.999), (0.35, 0.98)
#: Least posterior of a kept document; words of a window that is looked for again.
LEAST, WINDOW = 0.5, 8
#: Base limits: fewest words, and per cent of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 20, 30

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: ASCII characters that aren't letters or white space, but for the sentence marks.
OTHER = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalpha() and chr(c) not in ".,;:!?'\"-")


def _let(value: Column, body) -> Column:
    """body(x) with x the value, computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(hashes: Column) -> Column:
    """A hash of each window of WINDOW words."""
    at = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))
    return F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words under windows that occur twice or more: neighbours in sorted order are equal, and the places' gaps are summed."""
    pairs = F.sort_array(F.transform(windows, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

    def again(s: Column) -> Column:
        same = lambda x, i, d: F.coalesce(x["v"] == F.get(s, i + d)["v"], F.lit(False))
        marked = F.transform(s, lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def cover(q: Column) -> Column:
        gaps = F.transform(q, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(q, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(_let(_let(pairs, again), cover))


def _counted(held: DataFrame, column: str) -> DataFrame:
    """held and the counts of its text column; its own columns mustn't have their names."""
    text = F.coalesce(F.col(column), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    dense = F.translate(text, SPACE, "")
    hashed = held.select(
        "*",
        _let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("different"))).alias("_l"),
        _let(dense, lambda x: F.struct(F.length(x).alias("all"), F.length(F.translate(x, SYMBOLS, "")).alias("plain"), F.length(F.translate(x, OTHER, "")).alias("usual"), F.length(F.translate(x, ".!?", "")).alias("open"))).alias("_c"),
        _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).alias("n"), _let(_windows(h), _covered).alias("again"))).alias("_w"),
    )
    found = {"n_words": "_w.n", "word_chars": "_c.all", "n_symbols": "_c.all - _c.plain", "n_dup_lines": "_l.all - _l.different", "n_repeat_words": "_w.again", "n_lines": "_l.all", "n_other": "_c.all - _c.usual", "n_stops": "_c.all - _c.open"}
    return hashed.withColumns({n: F.expr(f"cast({e} as bigint)") for n, e in found.items()}).drop("_l", "_c", "_w")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_other, n_stops."""
    return _counted(narrow(docs, {"doc_id": "long", "text": "string"}), "text").drop("text")


#: Conditions on the counts under which a rule votes good, and bad (which goes first); else it abstains.
RULES = [
    ("n_words between 30 and 100000", "n_words < 20"),
    ("word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("20 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("n_lines > 3 and 20 * n_dup_lines <= n_lines", "n_lines > 3 and 10 * n_dup_lines > 3 * n_lines"),
    ("20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    ("50 * n_other <= word_chars", "10 * n_other > word_chars"),
    ("n_stops > 0 and n_words <= 60 * n_stops", "n_words > 100 * n_stops"),
]


def votes() -> list[Column]:
    """1, -1 or 0 of each rule."""
    return [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for good, bad in RULES]


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _total(rows: Column, of) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + of(x))


def _within(p: Column, bounds: tuple[float, float]) -> Column:
    return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), p))


def _posterior(votes: Column, prior: Column, accuracy: Column) -> Column:
    good, bad = lambda a: F.ln(a["good"] / (1 - a["bad"])), lambda a: F.ln((1 - a["good"]) / a["bad"])
    weight = F.zip_with(votes, accuracy, lambda v, a: F.when(v == 1, good(a)).when(v == -1, bad(a)).otherwise(0.0))
    return 1 / (1 + F.exp(-(_logit(prior) + F.aggregate(weight, F.lit(0.0), lambda a, x: a + x))))


def fitted(patterns: DataFrame, n_rules: int) -> DataFrame:
    """votes, n -> votes, posterior; patterns is bounded by the number of rules."""
    rows = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows"))
    shape = "struct<prior:double,accuracy:array<struct<good:double,bad:double>>>"

    def step(state: Column, rows: Column) -> Column:
        scored = F.transform(rows, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), _posterior(x["votes"], state["prior"], state["accuracy"]).alias("p")))

        def maximised(q: Column) -> Column:
            prior = _total(q, lambda x: x["n"] * x["p"]) / _total(q, lambda x: x["n"])
            each = []
            for j in range(n_rules):
                def votes(v: int, p, j=j) -> Column:
                    return _total(q, lambda x: F.when(x["votes"][j] == v, x["n"] * p(x)).otherwise(0.0))

                good, bad = lambda x: x["p"], lambda x: 1 - x["p"]
                tp, fn, fp, tn = votes(1, good), votes(-1, good), votes(1, bad), votes(-1, bad)
                each.append(F.struct(_within((tp + ON_GOOD) / (tp + fn + 1), GOOD_BOUNDS).alias("good"), _within((tn + ON_BAD) / (tn + fp + 1), BAD_BOUNDS).alias("bad")))
            return F.struct(_within(prior, SHARE).alias("prior"), F.array(*each).alias("accuracy")).cast(shape)

        return _let(scored, maximised)

    begin = F.struct(F.lit(PRIOR).alias("prior"), F.array_repeat(F.struct(F.lit(ON_GOOD).alias("good"), F.lit(ON_BAD).alias("bad")), n_rules).alias("accuracy")).cast(shape)
    model = rows.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, lambda s, _: step(s, F.col("rows"))).alias("model"))
    return model.select(F.explode("rows").alias("row"), "model").select("row.votes", _posterior(F.col("row.votes"), F.col("model.prior"), F.col("model.accuracy")).alias("posterior"))


def _assessed(counted: DataFrame) -> DataFrame:
    """Rows with counts, once written; votes, posterior, base_failed and kept are added."""
    rules = votes()
    held = written(counted.withColumn("votes", F.array(*rules)), "quality")
    model = fitted(held.groupBy("votes").agg(F.count("*").alias("n")), len(rules))
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words")
    # at most 3 ** 7 rows are broadcast
    return held.join(F.broadcast(model), "votes").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= LEAST))


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, votes, posterior, base_failed and kept of every row."""
    return _assessed(counts(docs))


def report(docs: DataFrame) -> DataFrame:
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are kept; their texts are written once, and not shuffled."""
    names = list(docs.columns)
    plain = [f"c{i}" for i in range(len(names))]
    counted = _counted(docs.toDF(*plain), f"c{names.index('text')}")
    return _assessed(counted).where("kept").select(*plain).toDF(*names)
