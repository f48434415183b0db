"""Quality rules as a bitmask ledger, in column expressions only.

Every document is measured once and every rule evaluated once; the ledger keeps the measurements and one bit per failed rule. A policy
is a named set of rules, that is, a mask: applying it, comparing it with another, or asking what a rule alone costs is
bitwise arithmetic over the ledger and never touches a text again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import SEPARATORS, distinct_in_runs, whole_text

BLANKS = " \\t\\n\\u000B\\f\\r"
#: The upper half of a window's key is a hash, the lower half its place in the text.
HASH, PLACE = 0x7FFFFFFF00000000, 0xFFFFFFFF

#: Name and condition (true: failed) of every rule; the order fixes the bits. Only append. Whole numbers, so SQL agrees exactly.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("shouting", "n_words >= 5 and 2 * n_upper > word_chars"),
    ("exclamations", "5 * n_exclamations > n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("few_distinct_words", "10 * n_distinct_words < 3 * n_words"),
    ("long_repeated_windows", "n_words >= 50 and 100 * n_repeat_words > 50 * n_words"),
    ("doubled_words", "n_words >= 8 and 4 * n_doubled_words > n_words"),
)
BASE = ("too_few_words", "repeated_windows")
#: Versioned policies: the rules that reject. ``strict`` is the contract's; ``clean`` lets short texts pass.
POLICIES: dict[str, tuple[str, ...]] = {
    "strict-1": tuple(name for name, _ in RULES),
    "clean-1": ("symbols", "repeated_lines", "shouting", "exclamations", "word_length", "few_distinct_words", "long_repeated_windows", "doubled_words"),
}
#: Policies that judge variety by runs of words, so whatever a text's length, where the policy they else follow has few_distinct_words. Their
#: rule has no bit, as the bits of a ledger are those the SQL knows.
BY_RUNS, FEW_IN_RUNS = {"clean-2": "clean-1"}, "10 * n_distinct_in_runs < 3 * n_words"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclamations", "n_distinct_words", "n_doubled_words", "n_distinct_in_runs")


def mask(names: tuple[str, ...]) -> int:
    places = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << places[name] for name in names)


def _count(marks: Column, pattern: str) -> Column:
    return F.char_length(marks) - F.char_length(F.regexp_replace(marks, pattern, ""))


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``MEASURES``; all long, none null. A null text is measured as an empty one, whose measures are all 0.

    Repeated windows are found inside the row, without a shuffle: hashes of three words, with their places in the lower half, are sorted
    as plain numbers; neighbours of equal hash are candidates, and only these are compared word for word.
    """
    held = docs.drop(*MEASURES).withColumn("_t", whole_text(text)).withColumn("_s", F.expr(f"trim(BOTH '{BLANKS}' FROM _t)"))
    held = held.withColumn("_w", F.when(F.col("_s") == "", F.array().cast("array<string>")).otherwise(F.split("_s", SEPARATORS))).drop("_s")
    words = F.col("_w")
    key = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(HASH)).bitwiseOR(i.cast("long"))
    held = held.withColumn("n_words", F.size("_w").cast("long")).withColumn("_k", F.sort_array(F.transform(words, key)))
    keys = F.col("_k")
    same = lambda k, other: k.bitwiseXOR(other) <= F.lit(PLACE)
    held = held.withColumn("_c", F.filter(keys, lambda k, j: same(k, F.get(keys, j + 1)) | same(k, F.get(keys, j - 1)))).drop("_k")
    place = lambda k: k.bitwiseAND(F.lit(PLACE)).cast("int")
    windows = F.transform(
        F.filter("_c", lambda k: place(k) < F.col("n_words") - 2),
        lambda k: F.struct(F.concat_ws(" ", *_window(words, place(k))).alias("s"), place(k).alias("i")),
    )
    held = held.withColumn("_x", F.when(F.size("_c") > 0, F.sort_array(windows))).drop("_c")
    found = F.col("_x")
    twice = F.filter(found, lambda x, j: (x["s"] == F.get(found, j + 1)["s"]) | (x["s"] == F.get(found, j - 1)["s"]))
    held = held.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_x")
    places = F.col("_p")
    covers = F.transform(places, lambda p, j: F.coalesce(F.least(F.get(places, j + 1) - p, F.lit(3)), F.lit(3)))
    total = F.aggregate(covers, F.lit(0).cast("long"), lambda a, b: a + b)
    lines = F.filter(F.split("_t", "\n"), lambda x: F.ltrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    held = held.withColumn("_l", lines)
    # One pass over the text leaves the few characters that are counted.
    held = held.withColumn("_m", F.regexp_replace("_t", r"[^#*$%&|<>!A-Z]+", ""))
    doubled = F.size(F.filter(words, lambda w, i: w == F.get(words, i + 1)))
    measures = {
        "word_chars": F.char_length(F.array_join("_w", "")),
        "n_symbols": _count(F.col("_m"), r"[#*$%&|<>]+"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.coalesce(total, F.lit(0)),
        "n_lines": F.size("_l"),
        "n_upper": _count(F.col("_m"), "[A-Z]+"),
        "n_exclamations": _count(F.col("_m"), "!+"),
        "n_distinct_words": F.size(F.array_distinct("_w")),
        "n_doubled_words": doubled,
        "n_distinct_in_runs": distinct_in_runs(words),
    }
    return held.withColumns({name: value.cast("long") for name, value in measures.items()}).drop("_t", "_w", "_p", "_l", "_m")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their measurements and ``failed``, one bit per failed rule. Columns of these names are replaced."""
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, condition) in enumerate(RULES)]
    return measured(docs.drop("failed"), text).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def rejected(policy: str) -> Column:
    """Does this policy reject the row of a ledger?"""
    if policy in BY_RUNS:
        names = tuple(name for name in POLICIES[BY_RUNS[policy]] if name != "few_distinct_words")
        return (F.col("failed").bitwiseAND(F.lit(mask(names))) != 0) | F.expr(FEW_IN_RUNS)
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def passing(docs: DataFrame, policy: str, text: str = "text") -> DataFrame:
    """The ledger's rows that a policy keeps.

    The row number is there for the optimizer only: it would else move the filter below the measurements, writing them all out again for every
    time one uses another.
    """
    book = ledger(docs, text).withColumn("_at", F.monotonically_increasing_id())
    return book.where(~rejected(policy) & (F.col("_at") >= 0)).drop("_at")


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: how many rows fail it, how many only it rejects (they would pass without it), and the rows in all.

    Computed from bits alone; an empty ledger gives one row per rule with zeros.
    """
    whole, names = mask(POLICIES[policy]), POLICIES[policy]
    held, one = F.col("failed").bitwiseAND(F.lit(whole)), [(name, 1 << i) for i, (name, _) in enumerate(RULES) if name in names]
    sums = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_or(held), F.lit(0)).alias("seen")]
    sums += [F.count_if(held.bitwiseAND(F.lit(b)) != 0).alias(f"fail_{n}") for n, b in one] + [F.count_if(held == b).alias(f"only_{n}") for n, b in one]
    entries = [F.struct(F.lit(n).alias("rule"), F.col(f"fail_{n}").alias("failed"), F.col(f"only_{n}").alias("only"), "rows", (F.col("seen").bitwiseAND(F.lit(b)) != 0).alias("seen")) for n, b in one]
    return book.agg(*sums).select(F.inline(F.array(*entries)))
