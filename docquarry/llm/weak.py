"""Quality classifier from weak labels.

Labellers are cheap, overlapping heuristics that vote bad, good or not at all; annotations, where a row has one, are a labeller like
the others. Expectation-maximisation over the counts of vote patterns estimates how accurate each labeller is, for either class. The
posterior of a row's pattern is its soft label, and soft labels train a linear scorer over hashed words, word beginnings
and measurement steps. The scorer, which needs the text alone, judges every row.

Only vote patterns (at most 3^labellers, whatever the data), a sample of ``FIT_ROWS`` rows and the scorer's weights
pass through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import SEPARATORS, distinct_in_runs, slices, whole_text

#: Rows that fit the scorer at most (annotated ones first), hashed places of its weights, and rounds of descent.
FIT_ROWS, PLACES, ROUNDS = 12_000, 1 << 18, 150
#: Fixed list: common English insults, for the heuristic labeller of toxicity. The scorer learns the rest.
INSULTS = ("idiot", "moron", "stupid", "trash", "scum", "loser", "worthless", "pathetic", "disgusting", "clown")
#: Annotations are taken to be right this often at least; heuristics may be as bad as a coin.
LEAST_ANNOTATED = 0.98
TASKS = ("junk", "toxic")
STEPS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)


@dataclass(frozen=True)
class Model:
    """Weights per task over hashed places, and what EM found about each labeller (accuracy on bad and on good rows)."""

    weights: np.ndarray
    bias: np.ndarray
    accuracies: dict[str, dict[str, tuple[float, float]]]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _gone(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


MEASURES = ("symbols", "shouts", "capitals", "repeats", "lines")


def _measured(held: DataFrame) -> DataFrame:
    """A frame with the text ``t``, with the shares that labellers and scorer look at (0 for an empty text) and the distinct words ``v``.

    Each step is a column of its own, since expressions that use it several times would else split the text as often.
    """
    held = held.withColumns({
        "w": F.split(F.trim("t"), SEPARATORS), "l": F.split("t", "\n"), "v": F.array_remove(F.array_distinct(F.split(F.lower("t"), r"[^\p{L}]+")), ""),
        "m": F.regexp_replace("t", r"[^#*$%&|<>!\p{Lu}]+", ""),
    })
    marks, words = F.col("m"), F.size("w")
    return held.withColumns({
        "symbols": _share(_gone(marks, r"[#*$%&|<>]+"), words),
        "shouts": _share(_gone(marks, "!+"), words),
        "capitals": _share(_gone(marks, r"\p{Lu}+"), F.char_length("t")),
        "repeats": 1.0 - distinct_in_runs(F.col("w")) / words,
        "lines": 1.0 - F.size(F.array_distinct("l")) / F.size("l"),
    }).drop("w", "l", "m")


def observed(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """What fitting and scoring need of every row, read from its text once: k, the votes, hashed features f, and the row itself.

    ``row`` is a struct of the columns to ``carry`` (all, unless named), so these may bear any name. Write this frame as a table before use.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)])
    held = _measured(docs.select(row.alias("row"), F.col(key).alias("k"), whole_text(text).alias("t"))).withColumn("f", features())
    return held.select("row", "k", "f", *[v.cast("tinyint").alias(f"{task}.{name}") for task, of in votes().items() for name, v in of.items()])


def votes() -> dict[str, dict[str, Column]]:
    """Per task and labeller, over a measured frame: 1 bad, 0 good, null no vote."""

    def vote(name: str, bad: float, good: float) -> Column:
        return F.when(F.col(name) > bad, 1).when(F.col(name) < good, 0)

    odd = (F.col("symbols") > 0.1) | (F.col("shouts") > 0.2) | (F.col("capitals") > 0.4) | (F.col("repeats") > 0.6) | (F.col("lines") > 0.5)
    return {
        "junk": {
            "symbol_density": vote("symbols", 0.1, 0.02),
            "exclamations": vote("shouts", 0.2, 0.02),
            "capital_letters": vote("capitals", 0.4, 0.1),
            "word_variety": vote("repeats", 0.6, 0.45),
            "line_variety": vote("lines", 0.5, 0.35),
            "any_oddity": F.when(odd, 1).otherwise(0),
        },
        "toxic": {"insults": F.when(F.arrays_overlap("v", F.array(*map(F.lit, INSULTS))), 1).otherwise(0)},
    }


#: Features that a round of fitting handles at once.
BLOCK = 1 << 18


def features() -> Column:
    """Distinct hashed places, over a measured frame: words, their first five letters, and the step each measurement reaches."""
    place = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(PLACES)).cast("int")
    steps = [place(F.lit(name), sum(F.when(F.col(name) > s, 1).otherwise(0) for s in STEPS)) for name in MEASURES]
    return F.concat(F.transform("v", lambda w: place(w)), F.array_distinct(F.transform("v", lambda w: place(F.lit("^"), F.substring(w, 1, 5)))), F.array(*steps))


def estimate(patterns: np.ndarray, counts: np.ndarray, least: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for a two-class model with independent labellers. Patterns hold 1, 0 or -1 (no vote); ``least`` bounds their accuracies below.

    Returns the posterior of bad per pattern, per labeller its accuracy on (bad, good) rows, and the share of bad rows.
    """
    bad, good = patterns == 1, patterns == 0
    right = np.maximum(np.full((patterns.shape[1], 2), 0.8), least[:, None])
    prior, posterior = 0.2, np.full(len(counts), 0.2)
    for _ in range(rounds):
        log_bad = np.log(prior) + bad @ np.log(right[:, 0]) + good @ np.log(1 - right[:, 0])
        log_good = np.log(1 - prior) + bad @ np.log(1 - right[:, 1]) + good @ np.log(right[:, 1])
        posterior = 1 / (1 + np.exp(np.clip(log_good - log_bad, -50, 50)))
        yes, no = counts * posterior, counts * (1 - posterior)
        prior = min(max((yes.sum() + 1) / (counts.sum() + 5), 1e-4), 0.5)
        # A few right and wrong votes beforehand: an accuracy stays off 0 and 1, and no labeller is turned round by few rows.
        right[:, 0] = (yes @ bad + 8) / (yes @ (bad | good) + 10)
        right[:, 1] = (no @ good + 8) / (no @ (bad | good) + 10)
        right = np.clip(right, least[:, None], 0.999)
    return posterior, right, prior


def train(rows: list[np.ndarray], soft: np.ndarray, rounds: int = ROUNDS, rate: float = 0.3, shrink: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch AdaGrad; a feature's value is 1 when present.

    Features are kept as 32-bit places, and each round goes through them in blocks: what it needs besides is a few arrays of a block and of all places.
    """
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    ends = np.cumsum(lengths)
    places = np.concatenate(rows).astype(np.int32, copy=False) if rows else np.empty(0, np.int32)
    blocks = list(slices(lengths, BLOCK))
    weights, seen, bias, seen_bias = np.zeros(PLACES), np.full(PLACES, 1e-3), 0.0, 1e-3
    balance = np.where(soft > 0.5, 0.5 / max(soft.mean(), 0.02), 1.0)  # bad rows are few
    for _ in range(rounds if len(rows) else 0):
        slope, drift = shrink * np.sign(weights) + 1e-5 * weights, 0.0
        for i, j in blocks:
            own, starts = places[ends[i] - lengths[i] : ends[j - 1]], ends[i:j] - lengths[i:j] - (ends[i] - lengths[i])
            running = np.concatenate(([0.0], np.cumsum(weights[own])))
            score = bias + running[starts + lengths[i:j]] - running[starts]
            gap = balance[i:j] * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - soft[i:j]) / len(rows)
            slope += np.bincount(own, np.repeat(gap, lengths[i:j]), PLACES)
            drift += gap.sum()
        seen += slope**2
        weights -= rate * slope / np.sqrt(seen + 1e-6)
        seen_bias += drift**2
        bias -= rate * drift / np.sqrt(seen_bias + 1e-6)
    return weights, bias


def _drawn(wanted: int, rows: int) -> float:
    """The share to draw so that ``wanted`` of so many rows are found, but for one draw in some thousand; a limit then cuts the surplus."""
    return min(1.0, (wanted + 4 * wanted**0.5) / max(rows, 1))


def fit(seen: DataFrame, labels: DataFrame | None, key: str = "doc_id") -> Model:
    """The model of an observed table. ``labels``: key, quality 0/1, toxic 0/1, either may be null; without them heuristics stand alone.

    A key that is annotated more than once: the worse verdict counts. An empty table gives a model that rejects nothing.
    """
    names = {task: list(of) for task, of in votes().items()}
    narrow = seen.select("k", *[f"`{task}.{name}`" for task in TASKS for name in names[task]])
    if labels is not None:
        marks = labels.groupBy(F.col(key).alias("k")).agg((1 - F.min("quality")).alias("junk.annotation"), F.max("toxic").alias("toxic.annotation"))
        narrow = narrow.join(marks, "k", "left")
        for task in TASKS:
            names[task].append("annotation")
    columns = [f"`{task}.{name}`" for task in TASKS for name in names[task]]
    patterns = narrow.groupBy(*columns).count().collect()  # at most 3^labellers rows
    total = sum(r["count"] for r in patterns)
    if not total:
        return Model(np.zeros((len(TASKS), PLACES)), np.full(len(TASKS), -10.0), {})
    counts = np.array([r["count"] for r in patterns], float)
    soft, accuracies, at = [], {}, 0
    table = np.array([[-1 if v is None else v for v in r[:-1]] for r in patterns])
    for task in TASKS:
        part = table[:, at : at + len(names[task])]
        at += len(names[task])
        posterior, right, _ = estimate(part, counts, np.array([LEAST_ANNOTATED if n == "annotation" else 0.5 for n in names[task]]))
        soft.append({tuple(p): float(s) for p, s in zip(part.tolist(), posterior)})
        accuracies[task] = {n: (float(a), float(b)) for n, (a, b) in zip(names[task], right)}
    annotated = sum(r["count"] for r, p in zip(patterns, table) if labels is not None and max(p[len(names["junk"]) - 1], p[-1]) >= 0)
    # Annotated rows fill the sample first, whatever the table's size; others, under their posteriors, fill what room is left. Either are
    # drawn before they meet the features, so no more than the sample's rows carry these through a shuffle.
    keyed, mixed = seen.drop("row"), F.xxhash64("k", F.lit(42))
    if labels is not None:
        known = F.col("`junk.annotation`").isNotNull() | F.col("`toxic.annotation`").isNotNull()
        part = F.pmod(mixed, F.lit(1 << 30)) < int(_drawn(FIT_ROWS, annotated) * (1 << 30))
        chosen = marks.where(known & part).join(seen.select("k"), "k", "left_semi").orderBy(mixed).limit(FIT_ROWS)
        marked = keyed.join(F.broadcast(chosen), "k").limit(FIT_ROWS)  # as many rows at most as a sample has
        room = FIT_ROWS - min(annotated, FIT_ROWS)
        plain = keyed.where(F.rand(42) < _drawn(room, total - annotated)).join(marks, "k", "left").where(~known).orderBy(mixed).limit(room)
        sample = marked.unionByName(plain) if room else marked
    else:
        sample = keyed.where(F.rand(42) < _drawn(FIT_ROWS, total)).limit(FIT_ROWS)
    rows = sample.select("f", *columns).toArrow()
    places = [np.asarray(x.values) for x in rows["f"]]
    weights, bias, at = [], [], 1
    for task, known in zip(TASKS, soft):
        width = len(names[task])
        part = np.array([[-1 if v is None else v for v in rows.column(at + j).to_pylist()] for j in range(width)]).T.reshape(-1, width)
        at += width
        w, b = train(places, np.array([known.get(tuple(p), 0.5) for p in part.tolist()]))
        weights.append(w), bias.append(b)
    return Model(np.array(weights), np.array(bias), accuracies)


def score(seen: DataFrame, model: Model) -> DataFrame:
    """The rows of an observed table with ``junk``, ``toxic`` (probabilities) and ``rejected`` (either above one half).

    A null or empty text scores like any text without words. Columns of these names are replaced; nothing is shuffled.
    """
    shared = seen.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 2 MB, whatever the data

    @F.arrow_udf(T.StructType([T.StructField(t, T.DoubleType()) for t in TASKS]))
    def judged(column: pa.Array) -> pa.Array:
        weights, bias = shared.value
        return _judged(column, weights, bias)

    scored = seen.select("row", judged("f").alias("_weak")).select("row.*", "_weak")
    scored = scored.drop(*TASKS, "rejected").withColumns({t: F.col("_weak")[t] for t in TASKS}).drop("_weak")
    return scored.withColumn("rejected", (F.col("junk") > 0.5) | (F.col("toxic") > 0.5))


def passing(seen: DataFrame, model: Model) -> DataFrame:
    """The scored rows that the model does not reject; ``seen`` need not be written first.

    The row number is there for the optimizer only: it would else move the filter below the measurements, writing them all out again for every
    time one uses another.
    """
    scored = score(seen, model).withColumn("_at", F.monotonically_increasing_id())
    return scored.where(~F.col("rejected") & (F.col("_at") >= 0)).drop("_at")


def _judged(column: pa.Array, weights: np.ndarray, bias: np.ndarray) -> pa.Array:
    places = np.asarray(column.flatten())
    offsets = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(column)))))
    out = []
    for w, b in zip(weights, bias):
        running = np.concatenate(([0.0], np.cumsum(w[places], dtype=np.float64)))
        total = running[offsets[1:]] - running[offsets[:-1]] + b
        out.append(pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
    return pa.StructArray.from_arrays(out, names=list(TASKS))
