"""Operator 8: quality rules as a learned decision list.

Sequential covering on labelled statistics: conjunctions of threshold conditions, one that rejects and one that keeps,
are grown on two thirds of the labelled documents (largest information gain first) and pruned on the last third
(conditions go from the end while precision there does not suffer). The more telling of those that are precise enough
joins the list, and the documents that it covers are taken out before the next one is grown. A later rule is thus learnt
on what the earlier ones leave and holds for that alone: the list is read in order, as one Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import WORD, labelled_sample

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: At most so many labelled documents are fitted on.
SAMPLE = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_distinct_words", "n_marked_words", "n_same_as_previous"]


def repeated_window_words(ids: np.ndarray, width: int = 5) -> int:
    """How many positions lie in a window of `width` ids that occurs twice or more; first occurrences count too."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    name = ids.astype(np.int64)
    joined, span = name, 1
    while span < width:  # windows of span + step words, named exactly by sorting
        step = min(span, width - span)
        size = len(joined) - step
        pair = joined[:size] * (int(joined.max()) + 1) + joined[step : step + size]
        joined, span = np.unique(pair, return_inverse=True)[1], span + step
    again = np.bincount(joined)[joined] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: str) -> tuple[int, ...]:
    """The COUNTS of a text."""
    words = WORD.findall(text)
    if not words:
        return (0,) * len(COUNTS)
    names: dict[str, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(ids) if len(names) < len(words) - 4 else 0,
        len(lines),
        sum(w.isupper() for w in names if len(w) > 1),
        len(names),
        sum(not (w[-1].isalnum() or w[-1] in ".,") for w in words),
        int((ids[1:] == ids[:-1]).sum()),
    )


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, under the names _keep0, _keep1 and so on, and the COUNTS of each whole text, however long. A null or empty
    text, or one of white space, has zeros; repeated rows are counted each; an empty table gives no rows."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kept = [f"_keep{i}" for i in range(len(keep))]
    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        for batch in batches:
            rows = np.array([text_counts(t or "") for t in batch.column(at).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(c) for c in rows.T], names=[*kept, *COUNTS])

    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, ", ".join([f"{k} {kinds[c]}" for k, c in zip(kept, keep)] + [f"{c} bigint" for c in COUNTS]))


def statistics() -> dict[str, Column]:
    """The ratios that rules may test, from the COUNTS."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_chars": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "marked_share": per_word("n_marked_words"),
        "repeat_share": per_word("n_repeat_words"),
        "same_as_previous_share": per_word("n_same_as_previous"),
        "upper_share": F.col("n_upper_words") / F.greatest(F.col("n_distinct_words"), F.lit(1)),
        "distinct_share": per_word("n_distinct_words"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


@dataclass
class Rule:
    """All of conditions (statistic, '<=' or '>', threshold) hold -> verdict."""

    conditions: list[tuple[str, str, float]]
    verdict: bool

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, x in self.conditions:
            out = out & (stats[name] <= F.lit(x) if op == "<=" else stats[name] > F.lit(x))
        return out

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, t in self.conditions:
            out &= x[name] <= t if op == "<=" else x[name] > t
        return out


@dataclass
class DecisionList:
    """Rules in order; the first that holds decides, else default."""

    rules: list[Rule] = field(default_factory=list)
    default: bool = True

    def column(self, stats: dict[str, Column] | None = None) -> Column:
        stats = stats or statistics()
        out = None
        for r in self.rules:
            out = (F if out is None else out).when(r.column(stats), F.lit(r.verdict))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))

    def __str__(self) -> str:
        said = [f"{' and '.join(f'{n} {op} {t:.4g}' for n, op, t in r.conditions)} -> {'keep' if r.verdict else 'reject'}" for r in self.rules]
        return "\n".join([*said, f"otherwise -> {'keep' if self.default else 'reject'}"])


class _Cuts:
    """Candidate thresholds of one statistic, midway between neighbouring values at quantiles of both classes."""

    def __init__(self, v: np.ndarray, bad: np.ndarray, most: int):
        u = np.unique(v)
        if len(u) < 2:
            self.at, self.place = np.zeros(0), np.zeros(len(v), np.int64)
            return
        q = np.concatenate([np.quantile(v[y], np.linspace(0, 1, most)) for y in (bad, ~bad)])
        i = np.searchsorted(u, q)
        i = np.unique(np.concatenate([i - 1, i]).clip(0, len(u) - 2))
        self.at = (u[i] + u[i + 1]) / 2
        self.place = np.searchsorted(self.at, v)  # v <= at[k] just if k >= place

    def below(self, on: np.ndarray) -> np.ndarray:
        """How many rows of `on` have a value at or below each threshold."""
        return np.cumsum(np.bincount(self.place[on], minlength=len(self.at) + 1))[:-1]


def _grown(cuts: dict[str, _Cuts], y: np.ndarray, on: np.ndarray, most: int, barred: set) -> list[tuple[str, str, float]]:
    """Conditions for target y on the rows `on`, each with the largest information gain; of thresholds that gain the same
    the middle one. The first condition is none of `barred`."""
    out: list[tuple[str, str, float]] = []
    while len(out) < most:
        p, q = int((on & y).sum()), int((on & ~y).sum())
        if not p or not q:
            break
        base, best = np.log2(p / (p + q)), (1e-9, None)
        for k, c in cuts.items():
            low_p, low_q = c.below(on & y), c.below(on & ~y)
            for op, pp, qq in (("<=", low_p, low_q), (">", p - low_p, q - low_q)):
                if not len(c.at) or not out and (k, op) in barred:
                    continue
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + qq, 1)) - base), 0)
                ties = np.flatnonzero(gain >= gain.max() - 1e-9)
                i = int(ties[len(ties) // 2])
                if gain[i] > best[0] + 1e-9:
                    best = (float(gain[i]), (k, op, i))
        if best[1] is None:
            break
        k, op, i = best[1]
        out.append((k, op, float(cuts[k].at[i])))
        on = on & ((cuts[k].place <= i) if op == "<=" else (cuts[k].place > i))
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, sure: float = 0.995, most_rules: int = 12, most_conditions: int = 4, cuts: int = 48) -> DecisionList:
    """An ordered list from statistics x and labels bad. A rule that rejects needs `precision` on the pruning part, one
    that keeps needs `sure`; where a rule fails, one that opens with another condition is tried. What no rule covers is
    kept, so without labelled rows of both kinds everything is. Ties go to the statistic named first."""
    if not bad.any() or bad.all():
        return DecisionList()
    n = len(bad)
    part = np.arange(n) % 3
    grow, prune, left = part < 2, part == 2, np.ones(n, bool)
    grid = {k: _Cuts(v, bad, cuts) for k, v in x.items()}
    out = DecisionList()
    barred: dict[bool, set] = {False: set(), True: set()}
    while len(out.rules) < most_rules and (left & grow & bad).any():
        found, grew = [], False
        for verdict, y, bound in ((False, bad, precision), (True, ~bad, sure)):
            conditions = _grown(grid, y, left & grow, most_conditions, barred[verdict])
            if not conditions:
                continue
            grew = True

            def judged(size: int) -> tuple[int, int]:
                hit = Rule(conditions[:size], verdict).mask(x) & left & prune
                return int((hit & y).sum()), int(hit.sum())

            share = lambda size: (judged(size)[0] + 1) / (judged(size)[1] + 2)
            size = len(conditions)
            while size > 1 and share(size - 1) >= share(size):
                size -= 1
            right, seen = judged(size)
            if right < 3 or right < bound * seen:
                barred[verdict].add(conditions[0][:2])
                continue
            usual = max((left & prune & y).sum(), 1) / max((left & prune).sum(), 1)
            found.append((right * np.log2(right / seen / usual), Rule(conditions[:size], verdict)))
        if found:
            rule = max(found, key=lambda f: f[0])[1]
            out.rules.append(rule)
            left &= ~rule.mask(x)
            barred = {False: set(), True: set()}
        elif not grew:
            break
    while out.rules and out.rules[-1].verdict == out.default:  # says what the default says
        out.rules.pop()
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Learns from the labelled documents (at most `sample`, the least by a hash of doc_id; their statistics alone
    come to the driver). Ungraded documents are not read further than their id. Null doc_ids and labels teach nothing;
    null, empty and very short texts fail the base rule and teach nothing either; without labels nothing is learnt."""
    rows = measure(labelled_sample(docs, labels, "quality", sample), ("doc_id", "_label"), "_text")
    got = rows.where("n_words >= 10").select(F.col("_keep1").alias("_label"), F.col("_keep0").alias("doc_id"), *[c.alias(k) for k, c in statistics().items()]).toPandas().sort_values(["doc_id", "_label"])
    got = got.sample(frac=1.0, random_state=0)
    return learn({k: got[k].to_numpy(float) for k in statistics()}, got["_label"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def apply(docs: DataFrame, rules: DecisionList, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the COUNTS, base_failed and kept. Each row is judged by itself and its whole text, however long, so repeated
    rows get the same verdict; null and empty texts have no words and fail; an empty table gives no rows. Columns other
    than keep and text are not read, and may have any name."""
    rows = measure(docs, keep)
    names = [F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)]
    return rows.select(*names, *COUNTS, base_failed().alias("base_failed"), (~base_failed() & rules.column()).alias("kept"))
