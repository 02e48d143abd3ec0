"""Quality rules whose thresholds bound the share of good documents they reject."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch
from .textio import portions, record

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Cut-offs are sought on this grid of each feature's values, which lie between 0 and 1.
GRID = 100
#: Features of a document, larger being worse: shares of its words or characters.
FEATURES = ("symbols", "repeats", "lines", "capitals", "marks")
STATS = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *[(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("levels", pa.list_(pa.int32()))])
STATS_SQL = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, levels array<int>"

_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_NOT_SYMBOL = re.compile(f"[^{re.escape(SYMBOLS)}]+")


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, first finds included."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, reach = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + width - max(i, reach)
            reach = i + width
    return covered


def measure(text: str | None) -> tuple:
    """Base figures of a whole text, and its features as steps of :data:`GRID`."""
    text = text or ""
    words = [w for w in _SPACES.split(text) if w]
    n, chars = len(words), sum(map(len, words))
    symbols = len(_NOT_SYMBOL.sub("", text))
    lines = [line for line in text.split("\n") if _SPACES.sub("", line)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    capitals = sum(map(str.isupper, words))
    marks = text.count("!!")
    shares = (symbols / max(chars, 1), repeats / max(n, 1), dup / max(len(lines), 1), capitals / max(n, 1), marks / max(n, 1))
    return n, chars, symbols, dup, repeats, [min(GRID, math.ceil(GRID * s)) for s in shares]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, by the continued fraction of the incomplete beta function.

    It takes some hundred steps at most, however large ``n`` is.
    """
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    turned = x > (a + 1) / (a + b + 2)  # there the fraction converges fast on the other side
    if turned:
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 10_000):
        before = total
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / (1.0 + step * d or tiny), 1.0 + step / c or tiny
            total *= c * d
        if abs(total - before) <= 1e-15 * abs(total):
            break
    found = front * total
    return min(1.0, max(0.0, 1 - found if turned else found))


def tail_weights(bad: list[int], others: list[int]) -> list[float]:
    """Per step of a feature, how much likelier a bad document is than any other to come as far.

    Logarithms of ratios of shares, smoothed towards equal shares by one document each, never falling
    and never below 0.
    """
    n_bad, n_others, best, out = sum(bad), sum(others), 0.0, []
    b, o = n_bad, n_others
    for here_bad, here_others in zip(bad, others, strict=True):
        if b + o:
            share = (b + o) / (n_bad + n_others)
            best = max(best, math.log((b + share) / (n_bad + 1)) - math.log((o + share) / (n_others + 1)))
        out.append(best)
        b, o = b - here_bad, o - here_others
    return out


def safe_steps(good: dict[str, list[int]], *, risk: float, error: float) -> dict[str, int]:
    """Per stratum, how many steps of its path are shown to reject few good documents.

    ``good`` holds good held-out documents by the step that rejects them first, the last number those
    that no step does. Along a path, the first step that fails ends it, so there is no correction over
    steps. A step fails if, were its true rate of false rejection above ``risk``, seeing so few would have
    a chance above the stratum's share of ``error``. Strata share it evenly; one whose path passes to its
    end leaves its share to the others (Holm's steps, on paths). Strata that are too small for any test
    to pass get none; their sizes say nothing of rates. With probability 1 - ``error``, every passed
    step of every stratum rejects at most ``risk`` of its good documents.
    """
    sizes = sorted((sum(n) for n in good.values()), reverse=True)
    fit = [m for m, n in enumerate(sizes, 1) if n and (1 - risk) ** n <= error / m]
    taking = {s: n for s, n in good.items() if fit and sum(n) >= sizes[max(fit) - 1] and (1 - risk) ** sum(n) <= error / max(fit)}
    passed, left = dict.fromkeys(good, 0), set(taking)
    while left:
        level, ended = error / len(left), set()
        for s in left:
            n, lost = sum(taking[s]), sum(taking[s][: passed[s]])
            for first in taking[s][passed[s] : -1]:
                lost += first
                if binomial_tail(lost, n, risk) > level:
                    break
                passed[s] += 1
            else:
                ended.add(s)
        if not ended:
            break
        left -= ended
    return passed


def best_step(passed: int, good: list[int], bad: list[int]) -> int:
    """Of the passed steps, the first that parts bad from good documents best; 0 for none."""
    n_good, n_bad, gains, g, b = max(1, sum(good)), max(1, sum(bad)), [0.0], 0, 0
    for step in range(passed):
        g, b = g + good[step], b + bad[step]
        gains.append(b / n_bad - g / n_good)
    return gains.index(max(gains))


def safe_cutoffs(stats: DataFrame, labelled: DataFrame, strata: tuple[str, ...], *, risk: float, error: float) -> dict[tuple[str, int], int]:
    """Cut-offs by stratum and feature from all documents and those with a label (``good`` true or false).

    A stratum's path leads through cut-offs of all features together: it lowers the one whose next step
    tells bad documents best from documents without a label (:func:`tail_weights`). Good documents have no
    part in it, so they can test it. The driver gets counts by stratum, feature and step alone.
    """
    steps = lambda df: df.select("stratum", *(c for c in df.columns if c == "good"), F.posexplode("levels").alias("feature", "step"))
    zeros = lambda: {(s, f): [0] * (GRID + 1) for s in strata for f in range(len(FEATURES))}
    others, bad = zeros(), zeros()
    for s, f, step, n in steps(stats).groupBy("stratum", "feature", "step").count().collect():
        others[s, f][step] = n
    for s, good, f, step, n in steps(labelled).groupBy("stratum", "good", "feature", "step").count().collect():
        others[s, f][step] -= n
        if not good:
            bad[s, f][step] += n
    weights = {k: tail_weights(bad[k], others[k]) for k in bad}
    paths = {s: sorted({w for f in range(len(FEATURES)) for w in weights[s, f] if w > 0}, reverse=True) for s in strata}
    first = {k: [paths[k[0]].index(w) if w > 0 else len(paths[k[0]]) for w in ws] for k, ws in weights.items()}

    table = F.create_map(*[x for (s, f), at in first.items() for x in (F.lit(f"{s}/{f}"), F.array(*map(F.lit, at)))])
    met = F.least(*[F.get(F.element_at(table, F.concat("stratum", F.lit(f"/{f}"))), F.get("levels", F.lit(f))) for f in range(len(FEATURES))])
    by_step = {good: {s: [0] * (len(paths[s]) + 1) for s in strata} for good in (True, False)}
    for s, good, step, n in labelled.groupBy("stratum", "good", met.alias("step")).count().collect():
        by_step[good][s][step] = n
    passed = safe_steps(by_step[True], risk=risk, error=error)
    taken = {s: best_step(passed[s], by_step[True][s], by_step[False][s]) for s in strata}
    return {(s, f): next((v for v, at in enumerate(first[s, f]) if at < taken[s]), GRID + 1) - 1 for s, f in first}


def judge_quality(
    docs: DataFrame, labels: DataFrame, *, risk: float = 0.05, error: float = 0.05, strata: tuple[str, ...] = ("en", "fr", "de", "es"),
    id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality",
) -> DataFrame:
    """Judge every whole text by base rules and by risk-controlled thresholds.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    stratum, failed`` (``failed``: the features above their cut-off). Strata are the named values of
    ``stratum_col`` and ``other`` for the rest, so the driver gets a fixed number of counts. All labelled
    good documents are the holdout. Paths through the cut-offs are learned from bad documents and those
    without a label; good ones only tell how far along its path a stratum may go (:func:`safe_steps`).

    Null or empty text: all figures 0, base rules fail. Very long texts: whole. Ties: a feature at its
    cut-off is kept, and of steps that part good from bad alike the first is taken. Null ``doc_id``: judged, never labelled. Null
    label: as without one; documents with labels that differ count as bad. Repeated rows: judged each.
    Empty tables: no rows, or no threshold; nor is there one in a stratum without bad documents. Other columns are not read.
    """
    stratum = F.when(F.col(stratum_col).isin(*strata), F.col(stratum_col)).otherwise(F.lit("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            ids, kinds, texts = (c.to_pylist() for c in batch.columns)
            rows = [(i, k, *measure(t)) for i, k, t in zip(ids, kinds, texts, strict=True)]
            yield record(STATS, **dict(zip(STATS.names, zip(*rows, strict=True), strict=True)))

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.keep(plain.mapInArrow(run, STATS_SQL), "stats")
    told = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.min(good_col) == 1).alias("good")).filter("doc_id IS NOT NULL AND good IS NOT NULL")
    tested = stats.filter(~base_failed())
    labelled = scratch.keep(tested.join(told, "doc_id").select("stratum", "good", "levels"), "labelled")
    cuts = safe_cutoffs(tested, labelled, (*strata, "other"), risk=risk, error=error)

    cut_of = F.create_map(*[x for (s, f), cut in cuts.items() for x in (F.lit(f"{s}/{f}"), F.lit(cut))])
    above = [F.when(F.element_at("levels", f + 1) > F.element_at(cut_of, F.concat("stratum", F.lit(f"/{f}"))), F.lit(name)) for f, name in enumerate(FEATURES)]
    judged = stats.withColumn("base_failed", base_failed()).withColumn("failed", F.array_compact(F.array(*above)))
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "stratum", "failed")
