"""Language of documents from several kinds of evidence."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch
from .textio import portions, record

#: Hash buckets of byte trigrams, and how far their overlap overstates what they say.
BUCKETS, OVERLAP = 1 << 14, 4.0
#: Languages that endings of addresses suggest.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
#: How often a declared language, and one that an address suggests, is taken to be right.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.7
#: Documents of the next higher level that a level's own documents are weighed against.
PSEUDO = 20.0
UNKNOWN = "und"


def _grams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text's words, in lower case, digits and marks as blanks."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(_BLANKED)
    x = np.frombuffer(" ".join(kept.split()).encode().join((b" ", b" ")), np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - 14)).astype(np.int64)


_BLANKED = {c: " " for c in range(128) if not chr(c).isalpha()}
COUNTS = pa.schema([("label", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _draw(id_: Column, every: int) -> Column:
    return F.pmod(F.xxhash64(id_.cast("long"), F.lit("train")), F.lit(every)) == 0


class Model:
    """Log-likelihoods of buckets per language, the last one for anything else; fitted on one row in ``every``."""

    def __init__(self, languages: list[str], table: np.ndarray, every: int = 1):
        self.languages, self.table, self.every = languages, table, every

    def fitted_on(self, id_: Column) -> Column:
        """Whether a row's label, if it has one, was used; such a label is no evidence of its own."""
        return F.coalesce(_draw(id_, self.every), F.lit(True))

    def log_likelihoods(self, text: str | None) -> np.ndarray | None:
        grams = _grams(text) if text else ()
        return self.table[grams].sum(axis=0, dtype=np.float64) / OVERLAP if len(grams) else None


def train(docs: DataFrame, *, languages: tuple[str, ...], sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Fit a model on about ``sample`` labelled rows, chosen by a hash of their ids.

    The driver gets counts of buckets, ``BUCKETS`` per language at most. A language without rows in the
    sample is never found.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).filter(F.col("label").isin(*languages) & F.col("id").isNotNull())
    every = max(1, labelled.select("id").count() // sample)
    chosen = labelled.filter(_draw(F.col("id"), every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    total[label] = total.get(label, 0) + np.bincount(_grams(text), minlength=BUCKETS)
        for label, counts in total.items():
            used = np.flatnonzero(counts)
            yield record(COUNTS, label=[label] * len(used), bucket=used, n=counts[used])

    counts = chosen.select("label", "text").mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n")).collect()
    found = [x for x in languages if any(r[0] == x for r in counts)]
    table = np.full((BUCKETS, len(found) + 1), 0.5)
    for label, bucket, c in counts:
        table[bucket, found.index(label)] += c
    table[:, -1] = 1.0
    return Model(found, np.log(table / table.sum(axis=0)).astype(np.float32), every)


SCORES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("declared", pa.string()), ("address", pa.string()), ("host", pa.string()), ("scores", pa.list_(pa.float64()))])


def _scores(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            scores = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                x = model.log_likelihoods(text)
                scores.append(None if x is None else (x - x.max()).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.list_(pa.float64()))], schema=SCORES)

    return docs.mapInArrow(run, "doc_id long, text_key long, declared string, address string, host string, scores array<double>")


def _with_normalized(df: DataFrame, logs: str, to: str) -> DataFrame:
    """Probabilities of an array of logarithms; each step in a column, so that none is worked out twice."""
    df = df.withColumn("__top", F.array_max(logs)).withColumn("__shares", F.transform(logs, lambda x: F.exp(x - F.col("__top"))))
    df = df.withColumn("__sum", F.aggregate("__shares", F.lit(0.0), lambda a, b: a + b))
    return df.withColumn(to, F.transform("__shares", lambda x: x / F.col("__sum"))).drop("__top", "__shares", "__sum")


def _said(column: str, languages: list[str], right: float) -> Column:
    """Log-likelihoods of a statement that names the true language with chance ``right``."""
    wrong = (1 - right) / max(1, len(languages))
    known = F.col(column).isin(*languages) if languages else F.lit(False)
    return F.when(F.coalesce(known, F.lit(False)), F.array(*[F.when(F.col(column) == x, math.log(right)).otherwise(math.log(wrong)) for x in languages], F.lit(math.log(wrong)))).otherwise(F.array(*[F.lit(0.0)] * (len(languages) + 1)))


def address_language(host: Column, path: Column | None = None, languages: tuple[str, ...] = ()) -> Column:
    """The language of an address: of the country at the host's end, else a first part of the path that names one."""
    country = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.element_at(F.split(F.lower(host), r"\."), -1))
    if path is None or not languages:
        return country
    part = F.lower(F.regexp_extract(path, "^/([A-Za-z]{2})(?:[/_-]|$)", 1))
    return F.coalesce(country, F.when(part.isin(*languages), part))


def identify(
    docs: DataFrame, model: Model, *, accept: tuple[str, ...] = ("en", "fr", "de", "es"), least: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, address: Column | None = None,
) -> DataFrame:
    """The language of every whole text, by Bayes' rule over all evidence.

    Returns a row per document: ``doc_id, text_key, language, probability, text_language, declared,
    address, host, kept``. The text gives likelihoods of byte trigrams; ``declared`` (as in markup) and
    ``address`` (what it says of the language; by default the country at the end of ``host``) name
    languages that are right with fixed chances. Labels that the model was fitted on must not be passed
    as ``declared`` (:meth:`Model.fitted_on`). Hosts give priors: posteriors
    by text alone are summed per host, per last part of the host and over all documents, and each
    level is smoothed by the next with ``PSEUDO`` documents, a document's own share taken out. Sums go
    through partial aggregation, so a host with a third of all rows is no heavier than others.

    Kept: documents whose most probable language is accepted with at least ``least``. Null or empty
    text, or one without letters: language ``und``, not kept. Very long texts: whole. Ties: the language
    that the model names first. Null id, declaration or host: judged without that evidence. Repeated
    rows: judged alike. Empty table: no rows. Without any labelled row
    to fit, texts with letters are kept unjudged. Other columns are not read.
    """
    names = [*model.languages, UNKNOWN]
    none = F.lit(None).cast("string")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), (none if declared is None else declared).alias("declared"), (address_language(none if host is None else host) if address is None else address).alias("address"), (none if host is None else host).alias("host"), F.col(text_col).alias("text"))
    scored = Scratch(docs.sparkSession, "langid").keep(_scores(plain, model), "scores")
    if not model.languages:
        unjudged = F.col("scores").isNotNull()
        return scored.select("doc_id", "text_key", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("probability"), F.lit(UNKNOWN).alias("text_language"), "declared", "address", "host", unjudged.alias("kept"))

    k = len(names)
    scored = _with_normalized(scored, "scores", "own").withColumn("own", F.coalesce("own", F.array(*[F.lit(0.0)] * k)))
    scored = scored.withColumn("top", F.coalesce(F.element_at(F.split("host", r"\."), -1), F.lit("")))
    sums = [F.sum(F.col("own")[i]) for i in range(k)]
    by_host = scored.filter("host IS NOT NULL").groupBy("host", "top").agg(F.array(*sums).alias("in_host"))
    by_top = by_host.groupBy("top").agg(F.array(*[F.sum(F.col("in_host")[i]) for i in range(k)]).alias("in_top"))
    overall = scored.agg(*sums).first()
    n = sum(x or 0.0 for x in overall) + k
    base = F.array(*[F.lit(((x or 0.0) + 1.0) / n) for x in overall])
    placed = scored.join(by_host.drop("top"), "host", "left").join(by_top, "top", "left")

    def smoothed(level: str, prior: Column) -> Column:
        """Shares of a level without the document itself, weighed with the level above."""
        others = F.when(F.col(level).isNull(), F.array(*[F.lit(0.0)] * k)).otherwise(F.zip_with(level, "own", lambda a, b: F.greatest(a - b, F.lit(0.0))))
        total = F.aggregate(others, F.lit(PSEUDO), lambda a, b: a + b)
        return F.zip_with(others, prior, lambda a, p: (a + PSEUDO * p) / total)

    placed = placed.withColumn("p_top", smoothed("in_top", base)).withColumn("p_host", smoothed("in_host", F.col("p_top")))
    logs = F.transform("p_host", lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    for more in (F.col("scores"), _said("declared", model.languages, DECLARED_RIGHT), _said("address", model.languages, SUFFIX_RIGHT)):
        logs = F.zip_with(logs, more, lambda a, b: a + b)
    placed = _with_normalized(placed.withColumn("logs", logs), "logs", "posterior")  # null without scores
    labels = F.array(*[F.lit(x) for x in names])
    best = lambda c: F.coalesce(F.element_at(labels, F.array_position(F.col(c), F.array_max(c)).cast("int")), F.lit(UNKNOWN))
    out = placed.select("doc_id", "text_key", best("posterior").alias("language"), F.coalesce(F.array_max("posterior"), F.lit(0.0)).alias("probability"), F.when(F.col("scores").isNotNull(), best("own")).otherwise(F.lit(UNKNOWN)).alias("text_language"), "declared", "address", "host")
    return out.withColumn("kept", F.col("language").isin(*accept) & (F.col("probability") >= least))
