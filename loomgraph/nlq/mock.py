"""Events of an answer without a translator or a graph, for trying what reads them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..functions.text import characters

#: Milliseconds from one event to the next.
PER_CHARACTER, BEFORE_RESULTS, BEFORE_DONE = 18, 300, 50
SPARQL = "SELECT ?title WHERE { ?b a :Book ; :title ?title } LIMIT 2"
RESULTS = {"columns": ["title"], "rows": [{"title": "Αλγόριθμοι"}, {"title": "Βάσεις δεδομένων"}]}
TOKENS = (120, 45)


def mock_events(requests: DataFrame) -> DataFrame:
    """``request_id, seq, at_ms, event, data`` for ``request_id, provider, model``, the same answer for all."""
    n, end = len(SPARQL), len(SPARQL) * PER_CHARACTER
    done = F.to_json(F.struct("provider", "model", F.lit(TOKENS[0]).alias("input_tokens"), F.lit(TOKENS[1]).alias("output_tokens"), F.lit(0).alias("retries")))
    event = lambda at, kind, data: F.struct(at.cast("int").alias("at_ms"), F.lit(kind).alias("event"), data.alias("data"))
    typed = F.transform(characters(F.lit(SPARQL)), lambda c, i: event((i + 1) * PER_CHARACTER, "sparql_token", c))
    last = F.array(event(F.lit(end), "sparql_complete", F.lit(SPARQL)), event(F.lit(end + BEFORE_RESULTS), "results", F.lit(json.dumps(RESULTS, ensure_ascii=False, separators=(",", ":")))), event(F.lit(end + BEFORE_RESULTS + BEFORE_DONE), "done", done))
    every = requests.select("request_id", F.posexplode(F.concat(typed, last)).alias("seq", "e"))
    return every.select("request_id", "seq", "e.at_ms", "e.event", "e.data")
