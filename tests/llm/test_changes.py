"""Operators 11 to 13 against brute force, and what was mended in others."""

import collections
import datetime
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash

from loomgraph.llm import centroids, pages, pii, queries, sequencer, simhash
from loomgraph.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


# SimHash
def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def differing(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_simhash(rows):
    """``doc_id, fingerprint, component`` of rows ``doc_id, text``."""
    made = [(i, plain_fingerprint(t)) for i, t in rows]
    every = sorted({f for _, f in made})
    of = components(every, [(a, b) for n, a in enumerate(every) for b in every[:n] if differing(a, b) <= 2])
    least = {}
    for i, f in made:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    return sorted(((i, f"{f:016x}", least.get(of[f])) for i, f in made), key=str)


def told(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert told(queries.QUERIES["op11_simhash"](spark, SF)) == brute_simhash(rows)


def test_simhash_odd_cases(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    long_ = " ".join(rng.choice(words) for _ in range(40_000))
    texts = ["", None, " \t\n", "one", "ONE", "one two", "Ａ Σ ΑΣ \x1c é", "a b c a b c a b c", long_, long_ + " w1", "x " * 9, "tie tie2"]
    rows = [*enumerate(texts), (8, long_), (None, "one"), (None, "alone here now"), (None, None), (None, "alone here now")]
    df = spark.createDataFrame([(i, t, "c", "d", "e") for i, t in rows], "doc_id long, text string, fp string, node string, component string")
    assert told(simhash.near_documents(df)) == brute_simhash(rows)
    kept = {(r.doc_id, r.component_id): r.kept for r in simhash.near_documents(df).collect()}
    assert all(v == (k[0] == k[1] or k[1] is None) for k, v in kept.items())
    assert simhash.near_documents(df.limit(0)).count() == 0


def families(rng, n, size):
    """Numbers that differ from one of ``n`` in up to three bits."""
    out = set()
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def test_tries_find_every_pair():
    numbers = np.array(families(random.Random(2), 40, 25), np.uint64)
    near = {(i, j) for i in range(len(numbers)) for j in range(i) if differing(int(numbers[i]), int(numbers[j])) <= 2}
    found = {(j, i) for a, b in simhash.node_pairs(numbers, numbers, 2) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert found == near and len(near) > 500
    a, b = numbers[::2].copy(), numbers[1::2].copy()
    found = {(i, j) for x, y in simhash.node_pairs(a, b, 2) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert found == {(i, j) for i in range(len(a)) for j in range(len(b)) if differing(int(a[i]), int(b[j])) <= 2}


@pytest.mark.parametrize("whole", [8192, 16, 1])
def test_large_tries_are_split(spark, monkeypatch, whole):
    """The same components whatever a task takes whole, with many numbers that share their first bits."""
    monkeypatch.setattr(simhash, "WHOLE", whole)
    rng = random.Random(3)
    numbers = sorted({*families(rng, 12, 20), *(0x123456 << 40 | rng.getrandbits(7) << rng.choice((0, 30)) for _ in range(150)), 0, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in numbers]
    links = [tuple(r) for r in simhash.near_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, Scratch(spark, "test")).collect()]
    assert all(differing(a, b) <= 2 for a, b in links)
    assert components(signed, links) == components(signed, [(a, b) for n, a in enumerate(signed) for b in signed[:n] if differing(a, b) <= 2])


# Centroids
def brute_lloyd(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((square(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign() if centres else []
    total = collections.Counter()
    for d, c in found:
        total[c] += d
    return sorted(((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, found, strict=False)), key=str)


def clustered(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_centroids_by_the_letter(spark):
    rng = random.Random(4)
    vector = lambda: [rng.gauss(0, 2) for _ in range(64)]
    rows = [(i, vector()) for i in range(60)]
    rows += [(60, rows[3][1]), (3, rows[3][1]), (61, None), (62, [1.0] * 63), (63, [None] + [1.0] * 63), (64, [float("nan")] * 64), (65, [float("inf")] * 64), (None, vector()), (66, [0.5 / 64] * 64), (67, [-0.5 / 64] * 64), (68, []), (69, [1.0] * 65)]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(5)
    assert clustered(centroids.cluster(df)) == brute_lloyd(rows)
    few = rows[:5]
    assert clustered(centroids.cluster(spark.createDataFrame(few, "vec_id long, embedding array<double>"))) == brute_lloyd(few)
    assert centroids.cluster(df.limit(0)).count() == 0 and centroids.cluster(df.filter("vec_id IS NULL")).count() == 0


def test_equal_distances_and_huge_components(spark):
    same = [(i, [1.0] * 64) for i in range(40)] + [(100, [3e38] * 64), (101, [-3e38] * 64)]
    rows = centroids.cluster(spark.createDataFrame(same, "vec_id long, embedding array<float>")).collect()
    assert len(rows) == 42 and all(r.distance >= 0 for r in rows) and len({r.cluster for r in rows if r.vec_id < 100}) == 1


# Sequenced changes
def brute_changes(rows, batches=10, patience=8):
    """Distinct rows of ``client_changes``, one step after another."""
    numbers = collections.defaultdict(set)
    for r in rows:
        numbers[r["client_id"]].add(r["seq"])
    rank = {c: {s: i + 1 for i, s in enumerate(sorted(v, key=lambda x: (x is not None, x or 0)))} for c, v in numbers.items()}
    events = []
    for r in rows:
        h = zlib.crc32(str(r["change_id"]).encode()) if r["change_id"] is not None else 0
        if r["valid_at"] is None or h % 11 == 0:
            continue
        day = (r["valid_at"].date() - datetime.date(1970, 1, 1)).days + 5 * (h % 4)
        events.append((max(1, min(batches, 1 + (day - 19723) * 10 // 160)), day, r["change_id"], rank[r["client_id"]][r["seq"]], r))
    out, clients, latest = [], {}, None

    def apply(name, c, batch, missed):
        while c["next"] in c["held"]:
            r = c["held"].pop(c["next"])[1]
            cents = None if r["balance"] is None else math.floor(100 * r["balance"] + 0.5)
            if r["op"] == "I":
                c["city"], c["cents"] = r["city"], cents
            elif r["op"] == "U":
                c["city"], c["cents"] = c["city"] if r["city"] is None else r["city"], c["cents"] if cents is None else cents
            elif r["op"] == "D":
                c["city"] = c["cents"] = None
            out.append([r["change_id"], name, "applied", batch, missed, c["city"], c["cents"], False])
            c["last"], c["next"], missed = (out[-1], r["op"]), c["next"] + 1, 0

    def jump(batch, today):
        for name, c in clients.items():
            while c["held"] and (today is None or min(d for d, _ in c["held"].values()) + patience <= today):
                least = min(c["held"])
                missed, c["next"] = least - c["next"], least
                apply(name, c, batch, missed)

    for batch in range(1, batches + 1):
        if latest is not None:
            jump(batch, latest)
        mine = sorted((e for e in events if e[0] == batch), key=lambda e: e[1:3])
        for _, day, change, n, r in mine:
            c = clients.setdefault(r["client_id"], {"next": 1, "city": None, "cents": None, "held": {}, "last": None})
            if n < c["next"] or n in c["held"]:
                out.append([change, r["client_id"], "rejected", batch, 0, None, None, False])
            else:
                c["held"][n] = (day, r)
                apply(r["client_id"], c, batch, 0)
        latest = max([d for _, d, *_ in mine] + ([latest] if latest is not None else []), default=None)
    jump(batches + 1, None)
    for c in clients.values():
        if c["last"] and c["last"][1] != "D":
            c["last"][0][7] = True
    return sorted(map(tuple, out), key=str)


CONTRACT = ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]


def test_changes_query(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/client_changes.parquet").distinct().collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_changes"](spark, SF).select(*CONTRACT).collect()), key=str) == brute_changes(rows)


def test_changes_odd_cases(spark, tmp_path):
    """Null in every column, repeated rows, gaps, empty batches, a client with most rows, clashing columns."""
    rng = random.Random(7)
    at = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    names = ["change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance"]
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*range(12), None]), rng.choice(["I", "U", "U", "D", "X", None]), rng.choice([at(rng.randint(0, 20)), at(rng.randint(100, 200)), None]), "s", None, rng.choice(["x" * 5000, "b", "", None]), rng.choice([1.005, -2.5, None])) for i in range(160)]
    rows += [rows[0], rows[5], (None, 1, 3, "I", at(3), None, None, "z", 1.0)]
    df = spark.createDataFrame([(*r, "k", 9, "h") for r in rows], "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, kind string, n long, bucket string")
    df.repartition(3).write.parquet(str(tmp_path / "client_changes.parquet"))
    got = queries.QUERIES["op13_changes"](spark, str(tmp_path)).select(*CONTRACT).collect()
    assert sorted(map(tuple, got), key=str) == brute_changes([dict(zip(names, r, strict=True)) for r in set(rows)])
    df.limit(0).write.parquet(str(tmp_path / "none" / "client_changes.parquet"))
    assert queries.QUERIES["op13_changes"](spark, str(tmp_path / "none")).count() == 0


def test_the_wheel_visits_only_days_that_have_come():
    bucket = sequencer.Bucket(8)
    for name, n, day in (("a", 2, 10), ("b", 5, 20), ("b", 7, 12)):
        bucket.take(name, n, (day, n, "U", None, None), 1)
        bucket.schedule(name, bucket.clients[name])
    assert {d: list(x) for d, x in bucket.wheel.items()} == {18: ["a"], 20: ["b"]}
    again = sequencer.Bucket(8, *bucket.state())
    assert not again.tick(17, 2) and again.tick(18, 2) and [r[:2] + r[6:7] for r in again.out] == [(2, "a", 1)] and list(again.wheel) == [20]
    again.tick(20, 3)  # b jumps to 5; then its earliest is day 12, due on 20 as well
    assert [(r[2], r[6]) for r in again.out if r[1] == "b"] == [(5, 4), (7, 1)] and not again.wheel


def test_dense_numbers_over_ranges(spark):
    rng = random.Random(9)
    pairs = {(c, rng.choice([rng.randint(-5000, 9000), None])) for c in (1, None) for _ in range(400)}
    found = {(r.client_id, r.seq): r.n for r in sequencer.dense_numbers(spark.createDataFrame(list(pairs), "client_id long, seq long")).collect()}
    for c in (1, None):
        mine = sorted((s for x, s in pairs if x == c), key=lambda s: (s is not None, s or 0))
        assert [found[c, s] for s in mine] == list(range(1, len(mine) + 1))


# what was mended
def test_no_value_is_its_own_surrogate(spark):
    cipher = pii.Cipher(b"k")
    for size in (2, 3, 10, 256, 1000):
        image = [cipher.number("t", i, size) for i in range(size)]
        assert sorted(image) == list(range(size)) and all(i != x for i, x in enumerate(image))
    block = [f"169.254.{i >> 8}.{i & 255}" for i in range(1 << 13)]
    docs = spark.createDataFrame([(i, " ".join(block[i : i + 64])) for i in range(0, len(block), 64)], "doc_id long, text string")
    out = [x for r in pii.replace_entities(docs, key=b"k").orderBy("doc_id").collect() for x in r.text.split()]
    assert len(set(out)) == len(block) and all(a != b for a, b in zip(block, out, strict=True))


def surrogates(text):
    cipher, out, at = pii.Cipher(b"k"), [], 0
    for e in pii.find(text):
        out += [text[at : e.start], pii.dressed(e.kind, e.text, pii.surrogate(cipher, e.kind, e.key))]
        at = e.end
    return "".join([*out, text[at:]])


def test_one_person_has_one_surrogate():
    text = "John Smith met Anna Lee. John Smith's dog. JOHN SMITH left. Mr. John\nSmith and John O'Brien’s JOHN O'BRIEN."
    found = pii.find(text)
    assert [e.text for e in found] == ["John Smith", "Anna Lee", "John Smith", "JOHN SMITH", "John\nSmith", "John O'Brien", "JOHN O'BRIEN"]
    assert len({e.key for e in found}) == 3
    new = surrogates(text)
    person = re.match(r"(\w+ \w+) met", new)[1]
    assert f"{person}'s dog" in new and f"{person.upper()} left" in new and f"Mr. {person.replace(' ', chr(10))} and" in new and not re.search("(?i)smith|lee|brien", new)


@pytest.mark.parametrize("text, gone", [("Pedro Sánchez left", "Sánchez"), ("Dr. Angela Merkel spoke", "Merkel"), ("Professor Ōtani wrote", "Ōtani"), ("password: hunter2", "hunter2"), ("password: correcthorse", "correcthorse"), ("My name is Igor Šmíd.", "Šmíd"), ("Signed, Sara Novak", "Novak"), ("Mrs. Šß", "Šß")])
def test_more_names_and_secrets_are_found(text, gone):
    assert gone not in surrogates(text) and len(pii.find(text)) == 1


@pytest.mark.parametrize("text", ["password: required", "The secret: everyone knows", "Marks and Johnson", "the token: it is", "Don Quijote and New York", "dear Valued Customer"])
def test_clean_text_stays(text):
    assert surrogates(text) == text


def test_the_key_is_kept_out_of_logs(spark):
    pii.session_key(spark)
    setting = next(k for k in spark.conf.getAll if k.startswith("spark.loomgraph.surrogates"))
    assert re.search("(?i)secret|password|token|access[.]key", setting)


@pytest.mark.parametrize("tag", ["<script ", "<!--", "<nav>", "<h1>", "<article>", "<a ", "</article>", "<html ", "<template><nav>"])
def test_hostile_markup_takes_linear_time(tag):
    markup, began = tag * (2_000_000 // len(tag)), time.perf_counter()
    pages.page_texts(markup), pages.declared_language(markup)
    assert time.perf_counter() - began < 2


def test_pages_keep_headings_and_what_is_not_closed():
    markup = "<html lang='de-AT'><head><script>no</script><style>no</style></head><body><nav>no</nav>out<article class=x><h1>Head &amp; er</h1><p>a<!-- no -->b</p><noscript>no<p>c</article></body>"
    assert pages.page_texts(markup) == ("Head & er a b no c", "a b no c") and pages.declared_language(markup) == "de"
    assert pages.page_text("<body>x <b>y") == "x y" and pages.page_text("plain < text") == "plain < text" and pages.page_texts(None) == ("", "")
    assert pages.page_text("<SCRIPT>no</script >yes<!-- open") == "yes<!-- open"


def test_near_duplicates_keep_one_of_each_document(spark):
    import corpus_pipeline as pipeline

    a, b, c = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40)), " ".join(f"c{i}" for i in range(40))
    docs = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda rows: collections.Counter(r.text for r in pipeline.near_duplicates(spark, docs(rows), SF).collect())
    assert kept([(1, a), (1, a), (1, a), (2, b), (2, a)]) == {a: 1, b: 1}
    found = kept([(1, a), (1, c), (2, b), (3, b + " x"), (None, b), (None, None), (None, None), (4, "")])
    assert found[a] == found[c] == found[None] == found[""] == 1 and found[b] + found[b + " x"] == 1
    assert kept([(1, a), (2, a), (3, b)]) == {a: 1, b: 1}


def test_mixture_shares_exactly(spark):
    import corpus_pipeline as pipeline
    from loomgraph.llm import mixing

    rows = [*[(1, "a b c d", "x")] * 7, *((i, "c " * 30, "y") for i in range(10, 40)), (50, "", "x"), (50, "", "x")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, r.text) for r in pipeline.mixture(spark, docs, SF).collect())
    wanted = collections.Counter()
    for r in mixing.mix(docs).filter("size > 0").collect():
        wanted[r.doc_id] += r.epochs + int(r.drawn)
    assert all(got[i, t] == wanted[i] for i, t, _ in rows if t) and got[50, ""] == 2
