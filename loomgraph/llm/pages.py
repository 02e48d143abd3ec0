"""What a web page says: its text, the language its markup declares, its address."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch
from .textio import portions, record

#: Elements whose content is no text of the page, and those that head its text.
DROPPED, HEADINGS = frozenset(("script", "style", "nav", "template", "noscript")), frozenset(f"h{i}" for i in range(1, 7))
_TAG = re.compile(r"<[^>]*>")
_ARTICLE, _ARTICLE_END, _BODY = re.compile(r"(?i)<article\b"), re.compile(r"(?i)</article\s*>"), re.compile(r"(?i)<body\b")
_HTML, _LANG = re.compile(r"(?i)<html\b"), re.compile(r"(?i)\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")


@cache
def _openings(names: frozenset[str], comments: bool) -> re.Pattern | None:
    parts = ["!--"] * comments + ([rf"({'|'.join(sorted(names))})\b"] if names else [])
    return re.compile(f"(?i)<(?:{'|'.join(parts)})") if parts else None


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"(?i)</{name}\s*>")


def without(markup: str, names: frozenset[str], comments: bool = True) -> str:
    """Markup without comments and some elements, read once from left to right.

    What isn't closed stays, but for its tag; such a name isn't looked for again, so markup full of tags
    that are never closed takes no longer than other markup.
    """
    out, kept, at = [], 0, 0
    while (pattern := _openings(names, comments)) and (m := pattern.search(markup, at)):
        name = m[1].lower() if names and m[1] else None
        if name is None:
            end = markup.find("-->", m.end())
            end = end + 3 if end >= 0 else -1
        else:
            closed = _closing(name).search(markup, m.end())
            end = closed.end() if closed else -1
        if end < 0:
            names, comments, at = names - {name}, comments and name is not None, m.start()
            continue
        out.append(markup[kept : m.start()])
        kept = at = end
    out.append(markup[kept:])
    return " ".join(out)


def _main_part(plain: str) -> str:
    """What the first article's tag and the last article's end enclose, else the body, else all."""
    first = _ARTICLE.search(plain)
    begin = plain.find(">", first.end()) + 1 if first else 0
    if begin:
        last = None
        for last in _ARTICLE_END.finditer(plain, begin):  # noqa: B007
            pass
        if last:
            return plain[begin : last.start()]
    body = _BODY.search(plain)
    begin = plain.find(">", body.end()) + 1 if body else 0
    return plain[begin:]


def _words(markup: str) -> str:
    end = markup.rfind(">") + 1  # up to here every tag that opens is closed
    return " ".join(html.unescape(_TAG.sub(" ", markup[:end]) + markup[end:]).split())


def page_texts(markup: str | None) -> tuple[str, str]:
    """Words of a page's article, or of its body, or of all of it, with single blanks between them; with and without headings."""
    if not markup:
        return "", ""
    main = _main_part(without(markup, DROPPED))
    return _words(main), _words(without(main, HEADINGS, False))


def page_text(markup: str | None) -> str:
    return page_texts(markup)[0]


def declared_language(markup: str | None) -> str | None:
    opened = _HTML.search(markup or "")
    end = markup.find(">", opened.end()) if opened else -1
    found = _LANG.search(markup[opened.end() : end]) if end >= 0 else None
    return found[1].lower() if found else None


def text_key(text: str | None) -> bytes | None:
    """128 bits of a hash of a text's words; null without words."""
    plain = " ".join((text or "").split())
    return hashlib.blake2b(plain.encode(), digest_size=16).digest() if plain else None


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("declared", pa.string()), ("text", pa.string()), ("text_key", pa.binary())])
READ_SQL = "page_id long, url string, declared string, text string, text_key binary"


def read_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, declared, text, text_key`` of every page.

    ``text_key`` is that of the running text, without headings, by which a page is found to show a document.

    Null or empty markup: no text, nothing declared, no key. Very long or hostile markup: whole, in time
    that grows with its length alone. Null ids: kept. Repeated rows: read alike. Empty table: no rows.
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "html"):
            marked = batch.column(2).to_pylist()
            texts, running = zip(*map(page_texts, marked), strict=True)
            yield record(READ, page_id=batch.column(0), url=batch.column(1), declared=[declared_language(m) for m in marked], text=list(texts), text_key=[text_key(t) for t in running])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, READ_SQL)


def text_keys(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key`` of documents, by which pages that show them are found.

    Null text, an empty one or one without words: null key. Very long texts: whole. Null ids: kept.
    Repeated rows: alike. Empty table: no rows. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            yield record(schema, doc_id=batch.column(0), text_key=[text_key(t) for t in batch.column(1).to_pylist()])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text_key binary")


def labels_of_pages(read: DataFrame, docs: DataFrame, labels: DataFrame, bad: Column) -> DataFrame:
    """``page_id, url, bad`` of the pages that show a labelled document's text.

    ``bad`` is a condition on the columns of ``labels``; a text is bad if any document with it is.

    Null ids, texts or labels: never found. Repeated rows of pages: each has its row; of documents and
    labels: as one. Very long texts: by their keys. Empty tables: no rows. Other columns are not read.
    """
    judged = labels.select(F.col("doc_id").cast("long").alias("doc_id"), bad.alias("bad")).filter("doc_id IS NOT NULL AND bad IS NOT NULL")
    known = text_keys(docs).join(judged, "doc_id").filter("text_key IS NOT NULL").groupBy("text_key").agg(F.max("bad").alias("bad"))
    known = Scratch(docs.sparkSession, "labels").keep(known, "known")  # so that the join below can split a hot text
    return read.select("page_id", "url", "text_key").join(known, "text_key").select("page_id", "url", "bad")
