"""Rows from text and markup: images with their captions, packed chunks, routed paragraphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions import text as T
from winnow.operators.filters import score_gate, size_gate

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Images(HTMLParser):
    """Keeps the open elements; an image's caption and its next paragraph among siblings arrive later."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = [{"tag": "", "waiting": [], "text": None}]
        self.found: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p" and any(x["tag"] == "p" for x in self.open) and self.open[-1]["tag"] == "p":
            self.handle_endtag("p")
        at = dict(attrs)
        if tag == "img":
            figure = next((x for x in reversed(self.open) if x["tag"] == "figure"), None)
            image = {"src": at.get("src") or "", "alt": (at.get("alt") or "").strip(), "p": None, "figure": figure}
            self.found.append(image)
            self.open[-1]["waiting"].append(image)
            return
        if tag in _VOID:
            return
        node = {"tag": tag, "waiting": [], "text": [] if tag in ("figcaption", "p") else None, "caption": None, "takers": []}
        if tag == "p":
            node["takers"], self.open[-1]["waiting"] = self.open[-1]["waiting"], []
        self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if not any(x["tag"] == tag for x in self.open[1:]):
            return
        while True:
            node = self.open.pop()
            if node["tag"] == "figcaption":
                figure = next((x for x in reversed(self.open) if x["tag"] == "figure"), None)
                if figure is not None and figure["caption"] is None:
                    figure["caption"] = "".join(node["text"])
            for image in node.get("takers", ()):
                image["p"] = "".join(node["text"])
            if node["tag"] == tag:
                return

    def handle_data(self, data: str) -> None:
        part = data.strip()
        for x in self.open:
            if x["text"] is not None and part:
                x["text"].append(part)

    def images(self, base: str) -> list[tuple[str, str]]:
        while len(self.open) > 1:
            self.handle_endtag(self.open[-1]["tag"])
        out = []
        for i in self.found:
            text = (i["figure"] or {}).get("caption") or i["alt"] or (i["p"] or "")[:300]
            if i["src"] and text:
                out.append((urljoin(base, i["src"]) if base else i["src"], text))
        return out


def html_images(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, n, src, text) of each image with a caption, an alt text or a paragraph after it, in page order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, base, page in zip(b["k"], b["u"], b["h"]):
                parser = _Images()
                parser.feed(page or "")
                parser.close()
                out += [(k, n, s, t) for n, (s, t) in enumerate(parser.images(base or ""))]
            yield pd.DataFrame(out, columns=[key, "n", "src", "text"])

    rows = pages.select(F.col(key).cast("bigint").alias("k"), F.col(url).alias("u"), F.col(html).alias("h")).filter("k IS NOT NULL AND contains(lower(h), '<img')")
    return rows.mapInPandas(run, f"{key} bigint, n int, src string, text string")


#: (address) -> bytes, or None where nothing comes back: brought by the caller, run once per address by the executors.
Fetch = Callable[[str], bytes | None]


def fetched(rows: DataFrame, fetch: Fetch, address: str = "src") -> DataFrame:
    """rows with content and image_path, a name made of the address's md5 and its ending; without those that cannot be fetched. A fetch that
    raises counts as nothing: a page's other images stay."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for a in b:
                try:
                    out.append(fetch(a))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pd.Series(out, dtype=object)

    got = rows.withColumn("content", F.pandas_udf(run, "binary").asNondeterministic()(F.col(address))).filter("content IS NOT NULL")
    low = F.lower(address)
    ending = F.when(low.contains(".png"), ".png").when(low.contains(".webp"), ".webp").when(low.contains(".gif"), ".gif").when(low.contains(".jpeg"), ".jpeg").otherwise(".jpg")
    return got.withColumn("image_path", F.concat(T.short_hash(F.col(address)), ending))


def web_samples(pages: DataFrame, fetch: Fetch, size: Callable[[bytes], tuple[int, int] | None], clip: Callable[[DataFrame], DataFrame] | None = None, least_clip: float = 0.15) -> DataFrame:
    """Samples (image_path, source_text, source_type, url, content) of web pages: their images with text, fetched, those of a
    usable size kept, and, where `clip` adds a column of that name, those that fit their text. size: (width, height) of an image."""
    rows = fetched(html_images(pages), fetch)

    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([size(x) or (None, None) for x in b], columns=["width", "height"]).astype("Int64")

    measured = rows.withColumn("__s", F.pandas_udf(sizes, "width bigint, height bigint")(F.col("content"))).withColumns({"width": F.col("__s.width"), "height": F.col("__s.height")})
    kept = size_gate(measured).select("image_path", F.col("text").alias("source_text"), F.lit("web_image").alias("source_type"), F.col("src").alias("url"), "content")
    return kept if clip is None else score_gate(clip(kept), "clip", least_clip)


def pdf_samples(files: DataFrame, render: Callable[[bytes], Iterable[tuple[bytes, bytes]]], read: Callable[[bytes], str]) -> DataFrame:
    """Samples (image_path, source_text, source_type, path, page, region, text_length, content) of PDF files (path, content).

    render: (picture file, raw pixels) of each page in turn; read: a picture's text. A page's name has its number and the hash of its
    first 4096 bytes of pixels; its text is the caption found on it, else how it begins. A file that fails gives no page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    out += [(path, n, picture, bytes(pixels[:4096]), read(picture)) for n, (picture, pixels) in enumerate(render(data))]
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(out, columns=["path", "page", "content", "head", "text"])

    rows = files.select("path", "content").mapInPandas(run, "path string, page int, content binary, head binary, text string")
    name = F.format_string("page_%04d_%s.png", F.col("page"), T.short_hash(F.col("head"), 10))
    return rows.select(name.alias("image_path"), T.caption(F.col("text")).alias("source_text"), F.lit("pdf_scan").alias("source_type"), "path", "page", F.lit("full_page").alias("region"), F.length(F.coalesce("text", F.lit(""))).alias("text_length"), "content")


def packed(sentences: list[str], least: int = 300, most: int = 600, overlap: int = 0, small: int = 200) -> list[str]:
    """Sentences put together to chunks of least to most characters; what is small joins the chunk before it."""
    chunks: list[str] = []
    part: list[str] = []
    size = 0
    for s in sentences:
        if part and size >= least and size + len(s) > most:
            chunks.append(" ".join(part))
            tail: list[str] = []
            while overlap and len(tail) < len(part) and sum(map(len, tail)) < overlap:
                tail.insert(0, part[-1 - len(tail)])
            part, size = tail, sum(map(len, tail))
        part.append(s)
        size += len(s)
    if part:
        chunks.append(" ".join(part))
    out: list[str] = []
    for c in chunks:
        if out and len(c) < small and len(out[-1]) + len(c) <= most + 200:
            out[-1] += " " + c
        else:
            out.append(c)
    return out


def chunks(df: DataFrame, key: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """(key, n, chunk) of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, n, c) for k, s in zip(b["k"], b["s"]) for n, c in enumerate(packed(list(s), **sizes))]
            yield pd.DataFrame(out, columns=[key, "n", "chunk"])

    rows = df.select(F.col(key).cast("bigint").alias("k"), T.sentences(F.col(text)).alias("s")).filter("k IS NOT NULL AND size(s) > 0")
    return rows.mapInPandas(run, f"{key} bigint, n int, chunk string")


def routed(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(key, n, kind, paragraph): paragraphs of `least` characters or more; one with a question mark is a question."""
    rows = df.select(key, F.posexplode(T.paragraphs(F.col(text), least)).alias("n", "paragraph"))
    return rows.select(key, "n", F.when(F.col("paragraph").contains("?"), "question").otherwise("answer").alias("kind"), "paragraph")
