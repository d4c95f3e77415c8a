"""Interleaved document sequences from HTML.

A page becomes an array of parts in reading order: text, and references to media.
Addresses are made absolute with the page's base element or else its address.  An image's address is the first of src (unless that is a placeholder that a
lazy loader replaces), data-src, the largest of srcset or data-srcset, and that of a source of the same picture; a video's poster is an image of its own.
A reference keeps its position, address, alternative text or caption, and the SHA-256
digest of its payload where the page tells it: of a data URI's bytes, from an
integrity attribute, or a digest that is part of the address.  Digests are joined with a table of
payloads; only pages with a digest take part in that shuffle, and of them only the references.

Left out are: script, style and title, and templates, which are inert; the text (not the media) of
nav, footer and aside, of noscript, of svg, and of video and audio (it is for readers without
them).  An element counts as one of these only if its own end tag closes it: where
the end of an enclosing block or of the page does, that tag was forgotten, and its text stays.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written

PART = "struct<position:int,kind:string,text:string,url:string,digest:string,caption:string>"
SEQUENCE = f"page_key binary, page_id bigint, url string, parts array<{PART}>, held array<struct<digest:string,mime:string,payload_bytes:bigint>>"
RESULT_PART = "struct<position:int,kind:string,text:string,url:string,digest:string,caption:string,mime:string,payload_bytes:bigint,resolved:boolean>"
_KINDS = {"img": "image", "image": "image", "video": "video", "audio": "audio", "iframe": "embed", "embed": "embed", "object": "embed"}
_RAW = {"script", "style"}
_FURNITURE = {"nav", "footer", "aside"}
_QUIET = {*_FURNITURE, "noscript", "template", "title", "svg", "video", "audio"}
_BREAKS = {
    *("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "section", "article"),
    *("blockquote", "pre", "hr", "figure", "figcaption", "header", "main", "dl", "dt", "dd", "body", "html", "form"),
}
_VOID = {"img", "image", "br", "hr", "embed", "source", "track", "meta", "link", "input", "wbr", "area", "base", "col"}
_EMPTY = {"template", "title"}  # of _QUIET, those without elements of the page
_TRACKED = (_BREAKS - _VOID) | _QUIET
_END_P = (_BREAKS | _FURNITURE) - {"br"}
_BLANK = re.compile(r"\s+")
_SRCSET = re.compile(r"[\s,]*(\S*[^\s,])(?:\s+([\d.]+)[wxh])?[^,]*(?:,|$)")
_HEX64 = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{64}(?![0-9a-fA-F])")


def data_uri(url: str) -> tuple[str, bytes] | None:
    """(media type, bytes) of a data URI; None if it is malformed."""
    head, comma, body = url[5:].partition(",")
    if not comma:
        return None
    mime = head.split(";")[0].strip().lower() or "text/plain"
    raw = unquote_to_bytes(body)
    if head.lower().rstrip().endswith(";base64"):
        try:
            raw = base64.b64decode(b"".join(raw.split()), validate=True)
        except (binascii.Error, ValueError):
            return None
    return mime, raw


def digest_of(url: str, attrs: dict) -> str | None:
    if url[:5].lower() == "data:":
        found = data_uri(url)
        return hashlib.sha256(found[1]).hexdigest() if found else None
    for word in (attrs.get("integrity") or "").split():
        if word.startswith("sha256-"):
            try:
                raw = base64.b64decode(word[7:], validate=True)
            except (binascii.Error, ValueError):
                continue
            if len(raw) == 32:
                return raw.hex()
    m = _HEX64.search(url)
    return m.group().lower() if m else None


def largest(srcset: str) -> str | None:
    """The address with the largest width or density; of equal ones the first."""
    found = [(float(m[2]) if m[2] and m[2].count(".") < 2 and m[2] != "." else 1.0, m[1]) for m in _SRCSET.finditer(srcset)]
    return max(found, key=lambda x: x[0])[1] if found else None


def address_of(attrs: dict) -> str:
    src, later = (attrs.get("src") or "").strip(), (attrs.get("data-src") or attrs.get("data-original") or "").strip()
    if later and src[:5].lower() in ("", "data:"):
        return later
    many = (attrs.get("srcset") or "").strip() or (attrs.get("data-srcset") or "").strip()
    return src or (largest(many) if many else None) or (attrs.get("data") or attrs.get("href") or attrs.get("xlink:href") or "").strip()


class _Open(NamedTuple):
    """An open element, and what there was before it."""

    tag: str
    parts: int
    figures: int
    in_caption: int
    said: int  # pieces of the caption it stands in
    media: dict | None  # the part of a video or audio


class _Reader(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.based = base, False
        self.source: str | None = None  # of the open picture
        self.parts: list[dict] = []
        self.payloads: dict[str, tuple[str, bytes]] = {}
        self.buffer: list[str] = []
        self.raw: str | None = None
        self.figures: list[tuple[int, list[str]]] = []  # first part of it, caption
        self.in_caption = 0
        self.open: list[_Open] = []
        self.count: Counter[str] = Counter()  # of the tags in open
        self.gone: set[int] = set()  # numbers of parts that are left out

    def flush(self) -> None:
        text = _BLANK.sub(" ", "".join(self.buffer)).strip()
        self.buffer.clear()
        if text:
            self.parts.append({"kind": "text", "text": text, "url": None, "digest": None, "caption": None})

    def refer(self, kind: str, attrs: dict) -> None:
        url = address_of(attrs)
        if not url and kind == "image" and self.source:
            url = self.source
        self.flush()
        if url[:5].lower() == "data:":
            digest, shown = digest_of(url, attrs), None
            if digest:
                self.payloads.setdefault(digest, data_uri(url))
        else:
            digest = digest_of(url, attrs) if url else None
            try:
                shown = urljoin(self.base, url) if url else None
            except ValueError:
                shown = url
        said = _BLANK.sub(" ", attrs.get("alt") or attrs.get("title") or "").strip() or None
        self.parts.append({"kind": kind, "text": None, "url": shown, "digest": digest, "caption": said})

    def enter(self, tag: str, media: dict | None = None) -> None:
        said = len(self.figures[-1][1]) if self.figures else 0
        self.open.append(_Open(tag, len(self.parts), len(self.figures), self.in_caption, said, media))
        self.count[tag] += 1

    def leave(self, tag: str) -> None:
        """Closes the innermost open element of that tag and all within it."""
        if not self.count[tag]:
            return
        while True:
            o = self.open.pop()
            self.count[o.tag] -= 1
            if o.tag in _QUIET:
                self.flush()
                while len(self.figures) > o.figures:
                    self.close_figure()
                self.in_caption = o.in_caption
                if o.tag == tag:
                    self.gone.update(k for k in range(o.parts, len(self.parts)) if tag in _EMPTY or self.parts[k]["kind"] == "text")
                    if self.in_caption and self.figures:
                        del self.figures[-1][1][o.said :]
            if o.tag == tag:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _RAW:
            self.flush()
            self.raw = tag
            return
        known = dict(attrs)
        if tag in _END_P and self.open and self.open[-1].tag == "p":
            self.leave("p")
        if tag == "base" and known.get("href") and not self.based:
            self.based = True
            try:
                self.base = urljoin(self.base, known["href"].strip())
            except ValueError:
                pass
        elif tag == "picture":
            self.source = None
        if tag in _KINDS:
            if tag == "video" and known.get("poster"):
                self.refer("image", {"src": known["poster"], "title": known.get("title")})
            self.refer(_KINDS[tag], known)
            if tag == "img":
                self.source = None
            if tag in _QUIET:
                self.enter(tag, self.parts[-1])
        elif tag == "source" and (known.get("srcset") or known.get("data-srcset")) and not (self.count["video"] or self.count["audio"]):
            self.source = self.source or largest(known.get("srcset") or known["data-srcset"])
        elif tag == "source" and known.get("src"):
            part = next((o.media for o in reversed(self.open) if o.media), None) if self.count["video"] or self.count["audio"] else None
            if part and part["url"] is None and part["digest"] is None:
                self.refer(part["kind"], known)
                new = self.parts.pop()
                part.update(url=new["url"], digest=new["digest"])
        else:
            if tag in _BREAKS or tag in _QUIET:
                self.flush()
            if tag in _TRACKED:
                self.enter(tag)
            if tag == "figure":
                self.figures.append((len(self.parts), []))
            elif tag == "figcaption" and self.figures:
                self.in_caption += 1

    def handle_endtag(self, tag):
        if tag in _RAW:
            self.raw = None
            return
        if tag in _BREAKS:
            self.flush()
        if tag == "figcaption" and self.in_caption:
            self.in_caption -= 1
        elif tag == "figure" and self.figures:
            self.close_figure()
        if tag in ("body", "html"):
            self.end()
        elif tag in _TRACKED:
            self.leave(tag)

    def end(self) -> None:
        """Closes what is open; what has no end tag keeps its text."""
        self.flush()
        self.open.clear()
        self.count.clear()

    def close_figure(self) -> None:
        start, said = self.figures.pop()
        caption = _BLANK.sub(" ", "".join(said)).strip()
        if caption:
            media = [p for p in self.parts[start:] if p["kind"] != "text"]
            for p in media:
                p["caption"] = caption
            if not media:
                self.parts.append({"kind": "text", "text": caption, "url": None, "digest": None, "caption": None})

    def handle_data(self, data):
        if self.raw:
            return
        if self.in_caption and self.figures:
            self.figures[-1][1].append(data)
        else:
            self.buffer.append(data)

    def done(self) -> list[dict]:
        self.close()
        self.flush()
        while self.figures:
            self.close_figure()
        return [{"position": k, **p} for k, p in enumerate(p for n, p in enumerate(self.parts) if n not in self.gone)]


def read_page(html: str, base: str = "") -> tuple[list[dict], dict[str, tuple[str, bytes]]]:
    """A page's parts in reading order, and the payloads that it holds itself, by digest."""
    r = _Reader(base)
    r.feed(html)
    return r.done(), r.payloads


def sequences(pages: DataFrame) -> DataFrame:
    """(page_key, page_id, url, parts, held) of each row of pages; page_key is a digest of
    the row's id, address and text, held tells of the payloads in it."""
    own = pa.list_(pa.struct([("digest", pa.string()), ("mime", pa.string()), ("payload_bytes", pa.int64())]))
    kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "url", "digest", "caption"))]))

    def run(batches):
        for b in batches:
            ids, urls = b.column(0).to_pylist(), b.column(1).to_pylist()
            keys, parts, held = [], [], []
            for i, u, h in zip(ids, urls, b.column(2).to_pylist()):
                keys.append(hashlib.blake2b(repr((i, u, h)).encode("utf-8", "replace"), digest_size=16).digest())
                found, payloads = read_page(h, u or "") if h else ([], {})
                parts.append(found)
                held.append([{"digest": d, "mime": m, "payload_bytes": len(raw)} for d, (m, raw) in payloads.items()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), b.column(0), b.column(1), pa.array(parts, kind), pa.array(held, own)], names=["page_key", "page_id", "url", "parts", "held"]
            )

    picked = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(picked, run, SEQUENCE)


def embedded_payloads(pages: DataFrame) -> DataFrame:
    """(digest, mime, payload) of the data URIs in pages, each digest once."""

    def run(batches):
        for b in batches:
            rows = [(d, m, raw) for h in b.column(0).to_pylist() if h for d, (m, raw) in read_page(h)[1].items()]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.binary()))], names=["digest", "mime", "payload"])

    found = map_arrow(pages.select(F.col("html").cast("string").alias("html")).filter(F.lower("html").contains("data:")), run, "digest string, mime string, payload binary")
    return found.groupBy("digest").agg(F.min("mime").alias("mime"), F.first("payload").alias("payload"))


def interleave(pages: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """(page_id, url, parts) of each row of pages, references resolved.

    payloads has (digest, mime, payload); of rows with one digest the first media
    type by name is taken and the longest payload.  Without it the pages' own data URIs are the
    payloads.  Each part of a page has position, kind, text, url, digest, caption, mime,
    payload_bytes and resolved; a part of text has nulls for the others and resolved
    is null; a reference without digest, or whose digest is unknown, has resolved
    false.  A null or empty html gives no parts; null ids and addresses are carried;
    repeated rows give a row each; other columns are not read; a page of any length is read whole; no pages give no rows.
    What is left out of a page's text (navigation and the like) is told at the top of this module.
    """
    seqs = written(sequences(pages), "sequences")
    if payloads is None:
        sizes = seqs.filter(F.size("held") > 0).select(F.explode("held").alias("h")).select("h.digest", "h.mime", "h.payload_bytes")
    else:
        sizes = payloads.filter("digest is not null").select(F.lower("digest").alias("digest"), "mime", F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    known = sizes.groupBy("digest").agg(F.min("mime").alias("mime"), F.max("payload_bytes").alias("payload_bytes"))
    has = F.exists("parts", lambda p: p["digest"].isNotNull())
    refs = seqs.filter(has).select("page_key", F.explode("parts").alias("p")).select("page_key", F.col("p.position").alias("position"), F.col("p.digest").alias("digest"))
    found = (
        refs.filter("digest is not null")
        .distinct()
        .join(known, "digest")
        .groupBy("page_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("mime", "payload_bytes")))).alias("__known"))
    )

    def parts(lookup) -> F.Column:
        def one(p):
            got = lookup(p)
            is_ref = p["kind"] != "text"
            return F.struct(
                *(p[n].alias(n) for n in ("position", "kind", "text", "url", "digest", "caption")),
                F.when(is_ref, got["mime"]).alias("mime"),
                F.when(is_ref, got["payload_bytes"]).alias("payload_bytes"),
                F.when(is_ref, got.isNotNull()).alias("resolved"),
            )

        return F.transform("parts", one).cast(f"array<{RESULT_PART}>").alias("parts")

    nothing = F.lit(None).cast("struct<mime:string,payload_bytes:bigint>")
    plain = seqs.filter(~has).select("page_id", "url", parts(lambda p: nothing))
    joined = seqs.filter(has).join(found, "page_key", "left").select("page_id", "url", parts(lambda p: F.col("__known")[p["position"]]))
    return plain.unionByName(joined)
