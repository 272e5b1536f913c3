"""EPUB packages and markup blocks (ids A7, A13, J1-J4), and EPUB files as a sink.

Archives are unzipped and markup is parsed in Arrow batches, a package at a time; what
follows - units, ids, hashes, visual candidates - is relational.
"""

from __future__ import annotations

import hashlib
import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_TOTAL_BYTES, MOST_RATIO = 10_000, 64 << 20, 512 << 20, 200
#: Text and overhead of the books in a frame that a worker gives back.
FRAME_BYTES = 4 << 20
LEAF_KINDS = {**dict.fromkeys(("p", "li", "blockquote", "pre", "dt", "dd", "aside"), "Text"), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "Heading"), "figcaption": "Caption"}
SKIPPED = {"script", "style", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "image"}
#: A start tag of these ends an open paragraph.
_ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd".split())
_OPEN_ENDED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

BLOCK_SCHEMA = "unit string, block_idx int, kind string, text string, fragment_id string"
IMAGE_SCHEMA = "resource string, in_figure boolean, presentation boolean, empty_alt boolean"


def safe_path(base: str, target: str) -> str | None:
    """A path inside the archive; null for absolute ones and those that leave it."""
    target = unquote(target.split("#")[0].split("?")[0])
    if not target or target.startswith(("/", "\\")) or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target) or "\\" in target or "\0" in target:
        return None
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), target))
    return None if path.startswith("..") or path.startswith("/") else path


class _Blocks(HTMLParser):
    """Leaf blocks in order, and images with where they stand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, str | None]] = []
        self.images: list[tuple[str, bool, bool, bool]] = []
        self.loose: list[str] = []
        self.stack: list[str] = []
        self.leaf: list | None = None
        self.body = False
        self.any_body = False
        self.links = 0

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "body":
            self.body = self.any_body = True
        if tag in ("img", "image"):
            hidden = given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in ("presentation", "none")
            source = given.get("src") or given.get("xlink:href") or given.get("href") or ""
            if source:
                self.images.append((source, "figure" in self.stack, hidden, "alt" in given and not given["alt"].strip()))
        if tag == "a" and re.match(r"https?:", given.get("href", "")):
            self.links += 1
        if tag in VOID:
            if tag == "br" and self.leaf is not None:
                self.leaf[2].append(" ")
            return
        if self.leaf is not None and (self.leaf[0] in _OPEN_ENDED.get(tag, set()) or (self.leaf[0] == "p" and tag in _ENDS_P)):
            self._close(self.leaf[0])
        self.stack.append(tag)
        if self.leaf is None and tag in LEAF_KINDS and not SKIPPED & set(self.stack):
            self.leaf = [tag, given.get("id"), [], len(self.stack)]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag):
        if self.leaf is not None and self.leaf[0] == tag and (tag not in self.stack or len(self.stack) - self.stack[::-1].index(tag) <= self.leaf[3]):
            text = re.sub(r"\s+", " ", "".join(self.leaf[2])).strip()
            if text:
                self.blocks.append((LEAF_KINDS[tag], text, self.leaf[1]))
            self.leaf = None
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_endtag(self, tag):
        # the end of an element around the leaf ends the leaf
        if self.leaf is not None and tag != self.leaf[0] and tag in self.stack and len(self.stack) - self.stack[::-1].index(tag) < self.leaf[3]:
            self._close(self.leaf[0])
        self._close(tag)

    def handle_data(self, data):
        if SKIPPED & set(self.stack) or "head" in self.stack or "title" in self.stack:
            return
        if self.leaf is not None:
            self.leaf[2].append(data)
        self.loose.append(data)

    def finish(self):
        self.close()
        if self.leaf is not None:
            self._close(self.leaf[0])
        if not self.blocks:  # the whole body is the block
            text = re.sub(r"\s+", " ", "".join(self.loose)).strip()
            if text:
                self.blocks.append(("Text", text, None))
        return self


def parse_markup(text: str | None) -> _Blocks:
    parser = _Blocks()
    parser.feed(text or "")
    return parser.finish()


def markup_blocks(pages: DataFrame, key: str, content: str) -> DataFrame:
    """J1 over a column of markup: (key, block_idx, kind, text, fragment_id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, kind, text, fragment) for k, c in zip(batch["k"], batch["c"], strict=True) for i, (kind, text, fragment) in enumerate(parse_markup(c).blocks)]
            yield pd.DataFrame(rows, columns=["k", "block_idx", "kind", "text", "fragment_id"])

    source = pages.select(F.col(key).cast("long").alias("k"), F.col(content).cast("string").alias("c"))
    out = source.mapInPandas(run, "k long, block_idx int, kind string, text string, fragment_id string")
    return out.withColumnRenamed("k", key)


def markup_images(pages: DataFrame, key: str, content: str) -> DataFrame:
    """J4 over a column of markup: (key, use_idx, resource, in_figure, presentation, empty_alt)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *use) for k, c in zip(batch["k"], batch["c"], strict=True) for i, use in enumerate(parse_markup(c).images)]
            yield pd.DataFrame(rows, columns=["k", "use_idx", "resource", "in_figure", "presentation", "empty_alt"])

    source = pages.select(F.col(key).cast("long").alias("k"), F.col(content).cast("string").alias("c"))
    return source.mapInPandas(run, "k long, use_idx int, " + IMAGE_SCHEMA).withColumnRenamed("k", key)


_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/", "n": "urn:oasis:names:tc:opendocument:xmlns:container"}


def open_package(raw: bytes) -> dict:
    """Entries, manifest, spine and metadata of a package; ValueError if it breaks a rule."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = z.infolist()
        if len(infos) > MOST_ENTRIES:
            raise ValueError("too many entries")
        total = 0
        for i in infos:
            total += i.file_size
            if i.file_size > MOST_ENTRY_BYTES or total > MOST_TOTAL_BYTES or (i.compress_size and i.file_size / i.compress_size > MOST_RATIO and i.file_size > 1 << 20):
                raise ValueError(f"entry {i.filename} is too large")
            if not i.is_dir() and safe_path("", i.filename) != i.filename:
                raise ValueError(f"entry {i.filename} leaves the archive")
        files = {i.filename: z.read(i) for i in infos if not i.is_dir()}
    if "META-INF/container.xml" not in files:
        raise ValueError("no container.xml")
    root = ElementTree.fromstring(files["META-INF/container.xml"]).find(".//c:rootfile", _NS)
    package = root.get("full-path") if root is not None else None
    if package not in files:
        raise ValueError("no package document")
    opf = ElementTree.fromstring(files[package])
    manifest = {}
    for item in opf.iterfind(".//o:manifest/o:item", _NS):
        path = safe_path(package, item.get("href", ""))
        if path is None:
            raise ValueError("manifest leaves the archive")
        manifest[item.get("id")] = {"path": path, "media_type": item.get("media-type", ""), "properties": set((item.get("properties") or "").split())}
    spine = [(manifest[r.get("idref")], (r.get("linear") or "yes").lower() != "no") for r in opf.iterfind(".//o:spine/o:itemref", _NS) if r.get("idref") in manifest]
    meta = lambda tag: next((e.text.strip() for e in opf.iterfind(f".//d:{tag}", _NS) if e.text and e.text.strip()), None)
    covers = {m.get("content") for m in opf.iterfind(".//o:metadata/o:meta", _NS) if m.get("name") == "cover"}
    cover = next((v["path"] for k, v in manifest.items() if k in covers or "cover-image" in v["properties"]), None)
    guide = {g.get("type", ""): safe_path(package, g.get("href", "")) for g in opf.iterfind(".//o:guide/o:reference", _NS)}
    return {"files": files, "package": package, "manifest": manifest, "spine": spine, "title": meta("title"), "identifier": meta("identifier"), "language": meta("language"), "cover": cover, "guide": guide}


def navigation_targets(book: dict) -> set[tuple[str, str]]:
    """(path, fragment) that the table of contents points to; an empty fragment is a document's start."""
    nav = next((v["path"] for v in book["manifest"].values() if "nav" in v["properties"]), None)
    if nav is None or nav not in book["files"]:
        return set()
    text = book["files"][nav].decode("utf-8", "replace")
    toc = re.search(r"<nav\b[^>]*epub:type\s*=\s*[\"'][^\"']*\btoc\b[^\"']*[\"'][^>]*>(.*?)</nav>", text, re.S | re.I)
    out = set()
    for m in re.finditer(r"<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']", toc[1] if toc else text, re.I):
        href = html.unescape(m[1])
        path = nav if href.startswith("#") else safe_path(nav, href)
        if path:
            out.add((path, unquote(href.split("#", 1)[1]) if "#" in href else ""))
    return out


def read_book(raw: bytes | None) -> dict:
    """Everything of one package as plain rows, or its error."""
    try:
        book = open_package(raw or b"")
    except (zipfile.BadZipFile, ValueError, ElementTree.ParseError, KeyError, RuntimeError, NotImplementedError, OSError) as e:
        return {"error": f"{type(e).__name__}: {e}", "blocks": [], "images": [], "units": []}
    targets = navigation_targets(book)
    images: list[tuple] = []
    blocks: list[tuple] = []
    units: list[tuple] = []
    body_start = book["guide"].get("text") or book["guide"].get("bodymatter")
    started = body_start is None
    for n, (item, linear) in enumerate(book["spine"]):
        path = item["path"]
        started = started or path == body_start
        parsed = parse_markup(book["files"].get(path, b"").decode("utf-8", "replace"))
        is_nav, is_cover = "nav" in item["properties"], path == book["guide"].get("cover")
        units.append((n, path, is_nav or is_cover or not linear, started, len(parsed.blocks), len(parsed.images), parsed.links))
        for i, (kind, text, fragment) in enumerate(parsed.blocks):
            named = (path, fragment or "") in targets and (fragment or i == 0)
            blocks.append((n, i, "Heading" if named and kind == "Text" else kind, text, fragment))
        for source, in_figure, presentation, empty_alt in parsed.images:
            resource = safe_path(path, source)
            if resource:
                size = len(book["files"].get(resource, b""))
                images.append((n, resource, in_figure, presentation, empty_alt, resource == book["cover"] or is_cover, is_nav, not started, size))
    return {"error": None, "title": book["title"], "identifier": book["identifier"], "language": book["language"], "blocks": blocks, "images": images, "units": units}


BOOK_SCHEMA = """doc_id long, error string, title string, identifier string, language string,
  units array<struct<unit_no:int,unit:string,presentation_only:boolean,in_body:boolean,blocks:int,images:int,links:int>>,
  blocks array<struct<unit_no:int,block_idx:int,kind:string,text:string,fragment_id:string>>,
  images array<struct<unit_no:int,resource:string,in_figure:boolean,presentation:boolean,empty_alt:boolean,is_cover:boolean,is_nav:boolean,is_preliminary:boolean,byte_length:int>>"""


def read_books(files: DataFrame) -> DataFrame:
    """(doc_id, content) to a row a package; a broken one has its error and no blocks."""
    columns = ["doc_id", "error", "title", "identifier", "language", "units", "blocks", "images"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a frame is yielded as soon as its books are large: a worker holds few, however many a batch has
        for batch in batches:
            rows, held = [], 0
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                b = read_book(bytes(content) if content is not None else None)
                rows.append((doc_id, b["error"], b.get("title"), b.get("identifier"), b.get("language"), b["units"], b["blocks"], b["images"]))
                held += 1024 + sum(len(x[3]) + 256 for x in b["blocks"])
                if held >= FRAME_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return files.select("doc_id", "content").mapInPandas(run, BOOK_SCHEMA)


# --- sink -------------------------------------------------------------------------------------

_XHTML = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{title}</title></head><body>{body}</body></html>'


def make_book(title: str, language: str, identifier: str, sections: list[tuple[str | None, list[tuple[str, str]]]], assets: list[tuple[str, str, bytes, str]] = ()) -> bytes:
    """An EPUB of sections (heading, (kind, text)...), a table of contents and verified assets (name, type, bytes, sha256)."""
    e = html.escape
    out = io.BytesIO()
    names = [f"section-{i:06d}.xhtml" for i in range(1, len(sections) + 1)]
    with zipfile.ZipFile(out, "w") as z:
        fixed = lambda name, data, how=zipfile.ZIP_DEFLATED: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, how)
        fixed("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        fixed("META-INF/container.xml", f'<container version="1.0" xmlns="{_NS["c"]}"><rootfiles><rootfile full-path="OPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        for name, (_heading, blocks) in zip(names, sections, strict=True):
            body = "".join(f"<h2>{e(t)}</h2>" if kind == "Heading" else f"<p>{e(t)}</p>" for kind, t in blocks)
            fixed(f"OPS/{name}", _XHTML.format(title=e(title), body=body))
        links = "".join(f'<li><a href="{n}">{e(h or f"Section {i}")}</a></li>' for i, (n, (h, _)) in enumerate(zip(names, sections, strict=True), 1))
        fixed("OPS/nav.xhtml", _XHTML.format(title=e(title), body=f'<nav epub:type="toc"><ol>{links}</ol></nav>'))
        items = "".join(f'<item id="s{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names, 1))
        for i, (name, kind, data, digest) in enumerate(assets):
            if hashlib.sha256(data).hexdigest() != digest:
                raise ValueError(f"asset {name} has another digest")
            fixed(f"OPS/{name}", data)
            items += f'<item id="a{i}" href="{name}" media-type="{kind}"/>'
        spine = "".join(f'<itemref idref="s{i}"/>' for i in range(1, len(names) + 1))
        fixed(
            "OPS/package.opf",
            f'<package xmlns="{_NS["o"]}" version="3.0" unique-identifier="id"><metadata xmlns:dc="{_NS["d"]}"><dc:identifier id="id">{e(identifier)}</dc:identifier><dc:title>{e(title)}</dc:title>'
            f'<dc:language>{e(language)}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>',
        )
    return out.getvalue()


def export_books(elements: DataFrame) -> DataFrame:
    """(doc_id, content), a book for each document; runs of equal segment ids are its sections.

    elements: doc_id, ordinal, segment_id, kind, text. A document is one group: as large as a
    book, never larger.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["text"].notna()].sort_values("ordinal")
        sections: list[tuple[str | None, list]] = []
        last: object = object()
        for segment, kind, text in zip(rows["segment_id"], rows["kind"], rows["text"], strict=True):
            if segment != last:
                sections.append((None, []))
                last = segment
            sections[-1][1].append((kind, text))
        named = [(next((t for k, t in blocks if k == "Heading"), None), blocks) for _, blocks in sections]
        doc_id = int(rows["doc_id"].iloc[0]) if len(rows) else 0
        return pd.DataFrame({"doc_id": [doc_id], "content": [make_book(f"Document {doc_id}", "en", f"doc-{doc_id}", named)]}) if len(rows) else pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "content": pd.Series(dtype="object")})

    return elements.select("doc_id", "ordinal", "segment_id", "kind", "text").groupBy("doc_id").applyInPandas(run, "doc_id long, content binary")
