"""Media columns: interleaved sequences of text and media, payloads resolved by digest.

HTML becomes an ordered list of text and media-reference structs. References name a payload by its digest; a join on the
digest brings the stored bytes, while position and caption stay with the reference.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm._common import in_slices, table

#: Bytes in a row of the stored picture; payloads are padded to whole rows by a byte that UTF-8 never uses.
ROW, PAD = 576, 255
#: Payloads of one digest are kept once for each of so many salts, so that copies meet in as many groups.
SALTS = 256
LEVEL = 5
#: Pictures that a task keeps for further copies.
HELD = 64
ITEMS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_MEDIA = {"img", "audio", "video", "source", "embed"}
_PNG = b"\x89PNG\r\n\x1a\n"


def png_encode(payload: bytes, width: int = ROW) -> bytes:
    """A greyscale picture of 8-bit samples, row by row; the payload must fill its rows."""
    height, over = divmod(len(payload), width)
    if over or not height:
        raise ValueError("the payload must be a positive multiple of the width")
    samples = np.zeros((height, width + 1), np.uint8)  # each row begins with its filter: none
    samples[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(samples.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def png_decode(stored: bytes) -> bytes:
    """The samples of an 8-bit greyscale picture; checksums are verified and all row filters undone."""
    if stored[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, laced) != (8, 0, 0):
                raise ValueError("8-bit greyscale only")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if not raw[:, 0].any():
        return raw[:, 1:].tobytes()
    out, above = [], np.zeros(width, np.int32)
    for line in raw:
        kind, row = int(line[0]), line[1:].astype(np.int32)
        if kind == 1:
            row = np.cumsum(row) & 255
        elif kind == 2:
            row = (row + above) & 255
        elif kind in (3, 4):
            for i in range(width):
                a, b, c = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
                guess = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[i] = (row[i] + guess) & 255
        above = row
        out.append(row.astype(np.uint8).tobytes())
    return b"".join(out)


class _Interleaver(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None
        self.hidden = 0

    def _close(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self._close()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA and a.get("src"):
            self._close()
            self.items.append({"kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt") or None})
        elif tag not in ("b", "i", "em", "strong", "a", "span", "u", "sub", "sup", "code", "br"):
            self._close()
        elif tag == "br":
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure or 0 :] if self.figure is not None else self.items[-1:]:
                if item["kind"] == "media":
                    item["caption"] = said or item["caption"]
        elif tag == "figure":
            self._close()
            self.figure = None
        elif tag in ("p", "div", "section", "article", "li", "td", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"):
            self._close()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def interleaved(html: str | None) -> list[dict]:
    """Text and media references of a page in order, numbered from 0; a figure's caption goes to its media."""
    parser = _Interleaver()
    parser.feed(html or "")
    parser.close()
    parser._close()
    return [{"position": k, **item} for k, item in enumerate(parser.items)]


def sequences(html: Column) -> Column:
    @F.pandas_udf(ITEMS)
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([interleaved(p) for p in pages])

    return of(html)


def stored_media(payloads: DataFrame, salts: int = SALTS) -> DataFrame:
    """payloads (salt, digest, payload) -> (salt, digest, stored): one picture for each digest and salt. Copies that a task
    meets one after the other are encoded once; HELD pictures wait for theirs."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, bytes] = {}
        for batch in batches:
            out = []
            for digest, payload in zip(batch["digest"], batch["payload"]):
                picture = held.pop(digest, None) or png_encode(payload)
                held[digest] = picture  # the latest last
                if len(held) > HELD:
                    del held[next(iter(held))]
                out.append(picture)
            yield pd.DataFrame({"salt": batch["salt"], "digest": batch["digest"], "stored": out})

    return in_slices(payloads.select("salt", "digest", "payload"), store, "salt int, digest string, stored binary").groupBy("digest", "salt").agg(F.first("stored").alias("stored"))


def resolve(pages: DataFrame, media: DataFrame, keys: Sequence[str], salts: int = SALTS) -> DataFrame:
    """pages (keys, html) and media (digest, salt, stored) -> one row for each item of a sequence, with its bytes.

    Rows are (keys, position, kind, text, ref, caption, stored). The key columns choose the salt, so references to one
    payload are spread over ``salts`` groups. An unknown digest leaves ``stored`` null; order and captions are as parsed.
    Null or empty html: no rows.
    """
    items = pages.select(*keys, F.explode(sequences(F.col("html"))).alias("item")).select(*keys, "item.*")
    items = items.withColumn("digest", F.regexp_extract("ref", "^media:([0-9a-f]+)$", 1)).withColumn("salt", salt_of(keys, salts))
    return items.join(media, ["digest", "salt"], "left").drop("digest", "salt")


def assemble(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The resolved items of each page again as one array in page order."""
    return items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "kind", "text", "ref", "caption", "stored"))).alias("items"))


def salt_of(keys: Sequence[str], salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")


def payload_of(text: Column) -> Column:
    """A text's UTF-8 bytes, padded to a positive multiple of a row."""
    n = F.octet_length(text)
    pad = F.when(n == 0, ROW).otherwise(F.pmod(-n, F.lit(ROW)))
    return F.concat(text.cast("binary"), F.unhex(F.repeat(F.lit(f"{PAD:02X}"), pad)))


def page_of(doc_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<article><p>Document "), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(' as a picture.</p><figure><img src="media:'), digest, F.lit(f'"><figcaption>{escape("one sample a byte")}</figcaption></figure></article>'))


def feature(payload: bytes) -> str:
    """Mean, deviation and a histogram of 16 bins of the samples."""
    x = np.frombuffer(payload, np.uint8)
    return f"mean={x.mean():.4f};std={x.std():.4f};hist=" + ",".join(map(str, np.bincount(x >> 4, minlength=16).tolist()))


def measured(items: DataFrame) -> DataFrame:
    """Read stored bytes back and describe them: the media items with their digests, sizes and feature, and their place and
    caption as parsed. An item whose reference wasn't resolved has nulls."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        for batch in batches:
            rows = []
            for doc_id, stored in zip(batch["doc_id"], batch["stored"]):
                if stored is None:
                    rows.append((doc_id, *[None] * 7))
                    continue
                payload = png_decode(stored)
                rows.append((doc_id, len(payload.rstrip(bytes([PAD]))), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), sha256(stored).hexdigest(), feature(payload)))
            batch = batch.reset_index(drop=True)
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            whole = {n: pd.array(out[n].tolist(), dtype="Int64") for n in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")}
            yield out.assign(doc_id=batch["doc_id"], **whole, position=batch["position"], caption=batch["caption"])

    kind = items.schema["doc_id"].dataType.simpleString()
    return in_slices(items.filter("kind = 'media'").select("doc_id", "stored", "position", "caption"), read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, position int, caption string")


def text_media(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every text as a picture in an interleaved document, resolved by digest, read back and measured.

    * null or empty text: one row of padding. Equal texts: equal stored bytes and values.
    * repeated rows: one result each. Null doc_id: kept as null. Empty table: no rows. Extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("number", F.xxhash64("doc_id", "text"))
    base = base.withColumn("payload", payload_of(F.col("text"))).withColumn("digest", F.sha2("payload", 256))
    media = stored_media(base.withColumn("salt", salt_of(["doc_id", "number"], salts)))
    pages = base.select("doc_id", "number", page_of(F.col("doc_id"), F.col("digest")).alias("html"))
    return measured(resolve(pages, media, ["doc_id", "number"], salts))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
