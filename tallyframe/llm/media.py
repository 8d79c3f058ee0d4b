"""Media columns: bytes kept losslessly as grey PNG images in binary columns, read back with every checksum tested,
and hashed by their low frequencies.

The encoder and the decoder are written against the PNG format: chunks with CRC-32, one zlib stream, and a filter
per image row, the one of the five whose residuals have the least sum of absolute values. Unfiltering runs in numpy
along the anti-diagonals of many images at once: a sample depends on its neighbours to the left, above and in the
corner, which lie on the two diagonals before. Nothing is shuffled; each row stands alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import free_names, other_columns, utf8
from tallyframe.session import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
BLOCK = 64
SIDE, LOW = 32, 8
LEVEL = 6
#: Samples of images of like heights that are unfiltered together, about, and rows of one image at a time.
TOGETHER, TALL = 1 << 20, 1 << 13


def padded(text: Column, block: int = BLOCK) -> Column:
    """The UTF-8 bytes of a text with bytes 0 up to a positive multiple of block."""
    body = utf8(text)
    n = F.octet_length(body)
    return F.concat(body, F.repeat(F.lit("\x00"), F.when(n == 0, block).otherwise(F.pmod(-n, F.lit(block)))).cast("binary"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL, filters: int | np.ndarray | None = None) -> bytes:
    """A grey 8-bit PNG of width columns whose samples are the payload, a positive multiple of width in length.
    filters: the filter type of all rows, or of each; None chooses the best for each row, the lowest type on ties."""
    px = np.frombuffer(payload, dtype=np.uint8)
    if not len(px) or len(px) % width:
        raise ValueError(f"{len(px)} bytes are not a positive multiple of {width}")
    x = px.reshape(-1, width).astype(np.int16)
    left = np.pad(x, ((0, 0), (1, 0)))[:, :-1]
    up = np.pad(x, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(x, ((1, 0), (1, 0)))[:-1, :-1]
    rows = np.stack([x, x - left, x - up, x - ((left + up) >> 1), x - paeth(left, up, corner)]).astype(np.uint8)
    if filters is None:
        kinds = np.abs(rows.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0).astype(np.uint8)
    else:
        kinds = np.broadcast_to(np.asarray(filters, dtype=np.uint8), len(x))
    raw = np.concatenate([kinds[:, None], rows[kinds, np.arange(len(x))]], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, len(x), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours the nearest to left + up - corner; ties in that order."""
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def unfilter(raws: list[np.ndarray], above: np.ndarray | None = None) -> list[np.ndarray]:
    """Samples of one byte from rows that begin with their filter type, for images of one width. above: the row over
    each image's first, zeros if None.

    Sample (r, c) lies on diagonal r + c. Images are laid out by diagonal, so that each step takes one slice of all of
    them; filters of all five types are undone in the same step."""
    if not raws:
        return []
    height, width = max(len(r) for r in raws), raws[0].shape[1] - 1
    kinds = np.zeros((len(raws), height), dtype=np.uint8)
    x = np.zeros((len(raws), height, width), dtype=np.uint8)
    for i, r in enumerate(raws):
        kinds[i, : len(r)], x[i, : len(r)] = r[:, 0], r[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter type")
    if not kinds.any():  # nothing to undo
        return [x[i, : len(r)] for i, r in enumerate(raws)]
    n = height + width - 1
    column = np.arange(width)
    # diagonal d and column c hold row d - c; two empty diagonals and one empty column stand for what is outside
    out = np.zeros((n + 2, len(raws), width + 1), dtype=np.int16)
    if above is not None:
        out[column + 1, :, column + 1] = above.T
    for d in range(n):
        lo, hi = max(0, d - height + 1), min(width, d + 1)
        c = column[lo:hi]
        kind, value = kinds[:, d - c], x[:, d - c, c].astype(np.int16)
        left, up, corner = out[d + 1][:, lo:hi], out[d + 1][:, lo + 1 : hi + 1], out[d][:, lo:hi]
        p = left + up - corner
        a, b, e = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        nearest = np.where((a <= b) & (a <= e), left, np.where(b <= e, up, corner))
        guess = np.where(kind == 1, left, np.where(kind == 2, up, np.where(kind == 3, (left + up) >> 1, np.where(kind == 4, nearest, 0))))
        out[d + 2][:, lo + 1 : hi + 1] = (value + guess) & 255
    row = np.arange(height)[:, None]
    whole = out[row + column + 2, :, column + 1]  # height, width, image
    return [whole[: len(r), :, i].astype(np.uint8) for i, r in enumerate(raws)]


def filtered_rows(media: bytes) -> np.ndarray:
    """The rows of a grey 8-bit PNG, each with its filter type before it. Raises ValueError if the signature, the order
    or CRC of a chunk, the zlib stream's checksum, or the size is wrong; no more is inflated than the header says."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, kinds, data, size = 8, [], [], None
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("the file ends inside a chunk")
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body, end = media[at + 8 : at + 8 + n], at + 12 + n
        if end > len(media) or struct.unpack(">I", media[end - 4 : end])[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind[0] & 32 == 0 and kind != b"IEND":
            raise ValueError(f"unknown critical chunk {kind!r}")
        kinds.append(kind)
        at = end
    if not kinds or kinds[0] != b"IHDR" or kinds[-1] != b"IEND" or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole grey 8-bit PNG")
    want, inflate = size[1] * (size[0] + 1), zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(data), want + 1)
    except zlib.error as e:
        raise ValueError(f"image data: {e}") from e
    if len(raw) != want or not inflate.eof or not want:
        raise ValueError("image data of another size")
    return np.frombuffer(raw, dtype=np.uint8).reshape(size[1], size[0] + 1)


def decode_pngs(medias: list[bytes]) -> list[np.ndarray | ValueError]:
    """The samples of each image, or what is wrong with it. Images of one width and like heights are unfiltered
    together, at most about TOGETHER samples."""
    out: list[np.ndarray | ValueError] = []
    groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}

    def finish(group: list[tuple[int, np.ndarray]]) -> None:
        for (i, _), px in zip(group, unfilter([raw for _, raw in group])):
            out[i] = px

    for i, media in enumerate(medias):
        try:
            raw = filtered_rows(media)
            if raw[:, 0].max() > 4:
                raise ValueError("unknown filter type")
        except ValueError as e:
            out.append(e)
            continue
        if len(raw) > TALL:  # rows of a tall image need no more than the row before them
            parts: list[np.ndarray] = []
            for at in range(0, len(raw), TALL):
                parts += unfilter([raw[at : at + TALL]], parts[-1][-1:] if parts else None)
            out.append(np.concatenate(parts))
            continue
        out.append(raw)
        group = groups.setdefault((raw.shape[1], len(raw).bit_length()), [])
        group.append((i, raw))
        if len(group) * max(len(r) for _, r in group) * raw.shape[1] > TOGETHER:
            finish(groups.pop((raw.shape[1], len(raw).bit_length())))
    for group in groups.values():
        finish(group)
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The samples of one image; raises ValueError where filtered_rows() does or a filter type is unknown."""
    (px,) = decode_pngs([media])
    if isinstance(px, ValueError):
        raise px
    return px


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) + 0.5) * np.arange(low)[:, None] / n)


_BASIS = _cosines(SIDE, LOW)


def cosine_hash(px: np.ndarray) -> str:
    """64 bits as hexadecimal digits: the image as SIDE x SIDE means, its LOW x LOW lowest cosine terms, each over
    or not over the median of all but the constant one."""
    height, width = px.shape
    cuts_y, cuts_x = (np.arange(SIDE + 1) * n // SIDE for n in (height, width))
    y0, x0 = np.minimum(cuts_y[:-1], height - 1), np.minimum(cuts_x[:-1], width - 1)
    sums = np.add.reduceat(np.add.reduceat(px, y0, axis=0, dtype=np.int64), x0, axis=1)
    # reduceat gives single rows where a strip is empty; strips end at the next start
    area = np.maximum(1, np.diff([*y0, height]))[:, None] * np.maximum(1, np.diff([*x0, width]))[None]
    terms = (_BASIS @ (sums / area) @ _BASIS.T).round(6).ravel()
    bits = terms > np.median(terms[1:])
    return np.packbits(bits).tobytes().hex()


def store(df: DataFrame, payload: str = "payload", media: str = "media", width: int = WIDTH, level: int = LEVEL) -> DataFrame:
    """Adds the column media, the payload as PNG. A null payload gives null."""
    ship(df.sparkSession)

    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else encode_png(b, width, level))

    return df.withColumn(media, encode(F.col(payload)))


def read(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds __payload (the bytes of the image), __feature (its cosine hash) and __error. What is no whole PNG gives
    null for the first two and its fault as __error; a null image gives nulls. Columns of df with
    these three names are replaced."""
    ship(df.sparkSession)

    @F.pandas_udf("payload binary, feature string, error string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            given = [i for i, b in enumerate(s) if b is not None]
            rows: list[tuple] = [(None, None, None)] * len(s)
            for i, px in zip(given, decode_pngs([s.iloc[i] for i in given])):
                rows[i] = (None, None, str(px)) if isinstance(px, ValueError) else (px.tobytes(), cosine_hash(px), None)
            yield pd.DataFrame(rows, columns=["payload", "feature", "error"])

    (held,) = free_names(df, "__read")
    return df.withColumn(held, decode(F.col(media))).select(*other_columns(df, "__payload", "__feature", "__error"), F.col(f"{held}.payload").alias("__payload"), F.col(f"{held}.feature").alias("__feature"), F.col(f"{held}.error").alias("__error"))
