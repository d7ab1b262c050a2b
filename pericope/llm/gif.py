"""GIF media columns: decodes LZW streams, palettes, disposal and transparency into timed frames.

decode() turns a binary column into one row per frame, with the time at which it
is shown, how long, what it covers, and a colour histogram of the whole canvas
as shown. A large canvas comes in bands of rows, each a row of the table, so that
no file needs more memory than a band and its own bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pericope.llm.shared import only

#: Of each of red, green and blue: how many bins a histogram has.
BINS = 4
#: A canvas of more pixels comes in bands of about so many.
BAND_PIXELS = 1 << 22


class BadGif(ValueError):
    pass


def lzw_chunks(data: bytes, root: int, want: int, size: int = 1 << 20) -> Iterator[bytes]:
    """The first `want` colour indices of a code stream whose codes begin root + 1 bits wide, about `size` at a time; fewer if it ends or breaks before."""
    clear, stop = 1 << root, (1 << root) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, mask = list(base), root + 1, (1 << (root + 1)) - 1
    out, n, given = [], 0, 0
    bits = have = 0
    last: bytes | None = None
    for byte in data:
        bits |= byte << have
        have += 8
        while have >= width:
            code = bits & mask
            bits >>= width
            have -= width
            if code == clear:
                table, width, mask, last = list(base), root + 1, (1 << (root + 1)) - 1, None
                continue
            if code == stop or given + n >= want:
                have = -1
                break
            if last is None:
                if code >= clear:
                    have = -1
                    break
                word = table[code]
            else:
                if code < len(table):
                    word = table[code]
                elif code == len(table) and code < 4096:
                    word = last + last[:1]
                else:
                    have = -1
                    break
                if len(table) < 4096:
                    table.append(last + word[:1])
                    if len(table) > mask and width < 12:
                        width += 1
                        mask = (1 << width) - 1
            out.append(word)
            n += len(word)
            last = word
        if have < 0:
            break
        if n >= size:
            yield b"".join(out)[: want - given]
            out, n, given = [], 0, given + n
    if n and given < want:
        yield b"".join(out)[: want - given]


def lzw_decode(data: bytes, root: int, want: int) -> np.ndarray:
    """lzw_chunks() in one array."""
    return np.frombuffer(b"".join(lzw_chunks(data, root, want)), np.uint8)


def lzw_encode(pixels: bytes, root: int) -> bytes:
    """A code stream for colour indices below 2**root."""
    clear, stop = 1 << root, (1 << root) + 1
    out, bits, have = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, have
        bits |= code << have
        have += width
        while have >= 8:
            out.append(bits & 255)
            bits >>= 8
            have -= 8

    width, table = root + 1, {bytes([i]): i for i in range(clear)}
    put(clear, width)
    size, word = stop + 1, b""
    for p in pixels:
        longer = word + bytes([p])
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        if size < 4096:
            table[longer] = size
            if size == 1 << width and width < 12:
                width += 1
            size += 1
        else:
            put(clear, width)
            width, size, table = root + 1, stop + 1, {bytes([i]): i for i in range(clear)}
        word = bytes([p])
    if word:
        put(table[word], width)
    # the reader may have widened its codes after the last one
    if size == 1 << width and width < 12 and word:
        width += 1
    put(stop, width)
    if have:
        out.append(bits & 255)
    return bytes(out)


def _rows(h: int, interlaced: bool) -> np.ndarray:
    """In which order a frame's rows are stored."""
    return np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))]) if interlaced else np.arange(h)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise BadGif("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def word(self) -> int:
        return int.from_bytes(self.take(2), "little")

    def blocks(self) -> bytes:
        """Data sub-blocks up to their end, or up to the file's."""
        out = []
        while True:
            n = self.take(1)[0]
            if not n:
                return b"".join(out)
            if self.at + n > len(self.data):
                out.append(self.data[self.at :])
                self.at = len(self.data)
                return b"".join(out)
            out.append(self.take(n))


def parse(data: bytes) -> dict:
    """What a file says, without its pixels: width, height, loops (null: plays once), error, and frames, each with left, top, width, height, start_ms, delay_ms, disposal, interlaced, transparent, colours, root and codes.

    Raises BadGif if there is no readable header. What comes before a fault
    further on is kept, and error says what the fault was.
    """
    r = _Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise BadGif("no GIF header")
    width, height = r.word(), r.word()
    flags, _background, _ = r.take(3)
    palette = np.frombuffer(r.take(3 << ((flags & 7) + 1)), np.uint8).reshape(-1, 3) if flags & 128 else None
    out = {"width": width, "height": height, "loops": None, "frames": [], "error": None}
    delay, disposal, transparent, at = 0, 0, None, 0
    try:
        while True:
            kind = r.take(1)
            if kind == b";":
                break
            if kind == b"!":
                label = r.take(1)[0]
                body = r.blocks()
                if label == 0xF9 and len(body) >= 4:
                    disposal = body[0] >> 2 & 7
                    delay = int.from_bytes(body[1:3], "little") * 10
                    transparent = body[3] if body[0] & 1 else None
                elif label == 0xFF and body[:11] in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(body) >= 14 and body[11] == 1:
                    out["loops"] = int.from_bytes(body[12:14], "little")
                continue
            if kind != b",":
                raise BadGif(f"unknown block {kind[0]}")
            left, top, w, h = r.word(), r.word(), r.word(), r.word()
            own = r.take(1)[0]
            colours = np.frombuffer(r.take(3 << ((own & 7) + 1)), np.uint8).reshape(-1, 3) if own & 128 else palette
            root = r.take(1)[0]
            if not 1 <= root <= 8:
                raise BadGif("bad code size")
            if colours is None:
                colours = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)  # no palette at all: shades of grey
            frame = {"left": left, "top": top, "width": w, "height": h, "start_ms": at, "delay_ms": delay, "disposal": disposal, "interlaced": bool(own & 64), "transparent": transparent}
            out["frames"].append(frame | {"colours": colours, "root": root, "codes": r.blocks()})
            at += delay
            delay, disposal, transparent = 0, 0, None
    except BadGif as e:
        out["error"] = str(e)
    return out


def render(g: dict, first: int = 0, rows: int | None = None) -> Iterator[tuple[np.ndarray, bool]]:
    """(canvas, complete) of every frame of parse(): `rows` rows from the first of the canvas as shown, RGBA, in an array that the next step changes; and whether the file has all of the frame's pixels."""
    width = g["width"]
    rows = g["height"] - first if rows is None else rows
    canvas = np.zeros((rows, width, 4), np.uint8)
    for f in g["frames"]:
        w, h, colours = f["width"], f["height"], f["colours"]
        # what lies outside the canvas or the band isn't shown
        box = np.s_[max(0, f["top"] - first) : max(0, min(rows, f["top"] + h - first)), f["left"] : min(f["left"] + w, width)]
        before = canvas.copy() if f["disposal"] == 3 else None
        order, at = _rows(h, f["interlaced"]), 0
        for chunk in lzw_chunks(f["codes"], f["root"], w * h):
            index = np.frombuffer(chunk, np.uint8)
            place = np.arange(at, at + len(index))
            y, x = order[place // w] + f["top"] - first, place % w + f["left"]
            seen = (y >= 0) & (y < rows) & (x < width) & (index < len(colours))
            if f["transparent"] is not None:
                seen &= index != f["transparent"]
            y, x = y[seen], x[seen]
            canvas[y, x, :3] = colours[index[seen]]
            canvas[y, x, 3] = 255
            at += len(index)
        yield canvas, at == w * h
        if f["disposal"] == 2:
            canvas[box] = 0
        elif f["disposal"] == 3:
            canvas = before


def read(data: bytes) -> dict:
    """parse() with each frame's canvas and whether it is complete; for files that fit in memory."""
    g = parse(data)
    for f, (canvas, complete) in zip(g["frames"], render(g)):
        f |= {"canvas": canvas.copy(), "complete": complete}
    return g


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Opaque pixels by colour, bins to each of red, green and blue, blue fastest; in the last place the transparent ones."""
    c = canvas.reshape(-1, 4)
    seen = c[:, 3] > 0
    q = (c[:, :3].astype(np.int64) * bins) >> 8
    h = np.bincount(((q[:, 0] * bins + q[:, 1]) * bins + q[:, 2])[seen], minlength=bins**3)
    return np.append(h, np.count_nonzero(~seen))


_INTS = ("delay_ms", "left", "top", "width", "height", "disposal")
_OUT = (
    "id long, valid boolean, error string, canvas_width int, canvas_height int, loops int, n_frames int, duration_ms long, frame int, band int, first_row int, start_ms long, "
    + ", ".join(f"{c} int" for c in _INTS)
    + ", interlaced boolean, complete boolean, histogram array<int>, pixels binary"
)
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _file_rows(key: int | None, data: bytes | None, pixels: bool, bins: int) -> Iterator[dict]:
    row = {"id": key, "valid": False, "error": "no data", "n_frames": 0, "duration_ms": 0}
    if not data:
        yield row
        return
    try:
        g = parse(data)
    except BadGif as e:
        yield row | {"error": str(e)}
        return
    row |= {"valid": True, "error": g["error"], "canvas_width": g["width"], "canvas_height": g["height"], "loops": g["loops"], "n_frames": len(g["frames"]), "duration_ms": sum(f["delay_ms"] for f in g["frames"])}
    if not g["frames"]:
        yield row
        return
    rows = max(1, BAND_PIXELS // max(1, g["width"]))
    for band, first in enumerate(range(0, max(1, g["height"]), rows)):
        for i, (f, (canvas, complete)) in enumerate(zip(g["frames"], render(g, first, min(rows, g["height"] - first)))):
            own = {k: f[k] for k in ("start_ms", *_INTS, "interlaced")} | {"histogram": histogram(canvas, bins), "pixels": canvas.tobytes() if pixels else None}
            yield row | {"frame": i, "band": band, "first_row": first, "complete": complete} | own


def decode(media: DataFrame, id_col: str = "media_id", data_col: str = "data", pixels: bool = True, bins: int = BINS) -> DataFrame:
    """One row per frame of every row of media, in file order: (id_col, valid, error, canvas_width, canvas_height, loops, n_frames, duration_ms, frame, band, first_row, start_ms, delay_ms, left, top, width, height, disposal, interlaced, complete, histogram, pixels).

    start_ms and delay_ms are when and how long the frame is shown; left to
    height its place; histogram is histogram() of the canvas as shown, and with
    `pixels` the canvas itself, RGBA by rows. A canvas of more than BAND_PIXELS
    pixels comes in bands: rows of one frame with a number each, from first_row
    of the canvas on, whose histograms add up.

    A null or empty column, data without a GIF header, and a file without a
    frame give one row with a null frame: the first two aren't valid, with the
    reason in error. A file that breaks off is valid with the frames before the
    fault, the last perhaps not complete, and an error. Null ids are kept;
    repeated rows each give their rows; frames of length 0 share their start.
    Files of any length and canvases of any size are decoded whole. An empty
    table gives an empty result. Other columns are ignored, whatever their
    names. Ids have to be of whole numbers, else a TypeError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, _TYPES[k]) for n, k in (x.strip().split(" ") for x in _OUT.split(", "))])
        rows, held = [], 0
        for b in batches:
            for key, data in zip(b.column(0), b.column(1)):
                for row in _file_rows(key.as_py(), data.as_py(), pixels, bins):
                    rows.append(row)
                    held += len(row.get("pixels") or b"")
                    if len(rows) >= 1024 or held > 4 * BAND_PIXELS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    d = only(media, id=id_col, data=data_col).select("id", F.col("data").cast("binary"))
    return d.mapInArrow(run, _OUT).withColumnRenamed("id", id_col)


# --------------------------------------------------------------------------
# files to decode


def encode(width: int, height: int, palette: np.ndarray, frames: list[dict], loops: int | None = 0) -> bytes:
    """A GIF89a file. Each frame: pixels (height, width) of indices; optional left, top, delay_ms, disposal, transparent, interlaced, palette."""

    def bits(colours: np.ndarray) -> int:
        return max(1, int(len(colours) - 1).bit_length())

    def table(colours: np.ndarray) -> bytes:
        full = np.zeros((1 << bits(colours), 3), np.uint8)
        full[: len(colours)] = colours
        return full.tobytes()

    def chunks(body: bytes) -> bytes:
        return b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)) + b"\0"

    word = lambda x: int(x).to_bytes(2, "little")
    out = [b"GIF89a", word(width), word(height), bytes([0x80 | (bits(palette) - 1), 0, 0]), table(palette)]
    if loops is not None:
        out.append(b"!\xff\x0bNETSCAPE2.0\x03\x01" + word(loops) + b"\0")
    for f in frames:
        p = f["pixels"]
        own = f.get("palette")
        t = f.get("transparent")
        out.append(b"!\xf9\x04" + bytes([f.get("disposal", 0) << 2 | (t is not None)]) + word(f.get("delay_ms", 0) // 10) + bytes([t or 0, 0]))
        root = max(2, bits(own if own is not None else palette))
        flags = (0x80 | (bits(own) - 1) if own is not None else 0) | (0x40 if f.get("interlaced") else 0)
        out.append(b"," + word(f.get("left", 0)) + word(f.get("top", 0)) + word(p.shape[1]) + word(p.shape[0]) + bytes([flags]) + (table(own) if own is not None else b""))
        out.append(bytes([root]) + chunks(lzw_encode(p[_rows(p.shape[0], bool(f.get("interlaced")))].astype(np.uint8).tobytes(), root)))
    return b"".join([*out, b";"])


def vector_gif(key: int, vector: np.ndarray) -> bytes:
    """An animation of a vector: its values as shades on a square, then two smaller frames over it; the key chooses palette, disposal, transparency and interlacing."""
    side = max(4, int(np.ceil(np.sqrt(max(1, len(vector))))))
    v = np.zeros(side * side)
    v[: len(vector)] = np.nan_to_num(np.asarray(vector, float))
    lo, hi = v.min(), v.max()
    shade = np.minimum(15, ((v - lo) / (hi - lo + 1e-9) * 16).astype(int)).reshape(side, side)
    ramp = np.arange(16)
    palette = np.stack([ramp * 17, (ramp * (3 + key % 5) * 17) % 256, 255 - ramp * 16], axis=1).astype(np.uint8)
    half = side // 2
    frames = [
        {"pixels": shade, "delay_ms": 40 + key % 7 * 10, "disposal": 1, "interlaced": key % 2 == 0},
        {"pixels": shade[:half, :half].T, "left": half, "top": key % (side - half + 1), "delay_ms": 100, "disposal": 2 + key % 2, "transparent": key % 16},
        {"pixels": 15 - shade[half:, :half], "left": 0, "top": half, "delay_ms": 80, "disposal": 0, "palette": palette[::-1], "transparent": 0 if key % 3 else None},
    ]
    return encode(side, side, palette, frames, loops=key % 4 or None)


def from_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, data): vector_gif() of every row. A null vector gives null data, a null id counts as 0 for the looks; null values within a vector as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            data = [None if x is None else vector_gif(i or 0, np.array([np.nan if y is None else y for y in x])) for i, x in zip(ids, v)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["id", "data"])

    d = only(vectors, id=id_col, v=vector_col)
    return d.mapInArrow(run, "id long, data binary").withColumnRenamed("id", id_col)
