"""Compressed inputs: sniffing by magic bytes, streaming decoders, and where an input can be cut."""

from __future__ import annotations

import bz2
import glob
import lzma
import os
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from ..errors import DecompressionError

PIECE = 4 << 20

#: The empty block that ends a BGZF file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")

EXTENSIONS = {".gz": "gzip", ".bgz": "bgzf", ".zst": "zstd", ".bz2": "bzip2", ".xz": "xz"}


def compression_format(head: bytes | None) -> str | None:
    """gzip, bgzf, zstd, pzstd, bzip2 or xz by the first bytes (18 tell bgzf from gzip), None for anything else."""
    if not head:
        return None
    if head[:2] == b"\x1f\x8b":
        blocked = len(head) >= 18 and head[2] == 8 and head[3] & 4 and head[12:16] == b"BC\x02\x00"
        return "bgzf" if blocked else "gzip"
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    if len(head) >= 4 and head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5:
        return "pzstd"
    if head[:2] == b"BZ":
        return "bzip2"
    return "xz" if head[:3] == b"\xfd7z" else None


def format_from_path(path: str) -> str | None:
    """The format that a file's extension stands for; only where its bytes can't be looked at."""
    return EXTENSIONS.get(os.path.splitext(path)[1].lower())


def open_input(path: str) -> BinaryIO:
    """A seekable file, local or in any store that pyarrow knows by the path's scheme."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def list_inputs(paths: list[str]) -> list[tuple[str, int]]:
    """(path, size) of all files that the paths (files, folders, local patterns) stand for, in order of name; a path for which
    there is nothing is an error."""
    found = find_inputs(paths)
    for path, size in found:
        if size is None:
            raise FileNotFoundError(f"no such file or folder: {path}")
    return found


def find_inputs(paths: list[str]) -> list[tuple[str, int | None]]:
    """As list_inputs, with size None for a path for which there is nothing."""
    found: list[tuple[str, int | None]] = []
    for path in paths:
        if "://" in path and not path.startswith("file:"):
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            info = store.get_file_info(inner)
            infos = store.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
            prefix = path.split("://")[0] + "://"
            found += [(prefix + i.path if not i.path.startswith(prefix) else i.path, i.size) for i in infos if i.type == fs.FileType.File and not os.path.basename(i.path).startswith(("_", "."))]
            found += [(path, None)] if info.type == fs.FileType.NotFound else []
            continue
        path = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
        names = [os.path.join(d, f) for d, _, fs_ in os.walk(path) for f in fs_ if not f.startswith(("_", "."))] if os.path.isdir(path) else glob.glob(path) if glob.has_magic(path) and not os.path.exists(path) else [path]
        found += [(name, os.path.getsize(name) if os.path.exists(name) else None) for name in names or ([] if os.path.isdir(path) else [path])]
    return sorted(found, key=lambda f: f[0])


def modified_at(path: str) -> float:
    """When a file was last written, in seconds since 1970."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return os.path.getmtime(path)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.get_file_info(inner).mtime_ns / 1e9


def raw_pieces(file: BinaryIO, size: int = PIECE) -> Iterator[bytes]:
    while piece := file.read(size):
        yield piece


def gzip_pieces(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """All members of a gzip stream; what follows a member and isn't one is ignored. Check sums are verified."""
    decoder, rest, begun = zlib.decompressobj(31), b"", False
    try:
        for piece in pieces:
            rest += piece
            while rest:
                if not begun:
                    if len(rest) < 2:
                        break
                    if rest[:2] != b"\x1f\x8b":
                        return
                    decoder, begun = zlib.decompressobj(31), True
                out = decoder.decompress(rest, PIECE)
                if out:
                    yield out
                if decoder.eof:
                    rest, begun = decoder.unused_data, False
                else:
                    rest = decoder.unconsumed_tail
                    if not rest:
                        break
    except zlib.error as error:
        raise DecompressionError(str(error)) from error
    if begun:
        raise DecompressionError("unexpected end of a gzip member")


def zstd_pieces(file: BinaryIO, size: int = PIECE) -> Iterator[bytes]:
    """All frames of a zstd stream, skippable ones passed over."""
    import zstandard

    try:
        with zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True, closefd=False) as reader:
            while piece := reader.read(size):
                yield piece
    except zstandard.ZstdError as error:
        raise DecompressionError(str(error)) from error


def chained_pieces(pieces: Iterator[bytes], make, errors: tuple) -> Iterator[bytes]:
    """All streams, one after another, of a format whose decoder objects end with each."""
    decoder = make()
    fresh = True
    try:
        for piece in pieces:
            while piece:
                if decoder.eof:
                    decoder, fresh = make(), True
                out = decoder.decompress(piece)
                fresh = False
                if out:
                    yield out
                piece = decoder.unused_data if decoder.eof else b""
    except errors as error:
        raise DecompressionError(str(error)) from error
    if not decoder.eof and not fresh:
        raise DecompressionError("unexpected end of the stream")


def decoded_pieces(file: BinaryIO, format_: str | None, size: int = PIECE) -> Iterator[bytes]:
    """The decompressed bytes of a file, in pieces."""
    if format_ in ("gzip", "bgzf"):
        return gzip_pieces(raw_pieces(file, size))
    if format_ in ("zstd", "pzstd"):
        return zstd_pieces(file, size)
    if format_ == "bzip2":
        return chained_pieces(raw_pieces(file, size), bz2.BZ2Decompressor, (OSError, ValueError))
    if format_ == "xz":
        return chained_pieces(raw_pieces(file, size), lzma.LZMADecompressor, (lzma.LZMAError,))
    return raw_pieces(file, size)


def bgzf_block_size(head: bytes) -> int | None:
    """The size of the block that begins with these 18 bytes."""
    return int.from_bytes(head[16:18], "little") + 1 if compression_format(head) == "bgzf" else None


def next_bgzf_block(file: BinaryIO, at: int, size: int) -> int | None:
    """The first block start at or after `at`: its header must be followed by another or by the file's end."""
    file.seek(at)
    window = file.read((1 << 17) + 64)
    i = window.find(b"\x1f\x8b\x08")
    while i >= 0:
        length = bgzf_block_size(window[i : i + 18])
        if length:
            file.seek(at + i + length)
            after = file.read(18)
            if at + i + length == size or bgzf_block_size(after):
                return at + i
        i = window.find(b"\x1f\x8b\x08", i + 1)
    return None


def zstd_frames(file: BinaryIO, size: int) -> list[int] | None:
    """Where each frame begins, from the sizes in frame and block headers; None if the file isn't frames to its end."""
    starts, at = [], 0
    while at < size:
        file.seek(at)
        head = file.read(18)
        magic = int.from_bytes(head[:4], "little")
        if magic >> 4 == 0x184D2A5:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        if magic != 0xFD2FB528 or len(head) < 6:
            return None
        starts.append(at)
        flags = head[4]
        single = flags >> 5 & 1
        content = (1 if single else 0, 2, 4, 8)[flags >> 6]
        at += 4 + 1 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content
        last = 0
        while not last:
            file.seek(at)
            block = file.read(3)
            if len(block) < 3:
                return None
            value = int.from_bytes(block, "little")
            last, kind = value & 1, value >> 1 & 3
            at += 3 + (1 if kind == 1 else value >> 3)
        at += 4 * (flags >> 2 & 1)
    return starts if at == size else None


class Plain:
    """An encoder: bytes in, bytes of the file out, `finish` for its end. This one changes nothing."""

    extension = ""

    def write(self, data: bytes) -> bytes:
        return data

    def finish(self) -> bytes:
        return b""


class OneStream(Plain):
    """gzip, bzip2 or xz in one stream, which only a reader from the beginning can decode."""

    def __init__(self, name: str):
        make = {"gzip": lambda: zlib.compressobj(6, zlib.DEFLATED, 31), "bzip2": bz2.BZ2Compressor, "xz": lzma.LZMACompressor}[name]
        self.encoder, self.extension = make(), {"gzip": ".gz", "bzip2": ".bz2", "xz": ".xz"}[name]

    def write(self, data: bytes) -> bytes:
        return self.encoder.compress(data)

    def finish(self) -> bytes:
        return self.encoder.flush()


class Blocks(Plain):
    """Blocks of equal size that are compressed each by itself, so that readers can begin at any of them."""

    def __init__(self, size: int):
        self.size, self.held = size, bytearray()

    def block(self, data: bytes) -> bytes:
        raise NotImplementedError

    def write(self, data: bytes) -> bytes:
        self.held += data
        whole = len(self.held) // self.size * self.size
        if not whole:
            return b""
        view = bytes(self.held[:whole])
        del self.held[:whole]
        return b"".join(self.block(view[a : a + self.size]) for a in range(0, whole, self.size))

    def finish(self) -> bytes:
        return self.block(bytes(self.held)) if self.held else b""


class BgzfBlocks(Blocks):
    """BGZF: gzip members with their size in the header, and an empty one at the end. Their size is held in 16 bits."""

    extension = ".gz"

    def __init__(self, size: int = 65280):
        super().__init__(min(size, 65280))

    def block(self, data: bytes) -> bytes:
        encoder = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = encoder.compress(data) + encoder.flush()
        head = bytes.fromhex("1f8b08040000000000ff060042430200") + (len(packed) + 25).to_bytes(2, "little")
        return head + packed + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")

    def finish(self) -> bytes:
        return super().finish() + BGZF_END


class ZstdFrames(Blocks):
    """zstd frames with content size and check sum."""

    extension = ".zst"

    def __init__(self, size: int = 4 << 20):
        import zstandard

        super().__init__(size)
        self.encoder = zstandard.ZstdCompressor(write_checksum=True)

    def block(self, data: bytes) -> bytes:
        return self.encoder.compress(data)


def make_encoder(name: str | None, block_bytes: int | None = None) -> Plain:
    """none, bgzf, zstd (frames), gzip, bzip2 or xz; block_bytes: how much text a block or frame has."""
    if name in (None, "", "none"):
        return Plain()
    if name in ("bgzf", "zstd"):
        kind = BgzfBlocks if name == "bgzf" else ZstdFrames
        return kind(block_bytes) if block_bytes else kind()
    if name not in ("gzip", "bzip2", "xz"):
        raise ValueError(f"no such compression: {name}")
    return OneStream(name)
