"""WARC framing in plain Python: two readers with different tolerance, and a writer."""

from __future__ import annotations

import codecs
import gzip
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

CHUNK = LINE = 1 << 20
GZIP_CHUNK = 1 << 16
BLANK = (b"\r\n", b"\n")
INITIALS = (b"W", b"w", b"C", b"c")  # of the headers that count
#: A body must fit into a row's binary column.  Longer ones are counted through, never held.
MAX_BODY = (1 << 31) - (1 << 20)


class Record(NamedTuple):
    warc_type: str
    target_uri: str
    warc_date: str
    content_length: int
    body: bytes | None


class BadArchive(Exception):
    """The archive cannot be read to its end."""


class Gunzip(io.RawIOBase):
    """Decompressed bytes of a gzip stream of any number of members, as a raw stream.

    It gives what it has, member by member, so that damage does not take what stands before it.  Zero
    bytes between members are passed over; damage raises ``zlib.error``, an end in a member ``EOFError``.
    """

    def __init__(self, source: BinaryIO):
        self.source, self.held, self.member, self.begun = source, b"", None, False

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            ended = not self.held and not (held := self.source.read(GZIP_CHUNK))
            if not self.held:
                self.held = held
            if self.member is None:
                if self.begun:
                    self.held = self.held.lstrip(b"\0")
                if ended:
                    return 0
                if not self.held:
                    continue
                self.member, self.begun = zlib.decompressobj(31), True
            out = self.member.decompress(self.held, len(buffer))
            if self.member.eof:
                self.held, self.member = self.member.unused_data, None
            else:
                self.held = self.member.unconsumed_tail
                if ended and not out:
                    raise EOFError("the stream ends in a gzip member")
            if out:
                buffer[: len(out)] = out
                return len(out)


def header_number(value: bytes) -> int:
    """The ASCII digits of a value as a number, wrapping at 64 bits; 0 if there are none."""
    digits = bytes(c for c in value if 48 <= c <= 57)
    return int(digits) % (1 << 64) if digits else 0


def _headers(lines: list[bytes]) -> tuple[str, str, str, int]:
    """Type, URI, date and length; names match in any case, the last of a repeated header counts."""
    found = {b"warc-type": b"", b"warc-target-uri": b"", b"warc-date": b"", b"content-length": b""}
    for line in lines:
        if line[:1] in INITIALS:
            name, colon, value = line.partition(b":")
            if colon and (key := name.lower()) in found:
                found[key] = value.strip()
    text = [found[k].decode("utf-8", "replace") for k in (b"warc-type", b"warc-target-uri", b"warc-date")]
    return text[0], text[1], text[2], header_number(found[b"content-length"])


def _odd_line(stream: BinaryIO, line: bytes, tolerant: bool) -> bytes:
    """Checks a line that has begun with ``line``, and passes over what follows its first ``LINE`` bytes.

    So bytes without line ends take no memory.
    """
    decoder, part = codecs.getincrementaldecoder("utf-8")("replace" if tolerant else "strict"), line
    try:
        while part:
            decoder.decode(part)
            if len(part) < LINE or part.endswith(b"\n"):
                break
            part = stream.readline(LINE)
        decoder.decode(b"", final=True)
    except UnicodeDecodeError as e:
        raise BadArchive(f"a line between records or in a header is not UTF-8: {e.reason}") from e
    return line


def _skip(stream: BinaryIO, n: int) -> int:
    """Read and drop ``n`` bytes; how many there were."""
    left = n
    while left > 0:
        got = len(stream.read(min(left, CHUNK)))
        if not got:
            break
        left -= got
    return n - left


def _take(stream: BinaryIO, n: int) -> bytes:
    """Up to ``n`` bytes, in chunks, so that a length that is not there takes no memory."""
    parts, left = [], n
    while left > 0:
        part = stream.read(min(left, CHUNK))
        if not part:
            break
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def _too_long(stream: BinaryIO, length: int, held: int = 0) -> BadArchive | None:
    """Why a body over ``MAX_BODY`` cannot be given; None if the stream ends in it.  Nothing is held."""
    return BadArchive(f"a response of {length} bytes is too long for a row") if _skip(stream, length - held) == length - held else None


def read_stream(stream: BinaryIO, *, every_type: bool = False, with_body: bool = True, tolerant: bool = False) -> Iterator[Record]:
    """Records of a decompressed stream, one in memory at a time.

    A record starts at a line with ``WARC/``; other lines between records are skipped; headers end at a
    blank line, with either line end.  Without ``every_type`` only responses with a body are given and
    others are skipped unread.  A response cut short, a header that is not UTF-8, a damaged compression,
    or a length beyond 63 bits raises ``BadArchive``.  With ``tolerant`` such records are passed over: what
    can be read is given and the archive counts as read, however little of it that is.
    """
    try:
        while line := stream.readline(LINE):
            if len(line) == LINE or not line.isascii():
                line = _odd_line(stream, line, tolerant)
            if line[:5] != b"WARC/":
                continue
            lines = []
            while line := stream.readline(LINE):
                if len(line) == LINE or not line.isascii():
                    line = _odd_line(stream, line, tolerant)
                if line in BLANK or not line.strip():
                    break
                lines.append(line)
            else:
                return
            kind, uri, date, length = _headers(lines)
            if length >> 63:
                raise BadArchive(f"a record claims {length} bytes")
            wanted = kind.lower() == "response" and length > 0
            if wanted and with_body:
                if length > MAX_BODY:
                    raise _too_long(stream, length) or BadArchive(f"a response of {length} bytes is cut short")
                body = _take(stream, length)
                if len(body) < length:
                    if tolerant:
                        return
                    raise BadArchive(f"a response of {length} bytes ends after {len(body)}")
                yield Record(kind, uri, date, length, body)
                continue
            if wanted or every_type:
                yield Record(kind, uri, date, length, None)
            _skip(stream, length)
    except (EOFError, OSError, zlib.error) as e:
        if not tolerant:
            raise BadArchive(f"damaged compression: {e}") from e
    except BadArchive:
        if not tolerant:
            raise


def read_lenient(stream: BinaryIO, *, every_type: bool = False, with_body: bool = True) -> Iterator[Record]:
    """Records of a decompressed stream: ``WARC/`` anywhere starts one, a blank CRLF line ends its header.

    The first response that is cut short ends the scan and what came before stays; damaged compression
    fails the archive.  A window slides over the stream: it holds one header or body, not the archive.
    """
    window, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        part = b"" if ended else stream.read(CHUNK)
        ended = not part
        window.extend(part)
        return not ended

    def find(what: bytes, at: int) -> int:
        while (k := window.find(what, at)) < 0:
            at = max(at, len(window) - len(what) + 1)
            if not more():
                return -1
        return k

    try:
        while True:
            while (start := window.find(b"WARC/")) < 0:
                del window[: max(0, len(window) - 4)]
                if not more():
                    return
            del window[:start]
            end = find(b"\r\n\r\n", 0)
            if end < 0:
                return
            kind, uri, date, length = _headers([x.rstrip(b"\r") for x in bytes(window[:end]).split(b"\n")[1:]])
            del window[: end + 4]
            if kind.lower() == "response" and length > 0:
                if length > MAX_BODY:
                    if failure := _too_long(stream, length, len(window)):
                        raise failure
                    return
                while len(window) < length:
                    if not more():
                        return
                yield Record(kind, uri, date, length, bytes(window[:length]) if with_body else None)
            elif every_type:
                yield Record(kind, uri, date, min(length, (1 << 63) - 1), None)
            past = length + 4 - len(window)
            del window[: length + 4 if past <= 0 else len(window)]
            if past > 0:
                _skip(stream, past)
    except (EOFError, OSError, zlib.error) as e:
        raise BadArchive(f"damaged compression: {e}") from e


def format_record(warc_type: str, body: bytes, target_uri: str | None = None, warc_date: str | None = None) -> bytes:
    """One record in WARC/1.0 form."""
    head = [b"WARC/1.0", f"WARC-Type: {warc_type}".encode(), f"Content-Length: {len(body)}".encode()]
    if target_uri:
        head.append(f"WARC-Target-URI: {target_uri}".encode())
    if warc_date:
        head.append(f"WARC-Date: {warc_date}".encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member with no time stamp, so equal data give equal bytes."""
    return gzip.compress(data, 6, mtime=0)
