"""What can be wrong with an input, as exceptions and as rows."""

from __future__ import annotations


#: The texts of the errors, which programs may match on.
INVALID_RECORD_START = "invalid record start: expected {expected}, found byte {byte} ('{char}')"
TRUNCATED_RECORD = "unexpected end of file mid-record"
INVALID_BASE = "invalid base 0x{byte} ('{char}') at byte offset {pos}"
DECOMPRESSION = "decompression error: {message}"
IO = "I/O error: {message}"


class FastxError(Exception):
    """Base of all errors about an input; terminal for the scan that meets it."""

    kind = "Custom"
    byte: int | None = None
    pos: int | None = None

    def row(self) -> dict:
        """The error struct of permissive reads."""
        return {"kind": self.kind, "byte": self.byte, "pos": self.pos, "message": str(self)}

    def __reduce__(self):
        return _restored, (type(self), self.args, self.byte, self.pos)


def _restored(cls: type, args: tuple, byte: int | None, pos: int | None) -> FastxError:
    error = cls.__new__(cls)
    Exception.__init__(error, *args)
    error.byte, error.pos = byte, pos
    return error


class InvalidRecordStart(FastxError):
    kind = "InvalidRecordStart"

    def __init__(self, expected: str, found: int, pos: int | None = None):
        super().__init__(INVALID_RECORD_START.format(expected=expected, byte=f"{found:#04x}", char=chr(found)))
        self.byte, self.pos = found, pos


class TruncatedRecord(FastxError):
    kind = "TruncatedRecord"

    def __init__(self, pos: int | None = None):
        super().__init__(TRUNCATED_RECORD)
        self.pos = pos


class InvalidBase(FastxError):
    kind = "InvalidBase"

    def __init__(self, byte: int, pos: int):
        super().__init__(INVALID_BASE.format(byte=f"{byte:02x}", char=chr(byte), pos=pos))
        self.byte, self.pos = byte, pos


class DecompressionError(FastxError):
    kind = "Decompression"

    def __init__(self, message: str):
        super().__init__(DECOMPRESSION.format(message=message))


class InputError(FastxError):
    """A file that isn't there, can't be opened, or can't be read to its end."""

    kind = "Io"

    def __init__(self, message: str):
        super().__init__(IO.format(message=message))
