"""Reader options: which fields are wanted, and what becomes of residues other than A, C, G and T."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import IntFlag


class Flag(IntFlag):
    """The bits of an option set."""

    HEADER = 1 << 0
    DNA_STRING = 1 << 1
    DNA_COLUMNAR = 1 << 2
    DNA_PACKED = 1 << 3
    DNA_LEN = 1 << 4
    QUALITY = 1 << 5
    SPLIT = 1 << 6
    RECORD = 1 << 7
    CHUNK = 1 << 8
    MERGE_CHUNKS = 1 << 9
    MERGE_RECORDS = 1 << 10
    MASK_NON_ACTG = 1 << 11
    MASK_N = 1 << 12
    REJECT = 1 << 13


DEFAULT = Flag.HEADER | Flag.DNA_STRING | Flag.RECORD

#: The columns that each field flag asks for.
COLUMNS = {
    Flag.HEADER: ("header",),
    Flag.DNA_STRING: ("seq",),
    Flag.DNA_PACKED: ("packed",),
    Flag.DNA_COLUMNAR: ("columnar",),
    Flag.DNA_LEN: ("dna_len",),
    Flag.QUALITY: ("quality",),
    Flag.MASK_NON_ACTG: ("mask_non_actg",),
    Flag.MASK_N: ("mask_n",),
}


@dataclass(frozen=True)
class FastxOptions:
    """An immutable option set; every method gives a changed copy, and the order of calls matters where a later choice of
    policy undoes an earlier one (a packed or columnar encoding asks for runs, a policy sets which events are returned)."""

    flags: Flag = DEFAULT

    def _set(self, on: Flag = Flag(0), off: Flag = Flag(0)) -> FastxOptions:
        return replace(self, flags=(self.flags & ~off) | on)

    @classmethod
    def from_config(cls, config: int) -> FastxOptions:
        return cls(Flag(config))

    def config(self) -> int:
        return int(self.flags)

    def with_flag(self, flag: Flag) -> FastxOptions:
        return self._set(on=flag)

    def without_flag(self, flag: Flag) -> FastxOptions:
        return self._set(off=flag)

    def has(self, flag: Flag) -> bool:
        return bool(self.flags & flag)

    def compute_headers(self) -> FastxOptions:
        return self._set(on=Flag.HEADER)

    def ignore_headers(self) -> FastxOptions:
        return self._set(off=Flag.HEADER)

    def compute_quality(self) -> FastxOptions:
        return self._set(on=Flag.QUALITY)

    def ignore_quality(self) -> FastxOptions:
        return self._set(off=Flag.QUALITY)

    def compute_dna_len(self) -> FastxOptions:
        return self._set(on=Flag.DNA_LEN)

    def ignore_dna_len(self) -> FastxOptions:
        return self._set(off=Flag.DNA_LEN)

    def compute_mask_non_actg(self) -> FastxOptions:
        return self._set(on=Flag.MASK_NON_ACTG)

    def compute_mask_n(self) -> FastxOptions:
        return self._set(on=Flag.MASK_N)

    def ignore_dna(self) -> FastxOptions:
        """No sequence in any form; whole records are returned. Merging stays as it was."""
        return self._set(on=Flag.RECORD, off=Flag.DNA_STRING | Flag.DNA_COLUMNAR | Flag.DNA_PACKED | Flag.SPLIT | Flag.REJECT | Flag.CHUNK)

    def dna_string(self) -> FastxOptions:
        return self.ignore_dna().and_dna_string()

    def dna_packed(self) -> FastxOptions:
        return self.ignore_dna().and_dna_packed()

    def dna_columnar(self) -> FastxOptions:
        return self.ignore_dna().and_dna_columnar()

    def and_dna_string(self) -> FastxOptions:
        return self._set(on=Flag.DNA_STRING)

    def and_dna_packed(self) -> FastxOptions:
        return self._set(on=Flag.DNA_PACKED).split_non_actg()

    def and_dna_columnar(self) -> FastxOptions:
        return self._set(on=Flag.DNA_COLUMNAR).split_non_actg()

    def keep_non_actg(self) -> FastxOptions:
        return self._set(on=Flag.RECORD, off=Flag.SPLIT | Flag.CHUNK | Flag.MERGE_CHUNKS | Flag.REJECT)

    def split_non_actg(self) -> FastxOptions:
        return self._set(on=Flag.SPLIT | Flag.CHUNK, off=Flag.MERGE_CHUNKS | Flag.REJECT | Flag.RECORD)

    def skip_non_actg(self) -> FastxOptions:
        return self._set(on=Flag.SPLIT | Flag.MERGE_CHUNKS | Flag.RECORD, off=Flag.CHUNK | Flag.REJECT)

    def reject_non_actg(self) -> FastxOptions:
        return self._set(on=Flag.SPLIT | Flag.REJECT | Flag.RECORD, off=Flag.CHUNK | Flag.MERGE_CHUNKS)

    def merge_records(self) -> FastxOptions:
        return self._set(on=Flag.MERGE_RECORDS)

    def return_record(self, wanted: bool = True) -> FastxOptions:
        return self._set(on=Flag.RECORD) if wanted else self._set(off=Flag.RECORD)

    def return_dna_chunk(self, wanted: bool = True) -> FastxOptions:
        return self._set(on=Flag.CHUNK) if wanted else self._set(off=Flag.CHUNK)

    @property
    def policy(self) -> str:
        """keep, split, skip or reject."""
        if self.has(Flag.REJECT):
            return "reject"
        if not self.has(Flag.SPLIT):
            return "keep"
        return "skip" if self.has(Flag.MERGE_CHUNKS) else "split"

    @property
    def columns(self) -> list[str]:
        """The wanted columns, in a fixed order."""
        return [c for flag, names in COLUMNS.items() if self.has(flag) for c in names]
