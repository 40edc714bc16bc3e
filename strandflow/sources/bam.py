"""Binary alignment files as a Spark data source, one partition a file.

    spark.dataSource.register(BamSource)
    spark.read.format("strandflow_bam").load("x.bam")

Files are decoded block by block as a stream, so memory stays small; many files are read in
parallel. For repeated use over large files, write the rows as Parquet sorted by (tid, pos): row
group statistics then replace the index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "qname string, flag int, tid int, contig string, pos int, mapq int, cigar string, mate_tid int, mate_pos int, isize int, seq string, qual array<int>, tags map<string,string>, stop int"
# fixed values: codes of bases, operations and tag widths
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
WIDTH = {"A": ("c", 1), "c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}


def blocks(stream) -> Iterator[bytes]:
    """Uncompressed blocks of a BGZF stream; an empty block ends a file."""
    while head := stream.read(18):
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        extra = struct.unpack_from("<H", head, 10)[0]
        fields = head[12:] + stream.read(extra - 6)
        at, size = 0, None
        while at + 4 <= len(fields):
            kind, n = fields[at : at + 2], struct.unpack_from("<H", fields, at + 2)[0]
            if kind == b"BC":
                size = struct.unpack_from("<H", fields, at + 4)[0]
            at += 4 + n
        if size is None:
            raise ValueError("a block without its size")
        body = stream.read(size - extra - 19 + 8)
        yield zlib.decompress(body[:-8], -15)


class Bytes:
    """Exact reads over an iterator of blocks."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held, self.at = parts, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            more = next(self.parts, None)
            if more is None:
                if len(self.held) == self.at:
                    return b""
                raise ValueError("the file is cut")
            self.held, self.at = self.held[self.at :] + more, 0
        out = self.held[self.at : self.at + n]
        self.at += n
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def header(data: Bytes) -> tuple[str, list[tuple[str, int]]]:
    if data.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = data.take(data.number()).rstrip(b"\0").decode()
    contigs = []
    for _ in range(data.number()):
        name = data.take(data.number())[:-1].decode()
        contigs.append((name, data.number()))
    return text, contigs


def tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            code, width = WIDTH[sub]
            out[name] = sub + "".join(f",{x}" for x in struct.unpack_from(f"<{n}{code}", raw, at + 5))
            at += 5 + n * width
        else:
            code, width = WIDTH[kind]
            v = struct.unpack_from("<" + code, raw, at)[0]
            out[name], at = v.decode() if kind == "A" else f"{v:g}" if kind == "f" else str(v), at + width
    return out


def record(raw: bytes, contigs: list[tuple[str, int]]) -> tuple:
    tid, pos, name_len, mapq, _, n_ops, flag, length, mate_tid, mate_pos, isize = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32
    qname = raw[at : at + name_len - 1].decode()
    at += name_len
    ops = [(OPS[v & 15], v >> 4) for v in struct.unpack_from(f"<{n_ops}I", raw, at)]
    at += 4 * n_ops
    packed = raw[at : at + (length + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:length]
    at += (length + 1) // 2
    qual = raw[at : at + length]
    span = sum(n for op, n in ops if op in "MDN=X")
    return (qname, flag, tid, contigs[tid][0] if tid >= 0 else None, pos, mapq, "".join(f"{n}{op}" for op, n in ops) or "*", mate_tid, mate_pos, isize, seq, [] if qual[:1] == b"\xff" else list(qual), tags(raw[at + length :]), pos - 1 + span)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, part):
        with open(part.path, "rb") as f:
            data = Bytes(blocks(f))
            _, contigs = header(data)
            while size := data.take(4):
                yield record(data.take(struct.unpack("<i", size)[0]), contigs)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandflow_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        import glob
        import os

        path = self.options["path"]
        found = sorted(glob.glob(os.path.join(path, "*.bam")) if os.path.isdir(path) else glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return _Reader(found)
