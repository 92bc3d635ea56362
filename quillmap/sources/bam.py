"""BAM files as a Spark data source, ``bam``: splittable reader with pruning by the BAI index, and a writer that keeps records as they are.

Blocks are gzip members; records may reach over them. A file is cut into ranges of about ``split`` bytes (an option), with an index within
each contig; a task looks for the first block in its range, and in it for the first place from which several records follow each other
without contradiction. Options ``contig`` (an id), ``begin`` and ``end`` (0-based, end exclusive) prune to reads that begin there.

Column ``record`` holds a record's own bytes. A row that still has them is written back as it was, but for its mapping quality.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quillmap.sources import schemas

#: Fixed values of the format: letters of 4-bit bases, the empty last block, and sizes of tag values.
LETTERS = "=ACMGRSVTWYHKDBN"
CIGAR = "MIDNSHP=X"
MAGIC = b"\x1f\x8b\x08\x04"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
VALUE = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
PAIRS = [LETTERS[b >> 4] + LETTERS[b & 15] for b in range(256)]
#: Bytes of a file that a task reads, and the longest block.
SPLIT, LONGEST_BLOCK = 64 << 20, 1 << 16
INT_TAGS = {"AS": "as_", "XS": "xs", "YS": "ys", "XG": "xg", "NM": "nm", "XM": "xm", "XO": "xo"}


class Blocks:
    """Bytes of a block-compressed file from a virtual offset on."""

    def __init__(self, path: str, offset: int = 0):
        self.file = open(path, "rb")
        self.file.seek(offset >> 16)
        self.at, self.data, self.pos = offset >> 16, b"", 0
        if self._next():
            self.pos = offset & 0xFFFF

    def _next(self) -> bool:
        self.at = self.file.tell()
        head = self.file.read(18)
        if len(head) < 18:
            self.data, self.pos = b"", 0
            return False
        extra = struct.unpack_from("<H", head, 10)[0]
        size = struct.unpack_from("<H", head, 16)[0] + 1
        body = self.file.read(size - 18)
        self.data, self.pos = zlib.decompress(body[extra - 6 : -8], -15), 0
        return True

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            got = self.data[self.pos : self.pos + n]
            self.pos += len(got)
            n -= len(got)
            parts.append(got)
            if n and not got and not self._next():
                break
        return b"".join(parts)

    def offset(self) -> int:
        """Virtual offset of the next byte; at a block's end that is the next block's first."""
        while self.pos >= len(self.data) and self._next():
            pass
        return self.at << 16 | self.pos


def header_text(path: str) -> str:
    """The header's text of a file, or of the first file of a folder."""
    blocks = Blocks(files(path)[0])
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    return blocks.read(struct.unpack("<i", blocks.read(4))[0]).rstrip(b"\0").decode()


def files(path: str) -> list[str]:
    return sorted(glob.glob(os.path.join(path, "*.bam"))) if os.path.isdir(path) else [path]


def header(blocks: Blocks) -> list[tuple[str, int]]:
    """Contigs with their lengths."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return out


def _tags(raw: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """Values by tag as text, and their types (arrays as B and the type of their elements)."""
    out, kinds, p = {}, {}, 0
    while p + 3 <= len(raw):
        name, kind, p = raw[p : p + 2].decode(), chr(raw[p + 2]), p + 3
        kinds[name] = kind
        if kind == "A":
            out[name], p = chr(raw[p]), p + 1
        elif kind in "ZH":
            end = raw.index(b"\0", p)
            out[name], p = raw[p:end].decode("utf-8", "replace"), end + 1
        elif kind == "B":
            sub, n = chr(raw[p]), struct.unpack_from("<i", raw, p + 1)[0]
            values = struct.unpack_from(f"<{n}{VALUE[sub]}", raw, p + 5)
            out[name], p, kinds[name] = ",".join(map(str, values)), p + 5 + struct.calcsize(f"<{n}{VALUE[sub]}"), "B" + sub
        else:
            out[name], p = str(struct.unpack_from("<" + VALUE[kind], raw, p)[0]), p + struct.calcsize("<" + VALUE[kind])
    return out, kinds


def _packed_tag(name: str, kind: str, value: str) -> bytes:
    head = name.encode() + kind[0].encode()
    if kind in ("Z", "H"):
        return head + value.encode() + b"\0"
    if kind == "A":
        return head + value[:1].encode()
    if kind[0] == "B":
        values = [float(v) if kind[1] == "f" else int(v) for v in value.split(",") if v]
        return head + kind[1].encode() + struct.pack(f"<i{len(values)}{VALUE[kind[1]]}", len(values), *values)
    if kind == "f":
        return head + struct.pack("<f", float(value))
    return head + struct.pack("<" + VALUE[kind], int(value))


def record(raw: bytes, names: list[str], ord_: int) -> tuple:
    """A row of the reads schema from one record."""
    contig, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    p = 32
    qname = raw[p : p + l_name - 1].decode()
    p += l_name
    cigar = "".join(f"{x >> 4}{CIGAR[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", raw, p))
    p += 4 * n_cigar
    seq = "".join(map(PAIRS.__getitem__, raw[p : p + (l_seq + 1) // 2]))[:l_seq]
    p += (l_seq + 1) // 2
    quals = raw[p : p + l_seq]
    tags, kinds = _tags(raw[p + l_seq :])

    def whole(t: str) -> int | None:
        v = tags.get(t)
        return int(v) if v is not None and v.lstrip("-").isdigit() else None

    return (
        ord_, qname + ("/1" if flag & 0x40 else "/2"), qname, bool(flag & 0x40), bool(flag & 0x10), bool(flag & 0x20), bool(flag & 0x4), contig if contig >= 0 else None,
        names[contig] if contig >= 0 else None, pos if pos >= 0 else None, mapq, tlen, seq or None, None if not quals or quals[0] == 255 else bytes(q + 33 for q in quals).decode(),
        *(whole(t) for t in INT_TAGS), tags.get("YT"), tags, kinds, flag, cigar or None, names[mate] if mate >= 0 else None, mate_pos if mate_pos >= 0 else None, raw,
    )


def index_spans(path: str) -> list[tuple[int, int, tuple[int, ...]] | None]:
    """From ``path``.bai, for each contig the virtual offsets of its first read and of its end, and those of its windows of 16,384 bases; None without reads."""
    with open(path, "rb") as f:
        raw = f.read()
    if raw[:4] != b"BAI\1":
        raise ValueError("not a BAI file")
    n, p, out = struct.unpack_from("<i", raw, 4)[0], 8, []
    for _ in range(n):
        bins, p, least, most = struct.unpack_from("<i", raw, p)[0], p + 4, None, 0
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", raw, p)
            p += 8
            for _ in range(chunks):
                a, b = struct.unpack_from("<QQ", raw, p)
                p += 16
                # bin 37450 holds counts, not places
                if number != 37450:
                    least, most = a if least is None else min(a, least), max(b, most)
        windows = struct.unpack_from("<i", raw, p)[0]
        linear = struct.unpack_from(f"<{windows}Q", raw, p + 4)
        p += 4 + 8 * windows
        out.append(None if least is None else (least, most, linear))
    return out


def block_from(path: str, at: int) -> int | None:
    """Where the first block begins that starts at ``at`` or later: its header is followed by another block's, or by the end of the file."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        f.seek(at)
        data = f.read(3 * LONGEST_BLOCK)
        p = data.find(MAGIC)
        while p >= 0:
            if data[p + 12 : p + 16] == b"BC\2\0" and p + 18 <= len(data):
                after = at + p + struct.unpack_from("<H", data, p + 16)[0] + 1
                f.seek(after)
                if after == size or f.read(4) == MAGIC:
                    return at + p
            p = data.find(MAGIC, p + 1)
    return None


def _follows(data: bytes, p: int, contigs: int, records: int = 4) -> bool:
    """Whether ``records`` records, or as many as are there, could follow each other from ``p``; the first must be whole."""
    for i in range(records):
        if p + 36 > len(data):
            return i > 0
        size, contig, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, p)
        if not (-1 <= contig < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1 and l_name > 0 and l_seq >= 0):
            return False
        if size < 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq:
            return False
        name = data[p + 36 : p + 36 + l_name]
        if len(name) == l_name and (name[-1] != 0 or not all(33 <= c <= 126 for c in name[:-1])):
            return False
        p += 4 + size
        if p > len(data):
            return i > 0
    return True


def record_from(path: str, at: int, contigs: int) -> int | None:
    """Virtual offset of the first record that begins in a block at ``at`` or later."""
    while (block := block_from(path, at)) is not None:
        blocks = Blocks(path, block << 16)
        first = len(blocks.data)
        data = blocks.read(first + 4 * LONGEST_BLOCK)
        for p in range(first):
            if _follows(data, p, contigs):
                return block << 16 | p
        at = block + 1
    return None


@dataclass
class Piece(InputPartition):
    """Records of ``contig`` (None: all, -1: unplaced ones) that begin from ``start`` on, a virtual offset or, where ``guess``, a byte, and before ``stop``, a virtual offset."""

    path: str
    start: int
    guess: bool
    stop: int
    contig: int | None
    number: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.contig = int(options["contig"]) if "contig" in options else None
        self.begin, self.end = int(options.get("begin", -(1 << 40))), int(options.get("end", 1 << 40))
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Piece]:
        out: list[Piece] = []

        def cut(f: str, start: int, stop: int, contig: int | None) -> None:
            # the first piece begins where a record surely does, the others where one is found
            cuts = list(range((start >> 16) + self.split, stop >> 16, self.split))
            for a, b in zip([start, *cuts], [*(c << 16 for c in cuts), stop]):
                out.append(Piece(f, a, a != start, b, contig, len(out)))

        for f in files(self.path):
            blocks = Blocks(f)
            header(blocks)
            first, size = blocks.offset(), os.path.getsize(f) << 16
            if not os.path.exists(f + ".bai"):
                cut(f, first, size, self.contig)
                continue
            spans = index_spans(f + ".bai")
            for i, span in enumerate(spans):
                if span is not None and self.contig in (None, i):
                    windows = [w for w in span[2][: (max(self.begin, 0) >> 14) + 1] if w]
                    # reads of an earlier window may begin later than its first overlap, never before it
                    cut(f, max(span[0], windows[-1]) if windows else span[0], span[1], i)
            if self.contig is None:
                cut(f, max([s[1] for s in spans if s is not None], default=first), size, -1)
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        contigs = header(Blocks(piece.path))
        names = [n for n, _ in contigs]
        start = record_from(piece.path, piece.start, len(contigs)) if piece.guess else piece.start
        if start is None:
            return
        blocks = Blocks(piece.path, start)
        # file order: the piece above, the record's number within it below
        number = piece.number << 40
        while blocks.offset() < piece.stop and len(size := blocks.read(4)) == 4:
            raw = blocks.read(struct.unpack("<i", size)[0])
            contig, pos = struct.unpack_from("<ii", raw)
            if piece.contig in (None, contig) and self.begin <= pos < self.end:
                yield record(raw, names, number)
            number += 1


def _bin(begin: int, end: int) -> int:
    """The index bin of an interval: the smallest of the nested ranges that holds it."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
    return 0


def _packed(row, names: dict[str, int]) -> bytes:
    """A record: the row's own bytes with its mapping quality, or one made from its columns."""
    own = getattr(row, "record", None)
    mapq = min(max(row.mapq if row.mapq is not None else 255, 0), 255)
    if own:
        body = bytearray(own)
        # all of a recalibrated record stays, the quality is its tenth byte
        body[9] = mapq
        return struct.pack("<i", len(body)) + bytes(body)
    seq, qual = row.seq or "", row.qual or ""
    code = {c: i for i, c in enumerate(LETTERS)}
    nib = [code.get(c, 15) for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(nib[::2], nib[1::2]))
    quals = bytes(ord(c) - 33 for c in qual) if len(qual) == len(seq) else b"\xff" * len(seq)
    contig = names.get(row.contig, -1) if row.contig is not None else -1
    flag = getattr(row, "flag", None)
    if flag is None:
        flag = 1 | (0x40 if row.is_first else 0x80) | (0x10 if row.is_rc else 0) | (0x20 if row.mate_rc else 0) | (0x4 if row.is_unmapped else 0)
    # a row without a CIGAR doesn't say how it is aligned: none is made up
    steps = re.findall(r"(\d+)([MIDNSHP=X])", getattr(row, "cigar", None) or "")
    cigar = b"".join(struct.pack("<I", int(n) << 4 | CIGAR.index(c)) for n, c in steps)
    span = sum(int(n) for n, c in steps if c in "MDN=X") or len(seq) or 1
    tags, kinds = getattr(row, "tags", None), getattr(row, "tag_types", None) or {}
    if tags:
        extra = b"".join(_packed_tag(t, kinds.get(t) or ("i" if t in INT_TAGS else "Z"), v) for t, v in tags.items())
    else:
        extra = b"".join(t.encode() + b"i" + struct.pack("<i", getattr(row, c)) for t, c in INT_TAGS.items() if getattr(row, c) is not None)
        if row.yt is not None:
            extra += b"YTZ" + row.yt.encode() + b"\0"
    name = row.qname.encode() + b"\0"
    pos = row.begin_pos if row.begin_pos is not None else -1
    mate, mate_pos = getattr(row, "mate_contig", None), getattr(row, "mate_pos", None)
    place = names.get(mate, -1) if mate is not None else -1, mate_pos if mate_pos is not None else -1
    bin_ = _bin(pos, pos + span) if pos >= 0 else 4680
    head = struct.pack("<iiBBHHHiiii", contig, pos, len(name), mapq, bin_, len(steps), flag, len(seq), *place, row.tlen or 0)
    body = head + name + cigar + packed + quals + extra
    return struct.pack("<i", len(body)) + body


def _block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return bytes.fromhex("1f8b08040000000000ff060042430200") + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Written(WriterCommitMessage):
    temp: str
    final: str


class BamWriter(DataSourceWriter):
    """Each task writes a whole BAM file of its rows, in their order, which appears once the job is done.

    Option ``contigs`` is ``name:length,...`` in header order, ``header`` the header's text, by default a line for each contig.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.contigs = [(n, int(x)) for n, x in (c.rsplit(":", 1) for c in options["contigs"].split(","))]
        self.text = options.get("header") or "".join(f"@SQ\tSN:{n}\tLN:{x}\n" for n, x in self.contigs)
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        part, job = TaskContext.get().partitionId(), uuid.uuid4().hex
        temp = os.path.join(self.path, f"_part-{part:05d}-{job}")
        names = {n: i for i, (n, _) in enumerate(self.contigs)}
        text = self.text.encode()
        buf = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.contigs))
        buf += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", x) for n, x in self.contigs)
        with open(temp, "wb") as f:
            for row in rows:
                buf += _packed(row, names)
                while len(buf) > 60_000:
                    f.write(_block(buf[:60_000]))
                    buf = buf[60_000:]
            f.write(_block(buf) + LAST_BLOCK)
        return Written(temp, os.path.join(self.path, f"part-{part:05d}-{job[:8]}.bam"))

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for old in [*glob.glob(os.path.join(self.path, "part-*.bam")), *glob.glob(os.path.join(self.path, "part-*.bam.bai"))]:
                os.remove(old)
        for m in messages:
            if m is not None:
                os.replace(m.temp, m.final)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temp):
                os.remove(m.temp)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return schemas.READS

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BamWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def index_file(path: str) -> None:
    """Writes ``path``.bai for a sorted file: for each contig one chunk from its first to its last read, and the first read that begins in each window."""
    blocks = Blocks(path)
    names = header(blocks)
    spans: dict[int, list[int]] = {}
    windows: dict[int, list[int]] = {}
    while True:
        start = blocks.offset()
        size = blocks.read(4)
        if len(size) < 4:
            break
        raw = blocks.read(struct.unpack("<i", size)[0])
        contig, pos = struct.unpack_from("<ii", raw)
        if contig >= 0:
            spans.setdefault(contig, [start, start])[1] = blocks.offset()
            own = windows.setdefault(contig, [])
            while len(own) <= max(pos, 0) >> 14:
                own.append(start)
    out = b"BAI\1" + struct.pack("<i", len(names))
    for i in range(len(names)):
        if i in spans:
            own = windows[i]
            out += struct.pack("<iIiQQ", 1, 0, 1, *spans[i]) + struct.pack(f"<i{len(own)}Q", len(own), *own)
        else:
            out += struct.pack("<ii", 0, 0)
    with open(path + ".bai", "wb") as f:
        f.write(out)
