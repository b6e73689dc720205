import struct
import zlib

from tidemill.sources import compound


def record(tag, level, body):
    if len(body) < 0xFFF:
        return struct.pack("<I", tag | level << 10 | len(body) << 20) + body
    return struct.pack("<II", tag | level << 10 | 0xFFF << 20, len(body)) + body


def cell(row, col, rowspan=1, colspan=1):
    return bytes(8) + struct.pack("<HHHH", col, row, colspan, rowspan) + bytes(8)


SECTION = (
    record(66, 0, b"") + record(67, 1, "안내".encode("utf-16-le") + struct.pack("<8H", 11, *[7] * 7) + "끝\r".encode("utf-16-le"))
    + record(71, 1, b" lbt") + record(77, 2, bytes(8))
    + record(72, 2, cell(0, 0, 1, 2)) + record(66, 2, b"") + record(67, 3, "제목".encode("utf-16-le"))
    + record(72, 2, cell(1, 0)) + record(67, 3, ("긴" * 3000).encode("utf-16-le")) + record(72, 2, cell(1, 1)) + record(67, 3, "나".encode("utf-16-le"))
    + record(66, 0, b"") + record(67, 1, "뒤".encode("utf-16-le"))
)


def packed(streams):
    """A compound file with 512-byte sectors and no small streams."""
    free, end = 0xFFFFFFFF, 0xFFFFFFFE
    sectors, fat, starts = [], [], {}
    for name, raw in streams.items():
        raw = raw.ljust(4096, b"\0") if name == "FileHeader" else raw + bytes(max(0, 4096 - len(raw)))
        n = -(-len(raw) // 512)
        starts[name] = (len(sectors), len(raw))
        for i in range(n):
            sectors.append(raw[i * 512 : (i + 1) * 512].ljust(512, b"\0"))
            fat.append(len(sectors) if i + 1 < n else end)

    def entry(name, kind, left=free, right=free, child=free, start=0, size=0):
        label = name.encode("utf-16-le")
        return label.ljust(64, b"\0") + struct.pack("<HBBIII", len(label) + 2, kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", start, size)

    folder = entry("Root Entry", 5, child=1) + entry("FileHeader", 2, right=2, start=starts["FileHeader"][0], size=starts["FileHeader"][1]) + entry("BodyText", 1, child=3) + entry("Section0", 2, start=starts["Section0"][0], size=starts["Section0"][1])
    at = len(sectors)
    sectors.append(folder)
    fat.append(end)
    n_fat = -(-(len(fat) + 4) // 128)
    fat_at = len(sectors)
    fat += [0xFFFFFFFD] * n_fat
    raw = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * 512, b"\xff")
    sectors += [raw[i * 512 : (i + 1) * 512] for i in range(n_fat)]
    head = compound.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, n_fat, at, 0, 4096, end, 0, end, 0)
    head += struct.pack("<109I", *[fat_at + i if i < n_fat else free for i in range(109)])
    return head + b"".join(sectors)


def test_records_of_a_section():
    paragraphs, tables = compound.section(SECTION)
    assert paragraphs == ["안내끝", "뒤"]
    assert [(c["row"], c["col"], c["rowspan"], c["colspan"], c["text"][:2]) for c in tables[0]["cells"]] == [(0, 0, 1, 2, "제목"), (1, 0, 1, 1, "긴긴"), (1, 1, 1, 1, "나")]


def test_whole_file():
    deflated = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = deflated.compress(SECTION) + deflated.flush()
    for flags, body in ((0, SECTION), (1, raw)):
        body = body if flags else body + record(66, 0, bytes(max(0, 4096 - len(body))))
        found = compound.document(packed({"FileHeader": bytes(36) + struct.pack("<I", flags), "Section0": body}))
        assert found["status"] == "extracted" and found["tables"][0]["rows"] == 2 and found["paragraphs"][0] == "안내끝"
    assert compound.document(packed({"FileHeader": bytes(36) + struct.pack("<I", 2), "Section0": raw}))["status"] == "needs_parser"
