"""Reader of compound files (the public MS-CFB format), for streams of word processor files."""

from __future__ import annotations

import struct

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF
_MAX_REGULAR = 0xFFFFFFFA


class CompoundFile:
    """Streams of a compound file by path, such as BodyText/Section0; raises ValueError where it is broken."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift > 12:
            raise ValueError("sector size")
        self.sector, self.mini = 1 << shift, 1 << mini_shift
        n_fat, first_dir = struct.unpack_from("<II", data, 44)
        self.cutoff, first_mini_fat, n_mini_fat, first_difat, n_difat = struct.unpack_from("<5I", data, 56)
        difat = [x for x in struct.unpack_from("<109I", data, 76) if x <= _MAX_REGULAR]
        at, seen = first_difat, 0
        while at <= _MAX_REGULAR and seen < n_difat:
            entries = struct.unpack(f"<{self.sector // 4}I", self._sector(at))
            difat += [x for x in entries[:-1] if x <= _MAX_REGULAR]
            at, seen = entries[-1], seen + 1
        self.fat: list[int] = []
        for x in difat[:n_fat]:
            self.fat += struct.unpack(f"<{self.sector // 4}I", self._sector(x))
        mini = self._chain(first_mini_fat) if n_mini_fat and first_mini_fat <= _MAX_REGULAR else b""
        self.mini_fat = list(struct.unpack(f"<{len(mini) // 4}I", mini))
        self.entries = self._directory(self._chain(first_dir))
        root = self.entries[0]
        self.mini_stream = self._chain(root[3])[: root[4]] if root[4] else b""
        self.streams: dict[str, int] = {}
        self._walk(root[2][2], "", set())

    def _sector(self, i: int) -> bytes:
        at = (i + 1) * self.sector
        out = self.data[at : at + self.sector]
        if len(out) < self.sector:
            out += b"\0" * (self.sector - len(out))
            if at >= len(self.data):
                raise ValueError("sector outside the file")
        return out

    def _chain(self, i: int) -> bytes:
        out, seen = [], set()
        while i <= _MAX_REGULAR:
            if i in seen or i >= len(self.fat):
                raise ValueError("sector chain")
            seen.add(i)
            out.append(self._sector(i))
            i = self.fat[i]
        return b"".join(out)

    @staticmethod
    def _directory(data: bytes) -> list[tuple[str, int, tuple[int, int, int], int, int]]:
        out = []
        for at in range(0, len(data) - 127, 128):
            n, kind = struct.unpack_from("<HB", data, at + 64)
            name = data[at : at + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
            links = struct.unpack_from("<III", data, at + 68)
            start, size = struct.unpack_from("<IQ", data, at + 116)
            out.append((name, kind, links, start, size))
        return out

    def _walk(self, i: int, prefix: str, seen: set[int]) -> None:
        todo = [(i, prefix)]
        while todo:
            i, prefix = todo.pop()
            if i > _MAX_REGULAR or i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            name, kind, (left, right, child), _, _ = self.entries[i]
            todo += [(left, prefix), (right, prefix)]
            if kind == 1:
                todo.append((child, f"{prefix}{name}/"))
            elif kind == 2:
                self.streams[prefix + name] = i

    def read(self, path: str) -> bytes:
        _, _, _, start, size = self.entries[self.streams[path]]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen, i = [], set(), start
        while i <= _MAX_REGULAR and size:
            if i in seen or i >= len(self.mini_fat):
                raise ValueError("short sector chain")
            seen.add(i)
            out.append(self.mini_stream[i * self.mini : (i + 1) * self.mini])
            i = self.mini_fat[i]
        return b"".join(out)[:size]


def build(streams: dict[str, bytes]) -> bytes:
    """A small compound file that holds the streams, for fixtures and tests; every stream takes regular sectors."""
    names: list[tuple[str, int, bytes]] = [("Root Entry", 5, b"")]
    children: dict[str, list[int]] = {"": []}
    for path, body in streams.items():
        folder, _, name = path.rpartition("/")
        if folder and folder not in children:
            children[""].append(len(names))
            children[folder] = []
            names.append((folder, 1, b""))
        children[folder].append(len(names))
        names.append((name, 2, body))
    folders = {n: i for i, (n, k, _) in enumerate(names) if k == 1}
    n_dir = -(-len(names) // 4)
    sectors: list[bytes] = []
    fat: list[int] = []
    starts: dict[int, int] = {}
    for i, (_, kind, body) in enumerate(names):
        if kind == 2:
            starts[i] = len(sectors)
            n = max(1, -(-len(body) // 512))
            sectors += [body[k * 512 : (k + 1) * 512].ljust(512, b"\0") for k in range(n)]
            fat += [*range(starts[i] + 1, starts[i] + n), _END]
    first_dir = len(sectors)
    fat += [*range(first_dir + 1, first_dir + n_dir), _END]
    n_fat = 1
    while (len(fat) + n_fat) > 128 * n_fat:
        n_fat += 1
    fat_at = first_dir + n_dir
    fat += [0xFFFFFFFD] * n_fat
    rows = b""
    for i, (name, kind, body) in enumerate(names):
        group = children[""] if kind != 2 or i in children[""] else next(g for f, g in children.items() if f and i in g)
        right = group[group.index(i) + 1] if i in group and group.index(i) + 1 < len(group) else _FREE
        own = children[""] if kind == 5 else children.get(name, []) if kind == 1 and folders.get(name) == i else []
        raw = name.encode("utf-16-le")
        rows += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + struct.pack("<III", _FREE, right, own[0] if own else _FREE)
        rows += b"\0" * 36 + struct.pack("<IQ", starts.get(i, _END), len(body))
    rows = rows.ljust(n_dir * 512, b"\0")
    table = struct.pack(f"<{128 * n_fat}I", *fat, *[_FREE] * (128 * n_fat - len(fat)))
    difat = [fat_at + k for k in range(n_fat)] + [_FREE] * (109 - n_fat)
    head = MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<II", 0, n_fat)
    head += struct.pack("<III", first_dir, 0, 0) + struct.pack("<IIII", _END, 0, _END, 0) + struct.pack("<109I", *difat)
    return head.ljust(512, b"\0") + b"".join(sectors) + rows + table
