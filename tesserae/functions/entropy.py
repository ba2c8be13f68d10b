"""Entropy coders as NumPy kernels that run many independent streams in lock step.

A lane is one stream: one of the four interleaved streams of a range-coded section, or one block of
a table-coded one. All lanes of a batch take a step together, so Python's cost is one loop over the
longest lane and not over all bytes. Lanes are sorted by length first, which lets finished ones
drop off the end.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the two section formats.
RANS_BITS, RANS_LOW, RANS_STREAMS = 12, 1 << 23, 4
TANS_FORMAT, TANS_BITS, TANS_BLOCK, TANS_MAX_BITS = 2, 12, 2048, 15
RAW, RANS, TANS = 0, 1, 2
MIN_BYTES, MIN_GAIN = 48, 8
MISSING = 1e9


class CorruptSection(ValueError):
    pass


def histogram(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def normalize(counts, bits: int = RANS_BITS) -> np.ndarray:
    """Integer frequencies with a sum of 2 ** bits: floors, at least 1 where a symbol occurs, the rest made up at the most frequent symbol (the lowest of several)."""
    c = np.asarray(counts, np.int64)
    total, size = int(c.sum()), 1 << bits
    if not total:
        return np.zeros(len(c), np.int64)
    f = np.where(c > 0, np.clip(c * size // total, 1, size), 0)
    while (over := int(f.sum()) - size) > 0:
        # level the top down to the next height, one unit at a time for equal ones, lowest symbol first
        top = int(f.max())
        ties = np.flatnonzero(f == top)
        f[ties[:over]] -= 1
    f[int(f.argmax())] += size - int(f.sum())
    return f


def pairs(freq: np.ndarray) -> bytes:
    used = np.flatnonzero(freq)
    return struct.pack("<H", len(used)) + b"".join(struct.pack("<BH", s, freq[s]) for s in used.tolist())


def read_pairs(blob: bytes, at: int, bits: int) -> tuple[np.ndarray, int]:
    if at + 2 > len(blob):
        raise CorruptSection("truncated table")
    n = struct.unpack_from("<H", blob, at)[0]
    at += 2
    if n > 256 or at + 3 * n > len(blob):
        raise CorruptSection("bad table size")
    f = np.zeros(256, np.int64)
    last = -1
    for _ in range(n):
        s, v = struct.unpack_from("<BH", blob, at)
        if s <= last or v == 0:
            raise CorruptSection("table out of order")
        f[s], last, at = v, s, at + 3
    if n and f.sum() != 1 << bits:
        raise CorruptSection("frequencies don't sum up")
    return f, at


def lanes_matrix(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lanes, longest) bytes, lengths, order: longest first."""
    size = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-size, kind="stable")
    m = np.zeros((len(parts), int(size.max(initial=0))), np.uint8)
    for row, k in enumerate(order):
        m[row, : size[k]] = parts[k]
    return m, size[order], order


def rans_encode(sections: list[bytes]) -> list[bytes]:
    """Self-describing sections: u32 length, table, four u32 stream lengths, streams, four u32 states."""
    if not sections:
        return []
    arrays = [np.frombuffer(s, np.uint8) for s in sections]
    freq = np.stack([normalize(np.bincount(a, minlength=256)) for a in arrays])
    start = np.cumsum(freq, 1) - freq
    m, size, order = lanes_matrix([a[j::RANS_STREAMS] for a in arrays for j in range(RANS_STREAMS)])
    table = order // RANS_STREAMS
    x = np.full(len(order), RANS_LOW, np.int64)
    out = np.zeros((len(order), 2 * m.shape[1] + 8), np.uint8)
    fill = np.zeros(len(order), np.int64)
    live = 0
    for t in range(m.shape[1] - 1, -1, -1):
        while live < len(size) and size[live] > t:
            live += 1
        rows = np.arange(live)
        sym = m[:live, t]
        f, s = freq[table[:live], sym], start[table[:live], sym]
        cap = ((RANS_LOW >> RANS_BITS) << 8) * f
        for _ in range(2):
            push = rows[x[:live] >= cap]
            out[push, fill[push]] = x[push] & 255
            fill[push] += 1
            x[push] >>= 8
        x[:live] = ((x[:live] // f) << RANS_BITS) + x[:live] % f + s
    streams: list[bytes] = [b""] * len(order)
    finals = np.empty(len(order), np.int64)
    for row, k in enumerate(order):
        streams[k] = out[row, : fill[row]][::-1].tobytes()
        finals[k] = x[row]
    result = []
    for k, a in enumerate(arrays):
        own = streams[4 * k:4 * k + 4]
        result.append(struct.pack("<I", len(a)) + pairs(freq[k]) + struct.pack("<4I", *map(len, own)) + b"".join(own) + struct.pack("<4I", *finals[4 * k:4 * k + 4].tolist()))
    return result


def rans_decode(blobs: list[bytes]) -> list[bytes | CorruptSection]:
    """Sections back from blobs; one that is damaged gives its error."""
    result: list = [None] * len(blobs)
    heads = {}
    for k, b in enumerate(blobs):
        try:
            if len(b) < 6:
                raise CorruptSection("truncated header")
            n = struct.unpack_from("<I", b)[0]
            f, at = read_pairs(b, 4, RANS_BITS)
            if at + 16 > len(b):
                raise CorruptSection("truncated header")
            lens = struct.unpack_from("<4I", b, at)
            if at + 32 + sum(lens) != len(b) or (n and not f.any()) or n > (1 << 31):
                raise CorruptSection("lengths don't match")
            if n > 8 * 4096 * (sum(lens) + 16):
                raise CorruptSection("more symbols than the streams can hold")
            streams, p = [], at + 16
            for size in lens:
                streams.append(np.frombuffer(b, np.uint8, size, p))
                p += size
            heads[k] = (n, f, streams, struct.unpack_from("<4I", b, p))
        except CorruptSection as e:
            result[k] = e
    if not heads:
        return result
    keys = list(heads)
    freq = np.stack([heads[k][1] for k in keys])
    start = np.cumsum(freq, 1) - freq
    symbol = np.zeros((len(keys), 1 << RANS_BITS), np.uint8)
    for i in range(len(keys)):
        full = np.repeat(np.arange(256), freq[i])
        symbol[i, : len(full)] = full
    count = np.array([(heads[k][0] + 3 - j) // 4 for k in keys for j in range(4)])
    order = np.argsort(-count, kind="stable")
    m, size, _ = lanes_matrix([heads[k][2][j] for k in keys for j in range(4)])
    place = np.empty(len(order), np.int64)
    place[_] = np.arange(len(order))
    stream_row, need = place[order], count[order]
    stream_size = size[stream_row]
    table = order // 4
    x = np.array([s for k in keys for s in heads[k][3]], np.int64)[order]
    p = np.zeros(len(order), np.int64)
    bad = np.zeros(len(order), bool)
    out = np.zeros((len(order), int(count.max(initial=0))), np.uint8)
    live = len(order)
    for t in range(out.shape[1]):
        while live and need[live - 1] <= t:
            live -= 1
        rows = np.arange(live)
        slot = x[:live] & ((1 << RANS_BITS) - 1)
        sym = symbol[table[:live], slot]
        out[:live, t] = sym
        x[:live] = freq[table[:live], sym] * (x[:live] >> RANS_BITS) + slot - start[table[:live], sym]
        for _ in range(2):
            pull = rows[(x[:live] < RANS_LOW) & ~bad[:live]]
            short = pull[p[pull] >= stream_size[pull]]
            bad[short] = True
            pull = pull[p[pull] < stream_size[pull]]
            x[pull] = (x[pull] << 8) | m[stream_row[pull], p[pull]]
            p[pull] += 1
    bad |= (x != RANS_LOW) | (p != stream_size)
    wrong, lanes = np.empty(len(order), bool), [b""] * len(order)
    for row, k in enumerate(order):
        wrong[k] = bad[row]
        lanes[k] = out[row, : need[row]]
    for i, k in enumerate(keys):
        if wrong[4 * i:4 * i + 4].any():
            result[k] = CorruptSection("streams don't end where they should")
            continue
        whole = np.empty(heads[k][0], np.uint8)
        for j in range(4):
            whole[j::4] = lanes[4 * i + j]
        result[k] = whole.tobytes()
    return result


def spread(freq: np.ndarray, bits: int = TANS_BITS) -> np.ndarray:
    """Symbol of each slot: occurrence i (symbols ascending) takes slot i * step mod 2 ** bits, with an odd step."""
    size = 1 << bits
    step = (size >> 1) + (size >> 3) + 3
    out = np.zeros(size, np.uint8)
    out[np.arange(int(freq.sum())) * step % size] = np.repeat(np.arange(256), freq)
    return out


class Table:
    """State tables of one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int) -> None:
        freq = np.asarray(freq, np.int64)
        size = 1 << bits
        self.freq, self.bits, self.size = freq, bits, size
        self.symbol = spread(freq, bits)
        by_symbol = np.argsort(self.symbol, kind="stable")  # slots of each symbol, ascending
        self.first = np.cumsum(freq) - freq
        self.slots = by_symbol
        rank = np.empty(size, np.int64)
        rank[by_symbol] = np.arange(size) - self.first[self.symbol[by_symbol]]
        state = np.maximum(freq[self.symbol] + rank, 1)
        log = lambda v: np.frexp(v.astype(np.float64))[1] - 1
        self.width = (bits - log(state)).astype(np.int64)
        self.base = state << self.width
        self.most = np.where(freq > 0, bits - log(np.maximum(freq, 1)), 0).astype(np.int64)


def code_lengths(freq: np.ndarray, bits: int = TANS_BITS) -> np.ndarray:
    f = np.asarray(freq, np.float64)
    return np.where(f > 0, bits - np.log2(np.maximum(f, 1)), MISSING)


def block_histograms(data: bytes, block: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    n = -(-len(a) // block)
    return np.bincount(a + 256 * (np.arange(len(a)) // block), minlength=256 * n).reshape(n, 256)


def select_tables(hists: np.ndarray, tables: list[np.ndarray], bits: int = TANS_BITS) -> np.ndarray:
    """Cheapest table of each block, the lowest of equal ones."""
    return cheapest(hists, np.stack([code_lengths(t, bits) for t in tables], 1))


def cheapest(hists: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """select_tables by code lengths (256, tables)."""
    return (hists.astype(np.float64) @ lengths).argmin(1)


def stack(tables: list[Table]) -> dict[str, np.ndarray]:
    return {k: np.stack([getattr(t, k) for t in tables]) for k in ("freq", "symbol", "first", "slots", "width", "base", "most")}


def tans_blocks(blocks: list[np.ndarray], which: np.ndarray, tables: list[Table]) -> list[tuple[bytes, int, int]]:
    """(payload, bits, final state) of each block."""
    if not blocks:
        return []
    t = stack(tables)
    size = tables[0].size
    m, n, order = lanes_matrix(blocks)
    tab = which[order]
    x = np.full(len(order), size, np.int64)
    value, width = np.zeros(m.shape, np.int64), np.zeros(m.shape, np.int64)
    live = len(order)
    for i in range(m.shape[1]):
        while live and n[live - 1] <= i:
            live -= 1
        w, sym = tab[:live], m[:live, i]
        f, k = t["freq"][w, sym], t["most"][w, sym]
        k = k - ((x[:live] >> k) < f)
        value[:live, i], width[:live, i] = x[:live] & ((1 << k) - 1), k
        x[:live] = size + t["slots"][w, t["first"][w, sym] + (x[:live] >> k) - f]
    bits = width.sum(1)
    begin = np.concatenate([[0], np.cumsum((bits + 7) // 8 * 8)])
    at = begin[:-1, None] + np.cumsum(width, 1) - width
    stream = np.zeros(int(begin[-1]), np.uint8)
    for b in range(int(width.max(initial=0))):
        has = width > b
        stream[at[has] + b] = (value[has] >> b) & 1
    packed = np.packbits(stream, bitorder="little")
    out: list = [None] * len(order)
    for row, k in enumerate(order):
        out[k] = (packed[begin[row] // 8:begin[row + 1] // 8].tobytes(), int(bits[row]), int(x[row]))
    return out


def tans_unblock(payloads: list[bytes], bits: np.ndarray, finals: np.ndarray, sizes: np.ndarray, which: np.ndarray, tables: list[Table]) -> tuple[list[np.ndarray], np.ndarray]:
    """Blocks back, and which of them are damaged."""
    t = stack(tables)
    size = tables[0].size
    order = np.argsort(-sizes, kind="stable")
    wide = np.zeros((len(order), max(map(len, payloads), default=0) + 4), np.int64)
    for row, k in enumerate(order):
        wide[row, : len(payloads[k])] = np.frombuffer(payloads[k], np.uint8)
    x, p, tab, need = finals[order] - size, bits[order].astype(np.int64), which[order], sizes[order]
    bad = (x < 0) | (x >= size)
    x = np.clip(x, 0, size - 1)
    out = np.zeros((len(order), int(sizes.max(initial=0))), np.uint8)
    live = 0
    for i in range(out.shape[1] - 1, -1, -1):
        while live < len(order) and need[live] > i:
            live += 1
        rows, w = np.arange(live), tab[:live]
        out[:live, i] = t["symbol"][w, x[:live]]
        k = t["width"][w, x[:live]]
        p[:live] -= k
        bad[:live] |= p[:live] < 0
        q = np.maximum(p[:live], 0)
        byte = q >> 3
        v = (wide[rows, byte] | (wide[rows, byte + 1] << 8) | (wide[rows, byte + 2] << 16)) >> (q & 7)
        x[:live] = np.clip(t["base"][w, x[:live]] + (v & ((1 << k) - 1)) - size, 0, size - 1)
    bad |= (p != 0) | (x != 0)
    back, wrong = [None] * len(order), np.empty(len(order), bool)
    for row, k in enumerate(order):
        back[k], wrong[k] = out[row, : need[row]], bad[row]
    return back, wrong


def tans_encode(sections: list[bytes], bits: int = TANS_BITS, block: int = TANS_BLOCK, tables: list | None = None, embed: bool = True) -> list[bytes]:
    """Self-describing sections; with `tables` each block uses its cheapest one, else a table is made for each section."""
    if not 1 <= bits <= TANS_MAX_BITS:
        raise ValueError(f"bits must be in 1..{TANS_MAX_BITS}")
    if block < 1 or block * bits > 0xFFFF:
        raise ValueError("block must be positive and block * bits at most 65535")
    if tables is not None and (not tables or any(len(t) != 256 or sum(t) != 1 << bits or min(t) < 0 for t in tables)):
        raise ValueError("tables must be non-empty, of 256 frequencies with a sum of 2 ** bits")
    own = [[normalize(histogram(s), bits)] for s in sections] if tables is None else None
    freqs = [f for x in own for f in x] if own else [np.asarray(t, np.int64) for t in tables or []]
    built = [Table(f, bits) for f in freqs]
    lengths = np.stack([code_lengths(f, bits) for f in freqs], 1) if tables is not None else None
    blocks, which, spans, picks = [], [], [], []
    for k, s in enumerate(sections):
        a = np.frombuffer(s, np.uint8)
        cuts = [a[i:i + block] for i in range(0, len(a), block)]
        pick = np.full(len(cuts), k) if own else cheapest(block_histograms(s, block), lengths) if len(cuts) else np.zeros(0, np.int64)
        spans.append((len(blocks), len(blocks) + len(cuts)))
        blocks += cuts
        which += pick.tolist()
        picks.append(np.asarray(pick))
    coded = tans_blocks(blocks, np.array(which, np.int64), built) if blocks else []
    out = []
    for k, s in enumerate(sections):
        rows = coded[spans[k][0]:spans[k][1]]
        mine = own[k] if own else freqs
        head = struct.pack("<IBBBIB", len(s), TANS_FORMAT, bits, len(mine), block, int(embed))
        head += b"".join(pairs(f) for f in mine) if embed else b""
        head += struct.pack("<I", len(rows)) + struct.pack(f"<{len(rows)}H", *[r[1] for r in rows]) + struct.pack(f"<{len(rows)}H", *[r[2] for r in rows])
        order = np.arange(len(rows))
        if len(mine) > 1:
            head += bytes(picks[k].tolist())
            order = np.argsort(picks[k], kind="stable")
        out.append(head + b"".join(rows[i][0] for i in order.tolist()))
    return out


def tans_split(blob: bytes, tables: list | None = None) -> dict:
    """Header fields and payloads of a section, checked, not decoded."""
    if len(blob) < 12:
        raise CorruptSection("truncated header")
    n, fmt, bits, k, block, embed = struct.unpack_from("<IBBBIB", blob)
    if fmt != TANS_FORMAT or not 1 <= bits <= TANS_MAX_BITS or not k or not block or embed > 1 or block * bits > 0xFFFF:
        raise CorruptSection("bad header")
    at, freqs = 12, []
    if embed:
        for _ in range(k):
            f, at = read_pairs(blob, at, bits)
            freqs.append(f)
    elif tables is None or len(tables) != k:
        raise CorruptSection("section needs its dictionary")
    else:
        freqs = [np.asarray(t, np.int64) for t in tables]
    if at + 4 > len(blob):
        raise CorruptSection("truncated header")
    nb = struct.unpack_from("<I", blob, at)[0]
    at += 4
    if nb != -(-n // block) or at + nb * (4 + (k > 1)) > len(blob):
        raise CorruptSection("wrong number of blocks")
    lens = np.frombuffer(blob, "<u2", nb, at).astype(np.int64)
    finals = np.frombuffer(blob, "<u2", nb, at + 2 * nb).astype(np.int64)
    at += 4 * nb
    pick = np.frombuffer(blob, np.uint8, nb, at).astype(np.int64) if k > 1 else np.zeros(nb, np.int64)
    at += nb if k > 1 else 0
    if (pick >= k).any():
        raise CorruptSection("bad selector")
    size = (lens + 7) // 8
    if at + int(size.sum()) != len(blob):
        raise CorruptSection("payloads don't fill the section")
    payloads: list = [b""] * nb
    for i in np.argsort(pick, kind="stable").tolist():
        payloads[i] = blob[at:at + size[i]]
        at += int(size[i])
    sizes = np.full(nb, block)
    if nb:
        sizes[-1] = n - block * (nb - 1)
    return {"n": n, "bits": bits, "freqs": freqs, "lens": lens, "finals": finals, "pick": pick, "payloads": payloads, "sizes": sizes}


def tans_decode(blobs: list[bytes], tables: list | None = None) -> list[bytes | CorruptSection]:
    """Sections back; blocks of all sections that share a precision are decoded together."""
    tables = [np.asarray(t, np.int64) for t in tables] if tables else tables
    result: list = [None] * len(blobs)
    heads = {}
    for k, b in enumerate(blobs):
        try:
            heads[k] = tans_split(b, tables)
            if heads[k]["n"] and any(f.sum() == 0 for f in heads[k]["freqs"]):
                raise CorruptSection("empty table")
        except CorruptSection as e:
            result[k] = e
    for bits in {h["bits"] for k, h in heads.items() if result[k] is None}:
        keys = [k for k, h in heads.items() if h["bits"] == bits and result[k] is None]
        known: dict[bytes, int] = {}
        built: list[Table] = []
        which, payloads, lens, finals, sizes, ends = [], [], [], [], [], []
        for k in keys:
            h = heads[k]
            local = []
            for f in h["freqs"] if h["n"] else []:
                if f.tobytes() not in known:
                    known[f.tobytes()] = len(built)
                    built.append(Table(f, bits))
                local.append(known[f.tobytes()])
            which += [local[p] for p in h["pick"]]
            payloads += h["payloads"]
            lens += h["lens"].tolist()
            finals += h["finals"].tolist()
            sizes += h["sizes"].tolist()
            ends.append(len(payloads))
        ints = lambda v: np.array(v, np.int64)
        back, wrong = tans_unblock(payloads, ints(lens), ints(finals), ints(sizes), ints(which), built) if payloads else ([], np.zeros(0, bool))
        first = 0
        for k, end in zip(keys, ends, strict=True):
            result[k] = CorruptSection("damaged block") if wrong[first:end].any() else b"".join(x.tobytes() for x in back[first:end])
            first = end
    return result


def worth(raw: bytes, coded: bytes) -> bool:
    return len(raw) > MIN_BYTES and len(coded) * 100 < (100 - MIN_GAIN) * len(raw)


def pack(sections: list[bytes], method: int = RANS, **kw) -> list[tuple[int, bytes]]:
    """(method, stored): coded only where it saves enough."""
    if method == RAW:
        return [(RAW, s) for s in sections]
    coded = rans_encode(sections) if method == RANS else tans_encode(sections, **kw)
    return [(method, c) if worth(s, c) else (RAW, s) for s, c in zip(sections, coded, strict=True)]


def unpack(stored: list[tuple[int, bytes]], tables: list | None = None) -> list[bytes | CorruptSection]:
    out: list = [b if m == RAW else CorruptSection(f"unknown method {m}") if m not in (RANS, TANS) else None for m, b in stored]
    for method, decode in ((RANS, rans_decode), (TANS, lambda b: tans_decode(b, tables))):
        at = [i for i, (m, _) in enumerate(stored) if m == method]
        for i, x in zip(at, decode([stored[i][1] for i in at]) if at else [], strict=True):
            out[i] = x
    return out


def pack_planar(sections: list[bytes], method: int = RANS, **kw) -> list[tuple[int, bytes]]:
    """16-bit elements as a low and a high byte plane, coded apart; raw where neither gains."""
    planes = pack([p for s in sections for p in (s[0::2], s[1::2])], method, **kw)
    out = []
    for k, s in enumerate(sections):
        low, high = planes[2 * k], planes[2 * k + 1]
        wrapped = b"".join(struct.pack("<BI", m, len(b)) + b for m, b in (low, high))
        out.append((RAW, s) if low[0] == high[0] == RAW or len(wrapped) >= len(s) else (method, wrapped))
    return out


def unpack_planar(stored: list[tuple[int, bytes]], tables: list | None = None) -> list[bytes | CorruptSection]:
    planes = []
    for m, b in stored:
        if m == RAW:
            planes += [(RAW, b[0::2]), (RAW, b[1::2])]
            continue
        at = 0
        for _ in range(2):
            if at + 5 > len(b):
                planes.append((255, b""))
                continue
            mm, size = struct.unpack_from("<BI", b, at)
            planes.append((mm if at + 5 + size <= len(b) else 255, b[at + 5:at + 5 + size]))
            at += 5 + size
    back = unpack(planes, tables)
    out = []
    for k in range(len(stored)):
        low, high = back[2 * k], back[2 * k + 1]
        if isinstance(low, CorruptSection) or isinstance(high, CorruptSection) or not 0 <= len(low) - len(high) <= 1:
            out.append(CorruptSection("damaged plane"))
            continue
        whole = np.empty(len(low) + len(high), np.uint8)
        whole[0::2], whole[1::2] = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        out.append(whole.tobytes())
    return out


def zigzag(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.int64)
    return (v << 1) ^ (v >> 63)


def unzigzag(u: np.ndarray) -> np.ndarray:
    return (u >> 1) ^ -(u & 1)


def rice_cost(u: np.ndarray, k: int) -> int:
    return int(((u >> k) + 1 + k).sum())


def rice_encode(values: np.ndarray, choices: int = 5) -> bytes:
    """u32 count, u8 k, then for each value its quotient in ones, a zero and k low bits (lowest first)."""
    u = zigzag(values)
    k = min(range(choices), key=lambda c: (rice_cost(u, c), c))
    q = u >> k
    end = np.cumsum(q + 1 + k)
    bits = np.zeros(int(end[-1]) if len(u) else 0, np.uint8)
    start = end - (q + 1 + k)
    bits[np.repeat(start, q) + (np.arange(int(q.sum())) - np.repeat(np.cumsum(q) - q, q))] = 1
    for b in range(k):
        bits[start + q + 1 + b] = (u >> b) & 1
    return struct.pack("<IB", len(u), k) + np.packbits(bits, bitorder="little").tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    n, k = struct.unpack_from("<IB", blob)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=5), bitorder="little")
    zeros = np.append(np.flatnonzero(bits == 0), [len(bits)] * 1)
    out, at, z = np.empty(n, np.int64), 0, 0
    weight = 1 << np.arange(k)
    for i in range(n):
        z = int(np.searchsorted(zeros[z:], at)) + z
        stop = int(zeros[z])
        if stop + k >= len(bits) + (k == 0):
            raise CorruptSection("truncated Rice stream")
        out[i] = ((stop - at) << k) + int((bits[stop + 1:stop + 1 + k] * weight).sum())
        at = stop + 1 + k
    return unzigzag(out)


def learn_dictionary(hists: np.ndarray, k: int = 8, bits: int = TANS_BITS, rounds: int = 25) -> list[np.ndarray]:
    """At most k frequency tables for blocks with these byte counts: clusters by the bits that a block takes under a table.

    Each table is the pooled count of its blocks, in which every symbol keeps some mass, and each
    block belongs to the table that codes it shortest (the first of equals). The first table pools all blocks; the
    next start from the block that those there are code worst. Tables without blocks go.
    """
    h = np.asarray(hists, np.float64)
    h = h[h.sum(1) > 0] if h.ndim == 2 and h.shape[1] == 256 else np.zeros((0, 256))
    if not len(h):
        raise ValueError("there are no blocks to learn from")
    table = lambda rows: normalize((rows.sum(0) * 256 + max(1.0, rows.sum() / 16)).astype(np.int64), bits)
    cost = lambda f: h @ (bits - np.log2(f))
    tables = [table(h)]
    ideal = (h * np.log2(np.where(h > 0, h.sum(1, keepdims=True) / np.maximum(h, 1), 1))).sum(1)
    while len(tables) < k:
        worst = np.min([cost(f) for f in tables], axis=0) - ideal
        new = table(h[[int(worst.argmax())]])
        if any((new == f).all() for f in tables):
            break
        tables.append(new)
    own = None
    for _ in range(rounds):
        now = np.stack([cost(f) for f in tables]).argmin(0)
        if own is not None and (now == own).all():
            break
        own = now
        tables = [table(h[own == j]) for j in range(len(tables)) if (own == j).any()]
        own = np.unique(own, return_inverse=True)[1]
    return tables
