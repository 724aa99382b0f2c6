"""Brute-force versions of the operators, and a small corpus with awkward rows."""

from __future__ import annotations

import base64
import random
import re
import struct
import zlib
from hashlib import sha256

WORDS = [a + b for a in ("ba", "ko", "li", "mu", "ne", "sa", "to", "vi") for b in ("ran", "del", "sto", "ki", "mer", "pu")]


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared passages, nulls and ties."""
    rng = random.Random(5)

    def prose(n: int) -> str:
        return " ".join(f"{rng.choice(WORDS)}{rng.choice(WORDS)}" for _ in range(n))

    base = [prose(rng.randrange(3, 160)) for _ in range(40)]
    texts: list[str | None] = [*base, *base[:6], base[0], base[0]]
    for t in base[6:14]:  # near copies: one word changed
        words = t.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    chain = prose(80).split()  # each near its neighbours only
    for i in range(6):
        texts.append(" ".join([*[f"new{i}x{j}" for j in range(i * 2)], *chain[i * 2 :]]))
    passage = prose(75)
    texts += [f"{prose(20)} {passage} {prose(12)}" for _ in range(5)]
    texts += [None, "", "   \t\n", "One two", "one TWO", "a b c d e", "É é Ü ß", "x" * 900, "x" * 900, "ab" * 700, prose(4000), "1 2 3", "..."]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None, "c")[i % 4], len(t) if t else None) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, base[2], None, None, None), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words5(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text: str | None) -> set[tuple]:
    w = words5(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return [(r[0], len(sets[i]), c := (least.get(top(i)) if sets[i] else r[0]), r[0] is not None and r[0] == c) for i, r in enumerate(rows)]


def repeated_bytes(rows: list[tuple], length: int = 400) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    data = [(r[1] or "").encode() for r in rows]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for r, d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((r[0], len(d), sum(gone), spans, sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def contamination(rows: list[tuple], items: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""

    def words(text: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins = []
    for item, text in items:
        w = words(text)
        wins += [(item, w[i : i + 10]) for i in range(max(1, len(w) - 9))] if w else []
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    if item is not None:
                        found.add(str(item))
        out.append((r[0], len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def token_rows(rows: list[tuple], tokenizer) -> list[tuple]:
    """(doc_id, start, n_tokens, ids_crc32); rows in ascending doc_id order, nulls last."""
    out, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        out.append((r[0], at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


SECRETS = (("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1), ("access", r"AKIA[A-Z0-9]+", 16, 0), ("hex", r"[0-9a-f]+", 32, 0))


def base_secrets(text: str) -> list[tuple]:
    """(start, kind, end)."""
    out = []
    for kind, (_, pattern, least, group) in enumerate(SECRETS):
        out += [(x.start(), kind, x.end()) for x in re.finditer(pattern, text, re.ASCII) if len(x[group]) >= least]
    return sorted(out)


def all_secrets(text: str) -> list[tuple]:
    """(start, kind, end) in the text and in all layers, every layer as a list of (character, start, end)."""
    found, work, seen = set(), [[(c, i, i + 1) for i, c in enumerate(text)]], set()
    while work:
        layer = work.pop()
        own = "".join(x[0] for x in layer)
        if not layer or (own, layer[0][1], layer[-1][2]) in seen:
            continue
        seen.add((own, layer[0][1], layer[-1][2]))
        found |= {(layer[a][1], k, layer[b - 1][2]) for a, k, b in base_secrets(own)}
        work += layers_below(layer, own)
    return sorted(found)


def layers_below(layer: list[tuple], text: str) -> list[list[tuple]]:
    out = []
    for run in re.finditer(r"\S+", text):
        own = layer[run.start() : run.end()]
        if re.search("%[0-9A-Fa-f]{2}", run[0]):
            got, i = [], 0
            while i < len(own):
                if re.match("%[0-9A-Fa-f]{2}", run[0][i:]):
                    got.append((int(run[0][i + 1 : i + 3], 16), own[i][1], own[i + 2][2]))
                    i += 3
                else:
                    got += [(b, *own[i][1:]) for b in own[i][0].encode("utf-8", "surrogateescape")]
                    i += 1
            out += from_bytes(got)
        if re.search(r"\\(u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})", run[0]):
            chars, raw, i = [], [], 0
            while i < len(own):
                m = re.match(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))", run[0][i:])
                n = m.end() if m else 1
                c, span = (chr(int(m[1] or m[2], 16)) if m else own[i][0]), (own[i][1], own[i + n - 1][2])
                if chars and "\ud800" <= chars[-1][0] <= "\udbff" and "\udc00" <= c <= "\udfff":
                    chars[-1] = ((chars[-1][0] + c).encode("utf-16", "surrogatepass").decode("utf-16"), chars[-1][1], span[1])
                    raw[-4:] = [(b, chars[-1][1], span[1]) for b in chars[-1][0].encode()]
                else:
                    chars.append((c, *span))
                    raw += [(b, *span) for b in ([ord(c)] if m and m[2] else c.encode("utf-8", "surrogateescape" if "\udc80" <= c <= "\udcff" else "surrogatepass"))]
                i += n
            out.append(chars)
            if re.search(r"\\x[89A-Fa-f]", run[0]):
                out += from_bytes(raw)
    for m in [*re.finditer("[A-Za-z0-9+/_-]{16,}", text), *re.finditer(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{4,})+", text)]:
        own = [x for x in layer[m.start() : m.end()] if x[0] not in "\r\n \t"]
        for shift in range(4):
            part = own[shift:]
            if len(part) % 4 == 1:
                part = part[:-1]
            data = base64.b64decode("".join(x[0] for x in part).replace("-", "+").replace("_", "/") + "=" * (-len(part) % 4))
            out += from_bytes([(b, own[shift + i // 3 * 4 + i % 3][1], own[min(shift + i // 3 * 4 + i % 3 + 1, len(own) - 1)][2]) for i, b in enumerate(data)], (layer[m.start()][1], layer[m.end() - 1][2]))
    return out


def from_bytes(data: list[tuple], whole: tuple | None = None) -> list[list[tuple]]:
    """The text of (byte, start, end), and of the streams in it."""
    raw = bytes(x[0] for x in data)
    whole = whole or (data[0][1], data[-1][2])
    layer, at = [], 0
    for c in raw.decode("utf-8", "surrogateescape"):
        n = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
        layer.append((c, data[at][1], data[at + n - 1][2]))
        at += n
    return [layer, *[[(c, *whole) for c in t] for t in streams(raw)]]


def streams(raw: bytes) -> list[str]:
    out, done = [], 0
    for i in range(len(raw)):
        usual = raw[i : i + 3] == b"\x1f\x8b\x08" or raw[i : i + 2] in (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
        if i < done or not (usual or (i == 0 and starts_stream(raw))):
            continue
        got, at = b"", i
        while starts_stream(raw[at:]):
            d = zlib.decompressobj(47)
            try:
                for k in range(at, len(raw)):  # byte by byte: all there is before the damage
                    got += d.decompress(raw[k : k + 1])
                    if d.eof:
                        break
            except zlib.error:
                break
            if not d.eof:
                at = len(raw)
                break
            at = k + 1
        done = max(done, at)
        if got:
            out += [got.decode("utf-8", "surrogateescape"), *streams(got)]
    return out


def starts_stream(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0)


def read_container(data: bytes) -> list[dict]:
    """Tracks of a plain ISO media file, unit by unit: codec, timescale, duration, units' and keyframes' (offset, bytes)."""

    def boxes(begin: int, end: int) -> list[tuple]:
        out = []
        while begin < end:
            size, kind = int.from_bytes(data[begin : begin + 4], "big"), data[begin + 4 : begin + 8]
            head = 8
            if size == 1:
                size, head = int.from_bytes(data[begin + 8 : begin + 16], "big"), 16
            out.append((kind, begin + head, begin + size if size else end))
            begin = out[-1][2]
        return out

    def find(box: tuple, *path: bytes) -> list[tuple]:
        got = [box]
        for kind in path:
            got = [x for b in got for x in boxes(b[1], b[2]) if x[0] == kind]
        return got

    word = lambda at, n=4: int.from_bytes(data[at : at + n], "big")
    out = []
    for trak in find((b"", 0, len(data)), b"moov", b"trak"):
        stbl = {k: (a, e) for k, a, e in boxes(*find(trak, b"mdia", b"minf", b"stbl")[0][1:])}
        at = find(trak, b"mdia", b"mdhd")[0][1]
        scale, duration = (word(at + 20), word(at + 24, 8)) if data[at] else (word(at + 12), word(at + 16))
        at = stbl[b"stsz"][0]
        sizes = [word(at + 4) or word(at + 12 + 4 * i) for i in range(word(at + 8))]
        at, wide = (stbl[b"stco"][0], 4) if b"stco" in stbl else (stbl[b"co64"][0], 8)
        offsets = [word(at + 8 + wide * i, wide) for i in range(word(at + 4))]
        at = stbl[b"stsc"][0]
        runs = [(word(at + 8 + 12 * i), word(at + 12 + 12 * i)) for i in range(word(at + 4))]
        units = []
        for c, offset in enumerate(offsets, 1):
            for _ in range([per for first, per in runs if first <= c][-1]):
                if len(units) < len(sizes):
                    units.append((offset, sizes[len(units)]))
                    offset += units[-1][1]
        at = stbl[b"stss"][0] if b"stss" in stbl else None
        sync = [word(at + 8 + 4 * i) for i in range(word(at + 4))] if at else None
        out.append({"codec": data[stbl[b"stsd"][0] + 12 : stbl[b"stsd"][0] + 16].decode(), "timescale": scale, "duration": duration, "units": units, "keyframes": sync and [units[s - 1] for s in sync]})
    return out
