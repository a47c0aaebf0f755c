"""SentencePiece encoding with original byte spans, and decoding, for BPE models of any character map.

Normalisation walks a text by the longest prefix that the model's compiled character map holds (a double-array trie of UTF-8 keys
with the offset of a replacement each) and notes for each normalised byte where it comes from; without a map each character stands
for itself. White space is written as U+2581 then, with one more before the text if the model says so. Merging takes the adjacent pair
of best score, the leftmost among equals; characters that no piece has become their bytes. Ends of pieces in normalised bytes,
looked up in the alignment, are spans of the original UTF-8.

A merge never goes over two characters that no piece holds side by side, so a text is the row of its segments: stretches between
such places (before white space, around characters outside all longer pieces). A task keeps the pieces of each different
segment it has met, up to HELD of them, and puts texts together by array lookups.

decode() gives the text of ids as the library does: control symbols are silent, runs of byte pieces are read as UTF-8 with
U+FFFD for each byte that isn't, the unknown id shows the model's surface for it, and the white space that encoding puts in front goes.

The model's bytes are broadcast (it's a file of fixed size; its path is a parameter).

Defined cases: null and empty texts have the begin and end ids alone, with empty spans; null doc_ids and repeated rows are rows of
their own; an empty table gives no rows; texts are encoded whole, however long (a stretch without any place to part it
is merged in memory as one); columns named as the added ones are replaced. Models with user-defined or unused pieces, white space
as suffix, a map for decoding, or of another kind than BPE raise ValueError."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilgram.llm import common

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Different segments (and their pieces) that a task keeps; characters from which a segment is parted between any two that no piece joins.
HELD, HELD_PIECES, LONG = 1 << 19, 1 << 22, 48
#: Rank of pairs that make no piece.
NEVER = 1 << 62
#: Segments that are merged side by side (in cache).
SIDE_BY_SIDE = 1 << 12
#: Fixed values of the model format: kinds of pieces, and numbers of fields.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
BPE = 2


def varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if data[i - 1] < 128:
            return value, i


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    i = 0
    while i < len(data):
        tag, i = varint(data, i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(data, i)
        else:
            n, i = varint(data, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class CharMap:
    """A compiled character map: 4 bytes of length, that many of trie units, then replacements that end with a zero byte."""

    def __init__(self, data: bytes):
        n = int.from_bytes(data[:4], "little")
        self.units, self.texts, self.known = np.frombuffer(data[4 : 4 + n], "<u4").tolist(), data[4 + n :], {}
        self.parts = not self.over_space()

    @staticmethod
    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def step(self, node: int, byte: int) -> int:
        """The node below, or 0. The root is node 0."""
        at = node ^ self.offset(self.units[node]) ^ byte
        return at if byte and at < len(self.units) and self.units[at] & 0x800000FF == byte else 0

    def over_space(self) -> bool:
        """Whether any key has a space after other bytes."""
        units = np.array(self.units, np.int64)
        below = np.arange(len(units)) ^ ((units >> 10) << ((units & (1 << 9)) >> 6))
        level = np.zeros(1, np.int64)
        while True:
            to = (below[level][:, None] ^ np.arange(1, 256)[None, :]).ravel()
            label = np.tile(np.arange(1, 256), len(level))
            fits = to < len(units)
            to, label = to[fits], label[fits]
            hit = (units[to] & 0x800000FF) == label
            if level[0] and (label[hit] == 32).any():
                return True
            level = np.unique(to[hit])
            if not len(level):
                return False

    def prefix(self, data: bytes, i: int) -> tuple[bytes, int]:
        """What stands for the longest known prefix of data[i:], and the prefix's length: a character as it is if none is known."""
        node, best, n = 0, None, 0
        for j in range(i, len(data)):
            node = self.step(node, data[j])
            if not node:
                break
            if self.units[node] >> 8 & 1:
                best, n = self.units[node ^ self.offset(self.units[node])] & 0x7FFFFFFF, j + 1 - i
        if best is None:
            n = 1 + sum(data[i] >= x for x in (0xC0, 0xE0, 0xF0))
            return data[i : i + n], n
        return self.texts[best : self.texts.index(b"\0", best)], n

    def mapped(self, data: bytes) -> tuple[bytes, list[int], list[int]]:
        """Normalised bytes; where in data each comes from; and where the prefixes of data begin in the normalised bytes."""
        if (got := self.known.get(data)) is not None:
            return got
        out, source, begins, i = bytearray(), [], [], 0
        while i < len(data):
            text, n = self.prefix(data, i)
            begins.append(len(out))
            out += text
            source += [i] * len(text)
            i += n
        if len(self.known) >= HELD:
            self.known.clear()
        got = bytes(out), source, begins
        if len(data) <= LONG:
            self.known[data] = got
        return got


class Segments(dict):
    """Number of each segment met; its pieces lie in ids and sizes (normalised bytes of each) from start to end."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.ids, self.sizes, self.ends = model, array("i"), array("i"), array("q", [0])

    def __missing__(self, segment: str) -> int:
        parts = self.model.parted(segment) if len(segment) > LONG else [segment]
        numbers = [self[p] for p in parts] if len(parts) > 1 else []  # before this one's own pieces are put down
        for ids, sizes in map(self.pieces_at, numbers) if numbers else [self.model.pieces_of(segment)]:
            self.ids.extend(ids)
            self.sizes.extend(sizes)
        self[segment] = n = len(self.ends) - 1
        self.ends.append(len(self.ids))
        return n

    def fill(self, segments: list[str]) -> None:
        """Short segments that aren't here yet, merged side by side."""
        known, ids, sizes, counts = self.model.merged_together(segments)
        self.ids.frombytes(ids.astype(np.int32).tobytes())
        self.sizes.frombytes(sizes.astype(np.int32).tobytes())
        first = len(self.ends) - 1
        self.ends.frombytes((self.ends[-1] + np.cumsum(counts)).astype(np.int64).tobytes())
        self.update(zip(known, range(first, first + len(known)), strict=True))

    def pieces_at(self, n: int) -> tuple[array, array]:
        a, b = self.ends[n], self.ends[n + 1]
        return self.ids[a:b], self.sizes[a:b]


class Model:
    def __init__(self, data: bytes):
        self.texts, self.kinds, self.ids, self.bytes, score = [], [], {}, {}, {}
        trainer = normalizer = denormalizer = b""
        for number, value in fields(data):
            if number == PIECES:
                f = dict(fields(value))
                text, kind = f.get(1, b"").decode(), f.get(3, NORMAL)
                if kind == NORMAL:
                    score[text], self.ids[text] = struct.unpack("<f", f.get(2, bytes(4)))[0], len(self.texts)
                if kind == BYTE:
                    self.bytes[int(text[3:-1], 16)] = len(self.texts)
                self.texts.append(text)
                self.kinds.append(kind)
            trainer, normalizer, denormalizer = (value if number == n else x for n, x in ((TRAINER, trainer), (NORMALIZER, normalizer), (DENORMALIZER, denormalizer)))
        t, n = dict(fields(trainer)), dict(fields(normalizer))
        if t.get(3, 1) != BPE or t.get(24, 0) or {USER_DEFINED, UNUSED} & set(self.kinds) or dict(fields(denormalizer)).get(2):
            raise ValueError("only BPE models without user-defined or unused pieces, suffixed white space or a map for decoding are known")
        places = {x: i for i, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank, self.sizes = {text: places[x] for text, x in score.items()}, [len(x.encode()) for x in self.texts]
        self.map = CharMap(n[2]) if n.get(2) else None
        self.dummy, self.squeeze, self.escape = (bool(n.get(k, 1)) for k in (3, 4, 5))
        self.space = SPACE.encode() if self.escape else b" "
        named = {text: i for i, text in enumerate(self.texts)}
        self.unknown, self.begin, self.end = self.kinds.index(UNKNOWN), named.get(t.get(46, b"<s>").decode(), -1), named.get(t.get(47, b"</s>").decode(), -1)
        self.fallback, self.show_unknown = bool(t.get(35, 0)), t.get(44, " ⁇ ".encode())
        several = [x for x in self.ids if len(x) > 1]
        self.pairs = {x[i : i + 2] for x in several for i in range(len(x) - 1)}
        inner = "".join(sorted({c for x in several for c in x} - {SPACE}))
        parted = not any(pair[1] == SPACE != pair[0] for pair in self.pairs)
        self.segment = re.compile(f"{SPACE}+[{re.escape(inner)}]*|[{re.escape(inner)}]+|[^{SPACE}{re.escape(inner)}]" if parted and inner else "(?s:.+)")
        self.shown = [self.surface(i) for i in range(len(self.texts))]
        self.silent = np.array([k in (CONTROL, UNKNOWN) for k in self.kinds])
        self.size_of = np.array(self.sizes, np.int64)
        self.pair_table()
        self.met = Segments(self)

    # normalisation

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The text as pieces see it, and for each of its bytes (and its end) the place in the text's UTF-8."""
        data = text.encode("utf-8", "replace")
        if not data:
            return "", np.zeros(1, np.int64)
        if self.map is None and not self.squeeze:
            wide = np.ones(len(data), np.int64)
            wide[np.frombuffer(data, np.uint8) == 32] = len(self.space)
            lead = len(self.space) if self.dummy else 0
            align = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(data)), wide), [len(data)]])
            return (SPACE * self.dummy + text.replace(" ", SPACE)) if self.escape else " " * self.dummy + text, align
        return self.walked(data)

    def walked(self, data: bytes) -> tuple[str, np.ndarray]:
        out, source, place = bytearray(), [], 0
        spaced = begun = False
        # Words apart, so that each different one is walked once; whole, if the map has keys that go over a space.
        for chunk in re.findall(b"\x20|[^\x20]+", data) if self.map is None or self.map.parts else [data]:
            text, at, begins = self.map.mapped(chunk) if self.map else (chunk, range(len(chunk)), range(len(chunk)))
            if b" " not in text and text:
                if not begun and self.dummy:
                    self.put(out, source, b" ", place)
                begun, spaced = True, False
                out += text
                source += [place + x for x in at]
            elif text:
                for a, b in zip(begins, [*begins[1:], len(text)], strict=True):
                    part, here = text[a:b], place + at[a] if b > a else 0
                    if self.squeeze and (spaced or not begun):
                        part = part.lstrip(b" ") if spaced or begun or part != b" " else b""
                    if not part:
                        continue
                    if not begun and self.dummy:
                        self.put(out, source, b" ", here)
                        if self.squeeze:
                            part = part.lstrip(b" ")
                    begun = True
                    self.put(out, source, part, here)
                    if part:
                        spaced = self.squeeze and part.endswith(b" ")
            place += len(chunk)
        end = place
        while self.squeeze and out.endswith(self.space):
            end = source[len(out) - len(self.space)]
            del out[-len(self.space) :], source[-len(self.space) :]
        return out.decode(), np.array([*source, end], np.int64)

    def put(self, out: bytearray, source: list[int], part: bytes, here: int) -> None:
        part = part.replace(b" ", self.space)
        out += part
        source += [here] * len(part)

    # merging

    def parted(self, segment: str) -> list[str]:
        cuts = [0, *[i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.pairs], len(segment)]
        return [segment[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def pair_table(self) -> None:
        """Ranks and results of all pairs of symbols that make a piece, by code; a number for each character in pieces."""
        n = len(self.texts)
        chars = {c for x in self.ids for c in x}
        symbol = self.ids | {c: n + k for k, c in enumerate(sorted(chars - self.ids.keys()))}  # these have no piece of their own
        self.char_ids = np.full(0x110000, -2, np.int32)
        for c in chars:
            self.char_ids[ord(c)] = symbol[c]
        pairs = sorted((symbol[x[:k]] << 32 | symbol[x[k:]], self.rank[x], i) for x, i in self.ids.items() for k in range(1, len(x)) if x[:k] in symbol and x[k:] in symbol)
        self.pair_codes, self.pair_ranks, self.pair_ids = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ([-1], [NEVER], [0])))

    def pair_at(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair in the table, and its rank."""
        code = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return at, np.where(self.pair_codes[at] == code, self.pair_ranks[at], NEVER)

    def merged_together(self, segments: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Segments in another order, the ids and sizes of their pieces in a row, and how many each has."""
        segments = sorted(segments, key=len)
        ids, counts = [], []
        for a in range(0, len(segments), SIDE_BY_SIDE):
            some = segments[a : a + SIDE_BY_SIDE]
            size = np.fromiter(map(len, some), np.int64, len(some))
            table = np.full((len(some), int(size[-1]) + 1), -1, np.int32)
            inside = np.arange(table.shape[1]) < size[:, None]
            table[inside] = self.char_ids[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)]
            size = self.merge_rows(table, size)
            ids.append(table[np.arange(table.shape[1]) < size[:, None]])
            counts.append(size)
        flat, n = np.concatenate(ids), np.concatenate(counts)
        sizes = self.size_of[np.clip(flat, 0, None)]
        lost = (flat < 0) | (flat >= len(self.texts))
        if not lost.any():
            return segments, flat, sizes, n
        # Segments with characters that have no piece are encoded alone, and put in place.
        ends, parts, at = np.cumsum(n), [], 0
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(lost), "right")).tolist():
            begin, end, own = int(ends[k] - n[k]), int(ends[k]), self.pieces_of(segments[k])
            parts += [(flat[at:begin], sizes[at:begin]), own]
            n[k], at = len(own[0]), end
        parts.append((flat[at:], sizes[at:]))
        flat, sizes = (np.concatenate([np.asarray(p[i], np.int64) for p in parts]) for i in (0, 1))
        return segments, flat, sizes, n

    def merge_rows(self, table: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Merges each row of symbols (padded by -1) in place until no pair makes a piece; how many symbols are left."""
        row, size = np.arange(len(table)), size.copy()
        ids, (_, ranks) = table, self.pair_at(table[:, :-1], table[:, 1:])
        column = np.arange(ids.shape[1])
        while len(row):
            at = ranks.argmin(1)
            here = np.arange(len(row))
            going = ranks[here, at] < NEVER
            if not going.all():
                table[row[~going]] = ids[~going]
                row, ids, ranks, at = row[going], ids[going], ranks[going], at[going]
                here = np.arange(len(row))
                if not len(row):
                    break
            pair, _ = self.pair_at(ids[here, at], ids[here, at + 1])
            behind = column[None, :-1] > at[:, None]
            ids = np.concatenate([np.where(behind, ids[:, 1:], ids[:, :-1]), np.full((len(row), 1), -1, ids.dtype)], axis=1)
            ids[here, at] = self.pair_ids[pair]
            ranks = np.concatenate([np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1]), np.full((len(row), 1), NEVER)], axis=1)
            ranks[here, at] = self.pair_at(ids[here, at], ids[here, at + 1])[1]
            left = np.flatnonzero(at)
            ranks[left, at[left] - 1] = self.pair_at(ids[left, at[left] - 1], ids[left, at[left]])[1]
            size[row] -= 1
        return size

    def merged(self, segment: str) -> list[str]:
        """The best pair's rank is found among all of a short segment's; a long one keeps its pairs in a heap."""
        if len(segment) > LONG:
            return self.merged_by_heap(segment)
        parts, rank = list(segment), self.rank.get
        ranks = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
        return parts

    def merged_by_heap(self, segment: str) -> list[str]:
        parts, left, right, heap = list(segment), list(range(-1, len(segment) - 1)), list(range(1, len(segment) + 1)), []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (r := self.rank.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], right[i] = both, None, right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def pieces_of(self, segment: str) -> tuple[list[int], list[int]]:
        parts = self.merged(segment)
        found = list(map(self.ids.get, parts))
        if None not in found:
            return found, list(map(self.sizes.__getitem__, found))
        ids, sizes = [], []
        for piece, one in zip(parts, found, strict=True):
            raw = piece.encode("utf-8", "replace")
            more = [one] if one is not None else [self.bytes[b] for b in raw] if self.fallback else [self.unknown]
            ids += more
            sizes += [0] * (len(more) - 1) + [len(raw)]  # of a character's bytes the last one stands for it
        return ids, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts in a row, with begin and end ids; byte where each begins and ends; ends of the texts in ids."""
        if len(self.met) > HELD or len(self.met.ids) > HELD_PIECES:
            self.met = Segments(self)
        norms = [self.normalised(t) for t in texts]
        rows = [self.segment.findall(n) for n, _ in norms]
        if new := [s for s in set().union(*rows).difference(self.met) if len(s) <= LONG]:
            self.met.fill(new)
        number = np.fromiter(map(self.met.__getitem__, chain.from_iterable(rows)), np.int64, sum(map(len, rows)))
        ends, ids, sizes = np.array(self.met.ends), np.array(self.met.ids, np.int32), np.array(self.met.sizes, np.int64)
        start, n = ends[number], ends[number + 1] - ends[number]
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        of_text = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)])
        text_ends = np.cumsum(of_text + 2)
        inner = np.ones(int(text_ends[-1]) if len(texts) else 0, bool)
        inner[text_ends - 1] = inner[text_ends - 2 - of_text] = False
        out, size = np.full(len(inner), self.end, np.int32), np.zeros(len(inner), np.int64)
        out[text_ends - 2 - of_text] = self.begin
        out[inner], size[inner] = ids[at], sizes[at]
        if not self.fallback and len(out):  # a row of unknown characters is one piece
            keep = np.concatenate([[True], (out[1:] != self.unknown) | (out[:-1] != self.unknown)])
            out, size, text_ends = out[keep], np.add.reduceat(size, np.flatnonzero(keep)), np.cumsum(keep)[text_ends - 1]
            of_text = np.diff(text_ends, prepend=0) - 2
        aligns = [a for _, a in norms]
        base = np.cumsum([0, *map(len, aligns)])[:-1]
        done = np.cumsum(size)
        first = text_ends - 2 - of_text
        shift = np.repeat(base - (done[first] if len(texts) else 0), of_text + 2)
        align = np.concatenate(aligns) if aligns else np.zeros(0, np.int64)
        return out, align[done - size + shift], align[done + shift], text_ends

    # decoding

    def surface(self, i: int) -> bytes:
        kind, text = self.kinds[i], self.texts[i]
        if kind == BYTE:
            return bytes([int(text[3:-1], 16)])
        return b"" if kind == CONTROL else self.show_unknown if kind == UNKNOWN else text.replace(SPACE, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        kept = np.flatnonzero(~self.silent[ids])
        if len(kept) and kept[-1] - kept[0] + 1 == len(kept) and len(kept) + self.silent[ids].sum() == len(ids) and not (ids == self.unknown).any() and not self.squeeze:
            inner = ids[kept].tolist()
            raw = b"".join(map(self.shown.__getitem__, inner))
            try:
                return raw.decode()[self.dummy and self.kinds[inner[0]] != BYTE and raw[:1] == b" " :]
            except UnicodeDecodeError:
                pass
        out, run, leading = [], bytearray(), self.dummy or self.squeeze
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.kinds[i] == BYTE:
                run += self.shown[i]
                continue
            if run:
                out.append(lenient(bytes(run)))
                run.clear()
            leading = leading and not any(out)
            if i >= 0:
                text = self.shown[i].decode()
                if leading and self.kinds[i] not in (CONTROL, UNKNOWN) and text[:1] == " ":
                    text, leading = text[1:], self.squeeze
                out.append(text)
        return "".join(out)


def lenient(run: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that begins no character."""
    out, i = [], 0
    while i < len(run):
        for n in range(1, 5):
            try:
                out.append(run[i : i + n].decode())
                break
            except UnicodeDecodeError:
                n = 0
        if not n:
            out.append("�")
        i += n or 1
    return "".join(out)


_loaded: dict[bytes, Model] = {}


def loaded(data: bytes) -> Model:
    """The model of these bytes, built once a process."""
    key = hashlib.sha256(data).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(data)
    return _loaded[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def listed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids, begins and ends (arrays of int; bytes of the text's UTF-8)."""
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    docs = docs.drop("ids", "begins", "ends")
    text = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(sent.value)
        for b in batches:
            ids, begins, ends, text_ends = model.encode([t or "" for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, *[listed(x, text_ends) for x in (ids, begins, ends)]], names=[*b.schema.names, "ids", "begins", "ends"])

    fields_ = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return common.in_arrow(docs, work, f"{fields_}, ids array<int>, begins array<int>, ends array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """rows (ids) with the text that the ids stand for in decoded; null ids give null."""
    sent = rows.sparkSession.sparkContext.broadcast(model_bytes(path))
    rows = rows.drop("decoded")
    at = rows.columns.index("ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(sent.value)
        for b in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return common.in_arrow(rows, work, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (begin and end of each id, as the ids): encoding and decoding in one
    pass, so that the arrays needn't leave the task."""
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(sent.value)
        for b in batches:
            ids, begins, ends, text_ends = model.encode([t or "" for t in b.column(1).to_pylist()])
            spans = np.stack([begins, ends], axis=1).astype("<u4")
            cuts = list(zip([0, *text_ends[:-1].tolist()], text_ends.tolist(), strict=True)) if b.num_rows else []
            sha = lambda data: hashlib.sha256(data).hexdigest()
            columns = [[y - x for x, y in cuts], [sha(ids[x:y].astype("<u4").tobytes()) for x, y in cuts], [sha(model.decode(ids[x:y]).encode()) for x, y in cuts], [sha(spans[x:y].tobytes()) for x, y in cuts]]
            yield pa.record_batch([b.column(0), *map(pa.array, columns, [pa.int64(), *[pa.string()] * 3])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return common.in_arrow(docs.select("doc_id", "text"), work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
