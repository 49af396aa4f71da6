"""Token ids as directly addressable codes (variable-length chunks with rank).

An id is cut into chunks, low bits first.  Level 0 holds the first chunk of
every id; a continuation bitmap says which ids go on, and a rank directory
(set bits before each 512-bit block) turns a position into its position one
level down.  Token ``i`` is therefore read by one probe per level, without
decoding anything before it.  Chunk widths are chosen per file by dynamic
programming over the bit lengths that occur.

File layout (little-endian): magic ``QMDAC1``, a 16-bit number of levels, the
widths, document and token counts, document ids with a validity byte each,
document offsets, then for every level its packed chunks, bitmap and ranks.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, get_file, keep_cache, put_file, saved, shared_path, slices

MAGIC = b"QMDAC1"
BLOCK = 512  # bits of a rank block
MAX_WIDTH = 16
RUN = 1 << 16  # values packed at a time, a multiple of 64


def chunk_widths(ids: np.ndarray) -> list[int]:
    """Widths with the least total bits: chunks plus one continuation bit each."""
    peak = int(ids.max(initial=0))
    top = max(1, peak.bit_length())
    if peak < 1 << 20:
        upto = np.cumsum(np.bincount(ids, minlength=1))
        longer = [len(ids) - int(upto[min((1 << b) - 1, peak)]) for b in range(33)]  # ids of more than b bits
    else:
        longer = [int(np.count_nonzero(ids >> np.uint32(b))) for b in range(32)] + [0]
    longer[0] = len(ids)
    best: list[tuple[int, list[int]]] = [(0, [])]
    for b in range(1, top + 1):
        options = []
        for a in range(max(0, b - MAX_WIDTH), b):
            bits = longer[a] * (b - a + (b < top))
            options.append((best[a][0] + bits, [*best[a][1], b - a]))
        best.append(min(options))
    return best[top][1]


def pack(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits one after another: 64 of them fill ``width`` words of 64 bits."""
    out = []
    for a in range(0, len(values), RUN):
        some = values[a : a + RUN].astype(np.uint64)
        v = np.pad(some, (0, -len(some) % 64)).reshape(-1, 64).T
        words = np.zeros((width, v.shape[1]), np.uint64)
        for k in range(64):
            word, shift = k * width >> 6, k * width & 63
            words[word] |= v[k] << np.uint64(shift)
            if shift + width > 64:
                words[word + 1] |= v[k] >> np.uint64(64 - shift)
        out.append(np.ascontiguousarray(words.T).astype("<u8").tobytes())
    return b"".join(out) + bytes(8)


def unpack(packed: np.ndarray, width: int, start: int, stop: int) -> np.ndarray:
    """Values start..stop-1."""
    out = [np.zeros(0, np.uint32)]
    first = start // 64 * 64
    for a in range(first, stop, RUN):
        groups = -(-(min(stop, a + RUN) - a) // 64)
        words = packed[a // 8 * width :][: groups * width * 8].view("<u8").reshape(groups, width).T
        v = np.empty((groups, 64), np.uint32)
        mask = np.uint64((1 << width) - 1)
        for k in range(64):
            word, shift = k * width >> 6, k * width & 63
            x = words[word] >> np.uint64(shift)
            if shift + width > 64:
                x |= words[word + 1] << np.uint64(64 - shift)
            v[:, k] = x & mask
        out.append(v.ravel())
    return np.concatenate(out)[start - first : stop - first]


def unpack_one(packed: np.ndarray, width: int, i: int) -> int:
    bit = i * width
    return int.from_bytes(packed[bit >> 3 : (bit + width + 7 >> 3)].tobytes(), "little") >> (bit & 7) & (1 << width) - 1


def encode_file(doc_ids: list, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    widths = chunk_widths(ids)
    head = [MAGIC, struct.pack("<H", len(widths)), bytes(widths), struct.pack("<qq", len(doc_ids), len(ids))]
    head.append(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    head.append(bytes(d is not None for d in doc_ids))
    head.append(np.asarray(offsets, "<i8").tobytes())
    rest = ids.astype(np.uint32)
    for k, width in enumerate(widths):
        chunks = pack(rest & np.uint32((1 << width) - 1), width)
        more = (rest >> np.uint32(width)) > 0
        last = k == len(widths) - 1
        bitmap = b"" if last else np.packbits(np.pad(more, (0, -len(more) % BLOCK)), bitorder="little").tobytes()
        rank = np.zeros(1, "<u4")
        if not last:
            rank = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64))]).astype("<u4") if len(more) else rank
        head.append(struct.pack("<qqq", len(chunks), len(bitmap), len(rank)))
        head += [chunks, bitmap, rank.tobytes()]
        rest = rest[more] >> np.uint32(width)
    return b"".join(head)


class TokenFile:
    """Random access to one encoded file."""

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        at = len(MAGIC)
        (levels,) = struct.unpack_from("<H", data, at)
        at += 2
        self.widths = list(data[at : at + levels])
        at += levels
        self.n_docs, self.n_tokens = struct.unpack_from("<qq", data, at)
        at += 16
        ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        valid = np.frombuffer(data, np.uint8, self.n_docs, at)
        at += self.n_docs
        self.doc_ids = [int(d) if ok else None for d, ok in zip(ids, valid, strict=True)]
        self.offsets = np.frombuffer(data, "<i8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in self.widths:
            a, b, c = struct.unpack_from("<qqq", data, at)
            at += 24
            chunks = np.frombuffer(data, np.uint8, a, at)
            bitmap = np.frombuffer(data, np.uint8, b, at + a)
            rank = np.frombuffer(data, "<u4", c, at + a + b)
            at += a + b + 4 * c
            self.levels.append((chunks, bitmap, rank))

    def __getitem__(self, i: int) -> int:
        """Token ``i``: one probe per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for width, (chunks, bitmap, rank) in zip(self.widths, self.levels, strict=True):
            value |= unpack_one(chunks, width, i) << shift
            shift += width
            if not len(bitmap) or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = np.unpackbits(bitmap[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(rank[block]) + int(before.sum())
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Tokens start..stop-1, all levels at once."""
        out = np.zeros(stop - start, np.uint32)
        place, shift = np.arange(stop - start), 0
        for width, (chunks, bitmap, rank) in zip(self.widths, self.levels, strict=True):
            if start >= stop:
                break
            out[place] |= unpack(chunks, width, start, stop) << np.uint32(shift)
            shift += width
            if not len(bitmap):
                break
            lo, hi = start // BLOCK, (stop - 1) // BLOCK + 1
            bits = np.unpackbits(bitmap[lo * BLOCK // 8 : hi * BLOCK // 8], bitorder="little")
            more = bits[start - lo * BLOCK : stop - lo * BLOCK].astype(bool)
            # those that go on are consecutive one level down
            place = place[more]
            start = int(rank[lo]) + int(bits[: start - lo * BLOCK].sum())
            stop = start + len(place)
        return out


_TOKENIZERS: dict[str, Encoder] = {}
keep_cache("tokens", _TOKENIZERS.clear)
CALL_BYTES = 1 << 18  # of texts encoded together
KNOWN = 1 << 18  # pieces whose ids are kept
LONGEST = 64  # bytes of a piece whose ids are kept
BASE = 0x9E3779B97F4A7C15  # of the polynomial hash; odd, so that it has an inverse

#: First bytes of UTF-8 characters that are no white space; where another follows a blank, the text isn't cut.
SAFE = np.zeros(256, bool)
SAFE[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


def _parts(text: str, size: int = CALL_BYTES) -> Iterator[str]:
    """A long text in parts that begin with a blank between non-blanks, where pieces begin too."""
    at = 0
    while len(text) - at > 2 * size:
        to = text.find(" ", at + size)
        while 0 < to < len(text) - 1 and (text[to - 1].isspace() or text[to + 1].isspace()):
            to = text.find(" ", to + 1)
        if not 0 < to < len(text) - 1:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def _byte_alphabet() -> np.ndarray:
    """Byte-level alphabet: printable bytes are themselves, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    out = np.arange(256, dtype="<u4")
    out[rest] = 256 + np.arange(len(rest))
    return out


BYTE_LEVEL = _byte_alphabet()

#: Kinds of bytes: letters that every version of Unicode counts as such (U+00C0 to U+024F as two bytes),
#: closing punctuation, line feed, blank, and all others.
LETTER, CLOSING, FEED, BLANK, OTHER = range(5)
KIND = np.full(256, OTHER, np.int8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
KIND[list(b".,;:!?")] = CLOSING
KIND[10], KIND[32] = FEED, BLANK
#: KIND pairs that may follow one another in a piece of words, closing punctuation and single line feeds.
FOLLOWS = np.zeros((5, 5), bool)
for _a, _b in ((LETTER, LETTER), (LETTER, CLOSING), (LETTER, FEED), (CLOSING, CLOSING), (CLOSING, FEED), (FEED, LETTER), (BLANK, LETTER)):
    FOLLOWS[_a, _b] = True


def simple_pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, str]:
    """Which of the pieces are words, closing punctuation and single line feeds, and their pre-tokens in byte-level letters, tabs between.

    In such a piece the pre-tokens are the words with the blank before them, the runs of punctuation and the line feeds.
    """
    own = np.repeat(np.arange(len(sizes)), sizes)
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(len(own))
    byte = data[at]
    kind = KIND[byte]
    first = np.append(True, own[1:] != own[:-1])
    last = np.append(first[1:], True)
    before, after = np.append(np.uint8(0), byte[:-1]), np.append(byte[1:], np.uint8(0))
    bad = (kind == OTHER) | (first & (kind != LETTER) & (kind != BLANK)) | (last & ((kind == FEED) | (kind == BLANK)))
    bad[1:] |= ~first[1:] & ~FOLLOWS[kind[:-1], kind[1:]]
    # signs of multiplication and division, and U+0250 to U+027F
    bad |= (before == 0xC3) & ((byte == 0x97) | (byte == 0xB7)) | (byte == 0xC9) & (after >= 0x90)
    good = np.ones(len(sizes), bool)
    good[own[bad]] = False
    keep = good[own]
    kind, byte, first = kind[keep], byte[keep], first[keep]
    border = first.copy()
    border[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK)
    out = np.full(len(byte) + int(border.sum()), 9, "<u4")
    out[np.arange(len(byte)) + np.cumsum(border)] = BYTE_LEVEL[byte]
    return good, out.tobytes().decode("utf-32-le")


class PieceTable:
    """Ids of pieces by the pieces' 64-bit hashes, looked up for whole batches at once.

    Open addressing at a load of one half at most.  When the table is full the
    pieces that were met again since they came stay, half of it at most.
    """

    def __init__(self, most: int) -> None:
        self.most, self.mask = most, np.uint64(4 * most - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(4 * self.most, np.uint64)
        self.start = np.zeros(4 * self.most, np.int32)
        self.count = np.zeros(4 * self.most, np.int32)
        self.again = np.zeros(4 * self.most, bool)
        self.n = self.used = 0
        self.flat = np.zeros(4 * self.most, np.uint32)  # ids, piece by piece

    def append(self, ids: np.ndarray) -> int:
        """Put ids behind the others; where they begin."""
        at = self.used
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[at : at + len(ids)] = ids
        self.used = at + len(ids)
        return at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 where they aren't there."""
        slot = (keys & self.mask).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, slot, -1)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            held, want = self.keys[slot[open_]], keys[open_]
            out[open_] = np.where(held == want, slot[open_], -1)
            open_ = open_[(held != want) & (held != 0)]
        return out

    def put(self, keys: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """Add distinct keys that aren't there."""
        slot = (keys & self.mask).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[at], self.start[at], self.count[at], self.again[at] = keys[won], start[won], count[won], False
            left = np.ones(len(keys), bool)
            left[won] = False
            open_ = open_[left[open_]]
            slot[open_] = (slot[open_] + 1) & int(self.mask)
        self.n += len(keys)

    def shrink(self) -> None:
        stay = np.flatnonzero(self.again & (self.keys != 0))[: self.most // 2]
        keys, start, count, flat = self.keys[stay], self.start[stay].astype(np.int64), self.count[stay].astype(np.int64), self.flat
        self.clear()
        at = self.append(flat[np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())])
        self.put(keys, at + np.cumsum(count) - count, count)


class Encoder:
    """A tokenizer with the ids of the pieces it met.

    Byte-level pre-tokenization binds a blank to the word behind it, so a text may
    be cut before each blank that a non-blank follows and its pieces be encoded
    apart.  Pieces are known by a 64-bit hash.  Those that the table lacks are
    encoded in one call, end to end, and the ids dealt to them by the tokens'
    lengths: words and punctuation by the model alone, others by the whole
    tokenizer.  Pieces above ``LONGEST`` bytes are encoded each time.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        pre, added = self.whole.pre_tokenizer, self.whole.get_added_tokens_decoder()
        #: Whether pieces may be encoded apart.
        self.apart = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.whole.normalizer is None
        self.apart = self.apart and not any(" " in t.content or t.lstrip or t.rstrip for t in added.values())
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        if self.apart:
            vocab = self.whole.get_vocab(with_added_tokens=True)
            self.lengths = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # bytes of each token
            for token, k in vocab.items():
                self.lengths[k] = len(token)
            for k, t in added.items():
                self.lengths[k] = len(t.content.encode())
            self.known = PieceTable(KNOWN)
            self.power = self.inverse = np.ones(1, np.uint64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hash of each piece, from sums over the whole batch; never 0."""
        if len(self.power) <= len(data):
            n = 2 * len(data) + 2
            self.power, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (BASE, pow(BASE, -1, 1 << 64)))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)])])
            h = (sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.maximum(h ^ (h >> np.uint64(31)), np.uint64(1))

    def deal(self, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray | None:
        """How many ids each piece has, from its bytes; None if a token lies across two of them."""
        reach, ends = np.cumsum(self.lengths[ids]), np.cumsum(sizes)
        cuts = np.searchsorted(reach, ends)
        if not len(reach) or cuts[-1] >= len(reach) or (reach[cuts] != ends).any():
            return None
        return np.diff(cuts + 1, prepend=0)

    def learn(self, buf: bytes, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces: where their ids begin in the table's, and how many each has."""
        start, count = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)

        def take(some: np.ndarray, ids: np.ndarray) -> None:
            each = self.deal(sizes[some], ids)
            if each is not None:
                count[some], start[some] = each, self.known.append(ids) + np.cumsum(each) - each

        def texts(some: np.ndarray) -> list[str]:
            return [buf[a : a + n].decode() for a, n in zip(starts[some].tolist(), sizes[some].tolist(), strict=True)]

        simple, letters = simple_pieces(data, starts, sizes)
        if simple.any():
            take(np.flatnonzero(simple), np.array(self.words.encode_batch_fast([letters], add_special_tokens=False)[0].ids, np.uint32))
        bound = np.flatnonzero((count < 0) & (sizes > 1) & (data[starts] == 32))
        bound = bound[SAFE[data[starts[bound] + 1]]]
        if len(bound):
            take(bound, self.ids(["".join(texts(bound))])[0])
        rest = np.flatnonzero(count < 0)
        for k, ids in zip(rest.tolist(), self.ids(texts(rest)), strict=True):
            start[k], count[k] = self.known.append(ids), len(ids)
        return start, count

    def batch(self, parts: list[bytes]) -> list[np.ndarray]:
        known = self.known
        if known.n > known.most:
            known.shrink()
        size = np.array([len(p) for p in parts])
        to = np.cumsum(size)
        buf = b"".join(parts)
        if not buf:
            return [np.zeros(0, np.uint32) for _ in parts]
        data = np.frombuffer(buf, np.uint8)
        begins = np.zeros(len(data), bool)
        begins[:-1] = (data[:-1] == 32) & SAFE[data[1:]]
        begins[(to - size)[size > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        keys = self.hashes(data, starts, ends)
        slot = known.find(keys)
        known.again[slot[slot >= 0]] = True
        start, count = known.start[slot].astype(np.int64), known.count[slot].astype(np.int64)
        lacking = np.flatnonzero(slot < 0)
        if len(lacking):
            # longer pieces are told apart by place, not by hash
            own = keys[lacking]
            long = ends[lacking] - starts[lacking] > LONGEST
            _, first, which = np.unique(np.where(long, lacking.astype(np.uint64), own | np.uint64(1 << 63)), return_index=True, return_inverse=True)
            at = lacking[first]
            s, c = self.learn(buf, data, starts[at], ends[at] - starts[at])
            start[lacking], count[lacking] = s[which], c[which]
            keep = ~long[first]
            new, where = np.unique(keys[at[keep]], return_index=True)
            known.put(new, s[keep][where], c[keep][where])
        total = np.cumsum(count)
        ids = known.flat[np.repeat(start - total + count, count) + np.arange(total[-1])]
        total = np.concatenate([[0], total])
        borders = total[np.searchsorted(starts, np.concatenate([[0], to]))]
        return [ids[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian uint32, as the tokenizer gives them."""
        if not self.apart:
            return [x.astype("<u4").tobytes() for x in self.ids(texts)]
        parts = [(k, part.encode()) for k, text in enumerate(texts) for part in _parts(text)]
        out: list[list[bytes]] = [[] for _ in texts]
        for a, b in slices([len(part) for _, part in parts], CALL_BYTES):
            for (k, _), ids in zip(parts[a:b], self.batch([part for _, part in parts[a:b]]), strict=True):
                out[k].append(ids.astype("<u4").tobytes())
        return [b"".join(x) for x in out]


def load_tokenizer(path: str) -> Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each whole text as little-endian uint32, as the tokenizer gives them."""
    return load_tokenizer(path).encode(texts)


MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, bytes long"


def write_tokens(docs: DataFrame, tokenizer: str, *, end_id: int, out_dir: str | None = None, file_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write token files in ascending order of the id.

    Returns the manifest, one row per file: part and seq give the order of the
    files, base the number of tokens in all files before.  Null texts are
    empty, null ids come first, rows that share an id are kept in the order of
    their texts' hash; a document is never split between files.  An empty table
    gives an empty manifest.
    """
    spark = docs.sparkSession
    out_dir = out_dir or shared_path(spark, "tokens")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("tokens")
        part, seq = TaskContext.get().partitionId(), 0
        attempt = TaskContext.get().taskAttemptId()
        doc_ids: list = []
        held: list[bytes] = []
        size = 0
        end = struct.pack("<I", end_id)

        def flush() -> pd.DataFrame:
            nonlocal seq, size
            offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in held])])
            ids = np.frombuffer(b"".join(held), "<u4")
            data = encode_file(doc_ids, offsets, ids)
            path = f"{out_dir}/part-{part:06d}-{seq:06d}-{attempt}.dac"
            put_file(path, data)
            row = pd.DataFrame([(part, seq, path, len(doc_ids), len(ids), len(data))], columns=["part", "seq", "path", "n_docs", "n_tokens", "bytes"])
            seq, size = seq + 1, 0
            doc_ids.clear()
            held.clear()
            return row

        for batch in batches:
            batch_ids = batch["__id"].tolist()
            texts = batch["__text"].tolist()
            for a, b in slices([len(t) for t in texts], CALL_BYTES):
                for doc_id, ids in zip(batch_ids[a:b], encode_texts(texts[a:b], tokenizer), strict=True):
                    doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= file_tokens:
                        yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    tie = F.xxhash64("__text")
    ordered = rows.repartitionByRange(F.col("__id").asc_nulls_first(), tie).sortWithinPartitions(F.col("__id").asc_nulls_first(), tie)
    # ids as strings keep nulls apart from numbers in pandas
    files = saved(ordered.select(F.col("__id").cast("string").alias("__id"), "__text").mapInPandas(write, MANIFEST), "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document from its file: doc_id, start, n_tokens, ids_crc32, path."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                f = TokenFile(get_file(path))
                ids = f.slice(0, f.n_tokens).astype("<u4")
                ends = f.offsets.tolist()
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(f.doc_ids, "Int64"),
                        "start": base + f.offsets[:-1],
                        "n_tokens": np.diff(f.offsets),
                        "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:])],
                        "path": path,
                    }
                )

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("path", "base").repartition(tasks, "path")  # a number of its own, so few files aren't read by one task
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def token_table(docs: DataFrame, tokenizer: str, *, end_id: int = 2, **options) -> DataFrame:
    """Write the token files and return what reading them back gives."""
    return read_tokens(write_tokens(docs, tokenizer, end_id=end_id, **options))
