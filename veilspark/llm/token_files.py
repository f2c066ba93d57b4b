"""Token ids in a compact file: a context-mixing arithmetic coder in independent blocks.

Documents are tokenized, closed by an end id, put in ascending order of doc_id (null first, then by text) and
their ids written one after the other, in shards of ranges of doc_id. A shard is a Parquet file of blocks, written
by Spark's committer, so a lost executor's blocks are written anew. A block holds up to `BLOCK` ids and depends on
no other:

    magic b"VTB4" | ids u32 | vocabulary u32 | crc32 of the ids, begun at the vocabulary, as u32 | bytes coded u32 |
    crc32 of these u32 | coded: the table (distinct ids u16, bytes u16, Rice parameter u8, bits of gaps and counts), then
    the choices of an order and the ids of order 0, each as states of coders, their numbers of words and the words

Numbers are little-endian. Beside it stand the block's place in the shard and its pieces of documents. A damaged
block raises, and no other is lost.

Coding. Three predictions drive an arithmetic coder (range variant of asymmetric numeral systems): order 2, the id that
last followed the last two, and order 1, the id that last followed the last one, get parts of 2^24 by how often in a row
such a guess was right; order 0 has the rest. An id takes order 2's part if its guess is right, else order 1's, else order
0's and then a part of 2^12 by how often order 0 has it in the block, which is written before. Both kinds of choices are
coded side by side in numpy for hundreds of blocks, `TURN` and `SPAN` ids by a coder, in whole numbers and exact
quotients, so every machine decodes what any other encoded.

Defined results: null text is empty and has its end id only; repeated rows are documents of their own; a text of
any length is whole, its ids span blocks; an empty table makes an empty file; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .common import small

MAGIC = b"VTB4"
BLOCK = 4096  # at most _SLOTS
TURN = 1024  # ids whose choices of an order one coder takes
SPAN = 512  # ids of order 0 that one coder takes
FEW = 32  # blocks whose tables are made at once
LANES = 1024  # blocks coded side by side, at most
MOST = 1 << 22  # ids of a vocabulary
END = 2
_HEAD = 24  # bytes
_SLOTS = 4096  # places in a block's table, at most
_PAIRS = 2048  # slots of order 2
_NONE = _SLOTS - 1 << 4  # no guess: a table as long has no id twice
_TOTAL, _LOW = 1 << 24, 1 << 31  # what probabilities are parts of; the least state of a coder
# Parts of _TOTAL (order 1: of what order 2 leaves) for a guess, by 1 + how often in a row it was right. What they leave is over BLOCK parts wide.
_ODDS = np.array([[0, 20, 45, 58, 67, 73, 77, 81, 84, 87, 89, 91, 93, 94, 96, 99.4], [0, 9, 30, 43, 52, 60, 66, 71, 76, 80, 83, 86, 89, 91, 93, 94]])
_ODDS = (_ODDS / 100 * _TOTAL).astype(np.int64)
_PIECES = 300_000  # tokenized pieces that a worker remembers
_CHARS = 1 << 20  # of texts split side by side
_FILE = "shard int, block int, first bigint, n int, docs array<struct<ordinal:bigint,doc_id:bigint,n:int,opens:boolean>>, body binary"

# Letters, numbers and white space up to U+024F, for the tokenizer's published split pattern:
#   's|'t|'re|'ve|'m|'ll|'d| ?[letters]+| ?[numbers]+| ?[others]+|[space]+(?![^space])|[space]+
# Texts with other characters are not split here.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_EVERY = "".join(map(chr, range(0x250)))
_KINDS = np.full(0x250, 3, np.uint8)
for _kind, _set in enumerate((_S, _L, _N)):
    _KINDS[[ord(c) for c in re.findall(f"[{_set}]", _EVERY)]] = _kind
# The letters that stand for bytes in the tokenizer's file: those that print are themselves, the others follow from U+0100.
_LETTERS = np.arange(256, dtype="<u2")
_hidden = np.array([*range(33), *range(127, 161), 173])
_LETTERS[_hidden] = 256 + np.arange(len(_hidden))
_LINE = chr(_LETTERS[10])


@lru_cache(1)
def tokenizer_of(path: str) -> Ids:
    """One for all tasks of a worker, with what it remembers."""
    return Ids(path)


class Ids:
    """Whole texts to ids. Pieces between which the tokenizer never merges are tokenized once and remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.joined = Tokenizer(self.tokenizer.model)  # the same for pieces in the tokenizer's own letters, spaces between them
        self.joined.pre_tokenizer = WhitespaceSplit()
        self.leads = np.zeros(self.vocabulary, bool)  # ids that begin with a space
        self.leads[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(chr(_LETTERS[32]))]] = True
        self.at: dict[bytes, int] = {}
        self.first, self.flat, self.uses = np.zeros(1024, np.int64), np.zeros(4096, np.int32), np.zeros(1024, np.uint8)  # with room for more

    def _forget(self) -> None:
        """Up to half of the pieces stay: those used more than once since the last time."""
        uses = self.uses[: len(self.at)]
        stay = np.flatnonzero(uses > max(1, int(np.partition(uses, len(uses) // 2)[len(uses) // 2])))
        pieces, begin = list(self.at), self.first[stay]
        size = self.first[stay + 1] - begin
        ids = self.flat[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        self.at = {}
        self.uses[:] = 0
        self._keep([pieces[i] for i in stay.tolist()], size, ids)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """The places that new pieces get. Words led by a space go through the tokenizer many in one call: each begins
        where an id begins with a space."""
        led = [p[:1] == b" " < p[1:2] != b"\xc2" for p in pieces]  # no other white space follows
        words = list(compress(pieces, led))
        n = len(self.at)
        for i in range(0, len(words), 2048):  # what the tokenizer returns is far larger than the ids
            some = words[i : i + 2048]
            letters = _LETTERS[np.frombuffer(b"\n".join(some), np.uint8)].tobytes().decode("utf-16-le").replace(_LINE, " ")
            ids = np.array(self.joined.encode_batch_fast([letters], add_special_tokens=False)[0].ids, np.int32)
            starts = np.flatnonzero(self.leads[ids])
            self._keep(some, np.diff(starts, append=len(ids)), ids)
        rest = list(compress(pieces, map(not_, led)))
        for i in range(0, len(rest), 2048):
            some = rest[i : i + 2048]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)]
            self._keep(some, np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.int32))
        places = np.empty(len(pieces), np.int64)
        places[np.argsort(~np.array(led), kind="stable")] = n + np.arange(len(pieces))
        return places

    def _keep(self, pieces: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.at)
        begin = int(self.first[n])
        self.first, self.flat = _roomy(self.first, n + 1 + len(pieces)), _roomy(self.flat, begin + len(ids))
        self.uses = _roomy(self.uses, n + 1 + len(pieces))
        self.first[n + 1 : n + 1 + len(pieces)] = begin + np.cumsum(sizes)
        self.flat[begin : begin + len(ids)] = ids
        self.at.update(zip(pieces, range(n, n + len(pieces))))

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        column = pa.compute.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        raw, ends = _bytes(column)
        high = np.flatnonzero(raw >= 0xC9)  # first bytes from U+0240
        high = high[(raw[high] > 0xC9) | (raw[high - len(raw) + 1] >= 0x90)]
        whole = np.zeros(len(column), bool)
        whole[np.searchsorted(ends, high, side="right") - 1] = True
        if len(high):
            raw, ends = _bytes(column.filter(pa.array(~whole)))
        split, i = [], 0
        while i < len(ends) - 1:
            if len(self.at) > _PIECES:
                self._forget()
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + _CHARS, side="right")) - 1)
            split += self._split(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            i = j
        if not len(high):
            return split
        rest = iter(split)
        return [np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.int32) if w else next(rest) for i, w in enumerate(whole)]

    def _split(self, raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Texts up to U+024F as bytes, all side by side: where pieces begin follows from the kinds of neighbouring characters."""
        if not len(raw):
            return [np.zeros(0, np.int32) for _ in ends[1:]]
        starts = _piece_starts(raw, ends[:-1])
        offsets = np.append(starts, len(raw))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        kinds = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.at.get, kinds, repeat(-1)), np.int64, len(kinds))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn([kinds[i] for i in new.tolist()])
        self.uses[at] += self.uses[at] < 255
        first = self.first[at]
        size = self.first[at + 1] - first
        each = pieces.indices.to_numpy()
        sizes = size[each]
        after = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.repeat(first[each] - after[:-1], sizes) + np.arange(after[-1])]
        cuts = after[np.searchsorted(starts, ends)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a column of large strings as bytes, and where each ends, from 0."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return raw, ends - ends[0]


def _roomy(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.append(x, np.zeros(max(size - len(x), len(x) // 2), x.dtype))


def _piece_starts(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern begin in the bytes of characters up to U+024F, given where texts begin."""
    kind = _KINDS[raw]
    two = np.flatnonzero(raw >= 0xC2)  # no character here has more than two bytes
    kind[two] = kind[two + 1] = _KINDS[(raw[two] & 31).astype(np.int64) << 6 | raw[two + 1] & 63]
    first = np.zeros(len(raw) + 3, bool)  # of a text; the end counts as one
    first[texts] = first[len(raw) :] = True
    begins = np.append(True, kind[1:] != kind[:-1]) | first[: len(raw)]
    # the last of some white space before a word is a piece of its own, or a space leads the word's piece
    space = kind == 0
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1 : len(raw)])
    begins[last - (raw[last] >= 128)] = True
    begins[last[raw[last] == 32] + 1] = False
    quotes = np.flatnonzero((raw == 39) & begins)
    if len(quotes):
        ahead = np.append(raw, [0, 0, 0]).astype(np.int64)
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        one[first[quotes + 1]] = 0
        two[first[quotes + 1] | first[quotes + 2]] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.isin(one * 65536 + two, [ord(c) * 65536 + ord(d) for c, d in ("re", "ve", "ll")])
        begins[quotes[short | long] + 1] = False
        for some, step in ((short, 2), (long, 3)):
            after = quotes[some] + step
            begins[after[after < len(raw)]] = True
    return np.flatnonzero(begins)


def _rows(texts: list[np.ndarray], kind: type) -> np.ndarray:
    """Arrays of several lengths, longest first, as the rows of one."""
    out = np.zeros((len(texts), max(map(len, texts), default=0)), kind)
    for row, x in zip(out, texts):
        row[: len(x)] = x
    return out


def _inner(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of the sizes, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _set_bits(bits: np.ndarray, at: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
    """Put the lowest bits of each value at its place, highest of them first."""
    last = at + widths - 1
    for j in range(int(widths.max(initial=0))):
        some = widths > j
        if not some.all():
            last, values, widths = last[some], values[some], widths[some]
        bits[last - j] = values >> j & 1


def _get_bits(bits: np.ndarray, at: np.ndarray, widths: np.ndarray) -> np.ndarray:
    out, last = np.zeros(len(at), np.int64), at + widths - 1
    for j in range(int(widths.max(initial=0))):
        some = np.flatnonzero(widths > j)
        out[some] += bits[last[some] - j].astype(np.int64) << j
    return out


def _packed_tables(tables: list[np.ndarray], counts: list[np.ndarray]) -> list[bytes]:
    """Of each block the ascending ids by Rice-coded gaps, and their counts: the bits of each in unary, then those below the highest."""
    n = np.array([len(x) for x in tables])
    first = np.cumsum(n) - n
    ids, count = np.concatenate(tables), np.concatenate(counts)
    gaps = np.diff(ids, prepend=-1) - 1
    gaps[first] = ids[first]
    low = np.maximum(np.frexp(np.add.reduceat(gaps, first) / n * 0.69)[1] - 1, 0).astype(np.int64)
    lows, inner = np.repeat(low, n), _inner(n)
    size = np.frexp(count)[1].astype(np.int64) - 1
    unary = np.empty(2 * len(ids), np.int64)  # of a block the gaps' upper parts, then the sizes
    at = np.repeat(2 * first, n) + inner
    unary[at], unary[at + np.repeat(n, n)] = gaps >> lows, size
    ones = np.cumsum(unary + 1)
    whole = np.diff(ones[2 * (first + n) - 1], prepend=0)
    sizes = (whole + n * low + np.add.reduceat(size, first) + 7) // 8
    begin = 8 * (np.cumsum(sizes) - sizes)
    bits = np.zeros(8 * int(sizes.sum()), np.uint8)
    bits[ones - 1 + np.repeat(begin - (np.cumsum(whole) - whole), 2 * n)] = 1
    after = begin + whole
    _set_bits(bits, np.repeat(after, n) + inner * lows, gaps, lows)
    many = np.flatnonzero(size)
    ahead = np.cumsum(size) - size
    _set_bits(bits, (np.repeat(after + n * low - ahead[first], n) + ahead)[many], count[many], size[many])
    data = np.packbits(bits).tobytes()
    heads = np.stack([n, sizes], 1).astype("<u2")
    return [h.tobytes() + bytes([k]) + data[a // 8 : a // 8 + z] for h, k, a, z in zip(heads, low.tolist(), begin.tolist(), sizes.tolist())]


def _tables(data: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """What _packed_tables made: ids, counts and the bytes read of each."""
    heads = np.array([[*np.frombuffer(d, "<u2", 2), d[4]] for d in data], np.int64)
    n, sizes, low = heads.T
    bits = np.unpackbits(np.frombuffer(b"".join(d[5 : 5 + z] for d, z in zip(data, sizes.tolist())), np.uint8))
    begin = 8 * (np.cumsum(sizes) - sizes)
    ones = np.flatnonzero(bits)
    inner2 = _inner(2 * n)
    unary = ones[np.repeat(np.searchsorted(ones, begin), 2 * n) + inner2]
    edge = np.cumsum(2 * n)
    after = unary[edge - 1] + 1
    values = np.diff(unary, prepend=-1) - 1
    values[edge - 2 * n] = unary[edge - 2 * n] - begin
    first, inner, lows = np.cumsum(n) - n, _inner(n), np.repeat(low, n)
    at = np.repeat(2 * first, n) + inner
    gaps = (values[at] << lows) + _get_bits(bits, np.repeat(after, n) + inner * lows, lows)
    size = values[at + np.repeat(n, n)]
    counts = np.ones(len(gaps), np.int64)
    many, ahead = np.flatnonzero(size), np.cumsum(size) - size
    counts[many] = _get_bits(bits, (np.repeat(after + n * low - ahead[first], n) + ahead)[many], size[many]) + (1 << size[many])
    total = np.cumsum(gaps + 1)
    ids = total - 1 - np.repeat(total[first] - gaps[first] - 1, n)
    return np.split(ids, first[1:]), np.split(counts, first[1:]), (5 + sizes).tolist()


def _slot2(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return one * 1021 + two & _PAIRS - 1


def _guesses(ranks: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """What followed each slot last, times 16, and 1 + how often in a row that guess was right (0: no guess)."""
    order = np.argsort(slots.astype(np.uint16), kind="stable")
    came, place = ranks[order], slots[order]
    known, right = np.zeros(len(ranks), bool), np.zeros(len(ranks), bool)
    np.equal(place[1:], place[:-1], out=known[1:])
    np.equal(came[1:], came[:-1], out=right[1:])
    right &= known
    each = _EACH[: len(ranks)]
    row = each - np.maximum.accumulate(each * ~right)
    seen = np.empty(len(ranks), np.uint16)
    seen[1:] = came[:-1] << 4 | np.minimum(row[:-1] + 1, 15)
    seen[~known] = _NONE
    out = np.empty(len(ranks), np.uint16)
    out[order] = seen
    return out


# Parts of _TOTAL that the guesses of order 2 and 1 get, at 16 * (1 + how often in a row order 2 was right) + that of order 1.
_PART2 = np.repeat(_ODDS[0], 16)
_PART1 = (_TOTAL - _PART2) * np.tile(_ODDS[1], 16) >> 24
# The same for a choice of order 2, 1 or 0, at 4 * that place + 0, 1 or 2.
_STARTS = np.stack([0 * _PART2, _PART2, _PART2 + _PART1, 0 * _PART2], 1).ravel().astype(np.uint64)
_WIDTHS = np.stack([_PART2, _PART1, _TOTAL - _PART2 - _PART1, 0 * _PART2], 1).ravel().astype(np.uint64)
_LIMITS = _WIDTHS << np.uint64(39)  # a state from here on gives a word away first
_ENDS2, _ENDS1 = _STARTS[1::4].copy(), _STARTS[2::4].copy()
_COSTS = np.log2(_TOTAL / np.maximum(_WIDTHS, 1)) + 2**-20  # bits
_SURE = 2  # order 0 where there is no guess: nothing to write
_EACH = np.arange(_SLOTS, dtype=np.int32)


def _choices(ids: np.ndarray, table: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a block with the distinct ids `table`, which have a place each: the choice of an order for each id, and the
    places of the ids that are left to order 0."""
    ranks = place[ids]
    one = np.zeros(len(ids), np.int64)
    one[1:] = ranks[:-1]
    two = np.zeros(len(ids), np.int64)
    two[1:] = one[:-1]
    seen2 = _guesses(ranks, _slot2(one, two))
    seen1 = _guesses(ranks, one)
    guess2, guess1, row2, row1 = seen2 >> 4, seen1 >> 4, seen2 & 15, seen1 & 15
    row1 *= guess1 != guess2  # one guess of both is order 2's
    right2, right1 = (guess2 == ranks) & (row2 > 0), (guess1 == ranks) & (row1 > 0)
    left = ~(right2 | right1)
    return (row2 << 6 | row1 << 2) + (right1 + left.view(np.uint8) * 2), ranks[left]


def _shares(counts: np.ndarray) -> np.ndarray:
    """Where the parts of 2^12 for so many of each begin, and the end of the last; each has one at least."""
    after = np.append(0, np.cumsum(counts))
    return (after << 12) // after[-1]


def _places(order: list[np.ndarray], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Arrays, longest first, as the columns of one; and how many of them reach each row."""
    lengths = np.array([len(x) for x in order])
    return np.ascontiguousarray(_rows(order, kind).T), np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")


def _coded_choices(choices: list[np.ndarray]) -> list[bytes]:
    """Each block's choices, those of `TURN` ids by one coder: states u64, numbers of words u16, words u32."""
    parts = [x[i : i + TURN] for x in choices for i in range(0, len(x), TURN)]
    parts = [x[x != _SURE] for x in parts]
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    columns, active = _places([parts[i] for i in order], np.uint16)
    room = max(int(_COSTS[x].sum()) for x in parts) // 32 + 2
    state = np.full(len(parts), _LOW, np.uint64)
    words, at = np.zeros((len(parts), room), "<u4"), np.full(len(parts), room)
    for t in range(len(columns) - 1, -1, -1):  # the reader goes forwards
        n = active[t]
        x, choice = state[:n], columns[t, :n]
        f = _WIDTHS[choice]
        full = (x >= _LIMITS[choice]).nonzero()[0]
        if len(full):
            at[full] -= 1
            words[full, at[full]] = x[full] & np.uint64(0xFFFFFFFF)
            x[full] >>= np.uint64(32)
        turns = x // f
        state[:n] = (turns << np.uint64(24)) + (x - turns * f) + _STARTS[choice]
    states, sizes, coded = np.zeros(len(parts), "<u8"), np.zeros(len(parts), "<u2"), [b""] * len(parts)
    states[order], sizes[order] = state, room - at
    for i, w, a in zip(order, words, at.tolist()):
        coded[i] = w[a:].tobytes()
    ends = np.cumsum([0, *(-(-len(x) // TURN) for x in choices)]).tolist()
    return [states[a:b].tobytes() + sizes[a:b].tobytes() + b"".join(coded[a:b]) for a, b in zip(ends, ends[1:])]


def _coded_ids(missed: list[np.ndarray], shares: list[np.ndarray]) -> list[bytes]:
    """Each block's ids of order 0, as places in its table, `SPAN` by one coder: states u32, numbers of words u16, words u16."""
    lanes = [(block, i) for block, m in enumerate(missed) for i in range(0, len(m), SPAN)]
    lanes.sort(key=lambda x: x[1] + SPAN > len(missed[x[0]]) and x[1] - len(missed[x[0]]) + SPAN)
    base = np.cumsum([0, *map(len, shares)])
    starts = np.concatenate(shares)
    columns, active = _places([missed[b][i : i + SPAN] for b, i in lanes], np.uint16)
    base = np.array([base[b] for b, _ in lanes], np.int64)
    room = len(columns) + 1
    state = np.full(len(lanes), 1 << 16, np.int64)
    words, at = np.zeros(len(lanes) * room, "<u2"), np.arange(1, len(lanes) + 1) * room - 1
    for t in range(len(columns) - 1, -1, -1):
        n = active[t]
        x, place = state[:n], base[:n] + columns[t, :n]
        start = starts[place]
        f = starts[place + 1] - start
        full = x >= f << 20
        words[at[:n]] = x & 0xFFFF  # stays only if the place before it is the next
        at[:n] -= full
        x >>= full * 16
        turns = (x / f).astype(np.int64)  # below 2^32, where a double's quotient cannot round up to a whole number
        state[:n] = (turns << 12) + (x - turns * f) + start
    at += 1
    out: list[list] = [[] for _ in missed]
    for lane, (block, i) in enumerate(lanes):
        out[block].append((i, int(state[lane]), words[at[lane] : (lane + 1) * room]))
    coded = []
    for some in out:
        some.sort(key=lambda x: x[0])
        coded.append(np.array([x for _, x, _ in some], "<u4").tobytes() + np.array([len(w) for _, _, w in some], "<u2").tobytes() + b"".join(w.tobytes() for _, _, w in some))
    return coded


def encode_blocks(blocks: list[np.ndarray], size: int = 65_536) -> list[bytes]:
    """Each block's ids (up to BLOCK of them, below `size`) as bytes."""
    if not 0 < size <= MOST or any(len(b) > _SLOTS or (len(b) and (b.min() < 0 or b.max() >= size)) for b in blocks):
        raise ValueError(f"a block holds up to {_SLOTS} ids below the vocabulary's size, {MOST} at most")
    out: list[bytes] = [b""] * len(blocks)
    order = sorted((i for i in range(len(blocks)) if len(blocks[i])), key=lambda i: -len(blocks[i]))
    seen, place = np.zeros(size, bool), np.zeros(size, np.uint16)
    for begin in range(0, len(order), LANES):
        part = order[begin : begin + LANES]
        tables, every, choices, missed = [], [], [], []
        for i in part:
            seen[blocks[i]] = True
            table = np.flatnonzero(seen)
            seen[table] = False
            place[table] = np.arange(len(table))
            choice, left = _choices(blocks[i], table, place)
            counts = np.bincount(left, minlength=len(table))  # what comes first is left to order 0: there is one of each
            tables.append(table)
            every.append(counts)
            choices.append(choice)
            missed.append(left)
        packed = chain.from_iterable(_packed_tables(tables[i : i + FEW], every[i : i + FEW]) for i in range(0, len(part), FEW))
        for i, *coded in zip(part, packed, _coded_choices(choices), _coded_ids(missed, list(map(_shares, every)))):
            out[i] = b"".join(coded)
    for i, ids in enumerate(blocks):
        check = zlib.crc32(ids.astype("<u4").tobytes(), size)
        out[i] = MAGIC + np.array([len(ids), size, check, len(out[i]), zlib.crc32(out[i])], "<u4").tobytes() + out[i]
    return out


def _left_ids(counts: list[np.ndarray], data: list[bytes]) -> list[np.ndarray]:
    """The places in their tables of the ids of order 0 of some blocks, with what _coded_ids made."""
    shares = [_shares(c) for c in counts]
    widths = [np.diff(x) for x in shares]
    every = np.concatenate(widths)
    holds = np.repeat(np.concatenate([_EVERY_PLACE[: len(w)] for w in widths]), every)  # what each part belongs to
    begins = np.repeat(np.concatenate([x[:-1] for x in shares]), every)
    packed = np.repeat(every << 12, every) + np.tile(np.arange(4096), len(counts)) - begins  # width, place in the part
    packed = packed.astype(np.uint32)
    lengths, state, sizes, words = [], [], [], []
    for c, d in zip(counts, data):
        m = int(c.sum())
        n = -(-m // SPAN)
        lengths += [min(SPAN, m - i) for i in range(0, m, SPAN)]
        state.append(np.frombuffer(d, "<u4", n))
        sizes.append(np.frombuffer(d, "<u2", n, 4 * n))
        words.append(np.frombuffer(d, "<u2", offset=6 * n))
    of = np.repeat(np.arange(len(counts)), [len(x) for x in state]) << 12
    length, sizes = np.array(lengths), np.concatenate(sizes).astype(np.int64)
    order = np.argsort(-length, kind="stable")
    active = np.searchsorted(-length[order], -np.arange(length.max()), side="left").tolist()
    at, base, x = (np.cumsum(sizes) - sizes)[order], of[order], np.concatenate(state)[order]
    left = np.concatenate([*words, np.zeros(1, "<u2")]).astype(np.uint32)
    found = np.zeros((len(active), len(order)), np.int32)
    n = len(order)
    for t, now in enumerate(active):
        if now < n:
            n = now
            at, base, x = at[:n], base[:n], x[:n]
        part = base + (x & 4095)
        found[t, :n] = part
        here = packed[part]
        x = (here >> 12) * (x >> 12) + (here & 4095)
        less = x < 65536
        np.copyto(x, x << 16 | left[at], where=less)
        at = at + less
    found = holds[found.T]  # a lane a row
    rows: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(order)
    for row, lane in zip(found, order):
        rows[lane] = row[: length[lane]]
    ends = np.cumsum([0, *map(len, state)])
    return [np.concatenate(rows[a:b]) for a, b in zip(ends, ends[1:])]


_EVERY_PLACE = np.arange(4096, dtype=np.uint16)


def _ranks(lengths: np.ndarray, missed: list[np.ndarray], data: list[bytes], most: int) -> np.ndarray:
    """The places in their tables of all ids of blocks, longest first; a row a step."""
    lanes, steps = len(lengths), int(lengths.max())
    left = np.concatenate([*missed, np.zeros(1, np.uint16)])
    next0 = np.cumsum([0, *map(len, missed[:-1])])
    turns = (-(-lengths // TURN)).tolist()
    states, sizes = np.zeros((turns[0], lanes), np.uint64), np.zeros((turns[0], lanes), np.int64)
    for i, (k, d) in enumerate(zip(turns, data)):
        states[:k, i], sizes[:k, i] = np.frombuffer(d, "<u8", k), np.frombuffer(d, "<u2", k, 8 * k)
    words = np.concatenate([*(np.frombuffer(d, "<u4", offset=10 * k) for k, d in zip(turns, data)), np.zeros(1, "<u4")]).astype(np.uint64)
    begins = (np.cumsum(sizes.T) - sizes.T.ravel()).reshape(lanes, -1).T
    last2, last1 = np.full(lanes * _PAIRS, _NONE, np.uint16), np.full(lanes * most, _NONE, np.uint16)  # as _guesses has them
    out = np.zeros((steps, lanes), np.uint16)
    one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    at2, at1 = np.arange(lanes) * _PAIRS, np.arange(lanes) * most
    active = np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()
    n = lanes
    for t in range(steps):
        if active[t] < n:
            n = active[t]
            at2, at1, next0, one, two = at2[:n], at1[:n], next0[:n], one[:n], two[:n]
            if t % TURN:
                state, at = state[:n], at[:n]
        if t % TURN == 0:
            state, at = states[t // TURN, :n], begins[t // TURN, :n]
        slot2, slot1 = at2 + _slot2(one, two), at1 + one
        seen2, seen1 = last2[slot2], last1[slot1]
        guess2, guess1 = seen2 >> 4, seen1 >> 4
        rows = ((seen2 & 15) << 4 | (seen1 & 15) * (guess1 != guess2)).astype(np.int64)
        value = state & np.uint64(_TOTAL - 1)
        not2, not1 = value >= _ENDS2[rows], value >= _ENDS1[rows]
        choice = (rows << 2) + not2 + not1
        state = _WIDTHS[choice] * (state >> np.uint64(24)) + (value - _STARTS[choice])
        less = (state < np.uint64(_LOW)).nonzero()[0]
        if len(less):
            state[less] = state[less] << np.uint64(32) | words[at[less]]
            at[less] += 1
        rank = left[next0]
        np.copyto(rank, guess1, where=not1 < not2)
        np.copyto(rank, guess2, where=~not2)
        next0 = next0 + not1
        # a row goes on where the guess was right, up to 15
        first = rank << 4 | 1
        more = np.minimum(seen2 + 1, first | 14)
        np.copyto(more, first, where=not2)
        last2[slot2] = more
        more = np.minimum(seen1 + 1, first | 14)
        np.copyto(more, first, where=guess1 != rank)
        last1[slot1] = more
        out[t, :n] = rank
        one, two = rank.astype(np.int64), one
    return out


def decode_blocks(bodies: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises if one is damaged."""
    heads = []
    for body in bodies:
        head = np.frombuffer(body[4:_HEAD], "<u4").astype(np.int64) if len(body) >= _HEAD else np.zeros(5, np.int64)
        sound = body[:4] == MAGIC and head[0] <= _SLOTS and 0 < head[1] <= MOST and len(body) == _HEAD + head[3] and bool(head[0]) == bool(head[3])
        if not sound or zlib.crc32(body[_HEAD:]) != head[4]:
            raise ValueError("not a block, or a damaged one")
        heads.append(head)
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(bodies)
    order = sorted((i for i in range(len(bodies)) if heads[i][0]), key=lambda i: -heads[i][0])
    for begin in range(0, len(order), LANES):
        part = order[begin : begin + LANES]
        found = [_tables([bodies[i][_HEAD:] for i in part[j : j + FEW]]) for j in range(0, len(part), FEW)]
        tables, counts, read = (list(chain.from_iterable(x)) for x in zip(*found))
        coded = [bodies[i][_HEAD + n :] for i, n in zip(part, read)]
        turns = [-(-int(heads[i][0]) // TURN) for i in part]
        ends = [10 * k + 4 * int(np.frombuffer(d, "<u2", k, 8 * k).sum(dtype=np.int64)) for k, d in zip(turns, coded)]
        missed = []
        for i in range(0, len(part), 128):  # their parts together are small
            missed += _left_ids(counts[i : i + 128], [d[e:] for d, e in zip(coded[i : i + 128], ends[i : i + 128])])
        ranks = np.ascontiguousarray(_ranks(np.array([heads[i][0] for i in part]), missed, [d[:e] for d, e in zip(coded, ends)], max(map(len, counts))).T)
        for row, table, i in zip(ranks, tables, part):
            out[i] = table[row[: heads[i][0]]].astype(np.int32)
    for i, ids in enumerate(out):
        if zlib.crc32(ids.astype("<u4").tobytes(), int(heads[i][1])) != heads[i][2]:
            raise ValueError("a block is damaged: its checksum differs")
    return out


@lru_cache(64)
def _zeros(power: int) -> tuple[int, ...]:
    """The linear map of a crc32 when 2^power zero bits follow, by its 32 columns."""
    if power == 0:
        return (0xEDB88320, *(1 << i for i in range(31)))
    half = _zeros(power - 1)
    return tuple(_applied(half, x) for x in half)


def _applied(columns: tuple[int, ...], x: int) -> int:
    out, i = 0, 0
    while x:
        if x & 1:
            out ^= columns[i]
        x >>= 1
        i += 1
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """crc32 of two strings one after the other, from theirs and the second's size in bytes."""
    bits, power = 8 * size, 0
    while bits:
        if bits & 1:
            first = _applied(_zeros(power), first)
        bits >>= 1
        power += 1
    return first ^ second


def write(docs: DataFrame, path: str, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json"), end: int = END) -> None:
    """Write the ids of docs (doc_id, text) as token files in the folder `path`, by a tokenizers file's path."""
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids = TaskContext.get().partitionId(), tokenizer_of(tokenizer)
        held: list[np.ndarray] = []
        docs: list[tuple[int, int | None, int]] = []  # ordinal, doc_id and ids of documents not yet in blocks
        size = written = block = ordinal = 0
        carried = False  # whether the first of docs began in an earlier block

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, written, block, carried
            stream = np.concatenate(held) if held else np.zeros(0, np.int32)
            whole = len(stream) if last else len(stream) // BLOCK * BLOCK
            blocks = [stream[i : min(i + BLOCK, whole)] for i in range(0, whole, BLOCK)]
            rows = []
            for part, body in zip(blocks, encode_blocks(blocks, max(ids.vocabulary, end + 1))):
                room, pieces = len(part), []
                while room:
                    number, doc_id, n = docs[0]
                    take = min(n, room)
                    pieces.append({"ordinal": number, "doc_id": doc_id, "n": take, "opens": not carried})
                    room -= take
                    carried = take < n
                    if carried:
                        docs[0] = (number, doc_id, n - take)
                    else:
                        docs.pop(0)
                rows.append((shard, block, written, len(part), pieces, body))
                block, written = block + 1, written + len(part)
            held, size = [stream[whole:]], len(stream) - whole
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), _PIECE, pa.binary()]
            names = ["shard", "block", "first", "n", "docs", "body"]
            for i in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 1024]), kinds)], names=names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i in range(0, len(keys), 1024):
                for doc_id, found in zip(keys[i : i + 1024], ids.encode(batch.column(1).slice(i, 1024))):
                    held.append(np.append(found, end).astype(np.int32))
                    docs.append((ordinal, doc_id, len(found) + 1))
                    size += len(found) + 1
                    ordinal += 1
                    if size >= BLOCK * LANES // 2:
                        yield from flush(False)
        if docs:
            yield from flush(True)

    # rows of one doc_id, or of none, are parted by their texts: no id is bound to one task
    ordered = picked.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _FILE).write.parquet(path)


_PIECE = pa.list_(pa.struct([("ordinal", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("opens", pa.bool_())]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of documents in token files: shard, ordinal, doc_id, start (ids of all before), ids."""
    blocks = spark.read.schema(_FILE).parquet(path)
    sizes = sorted(blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect())  # as many as files
    before = np.cumsum([0, *(int(r.n) for r in sizes)])
    base = spark.createDataFrame([(r.shard, int(b)) for r, b in zip(sizes, before)], "shard int, base bigint")
    placed = blocks.join(small(base), "shard").select("shard", (F.col("base") + F.col("first")).alias("first"), "docs", "body")
    schema = "shard int, ordinal bigint, doc_id bigint, start bigint, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer_of.cache_clear()  # a worker that wrote before
        for shards, firsts, docs, bodies in _grouped(batches):
            rows, every = [], np.concatenate(decode_blocks(bodies))
            for shard, first, pieces in zip(shards, firsts, docs):
                at = first
                for piece in pieces:
                    rows.append((shard, piece["ordinal"], piece["doc_id"], at))
                    at += piece["n"]
            ends = np.cumsum([0, *(piece["n"] for pieces in docs for piece in pieces)]).astype(np.int32)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = [f.split(" ")[0] for f in schema.split(", ")]
            for i in range(0, len(rows), 1024):
                cuts = ends[i : i + 1025]
                ids = pa.ListArray.from_arrays(cuts - cuts[0], every[cuts[0] : cuts[-1]])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows[i : i + 1024]), kinds)), ids], names=names)

    return placed.mapInArrow(run, schema)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of several batches, as many as are decoded side by side."""
    held: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            if len(held) == LANES:
                yield tuple(zip(*held))
                held = []
    if held:
        yield tuple(zip(*held))


def digests(pieces: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of read()."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            flat, edges = ids.flatten().to_numpy().astype("<u4", copy=False), np.cumsum([0, *pa.compute.list_value_length(ids).to_pylist()])
            found = [zlib.crc32(flat[a:b]) for a, b in zip(edges, edges[1:])]
            columns = [*batch.columns[:4], pa.array(np.diff(edges), pa.int64()), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "ordinal", "doc_id", "start", "n", "crc"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for parts in batch.column(3).to_pylist():
                crc = parts[0]["crc"]
                for part in parts[1:]:
                    crc = joined_crc(crc, part["crc"], 4 * part["n"])
                crcs.append(crc)
            columns = [*batch.columns[:3], pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    each = pieces.mapInArrow(sums, "shard int, ordinal bigint, doc_id bigint, start bigint, n bigint, crc bigint")
    docs = each.groupBy("shard", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("parts")
    )
    return docs.select("doc_id", "start", "n_tokens", "parts").mapInArrow(joined, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
