"""SentencePiece's merge-type encoding: a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import batches, read, tuned

SPACE = "▁"
#: Most chunks that a worker remembers in each of two generations.
REMEMBERED = 400_000
#: Characters up to which a chunk's agenda is searched rather than kept as a heap, and is merged with many others at a time.
SHORT = 40
#: Bits of a symbol in a pair's key: symbols are pieces, and the characters that are none, by their code points.
BITS = 21
#: The rank of a pair that makes no piece; ranks stand above the 32 bits of a place.
NONE = 1 << 62


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a merge-type model, and texts' ids; the library serves to read the model, to check and to decode."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.text, self.names = [m.id_to_piece(i) for i in range(n)], np.array([f"{i},".encode() for i in range(n)])
        normal = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {self.text[i]: i for i in normal}
        # Rank of a piece in the agenda: higher scores first.
        order = sorted(normal, key=lambda i: -m.get_score(i))
        rank, self.rank = {}, {}
        for i in order:
            self.rank[self.text[i]] = rank.setdefault(m.get_score(i), len(rank))
        self._pair_table()
        self.bytes = {int(self.text[i][1:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.user = [self.text[i] for i in normal if m.get_score(i) == 0.0 and len(self.text[i]) > 1]
        # No piece has a space mark after another character, so nothing is merged across one; nor between two characters
        # that stand side by side in no piece.
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("only models without pieces that span words can be used")
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.known: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # Whether the model maps what it reads: a model with the identity rule only adds and escapes spaces.
        probe = "Aé ﬁ　x  y "
        if m.encode(probe, out_type=str) != [self.text[i] for c in self.chunks(self.normalized(probe)) for i in self.merge(c)]:
            raise ValueError("only models that keep characters and spaces as they are can be used")
        # What a text that starts with a line end has before its rest: behind it, any run can be checked as it is.
        self.lead = m.encode("\n")
        if SPACE + "\n" in self.inside or any(p[0] == "\n" for p in self.inside):
            raise ValueError("only models without pieces that go on after a line end can be used")

    def _pair_table(self) -> None:
        """Pairs of symbols that make a piece, hashed: what merges many chunks at a time looks up."""
        single = sorted({c for p in self.rank for c in p} - self.rank.keys())
        symbols = [*self.rank, *single]
        number = {p: k for k, p in enumerate(symbols)}
        self.of_symbol = np.array([self.ids.get(p, -1) for p in symbols], np.int64)
        self.symbol_rank = np.array([self.rank[p] << 32 for p in self.rank] + [NONE] * (len(single) + 1), np.int64)  # the last: of -1
        self.n_symbols, self.characters = len(symbols), dict(enumerate(single, len(self.rank)))
        if self.n_symbols + 0x110000 > 1 << BITS:
            raise ValueError("too many pieces")
        self.of_character = self.n_symbols + np.arange(0x110000)
        for c, k in number.items():
            if len(c) == 1:
                self.of_character[ord(c)] = k
        pairs = {number[p[:i]] << BITS | number[p[i:]]: number[p] for p in self.rank for i in range(1, len(p)) if p[:i] in number and p[i:] in number}
        keys, made = np.array([*pairs], np.int64), np.array([*pairs.values()], np.int64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        at = self._slot(keys)
        while len(keys):  # one of those that meet in a free slot takes it, the others go on to the next
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[free]
            put = self.slots[at] == keys
            self.made[at[put]] = made[put]
            keys, made, at = keys[~put], made[~put], (at[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that a and b make, or -1."""
        keys = a << BITS | b
        at = self._slot(keys)
        found = self.slots[at]
        other = np.flatnonzero((found != keys) & (found >= 0))
        while len(other):
            at[other] = (at[other] + 1) & self.mask
            found[other] = self.slots[at[other]]
            other = other[(found[other] != keys[other]) & (found[other] >= 0)]
        made = self.made[at]
        made[found != keys] = -1
        return made

    def _agenda(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the symbols at these places make with the next one, and its rank."""
        made = self._made(symbols[at], symbols[at + 1])
        return made, self.symbol_rank[made]

    def merge_all(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many chunks, one after the other, and where each ends: in each round every chunk's best pair (rank, then
        leftmost) is merged."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = self.of_character[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        rows, first = np.arange(len(chunks)), np.concatenate([[0], np.cumsum(size)[:-1]])
        made, rank = np.full(len(symbols), -1), np.full(len(symbols), NONE)
        places, inner = np.arange(len(symbols)), np.ones(len(symbols), bool)
        inner[first + size - 1] = False  # a chunk's last symbol has no next one
        at = np.flatnonzero(inner)
        made[at], rank[at] = self._agenda(symbols, at)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            best = np.minimum.reduceat(rank + places[: len(rank)], first)
            done = best >= NONE
            if done.any():
                out = np.repeat(done, size)
                ended.append((np.repeat(rows[done], size[done]), symbols[out]))
                best = best[~done] & 0xFFFFFFFF
                best -= np.cumsum(out)[best]
                symbols, made, rank, rows, size = symbols[~out], made[~out], rank[~out], rows[~done], size[~done]
                first = np.cumsum(size) - size
            else:
                best &= 0xFFFFFFFF
            symbols[best] = made[best]
            # The pair's second symbol goes, and what is made with the neighbours is looked up again.
            left = np.ones(len(symbols), bool)
            left[best + 1] = False
            made[best], rank[best] = -1, NONE
            symbols, made, rank = symbols[left], made[left], rank[left]
            k = np.arange(len(rows))
            best, first, size = best - k, first - k, size - 1
            after, before = best[best + 1 < first + size], best[best > first] - 1
            for at in (after, before):
                made[at], rank[at] = self._agenda(symbols, at)
        which, symbols = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(which, kind="stable")
        which, symbols = which[order], symbols[order]
        ids = np.where(symbols < self.n_symbols, self.of_symbol[np.minimum(symbols, self.n_symbols - 1)], -1)
        stop = np.searchsorted(which, np.arange(len(chunks)), side="right")
        odd = np.flatnonzero(ids < 0)
        if len(odd):  # characters that are no pieces
            kinds, kind = np.unique(symbols[odd], return_inverse=True)
            spelt = [self.spelt(self.characters[k] if k < self.n_symbols else chr(k - self.n_symbols)) for k in kinds.tolist()]
            length = np.array([len(x) for x in spelt])
            table = np.array([x + [0] * (length.max() - len(x)) for x in spelt])
            n = np.ones(len(ids), np.int64)
            n[odd] = length[kind]
            ends = np.cumsum(n)
            ids, begin = np.repeat(ids, n), ends[odd] - n[odd]
            for j in range(table.shape[1]):
                more = length[kind] > j
                ids[begin[more] + j] = table[kind[more], j]
            stop = ends[stop - 1]
        return ids.astype("<i4"), stop

    def spelt(self, symbol: str) -> list[int]:
        """Ids of a symbol that is no piece."""
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    @staticmethod
    def normalized(text: str) -> str:
        """The text with a space before it and all spaces marked; an empty text stays empty."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    @staticmethod
    def chunks(marked: str) -> list[str]:
        """Runs that begin where a space mark follows another character: merges stay within them."""
        return re.findall(f"{SPACE}+[^{SPACE}]*", marked) if marked else []

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk: the agenda's best pair (rank, then leftmost) is merged until none is left."""
        out: list[int] = []
        for s in self.merged_short(chunk) if len(chunk) <= SHORT else self.merged_long(chunk):
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            else:
                out.extend(self.spelt(s))
        return out

    def merged_short(self, chunk: str) -> list[str]:
        """Symbols of a short chunk: the agenda is a list of the adjacent pairs' ranks, searched whole for the least."""
        get, none, symbols = self.rank.get, len(self.rank) + 1, list(chunk)
        agenda = [get(chunk[i : i + 2], none) for i in range(len(chunk) - 1)]
        while agenda and (best := min(agenda)) != none:
            i = agenda.index(best)
            pair = symbols[i] + symbols[i + 1]
            symbols[i : i + 2] = [pair]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(pair + symbols[i + 1], none)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + pair, none)
        return symbols

    def merged_long(self, chunk: str) -> list[str]:
        """Symbols of a chunk of any length: the agenda is a heap, and symbols are linked to their neighbours."""
        rank = self.rank
        symbols: list[str] = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            if not symbols[i] or (j := after[i]) == n or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := pair + symbols[k]) in rank:
                    heapq.heappush(agenda, (rank[new], i, new))
            if (h := before[i]) >= 0 and (new := symbols[h] + pair) in rank:
                heapq.heappush(agenda, (rank[new], h, new))
        return [s for s in symbols if s]

    def parts(self, chunk: str) -> list[str]:
        """The chunk, cut where two characters stand side by side in no piece."""
        inside, out, at = self.inside, [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in inside:
                out.append(chunk[at:i])
                at = i
        out.append(chunk[at:])
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes words not yet known, chunks without their first mark; the library must agree on the ids of every one.

        Words up to SHORT are merged many at a time; longer ones part by part, as each part is met for the first time.
        """
        young = self.young
        short = [w for w in words if len(w) < SHORT]
        for i in range(0, len(short), 4000):
            some = short[i : i + 4000]
            chunks = [SPACE + w for w in some]
            ids, stop = self.merge_all(chunks)
            self.agreed(chunks, ids, stop)
            raw, at = ids.tobytes(), 0
            for w, e in zip(some, (4 * stop).tolist(), strict=True):
                young[w] = raw[at:e]
                at = e
        long = [w for w in words if len(w) >= SHORT]
        if not long:
            return
        cut = [self.parts(SPACE + w) for w in long]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list({p for parts in cut for p in parts if p not in known})
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            own = [self.merge(p) for p in some]
            self.agreed(some, np.array(list(chain.from_iterable(own)), "<i4"), np.cumsum([len(x) for x in own]))
            known.update((p, np.array(x, "<i4").tobytes()) for p, x in zip(some, own, strict=True))
        for w, parts in zip(long, cut, strict=True):
            young[w] = b"".join([known[p] for p in parts])

    def agreed(self, parts: list[str], ids: np.ndarray, stop: np.ndarray) -> None:
        """Raises ValueError unless the library has these ids for every part."""
        every, lead = self.library.encode(["\n" + p for p in parts], num_threads=1), len(self.lead)
        theirs = np.fromiter(chain.from_iterable(every), np.int32)
        ends = np.cumsum(np.fromiter(map(len, every), np.int64, len(every)))
        own = np.ones(len(theirs), bool)
        at = np.concatenate([[0], ends[:-1]])
        for j, k in enumerate(self.lead):
            if (theirs[at + j] != k).any():
                raise ValueError("the library encodes a line end in another way")
            own[at + j] = False
        if not np.array_equal(ends - lead * np.arange(1, len(ends) + 1), stop) or not np.array_equal(theirs[own], ids):
            start = 0
            for p, e, x in zip(parts, stop.tolist(), every, strict=True):
                if ids[start:e].tolist() != x[lead:]:
                    raise ValueError(f"the library encodes {p!r} as {x[lead:]}, not {ids[start:e].tolist()}")
                start = e

    def words(self, text: str) -> list[str]:
        """The text's chunks without the mark that each begins with."""
        if not text or text[0] == " " or "  " in text or SPACE in text:
            return [c[1:] for c in self.chunks(self.normalized(text))]
        return text.split(" ")

    def look_up(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        cut = [self.words(t) for t in texts]
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old, missing = self.young, self.old, []
        for w in set().union(*cut).difference(young):
            if (known := old.get(w)) is not None:
                young[w] = known
            else:
                missing.append(w)
        self.learn(missing)
        get = young.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<i4") for ws in cut]

    def encode(self, text: str) -> list[int]:
        return self.look_up([text])[0].tolist()

    def joined(self, ids: np.ndarray) -> bytes:
        """Decimal ids, joined by commas."""
        return self.names[ids].tobytes().translate(None, b"\0")[:-1]


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """A worker's model: read once, and what it has learnt is kept from task to task."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str, *, with_ids: bool = False) -> DataFrame:
    """Every text of docs(doc_id, text) encoded, and decoded by the library: number of ids, both digests, ids if asked for.

    Null texts are empty: no ids. Texts of any length are cut into chunks, so memory is bounded by a batch, or a text, and
    what is remembered. Rows stay as they are, repeated or not; other columns go. A part on which the library disagrees
    raises ValueError.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(it) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches(it, rows=250, size=2 << 20):
            rows, found = [], m.look_up([t or "" for t in b.column(1).to_pylist()])
            every = [x.tolist() for x in found]
            for i, known, ids, text in zip(b.column(0).to_pylist(), found, every, m.library.decode(every, num_threads=1), strict=True):
                rows.append((i, len(ids), hashlib.sha256(m.joined(known)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) + ((ids,) if with_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT + ", ids array<int>" * with_ids)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded with the public merge-type model; null and empty texts have no ids."""
    tuned(spark)
    return encoded(read(spark, sf_dir, "documents"), default_model())
