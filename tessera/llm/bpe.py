"""Byte-level BPE as a lazily determinised transducer, and decoding through an incremental UTF-8 machine.

Method. A byte-pair encoding has the property that, for every prefix of a piece, one token ends it,
and that token is the one suffix of the prefix whose boundary the merges would keep: two neighbours
``(a, b)`` are kept exactly when encoding ``a + b`` from scratch gives ``a, b`` again. Reading a
piece byte by byte therefore needs, for each open position, only the token that ends there. A state
of the transducer is that list for the bytes since the last settled boundary, with the token before
it, and the longest beginning of a token that the bytes end with (its place in the trie of tokens,
from which suffix links lead to the shorter ones). A boundary is settled when
every chain of tokens that can still be continued passes it; a chain can be continued only where the
bytes read since begin some token, so the lookahead is less than the longest token. Tokens before it
are emitted at each byte, and what no later byte asks for is left out (tokens on none of those
chains, the token before a boundary that nothing can be joined to, a beginning that no token goes on
from), so beginnings of pieces that differ only in what is settled share a state. States and
transitions are made when first met and kept in a bounded table.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import _HELD, bounded, free_name, held_by, slices, texts_of, tidy

#: Entries of the memo tables (of pieces, of states, of kept boundaries) before they are emptied, as they are when a task ends: they bound a worker's memory to about 200 MB.
PIECES, STATES, BOUNDARIES = 200_000, 200_000, 50_000
#: Bytes that the UTF-8 machine is fed at a time.
DECODED = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file of one ``base64 rank`` pair a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes single pieces; equal to merging the lowest-ranked pair until none is left."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        #: The two parts whose merge makes a token of several bytes. What no merge makes is only a whole piece.
        self.made_of: dict[bytes, tuple[bytes, bytes]] = {}
        #: The trie of all tokens: node and byte to node; of each node the token that merges make there, its depth, parent and last byte, whether it goes on, and (made when asked for) the node of its longest shorter suffix.
        self.goto: dict[int, int] = {}
        self.token_at: list[bytes | None] = [None]
        self.depth, self.above, self.goes_on, self.suffix = array("i", [0]), array("q", [0]), bytearray(1), array("i", [0])
        for token in ranks:
            node = 0
            for byte in token:
                key = node << 8 | byte
                self.goes_on[node] = 1
                after = self.goto.get(key)
                if after is None:
                    after = self.goto[key] = len(self.token_at)
                    self.token_at.append(None)
                    self.depth.append(self.depth[node] + 1)
                    self.above.append(key)
                    self.goes_on.append(0)
                    self.suffix.append(-1)
                node = after
            if len(token) == 1:
                self.token_at[node] = token
            else:
                parts = self.merge(token, 2)
                if len(parts) == 2 and parts[0] + parts[1] == token:
                    self.made_of[token] = (parts[0], parts[1])
                    self.token_at[node] = token
        self.kept = lru_cache(BOUNDARIES)(self._kept)
        self.reset()

    def reset(self) -> None:
        #: A state: last settled token, if one can follow it directly; for each position since then the token that ends there, None where no chain passes; the positions on its chain, as bits; the place in the trie.
        self.states: list[tuple[bytes, tuple[bytes | None, ...], tuple[int, ...], int]] = [(b"", (), (0,), 0)]
        self.numbers = {self.states[0]: 0}
        #: State's number << 8 | byte to number of what is emitted << 32 | next state's number << 8.
        self.moves: dict[int, int] = {}
        self.outputs: list[tuple[int, ...]] = [()]
        self.output_numbers: dict[tuple[int, ...], int] = {(): 0}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.after: dict[int, int] = {}
        self.places: dict[int, tuple[tuple[tuple[bytes, int], ...], tuple[int, ...], int]] = {}

    def _renew(self, state: int) -> int:
        """Empty the tables but for one state, as a piece may be longer than they hold; its new number << 8."""
        kept = self.states[state >> 8]
        self.reset()
        number = self.numbers.setdefault(kept, 1)
        if number:
            self.states.append(kept)
        return number << 8

    def _after(self, node: int, byte: int) -> int:
        """The longest beginning of a token at the end of a node's bytes and one more."""
        key = node << 8 | byte
        to = self.after.get(key)
        if to is None:
            to = self.goto.get(key)
            if to is None:
                to = self._after(self._suffix(node), byte) if node else 0
            self.after[key] = to
        return to

    def _suffix(self, node: int) -> int:
        if self.suffix[node] < 0:
            parent, byte = self.above[node] >> 8, self.above[node] & 255
            self.suffix[node] = self._after(self._suffix(parent), byte) if parent else 0
        return self.suffix[node]

    def _place(self, node: int) -> tuple[tuple[tuple[bytes, int], ...], tuple[int, ...], int]:
        """The tokens that a node's bytes end with and their lengths, longest first; the lengths of their ends that a token goes on from; the node of the longest of these."""
        got = self.places.get(node)
        if got is None:
            tokens, lengths, longest = self._place(self._suffix(node)) if node else ((), (), 0)
            if (own := self.token_at[node]) is not None:
                tokens = ((own, len(own)), *tokens)
            if node and self.goes_on[node]:
                lengths, longest = (self.depth[node], *lengths), node
            got = self.places[node] = tokens, lengths, longest
        return got

    def merge(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The definition: merge the lowest-ranked neighbouring pair, leftmost first, down to ``least`` parts. Only for short pieces."""
        get, none = self.ranks.get, 1 << 62
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while len(parts) > least and (rank := min(pairs)) != none:
            at = pairs.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def _kept(self, left: bytes, right: bytes) -> bool:
        """Whether the merges keep the boundary: undone from the last, they never leave a pair there that would have merged before."""
        ranks, made_of = self.ranks, self.made_of
        limit = 1 << 62
        while True:
            rank = ranks.get(left + right)
            if rank is not None and rank < limit:
                return False
            a, b = made_of.get(left), made_of.get(right)
            if a is None and b is None:
                return True
            # the one of higher rank was made later; of equal ones the right one
            if b is None or a is not None and ranks[left] > ranks[right]:
                limit, left = ranks[left], a[1]
            else:
                limit, right = ranks[right] + 1, b[0]

    def _step(self, state: int, byte: int) -> int:
        before, ending, chains, node = self.states[state]
        tokens, lengths, node = self._place(self._after(node, byte))
        n, at, token = len(ending) + 1, 0, b""
        for token, length in tokens:
            at = n - length
            left = ending[at - 1] if at else before
            if not left or self.kept(left, token):
                break
        # the last position that the chains of the last token and of every token that can be continued pass, and all positions they pass
        common = passed = chains[at] | 1 << n
        ending, chains = (*ending, token), (*chains, common)
        for length in lengths:
            common &= chains[n - length]
            passed |= chains[n - length]
        cut, out = 0, ()
        if common:
            cut = common.bit_length() - 1
            out, before = self._tokens(ending[:cut]), ending[cut - 1]
            ending, chains, passed = ending[cut:], tuple([chain >> cut & ~1 for chain in chains[cut:]]), passed >> cut & ~1
        if cut < n and n - cut not in lengths:
            before = b""
        if passed + 2 != 2 << n - cut:
            ending = tuple([token if passed >> at & 1 else None for at, token in enumerate(ending, 1)])
            chains = (0, *[chain if passed >> at & 1 else 0 for at, chain in enumerate(chains[1:], 1)])
        after = (before, ending, chains, node)
        number = self.numbers.setdefault(after, len(self.states))
        if number == len(self.states):
            self.states.append(after)
        emitted = self.output_numbers.setdefault(out, len(self.outputs))
        if emitted == len(self.outputs):
            self.outputs.append(out)
        return emitted << 32 | number << 8

    def _tokens(self, ending: tuple[bytes, ...]) -> tuple[int, ...]:
        """The ids on the last position's chain."""
        tokens, p = [], len(ending)
        while p > 0:
            tokens.append(self.ranks[ending[p - 1]])
            p -= len(ending[p - 1])
        return tuple(reversed(tokens))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            move = moves.get(state | byte)
            if move is None:
                if len(self.states) >= STATES:
                    state = self._renew(state)
                    moves = self.moves
                move = moves[state | byte] = self._step(state >> 8, byte)
            if move >> 32:
                out += self.outputs[move >> 32]
                move &= 0xFFFFFFFF
            state = move
        end = self.ends.get(state)
        if end is None:
            end = self.ends[state] = self._tokens(self.states[state >> 8][1])
        out += end
        return out


class _Pieces(dict):
    """Piece to its ids as packed int32; fills itself through the transducer and is emptied when full."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(self) >= PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def _ranges(kind: str, top: int) -> str:
    """The characters below ``top`` that ``kind`` (a class such as \\p{L}) matches, as ranges of a set."""
    every = "".join(map(chr, (c for c in range(top) if not 0xD800 <= c < 0xE000)))
    runs = [(ord(m[0][0]), ord(m[0][-1])) for m in regex.finditer(f"{kind}+", every)]
    cut = [r for a, b in runs for r in ([(a, 0xD7FF), (0xE000, b)] if a < 0xD800 <= b else [(a, b)])]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in cut)


def spelled_out(pattern: str, top: int) -> re.Pattern | None:
    """The pattern for texts of characters below ``top`` with its classes as sets, which ``re`` matches faster; None if it has what ``re`` would take otherwise."""
    kinds: dict[str, str] = {}

    def ranges(kind: str) -> str:
        return kinds.get(kind) or kinds.setdefault(kind, _ranges(kind, top))

    out, inside, at = [], False, 0
    while at < len(pattern):
        m = re.compile(r"\\p\{\w+\}|\\[sS]|\\?.", re.S).match(pattern, at)
        at, one = m.end(), m[0]
        if one == "\\S":
            if inside:
                return None
            out.append(f"[^{ranges(chr(92) + 's')}]")
        elif one == "\\s" or len(one) > 2:
            out.append(ranges(one) if inside else f"[{ranges(one)}]")
        elif len(one) == 2 and (one[1].isalnum() or one[1] == "_"):
            return None
        else:
            if one == "[" and (inside or pattern[at : at + 1] == "]"):
                return None
            if inside and one in "&~|-" and pattern[at : at + 1] == one:
                return None
            inside = one == "[" or inside and one != "]"
            out.append(one)
    return re.compile("".join(out)) if "(?" not in pattern.replace("(?!", "").replace("(?:", "").replace("(?=", "") else None


class Tokenizer:
    """Encoder of whole texts: each match of ``pattern`` is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = _Pieces(Transducer(ranks))
        every = regex.compile(pattern)
        self.finders = [(spelled_out(pattern, top) or every).findall for top in (1 << 7, 1 << 16)] + [every.findall]
        self.bytes_of = {i: t for t, i in ranks.items()}
        top = max(self.bytes_of, default=-1)
        #: Token bytes by id; ids that the ranks leave out are null.
        self.table = pa.array([self.bytes_of.get(i) for i in range(top + 1)], pa.binary())

    def find(self, text: str) -> list[str]:
        """The pattern's matches, by the pattern for the text's characters."""
        if text.isascii():
            return self.finders[0](text)
        return self.finders[1 if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else 2](text)

    def forget(self) -> None:
        """Empty the memo tables; what was made from the ranks stays."""
        self.pieces.clear()
        self.pieces.transducer.reset()
        self.pieces.transducer.kept.cache_clear()

    def encode_packed(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode_batch(self, ids: pa.Array, offsets: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids (from one offset to the next): all tokens' bytes are gathered at once, each text's go through a machine of its own."""
        if ids.null_count or len(ids) and (pa.compute.min(ids).as_py() < 0 or pa.compute.max(ids).as_py() >= len(self.table)):
            raise ValueError("unknown token id")
        gathered = self.table.take(ids)
        if gathered.null_count:
            raise ValueError("unknown token id")
        ends = np.frombuffer(gathered.buffers()[1], np.int32, len(ids) + 1) if len(ids) else np.zeros(1, np.int32)
        data = memoryview(gathered.buffers()[2] or b"")
        out = []
        for a, b in zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist(), strict=True):
            machine = Utf8Machine()
            parts = [machine.feed(bytes(data[low : min(low + DECODED, b)])) for low in range(a, b, DECODED)]
            out.append("".join([*parts, machine.close()]))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Decoded text as soon as it is whole: one string for each block of ids."""
        machine = Utf8Machine()
        ids = iter(ids)
        get = self.bytes_of.__getitem__
        while block := list(islice(ids, 4096)):
            yield machine.feed(b"".join(map(get, block)))
        yield machine.close()


class Utf8Machine:
    """Incremental UTF-8: its state is the bytes of an unfinished character, three at most; faults become U+FFFD."""

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes can complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 0
                if need <= back:
                    return 0
                if back > 1:  # the second byte of some leads has a narrower range
                    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                    if not low <= data[-back + 1] <= high:
                        return 0
                return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        keep = self.unfinished(data)
        self.open = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer for each rank file and Python worker, until another operator's step runs there."""
    key, held = (path, pattern), held_by("bpe")
    if key not in held:
        held[key] = Tokenizer(load_ranks(path), pattern)
    return held[key]


def forget() -> None:
    """Empty the memo tables of this Python worker's tokenizers: it may idle while others work."""
    for tok in _HELD.get("bpe", {}).values():
        tok.forget()


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids``: the token ids of every whole text; ``decoded`` names a column for the text decoded from them again.

    A map over the rows without a shuffle. Null and empty texts give an empty list (and an empty
    string). Repeated rows stay; other columns pass through, and those named as an output are replaced.
    ``ranks_path`` must exist on every executor.
    """
    outputs = [ids] + ([decoded] if decoded else [])
    kept = [c for c in df.columns if c.lower() not in {o.lower() for o in outputs}]
    hidden = free_name(df, "__text")
    df = bounded(df)
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(hidden))
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType(), False))
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks_path, pattern)
        for whole in batches:
            for batch in slices(whole):
                packed = [tok.encode_packed(t) for t in texts_of(batch, hidden)]
                sizes = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
                columns = [batch.column(c) for c in kept] + [pa.ListArray.from_arrays(pa.array(offsets), values)]
                if decoded:
                    columns.append(pa.array(tok.decode_batch(values, offsets), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *outputs])

    return source.mapInArrow(tidy(run, forget), schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """Replace or add ``text``: what the ids stand for, bytes that are no UTF-8 as U+FFFD. Null ids give an empty string; an unknown id is an error."""
    kept = [c for c in df.columns if c.lower() != text.lower()]
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks_path, pattern)
        for whole in batches:
            for batch in slices(whole):
                lists = batch.column(ids)
                offsets = np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
                texts = tok.decode_batch(lists.flatten(), offsets)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, text])

    return bounded(df).select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(tidy(run, forget), schema)
