"""BPE encoding and decoding with a public tokenizer file, exact for texts of any length, by tree concatenation.

A text of more than `LEAF_TEXT` characters is halved down to leaves of that size, which are encoded as if they stood alone, all
leaves of a batch at once. Going up the tree, each join is repaired: a window of pieces around it is encoded again and
grown until it shares a piece, at the same place and with the same ids, with either side; then the left side, the window and the
right side are spliced at the shared pieces. What a piece is depends on no more than `LOOK` characters after it, so
shared pieces that keep this distance from a cut are those of the whole text. All joins of a level are repaired at once.

A leaf is cut into pieces by the tokenizer's own pattern (pieces.py). The tokenizers library encodes each distinct piece once;
a bounded table of the worker keeps it. A piece of more than `LONG` characters has no splitting point at all and is a tree of its
own, over tokens: BPE output is exact if each pair of neighbouring tokens is, so windows of tokens around the joins grow until
they share a token with either side.

Texts outside the fast path (special-token strings, or characters whose classes may differ between Unicode versions)
go to the library as they are.

Defined results: null counts as empty (no ids, empty text); repeated rows and null ids give a row each; input columns are
kept, so a new column whose name is taken gets `_` added until it is free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces as P
from .common import free_name, table

#: Characters of a leaf of a text, and pieces on either side of a join that are encoded again at first.
LEAF_TEXT, SIDE = 8192, 4
#: A piece and whether it ends are decided by at most so many characters after it.
LOOK = 4
#: Pieces of more characters than this are trees of their own, from leaves of at most LEAF characters and windows of WINDOW tokens.
LONG, LEAF, WINDOW = P.SHORT, 128, 8
#: Entries of a worker's table of pieces; it is emptied when full.
KEPT = 1_500_000
#: Characters of the pieces that are kept as strings: long ones, and those that share a hash.
ODD = 1 << 22
#: Pieces in one call of the library.
AT_ONCE = 500


def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _byte_characters() -> np.ndarray:
    """Code point that stands for each byte in byte-level vocabularies: itself if printable, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return np.array([b if b in shown else next(rest) for b in range(256)], np.uint32)


class Encoder:
    """Encodes and decodes with one tokenizer file; `word` files lower-case texts and drop white space."""

    def __init__(self, path: str, kept: int = KEPT, long: int = LONG, leaf: int = LEAF, leaf_text: int = LEAF_TEXT):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = tokenizer(path)
        self.word = self.tok.normalizer is not None
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.long, self.leaf, self.leaf_text = min(long, LONG), leaf, leaf_text
        self.table = P.Table(kept)
        self.odd, self.odd_chars = {}, 0
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.strings = [""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.strings[i] = s
        self.arrow_strings = pa.array(self.strings, pa.string())
        self.widths = np.array([len(s.removesuffix("</w>") if self.word else s) for s in self.strings], np.int64)
        # the library's own model behind a splitter at new lines, which byte-level text never holds: many pieces in one call
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.letters = _byte_characters()
        self.joins = 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids."""
        sizes = np.array([len(p.encode()) for p in fresh], np.int64)
        shown = self.letters[np.frombuffer("".join(fresh).encode(), np.uint8)]
        ends = np.cumsum(sizes)
        lines = np.insert(shown, ends[:-1], 10).astype("<u4")
        cuts = np.append(np.arange(0, len(fresh), AT_ONCE), len(fresh))
        at = np.append(0, ends) + np.arange(len(fresh) + 1)
        texts = [lines[at[a] : at[b] - 1].tobytes().decode("utf-32-le") for a, b in zip(cuts[:-1], cuts[1:])]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)])
        owner = np.searchsorted(ends, np.cumsum(self.widths[ids]))
        return np.bincount(owner, minlength=len(fresh)), ids

    # ---- tree concatenation of one long piece -------------------------------------------------------------------
    # A token is (id, bytes it covers). Cuts fall between characters; windows are cut at token ends that are
    # character ends too, and grow otherwise.

    def _spans(self, piece: str, ids: np.ndarray) -> np.ndarray:
        """Byte end of each token within the piece."""
        return np.cumsum(self.widths[ids])

    def long_piece(self, piece: str) -> np.ndarray:
        """Ids of a piece without a splitting point."""
        cuts = [0]
        while cuts[-1] < len(piece):
            cuts.append(min(cuts[-1] + self.leaf, len(piece)))
        parts = self._library([piece[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
        points = P.codes_of(piece)
        lengths = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))
        nodes = [(a, b, ids, lengths[a] + self._spans(piece, ids)) for a, b, ids in zip(cuts[:-1], cuts[1:], parts)]
        while len(nodes) > 1:
            nodes = [self._join(piece, lengths, *nodes[k : k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return nodes[0][2]

    def _join(self, piece: str, lengths: np.ndarray, left, right):
        a, m, ids_l, ends_l = left
        _, b, ids_r, ends_r = right
        n = WINDOW
        while True:
            # a window of n tokens on either side, from and to ends of characters
            p = lengths[a] if n >= len(ids_l) else ends_l[len(ids_l) - n - 1]
            q = lengths[b] if n >= len(ids_r) else ends_r[n - 1]
            x, y = np.searchsorted(lengths, [p, q])
            whole = n >= len(ids_l) and n >= len(ids_r)
            if lengths[x] == p and lengths[y] == q:
                ids = self._library([piece[x:y]])[0]
                ends = p + self._spans(piece, ids)
                i = a if n >= len(ids_l) else self._shared(ids_l, ends_l, lengths[a], ids, ends, p, first=True)
                j = b if n >= len(ids_r) else self._shared(ids_r, ends_r, lengths[m], ids, ends, p, first=False)
                if n >= len(ids_l):
                    head, head_ends, start = ids_l[:0], ends_l[:0], 0
                elif i is not None:
                    head, head_ends, start = ids_l[: i[0]], ends_l[: i[0]], i[1]
                if n >= len(ids_r):
                    tail, tail_ends, stop = ids_r[:0], ends_r[:0], len(ids)
                elif j is not None:
                    tail, tail_ends, stop = ids_r[j[0] :], ends_r[j[0] :], j[1]
                if i is not None and j is not None and start <= stop:
                    return a, b, np.concatenate([head, ids[start:stop], tail]), np.concatenate([head_ends, ends[start:stop], tail_ends])
            if whole:  # both sides are in the window and it still does not fit: encode all
                ids = self._library([piece[a:b]])[0]
                return a, b, ids, lengths[a] + self._spans(piece, ids)
            n *= 2

    def _shared(self, side, side_ends, side_start, ids, ends, start, first: bool):
        """Position (in the side, in the window) of a token that both have at the same place."""
        side_begins = np.concatenate([[side_start], side_ends[:-1]])
        begins = np.concatenate([[start], ends[:-1]])
        _, s, w = np.intersect1d(side_begins, begins, return_indices=True)
        ok = (side[s] == ids[w]) & (side_ends[s] == ends[w])
        if self.word:  # the window's last token ends a word, its neighbours in the text may not
            ok &= w < len(ids) - 1
        s, w = s[ok], w[ok]
        if not len(s):
            return None
        k = 0 if first else len(s) - 1
        return int(s[k]), int(w[k])

    # ---- texts ------------------------------------------------------------------------------------------------

    def _pieces(self, text: str, codes: np.ndarray, kinds: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and table row of every piece of the units that begin at `edges`; rows of new pieces are made."""
        begin, end = P.split(codes, kinds, edges, self.word)
        h = P.hashes_of(codes, begin, end)
        rows = np.full(len(h), -1)
        short = np.flatnonzero(end - begin <= P.SHORT)
        rows[short] = self.table.find(h[short], codes, begin[short], end[short])
        new = short[rows[short] == -1]
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            at = new[first]
            counts, ids = self._encode_all([text[x:y] for x, y in zip(begin[at].tolist(), end[at].tolist())])
            self.table.add(h[at], counts, ids, codes, begin[at], end[at])
            rows[new] = self.table.find(h[new], codes, begin[new], end[new])
        # long pieces, and those whose hash another piece has, are told apart as strings
        for k in np.flatnonzero(rows < 0).tolist():
            piece = text[begin[k] : end[k]]
            if piece not in self.odd:
                if self.odd_chars + len(piece) > ODD:
                    self.odd, self.odd_chars = {}, 0
                self.odd[piece] = int(self.table.append(*self._encode_all([piece]))[0])
                self.odd_chars += len(piece)
            rows[k] = self.odd[piece]
        return begin, end, rows

    def _encode_all(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids; pieces of more than `long` characters as trees."""
        if all(len(p) <= self.long for p in fresh):
            return self._encode_new(fresh)
        own = {k: self.long_piece(p) for k, p in enumerate(fresh) if len(p) > self.long}
        short = [p for k, p in enumerate(fresh) if k not in own]
        counts, ids = self._encode_new(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        parts = iter(np.split(ids, np.cumsum(counts)[:-1]) if short else [])
        each = [own[k] if k in own else next(parts) for k in range(len(fresh))]
        return np.array([len(x) for x in each]), np.concatenate(each)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids before each text (one more entry)."""
        if self.table.n > self.table.most or self.table.used > 16 * self.table.most:
            self.table.clear()
            self.odd, self.odd_chars = {}, 0
        whole = "".join(texts)
        special = any(x in whole for x in self.special)
        if self.word:
            lowered = whole.lower()
            if len(lowered) != len(whole):  # some character has more than one small letter; such texts are not plain
                lowered = "".join(t.lower() if len(t.lower()) == len(t) else "\u0130" * len(t) for t in texts)
            whole = lowered
        sizes = np.array([len(t) for t in texts], np.int64)
        stop = np.cumsum(sizes)
        start = stop - sizes
        codes = P.codes_of(whole)
        kinds = P.classes_of(codes)
        hard = np.zeros(len(texts), bool)
        bad = np.flatnonzero(kinds == P.HARD)
        hard[np.searchsorted(stop, bad, side="right")] = True
        if special:
            hard |= np.array([any(x in t for x in self.special) for t in texts])
        if hard.any():
            keep = np.repeat(~hard, sizes)
            codes, kinds = codes[keep], kinds[keep]
            whole = "".join(whole[a:b] for a, b, x in zip(start.tolist(), stop.tolist(), hard.tolist()) if not x)
        easy = np.flatnonzero(~hard)
        size = sizes[easy]
        begins = np.cumsum(size) - size
        rows, owner = self._tree(whole, codes, kinds, begins, size)
        ids, ends = self.table.expand(rows)
        counts = np.zeros(len(texts), np.int64)
        cut = np.searchsorted(owner, np.arange(len(easy) + 1))
        counts[easy] = np.diff(ends[cut])
        if hard.any():
            where = np.flatnonzero(hard)
            own = self._library([texts[k] for k in where])
            for k, x in zip(where, own):
                counts[k] = len(x)
            before = np.append(0, np.cumsum(counts))
            out = np.zeros(before[-1], np.uint32)
            out[np.repeat(~hard, counts)] = ids
            for k, x in zip(where, own):
                out[before[k] : before[k + 1]] = x
            return out, before
        return ids, np.append(0, np.cumsum(counts))

    def _tree(self, whole: str, codes: np.ndarray, kinds: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table row and text of every piece, in order; long texts by leaves and joins."""
        many = np.maximum(-(-sizes // self.leaf_text), 1)
        owner = np.repeat(np.arange(len(sizes)), many)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        edges = begins[owner] + number * self.leaf_text
        begin, end, rows = self._pieces(whole, codes, kinds, edges)
        if not (many > 1).any():
            return rows, np.searchsorted(begins + sizes, begin, side="right")
        last = np.minimum(edges + self.leaf_text, begins[owner] + sizes[owner])
        lo, hi = np.searchsorted(begin, edges), np.searchsorted(begin, last)
        nodes: list[tuple[int, int, int, _Run]] = []
        for k, (t, a, b) in enumerate(zip(owner.tolist(), edges.tolist(), last.tolist())):
            nodes.append((t, a, b, _Run(begin[lo[k] : hi[k]], end[lo[k] : hi[k]], rows[lo[k] : hi[k]])))
        while True:
            pairs, merged, k = [], [], 0
            while k < len(nodes):
                if k + 1 < len(nodes) and nodes[k][0] == nodes[k + 1][0]:
                    pairs.append((len(merged), nodes[k], nodes[k + 1]))
                    merged.append(None)
                    k += 2
                else:
                    merged.append(nodes[k])
                    k += 1
            if not pairs:
                break
            for at, node in self._join_all(whole, codes, kinds, pairs):
                merged[at] = node
            nodes = merged
        out = [node[3].all() for node in nodes]
        return np.concatenate(out), np.repeat(np.array([node[0] for node in nodes]), [len(x) for x in out])

    def _join_all(self, whole, codes, kinds, pairs):
        """Repair the joins of a level: all windows are encoded in one call, those that do not agree yet grow."""
        n = SIDE
        while pairs:
            self.joins += len(pairs)
            windows = []
            for _, (_, a, m, left), (_, _, b, right) in pairs:
                p = left.begin_of_last(n, a)
                q = right.end_of_first(n, b)
                windows.append((p, q))
            size = np.array([q - p for p, q in windows])
            ends = np.cumsum(size)
            at = np.repeat(np.array([p for p, _ in windows]) - (ends - size), size) + np.arange(ends[-1])
            text = "".join([whole[p:q] for p, q in windows])
            begin, end, rows = self._pieces(text, codes[at], kinds[at], ends - size)
            cut = np.searchsorted(begin, np.append(0, ends))
            again = []
            for k, ((place, (t, a, m, left), (_, _, b, right)), (p, q)) in enumerate(zip(pairs, windows)):
                own = slice(cut[k], cut[k + 1])
                move = p - int(ends[k] - size[k])
                x, y, r = begin[own] + move, end[own] + move, rows[own]
                i = 0 if p == a else left.shared(x, y, r, n, m - LOOK, first=True)
                j = len(x) if q == b else right.shared(x, y, r, n, q - LOOK, first=False)
                if i is not None and j is not None and (p == a or j > i):
                    head, tail = left.before(p), right.after(int(x[j]) if j < len(x) else b)
                    yield place, (t, a, b, _Run.of(head, _Run(x[:j], y[:j], r[:j]), tail))
                else:
                    again.append(pairs[k])
            pairs, n = again, 2 * n

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, ends = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The library's decode(ids, skip_special_tokens=False); without a decoder in the file, tokens joined by spaces."""
        if self.tok.decoder is not None:
            return pa.array(self.tok.decode_batch([ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])], skip_special_tokens=False), pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.arrow_strings.take(pa.array(ids))), " ")

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64)
        return self.decode_flat(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.uint32), ends).to_pylist()


class _Run:
    """The pieces of a node in order, as a chain of arrays: a join cuts and links arrays at its place only."""

    __slots__ = ("parts",)

    def __init__(self, begin: np.ndarray, end: np.ndarray, rows: np.ndarray):
        self.parts = [(begin, end, rows)] if len(begin) else []

    @classmethod
    def of(cls, *runs: "_Run") -> "_Run":
        out = cls.__new__(cls)
        out.parts = [part for run in runs for part in run.parts]
        return out

    def begin_of_last(self, n: int, start: int) -> int:
        for begin, _, _ in reversed(self.parts):
            if n <= len(begin):
                return int(begin[-n])
            n -= len(begin)
        return start

    def end_of_first(self, n: int, stop: int) -> int:
        for _, end, _ in self.parts:
            if n <= len(end):
                return int(end[n - 1])
            n -= len(end)
        return stop

    def shared(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, n: int, upto: int, first: bool) -> int | None:
        """Position in the window of its first (last) piece that is also one of the n last (first) pieces here and ends at `upto` at the latest."""
        near, held = [], 0
        for part in reversed(self.parts) if first else self.parts:
            near.append([c[-(n - held) :] if first else c[: n - held] for c in part])
            held += len(part[0])
            if held >= n:
                break
        if not near:
            return None
        if first:
            near.reverse()
        begin, end, rows = (np.concatenate([part[c] for part in near]) for c in range(3))
        at = np.minimum(np.searchsorted(begin, x), len(begin) - 1)
        ok = np.flatnonzero((begin[at] == x) & (end[at] == y) & (rows[at] == r) & (y <= upto))
        return (int(ok[0]) if first else int(ok[-1])) if len(ok) else None

    def before(self, p: int) -> "_Run":
        """What begins before p."""
        out = _Run.of(self)
        while out.parts and out.parts[-1][0][-1] >= p:
            begin, end, rows = out.parts.pop()
            k = int(np.searchsorted(begin, p))
            if k:
                out.parts.append((begin[:k], end[:k], rows[:k]))
        return out

    def after(self, p: int) -> "_Run":
        """What begins at p or later."""
        parts = list(self.parts)
        while parts and parts[0][0][-1] < p:
            parts.pop(0)
        if parts:
            begin, end, rows = parts[0]
            k = int(np.searchsorted(begin, p))
            parts[0] = (begin[k:], end[k:], rows[k:])
        out = _Run.of()
        out.parts = parts
        return out

    def all(self) -> np.ndarray:
        return np.concatenate([part[2] for part in self.parts]) if self.parts else np.zeros(0, np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; its piece table lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def groups(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of about so many characters, one text at least."""
    start = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", ids_as: str = "ids", decoded_as: str = "decoded") -> DataFrame:
    """The input without its text, with the token ids and the text decoded from them."""
    names = [c for c in docs.columns if c != text_col]
    ids_as = free_name(names, ids_as)
    decoded_as = free_name([*names, ids_as], decoded_as)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in it:
            texts = [t or "" for t in b.column(len(names)).to_pylist()]
            for p, q in groups(texts):
                ids, ends = enc.encode_flat(texts[p:q])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.slice(p, q - p).columns[: len(names)], lists, enc.decode_flat(ids, ends)], [*names, ids_as, decoded_as])

    source = docs.select(*names, text_col)
    return source.mapInArrow(batches, ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"`{ids_as}` array<int>", f"`{decoded_as}` string"]))


def digests(done: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, public_path("word_bpe_49k.json")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of the query."""
    done = encode_decode(docs.select("doc_id", "lang", "source", "text"), public_path("word_bpe_49k.json"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
