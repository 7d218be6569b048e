"""Where the tokens of two tokenizers meet: shared cuts, groups between them, and linked ids.

The ends of the tokens of a byte-level BPE (A) and of a SentencePiece BPE (B) are bits over
the same bytes, packed into words. AND gives the cuts that both share, popcounts before a
cut its rank among the tokens of either side, and so the ranges of tokens between two cuts.
Texts are cut before spaces, where both sides always end a token; each distinct segment is
encoded and aligned once as long as it is remembered, many of them in one pass over bits.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import add_fields, broadcast_if_small, gather, per_text, space_segments, unused, utf8, valid_strings, work_table, worker_threads
from scriptorium.llm.sentencepiece_codec import BPE, BYTE, MARK, USER, Model
from scriptorium.llm.token_counts import load_tokenizer

#: Segments aligned in one go, those that B gets as one text, bytes of segments remembered in a worker, about, and characters of the longest one remembered.
CALL_SEGMENTS, JOINED, MEMORY_BYTES, MEMORY_CHARS = 10_000, 100, 160_000_000, 256


# Bitsets ----------------------------------------------------------------


class Bits:
    """A set of positions, packed into 64-bit words, with the number of members before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    @classmethod
    def of(cls, positions: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-(size + 1) // 64) * 64, np.uint8)
        flags[positions] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def rank(self, positions: np.ndarray) -> np.ndarray:
        """Members up to each position, itself included."""
        word, bit = positions >> 6, (positions & 63).astype(np.uint64)
        upto = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
        return self.before[word] + np.bitwise_count(upto)

    def select(self) -> np.ndarray:
        """All members in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two rising lists of token ends in ``size`` bytes: the cuts both have, and how many tokens of either end up to each."""
    a, b = Bits.of(ends_a, size), Bits.of(ends_b, size)
    cuts = (a & b).select()
    return cuts, a.rank(cuts), b.rank(cuts)


# Tokenizers -------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_level_pieces(tokenizer) -> list[bytes]:
    """The bytes of every id."""
    alphabet = byte_alphabet()
    out = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for token, k in tokenizer.get_vocab().items():
        out[k] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
    return out


def sentence_pieces(model: Model) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]


#: An aligned segment: its groups as text, its links (an A id and a B id in one number each), and how many tokens of A and B (in one number, too).
Aligned = tuple[str, bytes, int]


class Aligner:
    """Aligns texts; ``path_a`` is a tokenizers file, ``path_b`` a SentencePiece model."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.first = load_tokenizer(path_a)
        self.first.encode_special_tokens = True
        data = open(path_b, "rb").read()
        model = Model(data)
        if model.kind != BPE or not model.dummy_prefix or not model.cuts_at_spaces() or any(kind == USER for _, _, kind in model.pieces):
            raise ValueError(f"{path_b}: a BPE model without own pieces that puts a space ahead, and none of whose pieces goes on past a space, is needed")
        self.second = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.pieces = byte_level_pieces(self.first), sentence_pieces(model)
        self.sizes = tuple(np.array([len(p) for p in pieces], np.int64) for pieces in self.pieces)
        # Every id as it is written among the groups: before another one of its side, and as the last of its side; B's come after A's.
        self.written = [f"{k}{mark}" for pieces, last in zip(self.pieces, "|;", strict=True) for k in range(len(pieces)) for mark in (",", last)]
        self.widths = np.array([len(w) for w in self.written], np.int64)
        #: What encoding a space at the end of a text adds; by itself the library makes nothing of it.
        one = self.second.encode("a")
        self.trailing = self.second.encode("a ")[len(one) :]
        #: Segments with what they align to, None where the tokens of one side don't join to the text.
        self.memory: dict[str, Aligned | None] = {}
        self.held = 0
        self.again: set[str] = set()  # segments that were needed again since memory was last emptied

    def learn(self, distinct: set[str]) -> list[str]:
        """Align the segments that aren't remembered; each starts with a space. Returns the new ones."""
        if self.held > MEMORY_BYTES:  # what these texts need, and what was needed again, is most likely to be needed again
            keep = distinct | self.again if 2 * len(self.again) < len(self.memory) else distinct
            self.memory = {s: self.memory[s] for s in keep if s in self.memory}
            self.held, self.again = _weight(self.memory), set()
        new = list(distinct.difference(self.memory))
        self.again.update(distinct.difference(new))
        for k in range(0, len(new), CALL_SEGMENTS):
            part, flat_a = self._encode_first(new[k : k + CALL_SEGMENTS])
            if part:
                self._align(part, flat_a, self._encode_second(part))
        self.held += _weight(new)
        return new

    def _encode_first(self, part: list[str]) -> tuple[list[str], np.ndarray]:
        """The segments whose bytes A keeps, and its ids of them; the others are remembered as having none.

        Segments that end in something other than white space can't reach into the next one, so they make one text.
        """
        part, closed = _closed_first(part)
        joined = self.first.encode_batch_fast(["".join(part[:closed]), *part[closed:]], add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.int64) for e in joined])
        if self._bytes(0, flat) == "".join(part).encode():
            return part, flat
        each = [e.ids for e in self.first.encode_batch_fast(part, add_special_tokens=False)]
        same = [b"".join(map(self.pieces[0].__getitem__, ids)) == s.encode() for s, ids in zip(part, each, strict=True)]
        self.memory.update((s, None) for s, ok in zip(part, same, strict=True) if not ok)
        kept = [(s, ids) for s, ids, ok in zip(part, each, same, strict=True) if ok]
        return [s for s, _ in kept], np.fromiter(chain.from_iterable(ids for _, ids in kept), np.int64)

    def _encode_second(self, part: list[str]) -> np.ndarray:
        """B's ids of all segments in their order, in which those that end in white space come last; the others are joined, as for A."""
        part, closed = _closed_first(part)
        joined = ["".join(part[k : min(k + JOINED, closed)])[1:] for k in range(0, closed, JOINED)]
        ids = self.second.encode(joined, num_threads=1) + self._encode_second_each(part[closed:])
        return np.fromiter(chain.from_iterable(ids), np.int64)

    def _encode_second_each(self, part: list[str]) -> list[list[int]]:
        ids = self.second.encode([s[1:] for s in part], num_threads=1)
        if " " in part:
            ids[part.index(" ")] = self.trailing
        return ids

    def _align(self, part: list[str], flat_a: np.ndarray, flat_b: np.ndarray) -> None:
        """Remember what the segments align to."""
        raw = [s.encode() for s in part]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        ends_a, ends_b = self.sizes[0][flat_a].cumsum(), self.sizes[1][flat_b].cumsum()
        # Whether B's bytes join to the text is told for all segments at once, and if they don't, one by one.
        if not np.isin(ends, ends_b, assume_unique=True).all() or self._bytes(1, flat_b) != b"".join(raw):
            each = self._encode_second_each(part)
            same = [b"".join(map(self.pieces[1].__getitem__, ids)) == text for ids, text in zip(each, raw, strict=True)]
            self.memory.update((s, None) for s, ok in zip(part, same, strict=True) if not ok)
            if any(same):
                own_a = np.repeat(np.array(same), np.diff(np.searchsorted(ends_a, ends), prepend=-1))
                kept = [(s, ids) for s, ids, ok in zip(part, each, same, strict=True) if ok]
                self._align([s for s, _ in kept], flat_a[own_a], np.fromiter(chain.from_iterable(ids for _, ids in kept), np.int64))
            return
        _, rank_a, rank_b = shared_cuts(ends_a, ends_b, int(ends[-1]))
        links = ((flat_a[rank_a - 1] << 32) | flat_b[rank_b - 1]).tobytes()
        # Each group's ids of A, then of B: where they go in one list, and which of them are the last of their side.
        last_a, last_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        last_a[rank_a - 1] = last_b[rank_b - 1] = 1
        size_a, size_b = np.diff(rank_a, prepend=0), np.diff(rank_b, prepend=0)
        marks = np.empty(len(flat_a) + len(flat_b), np.int64)
        marks[np.arange(len(flat_a)) + np.repeat(rank_b - size_b, size_a)] = 2 * flat_a + last_a
        marks[np.arange(len(flat_b)) + np.repeat(rank_a, size_b)] = 2 * (len(self.pieces[0]) + flat_b) + last_b
        text = "".join(map(self.written.__getitem__, marks.tolist()))
        # The ends of segments are cuts, so a segment's groups are those up to the cut at its last token.
        upto_a, upto_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1
        tokens = (np.diff(upto_a, prepend=0) << 32) | np.diff(upto_b, prepend=0)
        chars = [0, *self.widths[marks].cumsum()[upto_a + upto_b - 1].tolist()]
        bytes_ = [0, *(8 * np.searchsorted(rank_a, upto_a) + 8).tolist()]
        rows = zip(part, chars, chars[1:], bytes_, bytes_[1:], tokens.tolist(), strict=False)
        self.memory.update([(s, (text[a : b - 1], links[c:d], n)) for s, a, b, c, d, n in rows])

    def _bytes(self, side: int, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces[side].__getitem__, ids.tolist()))

    def align(self, texts: list[str]) -> list[list[Aligned]]:
        """The aligned segments of each text behind a space; none if it is empty or the tokens of either side don't join to it."""
        aligned, which, bounds = self.align_segments(pa.array(texts, pa.string()))
        return [[aligned[k] for k in which[a:b].tolist()] for a, b in zip(bounds, bounds[1:], strict=False)]

    def align_segments(self, texts: pa.Array) -> tuple[list[Aligned], np.ndarray, np.ndarray]:
        """The distinct segments of all texts aligned, for every segment which of them it is, and where each text's segments start and end."""
        distinct, which, bounds = space_segments(pc.if_else(pc.match_substring(texts, MARK), "", texts))
        new = self.learn(set(distinct))
        aligned = list(map(self.memory.__getitem__, distinct))
        long = [s for s in new if len(s) > MEMORY_CHARS]
        for s in long:
            del self.memory[s]
        self.held -= _weight(long)
        lost = np.array([x is None for x in aligned], bool)
        if lost.any():
            gone = np.diff(np.concatenate(([0], np.cumsum(lost[which])))[bounds]) > 0
            which = which[np.repeat(~gone, np.diff(bounds))]
            bounds = np.concatenate(([0], np.cumsum(np.where(gone, 0, np.diff(bounds)))))
            aligned = [x or ("", b"", 0) for x in aligned]
        return aligned, which, bounds


def _closed_first(part: list[str]) -> tuple[list[str], int]:
    """The segments, those that end in white space last, and how many others there are."""
    still_open = [s for s in part if s[-1].isspace()]
    if not still_open:
        return part, len(part)
    return [s for s in part if not s[-1].isspace()] + still_open, len(part) - len(still_open)


def _weight(segments: Collection[str]) -> int:
    """Bytes that remembering segments takes, about."""
    return 450 * len(segments) + 30 * sum(map(len, segments))


# Tables -----------------------------------------------------------------

FIELDS = "n_a long, n_b long, n_groups long, alignment string, link_a array<int>, link_b array<int>, link_times array<int>"


def _columns(aligner: Aligner, texts: pa.Array) -> list[pa.Array]:
    aligned, which, bounds = aligner.align_segments(texts)
    text, links, tokens = zip(*aligned, strict=True) if aligned else ((), (), ())

    def per_document(of_segments: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(of_segments[which])))[bounds])

    tokens = np.array(tokens, np.int64)
    starts = np.cumsum([0, *map(len, links)]) // 8
    groups = per_document(np.diff(starts))
    alignment = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(text, pa.string()).take(pa.array(which))), ";")
    # Distinct links of every document: document and both ids in one number, sorted.
    codes = gather(np.frombuffer(b"".join(links), np.int64), starts, which)
    size_a, size_b = map(len, aligner.pieces)
    codes, times = np.unique((np.repeat(np.arange(len(groups)), groups) * size_a + (codes >> 32)) * size_b + (codes & 0xFFFFFFFF), return_counts=True)
    rest, b = np.divmod(codes, size_b)
    document, a = np.divmod(rest, size_a)
    ends = pa.array(np.searchsorted(document, np.arange(len(groups) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (a, b, times)]
    return [*(pa.array(x, pa.int64()) for x in (per_document(tokens >> 32), per_document(tokens & 0xFFFFFFFF), groups)), alignment, *lists]


def align_documents(docs: DataFrame, path_a: str, path_b: str, threads: int = 1) -> DataFrame:
    """Align the tokens of two tokenizers in every text.

    A encodes a space and the text, B the text, ahead of which it puts a space itself; names
    of special tokens in a text are plain text to both. Adds n_a, n_b (tokens), n_groups
    (the parts between byte offsets where tokens of both end), alignment (the ids of each
    group, ``a1,a2|b1;a3|b2,b3``), and the distinct links (link_a, link_b, link_times): a link
    joins the A token and the B token that end at one offset, so every group has one, between the
    last tokens of both sides. Columns of those names are replaced. Both files have to be readable
    on every executor. Defined cases: null and empty texts, and texts whose
    joined tokens of either side aren't the text behind its space (a normaliser changed it, or it
    holds the space mark U+2581), have no tokens: zeros, an empty alignment and no links;
    repeated rows are aligned each; an empty table stays empty; a text without spaces is one
    segment.
    """

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        worker_threads(threads)
        aligner = Aligner(path_a, path_b)
        return lambda part: _columns(aligner, valid_strings(part))

    return add_fields(docs, per_text(FIELDS, make)(utf8("text")), [f.split()[0] for f in FIELDS.split(", ")])


def _links(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, link, b, times) of every document's distinct links, both ids in one number."""
    each = rows.select(*keys, F.explode(F.arrays_zip("link_a", "link_b", "link_times")).alias("x"))
    link = F.shiftleft(F.col("x.link_a").cast("long"), 32).bitwiseOR(F.col("x.link_b").cast("long"))
    return each.select(*keys, link.alias("link"), F.col("x.link_b").alias("b"), F.col("x.link_times").alias("times"))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(link, n, best): how many links of all texts join the two ids, and whether no A id has more with that B id."""
    counted = work_table(_links(aligned).groupBy("link", "b").agg(F.sum("times").alias("n")), "link-counts")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def rate_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` with n_links, n_best (links whose count is the highest of their B id, ties included) and count_sum (counts over all links).

    ``aligned`` has the columns of align_documents(); it is written once, as it is read three
    times. A document's distinct links meet the counts in the tasks that read them, while the
    counts are few enough to be sent round, else by a shuffle. Columns of the added names
    are replaced; rows are told apart whatever their ids.
    """
    added = ["n_links", "n_best", "count_sum"]
    key = unused("align_row", aligned)
    kept = [c for c in aligned.columns if c.lower() not in added]
    numbered = work_table(aligned.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias(key)), "aligned")
    counts = broadcast_if_small(work_table(link_counts(numbered), "link-rates"))
    rated = _links(numbered, key).join(counts, "link").groupBy(key)
    rated = rated.agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = numbered.join(rated, key, "left")
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in added])
