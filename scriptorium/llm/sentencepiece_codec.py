"""SentencePiece encoding and decoding with the tokenizers library.

The model file is parsed as a protobuf and rebuilt: its character map as a normaliser, the
space marker, the pieces with their scores (a unigram model, or a BPE model whose merges
follow from the scores) and byte fallback. Every rebuilt codec is held against the
sentencepiece library on probe texts when it is loaded, and so is every text it encodes: the
segments of a BPE text, between which no piece can reach, each by itself, and texts of
unigram models, whose scores are summed over the whole text, as wholes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Collection, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.common import add_fields, per_text, utf8, worker_threads

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Segments encoded in one go, those that the libraries get as one text, bytes of segments remembered in a worker, about, and characters of the longest one remembered.
CALL_SEGMENTS, JOINED, MEMORY_BYTES, MEMORY_CHARS = 10_000, 100, 100_000_000, 256
PROBES = ("", " ", "a", " a", "a ", "  two  spaces ", "Hello, world!", "line\nbreak\ttab\r\n", "Éçà über ñandú", "日本語 テキスト", "😀👩‍🚀", "<s> </s> <unk> <0x0A>", f"{MARK}mark{MARK}", "\x00\x7f​", "é", "1234567890" * 7, "ﬁ ½ Ⅳ")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                length, at = _varint(data, at)
            else:
                length = {1: 8, 5: 4}[kind]
            value, at = data[at : at + length], at + length
        yield key >> 3, value


class Model:
    """What a SentencePiece model file holds, as far as encoding needs it."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.charsmap = UNIGRAM, b""
        self.byte_fallback, self.suffix_mark = False, False
        self.dummy_prefix = self.squeeze_spaces = self.escape_spaces = True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind = trainer.get(3, UNIGRAM)
                self.byte_fallback = bool(trainer.get(35, 0))
                self.suffix_mark = bool(trainer.get(24, 0))
            elif number == 3:
                norm = dict(_fields(value))
                self.charsmap = norm.get(2, b"")
                self.dummy_prefix, self.squeeze_spaces, self.escape_spaces = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        if self.suffix_mark or not self.escape_spaces:
            raise ValueError("models that mark word ends, or leave spaces as they are, aren't supported")

    def merges(self) -> list[tuple[str, str]]:
        """The pairs that make a piece, best score first."""
        ids = {p: k for k, (p, _, _) in enumerate(self.pieces)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
                found += [(-score, ids[piece], ids[a], ids[b], a, b) for a, b in pairs if a in ids and b in ids]
        return [(a, b) for *_, a, b in sorted(found)]

    def cuts_at_spaces(self) -> bool:
        """Whether no piece goes on after a space that follows something else."""
        return all(MARK not in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))


class Codec:
    """Encodes and decodes as the sentencepiece library does, checked against it."""

    def __init__(self, path: str, data: bytes | None = None):
        import sentencepiece
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        data = data or open(path, "rb").read()
        self.model = model = Model(data)
        names = [p for p, _, _ in model.pieces]
        self.unknown = next(k for k, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
        if model.kind == BPE:
            core = models.BPE({p: k for k, p in enumerate(names)}, model.merges(), unk_token=names[self.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
        elif model.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in model.pieces], self.unknown, model.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are supported")
        self.tokenizer = Tokenizer(core)
        #: The normaliser runs on whole texts, ahead of the cutting into segments.
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normalizer = normalizers.Sequence(steps) if steps else None
        self.tokenizer.normalizer = normalizers.Replace(" ", MARK)
        strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), *([decoders.ByteFallback()] if model.byte_fallback else []), decoders.Fuse(), *strip])
        self.tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER])
        self.segmented = model.cuts_at_spaces() and not any(kind == USER for _, _, kind in model.pieces)
        #: The library's unigram model would take these names in a text for the pieces; such texts go to sentencepiece.
        names = [p for p, _, kind in model.pieces if kind in (UNKNOWN, CONTROL, BYTE)]
        self.reserved = re.compile("|".join(map(re.escape, names))) if model.kind == UNIGRAM else None
        #: What each piece decodes to by itself, behind another one; bytes have none that they could be told by.
        apart = self.tokenizer.token_to_id("a") if self.tokenizer.token_to_id("a") is not None else self.unknown
        lead = len(self.tokenizer.decode([apart], skip_special_tokens=False))
        self.plain = [back[lead:] for back in self.tokenizer.decode_batch([[apart, k] for k in range(len(model.pieces))], skip_special_tokens=False)]
        self.plain = [MARK * 2 if kind in (BYTE, UNKNOWN, CONTROL) else text for text, (_, _, kind) in zip(self.plain, model.pieces, strict=True)]
        self.bytes = frozenset(k for k, (_, _, kind) in enumerate(model.pieces) if kind == BYTE)
        #: The bytes of each piece, and whether it decodes to something else by itself, or by neighbours.
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        self.apart = np.array([r != text.encode() for r, text in zip(self.raw, self.plain, strict=True)])
        self.joinable = model.kind == BPE and self.segmented and model.dummy_prefix
        #: Ids of segments, what the sentencepiece library makes of them, those whose decoding depends on neighbours or differs, and the size of all.
        self.memory: dict[str, bytes] = {}
        self.truth: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.held = 0
        self.again: set[str] = set()  # segments that were needed again since memory was last emptied
        self.oracle = sentencepiece.SentencePieceProcessor(model_proto=data)
        if not all(self.same(PROBES, self.encode(list(PROBES)))):
            raise ValueError(f"{path}: the rebuilt tokenizer does not encode as the model does")

    def same(self, texts, encoded: list[list[int]]) -> list[bool]:
        return [a == b for a, b in zip(self.oracle.encode(list(texts), num_threads=1), encoded, strict=True)]

    def normalize(self, text: str) -> str:
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return text

    def segments(self, text: str) -> list[str]:
        """A normalised text in the parts that are encoded by themselves, the space ahead of it included."""
        if not text:
            return []
        text = (" " if self.model.dummy_prefix else "") + text
        if not self.segmented:
            return [text]
        if text[0] != " " or "  " in text or MARK in text or _CUT in text:
            return _SEGMENT.findall(text)
        return text.replace(" ", _CUT + " ").split(_CUT)[1:]

    def learn(self, distinct: set[str]) -> list[str]:
        """Encode the segments that aren't remembered, by both libraries, and decode them again. Returns the new ones."""
        if self.held > MEMORY_BYTES:
            keep = distinct | self.again if 2 * len(self.again) < len(self.memory) else distinct
            self.memory, self.truth = ({s: m[s] for s in keep if s in m} for m in (self.memory, self.truth))
            self.odd &= self.memory.keys()
            self.held, self.again = _weight(self.memory), set()
        new = list(distinct.difference(self.memory))
        self.again.update(distinct.difference(new))
        # A segment between others is encoded as by itself if no piece can go on into the next one: it begins with a space and doesn't end in one.
        joinable = [s for s in new if s[0] == " " != s[-1] and MARK not in s] if self.joinable else []
        for k in range(0, len(joinable), CALL_SEGMENTS):
            part = joinable[k : k + CALL_SEGMENTS]
            if not self._learn_joined(part):
                self._learn_each(part)
        rest = list(set(new).difference(joinable))
        for k in range(0, len(rest), CALL_SEGMENTS):
            self._learn_each(rest[k : k + CALL_SEGMENTS])
        self.held += _weight(new)
        return new

    def _learn_joined(self, part: list[str]) -> bool:
        """Encode segments many at a time; nothing is learnt if the libraries differ or their tokens don't join to the segments."""
        joined = ["".join(part[k : k + JOINED]) for k in range(0, len(part), JOINED)]
        encoded = self.tokenizer.encode_batch_fast([t.replace(" ", MARK) for t in joined], add_special_tokens=False)
        known = self.oracle.encode([t[1:] for t in joined], num_threads=1)
        if [e.ids for e in encoded] != known:
            return False
        flat = np.fromiter(chain.from_iterable(known), np.int32)
        raw = [s.encode() for s in part]
        ends, token_ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))), self.sizes[flat].cumsum()
        last = np.searchsorted(token_ends, ends)
        if token_ends[-1] != ends[-1] or (token_ends[last] != ends).any() or b"".join(map(self.raw.__getitem__, flat.tolist())) != b"".join(raw):
            return False
        upto = np.concatenate(([0], last + 1))
        ids, cuts = flat.tobytes(), (4 * upto).tolist()
        packed = [(s, ids[a:b]) for s, a, b in zip(part, cuts, cuts[1:], strict=False)]
        self.memory.update(packed)
        self.truth.update(packed)
        # Pieces that decode by themselves to what they stand for have done so in the comparison of bytes.
        apart = np.concatenate(([0], np.cumsum(self.apart[flat])))[upto]
        self._check_decoding([(part[k], flat[upto[k] : upto[k + 1]].tolist()) for k in np.flatnonzero(np.diff(apart)).tolist()])
        return True

    def _learn_each(self, part: list[str]) -> None:
        """Encode segments one by one."""
        ahead = int(self.model.dummy_prefix)
        marked = [s.replace(" ", MARK) for s in part]  # cheaper here than in the library's normaliser, which does the same
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(marked, add_special_tokens=False)]
        known = self.oracle.encode([s[ahead:] for s in part], num_threads=1) if self.model.kind == BPE else encoded
        if " " in part and self.model.kind == BPE and ahead:  # the library puts no space ahead of an empty text
            known[part.index(" ")] = self.oracle.encode("a ")[len(self.oracle.encode("a")) :]
        ends = list(accumulate(map(len, encoded), initial=0))
        flat = array("i", chain.from_iterable(encoded)).tobytes()
        packed = {s: flat[4 * a : 4 * b] for s, a, b in zip(part, ends, ends[1:], strict=False)}
        self.memory.update(packed)
        if known != encoded:
            packed = {s: packed[s] if ids == true else array("i", true).tobytes() for s, ids, true in zip(part, encoded, known, strict=True)}
        self.truth.update(packed)
        # Pieces other than bytes decode one by one, so the library's decoder is asked for the rest only.
        self._check_decoding([(s, ids) for s, ids in zip(part, encoded, strict=True) if "".join(map(self.plain.__getitem__, ids)) != s])

    def _check_decoding(self, rest: list[tuple[str, list[int]]]) -> None:
        """Note the segments whose decoding depends on neighbours or differs."""
        ahead = int(self.model.dummy_prefix)
        backs = self.decode([ids for _, ids in rest])
        self.odd.update(s for (s, ids), back in zip(rest, backs, strict=True) if ids[0] in self.bytes or back != s[ahead:] or MARK in s)

    def forget_long(self, new: list[str]) -> None:
        long = [s for s in new if len(s) > MEMORY_CHARS]
        for s in long:
            del self.memory[s], self.truth[s]
        self.odd.difference_update(long)
        self.held -= _weight(long)

    def encode_packed(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """Of every text its ids, four bytes each, whether decoding gives the normalised text back, and whether the library agrees.

        Distinct segments are encoded once. Where the libraries differ, the ids are those of sentencepiece.
        """
        normal = [self.normalize(t) for t in texts]
        cut = [self.segments(t) for t in normal]
        distinct = set().union(*cut)
        new = self.learn(distinct)
        packed = [b"".join(map(self.memory.__getitem__, segments)) for segments in cut]
        wrong = {s for s in distinct if self.memory[s] is not self.truth[s] and self.memory[s] != self.truth[s]}
        odd = distinct & self.odd
        parity = [wrong.isdisjoint(segments) for segments in cut] if wrong else [True] * len(texts)
        for k, text in enumerate(texts):
            if self.reserved and self.reserved.search(text):
                packed[k] = array("i", self.oracle.encode(text)).tobytes()
            elif self.model.kind != BPE and not self.same([text], [np.frombuffer(packed[k], np.int32).tolist()])[0] or self.normalizer and not self.same_normal(text, normal[k]):
                parity[k] = False
            if not parity[k]:
                packed[k] = array("i", self.oracle.encode(text)).tobytes()
        plain = [parity[k] and (not odd or odd.isdisjoint(segments)) and not (self.reserved and self.reserved.search(texts[k])) for k, segments in enumerate(cut)]
        back = [ok or self.decode([np.frombuffer(packed[k], np.int32).tolist()])[0] == normal[k] for k, ok in enumerate(plain)]
        self.forget_long(new)
        return packed, back, parity

    def same_normal(self, text: str, normal: str) -> bool:
        """Whether the library normalises the text alike; it writes spaces as marks, one of them ahead."""
        ahead = MARK if self.model.dummy_prefix and normal else ""
        return self.oracle.normalize(text).replace(" ", MARK) == (ahead + normal).replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(ids, np.int32).tolist() for ids in self.encode_packed(texts)[0]]

    def decode(self, encoded: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(encoded, skip_special_tokens=False)


#: A run of spaces, written as spaces or as their marks, with what follows up to the next.
_SEGMENT = re.compile(f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+")
_CUT = "\x1f"


def _weight(segments: Collection[str]) -> int:
    """Bytes that remembering segments takes, about."""
    return 350 * len(segments) + 6 * sum(map(len, segments))


def _coded(codec: Codec, texts: list[str], with_ids: bool) -> list[pa.Array]:
    """The columns that encode_documents() adds."""
    packed, back, parity = codec.encode_packed(texts)
    counts = [len(ids) // 4 for ids in packed]
    columns = [
        pa.array(counts, pa.int64()),
        pa.array([hashlib.sha256(ids).hexdigest() for ids in packed], pa.string()),
        pa.array(back, pa.bool_()),
        pa.array(parity, pa.bool_()),
    ]
    if with_ids:
        flat = np.frombuffer(b"".join(packed), np.int32)
        columns.insert(0, pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), flat))
    return columns


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = True, threads: int = 2) -> DataFrame:
    """Encode every text, decode it again and compare.

    ``model_path`` is a SentencePiece model that every executor can read. Adds token_ids
    (if ``with_ids``), n_tokens, ids_sha256 (of the ids as four bytes each, the lowest first), round_trip
    (decoding gives the normalised text back) and parity (the rebuilt tokenizer gives the
    ids of the sentencepiece library, whose ids are taken where it does not).
    Columns of those names are replaced. Defined cases: null is an empty text, which has no
    tokens; names of control pieces in a text are plain text; repeated rows are encoded
    each; an empty table stays empty. A model that the rebuilt tokenizer does not match on
    the probe texts is refused with an error.
    """
    names = ["token_ids"] * with_ids + ["n_tokens", "ids_sha256", "round_trip", "parity"]
    fields = "token_ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, round_trip boolean, parity boolean"

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        worker_threads(threads)
        codec = Codec(model_path)
        return lambda part: _coded(codec, [t.decode("utf-8", "replace") for t in part.to_pylist()], with_ids)

    return add_fields(docs, per_text(fields, make)(utf8("text")), names)
