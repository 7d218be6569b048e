"""Token counts that equal those of whole-text encoding, for texts of any length.

A text longer than a chunk is encoded in overlapping chunks with offsets. Two chunks are
spliced where both have a token start at a stable boundary: any character but white space
followed by a space, tab or line feed, where byte-level pre-tokenisation always ends one piece and
starts another whatever stands further away. If an overlap holds no such boundary, it is
widened and its chunk encoded again, at worst up to the end of the text. The chunks of many
texts make one batch for the library.

Texts within one chunk need no splicing. They are cut at the same kind of boundary, and
each distinct segment is encoded once as long as it is remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import add_fields, per_text, utf8, worker_threads

#: Characters of a chunk, and by how many the next one overlaps it at first; characters encoded with offsets in one go, as these take many times more.
CHUNK, OVERLAP, CALL_CHARS = 4096, 64, 250_000
#: Bytes of segments remembered in a worker, about, segments encoded in one go, and characters of the longest one remembered.
MEMORY_BYTES, CALL_SEGMENTS, MEMORY_CHARS = 40_000_000, 20_000, 256
_STABLE = re.compile(r"(?<=\S)(?=[ \t\n])")
_INNER = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s |\x1f")
_CUT = "\x1f"


class _Chunk:
    """The encoding of text[start:end]; positions are those of the whole text."""

    def __init__(self, start: int, end: int, encoding):
        self.start, self.end, self.encoding = start, end, encoding

    def index(self, at: int) -> int:
        """How many tokens start before ``at``, which is a boundary."""
        return self.encoding.char_to_token(at - self.start) if at > self.start else 0

    def starts_token(self, at: int) -> bool:
        token = self.encoding.char_to_token(at - self.start)
        return token is not None and self.encoding.token_to_chars(token)[0] == at - self.start


class Counter:
    """Counts tokens with a tokenizers.Tokenizer; ``chunk`` and ``overlap`` in characters."""

    def __init__(self, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk, overlap
        #: Overlaps that were widened so far, for want of a common boundary.
        self.widened = 0
        #: Tokens of segments, and about how many bytes that takes.
        self.memory: dict[str, int] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[tuple[str, int, int]]) -> list[_Chunk]:
        encoded = self.tokenizer.encode_batch([text[a:b] for text, a, b in pieces], add_special_tokens=False)
        return [_Chunk(a, b, e) for (_, a, b), e in zip(pieces, encoded, strict=True)]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The chunks of a text, at first."""
        return [(a, min(a + self.chunk, len(text))) for a in range(0, max(1, len(text) - self.overlap), self.chunk - self.overlap)]

    def long(self, text: str) -> int:
        return self.spliced(text, self._encode([(text, a, b) for a, b in self.spans(text)]))

    def spliced(self, text: str, chunks: list[_Chunk]) -> int:
        left, *waiting = chunks
        total, since, overlap = 0, 0, self.overlap
        while left.end < len(text):
            while len(waiting) > 1 and waiting[1].start < left.end - self.overlap:
                waiting.pop(0)  # a widened chunk has gone past it
            right = waiting.pop(0) if waiting and waiting[0].end > left.end else self._encode([(text, max(since, left.end - overlap), min(len(text), left.end + self.chunk))])[0]
            at = self._common_start(text, left, right)
            if at is None and right.start > since:
                self.widened += 1
                overlap *= 4
                waiting = [x for x in waiting if x.start > right.end]
                continue
            if at is None:  # no stable boundary since the last splice: the chunk itself has to grow
                left = self._encode([(text, since, min(len(text), 2 * left.end - since))])[0]
                continue
            total += left.index(at) - left.index(since)
            left, since, overlap = right, at, self.overlap
        return total + len(left.encoding) - left.index(since)

    @staticmethod
    def _common_start(text: str, left: _Chunk, right: _Chunk) -> int | None:
        """The first stable boundary in the overlap at which both chunks start a token."""
        for m in _STABLE.finditer(text, right.start + 1, left.end):
            if left.starts_token(m.start()) and right.starts_token(m.start()):
                return m.start()
        return None

    @staticmethod
    def segments(text: str) -> list[str]:
        """``text`` cut before every space that follows a character other than white space."""
        if text[:1] == " " or _ODD.search(text):
            return _INNER.split(text)
        return text.replace(" ", _CUT + " ").split(_CUT)

    def short(self, texts: list[str]) -> list[int]:
        cut = [self.segments(t) for t in texts]
        distinct = set().union(*cut)
        if self.held > MEMORY_BYTES:  # what these texts need is most likely to be needed again
            self.memory = {s: self.memory[s] for s in distinct if s in self.memory}
            self.held = sum(180 + len(s) for s in self.memory)
        new = [s for s in distinct if s not in self.memory]
        for k in range(0, len(new), CALL_SEGMENTS):
            part = new[k : k + CALL_SEGMENTS]
            self.memory.update(zip(part, self.whole(part), strict=True))
        self.held += sum(180 + len(s) for s in new)
        known = self.memory.__getitem__
        counts = [sum(map(known, segments)) for segments in cut]
        for s in new:
            if len(s) > MEMORY_CHARS:
                self.held -= 180 + len(s)
                del self.memory[s]
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of every text."""
        counts = [0] * len(texts)
        long = [k for k, t in enumerate(texts) if len(t) > self.chunk]
        for some in _portions(long, [len(texts[k]) for k in long]):
            cut = [self.spans(texts[k]) for k in some]
            chunks = iter(self._encode([(texts[k], a, b) for k, spans in zip(some, cut, strict=True) for a, b in spans]))
            for k, spans in zip(some, cut, strict=True):
                counts[k] = self.spliced(texts[k], [next(chunks) for _ in spans])
        rest = [k for k, t in enumerate(texts) if len(t) <= self.chunk]
        for k, n in zip(rest, self.short([texts[k] for k in rest]), strict=True):
            counts[k] = n
        return counts


def _portions(items: list[int], sizes: list[int]) -> Iterator[list[int]]:
    """The items in runs of about CALL_CHARS, or of one that is larger."""
    run, held = [], 0
    for item, size in zip(items, sizes, strict=True):
        if run and held + size > CALL_CHARS:
            yield run
            run, held = [], 0
        run.append(item)
        held += size
    if run:
        yield run


def load_tokenizer(path: str):
    """The tokenizer, if it is one for which the stable boundaries hold."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    byte_level = isinstance(tokenizer.pre_tokenizer, ByteLevel) and not tokenizer.pre_tokenizer.add_prefix_space
    added = tokenizer.get_added_tokens_decoder().values()
    if not byte_level or tokenizer.normalizer is not None or any(re.search(r"\s", t.content) or t.lstrip or t.rstrip or t.single_word for t in added):
        raise ValueError("a byte-level tokenizer without normaliser and with plain added tokens is needed")
    return tokenizer


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, threads: int = 1) -> DataFrame:
    """Count bytes and tokens of every text, and tell which exceed ``limit`` tokens.

    ``tokenizer_path`` is a tokenizers file that every executor can read. Adds n_bytes,
    n_tokens, n_chunks (the chunks that a text was cut into, 1 if it was encoded whole) and
    over_limit; columns of those names are replaced. Defined cases: null or
    empty text has 0 bytes and 0 tokens; added tokens written out in a text count as the
    library takes them by default; repeated rows are counted each; an empty table stays
    empty; a text without any white space is encoded in one piece, as its chunk grows to it.
    """

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        worker_threads(threads)
        counter = Counter(load_tokenizer(tokenizer_path))

        def counted(part: pa.Array) -> list[pa.Array]:
            raw = part.to_pylist()
            texts = [t.decode("utf-8", "replace") for t in raw]
            chunks = [max(1, len(counter.spans(t))) for t in texts]
            return [pa.array(x, pa.int64()) for x in ([len(t) for t in raw], counter.count(texts), chunks)]

        return counted

    over = [c for c in docs.columns if c.lower() == "over_limit"]
    counted = add_fields(docs.drop(*over), per_text("n_bytes long, n_tokens long, n_chunks long", make)(utf8("text")), ["n_bytes", "n_tokens", "n_chunks"])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
