"""Token counts by overlap resynchronisation.

A text of more than CHUNK characters is encoded in overlapping chunks with offsets. Two neighbours
are spliced at a position inside their overlap that is an edge, where both start a token and agree
on the next AGREE tokens. An edge is a place where the pre-tokenizer starts anew whatever stands
before it, so that what follows depends only on what follows:

* tokenizers that drop white space: after white space, or between a sign (not an apostrophe) and a
  letter, which serves scripts without spaces;
* tokenizers that keep it (byte-level ones, and sentencepiece, whose pieces never cross the start of
  a word): at a single white space before a letter.

Where there is no such position the overlap doubles, if need be to the end of the text. So memory
for encodings is bounded by the chunk wherever a text has edges. Whether splicing gives a
tokenizer's own tokens is tried on a probe when its file is loaded; one that fails encodes all texts whole.

Shorter texts are encoded at once. For a tokenizer that drops white space, counts add up over the
pieces between ASCII white space, so their pieces are looked up in a worker's memory, of at most
CACHE_BYTES, and only new ones are encoded.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows get equal results;
lone surrogates, which no Parquet string can hold, are replaced; an empty table gives an empty one;
other columns, of whatever name, are never read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, AGREE = 32_768, 512, 8
LIMIT = 2048
#: About what a remembered piece takes beside its own bytes, and what all may take.
PIECE_BYTES, CACHE_BYTES = 130, 96 << 20
WHITE = " \t\n\r\x0b\x0c"
PROBE = ("The quick (brown) fox's 12 jumps,\nover  l\u00e4zy d\u00f6gs; it's 3.5 \u6f22\u5b57\u3002\u4eca\u65e5\u306f\uff01ok? \u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 a1b2 foo_bar " * 12).strip()
PIECE = re.compile(r"[^ \t\n\r\x0b\x0c]+")


class Encoder:
    """A tokenizer file with the chunked count; one for each file in a worker."""

    of: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        self.path, self.known, self.held, self.prefixes = path, {}, 0, path.endswith(".model")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.drops_space = False
            self.lengths: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]

            def encode(text: str) -> list[tuple[int, int, int]]:
                data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                chars = np.cumsum((data & 0xC0) != 0x80)  # offsets come in bytes
                at = lambda k: int(chars[k - 1]) if k else 0
                return [(at(x.begin), at(x.end), x.id) for x in model.encode(text, return_type="proto").pieces]

            self.encode = encode
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokens = Tokenizer.from_file(path)
            tokens.no_truncation()
            tokens.no_padding()

            def encode(text: str) -> list[tuple[int, int, int]]:
                e = tokens.encode(text, add_special_tokens=False)
                return [(a, b, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)]

            self.encode = encode
            self.lengths = lambda texts: [len(x) for x in tokens.encode_batch_fast(texts, add_special_tokens=False)]
            blank, one, two, both = self.lengths([" \t\r\n\x0b\x0c ", "spoon", "fork's", "spoon\n fork's"])
            self.drops_space = blank == 0 and both == one + two
        self.splices = [x[2] for x in self.spliced(PROBE, 128, 16)] == [x[2] for x in self.encode(PROBE)]

    @classmethod
    def get(cls, path: str) -> "Encoder":
        if path not in cls.of:
            cls.of[path] = cls(path)
        return cls.of[path]

    def counts(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= chunk or not self.splices]
        if self.drops_space:
            if self.held > CACHE_BYTES:
                self.known.clear()
                self.held = 0
            known, pieces = self.known, [PIECE.findall(texts[i]) for i in short]
            new = list(dict.fromkeys(p for own in pieces for p in own if p not in known))
            for k in range(0, len(new), 8192):
                known.update(zip(new[k:k + 8192], self.lengths(new[k:k + 8192]), strict=True))
            self.held += sum(PIECE_BYTES + len(p) for p in new)
            for i, own in zip(short, pieces, strict=True):
                out[i] = sum(map(known.__getitem__, own))
        else:
            for i, n in zip(short, self.lengths([texts[i] for i in short]), strict=True):
                out[i] = n
        for i, t in enumerate(texts):
            if len(t) > chunk and self.splices:
                out[i] = sum(1 for _ in self.spliced(t, chunk, overlap))
        return out

    def spans(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, id) of the tokens of text[start:end], offsets in the whole text."""
        skip = int(self.prefixes and start > 0 and text[start] == " ")  # a sentencepiece model puts a space of its own before what it is given
        out = [(start + skip + a, start + skip + b, i) for a, b, i in self.encode(text[start + skip:end])]
        if skip and out:
            out[0] = (start, *out[0][1:])
        return out

    def edge(self, text: str, p: int) -> bool:
        """Whether the pre-tokenizer starts anew at p, whatever stands before."""
        before, here = text[p - 1], text[p]
        if self.drops_space:
            return before in WHITE or (here.isalpha() and unicodedata.category(before)[0] in "PS" and before not in "'\u2019")
        return here == " " and before not in WHITE and text[p + 1:p + 2].isalpha()

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int]]:
        """Tokens of the whole text, from overlapping chunks."""
        start, wide = 0, overlap
        end = min(len(text), chunk)
        left = self.spans(text, 0, end)
        while end < len(text):
            begin = max(start, end - wide)
            after = min(len(text), begin + max(chunk, 2 * wide))
            right = self.spans(text, begin, after)
            at = self.boundary(text, left, right, begin, end)
            if at is None:
                wide *= 2
                if begin == start:  # the overlap is all of the left chunk: let that one grow
                    end = min(len(text), end + wide)
                    left = self.spans(text, start, end)
                continue
            yield from (x for x in left if x[0] < at)
            left = [x for x in right if x[0] >= at]
            start, end, wide = at, after, overlap
        yield from left

    def boundary(self, text: str, left: list, right: list, begin: int, end: int) -> int | None:
        """The first edge in (begin, end) where both start a token and agree from there on."""
        i = next((k for k, x in enumerate(left) if x[0] > begin), len(left))
        places = {x[0]: k for k, x in reversed(list(enumerate(right)))}
        for k in range(max(i, 1), len(left) - AGREE):
            p = left[k][0]
            # a token that touches the chunk's end may be cut short, so the agreement stops before it
            if left[k - 1][0] < p and (j := places.get(p)) is not None and left[k:k + AGREE] == right[j:j + AGREE] and left[k + AGREE - 1][1] < end and self.edge(text, p):
                return p
        return None


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs. path: the tokenizer's file on every worker."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                n = encoder.counts([t or "" for t in b.column(2).to_pylist()], chunk, overlap)
                yield pa.record_batch({"doc_id": b.column(0), "n_bytes": b.column(1), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def report(docs: DataFrame) -> DataFrame:
    """The columns of op5."""
    return count(docs)
