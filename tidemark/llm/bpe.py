"""BPE encoding and decoding with forced boundaries.

A merge can only join two bytes that stand side by side inside some token of the vocabulary. Where two neighbouring
bytes of a pre-token never do so, no merge crosses: the place is a certain cut. Pre-tokens are cut there, the fragments
are merged independently of each other, and their ids are concatenated. The result equals that of the whole pre-token.

Pre-tokens never cross white space, so whole white-space separated chunks are kept in a bounded cache per worker.

Defined cases: a null or empty text has no tokens; special tokens' strings in a text become their ids, as the library
does by default; null ids pass through; repeated rows are encoded one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, lean

#: White-space separated chunks, and pre-tokens, that a worker keeps. The first ones stay: frequent words come early.
CHUNKS, PARTS = 250_000, 700_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def little(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit numbers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class ForcedBoundaryBPE:
    """Encoder and decoder for a tokenizers JSON file of BPE over byte letters with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.inner = BPE(vocab, merges)
        self.final = BPE(vocab, merges, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.tokens = [""] * (1 + max(max(vocab.values()), *special.values()))
        for k, v in (vocab | special).items():
            self.tokens[v] = k
        # pairs of byte letters that stand side by side inside a token
        self.pairs = set()
        for token in vocab:
            bare = token.removesuffix(self.suffix)
            self.pairs.update(a + b for a, b in zip(bare, bare[1:], strict=False))
        self.letters = {x: self.library.pre_tokenizer.pre_tokenize_str(chr(x))[0][0] for x in range(33, 127)}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.ascii = re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"))
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def fragments(self, letters: str) -> list[str]:
        """letters, cut at every place where no token can lie across."""
        pairs = self.pairs
        cuts = [i for i in range(1, len(letters)) if letters[i - 1 : i + 1] not in pairs]
        return [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)], strict=True)]

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isprintable():
            parts = self.ascii.findall(chunk)  # printable ASCII bytes are their own letters
        else:
            parts = [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        out, known = [], self.parts
        for part in parts:
            got = known.get(part)
            if got is None:
                *first, last = self.fragments(part)
                ids = [t.id for x in first for t in self.inner.tokenize(x)]
                ids += [t.id for t in self.final.tokenize(last)]
                got = little(ids)
                if len(known) < PARTS and len(part) < 64:
                    known[part] = got
            out.append(got)
        return out[0] if len(out) == 1 else b"".join(out)

    def _plain(self, text: str) -> list[bytes]:
        try:
            text.encode("latin-1")
            easy = not any(x in text for x in "\x1c\x1d\x1e\x1f")
        except UnicodeEncodeError:
            easy = False
        # Latin-1 has no combining marks and lowers letter by letter; the rest goes through the library's normalizer
        chunks = text.lower().split() if easy else self.library.normalizer.normalize_str(text).split(" ")
        cache, out = self.cache, []
        for chunk in chunks:
            got = cache.get(chunk)
            if got is None:
                got = self._chunk(chunk) if chunk else b""
                if len(cache) < CHUNKS and len(chunk) < 64:
                    cache[chunk] = got
            out.append(got)
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if "<|" not in text:
            return b"".join(self._plain(text))
        out: list[bytes] = []
        for x in self.special_split.split(text):
            if x in self.special:
                out.append(self.special[x])
            elif x:
                out += self._plain(x)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """As a tokenizers file without a decoder: the tokens, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def bpe(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (an array of int)."""
    path = vocabulary or default_vocabulary()
    d = keyed(docs, id_col, text_col)

    def run(batches):
        coder = bpe(path)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                ids = [np.frombuffer(coder.encode(x), "<u4").astype("i4") for x in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)]).astype("i4")
                values = pa.array(np.concatenate(ids)) if ids else pa.array([], pa.int32())
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(run), f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text, from arrays of ids; null ids give an empty text."""
    path = vocabulary or default_vocabulary()
    d = tokens.select(tokens[id_col].alias("doc_id"), tokens[ids_col].cast("array<int>").alias("ids"))

    def run(batches):
        coder = bpe(path)
        for b in batches:
            texts = [coder.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return d.mapInArrow(lean(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")


def op2(docs: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """Digests of what encoding and then decoding give; both happen in one pass, and ids stay within the worker."""
    path = vocabulary or default_vocabulary()
    d = keyed(docs)

    def run(batches):
        coder = bpe(path)
        numbers = [str(i) for i in range(len(coder.tokens))]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for k in range(b.num_rows):
                ids = np.frombuffer(coder.encode(b.column(1)[k].as_py()), "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(numbers.__getitem__, ids))))
                text_sha.append(sha(coder.decode(ids)))
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(run), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
