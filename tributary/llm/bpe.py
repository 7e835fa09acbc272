"""Operator 1: byte-pair encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so the place between its two
bytes is a certain cut: the fragments on both sides are encoded independently and their ids concatenated.
Spaces and pre-tokens are forced boundaries as well: texts are cut there first, then each pre-token at its impossible
pairs. As fragments repeat, each worker encodes a fragment once and looks it up afterwards.

Edge cases: a null text counts as empty; an empty text gives no ids and decodes to the empty text; repeated
rows are encoded each by itself; an empty table gives an empty result; extra columns are not carried, so their
names cannot clash.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from .shared import documents, file_bytes, tidy, widened

#: Fixed values of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Fixed value: how byte-level vocabularies with use_regex split a text.
_BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MEMO = 150_000
_OTHER_BLANK = re.compile(r"[^\S \n]")
_BEYOND_LATIN = re.compile("[^\x00-\u02ff]")


def _alphabet() -> list[str]:
    spare = iter(range(256, 512))
    own = set(_PRINTABLE)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder for a byte-level BPE vocabulary in the public JSON format."""

    def __init__(self, spec: bytes):
        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.merges, self.models = merges, None
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.byte_level_decoder = (data.get("decoder") or {}).get("type") == "ByteLevel"
        self.lower = any(n["type"] == "Lowercase" for n in (data.get("normalizer") or {}).get("normalizers", []))
        parts = data["pre_tokenizer"].get("pretokenizers", [data["pre_tokenizer"]])
        own = [p["pattern"]["Regex"] for p in parts if p["type"] == "Split"]
        self.split = regex.compile((own[0] if own else _BYTE_LEVEL_PATTERN).replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cut_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.alphabet = _alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.inside, self.closing = self._pairs()
        self.ascii = {b: self.alphabet[b] for b in range(128)}
        self.blank = re.compile(r"(?: |[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]){1,}")
        self.spec, self.library, self.unknown = spec, None, None
        self.rank_coder = self._rank_coder()
        self.memo: dict[str, bytes] = {}
        self.fragments: dict[tuple[str, bool], bytes] = {}

    def _pairs(self) -> tuple[set[str], set[str]]:
        """Neighbours inside tokens: those anywhere, and those whose second symbol carries the end-of-word mark."""
        inside, closing = set(), set()
        for token in self.vocab:
            ends = bool(self.end) and token.endswith(self.end) and token != self.end
            body = token[: len(token) - len(self.end)] if ends else token
            pairs = [body[k : k + 2] for k in range(len(body) - 1)]
            if ends and pairs:
                closing.add(pairs.pop())
            inside.update(pairs)
        return inside, closing if self.end else inside

    def cuts(self, symbols: str) -> list[str]:
        """Fragments of a pre-token between its impossible pairs."""
        if self.inside.issuperset(map(add, symbols[:-2], symbols[1:-1])) and (len(symbols) < 2 or symbols[-2:] in self.closing):
            return [symbols]
        last, start, out = len(symbols) - 2, 0, []
        for k in range(len(symbols) - 1):
            if symbols[k : k + 2] not in (self.closing if k == last else self.inside):
                out.append(symbols[start : k + 1])
                start = k + 1
        out.append(symbols[start:])
        return out

    def _merge(self, fragment: str, final: bool) -> bytes:
        """Merges inside one fragment: the tokenizers library's BPE model, with the end mark only on a final fragment."""
        if self.models is None:
            inner = models.BPE(vocab=self.vocab, merges=self.merges)
            self.models = inner, models.BPE(vocab=self.vocab, merges=self.merges, end_of_word_suffix=self.end) if self.end else inner
        return array("I", [t.id for t in self.models[final].tokenize(fragment)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between two spaces."""
        if self.rank_coder is not None:
            return array("I", self.rank_coder.encode_ordinary(chunk)).tobytes()
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return b"".join([self._word(word) for word in self.split.findall(self.blank.sub(" ", chunk).lower() if self.lower else chunk)])

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. Spaces are forced boundaries, so chunks between them are memoised.

        Where spaces are part of tokens, a run of white space must not be split, and such texts go whole.
        """
        if _BEYOND_LATIN.search(text) and self._unassigned().search(text):
            return b"".join([self._symbols(piece) for piece in self._library_split(text)])
        joined = "" if self.lower else " "
        if joined and ("  " in text or " \n" in text or "\n " in text or text.endswith(" ") or _OTHER_BLANK.search(text)):
            return self._chunk(text)
        memo, out, get, first = self.memo, [], self.memo.get, True
        for chunk in text.split(" "):
            key = chunk if first else joined + chunk
            first = False
            ids = get(key)
            if ids is None:
                ids = self._chunk(key)
                if len(key) <= 64:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    memo[key] = ids
            out.append(ids)
        return b"".join(out)

    def _rank_coder(self) -> tiktoken.Encoding | None:
        """For vocabularies whose ids are their merge ranks and whose tokens are plain bytes, the coder made for those."""
        if self.end or self.lower or len(self.vocab) != max(self.vocab.values()) + 1:
            return None
        ranks = {bytes([self.byte_of[c] for c in t]): i for t, i in self.vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=_BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _unassigned(self) -> re.Pattern:
        """Characters that Python's tables do not know; libraries with newer tables may class or fold them."""
        if self.unknown is None:
            cn = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
            stops = [k for k in range(len(cn)) if k + 1 == len(cn) or cn[k + 1] != cn[k] + 1]
            starts = [0, *(k + 1 for k in stops[:-1])]
            self.unknown = re.compile("[" + "".join(f"\\U{cn[a]:08x}-\\U{cn[b]:08x}" for a, b in zip(starts, stops, strict=True)) + "]")
        return self.unknown

    def _library_split(self, text: str) -> list[str]:
        """Pre-tokens as the tokenizers library normalises and splits the text, in the byte-level alphabet."""
        if self.library is None:
            self.library = Tokenizer.from_buffer(self.spec)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _word(self, word: str) -> bytes:
        return self._symbols(word.translate(self.ascii) if word.isascii() else "".join([self.alphabet[b] for b in word.encode("utf-8", "replace")]))

    def _symbols(self, symbols: str) -> bytes:
        out = []
        pieces = self.cuts(symbols)
        for k, fragment in enumerate(pieces):
            key = (fragment, k == len(pieces) - 1)
            ids = self.fragments.get(key)
            if ids is None:
                ids = self._merge(*key)
                if len(fragment) <= 64:
                    if len(self.fragments) >= _MEMO:
                        self.fragments.clear()
                    self.fragments[key] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut_special is None or "<|" not in text:
            return self._plain(text)
        parts = self.cut_special.split(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def decode(self, ids) -> str:
        """Text of ids, special tokens included; without a byte-level decoder the tokens, with spaces between."""
        tokens = [self.token[i] for i in ids if i in self.token]
        if not self.byte_level_decoder:
            return " ".join(tokens)
        out = bytearray()
        for t in tokens:
            try:
                out += bytes([self.byte_of[c] for c in t])
            except KeyError:
                out += t.encode()
        return out.decode("utf-8", "replace")


_LOADED: dict[int, Bpe] = {}


def loaded(spec: bytes) -> Bpe:
    """One instance for each vocabulary and worker."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED[key] = Bpe(spec)
    return _LOADED[key]


def _lists(chunks: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(c) // 4 for c in chunks), dtype=np.int64, count=len(chunks))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(chunks), dtype="<u4").astype(np.int32)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row. ``vocabulary``: path of a tokenizer file, read once and broadcast (1 to 2 MB)."""
    spec = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists([bpe.encode(t) for t in part.column(1).to_pylist()])], names=[id_col, "ids"])

    return documents(df, id_col, text_col, id_col).mapInArrow(tidy(run), f"`{id_col}` long, ids array<int>")


def decode(df: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """Columns ``keep``, the ids, and ``decoded``: their text, special tokens included. Null ids decode to ''."""
    spec = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))
    source = df.select(*keep, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for part in _slices(batches):
            texts = pa.array([bpe.decode(x.as_py()) for x in part.column(part.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return source.mapInArrow(tidy(run), widened(source, decoded="string"))


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ``decode`` of ``encode`` in one pass, with one Python worker instead of two."""
    spec = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for part in _slices(batches):
            ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
            texts = pa.array([bpe.decode(array("I", x).tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids), texts], names=[id_col, "ids", "decoded"])

    return documents(df, id_col, text_col, id_col).mapInArrow(tidy(run), f"`{id_col}` long, ids array<int>, decoded string")


def digests(spark, sf_dir: str, vocabulary: str) -> DataFrame:
    """Query op1: every document's ids and round trip, as counts and digests."""
    both = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
