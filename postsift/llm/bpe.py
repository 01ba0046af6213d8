"""Byte-level BPE encoding and decoding with the `tokenizers` library over Arrow batches.

The vocabulary is a rank file: one base64 token and its rank per line. Bytes are written as
printable characters (the byte-to-character table of byte-level BPE), merges are derived from the
ranks, and each match of the split pattern is encoded on its own. Decoding maps the characters of
the tokens back to bytes; a character whose bytes are spread over several tokens comes out whole,
as bytes are joined before they are read as UTF-8.

Texts: null counts as empty; an empty text has no tokens. Repeated rows are encoded like any other.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from postsift.llm.common import give_back

SLICE_CHARS = 2_000_000
#: Distinct matches whose ids a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(moved)) for b in range(256)]


def read_ranks(text: bytes) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file's content."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in text.splitlines() if line)}


def _last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that are joined last when `token` is built from its bytes by rank."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        joined = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        i = min(range(len(joined)), key=joined.__getitem__)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """An encoder and decoder for one rank file and one split pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

        ranks = read_ranks(rank_file)
        chars = byte_characters()
        spell = functools.lru_cache(maxsize=None)(lambda token: "".join(chars[b] for b in token))
        merges = [
            tuple(map(spell, _last_pair(token, ranks)))
            for token in sorted(ranks, key=ranks.get) if len(token) > 1
        ]
        model = models.BPE({spell(t): r for t, r in ranks.items()}, merges, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.tokenizer.decoder = decoders.ByteLevel()
        # Matches are independent of each other, so one that came before need not be merged again.
        self.split = regex.compile(pattern)
        self.merge, self.characters = model.tokenize, chars
        self.known: dict[str, list[int]] = {}
        size = max(ranks.values(), default=-1) + 1
        lengths = np.zeros(size + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank + 1] = len(token)
        self.starts = np.cumsum(lengths)
        table = bytearray(int(self.starts[-1]))
        back = {c: b for b, c in enumerate(chars)}
        for token, rank in ranks.items():
            # From characters back to bytes: the table that decoding reads.
            table[self.starts[rank] : self.starts[rank + 1]] = bytes(back[c] for c in spell(token))
        self.table = np.frombuffer(bytes(table), np.uint8)

    def encode(self, texts: list[str], offsets: bool = False) -> list:
        """Ids of each text as uint32 arrays; with `offsets` also (start, end) code points per token."""
        if not offsets:
            return list(map(self._ids, texts))
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [(np.array(e.ids, np.uint32), np.array(e.offsets, np.int64).reshape(-1, 2)) for e in found]

    def _ids(self, text: str) -> np.ndarray:
        pieces, known = self.split.findall(text), self.known
        new = list(set(pieces).difference(known))
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(pieces))
            for piece in new:
                spelled = piece.encode().decode("latin-1").translate(self.characters)
                known[piece] = [token.id for token in self.merge(spelled)]
        return np.fromiter(chain.from_iterable(map(known.__getitem__, pieces)), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids, by gathering each token's bytes."""
        ids = np.asarray(ids, np.int64)
        lengths = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.table[at].tobytes()


_LOADED: dict[str, ByteBpe] = {}


def _codec(rank_file: bytes, pattern: str) -> ByteBpe:
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(rank_file, pattern)
    return _LOADED[key]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _run(docs: DataFrame, rank_file: bytes, pattern: str, text: str, keep: list[str], make, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)  # a vocabulary file, about 1 MB
    # Another name for the text keeps it apart from a kept column of any name.
    narrow = docs.select(*[docs[c] for c in keep], docs[text].alias("bpe text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(keep)])

    def apply(batches):
        give_back()
        codec = _codec(shared.value, pattern)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(len(keep)).to_pylist()]
            for start, end in _slices(texts):
                made = make(codec, texts[start:end])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(start, end - start) for i in range(len(keep))] + list(made.values()),
                    names=[*keep, *made],
                )
        codec.known.clear()  # the worker may serve other stages next
        give_back()

    return narrow.mapInArrow(apply, f"{fields}, {schema}")


def encode(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", keep: list[str] | None = None,
           offsets: bool = False) -> DataFrame:
    """`keep` columns (all but the text by default) and `ids` array<int>; with `offsets` also
    `starts` and `ends` array<int>, the code points of the text that each token covers."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep

    def make(codec, texts):
        found = codec.encode(texts, offsets)
        if not offsets:
            return {"ids": _lists(found)}
        return {
            "ids": _lists([i for i, _ in found]),
            "starts": _lists([o[:, 0] for _, o in found]),
            "ends": _lists([o[:, 1] for _, o in found]),
        }

    more = ", starts array<int>, ends array<int>" if offsets else ""
    return _run(docs, rank_file, pattern, text, keep, make, "ids array<int>" + more)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int32), *[a.astype(np.int32) for a in arrays]])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def decode(tokens: DataFrame, rank_file: bytes, ids: str = "ids") -> DataFrame:
    """Adds `decoded` binary, the bytes of the array `ids` (null: empty), to all other columns."""
    shared = tokens.sparkSession.sparkContext.broadcast(rank_file)
    keep = [c for c in tokens.columns if c != ids]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields if f.name != ids)

    def apply(batches):
        codec = _codec(shared.value, "")
        for batch in batches:
            out = [codec.decode(np.array(i or [], np.int64)) for i in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(out, pa.binary())], names=[*keep, "decoded"]
            )

    return tokens.select(*keep, ids).mapInArrow(apply, ", ".join(filter(None, [fields, "decoded binary"])))


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", key: str = "doc_id",
               with_ids: bool = False) -> DataFrame:
    """`key`, n_tokens, ids_sha256 and decoded_sha256 (with `with_ids` also ids): each text encoded, and
    its ids decoded again."""

    def make(codec, texts):
        found = codec.encode(texts)
        return {
            "n_tokens": pa.array([len(i) for i in found], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in found]),
            "decoded_sha256": pa.array([hashlib.sha256(codec.decode(i)).hexdigest() for i in found]),
            **({"ids": _lists(found)} if with_ids else {}),
        }

    more = ", ids array<int>" if with_ids else ""
    return _run(docs, rank_file, pattern, text, [key], make,
                "n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
