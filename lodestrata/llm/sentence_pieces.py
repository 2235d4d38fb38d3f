"""SentencePiece encoding that keeps each piece's place in the original text, and decoding.

A text is brought to its normal form by longest-prefix matches in the model's compiled character map, which is walked
for all places of the text at once, a byte a step. Every byte of the normal form keeps the original byte at which the
match that made it began; this alignment projects each piece, whatever the map inserted, dropped or merged before it, to
a span of the original bytes. Pieces themselves come from the library, from the model without its normaliser; their
places in the normal form are sums of their lengths, taken for a group of texts at once.

Rows are independent: nothing is shuffled, and a task holds one group of texts at a time.

Edge cases: null text counts as empty and has no ids; an empty table gives an empty result; rows with the same id or
text get a row each; texts are taken whole; other columns of the input are ignored. A character that the vocabulary
lacks becomes byte pieces, of which the last spans the character and the others are empty; of the pieces that one
original character became, too, the last spans it. Models with user-defined symbols are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, token_cache

MARK = "▁"
ENCODED = "doc_id {}, ids array<int>, begins array<int>, ends array<int>, n_bytes long, covered_bytes long"


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 and the replacements that its leaves point to.

    A unit of the trie holds in bits 0-7 its byte, in bit 8 whether a match ends here, in bits 10-30 the distance to
    its children, times 256 if bit 9 is set; a leaf's lower 31 bits are an offset into the replacements.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.texts = blob[4 + size :]

    def _children(self, units: np.ndarray) -> np.ndarray:
        return (units >> 10) << np.where(units & 512, 8, 0)

    def matches(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start: the length of the longest match, 0 if none, and its leaf's value."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        alive, node, step = np.arange(len(starts)), np.repeat(self._children(self.units[:1]), len(starts)), 0
        while len(alive):
            inside = starts[alive] + step < len(raw)
            alive, node = alive[inside], node[inside]
            byte = raw[starts[alive] + step].astype(np.int64)
            node = node ^ byte
            fits = node < len(self.units)
            alive, node, byte = alive[fits], node[fits], byte[fits]
            unit = self.units[node]
            fits = (unit & ((1 << 31) | 255)) == byte
            alive, node, unit = alive[fits], node[fits], unit[fits]
            node = node ^ self._children(unit)
            step += 1
            ends = (unit >> 8) & 1 == 1
            length[alive[ends]] = step
            value[alive[ends]] = self.units[node[ends]] & ((1 << 31) - 1)
        return length, value

    def _text(self, value: int) -> bytes:
        return self.texts[value : self.texts.index(b"\0", value)]

    def apply(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The replaced bytes, for each the original byte at which its match or character begins, and where leading spaces end."""
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        sizes = np.diff(np.append(starts, len(raw)))
        length, value = self.matches(raw, starts)
        origin = np.repeat(starts, sizes)
        lead = 0
        while lead < len(starts) and (self._text(int(value[lead])) == b" " if length[lead] else raw[starts[lead]] == 32):
            lead = int(np.searchsorted(starts, starts[lead] + max(1, length[lead])))
        lead = int(starts[lead]) if lead < len(starts) else len(raw)
        parts, origins, at = [], [], 0
        for i in np.flatnonzero(length).tolist():
            begin = int(starts[i])
            if begin < at:  # inside the match before
                continue
            text = self._text(int(value[i]))
            parts += [raw[at:begin], np.frombuffer(text, np.uint8)]
            origins += [origin[at:begin], np.full(len(text), begin)]
            at = begin + int(length[i])
        if not parts:
            return raw, origin, lead
        return np.concatenate([*parts, raw[at:]]), np.concatenate([*origins, origin[at:]]), lead


class Pieces:
    """A model's encoder with spans, and its decoder."""

    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("the model has user-defined symbols")
        self.full = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.squeeze, self.escape = spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.prefix = spec.add_dummy_prefix and not model.trainer_spec.treat_whitespace_as_suffix
        self.suffix = spec.add_dummy_prefix and model.trainer_spec.treat_whitespace_as_suffix
        self.space = np.frombuffer((MARK if self.escape else " ").encode(), np.uint8)
        # with byte pieces every id stands for so many bytes of the normal form; without, the library says what it stands for
        self.by_length = model.trainer_spec.model_type == model.trainer_spec.BPE and model.trainer_spec.byte_fallback
        self.byte_values = np.array([int(p.piece[3:5], 16) if p.type == kinds.BYTE else -1 for p in model.pieces])
        self.lengths = np.where(self.byte_values >= 0, 1, [len(p.piece.encode()) for p in model.pieces])
        spec.precompiled_charsmap, spec.name, spec.normalization_rule_tsv = b"", "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def normal(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normal form, and for each of its bytes, and its end, the original byte that it comes from."""
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if self.map is None:
            out, origin = raw, np.arange(len(raw))
            whole = (raw & 0xC0) != 0x80
            origin = origin[whole][np.cumsum(whole) - 1] if len(raw) else origin
            lead = len(raw) - len(text.lstrip(" ").encode("utf-8", "replace")) if self.squeeze else 0
        else:
            out, origin, lead = self.map.apply(raw)
        end, blank = len(raw), out == 32
        if self.squeeze:
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            if len(keep) and blank[0]:
                keep[0] = False
            if not keep.any():
                return b"", np.array([end])
            out, origin, blank = out[keep], origin[keep], blank[keep]
        elif not len(raw):
            return b"", np.array([0])
        first = lead if self.squeeze else 0
        width = len(self.space)
        if self.escape:
            times = np.where(blank, width, 1)
            origin, at = np.repeat(origin, times), np.flatnonzero(np.repeat(blank, times)).reshape(-1, width)
            out = np.repeat(out, times)
            out[at] = self.space
        if self.prefix:
            out, origin = np.concatenate([self.space, out]), np.concatenate([np.full(width, first), origin])
        done = out.tobytes()
        if self.squeeze:
            mark = self.space.tobytes()
            while done.endswith(mark):
                done = done[:-width]
                end = int(origin[len(done)])
        origin = np.append(origin[: len(done)], end)
        if self.suffix:
            done, origin = done + self.space.tobytes(), np.append(origin, np.full(width, end))
        return done, origin

    def _spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of normal forms that stand one after another begin and end, from the pieces' lengths."""
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]
        values = self.byte_values[ids]
        if (values >= 0).any():
            inner = (values & 0xC0) == 0x80
            inner &= values >= 0
            begins = np.maximum.accumulate(np.where(inner, 0, begins))  # a character's later bytes begin where it does
            ends = np.where((values >= 0) & np.append(inner[1:], False), begins, ends)
        return begins, ends

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text its ids, and the original bytes at which each piece begins and ends."""
        forms = [self.normal(t) for t in texts]
        plain = [f.decode() for f, _ in forms]
        if not self.by_length:
            got = [p.pieces for p in self.bare.encode(plain, return_type="proto", num_threads=1)]
            return [tuple(a if k == "id" else origin[a] for k in ("id", "begin", "end") for a in [np.array([getattr(x, k) for x in p], np.int64)]) for (_, origin), p in zip(forms, got)]
        parts = [np.asarray(x, np.int32) for x in self.bare.encode(plain, return_type="numpy", num_threads=1)]
        if not parts:
            return []
        cuts = np.cumsum([len(p) for p in parts])
        ids = np.concatenate(parts)
        begins, ends = self._spans(ids)
        text = np.repeat(np.arange(len(parts)), [len(p) for p in parts])  # each form is followed by its end
        origin = np.concatenate([o for _, o in forms])
        begins, ends = (np.split(origin[x + text], cuts[:-1]) for x in (begins, ends))
        return list(zip(parts, begins, ends))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.full.decode(ids, num_threads=1)


@lru_cache(maxsize=2)
def _pieces(blob: bytes) -> Pieces:
    return Pieces(blob)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]).astype(np.int32)))


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per row: doc_id, ids, begins and ends (bytes of the UTF-8 text), n_bytes, and how many of them the spans cover.

    With ``decoded`` also what the library makes of the ids.
    """
    blob = token_cache.TokenizerFile(model_path).blob

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(blob)
        for b in batches:
            at = 0
            for group in token_cache.groups([t or "" for t in b.column(1).to_pylist()]):
                got = model.encode(group)
                columns = [b.column(0).slice(at, len(group)), *(_lists([g[k] for g in got]) for k in range(3))]
                columns.append(pa.array([len(t.encode("utf-8", "replace")) for t in group], pa.int64()))
                columns.append(pa.array([int((e - s).sum()) for _, s, e in got], pa.int64()))
                names = ["doc_id", "ids", "begins", "ends", "n_bytes", "covered_bytes"]
                if decoded:
                    columns.append(pa.array(model.decode([g[0].tolist() for g in got]), pa.string()))
                    names.append("decoded")
                at += len(group)
                yield pa.record_batch(columns, names=names)

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
    schema = ENCODED.format(narrow.schema[0].dataType.simpleString()) + (", decoded string" if decoded else "")
    return narrow.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, *, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """The rows with the text that their ids stand for; null ids decode to null, none to the empty text."""
    blob = token_cache.TokenizerFile(model_path).blob

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        there = [i for i, x in enumerate(ids) if x is not None]
        out: list[str | None] = [None] * len(ids)
        for i, t in zip(there, _pieces(blob).decode([[int(v) for v in ids.iloc[i]] for i in there])):
            out[i] = t
        return pd.Series(out, dtype=object)

    return rows.withColumn(name, text(F.col(ids_col)))


def op13_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = encode(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_bytes", "covered_bytes"
    )
