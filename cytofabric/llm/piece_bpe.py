"""SentencePiece BPE, encoded exactly by backtracking instead of a queue of merges, and decoded."""

from __future__ import annotations

import re
from array import array
from functools import cache
from itertools import accumulate, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, only, slices, table

MARK = "▁"  # stands for a space
_LATIN = "A-Za-zÀ-ɏ"
#: Units that no merge crosses, as no piece does (PieceBPE tests it): marks, then Latin letters only or none.
UNIT = re.compile(f"{MARK}*[{_LATIN}]+|{MARK}*[^{MARK}{_LATIN}]+|{MARK}+")


class Pairs(Remembered):
    """last -> {piece: make(last, piece)}, so that a piece's row is looked up once for all that may follow it. At `most` rows and pairs together all go."""

    class Row(dict):
        def __init__(self, pairs: Pairs, last: str):
            super().__init__()
            self.pairs, self.last = pairs, last

        def __missing__(self, piece: str):
            self.pairs.count()
            value = self[piece] = self.pairs.make(self.last, piece)
            return value

    held = 0

    def count(self) -> None:
        if self.held >= self.most:
            self.clear()
        self.held += 1

    def __missing__(self, last: str) -> Pairs.Row:
        self.count()
        row = self[last] = Pairs.Row(self, last)
        return row

    def clear(self) -> None:
        super().clear()
        self.held = 0


class PieceBPE:
    """The vocabulary of a BPE model with byte fallback and an identity normalizer, and its encoder."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.vocab_size())
        self.pieces = [model.id_to_piece(i) for i in n]
        plain = [i for i in n if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in n if model.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        if len(self.byte) != 256 or any(len(UNIT.findall(p)) != 1 for p in self.id):
            raise ValueError("the model needs byte fallback, and no piece that crosses units")
        # a piece that its own text does not merge to can stand in no encoding
        self.reached = {p for p in self.id if len(p) == 1 or self.merge(p) == [p]}
        self.packed = {p: array("i", [i]).tobytes() for p, i in self.id.items()}
        self.find = ahocorasick.Automaton()
        self.shorter: dict[str, str] = {}  # the next shorter piece that a piece begins with
        for p in self.reached:
            self.find.add_word(p, len(p))
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reached), "")
        self.find.make_automaton()
        self.span = max(map(len, self.reached), default=1)
        self.begun: dict[str, str] = {}  # the longest piece that the text at a node of the automaton begins with
        for p in sorted(self.reached, key=len):
            for k in range(1, len(p) + 1):
                self.begun[p[:k]] = p if k == len(p) else self.begun.get(p[:k]) or self.begun.get(p[: k - 1], "")
        self.fits = Pairs(self.may_follow, 150_000)
        self.units = Remembered(self.unit_ids, 200_000)
        self.text = [p if p in self.id else chr(self.value[i]) if i in self.value else " \u2047 " if model.is_unknown(i) else "" for i, p in enumerate(self.pieces)]
        self.high = np.array([self.value.get(i, 0) >= 128 for i in n])

    def merge(self, text: str) -> list[str]:
        """The merges one by one: the best-scored pair first, of equal ones the leftmost. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i, (a, b) in enumerate(pairwise(parts)):
                s = self.score.get(a + b)
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, last: str, piece: str) -> bool:
        return self.merge(last + piece) == [last, piece]

    def known_pieces(self, text: str) -> list[str]:
        """Of a text all of whose characters are pieces; raises a KeyError or IndexError where one is not."""
        fits, shorter = self.fits, self.shorter  # may a piece follow another: their text merges to these two again
        walk, begun, span = self.find.longest_prefix, self.begun, self.span
        n, p = len(text), begun[text[: walk(text[:span])]]
        failed, out, at = 0, [p], len(p)  # failed: bitfield of positions from which no way goes on
        while at < n:
            ahead = text[at : at + span]
            p = begun[ahead[: walk(ahead)]]
            if out:
                may = fits[out[-1]]
                if failed:
                    while p and (failed >> (at + len(p)) & 1 or not may[p]):
                        p = shorter[p]
                else:
                    while p and not may[p]:
                        p = shorter[p]
            else:
                while p and failed >> len(p) & 1:
                    p = shorter[p]
            while not p:  # nothing that may follow leads on from here: the piece before gives way to a shorter one
                failed |= 1 << at
                p = out.pop()
                at -= len(p)
                may = fits[out[-1]] if out else None
                p = shorter[p]
                while p and (failed >> (at + len(p)) & 1 or may is not None and not may[p]):
                    p = shorter[p]
            out.append(p)
            at += len(p)
        return out

    def unit_pieces(self, unit: str) -> list[str]:
        """Pieces of a unit; characters outside the vocabulary stand alone, nothing merges with them."""
        out, at = [], 0
        for i, c in enumerate(unit):
            if c not in self.id:
                out += self.known_pieces(unit[at:i]) if i > at else []
                out.append(c)
                at = i + 1
        return out + (self.known_pieces(unit[at:]) if at < len(unit) else [])

    def unit_ids(self, unit: str) -> bytes:
        packed = self.packed
        try:
            return b"".join(map(packed.__getitem__, self.known_pieces(unit)))
        except (KeyError, IndexError):  # of a character outside the vocabulary
            return b"".join(packed[p] if p in packed else self.bytes_of(p) for p in self.unit_pieces(unit))

    def bytes_of(self, text: str) -> bytes:
        return array("i", map(self.byte.__getitem__, text.encode())).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers: a space before the text, spaces as marks, no begin or end."""
        return b"".join(map(self.units.__getitem__, UNIT.findall(MARK + text.replace(" ", MARK)))) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        """The text; the space put before it goes. Ids of ASCII bytes are their characters."""
        if len(ids) and self.high[ids].any():
            text = self.decode_bytes(ids.tolist())
        else:
            text = "".join(map(self.text.__getitem__, ids.tolist()))
        return text.removeprefix(MARK).replace(MARK, " ")

    def decode_bytes(self, ids: list[int]) -> str:
        """Runs of byte ids are UTF-8; each byte in them that is not becomes U+FFFD."""
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i in self.value:
                held.append(self.value[i])
                continue
            while held:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[:n]).decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("\ufffd")
                    n = 1
                del held[:n]
            if i >= 0:
                out.append(self.text[i])
        return "".join(out)


@cache
def load(path: str) -> PieceBPE:
    """One for each Python worker. The file must be on every machine, as an installed package's are."""
    return PieceBPE(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def id_lists(raw: list[bytes]) -> pa.ListArray:
    offsets = np.fromiter(accumulate((len(x) // 4 for x in raw), initial=0), np.int32, len(raw) + 1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))


def encode(text: Column, model: str | None = None) -> Column:
    """array<int> of ids for any text; null counts as empty, which has none. Rows are independent."""
    path = model or default_model()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        only(bpe.units, bpe.fits)
        parts = [_encoded(bpe, part) for part in slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, model: str | None = None) -> Column:
    """The text of array<int>; null and no ids give the empty text."""
    path = model or default_model()

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        bpe = load(path)
        parts = [_decoded(bpe, part) for part in slices(lists)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return texts(ids)


def round_trip(text: Column, model: str | None = None) -> Column:
    """struct(ids, decoded): encode() of a text, and decode() of these ids. Where both are wanted, decode(encode(text)) beside encode(text)
    would encode each text twice, as Spark hands Python the inner call once for each of them."""
    path = model or default_model()

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        only(bpe.units, bpe.fits)
        parts = []
        for part in slices(texts):
            ids = _encoded(bpe, part)
            parts.append(pa.StructArray.from_arrays([ids, _decoded(bpe, ids)], names=["ids", "decoded"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))

    return both(text)


def _encoded(bpe: PieceBPE, texts: pa.Array) -> pa.ListArray:
    return id_lists([bpe.encode(t) for t in texts.to_pylist()])


def _decoded(bpe: PieceBPE, lists: pa.ListArray) -> pa.StringArray:
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    null = lists.is_null().to_numpy(zero_copy_only=False)
    return pa.array(["" if null[i] else bpe.decode(flat[at[i] : at[i + 1]]) for i in range(len(lists))], pa.string())


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, the columns in keep, ids, decoded. Repeated rows and null ids stay; other columns are not read."""
    return docs.select(F.col(id_col), *keep, round_trip(F.col(text_col), model).alias("trip_")).select(id_col, *keep, "trip_.ids", "trip_.decoded")


def digests(encoded: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        id_col, *keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents")))
