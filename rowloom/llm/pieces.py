"""SentencePiece encoding and decoding with a public model.

The marked words of a batch (a run of word marks and what follows up to the next mark; no piece crosses such a border),
distinct and sorted, are walked as a trie, depth first. Each character adds a node that holds the forward state of its
prefix: the last piece of the prefix's best segmentation, from which the rest follows by stepping back. Words that share
a prefix share its nodes, and a node takes a few bytes however long the word is.

A model of kind unigram is Viterbi's: the forward state has the best sum of scores too. A model of kind BPE has no additive
score to maximise: its result is that of its merges in the order of their rank. The forward step therefore takes the one
piece that ends here and that the merges let follow the last piece of the prefix before it (such a segmentation of a prefix
is unique). Other kinds are refused, as are models that rewrite texts or whose pieces cross words. Characters that the
model lacks become the pieces of their UTF-8 bytes, or the unknown piece if it has none for bytes.

Words are found, told apart and put in place of their ids by Arrow; Python sees distinct words alone.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import KEEPING
from .words import pieces as cut

MARK = "▁"
#: Words that a worker keeps between batches, their most characters, and pairs of pieces that it keeps; beyond it they are found again.
KEPT, LONG, PAIRS = 400_000, 64, 600_000
#: Bytes of text that are encoded together.
BATCH = 1 << 20
# Kinds of models, and numbers of fields in their files.
UNIGRAM, BPE = 1, 2
TRAINER, NORMALIZER, KIND, BYTES, UNKNOWN_TEXT, RULES, PREFIX, SQUEEZE, ESCAPE = 2, 3, 3, 35, 44, 2, 3, 4, 5
#: What a character that a unigram model lacks scores below its worst piece.
PENALTY = 10.0
#: Sums of scores that differ by no more are equal.
EQUAL = 1e-6
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
_IRREGULAR = f"^$|^ | $|  |{MARK}"


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def message(data: bytes) -> dict[int, int | bytes]:
    """The fields of a protocol buffer message, the last of each number."""
    found, at = {}, 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        match key & 7:
            case 0:
                found[key >> 3] = varint()
            case kind:
                size = varint() if kind == 2 else 8 if kind == 1 else 4
                found[key >> 3] = data[at : at + size]
                at += size
    return found


class Pieces:
    """Encodes and decodes with the model file at ``path``."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        said = message(model.serialized_model_proto())
        trainer, normalizer = (message(said.get(x, b"")) for x in (TRAINER, NORMALIZER))
        self.kind = trainer.get(KIND, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("the model must be of kind unigram or BPE")
        if normalizer.get(RULES) or normalizer.get(SQUEEZE, 1) or not normalizer.get(PREFIX, 1) or not normalizer.get(ESCAPE, 1):
            raise ValueError("the model must take texts as they are, with a word mark put before")
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.ids, self.byte_ids, self.as_bytes, self.unknown = {}, [0] * 256, [b""] * size, 0
        self.fallback = bool(trainer.get(BYTES, 0))
        for i, x in enumerate(self.text):
            if model.is_byte(i):
                self.byte_ids[int(x[3:5], 16)] = i
                self.as_bytes[i] = bytes([int(x[3:5], 16)])
            elif model.is_unknown(i):
                self.unknown = i
                self.as_bytes[i] = trainer.get(UNKNOWN_TEXT, " ⁇ ".encode())
            elif not (model.is_control(i) or model.is_unused(i)):
                self.ids[x] = i
                self.as_bytes[i] = x.replace(MARK, " ").encode()
        if any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("no piece of the model may cross words")
        lengths: dict[str, set[int]] = {}  # of the pieces that end with three characters
        for x in self.ids:
            lengths.setdefault(x[-3:], set()).add(len(x))
        self.lengths = {x: tuple(sorted(k | {1, 2}, reverse=True)) for x, k in lengths.items()}
        self.rank = {x: -model.get_score(i) for x, i in self.ids.items()}
        self.worst = min((model.get_score(i) for i in self.ids.values()), default=0.0) - PENALTY
        # characters that the model lacks get numbers beyond its own, and the ids of their bytes
        self.numbers = dict(self.ids)
        self.strings, self.bytes_of = list(self.text), [i.to_bytes(4, "little") for i in range(size)]
        self.sizes = [len(x) for x in self.text]
        self.surfaces = pa.array(self.as_bytes, pa.binary())
        self.kept: dict[str, bytes] = {}
        self.follows: dict[int, bool] = {}
        self.stands: dict[str, bool] = {}

    def add_character(self, c: str) -> int:
        n = self.numbers[c] = len(self.strings)
        self.strings.append(c)
        self.sizes.append(1)
        self.bytes_of.append(b"".join(self.byte_ids[x].to_bytes(4, "little") for x in c.encode()) if self.fallback else b"")
        return n

    def merged(self, word: str) -> list[str]:
        """Segmentation by the merges themselves: again and again the pair whose piece ranks first, leftmost among equals."""
        parts = list(word)
        while len(parts) > 1:
            best = min(((self.rank.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1)))
            if best[0] == float("inf"):
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the text of both gives just these two pieces."""
        x, y = self.strings[left], self.strings[right]
        if len(self.follows) >= PAIRS:
            self.follows.clear()
        found = self.follows[left << 32 | right] = self.merged(x + y) == [x, y]
        return found

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, four bytes each, by one walk over the trie of all."""
        out: dict[str, bytes] = {}
        last = array("q")  # of each prefix of the word at hand: its last piece
        sums = array("d", [0.0])  # of each prefix, and of none: its best score
        before, step = "", self.merge_step if self.kind == BPE else self.score_step
        for word in sorted(words):
            at, n = 0, min(len(before), len(word))
            while at < n and before[at] == word[at]:
                at += 1
            del last[at:], sums[at + 1 :]
            step(word, last, sums)
            out[word] = self.ids_of(last, len(word))
            before = word
        return out

    def ids_of(self, last: array, end: int) -> bytes:
        """The ids of a prefix, by stepping back from its last piece; runs of unknown characters are one piece."""
        out, sizes, bytes_of, unknown = [], self.sizes, self.bytes_of, False
        while end:
            p = last[end - 1]
            end -= sizes[p]
            if not (x := bytes_of[p]):
                if unknown:
                    continue
                x = self.unknown.to_bytes(4, "little")
            unknown = not bytes_of[p]
            out.append(x)
        return b"".join(reversed(out))

    def merge_step(self, word: str, last: array, sums: array) -> None:
        """Lengthen the walk to the whole word by pieces that the merges let follow."""
        number, follows, lengths, short = self.numbers.get, self.follows.get, self.lengths.get, (2, 1)
        for e in range(len(last) + 1, len(word) + 1):
            for k in lengths(word[e - 3 : e], short) if e > 2 else short:
                s = e - k
                if s < 0:
                    continue
                p = number(word[s:e])
                if p is None:
                    if k > 1:
                        continue
                    p = self.add_character(word[s:e])
                if s:
                    ok = follows(last[s - 1] << 32 | p)
                    if ok is None:
                        ok = self.may_follow(last[s - 1], p)
                    if not ok:
                        continue
                elif e > 1 and not self.may_stand(word[:e]):
                    continue
                last.append(p)
                break

    def score_step(self, word: str, last: array, sums: array) -> None:
        """Lengthen the walk to the whole word by the pieces whose sums of scores are best; of sums that are equal but for
        rounding, the one with the longest last piece. (The library adds up whole texts in single precision, so among such
        equals its choice depends on the words before.)"""
        number, rank, lengths, short = self.numbers.get, self.rank.get, self.lengths.get, (2, 1)
        for e in range(len(last) + 1, len(word) + 1):
            best = None
            for k in lengths(word[e - 3 : e], short) if e > 2 else short:
                s = e - k
                if s < 0:
                    continue
                score = rank(word[s:e])
                if score is None and k > 1:
                    continue
                total = sums[s] - score if score is not None else sums[s] + self.worst
                if best is None or total > best[0] + EQUAL:
                    best = total, word[s:e]
            p = number(best[1])
            last.append(self.add_character(best[1]) if p is None else p)
            sums.append(best[0])

    def may_stand(self, piece: str) -> bool:
        """Whether merges make this piece of its characters (each piece that they can reach does)."""
        found = self.stands.get(piece)
        if found is None:
            found = self.stands[piece] = self.merged(piece) == [piece]
        return found

    def encode(self, texts: pa.Array, kept: dict[str, bytes]) -> pa.ListArray:
        """The ids of each text (null: null); ``kept`` holds the ids of words already known, by the word without its first mark."""
        words = marked_words(texts)
        coded = words.values.dictionary_encode()
        every = coded.dictionary.to_pylist()
        fresh = [w for w in every if w not in kept]
        if len(kept) + len(fresh) > KEPT:
            here = {w: kept[w] for w in every if w in kept}
            kept.clear()
            kept.update(here)
        found = self.encode_words([MARK + w for w in fresh])
        found = {w: found[MARK + w] for w in fresh}
        kept.update((w, x) for w, x in found.items() if len(w) <= LONG)
        ids = [found[w] if w in found else kept[w] for w in every]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        starts, chosen = np.cumsum(sizes) - sizes, coded.indices.to_numpy(zero_copy_only=False)
        count = sizes[chosen] if len(chosen) else np.zeros(0, np.int64)
        ends = np.cumsum(count)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat((starts[chosen] if len(chosen) else count) - (ends - count), count)
        offsets = np.concatenate(([0], ends))[np.asarray(words.offsets)]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[take] if len(take) else np.zeros(0, np.int32)), mask=texts.is_null())

    def decode(self, ids: pa.ListArray) -> list[str | None]:
        """The text of each list of ids (null: null); bytes that are no UTF-8 become replacement characters."""
        flat = ids.flatten()
        surfaces = self.surfaces.take(flat)
        counts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
        o = np.frombuffer(surfaces.buffers()[1], np.int32, len(surfaces) + 1, surfaces.offset * 4)[counts].tolist() if len(surfaces) else [0] * len(counts)
        raw = surfaces.buffers()[2].to_pybytes() if len(surfaces) and surfaces.buffers()[2] else b""
        # the mark put before a text goes with the first piece that says something
        flat = flat.to_numpy()
        marked = [next((self.text[x].startswith(MARK) for x in flat[s:e] if self.as_bytes[x]), False) for s, e in zip(counts, counts[1:], strict=False)]
        return [raw[s + m : e].decode(errors="replace") if ok else None for s, e, m, ok in zip(o, o[1:], marked, ids.is_valid().to_pylist(), strict=False)]


def marked_words(texts: pa.Array) -> pa.ListArray:
    """The marked words of each text, their first mark left out and spaces as marks. Most texts have one space between words
    and no other; Arrow splits these."""
    odd = pc.fill_null(pc.match_substring_regex(texts, _IRREGULAR), True)
    if not pc.any(odd).as_py():
        return pc.split_pattern(texts, " ")
    one = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    two = pa.array([[w[1:] for w in _WORD.findall(MARK + t.replace(" ", MARK))] if t else [] for t in texts.filter(odd).to_pylist()], pa.list_(texts.type))
    mask = odd.to_numpy(zero_copy_only=False)
    places = np.empty(len(texts), np.int64)
    places[~mask], places[mask] = np.arange(len(one)), len(one) + np.arange(len(two))
    return pa.concat_arrays([one, two]).take(pa.array(places))


_LOADED: dict[str, Pieces] = {}
KEEPING.append(_LOADED)


def loaded(path: str) -> Pieces:
    """The model, read once by each worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoded(batches, path: str, column: str = "text"):
    """(batch, ids of its texts)"""
    model = loaded(path)
    for b in cut(batches, BATCH, column, _LOADED):
        yield b, model.encode(b.column(column), model.kept)


def encode_rows(batches, path: str, carried: list[str]):
    for b, ids in encoded(batches, path):
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), ids], [*carried, "__rl_ids"])


def decode_rows(batches, path: str, carried: list[str]):
    model = loaded(path)
    for b in batches:
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(model.decode(b.column("__rl_ids")), pa.string())], [*carried, "__rl_text"])


def _replaced(df: DataFrame, path: str, column: str, out: str, inner: str, rows, kind: str) -> DataFrame:
    names = [c for c in df.columns if c not in (column, out)]
    safe = [f"__rl_{i}" for i in range(len(names))]
    told = df.select(F.col(f"`{column}`").alias(inner), *(F.col(f"`{n}`").alias(s) for n, s in zip(names, safe, strict=True)))
    made = "__rl_ids" if rows is encode_rows else "__rl_text"
    schema = ", ".join([*(f"{s} {told.schema[s].dataType.simpleString()}" for s in safe), f"{made} {kind}"])
    found = told.mapInArrow(lambda it: rows(it, path, safe), schema)
    return found.select(*(F.col(s).alias(n) for s, n in zip(safe, names, strict=True)), F.col(made).alias(out))


def encode(df: DataFrame, path: str, column: str = "text", out: str = "ids") -> DataFrame:
    """The columns of ``df`` but ``column`` (and but one already named ``out``), and ``out``: the ids of ``column`` (null: null; empty: none)."""
    return _replaced(df, path, column, out, "text", encode_rows, "array<int>")


def decode(df: DataFrame, path: str, column: str = "ids", out: str = "text") -> DataFrame:
    """The columns of ``df`` but ``column`` (and but one already named ``out``), and ``out``: the text of the ids in ``column`` (null: null)."""
    return _replaced(df, path, column, out, "__rl_ids", decode_rows, "string")


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with n_ids, ids and lossless (whether the ids decode to the text; null for a null text) in place of text and of columns of these names."""
    names = [c for c in docs.columns if c not in ("text", "n_ids", "ids", "lossless")]

    def run(batches):
        for b, ids in encoded(batches, path):
            same = [None if t is None else back == t for t, back in zip(b.column("text").to_pylist(), loaded(path).decode(ids), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64()), ids, pa.array(same, pa.bool_())], [*names, "n_ids", "ids", "lossless"])

    schema = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names), "n_ids long, ids array<int>, lossless boolean"])
    return docs.select("text", *(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)


def digest(batches, path: str):
    """A row for each text: ids encoded, then decoded again, and digests of both."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for b, ids in encoded(batches, path):
        raw, ok = ids.flatten().to_numpy().astype("<i4").tobytes(), ids.is_valid().to_pylist()
        n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = (np.cumsum(n) * 4).tolist()
        back = loaded(path).decode(ids)
        marks = [sha(raw[e - 4 * k : e]) if v else None for e, k, v in zip(ends, n.tolist(), ok, strict=True)]
        same = [x == t for x, t in zip(back, b.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(marks, pa.string()), pa.array([x if x is None else sha(x.encode()) for x in back], pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_sha256", "decoded_sha256", "lossless"])


def op2_sentencepiece(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Each of ``documents`` encoded and decoded: number of ids, SHA-256 of the ids (32-bit little-endian) and of the text
    decoded (null for a null text), and whether that is the text."""
    path = path or model_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(lambda it: digest(it, path), "doc_id long, n_ids long, ids_sha256 string, decoded_sha256 string, lossless boolean")
