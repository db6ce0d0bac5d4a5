"""SentencePiece encoding and decoding by batched numpy Viterbi over words of equal length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, ranges, slices, table, utf8
from tessera.llm.pretokens import WordTable

SPACE_MARK = "▁"
UNIGRAM, BPE = 1, 2
START, UNKNOWN = (1 << 22) - 1, 1 << 21
#: Pairs of neighbours whose stability is kept at most; words of one length that advance together at least, fewer go one by one.
PAIRS, FEW = 500_000, 4


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a serialised protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + n]
            at += n


class Pieces:
    """A model file: what each id stands for, and the normal pieces with their scores.

    Fixed values, of the file format: fields of the model (1 piece, 2 trainer, 3 normaliser), of a piece (1 text, 2 score,
    3 type: 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte), of the trainer (3 model type), of the
    normaliser (2 character map, 3 dummy prefix, 4 extra white space removed).
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(proto_fields(f.read()))
        self.text, self.kind, self.score = [], [], []
        self.model, self.prefix = UNIGRAM, True
        trim = True
        for field, value in fields:
            if field == 1:
                p = dict(proto_fields(value))
                self.text.append(p[1].decode())
                self.score.append(float(np.frombuffer(p.get(2, bytes(4)), "<f4")[0]))
                self.kind.append(p.get(3, 1))
            elif field == 2:
                self.model = dict(proto_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                n = dict(proto_fields(value))
                self.prefix, trim = bool(n.get(3, 1)), bool(n.get(4, 1))
                if n.get(2):
                    raise ValueError("models with a character map for normalisation are not supported")
        if trim or {4, 5} & set(self.kind):
            raise ValueError("models that remove white space or have user-defined or unused pieces are not supported")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == 1}
        self.unknown = self.kind.index(2)
        self.bytes = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == 6}
        self.raw = [b"" if k == 3 else bytes([int(t[1:-1], 16)]) if k == 6 else t.replace(SPACE_MARK, " ").encode() for t, k in zip(self.text, self.kind)]


class Viterbi:
    """Best segmentations of many words at once.

    For a unigram model a path's score is the sum of its pieces' scores. For a merge (BPE) model the scores only order the
    merges, and the segmentation that the merges end in is the one path all of whose neighbours are stable: merging the
    two pieces' characters on their own ends in these two pieces. So a step to an unstable neighbour scores minus
    infinity, and the maximum is the merge result exactly. Stability of a pair is found once and kept in sorted keys.
    Where fewer than FEW words have a length, arrays of words gain nothing and the same recurrence runs word by word.
    """

    def __init__(self, ids: dict[str, int], score: list[float], model: int):
        self.ids, self.model = ids, model
        self.rank = {t: score[i] for t, i in ids.items()}
        self.longest = max(map(len, ids))
        texts = list(ids)
        keys = np.array([self.key(t) for t in texts], np.uint64)
        order = np.argsort(keys)
        self.keys, self.of = keys[order], np.array([ids[t] for t in texts])[order]
        self.score = np.array(score)
        self.bad = float(self.score[self.of].min()) - 10
        self.name = {i: t for t, i in ids.items()}
        self.forget()

    def forget(self) -> None:
        self.pairs, self.stable, self.told = np.zeros(0, np.uint64), np.zeros(0, bool), {}

    @staticmethod
    def key(text: str) -> int:
        h = 0
        for c in text:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15 + (h >> 29)) & (2**64 - 1)
        return h

    def piece_text(self, token: int) -> str:
        return self.name[token] if token < UNKNOWN else chr(token - UNKNOWN)

    def merged(self, text: str) -> list[str]:
        """Merge the adjacent pair whose piece has the highest score, the leftmost of equals, until none is a piece."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_stable(self, pair: int) -> bool:
        b = self.piece_text(pair & 0xFFFFFFFF)
        a = [] if pair >> 32 == START else [self.piece_text(pair >> 32)]
        return self.merged("".join(a) + b) == [*a, b]

    def allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        unique, inverse = np.unique(pair, return_inverse=True)
        at = np.searchsorted(self.pairs, unique)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == unique[known]
        if not known.all():
            fresh = unique[~known]
            told = [self.is_stable(p) for p in fresh.tolist()]
            spot = np.searchsorted(self.pairs, fresh)
            self.pairs, self.stable = np.insert(self.pairs, spot, fresh), np.insert(self.stable, spot, told)
            at = np.searchsorted(self.pairs, unique)
        return self.stable[at][inverse]

    def equal_length(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as rows of code points -> the last piece of each prefix and its length."""
        n, length = cp.shape
        best = np.full((length + 1, n), -np.inf)
        last, back = np.full((length + 1, n), START, np.int64), np.zeros((length + 1, n), np.int64)
        best[0] = 0
        piece = {}
        for a in range(length):
            h = np.zeros(n, np.uint64)
            for b in range(a + 1, min(length, a + self.longest) + 1):
                h = (h ^ cp[:, b - 1].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + (h >> np.uint64(29))
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                found = self.keys[at] == h
                if found.any() or b == a + 1:
                    piece[a, b] = np.where(found, self.of[at], UNKNOWN + cp[:, b - 1] if b == a + 1 else -1)
        for b in range(1, length + 1):
            for a in range(max(0, b - self.longest), b):
                if (a, b) not in piece:
                    continue
                token = piece[a, b]
                rows = np.flatnonzero((token >= 0) & np.isfinite(best[a]))
                token = token[rows]
                known = token < UNKNOWN
                if self.model == BPE:
                    gain = np.where(self.allowed(last[a, rows], token), 0.0, -np.inf)
                else:
                    gain = np.where(known, self.score[np.where(known, token, 0)], self.bad)
                value = best[a, rows] + gain
                up = value > best[b, rows]
                rows, token = rows[up], token[up]
                best[b, rows], last[b, rows], back[b, rows] = value[up], token, b - a
        return last, back

    def one_word(self, word: str) -> list[int]:
        """The recurrence of equal_length() for one word."""
        n, ids, told = len(word), self.ids, self.told
        best, last, back = [-np.inf] * (n + 1), [START] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for b in range(1, n + 1):
            for a in range(max(0, b - self.longest), b):
                token = ids.get(word[a:b], UNKNOWN + ord(word[a]) if b == a + 1 else None)
                if token is None or best[a] == -np.inf:
                    continue
                if self.model == BPE:
                    pair = last[a] << 32 | token
                    if pair not in told:
                        told[pair] = self.is_stable(pair)
                    gain = 0.0 if told[pair] else -np.inf
                else:
                    gain = float(self.score[token]) if token < UNKNOWN else self.bad
                if best[a] + gain > best[b]:
                    best[b], last[b], back[b] = best[a] + gain, token, b - a
        out = []
        while n:
            out.append(last[n])
            n -= back[n]
        return out[::-1]

    def segment(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word: ids, or UNKNOWN + code point for a character that is no piece."""
        if len(self.pairs) + len(self.told) > PAIRS:
            self.forget()
        out: list[list[int]] = [[] for _ in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(lengths[lengths > 0]).tolist():
            every = np.flatnonzero(lengths == size)
            if len(every) < FEW:
                for i in every.tolist():
                    out[i] = self.one_word(words[i])
                continue
            most = max(1, min(8_000, 4_000_000 // (size * size + 1)))
            for group in np.split(every, range(most, len(every), most)):
                cp = np.frombuffer("".join(words[i] for i in group.tolist()).encode("utf-32-le"), np.uint32).reshape(len(group), size).astype(np.int64)
                last, back = self.equal_length(cp)
                at, rows = np.full(len(group), size), np.arange(len(group))
                steps = []
                while len(rows):
                    steps.append((rows, last[at[rows], rows]))
                    at[rows] -= back[at[rows], rows]
                    rows = rows[at[rows] > 0]
                who, token = np.concatenate([s[0] for s in steps]), np.concatenate([s[1] for s in steps])
                order = np.lexsort((-np.arange(len(who)), who))
                for w, tokens in zip(group.tolist(), np.split(token[order], np.cumsum(np.bincount(who, minlength=len(group)))[:-1])):
                    out[w] = tokens.tolist()
        # pieces were found by hashes: their texts must be the word
        for i, (word, tokens) in enumerate(zip(words, out)):
            if "".join(map(self.piece_text, tokens)) != word:
                out[i] = self.one_word(word)
        return out


class Codec:
    """Encodes and decodes texts by a model file; the words encoded so far are kept."""

    def __init__(self, path: str):
        self.pieces = p = Pieces(path)
        self.viterbi = Viterbi(p.ids, p.score, p.model)
        self.words = WordTable(self.encode_words, most=500_000)
        # Words end where no piece holds the two characters side by side, so no piece spans two words.
        chars = sorted({c for t in p.ids if len(t) > 1 for c in t})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for t in p.ids:
            for a, b in zip(t, t[1:]):
                self.joined[self.number[ord(a)], self.number[ord(b)]] = True
        size = np.array([len(r) for r in p.raw])
        self.raw, self.raw_size, self.raw_at = np.frombuffer(b"".join(p.raw), np.uint8), size, np.cumsum(size) - size

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out = self.viterbi.segment(words)
        p = self.pieces
        for tokens in out:
            if any(t >= UNKNOWN for t in tokens):
                tokens[:] = [i for t in tokens for i in ([t] if t < UNKNOWN else [p.bytes[b] for b in chr(t - UNKNOWN).encode()] if p.bytes else [p.unknown])]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's number of ids. An empty text has none."""
        prefix = SPACE_MARK if self.pieces.prefix else ""
        marked = [prefix + t.replace(" ", SPACE_MARK) if t else "" for t in texts]
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))))
        text = "".join(marked)
        if not text:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        number = self.number[cp]
        mark = np.ones(len(cp) + 1, bool)
        mark[1:-1] = ~self.joined[number[:-1], number[1:]]
        mark[at] = True
        begin = np.flatnonzero(mark[:-1])
        start, length = self.words.look_up(text, cp, begin, np.append(begin[1:], len(cp)))
        before = np.concatenate(([0], np.cumsum(length)))
        return self.words.flat[ranges(start, length)], np.diff(before[np.searchsorted(begin, at)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids: byte pieces are joined before UTF-8 is read, and the prefix's space goes."""
        size = self.raw_size[ids]
        data = self.raw[ranges(self.raw_at[ids], size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return [t[1:] if self.pieces.prefix and t[:1] == " " else t for t in out]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs with a column piece_ids array<int> (replaced if it is there already): the ids of whole texts, none for null and empty texts.

    One row for each input row, repeated ones too; an empty table gives an empty one; other columns are kept. Texts are
    read 2 MB at a time, a longer one at once; a very long word without a place to cut it takes about 50 us a character.
    """
    columns = [c for c in docs.columns if c != "piece_ids"]
    shape = docs.select(*columns, F.array().cast("array<int>").alias("piece_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        try:
            for batch in batches:
                data, offsets = utf8(batch.column("text"))
                for a, b in slices(offsets, 1 << 19):
                    texts = [data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist())]
                    ids, counts = own.encode(texts)
                    part = batch.slice(a, b - a)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], lists], [*columns, "piece_ids"])
        finally:
            own.words.clear()  # the worker lives on after the task; what is known of pairs (PAIRS at most) serves the next one

    return docs.select(*columns).mapInArrow(lean(run), shape.schema)


def decoded(docs: DataFrame, path: str) -> DataFrame:
    """docs with a column decoded (replaced if it is there already): the text of piece_ids; a null list gives null. U+2581 in a text comes back as a space."""
    columns = [c for c in docs.columns if c != "decoded"]
    shape = docs.select(*columns, F.lit("").cast("string").alias("decoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("piece_ids")
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, ends, texts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(counts))), []
            for a, b in slices(ends, 1 << 18):
                texts += codec(path).decode(ids[ends[a] : ends[b]], counts[a:b])
            out = pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], out], [*columns, "decoded"])

    return docs.select(*columns).mapInArrow(lean(run), shape.schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_xxh64 (hash of the ids), round_trip (the decoded text is the text), decoded_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decoded(encoded(docs, model_path()), model_path())
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_xxh64"), (F.col("decoded") == text).alias("round_trip"), F.sha2("decoded", 256).alias("decoded_sha256"))
