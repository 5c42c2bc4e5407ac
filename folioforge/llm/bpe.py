"""Exact BPE encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import array
import functools
import itertools
import json
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, packed, release, sha256_hex, table

#: Words whose ids a worker remembers in each generation, and their characters at most: with both, what it remembers is bounded in bytes.
REMEMBERED, LONGEST = 200_000, 64
#: Rows that are handled, and handed on, together.
TOGETHER = 256
#: Places for the marks of words that came once; cleared when half as many words have been marked.
MARKS = 1 << 20
#: Places of the pair-compatibility table: a pair has one place, and a later pair may take it.
PAIRS = 1 << 20
#: A last character stands for itself plus the end of its word.
_END = 0x4000
_MASK = PAIRS - 1


def byte_characters() -> list[str]:
    """The printable character for each byte value in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b if b in shown else next(spare)) for b in range(256)]


@functools.lru_cache(maxsize=4)
def unlike(raw: str) -> tuple[dict[int, str], dict[str, str]]:
    """Where the vocabulary's own library knows another Unicode version than Python and regex do.

    ({character: its lower case there}, {L, N or O: characters that are letters, numbers or neither there but not here}).  Asked
    of the library character by character, between fixed neighbours; white space is the same in all versions.
    """
    from tokenizers import Regex, Tokenizer
    from tokenizers.pre_tokenizers import Split

    normal = Tokenizer.from_str(raw).normalizer
    split = Split(Regex(next(x["pattern"]["Regex"] for x in json.loads(raw)["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")), "removed", invert=True)
    here = [(k, regex.compile(rf"\p{{{k}}}")) for k in "LN"]
    lower, kinds = {}, {"L": "", "N": "", "O": ""}
    points = [chr(c) for c in range(0x80, 0x32400) if not 0xD800 <= c < 0xE000 and not chr(c).isspace()]
    for part in itertools.batched(points, 20_000):
        there = normal.normalize_str(" ".join(f"a{c}a" for c in part)).split(" ")
        for c, x in zip(part, there, strict=True):
            if x != unicodedata.normalize("NFC", f"a{c}a").replace("Σ", "σ").lower():
                lower[ord(c)] = x[1:-1]
        found = {span for _, span in split.pre_tokenize_str("".join(f" a{c} !{c}" for c in part))}
        for k, c in enumerate(part):
            at = 6 * k
            kind = "L" if (at + 1, at + 3) in found else "O" if (at + 4, at + 6) in found else "N"
            if kind != next((n for n, p in here if p.match(c)), "O"):
                kinds[kind] += c
    return lower, kinds


class _Words(dict):
    """Packed ids of the pieces met, in two generations: what is in use survives when the older one goes.

    Most words come once only, so a word is remembered from its second coming on; before, it leaves a mark by its hash.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary, self.older, self.marks, self.marked = vocabulary, {}, bytearray(MARKS), 0

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            ids = self.vocabulary.encode_word(word)
            found = struct.pack(f"={len(ids)}i", *ids)
            place = hash(word) & (MARKS - 1)
            if len(word) > LONGEST or not self.marks[place]:
                self.marks[place] = 1
                self.marked += 1
                if self.marked > MARKS >> 1:
                    self.marks, self.marked = bytearray(MARKS), 0
                return found
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


class Vocabulary:
    """The merges of a word-end byte-level BPE file (`tokenizers` JSON), as tables for encoding and decoding.

    An id's merges are ranked by the ids themselves: `pair` has the id that two ids merge to, `left` and `right` the two that
    an id was merged from (itself for single characters).  `longest` walks a reversed word once and gives the longest token
    that starts at each position; `shorter` has the longest proper prefix of a token that is a token as well.
    """

    def __init__(self, raw: str, differing: tuple[dict[int, str], dict[str, str]] | None = None) -> None:
        spec = json.loads(raw)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.pair: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            ids = vocab[a], vocab[b], vocab[a + b]
            self.left[ids[2]], self.right[ids[2]] = ids[:2]
            self.pair[ids[:2]] = ids[2]
        symbols = self.symbols = {self._symbols(t): i for t, i in vocab.items()}
        #: Whether two ids may stand side by side, for pairs met so far: the pair, shifted by one, and the answer.
        self.compatibility = array.array("q", bytes(8 * PAIRS))
        self.length = [0] * size
        self.shorter = [-1] * size
        self.longest = ahocorasick.Automaton()
        for s, i in symbols.items():
            self.length[i] = len(s)
            self.longest.add_word(s[::-1], i)
        self.longest.make_automaton()
        for s, i in symbols.items():
            for n in range(len(s) - 1, 0, -1):
                if (found := symbols.get(s[:n])) is not None:
                    self.shorter[i] = found
                    break
        self.bytes_to = dict(enumerate(byte_characters()))
        names = [""] * size
        for t, i in (*vocab.items(), *self.special.items()):
            names[i] = t
        parts = [f" {x}".encode() for x in names]
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.words = _Words(self)
        marks = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None
        # The split pattern of the file; white space is dropped by not matching it.  In ASCII texts it comes to simple ranges.
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.ascii_pieces = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"[\p{N}]", "[0-9]").replace(r"\p{N}", "0-9"), re.ASCII)
        # Texts with a character that the library takes otherwise are split by its classes; a coarse look comes first.
        self.lower, kinds = unlike(raw) if differing is None else differing
        other = "".join(kinds.values())
        either = "".join(map(regex.escape, other)) + "\\0"
        odd = "".join(map(re.escape, sorted({*other, *map(chr, self.lower)})))
        self.maybe_odd = re.compile("[" + "".join(map(re.escape, sorted(c for c in {*other, *map(chr, self.lower)} if c < "\U00010000"))) + "\U00010000-\U0010ffff]")
        self.odd = re.compile(f"[{odd}]") if odd else None
        as_there = {k: rf"[[\p{{{k}}}--[{either}]]" + "".join(map(regex.escape, kinds[k])) + "]" for k in "LN"}
        self.odd_pieces = regex.compile(pattern.replace(r"\p{L}", as_there["L"]).replace(r"\p{N}", as_there["N"]), regex.V1)

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + _END)
        return token

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the boundary between a and b: none that crosses it comes before those that made them."""
        pair, left, right, limit = self.pair, self.left, self.right, 1 << 62
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece.  Linear: a position that failed is marked and never tried again."""
        # Printable ASCII stands for itself in byte-level vocabularies.
        s = word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes_to)
        if self.suffix:
            s = s[:-1] + chr(ord(s[-1]) + _END)
        if (whole := self.symbols.get(s)) is not None:
            return [whole]
        n, length, shorter, table = len(s), self.length, self.shorter, self.compatibility
        # Read backwards, matches end where tokens start; the longest of a place comes first, so it is kept last.
        found = list(self.longest.iter(s[::-1]))
        found.reverse()
        first = dict(found)
        shut, out, at, token, last = set(), [], 0, first[n - 1], -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if end not in shut:
                    if last < 0:
                        break
                    pair = last << 33 | token << 1
                    place = (last * 40503 + token) & _MASK
                    fits = table[place] ^ pair
                    if fits > 1 or fits < 0 or not pair:
                        fits = self.compatible(last, token)
                        table[place] = pair | fits
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last, at, token = token, end, first.get(n - 1 - end, -1)
            else:
                shut.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= length[token]
                token = shorter[token]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for null.  Special tokens in the text become their ids, as in the file's own library."""
        if not text:
            return np.empty(0, np.int32)
        out: list[bytes] = []
        for part in self.marks.split(text) if self.marks and any(m in text for m in self.special) else (text,):
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            pieces = self.ascii_pieces
            if not part.isascii():
                # The library lower-cases each character by itself; str.lower() has a rule of its own for a final sigma.
                part, pieces = unicodedata.normalize("NFC", part).replace("Σ", "σ"), self.pieces
                if self.odd and self.maybe_odd.search(part) and self.odd.search(part):
                    part, pieces = part.translate(self.lower), self.odd_pieces
            out.append(b"".join(map(self.words.__getitem__, pieces.findall(part.lower()))))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of many rows at once: flat ids and the rows' offsets give flat bytes and their offsets.

        The file names no decoder: tokens are joined by one space.  Each token is a slice of one flat table that holds the
        space before it; the first of a row loses it.
        """
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        first = rows[:-1][rows[:-1] < rows[1:]]
        start[first] += 1
        size[first] -= 1
        ends = np.concatenate(([0], np.cumsum(size)))
        gather = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[gather], ends[rows]


_loaded: dict[str, Vocabulary] = {}


class _Shared:
    """A vocabulary for the workers.  Each keeps one, by content, with what it remembers, until it is told to forget it."""

    def __init__(self, spark, path: str) -> None:
        with open(path, encoding="utf-8") as f:  # a vocabulary file of fixed size on the driver
            raw = f.read()
        self.key, self.raw = xxhash.xxh3_128_hexdigest(raw), spark.sparkContext.broadcast((raw, unlike(raw)))

    def get(self) -> Vocabulary:
        if self.key not in _loaded:
            _loaded.clear()
            _loaded[self.key] = Vocabulary(*self.raw.value)
        return _loaded[self.key]

    def forget(self) -> None:
        _loaded.clear()
        release()


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df and the token ids of each whole text (array<int>; none for null or empty), as out or, where df has a column so named, out with a _ after it."""
    shared = _Shared(df.sparkSession, path)

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def of(texts: pa.Array) -> pa.Array:
        vocabulary = shared.get()
        return _encoded(vocabulary, texts)

    return df.withColumn(free(df, out), of(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df and the text of each row's ids (empty for null or none); out of range ids are an error.  Named as in encode()."""
    shared = _Shared(df.sparkSession, path)

    @F.arrow_udf(T.StringType())
    def of(lists: pa.Array) -> pa.Array:
        vocabulary = shared.get()
        return pa.concat_arrays([pa.array([], pa.string()), *(_decoded(vocabulary, lists.slice(at, TOGETHER)) for at in range(0, len(lists), TOGETHER))])

    return df.withColumn(free(df, out), of(F.col(ids)))


def _encoded(vocabulary: Vocabulary, texts: pa.Array) -> pa.Array:
    parts = [vocabulary.encode(x.as_py()) for x in texts]
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.int32)])))


def _decoded(vocabulary: Vocabulary, lists: pa.Array) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    flat, cuts = vocabulary.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends)
    return pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.string())


def coded(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: bool = True) -> DataFrame:
    """encode() and decode() in one pass, TOGETHER rows at a time, so that a worker holds few texts besides those it was handed.

    The text itself goes on if keep says so.  The vocabulary, and what a worker remembers of the words, go at the end of each
    task: the worker may go on to tasks of other operators, beside an executor whose heap is full.
    """
    shared = _Shared(df.sparkSession, path)
    names = free(df, ids), free(df, decoded)
    mine = packed(df) if keep else packed(df, text, _text=F.col(text))

    def run(batches):
        vocabulary = shared.get()
        batch = part = made = None
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(at, TOGETHER)
                    made = _encoded(vocabulary, part["_row"].field(text) if keep else part["_text"])
                    yield pa.RecordBatch.from_arrays([part["_row"], made, _decoded(vocabulary, made)], ["_row", "_ids", "_decoded"])
        finally:
            del vocabulary, batch, part, made
            shared.forget()

    row = mine.schema["_row"]
    out = mine.mapInArrow(run, T.StructType([row, T.StructField("_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("_decoded", T.StringType())]))
    return out.select("_row.*", F.col("_ids").alias(names[0]), F.col("_decoded").alias(names[1]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Null texts count as empty: no tokens, and the hash of nothing twice."""
    path = path or default_path()
    done = coded(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep=False)
    joined = F.coalesce(F.concat_ws(" ", F.col("ids").cast("array<string>")), F.lit(""))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_hex(joined).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """The kept documents with their token ids and the decoded text, as ids and decoded; where docs has such columns, with a _ after the name."""
    path = path or default_path()
    return coded(docs, path)
