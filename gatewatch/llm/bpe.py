"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

The vocabulary file describes a lower-casing word BPE whose words end in `</w>`. Word counts over all documents pick the
frequent words; these are merged once and compiled into a minimal automaton (states with equal futures are shared) that
numbers its words, and the number leads to the word's ids. It is one flat int32 file, handed to executors by
SparkContext.addFile and memory-mapped there. Words outside it are merged exactly, so the lexicon changes speed, never ids.

Defined cases: a null or empty text has no ids and decodes to the empty text; the special tokens' strings inside a text are
those tokens; repeated rows and null doc_ids each give their row; an empty table gives an empty result and lexicon; columns
other than those asked for are not read. A batch of Arrow rows is encoded at a time, whatever a text's length.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, put, table

#: Words in the lexicon at most, occurrences of a frequent word at least, words kept by a worker between batches.
MAX_WORDS, MIN_COUNT, KEPT = 100_000, 8, 300_000
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokenizer's pattern, for any text and for ASCII.
ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
END, NONE = "</w>", 1 << 40


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: its own where it has one, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Bpe:
    """The vocabulary and its merges, as ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, pairs = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in pairs]
        self.token = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        chars = byte_chars()
        self.inner, self.last = (np.array([vocab[c + end] for c in chars], np.int64) for end in ("", END))
        key = np.array([(vocab[a] << 20) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE if there is none."""
        pair = (left << 20) + right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], NONE)

    def merged(self, found: list[str]) -> list[np.ndarray]:
        """The ids of each word (none empty). In every round each word's lowest-ranked neighbouring pair is merged, the
        leftmost first, all words in step, until no word has one."""
        data = [w.encode() for w in found]
        if not data:
            return []
        length = np.array([len(d) for d in data])
        raw = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(length)
        token = self.inner[raw]
        token[ends - 1] = self.last[raw[ends - 1]]
        rank = np.append(self.ranks(token[:-1], token[1:]), NONE)
        rank[ends - 1] = NONE
        word, out = np.repeat(np.arange(len(data)), length), [None] * len(data)
        while len(token):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(starts, append=len(token))
            if (done := least == NONE).any():
                for w, a, n in zip(word[starts[done]].tolist(), starts[done].tolist(), size[done].tolist()):
                    out[w] = token[a : a + n].astype(np.uint32)
                left = np.repeat(~done, size)
                token, rank, word, least, size = token[left], rank[left], word[left], least[~done], size[~done]
                if not len(token):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            hit = hit[np.diff(word[hit], prepend=-1) != 0]
            token[hit] = self.made[rank[hit]]
            left = np.ones(len(token), bool)
            left[hit + 1] = False
            rank[hit] = NONE
            place = (np.cumsum(left) - 1)[hit]
            token, rank, word = token[left], rank[left], word[left]
            inner = place[np.append(word[1:], -1)[place] == word[place]]
            rank[inner] = self.ranks(token[inner], token[inner + 1])
            before = place[place > 0] - 1
            before = before[word[before] == word[before + 1]]
            rank[before] = self.ranks(token[before], token[before + 1])
        return out

    def ids(self, word: str) -> list[int]:
        return self.merged([word])[0].tolist()

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text in order."""
        if "<|" in text:
            return [w for part in self.cut.split(text) for w in ([part] if part in self.special else words(part))]
        return words(text)


def words(text: str) -> list[str]:
    if text.isascii():
        return ASCII.findall(text.lower())
    return ANY.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


def compile_lexicon(entries: dict[str, np.ndarray]) -> np.ndarray:
    """The minimal automaton of the words, as one int32 array: five lengths, then edges' keys (state * 256 + byte), targets and
    numbers skipped, states' finality, ids' offsets and ids. Words are added in byte order; a state is frozen, and shared with
    an equal one, as soon as no later word can pass through it."""
    ordered = sorted((w.encode(), w) for w in entries)
    register: dict[tuple, int] = {}
    edges: list[tuple] = []  # of frozen states: ((byte, target), ...), final, words below

    def freeze(state: list) -> int:
        key = (tuple(state[0]), state[1])
        if key not in register:
            register[key] = len(edges)
            edges.append((key[0], state[1], state[1] + sum(edges[t][2] for _, t in key[0])))
        return register[key]

    path: list[list] = [[[], False]]  # states along the last word: edges, final
    labels = b""
    for data, _ in ordered:
        common = len(os.path.commonprefix([labels, data]))
        while len(path) > common + 1:
            done = freeze(path.pop())
            path[-1][0].append((labels[len(path) - 1], done))
        path += [[[], False] for _ in data[common:]]
        path[-1][1] = True
        labels = data
    while len(path) > 1:
        done = freeze(path.pop())
        path[-1][0].append((labels[len(path) - 1], done))
    root = freeze(path[0])
    edges[0], edges[root] = edges[root], edges[0]  # the root is state 0
    moved = {0: root, root: 0}
    keys, targets, skips = [], [], []
    for s, (out, final, _) in enumerate(edges):
        skip = int(final)
        for byte, t in out:
            t = moved.get(t, t)
            keys.append(s * 256 + byte)
            targets.append(t)
            skips.append(skip)
            skip += edges[t][2]
    ids = [entries[w] for _, w in ordered]
    offsets = np.cumsum([0, *map(len, ids)])
    finals = [int(e[1]) for e in edges]
    flat = [i for x in ids for i in x.tolist()]
    head = [len(keys), len(finals), len(ids), len(flat), 0]
    return np.array([*head, *keys, *targets, *skips, *finals, *offsets, *flat], np.int32)


class Lexicon:
    """Looks words up in the memory-mapped automaton, all of a batch in step."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int32, mode="r")
        n_edges, n_states, n_words, n_ids, _ = map(int, data[:5])
        cut = np.cumsum([5, n_edges, n_edges, n_edges, n_states, n_words + 1, n_ids])
        self.key, self.target, self.skip, self.final, self.offset, self.flat = (data[a:b] for a, b in zip(cut, cut[1:]))

    def numbers(self, found: list[str]) -> np.ndarray:
        """The number of each word, -1 for words outside."""
        data = [w.encode() for w in found]
        if not data or not len(self.key):
            return np.full(len(data), -1)
        length = np.array([len(d) for d in data])
        start = np.cumsum(length) - length
        raw = np.frombuffer(b"".join(data), np.uint8)
        state, number, alive = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64), np.arange(len(data))
        for at in range(int(length.max())):
            alive = alive[length[alive] > at]
            key = (state[alive] * 256 + raw[start[alive] + at]).astype(np.int32)
            edge = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            there = self.key[edge] == key
            number[alive[~there]], length[alive[~there]] = -1, 0
            alive, edge = alive[there], edge[there]
            number[alive] += self.skip[edge]
            state[alive] = self.target[edge]
        number[(length > 0) & (self.final[state] == 0)] = -1
        return number


_loaded: dict[str, object] = {}


def _once(kind, name: str):
    if name not in _loaded:
        _loaded[name] = kind(SparkFiles.get(name))
    return _loaded[name]


class Encoder:
    """Encodes lists of texts; keeps the ids of words met lately."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon):
        self.bpe, self.lexicon, self.kept = bpe, lexicon, {}

    def ids_of(self, found: list[str]) -> list[np.ndarray]:
        out, asked = [None] * len(found), []
        for i, w in enumerate(found):
            if w in self.bpe.special:
                out[i] = np.array([self.bpe.special[w]], np.uint32)
            elif (ids := self.kept.get(w)) is not None:
                out[i] = ids
            else:
                asked.append(i)
        numbers = self.lexicon.numbers([found[i] for i in asked])
        lo, hi = self.lexicon.offset[numbers], self.lexicon.offset[numbers + 1] if len(numbers) else numbers
        if len(self.kept) + len(asked) > KEPT:
            self.kept.clear()
        flat = np.asarray(self.lexicon.flat).astype(np.uint32) if len(asked) > 1000 else self.lexicon.flat
        for i, n, a, b in zip(asked, numbers.tolist(), lo.tolist(), hi.tolist()):
            if n >= 0:
                out[i] = self.kept[found[i]] = flat[a:b]
        unseen = [i for i, n in zip(asked, numbers.tolist()) if n < 0]
        for i, ids in zip(unseen, self.bpe.merged([found[i] for i in unseen])):
            out[i] = self.kept[found[i]] = ids
        return out

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Flat ids, tokens per text, and per word of the texts its place among the distinct words, their decoded forms, words per text."""
        index: dict[str, int] = {}
        codes, counts = [], []
        for text in texts:
            found = self.bpe.pieces(text)
            codes += [index.setdefault(w, len(index)) for w in found]
            counts.append(len(found))
        ids = self.ids_of(list(index))
        token = self.bpe.token
        decoded = [" ".join([token[i] for i in x.tolist()]) for x in ids]
        length = np.array([len(x) for x in ids], np.int64)
        start = np.cumsum(length) - length
        code, counts = np.array(codes, np.int64), np.array(counts, np.int64)
        each = length[code] if len(code) else np.zeros(0, np.int64)
        ends = np.cumsum(each)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        spread = flat[np.repeat(start[code] - (ends - each), each) + np.arange(int(ends[-1]))] if len(code) else flat
        upto = np.concatenate([[0], ends])[np.cumsum(counts)] if len(counts) else counts
        return spread.astype("<u4"), np.diff(upto, prepend=0), code, decoded, counts

    def documents(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Per text its ids and its decoded form."""
        flat, tokens, code, decoded, counts = self.encode(texts)
        code, at, word = code.tolist(), 0, 0
        for n, k in zip(tokens.tolist(), counts.tolist()):
            yield flat[at : at + n], " ".join([decoded[c] for c in code[word : word + k]])
            at, word = at + n, word + k


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: occurrences of each run of letters, in lower case, over all documents."""
    found = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    return found.filter(F.col("word") != "").groupBy("word").agg(F.count("*").alias("n"))


_shared: set[tuple[str, str]] = set()  # application and name of the files that this driver has handed out


def share(spark: SparkSession, path: str) -> str:
    name = os.path.basename(path)
    if (spark.sparkContext.applicationId, name) not in _shared:  # a name tells the content
        spark.sparkContext.addFile(path)
        _shared.add((spark.sparkContext.applicationId, name))
    return name


def build_lexicon(docs: DataFrame, tokenizer_path: str, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> str:
    """Compiles the most frequent words, at most max_words of them, and returns the shared file's name.

    A histogram of the counts, by sixteenths of a doubling, tells from which count on there are max_words words at most; only
    those come to the driver."""
    spark = docs.sparkSession
    counted = materialize(word_counts(docs).filter(F.col("n") >= min_count).withColumn("bin", F.floor(F.log2("n") * 16).cast("int")), "words")
    room, least = max_words, None
    for r in counted.groupBy("bin").count().orderBy(F.desc("bin")).collect():  # at most 1,024 bins
        room -= r["count"]
        if room < 0:
            break
        least = r["bin"]
    top = [] if least is None else sorted(counted.filter(F.col("bin") >= least).select("word").toArrow()["word"].to_pylist())
    discard(counted)
    data = compile_lexicon(dict(zip(top, Bpe(tokenizer_path).merged(top)))).tobytes()
    return share(spark, put(spark, f"lexicon-{hashlib.sha1(data).hexdigest()[:16]}.bin", data))


def encode(docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ("doc_id",), lexicon: str | None = None, full: bool = False) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 of every text; with full also the ids and the decoded text."""
    name = share(docs.sparkSession, tokenizer_path)
    lexicon = lexicon or build_lexicon(docs, tokenizer_path)
    chosen = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_once(Bpe, name), _once(Lexicon, lexicon))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for ids, text in encoder.documents(part["_text"].to_pylist()):
                    row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    rows.append((*row, ids.astype(np.int32), text) if full else row)
                own = [pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *own], [*keep, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(keep) + len(own)])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the decoded text."""
    return encode(table(spark, sf_dir, "documents"), tokenizer_path())
