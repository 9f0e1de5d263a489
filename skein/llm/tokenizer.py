"""Byte-level BPE as a deterministic automaton over tokens (problem 8)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = 1 << 30
CACHED_WORDS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeAutomaton:
    """The automaton whose paths are exactly the token sequences that the merges produce.

    It starts with one state and an arc for each byte. The gadget of merge number r, (u, v) -> w, takes the arcs on v
    away from the states entered by u and gives the states before them an arc on w. A state is known by the token that
    enters it. Which arcs the gadgets have taken from it follows from the pieces that end its token, each with the
    number of the merge that uses it up, and from the pieces that begin the arc's token, so the 50k x 50k arcs are
    never laid out: ``gadgets[u][v]`` has each gadget's number, and arcs once decided are kept in ``arcs``.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], pattern: str):
        import regex

        self.ids = vocabulary
        self.split = regex.compile(pattern).findall
        self.labels = {i: t for t, i in vocabulary.items()}
        self.longest = max(map(len, vocabulary), default=1)
        self.gadgets: dict[bytes, dict[bytes, int]] = {}
        self.ends = {bytes([b]): ((bytes([b]), NEVER),) for b in range(256)}
        self.begins = dict(self.ends)
        self.arcs: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[str, list[int]] = {}
        for r, (u, v) in enumerate(merges):
            w = u + v
            # a pair that earlier gadgets keep apart never meets, so this merge adds no path
            if u in self.ends and v in self.begins and w not in self.ends and self._open(u, v):
                self.ends[w] = ((w, NEVER), (v, r), *self.ends[v][1:])
                self.begins[w] = ((w, NEVER), (u, r), *self.begins[u][1:])
            self.gadgets.setdefault(u, {}).setdefault(v, r)

    def _open(self, before: bytes, label: bytes) -> bool:
        """Whether no gadget so far took the arc ``label`` from the state entered by ``before``.

        Of equal neighbours the left pair merges first: a piece used up by the merge itself on its left is gone, one
        used up on its right is still there.
        """
        for u, gone_left in self.ends[before]:
            row = self.gadgets.get(u)
            if row:
                for v, gone_right in self.begins[label]:
                    r = row.get(v)
                    if r is not None and r < gone_left and r <= gone_right:
                        return False
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """Ids on the one path that spells ``word``: for each prefix the one token that can end it, then back from the end."""
        last: list[bytes] = [b""] * (len(word) + 1)
        ids, ends, arcs = self.ids, self.ends, self.arcs
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - self.longest), i):
                label = word[j:i]
                if label in ends and label in ids:
                    if j == 0:
                        last[i] = label
                        break
                    arc = (last[j], label)
                    ok = arcs.get(arc)
                    if ok is None:
                        if len(arcs) > 4 * CACHED_WORDS:
                            arcs.clear()
                        ok = arcs[arc] = self._open(*arc)
                    if ok:
                        last[i] = label
                        break
        out, i = [], len(word)
        while i:
            out.append(ids[last[i]])
            i -= len(last[i])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        words = self.words
        for word in self.split(text):
            found = words.get(word)
            if found is None:
                found = self.encode_word(word.encode("utf-8", "surrogatepass"))
                if len(word) <= 64:
                    if len(words) > CACHED_WORDS:
                        words.clear()
                    words[word] = found
            out += found
        return out

    def decode(self, ids: list[int] | None) -> str:
        return b"".join(self.labels[i] for i in ids or []).decode("utf-8", "replace")


def compile_automaton(content: bytes, pattern: str) -> MergeAutomaton:
    """From the content of a byte-level BPE vocabulary file in the format of the tokenizers library."""
    model = json.loads(content)["model"]
    alphabet = byte_alphabet()
    plain = lambda t: bytes(alphabet[c] for c in t)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocabulary = {plain(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t) and not (t.startswith("<|") and t.endswith("|>"))}
    return MergeAutomaton(vocabulary, [(plain(u), plain(v)) for u, v in merges], pattern)


def default_vocabulary() -> tuple[str, str]:
    """Path of byte_bpe_50k.json and the pattern that splits text into words, from the installed vocabulary package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


_compiled: dict[str, MergeAutomaton] = {}


def _automaton(content: bytes, pattern: str) -> MergeAutomaton:
    key = hashlib.md5(content + pattern.encode()).hexdigest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = compile_automaton(content, pattern)
    return _compiled[key]


def _lists(rows: list[list[int]]) -> pa.Array:
    sizes = np.fromiter(map(len, rows), np.int32, len(rows))
    flat = np.fromiter((i for r in rows for i in r), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _mapper(df: DataFrame, vocabulary: tuple[str, str] | None, take: str, made: str, kind, work):
    """Replace column ``take`` by ``made``, which ``work(automaton, values)`` computes for each Arrow batch."""
    path, pattern = vocabulary or default_vocabulary()
    # the vocabulary's size is fixed, whatever the corpus
    shipped = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    kept = [c for c in df.columns if c != take]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shipped.value, pattern)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(take)).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), work(machine, values)], [*kept, made])

    schema = df.select(*[f"`{c}`" for c in kept]).schema.add(made, kind)
    return df.mapInArrow(run, schema)


def encode_corpus(df: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, ids`` for every row: the token ids of the whole text, without special tokens.

    Null and empty texts have an empty list. Text that looks like a special token is ordinary text. Rows and ids are
    kept as they are, repeated or null; other columns aren't looked at. ``vocabulary`` is (path, split pattern).
    """
    from pyspark.sql import types as T

    rows = df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return _mapper(rows, vocabulary, "text", "ids", T.ArrayType(T.IntegerType()), lambda m, values: _lists([m.encode(v) for v in values]))


def count_tokens(df: DataFrame, text: str, made: str = "n_tokens", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in place of it; 0 for null and empty texts."""
    from pyspark.sql import types as T

    return _mapper(df, vocabulary, text, made, T.LongType(), lambda m, values: pa.array([len(m.encode(v)) for v in values], pa.int64()))


def decode_corpus(df: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``: the labels of the arcs in order; a null or empty list is the empty text."""
    from pyspark.sql import types as T

    return _mapper(df.select("doc_id", "ids"), vocabulary, "ids", "text", T.StringType(), lambda m, values: pa.array([m.decode(v) for v in values], pa.string()))
