"""Subject areas of documents: a seeded non-negative factorization of the document-term matrix (problem 10)."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.lineage import Scratch

GENERAL = "general"
LANGUAGES = 60  # the most frequent language labels have columns of their own, all others share one set
VOCABULARY = 400_000  # at most so many terms have columns, those of the most documents
SHARED = 0.08  # share of a language's documents from which on a term counts mostly as shared by all of them
ROUNDS = 6
INNER = 4
FLOOR = 1e-9
PART = 1_000  # documents that are worked on at once
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}ー"
_RUN = regex.compile(rf"[{_CJK}]+|\p{{L}}+|[.!?。\n\r]+")
_HAS_CJK = regex.compile(rf"[{_CJK}]")
_KATAKANA = regex.compile(r"[\p{Katakana}ー]{2,}")
_MARKS = regex.compile(r"\p{M}+")


class _Words(dict):
    """Hashes of words; 0 for what ends a sentence."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        made = self[word] = 0 if word[0] in ".!?。\n\r" else (xxhash.xxh3_64_intdigest(word) >> 1) or 1
        return made


_words = _Words()


def _plain(text: str) -> str:
    """Lower case without marks and markup entities."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).lower()))


def _codes(text: str) -> list[int]:
    """Hashed words of a text in order, 0 between sentences. Runs of scripts without spaces give their runs of 2 and 3
    signs and whole katakana words, each with a gap (-1) before it, as they have no neighbours."""
    plain = _plain(text)
    if not _HAS_CJK.search(plain):
        return list(map(_words.__getitem__, _RUN.findall(plain)))
    out: list[int] = []
    for run in _RUN.findall(plain):
        if _HAS_CJK.match(run):
            parts = [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)] + ["#" + k for k in _KATAKANA.findall(run)]
            out += [x for p in parts for x in (-1, _words[p])] + [-1]
        else:
            out.append(_words[run])
    return out


def sentence_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(sentence numbers, hashed terms) of a text: words and pairs of neighbouring words, each once a sentence."""
    return _terms_of(np.array(_codes(text), np.int64), np.zeros(0, np.int64))[:2]


def _terms_of(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, term, sentences before each of ``starts``) of codes; distinct, in order of the sentence."""
    sentence = np.cumsum(codes == 0)
    before = sentence[starts] if len(starts) else starts
    word = codes > 0
    with np.errstate(over="ignore"):
        pairs = (codes[:-1] * np.int64(1_000_003) + codes[1:]) & np.int64(0x7FFFFFFFFFFFFFFF)
    two = word[:-1] & word[1:]
    s, t = np.concatenate([sentence[word], sentence[1:][two]]), np.concatenate([codes[word], pairs[two]])
    order = np.lexsort((t, s))
    s, t = s[order], t[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])] if len(s) else np.zeros(0, bool)
    return s[new], t[new], before


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, lang, titles, terms, sentences``: of each entry its term and sentence; the first ``titles`` sentences are the title's."""
    for batch in batches:
        for part in _parts(batch):
            ids, langs, titles, codes, starts = [], [], [], [], []
            for doc, title, text, lang in zip(*(part.column(i).to_pylist() for i in range(4))):
                if not text or not text.strip():
                    continue
                head = [*_codes(title or ""), 0]
                starts.append(len(codes))
                titles.append(head.count(0))
                codes += head
                codes += _codes(text)
                codes.append(0)
                ids.append(doc)
                langs.append((lang or "").strip().lower()[:2])
            s, t, before = _terms_of(np.array(codes, np.int64), np.array(starts, np.int64))
            # a document's own first position may be the end of an empty title
            before = before - np.array([codes[i] == 0 for i in starts], np.int64) if starts else before
            doc = np.searchsorted(before, s, side="right") - 1
            sizes = np.bincount(doc, minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(titles, pa.int32()), _lists(t, sizes), _lists((s - before[doc]).astype(np.int32), sizes)],
                ["doc_id", "lang", "titles", "terms", "sentences"],
            )


class Vocabulary:
    """The kept terms, and the columns of X: a term of two languages is two columns."""

    def __init__(self, terms: np.ndarray, languages: np.ndarray, counts: np.ndarray, documents: np.ndarray):
        """Of each (term, language), sorted by both, the documents with it; ``documents``: those of each language."""
        total = np.bincount(np.unique(terms, return_inverse=True)[1], counts)[np.unique(terms, return_inverse=True)[1]] if len(terms) else counts
        used = (counts >= 3) & (counts >= 0.02 * total)
        self.of, self.language, self.count = terms[used], languages[used], counts[used].astype(float)
        self.share = (self.count / np.maximum(total[used], 1)).astype(np.float32)
        self.terms, self.first = np.unique(self.of, return_index=True)
        self.width = np.diff(np.r_[self.first, len(self.of)])
        self.documents = documents

    @property
    def columns(self) -> int:
        return len(self.of)


def _offsets(column) -> np.ndarray:
    o = column.offsets.to_numpy()
    return (o - o[0]).astype(np.int64)


def _encode(batch: pa.RecordBatch, v: Vocabulary) -> pa.RecordBatch:
    """Terms as columns of the document's language, which is the one that its terms are mostly found in, whatever its label says."""
    terms = batch.column("terms")
    flat, sentence = terms.flatten().to_numpy(), batch.column("sentences").flatten().to_numpy()
    doc = np.repeat(np.arange(batch.num_rows), np.diff(_offsets(terms)))
    languages = len(v.documents)
    if v.columns:
        at = np.minimum(np.searchsorted(v.terms, flat), len(v.terms) - 1)
        known = np.flatnonzero(v.terms[at] == flat)
        width = v.width[at[known]]
        entry = np.repeat(known, width)
        column = np.arange(len(entry)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(v.first[at[known]], width)
        told = np.bincount(doc[entry] * languages + v.language[column], v.share[column], batch.num_rows * languages).reshape(-1, languages)
        language = told.argmax(axis=1)
        own = v.language[column] == language[doc[entry]]
        entry, column = entry[own], column[own]
    else:
        language, entry, column = np.zeros(batch.num_rows, int), np.zeros(0, int), np.zeros(0, int)
    sizes = np.bincount(doc[entry], minlength=batch.num_rows)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("labels"), pa.array(language.astype(np.int32)), batch.column("titles"), _lists(column.astype(np.int32), sizes), _lists(sentence[entry].astype(np.int32), sizes)],
        ["doc_id", "labels", "language", "titles", "columns", "sentences"],
    )


class Block:
    """Documents of an Arrow batch as a sparse matrix, its entries in order of document and sentence."""

    def __init__(self, batch: pa.RecordBatch):
        columns, labels = batch.column("columns"), batch.column("labels")
        self.docs = batch.num_rows
        self.language = batch.column("language").to_numpy()
        self.term = columns.flatten().to_numpy()
        starts = _offsets(columns)
        self.doc = np.repeat(np.arange(self.docs), np.diff(starts))
        self.some = np.flatnonzero(np.diff(starts))  # documents with entries, and where they start
        self.starts = starts[self.some]
        sentence = batch.column("sentences").flatten().to_numpy()
        new = np.r_[True, (self.doc[1:] != self.doc[:-1]) | (sentence[1:] != sentence[:-1])] if len(self.doc) else np.zeros(0, bool)
        self.sentence = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.doc_of = self.doc[self.first]
        self.title = sentence[self.first] < batch.column("titles").to_numpy()[self.doc_of]
        self.label_doc = np.repeat(np.arange(self.docs), np.diff(_offsets(labels)))
        self.label = labels.flatten().to_numpy()
        self.labels_of = np.bincount(self.label_doc, minlength=self.docs)

    @property
    def sentences(self) -> int:
        return len(self.first)

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.docs, values.shape[1]), values.dtype)
        if len(values):
            out[self.some] = np.add.reduceat(values, self.starts, axis=0)
        return out

    def by_sentence(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first, axis=0) if len(values) else np.zeros((0, values.shape[1]), values.dtype)


class Factors:
    """H of X = W H: a row for each subject and a last one for what a language's documents share."""

    def __init__(self, subjects: list[str], vocabulary: Vocabulary, mass: np.ndarray, trust: float = 6.0):
        """``mass``: how much of each column each row accounts for, not divided by the row's size. ``trust``: weight of a label, in terms."""
        self.subjects, self.trust = subjects, trust
        languages = len(vocabulary.documents)
        sums = np.stack([np.bincount(vocabulary.language, row, languages) for row in mass])
        self.h = np.ascontiguousarray((mass / np.maximum(sums[:, vocabulary.language], 1e-30)).T.astype(np.float32))  # of each language, rows add up to 1
        self.part = np.ascontiguousarray((mass / np.maximum(mass.sum(axis=0), 1e-30)).T.astype(np.float32))  # of each column, its rows' parts
        self.size = np.ascontiguousarray((sums / np.maximum(sums.sum(axis=0), 1e-30)).T.astype(np.float32))  # by language

    def mixtures(self, block: Block, weight: np.ndarray | None = None, labels: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """W of a block by multiplicative updates with H fixed, and each entry's responsibilities. ``weight`` is that of
        the entries of X (1 if not given); ``labels``: whether those anchor W."""
        h = self.h[block.term]
        w = self.size[block.language]
        prior = np.zeros_like(w)
        if labels and len(block.label):
            prior[block.label_doc, block.label] = self.trust / block.labels_of[block.label_doc]
        w = w + prior
        for i in range(INNER):
            z = np.einsum("ek,ek->e", w[block.doc], h)
            x = (1 if weight is None else weight) / np.maximum(z, 1e-30)
            w = w * block.by_doc(h * x[:, None]) + prior + np.float32(0.01)
            w /= w.sum(axis=1, keepdims=True)
        share = w[block.doc] * h
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
        return w, share


def _best(block: Block, share: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each sentence the subject that holds most of its entries' responsibilities (-1: none does clearly) and how many."""
    mass = block.by_sentence(share)[:, :k]
    strength, total = mass.max(axis=1, initial=0), mass.sum(axis=1)
    return np.where((strength >= 0.6) & (strength >= 0.5 * total), mass.argmax(axis=1) if len(mass) else 0, -1), strength


def _labelled(block: Block, total: np.ndarray) -> None:
    """Add the documents of each subject that have a column."""
    pair = np.unique(block.doc * np.int64(max(1, len(total))) + block.term)
    doc, term = pair // max(1, len(total)), pair % max(1, len(total))
    for s in range(total.shape[1]):
        own = np.zeros(block.docs, bool)
        own[block.label_doc[block.label == s]] = True
        total[:, s] += np.bincount(term[own[doc]], minlength=len(total))


def _seeded(v: Vocabulary, counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Anchors from labelled documents, of which each subject has ``size`` by language and ``counts`` by column: columns
    in the measure in which a subject's documents have them more often than others of the language do; in the last row,
    what many of a language's documents have."""
    size = size[:, v.language]
    seen = counts.sum(axis=0)
    rate = counts / np.maximum(size, 1)
    rest = (seen - counts + 0.3) / (size.sum(axis=0) - size + 1)
    lift = np.maximum(0, np.log(np.maximum(rate, 1e-12) / rest) - np.log(2.0))
    whole = np.maximum(v.documents[v.language], 1)
    scale = size.sum(axis=0) / whole
    own = counts * lift + FLOOR + 0.05 * v.count * scale * (seen < 2)
    often = v.count / whole
    return np.vstack([own, v.count * scale * often**2 / (often**2 + SHARED**2) + FLOOR])


def _update(factors: Factors, block: Block, total: np.ndarray) -> None:
    """Add a block's responsibilities by column to the first columns of ``total``."""
    _, share = factors.mixtures(block)
    for i in range(share.shape[1]):
        total[:, i] += np.bincount(block.term, share[:, i], len(total))


def _agreement(factors: Factors, block: Block, total: np.ndarray) -> None:
    """Add to the last two columns, for columns of X that are everyone's: sentences with them that name a subject, and
    those of them that some other sentence of the document agrees with."""
    k = len(factors.subjects)
    best, _ = _best(block, factors.part[block.term], k)
    on = best >= 0
    tally = np.zeros((block.docs, k))
    np.add.at(tally, (block.doc_of[on], best[on]), 1)
    others = tally.sum(axis=1)[block.doc_of] - on
    same = np.where(on, tally[block.doc_of, np.maximum(best, 0)] - 1, 0) > 0
    use = on & (others >= 2) & ~block.title & (best != (factors.subjects.index(GENERAL) if GENERAL in factors.subjects else -2))
    entry = use[block.sentence] & (factors.part[block.term, -1] > 0.5)
    total[:, -2] += np.bincount(block.term[entry], minlength=len(total))
    total[:, -1] += np.bincount(block.term[entry], same[block.sentence[entry]], len(total))


def _factors(subjects: list[str], v: Vocabulary, total: np.ndarray, trust: float) -> Factors:
    h = total[:, : len(subjects) + 1].T
    return Factors(subjects, v, h + FLOOR * h.sum(axis=1, keepdims=True) + 1e-30, trust)


def marks(total: np.ndarray) -> np.ndarray:
    """Columns that mark mentions in passing: those whose sentences mostly disagree with all others of their document."""
    return (total[:, -2] >= 5) & (total[:, -1] < 0.5 * total[:, -2])


def decide(factors: Factors, passing: np.ndarray, block: Block, cut: float = 0.2, least: float = 1.6, alone: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(document, subject) pairs by W.

    X's entries in sentences that are in passing are left out, and those of each other sentence weigh so that what it says of
    subjects counts once. A subject stands if W gives it the most, or ``least`` sentences and ``cut`` of what W gives to subjects.
    """
    k = len(factors.subjects)
    general = factors.subjects.index(GENERAL) if GENERAL in factors.subjects else -1
    _, share = factors.mixtures(block, labels=False)
    mass = block.by_sentence(share)[:, :k]
    best, strength = _best(block, share, k)
    told = best >= 0
    if len(passing):
        told &= ~np.logical_or.reduceat(passing[block.term], block.first) if block.sentences else told
    w = np.zeros((block.docs, k))
    np.add.at(w, block.doc_of[told], mass[told] / np.maximum(mass[told].sum(axis=1, keepdims=True), 1e-30))
    if general >= 0:
        w[:, general] = 0
    total = w.sum(axis=1, keepdims=True)
    stands = (w >= least) & (w >= cut * total)
    stands[np.arange(block.docs), w.argmax(axis=1)] |= w.max(axis=1) >= alone
    if general >= 0:
        stands[:, general] = ~stands.any(axis=1)
    return np.nonzero(stands)


def _parts(batch: pa.RecordBatch, rows: int = PART) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _counted(languages: dict[str, int]):
    """Documents with each (term, language) of some batches together; of labels without a number, the number after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(languages) + 1
        for batch in batches:
            terms = batch.column("terms")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(_offsets(terms)))
            lang = np.array([languages.get(x, width - 1) for x in batch.column("lang").to_pylist()], np.int64)
            known, code = np.unique(terms.flatten().to_numpy(), return_inverse=True)
            pair = np.unique(doc * np.int64(max(1, len(known))) + code)
            cell, n = np.unique(pair % max(1, len(known)) * width + lang[pair // max(1, len(known))], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(known[cell // width]), pa.array((cell % width).astype(np.int32)), pa.array(n.astype(np.int64))], ["t", "l", "n"])

    return run


def vocabulary(terms: DataFrame) -> Vocabulary:
    """Columns from counts over all of ``terms``: of terms in at least 3 documents, the ``VOCABULARY`` most frequent."""
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    named = {r["lang"]: i for i, r in enumerate(sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())}
    number = F.coalesce(F.create_map(*[F.lit(x) for pair in named.items() for x in pair])[F.col("lang")], F.lit(len(named))) if named else F.lit(0)
    documents = np.zeros(len(named) + 1)
    for r in sizes.groupBy(number.alias("l")).agg(F.sum("n").alias("n")).collect():
        documents[r["l"]] = r["n"]
    # counts of a batch come combined, so terms are shuffled once, and both sums use that partitioning
    counts = terms.select("lang", "terms").mapInArrow(_counted(named), "t bigint, l int, n bigint").repartition("t").groupBy("t", "l").agg(F.sum("n").alias("n"))
    kept = counts.groupBy("t").agg(F.sum("n").alias("n"), F.collect_list(F.struct("l", "n")).alias("by")).where(F.col("n") >= 3).orderBy(F.desc("n"), "t").limit(VOCABULARY)
    rows = kept.select("t", F.explode("by").alias("b")).select("t", "b.l", "b.n").toPandas().sort_values(["t", "l"])
    return Vocabulary(rows["t"].to_numpy(np.int64), rows["l"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), documents)


def document_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, subject``: a row for each subject that a document is mainly about, by title and whole text.

    Documents whose text is null, empty or white space have no row; neither has a null ``doc_id``. ``subjects`` and
    their labels are matched trimmed and in lower case; labels of unknown subjects or documents are left out, repeated
    ones count once. ``general``, if it is a subject, stands alone and where nothing else does. Without labels all
    documents are general. Empty tables give no rows.

    Terms are counted over all documents. H is seeded by all labelled documents; its updates, and the marks of mentions
    in passing, are sums over all documents, a pass for each update. W decides, labels have no say in it. Terms of fewer than 3 documents, or beyond the ``VOCABULARY`` most
    frequent, say nothing: a document that has only such is general. Languages beyond the ``LANGUAGES`` most frequent
    labels share one set of columns.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark, "subjects")
    names = sorted({r["s"] for r in subjects.select(F.lower(F.trim("subject")).alias("s")).where("s <> ''").distinct().collect()})  # configuration
    if not names:
        return spark.createDataFrame([], "doc_id bigint, subject string")
    number = F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, i)])
    given = labels.select("doc_id", number[F.lower(F.trim("subject"))].alias("n")).where("doc_id is not null and n is not null")
    given = given.groupBy("doc_id").agg(F.array_sort(F.collect_set("n")).alias("labels"))
    found = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), F.col("title").cast("string"), F.col("text").cast("string"), F.col("lang").cast("string"))
    found = found.mapInArrow(_tokenize, "doc_id bigint, lang string, titles int, terms array<bigint>, sentences array<int>")
    terms = scratch.cut(found)
    v = vocabulary(terms)
    sent = sc.broadcast(v)  # at most VOCABULARY terms

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _encode(batch, sent.value)

    labelled = terms.join(given, "doc_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<int>")))
    encoded = scratch.cut(labelled.mapInArrow(encode, "doc_id bigint, labels array<int>, language int, titles int, columns array<int>, sentences array<int>"))
    columns = v.columns

    def summed(rows: DataFrame, width: int, add) -> np.ndarray:
        """``add`` adds a block to a table of a row for each column of X; these are summed over all rows."""
        cols = [f"v{i}" for i in range(width)]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((columns, width))
            for batch in batches:
                for part in _parts(batch):
                    add(Block(part), total)
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, i]) for i in range(width))], ["term", *cols])

        found = rows.mapInArrow(sums, ", ".join(["term bigint", *(f"{c} double" for c in cols)])).groupBy("term").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
        total = np.zeros((columns, width))
        total[found["term"].to_numpy(int)] = found[cols].to_numpy()
        return total

    known = encoded.where(F.size("labels") > 0)
    size = np.zeros((len(names), len(v.documents)))
    for r in known.select("language", F.explode("labels").alias("s")).groupBy("language", "s").agg(F.count(F.lit(1)).alias("n")).collect():  # subjects and languages
        size[r["s"], r["language"]] = r["n"]
    factors = Factors(names, v, _seeded(v, summed(known, len(names), _labelled).T, size))
    for _ in range(ROUNDS):
        held = sc.broadcast(factors)
        total = summed(encoded, len(names) + 1, lambda block, total, held=held: _update(held.value, block, total))
        factors = _factors(names, v, total, max(1.0, factors.trust / 2))
        held.destroy()
    first = sc.broadcast(factors)

    def both(block: Block, total: np.ndarray) -> None:
        _update(first.value, block, total)
        _agreement(first.value, block, total)

    total = summed(encoded, len(names) + 3, both)
    last = sc.broadcast((_factors(names, v, total, factors.trust), marks(total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, passing = last.value
        text = pa.array(factors.subjects, pa.string())
        for batch in batches:
            for part in _parts(batch):
                doc, subject = decide(factors, passing, Block(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), text.take(pa.array(subject))], ["doc_id", "subject"])

    return encoded.mapInArrow(run, "doc_id bigint, subject string").distinct()
