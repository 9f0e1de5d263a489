from __future__ import annotations

import random

from skein.llm import subjects
from skein.llm.subjects import document_subjects, sentence_terms

WORDS = {
    "sport": (["racket", "football", "dumbbells", "jersey", "goal net"], ["Our team won the final.", "My coach noticed the serve."]),
    "music": (["guitar", "metronome", "violin strings", "tuner", "amplifier"], ["The low notes sound warm.", "Chords ring out."]),
    "law": (["contract handbook", "notary stamp", "court forms", "statute book"], ["The judge accepted it.", "My landlord gave in."]),
}
NEUTRAL = ["I bought the {} in spring.", "The manual of the {} has 9 pages.", "I use the {} almost every day.", "The {} weighs about 200 grams."]
SERVICE = ["The parcel came early.", "Friendly support, they answered.", "Box was neat and nothing was damaged."]
DOCS = "doc_id long, title string, text string, lang string, terms string, labels string"


def corpus(n=600, seed=0):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        subjects = rnd.sample(sorted(WORDS), 2 if rnd.random() < 0.15 else 1) if rnd.random() < 0.85 else []
        text = []
        for s in subjects:
            things, says = WORDS[s]
            text += [rnd.choice(NEUTRAL).format(rnd.choice(things)) for _ in range(3)] + [rnd.choice(says)]
        if len(subjects) == 1 and rnd.random() < 0.3:
            other = rnd.choice([s for s in WORDS if s not in subjects])
            text.insert(2, f"By the way, my neighbour wanted a {rnd.choice(WORDS[other][0])} instead.")
        text += rnd.sample(SERVICE, 1 if subjects else 2)
        out.append((k, "My order" if not subjects else f"Great {rnd.choice(WORDS[subjects[0]][0])}", " ".join(text), "en", set(subjects) or {"general"}))
    return out


def run(spark, docs, labels, names=("sport", "music", " Law", "general")):
    got = {}
    d = spark.createDataFrame([(*r[:4], "x", "y") for r in docs], DOCS)
    s = spark.createDataFrame([(x, "") for x in names], "subject string, about string")
    rows = document_subjects(d, s, spark.createDataFrame(labels, "doc_id long, subject string, annotator string")).collect()
    for r in rows:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert len(rows) == sum(map(len, got.values()))
    return got


def test_held_out_accuracy(spark):
    """Labels of a tenth of the documents, some wrong, some repeated, in odd spellings."""
    docs = corpus()
    rnd = random.Random(1)
    labels = []
    for k, *_, subjects in docs[:60]:
        s = rnd.choice(sorted(subjects)) if rnd.random() > 0.08 else rnd.choice(sorted(WORDS))
        labels += [(k, s.upper(), "a")] + [(k, f" {s}", "b")] * (rnd.random() < 0.2)
    got = run(spark, docs, labels)
    right = [got[k] == subjects for k, *_, subjects in docs[60:]]
    assert sum(right) / len(right) > 0.93


def test_blank_texts_and_missing_labels(spark):
    docs = [(1, "t", None, "en"), (2, "t", "", "en"), (3, None, " \n　 ", None), (4, None, "!!!", None), (5, "x", "a racket. " * 4000, "zz"), (None, "t", "text", "en")]
    assert run(spark, docs, []) == {4: {"general"}, 5: {"general"}}
    assert run(spark, docs, [(5, "sport", "a"), (77, "music", "a"), (4, "unheard", "a"), (None, "sport", "a"), (5, None, "a")]).keys() == {4, 5}
    assert run(spark, [], []) == {}


def test_a_rare_language_has_its_own_columns(spark):
    """Ten labelled documents among three thousand are in a second language that no other document uses."""
    docs = [(k, t, x, lang, y) for k, t, x, lang, y in corpus(2990, seed=3)]
    rnd = random.Random(5)
    things = ["raketa", "fotbal", "cinka", "dres"]
    docs += [(5000 + i, f"Dobra {rnd.choice(things)}", f"Koupil jsem {rnd.choice(things)} na jare. Nase mistrovstvi vyhrala {rnd.choice(things)}. Trener videl {rnd.choice(things)}.", "cs", {"sport"}) for i in range(10)]
    labels = [(k, sorted(y)[0], "a") for k, *_, y in docs[:200]] + [(k, "sport", "a") for k, *_ in docs[2990:]]
    got = run(spark, docs, labels)
    assert all(got[k] == {"sport"} for k, *_ in docs[2990:])
    assert sum(got[k] == y for k, *_, y in docs[200:2990]) / 2790 > 0.93


def test_languages_beyond_the_listed_share_columns(spark, monkeypatch):
    monkeypatch.setattr(subjects, "LANGUAGES", 1)
    docs = corpus(300)
    docs += [(k + 5000, "", x.replace("e", "yx").replace("a", "oz"), "q" + "abc"[k % 3], y) for k, _, x, _, y in corpus(300, seed=8)]
    labels = [(k, s, "a") for k, *_, y in docs[:60] + docs[300:360] for s in y]
    got = run(spark, docs, labels)
    rest = docs[60:300] + docs[360:]
    assert sum(got[k] == y for k, *_, y in rest) / len(rest) > 0.9


def test_terms():
    terms = lambda t: set(sentence_terms(t)[1].tolist())
    assert terms("The ÉTUI, the étui") >= terms("étui")
    assert not terms("❤️ 123 !") and len(terms("日本語")) == 3
    assert terms("b&amp;amp;a") == terms("B & A")
    s, t = sentence_terms("a b. a b\nc")
    assert s.tolist() == [0, 0, 0, 1, 1, 1, 2] and len(set(t.tolist())) == 4
    assert sentence_terms("")[1].size == 0


def test_titles_are_marked():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": [1, 2, 3, 4], "b": ["x. y", None, "", "z"], "c": ["p q", "r. s", " ", "日本語。京都"], "d": ["en", None, "en", "ja"]})
    (out,) = list(subjects._tokenize(iter([batch])))
    assert out.column("doc_id").to_pylist() == [1, 2, 4] and out.column("titles").to_pylist() == [2, 1, 1]
    assert [sorted(set(x)) for x in out.column("sentences").to_pylist()] == [[0, 1, 2], [1, 2], [0, 1, 2]]
    assert list(map(len, out.column("terms").to_pylist())) == [5, 2, 5]


def test_all_documents_count(spark, monkeypatch):
    """Every round is a sum over all documents, and every labelled one seeds, whatever their number or length."""
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(6000))
    docs = [(i, "", ("The soup was salty. " if i % 2 else "The drill is loud. ") + (long if i < 4 else "It came today."), "en") for i in range(60)]
    documents = spark.createDataFrame(docs, "doc_id bigint, title string, text string, lang string")
    names = spark.createDataFrame([("food",), ("tools",)], "subject string")
    labels = spark.createDataFrame([(i, "food" if i % 2 else "tools") for i in range(8)], "doc_id bigint, subject string")
    seeded, before = [], subjects._seeded
    monkeypatch.setattr(subjects, "_seeded", lambda v, counts, size: seeded.append((counts.max(), size.sum())) or before(v, counts, size))
    assert not hasattr(subjects, "FIT_ROWS") and not hasattr(subjects, "LABELLED")
    got = {(r["doc_id"], r["subject"]) for r in document_subjects(documents, names, labels).collect()}
    assert seeded == [(4.0, 8.0)]
    assert got >= {(i, "food" if i % 2 else "tools") for i in range(8, 60)}
