"""Restoring against the whole lattice, and scoring on held-out rows."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tessera.llm import toxicity_channel as tox

PLAIN = "you are a stupid idiot and the worst loser of all, what an idiotic moron said this is pathetic trash was worthless or disgusting and he has to go"


def model_of(texts):
    counts = np.zeros(tox._SIZE, np.int64)
    for text in texts:
        classes = [0] * (tox.ORDER - 1) + tox._symbols((text + " ").lower().encode())
        for k in range(len(classes) - tox.ORDER + 1):
            code = 0
            for c in classes[k : k + tox.ORDER]:
                code = code * 32 + c
            counts[code] += 1
    return tox.language_model(counts)


@pytest.fixture(scope="module")
def restorer():
    rng = random.Random(2)
    words = PLAIN.split()
    return tox.Restorer(model_of([PLAIN] + [" ".join(rng.choices(words, k=40)) for _ in range(60)]), tox.Channel())


@pytest.mark.parametrize(
    "written, meant",
    [
        ("you are an id1ot", "you are an idiot"),
        ("l0ser and m0r0n", "loser and moron"),
        ("i d i o t", "idiot"),
        ("m.o.r.o.n", "moron"),
        ("stuuuupid loooser", "stupid loser"),
        ("p@th3t1c tr@$h", "pathetic trash"),
        ("w o r t h l e s s", "worthless"),
        ("a mor.on", "a moron"),
        ("STUPID", "stupid"),
        ("idiot", "idiot"),
        ("", ""),
        ("  \n\t ", "  \n\t "),
        ("é 東京 2024", "é 東京 2024"),
        ("on 3 of 1200 days", "on 3 of 1200 days"),
    ],
)
def test_restores(restorer, written, meant):
    assert restorer.text(written.encode()).decode() == meant


def cost_of(classes, bits):
    context = total = 0
    for c in classes:
        if c or context & 31:
            at = context * 32 + c
            total += bits[at]
            context = at & tox._CONTEXT
    return total


def whole_lattice(raw, bits, how):
    """Every path through the lattice of the whole text: (bits, restored)."""
    raw = raw.lower()
    parts, at = [], 0
    for match in tox.PLACES.finditer(raw):
        parts += [[(raw[k : k + 1], tox._symbols(raw[k : k + 1]), 0.0)] for k in range(at, match.start())]
        parts += tox.readings(match.group(), how, tox.SPACED.match(match.group()) is not None)
        at = match.end()
    parts += [[(raw[k : k + 1], [c for c in tox._symbols(b"a" + raw[k : k + 1])[1:]], 0.0)] for k in range(at, len(raw))]
    for path in itertools.product(*parts):
        classes = [c for _, said, _ in path for c in said] + [0]
        yield cost_of(classes, bits) + sum(asked for *_, asked in path), b"".join(text for text, *_ in path)


def test_pieces_give_the_whole_lattice_s_best_path(restorer):
    rng = random.Random(8)
    many = 0
    for _ in range(400):
        raw = "".join(rng.choices("idotsmornaeel01@$. ", k=rng.randrange(1, 16))).encode()
        if len(list(tox.PLACES.finditer(raw))) == 0 or any(raw.find(x * 3) >= 0 for x in (b" ", b".")):
            continue
        paths = list(itertools.islice(whole_lattice(raw, restorer.bits, restorer.how), 60_000))
        if len(paths) == 60_000:
            continue
        least = min(cost for cost, _ in paths)
        got = restorer.text(raw)
        assert min(cost for cost, text in paths if text == got) <= least + 1e-3, raw
        many += len(paths) > 1
    assert many > 100


def test_model_is_a_distribution(restorer):
    odds = np.exp2(-np.frombuffer(restorer.bits, np.float32).reshape(-1, 32).astype(float))
    assert np.allclose(odds.sum(1), 1, atol=1e-4)


def test_counts_cover_every_text(spark):
    texts = ["abc abd", None, "", "Éa 12, b" * 50, "abc abd", "x" * 10]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    counts = tox.count_grams(docs)
    want = np.zeros(tox._SIZE, np.int64)
    for text in texts:
        classes = [0] * (tox.ORDER - 1) + tox._symbols(b" " + (text or "").encode() + b" ")
        classes = classes[1:] if classes[tox.ORDER - 1] == 0 else classes
        for k in range(len(classes) - tox.ORDER + 1):
            code = 0
            for c in classes[k : k + tox.ORDER]:
                code = code * 32 + c
            want[code] += 1
    assert np.array_equal(counts, want)


def test_many_texts_at_once(restorer):
    """Trying the pattern where a place can begin gives what searching gives."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("idotsmaeell0013@$!. -_'é*Z", k=rng.randrange(0, 60))) for _ in range(600)] + ["a a a", "aa", "a", "", "1d", "d1"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    assert restorer.texts(data, offsets) == [restorer.text(r) for r in raw]


def corpus():
    rng = random.Random(6)
    clean = [f"w{k}ord" for k in range(300)]
    bad = ["idiot", "moron", "stupid", "loser", "trash"]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(clean, k=rng.randrange(3, 120))
        toxic = i % 3 == 0
        for _ in range(2 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_and_obfuscated_rows(spark):
    rows, labels = corpus()
    hidden = {"idiot": "1d10t", "moron": "m o r o n", "stupid": "stuuupid", "loser": "l0$er", "trash": "tr.ash"}
    hide = lambda t: " ".join(hidden.get(w, w) for w in t.split(" "))
    docs = spark.createDataFrame(rows + [(10_000 + i, hide(t)) for i, t in rows], "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")

    model = tox.language_model(tox.count_grams(docs.where("doc_id < 10000")))  # most of a corpus is written plainly
    weights = tox.train(docs, marks, ~tox.held_out(), model)
    got = {r.doc_id: r.predicted for r in tox.score(docs, weights, model).collect()}
    truth = dict(labels)
    held = {r.doc_id for r in docs.where(tox.held_out()).select("doc_id").collect()}
    for shift in (0, 10_000):
        both = [(got[i + shift], truth[i]) for i in truth if i + shift in held or shift]
        assert sum(p for p, t in both if t) > 0.95 * sum(t for _, t in both)
        assert sum(p for p, t in both if not t) == 0
    again = tox.train(docs.repartition(2), marks, ~tox.held_out(), model)
    assert np.array_equal(weights, again)


def test_awkward_rows(spark, docs, empty):
    marks = spark.createDataFrame([(10, 1), (11, 0), (30, 1), (None, 1), (12, None), (50, 0)], "doc_id long, toxic int")
    rows = tox.toxicity_digest(docs, marks).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert tox.toxicity_digest(empty, marks).collect() == []
    assert {r.score for r in tox.toxicity_digest(docs, marks.where("false")).collect()} == {0.5}
    model = tox.language_model(tox.count_grams(docs))
    texts = {r.doc_id: r.restored for r in tox.score(docs, np.zeros((1 << 20) + 1), model, texts=True).collect()}
    assert texts[4] == "one two" and texts[1] == ""
