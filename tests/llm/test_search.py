"""Wu-Manber search: against plain windows on random words, with repeated and overlapping items, and the size of its tables."""

import pickle
import re

import numpy as np
import pytest

from plumbline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def _plain(texts, items, window):
    out = []
    for text in texts:
        w, hit, found = _words(text), set(), set()
        for item, t in items:
            iw = _words(t)
            n = min(window, len(iw))
            own = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in own:
                    hit.update(range(at, at + n))
                    found.add(item)
        out.append((len(w), len(hit), sorted(found)))
    return out


def _found(part, texts):
    got = part.find(texts).to_pylist()
    for r in got:
        places = [(s["start"], s["end"]) for s in r["spans"]]
        assert places == sorted(places) and all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False))
    return [(r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in got]


@pytest.mark.parametrize("window", [1, 2, 3, 10, 300])
@pytest.mark.parametrize("alphabet", [2, 5, 60])
def test_matches_plain_windows(window, alphabet):
    rng = np.random.default_rng(window * 100 + alphabet)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(["A", "é", "x1", "日本"]) + str(int(k)) for k in rng.integers(0, alphabet, n))
    items = [(f"i{k}", text(int(rng.integers(0, 30)))) for k in range(15)] + [("none", None), ("dots", "..."), ("i1", text(12)), ("", text(11))]
    texts = [None, "", "?!", *[text(int(n)) for n in rng.integers(0, 700, 12)]]
    texts += [f"{text(5)} {items[3][1]} {items[4][1].upper()}", items[5][1], items[6][1] * 3, items[7][1] + " end"]
    assert _found(decontaminate.Part(items, window), texts) == _plain(texts, items, window)


def test_texts_do_not_run_into_each_other():
    items = [("a", "one two three"), ("b", "three four")]
    assert _found(decontaminate.Part(items, 10), ["one two", "three", "four", "x three", "four"]) == [(2, 0, []), (1, 0, []), (1, 0, []), (2, 0, []), (1, 0, [])]


def test_a_window_of_many_items_names_them_all():
    items = [(f"{i:03}", f"same ten words in every one of these items here {i}") for i in range(200)]
    got = _found(decontaminate.Part(items, 10), ["so same ten words in every one of these items here ends"])
    assert got == [(12, 10, [f"{i:03}" for i in range(200)])]


def test_tables_take_few_bytes_a_window():
    rng = np.random.default_rng(0)
    items = [(str(i), " ".join(f"w{int(k)}" for k in rng.integers(0, 50_000, 400))) for i in range(1000)]
    part = decontaminate.Part(items, 10)
    windows = sum(len(s.ends) for s in part.searches)
    assert windows == 391_000 and len(pickle.dumps(part)) < 48 * windows


def test_many_parts_give_what_one_gives(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{int(k)}" for k in rng.integers(0, 40, n))
    items = [(i, text(14)) for i in range(40)]
    rows = [(i % 55, text(80) + " " + items[i % 40][1] + " " + items[(i * 7) % 40][1], 1, "z") for i in range(60)] + [(None, None, 2, "z"), (99, "", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, items string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(decontaminate.contamination(docs, bench).collect(), key=str)
    many = sorted(decontaminate.contamination(docs, bench, part_bytes=300).collect(), key=str)
    assert one == many and sum(r.contaminated for r in one) == 60
    whole = decontaminate.decontaminate(docs, bench, part_bytes=300)
    assert whole.columns == ["doc_id", "text", "n_words", "n_hit", "items"] and whole.count() == 62
