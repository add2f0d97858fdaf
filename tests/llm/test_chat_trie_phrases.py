"""Chat windows, the prefix trie and collocations against plain Python, on odd rows and with hot keys dealt."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from plumbline.llm import chat, collocations, prefix_trie, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn int, role string, text string, segment string, node int, h int"


def _conversations(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)


def _odd_conversations(seed, ids):
    """Unique (conversation, turn) pairs with nulls, empty texts, control strings and repeated turns."""
    rng = random.Random(seed)
    bits = ["\\", "### ", "</turn>", "\n", ":", "###", "</turn", "x", "é", "日本", " ", "### user:\n", "</turn>\n", "\\\\"]
    rows = []
    for c in ids:
        for t in range(rng.choice([1, 2, 5, 40])):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "a:b\n", "### \\"]) if t else rng.choice(["system", "user"])
            text = None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 60])))
            rows.append((c, None if t == 0 and rng.random() < 0.5 else t, role, text))
    return rows


def _by_conversation(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [v[2:] for v in sorted(turns)] for c, turns in out.items()}


def _chat_digests(rows):
    out = {}
    for c, turns in _by_conversation(rows).items():
        said = [text for role, text in turns if role == "assistant"]
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len("".join(said)), hashlib.sha256("".join(said).encode()).hexdigest())
    return out


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "### ", "\\### ", "</turn>", "\\</turn>\n", "#### x", "a\\", "\\### Assistant: </turn> ok", "</</turn>turn>", "\\\\\\</turn>"])
def test_escaping_reads_back(text):
    written = chat.header(text) + chat.escape(text) + "</turn>\n"
    found = chat.read_window(written * 2)
    assert [(r, chat.unescape((written * 2)[a:z])) for r, a, z in found] == [(text, text)] * 2


@pytest.mark.parametrize("options", [{}, {"budget": 60, "history": 20}, {"budget": 100, "history": 40, "segment": 7}, {"budget": 100, "history": 40, "segment": 7, "hot_turns": 10}, {"budget": 10, "history": 0, "segment": 3, "hot_turns": 4}])
def test_chat_windows_read_back_whole(spark, options):
    rows = _odd_conversations(5, [*range(25), None])
    got = {r.conv_id: tuple(r)[1:5] for r in chat.chat_digest(_conversations(spark, rows), PATH, **options).collect()}
    assert got == _chat_digests(rows)


def test_chat_windows_are_the_same_where_long_conversations_are_dealt(spark):
    frame = _conversations(spark, _odd_conversations(6, range(25)))
    plain, dealt = (sorted(map(str, chat.chat_windows(frame, PATH, 100, 40, 7, hot).collect())) for hot in (4096, 10))
    assert plain == dealt and any("segment=5" in r for r in plain)


def _slow_plan(tokens, assistant, system, budget, history):
    """The windows by trying ends and beginnings one by one."""
    out, own = [], 0
    while own < len(tokens):
        first = own
        while first > 0 and sum(tokens[first - 1 : own]) <= history and sum(tokens[first - 1 : own + 1]) <= budget - system:
            first -= 1
        end = own + 1
        while end < len(tokens) and sum(tokens[first : end + 1]) <= budget - system:
            end += 1
        if end < len(tokens):
            end = max((i + 1 for i in range(own, end) if assistant[i]), default=end)
        out.append((first, own, end))
        own = end
    return out


def test_prefix_sums_choose_the_windows_of_a_search():
    rng = np.random.default_rng(3)
    for _ in range(500):
        n = int(rng.integers(0, 30))
        tokens, assistant = rng.integers(1, 40, n), rng.random(n) < 0.5
        system, budget, history = (int(rng.integers(0, x)) for x in (30, 100, 50))
        found = chat.plan(tokens, assistant, system, budget, history)
        assert found == _slow_plan(tokens.tolist(), assistant.tolist(), system, budget, history)
        assert [i for _, a, z in found for i in range(a, z)] == list(range(n))
        assert all(system + tokens[f:z].sum() <= budget or (z == a + 1 and f == a) for f, a, z in found)


def test_chat_windows_keep_budget_system_and_mask(spark):
    found = chat.chat_windows(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"), PATH, budget=300, history=100).collect()
    assert any(r.n_history for r in found) and any(r.system and r.window for r in found)
    for r in found:
        turns = chat.read_window(r.text)
        assert len(turns) == (r.n_own + r.n_history + (1 if r.system and r.window else 0))
        assert r.n_tokens <= 300 or r.n_own - (r.system and not r.window) == 1
        assert not r.system or turns[0][0] == "system"
        fresh = turns[len(turns) - r.n_own :]
        assert [(s.start, s.end) for s in r.mask] == [(a, z) for role, a, z in fresh if role == "assistant"]


def test_chat_takes_empty_tables_and_very_long_turns(spark):
    assert chat.chat_digest(_conversations(spark, []), PATH).count() == 0
    rows = [(1, 0, "system", "s"), (1, 1, "user", "word " * 400_000), (1, 2, "assistant", "\\" * 100_000), (2, 0, "system", "only")]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.chat_digest(_conversations(spark, rows), PATH).collect()}
    assert got == _chat_digests(rows)


def _slow_trie(rows):
    whole = _by_conversation([r for r in rows if r[0] is not None])
    rebuilt = {}
    for c, turns in whole.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(whole.get(c - c % 5, [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if rebuilt[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [1, 7, 2048])
def test_prefix_trie_matches_sets_of_prefixes(spark, shard):
    rng = random.Random(8)
    rows = [r for r in _odd_conversations(9, range(0, 60)) if rng.random() < 0.9]
    hot = [("user", "hello"), ("assistant", "hi"), (None, None), ("user", "é" * 50)]
    for c in range(100, 400):  # a very common conversation, with common beginnings
        rows += [(c, t, *turn) for t, turn in enumerate(hot[: rng.choice([1, 2, 4, 4, 4])])]
    rows += [(500, t, "user", str(t % 2)) for t in range(300)] + [(501, t, "user", str(t % 2)) for t in range(299)]
    rows += [(None, 0, "user", "no id"), (600, 3, "user", "x" * 1_000_000)]
    got = sorted((tuple(r) for r in prefix_trie.shared_head_trie(_conversations(spark, rows), shard).collect()), key=str)
    assert got == _slow_trie(rows)


def test_prefix_trie_of_an_empty_table(spark):
    assert prefix_trie.shared_head_trie(_conversations(spark, [])).count() == 0


def _slow_collocations(rows, least, inside, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    wanted = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    scored = defaultdict(list)
    for (lang, w), a in wanted.items():
        score, cut = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        if not any(100 * b >= inside * a for (other, v), b in wanted.items() if other == lang and len(v) > len(w) and w in (v[:2], v[1:])):
            scored[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in scored.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_collocations_match_counters(spark, block):
    rng = random.Random(4)
    words = ["New", "york", "the", "é", "日本", "a\x00b", "\x1f", "TOKEN", "x", "of", "\u00a0"]
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", None, "und", "d\ne", ""])
        rows.append((lang, "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", "\n", " ", " "]) for _ in range(rng.choice([0, 1, 2, 30])))))
    rows += [("en", None), (None, None), ("en", "hot pair " * 30_000), ("en", "z" * 300_000), ("en", "   .,;"), *[("en", "y" * 3000 + " q")] * 12]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, rank int, phrase string").repartition(6)
    got = sorted(tuple(r) for r in collocations.collocations(frame, top=100, block=block).collect())
    assert got == _slow_collocations(rows, 10, 50, 100)
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_many_candidates_take_no_more_passes_over_the_texts(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(200)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").mapInArrow(counted, "lang string, text string")
    got = sorted(tuple(r) for r in collocations.collocations(frame, block=8).collect())
    assert got == _slow_collocations([("en", t) for t in texts], 10, 50, 2000) and len(got) > 8 * 10
    assert read.value == 4 * len(texts)  # one to count words, two to sieve, one to count phrases


def test_phrases_are_told_by_bytes_where_their_hashes_clash(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 12, "text": ["a b. c d. a b."] * 12})
    monkeypatch.setattr(collocations, "_phrase_hashes", lambda words, lang, width: np.full(len(words), 7 << 40, np.uint64))
    shared = SimpleNamespace(value={2: np.full(1 << (collocations._BITS - 3), 255, np.uint8)})
    packed = pa.Table.from_batches(collocations._pack([batch], 1, shared))
    assert collocations._count(packed, 10, 1).to_pylist() == [{"lang": "en", "phrase": p, "width": 2, "f": f} for p, f in (("a b", 24), ("c d", 12))]


def test_double_array_finds_all_keys():
    rng = random.Random(2)
    keys = sorted({("en\n" + " ".join(rng.choice("ab\x00\xff") * rng.randint(1, 3) for _ in range(rng.randint(1, 3))) + " ").encode() for _ in range(200)})
    trie = collocations.Trie(*collocations._bytes_of(pa.chunked_array([pa.array(keys[:50], pa.binary()), pa.array(keys[50:], pa.binary())])))
    for i, k in enumerate(keys):
        assert trie.accept[trie.root(k)] == i
    assert trie.root(keys[0] + b"?") == -1 and collocations.Trie(*collocations._bytes_of(pa.chunked_array([], pa.binary()))).root(b"a") == -1


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_collocations", "op13_prefix_trie"])
def test_registered_queries_take_clashing_columns_and_empty_tables(spark, tmp_path, name):
    rows = [(i // 3, i % 3, "user", f"some text {i % 5}", *range(8)) for i in range(60)]
    extra = ", ".join(f"{c} int" for c in ("segment", "window", "node", "h", "f", "n", "bucket", "id"))
    for at, own in (("a", rows), ("b", [])):
        spark.createDataFrame(own, "conv_id long, turn int, role string, text string, " + extra).write.parquet(str(tmp_path / at / "conversations.parquet"))
        spark.createDataFrame([("en", r[3], *r[4:]) for r in own], "lang string, text string, " + extra).write.parquet(str(tmp_path / at / "documents.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path / "a")).count() > 0
    assert queries.QUERIES[name](spark, str(tmp_path / "b")).count() == (1 if name == "op11_chat_format" else 0)
