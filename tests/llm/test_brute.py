"""Substring dedup against a byte-by-byte version, the quality classifier on labelled texts, and registered queries on clashing columns."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from plumbline.llm import quality, queries, substring_dedup


def _chunks(text):
    """Ends of the chunks of one text in bytes, by a loop over its bytes."""
    raw, cuts, hashes, h, last = text.encode(), [], [], 0, None
    for i, byte in enumerate(raw):
        h = ((h << 1) + int(substring_dedup._GEAR[byte])) & 0xFFFF
        hashes.append(h)
        place = i + 1
        if h >> 12 == 0 and place >= 16:
            if (last is None or place - last >= 8) and place < len(raw) and raw[place] & 0xC0 != 0x80:
                cuts.append(place)
            last = place
    out, before = [], 0
    for cut in [*cuts, len(raw)] if raw else []:
        while cut - before > 512:
            # of the greatest hashes at 64 to 512 bytes, the first at a character's end
            places = [p for p in range(before + 64, before + 513) if raw[p] & 0xC0 != 0x80]
            before = max(places, key=lambda p: (hashes[p - 1], -p))
            out.append(before)
        out.append(cut)
        before = cut
    return out


def _plain(rows, min_words):
    """repeated and removed spans, in bytes, of each (id, text)."""
    places = defaultdict(list)
    chunks = {}
    for i, text in rows:
        raw, begin, own = (text or "").encode(), 0, []
        for k, end in enumerate(_chunks(text or "")):
            own.append((begin, end))
            places[xxhash.xxh3_128_digest(raw[begin:end])].append((i, k))
            begin = end
        chunks[i] = own
    again = {p for ps in places.values() if len(ps) > 1 for p in ps}
    later = {p for ps in places.values() for p in sorted(ps)[1:]}
    out = {}
    for i, text in rows:
        raw, spans = (text or "").encode(), []
        for chosen in (again, later):
            runs, current = [], None
            for k, (a, z) in enumerate(chunks[i]):
                if (i, k) in chosen:
                    current = (current[0], z) if current else (a, z)
                elif current:
                    runs.append(current)
                    current = None
            spans.append([r for r in [*runs, *([current] if current else [])] if len(raw[r[0] : r[1]].split()) >= min_words])
        out[i] = spans
    return out


def test_substring_dedup_matches_a_byte_loop(spark):
    rng = np.random.default_rng(12)
    word = lambda: rng.choice(["alpha", "béta", "γάμμα", "delta-", "日本語", "x", "Epsilon.", "z" * 30]) + str(int(rng.integers(500)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60), text(25), text(90)]
    rows = []
    for i in range(60):
        parts = [text(int(rng.integers(0, 60)))]
        for p in rng.permutation(3)[: int(rng.integers(0, 3))]:
            parts += [passages[p], text(int(rng.integers(1, 20)))]
        rows.append((i, " ".join(parts)))
    rows += [(70, None), (71, ""), (72, rows[0][1]), (73, passages[0] + " " + passages[0]), (74, "日" * 900), (75, "y" * 3000)]
    want = _plain(rows, 10)
    found = substring_dedup.substring_dedup(spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, key int, marks string").repartition(4), min_words=10)
    for r in found.collect():
        text = dict(rows)[r.doc_id] or ""
        in_bytes = [[(len(text[: s.start].encode()), len(text[: s.end].encode())) for s in spans] for spans in (r.repeated, r.removed)]
        assert in_bytes == want[r.doc_id], r.doc_id
        assert r.n_chunks == len(_chunks(text))
        kept, at = "", 0
        for s in r.removed:
            kept, at = kept + text[at : s.start], s.end
        assert (r.kept_text or "") == kept + text[at:]


def test_substring_dedup_merges_common_chunks_across_slices(spark, monkeypatch):
    """The same result whether chunks are sent at once, wait for later slices, or outnumber those that may wait."""
    rng = np.random.default_rng(4)
    common = " ".join(f"common{i} line" for i in range(40))
    rows = [(int(i), f"{common} {' '.join(map(str, rng.integers(0, 10**6, 30)))} {common if i % 3 else ''}") for i in rng.permutation(120)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part])], ["key", "t"])
    batches = [batch(rows[i : i + 10]) for i in range(0, 120, 10)]
    want = {i: _plain(rows, 10)[i] for i, _ in rows}
    marks = []
    for held, waiting in ((1 << 19, 1 << 16), (100, 1 << 16), (100, 3), (1, 1)):
        monkeypatch.setattr(substring_dedup, "_HELD", held)
        monkeypatch.setattr(substring_dedup, "_COMMON", waiting)
        posted = list(substring_dedup._posted(iter(batches)))
        settled = pa.Table.from_batches(list(substring_dedup._settled(iter(posted)))).to_pylist()
        marks.append(defaultdict(set))
        for r in settled:
            marks[-1][r["key"]].add(r["mark"])
        assert sum(map(len, marks[-1].values())) == len(settled)
        # chunks that all texts have leave the task once, if they may wait
        sent = Counter(r["digest"] for b in posted for r in b.to_pylist() if r["place"] & 3 != substring_dedup._LATER)
        assert waiting < 1 << 16 or {sent[d] for d in set.intersection(*map(_digests, dict(rows).values()))} == {1}
    assert marks[0] == marks[1] == marks[2] == marks[3]
    assert all(len(marks[0][i]) > 20 and spans[0] for i, spans in want.items())


def _digests(text):
    raw, ends = text.encode(), _chunks(text)
    return {int(np.frombuffer(xxhash.xxh3_128_digest(raw[a:z]), np.int64)[0]) for a, z in zip([0, *ends], ends, strict=False)}


@pytest.mark.parametrize("period", [1, 2, 3, 5, 8, 13])
def test_substring_dedup_matches_periodic_text(spark, period):
    """A long passage of a few words over and over is found in other surroundings, but for its edges."""
    rng = np.random.default_rng(period)
    words = lambda n: " ".join(f"w{rng.integers(10**6)}" for _ in range(n))
    passage = " ".join([words(period)] * (600 // period))
    rows = [(i, f"{words(30 + i)} {passage} {words(20)}") for i in range(3)] + [(7, words(300))]
    found = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[7].repeated == []
    for i in (1, 2):
        removed = sum(s.end - s.start for s in found[i].removed)
        assert len(passage) - 1100 < removed <= len(passage) + 100


def test_quality_on_labelled_documents(spark):
    """Labels play no part in the fit: nearly all fine documents stay, nearly all low ones go."""
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = {r.doc_id: r.accepted for r in quality.classify(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    fine, low = ([judged[i] for i, q in labels.items() if q == which and i in judged] for which in (1, 0))
    assert len(fine) > 100 and np.mean(fine) > 0.99 and len(low) > 20 and np.mean(low) < 0.05


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_jaccard_join", "op3_exact_dedup", "op4_packing", "op5_decontaminate", "op6_lm_score", "op9_quality", "op10_sharding"])
def test_registered_queries_take_tables_with_columns_of_their_own_names(spark, tmp_path, name):
    rows = [(i, f"Some text number {i % 7} that stands in more rows than one. It goes on a little.", *range(12)) for i in range(40)]
    clashing = ["row", "id", "t", "n", "_row", "quality", "votes", "n_words", "component_id", "keep_id", "slot", "hash"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in clashing))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", "text number 3 that stands in more rows than one", 1)], "item_id string, text string, n_hit int").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(40)) and len(got) >= 40
    if name == "op3_exact_dedup":
        assert sum(r.kept for r in got) == 7
        assert all(r.text_sha256 == hashlib.sha256(rows[r.doc_id][1].lower().encode()).hexdigest() for r in got)


@pytest.mark.parametrize("name", ["op7_url_filter", "op8_html_extract"])
def test_registered_queries_over_pages_with_clashing_columns(spark, tmp_path, name):
    rows = [(i, f"http://www.example.com/en/{i}", f"<article><p>Text {i}.</p></article>", *range(10)) for i in range(30)]
    clashing = ["id", "host", "path", "rule", "key", "block", "best", "texts", "winner", "text"]
    spark.createDataFrame(rows, "page_id long, url string, html string, " + ", ".join(f"{c} int" for c in clashing)).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.page_id for r in got} == set(range(30)) and len(got) == 30
    assert all(r.verdict == "allow" and r.rule == "www.example.com/en/" for r in got) if name == "op7_url_filter" else all(r.text == f"Text {r.page_id}." for r in got)


@pytest.mark.parametrize("name", ["op2_jaccard_join", "op3_exact_dedup", "op5_decontaminate", "op6_lm_score", "op9_quality", "op10_sharding"])
def test_registered_queries_take_texts_of_megabytes(spark, tmp_path, name):
    long = " ".join(f"word{i % 5000}" for i in range(250_000))
    rows = [(0, long), (1, long), (2, long + " end"), (3, "x" * 2_000_000), (4, "a short text that stands alone"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", "word7 word8 word9 word10 word11 word12 word13 word14 word15 word16")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(6))
    if name == "op2_jaccard_join":
        assert [got[i].component_id for i in range(6)] == [0, 0, 0, 3, 4, 5] and got[0].n_shingles == 5000
    if name == "op3_exact_dedup":
        assert got[0].keep_id == got[1].keep_id == 1 and got[3].kept
    if name == "op5_decontaminate":
        assert got[0].n_words == 250_000 and got[0].n_hit == 500 and not got[3].contaminated
