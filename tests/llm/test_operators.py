"""The training-data operators against plain Python, and their defined cases."""

from __future__ import annotations

import collections
import gzip
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tallyspark.llm import backoff_lm, language_id, near_copies, packing, pieces, pii, pivots, quality_rules, toxicity, warc
from tallyspark.llm.components import components
from tallyspark.llm.meetings import connect as connect_members
from tallyspark.llm.queries import ORACLES, QUERIES, tokenizer
from tests.oracle import connect, difference

SMALL = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"
SPACES = re.compile("[ \t-\r]+")
LONG = "word " * 30_000 + "x" * 3_000
#: null ids and texts, empty and long texts, repeated rows, and a column whose name clashes with results
ODD = [
    (1, "", "a"), (2, None, "b"), (None, "text without an id " * 20, "c"), (4, LONG, None), (5, "same same", "d"), (5, "same same", "d"),
    (7, "\n\t ", ""), (8, "été 漢字 🙂 a@b.co <|endoftext|> İ", "e"), (9, "the cat sat on the mat and the dog ran to the end of it " * 6, "f"),
    (10, "the cat sat on the mat and the dog ran to the end of it " * 6, "g"),
]


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SPACES.split(low) if w]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    assert difference(connect(SMALL), QUERIES[name](spark, SMALL), ORACLES[name]) is None


def test_pipeline_runs_registered(spark):
    rows = queries()["pipeline"](spark, SMALL).collect()
    assert rows and {r.length for r in rows} and all(0 < r.length <= 2048 for r in rows)


def test_toxicity_held_out_and_odd_rows(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    machine = toxicity.train(docs, labels, toxicity.learnable())
    found = docs.join(labels, "doc_id").where(~toxicity.learnable()).select("toxic", toxicity.score(docs.text, machine, docs).alias("s")).collect()
    hits = sum(r.toxic == 1 and r.s >= 0.5 for r in found)
    assert hits >= 0.8 * sum(r.toxic for r in found) and sum(r.toxic == 0 and r.s >= 0.5 for r in found) <= 0.1 * hits
    scores = [r.s for r in odd.select(toxicity.score(odd.text, machine, odd).alias("s")).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[4] == scores[5]
    nothing = toxicity.train(empty, labels, toxicity.learnable())
    assert all(r.s < 1e-9 for r in odd.select(toxicity.score(odd.text, nothing, odd).alias("s")).collect())
    assert not odd.limit(0).select(toxicity.score(odd.text, machine, odd)).collect()


def test_toxicity_learns_interactions():
    settings = toxicity.Settings(min_deviation=-1, min_documents=1, epochs=200, decay=0.0)
    lengths, bins = np.array([1, 1, 2] * 40), np.array([1, 2, 1, 2] * 40, np.int32)
    machine = toxicity._fit(lengths, bins, np.array([0.0, 0.0, 1.0] * 40), settings)
    raw = machine.parts(np.array([0, 1, 2, 2]), np.array([0, 1, 0, 1]), 3)[0]
    assert raw[0] < 0 and raw[1] < 0 and raw[2] > 0 and machine.factors[0] @ machine.factors[1] > 0


def test_toxicity_learns_pairs_of_neutral_terms_as_registered():
    rng, kept, labels = np.random.default_rng(3), [], []
    for _ in range(4000):
        bins = set((1000 + rng.zipf(1.3, 60) % 3000).tolist())
        # 1 and 2 are as often in toxic texts as any word, and toxic only together
        together = rng.random() < 0.025
        one = together or rng.random() < 0.2
        two = together or (not one and rng.random() < 0.25)
        toxic = together or (not one and not two and rng.random() < 0.15)
        held = {1: one, 2: two, 3: toxic and not together}
        kept.append(sorted(bins | {b for b, is_held in held.items() if is_held}))
        labels.append(float(toxic))
    machine = toxicity._fit(np.array([len(x) for x in kept]), np.array([b for x in kept for b in x], np.int32), np.array(labels), toxicity.Settings())
    assert 1 in machine.bins and 2 in machine.bins
    one, two = np.searchsorted(machine.bins, [1, 2])
    raw = machine.parts(np.array([0, 1, 2, 2]), np.array([one, two, one, two]), 3)[0]
    assert raw[0] < 0 and raw[1] < 0 and raw[2] > 0


def test_quality_rules_odd_rows(odd, empty):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.judge(odd).collect()}
    assert rows[(1, 0)].base_failed and rows[(2, 0)].base_failed and rows[(7, 0)].n_dup_lines == 0
    assert rows[(4, 30_001)].n_repeat_words == 30_000 and not rows[(4, 30_001)].kept
    assert quality_rules.keep(odd).columns == odd.columns and quality_rules.judge(empty).count() == 0


def test_quality_rules_keep_long_texts(spark):
    clean = " ".join(w for k in range(130_000) for w in ("the", f"word{k}"))
    row = quality_rules.judge(spark.createDataFrame([(1, clean)], "doc_id long, text string")).first()
    assert row.n_words == 260_000 and row.kept


def test_language_with_few_rows_keeps_its_terms(spark):
    rng = random.Random(8)
    large = [(i, "big", " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300))) for i in range(300)]
    small = [(1000 + i, "small", "zuzu zaza zuza wywy wawy zuzu") for i in range(4)]
    docs = spark.createDataFrame(large + small, "doc_id long, lang string, text string")
    model = language_id.train(docs, F.lit(True), language_id.Settings(max_terms=1000))
    assert sum(len(k) for k in model.keys) <= 1000
    places = [(i, w) for i, w in enumerate(["zuzu", "wywy", "zuza wawy"])]
    asked = spark.createDataFrame(places, "doc_id long, text string")
    found = [r.p.lang_pred for r in asked.select(language_id.predict(F.col("text"), model, asked).alias("p")).collect()]
    assert found == ["small"] * 3
    column = model.languages.index("small")
    words = np.exp(model.logs[language_id.WORD][:, column])
    assert (words > words.min() * 5).sum() >= 5  # its own five words are known as words


def test_pieces_equal_the_library():
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    model, library = pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    alphabet = "a's THE the ing tion    \t\n éÀß x!!'', 漢字日本 🙂<|>==--....0123456789(){}\\/ïаб"
    given = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", " ", " " * 37, "ab" * 400, LONG]
    counts, ids = zip(*((c, i) for _, c, i in pieces.encode(model, pa.array([*given, None]))))
    counts, ids = np.concatenate(counts), np.concatenate(ids)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert all(p.tolist() == library.encode(t) for p, t in zip(parts, given)) and not len(parts[-1])
    assert [b.decode() for b in pieces.decode(model, counts, ids)] == [*given, ""]


def test_pieces_refuse_models_without_merges(tmp_path):
    import sentencepiece

    lines = ["the cat sat on the mat", "a dog ran to the end of it", "cats and dogs sat and ran"] * 20
    for kind in ("unigram", "char", "word", "bpe"):
        name = str(tmp_path / kind)
        sentencepiece.SentencePieceTrainer.train(
            sentence_iterator=iter(lines), model_prefix=name, model_type=kind, vocab_size=30, hard_vocab_limit=False, minloglevel=2)
        if kind == "bpe":
            assert pieces.load(f"{name}.model")
        else:
            with pytest.raises(ValueError, match="not a BPE model"):
                pieces.load(f"{name}.model")


def test_pieces_odd_rows(odd, empty):
    path = tokenizer("piece_bpe_32k.model")
    rows = pieces.digest(odd, path).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows) and pieces.digest(empty, path).count() == 0


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    def luhn(digits: str) -> bool:
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0

    find = lambda pattern: re.finditer(pattern, text)
    out = [("email", *m.span()) for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    out += [("ip", *m.span()) for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in find(r"[0-9]([\x20-]?[0-9])+") if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= len(digits(m)) <= 15]


def test_pii_base_spans():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("a.@-+ 1234.5()%é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("1" * 100_000 + "." + "9" * 10_000) == []


def test_pii_contexts_add_spans_and_redact(spark, empty):
    seeds = [(k, f"reach me by phone: +1 (212) 555-{k:04d} today") for k in range(20)]
    docs = spark.createDataFrame([*seeds, (99, "reach me by phone: 4412-77 today"), (100, None), (100, None), (None, "no 5 data")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs).collect() if r.doc_id is not None}
    assert [(s.kind, s.start, s.end) for s in rows[99].spans] == [("phone", 19, 26)] and not rows[99].base and not rows[100].spans
    masked = pii.redact(docs).collect()
    assert len(masked) == docs.count() and {r.text for r in masked if r.doc_id == 99} == {"reach me by phone: <PHONE> today"}
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0


def test_packing_ids_and_pieces(spark, odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(2)
    alphabet = "a's 'S'T'LL'Ll 're've'd ''s 1²½ éÀßÿñ \u0085\t\n İıſ x'llama !'s ’ 漢字 🙂 <|endoftext|> ẞ Σς ǅ ́ é ª º µ"
    docs = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    docs += [(1000 + k, t) for k, (_, t, _) in enumerate(ODD)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()
    by_document, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_document[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in docs:
        ids, at = [*plain.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_document[doc_id], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(part) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for items in by_sequence.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(empty, path).count() == 0 and packing.pack(odd, path).where("doc_id = 5").count() >= 2


@pytest.mark.parametrize("blocks", [{}, {"list_block": 3, "group_block": 2}])
def test_near_copies_against_all_pairs(spark, blocks):
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(80)]
    docs = [(k, t) for k, (_, t, _) in enumerate(ODD)]
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(80)] = str(rng.randrange(10**6))
        docs.append((100 + k, " ".join(copy)))
    docs.append((200, docs[-1][1].upper()))
    settings = near_copies.Settings(words=3, percent=85, **blocks)
    sets = {}
    for k, text in docs:
        w = words(text)
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    reach = {k: k for k, _ in docs}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    reach[a] = min(reach[a], reach[b])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in near_copies.find(frame, settings).collect()}
    assert {k: r.component_id for k, r in found.items()} == reach and {k: r.n_shingles for k, r in found.items()} == {k: len(s) for k, s in sets.items()}
    kept = {r.doc_id for r in near_copies.keep_one(frame, settings).collect()}
    assert kept == {k for k in reach if reach[k] == k}


def test_near_copies_odd_rows(odd, empty):
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == {1: 1, 2: 1, None: 1, 4: 1, 5: 1, 7: 1, 8: 1, 9: 1}
    assert near_copies.find(empty).count() == 0 and near_copies.keep_one(empty).count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_pivots_against_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + 0.12 * rng.normal(size=16)).tolist(), k % 2) for k in range(240)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], None), (503, None, 0), (504, [0.0] * 16, 0), (505, [float("nan")] * 16, 0),
             (506, [None] + [1.0] * 15, 0), (507, [], 1), (508, [1.0, 2.0], 1), (509, [2.0, 4.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in pivots.find(frame, pivots.Settings(block=block)).collect()}
    good = [(k, np.array(v), c) for k, v, c in rows if c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = collections.Counter()
    for a, u, c in good:
        for b, w, d in good:
            if a != b and c == d and len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= 0.93:
                links[a] += 1
    assert len(found) == len(rows) and sum(r.n_links for r in found.values()) >= 0.98 * sum(links.values())
    assert all(r.n_links <= links[k] for k, r in found.items()) and all(found[k].kept and not found[k].n_links for k in range(502, 508))
    assert pivots.find(frame.limit(0)).count() == 0


def test_warc_round_trip_index_and_ranges(spark):
    page = "<p>" + "ä" * 100
    rows = [(1, "http://a.example.com/x?y=1", page), (2, "http://b.example.com:80/", page), (3, None, None), (4, "u 1", ""), (5, "-", "short"), (6, "t\tb", "short"),
            (7, "http://a.example.com/x?y=1", "W" * 40_000_000), (8, "http://a.example.com/x?y=1", "\r\n\r\nWARC/1.1\r\n\0" * 20), (9, "http://b.example.com/", page)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("html", "html")
    folder, found = warc.archive(frame, warc.Settings(block=2))
    got = {r.page_id: r for r in found.collect()}
    for page_id, url, html in rows:
        payload = (html or "").encode()
        assert got[page_id].payload_digest == hashlib.sha256(payload).hexdigest() and got[page_id].payload_bytes == len(payload) and got[page_id].url == (url or "")
        assert (got[page_id].record_type, got[page_id].refers_to) == (("revisit", 1) if page_id in (2, 9) else ("response", None))
    hits = warc.lookup(spark, f"{folder}/index", frame.where("page_id IN (1, 5)").select("url")).collect()
    assert sorted(r.page_id for r in hits) == [1, 5, 7, 8]
    for r in hits:
        assert warc.read_record(spark, r.file, r.offset, r.length)[1] == rows[r.page_id - 1][2].encode()
    path = got[1].file.removeprefix("file:")
    with gzip.open(path) as file:
        assert file.read().startswith(b"WARC/1.1\r\n")
    assert warc.archive(frame.limit(0))[1].count() == 0


def test_language_held_out_and_odd_rows(spark, odd, empty):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    model = language_id.train(docs, ~language_id.held_out())
    found = docs.where(language_id.held_out()).select("lang", language_id.predict(docs.text, model, docs).alias("p")).collect()
    assert sum(r.lang == r.p.lang_pred for r in found) >= 0.97 * len(found)
    rows = odd.select("doc_id", language_id.predict(odd.text, model, odd).alias("p")).collect()
    assert all((r.p.lang_pred == "und") == (r.doc_id in (1, 2, 7)) and 0 <= r.p.score <= 1 for r in rows)
    nothing = language_id.train(empty.selectExpr("doc_id", "text", "score AS lang"), ~language_id.held_out())
    assert {r.p.lang_pred for r in odd.select(language_id.predict(odd.text, nothing, odd).alias("p")).collect()} == {"und"}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores_against_plain_counts(spark, texts, order):
    settings = backoff_lm.Settings(order=order, block_bytes=1 << 18)
    found = {r.doc_id: r for r in backoff_lm.score(spark.read.parquet(f"{MID}/documents.parquet"), settings).collect()}
    grams = lambda w: collections.Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    split = {k: words(t) for k, t in texts.items()}
    counts, total = collections.Counter(), sum(map(len, split.values()))
    for w in split.values():
        counts.update(grams(w))
    for k in list(split)[:40]:
        w, own, sum_ = split[k], grams(split[k]), 0.0
        rest = lambda g: counts[g] - own[g]  # noqa: B023, E731
        for i in range(len(w)):
            n, factor = min(order, i + 1), 1.0
            while n > 1 and rest(tuple(w[i - n + 1 : i + 1])) <= 0:
                n, factor = n - 1, factor * settings.backoff
            g = tuple(w[i - n + 1 : i + 1])
            value = rest(g) / rest(g[:-1]) if n > 1 else (rest(g) or 0.5) / max(total - len(w), 1)
            sum_ += math.log(factor * value)
        assert found[k].n_words == len(w) and math.isclose(found[k].log_score, sum_, rel_tol=1e-9)


def test_backoff_odd_rows(odd, empty):
    rows = backoff_lm.score(odd).collect()
    assert len(rows) == len(ODD) and all((r.mean_log_score is None) == (r.n_words == 0) for r in rows)
    assert backoff_lm.score(empty).count() == 0


def test_backoff_uses_three_words_as_registered(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x b d")], "doc_id long, text string")
    found = {r.doc_id: r.log_score for r in backoff_lm.score(docs).collect()}
    # a: 1 of 6 words, b after a: 1 of 1, c after a b: 1 of 1, though after b alone it is 1 of 2
    assert math.isclose(found[1], math.log(1 / 6)) and math.isclose(found[2], math.log(1 / 6))


def test_backoff_moves_texts_and_ngrams_once(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x b d")], "doc_id long, text string")
    scored = backoff_lm.score(docs, backoff_lm.Settings(block_bytes=8))
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in plan.splitlines() if re.search(r"- Exchange |ReusedExchange", line)]
    # texts, read twice; n-grams, for the count table and its join together; answers
    assert sum("ReusedExchange" in line for line in moved) == 1 and len(moved) == 4, plan


def test_backoff_messages_keep_every_ngram():
    rng = np.random.default_rng(4)
    for n, top in ((1, 1), (3, 1 << 62), (20_000, 1 << 63), (5_000, 1 << 20)):
        keys = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        counts = np.where(rng.random(len(keys)) < 0.8, 1, rng.integers(1, 1 << 20, len(keys)))
        several = (counts > 1) & (rng.random(len(keys)) < 0.5)
        sent = backoff_lm._messages(-7, keys, counts, several)
        order = rng.permutation(sent.num_rows)
        gram, block, place, times, documents = backoff_lm._unpacked(*sent.take(pa.array(order)).columns)
        assert (gram == keys[place]).all() and sorted(place.tolist()) == list(range(len(keys))) and set(block.tolist()) == {-7}
        assert (times == counts[place]).all() and (documents == 1 + several[place]).all()
        assert sent.num_rows <= backoff_lm._SLICES and (np.asarray(sent.column("slice")) == np.unique(keys >> backoff_lm._SLICE_BITS)).all()


def _peak(work) -> tuple[object, int]:
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_backoff_memory_is_that_of_a_block():
    rng = np.random.default_rng(5)
    names = np.array([f"w{k:x}" for k in range(60_000)])
    texts = pa.array([" ".join(names[rng.integers(0, len(names), 300)]) for _ in range(4_000)])
    found = backoff_lm.grams(texts, 3)
    n_grams = sum(int(f.sum()) for f in found.fits)
    backoff_lm._places(backoff_lm.grams(texts[:2], 3))  # modules that numpy and Arrow load at first use
    (size, places), peak = _peak(lambda: backoff_lm._places(found))
    assert peak < 24 * n_grams, peak / n_grams
    keys = np.unique(np.concatenate([h[f] for f, h in zip(found.fits, found.hashes)]))
    assert size == len(keys) and all((keys[p[f] - 1] == h[f]).all() and not p[~f].any() for f, h, p in zip(found.fits, found.hashes, places))
    sent, peak = _peak(lambda: pa.Table.from_batches(backoff_lm._sent(3, found)))
    assert peak < 24 * n_grams, peak / n_grams
    gram, _, place, _, _ = backoff_lm._unpacked(*(c.combine_chunks() for c in sent.columns))
    assert (gram == keys).all() and (place == np.arange(size)).all()
    again = sent.set_column(1, "block", pa.array(np.full(len(sent), 4)))
    both = pa.concat_tables([sent, again]).sort_by("slice").combine_chunks().to_batches()
    summed, peak = _peak(lambda: sum(b.num_rows for b in backoff_lm._counted(iter(both))))
    assert summed == 2 * size and peak < 24 * 2 * size, peak / (2 * size)


def test_backoff_portions_and_stretches_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abcdefgh"), n)) for n in (0, 1, 2, 700, 0, 90, 1, 0)]
    split = [words(t) for t in texts]
    counts = collections.Counter(tuple(w[i : i + n]) for w in split for n in (1, 2, 3) for i in range(len(w) - n + 1))
    results = []
    for together, rows in ((1 << 18, 500), (1, 1), (64, 3)):
        monkeypatch.setattr(backoff_lm, "_TOGETHER", together)
        monkeypatch.setattr(backoff_lm, "_ROWS", rows)
        found = backoff_lm.grams(pa.array(texts), 3)
        messages = pa.Table.from_batches(backoff_lm._sent(9, found)).combine_chunks()
        counted = pa.Table.from_batches(backoff_lm._counted(iter(messages.to_batches(max_chunksize=7))))
        size, places = backoff_lm._places(found)
        assert size == len(counts)
        times = np.zeros(size + 1)
        times[0] = sum(map(len, split))
        times[np.asarray(counted["place"]) + 1] = np.asarray(counted["times"])
        assert sorted(times[1:][times[1:] > 0]) == sorted(
            v for g, v in counts.items() if sum(any(tuple(w[i : i + len(g)]) == g for i in range(len(w))) for w in split) > 1
        )
        sums = backoff_lm._sums(found, places, times, np.array([len(w) for w in split]), backoff_lm.Settings())
        size = next(backoff_lm._sizes(iter([pa.RecordBatch.from_pydict({"text": pa.array([*texts, None])})])))
        assert size.to_pydict() == {"words": [times[0]], "bytes": [sum(map(len, texts))]}
        results.append(sums.tolist())
    assert results[0] == results[1] == results[2] and np.isfinite(results[0]).all()


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001), (5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(201)}, 1000: 1000, 1001: 1000}


def test_connect_loses_no_link_and_spares_what_is_connected(spark):
    rng = random.Random(3)
    # one large component, small ones linked to it or to each other by a single link, and single nodes
    links = [(0, k) for k in range(1, 120)] + [(rng.randrange(120), k) for k in range(120, 140)] + [(k, k + 1) for k in range(140, 180, 2)]
    reach = {k: k for k in range(200)}
    for _ in range(5):
        for a, b in links:
            reach[a] = reach[b] = min(reach[a], reach[b])
    table = spark.createDataFrame([*links, *[(b, a) for a, b in links]], "a long, b long").cache()
    dealt = []

    def compare(members, few):
        dealt.append(members.count())
        left, right = (members.select("key", "i", "j", F.col("node").alias(side)) for side in "ab")
        return left.join(right, ["key", "i", "j"]).join(table, ["a", "b"]).select("a", "b")

    members = spark.createDataFrame([(7, k) for k in range(200)] + [(8, 0), (8, 199), (9, 5)], "key long, node long")
    found = {r.node: r.component for r in connect_members(members, "key", 10, compare).collect()}
    assert all(found.get(k, k) == reach[k] for k in reach)
    # all pairs of 20 blocks would deal each of the 200 members 19 times
    assert dealt[0] == 200 + 4 * 19 + 2 and sum(dealt) < 200 * 19
    assert connect_members(members.limit(0), "key", 10, compare).count() == 0


def test_pii_contexts_are_whole_words_on_either_side():
    far = " " * 500
    word = "w" * 300
    assert pii._context(f"{word}{far}id7{far}{word} x", 800, 803) == (word, word)
    assert pii._context("id7 after", 0, 3) == ("", "after") and pii._context("before id7", 7, 10) == ("before", "")
    assert [p for _, p, *_ in pii._candidates("id7 after", [])] == ["* after"]
    assert [p for _, p, *_ in pii._candidates("a id7 z", [])] == ["a *", "* z", "a * z"]


def test_pii_learns_from_the_word_after(spark):
    rng = random.Random(2)
    seeds = [(i, f"{rng.choice('abcdefgh')}{i} u{i}@mail.com verified filler") for i in range(40)]
    unseen = [(100 + i, f"{rng.choice('abcdefgh')}{i} user{i}77 verified filler") for i in range(3)]
    docs = spark.createDataFrame(seeds + unseen, "doc_id long, text string")
    found = {r.doc_id: {s.kind for s in r.spans} for r in pii.find(docs).collect()}
    assert all(len(found[100 + i]) >= 1 for i in range(3))
